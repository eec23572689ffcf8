"""Near-duplicate documents by SuperMinHash signatures, banding, verification and union-find.

A document's set holds its distinct shingles of `size` words (A-Z lower-cased; with fewer words the whole
sequence), as 64-bit hashes. Equal sets are one class, known by the digest of the set; only classes go on.

Signatures. Each element shuffles the VALUES places of a signature step by step: in step j it offers j plus a
fraction of its own to the next place of its shuffle, and a place keeps the least offer. An element offers each
place once, so places are covered evenly and agree less by chance than with independent hashes. A set is done
when no place holds more than the steps already made, which is after one step for long texts.

Banding. BAND values form a band; classes that agree in one are a bucket. Classes linked at a similarity of 0.8
miss each other in all bands with a probability below 1e-5. Buckets with the same classes count once.

Verification. Each class is first compared, on whole sets, with the most central class of its buckets: the one
that most others meet. What is linked to such a centre is one part. Buckets that still hold several parts are
compared in full, in jobs of bounded blocks of their classes: pairs of different parts, whose signatures agree
in LEAST or more values and that met in no earlier band, are verified on whole sets. A job's union-find leaves
out what its links have already joined and keeps a forest; no pairs leave a job but these links. The forests of
all jobs are joined by alternating stars.

Null and empty texts have no shingles and are linked with nothing. Rows that share an id and have different
sets are documents of their own; the id of a component is the smallest id in it. Rows without an id have no
component, link nothing and are kept. Extra columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaline.llm.common import batches_out, bitmap_of, chosen, slot_of
from vitaline.llm.graph import components
from vitaline.llm.jaccard import shingle_sets
from vitaline.session import cut

VALUES = 150
BAND = 5
LEAST = 94  # of VALUES: linked pairs agree in 120 on average, and in fewer than this less than once in a million
TOGETHER = 100_000  # elements whose shuffles are held at once
FOLLOWERS = 200  # classes compared with one copy of their centre, on average
BLOCK = 512  # classes of a block
BLOCK_WEIGHT = 1_000_000  # shingles of a block, on average

_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _signed(sets: list[np.ndarray], values: int) -> np.ndarray:
    """Signatures of sets that are not empty: the step in the high 32 bits, the fraction in the low ones."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    elements = np.concatenate(sets)
    out = np.full(len(sets) * values, _FULL)
    shuffles = None
    for step in range(values):
        drawn = _mixed(elements + np.uint64((step + 1) * _STEP & 0xFFFFFFFFFFFFFFFF))
        other = step + ((drawn >> np.uint64(32)) % np.uint64(values - step)).astype(np.int64)
        offer = (np.uint64(step) << np.uint64(32)) | (drawn & np.uint64(0xFFFFFFFF))
        if not step:
            places = other
        else:
            row = np.arange(len(elements))
            if shuffles is None:  # swap the first step's place to the front, as all later ones are
                shuffles = np.tile(np.arange(values, dtype=np.uint8), (len(elements), 1))
                shuffles[row, places] = 0
                shuffles[:, 0] = places
            places = shuffles[row, other].astype(np.int64)
            shuffles[row, other] = shuffles[:, step]
            shuffles[:, step] = places
        np.minimum.at(out, owner * values + places, offer)
        going = (out.reshape(-1, values).max(axis=1) >= np.uint64((step + 1) << 32))[owner]
        if not going.any():
            break
        if not going.all():
            owner, elements, places = owner[going], elements[going], places[going]
            shuffles = shuffles if shuffles is None else shuffles[going]
    return out.reshape(-1, values)


def signatures(sets: list[np.ndarray], values: int = VALUES) -> np.ndarray:
    """One row of `values` (up to 256) a set; sets must not be empty."""
    rows, start, held = [np.zeros((0, values), np.uint64)], 0, 0
    for i, s in enumerate(sets):
        if held and held + len(s) > TOGETHER:
            rows.append(_signed(sets[start:i], values))
            start, held = i, 0
        held += len(s)
    if start < len(sets):
        rows.append(_signed(sets[start:], values))
    return np.concatenate(rows)


def bands(signed: np.ndarray, band: int = BAND) -> np.ndarray:
    """A hash of each whole band of each row."""
    count = signed.shape[1] // band
    groups = signed[:, : count * band].reshape(len(signed), count, band)
    out = np.zeros(groups.shape[:2], np.uint64)
    for i in range(band):
        out = _mixed((out ^ groups[:, :, i]) + np.uint64(_STEP))
    return out


def _digest(s: np.ndarray) -> bytes:
    return hashlib.md5(s.tobytes()).digest()


def _overview(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n, digest and bands of every row; bands are null for empty sets."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            sets = shingle_sets(b.column("text").to_pylist(), size)
            filled = np.array([len(s) > 0 for s in sets], bool)
            values: list = [None] * len(sets)
            hashes = bands(signatures([s for s in sets if len(s)])).view(np.int64)
            for i, row in zip(np.flatnonzero(filled).tolist(), hashes, strict=True):
                values[i] = row
            yield {"doc_id": b.column("doc_id"), "n": [len(s) for s in sets], "digest": list(map(_digest, sets)), "bands": values}

    return cut(batches_out(docs.select("doc_id", "text"), run, f"doc_id {kind}, n long, digest binary, bands array<long>"))


def _contents(docs: DataFrame, size: int, wanted: DataFrame, signed: bool = False) -> DataFrame:
    """digest, content (the packed set) of the classes of `wanted` (doc_id, digest); `signed` adds signature (16
    bits a value) and bands (32 bits each)."""
    bits = 1 << min(max(int(wanted.count() * 16).bit_length(), 20), 27)
    bitmap = bitmap_of(wanted, "doc_id", bits=bits)
    slotted = docs.withColumn("slot", slot_of("doc_id", bits=bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            sets = [s for s in shingle_sets(chosen(b, bitmap).column("text").to_pylist(), size) if len(s)]
            rows = {"digest": list(map(_digest, sets)), "content": [s.tobytes() for s in sets]}
            if signed:
                values = signatures(sets)
                rows["signature"] = [row.tobytes() for row in values.astype(np.uint16)]
                rows["bands"] = [row.tobytes() for row in bands(values).astype(np.uint32)]
            yield rows

    extra = ", signature binary, bands binary" if signed else ""
    found = batches_out(slotted.select("text", "slot"), run, f"digest binary, content binary{extra}")
    found = found.join(wanted.select("digest"), "digest", "left_semi")
    return found.groupBy("digest").agg(*[F.first(c).alias(c) for c in found.columns[1:]])


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 |x & y| >= percent |x | y|, for sorted distinct values."""
    if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
        return False
    same = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * same >= percent * (len(x) + len(y) - same)


def _set(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.uint64)


def _with_centre(pairs: DataFrame, contents: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are linked; every a has one b.

    A centre b meets its classes in streams of about FOLLOWERS, each headed by the centre's own set.
    """
    centres = pairs.groupBy("b").agg(F.ceil(F.count("*") / FOLLOWERS).alias("streams"))
    deal = F.pmod(F.xxhash64("a"), F.col("streams"))
    roles = pairs.join(centres, "b").select(F.col("a").alias("digest"), "b", deal.alias("stream"), F.lit(1).alias("place"))
    heads = F.explode(F.sequence(F.lit(0).cast("long"), F.col("streams") - 1))
    roles = roles.unionAll(centres.select(F.col("b").alias("digest"), "b", heads.alias("stream"), F.lit(0).alias("place")))
    rows = contents.join(roles, "digest").repartition("b", "stream").sortWithinPartitions("b", "stream", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        head = np.zeros(0, np.uint64)
        for batch in batches:
            out: dict[str, list] = {"a": [], "b": []}
            for row in batch.to_pylist():
                if not row["place"]:
                    head = _set(row["content"])
                elif _linked(_set(row["content"]), head, percent):
                    out["a"].append(row["digest"])
                    out["b"].append(row["b"])
            yield out

    return batches_out(rows.select("digest", "b", "place", "content"), run, "a binary, b binary")


class _Forest:
    """Union-find over the parts of a job."""

    def __init__(self, n: int):
        self.above = list(range(n))

    def find(self, x: int) -> int:
        while self.above[x] != x:
            self.above[x] = self.above[self.above[x]]
            x = self.above[x]
        return x

    def join(self, x: int, y: int) -> None:
        self.above[self.find(x)] = self.find(y)


def _job_links(table: pa.Table, percent: int) -> Iterator[tuple[bytes, bytes]]:
    """Links of a job that join different parts: block `low` against block `high`, or within one block."""
    job = table.slice(0, 1).to_pylist()[0]
    digests, contents = table["digest"].to_pylist(), table["content"].to_pylist()
    signed = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint16).reshape(len(digests), -1)
    early = np.frombuffer(b"".join(table["bands"].to_pylist()), np.uint32).reshape(len(digests), -1)[:, : job["band"]]
    block = table["block"].to_numpy()
    _, part = np.unique(np.array(table["part"].to_pylist(), dtype=object), return_inverse=True)
    sizes = np.array([len(c) for c in contents])
    forest = _Forest(int(part.max()) + 1)
    # order by size, so that only a stretch of the others can be similar enough
    order = np.argsort(sizes, kind="stable")
    signed, early, block, part, sizes = signed[order], early[order], block[order], part[order], sizes[order]
    for x in range(len(order)):
        end = np.searchsorted(sizes, sizes[x] * 100 // percent, side="right")
        others = np.arange(x + 1, end)
        others = others[part[others] != part[x]]
        if job["low"] != job["high"]:
            others = others[block[others] != block[x]]
        others = others[(signed[others] == signed[x]).sum(axis=1) >= LEAST]
        others = others[~(early[others] == early[x]).any(axis=1)]
        for y in others.tolist():
            if forest.find(part[x]) != forest.find(part[y]) and _linked(
                _set(contents[order[x]]), _set(contents[order[y]]), percent
            ):
                forest.join(part[x], part[y])
                yield digests[order[x]], digests[order[y]]


def _in_blocks(members: DataFrame, contents: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different parts within the buckets of `members` (band, value, digest, part, size, weight)."""
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("weight") / BLOCK_WEIGHT))
    dealt = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select(
        "band", "value", "digest", "part", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    )

    def run(table: pa.Table) -> pa.Table:
        found = list(_job_links(table, percent))
        return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

    rows = dealt.join(contents, "digest")
    return rows.groupBy("band", "value", "low", "high").applyInArrow(run, "a binary, b binary")


def _buckets(classes: DataFrame) -> DataFrame:
    """band, value, digest, doc_id, n, size, weight, times for the buckets of two classes or more.

    Of buckets with the same classes there is the one of the lowest band, `times` being their number.
    """
    postings = classes.select("digest", "n", "doc_id", F.posexplode("bands").alias("band", "value"))
    mark = F.xxhash64("digest")
    groups = postings.groupBy("band", "value").agg(
        F.count("*").alias("size"),
        F.sum("n").alias("weight"),
        F.bit_xor(mark).alias("mark"),
        F.bit_xor(F.xxhash64(mark, F.lit(1))).alias("mark2"),
    )
    groups = groups.where("size > 1").groupBy("size", "weight", "mark", "mark2")
    groups = groups.agg(F.min(F.struct("band", "value")).alias("first"), F.count("*").alias("times"))
    groups = groups.select("first.*", "size", "weight", "times")
    return postings.join(groups, ["band", "value"])


def _centres(buckets: DataFrame) -> DataFrame:
    """Pairs (a, b): each class with the centre it has the most buckets in common with."""
    met = buckets.groupBy("digest").agg(F.sum(F.col("size") * F.col("times")).alias("met"))
    known = buckets.join(met, "digest")
    centre = known.groupBy("band", "value").agg(F.max(F.struct("met", "digest")).alias("centre"))
    pairs = buckets.join(centre, ["band", "value"]).where("centre.digest <> digest")
    pairs = pairs.groupBy("digest", "centre").agg(F.sum("times").alias("common"))
    best = pairs.groupBy("digest").agg(F.max(F.struct("common", "centre")).alias("best"))
    return best.select(F.col("digest").alias("a"), F.col("best.centre.digest").alias("b"))


def near_duplicates(docs: DataFrame, size: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links) and kept of every row.

    VALUES, BAND and LEAST suit a `percent` of 80 or more.
    """
    docs = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    rows = _overview(docs, size)
    classes = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("digest")
    classes = cut(classes.agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    buckets = cut(_buckets(classes))
    ids = classes.select("doc_id", "digest")

    pairs = cut(_centres(buckets))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct()
    first = cut(_with_centre(pairs, _contents(docs, size, ids.join(wanted, "digest")), percent))

    parts = components(first).select(F.col("node").alias("digest"), F.col("component").alias("part"))
    placed = buckets.join(parts, "digest", "left").withColumn("part", F.coalesce("part", "digest"))
    placed = cut(placed.select("band", "value", "digest", "doc_id", "part", "size", "weight"))
    several = placed.groupBy("band", "value").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high")
    members = cut(placed.join(several.select("band", "value"), ["band", "value"], "left_semi"))
    wanted = members.select("doc_id", "digest").distinct()
    second = cut(_in_blocks(members, _contents(docs, size, wanted, signed=True), percent))

    found = components(first.unionAll(second)).withColumnRenamed("node", "digest")
    grouped = classes.select("digest", "doc_id").join(found, "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    smallest = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    known = grouped.join(smallest, "component").select("digest", "component_id")
    out = rows.join(known, "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), _component().alias("component_id"), _kept().alias("kept"))


def _component() -> Column:
    return F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))


def _kept() -> Column:
    return F.coalesce(F.col("doc_id") == _component(), F.lit(True))


def sql(size: int, kept: bool = False) -> str:
    """What near-duplicate queries return, in SQL: every pair that shares a shingle, and labels spread over links."""
    last = ", doc_id = component_id AS kept" if kept else ""
    return rf"""
WITH RECURSIVE
words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < {size} THEN [array_to_string(w, ' ')]
                      ELSE list_distinct([array_to_string(w[i:i + {size - 1}], ' ') FOR i IN range(1, len(w) - {size - 2})]) END AS s
  FROM words),
classes AS (SELECT min(doc_id) AS id, s FROM (SELECT doc_id, list_sort(s) AS s FROM sets WHERE len(s) > 0) GROUP BY s),
shingles AS (SELECT id, len(s) AS n, unnest(s) AS x FROM classes),
links AS (
  SELECT a.id AS a, b.id AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.id < b.id
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
near AS (SELECT a AS node, b AS other FROM links UNION ALL SELECT b, a FROM links),
reach(node, root) AS (
  SELECT id, id FROM classes
  UNION
  SELECT near.other, reach.root FROM reach JOIN near USING (node) WHERE reach.root < near.other),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
placed AS (
  SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(root, doc_id) AS component_id
  FROM sets LEFT JOIN classes ON classes.s = list_sort(sets.s) LEFT JOIN roots ON node = id)
SELECT doc_id, n_shingles, component_id{last} FROM placed
"""


SQL = sql(4, kept=True)
