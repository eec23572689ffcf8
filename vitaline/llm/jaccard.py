"""Near-duplicate documents by Jaccard similarity of word shingles, joined through a token-group matrix.

A document's set holds its distinct shingles of `size` words (A-Z lower-cased; with fewer words the whole
sequence), as 64-bit hashes. Equal sets are one class; only one representative of each goes on.

Grouping. Shingles have one order: ordinary ones by hash, frequent ones last. Two sets that are similar
enough share at least l(n) shingles of their prefixes, n - ceil(s n) + l(n) shingles long in that order, with
l(n) = n // 20 + 1 for the smaller n. Sets with a shingle of their prefixes in common are partitioned by
their leaders: each set is compared with the smallest set that shares most of its prefix. Those linked to it
make parts; those that are not stay beside it, as sets that resemble each other. Both kinds are cut into groups
of at most GROUP sets and GROUP_SHINGLES shingles on average.

Token-group matrix. For shingles that several parts still share, the matrix has a row (shingle, group) for
each group whose sets have it. A set meets its own group of unlinked sets, and the groups of larger parts,
through its own prefix shingles; the shingles it shares with a group's union bound what it can share with any
member. For groups that reach l, the union of the whole sets is stored, by 16 bits of each shingle, which can
only raise the bound: if 100 |Q & union| >= 100 s |Q| the group is opened and its members are compared one by
one. Unions and members are sent once to each stream of sets that meet the group. All comparisons that make
links are exact, and no link between different parts is lost, so the parts joined by these links are the
components.

Frequent shingles are found by counting blocks of documents (see `frequent`); which ones are found changes
the order, never the result; the OFTEN most frequent are kept. No step has all pairs of a group: classes, parts and groups stand for copies.

Null and empty texts have no shingles and are linked with nothing. Rows that share an id are one document in
links, with the shingles of each; rows without an id have no component. Extra columns are ignored, an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaline.llm.common import batches_out, bitmap_of, chosen, slot_of
from vitaline.llm.graph import components
from vitaline.session import cut

GROUP = 64  # sets of a group, on average
GROUP_SHINGLES = 1 << 20  # shingles of the sets of a group, on average
FOLLOWERS = 256  # sets compared with one copy of their leader or group, on average
OFTEN = 500_000  # frequent shingles the order knows of
BLOCK = 4_000_000  # shingles counted together to find frequent ones
LOCAL = 8  # documents of a block that must have a shingle for it to be counted on
FREQUENT = 50  # documents from which on a shingle counts as frequent
PORTION = 1 << 17  # bytes of texts whose shingles are worked out together
LONG_WORD = 64  # bytes from which on the rest of a word is hashed by itself
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # masks of the first bytes


def _mixed(h: np.ndarray) -> np.ndarray:
    """One-to-one, so that words of one length and at most 8 bytes never share a hash."""
    h = h * _STEPS[0]
    h ^= h >> np.uint64(32)
    h *= _STEPS[1]
    return h ^ (h >> np.uint64(29))


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the words of a text, and 64-bit hashes of their length and bytes, taken eight by eight."""
    data = np.frombuffer(text + b" " * 8, np.uint8)
    inside = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    hashes = _mixed(_mixed(sizes.astype(np.uint64)) ^ (eight[starts] & _FIRST[np.minimum(sizes, 8)]))
    at, rest = 8, np.flatnonzero(sizes > 8)
    while len(rest) and at < LONG_WORD:
        hashes[rest] = _mixed(hashes[rest] ^ (eight[starts[rest] + at] & _FIRST[np.minimum(sizes[rest] - at, 8)]))
        at += 8
        rest = rest[sizes[rest] > at]
    for i in rest.tolist():
        hashes[i] ^= np.uint64(xxhash.xxh3_64_intdigest(text[starts[i] : starts[i] + sizes[i]]))
    return starts, hashes


def _rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    out = np.full(max(len(hashes) - size + 1, 0), size, np.uint64)
    for i in range(size):
        out = (out ^ hashes[i : len(out) + i]) * _STEPS[i % 4]
        out ^= out >> np.uint64(31)
    return out


def shingle_sets(texts: list[bytes | None], size: int = 5) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its shingles; texts are worked out together, PORTION bytes at a time."""
    out: list[np.ndarray] = []
    first, total = 0, 0
    for last, text in enumerate(texts, 1):
        total += len(text or b"")
        if total > PORTION or last == len(texts):
            out += _sets_of([t or b"" for t in texts[first:last]], size)
            first, total = last, 0
    return out


def _sets_of(texts: list[bytes], size: int) -> list[np.ndarray]:
    starts, hashes = word_hashes(b"\n".join(texts).lower())
    ends = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts])).tolist()
    found = _rolled(hashes, size)
    cuts, low = [], 0
    for high in ends:
        cuts.append((low, max(high - size + 1, low)))
        found[low : cuts[-1][1]].sort()
        low = high
    new = np.append(True, found[1:] != found[:-1])
    out, low = [], 0
    for (start, end), high in zip(cuts, ends, strict=True):
        if start < end:
            new[start] = True
            out.append(found[start:end][new[start:end]])
        else:  # the whole sequence, or nothing
            out.append(_rolled(hashes[low:high], high - low) if high > low else np.zeros(0, np.uint64))
        low = high
    return out


def _overview(docs: DataFrame, size: int) -> DataFrame:
    """Rows (doc_id, n, digest) of the documents, and rows (shingle, docs) of shingles frequent in a block."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: dict[bytes, np.ndarray] = {}
        total = 0

        def frequent() -> dict:
            values, times = np.unique(np.concatenate([*held.values(), np.zeros(0, np.uint64)]), return_counts=True)
            held.clear()
            often = times >= LOCAL
            n = int(often.sum())
            none = [None] * n
            return {"doc_id": none, "n": none, "digest": none, "shingle": values[often].view(np.int64), "docs": times[often]}

        for b in batches:
            sets = shingle_sets(b.column("text").to_pylist(), size)
            digests = [hashlib.md5(s.tobytes()).digest() for s in sets]
            none = [None] * len(sets)
            yield {"doc_id": b.column("doc_id"), "n": list(map(len, sets)), "digest": digests, "shingle": none, "docs": none}
            for digest, s in zip(digests, sets, strict=True):
                if digest not in held:
                    held[digest] = s
                    total += len(s)
            if total > BLOCK:
                yield frequent()
                total = 0
        yield frequent()

    out = batches_out(docs, run, f"doc_id {kind}, n long, digest binary, shingle long, docs long")
    return cut(out)


def _least_shared(n: np.ndarray | int) -> np.ndarray | int:
    return n // 20 + 1


def _prefixes(docs: DataFrame, size: int, percent: int, often: np.ndarray, bitmap: np.ndarray) -> DataFrame:
    """doc_id, n, shingle for the prefix of each chosen document. often: frequent shingles, rarest first."""
    kind = dict(docs.dtypes)["doc_id"]
    by_value = np.argsort(often)
    values = often[by_value]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            b = chosen(b, bitmap)
            sets = shingle_sets(b.column("text").to_pylist(), size)
            cuts = []
            for s in sets:
                n = len(s)
                length = min(n, n - -(-n * percent // 100) + _least_shared(n)) if n else 0
                if len(values) and n:
                    at = np.minimum(np.searchsorted(values, s), len(values) - 1)
                    hot = values[at] == s
                    rare = s[~hot]
                    if len(rare) < length:
                        ranks = np.sort(by_value[at[hot]])
                        rare = np.concatenate([rare, often[ranks[: length - len(rare)]]])
                    s = rare
                cuts.append(s[:length])
            ids = b.column("doc_id")
            counts = np.array([len(c) for c in cuts], np.int64)
            at = pa.array(np.repeat(np.arange(len(cuts)), counts))
            sizes = np.repeat(np.array([len(s) for s in sets], np.int64), counts)
            flat = np.concatenate([*cuts, np.zeros(0, np.uint64)]).view(np.int64)
            for start in range(0, max(len(flat), 1), 100_000):
                part = slice(start, start + 100_000)
                yield {"doc_id": ids.take(at[part]), "n": sizes[part], "shingle": flat[part]}

    return batches_out(docs, run, f"doc_id {kind}, n long, shingle long")


def _contents(docs: DataFrame, size: int, ids: DataFrame, short: bool = False) -> DataFrame:
    """doc_id, content: the packed sets of the documents in `ids` (column doc_id), and a few others.

    `short` contents have the lowest 16 bits of each shingle only: enough for a bound, since what two sets
    share they also share in these.
    """
    kind = dict(docs.dtypes)["doc_id"]
    bitmap = bitmap_of(ids, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            b = chosen(b, bitmap)
            sets = shingle_sets(b.column("text").to_pylist(), size)
            packed = [(s.astype(np.uint16) if short else s).tobytes() for s in sets]
            yield {"doc_id": b.column("doc_id"), "content": packed}

    # joined to tables that grow with the documents: merged at every size, never broadcast
    return cut(batches_out(docs, run, f"doc_id {kind}, content binary")).hint("merge")


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 |x & y| >= percent |x | y|, for sorted distinct values."""
    if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
        return False
    same = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * same >= percent * (len(x) + len(y) - same)


def _set(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.uint64)


def _streams(pairs: DataFrame, key: list[str], contents: DataFrame, heads: DataFrame) -> DataFrame:
    """doc_id, the key, place, content: in each stream of a key its heads (place 0), then its sets.

    pairs: doc_id and key. heads: key, doc_id, content. A key that very many sets meet is dealt over streams of
    about FOLLOWERS, each with the key's heads.
    """
    counts = pairs.groupBy(*key).agg(F.ceil(F.count("*") / FOLLOWERS).alias("streams"))
    deal = F.pmod(F.xxhash64("doc_id"), F.col("streams"))
    sets = pairs.join(counts, key).select("doc_id", *key, deal.alias("stream"), F.lit(1).alias("place")).join(contents, "doc_id")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("streams") - 1))
    first = heads.join(counts, key).select("doc_id", *key, copies.alias("stream"), F.lit(0).alias("place"), "content")
    rows = sets.select(first.columns).unionAll(first).repartition(*key, "stream")
    return rows.sortWithinPartitions(*key, "stream", "place").select("doc_id", *key, "stream", "place", "content")


def _verified(pairs: DataFrame, contents: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are linked; every a has one b."""
    kind = dict(pairs.dtypes)["a"]
    leaders = pairs.select("b").distinct().select("b", F.col("b").alias("doc_id")).join(contents, "doc_id")
    rows = _streams(pairs.select(F.col("a").alias("doc_id"), "b"), ["b"], contents, leaders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        head = np.zeros(0, np.uint64)
        for batch in batches:
            out: dict[str, list] = {"a": [], "b": []}
            for row in batch.to_pylist():
                if not row["place"]:
                    head = _set(row["content"])
                elif _linked(_set(row["content"]), head, percent):
                    out["a"].append(row["doc_id"])
                    out["b"].append(row["b"])
            yield out

    return batches_out(rows, run, f"a {kind}, b {kind}")


CELL = ["part", "linked", "number"]  # a group: of the sets linked to a part, or of those beside a leader


def _unions(members: DataFrame, short: DataFrame) -> DataFrame:
    """Of each group the union of its members' short contents."""
    kind = dict(members.dtypes)["part"]
    held = members.join(short, "doc_id").groupBy(*CELL).agg(F.collect_list("content").alias("contents"))  # about GROUP

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            unions = [
                np.unique(np.concatenate([np.frombuffer(c, np.uint16) for c in own])).tobytes()
                for own in b.column("contents").to_pylist()
            ]
            yield {name: b.column(name) for name in CELL} | {"content": unions}

    return cut(batches_out(held, run, f"part {kind}, linked boolean, number long, content binary"))


def _qualified(pairs: DataFrame, short: DataFrame, unions: DataFrame, percent: int) -> DataFrame:
    """The pairs (doc_id, group) whose group has enough of the document's shingles in its union."""
    kind = dict(pairs.dtypes)["doc_id"]
    rows = _streams(pairs, CELL, short, unions.withColumn("doc_id", F.lit(None).cast(kind)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        union = np.zeros(1 << 16, bool)
        for b in batches:
            keep = []
            for row in b.select(["place", "content"]).to_pylist():
                content = np.frombuffer(row["content"], np.uint16)
                if row["place"]:
                    keep.append(100 * int(union[content].sum()) >= percent * len(content))
                else:
                    union[:] = False
                    union[content] = True
                    keep.append(False)
            b = b.filter(pa.array(keep, pa.bool_()))
            yield {name: b.column(name) for name in ("doc_id", *CELL)}

    return cut(batches_out(rows, run, f"doc_id {kind}, part {kind}, linked boolean, number long"))


def _opened(pairs: DataFrame, contents: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between documents and members of the groups they qualify for."""
    kind = dict(pairs.dtypes)["doc_id"]
    rows = _streams(pairs, CELL, contents, members.join(contents, "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        own: list[tuple] = []  # the members of the group at hand
        stream = None
        for b in batches:
            out: dict[str, list] = {"a": [], "b": []}
            for row in b.to_pylist():
                at = (row["part"], row["linked"], row["number"], row["stream"])
                content = _set(row["content"])
                if not row["place"]:
                    if at != stream:
                        own, stream = [], at
                    own.append((row["doc_id"], content))
                    continue
                for other, held in own:
                    if other != row["doc_id"] and _linked(content, held, percent):
                        out["a"].append(row["doc_id"])
                        out["b"].append(other)
            yield out

    return batches_out(rows, run, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links) of every row."""
    docs = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    seen = _overview(docs, size)
    rows = seen.where("n IS NOT NULL").select("doc_id", "n", "digest")
    classes = cut(rows.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL"))
    often = (
        seen.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= FREQUENT)
    )
    often = often.orderBy(F.desc("docs"), "shingle").limit(OFTEN).orderBy("docs", "shingle").select("shingle")
    often = often.toPandas()["shingle"].to_numpy(np.int64).view(np.uint64)
    slotted = docs.withColumn("slot", slot_of("doc_id"))
    prefixes = cut(_prefixes(slotted, size, percent, often, bitmap_of(classes, "doc_id")))
    shared = prefixes.groupBy("shingle").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last"))
    shared = shared.where("leader <> last").select("shingle", "leader")
    reps = classes.select("doc_id").distinct()
    # all sides grow with the documents: merged at every size, never broadcast. Written in between, or else the
    # documents are matched before the shingles, with all rows of the prefixes
    met = cut(prefixes.hint("merge").join(shared, "shingle").distinct())
    met = cut(met.hint("merge").join(reps, "doc_id", "left_semi"))

    # parts: each set with its nearest leader, if they are linked
    nearest = (
        met.where("doc_id <> leader")
        .groupBy("doc_id", "leader", "n")
        .agg(F.count("*").alias("common"))
        .where(F.col("common") * 20 >= F.col("n"))
        .groupBy("doc_id")
        .agg(F.max(F.struct("common", "leader")).alias("best"))
    )
    pairs = cut(nearest.select(F.col("doc_id").alias("a"), F.col("best.leader").alias("b")))
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    first = cut(_verified(pairs, _contents(slotted, size, ids), percent))
    parts = cut(components(first))

    # groups: of the sets of a part, or of the unlinked sets beside a leader
    parts = parts.select(F.col("node").alias("doc_id"), "component")
    beside = pairs.select(F.col("a").alias("doc_id"), "b")
    sets = met.groupBy("doc_id").agg(F.max("n").alias("n")).join(parts, "doc_id", "left").join(beside, "doc_id", "left")
    part = F.coalesce("component", "b", "doc_id")
    sets = sets.select("doc_id", "n", part.alias("part"), F.col("component").isNotNull().alias("linked"))
    sets = cut(sets)
    cells = sets.groupBy("part", "linked").agg(F.count("*").alias("members"), F.sum("n").alias("size"))
    several = F.greatest(F.ceil(F.col("members") / GROUP), F.ceil(F.col("size") / GROUP_SHINGLES))
    number = F.pmod(F.xxhash64("doc_id"), several).cast("long")
    sets = cut(sets.join(cells, ["part", "linked"]).select("doc_id", "part", "linked", "members", number.alias("number")))

    # the matrix: shingles that several parts, or several unlinked sets, have
    placed = cut(met.select("doc_id", "n", "shingle").join(sets.hint("merge"), "doc_id"))
    unit = F.when(F.col("linked"), F.col("part")).otherwise(F.col("doc_id"))
    several = placed.groupBy("shingle").agg(F.min(F.struct("linked", unit)).alias("low"), F.max(F.struct("linked", unit)).alias("high"))
    matrix = cut(placed.join(several.where("low <> high").select("shingle"), "shingle", "left_semi"))
    alone = F.when(F.min("doc_id") == F.max("doc_id"), F.min("doc_id"))  # the only set of the group that has it
    groups = matrix.groupBy("shingle", *CELL, "members").agg(alone.alias("only"))
    mine = matrix.select(
        "shingle",
        "doc_id",
        "n",
        F.struct("members", "part", "linked").alias("own"),
        F.struct("members", "part", "linked", "number").alias("own_group"),
    )
    larger = F.col("own") < F.struct("members", "part", "linked")
    beside = ~F.col("linked") & (F.col("own") == F.struct("members", "part", "linked"))
    bound = _least_shared_column(F.ceil(F.col("n") * percent / 100))
    candidates = (
        mine.join(groups, "shingle")
        .where(larger | (beside & (F.col("own_group") <= F.struct("members", *CELL))))
        .where("only IS NULL OR only <> doc_id")
        .groupBy("doc_id", "n", "members", *CELL)
        .agg(F.count("*").alias("common"))
        .where(F.col("common") >= bound)
        .select("doc_id", *CELL)
    )
    candidates = cut(candidates)
    wanted = candidates.select(*CELL).distinct()
    members = cut(sets.select("doc_id", *CELL).join(wanted, CELL, "left_semi"))
    ids = candidates.select("doc_id").unionAll(members.select("doc_id")).distinct()
    short = _contents(slotted, size, ids, short=True)
    qualified = _qualified(candidates, short, _unions(members, short), percent)
    members = cut(members.join(qualified.select(*CELL).distinct(), CELL, "left_semi"))
    ids = qualified.select("doc_id").unionAll(members.select("doc_id")).distinct()
    second = _opened(qualified, _contents(slotted, size, ids), members, percent)

    found = components(first.unionAll(second)).select(F.col("node").alias("doc_id"), "component")
    classes = classes.join(found, "doc_id", "left").select("digest", F.coalesce("component", "doc_id").alias("component_id"))
    out = rows.join(classes, "digest", "left")
    least = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), least.alias("component_id"))


def _least_shared_column(n: Column) -> Column:
    return F.floor(n / 20) + 1


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows that are the smallest of their component; all columns are kept.

    Rows without an id or without words stay. Of rows that share an id, those with the same shingles count
    as one and all stay.
    """
    found = near_duplicates(docs, size, percent)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
