"""Byte-level dedup of repeated substrings by suffix sorting with a difference cover.

Every byte that a WINDOW-byte string covers which also starts in a document with a smaller id is removed.
Strings do not cross documents and are judged on the input.

Distribution. Equal strings must meet in one task. The anchor of a string is its GRAM-byte gram with the
smallest hash (the leftmost one), so equal strings have equal anchors, and the strings of an anchor are
neighbours in the text. Grams that anchor strings of one document only are left aside; for the others,
Spark brings the surroundings of all their occurrences together, sorted by gram.

Sorting. A task sorts the suffixes of such surroundings to a depth of WINDOW bytes by the difference cover
{1, 2} modulo 3: it sorts the sampled positions by triples (of 6 bytes each) and names them by rank;
recurses on the names, which as triples at distances 0, 18 and 36 already reach WINDOW bytes; merges the
remaining suffixes, compared by their first byte or two and the rank of the sampled suffix behind; and
compares the prefixes of adjacent suffixes. Runs of equal prefixes are the repeated strings.

Equal texts are one class, of which only the one with the smallest id is sorted; its copies are covered
whole. A gram with more than HOT occurrences is not brought to one task: the digests of its strings are
grouped with partial sums and joined back instead.

Null and empty texts have no bytes. Documents that share an id never cover each other; equal rows give equal
results. Rows without an id keep all their bytes and cover nothing. Ids are integers. Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaline.llm.common import batches_out, bitmap_of, chosen, in_bitmap, slot_of
from vitaline.session import cut

WINDOW = 50
GRAM = 16
GRAM_BITS = 1 << 26  # of the bitmap of shared grams: eight megabytes, whatever the data
STRIDE = (1 << 20) - 2 * WINDOW  # strings whose anchors are looked for together
SORTED = 1_500_000  # bytes of surroundings sorted together
PORTION = 4_000_000  # bytes of text whose grams are pre-aggregated together
HOT = 200_000  # occurrences of a gram that one task takes
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_AT = np.uint64((1 << 20) - 1)


def words_at(data: bytes | np.ndarray) -> np.ndarray:
    """The 8 bytes from every place on, as big-endian numbers; the last 7 places are padded with zeros."""
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(8, np.uint8)])
    return np.ndarray((len(raw) - 8,), ">u8", raw.data, strides=(1,)).astype(np.uint64)


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams (as hashes) that anchor strings of a text, and the first and last start of these strings."""
    grams, firsts, lasts = [], [], []
    for begin in range(0, max(len(data) - WINDOW + 1, 0), STRIDE):
        part = data[begin : begin + STRIDE + WINDOW - 1]
        words = words_at(part)
        n = len(part) - GRAM + 1
        hashes = words[:n] * _M1 + words[8 : 8 + n]
        hashes ^= hashes >> np.uint64(29)
        hashes *= _M2
        hashes ^= hashes >> np.uint64(32)
        low = (hashes & ~_AT) | np.arange(n, dtype=np.uint64)
        reach, span = 1, WINDOW - GRAM + 1
        while reach * 2 <= span:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if reach < span:
            low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
        at = low & _AT
        cuts = np.flatnonzero(np.diff(at.view(np.int64), prepend=-1))
        grams.append(hashes[at[cuts]])
        firsts.append(cuts + begin)
        lasts.append(np.append(cuts[1:], len(at)) - 1 + begin)
    if not grams:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(grams), np.concatenate(firsts), np.concatenate(lasts)


def _ranks(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of numbers of `bits` bits, and whether each number in that order differs from the one before."""
    places = np.uint64(max(len(values) - 1, 1).bit_length())
    if bits + int(places) <= 64:  # sorted as they are, with their places behind them, which is much faster
        packed = np.sort(values << places | np.arange(len(values), dtype=np.uint64))
        order = (packed & ((np.uint64(1) << places) - np.uint64(1))).view(np.int64)
        ordered = packed >> places
    else:
        order = np.argsort(values, kind="stable")
        ordered = values[order]
    return order, _changes(ordered)


def _changes(ordered: np.ndarray) -> np.ndarray:
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return new


def _and_behind(marks: np.ndarray, distance: int) -> np.ndarray:
    """The marked places and those `distance` behind them."""
    out = marks.copy()
    out[distance:] |= marks[:-distance]
    return out


def _six(data: np.ndarray) -> tuple[np.ndarray, int]:
    """The 6 bytes from every place on, as numbers in their order, and the bits of these."""
    there = np.bincount(data, minlength=256) > 0
    base = int(there.sum())
    digits = (np.cumsum(there) - 1).astype(np.uint64)[data]
    three = np.zeros(len(data) + 3, np.uint64)
    three[: len(data) - 2] = (digits[:-2] * np.uint64(base) + digits[1:-1]) * np.uint64(base) + digits[2:]
    return three[:-3] * np.uint64(base**3) + three[3:], (base**6 - 1).bit_length()


def suffix_order(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """`starts` in the order of the WINDOW bytes from each on; `data` goes on for WINDOW + 2 bytes after each."""
    data = np.concatenate([data, np.zeros(64, np.uint8)])
    byte = data.astype(np.uint64)
    zeros, ones, twos = (starts[starts % 3 == r] for r in range(3))
    ours = np.zeros(len(data), bool)
    ours[ones] = ours[twos] = True
    sampled = ours.copy()  # the sampled suffixes that are ranked: our own, and those that the merge looks at
    sampled[zeros + 1] = sampled[zeros + 2] = sampled[ones + 1] = sampled[twos + 2] = True
    # and the places whose names these take
    to_18 = _and_behind(sampled, 18)
    to_12 = to_18.copy()
    to_12[36:] |= sampled[:-36]
    to_6 = _and_behind(to_12, 6)
    to_6[12:] |= to_18[:-12]

    def names(at: np.ndarray, values: np.ndarray, bits: int) -> np.ndarray:
        order, new = _ranks(values, bits)
        out = np.zeros(len(data), np.uint64)
        out[at[order]] = np.cumsum(new, dtype=np.uint64)
        return out

    # triples of 6 bytes each, named by rank
    at = np.flatnonzero(to_6)
    values, bits = _six(data)
    name_6 = names(at, values[at], bits)
    width = len(at).bit_length()
    shift = np.uint64(width)
    at = np.flatnonzero(to_12)
    name_12 = names(at, name_6[at] << shift | name_6[at + 6], 2 * width)
    at = np.flatnonzero(to_18)
    name_18 = names(at, name_12[at] << shift | name_6[at + 12], 2 * width)
    # names of names: 18 + 18 + 14 bytes; with 13 or 12 at the end they reach one or two bytes less far
    at = np.flatnonzero(sampled)
    name_36 = names(at, name_18[at] << shift | name_18[at + 18], 2 * width)
    tail = name_12[at + 36] << np.uint64(16) | byte[at + 48] << np.uint64(8) | byte[at + 49]
    name_14 = names(at, tail, width + 16)
    order, new = _ranks(name_36[at] << shift | name_14[at], 2 * width)
    at = at[order]
    base, end = _changes(name_36[at]), name_12[at + 36]
    rank = np.zeros((3, len(data)), np.uint64)  # to a depth of 50, 49 and 48 bytes
    rank[0, at] = np.cumsum(new, dtype=np.uint64)
    rank[1, at] = np.cumsum(base | _changes(end << np.uint64(8) | byte[at + 48]), dtype=np.uint64)
    rank[2, at] = np.cumsum(base | _changes(end), dtype=np.uint64)
    # the merge: places of the remaining suffixes among the sampled ones, of either remainder
    one = lambda at: byte[at] << shift | rank[1, at + 1]
    two = lambda at: (byte[at] << np.uint64(8) | byte[at + 1]) << shift | rank[2, at + 2]
    zero = zeros[_ranks(one(zeros), width + 8)[0]]
    both = at[ours[at]]
    remainder = both % 3
    less = np.zeros(len(zero), np.int64)  # sampled suffixes before each remaining one
    for r, key in ((1, one), (2, two)):
        less += np.searchsorted(key(both[remainder == r]), key(zero))
    out = np.empty(len(starts), np.int64)
    place = np.arange(len(zero)) + less
    out[place] = zero
    rest = np.ones(len(starts), bool)
    rest[place] = False
    out[rest] = both
    return out


def same_as_before(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Whether the WINDOW bytes from each place on equal those from the place before it in `order`."""
    words = words_at(data)
    same = np.zeros(len(order), bool)
    same[1:] = True
    for step in (0, 8, 16, 24, 32, 40, WINDOW - 8):
        part = words[order + step]
        same[1:] &= part[1:] == part[:-1]
    return same


def covered_strings(data: np.ndarray, sizes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each string of each context, in sequence, whether it also starts in one of a smaller document.

    `data` holds the contexts one after the other, `sizes` their bytes and `docs` their documents.
    """
    data = np.concatenate([data, np.zeros(WINDOW + 2, np.uint8)])
    begins = np.cumsum(sizes) - sizes
    counts = sizes - WINDOW + 1
    starts = np.arange(counts.sum()) + np.repeat(begins - np.cumsum(counts) + counts, counts)
    order = suffix_order(data, starts)
    owner = np.zeros(len(data), np.int64)
    owner[starts] = np.repeat(docs, counts)
    owner = owner[order]
    runs = np.flatnonzero(~same_as_before(data, order))
    least = np.minimum.reduceat(owner, runs)
    covered = np.zeros(len(data), bool)
    covered[order] = owner > np.repeat(least, np.diff(np.append(runs, len(order))))
    return covered[starts]


def covered_spans(
    covered: np.ndarray, counts: np.ndarray, firsts: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, start and end (in its document) of each run of covered strings; contexts have `counts` strings
    from `firsts` on."""
    ends = np.cumsum(counts)
    begins = ends - counts
    before = np.concatenate([[False], covered[:-1]])
    before[begins] = False
    after = np.concatenate([covered[1:], [False]])
    after[ends - 1] = False
    opens, closes = np.flatnonzero(covered & ~before), np.flatnonzero(covered & ~after)
    context = np.searchsorted(ends, opens, side="right")
    shift = (firsts - begins)[context]
    return context, opens + shift, closes + shift + WINDOW


def _grams(texts: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """gram, doc_id, n: of the documents of a portion of texts that have strings with this anchor, the first and
    the last, and how often the portion has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        grams, docs, times, size = [], [], [], 0

        def rows() -> dict:
            gram = np.concatenate([np.zeros(0, np.uint64), *grams])
            doc, n = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (docs, times))
            order = np.lexsort((doc, gram))
            gram, doc, n = gram[order], doc[order], n[order]
            new = np.ones(len(gram), bool)
            new[1:] = gram[1:] != gram[:-1]
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(gram)) - 1 if len(starts) else starts
            several = doc[starts] != doc[ends]
            for x in (grams, docs, times):
                x.clear()
            total = np.add.reduceat(n, starts) if len(starts) else n
            return {
                "gram": np.concatenate([gram[starts], gram[ends][several]]).view(np.int64),
                "doc_id": np.concatenate([doc[starts], doc[ends][several]]),
                "n": np.concatenate([total, np.zeros(int(several.sum()), np.int64)]),
            }

        for b in batches:
            b = chosen(b, bitmap)
            for doc_id, data in zip(b.column("doc_id").to_pylist(), b.column("data").to_pylist(), strict=True):
                found, n = np.unique(anchors(data)[0], return_counts=True)
                grams.append(found)
                docs.append(np.full(len(found), doc_id, np.int64))
                times.append(n)
                size += len(data)
                if size > PORTION:
                    yield rows()
                    size = 0
        yield rows()

    return batches_out(texts, run, "gram long, doc_id long, n long")


def _shared(grams: DataFrame) -> DataFrame:
    """gram, n: of the grams of several documents. Tasks read whole grams, pre-aggregated; a gram needs three
    numbers at a time."""
    by_gram = grams.repartition(F.col("gram")).sortWithinPartitions("gram")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        last: tuple[int, int, int, int] | None = None  # gram, first and last document, times
        for b in batches:
            if not b.num_rows:
                continue
            gram, doc, n = (b.column(c).to_numpy(zero_copy_only=False) for c in ("gram", "doc_id", "n"))
            starts = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
            keys, low, high = gram[starts], np.minimum.reduceat(doc, starts), np.maximum.reduceat(doc, starts)
            total = np.add.reduceat(n, starts)
            if last and last[0] == keys[0]:
                low[0], high[0], total[0] = min(last[1], low[0]), max(last[2], high[0]), last[3] + total[0]
            elif last and last[1] != last[2]:
                yield {"gram": [last[0]], "n": [last[3]]}
            last = (int(keys[-1]), int(low[-1]), int(high[-1]), int(total[-1]))
            several = low[:-1] != high[:-1]
            yield {"gram": keys[:-1][several], "n": total[:-1][several]}
        if last and last[1] != last[2]:
            yield {"gram": [last[0]], "n": [last[3]]}

    return batches_out(by_gram, run, "gram long, n long")


def _slots(grams: np.ndarray) -> np.ndarray:
    """Slots of grams, which are hashes already."""
    return ((grams >> np.uint64(7)) % np.uint64(GRAM_BITS)).astype(np.int64)


def _gram_bitmap(shared: DataFrame) -> np.ndarray:
    slot = (F.shiftrightunsigned("gram", 7) % F.lit(GRAM_BITS)) + 1
    parts = shared.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")
    )
    out = np.zeros(GRAM_BITS // 8, np.uint8)
    for row in parts.collect():  # GRAM_BITS / 8 bytes at most
        out[(row.bucket - 1) * 4096 : row.bucket * 4096] = np.frombuffer(row.bits, np.uint8)
    return out


def _contexts(texts: DataFrame, bitmap: np.ndarray, grams: np.ndarray, hot: np.ndarray | None, want_hot: bool) -> DataFrame:
    """gram, doc_id, text_key, first, context: the bytes of all strings that a shared gram anchors in a text.

    The grams in the bitmap `hot` only, or all others; a few unshared ones come along.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        names = ("gram", "doc_id", "text_key", "first", "context")
        for b in batches:
            b = chosen(b, bitmap)
            out: dict[str, list] = {n: [] for n in names}
            for row in b.select(["doc_id", "text_key", "data"]).to_pylist():
                gram, first, last = anchors(row["data"])
                some = in_bitmap(grams, _slots(gram))
                if hot is not None:
                    some &= in_bitmap(hot, _slots(gram)) == want_hot
                first, last = first[some].tolist(), last[some].tolist()
                out["gram"] += gram[some].view(np.int64).tolist()
                out["doc_id"] += [row["doc_id"]] * len(first)
                out["text_key"] += [row["text_key"]] * len(first)
                out["first"] += first
                out["context"] += [row["data"][i : j + WINDOW] for i, j in zip(first, last, strict=True)]
            yield out

    return batches_out(texts, run, "gram long, doc_id long, text_key long, first long, context binary")


def _sorted_spans(contexts: DataFrame) -> DataFrame:
    """text_key, doc_id, start, end of repeated strings; contexts of a gram are in one partition, in sequence.

    About SORTED bytes are sorted together, always whole grams.
    """

    def spans(table: pa.Table) -> dict:
        table = table.combine_chunks()
        column = table.column("context").combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0)
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        sizes = np.diff(offsets).astype(np.int64)
        docs, firsts = (table.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "first"))
        covered = covered_strings(data, sizes, docs)
        context, start, end = covered_spans(covered, sizes - WINDOW + 1, firsts)
        keys = table.column("text_key").to_numpy()
        return {"text_key": keys[context], "doc_id": docs[context], "start": start, "end": end}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.column("context").nbytes
            if size > SORTED:
                table = pa.Table.from_batches(held)
                grams = table.column("gram").to_numpy()
                whole = np.flatnonzero(grams != grams[-1])
                if len(whole):
                    yield spans(table.slice(0, int(whole[-1]) + 1))
                    held = table.slice(int(whole[-1]) + 1).to_batches()
                size = sum(x.column("context").nbytes for x in held)
        if held:
            yield spans(pa.Table.from_batches(held))

    return batches_out(contexts, run, "text_key long, doc_id long, start long, end long")


def _hot_spans(contexts: DataFrame) -> DataFrame:
    """The same for grams with very many occurrences: digests of strings are grouped, and joined back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            out: dict[str, list] = {n: [] for n in ("digest", "text_key", "doc_id", "start")}
            for row in b.to_pylist():
                n = len(row["context"]) - WINDOW + 1
                out["digest"] += [hashlib.md5(row["context"][i : i + WINDOW]).digest() for i in range(n)]
                out["text_key"] += [row["text_key"]] * n
                out["doc_id"] += [row["doc_id"]] * n
                out["start"] += range(row["first"], row["first"] + n)
            yield out

    strings = cut(batches_out(contexts, run, "digest binary, text_key long, doc_id long, start long"))
    least = strings.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    found = strings.join(least.where("least < most"), "digest").where("doc_id > least")
    return found.select("text_key", "doc_id", "start", (F.col("start") + WINDOW).alias("end"))


def repeated_spans(texts: DataFrame, firsts: np.ndarray) -> DataFrame:
    """text_key, doc_id, spans (start, end): of the repeated strings of the texts whose slot is in `firsts`."""
    texts = texts.where(F.col("doc_id").isNotNull() & (F.length("data") >= WINDOW))
    shared = cut(_shared(_grams(texts, firsts)))
    grams = _gram_bitmap(shared)
    often = shared.where(F.col("n") > HOT)
    hot = None if often.isEmpty() else _gram_bitmap(often)
    usual = _contexts(texts, firsts, grams, hot, False).repartition(F.col("gram")).sortWithinPartitions("gram")
    found = _sorted_spans(usual)
    if hot is not None:
        found = found.unionAll(_hot_spans(_contexts(texts, firsts, grams, hot, True)))
    return found.groupBy("text_key", "doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


_RESULT = "doc_id long, n_bytes long, kept binary, spans array<struct<start: long, end: long>>"


def _cut_out(rows: Iterator[tuple[int | None, bytes, list[tuple[int, int]]]]) -> dict:
    out: dict[str, list] = {n: [] for n in ("doc_id", "n_bytes", "kept", "spans")}
    for doc_id, text, spans in rows:
        at, kept = 0, []
        for start, end in spans:
            kept.append(text[at:start])
            at = end
        out["doc_id"].append(doc_id)
        out["n_bytes"].append(len(text))
        out["kept"].append(b"".join([*kept, text[at:]]))
        out["spans"].append([{"start": s, "end": e} for s, e in spans])
    return out


def drop_repeated_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, kept (the remaining bytes), spans: maximal removed runs (start, end) of every row."""
    kind = dict(docs.dtypes)["doc_id"]
    data = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), data.alias("data"))
    classes = docs.where("doc_id IS NOT NULL").groupBy(F.unhex(F.md5("data")).alias("digest"))
    classes = classes.agg(F.min("doc_id").alias("doc_id")).select("doc_id", _text_key(F.hex("digest")).alias("text_key"))
    # a row that is not among these is a copy, and covered whole; one that is there by chance only is sorted too
    firsts = bitmap_of(classes, "text_key", "doc_id")
    texts = docs.withColumn("text_key", _text_key(F.md5("data"))).withColumn("slot", slot_of("text_key", "doc_id"))
    found = cut(repeated_spans(texts, firsts))
    spanned = bitmap_of(found, "text_key", "doc_id")

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            slots = b.column("slot").to_numpy(zero_copy_only=False)
            first, moved = in_bitmap(firsts, slots), in_bitmap(spanned, slots)
            rows = zip(b.column("doc_id").to_pylist(), b.column("data").to_pylist(), first, moved, strict=True)
            copy = lambda i, text, f: i is not None and not f and len(text) >= WINDOW
            yield _cut_out(
                (i, text, [(0, len(text))] if copy(i, text, f) else []) for i, text, f, m in rows if i is None or not m or not f
            )

    def moving(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            slots = b.column("slot").to_numpy(zero_copy_only=False)
            some = in_bitmap(firsts, slots) & in_bitmap(spanned, slots)
            b = b.filter(pa.array(some & ~b.column("doc_id").is_null().to_numpy(zero_copy_only=False)))
            yield {name: b.column(name) for name in ("doc_id", "text_key", "data")}

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            rows = b.select(["doc_id", "data", "spans"]).to_pylist()
            yield _cut_out(
                (r["doc_id"], r["data"], merged([(s["start"], s["end"]) for s in r["spans"] or []])) for r in rows
            )

    moved = batches_out(texts, moving, "doc_id long, text_key long, data binary")
    joined = moved.join(found, ["text_key", "doc_id"], "left").select("doc_id", "data", "spans")
    done = batches_out(texts, plain, _RESULT).unionAll(batches_out(joined, apply, _RESULT))
    return done.withColumn("doc_id", F.col("doc_id").cast(kind))


def _text_key(digest: Column) -> Column:
    """Sixty bits of a digest. Together with the id they tell rows apart."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
