"""Benchmark decontamination by latent semantic retrieval.

Texts are read as words (lower-cased, ASCII punctuation separates); only words of the benchmark matter,
all others are one unknown word that matches nothing.

1. Documents become word numbers, cut into passages of PASSAGE words; documents per word of passages give
   the inverse document frequencies. Words in more than `max_share` of the passages carry no weight here.
2. A randomised SVD of the TF-IDF matrix of all passages and the benchmark items (weighted to have the same
   total) gives `rank` directions: the matrix is multiplied with random vectors and its transpose in the
   tasks, Spark sums the products by word, and small dense algebra of (words x rank) is left to the driver.
3. Items and overlapping windows of the documents are projected. An item of n words is searched in windows
   of the next power of two; a window is a candidate for every item whose cosine in the latent space is
   `cosine` or more. Windows are laid only where an item can be a hit at all: a hit needs `rephrased` of the
   item's words, so the surroundings must have as many of its anchors as these are more than its other words.
   Words are counted per item and stretch of text for that. Anchors are the item's weighted words if these
   are so many that every hit has `min_words` of them. An item with fewer (short, plain, or copied so often
   that its own words are frequent) has its least frequent words as anchors, as many as this takes, and all
   windows whose surroundings have the anchors and words it needs are candidates, whatever their cosine. So
   how often a passage is copied, and how small the table is, does not decide whether it is looked at.
4. A candidate and its surroundings are checked by the longest common subsequence of words: a hit has
   `copied` of the item's words, or `rephrased` of them and as large a share of the weighted words of its
   answer (the last ANSWER words; its anchors there if no word is weighted, all of it if there are none).

The benchmark is a query set, searched in blocks of BLOCK items, so all that is broadcast is bounded by a
block. A hit is (doc_id, item_id, cosine, common, answer_common, start_word, end_word), the best one per
document and item. The cosine is 0 for items without weighted words. Null and empty texts have no hits,
neither have items with fewer than `min_words` words. Documents that share an id share their hits; extra
columns are ignored; an empty table on either side gives no hits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import compress, pairwise

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaline.llm.common import map_rows
from vitaline.llm.jaccard import word_hashes
from vitaline.session import cut

PASSAGE = 64
ANSWER = 8
BLOCK = 2000
PORTION = 1 << 17  # bytes of texts whose words are looked up together
_SIGNS = bytes(b for b in range(128) if not chr(b).isalnum())
_SEPARATE = bytes.maketrans(_SIGNS, b" " * len(_SIGNS))


def _plain(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SEPARATE)


def words_of(text: str | None) -> list[bytes]:
    return _plain(text).split()


class Items:
    """A block of items as arrays of word numbers."""

    def __init__(self, rows: list[tuple]):
        self.ids = [item_id for item_id, _ in rows]
        split = [words_of(text) for _, text in rows]
        self.vocabulary = {w: i for i, w in enumerate(sorted(set().union(*split)))}
        self.words = [np.array([self.vocabulary[w] for w in s], np.int32) for s in split]
        self.kind = np.dtype("<i2" if len(self.vocabulary) < 1 << 15 else "<i4")  # of packed word numbers
        self.weight = np.zeros(len(self.vocabulary))  # inverse document frequencies, once known
        self.share = np.zeros(len(self.vocabulary))  # of the passages that have the word, once known
        self.basis = np.zeros((len(self.vocabulary), 0))  # words x rank, times the weights

    def projected(self) -> np.ndarray:
        out = np.zeros((len(self.words), self.basis.shape[1]))
        for i, words in enumerate(self.words):
            out[i] = self.basis[words].sum(0)
        return out


class Numbers:
    """The numbers of known words by their hashes."""

    def __init__(self, words: list[bytes]):
        _, hashes = word_hashes(b" ".join(words))
        self.words = np.argsort(hashes).astype(np.int32)
        self.hashes = hashes[self.words]

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words of all texts, -1 for unknown ones, and how many each text has."""
        starts, hashes = word_hashes(b" ".join(texts))
        ends = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        ids = np.where(self.hashes[at] == hashes, self.words[at], np.int32(-1)) if len(self.hashes) else np.full(len(hashes), -1, np.int32)
        return ids, np.diff(ends, prepend=0)


def passages_of(ids: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Of each word the passages that have it; `counts`: words of each text."""
    parts = -(-counts // PASSAGE)
    place = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)
    passage = place // PASSAGE + np.repeat(np.cumsum(parts) - parts, counts)
    known = np.flatnonzero(ids >= 0)
    where = np.sort(passage[known] * size + ids[known])
    return np.bincount(where[np.diff(where, prepend=-1) > 0] % max(size, 1), minlength=size)


def encode(docs: DataFrame, items: Items) -> DataFrame:
    """Rows (doc_id, words): packed word numbers, -1 for unknown; and rows (word, passages)."""
    kind = dict(docs.dtypes)["doc_id"]
    size, numbers = len(items.vocabulary), Numbers(list(items.vocabulary))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        passages = np.zeros(size, np.int64)
        total = 0
        for b in batches:
            packed = []
            texts = [_plain(t) for t in b["text"]]
            n_bytes = np.cumsum([len(t) for t in texts])
            cuts = np.flatnonzero(np.diff(n_bytes // PORTION, prepend=0)).tolist()
            for low, high in pairwise([0, *cuts, len(texts)]):  # texts of about PORTION bytes together
                if low == high:
                    continue
                ids, counts = numbers.of(texts[low:high])
                passages += passages_of(ids, counts, size)
                total += int((-(-counts // PASSAGE)).sum())
                packed += [own.astype(items.kind).tobytes() for own in np.split(ids, np.cumsum(counts)[:-1])]
            none = [None] * len(packed)
            yield {"doc_id": b["doc_id"], "words": packed, "word": none, "passages": none}
        found = np.flatnonzero(passages)
        none = [None] * (len(found) + 1)
        word = pa.array([*found.tolist(), -1], pa.int32())  # -1: passages in all
        yield {"doc_id": none, "words": none, "word": word, "passages": [*passages[found].tolist(), total]}

    return cut(map_rows(docs, ["doc_id", "text"], run, f"doc_id {kind}, words binary, word int, passages long"))


def _sums(encoded: DataFrame, items: Items, vectors: np.ndarray, small: bool) -> np.ndarray:
    """With A the passages by weighted words: A'A times `vectors`, or for `small` its product with vectors'.

    `vectors` has a row for each word. Tasks multiply, Spark sums.
    """
    weight, kind = items.weight.copy(), items.kind
    weighted = (vectors * weight[:, None]).astype(np.float32)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        out = np.zeros((vectors.shape[1] if small else len(weight), vectors.shape[1]))
        for b in batches:
            ids = [np.frombuffer(w, kind).astype(np.int32) for w in b["words"]]
            at, passage = [], []
            first = 0
            for words in ids:
                known = np.flatnonzero(weight[words] * (words >= 0)) if len(words) else words
                at.append(words[known])
                passage.append(known // PASSAGE + first)
                first += -(-len(words) // PASSAGE)
            at, passage = np.concatenate(at), np.concatenate(passage)
            if not len(at):
                continue
            starts = np.flatnonzero(np.diff(passage, prepend=-1))
            projected = np.add.reduceat(weighted[at], starts, axis=0)
            if small:
                out += projected.T @ projected
                continue
            row = np.cumsum(np.diff(passage, prepend=passage[0]) > 0)
            order = np.argsort(at, kind="stable")
            starts = np.flatnonzero(np.diff(at[order], prepend=-1))
            out[at[order][starts]] += np.add.reduceat(projected[row[order]], starts, axis=0)
        rows = np.flatnonzero(np.abs(out).sum(1))
        vecs = pa.array(list(out[rows]), pa.list_(pa.float64())) if len(rows) else pa.array([], pa.list_(pa.float64()))
        yield {"row": rows.tolist(), "vec": vecs}

    parts = map_rows(encoded, ["words"], run, "row int, vec array<double>").withColumn("vec", array_to_vector("vec"))
    sums = parts.groupBy("row").agg(Summarizer.sum(F.col("vec")).alias("vec")).select("row", vector_to_array("vec").alias("vec"))
    result = np.zeros((vectors.shape[1] if small else len(weight), vectors.shape[1]))
    for row in sums.collect():  # words x rank numbers
        result[row.row] = row.vec
    return result if small else result * weight[:, None]


def latent_basis(encoded: DataFrame, items: Items, rank: int, extra: int = 8, seed: int = 7) -> np.ndarray:
    """Orthonormal columns: the leading right singular vectors of the weighted passages and items."""
    size = len(items.vocabulary)
    width = min(rank + extra, size)
    own = np.zeros((len(items.words), size))
    for i, words in enumerate(items.words):
        np.add.at(own[i], words, items.weight[words])
    energy = float((own**2).sum())
    draws = np.random.default_rng(seed).standard_normal((size, width))
    product = _sums(encoded, items, draws, False)
    # the trace of A'A by the same draws, to give the items as much weight as all passages
    trace = max(float((draws * product).sum()) / width, 0.0)
    boost = trace / energy if energy and trace else 1.0
    basis, _ = np.linalg.qr(product + boost * (own.T @ (own @ draws)))
    inner = _sums(encoded, items, basis, True) + boost * ((own @ basis).T @ (own @ basis))
    values, turns = np.linalg.eigh((inner + inner.T) / 2)
    return (basis @ turns)[:, np.argsort(-values)[:rank]]


def places_of(item: np.ndarray) -> dict[int, int]:
    """The places of each word of an item, as bits."""
    places: dict[int, int] = {}
    for i, word in enumerate(item.tolist()):
        places[word] = places.get(word, 0) | 1 << i
    return places


def common_bits(places: dict[int, int], size: int, text: list[int]) -> int:
    """Length of the longest common subsequence of an item of `size` words and a text of words of the item."""
    row = full = (1 << size) - 1
    for word in text:
        both = row & places[word]
        row = ((row + both) | (row - both)) & full
    return size - row.bit_count()


def common_words(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence, one bit for each place of `item`."""
    places = places_of(item)
    return common_bits(places, len(item), [word for word in text.tolist() if word in places])


class Places:
    """Which items a stretch of text can hold: the items of each anchor, and what each item needs."""

    def __init__(self, items: Items, limits: dict):
        sizes = np.array([len(w) for w in items.words])
        least = np.ceil(limits["rephrased"] * sizes - 1e-9).astype(int)  # words of a hit
        self.direct = np.zeros(len(sizes), bool)  # items that are searched without the cosine
        self.anchors, self.answers, plain = [], [], []
        for i, words in enumerate(items.words):
            anchor = items.weight[words] > 0
            enough = min(sizes[i] - least[i] + limits["min_words"], sizes[i])
            if anchor.sum() < enough:
                self.direct[i] = True
                share = items.share[words]
                anchor |= share <= np.sort(share)[enough - 1]
            own = np.unique(words[anchor])
            plain.append(sizes[i] - int(anchor.sum()))
            self.anchors.append(own if sizes[i] >= limits["min_words"] else own[:0])
            tail = words[-ANSWER:]
            for some in (items.weight[tail] > 0, np.isin(tail, own)):
                if some.any():
                    tail = tail[some]
                    break
            self.answers.append(tail)
        owner = np.repeat(np.arange(len(sizes)), [len(a) for a in self.anchors])
        word = np.concatenate([np.zeros(0, np.int64), *self.anchors]).astype(np.int64)
        order = np.argsort(word, kind="stable")
        self.owners = owner[order]
        self.starts = np.searchsorted(word[order], np.arange(len(items.vocabulary) + 1))
        self.anchoring = np.append(np.diff(self.starts) > 0, False)  # by word; the last is for unknown ones
        self.least = least
        self.needs = np.maximum(least - np.array(plain, int), limits["min_words"])
        self.widths = np.array([1 << max(n - 1, 1).bit_length() for n in sizes.tolist()])
        self.marks = np.zeros(len(items.vocabulary) + 1, bool)
        self.words = [(words, places_of(words)) for words in items.words]
        self.tails = [(tail, places_of(tail)) for tail in self.answers]

    def common(self, whole: tuple[np.ndarray, dict[int, int]], text: np.ndarray, least: int = 0) -> int:
        """`common_words` of one of `words` or `tails`: only the text's words that it has are looked at. 0 if the
        text's different words of it and the item's repeated ones are fewer than `least`."""
        item, places = whole
        self.marks[item] = True
        found = text[self.marks[text]].tolist()
        self.marks[item] = False
        if len(found) < least or len(set(found)) + len(item) - len(places) < least:
            return 0
        return common_bits(places, len(item), found)

    def held(self, text: np.ndarray, items: Iterable[int]) -> list[bool]:
        """Whether the text has as many of the items' words as a hit; no common subsequence is longer than these."""
        self.marks[text] = True
        out = [bool(np.count_nonzero(self.marks[self.words[i][0]]) >= self.least[i]) for i in items]
        self.marks[text] = False
        return out

    def rich(self, part: np.ndarray, item: int, words: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The windows whose surroundings (left, right) have the anchors and words that a hit of the item has."""
        found = np.arange(len(left))
        for some, least in ((self.anchors[item], self.needs[item]), (words, self.least[item])):
            self.marks[some] = True
            sums = np.zeros(len(part) + 1, np.int64)
            np.cumsum(self.marks[part], out=sums[1:])
            self.marks[some] = False
            found = found[sums[right[found]] - sums[left[found]] >= least]
            if not len(found):
                break
        return found

    def stretches(self, ids: np.ndarray, held: bool = False) -> Iterator[tuple[int, int, int, list[int]]]:
        """Width, start, end and items of the stretches that may hold items of this width, by their anchors.
        `held`: without items of whose words the whole text has too few for a hit."""
        place = np.flatnonzero(self.anchoring[ids])
        first = self.starts[ids[place]]
        n = self.starts[ids[place] + 1] - first
        item = self.owners[np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)]
        # no stretch has more of an item's anchors than the whole text
        able = np.bincount(item, minlength=len(self.needs)) >= self.needs
        if not able.any():
            return
        if held:
            able[able] = self.held(ids, np.flatnonzero(able))
            if not able.any():
                return
        own = able[item]
        item, place = item[own], np.repeat(place, n)[own]
        # a window and what is looked at around it lie in two adjacent blocks of this size
        sizes = 2 * self.widths
        n_blocks = len(ids) // int(sizes[able].min()) + 1
        keys, times = np.unique(item * (n_blocks + 2) + place // sizes[item] + 1, return_counts=True)
        next_one = np.append(np.where(keys[1:] == keys[:-1] + 1, times[1:], 0), 0)
        near = times + np.maximum(next_one, np.append(0, np.where(next_one[:-1] > 0, times[:-1], 0)))
        rich = keys[near >= self.needs[keys // (n_blocks + 2)]]
        members: dict[tuple[int, int], list[int]] = {}
        for key in rich.tolist():
            which, block = divmod(key, n_blocks + 2)
            members.setdefault((int(self.widths[which]), block - 1), []).append(which)
        for (width, at), found in members.items():
            low, high = max((at - 1) * 2 * width, 0), min((at + 2) * 2 * width, len(ids))
            yield width, low, high, found


def _cosines(
    part: np.ndarray, weighted: np.ndarray, starts: np.ndarray, ends: np.ndarray, basis: np.ndarray, near: np.ndarray
) -> np.ndarray:
    """Windows by items."""
    own = np.flatnonzero(weighted)
    sums = np.vstack([np.zeros(near.shape[1]), np.cumsum(basis[part[own]], axis=0)])
    windows = sums[np.searchsorted(own, ends)] - sums[np.searchsorted(own, starts)]
    windows /= np.maximum(np.linalg.norm(windows, axis=1), 1e-12)[:, None]
    return windows @ near.T


def windows(size: int, width: int) -> tuple[np.ndarray, ...]:
    """Starts and ends of the windows of a part, and starts and ends of what is looked at around them."""
    starts = np.arange(0, max(size - width // 2, 1), max(width // 4, 1))
    ends = np.minimum(starts + width, size)
    return starts, ends, np.maximum(starts - width // 2, 0), np.minimum(ends + width // 2, size)


def _hits(ids: np.ndarray, items: Items, near: np.ndarray, places: Places, limits: dict) -> dict[int, tuple]:
    """Best hit per item place for one document."""
    found: dict[int, tuple] = {}
    known = ids >= 0
    weighted = np.zeros(len(ids), bool)
    weighted[known] = items.weight[ids[known]] > 0
    for width, low, high, members in places.stretches(ids, held=True):
        part = ids[low:high]
        members = list(compress(members, places.held(part, members)))
        starts = cosines = None
        for m, item in enumerate(members):
            words, tail = items.words[item], places.answers[item]
            if places.direct[item]:
                # nothing in the parts if not in the whole, which is soonest told
                if places.common(places.words[item], part, places.least[item]) < places.least[item]:
                    continue
                if starts is None:
                    starts, ends, lefts, rights = windows(len(part), width)
                candidates = places.rich(part, item, words, lefts, rights)
                if not len(candidates):
                    continue
                if places.common(places.words[item], part[lefts[candidates[0]] : rights[candidates[-1]]]) < places.least[item]:
                    continue
            elif starts is None:
                starts, ends, lefts, rights = windows(len(part), width)
            if cosines is None:
                cosines = _cosines(part, weighted[low:high], starts, ends, items.basis, near[members])
            if not places.direct[item]:
                candidates = np.flatnonzero(cosines[:, m] >= limits["cosine"])
            for w in candidates.tolist():
                left, right = low + int(lefts[w]), low + int(rights[w])
                common = places.common(places.words[item], ids[left:right], places.least[item])
                if common < places.least[item]:
                    continue
                answer = places.common(places.tails[item], ids[left:right])
                if common < limits["copied"] * len(words) and answer < limits["rephrased"] * len(tail):
                    continue
                hit = (common, round(float(cosines[w, m]), 6), answer, left, right)
                found[item] = max(found.get(item, hit), hit)
    return found


def search(encoded: DataFrame, items: Items, item_type: str, limits: dict) -> DataFrame:
    kind = dict(encoded.dtypes)["doc_id"]
    near = items.projected()
    length = np.linalg.norm(near, axis=1)
    near /= np.maximum(length, 1e-12)[:, None]
    places = Places(items, limits)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            rows = [
                (doc_id, items.ids[item], hit[1], hit[0] / len(items.words[item]), hit[2], hit[3], hit[4])
                for doc_id, words in zip(b["doc_id"], b["words"], strict=True)
                for item, hit in sorted(_hits(np.frombuffer(words, items.kind).astype(np.int32), items, near, places, limits).items())
            ]
            names = ("doc_id", "item_id", "cosine", "common", "answer_common", "start_word", "end_word")
            yield {name: [r[i] for r in rows] for i, name in enumerate(names)}

    schema = f"doc_id {kind}, item_id {item_type}, cosine double, common double, answer_common long, start_word long, end_word long"
    return map_rows(encoded, ["doc_id", "words"], run, schema)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    rank: int = 256,
    max_share: float = 0.005,
    min_words: int = 3,
    cosine: float = 0.5,
    copied: float = 0.8,
    rephrased: float = 0.6,
) -> DataFrame:
    """The hits; see the module's text."""
    spark = docs.sparkSession
    limits = {"min_words": min_words, "cosine": cosine, "copied": copied, "rephrased": rephrased}
    item_type = dict(benchmark.dtypes)["item_id"]
    benchmark = cut(benchmark.select("item_id", "text").where("item_id IS NOT NULL AND length(text) > 0").distinct())
    n_blocks = -(-benchmark.count() // BLOCK)
    hits = None
    for block in range(n_blocks):
        own = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block)
        found = _block(docs, own, rank, max_share, item_type, limits)
        hits = found if hits is None else hits.unionAll(found)
    if hits is None:
        hits = _none(spark, dict(docs.dtypes)["doc_id"], item_type)
    best = F.max(F.struct("common", "cosine", "answer_common", "start_word", "end_word")).alias("best")
    return hits.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def _none(spark: SparkSession, kind: str, item_type: str) -> DataFrame:
    schema = f"doc_id {kind}, item_id {item_type}, cosine double, common double, answer_common long, start_word long, end_word long"
    return spark.createDataFrame([], schema)


def _block(docs: DataFrame, own: DataFrame, rank: int, max_share: float, item_type: str, limits: dict) -> DataFrame:
    items = Items(sorted(((r.item_id, r.text) for r in own.collect()), key=str))  # about BLOCK items
    if not items.vocabulary:
        return _none(docs.sparkSession, dict(docs.dtypes)["doc_id"], item_type)
    seen = encode(docs.select("doc_id", "text"), items)
    encoded = seen.where("words IS NOT NULL").select("doc_id", "words")
    counts = seen.where("word IS NOT NULL").groupBy("word").agg(F.sum("passages").alias("n")).collect()  # the vocabulary
    counts = {r.word: r.n for r in counts}
    total = counts.pop(-1, 0)
    share = np.array([counts.get(i, 0) for i in range(len(items.vocabulary))]) / max(total, 1)
    items.share = share
    items.weight = np.where(share <= max_share, np.log((1 + total) / (1 + share * total)) + 1, 0.0)
    basis = latent_basis(encoded, items, min(rank, len(items.ids)))
    items.basis = basis * items.weight[:, None]
    return search(encoded, items, item_type, limits)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options: float) -> DataFrame:
    """The rows of documents without a hit; all columns are kept."""
    hits = cut(contaminated(docs, benchmark, **options).select("doc_id").distinct())
    return docs.join(hits, "doc_id", "left_anti").select(docs.columns)
