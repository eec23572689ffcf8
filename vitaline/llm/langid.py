"""Language identification by interpolated Kneser-Ney character models, one per language.

A text is read as lower-cased words of letters (ASCII signs and digits separate words, other characters
belong to them), each with a blank before and after; the blank before is context only. A language's model
gives each character's probability from up to `order - 1` characters before it in its word: discounted
counts of the longest context, interpolated down to single characters and a uniform share. Orders below the
longest use continuation counts (distinct characters to the left), except at word starts, which nothing
precedes. All models are kept together in sorted arrays of 64-bit hashes, per order one array of contexts
and one of n-grams, with a column for each language.

The prediction is the language with the lowest cross-entropy in bits per character. `score` is its
probability when all languages are equally likely and at most EVIDENCE characters count as independent.
Part of the learning sample is held back to calibrate rejection: a text is rejected if its cross-entropy
exceeds the language's mean by MARGIN bits and `reject` standard deviations at its length.

Models are fitted on a bounded sample: of the `languages` most frequent languages each the `sample` documents
with the lowest hashes of their ids, as far as these have at most `chars` characters together, among the rows
the caller offers; a document with more than a hundredth of `chars` is predicted but not learned from. Words
are counted in Spark, as are n-grams, continuations, discounts and the shares that follow; the driver puts the
finished shares into sorted arrays, whose size the sample bounds.

Null texts and texts without a letter get `und`, score 0, and are rejected; with nothing to learn from, all get
`und`. Rows without an id are predicted; callers that deal rows by id do not learn from them. Rows are predicted
one by one from their text alone; repeated rows and extra columns make no difference. An empty table gives an
empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitaline.llm.common import fold, map_rows
from vitaline.session import cut

ORDER = 5
SAMPLE = 1500
CHARS = 16_000_000
LANGUAGES = 200
SAMPLE_BUCKETS = 1 << 16
PORTION = 1 << 20  # characters of words counted together in a task
EVIDENCE = 64
MARGIN = 2.0
UNKNOWN = "und"
CACHE_WORDS = 300_000  # words whose scores a worker remembers; the memory is emptied when full
_SEPARATE = bytes.maketrans(bytes(range(65)) + b"[\\]^_`{|}~\x7f", b" " * 76)
_LETTER = re.compile(r"[^\W\d_]")
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_SEPARATE).split()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MULTIPLY
    return h ^ (h >> np.uint64(32))


def grams(words: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Every character of the words, the blank after included, with what precedes it.

    Returns (word number, place in the word from 1, hashes of the last k characters for k = 0..order that
    end at the character, characters). Hashes of k characters count only where k <= place + 1.
    """
    chars = np.frombuffer(b"".join(w.decode("utf-8", "replace").encode("utf-32-le") + b" \0\0\0" for w in words), "<u4")
    ends = np.flatnonzero(chars == 32)
    word = np.searchsorted(ends, np.arange(len(chars)))
    place = np.arange(len(chars)) - np.concatenate(([-1], ends[:-1]))[word]
    hashes = [np.zeros(len(chars), np.uint64)]
    powers = chars.astype(np.uint64) + np.uint64(1)
    for k in range(1, order + 1):
        older = np.full(len(chars), 33, np.uint64)  # the blank before the word
        if k <= len(chars):
            older[k - 1 :] = powers[: len(chars) - k + 1]
        older[place == k - 1] = 33
        hashes.append(_mix(hashes[-1] * np.uint64(31) + older + np.uint64(k)))
    return word, place, hashes, chars


class Model:
    """Probabilities of all languages; see the module's text.

    tables: for each length of n-grams their sorted hashes, their shares by language, the sorted hashes of their
    contexts and what each context leaves to shorter ones. A last row of shares and rests is for what is not found.
    """

    def __init__(self, langs: list[str], tables: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self.langs, self.tables, self.order = langs, tables, len(tables)
        self.uniform = 1.0 / (len(tables[0][0]) + 1)

    def score(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each word in each language, and characters of each word."""
        word, place, hashes, chars = grams(words, self.order)
        before = grams_before(word, place, hashes, chars, self.order)
        p = np.full((len(chars), len(self.langs)), self.uniform, np.float32)
        for k, (keys, share, contexts, rest) in enumerate(self.tables, 1):
            ok = place + 1 >= k
            p[ok] = share[_find(keys, hashes[k][ok])] + rest[_find(contexts, before[k - 1][ok])] * p[ok]
        bits = -np.log2(p)
        starts = np.flatnonzero(place == 1)
        return np.add.reduceat(bits, starts, axis=0), np.bincount(word, minlength=len(words))


def grams_before(
    word: np.ndarray, place: np.ndarray, hashes: list[np.ndarray], chars: np.ndarray, order: int
) -> list[np.ndarray]:
    """Hashes of the k characters before each character, k = 0..order - 1."""
    blank = _mix(np.array([33 + 1], np.uint64))[0]  # the blank before a word, as a gram of one character
    out = [hashes[0]]
    for k in range(1, order):
        h = np.zeros(len(chars), np.uint64)
        h[1:] = hashes[k][:-1]
        first = place == 1
        h[first] = blank if k == 1 else 0
        out.append(h)
    return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted key in the sorted keys, or the number of keys."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, len(keys))


class Identifier:
    """A model, what calibration found, and scores of words seen before."""

    def __init__(self, model: Model, mean: np.ndarray, spread: np.ndarray, reject: float):
        self.model, self.mean, self.spread, self.reject = model, mean, spread, reject
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.bits = np.zeros((1024, len(self.model.langs)), np.float32)
        self.chars = np.zeros(1024, np.int64)

    def __getstate__(self) -> tuple:
        return self.model, self.mean, self.spread, self.reject

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per character in each language (NaN without a letter), and characters, of each text."""
        if len(self.known) > CACHE_WORDS:
            self._forget()
        split = [words_of(t) if t and _LETTER.search(t) else [] for t in texts]
        new = list(set().union(*split) - self.known.keys())
        for start in range(0, len(new), 1 << 14):
            self._learn(new[start : start + (1 << 14)])
        out = np.full((len(texts), len(self.model.langs)), np.nan)
        length = np.zeros(len(texts), np.int64)
        for i, words in enumerate(split):
            if words:
                at = list(map(self.known.__getitem__, words))
                length[i] = self.chars[at].sum()
                out[i] = self.bits[at].sum(0, dtype=float) / length[i]
        if new and max(map(len, new)) > 200:  # do not hold on to very long words
            self._forget()
        return out, length

    def _learn(self, words: list[bytes]) -> None:
        n = len(self.known)
        while n + len(words) > len(self.chars):
            self.bits = np.concatenate([self.bits, np.zeros_like(self.bits)])
            self.chars = np.concatenate([self.chars, np.zeros_like(self.chars)])
        self.bits[n : n + len(words)], self.chars[n : n + len(words)] = self.model.score(words)
        self.known.update(zip(words, range(n, n + len(words)), strict=True))

    def predict(self, texts: list[str | None]) -> dict[str, list]:
        bits, length = self.entropies(texts)
        some = length > 0
        low = np.where(some[:, None], bits, 0.0)
        best = low.argmin(1)
        at = np.arange(len(texts))
        odds = np.exp2(-(low - low[at, best][:, None]) * np.minimum(length, EVIDENCE)[:, None])
        limit = self.mean[best] + MARGIN + self.reject * self.spread[best] / np.sqrt(np.maximum(length, 1))
        return {
            "lang_pred": [self.model.langs[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)],
            "score": np.where(some, 1 / odds.sum(1), 0.0).tolist(),
            "bits_per_char": [float(low[i, b]) if some[i] else None for i, b in zip(at, best, strict=True)],
            "rejected": (~some | (low[at, best] > limit)).tolist(),
        }


def _word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n of rows (lang, text), dealt over tasks by word."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        counts: Counter = Counter()
        held = 0

        def counted() -> dict:
            out = {"lang": [k[0] for k in counts], "word": [k[1] for k in counts], "n": list(counts.values())}
            counts.clear()
            return out

        for b in batches:
            for lang, text in zip(b["lang"], b["text"], strict=True):
                words = words_of(text or "")
                counts.update((lang, w) for w in words)
                held += len(text or "")
            if held > 8 * PORTION:
                yield counted()
                held = 0
        yield counted()

    counted = map_rows(docs, ["lang", "text"], run, "lang string, word binary, n long")
    tasks = 2 * docs.sparkSession.sparkContext.defaultParallelism  # too little data for them to be planned by bytes
    return counted.repartition(tasks, "lang", "word").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _gram_counts(words: DataFrame, order: int) -> DataFrame:
    """lang, k, gram, context, suffix (the gram without its first character), n, start (of n: at a word's start)."""
    names = ("lang", "k", "gram", "context", "suffix", "n", "start")

    def counted(lang: str, own: list[bytes], times: list[int]) -> Iterator[dict]:
        word, place, hashes, chars = grams(own, order)
        before = grams_before(word, place, hashes, chars, order)
        weight = np.array(times, float)[word]
        for k in range(1, order + 1):
            ok = place + 1 >= k
            keys, first, back = np.unique(hashes[k][ok], return_index=True, return_inverse=True)
            n = np.bincount(back, weight[ok]).astype(np.int64)
            start = np.bincount(back, weight[ok] * (place[ok] == k - 1)).astype(np.int64)
            context, suffix = (h[ok][first].view(np.int64) for h in (before[k - 1], hashes[k - 1]))
            values = ([lang] * len(keys), np.full(len(keys), k, np.int32), keys.view(np.int64), context, suffix, n, start)
            for i in range(0, len(keys), 100_000):
                yield {name: v[i : i + 100_000] for name, v in zip(names, values, strict=True)}

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        held: dict[str, tuple[list, list]] = {}
        size = 0
        for b in batches:
            for lang, w, n in zip(b["lang"], b["word"], b["n"], strict=True):
                own, times = held.setdefault(lang, ([], []))
                own.append(bytes(w))
                times.append(n)
                size += len(w)
            if size > PORTION:
                for lang, (own, times) in held.items():
                    yield from counted(lang, own, times)
                held, size = {}, 0
        for lang, (own, times) in held.items():
            yield from counted(lang, own, times)

    schema = "lang string, k int, gram long, context long, suffix long, n long, start long"
    parts = map_rows(words, ["lang", "word", "n"], run, schema)
    both = [F.min("context").alias("context"), F.min("suffix").alias("suffix")]
    return parts.groupBy("lang", "k", "gram").agg(*both, F.sum("n").alias("n"), F.sum("start").alias("start"))


def _arrays(rows: DataFrame, langs: list[str], order: int, missing: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted keys and a column of values for each language, by k, of rows (k, key, lang, value)."""
    number = F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang")).cast("short") - 1
    found = rows.select("k", "key", number.cast("short").alias("lang"), "value").toArrow()
    k, key, lang, value = (found.column(name).to_numpy() for name in ("k", "key", "lang", "value"))
    out = []
    for size in range(1, order + 1):
        own = np.flatnonzero(k == size)
        keys, row = np.unique(key[own].view(np.uint64), return_inverse=True)
        values = np.full((len(keys) + 1, len(langs)), missing, np.float32)  # the last row: not found
        values[row, lang[own]] = value[own]
        out.append((keys, values))
    return out


def train(words: DataFrame, order: int = ORDER) -> Model | None:
    """The model of rows (lang, word, n); None without rows. Its size is that of the distinct n-grams."""
    counts = cut(_gram_counts(words, order))
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())  # as many as the caller samples
    if not langs:
        return None
    longer = counts.where("k > 1").select("lang", F.expr("k - 1 AS k"), F.col("suffix").alias("gram"), F.lit(1).alias("kinds"))
    longer = longer.groupBy("lang", "k", "gram").agg(F.sum("kinds").alias("kinds"))
    continued = F.when(F.col("k") < order, F.coalesce("kinds", "start")).otherwise(F.col("n"))
    grams_ = counts.join(longer, ["lang", "k", "gram"], "left").select("lang", "k", "gram", "context", continued.alias("mass"))
    grams_ = cut(grams_)
    once, twice = F.count_if(F.col("mass") == 1), F.count_if(F.col("mass") == 2)
    discount = F.least(F.greatest(F.when(once > 0, once / (once + 2 * twice)).otherwise(0.5), F.lit(0.1)), F.lit(0.9))
    discounts = grams_.groupBy("lang", "k").agg(discount.alias("discount"))
    contexts = grams_.groupBy("lang", "k", "context").agg(F.sum("mass").alias("total"), F.count("*").alias("kinds"))
    contexts = cut(contexts.join(discounts, ["lang", "k"]))
    share = ((F.col("mass") - F.col("discount")) / F.col("total")).cast("float")
    shares = grams_.join(contexts, ["lang", "k", "context"]).select("lang", "k", F.col("gram").alias("key"), share.alias("value"))
    rest = (F.col("discount") * F.col("kinds") / F.col("total")).cast("float")
    rests = contexts.select("lang", "k", F.col("context").alias("key"), rest.alias("value"))
    shares, rests = _arrays(shares, langs, order, 0.0), _arrays(rests, langs, order, 1.0)
    return Model(langs, [a + b for a, b in zip(shares, rests, strict=True)])


def _sample(labelled: DataFrame, sample: int, chars: int, languages: int) -> DataFrame:
    """doc_id, lang, text of the documents to learn from.

    Documents are counted by language and bucket of their ids' hash; only those of the buckets up to the one in
    which the sample ends are ranked.
    """
    size = F.length("text")
    rows = labelled.where(F.col("lang").isNotNull() & (size > 0) & (size <= chars // 100)).select("doc_id", "lang", "text")
    rank = F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample"))
    rows = rows.withColumns({"rank": rank, "bucket": F.floor((rank.cast("double") / 2.0**64 + 0.5) * SAMPLE_BUCKETS)})
    counts = cut(rows.groupBy("lang", "bucket").agg(F.count("*").alias("n")))
    known = counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).select("lang")
    upto = Window.partitionBy("lang").orderBy("bucket")  # SAMPLE_BUCKETS rows a language
    ends = counts.join(known, "lang").withColumn("before", F.sum("n").over(upto) - F.col("n")).where(F.col("before") < sample)
    ends = ends.groupBy("lang").agg(F.max("bucket").alias("last"))
    near = rows.join(F.broadcast(ends), "lang").where("bucket <= last")  # `languages` rows
    order_by = Window.partitionBy("lang").orderBy("rank", "doc_id", F.xxhash64("text"))
    taken = near.withColumn("place", F.row_number().over(order_by)).where(F.col("place") <= sample)
    total = F.sum(F.length("text").cast("long")).over(Window.partitionBy("lang").orderBy("place"))
    return cut(taken.withColumn("total", total).where(F.col("total") <= chars).select("doc_id", "lang", "text"))


def fit(
    labelled: DataFrame,
    sample: int = SAMPLE,
    order: int = ORDER,
    reject: float = 6.0,
    chars: int = CHARS,
    languages: int = LANGUAGES,
) -> Identifier | None:
    """An identifier from rows (doc_id, text, lang); None if no row has a language and a word.

    Reads `sample` documents a language. One in ten calibrates rejection, the others train the models.
    """
    taken = _sample(labelled, sample, chars, languages)
    held = F.coalesce(fold(F.col("doc_id"), 10) == 9, F.lit(False))
    model = train(_word_counts(taken.where(~held)), order)
    if model is None:
        return None
    flat = Identifier(model, np.zeros(len(model.langs)), np.zeros(len(model.langs)), reject)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            bits, length = flat.entropies(b["text"])
            own = [model.langs.index(x) if x in model.langs else -1 for x in b["lang"]]
            rows = [(x, float(h[o]), int(n)) for x, h, n, o in zip(b["lang"], bits, length, own, strict=True) if n and o >= 0]
            yield {name: [r[i] for r in rows] for i, name in enumerate(("lang", "bits", "n"))}

    # a tenth of the sample, two numbers a document
    seen = map_rows(taken.where(held), ["lang", "text"], run, "lang string, bits double, n long").collect()
    mean, spread = np.full(len(model.langs), math.inf), np.zeros(len(model.langs))  # inf: nothing is rejected
    for i, lang in enumerate(model.langs):
        bits = np.array([r.bits for r in seen if r.lang == lang])
        n = np.array([r.n for r in seen if r.lang == lang], float)
        if len(bits) >= 10:
            mean[i] = np.median(bits)  # some documents are labelled with a wrong language
            spread[i] = 1.4826 * np.median(np.abs(bits - mean[i]) * np.sqrt(n))
    return Identifier(model, mean, spread, reject)


def identify(docs: DataFrame, identifier: Identifier | None, keep: list[str] | None = None) -> DataFrame:
    """doc_id (or the columns `keep`), lang_pred, score, bits_per_char, rejected."""
    kinds = dict(docs.dtypes)
    names = keep or ["doc_id"]

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            n = len(b["text"])
            none = {"lang_pred": [UNKNOWN] * n, "score": [0.0] * n, "bits_per_char": [None] * n, "rejected": [True] * n}
            yield {k: b[k] for k in names} | (identifier.predict(b["text"]) if identifier else none)

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names)
    schema += ", lang_pred string, score double, bits_per_char double, rejected boolean"
    return map_rows(docs, dict.fromkeys([*names, "text"]), run, schema)
