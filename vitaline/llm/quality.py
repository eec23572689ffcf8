"""Quality rules by distribution divergence: histograms of a document against references by language.

Two histograms describe a text: its characters by class (lower case, upper case, digits, blanks, line ends,
stops, symbols, other letters) and its words by the `top` most common words of a language, all other words
as one bin. A reference is the sum of the histograms of all documents of a language that the base rules let
pass. The distance is Jensen-Shannon's (the root of the divergence in bits, 0 to 1); a document is compared
with each language's reference and judged by its nearest one. Word histograms of short texts are mostly
chance, so they count from `min_words` words on; references with less than `min_reference` words are not used.

Base rules: a text fails with fewer than 50 words, or if more than half of its words lie in 3-word windows
found twice or more. Null and empty texts have no words and fail. Documents without a language take part in
all but the references. Repeated rows are judged one by one and each counts in the references. Without any
reference the base rules alone decide. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitaline.llm.common import map_rows

SYMBOLS = "#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "blank", "line", "stop", "symbol", "other")
_STOPS = b".,;:!?\"'()-"
FLUSH_WORDS = 200_000  # distinct words a task holds before it hands on their counts


def _class_table() -> np.ndarray:
    """Class number of each byte; bytes that continue a character have none (8)."""
    table = np.full(256, CLASSES.index("symbol"), np.uint8)
    for name, chars in (
        ("lower", bytes(range(97, 123))),
        ("upper", bytes(range(65, 91))),
        ("digit", b"0123456789"),
        ("blank", b" \t\x0b\x0c\r"),
        ("line", b"\n"),
        ("stop", _STOPS),
    ):
        table[list(chars)] = CLASSES.index(name)
    table[0x80:0xC0] = len(CLASSES)
    table[0xC0:] = CLASSES.index("other")
    return table


_CLASS = _class_table()
_PLAIN = bytes.maketrans(_STOPS, b" " * len(_STOPS))


def char_classes(data: bytes) -> np.ndarray:
    return np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=len(CLASSES) + 1)[: len(CLASSES)]


def plain_words(data: bytes) -> Counter:
    """Lower-cased words without stops."""
    return Counter(data.lower().translate(_PLAIN).split())


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in 3-word windows that the text has twice or more, the first one included."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    pairs = ids[:-1] * len(number) + ids[1:]
    _, pairs = np.unique(pairs, return_inverse=True)
    _, triple, times = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    inside = np.zeros(len(words), bool)
    starts = np.flatnonzero(times[triple] > 1)
    for shift in range(3):
        inside[starts + shift] = True
    return int(inside.sum())


def base_counts(text: str | None) -> dict[str, int]:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    seen: set[str] = set()
    dups = 0
    for line in text.split("\n"):
        if line in seen:
            dups += 1
        elif line.strip(" \t\x0b\x0c\r"):
            seen.add(line)
    return {
        "n_words": len(words),
        "word_chars": len(text) - sum(map(text.count, " \t\n\r\x0b\x0c")),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": dups,
        "n_repeat_words": repeated_words(words),
    }


def failed(c: dict[str, int]) -> bool:
    return c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]


def references(docs: DataFrame, top: int, min_reference: int) -> dict[str, dict]:
    """Per language: shares of the character classes, the `top` words and their shares (the rest last).

    Counts cover all documents and are summed by Spark; what reaches the driver is `top` words a language.
    """

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        held: dict[str, Counter] = {}

        def rows() -> dict:
            out: dict[str, list] = {"lang": [], "word": [], "n": []}
            for lang, counts in held.items():
                out["lang"] += [lang] * len(counts)
                out["word"] += counts.keys()
                out["n"] += counts.values()
            held.clear()
            return out

        for b in batches:
            for lang, text in zip(b["lang"], b["text"], strict=True):
                if lang is None or not text or failed(base_counts(text)):
                    continue
                data = text.encode("utf-8", "surrogatepass")
                counts = held.setdefault(lang, Counter())
                counts.update(plain_words(data))
                for name, n in zip(CLASSES, char_classes(data).tolist(), strict=True):
                    counts[b" " + name.encode()] += n  # no word starts with a blank
                if sum(map(len, held.values())) > FLUSH_WORDS:
                    yield rows()
        yield rows()

    counts = map_rows(docs, ["lang", "text"], run, "lang string, word binary, n long")
    counts = counts.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("is_class", F.substring("word", 1, 1) == F.lit(b" "))
    order = Window.partitionBy("lang", "is_class").orderBy(F.desc("n"), "word")
    best = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(top, len(CLASSES)))
    totals = counts.where(~F.col("is_class")).groupBy("lang").agg(F.sum("n").alias("total"))
    found: dict[str, dict] = {}
    for lang, total in totals.where(F.col("total") >= min_reference).collect():
        found[lang] = {"total": total, "words": {}, "classes": {}}
    for row in best.collect():
        if row.lang in found:
            word = bytes(row.word)
            if row.is_class:
                found[row.lang]["classes"][word[1:].decode()] = row.n
            elif row.place <= top:
                found[row.lang]["words"][word] = row.n
    for ref in found.values():
        words = np.array([*ref["words"].values(), ref["total"] - sum(ref["words"].values())], float)
        classes = np.array([ref["classes"].get(c, 0) for c in CLASSES], float)
        ref |= {"word_share": words / words.sum(), "class_share": classes / classes.sum()}
    return dict(sorted(found.items()))


def distance(counts: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts to a distribution; 1 for a row without counts."""
    total = counts.sum(1, keepdims=True)
    p = counts / np.maximum(total, 1)
    m = (p + share) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        right = np.where(share > 0, share * np.log2(share / m), 0).sum(1)
    return np.where(total[:, 0] > 0, np.sqrt(np.clip((left + right) / 2, 0, 1)), 1.0)


def judge(
    docs: DataFrame,
    top: int = 50,
    min_words: int = 50,
    min_reference: int = 1000,
    max_char_distance: float = 0.3,
    max_word_distance: float = 0.45,
) -> DataFrame:
    """doc_id, the base counts, base_failed, nearest language and distances, kept."""
    refs = references(docs, top, min_reference)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            base = [base_counts(t) for t in b["text"]]
            fails = [failed(c) for c in base]
            data = [(t or "").encode("utf-8", "surrogatepass") for t in b["text"]]
            classes = np.array([char_classes(d) for d in data], float).reshape(len(data), len(CLASSES))
            words = [plain_words(d) for d in data]
            n_plain = np.array([sum(w.values()) for w in words], float)
            chars, heads = np.ones((len(data), 0)), np.ones((len(data), 0))
            for ref in refs.values():
                head = np.array([[w.get(x, 0) for x in ref["words"]] for w in words], float)
                head = np.column_stack([head.reshape(len(data), len(ref["words"])), n_plain])
                head[:, -1] -= head[:, :-1].sum(1)
                chars = np.column_stack([chars, distance(classes, ref["class_share"])])
                heads = np.column_stack([heads, distance(head, ref["word_share"])])
            out = {"doc_id": b["doc_id"], **{k: [c[k] for c in base] for k in base_counts(None)}}
            if refs and data:
                near = (chars + heads).argmin(1)
                at = np.arange(len(data))
                char, word = chars[at, near], heads[at, near]
                long = np.array(out["n_words"]) >= min_words
                good = (char <= max_char_distance) & (~long | (word <= max_word_distance))
                langs = [list(refs)[i] for i in near]
            else:
                char = word = np.zeros(len(data))
                good, langs = np.ones(len(data), bool), [None] * len(data)
            out |= {"base_failed": fails, "nearest": langs, "char_distance": char.tolist()}
            out |= {"word_distance": word.tolist(), "kept": [not f and bool(g) for f, g in zip(fails, good, strict=True)]}
            yield out

    counts = ", ".join(f"{k} long" for k in base_counts(None))
    schema = f"doc_id {kind}, {counts}, base_failed boolean, nearest string, char_distance double, word_distance double, kept boolean"
    return map_rows(docs, ["doc_id", "text"], run, schema)
