"""Periodic runs of words in a text, found by recursive frequency splitting and a lag scan.

A run is a stretch of words with smallest period q, at least max(`shortest`, `times` * q) words long, that no
neighbouring word extends keeping period q.

Splitting. A word of a run occurs in it `times` times or more, so a word that occurs less often within its
segment is in no run: it splits the segment. Parts shorter than `shortest` go, the others are counted anew,
until no segment changes. No run is cut: a word next to a run that kept its period would occur often enough.

Lag scan. For a lag q the words of a run equal those q further on over at least (`times` - 1) q places, so
for every lag that is not small one of the places 0, q, 2q, ... starts GRAM such equalities in a row. These
places are compared by hashes of GRAM words, for all lags of a segment in about 2 sqrt(length) vector steps;
small lags are compared at every place. What is found is followed word by word to both ends. A stretch found
again with a multiple of its period is the same run.

Null and empty texts have no words and no runs. Whole texts are scanned, at a cost of about length times its
logarithm. Rows are handled one by one: equal rows, ids that repeat and null ids are rows like others. Texts
are taken as bytes, so invalid UTF-8 is kept. Columns besides doc_id and text are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaline.llm.common import batches_out

SHORTEST = 24
TIMES = 3
GRAM = 8
_STEP = np.uint64(0x9E3779B97F4A7C15)

Run = tuple[int, int, int]  # start, length, period


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words."""
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))


def segments(ids: np.ndarray, shortest: int = SHORTEST, times: int = TIMES) -> list[tuple[int, int]]:
    """Start and end of the stretches that remain when words too rare within their stretch split it."""
    stable: list[tuple[int, int]] = []
    starts, ends = np.array([0]), np.array([len(ids)])
    while True:
        wide = ends - starts >= shortest
        starts, ends = starts[wide], ends[wide]
        if not len(starts):
            return sorted(stable)
        sizes = ends - starts
        offsets = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(starts)), sizes)
        place = np.arange(int(sizes.sum())) - offsets[owner] + starts[owner]
        # occurrences of each word within its own segment
        _, kind, count = np.unique(owner * (int(ids.max()) + 1) + ids[place], return_inverse=True, return_counts=True)
        rare = count[kind] < times
        changed = np.zeros(len(starts), bool)
        changed[owner[rare]] = True
        stable += zip(starts[~changed].tolist(), ends[~changed].tolist(), strict=True)
        keep = changed[owner] & ~rare
        # parts of changed segments: places that go on from the place before in the same segment
        fresh = np.ones(int(keep.sum()), bool)
        kept, mine = place[keep], owner[keep]
        fresh[1:] = (kept[1:] != kept[:-1] + 1) | (mine[1:] != mine[:-1])
        first = np.flatnonzero(fresh)
        starts = kept[first]
        ends = kept[np.append(first[1:], len(kept)) - 1] + 1 if len(first) else starts


def _grams(ids: np.ndarray) -> np.ndarray:
    out = np.zeros(len(ids) - GRAM + 1, np.uint64)
    for i in range(GRAM):
        out = (out ^ ids[i : len(out) + i].astype(np.uint64)) * _STEP
        out ^= out >> np.uint64(29)
    return out


def _reach(x: np.ndarray, y: np.ndarray) -> int:
    """How many first items of two arrays are equal, looked at in growing steps."""
    at, step, most = 0, 32, min(len(x), len(y))
    while at < most:
        end = min(at + step, most)
        differ = np.flatnonzero(x[at:end] != y[at:end])
        if len(differ):
            return at + int(differ[0])
        at, step = end, step * 2
    return most


class _Scan:
    """The runs of one segment, lags in ascending order."""

    def __init__(self, ids: np.ndarray, shortest: int, times: int):
        self.ids, self.shortest, self.times = ids, shortest, times
        self.found: dict[tuple[int, int], int] = {}  # start, length -> smallest period
        self.runs: list[Run] = []
        # end and period of the run found last that covers a word
        self.end = np.zeros(len(ids), np.int64)
        self.period = np.full(len(ids), len(ids))

    def known(self, place: np.ndarray, lag: np.ndarray | int) -> np.ndarray:
        """Whether the run found last at each place has the lag as a multiple of its period there."""
        return (lag % self.period[place] == 0) & (place + lag + GRAM <= self.end[place])

    def follow(self, place: int, lag: int) -> int:
        """Record the run of `lag` around a place that equals the one `lag` further; the end of the stretch."""
        ids = self.ids
        ahead = _reach(ids[place : len(ids) - lag], ids[place + lag :])
        back = _reach(ids[:place][::-1], ids[lag : place + lag][::-1])
        start, length = place - back, ahead + back + lag
        if length >= max(self.shortest, self.times * lag) and (start, length) not in self.found:
            self.found[start, length] = lag
            self.runs.append((start, length, lag))
            self.end[start : start + length] = start + length
            self.period[start : start + length] = lag
        return place + ahead

    def every_place(self, lag: int) -> None:
        least = max(self.shortest, self.times * lag) - lag
        same = np.concatenate([[False], self.ids[:-lag] == self.ids[lag:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        begin, size = edges[::2], edges[1::2] - edges[::2]
        for place in begin[size >= least].tolist():
            self.follow(place, lag)

    def candidates(self, places: np.ndarray, lag: int) -> None:
        done = -1
        for place in places[~self.known(places, lag)].tolist():
            if place >= done:
                done = self.follow(place, lag)

    def run(self) -> list[Run]:
        ids, n = self.ids, len(self.ids)
        most = n // self.times
        dense = min(max(GRAM, -(-self.shortest // self.times)), most + 1)
        for lag in range(1, dense):
            self.every_place(lag)
        if most < dense:
            return self.runs
        grams = _grams(ids)
        split = max(int(n**0.5), dense)
        for lag in range(dense, min(split, most + 1)):
            sampled = grams[::lag]
            self.candidates(np.flatnonzero(sampled[:-1] == sampled[1:]) * lag, lag)
        if most < split:
            return self.runs
        lags, places = [], []
        for j in range(n // split + 1):  # the j-th sampled place of all larger lags at once
            x, y = grams[j * split :: j] if j else grams[:1], grams[(j + 1) * split :: j + 1]
            count = min(len(y), most - split + 1) if not j else min(len(x), len(y), most - split + 1)
            if count <= 0:
                break
            lag = np.flatnonzero((x[:count] if j else x) == y[:count]) + split
            new = ~self.known(lag * j, lag)
            lags.append(lag[new])
            places.append((lag * j)[new])
        lag, place = np.concatenate(lags), np.concatenate(places)
        order = np.lexsort((place, lag))
        lag, place = lag[order], place[order]
        bounds = np.flatnonzero(np.concatenate([[True], lag[1:] != lag[:-1], [True]])) if len(lag) else []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            self.candidates(place[a:b], int(lag[a]))
        return self.runs


def runs(words: list[bytes], shortest: int = SHORTEST, times: int = TIMES) -> list[Run]:
    """(start, length, period) of every run, by start and then period. times: 3 at least."""
    if len(words) < shortest:
        return []
    ids = numbered(words)
    out = []
    for start, end in segments(ids, shortest, times):
        out += [(start + s, length, q) for s, length, q in _Scan(ids[start:end], shortest, times).run()]
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(n: int, found: list[Run]) -> np.ndarray:
    """Which of n words stay: those that no run contains after its first period."""
    keep = np.ones(n, bool)
    for start, length, period in found:
        keep[start + period : start + length] = False
    return keep


def strongest(found: list[Run]) -> Run | None:
    """The run with the greatest length / period; of equals the one that starts first, then the shortest period."""
    best = None
    for run in found:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


Rewrite = Callable[[object, list[bytes]], list[bytes]]


def collapse(docs: DataFrame, rewrite: Rewrite | None = None, shortest: int = SHORTEST, times: int = TIMES) -> DataFrame:
    """doc_id, runs (start, length, period of each) and collapsed: the text without the repeats of its runs.

    `rewrite` may change the words of a row before runs are looked for.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            ids = b.column("doc_id")
            all_runs, texts = [], []
            for doc_id, text in zip(ids.to_pylist(), b.column("text").to_pylist(), strict=True):
                words = (text or b"").split()
                if rewrite is not None:
                    words = rewrite(doc_id, words)
                found = runs(words, shortest, times)
                all_runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                if found:
                    words = [words[i] for i in np.flatnonzero(kept(len(words), found)).tolist()]
                texts.append(b" ".join(words))
            yield {"doc_id": ids, "runs": all_runs, "collapsed": texts}

    schema = f"doc_id {kind}, runs array<struct<start: long, length: long, period: long>>, collapsed binary"
    out = batches_out(docs.select("doc_id", F.col("text").cast("binary").alias("text")), run, schema)
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def planted(doc_id: object, words: list[bytes]) -> list[bytes]:
    """Words made periodic from some place on for a tenth of the ids; rows without an id stay as they are."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    first = g % n
    period = 1 + (n - first) // (3 + g % 8)
    return [w if i < first else words[first + (i - first) % period] for i, w in enumerate(words)]


def digests(collapsed: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run and digests of the runs and the collapsed text."""

    def stronger(best, run):
        ahead = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | ahead, run).otherwise(best)

    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    best = F.aggregate("runs", none, stronger)
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    rows = collapsed.withColumn("best", best)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.*",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
