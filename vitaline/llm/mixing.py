"""Language-model scores by online logistic context mixing.

A text (A-Z lower-cased) is a sequence of tokens: its words, each with a blank after it, then one line end.
Bytes are coded as binary decisions along a Huffman tree of the learning bytes, so a byte takes as many
decisions as it has bits of information rather than eight.

Predictors. A context is the last few bytes of the token, or all of it so far, alone or together with the
script: the last byte beyond ASCII in the tokens before, which tells languages apart. For each kind a hashed
table counts the decisions seen in (context, tree node); a predictor's input is the log odds
ln((n1 + a) / (n0 + a)). A last predictor expects the token before once more: its input is 1 while the
decisions agree with that token's, -1 where they first differ, then 0.

Gated weights. A gate is chosen by the place in the token and by how often the two longest contexts were
seen. Each gate has its own weights, a logistic regression fitted by Newton steps to all distinct tokens,
weighted by their counts over all learning documents; a token's own occurrence is taken out of the counts
before it is predicted.

Online mixing. Within a document, the gate's log odds and all inputs are mixed once more by weights that
start at (1, 0, ..., 0) and take a gradient step after every BLOCK tokens. Adaptive refinement then replaces
half of each probability by how often this document's earlier decisions of like confidence came true. All
steps use earlier tokens only, so the probabilities of all texts sum to one.

Counting covers all learning documents: Spark counts the tokens, tasks count decisions of the
counted tokens into tables of a fixed size, which are summed in pieces. Scoring is one pass over the texts;
a document's state depends on nothing but the document. The base score needs every token's count: the
`common` most frequent tokens are known to the tasks, all others go through a join.

Null and empty texts have one token, the end. Repeated rows are scored one by one; ids may be null or
repeated. Without learning documents, tables are empty, gates are untrained, and base_score is that of an
empty vocabulary (-log10 of 1 a token). An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaline.llm.common import map_rows
from vitaline.session import cut

BLOCK = 128  # tokens between two steps of a document's weights
STEP = 0.02
PRIOR = 0.4  # a of the log odds
REPEAT_STEP = 0.5  # of the weight of the predictor that expects the token before
WAY = 52  # decisions for which it does so
BANDS, BAND_WIDTH, BAND_PRIOR = 48, 0.25, 100.0
COMMON = 1 << 18
PORTION = 1_000_000  # bytes of texts whose distinct tokens are looked up together
FLUSH_KEYS = 300_000
CHUNK = 2048  # keys whose decisions are worked out together
FILL_KEYS = 1_500_000  # keys for which a task fills tables of its own
END = b"\n"
#: bytes of the context (None: the whole token so far), whether the script belongs to it, bits of the table's size
PREDICTORS = ((1, True, 18), (3, False, 20), (5, False, 20), (3, True, 20), (None, False, 21), (None, True, 21))
K = len(PREDICTORS)
_PIECE = 1 << 15  # slots summed together, for both branches
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_P = np.uint64(0x100000001B3)
_P_INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))
_WAY_BITS = np.append(1 << np.arange(WAY - 1, -1, -1, dtype=np.int64), 0)
_PLACES = np.array([0, 1, 2, 3, 3, 4])  # place in the token -> class, 4 from the fifth byte on
_SEEN = np.array([0, 1, 1, 1, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 3], np.uint8)  # times seen -> class, 3 from 16 on
GATES = 5 * 4 * 4


def tokens_of(text: str | None) -> list[bytes]:
    """Tokens without the blank that ends each word."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def keyed(split: list[list[bytes]]) -> tuple[list[bytes], list[np.ndarray]]:
    """Distinct keys of some texts' tokens, and each text as numbers of keys.

    A key is the script (the last byte beyond ASCII in the text before the token, less 0x7F; or 0) and the token.
    """
    number: dict[bytes, int] = {}
    texts = [np.array([number.setdefault(t, len(number)) for t in tokens], np.int64) for tokens in split]
    tokens = list(number)
    last = np.array([0 if t.isascii() else t.translate(None, _ASCII)[-1] - 0x7F for t in tokens], np.int64)
    pairs = []
    for text in texts:
        own = last[text]
        latest = np.maximum.accumulate(np.where(own > 0, np.arange(1, len(own) + 1), 0))
        script = np.zeros(len(own), np.int64)
        script[1:] = np.where(latest[:-1] > 0, own[latest[:-1] - 1], 0)
        pairs.append(script * len(tokens) + text)
    distinct, back = np.unique(np.concatenate(pairs), return_inverse=True)
    keys = [bytes((s,)) + tokens[t] for s, t in zip(*(x.tolist() for x in np.divmod(distinct, len(tokens))), strict=True)]
    return keys, np.split(back, np.cumsum([len(p) for p in pairs])[:-1])


_ASCII = bytes(range(128))


class Code:
    """A Huffman code of the bytes: for each byte the nodes on its way and the branches taken."""

    def __init__(self, counts: np.ndarray):
        heap = [(int(n) + 1, b, b) for b, n in enumerate(counts)]
        heapq.heapify(heap)
        above: dict[int, tuple[int, int]] = {}
        node = 256
        while len(heap) > 1:
            (n, _, left), (m, _, right) = heapq.heappop(heap), heapq.heappop(heap)
            above[left], above[right] = (node, 0), (node, 1)
            heapq.heappush(heap, (n + m, node, node))
            node += 1
        ways = []
        for byte in range(256):
            way, at = [], byte
            while at in above:
                at, branch = above[at]
                way.append((at - 256, branch))
            ways.append(way[::-1])
        self.length = np.array([len(w) for w in ways])
        self.nodes = np.zeros((256, self.length.max()), np.uint64)
        self.branches = np.zeros((256, self.length.max()), bool)
        for byte, way in enumerate(ways):
            for depth, (node, branch) in enumerate(way):
                self.nodes[byte, depth], self.branches[byte, depth] = node, bool(branch)
        self.width = self.nodes.shape[1]
        self.flat_nodes = (self.nodes.reshape(-1) + np.uint64(1)) * _M1
        self.flat_branches = self.branches.reshape(-1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M2
    return h ^ (h >> np.uint64(29))


class Decisions:
    """All decisions of some keys: slots[k] in predictor k's table, branch taken, place, decisions a token."""

    def __init__(self, keys: list[bytes], code: Code):
        script = np.array([k[0] for k in keys], np.uint64)
        tokens = [k[1:] for k in keys]
        joined = b"".join([t if t == END else t + b" " for t in tokens])
        data = np.frombuffer(joined, np.uint8).astype(np.int64)
        sizes = np.array([len(t) + (t != END) for t in tokens], np.int64)
        starts = np.cumsum(sizes) - sizes
        place = np.arange(len(data)) - np.repeat(starts, sizes)
        values = data.astype(np.uint64) + np.uint64(1)
        counts = code.length[data]
        begin = np.cumsum(counts) - counts
        # row of the code's table: the byte's first one, and on from there
        at = np.arange(begin[-1] + counts[-1] if len(data) else 0) + np.repeat(data * code.width - begin, counts)
        node = code.flat_nodes[at]
        self.branch = code.flat_branches[at]
        self.place = np.repeat(place, counts)
        self.counts = np.add.reduceat(counts, starts) if len(tokens) else counts
        first = np.cumsum(self.counts) - self.counts
        step = np.minimum(np.arange(len(at)) - np.repeat(first, self.counts), WAY)
        early = _WAY_BITS[step] * self.branch
        self.way = np.add.reduceat(early, first) if len(tokens) else early  # the first WAY branches of each key
        self.slots = []
        script = (np.repeat(script, sizes) + np.uint64(1)) * _M2
        hashes: dict[int | None, np.ndarray] = {}
        context = np.zeros(len(data), np.uint64)
        reach = 0
        for order, with_script, bits in PREDICTORS:
            if order in hashes:
                context = hashes[order]
            elif order is None:
                power = np.cumprod(np.full(len(data), _P, np.uint64))
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * power)))[:-1]
                first = np.repeat(starts, sizes)
                # powers of the inverse bring every token's hash back to the same start
                back = np.cumprod(np.full(len(data), _P_INVERSE, np.uint64))
                context = _mix((sums - sums[first]) * back[first] + np.uint64(77))
            else:
                while reach < order:
                    reach += 1
                    older = np.zeros(len(data), np.uint64)
                    older[reach:] = values[:-reach] if reach <= len(data) else 0
                    older[place < reach] = 0
                    context = _mix(context * _M1 + older + np.uint64(reach))
            hashes[order] = context
            mixed = np.repeat(_mix(context ^ script) if with_script else context, counts)
            mixed ^= node
            mixed *= _M2
            mixed >>= np.uint64(64 - bits)
            self.slots.append(mixed.view(np.int64))


def gates(place: np.ndarray, seen: list[np.ndarray]) -> np.ndarray:
    """Gate of each decision; `seen`: classes of how often the two longest contexts were seen."""
    longest, next_one = seen
    return (_PLACES[np.minimum(place, len(_PLACES) - 1)] * 4 + longest) * 4 + next_one


def seen_class(times: np.ndarray) -> np.ndarray:
    return _SEEN[np.minimum(times, len(_SEEN) - 1).astype(np.int64)]


def log_odds(n1: np.ndarray, n0: np.ndarray) -> np.ndarray:
    return np.log((n1 + np.float32(PRIOR)) / (n0 + np.float32(PRIOR)))


class Model:
    """Tables of counts (one row per branch), the code, and weights by gate."""

    def __init__(self, code: Code, tables: list[np.ndarray], weights: np.ndarray):
        self.code, self.weights = code, weights
        self.tables = tables
        self.odds: list[np.ndarray] = []
        self.classes: list[np.ndarray] = []
        self.shared: Broadcast | None = None  # this model with its tables, sent to the executors once

    def __getstate__(self) -> dict:
        return {**self.__dict__, "odds": [], "classes": [], "shared": None}

    def prepare(self) -> None:
        """Log odds of all slots, once per worker."""
        if not self.odds:
            self.odds = [log_odds(t[1].astype(np.float32), t[0].astype(np.float32)) for t in self.tables]
            self.classes = [seen_class(t.sum(0, dtype=np.int64)) for t in self.tables[-2:]]

    def learning_inputs(self, keys: list[bytes]) -> tuple[Decisions, np.ndarray, np.ndarray]:
        """Decisions, gates and inputs, signed by the branch, with one own occurrence taken out."""
        d = Decisions(keys, self.code)
        inputs = np.empty((len(d.branch), K), np.float32)
        seen = []
        for k, slots in enumerate(d.slots):
            taken = self.tables[k][d.branch.astype(np.int64), slots].astype(np.float32) - 1
            other = self.tables[k][1 - d.branch.astype(np.int64), slots].astype(np.float32)
            np.maximum(taken, 0, out=taken)
            inputs[:, k] = log_odds(taken, other)
            seen.append(taken + other)
        return d, gates(d.place, [seen_class(seen[-1]), seen_class(seen[-2])]), inputs

    def inputs(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First row of each key (and the end), rows of (gate's log odds, inputs, 0), signed, and ways."""
        self.prepare()
        weights = self.weights.astype(np.float32)
        parts, counts, ways = [], [], []
        for start in range(0, len(keys), CHUNK):
            d = Decisions(keys[start : start + CHUNK], self.code)
            rows = np.zeros((len(d.branch), K + 2), np.float32)
            for k, slots in enumerate(d.slots):
                rows[:, k + 1] = self.odds[k][slots]
            gate = gates(d.place, [self.classes[1][d.slots[-1]], self.classes[0][d.slots[-2]]])
            rows[:, 0] = np.einsum("ij,ij->i", rows[:, 1:-1], weights[gate])
            rows *= np.where(d.branch, np.float32(1), np.float32(-1))[:, None]
            parts.append(rows)
            counts.append(d.counts)
            ways.append(d.way)
        return np.concatenate(([0], np.cumsum(np.concatenate(counts)))), np.concatenate(parts), np.concatenate(ways)


_BAND_START = 1 / (1 + np.exp(-(np.arange(BANDS) + 0.5) * BAND_WIDTH))  # of the likelier branch
_BAND_START[0] = 0.5  # the band around 0 tells nothing
_NATS = 1 / math.log(2)  # bits
_STEPS = np.array([STEP] * (K + 1) + [REPEAT_STEP], np.float32)


def _refinement(right: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Probability that a decision comes true, by the signed band of its log odds."""
    high = right / times
    high[0] = 0.5
    return np.concatenate((1 - high[::-1], high)).astype(np.float32)


def document_bits(keys: np.ndarray, first: np.ndarray, rows: np.ndarray, ways: np.ndarray) -> float:
    """Bits of a document given the rows of its keys; weights and refinement start anew."""
    weights = np.zeros(K + 2, np.float32)
    weights[0] = 1
    squares = np.full(K + 2, 1e-3, np.float32)
    right, times = _BAND_START * BAND_PRIOR, np.full(BANDS, BAND_PRIOR)
    table = _refinement(right, times)
    low = first[keys]
    counts = first[keys + 1] - low
    way = ways[keys]
    agree = np.zeros(len(keys), np.int64)  # decisions on which a token agrees with the one before
    agree[1:] = WAY - np.frexp((way[1:] ^ way[:-1]).astype(float))[1]
    np.minimum(agree, counts, out=agree)
    differs = (agree < WAY) & (agree < counts)
    differs[0] = False
    total = 0.0
    one = np.float32(1)
    for start in range(0, len(keys), BLOCK):
        n = counts[start : start + BLOCK]
        begin = np.cumsum(n) - n
        x = rows[np.arange(begin[-1] + n[-1]) + np.repeat(low[start : start + BLOCK] - begin, n)]
        same = agree[start : start + BLOCK]
        x[np.arange(same.sum()) + np.repeat(begin - np.cumsum(same) + same, same), -1] = one
        x[(begin + same)[differs[start : start + BLOCK]], -1] = -one
        z = x @ weights
        p = one / (one + np.exp(-z))
        z *= np.float32(1 / BAND_WIDTH)
        z += np.float32(BANDS)
        band = np.clip(z, 0, 2 * BANDS - 0.5, out=z).astype(np.intp)
        total += len(p) - float(np.log(p + table[band]).sum(dtype=float)) * _NATS
        gradient = (one - p) @ x
        squares += gradient * gradient
        weights += _STEPS * gradient / np.sqrt(squares)
        seen = np.bincount(band, minlength=2 * BANDS)
        right += seen[BANDS:]
        times += seen[BANDS:] + seen[:BANDS][::-1]
        table = _refinement(right, times)
    return total


def _portions(batches: Iterator[dict]) -> Iterator[tuple[list, list[bytes], list[np.ndarray]]]:
    """Ids, distinct keys and texts as numbers of keys, for runs of documents of about PORTION characters."""
    ids, split, size = [], [], 0
    for b in batches:
        for doc_id, text in zip(b.get("doc_id", b["text"]), b["text"], strict=True):
            ids.append(doc_id)
            split.append(tokens_of(text))
            size += len(text or "")
            if size > PORTION:
                yield ids, *keyed(split)
                ids, split, size = [], [], 0
    if split:
        yield ids, *keyed(split)


def count_keys(docs: DataFrame) -> DataFrame:
    """key, n over all rows."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        held: dict[bytes, int] = {}
        for _, keys, texts in _portions(batches):
            times = np.bincount(np.concatenate(texts), minlength=len(keys)).tolist()
            for key, n in zip(keys, times, strict=True):
                held[key] = held.get(key, 0) + n
            if len(held) > FLUSH_KEYS:
                yield {"key": list(held.keys()), "n": list(held.values())}
                held.clear()
        yield {"key": list(held.keys()), "n": list(held.values())}

    counted = map_rows(docs, ["text"], run, "key binary, n long")
    return cut(counted.groupBy("key").agg(F.sum("n").alias("n")))


def _byte_counts(counts: DataFrame) -> np.ndarray:
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        total = np.zeros(256)
        for b in batches:
            tokens = [k[1:] if k[1:] == END else k[1:] + b" " for k in b["key"]]
            sizes = np.array([len(t) for t in tokens])
            total += np.bincount(np.frombuffer(b"".join(tokens), np.uint8), np.repeat(np.array(b["n"]), sizes), 256)
        yield {"byte": list(range(256)), "n": total.astype(np.int64).tolist()}

    out = np.zeros(256, np.int64)
    for row in map_rows(counts, ["key", "n"], run, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        out[row.byte] = row.n
    return out


def _packed(values: np.ndarray, kind: type = np.uint32) -> bytes:
    """The slots of a piece that are not 0, and their counts."""
    slots = np.flatnonzero(values)
    return slots.astype(np.uint16).tobytes() + np.minimum(values[slots], np.iinfo(kind).max).astype(kind).tobytes()


def _add_packed(total: np.ndarray, packed: bytes, kind: type = np.uint32) -> None:
    n = len(packed) // (2 + np.dtype(kind).itemsize)
    total[np.frombuffer(packed, np.uint16, n)] += np.frombuffer(packed, kind, n, 2 * n)


def _tables(counts: DataFrame, code: Code, keys: int) -> list[np.ndarray]:
    """Counts of decisions by branch and slot; tasks fill whole tables, Spark sums and scales them piece by piece.

    A task takes FILL_KEYS keys or more, since what it hands on is up to the tables' size. The driver takes the
    scaled pieces of one table at a time.
    """

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        tables = [np.zeros((2, 1 << bits), np.int64) for *_, bits in PREDICTORS]
        for b in batches:
            for start in range(0, len(b["key"]), CHUNK):
                d = Decisions(b["key"][start : start + CHUNK], code)
                times = np.repeat(np.array(b["n"][start : start + CHUNK], np.int64), d.counts)
                for table, slots in zip(tables, d.slots, strict=True):
                    np.add.at(table.reshape(-1), slots + d.branch * table.shape[1], times)
        for k, table in enumerate(tables):
            pieces = [p for p in range(0, table.shape[1], _PIECE) if table[:, p : p + _PIECE].any()]
            data = [_packed(table[:, p : p + _PIECE].reshape(-1)) for p in pieces]
            yield {"k": [k] * len(pieces), "piece": pieces, "data": data}

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(2 * _PIECE, np.int64)
        for packed in parts["data"]:
            _add_packed(total, packed)
        data = _packed(scaled(total.reshape(2, -1)).reshape(-1), np.uint16)
        return pd.DataFrame({"k": parts["k"][:1], "piece": parts["piece"][:1], "data": [data]})

    schema = "k int, piece int, data binary"
    filled = map_rows(counts.coalesce(max(6, keys // FILL_KEYS)), ["key", "n"], run, schema)
    summed = cut(filled.groupBy("k", "piece").applyInPandas(add, schema))
    tables = [np.zeros((2, 1 << bits), np.uint16) for *_, bits in PREDICTORS]
    for k, table in enumerate(tables):
        for row in summed.where(F.col("k") == k).collect():  # the table's size
            piece = np.zeros(2 * _PIECE, np.uint16)
            _add_packed(piece, row.data, np.uint16)
            table[:, row.piece : row.piece + _PIECE] = piece.reshape(2, -1)
    return tables


def scaled(table: np.ndarray) -> np.ndarray:
    """Counts in 16 bits: both counts of a slot are halved until they fit."""
    bits = np.frexp(table.max(0).astype(float))[1]
    return (table >> np.maximum(bits - 16, 0)).astype(np.uint16)


def _fit_gates(counts: DataFrame, shared: Broadcast, steps: int) -> np.ndarray:
    """Weights by gate after Newton steps over the keys in `counts`."""
    weights = np.full((GATES, K), 0.3)
    for _ in range(steps):
        now = weights.copy()

        def run(batches: Iterator[dict], now: np.ndarray = now) -> Iterator[dict]:
            sums = np.zeros((GATES, K + K * K))
            for b in batches:
                for start in range(0, len(b["key"]), CHUNK):
                    d, gate, x = shared.value.learning_inputs(b["key"][start : start + CHUNK])
                    times = np.repeat(np.array(b["n"][start : start + CHUNK], float), d.counts)
                    order = np.argsort(gate.astype(np.uint8), kind="stable")
                    x, gate, times = x[order].astype(float), gate[order], times[order]
                    p = 1 / (1 + np.exp(-np.clip(np.einsum("ij,ij->i", x, now[gate]), -30, 30)))
                    cuts = np.flatnonzero(np.diff(gate, prepend=-1, append=-1))
                    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                        part, w, q = x[low:high], times[low:high], p[low:high]
                        sums[gate[low], :K] += (w * (1 - q)) @ part
                        sums[gate[low], K:] += ((part * (w * q * (1 - q))[:, None]).T @ part).reshape(-1)
            gate, column = np.nonzero(sums)
            yield {"gate": gate.tolist(), "column": column.tolist(), "value": sums[gate, column].tolist()}

        found = map_rows(counts, ["key", "n"], run, "gate int, column int, value double")
        sums = np.zeros((GATES, K + K * K))
        for row in found.groupBy("gate", "column").agg(F.sum("value").alias("value")).collect():
            sums[row.gate, row.column] = row.value
        for gate in range(GATES):
            slope, curve = sums[gate, :K], sums[gate, K:].reshape(K, K)
            change = np.linalg.solve(curve + (1.0 + 1e-3 * np.trace(curve)) * np.eye(K), slope)
            weights[gate] += np.clip(change, -1, 1)
    return weights


def fit(counts: DataFrame, steps: int = 3) -> Model:
    """A model from counted keys (key, n)."""
    code = Code(_byte_counts(counts))
    keys = counts.count()
    model = Model(code, _tables(counts, code, keys), np.full((GATES, K), 0.3))
    model.shared = counts.sparkSession.sparkContext.broadcast(model)
    model.weights = _fit_gates(counts, model.shared, steps)
    return model


def _most_common(counts: DataFrame, most: int) -> pa.Table:
    """At most `most` tokens with their counts: all above a limit, found by eighths of powers of two."""
    level = F.floor(F.log2("c") * 8).cast("int")
    levels = {r.level: r.n for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()}
    total, least = 0, 1 << 20
    for at in sorted(levels, reverse=True):  # a few hundred levels
        total += levels[at]
        if total > most:
            break
        least = at
    return counts.where(level >= least).select("token", "c").toArrow()


def score(docs: DataFrame, model: Model, counts: DataFrame, common: int = COMMON) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row."""
    kind = dict(docs.dtypes)["doc_id"]
    token = F.expr("substring(key, 2)")
    counts = cut(counts.groupBy(token.alias("token")).agg(F.sum("n").alias("c")))
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    space = math.log10(totals.n + 0.5 * (totals.v + 1))
    most_common = _most_common(counts, common)
    names = ("row", "doc_id", "n_tokens", "n_known", "base", "bits", "n_bytes", "token", "n")

    shared, weights = model.shared, model.weights

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        row = TaskContext.get().partitionId() << 40
        model = shared.value
        model.weights = weights
        known = dict(zip(*(c.to_pylist() for c in most_common.columns), strict=True))
        for ids, keys, texts in _portions(batches):
            first, rows, ways = model.inputs(keys)
            seen = np.array([known.get(k[1:], -1) for k in keys], float)
            base = np.where(seen >= 0, np.log10(np.maximum(seen, 0) + 0.5), 0.0)
            sizes = np.array([len(k) - (k[1:] == END) for k in keys])
            out: dict[str, list] = {name: [] for name in names}
            for doc_id, text in zip(ids, texts, strict=True):
                found = seen[text] >= 0
                bits = document_bits(text, first, rows, ways)
                values = (row, doc_id, len(text), int(found.sum()), float(base[text].sum()), bits, int(sizes[text].sum()), None, None)
                for name, value in zip(names, values, strict=True):
                    out[name].append(value)
                rest, times = np.unique(text[~found], return_counts=True)
                none = [None] * len(rest)
                for name in names[1:-2]:
                    out[name] += none
                out["row"] += [row] * len(rest)
                out["token"] += [keys[i][1:] for i in rest.tolist()]
                out["n"] += times.tolist()
                row += 1
            yield out

    schema = f"row long, doc_id {kind}, n_tokens long, n_known long, base double, bits double, n_bytes long, token binary, n long"
    passed = cut(map_rows(docs, ["doc_id", "text"], run, schema))
    rest = passed.where("token IS NOT NULL").select("row", "token", "n").join(counts, "token", "left")
    rest = rest.groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rest_base"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("rest_known"),
    )
    rows = passed.where("n_tokens IS NOT NULL").drop("token", "n").join(rest, "row", "left")
    return rows.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(totals.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest_base", F.lit(0.0)) - F.col("n_tokens") * space).alias("base_score"),
        (-F.col("bits") * math.log10(2)).alias("score"),
        (F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"),
    )


def learn_and_score(docs: DataFrame, held_out: Column, steps: int = 3) -> DataFrame:
    """Scores of all rows by a model of the rows that are not held out."""
    counts = count_keys(docs.where(~held_out))
    model = fit(counts, steps)
    scored = score(docs, model, counts)
    model.shared.destroy()  # the texts have been scored and written; only their rest is joined later
    return scored
