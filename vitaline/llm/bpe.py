"""Byte-level BPE encoding and decoding: merges chosen by a segment tree over byte positions.

Every match of the split pattern is encoded by itself. The tree's leaf of a byte holds the rank of the
pair that starts there (with its position, so that of equal ranks the leftmost wins); a node holds the
smaller of its two children. The root names the next merge; a merge changes at most three leaves (the
pair itself, the pair of the left neighbour, the swallowed symbol), each in logarithmic time, so a piece
of n bytes takes O(n log n) whatever its content. The distinct new pieces of a batch of texts are merged in
step, a tree per row of an array; ids of pieces are remembered, so a frequent word is merged once.

Null and empty texts have no ids and decode to nothing. Rows are encoded one by one: repeated rows, ties
and extra columns make no difference, an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame

from vitaline.llm.common import map_rows

NO_PAIR = 1 << 62
_SHIFT = 32  # a leaf is rank << 32 | position
CACHE_PIECES = 400_000  # pieces remembered by a worker; the memory is emptied when full
CACHE_TEXT = 4_000_000  # characters of the texts whose pieces are looked up together


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1 << (n - 1).bit_length() if n > 1 else 1
    after = list(range(1, n + 1))  # where the symbol that starts at i ends, which is its right neighbour
    before = list(range(-1, n - 1))
    tree = [NO_PAIR] * (2 * size)
    rank = ranks.get
    for i in range(n - 1):
        r = rank(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r << _SHIFT | i
    for node in range(size - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left < right else right

    def put(i: int, value: int) -> None:
        node = size + i
        tree[node] = value
        node >>= 1
        while node:
            left, right = tree[2 * node], tree[2 * node + 1]
            low = left if left < right else right
            if tree[node] == low:
                return
            tree[node] = low
            node >>= 1

    while tree[1] != NO_PAIR:
        at = tree[1] & ((1 << _SHIFT) - 1)
        gone = after[at]
        end = after[at] = after[gone]
        put(gone, NO_PAIR)
        if end < n:
            before[end] = at
            r = rank(piece[at : after[end]])
            put(at, NO_PAIR if r is None else r << _SHIFT | at)
        else:
            put(at, NO_PAIR)
        left = before[at]
        if left >= 0:
            r = rank(piece[left:end])
            put(left, NO_PAIR if r is None else r << _SHIFT | left)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Pairs:
    """Ranks of pairs of token ids, as a sorted array of keys: every way to cut a token into two tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        found = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    found[left << 32 | right] = rank
        self.keys = np.array(sorted(found), np.int64)
        self.ranks = np.array([found[k] for k in self.keys.tolist()], np.int64)

    def leaf(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leaves of the pairs that start at `at`; a negative id stands for no symbol."""
        keys = left.astype(np.int64) << 32 | np.maximum(right, 0)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        found = (self.keys[place] == keys) & (left >= 0) & (right >= 0)
        return np.where(found, self.ranks[place] << _SHIFT | at, NO_PAIR)


def merge_many(pieces: list[bytes], byte_ids: np.ndarray, pairs: Pairs, width: int) -> list[bytes]:
    """Packed ids of pieces of at most `width` bytes, a power of two: one tree per row, all merged in step."""
    rows = len(pieces)
    lengths = np.array([len(p) for p in pieces], np.int64)
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(rows, width)
    live = np.arange(width) < lengths[:, None]
    symbols = np.full((rows, width + 1), -1, np.int64)
    symbols[:, :width][live] = byte_ids[raw[live]]
    after = np.tile(np.arange(1, width + 2), (rows, 1))
    before = np.tile(np.arange(-1, width), (rows, 1))
    tree = np.full((rows, 2 * width), NO_PAIR, np.int64)
    tree[:, width:] = pairs.leaf(symbols[:, :-1], symbols[:, 1:], np.arange(width))
    size = width
    while size > 1:
        tree[:, size // 2 : size] = np.minimum(tree[:, size : 2 * size : 2], tree[:, size + 1 : 2 * size : 2])
        size //= 2

    def put(row: np.ndarray, at: np.ndarray, value: np.ndarray | int) -> None:
        node = at + width
        tree[row, node] = value
        for _ in range(width.bit_length() - 1):
            node = node >> 1
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

    row = np.arange(rows)
    while True:
        root = tree[row, 1]
        more = root != NO_PAIR
        row, root = row[more], root[more]
        if not len(row):
            break
        at = root & ((1 << _SHIFT) - 1)
        symbols[row, at] = root >> _SHIFT  # a token's id is its rank
        gone = after[row, at]
        end = after[row, gone]
        after[row, at] = end
        before[row, end] = at
        live[row, gone] = False
        put(row, gone, NO_PAIR)
        put(row, at, pairs.leaf(symbols[row, at], symbols[row, end], at))
        left = before[row, at]
        has = left >= 0
        put(row[has], left[has], pairs.leaf(symbols[row[has], left[has]], symbols[row[has], at[has]], left[has]))
    ids = symbols[:, :-1][live].astype("<u4").tobytes()
    ends = (np.cumsum(live.sum(1)) * 4).tolist()
    return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


WIDTHS = (8, 16, 32, 64)  # longer pieces are merged one by one


class Codec:
    """Encodes texts to ids (packed as little-endian unsigned 32-bit integers) and back."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pairs = Pairs(self.ranks)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.split = regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}

    def _learn(self, pieces: set[str]) -> None:
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            data = piece.encode("utf-8")
            rank = self.ranks.get(data)
            if rank is not None:
                self.cache[piece] = rank.to_bytes(4, "little")
            elif len(data) > WIDTHS[-1]:
                self.cache[piece] = np.array(merge(data, self.ranks), "<u4").tobytes()
            else:
                by_width.setdefault(next(w for w in WIDTHS if len(data) <= w), []).append((piece, data))
        for width, group in by_width.items():
            for start in range(0, len(group), 1 << 14):
                part = group[start : start + (1 << 14)]
                ids = merge_many([data for _, data in part], self.byte_ids, self.pairs, width)
                self.cache.update(zip([piece for piece, _ in part], ids, strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > CACHE_PIECES:
            self.cache.clear()
        out = []
        for some in _portions(texts):
            split = [self.split(text) for text in some]
            self._learn(set().union(*split) - self.cache.keys())
            out += [b"".join(map(self.cache.__getitem__, pieces)) for pieces in split]
            if any(len(text) > CACHE_TEXT for text in some):  # its pieces may be long
                self.cache = {k: v for k, v in self.cache.items() if len(k) <= WIDTHS[-1]}
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _portions(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts that together exceed CACHE_TEXT by one text at most."""
    some, chars = [], 0
    for text in texts:
        some.append(text)
        chars += len(text)
        if chars > CACHE_TEXT:
            yield some
            some, chars = [], 0
    if some:
        yield some


_CODECS: dict[tuple[str, str], Codec] = {}


def _codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: the packed ids of every text."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        codec = _codec(path, pattern)
        for b in batches:
            yield {id_col: b[id_col], "ids": codec.encode([t or "" for t in b[text_col]])}

    return map_rows(docs, [id_col, text_col], run, f"{id_col} {kind}, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """doc_id, data: the bytes of packed ids; an unknown id raises KeyError."""
    kind = dict(encoded.dtypes)[id_col]

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        codec = _codec(path, pattern)
        for b in batches:
            yield {id_col: b[id_col], "data": [codec.decode(i or b"") for i in b["ids"]]}

    return map_rows(encoded, [id_col, "ids"], run, f"{id_col} {kind}, data binary")


def round_trip(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and the packed ids), in one pass over the texts."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        codec = _codec(path, pattern)
        for b in batches:
            ids = codec.encode([t or "" for t in b[text_col]])
            yield {
                id_col: b[id_col],
                "n_tokens": [len(i) // 4 for i in ids],
                "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids],
                "decoded_sha256": [hashlib.sha256(codec.decode(i)).hexdigest() for i in ids],
                "ids": ids if keep_ids else [],
            }

    schema = f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_rows(docs, [id_col, text_col], run, schema + ", ids binary" * keep_ids)
