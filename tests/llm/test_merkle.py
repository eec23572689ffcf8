from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from vitaline.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, pos int, path string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    values = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes, fan):
    """The root of nodes, and for each the list of (place, others) up to it."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, path in enumerate(paths):
            run = nodes[at[i] // fan * fan : at[i] // fan * fan + fan]
            place = at[i] % fan
            path.append((place, run[:place] + run[place + 1 :]))
            at[i] //= fan
        nodes = [h(*nodes[i : i + fan]) for i in range(0, len(nodes), fan)]
    return nodes[0], paths


def brute(rows, fan):
    by_source = {}
    for row in rows:
        by_source.setdefault(row["source"], []).append(row)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in sources:
        mine = sorted(by_source[source], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"])))
        trees[source] = mine, *climb([leaf_of(r, r["text"]) for r in mine], fan)
    root, tops = climb([trees[s][1] for s in sources], fan)
    out = []
    for source, above in zip(sources, tops, strict=True):
        mine, subroot, paths = trees[source]
        for row, path in zip(mine, paths, strict=True):
            leaf, text, doc_id = leaf_of(row, row["text"]), row["text"], row["doc_id"]
            node = leaf
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 and text is not None:
                node = leaf_of(row, "".join(c.lower() if c.isascii() else c for c in text))
            for place, others in path + above:
                node = h(*others[:place], node, *others[place:])
            shown = h(*(x for _, others in path + above for x in others))
            out.append((doc_id, leaf, subroot, root, shown, node, node == root))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "x", 1, "y") for r in rows], SCHEMA)


def answer(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def row(doc_id, source, text="Some Text", lang="en", n_chars=9):
    return {"doc_id": doc_id, "source": source, "text": text, "lang": lang, "n_chars": n_chars}


@pytest.mark.parametrize(("fan", "stride"), [(16, 2), (3, 1), (2, 3)])
def test_trees_of_every_size(spark, fan, stride):
    """Sources of one row up to several stored levels, nulls everywhere, repeated ids and rows."""
    rows = [row(i * 7 % 1000, "hot", f"Text {i}") for i in range(300)]
    for n in (1, 2, fan, fan + 1, fan**2, fan**2 + 1):
        rows += [row(1000 + n * 100 + i, f"s{n}", None if i % 3 else "É A" * i, None, None) for i in range(min(n, 90))]
    rows += [row(5, None), row(None, None), row(None, None), row(6, None, ""), row(6, None, "Zz"), row(7, ""), row(8, "ÿ")]
    docs = frame(spark, rows).repartition(5)
    assert answer(merkle.audit(docs, fan=fan, stride=stride)) == brute(rows, fan)


def test_one_row_and_none(spark):
    only = [row(5, "a")]
    assert answer(merkle.audit(frame(spark, only))) == brute(only, 16)
    assert merkle.audit(frame(spark, only).limit(0)).count() == 0


def test_only_every_second_level_is_stored(spark):
    rows = [row(i, "a") for i in range(300)]
    manifest = merkle.build(frame(spark, rows))
    assert [level.count() for level in manifest.sources.levels] == [300, 2, 1]
    path = merkle.proofs(manifest).where("doc_id = 17").first().path
    assert [(s.place, len(s.siblings)) for s in path] == [(1, 15 * 64), (1, 15 * 64), (0, 64)]


def test_any_change_is_noticed(spark):
    rows = [row(i, "ab"[i % 2], "long " * 50_000 if i == 3 else "T") for i in range(40)]
    found = merkle.proofs(merkle.build(frame(spark, rows)))
    wrong = F.sha2(F.concat("leaf", F.lit("x")), 256)
    out = found.select(
        (merkle.folded(F.col("leaf"), F.col("path")) == F.col("root")).alias("good"),
        (merkle.folded(wrong, F.col("path")) == F.col("root")).alias("bad"),
    )
    assert {tuple(r) for r in out.collect()} == {(True, False)}
