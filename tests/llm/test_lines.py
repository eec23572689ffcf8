from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from vitaline.llm import line_templates, units

KINDS = "doc_id long, text string, dropped string, line int"


def clean(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], KINDS)
    out = line_templates.drop_recurring_lines(docs, **options).collect()
    assert all((r.dropped, r.line) == ("x", 1) for r in out)
    return sorted(((r.doc_id or 0, r.text, r.n_lines, r.n_dropped) for r in out), key=str)


def test_templates_generalise_fields(spark):
    body = ["", *(" ".join(letter * k for k in range(1, 20)) for letter in "abcde")]

    def rows(names):
        return [(i, f"{body[i]}\nposted in march by {n} on page {i}") for i, n in enumerate(names, 1)]

    # the page is a field anywhere; the name is constant where enough texts have the same
    same = rows(["ann", "bob", "cat", "ann", "ann"])
    assert [n for *_, n in clean(spark, same, min_docs=4)] == [1] * 5
    assert [n for *_, n in clean(spark, same, min_docs=3)] == [1, 0, 0, 1, 1]
    out = clean(spark, rows("vwxyz"), min_docs=5)
    assert [(t, n) for _, t, _, n in out] == [(t, 1) for t in body[1:]]
    assert [n for *_, n in clean(spark, rows("vwxyz"), min_docs=6)] == [0] * 5


def brute_templates(rows, min_docs, similarity=0.75):
    """(text, lines, dropped lines) by text, one line at a time."""

    def parse(line):
        words = re.findall(r"[^\x20\x09-\x0D]+", line)
        fields = ["<*>" if re.search("[0-9@]", w) else w for w in words]
        return tuple(fields if set(fields) != {"<*>"} else words)

    texts = {t for _, t in rows if t is not None}
    holders = {}  # line -> texts
    for t in texts:
        for words in filter(None, map(parse, t.split("\n"))):
            holders.setdefault(words, set()).add(t)
    votes = Counter()
    for words, held in holders.items():
        votes.update({(len(words), words[:3], i, w): len(held) for i, w in enumerate(words) if i > 2 and w != "<*>"})
    template = {}
    for words in holders:
        said = tuple((i, w) for i, w in enumerate(words) if i > 2 and votes[len(words), words[:3], i, w] >= min_docs)
        shares = len(words) > 3 and len(said) + 3 >= len(words) * similarity
        template[words] = (len(words), words[:3], said) if shares else words
    found = {}
    for words, held in holders.items():
        found.setdefault(template[words], set()).update(held)
    out = {None: (None, 0, 0)}
    for t in texts:
        lines = t.split("\n")
        kept = [x for x in lines if not parse(x) or len(found[template[parse(x)]]) < min_docs]
        out[t] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def test_templates_equal_brute_force(spark):
    deal = random.Random(5)
    endings = ["by {} on a page", "to {} at the gate", "of {} in our shop"]  # three templates of one leaf
    rows = []
    for i in range(60):
        name = deal.choice([chr(97 + i // 26) * 3 + chr(97 + i % 26), "ann", "bob"])
        lines = [f"seen and read {endings[i % 3].format(name)}", " ".join(deal.choices("pqr", k=deal.randint(1, 5)))]
        lines += [deal.choice(["", "  ", "7", f"{i}", "ok", f"page {i}", "\tpage  7 ", f"{i} of 9", f"thanks for reading {name}"]) for _ in range(4)]
        rows.append((i, "\n".join(deal.sample(lines, len(lines)))))
    rows += [(i, rows[0][1]) for i in range(60, 90)] + [(90, None), (90, ""), (None, "ok"), (91, "ok"), (91, "7\nok")]
    for min_docs in (3, 12):
        expected = brute_templates(rows, min_docs)
        assert clean(spark, rows, min_docs=min_docs) == sorted(((i or 0, *expected[t]) for i, t in rows), key=str)
    out = clean(spark, [(i, f"seen and read {endings[i % 3].format(chr(97 + i % 26) * (2 + i // 26))}") for i in range(60)])
    assert [r[1:] for r in out] == [("", 1, 1)] * 60


def test_copies_count_once_and_odd_rows(spark):
    copy = "one line of a copied text\nand another line of it"
    rows = [(i, copy) for i in range(1, 7)] + [(None, None), (7, None), (8, ""), (9, "\n\n"), (9, "\n\n")]
    out = clean(spark, rows, min_docs=2)
    assert [r[1] for r in out if 0 < r[0] < 7] == [copy] * 6
    assert [r[1:] for r in out if r[0] > 6 or r[0] == 0] == [(None, 0, 0), (None, 0, 0), ("", 1, 0), ("\n\n", 3, 0), ("\n\n", 3, 0)]
    # a line that the copies share with another text goes from all of them
    out = clean(spark, [*rows, (6, "and another line of it\nx")], min_docs=2)
    assert [r[1] for r in out if 0 < r[0] < 7] == ["one line of a copied text"] * 6 + ["x"]
    assert clean(spark, []) == []


def test_very_long_words_take_linear_time(spark):
    text = "a b c " + "x" * 300_000 + "\nfollow us on our page 3 today"
    out = clean(spark, [(i, f"{text}\n{'xyz'[i]}") for i in range(2)], min_docs=2)
    assert [r[1] for r in out] == ["x", "y"]


def brute(rows, min_words):
    """Removed starts per document, one occurrence at a time in rank order."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        at = 0
        for line in (text or "").split("\n"):
            words = tuple(units.normalised(line))
            if len(words) >= min_words:
                if words in seen:
                    out.setdefault(doc_id, []).append(at)
                seen.add(words)
            at += len(line) + 1
    return out


def test_units_equal_brute_force(spark):
    rows = [(1, "a b c\nd e f\na b c"), (2, "x\nA, B; c!\n\ny"), (3, "d e f\nd e f"), (4, None), (5, ""), (6, "é a b\nz"), (7, "É a b")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, starts string, start int")
    out = {r.doc_id: r for r in units.drop_repeated_units(docs, min_words=3).collect()}
    assert {i: r.starts for i, r in out.items() if r.starts} == brute(rows, 3)
    assert {i: r.text for i, r in out.items()} == {1: "a b c\nd e f", 2: "x\n\ny", 3: "", 4: None, 5: "", 6: "é a b\nz", 7: ""}
    for i, text in rows:
        gone = "".join(text[s.start : s.end] for s in out[i].spans) if text else ""
        assert len(out[i].text or "") + len(gone) == len(text or "")
    assert units.drop_repeated_units(docs.limit(0)).count() == 0


def test_short_units_count_too(spark):
    rows = [(1, "x\ny z\n-\n\n7"), (2, "X!\n-\n\n7\nw"), (3, "y z"), (4, "\n\n--"), (5, "a " * 100_000 + "\nA " + " a" * 99_999)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in units.drop_repeated_units(docs).collect()}
    assert {i: r.starts for i, r in out.items() if r.starts} == brute(rows, 1)
    assert {i: r.text for i, r in out.items() if i < 5} == {1: rows[0][1], 2: "-\n\nw", 3: "", 4: "\n\n--"}
    assert out[5].text == rows[4][1].split("\n")[0]


def test_paragraphs_and_repeated_rows(spark):
    rows = [(1, "a b\nc d\n\nx"), (1, "a b\nc d\n\nx"), (2, "y\n \na b c\nd\n\nz"), (None, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r.doc_id or 0, r.text) for r in units.drop_repeated_units(docs, "paragraph", 4).collect())
    assert out == [(0, "q"), (1, "a b\nc d\n\nx"), (1, "a b\nc d\n\nx"), (2, "y\n \nz")]


@pytest.mark.parametrize("gone,left", [([0], "b\nc"), ([2], "a\nc"), ([4], "a\nb"), ([2, 4], "a"), ([0, 2, 4], "")])
def test_separators_go_with_units(gone, left):
    text, at, kept = "a\nb\nc", 0, ""
    for start, end in units.removed_spans(text, gone, units.SEPARATORS["line"]):
        kept, at = kept + text[at:start], end
    assert kept + text[at:] == left
