"""Substring dedup by line hashing: units that recur are kept once, at their earliest ranked place.

Texts are cut into units at line feeds (or at blank lines, for paragraphs). A unit is normalised (lower
case; every ASCII character that is no letter or digit separates words; words one blank apart) and units
with the same digest are one group, whether in one document or in many. Of a group the occurrence with the
lowest (doc_id, start) stays, all others are removed. Offsets are in characters of the original text; a
removed unit takes its separator along: the one after it, or for the last units of a text the one before them.

Every unit with a letter or digit counts, however short; with `min_words` above 1 units of fewer words stay. Null
texts stay null and have no units. Rows that share an id rank equally and share their places: equal rows are kept
or lose the same units. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaline.llm.common import map_rows

SEPARATORS = {"line": re.compile("\n"), "paragraph": re.compile("\n[ \t\r]*\n\\s*")}
_SEPARATE = bytes.maketrans(
    bytes(b for b in range(128) if not chr(b).isalnum()), b" " * sum(not chr(b).isalnum() for b in range(128))
)


def normalised(unit: str) -> list[bytes]:
    return unit.lower().encode("utf-8", "surrogatepass").translate(_SEPARATE).split()


def cut_units(text: str, separator: re.Pattern) -> Iterator[tuple[int, int]]:
    """Start and end of each unit, separators left out."""
    start = 0
    for found in separator.finditer(text):
        yield start, found.start()
        start = found.end()
    yield start, len(text)


def units(docs: DataFrame, unit: str = "line", min_words: int = 1) -> DataFrame:
    """doc_id, start, digest of every unit of `min_words` words or more."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        separator = SEPARATORS[unit]
        for b in batches:
            out: dict[str, list] = {"doc_id": [], "start": [], "digest": []}
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                for start, end in cut_units(text or "", separator):
                    words = normalised(text[start:end]) if end > start else []
                    if len(words) >= min_words:
                        out["doc_id"].append(doc_id)
                        out["start"].append(start)
                        out["digest"].append(hashlib.md5(b" ".join(words)).digest())
            yield out

    return map_rows(docs, ["doc_id", "text"], run, f"doc_id {kind}, start long, digest binary")


def duplicates(found: DataFrame) -> DataFrame:
    """doc_id, starts: where a document's units are that are not the earliest of their group."""
    first = (
        found.groupBy("digest")
        .agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
    )
    again = found.join(first, "digest").where(~F.struct("doc_id", "start").eqNullSafe(F.col("first")))
    return again.groupBy("doc_id").agg(F.sort_array(F.collect_set("start")).alias("starts"))


def removed_spans(text: str, starts: list[int], separator: re.Pattern) -> list[tuple[int, int]]:
    """Maximal removed runs for units that begin at `starts`, separators included."""
    gone, spans, last = set(starts), [], 0
    places = list(cut_units(text, separator))
    for i, (start, end) in enumerate(places):
        if start not in gone or start == end:
            last = end
            continue
        after = places[i + 1][0] if i + 1 < len(places) else end
        begin = start if i + 1 < len(places) else last
        if spans and begin <= spans[-1][1]:
            spans[-1] = (min(begin, spans[-1][0]), after)
        else:
            spans.append((begin, after))
    return spans


def drop_repeated_units(docs: DataFrame, unit: str = "line", min_words: int = 1) -> DataFrame:
    """doc_id, text without repeated units, spans (start, end in the original text), starts of the removed
    units, n_units_removed."""
    kind = dict(docs.dtypes)["doc_id"]
    docs = docs.select("doc_id", "text")
    again = duplicates(units(docs, unit, min_words)).withColumnRenamed("doc_id", "again_id")
    rows = docs.join(again, docs["doc_id"].eqNullSafe(again["again_id"]), "left").drop("again_id")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        separator = SEPARATORS[unit]
        for b in batches:
            out: dict[str, list] = {"doc_id": b["doc_id"], "text": [], "spans": [], "starts": [], "n_units_removed": []}
            for text, starts in zip(b["text"], b["starts"], strict=True):
                spans = removed_spans(text, starts, separator) if starts and text else []
                at, kept = 0, []
                for start, end in spans:
                    kept.append(text[at:start])
                    at = end
                out["text"].append("".join([*kept, text[at:]]) if spans else text)
                out["spans"].append([{"start": s, "end": e} for s, e in spans])
                out["starts"].append(starts or [])
                out["n_units_removed"].append(len(starts or []))
            yield out

    schema = f"doc_id {kind}, text string, spans array<struct<start: long, end: long>>, starts array<long>"
    schema += ", n_units_removed long"
    return map_rows(rows, ["doc_id", "text", "starts"], run, schema)


#: What op9_line_hashes returns, in SQL.
SQL = r"""
WITH raws AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS raw
  FROM documents),
lines AS (
  SELECT *, coalesce(sum(len(raw) + 1) OVER (PARTITION BY doc_id ORDER BY line_no
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
         count(*) OVER (PARTITION BY doc_id) AS n_lines,
         trim(regexp_replace(lower(raw), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')) AS norm
  FROM raws),
units AS (SELECT * FROM lines WHERE norm <> ''),
ranked AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id, start) AS rank FROM units),
marked AS (
  SELECT lines.*, ranked.rank IS NOT NULL AS gone
  FROM lines LEFT JOIN (SELECT * FROM ranked WHERE rank > 1) ranked USING (doc_id, line_no)),
done AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_units_removed,
         coalesce(string_agg(raw, chr(10) ORDER BY line_no) FILTER (NOT gone), '') AS text_left,
         string_agg(start, ',' ORDER BY line_no) FILTER (gone) AS starts
  FROM marked GROUP BY doc_id)
SELECT doc_id, coalesce(n_units_removed, 0) AS n_units_removed, coalesce(starts, '') AS starts,
       md5(text_left) AS text_md5, len(text)::BIGINT - len(text_left) AS n_removed
FROM documents LEFT JOIN done USING (doc_id)
"""
