"""Line dedup by a fixed-depth template tree, in DataFrame functions only.

A line's words are parsed down a tree of fixed depth: the number of words, then the first DEPTH words; the
leaf holds the lines that agree so far. Fields are generalised twice. A word with a digit or an at sign is
a variable field anywhere, also on the way down (a line of nothing but such words is taken as it stands).
Inside a leaf, lines are grouped by the words they agree on: a word is constant at its place if at least
`min_docs` texts of the leaf have it there, else it is a field, and lines with the same constants at the same
places share a template, so a leaf holds as many templates as its lines need. Constants, with the words on
the way down, must make up at least `similarity` of the line; any other line is its own template. Thus at
the default a field needs three constants, and lines of up to three words are compared word by word.

A template found in at least `min_docs` different texts is dropped from every document: no line and no
document is too short or too much of a copy for that. Documents of the same text count once, so that copies
of one document alone do not make its lines recur; that is for document-level dedup to see.

Null texts stay null; empty texts and blank lines stay. Ids play no part: rows that share one are cleaned each
by its own text. Extra columns are passed on unchanged, but for n_lines and n_dropped, which are set anew; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaline.llm.common import fresh
from vitaline.session import cut

DEPTH = 3
FIELD = "<*>"
SLOTS = 1 << 23  # bits of the bitmap of leaves, 64 to a row: 131,072 rows at most, whatever the data
_BLANK = r"[\x20\x09-\x0D]+"
_ODD = r"[0-9@\x09-\x0D]|  "  # all other lines are as they should be, but for outer blanks
_FIELDS_ONLY = r"^<\*>(?: <\*>)*$"
_VARIABLE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"  # linear in the line


def masked(line: Column) -> Column:
    """The line's words, one blank apart, with variable fields generalised unless there is nothing else."""
    apart = F.trim(F.regexp_replace(line, _BLANK, " "))
    whole = F.trim(F.regexp_replace(F.regexp_replace(line, _VARIABLE, FIELD), _BLANK, " "))
    whole = F.when(whole.rlike(_FIELDS_ONLY), apart).otherwise(whole)
    return F.when(line.rlike(_ODD), whole).otherwise(F.trim(line))


def _lines(docs: DataFrame) -> DataFrame:
    """text_id, line, n (words), leaf for each masked line that is not blank.

    They are worked out inside the array that is exploded, so that each is computed once, however often it
    is used after that.
    """

    def parsed(line: Column) -> Column:
        n = F.length(line) - F.length(F.replace(line, F.lit(" "))) + 1
        leaf = F.xxhash64(n, F.substring_index(line, " ", DEPTH))
        return F.struct(line.alias("line"), n.alias("n"), leaf.alias("leaf"))

    lines = F.transform(F.transform(F.split("text", "\n"), masked), parsed)
    lines = docs.select("text_id", F.explode(lines).alias("parsed")).select("text_id", "parsed.*")
    return lines.where(F.col("line") != "")


def _in_leaves(lines: DataFrame, leaves: DataFrame) -> DataFrame:
    """The lines of some leaves. A bitmap of fixed size thins them out before they are joined exactly."""
    slot = F.pmod("leaf", F.lit(SLOTS))
    row, bit = F.shiftright(slot, 6), F.pmod(slot, F.lit(64)).cast("int")
    bits = leaves.groupBy(row.alias("row")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    found = lines.withColumn("row", row).join(F.broadcast(bits), "row")
    found = found.where(F.getbit("bits", bit) == 1).drop("row", "bits")
    return found.join(leaves, "leaf")


def _templates(lines: DataFrame, weights: DataFrame, min_docs: int, similarity: float) -> DataFrame:
    """digest, weight, template of the lines that share a template with another one.

    They are looked for in leaves with several kinds of line and `min_docs` of these in all.
    """
    shared = weights.groupBy("leaf").agg(F.count("*").alias("kinds"), F.sum("weight").alias("total"))
    shared = cut(shared.where((F.col("kinds") > 1) & (F.col("total") >= min_docs)).select("leaf"))
    kinds = _in_leaves(lines.where(F.col("n") > DEPTH).select("leaf", "line", "n"), shared).distinct()
    kinds = kinds.withColumn("digest", F.unhex(F.md5("line"))).join(weights.select("digest", "weight"), "digest")
    places = kinds.select("leaf", "digest", "weight", "n", F.posexplode(F.split("line", " ")).alias("pos", "word"))
    places = cut(places.where(F.col("pos") >= DEPTH))  # what the leaves' lines say place by place
    constants = places.where(F.col("word") != FIELD).groupBy("leaf", "pos", "word").agg(F.sum("weight").alias("votes"))
    constants = cut(constants.where(F.col("votes") >= min_docs).select("leaf", "pos", "word", F.lit(True).alias("constant")))
    said = F.when(F.col("constant"), F.struct("pos", "word"))  # fields are null, which collect_list leaves out
    grouped = (
        places.join(constants, ["leaf", "pos", "word"], "left")
        .groupBy("digest", "leaf", "weight", "n")
        .agg(F.array_sort(F.collect_list(said)).alias("said"))
        .where(F.size("said") + DEPTH >= F.col("n") * similarity)
    )
    words = F.array_join(F.transform("said", lambda s: F.concat_ws(" ", s["pos"].cast("string"), s["word"])), " ")
    template = F.unhex(F.md5(F.concat_ws(" ", F.col("leaf").cast("string"), words)))
    return grouped.select("digest", "weight", template.alias("template"))


def recurring(docs: DataFrame, min_docs: int, similarity: float) -> DataFrame:
    """text_id, dropped: digests of the lines of a text whose template recurs."""
    lines = _lines(docs)
    digest = F.unhex(F.md5("line")).alias("digest")
    parsed = cut(lines.select("text_id", digest, "leaf").distinct())
    weights = cut(parsed.groupBy("digest", "leaf").agg(F.count("*").alias("weight")))
    general = cut(_templates(lines, weights, min_docs, similarity))
    # texts are counted where a template's lines are all rare and yet numerous enough together
    totals = general.groupBy("template").agg(F.sum("weight").alias("total"), F.max("weight").alias("most"))
    totals = totals.where(F.col("total") >= min_docs)
    doubtful = general.join(totals.where(F.col("most") < min_docs).select("template"), "template")
    texts = parsed.join(doubtful.select("digest", "template"), "digest").select("template", "text_id").distinct()
    counted = texts.groupBy("template").agg(F.count("*").alias("texts")).where(F.col("texts") >= min_docs)
    often = counted.select("template").union(totals.where(F.col("most") >= min_docs).select("template"))
    gone = weights.where(F.col("weight") >= min_docs).select("digest")
    gone = cut(gone.union(general.join(often, "template").select("digest")).distinct())
    return parsed.join(gone, "digest", "left_semi").groupBy("text_id").agg(F.collect_set("digest").alias("dropped"))


def drop_recurring_lines(docs: DataFrame, min_docs: int = 10, similarity: float = 0.75) -> DataFrame:
    """The rows with recurring lines taken out of `text`, and n_lines, n_dropped."""
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    key, text_id, gone, left = (fresh(docs, name) for name in ("key", "text_id", "gone", "left"))
    digest = F.unhex(F.md5("text"))
    found = recurring(docs.select("text", digest.alias("text_id")), min_docs, similarity).toDF(key, gone)
    rows = docs.select(*[F.col(f"`{c}`") for c in own], digest.alias(text_id))
    rows = rows.join(found, F.col(text_id) == F.col(key), "left")
    lines = F.split("text", "\n")
    stay = F.filter(lines, lambda x: ~F.array_contains(gone, F.unhex(F.md5(masked(x)))))
    rows = rows.withColumn(left, F.when(F.col(gone).isNotNull(), stay))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    n_dropped = F.when(F.col(gone).isNull(), 0).otherwise(n_lines - F.size(left))
    return rows.select(
        *[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in own],
        n_lines.cast("long").alias("n_lines"),
        n_dropped.cast("long").alias("n_dropped"),
    )


_SQL_APART = r"""trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g'))"""
_SQL_MASK = r"""trim(regexp_replace(regexp_replace(raw, '[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*', '<*>', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'))"""

#: The same in SQL, for the defaults.
SQL = rf"""
WITH texts AS (SELECT DISTINCT md5(text) AS text_id, text FROM documents WHERE text IS NOT NULL),
raws AS (
  SELECT text_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS raw
  FROM texts),
every AS (
  SELECT text_id, line_no, raw,
         CASE WHEN regexp_matches({_SQL_MASK}, '^<\*>( <\*>)*$') THEN {_SQL_APART} ELSE {_SQL_MASK} END AS line
  FROM raws),
lines AS (SELECT DISTINCT text_id, line FROM every WHERE line <> ''),
kinds AS (
  SELECT line, count(*) AS weight, string_split(line, ' ') AS words, len(words) AS length,
         concat_ws(' ', length::VARCHAR, words[1], words[2], words[3]) AS leaf
  FROM lines GROUP BY line),
places AS (
  SELECT leaf, line, weight, length, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM kinds WHERE length > 3),
constants AS (
  SELECT leaf, pos, word FROM places WHERE pos > 3 AND word <> '<*>' GROUP BY leaf, pos, word HAVING sum(weight) >= 10),
general AS (
  SELECT leaf, line, coalesce(string_agg(pos || ' ' || word, ' ' ORDER BY pos) FILTER (constants.leaf IS NOT NULL), '') AS said
  FROM places LEFT JOIN constants USING (leaf, pos, word) WHERE pos > 3
  GROUP BY leaf, line, length HAVING count(constants.leaf) + 3 >= length * 0.75),
parsed AS (
  SELECT text_id, line, coalesce('leaf ' || leaf || ' says ' || said, 'line ' || line) AS template
  FROM lines LEFT JOIN general USING (line)),
often AS (SELECT template FROM parsed GROUP BY template HAVING count(DISTINCT text_id) >= 10),
dropped AS (SELECT DISTINCT text_id, line FROM parsed SEMI JOIN often USING (template)),
marked AS (
  SELECT every.*, dropped.line IS NOT NULL AS gone FROM every LEFT JOIN dropped USING (text_id, line)),
cleaned AS (
  SELECT text_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
         coalesce(string_agg(raw, chr(10) ORDER BY line_no) FILTER (NOT gone), '') AS left_over
  FROM marked GROUP BY text_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, md5(left_over) AS text_md5
FROM documents LEFT JOIN cleaned ON md5(text) = text_id
"""
