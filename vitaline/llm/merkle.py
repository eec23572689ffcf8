"""Merkle manifest of a dataset: a tree of digests a source, and proofs by checkpoint and recompute.

A row's leaf is the digest of its doc_id, source, lang, n_chars and text. Inside a source leaves ascend by
doc_id (rows that share an id by their leaf) and every `fan` consecutive nodes become their digest, level by
level, until one is left, the subroot. The subroots, ordered by source, make the root in the same way.

Only every `stride` levels are written. A stored node stands for an aligned subtree of at most fan ** stride
stored descendants of the level below. Proofs are drawn from the root down: each subtree regenerates its
missing interior nodes from its stored descendants, hands every descendant the siblings on its way to the top
of the subtree together with those above it, and forgets the interior nodes.

Places are found without bringing a source together: rows are range-partitioned by source and id, numbered
inside their block, and moved up by the rows of the blocks before. A subtree is the largest group there is.

A null is `-` in a leaf; a null source is a source of its own and comes first, null ids come first inside a
source. Empty texts are values like others. Equal rows are leaves of their own side by side. The proof of the
only leaf of the only source has no steps. Columns besides the five are ignored, whatever their names; an
empty table has no root and gives an empty result. Tampering with a text that is not valid UTF-8 also replaces
its invalid bytes.
"""

from __future__ import annotations

import dataclasses
import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vitaline.llm.common import fold
from vitaline.session import cut

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 16
STRIDE = 2
_DIGITS = 64  # of a digest as hex text
_STEP = "array<struct<place: int, siblings: string>>"


@dataclasses.dataclass(frozen=True)
class Tree:
    """Stored levels from the leaves up: key, pos, n (nodes of the key on this level), digest.

    The last level has one node a key.
    """

    levels: list[DataFrame]
    fan: int
    stride: int

    @property
    def roots(self) -> DataFrame:
        return self.levels[-1].select("key", "digest")


@dataclasses.dataclass(frozen=True)
class Manifest:
    """The trees of all sources, whose leaves have their row's doc_id, and the tree of their subroots."""

    sources: Tree
    top: Tree


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(**changed: Column) -> Column:
    """The digest of a row; `changed` gives other values of its fields."""

    def part(name: str) -> Column:
        text = changed.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return digest(*map(part, FIELDS))


def _key(source: Column) -> Column:
    """Text that is never null and orders as the sources do, null first and then bytewise."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` with pos, from 0 inside each key in `order`, and n, the rows of the key."""
    number = F.monotonically_increasing_id()  # the block in the high bits, the row's number inside it in the low 33
    rows = rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    rows = cut(rows.withColumn("number", number).withColumn("block", F.shiftright("number", 33)))
    starts = rows.groupBy("key", "block").agg(F.min("number").alias("first"), F.count("*").alias("rows"))
    inside = W.partitionBy("key").orderBy("block").rowsBetween(W.unboundedPreceding, W.currentRow)
    starts = starts.withColumns(
        {"before": F.sum("rows").over(inside) - F.col("rows"), "n": F.sum("rows").over(W.partitionBy("key"))}
    )
    placed = rows.join(starts, ["key", "block"]).withColumn("pos", F.col("number") - F.col("first") + F.col("before"))
    return placed.drop("number", "block", "first", "rows", "before")


def _subtrees(level: DataFrame, fan: int, stride: int, *carried: str) -> DataFrame:
    """One row a subtree: key, n, pos (that of the node it becomes), nodes, and runs_k.

    nodes are the stored descendants in order, with `carried` columns; runs_k are the digests of each run of
    level k written one after the other, k = 0 for the stored ones.
    """
    below = fan**stride
    nodes = F.sort_array(F.collect_list(F.struct("pos", "digest", *carried)))
    rows = level.groupBy("key", "n", F.floor(F.col("pos") / below).cast("long").alias("subtree")).agg(nodes.alias("nodes"))
    rows = rows.withColumnRenamed("subtree", "pos").withColumn("_level", F.col("nodes.digest"))
    for k in range(stride):
        last = F.ceil(F.size("_level") / fan).cast("int") - 1
        run = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice("_level", i * fan + 1, fan), ""))
        rows = rows.withColumn(f"runs_{k}", run)
        rows = rows.withColumn("_level", F.transform(f"runs_{k}", lambda r: F.sha2(r, 256)))
    return rows.drop("_level")


def _counts(fan: int, stride: int) -> list[Column]:
    """Nodes of the key on each level of a subtree, the stored one and the one it becomes included."""
    return [F.ceil(F.col("n") / fan**k).cast("long") for k in range(stride + 1)]


def _tree(leaves: DataFrame, fan: int, stride: int) -> Tree:
    """The stored levels above written leaves (key, pos, n, digest); a level is run-length `fan` ** `stride` smaller."""
    levels = [leaves]
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        counts = _counts(fan, stride)
        node = F.element_at("nodes.digest", 1)
        for k in range(stride):
            node = F.when(counts[k] > 1, F.sha2(F.element_at(f"runs_{k}", 1), 256)).otherwise(node)
        up = _subtrees(levels[-1], fan, stride).select("key", "pos", counts[-1].alias("n"), node.alias("digest"))
        levels.append(cut(up))
        most = math.ceil(most / fan**stride)
    return Tree(levels, fan, stride)


def build(docs: DataFrame, fan: int = FAN, stride: int = STRIDE, **carried: Column) -> Manifest:
    """Leaves, stored levels and subroots of `docs`; `carried` columns are kept beside each leaf."""
    rows = docs.select(_key(F.col("source")).alias("key"), "doc_id", leaf().alias("digest"), *[c.alias(n) for n, c in carried.items()])
    sources = _tree(cut(_placed(cut(rows), ["doc_id", "digest"])), fan, stride)
    subroots = sources.roots.select(F.lit("").alias("key"), F.col("key").alias("source_key"), "digest")
    return Manifest(sources, _tree(cut(_placed(subroots, ["source_key"])), fan, stride))


def _paths(tree: Tree, above: DataFrame, *carried: str) -> DataFrame:
    """key, pos, digest, `carried` and path of every leaf of the tree: the steps to its root and then `above`
    (key, pos, above): the steps from there on."""
    fan, stride = tree.fan, tree.stride
    for level in reversed(range(len(tree.levels) - 1)):
        keep = carried if not level else ()
        counts = _counts(fan, stride)
        rows = _subtrees(tree.levels[level], fan, stride, *keep).join(above, ["key", "pos"])

        def steps(local: Column) -> Column:
            out = []
            for k in range(stride):
                place = F.floor(local / fan**k).cast("int")
                run, place = F.element_at(f"runs_{k}", F.floor(place / fan).cast("int") + 1), place % fan
                before = F.substring(run, F.lit(1), place * _DIGITS)
                after = F.substring(run, (place + 1) * _DIGITS + 1, F.lit(fan * _DIGITS))
                step = F.struct(place.alias("place"), F.concat(before, after).alias("siblings"))
                out.append(F.when(counts[k] > 1, F.array(step)).otherwise(F.array().cast(_STEP)))
            return F.concat(*out, F.col("above"))

        drawn = F.transform("nodes", lambda node, i: F.struct(node.alias("node"), steps(i).alias("path")))  # noqa: B023
        rows = rows.select("key", F.inline(drawn)).select("key", "node.*", "path")
        if not level:
            return rows
        above = cut(rows.select("key", "pos", F.col("path").alias("above")))
    return tree.levels[0].join(above, ["key", "pos"]).select("key", "pos", "digest", *carried, F.col("above").alias("path"))


def proofs(manifest: Manifest, *carried: str) -> DataFrame:
    """doc_id, leaf, `carried`, subroot, root and path of every leaf.

    path has a step a level up to the root: the node's place in its run, from 0, and the digests of the others
    in order, written one after the other.
    """
    start = manifest.top.levels[-1].select("key", "pos", F.array().cast(_STEP).alias("above"))
    root = manifest.top.roots.select("key", F.col("digest").alias("root"))
    top = _paths(manifest.top, start, "source_key").join(root, "key")
    top = cut(top.select(F.col("source_key").alias("key"), F.col("digest").alias("subroot"), "root", F.col("path").alias("above")))
    above = top.select("key", F.lit(0).cast("long").alias("pos"), "above")
    found = _paths(manifest.sources, above, "doc_id", *carried)
    return found.join(top.drop("above"), "key").select("doc_id", F.col("digest").alias("leaf"), *carried, "subroot", "root", "path")


def folded(node: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""

    def up(acc: Column, step: Column) -> Column:
        before = step["place"] * _DIGITS
        siblings = step["siblings"]
        return digest(F.substring(siblings, F.lit(1), before), acc, F.substring(siblings, before + 1, F.length(siblings)))

    return F.aggregate(path, node, up)


def audit(docs: DataFrame, parts: int = 5, fan: int = FAN, stride: int = STRIDE) -> DataFrame:
    """Every row's proof, folded from a tampered leaf where `parts` divides the id's crc32: its text's A-Z lower-cased."""
    lowered = F.translate(F.col("text"), string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.when(fold(F.col("doc_id"), parts) == 0, leaf(text=lowered))
    found = proofs(build(docs, fan, stride, tampered=tampered), "tampered")
    siblings = F.array_join(F.col("path.siblings"), "")
    out = found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(siblings, 256).alias("proof_sha256"),
        folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: What op13_checkpoint_merkle returns, in SQL. The digest of a list is that of its texts put together; the CRC
#: takes each byte and then shifts eight times (-1).
SQL = r"""
WITH RECURSIVE
crc(doc_id, value) AS (
  SELECT doc_id, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten([
      list_prepend(ascii(d)::BIGINT, [-1, -1, -1, -1, -1, -1, -1, -1]) FOR d IN string_split(doc_id::VARCHAR, '')])),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
digests AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                                 'abcdefghijklmnopqrstuvwxyz'), '-')) AS lowered
  FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-')
                  || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
                  || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM documents)),
leaves AS (
  SELECT doc_id, source, leaf, CASE WHEN value % 5 = 0 THEN lowered ELSE leaf END AS shown,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY source) AS n
  FROM digests LEFT JOIN crc USING (doc_id)),
tree(source, level, pos, n, digest) AS (
  SELECT source, 0, pos, n, leaf FROM leaves
  UNION ALL
  SELECT source, level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos))
  FROM tree WHERE n > 1 GROUP BY source, level, pos // 16, n),
subroots AS (
  SELECT source, digest AS subroot, level AS height,
         row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
  FROM tree WHERE n = 1),
top(level, pos, n, digest) AS (
  SELECT 0, pos, n, subroot FROM subroots
  UNION ALL
  SELECT level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos))
  FROM top WHERE n > 1 GROUP BY level, pos // 16, n),
runs AS (
  SELECT 1 AS part, source, level, pos // 16 AS run, list(digest ORDER BY pos) AS nodes
  FROM tree WHERE n > 1 GROUP BY source, level, pos // 16
  UNION ALL
  SELECT 2, NULL, level, pos // 16, list(digest ORDER BY pos) FROM top WHERE n > 1 GROUP BY level, pos // 16),
steps AS (
  SELECT l.source, l.pos, r.level AS step, (l.pos // (16 ** r.level)::BIGINT) % 16 AS place, nodes
  FROM leaves l JOIN runs r ON r.part = 1 AND r.source IS NOT DISTINCT FROM l.source
                            AND r.run = l.pos // (16 ** (r.level + 1))::BIGINT
  UNION ALL
  SELECT l.source, l.pos, height + r.level, (s.pos // (16 ** r.level)::BIGINT) % 16, nodes
  FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source
                JOIN runs r ON r.part = 2 AND r.run = s.pos // (16 ** (r.level + 1))::BIGINT),
cut AS (
  SELECT source, pos, step, array_to_string(nodes[:place], '') AS before, array_to_string(nodes[place + 2:], '') AS after
  FROM steps),
climb(source, pos, step, node) AS (
  SELECT source, pos, 0, shown FROM leaves
  UNION ALL
  SELECT c.source, c.pos, c.step + 1, sha256(before || node || after)
  FROM climb c JOIN cut ON cut.source IS NOT DISTINCT FROM c.source AND cut.pos = c.pos AND cut.step = c.step),
ends AS (SELECT source, pos, arg_max(node, step) AS folded_root FROM climb GROUP BY source, pos),
shown AS (
  SELECT source, pos, sha256(string_agg(before || after, '' ORDER BY step)) AS proof_sha256 FROM cut GROUP BY source, pos)
SELECT l.doc_id, l.leaf, s.subroot, t.digest AS root, coalesce(h.proof_sha256, sha256('')) AS proof_sha256, e.folded_root,
       e.folded_root = t.digest AS verified
FROM leaves l
JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source
JOIN (SELECT digest FROM top WHERE n = 1) t ON true
JOIN ends e ON e.source IS NOT DISTINCT FROM l.source AND e.pos = l.pos
LEFT JOIN shown h ON h.source IS NOT DISTINCT FROM l.source AND h.pos = l.pos
"""
