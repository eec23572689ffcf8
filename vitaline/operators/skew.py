"""Joins, numbering and copies that stay spread out when one key holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vitaline.config import KEY
from vitaline.session import cut

SALTS = 8
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 << 20
GROUP_ROWS = 1 << 20  # rows of a group that one task puts in order
GROUP_BUCKETS = 1 << 16  # by which larger groups are looked for; every task sends at most so many sums
COPY_CHUNK = 4096


def join_on_key(facts: DataFrame, dim: DataFrame, on: Sequence[str] = KEY, how: str = "inner") -> DataFrame:
    """Equi-join many fact rows per key to one dimension row per key.

    A plain join: filters are pushed through it, the planner sees the true size of the narrow side and
    broadcasts it only below the byte threshold, and where a key holds so many rows that its shuffle
    partition is skewed, adaptive execution (see `session.SETTINGS`) splits that partition by its input
    blocks, into as many tasks as the key needs, and repeats only its own dimension rows.
    """
    return facts.join(dim, list(on), how)


def _row_bytes(df: DataFrame) -> Column:
    """Bytes of a row: 16 a column, and what strings, binaries, arrays, maps and structs hold besides."""
    size = F.lit(16 * len(df.columns)).cast("long")
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        kind = field.dataType.typeName()
        if kind in ("array", "map", "struct"):
            column = F.to_json(F.struct(column))
        elif kind not in ("string", "varchar", "char", "binary"):
            continue
        size = size + F.coalesce(F.octet_length(column), F.lit(0))
    return size


def fits_broadcast(dim: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True when `dim` has at most `max_rows` rows, and at most `max_bytes` bytes in them.

    Reads no more than one row beyond the limit.
    """
    some = dim.limit(max_rows + 1).select(_row_bytes(dim).alias("_bytes"))
    rows, size = some.agg(F.count("*"), F.sum("_bytes")).first()
    return rows <= max_rows and (size or 0) <= max_bytes


def lookup(
    facts: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    max_rows: int = BROADCAST_ROWS,
    small: bool | None = None,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Left join to a code table; null matches null.

    Broadcast when small by counted rows and bytes (`fits_broadcast`), salted beyond that. `small` passes on
    what was found before.
    """
    if small is None:
        small = fits_broadcast(dim, max_rows, max_bytes)
    names = [c for c in dim.columns if c not in on]
    keyed = dim.select(*[F.col(c).alias(f"_k_{c}") for c in on], *names)
    if small:
        left, right = facts, F.broadcast(keyed)
        match = F.lit(True)
    else:
        left = facts.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
        right = keyed.withColumn("_k_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        match = F.col("_salt") == F.col("_k_salt")
    for c in on:
        match = match & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return left.join(right, match, "left").select(*facts.columns, *names)


def collapse_copies(df: DataFrame, count: str = "n_copies") -> DataFrame:
    """One row per distinct row with its number of copies; copies are added up before the shuffle."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(count))


def expand_copies(
    df: DataFrame,
    count: str = "n_copies",
    index: str = "copy",
    chunk: int = COPY_CHUNK,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Undo `collapse_copies`: each row `count` times, numbered from 1 in `index`.

    A row with many copies is first cut into chunks that are shuffled apart, so no task writes more
    than `chunk` rows for one of them. `counts` is a written table with the same or larger counts, given
    where `df` is dear to compute: without a large count in it `df` is read once, otherwise written.
    """

    def each(rows: DataFrame) -> DataFrame:
        return rows.withColumn(index, F.explode(F.sequence(F.lit(1).cast("long"), F.col(count))))

    if counts is not None:
        if counts.filter(F.col(count) > chunk).isEmpty():
            return each(df).drop(count)
        df = cut(df)
    some = each(df.filter(F.col(count) <= chunk))
    starts = F.sequence(F.lit(1).cast("long"), F.col(count), F.lit(chunk).cast("long"))
    last = F.least(F.col("_start") + F.lit(chunk - 1), F.col(count))
    many = (
        df.filter(F.col(count) > chunk)
        .withColumn("_start", F.explode(starts))
        .repartition(F.col("_start"), *[F.col(c) for c in df.columns])
        .withColumn(index, F.explode(F.sequence(F.col("_start"), last)))
        .drop("_start")
    )
    return some.unionByName(many).drop(count)


def _large_groups(rows: DataFrame, group: Sequence[str], max_rows: int) -> DataFrame | None:
    """The groups of more than `max_rows` rows, None without one.

    Rows are first counted by a hash of the group, in at most GROUP_BUCKETS sums a task, and groups
    only in the buckets that hold too many.
    """
    bucket = F.pmod(F.xxhash64(*group), F.lit(GROUP_BUCKETS))
    full = rows.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("_rows")).where(F.col("_rows") > max_rows)
    full = cut(full.select("_bucket"))
    if full.isEmpty():
        return None
    among = rows.select(*group, bucket.alias("_bucket")).join(F.broadcast(full), "_bucket")  # GROUP_BUCKETS numbers at most
    large = cut(among.groupBy(*group).agg(F.count("*").alias("_rows")).where(F.col("_rows") > max_rows).select(*group))
    return None if large.isEmpty() else large


def _weight_before(rows: DataFrame, group: Sequence[str], ties: Sequence[str], weight: str, max_rows: int) -> DataFrame:
    """Adds `_before`, the weight before each row of its group: one window a group, blocks for a large one."""
    inside = W.partitionBy(*group).orderBy(*ties).rowsBetween(W.unboundedPreceding, W.currentRow)

    def windowed(some: DataFrame) -> DataFrame:
        return some.withColumn("_before", F.sum(weight).over(inside) - F.col(weight))

    large = _large_groups(rows, group, max_rows)
    if large is None:
        return windowed(rows)
    blocked = running_total(rows.join(large, list(group), "left_semi"), ties, F.col(weight), group, out="_running")
    blocked = blocked.withColumn("_before", F.col("_running") - F.col(weight)).drop("_running")
    return windowed(rows.join(large, list(group), "left_anti")).unionByName(blocked)


def number_rows(
    rows: DataFrame,
    keys: Sequence[str],
    groups: Sequence[Column],
    ties: Sequence[str],
    weight: str,
    gap: str | None = None,
    max_group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Adds `start`, the running weight before each row of a key, and `total`, the weight of the key.

    `rows` holds distinct rows and is read by its group columns alone (twice) and in full: a written table.
    The order inside a key is `groups`, then `ties`. `groups` are never null
    and have few values per key, such as the days of a life and the code list: only the sums of these
    groups meet in one window per key, the rows themselves in one window per group. A group of more than
    `max_group_rows` rows is put in order by range blocks, each with its own window, plus the totals of
    the blocks before; both ways give the same numbers.
    With `gap`, the first row of a group gets the distance of its first group column to the group before
    (0 when that is the same value, or none), all other rows 0.
    """
    names = [f"_g{i}" for i in range(len(groups))]
    tagged = rows.withColumns(dict(zip(names, groups, strict=True)))
    group = [*keys, *names]
    upto = (W.unboundedPreceding, W.currentRow)

    within = _weight_before(tagged, group, ties, weight, max_group_rows)

    in_key = W.partitionBy(*keys).orderBy(*names)
    starts = (
        tagged.groupBy(*group)
        .agg(F.sum(weight).alias("_w"))
        .select(
            *group,
            (F.sum("_w").over(in_key.rowsBetween(*upto)) - F.col("_w")).alias("_group_before"),
            F.sum("_w").over(in_key.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("total"),
            (F.col(names[0]) - F.lag(names[0]).over(in_key)).alias("_gap"),
        )
    )
    numbered = within.join(starts, group).withColumn("start", F.col("_group_before") + F.col("_before"))
    if gap is not None:
        first = F.when(F.col("_before") == 0, F.col("_gap"))
        numbered = numbered.withColumn(gap, F.coalesce(first, F.lit(0)))
    return numbered.drop("_group_before", "_before", "_gap", *names)


def split_parts(rows: DataFrame, size: int, unit: Column | None = None) -> DataFrame:
    """Numbered rows dealt to parts of `size`: adds `part`, `from_copy` (from 0) and `copies`.

    The copies of a row stand `unit` (default 1) apart from `start` on; each row is repeated once per
    part its copies reach into, so a part never holds more than its share of them.
    """
    unit = F.lit(1) if unit is None else unit
    start, count = F.col("start"), F.col("n_copies")

    def copies_before(place: Column) -> Column:
        return F.ceil((place - start) / unit).cast("long")

    first = F.floor(start / size).cast("long")
    last = F.floor((start + (count - 1) * unit) / size).cast("long")
    low = F.greatest(copies_before(F.col("part") * size), F.lit(0).cast("long"))
    high = F.least(copies_before((F.col("part") + 1) * size), count)
    return (
        rows.withColumn("part", F.explode(F.sequence(first, last)))
        .withColumn("from_copy", low)
        .withColumn("copies", high - F.col("from_copy"))
        .filter(F.col("copies") > 0)
    )


def running_total(
    df: DataFrame,
    order: Sequence[str],
    value: Column | None = None,
    by: Sequence[str] = (),
    out: str = "running",
    small: bool | None = None,
) -> DataFrame:
    """Running sum of `value` (default 1: the row number) in `order`, over all rows or inside each `by` group.

    `df` holds one row per distinct (`by`, `order`); equal rows belong pre-aggregated into `value`.
    A table counted small is summed in one window. A larger one is range-partitioned on (`by`, `order`)
    and written with its block number; the sum is then one window per block plus the total of the
    blocks before it. `small` passes on a count made before.
    """
    value = F.lit(1).cast("long") if value is None else value
    upto = (W.unboundedPreceding, W.currentRow)
    rows = df.withColumn("_value", value)
    if not small:
        rows = cut(rows)
    if small or fits_broadcast(rows):
        over = W.partitionBy(*by).orderBy(*order).rowsBetween(*upto)
        return rows.withColumn(out, F.sum("_value").over(over)).drop("_value")
    # Once written the block is a column: a later re-plan cannot move a row to another block.
    blocks = cut(
        rows.repartitionByRange(_blocks(df), *by, *order).withColumn("_block", F.spark_partition_id())
    )
    inside = W.partitionBy(*by, "_block").orderBy(*order).rowsBetween(*upto)
    sums = blocks.groupBy(*by, "_block").agg(F.sum("_value").alias("_sum"))
    before = W.partitionBy(*by).orderBy("_block").rowsBetween(*upto)
    offsets = sums.withColumn("_offset", F.sum("_sum").over(before) - F.col("_sum")).drop("_sum")
    return (
        blocks.withColumn("_inside", F.sum("_value").over(inside))
        .join(offsets, [*by, "_block"])
        .withColumn(out, F.col("_inside") + F.col("_offset"))
        .drop("_value", "_block", "_inside", "_offset")
    )


def _blocks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
