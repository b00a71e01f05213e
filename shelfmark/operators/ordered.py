"""Order-dependent operators that never put one whole key into one task.

A plain window puts every row of its key into one task. Here the numeric order column is cut
into fixed ranges first: a window runs per (key, range), and a second, small window runs over
one summary row per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.session import materialise

# Rows with dense numbering that one task sorts at most per key.
RANGE_WIDTH = 1 << 18


def _ranges(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn("_range", F.floor(F.col(order) / F.lit(width)))


def previous_row(df: DataFrame, keys: list[str], order: str, cols: list[str],
                 name: str = "previous", width: int = RANGE_WIDTH) -> DataFrame:
    """Add struct `name`: `cols` of the row before this one within its key, null for the first.

    `order` is a non-null whole number, unique within a key.
    """
    ranged = _ranges(df, order, width)
    per_range = Window.partitionBy(*keys, "_range").orderBy(order)
    inside = ranged.withColumn("_inside", F.lag(F.struct(*cols)).over(per_range))
    tails = ranged.groupBy(*keys, "_range").agg(
        F.max_by(F.struct(*cols), F.col(order)).alias("_tail"))
    carry = tails.select(
        *keys, "_range",
        F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_range")).alias("_carry"))
    return (
        inside.join(carry, [*keys, "_range"], "left")
        .withColumn(name, F.coalesce("_inside", "_carry"))
        .drop("_inside", "_carry", "_range")
    )


def running_sum(df: DataFrame, keys: list[str], order: str, value: Column, name: str,
                width: int = RANGE_WIDTH) -> DataFrame:
    """Add BIGINT `name`: sum of `value` from the first row of the key up to this one."""
    ranged = _ranges(df.withColumn("_value", value), order, width)
    inside = ranged.withColumn("_inside", F.sum("_value").over(
        Window.partitionBy(*keys, "_range").orderBy(order)
        .rowsBetween(Window.unboundedPreceding, 0)))
    sums = ranged.groupBy(*keys, "_range").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *keys, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    return (
        inside.join(offsets, [*keys, "_range"], "left")
        .withColumn(name, (F.col("_inside") + F.col("_before")).cast("bigint"))
        .drop("_inside", "_before", "_range", "_value")
    )


def number_rows(df: DataFrame, keys: list[str], order: str, name: str = "row_no",
                width: int = RANGE_WIDTH, where: Column | None = None) -> DataFrame:
    """Add BIGINT `name`: 1-based position of the row within its key by `order`.

    With `where`, counts only rows that satisfy it, so a row carries the running count.
    """
    one = F.when(where, 1).otherwise(0) if where is not None else F.lit(1)
    return running_sum(df, keys, order, one, name, width)


def running_max(df: DataFrame, keys: list[str], order: str, value: str, name: str,
                width: int = RANGE_WIDTH) -> DataFrame:
    """Add `name`: maximum of `value` over the rows strictly before this one within its key."""
    ranged = _ranges(df, order, width)
    strictly_before = (Window.unboundedPreceding, -1)
    inside = ranged.withColumn("_inside", F.max(value).over(
        Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(*strictly_before)))
    tops = ranged.groupBy(*keys, "_range").agg(F.max(value).alias("_top"))
    carry = tops.select(*keys, "_range", F.max("_top").over(
        Window.partitionBy(*keys).orderBy("_range").rowsBetween(*strictly_before)).alias("_carry"))
    return (
        inside.join(carry, [*keys, "_range"], "left")
        .withColumn(name, F.greatest("_inside", "_carry"))
        .drop("_inside", "_carry", "_range")
    )


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of every key as an aggregate, so copies collapse before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def number_sorted(df: DataFrame, keys: list[str], order: list[Column], name: str = "row_no"
                  ) -> DataFrame:
    """Add BIGINT `name`: 1-based position of the row within its key by any order.

    Rows are dealt by range and written once; each range is numbered for itself and one count
    per range and key carries the numbers on, so no key is one task.
    """
    places = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    sort = [f"_o{i}" for i in range(len(order))]
    dealt = materialise(
        df.select("*", *places).repartitionByRange(*keys, *sort)
        .withColumn("_part", F.spark_partition_id()), "sorted-ranges")
    inside = dealt.withColumn("_inside", F.row_number().over(
        Window.partitionBy("_part", *keys).orderBy(*sort)))
    counts = dealt.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = counts.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0))
                          .alias("_before"))
    return inside.join(carry, [*keys, "_part"]).withColumn(
        name, F.col("_inside") + F.col("_before")).select(*df.columns, name)
