"""Latest-record views. Every order ends in a unique key, so results are the same at every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut_lineage


def latest(rows: DataFrame, by: str | list[str], *order: Column) -> DataFrame:
    """The first row of each group in the given order; Spark keeps one row per group before the shuffle."""
    window = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


def last_n(rows: DataFrame, by: str | list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each group, with their place from 1."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("place") <= n)


def latest_by_id(rows: DataFrame, by: str, key: str = "id") -> DataFrame:
    """The row with the greatest key of each group, by a hash aggregate that moves one row per group and task."""
    others = [c for c in rows.columns if c not in (by, key)]
    best = rows.groupBy(by).agg(F.max(F.struct(key, *others)).alias("_best")) if _orderable(rows, others) else None
    if best is None:
        return latest(rows, by, F.col(key).desc())
    return best.select(by, *[F.col(f"_best.{c}").alias(c) for c in (key, *others)])


def _orderable(rows: DataFrame, columns: list[str]) -> bool:
    return not any("map<" in dict(rows.dtypes)[c] or "variant" in dict(rows.dtypes)[c] for c in columns)


def as_of(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, value: str, key: str) -> DataFrame:
    """left with the value of right's latest row at or before left_time in each group (by, times and key of right in order); null where there
    is none, as for rows of left without a group or a time. Rows of right without either are left out.

    Both sides are put in one order and dealt by ranges of it; within a range of a group the last value is carried on, and a range
    begins with the last value of those before it. So no pair of rows is made, and a group of all rows lies in many tasks."""
    sides = left.select(F.col(by), F.col(left_time).alias("_time"), F.lit(1).alias("_side"), F.lit(None).alias("_key"), F.struct(*left.columns).alias("_row"), F.lit(None).alias("_value"))
    other = right.select(F.col(by), F.col(right_time).alias("_time"), F.lit(0).alias("_side"), F.col(key).alias("_key"), F.lit(None).alias("_row"), F.struct(F.col(value).alias("v")).alias("_value"))
    both = sides.unionByName(other.filter(F.col(by).isNotNull() & F.col("_time").isNotNull()))
    order, parts = ["_time", "_side", "_key"], int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut_lineage(both.repartitionByRange(parts, by, *order).withColumn("_range", F.spark_partition_id()))
    ends = dealt.groupBy(by, "_range").agg(F.max_by("_value", F.when(F.col("_side") == 0, F.struct(*order))).alias("_end"))
    earlier = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(F.col(by).alias("_by"), F.col("_range").alias("_from"), F.last("_end", ignorenulls=True).over(earlier).alias("_before"))
    within = Window.partitionBy(by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = dealt.withColumn("_last", F.last("_value", ignorenulls=True).over(within)).filter("_side = 1")
    placed = carried.join(before, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_from")))
    return placed.select("_row.*", F.coalesce("_last", "_before")["v"].alias(value))


def last_of(items: Column, key: str = "id") -> Column:
    """The element of a stored list of structs with the greatest key, whatever the list's order; null for an empty list."""
    return F.array_max(F.transform(items, lambda x: F.struct(x[key].alias("k"), x.alias("x"))))["x"]


def first_of(items: Column, key: str = "id") -> Column:
    """The element of a stored list of structs with the least key."""
    return F.array_min(F.transform(items, lambda x: F.struct(x[key].alias("k"), x.alias("x"))))["x"]
