"""A table with one row for each key, changed batch by batch: Parquet in buckets of keys.

A batch writes the buckets of its own keys anew, under its number, and no others; files of the rest keep their names. A bucket's newest
batch counts. A batch that is run again reads what was there before it and overwrites only what it wrote itself, so running
it twice, or after it broke off, gives the same table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a table; a table keeps the number that it began with.
BUCKETS = 64


def _versions(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    full = f"{schema}, _bucket int, _batch bigint"
    try:
        return spark.read.schema(full).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)


def stored(spark: SparkSession, folder: str, schema: str, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """The table as it is, or as it was before a batch; only some buckets of it, if given. At most one number for each bucket is
    broadcast."""
    rows = _versions(spark, folder, schema)
    if buckets is not None:
        rows = rows.filter(F.col("_bucket").isin(buckets))
    if before is not None:
        rows = rows.filter(F.col("_batch") < before)
    newest = rows.groupBy("_bucket").agg(F.max("_batch").alias("_batch"))
    return rows.join(F.broadcast(newest), ["_bucket", "_batch"], "left_semi").drop("_bucket", "_batch")


def upsert(batch: DataFrame, number: int, folder: str, key: str, order: list[str], buckets: int = BUCKETS) -> None:
    """Put a batch's rows in the place of those with their keys. Of several rows of a key the one that is last by `order` counts, whether it is
    new or was there; without an order, the batch's row (of several, the greatest by all columns). Rows without a key are one row."""
    spark = batch.sparkSession
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in batch.schema.fields)
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    fresh = batch.withColumn("_new", F.lit(1))
    touched = [r[0] for r in batch.select(bucket.alias("b")).distinct().collect()]
    if not touched:
        return
    known = stored(spark, folder, schema, before=number, buckets=touched).withColumn("_new", F.lit(0))
    rest = [c for c in batch.columns if c != key and c not in order]
    last = fresh.unionByName(known).groupBy(key).agg(F.max(F.struct(*order, "_new", *rest)).alias("_last"))
    whole = last.select(*[F.col(c) if c == key else F.col(f"_last.{c}").alias(c) for c in batch.columns]).withColumn("_bucket", bucket).withColumn("_batch", F.lit(number).cast("long"))
    whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket", "_batch").parquet(folder)
