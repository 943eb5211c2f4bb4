"""Getting shops and evidence in, and rows out."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, urls

MOST_CSV_BYTES = 5 * 1024 * 1024


def read_shop_csv(spark: SparkSession, path: str) -> DataFrame:
    """The URLs of a shop list: of the column that its header names as URL, else of the first column. Blank cells and a byte order
    mark are left out. Only .csv files of at most 5 MiB are taken, so the first line is all that the driver looks at."""
    if not path.lower().endswith(".csv"):
        raise ValueError("a .csv file is needed")
    files = spark.read.format("binaryFile").load(path).select("length")
    if files.filter(F.col("length") > MOST_CSV_BYTES).limit(1).count():
        raise ValueError("the file is larger than 5 MiB")
    # Cells in quotes may go over several lines; files are small, so a task reads one whole.
    read = spark.read.option("multiLine", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
    first = spark.read.text(path).select(F.regexp_replace("value", "^\\ufeff", "")).limit(1).collect()
    cells = next(csv.reader(io.StringIO(first[0][0])), []) if first else []
    names = [c.strip().lower() for c in cells]
    column = next((k for k, n in enumerate(names) if n in fixed.URL_COLUMN_NAMES), None)
    rows = read.schema(", ".join(f"c{k} string" for k in range(max(1, len(cells))))).csv(path)
    out = rows.select(F.regexp_replace(F.coalesce(F.col(f"c{column or 0}"), F.lit("")), r"(?U)^[\s\ufeff]+|\s+$", "").alias("url"))
    if column is not None:
        out = out.filter(~F.lower("url").isin(fixed.URL_COLUMN_NAMES))
    return out.filter("url <> ''")


def import_outcomes(listed: DataFrame, shops: DataFrame) -> DataFrame:
    """listed(url) -> given, rows, url, domain, outcome, reason: one row for each different URL of a shop list and how often it is there. added: a
    shop of a domain that is not known (of several URLs of a domain, the least one); skipped: the shop is known, by URL or by
    domain, or the list has its domain already; error: an internal address. A repetition of an added URL counts as skipped."""
    once = listed.groupBy(F.col("url").alias("given")).agg(F.count("*").alias("rows"))
    named = once.withColumn("url", urls.with_scheme(F.col("given"))).withColumn("domain", urls.domain(F.col("url"))).withColumn("_key", F.lower("domain"))
    public = F.coalesce(urls.public_url(F.col("url"), F.lit(None).cast("array<string>")), F.lit(False))
    by_url = shops.select("url").distinct().withColumn("_url", F.lit(True))
    by_domain = shops.select(F.lower("domain").alias("_key")).distinct().withColumn("_domain", F.lit(True))
    placed = named.withColumn("_public", public).join(by_url, "url", "left").join(by_domain, "_key", "left").withColumn("_known", F.col("_url").isNotNull() | F.col("_domain").isNotNull())
    firsts = placed.filter("_public and not _known").groupBy("_key").agg(F.min(F.struct("url", "given"))["given"].alias("_first"))
    whole = placed.join(firsts, "_key", "left")
    outcome = F.when(~F.col("_public"), "error").when(F.col("_known"), "skipped").when(F.col("given") == F.col("_first"), "added").otherwise("skipped")
    reason = F.when(~F.col("_public"), "internal address").when(F.col("_known"), "known already").when(F.col("given") != F.col("_first"), "domain is in the list already")
    return whole.select("given", "rows", "url", "domain", outcome.alias("outcome"), reason.alias("reason"))


def import_shops(listed: DataFrame, shops: DataFrame, folder: str) -> dict[str, int]:
    """Append the new shops (url, domain) to a folder of Parquet and say how many rows of the list were added, skipped and errors. They are counted
    in the pass that writes."""
    seen = Observation()
    added = F.when(F.col("outcome") == "added", 1).otherwise(0)
    counts = {
        "total_processed": F.sum("rows"), "added": F.sum(added), "skipped": F.sum(F.when(F.col("outcome") != "error", F.col("rows") - added)),
        "errors": F.sum(F.when(F.col("outcome") == "error", F.col("rows"))),
    }
    outcomes = import_outcomes(listed, shops).observe(seen, *[F.coalesce(v, F.lit(0)).cast("long").alias(k) for k, v in counts.items()])
    # Which rows are written is decided after they were counted: a filter below would count new shops only.
    outcomes.withColumn("_keep", F.col("outcome") == "added").filter("_keep").select("url", "domain").write.mode("append").parquet(folder)
    return dict(seen.get)


def new_shops(listed: DataFrame, shops: DataFrame) -> DataFrame:
    """listed(url) -> url, domain of shops not yet known by URL or by domain, each once. Two anti joins in a row keep both
    conditions equi-joins."""
    with_domain = listed.select(urls.with_scheme(F.col("url")).alias("url")).withColumn("domain", urls.domain(F.col("url")))
    public = with_domain.filter(urls.public_url(F.col("url"), F.lit(None).cast("array<string>")))
    known = shops.select(F.lower("domain").alias("_domain")).distinct()
    fresh = public.join(shops.select("url").distinct(), "url", "left_anti").join(known, F.lower(public["domain"]) == F.col("_domain"), "left_anti")
    return fresh.groupBy(F.lower("domain").alias("_key")).agg(F.min(F.struct("url", "domain")).alias("s")).select("s.*")


def without_shops(rows: DataFrame, gone: DataFrame, key: str = "shop_id") -> DataFrame:
    """Rows of an evidence table without those of deleted shops (gone: key)."""
    return rows.join(gone, key, "left_anti")


def usable_whois(rows: DataFrame) -> DataFrame:
    """WHOIS rows that hold anything: a registrar, a date, raw text or an error."""
    return rows.filter(F.coalesce("registrar", F.col("registration_date").cast("string"), "raw_data", "error").isNotNull())


def append(df: DataFrame, folder: str, name: str, by: str | None = None) -> None:
    """Append evidence as Parquet."""
    writer = df.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(f"{folder}/{name}")


def stored_scrape(pages: DataFrame) -> DataFrame:
    """What is stored of a crawl: sorted lists, at most 100 external links, and a hash of its provenance."""
    return pages.withColumns({"external_links": F.slice(F.array_sort("external_links"), 1, 100), "provenance_hash": F.sha2(F.to_json("sources"), 256)})


def write_export(df: DataFrame, path: str) -> None:
    """An export as CSV files with headers, as many as df has partitions."""
    df.write.mode("overwrite").option("header", True).csv(path)
