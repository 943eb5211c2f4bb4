"""The filter and sort language of the overview, turned into Columns while the plan is built."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..sources.shared import cut_lineage

_NUMBER = re.compile(r"([><=!]+)?\s*(\d+(?:\.\d+)?)")


def number_filter(value: Column, expression: str | None) -> Column:
    """">5", "<=3", "=8", "!=2" or plain "5" (at least 5). No or unreadable expressions keep all rows; an unknown
    sign means at least; null and NaN count as 0."""
    read = _NUMBER.fullmatch(expression or "")
    if not read:
        return F.lit(True)
    number = F.nanvl(F.coalesce(value.cast("double"), F.lit(0.0)), F.lit(0.0))
    limit = F.lit(float(read[2]))
    compared = {">": number > limit, "<": number < limit, "<=": number <= limit, "=": number == limit, "==": number == limit, "!=": number != limit, "!": number != limit}
    return compared.get(read[1] or ">=", number >= limit)


def bool_filter(value: Column, expression: str | None) -> Column:
    """"ja" keeps true, "nee" false and null, anything else all rows."""
    true = F.coalesce(value, F.lit(False))
    return {"ja": true, "nee": ~true}.get(expression or "", F.lit(True))


def text_filter(value: Column, part: str | None) -> Column:
    return F.lower(F.coalesce(value, F.lit(""))).contains((part or "").lower())


#: Filter name -> (kind, column of the overview).
OVERVIEW_FILTERS = {
    "domain": ("text", "domain"), "risk": ("risk", "risk_level"), "platform": ("text", "platform"), "age": ("number", "domain_age"),
    "emails": ("number", "emails"), "phones": ("number", "phones"), "addresses": ("number", "addresses"), "kvk": ("number", "kvk"),
    "btw": ("number", "btw"), "iban": ("number", "iban"), "keurm": ("number", "trustmarks_verified"), "vals": ("number", "claimed_not_verified"),
    "tp": ("number", "trustpilot_score"), "registrar": ("text", "registrar"), "ssl": ("bool", "ssl_valid"), "contact": ("bool", "contact"),
    "privacy": ("bool", "privacy"), "terms": ("bool", "terms"), "returns": ("bool", "returns"),
}


def column_filters(filters: dict[str, str]) -> Column:
    """The conjunction of all non-empty filters."""
    kinds = {"text": text_filter, "number": number_filter, "bool": bool_filter, "risk": lambda c, x: F.coalesce(c, F.lit("unknown")) == x}
    parts = [kinds[OVERVIEW_FILTERS[k][0]](F.col(OVERVIEW_FILTERS[k][1]), v) for k, v in filters.items() if v]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def search(text: str, *columns: str) -> Column:
    """Case-blind search for a part in any of the columns; % and _ in it are wildcards; null columns do not match."""
    return reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{text}%") for c in columns])


def risk_order(level: Column) -> Column:
    return F.coalesce(*[F.when(level == k, F.lit(v)) for k, v in fixed.RISK_ORDER.items()], F.lit(4))


def sort_key(name: str) -> Column:
    """The overview's sort key of a filter name, with '' or 0 for null."""
    if name == "scanned":
        return F.coalesce(F.date_format("last_scanned", "yyyy-MM-dd HH:mm:ss"), F.lit(""))
    kind, column = OVERVIEW_FILTERS.get(name, ("text", name))
    if kind == "risk":
        return risk_order(F.col(column))
    if kind == "bool":
        return F.coalesce(F.col(column), F.lit(False)).cast("int")
    return F.coalesce(F.col(column), F.lit(0.0) if kind == "number" else F.lit(""))


def page(rows: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    """One page, from 1, of at most 100 rows; the order must end in a unique key."""
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("pages count from 1 and have 1 to 100 rows")
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


#: The names by which the overview can be sorted.
SORT_KEYS = (*OVERVIEW_FILTERS, "scanned")


def numbered(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """All rows with their place in an order, from 1; the order must end in a unique key. Rows are dealt by ranges of the order and stored
    so, and each range goes on from the number of rows before it: no task orders everything."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut_lineage(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    ranges = dealt.groupBy("_range").agg(F.count("*").alias("_rows"))
    before = ranges.select("_range", F.coalesce(F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn(name, within).join(F.broadcast(before), "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")


def scans_matching(scans: DataFrame, shop_id: int | None = None, status: str | None = None) -> DataFrame:
    """Scans with all given properties; 0 and '' are not given."""
    if shop_id:
        scans = scans.filter(F.col("shop_id") == shop_id)
    if status:
        scans = scans.filter(F.col("status") == status)
    return scans


def pinned_first(active: Column, queued: Column) -> Column:
    """A leading sort key: the active shop, then queued ones, then the others."""
    return F.when(active, 0).when(queued, 1).otherwise(2)
