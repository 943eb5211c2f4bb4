"""Row sets for reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, urls


def lookup(code: Column, table: dict[str, str]) -> Column:
    """A code's name, or the code in upper case."""
    names = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(names, code), F.upper(code))


def ibans_by_country(ibans: DataFrame, by: str, column: str = "iban") -> DataFrame:
    """by, country, name, ibans (sorted), place: the Netherlands first, then by code."""
    country = F.upper(F.substring(column, 1, 2))
    grouped = ibans.groupBy(by, country.alias("country")).agg(F.array_sort(F.collect_set(column)).alias("ibans"))
    return grouped.select(by, "country", lookup(F.col("country"), fixed.COUNTRY_NAMES).alias("name"), "ibans", (F.col("country") != "NL").cast("int").alias("foreign"))


def question_status(answer: Column, kind: str) -> Column:
    """The mark of a questionnaire's answer: unknown, warn or neutral by kind when true, ok when true, else none."""
    positive = {"warn": "warn", "neutral": "neutral"}.get(kind, "ok")
    return F.when(answer.isNull(), "unknown").when(answer, positive).otherwise("none")


def report_rows(shops: DataFrame, key: str, sections: list[tuple[str, list[tuple[str, str]]]]) -> DataFrame:
    """(key, section, ord, label, value): one row per shop and line. sections: name -> lines of (label, column)."""
    lines, n = [], 0
    for section, labelled in sections:
        for label, column in labelled:
            lines.append(F.struct(F.lit(section).alias("section"), F.lit(n).alias("ord"), F.lit(label).alias("label"), F.coalesce(F.col(column).cast("string"), F.lit("—")).alias("value")))
            n += 1
    return shops.select(key, F.explode(F.array(*lines)).alias("_line")).select(key, "_line.*")


def sources_shown(values: DataFrame, provenance: DataFrame, by: str, most: int = 3) -> DataFrame:
    """values(by, value) with up to `most` pages on which each was found."""
    return values.join(provenance.select(by, "value", F.slice("urls", 1, most).alias("shown")), [by, "value"], "left")


def settings_listed(definitions: DataFrame, stored: DataFrame) -> DataFrame:
    """definitions(key, label, service, ord) with what is stored (key, value), masked, in the order of definitions."""
    from ..functions.text import masked

    joined = definitions.join(stored, "key", "left")
    return joined.select("service", "ord", "key", "label", F.col("value").isNotNull().alias("is_set"), masked(F.coalesce("value", F.lit(""))).alias("shown"))


def settings_by_service(listed: DataFrame) -> DataFrame:
    """settings_listed's rows by service: service, settings (in their order), n_set."""
    items = F.sort_array(F.collect_list(F.struct("ord", "key", "label", "is_set", "shown")))
    return listed.groupBy("service").agg(items.alias("settings"), F.count_if("is_set").alias("n_set"))


def evidence_files(pages: DataFrame, by: str = "shop_id") -> DataFrame:
    """evidence_pages with a file name for each page and one escaped line for each finding."""
    line = lambda f: F.concat(urls.html_escaped(f["type"]), F.lit(": "), urls.html_escaped(f["value"]))
    from pyspark.sql import Window

    index = F.row_number().over(Window.partitionBy(by).orderBy("url")) - 1
    return pages.withColumn("_index", index).select(by, "url", urls.file_prefix(F.col("url"), F.col("_index")).alias("file"), F.transform("findings", line).alias("lines"))


def non_zero(counts: Column) -> Column:
    """The entries of a map of counts that are above zero."""
    return F.map_filter(counts, lambda k, v: F.coalesce(v, F.lit(0)) > 0)


def batch_of_reports(rows: DataFrame, chosen: DataFrame, key: str, most: int = 50) -> DataFrame:
    """report_rows of the chosen shops (key), at most `most` of them, by key; shops that do not exist are left out."""
    picked = chosen.select(key).distinct().join(rows.select(key).distinct(), key, "left_semi").orderBy(key).limit(most)
    return rows.join(F.broadcast(picked), key, "left_semi")
