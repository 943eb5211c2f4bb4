"""The shop overview: shops with their latest evidence, one pass per evidence table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .latest import latest, latest_by_id


def last_scanned(scans: DataFrame) -> DataFrame:
    """scans(shop_id, status, completed_at) -> shop_id, last_scanned: a completed scan without a time does not hide a dated one."""
    return scans.filter("status = 'completed'").groupBy("shop_id").agg(F.max("completed_at").alias("last_scanned"), F.lit(True).alias("has_scan"))


def overview(shops: DataFrame, scans: DataFrame) -> DataFrame:
    """shops with last_scanned and has_scan."""
    joined = shops.join(last_scanned(scans), shops["id"] == F.col("shop_id"), "left").drop("shop_id")
    return joined.withColumn("has_scan", F.coalesce("has_scan", F.lit(False)))


def overview_order() -> list[Column]:
    """Shops without a scan first, then by domain."""
    return [F.col("has_scan"), F.col("domain"), F.col("id")]


def with_stats(shops: DataFrame, scrape: DataFrame, whois: DataFrame, ssl: DataFrame, trustmark: DataFrame, tech: DataFrame, scam: DataFrame, status: DataFrame) -> DataFrame:
    """shops with the statistics of the latest record of each kind; null where a shop has none. Within a record, missing page flags are false,
    missing lists empty, missing trustmark counts 0, and empty names null."""
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).otherwise(0)
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    parts = [
        latest_by_id(scrape, "shop_id").select(
            "shop_id", *[size(c).alias(c) for c in ("emails", "phones", "addresses", "kvk", "btw", "iban")],
            flag("has_contact").alias("contact"), flag("has_privacy").alias("privacy"), flag("has_terms").alias("terms"), flag("has_return").alias("returns"),
            "is_opening_soon", "is_maintenance", "has_delivery_time", "has_preorder", "has_whatsapp_contact", "has_suspicious_prices",
            F.coalesce("detected_languages", F.array().cast("array<string>")).alias("detected_languages"),
        ),
        latest_by_id(whois, "shop_id").select("shop_id", given("registrar").alias("registrar"), F.col("domain_age_days").alias("domain_age"), F.col("registration_date").cast("string").alias("registration_date")),
        latest_by_id(ssl, "shop_id").select("shop_id", flag("has_ssl").alias("ssl_valid"), F.col("issuer").alias("ssl_issuer")),
        latest_by_id(trustmark, "shop_id").select(
            "shop_id", F.coalesce("total_verified", F.lit(0)).alias("trustmarks_verified"), F.coalesce("claimed_not_verified", F.lit(0)).alias("claimed_not_verified"), "trustpilot_score"
        ),
        latest_by_id(tech, "shop_id").select("shop_id", F.coalesce(given("ecommerce_platform"), given("cms")).alias("platform")),
        latest_by_id(scam, "shop_id").select("shop_id", F.col("flagged").alias("scam_flagged"), F.col("total_hits").alias("scam_hits")),
        latest(status, "shop_id", F.col("checked_at").desc_nulls_last(), F.col("id").desc()).select("shop_id", "is_online", F.col("checked_at").alias("status_checked_at")),
    ]
    out = shops
    for part in parts:
        out = out.join(part.withColumnRenamed("shop_id", "_shop"), F.col("id") == F.col("_shop"), "left").drop("_shop")
    return out


def detail(shops: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """shops with one array of records per child table, in the order of their ids; empty where there are none. A shop's
    records are one row here, so this is for shops that are looked at, not for whole histories."""
    out = shops
    by_id = lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)  # noqa: E731 - records with maps have no order of their own
    for name, rows in children.items():
        fields = [c for c in rows.columns if c != "shop_id"]
        nested = rows.groupBy("shop_id").agg(F.array_sort(F.collect_list(F.struct("id", *[c for c in fields if c != "id"])), by_id).alias(name))
        out = out.join(nested, out["id"] == nested["shop_id"], "left").drop("shop_id").withColumn(name, F.coalesce(name, F.array()))
    return out


def shop_of(shops: DataFrame, key: int) -> DataFrame:
    """The shop of an id: one row or none, read with the condition pushed to the files."""
    return shops.filter(F.col("id") == key)


def detail_json(details: DataFrame) -> DataFrame:
    """detail's rows as JSON texts: id, json."""
    return details.select("id", F.to_json(F.struct(*details.columns)).alias("json"))


def yes_no(value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit(False)), "Ja").otherwise("Nee")


def three_way(value: Column) -> Column:
    return F.when(value, "Ja").when(~value, "Nee").otherwise("")


#: Export label -> column of the overview, in order, by kind of cell.
EXPORT = [
    ("Domein", "text", "domain"), ("URL", "text", "url"), ("Risico", "risk", "risk_level"), ("Platform", "text", "platform"),
    ("Domeinleeftijd (dagen)", "blank", "domain_age"), ("Registrar", "text", "registrar"), ("SSL geldig", "yes", "ssl_valid"), ("Online", "three", "is_online"),
    ("E-mails (aantal)", "number", "emails"), ("Telefoon (aantal)", "number", "phones"), ("Adressen (aantal)", "number", "addresses"),
    ("KvK (aantal)", "number", "kvk"), ("BTW (aantal)", "number", "btw"), ("IBAN (aantal)", "number", "iban"),
    ("Contact pagina", "yes", "contact"), ("Privacy pagina", "yes", "privacy"), ("Voorwaarden", "yes", "terms"), ("Retourbeleid", "yes", "returns"),
    ("Keurmerken (geverif.)", "number", "trustmarks_verified"), ("Valse keurmerken", "number", "claimed_not_verified"),
    ("Trustpilot score", "blank", "trustpilot_score"), ("Laatste scan", "time", "last_scanned"),
]


def export_rows(shops: DataFrame) -> DataFrame:
    """The 22 columns of the standard export; columns that shops lack are empty."""
    cells = {
        "text": lambda c: F.coalesce(c.cast("string"), F.lit("")),
        "risk": lambda c: F.coalesce(c.cast("string"), F.lit("onbekend")),
        "blank": lambda c: F.when(c.isNull() | (c == 0), "").otherwise(c.cast("string")),
        "yes": lambda c: yes_no(c.cast("boolean")),
        "three": lambda c: three_way(c.cast("boolean")),
        "number": lambda c: F.coalesce(c.cast("long"), F.lit(0)),
        "time": lambda c: F.coalesce(F.date_format(c.cast("timestamp"), "yyyy-MM-dd HH:mm:ss"), F.lit("")),
    }
    return shops.select(*[cells[kind](F.col(c) if c in shops.columns else F.lit(None)).alias(label) for label, kind, c in EXPORT])


def joined_lists(record: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The extended export's columns: lists joined by ", ", or another sign given as label -> sign in columns."""
    clean = lambda c: F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    return record.select("shop_id", *[F.array_join(clean(c), sign).alias(c) for c, sign in columns.items()])
