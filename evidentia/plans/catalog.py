"""The registered queries. The test tables stand in for the evidence: customer for shops, orders for scans, events for
availability checks and tracker ids, pages for crawled pages, documents for page texts. What those tables do not hold is
shown on literal rows, given to Spark and to SQL alike."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed, text, urls
from ..functions import html as html_functions
from ..operators import crawl, evidence, filters, latest, overview, report, risk, technology
from ..sources import ingest
from ..sources.shared import shared_folder
from ..streaming import status as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL form."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(literal, value)) + "]"
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    """A SQL table of literal rows."""
    return f"(VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS t({columns})"


def sql_set(lists: str) -> str:
    return f"array_to_string(list_sort(list_distinct({lists})), '|')"


def joined(values_: F.Column) -> F.Column:
    return F.array_join(values_, "|")


# --- shops, scans and statuses on the test tables


def shops(spark, d):
    c = table(spark, d, "customer")
    level = F.element_at(F.array(*[F.lit(x) for x in ("low", "medium", "high", "critical", "unknown")]), F.pmod(F.col("c_custkey"), F.lit(5)).cast("int") + 1)
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("domain"), F.concat(F.lit("https://www."), F.lower("c_name"), F.lit(".nl")).alias("url"), F.col("c_mktsegment").alias("platform"), F.col("c_acctbal").alias("domain_age"), level.alias("risk_level"))


SHOPS = """(SELECT c_custkey AS id, c_name AS domain, 'https://www.' || lower(c_name) || '.nl' AS url, c_mktsegment AS platform, c_acctbal AS domain_age,
            (['low','medium','high','critical','unknown'])[c_custkey % 5 + 1] AS risk_level FROM customer)"""


def scans(spark, d):
    o = table(spark, d, "orders")
    done = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "partial").otherwise("running")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("shop_id"), done.alias("status"), F.col("o_orderdate").alias("completed_at"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))


SCANS = """(SELECT o_orderkey AS id, o_custkey AS shop_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'partial' ELSE 'running' END AS status,
            o_orderdate AS completed_at, o_totalprice AS price, o_orderpriority AS priority FROM orders)"""


def checks(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("shop_id"), (F.col("event_type") != "error").alias("is_online"), F.col("value").alias("response_ms"), F.col("ts").alias("checked_at"), F.get_json_object("props", "$.k").alias("k"))


CHECKS = """(SELECT event_id AS id, user_id AS shop_id, event_type <> 'error' AS is_online, value AS response_ms, ts AS checked_at,
             json_extract_string(props, '$.k') AS k FROM events)"""

LAST = f"(SELECT shop_id, max(completed_at) AS last_scanned FROM {SCANS} WHERE status = 'completed' GROUP BY 1)"


@query(f"""SELECT s.id, s.domain, l.last_scanned, l.shop_id IS NOT NULL AS has_scan FROM {SHOPS} s LEFT JOIN {LAST} l ON s.id = l.shop_id
           ORDER BY has_scan, domain, id LIMIT 20""")
def overview_page(spark, d):
    return filters.page(overview.overview(shops(spark, d), scans(spark, d)), overview.overview_order()).select("id", "domain", "last_scanned", "has_scan")


@query(f"SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY shop_id ORDER BY id DESC) AS r FROM {SCANS}) WHERE r = 1")
def latest_record_by_id(spark, d):
    return latest.latest_by_id(scans(spark, d), "shop_id")


@query(f"SELECT * EXCLUDE (r, k) FROM (SELECT *, row_number() OVER (PARTITION BY shop_id ORDER BY checked_at DESC, id DESC) AS r FROM {CHECKS}) WHERE r = 1")
def latest_status(spark, d):
    return latest.latest(checks(spark, d), "shop_id", F.col("checked_at").desc(), F.col("id").desc()).drop("k")


@query(f"SELECT shop_id, id, place FROM (SELECT *, row_number() OVER (PARTITION BY shop_id ORDER BY checked_at DESC, id DESC) AS place FROM {CHECKS}) WHERE place <= 20")
def status_history_20(spark, d):
    return latest.last_n(checks(spark, d), "shop_id", 20, F.col("checked_at").desc(), F.col("id").desc()).select("shop_id", "id", "place")


@query(f"SELECT shop_id, last_scanned FROM {LAST}")
def last_scanned(spark, d):
    return overview.last_scanned(scans(spark, d)).select("shop_id", "last_scanned")


@query(f"SELECT id, shop_id, completed_at FROM {SCANS} WHERE status = 'completed' ORDER BY completed_at DESC, id DESC LIMIT 100")
def scan_list_filtered(spark, d):
    rows = filters.scans_matching(scans(spark, d), shop_id=0, status="completed").select("id", "shop_id", "completed_at")
    return filters.page(rows, [F.col("completed_at").desc(), F.col("id").desc()], 1, 100)


@query(f"SELECT id, domain FROM {SHOPS} WHERE url ILIKE '%r#00%1.nl%' OR domain ILIKE '%r#00%1.nl%' OR platform ILIKE '%r#00%1.nl%' OR domain ILIKE '%99%'")
def shop_search_ilike(spark, d):
    return shops(spark, d).filter(filters.search("r#00%1.nl", "url", "domain", "platform") | filters.search("99", "domain")).select("id", "domain")


@query("SELECT count(*) AS n FROM customer")
def shop_count(spark, d):
    return shops(spark, d).agg(F.count("*").alias("n"))


@query(f"SELECT id, risk_level FROM {SHOPS} WHERE risk_level = 'high'")
def risk_level_filter(spark, d):
    return shops(spark, d).filter(F.col("risk_level") == "high").select("id", "risk_level")


@query(f"""SELECT id, CASE WHEN domain_age / 100 >= 70 THEN 'low' WHEN domain_age / 100 >= 40 THEN 'medium' WHEN domain_age / 100 >= 15 THEN 'high' ELSE 'critical' END AS level,
           CASE WHEN domain_age < 365 THEN 'young' WHEN domain_age < 730 THEN 'recent' ELSE 'settled' END AS age FROM {SHOPS}""")
def risk_bucket(spark, d):
    return shops(spark, d).select("id", risk.level(F.col("domain_age") / 100).alias("level"), evidence.age_class(F.col("domain_age")).alias("age"))


NUMBER_CASES = [(k, x, v) for k, (x, v) in enumerate((x, v) for x in (">5", ">=5", "5", "<10", "=8", "!=8", "abc", "") for v in (5.0, 8.0, 12.5, None))]


@query(f"""SELECT k, CASE x WHEN '>5' THEN w > 5 WHEN '>=5' THEN w >= 5 WHEN '5' THEN w >= 5 WHEN '<10' THEN w < 10 WHEN '=8' THEN w = 8 WHEN '!=8' THEN w <> 8 ELSE true END AS kept
           FROM (SELECT *, coalesce(v, 0) AS w FROM {values(NUMBER_CASES, 'k, x, v')})
           UNION ALL SELECT id + 1000, domain_age >= 4500 FROM {SHOPS}""")
def numeric_filter_dsl(spark, d):
    rows = spark.createDataFrame(NUMBER_CASES, "k long, x string, v double")
    kept = F.coalesce(*[F.when(F.col("x") == x, filters.number_filter(F.col("v"), x)) for x in dict.fromkeys(c[1] for c in NUMBER_CASES)])
    return rows.select("k", kept.alias("kept")).union(shops(spark, d).select(F.col("id") + 1000, filters.number_filter(F.col("domain_age"), "4500")))


BOOL_CASES = [(k, x, v) for k, (x, v) in enumerate((x, v) for x in ("ja", "nee", "", "misschien") for v in (True, False, None))]


@query(f"SELECT k, CASE x WHEN 'ja' THEN coalesce(v, false) WHEN 'nee' THEN NOT coalesce(v, false) ELSE true END AS kept FROM {values(BOOL_CASES, 'k, x, v')}")
def bool_filter_dsl(spark, d):
    rows = spark.createDataFrame(BOOL_CASES, "k long, x string, v boolean")
    return rows.select("k", F.coalesce(*[F.when(F.col("x") == x, filters.bool_filter(F.col("v"), x)) for x in ("ja", "nee", "", "misschien")]).alias("kept"))


@query(f"SELECT id FROM {SHOPS} WHERE contains(lower(domain), '#0000') AND contains(lower(platform), 'build') AND domain_age < 6000 AND risk_level = 'low'")
def column_filters(spark, d):
    return shops(spark, d).filter(filters.column_filters({"domain": "#0000", "platform": "BUILD", "age": "<6000", "risk": "low", "emails": ""})).select("id")


@query(f"SELECT (l.shop_id IS NOT NULL) AS scanned, count(*) AS n FROM {SHOPS} s LEFT JOIN {LAST} l ON s.id = l.shop_id GROUP BY 1")
def scanned_unscanned(spark, d):
    return overview.overview(shops(spark, d), scans(spark, d)).groupBy(F.col("last_scanned").isNotNull().alias("scanned")).agg(F.count("*").alias("n"))


@query(f"SELECT id, domain FROM {SHOPS} WHERE id IN (SELECT shop_id FROM {SCANS} WHERE priority = '1-URGENT' AND price > 300000)")
def selected_semi(spark, d):
    picked = scans(spark, d).filter("priority = '1-URGENT' AND price > 300000").select(F.col("shop_id").alias("id"))
    return shops(spark, d).join(picked, "id", "left_semi").select("id", "domain")


LISTED = [("Winkel-Een.nl",), ("www.winkel-een.nl",), ("https://winkel-twee.nl/",), (" winkel-drie.nl ",), ("localhost",)]


@query(f"""WITH l AS (SELECT CASE WHEN starts_with(trim(u), 'http') THEN trim(u) ELSE 'https://' || trim(u) END AS url FROM {values(LISTED, 'u')}
                      UNION ALL SELECT url FROM {SHOPS} UNION ALL SELECT url || '/x' FROM {SHOPS} UNION ALL SELECT 'new' || id || '.nl' FROM {SHOPS} WHERE platform = 'BUILDING'),
                m AS (SELECT CASE WHEN starts_with(url, 'http') THEN url ELSE 'https://' || url END AS url FROM l),
                n AS (SELECT url, regexp_replace(regexp_extract(url, '^https?://([^/?#]*)', 1), '^www\\.', '') AS domain FROM m)
           SELECT domain, count(*) AS n FROM (SELECT min(domain) AS domain, lower(domain) AS k FROM n
             WHERE domain <> 'localhost' AND lower(domain) NOT IN (SELECT lower(c_name) || '.nl' FROM customer) GROUP BY lower(domain)) GROUP BY 1""")
def import_anti(spark, d):
    own = shops(spark, d)
    listed = spark.createDataFrame(LISTED, "url string").union(own.select("url")).union(own.select(F.concat("url", F.lit("/x"))))
    listed = listed.union(own.filter("platform = 'BUILDING'").select(F.concat(F.lit("new"), "id", F.lit(".nl"))))
    # A shop's URL holds a '#', which ends its authority; its known domain is what the same reading gives.
    known = own.select("url", F.concat(F.lower("domain"), F.lit(".nl")).alias("domain"))
    return ingest.new_shops(listed, known).groupBy(F.col("domain")).agg(F.count("*").alias("n"))


@query(f"""SELECT id, row_number() OVER (ORDER BY CASE risk_level WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, domain_age DESC, id) AS place FROM {SHOPS}""")
def client_sort(spark, d):
    return filters.numbered(shops(spark, d), [filters.sort_key("risk"), filters.sort_key("age").desc(), F.col("id")]).select("id", "place")


@query(f"""SELECT id, row_number() OVER (ORDER BY CASE WHEN id = 77 THEN 0 WHEN platform = 'HOUSEHOLD' THEN 1 ELSE 2 END, domain, id) AS place FROM {SHOPS}""")
def pin_to_top(spark, d):
    return filters.numbered(shops(spark, d), [filters.pinned_first(F.col("id") == 77, F.col("platform") == "HOUSEHOLD"), F.col("domain"), F.col("id")]).select("id", "place")


# Evidence records made of orders: which orders are records of a kind, their columns, and the statistics that SQL expects of the latest.
_some = lambda n: f"slice(array('a', 'b', 'c', 'd'), 1, cast({n} AS int))"
FLAGS = {"is_opening_soon": "o_orderkey % 7 = 1", "is_maintenance": "o_orderkey % 11 = 1", "has_delivery_time": "o_custkey % 2 = 1", "has_preorder": "o_custkey % 5 = 2", "has_whatsapp_contact": "o_orderkey % 6 = 2", "has_suspicious_prices": "o_totalprice < 50000"}
RECORDS = {
    "scrape": ("o_orderkey % 2 = 0", {
        "emails": _some("o_orderkey % 4"), "phones": _some("o_orderkey % 3"), "addresses": _some("o_custkey % 2"), "kvk": _some("least(4, o_orderkey % 5)"), "btw": f"CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE {_some('o_custkey % 4')} END",
        "iban": _some("o_custkey % 3"), "has_contact": "nullif(o_orderkey % 3 = 1, false)", "has_privacy": "nullif(o_orderkey % 5 = 1, false)", "has_terms": "o_custkey % 3 = 1", "has_return": "o_custkey % 7 = 1", **FLAGS,
        "detected_languages": "CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE slice(array('nl', 'en', 'de'), 1, cast(o_orderkey % 4 AS int)) END",
    }, {
        "emails": "(o_orderkey % 4)::INTEGER", "phones": "(o_orderkey % 3)::INTEGER", "addresses": "(o_custkey % 2)::INTEGER", "kvk": "least(4, o_orderkey % 5)::INTEGER", "btw": "(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey % 4 END)::INTEGER",
        "iban": "(o_custkey % 3)::INTEGER", "contact": "o_orderkey % 3 = 1", "privacy": "o_orderkey % 5 = 1", "terms": "o_custkey % 3 = 1", "returns": "o_custkey % 7 = 1", **FLAGS,
        "detected_languages": "CASE WHEN o_custkey % 9 = 0 THEN '' ELSE array_to_string((['nl', 'en', 'de'])[1:(o_orderkey % 4)], '|') END",
    }),
    "whois": ("o_orderkey % 3 = 0", {"registrar": "CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END", "domain_age_days": "cast(o_orderkey % 1500 AS int)", "registration_date": "cast(o_orderdate AS date)"},
              {"registrar": "CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END", "domain_age": "(o_orderkey % 1500)::INTEGER", "registration_date": "o_orderdate::DATE::VARCHAR"}),
    "ssl": ("o_orderkey % 3 = 1", {"has_ssl": "nullif(o_orderkey % 2 = 0, false)", "issuer": "o_orderpriority"}, {"ssl_valid": "o_orderkey % 2 = 0", "ssl_issuer": "o_orderpriority"}),
    "trustmark": ("o_orderkey % 4 = 0", {"total_verified": "nullif(cast(o_orderkey % 3 AS int), 0)", "claimed_not_verified": "nullif(cast(o_custkey % 2 AS int), 0)", "trustpilot_score": "CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE cast(o_custkey % 50 AS double) / 10 END"},
                  {"trustmarks_verified": "(o_orderkey % 3)::INTEGER", "claimed_not_verified": "(o_custkey % 2)::INTEGER", "trustpilot_score": "CASE WHEN o_custkey % 3 <> 0 THEN (o_custkey % 50)::DOUBLE / 10 END"}),
    "tech": ("o_orderkey % 5 = 0", {"ecommerce_platform": "CASE WHEN o_custkey % 3 = 0 THEN 'Shopify' ELSE '' END", "cms": "CASE WHEN o_custkey % 4 = 0 THEN 'WordPress' END"},
             {"platform": "CASE WHEN o_custkey % 3 = 0 THEN 'Shopify' WHEN o_custkey % 4 = 0 THEN 'WordPress' END"}),
    "scam": ("o_orderkey % 7 = 0", {"flagged": "o_totalprice > 200000", "total_hits": "cast(o_orderkey % 6 AS int)"}, {"scam_flagged": "o_totalprice > 200000", "scam_hits": "(o_orderkey % 6)::INTEGER"}),
}
_BASE = ["id", "domain", "url", "risk_level"]
_STATS = [c for _, _, stats in RECORDS.values() for c in stats]
OVERVIEW = f"(SELECT {', '.join('s.' + c for c in _BASE)}, l.last_scanned, l.shop_id IS NOT NULL AS has_scan, {', '.join(f'{k}.{c}' for k, (_, _, stats) in RECORDS.items() for c in stats)}, e.is_online, e.checked_at AS status_checked_at FROM {SHOPS} s LEFT JOIN {LAST} l ON s.id = l.shop_id " + " ".join(
    f"LEFT JOIN (SELECT o_custkey AS shop_id, {', '.join(f'{x} AS {c}' for c, x in stats.items())} FROM orders WHERE {where} QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) {k} ON s.id = {k}.shop_id"
    for k, (where, _, stats) in RECORDS.items()
) + f" LEFT JOIN (SELECT * FROM {CHECKS} QUALIFY row_number() OVER (PARTITION BY shop_id ORDER BY checked_at DESC, id DESC) = 1) e ON s.id = e.shop_id)"


def full_overview(spark, d):
    """The overview with the statistics of eight kinds of records."""
    o = table(spark, d, "orders")
    made = {k: o.filter(where).selectExpr("o_orderkey AS id", "o_custkey AS shop_id", *[f"{x} AS {c}" for c, x in columns.items()]) for k, (where, columns, _) in RECORDS.items()}
    return overview.with_stats(overview.overview(shops(spark, d).select(_BASE), scans(spark, d)), **made, status=checks(spark, d))


@query(f"SELECT * FROM {OVERVIEW}")
def overview_full(spark, d):
    return full_overview(spark, d).withColumn("detected_languages", joined(F.col("detected_languages")))


_CELLS = {
    "text": "coalesce({c}::VARCHAR, '')", "risk": "coalesce({c}, 'onbekend')", "blank": "CASE WHEN {c} IS NULL OR {c} = 0 THEN '' ELSE {c}::VARCHAR END", "yes": "CASE WHEN {c} THEN 'Ja' ELSE 'Nee' END",
    "three": "CASE WHEN {c} THEN 'Ja' WHEN NOT {c} THEN 'Nee' ELSE '' END", "number": "coalesce({c}, 0)::BIGINT", "time": "coalesce(strftime({c}, '%Y-%m-%d %H:%M:%S'), '')",
}


@query("SELECT " + ", ".join(_CELLS[kind].format(c=c) + f' AS "{label}"' for label, kind, c in overview.EXPORT) + f" FROM {OVERVIEW}")
def export_standard(spark, d):
    return overview.export_rows(full_overview(spark, d))


_SQL_KEYS = {"risk": "CASE risk_level WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END", "scanned": "coalesce(strftime(last_scanned, '%Y-%m-%d %H:%M:%S'), '')"} | {
    k: {"text": f"coalesce({c}, '')", "number": f"coalesce({c}, 0)::DOUBLE", "bool": f"coalesce({c}, false)::INTEGER"}[kind] for k, (kind, c) in filters.OVERVIEW_FILTERS.items() if kind != "risk"
}


@query("SELECT id, " + ", ".join(f'{_SQL_KEYS[k]} AS "{k}"' for k in filters.SORT_KEYS) + f" FROM {OVERVIEW}")
def sort_keys(spark, d):
    return full_overview(spark, d).select("id", *[filters.sort_key(k).alias(k) for k in filters.SORT_KEYS])


SORTED = {"tp": "desc", "scanned": "asc", "registrar": "desc", "emails": "asc"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS key, id, row_number() OVER (ORDER BY {_SQL_KEYS[k]} {way}, id) AS place FROM {OVERVIEW}" for k, way in SORTED.items()))
def sorted_overview(spark, d):
    rows = full_overview(spark, d).select("id", *[filters.sort_key(k).alias(k) for k in SORTED])
    each = [filters.numbered(rows, [F.col(k).desc() if way == "desc" else F.col(k).asc(), F.col("id")]).select(F.lit(k).alias("key"), "id", "place") for k, way in SORTED.items()]
    return each[0].union(each[1]).union(each[2]).union(each[3])


ASKED = {
    "domain": "#0000", "risk": "high", "platform": "shop", "age": "<900", "emails": ">1", "phones": "2", "addresses": "=1", "kvk": "!=0", "btw": ">=2", "iban": "<2", "keurm": "1", "vals": "=1", "tp": ">2.5",
    "registrar": "URGENT", "ssl": "ja", "contact": "nee", "privacy": "ja", "terms": "nee", "returns": "ja",
}
_SQL_ASKED = {
    "domain": "contains(lower(domain), '#0000')", "risk": "risk_level = 'high'", "platform": "contains(lower(coalesce(platform, '')), 'shop')", "age": "coalesce(domain_age, 0) < 900", "emails": "coalesce(emails, 0) > 1",
    "phones": "coalesce(phones, 0) >= 2", "addresses": "coalesce(addresses, 0) = 1", "kvk": "coalesce(kvk, 0) <> 0", "btw": "coalesce(btw, 0) >= 2", "iban": "coalesce(iban, 0) < 2", "keurm": "coalesce(trustmarks_verified, 0) >= 1",
    "vals": "coalesce(claimed_not_verified, 0) = 1", "tp": "coalesce(trustpilot_score, 0) > 2.5", "registrar": "contains(lower(coalesce(registrar, '')), 'urgent')", "ssl": "coalesce(ssl_valid, false)",
    "contact": "NOT coalesce(contact, false)", "privacy": "coalesce(privacy, false)", "terms": "NOT coalesce(terms, false)", "returns": "coalesce(returns, false)",
}


@query(f"SELECT id, {', '.join(f'{x} AS {k}' for k, x in _SQL_ASKED.items())} FROM {OVERVIEW}")
def each_column_filter(spark, d):
    return full_overview(spark, d).select("id", *[filters.column_filters({k: v}).alias(k) for k, v in ASKED.items()])


@query(f"SELECT id, domain, url FROM {SHOPS} WHERE id = 7")
def shop_by_id(spark, d):
    return overview.shop_of(shops(spark, d), 7).select("id", "domain", "url")


@query(f"""SELECT v, shop_id, domain, url, shops FROM (SELECT *, count(*) OVER (PARTITION BY v) AS shops FROM (SELECT DISTINCT shop_id, 'GTM-K' || k AS v FROM {CHECKS} WHERE k IS NOT NULL)) JOIN {SHOPS} s ON shop_id = s.id WHERE shops > 1""")
def tracker_xref_domains(spark, d):
    ids = checks(spark, d).filter("k is not null").select("shop_id", F.concat(F.lit("GTM-K"), "k").alias("v"))
    return technology.cross_references(ids, shops(spark, d), "shop_id", "v")


TRACKER_ROWS = f"(SELECT shop_id, CASE WHEN id % 2 = 0 THEN 'google_tag_manager' ELSE 'google_analytics' END AS platform, CASE WHEN id % 2 = 0 THEN 'GTM-K' ELSE 'UA-' END || k AS display_id FROM {CHECKS} WHERE k IS NOT NULL)"


def tracker_rows(spark, d):
    return checks(spark, d).filter("k is not null").selectExpr("shop_id", "CASE WHEN id % 2 = 0 THEN 'google_tag_manager' ELSE 'google_analytics' END AS platform", "CASE WHEN id % 2 = 0 THEN 'GTM-K' ELSE 'UA-' END || k AS display_id")


@query(f"""SELECT shop_id, string_agg(DISTINCT platform, '|' ORDER BY platform) AS trackers, string_agg(DISTINCT display_id, ' ' ORDER BY display_id) AS all_ids_flat, count(DISTINCT platform) AS total_trackers,
           count(DISTINCT display_id) AS total_unique_ids FROM {TRACKER_ROWS} GROUP BY 1""")
def tracker_records(spark, d):
    return technology.tracker_records(tracker_rows(spark, d), "shop_id").withColumn("trackers", joined(F.col("trackers")))


@query(f"SELECT shop_id, count(DISTINCT platform) AS platforms, count(DISTINCT display_id) AS ids FROM {TRACKER_ROWS} GROUP BY 1")
def tracker_totals(spark, d):
    pages = tracker_rows(spark, d).select("shop_id", F.array(F.struct("platform", "display_id")).alias("trackers"))
    return technology.tracker_totals(pages, "shop_id")


@query(f"""SELECT shop_id, id, place FROM (SELECT shop_id, id, row_number() OVER (PARTITION BY shop_id ORDER BY id) AS place FROM (SELECT DISTINCT shop_id, display_id AS id FROM {TRACKER_ROWS}
           UNION SELECT o_custkey, 'UA-' || o_orderkey % 9 FROM orders UNION SELECT o_custkey, 'G-' || o_orderkey % 9 FROM orders) WHERE starts_with(id, 'UA-') OR starts_with(id, 'GTM-')) WHERE place <= 3""")
def reverse_lookup_ids(spark, d):
    o = table(spark, d, "orders").selectExpr("o_custkey AS shop_id", "explode(array('UA-' || (o_orderkey % 9), 'G-' || (o_orderkey % 9))) AS id")
    return technology.reverse_lookup_ids(tracker_rows(spark, d).withColumnRenamed("display_id", "id"), o, "shop_id")


LISTS = [(1, '["b@x.nl","a@x.nl"]', '["Weg 1","Laan 2"]'), (2, "[]", None), (3, '["","c@x.nl"]', '"los"'), (4, None, "[]")]


@query(f"""SELECT shop_id, array_to_string(list_filter(from_json(coalesce(emails, '[]'), '["VARCHAR"]'), lambda x: x <> ''), ', ') AS emails,
           CASE WHEN addresses = '"los"' THEN 'los' ELSE array_to_string(list_filter(from_json(coalesce(addresses, '[]'), '["VARCHAR"]'), lambda x: x <> ''), ' | ') END AS addresses
           FROM {values(LISTS, 'shop_id, emails, addresses')}""")
def export_extended(spark, d):
    rows = spark.createDataFrame(LISTS, "shop_id long, emails string, addresses string")
    lists = rows.select("shop_id", text.json_list(F.col("emails")).alias("emails"), text.json_list(F.col("addresses")).alias("addresses"))
    return overview.joined_lists(lists, {"emails": ", ", "addresses": " | "})


@query(f"SELECT s.id, count(o.id) AS scans, coalesce(string_agg(o.id::VARCHAR, ',' ORDER BY o.id), '') AS scan_ids FROM {SHOPS} s LEFT JOIN {SCANS} o ON s.id = o.shop_id GROUP BY 1")
def shop_detail_nested(spark, d):
    nested = overview.detail(shops(spark, d), {"scans": scans(spark, d).select("id", "shop_id", "status")})
    return nested.select("id", F.size("scans").cast("long").alias("scans"), F.array_join(F.transform("scans", lambda s: s["id"].cast("string")), ",").alias("scan_ids"))


@query(f"""SELECT s.id, s.domain, l.last_scanned, e.is_online, e.checked_at, r.status AS last_status FROM {SHOPS} s LEFT JOIN {LAST} l ON s.id = l.shop_id
           LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY shop_id ORDER BY checked_at DESC, id DESC) AS r FROM {CHECKS}) WHERE r = 1) e ON s.id = e.shop_id
           LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY shop_id ORDER BY id DESC) AS r FROM {SCANS}) WHERE r = 1) r ON s.id = r.shop_id""")
def overview_stats(spark, d):
    last_check = latest.latest(checks(spark, d), "shop_id", F.col("checked_at").desc(), F.col("id").desc()).select(F.col("shop_id").alias("id"), "is_online", "checked_at")
    last_row = latest.latest_by_id(scans(spark, d), "shop_id").select(F.col("shop_id").alias("id"), F.col("status").alias("last_status"))
    return overview.overview(shops(spark, d), scans(spark, d)).select("id", "domain", "last_scanned").join(last_check, "id", "left").join(last_row, "id", "left")


@query(f"""WITH t AS (SELECT DISTINCT shop_id, 'GTM-K' || k AS v FROM {CHECKS} WHERE k IS NOT NULL)
           SELECT v, count(*) AS shops, min(shop_id) AS first_shop, max(shop_id) AS last_shop FROM t GROUP BY 1 HAVING count(*) > 1""")
def tracker_xref_equi(spark, d):
    ids = checks(spark, d).filter("k is not null").select("shop_id", F.concat(F.lit("GTM-K"), "k").alias("v"))
    return technology.shops_by_id(ids, "shop_id", "v")


@query(f"""WITH t AS (SELECT DISTINCT shop_id, 'GTM-K' || k AS v FROM {CHECKS} WHERE k IS NOT NULL)
           SELECT v, shop_id, shops FROM (SELECT *, count(*) OVER (PARTITION BY v) AS shops FROM t) WHERE shops > 1""")
def tracker_xref_shops(spark, d):
    ids = checks(spark, d).filter("k is not null").select("shop_id", F.concat(F.lit("GTM-K"), "k").alias("v"))
    return technology.shops_of_shared_ids(ids, "shop_id", "v")


LOOKED_FOR = f"(SELECT DISTINCT shop_id, CASE id % 3 WHEN 0 THEN 'AD ' || k || ' --' WHEN 1 THEN 'Page=' || k ELSE k END AS v FROM {CHECKS} WHERE k IS NOT NULL)"


@query(f"""WITH t AS (SELECT v, count(*) AS shops FROM {LOOKED_FOR} GROUP BY 1), p AS (SELECT page_id AS other, lower(url || ' ' || html) AS flat FROM pages)
           SELECT v, shops, other FROM t, p WHERE contains(flat, lower(v))""")
def tracker_xref_contains(spark, d):
    """The pages that contain a value of any shop, and how many shops have it: the whole cross-reference without its pairs of shops."""
    ids = checks(spark, d).filter("k is not null").selectExpr("shop_id", "CASE id % 3 WHEN 0 THEN 'AD ' || k || ' --' WHEN 1 THEN 'Page=' || k ELSE k END AS v").distinct()
    shops = ids.groupBy("v").agg(F.count("*").alias("shops"))
    pages = table(spark, d, "pages").select(F.col("page_id").alias("other"), F.concat_ws(" ", "url", "html").alias("flat"))
    return technology.texts_of_values(shops, "v", pages, "other", "flat").join(shops, "v").select("v", "shops", "other")


@query(f"""WITH t AS (SELECT shop_id, display_id AS v FROM {TRACKER_ROWS})
           SELECT DISTINCT a.shop_id, b.shop_id AS other, a.v FROM t a JOIN t b ON a.v = b.v AND a.shop_id <> b.shop_id""")
def tracker_xref_pairs(spark, d):
    return technology.shared_ids(tracker_rows(spark, d).withColumnRenamed("display_id", "v"), "shop_id", "v")


TRACKED = [
    (1, "<script>gtag('config','AW-123456789');gtag('config', 'UA-12345-1')</script>"),
    (2, "fbq('init', '123456789012345'); facebook.com/tr?id=123456789012345"),
    (3, "GTM-ABC12 gtm-xyz99 ttq.load('ABCDEFGHIJ1234')"),
    (4, "bat.bing.com/bat.js?x&ti=1234567"),
    (5, "nothing"),
]
SQL_TRACKERS = [
    ("google_ads", "AW-", r"(?i)AW-(\d{9,11})"), ("google_ads", "AW-", r"""(?i)send_to["'']?\s*[:=]\s*["'']?AW-(\d{9,11})"""), ("google_analytics", "", r"(?i)(UA-\d{4,10}-\d{1,4})"),
    ("google_tag_manager", "", r"(?i)(GTM-[A-Z0-9]{5,8})"), ("meta_pixel", "FB-", r"""(?i)fbq\s*\(\s*[''"]init[''"]\s*,\s*[''"](\d{12,20})[''"]"""),
    ("meta_pixel", "FB-", r"(?i)facebook\.com/tr\?id=(\d{12,20})"), ("tiktok_pixel", "TT-", r"""(?i)ttq\.load\s*\(\s*[''"]([A-Z0-9]{10,25})[''"]"""), ("bing_uet", "UET-", r"(?i)bat\.bing\.com/bat\.js\?.*ti=(\d{7,10})"),
]


@query("WITH p AS (SELECT id, html FROM " + values(TRACKED, "id, html") + " UNION ALL SELECT page_id + 100, html FROM pages)\nSELECT DISTINCT id, platform, display_id FROM ("
       + " UNION ALL ".join(f"SELECT id, '{n}' AS platform, '{p}' || unnest(regexp_extract_all(html, '{r}', 1)) AS display_id FROM p" for n, p, r in SQL_TRACKERS) + ")")
def tracker_ids(spark, d):
    rows = spark.createDataFrame(TRACKED, "id long, html string").union(table(spark, d, "pages").select(F.col("page_id") + 100, "html"))
    return rows.select("id", F.explode(technology.tracker_ids(F.col("html"))).alias("t")).select("id", "t.platform", "t.display_id").distinct()


TECH_PAGES = [
    (1, '<script src="https://cdn.shopify.com/x.js"></script> Mollie'), (2, '<link href="/wp-content/plugins/woocommerce/a.css"> klarna recaptcha'),
    (3, "magento data-mage-init paypal.com"), (4, "jquery-3 hotjar.com trustpilot"), (5, "plain"),
]
def _sql_signature(patterns: list[str]) -> str:
    return "|".join("(?:" + technology.lower_pattern(p).replace("(?![a-z])", "") + ")" for p in patterns).replace("'", "''")


@query("WITH p AS (SELECT id, html FROM " + values(TECH_PAGES, "id, html") + " UNION ALL SELECT page_id + 100, html FROM pages)\nSELECT id, array_to_string(list_filter(["
       + ", ".join(f"CASE WHEN regexp_matches(lower(html), '{_sql_signature(t[2])}') THEN '{t[1]}' END" for t in fixed.TECHNOLOGIES) + "], lambda x: x IS NOT NULL), '|') AS names FROM p")
def tech_signatures(spark, d):
    rows = spark.createDataFrame(TECH_PAGES, "id long, html string").union(table(spark, d, "pages").select(F.col("page_id") + 100, "html"))
    low = rows.select("id", F.lower("html").alias("low"))
    return low.select("id", technology.detected_names(F.col("low"), lowered=True).alias("names"))


@query("SELECT id, coalesce(" + ", ".join(f"CASE WHEN regexp_matches(lower(html), '{_sql_signature(t[2])}') THEN '{t[1]}' END" for t in fixed.TECHNOLOGIES if t[0] == "ecommerce") + ") AS platform FROM (SELECT * FROM " + values(TECH_PAGES, "id, html") + " UNION ALL SELECT page_id + 100, html FROM pages)")
def tech_first_platform(spark, d):
    rows = spark.createDataFrame(TECH_PAGES, "id long, html string").union(table(spark, d, "pages").select(F.col("page_id") + 100, "html"))
    low = rows.select("id", F.lower("html").alias("low"))
    return low.select("id", technology.first_of(technology.detected(F.col("low"), lowered=True), "ecommerce").alias("platform"))


MARKED = [(-1, {"CF-Ray": "1"}, "Cloudflare"), (-2, {"server": "cloudfront", "x-cache": "x-amz-cf-id"}, "Amazon CloudFront"), (-3, {"x": "y"}, "")]
SHOWN = f"""(SELECT * FROM {values([(m[0], ", ".join(f"{k}: {v}" for k, v in m[1].items())) for m in MARKED], "id, lines")}
             UNION ALL SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'X-Vercel-Id: ' || user_id WHEN 1 THEN 'Server: X-NF ' || event_type ELSE 'Date: ' || user_id END FROM events)"""
SQL_MARKS = [(t[1], t[3]) for t in fixed.TECHNOLOGIES if t[3]]


@query("SELECT id, array_to_string(list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(lines), '{m}')" for m in marks) + f" THEN '{n}' END" for n, marks in SQL_MARKS) + f"], lambda x: x IS NOT NULL), '|') AS names FROM {SHOWN}")
def tech_headers(spark, d):
    """Technologies that only response headers show, by name or by value."""
    own = spark.createDataFrame([m[:2] for m in MARKED], "id long, headers map<string,string>")
    made = table(spark, d, "events").selectExpr("event_id AS id", "CASE event_id % 3 WHEN 0 THEN map('X-Vercel-Id', cast(user_id AS string)) WHEN 1 THEN map('Server', 'X-NF ' || event_type) ELSE map('Date', cast(user_id AS string)) END AS headers")
    return own.union(made).select("id", technology.detected_names(F.lit(""), F.col("headers")).alias("names"))


BY_CATEGORY = list(dict.fromkeys(t[0] for t in fixed.TECHNOLOGIES))


@query("WITH p AS (SELECT id, html FROM " + values(TECH_PAGES, "id, html") + " UNION ALL SELECT page_id + 100, html FROM pages), n AS (SELECT id, unnest(["
       + ", ".join(f"CASE WHEN regexp_matches(lower(html), '{_sql_signature(t[2])}') THEN {{'k': {k}, 'c': '{t[0]}', 'n': '{t[1]}'}} END" for k, t in enumerate(fixed.TECHNOLOGIES))
       + "]) AS t FROM p) SELECT id, t.c AS category, string_agg(t.n, '|' ORDER BY t.k) AS names FROM n WHERE t IS NOT NULL GROUP BY 1, 2")
def tech_by_category(spark, d):
    rows = spark.createDataFrame(TECH_PAGES, "id long, html string").union(table(spark, d, "pages").select(F.col("page_id") + 100, "html"))
    low = rows.select("id", F.lower("html").alias("low"))
    # The outer form, as the inner one is given a filter that searches each page once more.
    found = low.select("id", F.explode_outer(technology.by_category(technology.detected(F.col("low"), lowered=True))).alias("category", "n")).filter("category is not null")
    return found.select("id", "category", joined(F.col("n")).alias("names"))


HEADERS = [(1, []), (2, ["content-security-policy", "X-Frame-Options", "referrer-policy"]), (3, list(fixed.SECURITY_HEADERS)), (4, ["Server", "X-XSS-Protection"])]


@query(f"""WITH h AS (SELECT unnest({literal([h.lower() for h in fixed.SECURITY_HEADERS])}) AS name), t AS (SELECT id, list_transform(names::VARCHAR[], lambda x: lower(x)) AS names FROM {values(HEADERS, 'id, names')})
           SELECT id, round(count(*) FILTER (list_contains(names, name)) / 9 * 100)::INTEGER AS score, count(*) FILTER (name IN ('strict-transport-security', 'content-security-policy') AND NOT list_contains(names, name))::INTEGER AS critical_missing
           FROM t, h GROUP BY 1""")
def security_score(spark, d):
    rows = spark.createDataFrame(HEADERS, "id long, names array<string>")
    headers = F.map_from_arrays("names", F.transform("names", lambda n: F.lit("x")))
    return rows.select("id", evidence.security_score(headers).alias("score"), F.size(evidence.missing_headers(headers, True)).alias("critical_missing"))


URLS = [(-1, "www.Shop.nl"), (-2, "http://www.a.nl:8080/x"), (-3, "winkel.nl/pad?x=1"), (-4, "  https://b.nl/  ")]
ALL_URLS = f"(SELECT id, url FROM {values(URLS, 'id, url')} UNION ALL SELECT page_id, url FROM pages)"


def all_urls(spark, d):
    return spark.createDataFrame(URLS, "id long, url string").union(table(spark, d, "pages").select("page_id", "url"))


SQL_AUTHORITY = "regexp_extract(CASE WHEN regexp_matches(url, '^https?://') THEN url ELSE 'https://' || url END, '^https?://([^/?#]*)', 1)"


@query(f"SELECT id, regexp_replace({SQL_AUTHORITY}, '^www\\.', '') AS domain FROM {ALL_URLS}")
def domain_extract(spark, d):
    return all_urls(spark, d).select("id", urls.domain(F.col("url")).alias("domain"))


@query(f"SELECT id, CASE WHEN regexp_matches(trim(url), '^https?://') THEN trim(url) ELSE 'https://' || trim(url) END AS url FROM {ALL_URLS}")
def url_normalize(spark, d):
    return all_urls(spark, d).select("id", urls.with_scheme(F.col("url")).alias("url"))


@query(f"""SELECT id, ltrim(lower({SQL_AUTHORITY}), 'w.') AS compat, regexp_replace(regexp_replace(lower({SQL_AUTHORITY}), '^www\\.', ''), ':\\d+$', '') AS host
           FROM (SELECT * FROM {ALL_URLS} UNION ALL SELECT -9, 'www.witgoedvandaag.nl')""")
def host_strip_compat(spark, d):
    rows = all_urls(spark, d).union(spark.createDataFrame([(-9, "www.witgoedvandaag.nl")], "id long, url string"))
    return rows.select("id", urls.host_compat(F.col("url")).alias("compat"), urls.host(F.col("url")).alias("host"))


CANONICAL = [
    ("https://WWW.Shop.nl/pad/?utm_source=x&a=1#top", "https://shop.nl/pad?a=1"), ("http://shop.nl/", "http://shop.nl/"), ("http://shop.nl", "http://shop.nl"),
    ("https://shop.nl/a/?fbclid=1", "https://shop.nl/a"), ("https://shop.nl/a?b=2&c=3&GCLID=4", "https://shop.nl/a?b=2&c=3"), ("https://shop.nl/a?leeg=", "https://shop.nl/a"),
]


@query(f"SELECT url, wanted AS canonical FROM {values(CANONICAL, 'url, wanted')}")
def crawl_canonical(spark, d):
    return spark.createDataFrame(CANONICAL, "url string, wanted string").select("url", urls.canonical(F.col("url")).alias("canonical"))


SQL_HOST = f"regexp_replace(regexp_replace(lower({SQL_AUTHORITY}), '^www\\.', ''), ':\\d+$', '')"


@query(f"SELECT id, {SQL_HOST} = 'example.com' OR ends_with({SQL_HOST}, '.example.com') AS same FROM {ALL_URLS}")
def same_site(spark, d):
    return all_urls(spark, d).select("id", urls.same_site(F.col("url"), F.lit("example.com")).alias("same"))


PATHS = [(-11, "https://a.nl/x.PDF"), (-12, "https://a.nl/x.pdf?y"), (-13, "https://a.nl/pdf"), (-14, "https://a.nl/contact"), (-15, "https://a.nl/Privacybeleid/x"), (-16, "https://a.nl/retourneren"), (-17, "https://a.nl/tc/")]
ALL_PATHS = f"(SELECT id, url, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]*([^?#]*)', 1)) AS p FROM (SELECT * FROM {values(PATHS, 'id, url')} UNION ALL SELECT page_id, url FROM pages))"


def all_paths(spark, d):
    return spark.createDataFrame(PATHS, "id long, url string").union(table(spark, d, "pages").select("page_id", "url"))


@query(f"SELECT id, NOT regexp_matches(p, '\\.({'|'.join(fixed.SKIPPED_EXTENSIONS)})$') AS scrapeable FROM {ALL_PATHS}")
def scrapeable(spark, d):
    return all_paths(spark, d).select("id", urls.scrapeable(F.col("url")).alias("scrapeable"))


PRODUCTS = [(k, u) for k, u in enumerate([
    "https://a.nl/products/x", "https://a.nl/collections/c/p", "https://a.nl/shop/jas-1234", "https://a.nl/?id=5", "https://a.nl/artikele/x", "https://a.nl/contact", "https://a.nl/artikelen/x", "https://a.nl",
])]


@query(f"""SELECT id, regexp_matches('/' || CASE WHEN contains(url, '/') THEN regexp_extract(regexp_replace(url, '^[^:]*://', ''), '/(.*)$', 1) ELSE '' END, '(?i){"|".join(fixed.PRODUCT_URLS)}') AS product
           FROM (SELECT * FROM {values(PRODUCTS, 'id, url')} UNION ALL SELECT page_id + 100, url FROM pages)""")
def product_url(spark, d):
    rows = spark.createDataFrame(PRODUCTS, "id long, url string").union(table(spark, d, "pages").select(F.col("page_id") + 100, "url"))
    return rows.select("id", urls.product_page(F.col("url")).alias("product"))


@query("SELECT id, " + ", ".join("(" + " OR ".join(f"contains(p, '{x}')" for x in words) + f") AS is_{kind}" for kind, words in fixed.PAGE_TYPES.items()) + f" FROM {ALL_PATHS}")
def page_type(spark, d):
    return all_paths(spark, d).select("id", *[urls.page_type(F.col("url"), k).alias(f"is_{k}") for k in fixed.PAGE_TYPES])


SOCIAL = [("https://www.facebook.com/a", "facebook"), ("https://m.facebook.com/a", "facebook"), ("https://x.com/a", "twitter"), ("https://notx.com/a", None), ("https://nl.trustpilot.com/review/a", "trustpilot"), ("https://shop.nl", None)]


@query(f"SELECT url, wanted AS platform FROM {values(SOCIAL, 'url, wanted')}")
def social_platform(spark, d):
    return spark.createDataFrame(SOCIAL, "url string, wanted string").select("url", urls.social_platform(F.col("url")).alias("platform"))


def page_links(spark, d):
    """The URL of each page and all links in it, and the literal cases."""
    read = table(spark, d, "pages").select("page_id", "url", html_functions.parse_html(F.col("url"), F.col("html"), "links").alias("p"))
    found = read.select("page_id", F.explode(F.concat(F.array("url"), F.col("p.links"))).alias("url"))
    return found.union(spark.createDataFrame([(-1, c[0]) for c in (*CANONICAL, *SOCIAL)], "page_id long, url string"))


@query()
def canonical_of_links(spark, d):
    return page_links(spark, d).select("page_id", "url", urls.canonical(F.col("url")).alias("canonical"))


@query()
def social_of_links(spark, d):
    return page_links(spark, d).select("page_id", "url", urls.social_platform(F.col("url")).alias("platform"))


ADDRESSES = [("10.1.2.3", True), ("172.31.0.1", True), ("172.32.0.1", False), ("8.8.8.8", False), ("127.0.0.1", True), ("::1", True), ("fd00::1", True), ("2001:db8::1", False), ("geen ip", False), ("192.168.9.9", True), ("999.1.1.1", False)]


@query(f"SELECT ip, wanted AS private FROM {values(ADDRESSES, 'ip, wanted')}")
def private_network(spark, d):
    return spark.createDataFrame(ADDRESSES, "ip string, wanted boolean").select("ip", urls.private_address(F.col("ip")).alias("private"))


# --- entities


SQL_EMAILS = f"""list_filter(list_transform(regexp_extract_all(text, '{fixed.EMAIL}'), lambda x: trim(lower(x), '.')), lambda x: NOT regexp_matches(x, '{fixed.EMAIL_ASSETS}'))"""


@query(f"SELECT doc_id, {sql_set(SQL_EMAILS)} AS emails FROM documents")
def emails(spark, d):
    return table(spark, d, "documents").select("doc_id", joined(text.emails(F.col("text"))).alias("emails"))


@query(f"WITH f AS (SELECT DISTINCT source, unnest({SQL_EMAILS}) AS email, doc_id FROM documents) SELECT source, email, count(*) AS pages, min(doc_id) AS first_page FROM f GROUP BY 1, 2")
def emails_by_source(spark, d):
    rows = table(spark, d, "documents").select("source", "doc_id", F.explode(text.emails(F.col("text"))).alias("email")).distinct()
    return rows.groupBy("source", "email").agg(F.count("*").alias("pages"), F.min("doc_id").alias("first_page"))


ENTITY_TEXTS = [
    (-1, "Bel 06-12345678 of +31 6 12345678"), (-2, "KvK-nummer: 12345678, btw nl123456789b01"), (-3, "KvK nr. 01234567 CoC #87654321"), (-4, "Kamer van Koophandel te Utrecht onder 23456789"),
    (-5, "NL91 ABNA 0417 1643 00 en GB29 NWBK 6016 1331 9268 19"), (-6, "DE89 3704 0044 0532 0130 00"), (-7, "Dorpsstraat 12, 1234 AB Utrecht"), (-8, "Kerkweg 5"), (-9, "nu € 0,99 was €12,50"), (-10, "€ 3,00"), (-11, "kvk 123456789"),
    (-12, "BTW-nummer: NL123456789B01 xNL123456789B01"),
]
ENTITIES = f"(SELECT * FROM {values(ENTITY_TEXTS, 'id, text')} UNION ALL SELECT doc_id, text FROM documents)"


def entity_texts(spark, d):
    return spark.createDataFrame(ENTITY_TEXTS, "id long, text string").union(table(spark, d, "documents").select("doc_id", "text"))


def _sql_all(patterns: list[str], group: int = 1) -> str:
    return "list_concat(" + ", ".join("regexp_extract_all(text, '{}', {})".format(p.replace("'", "''"), group) for p in [*patterns, "($^x)"]) + ")"


@query()
def phones(spark, d):
    return entity_texts(spark, d).select("id", joined(text.phones(F.col("text"))).alias("phones"))


@query(f"SELECT id, {sql_set(f'list_filter({_sql_all(fixed.KVK_NUMBERS)}, lambda x: NOT starts_with(x, $$0$$))')} AS kvk FROM {ENTITIES}")
def kvk(spark, d):
    return entity_texts(spark, d).select("id", joined(text.kvk_numbers(F.col("text"))).alias("kvk"))


@query(f"SELECT id, {sql_set(f'list_transform({_sql_all(fixed.VAT_NUMBERS)}, lambda x: upper(x))')} AS btw FROM {ENTITIES}")
def btw(spark, d):
    return entity_texts(spark, d).select("id", joined(text.vat_numbers(F.col("text"))).alias("btw"))


@query(f"SELECT id, {sql_set(f'list_transform({_sql_all([fixed.IBAN], 0)}, lambda x: replace(x, $$ $$, $$$$))')} AS iban FROM {ENTITIES}")
def iban(spark, d):
    return entity_texts(spark, d).select("id", joined(text.ibans(F.col("text"))).alias("iban"))


ADDRESS_CASES = [("Dorpsstraat 12, 1234 AB Utrecht", "Dorpsstraat 12 1234 AB Utrecht|Dorpsstraat 12, 1234 AB Utrecht"), ("Kerkweg 5", ""), ("niets", "")]


@query(f"SELECT text, wanted AS addresses FROM {values(ADDRESS_CASES, 'text, wanted')}")
def addresses(spark, d):
    return spark.createDataFrame(ADDRESS_CASES, "text string, wanted string").select("text", joined(text.addresses(F.col("text"))).alias("addresses"))


@query()
def addresses_of_documents(spark, d):
    return entity_texts(spark, d).select("id", joined(text.addresses(F.col("text"))).alias("addresses"))


LONGEST = [(1, ["Dorpsstraat 1", "Dorpsstraat 1 1234 AB", "Kerkweg 22"]), (2, ["a"]), (3, ["ab", "b", "abc"])]


@query(f"SELECT id, array_to_string(list_sort(list_filter(items::VARCHAR[], lambda x: len(list_filter(items::VARCHAR[], lambda y: y <> x AND contains(y, x))) = 0)), '|') AS kept FROM {values(LONGEST, 'id, items')}")
def substring_maximal(spark, d):
    return spark.createDataFrame(LONGEST, "id long, items array<string>").select("id", joined(F.array_sort(text.longest_only(F.col("items")))).alias("kept"))


@query(f"""SELECT id, len(p)::INTEGER AS prices, coalesce(list_min(list_filter(p, lambda x: x > 0)) < 3, false) AS suspicious
           FROM (SELECT id, list_transform(regexp_extract_all(text, '{fixed.PRICE}', 1), lambda x: replace(x, ',', '.')::DOUBLE) AS p FROM {ENTITIES})""")
def prices_suspicious(spark, d):
    return entity_texts(spark, d).select("id", F.size(text.prices(F.col("text"))).alias("prices"), text.suspicious_price(F.col("text")).alias("suspicious"))


KEYWORD_TEXTS = [(-1, "Wij zijn BINNENKORT GEOPEND"), (-2, "site is down, be back soon"), (-3, "Levertijd: 2 werkdagen"), (-4, "pre-order nu"), (-5, "app via WhatsApp"), (-6, "bel wa.me/316")]


def _sql_words(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(text), {literal(w)})" for w in dict.fromkeys(words)) + ")"


KEYWORDS = f"(SELECT * FROM {values(KEYWORD_TEXTS, 'id, text')} UNION ALL SELECT doc_id, text FROM documents)"


@query(f"SELECT id, {_sql_words(fixed.OPENING_SOON)} AS opening_soon, {_sql_words(fixed.MAINTENANCE)} AS maintenance, {_sql_words(fixed.DELIVERY_TIME)} AS delivery_time, {_sql_words(fixed.PRE_ORDER)} AS pre_order FROM {KEYWORDS}")
def keyword_flags(spark, d):
    rows = spark.createDataFrame(KEYWORD_TEXTS, "id long, text string").union(table(spark, d, "documents").select("doc_id", "text"))
    c = F.col("low")
    flags = {"opening_soon": text.opening_soon(c, True), "maintenance": text.maintenance(c, lowered=True), "delivery_time": text.delivery_time(c, True), "pre_order": text.pre_order(c, True)}
    return rows.select("id", F.lower("text").alias("low")).select("id", *[v.alias(k) for k, v in flags.items()])


@query(f"SELECT id, {_sql_words(fixed.WHATSAPP)} AS whatsapp FROM (SELECT * FROM {values(KEYWORD_TEXTS, 'id, text')} UNION ALL SELECT page_id, html FROM pages)")
def whatsapp_flag(spark, d):
    rows = spark.createDataFrame(KEYWORD_TEXTS, "id long, text string").union(table(spark, d, "pages").select("page_id", "html"))
    return rows.select("id", text.whatsapp(F.col("text")).alias("whatsapp"))


LANGUAGE_PAGES = [(-1, '<html lang="nl-NL"><link rel="alternate" hreflang="en" href="/en"><link rel="alternate" hreflang="x-default">'), (-2, "<html><body>"), (-3, "<HTML lang='de'><link hreflang=\"de-AT\"><link hreflang=\"fr\">")]
SQL_LANGUAGES = r"""list_concat([regexp_extract(html, '(?is)<html\b[^>]*?\blang\s*=\s*["'']?([a-zA-Z\-]+)', 1)], regexp_extract_all(html, '(?is)<link\b[^>]*?\bhreflang\s*=\s*["'']?([a-zA-Z\-]+)', 1))"""


@query(f"""SELECT id, {sql_set(f"list_filter(list_transform({SQL_LANGUAGES}, lambda x: lower(split_part(x, '-', 1))), lambda x: len(x) = 2)")} AS languages
           FROM (SELECT * FROM {values(LANGUAGE_PAGES, 'id, html')} UNION ALL SELECT page_id, html FROM pages)""")
def languages(spark, d):
    rows = spark.createDataFrame(LANGUAGE_PAGES, "id long, html string").union(table(spark, d, "pages").select("page_id", "html"))
    return rows.select("id", joined(F.array_sort(text.languages(F.col("html")))).alias("languages"))


@query("SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title FROM pages")
def page_title(spark, d):
    return table(spark, d, "pages").select("page_id", text.page_title(F.col("html")).alias("title"))


_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")]


def _sql_text(html: str) -> str:
    out = f"regexp_replace(regexp_replace({html}, '(?is)<(script|style|noscript)\\b.*?</(script|style|noscript)\\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
    for a, b in _ENTITIES:
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, length({_sql_text('html')}) AS n FROM pages")
def visible_text_len(spark, d):
    return table(spark, d, "pages").select("page_id", F.length(text.visible_text(F.col("html"))).cast("long").alias("n"))


@query("SELECT page_id, sha256(html) AS hash FROM pages")
def html_hash(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("hash"))


@query()
def html_parsed(spark, d):
    parsed = table(spark, d, "pages").select("page_id", html_functions.parse_html(F.col("url"), F.col("html")).alias("p"))
    return parsed.select("page_id", "p.title", F.length("p.text").alias("text_chars"), F.size("p.links").alias("links"), F.size("p.metas").alias("metas"), joined(F.col("p.langs")).alias("langs"))


# --- crawls


def crawled(spark, d):
    """Documents as the pages of crawls, one crawl for each source."""
    c = F.col("text")
    return table(spark, d, "documents").select(
        F.col("source").alias("shop_id"), F.col("doc_id").alias("page_no"), text.emails(c).alias("emails"), text.delivery_time(c).alias("delivery"), F.contains(F.lower(c), F.lit("apache")).alias("licensed"),
        F.when(F.col("n_chars") < 100, "short").alias("error"), "lang", "n_chars",
    )


@query(f"""SELECT source AS shop_id, {sql_set(f'flatten(list({SQL_EMAILS}))')} AS emails, bool_or({_sql_words(fixed.DELIVERY_TIME)}) AS delivery, bool_or(contains(lower(text), 'apache')) AS licensed,
           count(*) FILTER (n_chars >= 100) AS pages_crawled, count(*) FILTER (n_chars < 100) AS pages_failed FROM documents GROUP BY 1""")
def crawl_aggregate(spark, d):
    out = crawl.crawl_aggregate(crawled(spark, d), "shop_id", ["emails"], ["delivery", "licensed"])
    return out.withColumn("emails", joined(F.col("emails")))


@query(f"""WITH v AS (SELECT source AS shop_id, kind, unnest(found) AS value FROM (SELECT source, unnest(['emails', 'iban', 'btw', 'kvk']) AS kind, unnest([{SQL_EMAILS}, list_transform({_sql_all([fixed.IBAN], 0)}, lambda x: replace(x, ' ', '')),
              list_transform({_sql_all(fixed.VAT_NUMBERS)}, lambda x: upper(x)), list_filter({_sql_all(fixed.KVK_NUMBERS)}, lambda x: NOT starts_with(x, '0'))]) AS found FROM documents))
           SELECT s.shop_id, k.kind, coalesce(string_agg(DISTINCT value, '|' ORDER BY value), '') AS found FROM (SELECT DISTINCT source AS shop_id FROM documents) s
           CROSS JOIN (SELECT unnest(['emails', 'iban', 'btw', 'kvk']) AS kind) k LEFT JOIN v ON v.shop_id = s.shop_id AND v.kind = k.kind GROUP BY 1, 2""")
def crawl_entity_sets(spark, d):
    """All sets of a crawl at once, in one pass over its pages."""
    c = F.col("text")
    sets = {"emails": text.emails(c), "iban": text.ibans(c), "btw": text.vat_numbers(c), "kvk": text.kvk_numbers(c)}
    pages = table(spark, d, "documents").select(F.col("source").alias("shop_id"), *[v.alias(k) for k, v in sets.items()], F.lit(None).cast("string").alias("error"))
    out = crawl.crawl_aggregate(pages, "shop_id", list(sets), [])
    return out.select("shop_id", F.explode(F.create_map(*[x for k in sets for x in (F.lit(k), joined(F.col(k)))])).alias("kind", "found"))


@query("SELECT source AS shop_id, 'page-' || doc_id AS url, 'short' AS error FROM documents WHERE n_chars < 100")
def crawl_errors(spark, d):
    return crawl.crawl_errors(crawled(spark, d).withColumn("url", F.concat(F.lit("page-"), "page_no")), "shop_id")


@query("""WITH f AS (SELECT source AS shop_id, lang, min(doc_id) AS page_no FROM documents GROUP BY 1, 2), n AS (SELECT shop_id, page_no, count(*) AS fresh FROM f GROUP BY 1, 2)
          SELECT source AS shop_id, doc_id AS page_no, sum(coalesce(fresh, 0)) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS "distinct" FROM documents LEFT JOIN n ON source = shop_id AND doc_id = page_no""")
def running_distinct(spark, d):
    pages = table(spark, d, "documents").select(F.col("source").alias("shop_id"), F.col("doc_id").alias("page_no"), "lang")
    return crawl.running_distinct(pages, "shop_id", "page_no", "lang")


@query("""SELECT source AS shop_id, string_agg(lang, '|' ORDER BY first, lang) AS langs FROM (SELECT source, lang, min(doc_id) AS first FROM documents GROUP BY 1, 2) GROUP BY 1""")
def crawl_languages(spark, d):
    return crawl.first_seen(crawled(spark, d), "shop_id", "page_no", "lang").select("shop_id", joined(F.col("lang")).alias("langs"))


@query("SELECT source AS shop_id, lang, arg_max(doc_id, doc_id) AS page FROM documents GROUP BY 1, 2")
def crawl_last_wins(spark, d):
    out = crawl.last_wins(crawled(spark, d).withColumn("page", F.col("page_no")), "shop_id", "page_no", "lang", "page")
    return out.select("shop_id", F.explode("page").alias("lang", "page"))


@query(f"""WITH f AS (SELECT DISTINCT source AS shop_id, unnest({SQL_EMAILS}) AS value, 'page-' || doc_id AS url FROM documents)
           SELECT shop_id, value, string_agg(url, '|' ORDER BY url) AS urls FROM f GROUP BY 1, 2""")
def provenance_index(spark, d):
    found = crawled(spark, d).select("shop_id", F.lit("email").alias("type"), F.explode("emails").alias("value"), F.concat(F.lit("page-"), "page_no").alias("url"))
    return crawl.provenance(found).select("shop_id", "value", joined(F.col("urls")).alias("urls"))


@query(f"""WITH f AS (SELECT DISTINCT source AS shop_id, unnest({SQL_EMAILS}) AS value, 'page-' || doc_id AS url FROM documents),
                h AS (SELECT DISTINCT source AS shop_id, 'home' AS url, source || '@home' AS value FROM documents WHERE source NOT IN (SELECT shop_id FROM f))
           SELECT shop_id, url, string_agg(value, '|' ORDER BY value) AS vals FROM (SELECT shop_id, url, value FROM f UNION ALL SELECT shop_id, url, value FROM h) GROUP BY 1, 2""")
def evidence_pages(spark, d):
    rows = crawled(spark, d)
    found = rows.select("shop_id", F.lit("email").alias("type"), F.explode("emails").alias("value"), F.concat(F.lit("page-"), "page_no").alias("url"))
    each = table(spark, d, "documents").select(F.col("source").alias("shop_id")).distinct()
    pages = crawl.evidence_pages(crawl.provenance(found), each.withColumn("url", F.lit("home")), each.select("shop_id", F.lit("email").alias("type"), F.concat("shop_id", F.lit("@home")).alias("value")))
    return pages.select("shop_id", "url", joined(F.transform("findings", lambda f: f["value"])).alias("vals"))


@query("""SELECT doc_id, count(*) OVER w AS done, sum(n_chars) OVER w::BIGINT AS chars FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)""")
def running_progress(spark, d):
    return crawl.running_progress(crawled(spark, d).select("shop_id", "page_no", "n_chars"), "shop_id", ["page_no"], {"chars": "n_chars"}).select(F.col("page_no").alias("doc_id"), "done", "chars")


LINKS = [("https://s.nl/", x) for x in ("https://s.nl/contact", "https://s.nl/a", "https://s.nl/product/1/", "https://ander.nl/x", "https://s.nl/b.pdf")] + [("https://s.nl/a", "https://s.nl/b"), ("https://s.nl/a", "https://s.nl/"), ("https://s.nl/b", "https://www.s.nl/a#x")]


@query()
def crawl_frontier(spark, d):
    """A crawl of each site among the pages, from its first URL, along the links that the pages hold and one from each page to the
    next of its site; pages without a body fail."""
    pages = table(spark, d, "pages").select("url", "html", urls.host(F.col("url")).alias("site"))
    held = pages.select(F.col("url").alias("src"), F.explode(html_functions.parse_html(F.col("url"), F.col("html"), "links")["links"]).alias("dst"))
    after = Window.partitionBy("site").orderBy("url")
    chain = pages.select(F.col("url").alias("src"), F.lead("url").over(after).alias("dst")).filter("dst is not null")
    start = pages.groupBy("site").agg(F.min("url").alias("url")).union(spark.createDataFrame([("s.nl", "https://s.nl/")], "site string, url string"))
    links = held.union(chain).union(spark.createDataFrame(LINKS, "src string, dst string"))
    return crawl.crawl_order(start, links, pages.filter("coalesce(html, '') = ''").select("url"))


# --- sets


@query("SELECT user_id AS id FROM events UNION SELECT o_custkey FROM orders")
def entity_union(spark, d):
    return checks(spark, d).select(F.col("shop_id").alias("id")).union(scans(spark, d).select("shop_id")).distinct()


@query("SELECT o_custkey AS id FROM orders EXCEPT SELECT user_id FROM events")
def entity_except(spark, d):
    return scans(spark, d).select(F.col("shop_id").alias("id")).distinct().join(checks(spark, d).select(F.col("shop_id").alias("id")), "id", "left_anti")


# --- network evidence


WHOIS = [
    (1, "Domain name: x.nl\nRegistrar:   Mijn Registrar B.V. \nCreation Date: 2020-03-04T10:00:00Z\nRegistry Expiry Date: 2026-03-04\ncountry: NL"),
    (2, "Sponsoring Registrar: Tweede\nregistered: 2019-01-02\npaid-till: 2027-01-01\nRegistrant Country: DE\nCountry: FR"),
    (3, "niets hiervan"),
]


def _sql_whois(field: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(trim(regexp_extract(raw, '(?im)^{label}\\s*:\\s*(.+)$', 1)), '')" for label in fixed.WHOIS_LABELS[field]) + ")"


#: A WHOIS answer for each shop, in the words of both engines.
WHOIS_OF_SHOP = """concat('Domain Name: ', c_name, chr(10), CASE c_custkey % 3 WHEN 0 THEN 'Registrar: ' WHEN 1 THEN 'sponsoring registrar:   ' ELSE 'Houder: ' END, c_mktsegment, chr(10),
                   CASE c_custkey % 4 WHEN 0 THEN 'Creation Date: 2019-0' WHEN 1 THEN 'registered: 2020-0' WHEN 2 THEN 'Created On:  2021-0' ELSE 'x: ' END, c_custkey % 9 + 1, '-11', chr(10),
                   CASE WHEN c_custkey % 5 = 0 THEN 'paid-till: 2027-01-01' ELSE 'Registry Expiry Date:' END, chr(10), CASE WHEN c_custkey % 2 = 0 THEN 'Country: ' ELSE 'Registrant Country: ' END, c_nationkey)"""


@query("SELECT id, " + ", ".join(f"{_sql_whois(f)} AS {f}" for f in fixed.WHOIS_LABELS) + f" FROM (SELECT * FROM {values(WHOIS, 'id, raw')} UNION ALL SELECT c_custkey + 100, {WHOIS_OF_SHOP} FROM customer)")
def whois_parse(spark, d):
    rows = spark.createDataFrame(WHOIS, "id long, raw string").union(table(spark, d, "customer").selectExpr("c_custkey + 100", WHOIS_OF_SHOP))
    return rows.select("id", *[evidence.whois_field(F.col("raw"), f).alias(f) for f in fixed.WHOIS_LABELS])


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate::DATE END AS day FROM orders""")
def lenient_dates(spark, d):
    """Dates with anything after them, and texts that hold none."""
    text_ = "CASE o_orderkey % 3 WHEN 0 THEN concat('geen ', o_orderkey) WHEN 1 THEN concat(cast(cast(o_orderdate AS date) AS string), 'T10:00:00Z') ELSE cast(cast(o_orderdate AS date) AS string) END"
    return table(spark, d, "orders").selectExpr("o_orderkey AS id", f"{text_} AS t").select("id", evidence.lenient_date(F.col("t")).alias("day"))


@query(f"SELECT id, CASE WHEN response_ms >= 70 THEN 'good' WHEN response_ms >= 40 THEN 'fair' ELSE 'poor' END AS class FROM {CHECKS} WHERE response_ms IS NOT NULL")
def security_classes(spark, d):
    return checks(spark, d).filter("response_ms is not null").select("id", evidence.security_class(F.col("response_ms")).alias("class"))


@query("""SELECT p_partkey AS id, array_to_string(list_filter([p_name, lower(p_brand), p_type], lambda x: NOT contains(lower(x), lower(p_brand))), '|') AS others FROM part""")
def others_without_own(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), joined(technology.without_own(F.array("p_name", F.lower("p_brand"), "p_type"), F.col("p_brand"))).alias("others"))


@query("""SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '2000-01-01')::INTEGER AS age_days,
          CASE WHEN date_diff('day', o_orderdate::DATE, DATE '2000-01-01') < 365 THEN 'young' WHEN date_diff('day', o_orderdate::DATE, DATE '2000-01-01') < 730 THEN 'recent' ELSE 'settled' END AS age FROM orders""")
def domain_age(spark, d):
    days = evidence.age_days(F.to_date("o_orderdate"), F.lit("2000-01-01").cast("date"))
    return table(spark, d, "orders").select("o_orderkey", days.alias("age_days"), evidence.age_class(days).alias("age"))


CERTIFICATES = [("Jun  1 12:00:00 2025 GMT", "2025-06-01 12:00:00"), ("Dec 31 23:59:59 2024 GMT", "2024-12-31 23:59:59"), ("20250601120000Z", "2025-06-01 12:00:00"), ("onleesbaar", None)]


@query(f"SELECT t, wanted::TIMESTAMP AS at, date_diff('day', DATE '2025-01-01', wanted::DATE)::INTEGER AS days_left FROM {values(CERTIFICATES, 't, wanted')}")
def cert_dates(spark, d):
    at = evidence.certificate_time(F.col("t"))
    return spark.createDataFrame(CERTIFICATES, "t string, wanted string").select("t", at.alias("at"), F.datediff(F.to_date(at), F.lit("2025-01-01").cast("date")).alias("days_left"))


PRIVACY = [(1, "REDACTED for privacy", None, None, True), (2, None, None, "Straat 1", None), (3, "Bedrijf", "Jan", None, False), (4, "Bedrijf", None, "Straat 1", False), (5, None, "", None, None)]


OWNERS = """o_orderkey + 100 AS id, CASE o_orderkey % 5 WHEN 0 THEN 'REDACTED ' || o_orderpriority WHEN 1 THEN NULL ELSE o_orderpriority END AS org,
             CASE o_custkey % 4 WHEN 0 THEN 'WhoisGuard' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE o_orderstatus END AS name, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'Weg ' || o_orderkey END AS address"""


@query(f"""SELECT id, CASE WHEN regexp_matches(lower(concat_ws(chr(10), org, name)), '{"|".join(fixed.PRIVACY_WORDS)}') THEN true
           WHEN (coalesce(org, '') = '')::INTEGER + (coalesce(name, '') = '')::INTEGER + (coalesce(address, '') = '')::INTEGER >= 2 THEN NULL ELSE false END AS protected
           FROM (SELECT id, org, name, address FROM {values(PRIVACY, 'id, org, name, address, wanted')} UNION ALL SELECT {OWNERS} FROM orders)""")
def privacy_flag(spark, d):
    rows = spark.createDataFrame([p[:4] for p in PRIVACY], "id long, org string, name string, address string").union(table(spark, d, "orders").selectExpr(*[x.strip() for x in OWNERS.replace("\n", " ").split(", ") if x.strip()]))
    none = F.lit(None).cast("string")
    return rows.select("id", evidence.privacy_protected(F.col("org"), F.col("name"), none, none, F.col("address")).alias("protected"))


DNS = [("a.nl", "A", "1.2.3.4"), ("a.nl", "TXT", "v=spf1 -all"), ("a.nl", "MX", "mx.a.nl"), ("a.nl", "MX", "b.a.nl"), ("b.nl", "A", "5.6.7.8"), ("b.nl", "DMARC", "v=DMARC1; p=none")]


@query(f"""SELECT domain, coalesce(string_agg(DISTINCT value, '|' ORDER BY value) FILTER (rtype = 'MX'), '') AS mx, bool_or(rtype = 'TXT' AND starts_with(value, 'v=spf1')) AS has_spf,
           bool_or(rtype = 'DMARC' AND starts_with(value, 'v=DMARC1')) AS has_dmarc, bool_or(rtype = 'MX') AS has_mx FROM {values(DNS, 'domain, rtype, value')} GROUP BY 1""")
def dns_summary(spark, d):
    out = evidence.dns_summary(spark.createDataFrame(DNS, "domain string, rtype string, value string"))
    return out.select("domain", joined(F.col("mx_records")).alias("mx"), "has_spf", "has_dmarc", "has_mx")


MATCHES = [
    (1, "bol.com", ["bol.com b.v."], "strong", 100), (2, "fiets-winkel.nl", ["Fietswinkel"], "strong", 100), (3, "fietswinkel-jansen.nl", ["Jansen Tweewielers"], "partial", 50),
    (4, "grotefietsen.nl", ["De Grote Fietsen Zaak Nederland"], "partial", 50), (5, "abc.nl", ["Xyz Holding"], "none", 0), (6, "abc.nl", [], "unknown", 0), (7, "abc.nl", ["-"], "none", 0),
]


@query(f"SELECT id, match, score FROM {values([(m[0], m[3], m[4]) for m in MATCHES], 'id, match, score')}")
def registry_match(spark, d):
    rows = spark.createDataFrame(MATCHES, "id long, domain string, names array<string>, match string, score int")
    found = rows.select("id", evidence.name_match(F.col("domain"), F.col("names")).alias("m"))
    return found.select("id", "m.match", "m.score")


LOOKUPS = [(1, 0, "11111111", True, 50, "partial"), (1, 1, "22222222", None, 100, "strong"), (1, 2, "33333333", False, 100, "later"), (2, 0, None, None, 0, "none")]


@query(f"""SELECT shop_id, count(number) AS total_found, count(*) FILTER (number IS NOT NULL AND coalesce(active, true)) AS total_active, arg_max(match, score * 100 - place) AS best_match
           FROM {values(LOOKUPS, 'shop_id, place, number, active, score, match')} GROUP BY 1""")
def registry_totals(spark, d):
    rows = spark.createDataFrame(LOOKUPS, "shop_id long, place int, number string, is_active boolean, score int, match string")
    return evidence.register_totals(rows, "shop_id")


MARKS = [(1, True, True), (1, True, False), (1, False, True), (1, False, False), (2, True, None), (2, None, True)]


@query(f"""SELECT shop_id, count(*) AS total_checked, count(*) FILTER (v) AS total_verified, count(*) FILTER (NOT v) AS total_not_found, count(*) FILTER (c AND NOT v) AS claimed_not_verified,
           count(*) FILTER (v AND NOT c) AS verified_not_claimed FROM (SELECT shop_id, coalesce(claimed, false) AS c, coalesce(verified, false) AS v FROM {values(MARKS, 'shop_id, claimed, verified')}
           UNION ALL SELECT user_id + 100, coalesce(value > 40, false), coalesce(CASE WHEN event_type <> 'error' THEN value < 60 END, false) FROM events) GROUP BY 1""")
def trustmark_summary(spark, d):
    results = table(spark, d, "events").selectExpr("user_id + 100", "value > 40", "CASE WHEN event_type <> 'error' THEN value < 60 END")
    return evidence.trustmark_summary(spark.createDataFrame(MARKS, "shop_id long, claimed boolean, verified boolean").union(results), "shop_id")


@query("SELECT user_id AS shop_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS total_hits, bool_or(event_type = 'error') AS flagged FROM events GROUP BY 1")
def scam_totals(spark, d):
    rows = checks(spark, d).select("shop_id", (~F.col("is_online")).cast("int").alias("count"), (~F.col("is_online")).alias("found"))
    return evidence.fraud_totals(rows, "shop_id")


@query(f"""SELECT shop_id, count(*) AS checked, count(*) FILTER (valid) AS valid, count(*) FILTER (NOT valid) AS invalid
           FROM (SELECT shop_id, CASE WHEN response_ms > 90 THEN NULL ELSE response_ms > 5 END AS valid FROM {CHECKS}) GROUP BY 1""")
def address_counts(spark, d):
    rows = checks(spark, d).select("shop_id", F.when(F.col("response_ms") <= 90, F.col("response_ms") > 5).alias("valid"))
    return evidence.address_counts(rows, "shop_id")


LEVELS = [(1, [("x gevaarlijk", ""), ("rustig", "")], "hoog"), (2, [("rustig", ""), ("verdacht", "")], "medium"), (3, [("rustig", "")], "laag"), (4, [], None), (5, [("a", "red"), ("b", "orange")], "medium")]


@query(f"SELECT id, wanted AS level FROM {values([(x[0], x[2]) for x in LEVELS], 'id, wanted')}")
def warning_levels(spark, d):
    rows = spark.createDataFrame(LEVELS, "id long, items array<struct<text:string,classes:string>>, wanted string")
    return rows.select("id", evidence.warning_level(F.col("items")).alias("level"))


SCORES = [(1, "score 9,2 / 10 uit 120 beoordelingen", 9.2, None, 120), (2, '"trustScore": 4.6, "numberOfReviews": "1234"', None, 4.6, 1234), (3, "1.234 reviews", None, None, 1234), (4, "", None, None, None)]


@query(f"SELECT id, a AS of_ten, b AS trust, c AS reviews, CASE WHEN b >= 4.5 THEN 'Uitstekend' END AS rating FROM {values([(x[0], *x[2:]) for x in SCORES], 'id, a, b, c')}")
def review_scores(spark, d):
    rows = spark.createDataFrame(SCORES, "id long, html string, a double, b double, c int")
    h = F.col("html")
    return rows.select("id", evidence.score_of_ten(h).alias("of_ten"), evidence.trust_score(h).alias("trust"), evidence.review_count(h).alias("reviews"), evidence.rating_class(evidence.trust_score(h)).alias("rating"))


@query("SELECT doc_id, len(regexp_extract_all(text, '(?i)the '))::INTEGER AS n FROM documents")
def occurrence_count(spark, d):
    return table(spark, d, "documents").select("doc_id", text.occurrences(F.col("text"), "the ").alias("n"))


IBANS = [(1, "DE89"), (1, "NL91"), (1, "nl20"), (1, "BE68"), (2, "XX12")]


@query(f"""SELECT shop_id, upper(iban[1:2]) AS country, CASE upper(iban[1:2]) WHEN 'DE' THEN 'Duitsland' WHEN 'NL' THEN 'Nederland' WHEN 'BE' THEN 'België' ELSE upper(iban[1:2]) END AS name,
           string_agg(iban, '|' ORDER BY iban) AS ibans, (upper(iban[1:2]) <> 'NL')::INTEGER AS "foreign" FROM {values(IBANS, 'shop_id, iban')} GROUP BY ALL""")
def iban_by_country(spark, d):
    return report.ibans_by_country(spark.createDataFrame(IBANS, "shop_id long, iban string"), "shop_id").withColumn("ibans", joined(F.col("ibans")))


JSON = [(-1, '["a","",null,"b"]', 2), (-2, '"x"', 1), (-3, "12345678", 1), (-4, "0", 0), (-5, "[kapot", 1), (-6, None, 0), (-7, "[]", 0), (-8, "null", 0)]


@query(f"SELECT id, wanted AS n FROM {values([(x[0], x[2]) for x in JSON], 'id, wanted')} UNION ALL SELECT event_id, 1 FROM events")
def json_count(spark, d):
    rows = spark.createDataFrame([x[:2] for x in JSON], "id long, j string").union(table(spark, d, "events").select("event_id", "props"))
    return rows.select("id", text.json_count(F.col("j")).alias("n"))


# --- risk


FACT_COLUMNS = "emails array<string>, phones array<string>, addresses array<string>, kvk array<string>, btw array<string>, ibans array<string>, has_contact boolean, has_privacy_page boolean, has_terms_page boolean, has_return_page boolean, kvk_number string, has_ssl boolean, is_expired boolean, domain_age int, total_verified int, claimed_not_verified int, flagged boolean"
_GOOD = (["a@b.nl"], ["0612345678"], ["Weg 1"], ["12345678"], ["NL1"], ["NL91"], True, True, True, True, "12345678", True, None, 800, 1, 0, None)
_NONE = (None,) * 17
FACTS = [(-1, *_NONE), (-2, *_GOOD), (-3, *_GOOD[:5], ["NL91", "DE89"], *_GOOD[6:]), (-4, *_GOOD[:16], True), (-5, *_GOOD[:13], 400, None, 2, False)]
FACT_SCORES = [(-1, -64, 0.0, "critical"), (-2, 115, 95.8, "low"), (-3, 95, 79.2, "low"), (-4, 75, 62.5, "medium"), (-5, 75, 62.5, "medium")]


def shop_facts(spark, d):
    """Facts of shops from the stand-in tables: balance for domain age, scans for pages, checks for the fraud flag."""
    o = scans(spark, d).groupBy("shop_id").agg(F.count("*").alias("n"), F.bool_or(F.col("priority") == "1-URGENT").alias("urgent"), F.max("price").alias("price"))
    e = checks(spark, d).groupBy("shop_id").agg(F.count_if(~F.col("is_online")).alias("errors"))
    rows = shops(spark, d).join(o, F.col("id") == o["shop_id"], "left").drop("shop_id").join(e, F.col("id") == e["shop_id"], "left").drop("shop_id")
    some = lambda c, v: F.when(c, F.array(F.lit(v))).otherwise(F.array().cast("array<string>"))
    n = F.coalesce("n", F.lit(0))
    return rows.select(
        "id", some(n > 5, "e").alias("emails"), some(n > 10, "p").alias("phones"), some(n > 8, "a").alias("addresses"), some(F.col("urgent"), "k").alias("kvk"), some(n > 1, "b").alias("btw"), some(n > 3, "NL1").alias("ibans"),
        F.col("urgent").alias("has_contact"), (n > 12).alias("has_privacy_page"), (n > 13).alias("has_terms_page"), (n > 14).alias("has_return_page"), F.when(F.col("urgent"), "1").alias("kvk_number"),
        (F.col("price") > 100000).alias("has_ssl"), F.lit(None).cast("boolean").alias("is_expired"), F.col("domain_age").cast("int").alias("domain_age"), F.lit(0).alias("total_verified"), (n % 2).cast("int").alias("claimed_not_verified"), (F.col("errors") > 2).alias("flagged"),
    )


RISK_SQL = f"""
    WITH f AS (SELECT s.id, coalesce(o.n, 0) AS n, coalesce(urgent, false) AS urgent, coalesce(price > 100000, false) AS has_ssl, trunc(domain_age)::INTEGER AS age, coalesce(errors > 2, false) AS flagged FROM {SHOPS} s
               LEFT JOIN (SELECT shop_id, count(*) AS n, bool_or(priority = '1-URGENT') AS urgent, max(price) AS price FROM {SCANS} GROUP BY 1) o ON s.id = o.shop_id
               LEFT JOIN (SELECT shop_id, count(*) FILTER (NOT is_online) AS errors FROM {CHECKS} GROUP BY 1) e ON s.id = e.shop_id),
         r AS (SELECT id, (CASE WHEN n > 8 THEN 15 ELSE -15 END + CASE WHEN n > 5 THEN 10 ELSE -10 END + CASE WHEN n > 10 THEN 5 ELSE 0 END + CASE WHEN urgent THEN 15 ELSE -10 END + CASE WHEN urgent THEN 10 ELSE -5 END
                  + CASE WHEN urgent THEN 5 ELSE -5 END + CASE WHEN n > 12 THEN 5 ELSE -3 END + CASE WHEN n > 13 THEN 5 ELSE -3 END + CASE WHEN n > 14 THEN 5 ELSE -3 END + CASE WHEN n > 3 THEN 10 ELSE -5 END
                  + CASE WHEN has_ssl THEN 5 ELSE -10 END + CASE WHEN age >= 365 THEN 5 ELSE -5 END + CASE WHEN age >= 730 THEN 5 ELSE 0 END + CASE WHEN n % 2 = 0 THEN 10 ELSE -20 END + CASE WHEN flagged THEN -40 ELSE 0 END)::INTEGER AS raw FROM f),
         s AS (SELECT id, raw, round(greatest(0, raw) / 120 * 100, 1) AS score FROM r UNION ALL SELECT * EXCLUDE level FROM {values(FACT_SCORES, 'id, raw, score, level')})
    SELECT id, raw, score, CASE WHEN score >= 70 THEN 'low' WHEN score >= 40 THEN 'medium' WHEN score >= 15 THEN 'high' ELSE 'critical' END AS risk_level FROM s"""


@query(RISK_SQL)
def risk_score(spark, d):
    facts = spark.createDataFrame(FACTS, f"id long, {FACT_COLUMNS}").unionByName(shop_facts(spark, d))
    return risk.scored(facts, "id").drop("tips")


TIPS = [(-1, "not_in_scam_db"), (-2, "")]


@query("""SELECT * FROM (VALUES (-1, 'has_address|has_email|has_kvk|has_ssl|kvk_verified|has_contact_page|has_nl_iban|domain_age_1yr|has_privacy|has_terms|has_returns'), (-2, ''), (-3, 'no_foreign_iban'), (-4, 'not_in_scam_db'), (-5, 'no_fake_tm')) AS t(id, rules)""")
def risk_tips(spark, d):
    return risk.scored(spark.createDataFrame(FACTS, f"id long, {FACT_COLUMNS}"), "id").select("id", joined(F.transform("tips", lambda t: t["rule"])).alias("rules"))


@query(f"SELECT * FROM {values([(n, *r[:4]) for n, r in enumerate(fixed.RISK_RULES)], 'rule_no, rule, label, points, malus')}")
def risk_config(spark, d):
    return risk.rules(spark).drop("tip")


# --- scans, reports and small functions


COMPLETE = [(1, ["whois", "ssl"], ["ssl", "whois", "tech"], True, True), (2, ["whois", "ssl"], ["ssl"], False, True), (3, [], [], True, True), (4, ["fout"], [], False, False)]


@query(f"SELECT id, done, known FROM {values([(c[0], c[3], c[4]) for c in COMPLETE], 'id, done, known')}")
def collectors_complete(spark, d):
    rows = spark.createDataFrame(COMPLETE, "id long, requested array<string>, completed array<string>, done boolean, known boolean")
    known = F.array(*[F.lit(c) for c in fixed.COLLECTORS])
    return rows.select("id", (F.size(F.array_except("requested", "completed")) == 0).alias("done"), (F.size(F.array_except("requested", known)) == 0).alias("known"))


SESSIONS = f"""(SELECT shop_id, min(t) AS begun, max(t) AS ended, count(*) AS done FROM (SELECT shop_id, t, sum(fresh) OVER (PARTITION BY shop_id ORDER BY t, id) AS run FROM (
           SELECT shop_id, id, checked_at AS t, CASE WHEN checked_at - lag(checked_at) OVER (PARTITION BY shop_id ORDER BY checked_at, id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM {CHECKS})) GROUP BY shop_id, run)"""


@query(f"""WITH s AS (SELECT shop_id, sum(done)::BIGINT AS done, sum(epoch_us(ended) - epoch_us(begun)) / 1000000 AS elapsed FROM {SESSIONS} GROUP BY 1),
           a AS (SELECT shop_id, round(avg(response_ms), 6) AS avg_ms FROM {CHECKS} GROUP BY 1)
           SELECT shop_id, done, avg_ms, greatest(0, 50 - done) AS pages_left, elapsed, CASE WHEN elapsed > 0 THEN round(elapsed / done * greatest(0, 50 - done), 3) END AS eta FROM s JOIN a USING (shop_id)""")
def batch_eta(spark, d):
    left = streams.time_left(streams.work_sessions(checks(spark, d), "shop_id", "checked_at"), "shop_id", F.lit(50))
    speed = checks(spark, d).groupBy("shop_id").agg(F.round(F.avg("response_ms"), 6).alias("avg_ms"))
    return left.join(speed, "shop_id").select("shop_id", "done", "avg_ms", F.col("left").alias("pages_left"), "elapsed", F.round("eta", 3).alias("eta"))


DURATIONS = [(0, "--:--"), (-5, "--:--"), (None, "--:--"), (61000, "01:01"), (3661000, "1:01:01"), (59999, "00:59")]


@query(f"""SELECT ms, CASE WHEN ms IS NULL OR ms <= 0 THEN '--:--' WHEN ms >= 3600000 THEN printf('%d:%02d:%02d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60) ELSE printf('%02d:%02d', ms // 60000, ms // 1000 % 60) END AS shown
           FROM (SELECT ms::BIGINT AS ms FROM {values(DURATIONS, 'ms, shown')} UNION ALL SELECT event_id * 7919 - 50000 FROM events)""")
def duration_format(spark, d):
    rows = spark.createDataFrame([x[:1] for x in DURATIONS], "ms long").union(table(spark, d, "events").selectExpr("event_id * 7919 - 50000"))
    return rows.select("ms", text.duration(F.col("ms")).alias("shown"))


@query(f"""SELECT e.id, o.status FROM {CHECKS} e ASOF LEFT JOIN (SELECT shop_id, completed_at, arg_max(status, id) AS status FROM {SCANS} GROUP BY 1, 2) o
           ON e.shop_id = o.shop_id AND e.checked_at >= o.completed_at""")
def asof_latest(spark, d):
    return latest.as_of(checks(spark, d).drop("k"), scans(spark, d), "shop_id", "checked_at", "completed_at", "status", "id").select("id", "status")


SECRETS = [("geheim123", "*****m123"), ("abcd", "****"), ("ab", "**"), (None, ""), ("", "")]


@query(f"""SELECT secret, CASE WHEN secret IS NULL THEN '' WHEN length(secret) > 4 THEN repeat('*', length(secret) - 4) || right(secret, 4) ELSE repeat('*', length(secret)) END AS shown
           FROM (SELECT secret FROM {values(SECRETS, 'secret, shown')} UNION ALL SELECT substr(c_name, 1, (c_custkey % 15)::INTEGER) FROM customer)""")
def mask_secret(spark, d):
    rows = spark.createDataFrame([x[:1] for x in SECRETS], "secret string").union(table(spark, d, "customer").selectExpr("substr(c_name, 1, cast(c_custkey % 15 AS int))"))
    return rows.select("secret", text.masked(F.col("secret")).alias("shown"))


@query("SELECT page_id, 'bewijs_' || lpad((page_id + 1)::VARCHAR, greatest(3, length((page_id + 1)::VARCHAR))::INTEGER, '0') || '_' || regexp_replace(regexp_replace(url, '^https?://', ''), '[^a-zA-Z0-9._-]', '_', 'g')[1:70] AS file FROM pages")
def file_prefix(spark, d):
    return table(spark, d, "pages").select("page_id", urls.file_prefix(F.col("url"), F.col("page_id")).alias("file"))


@query(f"""SELECT id, section, ord, label, value FROM (SELECT id, 'Samenvatting' AS section, 0 AS ord, 'Domein' AS label, domain AS value FROM {SHOPS} UNION ALL SELECT id, 'Samenvatting', 1, 'Risico', risk_level FROM {SHOPS}
           UNION ALL SELECT s.id, 'Scans', 2, 'Laatste scan', coalesce(strftime(last_scanned, '%Y-%m-%d %H:%M:%S'), '—') FROM {SHOPS} s LEFT JOIN {LAST} l ON s.id = l.shop_id)""")
def report_rows(spark, d):
    rows = overview.overview(shops(spark, d), scans(spark, d))
    return report.report_rows(rows, "id", [("Samenvatting", [("Domein", "domain"), ("Risico", "risk_level")]), ("Scans", [("Laatste scan", "last_scanned")])])


# --- streams, replayed over the events table


def _stream(spark, d):
    """The events table as a stream of files. A pattern that only the table's own path meets reads it in any file system, be it
    one file or a folder of them."""
    stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")
    e = stream.select(F.col("event_id").alias("id"), F.col("user_id").alias("shop_id"), (F.col("event_type") != "error").alias("is_online"), F.col("value").alias("response_ms"), F.col("ts").alias("checked_at"))
    return e, f"{shared_folder(spark)}/evidentia-stream-{uuid.uuid4().hex}"


@query(f"SELECT shop_id, checked_at, id, is_online, response_ms FROM (SELECT *, row_number() OVER (PARTITION BY shop_id ORDER BY checked_at DESC, id DESC) AS r FROM {CHECKS}) WHERE r = 1")
def stream_status_latest(spark, d):
    stream, folder = _stream(spark, d)
    return streams.replay(spark, streams.latest_status(stream), "complete", folder)


@query(f"SELECT shop_id AS scan_id, max(checked_at) AS ts, count(*) AS updates, arg_max(response_ms, checked_at) AS progress FROM {CHECKS} GROUP BY 1")
def stream_progress(spark, d):
    stream, folder = _stream(spark, d)
    events = stream.select(F.col("shop_id").alias("scan_id"), F.col("checked_at").alias("ts"), F.col("id").alias("seq"), F.col("response_ms").alias("progress"))
    return streams.replay(spark, streams.latest_progress(events), "complete", folder)


@query(f"""SELECT date_trunc('hour', checked_at) AS hour, count(*) AS checks, sum(is_online::INTEGER)::BIGINT AS online FROM {CHECKS} GROUP BY 1
           HAVING date_trunc('hour', max(checked_at)) + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events)""")
def stream_uptime(spark, d):
    """Hours that are over for good: an hour before the newest check, they can change no more."""
    stream, folder = _stream(spark, d)
    return streams.replay(spark, streams.hourly_uptime(stream), "append", folder)


# --- more of the evidence, on literal rows


def wanted(rows: list[tuple], keep: list[int], columns: str) -> str:
    """SQL of literal rows' wanted values: the positions kept, under these names."""
    return f"SELECT * FROM {values([tuple(r[k] for k in keep) for r in rows], columns)}"


SHOPIFY = [(1, '{"shopId": 42, "myshopify_domain":"a.myshopify.com"} Shopify.shop = "a.myshopify.com" "shopId": 42', "42", "a.myshopify.com", "a.myshopify.com"), (2, "niets", "", "", "")]


@query(wanted(SHOPIFY, [0, 2, 3, 4], "id, shop_id, domain, shop"))
def shopify_identity(spark, d):
    rows = spark.createDataFrame(SHOPIFY, "id long, html string, a string, b string, c string").select("id", technology.shopify_identities(F.col("html")).alias("s"))
    return rows.select("id", joined(F.col("s.shop_id")).alias("shop_id"), joined(F.col("s.myshopify_domain")).alias("domain"), joined(F.col("s.shopify_shop")).alias("shop"))


@query()
def shopify_of_pages(spark, d):
    rows = spark.createDataFrame([(-r[0], r[1]) for r in SHOPIFY], "id long, html string").union(table(spark, d, "pages").select("page_id", "html"))
    found = rows.select("id", technology.shopify_identities(F.col("html")).alias("s"))
    return found.select("id", *[joined(F.col(f"s.{k}")).alias(k) for k in fixed.SHOPIFY_IDENTITIES])


LDJSON = [
    (1, ['{"@graph":[{"email":"mailto:A@b.nl","telephone":"06"},{"vatID":"NL1"}]}'], "a@b.nl", "06", "NL1", ""),
    (2, ['[{"address":{"streetAddress":"Weg 1","addressLocality":"Stad"}}]'], "", "", "", "Weg 1, Stad"), (3, ["kapot"], "", "", "", ""), (4, [], "", "", "", ""),
]


@query(wanted(LDJSON, [0, 2, 3, 4, 5], "id, emails, phones, tax_ids, addresses"))
def structured_data(spark, d):
    rows = spark.createDataFrame(LDJSON, "id long, blocks array<string>, a string, b string, c string, e string").select("id", html_functions.structured_data(F.col("blocks")).alias("s"))
    return rows.select("id", *[joined(F.col(f"s.{c}")).alias(c) for c in ("emails", "phones", "tax_ids", "addresses")])


TITLES = [("Fietsen Jansen - KVK 12345678", "Fietsen Jansen"), ("Winkel B.V. 87654321", "Winkel B.V."), ("Gewoon | Kamer van Koophandel", "Gewoon")]


TITLE_OF_PART = "concat(p_name, CASE p_partkey % 4 WHEN 0 THEN ' - KVK 12345678' WHEN 1 THEN concat(' ', 10000000 + p_partkey, ' ') WHEN 2 THEN ' | Kamer van Koophandel' ELSE ' - Fabriek' END)"


@query(f"""SELECT title, trim(regexp_replace(regexp_replace(title, '\\s*[-|]\\s*(KVK|kvk|Kamer).*$', ''), '\\s*\\d{{8}}\\s*', '', 'g')) AS name FROM (SELECT title FROM {values(TITLES, 'title, w')} UNION ALL SELECT {TITLE_OF_PART} FROM part)""")
def company_title(spark, d):
    rows = spark.createDataFrame([t[:1] for t in TITLES], "title string").union(table(spark, d, "part").selectExpr(TITLE_OF_PART))
    return rows.select("title", evidence.company_from_title(F.col("title")).alias("name"))


ESCAPES = [('<a href="x">&</a>', "&lt;a href=&quot;x&quot;&gt;&amp;&lt;/a&gt;"), (None, ""), ("gewoon", "gewoon")]


@query(wanted(ESCAPES, [0, 1], "t, shown"))
def html_escape(spark, d):
    return spark.createDataFrame(ESCAPES, "t string, shown string").select("t", urls.html_escaped(F.col("t")).alias("shown"))


@query("""SELECT doc_id, sha256(replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS shown_sha256 FROM documents""")
def html_escape_of_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(urls.html_escaped(F.col("text")), 256).alias("shown_sha256"))


ANSWERS = [(1, True, "warn", "neutral", "ok"), (2, False, "none", "none", "none"), (3, None, "unknown", "unknown", "unknown")]


@query(wanted(ANSWERS, [0, 2, 3, 4], "id, warn, neutral, plain"))
def question_status(spark, d):
    rows = spark.createDataFrame(ANSWERS, "id long, answer boolean, a string, b string, c string")
    return rows.select("id", *[report.question_status(F.col("answer"), k).alias(k) for k in ("warn", "neutral", "plain")])


SETTINGS = [("kvk_api_key", "KvK-sleutel", "KvK", 0), ("maps_key", "Kaarten", "Kaarten", 1)]
STORED = [("kvk_api_key", "geheim123"), ("oud", "x")]


@query(f"""SELECT service, ord, d.key, label, v.value IS NOT NULL AS is_set, CASE WHEN v.value IS NULL THEN '' ELSE repeat('*', length(v.value) - 4) || right(v.value, 4) END AS shown
           FROM {values(SETTINGS, 'key, label, service, ord')} d LEFT JOIN {values(STORED, 'key, value')} v ON d.key = v.key""".replace("AS t(key, label, service, ord) d", "AS d(key, label, service, ord)").replace("AS t(key, value) v", "AS v(key, value)"))
def settings_list(spark, d):
    return report.settings_listed(spark.createDataFrame(SETTINGS, "key string, label string, service string, ord int"), spark.createDataFrame(STORED, "key string, value string"))


GEOCODED = [(1, 7.5, "Weg 1, Stad", True), (2, 4.0, "Weg 1", False), (3, 9.0, "", False), (4, None, None, None)]


@query(f"""SELECT id, CASE WHEN score IS NOT NULL THEN score > 5 AND coalesce(name <> '', false) END AS valid FROM (SELECT id, score, name FROM {values(GEOCODED, 'id, score, name, w')}
           UNION ALL SELECT event_id + 100, CASE WHEN user_id % 5 <> 0 THEN value / 10 END, CASE user_id % 3 WHEN 0 THEN '' WHEN 1 THEN event_type END FROM events)""")
def geocode_valid(spark, d):
    answers = table(spark, d, "events").selectExpr("event_id + 100", "CASE WHEN user_id % 5 <> 0 THEN value / 10 END", "CASE user_id % 3 WHEN 0 THEN '' WHEN 1 THEN event_type END")
    rows = spark.createDataFrame([g[:3] for g in GEOCODED], "id long, score double, name string").union(answers)
    return rows.select("id", evidence.geocoded(F.col("score"), F.col("name")).alias("valid"))


REVERSED = [("ec2-1-2.compute.amazonaws.com.", "amazonaws.com"), ("host.nl", "host.nl")]


HOST_OF_SHOP = "concat('h', c_custkey, '.', CASE WHEN c_custkey % 2 = 0 THEN concat('net', c_nationkey, '.') ELSE '' END, lower(c_mktsegment), '.nl', CASE WHEN c_custkey % 3 = 0 THEN '.' ELSE '' END)"


@query(f"""SELECT name, array_to_string(string_split(rtrim(name, '.'), '.')[-2:], '.') AS org FROM (SELECT name FROM {values(REVERSED, 'name, w')} UNION ALL SELECT {HOST_OF_SHOP} FROM customer)""")
def ip_organisation(spark, d):
    rows = spark.createDataFrame([r[:1] for r in REVERSED], "name string").union(table(spark, d, "customer").selectExpr(HOST_OF_SHOP))
    return rows.select("name", evidence.organisation_of(F.col("name")).alias("org"))


CLAIMS = [(1, ["Thuiswinkel Waarborg"], "thuiswinkel", True), (2, ["Kiyoh"], "thuiswinkel", False), (3, [], "kiyoh", False)]


@query(f"""SELECT id, len(list_filter(names::VARCHAR[], lambda n: contains(lower(n), key))) > 0 AS claimed FROM (SELECT id, names::VARCHAR[] AS names, key FROM {values(CLAIMS, 'id, names, key, w')}
           UNION ALL SELECT c_custkey + 100, [c_name, c_mktsegment], (['build', 'auto', '#00000'])[c_custkey % 3 + 1] FROM customer)""")
def trustmark_claimed(spark, d):
    shown = table(spark, d, "customer").selectExpr("c_custkey + 100", "array(c_name, c_mktsegment)", "element_at(array('build', 'auto', '#00000'), cast(c_custkey % 3 + 1 AS int))")
    rows = spark.createDataFrame([c[:3] for c in CLAIMS], "id long, names array<string>, key string").union(shown)
    return rows.select("id", evidence.claimed(F.col("names"), F.col("key")).alias("claimed"))


REGISTER = [(1, ["12345678", "kort", "23456789"]), (2, []), (3, ["x"])]


@query("SELECT * FROM (VALUES (1, '12345678'), (1, '23456789'), (2, 'zoek2'), (3, 'zoek3')) AS t(shop_id, number)")
def register_rows(spark, d):
    lookups = spark.createDataFrame(REGISTER, "shop_id long, numbers array<string>")
    return evidence.register_rows(lookups, lookups.select("shop_id", F.concat(F.lit("zoek"), "shop_id").alias("number")), "shop_id")


FRAUD = [(1, [("Shop.nl is fout", "Titel")], "", "Titel"), (2, [], "shop.nl en SHOP.nl", "Domein 2x gevonden in zoekresultaten"), (3, [], "shop.nl shop.nl geen resultaten", ""), (4, [], "shop.nl", "")]


@query(wanted(FRAUD, [0, 3], "id, hits"))
def fraud_hits(spark, d):
    rows = spark.createDataFrame(FRAUD, "id long, items array<struct<text:string,title:string>>, page string, w string")
    return rows.select("id", joined(F.slice(evidence.fraud_hits(F.col("items"), F.col("page"), F.lit("shop.nl")), 1, 5)).alias("hits"))


ISSUERS = [(1, [("countryName", "US"), ("organizationName", "Let's Encrypt"), ("commonName", "R3")], "r3", "Let's Encrypt", True, False), (2, [("commonName", "Eigen")], "EIGEN", "Eigen", False, True), (3, [], None, None, False, False)]


@query(wanted(ISSUERS, [0, 3, 4, 5], "id, issuer, free, self_signed"))
def certificate_issuer(spark, d):
    rows = spark.createDataFrame(ISSUERS, "id long, rdns array<struct<k:string,v:string>>, subject string, a string, b boolean, c boolean")
    issuer = evidence.common_name(F.col("rdns"))
    return rows.select("id", issuer.alias("issuer"), evidence.free_issuer(issuer).alias("free"), evidence.self_signed(issuer, F.col("subject")).alias("self_signed"))


STATES = [(1, ["whois", "ssl"], "completed", 0), (2, ["tech"], "partial", 0), (3, ["tech", "ssl"], "running", 1), (4, ["ssl"], "pending", 1)]
DONE = [(1, "whois", True), (1, "ssl", True), (2, "tech", False), (3, "ssl", True)]


@query(wanted(STATES, [0, 2, 3], 'id, status, "left"'))
def scan_states(spark, d):
    rows = spark.createDataFrame(STATES, "id long, requested array<string>, w string, v int").select("id", "requested")
    return streams.scan_states(rows, spark.createDataFrame(DONE, "scan_id long, collector string, ok boolean"))


TRIES = [("a", 1, False, "x"), ("a", 2, True, "y"), ("a", 3, True, "z"), ("b", 1, False, "p"), ("b", 2, False, "q"), ("b", 4, True, "laat")]


@query(f"SELECT s, coalesce(arg_min(result, attempt) FILTER (ok), arg_max(result, attempt)) AS result, bool_or(ok) AS ok FROM {values(TRIES, 's, attempt, ok, result')} WHERE attempt <= 3 GROUP BY 1")
def first_success(spark, d):
    return streams.first_success(spark.createDataFrame(TRIES, "s string, attempt int, ok boolean, result string"), "s")


WHOIS_ROWS = [(1, "R", None, None, None), (2, None, None, None, None), (3, None, None, None, "fout"), (4, None, None, "ruw", None)]


@query("SELECT * FROM (VALUES (1), (3), (4)) AS t(id)")
def whois_stored(spark, d):
    return ingest.usable_whois(spark.createDataFrame(WHOIS_ROWS, "id long, registrar string, registration_date date, raw_data string, error string")).select("id")


@query("SELECT o_orderkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def cascading_delete(spark, d):
    gone = shops(spark, d).filter("platform = 'MACHINERY'").select(F.col("id").alias("shop_id"))
    return ingest.without_shops(scans(spark, d), gone).select("id")


@query(f"""SELECT s.id, coalesce(e.online, s.risk_level = 'low') AS is_online FROM {SHOPS} s
           LEFT JOIN (SELECT shop_id, bool_and(is_online) AS online FROM {CHECKS} GROUP BY 1) e ON s.id = e.shop_id""")
def status_merge(spark, d):
    fresh = checks(spark, d).groupBy(F.col("shop_id").alias("id")).agg(F.bool_and("is_online").alias("online"))
    return shops(spark, d).join(fresh, "id", "left").select("id", F.coalesce("online", F.col("risk_level") == "low").alias("is_online"))


STORED_PAGES = [(1, ["https://b.nl", "https://a.nl", "https://c.nl"], {"email": ["https://x.nl"]})]


@query("""SELECT 1 AS id, 'https://a.nl|https://b.nl|https://c.nl' AS links, sha256('{"email":["https://x.nl"]}') AS provenance_hash""")
def scrape_stored(spark, d):
    rows = ingest.stored_scrape(spark.createDataFrame(STORED_PAGES, "id long, external_links array<string>, sources map<string,array<string>>"))
    return rows.select("id", joined(F.col("external_links")).alias("links"), "provenance_hash")


@query(f"""WITH f AS (SELECT DISTINCT source AS shop_id, unnest({SQL_EMAILS}) AS value, 'page-' || doc_id AS url FROM documents),
                n AS (SELECT shop_id, url, row_number() OVER (PARTITION BY shop_id ORDER BY url) AS i, string_agg('email: ' || value, '|' ORDER BY value) AS lines FROM f GROUP BY 1, 2)
           SELECT shop_id, 'bewijs_' || lpad(i::VARCHAR, greatest(3, length(i::VARCHAR))::INTEGER, '0') || '_' || url AS file, lines FROM n""")
def evidence_files(spark, d):
    found = crawled(spark, d).select("shop_id", F.lit("email").alias("type"), F.explode("emails").alias("value"), F.concat(F.lit("page-"), "page_no").alias("url"))
    each = table(spark, d, "documents").select(F.col("source").alias("shop_id")).distinct()
    pages = crawl.evidence_pages(crawl.provenance(found), each.withColumn("url", F.lit("home")), spark.createDataFrame([], "shop_id string, type string, value string"))
    return report.evidence_files(pages).select("shop_id", "file", joined(F.col("lines")).alias("lines"))


@query(f"""SELECT id, b AS ten, five FROM {values([(1, 'cijfer 8,5 / 10', 8.5, None), (2, '4,87 / 5 sterren', None, 4.87)], 'id, h, b, five')}""")
def trusted_scores(spark, d):
    rows = spark.createDataFrame([(1, "cijfer 8,5 / 10"), (2, "4,87 / 5 sterren")], "id long, h string")
    return rows.select("id", evidence.score_of_ten(F.col("h")).alias("ten"), evidence.score_of_five(F.col("h")).alias("five"))


@query("SELECT event_id AS id, CASE WHEN value < 100 THEN value::INTEGER < 50 END AS is_online FROM events")
def online_from_status(spark, d):
    status_code = F.when(F.col("value") < 100, F.round("value").cast("int") * 10)
    return table(spark, d, "events").select(F.col("event_id").alias("id"), (status_code < 500).alias("is_online"))



FOUND = [(1, 1, "https://www.google.com/x", "G"), (1, 2, "https://a.nl/1", "A"), (1, 3, "https://www.a.nl/2", "A2"), (1, 4, "http://b.nl", "B" * 120), (1, 5, "ftp://c.nl", "C"), (2, 1, "https://w.nl", "W")]


@query(f"SELECT * FROM {values([(1, 1, 'a.nl', 'A'), (1, 2, 'b.nl', 'B' * 100), (2, 1, 'w.nl', 'W')], 'shop_id, place, domain, title')}")
def search_other_sites(spark, d):
    return technology.other_sites(spark.createDataFrame(FOUND, "shop_id long, place int, url string, title string"), "shop_id").drop("url")


ANSWERED = [(1, "a.nl,UA-1\nb.a.nl, UA-2 \nkapot", "a.nl=UA-1|b.a.nl=UA-2"), (2, "error invalid", ""), (3, "", "")]


@query(wanted(ANSWERED, [0, 2], "id, pairs"))
def analytics_lookup(spark, d):
    rows = spark.createDataFrame(ANSWERED, "id long, answer string, w string")
    return rows.select("id", joined(F.transform(technology.analytics_lines(F.col("answer")), lambda p: F.concat_ws("=", p["subdomain"], p["id"]))).alias("pairs"))


CHAINS = [
    (1, "http://a.nl", [("http://a.nl", 301, "https://www.a.nl"), ("https://www.a.nl", 200, "(final)")], 1, False, True, False),
    (2, "http://a.nl", [("http://b.nl", 200, "(final)")], 0, True, False, False), (3, "http://a.nl", [], 0, False, False, False),
    (4, "http://a.nl", [("http://a.nl", 301, "x")] * 5 + [("https://c.nl", 200, "(final)")], 5, True, True, True),
]


@query(wanted(CHAINS, [0, 3, 4, 5, 6], "id, redirects, domain_changed, http_to_https, too_many"))
def redirect_chains(spark, d):
    rows = spark.createDataFrame(CHAINS, "id long, start string, chain array<struct<url:string,status_code:int,location:string>>, a int, b boolean, c boolean, e boolean")
    return rows.select("id", evidence.redirect_summary(F.col("start"), F.col("chain")).alias("r")).select("id", "r.*")


@query("SELECT o_custkey AS shop_id, o_orderstatus AS kind, count(*) AS n FROM orders GROUP BY 1, 2")
def non_zero_badges(spark, d):
    kinds = {k: F.count_if(F.col("o_orderstatus") == k) for k in ("F", "O", "P")}
    counts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("shop_id")).agg(F.map_from_arrays(F.array(*map(F.lit, kinds)), F.array(*kinds.values())).alias("counts"))
    return counts.select("shop_id", F.explode(report.non_zero(F.col("counts"))).alias("kind", "n"))


@query(f"""WITH p AS (SELECT DISTINCT shop_id FROM {SCANS} WHERE price > 300000), c AS (SELECT id FROM {SHOPS} WHERE id IN (SELECT shop_id FROM p) ORDER BY id LIMIT 50)
           SELECT id, label, value FROM (SELECT id, 'Domein' AS label, domain AS value FROM {SHOPS} UNION ALL SELECT id, 'Risico', risk_level FROM {SHOPS}) WHERE id IN (SELECT id FROM c)""")
def batch_reports(spark, d):
    rows = report.report_rows(shops(spark, d), "id", [("Samenvatting", [("Domein", "domain"), ("Risico", "risk_level")])])
    chosen = scans(spark, d).filter("price > 300000").select(F.col("shop_id").alias("id"))
    return report.batch_of_reports(rows, chosen, "id").select("id", "label", "value")
