"""Queries over whole test tables in the place of those that showed an operator on literal rows alone. Their evidence is made from the tables'
rows, by SQL that Spark and DuckDB share or from sums that both make; what the operators find in it, the SQL forms compute from the numbers
that it was made of. The literal rows stay as FIXTURES, which the tests run and nobody registers."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from ..functions import fixed, structured, text, urls
from ..functions import html as html_functions
from ..operators import crawl, evidence, overview, report, responses, risk, shop_report, technology
from ..sources import ingest, schemas
from ..sources.shared import shared_folder
from ..streaming import status as streams
from .catalog import CHECKS, SCANS, SESSIONS, SHOPS, _stream, checks, joined, query, scans, shop_facts, table
from .network import ORACLE_SQL, QUERIES, REQUESTED, made

__all__ = ["FIXTURES", "FIXTURE_SQL", "ORACLE_SQL", "QUERIES"]

#: Literal queries whose operators run over whole tables under another name.
_TWINS = [
    "bool_filter_dsl", "security_score", "crawl_canonical", "social_platform", "addresses", "cert_dates", "dns_summary", "registry_match", "warning_levels", "risk_config", "collectors_complete",
    "shopify_identity", "structured_data", "html_escape", "register_rows", "fraud_hits", "certificate_issuer", "scan_states", "redirect_chains",
]
#: Literal queries that have a whole-table form here, under the same name.
_REPLACED = [
    "private_network", "substring_maximal", "registry_totals", "review_scores", "trusted_scores", "iban_by_country", "risk_tips", "question_status", "settings_list", "first_success", "whois_stored",
    "scrape_stored", "search_other_sites", "analytics_lookup", "export_extended",
]

FIXTURES = {name: QUERIES.pop(name) for name in (*_TWINS, *_REPLACED)}
FIXTURE_SQL = {name: ORACLE_SQL.pop(name) for name in FIXTURES if name in ORACLE_SQL}

HOSTS = """SELECT c_custkey AS id, CASE c_custkey % 8 WHEN 0 THEN '10.' || CAST(c_custkey % 256 AS STRING) || '.0.1' WHEN 1 THEN '172.' || CAST(c_custkey % 64 AS STRING) || '.3.4' WHEN 2 THEN '192.' || CAST(166 + c_custkey % 5 AS STRING) || '.9.9'
 WHEN 3 THEN CAST(c_custkey % 300 AS STRING) || '.0.0.1' WHEN 4 THEN 'f' || CASE c_custkey % 3 WHEN 0 THEN 'c' WHEN 1 THEN 'd' ELSE 'e' END || '0' || CAST(c_custkey % 10 AS STRING) || '::1' WHEN 5 THEN '::' || CAST(c_custkey % 3 AS STRING)
 WHEN 6 THEN '169.' || CAST(253 + c_custkey % 3 AS STRING) || '.1.1' ELSE c_name END AS ip FROM customer"""


@query(f"""SELECT id, ip, CASE WHEN contains(ip, ':') THEN ip = '::1' OR starts_with(ip, 'fc') OR starts_with(ip, 'fd') WHEN contains(ip, '.') THEN a = 10 OR a = 127 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) ELSE false END AS private
           FROM (SELECT *, TRY_CAST(split_part(ip, '.', 1) AS INTEGER) AS a, TRY_CAST(split_part(ip, '.', 2) AS INTEGER) AS b FROM ({HOSTS}))""")
def private_network(spark, d):
    return made(spark, d, HOSTS, "customer").select("id", "ip", F.coalesce(urls.private_address(F.col("ip")), F.lit(False)).alias("private"))


@query("""WITH t AS (SELECT o_custkey AS id, list_distinct(list('Weg ' || o_orderkey % 120)) AS items FROM orders GROUP BY 1)
          SELECT id, array_to_string(list_sort(list_filter(items, lambda x: len(list_filter(items, lambda y: y <> x AND contains(y, x))) = 0)), '|') AS kept FROM t""")
def substring_maximal(spark, d):
    items = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set(F.concat(F.lit("Weg "), (F.col("o_orderkey") % 120).cast("string"))).alias("items"))
    return items.select("id", joined(F.array_sort(text.longest_only(F.col("items")))).alias("kept"))


LOOKUPS = """SELECT o_custkey AS shop_id, o_orderkey AS place, CASE WHEN o_orderkey % 5 > 0 THEN CAST(10000000 + o_orderkey AS STRING) END AS number, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_active,
 o_orderkey % 4 * 25 AS score, 'm' || CAST(o_orderkey AS STRING) AS match FROM orders"""


@query(f"""SELECT shop_id, count(number) AS total_found, count(*) FILTER (number IS NOT NULL AND coalesce(is_active, true)) AS total_active, arg_max(match, score::HUGEINT * 1000000000000 - place) AS best_match FROM ({LOOKUPS}) GROUP BY 1""")
def registry_totals(spark, d):
    return evidence.register_totals(made(spark, d, LOOKUPS, "orders"), "shop_id")


ANSWERS = """SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'score ' || CAST(c_custkey % 10 AS STRING) || ',' || CAST(c_custkey % 7 AS STRING) || ' / 10 uit ' || CAST(c_custkey AS STRING) || ' beoordelingen'
 WHEN 1 THEN '"trustScore": ' || CAST(c_custkey % 6 AS STRING) || '.' || CAST(c_custkey % 9 AS STRING) || ', "numberOfReviews": "' || CAST(c_custkey AS STRING) || '"' WHEN 2 THEN CAST(1 + c_custkey % 9 AS STRING) || '.' || CAST(100 + c_custkey % 900 AS STRING) || ' Reviews'
 WHEN 3 THEN CAST(c_custkey % 5 AS STRING) || ',' || CAST(10 + c_custkey % 90 AS STRING) || ' / 5 sterren' ELSE c_name END AS html FROM customer"""
TRUST = "CASE WHEN c_custkey % 5 = 1 THEN c_custkey % 6 + c_custkey % 9 / 10.0 END::DOUBLE"


@query(f"""SELECT *, CASE WHEN trust >= 4.5 THEN 'Uitstekend' WHEN trust >= 4 THEN 'Goed' WHEN trust >= 3 THEN 'Gemiddeld' WHEN trust >= 2 THEN 'Matig' WHEN trust IS NOT NULL THEN 'Slecht' END AS rating FROM (
           SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 10 + c_custkey % 7 / 10.0 END::DOUBLE AS of_ten, {TRUST} AS trust,
                  CASE c_custkey % 5 WHEN 0 THEN c_custkey WHEN 1 THEN c_custkey WHEN 2 THEN (1 + c_custkey % 9) * 1000 + 100 + c_custkey % 900 END::INTEGER AS reviews FROM customer)""")
def review_scores(spark, d):
    h = F.col("html")
    scores = made(spark, d, ANSWERS, "customer").select("id", evidence.score_of_ten(h).alias("of_ten"), evidence.trust_score(h).alias("trust"), evidence.review_count(h).alias("reviews"))
    return scores.withColumn("rating", evidence.rating_class(F.col("trust")))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 10 + c_custkey % 7 / 10.0 END::DOUBLE AS ten, CASE WHEN c_custkey % 5 = 3 THEN c_custkey % 5 + (10 + c_custkey % 90) / 100.0 END::DOUBLE AS five FROM customer""")
def trusted_scores(spark, d):
    return made(spark, d, ANSWERS, "customer").select("id", evidence.score_of_ten(F.col("html")).alias("ten"), evidence.score_of_five(F.col("html")).alias("five"))


IBANS = """SELECT o_custkey AS shop_id, CASE o_orderkey % 5 WHEN 0 THEN 'NL' WHEN 1 THEN 'nl' WHEN 2 THEN 'DE' WHEN 3 THEN 'be' ELSE 'XX' END || CAST(o_orderkey % 90 AS STRING) AS iban FROM orders"""


@query(f"""SELECT shop_id, country, CASE country WHEN 'DE' THEN 'Duitsland' WHEN 'NL' THEN 'Nederland' WHEN 'BE' THEN 'België' ELSE country END AS name, string_agg(DISTINCT iban, '|' ORDER BY iban) AS ibans, (country <> 'NL')::INTEGER AS "foreign"
           FROM (SELECT *, upper(iban[1:2]) AS country FROM ({IBANS})) GROUP BY shop_id, country""")
def iban_by_country(spark, d):
    return report.ibans_by_country(made(spark, d, IBANS, "orders"), "shop_id").withColumn("ibans", joined(F.col("ibans")))


#: When a rule of each shop fails, over the numbers that shop_facts makes its facts of.
FAILS = {
    "has_address": "n <= 8", "has_email": "n <= 5", "has_phone": "n <= 10", "has_kvk": "NOT urgent", "has_btw": "true", "kvk_verified": "NOT urgent", "has_contact_page": "NOT urgent", "has_privacy": "n <= 12", "has_terms": "n <= 13", "has_returns": "n <= 14",
    "has_nl_iban": "n <= 3", "no_foreign_iban": "false", "has_ssl": "NOT has_ssl", "domain_age_1yr": "age < 365", "domain_age_2yr": "age < 730", "has_verified_tm": "true", "no_fake_tm": "n % 2 = 1", "not_in_scam_db": "flagged",
}
FAILED = ", ".join(f"CASE WHEN {FAILS[k]} THEN '{k}' END" for k, *_ in sorted((r for r in fixed.RISK_RULES if r[3] > 0), key=lambda r: -r[3]))


@query(f"""WITH f AS (SELECT s.id, coalesce(o.n, 0) AS n, coalesce(urgent, false) AS urgent, coalesce(price > 100000, false) AS has_ssl, trunc(domain_age)::INTEGER AS age, coalesce(errors > 2, false) AS flagged FROM {SHOPS} s
           LEFT JOIN (SELECT shop_id, count(*) AS n, bool_or(priority = '1-URGENT') AS urgent, max(price) AS price FROM {SCANS} GROUP BY 1) o ON s.id = o.shop_id
           LEFT JOIN (SELECT shop_id, count(*) FILTER (NOT is_online) AS errors FROM {CHECKS} GROUP BY 1) e ON s.id = e.shop_id)
           SELECT id, array_to_string(list_filter([{FAILED}], lambda x: x IS NOT NULL), '|') AS rules FROM f""")
def risk_tips(spark, d):
    return risk.scored(shop_facts(spark, d), "id").select("id", joined(F.transform("tips", lambda t: t["rule"])).alias("rules"))


REPLIES = "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS answer FROM orders"


@query(f"""SELECT id, {', '.join(f"CASE WHEN answer IS NULL THEN 'unknown' WHEN NOT answer THEN 'none' ELSE '{shown}' END AS {kind}" for kind, shown in (('warn', 'warn'), ('neutral', 'neutral'), ('plain', 'ok')))} FROM ({REPLIES})""")
def question_status(spark, d):
    return made(spark, d, REPLIES, "orders").select("id", *[report.question_status(F.col("answer"), k).alias(k) for k in ("warn", "neutral", "plain")])


DEFINED = "SELECT 'key' || CAST(c_custkey AS STRING) AS key, c_name AS label, c_mktsegment AS service, c_custkey AS ord FROM customer"
KEPT = "SELECT 'key' || CAST(s_suppkey * 7 AS STRING) AS key, substring(s_name, 1 + CAST(s_suppkey % 16 AS INT), 30) AS value FROM supplier"


@query(f"""SELECT service, ord, d.key, label, v.value IS NOT NULL AS is_set, CASE WHEN v.value IS NULL THEN '' WHEN length(v.value) > 4 THEN repeat('*', length(v.value) - 4) || right(v.value, 4) ELSE repeat('*', length(v.value)) END AS shown
           FROM ({DEFINED}) d LEFT JOIN ({KEPT}) v ON d.key = v.key""")
def settings_list(spark, d):
    return report.settings_listed(made(spark, d, DEFINED, "customer"), made(spark, d, KEPT, "supplier"))


@query(f"""WITH l AS (SELECT service, ord, d.key, v.value IS NOT NULL AS is_set FROM ({DEFINED}) d LEFT JOIN ({KEPT}) v ON d.key = v.key)
           SELECT service, count(*) AS settings, count(*) FILTER (is_set) AS n_set, string_agg(key, '|' ORDER BY ord) AS keys FROM l GROUP BY 1""")
def settings_by_service(spark, d):
    grouped = report.settings_by_service(report.settings_listed(made(spark, d, DEFINED, "customer"), made(spark, d, KEPT, "supplier")))
    return grouped.select("service", F.size("settings").cast("long").alias("settings"), "n_set", joined(F.transform("settings", lambda s: s["key"])).alias("keys"))


TRIES = "SELECT l_orderkey AS s, l_linenumber AS attempt, l_quantity < 20 AS ok, l_returnflag || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) AS result FROM lineitem"


@query(f"""SELECT s, coalesce(arg_min(result, attempt) FILTER (ok), arg_max(result, attempt)) AS result, bool_or(ok) AS ok FROM (SELECT s, attempt, bool_or(ok) AS ok, min(result) AS result FROM ({TRIES}) GROUP BY 1, 2) WHERE attempt <= 3 GROUP BY 1""")
def first_success(spark, d):
    once = made(spark, d, TRIES, "lineitem").groupBy("s", "attempt").agg(F.bool_or("ok").alias("ok"), F.min("result").alias("result"))
    return streams.first_success(once, "s")


WHOIS = """SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN c_name END AS registrar, CASE WHEN c_custkey % 6 = 1 THEN DATE '2020-01-01' END AS registration_date,
 CASE WHEN c_custkey % 7 = 2 THEN c_mktsegment END AS raw_data, CASE WHEN c_acctbal < 0 THEN 'fout' END AS error FROM customer"""


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 4 = 0 OR c_custkey % 6 = 1 OR c_custkey % 7 = 2 OR c_acctbal < 0")
def whois_stored(spark, d):
    return ingest.usable_whois(made(spark, d, WHOIS, "customer")).select("id")


@query("""SELECT o_custkey % 20 AS id, array_to_string(list_sort(list('https://s' || o_orderkey || '.nl'))[1:100], '|') AS links,
          sha256('{"email":["' || array_to_string(list_sort(list('https://s' || o_orderkey || '.nl')), '","') || '"]}') AS provenance_hash FROM orders GROUP BY 1""")
def scrape_stored(spark, d):
    found = table(spark, d, "orders").groupBy((F.col("o_custkey") % 20).alias("id")).agg(F.collect_list(F.concat(F.lit("https://s"), F.col("o_orderkey").cast("string"), F.lit(".nl"))).alias("external_links"))
    rows = ingest.stored_scrape(found.withColumn("sources", F.create_map(F.lit("email"), F.array_sort("external_links"))))
    return rows.select("id", joined(F.col("external_links")).alias("links"), "provenance_hash")


FOUND = """SELECT o_custkey % 50 AS shop_id, o_orderkey AS place, CASE o_orderkey % 7 WHEN 0 THEN 'https://www.google.com/' WHEN 1 THEN 'ftp://c.nl/' WHEN 2 THEN 'https://www.S' || CAST(o_orderkey % 23 AS STRING) || '.nl/' ELSE 'http://s' || CAST(o_orderkey % 23 AS STRING) || '.nl:8080/' END || CAST(o_orderkey AS STRING) AS url,
 repeat(o_orderpriority, 20) AS title FROM orders"""


@query(f"""WITH h AS (SELECT shop_id, place, title, 's' || place % 23 || '.nl' AS domain, row_number() OVER (PARTITION BY shop_id, place % 23 ORDER BY place) AS turn FROM ({FOUND}) WHERE place % 7 > 1),
           r AS (SELECT *, row_number() OVER (PARTITION BY shop_id ORDER BY place) AS n FROM h WHERE turn = 1)
           SELECT shop_id, n::INTEGER AS place, domain, title[1:100] AS title FROM r WHERE n <= 10""")
def search_other_sites(spark, d):
    return technology.other_sites(made(spark, d, FOUND, "orders"), "shop_id").drop("url")


@query("""SELECT o_custkey AS id, CASE WHEN o_custkey % 9 = 0 THEN '' ELSE coalesce(string_agg('s' || o_orderkey || '.nl=UA-' || o_orderkey % 77, '|' ORDER BY o_orderkey) FILTER (o_orderkey % 5 > 0), '') END AS pairs FROM orders GROUP BY 1""")
def analytics_lookup(spark, d):
    key = F.col("o_orderkey")
    line = F.when(key % 5 == 0, F.concat(F.lit("kapot "), key.cast("string"))).otherwise(F.concat(F.lit(" s"), key.cast("string"), F.lit(".nl, UA-"), (key % 77).cast("string")))
    lines = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key.alias("k"), line.alias("l")))), lambda x: x["l"]), "\n").alias("a"))
    answer = F.when(F.col("o_custkey") % 9 == 0, F.concat(F.lit("Error: "), F.col("a"))).otherwise(F.col("a"))
    pairs = F.transform(technology.analytics_lines(answer), lambda p: F.concat_ws("=", p["subdomain"], p["id"]))
    return lines.select(F.col("o_custkey").alias("id"), joined(pairs).alias("pairs"))


#: The six lists of the extended export, with the signs that join them.
LISTS = {"emails": ", ", "phones": ", ", "addresses": " | ", "kvk": ", ", "btw": ", ", "iban": ", "}
_ENTRY = {"emails": "'i' || o_orderkey || '@s.nl'", "phones": "'06' || o_orderkey", "addresses": "'Weg ' || o_orderkey % 50", "kvk": "'' || (10000000 + o_orderkey)", "btw": "CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'NL' || o_orderkey END", "iban": "'NL91' || o_orderkey"}


def _sql_list(name: str, sign: str) -> str:
    return f"array_to_string(list_filter(list({_ENTRY[name]} ORDER BY o_orderkey), lambda x: x <> ''), '{sign}')"


@query(f"""SELECT o_custkey AS shop_id, {', '.join(f"CASE WHEN (o_custkey + {k}) % 5 = 0 THEN '' WHEN (o_custkey + {k}) % 5 = 1 THEN 'los' ELSE {_sql_list(name, sign)} END AS {name}" for k, (name, sign) in enumerate(LISTS.items()))} FROM orders GROUP BY 1""")
def export_extended(spark, d):
    """Lists as they are stored: JSON, none at all, or a lone value."""
    o = table(spark, d, "orders")
    entries = o.select("o_custkey", "o_orderkey", *[F.expr(x).alias(n) for n, x in _ENTRY.items()])
    kept = entries.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", *LISTS))).alias("all"))
    stored = kept.select(F.col("o_custkey").alias("shop_id"), *[_stored_list(k, n).alias(n) for k, n in enumerate(LISTS)])
    return overview.joined_lists(stored.select("shop_id", *[text.json_list(F.col(n)).alias(n) for n in LISTS]), LISTS)


def _stored_list(k: int, name: str):
    turn = (F.col("o_custkey") + k) % 5
    return F.when(turn == 0, F.when(F.col("o_custkey") % 2 == 0, F.lit("[]"))).when(turn == 1, F.lit('"los"')).otherwise(F.to_json(F.col(f"all.{name}")))


LISTED = """SELECT CASE c_custkey % 9 WHEN 0 THEN 'http://localhost/' || CAST(c_custkey AS STRING) WHEN 1 THEN 'https://www.known' || CAST(c_custkey % 40 AS STRING) || '.nl/x' WHEN 2 THEN 'New' || CAST(c_custkey % 30 AS STRING) || '.nl' ELSE 'https://shop' || CAST(c_custkey % 500 AS STRING) || '.nl' END AS url FROM customer"""
KNOWN = "SELECT 'https://known' || CAST(s_suppkey AS STRING) || '.nl' AS url, 'Known' || CAST(s_suppkey AS STRING) || '.nl' AS domain FROM supplier"


@query(f"""WITH l AS (SELECT url AS given, count(*) AS rows, any_value(CASE WHEN starts_with(url, 'http') THEN url ELSE 'https://' || url END) AS url FROM ({LISTED}) GROUP BY 1),
           n AS (SELECT *, regexp_replace(regexp_extract(url, '^https?://([^/?#]*)', 1), '^www\\.', '') AS domain FROM l)
           SELECT given, rows, url, domain, CASE WHEN contains(url, 'localhost') THEN 'error' WHEN k.d IS NOT NULL THEN 'skipped' ELSE 'added' END AS outcome,
           CASE WHEN contains(url, 'localhost') THEN 'internal address' WHEN k.d IS NOT NULL THEN 'known already' END AS reason FROM n LEFT JOIN (SELECT DISTINCT lower(domain) AS d FROM ({KNOWN})) k ON lower(domain) = k.d""")
def import_outcomes(spark, d):
    return ingest.import_outcomes(made(spark, d, LISTED, "customer"), made(spark, d, KNOWN, "supplier"))


#: Pages of shops with what they say of themselves, by kind of block.
SPOKEN = """CASE c_custkey % 6
 WHEN 0 THEN concat('<script type="application/ld+json">', '{"@graph":[{"@type":"Store","email":"Info', CAST(c_custkey AS STRING), '@S.nl","telephone":"020-1234567"},{"vatID":"NL', CAST(100000000 + c_custkey AS STRING), 'B01"}]}', '</script>')
 WHEN 1 THEN concat('<script type="application/ld+json">', '[{"address":{"streetAddress":"Weg ', CAST(c_custkey AS STRING), '","postalCode":"1234 AB","addressLocality":"Stad"}},"x"]', '</script>')
 WHEN 2 THEN concat('<script type="application/ld+json">', '{"taxID":"', CAST(10000000 + c_custkey AS STRING), '","telephone":["0612345678",null,{"x":1}]}', '</script>')
 WHEN 3 THEN concat('<script type="application/ld+json">', '{"note":{"text":["KvK ', CAST(20000000 + c_custkey AS STRING), '","NL91ABNA0417164300"]}}', '</script>')
 WHEN 4 THEN concat('<script type="application/ld+json">', '{"email":"kapot@s.nl"', '</script>')
 ELSE concat('<meta name="kvk-nummer" content="', CAST(30000000 + c_custkey AS STRING), '"><meta property="business:email" content="W', CAST(c_custkey AS STRING), '@x.nl">') END"""


@query("""SELECT -1 - c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 'info' || c_custkey || '@s.nl' WHEN 5 THEN 'w' || c_custkey || '@x.nl' ELSE '' END AS emails, CASE c_custkey % 6 WHEN 0 THEN '0201234567' WHEN 2 THEN '0612345678' ELSE '' END AS phones,
          CASE c_custkey % 6 WHEN 2 THEN '' || (10000000 + c_custkey) WHEN 3 THEN '' || (20000000 + c_custkey) WHEN 5 THEN '' || (30000000 + c_custkey) ELSE '' END AS kvk, CASE c_custkey % 6 WHEN 0 THEN 'NL' || (100000000 + c_custkey) || 'B01' ELSE '' END AS btw,
          CASE c_custkey % 6 WHEN 3 THEN 'NL91ABNA0417164300' ELSE '' END AS iban, CASE c_custkey % 6 WHEN 1 THEN 'Weg ' || c_custkey || ' 1234 AB Stad' ELSE '' END AS addresses FROM customer
          UNION ALL SELECT page_id, '', '', '', '', '', '' FROM pages""")
def structured_of_pages(spark, d):
    """All pages, which hold no such blocks, and one for each shop. A small file of shops makes many pages, so the shops are dealt out first."""
    shops = table(spark, d, "customer").select("c_custkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    made_pages = shops.select((-1 - F.col("c_custkey")).alias("id"), F.lit("https://s.nl/").alias("url"), F.expr(SPOKEN).alias("html"))
    rows = made_pages.union(table(spark, d, "pages").select("page_id", "url", "html"))
    parsed = rows.select("id", html_functions.parse_html(F.col("url"), F.col("html"), "ldjson", "metas").alias("p"))
    found = parsed.select("id", structured.structured_entities(F.col("p.ldjson"), F.col("p.metas")).alias("s"))
    return found.select("id", *[joined(F.col(f"s.{c}")).alias(c) for c in ("emails", "phones", "kvk", "btw", "iban", "addresses")])



@query(f"""WITH h AS (SELECT shop_id, place, title, CASE WHEN place % 7 = 0 THEN 'google.com' ELSE 's' || place % 23 || '.nl' END AS domain, url FROM ({FOUND}) WHERE place % 7 <> 1),
           r AS (SELECT p.platform, h.*, row_number() OVER (PARTITION BY p.platform, shop_id ORDER BY place) AS n FROM h, (VALUES ('google_ads'), ('meta')) AS p(platform) WHERE domain <> 'google.com')
           SELECT platform, shop_id, n::INTEGER AS place, domain, url, title[1:100] AS title FROM r WHERE n <= 10""")
def tracker_owners(spark, d):
    found = made(spark, d, FOUND, "orders")
    both = [technology.owner_results(found, "shop_id", p).select(F.lit(p).alias("platform"), "*") for p in fixed.SKIPPED_OWNERS]
    return both[0].union(both[1])


@query("""WITH l AS (SELECT o_custkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN 's' || o_orderkey % 40 || '.nl' END AS name FROM orders)
          SELECT id, coalesce(array_to_string(list_sort(list_distinct(list(name) FILTER (name IS NOT NULL)))[1:20], '|'), '') AS sites FROM l GROUP BY 1""")
def spied_sites(spark, d):
    key = F.col("o_orderkey")
    link = F.struct(F.when(key % 3 == 1, F.concat(F.lit("https://x.com/go/"), key.cast("string"))).when(key % 3 == 2, "/go/y").otherwise("/stop/").alias("href"), F.concat(F.lit(" S"), (key % 40).cast("string"), F.lit(".NL ")).alias("text"))
    links = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list(link).alias("links"))
    return links.select("id", joined(technology.related_sites(F.col("links"))).alias("sites"))


@query("""SELECT o_custkey AS id, CASE WHEN o_custkey % 3 = 2 OR o_custkey % 10 = 0 THEN '' ELSE coalesce(string_agg('s' || o_orderkey || '.nl', '|' ORDER BY o_orderkey) FILTER (o_orderkey % 4 > 0), '') END AS domains FROM orders GROUP BY 1""")
def reverse_lookups(spark, d):
    key, shop = F.col("o_orderkey"), F.col("o_custkey")
    line = F.when(key % 4 > 0, F.concat(F.lit("s"), key.cast("string"), F.lit(".nl "))).otherwise("geen")
    lines = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key.alias("k"), line.alias("l")))), lambda x: x["l"]), "\n").alias("a"))
    name = F.when(shop % 3 == 0, "UA-1").when(shop % 3 == 1, "GTM-2").otherwise("G-3")
    answer = F.when(shop % 10 == 0, F.concat(F.lit("error "), F.col("a"))).otherwise(F.col("a"))
    return lines.select(shop.alias("id"), joined(technology.reverse_lines(name, answer)).alias("domains"))


FRAUD_COUNTS = f"""(SELECT doc_id // 3 AS shop_id, doc_id % 3 AS s, CASE WHEN len(hits) > 0 THEN len(hits) WHEN times >= 2 AND (doc_id % 3 = 2 OR NOT quiet) THEN 1 ELSE 0 END AS n FROM (
    SELECT doc_id, len(list_filter(string_split(low, chr(10)), lambda x: length(x) > 200 AND contains(x, 'men'))) AS n_hits, list_filter(string_split(low, chr(10)), lambda x: length(x) > 200 AND contains(x, 'men')) AS hits,
           (length(low) - length(replace(low, 'men', ''))) // 3 AS times, list_bool_or([{', '.join(f"contains(low, '{x}')" for x in fixed.NO_RESULTS)}]) AS quiet FROM (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents)))"""


@query(f"""SELECT shop_id, sum(n) > 0 AS flagged, sum(n)::INTEGER AS total_hits, {', '.join(f"coalesce(max(n) FILTER (s = {k}), 0) > 0 AS {name}_found, coalesce(max(n) FILTER (s = {k}), 0)::INTEGER AS {name}_count, least(5, coalesce(max(n) FILTER (s = {k}), 0))::INTEGER AS {name}_shown" for k, name in enumerate(fixed.FRAUD_SOURCES))} FROM {FRAUD_COUNTS} GROUP BY 1""")
def fraud_records(spark, d):
    """Documents as answers of three fraud lists, three of them to a shop; their long lines are result items."""
    body, names = F.coalesce("text", F.lit("")), F.array(*map(F.lit, fixed.FRAUD_SOURCES))
    items = F.transform(F.filter(F.split(body, "\n"), lambda x: F.length(x) > 200), lambda x: F.struct(x.alias("text"), F.lit(None).cast("string").alias("title")))
    answers = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 3).alias("shop_id"), F.get(names, (F.col("doc_id") % 3).cast("int")).alias("source"), F.lit("men").alias("domain"), items.alias("items"), body.alias("text"))
    record = evidence.fraud_record(answers, "shop_id")
    return record.withColumns({f"{s}_hits": F.size(f"{s}_hits") for s in fixed.FRAUD_SOURCES}).withColumnsRenamed({f"{s}_hits": f"{s}_shown" for s in fixed.FRAUD_SOURCES})


# --- the whole report of every shop

#: Evidence of shop k in the columns of sources/schemas.py: when there is any, and its columns.
EVIDENCE = {
    "scrape": ("k % 2 = 0", {
        "emails": "array(concat('a', k, '@s.nl'))", "kvk": "array(cast(10000000 + k AS string))", "iban": "array('DE1', 'NL2')", "social": "map('facebook', concat('fb', k))", "has_contact": "k % 3 = 0", "has_privacy": "k % 4 = 0",
        "is_opening_soon": "k % 5 = 0", "languages": "array('nl', 'xx')", "sources": "map(concat('a', k, '@s.nl'), array('p1', 'p2', 'p3', 'p4'))"}),
    "whois": ("k % 5 = 0", {"registrar": "name", "registrant_country": "'NL'", "registration_date": "DATE '2020-01-01'", "domain_age_days": "cast(k AS int)", "is_privacy_protected": "CASE WHEN k % 10 = 0 THEN true END", "name_servers": "array('ns1', 'ns2')"}),
    "ssl": ("k % 7 = 0", {"has_ssl": "true", "issuer": "name", "valid_from": "TIMESTAMP '2024-01-01 00:00:00'", "is_self_signed": "k % 14 = 0"}),
    "dns_http": ("k % 11 = 0", {"a_records": "array('10.0.0.1')", "has_mx": "true", "security_score": "cast(k % 100 AS int)", "redirects": "array(struct('http://s.nl', 301, 'https://s.nl'), struct('https://s.nl', 200, ''))"}),
    "tech": ("k % 3 = 0", {"technologies": "map('payment', array('iDEAL', 'PayPal'))", "ecommerce_platform": "'Magento'", "payment_providers": "array('iDEAL', 'PayPal')"}),
    "trustmark": ("k % 13 = 0", {"verifications": "array(struct('Thuiswinkel', 'not_found', true, false))"}),
    "kvk": ("k % 4 = 1", {"kvk_number": "cast(10000000 + k AS string)", "company_name": "name", "street": "'Weg'", "house_number": "'1'", "city": "'Stad'"}),
    "ad_tracker": ("k % 6 = 0", {"trackers": "array(struct('GA', 'UA-1', 'UA-1'))", "cross_references": "array(struct('UA-1', k + 1), struct('UA-1', k + 0))"}),
    "scam": ("k % 8 = 0", {"flagged": "true", "total_hits": "3", "checks": "array(struct('opgelicht.nl', true, 3, array('a', 'b', 'c')), struct('x', false, 0, cast(array() AS array<string>)))"}),
    "bag_validation": ("k % 9 = 0", {"addresses_checked": "2", "addresses_valid": "1", "addresses_invalid": "0", "results": "array(struct('A', true, 9.0D), struct('B', cast(null AS boolean), cast(null AS double)))"}),
}


def evidence_of_shops(spark, d):
    """The evidence tables of all shops, each with an older record that must not count (of register entries there is none)."""
    k = table(spark, d, "customer").selectExpr("c_custkey AS k", "c_name AS name")
    out = {}
    for name, (when, columns) in EVIDENCE.items():
        schema = schemas.empty(spark, name).schema
        own = {"id": "k", "shop_id": "k", **columns}
        rows = k.filter(when).select(*[F.expr(own.get(f.name, "NULL")).cast(f.dataType).alias(f.name) for f in schema])
        old = k.filter(when).select(*[F.expr({"id": "-1 - k", "shop_id": "k"}.get(f.name, "NULL")).cast(f.dataType).alias(f.name) for f in schema])
        out[name] = rows if name == "kvk" else rows.unionByName(old)
    return out


def _yes(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 'Ja' ELSE 'Nee' END"


_EVEN, _W, _T = "k % 2 = 0", "k % 5 = 0", "k % 3 = 0"
#: The lines of a report in SQL: section, whether it has the lines, and (label, value) of each.
REPORTED = [
    ("Samenvatting", "true", [("E-mailadressen gevonden", f"CASE WHEN {_EVEN} THEN '1' ELSE '0' END"), ("Telefoonnummers gevonden", "'0'"), ("Adressen gevonden", "'0'"), ("Contactpagina", _yes("k % 6 = 0")), ("Privacybeleid", _yes("k % 4 = 0")), ("Algemene voorwaarden", "'Nee'"), ("Retourbeleid", "'Nee'")]),
    ("Vragenlijst", "true", [("Binnenkort geopend?", _yes("k % 10 = 0")), ("In onderhoud?", "'Nee'"), ("Talen op de website", f"CASE WHEN {_EVEN} THEN 'Nederlands, XX' ELSE '—' END"), *[(x, "'Nee'") for x in ("Levertijd vermeld?", "Pre-orders mogelijk?", "Contact via WhatsApp?", "Verdacht lage prijzen?")]]),
    ("Bedrijfsgegevens", "true", [("KvK-nummer", f"CASE WHEN {_EVEN} THEN '' || (10000000 + k) ELSE '—' END"), ("BTW-nummer", "'—'")]),
    ("Betalingen & Bankgegevens", "true", [("Betaalmethoden gedetecteerd", f"CASE WHEN {_T} THEN 'iDEAL, PayPal' ELSE 'Niet gedetecteerd' END")]),
    ("Betalingen & Bankgegevens", _EVEN, [None, ("IBAN Nederland", "'NL2'"), ("IBAN Duitsland", "'DE1'")]),
    ("WHOIS Domeinregistratie", f"NOT ({_W})", [("WHOIS", "'Geen WHOIS-data beschikbaar'")]),
    ("WHOIS Domeinregistratie", _W, [("Registrar", "name"), ("Land", "'NL'"), ("Geregistreerd", "'2020-01-01'"), ("Vervalt", "'—'"), ("Domeinleeftijd", "CASE WHEN k <> 0 THEN k || ' dagen' ELSE '—' END"), ("Privacy beschermd", "CASE WHEN k % 10 = 0 THEN 'Ja' ELSE '—' END"), ("Naamservers", "'ns1, ns2'")]),
    ("SSL Certificaat", "k % 7 = 0", [("SSL actief", "'Ja'"), ("Uitgever", "name"), ("Geldig vanaf", "'2024-01-01'"), ("Geldig tot", "'—'"), ("Verlopen", "'Nee'"), ("Self-signed", _yes("k % 14 = 0"))]),
    ("DNS Records & HTTP Security", "k % 11 = 0", [("A records", "'10.0.0.1'"), ("MX (e-mail)", "'Ja'"), ("SPF", "'Nee'"), ("DMARC", "'Nee'"), ("Security headers score", "k % 100 || '%'"), ("HTTP → HTTPS redirect", "'Ja'"), ("Aantal redirects", "'1'"), ("Domein wijzigt bij redirect", "'Nee'")]),
    ("Technologie Detectie", _T, [("E-commerce platform", "'Magento'"), ("Betaalmethoden", "'iDEAL, PayPal'")]),
    ("Keurmerk Verificatie", "k % 13 = 0", [("Thuiswinkel", "'Niet gevonden (geclaimd, niet geverifieerd)'")]),
    ("KVK Handelsregister", "k % 4 = 1", [("KVK-nummer", "'' || (10000000 + k)"), ("Bedrijfsnaam", "name"), ("Rechtsvorm", "'—'"), ("Adres", "'Weg 1'"), ("Plaats", "'Stad'"), ("Actief", "'Onbekend'")]),
    ("Advertentie Trackers", "k % 6 = 0", [("GA", "'UA-1'"), ("Cross-referentie UA-1", "k || ', ' || (k + 1)")]),
    ("Fraudedatabases Check", "k % 8 = 0", [("In fraudedatabase gevonden", "'Ja'"), ("Aantal meldingen", "'3'"), ("Gevonden in", "'opgelicht.nl'"), ("opgelicht.nl", "'3: a | b'")]),
    ("Gevonden contactgegevens", _EVEN, [("E-mailadres", "'a' || k || '@s.nl'"), ("  Gevonden op", "'p1, p2, p3'")]),
    ("Adresvalidatie BAG/PDOK", "k % 9 = 0", [("Gecontroleerde adressen", "'2'"), ("Geldig (in BAG)", "'1'"), ("Ongeldig / niet gevonden", "'0'"), ("A", "'✓ Geldig'"), ("B", "'? Onbekend'")]),
    ("Social media", _EVEN, [("facebook", "'fb' || k")]),
]


@query("WITH c AS (SELECT c_custkey AS k, c_name AS name FROM customer) " + " UNION ALL ".join(
    f"SELECT k AS shop_id, '{section}' AS section, {ord_} AS ord, '{line[0]}' AS label, {line[1]} AS value FROM c WHERE {when}" for section, when, lines in REPORTED for ord_, line in enumerate(lines) if line))
def shop_reports(spark, d):
    shops = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return shop_report.shop_report(shops, evidence_of_shops(spark, d))


#: The kinds of records of a shop's detail document.
CHILDREN = ("scans", *EVIDENCE, "status_check")


@query("SELECT c_custkey AS id, " + ", ".join(f"""CASE WHEN {when} THEN '{"k" if name == "kvk" else "-1-k,k"}' ELSE '' END AS {name}""".replace("'-1-k,k'", "(-1 - c_custkey) || ',' || c_custkey").replace("'k'", "'' || c_custkey").replace("k %", "c_custkey %") for name, (when, _) in EVIDENCE.items())
       + f""", coalesce(s.ids, '') AS scans, coalesce(e.ids, '') AS status_check FROM customer LEFT JOIN (SELECT shop_id, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM {SCANS} GROUP BY 1) s ON s.shop_id = c_custkey
       LEFT JOIN (SELECT shop_id, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM {CHECKS} GROUP BY 1) e ON e.shop_id = c_custkey""")  # fmt: skip
def shop_details(spark, d):
    """Every shop's document with all kinds of records; shown are the ids that each kind holds."""
    children = {"scans": scans(spark, d).select("id", "shop_id", "status"), **evidence_of_shops(spark, d), "status_check": checks(spark, d).select("id", "shop_id", "is_online", "checked_at")}
    nested = overview.detail(table(spark, d, "customer").selectExpr("c_custkey AS id", "c_name AS domain"), children)
    return nested.select("id", *[F.array_join(F.transform(name, lambda x: x["id"].cast("string")), ",").alias(name) for name in CHILDREN])


# --- answers, documents and stored evidence


@query("""SELECT id, shop_id, registrar, registration_date, expiration_date, domain_age_days, registrant_country, name_servers, is_privacy_protected, raw_data, collected_at FROM (
          SELECT c_custkey AS id, c_custkey AS shop_id, c_name AS registrar, DATE '2020-01-01' AS registration_date, NULL::DATE AS expiration_date, c_custkey::INTEGER AS domain_age_days, 'NL' AS registrant_country, '["ns1","ns2"]' AS name_servers,
                 CASE WHEN c_custkey % 10 = 0 THEN true END AS is_privacy_protected, NULL::VARCHAR AS raw_data, NULL::TIMESTAMP AS collected_at FROM customer WHERE c_custkey % 5 = 0
          UNION ALL SELECT -1 - c_custkey, c_custkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM customer WHERE c_custkey % 5 = 0)""")
def whois_responses(spark, d):
    return responses.response(evidence_of_shops(spark, d)["whois"], "whois")


@query("""SELECT c_custkey AS id, '{"id":' || c_custkey || ',"domain":"' || c_name || '","scans":[' || coalesce(s.items, '') || ']}' AS json FROM customer LEFT JOIN (
          SELECT o_custkey, string_agg('{"id":' || o_orderkey || ',"status":"' || CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'partial' ELSE 'running' END || '"}', ',' ORDER BY o_orderkey) AS items FROM orders GROUP BY 1) s ON o_custkey = c_custkey""")
def shop_documents(spark, d):
    shops = table(spark, d, "customer").selectExpr("c_custkey AS id", "c_name AS domain")
    return overview.detail_json(overview.detail(shops, {"scans": scans(spark, d).select("id", "shop_id", "status")}))


@query("WITH c AS (SELECT c_custkey AS k FROM customer) " + " UNION ALL ".join(f"SELECT '{name}' AS kind, count(*){'' if name == 'kvk' else ' * 2'} AS records, count(*) AS shops, sum(k)::BIGINT{'' if name == 'kvk' else ' - sum(k + 1)::BIGINT'} AS ids FROM c WHERE {when}" for name, (when, _) in EVIDENCE.items()))
def evidence_stored(spark, d):
    """All evidence appended to Parquet and read again with its declared schema."""
    folder = f"{shared_folder(spark)}/evidentia-evidence-{uuid.uuid4().hex}"
    counts = []
    for name, rows in evidence_of_shops(spark, d).items():
        ingest.append(rows, folder, name)
        counts.append(schemas.read(spark, folder, name).agg(F.lit(name).alias("kind"), F.count("*").alias("records"), F.countDistinct("shop_id").alias("shops"), F.sum("id").alias("ids")))
    return reduce(lambda a, b: a.unionByName(b), counts)


@query("""WITH f AS (SELECT DISTINCT o_custkey AS shop_id, 'v' || o_orderkey % 5 AS value, 'page-' || o_orderkey AS url FROM orders)
          SELECT shop_id, value, array_to_string(list_sort(list(url))[1:3], '|') AS shown FROM f GROUP BY 1, 2""")
def sources_of_values(spark, d):
    found = table(spark, d, "orders").select(F.col("o_custkey").alias("shop_id"), F.lit("x").alias("type"), F.concat(F.lit("v"), (F.col("o_orderkey") % 5).cast("string")).alias("value"), F.concat(F.lit("page-"), F.col("o_orderkey").cast("string")).alias("url"))
    shown = report.sources_shown(found.select("shop_id", "value").distinct(), crawl.provenance(found), "shop_id")
    return shown.select("shop_id", "value", joined(F.col("shown")).alias("shown"))


# --- streams and their time


@query(f"SELECT id, shop_id, is_online, response_ms, checked_at FROM {CHECKS}")
def stream_checks_once(spark, d):
    """A stream that brings every check twice, each let through once within the watermark."""
    stream, folder = _stream(spark, d)
    return streams.replay(spark, streams.distinct_checks(stream.union(stream), late="365 days"), "append", folder)


@query(f"SELECT shop_id, begun, ended, done FROM {SESSIONS}")
def work_sessions_of_shops(spark, d):
    return streams.work_sessions(checks(spark, d), "shop_id", "checked_at")


@query(f"""WITH done AS (SELECT l_orderkey AS scan_id, list_distinct(list(l_returnflag)) AS names, bool_and(l_quantity < 45) AS all_ok, max(TIMESTAMP '1998-01-01 00:00:00' + INTERVAL 1 HOUR * (l_orderkey % 6) + INTERVAL 1 MINUTE * l_linenumber) AS heard FROM lineitem GROUP BY 1),
           j AS (SELECT id, names, all_ok, greatest(TIMESTAMP '1998-01-01 00:00:00' + INTERVAL 1 HOUR * (id % 4), heard) AS last, len(list_filter(string_split(requested, '|'), lambda x: NOT list_contains(coalesce(names, []), x)))::INTEGER AS n_left FROM ({REQUESTED}) s LEFT JOIN done ON scan_id = id)
           SELECT id, CASE WHEN n_left = 0 THEN CASE WHEN all_ok THEN 'completed' ELSE 'partial' END WHEN last + INTERVAL 1 HOUR <= TIMESTAMP '1998-01-01 05:00:00' THEN 'failed' WHEN names IS NULL THEN 'pending' ELSE 'running' END AS status, n_left FROM j""")
def timed_scan_states_of_orders(spark, d):
    """States of scans at five o'clock: those that are not ended and silent for an hour have failed."""
    asked = made(spark, d, REQUESTED, "orders")
    scans_ = asked.select("id", F.split("requested", r"\|").alias("requested"), F.expr("timestampadd(HOUR, CAST(id % 4 AS INT), TIMESTAMP '1998-01-01 00:00:00')").alias("begun"))
    heard = F.expr("timestampadd(MINUTE, CAST(l_orderkey % 6 * 60 + l_linenumber AS INT), TIMESTAMP '1998-01-01 00:00:00')")
    done = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("scan_id"), F.col("l_returnflag").alias("collector"), (F.col("l_quantity") < 45).alias("ok"), heard.alias("at"))
    return streams.timed_scan_states(scans_, done, F.expr("TIMESTAMP '1998-01-01 05:00:00'")).withColumnRenamed("left", "n_left")
