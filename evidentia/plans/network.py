"""Registered queries of network evidence, the register, scans and queues over whole test tables. What those tables do not hold (answers
of name servers, certificates, headers, redirects) is made from their rows by one SQL text that Spark and DuckDB both run; what
the operators make of it, the SQL forms compute on their own."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import evidence, latest
from ..sources import upsert
from ..sources.shared import shared_folder
from ..streaming import status as streams
from .catalog import CHECKS, ORACLE_SQL, QUERIES, _stream, checks, joined, literal, query, table

__all__ = ["ORACLE_SQL", "QUERIES"]


def made(spark, d, text: str, *names: str):
    """The rows of a SQL text over test tables, in Spark."""
    named = re.sub(rf"\bFROM ({'|'.join(names)})\b", r"FROM {\1}", text.replace("\n", " "))
    return spark.sql(named, **{n: table(spark, d, n) for n in names})


ANSWERS = """SELECT 'shop' || CAST(o_custkey AS STRING) || '.nl' AS domain,
 CASE o_orderkey % 8 WHEN 0 THEN 'A' WHEN 1 THEN 'MX' WHEN 2 THEN 'NS' WHEN 3 THEN 'DMARC' WHEN 4 THEN 'AAAA' WHEN 5 THEN 'CNAME' ELSE 'TXT' END AS rtype,
 CASE o_orderkey % 8 WHEN 0 THEN '10.0.' || CAST(o_custkey % 9 AS STRING) || '.' || CAST(o_orderkey % 50 AS STRING) WHEN 3 THEN CASE WHEN o_custkey % 3 = 0 THEN 'v=DMARC1; p=' || lower(o_orderpriority) ELSE 'none' END
 WHEN 6 THEN 'v=spf1 include:' || CAST(o_orderkey % 13 AS STRING) WHEN 7 THEN 'proof=' || o_orderstatus ELSE 'host' || CAST(o_orderkey % 5 AS STRING) || '.example' END AS value,
 o_orderkey AS place FROM orders"""

RECORDS = f"""(SELECT domain, coalesce(string_agg(DISTINCT value, '|' ORDER BY value) FILTER (rtype = 'A'), '') AS a, coalesce(string_agg(DISTINCT value, '|' ORDER BY value) FILTER (rtype = 'AAAA'), '') AS aaaa,
 coalesce(string_agg(DISTINCT value, '|' ORDER BY value) FILTER (rtype = 'CNAME'), '') AS cname, arg_max(value, place) FILTER (rtype = 'TXT' AND starts_with(value, 'v=spf1')) AS spf_record,
 arg_max(value, place) FILTER (rtype = 'DMARC' AND starts_with(value, 'v=DMARC1')) AS dmarc_record, bool_or(rtype = 'MX') AS has_mx FROM ({ANSWERS}) GROUP BY 1)"""


def dns(spark, d):
    found = evidence.dns_summary(made(spark, d, ANSWERS, "orders"))
    return found.select("domain", joined(F.col("a_records")).alias("a"), joined(F.col("aaaa_records")).alias("aaaa"), joined(F.col("cname_records")).alias("cname"), "spf_record", "dmarc_record", "has_mx")


@query(f"SELECT * FROM {RECORDS}")
def dns_of_shops(spark, d):
    return dns(spark, d)


# Networks of several lengths within each other, and an IPv6 answer for each third order.
HOSTS = f"""SELECT domain, rtype, value, place FROM ({ANSWERS}) AS a UNION ALL
 SELECT 'shop' || CAST(o_custkey AS STRING) || '.nl' AS domain, 'AAAA' AS rtype, '2001:db8:' || CAST(o_custkey % 9 AS STRING) || '::' || CAST(o_orderkey % 50 AS STRING) AS value, o_orderkey AS place FROM orders WHERE o_orderkey % 3 = 0"""
OWNERS = """SELECT CASE s_suppkey % 4 WHEN 0 THEN '10.0.' || CAST(s_suppkey % 9 AS STRING) || '.' || CAST(s_suppkey % 50 AS STRING) WHEN 1 THEN '10.0.' || CAST(s_suppkey % 9 AS STRING) || '.0/' || CAST(24 + s_suppkey % 5 AS STRING)
 WHEN 2 THEN '10.0.0.0/' || CAST(8 + s_suppkey % 13 AS STRING) ELSE '2001:db8:' || CAST(s_suppkey % 9 AS STRING) || '::/' || CAST(44 + s_suppkey % 84 AS STRING) END AS ip,
 CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS org, 'n' || CAST(s_suppkey % 3 AS STRING) || '.dc.host' || CAST(s_nationkey AS STRING) || '.net.' AS reverse_name FROM supplier"""

# In SQL: an address as bits, and the longest network whose bits begin it.
V4_BITS = "array_to_string([format('{{:08b}}', part::INTEGER) FOR part IN string_split({0}, '.')], '')"
V6_BITS = """array_to_string([format('{{:016b}}', ('0x' || part)::INTEGER) FOR part IN string_split(split_part({0}, '::', 1), ':')], '') || repeat('0', 16 * (8 - len(string_split(split_part({0}, '::', 1), ':')) - 1)) ||
 format('{{:016b}}', ('0x' || CASE WHEN split_part({0}, '::', 2) = '' THEN '0' ELSE split_part({0}, '::', 2) END)::INTEGER)"""


def sql_bits(ip: str) -> str:
    return f"CASE WHEN contains({ip}, ':') THEN '6' || {V6_BITS.format(ip)} WHEN regexp_matches({ip}, '^[0-9.]+$') THEN '4' || {V4_BITS.format(ip)} END"


@query(f"""WITH o AS (SELECT split_part(ip, '/', 1) AS base, CASE WHEN contains(ip, '/') THEN split_part(ip, '/', 2)::INTEGER WHEN contains(ip, ':') THEN 128 ELSE 32 END AS n, ip,
           coalesce(org, array_to_string(list_slice(string_split(rtrim(reverse_name, '.'), '.'), -2, -1), '.')) AS org FROM ({OWNERS})),
           nets AS (SELECT left({sql_bits('base')}, n + 1) AS bits, n, min(ip) AS network, min(org) AS org FROM o GROUP BY 1, 2),
           a AS (SELECT row_number() OVER () AS k, domain, value AS ip, {sql_bits('value')} AS bits FROM ({HOSTS}) WHERE rtype IN ('A', 'AAAA')),
           cut AS (SELECT k, domain, ip, n, left(bits, n + 1) AS bits FROM a, (SELECT DISTINCT n FROM nets))
           SELECT c.domain, c.ip, nets.network, nets.org FROM (SELECT k, any_value(cut.domain) AS domain, any_value(cut.ip) AS ip, max(nets.n) AS n FROM cut LEFT JOIN nets ON nets.n = cut.n AND nets.bits = cut.bits GROUP BY k) c
           JOIN a USING (k) LEFT JOIN nets ON nets.n = c.n AND nets.bits = left(a.bits, c.n + 1)""")
def owners_of_addresses(spark, d):
    return evidence.with_owners(made(spark, d, HOSTS, "orders"), made(spark, d, OWNERS, "supplier"))


NAMES = " || ".join(f"CASE WHEN c_custkey % {k + 2} = 0 THEN '|{name.upper() if k % 2 else name}' ELSE '' END" for k, name in enumerate(fixed.SECURITY_HEADERS))
SENT = f"SELECT 'shop' || CAST(c_custkey AS STRING) || '.nl' AS domain, 'Server' || {NAMES} AS names FROM customer"
PRESENT = " + ".join(f"list_contains(string_split(lower(names), '|'), '{name.lower()}')::INTEGER" for name in fixed.SECURITY_HEADERS)
CRITICAL = " + ".join(f"(NOT list_contains(string_split(lower(names), '|'), '{name.lower()}'))::INTEGER" for name, critical in fixed.SECURITY_HEADERS.items() if critical)
SCORES = f"(SELECT domain, round(({PRESENT}) / {len(fixed.SECURITY_HEADERS)} * 100)::INTEGER AS score, {CRITICAL} AS critical_missing FROM ({SENT}) WHERE length(names) > 6)"


def headers(spark, d):
    names = F.split("names", r"\|")
    sent = made(spark, d, SENT, "customer").filter("length(names) > 6").select("domain", F.map_from_arrays(names, F.transform(names, lambda n: F.lit("x"))).alias("h"))
    return sent.select("domain", evidence.security_score(F.col("h")).alias("score"), F.size(evidence.missing_headers(F.col("h"), True)).alias("critical_missing"))


HOPS = """SELECT 'shop' || CAST(c_custkey AS STRING) || '.nl' AS domain, CASE WHEN c_custkey % 4 = 0 THEN 'https://' ELSE 'http://' END AS scheme, c_custkey % 6 AS hops,
 CASE WHEN c_custkey % 5 = 0 THEN 'https://www.other.nl/x' WHEN c_custkey % 7 = 0 THEN 'http://shop' || CAST(c_custkey AS STRING) || '.nl/' ELSE 'https://www.shop' || CAST(c_custkey AS STRING) || '.nl/home' END AS shown FROM customer"""
FINAL = "regexp_replace(regexp_replace(shown, '^https?://', ''), '/.*$', '')"
REDIRECTS = f"""(SELECT domain, hops::INTEGER AS redirects, {FINAL} NOT IN (domain, 'www.' || domain) AS domain_changed, scheme = 'http://' AND starts_with(shown, 'https://') AS http_to_https, hops > 3 AS too_many FROM ({HOPS}))"""


def redirects(spark, d):
    hop = lambda url, code: F.struct(url.alias("url"), F.lit(code).alias("status_code"), F.lit("x").alias("location"))
    start = F.concat("scheme", "domain")
    chain = F.concat(F.array_repeat(hop(start, 301), F.col("hops").cast("int")), F.array(hop(F.col("shown"), 200)))
    return made(spark, d, HOPS, "customer").select("domain", evidence.redirect_summary(start, chain).alias("r")).select("domain", "r.*")


@query(f"""SELECT domain, d.domain IS NOT NULL AS has_dns, spf_record, dmarc_record, has_mx, score, critical_missing, redirects, domain_changed, http_to_https, too_many
           FROM {RECORDS} d FULL JOIN {SCORES} h USING (domain) FULL JOIN {REDIRECTS} r USING (domain)""")
def network_of_shops(spark, d):
    found = evidence.network_record(dns(spark, d), headers(spark, d), redirects(spark, d), "domain")
    return found.select(
        "domain", F.col("dns").isNotNull().alias("has_dns"), "dns.spf_record", "dns.dmarc_record", "dns.has_mx", "headers.score", "headers.critical_missing",
        "redirects.redirects", "redirects.domain_changed", "redirects.http_to_https", "redirects.too_many",
    )


CERTIFICATES = """SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN 'Let''s Encrypt R' || CAST(c_custkey % 5 AS STRING) WHEN 2 THEN UPPER(c_mktsegment) || ' CA' END AS issuer, c_mktsegment AS organisation,
 CASE WHEN c_custkey % 8 = 0 THEN UPPER(c_name) ELSE 'shop' || CAST(c_custkey AS STRING) END AS subject,
 CASE WHEN c_custkey % 11 = 0 THEN 'onleesbaar' ELSE CASE c_custkey % 3 WHEN 0 THEN 'Jan' WHEN 1 THEN 'Jun' ELSE 'Dec' END || '  ' || CAST(c_custkey % 9 + 1 AS STRING) || ' 12:34:56 ' || CAST(2024 + c_custkey % 3 AS STRING) || ' GMT' END AS not_after,
 CASE WHEN c_custkey % 2 = 0 THEN 'www.shop' || CAST(c_custkey AS STRING) || '.nl' END AS extra FROM customer"""


@query(f"""SELECT id, issuer IS NOT NULL AS has_ssl, issuer AS issuer_name, CASE WHEN issuer IS NOT NULL THEN organisation END AS issuer_organization, CASE WHEN issuer IS NOT NULL THEN valid END AS valid_until,
           CASE WHEN issuer IS NOT NULL THEN valid < TIMESTAMP '2025-06-06 00:00:00' END AS is_expired, CASE WHEN issuer IS NOT NULL THEN floor((epoch(valid) - epoch(TIMESTAMP '2025-06-06 00:00:00')) / 86400)::INTEGER END AS days_until_expiry,
           lower(issuer) = lower(subject) AS is_self_signed, CASE WHEN issuer IS NOT NULL THEN list_bool_or(list_transform({literal(fixed.FREE_ISSUERS)}, lambda x: contains(lower(issuer), x))) END AS is_free_ssl,
           CASE WHEN issuer IS NOT NULL THEN concat_ws('|', 'shop' || id || '.nl', extra) END AS san_domains
           FROM (SELECT *, try_strptime(replace(not_after, '  ', ' '), '%b %-d %H:%M:%S %Y GMT') AS valid FROM ({CERTIFICATES}))""")
def certificates_of_shops(spark, d):
    pair = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    rows = made(spark, d, CERTIFICATES, "customer")
    named = F.when(F.col("issuer").isNotNull(), F.array(pair("commonName", F.col("issuer")), pair("organizationName", F.col("organisation"))))
    san = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in (("DNS", F.concat(F.lit("shop"), "id", F.lit(".nl"))), ("IP Address", F.lit("10.0.0.1")), ("DNS", F.col("extra")))])
    rows = rows.select("id", named.alias("issuer"), F.array(pair("commonName", F.col("subject"))).alias("subject"), F.lit("20240101000000Z").alias("not_before"), "not_after", san.alias("san"))
    found = evidence.certificate_record(rows, F.lit("2025-06-06 00:00:00").cast("timestamp"))
    return found.select("id", "has_ssl", "issuer_name", "issuer_organization", F.col("valid_until").cast("timestamp_ntz").alias("valid_until"), "is_expired", "days_until_expiry", "is_self_signed", "is_free_ssl", F.when(F.col("has_ssl"), joined(F.col("san_domains"))).alias("san_domains"))


MARKS = "coalesce(string_split(text, chr(10)), [])"


@query(f"""WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS low, list_filter({MARKS}, lambda x: length(x) > 200 AND contains(lower(x), 'men')) AS hits FROM documents),
           n AS (SELECT doc_id, hits, (length(low) - length(replace(low, 'men', ''))) // 3 AS times, list_bool_or(list_transform({literal(fixed.NO_RESULTS)}, lambda x: contains(low, x))) AS quiet FROM t)
           SELECT doc_id, CASE WHEN len(hits) > 0 THEN len(hits) WHEN times >= 2 AND NOT quiet THEN 1 ELSE 0 END::INTEGER AS n_hits,
           md5(CASE WHEN len(hits) > 0 THEN array_to_string(list_transform(hits[1:5], lambda x: x[1:100]), '|') WHEN times >= 2 AND NOT quiet THEN 'Domein ' || times || 'x gevonden in zoekresultaten' ELSE '' END) AS shown FROM n""")
def fraud_of_documents(spark, d):
    """Whole texts as answers of a fraud list, their long lines as its result items; the five shown are cut after counting."""
    text = F.coalesce("text", F.lit(""))
    items = F.transform(F.filter(F.split(text, "\n"), lambda x: F.length(x) > 200), lambda x: F.struct(x.alias("text"), F.lit(None).cast("string").alias("title")))
    hits = table(spark, d, "documents").select("doc_id", evidence.fraud_hits(items, text, F.lit("men")).alias("hits"))
    return hits.select("doc_id", F.size("hits").alias("n_hits"), F.md5(joined(F.slice("hits", 1, 5))).alias("shown"))


@query(f"""WITH t AS (SELECT doc_id, list_transform({MARKS}, lambda x: CASE WHEN length(x) % 7 = 0 THEN 2 WHEN length(x) % 5 = 0 THEN 1 ELSE 0 END) AS marks FROM documents),
           s AS (SELECT doc_id, marks, list_filter(marks, lambda m: m > 0) AS strong FROM t)
           SELECT doc_id, CASE WHEN len(strong) > 0 THEN CASE strong[-1] WHEN 2 THEN 'hoog' ELSE 'medium' END WHEN len(marks) > 0 THEN 'laag' END AS level FROM s""")
def warnings_of_documents(spark, d):
    colour = lambda x: F.when(F.length(x) % 7 == 0, "red").when(F.length(x) % 5 == 0, "orange").otherwise("")
    items = F.transform(F.coalesce(F.split("text", "\n"), F.array().cast("array<string>")), lambda x: F.struct(F.lit("").alias("text"), colour(x).alias("classes")))
    return table(spark, d, "documents").select("doc_id", evidence.warning_level(items).alias("level"))


BODIES = """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'thuiswinkel' WHEN 1 THEN 'webwinkelkeur' WHEN 2 THEN 'trusted shops' ELSE 'trustpilot' END AS source,
 CASE page_id % 7 WHEN 0 THEN 404 WHEN 1 THEN 500 ELSE 200 END AS code, html, CASE page_id % 3 WHEN 0 THEN 'charset.nl' WHEN 1 THEN 'doctype' ELSE 'nergens.nl' END AS domain,
 CASE WHEN page_id % 2 = 0 THEN url ELSE 'https://www.trustpilot.com/review/doctype' END AS shown_url FROM pages"""


@query(f"""SELECT page_id, source, CASE WHEN code = 404 AND source IN ('webwinkelkeur', 'trustpilot') THEN 'not_found' WHEN code <> 200 THEN 'check_failed'
           WHEN source = 'trustpilot' THEN CASE WHEN contains(lower(shown_url), 'trustpilot.com/review/' || domain) THEN 'found' ELSE 'not_found' END
           WHEN contains(lower(html), domain) OR (source = 'webwinkelkeur' AND contains(lower(html), 'lid van webwinkelkeur')) THEN 'verified'
           WHEN source = 'thuiswinkel' AND contains(lower(html), string_split(domain, '.')[1]) THEN 'likely_verified' ELSE 'not_found' END AS status FROM ({BODIES})""")
def trustmark_statuses(spark, d):
    rows = made(spark, d, BODIES, "pages")
    return rows.select("page_id", "source", evidence.trustmark_status(F.col("source"), F.col("code"), F.col("html"), F.col("domain"), F.col("shown_url")).alias("status"))


PLAIN = lambda x: f"replace(replace(replace(lower({x}), ' ', ''), '-', ''), '.', '')"


NAMED = """SELECT p_partkey, replace(p_name, ' ', '-') || '.nl' AS domain, CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS a,
 CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'Holding ' || split_part(p_name, ' ', 1) WHEN 2 THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) END AS b, CASE WHEN p_partkey % 3 = 0 THEN '-' END AS c FROM part"""


@query(f"""WITH p AS (SELECT p_partkey, domain, unnest([a, b, c]) AS n, unnest([1, 2, 3]) AS place FROM ({NAMED})),
           s AS (SELECT *, list_filter(string_split(lower(n), ' '), lambda w: length(w) > 3) AS words, {PLAIN('n')} AS own, {PLAIN('domain')} AS plain FROM p WHERE n IS NOT NULL),
           r AS (SELECT p_partkey, place, n, own <> '' AND (contains(plain, own) OR contains(own, plain)) AS strong,
                 CASE WHEN own <> '' AND (contains(plain, own) OR contains(own, plain)) THEN 100 WHEN len(words) = 0 THEN 0 ELSE floor(len(list_filter(words, lambda w: contains(plain, w))) / len(words) * 100)::INTEGER END AS score FROM s),
           b AS (SELECT p_partkey, bool_or(strong) AS strong, max(score) AS top, arg_max(n, score * 10 - place) AS best FROM r GROUP BY 1)
           SELECT part.p_partkey, CASE WHEN best IS NULL THEN 'unknown' WHEN strong THEN 'strong' WHEN top >= 50 THEN 'partial' ELSE 'none' END AS match, CASE WHEN strong OR top >= 50 THEN top ELSE 0 END AS score, CASE WHEN strong OR top >= 50 THEN best END AS name
           FROM part LEFT JOIN b ON b.p_partkey = part.p_partkey""")
def register_names_of_parts(spark, d):
    rows = made(spark, d, NAMED, "part").select("p_partkey", evidence.name_match(F.col("domain"), F.array("a", "b", "c")).alias("m"))
    return rows.select("p_partkey", "m.*")


KNOWN = {
    "api": "SELECT s_suppkey AS number, CASE WHEN s_suppkey % 3 <> 0 THEN s_name END AS company_name, s_acctbal > 0 AS is_active FROM supplier",
    "open": "SELECT p_partkey % 400 AS number, CASE WHEN p_partkey % 4 <> 0 THEN p_name ELSE '' END AS company_name, p_size > 10 AS is_active FROM part",
}
FIRST = {k: f"(SELECT number, min(company_name) AS c, arg_min(is_active, (company_name, is_active)) AS a FROM ({v}) WHERE coalesce(company_name, '') <> '' GROUP BY 1)" for k, v in KNOWN.items()}


@query(f"""SELECT n.number, coalesce(x.c, y.c) AS company_name, CASE WHEN x.c IS NOT NULL THEN x.a ELSE y.a END AS is_active, CASE WHEN x.c IS NOT NULL THEN 'api' WHEN y.c IS NOT NULL THEN 'open' ELSE 'none' END AS source
           FROM (SELECT DISTINCT l_partkey AS number FROM lineitem) n LEFT JOIN {FIRST['api']} x ON x.number = n.number LEFT JOIN {FIRST['open']} y ON y.number = n.number""")
def register_cascades(spark, d):
    sources = [("api", made(spark, d, KNOWN["api"], "supplier")), ("open", made(spark, d, KNOWN["open"], "part"))]
    return evidence.register_cascade(table(spark, d, "lineitem").select(F.col("l_partkey").alias("number")), sources)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate::DATE END AS day FROM orders""")
def register_dates(spark, d):
    text = F.when(F.col("o_orderkey") % 5 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return table(spark, d, "orders").select("o_orderkey", evidence.register_date(text).alias("day"))


REQUESTED = "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'A|N' ELSE 'A|N|R' END AS requested, CASE WHEN o_orderkey % 17 = 0 THEN 'kapot' END AS error FROM orders"


@query(f"""WITH done AS (SELECT l_orderkey AS scan_id, list_distinct(list(l_returnflag)) AS names, bool_and(l_quantity < 45) AS all_ok FROM lineitem GROUP BY 1),
           j AS (SELECT id, error, names, all_ok, len(list_filter(string_split(requested, '|'), lambda x: NOT list_contains(coalesce(names, []), x)))::INTEGER AS n_left FROM ({REQUESTED}) s LEFT JOIN done ON scan_id = id)
           SELECT id, CASE WHEN error IS NOT NULL THEN 'failed' WHEN names IS NULL THEN 'pending' WHEN n_left > 0 THEN 'running' WHEN all_ok THEN 'completed' ELSE 'partial' END AS status, n_left FROM j""")
def scan_states_of_orders(spark, d):
    scans = made(spark, d, REQUESTED, "orders").withColumn("requested", F.split("requested", r"\|"))
    done = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("scan_id"), F.col("l_returnflag").alias("collector"), (F.col("l_quantity") < 45).alias("ok"))
    return streams.scan_states(scans, done).withColumnRenamed("left", "n_left")


@query("""SELECT c_custkey AS shop_id, c_custkey AS place, CASE WHEN c_acctbal < 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN c_acctbal < 0 THEN 'geen antwoord van ' || c_name ELSE lower(c_name) END AS result FROM customer""")
def queue_of_shops(spark, d):
    def work(row: dict) -> str:
        if row["balance"] < 0:
            raise ValueError(f"geen antwoord van {row['name']}")
        return row["name"].lower()

    rows = table(spark, d, "customer").selectExpr("c_custkey AS shop_id", "c_custkey AS place", "c_name AS name", "c_acctbal AS balance")
    return streams.scan_queue(rows, work)


@query(f"SELECT shop_id, checked_at, id, is_online, response_ms FROM (SELECT *, row_number() OVER (PARTITION BY shop_id ORDER BY checked_at DESC, id DESC) AS r FROM {CHECKS}) WHERE r = 1")
def stream_latest_folded(spark, d):
    stream, folder = _stream(spark, d)
    return streams.fold_latest(spark, stream, folder)


CHANGES = """SELECT o_custkey AS id, o_orderkey AS number, lower(o_orderpriority) AS name, CASE WHEN o_orderstatus = 'F' THEN 'high' ELSE 'low' END AS risk_level FROM orders"""


@query(f"""WITH first AS (SELECT c_custkey AS id, -1 AS number, c_name AS name, 'unknown' AS risk_level FROM customer), changed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY number DESC) AS r FROM ({CHANGES})) WHERE r = 1)
           SELECT coalesce(c.id, f.id) AS id, coalesce(c.number, f.number) AS number, CASE WHEN c.id IS NULL THEN f.name ELSE c.name END AS name, coalesce(c.risk_level, f.risk_level) AS risk_level FROM first f FULL JOIN changed c ON f.id = c.id""")
def shops_upserted(spark, d):
    """Shops put in as a first batch, and changed by their scans in two more, the second of which runs twice."""
    folder = f"{shared_folder(spark)}/evidentia-shops-{uuid.uuid4().hex}"
    shops = table(spark, d, "customer").selectExpr("c_custkey AS id", "-1L AS number", "c_name AS name", "'unknown' AS risk_level")
    changes = made(spark, d, CHANGES, "orders")
    for number, batch in enumerate([shops, changes.filter("number % 2 = 1"), changes.filter("number % 2 = 0"), changes.filter("number % 2 = 0")]):
        upsert.upsert(batch, min(number, 2), folder, "id", ["number"])
    return upsert.stored(spark, folder, "id long, number long, name string, risk_level string")


@query(f"SELECT shop_id, arg_max_null(k, id) AS last_k, max(id) AS last_id, min(id) AS first_id FROM {CHECKS} GROUP BY 1")
def ends_of_stored_lists(spark, d):
    stored = checks(spark, d).groupBy("shop_id").agg(F.collect_list(F.struct("id", "k")).alias("items"))
    return stored.select("shop_id", latest.last_of(F.col("items"))["k"].alias("last_k"), latest.last_of(F.col("items"))["id"].alias("last_id"), latest.first_of(F.col("items"))["id"].alias("first_id"))
