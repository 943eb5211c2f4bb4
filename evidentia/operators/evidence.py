"""Network evidence: WHOIS, certificates, DNS, headers, trustmarks, fraud lists, addresses and the business register."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from .networks import longest_networks


# --- WHOIS and dates


def whois_field(raw: Column, field: str) -> Column:
    """The first of a field's line labels that has a value in WHOIS text, or null."""
    lines = [F.nullif(F.trim(F.regexp_extract(raw, rf"(?im)^{label}\s*:\s*(.+)$", 1)), F.lit("")) for label in fixed.WHOIS_LABELS[field]]
    return F.coalesce(*lines)


def lenient_date(text: Column) -> Column:
    """The date in a text's first ten letters, or null."""
    return F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")


def certificate_time(text: Column) -> Column:
    """"Jun  1 12:00:00 2025 GMT" or "20250601120000Z" as a UTC time, or null."""
    one = F.regexp_replace(F.trim(text), r"\s+", " ")
    parts = F.regexp_extract(one, r"^(\w{3} \d{1,2} \d{2}:\d{2}:\d{2} \d{4})", 1)
    return F.coalesce(F.try_to_timestamp(parts, F.lit("MMM d HH:mm:ss yyyy")), F.try_to_timestamp(F.regexp_extract(one, r"^(\d{14})Z$", 1), F.lit("yyyyMMddHHmmss")))


def age_days(day: Column, asof: Column) -> Column:
    return F.datediff(asof, day)


def age_class(days: Column) -> Column:
    return F.when(days.isNull(), F.lit(None)).when(days < 365, "young").when(days < 730, "recent").otherwise("settled")


def privacy_protected(org: Column, name: Column, registrant: Column, emails: Column, address: Column) -> Column:
    """True if a privacy word occurs; unknown (null) if two of name, organisation and address are missing; else false."""
    spoken = F.lower(F.concat_ws("\n", org, name, registrant, emails)).rlike("|".join(fixed.PRIVACY_WORDS))
    missing = sum(((x.isNull() | (x == "")).cast("int") for x in (name, org, address)), F.lit(0))
    return F.when(spoken, True).when(missing >= 2, F.lit(None).cast("boolean")).otherwise(False)


# --- certificates


def common_name(rdns: Column) -> Column:
    """The first commonName or organizationName of array<struct<k, v>> in its order."""
    return F.try_element_at(F.filter(rdns, lambda x: x["k"].isin("commonName", "organizationName")), F.lit(1))["v"]


def self_signed(issuer: Column, subject: Column) -> Column:
    return F.coalesce(F.lower(issuer) == F.lower(subject), F.lit(False))


def free_issuer(issuer: Column) -> Column:
    return F.coalesce(F.lower(issuer).rlike("|".join(x.replace(".", r"\.") for x in fixed.FREE_ISSUERS)), F.lit(False))


def certificate_record(rows: DataFrame, asof: Column) -> DataFrame:
    """rows(..., issuer, subject: array<struct<k, v>>, not_before, not_after: string, san: array<struct<kind, value>>) with the
    certificate's fields as of a time. Without an issuer list there is no certificate, and all fields but has_ssl are null."""
    start, end = certificate_time(F.col("not_before")), certificate_time(F.col("not_after"))
    issuer, subject = common_name(F.col("issuer")), common_name(F.col("subject"))
    organisation = F.try_element_at(F.filter("issuer", lambda x: x["k"] == "organizationName"), F.lit(-1))["v"]
    there = F.col("issuer").isNotNull()
    fields = {
        "issuer_name": issuer, "issuer_organization": organisation, "subject_name": subject, "valid_from": start, "valid_until": end, "is_expired": asof > end,
        "days_until_expiry": F.floor((F.unix_seconds(end) - F.unix_seconds(asof)) / 86400).cast("int"), "is_self_signed": F.lower(issuer) == F.lower(subject),
        "is_free_ssl": F.when(issuer.isNotNull(), free_issuer(issuer)), "san_domains": F.transform(F.filter("san", lambda x: x["kind"] == "DNS"), lambda x: x["value"]),
    }
    return rows.withColumns({"has_ssl": there} | {name: F.when(there, c) for name, c in fields.items()}).drop("issuer", "subject", "not_before", "not_after", "san")


# --- DNS and headers


def dns_summary(answers: DataFrame) -> DataFrame:
    """answers(domain, rtype, value[, place]) -> one row per domain with sorted lists, the SPF and DMARC records and flags. Of several
    SPF or DMARC records the last one by place counts; without places the greatest one."""
    place = F.col("place") if "place" in answers.columns else F.col("value")
    values = lambda kind: F.array_sort(F.collect_set(F.when(F.col("rtype") == kind, F.col("value"))))

    def last(kind: str, start: str) -> Column:
        starts = (F.col("rtype") == kind) & F.col("value").startswith(start)
        return F.max_by(F.when(starts, F.col("value")), F.when(starts, F.struct(place, "value")))

    found = answers.groupBy("domain").agg(
        values("A").alias("a_records"), values("AAAA").alias("aaaa_records"), values("MX").alias("mx_records"), values("NS").alias("ns_records"),
        values("CNAME").alias("cname_records"), values("TXT").alias("txt_records"), last("TXT", "v=spf1").alias("spf_record"), last("DMARC", "v=DMARC1").alias("dmarc_record"),
        F.bool_or(F.col("rtype") == "MX").alias("has_mx"),
    )
    return found.withColumns({"has_spf": F.col("spf_record").isNotNull(), "has_dmarc": F.col("dmarc_record").isNotNull()})


def with_owners(answers: DataFrame, owners: DataFrame) -> DataFrame:
    """The A and AAAA answers with the organisation of each address: owners(ip, org, reverse_name) names it, else its reverse name does. ip is an
    address or a network (10.0.0.0/8, 2001:db8::/32); the longest network around an address counts."""
    named = owners.select(F.col("ip").alias("network"), F.coalesce("org", organisation_of(F.col("reverse_name"))).alias("org"))
    a = answers.filter(F.col("rtype").isin("A", "AAAA")).select("domain", F.col("value").alias("ip"))
    return longest_networks(a, "ip", named, "network", "org").select("domain", "ip", "network", "org")


def network_record(dns: DataFrame, headers: DataFrame, redirects: DataFrame, by: str) -> DataFrame:
    """One row per shop of what its DNS, header and redirect checks gave, each as a struct; null where a check gave nothing."""
    packed = [df.select(by, F.struct(*[c for c in df.columns if c != by]).alias(name)) for df, name in ((dns, "dns"), (headers, "headers"), (redirects, "redirects"))]
    return packed[0].join(packed[1], by, "full").join(packed[2], by, "full")


def missing_headers(headers: Column, critical: bool) -> Column:
    names = F.transform(F.map_keys(headers), F.lower)
    return F.filter(F.array(*[F.lit(h) for h, c in fixed.SECURITY_HEADERS.items() if c == critical]), lambda h: ~F.array_contains(names, F.lower(h)))


def security_score(headers: Column) -> Column:
    """The share of security headers that are there, in whole percent; header names in any case."""
    n = len(fixed.SECURITY_HEADERS)
    missing = F.size(missing_headers(headers, True)) + F.size(missing_headers(headers, False))
    return F.round((n - missing) / n * 100).cast("int")


def security_class(score: Column) -> Column:
    return F.when(score >= 70, "good").when(score >= 40, "fair").otherwise("poor")


def organisation_of(reverse_name: Column) -> Column:
    """The last two labels of a host name."""
    return F.substring_index(F.rtrim(reverse_name, F.lit(".")), ".", -2)


# --- trustmarks and fraud lists


def score_of_ten(html: Column) -> Column:
    return F.replace(F.nullif(F.regexp_extract(html, r"(\d[.,]\d)\s*/\s*10", 1), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def score_of_five(html: Column) -> Column:
    return F.replace(F.nullif(F.regexp_extract(html, r"(\d[.,]\d+)\s*/\s*5", 1), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def trust_score(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r'"trustScore":\s*(\d+\.?\d*)', 1), F.lit("")).try_cast("double")


def review_count(html: Column) -> Column:
    own = F.nullif(F.regexp_extract(html, r'"numberOfReviews":\s*"?(\d+)"?', 1), F.lit(""))
    spoken = F.nullif(F.regexp_extract(html, r"(?i)(\d[\d.,]*)\s*(?:reviews|beoordelingen)", 1), F.lit(""))
    return F.translate(F.coalesce(own, spoken), ".,", "").try_cast("int")


def rating_class(score: Column) -> Column:
    return (
        F.when(score.isNull(), F.lit(None)).when(score >= 4.5, "Uitstekend").when(score >= 4.0, "Goed")
        .when(score >= 3.0, "Gemiddeld").when(score >= 2.0, "Matig").otherwise("Slecht")
    )


def trustmark_status(source: Column, code: Column, body: Column, domain: Column, shown_url: Column) -> Column:
    """What a trustmark site's answer says of a domain: verified, likely_verified (only its name is on a list of members), found (a
    review profile), not_found, or check_failed when there was no usable answer."""
    low, own = F.lower(F.coalesce(body, F.lit(""))), F.lower(domain)
    name = F.substring_index(own, ".", 1)
    listed = low.contains(own) | ((source == "webwinkelkeur") & low.contains("lid van webwinkelkeur"))
    likely = (source == "thuiswinkel") & (F.length(name) > 3) & low.contains(name)
    profile = F.coalesce(F.lower(shown_url).contains(F.concat(F.lit("trustpilot.com/review/"), domain)), F.lit(False))
    told = F.when(source == "trustpilot", F.when(profile, "found").otherwise("not_found")).when(listed, "verified").when(likely, "likely_verified").otherwise("not_found")
    absent = (code == 404) & source.isin("webwinkelkeur", "trustpilot")
    return F.when(code == 200, told).when(absent, "not_found").otherwise("check_failed")


def trustmark_summary(results: DataFrame, by: str) -> DataFrame:
    """results(by, claimed, verified) -> counts per shop; a failed check counts as not verified."""
    claimed, verified = F.coalesce("claimed", F.lit(False)), F.coalesce("verified", F.lit(False))
    return results.groupBy(by).agg(
        F.count("*").alias("total_checked"), F.count_if(verified).alias("total_verified"), F.count_if(~verified).alias("total_not_found"),
        F.count_if(claimed & ~verified).alias("claimed_not_verified"), F.count_if(verified & ~claimed).alias("verified_not_claimed"),
    )


def claimed(names: Column, key: Column) -> Column:
    """Whether a trustmark's key is part of a name that the page shows."""
    return F.exists(names, lambda n: F.lower(n).contains(key))


def fraud_hits(items: Column, text: Column, domain: Column, phrases: bool = True) -> Column:
    """Titles of result items (struct<text, title>) that name the domain; if none, one line when the page names it twice or
    more and does not say that nothing was found."""
    hits = F.transform(F.filter(items, lambda x: F.lower(x["text"]).contains(F.lower(domain))), lambda x: F.coalesce(x["title"], F.substring(x["text"], 1, 100)))
    low = F.lower(text)
    times = ((F.length(low) - F.length(F.replace(low, F.lower(domain), F.lit("")))) / F.length(domain)).cast("int")
    quiet = low.rlike("|".join(fixed.NO_RESULTS)) if phrases else F.lit(False)
    general = F.when((times >= 2) & ~quiet, F.array(F.concat(F.lit("Domein "), times, F.lit("x gevonden in zoekresultaten")))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(hits) > 0, hits).otherwise(general)


def fraud_record(answers: DataFrame, by: str, shown: int = 5) -> DataFrame:
    """answers(by, source, domain, items, text), one for each fraud list and shop -> one record for each shop: whether and how often each list has its
    domain, the hits that are kept (cut after counting), all hits, and whether any list has it. A list without an answer found nothing."""
    by_source = reduce(lambda rest, s: F.when(F.col("source") == s[0], fraud_hits(F.col("items"), F.col("text"), F.col("domain"), s[1])).otherwise(rest), fixed.FRAUD_SOURCES.items(), F.array().cast("array<string>"))
    found = answers.filter(F.col("source").isin(*fixed.FRAUD_SOURCES)).select(by, "source", by_source.alias("hits"))
    none = F.array().cast("array<string>")
    per = [F.coalesce(F.max(F.when(F.col("source") == s, F.col("hits"))), none).alias(f"{s}_hits") for s in fixed.FRAUD_SOURCES]
    wide = found.groupBy(by).agg(*per)
    counts = {f"{s}_count": F.size(f"{s}_hits") for s in fixed.FRAUD_SOURCES}
    wide = wide.withColumns(counts).withColumn("total_hits", sum((F.col(c) for c in counts), F.lit(0))).withColumn("flagged", F.col("total_hits") > 0)
    return wide.select(by, "flagged", "total_hits", *[c for s in fixed.FRAUD_SOURCES for c in ((F.col(f"{s}_count") > 0).alias(f"{s}_found"), F.col(f"{s}_count"), F.slice(f"{s}_hits", 1, shown).alias(f"{s}_hits"))])


def warning_level(items: Column) -> Column:
    """The level that result items (struct<text, classes>) leave in their order: high and medium replace what was before, low does not."""

    def step(level: Column, x: Column) -> Column:
        low = F.lower(x["text"])
        high = x["classes"].contains("red") | low.contains("gevaarlijk") | low.contains("oplichting")
        return F.when(high, "hoog").when(x["classes"].contains("orange") | low.contains("verdacht"), "medium").otherwise(F.coalesce(level, F.lit("laag")))

    return F.aggregate(items, F.lit(None).cast("string"), step)


def fraud_totals(checks: DataFrame, by: str) -> DataFrame:
    return checks.groupBy(by).agg(F.sum("count").alias("total_hits"), F.bool_or("found").alias("flagged"))


def address_counts(checks: DataFrame, by: str) -> DataFrame:
    """Checked, valid and invalid addresses per shop; those with an unknown result are only checked."""
    return checks.groupBy(by).agg(F.count("*").alias("checked"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"))


def geocoded(score: Column, name: Column) -> Column:
    """Whether the geocoder's best answer makes an address valid; unknown without an answer."""
    return F.when(score.isNotNull(), (score > 5) & F.coalesce(name != "", F.lit(False)))


# --- business register


def name_match(domain: Column, names: Column) -> Column:
    """How a domain matches company and trade names: struct<match, score, name>. Strong if one, without spaces, hyphens and
    dots, contains the other; else the share of a name's words of four letters or more that occur in the domain, partial from 50."""
    plain = F.translate(F.lower(domain), " -.", "")
    usable = F.filter(names, lambda n: n.isNotNull() & (n != ""))

    def score(n: Column) -> Column:
        own = F.translate(F.lower(n), " -.", "")
        words = F.filter(F.split(F.lower(n), r"\s+"), lambda w: F.length(w) > 3)
        part = F.when(F.size(words) > 0, F.floor(F.size(F.filter(words, lambda w: plain.contains(w))) / F.size(words) * 100)).otherwise(0)
        return F.when((own != "") & (plain.contains(own) | own.contains(plain)), 100).otherwise(part).cast("int")

    scored = F.transform(usable, lambda n, k: F.struct(score(n).alias("score"), (-k).alias("place"), n.alias("name")))
    best = F.array_max(scored)
    strong = F.exists(usable, lambda n: (F.translate(F.lower(n), " -.", "") != "") & (plain.contains(F.translate(F.lower(n), " -.", "")) | F.translate(F.lower(n), " -.", "").contains(plain)))
    match = F.when(F.size(usable) == 0, "unknown").when(strong, "strong").when(best["score"] >= 50, "partial").otherwise("none")
    named = match.isin("strong", "partial")
    return F.struct(match.alias("match"), F.when(named, best["score"]).otherwise(0).alias("score"), F.when(named, best["name"]).alias("name"))


def register_totals(lookups: DataFrame, by: str) -> DataFrame:
    """lookups(by, place, number, is_active, score, match) -> found and active entries (unknown counts as active) and the
    first best domain match."""
    best = F.max_by(F.col("match"), F.struct("score", -F.col("place")))
    return lookups.groupBy(by).agg(
        F.count("number").alias("total_found"), F.count_if(F.col("number").isNotNull() & F.coalesce("is_active", F.lit(True))).alias("total_active"), best.alias("best_match")
    )


def company_from_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(title, r"\s*[-|]\s*(KVK|kvk|Kamer).*$", ""), r"\s*\d{8}\s*", ""))


def register_date(text: Column) -> Column:
    """A register's date of eight digits, or null."""
    return F.when(F.length(text) == 8, F.try_to_date(text, "yyyyMMdd"))


def register_cascade(numbers: DataFrame, sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """numbers(number) with the company that the first source knows it by: sources are (name, rows(number, company_name, is_active)) in
    order of trust; a row without a company name counts as unknown there. Of several rows of a source the least company name counts."""
    out, source, company, active = numbers.select("number").distinct(), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for name, rows in sources:
        best = rows.filter(F.coalesce("company_name", F.lit("")) != "").groupBy("number").agg(F.min(F.struct("company_name", "is_active")).alias(f"_{name}"))
        out, known = out.join(best, "number", "left"), F.col(f"_{name}")
        company, active = F.coalesce(company, known["company_name"]), F.when(source.isNotNull(), active).otherwise(known["is_active"])
        source = F.coalesce(source, F.when(known.isNotNull(), name))
    return out.select("number", company.alias("company_name"), active.alias("is_active"), F.coalesce(source, F.lit("none")).alias("source"))


def register_rows(lookups: DataFrame, placeholders: DataFrame, by: str) -> DataFrame:
    """Rows to store: a row for each lookup with a number, else a shop's placeholder. lookups(by, numbers array)."""
    stored = lookups.select(by, F.explode(F.slice(F.filter("numbers", lambda n: n.rlike(r"^\d{8}$")), 1, 5)).alias("number"))
    return stored.unionByName(placeholders.join(stored.select(by).distinct(), by, "left_anti"), allowMissingColumns=True)


# --- redirects


def redirect_summary(start: Column, chain: Column) -> Column:
    """Of a chain of struct<url, status_code, location> that ends with the page shown: its length, whether the domain changed, and
    whether it leads from http to https."""
    from ..functions import urls

    final = F.try_element_at(chain, F.lit(-1))["url"]
    return F.struct(
        F.greatest(F.size(chain) - 1, F.lit(0)).alias("redirects"),
        F.coalesce(urls.host(start) != urls.host(final), F.lit(False)).alias("domain_changed"),
        F.coalesce(start.startswith("http://") & final.startswith("https://"), F.lit(False)).alias("http_to_https"),
        (F.size(chain) - 1 > 3).alias("too_many"),
    )
