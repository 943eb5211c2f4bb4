"""URL and host functions, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def with_scheme(url: Column) -> Column:
    """The URL without white space around it, with https:// unless it has a scheme."""
    bare = F.regexp_replace(url, r"(?U)^\s+|\s+$", "")
    return F.when(bare.rlike("^https?://"), bare).otherwise(F.concat(F.lit("https://"), bare))


def authority(url: Column) -> Column:
    """Host and port, in the case given; URLs without a scheme count as https."""
    full = F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url))
    return F.regexp_extract(full, "^https?://([^/?#]*)", 1)


def domain(url: Column) -> Column:
    """The authority without one leading www., in the case given."""
    return F.regexp_replace(authority(url), r"^www\.", "")


def host(url: Column) -> Column:
    """The lower-cased host without port and one leading www."""
    return F.regexp_replace(F.regexp_replace(F.lower(authority(url)), r"^www\.", ""), r":\d+$", "")


def host_compat(url: Column) -> Column:
    """The lower-cased authority without any leading w and dot; kept for comparison with old records only."""
    return F.ltrim(F.lower(authority(url)), F.lit("w."))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def _decoded(part: Column) -> Column:
    return F.coalesce(F.try_url_decode(part), F.replace(part, F.lit("+"), F.lit(" ")))


def _encoded(part: Column) -> Column:
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical(url: Column) -> Column:
    """One form of all spellings of a page's URL: lower host without www., no slash at the end of the path, no fragment. Parameters
    are decoded and encoded anew; those without a value and those that track are left out, and those of one name stand together
    where the first of them stood."""
    scheme = F.regexp_extract(url, "^([a-zA-Z][a-zA-Z0-9+.\\-]*)://", 1)
    place = F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.\\-]*://([^/?#]*)", 1)
    own_path = F.regexp_replace(path(url), ";[^/]*$", "")
    own_path = F.when(own_path == "/", own_path).otherwise(F.regexp_replace(own_path, "/$", ""))
    given = F.filter(F.split(query(url), "&"), lambda p: p.rlike("^[^=]*=."))
    pairs = F.transform(given, lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("name"), _decoded(F.regexp_replace(p, "^[^=]*=", "")).alias("value")))
    pairs = F.filter(pairs, lambda p: ~F.lower(p["name"]).isin(fixed.TRACKING_PARAMETERS))
    names = F.array_distinct(F.transform(pairs, lambda p: p["name"]))
    together = F.flatten(F.transform(names, lambda n: F.filter(pairs, lambda p: p["name"] == n)))
    rest = F.array_join(F.transform(together, lambda p: F.concat(_encoded(p["name"]), F.lit("="), _encoded(p["value"]))), "&")
    return F.concat(F.lower(scheme), F.lit("://"), F.regexp_replace(F.lower(place), r"^www\.", ""), own_path, F.when(rest != "", F.concat(F.lit("?"), rest)).otherwise(F.lit("")))


def same_site(url: Column, base: Column) -> Column:
    """Whether the URL's host is the base host or below it."""
    own = host(url)
    return (own == base) | own.endswith(F.concat(F.lit("."), base))


def scrapeable(url: Column) -> Column:
    return ~F.lower(path(url)).rlike(r"\.(" + "|".join(fixed.SKIPPED_EXTENSIONS) + ")$")


def product_page(url: Column) -> Column:
    rest = F.when(url.contains("/"), F.regexp_extract(F.regexp_replace(url, "^[^:]*://", ""), "/(.*)$", 1)).otherwise(F.lit(""))
    return F.concat(F.lit("/"), rest).rlike("(?i)" + "|".join(fixed.PRODUCT_URLS))


def page_type(url: Column, kind: str) -> Column:
    own = F.lower(path(url))
    return any_of([own.contains(p) for p in fixed.PAGE_TYPES[kind]])


def priority_page(url: Column) -> Column:
    own = F.lower(path(url))
    return any_of([own.contains(p) for p in fixed.PRIORITY_PATHS])


def social_platform(url: Column) -> Column:
    """The platform whose domain the URL's host is or is below, or null."""
    own = host(url)
    found = [F.when((own == d) | own.endswith("." + d), F.lit(p)) for d, p in fixed.SOCIAL_DOMAINS.items()]
    return F.coalesce(*found)


def ipv4_number(ip: Column) -> Column:
    """An IPv4 address as a number, or null."""
    parts = F.split(ip, r"\.")
    number = reduce(lambda a, k: a * 256 + F.try_element_at(parts, F.lit(k + 1)).try_cast("long"), range(1, 4), F.try_element_at(parts, F.lit(1)).try_cast("long"))
    return F.when(ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), number)


def private_address(ip: Column) -> Column:
    """Whether an address lies in a private network; what is no address does not."""
    number, inside = ipv4_number(ip), []
    for network in fixed.PRIVATE_NETWORKS:
        base, bits = network.split("/")
        if ":" not in network:
            first = sum(int(x) << s for x, s in zip(base.split("."), (24, 16, 8, 0)))
            inside.append(number.between(first, first + 2 ** (32 - int(bits)) - 1))
    low = F.lower(ip)
    return F.coalesce(any_of(inside), F.lit(False)) | (low == "::1") | low.rlike("^f[cd][0-9a-f]{2}:")


def public_url(url: Column, addresses: Column) -> Column:
    """Whether neither the host nor an address that it resolves to is internal."""
    name = F.regexp_replace(F.lower(authority(url)), r":\d+$", "")
    return ~name.isin(fixed.BLOCKED_HOSTS) & ~F.exists(F.coalesce(addresses, F.array().cast("array<string>")), private_address)


def file_prefix(url: Column, index: Column) -> Column:
    """A safe file name for the evidence of the index-th URL, from 0."""
    safe = F.substring(F.regexp_replace(F.regexp_replace(url, "^https?://", ""), "[^a-zA-Z0-9._-]", "_"), 1, 70)
    number = (index + 1).cast("string")
    return F.concat(F.lit("bewijs_"), F.lpad(number, F.greatest(F.lit(3), F.length(number)), F.lit("0")), F.lit("_"), safe)


def html_escaped(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out
