"""Extraction of entities and flags from text, as Column expressions. Results are sorted sets unless said otherwise.
Patterns run with Unicode classes, as (?U) says; null texts yield empty sets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .urls import any_of


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """All matches of a pattern, or of one of its groups."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + pattern), F.lit(group))


def _where(condition: Column, text: Column) -> Column:
    """The texts in which a dear pattern can match at all; null for the others."""
    return F.when(condition, text)


def _found_where(condition: Column, matches: Column) -> Column:
    """What dear patterns match where they can match at all; nothing elsewhere. The condition is tried once for all of them."""
    return F.when(condition, matches).otherwise(F.array().cast("array<string>"))


def _set(*lists: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.array(*lists))))


def _clean_email(x: Column) -> Column:
    return F.trim(F.lower(x), F.lit("."))


def emails(text: Column, html: Column | None = None) -> Column:
    """Addresses in the text and in mailto: links, lower-cased, without those that name an asset file."""
    in_text = F.transform(found(_where(text.contains("@"), text), fixed.EMAIL, 0), _clean_email)
    lists = [in_text]
    if html is not None:
        lists.append(F.filter(F.transform(found(html, "(?i)" + fixed.MAILTO), _clean_email), lambda x: x.contains("@")))
    return F.filter(_set(*lists), lambda x: ~x.rlike(fixed.EMAIL_ASSETS))


def phones(text: Column) -> Column:
    """Dutch and international numbers of ten digits or more, without separators."""
    plain = [F.transform(found(text, p, 0), lambda x: F.regexp_replace(x, r"(?U)[\s\-.]", "")) for p in fixed.PHONES]
    return F.filter(_set(*plain), lambda x: F.length(F.regexp_replace(x, r"\D", "")) >= 10)


def kvk_numbers(text: Column) -> Column:
    return _found_where(text.rlike(r"(?U)\d{8}"), F.filter(_set(*[found(text, p) for p in fixed.KVK_NUMBERS]), lambda x: ~x.startswith("0")))


def vat_numbers(text: Column) -> Column:
    return _found_where(text.rlike(r"(?iU)nl\d{9}b\d{2}"), _set(*[F.transform(found(text, p), F.upper) for p in fixed.VAT_NUMBERS]))


def ibans(text: Column) -> Column:
    return _set(F.transform(found(text, fixed.IBAN, 0), lambda x: F.replace(x, F.lit(" "), F.lit(""))))


def strict_ibans(text: Column) -> Column:
    """A variant for all countries: two letters, two check digits and 11 to 30 more, with a valid checksum."""
    candidates = F.transform(found(text, r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}\b", 0), lambda x: F.replace(x, F.lit(" "), F.lit("")))
    return F.filter(_set(candidates), iban_checksum)


def iban_checksum(iban: Column) -> Column:
    """Whether the check digits agree: the rearranged number is 1 modulo 97."""
    letters = F.split(F.concat(F.substring(iban, 5, 34), F.substring(iban, 1, 4)), "")

    def step(acc: Column, c: Column) -> Column:
        value = F.when(c.rlike("^[0-9]$"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
        return (acc * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(0), step) == 1


def longest_only(items: Column) -> Column:
    """The items that no other item contains."""
    return F.filter(items, lambda x: ~F.exists(items, lambda y: (y != x) & y.contains(x)))


_STREET, _CONTEXT = re.compile(fixed.STREET_ADDRESS), re.compile(fixed.CONTEXT_ADDRESS)


def addresses_in(text: str | None) -> list[str]:
    """addresses of one text."""
    street = (" ".join(p for p in (g.strip(" ") for g in m.groups("")) if p) for m in _STREET.finditer(text or ""))
    context = (" ".join(m[0].split()) for m in _CONTEXT.finditer(text or ""))
    items = {x for x in street if len(x) > 10} | {x for x in context if 10 < len(x) < 120}
    return sorted(x for x in items if not any(x != y and x in y for y in items))


def addresses(text: Column) -> Column:
    """Street addresses by street suffix and by postcode, without those within a longer one. In Python: a long run of words after
    a capital takes more stack than the JVM's matcher has."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(addresses_in)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<string>")(text)


def prices(text: Column) -> Column:
    """All prices, in order."""
    return F.transform(found(text, fixed.PRICE), lambda x: F.replace(x, F.lit(","), F.lit(".")).try_cast("double"))


def suspicious_price(text: Column) -> Column:
    lowest = F.array_min(F.filter(prices(text), lambda p: p > 0))
    return F.coalesce(lowest < fixed.SUSPICIOUS_PRICE, F.lit(False))


def mentions(text: Column, words: list[str], lowered: bool = False) -> Column:
    """Whether any of the words occurs, in any case. A text that is in lower case already (lowered) is not lowered again: with several
    flags of one text, lower it in a projection below."""
    low = text if lowered else F.lower(text)
    return F.coalesce(any_of([low.contains(w) for w in dict.fromkeys(words)]), F.lit(False))


def opening_soon(text: Column, lowered: bool = False) -> Column:
    return mentions(text, fixed.OPENING_SOON, lowered)


def maintenance(text: Column, status: Column | None = None, lowered: bool = False) -> Column:
    spoken = mentions(text, fixed.MAINTENANCE, lowered)
    return spoken if status is None else spoken | F.coalesce(status == 503, F.lit(False))


def delivery_time(text: Column, lowered: bool = False) -> Column:
    return mentions(text, fixed.DELIVERY_TIME, lowered)


def pre_order(text: Column, lowered: bool = False) -> Column:
    return mentions(text, fixed.PRE_ORDER, lowered)


def whatsapp(html: Column, links: Column | None = None) -> Column:
    out = mentions(html, fixed.WHATSAPP)
    if links is None:
        return out
    return out | F.coalesce(F.exists(links, lambda x: any_of([F.lower(x).contains(w) for w in ("wa.me/", "api.whatsapp.com")])), F.lit(False))


def languages(html: Column) -> Column:
    """Two-letter languages of the page and of its alternates, in the order seen."""
    own = F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-zA-Z\-]+)""", 1)
    others = F.regexp_extract_all(html, F.lit(r"""(?is)<link\b[^>]*?\bhreflang\s*=\s*["']?([a-zA-Z\-]+)"""), F.lit(1))
    short = F.transform(F.concat(F.array(own), others), lambda x: F.lower(F.substring_index(x, "-", 1)))
    return F.array_distinct(F.filter(short, lambda x: F.length(x) == 2))


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def visible_text(html: Column) -> Column:
    """Text without scripts, styles and tags, with single spaces; a fast form of html.parse_html's text."""
    out = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</(script|style|noscript)\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def occurrences(text: Column, literal: str) -> Column:
    """How often a literal occurs, in any case."""
    return F.coalesce(F.regexp_count(text, F.lit("(?iu)" + re.escape(literal))), F.lit(0))


def json_list(text: Column) -> Column:
    """A JSON list of strings; a lone value is a list of one, and what cannot be read is empty."""
    parsed = F.from_json(text, "array<string>")
    scalar = F.get_json_object(text, "$")
    single = F.when(text.rlike(r'^\s*("|-?\d|true|false)') & scalar.isNotNull(), F.array(scalar))
    return F.filter(F.coalesce(parsed, single, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))


def json_count(text: Column) -> Column:
    """Elements of a JSON list that are not empty; a lone value counts by itself, and what cannot be read as one."""
    parsed = F.from_json(text, "array<string>")
    scalar = F.trim(text)
    truthy = lambda x: x.isNotNull() & ~x.isin("", "0", "0.0", "false", "[]", "{}")
    return (
        F.when(text.isNull() | (scalar == ""), 0)
        .when(scalar.startswith("["), F.when(parsed.isNotNull(), F.size(F.filter(parsed, truthy))).otherwise(1))
        .when(scalar.isin("null", "0", "0.0", "false", '""', "{}"), 0)
        .otherwise(1)
    )


def duration(ms: Column) -> Column:
    """h:mm:ss or mm:ss of milliseconds, or --:-- without any."""
    s = F.floor(ms / 1000).cast("long")
    h, m, sec = F.floor(s / 3600).cast("long"), F.floor((s % 3600) / 60).cast("long"), s % 60
    shown = F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, sec)).otherwise(F.format_string("%02d:%02d", m, sec))
    return F.when(ms.isNull() | (ms <= 0), F.lit("--:--")).otherwise(shown)


def masked(secret: Column) -> Column:
    """A secret with its last four letters shown; shorter ones are hidden whole."""
    secret = F.coalesce(secret, F.lit(""))
    n = F.length(secret)
    return F.when(n > 4, F.concat(F.repeat(F.lit("*"), n - 4), F.right(secret, F.lit(4)))).otherwise(F.repeat(F.lit("*"), n))
