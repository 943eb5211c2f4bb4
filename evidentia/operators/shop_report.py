"""The whole report of each shop as rows: (shop_id, section, ord, label, value), the sections and lines in their order. Rendering is left to the
reader of the rows. Evidence is read as sources/schemas.py has it; of each kind a shop's latest record counts, of register entries all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, urls
from .latest import latest_by_id
from .overview import yes_no
from .report import lookup

NONE = "—"
LINES = "array<struct<label:string,value:string>>"
#: Fixed labels of the report.
CATEGORY_LABELS = {"analytics": "Analytics", "payment": "Betaalmethoden", "privacy": "Cookie consent", "trustmark": "Keurmerken", "framework": "Frameworks", "hosting": "Hosting/CDN", "security": "Beveiliging", "ecommerce": "E-commerce", "cms": "CMS"}
TRUSTMARK_STATUSES = {"verified": "Geverifieerd", "found": "Gevonden", "not_found": "Niet gevonden", "check_failed": "Controle mislukt", "likely_verified": "Waarschijnlijk"}
SOURCES_SHOWN, HITS_SHOWN, PARTNERS_SHOWN = 3, 2, 5


def _line(label: str | Column, value: Column) -> Column:
    label = F.lit(label) if isinstance(label, str) else label
    shown = value.cast("string")
    return F.struct(label.alias("label"), F.when(shown.isNull() | (shown == ""), NONE).otherwise(shown).alias("value"))


def _lines(*lines: Column) -> Column:
    return F.array(*lines).cast(LINES)


def _none() -> Column:
    return F.array().cast(LINES)


def _each(items: Column, line) -> Column:
    return F.coalesce(F.transform(items, line).cast(LINES), _none())


def _listed(items: Column) -> Column:
    return F.array_join(F.filter(items, lambda x: x.isNotNull() & (x != "")), ", ")


def _count(items: Column) -> Column:
    return F.when(items.isNull(), 0).otherwise(F.size(items))


def _unsure(value: Column, unknown: str) -> Column:
    return F.when(value, "Ja").when(~value, "Nee").otherwise(unknown)


def _with_sources(items: Column, sources: Column, label: str) -> Column:
    """A line for each value, and one with up to SOURCES_SHOWN of the pages that it was found on."""
    def lines(x: Column) -> Column:
        pages = F.slice(F.coalesce(F.try_element_at(sources, x), F.array().cast("array<string>")), 1, SOURCES_SHOWN)
        return F.when(F.size(pages) > 0, F.array(_line(label, x), _line("  Gevonden op", F.array_join(pages, ", ")))).otherwise(F.array(_line(label, x))).cast(LINES)

    return F.coalesce(F.flatten(F.transform(items, lines)), _none())


def _sources_line(items: Column, sources: Column) -> Column:
    """One line with pages of several values, as of register numbers."""
    pages = F.slice(F.flatten(F.transform(items, lambda x: F.coalesce(F.try_element_at(sources, x), F.array().cast("array<string>")))), 1, SOURCES_SHOWN)
    return F.when(F.size(pages) > 0, _lines(_line("  Gevonden op", F.array_join(pages, ", ")))).otherwise(_none())


def sections() -> list[tuple[str, Column]]:
    """(name, lines) of each section over a row with a struct of each kind of evidence; a section without lines does not appear."""
    s, whois, ssl, dns, tech, marks, ads, scam, bag = (F.col(k) for k in ("scrape", "whois", "ssl", "dns_http", "tech", "trustmark", "ad_tracker", "scam", "bag_validation"))
    given = lambda record, lines: F.when(record.isNotNull(), lines).otherwise(_none())
    pages = s["sources"]
    flags = [("Binnenkort geopend?", "is_opening_soon"), ("In onderhoud?", "is_maintenance"), None, ("Levertijd vermeld?", "has_delivery_time"), ("Pre-orders mogelijk?", "has_preorder"), ("Contact via WhatsApp?", "has_whatsapp"), ("Verdacht lage prijzen?", "has_suspicious_prices")]
    languages = _line("Talen op de website", F.array_join(F.transform(s["languages"], lambda c: lookup(c, fixed.LANGUAGE_NAMES)), ", "))
    countries = F.array_sort(F.transform(F.filter(s["iban"], lambda x: x != ""), lambda x: F.struct((F.upper(F.left(x, F.lit(2))) != "NL").alias("o"), F.upper(F.left(x, F.lit(2))).alias("c"), x.alias("x"))))
    ibans = _each(countries, lambda i: _line(F.concat(F.lit("IBAN "), lookup(i["c"], fixed.COUNTRY_NAMES)), i["x"]))
    hops, first, last = dns["redirects"], F.try_element_at(dns["redirects"], F.lit(1))["url"], F.try_element_at(dns["redirects"], F.lit(-1))["url"]
    turned = F.size(F.filter(hops, lambda h: h["status_code"].between(300, 399)))
    kinds = F.map_entries(tech["technologies"])
    by_kind = _each(F.filter(kinds, lambda e: F.size(e["value"]) > 0), lambda e: _line(F.coalesce(lookup_label(e["key"], CATEGORY_LABELS), e["key"]), F.array_join(e["value"], ", ")))
    mark_line = lambda v: _line(v["name"], F.concat(F.coalesce(lookup_label(v["status"], TRUSTMARK_STATUSES), v["status"]), F.when(v["claimed"] & ~v["verified"], " (geclaimd, niet geverifieerd)").otherwise("")))
    kvk_lines = lambda k: F.array(
        _line("KVK-nummer", k["kvk_number"]), _line("Bedrijfsnaam", k["company_name"]), _line("Rechtsvorm", k["legal_form"]), _line("Adres", F.concat_ws(" ", F.nullif(k["street"], F.lit("")), F.nullif(k["house_number"], F.lit("")))),
        _line("Plaats", F.concat_ws(" ", F.nullif(k["postal_code"], F.lit("")), F.nullif(k["city"], F.lit("")))), _line("Actief", _unsure(k["is_active"], "Onbekend")),
    ).cast(LINES)
    partners = F.transform(F.array_sort(F.array_distinct(F.transform(ads["cross_references"], lambda r: r["id"]))), lambda i: F.struct(i.alias("id"), F.slice(F.array_sort(F.transform(F.filter(ads["cross_references"], lambda r: r["id"] == i), lambda r: r["shop_id"])), 1, PARTNERS_SHOWN).alias("shops")))
    hit = F.filter(scam["checks"], lambda c: c["found"])
    return [
        ("Samenvatting", _lines(
            _line("E-mailadressen gevonden", _count(s["emails"])), _line("Telefoonnummers gevonden", _count(s["phones"])), _line("Adressen gevonden", _count(s["addresses"])), _line("Contactpagina", yes_no(s["has_contact"])),
            _line("Privacybeleid", yes_no(s["has_privacy"])), _line("Algemene voorwaarden", yes_no(s["has_terms"])), _line("Retourbeleid", yes_no(s["has_return"])))),
        ("Vragenlijst", _lines(*[languages if f is None else _line(f[0], yes_no(s[f[1]])) for f in flags])),
        ("Bedrijfsgegevens", F.concat(_lines(_line("KvK-nummer", _listed(s["kvk"]))), F.coalesce(_sources_line(s["kvk"], pages), _none()), _lines(_line("BTW-nummer", _listed(s["btw"]))), F.coalesce(_sources_line(s["btw"], pages), _none()))),
        ("Betalingen & Bankgegevens", F.concat(_lines(_line("Betaalmethoden gedetecteerd", F.coalesce(F.nullif(_listed(tech["payment_providers"]), F.lit("")), F.lit("Niet gedetecteerd")))), ibans)),
        ("WHOIS Domeinregistratie", F.when(whois.isNull(), _lines(_line("WHOIS", F.lit("Geen WHOIS-data beschikbaar")))).otherwise(_lines(
            _line("Registrar", whois["registrar"]), _line("Land", whois["registrant_country"]), _line("Geregistreerd", whois["registration_date"]), _line("Vervalt", whois["expiration_date"]),
            _line("Domeinleeftijd", F.when(whois["domain_age_days"] != 0, F.concat(whois["domain_age_days"].cast("string"), F.lit(" dagen")))), _line("Privacy beschermd", _unsure(whois["is_privacy_protected"], NONE)), _line("Naamservers", _listed(whois["name_servers"]))))),
        ("SSL Certificaat", given(ssl, _lines(
            _line("SSL actief", yes_no(ssl["has_ssl"])), _line("Uitgever", ssl["issuer"]), _line("Geldig vanaf", F.date_format(ssl["valid_from"], "yyyy-MM-dd")), _line("Geldig tot", F.date_format(ssl["valid_until"], "yyyy-MM-dd")),
            _line("Verlopen", yes_no(ssl["is_expired"])), _line("Self-signed", yes_no(ssl["is_self_signed"]))))),
        ("DNS Records & HTTP Security", given(dns, _lines(
            _line("A records", _listed(dns["a_records"])), _line("MX (e-mail)", yes_no(dns["has_mx"])), _line("SPF", yes_no(dns["has_spf"])), _line("DMARC", yes_no(dns["has_dmarc"])), _line("Security headers score", F.concat(F.coalesce(dns["security_score"], F.lit(0)).cast("string"), F.lit("%"))),
            _line("HTTP → HTTPS redirect", yes_no(first.startswith("http://") & last.startswith("https://"))), _line("Aantal redirects", F.greatest(turned, F.lit(0))), _line("Domein wijzigt bij redirect", yes_no(urls.host(first) != urls.host(last)))))),
        ("Technologie Detectie", given(tech, F.concat(
            F.when(tech["ecommerce_platform"] != "", _lines(_line("E-commerce platform", tech["ecommerce_platform"]))).otherwise(_none()), F.when(tech["cms"] != "", _lines(_line("CMS", tech["cms"]))).otherwise(_none()), by_kind))),
        ("Keurmerk Verificatie", given(marks, _each(marks["verifications"], mark_line))),
        ("KVK Handelsregister", F.coalesce(F.flatten(F.transform(F.col("kvk"), kvk_lines)), _none())),
        ("Advertentie Trackers", given(ads, F.concat(
            _each(ads["trackers"], lambda t: _line(t["platform"], t["display_id"])), _each(partners, lambda p: _line(F.concat(F.lit("Cross-referentie "), p["id"]), F.array_join(F.transform(p["shops"], lambda x: x.cast("string")), ", ")))))),
        ("Fraudedatabases Check", given(scam, F.concat(
            _lines(_line("In fraudedatabase gevonden", yes_no(scam["flagged"])), _line("Aantal meldingen", F.coalesce(scam["total_hits"], F.lit(0))), _line("Gevonden in", _listed(F.transform(hit, lambda c: c["source"])))),
            _each(hit, lambda c: _line(c["source"], F.concat(c["count"].cast("string"), F.lit(": "), F.coalesce(F.nullif(F.array_join(F.slice(c["hits"], 1, HITS_SHOWN), " | "), F.lit("")), F.lit(NONE)))))))),
        ("Gevonden contactgegevens", F.concat(_with_sources(s["emails"], pages, "E-mailadres"), _with_sources(s["phones"], pages, "Telefoonnummer"), _with_sources(s["addresses"], pages, "Adres"))),
        ("Adresvalidatie BAG/PDOK", F.when(bag["addresses_checked"] > 0, F.concat(
            _lines(_line("Gecontroleerde adressen", bag["addresses_checked"]), _line("Geldig (in BAG)", bag["addresses_valid"]), _line("Ongeldig / niet gevonden", bag["addresses_invalid"])),
            _each(bag["results"], lambda r: _line(r["address"], F.when(r["valid"], "✓ Geldig").when(~r["valid"], "✗ Niet gevonden").otherwise("? Onbekend"))))).otherwise(_none())),
        ("Social media", F.coalesce(F.transform(F.map_entries(s["social"]), lambda e: _line(e["key"], e["value"])).cast(LINES), _none())),
    ]


def lookup_label(code: Column, names: dict[str, str]) -> Column:
    return reduce(lambda rest, pair: F.when(code == pair[0], pair[1]).otherwise(rest), names.items(), F.lit(None).cast("string"))


def shop_report(shops: DataFrame, evidence: dict[str, DataFrame]) -> DataFrame:
    """shops(id) with the report of each: shop_id, section, ord (from 0 within the section), label, value. evidence: tables by the names of
    sources/schemas.py. One join for each kind, on the shop; a shop's register entries are one list."""
    out = shops.select(F.col("id").alias("shop_id"))
    for name in ("scrape", "whois", "ssl", "dns_http", "tech", "trustmark", "ad_tracker", "scam", "bag_validation"):
        rows = evidence[name]
        maps = [c for c, kind in rows.dtypes if kind.startswith("map")]
        # Maps have no order, so they go beside the greatest id as lists of entries.
        plain = rows.withColumns({c: F.map_entries(c) for c in maps}) if maps else rows
        best = latest_by_id(plain, "shop_id")
        best = best.withColumns({c: F.map_from_entries(c) for c in maps}) if maps else best
        out = out.join(best.select("shop_id", F.struct(*[c for c in best.columns if c != "shop_id"]).alias(name)), "shop_id", "left")
    entries = evidence["kvk"].groupBy("shop_id").agg(F.sort_array(F.collect_list(F.struct("id", *[c for c in evidence["kvk"].columns if c not in ("id", "shop_id")]))).alias("kvk"))
    out = out.join(entries, "shop_id", "left")
    parts = [F.struct(F.lit(k).alias("k"), F.lit(name).alias("section"), lines.alias("lines")) for k, (name, lines) in enumerate(sections())]
    spread = out.select("shop_id", F.explode(F.array(*parts)).alias("p")).select("shop_id", "p.section", F.posexplode("p.lines").alias("ord", "l"))
    return spread.select("shop_id", "section", "ord", "l.label", "l.value")
