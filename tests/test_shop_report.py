"""The whole report of a shop on records with nothing in them, and on odd ones."""

from evidentia.operators import shop_report
from evidentia.sources import schemas


def tables(spark, **rows):
    return {name: spark.createDataFrame(rows.get(name, []), kind) for name, kind in schemas.TABLES.items()}


def record(name, **values):
    """A row of a table in the order of its columns."""
    import re

    columns = [c.split()[0] for c in re.split(r", (?![^<]*>)", schemas.TABLES[name])]
    assert not values.keys() - set(columns)
    return tuple(values.get(c) for c in columns)


def lines(spark, shop=1, **rows):
    shops = spark.createDataFrame([(1,), (2,)], "id long")
    found = shop_report.shop_report(shops, tables(spark, **rows)).filter(f"shop_id = {shop}").collect()
    names = [n for n, _ in shop_report.sections()]
    return [(r.section, r.label, r.value) for r in sorted(found, key=lambda r: (names.index(r.section), r.ord))]


def test_a_shop_without_evidence(spark):
    found = lines(spark, 2, scam=[record("scam", id=1, shop_id=1, flagged=True)])
    assert {s for s, _, _ in found} == {"Samenvatting", "Vragenlijst", "Bedrijfsgegevens", "Betalingen & Bankgegevens", "WHOIS Domeinregistratie"}
    assert ("Betalingen & Bankgegevens", "Betaalmethoden gedetecteerd", "Niet gedetecteerd") in found and ("Vragenlijst", "Talen op de website", "—") in found


def test_records_with_nothing_in_them(spark):
    empty = {name: [record(name, id=1, shop_id=1)] for name in schemas.TABLES if name not in ("shops", "scans", "pages", "status_check")}
    found = lines(spark, **empty)
    assert ("WHOIS Domeinregistratie", "Privacy beschermd", "—") in found and ("KVK Handelsregister", "Actief", "Onbekend") in found
    assert ("DNS Records & HTTP Security", "Aantal redirects", "0") in found and ("Fraudedatabases Check", "Gevonden in", "—") in found
    assert not any(s in ("Adresvalidatie BAG/PDOK", "Social media", "Keurmerk Verificatie") for s, _, _ in found)


def test_lists_sources_and_the_latest_record(spark):
    scrape = [
        record("scrape", id=5, shop_id=1, emails=["b@x.nl", "a@x.nl"], kvk=["1", "2"], iban=["NL1", "be2", "", "ZZ3"], sources={"a@x.nl": ["p4", "p3", "p2", "p1"], "1": ["q1", "q2"], "2": ["q3", "q4"]}, social={"x": "u"}),
        record("scrape", id=4, shop_id=1, emails=["old@x.nl"]),
    ]
    found = lines(spark, scrape=scrape, kvk=[record("kvk", id=2, shop_id=1, kvk_number="22"), record("kvk", id=1, shop_id=1, kvk_number="11", is_active=False)])
    assert [x for x in found if x[0] == "Gevonden contactgegevens"] == [("Gevonden contactgegevens", *x) for x in (("E-mailadres", "b@x.nl"), ("E-mailadres", "a@x.nl"), ("  Gevonden op", "p4, p3, p2"))]
    assert [x[1:] for x in found if x[0] == "Bedrijfsgegevens"] == [("KvK-nummer", "1, 2"), ("  Gevonden op", "q1, q2, q3"), ("BTW-nummer", "—")]
    assert [x[1:] for x in found if x[0].startswith("Betalingen")][1:] == [("IBAN Nederland", "NL1"), ("IBAN België", "be2"), ("IBAN ZZ", "ZZ3")]
    assert [x[2] for x in found if x[1] == "KVK-nummer"] == ["11", "22"] and [x[2] for x in found if x[1] == "Actief"] == ["Nee", "Onbekend"]
