"""Literal cases of the extraction functions, and properties."""

import csv
import io
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidentia.functions import html, text, urls
from evidentia.operators import evidence, filters, latest, risk
from evidentia.sources import ingest, schemas


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("r")).first().r


@pytest.mark.parametrize("given_text, wanted", [
    ("Mail Info@Shop.NL. of logo@2x.png", ["info@shop.nl"]), ("", []), (None, []),
])
def test_emails(spark, given_text, wanted):
    assert one(spark, given_text, text.emails) == wanted


def test_mailto(spark):
    page = '<a href="mailto:Sales@Shop.nl?subject=x">'
    assert one(spark, page, lambda c: text.emails(F.lit(""), c)) == ["sales@shop.nl"]


@pytest.mark.parametrize("given_text, wanted", [
    ("Bel 06-12345678", ["0612345678"]), ("+31 6 12345678", ["+31612345678"]), ("0031612345678", ["0031612345678"]), ("020 123 4567", ["0201234567"]),
    ("tel 1061234567890", []), ("12345", []), ("06 12345678", ["0612345678"]),
])
def test_phones(spark, given_text, wanted):
    assert one(spark, given_text, text.phones) == wanted


@pytest.mark.parametrize("given_text, wanted", [
    ("KvK-nummer: 12345678", ["12345678"]), ("KvK nr. 01234567", []), ("CoC #87654321", ["87654321"]), ("order 12345678", []), ("kvk 123456789", ["23456789"]),
    ("Kamer van Koophandel te Utrecht onder 23456789", ["23456789"]),
])
def test_kvk(spark, given_text, wanted):
    assert one(spark, given_text, text.kvk_numbers) == wanted


def test_ibans(spark):
    assert one(spark, "NL91 ABNA 0417 1643 00", text.ibans) == ["NL91ABNA0417164300"]
    assert one(spark, "DE89 3704 0044 0532 0130 00", text.ibans) == []
    assert one(spark, "DE89 3704 0044 0532 0130 00", text.strict_ibans) == ["DE89370400440532013000"]
    assert one(spark, "DE88 3704 0044 0532 0130 00", text.strict_ibans) == []


@pytest.mark.parametrize("given_text, wanted", [("€ 0,99", True), ("€12,50 of €3", False), ("€ 3,00", False), ("€0", False), ("€1.299,00", True)])
def test_prices(spark, given_text, wanted):
    assert one(spark, given_text, text.suspicious_price) is wanted


def test_html():
    page = "<html lang='nl-NL'><title>A  b</title><script type='application/ld+json'>{\"email\":\"x@y.nl\"}</script><p>Hallo<b>daar<a href='/c#d'>C</a><meta name=description content=D>"
    title, described, body, links, ldjson, metas, langs = html.parse("https://s.nl/x", page)
    assert (title, described, body, links, langs) == ("A b", "D", "Hallo daar C", ["https://s.nl/c"], ["nl"])
    assert ldjson == ['{"email":"x@y.nl"}'] and html.parse(None, None)[2] == ""


def test_structured_data(spark):
    blocks = ['{"@graph":[{"email":"mailto:A@b.nl","address":{"streetAddress":"Weg 1","postalCode":"1234 AB"}}]}', '[{"telephone":"06"},{"vatID":"NL1"}]', "kapot"]
    df = spark.createDataFrame([(blocks,)], "b array<string>").select(html.structured_data(F.col("b")).alias("r"))
    r = df.first().r
    assert (r.emails, r.phones, r.tax_ids, r.addresses) == (["a@b.nl"], ["06"], ["NL1"], ["Weg 1, 1234 AB"])


@given(st.text(max_size=12))
@settings(max_examples=200, deadline=None)
def test_number_filter_never_raises(expression):
    pattern = filters._NUMBER.fullmatch(expression or "")
    assert pattern is None or float(pattern[2]) >= 0


def test_latest_agrees_with_maximum(spark):
    df = spark.createDataFrame([(k, k % 7, str(k)) for k in range(100)], "id long, shop_id long, v string")
    a = latest.latest_by_id(df, "shop_id").select("shop_id", "id", "v").collect()
    b = latest.latest(df, "shop_id", F.col("id").desc()).select("shop_id", "id", "v").collect()
    assert sorted(a) == sorted(b) and all(r.id == max(k for k in range(100) if k % 7 == r.shop_id) for r in a)


def test_canonical_is_idempotent(spark):
    df = spark.createDataFrame([("https://WWW.a.nl/x/?utm_source=1&b=2#c",), ("http://a.nl/",)], "u string")
    twice = df.select(urls.canonical(F.col("u")).alias("a")).select("a", urls.canonical(F.col("a")).alias("b"))
    assert all(r.a == r.b for r in twice.collect())


def test_risk_levels(spark):
    df = spark.createDataFrame([(float(raw),) for raw in (84, 83, 48, 47, 18, 17)], "raw double")
    assert [r.l for r in df.select(risk.level(F.round(F.col("raw") / risk.HIGHEST * 100, 1)).alias("l")).collect()] == ["low", "medium", "medium", "high", "high", "critical"]


def test_fraud_hits(spark):
    schema = "items array<struct<text:string,title:string>>, page string"
    df = spark.createDataFrame([([("a Shop.nl b", "T"), ("x", "Y")], ""), ([], "shop.nl en SHOP.nl"), ([], "shop.nl shop.nl geen resultaten"), ([], "shop.nl")], schema)
    found = [r.h for r in df.select(evidence.fraud_hits(F.col("items"), F.col("page"), F.lit("shop.nl")).alias("h")).collect()]
    assert found == [["T"], ["Domein 2x gevonden in zoekresultaten"], [], []]


@pytest.mark.parametrize("lines, wanted", [
    ("﻿Website,Note\nwww.a.nl,x\n\n b.nl ,y\n", ["www.a.nl", "b.nl"]), ("a.nl\nb.nl", ["a.nl", "b.nl"]), ("Note,URL\nx,https://c.nl\nkort\n", ["https://c.nl"]), ("", []),
])
def test_shop_csv(spark, tmp_path, lines, wanted):
    path = tmp_path / "list.csv"
    path.write_text(lines, encoding="utf-8")
    assert sorted(r.url for r in ingest.read_shop_csv(spark, str(path)).collect()) == sorted(wanted)
    with pytest.raises(ValueError):
        ingest.read_shop_csv(spark, str(tmp_path / "list.txt"))


def test_schemas(spark):
    assert all(schemas.empty(spark, name).columns for name in schemas.TABLES)


def test_import_counts(spark, tmp_path):
    text = '\ufeffnaam,Website ,x\n"Jan, de\n Wit",www.jan.nl,1\n,, \nPiet,https://piet.nl/a,"q ""x"""\nPiet,https://piet.nl/a,2\nP,piet.nl,3\nK,http://known.nl/other,\nU,https://u.nl/exact,\nL,http://localhost/x,\nkort\n'
    path = tmp_path / "shops.csv"
    path.write_bytes(text.encode())
    listed = ingest.read_shop_csv(spark, str(path))
    rows = [r for r in csv.reader(io.StringIO(text.lstrip("\ufeff")))][1:]
    assert sorted(r.url for r in listed.collect()) == sorted(r[1].strip() for r in rows if len(r) > 1 and r[1].strip())
    shops = spark.createDataFrame([("https://known.nl", "Known.nl"), ("https://u.nl/exact", "elders.nl")], "url string, domain string")
    counts = ingest.import_shops(listed, shops, str(tmp_path / "new"))
    assert counts == {"total_processed": 7, "added": 2, "skipped": 4, "errors": 1}
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "new")).collect()) == [("https://piet.nl", "piet.nl"), ("https://www.jan.nl", "jan.nl")]
    assert ingest.import_shops(listed.limit(0), shops, str(tmp_path / "none")) == {"total_processed": 0, "added": 0, "skipped": 0, "errors": 0}
    again = spark.read.parquet(str(tmp_path / "new")).union(shops.select("url", "domain"))
    assert ingest.import_shops(listed, again, str(tmp_path / "again"))["added"] == 0


PIECES = [
    '<a href="/x">', "<A HREF='y'>", "<a href=z>", "</a>", "<", ">", '"', " ", "&amp;", "&lt;a href=q&gt;", "<!--", "-->", "<script>", '<script type="application/ld+json">', "</script>", "<style>", "</style>", '<meta name="d" content="e">',
    '<meta\nname=q content="<a href=w>">', "<meta property='p' content='x'/>", "<p>", "</p>", "<br/>", '<div class="<a href=v>">', "<div '", "<?php a ?>", '<html lang="nl-NL">', '<link rel="alternate" hreflang="en">', "<title>", "</title>",
    "<textarea>", '<abbr title="x">', "<metadata x=\"y\">", "<scripty>", '<p a="b"c="d">', '<p a="b" >', '</p x="<a href=j>">', "</>", "<p:q>", "<noscript>", '{"a":1}', "\n",
]


def test_single_fields_agree_with_the_whole_page():
    rng, names = random.Random(4), list(html.FIELDS)
    for _ in range(4000):
        page = "".join(rng.choices(PIECES, k=rng.randrange(1, 20)))
        whole = html.parse("https://s.nl/d/", page)
        for some in (("links",), ("ldjson", "metas"), ("langs",)):
            assert html._fields(some)("https://s.nl/d/", page) == tuple(whole[names.index(n)] for n in some), page


def test_a_batch_of_pages_is_handed_on_in_parts():
    pages = ["<a href=/x>" * 6000, None, "", "<p>" * 100_000, "<a href=/y>"] * 5
    found = list(html.parsed(iter([(pa.array(["https://s.nl/"] * 25), pa.array(pages)), (pa.array([], pa.string()), pa.array([], pa.string()))]), ("links",)))
    assert len(found) > 5 and [len(x["links"]) for part in found for x in part.to_pylist()] == [6000, 0, 0, 0, 1] * 5


def test_parts_are_joined_to_their_rows(spark):
    rows = [(k, f"https://s.nl/{k}/", f'<title>{k}</title><a href="a">' + "x" * (k % 7 * 50_000)) for k in range(60)] + [(-1, None, None)]
    read = html.parse_html(F.col("url"), F.col("html"))
    some = html.parse_html(F.col("url"), F.col("html"), "links")
    got = spark.createDataFrame(rows, "id int, url string, html string").coalesce(1).select("id", read.alias("p"), some.alias("s")).collect()
    assert sorted((r.id, r.p.title, r.p.links, r.s.links) for r in got) == [(-1, None, [], [])] + [(k, str(k), [f"https://s.nl/{k}/a"], [f"https://s.nl/{k}/a"]) for k in range(60)]


def test_plain_tags_are_passed_over(monkeypatch):
    """Pages read for their blocks and meta tags cost a step for each such tag, not for each tag."""
    seen, handle = [], html._Page.handle_starttag
    monkeypatch.setattr(html._Page, "handle_starttag", lambda self, tag, attrs: (seen.append(tag), handle(self, tag, attrs))[1])
    page = '<p class="x">tekst <b>vet</b></p>' * 500 + '<meta name="kvk" content="12345678"><script type="application/ld+json">{}</script>' + "<i>x</i>" * 500
    assert html._fields(("ldjson", "metas"))("https://s.nl/", page) == (["{}"], [("kvk", "12345678")])
    assert seen == ["meta", "script"]
