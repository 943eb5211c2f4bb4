"""Operators on small rows and by brute force."""

import re
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import functions as F

from evidentia.functions import fixed, html, text
from evidentia.operators import crawl, latest, technology
from evidentia.plans import catalog
from evidentia.sources import ingest

SF = "/root/testdata/sf0.001"


def test_every_shop_of_a_shared_id_is_named(spark):
    rows = [(1, "a"), (2, "a"), (3, "a"), (3, "a"), (4, "b"), (5, None), (6, None), (None, "b"), (2, "c"), (7, "c")]
    found = technology.shops_of_shared_ids(spark.createDataFrame(rows, "shop long, v string"), "shop", "v").collect()
    assert sorted(tuple(r) for r in found) == [("a", 1, 3), ("a", 2, 3), ("a", 3, 3), ("c", 2, 2), ("c", 7, 2)]


def test_all_pairs_of_shops_of_an_id(spark):
    """Every pair in both directions, also of values cut into many blocks; and as a registered query."""
    rows = [(k % 90, f"v{k % 7 % 4}") for k in range(400)] + [(1, None), (None, "v1"), (5, "lone")]
    given = {(s, v) for s, v in rows if s is not None and v is not None}
    wanted = sorted((s, o, v) for s, v in given for o, w in given if v == w and s != o)
    for block in (1, 7, 2000):
        found = technology.shared_ids(spark.createDataFrame(rows, "shop long, v string"), "shop", "v", block)
        assert found.columns == ["shop", "other", "v"] and sorted(map(tuple, found.collect())) == wanted
    ids = catalog.tracker_rows(spark, SF).select("shop_id", "display_id").distinct().groupBy("display_id").count().collect()
    assert catalog.QUERIES["tracker_xref_pairs"](spark, SF).count() == sum(r["count"] * (r["count"] - 1) for r in ids) > len(ids)


def test_pairs_of_shops_are_read_off_lists(spark):
    """A join of pairs gives a row for a shop and a block, not for a pair; its tasks are not put together by their few bytes."""
    rows = [(f"s{k}", f"v{k % 3}") for k in range(90)] + [("s1", "v0")]
    found = technology.shared_ids(spark.createDataFrame(rows, "shop string, v string"), "shop", "v", 10)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Generate explode\(.*_others", plan.split("Join Inner")[0])
    assert found.rdd.getNumPartitions() >= technology.PAIR_TASKS * spark.sparkContext.defaultParallelism
    given = set(rows)
    assert sorted(map(tuple, found.collect())) == sorted((s, o, v) for s, v in given for o, w in given if v == w and s != o)


def test_each_signature_is_looked_for_once(spark):
    """The categories' query searches a page once for each signature, and finds the same with or without what holds another literal."""
    plan = catalog.QUERIES["tech_by_category"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert [len(re.findall(rf"Contains\(\S+, {x}\)", plan)) for x in ("cloudflare", "vercel", "netlify")] == [1, 1, 1]
    pages = ["mollie.com", "js.mollie", "WC-Cart", "x klarna", 'name="generator" content="wordpress', "checkoutshopper x adyen", "G-ABCDEFGHIJ", "cmplz", ""]
    got = [r.n.split("|") for r in spark.createDataFrame([(p,) for p in pages], "h string").select(technology.detected_names(F.col("h")).alias("n")).collect()]
    wanted = [[name for _, name, patterns, _ in fixed.TECHNOLOGIES if any(re.search(technology.lower_pattern(p), page.lower()) for p in patterns)] for page in pages]
    assert got == [w or [""] for w in wanted] and any(wanted)


def test_crawl_holds_links_as_columns():
    """A site's crawl from rows in any order; links of pages that are not taken stay in Arrow."""
    rows = [("s", None, "https://s.nl/", 2, False, True)] + [("s", f"https://s.nl/{a}", f"https://s.nl/{b}", 2, False, b != "b") for a, b in [("", "b"), ("", "a"), ("a", ""), ("a", "é"), ("b", "x"), ("é", "z"), ("q", "w")]]
    table = pa.Table.from_pylist([dict(zip(("site", "src", "dst", "kind", "product", "ok"), r)) for r in reversed(rows)])
    assert [(r["url"], r["depth"], r["place"]) for r in crawl._crawled(table, 50).to_pylist()] == [("https://s.nl/", 0, 1), ("https://s.nl/a", 1, 2), ("https://s.nl/é", 2, 3), ("https://s.nl/z", 3, 4)]
    assert crawl._crawled(table, 0).num_rows == 0


def test_crawl_follows_a_chain_of_pages(spark):
    pages = ["https://s.nl/", *(f"https://s.nl/lijst/{k}" for k in range(1, 22)), "https://s.nl/contact"]
    links = [*zip(pages, pages[1:]), (pages[9], pages[2]), (pages[-1], pages[0])]
    found = crawl.crawl_order(spark.createDataFrame([("s.nl", pages[0])], "site string, url string"), spark.createDataFrame(links, "src string, dst string")).collect()
    assert {r.url: r.depth for r in found} == {p: k for k, p in enumerate(pages)}
    # The contact page is known only when the last page of the chain was taken, so it comes last.
    assert [r.url for r in sorted(found, key=lambda r: r.place)] == pages


def test_crawl_follows_a_long_chain(spark):
    pages = ["https://s.nl/", *(f"https://s.nl/lijst/{k}" for k in range(1, 200))]
    rows = spark.createDataFrame(list(zip(pages, pages[1:])) + [("https://deep.s.nl/x", "https://s.nl/contact")], "src string, dst string")
    found = crawl.crawl_order(spark.createDataFrame([("s.nl", pages[0])], "site string, url string"), rows, max_pages=150).collect()
    assert [r.url for r in sorted(found, key=lambda r: r.place)] == pages[:150]


def test_as_of_within_one_group_over_many_ranges(spark):
    """One shop has nearly all rows; compared with a plain walk."""
    left = [(k, None if k == 5 else "hot" if k % 50 else "cold", None if k == 7 else k * 3 % 1001) for k in range(3000)]
    right = [(k, None if k == 9 else "hot" if k % 9 else "cold", None if k == 8 else k * 7 % 997, None if k % 4 == 0 else f"v{k}") for k in range(400)]
    found = latest.as_of(spark.createDataFrame(left, "n long, shop string, t long"), spark.createDataFrame(right, "id long, shop string, u long, v string"), "shop", "t", "u", "v", "id")
    assert found.columns == ["n", "shop", "t", "v"]

    def plain(shop, t):
        best = max(((u, i, v) for i, s, u, v in right if s == shop and s is not None and u is not None and t is not None and u <= t), key=lambda x: x[:2], default=None)
        return best and best[2]

    got = {r.n: (r.shop, r.t, r.v) for r in found.collect()}
    assert got == {n: (s, t, plain(s, t)) for n, s, t in left}
    assert "_range" in found._jdf.queryExecution().optimizedPlan().toString()


def read(spark, name):
    """The rows of a query over the whole table, and those of a table."""
    return [tuple(r) for r in catalog.QUERIES[name](spark, SF).collect()]


def test_addresses_of_whole_texts(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()} | dict(catalog.ENTITY_TEXTS)
    wanted = {}
    for k, t in texts.items():
        street = [" ".join(p for p in (g.strip(" ") for g in m.groups("")) if p) for m in re.finditer(fixed.STREET_ADDRESS, t)]
        near = [" ".join(m[0].split()) for m in re.finditer(fixed.CONTEXT_ADDRESS, t)]
        items = {x for x in street if len(x) > 10} | {x for x in near if 10 < len(x) < 120}
        wanted[k] = "|".join(sorted(x for x in items if not any(x != y and x in y for y in items)))
    found = read(spark, "addresses_of_documents")
    assert len(found) == len(texts) and dict(found) == wanted and any(wanted.values())


def test_links_of_whole_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    links = sorted([(p.page_id, u) for p in pages for u in (p.url, *html.parse(p.url, p.html)[3])] + [(-1, c[0]) for c in (*catalog.CANONICAL, *catalog.SOCIAL)])

    def canonical(url):
        scheme, host, path, query = re.match(r"(?s)(?:([a-zA-Z][a-zA-Z0-9+.\-]*)://([^/?#]*))?([^?#]*)(?:\?([^#]*))?", url).groups("")
        kept = [q for q in query.split("&") if "=" in q and q.split("=")[0].lower() not in fixed.TRACKING_PARAMETERS and q.split("=")[-1]]
        return f"{scheme.lower()}://{re.sub('^www[.]', '', host.lower())}{path if path == '/' else path.removesuffix('/')}{'?' if kept else ''}{'&'.join(kept)}"

    def platform(url):
        own = re.sub("^www[.]", "", (urlsplit(url).hostname or ""))
        return next((p for d, p in fixed.SOCIAL_DOMAINS.items() if own == d or own.endswith("." + d)), None)

    assert sorted(read(spark, "canonical_of_links")) == [(k, u, canonical(u)) for k, u in links] and len(links) > len(pages)
    assert sorted(read(spark, "social_of_links")) == [(k, u, platform(u)) for k, u in links]


def test_identities_of_whole_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    shopify = {p.page_id: p.html or "" for p in pages} | {-r[0]: r[1] for r in catalog.SHOPIFY}
    found = {r[0]: r[1:] for r in read(spark, "shopify_of_pages")}
    assert found == {k: tuple("|".join(sorted(set(re.findall(x, t)))) for x in fixed.SHOPIFY_IDENTITIES.values()) for k, t in shopify.items()}


def test_addresses_after_a_long_run_of_words(spark):
    row = ("Dit " + "zijn woorden " * 20_000 + ". Dorpsstraat 12, 1234 AB Utrecht",)
    frame = spark.createDataFrame([row, (None,), ("Dorpsstraat 12",)], "t string")
    found = [r.a for r in frame.select(text.addresses(frame["t"]).alias("a")).collect()]
    assert found == [["Dorpsstraat 12 1234 AB Utrecht", "Dorpsstraat 12, 1234 AB Utrecht"], [], ["Dorpsstraat 12"]]


def test_running_progress_over_ranges(spark):
    rows = [(None if k % 7 == 0 else "hot" if k % 7 < 5 else "b", None if k == 50 else k, None if k < 20 or k % 11 == 0 else k % 13) for k in range(400)]
    found = crawl.running_progress(spark.createDataFrame(rows, "shop string, page int, n int"), "shop", ["page"], {"chars": "n"})
    assert found.columns == ["shop", "page", "n", "done", "chars"]
    wanted, done, chars = [], {}, {}
    for shop, page, n in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        done[shop] = done.get(shop, 0) + 1
        chars[shop] = chars.get(shop) if n is None else (chars.get(shop) or 0) + n
        wanted.append((shop, page, n, done[shop], chars[shop]))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(wanted, key=repr)
    assert "_range" in found._jdf.queryExecution().optimizedPlan().toString()


def test_exports_have_a_file_for_each_partition(spark, tmp_path):
    ingest.write_export(spark.range(0, 100, 1, 4), str(tmp_path / "export"))
    assert len(list((tmp_path / "export").glob("*.csv"))) == 4 and spark.read.csv(str(tmp_path / "export"), header=True).count() == 100
