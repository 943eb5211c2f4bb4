"""Crawls and URL forms against plain Python, and streams over folders behind a URI."""

import collections
import datetime as dt
import random
import re
import shutil
from pathlib import Path
from urllib.parse import parse_qs, urlencode, urlparse

import pytest
from pyspark.sql import functions as F

from evidentia.functions import fixed, urls
from evidentia.operators import crawl, filters, technology
from evidentia.plans import catalog
from evidentia.sources import shared
from evidentia.streaming import status as streams

PRODUCT = re.compile("|".join(fixed.PRODUCT_URLS), re.IGNORECASE)


def plain_crawl(start: str, links: dict, failed: set, budget: int) -> list[str]:
    """One page after the other from three queues, first in first out."""
    queues, known, taken, products = {1: [], 2: [start], 3: []}, {start}, [], 0
    while any(queues.values()) and len(taken) < budget:
        kind = next(k for k in (1, 2, 3) if queues[k])
        if kind == 3 and products >= max(3, budget // 5):
            break
        url = queues[kind].pop(0)
        if url in failed:
            continue
        taken.append(url)
        products += bool(PRODUCT.search(urlparse(url).path))
        for link in sorted(links.get(url, ())):
            if link not in known:
                known.add(link)
                path = urlparse(link).path.lower()
                queues[1 if any(p in path for p in fixed.PRIORITY_PATHS) else 3 if PRODUCT.search(path) else 2].append(link)
    return taken


@pytest.mark.parametrize(("seed", "task_links"), [(0, 200_000), (1, 200_000), (2, 200_000), (0, 40)])
def test_crawl_order_against_a_plain_crawl(spark, seed, task_links):
    rng = random.Random(seed)
    shapes = ("/a{}", "/b/{}", "/contact/{}", "/faq{}", "/product/{}", "/shop/jas-1000{}", "/help/item/{}")
    sites, rows, failed, wanted = [], [], set(), {}
    for s in range(3):
        site, n = f"s{s}.nl", rng.choice((5, 25, 60))
        pages = [f"https://{site}/"] + [f"https://{site}" + rng.choice(shapes).format(k) for k in range(n)]
        links = collections.defaultdict(set)
        for k, page in enumerate(pages):
            for other in rng.sample(pages, min(len(pages), rng.choice((1, 2, 6)))) + ([pages[k + 1]] if k + 1 < len(pages) and rng.random() < 0.5 else []):
                if other != page:
                    links[page].add(other)
        bad = {p for p in pages[1:] if rng.random() < 0.15}
        sites.append((site, pages[0]))
        rows += [(a, b) for a in links for b in links[a]] + [(pages[0], "https://elders.nl/x"), (pages[0], pages[-1] + "#deel")]
        links[pages[0]].add(pages[-1])
        failed |= bad
        wanted[site] = plain_crawl(pages[0], links, bad, 12)
    found = crawl.crawl_order(
        spark.createDataFrame(sites, "site string, url string"), spark.createDataFrame(rows, "src string, dst string"), spark.createDataFrame([(u,) for u in failed] or [("x",)], "url string"), max_pages=12, task_links=task_links,
    ).collect()
    for site, urls_ in wanted.items():
        assert [r.url for r in sorted((r for r in found if r.site == site), key=lambda r: r.place)] == urls_
        assert [r.place for r in sorted((r for r in found if r.site == site), key=lambda r: r.place)] == list(range(1, len(urls_) + 1))


def plain_canonical(url: str) -> str:
    parts = urlparse(url)
    host, path = parts.netloc.lower().removeprefix("www."), parts.path
    path = path[:-1] if path != "/" and path.endswith("/") else path
    kept = {k: v for k, v in parse_qs(parts.query).items() if k.lower() not in fixed.TRACKING_PARAMETERS}
    return f"{parts.scheme}://{host}{path}" + ("?" + urlencode(kept, doseq=True) if kept else "")


def test_canonical_against_the_standard_library(spark):
    rng = random.Random(7)
    given = ["https://s.nl/x?token=abc=", "https://s.nl/?b=2&a=1&b=3", "https://s.nl/a;v=1?x=1", "https://S.nl/?q=a+b&r=%C3%A9~*-._", "https://s.nl?UTM_Source=x&y=", "https://s.nl/a/?=leeg&&c=%2F%20"]
    for _ in range(300):
        query = "&".join(rng.choice(("a", "b", "utm_source", "GCLID", "q%20x", "é")) + rng.choice(("=", "", "==")) + rng.choice(("", "1", "x y".replace(" ", "+"), "%2B%26", "~*", "a=b", "ü")) for _ in range(rng.randrange(5)))
        given.append(rng.choice(("https://www.Shop.nl", "http://a.b.nl:80", "HTTPS://x.nl")) + rng.choice(("", "/", "/pad/", "/Pad/x", "/p//")) + ("?" + query if query else "") + rng.choice(("", "#top")))
    rows = spark.createDataFrame([(u,) for u in given], "url string").select("url", urls.canonical(F.col("url")).alias("c")).collect()
    for r in rows:
        assert r.c == plain_canonical(r.url), r.url


def test_numbered_places_all_rows(spark):
    rows = spark.createDataFrame([(k, k % 7) for k in range(500)], "id long, v int")
    found = filters.numbered(rows, [F.col("v").desc(), F.col("id")]).collect()
    assert [r.id for r in sorted(found, key=lambda r: r.place)] == sorted(range(500), key=lambda k: (-(k % 7), k)) and sorted(r.place for r in found) == list(range(1, 501))
    assert filters.numbered(rows.limit(0), [F.col("id")]).collect() == []


def test_literal_starts():
    assert technology.literal_start(r"js\.stripe\.com") == ("js.stripe.com", True)
    assert technology.literal_start(r"gtm-[a-z0-9]+") == ("gtm-", False)
    assert technology.literal_start(r"jquery-\d") == ("jquery-", False)
    assert technology.literal_start(r"checkoutshopper.*adyen") == ("checkoutshopper", False)
    assert technology.literal_start(r"colou?r") == ("colo", False)


def test_substring_search_against_a_plain_one(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcAB1é") for _ in range(n))
    ids = [(k % 9, word(rng.choice((1, 2, 3, 4, 6)))) for k in range(80)] + [(1, "İx"), (2, ""), (3, None), (None, "abc"), (4, "not anywhere"), (4, "aaa"), (5, "aaa")]
    texts = [(k % 12, word(rng.randrange(40))) for k in range(40)] + [(1, None), (2, ""), (3, "aaaa" * 500), (3, "aaaa" * 500), (None, "abc")]
    found = technology.shared_ids_by_text(spark.createDataFrame(ids, "shop long, v string"), spark.createDataFrame(texts, "shop long, t string"), "shop", "v", "t")
    wanted = {(a, b, v) for a, v in ids for b, t in texts if v and t and a is not None and b is not None and a != b and v.lower() in t.lower()}
    got = [tuple(r) for r in found.collect()]
    assert set(got) == wanted and len(got) == len(wanted) > 100
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    none = spark.createDataFrame([], "shop long, v string, t string")
    assert technology.shared_ids_by_text(none, none, "shop", "v", "t").collect() == []


def test_streams_read_a_folder_behind_a_uri(spark, tmp_path):
    Path(tmp_path, "in").mkdir()
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(3).write.parquet(f"{tmp_path}/in/events.parquet")
    for name in ("stream_status_latest", "stream_uptime", "stream_progress"):
        by_path = catalog.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
        by_uri = catalog.QUERIES[name](spark, f"file://{tmp_path}/in").collect()
        assert by_path and sorted(map(str, by_path)) == sorted(map(str, by_uri))


def test_an_hour_is_final_and_late_checks_are_left_out(spark, tmp_path):
    schema = "id long, shop_id long, is_online boolean, response_ms double, checked_at timestamp"
    at = lambda h, m=0: dt.datetime(2026, 1, 1, h, m)
    batches = [[(1, 1, True, 1.0, at(9)), (2, 1, False, 1.0, at(9, 30)), (3, 1, True, 1.0, at(12))], [(4, 1, True, 1.0, at(9, 45)), (5, 1, True, 1.0, at(15))], [(6, 1, True, 1.0, at(18))]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/w{k}")
    folder = Path(tmp_path, "in")
    folder.mkdir()
    out = None
    for k in range(3):
        for part in Path(tmp_path, f"w{k}").glob("*.parquet"):
            shutil.copy(part, folder / f"{k}.parquet")
        stream = spark.readStream.schema(schema).parquet(str(folder))
        query = streams.hourly_uptime(stream).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        out = {r.hour.hour: (r.checks, r.online) for r in spark.read.parquet(f"{tmp_path}/out").collect()} if k else None
    assert out[9] == (2, 1) and out[12] == (1, 1) and 18 not in out


def test_a_cluster_must_name_its_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        shared.shared_folder(Session())
