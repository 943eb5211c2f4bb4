"""Crawls: aggregates over pages, provenance of what was found, running progress, and the order of a crawl."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..sources.shared import cut_lineage


def crawl_aggregate(pages: DataFrame, by: str, sets: list[str], flags: list[str]) -> DataFrame:
    """Per crawl, in one pass over its pages: sorted unions of array columns, any-of of flags, and the numbers of pages without
    and with an error. A value is kept once per crawl and task before values meet."""
    def named(c: str) -> Column:
        return F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.struct(F.lit(c).alias("kind"), x.alias("value")))

    none, found = F.array().cast("array<struct<kind:string,value:string>>"), map(named, sets)
    spread = pages.select(by, *flags, F.col("error").isNull().alias("_ok"), F.posexplode_outer(F.concat(none, *found)).alias("_place", "_found"))
    first = F.coalesce("_place", F.lit(0)) == 0
    once = spread.groupBy(by, F.col("_found.kind").alias("_kind"), F.col("_found.value").alias("_value")).agg(
        *[F.bool_or(f).alias(f) for f in flags], F.count_if(first & F.col("_ok")).alias("pages_crawled"), F.count_if(first & ~F.col("_ok")).alias("pages_failed")
    )
    return once.groupBy(by).agg(
        *[F.array_sort(F.collect_list(F.when(F.col("_kind") == c, F.col("_value")))).alias(c) for c in sets],
        *[F.coalesce(F.bool_or(f), F.lit(False)).alias(f) for f in flags],
        F.sum("pages_crawled").alias("pages_crawled"), F.sum("pages_failed").alias("pages_failed"),
    )


def crawl_errors(pages: DataFrame, by: str) -> DataFrame:
    """pages(by, url, error) -> the failed pages: by, url, error."""
    return pages.filter(F.col("error").isNotNull()).select(by, "url", "error")


def first_seen(values: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Distinct values of each group in the order first seen. values has one row for each occurrence."""
    firsts = values.groupBy(by, value).agg(F.min(order).alias("_first"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("_first", value))), lambda x: x[value])
    return firsts.groupBy(by).agg(listed.alias(value))


def last_wins(pairs: DataFrame, by: str, order: str, key: str, value: str) -> DataFrame:
    """A map for each group with the last value of each key."""
    last = pairs.groupBy(by, key).agg(F.max_by(value, order).alias(value))
    return last.groupBy(by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value)))).alias(value))


def provenance(findings: DataFrame, by: str = "shop_id") -> DataFrame:
    """findings(by, type, value, url) -> by, type, value, urls (sorted): where each value was found."""
    return findings.groupBy(by, "type", "value").agg(F.array_sort(F.collect_set("url")).alias("urls"))


def evidence_pages(sources: DataFrame, home: DataFrame, unplaced: DataFrame, by: str = "shop_id") -> DataFrame:
    """provenance's rows turned round: by, url, findings. Shops of which no value has a page get their values
    (unplaced: by, type, value) under their home page (home: by, url). What was found is stored, as it is read twice."""
    placed = cut_lineage(sources.select(by, F.explode("urls").alias("url"), "type", "value").filter("url <> ''"))
    rest = unplaced.join(placed.select(by).distinct(), by, "left_anti").join(home, by)
    return placed.unionByName(rest.select(by, "url", "type", "value")).groupBy(by, "url").agg(F.sort_array(F.collect_list(F.struct("type", "value"))).alias("findings"))


def running_progress(pages: DataFrame, by: str, order: list[str], counts: dict[str, str]) -> DataFrame:
    """Pages with running totals over a crawl: done, and the sums of the given columns. Pages are dealt by ranges of the order and
    stored so, and each range of a crawl goes on from the totals of those before it: no task has all of a large crawl."""
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut_lineage(pages.repartitionByRange(parts, order[0]).withColumn("_range", F.spark_partition_id()))
    sums = {"done": F.count(F.lit(1)), **{out: F.sum(c) for out, c in counts.items()}}
    earlier = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(by, "_range").agg(*[v.alias(f"_{k}") for k, v in sums.items()])
    before = totals.select(F.col(by).alias("_by"), F.col("_range").alias("_from"), *[F.sum(f"_{k}").over(earlier).alias(f"_{k}") for k in sums])
    window = Window.partitionBy(by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = dealt.withColumns({k: v.over(window) for k, v in sums.items()})
    placed = within.join(before, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_from")))
    whole = {k: F.coalesce(F.col(k) + F.col(f"_{k}"), k, f"_{k}").cast(within.schema[k].dataType) for k in sums}
    return placed.withColumns(whole).drop("_by", "_from", "_range", *[f"_{k}" for k in sums])


def running_distinct(found: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """found(by, order, value, ...) -> by, order, and how many distinct values a crawl has found up to that page. Only a value's first
    page counts, so this is a running total of first finds."""
    firsts = found.groupBy(by, value).agg(F.min(order).alias(order)).groupBy(by, order).agg(F.count("*").alias("_fresh"))
    pages = found.select(by, order).distinct().join(firsts, [by, order], "left").withColumn("_fresh", F.coalesce("_fresh", F.lit(0)))
    return running_progress(pages, by, [order], {"distinct": "_fresh"}).select(by, order, "distinct")


PRIORITY, NORMAL, PRODUCT = 1, 2, 3


#: A site with at most so many links, and bytes of their URLs, is crawled within one task.
TASK_LINKS, TASK_BYTES = 200_000, 64 << 20


def crawl_order(start: DataFrame, links: DataFrame, failed: DataFrame | None = None, max_pages: int = 50, task_links: int = TASK_LINKS) -> DataFrame:
    """The pages that a crawl takes: start(site, url), links(src, dst), failed(url) -> site, url, depth, kind, place (from 1).

    A site has three queues, first in first out: priority pages, others, product pages. A page is taken from the first queue that has
    one; its links within the site, in the order of their URLs, join their queues unless they were in one before. Failed pages
    give no links and use none of the budget of max_pages; product pages end when a fifth of the budget (three at least) was taken.

    Sites of at most task_links links (and TASK_BYTES of URLs) are crawled whole, each in a task of its own, which holds just those links as
    Arrow columns: one shuffle for all of them, however long their chains of pages are. A larger site is crawled over the cluster, in
    rounds (crawl_rounds); the result is the same."""
    edges = links.select(urls.canonical(F.col("src")).alias("src"), urls.canonical(F.col("dst")).alias("dst"))
    edges = cut_lineage(edges.filter(urls.scrapeable(F.col("dst"))).distinct())
    first = start.select("site", urls.canonical(F.col("url")).alias("url")).distinct()
    bad = failed.select(urls.canonical(F.col("url")).alias("url")).distinct() if failed is not None else None
    # A page's links count for each site at or above its host, and for the sites that it begins.
    labels = F.split(urls.host(F.col("src")), r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    inner = edges.withColumn("site", F.explode(above)).join(first.select("site").distinct(), "site")
    begun = edges.join(first, F.col("src") == F.col("url")).select("site", "src", "dst")
    owned = inner.select("site", "src", "dst").union(begun).distinct().filter(urls.same_site(F.col("dst"), F.col("site")))
    rows = cut_lineage(_queue_kind(owned.union(first.select("site", F.lit(None).cast("string"), F.col("url"))), bad))
    length = F.octet_length("dst") + F.coalesce(F.octet_length("src"), F.lit(0))
    sizes = rows.groupBy("site").agg(F.count_if(F.col("src").isNotNull()).alias("_links"), F.sum(length.cast("long")).alias("_bytes"))
    sizes = cut_lineage(sizes.select("site", ((F.col("_links") <= task_links) & (F.col("_bytes") <= TASK_BYTES)).alias("_small")))
    small = rows.join(sizes.filter("_small").select("site"), "site", "left_semi")
    taken = small.groupBy("site").applyInArrow(lambda site: _crawled(site, max_pages), "site string, url string, depth int, kind int, place long")
    large = sizes.filter("not _small").select("site")
    if large.isEmpty():
        return taken
    return taken.union(crawl_rounds(first.join(large, "site", "left_semi"), edges, bad, max_pages))


def _queue_kind(rows: DataFrame, bad: DataFrame | None) -> DataFrame:
    """rows(site, src, dst) with dst's queue, whether it is a product page, and whether it can be read; a first page has no src."""
    product = urls.product_page(F.col("dst"))
    kind = F.when(F.col("src").isNull(), NORMAL).when(urls.priority_page(F.col("dst")), PRIORITY).when(product, PRODUCT).otherwise(NORMAL)
    rows = rows.withColumns({"kind": kind, "product": product})
    return rows.withColumn("ok", F.lit(True)) if bad is None else rows.join(bad.select(F.col("url").alias("dst"), F.lit(False).alias("_ok")), "dst", "left").withColumn("ok", F.coalesce("_ok", F.lit(True))).drop("_ok")


def _crawled(site: pa.Table, max_pages: int) -> pa.Table:
    """One site's crawl over its links. They stay in Arrow columns, sorted; only the links of the pages that are taken become Python values."""
    name = site["site"][0]
    site = site.select(["src", "dst", "kind", "product", "ok"])
    site = site.take(pc.sort_indices(site, sort_keys=[("src", "ascending"), ("dst", "ascending")], null_placement="at_start")).combine_chunks()
    known: dict[str, int] = {}
    queues = {PRIORITY: deque(), NORMAL: deque(), PRODUCT: deque()}
    sources, begins = site["src"], site["src"].null_count

    def links(src: str) -> pa.Table:
        """The run of rows of a page, by halving."""
        ends = []
        for after in (False, True):
            low, high = begins, len(site)
            while low < high:
                middle = (low + high) // 2
                at = sources[middle].as_py()
                low, high = (middle + 1, high) if at < src or after and at == src else (low, middle)
            ends.append(low)
        return site.slice(ends[0], ends[1] - ends[0])

    def enqueue(found: pa.Table, depth: int) -> None:
        for url, kind, product, ok in zip(*[found[c].to_pylist() for c in ("dst", "kind", "product", "ok")]):
            if url not in known:
                known[url] = depth
                queues[kind].append((url, product, ok))

    enqueue(site.slice(0, begins), 0)
    taken, products = [], 0
    while len(taken) < max_pages and (kind := next((k for k in queues if queues[k]), None)):
        if kind == PRODUCT and products >= max(3, max_pages // 5):
            break
        url, product, ok = queues[kind].popleft()
        if ok:
            taken.append((url, known[url], kind, len(taken) + 1))
            products += bool(product)
            enqueue(links(url), known[url] + 1)
    url, depth, kind, place = zip(*taken) if taken else ((), (), (), ())
    columns = {"url": pa.array(url, pa.string()), "depth": pa.array(depth, pa.int32()), "kind": pa.array(kind, pa.int32()), "place": pa.array(place, pa.int64())}
    return pa.table({"site": pa.array([name.as_py()] * len(taken), pa.string()), **columns})


def crawl_rounds(start: DataFrame, edges: DataFrame, bad: DataFrame | None, max_pages: int) -> DataFrame:
    """crawl_order's result for sites of any size: start(site, url), edges(src, dst), bad(url), all canonical and distinct.

    All sites move at once, by whole runs of pages: a priority queue is taken as it stands, and another queue up to the first
    page that brings a link for a queue before it. A round holds each site's links of at most max_pages pages and failed ones. What
    is known is stored after each round. A chain of pages takes a round for each page."""
    site_url, most_products = ["site", "url"], max(3, max_pages // 5)

    def entries(rows: DataFrame) -> DataFrame:
        """Queue rows (site, url, depth, kind, seq) with what is known of their pages."""
        rows = rows.withColumns({"product": urls.product_page(F.col("url")), "taken": F.lit(False), "now": F.lit(False), "place": F.lit(None).cast("long")})
        return rows.withColumn("ok", F.lit(True)) if bad is None else rows.join(bad.withColumn("_bad", F.lit(True)), "url", "left").withColumn("ok", F.col("_bad").isNull()).drop("_bad")

    # now: whether a page was taken in the last round
    columns = ["site", "url", "depth", "kind", "seq", "product", "ok", "taken", "now", "place"]
    known = start.withColumns({"depth": F.lit(0), "kind": F.lit(NORMAL)})
    known = cut_lineage(entries(known.withColumn("seq", F.row_number().over(Window.partitionBy("site").orderBy("url")).cast("long"))).select(columns))
    taken, ok, kind, waiting = F.col("taken"), F.col("ok"), F.col("kind"), ~F.col("taken")
    by_seq = Window.partitionBy("site").orderBy("seq")
    earlier = by_seq.rowsBetween(Window.unboundedPreceding, -1)
    while True:
        sites = known.groupBy("site").agg(
            F.count_if(taken & ok).alias("_pages"), F.count_if(taken & ok & F.col("product")).alias("_products"), F.min(F.when(waiting, kind)).alias("_turn"), F.max("seq").alias("_last")
        )
        turn = known.filter(waiting).join(sites, "site").filter(kind == F.col("_turn")).withColumns({
            "_rank": F.row_number().over(by_seq), "_before": F.coalesce(F.sum(ok.cast("int")).over(earlier), F.lit(0)),
            "_sold": F.coalesce(F.sum((ok & F.col("product")).cast("int")).over(earlier), F.lit(0)),
        })
        turn = turn.filter((F.col("_pages") + F.col("_before") < max_pages) & ((kind < PRODUCT) | (F.col("_products") + F.col("_sold") < most_products)))
        found = turn.filter(ok).join(edges, F.col("url") == F.col("src")).filter(urls.same_site(F.col("dst"), F.col("site")))
        fresh = found.groupBy("site", F.col("dst").alias("url")).agg(F.min(F.struct("_rank", "depth", "_turn", "_last")).alias("_by")).join(known.select(site_url), site_url, "left_anti")
        fresh = fresh.select("site", "url", "_by.*").withColumn("kind", F.when(urls.priority_page(F.col("url")), PRIORITY).when(urls.product_page(F.col("url")), PRODUCT).otherwise(NORMAL))
        ends = fresh.filter(kind < F.col("_turn")).groupBy("site").agg(F.min("_rank").alias("_end"))
        within = F.col("_end").isNull() | (F.col("_rank") <= F.col("_end"))
        took = turn.join(ends, "site", "left").filter(within).select("site", "url", F.when(ok, F.col("_pages") + F.col("_before") + 1).alias("_place"), F.lit(True).alias("_took"))
        order = Window.partitionBy("site").orderBy("_rank", "url")
        joined = fresh.join(ends, "site", "left").filter(within).select("site", "url", (F.col("depth") + 1).alias("depth"), "kind", (F.col("_last") + F.row_number().over(order)).alias("seq"))
        marked = known.drop("now").join(took, site_url, "left").withColumns({"taken": taken | F.col("_took").isNotNull(), "place": F.coalesce("place", "_place"), "now": F.col("_took").isNotNull()})
        known = cut_lineage(marked.select(columns).unionByName(entries(joined).select(columns)))
        if known.filter("now").isEmpty():
            return known.filter(taken & ok).select("site", "url", "depth", "kind", "place")
