"""Technology signatures and tracker ids in pages."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.urls import any_of
from ..sources.shared import cut_lineage


def lower_pattern(pattern: str) -> str:
    """A signature as it is matched against lower-cased pages: the pattern in lower case, its classes kept."""
    return re.sub(r"\\[A-Za-z]|[^\\]", lambda m: m[0] if m[0].startswith("\\") else m[0].lower(), pattern)


def literal_start(pattern: str) -> tuple[str, bool]:
    """The literal text that a pattern begins with, and whether that is all of it."""
    out, k = "", 0
    while k < len(pattern):
        if pattern[k] == "\\" and k + 1 < len(pattern) and not pattern[k + 1].isalnum():
            out, k = out + pattern[k + 1], k + 2
        elif pattern[k] in "\\.[](){}*+?|^$":
            return (out[:-1] if pattern[k] in "*+?{" else out), False
        else:
            out, k = out + pattern[k], k + 1
    return out, True


def signature(low: Column, patterns: list[str]) -> Column:
    """Whether any pattern matches a lower-cased page. Most are literals and looked for as such; a true pattern runs only on pages that
    hold its literal beginning."""
    hits, starts = [], {p: literal_start(p) for p in map(lower_pattern, patterns)}
    literals = {start for start, whole in starts.values() if whole}
    for pattern, (start, whole) in starts.items():
        # What holds another literal of the list within it adds nothing.
        if any(x in start and (x != start or not whole) for x in literals):
            continue
        hits.append(low.contains(start) if whole else low.contains(start) & low.rlike(pattern))
    return any_of(hits)


def signatures(html: Column, headers: Column | None = None, lowered: bool = False) -> list[tuple[str, str, Column]]:
    """(category, name, whether the page or one of its headers, as "name: value", shows it) in the order of the signature table."""
    low, lines, out = html if lowered else F.lower(html), None, []
    if headers is not None:
        lines = F.lower(F.array_join(F.transform(F.map_entries(headers), lambda e: F.concat_ws(": ", e["key"], e["value"])), "\n"))
    for category, name, patterns, marks in fixed.TECHNOLOGIES:
        hit = F.coalesce(signature(low, patterns), F.lit(False))
        if lines is not None and marks:
            hit = hit | F.coalesce(any_of([lines.contains(m.lower()) for m in marks]), F.lit(False))
        out.append((category, name, hit))
    return out


def detected(html: Column, headers: Column | None = None, lowered: bool = False) -> Column:
    """The technologies of a page in the order of the signature table: array<struct<number, category, name>>. All signatures run in
    one projection and no page is joined to the table; give a page in lower case (lowered) from a projection below."""
    none = F.array().cast("array<struct<number:int,category:string,name:string>>")
    entry = lambda k, c, n: F.array(F.struct(F.lit(k).alias("number"), F.lit(c).alias("category"), F.lit(n).alias("name")))
    return F.concat(*[F.when(hit, entry(k, category, name)).otherwise(none) for k, (category, name, hit) in enumerate(signatures(html, headers, lowered))])


def detected_names(html: Column, headers: Column | None = None, sign: str = "|", lowered: bool = False) -> Column:
    """The names of a page's technologies, joined."""
    return F.concat_ws(sign, *[F.when(hit, F.lit(name)) for _, name, hit in signatures(html, headers, lowered)])


def first_of(found: Column, category: str) -> Column:
    """The first technology of a category, or null."""
    return F.try_element_at(F.filter(found, lambda x: x["category"] == category), F.lit(1))["name"]


def by_category(found: Column) -> Column:
    """category -> names, in the order of the signature table."""
    def grouped(all_: Column) -> Column:
        def names(category: str) -> Column:
            return F.transform(F.filter(all_, lambda x: x["category"] == category), lambda x: x["name"])

        pairs = [F.struct(F.lit(c).alias("k"), names(c).alias("v")) for c in dict.fromkeys(t[0] for t in fixed.TECHNOLOGIES)]
        return F.map_from_entries(F.filter(F.array(*pairs), lambda p: F.size(p["v"]) > 0))

    # What was found is bound once: written out for each category, it would search the page for all signatures again.
    return F.get(F.transform(F.array(found), grouped), F.lit(0))


def shopify_identities(html: Column) -> Column:
    """Names by which a Shopify page gives its shop away: a struct of sorted sets."""
    return F.struct(*[F.array_sort(F.array_distinct(F.regexp_extract_all(html, F.lit(p)))).alias(k) for k, p in fixed.SHOPIFY_IDENTITIES.items()])


def tracker_ids(html: Column) -> Column:
    """Tracker ids of a page: distinct array<struct<platform, id, display_id>>; a shown id has its platform's
    prefix once."""
    def identified(platform: str, prefix: str, pattern: str) -> Column:
        def entry(x: Column) -> Column:
            shown = F.when(x.startswith(prefix), x).otherwise(F.concat(F.lit(prefix), x))
            return F.struct(F.lit(platform).alias("platform"), x.alias("id"), shown.alias("display_id"))

        return F.transform(F.regexp_extract_all(html, F.lit("(?U)" + pattern)), entry)

    lists = [identified(platform, prefix, p) for platform, _, prefix, patterns in fixed.TRACKERS for p in patterns]
    return F.array_distinct(F.flatten(F.array(*lists)))


def tracker_totals(pages: DataFrame, by: str) -> DataFrame:
    """Per shop: platforms with an id, and distinct shown ids. pages(by, trackers)."""
    ids = pages.select(by, F.explode("trackers").alias("t"))
    return ids.groupBy(by).agg(F.countDistinct("t.platform").alias("platforms"), F.countDistinct("t.display_id").alias("ids"))


#: A value's shops are cut into blocks of about so many; each two blocks meet in a place of their own.
BLOCK_SHOPS = 2_000
#: Tasks that make pairs, for each core: the input of such a task is small, so by its bytes too few would be made of them.
PAIR_TASKS = 32


def shared_ids(ids: DataFrame, shop: str, value: str, block: int = BLOCK_SHOPS) -> DataFrame:
    """Pairs of shops that have a value in common, in both directions and each once: shop, other, value. A value of n shops gives
    n * (n - 1) rows, the square by nature; for values that many shops have, shops_of_shared_ids names the same partners in n rows.

    Pairs are made block by block: a value's shops are dealt into n / block blocks, and each two of these are a key of the join, so that no task
    holds or makes all pairs of a large value and none has more than about block shops in memory for a key. A shop meets a block as one
    list, and its pairs are read off that list: joined row by row, a pair takes two to three times as long."""
    spark = ids.sparkSession
    once = ids.select(F.col(value), F.col(shop)).filter(F.col(value).isNotNull() & F.col(shop).isNotNull()).distinct()
    sizes = once.groupBy(value).agg(F.count("*").alias("_shops")).filter("_shops > 1")
    dealt = once.join(sizes, value).withColumn("_blocks", F.ceil(F.col("_shops") / block).cast("int"))
    dealt = dealt.withColumn("_own", F.pmod(F.xxhash64(shop), F.col("_blocks")).cast("int"))
    meets = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    left = dealt.select(value, shop, F.col("_own").alias("_left"), meets.alias("_right"))
    lists = dealt.groupBy(value, "_blocks", F.col("_own").alias("_right")).agg(F.collect_list(shop).alias("_others"))
    right = lists.select(value, "_right", "_others", meets.alias("_left"))
    # A number of tasks that is given is kept; parts of a few MB would be put together, though each gives many millions of pairs.
    keys, tasks = [value, "_left", "_right"], max(int(spark.conf.get("spark.sql.shuffle.partitions")), PAIR_TASKS * spark.sparkContext.defaultParallelism)
    met = left.repartition(tasks, *keys).join(right.repartition(tasks, *keys).hint("merge"), keys)
    return met.select(shop, F.explode(F.array_remove("_others", F.col(shop))).alias("other"), value)


def shops_by_id(ids: DataFrame, shop: str, value: str) -> DataFrame:
    """For each value in several shops, the number of shops and the least and greatest of them: the size of a
    cross-reference without its pairs."""
    return ids.groupBy(value).agg(F.countDistinct(shop).alias("shops"), F.min(shop).alias("first_shop"), F.max(shop).alias("last_shop")).filter("shops > 1")


def shops_of_shared_ids(ids: DataFrame, shop: str, value: str) -> DataFrame:
    """One row for each shop of a value that several shops have: value, shop and the value's number of shops. Shops
    with the same value are each other's partners, so this is the whole cross-reference without its pairs."""
    once = ids.select(F.col(value), F.col(shop)).filter(F.col(value).isNotNull() & F.col(shop).isNotNull()).distinct()
    shared = once.groupBy(value).agg(F.count(shop).alias("shops")).filter("shops > 1")
    return once.join(shared, value).select(value, shop, "shops")


#: Bytes of a gram; grams of three, two and one bytes are numbered one after the other.
GRAM = 3
_FIRST_OF_SIZE = {3: 0, 2: 1 << 24, 1: (1 << 24) + (1 << 16)}
GRAMS = (1 << 24) + (1 << 16) + (1 << 8)
#: Bytes of text whose grams are made at once; a longer text is handled alone.
_TEXT_BYTES = 1 << 20


def _gram_rows(sizes: list[int], asked: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, text) -> (key, gram): the different grams of each text, of several sizes; only those asked for, if a table is given."""
    def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        octets = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64)
        of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        found = []
        for size in sizes:
            n = max(len(octets) - size + 1, 0)
            code = sum((octets[k : k + n] << (8 * k) for k in range(size)), np.full(n, _FIRST_OF_SIZE[size]))
            fits = of[:n] == of[size - 1 : size - 1 + n]
            fits &= True if asked is None else asked[code]
            found.append(of[:n][fits] * GRAMS + code[fits])
        both = np.unique(np.concatenate(found))
        return both // GRAMS, both % GRAMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_numpy(zero_copy_only=False), [(t or "").encode() for t in batch.column(1).to_pylist()]
            first = 0
            while first < len(texts):
                last, size = first + 1, len(texts[first])
                while last < len(texts) and size + len(texts[last]) <= _TEXT_BYTES:
                    size, last = size + len(texts[last]), last + 1
                of, gram = grams(texts[first:last])
                yield pa.RecordBatch.from_arrays([pa.array(keys[first:last][of]), pa.array(gram.astype(np.int32))], ["key", "gram"])
                first = last

    return run


def texts_of_values(values: DataFrame, value: str, texts: DataFrame, key: str, text: str) -> DataFrame:
    """Which texts contain which values, in any case: (value, key), each once, for lists and texts of any length. Empty values name nothing and are
    left out.

    Texts are posted under their grams of three bytes (values of one or two bytes under grams of theirs). A value is looked up under the
    rarest of its grams only, and confirmed on the text; a value with a gram that no text has is done at once. Grams that no
    value has are left out before anything is shuffled, by a table with a bit for every gram there can be."""
    names = values.select(F.col(value).alias("_value"), F.lower(value).alias("_low")).filter("_low <> ''").distinct()
    needles = cut_lineage(names.select("_low").distinct().select("_low", F.xxhash64("_low").alias("_needle"), F.least(F.octet_length("_low"), F.lit(GRAM)).alias("_size")))
    sizes = sorted(r[0] for r in needles.select("_size").distinct().collect())
    hay = texts.select(F.col(key).alias("_key"), F.lower(text).alias("_text")).filter("_text is not null")
    hay = hay.withColumn("_hay", F.xxhash64("_key", "_text"))
    if not sizes:
        return names.select(F.col("_value").alias(value)).join(hay.select(F.col("_key").alias(key)).limit(0), F.lit(True))
    parts = [needles.filter(F.col("_size") == k).select("_needle", "_low").mapInArrow(_gram_rows([k], None), "key long, gram int") for k in sizes]
    wanted = cut_lineage(reduce(lambda x, y: x.union(y), parts))
    asked = np.zeros(GRAMS, bool)
    asked[[r[0] for r in wanted.select("gram").distinct().collect()]] = True
    posted = cut_lineage(hay.select("_hay", "_text").mapInArrow(_gram_rows(sizes, asked), "key long, gram int").select(F.col("key").alias("_hay"), "gram"))
    frequency = posted.groupBy("gram").agg(F.count("*").alias("_texts"))
    # A value whose grams are not all there is in no text; else its rarest gram stands for it.
    rarest = wanted.join(frequency, "gram", "left").groupBy("key").agg(F.count_if(F.col("_texts").isNull()).alias("_missing"), F.min(F.struct("_texts", "gram"))["gram"].alias("gram"))
    looked_up = rarest.filter("_missing = 0").select(F.col("key").alias("_needle"), "gram").join(needles.select("_needle", "_low"), "_needle")
    pairs = posted.join(looked_up, "gram").select("_hay", "_low")
    confirmed = pairs.join(hay, "_hay").filter(F.col("_text").contains(F.col("_low"))).select("_low", "_key").distinct()
    return confirmed.join(names, "_low").select(F.col("_value").alias(value), F.col("_key").alias(key))


def shared_ids_by_text(ids: DataFrame, flat: DataFrame, shop: str, value: str, text: str) -> DataFrame:
    """Shops whose text contains another shop's value, in any case: (shop, other, value), each once. A value of n shops that m texts contain gives
    n * m rows; texts_of_values names the texts alone."""
    owners = ids.select(F.col(shop), F.col(value)).distinct()
    hits = texts_of_values(owners, value, flat.select(F.col(shop).alias("other"), F.col(text)), "other", text)
    return hits.join(owners, value).filter(F.col(shop) != F.col("other")).select(shop, "other", value)


def cross_references(ids: DataFrame, shops: DataFrame, shop: str, value: str) -> DataFrame:
    """The shops of each shared value with their domains: value, shop, domain, url, shops; each shop once for a value, and only
    shops that there are. shops(id, domain, url)."""
    return shops_of_shared_ids(ids, shop, value).join(shops.select(F.col("id").alias(shop), "domain", "url"), shop).select(value, shop, "domain", "url", "shops")


def tracker_records(ids: DataFrame, by: str) -> DataFrame:
    """ids(by, platform, display_id) -> one record of each shop: its platforms, its distinct ids as one text, and their numbers."""
    once = ids.select(by, "platform", "display_id").distinct()
    return once.groupBy(by).agg(
        F.array_sort(F.collect_set("platform")).alias("trackers"), F.array_join(F.array_sort(F.collect_set("display_id")), " ").alias("all_ids_flat"),
        F.countDistinct("platform").alias("total_trackers"), F.countDistinct("display_id").alias("total_unique_ids"),
    )


def reverse_lookup_ids(detected_ids: DataFrame, looked_up: DataFrame, by: str, most: int = 3) -> DataFrame:
    """The ids of which other domains are looked up: of those detected and those that a lookup gave, (by, id), each once, the
    Analytics and Tag Manager ids, the first `most` of a shop in their order."""
    both = detected_ids.select(by, "id").unionByName(looked_up.select(by, "id")).distinct()
    wanted = both.filter(F.col("id").startswith("UA-") | F.col("id").startswith("GTM-"))
    return wanted.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("id"))).filter(F.col("place") <= most)


def without_own(items: Column, own: Column) -> Column:
    """Items that do not contain the own domain."""
    return F.filter(items, lambda x: ~F.lower(x).contains(F.lower(own)))


def other_sites(results: DataFrame, by: str, most: int = 10) -> DataFrame:
    """results(by, place, url, title) -> the first `most` sites of a search, each domain once, without search engines and the
    like: by, place, domain, url, title (at most 100 letters)."""
    from ..functions import urls

    sites = results.filter(F.col("url").startswith("http")).withColumn("domain", urls.host(F.col("url")))
    sites = sites.filter(~F.col("domain").isin(fixed.SKIPPED_SITES))
    first = sites.withColumn("_turn", F.row_number().over(Window.partitionBy(by, "domain").orderBy("place", "url"))).filter("_turn = 1")
    ranked = first.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("place", "url"))).filter(F.col("place") <= most)
    return ranked.select(by, "place", "domain", "url", F.substring("title", 1, 100).alias("title"))


def analytics_lines(answer: Column) -> Column:
    """The (subdomain, id) pairs of a lookup's lines; none if the answer speaks of an error."""
    lines = F.transform(F.split(F.trim(answer), "\n"), lambda x: F.split(F.trim(x), ","))
    pairs = F.transform(F.filter(lines, lambda p: F.size(p) == 2), lambda p: F.struct(F.trim(p[0]).alias("subdomain"), F.trim(p[1]).alias("id")))
    return F.when(F.lower(answer).contains("error"), F.array().cast("array<struct<subdomain:string,id:string>>")).otherwise(pairs)


def owner_results(results: DataFrame, by: str, platform: str, most: int = 10) -> DataFrame:
    """results(by, place, url, title) of a search for the owner of a platform's id -> the first `most` pages that are not the platform's own or a
    search engine's: by, place, domain, url, title (at most 100 letters). A domain may come more than once."""
    from ..functions import urls

    sites = results.filter(F.col("url").startswith("http")).withColumn("domain", urls.host(F.col("url")))
    sites = sites.filter((F.col("domain") != "") & ~F.col("domain").isin(fixed.SKIPPED_OWNERS[platform]))
    ranked = sites.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("place", "url"))).filter(F.col("place") <= most)
    return ranked.select(by, "place", "domain", "url", F.substring("title", 1, 100).alias("title"))


def related_sites(links: Column, most: int = 20) -> Column:
    """Sites with the same id, of a page's links (struct<href, text>): the names of those that lead on (/go/), each once, the first `most` in
    their order."""
    names = F.transform(F.filter(links, lambda x: x["href"].contains("/go/")), lambda x: F.lower(F.trim(x["text"])))
    return F.slice(F.array_sort(F.array_distinct(F.filter(names, lambda n: n.contains(".") & (F.length(n) > 3)))), 1, most)


def reverse_lines(id_: Column, answer: Column) -> Column:
    """The domains of a reverse lookup's lines; only Analytics and Tag Manager ids have any, and none if the answer speaks of an error."""
    domains = F.filter(F.transform(F.split(F.trim(answer), "\n"), lambda x: F.trim(x)), lambda x: x.contains("."))
    asked = (id_.startswith("UA-") | id_.startswith("GTM-")) & ~F.lower(answer).contains("error")
    return F.when(asked, domains).otherwise(F.array().cast("array<string>"))
