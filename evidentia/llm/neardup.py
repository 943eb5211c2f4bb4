"""Near-duplicate documents by an inverted join of MinHash signature coordinates.

Texts with equal shingle sets form a class, and one node stands for each class. Every node posts itself under the
(coordinate, value) pairs of a prefix of its signature, its rarest coordinates - need + 1 pairs: two signatures that
agree on at least `need` of all coordinates share one of these (prefix filtering under one order), so the rest, with all values
that passages common to many documents make frequent, need not be posted and is compared only for pairs that met (skip merging). Pairs that agree on `need` coordinates or more are confirmed
on full shingle sets.

Within a bucket of a value that many nodes share, pairs are not listed: each is compared with the bucket's hub, the
node whose values are the most common ones. Nodes whose bucket still spans several components afterwards are
compared across components, unless the shingles that each shares with any other node are too few for a link. So every
link that could join components is confirmed or refuted, while copies around one text cost about as many pairs as
there are copies.

Defined results: null, empty and blank texts have no shingles and are linked with nothing; a text with fewer
words than a shingle is one shingle; rows with a null doc_id are counted but linked with nothing (null component,
kept); rows that share a doc_id are one node; repeated rows are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import BYTE_WORDS, SpanHash, cut_lineage, mixed, short_batches, slices, utf8, word_spans

COORDINATES = 64
BINS = 32

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_random = np.random.default_rng(64)
_FACTORS = _random.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _random.integers(1, 2**63, COORDINATES, dtype=np.uint64)
_PLACES = _random.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def need_of(percent: int, coordinates: int = COORDINATES) -> int:
    """The agreements below which a pair of that likeness falls with a small chance: one in 114,000 at 85 percent (41 of 64), one in
    71,500 at 80 percent (37 of 64), by the binomial tail."""
    p = percent / 100
    return max(1, math.floor(coordinates * p - 4.4 * math.sqrt(coordinates * p * (1 - p))))


def shingle_sets(texts: pa.Array, words: int, span_hash: SpanHash) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the sorted distinct hashes of its shingles, in a row, and where each text's begin."""
    octets, at = utf8(texts)
    start, end, counts = word_spans(octets, at)
    names = span_hash(BYTE_WORDS[_LOWER[octets]], start, end)
    first = np.concatenate([[0], np.cumsum(counts)])
    number = np.where(counts >= words, counts - words + 1, (counts > 0).astype(np.int64))
    text_of = np.repeat(np.arange(len(counts)), number)
    begin = np.concatenate([[0], np.cumsum(number)])
    head = first[text_of] + np.arange(begin[-1]) - begin[text_of]
    hashes = np.zeros(len(head), np.uint64)
    for k in range(words):
        inside = head + k < first[text_of + 1]
        hashes[inside] += names[head[inside] + k] * _PLACES[k]
    hashes = mixed(hashes)
    out, sizes = [], np.zeros(len(counts), np.int64)
    for k in range(len(counts)):
        own = np.sort(hashes[begin[k] : begin[k + 1]])
        if len(own) > 1:
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        out.append(own)
        sizes[k] = len(own)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def _digests(hashes: np.ndarray, begin: np.ndarray) -> list[bytes | None]:
    """128 bits of each set, or None of an empty one."""
    sizes = np.diff(begin)
    full = np.flatnonzero(sizes)
    halves = np.zeros((len(sizes), 2), np.uint64)
    if len(full):
        halves[full, 0] = np.add.reduceat(mixed(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), begin[full])
        halves[full, 1] = np.add.reduceat(mixed(hashes + np.uint64(0x1234567)), begin[full])
    return [halves[k].tobytes() if sizes[k] else None for k in range(len(sizes))]


def _signatures(hashes: np.ndarray, begin: np.ndarray) -> pa.Array:
    sizes = np.diff(begin)
    full = np.flatnonzero(sizes)
    values = np.zeros((len(sizes), COORDINATES), np.uint32)
    if len(full):
        for k in range(COORDINATES):
            values[full, k] = np.minimum.reduceat(hashes * _FACTORS[k] + _SHIFTS[k], begin[full]) >> np.uint64(32)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * COORDINATES), pa.array(values.ravel().view(np.int32)))


def _features(words: int, id_type: pa.DataType, with_sets: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span_hash = SpanHash()
        for batch in batches:
            for part in slices(batch):
                hashes, begin = shingle_sets(part.column("text"), words, span_hash)
                digests = pa.array(_digests(hashes, begin), pa.binary())
                if with_sets:
                    sets = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(hashes.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), digests, sets], ["node", "class", "hashes"])
                else:
                    own = [part.column("doc_id"), part.column("_text"), pa.array(np.diff(begin)), digests, _signatures(hashes, begin)]
                    yield pa.RecordBatch.from_arrays(own, ["doc_id", "_text", "n_shingles", "class", "signature"])

    return run


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (node, component), the least node reachable, for all nodes that have links. Labels spread to
    neighbours and then jump to their label's label, so that rounds grow with the logarithm of a chain's length."""
    edges = cut_lineage(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_b")).select("node", F.least("node", "_b").alias("component"), F.lit(True).alias("changed")))
    while not labels.filter("changed").isEmpty():
        near = edges.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("_near"))
        spread = labels.join(near, "node").select("node", F.col("component").alias("_old"), F.least("component", "_near").alias("_new"))
        jump = labels.select(F.col("node").alias("_new"), F.col("component").alias("_jump"))
        labels = cut_lineage(spread.join(jump, "_new", "left").select("node", F.least("_new", F.coalesce("_jump", "_new")).alias("component"), (F.least("_new", F.coalesce("_jump", "_new")) < F.col("_old")).alias("changed")))
    return labels.select("node", "component")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, need: int | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id, kept. Texts are linked when
    100 * intersection >= percent * union of their sets of `words`-word shingles. need: how many coordinates two signatures must
    agree on to be compared in full, by default need_of(percent), which loses a pair at the very threshold with the chance stated
    there. need=1 posts every coordinate and compares all that share any: a pair at 80 percent then goes unseen with a chance below
    2**-148, less than that of a hash collision; it costs more comparisons."""
    return _grouped(docs, words, percent, need).select("doc_id", "n_shingles", "component_id", "kept")


def _grouped(docs: DataFrame, words: int, percent: int, need: int | None = None) -> DataFrame:
    """The rows of near_duplicates with their class and a hash of their text (_text)."""
    short_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("_text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    need = need_of(percent) if need is None else need
    prefix = COORDINATES - need + 1
    rows = cut_lineage(docs.mapInArrow(_features(words, id_type, False), f"doc_id {id_type}, _text long, n_shingles long, class binary, signature array<int>"))
    nodes = cut_lineage(
        rows.filter("class is not null and doc_id is not null")
        .groupBy("class")
        .agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n"))
    )
    posted = nodes.select("node", F.posexplode("signature")).select("node", F.xxhash64("pos", "col").alias("bucket"))
    counts = posted.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    # In the order of rarity a node's unshared values come first, so they fill its prefix before any shared one.
    by_rarity = Window.partitionBy("node").orderBy("members", "bucket")
    ranked = posted.join(counts, "bucket").withColumns({"_rank": F.row_number().over(by_rarity), "_shared": F.count("*").over(Window.partitionBy("node")), "score": F.sum("members").over(Window.partitionBy("node"))})
    posted = ranked.filter(F.col("_rank") <= prefix - COORDINATES + F.col("_shared")).select("node", "bucket", "score")
    counts = posted.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    shared = cut_lineage(posted.join(counts, "bucket"))
    sets = cut_lineage(_sets(docs, nodes, shared.select("node").distinct(), words))
    hubs = shared.groupBy("bucket").agg(F.max(F.struct("score", "node"))["node"].alias("hub"))
    met = shared.join(hubs, "bucket").filter("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    tried = cut_lineage(_compared(_agreeing(met, nodes, need), sets))
    alike = F.col("common") * (100 + percent) >= F.col("both") * percent
    links = tried.filter(alike).select("a", "b")
    grouped = components(links)

    # Nodes that met in a bucket and are still in different components. What a set alone holds no other can share, and what it
    # shares with the hub and what it shares beyond the hub bound its intersection with another set one by one.
    placed = shared.join(grouped, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    placed = cut_lineage(_open(placed))
    own = sets.join(placed.select("node").distinct(), "node", "left_semi").select("node", F.explode("hashes").alias("_hash"))
    alone = own.groupBy("_hash").agg(F.count("*").alias("_nodes"), F.min("node").alias("node")).filter("_nodes = 1").groupBy("node").agg(F.count("*").alias("_alone"))
    sizes = sets.select("node", F.size("hashes").alias("n")).join(alone, "node", "left").select("node", "n", (F.col("n") - F.coalesce("_alone", F.lit(0))).alias("shares"))
    buckets = shared.groupBy("node").agg(F.array_sort(F.collect_set("bucket")).alias("buckets"))
    with_hub = tried.select("a", "b", F.col("common").alias("inside"), "only_a", "only_b")
    placed = (
        placed.join(hubs, "bucket").filter("node <> hub").join(sizes, "node").join(buckets, "node")
        .withColumns({"a": F.least("node", "hub"), "b": F.greatest("node", "hub"), "most": F.col("shares") * (100 + percent) - F.col("n") * percent})
        .join(with_hub, ["a", "b"], "left").withColumn("lacks", F.when(F.col("hub") == F.col("a"), F.col("only_a")).otherwise(F.col("only_b")))
        .drop("a", "b", "hub", "only_a", "only_b")
    )
    placed = cut_lineage(placed)
    least = placed.groupBy("bucket").agg((F.min("n") * percent).alias("_least"))
    placed = _open(placed.join(least, "bucket").filter("most >= _least").drop("_least"))
    other = placed.select("bucket", *[F.col(c).alias(f"_{c}") for c in ("node", "component", "n", "shares", "inside", "lacks", "buckets")])
    beyond = F.least(F.col("shares") - F.col("inside"), F.col("_shares") - F.col("_inside"))
    known = F.col("inside").isNotNull() & F.col("_inside").isNotNull()
    enough = lambda bound: bound * (100 + percent) >= (F.col("n") + F.col("_n")) * percent
    can = enough(F.when(known, F.least("inside", "_inside") + beyond).otherwise(F.least("shares", "_shares")))
    # Of the hub's shingles the two together lack as many at least as, bin by bin, the one that lacks more.
    lacking = F.aggregate(F.zip_with("lacks", "_lacks", lambda x, y: F.greatest(x, y)), F.lit(0), lambda t, x: t + x)
    of_hub = F.col("inside") + F.aggregate("lacks", F.lit(0), lambda t, x: t + x)
    can_by_bins = ~known | enough(of_hub - lacking + beyond)
    # A pair is made in the first of the buckets that its two nodes share.
    first = F.col("bucket") == F.array_min(F.array_intersect("buckets", "_buckets"))
    met = placed.join(other, "bucket").filter((F.col("node") < F.col("_node")) & (F.col("component") != F.col("_component")) & can & first & can_by_bins)
    met = met.select(F.col("node").alias("a"), F.col("_node").alias("b")).distinct()
    rest = cut_lineage(_agreeing(met, nodes, need))
    if not rest.isEmpty():
        links = links.union(_compared(rest, sets).filter(alike).select("a", "b"))
        grouped = components(links)

    of_class = nodes.join(grouped, "node", "left").select("class", F.coalesce("component", "node").alias("component"))
    component = F.coalesce("component", "doc_id")
    return rows.join(of_class, "class", "left").select(
        "doc_id", "_text", "class", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def _agreeing(pairs: DataFrame, nodes: DataFrame, need: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree on `need` coordinates or more."""
    own = nodes.select(F.col("node").alias("a"), F.col("signature").alias("_a"))
    other = nodes.select(F.col("node").alias("b"), F.col("signature").alias("_b"))
    agree = F.aggregate(F.zip_with("_a", "_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return pairs.join(own, "a").join(other, "b").filter(agree >= need).select("a", "b").distinct()


def _open(placed: DataFrame) -> DataFrame:
    """The rows of placed(bucket, node, component, ...) whose bucket has several components."""
    several = placed.groupBy("bucket").agg(F.min("component").alias("_least"), F.max("component").alias("_most")).filter("_least < _most").select("bucket")
    return placed.join(several, "bucket")


def _sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, hashes): the full shingle sets of the wanted nodes; only their texts are shingled again."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    classes = nodes.join(wanted, "node", "left_semi").select("node", "class")
    texts = docs.join(classes.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = texts.mapInArrow(_features(words, id_type, True), f"node {id_type}, class binary, hashes array<bigint>")
    return sets.join(classes, ["node", "class"], "left_semi").dropDuplicates(["node", "class"]).drop("class")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with the size of their full sets' intersection (common), the sum of their sizes (both), and how
    many hashes only a and only b has, by BINS bins of the hash."""
    own = sets.select(F.col("node").alias("a"), F.col("hashes").alias("_a"))
    other = sets.select(F.col("node").alias("b"), F.col("hashes").alias("_b"))
    joined = pairs.join(own, "a").join(other, "b").withColumns({"_only_a": F.array_except("_a", "_b"), "_only_b": F.array_except("_b", "_a")})
    none = F.array_repeat(F.lit(0), BINS)
    binned = lambda c: F.aggregate(F.transform(c, lambda x: F.pmod(x, F.lit(BINS)).cast("int")), none, lambda t, k: F.transform(t, lambda v, i: v + (i == k).cast("int")))
    sizes = joined.select("a", "b", (F.size("_a") - F.size("_only_a")).cast("long").alias("common"), (F.size("_a") + F.size("_b")).alias("both"), "_only_a", "_only_b")
    return sizes.select("a", "b", "common", "both", binned("_only_a").alias("only_a"), binned("_only_b").alias("only_b"))


def without_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs without those that another document of their group stands for. Of rows that share their doc_id and set one stays, by
    the least hash of the text; rows of one doc_id with different sets are judged each by its own. Rows without a doc_id stay, one of each text."""
    grouped = _grouped(docs, words, percent).filter("kept")
    of_set = F.when(F.col("doc_id").isNotNull(), F.col("class"))
    of_text = F.when(F.col("doc_id").isNull(), F.col("_text"))
    stay = grouped.groupBy("doc_id", of_set.alias("_set"), of_text.alias("_own")).agg(F.min("_text").alias("_text"))
    names = [next(n for n in (f"_{base}{'_' * k}" for k in range(99)) if n not in docs.columns) for base in ("id", "null", "text")]
    keys = lambda text: dict(zip(names, (F.coalesce(F.col("doc_id"), text), F.col("doc_id").isNull(), text)))
    chosen = stay.select(*[c.alias(n) for n, c in keys(F.col("_text")).items()])
    # The join and the removal of repeated rows use one dealing of the texts.
    return docs.withColumns(keys(F.xxhash64("text"))).join(chosen, names, "left_semi").dropDuplicates(names).select(*docs.columns)
