"""Sharding by best-fit-decreasing bin packing of indivisible groups of equal texts.

Groups are keyed by a hash of their text and measured by a distributed sum. Every group is an item of its own. Groups
of one size are alike to the packing, so the driver packs size classes (size, number of groups) and not groups: the
tightest bin with room for a size takes as many of its groups as fit at once, which are the steps that best fit would
take one by one. Sizes are exact up to 65,535 bytes and rounded up to 16 significant bits beyond, so there are at most
32,768 classes for each doubling of the size, whatever the input, and no shard exceeds the capacity found. Bins are
found in a balanced tree; the least capacity that fits the given number of shards is found by bisection. The groups of
a class are numbered on Spark, by counts of hash ranges where a class is crowded, and take the shards of their
numbers. Positions within a shard come from counts of hash ranges too, so no task holds a class or a shard.

Defined results: a null text counts no bytes and groups with empty ones; a group above a fair share has a shard of
its own, and the rest shares the others; repeated rows are rows of their own, in the same shard; rows with equal
ids are ordered by the text's hash; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from itertools import groupby, islice

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut_lineage

#: Bytes that a row costs besides its text.
ROW_BYTES = 16
#: Parts of a capacity to which the least one is found: the last shard lacks no more than a part for each other shard.
FINENESS = 20_000
#: Groups of a size class, or rows of a broadcast plan, that one task takes at most, about.
CROWD, BROADCAST_ROWS = 1 << 16, 1 << 20


class BinTree:
    """A balanced (AVL) search tree of (remaining capacity, bin)."""

    class Node:
        __slots__ = ("key", "left", "right", "height")

        def __init__(self, key):
            self.key, self.left, self.right, self.height = key, None, None, 1

    def __init__(self):
        self.root = None

    @staticmethod
    def _height(node):
        return node.height if node else 0

    def _turn(self, node, to_right):
        up = node.left if to_right else node.right
        if to_right:
            node.left, up.right = up.right, node
        else:
            node.right, up.left = up.left, node
        for x in (node, up):
            x.height = 1 + max(self._height(x.left), self._height(x.right))
        return up

    def _even(self, node):
        node.height = 1 + max(self._height(node.left), self._height(node.right))
        lean = self._height(node.left) - self._height(node.right)
        if lean > 1:
            if self._height(node.left.left) < self._height(node.left.right):
                node.left = self._turn(node.left, False)
            return self._turn(node, True)
        if lean < -1:
            if self._height(node.right.right) < self._height(node.right.left):
                node.right = self._turn(node.right, True)
            return self._turn(node, False)
        return node

    def add(self, key):
        def put(node):
            if node is None:
                return self.Node(key)
            if key < node.key:
                node.left = put(node.left)
            else:
                node.right = put(node.right)
            return self._even(node)

        self.root = put(self.root)

    def remove(self, key):
        def take(node, key):
            if key < node.key:
                node.left = take(node.left, key)
            elif key > node.key:
                node.right = take(node.right, key)
            elif node.left is None or node.right is None:
                return node.left or node.right
            else:
                least = node.right
                while least.left:
                    least = least.left
                node.key = least.key
                node.right = take(node.right, least.key)
            return self._even(node)

        self.root = take(self.root, key)

    def tightest(self, size):
        """The least key whose capacity is size or more, or None."""
        node, best = self.root, None
        while node:
            if node.key[0] >= size:
                best, node = node.key, node.left
            else:
                node = node.right
        return best


def fill(classes: list[tuple[int, int]], capacity: int) -> tuple[list[tuple[int, int, int]], int]:
    """classes of (size, number of items), sizes falling and each within capacity -> runs of (size, number, bin), in
    the order in which best fit places the items of each size, and the number of bins."""
    tree, bins, runs = BinTree(), 0, []
    for size, count in classes:
        while count:
            found = tree.tightest(size)
            if found is None:
                found = (capacity, bins)
                bins += 1
            else:
                tree.remove(found)
            # What is left of the tightest bin stays the tightest while it holds the size.
            taken = min(count, found[0] // size)
            runs.append((size, taken, found[1]))
            tree.add((found[0] - taken * size, found[1]))
            count -= taken
    return runs, bins


def best_fit_decreasing(items: list[tuple[int, object]], capacity: int) -> list[list]:
    """items of (size, name), each within capacity, into as few bins of that capacity as best fit needs."""
    items = sorted(items, key=lambda x: (-x[0], x[1]))
    runs, bins = fill([(size, len(list(same))) for size, same in groupby(items, key=lambda x: x[0])], capacity)
    names, out = iter(items), [[] for _ in range(bins)]
    for _, taken, k in runs:
        out[k] += [name for _, name in islice(names, taken)]
    return out


def pack(classes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """classes of (size, number of items) -> runs of (size, number, shard). Items above a fair share of what is left get
    shards of their own; the others enter the rest at the least capacity, to a part of FINENESS, at which best fit needs no
    more shards than there are."""
    classes = sorted(classes, reverse=True)
    runs, left, total = [], shards, sum(size * count for size, count in classes)
    while classes and left > 1 and classes[0][0] * left > total:
        size, count = classes.pop(0)
        runs.append((size, 1, shards - left))
        total, left = total - size, left - 1
        if count > 1:
            classes.insert(0, (size, count - 1))
    if classes:
        low = max(classes[0][0], -(-total // left))
        high, step = low, max(1, low // FINENESS)
        while (tried := fill(classes, high))[1] > left:
            low, high = high, high + step
            step *= 2
        found = tried[0]
        while high - low > max(1, low // FINENESS):
            middle = (low + high) // 2
            tried = fill(classes, middle)
            if tried[1] > left:
                low = middle
            else:
                high, found = middle, tried[0]
        runs += [(size, count, shards - left + k) for size, count, k in found]
    return runs


def _numbered(groups: DataFrame, classes: list[tuple[int, int]]) -> DataFrame:
    """groups with _number, from 0 in each size class; a crowded class is numbered in parts, by counts of the parts."""
    crowded = groups.sparkSession.createDataFrame([(size, 1 + count // CROWD) for size, count in classes if count > CROWD], "size long, _parts long")
    parted = groups.join(_bounded(crowded, len(classes)), "size", "left").withColumn("_part", F.coalesce(F.expr("pmod(_group, _parts)"), F.lit(0)))
    counts = parted.filter("_parts is not null").groupBy("size", "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("size", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy("size", "_part").orderBy("_group")) - 1
    numbered = parted.withColumn("_within", within).join(offsets, ["size", "_part"], "left")
    return numbered.select(*groups.columns, (F.coalesce("_offset", F.lit(0)) + F.col("_within")).alias("_number"))


def _bounded(plan: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(plan) if rows <= BROADCAST_ROWS else plan


def pack_shards(docs: DataFrame, shards: int = 40, hot_per_shard: int = 64, ranges: int = 1024) -> DataFrame:
    """docs(doc_id, text) -> doc_id, size, text_crc32, shard, slot (from 0 without gaps in each shard)."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = cut_lineage(docs.select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("_group")))
    measured = rows.groupBy("_group").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    grain = F.expr("shiftleft(1L, greatest(length(bin(_bytes)) - 16, 0))")
    groups = cut_lineage(measured.withColumn("size", F.ceil(F.col("_bytes") / grain) * grain))
    classes = [(x["size"], x["n"]) for x in groups.groupBy("size").agg(F.count("*").alias("n")).collect()]
    runs, done = [], {}
    for size, count, shard in pack(classes, shards):
        first = done.get(size, 0)
        done[size] = first + count
        runs.append((size, first, first + count, shard))
    plan = spark.createDataFrame(runs, "size long, _first long, _last long, shard int")
    inside = (F.col("_number") >= F.col("_first")) & (F.col("_number") < F.col("_last"))
    numbered = _numbered(groups, classes).withColumnRenamed("size", "_size")
    homes = numbered.join(_bounded(plan, len(runs)), (F.col("_size") == F.col("size")) & inside).select("_group", "_bytes", "_rows", "shard")
    homes = cut_lineage(homes)
    # Groups with many bytes or rows, at most 2 * shards * hot_per_shard, are met without dealing their rows by group.
    total = homes.agg(F.sum("_bytes").alias("bytes"), F.sum("_rows").alias("rows")).first()
    fraction = shards * hot_per_shard
    hot = (F.col("_bytes") * fraction > F.lit(total["bytes"] or 0)) | (F.col("_rows") * fraction > F.lit(total["rows"] or 0))
    home = homes.select("_group", "shard", hot.alias("_hot"))
    own = F.broadcast(home.filter("_hot").drop("_hot"))
    placed = rows.join(own, "_group").unionByName(rows.join(own, "_group", "left_anti").join(home.filter("not _hot").drop("_hot"), "_group"))
    placed = placed.withColumn("_range", F.pmod(F.xxhash64("doc_id"), F.lit(ranges)))
    counts = placed.groupBy("shard", "_range").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("shard", "_range").orderBy(F.col("doc_id").asc_nulls_first(), "_group")
    numbered = placed.withColumn("_row", F.row_number().over(within))
    return numbered.join(offsets, ["shard", "_range"]).select("doc_id", "size", "text_crc32", "shard", (F.col("_offset") + F.col("_row") - 1).cast("long").alias("slot"))
