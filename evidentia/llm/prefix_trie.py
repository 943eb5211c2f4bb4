"""Conversation prefix trie: how many turns conversations share from their beginning, and what storing those once would save.

A node is a distinct sequence of first turns (role, text); the root is the empty one. Turns are known by 128-bit digests, so no text is
shuffled. Turns that more than one conversation reaches are told apart from private ones by sorting prefix hashes; private tails
have nothing to count and are written as they stand. What is shared, and the first private turn, is a conversation's path.
Distinct paths are sorted over the cluster and cut into shards of bounded size. Each shard writes its trie as balanced
parentheses, with a tree of least excesses over blocks of BLOCK signs: findclose delimits a node's subtree, the rank of "()" counts
its leaves, and cumulative arrays give members and savings. Only the nodes above a shard's first and last path (its spines)
can be in another shard too; they are merged by their digests, which takes two paths for each shard.

The ids of the conversations that end at a node are hashed in their order: they are joined to long runs in sorted
ranges, and one task goes through a node's runs one by one, as the hash asks for; it holds one run at a time.

Defined results: null roles and texts are empty; turns are taken by number (null first), then by the digest of (role, text);
repeated rows are turns of their own; rows without a conv_id belong to no conversation and are left out; an empty table
has no node, not even a root; further columns are ignored. Two turns whose digests agree (chance 2**-128) count as one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut_lineage

#: Bytes of a turn's digest within a path.
DIGEST = 16
#: Signs of a block of the parentheses.
BLOCK = 64
#: A shard has this many turns of paths at most, or one longer path alone.
SHARD_TURNS = 1 << 17
#: Bytes of joined conversation ids in a run.
RUN_BYTES = 1 << 15

RESULT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


# --- balanced parentheses -------------------------------------------------------------------------------------------------------


class Parentheses:
    """A trie of sorted paths as balanced parentheses. lengths[i] is the number of turns of path i and shared[i] how many of them it
    has in common with the path before it (-1 for the first path: the root opens there)."""

    def __init__(self, lengths: np.ndarray, shared: np.ndarray) -> None:
        closes = np.concatenate([[0], lengths[:-1] - shared[1:]])
        opens = lengths - shared
        runs = np.stack([closes, opens], 1).ravel()
        self.opening = np.concatenate([np.repeat(np.tile([False, True], len(lengths)), runs), np.zeros(lengths[-1] + 1, bool)])
        self.at = np.flatnonzero(self.opening)
        self.excess = np.cumsum(np.where(self.opening, 1, -1))
        self.path = np.repeat(np.arange(len(lengths)), opens)
        self.depth = self.excess[self.at] - 1
        self.opened = np.cumsum(self.opening)
        self.leaf = np.concatenate([[0], np.cumsum(self.opening[:-1] & ~self.opening[1:]), [0]])
        self.leaf[-1] = self.leaf[-2]
        pad = -len(self.excess) % BLOCK
        level = np.concatenate([self.excess, np.full(pad, np.iinfo(np.int64).max)]).reshape(-1, BLOCK).min(1)
        self.levels = [level]
        while len(level) > 1:
            level = np.minimum(level[0::2], np.append(level[1::2], np.iinfo(np.int64).max)[: len(level[0::2])])
            self.levels.append(level)

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """For each opening place, the place that closes it: the first one after it whose excess is less than at the opening."""
        target = self.excess[at] - 1
        found = self._within(at + 1, target)
        left = np.flatnonzero(found < 0)
        found[left] = self._within(self._block(at[left] // BLOCK + 1, target[left]) * BLOCK, target[left])
        return found

    def _within(self, start: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The first place from start to the end of its block that reaches the target, or -1."""
        out = np.full(len(start), -1, np.int64)
        alive, place, end = np.arange(len(start)), start.copy(), np.minimum((start // BLOCK + 1) * BLOCK, len(self.excess))
        while len(alive):
            inside = place[alive] < end[alive]
            alive = alive[inside]
            hit = self.excess[place[alive]] <= target[alive]
            out[alive[hit]] = place[alive[hit]]
            alive = alive[~hit]
            place[alive] += 1
        return out

    def _block(self, block: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The first block from `block` on whose least excess reaches the target: up the tree, then down."""
        node, height = block.copy(), np.zeros(len(block), np.int64)
        least = lambda h, k: self._least(h, k)
        going = np.arange(len(block))
        while len(going):
            miss = least(height[going], node[going]) > target[going]
            going = going[miss]
            odd = node[going] & 1
            node[going] = np.where(odd == 1, (node[going] + 1) >> 1, node[going] + 1)
            height[going] += odd
        going = np.flatnonzero(height > 0)
        while len(going):
            height[going] -= 1
            node[going] <<= 1
            node[going] += least(height[going], node[going]) > target[going]
            going = going[height[going] > 0]
        return node

    def _least(self, height: np.ndarray, node: np.ndarray) -> np.ndarray:
        out = np.full(len(node), np.iinfo(np.int64).max)
        for h in np.unique(height):
            of = height == h
            level = self.levels[min(h, len(self.levels) - 1)]
            inside = of & (node < len(level)) if h < len(self.levels) else of & False
            out[inside] = level[node[inside]]
        return out

    def parents(self) -> np.ndarray:
        """The parent of each node in preorder (the root's is -1): the last node before it that is one less deep."""
        n = len(self.depth)
        keys = np.sort(self.depth * n + np.arange(n))
        place = np.searchsorted(keys, (self.depth - 1) * n + np.arange(n)) - 1
        return np.where(self.depth > 0, keys[place] % n, -1)


def least_of_ranges(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """min(values[first..last]) of each range, by a table of least values over spans of powers of two."""
    table = [values]
    while 2 << (len(table) - 1) <= len(values):
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    power = np.frexp(last - first + 1)[1] - 1
    out = np.empty(len(first), values.dtype)
    for p in np.unique(power):
        of = power == p
        out[of] = np.minimum(table[p][first[of]], table[p][last[of] - (1 << int(p)) + 1])
    return out


def shard_nodes(shard: int, keys: list[bytes], sizes: list[np.ndarray], convs: np.ndarray, least: np.ndarray, goes_on: np.ndarray, ends: list[str | None]) -> pd.DataFrame:
    """The nodes of a shard of distinct sorted paths. keys: a path's digests, joined; sizes: the bytes of its turns' texts; convs and
    least: how many conversations have the path and the smallest of them; goes_on: 1 where private turns follow; ends: the hash of
    those that end there."""
    lengths = np.array([len(k) // DIGEST for k in keys])
    shared = np.array([-1] + [_common(a, b) // DIGEST for a, b in zip(keys, keys[1:])])
    trie = Parentheses(lengths, shared)
    close = trie.findclose(trie.at)
    n, own = len(trie.at), np.arange(len(trie.at))
    last = trie.opened[close] - 1  # the last node of the subtree, in preorder
    # A path stands at its last node; a path is never a repetition, so that node opens with it.
    tail = np.cumsum(lengths - shared) - 1
    held = np.zeros(n + 1, np.int64)
    held[tail + 1] = convs
    held = np.cumsum(held)
    members = held[last + 1] - held[own]
    stands = np.zeros(n + 1, np.int64)
    stands[tail + 1] = 1
    stands = np.cumsum(stands)
    smallest = least_of_ranges(least, stands[own], stands[last + 1] - 1)
    text = np.concatenate([[0], *[s[max(d, 0) :] for s, d in zip(sizes, shared)]]).astype(np.int64)
    saved = np.concatenate([[0], np.cumsum((members - 1) * text)])
    parent = trie.parents()
    leaves = trie.leaf[close + 1] - trie.leaf[trie.at]
    ended = np.full(n, None, object)
    ended[tail] = ends
    # Spines: the nodes along the first and the last path. What hangs below them and is no spine itself is whole here.
    spine = np.zeros(n, bool)
    spine[: lengths[0] + 1] = True
    up = n - 1
    while up >= 0:
        spine[up] = True
        up = parent[up]
    hung = np.flatnonzero(~spine & spine[parent])
    children = np.bincount(parent[1:], minlength=n)
    children[tail] += goes_on  # the first private turn is the one child there, and the way to one leaf
    loose, hung_leaves = np.bincount(parent[hung], minlength=n), np.bincount(parent[hung], leaves[hung], n).astype(np.int64)
    loose[tail] += goes_on
    hung_leaves[tail] += goes_on
    names = np.full(n, None, object)
    for k in np.flatnonzero(spine):
        d = int(trie.depth[k])
        names[k] = hashlib.sha256(keys[trie.path[k]][: d * DIGEST]).digest()[:DIGEST]
    of = np.where(parent >= 0, parent, 0)
    return pd.DataFrame({
        "shard": np.full(n, shard), "name": names, "above": np.where((parent >= 0) & spine[of], names[of], None), "conv_id": smallest, "depth": trie.depth,
        "parent_conv_id": np.where(parent >= 0, smallest[of], 0), "n_convs": members, "text_bytes": text,
        "n_children": np.where(spine, loose, children), "n_leaves": np.where(spine, hung_leaves, leaves),
        "saved_tokens": np.where(spine, _hung_sum(parent[hung], (saved[last + 1] - saved[own])[hung], n), saved[last + 1] - saved[own]),
        "ends_sha256": ended,
    })


def _hung_sum(parent: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, parent, values)
    return out


def _common(a: bytes, b: bytes) -> int:
    """How many bytes two paths have in common at their beginning, in whole digests."""
    n = min(len(a), len(b)) // DIGEST * DIGEST
    if a[:n] == b[:n]:
        return n
    low, high = 0, n // DIGEST  # a[:low] agrees, a[:high] does not
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[: mid * DIGEST] == b[: mid * DIGEST] else (low, mid)
    return low * DIGEST


def merged_spines(rows: pd.DataFrame) -> pd.DataFrame:
    """The spines of all shards as one: rows of one name are one node. Totals go up from the deepest node."""
    first = rows.groupby("name", sort=False).agg(
        above=("above", "first"), conv_id=("conv_id", "min"), depth=("depth", "first"), n_convs=("n_convs", "sum"), text_bytes=("text_bytes", "first"),
        n_children=("n_children", "sum"), n_leaves=("n_leaves", "sum"), saved_tokens=("saved_tokens", "sum"), ends_sha256=("ends_sha256", "first"),
    ).sort_values("depth", kind="stable").reset_index()
    place = {name: k for k, name in enumerate(first["name"])}
    above = np.array([place.get(x, -1) for x in first["above"]])
    convs, text = first["n_convs"].to_numpy(), first["text_bytes"].to_numpy()
    children, leaves, saved = (first[c].to_numpy().copy() for c in ("n_children", "n_leaves", "saved_tokens"))
    np.add.at(children, above[above >= 0], 1)
    leaves[children == 0] = 1
    saved += (convs - 1) * text
    bounds = np.flatnonzero(np.diff(first["depth"].to_numpy(), prepend=-1))
    for begin, end in reversed(list(zip(bounds, [*bounds[1:], len(first)]))):
        level = np.arange(begin, end)[above[begin:end] >= 0]
        np.add.at(leaves, above[level], leaves[level])
        np.add.at(saved, above[level], saved[level])
    smallest = first["conv_id"].to_numpy()
    return first.assign(parent_conv_id=smallest[above], n_children=children, n_leaves=leaves, saved_tokens=saved, top=above < 0)


# --- conversations to paths -----------------------------------------------------------------------------------------------------


def turn_digest(role: Column, text: Column) -> Column:
    """128 bits of a digest of a turn; the length of the role keeps ("ab", "c") and ("a", "bc") apart."""
    return F.unhex(F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST))


def numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns(conv_id, turn, role, text) -> (conv_id, span, place, digest, text_bytes), places from 1, and the spans of all conversations:
    (conv_id, span, before, n). Rows are dealt by ranges, so a conversation of many turns lies in many spans."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    slim = turns.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), "turn", turn_digest(role, text).alias("digest"), F.octet_length(text).cast("long").alias("text_bytes"))
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("turn").asc_nulls_first(), F.col("digest")]
    dealt = cut_lineage(slim.repartitionByRange(parts, F.col("conv_id"), *order).withColumn("span", F.spark_partition_id()))
    spans = dealt.groupBy("conv_id", "span").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy("conv_id").orderBy("span")
    spans = spans.select("conv_id", "span", F.coalesce(F.sum("_n").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("_n").over(Window.partitionBy("conv_id")).alias("n"))
    ranked = dealt.withColumn("_place", F.row_number().over(Window.partitionBy("conv_id", "span").orderBy(*order)))
    placed = ranked.join(spans.select("conv_id", "span", "before"), ["conv_id", "span"]).withColumn("place", F.col("_place") + F.col("before"))
    return placed.select("conv_id", "span", "place", "digest", "text_bytes"), spans


def as_they_are(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: (conv_id, span, depth, digest, text_bytes), and the length of each, (conv_id, n)."""
    placed, spans = numbered(turns)
    return placed.withColumnRenamed("place", "depth"), spans.groupBy("conv_id").agg(F.max("n").alias("n"))


def rebuilt(turns: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first h turns of conversation c - c % group, h = crc32 of the decimal c, modulo `most`, and go on
    with their own turns after their first h: as as_they_are. A conversation may be left with no turn."""
    placed, spans = numbered(turns)
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("long")
    convs = spans.groupBy("conv_id").agg(F.max("n").alias("n")).withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % group})
    sizes = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("_there"))
    convs = cut_lineage(convs.join(sizes, "base", "left").withColumn("taken", F.least("h", F.coalesce("_there", F.lit(0)))).drop("_there"))
    heads = placed.filter(F.col("place") < most).select(F.col("conv_id").alias("base"), F.col("place").alias("depth"), "digest", "text_bytes")
    begin = convs.select("conv_id", "base", "taken").join(heads, "base").filter(F.col("depth") <= F.col("taken")).select("conv_id", F.lit(-1).alias("span"), "depth", "digest", "text_bytes")
    own = spans.select("conv_id", "span").join(convs.select("conv_id", "h", "taken"), "conv_id")
    rest = placed.join(own, ["conv_id", "span"]).filter(F.col("place") > F.col("h"))
    rest = rest.select("conv_id", "span", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "digest", "text_bytes")
    return begin.unionByName(rest), convs.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))


def prefix_hashes(rows: DataFrame) -> DataFrame:
    """rows with `prefix`, a 64-bit hash of all turns down to this one: exclusive or of hashes of (depth, digest), within each span of a
    conversation and over the spans before it."""
    mark = F.xxhash64("depth", "digest")
    spans = rows.groupBy("conv_id", "span").agg(F.bit_xor(mark).alias("_all"))
    earlier = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("conv_id", "span", F.coalesce(F.bit_xor("_all").over(earlier), F.lit(0).cast("long")).alias("_before"))
    within = Window.partitionBy("conv_id", "span").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumn("_in", F.bit_xor(mark).over(within))
    return summed.join(spans, ["conv_id", "span"]).withColumn("prefix", F.col("_in").bitwiseXOR(F.col("_before"))).drop("_in", "_before")


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by prefix, with whether a neighbour has the same; the first and the last row of a task count as shared, as their
    neighbours may lie in another one. Marking a private turn as shared costs a little work and changes no result."""
    held = None

    def out(batch: pa.RecordBatch, before, after) -> pa.RecordBatch:
        prefix = batch.column("prefix").to_numpy(zero_copy_only=False)
        same = prefix[1:] == prefix[:-1]
        left = np.concatenate([[before is None or before == prefix[0]], same])
        right = np.concatenate([same, [after is None or after == prefix[-1]]])
        columns = {c: batch.column(c) for c in batch.schema.names if c != "prefix"}
        return pa.RecordBatch.from_pydict(columns | {"shared": pa.array(left | right)})

    before = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if held is not None:
            yield out(held, before, batch.column("prefix")[0].as_py())
            before = held.column("prefix")[held.num_rows - 1].as_py()
        held = batch
    if held is not None:
        yield out(held, before, None)


def shared_and_private(rows: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The path of each conversation (conv_id, n, length, key, sizes): its shared turns and one more; and the private turns after it
    (conv_id, depth, n)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = cut_lineage(prefix_hashes(rows))
    sorted_rows = hashed.repartitionByRange(parts, "prefix", "conv_id").sortWithinPartitions("prefix", "conv_id")
    marked = cut_lineage(sorted_rows.mapInArrow(_marked, "conv_id long, span int, depth long, digest binary, text_bytes long, shared boolean"))
    spans = marked.groupBy("conv_id", "span").agg(F.min(F.when(~F.col("shared"), F.col("depth"))).alias("_first"))
    spans = spans.select("conv_id", "span", F.min("_first").over(Window.partitionBy("conv_id")).alias("_first")).join(convs, "conv_id")
    placed = marked.join(spans, ["conv_id", "span"])
    beyond = F.col("depth") > F.col("_first")
    kept = placed.filter(~F.coalesce(beyond, F.lit(False))).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "digest", "text_bytes"))).alias("_path"))
    paths = convs.join(kept, "conv_id", "left").withColumn("_path", F.coalesce("_path", F.array().cast("array<struct<depth:bigint,digest:binary,text_bytes:bigint>>")))
    key = F.unhex(F.array_join(F.transform("_path", lambda x: F.hex(x["digest"])), ""))
    paths = paths.select("conv_id", "n", F.size("_path").cast("long").alias("length"), key.alias("key"), F.transform("_path", lambda x: x["text_bytes"]).alias("sizes"))
    return paths, placed.filter(beyond).select("conv_id", "depth", "n")


# --- hashes of the conversations that end at a node -----------------------------------------------------------------------------


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (path, conv_id) -> (path, first conv_id, decimal ids joined by commas), a run for at most RUN_BYTES."""
    path, ids, size = None, [], 0
    done: list[tuple[bytes, int, str]] = []
    for batch in batches:
        for own, conv in zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist()):
            if ids and (own != path or size > RUN_BYTES):
                done.append((path, ids[0], ",".join(map(str, ids))))
                ids, size = [], 0
            path = own
            ids.append(conv)
            size += 20
        if len(done) > 1000:
            yield _run_rows(done)
            done = []
    if ids:
        done.append((path, ids[0], ",".join(map(str, ids))))
    yield _run_rows(done)


def _run_rows(done: list[tuple[bytes, int, str]]) -> pa.RecordBatch:
    paths, first, text = zip(*done) if done else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(paths, pa.binary()), pa.array(first, pa.int64()), pa.array(text, pa.string())], ["path", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by (path, first conv_id) -> (path, ends): one SHA-256 over all runs of a path."""
    path, state = None, None
    for batch in batches:
        paths, hashes = [], []
        for own, text in zip(batch.column("path").to_pylist(), batch.column("ids").to_pylist()):
            if state is not None and own != path:
                paths.append(path)
                hashes.append(state.hexdigest())
                state = None
            if state is None:
                path, state = own, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.binary()), pa.array(hashes, pa.string())], ["path", "ends"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([path], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["path", "ends"])


def path_ends(ended: DataFrame) -> DataFrame:
    """ended(path, conv_id) -> path, ends: the hash of all conv_ids of a path, ascending, joined by commas."""
    parts = int(ended.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = ended.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(_runs, "path binary, first long, ids string")
    return runs.repartition(parts, "path").sortWithinPartitions("path", "first").mapInArrow(_hashed, "path binary, ends string")


# --- the trie -------------------------------------------------------------------------------------------------------------------

_NODES = "shard long, name binary, above binary, conv_id long, depth long, parent_conv_id long, n_convs long, text_bytes long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted distinct paths -> the nodes of their shards."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    kept: list[dict] = []
    size = 0
    for batch in batches:
        for row in batch.to_pylist():
            if kept and size + len(row["sizes"]) + 1 > SHARD_TURNS:
                yield from _written(number, kept)
                number, kept, size = number + 1, [], 0
            kept.append(row)
            size += len(row["sizes"]) + 1
    if kept:
        yield from _written(number, kept)


def _written(number: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
    nodes = shard_nodes(
        number, [r["key"] for r in rows], [np.array(r["sizes"], np.int64) for r in rows], np.array([r["convs"] for r in rows]), np.array([r["least"] for r in rows]),
        np.array([r["goes_on"] for r in rows]), [r["ends"] for r in rows],
    )
    schema = pa.schema([(c.split()[0], {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[c.split()[1]]) for c in _NODES.split(", ")])
    yield from pa.Table.from_pandas(nodes, schema, preserve_index=False).to_batches(8192)


def prefix_trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """rows(conv_id, span, depth, digest, text_bytes) and convs(conv_id, n), as as_they_are and rebuilt give them -> a row for each node:
    RESULT. saved_tokens counts UTF-8 bytes: what the members of the subtree's nodes would not store again."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    none = F.sha2(F.lit(""), 256)
    paths, tails = shared_and_private(rows, convs)
    paths = cut_lineage(paths.withColumn("path", F.unhex(F.substring(F.sha2("key", 256), 1, 2 * DIGEST))))
    # A conversation ends at its path's node unless private turns follow.
    ended = paths.filter(F.col("n") == F.col("length")).select("path", "conv_id")
    distinct = paths.groupBy("key", "path").agg(F.first("sizes").alias("sizes"), F.count("*").alias("convs"), F.min("conv_id").alias("least"), F.max((F.col("n") > F.col("length")).cast("int")).alias("goes_on"))
    distinct = distinct.join(path_ends(ended), "path", "left").select("key", "sizes", "convs", "least", "goes_on", "ends")
    nodes = cut_lineage(distinct.repartitionByRange(parts, "key").sortWithinPartitions("key").mapInArrow(_shards, _NODES))
    spines = nodes.filter(F.col("name").isNotNull())
    schema = "name binary, above binary, conv_id long, depth long, n_convs long, text_bytes long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, parent_conv_id long, top boolean"
    columns = [c.split()[0] for c in schema.split(", ")]
    merged = cut_lineage(spines.groupBy().applyInPandas(lambda x: merged_spines(x)[columns], schema))
    # A node below a spine takes its parent's smallest member from the merged spine of its shard.
    smallest = spines.select("shard", "name").join(merged.select("name", F.col("conv_id").alias("_smallest")), "name").select("shard", F.col("name").alias("above"), "_smallest")
    inner = nodes.filter(F.col("name").isNull()).join(smallest, ["shard", "above"], "left").withColumn("parent_conv_id", F.coalesce("_smallest", "parent_conv_id"))
    names = [c.split()[0] for c in RESULT.split(", ")]
    top = merged.withColumn("parent_conv_id", F.when(~F.col("top"), F.col("parent_conv_id")))
    last = F.col("depth") == F.col("n")
    private = tails.select(
        "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), (~last).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(none).alias("ends_sha256"),
    )
    whole = inner.select(names).unionByName(top.select(names)).withColumn("ends_sha256", F.coalesce("ends_sha256", none))
    return whole.unionByName(private)
