"""Phrase collocations: phrases of two and three words that occur together more often than their parts would by chance.

Words get ids by frequency: the HEAD most frequent have their rank, others a 63-bit hash. An occurrence of two neighbours is a pair of
ids. Pairs of ranks fall into tiles of TILE x TILE cells; a tile with many occurrences is counted at once by a dense bincount over its
cells (its address is the cell), the rest as sorted coordinates with counts. Frequent pairs are then ranked the same way, and a
phrase of three words is a pair again: of a pair's id and a word's. Tasks send counts of ids, never words, except for the first count.

A phrase can only be frequent if its parts are, so occurrences of rare words and pairs are left out before counting: ranks are frequent
by themselves, and a table of SLOTS bits says which hashes may be. The ranks and that table are all that tasks are given: both have a fixed
size, and when more is frequent than fits, more is counted and nothing is lost.

Defined results: null texts are empty, a null lang is `und`; repeated rows count again; ties are broken as the order of the result says; an
empty table gives no phrases; further columns are ignored. Two different words of one hash would count as one: for v different
words the chance is v * v / 2**64 (1 in 7,000 for 50 million).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import BYTE_WORDS, SpanHash, cut_lineage, mixed, short_batches, slices, utf8

#: Words, and pairs, that have ranks.
HEAD = 1 << 17
#: Cells of a tile in each direction.
TILE = 1 << 11
#: A tile with so many occurrences in a buffer is counted densely.
DENSE = 1 << 17
#: Occurrences that a task holds before it counts them.
BUFFER = 3_000_000
#: Bits that say which hashes may belong to something frequent.
SLOTS = 1 << 24
#: Bytes of text that are cut into words at once.
PIECE_BYTES = 1 << 20
#: Parts of a word with many partners in the joins of counts.
SALT = 8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ENDS = np.zeros(256, bool)  # signs that end a piece
_ENDS[[*b".,;:!?", 10, 11, 12, 13]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 32]] = True
_ODD = np.uint64(0x9FB21C651E98DF25)
_TAIL = np.uint64(1 << 63)


def lang_word(lang: str) -> int:
    return int.from_bytes(hashlib.sha256(lang.encode()).digest()[:8], "little")


class Words:
    """The words of the texts of a batch: starts, ends, hashes (of lang and word), and whether a word and the next are in one piece."""

    def __init__(self, span_hash: SpanHash, texts: pa.Array, langs: np.ndarray) -> None:
        octets, at = utf8(texts)
        self.octets = _LOWER[octets]
        n = len(self.octets)
        ends = _ENDS[self.octets]
        inside = ~(ends | _BLANK[self.octets])
        fresh = np.zeros(n + 1, bool)
        fresh[at] = True
        before = np.concatenate([[False], inside[:-1]]) if n else inside
        self.start = np.flatnonzero(inside & (~before | fresh[:n]))
        after = np.concatenate([inside[1:], [False]]) if n else inside
        self.end = np.flatnonzero(inside & (~after | fresh[1:])) + 1
        self.text = np.searchsorted(at, self.start, side="right") - 1
        broken = np.concatenate([[0], np.cumsum(ends, dtype=np.int32)])[self.start]
        self.follows = (broken[1:] == broken[:-1]) & (self.text[1:] == self.text[:-1])
        self.key = mixed(span_hash(BYTE_WORDS[self.octets], self.start, self.end) ^ langs[self.text])


def gathered(octets: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans of an array of bytes as strings."""
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    place = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    data = np.ascontiguousarray(octets[place])
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, np.ndarray, list[str]]]:
    """Batches cut into words; with the lang of each text as its place in a list of langs."""
    span_hash, known, names = SpanHash(), {}, []
    marks = np.zeros(0, np.uint64)
    for batch in batches:
        for part in slices(batch, "text", PIECE_BYTES):
            coded = part.column("lang").dictionary_encode()
            for name in coded.dictionary.to_pylist():
                if name not in known:
                    known[name] = len(names)
                    names.append(name)
                    marks = np.append(marks, np.uint64(lang_word(name)))
            own = np.array([known[x] for x in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
            yield Words(span_hash, part.column("text"), marks[own]), own, names


# --- counting words -------------------------------------------------------------------------------------------------------------


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, id, n): the words of a task, each once for a buffer of them."""
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]] = []
    size, names = 0, []

    def merged() -> Iterator[pa.RecordBatch]:
        keys, counts, langs = (np.concatenate([x[k] for x in kept]) for k in range(3))
        words = pa.chunked_array([x[3] for x in kept], pa.large_string())
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.diff(keys[order], prepend=~keys[order[:1]]))
        once = order[first]
        rows = pa.table({
            "lang": pa.array(names, pa.string()).take(pa.array(langs[once])), "word": words.take(pa.array(once)).cast(pa.string()),
            "id": (keys[once] | _TAIL).view(np.int64), "n": np.add.reduceat(counts[order], first),
        })
        return iter(rows.to_batches(20_000))

    for words, own, names in _texts(batches):
        if len(words.key) == 0:
            continue
        keys, first, counts = np.unique(words.key, return_index=True, return_counts=True)
        kept.append((keys, counts, own[words.text[first]], gathered(words.octets, words.start[first], words.end[first])))
        size += len(keys)
        if size > BUFFER // 4:
            yield from merged()
            kept, size = [], 0
    if kept:
        yield from merged()


# --- counting pairs -------------------------------------------------------------------------------------------------------------


class Ranks:
    """Ranks of what is most frequent, by hash, and a table of bits for the rest; ids of hashes."""

    def __init__(self, keys: np.ndarray, bits: np.ndarray) -> None:
        """keys: 63-bit hashes by rank; bits: SLOTS bits, of which one is set for each frequent hash without a rank."""
        self.order = np.argsort(keys)
        self.keys, self.bits = keys[self.order], bits

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of hashes, and whether each may be frequent."""
        low = keys & ~_TAIL
        ids, frequent = (keys | _TAIL).view(np.int64).copy(), np.zeros(len(keys), bool)
        if len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, low), len(self.keys) - 1)
            frequent = self.keys[place] == low
            ids[frequent] = self.order[place[frequent]]
        slot = (low % np.uint64(SLOTS)).astype(np.int64)
        if len(self.bits):
            frequent |= (self.bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1
        return ids, frequent


def pair_key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mixed(mixed(left.view(np.uint64)) * _ODD + right.view(np.uint64))


class Tiles:
    """Counts of pairs of ids, BUFFER of them at a time."""

    def __init__(self) -> None:
        self.left, self.right, self.size = [], [], 0

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        self.left.append(left)
        self.right.append(right)
        self.size += len(left)

    def counted(self) -> Iterator[pa.RecordBatch]:
        """(l, r, n) of all that was added, and begin anew."""
        if not self.size:
            return
        left, right = np.concatenate(self.left), np.concatenate(self.right)
        self.left, self.right, self.size = [], [], 0
        ranked = (left >= 0) & (right >= 0)
        yield from self._rows(*_by_hash(left[~ranked], right[~ranked]))
        left, right = left[ranked], right[ranked]
        side = HEAD // TILE
        tile = left // TILE * side + right // TILE
        dense = np.flatnonzero(np.bincount(tile, minlength=side * side) >= DENSE)
        sparse = np.ones(len(tile), bool)
        for t in dense:
            of = tile == t
            sparse &= ~of
            cells = np.bincount((left[of] % TILE) * TILE + right[of] % TILE, minlength=TILE * TILE)
            cell = np.flatnonzero(cells)
            yield from self._rows(t // side * TILE + cell // TILE, t % side * TILE + cell % TILE, cells[cell])
        code, n = np.unique(left[sparse] * HEAD + right[sparse], return_counts=True)
        yield from self._rows(code // HEAD, code % HEAD, n)

    def _rows(self, left: np.ndarray, right: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield from pa.table({"l": left, "r": right, "n": n.astype(np.int64)}).to_batches(50_000)


def _by_hash(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs and their counts, sorted by a hash of both ids; by the ids themselves, should hashes meet."""
    if len(left) == 0:
        return left, right, left
    key = pair_key(left, right)
    order = np.argsort(key, kind="stable")
    key, left, right = key[order], left[order], right[order]
    fresh = np.diff(key, prepend=~key[:1]) != 0
    if np.any(~fresh[1:] & ((left[1:] != left[:-1]) | (right[1:] != right[:-1]))):
        order = np.lexsort((right, left))
        left, right = left[order], right[order]
        fresh = np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])])
    first = np.flatnonzero(fresh)
    return left[first], right[first], np.diff(first, append=len(left))


def _pair_counter(words: Ranks) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = Tiles()
        for found, _, _ in _texts(batches):
            ids, frequent = words(found.key)
            both = found.follows & frequent[1:] & frequent[:-1]
            tiles.add(ids[:-1][both], ids[1:][both])
            if tiles.size > BUFFER:
                yield from tiles.counted()
        yield from tiles.counted()

    return count


def _triple_counter(words: Ranks, pairs: Ranks) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = Tiles()
        for found, _, _ in _texts(batches):
            ids, frequent = words(found.key)
            both = found.follows & frequent[1:] & frequent[:-1]
            two, may = pairs(pair_key(ids[:-1], ids[1:]))
            may &= both
            three = may[1:] & may[:-1]
            tiles.add(two[:-1][three], ids[2:][three])
            if tiles.size > BUFFER:
                yield from tiles.counted()
        yield from tiles.counted()

    return count


# --- the phrases ----------------------------------------------------------------------------------------------------------------


def ranked(counts: DataFrame) -> tuple[DataFrame, Ranks]:
    """counts(id, n, ...), ids being hashes -> the same with the ids of Ranks, and those. HEAD ids and SLOTS bits come to the driver."""
    # By classes of counts, sixteen to a doubling, so that no sort of all counts is needed: the most frequent classes that fit.
    spark, level = counts.sparkSession, F.floor(F.log2("n") * 16)
    sizes = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).toPandas().sort_values("level", ascending=False)
    fit = sizes[sizes["words"].cumsum() <= HEAD]["level"]
    head = counts.filter(level >= int(fit.min())).select("id", "n").toPandas() if len(fit) else counts.select("id", "n").limit(0).toPandas()
    top = head.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy(np.int64)
    head = spark.createDataFrame(pa.table({"id": top, "_rank": np.arange(len(top))})) if len(top) else spark.createDataFrame([], "id long, _rank long")
    joined = cut_lineage(counts.join(F.broadcast(head), "id", "left").withColumn("id", F.coalesce("_rank", "id")).drop("_rank"))
    slot = F.col("id").bitwiseAND(SLOTS - 1)
    tail = joined.filter("id < 0").groupBy(F.shiftright(slot, 6).alias("at")).agg(F.expr(f"bit_or(shiftleft(1L, cast(id & {SLOTS - 1} & 63 as int)))").alias("bits")).toPandas()
    bits = np.zeros(SLOTS >> 6 if len(tail) else 0, np.uint64)
    bits[tail["at"].to_numpy(np.int64)] = tail["bits"].to_numpy(np.int64).view(np.uint64)
    return joined, Ranks(np.ascontiguousarray(top).view(np.uint64) & ~_TAIL, bits)


def _salted(frame: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """An inner join in which the partners of one key are dealt to SALT tasks; other has a row for each key."""
    salt = F.pmod(F.xxhash64(*frame.columns), F.lit(SALT))
    copies = other.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))).withColumn("_salt", F.col("_salt").cast("long"))
    return frame.withColumn("_salt", salt).join(copies, [*on, "_salt"]).drop("_salt")


def collocations(docs: DataFrame, least: int = 10, inside_percent: int = 50, top: int = 2000) -> DataFrame:
    """docs(text, lang) -> for each lang its first `top` phrases: lang, rank, phrase, a, l, r, n, score. a is the phrase's count, l and r
    those of the parts at its weakest cut, n all words of the lang. A phrase is left out if a longer one around it has at
    least inside_percent of its count."""
    short_batches(docs.sparkSession)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.mapInArrow(_word_rows, "lang string, word string, id long, n long")
    words = cut_lineage(rows.groupBy("lang", "word").agg(F.min("id").alias("id"), F.sum("n").alias("n")))
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent, word_ranks = ranked(words.filter(F.col("n") >= least))

    pairs = texts.mapInArrow(_pair_counter(word_ranks), "l long, r long, n long").groupBy("l", "r").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    pairs = cut_lineage(_with_key(pairs))
    pairs, pair_ranks = ranked(pairs)
    triples = texts.mapInArrow(_triple_counter(word_ranks, pair_ranks), "l long, r long, n long").groupBy("l", "r").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    triples = triples.select(F.col("l").alias("id"), F.col("r").alias("third"), F.col("n").alias("a"))

    left = frequent.select(F.col("id").alias("l"), "lang", F.col("word").alias("first_word"), F.col("n").alias("first_n"))
    right = frequent.select(F.col("id").alias("r"), F.col("word").alias("last_word"), F.col("n").alias("last_n"))
    two = cut_lineage(_salted(_salted(pairs, left, ["l"]), right, ["r"]))

    begin = two.select("id", "lang", F.col("r").alias("second"), F.concat_ws(" ", "first_word", "last_word").alias("begin"), "first_n", F.col("n").alias("begin_n"))
    end = two.select(F.col("id").alias("end_id"), F.col("l").alias("second"), F.col("r").alias("third"), F.col("last_word"), "last_n", F.col("n").alias("end_n"))
    three = cut_lineage(_salted(triples, begin, ["id"]).join(end, ["second", "third"]))

    exact = lambda a, l, r: F.expr(f"cast({a} as decimal(15,0)) * {a} * 1000000 div (cast({l} as decimal(18,0)) * {r})")  # noqa: E731, E741
    cut_1, cut_2 = exact("a", "first_n", "end_n"), exact("a", "begin_n", "last_n")
    longer = three.withColumns({"_1": cut_1, "_2": cut_2}).select(
        "lang", F.concat_ws(" ", "begin", "last_word").alias("phrase"), "a", F.when(F.col("_1") <= F.col("_2"), F.col("first_n")).otherwise(F.col("begin_n")).alias("l"),
        F.when(F.col("_1") <= F.col("_2"), F.col("end_n")).otherwise(F.col("last_n")).alias("r"), F.least("_1", "_2").alias("score"),
    )
    around = three.select(F.explode(F.array("id", "end_id")).alias("id"), "a").groupBy("id").agg(F.max("a").alias("_around"))
    kept = two.join(around, "id", "left").filter(F.coalesce(100 * F.col("_around") < inside_percent * F.col("n"), F.lit(True)))
    shorter = kept.select(
        "lang", F.concat_ws(" ", "first_word", "last_word").alias("phrase"), F.col("n").alias("a"), F.col("first_n").alias("l"), F.col("last_n").alias("r")
    ).withColumn("score", exact("a", "l", "r"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    best = shorter.unionByName(longer).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return best.join(totals.withColumnRenamed("total", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key = pair_key(*(batch.column(c).to_numpy() for c in "lr")) | _TAIL
        yield pa.RecordBatch.from_pydict({"l": batch.column("l"), "r": batch.column("r"), "n": batch.column("n"), "id": key.view(np.int64)})


def _with_key(pairs: DataFrame) -> DataFrame:
    """Pairs of ids with the hash by which tasks know them."""
    return pairs.mapInArrow(_key_rows, "l long, r long, n long, id long")
