"""Document fingerprints by locally consistent parsing.

A text is a sequence of symbols, at first its code points. Each level joins runs of one symbol, gives every symbol
a small label by deterministic coin tossing (the lowest bit in which it differs from the symbol before, three times
over), cuts at the labels' local maxima, and names each block by a hash of its symbols. A cut depends on a few
symbols around it only, so equal substrings get equal inner phrase names wherever they stand. The names of all
levels form the text's phrase set; its fingerprint is the name of the root, the number of
distinct phrases and the smallest phrase names (a bottom-k sketch). The likeness of two fingerprints is the share of
phrases that the two have in common (Dice), estimated from the sketches, and 1 for equal fingerprints.

Each document is also compared with an edited text, made from itself and the next document in descending doc_id
order. Documents are dealt by ranges of doc_id, each range with a copy of the first document of the next one, and
read in order, one Arrow batch at a time.

Defined results: null texts are empty; the empty text has a fingerprint of its own, like itself and nothing else; the
document after the last is the first (of a single document: itself); null ids come last; equal ids are ordered by
the text's hash; repeated rows are rows of their own; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import SpanHash, mixed

SKETCH = 64
#: Phrases of this level and above count.
FIRST_LEVEL = 1

#: The lowest bit set in a byte.
_LOWEST = np.array([0, *[(k & -k).bit_length() - 1 for k in range(1, 256)]], np.uint8)


def _before(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The symbol before each symbol; at a text's start one that differs in the lowest bit."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[at[:-1]] = x[at[:-1]] ^ x.dtype.type(1)
    return out


def next_level(x: np.ndarray, at: np.ndarray, span_hash: SpanHash) -> tuple[np.ndarray, np.ndarray]:
    """The names of the blocks of symbol sequences in a row, none of them empty; text k has x[at[k]:at[k + 1]]."""
    fresh = np.ones(len(x), bool)
    fresh[1:] = x[1:] != x[:-1]
    fresh[at[:-1]] = True
    if not fresh.all():
        start = np.flatnonzero(fresh)
        length = np.diff(np.append(start, len(x)))
        x = np.where(length > 1, mixed(x[start] + length.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)), x[start])
        at = np.searchsorted(start, at)
        # Two runs side by side may only seem equal if their hashes collide.
    differ = x ^ _before(x, at)
    low = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1))
    low = np.minimum(low, 63)
    label = (low << np.uint8(1)) | ((x >> low.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
    for _ in range(2):
        low = _LOWEST[label ^ _before(label, at)]
        label = (low << np.uint8(1)) | ((label >> low) & np.uint8(1))
    cut = np.zeros(len(x), bool)
    cut[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    last = at[1:] - 1
    cut[last] = False
    cut[at[:-1]] = True
    start = np.flatnonzero(cut)
    return span_hash(x, start, np.append(start[1:], len(x))), np.searchsorted(start, at)


def phrase_sets(texts: list[str], span_hash: SpanHash) -> list[tuple[int, np.ndarray]]:
    """Of each text the name of its root and its sorted distinct phrase names (upper 32 bits)."""
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    alive = [k for k, p in enumerate(points) if len(p)]
    root = [0] * len(texts)
    names: list[list[np.ndarray]] = [[] for _ in texts]
    if alive:
        x = np.concatenate([points[k] for k in alive]).astype(np.uint64)
        at = np.concatenate([[0], np.cumsum([len(points[k]) for k in alive])])
    level = 0
    while alive:
        x, at = next_level(x, at, span_hash)
        level += 1
        upper = (x >> np.uint64(32)).astype(np.uint32)
        left = []
        bounds = at.tolist()
        for j, k in enumerate(alive):
            single = bounds[j + 1] - bounds[j] == 1
            if level >= FIRST_LEVEL or single:
                names[k].append(upper[bounds[j] : bounds[j + 1]])
            if single:
                root[k] = int(x[bounds[j]])
            else:
                left.append(j)
        if len(left) < len(alive):
            size = np.diff(at)
            keep = np.zeros(len(alive), bool)
            keep[left] = True
            x = x[np.repeat(keep, size)]
            at = np.concatenate([[0], np.cumsum(size[keep])])
            alive = [alive[j] for j in left]
    return [(r, np.unique(np.concatenate(own)) if own else np.zeros(0, np.uint32)) for r, own in zip(root, names)]


def fingerprint(root: int, phrases: np.ndarray) -> str:
    return f"{root:016x}-{len(phrases)}-{phrases[:SKETCH].astype('>u4').tobytes().hex()}"


def likeness(a: str, b: str) -> float:
    """The share of phrases in common, 0 to 1, from the fingerprints alone."""
    if a == b:
        return 1.0
    (_, n, x), (_, m, y) = a.split("-"), b.split("-")
    x, y = {x[k : k + 8] for k in range(0, len(x), 8)}, {y[k : k + 8] for k in range(0, len(y), 8)}
    whole = int(n) <= SKETCH and int(m) <= SKETCH
    union = sorted(x | y)
    union = union if whole else union[:SKETCH]
    if not union:
        return 0.0
    both = sum(v in x and v in y for v in union)
    return 2 * both / (len(union) + both)


def edited_text(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(batches: Iterator[pa.RecordBatch], most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Rows (range, guest, doc_id, text) in order; a guest ends its range and gives no row."""
    span_hash = SpanHash()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    pending = None

    def result(rows, id_type):
        """rows (range, guest, doc_id, text), the first maybe with its fingerprint -> the last with its own, and a batch."""
        nonlocal pending
        known = [] if len(rows[0]) == 4 else [rows[0][4]]
        pairs = [(k, k + 1) for k in range(len(rows) - 1) if not rows[k][1] and rows[k][0] == rows[k + 1][0]]
        edited = [edited_text(rows[a][3], rows[b][3]) for a, b in pairs]
        found = phrase_sets([r[3] for r in rows[len(known) :]] + edited, span_hash)
        found = [fingerprint(*f) for f in found]
        own, changed = known + found[: len(rows) - len(known)], found[len(rows) - len(known) :]
        pending = (*rows[-1][:4], own[-1])
        ids = pa.array([rows[a][2] for a, _ in pairs], id_type)
        columns = [
            pa.array([len(rows[a][3]) for a, _ in pairs], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array([own[a] for a, _ in pairs], pa.string()),
            pa.array(changed, pa.string()),
            pa.array([likeness(own[a], e) for (a, _), e in zip(pairs, changed)], pa.float64()),
            pa.array([likeness(own[a], own[b]) for a, b in pairs], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays([ids, *columns], names)

    for batch in batches:
        id_type = batch.schema.field("doc_id").type
        size, rows = 0, [] if pending is None else [pending]
        ranges, guests = batch.column("range").to_pylist(), batch.column("guest").to_pylist()
        for k in range(batch.num_rows):
            text = batch.column("text")[k].as_py()
            rows.append((ranges[k], guests[k], batch.column("doc_id")[k].as_py(), text))
            size += len(text)
            if size > most:
                yield result(rows, id_type)
                size, rows = 0, [pending]
        if len(rows) > 1 or (rows and pending is None):
            yield result(rows, id_type)


def fingerprints(docs: DataFrame, rows_per_range: int = 500, most_ranges: int = 4096) -> DataFrame:
    """docs(doc_id, text), numeric ids -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. At most most_ranges + 1 range bounds come to the driver and are broadcast."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    ids = docs.select(F.col("doc_id").cast("double").alias("_id"))
    parts = max(1, min(most_ranges, ids.count() // rows_per_range))
    cuts = sorted(set(ids.approxQuantile("_id", [k / parts for k in range(1, parts)], 1 / (4 * parts)))) if parts > 1 else []
    splits = [-math.inf, *cuts, math.inf] if cuts else [-math.inf, 0.0, math.inf]
    # Bucketizer keeps null ids as the bucket after the last; here they come before the first.
    dealt = Bucketizer(splits=splits, inputCol="_id", outputCol="_range", handleInvalid="keep").transform(docs.withColumn("_id", F.col("doc_id").cast("double")))
    dealt = dealt.select("doc_id", "text", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.col("_range").cast("int")).alias("range"))
    firsts = sorted((r["range"], r["first"]) for r in dealt.groupBy("range").agg(F.max("doc_id").alias("first")).collect())
    # The first document of each range is a guest of the range before it in descending order; that of the highest, of the lowest.
    guests = [(first, firsts[(k + 1) % len(firsts)][0]) for k, (_, first) in enumerate(firsts)]
    table = docs.sparkSession.createDataFrame(guests, f"_first {id_type}, _host int")
    placed = dealt.join(F.broadcast(table), F.col("doc_id").eqNullSafe(F.col("_first")), "left")
    places = F.filter(F.array(F.struct(F.col("range"), F.lit(False).alias("guest")), F.struct(F.col("_host").alias("range"), F.lit(True).alias("guest"))), lambda p: p["range"].isNotNull())
    spread = placed.select("doc_id", "text", F.explode(places).alias("_place")).select(F.col("_place.range").alias("range"), F.col("_place.guest").alias("guest"), "doc_id", "text")
    ordered = spread.repartition("range").sortWithinPartitions("range", "guest", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    schema = f"doc_id {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInArrow(_compared, schema)
