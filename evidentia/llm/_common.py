"""What the corpus operators share: the word pattern, shared scratch space, Arrow batches and hashing."""

from __future__ import annotations
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .scratch import shared_folder

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that the operators handle at once; a longer text is handled alone.
CHUNK_BYTES = 1 << 18
#: Rows of an Arrow batch at most, as texts may be long.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there, so that a lost executor costs no earlier stage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def short_batches(spark: SparkSession) -> None:
    """Let the session's Arrow batches have BATCH_ROWS rows at most: both sides of a Python worker hold whole batches of texts."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= BATCH_ROWS:
        spark.conf.set(setting, str(BATCH_ROWS))


def slices(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about `most` bytes together, or one longer text alone."""
    if batch.num_rows == 0:
        return
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < batch.num_rows:
        done = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, done + most, side="right")))
        yield batch.slice(first, last - first)
        first = last


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each begins (one entry more than texts). Null is empty."""
    texts = column.cast(pa.large_string()).fill_null("")
    texts = pa.concat_arrays([texts]) if texts.offset == 0 else pa.array(texts.to_pylist(), pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1)
    octets = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return octets[at[0] : at[-1]], at - at[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (xor-shift and multiply rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class SpanHash:
    """Hashes of any spans of an array of 64-bit words by one running sum: words are weighted by powers of an odd
    base modulo 2**64, and a span's sum is divided by the power at its start, so equal spans agree at any place.
    Powers are kept for the next call, up to KEPT of them."""

    BASE = 0x9E3779B97F4A7C15
    KEPT = 1 << 19

    def __init__(self) -> None:
        self.power = self.inverse = np.zeros(0, np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n <= len(self.power):
            return self.power, self.inverse
        size = max(n, 1 << 16)
        power = np.cumprod(np.full(size, self.BASE, np.uint64))
        inverse = np.cumprod(np.full(size, pow(self.BASE, -1, 1 << 64), np.uint64))
        if size <= self.KEPT:
            self.power, self.inverse = power, inverse
        return power, inverse

    def __call__(self, words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of words[start:end] for each pair; spans are not empty."""
        if len(start) == 0:
            return np.zeros(0, np.uint64)
        power, inverse = self._powers(len(words))
        total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * power[: len(words)], out=total[1:])
        return mixed((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


#: A random 64-bit word for each byte value, from a fixed seed.
BYTE_WORDS = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def is_white(octets: np.ndarray) -> np.ndarray:
    return _WHITE[octets]


def word_spans(octets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and the number of words in each text."""
    n = len(octets)
    inside = ~_WHITE[octets]
    fresh = np.zeros(n + 1, bool)
    fresh[at] = True
    before = np.concatenate([[False], inside[:-1]]) if n else inside
    start = np.flatnonzero(inside & (~before | fresh[:n]))
    after = np.concatenate([inside[1:], [False]]) if n else inside
    end = np.flatnonzero(inside & (~after | fresh[1:])) + 1
    first = np.searchsorted(start, at)
    return start, end, np.diff(first)
