"""Quality by supervised subword embeddings.

A text is the average of learned vectors of its words, of its pairs of neighbouring words and of its character n-grams, all
hashed to a fixed number of buckets; a word that repeats the word before it counts in a bucket of its own. A softmax layer turns the average
into label probabilities. Vectors and layer are trained together by stochastic gradient descent in numpy on a bounded
sample of labelled rows. The layer being linear in the average, a trained model folds to one number for each bucket
(its vector's logit difference), so scoring is a table lookup and a mean for each text, over whole texts.

Defined results: null and empty texts have no features and score by the layer's constant; without labels of both
kinds every score is 0.5; repeated rows are rows of their own; an empty table gives an empty result; further
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SpanHash, is_white, mixed, short_batches, slices, utf8, word_spans
from .labelled import labelled_sample

BUCKET_BITS = 18
#: The bucket of repeats, after those that features are hashed to.
REPEAT = 1 << BUCKET_BITS
BUCKETS = REPEAT + 1
GRAMS = (3, 4, 5)
_GRAM_FACTOR = np.uint32(0x9E3779B1)
_PAIR_FACTOR = np.uint64(0xD1342543DE82EF95)


def _characters(octets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 texts in a row, and where each text begins."""
    lead = (octets & 0xC0) != 0x80
    if lead.all():
        return octets.astype(np.uint32), at
    return np.frombuffer(octets.tobytes().decode().encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum(lead)])[at]


def buckets_of(texts: pa.Array, span_hash: SpanHash) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of all texts in a row, kind by kind: the buckets of their features, and for each the text that has it.
    Words are whole; grams may reach the white space on either side of a word but not across it."""
    points, at = _characters(*utf8(texts))
    white = is_white(np.minimum(points, 255))
    text_at = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    start, end, counts = word_spans(np.where(white, 0x20, 0x61), at)
    word_text = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    names = span_hash(mixed(points.astype(np.uint64) + np.uint64(1)) | np.uint64(1), start, end)
    place = lambda h: (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
    out = [(place(names), word_text)]
    near = np.flatnonzero(word_text[1:] == word_text[:-1])
    again = names[near] == names[near + 1]
    out.append((np.where(again, REPEAT, place(mixed(names[near] * _PAIR_FACTOR + names[near + 1]))).astype(np.int32), word_text[near]))
    code = np.where(white, np.uint32(0), points) + np.uint32(1)
    for n in GRAMS:
        m = len(points) - n + 1
        if m <= 0:
            continue
        gram = np.full(m, n, np.uint32)
        for k in range(n):
            gram *= np.uint32(0x01000193)
            gram ^= code[k : k + m]
        whole = text_at[:m] == text_at[n - 1 :]
        for k in range(1, n - 1):
            whole &= ~white[k : k + m]
        gram *= _GRAM_FACTOR
        gram ^= gram >> np.uint32(15)
        gram *= np.uint32(0x85EBCA77)
        out.append(((gram[whole] >> np.uint32(32 - BUCKET_BITS)).astype(np.int32), text_at[:m][whole]))
    return out


@dataclass
class Model:
    #: For each bucket the logit difference of label 1 that its vector adds.
    logits: np.ndarray
    bias: float

    def scores(self, texts: pa.Array, span_hash: SpanHash) -> np.ndarray:
        n = len(texts)
        total, number = np.zeros(n), np.zeros(n)
        for buckets, text in buckets_of(texts, span_hash):
            total += np.bincount(text, self.logits[buckets], n)
            number += np.bincount(text, minlength=n)
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(number, 1) + self.bias, -30, 30)))


@dataclass
class Embeddings:
    """A trained model before it is folded: a vector for each bucket and the softmax layer."""

    vectors: np.ndarray
    layer: np.ndarray
    bias: np.ndarray

    def folded(self) -> Model:
        return Model((self.vectors @ (self.layer[1] - self.layer[0])).astype(np.float32), float(self.bias[1] - self.bias[0]))


def train(sample: list[tuple[str, int]], dim: int = 8, epochs: int = 5, least_steps: int = 4000, rate: float = 1.0, seed: int = 7) -> Embeddings:
    """Stochastic gradient descent, one text at a time, at a rate that falls to zero. A small sample is gone through oftener, for
    least_steps in all."""
    labels = np.array([label for _, label in sample], int)
    layer, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    if len(set(labels.tolist())) < 2:
        return Embeddings(np.zeros((BUCKETS, dim), np.float32), layer, bias)
    random, span_hash, bags = np.random.default_rng(seed), SpanHash(), []
    for text, _ in sample:
        found = np.concatenate([b for b, _ in buckets_of(pa.array([text], pa.large_string()), span_hash)])
        ids, n = np.unique(found, return_counts=True)
        bags.append((ids, (n / max(1, n.sum())).astype(np.float32)))
    vectors = random.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    epochs = max(epochs, -(-least_steps // len(bags)))
    done, steps = 0, epochs * len(bags)
    for _ in range(epochs):
        for k in random.permutation(len(bags)):
            ids, share = bags[k]
            hidden = share @ vectors[ids] if len(ids) else np.zeros(dim, np.float32)
            logit = layer @ hidden + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[labels[k]] -= 1
            step = np.float32(rate * (1 - done / steps))
            back = layer.T @ p
            layer -= step * np.outer(p, hidden)
            bias -= step * np.float32(0.1) * p
            if len(ids):
                # One rate for a vector whatever the text's length: shares are scaled to the largest of the text.
                vectors[ids] -= (step * len(ids) ** 0.5) * share[:, None] * back[None, :]
            done += 1
    return Embeddings(vectors, layer, bias)


def scores(docs: DataFrame, model: Model) -> Column:
    """A column expression of the quality of docs' text."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        span_hash = SpanHash()
        for texts in batches:
            found = [model.scores(part.column("text"), span_hash) for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]))]
            yield pa.array(np.concatenate(found) if found else np.zeros(0))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "double")(F.coalesce("text", F.lit("")))


def quality(docs: DataFrame, labels: DataFrame, learn: Column, sample_rows: int = 3000) -> DataFrame:
    """docs(doc_id, text) -> doc_id, score. The model is trained on up to sample_rows labels for which `learn`
    holds; doc_id serves to find their texts only."""
    model = train(labelled_sample(docs, labels, "quality", learn, sample_rows)).folded()
    return docs.select("doc_id", scores(docs, model).alias("score"))


def of_quality(docs: DataFrame, labels: DataFrame, learn: Column, threshold: float = 0.3, sample_rows: int = 3000) -> DataFrame:
    """docs whose score is the threshold or more, with their columns."""
    model = train(labelled_sample(docs, labels, "quality", learn, sample_rows)).folded()
    return docs.filter(scores(docs, model) >= threshold)
