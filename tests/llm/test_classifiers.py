"""The classifiers against plain forms of themselves, and on held-out texts without near copies in the sample."""

import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from evidentia.llm import queries, quality, toxicity
from evidentia.llm._common import SpanHash, mixed

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WHITE = set(" \t\n\x0b\x0c\r")
TEXTS = ["", " ", "een", "een een twee", "Straße été 日本語 😀 ok", "a b\tc\n\nd", "woord " * 50, "x" * 300, "é é  é"]


def word_name(word: str) -> int:
    points = np.array([ord(c) for c in word], np.uint64)
    return int(SpanHash()(mixed(points + np.uint64(1)) | np.uint64(1), np.array([0]), np.array([len(word)]))[0])


def plain_buckets(text: str) -> list[int]:
    """The features of a text by their definition, one at a time."""
    top = lambda h: int(h) >> (64 - quality.BUCKET_BITS)
    words = WORD.findall(text)
    out = [top(word_name(w)) for w in words]
    for a, b in zip(words, words[1:]):
        both = (word_name(a) * int(quality._PAIR_FACTOR) + word_name(b)) & (2**64 - 1)
        out.append(quality.REPEAT if a == b else top(mixed(np.array([both], np.uint64))[0]))
    for n in quality.GRAMS:
        for k in range(len(text) - n + 1):
            gram = text[k : k + n]
            if WHITE & set(gram[1:-1]):
                continue
            h = n
            for c in gram:
                h = (h * 0x01000193 & 0xFFFFFFFF) ^ ((0 if c in WHITE else ord(c)) + 1)
            h = h * int(quality._GRAM_FACTOR) & 0xFFFFFFFF
            h = (h ^ (h >> 15)) * 0x85EBCA77 & 0xFFFFFFFF
            out.append(h >> (32 - quality.BUCKET_BITS))
    return out


def test_quality_against_an_unfolded_forward_pass():
    random = np.random.default_rng(5)
    model = quality.Embeddings(random.normal(size=(quality.BUCKETS, 4)), random.normal(size=(2, 4)), random.normal(size=2))
    found = model.folded().scores(pa.array(TEXTS, pa.large_string()), SpanHash())
    for text, score in zip(TEXTS, found):
        buckets = plain_buckets(text)
        hidden = np.mean([model.vectors[b] for b in buckets], axis=0) if buckets else np.zeros(4)
        p = np.exp(model.layer @ hidden + model.bias)
        assert score == pytest.approx(p[1] / p.sum(), abs=1e-5)


def test_quality_takes_whole_letters():
    """Grams are of characters: texts that differ in the second byte of a letter only share no gram with it."""
    a, b = (set(plain_buckets(t)) for t in ("éééé", "èèèè"))
    assert not a & b and all(len(x) == 3 for x in ({*t} for t in ("aéb",)))
    batch = quality.buckets_of(pa.array(TEXTS, pa.large_string()), SpanHash())
    for k, text in enumerate(TEXTS):
        assert sorted(int(x) for ids, of in batch for x in ids[of == k]) == sorted(plain_buckets(text))


def plain_features(lexicon: toxicity.Lexicon, text: str) -> tuple[float, float]:
    """What the automaton finds, entry by entry with a pattern for each."""
    best, hidden, found = {}, [], []
    for folded in toxicity.readings(text):
        for entries, kept in ((lexicon.weights, found), (dict.fromkeys(map(toxicity.fold, lexicon.exceptions)), hidden)):
            for entry, weight in entries.items():
                ends = r"(?![^\W_])" if weight is not None and " " in entry else ""
                for m in re.finditer(rf"(?<![^\W_])(?=({re.escape(entry)}){ends})", folded):
                    if not ends or m.start() + len(entry) == len(folded) or not folded[m.start() + len(entry)].isalnum():
                        kept.append((m.start(), m.start() + len(entry), weight))
    for start, end, weight in found:
        if not any(a <= start and end <= b for a, b, _ in hidden):
            best[start] = max(weight, best.get(start, 0.0))
    raw = sum(best.values())
    return (math.log1p(raw), 100 * raw / (1 + len(text.split()))) if found else (0.0, 0.0)


def test_toxicity_against_a_plain_matcher():
    lexicon = toxicity.Lexicon(dict.fromkeys(toxicity.SEEDS, 3.0) | {"id": 1.0, "idiots": 5.0, "the clown": 2.5, "of trash": 2.0, "lo": 0.5})
    automaton = lexicon.automaton()
    texts = [
        "you 1oser c1own", "a trash can of trash", "the clown fish, the clown. the clowns", "IDIOTS!idiot !diot |diot ld1ot", "pathétic pàthetic", "semidiot id idi0t5", "", "   ", "st_upid tr@sh $tupid",
        "m|oron 1|! loser!loser", "ＩＤＩＯＴ іdiоt", "lol lo lo1", "trash bin trash", "x" * 5000 + " scum",
    ]
    for text in texts:
        assert lexicon.features(text, automaton) == pytest.approx(plain_features(lexicon, text))
    for disguised in ("1oser", "c1own", "|oser", "!diot", "pathétic", "idi0t5"):
        assert lexicon.features(f"you {disguised}", automaton)[0] > 0


@pytest.fixture(scope="module")
def labelled():
    """Labelled rows of the larger sample: (doc_id, text, quality, toxic)."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (pq.read_table(f"{sf}/{n}.parquet").to_pandas() for n in ("documents", "labels"))
    rows = labels.merge(docs, on="doc_id").fillna({"text": ""})
    return list(zip(rows.doc_id, rows.text, rows.quality, rows.toxic))


def without_copies(held: list, sample: list) -> list:
    """The held-out rows whose runs of five words mostly do not occur in the sample."""
    runs = lambda text: {tuple(w[k : k + 5]) for w in [text.split()] for k in range(max(1, len(w) - 4))}
    known = {hash(r) for x in sample for r in runs(x[1])}
    return [x for x in held if (own := runs(x[1])) and sum(hash(r) in known for r in own) < 0.2 * len(own)]


def test_toxicity_on_held_out_texts_without_near_copies(labelled):
    held = [x for x in labelled if zlib.crc32(str(x[0]).encode()) % 4 == 2]
    sample = [x for x in labelled if zlib.crc32(str(x[0]).encode()) % 4 != 2]
    lexicon = toxicity.learn_lexicon([(text, toxic) for _, text, _, toxic in sample])
    automaton = lexicon.automaton()
    fresh = without_copies(held, sample)
    said = [(lexicon.score(text, automaton) >= 0.3, bool(toxic)) for _, text, _, toxic in fresh]
    hits, toxic, predicted = sum(p and t for p, t in said), sum(t for _, t in said), sum(p for p, _ in said)
    # Of toxic labels in these tables a few are on texts that hold no insult at all.
    assert toxic > 40 and hits >= 0.85 * toxic and hits >= 0.95 * predicted


def test_quality_on_held_out_texts_without_near_copies(labelled):
    held = [x for x in labelled if zlib.crc32(str(x[0]).encode()) % 5 == 0]
    sample = [x for x in labelled if zlib.crc32(str(x[0]).encode()) % 5 != 0][:1500]
    model = quality.train([(text, q) for _, text, q, _ in sample]).folded()
    fresh = without_copies(held, sample)
    scores = model.scores(pa.array([x[1] for x in fresh], pa.large_string()), SpanHash())
    good = np.array([bool(x[2]) for x in fresh])
    assert (scores[good] >= 0.3).mean() > 0.95 and (scores[~good] < 0.3).mean() > 0.9 and (~good).sum() > 20


def test_labelled_sample_takes_one_text_of_an_id_and_stops_at_its_bytes(spark):
    from pyspark.sql import functions as F

    from evidentia.llm.labelled import labelled_sample

    docs = spark.createDataFrame([(k % 5, f"text {k} " * 10) for k in range(50)] + [(None, "x"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(5)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    found = labelled_sample(docs, labels, "quality", F.lit(True), 100)
    assert len(found) == 5 and found == labelled_sample(docs.repartition(7), labels, "quality", F.lit(True), 100)
    few = labelled_sample(docs, labels, "quality", F.lit(True), 100, most_bytes=200)
    assert len(few) < 5 and sum(len(text) for text, _ in few) <= 200


def test_registered_queries_of_the_classifiers(spark):
    """Shape and rules of the registered queries: folds by crc32 of the id, predictions by the threshold."""
    sf = "/root/testdata/sf0.001"
    for query, modulus, rest in ((queries.op1_quality, 5, 0), (queries.op7_toxicity, 4, 2)):
        rows = query(spark, sf).collect()
        assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
        for r in rows:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest)
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
