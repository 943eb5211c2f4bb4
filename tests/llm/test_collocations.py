"""Collocations against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from evidentia.llm import collocations


def brute(rows, least=10, inside=50, top=2000):
    f, n = {}, Counter()
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for size in (1, 2, 3):
                for k in range(len(w) - size + 1):
                    key = (lang, tuple(w[k : k + size]))
                    f[key] = f.get(key, 0) + 1
    out = {}
    for (lang, words), a in f.items():
        if len(words) == 1 or a < least:
            continue
        cuts = [(1_000_000 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        if len(words) == 2 and any(x[0] == lang and len(x[1]) == 3 and words in (x[1][:2], x[1][1:]) and b >= least and 100 * b >= inside * a for x, b in f.items()):
            continue
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    return sorted((lang, k, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, items in out.items() for k, x in enumerate(sorted(items)[:top], 1))


def rows_of_all_kinds():
    rng = random.Random(11)
    names = ["the", "of", "New", "york", "city", "été", "Ünder", "ünder", "a-b", "x\x00y", " ", "ß", "co", "op", "zz"]
    rows = []
    for k in range(300):
        words = [rng.choice(names) for _ in range(rng.randrange(60))]
        text = "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", ", ", "\n", "!", " ?"]) for w in words)
        rows.append((text + "San Francisco bay area. " * rng.randrange(3), rng.choice(["en", "en", "en", "fr", None, "und", ""])))
    return rows + [(None, "en"), ("", "en"), ("   ", None), (".,;", "fr"), ("hot pair " * 20_000, "en"), *[("same same", "de")] * 12, *[("nine times", "nl")] * 9]


@pytest.fixture(scope="module")
def small():
    return rows_of_all_kinds()


def found(spark, rows, **options):
    frame = spark.createDataFrame([(t, lang, 7) for t, lang in rows], "text string, lang string, n int")
    made = collocations.collocations(frame, **options)
    assert made.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert all(kind == "bigint" for c, kind in made.dtypes if c not in ("lang", "phrase"))
    return sorted(map(tuple, made.collect()))


def test_phrases(spark, small):
    assert found(spark, small) == brute(small)


def test_top_and_bounds(spark, small):
    assert found(spark, small, least=25, inside_percent=90, top=5) == brute(small, 25, 90, 5)


def test_nothing(spark):
    assert found(spark, []) == [] == found(spark, [("a b", "en"), (None, None)])


def test_counts_beyond_the_ranks(spark, small, monkeypatch):
    """Words and pairs without a rank are counted by their hashes: the same result with ranks for few or none."""
    whole = brute(small)
    ranked = collocations.ranked
    for kept in (0, 3):
        def few(counts):
            monkeypatch.setattr(collocations, "HEAD", kept)
            try:
                return ranked(counts)
            finally:
                monkeypatch.undo()

        with pytest.MonkeyPatch.context() as m:
            m.setattr(collocations, "ranked", few)
            assert found(spark, small) == whole


def test_tiles_count_like_a_counter(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(collocations, "DENSE", 500)
    left = np.minimum(rng.geometric(0.002, 30_000) - 1, collocations.HEAD - 1) * rng.choice([1, 1, 1, 40, -(2**40)], 30_000)
    right = np.minimum(rng.geometric(0.002, 30_000) - 1, collocations.HEAD - 1) * rng.choice([1, 1, 30], 30_000) % collocations.HEAD
    left = np.where(left > 0, left % collocations.HEAD, left)
    tiles = collocations.Tiles()
    tiles.add(left[:9], right[:9])
    tiles.add(left[9:], right[9:])
    rows = [x for b in tiles.counted() for x in zip(*(b.column(c).to_pylist() for c in "lrn"))]
    assert len({x[:2] for x in rows}) == len(rows)
    assert {x[:2]: x[2] for x in rows} == Counter(zip(left.tolist(), right.tolist()))
    assert list(tiles.counted()) == []


def test_pairs_whose_hashes_meet_are_told_apart(monkeypatch):
    monkeypatch.setattr(collocations, "pair_key", lambda a, b: (a % 3).view(np.uint64))
    left, right = np.array([-1, -4, -1, -4, -2], np.int64), np.array([5, 5, 5, 6, 5], np.int64)
    rows = list(zip(*map(list, collocations._by_hash(left, right))))
    assert dict(((a, b), n) for a, b, n in rows) == Counter(zip(left.tolist(), right.tolist()))
