"""Toxicity by a weighted lexicon that an Aho-Corasick automaton finds in folded text.

Folding lower-cases a text, takes accents off and maps look-alike letters and the digits and signs that stand for letters, so
that disguised words meet the lexicon. A sign that may stand for several letters or for none (AMBIGUOUS) is read each way. The
lexicon begins with a list of insults and grows by a bounded sample of labelled rows: words, beginnings of words, and phrases of
two words. What is learned must occur far oftener in toxic texts than in clean ones, in many of them and between many
different neighbours, which the copies of one text never give. Entries match from the start of a word; a phrase matches whole words. An entry's weight is its log odds. Phrases on the
exception list hide the entries inside them. A text's raw score is the sum of the weights found, and its final score a
logistic function of that sum and of the sum by length, with coefficients fitted on the same sample.

Defined results: null and empty texts score as texts in which nothing is found; without labelled rows the
lexicon is empty and every score is 0.5; repeated rows are rows of their own; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import median

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import short_batches, slices
from .labelled import labelled_sample

#: Letters of other scripts, digits and signs, each with the Latin letter that it passes for.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k",
    "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b",
    "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s",
}
_FOLDED = str.maketrans(LOOKALIKES | {z: "" for z in "\u200b\u200c\u200d\u2060\ufeff\u00ad"})
#: Signs with several readings: before folding, each reading's letters. In the first a sign parts words, and 1 is an i.
AMBIGUOUS = ({}, {"!": "i", "|": "i"}, {"!": "i", "|": "l", "1": "l"})
_READINGS = [str.maketrans(r) for r in AMBIGUOUS]
_SIGNS = re.compile(r"[1!|](?=\w)")

#: Phrases in which a lexicon entry does no harm.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "clownfish", "scumbling", "stupidity of war", "sore loser clause")

#: Insults that the lexicon begins with; labelled texts set their weights.
SEEDS = tuple("asshole bastard bitch clown cunt disgusting filth fuck idiot imbecile loser moron pathetic scum shithead slut stupid subhuman trash vermin whore worthless".split())
#: Coefficients while there are too few labels to fit them.
UNFITTED = (-4.0, 1.7, 0.3)

_TOKEN = re.compile(r"[^\W_]+")


def plain(text: str) -> str:
    """Lower case, without accents and in plain widths."""
    text = text.lower()
    if text.isascii():
        return text
    return "".join([c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)])


def fold(text: str) -> str:
    """The first reading of a text."""
    return plain(text).translate(_FOLDED)


def readings(text: str) -> list[str]:
    """All different readings of a text; they have the same length and places."""
    text = plain(text)
    if not _SIGNS.search(text):
        return [text.translate(_FOLDED)]
    return list(dict.fromkeys(text.translate(r).translate(_FOLDED) for r in _READINGS))


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    #: Of the constant, the logarithm of the raw score, and the raw score per 100 words.
    coefficients: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            out.add_word(entry, (len(entry), weight, " " not in entry))
        for phrase in self.exceptions:
            out.add_word(fold(phrase), (len(fold(phrase)), None, True))
        out.make_automaton()
        return out

    def features(self, text: str, automaton: ahocorasick.Automaton) -> tuple[float, float]:
        best: dict[int, float] = {}
        hidden, found = [], []
        for folded in readings(text):
            for end, (length, weight, is_stem) in automaton.iter(folded):
                start = end - length + 1
                if (start == 0 or not folded[start - 1].isalnum()) and (is_stem or end + 1 == len(folded) or not folded[end + 1].isalnum()):
                    (hidden if weight is None else found).append((start, end, weight))
        if not found:
            return 0.0, 0.0
        for start, end, weight in found:
            if not any(a <= start and end <= b for a, b, _ in hidden):
                best[start] = max(weight, best.get(start, 0.0))
        raw = sum(best.values())
        return math.log1p(raw), 100 * raw / (1 + len(text.split()))

    def score(self, text: str, automaton: ahocorasick.Automaton) -> float:
        log_raw, density = self.features(text, automaton)
        a, b, c = self.coefficients
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * log_raw + c * density))))


def _beginnings(word: str, shortest: int = 4, longest: int = 16) -> list[str]:
    return [word[:k] for k in range(shortest, min(longest, len(word)) + 1)]


def _pairs(tokens: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(tokens, tokens[1:])]


def learn_lexicon(sample: list[tuple[str, int]], entries: int = 400, least_texts: int = 10, least_log_odds: float = 2.5) -> Lexicon:
    """Entries are taken by the log odds of their rates per word in toxic and in clean texts; an entry must occur in least_texts
    different toxic texts, between as many different neighbours (the words before and after it), and be likelier than by chance by so many
    log odds. Equal texts count once. A beginning that never occurs without its next letter is left to the longer one. A seed that
    does not occur has the median weight of those that do."""
    texts = {text: label for text, label in sample}
    if not texts:
        return Lexicon({})
    if len(set(texts.values())) < 2:
        return Lexicon(dict.fromkeys(SEEDS, 4.0), coefficients=UNFITTED)
    # Of toxic texts the words are kept; clean ones are gone through one by one and counted for entries of toxic ones only.
    bad = [_TOKEN.findall(fold(text)) for text, label in texts.items() if label]
    toxic, in_texts = Counter(), Counter()
    for tokens in bad:
        own = Counter(b for w in tokens for b in _beginnings(w))
        own.update(_pairs(tokens))
        toxic.update(own)
        in_texts.update(own.keys())
    often = {e for e, n in in_texts.items() if n >= least_texts}
    clean, words, n_clean = Counter(), Counter(), 1
    for text, label in texts.items():
        if not label:
            tokens = _TOKEN.findall(fold(text))
            n_clean += len(tokens)
            words.update(tokens)
            clean.update(often.intersection(own := _pairs(tokens)) and [p for p in own if p in often])
    for word, n in words.items():
        for beginning in often.intersection(_beginnings(word)):
            clean[beginning] += n
    n_toxic = sum(map(len, bad)) + 1
    rate = {e: math.log((toxic[e] + 0.5) / n_toxic) - math.log((clean[e] + 0.5) / n_clean) for e in often}
    same_as_longer = {e[:-1] for e in toxic if toxic[e[:-1]] == toxic[e]}
    likely = {e for e, r in rate.items() if r >= least_log_odds and e not in same_as_longer}
    neighbours: dict[str, set] = {e: set() for e in likely}
    for tokens in bad:
        around = ["", *tokens, ""]
        for k, token in enumerate(tokens):
            for entry in likely.intersection(_beginnings(token)):
                neighbours[entry].add((around[k], around[k + 2]))
            if k + 1 < len(tokens) and (entry := f"{token} {tokens[k + 1]}") in likely:
                neighbours[entry].add((around[k], around[k + 3]))
    ranked = sorted((e for e in likely if len(neighbours[e]) >= least_texts), key=lambda e: (-rate[e], e))
    own = {e: round(rate[e], 4) for e in ranked if not any(e != s and e.startswith(s) for s in SEEDS)}
    known = [own[s] for s in SEEDS if s in own]
    weights = dict.fromkeys(SEEDS, median(known) if known else 4.0) | dict(list(own.items())[:entries])
    lexicon = Lexicon(weights)
    automaton = lexicon.automaton()
    x = np.array([(1.0, *lexicon.features(text, automaton)) for text, _ in sample])
    y = np.array([float(label) for _, label in sample])
    w = np.zeros(3)
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x.T * (p * (1 - p))) @ x + 0.05 * np.eye(3), x.T @ (y - p) - 0.05 * w)
    lexicon.coefficients = tuple(float(v) for v in w)
    return lexicon


def scores(docs: DataFrame, lexicon: Lexicon) -> Column:
    """A column expression of the toxicity of docs' text."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = lexicon.automaton()
        for texts in batches:
            found = [lexicon.score(t or "", automaton) for part in slices(pa.RecordBatch.from_arrays([texts], ["text"])) for t in part.column(0).to_pylist()]
            yield pa.array(found, pa.float64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "double")(F.coalesce("text", F.lit("")))


def toxicity(docs: DataFrame, labels: DataFrame, learn: Column, sample_rows: int = 6000) -> DataFrame:
    """docs(doc_id, text) -> doc_id, score. The lexicon is learned from up to sample_rows labels for which `learn`
    holds; doc_id serves to find their texts only."""
    lexicon = learn_lexicon(labelled_sample(docs, labels, "toxic", learn, sample_rows))
    return docs.select("doc_id", scores(docs, lexicon).alias("score"))


def without_toxic(docs: DataFrame, labels: DataFrame, learn: Column, threshold: float = 0.3, sample_rows: int = 6000) -> DataFrame:
    """docs whose score is below the threshold, with their columns."""
    lexicon = learn_lexicon(labelled_sample(docs, labels, "toxic", learn, sample_rows))
    return docs.filter(scores(docs, lexicon) < threshold)
