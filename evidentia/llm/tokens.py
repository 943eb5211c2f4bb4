"""Token counts at every prefix of a text, by dynamic programming over byte-pair encodings.

The encoding of a prefix is fixed by its last token: it is the encoding of what stands before that token, and
the two tokens at the seam must be ones that byte-pair merging leaves side by side. So the counts of all prefixes of
a piece follow from shorter ones, without encoding any of them. Pieces are what the tokenizer's splitting pattern
yields; a piece's counts are kept for its next occurrence. A text's ledger holds one signed byte for each code
point: by how much the token count changes there. Running sums of the ledger answer how many tokens any prefix
has and how long a prefix a budget allows.

Defined results: null texts are empty and have 0 tokens; the added tokens of the vocabulary file count as one each where
they stand in a text, as the library has it; repeated rows are rows of their own; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ._common import slices

#: How the vocabulary's tokenizer splits a text into pieces.
_ENDINGS = r"'s|'t|'re|'ve|'m|'ll|'d"
PIECES = regex.compile(_ENDINGS + r"| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Pieces, but two or more white spaces with the piece after them: a prefix may end between these.
_UNITS = regex.compile(rf"\s{{2,}}(?:(?<! )(?:{_ENDINGS})|\p{{L}}+|\p{{N}}+|[^\s\p{{L}}\p{{N}}]+)?|{_ENDINGS}| ?\p{{L}}+| ?\p{{N}}+| ?[^\s\p{{L}}\p{{N}}]+|\s")
_ENDING = regex.compile(_ENDINGS)
_RUN = regex.compile(r"\s{2,}")
_NEVER = 1 << 40


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary, by its public rule: bytes that print stand
    for themselves, the others for the letters from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class _Memo(dict):
    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        self[key] = value = self.make(key)
        return value


class PrefixCounter:
    """Counts of a byte-level BPE vocabulary file; memo_entries bounds what is kept of pieces and of token pairs."""

    def __init__(self, path: str, memo_entries: int = 300_000):
        with open(path, encoding="utf-8") as f:
            loaded = json.load(f)
        letters = byte_letters()
        octets = lambda token: bytes(letters[c] for c in token)
        vocab = loaded["model"]["vocab"]
        self.token = {octets(t): k for t, k in vocab.items() if all(c in letters for c in t)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in loaded["model"]["merges"]]
        self.rank = {(vocab[a] << 32) | vocab[b]: r for r, (a, b) in enumerate(merges)}
        self.parts = {vocab[a + b]: (vocab[a], vocab[b], r) for r, (a, b) in reversed([*enumerate(merges)])}
        self.longest = max(map(len, self.token))
        added = [t["content"] for t in loaded["added_tokens"]]
        self.added = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.limit = memo_entries
        self.pairs: dict[int, bool] = {}
        self.left, self.right = _Memo(lambda t: self._spine(t, 0)), _Memo(lambda t: self._spine(t, 1))
        self.whole = _Memo(self._is_whole)
        #: What is known of units, in two generations: what was met lately, and what was before that.
        self.ledgers, self.old = _Memo(self._unit_ledger), {}

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at one end of a token while it is merged, from a byte up: (token, rank of the merge that ends it)."""
        out, ends = [], _NEVER
        while token in self.parts:
            out.append((token, ends))
            ends = self.parts[token][2]
            token = self.parts[token][side]
        return [*reversed([*out, (token, ends)])]

    def _stay_apart(self, a: int, b: int, before: int = _NEVER) -> bool:
        """Whether no merge of a rank below `before` joins the end of a to the start of b. Both ends grow in the order of ranks; a
        join happens if its rank comes before the merges that would use up either end, leftmost first at a tie."""
        one, two, i, j = self.right[a], self.left[b], 0, 0
        while True:
            x, x_ends = one[i]
            y, y_ends = two[j]
            r = self.rank.get((x << 32) | y, _NEVER)
            if r < before and r < x_ends and r <= y_ends:
                return False
            if x_ends == _NEVER and y_ends == _NEVER:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def _is_whole(self, token: int) -> bool:
        """Whether merging a token's bytes gives that token."""
        if token not in self.parts:
            return True
        a, b, r = self.parts[token]
        return self.whole[a] and self.whole[b] and self._stay_apart(a, b, r)

    def piece_counts(self, piece: bytes, known: tuple[list[int], list[int]]) -> tuple[list[int], list[int]]:
        """The last token and the number of tokens of each prefix of a piece, by its length in bytes; known holds those of some first prefixes."""
        n, token, pairs, whole, longest = len(piece), self.token.get, self.pairs, self.whole, self.longest
        last, count = known
        for i in range(len(last), n + 1):
            for start in range(i - longest if i > longest else 0, i):
                t = token(piece[start:i])
                if t is None:
                    continue
                if start == 0:
                    if whole[t]:
                        break
                    continue
                pair = (last[start] << 32) | t
                apart = pairs.get(pair)
                if apart is None:
                    pairs[pair] = apart = whole[t] and self._stay_apart(last[start], t)
                if apart:
                    break
            last.append(t)
            count.append(count[start] + 1)
        return last, count

    def learn(self, units: set[str]) -> None:
        """Find the ledgers of many units at once: in their order, each goes on from the prefix it shares with the one before."""
        before, last, count = b"", [0], [0]
        for unit in sorted(units):
            if not unit.isascii() or unit[0] == "'" or unit[:2].isspace():
                self.ledgers[unit] = self._unit_ledger(unit)
                continue
            piece, same = unit.encode(), 0
            for x, y in zip(piece, before):
                if x != y:
                    break
                same += 1
            del last[same + 1 :], count[same + 1 :]
            self.piece_counts(piece, (last, count))
            before = piece
            self.ledgers[unit] = bytes([(y - x) & 255 for x, y in zip(count, count[1:])])

    def _at_letters(self, piece: str) -> list[int]:
        """Tokens of each non-empty prefix of a piece, by its length in code points."""
        octets = piece.encode()
        count = self.piece_counts(octets, ([0], [0]))[1]
        if len(octets) == len(piece):
            return count[1:]
        return [count[k] for k in range(1, len(octets) + 1) if k == len(octets) or octets[k] & 0xC0 != 0x80]

    def _unit_counts(self, unit: str) -> list[int]:
        run = _RUN.match(unit)
        if run:
            white, rest = run[0], unit[run.end() :]
            counts = self._at_letters(white)
            if not rest:
                return counts
            before = counts[-2]
            if white[-1] == " ":
                return counts + [before + c for c in self._at_letters(" " + rest)[1:]]
            before += self._at_letters(white[-1])[-1]
            return counts + [before + c for c in self._unit_counts(rest)]
        if unit[0] == "'" and len(unit) > 2 and _ENDING.fullmatch(unit):
            apart = self._at_letters("'")[-1]
            return [apart, *(apart + c for c in self._at_letters(unit[1:-1])), self._at_letters(unit)[-1]]
        return self._at_letters(unit)

    def _unit_ledger(self, unit: str) -> bytes:
        counts = self._unit_counts(unit)
        return bytes([(y - x) & 255 for x, y in zip([0, *counts], counts)])

    def _segment(self, text: str) -> bytes:
        return b"".join(map(self.ledgers.__getitem__, _UNITS.findall(text)))

    def texts(self, texts: list[str]) -> list[bytes]:
        """The ledger of each text: one signed byte for each code point, the change of the token count there."""
        if len(self.ledgers) > self.limit:
            self.old, self.ledgers = dict(self.ledgers), _Memo(self._unit_ledger)
        if len(self.pairs) > self.limit:
            self.pairs.clear()
        units = [None if self.added is not None and self.added.search(t) else _UNITS.findall(t) for t in texts]
        fresh = {u for own in units if own is not None for u in own} - self.ledgers.keys()
        self.ledgers.update({u: self.old[u] for u in fresh & self.old.keys()})
        self.learn(fresh - self.ledgers.keys())
        known = self.ledgers.__getitem__
        return [self._with_added(t) if own is None else b"".join(map(known, own)) for t, own in zip(texts, units)]

    def ledger(self, text: str) -> bytes:
        return self.texts([text])[0]

    def _with_added(self, text: str) -> bytes:
        out, at = [], 0
        for found in self.added.finditer(text):
            before = text[at : found.start()]
            out.append(self._segment(before))
            tail = (_UNITS.findall(before) or [""])[-1]
            total = lambda s: sum(np.frombuffer(self._segment(s), np.int8).tolist())
            counts = [total(tail + found[0][:k]) for k in range(len(found[0]))]
            out.append(np.diff([*counts, counts[0] + 1]).astype(np.int8).tobytes())
            at = found.end()
        return b"".join([*out, self._segment(text[at:])])


@lru_cache(maxsize=2)
def _counter(vocabulary: str) -> PrefixCounter:
    """One counter for all tasks of a Python worker, so that later tasks know the units of earlier ones."""
    return PrefixCounter(vocabulary)


def prefix_ledgers(docs: DataFrame, vocabulary: str) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_tokens, ledger. vocabulary: the path of a byte-level BPE file."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary)
        for batch in batches:
            for part in slices(batch, most=4 << 20):
                ledgers = counter.texts([t or "" for t in part.column("text").to_pylist()])
                tokens = [int(np.frombuffer(x, np.int8).sum(dtype=np.int64)) for x in ledgers]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(tokens, pa.int64()), pa.array(ledgers, pa.binary())], ["doc_id", "n_bytes", "n_tokens", "ledger"])

    slim = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return slim.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long, ledger binary")


@F.pandas_udf(LongType())
def tokens_of_prefix(ledger: pd.Series, chars: pd.Series) -> pd.Series:
    """Tokens of the text's first `chars` code points."""
    return pd.Series([int(np.frombuffer(x, np.int8)[: max(0, n)].sum(dtype=np.int64)) for x, n in zip(ledger, chars)], dtype="int64")


def longest_prefix(ledger: Column, budget: int) -> Column:
    """Code points of the longest prefix that has at most `budget` tokens."""

    @F.pandas_udf(LongType())
    def within(ledgers: pd.Series) -> pd.Series:
        fits = (np.flatnonzero(np.cumsum(np.frombuffer(x, np.int8), dtype=np.int64) <= budget) for x in ledgers)
        return pd.Series([int(f[-1]) + 1 if len(f) else 0 for f in fits], dtype="int64")

    return within(ledger)
