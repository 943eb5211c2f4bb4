"""Encoding and decoding with a merge-type SentencePiece model, with seeded merge-dropout.

Symbols begin as single letters; an agenda gives the neighbouring pair whose union is the best piece of the model, the
leftmost at a tie. With dropout, a merge that the agenda gives is passed over when a hash keyed by the seed, the
occurrence and the merge's place is below the rate, so a seed always gives the same segmentation and other seeds
give others. A unit is a run of spaces with the word after it: no piece of such a model reaches from a word into the
next space, so units are independent. An occurrence is a text and a unit's position in it, so a unit may be cut in as many
ways as its merges allow.

What the agenda gives next depends on the unit and on which merges were passed over so far, and on nothing else. So the
ways of a unit form a tree: a node is a merge, with one branch for merging and one for passing over, a leaf is a
segmentation. Each occurrence goes down its unit's tree by its own key; branches that no occurrence took before are
merged and added. The trees hold no more than memo_bytes; then they are begun anew, which changes no result.

Decoding joins the pieces, turns byte pieces back to bytes and markers to spaces. A marker that stands in the
text itself is written in bytes, so that every text comes back as it was.

Defined results: null texts are empty, have no pieces and decode to the empty text; letters that the model lacks
are written in bytes; repeated rows are rows of their own; an empty table gives an empty result; further columns
are not read.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import mixed, short_batches, slices

MARK = "▁"
#: Units of a text that begins with a marker.
_UNITS = re.compile(rf"{MARK}*[^{MARK}]+|{MARK}+")
#: Stands for a marker of the text itself until it is written in bytes; no valid text holds a lone surrogate.
_OWN_MARK = "\ud800"

_PAIR_FACTOR = 0x9E3779B97F4A7C15
_NONE = 2**31 - 1
#: No symbol: what stands beyond a unit's end and where a symbol was merged into the one before.
_NO = 1 << 30
#: So many units are merged at once, which keeps their arrays in the processor's cache.
_AT_ONCE = 16_384
#: Units up to these lengths share an array; longer ones are merged one by one, with a heap for an agenda.
_WIDTHS = (4, 6, 8, 10, 12, 16, 24, 32, 48, 64)
#: A branch that is not known yet; leaves are numbered from -2 down.
_UNKNOWN = -1


def _ragged(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The indices begin[k], begin[k] + 1, ... of all k in a row, count[k] of each."""
    ends = np.cumsum(count)
    return np.repeat(begin - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


class _Rows:
    """An array that grows."""

    def __init__(self, kind: type) -> None:
        self.data, self.n = np.empty(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.data):
            wider = np.empty(max(2 * len(self.data), self.n + len(values)), self.data.dtype)
            wider[: self.n] = self.data[: self.n]
            self.data = wider
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)


class _Numbers(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


@dataclass
class Merged:
    """Of many units in a row: the ids of their pieces, and the merges that the agenda gave, each with its place and whether it was passed over."""

    ids: np.ndarray
    n_ids: np.ndarray
    places: np.ndarray
    passed: np.ndarray
    n_steps: np.ndarray

    def taken(self, order: np.ndarray) -> Merged:
        """The units in another order."""
        at_ids, at_steps = (_ragged((np.cumsum(n) - n)[order], n[order]) for n in (self.n_ids, self.n_steps))
        return Merged(self.ids[at_ids], self.n_ids[order], self.places[at_steps], self.passed[at_steps], self.n_steps[order])


class PieceModel:
    def __init__(self, path: str, dropout: float = 0.0, seed: int = 0, memo_bytes: int = 64 << 20):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.pieces = [model.id_to_piece(k) for k in range(n)]
        self.ids, self.order = {}, {}
        plain = [k for k in range(n) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]
        place = {score: k for k, score in enumerate(sorted({-model.get_score(k) for k in plain}))}
        for k in plain:
            self.ids[self.pieces[k]] = k
            self.order[self.pieces[k]] = place[-model.get_score(k)]
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = np.full(n, -1, np.int16)
        self.byte_of[self.byte_ids] = np.arange(256)
        self.shown = [piece.replace(MARK, " ") for piece in self.pieces]
        self.control = np.array([model.is_control(k) or model.is_unknown(k) for k in range(n)])
        self.dropout = int(dropout * 2**32)
        self.seed = seed
        self.memo_bytes = memo_bytes
        self._pair_table()
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.letters = _Numbers(), 0
        self.root = _Rows(np.int32)
        #: Of each node its merge's place, and where merging and passing over lead: a node, a leaf or _UNKNOWN.
        self.place, self.branch = _Rows(np.uint32), _Rows(np.int32)
        self.leaf_begin, self.leaf_count, self.pool = _Rows(np.int64), _Rows(np.int32), _Rows(np.int32)

    def _held(self) -> int:
        """About as many bytes as the trees take, with the dictionary of units."""
        return 4 * self.letters + 160 * len(self.numbers) + sum(r.data.nbytes for r in (self.root, self.place, self.branch, self.leaf_begin, self.leaf_count, self.pool))

    def _pair_table(self) -> None:
        """A hash table in arrays of all pairs of pieces whose union is a piece: pair, union, order of the union."""
        found = []
        for piece, k in self.ids.items():
            for cut in range(1, len(piece)):
                left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if left is not None and right is not None:
                    found.append((left << 32 | right, k, self.order[piece]))
        bits = max(8, (2 * len(found)).bit_length())
        self.shift, mask = np.uint64(64 - bits), (1 << bits) - 1
        self.pair = np.full(1 << bits, -1, np.int64)
        self.union, self.union_order = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
        for pair, k, order in found:
            at = (pair * _PAIR_FACTOR & 0xFFFFFFFFFFFFFFFF) >> (64 - bits)
            while self.pair[at] != -1:
                at = (at + 1) & mask
            self.pair[at], self.union[at], self.union_order[at] = pair, k, order

    def _unions(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each pair the union's id and order; _NONE as order where there is no such piece."""
        pair = left.astype(np.int64) << 32 | right
        at = ((pair.view(np.uint64) * np.uint64(_PAIR_FACTOR)) >> self.shift).view(np.int64)
        found = self.pair[at]
        open_ = np.flatnonzero((found != pair) & (found != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.pair) - 1)
            found[open_] = self.pair[at[open_]]
            open_ = open_[(found[open_] != pair[open_]) & (found[open_] != -1)]
        return self.union[at], np.where(found == pair, self.union_order[at], _NONE)

    @staticmethod
    def _merge_place(left, length, right):
        """A number for a merge's place in its unit; of one merge or of arrays of merges alike."""
        return (left * 0x9E3779B1 + length * 0x85EBCA77 + right * 0xC2B2AE3D) & 0xFFFFFFFF

    def _dropped(self, key, place):
        """Whether the keyed hash passes a merge over; of Python numbers or of arrays of 32 bits alike."""
        x = (key + place) & 0xFFFFFFFF
        x = ((x ^ (x >> 16)) * 0x7FEB352D) & 0xFFFFFFFF
        x = ((x ^ (x >> 15)) * 0x846CA68B) & 0xFFFFFFFF
        return (x ^ (x >> 16)) < self.dropout

    def merge_many(self, wanted: list[str], keys: np.ndarray | None = None) -> Merged:
        """Merge many units, with dropout if they have keys. Units of like lengths advance one agenda step at a time together."""
        lengths = np.array([len(u) for u in wanted], np.int64)
        order = np.argsort(lengths, kind="stable")
        wanted, lengths = [wanted[j] for j in order.tolist()], lengths[order]
        keys = None if keys is None else keys[order]
        n_short = int(np.searchsorted(lengths, _WIDTHS[-1], "right"))
        letters = np.frombuffer("".join(wanted[:n_short]).encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = np.flatnonzero(np.bincount(letters))
        spelled, name_of = [], np.zeros(int(kinds[-1]) + 1 if len(kinds) else 0, np.int32)
        for c in kinds.tolist():
            known = self.ids.get(chr(c))
            if known is None:
                known = len(self.pieces) + len(spelled)
                spelled.append(self._in_bytes(chr(c)))
            name_of[c] = known
        symbols, begin = name_of[letters], np.concatenate([[0], np.cumsum(lengths)])
        cuts = sorted({0, n_short, *np.searchsorted(lengths[:n_short], _WIDTHS, "right").tolist()})
        parts = []
        for first, last in zip(cuts, cuts[1:]):
            for a in range(first, last, _AT_ONCE):
                b = min(last, a + _AT_ONCE)
                parts.append(self._merge_columns(symbols[begin[a] : begin[b]], lengths[a:b], None if keys is None else keys[a:b]))
        if spelled:
            parts = [self._spelled(part, spelled) for part in parts]
        parts += [self._merge(unit, None if keys is None else int(keys[n_short + k])) for k, unit in enumerate(wanted[n_short:])]
        both = Merged(*[np.concatenate([getattr(p, f) for p in parts]) for f in ("ids", "n_ids", "places", "passed", "n_steps")])
        return both.taken(np.argsort(order))

    def _merge_columns(self, symbols: np.ndarray, lengths: np.ndarray, keys: np.ndarray | None) -> Merged:
        """A unit is a column, a symbol stands in the row of its first letter; the rows beyond a unit's end hold no symbol."""
        n, width = len(lengths), int(lengths[-1])
        column = np.repeat(np.arange(n), lengths)
        row = np.arange(len(symbols)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        symbol = np.full((width + 1) * n, _NO, np.int32)
        symbol[row * n + column] = symbols
        after = np.repeat(np.arange(1, width + 2), n)
        before = np.repeat([width, *range(width)], n)
        union, agenda = np.zeros(len(symbol), np.int32), np.full(len(symbol), _NONE, np.int32)
        union[:-n], first = self._unions(symbol[:-n], symbol[n:])
        agenda[:-n] = np.where(first == _NONE, _NONE, first << 7 | np.repeat(np.arange(width, dtype=np.int32), n))
        steps = []
        while True:
            best = agenda.reshape(width + 1, n).min(axis=0)
            column = np.flatnonzero(best != _NONE)
            if not len(column):
                break
            at = (best[column] & 127).astype(np.int64)
            left = at * n + column
            other = after[left]
            end = after[other * n + column]
            agenda[left] = _NONE
            place = self._merge_place(at, end - at, other).astype(np.uint32)
            if keys is not None:
                over = self._dropped(keys[column], place)
                steps.append((column, place, over))
                go = ~over
                column, at, left, other, end = column[go], at[go], left[go], other[go], end[go]
            right, ahead, behind = other * n + column, end * n + column, before[left]
            symbol[left], symbol[right] = union[left], _NO
            agenda[right] = _NONE
            after[left], before[ahead] = end, at
            lower = np.concatenate([left, behind * n + column])
            union[lower], order = self._unions(symbol[lower], symbol[np.concatenate([ahead, left])])
            agenda[lower] = np.where(order == _NONE, _NONE, order << 7 | np.concatenate([at, behind]).astype(np.int32))
        alive = symbol.reshape(width + 1, n).T != _NO
        owner, place, over = (np.concatenate([s[k] for s in steps]) if steps else np.zeros(0, kind) for k, kind in enumerate((np.int64, np.uint32, bool)))
        by_unit = np.argsort(owner, kind="stable")
        return Merged(symbol.reshape(width + 1, n).T[alive], alive.sum(axis=1), place[by_unit], over[by_unit], np.bincount(owner, minlength=n))

    def _spelled(self, part: Merged, spelled: list[list[int]]) -> Merged:
        """The same with the letters that the model lacks in bytes; their symbols come after the model's pieces."""
        kind = part.ids - len(self.pieces)
        odd = np.flatnonzero(kind >= 0)
        if not len(odd):
            return part
        times = np.ones(len(kind), np.int64)
        times[odd] = [len(spelled[k]) for k in kind[odd].tolist()]
        ids = np.repeat(part.ids, times)
        ids[_ragged((np.cumsum(times) - times)[odd], times[odd])] = [b for k in kind[odd].tolist() for b in spelled[k]]
        n_ids = np.bincount(np.repeat(np.arange(len(part.n_ids)), part.n_ids), times, len(part.n_ids)).astype(np.int64)
        return Merged(ids, n_ids, part.places, part.passed, part.n_steps)

    def _merge(self, unit: str, key: int | None) -> Merged:
        """One unit, with a heap for an agenda."""
        order, symbols = self.order, list(unit)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for k in range(n - 1):
            both = symbols[k] + symbols[k + 1]
            if both in order:
                agenda.append((order[both], k, both))
        heapq.heapify(agenda)
        places, passed = [], []
        while agenda:
            _, k, both = heapq.heappop(agenda)
            right = after[k]
            if not symbols[k] or right >= n or symbols[k] + symbols[right] != both:
                continue
            if key is not None:
                places.append(self._merge_place(k, len(both), right))
                passed.append(self._dropped(key, places[-1]))
                if passed[-1]:
                    continue
            symbols[k], symbols[right] = both, ""
            after[k] = after[right]
            if after[k] < n:
                before[after[k]] = k
                wider = both + symbols[after[k]]
                if wider in order:
                    heapq.heappush(agenda, (order[wider], k, wider))
            if before[k] >= 0:
                wider = symbols[before[k]] + both
                if wider in order:
                    heapq.heappush(agenda, (order[wider], before[k], wider))
        ids = [i for s in symbols if s for i in ([self.ids[s]] if s in self.ids else self._in_bytes(s))]
        one = lambda x: np.array([len(x)])
        return Merged(np.array(ids, np.int32), one(ids), np.array(places, np.uint32), np.array(passed, bool), one(places))

    def _in_bytes(self, letter: str) -> list[int]:
        return [self.byte_ids[b] for b in (MARK if letter == _OWN_MARK else letter).encode()]

    def _units(self, text: str) -> list[str]:
        """The units of a text, each without its first marker."""
        if not text:
            return []
        if MARK in text:
            text = text.replace(MARK, _OWN_MARK)
        if text[0] != " " and "  " not in text:
            return text.split(" ")
        return [u[1:] for u in _UNITS.findall(MARK + text.replace(" ", MARK))]

    def _keys(self, text: str, n: int) -> np.ndarray:
        """A key for each of the n occurrences of a text."""
        start = xxhash.xxh64_intdigest(text.replace(MARK, _OWN_MARK).encode("utf-8", "surrogatepass"), seed=self.seed)
        return mixed(np.arange(n, dtype=np.uint64) + np.uint64(start)).astype(np.uint32)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The piece ids of all texts in a row, and where each text's begin (one entry more than texts)."""
        if self._held() > self.memo_bytes:
            self._forget()
        split = [self._units(t) for t in texts]
        units = [u for own in split for u in own]
        if not units:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        keys = np.concatenate([self._keys(t, len(own)) for t, own in zip(texts, split) if own]) if self.dropout else None
        leaf = self._leaves(units, keys)
        count = self.leaf_count.data[leaf]
        ids = self.pool.data[_ragged(self.leaf_begin.data[leaf], count)]
        ends = np.concatenate([[0], np.cumsum(count)])
        return ids, ends[np.concatenate([[0], np.cumsum([len(own) for own in split])])]

    def _leaves(self, units: list[str], keys: np.ndarray | None) -> np.ndarray:
        """The leaf of each occurrence."""
        number = np.fromiter(map(self.numbers.__getitem__, units), np.int64, len(units))
        self.root.add(np.full(len(self.numbers) - self.root.n, _UNKNOWN, np.int32))
        now = self.root.data[number]
        #: Which branch led here: below 0 that of a unit to its tree, else of a node, 2 for each.
        branch, depth = -1 - number, np.zeros(len(units), np.int32)
        left = np.arange(len(units))
        while True:
            walking = left[now[left] >= 0]
            while len(walking):
                node = now[walking]
                branch[walking] = taken = 2 * node.astype(np.int64) + self._dropped(keys[walking], self.place.data[node])
                depth[walking] += 1
                now[walking] = after = self.branch.data[taken]
                walking = walking[after >= 0]
            left = left[now[left] == _UNKNOWN]
            if not len(left):
                return -2 - now.astype(np.int64)
            _, first = np.unique(branch[left], return_index=True)
            self._grow(units, keys, left[first], branch, depth)
            at = branch[left]
            now[left] = np.where(at < 0, self.root.data[np.where(at < 0, -1 - at, 0)], self.branch.data[np.where(at < 0, 0, at)])

    def _grow(self, units: list[str], keys: np.ndarray | None, at: np.ndarray, branch: np.ndarray, depth: np.ndarray) -> None:
        """Merge the occurrences at `at`, whose branches differ and are unknown, and add what lies beyond these branches."""
        merged = self.merge_many([MARK + units[j] for j in at.tolist()], None if keys is None else keys[at])
        fresh = merged.n_steps - depth[at]
        step = _ragged(np.cumsum(merged.n_steps) - fresh, fresh)
        ends = np.cumsum(fresh)
        leaf = -2 - (self.leaf_count.n + np.arange(len(at)))
        below = self.place.n + np.arange(1, len(step) + 1)
        below[ends[fresh > 0] - 1] = leaf[fresh > 0]
        pairs = np.full(2 * len(step), _UNKNOWN, np.int32)
        pairs[2 * np.arange(len(step)) + merged.passed[step]] = below
        top = np.where(fresh > 0, self.place.n + ends - fresh, leaf)
        self.place.add(merged.places[step])
        self.branch.add(pairs)
        self.leaf_begin.add(self.pool.n + np.cumsum(merged.n_ids) - merged.n_ids)
        self.leaf_count.add(merged.n_ids)
        self.pool.add(merged.ids)
        own = branch[at]
        of_unit = own < 0
        self.root.data[-1 - own[of_unit]] = top[of_unit]
        self.branch.data[own[~of_unit]] = top[~of_unit]
        self.letters += sum(len(units[j]) for j in at[of_unit].tolist())

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        shown = list(map(self.shown.__getitem__, ids.tolist()))
        octets = self.byte_of[ids]
        at = np.flatnonzero(octets >= 0)
        if len(at):
            begin = at[np.concatenate([[True], at[1:] != at[:-1] + 1])]
            end = at[np.concatenate([at[1:] != at[:-1] + 1, [True]])] + 1
            octets = octets.astype(np.uint8)
            for a, b in zip(begin.tolist(), end.tolist()):
                shown[a:b] = [octets[a:b].tobytes().decode("utf-8", "replace"), *[""] * (b - a - 1)]
        return "".join(shown)[1:]


@lru_cache(maxsize=1)
def _model(path: str, dropout: float, seed: int) -> PieceModel:
    """One model for all tasks of a Python worker, so that later tasks know the units of earlier ones."""
    return PieceModel(path, dropout, seed)


def encoded(docs: DataFrame, model: str, dropout: float = 0.1, seed: int = 1) -> DataFrame:
    """docs(doc_id, text) -> doc_id, ids, decoded, lossless. model: the path of a merge-type SentencePiece model."""
    short_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _model(model, dropout, seed)
        for batch in batches:
            for part in slices(batch, most=1 << 20):
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids, begin = coder.encode_all(texts)
                bounds = begin.tolist()
                decoded = [coder.decode(ids[a:b]) for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(ids)), pa.array(decoded, pa.string()), pa.array([a == b for a, b in zip(texts, decoded)])],
                    ["doc_id", "ids", "decoded", "lossless"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, ids array<int>, decoded string, lossless boolean")
