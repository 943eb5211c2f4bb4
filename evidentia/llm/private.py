"""Personal data: e-mail addresses, IP addresses, card numbers and telephone numbers, by DataFrame functions alone.

Generators of high recall propose spans, which may overlap: for each kind the base pattern with its check, and a wide pattern for
forms that the base does not know (spelled-out addresses, IPv6, cards with other separators, national numbers). Boosted trees score a
span by its format and its context. They learn from all documents: what the base patterns accept against what only
the wide ones propose, by features that do not tell which of both proposed it. Documents whose texts' crc32 is a multiple of
five are kept out of learning; on them each kind's threshold is set where spans of at least that score are base spans to
`precision`. A wide span is added if it scores as much and meets no base span; of wide spans that meet, the better one. Base
spans stay as they are.

Features are small whole numbers, so learning sees one row for each combination of them (at most CELLS), counted by Spark over
all spans; only that table and the trees are on the driver. Texts are read once: spans with their features are stored.

Defined results: null texts are empty; repeated rows are rows of their own; a doc_id of any type is carried on; an empty
table gives an empty result; places are code points, ends exclusive; further columns are ignored by personal_spans and kept by
redacted. Patterns never backtrack into long runs, so a text costs time in proportion to its length.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut_lineage

KINDS = ("email", "ip", "card", "phone")

#: Leftmost matches of the base patterns. Possessive loops and the look-behinds change no match: a run that fails from its beginning fails
#: from each of its signs.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?[\[({]\x20?(?:at|AT|@)\x20?[\])}]\x20?|\x20(?:at|AT)\x20)[A-Za-z0-9-]++(?:(?:\x20?[\[({]\x20?(?:dot|DOT|\.)\x20?[\])}]\x20?|\x20(?:dot|DOT)\x20|\.)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}(?:[./_\x20-]{1,3}[0-9]{4}){3}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+.,/-])(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[\x20.-]\(?[0-9]{2,5}\)?){2,4}(?![0-9A-Za-z])",
}
#: What a text must hold for a pattern to be tried.
HINTS = {"email": ("@",), "ip": (".",), "card": (), "phone": ("+",)}
WIDE_HINTS = {"email": (" at ", " AT ", "at]", "at)", "AT]", "AT)", "@]", "@)", "at }", "@}"), "ip": (":",), "card": (), "phone": ()}
#: Words that announce a kind.
CUES = {
    "email": r"(?i)e-?mail|contact|write to|correo|courriel|adresse",
    "ip": r"(?i)\bip\b|address|host|server|client|login from",
    "card": r"(?i)card|visa|master|amex|credit|debit|karte|carte|tarjeta",
    "phone": r"(?i)tel|phone|call|mobile|fax|whatsapp|telefon|appel|llam",
}
#: Signs before a span that its context takes in.
CONTEXT = 30

FEATURES = {"kind": 4, "digits": 25, "groups": 9, "left": 3, "right": 3, "cue": 2, "check": 2, "length": 11}
#: Combinations of features that there can be.
CELLS = int(np.prod(list(FEATURES.values())))


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def step(total: Column, place: Column) -> Column:
        digit = F.substring(F.reverse(digits), place, F.lit(1)).cast("int")
        return total + F.when(place % 2 == 1, digit).otherwise(digit * 2 - F.when(digit > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def checked(kind: str, found: Column) -> Column:
    """Whether a match of a base pattern counts."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(found, r"\."), lambda p: F.when(F.length(part(p)) <= 3, part(p).cast("int") <= 255).otherwise(F.lit(False)))
    size = F.length(_digits(found))
    if kind == "phone":
        return size.between(9, 15)
    return F.when(size.between(13, 19), luhn(_digits(found))).otherwise(F.lit(False))


def plausible(kind: str, found: Column) -> Column:
    """A kind's check as a feature, for both its patterns."""
    if kind == "email":
        return found.rlike(r"[A-Za-z]{2,10}$")
    if kind == "ip":
        return F.when(found.contains(":"), F.size(F.split(found, ":")) == 8).otherwise(F.lit(True))
    if kind == "phone":
        return F.length(_digits(found)).between(9, 15)
    return luhn(_digits(found))


def plain_form(kind: str, found: Column) -> Column:
    """A span as its base pattern would have it, so that features tell forms apart, not spellings: spelled-out signs of addresses are signs."""
    if kind != "email":
        return found
    sign = lambda word, mark, x: F.regexp_replace(x, rf"(?i)\x20?[\[({{]\x20?(?:{word}|{re.escape(mark)})\x20?[\])}}]\x20?|\x20{word}\x20", mark)
    return sign("dot", ".", sign("at", "@", found))


def _sign(sign: Column) -> Column:
    """0: none or a blank, 1: another sign, 2: a letter, a digit or what joins them."""
    return F.when(F.coalesce(sign, F.lit("")).rlike(r"^\s*$"), 0).when(sign.rlike(r"[\p{L}\p{N}_@/=]"), 2).otherwise(1)


def proposed(text: Column, kind: str, pattern: str, base: bool) -> Column:
    """The matches of a pattern that count, with their places and features: array<struct<kind, start, end, base, FEATURES...>>. What lies between
    the matches gives their places and contexts, so a text is gone through once."""
    number = KINDS.index(kind)
    between = F.split(text, pattern, -1)
    zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), between.alias("before"), F.slice(between, F.lit(2), F.size(between)).alias("after"))

    def span(x: Column, start: Column, end: Column) -> Column:
        found = plain_form(kind, x["found"])
        values = {
            "digits": F.least(F.length(_digits(found)), F.lit(24)), "groups": F.least(F.size(F.split(found, r"[^0-9A-Za-z]+")), F.lit(8)),
            "left": _sign(F.right(x["before"], F.lit(1))), "right": _sign(F.left(x["after"], F.lit(1))),
            "cue": F.right(x["before"], F.lit(CONTEXT)).rlike(CUES[kind]).cast("int"), "check": plausible(kind, found).cast("int"), "length": F.least(F.floor(F.length(found) / 4), F.lit(10)),
        }
        return F.struct(F.lit(number).alias("kind"), start.alias("start"), end.alias("end"), F.lit(base).alias("base"), *[v.cast("int").alias(k) for k, v in values.items()])

    none = F.array().cast(SPANS)

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["before"])
        end = start + F.coalesce(F.length(x["found"]), F.lit(0))
        counts = x["found"].isNotNull() & (checked(kind, x["found"]) if base else F.lit(True))
        return F.struct(end.alias("at"), F.when(counts, F.concat(state["out"], F.array(span(x, start, end)))).otherwise(state["out"]).alias("out"))

    all_spans = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda s: s["out"])
    hints = (HINTS if base else WIDE_HINTS)[kind]
    may = F.lit(False)
    for hint in hints:
        may = may | text.contains(hint)
    # Numbers are found in few texts: the plain test for a run of them spares the others both passes.
    may = may if hints else text.rlike(r"[0-9][^\p{L}]{0,3}[0-9][^\p{L}]{0,3}[0-9]")
    return F.when(may, all_spans).otherwise(none)


SPANS = "array<struct<kind:int,start:int,end:int,base:boolean,digits:int,groups:int,left:int,right:int,cue:int,check:int,length:int>>"


def candidates(text: Column) -> Column:
    """All proposed spans of a text, wide ones that meet a base span left out, sorted by their beginnings."""
    text = F.coalesce(text, F.lit(""))
    lists = [proposed(text, k, BASE[k], True) for k in KINDS] + [proposed(text, k, WIDE[k], False) for k in KINDS]
    return without_met(F.sort_array(F.transform(F.concat(*lists), lambda x: F.struct(x["start"].alias("at"), (~x["base"]).alias("second"), x.alias("x")))))


def without_met(items: Column) -> Column:
    """Sorted (at, second, x) -> the x that are base spans or meet none: forwards against ends of base spans before them, and
    backwards against beginnings of those after them."""
    none = F.array().cast(SPANS)

    def forwards(state: Column, i: Column) -> Column:
        x = i["x"]
        out = F.when(x["base"] | (x["start"] >= state["end"]), F.concat(state["out"], F.array(x))).otherwise(state["out"])
        return F.struct(F.when(x["base"], F.greatest(state["end"], x["end"])).otherwise(state["end"]).alias("end"), out.alias("out"))

    def backwards(state: Column, x: Column) -> Column:
        out = F.when(x["base"] | (x["end"] <= state["begin"]), F.concat(state["out"], F.array(x))).otherwise(state["out"])
        return F.struct(F.when(x["base"], F.least(state["begin"], x["start"])).otherwise(state["begin"]).alias("begin"), out.alias("out"))

    first = F.aggregate(items, F.struct(F.lit(0).alias("end"), none.alias("out")), forwards, lambda s: s["out"])
    met = F.aggregate(F.reverse(first), F.struct(F.lit(2**31 - 1).alias("begin"), none.alias("out")), backwards, lambda s: F.reverse(s["out"]))
    return F.when(F.exists(items, lambda i: i["second"]), met).otherwise(F.transform(items, lambda i: i["x"]))


# --- boosted trees --------------------------------------------------------------------------------------------------------------


class Boosted:
    """Trees of two levels over whole-number features, by gradient boosting of the logistic loss on counted rows."""

    def __init__(self, trees: list[tuple], thresholds: dict[int, float]) -> None:
        self.trees, self.thresholds = trees, thresholds

    @classmethod
    def fit(cls, x: np.ndarray, good: np.ndarray, bad: np.ndarray, held: np.ndarray, rounds: int = 30, rate: float = 0.3, precision: float = 0.98, least: int = 50) -> Boosted:
        """x: rows of features; good and bad: how many base spans and others have them; held: rows that set the thresholds."""
        trees: list[tuple] = []
        margin = np.zeros(len(x))
        weight = np.where(held, 0, good + bad).astype(float)
        share = good / np.maximum(good + bad, 1)
        for _ in range(rounds if weight.sum() else 0):
            p = 1 / (1 + np.exp(-margin))
            gradient, hessian = weight * (share - p), weight * p * (1 - p)
            f, t = _best_split(x, gradient, hessian, np.ones(len(x), bool))
            low = x[:, f] <= t
            sides = []
            for side in (low, ~low):
                g, s = _best_split(x, gradient, hessian, side)
                leaves = [rate * gradient[side & part].sum() / (hessian[side & part].sum() + 1.0) for part in (x[:, g] <= s, x[:, g] > s)]
                margin[side] += np.where(x[side, g] <= s, *leaves)
                sides.append((g, s, *leaves))
            trees.append((f, t, *sides))
        model = cls(trees, {})
        model.thresholds = {k: model._threshold(k, x, margin, good, bad, held, precision, least) for k in range(len(KINDS))}
        return model

    @staticmethod
    def _threshold(kind: int, x: np.ndarray, margin: np.ndarray, good: np.ndarray, bad: np.ndarray, held: np.ndarray, precision: float, least: int) -> float:
        """The least score from which on a kind's held spans are base spans to `precision`, and at least `least` of them; else infinite."""
        of = np.flatnonzero(held & (x[:, 0] == kind))
        of = of[np.argsort(-margin[of], kind="stable")]
        right, all_ = np.cumsum(good[of]), np.cumsum((good + bad)[of])
        last = np.append(margin[of][1:] != margin[of][:-1], True)[: len(of)]  # rows of one score stand or fall together
        fit = np.flatnonzero(last & (right >= precision * all_) & (all_ >= least))
        return float(margin[of][fit[-1]]) if len(fit) else float("inf")

    def score(self, span: Column) -> Column:
        """The margin of a span, as an expression."""
        names = list(FEATURES)
        total = F.lit(0.0)
        for f, t, *sides in self.trees:
            low, high = (F.when(span[names[g]] <= int(s), float(a)).otherwise(float(b)) for g, s, a, b in sides)
            total = total + F.when(span[names[f]] <= int(t), low).otherwise(high)
        return total

    def accepts(self, span: Column) -> Column:
        wanted = F.lit(False)
        for kind, threshold in self.thresholds.items():
            if np.isfinite(threshold):
                wanted = wanted | ((span["kind"] == kind) & (self.score(span) >= F.lit(threshold - 1e-9)))
        return wanted


def _best_split(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray) -> tuple[int, int]:
    """The feature and bound whose halves fit the gradients best."""
    best, place = -1.0, (0, 0)
    for f, size in enumerate(FEATURES.values()):
        g = np.bincount(x[rows, f], gradient[rows], size)
        h = np.bincount(x[rows, f], hessian[rows], size)
        below, weight = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = below**2 / (weight + 1) + (g.sum() - below) ** 2 / (h.sum() - weight + 1)
        k = int(np.argmax(gain))
        if gain[k] > best + 1e-12:
            best, place = float(gain[k]), (f, k)
    return place


def learned(found: DataFrame, precision: float = 0.98) -> Boosted:
    """found(spans, held): a model of all spans. One row for each combination of features comes to the driver, CELLS and their halves at
    most."""
    rows = found.select("held", F.explode("spans").alias("s"))
    cells = rows.groupBy("held", *[F.col(f"s.{f}").alias(f) for f in FEATURES]).agg(F.count_if("s.base").alias("good"), F.count_if(~F.col("s.base")).alias("bad"))
    table = sorted(tuple(r) for r in cells.collect())
    values = np.array(table, np.int64).reshape(-1, len(FEATURES) + 3)
    return Boosted.fit(values[:, 1:-2], values[:, -2], values[:, -1], values[:, 0] == 1, precision=precision)


# --- documents ------------------------------------------------------------------------------------------------------------------


def selected(spans: Column, model: Boosted) -> Column:
    """Base spans and the wide ones that the model accepts, by kind and place; of accepted ones that meet, the one with the best score, and
    of equals the first."""
    none = F.array().cast(SPANS)
    ranked = F.sort_array(F.transform(F.filter(spans, lambda x: ~x["base"] & model.accepts(x)), lambda x: F.struct((-model.score(x)).alias("s"), x["start"].alias("at"), x.alias("x"))))

    def step(out: Column, i: Column) -> Column:
        x = i["x"]
        return F.when(F.exists(out, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])), out).otherwise(F.concat(out, F.array(x)))

    added = F.aggregate(ranked, none, step)
    return F.sort_array(F.concat(F.filter(spans, lambda x: x["base"]), added))


def written(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def personal_spans(docs: DataFrame, precision: float = 0.98) -> DataFrame:
    """docs(doc_id, text) -> doc_id, spans: array<struct<kind, start, end, base, ...>>, by kind (as in KINDS) and place."""
    return _with_spans(docs.select("doc_id", "text"), precision).select("doc_id", "spans")


def _with_spans(docs: DataFrame, precision: float, *keep: str) -> DataFrame:
    held = (F.crc32(F.coalesce("text", F.lit(""))) % 5 == 0).cast("int")
    found = cut_lineage(docs.select("doc_id", *keep, candidates(F.col("text")).alias("spans"), held.alias("held")))
    return found.withColumn("spans", selected(F.col("spans"), learned(found, precision)))


def redacted(docs: DataFrame, precision: float = 0.98) -> DataFrame:
    """docs with each span of personal data replaced by its kind in brackets; spans that meet give one."""
    named = docs.withColumn("_row", F.struct(*docs.columns))
    spans = _with_spans(named, precision, "_row")
    text = F.col("_row.text")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(state: Column, x: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, F.greatest(x["start"] - state["at"], F.lit(0)))
        apart = x["start"] >= state["at"]
        return F.struct(F.greatest(state["at"], x["end"]).alias("at"), F.when(apart, F.concat(state["out"], gap, F.get(names, x["kind"]))).otherwise(state["out"]).alias("out"))

    by_place = F.array_sort("spans", lambda a, b: F.when(a["start"] != b["start"], F.sign(a["start"] - b["start"]).cast("int")).otherwise(F.sign(b["end"] - a["end"]).cast("int")))
    rest = lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text)))
    clean = F.when(text.isNotNull(), F.aggregate(by_place, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, rest))
    return spans.select(*[clean.alias("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
