"""Mixing sources to target weights, by DataFrame functions alone.

Documents get hash-random keys. Within each source they are ordered by key, a distributed prefix sum of their
word counts says where each begins, and the source's budget is cut at its exact word. A budget above the source's
own size takes whole epochs first. No task holds a source: keys are cut into ranges, sums of ranges give each
range its offset, and rows are summed within (source, range) only.

Defined results: null or blank texts have size 0 and nothing taken; null sources form one source, the last;
repeated rows are rows of their own; documents with the same key are ordered by doc_id (nulls first), then by
the text's hash; an empty table gives an empty result; further columns of the documents are carried along
unless they bear the name of a result column or of one of the operator's own (RESULT, _OWN), which replace them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD

RESULT = ("size", "source_size", "target", "taken")
_OWN = ("_key", "_range", "_before", "_offset", "_sum", "source_key", "_copy")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_epochs: int = 3) -> DataFrame:
    """sizes(source_key, source_size), one row per source -> with target. Sources in the order of source_key weigh
    `weights` in turn and share the sum of all sizes; a target stops at most_epochs times the source's size, and the
    rest is shared again by weight. Taking sources by their limit per weight, the limited ones come first, so
    windows over this table of one row per source settle all rounds at once."""
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.row_number().over(Window.orderBy("source_key")) - 1) % len(weights) + 1)
    ranked = sizes.withColumn("_weight", weight.cast("long")).withColumn("_limit", F.col("source_size") * most_epochs)
    by_ratio = Window.orderBy(F.col("_limit").cast("double") / F.col("_weight"), "source_key")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    exact = "decimal(38,0)"
    ranked = ranked.withColumns({
        "_total": F.sum("source_size").over(everywhere),
        "_weights": F.sum("_weight").over(everywhere),
        "_limits_before": F.coalesce(F.sum("_limit").over(before), F.lit(0)),
        "_weights_before": F.coalesce(F.sum("_weight").over(before), F.lit(0)),
    })
    limited = F.col("_limit").cast(exact) * (F.col("_weights") - F.col("_weights_before")) <= F.col("_weight").cast(exact) * (F.col("_total") - F.col("_limits_before"))
    ranked = ranked.withColumn("_limited", limited)
    rest = F.col("_total") - F.sum(F.when(F.col("_limited"), F.col("_limit")).otherwise(F.lit(0))).over(everywhere)
    weights_left = F.col("_weights") - F.sum(F.when(F.col("_limited"), F.col("_weight")).otherwise(F.lit(0))).over(everywhere)
    ranked = ranked.withColumns({"_rest": rest, "_weights_left": weights_left})
    share = F.col("_rest").cast("double") / F.col("_weights_left").cast("double") * F.col("_weight")
    return ranked.select("source_key", "source_size", F.when(F.col("_limited"), F.col("_limit").cast("double")).otherwise(share).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_epochs: int = 3, seed: str = "mix-1", key_digits: int = 3) -> DataFrame:
    """docs(doc_id, source, text, ...) -> all its columns with size (words), source_size, target and taken (words of
    it that the mix takes, repeats counted). Sources by code point, nulls last, weigh `weights` in turn.
    16**key_digits key ranges split each source."""
    key = F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.lit(seed)))
    source_key = F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1"))
    docs = docs.drop(*RESULT, *_OWN)
    sized = docs.withColumns({"size": word_count(F.col("text")), "_key": key, "_range": F.substring(key, 1, key_digits), "source_key": source_key})
    ranges = sized.groupBy("source_key", "_range").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("source_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("source_key", "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    targets = source_targets(ranges.groupBy("source_key").agg(F.sum("_sum").alias("source_size")), weights, most_epochs)
    offsets = offsets.join(targets, "source_key")
    within = Window.partitionBy("source_key", "_range").orderBy("_key", F.col("doc_id").asc_nulls_first(), *([F.xxhash64("text")] if "text" in docs.columns else [])).rowsBetween(Window.unboundedPreceding, -1)
    summed = sized.withColumn("_before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = summed.join(offsets, ["source_key", "_range"])
    budget = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size") - F.col("_offset") - F.col("_before")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return placed.withColumn("taken", taken.cast("long")).drop(*_OWN)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of docs: a document for each whole or begun epoch; the one that a budget
    cuts keeps its first words, joined by single spaces. Columns of docs named as in RESULT or _OWN are null."""
    taken = mix_sources(docs, **options).filter("taken > 0")
    copies = taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    left = (F.col("taken") - (F.col("_copy") - 1) * F.col("size")).cast("int")
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})")), 1, left), " ")
    text = F.when(left < F.col("size"), cut).otherwise(F.col("text"))
    out = copies.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    hidden = {*RESULT, *_OWN}
    return out.select(*[F.lit(None).cast(docs.schema[c].dataType).alias(c) if c in hidden else c for c in docs.columns])
