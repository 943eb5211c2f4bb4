"""A bounded sample of labelled rows for the classifiers, the same at every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crc_of_id(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int, most_bytes: int = 16 << 20) -> list[tuple[str, int]]:
    """Up to `rows` labels for which `learn` holds, picked by a hash of doc_id, with their whole texts. The ids are
    picked from the labels alone, so at most `rows` of them are broadcast; of each id one text comes back, that of the least hash
    if there are several. Reading stops where the texts have most_bytes together."""
    picked = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & learn)
        .select("doc_id", F.col(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "_label")
        .limit(rows)
        .dropDuplicates(["doc_id"])
    )
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    once = found.groupBy("doc_id", "_label").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))
    out, size = [], 0
    for x in once.orderBy(F.xxhash64("doc_id"), "doc_id").select("text", "_label").toLocalIterator():
        size += len(x["text"].encode())
        if size > most_bytes:
            break
        out.append((x["text"], int(x["_label"])))
    return out
