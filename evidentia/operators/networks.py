"""Addresses and the networks that they lie in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import addresses
from ..sources.shared import cut_lineage
from .latest import as_of


def network_borders(networks: DataFrame, network: str, value: str) -> DataFrame:
    """networks(network, value) -> (family, at, cover): from key `at` to the next border of its family, addresses lie in the network of
    cover(bits, network, value), or in none. Of rows of one network the least value counts.

    A network begins at its first address. After its last one, the longest network around it that goes on takes over: it is looked up
    under each shorter prefix that occurs, by one equi-join over the networks, not over the addresses."""
    key = addresses.address_key(F.substring_index(network, "/", 1))
    nets = networks.select(key.alias("_key"), F.col(network).alias("network"), F.col(value).alias("value"))
    nets = nets.withColumn("bits", addresses.prefix_bits(F.col("network"), F.col("_key"))).filter("_key is not null and bits is not null")
    nets = nets.select(addresses.first_key(F.col("_key"), F.col("bits")).alias("first"), addresses.last_key(F.col("_key"), F.col("bits")).alias("last"), "bits", "network", "value")
    nets = cut_lineage(nets.groupBy("first", "last", "bits").agg(F.min("network").alias("network"), F.min("value").alias("value")))
    cover = F.struct("bits", "network", "value")
    begins = nets.groupBy(F.col("first").alias("at")).agg(F.max_by(cover, "bits").alias("cover"))
    # At most 33 and 129 lengths of prefixes.
    lengths = F.array_sort(F.collect_set(F.struct(F.substring("first", 1, 1).alias("family"), "bits")))
    known = nets.agg(lengths.alias("l")).first()["l"]
    shorter = F.filter(F.array(*[F.struct(F.lit(r["family"]).alias("family"), F.lit(r["bits"]).alias("bits")) for r in known]) if known else F.array().cast("array<struct<family:string,bits:int>>"),
                       lambda x: (x["family"] == F.substring("first", 1, 1)) & (x["bits"] < F.col("bits")))
    looked = nets.select("first", "last", F.explode(F.transform(shorter, lambda x: x["bits"])).alias("_bits"))
    looked = looked.select("last", F.col("_bits"), addresses.first_key(F.col("first"), F.col("_bits")).alias("_first"))
    around = nets.select(F.col("first").alias("_first"), F.col("bits").alias("_bits"), F.col("last").alias("_last"), cover.alias("cover"))
    after = looked.distinct().join(around, ["_first", "_bits"]).filter(F.col("_last") > F.col("last")).groupBy("last").agg(F.max_by("cover", "_bits").alias("cover"))
    ends = nets.select("last").distinct().join(after, "last", "left").select(F.concat("last", F.lit(addresses.AFTER)).alias("at"), "cover")
    return begins.union(ends).select(F.substring("at", 1, 1).alias("family"), "at", "cover")


def longest_networks(rows: DataFrame, ip: str, networks: DataFrame, network: str, value: str) -> DataFrame:
    """rows with `network` and `value` of the longest network that each row's address lies in; null for what is no address or lies in none.
    rows has neither column. Addresses are ordered once together with the borders of the networks; nothing is compared by pairs."""
    keyed = rows.withColumn("_at", addresses.address_key(F.col(ip))).withColumn("_family", F.substring("_at", 1, 1))
    borders = network_borders(networks, network, value).select(F.col("family").alias("_family"), F.col("at").alias("_border"), "cover")
    placed = as_of(keyed, borders, "_family", "_at", "_border", "cover", "_border")
    return placed.select(*[F.col(c) for c in rows.columns], F.col("cover.network").alias(network), F.col("cover.value").alias(value))
