"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, settle


def connected_components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """Of edges (u, v): a row (node, component) for each node, component being its smallest node.

    Alternating large-star and small-star steps, each pair ending in a table in the shared folder, until the edges no longer change;
    they number O(log^2 n).  Loops, repeated edges and nulls are dropped; no edges give an empty result.  A hub's edges meet in
    a join only, where Spark splits what is skewed.
    """

    def tidy(e: DataFrame) -> DataFrame:
        return e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def mark(e: DataFrame) -> tuple:
        h = F.xxhash64("u", "v")
        r = e.agg(F.count("*").alias("n"), F.sum(F.pmod(h, F.lit(1 << 24))).alias("s"), F.bit_xor(h).alias("x")).first()
        return r["n"], r["s"], r["x"]

    now = settle(tidy(edges.select("u", "v")), label)
    seen = mark(now)
    while seen[0]:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = tidy(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = tidy(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))))
        small = settle(small, label)
        discard(now)
        now, before = small, seen
        seen = mark(now)
        if seen == before:
            break
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out._settled_at = now._settled_at  # so that it can be discarded
    return out
