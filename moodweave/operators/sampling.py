"""Seeded splits and samples; order is by the MD5 of key and seed, so every engine draws alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import settle
from .rollups import numbered


def draw(key: Column, seed: str) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def held_out_size(n: int, ratio: float) -> int:
    """Between 1 and n - 1; halves round to even."""
    return max(1, min(n - 1, round(n * ratio))) if n > 1 else 0


def split_groups(rows: DataFrame, group: str, ratio: float, seed: str) -> DataFrame:
    """(group, split): dev for the first groups in drawing order, train for the rest; a group is never divided."""
    groups = rows.select(group).distinct()
    dev = held_out_size(groups.count(), ratio)
    return numbered(groups, draw(F.col(group), seed), F.col(group)).select(group, F.when(F.col("row") <= dev, "dev").otherwise("train").alias("split"))


def stratified(rows: DataFrame, key: str, stratum: str, n: int, rest: int, seed: str) -> DataFrame:
    """(key, stratum, part): n rows of each stratum, then `rest` of all others."""
    d = rows.select(key, stratum, draw(F.col(key), seed).alias("draw"))
    ranked = d.withColumn("rank", F.row_number().over(Window.partitionBy(stratum).orderBy("draw", key))).where(F.col("rank") <= n)
    first = ranked.select(key, stratum, F.lit("stratum").alias("part"))
    others = d.join(first.select(key), key, "left_anti").orderBy("draw", key).limit(rest).select(key, stratum, F.lit("rest").alias("part"))
    return first.unionByName(others)


def balanced(rows: DataFrame, key: str, kind: str, n: int, seed: str) -> DataFrame:
    """(key, kind): n rows, as evenly as the kinds allow: an equal share of each (the first kinds by name one more), and what a
    small kind lacks from the rows that come next in drawing order."""
    kinds = settle(rows.select(kind).where(F.col(kind).isNotNull()).distinct(), "kinds")
    count = kinds.count()
    if not count:
        return rows.select(key, kind).limit(0)
    early = kinds.orderBy(kind).limit(min(n % count, n)).select(kind, F.lit(1).alias("more"))
    share = kinds.join(early, kind, "left").select(kind, (F.lit(n // count) + F.coalesce("more", F.lit(0))).alias("share"))
    d = rows.where(F.col(kind).isNotNull()).select(key, kind, draw(F.col(key), seed).alias("draw"))
    ranked = d.withColumn("rank", F.row_number().over(Window.partitionBy(kind).orderBy("draw", key))).where(F.col("rank") <= n)
    ranked = settle(ranked.join(share, kind), "ranked")  # n rows a kind at most, read three times
    first = ranked.where(F.col("rank") <= F.col("share"))
    missing = n - first.count()
    more = ranked.where(F.col("rank") > F.col("share")).orderBy("draw", key).limit(max(0, missing))
    return first.unionByName(more).select(key, kind)


def split_rows(rows: DataFrame, key: str, ratio: float, seed: str) -> DataFrame:
    """(key, split): dev for the first rows in drawing order, train for the rest."""
    return split_groups(rows, key, ratio, seed)


def simple(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows of all, those that are drawn first; every column stays."""
    return rows.orderBy(draw(F.col(key), seed), key).limit(n)


def split_counts(rows: DataFrame, split: str, groups: str, label: str) -> DataFrame:
    """(split, label, rows, groups): a histogram of labels by split, and of each split over all labels (label ALL)."""
    sets = rows.select(split, F.coalesce(F.col(label).cast("string"), F.lit("unlabelled")).alias(label), groups)
    each = sets.groupBy(split, label).agg(F.count("*").alias("rows"), F.count_distinct(groups).alias("groups"))
    whole = sets.groupBy(split).agg(F.count("*").alias("rows"), F.count_distinct(groups).alias("groups")).withColumn(label, F.lit("ALL"))
    return each.unionByName(whole)
