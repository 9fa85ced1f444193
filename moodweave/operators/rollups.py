"""Roll-ups over score rows, ranks, quality scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import settle


def by_period_and_type(rows: DataFrame, period: str, kind: str, value: str) -> DataFrame:
    """n, mean and median of value by period and type, and by period over all types (type ALL), in one pass over the rows."""
    rows = rows.where(F.col(period).isNotNull() & F.col(kind).isNotNull())
    # Rows are first counted by value, so a median sorts distinct values of a group, and a running count finds its middle.
    counted = rows.groupBy(period, kind, value).agg(F.count("*").alias("c"), F.sum(value).alias("s"))
    both = counted.groupingSets([[period, kind, value], [period, value]], period, kind, value).agg(F.grouping_id().alias("g"), F.sum("c").alias("c"), F.sum("s").alias("s"))
    both = both.select(period, F.when(F.col("g") > 0, "ALL").otherwise(F.col(kind)).alias(kind), value, "c", "s")
    group = Window.partitionBy(period, kind)
    known = F.when(F.col(value).isNotNull(), F.col("c")).otherwise(0)
    upto = F.sum(known).over(group.orderBy(F.col(value).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    placed = both.withColumns({"known": known, "upto": upto, "all": F.sum(known).over(group)})
    low, high = F.floor((F.col("all") - 1) / 2), F.floor(F.col("all") / 2)  # places from 0 of the middle values
    here = lambda at: (F.col("upto") > at) & (F.col("upto") - F.col("known") <= at)
    grouped = placed.groupBy(period, kind).agg(F.sum("c").alias("n"), (F.sum("s") / F.sum("known")).alias("mean"), ((F.max(F.when(here(low), F.col(value))) + F.max(F.when(here(high), F.col(value)))) / 2).alias("median"))
    return grouped.select(period, kind, "n", "mean", "median")


def numbered(df: DataFrame, *order: Column, name: str = "row") -> DataFrame:
    """df with a global row number from 1 in the given total order, without putting all rows in one task.

    Rows are range-partitioned and numbered within partitions; the partitions' sizes, a row each, give what to add.
    """
    placed = settle(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("__part")).agg((F.max(F.col("__at").bitwiseAND((1 << 33) - 1)) + 1).alias("__n"))
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    out = placed.withColumn("__part", part).join(F.broadcast(before), "__part")
    return out.withColumn(name, F.col("__at").bitwiseAND((1 << 33) - 1) + F.col("__before") + 1).drop("__at", "__part", "__before")


def tertiles(df: DataFrame, *order: Column) -> DataFrame:
    """df with tertile low, mid or high by rank, cut at n div 3 and 2n div 3."""
    n = df.count()
    return numbered(df, *order).withColumn("tertile", F.when(F.col("row") <= n // 3, "low").when(F.col("row") <= 2 * n // 3, "mid").otherwise("high")).drop("row")


def top_per_group(rows: DataFrame, group: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each group with their rank; ranks above k never leave a map task."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def upper_median(x: str) -> Column:
    """The element at place n div 2 (from 0) of the sorted values."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {x} DESC)")


def signal_stats(rows: DataFrame, flag: str = "low_emotion_signal", signal: str = "emotion_signal_per_1k_words") -> DataFrame:
    """One row: docs, low_emotion_signal, its rate, and the mean signal of the rows that have one."""
    low = F.count_if(F.col(flag))
    return rows.agg(F.count("*").alias("docs"), low.alias("low_emotion_signal"), F.when(F.count("*") > 0, low / F.count("*")).alias("low_emotion_signal_rate"), F.avg(signal).alias("emotion_signal_per_1k_words_mean"))


def compare_runs(runs: dict[str, DataFrame], **names) -> DataFrame:
    """signal_stats of runs over the same documents, a row a run, with what differs from the first run."""
    out, base = None, None
    for i, (run, rows) in enumerate(runs.items()):
        s = signal_stats(rows, **names).withColumns({"run": F.lit(run), "place": F.lit(i)})
        out = s if out is None else out.unionByName(s)
    first = out.where("place = 0").select(F.col("low_emotion_signal_rate").alias("base_rate"), F.col("emotion_signal_per_1k_words_mean").alias("base_mean"))
    return out.join(F.broadcast(first)).withColumns({"rate_change": F.col("low_emotion_signal_rate") - F.col("base_rate"), "mean_change": F.col("emotion_signal_per_1k_words_mean") - F.col("base_mean")}).drop("place", "base_rate", "base_mean")  # one row


def intensity_of(rows: DataFrame, i: Column) -> Column:
    """A document's value of an emotion for a ranking: the first that its row has of calibrated and plain counts per thousand words,
    mixed rates, calibrated and plain distributions."""
    from .measures import measure

    kinds = ("pred_counts_calibrated_per_1k_words", "pred_counts_per_1k_words", "pred_mixscaled_per_1k_words", "pred_dist_calibrated", "pred_dist")
    base = {k: k.removesuffix("_per_1k_words") if k.startswith("pred_counts") else k for k in kinds}
    have = [k for k in kinds if base[k] in rows.columns]
    if not have:
        raise ValueError("no measure to rank by")
    return F.coalesce(*[F.try_element_at(measure(k), (i + 1).cast("int")) for k in have])


def strongest_documents(rows: DataFrame, emotions: int, k: int, key: str = "doc_id") -> DataFrame:
    """(emotion, rank, key, score): for each emotion the k documents of the highest `intensity_of`, ties by key; documents flagged low, and
    those without a value, take no part."""
    open_ = rows.where(~F.coalesce("low_emotion_signal", F.lit(False))) if "low_emotion_signal" in rows.columns else rows
    at = open_.withColumn("emotion", F.explode(F.sequence(F.lit(0), F.lit(emotions - 1))))
    scored = at.select(key, "emotion", F.round(intensity_of(rows, F.col("emotion")), 6).alias("score")).where("score is not null")
    return top_per_group(scored, "emotion", k, F.desc("score"), F.col(key)).select("emotion", "rank", key, "score")


def separation(distance: str, same: Column) -> Column:
    """(mean between - mean within) over the pooled population deviation."""
    within, between = F.when(same, F.col(distance)), F.when(~same, F.col(distance))
    return (F.avg(between) - F.avg(within)) / F.sqrt((F.var_pop(within) + F.var_pop(between)) / 2)


def scorecard(coverage: Column, top1: Column, effect: Column, explained: Column, zero_share: Column) -> tuple[Column, Column]:
    """Score of 100 from coverage (35), same-kind nearest neighbours (20), separation (25) and explanations (20), less up to 20 for
    documents without a term; and the verdict."""
    part = lambda x, full, points: points * F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / full))
    score = part(coverage, 0.1, 35.0) + part(top1, 1.0, 20.0) + part(effect, 2.0, 25.0) + part(explained, 1.0, 20.0) - part(zero_share, 0.5, 20.0)
    score = F.greatest(F.lit(0.0), score)
    return score, F.when(score >= 75, "strong").when(score >= 50, "usable").otherwise("weak")


def guard_reasons(limits: dict[str, tuple[str, float]]) -> Column:
    """Messages of the limits that a row of statistics breaks: name to (least or most, value)."""
    told = [F.when((F.col(c) < v) if kind == "least" else (F.col(c) > v), F.lit(f"{c} {'below' if kind == 'least' else 'above'} {v:g}")) for c, (kind, v) in limits.items()]
    return F.array_compact(F.array(*told))
