"""Mixing sources to target weights by capped water-filling.

Each source may give at most `max_epochs` times its own words.  Sources whose weighted share exceeds that are clamped there, the
excess goes to the others by weight until none is above, and documents are then repeated: all of them a whole number of times,
and a seeded sample of them once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import settle, unused

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
BINS = 1 << 16


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than code points 9 to 13 and 32; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(key: Column, seed: str) -> Column:
    """A seeded number in [0, 2^32) for each document."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 8), 16, 10).cast("long")


def water_fill(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """sizes(source, source_size) with each source's target.

    The level L solves sum(min(max_epochs * size, L * weight)) = sum(size).  In order of cap / weight the clamped sources come
    first, so running sums give the level after each number of clamped sources; the first consistent one holds.  One row per
    source: the only data in a single task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    up = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, everything = up.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    level = ranked.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))).withColumn("ratio", F.col("cap") / F.col("weight"))
    level = level.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    final = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"]
    return level.withColumn("final", final).select("source", "source_size", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("final") * F.col("weight"), F.col("cap"))).alias("target"))


def _bin(drawn: Column) -> Column:
    return F.floor(drawn / F.lit((1 << 32) // BINS)).cast("int")


def _plan(docs: DataFrame, key: str, text: str, source: str, weights: tuple[float, ...], max_epochs: float, seed: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Narrow rows (doc_id, source, size, draw, tie, bin); (plan_source, source_size, target, whole, rest, cut_bin, cut_below) of each
    source; and (source, doc_id, size, tie, each) of the different rows of the cut bins: the words of one more taking."""
    d = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), draw(F.col(key), seed).alias("draw"), F.xxhash64(F.col(text)).alias("tie"))
    d = settle(d.withColumn("bin", _bin(F.col("draw"))), "mix-sizes")  # narrow, and read several times
    hist = d.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    targets = water_fill(hist.groupBy("source").agg(F.sum("bin_size").cast("long").alias("source_size")), weights, max_epochs)
    goal = F.round("target").cast("long")
    targets = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    targets = targets.withColumn("rest", goal - F.col("whole") * F.col("source_size"))
    targets = settle(targets.withColumnRenamed("source", "plan_source"), "mix-targets")
    below = F.coalesce(F.sum("bin_size").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = hist.withColumn("below", below).join(targets, F.col("source").eqNullSafe(F.col("plan_source"))).where((F.col("below") <= F.col("rest")) & (F.col("below") + F.col("bin_size") > F.col("rest")))
    cuts = cuts.select(F.col("source").alias("cut_source"), F.col("bin").alias("cut_bin"), F.col("below").alias("cut_below"))
    plan = settle(targets.join(cuts, F.col("plan_source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source"), "mix-plan")
    cut = d.join(plan, d["source"].eqNullSafe(plan["plan_source"]) & (F.col("bin") == F.col("cut_bin")))
    # Rows that are alike are one group, so a row repeated without end is no long window; they share what the group takes.
    alike = cut.groupBy("source", "draw", "doc_id", "size", "tie", "rest", "cut_below").agg(F.count("*").alias("copies"))
    words = F.col("size") * F.col("copies")
    ahead = F.coalesce(F.sum(words).over(Window.partitionBy("source").orderBy("draw", F.col("doc_id").asc_nulls_last(), "size", "tie").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    takes = F.greatest(F.lit(0), F.least(words, F.col("rest") - F.col("cut_below") - ahead))
    extras = alike.withColumn("each", F.round(takes / F.col("copies")).cast("long")).select("source", "doc_id", "size", "tie", "each")
    return d, plan, extras


def plan_mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """One row per document row: doc_id, source, size, source_size, target, whole (times taken in full), extra (words of one more,
    partial or full, taking) and taken.

    A source takes every document floor(target / size) times, and of the rest the documents with the lowest seeded draws: those
    in histogram bins wholly below the cut, and from the cut bin as many as reach the target, the last of them in part, so the
    source's taken words equal its rounded target.  The histogram has a fixed number of bins a source, so no task holds a source;
    only documents of one cut bin a source are ordered.  Null text counts as empty, a null source is a source, a null key draws
    as the text 'null'; long texts count whole; repeated rows are taken alike, so that where they are the last in part the words
    may differ from the target by half their number; an empty table gives an empty result.  Other columns are not read.
    """
    d, plan, extras = _plan(docs, key, text, source, weights, max_epochs, seed)
    d = d.join(plan, d["source"].eqNullSafe(plan["plan_source"])).drop("plan_source")
    e = extras.select(*[F.col(c).alias(f"e_{c}") for c in ("source", "doc_id", "size", "tie")], "each")
    inside = F.col("bin") == F.coalesce("cut_bin", F.lit(-1))
    met = F.col("source").eqNullSafe(F.col("e_source")) & F.col("doc_id").eqNullSafe(F.col("e_doc_id")) & (F.col("size") == F.col("e_size")) & F.col("tie").eqNullSafe(F.col("e_tie"))
    cut = d.where(inside).join(e, met).withColumn("extra", F.col("each"))
    other = d.where(~inside).withColumn("extra", F.when(F.col("bin") < F.coalesce("cut_bin", F.lit(-1)), F.col("size")).otherwise(F.lit(0)).cast("long"))
    columns = ("doc_id", "source", "size", "source_size", "target", "whole", "extra")
    return cut.select(*columns).unionByName(other.select(*columns)).withColumn("taken", F.col("whole") * F.col("size") + F.col("extra"))


def mix_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """docs with each row repeated as the plan says; a partial taking keeps its first words, as written.

    What a row outside the cut bins takes follows from its source and draw, so texts go from the input to the result without a
    shuffle; only the few rows of the cut bins look theirs up.  Nulls, long texts, repeated rows and empty tables are as in
    `plan_mix`.  Columns stay as they are, whatever their names (n_chars, where there is one, follows the text).
    """
    _, plan, extras = _plan(docs, key, text, source, weights, max_epochs, seed)
    own, of, how, out = unused(docs, "mix", "mix_source", "mix_plan", "mix_takes")
    mine = F.struct(word_count(F.col(text)).alias("size"), _bin(draw(F.col(key), seed)).alias("bin"))
    plan = plan.select(F.col("plan_source").alias(of), F.struct("whole", F.coalesce("cut_bin", F.lit(-1)).alias("cut_bin")).alias(how))
    rows = docs.withColumn(own, mine).join(plan, docs[source].eqNullSafe(plan[of]))
    at, cut_bin, size = F.col(own)["bin"], F.col(how)["cut_bin"], F.col(own)["size"]
    other = rows.where(at != cut_bin).withColumn(out, F.when(at < cut_bin, size).otherwise(F.lit(0)))
    e = extras.select(F.struct("source", "doc_id", "size", "tie").alias(of), F.col("each").alias(out))
    met = F.col(source).eqNullSafe(e[of]["source"]) & F.col(key).eqNullSafe(e[of]["doc_id"]) & (size == e[of]["size"]) & F.xxhash64(F.col(text)).eqNullSafe(e[of]["tie"])
    cut = rows.where(at == cut_bin).drop(of).join(e, met)
    rows = other.select(*docs.columns, own, how, out).unionByName(cut.select(*docs.columns, own, how, out))
    times = F.filter(F.concat(F.array_repeat(size, F.col(how)["whole"].cast("int")), F.array(F.col(out))), lambda n: n > 0)
    rows = rows.withColumn(out, F.explode(times))
    lead = F.regexp_extract(F.col(text), r"^[\x20\x09-\x0D]*", 0)
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), F.lit(1))
    whole = F.col(out) == size
    rows = rows.withColumn(text, F.when(whole, F.col(text)).otherwise(F.concat(lead, F.array_join(F.slice(words, F.lit(1), F.col(out).cast("int")), ""))))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType)))
    return rows.select(*docs.columns)
