"""Classification metrics from counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(rows: DataFrame, gold: Column, predicted: Column) -> DataFrame:
    return rows.select(gold.alias("gold"), predicted.alias("predicted")).groupBy("gold", "predicted").agg(F.count("*").alias("n"))


def per_class(rows: DataFrame, gold: Column, predicted: Column) -> DataFrame:
    """(class, support, precision, recall, f1) from one count by class; absent denominators give 0."""
    cells = confusion(rows, gold, predicted)
    said = cells.select(F.explode(F.array(F.struct(F.col("gold").alias("class"), F.lit(1).alias("g"), (F.col("gold") == F.col("predicted")).cast("int").alias("t"), F.lit(0).alias("p")), F.struct(F.col("predicted").alias("class"), F.lit(0).alias("g"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("s"), "n")
    c = said.groupBy("s.class").agg(F.sum(F.col("n") * F.col("s.g")).alias("support"), F.sum(F.col("n") * F.col("s.p")).alias("claimed"), F.sum(F.col("n") * F.col("s.t")).alias("tp"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return c.select("class", "support", ratio(F.col("tp"), F.col("claimed")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"), ratio(2 * F.col("tp"), F.col("claimed") + F.col("support")).alias("f1"))


def macro_f1(rows: DataFrame, gold: Column, predicted: Column, classes: int) -> DataFrame:
    """One row: macro_f1, the mean over all `classes`, those that nobody has or claims included; hits; n."""
    each = per_class(rows, gold, predicted)
    hit = F.round(F.col("recall") * F.col("support")).cast("long")
    return each.agg((F.coalesce(F.sum(F.when(F.col("class").between(0, classes - 1), F.col("f1"))), F.lit(0.0)) / classes).alias("macro_f1"), F.sum(hit).alias("hits"), F.sum("support").alias("n"))


def multilabel_f1(rows: DataFrame, labels: dict[str, tuple[Column, Column, Column]]) -> DataFrame:
    """(label, tp, fp, fn, f1) for labels given as gold, predicted and mask, with rows MICRO and MACRO (labels with a mask only)."""
    one = [F.struct(F.lit(name).alias("label"), g.cast("int").alias("g"), p.cast("int").alias("p"), m.cast("int").alias("m")) for name, (g, p, m) in labels.items()]
    e = rows.select(F.explode(F.array(*one)).alias("x")).select("x.*").where("m = 1")
    counts = e.groupBy("label").agg(*[F.sum(c.cast("long")).alias(n) for n, c in (("tp", F.col("g") * F.col("p")), ("fp", (1 - F.col("g")) * F.col("p")), ("fn", F.col("g") * (1 - F.col("p"))))])
    f1 = lambda tp, fp, fn: F.when(tp + (fp + fn) / 2 > 0, tp / (tp + (fp + fn) / 2)).otherwise(0.0)
    each = counts.withColumn("f1", f1(F.col("tp"), F.col("fp"), F.col("fn")))
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn")]
    micro = counts.agg(*sums).select(F.lit("MICRO").alias("label"), "*").withColumn("f1", f1(F.col("tp"), F.col("fp"), F.col("fn")))
    macro = each.agg(*sums, F.avg("f1").alias("f1")).select(F.lit("MACRO").alias("label"), "*")
    return each.unionByName(micro).unionByName(macro)


def auc(rows: DataFrame, group: str, score: str, positive: Column) -> DataFrame:
    """(group, n, auc): chance that a positive row scores above a negative one, ties half; null with one class only.

    Rows are first counted by distinct score, so a sort holds distinct values of a group only.
    """
    c = rows.groupBy(group, score).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy(group).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    g = c.withColumn("wins", F.col("pos") * (below + F.col("neg") / 2)).groupBy(group).agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"), F.sum("wins").alias("wins"))
    return g.select(group, (F.col("p") + F.col("q")).alias("n"), F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("wins") / (F.col("p") * F.col("q"))).alias("auc"))
