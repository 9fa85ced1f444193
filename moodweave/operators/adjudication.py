"""Logs of judgements: parse, last one wins, apply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("AGREE", "DISAGREE", "ERROR")


def parse_log(lines: DataFrame, line: str = "value", emotions: list[str] | None = None, root: str = "") -> DataFrame:
    """lines with decision, file, scores and `invalid`, why a line is not taken, if it isn't: a JSON object with exactly one of KINDS,
    holding a file and, but for ERROR, scores of all the emotions, which are clamped.  Blank lines are `blank`."""
    body = F.from_json(F.col(line), "map<string,struct<file:string,scores:map<string,double>>>")
    said = F.map_keys(body)[0]
    got = F.element_at(body, said)
    invalid = F.when(F.trim(line) == "", "blank").when(body.isNull() | (F.coalesce(F.size(body), F.lit(0)) == 0), "not_json")
    invalid = invalid.when((F.size(body) != 1) | ~said.isin(*KINDS), "no_decision").when(F.coalesce(F.trim(got["file"]), F.lit("")) == "", "no_file")
    scores = got["scores"]
    if emotions is not None:
        full, scores = valid_scores(scores, emotions)
        invalid = invalid.when((said != "ERROR") & ~F.coalesce(full, F.lit(False)), "no_scores")
        scores = F.when(said != "ERROR", scores)
    ok = invalid.isNull()
    return lines.withColumns({"invalid": invalid, "decision": F.when(ok, said), "file": F.when(ok, canonical_path(F.trim(got["file"]), root)), "scores": F.when(ok, scores)})


def log_counters(parsed: DataFrame) -> DataFrame:
    """One row: lines, parsed, agree, disagree, error and invalid of a parsed log; blank lines are neither parsed nor invalid."""
    kind = lambda k: F.count_if(F.col("decision") == k).alias(k.lower())
    return parsed.agg(F.count("*").alias("lines"), F.count_if(F.col("invalid").isNull()).alias("parsed"), *map(kind, KINDS), F.count_if(F.col("invalid") != "blank").alias("invalid"))


def canonical_path(path: Column, root: str = "") -> Column:
    """With forward slashes, without ./ and doubled slashes, and relative to the root folder where it lies in it."""
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"/(?:\./|/)+", "/"), r"^(\./)+", "")
    base = root.rstrip("/") + "/"
    return F.when(out.startswith(base), F.substring(out, F.lit(len(base) + 1), F.length(out))).otherwise(out) if root else out


def latest(log: DataFrame, key: str, *order: Column) -> DataFrame:
    """The last row of each key, by a maximum that is combined before the exchange rather than by a sort."""
    rest = F.struct(*[c for c in log.columns if c != key])
    return log.groupBy(key).agg(F.max_by(rest, F.struct(*order)).alias("__r")).select(key, "__r.*")


def valid_scores(scores: Column, emotions: list[str], most: float = 20.0) -> tuple[Column, Column]:
    """Whether all emotions are scored, and the scores clamped to [0, most]."""
    full = F.size(F.array_except(F.array(*map(F.lit, emotions)), F.map_keys(scores))) == 0
    kept = F.map_filter(scores, lambda k, _: k.isin(*emotions))
    return full, F.transform_values(kept, lambda _, v: F.greatest(F.lit(0.0), F.least(F.lit(most), F.coalesce(v, F.lit(0.0)))))


def apply_latest(rows: DataFrame, verdicts: DataFrame, key: str, automatic: str, judged: str, tolerance: float = 1e-3) -> DataFrame:
    """rows with `final` and `status`: missing, agree, mismatch (an agreement that differs) or disagree."""
    j = rows.join(verdicts, key, "left")
    close = F.abs(F.col(automatic) - F.col(judged)) <= tolerance
    status = F.when(F.col("decision").isNull(), "missing").when(F.col("decision") == "DISAGREE", "disagree").when(close, "agree").otherwise("mismatch")
    return j.withColumn("status", status).withColumn("final", F.when(F.col("status") == "disagree", F.col(judged)).otherwise(F.col(automatic)))


def merge_ranges(ranges: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """(key, start, end, n): ranges of a key that overlap or touch (start <= end before + 1), made one."""
    by = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col(start) <= reach + 1, 0).otherwise(1)
    islands = ranges.withColumn("__fresh", fresh).withColumn("__island", F.sum("__fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(key, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("__island")
