"""An extension: scoring a stream of texts, and rolling signals up by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def score_stream(texts: DataFrame, lexicon: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """texts with n_words and lex_hits added, statelessly: the lexicon, a bounded table, becomes a literal set."""
    terms = [r["term"] for r in lexicon.select("term").distinct().limit(5000).collect()]
    words = tx.tokens(F.col(text))
    return texts.select("*", F.size(words).alias("n_words"), F.size(F.filter(words, lambda w: w.isin(terms) if terms else F.lit(False))).alias("lex_hits"))


def windowed_signal(events: DataFrame, every: str = "1 day", late: str = "2 days", key: str = "event_id", time: str = "ts", value: str = "value", kind: str = "event_type") -> DataFrame:
    """n and mean value by time window and kind; repeated keys within the watermark count once, later rows than it are dropped."""
    once = events.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])
    return once.groupBy(F.window(time, every).alias("w"), kind).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), kind, "n", "mean")
