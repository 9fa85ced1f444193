"""Commands over folders of text and tables: python -m moodweave.cli VERB ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import config
from .functions import text as tx
from .operators import chunking, comparison, features, lexicon, measures, metrics, sampling
from .operators import transport as ot
from .sources import readers, sinks


def _texts(spark, path):
    """Texts in the normal form that words are found in."""
    return readers.text_folder(spark, path).withColumn("text", tx.nfkc(F.col("text")))


def _score(spark, a, cfg):
    docs = _texts(spark, a.input).withColumn("doc_id", F.xxhash64("path")).withColumn("meta", tx.parse_file_name(F.col("path")))
    lex = readers.json_lexicon(spark, a.lexicon) if a.lexicon else lexicon.seed_table(spark)
    place = F.array_position(F.array(*map(F.lit, lexicon.EMOTIONS)), F.col("emotion")).cast("int") - 1
    lex = lex.withColumn("emotion", place).where("emotion >= 0")
    shared = lex.groupBy("term").agg(F.countDistinct("emotion").alias("shared"))
    counts = features.emotion_counts(lexicon.token_table(docs), lex.join(shared, "term"))
    rows = features.profiles(docs.withColumn("n_words", F.size(tx.tokens(F.col("text")))), counts).withColumnRenamed("counts", "lex_counts")
    rows = measures.gate(measures.calibrate(measures.rates(rows.withColumn("pred_counts", F.transform("lex_counts", lambda c: c + 0.125)))))
    sinks.json_lines(rows.drop("text").withColumn("emotions", F.array(*map(F.lit, lexicon.EMOTIONS))), a.output, "overwrite")


def _scores(spark, path):
    return spark.read.json(path)


def _compare(spark, a, cfg):
    sinks.json_lines(comparison.compare_scores(_scores(spark, a.input), F.expr(a.queries), ot.uniform_cost(len(lexicon.EMOTIONS)), cfg, a.measure), a.output, "overwrite")


def _explain(spark, a, cfg):
    print(json.dumps(comparison.explain_pair(_scores(spark, a.input), a.i, a.j, ot.uniform_cost(len(lexicon.EMOTIONS)), cfg, a.measure)))


def _compare_tokens(spark, a, cfg):
    docs = _texts(spark, a.input).select(F.xxhash64("path").alias("doc_id"), "text")
    vad = readers.word_vad(spark, a.vad).withColumn("conf", F.lit(1.0))
    sinks.json_lines(comparison.compare_clouds(docs, vad, F.expr(a.queries), cfg), a.output, "overwrite")


def _prepare(spark, a, cfg):
    docs = readers.text_folder(spark, a.input).withColumn("m", tx.parse_file_name(F.col("path"))).withColumn("group", F.coalesce("m.case_id", "m.stem"))
    split = sampling.split_groups(docs, "group", a.dev_ratio, a.seed)
    chunks = chunking.pack_paragraphs(docs, a.budget, a.stride, "path", "text")
    sinks.json_lines(chunks.join(docs.select("path", "group"), "path").join(split, "group"), a.output, "overwrite")


def _report(spark, a, cfg):
    rows = _scores(spark, a.input)
    metrics.per_class(rows, F.col(a.gold), F.col(a.predicted)).orderBy("class").show(truncate=False)


def _sentiment_prepare(spark, a, cfg):
    sinks.json_lines(readers.labelled_sentences(spark, a.input), a.output, "overwrite")


#: Verb: function, its arguments.
VERBS = {
    "score": (_score, {"--input": {}, "--output": {}, "--lexicon": {"default": None}}),
    "compare": (_compare, {"--input": {}, "--output": {}, "--queries": {"default": "id % 50 = 0"}, "--measure": {"default": None}}),
    "explain": (_explain, {"--input": {}, "--i": {"type": int}, "--j": {"type": int}, "--measure": {"default": None}}),
    "compare_tokens": (_compare_tokens, {"--input": {}, "--output": {}, "--vad": {}, "--queries": {"default": "true"}}),
    "prepare": (_prepare, {"--input": {}, "--output": {}, "--dev_ratio": {"type": float, "default": 0.2}, "--seed": {"default": "13"}, "--budget": {"type": int, "default": 254}, "--stride": {"type": int, "default": 0}}),
    "report": (_report, {"--input": {}, "--gold": {"default": "label"}, "--predicted": {"default": "pred_label"}}),
    "sentiment_prepare": (_sentiment_prepare, {"--input": {}, "--output": {}}),
}


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    sub = p.add_subparsers(dest="verb", required=True)
    for verb, (_, options) in VERBS.items():
        v = sub.add_parser(verb)
        v.add_argument("--config", default=None)
        for name, how in options.items():
            v.add_argument(name, required="default" not in how, **how)
    a = p.parse_args(args)
    VERBS[a.verb][0](SparkSession.builder.getOrCreate(), a, config.load(a.config))


if __name__ == "__main__":
    main()
