"""The registered queries over the engine's own operators; each reads its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels as lb
from ..functions import text as tx
from ..functions import vectors as vx
from ..config import Config
from ..operators import adjudication, chunking, clouds, comparison, features, lexicon, measures, metrics, models, neighbours, rollups, sampling
from ..operators import transport as ot
from ..operators.lexicon import EMOTIONS
from ..storage import spread

STOP_PHRASES = ("all rights reserved", "of the", "in the")
FILE_NAMES = (
    "data/ICJ_001_CorfuChannel_GBR_ALB_1949-04-09_JUD_01_ME_04_EN_llm.txt",
    "ICJ_050_NorthSea_1969-02-20.txt",
    "x/crystal_ball_data/test_violations/Article3/case_7.txt",
    "x/crystal_ball_data/train/Article6/non-violation/case_8.txt",
    "plain/report.txt",
)
SOLVER = ot.Solver("unbalanced_divergence", 0.1, 30, 0.5)
COST = ot.uniform_cost(8)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _r(*names: str):
    return [F.round(F.col(n), 6).alias(n) for n in names]


def tok_word_counts(spark, sf):
    w = _docs(spark, sf).select("doc_id", tx.tokens(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


def tok_df_idf(spark, sf):
    docs = _docs(spark, sf)
    n = docs.count()
    return lexicon.document_frequency(docs).select("term", "df", F.round(F.ln((F.lit(1.0) + n) / (1 + F.col("df"))) + 1, 6).alias("idf"))


def tok_tfidf_topk(spark, sf):
    docs = _docs(spark, sf)
    return clouds.weighted_terms(docs, docs.count(), 5).select("doc_id", "term", "tf", *_r("w"), F.col("rank").cast("long").alias("rank"))


def tok_drop_top_df(spark, sf):
    docs = _docs(spark, sf)
    common = clouds.frequent_terms(lexicon.document_frequency(docs, 2), 100)
    words = docs.select("doc_id", F.explode(tx.tokens(F.col("text"))).alias("term")).where(F.length("term") >= 2)
    return words.join(F.broadcast(common), "term", "left_anti").groupBy("doc_id").agg(F.count("*").alias("n_kept"), F.countDistinct("term").alias("n_terms"))  # 100 terms at most


def _lexicon_terms(lex: DataFrame) -> DataFrame:
    return lex.groupBy("term").agg(F.first("v").alias("v"), F.first("a").alias("a"), F.first("d").alias("d"), F.first("rank").alias("rank"))


def _selected(spark, sf) -> DataFrame:
    """(doc_id, n_raw, n_selected, ratio) against the lexicon's terms."""
    docs = _docs(spark, sf)
    words = docs.select("doc_id", F.explode_outer(tx.tokens(F.col("text"))).alias("term"))
    terms = lexicon.demo_lexicon(docs).select("term").distinct().withColumn("hit", F.lit(1))
    s = words.join(F.broadcast(terms), "term", "left").groupBy("doc_id").agg(F.count("term").alias("n_raw"), F.count("hit").alias("n_selected"))
    return s.withColumn("ratio", F.col("n_selected") / F.greatest("n_raw", F.lit(1)))


def tok_coverage_stats(spark, sf):
    s = _selected(spark, sf).agg(F.count("*").alias("docs"), F.sum("n_raw").alias("n_raw"), F.sum("n_selected").alias("n_selected"), F.count_if(F.col("n_selected") == 0).alias("docs_with_zero"), rollups.upper_median("ratio").alias("ratio_median"))
    return s.select("docs", "n_raw", "n_selected", "docs_with_zero", *_r("ratio_median"), F.round(F.col("n_selected") / F.greatest("n_raw", F.lit(1)), 6).alias("coverage_total"))


def text_line_predicates(spark, sf):
    line = F.col("line")
    rows = _docs(spark, sf).select("doc_id", F.explode(tx.lines(F.col("text"))).alias("line"))
    flags = {"n_caps": tx.is_caps(line), "n_page_number": tx.is_page_number(line), "n_page_label": tx.is_page_label(line), "n_toc": tx.is_toc_like(F.trim(line))}
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), *[F.count_if(c).alias(n) for n, c in flags.items()])


def text_repeated_lines(spark, sf):
    rows = _docs(spark, sf).select("doc_id", F.explode(F.transform(tx.lines(F.col("text")), tx.collapse)).alias("norm")).where(F.length("norm") >= 6)
    return rows.groupBy("doc_id", "norm").agg(F.count("*").alias("n")).where("n >= 3")


def _windows(spark, sf) -> DataFrame:
    """(doc_id, w) of each document's windows; words are a column of their own first, as a lambda would find them anew each time."""
    words = _docs(spark, sf).select("doc_id", tx.tokens(F.col("text")).alias("words"))
    return words.select("doc_id", F.explode(tx.windows(F.col("words"), 64, 16)).alias("w"))


def text_token_windows(spark, sf):
    rows = _windows(spark, sf)
    words = F.col("w.words")
    return rows.select("doc_id", F.col("w.start").cast("long").alias("start"), F.size(words).cast("long").alias("n_tokens"), F.try_element_at(words, F.lit(1)).alias("first_term"), F.try_element_at(words, F.lit(-1)).alias("last_term"))


def text_stopphrase_strip(spark, sf):
    stripped, hits = tx.strip_phrases(F.coalesce(F.col("text"), F.lit("")), list(STOP_PHRASES))
    return _docs(spark, sf).select("doc_id", hits.cast("long").alias("hits"), F.length(stripped).cast("long").alias("n_left"))


def text_context_snippet(spark, sf):
    docs = _docs(spark, sf)
    terms = lexicon.demo_lexicon(docs).select("term").distinct()
    tokens = lexicon.token_table(docs).join(F.broadcast(terms), "term", "left_semi")
    first = tokens.groupBy("doc_id").agg(F.min(F.struct("pos", "term")).alias("f"))
    return docs.join(first, "doc_id").select("doc_id", F.col("f.term").alias("term"), F.col("f.pos").cast("long").alias("pos"), tx.snippet(tx.tokens(F.col("text")), F.col("f.pos"), 3).alias("snippet"))


def text_lemma_candidates(spark, sf):
    vocab = lexicon.document_frequency(_docs(spark, sf)).select("term")
    each = vocab.select("term", F.posexplode(tx.lemma_candidates(F.col("term"))).alias("place", "lemma"))
    known = each.join(vocab.withColumnRenamed("term", "lemma"), "lemma", "left_semi")
    return known.groupBy("term").agg(F.min_by("lemma", "place").alias("lemma"), F.min("place").cast("long").alias("place"))


def range_merge_islands(spark, sf):
    e = _t(spark, sf, "events")
    start = F.floor(F.unix_timestamp("ts") / 3600).cast("long")
    ranges = e.select("user_id", start.alias("start"), (start + F.col("event_id") % 30).alias("end"))
    return adjudication.merge_ranges(ranges, "user_id").select("user_id", "start", "end", "n")


def _counts(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = _docs(spark, sf)
    lex = lexicon.demo_lexicon(docs)
    words = docs.select("doc_id", F.explode(tx.tokens(F.col("text"))).alias("term"))
    return docs, lex, features.emotion_counts(words, lex)


def lex_counts_prior(spark, sf):
    _, _, c = _counts(spark, sf)
    total = F.sum("count").over(Window.partitionBy("doc_id"))
    return c.select("doc_id", F.col("emotion").cast("long").alias("emotion"), F.round("count", 6).alias("count"), "hits", F.round(F.col("count") / total, 6).alias("prior"))


def lex_negated_counts(spark, sf):
    docs = _docs(spark, sf)
    listed = {r["rank"]: r["term"] for r in lexicon.stop_words(docs).collect()}  # STOP_RANKS terms
    pick = lambda *ranks: [listed[r] for r in ranks if r in listed]
    words = docs.select("doc_id", tx.tokens(F.col("text")).alias("w"))
    words = words.withColumn("masked", features.negated_places(F.col("w"), pick(10, 20), pick(15, 25), 3))
    terms = lexicon.demo_lexicon(docs).select("term").distinct()
    each = words.select("doc_id", "masked", F.posexplode("w").alias("pos", "term"))
    hit = each.join(F.broadcast(terms), "term", "left_semi").select("doc_id", F.array_contains("masked", F.col("pos")).alias("negated"))
    return hit.groupBy("doc_id").agg(F.count("*").alias("hits"), F.count_if("negated").alias("negated_hits"))


def lex_vad_average(spark, sf):
    docs = _docs(spark, sf)
    terms = _lexicon_terms(lexicon.demo_lexicon(docs)).withColumns({c: F.round(F.col(c) * 100).cast("long") for c in "vad"})  # whole numbers add up exactly
    words = docs.select("doc_id", F.explode(tx.tokens(F.col("text"))).alias("term"))
    means = features.vad_means(words, terms)
    # Millionths by whole-number division, halves up, as engines round halves of doubles differently.
    exact = [F.expr(f"(((cast(round({c} * vad_hits) as long) + 100 * vad_hits) * 20000 + vad_hits) div (2 * vad_hits) - 1000000) / 1000000.0D").alias(c) for c in "vad"]
    return means.select("doc_id", *exact, "vad_hits")


def lex_prototypes(spark, sf):
    return lexicon.prototypes(lexicon.demo_lexicon(_docs(spark, sf))).select(F.col("emotion").cast("long").alias("emotion"), "n", *_r("v", "a", "d"))


def _base_vad(lex: DataFrame) -> DataFrame:
    return lexicon.term_vad(lex.withColumn("is_prototype", F.col("rank") % 3 != 0))


def lex_term_vad_conf(spark, sf):
    lex = lexicon.demo_lexicon(_docs(spark, sf))
    imputed = lex.where("rank % 7 = 0").groupBy("term").agg(*[(0 - F.first(c)).alias(c) for c in "vad"], (F.first("rank") % 10 / 10).alias("conf"))
    return lexicon.merge_imputed(_base_vad(lex), imputed).select("term", *_r("v", "a", "d", "conf"), F.col("was_imputed").cast("int").alias("was_imputed"))


def lex_filters(spark, sf):
    lex = lexicon.demo_lexicon(_docs(spark, sf)).withColumn("is_prototype", F.col("rank") % 3 != 0)
    kept = lexicon.filter_entries(lex, None, 0.2, 0.3, -0.5)
    vocab = lexicon.emotional_terms(_base_vad(lex).withColumn("in_lexicon", F.length("term") % 2 == 0), 0.45, 0.45).select("term", F.lit(1).alias("emotional"))
    return kept.join(vocab, "term", "left").select("term", F.col("emotion").cast("long").alias("emotion"), F.coalesce("emotional", F.lit(0)).alias("emotional"))


def lex_term_weights(spark, sf):
    lex = lexicon.demo_lexicon(_docs(spark, sf))
    return lexicon.term_weights(lex.where("rank % 2 = 0").select("term", "intensity"), lex.where("rank % 3 = 0")).select("term", *_r("weight"))


def vad_scale_detect(spark, sf):
    lex = _lexicon_terms(lexicon.demo_lexicon(_docs(spark, sf)))
    unit = lex.select(*[((F.col(c) + 1) / 2).alias(c) for c in "vad"])
    return lexicon.scale_of(unit).select(*_r("least", "most", "mean", "span"), "mode")


def _profiles(spark, sf) -> DataFrame:
    docs, _, c = _counts(spark, sf)
    sized = docs.select("doc_id", F.size(tx.tokens(F.col("text"))).alias("n_words"))
    rows = features.profiles(sized, c).withColumnRenamed("counts", "lex_counts")
    return measures.rates(rows.withColumn("pred_counts", F.transform("lex_counts", lambda v, i: v + (i + 1) / 8.0)))


def entry_profile(spark, sf):
    p = _profiles(spark, sf).withColumn("p", vx.normalise(F.col("lex_counts")))
    return p.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "lex_hits", *[F.round(F.col("p")[i], 6).alias(e) for i, e in enumerate(EMOTIONS)], F.round(vx.entropy(F.col("p")), 6).alias("entropy"))


def score_calibrated(spark, sf):
    return measures.calibrate(_profiles(spark, sf)).select("doc_id", *_r("lex_mass", "lex_per_1k_words", "lex_strength", "pred_entropy_calibrated", "pred_counts_calibrated_mass"))


def score_signal_gate(spark, sf):
    g = measures.gate(measures.calibrate(_profiles(spark, sf)), 0.15, 0.99, 40)
    out = measures.low_signal_reason(g, 20)
    return out.select("doc_id", F.col("strict_low_signal").cast("int").alias("strict_low"), F.col("low_emotion_signal").cast("int").alias("low"), F.coalesce("reason", F.lit("kept")).alias("reason"), F.round(measures.signal(g), 6).alias("signal"))


def score_chunk_to_doc(spark, sf):
    rows = _windows(spark, sf)
    body = F.size("w.words")
    new = F.when(F.col("w.start") == 0, body).otherwise(F.greatest(body - 16, F.lit(1)))
    letters = F.aggregate("w.words", F.lit(0), lambda s, t: s + F.length(t))
    c = rows.select("doc_id", body.alias("body_tokens"), new.alias("new_tokens"), (letters / F.greatest(body, F.lit(1))).alias("mean_length"), letters.cast("double").alias("letters")).where("body_tokens > 0")
    means, sums = measures.chunk_means(c, ["mean_length"]), measures.chunk_sums(c, ["letters"])
    return means.join(sums, "doc_id").select("doc_id", "n_chunks", "n_tokens", *_r("mean_length", "letters"))


def measure_per_1k(spark, sf):
    p = _profiles(spark, sf).select("doc_id", F.posexplode(measures.measure("lex_counts_per_1k_words")).alias("emotion", "rate"))
    return p.select("doc_id", F.col("emotion").cast("long").alias("emotion"), *_r("rate"))


def _measured(spark, sf) -> DataFrame:
    """Documents with some lexicon hit: x, the calibrated distribution times the rate per hundred words."""
    p = measures.calibrate(_profiles(spark, sf))
    return p.where("lex_hits > 0").select("doc_id", F.transform("pred_dist_calibrated", lambda v: v * F.col("lex_per_1k_words") / 100).alias("x"))


def ot_doc_neighbours(spark, sf):
    n = neighbours.transport_neighbours(_measured(spark, sf), F.col("id") % 50 == 0, COST, SOLVER, 5)
    return n.select(F.col("query").alias("i"), F.col("id").alias("j"), F.col("rank").cast("long").alias("rank"), *_r("distance"))


def ot_doc_unbalanced_parts(spark, sf):
    return neighbours.against_mean(_measured(spark, sf), COST, SOLVER).select(F.col("id").alias("doc_id"), *_r("transport", "kl_a", "kl_b", "mass_a", "mass_b", "mass_plan", "distance"))


def ot_top_flows(spark, sf):
    f = neighbours.against_mean(_measured(spark, sf), COST, SOLVER, 3).select("id", F.posexplode("flows").alias("place", "f"))
    return f.select(F.col("id").alias("doc_id"), (F.col("place") + 1).cast("long").alias("rank"), F.round("f.mass", 6).alias("mass"), F.round("f.contribution", 6).alias("contribution"))


def ot_style_deltas(spark, sf):
    p = _profiles(spark, sf).select("doc_id", measures.measure("lex_counts_per_1k_words").alias("x"))
    mean = p.agg(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(8)])
    e = p.crossJoin(F.broadcast(mean)).select("doc_id", F.posexplode(F.zip_with("x", F.array(*[f"m{i}" for i in range(8)]), lambda x, m: F.round(x - m, 6))).alias("emotion", "delta"))  # one row
    return rollups.top_per_group(e, "doc_id", 3, F.abs("delta").desc(), F.col("emotion")).select("doc_id", F.col("rank").cast("long").alias("rank"), F.col("emotion").cast("long").alias("emotion"), "delta")


def ot_group_shift_terms(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id", F.coalesce("lang", F.lit("unknown")).alias("lang"), "text")
    words = docs.select("doc_id", "lang", F.explode(tx.tokens(F.col("text"))).alias("term"))
    s = clouds.group_shift(words, "lang")
    return rollups.top_per_group(s, "lang", 20, F.desc("n"), F.col("term")).select("lang", "term", "n", *_r("share"), F.col("rank").cast("long").alias("rank"))


def ot_token_vad_cost(spark, sf):
    t = _base_vad(lexicon.demo_lexicon(_docs(spark, sf)))  # at most 800 terms
    a, b = t.select(*[F.col(c).alias(f"a_{c}") for c in t.columns]), t.select(*[F.col(c).alias(f"b_{c}") for c in t.columns])
    d = F.sqrt(sum((F.col(f"a_{c}") - F.col(f"b_{c}")) * (F.col(f"a_{c}") - F.col(f"b_{c}")) for c in "vad")) / (2 * 3**0.5)
    both = F.col("a_conf") * F.col("b_conf")
    pairs = a.join(F.broadcast(b), F.col("a_term") < F.col("b_term")).withColumn("cost", F.round(F.least(d, F.lit(1.0)) * both + 1 - both, 6))
    return pairs.groupBy(F.col("a_term").alias("term")).agg(F.count("*").alias("n"), F.min("cost").alias("least"), F.sum(F.round(F.col("cost") * 1000000).cast("long")).alias("millionths"))


def emb_cosine_knn(spark, sf):
    n = neighbours.cosine_neighbours(_t(spark, sf, "embeddings"), F.col("id") % 50 == 0, 5)
    return n.select(F.col("query").alias("i"), F.col("id").alias("j"), F.col("rank").cast("long").alias("rank"), *_r("distance"))


def _centroids(e: DataFrame) -> DataFrame:
    m = e.select("label", F.posexplode("embedding").alias("dim", "value")).groupBy("label", "dim").agg(F.avg(F.col("value").cast("double")).alias("m"))
    return m.withColumn("value", F.col("m") / F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy("label"))))


def emb_centroids(spark, sf):
    return _centroids(_t(spark, sf, "embeddings")).select("label", F.col("dim").cast("long").alias("dim"), *_r("value"))


def emb_max_cosine_conf(spark, sf):
    e = _t(spark, sf, "embeddings").where("embedding is not null")
    packed = _centroids(e).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"]).alias("c"))
    refs = packed.agg(F.collect_list("c").alias("refs"))  # a vector a label
    x = F.transform("embedding", lambda v: v.cast("double"))
    best = F.array_max(F.transform("refs", lambda c: vx.dot(F.col("x"), c) / F.sqrt(vx.dot(F.col("x"), F.col("x")))))
    return e.select("vec_id", x.alias("x")).crossJoin(F.broadcast(refs)).select("vec_id", F.round(vx.clamp((best + 1) / 2, 0.0, 1.0), 6).alias("conf"))


def emb_top1_label_coherence(spark, sf):
    e = _t(spark, sf, "embeddings")
    n = neighbours.cosine_neighbours(e, F.col("id") % 50 == 0, 1)
    q, j = e.select(F.col("vec_id").alias("query"), F.col("label").alias("ql")), e.select(F.col("vec_id").alias("id"), F.col("label").alias("jl"))
    return n.join(q, "query").join(j, "id").groupBy(F.col("ql").alias("label")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("ql") == F.col("jl")).cast("double")), 6).alias("same_rate"))


def emb_intra_inter_separation(spark, sf):
    e = _t(spark, sf, "embeddings").where("embedding is not null")
    refs = _centroids(e).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"]).alias("c")).withColumnRenamed("label", "ref")
    d = e.crossJoin(F.broadcast(refs)).select("label", "ref", ((1 - vx.cosine(F.col("embedding"), F.col("c"))) / 2).alias("distance"))  # a vector a label
    same = F.col("label") == F.col("ref")
    return d.agg(F.count_if(same).alias("within"), F.count_if(~same).alias("between"), F.round(rollups.separation("distance", same), 6).alias("effect"))


def rollup_year_type(spark, sf):
    e = _t(spark, sf, "events").select(F.date_format("ts", "yyyy-MM").alias("month"), F.col("event_type").alias("kind"), "value")
    return rollups.by_period_and_type(e, "month", "kind", "value").select("month", "kind", "n", *_r("mean", "median"))


def rollup_topn_per_emotion(spark, sf):
    p = _profiles(spark, sf).select("doc_id", F.posexplode(measures.measure("lex_counts_per_1k_words")).alias("emotion", "rate")).withColumn("rate", F.round("rate", 6))
    return rollups.top_per_group(p, "emotion", 5, F.desc("rate"), F.col("doc_id")).select(F.col("emotion").cast("long").alias("emotion"), F.col("rank").cast("long").alias("rank"), "doc_id", "rate")


def rollup_tertiles(spark, sf):
    d = _docs(spark, sf).select("doc_id", F.size(tx.tokens(F.col("text"))).alias("n"))
    return rollups.tertiles(d, F.col("n"), F.col("doc_id")).select("doc_id", "tertile")


def rollup_scorecard(spark, sf):
    share = F.sum("n_selected") / F.sum("n_raw")
    s = _selected(spark, sf).agg(share.alias("coverage"), F.avg((F.col("n_selected") == 0).cast("double")).alias("zero_share"), F.avg((F.col("n_selected") >= 3).cast("double")).alias("explained"))
    top1 = emb_top1_label_coherence(spark, sf).agg((F.sum(F.round(F.col("same_rate") * F.col("n"))) / F.sum("n")).alias("top1"))
    s = s.join(F.broadcast(top1)).join(F.broadcast(emb_intra_inter_separation(spark, sf).select("effect")))  # one row each
    score, verdict = rollups.scorecard(F.col("coverage"), F.col("top1"), F.col("effect"), F.col("explained"), F.col("zero_share"))
    reasons = rollups.guard_reasons({"coverage": ("least", 0.9), "zero_share": ("most", 0.02)})
    return s.select(*_r("coverage", "zero_share", "top1", "effect", "explained"), F.round(score, 6).alias("score"), verdict.alias("verdict"), F.array_join(reasons, "; ").alias("reasons"))


def _labelled(spark, sf) -> DataFrame:
    d = _t(spark, sf, "documents").select("doc_id", "n_chars", "text")
    return _t(spark, sf, "labels").join(d, "doc_id")


def eval_confusion_f1(spark, sf):
    rows = _labelled(spark, sf)
    per = metrics.per_class(rows, F.col("quality"), (F.col("n_chars") > 1000).cast("int"))
    return per.select(F.col("class").cast("long").alias("label"), "support", *_r("precision", "recall", "f1"))


def eval_multilabel_f1(spark, sf):
    rows = _labelled(spark, sf)
    labels = {"quality": (F.col("quality") == 1, F.col("n_chars") > 1000, F.lit(True)), "toxic": (F.col("toxic") == 1, F.col("text").contains("idiot"), F.col("n_chars") > 500)}
    return metrics.multilabel_f1(rows, labels).select("label", "tp", "fp", "fn", *_r("f1"))


def eval_auc_by_emotion(spark, sf):
    p = _profiles(spark, sf).select("doc_id", F.posexplode(measures.measure("lex_counts_per_1k_words")).alias("emotion", "rate")).withColumn("rate", F.round("rate", 6))
    rows = p.join(_t(spark, sf, "labels").select("doc_id", "toxic"), "doc_id")
    return metrics.auc(rows, "emotion", "rate", F.col("toxic") == 1).select(F.col("emotion").cast("long").alias("emotion"), "n", *_r("auc"))


def adj_latest_upsert(spark, sf):
    e = _t(spark, sf, "events")
    log = e.where("event_id % 3 = 0").select("user_id", "ts", "event_id", F.round("value", 6).alias("judged"), F.when(F.col("event_id") % 2 == 0, "AGREE").otherwise("DISAGREE").alias("decision"))
    verdicts = adjudication.latest(log, "user_id", F.col("ts"), F.col("event_id"))
    rows = e.groupBy("user_id").agg(F.round(F.max("value"), 6).alias("automatic"))
    out = adjudication.apply_latest(rows, verdicts.drop("ts", "event_id"), "user_id", "automatic", "judged")
    return out.select("user_id", "automatic", "status", "final")


def split_by_group_hash(spark, sf):
    return sampling.split_groups(_t(spark, sf, "conversations"), "conv_id", 0.2, "13").select("conv_id", "split")


def sample_stratified_hash(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id", F.coalesce("source", F.lit("unknown")).alias("source"))
    return sampling.stratified(docs, "doc_id", "source", 3, 5, "13")


def contain_exact_ordered(spark, sf):
    return chunking.contained(_t(spark, sf, "benchmark"), _docs(spark, sf)).select("item", "doc")


def teacher_noisy_or(spark, sf):
    """Of each document's distribution over the first four emotions."""
    p = _profiles(spark, sf).select("doc_id", F.slice(vx.normalise(F.col("lex_counts")), 1, 4).alias("p"))
    return p.select("doc_id", F.round(vx.noisy_or(F.col("p")), 6).alias("p"))


def meta_parse(spark, sf):
    """Names of every kind, and one of a court for each document."""
    n = F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0")
    own = F.concat(F.lit("texts/ICJ_"), n, F.lit("_Case"), F.col("doc_id").cast("string"), F.lit("_19"), F.lpad((F.col("doc_id") % 100).cast("string"), 2, "0"), F.lit("-04-09_"), F.when(F.col("doc_id") % 2 == 0, "JUD").otherwise("ORD"), F.lit("_01.txt"))
    rows = spark.createDataFrame([(p,) for p in FILE_NAMES], "path string").unionByName(_t(spark, sf, "documents").select(own.alias("path")))
    return rows.select("path", tx.parse_file_name(F.col("path")).alias("m")).select("path", "m.*")


def text_boilerplate_strip(spark, sf):
    out = chunking.strip_boilerplate(_docs(spark, sf))
    return out.select("doc_id", F.length("text").cast("long").alias("n_left"))


def text_paragraph_chunks(spark, sf):
    return chunking.pack_paragraphs(_docs(spark, sf), 128, 32).select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.col("body_tokens").cast("long").alias("body_tokens"), F.col("new_body_tokens").cast("long").alias("new_body_tokens"))


def lex_phrase_matches(spark, sf):
    docs = _docs(spark, sf)
    top = [r["term"] for r in lexicon.ranked_vocabulary(docs, 40).orderBy("rank").collect()]  # forty terms
    phrases = {f"{top[i]} {top[i + 1]}": EMOTIONS[i % 8] for i in range(0, min(38, len(top) - 1))} | {t: EMOTIONS[i % 8] for i, t in enumerate(top[20:])}
    matched = features.longest_matches(docs.select("doc_id", tx.tokens(F.col("text")).alias("tokens")), phrases, tuple(top[10:11]), 3)
    return matched.groupBy("doc_id", "emotion").agg(F.count("*").alias("n"), F.count_if("negated").alias("negated"))


def ot_token_clouds(spark, sf):
    docs = _docs(spark, sf)
    out = comparison.compare_clouds(docs, _base_vad(lexicon.demo_lexicon(docs)), F.col("id") % 50 == 0, Config(top_flows=3))
    return out.select(F.col("query").alias("i"), F.col("id").alias("j"), F.col("rank").cast("long").alias("rank"), *_r("distance"), F.coalesce(F.size("flows"), F.lit(0)).cast("long").alias("n_flows"))


def text_excerpts(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id", tx.excerpt(F.col("text"), 60, r"\bthe\b").alias("around"), tx.excerpt(F.col("text"), 40).alias("head"), F.length(tx.normalise_space(F.coalesce("text", F.lit("")))).cast("long").alias("n_plain"))


def text_line_chunks(spark, sf):
    d = _docs(spark, sf).select("doc_id", tx.line_chunks(F.col("text"), 400).alias("c"))
    return d.select("doc_id", F.size("c").cast("long").alias("chunks"), F.array_max(F.transform("c", F.length)).cast("long").alias("longest"))


def text_truncated(spark, sf):
    d = _docs(spark, sf).select("doc_id", tx.truncate(F.coalesce("text", F.lit("")), 1000, 300, 300, (r"\bidiot\b",), 40).alias("t"))
    return d.select("doc_id", F.length("t").cast("long").alias("n_left"))


def label_keys(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", "source", "lang")
    mixed = F.concat(F.lit(" "), F.upper("lang"), F.lit("-"), F.col("source"), F.lit(" "))
    return d.select("doc_id", lb.normalise_label(mixed).alias("label"), lb.is_unlabelled(F.when(F.col("doc_id") % 7 == 0, "N/A").otherwise(F.col("lang"))).cast("int").alias("unlabelled"), lb.matches_any(F.col("source"), ["rc1", "7"]).cast("int").alias("hit"), lb.group_key(F.when(F.col("doc_id") % 5 > 0, F.col("lang"))).alias("key"))


def teacher_classes(spark, sf):
    """Of each document's distribution over the first three emotions."""
    p = _profiles(spark, sf).select("doc_id", vx.normalise(F.slice("lex_counts", 1, 3)).alias("p"))
    label, sentiment, score = models.class_from_probabilities(F.col("p"))
    return p.select("doc_id", label.cast("long").alias("label"), sentiment.cast("long").alias("sentiment"), F.round(score, 6).alias("score"))


def imputed_by_ridge(spark, sf):
    e = _t(spark, sf, "embeddings").where("embedding is not null").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"), (F.col("label") / 10.0).alias("v"))
    return models.impute(e, "x", models.ridge(e, "x", ["v"], 1.0)).select("vec_id", *_r("v"))


def outcome_regression(spark, sf):
    p = _profiles(spark, sf).join(_t(spark, sf, "labels").select("doc_id", F.col("toxic").cast("double").alias("outcome")), "doc_id")
    rows = p.select("doc_id", "outcome", *[F.col("lex_counts")[i].alias(e) for i, e in enumerate(EMOTIONS)], "n_words")
    fitted = models.logistic(rows, [*EMOTIONS, "n_words"], "outcome")
    return spark.createDataFrame([(n, round(float(c), 6)) for n, c in zip([*EMOTIONS, "n_words"], fitted.coefficients, strict=True)], "feature string, coefficient double")


def sample_balanced_by_class(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", F.coalesce("lang", F.lit("unknown")).alias("lang"))
    return sampling.balanced(d, "doc_id", "lang", 50, "13")


def ot_compare_rows(spark, sf):
    rows = _profiles(spark, sf).where("lex_hits > 0")
    out = comparison.compare_scores(rows, F.col("id") % 50 == 0, COST, Config(top_k=3, reg_m=0.5), "lex_counts_per_1k_words")
    return out.select(F.col("query").alias("i"), F.col("id").alias("j"), F.col("rank").cast("long").alias("rank"), *_r("distance", "mass_diff"), F.col("deltas")[0]["emotion"].cast("long").alias("top_emotion"))


def ot_group_distance(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id", F.coalesce("lang", F.lit("unknown")).alias("lang"), "text")
    words = docs.select("doc_id", "lang", F.explode(tx.tokens(F.col("text"))).alias("term"))
    out = comparison.group_shift(words, "lang", _base_vad(lexicon.demo_lexicon(docs)), Config())
    rows = [(*out["groups"], round(out["distance"], 6), f["from"], f["to"], round(f["contribution"], 6)) for f in out.get("flows", [])]
    return spark.createDataFrame(rows, "a string, b string, distance double, from_term string, to_term string, contribution double")


def stream_windowed_signal(spark, sf):
    """The batch form of the streaming roll-up."""
    from ..streaming.live import windowed_signal

    return windowed_signal(_t(spark, sf, "events")).select("start", "event_type", "n", *_r("mean"))


QUERIES = {
    f.__name__: f
    for f in (
        entry_profile, tok_word_counts, tok_df_idf, tok_tfidf_topk, tok_drop_top_df, tok_coverage_stats, text_line_predicates, text_repeated_lines, text_token_windows, text_stopphrase_strip,
        text_context_snippet, text_lemma_candidates, range_merge_islands, lex_counts_prior, lex_negated_counts, lex_vad_average, lex_prototypes, lex_term_vad_conf, lex_filters, lex_term_weights,
        vad_scale_detect, score_calibrated, score_signal_gate, score_chunk_to_doc, measure_per_1k, ot_doc_neighbours, ot_doc_unbalanced_parts, ot_top_flows, ot_style_deltas, ot_group_shift_terms,
        ot_token_vad_cost, emb_cosine_knn, emb_centroids, emb_max_cosine_conf, emb_top1_label_coherence, emb_intra_inter_separation, rollup_year_type, rollup_topn_per_emotion, rollup_tertiles,
        rollup_scorecard, eval_confusion_f1, eval_multilabel_f1, eval_auc_by_emotion, adj_latest_upsert, split_by_group_hash, sample_stratified_hash, contain_exact_ordered, teacher_noisy_or, meta_parse,
        text_excerpts, text_line_chunks, text_truncated, label_keys, teacher_classes, imputed_by_ridge, outcome_regression, sample_balanced_by_class, ot_compare_rows, ot_group_distance,
        text_boilerplate_strip, text_paragraph_chunks, lex_phrase_matches, ot_token_clouds, stream_windowed_signal,
    )
}
