"""Emotion and valence/arousal/dominance lexicons as small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vectors import clamp, salience

EMOTIONS = ["anger", "fear", "joy", "sadness", "trust", "disgust", "surprise", "anticipation"]

# Seed terms with valence, arousal and dominance.
SEEDS = {
    "anger": [("outraged", -0.8, 0.7, 0.6), ("protest", -0.6, 0.6, 0.5), ("resentment", -0.7, 0.5, 0.5), ("condemn", -0.6, 0.4, 0.6)],
    "fear": [("alarm", -0.6, 0.7, 0.4), ("threat", -0.7, 0.8, 0.5), ("apprehension", -0.5, 0.5, 0.4)],
    "joy": [("welcome", 0.7, 0.4, 0.5), ("celebrate", 0.8, 0.5, 0.6), ("rejoice", 0.8, 0.6, 0.6), ("praise", 0.6, 0.3, 0.6)],
    "sadness": [("regret", -0.4, 0.3, 0.4), ("lament", -0.5, 0.4, 0.4), ("grieve", -0.6, 0.4, 0.3), ("mourn", -0.6, 0.4, 0.3)],
    "disgust": [("disgust", -0.7, 0.6, 0.4), ("revulsion", -0.7, 0.6, 0.3), ("nausea", -0.6, 0.5, 0.3)],
    "surprise": [("surprised", 0.1, 0.8, 0.4), ("astonished", 0.2, 0.7, 0.5), ("unexpected", 0.0, 0.6, 0.4)],
    "anticipation": [("anticipate", 0.4, 0.5, 0.6), ("expect", 0.3, 0.4, 0.6), ("hope", 0.6, 0.5, 0.6)],
    "trust": [("support", 0.5, 0.4, 0.6), ("solidarity", 0.5, 0.3, 0.6), ("cooperate", 0.6, 0.4, 0.6), ("partnership", 0.6, 0.3, 0.7)],
    "resentment": [("objection", -0.4, 0.3, 0.5), ("disapproval", -0.5, 0.3, 0.5), ("dissent", -0.5, 0.4, 0.5)],
}
# Prototypes of emotions without entries of their own.
DEFAULT_PROTOTYPES = {"anticipation": (0.35, 0.45, 0.55), "surprise": (0.05, 0.75, 0.45), "disgust": (-0.55, 0.45, 0.35), "positive": (0.55, 0.35, 0.6), "negative": (-0.55, 0.45, 0.35)}

STOP_RANKS, LAST_RANK = 30, 830


def seed_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(e, *row) for e, rows in SEEDS.items() for row in rows], "emotion string, term string, v double, a double, d double")


def token_table(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, term) of every word of every text."""
    return docs.select("doc_id", F.posexplode(tx.tokens(F.col("text"))).alias("pos", "term"))


def document_frequency(docs: DataFrame, least_length: int = 1) -> DataFrame:
    """(term, df): documents that hold a term.  Terms are made distinct within documents first, so nothing is counted twice."""
    terms = docs.select(F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("term"))
    return terms.where(F.length("term") >= least_length).groupBy("term").agg(F.count("*").alias("df"))


def ranked_vocabulary(docs: DataFrame, last: int = LAST_RANK) -> DataFrame:
    """(term, df, rank): the most frequent terms of two letters or more, ties by term; at most `last` rows are ever ranked."""
    top = document_frequency(docs, 2).orderBy(F.desc("df"), "term").limit(last)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("df"), "term")))


def demo_lexicon(docs: DataFrame) -> DataFrame:
    """A lexicon made of the corpus's own frequent terms by integer rules, so that any engine finds the same one.

    (term, rank, emotion 0 to 7, v, a, d, intensity, shared): ranks up to STOP_RANKS are stop words and have no entry; every fifth
    rank also belongs to a second emotion; shared is the number of emotions that a term belongs to.
    """
    r = F.col("rank")
    ranked = ranked_vocabulary(docs).where(r > STOP_RANKS)
    both = F.when(r % 5 == 0, F.array(r % 8, (r * 3 + 1) % 8)).otherwise(F.array(r % 8))
    axis = lambda k: ((r * k) % 201 - 100) / 100.0
    return ranked.select("term", "rank", F.explode(both).alias("emotion"), axis(37).alias("v"), axis(53).alias("a"), axis(71).alias("d"), ((r % 101) / 100.0).alias("intensity"), F.size(both).alias("shared"))


def stop_words(docs: DataFrame) -> DataFrame:
    return ranked_vocabulary(docs, STOP_RANKS).select("term", "rank")


def scale_of(values: DataFrame, columns: tuple[str, ...] = ("v", "a", "d")) -> DataFrame:
    """One row: least, most, mean, span, mode of the scale that all values seem to be on."""
    x = F.explode(F.array(*columns)).alias("x")
    s = values.select(x).agg(F.min("x").alias("least"), F.max("x").alias("most"), F.avg("x").alias("mean")).withColumn("span", F.col("most") - F.col("least"))
    tol = 1e-6
    unit = (F.col("least") >= -tol) & (F.col("most") <= 1 + tol)
    nine = (F.col("least") >= 1 - tol) & (F.col("most") <= 9 + tol)
    mode = F.when(unit, F.when((F.col("span") >= 0.5) & F.col("mean").between(0.25, 0.75), "zero_one").otherwise("signed"))
    mode = mode.when(nine, F.when((F.col("span") >= 4) & F.col("mean").between(3.5, 6.5), "one_nine").otherwise("signed")).otherwise("signed")
    return s.withColumn("mode", mode)


def prototypes(lexicon: DataFrame) -> DataFrame:
    """(emotion, n, v, a, d): mean of each emotion's entries."""
    return lexicon.groupBy("emotion").agg(F.count("*").alias("n"), F.avg("v").alias("v"), F.avg("a").alias("a"), F.avg("d").alias("d"))


def term_vad(lexicon: DataFrame, prototype: str = "is_prototype", imputed_weight: float = 0.5) -> DataFrame:
    """(term, v, a, d, conf): mean over emotions; confidence 1 if an entry has measured values, else imputed_weight."""
    return lexicon.groupBy("term").agg(F.avg("v").alias("v"), F.avg("a").alias("a"), F.avg("d").alias("d"), F.when(F.bool_or(~F.col(prototype)), 1.0).otherwise(imputed_weight).alias("conf"))


def merge_imputed(base: DataFrame, imputed: DataFrame) -> DataFrame:
    """Full outer merge by term; an imputed entry wins where its confidence is greater or there is no other."""
    b, i = base.alias("b"), imputed.alias("i")
    wins = F.col("i.term").isNotNull() & (F.col("b.term").isNull() | (F.col("i.conf") > F.col("b.conf")))
    return b.join(i, F.col("b.term") == F.col("i.term"), "full_outer").select(F.coalesce("b.term", "i.term").alias("term"), *[F.when(wins, F.col(f"i.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in ("v", "a", "d", "conf")], wins.alias("was_imputed"))


def filter_entries(lexicon: DataFrame, stops: DataFrame | None = None, least_intensity: float = 0.0, least_salience: float = 0.0, least_arousal: float | None = None, prototype: str | None = None) -> DataFrame:
    """Entries that pass the thresholds (a missing intensity counts as failing one); with a prototype flag, only measured ones."""
    kept = lexicon
    if stops is not None:
        kept = kept.join(stops.select("term"), "term", "left_anti")
    if least_intensity > 0:
        kept = kept.where(F.coalesce("intensity", F.lit(-1.0)) >= least_intensity)
    if least_salience > 0:
        kept = kept.where(salience(F.col("v"), F.col("a")) >= least_salience)
    if least_arousal is not None:
        kept = kept.where(F.col("a") >= least_arousal)
    return kept if prototype is None else kept.where(~F.col(prototype))


def emotional_terms(terms: DataFrame, threshold: float, least_arousal: float, in_lexicon: str = "in_lexicon") -> DataFrame:
    """Terms for a vocabulary: lexicon terms that are imputed or salient enough; others need valence and arousal."""
    a = clamp(F.col("a"), 0.0, 1.0)
    lex = (F.col("conf") < 1) | (F.greatest(F.abs("v"), a) >= threshold)
    other = (F.abs("v") >= threshold) & (a >= least_arousal)
    return terms.where(F.when(F.col(in_lexicon), lex).otherwise(other))


def concat_sources(sources: list[DataFrame], flag: str = "is_prototype") -> DataFrame:
    """(term, emotion, v, a, d, is_prototype) of lexicons put one after another: of entries of one term and emotion the last one that
    was measured wins, else the last.  Sources without the flag count as measured."""
    parts = [s.select(F.lower("term").alias("term"), "emotion", "v", "a", "d", (F.col(flag) if flag in s.columns else F.lit(False)).alias(flag), F.lit(i).alias("source")) for i, s in enumerate(sources)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    best = F.max_by(F.struct("v", "a", "d", flag), F.struct(~F.col(flag), F.col("source"), F.col("v"), F.col("a"), F.col("d")))
    return rows.groupBy("term", "emotion").agg(best.alias("x")).select("term", "emotion", "x.*")


def expand_with_neighbours(lexicon: DataFrame, neighbours: DataFrame) -> DataFrame:
    """lexicon(term, emotion, v, a, d) and, for each of its terms, the term's neighbours(term, neighbour) in the same emotion with the
    same values; a neighbour that the emotion has already stays as it is, one of several terms takes the first term's values."""
    more = lexicon.select("term", "emotion", "v", "a", "d").join(neighbours, "term").groupBy("emotion", F.col("neighbour")).agg(F.min_by(F.struct("v", "a", "d"), "term").alias("x"))
    more = more.select(F.col("neighbour").alias("term"), "emotion", "x.*").join(lexicon.select("term", "emotion"), ["term", "emotion"], "left_anti")
    return lexicon.select("term", "emotion", "v", "a", "d").unionByName(more)


def vocabulary_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: terms of either, of both, of the first only, of the second only, and whether the first is a subset of the second."""
    x, y = a.select("term").distinct().withColumn("x", F.lit(1)), b.select("term").distinct().withColumn("y", F.lit(1))
    both = x.join(y, "term", "full_outer")
    counts = both.agg(F.count("*").alias("either"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("both"), F.count_if(F.col("y").isNull()).alias("first_only"), F.count_if(F.col("x").isNull()).alias("second_only"))
    return counts.withColumn("subset", F.col("first_only") == 0)


def weight_multiplier(weight: Column, default: float = 1.0, least: float = 0.0, most: float = 1.0, power: float = 1.0, mix: float = 1.0) -> Column:
    """1 - mix + mix * w^power, w being the weight (default where there is none) within [least, most]."""
    mix = max(0.0, min(1.0, mix))
    w = F.greatest(F.lit(float(least)), F.least(F.lit(float(max(least, most))), F.coalesce(weight, F.lit(float(default)))))
    return F.lit(1.0 - mix) + F.lit(mix) * F.pow(w, F.lit(float(power)))


def term_weights(intensity: DataFrame, terms: DataFrame, w_intensity: float = 0.6, w_salience: float = 0.4, least: float = 0.05) -> DataFrame:
    """(term, weight): weighted mean of the greatest intensity and the salience of a term, a missing one 0, clamped to [least, 1]."""
    i = intensity.groupBy("term").agg(F.max("intensity").alias("i"))
    s = terms.groupBy("term").agg(F.max(salience(F.col("v"), F.col("a"))).alias("s"))
    mean = (w_intensity * F.coalesce("i", F.lit(0.0)) + w_salience * F.coalesce("s", F.lit(0.0))) / (w_intensity + w_salience)
    return i.join(s, "term", "full_outer").select("term", F.greatest(F.lit(least), F.least(F.lit(1.0), mean)).alias("weight"))
