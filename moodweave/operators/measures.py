"""Score rows: measures, signal, filters, calibration and the low-signal gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import blend, entropy, normalise, per_thousand, total

STORED = ("pred_softmax", "pred_sigmoid", "pred_dist", "pred_counts", "pred_dist_calibrated", "pred_counts_calibrated", "lex_counts", "lex_prior", "pred_mixscaled_per_1k_words", "pred_mixscaled_per_1k_tokens")
DERIVED = {f"{counts}_per_1k_{unit}": (counts, f"n_{unit}") for counts in ("pred_counts", "pred_counts_calibrated", "lex_counts") for unit in ("words", "tokens")}
SIMPLEX = {"pred_softmax", "pred_dist", "pred_dist_calibrated", "lex_prior"}


def measure(name: str) -> Column:
    """A stored vector, or a vector of counts per thousand words or tokens."""
    if name in DERIVED:
        counts, n = DERIVED[name]
        return per_thousand(F.col(counts), F.col(n))
    if name not in STORED:
        raise ValueError(f"no measure {name}")
    return F.col(name)


def choose_measure(rows: DataFrame, unbalanced: bool, unit: str = "words") -> str:
    """The measure that a comparison takes by default: masses for unbalanced transport, else distributions, by what columns there are."""
    columns = set(rows.columns)
    wanted = [f"pred_counts_calibrated_per_1k_{unit}", f"pred_mixscaled_per_1k_{unit}", f"pred_counts_per_1k_{unit}", f"lex_counts_per_1k_{unit}"] if unbalanced else ["pred_dist_calibrated", "pred_dist", "pred_softmax", "lex_prior"]
    for name in wanted:
        if name in columns or (name in DERIVED and set(DERIVED[name]) <= columns):
            return name
    raise ValueError("no column to compare by")


def mass_of(rows: DataFrame, name: str, unit: str = "words") -> str | None:
    """The measure whose sum scales a distribution where mass need not balance: the first that the columns allow."""
    if name == "lex_prior":
        wanted = [f"lex_counts_per_1k_{unit}", "lex_counts"]
    else:
        wanted = [f"pred_counts_calibrated_per_1k_{unit}", f"pred_counts_per_1k_{unit}", f"pred_mixscaled_per_1k_{unit}", "pred_counts_calibrated", "pred_counts", "lex_counts"]
    columns = set(rows.columns)
    return next((m for m in wanted if m in columns or (m in DERIVED and set(DERIVED[m]) <= columns)), None)


def emotion_axis(rows: DataFrame, key: str = "doc_id", names: str = "emotions") -> list[str]:
    """The emotions of the first row by key, which name the axis of all vectors."""
    return list(rows.where(F.col(names).isNotNull()).agg(F.min_by(names, key).alias("e")).first()["e"] or [])


def mass_scaled(rows: DataFrame, vector: str, mass: str | None) -> DataFrame:
    """The vector made a distribution and, if there is a mass measure, multiplied by that measure's sum."""
    scaled = normalise(F.col(vector))
    if mass is not None:
        m = total(measure(mass))
        scaled = F.transform(scaled, lambda v: v * m)
    return rows.withColumn(vector, scaled)


def signal(rows: DataFrame) -> Column:
    """Emotion signal per thousand words: the stored one, else the greater of the predicted and the lexicon rate."""
    have = [F.col(c) for c in ("pred_per_1k_words", "lex_per_1k_words") if c in rows.columns]
    best = F.greatest(*have) if len(have) == 2 else have[0] if have else F.lit(None).cast("double")
    return F.coalesce(F.col("emotion_signal_per_1k_words"), best) if "emotion_signal_per_1k_words" in rows.columns else best


def low_signal_reason(rows: DataFrame, least_words: int = 0, least_signal: float | None = None) -> DataFrame:
    """rows with `reason`: few_words, flagged or low_signal for those to drop (in that order), null for those to keep."""
    flag = F.col("low_emotion_signal") if "low_emotion_signal" in rows.columns else F.lit(None).cast("boolean")
    reason = F.when(F.col("n_words") < least_words, "few_words").when(flag, "flagged")
    if least_signal is not None:
        reason = reason.when(flag.isNull() & (signal(rows) < least_signal), "low_signal")
    return rows.withColumn("reason", reason)


def has_mass(rows: DataFrame, vector: str) -> DataFrame:
    """Without rows whose distribution is empty or marked invalid."""
    kept = rows.where(total(F.col(vector)) > 1e-8)
    return kept.where(F.coalesce("pred_dist_calibrated_valid", F.lit(True))) if "pred_dist_calibrated_valid" in rows.columns else kept


def rates(rows: DataFrame, counts: str = "lex_counts") -> DataFrame:
    mass = total(F.col(counts))
    return rows.withColumns({"lex_mass": mass, "lex_density_words": mass / F.greatest("n_words", F.lit(1)), "lex_per_1k_words": mass / F.greatest("n_words", F.lit(1)) * 1000})


def calibrate(rows: DataFrame, predicted: str = "pred_counts", lexicon: str = "lex_counts", half_at: float = 20.0) -> DataFrame:
    """pred_counts_calibrated, lex_strength, pred_dist_calibrated, pred_entropy_calibrated and their mass."""
    b = blend(F.col(predicted), F.col(lexicon), normalise(F.col(lexicon)), F.col("n_words"), half_at)
    out = rows.withColumn("__b", b).withColumns({"pred_counts_calibrated": F.col("__b.counts"), "lex_strength": F.col("__b.strength")}).drop("__b")
    out = out.withColumn("pred_dist_calibrated", normalise(F.col("pred_counts_calibrated")))
    return out.withColumns({"pred_entropy_calibrated": entropy(F.col("pred_dist_calibrated")), "pred_counts_calibrated_mass": total(F.col("pred_counts_calibrated"))})


def gate(rows: DataFrame, least_density: float = 0.002, high_entropy: float = 0.95, least_hits: int = 3, strict: bool = True) -> DataFrame:
    """low_emotion_signal: few hits and a low density (the strict gate), or a low density and an undecided distribution."""
    density = F.col("lex_density_words") < least_density
    strictly = (F.col("lex_hits") < least_hits) & density if strict else F.lit(False)
    return rows.withColumns({"strict_low_signal": strictly, "low_emotion_signal": strictly | (density & (F.col("pred_entropy_calibrated") >= high_entropy))})


def chunk_means(chunks: DataFrame, vectors: list[str], key: str = "doc_id", weight: str = "new_tokens") -> DataFrame:
    """Token-weighted means of chunk columns for each document."""
    return chunks.groupBy(key).agg(F.count("*").alias("n_chunks"), F.sum(weight).alias("n_tokens"), *[(F.sum(F.col(c) * F.col(weight)) / F.sum(weight)).alias(c) for c in vectors])


def chunk_sums(chunks: DataFrame, counts: list[str], key: str = "doc_id") -> DataFrame:
    """Sums of chunk counts, each scaled by the share of the chunk that no chunk before it had."""
    return chunks.groupBy(key).agg(*[F.sum(F.col(c) * F.col("new_tokens") / F.col("body_tokens")).alias(c) for c in counts])


def label_mask(names: list[str], labels: Column, negative: Column, exhaustive: Column) -> Column:
    """1 for the labels that a row says something about."""
    all_names = F.array(*map(F.lit, names))
    known = F.transform(all_names, lambda n: (F.array_contains(labels, n) | F.array_contains(negative, n)).cast("int"))
    return F.when(F.coalesce(exhaustive, F.lit(False)), F.transform(all_names, lambda _: F.lit(1))).otherwise(known)
