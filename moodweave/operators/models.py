"""Models that take their features from tables; encoders stay outside and enter as tables of predictions."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import clamp
from ..storage import settle


class ScoreProvider(Protocol):
    """Anything that gives chunk predictions: (doc_id, chunk, probs array<double>, vad array<double>, counts array<double>)."""

    def predict(self, chunks: DataFrame) -> DataFrame: ...


class StoredPredictions:
    """Predictions made elsewhere, joined by document and chunk."""

    def __init__(self, table: DataFrame):
        self.table = table

    def predict(self, chunks: DataFrame) -> DataFrame:
        return chunks.join(self.table, ["doc_id", "chunk"])


class LexiconPredictions:
    """A stand-in for an encoder: lexicon counts, smoothed by one hit shared among the emotions."""

    def predict(self, chunks: DataFrame) -> DataFrame:
        smooth = F.transform("counts", lambda c: c + 1.0 / F.size("counts"))
        total = F.aggregate(smooth, F.lit(0.0), lambda a, b: a + b)
        return chunks.withColumn("probs", F.transform(smooth, lambda c: c / total))


def predict_documents(chunks: DataFrame, provider: ScoreProvider, vectors: tuple[str, ...] = ("probs",), key: str = "doc_id", weight: str = "new_tokens") -> DataFrame:
    """Document predictions of any provider: its chunk vectors averaged by the tokens that each chunk adds, with n_chunks and n_tokens."""
    said = provider.predict(chunks)
    each = said.select(key, "chunk", weight, *vectors)
    out = each.groupBy(key).agg(F.count("*").alias("n_chunks"), F.sum(weight).alias("n_tokens"))
    for v in vectors:
        at = each.select(key, weight, F.posexplode(v).alias("i", "x")).groupBy(key, "i").agg((F.sum(F.col("x") * F.col(weight)) / F.sum(weight)).alias("x"))
        packed = at.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias(v))
        out = out.join(packed, key)
    return out


def class_from_probabilities(probs: Column, low: int = -1) -> tuple[Column, Column, Column]:
    """Predicted class (the first of the largest), its signed form, and the expected signed value."""
    best = F.array_position(probs, F.array_max(probs)) - 1
    expected = F.aggregate(F.transform(probs, lambda p, i: p * (i + low)), F.lit(0.0), lambda a, b: a + b)
    return best.cast("int"), (best + low).cast("int"), expected


def ridge(rows: DataFrame, x: str, y: list[str], alpha: float = 1.0, dims: int | None = None) -> dict[str, np.ndarray]:
    """Intercept and coefficients of each target by the normal equations: one pass adds up a (dims + 1)^2 matrix a partition."""
    import pandas as pd

    n = dims or len(rows.select(x).first()[0])

    def add(it):
        gram, right = np.zeros((n + 1, n + 1)), np.zeros((n + 1, len(y)))
        for pdf in it:
            if len(pdf):
                a = np.hstack([np.ones((len(pdf), 1)), np.stack(pdf[x]).astype(float)])
                gram += a.T @ a
                right += a.T @ pdf[y].to_numpy(float)
        yield pd.DataFrame({"i": np.arange((n + 1) * (n + 1 + len(y))), "v": np.concatenate([gram.ravel(), right.ravel()])})

    sums = rows.select(x, *y).dropna().mapInPandas(add, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas().sort_values("i")["v"].to_numpy()
    gram, right = sums[: (n + 1) ** 2].reshape(n + 1, n + 1), sums[(n + 1) ** 2 :].reshape(n + 1, len(y))
    penalty = alpha * np.eye(n + 1)
    penalty[0, 0] = 0  # the intercept is free
    w = np.linalg.solve(gram + penalty, right)
    return {name: w[:, k] for k, name in enumerate(y)}


def impute(rows: DataFrame, x: str, weights: dict[str, np.ndarray]) -> DataFrame:
    """rows with each target's prediction, clamped to [-1, 1]."""

    def apply(w: np.ndarray) -> Column:
        c = F.array(*[F.lit(float(v)) for v in w[1:]])
        return clamp(F.aggregate(F.zip_with(F.col(x), c, lambda a, b: a * b), F.lit(float(w[0])), lambda s, v: s + v))

    return rows.withColumns({name: apply(w) for name, w in weights.items()})


@dataclass
class Logistic:
    intercept: float
    coefficients: np.ndarray
    iterations: int


def logistic(rows: DataFrame, features: list[str], outcome: str, iterations: int = 200, penalty: float = 1.0) -> Logistic:
    """A logistic regression of the outcome (0 or 1) with the ridge penalty 1 / (2 penalty) on the summed loss, the intercept free, by
    Newton's method: an iteration is one pass that adds up a small matrix a task."""
    import pandas as pd

    data = settle(rows.dropna(subset=[*features, outcome]).select(*[F.col(c).cast("double").alias(c) for c in [*features, outcome]]), "logistic-rows")
    n = len(features) + 1
    w, ridge = np.zeros(n), np.diag([0.0] + [1.0 / penalty] * (n - 1))

    def add(w: np.ndarray):
        def run(it):
            hessian, right, loss = np.zeros((n, n)), np.zeros(n), 0.0
            for pdf in it:
                if len(pdf):
                    x, y = np.hstack([np.ones((len(pdf), 1)), pdf[features].to_numpy(float)]), pdf[outcome].to_numpy(float)
                    m = x @ w
                    p = 1 / (1 + np.exp(-np.clip(m, -500, 500)))
                    hessian += (x * (p * (1 - p))[:, None]).T @ x
                    right += x.T @ (y - p)
                    loss += float(np.logaddexp(0, -m * (2 * y - 1)).sum())
            yield pd.DataFrame({"i": np.arange(n * n + n + 1), "v": np.concatenate([hessian.ravel(), right, [loss]])})

        sums = data.mapInPandas(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas().sort_values("i")["v"].to_numpy()
        return sums[: n * n].reshape(n, n) + ridge, sums[n * n : n * n + n] - ridge @ w, sums[-1] + w @ ridge @ w / 2

    hessian, right, loss = add(w)
    for done in range(iterations):
        step = np.linalg.lstsq(hessian, right, rcond=None)[0]
        if np.abs(step).max() < 1e-11:
            break
        for _ in range(30):  # halved until the loss falls, which it need not where steps are long
            there = add(w + step)
            if there[2] <= loss + 1e-9 * abs(loss):
                break
            step = step / 2
        w, (hessian, right, loss) = w + step, there
    return Logistic(float(w[0]), w[1:], done)


def row_losses(probs: Column, labels: Column, mask: Column, vad: Column, vad_gold: Column, uniform_transport: Column) -> Column:
    """struct<cross_entropy, vad, transport, terms> of one row's stored predictions: what `mean_loss` adds up."""
    p = F.transform(probs, lambda x: F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), x)))
    each = F.zip_with(F.zip_with(p, labels, lambda a, b: -(b * F.ln(a) + (1 - b) * F.ln(1 - a))), mask, lambda a, m: a * m)
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    squares = F.zip_with(vad, vad_gold, lambda a, b: (a - b) * (a - b))
    return F.struct(add(each).alias("cross_entropy"), (add(squares) / F.size(vad)).alias("vad"), uniform_transport.alias("transport"), add(F.transform(mask, lambda m: m.cast("double"))).alias("terms"))


def mean_loss(rows: DataFrame, losses: str, weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """One row: masked cross-entropy a known label, mean squared VAD error, mean transport, and their weighted sum."""
    c = F.col(losses)
    out = rows.agg((F.sum(c["cross_entropy"]) / F.greatest(F.sum(c["terms"]), F.lit(1.0))).alias("cross_entropy"), F.avg(c["vad"]).alias("vad"), F.avg(c["transport"]).alias("transport"))
    return out.withColumn("loss", weights[0] * F.col("cross_entropy") + weights[1] * F.col("vad") + weights[2] * F.col("transport"))


def composite_loss(probs: np.ndarray, labels: np.ndarray, mask: np.ndarray, vad: np.ndarray, vad_gold: np.ndarray, transport: np.ndarray, weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> float:
    """Masked cross-entropy, squared VAD error and mean transport, weighted: what training minimises, over stored predictions."""
    p = np.clip(probs, 1e-7, 1 - 1e-7)
    ce = -(labels * np.log(p) + (1 - labels) * np.log(1 - p)) * mask
    return float(weights[0] * ce.sum() / max(mask.sum(), 1) + weights[1] * ((vad - vad_gold) ** 2).mean() + weights[2] * transport.mean())
