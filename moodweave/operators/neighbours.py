"""Searches of documents against documents: by transport between emotion profiles, and by cosine between vectors.

The queries are a stated part of the rows.  They are taken in blocks of at most BLOCK, each sent whole to the tasks; every task reads
its part of the rows once a block and keeps only the best k of it for each query, and a window over those gives the final k.  No
row is shuffled for a query, and no pair outlives its batch.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import settle
from . import transport as ot

#: Queries that are sent to the tasks at once, rows that meet them at once, and pairs that a task should have at most: solved, screened.
BLOCK, BATCH, PAIRS, SCREENED = 2048, 1024, 1 << 22, 1 << 28


def search(rows: DataFrame, queries: Column, k: int | None, distances: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray], with_self: bool = False, most: int = PAIRS, more: DataFrame | None = None) -> DataFrame:
    """(query, id, distance, rank): of rows(id, ...) the k nearest of each query row, ties by id; itself excluded unless asked for.

    distances gives the [queries, rows] matrix of a block and a batch, inf for pairs that are none.  Without k all distances are kept,
    there is no rank, and rows go to whoever reads them without being stored (each reading solves them anew).  most: pairs of a block that a task should have; more(id, ...): further columns of the queries.
    """
    spark = rows.sparkSession
    rows = settle(rows, "search-rows")
    n, asked = rows.count(), rows.where(queries).count()
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-n * min(asked, BLOCK) // most))
    blocks = max(1, -(-asked // BLOCK))
    spread = settle(rows.repartition(max(1, min(n, tasks))), "search-spread")
    found = None
    for b in range(blocks):
        mine = rows.where(queries).where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        mine = mine if more is None else mine.join(more, "id")
        block = mine.toPandas().sort_values("id", ignore_index=True)  # about BLOCK rows
        one = spread.mapInPandas(_nearest(spark.sparkContext.broadcast(block), k, distances, with_self), "query long, id long, distance double")
        one = one if k is None else settle(one, "search-found")
        found = one if found is None else found.unionByName(one)
    if k is None:
        return found
    w = Window.partitionBy("query").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _nearest(block, k: int | None, distances, with_self: bool):
    def run(it):
        q = block.value
        asked = q["id"].to_numpy()
        kth = np.full(len(q), np.inf)  # of what was met so far
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))  # place of the query, id, distance
        for pdf in it:
            for start in range(0, len(pdf), BATCH) if len(q) else ():
                part = pdf.iloc[start : start + BATCH].reset_index(drop=True)
                there = part["id"].to_numpy()
                d = distances(q, part)
                if not with_self:
                    d[asked[:, None] == there[None, :]] = np.inf
                if k is None:
                    if (held := np.isfinite(d)).all():
                        yield pd.DataFrame({"query": np.repeat(asked, len(there)), "id": np.tile(there, len(asked)), "distance": d.ravel()})
                        continue
                    i, j = np.nonzero(held)
                    yield pd.DataFrame({"query": asked[i], "id": there[j], "distance": d[i, j]})
                    continue
                if len(part) > k and np.isinf(kth).any():
                    kth = np.minimum(kth, np.partition(d, k - 1, axis=1)[:, k - 1])
                i, j = np.nonzero((d <= kth[:, None]) & np.isfinite(d))
                if not len(i):
                    continue
                met = np.zeros(len(q), bool)
                met[i] = True
                old = met[best[0]]
                at, ids, far = (np.concatenate([x[old], y]) for x, y in zip(best, (i, there[j], d[i, j]), strict=True))
                order = np.lexsort((ids, far, at))
                at, ids, far = at[order], ids[order], far[order]
                rank = np.arange(len(at)) - np.searchsorted(at, at)
                last = rank == k - 1
                kth[at[last]] = far[last]
                best = tuple(np.concatenate([x[~old], y[rank < k]]) for x, y in zip(best, (at, ids, far), strict=True))
        if k is not None and len(q):
            yield pd.DataFrame({"query": asked[best[0]], "id": best[1], "distance": best[2]})

    return run


def _prepared(profiles: DataFrame, cost: np.ndarray, solver: ot.Solver, vector: str, key: str) -> DataFrame:
    """(id, x, self_cost): measures as the solver wants them; self costs are solved once a document."""

    def prepare(it):
        for pdf in it:
            x = solver.prepare(np.stack(pdf["x"])) if len(pdf) else np.zeros((0, len(cost)))
            yield pd.DataFrame({"id": pdf["id"], "x": list(x), "self_cost": ot.self_costs(x, cost, solver)})

    return profiles.select(F.col(key).alias("id"), F.col(vector).alias("x")).mapInPandas(prepare, "id long, x array<double>, self_cost double")


def _transport(cost: np.ndarray, solver: ot.Solver):
    def distances(q: pd.DataFrame, part: pd.DataFrame) -> np.ndarray:
        x, s = np.stack(part["x"]).astype(float), part["self_cost"].to_numpy(float)
        return np.stack([ot.distances(np.broadcast_to(np.asarray(qx, float), x.shape), x, np.full(len(x), qs), s, cost, solver) for qx, qs in zip(q["x"], q["self_cost"], strict=True)])

    return distances


def _stack(x: pd.Series, width: int) -> np.ndarray:
    return np.stack(x).astype(float) if len(x) else np.zeros((0, width))


def _screened(rows: DataFrame, queries: Column, cost: np.ndarray, solver: ot.Solver, k: int) -> DataFrame:
    """`search` by transport, solving only pairs that `ot.screen` leaves open.

    The k nearest by the screen, solved, bound each query's k-th distance from above; whatever the screen puts beyond that can't be
    among the k nearest.  Pairs of equal measures are solved once a batch.
    """
    width = len(cost)
    def screen(q: pd.DataFrame, part: pd.DataFrame) -> np.ndarray:
        return ot.screen(_stack(q["x"], width), _stack(part["x"], width), solver)

    near = search(rows, queries, k, screen, most=SCREENED)
    ends = lambda name, x, c: rows.select(F.col("id").alias(name), F.col("x").alias(x), F.col("self_cost").alias(c))
    pairs = near.select("query", "id").join(ends("query", "qx", "qs"), "query").join(ends("id", "ix", "is"), "id")

    def solved(it):
        for pdf in it:
            d = ot.distances(_stack(pdf["qx"], width), _stack(pdf["ix"], width), pdf["qs"].to_numpy(float), pdf["is"].to_numpy(float), cost, solver)
            yield pd.DataFrame({"id": pdf["query"], "distance": d})

    bounds = pairs.mapInPandas(solved, "id long, distance double").groupBy("id").agg(F.count("*").alias("n"), F.max("distance").alias("bound"))
    bounds = settle(bounds.select("id", F.when(F.col("n") == k, F.col("bound")).otherwise(float("inf")).alias("bound")), "screen-bounds")

    def distances(q: pd.DataFrame, part: pd.DataFrame) -> np.ndarray:
        x, y = _stack(q["x"], width), _stack(part["x"], width)
        out = np.full((len(x), len(y)), np.inf)
        i, j = np.nonzero((ot.screen(x, y, solver) <= ot.screen_limit(q["bound"].to_numpy(float))[:, None]) & (q["id"].to_numpy()[:, None] != part["id"].to_numpy()[None, :]))
        if len(i):
            ids = [np.unique(z, axis=0, return_index=True, return_inverse=True)[1:] for z in (x, y)]
            (fx, cx), (fy, cy) = ((first, of.ravel()) for first, of in ids)
            each, of = np.unique(cx[i] * len(fy) + cy[j], return_inverse=True)
            p, r = fx[each // len(fy)], fy[each % len(fy)]
            s, t = q["self_cost"].to_numpy(float), part["self_cost"].to_numpy(float)
            step = 1 << 16
            out[i, j] = np.concatenate([ot.distances(x[p[a : a + step]], y[r[a : a + step]], s[p[a : a + step]], t[r[a : a + step]], cost, solver) for a in range(0, len(p), step)])[of.ravel()]
        return out

    return search(rows, queries, k, distances, most=SCREENED, more=bounds)


def transport_neighbours(profiles: DataFrame, queries: Column, cost: np.ndarray, solver: ot.Solver = ot.Solver(), k: int = 10, vector: str = "x", key: str = "doc_id") -> DataFrame:
    """Nearest documents by transport between their measures; all pairs are solved where `ot.screen` doesn't hold."""
    rows = _prepared(profiles, cost, solver, vector, key)
    if ot.can_screen(cost, solver):
        rows = settle(rows, "measures")
        if (rows.agg(F.max(F.array_max("x"))).first()[0] or 0.0) <= ot.SCREEN_MOST:
            return _screened(rows, queries, cost, solver, k)
    return search(rows, queries, k, _transport(cost, solver))


def distance_rows(profiles: DataFrame, rows: Column, cost: np.ndarray, solver: ot.Solver = ot.Solver(), vector: str = "x", key: str = "doc_id") -> DataFrame:
    """(query, id, distance): the stated rows of the distance matrix of all profiles; `F.lit(True)` gives it whole.

    The diagonal is 0 for divergences, and there only; without one, the query is the side that mass starts from.
    """
    far = search(_prepared(profiles, cost, solver, vector, key), rows, None, _transport(cost, solver), with_self=True)
    return far.withColumn("distance", F.when(F.col("query") == F.col("id"), 0.0).otherwise(F.col("distance"))) if solver.divergence else far


def cosine_neighbours(vectors: DataFrame, queries: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Nearest vectors by half of one minus cosine; rows without a vector take no part."""
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.transform(vector, lambda v: v.cast("double")).alias("x"))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))

    def distances(q: pd.DataFrame, part: pd.DataFrame) -> np.ndarray:
        lengths = q["norm"].to_numpy()[:, None] * part["norm"].to_numpy()[None, :]
        return np.clip((1 - np.stack(q["x"]) @ np.stack(part["x"]).T / lengths) / 2, 0, 1)

    return search(rows.withColumn("norm", norm).where(F.col("norm") > 0), queries, k, distances)


def against_mean(profiles: DataFrame, cost: np.ndarray, solver: ot.Solver, k: int = 3, vector: str = "x", key: str = "doc_id") -> DataFrame:
    """Each document's transport to the mean measure: cost parts, the divergence and the k largest flows off the diagonal."""
    width = len(cost)
    profiles = settle(profiles.select(key, vector), "mean-rows")  # read twice
    means = profiles.agg(*[F.avg(F.col(vector)[i]).alias(str(i)) for i in range(width)]).first()
    mean = solver.prepare(np.array([[means[str(i)] or 0.0 for i in range(width)]]))
    mean_self = ot.self_costs(mean, cost, solver)

    def solve(it):
        for pdf in it:
            if not len(pdf):
                continue
            a = solver.prepare(np.stack(pdf["x"]))
            b = np.broadcast_to(mean, a.shape)
            p = ot.parts(a, b, cost, solver)
            flows = [[{"from": i, "to": j, "mass": m, "contribution": c} for i, j, m, c in ot.top_flows(x, cost, k)] for x in p["plan"]]
            d = ot.distances(a, b, ot.self_costs(a, cost, solver), np.repeat(mean_self, len(a)), cost, solver)
            yield pd.DataFrame({"id": pdf["id"], "distance": d, "flows": flows} | {c: p[c] for c in ("transport", "kl_a", "kl_b", "mass_a", "mass_b", "mass_plan")})

    schema = "id long, distance double, flows array<struct<from:int,to:int,mass:double,contribution:double>>, transport double, kl_a double, kl_b double, mass_a double, mass_b double, mass_plan double"
    return profiles.select(F.col(key).alias("id"), F.col(vector).alias("x")).mapInPandas(solve, schema)


def exact_to_mean(profiles: DataFrame, cost: np.ndarray, vector: str = "x", key: str = "doc_id") -> DataFrame:
    """(key, emd): exact transport of each document's distribution to that of the mean measure."""
    profiles = settle(profiles.select(key, vector), "mean-rows")  # read twice
    means = profiles.agg(*[F.avg(F.greatest(F.col(vector)[i], F.lit(0.0))).alias(str(i)) for i in range(len(cost))]).first()
    mean = np.maximum([[means[str(i)] or 0.0 for i in range(len(cost))]], ot.FLOOR)

    def solve(it):
        for pdf in it:
            x = np.maximum(np.stack(pdf[vector]), ot.FLOOR) if len(pdf) else np.zeros((0, len(cost)))
            yield pd.DataFrame({key: pdf[key], "emd": ot.loss(x, np.broadcast_to(mean, x.shape), cost, "emd")})

    return profiles.mapInPandas(solve, f"{key} long, emd double")


def reverse_explanation(e: DataFrame) -> DataFrame:
    """An explanation seen from the other side: a and b, from and to, exchanged."""
    return e.withColumns({"kl_a": F.col("kl_b"), "kl_b": F.col("kl_a"), "mass_a": F.col("mass_b"), "mass_b": F.col("mass_a"), "flows": F.transform("flows", lambda f: F.struct(f["to"].alias("from"), f["from"].alias("to"), f["mass"].alias("mass"), f["contribution"].alias("contribution")))})
