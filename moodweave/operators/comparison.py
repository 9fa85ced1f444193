"""Whole comparisons: score rows, pairs, token clouds, groups; and the search for good settings."""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import WORD
from ..functions.vectors import align
from ..storage import settle
from . import clouds, features, lexicon, measures, neighbours
from . import transport as ot
from .lexicon import EMOTIONS
from .rollups import top_per_group


def measured_rows(scores: DataFrame, cfg: Config, emotions: list[str] = EMOTIONS, measure: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, x) to compare, and (doc_id, reason) of what the low-signal filter dropped."""
    reasons = measures.low_signal_reason(scores, 1, None) if cfg.low_signal_filter else scores.withColumn("reason", F.lit(None).cast("string"))
    kept = reasons.where("reason is null")
    name = measure or measures.choose_measure(scores, cfg.solver().unbalanced)
    x = align(measures.measure(name), F.col("emotions"), emotions) if "emotions" in scores.columns else measures.measure(name)
    rows = kept.withColumn("x", x)
    if name in measures.SIMPLEX:
        rows = measures.has_mass(rows, "x")
    return rows.select("doc_id", "x"), reasons.where("reason is not null").select("doc_id", "reason")


def style_measure(scores: DataFrame) -> str | None:
    """The distribution that style is compared by, by what columns there are."""
    return next((m for m in ("pred_dist_calibrated", "pred_dist", "pred_sigmoid", "pred_softmax", "lex_prior") if m in scores.columns), None)


def compare_scores(scores: DataFrame, queries: Column, cost: np.ndarray, cfg: Config = Config(), measure: str | None = None, style: str | None = None) -> DataFrame:
    """(query, id, rank, distance, mass_diff, deltas): neighbours of the query rows with their largest emotion differences.

    With `style`, a distribution, style_distance is added: the balanced divergence between the two documents' distributions.
    """
    rows, _ = measured_rows(scores, cfg, measure=measure)
    rows = settle(rows, "compare-rows")  # read for the search and for both sides of its pairs
    near = neighbours.transport_neighbours(rows, queries, cost, cfg.solver(), cfg.top_k)
    q, j = rows.select(F.col("doc_id").alias("query"), F.col("x").alias("qx")), rows.select(F.col("doc_id").alias("id"), F.col("x").alias("jx"))
    both = near.join(q, "query").join(j, "id")
    mass = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    if style is not None:
        like = scores.select("doc_id", measures.measure(style).alias("s"))
        balanced = ot.Solver("sinkhorn_divergence", cfg.epsilon, cfg.iterations)

        def styled(it):
            for pdf in it:
                x, y = (balanced.prepare(np.stack(pdf[c])) if len(pdf) else np.zeros((0, len(cost))) for c in ("s", "t"))
                d = ot.distances(x, y, ot.self_costs(x, cost, balanced), ot.self_costs(y, cost, balanced), cost, balanced)
                yield pdf[["query", "id"]].assign(style_distance=d)

        pairs = near.select("query", "id").join(like.withColumnRenamed("doc_id", "query"), "query").join(like.select(F.col("doc_id").alias("id"), F.col("s").alias("t")), "id")
        both = both.join(pairs.mapInPandas(styled, "query long, id long, style_distance double"), ["query", "id"], "left")
    return both.withColumn("mass_diff", F.abs(mass("jx") - mass("qx"))).withColumn("deltas", top_deltas(F.col("qx"), F.col("jx"), 3)).drop("qx", "jx")


def top_deltas(x: Column, y: Column, k: int) -> Column:
    """array<struct<size, emotion, delta>>: the k largest differences y - x, ties by emotion."""
    d = F.transform(F.zip_with(x, y, lambda a, b: b - a), lambda v, i: F.struct((-F.abs(v)).alias("size"), i.alias("emotion"), v.alias("delta")))
    return F.slice(F.array_sort(d), 1, k)


def explain_pair(scores: DataFrame, i, j, cost: np.ndarray, cfg: Config = Config(), measure: str | None = None) -> dict:
    """Parts, distance and largest flows between two documents."""
    rows, dropped = measured_rows(scores, cfg, measure=measure)
    got = {r["doc_id"]: r["x"] for r in rows.where(F.col("doc_id").isin(i, j)).collect()}
    if {i, j} - set(got):
        return {"error": "not comparable", "dropped": {r["doc_id"]: r["reason"] for r in dropped.where(F.col("doc_id").isin(i, j)).collect()}}
    s = cfg.solver()
    a, b = s.prepare(np.array([got[i]])), s.prepare(np.array([got[j]]))
    p = ot.parts(a, b, cost, s)
    d = ot.distances(a, b, ot.self_costs(a, cost, s), ot.self_costs(b, cost, s), cost, s)
    return {k: float(v[0]) for k, v in p.items() if k != "plan"} | {"distance": float(d[0]), "flows": ot.top_flows(p["plan"][0], cost, cfg.top_flows)}


def selected_clouds(docs: DataFrame, vad: DataFrame, cfg: Config = Config(), weights: DataFrame | None = None, stops: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """(doc_id, terms, w, x, conf): each document's cloud of emotional terms, by the steps and settings of the reference's driver.

    The vocabulary is filtered by vad_threshold and min_arousal (a column in_lexicon of vad tells lexicon terms from others; without it
    all are); phrases, then words or their base words are extracted unless negated or a stop word; the drop_top_df most frequent words
    of the corpus are dropped; idf is over what is left, and max_terms of each document are kept, by tf-idf, tf or alike (cfg.weight).
    The lexicon and the stop words are bounded tables and come to the driver.  Costs by embedding take vectors(term, vector).
    """
    marked = vad if "in_lexicon" in vad.columns else vad.withColumn("in_lexicon", F.lit(True))
    if (cfg.cost != "vad") != (vectors is not None):
        raise ValueError("costs by embedding need vectors, and no other cost does")
    emotional = lexicon.emotional_terms(marked, cfg.vad_threshold, cfg.min_arousal).where("conf > 0" if cfg.cost == "vad" else "true").select("term")
    allowed = {r["term"] for r in emotional.collect()}
    stopped = {r["term"] for r in stops.select("term").collect()} if stops is not None else set()
    counts = features.emotional_words(docs, allowed, stopped, cfg.negation_window, cfg.min_token_len)
    if cfg.drop_top_df > 0:
        df = lexicon.document_frequency(docs, cfg.min_token_len)
        df = df if stops is None else df.join(stops.select("term"), "term", "left_anti")
        counts = counts.join(F.broadcast(clouds.frequent_terms(df, cfg.drop_top_df)), "term", "left_anti")  # drop_top_df rows
    counts = settle(counts, "cloud-terms")  # read twice
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    ranked = clouds.ranked_terms(counts, df, docs.count(), cfg.max_terms, weights, mode=cfg.weight, least=cfg.weight_min, most=cfg.weight_max, power=cfg.weight_power, mix=cfg.weight_mix)
    return clouds.build_clouds(ranked, vad, docs, vectors)


def explain_clouds(docs: DataFrame, vad: DataFrame, i, j, cfg: Config = Config(), weights: DataFrame | None = None, stops: DataFrame | None = None, vectors: DataFrame | None = None) -> dict:
    """Distance and largest term flows from document i to j, their terms being selected over all documents."""
    cloud = settle(selected_clouds(docs, vad, cfg, weights, stops, vectors).where(F.col("doc_id").isin(i, j)), "pair-clouds")
    sizes = {r["doc_id"]: r["n"] for r in cloud.select("doc_id", F.size("terms").alias("n")).collect()}
    if not (sizes.get(i) and sizes.get(j)):
        return {"error": "not comparable", "terms": sizes}
    pair = docs.sparkSession.createDataFrame([(min(i, j), max(i, j))], "i long, j long")
    r = clouds.compare_pairs(pair, cloud, ot.Solver("sinkhorn_divergence", cfg.epsilon, cfg.iterations), cfg.top_flows, cfg.term_cost()).first()
    flows = [f.asDict() for f in r["flows"]]
    return {"distance": r["distance"], "terms": sizes, "flows": flows if i <= j else [f | {"from": f["to"], "to": f["from"]} for f in flows]}


def compare_clouds(docs: DataFrame, vad: DataFrame, queries: Column, cfg: Config = Config(), weights: DataFrame | None = None, candidates: int = 0, stops: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """(query, id, rank, distance, flows): neighbours of the query documents by transport between term clouds, among all documents.

    A query without terms is a row without a neighbour.  With `candidates`, only so many clouds of the nearest centroids are solved
    for each query, and neighbours outside of them are missed.
    """
    cloud = settle(selected_clouds(docs, vad, cfg, weights, stops, vectors), "clouds")  # read for the search and for its flows
    asked = cloud.withColumnRenamed("doc_id", "id").where(queries)
    solver = ot.Solver("sinkhorn_divergence", cfg.epsilon, cfg.iterations)
    if candidates > 0:
        pairs = clouds.candidate_pairs(cloud, queries, max(candidates, cfg.top_k))
    else:
        near = clouds.cloud_neighbours(cloud, queries, cfg.top_k, solver, cfg.term_cost())
        pairs = near.select(F.least("query", "id").alias("i"), F.greatest("query", "id").alias("j")).distinct()
    solved = clouds.compare_pairs(pairs, cloud, solver, cfg.top_flows, cfg.term_cost())
    turned = F.transform("flows", lambda f: F.struct(f["to"].alias("from"), f["from"].alias("to"), f["mass"].alias("mass"), f["contribution"].alias("contribution")))
    both = solved.select(F.col("i").alias("query"), F.col("j").alias("id"), "distance", "flows").unionByName(solved.select(F.col("j").alias("query"), F.col("i").alias("id"), "distance", turned.alias("flows")))
    if candidates > 0:
        found = top_per_group(both.join(asked.select(F.col("id").alias("query")), "query", "left_semi"), "query", cfg.top_k, F.col("distance"), F.col("id"))
    else:
        found = near.join(both.select("query", "id", "flows"), ["query", "id"])
    alone = asked.where(F.size("terms") == 0).select(F.col("id").alias("query"))
    return found.unionByName(alone, allowMissingColumns=True)


def group_shift(tokens: DataFrame, group: str, vad: DataFrame, cfg: Config = Config()) -> dict:
    """Transport between the pooled clouds of the two largest groups, with both directions' largest flows.

    Each group's cloud is its max_terms most frequent terms, so what comes to the driver is bounded.
    """
    shares = clouds.group_shift(tokens.join(vad.select("term"), "term", "left_semi"), group)
    top = top_per_group(shares, group, cfg.max_terms, F.desc("n"), F.col("term")).join(vad, "term").orderBy(group, "rank").toPandas()
    made = {}
    for name, g in top.groupby(group, sort=True):
        made[name] = {"terms": g["term"].tolist(), "w": g["n"].to_numpy(float), "x": g[["v", "a", "d"]].to_numpy(float), "conf": g["conf"].to_numpy(float)}
    if len(made) < 2:
        return {"error": "fewer than two groups"}
    (na, a), (nb, b) = list(made.items())[:2]
    s = ot.Solver("sinkhorn_divergence", cfg.epsilon, cfg.iterations)
    d, more = clouds.cloud_distance(a, b, s, clouds.self_cost(a, s), clouds.self_cost(b, s))
    flows = [{"from": a["terms"][p], "to": b["terms"][q], "mass": m, "contribution": c} for p, q, m, c in ot.top_flows(more["plan"], more["cost"], cfg.top_flows, True)]
    return {"groups": [na, nb], "distance": d, "flows": flows, "back": [{"from": f["to"], "to": f["from"], "mass": f["mass"], "contribution": f["contribution"]} for f in flows]}


def guardrails(docs: DataFrame, vad: DataFrame, cfg: Config, kinds: DataFrame | None = None, queries: Column | None = None) -> dict:
    """Statistics of a token comparison with these settings, for `tune`: coverage (words that become terms), zero_share (documents
    without a term) and selected (the middle document's share); with kinds(doc_id, kind) and queries, also score, the share of the
    queries whose nearest document is of their kind."""
    cloud = settle(selected_clouds(docs, vad, cfg).select("doc_id", "terms", "w", "x", "conf"), "guard-clouds")
    words = docs.select("doc_id", F.size(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(WORD), F.lit(0))).alias("n"))
    each = words.join(cloud.select("doc_id", F.size("terms").alias("terms")), "doc_id").withColumn("share", F.col("terms") / F.greatest("n", F.lit(1)))
    r = each.agg((F.sum("terms") / F.greatest(F.sum("n"), F.lit(1))).alias("coverage"), F.avg((F.col("terms") == 0).cast("double")).alias("zero_share"), F.percentile_approx("share", 0.5).alias("selected")).first()
    out = {k: float(v or 0.0) for k, v in r.asDict().items()}
    if kinds is not None and queries is not None:
        near = clouds.cloud_neighbours(cloud, queries, 1, ot.Solver("sinkhorn_divergence", cfg.epsilon, cfg.iterations), cfg.term_cost())
        met = near.join(kinds.select(F.col("doc_id").alias("query"), F.col("kind").alias("qk")), "query").join(kinds.select(F.col("doc_id").alias("id"), F.col("kind").alias("jk")), "id")
        out["score"] = float(met.agg(F.avg((F.col("qk") == F.col("jk")).cast("double"))).first()[0] or 0.0)
    return out


def tune_guardrails(docs: DataFrame, vad: DataFrame, limits: dict[str, float], cfg: Config = Config(), rounds: int = 4, restarts: int = 2, **how) -> tuple[Config, dict]:
    """Settings of the vocabulary (vad_threshold, min_arousal, drop_top_df) that come closest to the limits on `guardrails`."""
    steps = {"vad_threshold": (0.1, 0.05, 0.85), "min_arousal": (0.1, 0.05, 0.85), "drop_top_df": (50, 0, 400)}
    whole = lambda s: s | {"drop_top_df": int(s["drop_top_df"])}
    best, stats = tune(lambda s: guardrails(docs, vad, replace(cfg, **whole(s)), **how), {k: getattr(cfg, k) for k in steps}, steps, limits, rounds, restarts)
    return replace(cfg, **whole(best)), stats


def tune(evaluate: Callable[[dict], dict], start: dict, steps: dict[str, tuple[float, float, float]], limits: dict[str, float], rounds: int = 10, restarts: int = 0, seed: int = 13) -> tuple[dict, dict]:
    """Settings that come closest to the limits, by hill climbing: each round tries one step up and down of each setting.  The climb is
    repeated from `restarts` seeded random settings, as long as some limit is not met.

    evaluate gives statistics of settings (coverage, separation, score, selected: at least; zero_share: at most the limit); an
    attempt is ranked by its weighted shortfalls, then by score and coverage.  steps: setting to (step, least, most).
    """
    weight = {"coverage": 2.0, "score": 2.0, "separation": 2.0}
    seen: dict[tuple, tuple] = {}

    def rank(settings: dict) -> tuple:
        key = tuple(sorted(settings.items()))
        if key not in seen:
            s = evaluate(settings)
            short = sum(weight.get(k, 1.0) * max(0.0, ((s[k] - v) if k == "zero_share" else (v - s[k])) / max(abs(v), 1e-9)) for k, v in limits.items())
            seen[key] = ((short, -s.get("score", 0.0), -s.get("coverage", 0.0)), s)
        return seen[key][0]

    def climb(best: dict) -> dict:
        for _ in range(rounds):
            tries = [best | {k: min(most, max(least, round(best[k] + sign * step, 10)))} for (k, (step, least, most)), sign in itertools.product(steps.items(), (1, -1))]
            found = min(tries, key=rank, default=best)
            if rank(found) >= rank(best):
                break
            best = found
        return best

    best, draws = climb(dict(start)), random.Random(seed)
    for _ in range(restarts):
        if rank(best)[0] <= 0:
            break
        drawn = {k: round(least + step * draws.randrange(int((most - least) / step) + 1), 10) for k, (step, least, most) in steps.items()}
        best = min(best, climb(dict(start) | drawn), key=rank)
    rank(best)
    return best, seen[tuple(sorted(best.items()))][1]
