"""Whole comparisons, models and settings search on small tables."""

from __future__ import annotations

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from moodweave import cli, config
from moodweave.functions import labels as lb
from moodweave.functions import text as tx
from moodweave.operators import clouds, comparison, models, neighbours, sampling
from moodweave.operators import transport as ot


def scores(spark):
    rows = [(0, 2000, 100, [10.0, 0.0], None), (1, 2000, 100, [0.0, 10.0], None), (2, 2000, 100, [6.0, 4.0], None), (3, 2000, 100, [1.0, 1.0], True)]
    return spark.createDataFrame(rows, "doc_id long, n_words int, n_tokens int, lex_counts array<double>, low_emotion_signal boolean")


def test_compare_and_explain(spark):
    cfg = config.Config(mode="sinkhorn_divergence", top_k=2, low_signal_filter=True)
    got = comparison.compare_scores(scores(spark), F.col("id") == 0, ot.uniform_cost(2), cfg, "lex_counts_per_1k_words").orderBy("rank").collect()
    assert [r["id"] for r in got] == [2, 1] and got[0]["deltas"][0]["emotion"] == 0 and got[0]["mass_diff"] == 0
    e = comparison.explain_pair(scores(spark), 0, 2, ot.uniform_cost(2), cfg, "lex_counts_per_1k_words")
    assert abs(e["distance"] - got[0]["distance"]) < 1e-9 and e["flows"][0][:2] == (0, 1)
    assert comparison.explain_pair(scores(spark), 0, 3, ot.uniform_cost(2), cfg, "lex_counts_per_1k_words")["dropped"] == {3: "flagged"}


def test_compare_clouds_and_groups(spark):
    docs = spark.createDataFrame([(0, "happy glad"), (1, "glad happy happy"), (2, "sad grim"), (3, "grim")], "doc_id long, text string")
    vad = spark.createDataFrame([("happy", 0.9, 0.5, 0.5, 1.0), ("glad", 0.8, 0.4, 0.5, 1.0), ("sad", -0.8, 0.3, 0.2, 1.0), ("grim", -0.7, 0.2, 0.2, 1.0)], "term string, v double, a double, d double, conf double")
    near = comparison.compare_clouds(docs, vad, F.lit(True), config.Config(top_k=1)).collect()
    assert {(r["query"], r["id"]) for r in near} == {(0, 1), (1, 0), (2, 3), (3, 2)}
    words = docs.withColumn("g", (F.col("doc_id") > 1).cast("string")).select("doc_id", "g", F.explode(F.split("text", " ")).alias("term"))
    out = comparison.group_shift(words, "g", vad)
    assert out["groups"] == ["false", "true"] and out["distance"] > 0.1 and out["flows"][0]["from"] in ("happy", "glad")


def test_clouds_rank_lexicon_terms_only(spark):
    """Rare words outside the lexicon took the places of a cloud; documents without terms vanished."""
    docs = spark.createDataFrame([(0, "zyx wvu tsr happy sad"), (1, "happy sad qpo nml"), (2, "kji hgf"), (3, None)], "doc_id long, text string")
    vad = spark.createDataFrame([("happy", 0.9, 0.5, 0.5, 1.0), ("sad", -0.8, 0.3, 0.2, 1.0)], "term string, v double, a double, d double, conf double")
    terms = clouds.weighted_terms(docs, 4, 2, vocabulary=vad)
    assert sorted((r["doc_id"], r["term"]) for r in terms.collect()) == [(0, "happy"), (0, "sad"), (1, "happy"), (1, "sad")]
    near = comparison.compare_clouds(docs, vad, F.lit(True), config.Config(max_terms=2)).collect()
    assert {(r["query"], r["id"]) for r in near} == {(0, 1), (1, 0), (2, None), (3, None)}


def test_compare_clouds_selects_its_terms(spark):
    """Negated, dull and too frequent words entered the clouds; phrases and inflected words did not."""
    docs = spark.createDataFrame([(0, "not happy but glad"), (1, "very sad tables, a table regrets"), (2, "glad not only grim glad")], "doc_id long, text string")
    vad = spark.createDataFrame([("happy", 0.9, 0.5, 0.5, 1.0), ("glad", 0.8, 0.4, 0.5, 1.0), ("very sad", -0.9, 0.3, 0.2, 1.0), ("sad", -0.7, 0.3, 0.2, 1.0), ("table", 0.1, 0.1, 0.1, 1.0), ("regret", -0.6, 0.2, 0.2, 1.0), ("grim", -0.7, 0.2, 0.2, 1.0)], "term string, v double, a double, d double, conf double")
    held = lambda cfg, **more: {r["doc_id"]: sorted(r["terms"]) for r in comparison.selected_clouds(docs, vad, cfg, **more).collect()}
    assert held(config.Config()) == {0: ["glad"], 1: ["regret", "very sad"], 2: ["glad", "grim"]}
    assert held(config.Config(vad_threshold=0.65, negation_window=0)) == {0: ["glad", "happy"], 1: ["very sad"], 2: ["glad", "grim"]}
    assert held(config.Config(drop_top_df=2)) == {0: [], 1: ["regret", "very sad"], 2: ["grim"]}
    assert held(config.Config(), stops=spark.createDataFrame([("grim",)], "term string"))[2] == ["glad"]
    near = {(r["query"], r["id"]): r for r in comparison.compare_clouds(docs, vad, F.lit(True)).collect()}
    e = comparison.explain_clouds(docs, vad, 2, 1)
    assert abs(e["distance"] - near[2, 1]["distance"]) < 1e-9 and e["flows"][0]["from"] in ("glad", "grim") and e["terms"] == {1: 2, 2: 2}
    assert "error" in comparison.explain_clouds(docs, vad, 0, 1, config.Config(drop_top_df=2))


def test_cloud_search_is_exhaustive(spark):
    """Copies with the query's own centroid filled all candidate places; every other document was never solved."""
    rng = np.random.RandomState(3)
    words = [f"w{chr(97 + i)}x" for i in range(12)]
    vad = spark.createDataFrame([(w, *map(float, rng.uniform(-1, 1, 3)), float(rng.choice([0.5, 1.0]))) for w in words], "term string, v double, a double, d double, conf double")
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words, rng.randint(1, 9)))) for i in range(60)], "doc_id long, text string")
    cloud = clouds.build_clouds(clouds.weighted_terms(docs, 60, 256, vocabulary=vad), vad, docs)
    pairs = spark.range(60).select(F.col("id").alias("i")).crossJoin(spark.range(60).select(F.col("id").alias("j"))).where("i < j")
    for epsilon in (0.1, 0.02):  # shared kernels, and logarithms
        solver = ot.Solver("sinkhorn_divergence", epsilon)
        solved = {frozenset((r["i"], r["j"])): r["distance"] for r in clouds.compare_pairs(pairs, cloud, solver).collect()}
        got = clouds.cloud_neighbours(cloud, F.col("id") % 7 == 0, 4, solver).collect()
        assert len(got) == 9 * 4
        for q in range(0, 60, 7):
            want = sorted(solved[frozenset((q, j))] for j in range(60) if j != q)[:4]
            mine = sorted((r["rank"], r["distance"], r["id"]) for r in got if r["query"] == q)
            assert np.allclose([d for _, d, _ in mine], want, atol=1e-9)
            assert all(abs(solved[frozenset((q, j))] - d) < 1e-9 for _, d, j in mine)


def test_clouds_are_left_out_only_beyond_the_limit():
    """Every cloud was solved to the end, however far.  Half of the points stand in two far corners, where plans are far from balanced."""
    rng, solver, term_cost = np.random.RandomState(5), ot.Solver("sinkhorn_divergence"), ot.TermCost()
    points = np.column_stack([np.vstack([rng.uniform(-1, 1, (20, 3)), rng.choice([-0.9, 0.9], (20, 1)) + rng.uniform(-0.05, 0.05, (20, 3))]), rng.choice([0.5, 1.0], 40)])
    sizes = np.sort(rng.randint(1, 15, 400))
    places = [rng.choice(40, n, replace=bool(n % 2)) for n in sizes]  # terms may share a place
    weights = [solver.prepare(rng.rand(n) ** 4) for n in sizes]
    dense, terms = (clouds._dense(points, places, w).astype(np.float32) for w in (weights, [np.ones(n) for n in sizes]))
    selves = np.array([clouds.self_cost({"w": w, "x": points[p, :3], "conf": points[p, 3]}, solver) for w, p in zip(weights, places, strict=True)])
    left = 0
    for i in range(0, 400, 9):
        first = rng.rand(400) < 0.5
        args = ({"w": weights[i], "x": points[places[i], :3], "conf": points[places[i], 3]}, first, points, places, weights, solver, term_cost)
        whole = clouds._costs_to_all(*args)
        bound = np.sort(whole - selves / 2)[10]
        got = clouds._costs_to_all(*args, bound + selves / 2, dense, terms)
        held = np.isfinite(got)
        assert held[whole - selves / 2 <= bound].all() and np.allclose(got[held], whole[held], atol=1e-12, rtol=0)
        left += (~held).sum()
    assert left > 0.6 * 45 * 400


def test_clouds_are_left_out_before_any_iteration(spark, monkeypatch):
    """Each pair was begun.  What a pair costs at least holds for any potentials and number of iterations, also far from balance."""
    rng, term_cost = np.random.RandomState(11), ot.TermCost()
    points = np.column_stack([np.vstack([rng.uniform(-1, 1, (20, 3)), rng.choice([-0.9, 0.9], (20, 1)) + rng.uniform(-0.05, 0.05, (20, 3))]), rng.choice([0.5, 1.0], 40)])
    cost = term_cost(points[:, :3], points[:, :3], points[:, 3], points[:, 3])
    places = [rng.choice(40, n, replace=bool(n % 2)) for n in np.sort(rng.randint(1, 15, 150))]
    for iterations, epsilon in ((1, 0.1), (3, 0.1), (30, 0.1), (30, 0.04)):
        solver = ot.Solver("sinkhorn_divergence", epsilon, iterations)
        weights = [solver.prepare(rng.rand(len(p)) ** 4) for p in places]
        dense, terms = (clouds._dense(points, places, w) for w in (weights, [np.ones(len(p)) for p in places]))
        first = rng.rand(150, 150) < 0.5
        whole = np.stack([clouds._costs_to_all({"w": w, "x": points[p, :3], "conf": points[p, 3]}, first[i], points, places, weights, solver, term_cost) for i, (w, p) in enumerate(zip(weights, places, strict=True))])
        duals = [clouds._dual(w, dense.mean(0), cost[p], solver) for w, p in zip(weights, places, strict=True)]
        duals = clouds._dense(points, places, duals) / np.maximum(terms, 1)
        for f in (duals, np.where(terms > 0, rng.uniform(-0.3, 0.3, dense.shape), 0)):
            low = clouds._least_costs(dense, terms, f - (dense * f).sum(1)[:, None] * (terms > 0), dense, terms, first, cost, solver)
            assert (low <= whole + 1e-9).all()
            if f is duals and iterations == 30:
                assert (low > 0.5 * whole).mean() > 0.5
    words = [f"w{chr(97 + i)}x" for i in range(8)]
    vad = spark.createDataFrame([(w, *map(float, [s] * 3), 1.0) for w, s in zip(words, (0.9, 0.85, 0.8, 0.75, -0.9, -0.85, -0.8, -0.75), strict=True)], "term string, v double, a double, d double, conf double")
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words[:4] if i < 10 else words[4:], 6))) for i in range(60)], "doc_id long, text string")
    cloud = clouds.build_clouds(clouds.weighted_terms(docs, 60, 256, vocabulary=vad), vad, docs)
    want = clouds.cloud_neighbours(cloud, F.col("id") == 0, 3).orderBy("rank").collect()
    monkeypatch.setattr(clouds, "_least_costs", lambda *args: np.full(args[5].shape, -np.inf))
    assert clouds.cloud_neighbours(cloud, F.col("id") == 0, 3).orderBy("rank").collect() == want and all(r["id"] < 10 for r in want)


def test_equal_clouds_rank_by_id(spark, monkeypatch):
    """Copies differed in the last bits of their distance, by the clouds that they were solved with."""
    whole = clouds._costs_to_all
    monkeypatch.setattr(clouds, "_costs_to_all", lambda *a: (lambda out: out - 1e-15 * (np.arange(len(out)) % 5))(whole(*a)))
    vad = spark.createDataFrame([("happy", 0.9, 0.5, 0.5, 1.0), ("glad", 0.8, 0.4, 0.5, 0.5), ("sad", -0.8, 0.3, 0.2, 1.0)], "term string, v double, a double, d double, conf double")
    docs = spark.createDataFrame([(0, "happy sad"), *[(i, "glad happy happy") for i in range(1, 30)]], "doc_id long, text string")
    cloud = clouds.build_clouds(clouds.weighted_terms(docs, 30, 256, vocabulary=vad), vad, docs)
    got = clouds.cloud_neighbours(cloud, F.col("id") == 0, 20).orderBy("rank").collect()
    assert [r["id"] for r in got] == list(range(1, 21))


def test_compare_clouds_misses_no_neighbour(spark):
    """Fifty single words in the query's direction come first by centroid, yet stand far away; the nearest cloud was never solved."""
    far = [(f"far{chr(97 + i // 26)}{chr(97 + i % 26)}", 0.05, 0.05, 0.05, 1.0) for i in range(55)]
    vad = spark.createDataFrame([("big", 0.9, 0.9, 0.9, 1.0), ("near", 0.95, 0.9, 0.8, 1.0), *far], "term string, v double, a double, d double, conf double")
    docs = spark.createDataFrame([(0, "big"), (1, "near"), *[(i + 2, t[0]) for i, t in enumerate(far)]], "doc_id long, text string")
    got = comparison.compare_clouds(docs, vad, F.col("id") == 0, config.Config(top_k=1, drop_top_df=0, vad_threshold=0.0, min_arousal=0.0)).collect()
    assert [r["id"] for r in got] == [1] and got[0]["flows"][0]["to"] == "near"


def test_exact_transport_is_the_least(spark):
    rng = np.random.RandomState(4)
    cost = rng.rand(3, 3)
    for a, b in (([1, 1, 1], [1, 1, 1]), ([2, 1, 0], [0, 1, 2]), ([3, 0, 1], [1, 2, 1])):
        units = [np.repeat(range(3), x) for x in (a, b)]
        best = min(sum(cost[i, j] for i, j in zip(units[0], p, strict=True)) for p in itertools.permutations(units[1])) / sum(a)
        assert np.isclose(ot.exact(np.array(a, float), np.array(b, float), cost), best)
    assert np.isclose(ot.loss(np.array([[0.5, 0.5]]), np.array([[1.0, 0.0]]), ot.uniform_cost(2), "emd")[0], 0.5, atol=1e-6)


def test_tuner_climbs():
    best, stats = comparison.tune(lambda s: {"coverage": s["t"], "score": -s["t"]}, {"t": 0.1}, {"t": (0.1, 0.0, 0.9)}, {"coverage": 0.5})
    assert best == {"t": 0.5} and stats["coverage"] == 0.5


def test_ridge_and_logistic(spark):
    rng = np.random.RandomState(0)
    x = rng.rand(80, 3)
    y = x @ [0.3, -0.2, 0.5] + 0.1
    df = spark.createDataFrame([(i, v.tolist(), float(t), float(t > 0.4)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, y double, o double")
    w = models.ridge(df.repartition(3), "x", ["y"], 1e-9)["y"]
    assert np.allclose(w, [0.1, 0.3, -0.2, 0.5], atol=1e-6)
    assert models.impute(df, "x", {"p": w}).where("abs(p - y) > 1e-6").count() == 0
    fitted = models.logistic(df.select("o", *[F.col("x")[i].alias(f"f{i}") for i in range(3)]), ["f0", "f1", "f2"], "o")
    assert fitted.coefficients[2] > 0 > fitted.coefficients[1]
    assert models.composite_loss(np.array([[0.5]]), np.array([[1]]), np.array([[1]]), np.zeros(3), np.zeros(3), np.array([0.0])) == pytest.approx(np.log(2))


def test_labels_and_texts(spark):
    r = spark.range(1).select(lb.normalise_label(F.lit(" Very-Sad thing ")).alias("a"), lb.is_unlabelled(F.lit(None).cast("string")).alias("b"), lb.group_key(F.lit("1949-04-09"), True).alias("c"), lb.group_key(F.lit(" ")).alias("d"), lb.provenance(F.lit(True), F.lit(False), F.lit(0.5)).alias("e"), lb.usable_silver(F.lit(None).cast("int"), 10, F.lit(10)).alias("f"), lb.prompt(F.lit("x"), "query").alias("g"), lb.matches_any(F.lit("GenocideCase"), ["genocide"]).alias("h")).first()
    assert tuple(r) == ("very_sad_thing", True, "1949", "unknown", "lexicon_imputed", False, "query: x", True)
    t = spark.range(1).select(tx.line_chunks(F.lit("aa\nbb\ncccccc\nd"), 5).alias("a"), tx.excerpt(F.lit("one two  three four"), 6, "three").alias("b"), tx.truncate(F.lit("h" * 10 + " xx key yy " + "t" * 10), 25, 5, 5, ("key",), 3).alias("c"), tx.normalise_space(F.lit(" “a”\n–b ")).alias("d")).first()
    assert t["a"] == ["aa\nbb", "cccccc", "d"] and t["b"].startswith("…") and "three"[:2] in t["b"] and "key" in t["c"] and t["d"] == '"a" -b'


def test_balanced_sample(spark):
    rows = spark.createDataFrame([(i, "a" if i < 2 else "b" if i < 20 else "c") for i in range(40)], "id long, k string")
    got = {r["k"]: r["count"] for r in sampling.balanced(rows, "id", "k", 12, "s").groupBy("k").count().collect()}
    assert sum(got.values()) == 12 and got["a"] == 2 and min(got["b"], got["c"]) >= 4


def test_command_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "ICJ_001_A_2000-01-01_JUD.txt").write_text("we welcome and praise this\n\nhope and regret")
    (tmp_path / "in" / "ICJ_002_B_2001-01-01_JUD.txt").write_text("alarm and threat and protest")
    cli.main(["score", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "scores")])
    rows = {r["meta"]["case_id"]: r for r in spark.read.json(str(tmp_path / "scores")).collect()}
    assert rows["001"]["lex_hits"] == 4 and rows["002"]["lex_counts"][1] == 2
    cli.main(["compare", "--input", str(tmp_path / "scores"), "--output", str(tmp_path / "near"), "--queries", "true", "--measure", "lex_counts_per_1k_words"])
    assert spark.read.json(str(tmp_path / "near")).count() == 2
    cli.main(["prepare", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "chunks"), "--budget", "6"])
    assert {json.loads(x)["split"] for x in spark.read.text(str(tmp_path / "chunks")).toPandas()["value"]} == {"dev", "train"}


def test_candidates_tie_at_nine_decimals(spark):
    """Centroids that differ in their last bits were ranked by these, and one at the origin was no candidate (F5)."""
    points = [(0, (1.0, 0.0, 0.0)), (1, (1.0, 1e-6, 0.0)), (2, (1.0, 0.0, 0.0)), (3, (0.0, 0.0, 0.0)), (4, (-1.0, 0.0, 0.0))]
    made = spark.createDataFrame([(i, ["t"], [1.0], [list(x)], [1.0]) for i, x in points], "doc_id long, terms array<string>, w array<double>, x array<array<double>>, conf array<double>")
    found = lambda k: {(r["i"], r["j"]) for r in clouds.candidate_pairs(made, F.col("id") == 0, k).collect()}
    assert found(1) == {(0, 1)} and found(3) == {(0, 1), (0, 2), (0, 3)}


SCREENED = ot.Solver("unbalanced_divergence", 0.1, 30, 0.5)


def measures(n: int, seed: int = 5) -> np.ndarray:
    """Of masses from thousandths to a thousand, with empty bins, near copies and copies."""
    rng = np.random.default_rng(seed)
    x = 10 ** rng.uniform(-3, 3, (n, 1)) * rng.dirichlet(np.full(8, 0.7), n) * (rng.random((n, 8)) < rng.uniform(0.2, 1.5, (n, 1)))
    x[n // 2 :: 3] = x[: len(x[n // 2 :: 3])] * np.exp(rng.normal(0, 0.05, x[n // 2 :: 3].shape))
    x[n // 2 + 1 :: 3] = x[: len(x[n // 2 + 1 :: 3])]
    return SCREENED.prepare(x)


def test_screen_never_passes_over_a_near_pair():
    cost, x = ot.uniform_cost(8), measures(600)
    s = ot.self_costs(x, cost, SCREENED)
    for i in range(0, 600, 3):
        d = ot.distances(np.broadcast_to(x[i], x.shape), x, np.full(len(x), s[i]), s, cost, SCREENED)
        assert (ot.screen(x[i : i + 1], x, SCREENED)[0] <= ot.screen_limit(d)).all()


def test_screened_neighbours_are_those_of_all_pairs(spark, monkeypatch):
    """Every pair was solved, which took a gigabyte's documents beyond their time (F3)."""
    cost, x = ot.uniform_cost(8), measures(400)
    rows = spark.createDataFrame([(i, [float(e) for e in r]) for i, r in enumerate(x)], "doc_id long, x array<double>")
    told = lambda found: sorted((r["query"], r["rank"], r["id"], round(r["distance"], 9)) for r in found.collect())
    every = told(neighbours.search(neighbours._prepared(rows, cost, SCREENED, "x", "doc_id"), F.col("id") % 7 == 0, 5, neighbours._transport(cost, SCREENED)))
    used, screened = [], neighbours._screened
    monkeypatch.setattr(neighbours, "_screened", lambda *a: (used.append(1), screened(*a))[1])
    assert told(neighbours.transport_neighbours(rows, F.col("id") % 7 == 0, cost, SCREENED, 5)) == every and used
    few = rows.where("doc_id < 4")
    assert len(told(neighbours.transport_neighbours(few, F.col("id") == 0, cost, SCREENED, 5))) == 3
    larger = rows.withColumn("x", F.transform("x", lambda e: e * 1000))
    used.clear()
    assert neighbours.transport_neighbours(larger, F.col("id") == 0, cost, SCREENED, 5).count() == 5 and not used


def test_compare_scores_reads_its_rows_once(spark, monkeypatch):
    """The rows were made anew for each side of the pairs (F1)."""
    settled, settle = [], comparison.settle
    monkeypatch.setattr(comparison, "settle", lambda df, label: (settled.append(label), settle(df, label))[1])
    cfg = config.Config(mode="sinkhorn_divergence", top_k=2)
    assert comparison.compare_scores(scores(spark), F.col("id") == 0, ot.uniform_cost(2), cfg, "lex_counts_per_1k_words").count() == 2
    assert settled == ["compare-rows"]
