"""What the registered queries leave out: tokenizer budgets, fuzzy blocks, costs by embedding, style, tuning, plans."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from moodweave import cli
from moodweave.config import Config
from moodweave.functions import text as tx
from moodweave.operators import chunking, clouds, comparison, lexicon, measures, neighbours, rollups
from moodweave.operators import transport as ot
from moodweave.storage import spread


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def word_tokenizer(path) -> str:
    """A tokenizer of words and marks with a given vocabulary."""
    vocab = {"[UNK]": 0, "hello": 1, ",": 2}
    body = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "Whitespace"}, "post_processor": None, "decoder": None, "model": {"type": "WordLevel", "vocab": vocab, "unk_token": "[UNK]"}}
    path.write_text(json.dumps(body))
    return str(path)


@pytest.mark.parametrize("stride", [0, 8])
def test_chunks_keep_a_tokenizers_budget(spark, tmp_path, stride):
    """The budget is of the tokenizer's tokens less the special ones, and new tokens add up to all of them."""
    file = word_tokenizer(tmp_path / "t.json")
    d = docs(spark, ["hello, " * 200, "a b, c\n\nd\n\n" + "e " * 40, "", None])
    out = chunking.pack_paragraphs(d, 32, stride, tokenizer=file).collect()
    one = sorted((r["chunk"], r["body_tokens"], r["new_body_tokens"], r["text"]) for r in out if r["doc_id"] == 0)
    assert all(n <= 30 for _, n, _, _ in one) and sum(fresh for _, _, fresh, _ in one) == 400
    assert one[0][3] == ("hello, " * 15).strip() and [c for c, *_ in one] == list(range(len(one)))
    two = [r["text"] for r in out if r["doc_id"] == 1]
    assert two[0] == "a b, c\n\nd" and {r["doc_id"] for r in out} == {0, 1}


def test_line_chunks_of_many_lines(spark):
    text = "\n".join(f"line {i}" for i in range(5000))
    got = docs(spark, [text, "", None]).select(tx.line_chunks(F.col("text"), 100).alias("c")).collect()
    assert "\n".join(got[0]["c"]) == text and max(map(len, got[0]["c"])) <= 100 and got[1]["c"] == [""] == got[2]["c"]
    done, held = [], None
    for line in text.split("\n"):
        if held is not None and len(held) + 1 + len(line) > 100:
            done, held = [*done, held], line
        else:
            held = line if held is None else f"{held}\n{line}"
    assert got[0]["c"] == [*done, held]


def test_blocks_are_found_by_their_middle(spark):
    block = " ".join(f"word{i}" for i in range(60))
    changed = "quite another start " + block[30:]
    rows = [(1, [block], "before " * 80 + changed + " after"), (2, [block], "before " * 80), (3, ["b", block], block + " b"), (4, [], None)]
    got = {r["i"]: r for r in chunking.blocks_in_order(spark.createDataFrame(rows, "i int, blocks array<string>, text string"), 0.9).collect()}
    assert got[1]["found"] and 0.9 <= got[1]["coverage"] < 1 and not got[2]["found"] and not got[3]["found"] and got[4]["found"]


def test_many_items_are_joined_as_few_are_looked_up(spark, monkeypatch):
    items = spark.createDataFrame([(1, "b c"), (2, "a B c d e f g h i j"), (3, "z"), (4, ""), (5, None)], "item_id long, text string")
    d = docs(spark, ["x a b  c\nd e f g h i j", "b c", "bc", None, "z z"])
    found = lambda: sorted(map(tuple, chunking.contained(items, d).collect()))
    few = found()
    monkeypatch.setattr(chunking, "FEW", 0)
    assert few == found() == [(1, 0), (1, 1), (2, 0), (3, 4)]


def test_clouds_by_embedding(spark):
    d = docs(spark, ["alpha alpha beta", "gamma beta", "delta", "nothing here"])
    vad = spark.createDataFrame([(t, 0.9, 0.6, 0.5, 1.0) for t in ("alpha", "beta", "gamma", "delta")], "term string, v double, a double, d double, conf double")
    vectors = spark.createDataFrame([("alpha", [1.0, 0.0]), ("beta", [0.9, 0.1]), ("gamma", [1.0, 0.1]), ("delta", [-1.0, 0.0])], "term string, vector array<float>")
    cfg = Config(drop_top_df=0, cost="embedding", top_k=2)
    got = {(r["query"], r["id"]): r["distance"] for r in comparison.compare_clouds(d, vad, F.col("id") == 0, cfg, vectors=vectors).collect()}
    assert got[0, 1] < got[0, 2] and set(got) == {(0, 1), (0, 2)}
    mixed = {r["id"]: r["distance"] for r in comparison.compare_clouds(d, vad, F.col("id") == 0, Config(drop_top_df=0, cost="embedding_vad", alpha=0.5, beta=0.5, top_k=2), vectors=vectors).collect()}
    assert mixed[1] < mixed[2]
    with pytest.raises(ValueError):
        comparison.selected_clouds(d, vad, cfg)
    x, y, c = np.array([[0.5, 0.5, 0.0, 1.0, 0.0]]), np.array([[-0.5, 0.5, 0.0, 0.0, 1.0]]), np.array([0.5])
    vad_only, near = ot.TermCost("vad")(x, y, c, c), ot.TermCost("embedding")(x, y, c, c)
    assert np.isclose(near[0, 0], 0.5) and np.isclose(vad_only[0, 0], 0.25 / (2 * 3**0.5) + 0.75)
    assert np.isclose(ot.TermCost("embedding_vad", 0.3, 0.7)(x, y, c, c)[0, 0], 0.3 * 0.5 + 0.7 * 0.25 / (2 * 3**0.5))


def test_weight_settings_choose_other_terms(spark):
    d = docs(spark, ["joy joy joy grief", "grief rage", "rage joy"])
    vad = spark.createDataFrame([(t, 0.9, 0.6, 0.5, 1.0) for t in ("joy", "grief", "rage")], "term string, v double, a double, d double, conf double")
    first = lambda **how: {r["doc_id"]: r["terms"][0] for r in comparison.selected_clouds(d, vad, Config(drop_top_df=0, **how.pop("cfg", {})), **how).collect()}
    assert first()[0] == "joy" and first(cfg={"weight": "tf"})[0] == "joy" and first(cfg={"weight": "uniform"})[0] == "joy"
    given = spark.createDataFrame([("grief", 1.0), ("joy", 0.1)], "term string, weight double")
    assert first(weights=given)[0] == "grief" and first(weights=given, cfg={"weight_mix": 0.0})[0] == "joy"


def test_style_distance(spark):
    rows = [(i, [float(3 * (i % 3 == k) + 1) * (i + 1) for k in range(3)], [float((i % 3 == k) + 1) / 4 for k in range(3)], 100) for i in range(9)]
    scores = spark.createDataFrame(rows, "doc_id long, lex_counts array<double>, pred_dist array<double>, n_words int")
    assert comparison.style_measure(scores) == "pred_dist" and measures.mass_of(scores, "lex_prior") == "lex_counts_per_1k_words"
    out = comparison.compare_scores(scores, F.col("id") == 0, ot.uniform_cost(3), Config(top_k=8), "lex_counts_per_1k_words", "pred_dist").collect()
    near = {r["id"]: r["style_distance"] for r in out}
    assert len(near) == 8 and abs(near[3]) < 1e-9 and abs(near[6]) < 1e-9 and near[1] > 1e-3


def test_tuner_restarts_until_the_limits_are_met():
    evaluate = lambda s: {"score": 1.0 if s["x"] == 0.9 else 0.1 - abs(s["x"] - 0.2)}
    steps, limits = {"x": (0.1, 0.0, 1.0)}, {"score": 0.9}
    stuck, _ = comparison.tune(evaluate, {"x": 0.1}, steps, limits)
    best, stats = comparison.tune(evaluate, {"x": 0.1}, steps, limits, restarts=40)
    assert stuck["x"] == 0.2 and best["x"] == 0.9 and stats["score"] == 1.0


def test_guardrails_are_tuned_on_a_comparison(spark):
    d = docs(spark, ["happy glad day", "sad grim day", "happy day", "sad day"])
    vad = spark.createDataFrame([("happy", 0.9, 0.6, 0.5, 1.0), ("glad", 0.6, 0.5, 0.5, 1.0), ("sad", -0.9, 0.5, 0.2, 1.0), ("grim", -0.7, 0.5, 0.2, 1.0), ("day", 0.38, 0.1, 0.1, 1.0)], "term string, v double, a double, d double, conf double")
    kinds = spark.createDataFrame([(0, "x"), (1, "y"), (2, "x"), (3, "y")], "doc_id long, kind string")
    stats = comparison.guardrails(d, vad, Config(drop_top_df=0), kinds, F.lit(True))
    assert stats["zero_share"] == 0 and stats["score"] == 1.0 and stats["coverage"] == 0.6
    cfg, tuned = comparison.tune_guardrails(d, vad, {"coverage": 0.9}, Config(drop_top_df=0), rounds=5, restarts=0)
    assert cfg.vad_threshold < 0.45 and tuned["coverage"] == 1.0


def test_distance_rows_are_symmetric_for_divergences(spark):
    rows = spark.createDataFrame([(i, [float(1 + (i * k) % 5) for k in range(1, 5)]) for i in range(6)], "doc_id long, x array<double>")
    got = {(r["query"], r["id"]): r["distance"] for r in neighbours.distance_rows(rows, F.lit(True), ot.uniform_cost(4), ot.Solver("unbalanced_divergence", 0.1, 200, 0.5)).collect()}
    assert len(got) == 36 and all(got[i, i] == 0 for i in range(6)) and all(abs(got[i, j] - got[j, i]) < 1e-9 for i in range(6) for j in range(6))
    plain = {(r["query"], r["id"]): r["distance"] for r in neighbours.distance_rows(rows, F.col("id") < 2, ot.uniform_cost(4), ot.Solver("sinkhorn")).collect()}
    assert len(plain) == 12 and plain[0, 0] > 0


def test_both_directions_of_a_divergence_are_solved_as_one_batch(monkeypatch):
    s, c, calls = ot.Solver("unbalanced_divergence", 0.1, 30, 0.5), ot.uniform_cost(4), []
    a, b = np.random.default_rng(5).uniform(0, 10, (2, 3000, 4))
    own = [ot.self_costs(x, c, s) for x in (a, b)]
    want = (ot.costs(a, b, c, s) + ot.costs(b, a, c, s)) / 2 - own[0] / 2 - own[1] / 2
    scalings = ot._scalings
    monkeypatch.setattr(ot, "_scalings", lambda *args: calls.append(len(args[0])) or scalings(*args))
    assert np.allclose(ot.distances(a, b, *own, c, s), want, rtol=0, atol=1e-13) and sum(calls) == 6000 and max(calls) <= ot.SHARED_PAIRS
    calls.clear()
    ot.distances(a[:5], b[:5], own[0][:5], own[1][:5], c, s)
    assert calls == [10]


def test_distance_rows_are_not_stored_before_they_are_read(spark, monkeypatch):
    """Every row of the matrix was written to the shared folder, read and written again."""
    stored, settle = [], neighbours.settle
    monkeypatch.setattr(neighbours, "settle", lambda df, label: (stored.append(label), settle(df, label))[1])
    monkeypatch.setattr(neighbours, "BLOCK", 3)
    rows = spark.createDataFrame([(i, [float(1 + (i * k) % 5) for k in range(1, 5)]) for i in range(12)], "doc_id long, x array<double>")
    s = ot.Solver("unbalanced_divergence", 0.1, 30, 0.5)
    got = {(r["query"], r["id"]): r["distance"] for r in neighbours.distance_rows(rows, F.col("id") % 2 == 0, ot.uniform_cost(4), s).collect()}
    assert set(got) == {(i, j) for i in range(0, 12, 2) for j in range(12)} and "search-found" not in stored
    x = np.array([[float(1 + (i * k) % 5) for k in range(1, 5)] for i in range(12)])
    for (i, j), d in got.items():
        want = ot.costs(x[[i, j]], x[[j, i]], ot.uniform_cost(4), s).mean() - ot.self_costs(x[[i, j]], ot.uniform_cost(4), s).mean()
        assert abs(d - (0 if i == j else want)) < 1e-12


def test_searches_by_blocks_of_queries(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 7 + 1), float(i % 11), 1.0]) for i in range(200)], "vec_id long, embedding array<double>")
    ask = lambda: sorted(map(tuple, neighbours.cosine_neighbours(rows, F.col("id") % 3 == 0, 4).collect()))
    whole = ask()
    monkeypatch.setattr(neighbours, "BLOCK", 10)
    monkeypatch.setattr(neighbours, "BATCH", 7)
    assert ask() == whole and len(whole) == 67 * 4


def test_medians_of_even_groups_and_nulls(spark):
    rows = spark.createDataFrame([("p", "a", x) for x in (4.0, 1.0, 1.0, 2.0, None)] + [("p", "b", 9.0), ("q", "b", None)], "period string, kind string, value double")
    got = {(r["period"], r["kind"]): (r["n"], r["mean"], r["median"]) for r in rollups.by_period_and_type(rows, "period", "kind", "value").collect()}
    assert got["p", "a"] == (5, 2.0, 1.5) and got["p", "ALL"] == (6, 3.4, 2.0) and got["q", "b"] == (1, None, None)


def test_settings_and_sources_of_lexicons(spark):
    a = spark.createDataFrame([("Joy", "joy", 0.5, 0.5, 0.5)], "term string, emotion string, v double, a double, d double")
    b = spark.createDataFrame([("joy", "joy", 0.1, 0.1, 0.1, True), ("new", "joy", 0.2, 0.2, 0.2, True)], "term string, emotion string, v double, a double, d double, is_prototype boolean")
    assert {(r["term"], r["v"]) for r in lexicon.concat_sources([a, b]).collect()} == {("joy", 0.5), ("new", 0.2)}
    assert {(r["term"], r["v"]) for r in lexicon.concat_sources([b, a]).collect()} == {("joy", 0.5), ("new", 0.2)}


def test_commands_take_texts_in_normal_form(spark, tmp_path):
    (tmp_path / "a.txt").write_text("ｒｅｇｒｅｔ and hope")
    assert cli._texts(spark, f"file://{tmp_path}").first()["text"] == "regret and hope"


def test_only_small_tables_of_few_files_are_spread(spark, tmp_path, monkeypatch):
    from moodweave import storage

    spark.range(20_000).withColumn("t", F.sha2(F.col("id").cast("string"), 256)).coalesce(1).write.parquet(f"{tmp_path}/one")
    one = spark.read.parquet(f"{tmp_path}/one")
    assert spread(one) is one  # below the least size
    monkeypatch.setattr(storage, "LEAST_SPREAD", 1000)
    assert spread(one) is not one and spread(one).count() == 20_000
    monkeypatch.setattr(storage, "MOST_SPREAD", 1000)
    assert spread(one) is one


def test_exact_distance_to_the_mean(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0, 1.0]), (2, [0.0, 2.0, 0.0])], "doc_id long, x array<double>")
    got = {r["doc_id"]: r["emd"] for r in neighbours.exact_to_mean(rows, ot.uniform_cost(3)).collect()}
    assert np.isclose(got[1], 0.5, atol=1e-6) and np.isclose(got[2], 0.5, atol=1e-6)
    assert clouds.term_costs(spark.createDataFrame([], "term string, v double, a double, d double, conf double"), None, ot.TermCost()).count() == 0
