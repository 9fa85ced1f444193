"""The engine's operators on small tables, against plain Python."""

from __future__ import annotations

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from moodweave import config
from moodweave.functions import text as tx
from moodweave.functions import vectors as vx
from moodweave.operators import adjudication, chunking, clouds, features, lexicon, measures, metrics, neighbours, rollups, sampling
from moodweave.operators import transport as ot
from moodweave.sources import readers, sinks
from moodweave.streaming import live


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# --- text


def test_tokens(spark):
    rows = docs(spark, ["Don’t stop—the well–known café's O'Brien 3x", None, "", "A_b ÀÉ"]).select(tx.tokens(F.col("text")).alias("t")).collect()
    assert [r["t"] for r in rows] == [["don't", "stop-the", "well-known", "café's", "o'brien", "x"], [], [], ["a", "b", "àé"]]


def test_unicode_forms(spark):
    r = one(spark, a=tx.nfkc(F.lit("ﬁne Ⅷ")), b=tx.strip_diacritics(F.lit("Élan ça")), c=tx.nfkc(F.lit(None).cast("string")))
    assert (r["a"], r["b"], r["c"]) == ("fine VIII", "Elan ca", None)


@pytest.mark.parametrize(("line", "caps", "number", "label", "toc"), [("INTERNATIONAL COURT", True, False, False, False), ("xiv", False, True, False, False), (" 12 ", False, True, False, True), ("Page 3", False, False, True, True), ("Merits ..... 45", False, False, False, True), ("Plain words here", False, False, False, False), ("1. Intro", False, False, False, True)])
def test_line_predicates(spark, line, caps, number, label, toc):
    c = F.lit(line)
    assert tuple(one(spark, a=tx.is_caps(c), b=tx.is_page_number(c), c=tx.is_page_label(c), d=tx.is_toc_like(c))) == (caps, number, label, toc)


def test_paragraphs_and_windows(spark):
    r = one(spark, p=tx.paragraphs(F.lit("a b\n\n  \nc\n\n")), q=tx.paragraphs(F.lit("")), w=tx.windows(F.array(*[F.lit(str(i)) for i in range(10)]), 4, 1), s=tx.windows(F.array(F.lit("x")), 4, 1))
    assert r["p"] == ["a b", "c"] and r["q"] == [""]
    assert [x["start"] for x in r["w"]] == [0, 3, 6] and r["w"][-1]["words"] == ["6", "7", "8", "9"] and len(r["s"]) == 1


def test_phrases_snippets_lemmas(spark):
    stripped, hits = tx.strip_phrases(F.lit("All  rights reserved. of THE law"), ["of the", "all rights reserved"])
    r = one(spark, t=stripped, h=hits, s=tx.snippet(F.array(*map(F.lit, "abcdef")), F.lit(1), 2))
    assert r["h"] == 2 and "rights" not in r["t"] and r["s"] == "a b c d"
    words = {"cities": "city", "hoped": "hope", "stopped": "stop", "better": "good", "happiness": "happi", "is": None}
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", tx.lemma_candidates(F.col("w")).alias("c")).collect()
    for r in got:
        assert (words[r["w"]] in r["c"]) if words[r["w"]] else r["c"] == []


def test_json_and_numbered_lines(spark):
    r = one(spark, a=tx.outermost_json(F.lit('x ```json\n{"a": 1}\n``` y')), b=tx.outermost_json(F.lit('say {"b": [1]} ok')), c=tx.outermost_json(F.lit("none")), d=tx.numbered_lines(F.lit("x\ny")))
    assert json.loads(r["a"]) == {"a": 1} and json.loads(r["b"]) == {"b": [1]} and r["c"] is None and r["d"] == ["00001|x", "00002|y"]


# --- vectors, measures


def test_vector_functions(spark):
    a = lambda *x: F.array(*map(F.lit, x))
    r = one(spark, e=vx.entropy(a(0.5, 0.5)), z=vx.normalise(a(0.0, 0.0)), k=vx.per_thousand(a(10.0, 0.0), F.lit(2000)), n=vx.noisy_or(a(0.5, 0.5)), u=vx.rescale_vad(F.lit(0.25), "zero_one"), v=vx.rescale_vad(F.lit(9.0), "one_nine"), s=vx.salience(F.lit(-0.7), F.lit(0.2)), al=vx.align(a(1.0, 2.0), a("b", "a"), ["a", "b"]))
    assert math.isclose(r["e"], 1) and r["z"] == [0.5, 0.5] and r["k"] == [5.0, 0.0] and r["n"] == 0.75 and (r["u"], r["v"], r["s"]) == (-0.5, 1.0, 0.7) and r["al"] == [2.0, 1.0]
    with pytest.raises(Exception, match="emotion names differ"):
        one(spark, x=vx.align(a(1.0), a("b"), ["a"]))


def test_blend_without_hits_keeps_the_guess(spark):
    a = lambda *x: F.array(*map(F.lit, x))
    r = one(spark, none=vx.blend(a(3.0, 1.0), a(0.0, 0.0), a(0.5, 0.5), F.lit(100), 20.0), some=vx.blend(a(3.0, 1.0), a(0.0, 2.0), a(0.0, 1.0), F.lit(100), 20.0))
    assert r["none"]["counts"] == [3.0, 1.0] and r["none"]["strength"] == 0
    assert math.isclose(r["some"]["strength"], 0.5) and np.allclose(r["some"]["counts"], [1.125, 1.875])


def test_filters_and_gate(spark):
    rows = spark.createDataFrame([(1, 5, None, 3.0), (2, 50, True, 3.0), (3, 50, None, 0.1), (4, 50, False, 0.1), (5, 50, None, 2.0)], "id int, n_words int, low_emotion_signal boolean, emotion_signal_per_1k_words double")
    got = {r["id"]: r["reason"] for r in measures.low_signal_reason(rows, 10, 1.0).collect()}
    assert got == {1: "few_words", 2: "flagged", 3: "low_signal", 4: None, 5: None}
    assert measures.choose_measure(spark.createDataFrame([([1.0], 3)], "lex_counts array<double>, n_words int"), True) == "lex_counts_per_1k_words"


def test_label_masks(spark):
    a = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    r = one(spark, a=measures.label_mask(["x", "y"], a("x"), a(), F.lit(False)), b=measures.label_mask(["x", "y"], a("x"), a("y"), F.lit(None).cast("boolean")), c=measures.label_mask(["x", "y"], a(), a(), F.lit(True)))
    assert (r["a"], r["b"], r["c"]) == ([1, 0], [1, 1], [1, 1])


# --- lexicon


def test_negation_scope(spark):
    words = "this is not good but fine and not only nice or n't".split()
    t = spark.createDataFrame([(1, i, w) for i, w in enumerate(words)], "doc_id long, pos int, term string")
    from pyspark.sql import Window

    t = t.withColumn("next", F.lead("term").over(Window.partitionBy("doc_id").orderBy("pos")))
    m = features.negated(t, features.is_negator(F.col("term"), F.col("next")), F.col("term").isin(*features.BOUNDARIES), 3)
    assert [r["pos"] for r in m.where("negated").orderBy("pos").collect()] == [3]


def test_negation_inside_rows_equals_the_window_form(spark):
    r = random.Random(7)
    rows = [(i, [r.choice(["not", "never", "but", "a", "b", "c"]) for _ in range(r.randrange(30))]) for i in range(80)]
    d = spark.createDataFrame(rows, "doc_id long, w array<string>")
    t = d.select("doc_id", F.posexplode("w").alias("pos", "term"))
    for window in (1, 3, 5):
        m = features.negated(t, F.col("term").isin("not", "never"), F.col("term") == "but", window)
        want = {(x["doc_id"], x["pos"]) for x in m.where("negated").collect()}
        got = d.select("doc_id", F.explode(features.negated_places(F.col("w"), ["not", "never"], ["but"], window)).alias("pos")).collect()
        assert {(x["doc_id"], x["pos"]) for x in got} == want


def test_longest_matches(spark):
    d = spark.createDataFrame([(1, "not very happy man happy".split()), (2, None)], "doc_id long, tokens array<string>")
    got = features.longest_matches(d, {"happy": "joy", "very happy": "joy", "not very happy": "sadness"}, ("not",), 2).collect()
    assert [(r["start"], r["phrase"], r["negated"]) for r in got] == [(0, "not very happy", False), (4, "happy", False)]
    got = features.longest_matches(d, {"happy": "joy", "very happy": "joy"}, ("not",), 2).collect()
    assert [(r["start"], r["n_words"], r["negated"]) for r in got] == [(1, 2, True), (4, 1, False)]


def test_shared_terms_split_their_weight(spark):
    t = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "doc_id long, term string")
    lex = spark.createDataFrame([("a", 0, 2), ("a", 1, 2), ("b", 1, 1)], "term string, emotion int, shared int")
    got = {r["emotion"]: (r["count"], r["hits"]) for r in features.emotion_counts(t, lex).collect()}
    assert got == {0: (1.0, 2), 1: (2.0, 3)}


def test_seed_prototypes_and_merge(spark):
    p = {r["emotion"]: r for r in lexicon.prototypes(lexicon.seed_table(spark)).collect()}
    assert len(p) == 9 and math.isclose(p["fear"]["v"], -0.6)
    base = spark.createDataFrame([("x", 0.1, 0.1, 0.1, 0.5), ("y", 0.2, 0.2, 0.2, 1.0)], "term string, v double, a double, d double, conf double")
    imp = spark.createDataFrame([("x", 0.9, 0.9, 0.9, 0.8), ("y", 0.9, 0.9, 0.9, 0.8), ("z", 0.3, 0.3, 0.3, 0.1)], base.schema)
    assert {r["term"]: r["v"] for r in lexicon.merge_imputed(base, imp).collect()} == {"x": 0.9, "y": 0.2, "z": 0.3}


@pytest.mark.parametrize(("values", "mode"), [([0.1, 0.9, 0.5], "zero_one"), ([1.0, 9.0, 5.0], "one_nine"), ([-0.5, 0.5, 0.0], "signed"), ([0.9, 1.0, 0.95], "signed")])
def test_scales(spark, values, mode):
    rows = spark.createDataFrame([tuple(values)], "v double, a double, d double")
    assert lexicon.scale_of(rows).first()["mode"] == mode


# --- transport


def plain_plan(a, b, c, s):
    k = np.exp(-c / s.epsilon)
    u, v, t = np.ones(len(a)), np.ones(len(b)), s.reg_m / (s.reg_m + s.epsilon) if s.unbalanced else 1
    for _ in range(s.iterations):
        u = (a / (k @ v)) ** t
        v = (b / (k.T @ u)) ** t
    return u[:, None] * k * v[None]


@pytest.mark.parametrize("mode", ["sinkhorn", "sinkhorn_divergence", "unbalanced", "unbalanced_divergence"])
def test_plans_match_scaling(mode):
    rng = np.random.RandomState(0)
    s = ot.Solver(mode, 0.3, 40, 0.5)
    a, b = s.prepare(rng.rand(5, 6)), s.prepare(rng.rand(5, 6))
    c = ot.vad_cost(rng.rand(6, 3))
    want = [plain_plan(x, y, c, s) for x, y in zip(a, b, strict=True)]
    assert np.allclose(ot.plan(a, b, c, s), want)
    assert np.allclose(ot.plan(a, b, np.broadcast_to(c, (5, 6, 6)), s), want)  # in logarithms
    assert np.allclose(ot.costs(a, b, c, s), ot.parts(a, b, np.broadcast_to(c, (5, 6, 6)), s)["cost"])


def test_balanced_marginals_and_divergence():
    s = ot.Solver("sinkhorn", 0.1, 200)
    a, b = np.array([[0.2, 0.3, 0.5]]), np.array([[0.5, 0.2, 0.3]])
    p = ot.plan(a, b, ot.uniform_cost(3), s)
    assert np.allclose(p.sum(2), a, atol=5e-3) and np.allclose(p.sum(1), b, atol=5e-3)
    d = ot.Solver("unbalanced_divergence", 0.1, 50, 0.5)
    c, x = ot.uniform_cost(3), d.prepare(a)
    own = ot.self_costs(x, c, d)
    assert abs(ot.distances(x, x, own, own, c, d)[0]) < 1e-6
    assert ot.distances(x, 3 * x, own, ot.self_costs(3 * x, c, d), c, d)[0] > 1e-4
    with pytest.raises(ValueError):
        ot.Solver("emd")


def test_costs_and_flows():
    c = ot.vad_cost(np.array([[0, 0, 0], [1, 0, 0], [0, 2, 0.0]]))
    assert np.allclose(np.diag(c), 0) and math.isclose(c[~np.eye(3, dtype=bool)].mean(), 1)
    assert np.allclose(ot.cosine_cost(np.eye(2), np.eye(2)), [[0, 0.5], [0.5, 0]])
    assert np.allclose(ot.term_vad_cost(np.zeros((1, 3)), np.ones((1, 3)), np.ones(1), np.zeros(1), 1.0), 1)
    f = ot.top_flows(np.array([[5.0, 1], [2, 5]]), np.array([[0.0, 1], [1, 0]]), 3)
    assert [(i, j) for i, j, *_ in f] == [(1, 0), (0, 1)]


def test_neighbours(spark):
    x = {0: [1.0, 0.0, 0.0], 1: [0.0, 1.0, 0.0], 2: [0.5, 0.5, 0.0], 3: None}
    rows = spark.createDataFrame([(k, v) for k, v in x.items()], "doc_id long, x array<double>")
    got = neighbours.transport_neighbours(rows.where("x is not null"), F.col("id") == 0, ot.uniform_cost(3), ot.Solver("sinkhorn_divergence"), 2).orderBy("rank").collect()
    assert [r["id"] for r in got] == [2, 1] and got[0]["distance"] < got[1]["distance"]
    got = neighbours.cosine_neighbours(rows, F.lit(True), 1, "doc_id", "x").collect()
    assert {(r["query"], r["id"]) for r in got} == {(0, 2), (1, 2), (2, 0)}


def test_token_clouds(spark):
    d = docs(spark, ["happy happy", "happy", "sad sad"])
    vad = spark.createDataFrame([("happy", 0.9, 0.5, 0.5, 1.0), ("sad", -0.8, 0.3, 0.2, 1.0)], "term string, v double, a double, d double, conf double")
    c = clouds.build_clouds(clouds.weighted_terms(d, 3, 10), vad)
    pairs = spark.createDataFrame([(0, 1), (0, 2)], "i long, j long")
    got = {r["j"]: r for r in clouds.compare_pairs(pairs, c).collect()}
    assert got[1]["distance"] < got[2]["distance"] and got[2]["flows"][0]["from"] == "happy"
    df = spark.createDataFrame([("a", 3), ("b", 1)], "term string, df long")
    assert [r["term"] for r in clouds.frequent_terms(df, 1).collect()] == ["a"] and clouds.frequent_terms(df, 2).count() == 0


# --- roll-ups, metrics, samples


def test_rollup_numbers_and_tertiles(spark):
    rows = spark.createDataFrame([("2020", "a", 1.0), ("2020", "b", 3.0), ("2021", "a", 5.0), (None, "a", 1.0)], "year string, kind string, value double")
    got = {(r["year"], r["kind"]): (r["n"], r["mean"]) for r in rollups.by_period_and_type(rows, "year", "kind", "value").collect()}
    assert got == {("2020", "a"): (1, 1.0), ("2020", "b"): (1, 3.0), ("2020", "ALL"): (2, 2.0), ("2021", "a"): (1, 5.0), ("2021", "ALL"): (1, 5.0)}
    r = spark.range(1000).repartition(7)
    assert rollups.numbered(r, F.desc("id")).where("row <> 1000 - id").count() == 0
    assert {x["tertile"]: x["count"] for x in rollups.tertiles(spark.range(10), F.col("id")).groupBy("tertile").count().collect()} == {"low": 3, "mid": 3, "high": 4}
    even = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    assert even.agg(rollups.upper_median("x")).first()[0] == 3.0


def test_metrics(spark):
    r = random.Random(2)
    rows = [(r.randrange(2), r.randrange(2), r.randrange(4)) for _ in range(200)]
    df = spark.createDataFrame(rows, "g int, p int, s int")
    for x in metrics.per_class(df, F.col("g"), F.col("p")).collect():
        tp = sum(g == p == x["class"] for g, p, _ in rows)
        assert math.isclose(x["f1"], 2 * tp / (sum(g == x["class"] for g, _, _ in rows) + sum(p == x["class"] for _, p, _ in rows)))
    pos, neg = [s for g, _, s in rows if g], [s for g, _, s in rows if not g]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    got = metrics.auc(df.withColumn("k", F.lit(1)), "k", "s", F.col("g") == 1).first()
    assert math.isclose(got["auc"], want) and got["n"] == 200


def test_splits_and_samples(spark):
    rows = spark.createDataFrame([(i, i // 3) for i in range(30)], "id long, g long")
    s = sampling.split_groups(rows, "g", 0.25, "x")
    assert s.where("split = 'dev'").count() == 2 and s.count() == 10
    assert sampling.held_out_size(1, 0.5) == 0 and sampling.held_out_size(5, 0.01) == 1 and sampling.held_out_size(5, 0.99) == 4
    t = sampling.stratified(rows, "id", "g", 1, 4, "x")
    assert t.count() == 14 and t.select("id").distinct().count() == 14


def test_adjudication(spark):
    lines = [json.dumps({"AGREE": {"file": "./a", "scores": {"joy": 30.0}}}), "nonsense", json.dumps({"AGREE": {"file": "a"}, "ERROR": {"file": "a"}}), json.dumps({"DISAGREE": {"file": "a", "scores": {"joy": 2.0}}})]
    log = adjudication.parse_log(spark.createDataFrame(list(enumerate(lines)), "line int, value string"))
    assert [r["invalid"] for r in log.orderBy("line").collect()] == [None, "not_json", "no_decision", None]
    last = adjudication.latest(log.where("invalid is null").select("line", "file", "decision"), "file", F.col("line")).collect()
    assert [(r["file"], r["decision"]) for r in last] == [("a", "DISAGREE")]
    full, clamped = adjudication.valid_scores(F.create_map(F.lit("joy"), F.lit(30.0)), ["joy"])
    assert tuple(one(spark, f=full, c=clamped)) == (True, {"joy": 20.0})
    got = adjudication.merge_ranges(spark.createDataFrame([("k", 1, 3), ("k", 4, 6), ("k", 8, 9), ("j", 2, 2)], "k string, start int, end int"), "k").collect()
    assert sorted((r["k"], r["start"], r["end"], r["n"]) for r in got) == [("j", 2, 2, 1), ("k", 1, 6, 2), ("k", 8, 9, 1)]


# --- chunks, containment


def test_boilerplate(spark):
    body = ["INTERNATIONAL COURT OF JUSTICE", "Table of contents", "Facts ..... 3", "", "Law ..... 9", "", "", "The Court finds", "12", "Page 4", "", "that it holds."] + ["word line"] * 80 + ["RUNNING HEADER LINE"] * 3 + ["RARE CAPITAL LINE HERE"]
    out = chunking.strip_boilerplate(docs(spark, ["\n".join(body), None])).orderBy("doc_id").collect()
    assert out[0]["text"].split("\n") == ["", "", "", "The Court finds", "", "that it holds."] + ["word line"] * 80 + ["RARE CAPITAL LINE HERE"] and out[1]["text"] == ""


@pytest.mark.parametrize("stride", [0, 8])
def test_chunks_count_every_word_once(spark, stride):
    texts = ["hello " * 200, "a b c\n\nd e\n\n" + "x " * 40 + "\n\nlast", "", None]
    got = chunking.pack_paragraphs(docs(spark, texts), 32, stride).collect()
    for i, t in enumerate(texts):
        assert sum(r["new_body_tokens"] for r in got if r["doc_id"] == i) == len((t or "").split())
    assert all(r["body_tokens"] <= 32 for r in got)


def test_containment(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine"), (2, "short bit"), (3, "absent words"), (4, " ")], "item_id long, text string")
    d = docs(spark, ["zero One two  three four five six\nseven eight nine ten", "a short bit here", "ashort bit", "one two three four five six seven eight ten nine", None])
    assert sorted(map(tuple, chunking.contained(items, d).collect())) == [(1, 0), (2, 1)]
    pairs = spark.createDataFrame([(["alpha beta", "gamma delta"], "x alpha beta y gamma delta"), (["gamma delta", "alpha beta"], "x alpha beta y gamma delta"), (["alpha betta gamma"], "alpha beta gamma")], "blocks array<string>, text string")
    got = chunking.blocks_in_order(pairs, 0.9).collect()
    assert [r["found"] for r in got] == [True, False, True]


# --- sources, streaming, settings


def test_readers(spark, tmp_path):
    (tmp_path / "vad.tsv").write_text("word\tvalence\tarousal\tdominance\nneg\t.25\t.75\t.5\nneg\t0\t.5\t.5\na battery\t1\t.5\t.5\n")
    got = {r["term"]: (r["v"], r["a"], r["d"]) for r in readers.word_vad(spark, str(tmp_path / "vad.tsv")).collect()}
    assert got == {"neg": (-1.0, 0.0, 0.0), "a battery": (1.0, 0.0, 0.0)}
    (tmp_path / "emo.tsv").write_text("neg\tfear\t1\nnew\tfear\t1\nno\tjoy\t0\nlost\tlove\t1\n")
    protos = spark.createDataFrame([("fear", -0.6, 0.6, 0.4)], "emotion string, v double, a double, d double")
    emo = readers.emotion_associations(spark, str(tmp_path / "emo.tsv"), readers.word_vad(spark, str(tmp_path / "vad.tsv")), protos)
    assert {(r["term"], r["v"], r["is_prototype"]) for r in emo.collect()} == {("neg", -1.0, False), ("new", -0.6, True)}
    (tmp_path / "lex.json").write_text(json.dumps({"joy": [["Not happy", [0.8, 0.4, 0.5]]], "__meta__": {"vad_scale": "zero_one"}}))
    r = readers.json_lexicon(spark, str(tmp_path / "lex.json")).first()
    assert (r["term"], r["emotion"]) == ("not happy", "joy") and math.isclose(r["v"], 0.6)
    (tmp_path / "stop.txt").write_text("# comment\n\nThe\nnot  happy\nthe\n")
    assert {(r["term"], r["n_tok"]) for r in readers.stop_list(spark, str(tmp_path / "stop.txt")).collect()} == {("the", 1), ("not happy", 2)}
    for body in ({"weights": {"a": 1, "b": 2.5}}, [["a", 1], ["b", 2.5]], [{"term": "a", "weight": 1}, {"word": "b", "score": 2.5}]):
        (tmp_path / "w.json").write_text(json.dumps(body))
        assert {(r["term"], r["weight"]) for r in readers.weight_payload(spark, str(tmp_path / "w.json")).collect()} == {("a", 1.0), ("b", 2.5)}
    (tmp_path / "imp.json").write_text(json.dumps({"terms": [{"term": "a", "vad": [1, 0, 0]}]}))
    assert readers.imputed_vad(spark, str(tmp_path / "imp.json")).first()["conf"] == 0.0
    (tmp_path / "i.tsv").write_text("a\tjoy\t0.2\na\tjoy\t0.7\nbad line\n")
    assert [r["score"] for r in readers.intensities(spark, str(tmp_path / "i.tsv")).collect()] == [0.7]
    (tmp_path / "s.csv").write_text('Sentence,Party,Sentiment,Overall Sentiment\n"Good, fine",x,y,1\n,x,y,1\nBad,x,y,7\nWorse,x,y,-1\n')
    assert {(r["text"], r["label"]) for r in readers.labelled_sentences(spark, str(tmp_path / "s.csv")).collect()} == {("Good, fine", 2), ("Worse", 0)}
    (tmp_path / "r.jsonl").write_text('{"a": 1}\nnot json\n\n{"a": 2}\n')
    assert readers.json_lines(spark, str(tmp_path / "r.jsonl"), "a int", tolerant=True).count() == 2


def test_text_folder(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "ICJ_001_X_1949-04-09.txt").write_text("INTERNATIONAL COURT\nHeld.\n7")
    (tmp_path / "d" / "e" / "plain.TXT").write_text("KEPT CAPITAL LINE")
    (tmp_path / "d" / "skip.md").write_text("no")
    got = {r["stem"]: r["text"] for r in readers.text_folder(spark, str(tmp_path / "d")).collect()}
    assert got == {"ICJ_001_X_1949-04-09": "Held.", "plain": "KEPT CAPITAL LINE"}


def test_stage_is_skipped_when_parameters_agree(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for p in ({"k": 1}, {"k": 1}, {"k": 2}):
        assert sinks.stage(spark, str(tmp_path / "t"), p, make).count() == 3
    assert len(made) == 2


def test_documents_and_reports(spark, tmp_path):
    sinks.json_document(spark, str(tmp_path / "a.json"), {"é": [1]})
    sinks.json_document(spark, str(tmp_path / "a.json"), {"é": [2]})
    sinks.yaml_document(spark, str(tmp_path / "a.yaml"), {"b": 1})
    sinks.html_report(docs(spark, ["</script>x"]), str(tmp_path / "a.html"), "<Report>")
    assert json.loads((tmp_path / "a.json").read_text()) == {"é": [2]} and (tmp_path / "a.yaml").read_text() == "b: 1\n"
    page = (tmp_path / "a.html").read_text()
    assert "</script>x" not in page and "&lt;Report>" in page
    sinks.json_lines(docs(spark, ["é"]), str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).first()["text"] == "é"


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "2024-01-01 01:00:00", 1.0, "a"), (1, "2024-01-01 01:00:00", 1.0, "a"), (2, "2024-01-01 02:00:00", 3.0, "a")], "event_id long, ts string, value double, event_type string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, ts timestamp, value double, event_type string").parquet(str(tmp_path / "in"))
    q = live.windowed_signal(stream).writeStream.outputMode("complete").format("memory").queryName("signals").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["n"], r["mean"]) for r in spark.table("signals").collect()] == [(2, 2.0)]
    lex = spark.createDataFrame([("joy",)], "term string")
    assert live.score_stream(docs(spark, ["joy and joy"]), lex, "doc_id").first()["lex_hits"] == 2


def test_settings(tmp_path):
    assert config.load({"epsilon": "0.2", "low_signal_filter": "yes", "top_k": "7", "unknown": 1, "mode": None}) == config.Config(epsilon=0.2, low_signal_filter=True, top_k=7)
    (tmp_path / "c.yaml").write_text("iterations: 5\n")
    assert config.load(str(tmp_path / "c.yaml")).solver().iterations == 5
