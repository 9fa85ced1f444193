"""Registered queries against their SQL on a small scale, if the driver's tables are there."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from moodweave.functions import text as tx

SF = os.environ.get("MOODWEAVE_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def told(value) -> str:
    if value is None or value != value or str(value) in ("NaT", "<NA>"):
        return "null"
    return f"{value + 0.0:.6f}" if isinstance(value, float) else str(value).lower()


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, name):
    mine = entry.queries()[name](spark, SF).toPandas()
    theirs = duck.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(mine.columns) == sorted(theirs.columns)
    columns = sorted(mine.columns)
    for df in (mine, theirs):
        for c in columns:
            if str(df[c].dtype).startswith("datetime"):
                df[c] = df[c].astype("datetime64[us]").astype(str)
    mine, theirs = (d[columns].astype({c: float for c in columns if "float64" in (str(mine[c].dtype), str(theirs[c].dtype))}) for d in (mine, theirs))
    rows = lambda d: sorted(tuple(told(v) for v in r) for r in d.itertuples(index=False))
    assert rows(mine) == rows(theirs)


def test_truncated_texts_keep_their_anchor(spark, tmp_path):
    """The pattern asked for a backslash, so no snippet was ever kept between head and tail."""
    texts = ["a " * 400 + "you idiot there " + "b " * 400, "a " * 400 + "idiotic " + "b " * 400, "short idiot"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    left = {r["doc_id"]: r["n_left"] for r in entry.queries()["text_truncated"](spark, str(tmp_path)).collect()}
    assert left[0] >= left[1] + len("idiot") and left[2] == len(texts[2])
    made = {r["doc_id"]: r["t"] for r in spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", tx.truncate(F.col("text"), 1000, 300, 300, (r"\bidiot\b",), 40).alias("t")).collect()}
    at = texts[0].index("idiot")
    assert made[0].startswith(texts[0][:300]) and made[0].endswith(texts[0][-300:]) and texts[0][at - 10 : at + 15] in made[0]
    assert {i: len(t) for i, t in made.items()} == left


def test_group_distance_keeps_the_default_number_of_terms(spark, monkeypatch):
    """The groups' clouds were cut to 64 of their lexicon terms."""
    from moodweave.config import Config
    from moodweave.operators import comparison

    asked, whole = [], comparison.group_shift
    monkeypatch.setattr(comparison, "group_shift", lambda words, group, vad, cfg=Config(): (asked.append(cfg.max_terms), whole(words, group, vad, cfg))[1])
    assert entry.queries()["ot_group_distance"](spark, SF).count() > 0
    assert asked == [Config().max_terms] == [256]
