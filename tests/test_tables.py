"""Immutable runs, catalog maintenance and the article analysis chain."""

import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidemark.functions.sentiment import lexicon_score
from tidemark.operators import entities, snapshots, universe
from tidemark.operators.entities import Category, Company
from tidemark.params import SOURCE_RELIABILITY, load_taxonomy

UNIVERSE = "version string, ticker string, weight double, effective_from date, effective_to date, status string"


def test_runs_are_immutable(spark, tmp_path):
    rows = spark.range(3)
    snapshots.append_run(rows, str(tmp_path / "runs"), "r1")
    with pytest.raises(AnalysisException):
        snapshots.append_run(rows, str(tmp_path / "runs"), "r1")
    snapshots.append_run(rows, str(tmp_path / "runs"), "r2")
    assert spark.read.parquet(str(tmp_path / "runs")).groupBy("run_id").count().count() == 2


def test_catalog_maintenance(spark):
    d = dt.date
    m = spark.createDataFrame([("a", "X", 2.0, d(2020, 1, 1), None, "confirmed")], UNIVERSE)
    new = spark.createDataFrame([("a", "X", 9.0, d(2020, 1, 1), None, "confirmed"), ("b", "X", 3.0, d(2026, 1, 1), None, "confirmed")], UNIVERSE)
    cat = spark.createDataFrame([("X", "X Ltd", "Energy")], "ticker string, name string, sector string")
    assert [(r["version"], r["weight"]) for r in universe.seed_versions(m, new, cat).collect()] == [("b", 3.0)]
    assert universe.history(m.unionByName(new.where("version = 'b'"))).count() == 2
    day = spark.createDataFrame([(d(2026, 2, 1),)], "day date")
    both = m.unionByName(new.where("version = 'b'"))
    assert universe.mirror_weights(cat, both, day).first()["index_weight"] == 3.0
    changes = spark.createDataFrame([("X", None, "Metals"), ("Z", "Z Ltd", None)], "ticker string, name string, sector string")
    got = {r["ticker"]: r for r in universe.upsert_catalog(cat, changes).collect()}
    assert got["X"]["name"] == "X Ltd" and got["X"]["sector"] == "Metals" and not got["X"]["rejected"] and got["Z"]["rejected"]


def test_analysis_chain_is_incremental(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"categories": {"profit": {"scope": "company", "base_strength": 1, "half_life_days": 10, "keywords": ["profit"]}}}')
    cats = entities.categories_from(load_taxonomy(str(tmp_path / "t.json")))
    assert cats == [Category("profit", "company", 1.0, 10.0, ("profit",))]
    news = spark.createDataFrame([(1, "HDFC Bank profit beats estimates", None, "Reuters India"), (2, "Weather is fine", None, "x")],
                                 "news_id long, title string, summary string, source string")
    scorer = lambda df: lexicon_score(df, "title", "summary")
    out = entities.analyse(news, [Company("HDFCBANK", "HDFC Bank", "Financials", ("HDFC Bank",))], cats, SOURCE_RELIABILITY, scorer)
    rows = {r["news_id"]: r for r in out.collect()}
    assert rows[1]["entity"] == "HDFCBANK" and rows[1]["sentiment"] > 15 and rows[1]["reliability"] == 0.95 and rows[1]["strength"] == 1.0
    assert rows[2]["entity"] == "NONE" and rows[2]["category"] == "unrelated"
    more = news.unionByName(spark.createDataFrame([(3, "t", None, "s")], news.schema))
    assert [r["news_id"] for r in entities.pending_articles(more, out, "lexicon-v3").collect()] == [3]


def test_batch_model_scorer(spark):
    news = spark.createDataFrame([("good",), ("bad",)], "title string")
    run = entities.model_scorer(lambda pdf: pdf["title"].eq("good") * 1.0 - 0.5, "toy")
    assert {r["title"]: r["score"] for r in run(news).collect()} == {"good": 50.0, "bad": -50.0}
    assert run(news).where(F.col("engine") == "toy").count() == 2
