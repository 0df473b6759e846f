"""The news behind each prediction, kept in long form (one row per prediction and news item)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import availability as av
from tidemark.operators import flow as flow_ops
from tidemark.operators.calendar import CutoffGrid
from tidemark.operators.scores import MACRO

MAX_NEW_IDS = 10


def evidence_ids(states: DataFrame, contributors: DataFrame, p: dict) -> DataFrame:
    """(pos, ticker, horizon, rank, news_id): up to ten new stories, then company and macro contributors, first mention kept."""
    fresh = flow_ops.new_news_ids(states, p, MAX_NEW_IDS).where(F.col("entity") != MACRO).select(
        "pos", F.col("entity").alias("ticker"), F.col("news_id"), F.col("rank").alias("place"))
    keys = ["pos", "horizon_type", "target_date"]
    company = contributors.where(F.col("entity") != MACRO).select(*keys, F.col("entity").alias("ticker"), "news_id", (F.col("rank") + 100).alias("place"))
    macro = contributors.where(F.col("entity") == MACRO).select(*keys, "news_id", (F.col("rank") + 200).alias("place"))
    asked = company.select(*keys, "ticker").distinct()
    rows = (
        company.unionByName(asked.join(macro, keys).select(company.columns))
        .unionByName(asked.join(fresh, ["pos", "ticker"]).select(company.columns))
    )
    first = rows.groupBy(*keys, "ticker", "news_id").agg(F.min("place").alias("place"))
    order = Window.partitionBy(*keys, "ticker").orderBy("place")
    return first.withColumn("rank", F.row_number().over(order)).drop("place")


def snapshot(ids: DataFrame, items: DataFrame, states: DataFrame, grid: CutoffGrid, p: dict) -> DataFrame:
    """Role and eligibility of every evidence item at its cut-off."""
    fresh = flow_ops.new_news_ids(states, p).select(F.col("pos").alias("_p"), F.col("news_id").alias("_n"), F.col("entity").alias("_e"), F.lit(True).alias("_new"))
    cut = grid.frame().select("pos", "as_of")
    facts = items.select("news_id", "entity", "available_at", "fetched_at", "provider_published_at", "timestamp_precision", "timezone_status", "source", "category")
    # Only referenced items survive the semi-join before the fact columns are attached.
    wanted = ids.select(F.col("news_id").alias("_w")).distinct()
    used = facts.join(wanted, F.col("news_id") == F.col("_w"), "left_semi")
    named = ids.join(F.broadcast(cut), "pos").join(used, "news_id")
    same = (F.col("pos") == F.col("_p")) & (F.col("news_id") == F.col("_n")) & (F.col("entity") == F.col("_e"))
    rows = named.join(fresh, same, "left")
    role = F.when(F.col("_new") & (F.col("entity") == F.col("ticker")), "new_company_news").when(F.col("_new") & (F.col("entity") == MACRO), "new_macro_news") \
        .otherwise("raw_score_evidence")
    cls = av.eligibility(F.col("provider_published_at"), F.col("timestamp_precision"), F.col("timezone_status"), F.col("fetched_at"), F.col("as_of"))
    return rows.withColumn("role", role).withColumn("eligibility", cls).drop("_p", "_n", "_e", "_new")


def bundle(evidence: DataFrame, policy: str) -> DataFrame:
    """Per (pos, ticker): event types and counts of policy-eligible evidence, and how much was excluded."""
    ok = F.col("eligibility").isin(*av.POLICIES[policy]) & (F.col("available_at") <= F.col("as_of"))
    return evidence.groupBy("pos", "ticker").agg(
        F.count_if(ok).alias("eligible"), F.count_if(~ok).alias("excluded"),
        F.array_join(F.array_sort(F.collect_set(F.when(ok, F.col("category")))), ",").alias("event_types"))
