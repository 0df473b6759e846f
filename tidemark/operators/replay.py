"""Set-based replay: forecasts for every (cut-off, company, horizon) in one job, without look-ahead.

The same composition serves a live run: a grid with a single cut-off and ``enforce_previous=True``.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timestamps import session_close
from tidemark.operators import flow as flow_ops
from tidemark.operators import market, predict, scores
from tidemark.operators.calendar import Calendar, CutoffGrid, horizons
from tidemark.operators.scores import MACRO
from tidemark.operators.universe import members_asof
from tidemark.session import cut_lineage

BASELINES = ["no_change", "historical_mean", "company_mean", "rolling_mean_20d"]


@dataclass
class Inputs:
    items: DataFrame
    bars: DataFrame
    index_bars: DataFrame
    members: DataFrame
    catalog: DataFrame
    sensitivity: DataFrame
    calendar: Calendar
    news_params: dict
    model_params: dict
    horizon_types: tuple = ("today",)
    convention: str = "indian_fy"
    policy: str = "provider_timestamp"
    default_sensitivity: float = 1.0


def horizon_rows(x: Inputs, grid: CutoffGrid, within_data: bool = True) -> DataFrame:
    days = grid.frame().select("session").withColumnRenamed("session", "day")
    rows = horizons(days, x.calendar, x.convention).where(F.col("horizon_type").isin(list(x.horizon_types))).drop("day")
    return rows.where(F.col("calendar_date") <= F.lit(x.calendar.last)) if within_data else rows


def predictions(x: Inputs, grid: CutoffGrid, enforce_previous: bool = False, within_data: bool = True,
                model: dict | None = None) -> DataFrame:
    """One row per (cut-off, universe member, horizon): inputs, features, forecast, or a missing_reason."""
    p1, p2 = x.news_params, x.model_params
    # The dimension-sized inputs (cut-offs x horizons, cut-offs x members) are materialised once: they are joined many times.
    hz = horizon_rows(x, grid, within_data)
    asked = cut_lineage(_with_today(scores.targets_of(hz, grid, session_close(F.col("target_date"))), grid))
    targets = asked.where(F.col("asked")).drop("asked")
    cut = grid.frame().select("pos", "session")
    days = cut.select(F.col("session").alias("day"))
    uni = members_asof(x.members, days).join(F.broadcast(cut), F.col("day") == F.col("session")).select(
        "pos", "version", F.col("ticker").alias("entity"), "weight")
    uni = cut_lineage(uni.join(x.catalog.select(F.col("ticker").alias("entity"), "sector"), "entity"))

    # sentiment side: everything below is bounded by cut-offs x universe x horizons; the news flow reads the items as well and does not wait
    with ThreadPoolExecutor(1) as side_job:
        flow_rows = side_job.submit(lambda: cut_lineage(flow_ops.news_flow(x.items, grid, uni.select("pos", "entity"), p1, x.policy)))
        states = scores.weighted_states(x.items, grid, p1, x.policy)
        sums = cut_lineage(scores.category_sums(states, asked, grid, p1))
        wanted = asked.select("pos", "session", "horizon_type", "target_date")
        everyone = uni.select("pos", "entity", "weight").unionByName(cut.select("pos", F.lit(MACRO).alias("entity"), F.lit(0.0).alias("weight")))
        expected = wanted.join(everyone, "pos")
        scored = cut_lineage(scores.entity_scores(sums, expected, p1))
        index = scores.index_scores(scored, p1).select("pos", "horizon_type", "target_date", F.col("company_weighted").alias("index_score"),
                                                       F.col("overall").alias("index_overall"))
        sens = predict.macro_sensitivity(scores.category_breakdown(sums), x.catalog, x.sensitivity, x.default_sensitivity)
        flow = flow_rows.result()
    rel = flow_ops.index_relative(flow, uni.select("pos", "entity", "weight"))

    hkeys = ["pos", "horizon_type", "target_date"]
    macro = scored.where(F.col("entity") == MACRO).select(*hkeys, F.col("score").alias("macro_score"))
    company = scored.where(F.col("entity") != MACRO).select(*hkeys, "session", "entity", "score", F.col("news_count").alias("company_news_count"),
                                                            F.col("evidence_weight").alias("company_evidence_weight"))
    side = company.join(macro, hkeys, "left").join(index, hkeys, "left")
    today = side.where(F.col("horizon_type") == "today").select(
        "pos", "entity", F.col("score").alias("today_score"), F.col("macro_score").alias("today_macro"), F.col("index_score").alias("today_index"))
    own = flow.where(F.col("entity") != MACRO).select(
        "pos", "entity", F.col("status").alias("f_status"), F.col("relative_sentiment").alias("f_relative"),
        F.col("sentiment_zscore").alias("f_zscore"), F.col("news_count").alias("f_news_count"),
        F.col("news_relevance").alias("f_news_relevance"), F.col("news_recency_hours").alias("f_recency"))
    mflow = flow.where(F.col("entity") == MACRO).select("pos", F.col("relative_sentiment").alias("m_relative"))

    # price side
    sessions = x.calendar.lookup(cut.select("session"), F.col("session"), "previous_session")
    features = market.market_features(x.bars, x.index_bars, sessions, p2, enforce_previous).withColumnRenamed("ticker", "entity")

    rows = (
        targets.join(uni, "pos").join(side.drop("session"), [*hkeys, "entity"], "left").join(today, ["pos", "entity"], "left")
        .join(own, ["pos", "entity"], "left").join(mflow, "pos", "left")
        .join(rel.withColumnRenamed("index_relative", "index_relative_raw"), "pos", "left")
        .join(sens, [*hkeys, "sector"], "left")
        .join(features, ["session", "entity"], "left")
        .withColumn("macro_sens", F.coalesce("macro_sens", F.lit(float(x.default_sensitivity))))
        .withColumn("missing_reason", F.when(F.col("n_obs").isNull() & F.col("missing_reason").isNull(),
                                             F.concat(F.lit("no closing price before "), F.col("session").cast("string")))
                    .otherwise(F.col("missing_reason")))
        .withColumn("status", F.when(F.col("missing_reason").isNull(), "OK").otherwise("MISSING_DATA"))
    )
    if p2.get("sentiment_input", "raw") == "relative":
        signals = {"s_company": F.coalesce("f_relative", F.lit(0.0)), "s_macro": F.coalesce("m_relative", F.lit(0.0)),
                   "s_index": F.coalesce("index_relative_raw", F.lit(0.0))}
    else:
        signals = {"s_company": F.col("score"), "s_macro": F.col("macro_score"), "s_index": F.col("index_score")}
    rows = rows.withColumns(signals)
    out = predict.linear_predict(predict.feature_columns(rows), model, p2) if model else \
        predict.feature_columns(predict.factor_predict(rows, p2))
    return out.withColumnRenamed("entity", "ticker").withColumnRenamed("version", "universe_version")


def _with_today(targets: DataFrame, grid: CutoffGrid) -> DataFrame:
    """Feature vectors are anchored on the next-session scores, so those targets are always computed.

    ``asked`` marks the targets the caller wants forecasts for.
    """
    columns = ["pos", "session", "as_of", "horizon_type", "horizon_label", "calendar_date", "target_date", "trading_days_ahead",
               "projected_calendar", "target_at"]
    wanted = targets.select(*columns, F.lit(True).alias("asked"))
    today = grid.frame().select(
        "pos", "session", "as_of", F.lit("today").alias("horizon_type"), F.lit("Today").alias("horizon_label"), F.col("session").alias("calendar_date"),
        F.col("session").alias("target_date"), F.lit(1).alias("trading_days_ahead"), F.lit(False).alias("projected_calendar"),
        F.greatest("as_of", session_close(F.col("session"))).alias("target_at"), F.lit(False).alias("asked"))
    missing = today.join(wanted.where("horizon_type = 'today'").select("pos"), "pos", "left_anti")
    return wanted.unionByName(missing)


def records(x: Inputs, grid: CutoffGrid, forecast: DataFrame | None = None) -> DataFrame:
    """Evaluation rows: forecasts with an outcome, the outcome, and the horizon-scaled baselines."""
    rows = (forecast if forecast is not None else predictions(x, grid)).where(F.col("status") == "OK")
    outcome = x.bars.select("ticker", F.col("date").alias("target_date"), F.col("close").alias("actual_close"))
    sessions = grid.frame().select("session")
    base = market.baseline_forecasts(x.bars, sessions)
    out = rows.join(outcome, ["ticker", "target_date"]).join(base, ["ticker", "session"], "left")
    for b in BASELINES:
        out = out.withColumn(b, F.bround(F.col(b) * F.col("trading_days_ahead"), 5))
    return (
        out.withColumn("actual", F.bround((F.col("actual_close") / F.col("previous_close") - 1) * 100, 4))
        .withColumn("neutral_threshold_pct", F.lit(float(x.model_params["neutral_threshold_sigma"])) * F.col("sigma_pct"))
        .withColumn("as_of_date", F.col("session"))
        .withColumn("month", F.date_format("session", "yyyy-MM"))
    )


def quality_flags(x: Inputs, grid: CutoffGrid, states: DataFrame | None = None) -> DataFrame:
    """(pos, ticker, data_quality_flag): VERIFIED when all new company and macro news was held before the cut-off."""
    states = states if states is not None else flow_ops.flow_states(x.items, grid, x.news_params, x.policy)
    fresh = flow_ops.new_news_ids(states, x.news_params)
    cut = grid.frame().select("pos", "as_of")
    judged = fresh.join(F.broadcast(cut), "pos").groupBy("pos", "entity").agg(
        F.count("*").alias("n"), F.count_if(F.coalesce(F.col("fetched_at") <= F.col("as_of"), F.lit(False))).alias("ok"))
    macro = judged.where(F.col("entity") == MACRO).select("pos", F.col("n").alias("mn"), F.col("ok").alias("mok"))
    days = grid.frame().select("pos", F.col("session").alias("day"))
    uni = members_asof(x.members, days.select("day")).join(F.broadcast(days), "day").select("pos", F.col("ticker").alias("entity"))
    n = F.coalesce("n", F.lit(0)) + F.coalesce("mn", F.lit(0))
    ok = F.coalesce("ok", F.lit(0)) + F.coalesce("mok", F.lit(0))
    return uni.join(judged, ["pos", "entity"], "left").join(macro, "pos", "left").select(
        "pos", F.col("entity").alias("ticker"),
        F.when(n == 0, "NO_NEW_NEWS").when(n == ok, "VERIFIED").otherwise("UNCERTAIN").alias("data_quality_flag"))
