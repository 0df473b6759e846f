"""Matching live predictions with realised closes. Predictions are immutable; outcomes are separate rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timestamps import session_close
from tidemark.operators.predict import direction


def pending(predictions: DataFrame, outcomes: DataFrame) -> DataFrame:
    live = predictions.where((F.col("status") == "OK") & ~F.col("is_backtest"))
    return live.join(outcomes.select("prediction_id"), "prediction_id", "left_anti")


def maturity(open_predictions: DataFrame, bars: DataFrame, now: Column) -> DataFrame:
    """Add actual_close and maturity: not_matured | scored | missing_target_price | awaiting_price."""
    target = bars.select("ticker", F.col("date").alias("target_date"), F.col("close").alias("actual_close"))
    last = bars.groupBy("ticker").agg(F.max("date").alias("_last"))
    rows = open_predictions.join(target, ["ticker", "target_date"], "left").join(F.broadcast(last), "ticker", "left")
    return rows.withColumn(
        "maturity",
        F.when(now < session_close(F.col("target_date")), "not_matured")
        .when(F.col("actual_close").isNotNull() & F.col("previous_close").isNotNull(), "scored")
        .when(F.col("_last") > F.col("target_date"), "missing_target_price").otherwise("awaiting_price")).drop("_last")


def outcome_rows(matured: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Outcome of every scored prediction; ``thresholds``: (param_version, neutral_threshold_sigma)."""
    rows = matured.where("maturity = 'scored'").join(F.broadcast(thresholds), "param_version", "left")
    actual = (F.col("actual_close") / F.col("previous_close") - 1) * 100
    rows = rows.withColumn("_a", actual).withColumn("_e", F.col("predicted_movement") - F.col("_a"))
    rows = rows.withColumn("actual_direction", direction(F.col("_a"), F.col("uncertainty_1sigma_pct") * F.coalesce("neutral_threshold_sigma", F.lit(0.1))))
    return rows.select(
        "prediction_id", F.col("target_date").alias("actual_close_date"), "actual_close", F.round("_a", 4).alias("actual_movement"),
        F.round("_e", 4).alias("error"), F.round(F.abs("_e"), 4).alias("abs_error"), F.round(F.col("_e") * F.col("_e"), 6).alias("squared_error"),
        "actual_direction", (F.col("actual_direction") == F.col("predicted_direction")).alias("direction_correct"))


def match_outcomes(predictions: DataFrame, outcomes: DataFrame, bars: DataFrame, thresholds: DataFrame, now: Column):
    """(new outcome rows, status of every pending prediction)."""
    state = maturity(pending(predictions, outcomes), bars, now)
    return outcome_rows(state, thresholds), state.select("prediction_id", "ticker", "target_date", "maturity")


def track_record(predictions: DataFrame, outcomes: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Evaluation rows of scored live predictions."""
    live = predictions.where(~F.col("is_backtest")).join(outcomes, "prediction_id").join(F.broadcast(thresholds), "param_version", "left")
    return live.select(
        "prediction_id", "ticker", "horizon_type", "target_date", F.col("predicted_movement").alias("predicted"), F.col("actual_movement").alias("actual"),
        F.col("uncertainty_1sigma_pct").alias("sigma_pct"), "predicted_direction",
        (F.coalesce("neutral_threshold_sigma", F.lit(0.1)) * F.col("uncertainty_1sigma_pct")).alias("neutral_threshold_pct"))


def latest_run(runs: DataFrame, at: str = "created_at") -> DataFrame:
    """The newest live run (one row)."""
    return runs.where(~F.col("is_backtest")).groupBy().agg(F.max_by("run_id", F.struct(at, "run_id")).alias("run_id"))


def find_predictions(predictions: DataFrame, runs: DataFrame, ticker: str | None = None, horizon_type: str | None = None, run_id: str | None = None,
                     target_date=None, include_backtest: bool = False, limit: int = 500) -> DataFrame:
    """Filters by run, ticker, horizon and target; without a run the latest live one."""
    rows = predictions
    if run_id is not None:
        rows = rows.where(F.col("run_id") == run_id)
    elif not include_backtest:
        rows = rows.join(F.broadcast(latest_run(runs)), "run_id", "left_semi")
    for column, value in (("ticker", ticker), ("horizon_type", horizon_type), ("target_date", target_date)):
        if value is not None:
            rows = rows.where(F.col(column) == F.lit(value))
    if not include_backtest:
        rows = rows.where(~F.col("is_backtest"))
    return rows.orderBy("prediction_id").limit(limit)


def overview(news: DataFrame, predictions: DataFrame, runs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(section, name, value) roll-up for a status page."""
    line = lambda df, s, n, val: df.select(F.lit(s).alias("section"), n.alias("name"), val.cast("bigint").alias("value"))
    articles = news.groupBy("provider").agg(F.count("*").alias("n"), F.count_if(F.col("availability_status") == "verified_pre_market").alias("v"))
    last = predictions.join(F.broadcast(latest_run(runs)), "run_id", "left_semi").where("horizon_type = 'today'").groupBy("predicted_direction").agg(F.count("*").alias("n"))
    live = predictions.where(~F.col("is_backtest") & (F.col("status") == "OK"))
    scored = live.join(outcomes.select("prediction_id"), "prediction_id", "left_semi").agg(F.count("*").alias("n"))
    waiting = live.join(outcomes.select("prediction_id"), "prediction_id", "left_anti").agg(F.count("*").alias("n"))
    return (
        line(articles, "articles", F.col("provider"), F.col("n")).unionByName(line(articles, "verified", F.col("provider"), F.col("v")))
        .unionByName(line(last, "directions", F.col("predicted_direction"), F.col("n")))
        .unionByName(line(scored, "outcomes", F.lit("scored"), F.col("n"))).unionByName(line(waiting, "outcomes", F.lit("pending"), F.col("n")))
    )
