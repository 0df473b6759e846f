"""Price-series operators. One bar per (ticker, date): a ticker's history is bounded by the calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.calendar import Calendar


def _series(*keys: str):
    return Window.partitionBy(*keys).orderBy("date")


def validate_bars(bars: DataFrame) -> DataFrame:
    """Drop bars without a positive close; gaps are never filled."""
    return bars.where(F.col("close") > 0)


def upsert_bars(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Newest fetch of each (ticker, date) wins. Combined map-side, so repeated re-deliveries never pile up in one task."""
    both = stored.unionByName(new, allowMissingColumns=True)
    values = [c for c in both.columns if c not in ("ticker", "date")]
    latest = both.groupBy("ticker", "date").agg(F.max(F.struct("fetched_at", *[c for c in values if c != "fetched_at"])).alias("b"))
    return latest.select("ticker", "date", *[F.col("b")[c].alias(c) for c in values])


def new_bar_count(stored: DataFrame, new: DataFrame) -> DataFrame:
    fresh = new.select("ticker", "date").distinct().join(stored.select("ticker", "date"), ["ticker", "date"], "left_anti")
    return fresh.groupBy("ticker").agg(F.count("*").alias("new_bars"))


def closes(bars: DataFrame, tickers: list[str] | None = None, start=None, end=None) -> DataFrame:
    """Range scan; both predicates reach the parquet reader."""
    out = bars.select("ticker", "date", "close")
    if tickers:
        out = out.where(F.col("ticker").isin(tickers))
    if start is not None:
        out = out.where(F.col("date") >= F.lit(start))
    if end is not None:
        out = out.where(F.col("date") <= F.lit(end))
    return out


def price_window(bars: DataFrame, start, end, warmup_days: int = 400, tail_days: int = 200) -> DataFrame:
    """Bars needed to replay [start, end]: warm-up for features, tail for month/quarter targets."""
    return bars.where((F.col("date") >= F.date_sub(F.lit(start), warmup_days)) & (F.col("date") <= F.date_add(F.lit(end), tail_days)))


def coverage(bars: DataFrame) -> DataFrame:
    return bars.groupBy("ticker").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("bars"))


def missing_sessions(bars: DataFrame, calendar: Calendar, start=None, end=None) -> DataFrame:
    """(ticker, session) pairs without a bar."""
    sessions = calendar.frame().select("session")
    if start is not None:
        sessions = sessions.where(F.col("session").between(F.lit(start), F.lit(end)))
    expected = bars.select("ticker").distinct().crossJoin(F.broadcast(sessions))
    held = bars.select("ticker", F.col("date").alias("session"))
    return expected.join(held, ["ticker", "session"], "left_anti")


def sessions_held(bars: DataFrame, calendar: Calendar, start, end) -> DataFrame:
    """One row: sessions in [start, end], how many (ticker, session) pairs lack a bar, and the share that has one."""
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    held = bars.select("ticker", "date").distinct().agg(F.countDistinct("ticker").alias("tickers"), F.count_if(F.col("date").between(lo, hi)).alias("held"))
    days = calendar.frame().where(F.col("session").between(lo, hi)).agg(F.count("*").alias("sessions"))
    expected = F.col("sessions") * F.col("tickers")
    return days.join(F.broadcast(held)).select(  # one row each
        "sessions", (expected - F.col("held")).alias("missing_sessions"), F.round(F.try_divide(F.col("held"), expected), 4).alias("coverage_ratio"))


def returns(bars: DataFrame) -> DataFrame:
    w = _series("ticker")
    prev = F.lag("close").over(w)
    return bars.select("ticker", "date", "close", (F.col("close") / prev - 1).alias("simple_return"),
                       (F.log("close") - F.log(prev)).alias("log_return"))


def n_session_returns(bars: DataFrame, sessions: tuple = (1, 5, 20)) -> DataFrame:
    w = _series("ticker")
    return bars.select("ticker", "date", *[((F.col("close") / F.lag("close", n).over(w) - 1) * 100).alias(f"return_{n}") for n in sessions])


def rolling_state(bars: DataFrame, index_bars: DataFrame, p: dict) -> DataFrame:
    """Per bar, statistics of the history up to and including it: volatility, drift, beta, n-session returns."""
    w = _series("ticker")
    own = (
        returns(bars)
        .withColumn("n_obs", F.row_number().over(w))
        .withColumn("daily_vol", F.stddev_samp("log_return").over(w.rowsBetween(1 - p["vol_lookback_days"], 0)))
        .withColumn("daily_drift", F.avg("log_return").over(w.rowsBetween(1 - p["drift_lookback_days"], 0)))
    )
    for n in (1, 5, 20):
        own = own.withColumn(f"return_{n}", (F.col("close") / F.lag("close", n).over(w) - 1) * 100)
    index_returns = returns(index_bars.select(F.lit("_index").alias("ticker"), "date", "close")).select(
        "date", F.col("log_return").alias("index_return"))
    paired = own.select("ticker", "date", "log_return").join(index_returns, "date").where("log_return IS NOT NULL AND index_return IS NOT NULL")
    wb = w.rowsBetween(1 - p["beta_lookback_days"], 0)
    beta = paired.select(
        "ticker", "date", F.covar_samp("log_return", "index_return").over(wb).alias("_cov"),
        F.var_samp("index_return").over(wb).alias("_var"), F.count("*").over(wb).alias("_pairs"))
    return own.join(beta, ["ticker", "date"], "left")


def market_features(bars: DataFrame, index_bars: DataFrame, sessions: DataFrame, p: dict,
                    enforce_previous: bool = False) -> DataFrame:
    """Features for predicting each session, from closes strictly before it.

    ``sessions``: (session[, previous_session]). Every (ticker, session) gets a row: values, or a missing_reason.
    """
    state = rolling_state(bars, index_bars, p)
    tickers = bars.select("ticker").distinct()
    asked = tickers.crossJoin(F.broadcast(sessions))
    values = ["date", "close", "n_obs", "daily_vol", "daily_drift", "return_1", "return_5", "return_20"]
    # As-of: interleave bars and asked sessions per ticker, carry the last bar forward to strictly later sessions.
    lines = state.select("ticker", F.col("date").alias("_at"), F.lit(1).alias("_bar"), F.struct(*values).alias("_s"),
                         F.when(F.col("_pairs").isNotNull(), F.struct("_cov", "_var", "_pairs")).alias("_b"))
    asks = asked.select("ticker", F.col("session").alias("_at"), F.lit(0).alias("_bar"), *[c for c in sessions.columns])
    order = Window.partitionBy("ticker").orderBy("_at", "_bar").rowsBetween(Window.unboundedPreceding, -1)
    merged = lines.unionByName(asks, allowMissingColumns=True)
    filled = merged.withColumn("_s", F.last("_s", ignorenulls=True).over(order)).withColumn("_b", F.last("_b", ignorenulls=True).over(order))
    rows = filled.where(F.col("_bar") == 0)
    estimated = (F.coalesce("_b._pairs", F.lit(0)) >= p["min_history_days"]) & (F.coalesce("_b._var", F.lit(0.0)) > 0)
    need = int(p["min_history_days"]) + 1
    session_text = F.col("session").cast("string")
    reason = F.when(F.col("_s").isNull(), F.concat(F.lit("no closing price before "), session_text))
    if enforce_previous:
        reason = reason.when(
            F.col("_s.date") != F.col("previous_session"),
            F.concat(F.lit("previous close for "), F.col("previous_session").cast("string"),
                     F.lit(" not available (latest stored close is "), F.col("_s.date").cast("string"), F.lit("); refresh market data")))
    reason = reason.when(F.col("_s.n_obs") < need, F.concat(
        F.lit("only "), F.col("_s.n_obs").cast("string"), F.lit(" closes before "), session_text, F.lit(f"; need {need}")))
    reason = reason.when(F.col("_s.daily_vol").isNull() | F.isnan("_s.daily_vol") | (F.col("_s.daily_vol") <= 0),
                         "volatility could not be estimated")
    return rows.select(
        "ticker", "session", F.col("_s.close").alias("previous_close"), F.col("_s.date").alias("previous_close_date"),
        F.col("_s.daily_vol").alias("daily_vol"), F.col("_s.daily_drift").alias("daily_drift"),
        F.when(estimated, F.try_divide(F.col("_b._cov"), F.col("_b._var"))).otherwise(1.0).alias("beta"),
        F.when(estimated, "estimated").otherwise("default").alias("beta_source"), F.col("_s.n_obs").alias("n_obs"),
        F.col("_s.return_1").alias("previous_return"), F.col("_s.return_5").alias("rolling_return_5d"),
        F.col("_s.return_20").alias("rolling_return_20d"), reason.alias("missing_reason"))


def baseline_forecasts(bars: DataFrame, sessions: DataFrame, window: int = 20) -> DataFrame:
    """Per-session expected return (%) of each transparent baseline, from returns dated strictly before the session."""
    r = returns(bars).where("simple_return IS NOT NULL").select("ticker", "date", (F.col("simple_return") * 100).alias("r"))
    per_day = r.groupBy("date").agg(F.sum("r").alias("s"), F.count("*").alias("n"))
    days = per_day.unionByName(sessions.select(F.col("session").alias("date"), F.lit(0.0).alias("s"), F.lit(0).cast("bigint").alias("n")))
    days = days.groupBy("date").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    before = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)  # calendar-sized
    pooled = days.select(F.col("date").alias("session"), F.try_divide(F.sum("s").over(before), F.sum("n").over(before)).alias("historical_mean"))
    w = Window.partitionBy("ticker").orderBy("date")
    state = r.select(
        "ticker", "date", F.avg("r").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("company_mean"),
        F.when(F.row_number().over(w) >= window, F.avg("r").over(w.rowsBetween(1 - window, 0))).alias("rolling_mean_20d"))
    asks = bars.select("ticker").distinct().crossJoin(F.broadcast(sessions.select("session")))
    merged = state.select("ticker", F.col("date").alias("_at"), F.lit(1).alias("_bar"), F.struct("company_mean", "rolling_mean_20d").alias("_s")) \
        .unionByName(asks.select("ticker", F.col("session").alias("_at"), F.lit(0).alias("_bar"), "session"), allowMissingColumns=True)
    order = Window.partitionBy("ticker").orderBy("_at", "_bar").rowsBetween(Window.unboundedPreceding, -1)
    rows = merged.withColumn("_s", F.last("_s", ignorenulls=True).over(order)).where(F.col("_bar") == 0)
    return rows.join(F.broadcast(pooled), "session").select(
        "ticker", "session", F.lit(0.0).alias("no_change"), "historical_mean", F.col("_s.company_mean").alias("company_mean"),
        F.col("_s.rolling_mean_20d").alias("rolling_mean_20d"))
