"""Forecast models: the sentiment factor model (raw and relative) and fitted linear models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scores import MACRO

FEATURES = [
    "raw_sentiment", "relative_sentiment", "sentiment_zscore", "news_count", "news_relevance", "news_recency",
    "macro_sentiment", "macro_relative", "index_sentiment", "index_relative", "historical_volatility", "beta",
    "previous_return", "rolling_return_5d", "rolling_return_20d",
]
COMPONENTS = ["company_sentiment", "macro_sentiment", "index_sentiment", "drift"]


def model_name(p: dict) -> str:
    if p.get("model", "factor") == "linear":
        return "ridge-v1"
    return "factor-v2" if p.get("sentiment_input", "raw") == "relative" else "factor-v1"


def direction(pct: Column, threshold: Column) -> Column:
    return F.when(pct > threshold, "UP").when(pct < -threshold, "DOWN").otherwise("NEUTRAL")


def macro_sensitivity(breakdown: DataFrame, sectors: DataFrame, table: DataFrame, default: float = 1.0, extra: tuple[str, ...] = ()) -> DataFrame:
    """(extra, pos, horizon, sector) -> weight-averaged sector multiplier over the macro categories present."""
    macro = breakdown.where(F.col("entity") == MACRO).select(*extra, "pos", "horizon_type", "target_date", "category", "weight")
    pairs = macro.crossJoin(F.broadcast(sectors.select("sector").distinct())).join(F.broadcast(table), ["sector", "category"], "left")
    total = F.sum("weight")
    return pairs.groupBy(*extra, "pos", "horizon_type", "target_date", "sector").agg(
        F.when(total > 0, F.sum(F.col("weight") * F.coalesce("multiplier", F.lit(float(default)))) / F.nullif(total, F.lit(0.0)))
        .otherwise(float(default)).alias("macro_sens"))


def feature_columns(df: DataFrame) -> DataFrame:
    """The model feature vector. Null means genuinely unknown.

    Expects: today_score, today_macro, today_index, flow columns (f_*), macro flow (m_relative), index_relative_raw,
    macro_sens, beta, daily_vol and the n-session returns.
    """
    has_flow, has_news = F.col("f_status").isNotNull(), F.coalesce("f_news_count", F.lit(0)) > 0
    return df.withColumns({
        "raw_sentiment": F.col("today_score"),
        "relative_sentiment": F.col("f_relative"),
        "sentiment_zscore": F.col("f_zscore"),
        "news_count": F.when(has_flow, F.log1p("f_news_count")),
        "news_relevance": F.when(has_flow, F.when(has_news, F.col("f_news_relevance")).otherwise(0.0)),
        "news_recency": F.when(has_flow, F.when(has_news, F.exp(-F.col("f_recency") / 24)).otherwise(0.0)),
        "macro_sentiment": F.col("today_macro"),
        "macro_relative": F.col("m_relative") * F.col("macro_sens"),
        "index_sentiment": F.col("today_index") * F.col("beta"),
        "index_relative": F.col("index_relative_raw") * F.col("beta"),
        "historical_volatility": F.col("daily_vol") * 100,
    })


def factor_predict(df: DataFrame, p: dict | None = None, prefix: str = "") -> DataFrame:
    """Add predicted (%), predicted_price, predicted_direction, sigma_pct, signal and one c_* column per component.

    Inputs: previous_close, daily_vol, daily_drift, beta, trading_days_ahead, s_company, s_macro, macro_sens, s_index.
    Parameters come from ``p`` or, when ``p`` is None, from columns named ``prefix + parameter`` (trial tables).
    """
    def par(name: str) -> Column:
        return F.lit(float(p[name])) if p is not None else F.col(prefix + name)

    relative = (p or {}).get("sentiment_input", "relative") == "relative"
    h = F.greatest(F.lit(1), F.col("trading_days_ahead"))
    sigma = F.col("daily_vol") * F.sqrt(h)
    k = par("sensitivity") * (F.col("daily_vol") if relative else sigma) / 100.0
    parts = {
        "company_sentiment": k * par("w_company") * F.col("s_company"),
        "macro_sentiment": k * par("w_macro") * F.col("macro_sens") * F.col("s_macro"),
        "index_sentiment": k * par("w_index") * F.col("beta") * F.col("s_index"),
        "drift": par("drift_weight") * F.col("daily_drift") * F.col("trading_days_ahead"),
    }
    out = df.withColumns({"_sigma": sigma, **{"_" + name: value for name, value in parts.items()}})
    raw = F.col("_company_sentiment") + F.col("_macro_sentiment") + F.col("_index_sentiment") + F.col("_drift")
    cap = par("max_sigma_clip") * F.col("_sigma")
    out = out.withColumns({"_raw": raw, "_move": F.greatest(-cap, F.least(cap, raw))})
    scale = F.when(F.col("_raw") == 0, 1.0).otherwise(F.try_divide("_move", "_raw"))
    out = out.withColumns({"_pct": (F.exp("_move") - 1.0) * 100.0, "_scale": scale})
    signal = (par("w_company") * F.col("s_company") + par("w_macro") * F.col("macro_sens") * F.col("s_macro")
              + par("w_index") * F.col("beta") * F.col("s_index")) / 100.0
    threshold = par("neutral_threshold_sigma") * F.col("_sigma") * 100.0
    return out.withColumns({
        "predicted": F.bround("_pct", 4) + F.lit(0.0),
        "predicted_price": F.bround(F.col("previous_close") * (1 + F.col("_pct") / 100.0), 2),
        "predicted_direction": direction(F.col("_pct"), threshold),
        "sigma_pct": F.bround(F.col("_sigma") * 100.0, 4),
        "signal": F.bround(signal, 5) + F.lit(0.0),
        # + 0.0 turns a negative zero into zero
        **{"c_" + name: F.bround(F.col("_" + name) * F.col("_scale") * 100.0, 4) + F.lit(0.0) for name in parts},
    }).drop("_sigma", "_raw", "_move", "_pct", "_scale", *["_" + n for n in parts])


def linear_terms(model: dict) -> dict[str, Column]:
    """coefficient x standardised value per feature; missing values contribute nothing."""
    return {
        f: F.coalesce((F.col(f) - F.lit(float(m))) / F.lit(float(s)), F.lit(0.0)) * F.lit(float(c))
        for f, c, m, s in zip(model["features"], model["coef"], model["mean"], model["std"])
    }


def linear_value(model: dict) -> Column:
    total = F.lit(float(model["intercept"]))
    for term in linear_terms(model).values():
        total = total + term
    return 1 / (1 + F.exp(-total)) if model["kind"] == "logistic" else total


def linear_predict(df: DataFrame, model: dict, p: dict) -> DataFrame:
    """Fitted model: full value one session ahead, the shock without the intercept further out; clipped."""
    sigma = F.col("daily_vol") * F.sqrt(F.greatest(F.lit(1), F.col("trading_days_ahead"))) * 100
    one_day = linear_value(model)
    near = F.col("trading_days_ahead") <= 1
    value = F.when(near, one_day).otherwise(one_day - F.lit(float(model["intercept"])))
    cap = F.lit(float(p["max_sigma_clip"])) * sigma
    out = df.withColumn("_pct", F.greatest(-cap, F.least(cap, value)))
    out = (
        out.withColumn("predicted", F.bround("_pct", 4))
        .withColumn("predicted_price", F.bround(F.col("previous_close") * (1 + F.col("_pct") / 100), 2))
        .withColumn("sigma_pct", F.bround(sigma, 4))
        .withColumn("predicted_direction", direction(F.col("_pct"), F.lit(float(p["neutral_threshold_sigma"])) * sigma))
    )
    pairs = [x for f, t in linear_terms(model).items() for x in (F.lit(f), F.bround(t, 5))]
    pairs += [F.lit("intercept"), F.when(near, F.bround(F.lit(float(model["intercept"])), 5)).otherwise(0.0)]
    return out.withColumn("contributions", F.create_map(*pairs)).drop("_pct")
