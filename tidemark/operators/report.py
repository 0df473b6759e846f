"""Report blocks over evaluation records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import metrics as metric_ops
from tidemark.operators.predict import COMPONENTS

SMALL_SAMPLE = 100


def contribution_long(records: DataFrame, *keys: str) -> DataFrame:
    """(keys, component, value): factor contributions, or the map of a linear model."""
    if "contributions" in records.columns:
        return records.select(*keys, F.explode("contributions").alias("component", "value"))
    return records.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("component"), F.col("c_" + c).alias("value")) for c in COMPONENTS])).alias("c")).select(*keys, "c.component", "c.value")


def contribution_summary(records: DataFrame, *keys: str) -> DataFrame:
    long = contribution_long(records, *keys)
    share = lambda c: F.round(F.avg(c.cast("double")), 4)
    return long.groupBy(*keys, "component").agg(
        metric_ops.half_up(F.avg("value"), 5).alias("mean"), share(F.col("value") > 0).alias("share_positive"),
        share(F.col("value") < 0).alias("share_negative"), F.count("*").alias("n"))


def company_summary(records: DataFrame) -> DataFrame:
    m = metric_ops.metrics(records, "ticker", "horizon_type").select(
        "ticker", "horizon_type", "n", "mae", "rmse", "directional_accuracy", "sign_accuracy", "bias", "no_change_mae")
    d = metric_ops.direction_distribution(records, "ticker", "horizon_type").drop("n")
    return m.join(d, ["ticker", "horizon_type"])


def failure_cases(records: DataFrame, n: int = 10) -> DataFrame:
    """Largest absolute errors (top-k: each task keeps its best n)."""
    return records.withColumn("error", F.round(F.col("predicted") - F.col("actual"), 4)).orderBy(
        F.desc(F.abs("error")), "session", "ticker", "horizon_type", "target_date").limit(n)


def failure_evidence(cases: DataFrame, evidence: DataFrame, titles: DataFrame, limit: int = 3) -> DataFrame:
    """Attach up to ``limit`` evidence titles (in evidence order) to each case."""
    keys = ["session", "ticker", "horizon_type", "target_date"]
    named = evidence.where(F.col("rank") <= limit).join(F.broadcast(cases.select(*keys)), keys).join(titles, "news_id")
    listed = named.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda x: x["title"]).alias("evidence"))
    return cases.join(listed, keys, "left")


def observations(records: DataFrame, baselines: list[str]) -> DataFrame:
    """(horizon_type, rule, value): one row per rule that fires."""
    m = metric_ops.metrics(records, "horizon_type")
    usable = metric_ops.with_all_baselines(records, baselines)
    worse = usable.groupBy("horizon_type").agg(
        F.avg(F.abs(F.col("predicted") - F.col("actual"))).alias("_m"),
        *[F.avg(F.abs(F.col(b) - F.col("actual"))).alias("_b_" + b) for b in baselines])
    beaten = reduce(lambda a, b: a + b, [(F.round("_m", 4) >= F.round("_b_" + b, 4)).cast("int") for b in baselines])
    m = m.join(worse.select("horizon_type", beaten.alias("lost_baselines")), "horizon_type", "left")
    called = F.col("up_n") + F.col("down_n")
    one_sided = F.try_divide(F.greatest("up_n", "down_n"), called)
    rules = [
        ("small_sample", F.col("n") < SMALL_SAMPLE, F.col("n").cast("double")),
        ("no_mae_skill", F.col("mae_skill") <= 0, F.col("mae_skill")),
        ("mae_skill", F.col("mae_skill") > 0, F.col("mae_skill")),
        ("loses_to_baselines", F.col("lost_baselines") > 0, F.col("lost_baselines").cast("double")),
        ("beats_all_baselines", F.col("lost_baselines") == 0, F.lit(0.0)),
        ("sign_like_coin_flip", F.col("sign_p_value") >= 0.05, F.col("sign_p_value")),
        ("sign_better", (F.col("sign_p_value") < 0.05) & (F.col("sign_accuracy") > 0.5), F.col("sign_accuracy")),
        ("sign_worse", (F.col("sign_p_value") < 0.05) & (F.col("sign_accuracy") <= 0.5), F.col("sign_accuracy")),
        ("mostly_neutral", F.try_divide("neutral_n", "n") > 0.5, F.round(F.try_divide("neutral_n", "n"), 4)),
        ("one_sided", (called >= 20) & (one_sided > 0.8), F.round(one_sided, 4)),
        ("overlapping_windows", F.col("horizon_type").isin("month_end", "quarter_end"), F.col("n").cast("double")),
    ]
    fired = F.array_compact(F.array(*[
        F.when(cond, F.struct(F.lit(name).alias("rule"), value.alias("value"))) for name, cond, value in rules]))
    return m.withColumn("_r", F.explode(fired)).select("horizon_type", "_r.rule", "_r.value")


def evaluation_report(records: DataFrame, baselines: list[str], features: list[str], meta: dict[str, str]) -> DataFrame:
    """One-row DataFrame with a JSON document; every block is a small aggregate, so only summaries are collected into it."""
    blocks = {
        "metrics": metric_ops.metrics(records), "metrics_by_horizon": metric_ops.metrics(records, "horizon_type"),
        "company_results": company_summary(records), "monthly_results": metric_ops.metrics(records, "horizon_type", "month"),
        "contributions": contribution_summary(records, "horizon_type"), "confusion_matrix": metric_ops.confusion_matrix(records),
        "baseline_comparison": metric_ops.baseline_comparison(records, baselines), "observations": observations(records, baselines),
        "feature_analysis_next_session": metric_ops.feature_analysis(records.where("horizon_type = 'today'"), features),
        "failure_cases": failure_cases(records).select("session", "ticker", "horizon_type", "target_date", "predicted", "actual", "error"),
    }
    listed = [df.agg(F.collect_list(F.struct(*df.columns)).alias(name)) for name, df in blocks.items()]
    doc = reduce(lambda x, y: x.join(F.broadcast(y)), listed)  # one row each
    return doc.select(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in meta.items()], *blocks)).alias("report"))


def newest_first(rows: DataFrame, at: str, limit: int = 50) -> DataFrame:
    return rows.orderBy(F.desc(at)).limit(limit)
