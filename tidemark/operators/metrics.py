"""Evaluation metrics: every ratio comes with the sample count it was computed on.

Records: predicted, actual, sigma_pct, predicted_direction, neutral_threshold_pct, baselines, keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.tails import normal_p, t_upper_p
from tidemark.operators.predict import direction

MAPE_FLOOR = 0.5
DIRECTIONS = ["UP", "DOWN", "NEUTRAL"]


def with_outcome_direction(records: DataFrame) -> DataFrame:
    return records.withColumn("actual_direction", direction(F.col("actual"), F.col("neutral_threshold_pct")))


def _ratio(hits: Column, n: Column) -> Column:
    return F.round(F.try_divide(hits, n), 4)


def half_up(c: Column, n: int = 4) -> Column:
    """Half-up after removing summation noise below 1e-9, so a mean that ends in 5 rounds the same in every run."""
    return F.round(F.round(c, 9), n)


_r = half_up


def coin_flip_z(hits: Column, n: Column) -> Column:
    return F.when(n >= 10, (hits - 0.5 * n) / F.sqrt(0.25 * n))


def _sums() -> list[Column]:
    err = F.col("predicted") - F.col("actual")
    act, pred = F.col("actual"), F.col("predicted")
    signed = F.col("predicted_direction").isin("UP", "DOWN") & (act != 0)
    sized = F.abs(act) >= MAPE_FLOOR
    is_ = lambda d: F.col("predicted_direction") == d
    return [
        F.count("*").alias("n"), F.avg(F.abs(err)).alias("_mae"), F.sqrt(F.avg(err * err)).alias("_rmse"), F.avg(err).alias("_bias"),
        F.avg(pred).alias("_mp"), F.avg(act).alias("_ma"), F.stddev_pop(pred).alias("_sp"), F.stddev_pop(act).alias("_sa"),
        F.covar_pop(pred, act).alias("_cov"), F.avg(F.when(sized, F.abs(err / F.nullif(act, F.lit(0.0))))).alias("_mape"),
        F.count_if(sized).alias("mape_n"), F.count_if(F.abs(err) <= F.col("sigma_pct")).alias("_within"),
        F.avg(F.abs(act)).alias("_mae0"), F.sqrt(F.avg(act * act)).alias("_rmse0"),
        F.count_if(is_("UP") & (F.col("actual_direction") == "UP") | is_("DOWN") & (F.col("actual_direction") == "DOWN")
                   | is_("NEUTRAL") & (F.col("actual_direction") == "NEUTRAL")).alias("_dir"),
        F.count_if(signed).alias("sign_n"), F.count_if(signed & ((pred > 0) == (act > 0))).alias("sign_hits"),
        F.count_if(is_("UP")).alias("up_n"), F.count_if(is_("UP") & (act > 0)).alias("_up"),
        F.count_if(is_("DOWN")).alias("down_n"), F.count_if(is_("DOWN") & (act < 0)).alias("_down"),
        F.count_if(is_("NEUTRAL")).alias("neutral_n"), F.count_if(is_("NEUTRAL") & (F.col("actual_direction") == "NEUTRAL")).alias("_neutral"),
    ]


def _finish(agg: DataFrame, keys: list[str]) -> DataFrame:
    corr = F.when((F.col("n") >= 3) & (F.col("_sp") > 0) & (F.col("_sa") > 0), F.try_divide("_cov", F.col("_sp") * F.col("_sa")))
    out = agg.withColumn("_z", coin_flip_z(F.col("sign_hits"), F.col("sign_n")))
    return out.select(
        *keys, "n", _r(F.col("_mae")).alias("mae"), _r(F.col("_rmse")).alias("rmse"), _r(F.col("_bias")).alias("bias"),
        _r(F.col("_mp")).alias("mean_predicted"), _r(F.col("_ma")).alias("mean_actual"), _r(corr).alias("correlation"),
        _r(F.col("_mape") * 100).alias("mape"), "mape_n", _ratio(F.col("_within"), F.col("n")).alias("within_1sigma"),
        _r(F.col("_mae0")).alias("no_change_mae"), _r(F.col("_rmse0")).alias("no_change_rmse"),
        _r(F.when(F.col("_mae0") > 0, 1 - F.try_divide("_mae", "_mae0"))).alias("mae_skill"),
        _ratio(F.col("_dir"), F.col("n")).alias("directional_accuracy"), _ratio(F.col("sign_hits"), F.col("sign_n")).alias("sign_accuracy"), "sign_n",
        _r(normal_p("_z")).alias("sign_p_value"), _ratio(F.col("_up"), F.col("up_n")).alias("up_accuracy"), "up_n",
        _ratio(F.col("_down"), F.col("down_n")).alias("down_accuracy"), "down_n",
        _ratio(F.col("_neutral"), F.col("neutral_n")).alias("neutral_accuracy"), "neutral_n")


def metrics(records: DataFrame, *keys: str) -> DataFrame:
    """All core metrics in one aggregation."""
    return _finish(with_outcome_direction(records).groupBy(*keys).agg(*_sums()), list(keys))


def metrics_by_sets(records: DataFrame, sets: list[list[str]]) -> DataFrame:
    """The same for several groupings in a single pass; absent keys read ALL."""
    keys = sorted({k for s in sets for k in s})
    rows = with_outcome_direction(records)
    grouped = rows.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(
        *_sums(), *[F.grouping(k).alias("_g_" + k) for k in keys])
    named = grouped.withColumns({k: F.when(F.col("_g_" + k) == 1, "ALL").otherwise(F.col(k).cast("string")) for k in keys})
    return _finish(named, keys)


def direction_distribution(records: DataFrame, *keys: str) -> DataFrame:
    rows = with_outcome_direction(records)
    n = F.count("*")
    cols = [n.alias("n")]
    for side in ("predicted", "actual"):
        for d in DIRECTIONS:
            hit = F.count_if(F.col(f"{side}_direction") == d)
            cols += [hit.alias(f"{side}_{d.lower()}"), _ratio(hit, n).alias(f"{side}_{d.lower()}_share")]
    cols += [F.count_if(F.col("actual") > 0).alias("sign_up"), F.count_if(F.col("actual") < 0).alias("sign_down"),
             F.count_if(F.col("actual") == 0).alias("sign_zero")]
    return rows.groupBy(*keys).agg(*cols)


def confusion_matrix(records: DataFrame) -> DataFrame:
    """Predicted direction x actual direction, zero-filled."""
    names = records.sparkSession.range(1).select(F.explode(F.array(*[F.lit(d) for d in DIRECTIONS])).alias("predicted_direction"))
    counts = with_outcome_direction(records).groupBy("predicted_direction").pivot("actual_direction", DIRECTIONS).count()
    return names.join(counts, "predicted_direction", "left").fillna(0, DIRECTIONS)


def error_stats(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """MAE, RMSE, bias, correlation, directional and sign accuracy of any forecast column."""
    pred, act, band = F.col(value), F.col("actual"), F.col("neutral_threshold_pct")
    err, pdir, adir = pred - act, direction(pred, band), direction(act, band)
    signed = (pdir != "NEUTRAL") & (act != 0)
    agg = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.abs(err)).alias("_mae"), F.sqrt(F.avg(err * err)).alias("_rmse"), F.avg(err).alias("_bias"),
        F.avg((pdir == adir).cast("double")).alias("_dir"), F.count_if(signed).alias("sign_n"),
        F.count_if(signed & ((pred > 0) == (act > 0))).alias("_hits"), F.stddev_pop(pred).alias("_sp"), F.stddev_pop(act).alias("_sa"),
        F.covar_pop(pred, act).alias("_cov"))
    corr = F.when((F.col("n") > 2) & (F.col("_sp") > 1e-12) & (F.col("_sa") > 0), F.try_divide("_cov", F.col("_sp") * F.col("_sa")))
    return agg.select(*keys, "n", _r(F.col("_mae")).alias("mae"), _r(F.col("_rmse")).alias("rmse"), _r(F.col("_bias")).alias("bias"),
                      _r(corr).alias("correlation"), _r(F.col("_dir")).alias("directional_accuracy"),
                      _ratio(F.col("_hits"), F.col("sign_n")).alias("sign_accuracy"), "sign_n")


def direction_counts(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """How often a forecast column says up, down and neutral, and how often each came true to be."""
    sides = {"predicted": direction(F.col(value), F.col("neutral_threshold_pct")), "actual": direction(F.col("actual"), F.col("neutral_threshold_pct"))}
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_if(c == d).alias(f"{side}_{d.lower()}") for side, c in sides.items() for d in DIRECTIONS])


def with_all_baselines(records: DataFrame, baselines: list[str]) -> DataFrame:
    """Records that no baseline lacks: the common sample of every comparison."""
    return records.dropna(subset=baselines)


def baseline_comparison(records: DataFrame, baselines: list[str]) -> DataFrame:
    """Model against each baseline on exactly the same rows: one row per forecast."""
    rows = with_all_baselines(records, baselines)
    long = rows.select("actual", "neutral_threshold_pct", F.explode(F.array(
        F.struct(F.lit("model").alias("forecast"), F.col("predicted").alias("value")),
        *[F.struct(F.lit(b).alias("forecast"), F.col(b).alias("value")) for b in baselines])).alias("f")).select(
        "actual", "neutral_threshold_pct", "f.forecast", "f.value")
    stats = error_stats(long, "value", "forecast")
    model = stats.where(F.col("forecast") == "model").select(F.col("mae").alias("_model_mae"))
    own = F.col("forecast") == "model"
    return stats.crossJoin(F.broadcast(model)).select(
        *stats.columns, F.when(~own & (F.col("mae") > 0), _r(1 - F.try_divide("_model_mae", "mae"))).alias("model_mae_skill"),
        F.when(~own, F.col("_model_mae") < F.col("mae")).alias("model_beats"))


def value_ranks(df: DataFrame, key: str, value: str, buckets: int = 256) -> DataFrame:
    """(key, value, n, before): copies of each value and how many rows are smaller - an exact distributed rank.

    Equal values are combined first; values are then split into approximate quantile buckets, counted per bucket,
    and only the bucket offsets (small) are accumulated. No key is ever sorted in one task.
    """
    counts = df.groupBy(key, value).agg(F.count("*").alias("n"))
    cuts = counts.groupBy(key).agg(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 10_000).alias("_cuts"))
    placed = counts.join(F.broadcast(cuts), key).withColumn(
        "_b", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    offsets = placed.groupBy(key, "_b").agg(F.sum("n").alias("_t"))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select(key, "_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(key, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("_in", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(F.broadcast(offsets), [key, "_b"])
        .select(key, value, "n", (F.col("_offset") + F.col("_in")).alias("before"))
    )


def with_rank(rows: DataFrame, ranks: DataFrame, value: str, out: str) -> DataFrame:
    """Add the mean rank of ``value`` within its feature. The most frequent value of each feature - zero, for sparse inputs, may hold
    most rows - gets its rank from a broadcast row per feature, so only the other values are joined by (feature, value)."""
    mean = (F.col("before") + (F.col("n") + 1) / 2).alias(out)
    hot = ranks.groupBy("feature").agg(F.max_by(F.struct(F.col(value).alias("_hot"), mean), F.struct("n", value)).alias("_h")).select("feature", "_h._hot", F.col(f"_h.{out}").alias("_rank"))
    marked = rows.join(F.broadcast(hot), "feature")
    often = marked.where(F.col(value) == F.col("_hot")).withColumn(out, F.col("_rank"))
    rest = marked.where(F.col(value) != F.col("_hot")).join(ranks.select("feature", value, mean), ["feature", value])
    return often.drop("_hot", "_rank").unionByName(rest.drop("_hot", "_rank"))


def feature_analysis(records: DataFrame, features: list[str], target: str = "actual") -> DataFrame:
    """Univariate relation of every model input with the realised return (one row per feature)."""
    long = records.select(F.col(target).cast("double").alias("y"), F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("f")).select("y", "f.feature", "f.x")
    known = F.col("x").isNotNull() & ~F.isnan("x")
    valid = long.where(known).select("feature", "x", "y")
    xr = value_ranks(valid, "feature", "x")
    yr = value_ranks(valid, "feature", "y")
    totals = long.groupBy("feature").agg(F.count_if(known).alias("n"), F.count_if(~known).alias("missing"))

    sized = xr.join(F.broadcast(totals.select("feature", F.col("n").alias("total"))), "feature")
    covers = lambda i: (F.col("before") <= i) & (i < F.col("before") + F.col("n"))
    quantile = {}
    for name, q in (("q_lo", 0.2), ("q_hi", 0.8)):
        spot = (F.col("total") - 1) * F.lit(q)
        quantile[name] = (F.max(F.when(covers(F.floor(spot)), F.col("x"))), F.max(F.when(covers(F.ceil(spot)), F.col("x"))),
                          F.max(spot - F.floor(spot)))
    bounds = sized.groupBy("feature").agg(*[e.alias(f"{n}_{i}") for n, es in quantile.items() for i, e in enumerate(es)])
    bounds = bounds.select("feature", *[(F.col(f"{n}_0") + (F.col(f"{n}_1") - F.col(f"{n}_0")) * F.col(f"{n}_2")).alias(n) for n in quantile])

    ranked = with_rank(with_rank(valid, xr, "x", "rx"), yr, "y", "ry").join(F.broadcast(bounds), "feature")
    nz = (F.col("x") != 0) & (F.col("y") != 0)
    agg = ranked.groupBy("feature").agg(
        F.avg("x").alias("_mean"), F.stddev_pop("x").alias("_sx"), F.stddev_pop("y").alias("_sy"), F.avg((F.col("x") != 0).cast("double")).alias("_nz"),
        F.covar_pop("x", "y").alias("_cov"), F.covar_pop("rx", "ry").alias("_rcov"), F.stddev_pop("rx").alias("_srx"), F.stddev_pop("ry").alias("_sry"),
        F.count_if(nz).alias("sign_n"), F.avg(F.when(nz, (F.signum("x") == F.signum("y")).cast("double"))).alias("_agree"),
        F.avg(F.when(F.col("x") >= F.col("q_hi"), F.col("y"))).alias("_top"), F.avg(F.when(F.col("x") <= F.col("q_lo"), F.col("y"))).alias("_bottom"),
        F.max("q_hi").alias("_qh"), F.max("q_lo").alias("_ql"))
    out = totals.join(agg, "feature", "left")
    spread_ok = (F.col("_sx") > 0) & (F.col("_sy") > 0) & (F.col("n") >= 3)
    corr = F.when(spread_ok, F.try_divide("_cov", F.col("_sx") * F.col("_sy")))
    out = out.withColumn("_corr", corr)
    t = F.when((F.col("n") >= 4) & (F.abs("_corr") < 1), F.col("_corr") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("_corr") * F.col("_corr"))))
    enough = F.col("n") >= 3
    out = out.withColumn("_p", _r(normal_p(t)))
    return out.select(
        "feature", "n", "missing", F.when(enough, _r(F.col("_mean"))).alias("mean"), F.when(enough, _r(F.col("_sx"))).alias("std"),
        F.when(enough, _r(F.col("_nz"))).alias("share_nonzero"), _r(F.col("_corr")).alias("correlation"), F.col("_p").alias("p_value"),
        F.when(spread_ok, _r(F.try_divide("_rcov", F.col("_srx") * F.col("_sry")))).alias("rank_correlation"),
        F.when(enough & (F.col("sign_n") >= 10), _r(F.col("_agree"))).alias("sign_agreement"), F.when(enough, F.col("sign_n")).alias("sign_n"),
        F.when(enough & (F.col("_qh") > F.col("_ql")), _r(F.col("_top") - F.col("_bottom"))).alias("top_minus_bottom"),
        F.when(F.col("_corr").isNotNull(), F.when(F.col("_corr") > 0, "positive").otherwise("negative")).alias("direction"),
        F.when(enough, F.coalesce(F.col("_p") < 0.05, F.lit(False))).alias("informative"))


def paired_test(records: DataFrame, model: str, baseline: str, *keys: str, date: str = "as_of_date") -> DataFrame:
    """Is the model's absolute error smaller? Loss differences are averaged per date, then a one-sided t test over dates."""
    diff = F.abs(F.col(model) - F.col("actual")) - F.abs(F.col(baseline) - F.col("actual"))
    daily = records.groupBy(*keys, date).agg(F.avg(diff).alias("_d"))
    agg = daily.groupBy(*keys).agg(F.count("*").alias("n_dates"), F.avg("_d").alias("_mean"), F.stddev_samp("_d").alias("_sd"))
    enough = (F.col("n_dates") >= 5) & (F.col("_sd") > 0)
    agg = agg.withColumn("_t", F.when(enough, F.try_divide("_mean", F.col("_sd") / F.sqrt("n_dates"))))
    agg = agg.withColumn("_p", t_upper_p(-F.col("_t"), (F.col("n_dates") - 1).cast("double")))
    return agg.select(
        *keys, "n_dates", F.when(F.col("n_dates") >= 5, _r(F.col("_mean"), 5)).alias("mean_loss_diff"), _r(F.col("_t")).alias("t"),
        _r(F.col("_p")).alias("p_value_improvement"), F.coalesce((F.col("_mean") < 0) & (F.col("_p") < 0.05), F.lit(False)).alias("significant"))


def objective(metric_rows: DataFrame, name: str) -> DataFrame:
    """Lower is better; an empty evaluation is infinitely bad."""
    column = {"mae": F.col("mae"), "rmse": F.col("rmse"), "directional_accuracy": -F.coalesce("directional_accuracy", F.lit(0.0)),
              "correlation": -F.coalesce("correlation", F.lit(0.0))}[name]
    return metric_rows.withColumn("objective", F.when(F.col("n") == 0, F.lit(float("inf"))).otherwise(column))


def classifier_scores(df: DataFrame, probability: str, outcome: str, base_rate: float, *keys: str) -> DataFrame:
    """Log-loss, Brier score, accuracy, and the majority-class baseline of a probability column (outcome in {0, 1})."""
    p, y = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(probability))), F.col(outcome).cast("double")
    majority = 1.0 if base_rate >= 0.5 else 0.0
    hits = F.count_if((F.col(probability) >= 0.5) == (y == 1))
    n = F.count("*")
    return df.groupBy(*keys).agg(
        n.alias("n"), _r(-F.avg(y * F.log(p) + (1 - y) * F.log(1 - p)), 6).alias("log_loss"), _r(F.avg(F.pow(F.col(probability) - y, 2)), 6).alias("brier"),
        _r(F.avg(F.pow(F.lit(base_rate) - y, 2)), 6).alias("brier_base_rate"), _ratio(hits, n).alias("accuracy"),
        _ratio(F.count_if(y == majority), n).alias("majority_accuracy"), _ratio(F.count_if(F.col(probability) >= 0.5), n).alias("share_predicted_up"))
