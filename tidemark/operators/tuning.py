"""Parameter search with a chronological train / validation / test split. Trials are rows of a broadcast table."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timestamps import session_close
from tidemark.operators import flow as flow_ops
from tidemark.operators import market, predict, replay, scores
from tidemark.operators import metrics as metric_ops
from tidemark.operators.calendar import CutoffGrid
from tidemark.operators.models import chronological_split
from tidemark.operators.predict import factor_predict
from tidemark.operators.scores import MACRO
from tidemark.operators.universe import members_asof
from tidemark.session import cut_lineage, local_frame

#: Fewest dates to train and to validate on.
MIN_DATES = (5, 3)
NEWS_KEYS = ["recency_half_life_scale", "shrinkage_k", "macro_weight_in_index", "price_report_weight"]
MODEL_KEYS = ["w_company", "w_macro", "w_index", "sensitivity", "drift_weight", "max_sigma_clip", "neutral_threshold_sigma"]


def sample_trials(base: dict[str, dict], space: dict[str, tuple], n: int, seed: int = 42) -> list[dict[str, dict]]:
    """Seeded uniform samples inside the bounds, four decimals; trial 0 is the base set itself."""
    rng = random.Random(seed)
    out = [{s: dict(v) for s, v in base.items()}]
    for _ in range(n):
        trial = {s: dict(v) for s, v in base.items()}
        for path, (lo, hi) in space.items():
            section, key = path.split(".")
            trial[section][key] = round(rng.uniform(lo, hi), 4)
        out.append(trial)
    return out


def trial_table(spark, trials: list[dict[str, dict]], indices=None) -> DataFrame:
    rows = [(i, *[float(trials[i]["model"][k]) for k in MODEL_KEYS]) for i in (indices if indices is not None else range(len(trials)))]
    return local_frame(spark, rows, "trial int, " + ", ".join(f"t_{k} double" for k in MODEL_KEYS))


def score_trials(inputs: DataFrame, trials: DataFrame) -> DataFrame:
    """Evaluation rows x trials. Inputs that do not depend on the trial are computed once, upstream."""
    drop = ["predicted", "predicted_price", "predicted_direction", "sigma_pct", "signal", "neutral_threshold_pct"]
    base = inputs.drop(*[c for c in drop if c in inputs.columns])
    crossed = base.crossJoin(F.broadcast(trials))
    scored = factor_predict(crossed, None, prefix="t_")
    return scored.withColumn("neutral_threshold_pct", F.col("t_neutral_threshold_sigma") * F.col("sigma_pct"))


def trial_inputs(x: replay.Inputs, grid: CutoffGrid, trials: list[dict[str, dict]]) -> DataFrame:
    """Evaluation rows (trial, session, ticker, horizon) with the signals of every trial's news parameters, from one stage over the stories.

    Parameters that act on single stories (half-life scale, baseline length) are laid out as arrays or scopes over the different values that
    occur; all others act on sums whose number is bounded by calendar, universe and trials. Baselines longer than the news reaches back are the same one.
    """
    spark, p = x.items.sparkSession, x.news_params
    first = x.items.agg(F.min("available_at")).first()[0]
    reach = max(1.0, (max(r[1] for r in grid.rows) - first).total_seconds() / 86_400 + 8) if first is not None else 1.0
    news = [t["news"] for t in trials]
    scales = sorted({float(n["recency_half_life_scale"]) for n in news})
    baselines = sorted({min(float(n["baseline_days"]), reach) for n in news})
    table = local_frame(spark, [(i, scales.index(float(n["recency_half_life_scale"])), baselines.index(min(float(n["baseline_days"]), reach)), *(float(n[k]) for k in NEWS_KEYS))
                                for i, n in enumerate(news)], "trial int, scale_no int, baseline_no int, t_scale double, t_shrinkage double, t_macro_weight double, t_price_report double")
    hz = replay.horizon_rows(x, grid)
    targets = cut_lineage(scores.targets_of(hz, grid, session_close(F.col("target_date"))))
    cut = grid.frame().select("pos", "session")
    uni = members_asof(x.members, cut.select(F.col("session").alias("day"))).join(F.broadcast(cut), F.col("day") == F.col("session")).select(
        "pos", F.col("version").alias("universe_version"), F.col("ticker").alias("entity"), "weight")
    uni = cut_lineage(uni.join(x.catalog.select(F.col("ticker").alias("entity"), "sector"), "entity"))
    hkeys = ["pos", "horizon_type", "target_date"]

    sums = cut_lineage(scores.faded_sums(scores.trial_grains(x.items, grid, p, table, scales, x.policy), targets, grid, {"recency_half_life_scale": F.col("t_scale")}, ("trial", "t_scale")))
    sens = predict.macro_sensitivity(scores.category_breakdown(sums, ("trial",)), x.catalog, x.sensitivity, x.default_sensitivity, ("trial",))
    wanted = targets.select(*hkeys, "session").join(uni, "pos").join(F.broadcast(table.select("trial")))
    if x.model_params.get("sentiment_input", "raw") == "relative":
        flow = cut_lineage(flow_ops.flow_of(flow_ops.trial_flow_grains(x.items, grid, p, table, baselines, x.policy), grid, uni.select("pos", "entity"), p, table))
        own = flow.where(F.col("entity") != MACRO).select("trial", "pos", "entity", F.col("relative_sentiment").alias("s_company"))
        macro = flow.where(F.col("entity") == MACRO).select("trial", "pos", F.col("relative_sentiment").alias("s_macro"))
        index = flow_ops.index_relative(flow, uni.select("pos", "entity", "weight"), ("trial",)).withColumnRenamed("index_relative", "s_index")
        rows = wanted.join(own, ["trial", "pos", "entity"], "left").join(macro, ["trial", "pos"], "left").join(index, ["trial", "pos"], "left")
    else:
        everyone = uni.select("pos", "entity", "weight").unionByName(cut.select("pos", F.lit(MACRO).alias("entity"), F.lit(0.0).alias("weight")))
        expected = targets.select(*hkeys, "session").join(everyone, "pos").join(F.broadcast(table.select("trial", "t_shrinkage", "t_macro_weight")))
        scored = cut_lineage(scores.entity_scores(sums, expected, {"shrinkage_k": F.col("t_shrinkage")}, ("trial",)))
        index = scores.index_scores(scored, {"macro_weight_in_index": F.first("t_macro_weight")}, ("trial",)).select("trial", *hkeys, F.col("company_weighted").alias("s_index"))
        own = scored.where(F.col("entity") != MACRO).select("trial", *hkeys, "entity", F.col("score").alias("s_company"))
        macro = scored.where(F.col("entity") == MACRO).select("trial", *hkeys, F.col("score").alias("s_macro"))
        rows = wanted.join(own, ["trial", *hkeys, "entity"], "left").join(macro, ["trial", *hkeys], "left").join(index, ["trial", *hkeys], "left")
    sessions = x.calendar.lookup(cut.select("session"), F.col("session"), "previous_session")
    features = market.market_features(x.bars, x.index_bars, sessions, x.model_params).where("missing_reason IS NULL AND n_obs IS NOT NULL").select(
        "session", F.col("ticker").alias("entity"), "previous_close", "daily_vol", "daily_drift", "beta")
    outcome = x.bars.select(F.col("ticker").alias("entity"), F.col("date").alias("target_date"), F.col("close").alias("actual_close"))
    ahead = targets.select(*hkeys, "trading_days_ahead")
    out = rows.join(sens, ["trial", *hkeys, "sector"], "left").join(features, ["session", "entity"]).join(outcome, ["entity", "target_date"]).join(ahead, hkeys)
    return out.select(
        "trial", "session", F.col("session").alias("as_of_date"), F.col("entity").alias("ticker"), "horizon_type", "target_date", "trading_days_ahead", "previous_close", "daily_vol", "daily_drift", "beta",
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("s_company", "s_macro", "s_index")], F.coalesce("macro_sens", F.lit(float(x.default_sensitivity))).alias("macro_sens"),
        F.bround((F.col("actual_close") / F.col("previous_close") - 1) * 100, 4).alias("actual"))


def search(x: replay.Inputs, grid: CutoffGrid, trials: list[dict[str, dict]], objective: str = "mae", train_end=None, valid_end=None,
           fractions: tuple[float, float] = (0.6, 0.2)) -> dict[str, DataFrame]:
    """Random search over news and model parameters: one story stage for all trials, however their news parameters differ."""
    rows = chronological_split(cut_lineage(trial_inputs(x, grid, trials)), train_end, valid_end, fractions)
    _check_dates(rows)
    scored = factor_predict(rows.join(F.broadcast(trial_table(x.items.sparkSession, trials)), "trial"), None, prefix="t_").withColumn(
        "neutral_threshold_pct", F.col("t_neutral_threshold_sigma") * F.col("sigma_pct"))
    return _judged(cut_lineage(scored), objective)


def _check_dates(rows: DataFrame) -> None:
    dates = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.countDistinct("as_of_date").alias("n")).collect()}
    if dates.get("train", 0) < MIN_DATES[0] or dates.get("validation", 0) < MIN_DATES[1]:
        raise ValueError(f"a search needs {MIN_DATES[0]} dates to train and {MIN_DATES[1]} to validate on, not {dates}")


def _judged(scored: DataFrame, objective: str) -> dict[str, DataFrame]:
    results = metric_ops.objective(metric_ops.metrics(scored, "trial", "part"), objective)
    tests = metric_ops.paired_test(scored.withColumn("zero", F.lit(0.0)), "predicted", "zero", "trial", "part")
    return {"results": results, "tests": tests}


def sweep(make_inputs, trials: list[dict[str, dict]], spark, objective: str = "mae", train_end=None, valid_end=None,
          fractions: tuple[float, float] = (0.6, 0.2)) -> dict[str, DataFrame]:
    """Random search. ``make_inputs(news_params)`` returns evaluation rows (see ``replay.records``).

    Trials sharing their news parameters share one replay; only model parameters are crossed with the rows. The
    candidate is chosen on train, gated on validation against the base set and no-change, and vetoed by the test.
    """
    groups: dict[tuple, list[int]] = {}
    enough = False
    for i, t in enumerate(trials):
        groups.setdefault(tuple(sorted((k, str(v)) for k, v in t["news"].items())), []).append(i)
    scored = None
    for members in groups.values():
        rows = chronological_split(make_inputs(trials[members[0]]["news"]), train_end, valid_end, fractions)
        if not enough:
            _check_dates(rows)
            enough = True
        part = score_trials(rows, trial_table(spark, trials, members))
        scored = part if scored is None else scored.unionByName(part)
    return _judged(scored, objective)


def verdict(results: DataFrame, tests: DataFrame) -> DataFrame:
    """One row: chosen trial, its objectives and whether it is recommended (never activated automatically)."""
    wide = results.groupBy("trial").pivot("part", ["train", "validation", "test"]).agg(
        F.first("objective").alias("objective"), F.first("mae").alias("mae"), F.first("no_change_mae").alias("zero"))
    sig = tests.where("part = 'test'").select("trial", F.col("significant").alias("test_significant"))
    rows = wide.join(sig, "trial", "left")
    best = rows.agg(F.min(F.struct("train_objective", "trial")).alias("b")).select(F.col("b.trial").alias("trial"))
    base = rows.where("trial = 0").select(F.col("validation_objective").alias("base_validation"))
    out = rows.join(F.broadcast(best), "trial").crossJoin(F.broadcast(base))
    improved = (F.col("trial") != 0) & (F.col("validation_objective") < F.col("base_validation"))
    beats_valid = F.col("validation_mae") < F.col("validation_zero")
    beats_test = (F.col("test_mae") < F.col("test_zero")) & F.coalesce("test_significant", F.lit(False))
    return out.select(
        "trial", "train_objective", "validation_objective", "base_validation", "test_objective",
        F.coalesce(improved & beats_valid & beats_test, F.lit(False)).alias("recommended"),
        F.when(F.col("trial") == 0, "no trial beat the active parameters on train").when(~improved, "did not improve on validation")
        .when(~beats_valid, "does not beat no-change on validation").when(F.col("test_mae").isNull(), "no test period")
        .when(~beats_test, "does not significantly beat no-change on test").otherwise("passed validation and test").alias("reason"))
