"""Calendars, features, forecasts, metrics, fitting and stored tables by hand."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.tails import t_upper
from tidemark.operators import market, metrics, models, outcomes, snapshots, tuning, universe
from tidemark.operators.calendar import Calendar, horizons
from tidemark.operators.predict import factor_predict, linear_predict
from tidemark.params import MODEL_PARAMS, SEARCH_SPACE, complete, default_params

RECORD = "as_of_date date, ticker string, predicted double, actual double, sigma_pct double, predicted_direction string, neutral_threshold_pct double"


def weekdays(start, n):
    out = []
    while len(out) < n:
        if start.weekday() < 5:
            out.append(start)
        start += dt.timedelta(days=1)
    return out


def test_horizons(spark):
    cal = Calendar.weekdays(spark, dt.date(2026, 9, 1), dt.date(2028, 12, 31))
    rows = horizons(spark.createDataFrame([(dt.date(2026, 10, 1),)], "day date"), cal).collect()
    by = {}
    for r in rows:
        by.setdefault(r["horizon_type"], []).append(r)
    months = sorted(by["month_end"], key=lambda r: r["target_date"])
    quarters = sorted(by["quarter_end"], key=lambda r: r["target_date"])
    assert len(months) == 3 and str(months[0]["target_date"]) == "2026-10-30" and months[0]["trading_days_ahead"] == 22
    assert [q["horizon_label"] for q in quarters[:2]] == ["Q3 FY27 end", "Q4 FY27 end"] and len(quarters) == 6
    assert by["today"][0]["horizon_label"] == "Today" and by["today"][0]["trading_days_ahead"] == 1


def test_universe_versions(spark):
    d = dt.date
    rows = [("a", "X", 2.0, d(2020, 1, 1), None, "confirmed"), ("a", "Y", 1.0, d(2020, 1, 1), None, "confirmed"), ("b", "X", 2.0, d(2026, 9, 30), None, "confirmed"),
            ("c", "Z", 1.0, d(2027, 1, 1), None, "requires_confirmation")]
    m = spark.createDataFrame(rows, "version string, ticker string, weight double, effective_from date, effective_to date, status string")
    days = spark.createDataFrame([(d(2026, 9, 1) + dt.timedelta(days=i),) for i in range(45)], "day date")
    p = sorted((str(r["date_from"]), str(r["date_to"]), r["version"]) for r in universe.universe_periods(m, days).collect())
    assert p == [("2026-09-01", "2026-09-29", "a"), ("2026-09-30", "2026-10-15", "b")]
    new = spark.createDataFrame([(d(2027, 2, 1),)], "day date")
    diff = {(r["ticker"], r["change"]) for r in universe.membership_diff(m, new).collect()}
    assert diff == {("Z", "would_add"), ("X", "would_remove")}
    log = spark.createDataFrame([("c", dt.datetime(2027, 1, 2))], "version string, confirmed_at timestamp_ntz")
    assert [r["version"] for r in universe.universe_asof(universe.confirm(m, log).drop("confirmed_at"), new).collect()] == ["c"]
    assert {r["ticker"] for r in universe.ever_confirmed(m).collect()} == {"X", "Y"}


def test_market_features_strictly_prior_and_stale(spark):
    rng = random.Random(5)
    days = weekdays(dt.date(2024, 1, 1), 60)
    closes = [100.0]
    for _ in days[1:]:
        closes.append(closes[-1] * math.exp(rng.gauss(0, 0.01)))
    bars = spark.createDataFrame([("A", d, c) for d, c in zip(days, closes)], "ticker string, date date, close double")
    index = spark.createDataFrame([(d, c * 2) for d, c in zip(days, closes)], "date date, close double")
    ask = spark.createDataFrame([(days[40], days[39]), (days[10], days[9])], "session date, previous_session date")
    rows = {r["session"]: r for r in market.market_features(bars, index, ask, MODEL_PARAMS, True).collect()}
    r = rows[days[40]]
    logs = np.diff(np.log(closes[:40]))
    assert r["previous_close"] == closes[39] and r["daily_vol"] == pytest.approx(logs.std(ddof=1)) and r["beta"] == pytest.approx(1.0)
    assert r["rolling_return_20d"] == pytest.approx((closes[39] / closes[19] - 1) * 100)
    assert rows[days[10]]["missing_reason"].startswith("only 10 closes")
    tampered = bars.withColumn("close", F.when(F.col("date") >= F.lit(days[40]), F.col("close") * 9).otherwise(F.col("close")))
    again = {x["session"]: x for x in market.market_features(tampered, index, ask, MODEL_PARAMS, True).collect()}
    assert again[days[40]] == r
    gap = market.market_features(bars.where(F.col("date") != F.lit(days[39])), index, ask, MODEL_PARAMS, True).where(F.col("session") == F.lit(days[40])).first()
    assert "not available" in gap["missing_reason"]


def test_factor_model_clips_and_contributions_sum(spark):
    df = spark.createDataFrame([(100.0, 0.01, 0.0, 1.0, 4, 50.0, 0.0, 1.0, 0.0)],
                               "previous_close double, daily_vol double, daily_drift double, beta double, trading_days_ahead int, s_company double, s_macro double, macro_sens double, s_index double")
    r = factor_predict(df, {**MODEL_PARAMS, "sensitivity": 100.0}).first()
    assert r["predicted"] == pytest.approx((math.exp(3 * 0.02) - 1) * 100, abs=1e-4) and r["predicted_direction"] == "UP"
    assert r["c_company_sentiment"] == pytest.approx(6.0)
    raw = factor_predict(df, {**MODEL_PARAMS, "sentiment_input": "raw"}).first()
    assert raw["predicted"] == pytest.approx((math.exp(0.5 * 0.02 * 0.5) - 1) * 100, abs=1e-4)


def test_linear_model_horizon_rule(spark):
    model = {"kind": "ridge", "features": ["x"], "coef": [0.5], "mean": [0.0], "std": [1.0], "intercept": 0.3, "alpha": 0.1, "n_train": 5}
    df = spark.createDataFrame([(100.0, 0.05, 1, 2.0), (100.0, 0.05, 20, 2.0), (100.0, 0.05, 1, None)], "previous_close double, daily_vol double, trading_days_ahead int, x double")
    assert [r["predicted"] for r in linear_predict(df, model, MODEL_PARAMS).collect()] == [1.3, 1.0, 0.3]


def test_metrics_by_hand(spark):
    d = dt.date(2026, 1, 1)
    rows = [(d, "A", 1.0, 2.0, 1.0, "UP", 0.1), (d, "A", -1.0, -0.5, 1.0, "DOWN", 0.1), (d, "A", 0.5, -1.0, 1.0, "UP", 0.1), (d, "A", 0.0, 0.05, 1.0, "NEUTRAL", 0.1)]
    m = metrics.metrics(spark.createDataFrame(rows, RECORD)).first()
    assert (m["n"], m["mae"], m["directional_accuracy"], m["mape_n"]) == (4, 0.7625, 0.75, 3)
    assert m["sign_accuracy"] == pytest.approx(0.6667) and m["sign_p_value"] is None and m["neutral_accuracy"] == 1.0
    c = {r["predicted_direction"]: r for r in metrics.confusion_matrix(spark.createDataFrame(rows, RECORD)).collect()}
    assert (c["UP"]["UP"], c["UP"]["DOWN"], c["NEUTRAL"]["NEUTRAL"]) == (1, 1, 1)


def test_tail_and_paired_test(spark):
    assert t_upper(2.086, 20) == pytest.approx(0.025, abs=1e-3) and t_upper(-2.086, 20) == pytest.approx(0.975, abs=1e-3)
    rng = random.Random(1)
    rows = []
    for i in range(40):
        for t in "AB":
            y = rng.gauss(0, 1)
            rows.append((dt.date(2026, 1, 1) + dt.timedelta(days=i), t, y, y * 0.2, y + rng.gauss(0, 3), 0.0))
    df = spark.createDataFrame(rows, "as_of_date date, ticker string, actual double, good double, bad double, zero double")
    good = metrics.paired_test(df.withColumn("good", F.col("actual") * 0.9), "good", "zero").first()
    assert good["significant"] and good["n_dates"] == 40
    assert not metrics.paired_test(df, "bad", "zero").first()["significant"] and not metrics.paired_test(df, "zero", "zero").first()["significant"]


def test_value_ranks_with_a_hot_value(spark):
    rng = random.Random(2)
    xs = [0.0] * 300 + [round(rng.gauss(0, 1), 2) for _ in range(600)]
    df = spark.createDataFrame([("f", x) for x in xs], "k string, x double")
    ordered = sorted(xs)
    for r in metrics.value_ranks(df, "k", "x", buckets=8).collect():
        assert r["before"] == ordered.index(r["x"]) and r["n"] == xs.count(r["x"])


def _sample(n=400, seed=0):
    rng = np.random.default_rng(seed)
    x, z = rng.normal(size=n), rng.normal(size=n)
    return x, z, 0.3 + 0.5 * x + 0.05 * rng.normal(size=n)


def test_ridge_and_missing_values_match_direct_solution(spark):
    x, z, y = _sample()
    rows = [(float(a), None if i % 5 == 0 else float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, z, y))]
    df = spark.createDataFrame(rows, "x double, z double, actual double").repartition(5)
    got = models.fit_ridge(df, ["x", "z"], [0.1])[0]
    raw = np.array([[a, np.nan if b is None else b] for a, b, _ in rows])
    mean, std = np.nanmean(raw, axis=0), np.nanstd(raw, axis=0)
    design = np.nan_to_num((raw - mean) / std)
    want = np.linalg.solve(design.T @ design + 0.1 * len(y) * np.eye(2), design.T @ (y - y.mean()))
    assert got["coef"] == pytest.approx(want.tolist(), abs=1e-7) and got["intercept"] == pytest.approx(y.mean())
    assert models.fit_ridge(df, [], [0.0])[0]["intercept"] == pytest.approx(y.mean())


def test_logistic_matches_direct_newton(spark):
    x, _, y = _sample(seed=3)
    up = (y > 0.3).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, up)], "x double, up int")
    got = models.fit_logistic(df, ["x"], 0.01, "up")
    zs = (x - x.mean()) / x.std()
    design, w = np.column_stack([np.ones_like(zs), zs]), np.zeros(2)
    pen = np.diag([0.0, 0.01 * len(x)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        w = w - np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + pen, design.T @ (p - up) + pen @ w)
    assert [got["intercept"], *got["coef"]] == pytest.approx(w.tolist(), abs=1e-6)


def test_split_and_selection_ignore_test_outcomes(spark):
    x, z, y = _sample(300, 4)
    days = [dt.date(2026, 1, 1) + dt.timedelta(days=i // 3) for i in range(300)]
    df = spark.createDataFrame([(d, float(a), float(b), float(c)) for d, a, b, c in zip(days, x, z, y)], "as_of_date date, x double, z double, actual double")
    parts = models.chronological_split(df)
    n = {r["part"]: r["count"] for r in parts.groupBy("part").count().collect()}
    assert n == {"train": 180, "validation": 60, "test": 60}
    noisy = parts.withColumn("actual", F.when(F.col("part") == "test", F.rand(1) * 50).otherwise(F.col("actual")))
    seen = []
    for rows in (parts, noisy):
        m = models.Moments.from_rows(["x", "z"], models.moments(rows.where("part = 'train'"), ["x", "z"]).collect())
        picked = models.select_all(m, rows.where("part = 'validation'"), {"a": ["x"], "b": ["z"]})
        assert picked["a"][0]["coef"][0] == pytest.approx(0.5, abs=0.1)
        seen.append({k: (m["alpha"], m["coef"]) for k, (m, _) in picked.items()})
    assert seen[0] == seen[1]


def test_parameter_tables(spark):
    assert complete({"news": {}, "model": {}})["model"]["sentiment_input"] == "raw"
    a, b = default_params(), default_params()
    b["news"]["shrinkage_k"] = 2.0
    old, new = snapshots.parameter_rows(spark, "a", a), snapshots.parameter_rows(spark, "b", b)
    assert [tuple(r) for r in snapshots.parameter_diff(old, new).collect()] == [("news.shrinkage_k", "1.0", "2.0")]
    prints = {r["version"]: r["fingerprint"] for r in snapshots.fingerprints(old.unionByName(new).unionByName(old.withColumn("version", F.lit("c")))).collect()}
    assert len(prints["a"]) == 10 and prints["a"] == prints["c"] != prints["b"]
    at = lambda h: dt.datetime(2026, 1, 1, h)
    log = spark.createDataFrame([("v1", "created", at(1)), ("v1", "activated", at(2)), ("v2", "created", at(3)), ("v3", "created", at(3)), ("v3", "activated", at(4))],
                                "version string, action string, at timestamp_ntz")
    assert {r["version"]: r["status"] for r in snapshots.parameter_status(log).collect()} == {"v1": "archived", "v2": "candidate", "v3": "active"}
    trials = tuning.sample_trials({"news": dict(a["news"]), "model": dict(a["model"])}, SEARCH_SPACE, 3)
    assert len(trials) == 4 and trials[0]["model"] == a["model"] and trials == tuning.sample_trials({"news": dict(a["news"]), "model": dict(a["model"])}, SEARCH_SPACE, 3)


def test_outcome_classification(spark):
    d, t = dt.date, dt.datetime
    preds = [(1, "A", d(2026, 9, 29)), (2, "A", d(2026, 9, 30)), (3, "B", d(2026, 9, 29)), (4, "C", d(2026, 9, 29))]
    p = spark.createDataFrame([(*x, 100.0, 1.0, 2.0, "UP", "OK", "v1", False) for x in preds],
                              "prediction_id long, ticker string, target_date date, previous_close double, predicted_movement double, uncertainty_1sigma_pct double, predicted_direction string, status string, param_version string, is_backtest boolean")
    bars = spark.createDataFrame([("A", d(2026, 9, 29), 101.5), ("B", d(2026, 9, 30), 9.0)], "ticker string, date date, close double")
    thr = spark.createDataFrame([("v1", 0.1)], "param_version string, neutral_threshold_sigma double")
    rows, state = outcomes.match_outcomes(p, p.select("prediction_id").limit(0), bars, thr, F.lit(t(2026, 9, 29, 11, 0).isoformat(" ")).cast("timestamp_ntz"))
    assert {r["prediction_id"]: r["maturity"] for r in state.collect()} == {1: "scored", 2: "not_matured", 3: "missing_target_price", 4: "awaiting_price"}
    r = rows.first()
    assert (r["actual_movement"], r["error"], r["abs_error"], r["squared_error"], r["direction_correct"]) == (1.5, -0.5, 0.5, 0.25, True)


def test_ranks_of_a_mostly_zero_feature(spark):
    import pandas as pd

    rng = random.Random(2)
    rows = [("f", 0.0 if rng.random() < 0.9 else float(rng.randint(-3, 3)), rng.gauss(0, 1)) for _ in range(400)] + [("g", 1.0, float(i % 3)) for i in range(30)]
    df = spark.createDataFrame(rows, "feature string, x double, y double")
    ranks = metrics.value_ranks(df, "feature", "x")
    got = metrics.with_rank(df, ranks, "x", "rx").toPandas()
    want = pd.DataFrame(rows, columns=["feature", "x", "y"])
    want["rx"] = want.groupby("feature")["x"].rank()
    key = ["feature", "x", "y", "rx"]
    assert got[key].sort_values(key).reset_index(drop=True).equals(want[key].sort_values(key).reset_index(drop=True))


def test_parameters_flatten_as_rows(spark):
    sets = spark.createDataFrame([("v", '{"a": {"x": 1.0, "b": {"c": "t"}, "source_reliability": {"m": 0.5}}, "n": null, "l": [1, 2]}')], "version string, params string")
    got = {r["name"]: r["value"] for r in snapshots.flatten(sets).collect()}
    assert got == {"a.x": "1.0", "a.b.c": '"t"', "a.source_reliability": '{"m":0.5}', "n": "null", "l": "[1,2]"}


def test_a_search_needs_enough_dates(spark):
    rows = spark.createDataFrame([(dt.date(2026, 1, d), 0.1) for d in range(1, 5)], "as_of_date date, actual double")
    with pytest.raises(ValueError, match="dates to train"):
        tuning.sweep(lambda news: rows, [{"news": {}, "model": {}}], spark)


def test_all_direction_models_match_separate_newton_fits(spark):
    """Models of several feature lists and penalties fitted together equal single dense fits, missing values included."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    x[rng.random((300, 3)) < 0.1] = np.nan
    y = (np.nan_to_num(x[:, 0]) - 0.5 * np.nan_to_num(x[:, 2]) + rng.normal(size=300) > 0).astype(int)
    rows = spark.createDataFrame([(*(None if math.isnan(v) else float(v) for v in r), int(t)) for r, t in zip(x, y)], "a double, b double, c double, up int").repartition(3)
    asked = [(["a"], 0.01), (["a", "c"], 0.1), ([], 0.0), (["c", "b", "a"], 1.0)]
    for (features, alpha), got in zip(asked, models.fit_logistics(rows, asked, "up")):
        at = ["abc".index(f) for f in features]
        z = np.nan_to_num((x[:, at] - np.nanmean(x[:, at], axis=0)) / np.nanstd(x[:, at], axis=0)) if at else np.zeros((300, 0))
        d, w = np.c_[np.ones(300), z], np.zeros(1 + len(at))
        pen = np.diag([0.0] + [alpha * 300] * len(at))
        for _ in range(60):
            p = 1 / (1 + np.exp(-d @ w))
            w = w - np.linalg.solve(d.T @ (d * (p * (1 - p))[:, None]) + pen + 1e-12 * np.eye(len(w)), d.T @ (p - y) + pen @ w)
        assert got["features"] == features and np.allclose([got["intercept"], *got["coef"]], w, atol=1e-6)


def test_directions_choose_the_penalty_on_validation_only(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(240):
        part = "train" if i < 140 else "validation" if i < 190 else "test"
        a = float(rng.normal())
        rows.append((part, a, float(rng.normal()), float(a + rng.normal() * 0.7) if part != "test" else float(-a)))
    df = spark.createDataFrame(rows, "part string, a double, b double, actual double")
    sets = {"none": [], "a": ["a"], "both": ["a", "b"]}
    got = {(r.feature_set, r.part): r for r in models.directions(df, sets).collect()}
    assert set(got) == {(s, p) for s in sets for p in ("validation", "test")}
    for name, features in sets.items():
        losses = []
        for alpha in models.ALPHAS if features else (0.0,):
            m = models.fit_logistic(df.where("part = 'train'").withColumn("up", (F.col("actual") > 0).cast("int")), features, alpha, "up")
            losses.append((logloss(m, [r for r in rows if r[0] == "validation"]), alpha))
        assert got[name, "validation"].alpha == min(losses)[1]
        assert abs(got[name, "validation"].log_loss - min(losses)[0]) < 1e-5
    assert got["a", "validation"].accuracy > 0.7 and got["a", "test"].accuracy < 0.4
    assert got["none", "test"].accuracy == got["none", "test"].majority_accuracy


def logloss(model, rows):
    total = 0.0
    for _, a, b, actual in rows:
        s = model["intercept"] + sum(c * ({"a": a, "b": b}[f] - m) / sd for f, c, m, sd in zip(model["features"], model["coef"], model["mean"], model["std"]))
        total -= math.log(1 / (1 + math.exp(-s)) if actual > 0 else 1 - 1 / (1 + math.exp(-s)))
    return total / len(rows)


def test_whole_experiment_walks_forward_and_scores_references(spark):
    from tidemark.operators.predict import FEATURES

    rng = random.Random(6)
    rows = []
    for d in range(30):
        for t in "AB":
            f = [rng.gauss(0, 1) for _ in FEATURES]
            rows.append((dt.date(2026, 1, 1) + dt.timedelta(days=d), t, "today", f"w{d // 6}", *f, 0.5 * f[1] + rng.gauss(0, 0.2), 0.05, 0.0, rng.gauss(0, 0.1), 0.2 * f[1]))
    schema = "as_of_date date, ticker string, horizon_type string, week string, " + ", ".join(f"{f} double" for f in FEATURES) + ", actual double, neutral_threshold_pct double, no_change double, drift double, predicted double"
    df = spark.createDataFrame(rows, schema)
    sets = {models.TRIVIAL_SET: [], "one": [FEATURES[1]], "full": list(FEATURES)}
    out = models.experiment(df, ["no_change", "drift"], references={"formula": df}, feature_sets=sets, period="week", with_directions=True)
    walk = out["walk_forward"].collect()
    assert {(r.feature_set, r.month) for r in walk} == {(s, f"w{k}") for s in ("full", "selected") for k in range(2, 5)} and all(r.n == 12 for r in walk)
    assert {(r.baseline, r.week) for r in out["walk_forward_baselines"].collect()} == {(b, f"w{k}") for b in ("no_change", "drift") for k in range(5)}
    ref = {r.part: r for r in out["references"].collect()}
    part = df.where(F.col("as_of_date") < dt.date(2026, 1, 19)).agg(F.avg(F.abs(F.col("predicted") - F.col("actual")))).first()[0]
    assert ref["train"].mae == pytest.approx(part, abs=1e-4)
    assert {(r.feature_set, r.part) for r in out["directions"].collect()} == {(s, p) for s in sets for p in ("validation", "test")}
    counts = {(r.feature_set, r.part): r for r in out["directions_per_part"].collect()}
    assert all(r.n == r.predicted_up + r.predicted_down + r.predicted_neutral == r.actual_up + r.actual_down + r.actual_neutral for r in counts.values())
    assert out["feature_analysis_all"].count() == len(FEATURES)
