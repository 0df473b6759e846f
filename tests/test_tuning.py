"""The search over news parameters against one replay per trial."""

import datetime as dt
import random

import pytest

from tidemark.operators import replay, tuning
from tidemark.operators.calendar import Calendar
from tidemark.params import MODEL_PARAMS, NEWS_PARAMS, SEARCH_SPACE

TICKERS = ["AA", "BB", "CC"]


def inputs(spark, mode):
    rng = random.Random(8)
    days = [dt.date(2026, 3, 2) + dt.timedelta(days=i) for i in range(60)]
    days = [d for d in days if d.weekday() < 5]
    closes = {t: 100.0 for t in [*TICKERS, "IDX"]}
    bars = []
    for d in days:
        for t in closes:
            closes[t] *= 1 + rng.gauss(0, 0.01)
            bars.append((t, d, round(closes[t], 4)))
    bars = spark.createDataFrame(bars, "ticker string, date date, close double")
    rows = []
    for i in range(600):
        at = dt.datetime(2026, 2, 1) + dt.timedelta(minutes=rng.randint(0, 90 * 24 * 60))
        rows.append((i, i if rng.random() < 0.6 else rng.randint(0, i), rng.choice([*TICKERS, "MACRO"]), rng.choice(["rates", "other", "energy"]), rng.choice([0.2, 0.4, 1.0]),
                     float(rng.randint(-90, 90)), rng.choice([0.3, 1.0]), rng.choice([0.6, 0.9]), rng.choice([2.0, 5.0]), at, rng.random() < 0.2, f"s{i % 7}"))
    items = spark.createDataFrame(rows, "news_id long, cluster_id long, entity string, category string, relevance double, sentiment double, strength double, reliability double, "
                                        "half_life_days double, available_at timestamp_ntz, price_report boolean, source string")
    members = spark.createDataFrame([("v1", dt.date(2020, 1, 1), None, "confirmed", t, w) for t, w in zip(TICKERS, (0.5, 0.3, 0.2))],
                                    "version string, effective_from date, effective_to date, status string, ticker string, weight double")
    catalog = spark.createDataFrame([(t, s) for t, s in zip(TICKERS, ("bank", "oil", "bank"))], "ticker string, sector string")
    sensitivity = spark.createDataFrame([("bank", "rates", 1.6), ("oil", "energy", -0.5)], "sector string, category string, multiplier double")
    own = bars.where("ticker <> 'IDX'")
    return replay.Inputs(items, own, bars.where("ticker = 'IDX'").drop("ticker"), members, catalog, sensitivity, Calendar.observed(own),
                         {**NEWS_PARAMS, "max_lookback_days": 20, "baseline_days": 10, "min_baseline_n": 8}, {**MODEL_PARAMS, "sentiment_input": mode, "min_history_days": 5})


@pytest.mark.parametrize("mode", ["relative", "raw"])
def test_one_stage_for_all_trials_equals_a_replay_per_trial(spark, mode):
    x = inputs(spark, mode)
    grid = x.calendar.grid()
    trials = tuning.sample_trials({"news": x.news_params, "model": x.model_params}, {**SEARCH_SPACE, "news.baseline_days": (3, 90)}, 2, seed=3)
    trials[1]["news"]["price_report_weight"] = 0.0
    got = {}
    rows = tuning.trial_inputs(x, grid, trials)
    scored = tuning.factor_predict(rows.join(tuning.trial_table(spark, trials), "trial"), None, prefix="t_")
    for r in scored.collect():
        got[r.trial, r.session, r.ticker] = (r.predicted, r.actual)
    assert len({k[0] for k in got}) == 3
    for i, t in enumerate(trials):
        own = replay.Inputs(**{**vars(x), "news_params": t["news"], "model_params": t["model"]})
        want = {(i, r.session, r.ticker): (r.predicted, r.actual) for r in replay.records(own, grid).collect()}
        mine = {k: v for k, v in got.items() if k[0] == i}
        assert mine.keys() == want.keys() and len(want) > 60
        for k, (p, a) in want.items():
            assert mine[k][0] == pytest.approx(p, abs=2e-4) and mine[k][1] == pytest.approx(a)


def test_search_judges_every_trial(spark):
    x = inputs(spark, "relative")
    trials = tuning.sample_trials({"news": x.news_params, "model": x.model_params}, SEARCH_SPACE, 3)
    out = tuning.search(x, x.calendar.grid(), trials)
    assert {(r.trial, r.part) for r in out["results"].collect()} == {(i, p) for i in range(4) for p in ("train", "validation", "test")}
    assert tuning.verdict(out["results"], out["tests"]).count() == 1
