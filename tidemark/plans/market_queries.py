"""Registered queries: calendars, universes, prices, outcomes, snapshots and parameters."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import articles as art
from tidemark.operators import evidence as ev_ops
from tidemark.operators import flow as flow_ops
from tidemark.operators import market, metrics, outcomes, replay, snapshots, universe
from tidemark.operators import scores as score_ops
from tidemark.operators.calendar import Calendar, horizons
from tidemark.params import LEGACY_VALUES, MODEL_PARAMS, default_params
from tidemark.plans import news_queries as nq
from tidemark.plans import study_queries as sq
from tidemark.sources import bench_views as v
from tidemark.sources.feeds import backfill_windows as chunked

_NOW = "2024-01-25 12:00:00"


def order_calendar(spark: SparkSession, sf_dir: str) -> Calendar:
    return Calendar.observed(v.order_bars(spark, sf_dir))


# ---- calendar and universe ------------------------------------------------------------------------
def session_calendar(spark, sf_dir):
    """Observed sessions with open and close instants."""
    s = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return order_calendar(spark, sf_dir).frame().select("session", F.col("idx").cast("bigint").alias("idx"), s("open_utc"), s("close_utc"))


def session_neighbours(spark, sf_dir):
    """Sessions around every order date (weekends included)."""
    days = v.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    out = order_calendar(spark, sf_dir).lookup(days, F.col("day"), "on_or_before", "on_or_after", "previous_session", "sessions_to_date")
    return out.withColumn("sessions_to_date", F.col("sessions_to_date").cast("bigint"))


def weekday_calendar(spark, sf_dir):
    """Weekday sessions of the order range compared with the observed ones, with projected ones flagged."""
    bounds = v.table(spark, sf_dir, "orders").agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b")).first()
    cal = Calendar.weekdays(spark, bounds["a"], bounds["b"], dt.date(1998, 6, 30))
    seen = v.order_bars(spark, sf_dir).select(F.col("date").alias("session")).distinct().withColumn("observed", F.lit(True))
    return cal.frame().join(seen, "session", "left").groupBy(F.year("session").cast("bigint").alias("year"), "projected").agg(
        F.count("*").alias("sessions"), F.count("observed").alias("observed"))


def prediction_session(spark, sf_dir):
    """First session whose open is at or after each event."""
    e = v.table(spark, sf_dir, "events").select("event_id", "ts")
    return nq.stream_calendar(spark, sf_dir).next_session(e, F.col("ts")).select("event_id", "session")


def _horizons(spark, sf_dir, convention):
    cal = order_calendar(spark, sf_dir)
    days = v.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct().where(F.col("day") > F.lit(cal.first))
    return horizons(days, cal, convention)


def forecast_horizons(spark, sf_dir):
    """Every horizon of every order date."""
    return _horizons(spark, sf_dir, "indian_fy").select(
        "day", "session", "horizon_type", "horizon_label", "calendar_date", "target_date", F.col("trading_days_ahead").cast("bigint").alias("trading_days_ahead"))


def quarter_labels(spark, sf_dir):
    """C7 with calendar quarters."""
    return _horizons(spark, sf_dir, "calendar").where("horizon_type = 'quarter_end'").groupBy("horizon_label").agg(F.count("*").alias("n"))


def _event_days(spark, sf_dir):
    return v.table(spark, sf_dir, "events").select(F.to_date("ts").alias("day")).distinct()


def universe_asof(spark, sf_dir):
    """Version and members effective on every event date."""
    return universe.members_asof(v.universe(spark), _event_days(spark, sf_dir))


def universe_periods(spark, sf_dir):
    """C9."""
    return universe.universe_periods(v.universe(spark), _event_days(spark, sf_dir))


def universe_diff(spark, sf_dir):
    """Membership changes a pending version would make, per event date."""
    return universe.membership_diff(v.universe(spark), _event_days(spark, sf_dir))


def universe_companies(spark, sf_dir):
    """Catalog rows of the effective universe ranked by weight, with the day's event count."""
    days = _event_days(spark, sf_dir)
    counts = v.table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("ticker")).agg(F.count("*").alias("events"))
    rows = universe.companies_asof(v.universe(spark), v.catalog(spark), days)
    return rows.join(counts, ["day", "ticker"], "left").select("day", "ticker", "sector", "weight", F.col("position").cast("bigint").alias("position"), "events")


# ---- prices ---------------------------------------------------------------------------------------
def bar_returns(spark, sf_dir):
    """P1-P2."""
    bars = v.order_bars(spark, sf_dir)
    a = market.returns(bars).drop("close")
    r = lambda c: F.round(c, 6).alias(c)
    return a.join(market.n_session_returns(bars), ["ticker", "date"]).select("ticker", "date", r("simple_return"), r("log_return"), r("return_1"), r("return_5"), r("return_20"))


def rolling_statistics(spark, sf_dir):
    """Volatility, drift and beta of the history up to each bar."""
    s = market.rolling_state(v.order_bars(spark, sf_dir), v.order_index(spark, sf_dir), MODEL_PARAMS)
    return s.select("ticker", "date", F.round("daily_vol", 6).alias("daily_vol"), F.round("daily_drift", 6).alias("daily_drift"),
                    F.when(F.col("_pairs") >= 20, F.round(F.try_divide("_cov", "_var"), 5)).alias("beta"))


def missing_sessions(spark, sf_dir):
    """P3."""
    bars = v.stream_bars(spark, sf_dir)
    return market.missing_sessions(bars, nq.stream_calendar(spark, sf_dir))


def bar_coverage(spark, sf_dir):
    """I16."""
    return market.coverage(v.order_bars(spark, sf_dir))


def bar_upsert(spark, sf_dir):
    """Bars of line items re-delivered with later fetch times; the newest fetch wins, bad closes are dropped."""
    li = v.table(spark, sf_dir, "lineitem")
    base = li.groupBy(F.col("l_returnflag").alias("ticker"), F.to_date("l_shipdate").alias("date")).agg(F.avg("l_extendedprice").alias("close"))
    stored = base.select("ticker", "date", "close", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("fetched_at"))
    new = base.where(F.dayofmonth("date") % 5 == 0).select(
        "ticker", "date", F.when(F.dayofmonth("date") == 10, 0.0).otherwise(F.col("close") * 2).alias("close"), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz").alias("fetched_at"))
    merged = market.upsert_bars(stored, market.validate_bars(new))
    return merged.groupBy("ticker", F.year("date").cast("bigint").alias("year")).agg(
        F.count("*").alias("bars"), F.round(F.sum("close"), 2).alias("close_sum"), F.count_if(F.col("fetched_at") > F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).alias("updated"))


def baselines_pit(spark, sf_dir):
    """B5 on the long price series: every session, strictly earlier returns only."""
    bars = v.order_bars(spark, sf_dir)
    sessions = Calendar.observed(bars).grid().frame().select("session")
    b = market.baseline_forecasts(bars, sessions)
    return b.select("ticker", "session", *[F.round(c, 5).alias(c) for c in ("historical_mean", "company_mean", "rolling_mean_20d")])


def long_horizon_predictions(spark, sf_dir):
    """B4 with month- and quarter-end targets on the long price series (no news: volatility bands and drift only)."""
    items = v.items(spark, sf_dir).where("entity = 'none'")
    members = v.universe(spark).where("version = 'base'").select("version", "effective_from", "effective_to", "status", "source").distinct().crossJoin(
        F.broadcast(v.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("ticker")).distinct())).withColumn("weight", F.lit(1.0))
    catalog = members.select("ticker", F.lit("Energy").alias("sector"))
    cal = order_calendar(spark, sf_dir)
    x = replay.Inputs(items, v.order_bars(spark, sf_dir), v.order_index(spark, sf_dir), members, catalog, v.sensitivity(spark), cal, nq.P,
                      {**MODEL_PARAMS, "drift_weight": 1.0}, horizon_types=("today", "month_end", "quarter_end"))
    r = replay.records(x, cal.grid())
    return r.select("session", "ticker", "horizon_type", "target_date", F.col("trading_days_ahead").cast("bigint").alias("trading_days_ahead"),
                    "sigma_pct", "predicted", "actual")


# ---- predictions as stored rows -------------------------------------------------------------------
def _predictions(spark, sf_dir):
    """Replayed forecasts as stored live predictions: one run per session, a few of them backtests."""
    r = sq.records(spark, sf_dir)
    key = F.concat("session", F.lit("-"), "ticker")
    return r.select(
        F.xxhash64(key).alias("prediction_id"), F.concat(F.lit("p-"), F.col("session").cast("string")).alias("run_id"), "ticker", "session", "horizon_type",
        F.date_add("target_date", F.when(F.col("ticker") == "view", 3).otherwise(0)).alias("target_date"), "previous_close", F.col("predicted").alias("predicted_movement"),
        F.col("sigma_pct").alias("uncertainty_1sigma_pct"), "predicted_direction", F.lit("OK").alias("status"), F.lit("v1").alias("param_version"),
        (F.dayofmonth("session") % 7 == 0).alias("is_backtest"))


def _known(predictions: DataFrame) -> DataFrame:
    """Outcomes recorded earlier: sessions before 12 January."""
    return predictions.where(F.col("session") < F.lit("2024-01-12").cast("date")).select("prediction_id")


def _thresholds(spark):
    return spark.range(1).select(F.lit("v1").alias("param_version"), F.lit(0.1).alias("neutral_threshold_sigma"))


def outcome_maturity(spark, sf_dir):
    """O1-O2: pending live predictions by maturity."""
    p = _predictions(spark, sf_dir)
    m = outcomes.maturity(outcomes.pending(p, _known(p)), v.stream_bars(spark, sf_dir), F.lit(_NOW).cast("timestamp_ntz"))
    return m.select("session", "ticker", "target_date", "maturity")


def outcome_rows(spark, sf_dir):
    """O3."""
    p = _predictions(spark, sf_dir)
    rows, _ = outcomes.match_outcomes(p, _known(p), v.stream_bars(spark, sf_dir), _thresholds(spark), F.lit(_NOW).cast("timestamp_ntz"))
    return rows.join(p.select("prediction_id", "session", "ticker"), "prediction_id").drop("prediction_id").withColumn("actual_close", F.round("actual_close", 6))


def live_track_record(spark, sf_dir):
    """Metrics of scored live predictions."""
    p = _predictions(spark, sf_dir)
    rows, _ = outcomes.match_outcomes(p, _known(p), v.stream_bars(spark, sf_dir), _thresholds(spark), F.lit(_NOW).cast("timestamp_ntz"))
    return metrics.metrics(outcomes.track_record(p, rows, _thresholds(spark)), "ticker").select("ticker", "n", "mae", "rmse", "bias", "directional_accuracy")


def _runs(p: DataFrame) -> DataFrame:
    return p.select("run_id", F.col("session").alias("created_at"), "is_backtest").distinct()


def prediction_lookup(spark, sf_dir):
    """Predictions of the latest live run."""
    p = _predictions(spark, sf_dir)
    return outcomes.find_predictions(p, _runs(p)).select("run_id", "ticker", "horizon_type", "target_date", "predicted_movement", "predicted_direction")


def overview(spark, sf_dir):
    """O5."""
    p = _predictions(spark, sf_dir)
    news = art.annotate(v.news(spark, sf_dir), nq.stream_calendar(spark, sf_dir))
    return outcomes.overview(news, p, _runs(p), _known(p))


def evidence_snapshot(spark, sf_dir):
    """M7-M8: news behind every prediction with role and eligibility, counted per (session, ticker)."""
    grid = nq.stream_calendar(spark, sf_dir).grid()
    items = v.items(spark, sf_dir)
    targets = nq.next_session_targets(grid)
    contributors = score_ops.top_contributors(score_ops.weighted_states(items, grid, nq.P), targets, grid, nq.P)
    states = flow_ops.flow_states(items, grid, nq.P)
    snap = ev_ops.snapshot(ev_ops.evidence_ids(states, contributors, nq.P), items, states, grid, nq.P)
    names = grid.frame().select("pos", "session")
    return snap.join(F.broadcast(names), "pos").groupBy("session", "ticker", "role", "eligibility").agg(F.count("*").alias("n"), F.sum("news_id").alias("id_sum"))


def leakage_audit(spark, sf_dir):
    """Evidence of every prediction checked against its cut-off, with violations planted in known rows."""
    grid = nq.stream_calendar(spark, sf_dir).grid()
    items = v.items(spark, sf_dir)
    fresh = flow_ops.new_news_ids(flow_ops.flow_states(items, grid, nq.P), nq.P)
    facts = items.select("news_id", "provider_published_at", "timestamp_precision", "timezone_status")
    from tidemark.functions import availability as av

    cut = grid.frame().select("pos", "as_of", F.col("as_of").alias("cutoff"))
    rows = fresh.join(facts, "news_id").join(F.broadcast(cut), "pos").withColumn("eligibility", av.eligibility(
        F.col("provider_published_at"), F.col("timestamp_precision"), F.col("timezone_status"), F.col("fetched_at"), F.col("as_of")))
    planted = rows.withColumn("cutoff", F.when(F.col("news_id") % 40 == 0, F.timestamp_add("HOUR", F.lit(-1), "available_at")).otherwise(F.col("cutoff"))).withColumn(
        "eligibility", F.when(F.col("news_id") % 41 == 0, "verified").otherwise(F.col("eligibility"))).withColumn("fetched_at", F.when(F.col("news_id") % 41 != 0, F.col("fetched_at")))
    kinds = art.leakage_violations(planted).groupBy("violation").agg(F.count("*").alias("n"))
    return kinds.unionByName(rows.groupBy().agg(F.count("*").alias("n")).select(F.lit("checked").alias("violation"), "n")).unionByName(
        art.leakage_violations(rows).groupBy().agg(F.count("*").alias("n")).select(F.lit("without planted rows").alias("violation"), "n"))


def evidence_bundle(spark, sf_dir):
    """Event types and policy-eligible evidence per (session, company)."""
    grid = nq.stream_calendar(spark, sf_dir).grid()
    items = v.items(spark, sf_dir)
    states = flow_ops.flow_states(items, grid, nq.P)
    fresh = flow_ops.new_news_ids(states, nq.P).where("entity <> 'MACRO'").select("pos", F.col("entity").alias("ticker"), "news_id")
    facts = items.select("news_id", "category", "available_at", "fetched_at", "provider_published_at", "timestamp_precision", "timezone_status")
    from tidemark.functions import availability as av

    rows = fresh.join(facts, "news_id").join(F.broadcast(grid.frame().select("pos", "session", "as_of")), "pos").withColumn("eligibility", av.eligibility(
        F.col("provider_published_at"), F.col("timestamp_precision"), F.col("timezone_status"), F.col("fetched_at"), F.col("as_of")))
    names = grid.frame().select("pos", "session")
    return ev_ops.bundle(rows, "exact_timestamp").join(F.broadcast(names), "pos").drop("pos")


# ---- stored snapshots and parameters --------------------------------------------------------------
def _snapshots(spark, sf_dir):
    grid, scored = nq._scores(spark, sf_dir)
    rows = scored.select("pos", "session", "horizon_type", "target_date", "entity", "score", "news_count", "evidence_weight")
    cut = grid.frame().select("pos", "as_of")
    both = rows.join(F.broadcast(cut), "pos")
    late = both.withColumn("as_of", F.timestamp_add("HOUR", F.lit(3), "as_of")).withColumn("score", F.col("score") + 1)
    return both.withColumn("k", F.lit("a")).unionByName(late.withColumn("k", F.lit("b"))).withColumn(
        "run_id", F.concat(F.lit("s1-"), F.col("session").cast("string"), "k")).withColumn("is_backtest", F.dayofmonth("session") % 5 == 0)


def latest_snapshot(spark, sf_dir):
    """Rows of the newest live run."""
    return snapshots.latest_snapshot(_snapshots(spark, sf_dir)).select("run_id", "entity", "score", "news_count")


def daily_history(spark, sf_dir):
    """Last live run of each day for one entity."""
    return snapshots.daily_history(_snapshots(spark, sf_dir), "MACRO").select("date", "score")


def nested_snapshot(spark, sf_dir):
    """The JSON document of a run's horizon, read back as rows."""
    docs = snapshots.nested_snapshot(snapshots.latest_snapshot(_snapshots(spark, sf_dir)))
    company = F.from_json("company_scores", "array<struct<ticker: string, score: double, news_count: bigint>>")
    return docs.select("run_id", "horizon_type", "target_date", "macro_score", F.explode(company).alias("c")).select("run_id", "horizon_type", "target_date", "macro_score", "c.*")


def score_snapshot(spark, sf_dir):
    """Rows a run persists (entities, MACRO, INDEX_COMPANY, INDEX)."""
    grid, _, _, sums = nq._scored(spark, sf_dir)
    everyone = nq.universe_positions(spark, grid).unionByName(grid.frame().select("pos", F.lit("MACRO").alias("entity"), F.lit(0.0).alias("weight")))
    expected = nq.next_session_targets(grid).select("pos", "session", "horizon_type", "target_date").join(everyone, "pos")
    scored = score_ops.entity_scores(sums, expected, nq.P)
    return snapshots.score_snapshot(scored, score_ops.index_scores(scored, nq.P), F.concat(F.lit("s1-"), F.col("session").cast("string"))).select(
        "run_id", "entity", "score", "news_count", "weight_coverage")


def parameter_tables(spark, sf_dir):
    """Thresholds re-estimated from the data as a candidate set, diffed against the defaults."""
    old = snapshots.parameter_rows(spark, "default", default_params())
    stats = v.table(spark, sf_dir, "events").agg(F.round(F.avg("value"), 4).alias("m"), F.count("*").alias("n"))
    estimated = stats.select(F.explode(F.create_map(
        F.lit("news.neutral_band"), F.col("m").cast("string"), F.lit("news.min_baseline_n"), F.col("n").cast("string"))).alias("name", "estimate"))
    new = old.where("name <> 'model.sentiment_input'").join(estimated, "name", "left").select(
        F.lit("candidate").alias("version"), "name", F.coalesce("estimate", "value").alias("value"))
    defaults = snapshots.parameter_rows(spark, "legacy", LEGACY_VALUES)
    return snapshots.parameter_diff(old, snapshots.complete_rows(new, defaults))


def parameter_activation(spark, sf_dir):
    """Status of every version from an activation log derived from the events."""
    log = v.table(spark, sf_dir, "events").where("event_type IN ('signup', 'purchase')").select(
        F.concat(F.lit("v"), (F.col("user_id") % 40).cast("string")).alias("version"),
        F.when((F.col("event_type") == "purchase") & (F.col("user_id") % 40 < 25), "activated").otherwise("created").alias("action"), F.col("ts").alias("at"))
    return snapshots.parameter_status(log)


def backfill_windows(spark, sf_dir):
    """Collection windows covering the stream, with the articles each would fetch."""
    b = v.table(spark, sf_dir, "events").agg(F.date_trunc("DAY", F.min("ts")).cast("string").alias("a"), F.date_trunc("DAY", F.max("ts")).cast("string").alias("b")).first()
    w = chunked(spark, b["a"], b["b"], 7)
    days = w.select("from_ts", "to_ts", F.explode(F.sequence(F.to_date("from_ts"), F.to_date("to_ts"))).alias("d"))
    e = v.table(spark, sf_dir, "events").select(F.to_date("ts").alias("d"), "ts")
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return e.join(F.broadcast(days), "d").where(F.col("ts").between(F.col("from_ts"), F.col("to_ts"))).groupBy("from_ts", "to_ts").agg(
        F.count("*").alias("articles")).select(fmt("from_ts"), fmt("to_ts"), "articles")


QUERIES = {f.__name__: f for f in (
    session_calendar, session_neighbours, weekday_calendar, prediction_session, forecast_horizons, quarter_labels, universe_asof, universe_periods, universe_diff,
    universe_companies, bar_returns, rolling_statistics, missing_sessions, bar_coverage, bar_upsert, baselines_pit, long_horizon_predictions, outcome_maturity,
    outcome_rows, live_track_record, prediction_lookup, overview, evidence_snapshot, leakage_audit, evidence_bundle, latest_snapshot, daily_history, nested_snapshot,
    score_snapshot, parameter_tables, parameter_activation, backfill_windows)}


# ---- SQL checks -----------------------------------------------------------------------------------
_COVER = f"""{v.SQL_UNIVERSE}, days AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events),
cover AS (SELECT day, x.* FROM days JOIN versions x ON effective_from <= day AND (effective_to IS NULL OR effective_to >= day)),
active AS (SELECT day, arg_max(version, effective_from) AS version, max(effective_from) AS since FROM cover WHERE status = 'confirmed' GROUP BY 1)"""
_SPINE = f"""{v.SQL_ORDER_BARS},
days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders),
nb AS (SELECT day, (SELECT max(session) FROM calendar WHERE session <= day) AS on_or_before, (SELECT min(session) FROM calendar WHERE session >= day) AS on_or_after,
              (SELECT max(session) FROM calendar WHERE session < day) AS previous_session, (SELECT count(*) FROM calendar WHERE session <= day) AS sessions_to_date FROM days)"""


def _horizon_sql(label: str) -> str:
    return f"""WITH {_SPINE},
base AS (SELECT n.day, n.on_or_after AS session, (SELECT count(*) FROM calendar c WHERE c.session < n.on_or_after) AS base_idx FROM nb n
         WHERE n.day > (SELECT min(session) FROM calendar) AND n.on_or_after IS NOT NULL),
steps AS (SELECT b.*, k, last_day(CAST(date_trunc('month', day) AS DATE) + to_months(CAST(k AS INTEGER))) AS nominal FROM base b CROSS JOIN range(0, 21) r(k)),
tg AS (SELECT s.*, c.session AS target, c.idx FROM steps s ASOF JOIN calendar c ON c.session <= s.nominal WHERE c.session > s.session),
m AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY k) AS r FROM tg WHERE k < 5 QUALIFY r <= 3),
q AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY k) AS r FROM tg WHERE month(nominal) % 3 = 0 QUALIFY r <= 6),
hz AS (
SELECT day, session, 'today' AS horizon_type, CASE WHEN session = day THEN 'Today' ELSE 'Next session ' || CAST(session AS VARCHAR) END AS horizon_label, session AS calendar_date,
       session AS target_date, CAST(1 AS BIGINT) AS trading_days_ahead FROM base UNION ALL
SELECT day, session, 'month_end', strftime(nominal, '%b %Y') || ' month-end', CAST(nominal AS DATE), target, CAST(greatest(1, idx - base_idx) AS BIGINT) FROM m UNION ALL
SELECT day, session, 'quarter_end', {label}, CAST(nominal AS DATE), target, CAST(greatest(1, idx - base_idx) AS BIGINT) FROM q)"""


_FY = "'Q' || CAST(CASE month(nominal) WHEN 3 THEN 4 ELSE month(nominal) // 3 - 1 END AS VARCHAR) || ' FY' || lpad(CAST((year(nominal) + (month(nominal) > 3)::INT) % 100 AS VARCHAR), 2, '0') || ' end'"
_CQ = "'Q' || CAST(quarter(nominal) AS VARCHAR) || ' ' || CAST(year(nominal) AS VARCHAR) || ' end'"
_STORED = f"""{nq.SQL_RECORDS},
stored AS (SELECT session, ticker, horizon_type, CAST(session + CASE WHEN ticker = 'view' THEN 3 ELSE 0 END AS DATE) AS target_date,
                  predicted AS predicted_movement, sigma_pct, predicted_direction, day(session) % 7 = 0 AS is_backtest, session < DATE '2024-01-12' AS known FROM records),
prev AS (SELECT f.session, f.ticker, f.previous_close FROM forecast f),
open_ AS (SELECT s.*, p.previous_close, b.close AS actual_close, (SELECT max(date) FROM bars x WHERE x.ticker = s.ticker) AS last_bar
          FROM stored s JOIN prev p USING (session, ticker) LEFT JOIN bars b ON b.ticker = s.ticker AND b.date = s.target_date WHERE NOT is_backtest AND NOT known),
mat AS (SELECT *, CASE WHEN TIMESTAMP '{_NOW}' < CAST(target_date AS TIMESTAMP) + INTERVAL 600 MINUTE THEN 'not_matured' WHEN actual_close IS NOT NULL THEN 'scored'
                       WHEN last_bar > target_date THEN 'missing_target_price' ELSE 'awaiting_price' END AS maturity FROM open_),
outc AS (SELECT session, ticker, target_date AS actual_close_date, actual_close, (actual_close / previous_close - 1) * 100 AS a, predicted_movement, sigma_pct, predicted_direction
         FROM mat WHERE maturity = 'scored'),
outr AS (SELECT *, CASE WHEN a > 0.1 * sigma_pct THEN 'UP' WHEN a < -0.1 * sigma_pct THEN 'DOWN' ELSE 'NEUTRAL' END AS actual_direction FROM outc)"""
_SNAP = f"""{v.SQL_ITEMS}, {v.SQL_STREAM_BARS}, {nq.sql_visible()}, {nq.SQL_ENT},
sc0 AS (SELECT c.session, c.as_of, e.entity, {nq.SQL_SCORE} AS score, coalesce(n, 0) AS news_count FROM cutoffs c CROSS JOIN ent e LEFT JOIN agg ON agg.session = c.session AND agg.entity = e.entity),
snap AS (SELECT 's1-' || CAST(session AS VARCHAR) || 'a' AS run_id, session, as_of, entity, score, news_count FROM sc0 UNION ALL
         SELECT 's1-' || CAST(session AS VARCHAR) || 'b', session, as_of + INTERVAL 3 HOUR, entity, score + 1, news_count FROM sc0)"""
_EVID = f"""WITH {v.SQL_ITEMS}, {v.SQL_STREAM_BARS}, {nq.SQL_UNI}, {nq.sql_visible()}, {nq.SQL_FLOW},
fresh_all AS (SELECT session, entity, news_id, row_number() OVER (PARTITION BY session, entity ORDER BY available_at, news_id) AS r FROM fstories WHERE available_at > window_start AND NOT price_report),
contrib AS (SELECT session, entity, news_id FROM weighted WHERE w > 0 QUALIFY row_number() OVER (PARTITION BY session, entity ORDER BY w DESC, available_at, news_id) <= 5),
asked2 AS (SELECT DISTINCT session, entity AS ticker FROM contrib WHERE entity <> 'MACRO'),
ids AS (SELECT session, entity AS ticker, news_id FROM contrib WHERE entity <> 'MACRO' UNION
        SELECT a.session, a.ticker, c.news_id FROM asked2 a JOIN contrib c ON c.session = a.session AND c.entity = 'MACRO' UNION
        SELECT a.session, a.ticker, f.news_id FROM asked2 a JOIN fresh_all f ON f.session = a.session AND f.entity = a.ticker AND f.r <= 10),
judged2 AS (SELECT x.session, x.ticker, x.news_id, i.entity, CASE WHEN i.fetched_at <= c.as_of THEN 'verified' WHEN i.provider_available_at > c.as_of THEN 'post_cutoff'
        WHEN i.timestamp_precision <> 'date_only' AND i.timezone_status <> 'unknown' THEN 'timestamp_before' ELSE 'uncertain' END AS eligibility,
        f.news_id IS NOT NULL AS is_new FROM ids x JOIN items i USING (news_id) JOIN cutoffs c USING (session) LEFT JOIN fresh_all f ON f.session = x.session AND f.news_id = x.news_id AND f.entity = i.entity)"""

ORACLES = {
    "session_calendar": f"""WITH {v.SQL_ORDER_BARS} SELECT session, CAST(idx - 1 AS BIGINT) AS idx, strftime(open_utc, '%Y-%m-%d %H:%M:%S') AS open_utc, strftime(close_utc, '%Y-%m-%d %H:%M:%S') AS close_utc FROM calendar""",
    "session_neighbours": f"WITH {_SPINE} SELECT * FROM nb",
    "weekday_calendar": f"""WITH {v.SQL_ORDER_BARS}, d AS (SELECT CAST(unnest(generate_series((SELECT min(o_orderdate) FROM orders), (SELECT max(o_orderdate) FROM orders), INTERVAL 1 DAY)) AS DATE) AS session)
SELECT CAST(year(d.session) AS BIGINT) AS year, d.session > DATE '1998-06-30' AS projected, count(*) AS sessions, count(c.session) AS observed FROM d LEFT JOIN calendar c ON c.session = d.session
WHERE isodow(d.session) < 6 GROUP BY 1, 2""",
    "prediction_session": f"WITH {v.SQL_STREAM_BARS} SELECT event_id, session FROM events ASOF LEFT JOIN calendar ON ts <= open_utc",
    "forecast_horizons": f"{_horizon_sql(_FY)} SELECT * FROM hz",
    "quarter_labels": f"{_horizon_sql(_CQ)} SELECT horizon_label, count(*) AS n FROM hz WHERE horizon_type = 'quarter_end' GROUP BY 1",
    "universe_asof": f"WITH {_COVER} SELECT day, version, ticker, weight FROM active JOIN members USING (version)",
    "universe_periods": f"""WITH {_COVER}, x AS (SELECT day, a.version, lag(a.version) OVER (ORDER BY day) AS p FROM days LEFT JOIN active a USING (day)),
y AS (SELECT *, sum(CASE WHEN version IS NOT DISTINCT FROM p THEN 0 ELSE 1 END) OVER (ORDER BY day) AS run FROM x)
SELECT version, min(day) AS date_from, max(day) AS date_to FROM y GROUP BY run, version""",
    "universe_diff": f"""WITH {_COVER}, pend AS (SELECT c.day, c.version FROM cover c JOIN active a USING (day) WHERE c.status <> 'confirmed' AND c.effective_from >= a.since)
SELECT p.day, p.version, m.ticker, 'would_add' AS change FROM pend p JOIN members m USING (version) WHERE NOT EXISTS (SELECT 1 FROM active a JOIN members n ON n.version = a.version WHERE a.day = p.day AND n.ticker = m.ticker)
UNION ALL SELECT p.day, p.version, n.ticker, 'would_remove' FROM pend p JOIN active a ON a.day = p.day JOIN members n ON n.version = a.version
WHERE NOT EXISTS (SELECT 1 FROM members m WHERE m.version = p.version AND m.ticker = n.ticker)""",
    "universe_companies": f"""WITH {_COVER}, e AS (SELECT CAST(ts AS DATE) AS day, event_type AS ticker, count(*) AS events FROM events GROUP BY 1, 2)
SELECT a.day, m.ticker, c.sector, m.weight, row_number() OVER (PARTITION BY a.day ORDER BY weight DESC, m.ticker) AS position, e.events
FROM active a JOIN members m USING (version) JOIN catalog c ON c.ticker = m.ticker LEFT JOIN e ON e.day = a.day AND e.ticker = m.ticker""",
    "bar_returns": f"""WITH {v.SQL_ORDER_BARS} SELECT ticker, date, round(close / lag(close) OVER w - 1, 6) AS simple_return, round(ln(close) - ln(lag(close) OVER w), 6) AS log_return,
       round((close / lag(close) OVER w - 1) * 100, 6) AS return_1, round((close / lag(close, 5) OVER w - 1) * 100, 6) AS return_5, round((close / lag(close, 20) OVER w - 1) * 100, 6) AS return_20
FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)""",
    "rolling_statistics": f"""WITH {v.SQL_ORDER_BARS}, r AS (SELECT ticker, date, ln(close) - ln(lag(close) OVER (PARTITION BY ticker ORDER BY date)) AS lr FROM bars),
i AS (SELECT date, ln(close) - ln(lag(close) OVER (ORDER BY date)) AS ir FROM index_bars),
p AS (SELECT r.ticker, r.date, covar_samp(lr, ir) OVER w AS c, var_samp(ir) OVER w AS vv, count(*) OVER w AS n FROM r JOIN i USING (date) WHERE lr IS NOT NULL AND ir IS NOT NULL
      WINDOW w AS (PARTITION BY r.ticker ORDER BY r.date ROWS BETWEEN 249 PRECEDING AND CURRENT ROW))
SELECT r.ticker, r.date, round(stddev_samp(lr) OVER (PARTITION BY r.ticker ORDER BY r.date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), 6) AS daily_vol,
       round(avg(lr) OVER (PARTITION BY r.ticker ORDER BY r.date ROWS BETWEEN 249 PRECEDING AND CURRENT ROW), 6) AS daily_drift, CASE WHEN n >= 20 THEN round(c / vv, 5) END AS beta
FROM r LEFT JOIN p ON p.ticker = r.ticker AND p.date = r.date""",
    "missing_sessions": f"WITH {v.SQL_STREAM_BARS} SELECT t.ticker, c.session FROM (SELECT DISTINCT ticker FROM bars) t CROSS JOIN calendar c WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.ticker = t.ticker AND b.date = c.session)",
    "bar_coverage": f"WITH {v.SQL_ORDER_BARS} SELECT ticker, min(date) AS first_date, max(date) AS last_date, count(*) AS bars FROM bars GROUP BY 1",
    "bar_upsert": """WITH b AS (SELECT l_returnflag AS ticker, CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice) AS close FROM lineitem GROUP BY 1, 2)
SELECT ticker, CAST(year(date) AS BIGINT) AS year, count(*) AS bars, round(sum(CASE WHEN day(date) % 5 = 0 AND day(date) <> 10 THEN close * 2 ELSE close END), 2) AS close_sum,
       count(*) FILTER (day(date) % 5 = 0 AND day(date) <> 10) AS updated FROM b GROUP BY 1, 2""",
    "baselines_pit": f"""WITH {v.SQL_ORDER_BARS}, r AS (SELECT ticker, date, (close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1) * 100 AS r FROM bars QUALIFY r IS NOT NULL),
d AS (SELECT date, sum(sum(r)) OVER (ORDER BY date) / sum(count(*)) OVER (ORDER BY date) AS hm FROM r GROUP BY 1),
o AS (SELECT ticker, date, avg(r) OVER (PARTITION BY ticker ORDER BY date) AS cm, CASE WHEN row_number() OVER (PARTITION BY ticker ORDER BY date) >= 20
      THEN avg(r) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS rm FROM r),
a AS (SELECT t.ticker, c.session FROM (SELECT DISTINCT ticker FROM bars) t CROSS JOIN calendar c WHERE c.idx > 1),
x AS (SELECT a.*, o.cm, o.rm FROM a ASOF LEFT JOIN o ON o.ticker = a.ticker AND o.date < a.session)
SELECT x.ticker, x.session, round(d.hm, 5) AS historical_mean, round(x.cm, 5) AS company_mean, round(x.rm, 5) AS rolling_mean_20d FROM x ASOF LEFT JOIN d ON d.date < x.session""",
    "long_horizon_predictions": f"""{_horizon_sql(_FY)},
r AS (SELECT ticker, date, close, ln(close) - ln(lag(close) OVER w) AS lr, (close / lag(close) OVER w - 1) * 100 AS sr, row_number() OVER w AS k FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)),
st AS (SELECT *, stddev_samp(lr) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS vol, avg(lr) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 249 PRECEDING AND CURRENT ROW) AS drift,
              avg(sr) OVER (PARTITION BY ticker ORDER BY date) AS cm FROM r),
h AS (SELECT hz.*, t.ticker FROM hz JOIN calendar ON calendar.session = hz.day CROSS JOIN (SELECT DISTINCT ticker FROM bars) t WHERE hz.calendar_date <= (SELECT max(session) FROM calendar)),
p AS (SELECT h.session, h.ticker, h.horizon_type, h.target_date, h.trading_days_ahead AS n, s.close, s.vol * sqrt(h.trading_days_ahead) AS sg, s.drift * h.trading_days_ahead AS raw, s.cm FROM h ASOF JOIN st s ON s.ticker = h.ticker AND s.date < h.session WHERE s.k >= 21 AND s.vol > 0)
SELECT p.session, p.ticker, horizon_type, target_date, n AS trading_days_ahead, round(sg * 100, 4) AS sigma_pct, round((exp(greatest(-3 * sg, least(3 * sg, raw))) - 1) * 100, 4) AS predicted,
       round((b.close / p.close - 1) * 100, 4) AS actual FROM p JOIN bars b ON b.ticker = p.ticker AND b.date = p.target_date""",
    "outcome_maturity": f"{_STORED} SELECT session, ticker, target_date, maturity FROM mat",
    "outcome_rows": f"""{_STORED} SELECT session, ticker, actual_close_date, round(actual_close, 6) AS actual_close, round(a, 4) AS actual_movement, round(predicted_movement - a, 4) AS error,
       round(abs(predicted_movement - a), 4) AS abs_error, round(pow(predicted_movement - a, 2), 6) AS squared_error, actual_direction, actual_direction = predicted_direction AS direction_correct FROM outr""",
    "live_track_record": f"""{_STORED}, t AS (SELECT ticker, predicted_movement - round(a, 4) AS e, predicted_direction, CASE WHEN round(a, 4) > 0.1 * sigma_pct THEN 'UP' WHEN round(a, 4) < -0.1 * sigma_pct THEN 'DOWN' ELSE 'NEUTRAL' END AS d FROM outr)
SELECT ticker, count(*) AS n, round(avg(abs(e)), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(e), 4) AS bias, round(count(*) FILTER (d = predicted_direction) / count(*), 4) AS directional_accuracy FROM t GROUP BY 1""",
    "prediction_lookup": f"""{_STORED} SELECT 'p-' || CAST(session AS VARCHAR) AS run_id, ticker, horizon_type, target_date, predicted_movement, predicted_direction FROM stored
WHERE NOT is_backtest AND session = (SELECT max(session) FROM stored WHERE NOT is_backtest)""",
    "latest_snapshot": f"WITH {_SNAP} SELECT run_id, entity, score, news_count FROM snap WHERE run_id = (SELECT arg_max(run_id, as_of) FROM snap WHERE day(session) % 5 <> 0)",
    "nested_snapshot": f"""WITH {_SNAP}, l AS (SELECT * FROM snap WHERE run_id = (SELECT arg_max(run_id, as_of) FROM snap WHERE day(session) % 5 <> 0))
SELECT run_id, 'today' AS horizon_type, session AS target_date, (SELECT score FROM l WHERE entity = 'MACRO') AS macro_score, entity AS ticker, score, news_count FROM l WHERE entity <> 'MACRO'""",
    "daily_history": f"WITH {_SNAP} SELECT CAST(as_of AS DATE) AS date, arg_max(score, as_of) AS score FROM snap WHERE day(session) % 5 <> 0 AND entity = 'MACRO' GROUP BY 1",
    "score_snapshot": f"""WITH {v.SQL_ITEMS}, {v.SQL_STREAM_BARS}, {nq.SQL_UNI}, {nq.sql_visible()}, {nq.SQL_INDEX}
SELECT 's1-' || CAST(session AS VARCHAR) AS run_id, entity, score, n AS news_count, NULL::DOUBLE AS weight_coverage FROM sc UNION ALL
SELECT 's1-' || CAST(session AS VARCHAR), 'INDEX_COMPANY', round(cw, 2), 0, round(coverage, 4) FROM idx UNION ALL
SELECT 's1-' || CAST(session AS VARCHAR), 'INDEX', round(0.6 * cw + 0.4 * macro, 2), 0, round(coverage, 4) FROM idx""",
    "evidence_snapshot": f"""{_EVID} SELECT session, ticker, CASE WHEN is_new AND entity = ticker THEN 'new_company_news' WHEN is_new AND entity = 'MACRO' THEN 'new_macro_news' ELSE 'raw_score_evidence' END AS role,
       eligibility, count(*) AS n, CAST(sum(news_id) AS BIGINT) AS id_sum FROM judged2 GROUP BY 1, 2, 3, 4""",
    "leakage_audit": f"""{_EVID} SELECT 'checked' AS violation, count(*) AS n FROM fresh_all UNION ALL SELECT 'without planted rows', CAST(0 AS BIGINT) UNION ALL
SELECT 'available_after_cutoff', count(*) FROM fresh_all WHERE news_id % 40 = 0 UNION ALL SELECT 'verified_but_not_held', count(*) FROM fresh_all WHERE news_id % 41 = 0 AND news_id % 40 <> 0""",
    "evidence_bundle": f"""{_EVID}, j AS (SELECT f.session, f.entity AS ticker, i.category, i.fetched_at <= c.as_of OR (i.timestamp_precision <> 'date_only' AND i.timezone_status <> 'unknown' AND i.provider_available_at <= c.as_of) AS ok
  FROM fresh_all f JOIN items i USING (news_id) JOIN cutoffs c ON c.session = f.session WHERE f.entity <> 'MACRO')
SELECT session, ticker, count(*) FILTER (coalesce(ok, FALSE)) AS eligible, count(*) FILTER (NOT coalesce(ok, FALSE)) AS excluded,
       coalesce(array_to_string(list_sort(list_distinct(list(category) FILTER (ok))), ','), '') AS event_types FROM j GROUP BY 1, 2""",
    "parameter_tables": """SELECT 'news.neutral_band' AS name, '15' AS old_value, CAST(round(avg(value), 4) AS VARCHAR) AS new_value FROM events UNION ALL
SELECT 'news.min_baseline_n', '10', CAST(count(*) AS VARCHAR) FROM events UNION ALL SELECT 'model.sentiment_input', '"relative"', '"raw"'""",
    "parameter_activation": """WITH l AS (SELECT 'v' || CAST(user_id % 40 AS VARCHAR) AS version, event_type = 'purchase' AND user_id % 40 < 25 AS act, ts FROM events WHERE event_type IN ('signup', 'purchase'))
SELECT version, CASE WHEN version = (SELECT arg_max(version, ts) FROM l WHERE act) THEN 'active' WHEN bool_or(act) THEN 'archived' ELSE 'candidate' END AS status FROM l GROUP BY 1""",
    "backfill_windows": """WITH b AS (SELECT date_trunc('day', min(ts)) AS a, date_trunc('day', max(ts)) AS z FROM events),
w AS (SELECT unnest(generate_series(a, z, INTERVAL 7 DAY)) AS f, z FROM b), x AS (SELECT f, least(f + INTERVAL 7 DAY - INTERVAL 1 SECOND, z) AS t FROM w WHERE f < z)
SELECT strftime(f, '%Y-%m-%d %H:%M:%S') AS from_ts, strftime(t, '%Y-%m-%d %H:%M:%S') AS to_ts, count(*) AS articles FROM x JOIN events e ON e.ts BETWEEN f AND t GROUP BY 1, 2""",
    "overview": f"""{_STORED.replace('WITH ', 'WITH ', 1)}, nw AS (SELECT event_id, {v.PROVIDER} AS provider, ts AS published_at, CASE WHEN event_id % 13 <> 0 THEN ts + to_hours(CAST((event_id % 5) * 6 AS INTEGER)) END AS fetched_at,
  {v.PRECISION} AS timestamp_precision, {v.ZONE_STATUS} AS timezone_status FROM events),
na AS (SELECT n.*, i.available_at FROM nw n JOIN items i ON i.news_id = n.event_id),
nv AS (SELECT na.provider, na.fetched_at <= c.open_utc AS ok FROM na ASOF LEFT JOIN calendar c ON na.available_at <= c.open_utc),
last_ AS (SELECT * FROM stored WHERE NOT is_backtest AND session = (SELECT max(session) FROM stored WHERE NOT is_backtest))
SELECT 'articles' AS section, provider AS name, count(*) AS value FROM nv GROUP BY 2 UNION ALL SELECT 'verified', provider, count(*) FILTER (ok) FROM nv GROUP BY 2 UNION ALL
SELECT 'directions', predicted_direction, count(*) FROM last_ GROUP BY 2 UNION ALL SELECT 'outcomes', 'scored', count(*) FROM stored WHERE NOT is_backtest AND known UNION ALL
SELECT 'outcomes', 'pending', count(*) FROM stored WHERE NOT is_backtest AND NOT known""",
}
