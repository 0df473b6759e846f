"""Registered queries: scores, flow, forecasts and replay over the event-stream views."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.timestamps import session_close
from tidemark.operators import flow as flow_ops
from tidemark.operators import market, replay
from tidemark.operators import scores as score_ops
from tidemark.operators.calendar import Calendar, CutoffGrid, horizons
from tidemark.operators.stories import enumerate_positions, score_range, story_states, with_visibility
from tidemark.operators.universe import members_asof
from tidemark.session import local_frame
from tidemark.sources import bench_views as v

P = v.STREAM_NEWS_PARAMS
M = v.STREAM_MODEL_PARAMS
#: Weekday calendar on which month and quarter ends of the stream are looked up.
HORIZON_DAYS = (dt.date(2023, 12, 1), dt.date(2026, 12, 31))
ENTITIES = ("click", "view", "signup", "purchase", "MACRO")


def stream_calendar(spark: SparkSession, sf_dir: str) -> Calendar:
    return Calendar.observed(v.stream_bars(spark, sf_dir))


def stream_inputs(spark: SparkSession, sf_dir: str, policy: str = "provider_timestamp", **model) -> replay.Inputs:
    return replay.Inputs(
        items=v.items(spark, sf_dir), bars=v.stream_bars(spark, sf_dir), index_bars=v.stream_index(spark, sf_dir),
        members=v.universe(spark), catalog=v.catalog(spark), sensitivity=v.sensitivity(spark),
        calendar=stream_calendar(spark, sf_dir), news_params=P, model_params={**M, **model}, policy=policy)


def next_session_targets(grid: CutoffGrid) -> DataFrame:
    rows = grid.frame().select("session", F.lit("today").alias("horizon_type"), F.col("session").alias("target_date"))
    return score_ops.targets_of(rows, grid, session_close(F.col("target_date")))


def universe_positions(spark: SparkSession, grid: CutoffGrid) -> DataFrame:
    days = grid.frame().select("pos", F.col("session").alias("day"))
    return members_asof(v.universe(spark), days.select("day")).join(F.broadcast(days), "day").select(
        "pos", F.col("ticker").alias("entity"), "weight")


def _scored(spark, sf_dir, policy="provider_timestamp"):
    grid = stream_calendar(spark, sf_dir).grid()
    targets = next_session_targets(grid)
    states = score_ops.weighted_states(v.items(spark, sf_dir), grid, P, policy)
    return grid, targets, states, score_ops.category_sums(states, targets, grid, P)


def _scores(spark, sf_dir, policy="provider_timestamp"):
    grid, targets, _, sums = _scored(spark, sf_dir, policy)
    entities = local_frame(spark, [(e,) for e in ENTITIES], "entity string")
    expected = targets.select("pos", "session", "horizon_type", "target_date").crossJoin(entities)
    return grid, score_ops.entity_scores(sums, expected, P)


def decayed_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shrunk, decayed score per entity at every session open."""
    return _scores(spark, sf_dir)[1].select("session", "entity", "score", "raw_mean", "evidence_weight", "news_count", "article_count")


def decayed_sentiment_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same news scored for the session, the next three month-ends and the next six quarter-ends of a weekday calendar."""
    grid = stream_calendar(spark, sf_dir).grid()
    weekdays = Calendar.weekdays(spark, HORIZON_DAYS[0], HORIZON_DAYS[1])
    ahead = horizons(grid.frame().select(F.col("session").alias("day")), weekdays)
    targets = score_ops.targets_of(ahead.select(F.col("day").alias("session"), "horizon_type", "target_date"), grid, session_close(F.col("target_date")))
    states = score_ops.weighted_states(v.items(spark, sf_dir), grid, P, "provider_timestamp")
    entities = local_frame(spark, [(e,) for e in ENTITIES], "entity string")
    expected = targets.select("pos", "session", "horizon_type", "target_date").crossJoin(F.broadcast(entities))
    out = score_ops.entity_scores(score_ops.category_sums(states, targets, grid, P), expected, P)
    return out.select("session", "horizon_type", "target_date", "entity", "score", "raw_mean", "evidence_weight", "news_count")


def decayed_sentiment_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under the strictest availability policy (A5): only items held before the cut-off."""
    return _scores(spark, sf_dir, "verified")[1].select("session", "entity", "score", "news_count", "article_count")


def decayed_sentiment_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, "exact_timestamp")[1].select("session", "entity", "score", "news_count", "article_count")


def cluster_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every story at every cut-off is summarised per (session, entity) after the collapse."""
    grid = stream_calendar(spark, sf_dir).grid()
    states = story_states(score_range(with_visibility(v.items(spark, sf_dir)), grid, P))
    grains = states.groupBy("entity", "p", "q").agg(
        F.count("*").alias("stories"), F.sum("articles").alias("articles"), F.sum("cluster_size").alias("sources"),
        F.sum("sentiment").alias("s"), F.sum("relevance").alias("rel"), F.sum("reliability").alias("rlb"),
        F.sum("news_id").alias("ids"), F.count_if("price_report").alias("reports"))
    spread = enumerate_positions(grains).groupBy("pos", "entity").agg(*[
        F.sum(c).alias(c) for c in ("stories", "articles", "sources", "s", "rel", "rlb", "ids", "reports")])
    return spread.join(F.broadcast(grid.frame().select("pos", "session")), "pos").select(
        "session", "entity", "stories", "articles", "sources", F.round("s", 4).alias("sentiment_sum"),
        F.round("rel", 4).alias("relevance_sum"), F.round("rlb", 4).alias("reliability_sum"), F.col("ids").alias("id_sum"), "reports")


def sentiment_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G5."""
    grid, _, _, sums = _scored(spark, sf_dir)
    names = grid.frame().select("pos", "session")
    return score_ops.category_breakdown(sums).join(F.broadcast(names), "pos").select("session", "entity", "category", "mean", "weight")


def top_contributors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five heaviest stories per (session, entity)."""
    grid, targets, states, _ = _scored(spark, sf_dir)
    names = grid.frame().select("pos", "session")
    return score_ops.top_contributors(states, targets, grid, P).join(F.broadcast(names), "pos").select(
        "session", "entity", "rank", "news_id", "category", "sentiment", "weight", "cluster_size")


def index_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company-weighted, macro and overall index score with coverage."""
    grid, _, _, sums = _scored(spark, sf_dir)
    everyone = universe_positions(spark, grid).unionByName(
        grid.frame().select("pos", F.lit("MACRO").alias("entity"), F.lit(0.0).alias("weight")))
    expected = next_session_targets(grid).select("pos", "session", "horizon_type", "target_date").join(everyone, "pos")
    return score_ops.index_scores(score_ops.entity_scores(sums, expected, P), P).select(
        "session", "company_weighted", "macro", "overall", "weight_coverage")


def news_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New news against own or pooled baseline."""
    grid = stream_calendar(spark, sf_dir).grid()
    return flow_ops.news_flow(v.items(spark, sf_dir), grid, universe_positions(spark, grid).select("pos", "entity"), P).drop("pos")


def pooled_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pooled baseline of the universe at every cut-off."""
    grid = stream_calendar(spark, sf_dir).grid()
    uni = universe_positions(spark, grid).select("pos", "entity")
    pool = flow_ops.pooled_moments(flow_ops.flow_grains(v.items(spark, sf_dir), grid, P), uni)
    names = grid.frame().select("pos", "session")
    return pool.join(F.broadcast(names), "pos").select(
        "session", F.col("pool_n").alias("n"), F.round(F.col("pool_s") / F.col("pool_n"), 5).alias("mean"),
        F.round(F.col("pool_ss") / F.col("pool_n"), 4).alias("mean_square"))


def index_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G10."""
    grid = stream_calendar(spark, sf_dir).grid()
    uni = universe_positions(spark, grid)
    flows = flow_ops.news_flow(v.items(spark, sf_dir), grid, uni.select("pos", "entity"), P)
    names = grid.frame().select("pos", "session")
    return flow_ops.index_relative(flows, uni).join(F.broadcast(names), "pos").select("session", "index_relative")


def market_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4-P7 on the event-stream closes, with the stale-close check of live runs."""
    cal = stream_calendar(spark, sf_dir)
    sessions = cal.lookup(cal.grid().frame().select("session"), F.col("session"), "previous_session")
    out = market.market_features(v.stream_bars(spark, sf_dir), v.stream_index(spark, sf_dir), sessions, M, enforce_previous=True)
    r = lambda c, n=6: F.round(c, n).alias(c)
    return out.select("ticker", "session", r("previous_close"), "previous_close_date", r("daily_vol"), r("daily_drift"), r("beta", 5),
                      "beta_source", "n_obs", r("previous_return", 5), r("rolling_return_5d", 5), r("rolling_return_20d", 5), "missing_reason")


FORECAST_COLUMNS = ["session", "ticker", "horizon_type", "target_date", "trading_days_ahead", "universe_version", "status", "missing_reason"]


def _forecast(out: DataFrame) -> DataFrame:
    ok = F.col("status") == "OK"
    value = lambda c, n: F.when(ok, F.round(c, n)).alias(c)
    return out.select(
        "session", "ticker", "universe_version", "status", F.round("score", 2).alias("sentiment_score"), value("predicted", 4),
        F.when(ok, F.col("predicted_direction")).alias("predicted_direction"), value("sigma_pct", 4), value("predicted_price", 2),
        value("signal", 5), value("c_company_sentiment", 4), value("c_macro_sentiment", 4), value("c_index_sentiment", 4), value("c_drift", 4),
        value("macro_sens", 4))


def factor_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1-M6 with relative sentiment, every session of the stream in one job."""
    x = stream_inputs(spark, sf_dir)
    return _forecast(replay.predictions(x, x.calendar.grid()))


def factor_predictions_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 with raw scores and a drift weight (the older parameter sets)."""
    x = stream_inputs(spark, sf_dir, sentiment_input="raw", drift_weight=0.5)
    return _forecast(replay.predictions(x, x.calendar.grid()))


#: Last day to which the observed sessions are continued with weekdays, so that month and quarter ends lie ahead.
PROJECTED_TO = dt.date(2024, 7, 1)


def replay_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replay with news for the session, month ends and quarter ends."""
    x = stream_inputs(spark, sf_dir)
    observed = x.calendar
    ahead = Calendar.weekdays(spark, observed.last + dt.timedelta(days=1), PROJECTED_TO)
    x.calendar = Calendar(spark, observed.sessions + ahead.sessions, "price-data", observed.last)
    x.horizon_types = ("today", "month_end", "quarter_end")
    grid = CutoffGrid(spark, tuple(r for r in x.calendar.grid().rows if r[0] <= observed.last))
    out = replay.predictions(x, grid).where("status = 'OK'")
    return out.select("session", "ticker", "horizon_type", "target_date", F.col("trading_days_ahead").cast("bigint").alias("trading_days_ahead"), F.round("score", 2).alias("score"),
                      F.round("macro_sens", 4).alias("macro_sens"), "predicted", "sigma_pct", "predicted_direction")


#: A fitted model as it would be stored: coefficients of standardised inputs.
LINEAR_MODEL = {"kind": "linear", "features": ["relative_sentiment", "news_count", "previous_return", "beta"], "coef": [0.2137, -0.1319, 0.3371, 0.0713],
                "mean": [1.5, 2.0, 0.05, 0.4], "std": [11.71, 0.73, 1.13, 0.97], "intercept": 0.043}


def linear_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3, M5: forecasts of a stored linear model with the contribution of every input."""
    x = stream_inputs(spark, sf_dir)
    out = replay.predictions(x, x.calendar.grid(), model=LINEAR_MODEL).where("status = 'OK'")
    parts = [F.col("contributions")[f].alias(f"c_{f}") for f in (*LINEAR_MODEL["features"], "intercept")]
    return out.select("session", "ticker", "predicted", "predicted_direction", *parts)


def linear_predictions_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: further ahead only the shock without the intercept counts, clipped by the horizon's own band."""
    x = stream_inputs(spark, sf_dir)
    rows = replay.predictions(x, x.calendar.grid(), model=LINEAR_MODEL).where("status = 'OK'")
    from tidemark.operators.predict import linear_predict

    inputs = rows.select("session", "ticker", "daily_vol", "previous_close", *LINEAR_MODEL["features"]).withColumn("trading_days_ahead", F.explode(F.array(F.lit(1), F.lit(5), F.lit(21))))
    out = linear_predict(inputs, LINEAR_MODEL, M)
    return out.select("session", "ticker", "trading_days_ahead", "predicted", "predicted_direction", F.col("contributions")["intercept"].alias("c_intercept"))


def feature_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 model inputs."""
    from tidemark.operators.predict import FEATURES

    x = stream_inputs(spark, sf_dir)
    rows = replay.predictions(x, x.calendar.grid()).where("status = 'OK'")
    return rows.select("session", "ticker", *[F.round(f, 5).alias(f) for f in FEATURES])


def stream_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = stream_inputs(spark, sf_dir)
    return replay.records(x, x.calendar.grid())


def replay_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation rows with outcomes and baselines."""
    return stream_records(spark, sf_dir).select(
        "session", "ticker", F.round("predicted", 4).alias("predicted"), F.round("actual", 4).alias("actual"),
        F.round("actual_close", 6).alias("actual_close"), "predicted_direction", F.round("neutral_threshold_pct", 5).alias("neutral_threshold_pct"),
        *[F.round(b, 5).alias(b) for b in replay.BASELINES])


def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: VERIFIED / UNCERTAIN / NO_NEW_NEWS per prediction."""
    x = stream_inputs(spark, sf_dir)
    grid = x.calendar.grid()
    names = grid.frame().select("pos", "session")
    return replay.quality_flags(x, grid).join(F.broadcast(names), "pos").select("session", "ticker", "data_quality_flag")


def no_lookahead_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts change nowhere when every item and close from 20 January on is altered; altering what came before does change them."""
    x = stream_inputs(spark, sf_dir)
    split = F.lit("2024-01-20").cast("date")
    cut = F.lit("2024-01-19 03:45:00").cast("timestamp_ntz")
    grid = CutoffGrid(spark, tuple(r for r in x.calendar.grid().rows if r[0].isoformat() < "2024-01-20"))
    y = stream_inputs(spark, sf_dir)
    y.items = y.items.withColumn("sentiment", F.when(F.col("available_at") > cut, -F.col("sentiment")).otherwise(F.col("sentiment")))
    y.bars = y.bars.withColumn("close", F.when(F.col("date") >= split, F.col("close") * 3).otherwise(F.col("close")))
    y.index_bars = y.index_bars.withColumn("close", F.when(F.col("date") >= split, F.col("close") * 3).otherwise(F.col("close")))
    pick = lambda z: _forecast(replay.predictions(z, grid)).select("session", "ticker", "predicted", "sigma_pct", "signal")
    z = stream_inputs(spark, sf_dir)
    z.items = z.items.withColumn("sentiment", F.when(F.col("available_at") <= cut, -F.col("sentiment")).otherwise(F.col("sentiment")))
    a, b, c = pick(x), pick(y), pick(z)
    changes = lambda other: a.exceptAll(other).unionByName(other.exceptAll(a)).groupBy().agg(F.count("*").alias("n"))
    return changes(b).select(F.lit("after the cut-off").alias("altered"), (F.col("n") > 0).alias("forecasts_change")).unionByName(
        changes(c).select(F.lit("before the cut-off").alias("altered"), (F.col("n") > 0).alias("forecasts_change")))


QUERIES = {f.__name__: f for f in (
    replay_horizons, linear_predictions, linear_predictions_ahead, decayed_sentiment, decayed_sentiment_horizons, decayed_sentiment_verified, decayed_sentiment_exact, cluster_collapse, sentiment_by_category, top_contributors,
    index_scores, news_flow, pooled_baseline, index_relative, market_features, factor_predictions, factor_predictions_raw, feature_vector,
    replay_records, quality_flags, no_lookahead_violations)}


# ---- SQL checks -----------------------------------------------------------------------------------
def sql_stories(out: str, source: str) -> str:
    """Collapse rows of ``source`` (items joined to cut-offs) into one row per (session, entity, cluster)."""
    return f"""
{out}_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY session, entity, cluster_id ORDER BY available_at, news_id) AS r,
         row_number() OVER (PARTITION BY session, entity, cluster_id ORDER BY relevance * reliability DESC, available_at, news_id) AS b,
         greatest(1e-9, relevance * reliability) AS cw FROM {source}),
{out} AS (
  SELECT session, entity, cluster_id, any_value(as_of) AS as_of, any_value(window_start) AS window_start,
         any_value(close_utc) AS close_utc, max(CASE WHEN r = 1 THEN news_id END) AS news_id,
         max(CASE WHEN r = 1 THEN available_at END) AS available_at, max(CASE WHEN r = 1 THEN strength END) AS strength,
         max(CASE WHEN r = 1 THEN half_life_days END) AS half_life_days, max(CASE WHEN r = 1 THEN category END) AS category,
         bool_or(r = 1 AND price_report) AS price_report, max(CASE WHEN r = 1 THEN fetched_at END) AS fetched_at,
         max(CASE WHEN b = 1 THEN relevance END) AS relevance, max(CASE WHEN b = 1 THEN reliability END) AS reliability,
         sum(cw * sentiment) / sum(cw) AS sentiment, count(DISTINCT source) AS cluster_size, count(*) AS articles
  FROM {out}_ranked GROUP BY session, entity, cluster_id)"""


def sql_visible(condition: str = "TRUE") -> str:
    return f"""
vis AS (
  SELECT c.session, c.as_of, c.window_start, c.close_utc, i.* FROM items i JOIN cutoffs c
    ON i.available_at <= c.as_of AND i.available_at >= c.as_of - INTERVAL {P['max_lookback_days']} DAY AND i.relevance >= 0.3
   AND ({condition})),
{sql_stories('stories', 'vis')},
weighted AS (
  SELECT *, reliability * relevance * strength
            * pow(0.5, (epoch_us(greatest(as_of, close_utc)) - epoch_us(available_at)) / 86400000000.0 / half_life_days)
            * (1 + 0.15 * ln(cluster_size)) * CASE WHEN price_report THEN 0.0 ELSE 1.0 END AS w FROM stories),
agg AS (SELECT session, entity, sum(w) AS ew, sum(w * sentiment) AS ws, count(*) AS n, sum(articles) AS a FROM weighted GROUP BY 1, 2)"""


SQL_SCORE = "CASE WHEN ew > 0 THEN round(greatest(-100, least(100, ws / ew * ew / (ew + 1))), 2) ELSE 0.0 END"
SQL_ENT = "ent AS (SELECT unnest(['click', 'view', 'signup', 'purchase', 'MACRO']) AS entity)"


def sql_policy(condition: str) -> str:
    return f"""
WITH {v.SQL_ITEMS}, {v.SQL_STREAM_BARS}, {sql_visible(condition)}, {SQL_ENT}
SELECT c.session, e.entity, {SQL_SCORE} AS score, coalesce(n, 0) AS news_count, CAST(coalesce(a, 0) AS BIGINT) AS article_count
FROM cutoffs c CROSS JOIN ent e LEFT JOIN agg ON agg.session = c.session AND agg.entity = e.entity"""


SQL_UNI = f"""{v.SQL_UNIVERSE},
active AS (
  SELECT c.session, arg_max(version, effective_from) AS version FROM cutoffs c JOIN versions
    ON effective_from <= c.session AND (effective_to IS NULL OR effective_to >= c.session) WHERE status = 'confirmed' GROUP BY 1),
uni AS (SELECT a.session, a.version, m.ticker AS entity, m.weight, k.sector FROM active a JOIN members m USING (version) JOIN catalog k USING (ticker))"""

SQL_FLOW = f"""
fvis AS (
  SELECT c.session, c.as_of, c.window_start, c.close_utc, i.* FROM items i JOIN cutoffs c
    ON i.available_at <= c.as_of AND i.available_at > c.window_start - INTERVAL {P['baseline_days']} DAY
   AND i.available_at >= c.as_of - INTERVAL {max(P['max_lookback_days'], P['baseline_days'] + 7)} DAY AND i.relevance >= 0.3),
{sql_stories('fstories', 'fvis')},
pvis AS (SELECT * FROM fvis WHERE available_at <= window_start AND entity <> 'MACRO'),
{sql_stories('pstories', 'pvis')},
pool AS (
  SELECT p.session, count(*) AS pn, avg(sentiment) AS pmean, stddev_samp(sentiment) AS pstd, avg(sentiment * sentiment) AS pms
  FROM pstories p JOIN uni u ON u.session = p.session AND u.entity = p.entity WHERE NOT price_report GROUP BY 1),
fresh AS (
  SELECT session, entity, count(*) FILTER (NOT price_report) AS news_count, count(*) FILTER (price_report) AS excluded,
         sum(greatest(1e-9, reliability * relevance * strength) * sentiment) FILTER (NOT price_report)
         / sum(greatest(1e-9, reliability * relevance * strength)) FILTER (NOT price_report) AS cur,
         avg(relevance) FILTER (NOT price_report) AS rel, max(available_at) FILTER (NOT price_report) AS newest
  FROM fstories WHERE available_at > window_start GROUP BY 1, 2),
base AS (
  SELECT session, entity, count(*) AS bn, avg(sentiment) AS bmean, stddev_samp(sentiment) AS bstd
  FROM fstories WHERE available_at <= window_start AND NOT price_report GROUP BY 1, 2),
asked AS (SELECT session, entity FROM uni UNION ALL SELECT session, 'MACRO' FROM cutoffs),
joined AS (
  SELECT a.session, a.entity, c.as_of, coalesce(f.news_count, 0) AS news_count, coalesce(f.excluded, 0) AS excluded, f.cur, f.rel, f.newest,
         a.entity <> 'MACRO' AND coalesce(b.bn, 0) < {P['min_baseline_n']} AND coalesce(p.pn, 0) >= {P['min_baseline_n']} AS pooled,
         b.bn, b.bmean, b.bstd, p.pn, p.pmean, p.pstd
  FROM asked a JOIN cutoffs c USING (session) LEFT JOIN fresh f USING (session, entity) LEFT JOIN base b USING (session, entity)
  LEFT JOIN pool p USING (session)),
picked AS (
  SELECT *, CASE WHEN pooled THEN pn ELSE coalesce(bn, 0) END AS baseline_n, CASE WHEN pooled THEN pmean ELSE bmean END AS mean_,
         CASE WHEN pooled THEN pstd ELSE bstd END AS std_ FROM joined),
flows AS (
  SELECT session, entity,
         CASE WHEN news_count = 0 THEN CASE WHEN baseline_n >= {P['min_baseline_n']} THEN 'no_new_news' ELSE 'insufficient_history' END
              WHEN baseline_n < {P['min_baseline_n']} THEN 'insufficient_history' WHEN pooled THEN 'ok_pooled_baseline' ELSE 'ok' END AS status,
         CASE WHEN news_count > 0 THEN round(cur, 3) END AS current_sentiment,
         CASE WHEN baseline_n < {P['min_baseline_n']} THEN NULL WHEN news_count = 0 THEN 0.0 ELSE round(cur - mean_, 3) END AS relative_sentiment,
         CASE WHEN baseline_n < {P['min_baseline_n']} OR coalesce(std_, 0) = 0 THEN NULL WHEN news_count = 0 THEN 0.0
              ELSE round(greatest(-5, least(5, (cur - mean_) / std_)), 4) END AS sentiment_zscore,
         round(mean_, 3) AS baseline_mean, round(std_, 3) AS baseline_std, CAST(baseline_n AS BIGINT) AS baseline_n, news_count,
         CASE WHEN news_count > 0 THEN round_even(round(rel, 9), 3) END AS news_relevance,
         CASE WHEN news_count > 0 THEN round((epoch_us(as_of) - epoch_us(newest)) / 3600000000.0, 2) END AS news_recency_hours,
         excluded AS price_reports_excluded
  FROM picked),
index_rel AS (
  SELECT f.session, round(sum(u.weight * f.relative_sentiment) / sum(u.weight), 3) AS index_relative
  FROM flows f JOIN uni u ON u.session = f.session AND u.entity = f.entity WHERE f.relative_sentiment IS NOT NULL GROUP BY 1)"""

SQL_INDEX = f"""
sc AS (
  SELECT u.session, u.entity, u.weight, {SQL_SCORE} AS score, coalesce(n, 0) AS n
  FROM (SELECT session, entity, weight FROM uni UNION ALL SELECT session, 'MACRO', 0.0 FROM cutoffs) u
  LEFT JOIN agg ON agg.session = u.session AND agg.entity = u.entity),
idx AS (
  SELECT session, sum(weight * score) FILTER (entity <> 'MACRO') / sum(weight) FILTER (entity <> 'MACRO') AS cw,
         max(score) FILTER (entity = 'MACRO') AS macro,
         coalesce(sum(weight) FILTER (entity <> 'MACRO' AND n > 0), 0) / sum(weight) FILTER (entity <> 'MACRO') AS coverage
  FROM sc GROUP BY 1)"""

SQL_MARKET = f"""
rets AS (
  SELECT ticker, date, close, ln(close) - ln(lag(close) OVER w) AS lr, (close / lag(close) OVER w - 1) * 100 AS sr FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)),
irets AS (SELECT date, ln(close) - ln(lag(close) OVER (ORDER BY date)) AS ir FROM index_bars),
asks AS (SELECT t.ticker, c.session, lag_session FROM (SELECT DISTINCT ticker FROM bars) t
         CROSS JOIN (SELECT session, (SELECT max(k.session) FROM calendar k WHERE k.session < c0.session) AS lag_session FROM cutoffs c0) c),
hist AS (
  SELECT a.ticker, a.session, r.date, r.close, r.lr, row_number() OVER (PARTITION BY a.ticker, a.session ORDER BY r.date DESC) AS k
  FROM asks a JOIN rets r ON r.ticker = a.ticker AND r.date < a.session),
paired AS (
  SELECT h.*, i.ir, row_number() OVER (PARTITION BY h.ticker, h.session ORDER BY h.date DESC) AS j
  FROM hist h JOIN irets i ON i.date = h.date WHERE h.lr IS NOT NULL AND i.ir IS NOT NULL),
feat AS (
  SELECT ticker, session, count(*) AS n_obs, max(CASE WHEN k = 1 THEN close END) AS previous_close, max(date) AS previous_close_date,
         stddev_samp(lr) FILTER (k <= {M['vol_lookback_days']}) AS daily_vol, avg(lr) FILTER (k <= {M['drift_lookback_days']}) AS daily_drift,
         (max(CASE WHEN k = 1 THEN close END) / max(CASE WHEN k = 2 THEN close END) - 1) * 100 AS previous_return,
         (max(CASE WHEN k = 1 THEN close END) / max(CASE WHEN k = 6 THEN close END) - 1) * 100 AS rolling_return_5d,
         (max(CASE WHEN k = 1 THEN close END) / max(CASE WHEN k = 21 THEN close END) - 1) * 100 AS rolling_return_20d
  FROM hist GROUP BY 1, 2),
betas AS (
  SELECT ticker, session, covar_samp(lr, ir) AS cov, var_samp(ir) AS var_, count(*) AS pairs FROM paired
  WHERE j <= {M['beta_lookback_days']} GROUP BY 1, 2),
market AS (
  SELECT a.ticker, a.session, a.lag_session, f.* EXCLUDE (ticker, session),
         CASE WHEN coalesce(pairs, 0) >= {M['min_history_days']} AND var_ > 0 THEN cov / var_ ELSE 1.0 END AS beta,
         CASE WHEN coalesce(pairs, 0) >= {M['min_history_days']} AND var_ > 0 THEN 'estimated' ELSE 'default' END AS beta_source
  FROM asks a LEFT JOIN feat f USING (ticker, session) LEFT JOIN betas b USING (ticker, session))"""


def sql_forecast(relative: bool, drift: float) -> str:
    s = ("coalesce(f.relative_sentiment, 0)", "coalesce(mf.relative_sentiment, 0)", "coalesce(ir.index_relative, 0)") if relative else \
        ("s.score", "x.macro", "round(x.cw, 2)")
    news_sigma = "daily_vol" if relative else "daily_vol * sqrt(1)"
    return f"""
bycat AS (SELECT session, category, round(sum(w), 5) AS weight FROM weighted WHERE entity = 'MACRO' AND w > 0 GROUP BY 1, 2),
sens AS (
  SELECT b.session, k.sector, sum(b.weight * coalesce(t.multiplier, 1.0)) / sum(b.weight) AS macro_sens
  FROM bycat b CROSS JOIN (SELECT DISTINCT sector FROM catalog) k LEFT JOIN sensitivity t ON t.sector = k.sector AND t.category = b.category GROUP BY 1, 2),
ins AS (
  SELECT u.session, u.entity AS ticker, u.version AS universe_version, s.score, x.macro, round(x.cw, 2) AS index_score, m.*  EXCLUDE (ticker, session),
         coalesce(z.macro_sens, 1.0) AS macro_sens, {s[0]} AS sc, {s[1]} AS sm, {s[2]} AS si, f.status AS f_status, f.relative_sentiment, f.sentiment_zscore,
         f.news_count, f.news_relevance, f.news_recency_hours, mf.relative_sentiment AS m_relative, ir.index_relative AS index_rel_raw,
         CASE WHEN m.n_obs IS NULL OR m.n_obs < {M['min_history_days'] + 1} OR coalesce(daily_vol, 0) <= 0 THEN 'MISSING_DATA' ELSE 'OK' END AS status
  FROM uni u JOIN sc s ON s.session = u.session AND s.entity = u.entity JOIN idx x ON x.session = u.session
  LEFT JOIN market m ON m.session = u.session AND m.ticker = u.entity LEFT JOIN sens z ON z.session = u.session AND z.sector = u.sector
  LEFT JOIN flows f ON f.session = u.session AND f.entity = u.entity LEFT JOIN flows mf ON mf.session = u.session AND mf.entity = 'MACRO'
  LEFT JOIN index_rel ir ON ir.session = u.session),
parts AS (
  SELECT *, {M['sensitivity']} * {news_sigma} / 100 * {M['w_company']} * sc AS pc, {M['sensitivity']} * {news_sigma} / 100 * {M['w_macro']} * macro_sens * sm AS pm,
         {M['sensitivity']} * {news_sigma} / 100 * {M['w_index']} * beta * si AS pi_, {drift} * daily_drift AS pd FROM ins),
moved AS (SELECT *, pc + pm + pi_ + pd AS raw, greatest(-3 * daily_vol, least(3 * daily_vol, pc + pm + pi_ + pd)) AS mv FROM parts),
forecast AS (
  SELECT *, (exp(mv) - 1) * 100 AS pct, CASE WHEN raw = 0 THEN 1.0 ELSE mv / raw END AS scale FROM moved)"""


SQL_FORECAST_SELECT = f"""
SELECT session, ticker, universe_version, status, score AS sentiment_score, CASE WHEN status = 'OK' THEN CASE WHEN round(pct, 4) = 0 THEN CAST(0 AS DOUBLE) ELSE round(pct, 4) END END AS predicted,
       CASE WHEN status = 'OK' THEN CASE WHEN pct > 0.1 * daily_vol * 100 THEN 'UP' WHEN pct < -0.1 * daily_vol * 100 THEN 'DOWN' ELSE 'NEUTRAL' END END AS predicted_direction,
       CASE WHEN status = 'OK' THEN round(daily_vol * 100, 4) END AS sigma_pct,
       CASE WHEN status = 'OK' THEN round(previous_close * (1 + pct / 100), 2) END AS predicted_price,
       CASE WHEN status = 'OK' THEN round(({M['w_company']} * sc + {M['w_macro']} * macro_sens * sm + {M['w_index']} * beta * si) / 100, 5) END AS signal,
       CASE WHEN status = 'OK' THEN CASE WHEN round(pc * scale * 100, 4) = 0 THEN CAST(0 AS DOUBLE) ELSE round(pc * scale * 100, 4) END END AS c_company_sentiment, CASE WHEN status = 'OK' THEN CASE WHEN round(pm * scale * 100, 4) = 0 THEN CAST(0 AS DOUBLE) ELSE round(pm * scale * 100, 4) END END AS c_macro_sentiment,
       CASE WHEN status = 'OK' THEN CASE WHEN round(pi_ * scale * 100, 4) = 0 THEN CAST(0 AS DOUBLE) ELSE round(pi_ * scale * 100, 4) END END AS c_index_sentiment, CASE WHEN status = 'OK' THEN CASE WHEN round(pd * scale * 100, 4) = 0 THEN CAST(0 AS DOUBLE) ELSE round(pd * scale * 100, 4) END END AS c_drift,
       CASE WHEN status = 'OK' THEN round(macro_sens, 4) END AS macro_sens
FROM forecast"""

_BASE = f"WITH {v.SQL_ITEMS}, {v.SQL_STREAM_BARS}, {SQL_UNI}, {sql_visible()}"
SQL_REPLAY = f"{_BASE}, {SQL_FLOW}, {SQL_INDEX}, {SQL_MARKET}, {sql_forecast(True, 0.0)}"

SQL_RECORDS = f"""{SQL_REPLAY},
pooled_returns AS (SELECT c.session, avg(r.sr) AS historical_mean FROM cutoffs c JOIN rets r ON r.date < c.session WHERE r.sr IS NOT NULL GROUP BY 1),
own_returns AS (
  SELECT ticker, session, avg(sr) AS company_mean, CASE WHEN count(*) >= 20 THEN avg(sr) FILTER (k <= 20) END AS rolling_mean_20d
  FROM (SELECT a.ticker, a.session, r.sr, row_number() OVER (PARTITION BY a.ticker, a.session ORDER BY r.date DESC) AS k
        FROM asks a JOIN rets r ON r.ticker = a.ticker AND r.date < a.session WHERE r.sr IS NOT NULL) GROUP BY 1, 2),
records AS (
  SELECT f.session, f.ticker, 'today' AS horizon_type, strftime(f.session, '%Y-%m') AS month, round(f.pct, 4) AS predicted, b.close AS actual_close,
         round((b.close / f.previous_close - 1) * 100, 4) AS actual, round(f.daily_vol * 100, 4) AS sigma_pct, f.score AS sentiment_score,
         CASE WHEN pct > 0.1 * daily_vol * 100 THEN 'UP' WHEN pct < -0.1 * daily_vol * 100 THEN 'DOWN' ELSE 'NEUTRAL' END AS predicted_direction,
         0.1 * round(f.daily_vol * 100, 4) AS neutral_threshold_pct, CAST(0.0 AS DOUBLE) AS no_change, round(p.historical_mean, 5) AS historical_mean,
         round(o.company_mean, 5) AS company_mean, round(o.rolling_mean_20d, 5) AS rolling_mean_20d,
         round(pc * scale * 100, 4) AS c_company_sentiment, round(pm * scale * 100, 4) AS c_macro_sentiment, round(pi_ * scale * 100, 4) AS c_index_sentiment,
         round(pd * scale * 100, 4) AS c_drift, f.score AS raw_sentiment, f.relative_sentiment, f.sentiment_zscore, ln(1 + f.news_count) AS news_count,
         CASE WHEN f_status IS NULL THEN NULL WHEN f.news_count > 0 THEN f.news_relevance ELSE 0.0 END AS news_relevance,
         CASE WHEN f_status IS NULL THEN NULL WHEN f.news_count > 0 THEN exp(-f.news_recency_hours / 24) ELSE 0.0 END AS news_recency,
         f.macro AS macro_sentiment, f.m_relative * f.macro_sens AS macro_relative, f.index_score * f.beta AS index_sentiment,
         f.index_rel_raw * f.beta AS index_relative, f.daily_vol * 100 AS historical_volatility, f.beta, f.previous_return, f.rolling_return_5d, f.rolling_return_20d
  FROM forecast f JOIN bars b ON b.ticker = f.ticker AND b.date = f.session LEFT JOIN pooled_returns p ON p.session = f.session
  LEFT JOIN own_returns o ON o.ticker = f.ticker AND o.session = f.session WHERE f.status = 'OK')"""

_FEATURES = ("raw_sentiment relative_sentiment sentiment_zscore news_count news_relevance news_recency macro_sentiment macro_relative index_sentiment "
             "index_relative historical_volatility beta previous_return rolling_return_5d rolling_return_20d").split()
_SQL_FEATURE_SOURCE = SQL_RECORDS.replace("JOIN bars b ON b.ticker = f.ticker AND b.date = f.session LEFT JOIN", "LEFT JOIN bars b ON b.ticker = f.ticker AND b.date = f.session LEFT JOIN")
_LINEAR = ", ".join(
    f"{c}::DOUBLE * coalesce(({f} - {m}::DOUBLE) / {d}::DOUBLE, 0) AS t_{f}" for f, c, m, d in zip(*(LINEAR_MODEL[k] for k in ("features", "coef", "mean", "std")))
) + f", {LINEAR_MODEL['intercept']}::DOUBLE + " + " + ".join(f"t_{f}" for f in LINEAR_MODEL["features"]) + " AS total"

ORACLES = {
    "decayed_sentiment": f"""
WITH {v.SQL_ITEMS}, {v.SQL_STREAM_BARS}, {sql_visible()}, {SQL_ENT}
SELECT c.session, e.entity, {SQL_SCORE} AS score, CASE WHEN ew > 0 THEN round(ws / ew, 2) END AS raw_mean,
       CASE WHEN ew > 0 THEN round(ew, 5) ELSE 0.0 END AS evidence_weight, coalesce(n, 0) AS news_count, CAST(coalesce(a, 0) AS BIGINT) AS article_count
FROM cutoffs c CROSS JOIN ent e LEFT JOIN agg ON agg.session = c.session AND agg.entity = e.entity""",
    "decayed_sentiment_horizons": f"""
WITH {v.SQL_ITEMS}, {v.SQL_STREAM_BARS}, {sql_visible()}, {SQL_ENT},
wk AS (SELECT CAST(d AS DATE) AS d FROM generate_series(DATE '{HORIZON_DAYS[0]}', DATE '{HORIZON_DAYS[1]}', INTERVAL 1 DAY) g(d) WHERE isodow(d) < 6),
hb AS (SELECT c.session, c.as_of, (SELECT min(d) FROM wk WHERE d >= c.session) AS base FROM cutoffs c),
hs AS (SELECT hb.*, k, last_day(CAST(date_trunc('month', session) AS DATE) + to_months(CAST(k AS INTEGER))) AS nominal FROM hb CROSS JOIN range(0, 21) r(k)),
ht AS (SELECT hs.*, (SELECT max(d) FROM wk WHERE d <= nominal) AS target FROM hs),
hz AS (SELECT session, as_of, 'today' AS horizon_type, base AS target_date FROM hb UNION ALL
  SELECT session, as_of, 'month_end', target FROM (SELECT * FROM ht WHERE target > base AND k < 5 QUALIFY row_number() OVER (PARTITION BY session ORDER BY k) <= 3) UNION ALL
  SELECT session, as_of, 'quarter_end', target FROM (SELECT * FROM ht WHERE target > base AND month(nominal) % 3 = 0 QUALIFY row_number() OVER (PARTITION BY session ORDER BY k) <= 6)),
hw AS (SELECT h.session, h.horizon_type, h.target_date, s.entity, s.sentiment, s.reliability * s.relevance * s.strength
  * pow(0.5, (epoch_us(greatest(h.as_of, CAST(h.target_date AS TIMESTAMP) + INTERVAL 600 MINUTE)) - epoch_us(s.available_at)) / 86400000000.0 / s.half_life_days)
  * (1 + 0.15 * ln(s.cluster_size)) * CASE WHEN s.price_report THEN 0.0 ELSE 1.0 END AS w FROM stories s JOIN hz h ON h.session = s.session),
ha AS (SELECT session, horizon_type, target_date, entity, sum(w) AS ew, sum(w * sentiment) AS ws, count(*) AS n FROM hw GROUP BY 1, 2, 3, 4)
SELECT h.session, h.horizon_type, h.target_date, e.entity, {SQL_SCORE} AS score, CASE WHEN ew > 0 THEN round(ws / ew, 2) END AS raw_mean,
  CASE WHEN ew > 0 THEN round(ew, 5) ELSE 0.0 END AS evidence_weight, coalesce(n, 0) AS news_count
FROM hz h CROSS JOIN ent e LEFT JOIN ha a ON a.session = h.session AND a.horizon_type = h.horizon_type AND a.target_date = h.target_date AND a.entity = e.entity""",
    "replay_horizons": f"""{_BASE}, {SQL_FLOW}, {SQL_MARKET},
pc AS (SELECT session, row_number() OVER (ORDER BY session) AS idx FROM (SELECT session FROM calendar UNION ALL
  SELECT CAST(d AS DATE) FROM generate_series(DATE '2024-01-01', DATE '{PROJECTED_TO}', INTERVAL 1 DAY) g(d) WHERE isodow(d) < 6 AND d > (SELECT max(session) FROM calendar))),
hb AS (SELECT c.session, c.as_of, (SELECT count(*) FROM pc WHERE pc.session < c.session) AS before FROM cutoffs c),
hs AS (SELECT hb.*, k, last_day(CAST(date_trunc('month', session) AS DATE) + to_months(CAST(k AS INTEGER))) AS nominal FROM hb CROSS JOIN range(0, 21) r(k)),
ht AS (SELECT hs.*, (SELECT max(session) FROM pc WHERE pc.session <= nominal) AS target FROM hs WHERE nominal <= (SELECT max(session) FROM pc)),
hz AS (SELECT session, as_of, 'today' AS horizon_type, session AS target_date, 1 AS h FROM hb UNION ALL
  SELECT x.session, as_of, 'month_end', target, greatest(1, idx - before) FROM (SELECT * FROM ht WHERE target > session AND k < 5 QUALIFY row_number() OVER (PARTITION BY session ORDER BY k) <= 3) x JOIN pc ON pc.session = target UNION ALL
  SELECT x.session, as_of, 'quarter_end', target, greatest(1, idx - before) FROM (SELECT * FROM ht WHERE target > session AND month(nominal) % 3 = 0 QUALIFY row_number() OVER (PARTITION BY session ORDER BY k) <= 6) x JOIN pc ON pc.session = target),
hw AS (SELECT z.session, z.horizon_type, z.target_date, s.entity, s.category, s.sentiment, s.reliability * s.relevance * s.strength
  * pow(0.5, (epoch_us(greatest(z.as_of, CAST(z.target_date AS TIMESTAMP) + INTERVAL 600 MINUTE)) - epoch_us(s.available_at)) / 86400000000.0 / s.half_life_days)
  * (1 + 0.15 * ln(s.cluster_size)) * CASE WHEN s.price_report THEN 0.0 ELSE 1.0 END AS w FROM stories s JOIN hz z ON z.session = s.session),
ha AS (SELECT session, horizon_type, target_date, entity, sum(w) AS ew, sum(w * sentiment) AS ws FROM hw GROUP BY 1, 2, 3, 4),
hc AS (SELECT session, horizon_type, target_date, category, round(sum(w), 5) AS weight FROM hw WHERE entity = 'MACRO' AND w > 0 GROUP BY 1, 2, 3, 4),
hm AS (SELECT b.session, b.horizon_type, b.target_date, k.sector, sum(b.weight * coalesce(t.multiplier, 1.0)) / sum(b.weight) AS macro_sens
  FROM hc b CROSS JOIN (SELECT DISTINCT sector FROM catalog) k LEFT JOIN sensitivity t ON t.sector = k.sector AND t.category = b.category GROUP BY 1, 2, 3, 4),
hi AS (SELECT z.session, u.entity AS ticker, z.horizon_type, z.target_date, z.h, {SQL_SCORE} AS score, coalesce(q.macro_sens, 1.0) AS ms, m.daily_vol, m.beta,
    coalesce(f.relative_sentiment, 0) AS sc, coalesce(mf.relative_sentiment, 0) AS sm, coalesce(ir.index_relative, 0) AS si
  FROM hz z JOIN uni u ON u.session = z.session LEFT JOIN ha a ON a.session = z.session AND a.horizon_type = z.horizon_type AND a.target_date = z.target_date AND a.entity = u.entity
  LEFT JOIN hm q ON q.session = z.session AND q.horizon_type = z.horizon_type AND q.target_date = z.target_date AND q.sector = u.sector
  JOIN market m ON m.session = z.session AND m.ticker = u.entity AND m.n_obs >= {M['min_history_days'] + 1} AND m.daily_vol > 0
  LEFT JOIN flows f ON f.session = z.session AND f.entity = u.entity LEFT JOIN flows mf ON mf.session = z.session AND mf.entity = 'MACRO' LEFT JOIN index_rel ir ON ir.session = z.session),
hf AS (SELECT *, daily_vol * sqrt(h) AS sg, {M['sensitivity']} * daily_vol / 100 * ({M['w_company']} * sc + {M['w_macro']} * ms * sm + {M['w_index']} * beta * si) AS raw FROM hi),
hp AS (SELECT *, (exp(greatest(-3 * sg, least(3 * sg, raw))) - 1) * 100 AS pct FROM hf)
SELECT session, ticker, horizon_type, target_date, CAST(h AS BIGINT) AS trading_days_ahead, score, round(ms, 4) AS macro_sens, round(pct, 4) + 0.0 AS predicted, round(sg * 100, 4) AS sigma_pct,
  CASE WHEN pct > 0.1 * sg * 100 THEN 'UP' WHEN pct < -0.1 * sg * 100 THEN 'DOWN' ELSE 'NEUTRAL' END AS predicted_direction FROM hp""",
    "decayed_sentiment_verified": sql_policy("i.fetched_at <= c.as_of"),
    "decayed_sentiment_exact": sql_policy(
        "i.fetched_at <= c.as_of OR (i.timestamp_precision <> 'date_only' AND i.timezone_status <> 'unknown' AND i.provider_available_at <= c.as_of)"),
    "cluster_collapse": f"""
WITH {v.SQL_ITEMS}, {v.SQL_STREAM_BARS}, {sql_visible()}
SELECT session, entity, count(*) AS stories, CAST(sum(articles) AS BIGINT) AS articles, CAST(sum(cluster_size) AS BIGINT) AS sources,
       round(sum(sentiment), 4) AS sentiment_sum, round(sum(relevance), 4) AS relevance_sum, round(sum(reliability), 4) AS reliability_sum,
       CAST(sum(news_id) AS BIGINT) AS id_sum, count(*) FILTER (price_report) AS reports FROM stories GROUP BY 1, 2""",
    "sentiment_by_category": f"""
WITH {v.SQL_ITEMS}, {v.SQL_STREAM_BARS}, {sql_visible()}
SELECT session, entity, category, round(sum(w * sentiment) / sum(w), 2) AS mean, round(sum(w), 5) AS weight FROM weighted WHERE w > 0 GROUP BY 1, 2, 3""",
    "top_contributors": f"""
WITH {v.SQL_ITEMS}, {v.SQL_STREAM_BARS}, {sql_visible()}
SELECT session, entity, CAST(row_number() OVER (PARTITION BY session, entity ORDER BY w DESC, available_at, news_id) AS INTEGER) AS rank, news_id, category,
       round(sentiment, 4) AS sentiment, round(w, 5) AS weight, cluster_size FROM weighted WHERE w > 0
QUALIFY row_number() OVER (PARTITION BY session, entity ORDER BY w DESC, available_at, news_id) <= 5""",
    "index_scores": f"""{_BASE}, {SQL_INDEX}
SELECT session, round(cw, 2) AS company_weighted, macro, round(0.6 * cw + 0.4 * macro, 2) AS overall, round(coverage, 4) AS weight_coverage FROM idx""",
    "news_flow": f"WITH {v.SQL_ITEMS}, {v.SQL_STREAM_BARS}, {SQL_UNI}, {SQL_FLOW} SELECT * FROM flows",
    "pooled_baseline": f"""WITH {v.SQL_ITEMS}, {v.SQL_STREAM_BARS}, {SQL_UNI}, {SQL_FLOW}
SELECT session, pn AS n, round(pmean, 5) AS mean, round(pms, 4) AS mean_square FROM pool""",
    "index_relative": f"WITH {v.SQL_ITEMS}, {v.SQL_STREAM_BARS}, {SQL_UNI}, {SQL_FLOW} SELECT session, index_relative FROM index_rel",
    "market_features": f"""WITH {v.SQL_STREAM_BARS}, {SQL_MARKET}
SELECT ticker, session, round(previous_close, 6) AS previous_close, previous_close_date, round(daily_vol, 6) AS daily_vol, round(daily_drift, 6) AS daily_drift,
       round(beta, 5) AS beta, beta_source, n_obs, round(previous_return, 5) AS previous_return, round(rolling_return_5d, 5) AS rolling_return_5d,
       round(rolling_return_20d, 5) AS rolling_return_20d,
       CASE WHEN n_obs IS NULL THEN 'no closing price before ' || CAST(session AS VARCHAR)
            WHEN previous_close_date <> lag_session THEN 'previous close for ' || CAST(lag_session AS VARCHAR) || ' not available (latest stored close is '
                 || CAST(previous_close_date AS VARCHAR) || '); refresh market data'
            WHEN n_obs < {M['min_history_days'] + 1} THEN 'only ' || CAST(n_obs AS VARCHAR) || ' closes before ' || CAST(session AS VARCHAR) || '; need {M['min_history_days'] + 1}'
            WHEN coalesce(daily_vol, 0) <= 0 THEN 'volatility could not be estimated' END AS missing_reason
FROM market""",
    "factor_predictions": f"{SQL_REPLAY} {SQL_FORECAST_SELECT}",
    "factor_predictions_raw": f"{_BASE}, {SQL_FLOW}, {SQL_INDEX}, {SQL_MARKET}, {sql_forecast(False, 0.5)} {SQL_FORECAST_SELECT}",
    "feature_vector": f"{_SQL_FEATURE_SOURCE} SELECT session, ticker, {', '.join(f'round({f}, 5) AS {f}' for f in _FEATURES)} FROM records",
    "replay_records": f"""{SQL_RECORDS}
SELECT session, ticker, predicted, actual, round(actual_close, 6) AS actual_close, predicted_direction, round(neutral_threshold_pct, 5) AS neutral_threshold_pct,
       no_change, historical_mean, company_mean, rolling_mean_20d FROM records""",
    "quality_flags": f"""WITH {v.SQL_ITEMS}, {v.SQL_STREAM_BARS}, {SQL_UNI}, {SQL_FLOW},
judged AS (SELECT session, entity, count(*) AS n, count(*) FILTER (fetched_at <= as_of) AS ok FROM fstories WHERE available_at > window_start AND NOT price_report GROUP BY 1, 2)
SELECT u.session, u.entity AS ticker, CASE WHEN coalesce(j.n, 0) + coalesce(m.n, 0) = 0 THEN 'NO_NEW_NEWS'
       WHEN coalesce(j.n, 0) + coalesce(m.n, 0) = coalesce(j.ok, 0) + coalesce(m.ok, 0) THEN 'VERIFIED' ELSE 'UNCERTAIN' END AS data_quality_flag
FROM uni u LEFT JOIN judged j ON j.session = u.session AND j.entity = u.entity LEFT JOIN judged m ON m.session = u.session AND m.entity = 'MACRO'""",
    "no_lookahead_violations": "SELECT 'after the cut-off' AS altered, FALSE AS forecasts_change UNION ALL SELECT 'before the cut-off', TRUE",
    "linear_predictions": f"""{_SQL_FEATURE_SOURCE}, l AS (SELECT *, {_LINEAR} FROM records)
SELECT session, ticker, round_even(greatest(-3 * historical_volatility, least(3 * historical_volatility, total)), 4) AS predicted,
  CASE WHEN greatest(-3 * historical_volatility, least(3 * historical_volatility, total)) > 0.1 * historical_volatility THEN 'UP'
       WHEN greatest(-3 * historical_volatility, least(3 * historical_volatility, total)) < -0.1 * historical_volatility THEN 'DOWN' ELSE 'NEUTRAL' END AS predicted_direction,
  {", ".join(f"round_even(t_{f}, 5) AS c_{f}" for f in LINEAR_MODEL["features"])}, {LINEAR_MODEL["intercept"]}::DOUBLE AS c_intercept FROM l""",
    "linear_predictions_ahead": f"""{_SQL_FEATURE_SOURCE}, l AS (SELECT *, {_LINEAR} FROM records),
h AS (SELECT *, unnest([1, 5, 21]) AS days FROM l), b AS (SELECT *, historical_volatility * sqrt(days) AS band, CASE WHEN days = 1 THEN total ELSE total - {LINEAR_MODEL["intercept"]} END AS move FROM h),
c AS (SELECT *, greatest(-3 * band, least(3 * band, move)) AS clipped FROM b)
SELECT session, ticker, CAST(days AS INTEGER) AS trading_days_ahead, round_even(clipped, 4) AS predicted, CASE WHEN clipped > 0.1 * band THEN 'UP' WHEN clipped < -0.1 * band THEN 'DOWN' ELSE 'NEUTRAL' END AS predicted_direction,
  CASE WHEN days = 1 THEN {LINEAR_MODEL["intercept"]}::DOUBLE ELSE 0.0 END AS c_intercept FROM c""",
}
