"""Domain views (items, news, bars, universe) over the generic benchmark tables.

The view definitions are plain column rules shared by the Spark views and the SQL text of the checks; the
operators applied to them are not shared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.availability import available_at
from tidemark.functions.timestamps import plus_days
from tidemark.params import MODEL_PARAMS, NEWS_PARAMS
from tidemark.session import local_frame, ship_package, use_utc

# Column rules valid in both SQL dialects.
ENTITY = "CASE WHEN event_type = 'error' THEN 'MACRO' ELSE event_type END"
CATEGORY = (
    "CASE WHEN event_type = 'error' THEN (CASE event_id % 5 WHEN 0 THEN 'interest_rate' WHEN 1 THEN 'inflation' "
    "WHEN 2 THEN 'gdp' WHEN 3 THEN 'currency' ELSE 'market_wrap' END) ELSE (CASE event_id % 5 WHEN 0 THEN 'earnings' "
    "WHEN 1 THEN 'guidance' WHEN 2 THEN 'contract' WHEN 3 THEN 'regulatory' ELSE 'analyst_rating' END) END"
)
PRECISION = "CASE event_id % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'minute' WHEN 2 THEN 'hour' ELSE 'date_only' END"
ZONE_STATUS = "CASE WHEN event_id % 7 = 0 THEN 'unknown' ELSE 'explicit' END"
PROVIDER = (
    "CASE event_id % 5 WHEN 0 THEN 'google_news_rss' WHEN 1 THEN 'publisher_rss' WHEN 2 THEN 'newsapi' "
    "WHEN 3 THEN 'gnews' ELSE 'marketaux' END"
)
RELEVANCE = "least(CAST(1.0 AS DOUBLE), CAST(0.2 AS DOUBLE) + CAST(0.1 AS DOUBLE) * CAST(event_id % 9 AS DOUBLE))"
SENTIMENT = (
    "greatest(CAST(-100.0 AS DOUBLE), least(CAST(100.0 AS DOUBLE), (value - CAST(35 AS DOUBLE)) * CAST(1.5 AS DOUBLE)))"
)
STRENGTH = (
    "CAST(CASE event_id % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.7 WHEN 3 THEN 0.6 ELSE 0.5 END AS DOUBLE)"
)
RELIABILITY = (
    "CAST(CASE event_id % 6 WHEN 0 THEN 0.95 WHEN 1 THEN 0.85 WHEN 2 THEN 0.8 WHEN 3 THEN 0.75 WHEN 4 THEN 0.6 "
    "ELSE 0.85 END AS DOUBLE)"
)
HALF_LIFE = (
    "CAST(CASE event_id % 5 WHEN 0 THEN 10 WHEN 1 THEN 20 WHEN 2 THEN 15 WHEN 3 THEN 45 ELSE 5 END AS DOUBLE)"
)

#: Everything up to the first full stop, question or exclamation mark, or line break, however long.
FIRST_SENTENCE = r"^[^.!?\n]*"

# Parameters sized for a 30-day event stream.
STREAM_NEWS_PARAMS = {**NEWS_PARAMS, "max_lookback_days": 12, "baseline_days": 8, "min_baseline_n": 350}
STREAM_MODEL_PARAMS = {**MODEL_PARAMS, "min_history_days": 5, "vol_lookback_days": 10, "drift_lookback_days": 15,
                       "beta_lookback_days": 15, "sensitivity": 0.8}

# (version, effective_from, effective_to, status, source) and their members.
UNIVERSE_VERSIONS = [
    ("base", "1990-01-01", None, "confirmed", "initial"),
    ("mid", "2024-01-16", None, "confirmed", "review"),
    ("next", "2024-01-20", None, "requires_confirmation", "proposal"),
    ("short", "2024-01-10", "2024-01-12", "confirmed", "interim"),
]
UNIVERSE_MEMBERS = [
    ("base", "click", 13.71), ("base", "view", 9.13), ("base", "signup", 7.37), ("base", "purchase", 4.91),
    ("mid", "click", 11.59), ("mid", "view", 8.83), ("mid", "purchase", 6.17),
    ("next", "click", 10.33), ("next", "signup", 5.71),
    ("short", "click", 12.41), ("short", "view", 9.77), ("short", "signup", 6.53), ("short", "purchase", 3.89),
]
CATALOG = [("click", "Click Ltd", "Financials"), ("view", "View Ltd", "Energy"), ("signup", "Signup Ltd", "Information Technology"),
           ("purchase", "Purchase Ltd", "Industrials")]
SENSITIVITY = [
    ("Financials", "interest_rate", 1.3), ("Financials", "inflation", 1.2), ("Financials", "gdp", 1.1),
    ("Financials", "currency", 0.8), ("Energy", "interest_rate", 0.7), ("Energy", "inflation", 0.7),
    ("Energy", "gdp", 0.9), ("Information Technology", "interest_rate", 0.5), ("Information Technology", "currency", 0.6),
    ("Industrials", "gdp", 1.2), ("Industrials", "inflation", 0.9),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    use_utc(spark)
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored (article, entity) facts from the event stream; only the needed columns reach the scan."""
    ev = table(spark, sf_dir, "events")
    out = ev.select(
        F.col("event_id").alias("news_id"), F.expr("event_id - event_id % 3").alias("cluster_id"),
        F.expr(ENTITY).alias("entity"), F.expr("event_type = 'error'").alias("is_macro"), F.expr(CATEGORY).alias("category"),
        F.expr(RELEVANCE).alias("relevance"), F.expr(SENTIMENT).alias("sentiment"), F.expr(STRENGTH).alias("strength"),
        F.expr(RELIABILITY).alias("reliability"), F.expr(HALF_LIFE).alias("half_life_days"),
        F.col("ts").alias("provider_published_at"),
        F.expr("CASE WHEN event_id % 13 <> 0 THEN timestampadd(HOUR, CAST((event_id % 5) * 6 AS INT), ts) END").alias("fetched_at"),
        F.expr(PRECISION).alias("timestamp_precision"), F.expr(ZONE_STATUS).alias("timezone_status"),
        F.expr("event_id % 11 = 0").alias("price_report"), F.concat(F.lit("s"), (F.col("user_id") % 6).cast("string")).alias("source"),
        F.concat("event_type", F.lit(" "), F.col("event_id").cast("string")).alias("title"), F.lit("lexicon-v3").alias("engine"))
    return out.withColumn("available_at", available_at(
        F.col("provider_published_at"), F.col("timestamp_precision"), F.col("fetched_at"), F.col("timezone_status")))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored articles; two of three events repeat the first one of their triple."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("news_id"), F.expr(PROVIDER).alias("provider"),
        F.concat(F.lit("s"), (F.col("user_id") % 6).cast("string")).alias("source"),
        F.concat("event_type", F.lit(" "), F.col("event_id").cast("string")).alias("title"),
        F.col("ts").alias("published_at"),
        F.expr("CASE WHEN event_id % 13 <> 0 THEN timestampadd(HOUR, CAST((event_id % 5) * 6 AS INT), ts) END").alias("fetched_at"),
        F.expr(PRECISION).alias("timestamp_precision"), F.expr(ZONE_STATUS).alias("timezone_status"),
        F.expr("CASE WHEN event_id % 3 <> 0 THEN event_id - event_id % 3 END").alias("duplicate_of"),
        F.expr("event_id % 10 = 0").alias("backfilled"))


def analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One analysis row per article; every 17th article is irrelevant."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("news_id"), F.expr(f"CASE WHEN event_id % 17 = 0 THEN 'NONE' ELSE {ENTITY} END").alias("entity"),
        F.expr(CATEGORY).alias("category"), F.expr(RELEVANCE).alias("relevance"), F.expr(SENTIMENT).alias("sentiment"),
        F.lit("lexicon-v3").alias("engine"))


def stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily closes of the four companies of the event stream (with some missing days)."""
    ev = table(spark, sf_dir, "events")
    return (
        ev.where("event_type <> 'error'")
        .groupBy(F.col("event_type").alias("ticker"), F.to_date("ts").alias("date"))
        .agg((100 + F.avg("value")).alias("close"))
        .where("NOT (ticker = 'signup' AND day(date) % 11 = 0)")
    )


def stream_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.groupBy(F.to_date("ts").alias("date")).agg((100 + F.avg("value")).alias("close"))


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily closes per order priority, weekdays only (1995-2001)."""
    o = table(spark, sf_dir, "orders").where("weekday(o_orderdate) < 5")
    return o.groupBy(F.col("o_orderpriority").alias("ticker"), F.to_date("o_orderdate").alias("date")).agg(
        F.avg("o_totalprice").alias("close"))


def order_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("weekday(o_orderdate) < 5")
    return o.groupBy(F.to_date("o_orderdate").alias("date")).agg(F.avg("o_totalprice").alias("close"))


def universe(spark: SparkSession) -> DataFrame:
    versions = local_frame(
        spark, UNIVERSE_VERSIONS, "version string, effective_from string, effective_to string, status string, source string"
    ).withColumn("effective_from", F.col("effective_from").cast("date")).withColumn(
        "effective_to", F.col("effective_to").cast("date"))
    members = local_frame(spark, UNIVERSE_MEMBERS, "version string, ticker string, weight double")
    return members.join(versions, "version")


def catalog(spark: SparkSession) -> DataFrame:
    return local_frame(spark, CATALOG, "ticker string, name string, sector string")


def sensitivity(spark: SparkSession) -> DataFrame:
    return local_frame(spark, SENSITIVITY, "sector string, category string, multiplier double")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: whole text as summary, its whole first sentence as headline."""
    d = table(spark, sf_dir, "documents")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return d.select(
        F.col("doc_id").alias("news_id"), F.regexp_extract("text", FIRST_SENTENCE, 0).alias("title"), F.col("text").alias("summary"), "source", "lang",
        F.timestamp_add("SECOND", (F.col("doc_id") * 7919) % 2592000, start).alias("published_at"))


# ---- SQL text of the same views for the checks ----------------------------------------------------
SQL_ITEMS = f"""
raw_items AS (
  SELECT event_id AS news_id, event_id - event_id % 3 AS cluster_id, {ENTITY} AS entity, {CATEGORY} AS category,
         {RELEVANCE} AS relevance, {SENTIMENT} AS sentiment, {STRENGTH} AS strength, {RELIABILITY} AS reliability,
         {HALF_LIFE} AS half_life_days, ts AS provider_published_at,
         CASE WHEN event_id % 13 <> 0 THEN ts + to_hours(CAST((event_id % 5) * 6 AS INTEGER)) END AS fetched_at,
         {PRECISION} AS timestamp_precision, {ZONE_STATUS} AS timezone_status, event_id % 11 = 0 AS price_report,
         's' || CAST(user_id % 6 AS VARCHAR) AS source, event_type || ' ' || CAST(event_id AS VARCHAR) AS title
  FROM events),
stamped AS (
  SELECT *, CASE WHEN timestamp_precision = 'date_only' OR timezone_status = 'unknown'
                 THEN CAST(CAST(provider_published_at AS DATE) + 1 AS TIMESTAMP)
                 WHEN timestamp_precision = 'hour' THEN provider_published_at + INTERVAL 1 HOUR
                 ELSE provider_published_at END AS provider_available_at
  FROM raw_items),
items AS (SELECT *, CASE WHEN fetched_at < provider_available_at THEN fetched_at ELSE provider_available_at END AS available_at
          FROM stamped)"""
SQL_NEWS = f"""
news AS (
  SELECT event_id AS news_id, {PROVIDER} AS provider, 's' || CAST(user_id % 6 AS VARCHAR) AS source, ts AS published_at,
         event_type || ' ' || CAST(event_id AS VARCHAR) AS title,
         CASE WHEN event_id % 13 <> 0 THEN ts + to_hours(CAST((event_id % 5) * 6 AS INTEGER)) END AS fetched_at,
         {PRECISION} AS timestamp_precision, {ZONE_STATUS} AS timezone_status,
         CASE WHEN event_id % 3 <> 0 THEN event_id - event_id % 3 END AS duplicate_of, event_id % 10 = 0 AS backfilled
  FROM events),
analysis AS (
  SELECT event_id AS news_id, CASE WHEN event_id % 17 = 0 THEN 'NONE' ELSE {ENTITY} END AS entity, {CATEGORY} AS category,
         {RELEVANCE} AS relevance, {SENTIMENT} AS sentiment, 'lexicon-v3' AS engine FROM events)"""
SQL_STREAM_BARS = """
bars AS (
  SELECT event_type AS ticker, CAST(ts AS DATE) AS date, 100 + avg(value) AS close FROM events WHERE event_type <> 'error'
  GROUP BY 1, 2 HAVING NOT (event_type = 'signup' AND day(CAST(ts AS DATE)) % 11 = 0)),
index_bars AS (SELECT CAST(ts AS DATE) AS date, 100 + avg(value) AS close FROM events GROUP BY 1),
calendar AS (
  SELECT date AS session, row_number() OVER (ORDER BY date) AS idx, CAST(date AS TIMESTAMP) + INTERVAL 225 MINUTE AS open_utc,
         CAST(date AS TIMESTAMP) + INTERVAL 600 MINUTE AS close_utc
  FROM (SELECT DISTINCT date FROM bars)),
cutoffs AS (
  SELECT session, idx, open_utc AS as_of, lag(open_utc) OVER (ORDER BY session) AS window_start, close_utc FROM calendar
  QUALIFY lag(open_utc) OVER (ORDER BY session) IS NOT NULL)"""
SQL_ORDER_BARS = """
bars AS (
  SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS close FROM orders
  WHERE isodow(o_orderdate) < 6 GROUP BY 1, 2),
index_bars AS (SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS close FROM orders WHERE isodow(o_orderdate) < 6 GROUP BY 1),
calendar AS (
  SELECT date AS session, row_number() OVER (ORDER BY date) AS idx, CAST(date AS TIMESTAMP) + INTERVAL 225 MINUTE AS open_utc,
         CAST(date AS TIMESTAMP) + INTERVAL 600 MINUTE AS close_utc
  FROM (SELECT DISTINCT date FROM bars))"""


def _values(rows) -> str:
    def lit(v):
        return "NULL" if v is None else (f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)")

    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


SQL_UNIVERSE = f"""
versions AS (
  SELECT version, CAST(f AS DATE) AS effective_from, CAST(t AS DATE) AS effective_to, status, source
  FROM (VALUES {_values(UNIVERSE_VERSIONS)}) v(version, f, t, status, source)),
members AS (SELECT * FROM (VALUES {_values(UNIVERSE_MEMBERS)}) m(version, ticker, weight)),
catalog AS (SELECT * FROM (VALUES {_values(CATALOG)}) c(ticker, name, sector)),
sensitivity AS (SELECT * FROM (VALUES {_values(SENSITIVITY)}) s(sector, category, multiplier))"""
SQL_ARTICLES = f"""
articles AS (
  SELECT doc_id AS news_id, regexp_extract(text, '{FIRST_SENTENCE}', 0) AS title, text AS summary, source, lang,
         TIMESTAMP '2024-01-01' + to_seconds((doc_id * 7919) % 2592000) AS published_at
  FROM documents)"""
