"""Registered queries that drive the streaming jobs over the given tables in several micro-batches, with late rows in the later ones."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans import article_queries as aq
from tidemark.plans import market_queries as mq
from tidemark.plans.news_queries import stream_calendar
from tidemark.session import ensure_checkpoint_dir
from tidemark.sources import bench_views as v
from tidemark.sources.commits import CommitLog, exactly_once
from tidemark.streaming import jobs, state

#: Deliveries that the source is split into, by a key: each covers the whole period, so later ones bring late rows.
DELIVERIES = 3
DELAY_HOURS = 48


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def _deliver(spark: SparkSession, rows: DataFrame, key: Column, folder: str, writer) -> None:
    """Append one delivery after the other to a source folder and run the stream over what is new."""
    for k in range(DELIVERIES):
        rows.where(F.pmod(key, F.lit(DELIVERIES)) == k).write.mode("append").parquet(f"{folder}/source")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/source")
        jobs.start(stream, writer, f"{folder}/offsets").awaitTermination()


def _table(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return CommitLog(spark, f"{folder}/out").read(schema)


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validated articles, one per canonical URL over all deliveries: the first one delivered."""
    e = F.col("event_id")
    raw = v.table(spark, sf_dir, "events").select(
        ((e % DELIVERIES) * 10**12 + e).alias("news_id"), F.expr(v.PROVIDER).alias("provider"), F.lit("s").alias("source"),
        F.concat("event_type", F.lit(" "), F.col("user_id").cast("string")).alias("title"),
        F.concat(F.lit("http://x.com/a?id="), (F.col("user_id") % 97).cast("string"), F.lit("&k="), F.col("event_type"), F.lit("&utm_source="), e.cast("string")).alias("url"),
        F.when(e % 19 != 0, F.col("ts")).alias("published_at"))
    folder = _folder(spark)
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    step = jobs.first_deliveries()
    _deliver(spark, raw, e_of(F.col("news_id")), folder, exactly_once(f"{folder}/out", lambda batch, earlier: step(jobs.accepted_articles(batch, now), earlier), partition_by=("prefix",)))
    return _table(spark, folder, "url_hash string, news_id long")


def e_of(news_id: Column) -> Column:
    """The delivery that an arrival number belongs to."""
    return F.floor(news_id / 10**12)


def stream_near_duplicates(spark, sf_dir):
    """Near-duplicates of every delivery against the stored leaders."""
    a = v.articles(spark, sf_dir)
    rows = a.select(((F.col("news_id") % DELIVERIES) * 10**12 + F.col("news_id")).alias("news_id"), "title", "published_at")
    folder = _folder(spark)
    _deliver(spark, rows, e_of(F.col("news_id")), folder, exactly_once(f"{folder}/out", jobs.near_duplicates_in()))
    return _table(spark, folder, "news_id long, duplicate_of long").select("news_id", "duplicate_of", F.coalesce("duplicate_of", "news_id").alias("cluster_id"))


def stream_session_flow(spark, sf_dir):
    """News flow per session and entity, stories collapsed, against the stories of the week before; late articles count and are told."""
    folder = _folder(spark)
    writer = jobs.labelled(f"{folder}/out", "available_at", DELAY_HOURS, jobs.story_sums(stream_calendar(spark, sf_dir)))
    _deliver(spark, v.items(spark, sf_dir), F.col("news_id"), folder, writer)
    out = jobs.session_flow(_table(spark, folder, "session date, entity string, cluster_id long, n long, n_late long, w double, ws double"), 7)
    rounded = [F.round(c, 6).alias(c) for c in ("mean", "baseline_mean", "relative")]
    return out.select("session", "entity", "stories", "articles", "late_articles", "baseline_n", *rounded)


def stream_arrivals(spark, sf_dir):
    """Sliding daily counts every six hours."""
    folder = _folder(spark)
    _deliver(spark, v.news(spark, sf_dir), F.col("news_id"), folder, jobs.labelled(f"{folder}/out", "published_at", DELAY_HOURS, jobs.arrivals("1 day", "6 hours")))
    rows = jobs.totals(_table(spark, folder, "window_start timestamp_ntz, provider string, timezone_status string, n long, n_late long"), "window_start", "provider", "timezone_status")
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "provider", "timezone_status", "n", "n_late")


def stream_baseline(spark, sf_dir):
    """Trailing seven-day mean and deviation per entity from streamed daily statistics."""
    folder = _folder(spark)
    _deliver(spark, v.items(spark, sf_dir), F.col("news_id"), folder, jobs.labelled(f"{folder}/out", "available_at", DELAY_HOURS, jobs.daily_statistics))
    daily = jobs.totals(_table(spark, folder, "entity string, day date, n long, n_late long, s double, ss double"), "entity", "day")
    return jobs.trailing_baseline(daily, 7).select("entity", "day", "n", F.round("mean", 9).alias("mean"), F.round("std", 7).alias("std"))


#: Ten-day stretches are delivered one after the other; every tenth item of the first one comes two deliveries late.
LATENESS_DAYS = 12


def stream_baseline_state(spark, sf_dir):
    """S5 with keyed state: the baseline of every entity and day from the days that late items can still reach, the last return of each."""
    folder = _folder(spark)
    day = F.to_date("available_at")
    stretch = F.least(F.lit(2), F.floor((F.dayofmonth(day) - 1) / 10)).cast("long")
    rows = v.items(spark, sf_dir).where(day < F.lit("2024-02-01").cast("date")).select(
        F.when((stretch == 0) & (F.col("news_id") % 10 == 0), 2).otherwise(stretch).alias("delivery"), "entity", day.alias("day"), "sentiment")
    write = exactly_once(f"{folder}/out")
    for k in range(DELIVERIES):
        rows.where(F.col("delivery") == k).write.mode("append").parquet(f"{folder}/source")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/source")
        x = F.col("sentiment")
        out = state.running_baseline(stream.select("entity", "day", F.lit(1).cast("long").alias("n"), x.alias("s"), (x * x).alias("ss")), 7, LATENESS_DAYS)
        jobs.start(out, lambda b, i: write(b.withColumn("batch", F.lit(i).cast("long")), i), f"{folder}/offsets", "update").awaitTermination()
    got = _table(spark, folder, state.BASELINE + ", batch long").where("too_late IS NULL")
    last = got.groupBy("entity", "day").agg(F.max_by(F.struct("n", "mean", "std"), "batch").alias("b"))
    return last.select("entity", "day", "b.n", F.round("b.mean", 9).alias("mean"), F.round("b.std", 7).alias("std"))


def stream_outcomes(spark, sf_dir):
    """Closes that arrive in deliveries mature stored predictions, each once."""
    folder = _folder(spark)
    p = mq._predictions(spark, sf_dir)
    held = mq._known(p).select("prediction_id")
    step = jobs.outcome_step(lambda: p, lambda: held, lambda: mq._thresholds(spark), F.lit(mq._NOW).cast("timestamp_ntz"))
    _deliver(spark, v.stream_bars(spark, sf_dir), F.day("date"), folder, exactly_once(f"{folder}/out", step))
    rows = _table(spark, folder, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in step(v.stream_bars(spark, sf_dir), lambda schema: spark.createDataFrame([], schema)).schema))
    return rows.join(p.select("prediction_id", "session", "ticker"), "prediction_id").drop("prediction_id").withColumn("actual_close", F.round("actual_close", 6))


QUERIES = {f.__name__: f for f in (stream_dedup, stream_near_duplicates, stream_session_flow, stream_arrivals, stream_baseline, stream_baseline_state, stream_outcomes)}

# A row is late if the newest row of an earlier delivery is more than the delay after it.
_LATE = """seen AS (SELECT {key} % {n} AS k, max({at}) AS newest FROM {rows} GROUP BY 1),
lated AS (SELECT r.*, coalesce({at} < (SELECT max(newest) FROM seen WHERE seen.k < r.{key} % {n}) - INTERVAL {h} HOUR, FALSE) AS late FROM {rows} r)"""


def _late(rows: str, at: str, key: str = "news_id") -> str:
    return _LATE.format(rows=rows, at=at, key=key, n=DELIVERIES, h=DELAY_HOURS)


ORACLES = {
    "stream_dedup": f"""SELECT sha256('http://x.com/a?id=' || CAST(user_id % 97 AS VARCHAR) || '&k=' || event_type) AS url_hash, min(event_id % {DELIVERIES} * 1000000000000 + event_id) AS news_id
FROM events WHERE event_id % 19 <> 0 GROUP BY 1""",
    "stream_near_duplicates": aq.ORACLES["near_dup_leaders"].replace("SELECT doc_id AS news_id,", f"SELECT doc_id % {DELIVERIES} * 1000000000000 + doc_id AS news_id,"),
    "stream_session_flow": f"""WITH {v.SQL_ITEMS}, {v.SQL_STREAM_BARS}, {_late("items", "available_at")},
x AS (SELECT c.session, i.* FROM lated i ASOF JOIN calendar c ON i.available_at <= c.open_utc),
st AS (SELECT session, entity, cluster_id, count(*) AS n, count(*) FILTER (late) AS nl, sum(reliability * relevance * strength * sentiment) / sum(reliability * relevance * strength) AS score FROM x GROUP BY 1, 2, 3),
f AS (SELECT session, entity, count(*) AS stories, CAST(sum(n) AS BIGINT) AS articles, CAST(sum(nl) AS BIGINT) AS late_articles, avg(score) AS m FROM st GROUP BY 1, 2),
b AS (SELECT f.session, f.entity, count(*) AS bn, avg(score) AS bm FROM f JOIN st ON st.entity = f.entity AND st.session < f.session AND st.session >= f.session - 7 GROUP BY 1, 2)
SELECT session, entity, stories, articles, late_articles, bn AS baseline_n, round(m, 6) AS mean, round(bm, 6) AS baseline_mean, round(m - bm, 6) AS relative FROM f LEFT JOIN b USING (session, entity)""",
    "stream_arrivals": f"""WITH {v.SQL_NEWS}, {_late("news", "published_at")}, w AS (SELECT *, unnest([0, 6, 12, 18]) AS h FROM lated)
SELECT strftime(time_bucket(INTERVAL 6 HOUR, published_at, TIMESTAMP '2024-01-01') - to_hours(CAST(h AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS window_start, provider, timezone_status, count(*) AS n,
  count(*) FILTER (late) AS n_late FROM w GROUP BY 1, 2, 3""",
    "stream_baseline": f"""WITH {v.SQL_ITEMS}, d AS (SELECT entity, CAST(available_at AS DATE) AS day, sentiment FROM items), k AS (SELECT DISTINCT entity, day FROM d)
SELECT k.entity, k.day, count(*) AS n, round(avg(sentiment), 9) AS mean, round(stddev_samp(sentiment), 7) AS std FROM k JOIN d ON d.entity = k.entity AND d.day < k.day AND d.day >= k.day - 7 GROUP BY 1, 2""",
    "stream_baseline_state": f"""WITH {v.SQL_ITEMS}, r AS (SELECT entity, CAST(available_at AS DATE) AS day, sentiment, news_id, least(2, (day(available_at) - 1) // 10) AS st FROM items WHERE available_at < TIMESTAMP '2024-02-01'),
q AS (SELECT *, CASE WHEN st = 0 AND news_id % 10 = 0 THEN 2 ELSE st END AS k FROM r), n AS (SELECT entity, k, max(day) AS newest FROM q GROUP BY 1, 2),
f AS (SELECT q.entity, q.k, max(n.newest) AS newest FROM (SELECT DISTINCT entity, k FROM q) q JOIN n ON n.entity = q.entity AND n.k < q.k GROUP BY 1, 2),
d AS (SELECT q.* FROM q LEFT JOIN f ON f.entity = q.entity AND f.k = q.k WHERE f.newest IS NULL OR q.day >= f.newest - {LATENESS_DAYS}), k AS (SELECT DISTINCT entity, day FROM d)
SELECT k.entity, k.day, count(*) AS n, round(avg(sentiment), 9) AS mean, round(stddev_samp(sentiment), 7) AS std FROM k JOIN d ON d.entity = k.entity AND d.day < k.day AND d.day >= k.day - 7 GROUP BY 1, 2""",
    "stream_outcomes": mq.ORACLES["outcome_rows"],
}
