"""Structured Streaming versions of ingestion, news flow, baselines and outcome matching.

Everything that a stream adds up is a sum over rows, so each micro-batch writes its own partial sums and the totals are read by
adding them: no row is too late to count and no state grows. Each batch is one commit of its table, and what depends on earlier
batches (uniqueness, duplicates, outcomes) looks up the commits before it, so a batch that is delivered again leaves the table
as it is. Late rows are kept and labelled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.urls import url_hash
from tidemark.operators import dedup, outcomes
from tidemark.operators.calendar import Calendar
from tidemark.sources import validation
from tidemark.sources.commits import CommitLog


def labelled(path: str, event_time: str, delay_hours: int, transform=None, owner: str = "stream"):
    """Like ``exactly_once``, with a column ``late``: older than the newest row of earlier batches by more than the delay.

    The newest event time of a batch is a note in its commit.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        log = CommitLog(batch.sparkSession, path)
        if log.has(owner, batch_id):
            return
        seen = max((e.notes["newest"] for e in log.before(owner, batch_id) if "newest" in e.notes), default=None)
        horizon = F.timestamp_add("HOUR", F.lit(-delay_hours), F.lit(seen).cast("timestamp_ntz"))
        marked = batch.withColumn("late", F.coalesce(F.col(event_time) < horizon, F.lit(False)))
        newest = batch.agg(F.date_format(F.max(event_time), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0]
        log.write(transform(marked) if transform else marked, owner, batch_id, notes={"newest": newest} if newest else {})

    return write


def start(stream: DataFrame, writer, checkpoint: str, mode: str = "append", available_now: bool = True):
    """Run a stream into a foreachBatch writer (all available data once, or continuously)."""
    w = stream.writeStream.outputMode(mode).foreachBatch(writer).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def totals(table: DataFrame, *keys: str) -> DataFrame:
    """Partial sums of all batches added up per key."""
    return table.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in table.columns if c not in keys and c != "batch"))


# ---- S1, S2: ingestion ----------------------------------------------------------------------------
def accepted_articles(raw: DataFrame, now: Column) -> DataFrame:
    """Validated articles with their URL hash."""
    ok, _ = validation.split(validation.validate(raw, now))
    return ok.withColumn("url_hash", url_hash(F.col("url"))).withColumn("prefix", F.substring("url_hash", 1, 2))


def first_deliveries(seq: str = "news_id"):
    """Batch step: the first article of every URL that no earlier batch has.

    The table is partitioned by the first two digits of the URL hash, and only the partitions that the batch touches are looked up.
    """
    def step(batch: DataFrame, earlier) -> DataFrame:
        rest = [c for c in batch.columns if c not in (seq, "url_hash")]
        first = batch.groupBy("url_hash").agg(F.min(F.struct(seq, *rest)).alias("_r")).select("url_hash", "_r.*")
        touched = [r[0] for r in batch.select("prefix").distinct().collect()]  # at most 256
        known = earlier("url_hash string, prefix string").where(F.col("prefix").isin(touched))
        return first.join(known.select("url_hash"), "url_hash", "left_anti")

    return step


def near_duplicates_in(hours: int = 48, threshold: float = 0.8, seq: str = "news_id"):
    """Batch step: resolve a micro-batch against the non-duplicates of earlier batches within the window of the batch.

    Stored leaders precede the batch and do not resemble one another, so resolving both together reproduces the order of
    arrival exactly while reading only the recent rows.
    """
    def step(batch: DataFrame, earlier) -> DataFrame:
        bounds = batch.agg(F.min("published_at").alias("lo"), F.max("published_at").alias("hi")).first()
        if bounds["lo"] is None:
            return batch.withColumn("duplicate_of", F.lit(None).cast("bigint"))
        lo, hi = (F.timestamp_add("HOUR", F.lit(s * hours), F.lit(x).cast("timestamp_ntz")) for s, x in ((-1, bounds["lo"]), (1, bounds["hi"])))
        leaders = earlier(f"{seq} long, title string, published_at timestamp_ntz, duplicate_of long").where("duplicate_of IS NULL")
        recent = leaders.where(F.col("published_at").between(lo, hi)).select(seq, "title", "published_at")
        both = recent.unionByName(batch.select(seq, "title", "published_at"))
        return batch.join(dedup.near_duplicates(both, threshold, hours, seq), seq)

    return step


# ---- S3, S4: session windows ----------------------------------------------------------------------
def story_sums(calendar: Calendar):
    """Batch step: weighted sums per (session, entity, story); irregular sessions come from a join with the calendar."""
    def step(items: DataFrame) -> DataFrame:
        located = calendar.next_session(items, F.col("available_at"), "session").where(F.col("session").isNotNull())
        w = F.col("reliability") * F.col("relevance") * F.col("strength")
        return located.groupBy("session", "entity", "cluster_id").agg(
            F.count("*").alias("n"), F.count_if("late").alias("n_late"), F.sum(w).alias("w"), F.sum(w * F.col("sentiment")).alias("ws"))

    return step


def session_flow(sums: DataFrame, baseline_days: int) -> DataFrame:
    """(session, entity, stories, articles, late_articles, mean, baseline_n, baseline_mean, relative) from the sums of all batches.

    A story counts once with its weighted mean sentiment; the baseline are the stories of the days before the session.
    """
    stories = totals(sums, "session", "entity", "cluster_id").withColumn("score", F.try_divide("ws", "w"))
    flow = stories.groupBy("session", "entity").agg(
        F.count("score").alias("stories"), F.sum("n").alias("articles"), F.sum("n_late").alias("late_articles"), F.avg("score").alias("mean"),
        F.sum("score").alias("s"), F.sum(F.col("score") * F.col("score")).alias("ss"))
    daily = flow.select("entity", F.col("session").alias("day"), F.col("stories").alias("n"), "s", "ss")
    base = trailing_baseline(daily, baseline_days).select("entity", F.col("day").alias("session"), F.col("n").alias("baseline_n"), F.col("mean").alias("baseline_mean"))
    return flow.drop("s", "ss").join(base, ["session", "entity"], "left").withColumn("relative", F.col("mean") - F.col("baseline_mean"))


# ---- S5: trailing baselines -----------------------------------------------------------------------
def daily_statistics(items: DataFrame) -> DataFrame:
    """Batch step: sufficient statistics per (entity, day)."""
    return items.groupBy("entity", F.to_date("available_at").alias("day")).agg(
        F.count("*").alias("n"), F.count_if("late").alias("n_late"), F.sum("sentiment").alias("s"), F.sum(F.col("sentiment") * F.col("sentiment")).alias("ss"))


def trailing_baseline(daily: DataFrame, days: int) -> DataFrame:
    """(entity, day, n, mean, std) over the ``days`` days before each day, from one row per entity and day."""
    spread = daily.withColumn("_offset", F.explode(F.sequence(F.lit(1), F.lit(days)))).withColumn("for_day", F.date_add("day", F.col("_offset")))
    sums = spread.groupBy("entity", F.col("for_day").alias("day")).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    known = sums.join(daily.select("entity", "day"), ["entity", "day"], "left_semi")
    mean = F.col("s") / F.col("n")
    return known.select("entity", "day", "n", mean.alias("mean"),
                        F.when(F.col("n") > 1, F.sqrt(F.greatest(F.lit(0.0), (F.col("ss") - F.col("s") * mean) / F.nullif(F.col("n") - 1, F.lit(0))))).alias("std"))


# ---- S6: arrival counts ---------------------------------------------------------------------------
def arrivals(size: str = "1 day", slide: str | None = None):
    """Batch step: tumbling or sliding counts of arrivals per provider and status, late ones also apart."""
    def step(news: DataFrame) -> DataFrame:
        at = F.col("published_at").cast("timestamp")
        window = F.window(at, size, slide) if slide else F.window(at, size)
        return news.groupBy(window.alias("_w"), "provider", "timezone_status").agg(F.count("*").alias("n"), F.count_if("late").alias("n_late")).select(
            F.col("_w.start").cast("timestamp_ntz").alias("window_start"), "provider", "timezone_status", "n", "n_late")

    return step


# ---- S7: outcomes ---------------------------------------------------------------------------------
def outcome_step(predictions, held, thresholds, now: Column):
    """Batch step: new bars mature pending predictions, each once. ``predictions()`` and ``held()`` (prediction_id) read the stored tables."""
    def step(bars: DataFrame, earlier) -> DataFrame:
        known = held().select("prediction_id").unionByName(earlier("prediction_id long").select("prediction_id"))
        touched = predictions().join(bars.select("ticker", F.col("date").alias("target_date")).distinct(), ["ticker", "target_date"], "left_semi")
        rows, _ = outcomes.match_outcomes(touched, known, bars, thresholds(), now)
        return rows

    return step
