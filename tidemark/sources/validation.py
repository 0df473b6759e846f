"""Article validation, reject accounting and the fetch log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REASONS = ("invalid", "missing_timestamp", "future_timestamp")
MAX_FUTURE_MINUTES = 15


def reject_reason(title: Column, url: Column, published: Column, now: Column) -> Column:
    return (
        F.when(title.isNull() | (F.trim(title) == ""), "invalid")
        .when(~F.coalesce(url.rlike("^https?://"), F.lit(False)), "invalid")
        .when(published.isNull(), "missing_timestamp")
        .when(published > F.timestamp_add("MINUTE", F.lit(MAX_FUTURE_MINUTES), now), "future_timestamp"))


def validate(raw: DataFrame, now: Column) -> DataFrame:
    """Add reject_reason (null = accepted); accepted titles are trimmed and sources defaulted."""
    return raw.withColumn("reject_reason", reject_reason(F.col("title"), F.col("url"), F.col("published_at"), now)).withColumn(
        "title", F.trim("title")).withColumn("source", F.trim(F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown"))))


def split(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    return validated.where(F.col("reject_reason").isNull()).drop("reject_reason"), validated.where(F.col("reject_reason").isNotNull())


def reject_counts(validated: DataFrame) -> DataFrame:
    return validated.groupBy("provider").agg(
        F.count("*").alias("fetched"), F.count_if(F.col("reject_reason").isNull()).alias("accepted"),
        *[F.count_if(F.col("reject_reason") == r).alias(f"rejected_{r}") for r in REASONS])


def fetch_log(resolved: DataFrame, started_at: Column) -> DataFrame:
    """One row per (provider, query). ``resolved`` carries reject_reason, is_exact_duplicate and duplicate_of."""
    ok = F.col("reject_reason").isNull()
    duplicate = ok & (F.col("is_exact_duplicate") | F.col("duplicate_of").isNotNull())
    return resolved.groupBy("provider", "query").agg(
        F.count("*").alias("fetched"), F.count_if(ok & ~F.col("is_exact_duplicate")).alias("new_items"), F.count_if(duplicate).alias("duplicates_at_collection"),
        F.count_if(F.col("reject_reason") == "future_timestamp").alias("rejected_future"),
        F.count_if(F.col("reject_reason") == "missing_timestamp").alias("rejected_missing_timestamp"),
        F.count_if(F.col("reject_reason") == "invalid").alias("rejected_invalid")).withColumn("started_at", started_at).withColumn("status", F.lit("ok"))
