"""Stored score snapshots, prediction runs and parameter tables: append-only, read by latest-wins views."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import local_frame


def score_snapshot(scores: DataFrame, index: DataFrame, run_id, as_of: str = "as_of") -> DataFrame:
    """Rows per entity plus MACRO, INDEX_COMPANY and INDEX for every horizon of a run."""
    keys = ["pos", "session", "horizon_type", "target_date"]
    own = scores.select(*keys, "entity", "score", "raw_mean", "evidence_weight", "news_count", F.lit(None).cast("double").alias("weight_coverage"))
    for column, name in (("company_weighted", "INDEX_COMPANY"), ("overall", "INDEX")):
        own = own.unionByName(index.select(
            *keys, F.lit(name).alias("entity"), F.col(column).alias("score"), F.lit(None).cast("double").alias("raw_mean"),
            F.lit(0.0).alias("evidence_weight"), F.lit(0).cast("bigint").alias("news_count"), "weight_coverage"))
    return own.withColumn("run_id", run_id)


def append_run(rows: DataFrame, path: str, run_id: str) -> None:
    """Persist the rows of one run (snapshots, predictions, replay records). A stored run is immutable: a second write fails."""
    rows.drop("run_id").write.mode("errorifexists").parquet(f"{path}/run_id={run_id}")


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """All rows of the newest live run."""
    newest = snapshots.where(~F.col("is_backtest")).groupBy().agg(F.max_by("run_id", F.struct("as_of", "run_id")).alias("run_id"))
    return snapshots.join(F.broadcast(newest), "run_id", "left_semi")


def nested_snapshot(snapshots: DataFrame) -> DataFrame:
    """One JSON document per horizon of a run: company scores, macro and index values."""
    company = ~F.col("entity").isin("MACRO", "INDEX", "INDEX_COMPANY")
    value = lambda e: F.max(F.when(F.col("entity") == e, F.col("score")))
    return snapshots.groupBy("run_id", "horizon_type", "target_date").agg(
        F.to_json(F.sort_array(F.collect_list(F.when(company, F.struct(F.col("entity").alias("ticker"), "score", "news_count", "evidence_weight"))))).alias("company_scores"),
        value("MACRO").alias("macro_score"), value("INDEX_COMPANY").alias("index_company_score"), value("INDEX").alias("index_score"))


def daily_history(snapshots: DataFrame, entity: str, horizon_type: str = "today", days: int = 90) -> DataFrame:
    """Last live run of each day, newest ``days`` days."""
    rows = snapshots.where((F.col("entity") == entity) & (F.col("horizon_type") == horizon_type) & ~F.col("is_backtest"))
    per_day = rows.groupBy(F.to_date("as_of").alias("date")).agg(
        F.max(F.struct("as_of", "run_id", "score")).alias("_l")).select("date", F.col("_l.as_of").alias("as_of"), F.col("_l.score").alias("score"))
    return per_day.orderBy(F.desc("date")).limit(days)


# ---- parameters -----------------------------------------------------------------------------------
def flatten(sets: DataFrame, whole: tuple[str, ...] = ("source_reliability",), levels: int = 4) -> DataFrame:
    """(version, name, value): one row per parameter from (version, params), params being a JSON object.

    Names join the keys of nested objects with dots; an object under a key of ``whole``, and what is nested deeper than ``levels``,
    stays one value. Values are JSON text.
    """
    level, leaves = sets.select("version", F.lit("").alias("path"), F.col("params").alias("text")), []
    for depth in range(levels):
        plain, typed = F.from_json("text", "map<string,string>"), F.from_json("text", "map<string,variant>")
        keys = level.select("version", "path", plain.alias("plain"), F.explode(typed).alias("key", "v"))
        rows = keys.select("version", "key", F.concat("path", "key").alias("name"), F.element_at("plain", F.col("key")).alias("text"), F.schema_of_variant("v").alias("kind"))
        inner = F.col("kind").startswith("OBJECT") & ~F.col("key").isin(*whole) if depth < levels - 1 else F.lit(False)
        text = F.when(F.col("kind") == "STRING", F.concat(F.lit('"'), "text", F.lit('"'))).otherwise(F.coalesce("text", F.lit("null")))
        leaves.append(rows.where(~inner).select("version", "name", text.alias("value")))
        level = rows.where(inner).select("version", F.concat("name", F.lit(".")).alias("path"), "text")
    return reduce(DataFrame.unionByName, leaves)


def fingerprints(rows: DataFrame) -> DataFrame:
    """(version, fingerprint): first ten hex digits of the SHA-256 of a set's rows, "name=value", sorted and joined by line breaks.

    A parameter set is configuration, so the rows of one version are few.
    """
    lines = F.array_sort(F.collect_list(F.concat_ws("=", "name", "value")))
    return rows.groupBy("version").agg(F.substring(F.sha2(F.array_join(lines, "\n"), 256), 1, 10).alias("fingerprint"))


def parameter_rows(spark, version: str, params: dict) -> DataFrame:
    return flatten(local_frame(spark, [(version, json.dumps(params))], "version string, params string"))


def parameter_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, old_value, new_value) of every parameter that differs or exists on one side only."""
    o, n = old.select("name", F.col("value").alias("old_value")), new.select("name", F.col("value").alias("new_value"))
    return o.join(n, "name", "full_outer").where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def complete_rows(rows: DataFrame, defaults: DataFrame) -> DataFrame:
    """Fill names missing from each version with the default value."""
    wanted = rows.select("version").distinct().crossJoin(F.broadcast(defaults.select("name", F.col("value").alias("_d"))))
    return rows.join(wanted, ["version", "name"], "full_outer").select("version", "name", F.coalesce("value", "_d").alias("value"))


def parameter_status(events: DataFrame) -> DataFrame:
    """Status per version from an append-only log (version, action: created | activated, at): exactly one active set."""
    activated = events.where("action = 'activated'")
    current = activated.groupBy().agg(F.max_by("version", F.struct("at", "version")).alias("_active"))
    ever = activated.select("version").distinct().withColumn("_was", F.lit(True))
    return (
        events.select("version").distinct().join(ever, "version", "left").crossJoin(F.broadcast(current))
        .select("version", F.when(F.col("version").eqNullSafe(F.col("_active")), "active").when(F.col("_was"), "archived").otherwise("candidate").alias("status"))
    )
