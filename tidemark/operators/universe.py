"""Date-effective universe membership. Versions are immutable; only confirmed ones are ever used.

Members: version, ticker, weight, effective_from, effective_to (null = open), status[, source, source_date].
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CONFIRMED = "confirmed"
_VERSION = ["version", "effective_from", "effective_to", "status"]


def version_table(members: DataFrame) -> DataFrame:
    return members.select(*_VERSION).distinct()


def _covering(members: DataFrame, days: DataFrame, day: str) -> DataFrame:
    """(day, version, ...) for every version covering a day: version intervals are expanded to days, then joined by equality."""
    bounds = days.agg(F.min(day).alias("_lo"), F.max(day).alias("_hi"))
    spans = version_table(members).crossJoin(F.broadcast(bounds)).select(
        *_VERSION, F.greatest("effective_from", "_lo").alias("_a"), F.least(F.coalesce("effective_to", "_hi"), "_hi").alias("_b"))
    covered = spans.where(F.col("_a") <= F.col("_b")).withColumn(day, F.explode(F.sequence("_a", "_b"))).drop("_a", "_b")
    return days.select(day).distinct().join(covered, day)


def universe_asof(members: DataFrame, days: DataFrame, day: str = "day") -> DataFrame:
    """(day, version): the confirmed version with the latest effective_from covering each day."""
    live = _covering(members, days, day).where(F.col("status") == CONFIRMED)
    best = live.groupBy(day).agg(F.max_by("version", F.struct("effective_from", "version")).alias("version"))
    return days.select(day).distinct().join(best, day, "left")


def members_asof(members: DataFrame, days: DataFrame, day: str = "day") -> DataFrame:
    """(day, version, ticker, weight) of the universe effective on each day; a missing weight counts as zero."""
    chosen = universe_asof(members, days, day).where(F.col("version").isNotNull())
    return chosen.join(members.select("version", "ticker", F.coalesce("weight", F.lit(0.0)).alias("weight")), "version").select(
        day, "version", "ticker", "weight")


def pending_versions(members: DataFrame, days: DataFrame, day: str = "day") -> DataFrame:
    """Unconfirmed versions covering a day that are not older than the active one."""
    cover = _covering(members, days, day)
    active = cover.where(F.col("status") == CONFIRMED).groupBy(day).agg(F.max("effective_from").alias("_active_from"))
    return (
        cover.where(F.col("status") != CONFIRMED).join(active, day, "left")
        .where(F.col("_active_from").isNull() | (F.col("effective_from") >= F.col("_active_from")))
        .select(day, "version", "effective_from")
    )


def membership_diff(members: DataFrame, days: DataFrame, day: str = "day") -> DataFrame:
    """(day, version, ticker, change): what a pending version would add to or remove from the active universe."""
    pending = pending_versions(members, days, day).join(members.select("version", "ticker"), "version").select(day, "version", "ticker")
    active = members_asof(members, days, day).select(day, "ticker")
    added = pending.join(active, [day, "ticker"], "left_anti").withColumn("change", F.lit("would_add"))
    removed = (
        pending.select(day, "version").distinct().join(active, day)
        .join(pending, [day, "version", "ticker"], "left_anti").withColumn("change", F.lit("would_remove"))
    )
    return added.select(day, "version", "ticker", "change").unionByName(removed.select(day, "version", "ticker", "change"))


def universe_periods(members: DataFrame, days: DataFrame, day: str = "day") -> DataFrame:
    """Maximal runs of consecutive days with one version (gaps and islands over the given days)."""
    chosen = universe_asof(members, days, day)
    order = Window.orderBy(day)  # calendar-sized: one row per day
    islands = chosen.withColumn(
        "_new", F.when(F.lag("version").over(order).eqNullSafe(F.col("version")) & F.lag(day).over(order).isNotNull(), 0).otherwise(1))
    runs = islands.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("_run", "version").agg(F.min(day).alias("date_from"), F.max(day).alias("date_to")).drop("_run")


def ever_confirmed(members: DataFrame) -> DataFrame:
    return members.where(F.col("status") == CONFIRMED).select("ticker").distinct()


def companies_asof(members: DataFrame, catalog: DataFrame, days: DataFrame, day: str = "day") -> DataFrame:
    """Catalog rows of the effective universe with the weight effective then, plus a rank by weight."""
    rows = members_asof(members, days, day).join(catalog, "ticker")
    order = Window.partitionBy(day).orderBy(F.desc("weight"), "ticker")
    return rows.withColumn("position", F.row_number().over(order))


def history(members: DataFrame) -> DataFrame:
    """One row per version with its members, ordered by effective_from."""
    return (
        members.groupBy(*_VERSION).agg(F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("_o"), "ticker", "weight"))).alias("m"))
        .select(*_VERSION, F.transform("m", lambda x: F.struct(x["ticker"].alias("ticker"), x["weight"].alias("weight"))).alias("members"))
        .orderBy("effective_from", "version")
    )


def seed_versions(stored: DataFrame, new: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows of versions not stored yet (stored versions never change). Unknown tickers fail the job."""
    fresh = new.join(stored.select("version").distinct(), "version", "left_anti")
    known = catalog.select("ticker", F.lit(True).alias("_known"))
    checked = fresh.join(known, "ticker", "left")
    guard = F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("ticker not in the catalog: "), F.col("ticker"))))
    return checked.withColumn("ticker", F.coalesce(guard.cast("string"), F.col("ticker"))).select(*new.columns)


def confirm(members: DataFrame, confirmations: DataFrame) -> DataFrame:
    """Apply an append-only (version, confirmed_at) log: a confirmed version stays confirmed."""
    first = confirmations.groupBy("version").agg(F.min("confirmed_at").alias("_at"))
    return members.join(first, "version", "left").withColumn(
        "status", F.when(F.col("_at").isNotNull(), CONFIRMED).otherwise(F.col("status"))).withColumnRenamed("_at", "confirmed_at")


def mirror_weights(catalog: DataFrame, members: DataFrame, day: DataFrame) -> DataFrame:
    """Catalog with the weight, its version and where that came from, effective on the (single) given day; others keep null."""
    current = members_asof(members, day).select("ticker", F.col("weight").alias("index_weight"), F.col("version").alias("weight_version"))
    columns = [F.col(c).alias(f"weight_{c}") for c in ("source", "source_date") if c in members.columns]
    if columns:
        origin = members.select("ticker", F.col("version").alias("weight_version"), *columns)
        current = current.join(origin, ["ticker", "weight_version"])
    return catalog.join(current, "ticker", "left")


def upsert_catalog(catalog: DataFrame, changes: DataFrame) -> DataFrame:
    """Non-null fields of a change overwrite; a new ticker must bring name, sector and weight."""
    fields = [c for c in catalog.columns if c != "ticker"]
    c, n = catalog.alias("c"), changes.alias("n")
    merged = c.join(n, "ticker", "full_outer")
    incomplete = F.lit(False)
    for f in fields:
        incomplete = incomplete | F.col(f"n.{f}").isNull()
    is_new = F.lit(True)
    for f in fields:
        is_new = is_new & F.col(f"c.{f}").isNull()
    return merged.select("ticker", *[F.coalesce(F.col(f"n.{f}"), F.col(f"c.{f}")).alias(f) for f in fields],
                         (is_new & incomplete).alias("rejected"))
