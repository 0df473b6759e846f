"""Daily bar ingest and partitioned storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import market
from tidemark.sources.commits import CommitLog

#: Columns of a stored bar that every reader knows.
STORED = "ticker string, date date, close double, fetched_at timestamp_ntz"


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Bars with an explicit schema (no inference pass)."""
    reader = spark.read.schema(schemas.BARS)
    return reader.option("header", "true").csv(path) if fmt == "csv" else reader.parquet(path)


def counted(bars: DataFrame, name: str = "bars") -> tuple[DataFrame, object]:
    """Validated bars plus an observation of how many arrived and how many were dropped."""
    from pyspark.sql import Observation

    seen = Observation(name)
    bad = F.col("close").isNull() | (F.col("close") <= 0)
    return market.validate_bars(bars.observe(seen, F.count("*").alias("bars"), F.count_if(bad).alias("dropped"))), seen


def _log(spark: SparkSession, path: str) -> CommitLog:
    return CommitLog(spark, path, by="year")


def stored_bars(spark: SparkSession, path: str, columns: str = STORED) -> DataFrame:
    """The bars of the store: of every year the files that wrote it last."""
    return _log(spark, path).read(f"{columns}, year int")


def store_bars(new: DataFrame, path: str, delivery: int | None = None) -> None:
    """Upsert by (ticker, date). Only the years present in ``new`` are read and written anew, beside the files they supersede.

    The new files count from their commit on, so a writer that dies leaves the store as it was. A numbered ``delivery`` that is in the store already changes nothing.
    """
    log = _log(new.sparkSession, path)
    entries = log.entries()
    if delivery is not None and any(e.owner == "bars" and e.batch == delivery for e in entries):
        return
    incoming = market.validate_bars(new).withColumn("year", F.year("date"))
    years = sorted(str(r["year"]) for r in incoming.select("year").distinct().collect())
    held = log.read(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in incoming.schema), entries).where(F.col("year").cast("string").isin(years))
    merged = market.upsert_bars(held, incoming)
    number = max((e.batch for e in entries), default=-1) + 1 if delivery is None else delivery
    log.write(merged.repartition("year").sortWithinPartitions("ticker", "date"), "bars", number, ("year",), tuple(years))
