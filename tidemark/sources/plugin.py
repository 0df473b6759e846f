"""Pluggable article sources through the Python Data Source API.

A provider implements ``partitions(options)`` (independent slices, e.g. one per query and window) and
``fetch(slice)`` yielding dicts of the raw-article schema; Spark schedules one task per slice.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark import schemas

_FIELDS = [f.strip().split(" ")[0] for f in schemas.RAW_ARTICLE.split(",")]


class Slice(InputPartition):
    def __init__(self, value):
        self.value = value


def article_source(name: str, partitions, fetch) -> type[DataSource]:
    """Build a data source class named ``name`` from two plain functions."""

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.options = dict(options)

        def partitions(self):
            return [Slice(p) for p in partitions(self.options)]

        def read(self, partition):
            for record in fetch(partition.value):
                yield tuple(record.get(f) for f in _FIELDS)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schemas.RAW_ARTICLE

        def reader(self, schema):
            return Reader(self.options)

    return Source


def register(spark: SparkSession, source: type[DataSource]) -> None:
    spark.dataSource.register(source)


def enabled(configured: list[str], available: dict[str, type[DataSource]]) -> tuple[list[type[DataSource]], list[str]]:
    """(sources to use, names that are not available)."""
    return [available[n] for n in configured if n in available], [n for n in configured if n not in available]
