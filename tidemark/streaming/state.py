"""Keyed stream operators whose state is bounded.

They keep per key what later rows can still change and no more. The RocksDB state store that they need is turned on by ``with_state``.
"""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BASELINE = "entity string, day date, n long, mean double, std double, too_late long"


def with_state(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    return spark


class DailyBaseline(StatefulProcessor):
    """Daily sums of an entity and the trailing statistics that they give.

    A row counts if its day is not more than ``lateness`` days before the newest day of earlier batches. Days that no accepted row can reach
    any more are dropped, so an entity has at most ``days`` + ``lateness`` days before its newest one. Every batch returns the days whose baseline it
    changed, the last return counts; rows that came too late are counted in a row without a baseline.
    """

    def __init__(self, days: int, lateness: int):
        self.days, self.lateness = days, lateness

    def init(self, handle) -> None:
        self.sums = handle.getMapState("sums", "day date", "n long, s double, ss double")
        self.newest = handle.getValueState("newest", "day date")

    def handleInputRows(self, key, rows, timerValues):
        before = self.newest.get()[0] if self.newest.exists() else None
        floor = before - dt.timedelta(days=self.lateness) if before else None
        fresh: dict[dt.date, list] = {}
        late: dict[dt.date, int] = {}
        for r in rows:
            if floor and r["day"] < floor:
                late[r["day"]] = late.get(r["day"], 0) + r["n"]
            else:
                x = fresh.setdefault(r["day"], [0, 0.0, 0.0])
                x[0], x[1], x[2] = x[0] + r["n"], x[1] + r["s"], x[2] + r["ss"]
        known = {k[0]: list(v) for k, v in self.sums.iterator()}
        for day, (n, s, ss) in fresh.items():
            old = known.get(day, [0, 0.0, 0.0])
            known[day] = [old[0] + n, old[1] + s, old[2] + ss]
            self.sums.updateValue((day,), tuple(known[day]))
        for day in sorted(known):
            # a day's own first rows and those of the days before it change its baseline
            if any(dt.timedelta(0) <= day - d <= dt.timedelta(days=self.days) for d in fresh):
                base = [known[d] for k in range(1, self.days + 1) if (d := day - dt.timedelta(days=k)) in known]
                n, s, ss = (sum(b[i] for b in base) for i in range(3))
                if n:
                    mean = s / n
                    yield Row(entity=key[0], day=day, n=n, mean=mean, std=math.sqrt(max(0.0, (ss - s * mean) / (n - 1))) if n > 1 else None, too_late=None)
        if fresh:
            newest = max([*fresh, *([before] if before else [])])
            self.newest.update((newest,))
            for day in known:
                if day < newest - dt.timedelta(days=self.days + self.lateness):
                    self.sums.removeKey((day,))
        for day, n in sorted(late.items()):
            yield Row(entity=key[0], day=day, n=None, mean=None, std=None, too_late=n)


def running_baseline(daily: DataFrame, days: int, lateness: int) -> DataFrame:
    """Stream of ``BASELINE`` rows from a stream (entity, day, n, s, ss) of rows or partial sums."""
    with_state(daily.sparkSession)
    return daily.groupBy("entity").transformWithState(DailyBaseline(days, lateness), BASELINE, "Update", "None")
