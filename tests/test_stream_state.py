"""Keyed stream state: what it returns, what it forgets."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.sources.commits import CommitLog, exactly_once
from tidemark.streaming import jobs, state


def deliver(spark, tmp_path, batches, schema, build, writer):
    """Run one micro-batch per delivery; returns the state rows after each."""
    held = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/source")
        q = jobs.start(build(spark.readStream.schema(schema).parquet(f"{tmp_path}/source")), writer, f"{tmp_path}/offsets", "update")
        q.awaitTermination()
        held.append(sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"]))
    return held


def by_hand(batches, days, lateness):
    sums, newest, late = {}, {}, {}
    for rows in batches:
        before = dict(newest)
        for e, d, x in rows:
            if e in before and d < before[e] - dt.timedelta(days=lateness):
                late[e, d] = late.get((e, d), 0) + 1
                continue
            sums.setdefault((e, d), []).append(x)
            newest[e] = max(newest.get(e, d), d)
    out = {}
    for e, d in sums:
        base = [x for k in range(1, days + 1) for x in sums.get((e, d - dt.timedelta(days=k)), [])]
        if base:
            mean = sum(base) / len(base)
            out[e, d] = (len(base), mean, (sum((x - mean) ** 2 for x in base) / (len(base) - 1)) ** 0.5 if len(base) > 1 else None)
    return out, late


def test_baseline_state_expires_and_equals_all_accepted_rows(spark, tmp_path):
    rng = random.Random(4)
    start = dt.date(2026, 1, 1)
    batches = []
    for b in range(5):
        rows = [(rng.choice("AB"), start + dt.timedelta(days=12 * b + rng.randint(0, 11)), float(rng.randint(-9, 9))) for _ in range(60)]
        if b > 1:
            rows += [("A", start + dt.timedelta(days=12 * b - back), 5.0) for back in (4, 6, 13, 25)]
        batches.append(rows)
    schema = "entity string, day date, sentiment double"
    x = F.col("sentiment")
    build = lambda s: state.running_baseline(s.select("entity", "day", F.lit(1).cast("long").alias("n"), x.alias("s"), (x * x).alias("ss")), 7, 10)
    write = exactly_once(f"{tmp_path}/out")
    held = deliver(spark, tmp_path, batches, schema, build, lambda b, i: write(b.withColumn("batch", F.lit(i).cast("long")), i))
    rows = CommitLog(spark, f"{tmp_path}/out").read(state.BASELINE + ", batch long").collect()
    want, late = by_hand(batches, 7, 10)
    last = {}
    for r in sorted((r for r in rows if r.too_late is None), key=lambda r: r.batch):
        last[r.entity, r.day] = r
    assert last.keys() == want.keys()
    for k, (n, mean, std) in want.items():
        assert last[k].n == n and last[k].mean == pytest.approx(mean) and (last[k].std == pytest.approx(std) if std is not None else last[k].std is None)
    got_late = {}
    for r in rows:
        if r.too_late:
            got_late[r.entity, r.day] = got_late.get((r.entity, r.day), 0) + r.too_late
    assert got_late == late and sum(late.values()) > 2
    assert max(held) <= 2 * (7 + 10 + 12 + 1) and held[-1] <= 2 * (7 + 10 + 2)

