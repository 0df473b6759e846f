"""Session set-up, lineage cutting and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Largest dimension (rows) that is ever broadcast on request.
BROADCAST_ROWS = 200_000


def build_session(app: str = "tidemark", master: str | None = None, **conf) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        # a checkpoint's files go once nothing refers to it any more
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package from where the driver has it.

    On a cluster it is installed on the nodes or sent with ``--py-files``; the extra path then does no harm.
    """
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def use_utc(spark: SparkSession) -> SparkSession:
    """Every stored instant is naive UTC, so the session zone must not shift casts."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def local_frame(spark: SparkSession, rows, schema: str) -> DataFrame:
    """Small literal rows as a local relation: known size, so the optimizer broadcasts it on its own."""
    struct = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)
    columns = list(zip(*rows)) if rows else [[] for _ in struct]
    arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)]
    return spark.createDataFrame(pa.table(arrays, schema=arrow), struct)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for reliable checkpoints: the cluster's ``spark.checkpoint.dir`` when it is set.

    Only a local master (tests) may fall back to a temporary folder; a cluster must name a shared one,
    otherwise losing an executor would lose the checkpoint with it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        configured = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and keeps iterative plans short."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def dimension(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a dimension, given only after counting it (at most ``max_rows + 1`` rows are read).

    A larger dimension is returned without a hint and joins by shuffle.
    """
    small = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if small else df


def spread(df: DataFrame) -> DataFrame:
    """Use every core for CPU-heavy row work on inputs that arrive in fewer splits than the cluster has cores.

    Large inputs already have more splits than cores and are returned unchanged (no shuffle), as are streams and plans
    that contain an exchange (asking those for their partitions would run it).
    """
    if df.isStreaming or "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
