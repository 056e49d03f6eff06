"""Session defaults and checkpoint handling."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed side even when that costs one more shuffle downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Checkpoints go with the frames that read them.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "gridstats", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the library defaults; cluster sizing stays with the submitter."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster; a scratch folder only in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="gridstats-ckpt-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the checkpoint folder so that later branches agree."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_and_count(df: DataFrame) -> tuple[DataFrame, int]:
    """``cut_lineage`` and the number of rows, counted as they are written."""
    rows = Observation()
    held = cut_lineage(df.observe(rows, F.count(F.lit(1)).alias("rows")))
    return held, rows.get["rows"]


def stored(df: DataFrame, rows_per_file: int | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: cut from its lineage, of a size that the planner knows, and read by columns."""
    path = f"{checkpoint_dir(df.sparkSession)}/gridstats-{uuid.uuid4().hex}"
    df.write.options(**({"maxRecordsPerFile": rows_per_file} if rows_per_file else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def file_by_file(spark: SparkSession) -> Iterator[None]:
    """Tasks of scans that are planned meanwhile read one file each, or a part of one."""
    name = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(name)
    # What opening a file counts for is a whole partition: no second file fits.
    spark.conf.set(name, spark.conf.get("spark.sql.files.maxPartitionBytes"))
    try:
        yield
    finally:
        spark.conf.set(name, before)
