"""Sinks: partitioned, resumable and cached tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridstats.functions.columns import quoted
from gridstats.sources.readers import read_table


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_partitions(df: DataFrame, path: str, by: Sequence[str] = ("year", "month")) -> None:
    """One directory per partition value; only partitions present in ``df`` are replaced.

    Rebalancing brings the rows of a partition together, so that small ones end up in one file,
    and lets adaptive execution split a partition that holds far more rows than the others.
    """
    balanced = df.hint("rebalance", *quoted(by))
    balanced.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option(
        "compression", "snappy").partitionBy(*by).parquet(path)


def folder(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def hidden(name: str) -> bool:
    """Staging folders and markers, which readers leave out."""
    return name.startswith(("_", "."))


def present(spark: SparkSession, path: str) -> bool:
    """Is there a table at ``path``: the marker of a finished write, or any file or folder that a reader would see?

    An unreadable table is present; what a crashed write leaves behind (``_temporary`` and the like) is not.
    """
    where, files = folder(spark, path)
    if not files.exists(where):
        return False
    names = [s.getPath().getName() for s in files.listStatus(where)]
    return "_SUCCESS" in names or not all(map(hidden, names))


def publish(df: DataFrame, path: str) -> None:
    """Write beside ``path`` and rename when the write is finished, so that ``path`` never holds half a table."""
    spark = df.sparkSession
    where, files = folder(spark, path)
    staging = where.suffix(f".{uuid.uuid4().hex}._building")
    try:
        write_csv(df, staging.toString()) if path.lower().endswith(".csv") else df.write.parquet(staging.toString())
        files.mkdirs(where.getParent())
        if files.exists(where):
            files.delete(where, True)  # only what a crashed write left: the caller has looked
        if not files.rename(staging, where):
            raise OSError(f"cannot rename to {path}")
    finally:
        if files.exists(staging):
            files.delete(staging, True)


def written_partitions(spark: SparkSession, path: str, by: Sequence[str] = ("year", "month")) -> DataFrame | None:
    """Partition values already present, as text, or None when nothing was written.

    They come from the names of directories: no file is opened. A partition is moved into place when its
    write is finished, so a directory stands for a whole partition.
    """
    where, files = folder(spark, path)
    found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(where, "/".join(f"{c}=*" for c in by))) if files.exists(where) else []
    depth = len(list(by))
    values = []
    for status in found:
        parts, at = [], status.getPath()
        for _ in range(depth):
            value = unquote(at.getName().split("=", 1)[1])
            parts.append(None if value == "__HIVE_DEFAULT_PARTITION__" else value)
            at = at.getParent()
        values.append(tuple(reversed(parts)))
    return spark.createDataFrame(values, ", ".join(f"`{c}` string" for c in by)) if values else None


def remaining(df: DataFrame, path: str, by: Sequence[str] = ("year", "month")) -> DataFrame:
    """Rows of partitions not written yet."""
    done = written_partitions(df.sparkSession, path, by)
    if done is None:
        return df
    done = done.select(*[F.col(f"`{c}`").cast(df.schema[c].dataType).alias(f"__{c}") for c in by])
    same = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"`__{c}`")) for c in by])
    return df.join(done, same, "left_anti")


def resume_partitions(df: DataFrame, path: str, by: Sequence[str] = ("year", "month")) -> None:
    write_partitions(remaining(df, path, by), path, by)


def cached_table(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read the table at ``path``, building and publishing it first when absent."""
    if not present(spark, path):
        publish(build(), path)
    return read_table(spark, path)


def write_cube(df: DataFrame, path: str, attributes: Mapping[str, Mapping[str, str]],
               by: Sequence[str] = ("year",)) -> None:
    """Long cube whose variables carry units and long names in the column metadata."""
    for name, meta in attributes.items():
        if name in df.columns:
            df = df.withMetadata(name, dict(meta))
    write_partitions(df, path, by)


def write_per_region(df: DataFrame, path: str, region: str) -> None:
    write_partitions(df, path, [region])


def save_fitted(model, frames: Mapping[str, DataFrame], path: str) -> None:
    """A fitted model and its parameter tables side by side."""
    model.write().overwrite().save(f"{path}/model")
    for name, frame in frames.items():
        frame.write.mode("overwrite").parquet(f"{path}/{name}")


def load_fitted(spark: SparkSession, loader, names: Sequence[str], path: str):
    return loader.load(f"{path}/model"), {n: spark.read.parquet(f"{path}/{n}") for n in names}
