"""Incremental variants of two batch results, as file-source streams that stop when caught up."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from gridstats.operators.summaries import mean_from_parts
from gridstats.sources.writers import folder, publish


def landed_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def running_mean(stream: DataFrame, cell: Sequence[str], values: Sequence[str], out: str, checkpoint: str, *,
                 compact_every: int = 20) -> StreamingQuery:
    """All-time mean per cell, kept as sums and counts in state; each trigger writes the cells that it changed.

    A trigger's changes are a folder of their own under ``out/changes``, which counts once its write is finished;
    a trigger that is run again replaces its own. Every ``compact_every`` triggers the newest rows are published as
    one snapshot. Read the table with ``read_running``.
    """
    spark, means = stream.sparkSession, mean_from_parts(stream, cell, values)

    def changed(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/changes/{number:010d}")
        if (number + 1) % compact_every == 0:
            compact(spark, out, cell)

    return (means.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .foreachBatch(changed).trigger(availableNow=True).start())


def _numbered(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished folders at ``path``."""
    where, files = folder(spark, path)
    if not files.exists(where):
        return []
    found = [s.getPath() for s in files.listStatus(where) if s.getPath().getName().isdigit()]
    return sorted(int(p.getName()) for p in found if files.exists(p.suffix("/_SUCCESS")))


def read_running(spark: SparkSession, out: str, cell: Sequence[str]) -> DataFrame:
    """The newest row of every cell: the last snapshot and the changes since."""
    snapshots = _numbered(spark, f"{out}/snapshots")
    since = snapshots[-1] if snapshots else -1
    paths = [f"{out}/snapshots/{since:010d}"] * bool(snapshots) + [f"{out}/changes/{n:010d}" for n in _numbered(spark, f"{out}/changes") if n > since]
    if not paths:
        raise FileNotFoundError(f"no finished trigger at {out}")
    rows = spark.read.parquet(*paths)
    number = F.regexp_extract(F.col("_metadata.file_path"), r"/(\d{10})/[^/]*$", 1)
    others = [c for c in rows.columns if c not in cell]
    newest = rows.select("*", number.alias("__trigger")).groupBy(*cell).agg(F.max_by(F.struct(*others), "__trigger").alias("__row"))
    return newest.select(*cell, "__row.*")


def compact(spark: SparkSession, out: str, cell: Sequence[str]) -> None:
    """Publish the newest rows as a snapshot and drop what the snapshot before it had replaced already."""
    changes, snapshots = _numbered(spark, f"{out}/changes"), _numbered(spark, f"{out}/snapshots")
    if changes and (not snapshots or changes[-1] > snapshots[-1]):
        publish(read_running(spark, out, cell), f"{out}/snapshots/{changes[-1]:010d}")
    for n in [n for n in changes if snapshots and n <= snapshots[-1]]:
        where, files = folder(spark, f"{out}/changes/{n:010d}")
        files.delete(where, True)
    for n in snapshots[:-1]:
        where, files = folder(spark, f"{out}/snapshots/{n:010d}")
        files.delete(where, True)


def score_new(stream: DataFrame, prepare_and_score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str,
              by: Sequence[str] = ("year", "month")) -> StreamingQuery:
    """Score files as they land. The checkpoint remembers what is done, so a restart repeats nothing."""
    scored = prepare_and_score(stream)
    return (scored.writeStream.format("parquet").outputMode("append").partitionBy(*by)
            .option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start())


def finished(query: StreamingQuery) -> None:
    """Wait for the stream to catch up and raise its error, if any."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()

