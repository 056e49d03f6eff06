"""Two-pass external shuffle into shards.

Pass one scatters whole rows over buckets that fit in memory, by a seeded hash of a row number. Pass two
shuffles each bucket with Fisher-Yates (``shuffle`` with a seed) and writes it as a Parquet table of buckets. The
buckets in order are the global order; dealing it over the shards in turn gives counts that differ by one at
most (law ``rows``); the slot is the place within the shard. All results are read from the buckets written.

Native DataFrame functions only. The row number makes buckets even whatever the keys hold, repeated
keys and equal texts included. Files give their rows in the same partitions and order to every attempt of a task;
rows of any other origin are materialised first, so a lost executor cannot renumber them. Null text has
size 1 and checksum 0. An empty table gives no rows. Columns beside those named pass through; input columns
named ``shard`` or ``slot`` come back with ``_before`` added to their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from gridstats.llm.common import table, whole
from gridstats.session import checkpoint_dir, cut_lineage

#: Payload bytes that one bucket may hold; a bucket is one array in a task's memory.
BUCKET_BYTES = 16 << 20
#: Rows per bucket at most, for rows with little payload.
BUCKET_ROWS = 20_000
#: Buckets that one task shuffles.
TASK_BUCKETS = 2
#: Buckets whose offsets are summed together.
BUCKET_RUN = 1024


def write_buckets(rows: DataFrame, path: str, seed: int, weight, files: bool = False, bucket_bytes: int = BUCKET_BYTES,
                  bucket_rows: int = BUCKET_ROWS) -> None:
    """``_bucket``, ``_at`` (place in the bucket) and ``_row`` as Parquet; ``weight`` is the bytes a row takes.

    ``files`` says that ``rows`` are read from files as they stand.
    """
    held = rows if files else cut_lineage(rows)
    count, total = held.agg(F.count("*"), F.sum(weight)).first()
    buckets = max(1, -(-int(total or 0) // bucket_bytes), -(-count // bucket_rows))
    numbered = held.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"), F.monotonically_increasing_id().alias("_number"))
    scattered = numbered.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), "_number"), F.lit(buckets))).repartition(-(-buckets // TASK_BUCKETS), "_bucket")
    # Sorted by row number first: what arrives in another order after a retry is shuffled alike.
    shuffled = scattered.groupBy("_bucket").agg(F.array_sort(F.collect_list(F.struct("_number", "_row"))).alias("_rows"))
    placed = shuffled.select("_bucket", F.posexplode(F.shuffle("_rows", seed)).alias("_at", "_entry"))
    placed.select("_bucket", "_at", F.col("_entry._row").alias("_row")).write.parquet(path)


def read_shards(spark: SparkSession, path: str, shards: int) -> DataFrame:
    """The rows written, with ``shard`` and ``slot``."""
    written = spark.read.parquet(path)
    offsets = bucket_offsets(written.groupBy("_bucket").agg(F.count("*").alias("_n")))
    place = F.col("_offset") + F.col("_at")
    names = written.schema["_row"].dataType.names
    kept = [F.col("_row").getField(n).alias(n if n not in ("shard", "slot") else f"{n}_before") for n in names]
    return written.join(offsets, "_bucket").select(*kept, F.pmod(place, F.lit(shards)).cast("int").alias("shard"),
                                                   F.floor(place / shards).cast("long").alias("slot"))


def external_shuffle(rows: DataFrame, shards: int, seed: int, weight, path: str | None = None, **sizes) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``, through buckets written to ``path``."""
    path = path or f"{checkpoint_dir(rows.sparkSession)}/buckets-{uuid.uuid4().hex}"
    write_buckets(rows, path, seed, weight, **sizes)
    return read_shards(rows.sparkSession, path, shards)


def bucket_offsets(counts: DataFrame) -> DataFrame:
    """Rows before each bucket, summed in two levels so that no window holds all buckets."""
    runs = counts.withColumn("_run", F.floor(F.col("_bucket") / BUCKET_RUN))
    inner = F.sum("_n").over(W.partitionBy("_run").orderBy("_bucket")) - F.col("_n")
    totals = runs.groupBy("_run").agg(F.sum("_n").alias("_total"))
    before = totals.select("_run", (F.sum("_total").over(W.orderBy("_run")) - F.col("_total")).alias("_before"))
    return runs.withColumn("_inner", inner).join(before, "_run").select("_bucket", (F.col("_inner") + F.col("_before")).alias("_offset"))


def sharded(docs: DataFrame, shards: int = 8, seed: int = 20, **sizes) -> DataFrame:
    """Digest of the whole documents that were shuffled and written."""
    size = (F.octet_length(whole("text")) + 1).cast("long")
    out = external_shuffle(docs, shards, seed, size, **sizes)
    return out.select("doc_id", size.alias("size"), F.crc32(whole("text").cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
                      "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` into eight shards."""
    return sharded(table(spark, sf_dir, "documents"), files=True)
