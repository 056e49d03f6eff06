"""Best-fit packing of documents into token sequences.

Documents above one third of the capacity are matched greedily, two to a sequence at most: from the
longest down, each with the longest other that fits. Smaller ones, longest first, go where they
leave the least room; new sequences open when none has room. Documents longer than the capacity are
cut into full pieces, the last may be shorter.

The decisions depend on lengths alone, so they are made once for all pieces on the histogram of
lengths, which has as many entries as the capacity whatever the input holds. Bins that are filled
alike are kept as runs. Every piece then finds its place from its rank among pieces of its length;
ranks are counted per partition, so a length that very many pieces share is not gathered.

Free style: tokens need the tokenizer in Python tasks. Null text counts as empty: the end id alone.
Repeated rows are packed each, and so are rows without an id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from gridstats.llm.common import table
from gridstats.llm.tokens import Encoder
from gridstats.session import cut_lineage

CAPACITY = 4096


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """``key``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked for, ``ids`` (32-bit little-endian)."""

    def encode(batches):
        encoder = Encoder(tokenizer)
        for batch in batches:
            rows, out = [], []
            for row, t in enumerate(batch.column("text").to_pylist()):
                ids = encoder(t or "")
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    rows.append(row)
                    out.append((n, at // 4, len(part) // 4, zlib.crc32(part), *([part] if keep_ids else [])))
            # Keys stay in Arrow: pandas would round large ones next to a null.
            columns = [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * len(kinds), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(rows, pa.int64())), *columns], names=names)

    names = ["key", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * keep_ids
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(encode, schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Places by length: rows (length, first rank, sequence, offset, copies in a sequence)."""
    left = {n: c for n, c in histogram.items() if c > 0}
    used = dict.fromkeys(left, 0)
    places, bins = [], 0
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> runs (first sequence, sequences)
    gaps: list[int] = []  # keys of room, sorted

    def put(length: int, first: int, count: int, offset: int, copies: int = 1) -> None:
        places.append((length, used[length], first, offset, copies))
        used[length] += count * copies

    def add(gap: int, first: int, count: int) -> None:
        if gap not in room:
            room[gap] = []
            insort(gaps, gap)
        room[gap].append((first, count))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large.pop()
        count = left.pop(n)
        while count:
            at = bisect_left(large, capacity - n + 1) - 1
            if 2 * n <= capacity and count > 1:
                pairs, mate = count // 2, n
                put(n, bins, pairs, 0, 1)
                put(n, bins, pairs, n, 1)
                count -= 2 * pairs
            elif at >= 0:
                mate = large[at]
                pairs = min(count, left[mate])
                put(n, bins, pairs, 0)
                put(mate, bins, pairs, n)
                count -= pairs
                left[mate] -= pairs
                if not left[mate]:
                    large.pop(at)
                    del left[mate]
            else:
                pairs, mate, whole = count, 0, count
                put(n, bins, whole, 0)
                count = 0
            add(capacity - n - mate, bins, pairs)
            bins += pairs
    for n in sorted(left, reverse=True):
        count = left[n]
        while count:
            at = bisect_left(gaps, n)
            if at == len(gaps):
                # As many sequences as these pieces alone need; the loop below fills them.
                fresh = -(-count // (capacity // n))
                add(capacity, bins, fresh)
                bins += fresh
                continue
            gap = gaps[at]
            first, runs = room[gap].pop()
            each = gap // n
            full = min(runs, count // each)
            if full:
                put(n, first, full, capacity - gap, each)
                add(gap - each * n, first, full)
                count -= full * each
            elif count:
                full = 1
                put(n, first, 1, capacity - gap, count)
                add(gap - count * n, first, 1)
                count = 0
            if runs > full:
                room[gap].append((first + full, runs - full))
            if not room.get(gap):
                room.pop(gap, None)
                del gaps[bisect_left(gaps, gap)]
    return np.array(sorted(places), dtype=np.int64).reshape(-1, 5)


def ranked(items: DataFrame) -> DataFrame:
    """``rank`` of each piece among those of its length, from counts per partition."""
    here = W.partitionBy("length", "part").orderBy("key", "piece", "ids_crc32")
    counts = items.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = counts.select("length", "part", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    return items.withColumn("here", F.row_number().over(here) - 1).join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("here"))


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (from ``pieces``) with ``sequence_id`` and ``offset``."""
    names = cut.columns
    items = cut_lineage(cut.withColumn("part", F.spark_partition_id()))
    lengths = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}  # one per length
    places = plan(lengths, capacity)
    starts = places[:, 0] * (1 << 48) + places[:, 1]

    def place(batches):
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(starts, batch.column("length").to_numpy() * (1 << 48) + rank, side="right") - 1
            length, first, sequence, offset, copies = places[at].T
            found = [pa.array(sequence + (rank - first) // copies), pa.array(offset + (rank - first) % copies * length)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *found], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return ranked(items).select(*names, "rank").mapInArrow(place, f"{schema}, sequence_id long, `offset` long")


def sequences(packed: DataFrame) -> DataFrame:
    """Ids of whole sequences, from ``pack`` over pieces that keep their ids."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return parts.select("sequence_id", joined.alias("ids"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def packed_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    return pack(pieces(docs, tokenizer or default_tokenizer())).withColumnRenamed("key", "doc_id")


def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``."""
    return packed_documents(table(spark, sf_dir, "documents"))
