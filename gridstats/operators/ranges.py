"""Positions and running totals from one sort by ranges and the sums of whole ranges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridstats.session import cut_lineage

#: Rows of a range, where the number of rows is known.
RANGE_ROWS = 250_000
_ROW_BITS = 33  # of ``monotonically_increasing_id``: the rest is the partition


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "position", partitions: int | None = None) -> DataFrame:
    """``df`` with each row's 0-based place in ``order``.

    Rows are sorted by ranges in one shuffle; a place is the row's place in its range plus the rows
    of all ranges before. Only the row counts of the ranges meet in one task. Equal rows of ``order``
    stay in one range: add columns that tell them apart where they may be many.
    """
    dealt = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    placed = cut_lineage(dealt.sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part, row = F.shiftright("__at", _ROW_BITS), F.col("__at").bitwiseAND((1 << _ROW_BITS) - 1)
    before = totals_before(placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n")), "__part", {"__n": "__before"})
    return placed.join(before, part == F.col("__part")).withColumn(name, F.col("__before") + row).drop("__at", "__part", "__before")


def totals_before(sums: DataFrame, part: str, measures: Mapping[str, str]) -> DataFrame:
    """Per range, the sum of each measure over all ranges before it; one row per range goes in."""
    before = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    return F.broadcast(sums.select(part, *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(out) for m, out in measures.items()]))


def _changes(batch: pa.RecordBatch, keys: Sequence[str], last: Sequence) -> np.ndarray:
    """True where a row's group is not that of the row before; null is a group of its own."""
    out = np.zeros(batch.num_rows, dtype=bool)
    for k, before in zip(keys, last):
        column = batch.column(k)
        if pa.types.is_floating(column.type):
            column = column.cast(pa.string())
        known = np.asarray(column.is_null())
        differ = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).fill_null(False)
        out[1:] |= np.asarray(differ) | (known[1:] != known[:-1])
        out[0] |= before is None or column[0].as_py() != before[0]
    return out


def running_sums(df: DataFrame, keys: Sequence[str], order: str, measures: Sequence[str], rows: int | None = None) -> DataFrame:
    """``df`` with ``<m>_before``: the sum of each measure over the group's rows of smaller ``order``.

    ``df`` has one row per (keys, order), so copies are combined already. The rows move once, into ranges
    of (keys, order); sums run along each range, and what the first group of a range has in ranges before
    comes from the sums per (keys, range). ``rows``, if known, sets the number of ranges.
    """
    keys, names = list(keys), list(measures)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) if rows is None else max(1, -(-rows // RANGE_ROWS))
    placed = df.repartitionByRange(parts, *keys, order).sortWithinPartitions(*keys, order).withColumn("__part", F.spark_partition_id())
    if parts > 1:
        # Written once: rows and sums below must see the same ranges, which are cut by a sample.
        placed = cut_lineage(placed)
    fields = {f.name: f.dataType.simpleString() for f in placed.schema.fields}
    kinds = {m: np.float64 if fields[m] in ("double", "float") else np.int64 for m in names}

    def run(batches):
        last, carried, first = [None] * len(keys), dict.fromkeys(names, 0), True
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = _changes(batch, keys, last) if keys else np.zeros(batch.num_rows, dtype=bool)
            if first:
                fresh[0] = True
            group = np.cumsum(fresh) - 1
            opening = group < (1 if fresh[0] else 0) if first else np.full(batch.num_rows, False)
            if not first and in_opening:
                opening = group < 0
            start = np.flatnonzero(fresh)
            out = list(batch.columns)
            for m in names:
                values = batch.column(m).to_numpy(zero_copy_only=False).astype(kinds[m])
                upto = np.cumsum(values)
                before = upto - values
                base = np.append(before[start], 0)
                within = before - np.where(group >= 0, base[group], -carried[m])
                out.append(pa.array(within))
                carried[m] = within[-1] + values[-1]
            in_opening, first = bool(opening[-1]), False
            last = []
            for k in keys:
                column = batch.column(k)
                column = column.cast(pa.string()) if pa.types.is_floating(column.type) else column
                last.append((column[len(column) - 1].as_py(),))
            yield pa.RecordBatch.from_arrays([*out, pa.array(opening)], names=[*batch.schema.names, *[f"{m}_before" for m in names], "__opening"])

    schema = ", ".join(f"`{n}` {t}" for n, t in fields.items())
    added = ", ".join(f"`{m}_before` {'double' if kinds[m] is np.float64 else 'long'}" for m in names)
    found = placed.mapInArrow(run, f"{schema}, {added}, __opening boolean")
    if parts == 1:
        return found.select(*df.columns, *[f"{m}_before" for m in names])
    sums = placed.groupBy(*keys, "__part").agg(*[F.sum(m).alias(f"__{m}") for m in names])
    earlier = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    # Only the first group of a range can have rows in ranges before: one row per range at most.
    carry = sums.select("__part", *[F.sum(f"__{m}").over(earlier).alias(f"__{m}") for m in names]).where(F.col(f"__{names[0]}").isNotNull())
    carry = F.broadcast(carry.withColumnRenamed("__part", "__of"))
    joined = found.join(carry, (F.col("__part") == F.col("__of")) & F.col("__opening"), "left")
    return joined.select(*df.columns, *[(F.col(f"{m}_before") + F.coalesce(f"__{m}", F.lit(0))).alias(f"{m}_before") for m in names])
