"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridstats.session import cut_lineage

SPAN = "struct<s:int,e:int,m:string>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str | Column) -> Column:
    """Text with null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def let(value: Column, use) -> Column:
    """Bind a column once inside an expression: ``use`` gets it as a lambda variable."""
    return F.transform(F.array(value), use)[0]


def empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (start, end, text); code points, end exclusive.

    The text between matches gives the positions, so both calls must see the same pattern. The
    guard keeps texts without a match to one pass.
    """
    zipped = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                        lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m")))

    def step(acc, x):
        start = acc["pos"] + x["gap"]
        end = start + F.length(x["m"])
        row = F.struct(start.alias("s"), end.alias("e"), x["m"].alias("m"))
        return F.when(x["m"].isNull(), acc).otherwise(
            F.struct(end.alias("pos"), F.array_append(acc["out"], row).alias("out")))

    start = F.struct(F.lit(0).alias("pos"), empty(SPAN).alias("out"))
    found = F.aggregate(zipped, start, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(empty(SPAN))


def joined_spans(spans: Column, kinds: Column) -> Column:
    """``kind:start:end`` joined by commas; ``spans`` are sorted (start, kind number, end) structs."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kinds[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def count_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["k"] == kind)).cast("long")


def small_side(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A materialised table of narrow rows, to be broadcast if it was counted to be short enough."""
    df = cut_lineage(df)
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bounded_sample(df: DataFrame, order: Column, rows: int) -> DataFrame:
    """About ``rows`` rows, those with the least hash values; all rows of a smaller table.

    Rows are picked where they lie, by a threshold, so no task gathers candidates. Rows of equal hash
    count once: ``order`` hashes all that tells rows apart, so copies neither crowd others out nor make the
    sample depend on the run.
    """
    count = df.count()
    share = min(1.0, rows / max(1, count))
    most = int(-(1 << 63) + share * (1 << 64)) - 1
    return df.withColumn("_order", order).where(F.col("_order") <= F.lit(min(most, (1 << 63) - 1))).dropDuplicates(["_order"]).drop("_order").limit(2 * rows)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Root (smallest id reachable) of every node with an edge: columns ``node``, ``root``.

    Alternates large-star and small-star contraction until the edge set stays the same. Only a
    count and a checksum of the edges come to the driver. Neighbourhoods are reduced to their
    minimum with partial aggregation, never gathered; a hub's rows are left to the skew join.
    """

    def minimum(df: DataFrame) -> DataFrame:
        return df.groupBy("u").agg(F.min("v").alias("m"))

    def large_star(e: DataFrame) -> DataFrame:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = minimum(both).withColumn("m", F.least("u", "m"))
        return (both.where("v > u").join(low, "u").where("v != m")
                .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())

    def small_star(e: DataFrame) -> DataFrame:
        low = minimum(e)
        moved = e.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    pairs, before = cut_lineage(pairs), None
    while True:
        # small-star wants each edge to point from the larger to the smaller id
        pairs = cut_lineage(small_star(large_star(pairs).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()))
        now = state(pairs)
        if now == before:
            break
        before = now
    leaves = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(leaves.select("root").distinct().select(F.col("root").alias("node"), "root"))
