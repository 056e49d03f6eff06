"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source is a stream of words: its documents in seeded order, end to end, cut into blocks of
``BLOCK_WORDS``. A source's quota is a whole number of blocks: full passes over the stream, then a
remainder from its start, which is a random set because the order is. The quotas of all sources are
split among the output shards by a binary tree: at each node the left half gets a draw without
replacement from the node's blocks, source by source (conditional hypergeometric draws), so quotas
stay exact. Shards then draw disjoint runs of the permuted blocks and shuffle locally.

DataFrame functions only. A source may hold any share of the rows: prefix sums run within hashed
sections of a source. All order comes from hashes of the row's content, so reruns agree. Identical
rows are numbered copies of one unit. Null or empty text has size 0 and takes nothing; a null source
is a source of its own, last in order; an empty table gives no rows. The number of sources and
shards is a setting of the mix: their quotas fit in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from gridstats.llm.common import let, table, whole
from gridstats.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, MOST_PASSES = (5, 2, 1), 3
BLOCK_WORDS, SHARDS, SEED = 64, 8, 7
#: Rows of a source that one prefix-sum window holds, on average.
SECTION_ROWS = 2_000


def words(text: str | Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def units(docs: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """Distinct rows by content with their number of copies, materialised."""
    light = docs.select(F.col(key).alias("_key"), F.col(source).alias("_source"), words(text).alias("_size"),
                        F.crc32(whole(text).cast("binary")).alias("_crc"))
    return cut_lineage(light.groupBy("_key", "_source", "_size", "_crc").agg(F.count("*").alias("_copies")))


def targets(parts: DataFrame, weights=WEIGHTS) -> DataFrame:
    """Per source: ``_of`` (size), ``_target``; targets stop at three times the size, the excess is
    shared again by weight. Filling sources in order of cap per weight gives that fixed point."""
    sizes = parts.groupBy("_source").agg(F.sum(F.col("_size") * F.col("_copies")).alias("_of"))
    everything = W.partitionBy()
    rank = F.row_number().over(everything.orderBy(F.col("_source").asc_nulls_last())) - 1
    ranked = sizes.withColumn("_rank", rank).withColumn("_weight", F.array(*[F.lit(float(w)) for w in weights])[F.col("_rank") % len(weights)])
    order = everything.orderBy(F.col("_of") / F.col("_weight"), "_rank")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    cap = F.col("_of") * float(MOST_PASSES)
    left = F.sum("_of").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    room = F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    level = ranked.withColumn("_level", left / room).withColumn("_open", cap / F.col("_weight") >= F.col("_level"))
    # The first source that its cap does not bind sets the level of all later ones.
    first = F.min(F.when(F.col("_open"), F.struct(F.col("_of") / F.col("_weight"), F.col("_rank"), F.col("_level").alias("level")))).over(everything)
    return level.select("_source", "_of", "_rank", F.least(cap, F.col("_weight") * F.coalesce(first["level"], F.lit(0.0))).alias("_target"))


def log_factorial(n: Column) -> Column:
    """ln n!: a table below 20, Stirling's series from there (error under 1e-12)."""
    x = n.cast("double")
    series = x * F.log(x) - x + F.log(x * 6.283185307179586) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n < 20, F.log(F.factorial(F.least(n, F.lit(19)).cast("int")).cast("double"))).otherwise(series)


def log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def hypergeometric(population: Column, marked: Column, draws: Column, uniform: Column) -> Column:
    """Marked items among ``draws`` without replacement, by inversion at ``uniform``.

    Probabilities are summed over the support within 12 standard deviations of the mean; what lies
    beyond is below the resolution of a double.
    """
    n, m, d = population.cast("double"), marked.cast("double"), draws.cast("double")
    mean = F.when(n > 0, d * m / n).otherwise(F.lit(0.0))
    spread = F.when(n > 0, F.sqrt(mean * (1 - m / n))).otherwise(F.lit(0.0)) * 12 + 12
    low = F.greatest(draws - (population - marked), F.lit(0), F.floor(mean - spread))
    high = F.least(draws, marked, F.ceil(mean + spread))

    def pick(logs: Column, start: Column) -> Column:
        return let(F.array_max(logs), lambda top: let(
            F.aggregate(logs, F.lit(0.0), lambda a, x: a + F.exp(x - top)), lambda total: F.aggregate(
                logs, F.struct(F.lit(0.0).alias("sum"), start.alias("at")),
                lambda a, x: F.struct((a["sum"] + F.exp(x - top)).alias("sum"),
                                      F.when(a["sum"] + F.exp(x - top) < uniform * total, a["at"] + 1).otherwise(a["at"]).alias("at")),
                lambda a: F.least(a["at"], high))))

    return let(low, lambda lo: pick(F.transform(F.sequence(lo, high), lambda k: log_choose(marked, k) + log_choose(population - marked, draws - k)), lo))


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """``shard``, ``_rank``, ``_blocks``: quotas (one row per source) split by the tree."""
    nodes = quotas.agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "_quota"))), lambda x: x["_quota"]).alias("counts"))
    nodes = nodes.select(F.lit(0).alias("first"), F.lit(shards).alias("leaves"), "counts")
    depth = max(1, (shards - 1).bit_length()) if shards > 1 else 0
    for level in range(depth):
        half = F.floor(F.col("leaves") / 2).cast("int")
        total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
        draws = F.floor(total * half / F.col("leaves"))

        salt = F.lit(seed * 64 + level)

        def draw(acc, x):
            uniform = (F.pmod(F.xxhash64(salt, "first", F.size(acc["out"])), F.lit(1 << 52)) + 0.5) / float(1 << 52)  # noqa: B023
            return let(hypergeometric(acc["rest"], x, acc["need"], uniform), lambda got: F.struct(
                (acc["rest"] - x).alias("rest"), (acc["need"] - got).alias("need"), F.array_append(acc["out"], got).alias("out")))

        start = F.struct(total.alias("rest"), draws.alias("need"), F.array().cast("array<bigint>").alias("out"))
        nodes = nodes.select("first", "leaves", "counts", half.alias("half"), F.aggregate("counts", start, draw, lambda a: a["out"]).alias("left"))
        right = F.zip_with("counts", "left", lambda c, x: c - x)
        children = F.array(F.struct(F.col("first"), F.col("half").alias("leaves"), F.col("left").alias("counts")),
                           F.struct((F.col("first") + F.col("half")).alias("first"), (F.col("leaves") - F.col("half")).alias("leaves"), right.alias("counts")))
        nodes = nodes.select(F.inline(F.filter(children, lambda c: c["leaves"] > 0)))
    return nodes.select(F.col("first").alias("shard"), F.posexplode("counts").alias("_at", "_blocks")).select("shard", (F.col("_at")).alias("_rank"), "_blocks")


def plan(parts: DataFrame, shards: int = SHARDS, block: int = BLOCK_WORDS, seed: int = SEED, weights=WEIGHTS) -> DataFrame:
    """Per source: size, target, blocks in a pass and the shards' disjoint runs of drawn blocks."""
    aims = targets(parts, weights).withColumn("_pass", F.ceil(F.col("_of") / block))
    full = F.when(F.col("_of") > 0, F.floor(F.col("_target") / F.col("_of"))).otherwise(F.lit(0))
    rest = F.round((F.col("_target") - full * F.col("_of")) / block).cast("long")
    aims = cut_lineage(aims.withColumn("_quota", full * F.col("_pass") + F.least(rest, F.col("_pass"))))
    leaves = split_quotas(aims.select("_rank", "_quota"), shards, seed)
    till = F.sum("_blocks").over(W.partitionBy("_rank").orderBy("shard"))
    runs = leaves.select("_rank", F.struct("shard", (till - F.col("_blocks")).alias("lo"), till.alias("hi")).alias("run"))
    runs = runs.groupBy("_rank").agg(F.array_sort(F.collect_list("run")).alias("_runs"))
    return aims.join(runs, "_rank").select("_source", "_of", "_target", "_pass", "_quota", "_runs")


def draws(docs: DataFrame, key: str, source: str, text: str, shards: int = SHARDS, block: int = BLOCK_WORDS, seed: int = SEED,
          weights=WEIGHTS) -> DataFrame:
    """Every row (copies too) with what the mix takes from it.

    ``_draws`` is an array of (round, shard, lo, hi): words [lo, hi) of the row, drawn in a pass over
    its source, for a shard.
    """
    parts = units(docs, key, source, text)
    count = parts.count()
    sections = max(1, -(-count // SECTION_ROWS))
    mixed = F.xxhash64(F.lit(seed), "_key", "_source", "_crc", "_size")
    placed = parts.withColumn("_order", mixed).withColumn("_section", F.pmod(F.xxhash64(F.col("_order")), F.lit(sections)))
    total = F.col("_size") * F.col("_copies")
    inner = F.sum(total).over(W.partitionBy("_source", "_section").orderBy("_order", "_key", "_crc", "_size")) - total
    starts = placed.groupBy("_source", "_section").agg(F.sum(total).alias("_sum"))
    starts = starts.select("_source", "_section", (F.sum("_sum").over(W.partitionBy("_source").orderBy("_section")) - F.col("_sum")).alias("_before"))
    placed = placed.withColumn("_inner", inner).join(
        starts.select(F.col("_source").alias("_s"), F.col("_section").alias("_t"), "_before"),
        F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_section") == F.col("_t")))
    streams = plan(parts, shards, block, seed, weights).withColumnRenamed("_source", "_s2")
    joined = placed.join(streams, F.col("_source").eqNullSafe(F.col("_s2")))
    copies = joined.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)).alias("_copy"))
    at = F.col("_before") + F.col("_inner") + F.col("_copy") * F.col("_size")
    copies = copies.withColumn("_at", at)
    passes = F.when(F.col("_pass") > 0, F.ceil(F.col("_quota") / F.col("_pass"))).otherwise(F.lit(0))

    def taken(p: Column, run: Column) -> Column:
        base = p * F.col("_pass")
        lo = F.greatest((run["lo"] - base) * block, F.lit(0), F.col("_at"))
        hi = F.least((run["hi"] - base) * block, F.col("_of"), F.col("_at") + F.col("_size"))
        return F.struct(p.cast("int").alias("round"), run["shard"].alias("shard"), (lo - F.col("_at")).alias("lo"), (hi - F.col("_at")).alias("hi"))

    rounds = F.filter(F.sequence(F.lit(0).cast("long"), F.greatest(passes - 1, F.lit(0))), lambda p: p < passes)
    found = F.flatten(F.transform(rounds, lambda p: F.transform("_runs", lambda run: taken(p, run))))
    return copies.select("_key", "_source", "_size", "_crc", "_copy", F.col("_of").alias("_source_size"), "_target",
                         F.filter(found, lambda d: d["hi"] > d["lo"]).alias("_draws"))


def taken(found: Column | str) -> Column:
    return F.aggregate(found, F.lit(0).cast("long"), lambda a, d: a + d["hi"] - d["lo"])


def by_shard(found: Column | str, shards: int = SHARDS) -> Column:
    """Words that each shard takes, ``shard:words`` joined by commas in order of shards; those without any are left out."""
    words_of = lambda s: F.aggregate(F.filter(found, lambda d: d["shard"] == s), F.lit(0).cast("long"), lambda a, d: a + d["hi"] - d["lo"])
    pairs = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(s.alias("shard"), words_of(s).alias("n")))
    return F.array_join(F.transform(F.filter(pairs, lambda x: x["n"] > 0), lambda x: F.concat_ws(":", x["shard"].cast("string"), x["n"].cast("string"))), ",")


def local_shuffle(drawn: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per draw in its shard, in an order shuffled within the shard's partition."""
    rows = drawn.select("_key", "_source", "_crc", "_copy", F.inline("_draws"))
    order = F.xxhash64(F.lit(seed), "shard", "_key", "_crc", "_copy", "round", "lo")
    return rows.withColumn("_order", order).repartition("shard", F.pmod("_order", F.lit(64))).sortWithinPartitions("shard", "_order")


def cut_words(text: Column, lo: Column, hi: Column) -> Column:
    """Words [lo, hi) of a text with the white space between them."""
    pieces = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    return F.array_join(F.slice(pieces, (lo + 1).cast("int"), (hi - lo).cast("int")), "")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Rows of ``docs`` as often as the mix takes them; a row at the edge of a quota keeps the words
    drawn from it. Columns stay."""
    # Read twice below, so that draws are computed once.
    drawn = cut_lineage(draws(docs, key, source, text))
    per_round = F.transform(F.array_distinct(F.transform("_draws", lambda d: d["round"])), lambda r: F.struct(
        r.alias("_round"),
        F.array_min(F.transform(F.filter("_draws", lambda d: d["round"] == r), lambda d: d["lo"])).alias("_lo"),
        F.array_max(F.transform(F.filter("_draws", lambda d: d["round"] == r), lambda d: d["hi"])).alias("_hi")))
    # Identical rows agree in all but what is drawn from each copy, so one row of them carries all copies.
    rounds = (drawn.select(F.col("_key").alias("_k"), F.col("_source").alias("_s"), F.col("_size").alias("_z"), F.col("_crc").alias("_c"), per_round.alias("_r"))
              .where(F.size("_r") > 0).select("_k", "_s", "_z", "_c", F.inline("_r")))
    one = docs.withColumn("_z2", words(text)).withColumn("_c2", F.crc32(whole(text).cast("binary")))
    one = one.dropDuplicates([key, source, "_z2", "_c2"]) if drawn.where("_copy > 0").take(1) else one
    same = (F.col(key).eqNullSafe(F.col("_k")) & F.col(source).eqNullSafe(F.col("_s")) & (F.col("_z2") == F.col("_z")) & (F.col("_c2") == F.col("_c")))
    rows = one.join(rounds, same)
    part = F.when((F.col("_lo") == 0) & (F.col("_hi") == F.col("_z")), F.col(text)).otherwise(cut_words(whole(text), F.col("_lo"), F.col("_hi")))
    rows = rows.withColumn(text, part)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length(text).cast("long"))
    return rows.select(*docs.columns)


def mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``; ``shards`` says how many words each output shard of the tree takes from a row."""
    drawn = draws(table(spark, sf_dir, "documents"), "doc_id", "source", "text")
    return drawn.select(F.col("_key").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
                        F.col("_target").alias("target"), taken("_draws").alias("taken"), by_shard("_draws").alias("shards"))
