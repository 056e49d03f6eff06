"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

Rotations of the principal axes are learned on a bounded sample so that signs make balanced binary codes of
``BITS`` bits (iterative quantisation). The first ``TABLE_BITS`` bits are cut into substrings, one table each. A
code is put under its own substring and, at radius 1, under all substrings one bit off, so codes meet
whose substrings differ in two bits at most. Where they meet, codes within ``reach`` differing bits in all are
candidates, and the cosines of the original vectors, in double precision, decide. A pair counts in the first table and
at one value where it meets, so no pair is listed and none counts twice.

Width, radius and reach are set from pairs of the sample at the least cosine and above: of all that find
``RECALL`` of them, the cheapest at the number of vectors. Wider substrings become cheapest as the input grows. Pairs
whose codes meet nowhere are not found: ``near_duplicates_by_tables`` is approximate, its recall is measured in
the tests. Where codes cannot tell links from other pairs (vectors that share nearly all of their direction), the exact
search answers.

``near_duplicates`` is the exact search: vectors sorted by code into blocks of bounded size, blocks whose ranges on
the rotated axes lie farther apart than two linked vectors can ruled out, all others multiplied tile by
tile. Its work is quadratic in blocks where ranges rule little out, as in high dimensions.

Equal vectors collapse to one with a count, equal codes to one entry. Cells of any size are searched slice against
slice. Cells return a link count and one edge per vector, not pairs; components follow by star contraction.

Null, zero and non-finite vectors, and lengths other than the commonest, link with nothing.
Parts of any finite size are allowed. Repeated rows, and rows that share an id, count as other vectors; an id's rows get
the counts of their own vectors. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridstats.llm.common import bounded_sample, connected_components, table
from gridstats.llm.vectors import comparable, matrix
from gridstats.session import cut_lineage

SAMPLE, ROUNDS, AXES, LEAST = 20_000, 50, 64, 0.9
#: Bits of a code, and those of them that the tables are cut from.
BITS, TABLE_BITS = 96, 64
#: Share of the sample's pairs that the tables, and of those that the reach, must find.
RECALL, WITHIN = 0.99, 0.998
#: Share of pairs below the least cosine within reach above which the exact search answers.
BLURRED = 0.005
#: Entries of a table that are searched together, and vectors of a cell that are reranked together.
SLICE, PART = 50_000, 1024
#: A block holds a sixth of the vectors, within these bounds, and a tile of a product so many rows.
BLOCK_ROWS, BLOCK_BYTES, TILE = 1024, 8 << 20, 256


def learn(sample: np.ndarray, bits: int = AXES, rounds: int = ROUNDS, seed: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dimensions x bits) whose signs are the code: principal axes, rotated until
    the codes lie closest to the projected vectors."""
    bits = min(bits, sample.shape[1])
    mean = sample.mean(axis=0)
    _, _, axes = np.linalg.svd(np.cov(sample - mean, rowvar=False).reshape(sample.shape[1], -1))
    flat = (sample - mean) @ axes[:bits].T
    rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))[0]
    for _ in range(rounds):
        left, _, right = np.linalg.svd(np.where(flat @ rotation >= 0, 1.0, -1.0).T @ flat)
        rotation = (left @ right).T
    return mean, axes[:bits].T @ rotation


def codes(units: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    bits = np.zeros((len(units), 64), dtype=bool)
    bits[:, :projection.shape[1]] = (units - mean) @ projection >= 0
    return np.packbits(bits, axis=1, bitorder="little").view("<i8").reshape(-1)


def blocks(coded: DataFrame, axes: np.ndarray, per: int, parts: int) -> DataFrame:
    """``block``, its range on every axis (``low``, ``high``) and its vectors packed: ``keys``, ``ns``, ``vs``."""

    def packed(block, frames):
        rows = pd.concat(frames)
        units = matrix(rows["v"])
        along = units @ axes
        return pd.DataFrame({"block": [block], "low": [along.min(axis=0)], "high": [along.max(axis=0)], "keys": [rows["key"].to_numpy(np.int64).tobytes()],
                             "ns": [rows["n"].to_numpy(np.int64).tobytes()], "vs": [units.tobytes()]})

    def run(batches):
        frames, held, block = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo in range(0, len(batch), per):
                part = batch.iloc[lo:lo + per]
                if held + len(part) > 1.25 * per:
                    yield packed(block, frames)
                    frames, held, block = [], 0, block + 1
                frames.append(part)
                held += len(part)
        if frames:
            yield packed(block, frames)

    dealt = coded.repartitionByRange(parts, "code", "key").sortWithinPartitions("code", "key")
    return dealt.mapInPandas(run, "block long, low array<double>, high array<double>, keys binary, ns binary, vs binary")


def distance(low: Column, high: Column, low2: Column, high2: Column) -> Column:
    """Square of the least distance between two boxes."""
    gaps = F.zip_with(F.zip_with(low, high2, lambda a, b: a - b), F.zip_with(low2, high, lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    return F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + g * g)


def joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the least place of its cluster) after the pairs (a, b) are joined."""
    while len(a):
        x, y = labels[a], labels[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (above := labels[labels] != labels).any():
            labels[above] = labels[labels[above]]
    return labels


def cell_links(own: bool, keys, ns, vs, keys2, ns2, vs2, least: float, counted=None) -> pd.DataFrame:
    """``key``, ``links`` and ``root`` (least key of its cluster in the cell) of vectors with a link;
    ``counted(a, b)`` says which pairs of places count."""
    every = keys if own else np.concatenate([keys, keys2])
    order = np.argsort(every, kind="stable")
    place = np.empty(len(every), dtype=np.int64)
    place[order] = np.arange(len(every))
    links, labels, shift = np.zeros(len(every), dtype=np.int64), np.arange(len(every)), 0 if own else len(keys)
    for lo in range(0, len(keys), TILE):
        good = vs[lo:lo + TILE] @ vs2.T >= least
        if own:
            good[np.arange(len(good)), lo + np.arange(len(good))] = False
        a, b = np.nonzero(good)
        a += lo
        if counted is not None:
            here = counted(a, b)
            a, b = a[here], b[here]
        np.add.at(links, a, ns2[b])
        if not own:
            np.add.at(links, b + shift, ns[a])
        labels = joined(labels, place[a], place[b + shift])
    used = np.flatnonzero(links)
    return pd.DataFrame({"key": every[used], "links": links[used], "root": every[order[labels[place[used]]]]})


def linked(packed: DataFrame, dimensions: int, least: float) -> DataFrame:
    """``key``, ``links`` and ``root`` per vector and cell (pair of blocks)."""
    slim = packed.select("block", "low", "high")
    other = slim.select(F.col("block").alias("block2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    near = distance(F.col("low"), F.col("high"), F.col("low2"), F.col("high2")) <= 2 - 2 * least + 1e-9
    pairs = cut_lineage(slim.join(other, F.col("block") <= F.col("block2")).where(near).select("block", "block2"))
    second = packed.select(F.col("block").alias("block2"), *[F.col(c).alias(f"{c}2") for c in ("keys", "ns", "vs")])
    cells = pairs.join(packed.drop("low", "high"), "block").join(second, "block2")

    def run(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                ints = [np.frombuffer(x, dtype=np.int64) for x in (row.keys, row.ns, row.keys2, row.ns2)]
                units = [np.frombuffer(x, dtype=np.float64).reshape(-1, dimensions) for x in (row.vs, row.vs2)]
                yield cell_links(row.block == row.block2, ints[0], ints[1], units[0], ints[2], ints[3], units[1], least)

    # Cells are few and heavy: one to a task.
    dealt = cells.repartition(max(1, pairs.count()))
    return dealt.mapInPandas(run, "key long, links long, root long")


class Tables(NamedTuple):
    """Count and width of the substrings, radius of a table's entries, and differing bits of a candidate."""

    count: int
    width: int
    radius: int
    reach: int


def wide_codes(units: np.ndarray, mean: np.ndarray, projections: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First 64 bits and the rest, both as unsigned integers."""
    bits = np.zeros((len(units), 128), dtype=bool)
    if len(units):
        bits[:, :projections.shape[1]] = (units - mean) @ projections >= 0
    both = np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def rotations(sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and as many learned projections side by side as make ``BITS`` bits."""
    per = min(AXES, sample.shape[1])
    learned = [learn(sample, per, seed=4 + i) for i in range(-(-BITS // per))]
    return learned[0][0], np.concatenate([projection for _, projection in learned], axis=1)[:, :BITS]


def calibrate(sample: np.ndarray, mean: np.ndarray, projections: np.ndarray, n: int, least: float) -> tuple[Tables, float]:
    """Tables for ``n`` vectors and the share of pairs below the least cosine within their reach.

    Two kinds of pairs must be found: vectors of the sample with a partner at the least cosine exactly, in a random
    direction, which are the hardest links there are; and the sample's own pairs at that cosine or above.
    """
    rng = np.random.default_rng(5)
    some = sample[:4000]
    off = rng.standard_normal(some.shape)
    off -= (off * some).sum(axis=1, keepdims=True) * some
    off /= np.maximum(np.linalg.norm(off, axis=1, keepdims=True), 1e-300)
    planted = least * some + math.sqrt(1 - least * least) * off
    low, high = wide_codes(sample, mean, projections)
    plow, phigh = wide_codes(planted, mean, projections)
    differ, total = low[:4000] ^ plow, np.bitwise_count(low[:4000] ^ plow) + np.bitwise_count(high[:4000] ^ phigh)
    a, b = np.nonzero(np.triu(sample[:500] @ sample.T >= least, 1))
    kinds = [(differ, total)] + ([(low[a] ^ low[b], np.bitwise_count(low[a] ^ low[b]) + np.bitwise_count(high[a] ^ high[b]))] if len(a) >= 100 else [])
    reach = max(int(np.quantile(t, WITHIN, method="higher")) for _, t in kinds)
    x, y = rng.integers(0, len(sample), (2, 20_000))
    apart = (sample[x] * sample[y]).sum(axis=1) < least
    x, y = x[apart], y[apart]
    within = np.bitwise_count(low[x] ^ low[y]) + np.bitwise_count(high[x] ^ high[y]) <= reach
    blurred = float(within.mean()) if len(x) else 0.0
    best = None
    for width in range(2, 31):
        count = TABLE_BITS // width
        mask = np.uint64((1 << width) - 1)
        for radius in (0, 1):
            found = min(float((np.min([np.bitwise_count(d >> np.uint64(t * width) & mask) for t in range(count)], axis=0) <= 2 * radius).mean()) for d, _ in kinds)
            entries = 1 + radius * width
            # An entry costs some thirty times as much as a comparison of two.
            cost = count * entries * (30 + n * entries / 2 ** (width + 1))
            if found >= RECALL and (best is None or cost < best[0]):
                best = cost, Tables(count, width, radius, reach)
    return best[1], blurred


def substrings(low: np.ndarray, table: int, tables: Tables) -> np.ndarray:
    """Values under which codes are entered in a table, one row per flip."""
    own = low >> np.uint64(table * tables.width) & np.uint64((1 << tables.width) - 1)
    flips = [0] + [1 << b for b in range(tables.width)] * tables.radius
    return own[None, :] ^ np.array(flips, dtype=np.uint64)[:, None]


def meets(a: np.ndarray, b: np.ndarray, table: int, value: np.ndarray, tables: Tables) -> np.ndarray:
    """Which pairs of codes (first bits) count under this value of this table."""
    mask, most = np.uint64((1 << tables.width) - 1), 2 * tables.radius
    good = np.ones(len(a), dtype=bool)
    for earlier in range(table):
        good &= np.bitwise_count((a ^ b) >> np.uint64(tables.width * earlier) & mask) > most
    own, other = (c >> np.uint64(tables.width * table) & mask for c in (a, b))
    x = own ^ other
    lowest = x & (~x + np.uint64(1))
    bits = np.bitwise_count(x)
    # One differing bit: the lesser of both values; two: the lesser of the values in between.
    at = np.where(bits <= 1, np.minimum(own, other), np.minimum(own ^ lowest, other ^ lowest))
    return good & (bits <= most) & (at == value)


ENTRY = np.dtype([("value", "<u2"), ("low", "<u8"), ("high", "<u4")])


def slice_of(low: np.ndarray, slices: int) -> np.ndarray:
    return ((low * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(slices)


def entered(coded: DataFrame, tables: Tables, top: int, slices: dict[int, int] | None) -> DataFrame:
    """Entries of the codes packed by ``part`` (table and first ``top`` bits of the value) and pair of slices;
    without ``slices`` only counts."""
    rest = np.uint64(tables.width - top)

    def run(batches):
        for batch in batches:
            low, high = (batch[c].to_numpy(np.int64).view(np.uint64) for c in ("low", "high"))
            for t in range(tables.count):
                values = substrings(low, t, tables)
                part = ((values >> rest).astype(np.int64) + (t << top)).reshape(-1)
                if slices is None:
                    parts, counts = np.unique(part, return_counts=True)
                    yield pd.DataFrame({"part": parts, "entries": counts})
                    continue
                held = np.empty(values.shape, dtype=ENTRY)
                held["value"], held["low"], held["high"] = values & ((np.uint64(1) << rest) - np.uint64(1)), low, high
                order = np.argsort(part, kind="stable")
                part, held = part[order], held.reshape(-1)[order]
                rows, cuts = [], [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1), len(part)]
                for lo, hi in zip(cuts, cuts[1:]):
                    if lo == hi:
                        continue
                    p, mine = int(part[lo]), held[lo:hi]
                    many = slices.get(p, 1)
                    if many == 1:
                        rows.append((p, 0, 0, mine.tobytes()))
                        continue
                    place = slice_of(mine["low"], many)
                    for i in range(many):
                        packed = mine[place == i].tobytes()
                        rows += [(p, min(i, j), max(i, j), packed) for j in range(many) if packed]
                yield pd.DataFrame(rows, columns=["part", "i", "j", "packed"])

    kind = "part long, entries long" if slices is None else "part long, i int, j int, packed binary"
    return coded.select("low", "high").mapInPandas(run, kind)


def groups(batches, by: list[str]):
    """Groups of consecutive rows of sorted batches: (values of ``by``, frame)."""
    last, held = None, []
    for batch in batches:
        if not len(batch):
            continue
        keys = batch[by].to_numpy(np.int64)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(batch)]
        for lo, hi in zip(cuts, cuts[1:]):
            now = tuple(keys[lo].tolist())
            if now != last:
                if held:
                    yield last, pd.concat(held) if len(held) > 1 else held[0]
                last, held = now, []
            held.append(batch.iloc[lo:hi])
    if held:
        yield last, pd.concat(held) if len(held) > 1 else held[0]


def taking_part(entries: DataFrame, tables: Tables, top: int, slices: dict[int, int], tasks: int) -> DataFrame:
    """``cell`` (table and value) and code of the entries that are in a candidate pair there."""

    def run(batches):
        for (part, i, j), rows in groups(batches, ["part", "i", "j"]):
            held = np.frombuffer(b"".join(rows["packed"]), dtype=ENTRY)
            held = held[np.argsort(held["value"], kind="stable")]
            value, low, high = held["value"].copy(), held["low"].copy(), held["high"].copy()
            side = slice_of(low, slices.get(part, 1)) if i != j else None
            table = part >> top
            whole = (np.uint64(part & ((1 << top) - 1)) << np.uint64(tables.width - top)) + value.astype(np.uint64)
            used, at, step = np.zeros(len(held), dtype=bool), np.arange(len(held)), 0
            while len(at):
                step += 1
                at = at[at + step < len(held)]
                at = at[value[at] == value[at + step]]
                near = at[np.bitwise_count(low[at] ^ low[at + step]) + np.bitwise_count(high[at] ^ high[at + step]) <= tables.reach]
                if side is not None:
                    near = near[side[near] != side[near + step]]
                near = near[meets(low[near], low[near + step], table, whole[near], tables)]
                used[near] = used[near + step] = True
            if used.any():
                yield pd.DataFrame({"cell": (np.int64(table) << tables.width) + whole[used].astype(np.int64),
                                    "low": low[used].view(np.int64), "high": high[used].astype(np.int64)})

    dealt = entries.repartition(tasks, "part", "i", "j").sortWithinPartitions("part", "i", "j")
    return dealt.mapInPandas(run, "cell long, low long, high long")


def reranked(members: DataFrame, tables: Tables, least: float, part: int = PART) -> DataFrame:
    """``key``, ``links`` and ``root`` per vector and cell, from the vectors of the codes in a cell."""
    sizes = members.groupBy("cell").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    split = members.join(sizes, "cell").withColumn("mine", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    split = split.select("cell", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
                         (F.col("mine") > F.col("other")).alias("second"), "key", "n", "low", "high", "v")

    def run(batches):
        for (cell, i, j), rows in groups(batches, ["cell", "i", "j"]):
            keys, ns, units = rows["key"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), matrix(rows["v"])
            low, high = (rows[c].to_numpy(np.int64).view(np.uint64) for c in ("low", "high"))
            second = rows["second"].to_numpy(bool)
            one, two = (np.arange(len(keys)),) * 2 if i == j else (np.flatnonzero(~second), np.flatnonzero(second))
            if not len(one) or not len(two):
                continue
            table, value = cell >> tables.width, np.uint64(cell & ((1 << tables.width) - 1))

            def counted(a, b):
                x, y = one[a], two[b]
                near = np.bitwise_count(low[x] ^ low[y]) + np.bitwise_count(high[x] ^ high[y]) <= tables.reach
                return near & meets(low[x], low[y], table, value, tables)

            yield cell_links(i == j, keys[one], ns[one], units[one], keys[two], ns[two], units[two], least, counted)

    dealt = split.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    return dealt.mapInPandas(run, "key long, links long, root long")


def table_links(units: DataFrame, sample: np.ndarray, least: float) -> DataFrame | None:
    """``key``, ``links`` and ``root`` per vector and cell of the tables; None where codes tell too little."""
    mean, projections = rotations(sample)
    count = units.count()
    tables, blurred = calibrate(sample, mean, projections, count, least)
    if blurred > BLURRED:
        return None

    @F.pandas_udf("low long, high long")
    def encode(v: pd.Series) -> pd.DataFrame:
        low, high = wide_codes(matrix(v), mean, projections)
        return pd.DataFrame({"low": low.view(np.int64), "high": high.view(np.int64)})

    vectors = units.withColumn("code", encode("v")).select("key", "n", "v", "code.low", "code.high")
    per_task = 40 * SLICE // (tables.count * (1 + tables.radius * tables.width))
    coded = vectors.groupBy("low", "high").agg(F.count("*").alias("several"))
    coded = cut_lineage(coded.repartition(math.ceil(count / per_task), "low", "high"))
    entries = coded.count() * tables.count * (1 + tables.radius * tables.width)
    per_table = entries / tables.count
    top = min(tables.width, max(tables.width - 16, min(10, math.ceil(math.log2(max(1, per_table / SLICE))))))
    # At most tables x 2^top (or 2^14) counts come to the driver.
    counts = entered(coded, tables, top, None).groupBy("part").agg(F.sum("entries").alias("entries")).where(F.col("entries") > 2 * SLICE)
    slices = {r["part"]: math.ceil(r["entries"] / SLICE) for r in counts.toLocalIterator()}
    packed = entered(coded, tables, top, slices)
    found = taking_part(packed, tables, top, slices, max(8, math.ceil(entries / SLICE)))
    # Vectors of one code meet under its own substring of the first table.
    first = F.col("low").bitwiseAND(F.lit((1 << tables.width) - 1))
    members = cut_lineage(found.unionByName(coded.where("several > 1").select(first.alias("cell"), "low", "high")).distinct())
    return cut_lineage(reranked(members.join(vectors, ["low", "high"]), tables, least))


def block_links(units: DataFrame, sample: np.ndarray, least: float) -> DataFrame:
    """``key``, ``links`` and ``root`` per vector and pair of blocks, exact."""
    mean, projection = learn(sample)

    def encode(batches):
        for batch in batches:
            batch["code"] = codes(matrix(batch["v"]), mean, projection) if len(batch) else np.zeros(0, dtype=np.int64)
            yield batch[["key", "n", "v", "code"]]

    coded = units.mapInPandas(encode, "key long, n long, v array<double>, code long")
    count, dimensions = units.count(), sample.shape[1]
    per = max(1, min(BLOCK_BYTES // (8 * dimensions), max(BLOCK_ROWS, -(-count // 6))))
    return cut_lineage(linked(cut_lineage(blocks(coded, projection, per, math.ceil(count / per))), dimensions, least))


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = LEAST) -> DataFrame:
    """``key``, ``n_links``, ``component_id`` of every row; every link is found."""
    return classes(rows, key, vector, least, block_links)


def near_duplicates_by_tables(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = LEAST) -> DataFrame:
    """``key``, ``n_links``, ``component_id`` of every row by the links that the Hamming tables find."""

    def links(units, sample, least):
        found = table_links(units, sample, least)
        return block_links(units, sample, least) if found is None else found

    return classes(rows, key, vector, least, links)


def classes(rows: DataFrame, key: str, vector: str, least: float, search) -> DataFrame:
    """``key``, ``n_links``, ``component_id`` of every row from the links ``search`` finds between different unit vectors."""
    held = comparable(rows, key, vector)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    distinct = cut_lineage(held.groupBy("v").agg(F.min("key").alias("key"), F.count("*").alias("n")))
    # Scaled by the largest part first: the squares of very large or small parts leave the doubles.
    scaled = distinct.withColumn("top", F.array_max(F.transform("v", F.abs))).withColumn("v", F.transform("v", lambda x: x / F.col("top")))
    units = cut_lineage(scaled.withColumn("size", norm(F.col("v"))).select("key", "n", F.transform("v", lambda x: x / F.col("size")).alias("v")))
    sample = matrix(bounded_sample(units, F.xxhash64("key", "v"), SAMPLE).toPandas()["v"])
    if len(sample) < 2:
        found = distinct.select("v", "key", (F.col("n") - 1).alias("links"), F.col("key").alias("component"))
    else:
        ranked = search(units, sample, least)
        counts = ranked.groupBy("key").agg(F.sum("links").alias("links"))
        roots = connected_components(ranked.where("key != root").select(F.col("key").alias("a"), F.col("root").alias("b")))
        found = (distinct.join(counts, "key", "left").join(roots, F.col("key") == F.col("node"), "left")
                 .select("v", "key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("root", "key").alias("component")))
    found = cut_lineage(found.select(F.col("v").alias("same"), "links", "component"))
    every = rows.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    return every.join(found, F.col("v") == F.col("same"), "left").select(
        "key", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "key").alias("component_id"))


def embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``embeddings``."""
    found = near_duplicates_by_tables(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("key").alias("vec_id"), "n_links", "component_id", (F.col("key") == F.col("component_id")).alias("kept"))
