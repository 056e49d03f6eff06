"""Exact order statistics for groups of any size.

The table is read twice. Groups no larger than a sketch are counted first and then collected whole, a few thousand
numbers at most. For larger ones and for whole columns, first a mergeable KLL sketch per group, of bounded size, brackets every wanted
rank: the value lies between two of the sketch's values, several times its error apart. Then rows between brackets only count, and rows inside of one count per value; both are combined before
they move, so what is shuffled is the share of rows in brackets (some thousandths per rank). Running
sums over the counts (``operators/ranges.py``) give the value at each rank, exactly. Brackets are written once,
so all tasks and re-runs see the same ones. NaN is null.

Whole columns are read side by side: a sketch of each in one aggregate, whose brackets come to the driver (a few
numbers per column) and enter the second read as literals.

A sketch errs by more than a bracket allows in one of 10^13 cases; the query then raises an error and gives
no wrong value.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridstats.functions.binning import order_code, part_code
from gridstats.functions.columns import col
from gridstats.operators.ranges import running_sums
from gridstats.session import cut_and_count

#: Size of the sketches, and the share of rows left on either side of a rank: three times the sketch's
#: error at 99 % confidence, which is 2.296 / k^0.9021.
SKETCH = 4096
SLACK = 3 * 2.296 / SKETCH**0.9021
#: Brackets end at this many equal steps of rank.
GRID = 128
#: Groups whose brackets (a few numbers each) travel to all tasks; beyond, they are joined by shuffle.
BROADCAST_GROUPS = 100_000
#: Order codes of 2^-20 of a magnitude are joined to bins of 2^-12 of it.
BIN_SHIFT = 8

RankOf = Callable[[Column], Column]


def present(value: str) -> Column:
    """Neither null nor NaN."""
    return col(value).isNotNull() & ~F.isnan(col(value).cast("double"))


def _running(keys: Sequence[str], order: str):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], exact: Sequence[str]) -> DataFrame:
    """Join on null-safe group keys plus non-null code columns."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in (*keys, *exact)})
    cond = [left[k].eqNullSafe(renamed[f"__{k}"]) for k in keys] + [left[e] == renamed[f"__{e}"] for e in exact]
    return left.join(renamed, cond, "inner").drop(*[f"__{k}" for k in (*keys, *exact)])


def _brackets(base: DataFrame, keys: list[str], named: Mapping[str, RankOf]) -> DataFrame:
    """One row per group, materialised: ``total``, the wanted ranks and the bracket ``lo_i``..``hi_i`` of each."""
    sketch = base.groupBy(*keys).agg(F.kll_sketch_agg_double("__x", F.lit(SKETCH)).alias("sketch"), F.count(F.lit(1)).alias("total"))
    grid = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])).alias("grid")
    ranks = sketch.select(*keys, "total", grid, *[rank(F.col("total")).cast("bigint").alias(f"r_{i}") for i, rank in enumerate(named.values())])

    def edge(i: int, side: int) -> Column:
        # A group that the sketch holds whole has no error, and one rank more on either side costs nothing.
        place = F.try_divide(F.col(f"r_{i}") + (side + 1) / 2 + side, F.col("total")) + side * SLACK
        step = F.greatest(F.least(place, F.lit(1.0)), F.lit(0.0)) * GRID
        return F.get("grid", (F.floor(step) if side < 0 else F.ceil(step)).cast("int"))

    edges = [c for i in range(len(named)) for c in (edge(i, -1).alias(f"lo_{i}"), edge(i, 1).alias(f"hi_{i}"))]
    found, groups = cut_and_count(ranks.select(*keys, "total", *[f"r_{i}" for i in range(len(named))], *edges))
    return F.broadcast(found) if groups <= BROADCAST_GROUPS else found


def _column_ranks(df: DataFrame, columns: Mapping[str, Column], ranks: Mapping[str, RankOf]) -> dict[str, tuple[int, list]]:
    """Per column: how many values it has, and the value at each rank (None outside of the column)."""
    names, slots = list(columns), range(len(ranks))
    base = df.select(*[F.when(present(c), c.cast("double")).alias(f"x_{i}") for i, c in enumerate(columns.values())])
    sketches = base.agg(*[F.kll_sketch_agg_double(f"x_{i}", F.lit(SKETCH)).alias(f"s_{i}") for i in range(len(names))],
                        *[F.count(f"x_{i}").alias(f"n_{i}") for i in range(len(names))])
    steps = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    grids = [F.when(F.col(f"n_{i}") > 0, F.kll_sketch_get_quantile_double(f"s_{i}", steps)).alias(f"g_{i}") for i in range(len(names))]
    wanted = [rank(F.when(F.col(f"n_{i}") > 0, F.col(f"n_{i}"))).cast("bigint").alias(f"r_{i}_{j}") for i in range(len(names)) for j, rank in enumerate(ranks.values())]
    row = sketches.select(*[f"n_{i}" for i in range(len(names))], *grids, *wanted).first()

    # Disjoint brackets of a column cut it into regions, numbered upwards; the odd ones are the brackets.
    regions, first, brackets = [], 0, {}
    for i in range(len(names)):
        n, grid, spans = row[f"n_{i}"], row[f"g_{i}"], []
        for r in (row[f"r_{i}_{j}"] for j in slots):
            if r is not None and 0 <= r < n:
                low, high = r / n - 1 / n - SLACK, (r + 2) / n + SLACK
                spans.append((grid[math.floor(max(low, 0.0) * GRID)], grid[math.ceil(min(high, 1.0) * GRID)]))
        merged: list[list[float]] = []
        for low, high in sorted(spans):
            if merged and low <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], high)
            else:
                merged.append([low, high])
        brackets[i] = (first, merged)
        if merged:
            x, region = F.col(f"x_{i}"), F
            for k, (low, high) in enumerate(merged):
                region = region.when(x < low, first + 2 * k).when(x <= high, first + 2 * k + 1)
            regions.append(F.struct(region.otherwise(first + 2 * len(merged)).alias("region"), x.alias("x")))
        first += 2 * len(merged) + 1
    found: dict[str, tuple[int, list]] = {name: (row[f"n_{i}"], [None] * len(ranks)) for i, name in enumerate(names)}
    if not regions:
        return found

    # Between brackets all rows count as one; inside a bracket every value counts by itself.
    inside = F.array_contains(F.array(*[F.lit(f + 2 * k + 1) for f, m in brackets.values() for k in range(len(m))]), F.col("region"))
    placed = base.select(F.inline(F.array(*regions))).where(F.col("x").isNotNull()).select("region", F.when(inside, F.col("x")).alias("x"))
    held, count = cut_and_count(placed.groupBy("region", "x").agg(F.count(F.lit(1)).alias("n")))
    sums = {r["region"]: r["n"] for r in held.groupBy("region").agg(F.sum("n").alias("n")).collect()}
    wants, places = [], {}
    for i, (start, merged) in brackets.items():
        for j in slots:
            r, before = row[f"r_{i}_{j}"], 0
            if not merged or r is None or not 0 <= r < row[f"n_{i}"]:
                continue
            for region in range(start, start + 2 * len(merged) + 1):
                here = sums.get(region, 0)
                if r < before + here:
                    if (region - start) % 2 == 0:
                        raise RuntimeError("a sketch missed a rank; run the query again")
                    wants.append(F.struct(F.lit(len(wants)).alias("id"), F.lit(region).alias("at"), F.lit(r - before).cast("long").alias("rank")))
                    places[len(wants) - 1] = (i, j)
                    break
                before += here
    upto = running_sums(held.where(F.col("x").isNotNull()), ["region"], "x", ["n"], count)
    asked = F.broadcast(df.sparkSession.range(1).select(F.inline(F.array(*wants))))
    hit = (F.col("region") == F.col("at")) & (F.col("n_before") <= F.col("rank")) & (F.col("rank") < F.col("n_before") + F.col("n"))
    for got in upto.join(asked, hit).select("id", "x").collect():
        i, j = places[got["id"]]
        found[names[i]][1][j] = got["x"]
    return found


def _literals(df: DataFrame, found: Mapping[str, tuple[int, list]], ranks: Sequence[str]) -> DataFrame:
    """One row per column: ``feature``, ``n`` and the value at each rank."""
    rows = [F.struct(F.lit(name).alias("feature"), F.lit(n).cast("long").alias("n"), *[F.lit(v).cast("double").alias(r) for r, v in zip(ranks, values)])
            for name, (n, values) in found.items()]
    return df.sparkSession.range(1).select(F.inline(F.array(*rows)))


def select_ranks(df: DataFrame, keys: Sequence[str], value: str, ranks: Mapping[str, RankOf]) -> DataFrame:
    """One row per group: ``n`` and, per name, the value at a 0-based rank.

    Each rank is a function of the group size ``n``; nulls and NaN are not counted, a rank outside of
    the group gives null.
    """
    keys = list(keys)
    if not keys:
        one = _literals(df, _column_ranks(df, {value: col(value)}, ranks), list(ranks))
        return one.select(F.when(F.col("n") > 0, F.col("n")).alias("n"), *ranks)
    base = df.where(present(value)).select(*keys, F.col(value).cast("double").alias("__x"))
    sizes = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size"))
    large, some = cut_and_count(sizes.where(F.col("__size") > SKETCH).select(*keys))
    if not some:
        return _of_whole_groups(base, keys, ranks)
    large = F.broadcast(large) if some <= BROADCAST_GROUPS else large
    of = large.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [base[k].eqNullSafe(of[f"__{k}"]) for k in keys])
    small = _of_whole_groups(base.join(of, same, "left_anti"), keys, ranks)
    return _of_brackets(_same(base, large, keys, []), keys, ranks).unionByName(small)


def _of_whole_groups(base: DataFrame, keys: list[str], ranks: Mapping[str, RankOf]) -> DataFrame:
    """Ranks of groups that are at most as large as a sketch: their values are collected and sorted."""
    held = base.groupBy(*keys).agg(F.array_sort(F.collect_list(F.col("__x") + 0.0)).alias("__values")).withColumn("n", F.size("__values").cast("long"))
    return held.select(*keys, "n", *[F.get("__values", rank(F.col("n")).cast("int")).alias(name) for name, rank in ranks.items()])


def _of_brackets(base: DataFrame, keys: list[str], ranks: Mapping[str, RankOf]) -> DataFrame:
    """Ranks of groups of any size."""
    slots = range(len(ranks))
    brackets = _brackets(base, keys, ranks)
    x = F.col("__x")
    rows = _same(base, brackets, keys, [])
    # Between two edges all rows count as one; inside a bracket every value counts by itself.
    at = sum(((F.col(f"lo_{i}") <= x).cast("int") + (F.col(f"hi_{i}") < x).cast("int") for i in slots), F.lit(0))
    inside = reduce(lambda a, b: a | b, [x.between(F.col(f"lo_{i}"), F.col(f"hi_{i}")) for i in slots])
    constant = [F.first(c).alias(c) for c in ("total", *[f"r_{i}" for i in slots])]
    held, count = cut_and_count(rows.groupBy(*keys, at.alias("__at"), F.when(inside, x).alias("__in")).agg(
        F.count(F.lit(1)).alias("__n"), F.min("__x").alias("__x"), *constant))
    upto = running_sums(held, keys, "__x", ["__n"], count)
    wanted = [F.col("__in").isNotNull() & F.col(f"r_{i}").between(F.col("__n_before"), F.col("__n_before") + F.col("__n") - 1) for i in slots]
    picked = upto.groupBy(*keys).agg(F.max("total").alias("n"), *[F.max(F.when(w, x)).alias(f"v_{i}") for i, w in enumerate(wanted)], *[
        F.max(f"r_{i}").alias(f"r_{i}") for i in slots])

    def checked(i: int) -> Column:
        missed = F.col(f"v_{i}").isNull() & F.col(f"r_{i}").between(0, F.col("n") - 1)
        return F.when(missed, F.raise_error(F.lit("a sketch missed a rank; run the query again"))).otherwise(F.col(f"v_{i}"))

    return picked.select(*keys, "n", *[checked(i).alias(name) for i, name in enumerate(ranks)])


def _quantile_ranks(probs: Mapping[str, float]) -> tuple[dict[str, RankOf], list[Column]]:
    """Ranks on either side of each quantile, and the interpolation between them."""
    def place(q: float) -> RankOf:
        return lambda n: (n - 1) * F.lit(float(q))

    ranks: dict[str, RankOf] = {}
    for name, q in probs.items():
        ranks[f"__lo_{name}"] = lambda n, q=q: F.floor(place(q)(n))
        ranks[f"__hi_{name}"] = lambda n, q=q: F.ceil(place(q)(n))
    out = []
    for name, q in probs.items():
        lo, hi, at = F.col(f"__lo_{name}"), F.col(f"__hi_{name}"), place(q)(F.col("n"))
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return ranks, out


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """One row per group: ``n`` and the linearly interpolated quantiles, exact."""
    ranks, out = _quantile_ranks(probs)
    return select_ranks(df, keys, value, ranks).select(*keys, "n", *out)


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    return exact_quantiles(df, keys, value, {name: 0.5})


def melt(df: DataFrame, keys: Sequence[str], features: Sequence[str], *, name: str = "feature",
         value: str = "value") -> DataFrame:
    """Wide to long: one row per (row, feature)."""
    pairs = [F.struct(F.lit(f).alias(name), F.col(f).cast("double").alias(value)) for f in features]
    return df.select(*keys, F.inline(F.array(*pairs)))


def feature_quantiles(df: DataFrame, features: Sequence[str], probs: Mapping[str, float],
                      keys: Sequence[str] = ()) -> DataFrame:
    """Quantiles of many columns in one set of passes: rows (keys, feature, n, quantiles)."""
    if not keys:
        ranks, out = _quantile_ranks(probs)
        found = _literals(df, _column_ranks(df, {f: F.col(f) for f in features}, ranks), list(ranks))
        return found.where(F.col("n") > 0).select("feature", "n", *out)
    return exact_quantiles(melt(df, keys, features), [*keys, "feature"], "value", probs)


def widen(long: DataFrame, features: Sequence[str], stats: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Back to one row (per key): column ``<feature>__<stat>`` for each pair."""
    picked = [F.max(F.when(F.col("feature") == f, F.col(s))).alias(f"{f}__{s}") for f in features for s in stats]
    return long.groupBy(*keys).agg(*picked)


def weighted_median(df: DataFrame, keys: Sequence[str], value: str, weight: str,
                    name: str = "weighted_median") -> DataFrame:
    """First value in ascending order whose cumulative weight reaches half of the group's total.

    The weights of equal values add up first; bins narrow as in ``select_ranks``.
    """
    keys = list(keys)
    values = df.where(present(value) & present(weight)).groupBy(*keys, F.col(value).cast("double").alias("__x")).agg(
        F.sum(weight).alias("cnt"))
    values = values.withColumn("__order_bin", F.shiftright(order_code("__x"), BIN_SHIFT))

    def first_reaching(counts: DataFrame, group: list[str], order: str, more: Sequence[str] = ()) -> DataFrame:
        w = _running(group, order)
        upto = F.col("base") + F.sum("cnt").over(w)
        last = F.max(order).over(Window.partitionBy(*group))
        reached = counts.withColumn("upto", upto).withColumn("last", last)
        # Rounding of a float weight may leave the last bin short of the target; it then qualifies.
        reached = reached.where((F.col("upto") >= F.col("half")) | (F.col(order) == F.col("last")))
        chosen = reached.groupBy(*group).agg(
            F.min_by(F.struct(order, (F.col("upto") - F.col("cnt")).alias("base"), "half", *more), order).alias("s"))
        return chosen.select(*group, "s.*")

    bins = values.groupBy(*keys, "__order_bin").agg(F.sum("cnt").alias("cnt"), F.min("__x").alias("lo"), F.max("__x").alias("hi"))
    bins = bins.withColumn("half", F.sum("cnt").over(Window.partitionBy(*keys)) / 2).withColumn("base", F.lit(0.0))
    values = _same(values, first_reaching(bins, keys, "__order_bin", ["lo", "hi"]), keys, ["__order_bin"])
    values = values.withColumn("__order_part", part_code("__x", "lo", "hi"))
    parts = values.groupBy(*keys, "__order_bin", "__order_part").agg(F.sum("cnt").alias("cnt"), *[F.first(c).alias(c) for c in ("base", "half")])
    parts = first_reaching(parts, [*keys, "__order_bin"], "__order_part")
    values = _same(values.drop("base", "half"), parts, keys, ["__order_bin", "__order_part"])
    values = first_reaching(values, [*keys, "__order_bin", "__order_part"], "__x")
    return values.groupBy(*keys).agg(F.max("__x").alias(name))
