"""Exact k nearest neighbours in feature space, without a cross join.

1. Copies of a vector collapse to one row with its first few ids, so copies never meet each other.
2. Distinct vectors go to the cell of their nearest pivot. Cells next to each other are packed into units of bounded
   size, a large cell is split by hash. Pivots grow with the data, up to the square root of the number of vectors.
3. A query vector first visits one unit of its own cell. The k-th distance found bounds the search.
4. The triangle inequality rules out cells too far from a vector to hold anything closer; a vector visits the units of the
   remaining cells. Where the bounds leave many units, cells go into a few large ones, so that a vector is copied few times.
5. A unit's vectors are copied once per part of its visitors, not per visit. A visit returns what lies within the bound, at
   most k rows per vector; they are merged with a top-k window.

Distances come from differences; products of matrices, in single precision, only tell, within their rounding, which pairs need none.

Nothing is approximated: a pruned cell provably holds no nearer vector. ``knn_join_approximate`` is the other mode,
to be asked for: in many dimensions the bounds rule out little, and locality-sensitive buckets look at fewer vectors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridstats.functions.columns import quoted
from gridstats.operators.quantiles import exact_quantiles
from gridstats.operators.scalars import attach_scalars
from gridstats.session import cut_lineage, stored

BLOCK_ROWS = 2048
#: Distances held at once.
CELLS = 4_000_000
#: Distances that stay in a core's cache between the steps of reckoning them.
CACHED = 1 << 17
#: Vectors that queries meet at once, and products of them that stay in a core's cache.
TILE, TILED = 2048, 1 << 19
#: Visitors, about, by which the size of units is judged.
JUDGED = 16384
#: Bytes of pivots that come to the driver whatever the number of vectors.
PIVOT_BYTES = 1 << 20
#: Vectors in a unit at most, units in a search at least, and bytes of a vector's copies beyond which units grow to that.
UNIT_ROWS, UNITS, COPIED = 32768, 8, 4096
#: Visitors that meet a unit at once, in vectors of the unit.
VISITORS = 16
#: Partitions that visits are dealt into, or four per core if that is more.
DEALT = 200
#: Vectors that approximate buckets are fitted on, and rows among them whose neighbours are looked up.
SAMPLE, TRIED = 2000, 200
COPY = 0.01


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty((len(a), len(b)))
    step = max(1, CELLS // max(1, b.size))
    for i in range(0, len(a), step):
        diff = a[i:i + step, None, :] - b[None, :, :]
        out[i:i + step] = np.sqrt((diff * diff).sum(axis=2))
    return out


def _rough(queries: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float] | None:
    """Factors whose product is the squared distances in single precision, how far it may be off, and its unit; None where
    numbers are too large."""
    middle = vectors.mean(axis=0)
    # A common offset would drown the distances; a difference of two numbers is rounded by its own size only.
    q, v = queries - middle, vectors - middle
    squares, sizes = (q * q).sum(axis=1), (v * v).sum(axis=1)
    if not (np.isfinite(squares).all() and np.isfinite(sizes).all()):
        return None
    unit = float(np.sqrt(max(squares.max(), sizes.max()))) or 1.0
    left = np.column_stack([q / unit, squares / unit**2, np.ones(len(q))]).astype(np.float32)
    right = np.column_stack([v / unit * -2, np.ones(len(v)), sizes / unit**2]).astype(np.float32).T
    slack = 2 * np.finfo(np.float32).eps * (queries.shape[1] + 8) * ((np.sqrt(squares) + np.sqrt(sizes.max())) / unit) ** 2 + 1e-30
    return left, right, slack, unit


def _close_pairs(queries: np.ndarray, vectors: np.ndarray, k: int, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, distance) of the pairs within reach that may be among the k nearest of the query, ties included."""
    with np.errstate(over="ignore", invalid="ignore"):
        factors = _rough(queries, vectors)
        if factors is None:
            slack, unit = np.zeros(len(queries)), 1.0
        else:
            left, right, slack, unit = factors
        limit = (reach / unit) ** 2 * (1 + 1e-6) + slack
    found = []
    for lo in range(0, len(vectors), TILE):
        some = vectors[lo:lo + TILE]
        rough = _distances(queries, some) ** 2 if factors is None else left @ right[:, lo:lo + TILE]
        near = rough <= limit[:, None].astype(rough.dtype)
        if np.count_nonzero(near) > 4 * k * len(queries):
            many = np.flatnonzero(near.sum(axis=1) > 4 * k)
            limit[many] = np.minimum(limit[many], np.partition(rough[many], k - 1, axis=1)[:, k - 1] * (1 + 1e-6) + 2 * slack[many])
            near[many] = rough[many] <= limit[many, None]
        flat = np.flatnonzero(near)
        found.append((flat // len(some), flat % len(some) + lo, rough.ravel()[flat]))
    at, to, rough = (np.concatenate(c) for c in zip(*found))
    if len(at) > 4 * k * len(queries) or len(found) > 1:
        # Only those that may be closer than the k-th.
        order = np.lexsort((rough, at))
        at, to, rough = at[order], to[order], rough[order]
        first = np.searchsorted(at, np.arange(len(queries)))
        kth = first + k - 1
        full = kth < np.append(first[1:], len(at))
        limit[full] = np.minimum(limit[full], rough[kth[full]] * (1 + 1e-6) + 2 * slack[full])
        kept = rough <= limit[at]
        at, to = at[kept], to[kept]
    dist, step = np.empty(len(at)), max(1, CELLS // max(1, queries.shape[1]))
    for i in range(0, len(at), step):
        diff = queries[at[i:i + step]] - vectors[to[i:i + step]]
        dist[i:i + step] = np.sqrt((diff * diff).sum(axis=1))
    kept = dist <= reach[at]
    return at[kept], to[kept], dist[kept]


class _Ids:
    """Ids of each vector, all kinds of ids compared by their order."""

    def __init__(self, column: pd.Series):
        ids = [i.tolist() for i in column]
        self.counts = np.array([len(i) for i in ids], dtype=np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        flat = np.concatenate([np.asarray(i, dtype=object) for i in ids]) if ids else np.zeros(0, dtype=object)
        self.names, self.order = np.unique(flat, return_inverse=True)

    def closest(self, at: np.ndarray, to: np.ndarray, dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, distance, id, vector) of the first k of each query by distance and id; each vector stands for its ids."""
        copies = self.counts[to]
        at, dist, vector = np.repeat(at, copies), np.repeat(dist, copies), np.repeat(to, copies)
        place = self.order[np.repeat(self.first[to] - (np.cumsum(copies) - copies), copies) + np.arange(copies.sum())]
        order = np.lexsort((place, dist, at))
        at, dist, place, vector = at[order], dist[order], place[order], vector[order]
        kept = np.arange(len(at)) - np.searchsorted(at, at, side="left") < k
        return at[kept], dist[kept], self.names[place[kept]], vector[kept]


def _nearest(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    """Per query of ``left`` the k closest of ``right`` within its reach: q, dist, id."""
    out = {"q": [], "dist": [], "id": []}
    if left.empty or right.empty:
        return pd.DataFrame(out)
    asked, given, ids = _matrix(left["vec"]), _matrix(right["t_vec"]), _Ids(right["t_ids"])
    number, reach = left["q"].to_numpy(), left["reach"].to_numpy()
    step = max(1, TILED // min(len(given), TILE))
    for i in range(0, len(asked), step):
        at, dist, near, _ = ids.closest(*_close_pairs(asked[i:i + step], given, k, reach[i:i + step]), k)
        for name, values in zip(out, (number[i + at], dist, near)):
            out[name].append(values)
    return pd.DataFrame({name: np.concatenate(values) for name, values in out.items()})


def _by_slices(column: pd.Series, width: int, use) -> list:
    """``use(matrix, from, to)`` on slices whose distances to ``width`` vectors fit in memory."""
    step = max(1, CELLS // max(1, width))
    return [use(_matrix(column.iloc[lo:lo + step]), lo, lo + step) for lo in range(0, len(column), step)]


def _distinct_vectors(df: DataFrame, vec: Column, row_id: str | None, k: int) -> DataFrame:
    """vec, ids: each distinct vector with its first k + 1 ids (only those can be among k neighbours)."""
    base = df.select(vec.alias("vec"), *([F.col(row_id).alias("id")] if row_id else []))
    base = base.where(F.col("vec").isNotNull())
    if row_id is None:
        counts = base.groupBy("vec").agg(F.count(F.lit(1)).alias("n"))
        return counts.select("vec", F.sequence(F.lit(1), F.least("n", F.lit(k + 1))).cast("array<bigint>").alias("ids"))
    # Spark limits each map task to its first k + 1 rows per vector before the shuffle.
    rn = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    first = base.withColumn("rn", rn).where(F.col("rn") <= k + 1)
    return first.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))


@dataclass(frozen=True)
class Layout:
    """Cells in the order of their pivots, packed into units of about ``rows`` vectors; a larger cell has several units."""

    first: np.ndarray
    count: np.ndarray

    @classmethod
    def of(cls, pivots: np.ndarray, sizes: np.ndarray, rows: int) -> Layout:
        spread = pivots - pivots.mean(axis=0)
        order = np.argsort(spread @ np.linalg.svd(spread, full_matrices=False)[2][0], kind="stable") if np.isfinite(spread).all() and spread.size else np.arange(len(pivots))
        first, count = np.zeros(len(sizes), dtype=np.int64), np.ones(len(sizes), dtype=np.int64)
        unit, held = 0, 0
        for c in order:
            count[c] = max(1, math.ceil(sizes[c] / rows))
            if held and held + sizes[c] > rows:
                unit, held = unit + 1, 0
            first[c] = unit
            unit, held = unit + int(count[c]) - 1, rows if count[c] > 1 else held + int(sizes[c])
        return cls(first, count)

    def unit(self, cell: Column, key: Column) -> Column:
        """The unit of a row: one of those of its cell."""
        # One literal each, however many cells there are.
        first, count = (F.element_at(F.split(F.lit(",".join(map(str, a.tolist()))), ",").cast("array<bigint>"), cell + 1) for a in (self.first, self.count))
        return first + F.pmod(F.xxhash64(key, F.lit(7)), count)

    def units(self, rows: np.ndarray, cells: np.ndarray, n: int) -> list[np.ndarray]:
        """The units of the cells of each of ``n`` rows, from pairs of a row and a cell."""
        count, total = self.count[cells], int((self.first + self.count).max(initial=0)) + 1
        places = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        pairs = np.unique(np.repeat(rows * total + self.first[cells], count) + places)
        return np.split(pairs % total, np.searchsorted(pairs // total, np.arange(1, n)))


def _meet(asked: DataFrame, given: DataFrame, part_rows: int, across, schema: str) -> DataFrame:
    """``across`` on the visitors ``asked`` and the vectors ``given`` of each ``unit``.

    Visitors of a unit are dealt into parts of about ``part_rows``; the unit's vectors are copied once per part.
    """
    spark = asked.sparkSession
    parts = cut_lineage(asked.groupBy("unit").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("parts")))
    groups = parts.agg(F.sum("parts")).first()[0] or 1
    dealt = min(groups, max(DEALT, 4 * spark.sparkContext.defaultParallelism))
    left = asked.join(parts, "unit").withColumn("part", F.pmod(F.xxhash64("q", F.lit(3)), F.col("parts")).cast("int")).drop("parts")
    # Fresh column names: the two sides of the co-group must not share attributes.
    right = given.join(parts, "unit").withColumn("p_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = right.withColumnRenamed("unit", "p_unit").drop("parts")
    return left.repartition(dealt, "unit", "part").groupBy("unit", "part").cogroup(
        right.repartition(dealt, "p_unit", "p_part").groupBy("p_unit", "p_part")).applyInPandas(across, schema)


def _visits(asked: DataFrame, reach: Column, opened, pivots: np.ndarray, sizes: np.ndarray, block_rows: int, width: int) -> tuple[DataFrame, Layout, int]:
    """``asked`` with ``reach``, once per unit that may hold something within it; the layout, and rows per part.

    ``opened(matrix, reach)`` gives pairs of a row and a cell; it holds ``width`` numbers per row.
    """
    def units(layout: Layout) -> Column:
        @F.pandas_udf("array<bigint>")
        def run(column: pd.Series, reach: pd.Series) -> pd.Series:
            found = lambda x, lo, hi: layout.units(*opened(x, reach.to_numpy()[lo:hi]), len(x))
            return pd.Series([u for part in _by_slices(column, width, found) for u in part], dtype=object)

        return run("vec", reach)

    rows, most = block_rows, max(block_rows, min(UNIT_ROWS, math.ceil(int(sizes.sum()) / UNITS)))
    layout = Layout.of(pivots, sizes, rows)
    # How large units should be is judged on some of the visitors; all of them visit.
    some = asked.where(F.pmod(F.xxhash64("q", F.lit(5)), F.lit(max(1, int(sizes.sum()) // JUDGED))) == 0)
    while rows < most and (some.agg(F.avg(F.size(units(layout)))).first()[0] or 0.0) * 8 * (pivots.shape[1] + 3) > COPIED:
        rows = min(4 * rows, most)
        layout = Layout.of(pivots, sizes, rows)
    return asked.withColumn("reach", reach).withColumn("unit", F.explode(units(layout))), layout, max(most, min(VISITORS * rows, UNIT_ROWS))


def _closest(found: DataFrame, want: int, *keys: str) -> DataFrame:
    """The first ``want`` of each query by distance and id."""
    rn = F.row_number().over(Window.partitionBy("q", *keys).orderBy("dist", "id"))
    return found.withColumn("rn", rn).where(F.col("rn") <= want).drop("rn")


def _search(vectors: DataFrame, want: int, block_rows: int, max_pivots: int | None) -> DataFrame:
    """vec -> best: the ``want`` closest (distance, id) among all vectors, per vector.

    ``vectors`` holds distinct ``vec`` with a number ``q`` and their ``ids``, already materialised.
    """
    n = vectors.count()
    kind = vectors.schema["ids"].dataType.elementType.simpleString()
    if not n:
        return vectors.select("vec", F.lit(None).cast(f"array<struct<dist:double,id:{kind}>>").alias("best"))
    cells = max(1, min(math.isqrt(n) if max_pivots is None else max_pivots, math.ceil(n / block_rows)))
    # A square root of the vectors at most comes to the driver.
    pivots = [r["vec"] for r in vectors.orderBy(F.xxhash64("vec"), "vec").limit(cells).select("vec").collect()]
    pivot_matrix = np.array(pivots, dtype=np.float64).reshape(len(pivots), -1)

    @F.pandas_udf("struct<cell:int,dist:double>")
    def home(column: pd.Series) -> pd.DataFrame:
        def nearest(part, lo, hi):
            d = _distances(part, pivot_matrix)
            at = d.argmin(axis=1)
            return pd.DataFrame({"cell": at.astype("int32"), "dist": d[np.arange(len(d)), at]})

        return pd.concat(_by_slices(column, len(pivots), nearest), ignore_index=True) if len(column) else pd.DataFrame({"cell": [], "dist": []})

    placed = cut_lineage(vectors.withColumn("home", home("vec")).select("q", "vec", "ids", "home.cell", "home.dist"))
    shape = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("radius"), F.min("dist").alias("inner"))
    known = {r["cell"]: r for r in shape.collect()}
    sizes = np.array([known[c]["n"] if c in known else 0 for c in range(len(pivots))])
    outer = np.array([known[c]["radius"] if c in known else -1.0 for c in range(len(pivots))])
    inner = np.array([known[c]["inner"] if c in known else math.inf for c in range(len(pivots))])

    def meet(asked: DataFrame, layout: Layout, part_rows: int) -> DataFrame:
        given = placed.select(layout.unit(F.col("cell"), F.col("vec")).alias("unit"), F.col("vec").alias("t_vec"), F.col("ids").alias("t_ids"))
        across = lambda left, right: _nearest(left, right, want)
        return _meet(asked.select("q", "vec", "reach", "unit"), given, part_rows, across, f"q bigint, dist double, id {kind}")

    layout = Layout.of(pivot_matrix, sizes, block_rows)
    first = placed.withColumns({"unit": layout.unit(F.col("cell"), F.col("vec")), "reach": F.lit(float("inf"))})
    found = meet(first, layout, block_rows)
    if n > block_rows:
        known_reach = F.when(F.count(F.lit(1)) == want, F.max("dist")).otherwise(float("inf")).alias("bound")
        bounds = cut_lineage(found.groupBy("q").agg(known_reach))

        def opened(part: np.ndarray, reach: np.ndarray):
            d = _distances(part, pivot_matrix)
            # Vectors that are not numbers have no distance and bound nothing.
            bound = np.fmax(np.fmax(d - np.where(np.isnan(outer), np.inf, outer), inner - d), 0.0)
            return np.nonzero((bound <= reach[:, None] + 1e-9 * (1.0 + np.nan_to_num(d))) & (sizes > 0))

        asked = cut_lineage(placed.select("q", "vec").join(bounds, "q", "left"))
        found = _closest(meet(*_visits(asked, F.coalesce("bound", F.lit(float("inf"))), opened, pivot_matrix, sizes, block_rows, len(pivots))), want)
    best = found.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("dist", "id"))).alias("best"))
    return vectors.select("q", "vec").join(best, "q").drop("q")


def _numbered(df: DataFrame) -> DataFrame:
    """Stored, with a number ``q`` per row."""
    return cut_lineage(df.withColumn("q", F.monotonically_increasing_id()))


def knn_join(df: DataFrame, row_id: str, vec: str, k: int = 5, *, block_rows: int = BLOCK_ROWS,
             max_pivots: int | None = None) -> DataFrame:
    """k nearest other rows per row: (id, rank, neighbour, distance); ties go to the smaller id."""
    v = F.col(vec).cast("array<double>")
    found = _search(_numbered(_distinct_vectors(df, v, row_id, k)), k + 1, block_rows, max_pivots)
    return _other_rows(df, row_id, v, found, k)


@dataclass(frozen=True)
class Buckets:
    """Random projections cut into cells, in several tables; near vectors share a cell in one of them."""

    directions: np.ndarray  # dimensions x (tables * hashes)
    shifts: np.ndarray
    tables: int
    probes: int
    recall: float  # on the sample that it was fitted on

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = (x @ self.directions + self.shifts).reshape(len(x), self.tables, -1)
        cell = np.floor(place)
        return cell.astype(np.int64), place - cell

    def names(self, cell: np.ndarray) -> np.ndarray:
        """One number per (table, cell)."""
        out = np.broadcast_to(np.arange(1, self.tables + 1, dtype=np.uint64), cell.shape[:2]).copy()
        with np.errstate(over="ignore"):
            for i in range(cell.shape[2]):
                out = (out ^ cell[:, :, i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(29)
        return out.view(np.int64)

    def home(self, x: np.ndarray) -> np.ndarray:
        return self.names(self.cells(x)[0])

    def visited(self, x: np.ndarray) -> np.ndarray:
        """Home cells and, per table, those beyond the ``probes`` nearest walls."""
        cell, within = self.cells(x)
        walls = np.argsort(np.minimum(within, 1 - within), axis=2)[:, :, :self.probes]
        out = [self.names(cell)]
        for i in range(walls.shape[2]):
            moved, wall = cell.copy(), walls[:, :, i:i + 1]
            step = np.where(np.take_along_axis(within, wall, axis=2) < 0.5, -1, 1)
            np.put_along_axis(moved, wall, np.take_along_axis(cell, wall, axis=2) + step, axis=2)
            out.append(self.names(moved))
        return np.concatenate(out, axis=1)


def fit_buckets(sample: np.ndarray, k: int, recall: float, seed: int = 11) -> Buckets:
    """The buckets that cost least among those that find ``recall`` of the sample's neighbours.

    A vector met in several tables counts in each, and a copy of a vector costs as much as meeting a share ``COPY`` of
    all vectors. Where no buckets are cheaper than to meet all, one holds everything. Neighbours within a sample are farther apart than in the whole table, so its recall is a cautious one.
    """
    rng = np.random.default_rng(seed)
    asked = rng.permutation(len(sample))[:TRIED]
    far = _distances(sample[asked], sample)
    far[np.arange(len(asked)), asked] = np.inf
    near = np.argpartition(far, min(k, len(sample) - 1) - 1, axis=1)[:, :k] if len(sample) > 1 else np.zeros((len(asked), 0), dtype=int)
    unit = float(np.median(np.take_along_axis(far, near, axis=1))) if near.size else 1.0
    best = None
    for tables in (1, 2, 4, 8, 16):
        for hashes in (1, 2, 3, 4, 6, 8, 10):
            for width in (0.5, 1.0, 2.0, 4.0, 8.0):
                b = Buckets(rng.standard_normal((sample.shape[1], tables * hashes)) / (width * (unit or 1.0)), rng.uniform(0, 1, tables * hashes), tables, min(2, hashes), 0.0)
                home, visited = b.home(sample), b.visited(sample[asked])
                met = np.zeros((len(asked), len(sample)), dtype=np.int32)
                for t in range(tables):
                    for p in range(b.probes + 1):
                        met += visited[:, p * tables + t][:, None] == home[:, t][None, :]
                found = float((np.take_along_axis(met, near, axis=1) > 0).mean()) if near.size else 1.0
                cost = met.mean() + COPY * visited.shape[1]
                if found >= recall and cost < (1 + COPY * UNITS if best is None else best[0]):
                    best = (cost, replace(b, recall=found))
    if best is None:
        # One cell in one table holds everything.
        return Buckets(np.zeros((sample.shape[1], 1)), np.zeros(1), 1, 0, 1.0)
    return best[1]


def knn_join_approximate(df: DataFrame, row_id: str, vec: str, k: int = 5, *, recall: float = 0.95, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``knn_join`` through locality-sensitive buckets: most of the k nearest other rows, distances exact.

    Buckets are fitted on ``SAMPLE`` vectors at most, to the recall asked for, and every vector is put into them. A
    bucket of any size is searched whole, in blocks. A row that shares no bucket with k others gets fewer.
    """
    v = F.col(vec).cast("array<double>")
    vectors = _numbered(_distinct_vectors(df, v, row_id, k))
    n = vectors.count()
    share = min(1.0, SAMPLE / max(1, n))
    least = vectors.where(F.pmod(F.xxhash64("vec"), F.lit(1 << 20)) < F.lit(math.ceil(share * (1 << 20))))
    sample = np.array([r["vec"] for r in least.select("vec").limit(2 * SAMPLE).collect()], dtype=np.float64)
    if not len(sample):
        return knn_join(df, row_id, vec, k, block_rows=block_rows)
    buckets = fit_buckets(sample, k, recall)

    def named(method: str) -> Column:
        @F.pandas_udf("array<bigint>")
        def run(column: pd.Series) -> pd.Series:
            parts = _by_slices(column, buckets.directions.shape[1] * 4, lambda x, lo, hi: list(np.sort(getattr(buckets, method)(x), axis=1)))
            return pd.Series([row for part in parts for row in part], dtype=object)

        return F.explode(F.array_distinct(run("vec")))

    # Large buckets are cut into few large units, which a vector visits one by one.
    unit_rows = max(block_rows, min(UNIT_ROWS, math.ceil(n / UNITS)))
    homes = vectors.select("vec", "ids", named("home").alias("bucket"))
    sizes = cut_lineage(homes.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / unit_rows).cast("int").alias("blocks")))

    def unit(block: Column) -> Column:
        return F.xxhash64("bucket", block.cast("int")).alias("unit")

    given = homes.join(sizes, "bucket").select(unit(F.pmod(F.xxhash64("vec"), F.col("blocks"))), F.col("vec").alias("t_vec"), F.col("ids").alias("t_ids"))
    asked = vectors.select("q", "vec", named("visited").alias("bucket")).join(sizes, "bucket")
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = asked.select("q", "vec", F.lit(float("inf")).alias("reach"), unit(F.col("block")))
    kind = vectors.schema["ids"].dataType.elementType.simpleString()
    across = lambda left, right: _nearest(left, right, k + 1)
    # The same neighbour may come from several tables.
    found = _closest(_meet(asked, given, unit_rows, across, f"q bigint, dist double, id {kind}").distinct(), k + 1)
    best = found.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("dist", "id"))).alias("best"))
    return _other_rows(df, row_id, v, vectors.select("q", "vec").join(best, "q").drop("q"), k)


def _other_rows(df: DataFrame, row_id: str, v: Column, found: DataFrame, k: int) -> DataFrame:
    rows = df.select(F.col(row_id).alias("id"), v.alias("vec")).join(found, "vec")
    others = F.slice(F.filter("best", lambda b: b["id"] != F.col("id")), 1, k)
    return rows.select("id", F.posexplode(others).alias("rank", "b")).select(
        "id", (F.col("rank") + 1).alias("rank"), F.col("b.id").alias("neighbour"), F.col("b.dist").alias("distance"))


def neighbour_recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: ``wanted`` neighbours of the exact search and the share of them ``found``, ties of distance counting as found."""
    farthest = exact.groupBy("id").agg(F.count(F.lit(1)).alias("wanted"), F.max("distance").alias("limit"))
    hits = found.join(farthest, "id").groupBy("id").agg(F.count_if(F.col("distance") <= F.col("limit") * (1 + 1e-12)).alias("hits"))
    return farthest.join(hits, "id", "left").agg(F.sum("wanted").alias("wanted"), (F.sum(F.least("hits", "wanted")) / F.sum("wanted")).alias("recall"))


def mean_neighbour_distance(df: DataFrame, features: list[str], k: int = 5, *, name: str = "mean_distance",
                            block_rows: int = BLOCK_ROWS, max_pivots: int | None = None) -> DataFrame:
    """Rows without null features, with the mean distance to their k nearest other rows."""
    complete = df.dropna(subset=list(features))
    vec = F.array(*[F.col(f).cast("double") for f in features])
    found = _search(_numbered(_distinct_vectors(complete, vec, None, k)), k + 1, block_rows, max_pivots)
    others = F.transform(F.slice("best", 2, k), lambda b: b["dist"])
    # Written: whoever reads the distances more than once runs the search once.
    means = stored(found.select("vec", (F.aggregate(others, F.lit(0.0), lambda a, d: a + d) / F.size(others)).alias(name)))
    return complete.withColumn("vec", vec).join(means, "vec").drop("vec")


def isolation_filter(df: DataFrame, features: list[str], *, k: int = 5, share: float = 0.99,
                     block_rows: int = BLOCK_ROWS, max_pivots: int | None = None) -> DataFrame:
    """Drop rows whose mean distance to k neighbours is beyond a quantile of all such distances."""
    scored = mean_neighbour_distance(df, features, k, name="__d", block_rows=block_rows, max_pivots=max_pivots)
    limit = exact_quantiles(scored, [], "__d", {"limit": share})
    return attach_scalars(scored, limit, "__l").where(F.col("__d") <= F.col("__l.limit")).drop("__d", "__l")


def _masked(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Distances over the features that both rows have (NaN marks the others), scaled up by the share of features used."""
    has, given = (~np.isnan(x) for x in (queries, vectors))
    asked, held = np.where(has, queries, 0.0), np.where(given, vectors, 0.0)
    sums = np.zeros((len(queries), len(vectors)))
    for f in range(queries.shape[1]):
        at = np.flatnonzero(has[:, f])
        if len(at):
            diff = asked[at, f, None] - held[None, :, f]
            diff *= given[None, :, f]
            diff *= diff
            if len(at) == len(queries):
                sums += diff
            else:
                sums[at] += diff
    shared = has.astype(np.float64) @ given.T.astype(np.float64)
    scale = np.sqrt(vectors.shape[1] / np.maximum(np.arange(queries.shape[1] + 1.0), 1))
    return np.where(shared > 0, np.sqrt(sums, out=sums) * scale[shared.astype(np.int8 if queries.shape[1] < 100 else np.int64)], np.inf)


def _masked_nearest(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    """Per query and feature it lacks, the k nearest of these donors that have it, within reach: q, feature, dist, id, value."""
    out = {"q": [], "feature": [], "dist": [], "id": [], "value": []}
    if left.empty or right.empty:
        return pd.DataFrame(out)
    asked, given, ids = _matrix(left["vec"]), _matrix(right["t_vec"]), _Ids(right["t_ids"])
    number, reach = left["q"].to_numpy(), left["reach"].to_numpy()
    step = max(1, CACHED // len(given))
    for lo in range(0, len(asked), step):
        part = asked[lo:lo + step]
        dist = _masked(part, given)
        for f in range(asked.shape[1]):
            q, d = np.flatnonzero(np.isnan(part[:, f])), np.flatnonzero(~np.isnan(given[:, f]))
            if not len(q) or not len(d):
                continue
            far = dist[np.ix_(q, d)]
            near = (far <= reach[lo:lo + step][q][:, None]) & np.isfinite(far)
            many = np.flatnonzero(near.sum(axis=1) > 4 * k)
            if len(many):
                near[many] &= far[many] <= np.partition(far[many], k - 1, axis=1)[:, k - 1, None]
            at, to = np.nonzero(near)
            at, far, near_ids, donor = ids.closest(at, d[to], far[at, to], k)
            for name, values in zip(out, (number[lo + q[at]], np.full(len(at), f), far, near_ids, given[donor, f])):
                out[name].append(values)
    return pd.DataFrame({name: np.concatenate(values) if values else [] for name, values in out.items()})


@dataclass(frozen=True)
class Boxes:
    """Per cell of donors: the range of each feature, whether all and whether any of its rows have it."""

    low: np.ndarray
    high: np.ndarray
    every: np.ndarray
    some: np.ndarray

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Least distance that any row of a cell can have to a query, whatever features either lacks.

        Features that all rows of the cell have count with their gap; at most all that any row has are shared.
        """
        sums, shared = np.zeros((len(queries), len(self.low))), np.zeros((len(queries), len(self.low)))
        for f in range(queries.shape[1]):
            q, low, high = queries[:, f, None], self.low[None, :, f], self.high[None, :, f]
            known = ~np.isnan(q)
            gap = np.nan_to_num(np.maximum(np.maximum(low - q, q - high), 0.0))
            sums += np.where(known & self.every[None, :, f], gap * gap, 0.0)
            shared += known & self.some[None, :, f]
        return np.where(shared > 0, np.sqrt(sums * queries.shape[1] / np.maximum(shared, 1)), np.inf)

    def of(self, cells: np.ndarray) -> Boxes:
        return Boxes(self.low[cells], self.high[cells], self.every[cells], self.some[cells])

    def around(self, groups: list[np.ndarray]) -> Boxes:
        """One box around the cells of each group, which is no farther from a query than any of them."""
        least = lambda a, empty, least: np.array([least(a[g], axis=0, initial=empty) for g in groups])
        return Boxes(least(np.nan_to_num(self.low, nan=np.inf), np.inf, np.min), least(np.nan_to_num(self.high, nan=-np.inf), -np.inf, np.max),
                     np.array([self.every[g].all(axis=0) for g in groups]), np.array([self.some[g].any(axis=0) for g in groups]))


@dataclass(frozen=True)
class Groups:
    """Pivots around some of them, about a square root: a row looks at these first, then at the pivots of one or a few groups."""

    pivots: np.ndarray
    centres: np.ndarray
    members: list[np.ndarray]

    @classmethod
    def of(cls, pivots: np.ndarray) -> Groups:
        # Pivots come in the order of a hash: the first ones are any of them.
        centres = pivots[:math.isqrt(len(pivots))]
        home = cls._nearest(pivots, centres)
        return cls(pivots, centres, [np.union1d(np.flatnonzero(home == g), [g]) for g in range(len(centres))])

    @staticmethod
    def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        """The place of the nearest centre, to rounding."""
        middle = centres.mean(axis=0)
        with np.errstate(over="ignore", invalid="ignore"):
            c = centres - middle
            return ((c * c).sum(axis=1) - 2.0 * ((x - middle) @ c.T)).argmin(axis=1)

    def home(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row: that of the nearest pivot in the group of the nearest centre."""
        group, out = self._nearest(x, self.centres), np.empty(len(x), dtype=np.int32)
        for g in np.unique(group):
            rows = np.flatnonzero(group == g)
            out[rows] = self.members[g][self._nearest(x[rows], self.pivots[self.members[g]])]
        return out


def _masked_search(asked: DataFrame, donors: DataFrame, means: list[float], k: int, block_rows: int, max_pivots: int | None) -> DataFrame:
    """``q``, ``feature`` (its place), ``dist``, ``id``, ``value``: the k nearest donors of every query that have the feature.

    ``asked`` holds ``q`` and ``vec``, ``donors`` distinct ``vec`` with a number and their ``ids``; null marks what a row lacks. One
    index of all donors: cells around pivots, in vectors whose gaps hold the means, and the box of each cell.
    """
    width = len(means)
    n = donors.count()
    filled = F.transform("vec", lambda v, i: F.coalesce(v, F.array(*[F.lit(m) for m in means])[i]))
    most = max(math.isqrt(n), PIVOT_BYTES // (8 * width)) if max_pivots is None else max_pivots
    cells = max(1, min(most, math.ceil(n / block_rows)))
    pivots = [r["v"] for r in donors.select("q", filled.alias("v")).orderBy(F.xxhash64("q"), "q").limit(cells).select("v").collect()]
    pivot_matrix = np.array(pivots, dtype=np.float64).reshape(len(pivots), width)
    # Any cell is right for a row: boxes are taken from what is in the cells.
    groups = Groups.of(pivot_matrix)

    @F.pandas_udf("int")
    def home(column: pd.Series) -> pd.Series:
        return pd.Series([c for part in _by_slices(column, len(groups.centres), lambda x, lo, hi: groups.home(x)) for c in part], dtype="int32")

    placed = cut_lineage(donors.withColumn("cell", home(filled)))
    value = [F.col("vec")[i] for i in range(width)]
    # One row per cell.
    shape = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *[
        g(v).alias(f"{name}_{i}") for i, v in enumerate(value) for name, g in (("low", F.min), ("high", F.max), ("known", F.count))]).collect()}
    sizes = np.array([shape[c]["n"] if c in shape else 0 for c in range(len(pivots))])
    column = lambda name: np.array([[shape[c][f"{name}_{i}"] if c in shape else None for i in range(width)] for c in range(len(pivots))], dtype=np.float64).reshape(len(pivots), width)
    known = np.nan_to_num(column("known"))
    boxes = Boxes(column("low"), column("high"), known == sizes[:, None], known > 0)
    asked = cut_lineage(asked.withColumn("cell", home(filled)))
    kinds = {"id": donors.schema["ids"].dataType.elementType.simpleString()}

    def meet(visitors: DataFrame, layout: Layout, part_rows: int) -> DataFrame:
        given = placed.select(layout.unit(F.col("cell"), F.col("q")).alias("unit"), F.col("vec").alias("t_vec"), F.col("ids").alias("t_ids"))
        across = lambda left, right: _masked_nearest(left, right, k)
        return _meet(visitors.select("q", "vec", "reach", "unit"), given, part_rows, across, f"q bigint, feature int, dist double, id {kinds['id']}, value double")

    layout = Layout.of(pivot_matrix, sizes, block_rows)
    first = asked.withColumns({"unit": layout.unit(F.col("cell"), F.col("q")), "reach": F.lit(float("inf"))})
    found = meet(first, layout, VISITORS * block_rows)
    if n <= block_rows:
        return found  # a single unit: every donor has been seen
    # The farthest of the k found for the worst feature bounds the search; a feature with fewer leaves it open.
    reach = found.groupBy("q", "feature").agg(F.max("dist").alias("far"), F.count(F.lit(1)).alias("n"))
    reach = reach.groupBy("q").agg(F.max(F.when(F.col("n") < k, float("inf")).otherwise(F.col("far"))).alias("bound"), F.count(F.lit(1)).alias("features"))
    lacking = F.size(F.filter("vec", lambda v: v.isNull()))
    asked = cut_lineage(asked.join(reach, "q", "left").select("q", "vec", F.when(F.col("features") == lacking, F.col("bound")).otherwise(float("inf")).alias("bound")))

    held = [g[sizes[g] > 0] for g in groups.members]
    held = [g for g in held if len(g)]
    outer, inner = boxes.around(held), [boxes.of(g) for g in held]

    def opened(part: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        limit, pairs = reach[:, None] * (1 + 1e-9), [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
        close = outer.bounds(part) <= limit * (1 + 1e-9)
        for g in np.flatnonzero(close.any(axis=0)):
            rows = np.flatnonzero(close[:, g])
            at, to = np.nonzero(inner[g].bounds(part[rows]) <= limit[rows])
            pairs.append((rows[at], held[g][to]))
        return tuple(np.concatenate(c) for c in zip(*pairs))

    return _closest(meet(*_visits(asked, F.col("bound") * (1 + 1e-9), opened, pivot_matrix, sizes, block_rows, 4 * len(held))), k, "feature")


def knn_impute(train: DataFrame, df: DataFrame, features: list[str], row_id: str, k: int = 5, *,
               block_rows: int = BLOCK_ROWS, max_pivots: int | None = None) -> DataFrame:
    """Fill nulls by the distance-weighted mean of the k nearest training rows that have the value.

    Distances use the features both rows have, scaled up by the share of features used. One search over one index of
    the training rows serves every pattern of missing features. A value no training row can supply falls back
    to the training mean.
    """
    vec = F.array(*[F.col(f).cast("double") for f in features])
    lacking = cut_lineage(df.where(F.exists(vec, lambda v: v.isNull())).select(F.col(row_id).alias("row"), vec.alias("vec")))
    # Only the order of ids counts, and a missing one comes first.
    least = {"string": "", "bigint": -(1 << 63), "int": -(1 << 31)}.get(train.schema[row_id].dataType.simpleString())
    number = F.col(row_id) if least is None else F.coalesce(row_id, F.lit(least)).cast(train.schema[row_id].dataType)
    given = train.where(F.exists(vec, lambda v: v.isNotNull())).select(number.alias("id"), vec.alias("vec"))
    # Rows of the same values have the same neighbours, and only the first k of the donors of the same values are any.
    donors = _numbered(_distinct_vectors(given, F.col("vec"), "id", k))
    asked = _numbered(lacking.select("vec").distinct())
    means = train.agg(*[F.avg(f).alias(f) for f in features])
    filled, found = df, None
    if lacking.take(1) and donors.take(1):
        near = _masked_search(asked, donors, [m or 0.0 for m in means.first()], k, block_rows, max_pivots)
        near = near.groupBy("q").agg(F.collect_list(F.struct("feature", "dist", "id", "value")).alias("near")).join(asked, "q").select("vec", "near")
        # Rows that share an id share the k nearest of all of them.
        found = lacking.join(near, "vec").select(F.col("row").alias("q"), F.inline("near")).repartition("q")
        found = _closest(found, k, "feature")
        exact = F.count_if(F.col("dist") == 0) > 0
        at_zero = F.avg(F.when(F.col("dist") == 0, F.col("value")))
        by_distance = F.sum(F.try_divide("value", "dist")) / F.sum(F.try_divide(F.lit(1.0), "dist"))
        values = found.groupBy("q", "feature").agg(F.when(exact, at_zero).otherwise(by_distance).alias("value"))
        wide = values.groupBy("q").agg(*[F.max(F.when(F.col("feature") == i, F.col("value"))).alias(f"__{f}") for i, f in enumerate(features)])
        filled = df.join(wide.withColumnRenamed("q", row_id), row_id, "left")
    marked = attach_scalars(filled, means, "__m")
    out = {f: F.coalesce(F.col(f).cast("double"), *([F.col(f"__{f}")] if found is not None else []), F.col(f"__m.{f}")) for f in features}
    return marked.withColumns(out).select(*quoted(df.columns))
