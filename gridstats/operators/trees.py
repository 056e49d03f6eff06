"""Boosted regression trees by the method of Spark's ``GBTRegressor``, fitted on rows packed into blocks.

1. Rows are packed once for all fits: a block holds, per feature, the distinct values of its rows in order and a short code
   per row, next to the label and the columns that fits choose rows by.
2. A fit reads the values of all its rows for the split points: those of a block are thinned to weighted quantiles, and these
   are merged per feature. A feature of few values gets all points between them.
3. Its rows become a byte per feature, the bin, and are written once, by feature.
4. A level of a tree is one pass: a task places the rows of a block in the nodes and adds up what is left to explain per
   node, feature and bin. What a task returns does not grow with its rows; a node is split on the driver.

As in Spark: squared error, variance gain, a leaf where nothing is gained, rows of a tree drawn without replacement. Spark's
own fit keeps every row as an object for each fit under way, which memory does not hold at size; blocks are read
from files, as columns. The result is Spark's model.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gridstats.session import stored

#: Bins of a feature at most, as Spark has them.
BINS = 32
#: Rows of a block at most, bytes of their values, unpacked, and weighted values that a feature's distribution is thinned to.
BLOCK_ROWS, BLOCK_BYTES, POINTS = 1 << 15, 32 << 20, 1024
#: Trees after which predictions so far are written with the blocks.
HELD_TREES = 10
#: Tasks of a pass, per core, and bytes of their sums that come to the driver at once.
TASKS, COLLECTED = 4, 64 << 20
#: An impurity below this is none.
PURE = 2.0**-52
BINNED = "block bigint, bins binary, label binary, margin binary"
SUMS = "part int, sums binary"
LABEL = "__label"

#: A tree in bytes: (node, feature, bin, new node) in order from the root, rows beyond the bin move to the new node.
Splits = list[tuple[int, int, int, int]]
#: Which rows of a block, by the columns kept with them.
Chosen = Callable[[pa.RecordBatch], np.ndarray]


@dataclass
class Node:
    at: int
    stats: np.ndarray  # rows, sum, sum of squares
    gain: float = 0.0
    feature: int = -1
    bin: int = -1
    children: tuple[Node, Node] | None = None

    @property
    def mean(self) -> float:
        return float(self.stats[1] / self.stats[0])

    @property
    def impurity(self) -> float:
        n, s, squares = self.stats
        return float((squares - s * s / n) / n)


@dataclass
class Tree:
    root: Node
    splits: Splits = field(default_factory=list)
    values: list[float] = field(default_factory=list)

    def placed(self, bins: np.ndarray) -> np.ndarray:
        return placed(self.splits, len(self.values), bins)


def placed(splits: Splits, nodes: int, bins: np.ndarray) -> np.ndarray:
    """The node of each row; ``bins`` holds a line of bytes per feature."""
    kind = np.uint8 if nodes <= 256 else np.uint16 if nodes <= 65536 else np.uint32
    at = np.zeros(bins.shape[1], dtype=kind)
    for node, feature, last, new in splits:
        beyond = bins[feature] > last
        beyond &= at == node
        at += beyond.astype(kind) * kind(new - node)
    return at


def _columns(column: pa.Array) -> np.ndarray:
    """Numbers, or lists of equal lengths, as the columns of a matrix; a missing number is not a number."""
    if not pa.types.is_list(column.type):
        return column.to_numpy(zero_copy_only=False)[:, None]
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass(frozen=True)
class Packed:
    """Stored blocks: ``block`` and ``data``, Arrow columns of coded features (by place), the label and the columns kept."""

    blocks: DataFrame
    width: int
    kept: T.StructType

    def map(self, use: Callable[[int, pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType) -> DataFrame:
        """``use(number, rows)`` of every block; nothing for None."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                    out = use(number, pa.ipc.open_stream(data.as_buffer()).read_next_batch())
                    if out is not None:
                        yield out

        return in_tasks(self.blocks).mapInArrow(run, schema)


def packed(df: DataFrame, features: Sequence[str], label: str, kept: Sequence[str] = ()) -> Packed:
    """Rows in blocks, stored; ``features`` are numbers or vectors."""
    kinds = [df.schema[f].dataType.simpleString() for f in features]
    given = [vector_to_array(f) if k == "vector" else F.col(f) if k.startswith("array") else F.col(f).cast("double") for f, k in zip(features, kinds)]
    rows = df.select(*[c.alias(f"__{i}") for i, c in enumerate(given)], F.col(label).cast("double").alias(LABEL), *kept)
    lists = [f"__{i}" for i, k in enumerate(kinds) if k == "vector" or k.startswith("array")]
    one = rows.select(*lists).first() if lists else ()
    width = len(given) - len(lists) + sum(map(len, one or ()))
    most, parts, names = max(1, min(BLOCK_ROWS, BLOCK_BYTES // max(1, 8 * width))), len(given), list(kept)

    def block(number: int, table: pa.Table) -> pa.RecordBatch:
        batch = table.combine_chunks().to_batches()[0]
        x = [_columns(batch.column(i)) for i in range(parts)]
        y = batch.column(parts).to_numpy(zero_copy_only=False)
        if np.isnan(y).any() or not all(np.isfinite(part).all() for part in x):
            raise ValueError("labels and features must be numbers, features finite ones")
        columns = []
        for values in (part[:, i] for part in x for i in range(part.shape[1])):
            distinct, code = np.unique(values + 0.0, return_inverse=True)
            columns.append(pa.DictionaryArray.from_arrays(code.astype(np.uint8 if len(distinct) <= 256 else np.uint16), distinct))
        inner = pa.RecordBatch.from_arrays([*columns, pa.array(y), *batch.columns[parts + 1:]], names=[*map(str, range(len(columns))), LABEL, *names])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, inner.schema) as stream:
            stream.write_batch(inner)
        return pa.RecordBatch.from_pydict({"block": [number], "data": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            while n >= most:
                table = pa.Table.from_batches(held)
                yield block(number, table[:most])
                number, held, n = number + 1, table[most:].to_batches(), n - most
        if n:
            yield block(number, pa.Table.from_batches(held))

    return Packed(stored(rows.mapInArrow(blocks, "block bigint, data binary")), width, df.select(*kept).schema)


def thinned(values: np.ndarray, weights: np.ndarray, most: int = POINTS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and their weights, at most about ``most`` of them: each stands for those after the one before."""
    order = np.argsort(values, kind="stable")
    values, weights = values[order], weights[order]
    last = np.flatnonzero(np.append(values[1:] != values[:-1], True)) if len(values) else np.zeros(0, dtype=np.int64)
    values, upto = values[last], np.cumsum(weights)[last]
    if len(values) > most:
        step = upto[-1] / most
        kept = np.flatnonzero(np.append(np.floor(upto[1:] / step) != np.floor(upto[:-1] / step), True))
        kept = np.union1d(kept, [0])  # the least value stays
        values, upto = values[kept], upto[kept]
    return values, np.diff(upto, prepend=0.0)


def split_points(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Spark's points between values: all of them where they are few, else those next to equal shares of the rows."""
    if len(values) <= BINS:
        return (values[1:] + values[:-1]) / 2
    out, stride, upto = [], weights.sum() / BINS, np.cumsum(weights)
    target = stride
    for i in range(1, len(values)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            out.append((values[i - 1] + values[i]) / 2)
            target += stride
    return np.array(out[:BINS - 1])


def fit_split_points(rows: Packed, places: Sequence[int], chosen: Chosen | None) -> list[np.ndarray]:
    """Split points of the features at some places, from all chosen rows."""
    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in places]
        for batch in batches:
            for data in batch.column(1):
                block = pa.ipc.open_stream(data.as_buffer()).read_next_batch()
                mask = None if chosen is None else chosen(block)
                for of, f in zip(held, places):
                    code, values = block.column(f).indices.to_numpy(), block.column(f).dictionary.to_numpy()
                    counts = np.bincount(code if mask is None else code[mask], minlength=len(values))
                    of.append(thinned(values[counts > 0], counts[counts > 0].astype(float)))
                    if len(of) > 32:
                        of[:] = [thinned(*map(np.concatenate, zip(*of)))]
        if held and held[0]:
            found = [thinned(*map(np.concatenate, zip(*of))) for of in held]
            yield pa.RecordBatch.from_pydict({"feature": pa.array(range(len(places)), pa.int32()), "values": [v.tobytes() for v, _ in found], "weights": [w.tobytes() for _, w in found]})

    def merged(table: pa.Table) -> pa.Table:
        parts = sorted(zip(table["values"].to_pylist(), table["weights"].to_pylist()))
        values, weights = (np.concatenate([np.frombuffer(b) for b in side]) for side in zip(*parts))
        points = split_points(*thinned(values, weights, 4 * POINTS))
        return pa.table({"feature": table["feature"][:1], "points": pa.array([points.tolist()], pa.list_(pa.float64()))})

    per_task = in_tasks(rows.blocks).mapInArrow(summaries, "feature int, values binary, weights binary")
    found = per_task.groupBy("feature").applyInArrow(merged, "feature int, points array<double>").collect()
    points = {r["feature"]: np.array(r["points"], dtype=np.float64) for r in found}
    return [points.get(f, np.zeros(0)) for f in range(len(places))]


def in_tasks(blocks: DataFrame) -> DataFrame:
    """Blocks in as many partitions as a pass has tasks; a task reads its blocks one by one."""
    return blocks.coalesce(TASKS * blocks.sparkSession.sparkContext.defaultParallelism)


def bins_of(block: pa.RecordBatch, places: Sequence[int], points: Sequence[np.ndarray], mask: np.ndarray | None) -> np.ndarray:
    """A line of bytes per feature: the bins of the rows."""
    codes = (block.column(f).indices.to_numpy() for f in places)
    return np.stack([np.searchsorted(p, block.column(f).dictionary.to_numpy()).astype(np.uint8)[code if mask is None else code[mask]]
                     for f, p, code in zip(places, points, codes)])


def binned(rows: Packed, places: Sequence[int], points: Sequence[np.ndarray], chosen: Chosen | None) -> DataFrame:
    """The chosen rows in stored blocks of bytes."""
    def bins(number: int, block: pa.RecordBatch) -> pa.RecordBatch:
        mask = None if chosen is None else chosen(block)
        y = block.column(LABEL).to_numpy()
        return pa.RecordBatch.from_pydict({"block": [number], "bins": [bins_of(block, places, points, mask).tobytes()],
                                           "label": [(y if mask is None else y[mask]).tobytes()], "margin": pa.array([None], pa.binary())})

    return stored(rows.map(bins, BINNED))


def opened(batch: pa.RecordBatch, i: int, width: int, trees: Sequence[Tree], rates: Sequence[float]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray | None]:
    """Number, bins, labels and prediction so far of a block; none before the first tree."""
    number, bins, label, margin = (batch.column(c)[i] for c in range(4))
    bins = np.frombuffer(bins.as_buffer(), dtype=np.uint8).reshape(width, -1)
    y, so_far = np.frombuffer(label.as_buffer()), np.frombuffer(margin.as_buffer()) if margin.is_valid else None
    for tree, rate in zip(trees, rates):
        step = rate * np.array(tree.values)[tree.placed(bins)]
        so_far = step if so_far is None else so_far + step
    return number.as_py(), bins, y, so_far


def level_sums(blocks: DataFrame, sizes: Sequence[int], trees: Sequence[Tree], rates: Sequence[float], splits: Splits,
               nodes: Sequence[int], size: int, share: float, seed: tuple[int, ...]) -> np.ndarray:
    """(3, nodes, bins of all features): rows, and sum and sum of squares of what is left to explain."""
    starts, total = np.cumsum([0, *sizes]), int(sum(sizes))
    slot = np.full(size, len(nodes), dtype=np.int64)
    slot[list(nodes)] = np.arange(len(nodes))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, seen = np.zeros((3, len(nodes), total)), False
        for batch in batches:
            for i in range(batch.num_rows):
                seen = True
                number, bins, y, so_far = opened(batch, i, len(sizes), trees, rates)
                left = y if so_far is None else 2.0 * (y - so_far)
                at = slot[placed(splits, size, bins)]
                if share < 1.0:
                    at[np.random.default_rng([*seed, number >> 32, number & 0xFFFFFFFF]).random(len(y), dtype=np.float32) >= share] = len(nodes)
                squares, place = left * left, np.empty_like(at)
                for f, n in enumerate(sizes):
                    np.multiply(at, n, out=place)
                    np.add(place, bins[f], out=place)
                    for k, weights in enumerate((None, left, squares)):
                        found = np.bincount(place, weights, minlength=n * (len(nodes) + 1))[:n * len(nodes)]
                        out[k, :, starts[f]:starts[f + 1]] += found.reshape(len(nodes), n)
        if seen:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "sums": [out.tobytes()]})

    def added(table: pa.Table) -> pa.Table:
        ordered = sorted(zip(table["part"].to_pylist(), table["sums"].to_pylist()))
        return pa.table({"part": pa.array([ordered[0][0]], pa.int32()), "sums": [np.sum([np.frombuffer(b) for _, b in ordered], axis=0).tobytes()]})

    tasks = TASKS * blocks.sparkSession.sparkContext.defaultParallelism
    found = in_tasks(blocks).mapInArrow(sums, SUMS)
    if tasks * 24 * len(nodes) * total > COLLECTED:
        found = found.groupBy(F.pmod("part", F.lit(math.isqrt(tasks)))).applyInArrow(added, SUMS)
    parts = sorted((r["part"], r["sums"]) for r in found.collect())
    return sum((np.frombuffer(b).reshape(3, len(nodes), total) for _, b in parts), np.zeros((3, len(nodes), total)))


def best_split(node: Node, sums: np.ndarray, sizes: Sequence[int], least: int) -> tuple[float, int, int, np.ndarray] | None:
    """(gain, feature, bin, statistics of the left side) of the split that gains most; the first of equals."""
    best, start = None, 0
    for f, n in enumerate(sizes):
        left = np.cumsum(sums[:, start:start + n], axis=1)[:, :-1]
        right, start = node.stats[:, None] - left, start + n
        fits = (left[0] >= max(1, least)) & (right[0] >= max(1, least))
        if not fits.any():
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            within = sum(np.where(fits, side[2] - side[1] * side[1] / side[0], np.inf) for side in (left, right))
        at = int(np.argmin(within))
        gain = node.impurity - float(within[at] / node.stats[0])
        if gain > 0 and (best is None or gain > best[0]):
            best = (gain, f, at, left[:, at])
    return best


def grown(blocks: DataFrame, sizes: Sequence[int], trees: Sequence[Tree], rates: Sequence[float], depth: int, least: int,
          share: float, seed: tuple[int, ...]) -> Tree:
    """One tree on what the trees so far leave to explain."""
    tree, open_nodes, size = None, [Node(0, np.zeros(3))], 1
    for level in range(max(1, depth)):
        sums = level_sums(blocks, sizes, trees, rates, tree.splits if tree else [], [n.at for n in open_nodes], size, share, seed)
        if tree is None:
            open_nodes[0].stats = sums[:, 0, :sizes[0]].sum(axis=1)
            tree = Tree(open_nodes[0])
            if not open_nodes[0].stats[0]:
                raise ValueError("no rows to fit")
        following = []
        for i, node in enumerate(open_nodes):
            if level >= depth or (level and abs(node.impurity) < PURE) or (found := best_split(node, sums[:, i], sizes, least)) is None:
                continue
            node.gain, node.feature, node.bin, left = found
            node.children = (Node(node.at, left), Node(size, node.stats - left))
            tree.splits.append((node.at, node.feature, node.bin, size))
            following += node.children
            size += 1
        open_nodes = following
        if not open_nodes:
            break
    tree.values = [0.0] * size
    leaves = [tree.root]
    while leaves:
        node = leaves.pop()
        if node.children:
            leaves += node.children
        else:
            tree.values[node.at] = node.mean
    return tree


def with_margins(blocks: DataFrame, width: int, trees: Sequence[Tree], rates: Sequence[float]) -> DataFrame:
    """Blocks stored again with the predictions so far."""
    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = [opened(batch, i, width, trees, rates)[3].tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(margins, pa.binary())], names=batch.schema.names)

    return stored(blocks.mapInArrow(written, BINNED))


def spark_model(spark: SparkSession, estimator: GBTRegressor, trees: Sequence[Tree], rates: Sequence[float], points: Sequence[np.ndarray]) -> GBTRegressionModel:
    """Spark's model of the trees."""
    gateway, jvm, width = spark.sparkContext._gateway, spark.sparkContext._jvm, len(points)

    def array(kind, values):
        out = gateway.new_array(kind, len(values))
        for i, v in enumerate(values):
            out[i] = v
        return out

    def node(n: Node):
        stats = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator(array(jvm.double, [float(v) for v in n.stats]), int(n.stats[0]))
        if n.children is None:
            return jvm.org.apache.spark.ml.tree.LeafNode(n.mean, n.impurity, stats)
        split = jvm.org.apache.spark.ml.tree.ContinuousSplit(n.feature, float(points[n.feature][n.bin]))
        return jvm.org.apache.spark.ml.tree.InternalNode(n.mean, n.impurity, n.gain, node(n.children[0]), node(n.children[1]), split, stats)

    regression = jvm.org.apache.spark.ml.regression
    made = [regression.DecisionTreeRegressionModel(f"dtr_{uuid.uuid4().hex[:12]}", node(t.root), width) for t in trees]
    model = regression.GBTRegressionModel(estimator.uid, array(regression.DecisionTreeRegressionModel, made), array(jvm.double, [float(r) for r in rates]), width)
    return estimator._copyValues(estimator._create_model(model))


@dataclass(frozen=True)
class Boosted:
    """A fit: Spark's model, and the same trees for rows in blocks."""

    model: GBTRegressionModel
    trees: list[Tree]
    rates: list[float]
    places: list[int]
    points: list[np.ndarray]

    def predicted(self, rows: Packed, label: str, chosen: Chosen | None = None, name: str = "log_prediction") -> DataFrame:
        """The kept columns, label and prediction of the chosen rows."""
        trees, rates, places, points, kept = [(t.splits, t.values) for t in self.trees], self.rates, self.places, self.points, rows.kept.names

        def predict(_, block: pa.RecordBatch) -> pa.RecordBatch | None:
            mask = None if chosen is None else chosen(block)
            if mask is not None and not mask.any():
                return None
            bins = bins_of(block, places, points, mask)
            out = np.zeros(bins.shape[1])
            for (splits, values), rate in zip(trees, rates):
                out += rate * np.array(values)[placed(splits, len(values), bins)]
            some = block.select([*kept, LABEL])
            some = some if mask is None else some.filter(pa.array(mask))
            return pa.RecordBatch.from_arrays([*some.columns, pa.array(out)], names=[*kept, label, name])

        return rows.map(predict, T.StructType([*rows.kept.fields, T.StructField(label, T.DoubleType()), T.StructField(name, T.DoubleType())]))


def fit_trees(rows: Packed, estimator: GBTRegressor, chosen: Chosen | None = None, places: Sequence[int] | None = None) -> Boosted:
    """``estimator`` fitted to the chosen rows and the features at some places; all of them if nothing is said."""
    places = list(range(rows.width) if places is None else places)
    if not places:
        raise ValueError("no rows to fit, or no features")
    points = fit_split_points(rows, places, chosen)
    sizes, blocks = [len(p) + 1 for p in points], binned(rows, places, points, chosen)
    trees, rates, written = [], [], 0
    for i in range(estimator.getMaxIter()):
        if i - written == HELD_TREES:
            blocks, written = with_margins(blocks, len(points), trees[written:], rates[written:]), i
        trees.append(grown(blocks, sizes, trees[written:], rates[written:], estimator.getMaxDepth(), estimator.getMinInstancesPerNode(),
                           estimator.getSubsamplingRate(), (estimator.getSeed() & 0xFFFFFFFF, i)))
        rates.append(estimator.getStepSize() if i else 1.0)
    return Boosted(spark_model(blocks.sparkSession, estimator, trees, rates, points), trees, rates, places, points)
