"""Approximate nearest neighbours by largest inner product: inverted lists with an adaptive dimension scan.

Vectors are scaled by M, the largest norm of the sample, and get one more part, the square root of
1 - |x|^2; queries get length one and a zero: Euclidean order is then inner-product order. Rows longer than M
go to a list of their own that every query visits. Lists are about ``LIST_ROWS`` rows: their number follows the table,
by centroids of the sample and, beyond ``COARSE`` of them, a second level of centroids of what the first
leaves over. Everything fitted comes from a bounded sample; every row is indexed. How many lists
a query visits is its own: those that hold ``WANTED`` of its nearest sample vectors.

Within a probed list vectors are scanned in blocks of columns after a random rotation. After each block a
test abandons candidates: the partial distance of a vector within the radius is above the test's share of
the radius in ``ERROR`` of all cases, as measured on the sample. While many candidates are left, a block is one matrix
product; once few are, only these are read on. Survivors are scored on the original vectors, in double precision.

A query that ends with fewer than k rows is scanned again over all lists without a radius.

The query set is stated by the caller and meets the rows in blocks: lists are cut into blocks of
``ROWS`` candidates and ``QUERIES`` queries, so no task holds a whole list. A query's radius is its
2k-th best distance in the sample, above the true k-th one, so each block returns few rows.

Null, zero and non-finite vectors, lengths other than the commonest, and rows without an id take no part. An id
that several rows share asks once, with the least of its vectors; as candidates such rows count each, but not for
their own id. Ties go to the smaller id. Parts of any finite size are allowed; an inner product past the
largest double is infinite. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from gridstats.llm.common import bounded_sample, small_side, table
from gridstats.llm.vectors import comparable, matrix
from gridstats.session import cut_lineage

K, SAMPLE, ROWS, QUERIES = 20, 20_000, 8192, 2048
#: Rows of a list, about; centroids of either level at most.
LIST_ROWS, COARSE, FINE = 1024, 1024, 256
#: Columns per step of the scan, the error of a test, the share left from which on candidates are read one by one.
COLUMNS, ERROR, SPARSE = 16, 0.003, 0.05
#: Share of a query's nearest sample vectors that the probed lists must hold; queries tried for the tests.
WANTED, TRIED = 0.98, 400
#: Distances held at once.
CELLS = 4 << 20


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T


def norms(x: np.ndarray) -> np.ndarray:
    """Lengths, without overflow where the length itself is finite."""
    top = np.abs(x).max(axis=1, initial=0)
    return top * np.linalg.norm(x / np.where(top > 0, top, 1)[:, None], axis=1)


def cluster(rows: np.ndarray, lists: int, rng, rounds: int = 12) -> np.ndarray:
    centres = rows[rng.permutation(len(rows))[:lists]].copy()
    for _ in range(rounds):
        near = nearest_of(rows, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        n = np.bincount(near, minlength=len(centres))[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


def nearest_of(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    step = max(1, CELLS // len(centres))
    return np.concatenate([np.zeros(0, dtype=np.int64), *[distances(rows[lo:lo + step], centres).argmin(axis=1) for lo in range(0, len(rows), step)]])


class Index:
    """What tasks need of the fitted index; its size depends on the sample, not on the table."""

    def __init__(self, sample: np.ndarray, count: int, k: int = K, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.k, self.norm = k, float(norms(sample).max())
        self.sample = self.widen(sample)
        width = self.sample.shape[1]
        self.rotation = np.linalg.qr(rng.standard_normal((width, width)))[0]
        lists = max(1, count // LIST_ROWS)
        self.coarse = cluster(self.sample, min(lists, COARSE, max(1, len(sample) // 16)), rng)
        self.home = nearest_of(self.sample, self.coarse)
        fine = min(FINE, -(-lists // len(self.coarse)))
        self.fine = cluster(self.sample - self.coarse[self.home], fine, rng) if fine > 1 else np.zeros((1, width))
        self.steps = [*range(COLUMNS, width, COLUMNS), width]
        self.shares = self.calibrate(sample[rng.permutation(len(sample))[:TRIED]])

    @property
    def lists(self) -> int:
        return len(self.coarse) * len(self.fine)

    def widen(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = x / self.norm
            return np.hstack([x, np.sqrt(np.maximum(0.0, 1 - (x * x).sum(axis=1)))[:, None]])

    @staticmethod
    def unit(q: np.ndarray) -> np.ndarray:
        top = np.abs(q).max(axis=1, initial=0)[:, None]
        q = q / top
        return np.hstack([q / np.linalg.norm(q, axis=1)[:, None], np.zeros((len(q), 1))])

    def calibrate(self, tried: np.ndarray) -> list[float]:
        """Per step, the share of the distance that a neighbour's partial distance stays below but for ``ERROR``."""
        asked = self.unit(tried)
        near = np.argpartition(distances(asked, self.sample), min(self.k, len(self.sample) - 1), axis=1)[:, :self.k + 1]
        gaps = ((asked @ self.rotation)[:, None, :] - (self.sample @ self.rotation)[near]) ** 2
        whole = np.maximum(gaps.sum(axis=2), 1e-300)
        return [float(np.quantile(gaps[:, :, :hi].sum(axis=2) / whole, 1 - ERROR)) for hi in self.steps[:-1]]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """List of each row; -1 for rows longer than the sample's."""
        wide = self.widen(x)
        long = ~(norms(x) <= self.norm * (1 + 1e-9))
        wide[long] = 0
        home = nearest_of(wide, self.coarse)
        out = home * len(self.fine) + (nearest_of(wide - self.coarse[home], self.fine) if len(self.fine) > 1 else 0)
        out[long] = -1
        return out

    def ask(self, q: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Lists to probe and the radius (squared) of each query."""
        lists, radii, reach = [], [], min(2 * self.k, len(self.sample)) - 1
        step = max(1, CELLS // len(self.sample))
        for lo in range(0, len(q), step):
            asked = self.unit(q[lo:lo + step])
            away = distances(asked, self.sample)
            near = np.argpartition(away, reach, axis=1)[:, :reach + 1]
            # Twice k, so that abandoned true neighbours leave enough others.
            radii.append(np.take_along_axis(away, near, axis=1).max(axis=1) * (1 + 1e-9) + 1e-9)
            order = np.argsort(distances(asked, self.coarse), axis=1)
            place = np.argsort(order, axis=1)
            ranks = np.sort(np.take_along_axis(place, self.home[near], axis=1), axis=1)
            probes = ranks[:, min(reach, int(np.ceil(WANTED * (reach + 1))) - 1)] + 1
            for one, mine, n in zip(asked, order, probes):
                lists.append(self.inner(one, mine[:n]))
        return lists, np.concatenate(radii) if len(self.sample) > self.k else np.full(len(q), np.inf)

    def inner(self, q: np.ndarray, homes: np.ndarray) -> np.ndarray:
        """Lists of the second level within ``homes``: those nearer than the farthest first-level list probed."""
        every = (homes[:, None] * len(self.fine) + np.arange(len(self.fine))).ravel()
        if len(self.fine) == 1:
            return every
        centres = (self.coarse[homes][:, None, :] + self.fine).reshape(-1, len(q))
        away = ((centres - q) ** 2).sum(axis=1)
        limit = ((self.coarse[homes] - q) ** 2).sum(axis=1).max()
        return every[(away <= limit) | (away <= np.partition(away, min(len(away), len(homes)) - 1)[min(len(away), len(homes)) - 1])]

    def scan(self, q: np.ndarray, radius: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, candidate) that no step of the scan abandons."""
        if np.isinf(radius).all():
            return tuple(i.ravel() for i in np.indices((len(q), len(x))))
        a, b = self.unit(q) @ self.rotation, self.widen(x) @ self.rotation
        partial, low, asked = np.zeros((len(a), len(b))), 0, None
        for hi, share in zip(self.steps, [*self.shares, 1.0]):
            if asked is None:
                # Abandoned candidates are not looked at again, but one product over all is cheaper than a choice.
                partial += distances(a[:, low:hi], b[:, low:hi])
                stay = partial <= (radius * share)[:, None]
                partial[~stay] = np.inf
                if hi == self.steps[-1] or np.count_nonzero(stay) <= SPARSE * stay.size:
                    asked, held = np.nonzero(stay)
                    partial = partial[asked, held]
            else:
                step = a[asked, low:hi] - b[held, low:hi]
                partial = partial + np.einsum("ij,ij->i", step, step)
                stay = partial <= (radius * share)[asked]
                asked, held, partial = asked[stay], held[stay], partial[stay]
            low = hi
        return asked, held


def best(asked: np.ndarray, key: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Rows of each query's k best: highest score, then smallest id."""
    order = np.lexsort((key, -score, asked))
    first = np.searchsorted(asked[order], asked[order], side="left")
    return order[np.arange(len(order)) - first < k]


def search(rows: DataFrame, key: str, vector: str, is_query: Column, k: int = K) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k rows found with the largest inner product."""
    held = cut_lineage(comparable(rows.where(F.col(key).isNotNull()), key, vector))
    count = held.count()
    sample = matrix(bounded_sample(held, F.xxhash64("key", "v"), SAMPLE).toPandas()["v"])
    if not len(sample):
        return held.select(F.col("key").alias("query_id"), F.lit(0).alias("rank"), F.col("key").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    index = held.sparkSession.sparkContext.broadcast(Index(sample, count, k))

    def listed(batches):
        for batch in batches:
            if len(batch):
                batch["list"] = index.value.assign(matrix(batch["v"]))
                yield batch

    def probing(batches):
        for batch in batches:
            if len(batch):
                lists, batch["radius"] = index.value.ask(matrix(batch["v"]))
                batch["list"] = [np.append(x, -1) for x in lists]
                yield batch

    fields = "key long, v array<double>"
    candidates = cut_lineage(held.mapInPandas(listed, f"{fields}, list long"))
    queries = cut_lineage(held.where(is_query).groupBy("key").agg(F.min("v").alias("v")))
    sizes = candidates.groupBy("list").agg(F.count("*").alias("rows"))

    def scan(cell: pd.DataFrame) -> pd.DataFrame:
        asking = cell["radius"].notna().to_numpy()
        q, c = cell[asking], cell[~asking].sort_values("key")
        out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})]
        if len(q) and len(c):
            qv, cv, qk, ck = matrix(q["v"]), matrix(c["v"]), q["key"].to_numpy(), c["key"].to_numpy()
            # Rows beyond the sample's norm are scored without tests.
            radius = q["radius"].to_numpy() if q["list"].iloc[0] >= 0 else np.full(len(q), np.inf)
            for lo in range(0, len(q), 128):
                who, what = index.value.scan(qv[lo:lo + 128], radius[lo:lo + 128], cv)
                other = qk[lo + who] != ck[what]
                who, what = who[other], what[other]
                score = np.concatenate([(qv[lo + who[i:i + 65536]] * cv[what[i:i + 65536]]).sum(axis=1) for i in range(0, max(1, len(who)), 65536)])
                keep = best(who, ck[what], score, k)
                out.append(pd.DataFrame({"query_id": qk[lo + who[keep]], "vec_id": ck[what[keep]], "score": score[keep]}))
        return pd.concat(out)

    def scanned(asked: DataFrame) -> DataFrame:
        wants = asked.groupBy("list").agg(F.count("*").alias("asking"))
        cells = small_side(sizes.join(wants, "list").select(
            "list", F.ceil(F.col("rows") / ROWS).alias("blocks"), F.ceil(F.col("asking") / QUERIES).alias("turns")))
        mine = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
        met = candidates.join(cells, "list").select("list", mine("blocks").alias("block"), every("turns").alias("turn"), "key", "v", F.lit(None).cast("double").alias("radius"))
        met = met.unionByName(asked.join(cells, "list").select("list", every("blocks").alias("block"), mine("turns").alias("turn"), "key", "v", "radius"))
        found = met.groupBy("list", "block", "turn").applyInPandas(scan, "query_id long, vec_id long, score double")
        order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return cut_lineage(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))

    asked = queries.mapInPandas(probing, f"{fields}, list array<long>, radius double")
    found = scanned(cut_lineage(asked.select("key", "v", "radius", F.explode("list").alias("list"))))
    full = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= min(k, count - 1)).select(F.col("query_id").alias("key"))
    short = cut_lineage(queries.join(full, "key", "left_anti"))
    if short.take(1):
        everywhere = short.select("key", "v", F.lit(float("inf")).alias("radius"), F.explode(F.sequence(F.lit(-1).cast("long"), F.lit(index.value.lists - 1).cast("long"))).alias("list"))
        found = found.join(full, F.col("query_id") == F.col("key"), "left_semi").unionByName(scanned(cut_lineage(everywhere)))
    return found


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``embeddings``; queries are the rows whose id is divisible by 20."""
    return search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("key") % 20 == 0)
