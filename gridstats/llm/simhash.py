"""SimHash near-duplicates by BK-trees over shards of fingerprints.

A document's fingerprint is the bitwise majority of the hashes of its word shingles. Equal
fingerprints collapse first; the distinct ones are dealt to shards so that any two within the radius
meet: the 64 bits are cut into four bands, at most two of which can differ, so each fingerprint goes
to six shards, keyed by two bands each. Every shard is searched by a BK-tree, whose children hang at
their Hamming distance from the parent; a search follows only edges within the radius of the
distance. A shard of more than ``TREE`` fingerprints becomes several trees, and every fingerprint of
it visits each of them. Links inside a shard come out as edges to one fingerprint per cluster, and
components follow by star contraction over the edges.

Shard trees travel through the shuffle, not a broadcast: together they grow with the corpus.

Null text counts as empty; texts without words have fingerprint zero and link like any other.
Repeated rows and equal texts share a fingerprint. Rows without an id have a fingerprint and the component of
their fingerprint, but are no component's smallest id; where no row of it has an id, it is null. An empty table gives no rows. Extra columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridstats.llm.common import connected_components, table
from gridstats.session import cut_lineage

SHINGLE, SEED, RADIUS, BANDS = 3, 42, 2, 4
TREE = 2048


def fingerprint(words: list[bytes], size: int = SHINGLE, seed: int = SEED) -> int:
    """Signed 64-bit majority fingerprint of a word sequence."""
    from xxhash import xxh64_intdigest

    if not words:
        return 0
    parts = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else iter([b" ".join(words)])
    hashes = np.fromiter((xxh64_intdigest(p, seed) for p in parts), dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: str | None = None) -> DataFrame:
    """``key`` and ``print``, and the string column ``carry`` if named, materialised."""

    def run(batches):
        for batch in batches:
            # bytes.lower and bytes.split know A-Z and the six ASCII white spaces only.
            prints = [fingerprint((t or "").encode().lower().split()) for t in batch.column("text").to_pylist()]
            # Keys stay in Arrow: pandas would round large ones next to a null.
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("key", *more)] + [pa.array(prints, pa.int64())], names=["key", *more, "print"])

    kind = docs.schema[key].dataType.simpleString()
    more = [carry] if carry else []
    held = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), *more)
    return cut_lineage(held.mapInArrow(run, ", ".join([f"key {kind}", *[f"{c} string" for c in more], "print long"])))


class BKTree:
    """Fingerprints by Hamming distance to their parent."""

    def __init__(self):
        self.root, self.children = None, {}

    def insert(self, value: int) -> None:
        if self.root is None:
            self.root, self.children[value] = value, {}
            return
        node = self.root
        while True:
            far = (node ^ value).bit_count()
            if far == 0:
                return
            below = self.children[node].get(far)
            if below is None:
                self.children[node][far] = value
                self.children[value] = {}
                return
            node = below

    def within(self, value: int, radius: int) -> list[int]:
        found, open_nodes = [], [] if self.root is None else [self.root]
        while open_nodes:
            node = open_nodes.pop()
            far = (node ^ value).bit_count()
            if far <= radius:
                found.append(node)
            low, high = far - radius, far + radius
            open_nodes += [c for d, c in self.children[node].items() if low <= d <= high]
        return found


class Clusters:
    """Union-find within one shard."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def root(self, x: int) -> int:
        path = []
        while (up := self.above.get(x, x)) != x:
            path.append(x)
            x = up
        for p in path:
            self.above[p] = x
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.above[max(a, b)] = min(a, b)


def shard_keys(value: Column) -> Column:
    """One key per pair of bands: the pair's number and the bits of both bands."""
    width = 64 // BANDS
    band = [F.shiftrightunsigned(value, i * width).bitwiseAND(F.lit((1 << width) - 1)) for i in range(BANDS)]
    pairs = [(i, j) for i in range(BANDS) for j in range(i)]
    return F.array(*[F.lit(n << 32) + band[i] * (1 << width) + band[j] for n, (i, j) in enumerate(pairs)])


def shard_links(members, radius: int):
    """Edges (id, id) that connect the clusters of one cell; members are (print, id, part) with part 0
    in the tree and searched, 1 only searching."""
    mask, tree, clusters, ids = (1 << 64) - 1, BKTree(), Clusters(), {}
    for value, owner, part in members:
        value &= mask
        ids[value] = owner
        for other in tree.within(value, radius):
            clusters.join(value, other)
        if part == 0:
            tree.insert(value)
    return [(ids[v], ids[clusters.root(v)]) for v in ids if clusters.root(v) != v]


def links(distinct: DataFrame, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """Edges (``a``, ``b``) between ids of fingerprints (``print``, ``id``) that connect all within the radius."""
    keyed = distinct.select("print", "id", F.explode(shard_keys(F.col("print"))).alias("shard"))
    sizes = keyed.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    shared = keyed.join(sizes, "shard").withColumn("parts", F.ceil(F.col("n") / tree).cast("int"))
    mine = F.pmod(F.xxhash64("print"), F.col("parts")).cast("int")
    # Cell (i, j), i <= j: tree of part i, searched by itself if i = j, by part j otherwise.
    cells = shared.withColumn("mine", mine).select(
        "print", "id", "shard", "mine", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    cells = cells.select("print", "id", "shard", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
                         (F.col("mine") > F.col("other")).cast("int").alias("part"))

    def run(batches):
        cell, members = None, []
        for batch in batches:
            for shard, i, j, part, value, owner in zip(*(batch[c].tolist() for c in ("shard", "i", "j", "part", "print", "id"))):
                if (shard, i, j) != cell:
                    if len(members) > 1:
                        yield from shard_links(members, radius)
                    cell, members = (shard, i, j), []
                members.append((value, owner, part))
        if len(members) > 1:
            yield from shard_links(members, radius)

    def framed(batches):
        out = []
        for edge in run(batches):
            out.append(edge)
            if len(out) == 50_000:
                yield pd.DataFrame(out, columns=["a", "b"])
                out = []
        yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    sorted_cells = cells.repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j", "part")
    return sorted_cells.mapInPandas(framed, "a long, b long")


def components(prints: DataFrame) -> DataFrame:
    """The columns of ``prints`` and ``component`` of every row."""
    # Fingerprints stand for themselves in links: those of rows without an id link too.
    distinct = cut_lineage(prints.groupBy("print").agg(F.min("key").alias("least")))
    roots = connected_components(links(distinct.select("print", F.col("print").alias("id"))))
    groups = cut_lineage(distinct.join(roots, F.col("print") == F.col("node"), "left").select("print", F.coalesce("root", "print").alias("root"), "least"))
    named = groups.groupBy("root").agg(F.min("least").alias("component"))
    return prints.join(groups.join(named, "root").select("print", "component"), "print").select(*prints.columns, "component")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: str | None = None) -> DataFrame:
    return components(fingerprints(docs, key, text, carry))


def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
