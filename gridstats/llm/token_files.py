"""Token-id files with keyed access through a minimal perfect hash.

Writing: documents are sorted by key into ranges; each task encodes its range and writes shard files:
a header, the offsets of the documents and their raw ids, little-endian, in two bytes where the
vocabulary allows and four elsewhere. The index maps the hash of a key to the places of its documents:
keys are dealt to index files by hash, and each file holds a minimal perfect hash (levels of bits; a key
owns the bit that no other key of its level hits, and the rank of this bit is its slot), a fingerprint
per slot and the runs (shard, first document, number of documents) of the key. A key takes two hashes
and a few bit tests whatever the number of documents. Files get fresh names; only those named in the
tables ``shards`` and ``parts``, written last, count, so a task that is run again does no harm.

Reading: keys find their index file by hash, their runs by slot and fingerprint, and their ids by the
offsets of the shard. Shards and index files are of bounded size, but for a single longer document.

Null keys are a key of their own and come first. Equal keys are several documents of one key, in the
order of their texts' hashes. Null text counts as empty: the end id alone. Keys that were not written
return no row, but for a false fingerprint match of one in 2^32. An empty table gives no rows.
Columns other than key and text are not read.
"""

from __future__ import annotations

import io
import math
import re
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridstats.llm.common import table
from gridstats.llm.tokens import PLAIN, Words
from gridstats.operators.ranges import totals_before
from gridstats.session import checkpoint_dir, cut_lineage

END = 2
#: Bytes of text a task encodes, ids in a shard, keys in an index file: all about.
TASK_BYTES, SHARD_IDS, PART_KEYS = 16 << 20, 4 << 20, 50_000
#: Pieces of the byte-level vocabulary's splitter, for texts of common Latin characters.
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+|\s+(?!\S)|\s+")
MAGIC = b"IDSHARD1"


class ByteWords(Words):
    """Ids by piece; every byte has a printable stand-in here, spaces too."""

    def __missing__(self, word: str) -> bytes:
        symbols = word.encode().decode("latin-1").translate(self.letters)
        ids = array("I", [t.id for t in self.encode(symbols)]).tobytes()
        if len(self) < 200_000:
            self[word] = ids
        return ids


class ByteEncoder:
    """Ids of a text followed by the end id, as bytes of 32-bit numbers."""

    def __init__(self, path: str, end: int = END):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.end = ByteWords(self.tokenizer), end.to_bytes(4, "little")
        self.item = 2 if max(self.tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else 4

    def __call__(self, text: str) -> bytes:
        if PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.words.__getitem__, PIECE.findall(text))) + self.end
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes() + self.end


def save(folder: str, name: str, *parts: bytes) -> None:
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/{name}") as out:
        for part in parts:
            out.write(part)


def shard_bytes(documents: list[bytes], item: int) -> list[bytes]:
    offsets = np.zeros(len(documents) + 1, dtype="<u8")
    np.cumsum([len(d) // 4 for d in documents], out=offsets[1:])
    ids = np.frombuffer(b"".join(documents), dtype="<u4").astype(f"<u{item}")
    return [MAGIC, np.array([item, len(documents)], dtype="<u8").tobytes(), offsets.tobytes(), ids.tobytes()]


def read_runs(folder: str, name: str, firsts: np.ndarray, copies: np.ndarray):
    """Per run, its documents as (first id's place in the shard, 32-bit ids)."""
    system, path = fs.FileSystem.from_uri(folder)
    with system.open_input_file(f"{path}/{name}") as file:
        head = file.read(24)
        if head[:8] != MAGIC:
            raise ValueError(f"{name} is no shard of token ids")
        item, count = np.frombuffer(head[8:], dtype="<u8").tolist()
        offsets = np.frombuffer(file.read(8 * (count + 1)), dtype="<u8").astype(np.int64)
        for first, n in zip(firsts.tolist(), copies.tolist()):
            file.seek(24 + 8 * (count + 1) + item * int(offsets[first]))
            ids = np.frombuffer(file.read(item * int(offsets[first + n] - offsets[first])), dtype=f"<u{item}").astype("<u4")
            at = offsets[first:first + n + 1]
            yield [(int(a), ids[a - at[0]:b - at[0]]) for a, b in zip(at[:-1], at[1:])]


def mixed(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    """Hash of a key's two hashes for one level."""
    with np.errstate(over="ignore"):
        x = a + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9) ^ b
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct pairs of 64-bit hashes."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        sizes, words = [], []
        while len(a):
            size = 64 * (2 * len(a) // 64 + 1)
            at = (mixed(a, b, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            rest = ~alone[at]
            a, b = a[rest], b[rest]
        return cls(np.array(sizes, dtype="<u8"), np.concatenate(words) if words else np.zeros(0, dtype="<u8"))

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 for some of the keys that were not built in."""
        out, left, start = np.full(len(a), -1, dtype=np.int64), np.arange(len(a)), 0
        for level, size in enumerate(self.sizes):
            at = start + (mixed(a[left], b[left], level) % size).astype(np.int64)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[hit]] = (self.before[word] + below)[hit]
            left, start = left[~hit], start + int(size)
        return out


def fingerprints(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (mixed(b, a, 99) >> np.uint64(32)).astype("<u4")


def index_bytes(a: np.ndarray, b: np.ndarray, shard: np.ndarray, first: np.ndarray, copies: np.ndarray) -> bytes:
    """Index file over runs; a key may have several."""
    order = np.lexsort((shard, b, a))
    a, b, shard, first, copies = a[order], b[order], shard[order], first[order], copies[order]
    fresh = np.ones(len(a), dtype=bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    start = np.flatnonzero(fresh)
    perfect = PerfectHash.build(a[start], b[start])
    slots = perfect.slots(a[start], b[start])
    keys = np.empty(len(start), dtype=np.int64)
    keys[slots] = np.arange(len(start))
    runs = np.diff(np.append(start, len(a)))[keys]
    ends = np.cumsum(runs)
    # Runs in the order of slots.
    taken = np.repeat(start[keys] - (ends - runs), runs) + np.arange(len(a))
    out = io.BytesIO()
    np.savez(out, sizes=perfect.sizes, words=perfect.words, prints=fingerprints(a[start], b[start])[keys],
             ends=ends.astype("<u8"), shard=shard[taken], first=first[taken], copies=copies[taken])
    return out.getvalue()


def look_up(index: bytes, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of the keys held: (place of the key asked for, shard, first, copies)."""
    with np.load(io.BytesIO(index)) as held:
        slots = PerfectHash(held["sizes"], held["words"]).slots(a, b)
        asked = np.flatnonzero(slots >= 0)
        asked = asked[held["prints"][slots[asked]] == fingerprints(a[asked], b[asked])]
        ends = held["ends"].astype(np.int64)
        stop = ends[slots[asked]]
        start = np.where(slots[asked] > 0, ends[slots[asked] - 1], 0)
        runs = stop - start
        at = np.repeat(start - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
        return np.repeat(asked, runs), held["shard"][at], held["first"][at], held["copies"][at]


def hashes(key: str) -> list:
    return [F.xxhash64(F.lit(seed), F.col(key)).alias(name) for seed, name in ((1, "_a"), (2, "_b"))]


def unsigned(column) -> np.ndarray:
    return np.ascontiguousarray(column.to_numpy(zero_copy_only=False)).view(np.uint64)


def write(docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = END,
          shard_ids: int = SHARD_IDS, part_keys: int = PART_KEYS) -> None:
    """Encode ``docs`` into ``folder`` (one that all executors share), with its index."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(size / TASK_BYTES))
    # Equal keys and texts are told apart by row, so that no range is larger than the others.
    order = [F.col("_key"), F.xxhash64("_text"), F.monotonically_increasing_id()]
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    rows = rows.withColumn("_order", F.struct(*order[1:])).repartitionByRange(tasks, "_key", "_order").sortWithinPartitions("_key", "_order")

    def encode(batches):
        encoder, part, mark = ByteEncoder(tokenizer, end), TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        documents, runs, held, shard = [], [], 0, part << 32

        def flush():
            name = f"{shard:016x}-{mark}.ids"
            save(f"{folder}/ids", name, *shard_bytes(documents, encoder.item))
            columns = list(zip(*runs))
            names = ["_a", "_b", "first", "copies", "ids"]
            return pa.RecordBatch.from_pydict({"shard": [shard] * len(runs), "file": [name] * len(runs)} | {
                n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})

        for batch in batches:
            for a, b, t in zip(*(batch.column(n).to_pylist() for n in ("_a", "_b", "_text"))):
                ids = encoder(t or "")
                if held and held + len(ids) // 4 > shard_ids:
                    yield flush()
                    documents, runs, held, shard = [], [], 0, shard + 1
                if runs and runs[-1][0] == a and runs[-1][1] == b:
                    runs[-1][3] += 1
                    runs[-1][4] += len(ids) // 4
                else:
                    runs.append([a, b, len(documents), 1, len(ids) // 4])
                documents.append(ids)
                held += len(ids) // 4
        if documents:
            yield flush()

    runs = cut_lineage(rows.select(*hashes("_key"), "_text").mapInArrow(
        encode, "shard long, file string, _a long, _b long, first long, copies long, ids long"))
    parts = max(1, math.ceil(runs.count() / part_keys))

    def build(held: pa.Table) -> pa.Table:
        name = f"{held.column('part')[0].as_py():08x}-{uuid.uuid4().hex[:12]}.mph"
        ints = (held.column(c).to_numpy() for c in ("shard", "first", "copies"))
        save(f"{folder}/index", name, index_bytes(unsigned(held.column("_a")), unsigned(held.column("_b")), *ints))
        return pa.table({"part": held.column("part").slice(0, 1), "name": [name]})

    dealt = runs.select(F.pmod("_a", F.lit(parts)).cast("int").alias("part"), "_a", "_b", "shard", "first", "copies")
    built = dealt.groupBy("part").applyInArrow(build, "part int, name string")
    shards = runs.groupBy("shard", "file").agg(F.sum("ids").alias("ids"), F.shiftright(F.col("shard"), 32).alias("task"))
    here = shards.withColumn("here", F.sum("ids").over(_before()) - F.col("ids"))
    before = totals_before(shards.groupBy("task").agg(F.sum("ids").alias("n")), "task", {"n": "before"})
    here.join(before, "task").select("shard", "file", (F.col("before") + F.col("here")).alias("base")).write.parquet(f"{folder}/shards")
    built.withColumn("parts", F.lit(parts)).write.parquet(f"{folder}/parts")


def _before():
    from pyspark.sql import Window

    return Window.partitionBy("task").orderBy("shard")


def fetch(keys: DataFrame, folder: str, key: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """Documents of the keys given (once each): ``key``, ``start`` (ids of all documents before), ``n_tokens``,
    ``ids_crc32`` of the ids as unsigned little-endian 32-bit numbers and, if asked for, ``ids``."""
    spark = keys.sparkSession
    kind = keys.schema[key].dataType.simpleString()
    index, shards = spark.read.parquet(f"{folder}/parts"), spark.read.parquet(f"{folder}/shards")
    parts = index.select("parts").first()
    asked = keys.select(F.col(key).alias("_key"), *hashes(key)).withColumn("part", F.pmod("_a", F.lit(parts[0] if parts else 1)).cast("int"))

    def find(held: pa.Table) -> pa.Table:
        system, path = fs.FileSystem.from_uri(folder)
        with system.open_input_stream(f"{path}/index/{held.column('name')[0].as_py()}") as file:
            place, shard, first, copies = look_up(file.read(), unsigned(held.column("_a")), unsigned(held.column("_b")))
        return pa.table({"_key": held.column("_key").take(pa.array(place)), "shard": shard, "first": first, "copies": copies})

    places = asked.join(index.select("part", "name"), "part").groupBy("part").applyInArrow(
        find, f"_key {kind}, shard long, first long, copies long")

    def read(held: pa.Table) -> pa.Table:
        held = held.sort_by("first")
        place, out = [], []
        runs = read_runs(f"{folder}/ids", held.column("file")[0].as_py(), held.column("first").to_numpy(), held.column("copies").to_numpy())
        base = held.column("base")[0].as_py()
        for i, documents in enumerate(runs):
            for at, ids in documents:
                place.append(i)
                raw = ids.tobytes()
                out.append((base + at, len(ids), zlib.crc32(raw), raw if keep_ids else None))
        columns = list(zip(*out)) or [[]] * 4
        found = {"_key": held.column("_key").take(pa.array(place, pa.int64()))}
        found |= {n: pa.array(c, pa.int64()) for n, c in zip(("start", "n_tokens", "ids_crc32"), columns)}
        return pa.table(found | ({"ids": pa.array(columns[3], pa.binary())} if keep_ids else {}))

    schema = f"_key {kind}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids
    return places.join(shards, "shard").groupBy("shard").applyInArrow(read, schema).withColumnRenamed("_key", key)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def written_and_read(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, **sizes) -> DataFrame:
    """All documents' rows, read back by key from the files written."""
    folder = folder or f"{checkpoint_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    write(docs, folder, tokenizer or default_tokenizer(), **sizes)
    return fetch(docs.select("doc_id").distinct(), folder)


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``."""
    return written_and_read(table(spark, sf_dir, "documents"))
