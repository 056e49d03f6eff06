"""Resampling towards a target distribution by hashed n-gram features, found with an Aho-Corasick dictionary.

The dictionary holds the commonest words, each bounded by delimiters and with its CRC and byte length
as payload. An automaton scan of a text emits the payloads in order; the stretches between them hold
words outside of the dictionary, whose payloads are computed on the spot, so features are whole whatever
the dictionary holds. A run of adjacent words is a feature: its CRC is composed from the payloads alone,
and its bucket is the CRC modulo their number. Every text is scanned once: a row's buckets are stored, counted, and
their gains added up to its weight. Gumbel noise from the document's id
turns the largest scores into a draw without replacement.

Only bounded data travels to all tasks: ``WORDS`` words of at most ``LONGEST`` bytes and one gain per bucket.
Scores are whole numbers, so a histogram of them (short whatever the number of rows) gives the score that
the draw ends at; only rows from there on are sorted, by ranges, for their ranks.

Null text has no words, weight 0 and is never drawn. A null id counts as empty in the noise and ranks after
all others of its score. Repeated rows get equal scores and ranks of their own. An empty table gives no
rows; without a target all features count as never seen there. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridstats.llm.common import table
from gridstats.operators.ranges import numbered
from gridstats.session import cut_lineage, stored

BUCKETS, GRAM, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
WORDS, LONGEST, HELD, PART = 1 << 16, 64, 1 << 20, 1 << 20
#: Buckets that a task holds before it passes them on.
PASSED = 1 << 22
#: ASCII other than digits and letters delimits words; A to Z are lowered; other bytes belong to words.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def plain(text: str) -> bytes:
    """UTF-8 bytes with one space for each delimiter, and one at either end."""
    return b" " + text.encode().translate(TABLE) + b" "


def _shifts() -> np.ndarray:
    """Tables (power, byte of the CRC, value) that append 2^power zero bytes to a CRC."""
    def by(start: np.ndarray) -> np.ndarray:
        """Table of a linear step from its values on single bits."""
        values = np.arange(256)
        out = np.zeros((4, 256), dtype=np.uint32)
        for byte in range(4):
            for bit in range(8):
                out[byte] ^= np.where(values >> bit & 1, start[8 * byte + bit], 0).astype(np.uint32)
        return out

    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    # CRC of a zero byte after state x, without the pre- and post-conditioning.
    step = np.array([zlib.crc32(b"\0", int(x) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF for x in bits], dtype=np.uint32)
    powers = [by(step)]
    for _ in range(31):
        powers.append(by(_apply(powers[-1], _apply(powers[-1], bits))))
    return np.array(powers)


def _apply(powers: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return powers[0][crc & 255] ^ powers[1][crc >> 8 & 255] ^ powers[2][crc >> 16 & 255] ^ powers[3][crc >> 24]


SHIFTS = _shifts()


def composed(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC of two strings joined, from their CRCs and the length of the second."""
    out = left
    for power in range(int(length.max(initial=0)).bit_length()):
        out = np.where(length >> power & 1, _apply(SHIFTS[power], out), out)
    return out ^ right


class Scanner:
    """Payloads of the words of a text, in order."""

    def __init__(self, words: list[bytes]):
        self.crc = np.array([zlib.crc32(w) for w in words], dtype=np.uint32)
        self.length = np.array([len(w) for w in words], dtype=np.int64)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, w in enumerate(words):
            self.automaton.add_word(f" {w.decode('latin-1')} ", i)
        if words:
            self.automaton.make_automaton()

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """CRCs and byte lengths."""
        data, at, parts = plain(text), 0, []
        while at < len(data) - 1:
            # Long texts are scanned in parts that share the space between them.
            stop = data.find(b" ", min(at + PART, len(data) - 1))
            parts.append(self.scan(data[at:stop + 1]))
            at = stop
        return tuple(np.concatenate(x) for x in zip(*parts))

    def scan(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        matches = self.automaton.iter(data.decode("latin-1")) if len(self.crc) else ()
        found = np.fromiter(chain.from_iterable(matches), dtype=np.int64).reshape(-1, 2)
        end, word = found[:, 0], found[:, 1]
        crc, length = self.crc[word], self.length[word]
        if int(length.sum()) == len(data) - data.count(b" "):
            return crc, length
        # Words outside of the dictionary stand in the stretches between matches.
        after = np.append(end - length, len(data) - 1)
        before = np.append(0, end)
        at, crcs, lengths = [], [], []
        for gap in np.flatnonzero(after - before > 1).tolist():
            for w in data[before[gap]:after[gap]].split():
                at.append(gap)
                crcs.append(zlib.crc32(w))
                lengths.append(len(w))
        return np.insert(crc, at, np.array(crcs, dtype=np.uint32)), np.insert(length, at, lengths)

    def buckets(self, text: str, gram: int = GRAM, count: int = BUCKETS) -> tuple[np.ndarray, int]:
        """Buckets of all runs of 1 to ``gram`` words, and the number of words."""
        crc, length = self(text)
        run, out = crc, [crc % count]
        for n in range(1, min(gram, len(crc))):
            # The next word and the space before it join the run.
            spaced = composed(np.full(len(crc) - n, zlib.crc32(b" "), dtype=np.uint32), crc[n:], length[n:])
            run = composed(run[:-1], spaced, length[n:] + 1)
            out.append(run % count)
        return np.concatenate(out), len(crc)


def frequent(texts: DataFrame, words: int = WORDS) -> list[bytes]:
    """About the ``words`` commonest words of not more than ``LONGEST`` bytes, fewer on ties."""

    def count(batches):
        held: Counter = Counter()

        def flush():
            rows = [(w, n) for w, n in held.items() if len(w) <= LONGEST]
            held.clear()
            return pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in rows], pa.binary()), "n": pa.array([n for _, n in rows], pa.int64())})

        for batch in batches:
            for t in batch.column(0).to_pylist():
                held.update(plain(t or "").split())
                if len(held) > HELD:
                    yield flush()
        yield flush()

    counts = cut_lineage(texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    # Some hundred sizes (eighths of a power of two) tell from which count on the words are few enough.
    size = F.floor(F.log2("n") * 8)
    room, least = words, None
    for row in counts.groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect():
        if row["count"] > room:
            break
        room, least = room - row["count"], row["size"]
    return [bytes(r["word"]) for r in counts.where(size >= least).select("word").collect()] if least is not None else []


def bucket_rows(batches, scan: Scanner, gram: int, count: int, most: int = PASSED):
    """Batches of key, number of words and buckets of all features, from batches of key and text."""

    def rows(keys, words, found):
        ends = np.cumsum([0, *map(len, found)])
        values = np.concatenate([np.empty(0, dtype=np.int32), *found]).astype(np.int32)
        return pa.RecordBatch.from_arrays([keys, pa.array(words, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))],
                                          names=["_key", "n_words", "buckets"])

    for batch in batches:
        start, words, found, held = 0, [], [], 0
        for i, t in enumerate(batch.column(1).to_pylist()):
            at, n = scan.buckets(t, gram, count) if t else (np.empty(0, dtype=np.int32), 0)
            words.append(n)
            found.append(at)
            held += len(at)
            if held > most:
                yield rows(batch.column(0).slice(start, len(words)), words, found)
                start, words, found, held = i + 1, [], [], 0
        yield rows(batch.column(0).slice(start, len(words)), words, found)


def bucketed(docs: DataFrame, scanner, key: str | None, text: str, gram: int = GRAM, count: int = BUCKETS) -> DataFrame:
    """``_key``, ``n_words`` and ``buckets`` of every row."""
    keyed = docs.select((F.col(key) if key else F.lit(0)).alias("_key"), F.col(text).cast("string").alias("_text"))
    kind = keyed.schema["_key"].dataType.simpleString()
    return keyed.mapInArrow(lambda batches: bucket_rows(batches, scanner(), gram, count), f"_key {kind}, n_words long, buckets array<int>")


def bucket_counts(rows: DataFrame, count: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all ``bucketed`` rows."""

    def run(batches):
        total = np.zeros(count, dtype=np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=count)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int64()), "n": pa.array(total[used], pa.int64())})

    out = np.zeros(count, dtype=np.int64)
    for row in rows.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one per bucket
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of each bucket's log ratio of smoothed shares."""
    s, t = float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((b + 1) * s / ((a + 1) * t))) for a, b in zip(source.tolist(), target.tolist())], dtype=np.int64)


def weighed(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
            gram: int = GRAM, buckets: int = BUCKETS, words: int = WORDS) -> DataFrame:
    """``key``, ``n_words``, ``n_features`` and ``weight`` (floored mean of gains) of every row."""
    context = docs.sparkSession.sparkContext
    dictionary = context.broadcast(frequent(docs.select(F.col(text).cast("string")), words))
    scanner = lambda: Scanner(dictionary.value)
    # Stored: a scan costs far more than reading its buckets again.
    held = stored(bucketed(docs, scanner, key, text, gram, buckets))
    gain = context.broadcast(gains(bucket_counts(held, buckets),
                                   bucket_counts(bucketed(target, scanner, None, target_text, gram, buckets), buckets)))

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            n = lists.value_lengths().to_numpy().astype(np.int64)
            upto = np.append(0, np.cumsum(gain.value[lists.flatten().to_numpy()]))
            end = np.cumsum(n)
            weight = (upto[end] - upto[end - n]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(weight)], names=["_key", "n_words", "n_features", "weight"])

    kind = docs.schema[key].dataType.simpleString()
    found = held.mapInArrow(run, f"_key {kind}, n_words long, n_features long, weight long")
    return found.withColumnRenamed("_key", key)


def resampled(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
              percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, **features) -> DataFrame:
    """``weighed`` rows with ``score`` and ``rank``, null for rows that are not drawn."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    found = weighed(docs, target, key, text, target_text, **features).withColumn("score", (F.col("weight") + noise).cast("long"))
    found = cut_lineage(found.withColumn("_may", F.col("n_words") >= least_words))
    # Scores are whole and within some ten thousands, whatever the number of rows.
    histogram = [(r["score"], r["count"]) for r in found.where("_may").groupBy("score").count().orderBy(F.desc("score")).collect()]
    wanted, last, seen = percent * sum(n for _, n in histogram) // 100, None, 0
    for score, n in histogram:
        if seen >= wanted:
            break
        last, seen = score, seen + n
    if last is None:
        return found.select("*", F.lit(None).cast("long").alias("rank")).drop("_may")
    near = F.col("_may") & (F.col("score") >= last)
    order = [F.desc("score"), F.col(key).asc_nulls_last(), F.monotonically_increasing_id()]
    ranked = numbered(found.where(near).withColumn("_row", order.pop()), [*order, "_row"], "rank").withColumn("rank", F.col("rank") + 1)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return ranked.drop("_row", "_may").unionByName(found.where(~near).withColumn("rank", F.lit(None).cast("long")).drop("_may"))


def importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``, towards all of ``benchmark``."""
    found = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")
