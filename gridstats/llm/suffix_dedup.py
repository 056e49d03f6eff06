"""Repeated passages by sparse suffixes at minimisers.

In every window of ``LEAST`` words the ``SEED``-word seed with the least hash is its minimiser, which
depends on the window's words alone. Windows that follow each other with the same minimiser are one
span. Spans whose seed occurs in one document only go. Equal spans of several documents are shared
whole. Where spans of one seed differ, one copy of each is taken apart and its windows, which are the
(left, right) splits of ``LEAST`` words around the seed, are grouped by their hash; a window that
another document holds marks its words. So any two occurrences of a window meet, however many
documents share its seed. Marks that overlap join, so longer passages come out whole.

A group is reduced to the least and greatest document that hold it, before the shuffle too, so neither
a seed nor a passage of very many documents is gathered.

Words are runs without ASCII white space, compared by 64-bit hashes. Null and short texts have no
passages. Repeated rows of one document are one document, and so are all rows without an id. An empty table gives no rows. Extra
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridstats.llm.common import table
from gridstats.session import cut_lineage

LEAST, SEED = 50, 16
WINDOW = LEAST - SEED + 1
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Rows of one frame that leaves a Python worker, about.
FRAME = 200_000


def word_hashes(text: str) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, text.encode().split()), dtype=np.uint64)


def mixed(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    out = a * MIX + (b if isinstance(b, np.ndarray) else np.uint64(b))
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ out >> np.uint64(32)


def spans(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Seed hash, content hash, first window and number of windows of every span, and all window hashes."""
    words = word_hashes(text)
    n = len(words) - SEED + 1
    if n < WINDOW:
        none = np.zeros(0, dtype=np.uint64)
        return none, none, none.astype(np.int64), none.astype(np.int64), none
    seeds = np.zeros(n, dtype=np.uint64)
    for i in range(SEED):
        seeds = seeds * MIX + words[i:i + n]
    seeds = mixed(seeds, 0)
    count = n - WINDOW + 1
    least = []
    for lo in range(0, count, 1 << 16):
        part = seeds[lo:min(n, lo + (1 << 16) + WINDOW - 1)]
        least.append(lo + np.arange(len(part) - WINDOW + 1) + np.lib.stride_tricks.sliding_window_view(part, WINDOW).argmin(axis=1))
    at = np.concatenate(least)
    # The seeds at these places cover all words of a window.
    windows = seeds[:count]
    for i in (SEED, 2 * SEED, LEAST - SEED):
        windows = mixed(windows, seeds[i:i + count])
    lo = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    size = np.diff(np.append(lo, count))
    # The first and the last window of a span overlap, so they cover all of its words.
    whole = mixed(mixed(windows[lo], windows[lo + size - 1]), size.astype(np.uint64))
    return seeds[at[lo]], whole, lo, size, windows


def document_spans(docs: DataFrame) -> DataFrame:
    """``seed``, ``span``, ``doc``, ``lo``, ``size`` of every span."""

    def frame(parts):
        seed, span, doc, lo, size = (np.concatenate(x) for x in zip(*parts))
        return pd.DataFrame({"seed": seed.view(np.int64), "span": span.view(np.int64), "doc": doc, "lo": lo.astype(np.int32), "size": size.astype(np.int16)})

    def run(batches):
        for batch in batches:
            parts, rows = [], 0
            for doc, text in zip(batch["doc"], batch["text"]):
                seed, span, lo, size, _ = spans(text)
                parts.append((seed, span, np.full(len(seed), doc, dtype=np.int64), lo, size))
                rows += len(seed)
                if rows >= FRAME:
                    yield frame(parts)
                    parts, rows = [], 0
            if parts:
                yield frame(parts)

    return docs.mapInPandas(run, "seed long, span long, doc long, lo int, size short")


def span_windows(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``seed``, ``span``, ``k`` and ``window`` hash of every window of the ``wanted`` spans, with the
    least and greatest document (``a``, ``b``) of the span. ``wanted`` names each span in one document."""

    def frame(parts):
        seed, span, k, window, a, b = (np.concatenate(x) for x in zip(*parts))
        return pd.DataFrame({"seed": seed.view(np.int64), "span": span.view(np.int64), "k": k.astype(np.int16), "window": window.view(np.int64), "a": a, "b": b})

    def run(batches):
        for batch in batches:
            parts, rows = [], 0
            for text, names, a, b in zip(batch["text"], batch["spans"], batch["a"], batch["b"]):
                seed, span, lo, size, windows = spans(text)
                names = np.asarray(names, dtype=np.int64)
                order = np.argsort(names)
                names, a, b = names[order], np.asarray(a, dtype=np.int64)[order], np.asarray(b, dtype=np.int64)[order]
                # A span may stand in the text more than once.
                span_, first = np.unique(span.view(np.int64), return_index=True)
                first = first[np.isin(span_, names)]
                if not len(first):
                    continue
                size_ = size[first]
                k = np.arange(size_.sum()) - np.repeat(np.cumsum(size_) - size_, size_)
                owner = np.repeat(first, size_)
                place = np.searchsorted(names, span[owner].view(np.int64))
                parts.append((seed[owner], span[owner], k, windows[lo[owner] + k], a[place], b[place]))
                rows += len(k)
                if rows >= FRAME:
                    yield frame(parts)
                    parts, rows = [], 0
            if parts:
                yield frame(parts)

    held = wanted.groupBy(F.col("doc").alias("owner")).agg(F.collect_list(F.struct("span", "a", "b")).alias("w"))
    dealt = docs.join(held, F.col("doc") == F.col("owner")).select("text", F.col("w.span").alias("spans"), F.col("w.a").alias("a"), F.col("w.b").alias("b"))
    return dealt.mapInPandas(run, "seed long, span long, k short, window long, a long, b long")


def passages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc``, ``lo``, ``hi``: words [lo, hi) of passages that other documents hold too."""
    held = docs.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    # A number that no document has stands for a missing id.
    low, high = held.agg(F.min("doc"), F.max("doc")).first()
    unknown = -1 if low is None else low - 1 if low > -(1 << 63) else high + 1
    held = held.withColumn("doc", F.coalesce("doc", F.lit(unknown)))
    every = cut_lineage(document_spans(held))
    low, high = F.min("doc").alias("a"), F.max("doc").alias("b")
    shared = every.groupBy("seed").agg(low, high).where("a < b").select(F.col("seed").alias("again"))
    every = cut_lineage(every.join(cut_lineage(shared), F.col("seed") == F.col("again"), "left_semi"))
    groups = cut_lineage(every.groupBy("seed", "span", "size").agg(low, high))
    mixed_seeds = groups.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select(F.col("seed").alias("again"))
    wanted = groups.join(mixed_seeds, F.col("seed") == F.col("again"), "left_semi").withColumn("doc", F.col("a"))
    windows = cut_lineage(span_windows(held, wanted))
    common = windows.groupBy("seed", "window").agg(F.min("a").alias("least"), F.max("b").alias("most")).where("least < most").select(
        F.col("seed").alias("again"), F.col("window").alias("same"))
    # Windows of one span overlap, so the first and the last shared one bound its marked words.
    part = windows.where("a = b").join(common, (F.col("seed") == F.col("again")) & (F.col("window") == F.col("same")), "left_semi")
    part = part.groupBy("seed", "span").agg(F.min("k").cast("int").alias("k_lo"), F.max("k").cast("int").alias("k_hi"))
    marked = groups.where("a < b").select("seed", "span", F.lit(0).alias("k_lo"), (F.col("size") - 1).cast("int").alias("k_hi")).unionByName(part)
    marked = cut_lineage(marked.select(F.col("seed").alias("again"), F.col("span").alias("same"), "k_lo", "k_hi"))
    found = every.join(marked, (F.col("seed") == F.col("again")) & (F.col("span") == F.col("same"))).select(
        "doc", (F.col("lo") + F.col("k_lo")).cast("long").alias("lo"), (F.col("lo") + F.col("k_hi") + LEAST).cast("long").alias("hi"))
    marks = found.groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("marks"))

    def merge(acc, x):
        last = F.element_at(acc, -1)
        grown = F.array_append(F.slice(acc, 1, F.size(acc) - 1), F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], x["hi"]).alias("hi")))
        return F.when((F.size(acc) > 0) & (x["lo"] <= last["hi"]), grown).otherwise(F.array_append(acc, x))

    marks = marks.withColumn("doc", F.nullif("doc", F.lit(unknown)))
    return marks.select("doc", F.inline(F.aggregate("marks", F.array().cast("array<struct<lo:bigint,hi:bigint>>"), merge)))


def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``: one row per passage; documents without any have none."""
    found = passages(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), F.col("lo").alias("start_word"), F.col("hi").alias("end_word"))
