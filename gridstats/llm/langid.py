"""Language identification by Bayesian evidence fusion.

Text likelihoods come from hashed letter trigrams, fitted on a bounded sample of different texts of
every label (``FIT_ROWS`` each), so a rare language is known too. Declared markup language, address suffix and host add evidence: how often a language
is declared as what is counted over all rows by grouped aggregation of the text posteriors, and host
priors are smoothed towards their suffix, suffix priors towards the whole corpus, each by a count of
pseudo-rows. The posterior is the product of the likelihood and these terms.

A row is rejected if its text holds no letters, if no language has half of the posterior, or if
text of some length is far less likely under its best language than any text of the sample.

Free style: trigram sums are numpy in Arrow batches; all counting is grouped aggregation. Null
evidence counts as a value of its own. Null text counts as empty and is rejected. Repeated rows get
equal results; equal posteriors go to the first language by name. An empty table, or one without a
labelled row, gives rows without a language, all rejected. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridstats.llm.common import small_side, table
from gridstats.session import cut_lineage

FIT_ROWS = 4000
SLOTS = 1 << 15
#: Trigrams overlap and repeat, so a text tells less than their product; evidence per trigram is scaled.
TEMPER = 0.3
HOST_ROWS, SUFFIX_ROWS, DECLARED_ROWS = 20.0, 20.0, 1.0
#: Below this many trigrams the average likelihood says little about being a language at all.
JUDGED, MARGIN = 40, 1.0


def trigrams(text: str) -> np.ndarray:
    """Hashed trigrams of the lower-cased text, runs of non-letters as one gap."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    low = codes < 0x250
    letter = np.where(low, LETTERS[np.where(low, codes, 0)], True)
    marks = np.where(letter, codes, 32)
    keep = np.ones(len(marks), dtype=bool)
    keep[1:] = (marks[1:] != 32) | (marks[:-1] != 32)
    marks = np.concatenate(([32], marks[keep], [32])).astype(np.uint64)
    mixed = (marks[:-2] * 1_000_003 + marks[1:-1]) * 1_000_003 + marks[2:]
    return ((mixed * 0x9E3779B1) >> 15 & (SLOTS - 1)).astype(np.int64)[marks[1:-1] != 32]


LETTERS = np.array([chr(c).isalpha() for c in range(0x250)])


class Model:
    """Languages, log-probabilities by slot and the least average likelihood of sample texts."""

    def __init__(self, languages: list[str], logs: np.ndarray, floor: float):
        self.languages, self.logs, self.floor = languages, logs, floor


def label_sample(held: DataFrame, text: str, label: str, order: Column, rows: int) -> DataFrame:
    """``text`` and ``label`` of about ``rows`` different texts of every label, those with the least hash
    values; all texts of a rarer label. Rows are picked where they lie, by a threshold per label."""
    named = held.select(F.col(text).alias("text"), F.col(label).alias("label"), order.alias("at"))
    # Different texts are estimated within some per cent, which only moves the size of the sample.
    counts = named.groupBy("label").agg(F.approx_count_distinct("at").alias("n"))
    most = F.when(F.col("n") * 0.8 <= rows, F.lit((1 << 63) - 1)).otherwise((F.lit(-float(1 << 63)) + F.lit(float(rows)) / F.col("n") * float(1 << 64)).cast("long"))
    limits = small_side(counts.select(F.col("label").alias("_label"), most.alias("most")))
    return named.join(limits, (F.col("label") == F.col("_label")) & (F.col("at") <= F.col("most"))).select("text", "label").distinct()


def fit(rows: DataFrame, text: str, label: str, order: Column, fit_rows: int = FIT_ROWS) -> Model:
    """Model from about ``fit_rows`` different texts of every label, those that come first by a hash."""
    held = rows.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    sample = cut_lineage(label_sample(held, text, label, order, fit_rows))

    def count(batches):
        for batch in batches:
            for label_, part in batch.groupby("label"):
                n = sum(np.bincount(trigrams(t), minlength=SLOTS) for t in part["text"])
                at = np.flatnonzero(n)
                yield pd.DataFrame({"label": label_, "slot": at, "n": n[at]})

    # Bounded: languages x SLOTS rows at most.
    counts = sample.mapInPandas(count, "label string, slot int, n long").groupBy("label", "slot").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["label"].unique())
    table_ = np.full((max(len(languages), 1), SLOTS), 0.1)
    for i, language in enumerate(languages):
        own = counts[counts["label"] == language]
        table_[i, own["slot"]] += own["n"]
    model = Model(languages, np.log(table_ / table_.sum(axis=1, keepdims=True)).astype(np.float32), -np.inf)
    if languages:
        worst = scores(sample.withColumn("key", F.lit(0)), "key", "text", [], model).where(F.col("n") >= JUDGED)
        model.floor = float(worst.agg(F.min(F.array_max("logs") / F.col("n"))).first()[0] or -np.inf) - MARGIN
    return model


def scores(rows: DataFrame, key: str, text: str, evidence: list[str], model: Model) -> DataFrame:
    """``key``, evidence columns, ``n`` trigrams and ``logs``: log-likelihood per language."""
    named = rows.select(F.col(key).alias("key"), F.col(text).alias("text"), *[F.col(c) for c in evidence])

    def run(batches):
        for batch in batches:
            counts, logs = [], []
            for t in batch.column("text").to_pylist():  # one text's trigrams at a time
                slots = trigrams(t or "")
                counts.append(len(slots))
                logs.append([float(row[slots].sum(dtype=np.float64)) for row in model.logs])
            # Keys stay in Arrow: pandas would round large ones next to a null.
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("key", *evidence)] + [pa.array(counts, pa.int64()), pa.array(logs, pa.list_(pa.float64()))],
                                             names=["key", *evidence, "n", "logs"])

    kinds = ", ".join(["key " + rows.schema[key].dataType.simpleString(), *[f"{c} string" for c in evidence]])
    return named.mapInArrow(run, f"{kinds}, n long, logs array<double>")


def normal(logs: Column) -> Column:
    """Probabilities from log weights."""
    def shares(raw: Column) -> Column:
        return F.transform(raw, lambda x: x / F.aggregate(raw, F.lit(0.0), lambda a, y: a + y))
    return F.transform(F.array(F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))), shares)[0]


def add(a: Column, b: Column, weight: float = 1.0) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y * weight)


def sums(share: Column, count: int) -> list[Column]:
    return [F.sum(share[i]).alias(f"p{i}") for i in range(count)]


def fuse(scored: DataFrame, model: Model) -> DataFrame:
    """``key``, ``text_hash`` and evidence with ``language``, ``confidence``, ``kept``.

    ``scored`` must be materialised: it is read once for each level of the priors.
    """
    k = len(model.languages)
    langs = F.array(*[F.lit(x) for x in model.languages])
    judged = scored.withColumn("likelihood", F.transform("logs", lambda x: x * TEMPER)).withColumn("share", normal(F.col("likelihood")))
    heard = judged.where(F.col("n") > 0)

    def vector(scale: Column | None = None) -> Column:
        return F.array(*[F.col(f"p{i}") if scale is None else F.col(f"p{i}") / scale for i in range(k)])

    overall = heard.agg(*sums(F.col("share"), k)).select(vector().alias("world"))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    share_of = lambda v, base, rows: F.zip_with(v, base, lambda x, b: (x + rows * b) / (total(v) + rows))
    even = F.array_repeat(F.lit(1.0 / k), k)
    world = overall.select(share_of(F.transform("world", lambda x: F.coalesce(x, F.lit(0.0))), even, 1.0).alias("world"))
    suffixes = heard.groupBy("suffix").agg(*sums(F.col("share"), k)).select("suffix", vector().alias("s"))
    suffixes = suffixes.withColumn("world", world.scalar()).select("suffix", share_of(F.col("s"), F.col("world"), SUFFIX_ROWS).alias("s"))
    hosts = heard.groupBy("suffix", "host").agg(*sums(F.col("share"), k)).select("suffix", "host", vector().alias("h"))
    same = F.col("suffix").eqNullSafe(F.col("suffix2"))
    hosts = hosts.join(suffixes.withColumnRenamed("suffix", "suffix2"), same).select(
        F.col("suffix").alias("suffix2"), F.col("host").alias("host2"), share_of(F.col("h"), F.col("s"), HOST_ROWS).alias("prior"))
    # P(declared | language): share of each declared value among the rows of a language.
    declared = heard.groupBy("declared").agg(*sums(F.col("share"), k)).select("declared", vector().alias("d"))
    everything = overall.select(F.transform("world", lambda x: F.coalesce(x, F.lit(0.0)))).scalar()
    declared = declared.withColumn("all", everything).select(
        F.col("declared").alias("declared2"), F.zip_with("d", "all", lambda x, a: (x + DECLARED_ROWS) / (a + DECLARED_ROWS * 20)).alias("said"))
    joined = judged.join(small_side(hosts), F.col("suffix").eqNullSafe(F.col("suffix2")) & F.col("host").eqNullSafe(F.col("host2")), "left")
    joined = joined.join(small_side(declared), F.col("declared").eqNullSafe(F.col("declared2")), "left")
    log = lambda v: F.transform(F.coalesce(v, even), lambda x: F.log(x))
    fused = joined.withColumn("posterior", normal(add(add(F.col("likelihood"), log(F.col("prior"))), log(F.col("said")))))
    best = F.array_max("posterior")
    language = langs[F.array_position("posterior", best).cast("int") - 1]
    unlike = (F.col("n") >= JUDGED) & (F.array_max("logs") / F.col("n") < model.floor)
    kept = (F.col("n") > 0) & (best >= 0.5) & ~unlike
    return fused.select("key", "text_hash", F.when(F.col("n") > 0, language).alias("language"), best.alias("confidence"), kept.alias("kept"))


def identify(rows: DataFrame, key: str, text: str, declared: Column, suffix: Column, host: Column, label: str,
             fit_rows: int = FIT_ROWS) -> DataFrame:
    """``key``, ``text_hash``, ``language``, ``confidence``, ``kept`` for every row; the model is fitted
    on rows with a ``label``."""
    held = rows.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(label).alias("label"), declared.cast("string").alias("declared"),
                       suffix.cast("string").alias("suffix"), host.cast("string").alias("host"), F.xxhash64(text).cast("string").alias("text_hash"))
    # By text alone: copies of a text share a hash and count once.
    model = fit(held, "text", "label", F.xxhash64("text_hash"), fit_rows)
    if not model.languages:
        return held.select("key", "text_hash", F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("confidence"), F.lit(False).alias("kept"))
    return fuse(cut_lineage(scores(held, "key", "text", ["declared", "suffix", "host", "text_hash"], model)), model)


def of_documents(docs: DataFrame) -> DataFrame:
    """Documents carry their language as declared and their source as host; they have no address suffix."""
    return identify(docs, "doc_id", "text", F.col("lang"), F.lit(None), F.col("source"), "lang")


def of_pages(pages: DataFrame) -> DataFrame:
    """Web pages: language of the html element, last label of the host, host; text without tags."""
    host = F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1)
    told = F.nullif(F.regexp_extract("html", r"""<html[^>]*\slang=["']?([A-Za-z-]+)""", 1), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style)\b.*?</\1>", " "), r"<[^>]*+>", " ")
    held = pages.withColumns({"_text": bare, "_told": told})
    return identify(held, "page_id", "_text", F.col("_told"), F.regexp_extract(host, r"[^.]*$", 0), host, "_told")


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``."""
    found = of_documents(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), "language", F.round("confidence", 6).alias("confidence"), "kept")
