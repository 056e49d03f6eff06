"""Collocations, importance resampling and token files against brute force, and on awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridstats.llm import collocations, importance, token_files
from gridstats.operators.ranges import numbered

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, f long, rank string, word string, shard int, _key string"
BIG = (1 << 60) + 1
LONG = " ".join(f"word{i % 977} filler." if i % 50 == 0 else f"word{i % 977} filler" for i in range(60_000))
TAIL = ("a", None, 1, 2, "r", "w", 3, "k")
ROWS = [(1, None, "en", *TAIL), (2, "", "en", *TAIL), (3, " \t\n", None, *TAIL), (4, "The same, Words are here AGAIN and again", "en", *TAIL),
        (5, "The same, Words are here AGAIN and again", "en", *TAIL), (5, "The same, Words are here AGAIN and again", "en", *TAIL),
        (5, "other text of this id", "en", *TAIL), (6, "ÄÖ 日本 \U0001f600 it's <|endoftext|>\x00 a\x01 b\x1fc  d e", "de", *TAIL), (7, LONG, None, *TAIL), (BIG, LONG, "und", *TAIL),
        (BIG + 1, "neighbouring ids stay apart", "en", *TAIL), (None, "no id at all", "de", *TAIL), (None, "no id at all, two", "de", *TAIL)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


# Collocations.

def brute_counts(rows):
    f, n = Counter(), Counter()
    for r in rows:
        lang = r["lang"] or "und"
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i:i + m])) for i in range(len(words)) for m in range(1, 6) if i + m <= len(words))
    return f, n


def brute_collocations(rows, least, best):
    f, n = brute_counts(rows)
    f = {k: v for k, v in f.items() if v >= least}
    covered = {}
    for (lang, w), v in f.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                covered[lang, w[i:i + m]] = max(v, covered.get((lang, w[i:i + m]), 0))
    out = defaultdict(list)
    for (lang, w), a in f.items():
        if len(w) > 1 and covered.get((lang, w), 0) < a:
            score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, v in out.items() for i, (s, a, p, l, r) in enumerate(sorted(v)[:best], 1)}


def rows_of(df):
    got = [tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("budget", [40, 1 << 20])
def test_collocations(docs, odd, budget):
    for frame, least in ((docs, 20), (odd, 2), (odd, 100), (odd.limit(0), 2)):
        assert rows_of(collocations.mined(frame, least=least, budget=budget, best=300)) == brute_collocations(frame.collect(), least, 300)


def test_collocations_control_characters(spark):
    """Separators inside words and before short suffixes do not mix phrases up."""
    rows = [(i, t, "x") for i, t in enumerate(["a b c", "a\x00b c", "a\x01 b", "a b", "a", "a\x1f b", "a\x1f@b c"] * 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for budget in (2, 1 << 20):
        assert rows_of(collocations.mined(frame, least=2, budget=budget)) == brute_collocations(frame.collect(), 2, 2000)


def test_bundles_hold_their_suffixes_in_less(spark):
    """op11's disk: suffixes move as numbers of words, much smaller than as strings, and come back whole."""
    names = pa.array([None, *[f"wörd{i}" for i in range(1, 400)], "a\x1fAb"], pa.string())
    rng = np.random.default_rng(5)
    for count in (1, 5000):
        rows = np.sort(rng.integers(1, 401, (count, 5)), axis=0).astype(np.int32)
        rows[::2, 4], rows[::4, 3] = 0, 0
        depth, n = rng.integers(3, 6, count).astype(np.int32), rng.integers(1, 70_000, count)
        data = collocations.packed(names, rows, depth, n)
        suffix, depths, counts = collocations.unpacked(data)
        assert suffix.equals(collocations.joined(names, rows, 5)) and depths.tolist() == depth.tolist() and counts.tolist() == n.tolist()
    assert len(data) < sum(len(x) for x in suffix.to_pylist()) / 2


def test_collocation_scores_past_64_bits(spark):
    big = 9_000_000_000_000
    phrases = spark.createDataFrame([("x", "a", 1, big), ("x", "b", 1, big - 1), ("x", "a b", 2, big - 7)], "lang string, phrase string, words int, f long")
    totals = spark.createDataFrame([("x", 10 * big + 3)], "lang string, n long")
    row = collocations.scored(phrases, totals).first()
    assert row["score"] == 1000 * (big - 7) * (10 * big + 3) // (big * (big - 1))


def test_partition_batches_are_added_up(spark, docs):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert rows_of(collocations.mined(docs.limit(60), least=10, best=300)) == brute_collocations(docs.limit(60).collect(), 10, 300)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


# Importance resampling.

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_features(text, gram, buckets):
    w = words_of(text)
    return [zlib.crc32(" ".join(w[i:i + m]).encode()) % buckets for m in range(1, gram + 1) for i in range(len(w) - m + 1)]


def brute_importance(rows, target, gram, buckets, percent, least):
    s, t = Counter(), Counter()
    for r in rows:
        s.update(brute_features(r["text"], gram, buckets))
    for r in target:
        t.update(brute_features(r["text"], gram, buckets))
    total, wanted = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * float(total) / ((s[b] + 1) * float(wanted)))) for b in range(buckets)]
    out = []
    for r in rows:
        b = brute_features(r["text"], gram, buckets)
        weight = sum(gain[x] for x in b) // len(b) if b else 0
        h = int(hashlib.sha256(f"2024:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([r["doc_id"], len(b), weight, score, None, len(words_of(r["text"]))])
    may = sorted((o for o in out if o[5] >= least), key=lambda o: (-o[3], o[0] is None, o[0]))
    for i, o in enumerate(may[:percent * len(may) // 100], 1):
        o[4] = i
    return Counter(tuple(o[:5]) for o in out)


@pytest.mark.parametrize(("gram", "words"), [(1, 1 << 16), (3, 50), (2, 0)])
def test_importance(spark, docs, odd, gram, words):
    target = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    for frame, percent, least in ((docs, 10, 20), (odd, 60, 0), (odd, 100, 3), (odd.limit(0), 10, 20)):
        for aim in (target, target.limit(0)):
            got = importance.resampled(frame, aim, percent=percent, least_words=least, gram=gram, words=words, buckets=997)
            got = Counter(tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect())
            assert got == brute_importance(frame.collect(), aim.collect(), gram, 997, percent, least)


def test_importance_repeated_rows_are_ranked_each(spark):
    rows = spark.range(4000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one two three").alias("text"))
    got = importance.resampled(rows, rows.limit(1), percent=50, least_words=1, buckets=97)
    assert sorted(r["rank"] for r in got.where("rank is not null").select("rank").collect()) == list(range(1, 2001))


def test_every_text_is_scanned_once(spark):
    """The scan is op12's cost: weights come from stored buckets, not from another scan of the texts."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = importance.weighed(docs, docs.limit(0), words=100)
    assert not any("documents" in f for f in found.inputFiles()) and found.count() == docs.count()


def test_rows_passed_on_in_parts_stay_whole():
    texts = [" ".join(f"w{i % 3} x{i}" for _ in range(i % 4)) or None for i in range(30)]
    batch = pa.RecordBatch.from_pydict({"_key": list(range(30)), "_text": pa.array(texts, pa.string())})
    scan = importance.Scanner([b"w1"])
    for most in (0, 3, 1 << 20):
        rows = [r for part in importance.bucket_rows([batch, batch.slice(0, 0)], scan, 1, 997, most) for r in part.to_pylist()]
        assert rows == [{"_key": i, "n_words": len(words_of(t or "")), "buckets": [zlib.crc32(w.encode()) % 997 for w in words_of(t or "")]}
                        for i, t in enumerate(texts)]


def test_payload_composition():
    parts = [b"", b"a", b"\x00\x00", "ärger".encode(), b"x" * 1000]
    for a in parts:
        for b in parts:
            crc = importance.composed(np.array([zlib.crc32(a)], dtype=np.uint32), np.array([zlib.crc32(b)], dtype=np.uint32), np.array([len(b)]))
            assert crc[0] == zlib.crc32(a + b)


def test_long_texts_are_scanned_in_parts(monkeypatch):
    monkeypatch.setattr(importance, "PART", 10)
    text = "ab cd ef gh a-verylongwordthatisnotknown ab"
    for words in ([b"ab", b"ef", b"gh"], []):
        crc, length = importance.Scanner(words)(text)
        assert crc.tolist() == [zlib.crc32(w.encode()) for w in words_of(text)]
        assert length.tolist() == [len(w) for w in words_of(text)]


# Token files.

def brute_tokens(rows):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(token_files.default_tokenizer())
    return [(r["doc_id"], np.array(exact.encode(r["text"] or "", add_special_tokens=False).ids + [2], dtype="<u4")) for r in rows]


@pytest.mark.parametrize("sizes", [{}, {"shard_ids": 500, "part_keys": 20}])
def test_token_files(docs, odd, sizes):
    for frame in (docs, odd, odd.limit(0)):
        got = token_files.written_and_read(frame, **sizes).collect()
        want = brute_tokens(frame.collect())
        assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((k, len(v), zlib.crc32(v.tobytes())) for k, v in want)
        got.sort(key=lambda r: r["start"])
        assert [r["start"] for r in got] == [0, *accumulate(r["n_tokens"] for r in got)][:len(got)]
        assert [r["doc_id"] is not None for r in got] == sorted(r["doc_id"] is not None for r in got)
        ids = [r["doc_id"] for r in got if r["doc_id"] is not None]
        assert ids == sorted(ids)


def test_keyed_access(spark, odd, tmp_path):
    folder = str(tmp_path)
    token_files.write(odd, folder, token_files.default_tokenizer(), shard_ids=500, part_keys=3)
    keys = spark.createDataFrame([(4,), (5,), (BIG,), (None,), (99,), (-3,)], "doc_id long")
    got = token_files.fetch(keys, folder, keep_ids=True).collect()
    want = Counter((k, v.tobytes()) for k, v in brute_tokens(odd.collect()) if k in (4, 5, BIG, None))
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == want


def test_one_key_over_many_shards(spark):
    rows = spark.range(300).select(F.when(F.col("id") % 3 > 0, F.lit(1)).otherwise(F.col("id")).cast("string").alias("doc_id"), F.lit("some text").alias("text"))
    got = token_files.written_and_read(rows, shard_ids=20, part_keys=10).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in rows.collect())
    assert sorted(r["start"] for r in got) == list(range(0, 300 * got[0]["n_tokens"], got[0]["n_tokens"]))


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 50_000):
        a, b = rng.integers(0, 1 << 63, (2, n), dtype=np.uint64)
        a[:n // 2] = 5  # equal first hashes are told apart by the second
        found = token_files.PerfectHash.build(a, b)
        assert sorted(found.slots(a, b).tolist()) == list(range(n))


def test_positions_by_ranges(spark):
    frame = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), F.lit(1).alias("position_of"))
    got = numbered(frame, ["v"], "at", partitions=6).collect()
    assert all(r["at"] == r["v"] for r in got) and len(got) == 1000
