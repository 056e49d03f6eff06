"""Operators of the subpackage and the pipeline against brute force, and on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridstats.llm import (adaptive_scan, external_shuffle, itq_dedup, langid, mixing, packing, pii, secret_scan,
                           simhash, suffix_dedup)
from gridstats.llm.common import connected_components, matches

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n int, shard string, component int"
#: Null and empty texts, null ids and sources, repeated rows, equal texts, a very long text, clashing column names.
LONG = " ".join(f"word{i % 977} filler" for i in range(60_000))
ROWS = [
    (1, None, "en", "a", None, "k", 1, "s", 1), (2, "", "en", None, 0, None, 1, "s", 1), (3, " \t\n", None, "b", 3, "k", 1, "s", 1),
    (4, "the same words are here again and again", "en", "a", 1, "k", 1, "s", 1), (5, "the same words are here again and again", "en", "b", 1, "k", 1, "s", 1),
    (5, "the same words are here again and again", "en", "b", 1, "k", 1, "s", 1), (6, "ÄÖ 日本 \U0001f600 password = hunter22x mail me@x.org", "de", "a", 1, "k", 1, "s", 1),
    (7, LONG, "en", "a", 1, "k", 1, "s", 1), (None, "no id at all, call +49 (30) 1234-5678", "de", "c", 1, "k", 1, "s", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def texts(df):
    return {r["doc_id"]: r["text"] or "" for r in df.collect()}


def test_matches_are_code_point_positions(spark):
    text = "\U0001f600é ab12 x ab7ab8"
    got = spark.createDataFrame([(text,)], "t string").select(matches(F.col("t"), "ab[0-9]+").alias("m")).first()["m"]
    assert [(r["s"], r["e"], r["m"]) for r in got] == [(m.start(), m.end(), m[0]) for m in re.finditer("ab[0-9]+", text)]


def brute_secrets(text):
    assign = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|(?i:passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans))


def test_secrets_and_ledger(spark, docs, odd, tmp_path):
    for frame in (docs, odd, odd.limit(0)):
        ledger = secret_scan.scan(secret_scan.unseen(frame, "doc_id", "text"))
        got = secret_scan.digest(secret_scan.findings_for(frame, "doc_id", "text", ledger), "doc_id").collect()
        want = Counter((r["doc_id"], hashlib.sha256(brute_secrets(r["text"] or "").encode()).hexdigest()) for r in frame.collect())
        assert Counter((r["doc_id"], r["base_sha256"]) for r in got) == want
    path = str(tmp_path / "ledger")
    first = secret_scan.update(spark, odd, "doc_id", "text", path).count()
    assert first == 6 * len(secret_scan.RULES)  # distinct texts, null as empty
    assert secret_scan.update(spark, odd, "doc_id", "text", path).count() == first
    newer = (secret_scan.Rule("hex", 2, "[0-9a-f]{30,}"), *secret_scan.RULES[3:])
    assert secret_scan.update(spark, odd, "doc_id", "text", path, newer).count() == first + 6


def test_packing_plan_and_tokens(spark, docs, odd):
    random.seed(3)
    lengths = Counter(min(4096, int(random.lognormvariate(6, 1.4)) + 1) for _ in range(5000))
    bins = defaultdict(list)
    places = packing.plan(dict(lengths))
    for length, first, sequence, offset, copies in places.tolist():
        later = [p[1] for p in places.tolist() if p[0] == length and p[1] > first]
        for rank in range(first, min([lengths[length], *later])):
            bins[sequence + (rank - first) // copies].append((offset + (rank - first) % copies * length, length))
    assert sum(map(len, bins.values())) == sum(lengths.values())
    check_sequences(bins)
    assert len(bins) <= 1.05 * sum(k * n for k, n in lengths.items()) / 4096 + 1
    from tokenizers import Tokenizer
    exact = Tokenizer.from_file(packing.default_tokenizer())
    for frame in (docs, odd, odd.limit(0)):
        got = packing.packed_documents(frame).collect()
        bins = defaultdict(list)
        for r in got:
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        check_sequences(bins)
        want = Counter()
        for r in frame.collect():
            ids = np.array(exact.encode(r["text"] or "", add_special_tokens=False).ids + [1], dtype="<u4")
            want.update((r["doc_id"], i // 4096, i, len(ids[i:i + 4096]), zlib.crc32(ids[i:i + 4096].tobytes())) for i in range(0, len(ids), 4096))
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want


def check_sequences(bins):
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
        assert sum(3 * n > 4096 for _, n in parts) <= 2


def test_sharding(docs, odd):
    for frame in (docs, odd, odd.limit(0)):
        got = external_shuffle.sharded(frame).collect()
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
            (r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in frame.collect())
        slots = defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        sizes = [len(slots[s]) for s in range(8)]
        assert max(sizes) - min(sizes) <= 1


def test_external_shuffle_over_many_buckets(spark):
    rows = spark.range(5000).withColumn("w", F.lit(1).cast("long"))
    got = external_shuffle.external_shuffle(rows, 3, 1, "w", bucket_rows=100)
    out = {(r["shard"], r["slot"]): r["id"] for r in got.collect()}
    assert len(out) == 5000 and sorted(out.values()) == list(range(5000))
    order = [out[k] for k in sorted(out)]
    assert np.corrcoef(order, range(5000))[0, 1] < 0.1


def brute_vector_links(vectors, least):
    ids = [i for i, v in vectors if v is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = np.array([v for i, v in vectors if i in set(ids)])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= least
    np.fill_diagonal(near, False)
    return ids, near


def test_embedding_links(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 32))
    rows = [(i, (base[i % 40] + 0.12 * rng.standard_normal(32)).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)]
    rows += [(2000, None), (2001, [0.0] * 32), (2002, [float("nan")] * 32), (2003, [None] * 32), (2004, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("key", F.lit("x"))
    got = {r["key"]: r for r in itq_dedup.near_duplicates(frame).collect()}
    ids, near = brute_vector_links([r for r in rows if r[0] < 2000], 0.9)
    found = sum(got[i]["n_links"] for i in ids)
    assert 0.97 * near.sum() <= found <= near.sum()
    assert all(got[i]["n_links"] <= n for i, n in zip(ids, near.sum(axis=1)))
    assert all((got[i]["n_links"], got[i]["component_id"]) == (0, i) for i in range(2000, 2005))
    assert itq_dedup.near_duplicates(frame.limit(0)).count() == 0


@pytest.mark.parametrize("offset", [0.0, 1.2, 2.5])
def test_embedding_links_with_a_common_direction(spark, offset):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 64)) + offset * np.sign(rng.standard_normal(64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = rng.standard_normal((1500, 64))
    off -= (off * x).sum(axis=1, keepdims=True) * x
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    near = rng.uniform(0.9, 0.93, (1500, 1))
    rows = list(enumerate(np.concatenate([x, near * x + np.sqrt(1 - near ** 2) * off]).tolist()))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["key"]: r["n_links"] for r in itq_dedup.near_duplicates(frame).collect()}
    ids, links = brute_vector_links(rows, 0.9)
    assert links.sum() >= 2900 and [got[i] for i in ids] == links.sum(axis=1).tolist()


@pytest.mark.parametrize("offset", [0.0, 1.2, 2.0])
def test_embedding_tables_recall(spark, offset):
    """Pairs little above the least cosine, with and without a common direction; none is invented."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 64)) + offset * np.sign(rng.standard_normal(64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = rng.standard_normal((1500, 64))
    off -= (off * x).sum(axis=1, keepdims=True) * x
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    near = rng.uniform(0.9, 0.93, (1500, 1))
    rows = list(enumerate(np.concatenate([x, near * x + np.sqrt(1 - near ** 2) * off]).tolist()))
    got = {r["key"]: r for r in itq_dedup.near_duplicates_by_tables(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    ids, links = brute_vector_links(rows, 0.9)
    want = dict(zip(ids, links.sum(axis=1)))
    assert sum(r["n_links"] for r in got.values()) >= 0.98 * links.sum()
    assert all(got[i]["n_links"] <= want[i] and got[i]["component_id"] <= i for i in want)


def test_embedding_tables_split_cells(spark, monkeypatch):
    """A dense group of a third of all rows, equal codes, copies, odd vectors and clashing names; cells in many slices."""
    monkeypatch.setattr(itq_dedup, "SLICE", 60)
    monkeypatch.setattr(itq_dedup, "PART", 16)
    rng = np.random.default_rng(6)
    hot, base = rng.standard_normal(32), rng.standard_normal((60, 32))
    rows = [(i, (base[i % 60] + 0.1 * rng.standard_normal(32)).tolist()) for i in range(240)]
    rows += [(1000 + i, (hot + 0.02 * rng.standard_normal(32)).tolist()) for i in range(120)]
    rows += [(1200 + i, rows[0][1]) for i in range(25)] + [((1 << 60) + 1, rows[5][1])]
    odd = [(2000, None), (2001, [0.0] * 32), (2002, [float("nan")] * 32), (2003, [None] * 32), (2004, []), (2005, [1.0])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    clash = frame.select("*", *[F.lit(1).alias(c) for c in ("key", "n", "v", "low", "high", "cell", "part", "i", "j", "packed", "several")])
    got = {r["key"]: (r["n_links"], r["component_id"]) for r in itq_dedup.near_duplicates_by_tables(clash).collect()}
    want = {r["key"]: (r["n_links"], r["component_id"]) for r in itq_dedup.near_duplicates(frame).collect()}
    assert got.keys() == want.keys() and sum(n for n, _ in got.values()) >= 0.99 * sum(n for n, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in got) and all(got[i] == (119, 1000) for i in range(1000, 1120))
    assert all(got[i] == (0, i) for i in range(2000, 2006)) and got[(1 << 60) + 1][0] == got[5][0]
    assert itq_dedup.near_duplicates_by_tables(frame.limit(0)).count() == 0
    assert [r["n_links"] for r in itq_dedup.near_duplicates_by_tables(frame.where("vec_id = 1001")).collect()] == [0]
    assert [r["n_links"] for r in itq_dedup.near_duplicates_by_tables(frame.where("vec_id >= 1200 and vec_id < 1225")).collect()] == [24] * 25


def test_calibrated_tables_widen_with_the_input():
    rng = np.random.default_rng(8)
    sample = rng.standard_normal((3000, 64))
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    mean, projections = itq_dedup.rotations(sample)
    tables = [itq_dedup.calibrate(sample, mean, projections, n, 0.9) for n in (10 ** 3, 10 ** 5, 10 ** 7)]
    widths = [t.width for t, _ in tables]
    assert widths == sorted(widths) and widths[0] < widths[-1] and all(blurred < 0.005 for _, blurred in tables)


def test_pairs_meet_once():
    """Codes whose substrings differ in two bits at most count under one value of one table."""
    tables = itq_dedup.Tables(4, 16, 1, 96)
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64))
    for x, y in zip(a, b):
        met = 0
        for t in range(4):
            for value in np.intersect1d(itq_dedup.substrings(np.array([x]), t, tables), itq_dedup.substrings(np.array([y]), t, tables)):
                met += int(itq_dedup.meets(np.array([x]), np.array([y]), t, value, tables)[0])
        assert met == 1


def test_adaptive_scan_recall(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").withColumn("list", F.lit(1))
    rows = frame.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=np.float64)
    found = defaultdict(list)
    for r in adaptive_scan.search(frame, "vec_id", "embedding", F.col("key") % 20 == 0).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hit = 0
    for i in np.flatnonzero(ids % 20 == 0):
        score = x @ x[i]
        score[i] = -np.inf
        best = set(ids[np.lexsort((ids, -score))[:20]].tolist())
        mine = sorted(found[int(ids[i])])
        assert [m[0] for m in mine] == list(range(1, 21))
        assert all(abs(s - x[np.flatnonzero(ids == v)[0]] @ x[i]) < 1e-12 for _, v, s in mine)
        hit += len(best & {m[1] for m in mine})
    assert hit / (20 * len(found)) >= 0.9


def test_adaptive_scan_small_and_odd(spark):
    rows = [(i, [1.0, float(i)]) for i in range(5)] + [(20, None), (40, [0.0, 0.0]), (60, [float("inf"), 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in adaptive_scan.search(frame, "vec_id", "embedding", F.col("key") % 20 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 1.0), (0, 4, 4, 1.0)]
    assert adaptive_scan.search(frame.limit(0), "vec_id", "embedding", F.col("key") % 20 == 0).count() == 0


def luhn(number):
    digits = [int(c) for c in reversed(number)]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def brute_pii(text):
    bare = lambda m: re.sub("[^0-9]", "", m)
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(bare(m[0])) <= 19 and luhn(bare(m[0]))]
    spans += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(bare(m[0])) <= 15]
    return ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{s}:{e}" for s, k, e in sorted(spans))


def test_pii_base_spans(spark, docs, odd):
    tricky = ["a@b.c%d@e.f x@y@z.com", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4", "4785380592391139 4785-3805 9239-1139", "9" * 30_000, "+1 (23) 456-78.90- +12", "1" * 11 + " 4"]
    extra = spark.createDataFrame([(100 + i, t) for i, t in enumerate(tricky)], "doc_id long, text string")
    for frame in (docs, odd, extra, odd.limit(0)):
        found = pii.find(frame, "doc_id", "text")
        got = pii.digest(pii.all_spans(found, pii.disclosing(found, frame, "text")), "doc_id").collect()
        want = Counter((r["doc_id"], hashlib.sha256(brute_pii(r["text"] or "").encode()).hexdigest()) for r in frame.collect())
        assert Counter((r["doc_id"], r["base_sha256"]) for r in got) == want


def test_disclosing_terms_go(spark):
    rows = [(i, f"note {i} about zanzibar from me@corp.org in town number {'abc'[i % 3] * 4} of the year", "en", "a", 1) for i in range(4)]
    rows += [(10 + i, f"note about the town of the year {i}", "en", "a", 1) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = texts(pii.sanitise(frame))
    assert all("zanzibar" not in out[i] and "[EMAIL]" in out[i] and "me@corp.org" not in out[i] and "about" in out[i] for i in range(4))
    assert all(out[r[0]] == r[1] for r in rows[4:])


def test_disclosing_terms_go_at_any_distance(spark):
    pad = "of the year and of the town " * 5
    rows = [(i, f"note {'abcd'[i] * 4} from me@corp.org {pad if i else ''}zanzibar {pad}ends in Zanzibar", "en", "a", 1) for i in range(4)]
    rows += [(10 + i, f"note from the town of the year and ends in {i}", "en", "a", 1) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = texts(pii.sanitise(frame))
    assert all("zanzibar" not in out[i].lower() and "[EMAIL]" in out[i] and "ends in" in out[i] for i in range(4))
    assert all(out[r[0]] == r[1] for r in rows[4:])


def test_mixing_targets_and_reruns(docs, odd):
    for frame in (docs, odd, odd.limit(0)):
        drawn = mixing.draws(frame, "doc_id", "source", "text").cache()
        rows = drawn.select("_source", "_size", "_target", "_source_size", "_draws", mixing.taken("_draws").alias("taken")).collect()
        assert len(rows) == frame.count()
        got, target, size = Counter(), {}, {}
        for r in rows:
            assert 0 <= r["taken"] <= 3 * r["_size"]
            got[r["_source"]] += r["taken"]
            target[r["_source"]], size[r["_source"]] = r["_target"], r["_source_size"]
        assert target == pytest.approx(brute_targets(size))
        assert all(abs(got[s] - t) <= 3 * mixing.BLOCK_WORDS for s, t in target.items())
        again = mixing.draws(frame.repartition(7), "doc_id", "source", "text").collect()
        assert sorted(map(str, again)) == sorted(map(str, drawn.collect()))


def test_splitting_tree_is_exact(spark):
    """Leaves add up to every source's quota and to equal shards, for any number of shards; halves follow the law."""
    for quotas, shards in (([1000, 37, 0, 5, 12_345], 8), ([7, 1], 5), ([64], 3), ([3, 3], 1), ([0, 0], 4)):
        frame = spark.createDataFrame(list(enumerate(quotas)), "_rank int, _quota long")
        leaves = mixing.split_quotas(frame, shards, 7).collect()
        per_source, per_shard = Counter(), Counter()
        for r in leaves:
            assert r["_blocks"] >= 0
            per_source[r["_rank"]] += r["_blocks"]
            per_shard[r["shard"]] += r["_blocks"]
        assert all(per_source[i] == q for i, q in enumerate(quotas)) and set(per_shard) == set(range(shards))
        assert max(per_shard.values()) - min(per_shard.values()) <= (shards - 1).bit_length()
    frame = spark.createDataFrame([(0, 30), (1, 30)], "_rank int, _quota long")
    first = [next(r["_blocks"] for r in mixing.split_quotas(frame, 2, seed).collect() if (r["shard"], r["_rank"]) == (0, 0)) for seed in range(12)]
    assert len(set(first)) > 3 and abs(sum(first) / 12 - 15) < 4 * (30 * 0.25 * 30 / 59 / 12) ** 0.5


def test_shards_of_the_mix(docs, odd):
    """Every word of a pass goes to one shard at most, shards take what the tree gives them, and local order is by shard."""
    for frame in (docs, odd, odd.limit(0)):
        drawn = mixing.draws(frame, "doc_id", "source", "text").cache()
        blocks = Counter()
        for r in drawn.select("*", mixing.by_shard("_draws").alias("shards")).collect():
            seen, words = Counter(), Counter()
            for d in r["_draws"]:
                assert 0 <= d["lo"] < d["hi"] <= r["_size"] and 0 <= d["shard"] < mixing.SHARDS
                words[d["shard"]] += d["hi"] - d["lo"]
                blocks[r["_source"], d["shard"]] += d["hi"] - d["lo"]
                for place in range(d["lo"], d["hi"]):
                    seen[d["round"], place] += 1
            assert all(n == 1 for n in seen.values())
            assert r["shards"] == ",".join(f"{s}:{n}" for s, n in sorted(words.items()))
        plan = mixing.plan(mixing.units(frame, "doc_id", "source", "text")).collect()
        for r in plan:
            short = -r["_of"] % mixing.BLOCK_WORDS * (mixing.MOST_PASSES + 1)
            for run in r["_runs"]:
                want = (run["hi"] - run["lo"]) * mixing.BLOCK_WORDS
                assert want - short <= blocks[r["_source"], run["shard"]] <= want
            assert [run["lo"] for run in r["_runs"]] == [0, *[run["hi"] for run in r["_runs"]][:-1]] and r["_runs"][-1]["hi"] == r["_quota"]
        local = mixing.local_shuffle(drawn).collect()
        assert Counter((r["_source"], r["shard"]) for r in local).keys() == blocks.keys()
        assert sum(r["hi"] - r["lo"] for r in local) == sum(blocks.values())


def brute_targets(size):
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(size.values()), set()
    while True:
        left = total - sum(3 * size[s] for s in capped)
        room = sum(weight[s] for s in order if s not in capped)
        target = {s: 3.0 * size[s] if s in capped else left * weight[s] / room for s in order}
        over = {s for s in order if s not in capped and target[s] > 3 * size[s]}
        if not over:
            return target
        capped |= over


def test_hypergeometric_law(spark):
    drawn = spark.range(20_000).select(mixing.hypergeometric(F.lit(60), F.lit(25), F.lit(12), (F.col("id") + 0.5) / 20_000).alias("x"))
    n = {r["x"]: r["count"] for r in drawn.groupBy("x").count().collect()}
    from math import comb
    assert all(abs(n.get(k, 0) / 20_000 - comb(25, k) * comb(35, 12 - k) / comb(60, 12)) < 2e-3 for k in range(13))


def test_repeated_passages(spark, docs, odd):
    for frame in (docs, odd, odd.limit(0)):
        held = {i: t.encode().split() for i, t in texts(frame.where("doc_id is not null")).items()}
        where = defaultdict(set)
        for i, w in held.items():
            for a in range(len(w) - 49):
                where[tuple(w[a:a + 50])].add(i)
        want = {(i, p) for i, w in held.items() for a in range(len(w) - 49) if len(where[tuple(w[a:a + 50])]) > 1 for p in range(a, a + 50)}
        got = {(r["doc"], p) for r in suffix_dedup.passages(frame.where("doc_id is not null")).collect() for p in range(r["lo"], r["hi"])}
        assert got == want


def test_repeated_passages_behind_common_seeds(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.getrandbits(40)}"
    line = [word() for _ in range(45)]
    rows = [(i, [word() for _ in range(8)] + line + [word() for _ in range(10)]) for i in range(600)]
    # The same left words for two documents far apart in the order of right contexts.
    shared = [word() for _ in range(12)]
    rows += [(1000 + i, shared + line + [f"{'az'[i]}{word()}" for _ in range(10)]) for i in range(2)]
    # One document repeats a passage more often than the other.
    passage = [word() for _ in range(60)]
    rows += [(2000, [w for _ in range(12) for w in [*passage, word()]]), (2001, [word(), *passage])]
    where = defaultdict(set)
    for i, w in rows:
        for a in range(len(w) - 49):
            where[tuple(w[a:a + 50])].add(i)
    want = {(i, p) for i, w in rows for a in range(len(w) - 49) if len(where[tuple(w[a:a + 50])]) > 1 for p in range(a, a + 50)}
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {(r["doc"], p) for r in suffix_dedup.passages(frame).collect() for p in range(r["lo"], r["hi"])}
    assert {i for i, _ in want} == {1000, 1001, 2000, 2001} and got == want


def brute_components(prints, linked):
    root = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if linked(prints[a], prints[b]) and root[a] != root[b]:
                    low = min(root[a], root[b])
                    root[a] = root[b] = low
                    changed = True
    return root


def test_simhash(docs, odd):
    from xxhash import xxh64_intdigest

    def brute(text):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if x]
        hashes = [xxh64_intdigest(" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    for frame in (docs, odd.where("doc_id is not null"), odd.limit(0)):
        prints = {i: brute(t) for i, t in texts(frame).items()}
        root = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 2)
        got = simhash.near_duplicates(frame).collect()
        assert len(got) == frame.count()
        assert all((r["print"] & (1 << 64) - 1, r["component"]) == (prints[r["key"]], root[r["key"]]) for r in got)


def test_large_shards_are_split(spark):
    random.seed(2)
    prints = {i: random.getrandbits(12) | (i % 3) << 40 for i in range(300)}
    frame = spark.createDataFrame(list(prints.items()), "id long, print long").dropDuplicates(["print"])
    held = {r["id"]: r["print"] for r in frame.collect()}
    roots = {r["node"]: r["root"] for r in connected_components(simhash.links(frame, tree=16)).collect()}
    want = brute_components(held, lambda a, b: (a ^ b).bit_count() <= 2)
    assert all(roots.get(i, i) == r for i, r in want.items())


def test_components_of_a_chain(spark):
    edges = spark.range(60).select((F.col("id") + 1).alias("a"), F.col("id").alias("b"))
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(61)}
    assert connected_components(edges.limit(0)).count() == 0


def test_language(spark, docs, odd):
    told = {r["doc_id"]: r["lang"] for r in docs.collect()}
    blind = langid.identify(docs, "doc_id", "text", F.lit(None), F.lit(None), F.col("source"), "lang", fit_rows=100)
    rows = blind.collect()
    assert sum(r["language"] == told[r["key"]] for r in rows) >= 0.98 * len(rows)
    assert all(r["kept"] for r in langid.of_documents(docs).collect())
    got = langid.of_documents(docs.select("doc_id", "text", "lang", "source").unionByName(odd.select("doc_id", "text", "lang", "source"))).collect()
    assert len(got) == docs.count() + len(ROWS)
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    assert langid.of_pages(pages).where("kept").count() == pages.count()
    assert langid.of_documents(odd.limit(0)).count() == 0


def test_rare_language_is_fitted(spark):
    rng = random.Random(10)
    def say(letters):
        return " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(30))
    rows = [(i, say("etaoinsr"), "en", "hot") for i in range(20_000)]
    rows += [(50_000 + i, say("\u03b1\u03b2\u03b3\u03b4\u03b5\u03b6"), "el", "rare") for i in range(2)]
    rows += [(90_000, rows[0][1], "en", "hot")] * 15_000  # one row over and over
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["key"]: r for r in langid.of_documents(frame).where("key >= 50000").distinct().collect()}
    assert all(got[50_000 + i]["language"] == "el" and got[50_000 + i]["kept"] for i in range(2))
    assert got[90_000]["language"] == "en" and got[90_000]["kept"]


def test_near_dedup_tells_texts_of_an_id_apart(spark):
    near = "the quick brown fox jumps over the lazy dog and runs into the wide green woods"
    rows = [(1, near, "en", "a", 1), (2, near, "en", "a", 1), (2, "an unrelated text about ships, harbours and their cranes in winter", "en", "a", 1),
            (3, "first text of three: how to bake bread without an oven", "en", "a", 1), (3, "second text of three: a short history of northern railways", "en", "a", 1),
            (3, "second text of three: a short history of northern railways", "en", "a", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, frame, SF_DIR).collect())
    assert got == sorted({(r[0], r[1]) for r in rows if (r[0], r[1]) != (2, near)})


def test_pipeline_stages(spark, docs):
    frame = docs.select("doc_id", "text", "lang", "source", "n_chars")
    near = {r["key"]: r["component"] for r in simhash.near_duplicates(frame).collect()}
    out = frame
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out, before = stage(spark, out, SF_DIR).cache(), out
        assert out.columns == frame.columns and out.count() > 0
        if name == "language_id":
            assert texts(out) == texts(before)
        if name == "simhash_dedup":
            assert {r["doc_id"] for r in out.collect()} == set(near.values())
        if name == "pii":
            assert all(not brute_pii(t) or "[" in t for t in texts(out).values()) and out.count() == before.count()
        if name == "mixing":
            n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
            size, got = Counter(), Counter()
            for r in before.collect():
                size[r["source"]] += n(r["text"])
            for r in out.collect():
                got[r["source"]] += n(r["text"])
            assert all(abs(got[s] - t) <= 3 * mixing.BLOCK_WORDS for s, t in brute_targets(size).items())
    assert corpus_pipeline.run(spark, SF_DIR).count() >= out.count()


def test_pipeline_stages_on_odd_and_empty_rows(spark, docs, odd):
    for frame in (odd.where("doc_id is not null"), odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, frame, SF_DIR).columns == frame.columns
            stage(spark, frame, SF_DIR).collect()


# Ids past 2^53 next to a null, clashing names, very large parts, repeated ids.

BIG = (1 << 60) + 1


def big_ids(spark):
    rows = [(BIG, "one text of some words", "en", "a"), (None, "a text without an id", "en", "a"), (BIG + 1, "one text of some words", "en", "a"), (BIG + 2, "tout autre chose", "fr", "b")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1)


def test_large_ids_next_to_null(spark):
    frame, ids = big_ids(spark), {BIG, BIG + 1, BIG + 2, None}
    assert {r["doc_id"] for r in packing.packed_documents(frame).collect()} == ids
    found = {r["key"]: r for r in simhash.near_duplicates(frame).collect()}
    assert set(found) == ids and found[BIG + 1]["component"] == BIG and found[None]["component"] is None
    assert {r["key"] for r in langid.of_documents(frame).collect()} == ids


def test_passages_of_documents_without_id(spark):
    shared = " ".join(f"w{i}" for i in range(60))
    rows = [(None, f"start {shared} end"), (None, f"other {shared} tail"), (BIG, f"{shared} x"), (-(1 << 63), "short")]
    got = {(r["doc"], r["lo"], r["hi"]) for r in suffix_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(None, 1, 61), (BIG, 0, 60)}


def test_shuffle_keeps_clashing_names(spark):
    rows = spark.range(50).select("id", F.lit("s").alias("shard"), F.lit(1.5).alias("slot"), F.lit(7).alias("_row"), F.lit(8).alias("_bucket"), F.lit(9).alias("_at"))
    got = external_shuffle.external_shuffle(rows, 4, 1, F.lit(1), bucket_rows=7)
    assert sorted(got.columns) == ["_at", "_bucket", "_row", "id", "shard", "shard_before", "slot", "slot_before"]
    found = got.collect()
    assert sorted(r["id"] for r in found) == list(range(50)) and {(r["shard_before"], r["slot_before"], r["_at"]) for r in found} == {("s", 1.5, 9)}
    assert sorted((r["shard"], r["slot"]) for r in found) == sorted((i % 4, i // 4) for i in range(50))


def brute_search(rows, k):
    out = {}
    with np.errstate(over="ignore", invalid="ignore"):
        for q in sorted({i for i, _ in rows if i % 20 == 0}):
            v = np.array(min(x for i, x in rows if i == q))
            scores = sorted((-float((v * np.array(x)).sum()), i) for i, x in rows if i != q)[:k]
            out[q] = [(i, -s) for s, i in scores]
    return out


@pytest.mark.parametrize("scale", [1.0, 1e160, 1e-160])
def test_nearest_with_repeated_ids_and_extreme_parts(spark, scale):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 12))
    rows = [(i, (v * (scale if i == 33 else 1.0)).tolist()) for i, v in enumerate(x)] + [(40, x[40].tolist()), (40, x[41].tolist()), (55, x[55].tolist())]
    frame = spark.createDataFrame([*rows, (None, x[0].tolist())], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in adaptive_scan.search(frame, "vec_id", "embedding", F.col("key") % 20 == 0, 10).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    want = brute_search(rows, 10)
    assert set(got) == set(want) and all([r for r, _, _ in sorted(v)] == list(range(1, 11)) for v in got.values())
    hits = sum(len({i for _, i, _ in got[q]} & {i for i, _ in want[q]}) / len({i for i, _ in want[q]}) for q in want) / len(want)
    assert hits >= 0.9
    for q, found in got.items():
        assert all(s == pytest.approx(dict(want[q])[i]) for _, i, s in found if i in dict(want[q]) and i != 40)


def test_nearest_in_two_levels_of_lists(spark, monkeypatch):
    monkeypatch.setattr(adaptive_scan, "LIST_ROWS", 16)
    monkeypatch.setattr(adaptive_scan, "COARSE", 8)
    rng = np.random.default_rng(9)
    x = rng.standard_normal((60, 24))[rng.integers(0, 60, 3000)] + 0.2 * rng.standard_normal((3000, 24))
    frame = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    found = defaultdict(set)
    for r in adaptive_scan.search(frame, "vec_id", "embedding", F.col("key") % 20 == 0, 20).collect():
        found[r["query_id"]].add(r["vec_id"])
    recall = np.mean([len(found[q] & {int(i) for i in np.argsort(-(x @ x[q]))[:21] if i != q}) / 20 for q in range(0, 3000, 20)])
    assert recall >= 0.9 and all(len(v) == 20 for v in found.values())


def test_links_of_very_large_and_small_parts(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((20, 8))
    rows = [(i, (v * s).tolist()) for i, (v, s) in enumerate(zip(np.repeat(x, 3, axis=0), [1.0, 1e200, 1e-200] * 20))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["key"]: (r["n_links"], r["component_id"]) for r in itq_dedup.near_duplicates(frame).collect()}
    assert all(got[i][0] >= 2 and got[i][1] <= i // 3 * 3 for i in got)


def test_language_posteriors_against_brute_force(docs):
    """Likelihoods, hierarchical priors, declared evidence and the reject rule, computed anew from the fitted model."""
    rows = docs.select(F.col("doc_id").alias("key"), "text", F.col("lang").alias("label"), F.col("lang").alias("declared"),
                       F.lit(None).cast("string").alias("suffix"), F.col("source").alias("host"), F.xxhash64("text").cast("string").alias("text_hash"))
    model = langid.fit(rows, "text", "label", F.xxhash64("text_hash"))
    got = {r["key"]: r for r in langid.fuse(langid.cut_lineage(langid.scores(rows, "key", "text", ["declared", "suffix", "host", "text_hash"], model)), model).collect()}
    held = rows.collect()
    k = len(model.languages)
    logs = np.array([[row[langid.trigrams(r["text"] or "")].sum(dtype=np.float64) for row in model.logs] for r in held])
    n = np.array([len(langid.trigrams(r["text"] or "")) for r in held])
    softmax = lambda v: np.exp(v - v.max(axis=1, keepdims=True)) / np.exp(v - v.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)
    share = softmax(logs * langid.TEMPER)
    heard = n > 0
    smooth = lambda v, base, rows_: (v + rows_ * base) / (v.sum() + rows_)
    world = smooth(share[heard].sum(axis=0), np.full(k, 1 / k), 1.0)
    suffix = smooth(share[heard].sum(axis=0), world, langid.SUFFIX_ROWS)
    total = share[heard].sum(axis=0)
    for i, r in enumerate(held):
        host = np.array([heard[j] and held[j]["host"] == r["host"] for j in range(len(held))])
        told = np.array([heard[j] and held[j]["declared"] == r["declared"] for j in range(len(held))])
        prior = smooth(share[host].sum(axis=0), suffix, langid.HOST_ROWS)
        said = (share[told].sum(axis=0) + langid.DECLARED_ROWS) / (total + langid.DECLARED_ROWS * 20)
        posterior = softmax((logs[i] * langid.TEMPER + np.log(prior) + np.log(said))[None])[0]
        out = got[r["key"]]
        assert out["confidence"] == pytest.approx(posterior.max(), rel=1e-6)
        if n[i]:
            assert out["language"] == model.languages[int(posterior.argmax())] or np.sort(posterior)[-2] == pytest.approx(posterior.max())
        unlike = n[i] >= langid.JUDGED and logs[i].max() / n[i] < model.floor
        assert out["kept"] == bool(n[i] > 0 and posterior.max() >= 0.5 and not unlike) or posterior.max() == pytest.approx(0.5)
