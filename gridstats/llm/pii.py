"""Information-theoretic sanitisation of personal data.

Patterns find the protected entities (base spans). The corpus then tells how strongly a term gives an
entity away: with N documents, c(e) that hold entity e, c(t) that hold term t and c(t, e) that hold
both, at any distance,

    disclosure(t, e) = ln(N c(t, e) / (c(t) c(e))) / ln(N / c(e))

is 0 for independent terms and 1 for a term that occurs with e alone. A term reaching ``GENERALISE``
is replaced by a placeholder wherever it stands in a document that holds e, one reaching ``REMOVE`` is
cut. Counts are over all documents, copies included; a term needs ``SUPPORT`` different surroundings of
e (``REACH`` code points on either side), of different documents or with the term in them, so that
copies of one text are no evidence of their own. Terms too frequent to reach ``GENERALISE`` with an
entity are left out before pairs are made: c(t, e) is c(e) at most, so c(t) may be c(e)^0.8 N^0.2 at
most. Documents without an entity are left as they are.

DataFrame functions only. Defined results: null text counts as empty; an entity in every document
tells nothing, so no term is flagged for it; ties and repeated rows get equal spans; extra columns
are not read. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridstats.llm.common import SPAN, count_of, empty, joined_spans, let, matches, table, whole
from gridstats.operators.scalars import broadcast_within
from gridstats.session import cut_lineage

REACH, SUPPORT, GENERALISE, REMOVE = 64, 2, 0.8, 0.95
TERM = r"\p{L}{3,}"
#: Hexadecimal digits of a text's hash that make its bucket; spans of flagged terms that travel to all tasks.
BUCKET_DIGITS, BROADCAST_SPANS = 5, 1_000_000
KINDS = ("email", "ip", "card", "phone", "term", "cut")
PLACE = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]", "")

# Possessive loops and a look-behind keep long runs linear; the matches are those of the plain patterns.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Checksum of a short digit string: every second digit from the right doubled, nines cast out."""
    places = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        (d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(F.filter(places, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x) % 10 == 0


def is_card(m: Column) -> Column:
    length = F.length(digits(m))
    return F.when(length.between(12, 19), luhn(digits(m))).otherwise(False)


PATTERNS = (
    (EMAIL, None),
    (IP, lambda m: m.rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$")),
    (CARD, is_card),
    (PHONE, lambda m: F.length(digits(m)).between(9, 15)),
)
#: Texts that fail this hold no entity of the kind; cheaper than collecting all short numbers.
GUARDS = (None, None, r"[0-9](?:[\x20-]?[0-9]){11}", None)


def entities(text: Column) -> Column:
    """Base spans, sorted: array of (s, k, e, m)."""

    def of(k: int, pattern: str, keep, guard) -> Column:
        found = matches(text, pattern)
        if keep is not None:
            found = F.filter(found, lambda x: keep(x["m"]))
        if guard is not None:
            found = F.when(text.rlike(guard), found).otherwise(empty(SPAN))
        return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), x["m"].alias("m")))

    return F.array_sort(F.concat(*[of(k, *pattern, guard) for k, (pattern, guard) in enumerate(zip(PATTERNS, GUARDS))]))


def nearby(text: Column, span: Column) -> Column:
    """Terms within reach of a span, with positions; a term cut by the edge of the reach is left out."""
    first = F.greatest(span["s"] - REACH, F.lit(0))
    left, right = F.substr(text, first + 1, span["s"] - first), F.substr(text, span["e"] + 1, F.lit(REACH))

    def terms(part: Column, offset: Column, inside) -> Column:
        return F.transform(F.filter(matches(part, TERM), inside), lambda t: F.struct(
            (t["s"] + offset).alias("s"), (t["e"] + offset).alias("e"), F.lower(t["m"]).alias("t")))

    whole_left = lambda t: (t["s"] > 0) | (first == 0)
    whole_right = lambda t: t["e"] < REACH
    return F.struct(F.xxhash64(left, right).alias("around"),
                    F.concat(terms(left, first, whole_left), terms(right, span["e"], whole_right)).alias("terms"))


def text_hash(text: Column) -> Column:
    """Sixteen bytes of the text's SHA-256."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def term_hashes(text: Column) -> Column:
    """Hashes of the different terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)), lambda t: F.xxhash64(t)))


def find(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Every row's base spans with their surroundings, materialised: ``_key``, ``_base`` and, where there are
    spans, ``_text_hash`` and ``_terms``. The texts themselves are not kept."""
    body = docs.select(F.col(key).alias("_key"), whole(text).alias("_text"))
    found = body.select("_key", "_text", entities(F.col("_text")).alias("_found"))
    spans = F.transform("_found", lambda x: F.struct(
        x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), F.xxhash64(x["k"], F.lower(x["m"])).alias("entity"),
        nearby(F.col("_text"), x).alias("near")))
    some = F.size("_found") > 0
    return cut_lineage(found.select("_key", F.when(some, text_hash(F.col("_text"))).alias("_text_hash"), spans.alias("_base"),
                                    F.when(some, term_hashes(F.col("_text"))).alias("_terms")))


def disclosing(found: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """``_text_hash`` and ``_more``: spans of terms that give an entity of the same text away, materialised.

    Terms, entities and texts are counted by their hashes. Texts are read again only where a term was flagged.
    """
    n = found.count()
    texts = cut_lineage(found.where(F.size("_base") > 0).groupBy("_text_hash")
                        .agg(F.count("*").alias("_copies"), F.first("_base").alias("_base"), F.first("_terms").alias("_terms")))
    each = texts.select("_text_hash", "_copies", F.explode("_base").alias("b"))
    # One surrounding stands for an entity in a text; two that differ (min < max) make SUPPORT.
    held = each.groupBy("_text_hash", F.col("b.entity").alias("entity")).agg(F.first("_copies").alias("_copies"), F.min("b.near.around").alias("around"))
    c_e = cut_lineage(held.groupBy("entity").agg(F.sum("_copies").alias("c_e")).where(F.col("c_e") < n)
                      .withColumn("most", F.pow(F.col("c_e").cast("double"), F.lit(GENERALISE)) * F.lit(float(max(n, 1)) ** (1 - GENERALISE)) * 1.000001))
    held = cut_lineage(held.join(c_e, "entity"))
    # The terms of texts with an entity, each with its number of documents.
    here = texts.select(F.col("_text_hash").alias("_hash"), F.explode("_terms").alias("term"))
    widest = c_e.agg(F.max("most")).first()[0] or 0.0
    everywhere = docs.select(F.explode(term_hashes(whole(text))).alias("term"))
    c_t = cut_lineage(everywhere.groupBy("term").agg(F.count("*").alias("c_t")).where(F.col("c_t") <= F.lit(widest))
                      .join(here.select(F.col("term").alias("again")).distinct(), F.col("term") == F.col("again"), "left_semi"))
    rare = here.join(c_t, "term").select("_hash", "term", "c_t")
    pairs = (rare.join(held, F.col("_hash") == F.col("_text_hash")).where(F.col("c_t") <= F.col("most"))
             .groupBy("entity", "term").agg(F.sum("_copies").alias("c_te"), F.min("around").alias("first"), F.max("around").alias("last"),
                                            F.first("c_t").alias("c_t"), F.first("c_e").alias("c_e")))
    gain = F.log(F.lit(float(n)) * F.col("c_te") / (F.col("c_t") * F.col("c_e")))
    scored = pairs.withColumn("disclosure", gain / F.log(F.lit(float(n)) / F.col("c_e"))).where(F.col("disclosure") >= GENERALISE)
    scored = cut_lineage(scored.select("entity", "term", (F.col("first") < F.col("last")).alias("apart"), F.when(F.col("disclosure") >= REMOVE, F.lit(5)).otherwise(F.lit(4)).alias("k")))
    # Evidence within one text: the term near the entity in different surroundings.
    near = each.select(F.col("b.entity").alias("entity"), F.col("b.near.around").alias("around"), F.explode("b.near.terms.t").alias("t"))
    near = near.groupBy("entity", F.xxhash64("t").alias("term")).agg(F.min("around").alias("a"), F.max("around").alias("b")).where("a < b").select("entity", "term")
    weak = scored.where(~F.col("apart")).join(near, ["entity", "term"], "left_semi")
    flagged = cut_lineage(scored.where("apart").unionByName(weak).select("entity", "term", "k"))
    terms = rare.join(flagged.select("term").distinct(), "term", "left_semi").select("_hash", "term")
    cuts = (terms.join(held.select("_text_hash", "entity"), F.col("_hash") == F.col("_text_hash")).join(flagged, ["entity", "term"])
            .groupBy("_text_hash", "term").agg(F.max("k").alias("k")).groupBy("_text_hash")
            .agg(F.map_from_entries(F.collect_list(F.struct("term", "k"))).alias("_kinds")))
    return marks(cut_lineage(cuts), docs, text)


def marks(cuts: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """``_text_hash`` and ``_more`` of texts with flagged terms (``_kinds``)."""
    bucket = lambda h: F.conv(F.substring(F.hex(h), 1, BUCKET_DIGITS), 16, 10).cast("int")
    # Bounded: 16 ** BUCKET_DIGITS numbers at most. Texts of other buckets go no further than their scan.
    buckets = F.broadcast(cuts.select(bucket(F.col("_text_hash")).alias("_bucket")).distinct())
    bodies = docs.select(whole(text).alias("_text")).withColumn("_hash", text_hash(F.col("_text")))
    bodies = bodies.join(buckets, bucket(F.col("_hash")) == F.col("_bucket"), "left_semi").groupBy("_hash").agg(F.first("_text").alias("_text"))
    whole_texts = bodies.join(cuts, F.col("_hash") == F.col("_text_hash"))
    marked = F.filter(F.transform(matches(F.col("_text"), TERM), lambda t: F.struct(
        t["s"].alias("s"), F.try_element_at("_kinds", F.xxhash64(F.lower(t["m"]))).alias("k"), t["e"].alias("e"))), lambda t: t["k"].isNotNull())
    return cut_lineage(whole_texts.select("_text_hash", F.array_sort(marked).alias("_more")))


def all_spans(found: DataFrame, more: DataFrame) -> DataFrame:
    """``_key``, ``_plain`` (base spans) and ``_spans`` (with flagged terms outside base spans)."""
    plain = F.transform("_base", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    rows = found.select("_key", "_text_hash", plain.alias("_plain"))
    out = rows.where(F.size("_plain") > 0).join(more, "_text_hash", "left")
    out = out.unionByName(rows.where(F.size("_plain") == 0), allowMissingColumns=True)
    return out.select("_key", "_text_hash", "_plain", F.array_sort(F.concat("_plain", clear_of(F.col("_plain"), F.col("_more")))).alias("_spans"))


def clear_of(plain: Column, more: Column) -> Column:
    kept = F.filter(more, lambda t: ~F.exists(plain, lambda b: (b["s"] < t["e"]) & (t["s"] < b["e"])))
    return F.coalesce(kept, empty("struct<s:int,k:int,e:int>"))


def redact(text: Column, spans: Column) -> Column:
    """Text with every span replaced by its placeholder; overlapping spans merge, the first names it."""
    places = F.array(*[F.lit(p) for p in PLACE])

    def merge(acc, x):
        apart = F.array_append(acc, x)
        last = F.element_at(acc, -1)
        grown = F.array_append(F.slice(acc, 1, F.size(acc) - 1), F.struct(last["s"].alias("s"), last["k"].alias("k"), F.greatest(last["e"], x["e"]).alias("e")))
        return F.when(F.size(acc) == 0, apart).when(x["s"] < last["e"], grown).otherwise(apart)

    def pieces(merged):
        def piece(x, i):
            start = F.when(i == 0, F.lit(0)).otherwise(F.try_element_at(merged, F.greatest(i, F.lit(1)))["e"])
            return F.concat(F.substr(text, start + 1, x["s"] - start), places[x["k"]])
        rest = F.substr(text, F.element_at(merged, -1)["e"] + 1, F.length(text))
        return F.concat(F.array_join(F.transform(merged, piece), ""), rest)

    merged = F.aggregate(spans, empty("struct<s:int,k:int,e:int>"), merge)
    return F.when(F.size(spans) > 0, let(merged, pieces)).otherwise(text)


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with redacted text; all rows and columns stay."""
    more = disclosing(find(docs, key, text), docs, text)
    # Base spans are found again in place; only flagged terms travel, to all tasks if they are few.
    more = broadcast_within(more.withColumnsRenamed({"_text_hash": "_marked_hash", "_more": "_marked_more"}), F.size("_marked_more") + 1, BROADCAST_SPANS)
    marked = docs.join(more, text_hash(whole(text)) == F.col("_marked_hash"), "left")
    plain = F.transform(entities(whole(text)), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    clean = let(plain, lambda p: redact(whole(text), F.array_sort(F.concat(p, clear_of(p, F.col("_marked_more"))))))
    return marked.withColumn(text, F.when(F.col(text).isNotNull(), clean)).select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(spans: DataFrame, key: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    counts = [count_of(F.col("_plain"), k).alias(f"n_{KINDS[k]}") for k in range(4)]
    return spans.select(F.col("_key").alias(key), *counts, F.sha2(joined_spans(F.col("_plain"), kinds), 256).alias("base_sha256"),
                        joined_spans(F.col("_spans"), kinds).alias("spans"))


def pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``."""
    docs = table(spark, sf_dir, "documents")
    found = find(docs, "doc_id", "text")
    return digest(all_spans(found, disclosing(found, docs, "text")), "doc_id")
