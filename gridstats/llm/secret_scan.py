"""Secret scan over an incremental blob ledger.

Every version of every path is content-addressed (SHA-256 of the text). A blob is scanned once per
rule version: pairs of blob and rule version that the ledger holds are skipped, new ones are scanned
and appended, and the findings of a blob are joined back to all its paths.

The scan is DataFrame functions only. Rows are (key, text) in any number; extra columns pass through
``findings_for`` untouched because only the named columns are read. Defined results: null text counts
as empty and has no findings; repeated rows and equal texts share one scan and each get the findings;
an empty table gives an empty result. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridstats.llm.common import count_of, empty, joined_spans, matches, table, whole
from gridstats.session import cut_lineage

BLOB, SPANS = "_blob", "_spans"


@dataclass(frozen=True)
class Rule:
    """A pattern under a kind and version; ``keep`` drops matches by their text."""

    kind: str
    version: int
    pattern: str
    keep: object = None

    @property
    def address(self) -> str:
        return f"{self.kind}@{self.version}"


ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

#: Base kinds come first; the order breaks ties between spans with one start.
RULES = (
    Rule("assign", 1, ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6),
    # Runs of one class: asking for the least length inside the pattern finds the same matches.
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
BASE = ("assign", "access", "hex")


def blob_address(text: str | Column) -> Column:
    return F.sha2(whole(text), 256)


def unseen(versions: DataFrame, key: str, text: str, rules=RULES, ledger: DataFrame | None = None) -> DataFrame:
    """One row per blob with rule versions the ledger lacks: ``_blob``, ``_text``, ``_todo``.

    The text of a blob is taken from the row with its smallest key, so texts are shuffled once, on
    (blob, key), and only for blobs with work to do.
    """
    held = versions.select(F.col(key).alias("_key"), whole(text).alias("_text"), blob_address(text).alias(BLOB))
    wanted = F.array(*[F.lit(r.address) for r in rules])
    blobs = held.groupBy(BLOB).agg(F.min("_key").alias("_key"))
    if ledger is None:
        blobs = blobs.withColumn("_todo", wanted)
    else:
        done = ledger.groupBy(F.col("blob").alias(BLOB)).agg(F.collect_set(F.concat_ws("@", "rule", F.col("version").cast("string"))).alias("_done"))
        blobs = (blobs.join(done, BLOB, "left")
                 .withColumn("_todo", F.array_except(wanted, F.coalesce("_done", empty("string")))).drop("_done"))
    blobs = blobs.where(F.size("_todo") > 0)
    blobs = blobs.select(F.col(BLOB).alias("_of"), F.col("_key").alias("_first"), "_todo")
    same = (F.col(BLOB) == F.col("_of")) & F.col("_key").eqNullSafe(F.col("_first"))
    return held.join(blobs, same).select(BLOB, "_text", "_todo")


def scan(blobs: DataFrame, rules=RULES) -> DataFrame:
    """Findings of unseen blobs: ``blob``, ``rule``, ``version``, ``spans`` for each pair scanned."""

    def of(k: int, rule: Rule) -> Column:
        found = matches(F.col("_text"), rule.pattern)
        if rule.keep is not None:
            found = F.filter(found, lambda x: rule.keep(x["m"]))
        spans = F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))
        return F.when(F.array_contains("_todo", rule.address), F.struct(
            F.lit(rule.kind).alias("rule"), F.lit(rule.version).alias("version"), spans.alias("spans")))

    pairs = F.array(*[of(k, r) for k, r in enumerate(rules)])
    # Repeated rows of the key that stands for a blob would count twice, so a blob keeps one scan.
    scanned = blobs.select(BLOB, F.filter(pairs, lambda x: x.isNotNull()).alias("pairs"))
    scanned = scanned.groupBy(BLOB).agg(F.first("pairs").alias("pairs"))
    return scanned.select(F.col(BLOB).alias("blob"), F.inline("pairs"))


def findings_for(versions: DataFrame, key: str, text: str, ledger: DataFrame, rules=RULES) -> DataFrame:
    """``_key`` and sorted ``_spans`` of every version, from the ledger's rows of the current rules."""
    current = F.array(*[F.lit(r.address) for r in rules])
    found = ledger.where((F.size("spans") > 0) & F.array_contains(current, F.concat_ws("@", "rule", F.col("version").cast("string"))))
    per_blob = found.groupBy(F.col("blob").alias(BLOB)).agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias(SPANS))
    # Both sides of the join are plain shuffles, so a blob with very many paths can be split.
    per_blob = cut_lineage(per_blob)
    paths = versions.select(F.col(key).alias("_key"), blob_address(text).alias(BLOB))
    return paths.join(per_blob, BLOB, "left").withColumn(SPANS, F.coalesce(SPANS, empty("struct<s:int,k:int,e:int>")))


def update(spark: SparkSession, versions: DataFrame, key: str, text: str, path: str, rules=RULES) -> DataFrame:
    """Scan what the ledger at ``path`` (a shared folder) lacks, append it, return the whole ledger."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    ledger = spark.read.parquet(path) if files.exists(folder) else None
    scan(unseen(versions, key, text, rules, ledger), rules).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def digest(found: DataFrame, key: str, rules=RULES, base=BASE) -> DataFrame:
    """Counts and span strings of ``findings_for``."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    known = [k for k, r in enumerate(rules) if r.kind in base]
    counts = [count_of(F.col(SPANS), k).alias(f"n_{rules[k].kind}") for k in known]
    basic = F.filter(SPANS, lambda x: x["k"].isin(known))
    return found.select(F.col("_key").alias(key), *counts, F.sha2(joined_spans(basic, kinds), 256).alias("base_sha256"),
                        joined_spans(F.col(SPANS), kinds).alias("spans"))


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``, each document a version of its own path, against an empty ledger."""
    docs = table(spark, sf_dir, "documents")
    ledger = scan(unseen(docs, "doc_id", "text"))
    return digest(findings_for(docs, "doc_id", "text", ledger), "doc_id")


def _positions(kind: str, pattern: str, keep: str) -> str:
    return f"""select doc_id, rid, '{kind}' as kind, f.s as s, f.s + length(f.m) as e from (
  select doc_id, rid, unnest(list_transform(range(1, len(m) + 1), lambda i: {{
      's': list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0),
      'm': m[i]}})) as f
  from (select doc_id, rid, regexp_extract_all(text, '{pattern}') as m, string_split_regex(text, '{pattern}') as p from d)
  where len(m) > 0) where {keep}"""


_ASSIGN_SQL = (r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"
               r"[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)")

SQL = f"""
with d as (select doc_id, row_number() over () as rid, coalesce(text, '') as text from documents),
found as (
{_positions('assign', _ASSIGN_SQL, f"length(regexp_extract(f.m, '{_ASSIGN_SQL}', 2)) >= 6")}
union all
{_positions('access', 'AKIA[A-Z0-9]+', 'length(f.m) >= 20')}
union all
{_positions('hex', '[0-9a-f]{24,}', 'true')}
union all
{_positions('pem', RULES[3].pattern, 'true')}
union all
{_positions('jwt', RULES[4].pattern, 'true')}),
per as (select rid, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
  count(*) filter (kind = 'hex') as n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' order by s, list_position(['assign', 'access', 'hex', 'pem', 'jwt'], kind))
    filter (kind in ('assign', 'access', 'hex')) as base,
  string_agg(kind || ':' || s || ':' || e, ',' order by s, list_position(['assign', 'access', 'hex', 'pem', 'jwt'], kind)) as spans
  from found group by rid)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join per using (rid)
"""
