"""Readers. All are lazy scans with explicit schemas; filters and columns reach the files."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gridstats.functions.columns import nan_to_null, quoted
from gridstats.session import cut_lineage

CLIMATE_SCHEMA = "map<string,struct<temp:array<double>,prec:array<double>>>"


def clean_nan(df: DataFrame) -> DataFrame:
    """NaN to null in every floating-point column: the one place where the two are told apart."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: nan_to_null(f"`{c}`").cast(df.schema[c].dataType) for c in floats}) if floats else df


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: str | T.StructType | None = None) -> DataFrame:
    """CSV with a header. Give a schema at scale: inference reads the files twice."""
    reader = spark.read.option("header", True).option("nanValue", "NaN").option("mode", "PERMISSIVE")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return clean_nan(reader.csv(path))


def read_keyed_csv(spark: SparkSession, path: str, key: str, columns: Mapping[str, str]) -> DataFrame:
    """CSV whose code column stays text, so that leading zeros survive; columns matched by name."""
    raw = spark.read.option("header", True).csv(path)
    picked = [F.col(f"`{key}`")]
    for name, kind in columns.items():
        picked.append((F.col(f"`{name}`").try_cast(kind) if name in raw.columns else F.lit(None).cast(kind)).alias(name))
    return clean_nan(raw.select(*picked))


def header_names(line: str) -> list[str]:
    """Column names of a header line by CSV rules: quotes, blanks around names, byte-order mark."""
    return [n.strip() for n in next(csv.reader([line.lstrip("\ufeff")], skipinitialspace=True), [])]


def first_lines(spark: SparkSession, pattern: str) -> DataFrame:
    """``path`` and ``line``: the first line of each file that is not blank."""
    lines = spark.read.text(pattern).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    # Row ids rise along a file, so the least one of its first block is the first line.
    numbered = lines.where((F.col("start") == 0) & (F.trim("value") != "")).withColumn("row", F.monotonically_increasing_id())
    return numbered.groupBy("path").agg(F.min_by("value", "row").alias("line"))


def read_named_csvs(spark: SparkSession, pattern: str, name_pattern: str, key: str, columns: Mapping[str, str], *,
                    anchor: str, prefix: str | None = None, prefix_length: int = 2) -> DataFrame:
    """Many CSVs whose key is part of the file or directory name; columns a file lacks come out null.

    ``name_pattern`` is a regular expression with one group, ``prefix`` names a column for the
    leading characters of the key. Each file is read by its own header, all of them in one scan: fields
    are read by place, and a table with one row per file says which place holds which column. A file
    whose header lacks the column ``anchor`` is an error that names it; an empty file has no rows.
    """
    files = cut_lineage(first_lines(spark, pattern))
    names = {r["line"]: header_names(r["line"]) for r in files.select("line").distinct().collect()}  # one per different header
    if not names:
        raise FileNotFoundError(f"no file with a header at {pattern}")
    if bad := [line for line, found in names.items() if anchor not in found]:
        paths = sorted(r["path"] for r in files.where(F.col("line").isin(bad)).limit(20).collect())
        raise ValueError(f"no column {anchor} in the header of {', '.join(paths)}")
    places = [(line, [found.index(c) if c in found else None for c in columns]) for line, found in names.items()]
    places = files.join(spark.createDataFrame(places, "line string, places array<int>"), "line").select("path", "places")
    fields = [f"c{i}" for i in range(max(map(len, names.values())))]
    # With a schema of its own the reader drops every file's first line unread.
    raw = spark.read.schema(", ".join(f"{c} string" for c in fields)).option("header", True).option("enforceSchema", True).option(
        "mode", "PERMISSIVE").option("escape", '"').csv(pattern).select(F.array(*fields).alias("fields"), F.col("_metadata.file_path").alias("path"))
    code = F.regexp_extract(F.col("path"), name_pattern, 1)
    picked = [code.alias(key)] + ([F.substring(code, 1, prefix_length).alias(prefix)] if prefix else [])
    for i, (name, kind) in enumerate(columns.items()):
        picked.append(F.get("fields", F.col("places")[i]).try_cast(kind).alias(name))
    return clean_nan(raw.join(places, "path").select(*picked))


def read_table(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """CSV or Parquet by extension."""
    if path.lower().endswith(".csv"):
        return read_csv(spark, path, schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return clean_nan(reader.parquet(path))


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """All Parquet files below a directory, their schemas merged; an empty tree raises."""
    df = spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).option(
        "pathGlobFilter", "*.parquet").parquet(path)
    return clean_nan(df)


def read_partitions(spark: SparkSession, path: str, year: int | Sequence[int] | None = None,
                    month: int | Sequence[int] | None = None) -> DataFrame:
    """Hive-partitioned ``year=/month=`` data; the conditions prune directories. Absent slices are empty."""
    df = spark.read.parquet(path)
    for name, wanted in (("year", year), ("month", month)):
        if wanted is not None:
            df = df.where(F.col(name).isin([wanted] if isinstance(wanted, int) else list(wanted)))
    return clean_nan(df)


def read_flat_layout(spark: SparkSession, path: str) -> DataFrame:
    """``year_Y/month_M`` directories: the partition values come from the path where the file lacks them."""
    df = spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).parquet(path)
    for name in ("year", "month"):
        found = F.regexp_extract(F.col("_metadata.file_path"), rf"/{name}_(\d+)/", 1).try_cast("int")
        df = df.withColumn(name, F.coalesce(F.col(name), found) if name in df.columns else found)
    return clean_nan(df)


def read_climate(spark: SparkSession, path: str) -> DataFrame:
    """Nested JSON document {region: {temp: [...], prec: [...]}} as one map column ``climate``."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.from_json("value", CLIMATE_SCHEMA).alias("climate"))


def read_climatology(spark: SparkSession, path: str, preferred: Sequence[str] = ("ssro", "ro")) -> DataFrame:
    """Long grid table (lat, lon[, month], value): the first preferred variable, else the first other one."""
    df = clean_nan(spark.read.parquet(path)).withColumnsRenamed({"latitude": "lat", "longitude": "lon"})
    axes = [c for c in ("lat", "lon", "month") if c in df.columns]
    rest = [c for c in df.columns if c not in axes]
    name = next((p for p in preferred if p in rest), rest[0])
    return df.select(*axes, F.col(name).cast("double").alias("value"))


def read_pixels(spark: SparkSession, path: str, value: str, box: tuple[float, float, float, float],
                digits: int = 6) -> DataFrame:
    """Pixel table inside (lat_min, lat_max, lon_min, lon_max), no-data dropped, coordinates rounded."""
    df = clean_nan(spark.read.parquet(path)).withColumnsRenamed({"y": "latitude", "x": "longitude"})
    inside = F.col("latitude").between(box[0], box[1]) & F.col("longitude").between(box[2], box[3])
    return df.where(inside & F.col(value).isNotNull()).withColumns({
        "latitude": F.bround("latitude", digits), "longitude": F.bround("longitude", digits)})


def coalesce_column(df: DataFrame, name: str, candidates: Sequence[str]) -> DataFrame:
    """Rename the first candidate that exists."""
    if name in df.columns:
        return df
    for c in candidates:
        if c in df.columns:
            return df.withColumnRenamed(c, name)
    raise ValueError(f"none of {list(candidates)} is a column")


def read_regions(spark: SparkSession, path: str, code: str, candidates: Sequence[str] = (),
                 keep: Sequence[str] | None = None, prefix: int | None = None) -> DataFrame:
    """Region table (region, rings, areasqkm), limited to known codes or code prefixes."""
    df = coalesce_column(spark.read.parquet(path), code, candidates).withColumnRenamed(code, "region")
    if keep is not None:
        tested = F.col("region") if prefix is None else F.substring("region", 1, prefix)
        df = df.where(tested.isin(list(keep)))
    return df


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """Published flux (region, central, lower, upper) with a text code."""
    return read_keyed_csv(spark, path, "region", {"central": "double", "lower": "double", "upper": "double"})


def read_landed_samples(spark: SparkSession, stations_path: str, results_path: str, station: str,
                        start: str | None = None, end: str | None = None, date: str = "ActivityStartDate") -> DataFrame:
    """Landed result files joined to their distinct stations; files may differ in columns."""
    stations, results = read_tree(spark, stations_path), read_tree(spark, results_path)
    stations = stations.dropDuplicates([station])
    if start is not None:
        results = results.where(F.col(date) >= F.lit(start).cast("date"))
    if end is not None:
        results = results.where(F.col(date) <= F.lit(end).cast("date"))
    fresh = [c for c in stations.columns if c not in results.columns or c == station]
    return results.join(stations.select(*quoted(fresh)), station, "left")


def missing_columns(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    return [c for c in wanted if c not in df.columns]


def union_frames(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name of frames whose columns may differ."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
