"""Layouts that the registered queries do not write themselves."""

import pytest

from gridstats.sources import readers, writers


def test_partition_values_from_flat_paths(spark, tmp_path):
    for y, m in ((1999, 1), (1999, 12), (2000, 3)):
        spark.createDataFrame([(float(m),)], "v double").write.parquet(f"{tmp_path}/year_{y}/month_{m}")
    rows = {(r["year"], r["month"], r["v"]) for r in readers.read_flat_layout(spark, str(tmp_path)).collect()}
    assert rows == {(1999, 1, 1.0), (1999, 12, 12.0), (2000, 3, 3.0)}


def test_partition_filters_reach_the_scan(spark, tmp_path):
    df = spark.createDataFrame([(2000, 1, 1.0), (2000, 2, 2.0), (2001, 1, float("nan"))], "year int, month int, v double")
    writers.write_partitions(df, str(tmp_path))
    slice_ = readers.read_partitions(spark, str(tmp_path), 2001)
    plan = slice_._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    assert [r["v"] for r in slice_.collect()] == [None]
    assert readers.read_partitions(spark, str(tmp_path), 1990).count() == 0


def test_files_with_other_column_order(spark, tmp_path):
    (tmp_path / "final_0101.csv").write_text("id,w,extra\n1,2.5,x\n")
    (tmp_path / "final_0202.csv").write_text("w,id\n7.5,3\n")
    (tmp_path / "final_0303.csv").write_text("id\n9\n")
    df = readers.read_named_csvs(spark, f"{tmp_path}/final_*.csv", r"final_(\d+)\.csv", "inner", {"id": "bigint", "w": "double"}, anchor="id", prefix="outer")
    assert {tuple(r) for r in df.collect()} == {("0101", "01", 1, 2.5), ("0202", "02", 3, 7.5), ("0303", "03", 9, None)}


def test_empty_tree_raises(spark, tmp_path):
    with pytest.raises(Exception):
        readers.read_tree(spark, str(tmp_path / "none")).count()


def test_data_line_like_a_header_is_data(spark, tmp_path):
    (tmp_path / "final_0102.csv").write_text("id,w\n1,2.5\nid,7\n3,4.5\n")
    df = readers.read_named_csvs(spark, f"{tmp_path}/final_*.csv", r"final_(\d+)\.csv", "inner", {"id": "string", "w": "double"}, anchor="id")
    assert sorted((r["id"], r["w"]) for r in df.collect()) == [("1", 2.5), ("3", 4.5), ("id", 7.0)]


def test_unreadable_table_is_left_alone(spark, tmp_path):
    from gridstats.sources import writers
    folder = tmp_path / "kept"
    folder.mkdir()
    (folder / "part-0.parquet").write_text("not a table")
    with pytest.raises(Exception):
        writers.cached_table(spark, str(folder), lambda: spark.range(3)).collect()
    assert (folder / "part-0.parquet").read_text() == "not a table"


def test_headers_by_csv_rules(spark, tmp_path):
    (tmp_path / "final_0101.csv").write_text('"id","w","note"\n1,2.5,"a, ""b"""\n2,,x\n')
    (tmp_path / "final_0202.csv").write_bytes(b"\xef\xbb\xbfid, w\r\n3,4.5\r\n")
    (tmp_path / "final_0303.csv").write_text('\n w ,"id"\n7.5,4\n')
    (tmp_path / "final_0404.csv").write_text("")
    read = lambda: readers.read_named_csvs(
        spark, f"{tmp_path}/final_*.csv", r"final_(\d+)\.csv", "code", {"id": "bigint", "w": "double", "note": "string"}, anchor="id")
    df = read()
    assert {tuple(r) for r in df.collect()} == {("0101", 1, 2.5, 'a, "b"'), ("0101", 2, None, "x"), ("0202", 3, 4.5, None), ("0303", 4, 7.5, None)}
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    (tmp_path / "final_0505.csv").write_text("other,w\n1,2\n")
    with pytest.raises(ValueError, match="final_0505.csv"):
        read()


def test_crashed_build_is_built_again(spark, tmp_path):
    path = tmp_path / "table"
    (path / "_temporary" / "0").mkdir(parents=True)
    assert not writers.present(spark, str(path))
    with pytest.raises(ZeroDivisionError):
        writers.cached_table(spark, str(path), lambda: spark.range(1 // 0))
    with pytest.raises(Exception):
        writers.cached_table(spark, str(path), lambda: spark.range(3).selectExpr("raise_error('lost') as x"))
    assert not writers.present(spark, str(path)) and [p.name for p in tmp_path.iterdir()] == ["table"]
    assert writers.cached_table(spark, str(path), lambda: spark.range(3)).count() == 3
    assert writers.cached_table(spark, str(path), lambda: spark.range(9)).count() == 3
    assert writers.cached_table(spark, str(tmp_path / "t.csv"), lambda: spark.range(4)).count() == 4
    # An empty table that was written is a table.
    writers.cached_table(spark, str(tmp_path / "none"), lambda: spark.range(0))
    assert writers.cached_table(spark, str(tmp_path / "none"), lambda: spark.range(9)).count() == 0


def test_resume_reads_directory_names_only(spark, tmp_path):
    path = str(tmp_path / "parts")
    rows = spark.createDataFrame([(2000, "a b/c=d", 1), (None, "e", 2), (2001, "f%", 3)], "year int, name string, v int")
    writers.write_partitions(rows.where("v < 3"), path, ["year", "name"])
    for part in (tmp_path / "parts").rglob("*.parquet"):
        part.write_text("no table any more")
    left = writers.remaining(rows, path, ["year", "name"])
    assert [tuple(r) for r in left.collect()] == [(2001, "f%", 3)]
    assert writers.written_partitions(spark, str(tmp_path / "absent"), ["year"]) is None
