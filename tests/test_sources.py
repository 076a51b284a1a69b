"""Readers and writers: round trips, bad rows, names."""

import pytest

from veta.sources import catalog, io, schemas


def test_csv_round_trip_with_a_schema(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5), (2, None)], schemas.PLOTS)
    io.save_files(df, f"{tmp_path}/plots.csv")
    back = io.load(spark, f"{tmp_path}/plots.csv", schema=schemas.PLOTS)
    assert back.dtypes == df.dtypes and sorted(map(tuple, back.collect())) == [(1, 2.5), (2, None)]
    assert io.load(spark, f"{tmp_path}/plots.csv", columns=["id_productor"]).columns == ["id_productor"]


def test_bad_csv_rows_become_nulls(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id_productor,superficie_ha\n1,2.5\nx,y\n3,4,5\n")
    got = io.load(spark, f"{tmp_path}/t.csv", schema=schemas.PLOTS).collect()
    assert sorted(map(tuple, got), key=str) == [(1, 2.5), (3, 4.0), (None, None)]


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json"])
def test_files_by_format_and_partition(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x long, k string")
    io.save_files(df, f"{tmp_path}/t.{fmt}", fmt, ["k"])
    assert sorted(map(tuple, io.load(spark, f"{tmp_path}/t.{fmt}", ["x", "k"]).collect())) == [(1, "a"), (2, "b")]
    assert {p.name for p in (tmp_path / f"t.{fmt}").iterdir() if p.is_dir()} == {"k=a", "k=b"}


def test_tables_have_upper_case_names(spark):
    io.save_table(spark.createDataFrame([(1, "a")], "x long, k string"), "veta_probe")
    try:
        back = io.load(spark, "veta_probe")
        assert back.columns == ["X", "K"] and io.lower_names(back).columns == ["x", "k"] and io.upper_names(io.lower_names(back)).columns == ["X", "K"]
        rows = {(r.table_name, r.column_name): r.ordinal_position for r in catalog.describe_catalog(spark, "default").collect()}
        assert rows[("veta_probe", "X")] == 1 and rows[("veta_probe", "K")] == 2
    finally:
        spark.sql("DROP TABLE veta_probe")


def test_required_and_optional_columns(spark):
    df = spark.createDataFrame([(1,)], "a long")
    assert io.check_columns(df, ["a"], {"b": "double"}).dtypes == [("a", "bigint"), ("b", "double")]
    with pytest.raises(ValueError, match="z"):
        io.check_columns(df, ["a", "z"])


@pytest.mark.parametrize("name", [n for n in vars(schemas) if n.isupper()])
def test_schemas_are_valid(spark, name):
    assert spark.createDataFrame([], getattr(schemas, name)).columns
