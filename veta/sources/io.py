"""Readers and writers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veta.functions.columns import as_number, as_timestamp, bucket_of


def load(spark: SparkSession, source: str, columns: Sequence[str] | None = None, fmt: str | None = None,
         schema: StructType | str | None = None) -> DataFrame:
    """Read a catalog table (a bare name) or files (a path); only the named columns if given.

    The format is taken from the ending of the path unless given (csv, json, orc; otherwise parquet).
    """
    if "/" not in source and fmt is None and not source.endswith((".parquet", ".csv", ".json", ".orc")):
        df = spark.read.table(source)
    else:
        kind = fmt or next((f for f in ("csv", "json", "orc") if source.rstrip("/").endswith("." + f)), "parquet")
        reader = spark.read.format(kind)
        if kind == "csv":
            reader = reader.option("header", True).option("mode", "PERMISSIVE")
            if schema is None:
                reader = reader.option("inferSchema", True)
        df = (reader.schema(schema) if schema is not None else reader).load(source)
    return df.select(*columns) if columns else df


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def upper_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.upper() for c in df.columns])


def coerce(df: DataFrame, numbers: Sequence[str] = (), timestamps: Sequence[str] = ()) -> DataFrame:
    """Force columns to double or timestamp; what does not parse becomes null."""
    return df.withColumns({**{c: as_number(c) for c in numbers}, **{c: as_timestamp(c) for c in timestamps}})


def check_columns(df: DataFrame, required: Sequence[str], optional: Mapping[str, str] | None = None) -> DataFrame:
    """Fail on a missing required column; add missing optional ones as typed nulls."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    absent = {c: F.lit(None).cast(t) for c, t in (optional or {}).items() if c not in df.columns}
    return df.withColumns(absent) if absent else df


def sample_percent(df: DataFrame, percent: float, ids: Sequence[str]) -> DataFrame:
    """Repeatable row sample by hash of the ids; 100 or more keeps everything."""
    if percent >= 100:
        return df
    return df.filter(bucket_of(ids) < F.lit(int(round(percent * 100))))


def save_files(df: DataFrame, path: str, fmt: str = "csv", partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True).option("encoding", "UTF-8")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(fmt).save(path)


def save_table(df: DataFrame, name: str) -> None:
    """Create or replace a table with upper-case column names."""
    upper_names(df).write.mode("overwrite").saveAsTable(name)
