"""Tables described by tables: column metadata and per-table summaries."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METADATA = "table_schema string, table_name string, column_name string, data_type string, ordinal_position int"


def describe_frames(spark: SparkSession, frames: Mapping[str, DataFrame], schema: str = "default") -> DataFrame:
    """One row per column of the given tables (names and types only; nothing is read)."""
    rows = [(schema, name, f.name, f.dataType.simpleString(), i)
            for name, df in frames.items() for i, f in enumerate(df.schema.fields, 1)]
    return spark.createDataFrame(rows, METADATA)


def describe_catalog(spark: SparkSession, pattern: str = ".*") -> DataFrame:
    """The same for every catalog table of the databases whose name matches the pattern."""
    rows = []
    for db in spark.catalog.listDatabases():
        if re.search(pattern, db.name, re.IGNORECASE):
            for t in spark.catalog.listTables(db.name):
                if t.isTemporary:
                    continue
                for i, c in enumerate(spark.catalog.listColumns(f"{db.name}.{t.name}"), 1):
                    rows.append((db.name, t.name, c.name, c.dataType, i))
    return spark.createDataFrame(rows, METADATA)


def row_counts(spark: SparkSession, frames: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table in one job; the counts come from the file footers."""
    parts = [df.agg(F.count(F.lit(1)).alias("registros")).select(F.lit(n).alias("table_name"), "registros")
             for n, df in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def summarise(metadata: DataFrame, counts: DataFrame, flat_tables: Iterable[str]) -> DataFrame:
    """Rows, format tag and the ordered column list of every table."""
    listed = (F.array_sort(F.collect_list(F.struct(
        "ordinal_position", F.concat_ws(" ", "column_name", "data_type").alias("text")))))
    columns = metadata.groupBy("table_name").agg(
        F.array_join(F.transform(listed, lambda s: s["text"]), ", ").alias("columnas_tipos"))
    tag = F.when(F.col("table_name").isin(list(flat_tables)), "CSV").otherwise("JSON")
    return (counts.join(columns, "table_name")
            .select(F.col("table_name").alias("tabla"), "registros", tag.alias("formato"), "columnas_tipos"))
