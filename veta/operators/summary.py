"""Descriptive tables: counts, describe, nulls, crosstabs, label profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veta.operators.sequence import quantiles
from veta.session import materialise


def label_profile(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """Size and mean of every column per label."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in columns])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Count and share of every value that is not null."""
    counts = materialise(df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.withColumn("proporcion", F.col("n") / F.lit(float(max(total, 1))))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles, one row per column."""
    base = df.agg(*[F.struct(F.count(c).alias("n"), F.avg(c).alias("media"), F.stddev_samp(c).alias("desv"),
                             F.min(c).cast("double").alias("minimo"), F.max(c).cast("double").alias("maximo")).alias(c)
                    for c in columns])
    long = base.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("s"))
                                           for c in columns])).alias("r")).select("r.variable", "r.s.*")
    quart = None
    for c in columns:
        q = quantiles(df, c, {"q25": 0.25, "q50": 0.5, "q75": 0.75}).select(F.lit(c).alias("variable"), "q25", "q50", "q75")
        quart = q if quart is None else quart.unionByName(q)
    return long.join(quart, "variable", "left")


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("nulos"),
                               (F.col(c) / F.col("_n")).alias("proporcion")) for c in columns])
    return row.select(F.explode(pairs).alias("r")).select("r.*")


def crosstab(df: DataFrame, rows: str, columns: str, values: Sequence) -> DataFrame:
    """Counts by two labels; the column labels are named so that no pass is spent on finding them."""
    out = df.groupBy(rows).pivot(columns, list(values)).agg(F.count(F.lit(1)))
    return out.fillna(0, [str(v) for v in values])


def pivot_metric(metrics: DataFrame, row: str, columns: Sequence[str], metric: str, values: Sequence[str]) -> DataFrame:
    """Mean metric, one row per model and one column per joined label of ``columns``."""
    return (metrics.withColumn("_c", F.concat_ws("_", *[F.col(c).cast("string") for c in columns]))
            .groupBy(row).pivot("_c", list(values)).agg(F.avg(metric)))


def top_groups(df: DataFrame, key: str, value: str, top: int = 10) -> DataFrame:
    """Groups with the highest mean: mean, max and count to one decimal."""
    return (df.groupBy(key).agg(F.round(F.avg(value), 1).alias("mean"), F.max(value).alias("max"),
                                F.count(value).alias("count"))
            .orderBy(F.desc("mean"), F.asc(key)).limit(top))
