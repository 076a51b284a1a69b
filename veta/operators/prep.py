"""Row preparation: imputation, scaling, bins, labels, encodings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veta.functions.columns import right_closed
from veta.operators.sequence import medians, quantiles


def quarantine(df: DataFrame, id_column: str, bad_ids: Sequence, required: Sequence[str]) -> DataFrame:
    """Drop known impossible records, then rows that lack a required value."""
    return df.filter(~F.col(id_column).isin(list(bad_ids))).dropna(subset=list(required))


def learned_medians(train: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    row = medians(train, columns).first()
    return {c: row[f"med_{c}"] for c in columns}


def median_fill(df: DataFrame, columns: Sequence[str], train: DataFrame | None = None) -> DataFrame:
    """Fill nulls with the exact median (of ``train`` if given)."""
    values = learned_medians(train if train is not None else df, columns)
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(values[c])) for c in columns})


def learned_scale(train: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column; a constant column is divided by 1."""
    row = train.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns]).first()
    return {c: (row[c]["m"] or 0.0, row[c]["s"] or 1.0) for c in columns}


def apply_scale(df: DataFrame, scale: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in scale.items()})


def standardise(df: DataFrame, columns: Sequence[str], train: DataFrame | None = None) -> DataFrame:
    """Centre and scale by population moments; the few learned numbers travel as literals."""
    return apply_scale(df, learned_scale(train if train is not None else df, columns))


def sparse_columns(df: DataFrame, columns: Sequence[str], top_share: float = 0.25) -> list[str]:
    """Columns whose share of nulls reaches the limit."""
    row = df.agg(*[F.avg(F.when(F.col(c).isNull(), 1.0).otherwise(0.0)).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] is None or row[c] >= top_share]


def drop_sparse(df: DataFrame, columns: Sequence[str], top_share: float = 0.25) -> DataFrame:
    return df.drop(*sparse_columns(df, columns, top_share))


def fill_category(df: DataFrame, columns: Sequence[str], value: str = "FALTA") -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(value)) for c in columns})


def quantile_bins(df: DataFrame, column: str, labels: Sequence[str], name: str) -> DataFrame:
    """Equal-frequency bins, closed on the right; equal values share a bin."""
    k = len(labels)
    edges = quantiles(df, column, {f"q{i}": i / k for i in range(1, k)}).first()
    cuts = [edges[f"q{i}"] for i in range(1, k)]
    if len(set(cuts)) < len(cuts):
        raise ValueError(f"bin edges of {column} coincide: {cuts}")
    return df.withColumn(name, right_closed(column, [float("-inf"), *cuts, float("inf")], labels))


def quantile_label(df: DataFrame, column: str, prob: float, name: str = "y", train: DataFrame | None = None) -> DataFrame:
    """1 where the value lies above the quantile (of ``train`` if given)."""
    cut = quantiles(train if train is not None else df, column, {"q": prob}).first()["q"]
    return df.withColumn(name, F.when(F.col(column) > F.lit(cut), 1).otherwise(0))


def one_hot(df: DataFrame, column: str, levels: Sequence, prefix: str) -> DataFrame:
    """0/1 columns for known levels; an unknown or missing value is 0 everywhere."""
    return df.withColumns({f"{prefix}{v}": F.when(F.col(column) == F.lit(v), 1).otherwise(0) for v in levels})


def levels_of(train: DataFrame, column: str, most: int = 200) -> list:
    """Sorted levels of a categorical column; refuses columns that are not categories."""
    rows = train.select(column).filter(F.col(column).isNotNull()).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{column} has more than {most} levels")
    return sorted(r[0] for r in rows)
