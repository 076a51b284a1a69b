"""Keyed calendar series: last version, dense calendar, limited fill."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veta.operators.sequence import attach


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Row with the highest ``order`` per key.

    One aggregate with map-side combine instead of a ranking window: a hot key is reduced before it moves.
    """
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, "_r.*").select(*df.columns)


def dense_months(df: DataFrame, keys: Sequence[str], month: str = "mes") -> DataFrame:
    """One row for every month between the first and the last of each key."""
    span = df.groupBy(*keys).agg(F.min(month).alias("_a"), F.max(month).alias("_b"))
    calendar = span.select(*keys, F.explode(F.expr("sequence(_a, _b, interval 1 month)")).alias(month))
    return calendar.join(df, [*keys, month], "left")


def fill_forward(df: DataFrame, keys: Sequence[str], columns: Sequence[str], steps: int, month: str = "mes") -> DataFrame:
    """Carry the last value over at most ``steps`` months.  A key has one row per month, so its window is
    as long as the calendar, whatever the size of the source."""
    w = Window.partitionBy(*keys).orderBy(month).rowsBetween(-steps, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def trim_incomplete(df: DataFrame, keys: Sequence[str], required: Sequence[str], month: str = "mes") -> DataFrame:
    """Drop the months before the first and after the last complete row of each key."""
    whole = F.lit(True)
    for c in required:
        whole = whole & F.col(c).isNotNull()
    span = df.filter(whole).groupBy(*keys).agg(F.min(month).alias("_a"), F.max(month).alias("_b"))
    return attach(df, span, keys, "inner").filter(F.col(month).between(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def monthly_panel(df: DataFrame, keys: Sequence[str], columns: Sequence[str], required: Sequence[str],
                  version: Sequence[str] = (), month: str = "mes", fill_steps: int = 2) -> DataFrame:
    """Last version of every month, dense calendar, limited forward fill, trimmed to complete ends."""
    d = df.withColumn(month, F.trunc(month, "MM"))
    if version:
        d = latest(d, [*keys, month], version)
    d = dense_months(d.select(*keys, month, *columns), keys, month)
    return trim_incomplete(fill_forward(d, keys, columns, fill_steps, month), keys, required, month)
