"""Leak-free splits and folds, as a label column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veta.operators.sequence import ROWS_PER_TASK, attach, dated, day_totals, group_totals, positions, running_by_day
from veta.session import materialise

TRAIN, VALIDATION = 0.70, 0.15
# Rows of a class that one task orders; larger classes are ordered in pieces.
STRATUM_ROWS = 250_000


def text_order(ids: Sequence[str]) -> Column:
    """Pseudo-random but repeatable order of rows."""
    return F.md5(F.concat_ws("|", *[F.col(i).cast("string") for i in ids]))


def _cuts(n: Column, train: float, validation: float) -> tuple[Column, Column]:
    return F.floor(n * F.lit(train)), F.floor(n * F.lit(train + validation))


def chronological(df: DataFrame, order: Sequence[str], keys: Sequence[str] = (), train: float = TRAIN,
                  validation: float = VALIDATION, name: str = "split") -> DataFrame:
    """First 70 % of the rows train, next 15 % validation, rest test (per key if keys are given)."""
    if keys:
        placed, n = group_totals(positions(df, keys, order, "_pos"), keys, {"_n": F.count(F.lit(1))}), F.col("_n")
    else:
        one = {"_pos": F.lit(1).cast("long")}
        days = day_totals(df, [], order[0], one) if dated(df, order[0]) else None
        placed = running_by_day(df, [], order, one, days=days[0]) if days else positions(df, [], order, "_pos")
        n = F.lit(days[1] if days else df.count())
    a, b = _cuts(n, train, validation)
    label = F.when(F.col("_pos") <= a, "train").when(F.col("_pos") <= b, "validation").otherwise("test")
    return placed.withColumn(name, label).drop("_pos", "_n")


def purged(df: DataFrame, keys: Sequence[str], order: Sequence[str], horizon: int, train: float = TRAIN,
           validation: float = VALIDATION, name: str = "split") -> DataFrame:
    """Chronological blocks with ``horizon`` rows left out between them (label ``purga``)."""
    placed = group_totals(positions(df, keys, order, "_pos"), keys, {"_n": F.count(F.lit(1))})
    a, b = _cuts(F.col("_n"), train, validation)
    p = F.col("_pos")
    label = (F.when(p <= a, "train").when(p <= F.least(a + horizon, b), "purga").when(p <= b, "validation")
             .when(p <= b + horizon, "purga").otherwise("test"))
    return placed.withColumn(name, label).drop("_pos", "_n")


def stratified(df: DataFrame, label: str, ids: Sequence[str], shares: Mapping[str, float], name: str = "split") -> DataFrame:
    """Random split with the same shares in every class; exact up to rounding, repeatable by the ids."""
    d = df.withColumn("_h", text_order(ids))
    # A row a class: sent to the rows, which would meet in one task a class.
    sizes = F.broadcast(materialise(df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))))
    d = attach(positions(d, [label], ["_h", *ids], "_pos", limit=STRATUM_ROWS), sizes, [label])
    upto, out, names = 0.0, None, list(shares)
    for n in names[:-1]:
        upto += shares[n]
        hit = F.col("_pos") <= F.floor(F.col("_n") * F.lit(upto) + 0.5)
        out = F.when(hit, n) if out is None else out.when(hit, n)
    return d.withColumn(name, out.otherwise(names[-1])).drop("_h", "_pos", "_n")


def stratified_folds(df: DataFrame, label: str, ids: Sequence[str], k: int, name: str = "pliegue") -> DataFrame:
    """Fold number 0..k-1, dealt in turn within every class."""
    d = positions(df.withColumn("_h", text_order(ids)), [label], ["_h", *ids], "_pos", limit=STRATUM_ROWS)
    return d.withColumn(name, F.pmod(F.col("_pos") - 1, F.lit(k)).cast("int")).drop("_h", "_pos")


def cuts_before(df: DataFrame, order: Sequence[str], cuts: Sequence[int], days: DataFrame, name: str) -> DataFrame:
    """How many of the ``cuts`` (numbers of rows from the first in the order) lie before every row.

    ``days`` comes from ``day_totals`` of the first column of the order.  Rows of a day that no cut divides are told by
    their date and do not move; only the days that a cut divides, at most one a cut, are ordered.
    """
    day = F.to_date(order[0])
    upto = days.select("_day", "_n", F.sum("_n").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"))
    # The day that holds each cut, and how many of its rows lie before the cut.
    holds = [F.when((F.col("_upto") >= c) & (F.col("_upto") - F.col("_n") < c), F.lit(c)) for c in sorted({c for c in cuts if c > 0})]
    found = upto.withColumn("_cut", F.explode(F.array_compact(F.array(*holds)))).collect() if holds else []
    at = {r["_cut"]: (r["_day"], r["_cut"] - r["_upto"] + r["_n"], r["_n"]) for r in found}
    here = lambda d: day.eqNullSafe(F.lit(d).cast("date"))
    divided = F.lit(False)
    for d, k, n in at.values():
        divided = divided | here(d) if k < n else divided
    passed = F.lit(0)
    for c in cuts:
        if c > 0 and c in at:
            d, k, _ = at[c]
            earlier = F.lit(False) if d is None else day.isNull() | (day < F.lit(d))
            passed = passed + F.when(earlier | (here(d) & (F.col("_at") <= k)), 0).otherwise(1)
        elif c <= 0:
            passed = passed + 1
    whole = df.filter(~divided).withColumn("_at", F.lit(0))
    w = Window.partitionBy("_day").orderBy(*order)
    split = df.filter(divided).withColumn("_day", day).withColumn("_at", F.row_number().over(w)).drop("_day")
    return whole.unionByName(split).withColumn(name, passed.cast("int")).drop("_at")


def expanding_folds(df: DataFrame, order: Sequence[str], k: int, name: str = "pliegue", limit: int = ROWS_PER_TASK) -> DataFrame:
    """Test fold 1..k of every row in time order, 0 for rows that are only ever trained on.

    Fold i is tested after training on all rows with a smaller number.
    """
    n = df.count()
    size = n // (k + 1)
    start = n - k * size
    # What a task orders stays one ordered part: closed-form fits on a few months react to the order of their sums.
    days = day_totals(df, [], order[0], {}) if n > limit and dated(df, order[0]) else None
    if days:
        return cuts_before(df, order, [start + i * size for i in range(k)], days[0], name)
    placed = positions(df, [], order, "_pos", limit)
    fold = F.when(F.col("_pos") <= start, 0).otherwise(F.floor((F.col("_pos") - start - 1) / F.lit(max(size, 1))) + 1)
    return placed.withColumn(name, fold.cast("int")).drop("_pos")


def every_nth(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """Every n-th row in order, so that overlapping horizons do not share months."""
    return positions(df, keys, order, "_pos").filter(F.pmod(F.col("_pos") - 1, F.lit(n)) == 0).drop("_pos")
