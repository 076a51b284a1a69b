"""Ordered operators that never put an unbounded key into one task.

A plain ``Window.partitionBy(key)`` sends all rows of a key to one task.  The operators here
first look at the group sizes (one aggregate with map-side combine).  If all groups are small
the plain window is used.  Otherwise the rows are range-partitioned on (key, order), written to
the checkpoint folder so that the partition numbers stay fixed, and worked on in pieces:

* running totals: inside each piece, plus the total of the key's earlier pieces;
* frames of n rows: rows get their exact position in the key and are cut into blocks of equal
  size, and each block receives copies of the n rows next to it.

Both give the same answer as the plain window.  Rows ordered by a date or time need neither: totals of the
calendar days are few, and within a day a plain window does (``running_by_day``).  Quantiles of a whole table are
found by counting values in ever smaller intervals (``selected``), so no row moves.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from veta.session import materialise, shuffle_partitions

ROWS_PER_TASK = 2_000_000
#: Intervals that a pass of ``selected`` cuts a range of values into, and its most passes.
CUTS, PASSES = 512, 12


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join per-key values back to rows; null keys meet null keys."""
    renamed = stats.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in stats.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & df[k].eqNullSafe(renamed[f"__{k}"])
    return df.join(renamed, cond, how).drop(*[f"__{k}" for k in keys])


def group_totals(df: DataFrame, keys: Sequence[str], aggregates: Mapping[str, Column]) -> DataFrame:
    """Per-key aggregates attached to every row, without a window over the key."""
    stats = df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggregates.items()])
    return attach(df, stats, keys)


def crowded(df: DataFrame, keys: Sequence[str], limit: int = ROWS_PER_TASK) -> bool:
    """True if some group has more than ``limit`` rows."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) if keys else df.agg(F.count(F.lit(1)).alias("n"))
    return not sizes.filter(F.col("n") > limit).isEmpty()


def pieces(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    """Range-partitioned, durable copy with the piece number of every row in ``_piece``."""
    rows = df.count()
    n = max(shuffle_partitions(df.sparkSession), -(-rows // max(limit, 1)))
    ranged = df.repartitionByRange(n, *[F.col(k).asc() for k in keys], *order)
    return materialise(ranged.withColumn("_piece", F.spark_partition_id()))


def _order(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o).asc() if isinstance(o, str) else o for o in order]


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], totals: Mapping[str, Column],
            include_current: bool = True, kind: str = "sum", limit: int = ROWS_PER_TASK,
            crowd: bool | None = None) -> DataFrame:
    """Running sum (or max) of each column in ``totals`` per key.

    ``order`` must end with a tie-break.  With ``include_current=False`` the first row of a key is null.
    ``crowd`` passes on a known answer of ``crowded`` (cheaper to find on the source of a long plan).
    """
    keys, order = list(keys), _order(order)
    agg = {"sum": F.sum, "max": F.max}[kind]
    end = 0 if include_current else -1
    if not (crowded(df, keys, limit) if crowd is None else crowd):
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
        return df.withColumns({name: agg(c).over(w) for name, c in totals.items()})
    held = pieces(df.withColumns({f"_in_{n}": c for n, c in totals.items()}), keys, order, limit)
    part = [*keys, "_piece"]
    sums = held.groupBy(*part).agg(*[agg(f"_in_{n}").alias(f"_sum_{n}") for n in totals])
    past = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*part, *[agg(f"_sum_{n}").over(past).alias(f"_off_{n}") for n in totals])
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    local = held.withColumns({f"_loc_{n}": agg(f"_in_{n}").over(w) for n in totals})
    out = attach(local, offsets, part)
    for n in totals:
        a, b = F.col(f"_loc_{n}"), F.col(f"_off_{n}")
        joined = (F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))) if kind == "sum" else F.greatest(a, b)
        out = out.withColumn(n, F.when(a.isNotNull() | b.isNotNull(), joined))
    return out.drop("_piece", *[f"_{p}_{n}" for n in totals for p in ("in", "loc", "off")])


def dated(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() in ("date", "timestamp", "timestamp_ntz")


def day_totals(df: DataFrame, keys: Sequence[str], when: str, totals: Mapping[str, Column], limit: int = ROWS_PER_TASK) -> tuple[DataFrame, int] | None:
    """(keys, _day, _n, totals) of every calendar day of ``when``, written, and the number of rows; None if there are too many
    days, or too many rows in one, for a task."""
    days = materialise(df.groupBy(*keys, F.to_date(when).alias("_day")).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(n) for n, c in totals.items()]))
    found = days.agg(F.count(F.lit(1)).alias("days"), F.max("_n").alias("most"), F.sum("_n").alias("rows")).first()
    return (days, found["rows"] or 0) if found["days"] <= limit and (found["most"] or 0) <= limit else None


def running_by_day(df: DataFrame, keys: Sequence[str], order: Sequence[str], totals: Mapping[str, Column], include_current: bool = True,
                   limit: int = ROWS_PER_TASK, days: DataFrame | None = None) -> DataFrame:
    """``running`` sums for rows ordered by a date or time first: the totals of the key's earlier days plus those within the day.

    One shuffle of the rows, whatever the size of a key; columns that nobody reads stay out of it.
    """
    if days is None:
        found = day_totals(df, keys, order[0], totals, limit) if dated(df, order[0]) else None
        if found is None:
            return running(df, keys, order, totals, include_current, limit=limit)
        days = found[0]
    past = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    offsets = days.select(*keys, "_day", *[F.sum(n).over(past).alias(f"_off_{n}") for n in totals])
    w = Window.partitionBy(*keys, "_day").orderBy(*_order(order)).rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    local = df.withColumn("_day", F.to_date(order[0])).withColumns({f"_loc_{n}": F.sum(c).over(w) for n, c in totals.items()})
    out = attach(local, F.broadcast(offsets), [*keys, "_day"])
    for n in totals:
        a, b = F.col(f"_loc_{n}"), F.col(f"_off_{n}")
        out = out.withColumn(n, F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))))
    return out.drop("_day", *[f"_{p}_{n}" for n in totals for p in ("loc", "off")])


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "pos",
              limit: int = ROWS_PER_TASK) -> DataFrame:
    """1-based position of every row in its key."""
    return running(df, keys, order, {name: F.lit(1).cast("long")}, limit=limit)


def framed(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
           stages: Sequence[Callable[[WindowSpec], Mapping[str, Column]]], before: int = 0, after: int = 0,
           limit: int = ROWS_PER_TASK, crowd: bool | None = None) -> DataFrame:
    """Window columns that look at most ``before`` rows back and ``after`` rows ahead in all stages together.

    Each stage receives the ordered window of the key and returns named columns.
    """
    keys, order = list(keys), _order(order)
    if not (crowded(df, keys, limit) if crowd is None else crowd):
        w = Window.partitionBy(*keys).orderBy(*order)
        for stage in stages:
            df = df.withColumns(dict(stage(w)))
        return df
    size = max(limit, before, after, 1)
    at = F.col("_pos") - 1
    block = F.floor(at / size)
    copies = [F.struct(block.alias("b"), F.lit(True).alias("own"))]
    if before:
        copies.append(F.when(at % size >= size - before, F.struct((block + 1).alias("b"), F.lit(False).alias("own"))))
    if after:
        copies.append(F.when(at % size < after, F.struct((block - 1).alias("b"), F.lit(False).alias("own"))))
    spread = (positions(df, keys, order, "_pos", limit)
              .withColumn("_copy", F.explode(F.filter(F.array(*copies), lambda c: c.isNotNull())))
              .withColumns({"_block": F.col("_copy.b"), "_own": F.col("_copy.own")}))
    w = Window.partitionBy(*keys, "_block").orderBy(*order)
    for stage in stages:
        spread = spread.withColumns(dict(stage(w)))
    return spread.filter("_own").drop("_pos", "_copy", "_block", "_own")


def selected(df: DataFrame, columns: Sequence[str], probs: Sequence[float], weight: str | None = None) -> dict[str, list[float | None]] | None:
    """Exact interpolated quantiles of whole columns by counting: each pass cuts the intervals that hold the wanted ranks.

    Nulls are left out.  None if a column holds NaN or infinity, or if the values are spread too unevenly.
    """
    n_of = F.col(weight) if weight else F.lit(1)
    x = {c: F.col(c).cast("double") for c in columns}
    row = df.agg(*[F.struct(F.sum(F.when(v.isNotNull(), n_of)).alias("n"), F.min(v).alias("a"), F.max(v).alias("b"),
                            F.count_if(F.isnan(v) | (F.abs(v) == float("inf"))).alias("odd")).alias(f"_{i}") for i, v in enumerate(x.values())]).first()
    if any(r["odd"] for r in row):
        return None
    sizes = {c: row[f"_{i}"]["n"] or 0 for i, c in enumerate(columns)}
    # (column, rank) to the interval that holds it and the number of values below the interval.
    at = {(c, k): (row[f"_{i}"]["a"], row[f"_{i}"]["b"], 0) for i, c in enumerate(columns) if sizes[c]
          for p in probs for k in {floor(p * (sizes[c] - 1)), ceil(p * (sizes[c] - 1))}}
    for _ in range(PASSES):
        todo = sorted({(c, a, b) for (c, _), (a, b, _) in at.items() if a < b})
        if not todo:
            break
        each = [F.when(x[c].between(a, b), F.struct(F.lit(i).alias("i"), F.least(F.floor((x[c] - a) / F.lit(b - a) * CUTS), F.lit(CUTS - 1)).cast("int").alias("j"), x[c].alias("x")))
                for i, (c, a, b) in enumerate(todo)]
        cut = (df.select(n_of.alias("n"), F.explode(F.filter(F.array(*each), lambda r: r.isNotNull())).alias("r"))
               .groupBy("r.i", "r.j").agg(F.sum("n").alias("n"), F.min("r.x").alias("a"), F.max("r.x").alias("b")).orderBy("i", "j").collect())
        for (c, k), (a, b, below) in list(at.items()):
            if a < b:
                i = todo.index((c, a, b))
                for r in cut:
                    if r["i"] == i:
                        if below <= k < below + r["n"]:
                            at[c, k] = (r["a"], r["b"], below)
                            break
                        below += r["n"]
    if any(a < b for a, b, _ in at.values()):
        return None
    out = {}
    for c in columns:
        h = [p * (sizes[c] - 1) for p in probs]
        out[c] = [at[c, floor(v)][0] + (v - floor(v)) * (at[c, ceil(v)][0] - at[c, floor(v)][0]) if sizes[c] else None for v in h]
    return out


def quantiles(df: DataFrame, value: str, probs: Mapping[str, float], keys: Sequence[str] = (),
              limit: int = ROWS_PER_TASK, crowd: bool | None = None) -> DataFrame:
    """Exact interpolated quantiles per key: one row per key, one column per entry of ``probs``.

    Equal values are counted first, so copies cost nothing.  Keys with more distinct values than one
    task should hold are answered from running counts over the sorted values.
    """
    keys, names = list(keys), list(probs)
    # No filter on the value: pushed down, it would copy the whole expression behind the value.
    hist = df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    if not (crowded(hist, keys, limit) if crowd is None else crowd):
        packed = F.percentile(F.col("_v").cast("double"), F.array(*[F.lit(float(probs[n])) for n in names]), F.col("_n"))
        agg = hist.groupBy(*keys).agg(packed.alias("_q"))
        return agg.select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    hist = materialise(hist).filter(F.col("_v").isNotNull())
    if not keys and (found := selected(hist, ["_v"], [float(probs[n]) for n in names], "_n")):
        return df.sparkSession.createDataFrame([tuple(found["_v"])], ", ".join(f"`{n}` double" for n in names))
    ranked = running(hist, keys, ["_v"], {"_upto": F.col("_n")}, limit=limit)
    sizes = hist.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    both = attach(ranked, sizes, keys)
    picks = []
    for n in names:
        h = F.lit(float(probs[n])) * (F.col("_total") - 1)
        for edge, rank in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            here = (F.col("_upto") > rank) & (F.col("_upto") - F.col("_n") <= rank)
            picks.append(F.max(F.when(here, F.col("_v").cast("double"))).alias(f"{n}_{edge}"))
        picks.append(F.max(h - F.floor(h)).alias(f"{n}_w"))
    out = both.groupBy(*keys).agg(*picks)
    return out.select(*keys, *[(F.col(f"{n}_lo") + F.col(f"{n}_w") * (F.col(f"{n}_hi") - F.col(f"{n}_lo"))).alias(n)
                               for n in names])


def medians(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), prefix: str = "med_",
            limit: int = ROWS_PER_TASK, crowd: bool | None = None) -> DataFrame:
    """Exact medians of several columns per key in one pass where the groups are small."""
    if not (crowded(df, keys, limit) if crowd is None else crowd):
        exprs = [F.percentile(F.col(c).cast("double"), F.lit(0.5)).alias(prefix + c) for c in columns]
        return df.groupBy(*keys).agg(*exprs) if keys else df.agg(*exprs)
    if not keys and (every := selected(df, columns, [0.5])):
        return df.sparkSession.createDataFrame([tuple(every[c][0] for c in columns)], ", ".join(f"`{prefix}{c}` double" for c in columns))
    if not keys:
        found = {prefix + c: quantiles(df, c, {"q": 0.5}, limit=limit).first() for c in columns}
        schema = ", ".join(f"`{n}` double" for n in found)
        return df.sparkSession.createDataFrame([tuple(r["q"] if r else None for r in found.values())], schema)
    out = df.select(*keys).distinct()
    for c in columns:
        out = attach(out, quantiles(df, c, {prefix + c: 0.5}, keys, limit), keys)
    return out


def average_ranks(hist: DataFrame, value: str, weight: str, keys: Sequence[str] = (), name: str = "rank",
                  limit: int = ROWS_PER_TASK) -> DataFrame:
    """Average rank of each distinct value in a table of (keys, value, weight)."""
    upto = running(hist, keys, [value], {"_upto": F.col(weight)}, limit=limit)
    return upto.withColumn(name, F.col("_upto") - F.col(weight) + (F.col(weight) + 1) / 2).drop("_upto")


def as_of_last(left: DataFrame, right: DataFrame, at_left: str, at_right: str, value: str, name: str,
               limit: int = ROWS_PER_TASK) -> DataFrame:
    """For each left row the ``value`` of the last right row whose position is not above it."""
    width = F.struct(F.col(at_right).alias("at"), F.col(value).alias("v"))
    empty = F.lit(None).cast(right.select(width.alias("x")).schema["x"].dataType)
    marks = right.select(F.col(at_right).cast("double").alias("_at"), F.lit(0).alias("_side"), width.alias("_mark"))
    rows = left.withColumns({"_at": F.col(at_left).cast("double"), "_side": F.lit(1), "_mark": empty})
    both = rows.unionByName(marks, allowMissingColumns=True)
    ties = [c for c in left.columns]
    filled = running(both, [], ["_at", "_side", *ties], {"_last": F.col("_mark")}, kind="max", limit=limit)
    return filled.filter("_side = 1").withColumn(name, F.col("_last.v")).drop("_at", "_side", "_mark", "_last")
