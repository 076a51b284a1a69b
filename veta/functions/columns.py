"""Column expressions shared by all operators.  Everything stays inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from math import log10, pi

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shares of the leading digits 1..9 under Benford's law.
BENFORD = {d: log10(1 + 1 / d) for d in range(1, 10)}
# Weights of meal and oil in the crush margin.
CRUSH_MEAL, CRUSH_OIL = 0.80, 0.18
# Tolerated moisture and impurities (fractions of the weight).
MOISTURE_FREE, IMPURITY_FREE = 0.14, 0.01


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ------------------------------------------------------------------ coercion
def as_number(c: str | Column) -> Column:
    """Double or null: text that does not parse and NaN both become null."""
    x = col(c).try_cast("double")
    return F.when(~F.isnan(x), x)


def as_timestamp(c: str | Column) -> Column:
    return F.try_to_timestamp(col(c).cast("string"))


def finite(c: str | Column) -> Column:
    """Null for NaN and for both infinities."""
    x = col(c)
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def flag(condition: Column) -> Column:
    """1.0 / 0.0, with an unknown condition counted as false."""
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


# ------------------------------------------------------------------ arithmetic
def clip(c: str | Column, low: float | None = None, high: float | None = None) -> Column:
    """Bound a value; a null stays null (``least`` and ``greatest`` alone would skip it)."""
    x = col(c)
    y = x
    if low is not None:
        y = F.greatest(y, F.lit(float(low)))
    if high is not None:
        y = F.least(y, F.lit(float(high)))
    return F.when(x.isNotNull(), y)


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, null where b is 0."""
    return col(a) / F.nullif(col(b), F.lit(0.0))


def log_skew(c: str | Column) -> Column:
    """log(1 + max(x, 0)) against long right tails."""
    return F.log1p(clip(c, 0))


def tidy(c: str | Column, digits: int = 6) -> Column:
    """Rounded for reports; turns -0.0 into 0.0."""
    return F.round(col(c), digits) + F.lit(0.0)


def net_weight(gross: str = "peso_bruto_tn", tare: str = "tara_tn") -> Column:
    return col(gross) - col(tare)


def tare_ratio(gross: str = "peso_bruto_tn", tare: str = "tara_tn") -> Column:
    return ratio(tare, gross)


def shrink_rate(moisture_pct: str | Column, impurity_pct: str | Column) -> Column:
    """Expected loss per ton: moisture and impurities above the tolerated part."""
    return clip(col(moisture_pct) / 100 - MOISTURE_FREE, 0) + clip(col(impurity_pct) / 100 - IMPURITY_FREE, 0)


def humidex(temperature: str | Column, humidity: str | Column) -> Column:
    t = col(temperature)
    return t + F.lit(0.05) * col(humidity) * (t / 30.0)


def crush_spread(meal: str | Column, oil: str | Column, bean: str | Column) -> Column:
    return CRUSH_MEAL * col(meal) + CRUSH_OIL * col(oil) - col(bean)


def log_positive(c: str | Column) -> Column:
    x = col(c)
    return F.log(F.when(x > 0, x))


# ------------------------------------------------------------------ dates
def month_text(c: str | Column) -> Column:
    return F.date_format(col(c), "yyyy-MM")


def decimal_hour(c: str | Column) -> Column:
    return F.hour(col(c)) + F.minute(col(c)) / 60.0


def epoch(c: str | Column) -> Column:
    """Seconds since 1970 as a double (microseconds kept)."""
    return F.unix_micros(col(c).cast("timestamp")) / 1e6


def floor_days(start: str | Column, end: str | Column) -> Column:
    """Whole days elapsed, rounded down also for negative spans."""
    return F.floor((epoch(end) - epoch(start)) / 86400.0)


def boundary_hours(start: str | Column, end: str | Column) -> Column:
    """Hour boundaries crossed between two times (00:59 to 01:01 counts 1)."""
    a = F.unix_micros(F.date_trunc("hour", col(start).cast("timestamp")))
    b = F.unix_micros(F.date_trunc("hour", col(end).cast("timestamp")))
    return ((b - a) / F.lit(3600000000)).cast("long")


def cyclic(c: str | Column, period: float) -> tuple[Column, Column]:
    angle = col(c) * F.lit(2 * pi / period)
    return F.sin(angle), F.cos(angle)


def is_sunday(c: str | Column) -> Column:
    return F.weekday(col(c)) == 6


# ------------------------------------------------------------------ classes
def right_closed(c: str | Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the interval (edge, next edge] that holds the value; null outside all of them."""
    x = col(c)
    steps = list(zip(edges, edges[1:], labels, strict=False))
    out = F.when((x > steps[0][0]) & (x <= steps[0][1]), F.lit(steps[0][2]))
    for low, high, label in steps[1:]:
        out = out.when((x > low) & (x <= high), F.lit(label))
    return out


def severity_of_delay(days: str | Column) -> Column:
    """0 on time, 1 slight (1 to 5 days), 2 severe."""
    d = col(days)
    return F.when(d <= 0, 0).when(d <= 5, 1).when(d.isNotNull(), 2)


def direction_class(change: str | Column, threshold: float | Column) -> Column:
    """0 down, 1 sideways, 2 up around a symmetric threshold."""
    x, t = col(change), F.lit(threshold) if not isinstance(threshold, Column) else threshold
    return F.when(x < -t, 0).when(x > t, 2).when(x.isNotNull(), 1)


def name_of_largest(values: Mapping[str, Column]) -> Column:
    """Name of the largest value; the first named wins a tie, nulls never win."""
    entries = [F.struct(v.alias("v"), F.lit(-i).alias("o"), F.lit(n).alias("n")) for i, (n, v) in enumerate(values.items())]
    return F.array_max(F.array(*entries))["n"]


def rank_in(c: str | Column, ascending: Sequence[str]) -> Column:
    """Position of a label in an ordered list (0 = lowest)."""
    out = F.when(col(c) == ascending[0], 0)
    for i, label in enumerate(ascending[1:], 1):
        out = out.when(col(c) == label, i)
    return out


# ------------------------------------------------------------------ text
def first_digit(c: str | Column) -> Column:
    """First digit other than 0 in the printed number; null if there is none."""
    found = F.regexp_extract(F.abs(col(c)).cast("string"), "([1-9])", 1)
    return F.nullif(found, F.lit("")).cast("int")


def has_odd_characters(c: str | Column) -> Column:
    return col(c).rlike("[^\\x00-\\x7F]")


def item(name: str, value: str | Column) -> Column:
    """``NAME=value`` token; null for a null value."""
    return F.concat(F.lit(name + "="), col(value).cast("string"))


def bucket_of(ids: Sequence[str | Column], buckets: int = 10000) -> Column:
    """Stable pseudo-random bucket 0..buckets-1 from an md5 of the given ids."""
    text = F.concat_ws("|", *[col(c).cast("string") for c in ids])
    head = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return F.pmod(head, F.lit(buckets))


def hash_order(ids: Sequence[str | Column], seed: int = 42) -> Column:
    return F.xxhash64(F.lit(seed), *[col(c) for c in ids])


# ------------------------------------------------------------------ tails
def chi2_tail_even(x: str | Column, df: int) -> Column:
    """Upper tail of chi-square for even degrees of freedom: exp(-x/2) * sum (x/2)^i / i!."""
    half = col(x) / 2
    term, total = F.lit(1.0), F.lit(1.0)
    for i in range(1, df // 2):
        term = term * half / i
        total = total + term
    return F.exp(-half) * total


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
