"""Monthly price panel: features, future changes, hedge back-test.

A panel has one row per series and month, so a window over a series is as long as the calendar,
whatever the size of the data it was aggregated from.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veta.functions.columns import crush_spread, cyclic, finite, log_positive
from veta.operators.sensors import trailing

# Log-ratio pairs (numerator, denominator, name) of the price features.
RATIOS = (("soya_aceite", "soya_grano", "aceite_grano"), ("soya_harina", "soya_grano", "harina_grano"),
          ("soya_grano", "maiz", "grano_maiz"), ("soya_grano", "urea", "grano_urea"), ("soya_grano", "dap", "grano_dap"),
          ("petroleo", "soya_grano", "petroleo_grano"), ("soya_aceite", "petroleo", "aceite_petroleo"))
ENSO_PHASE = 0.5

# Fixed value: share of nulls from which a feature is dropped.
SPARSE = 0.25


def _z(w, column: str, n: int) -> Column:
    return (F.col(column) - trailing(w, column, F.avg, n, n)) / trailing(w, column, F.stddev_samp, n, n)


def price_features(panel: DataFrame, key: str, series: Sequence[str], enso: str | None = None,
                   month: str = "mes") -> DataFrame:
    """Returns, volatilities, gaps, ratios, crush margin, climate and season, named ``group__feature``."""
    w = Window.partitionBy(key).orderBy(month)
    log = {s: f"_l_{s}" for s in series}
    d = panel.withColumns({log[s]: log_positive(s) for s in series})
    ratios = [(a, b, n) for a, b, n in RATIOS if a in series and b in series]
    d = d.withColumns({f"_r_{n}": F.col(log[a]) - F.col(log[b]) for a, b, n in ratios})
    crush = {"soya_harina", "soya_aceite", "soya_grano"} <= set(series)
    if crush:
        d = d.withColumn("_crush", crush_spread("soya_harina", "soya_aceite", "soya_grano"))
    d = d.withColumns({f"_d_{s}": F.col(c) - F.lag(c, 1).over(w) for s, c in log.items()})
    out: dict[str, Column] = {}
    diff = lambda c, k: F.col(c) - F.lag(c, k).over(w)
    for s, lp in log.items():
        r1 = f"_d_{s}"
        out[f"{s}__ret_1m"] = F.col(r1)
        out.update({f"{s}__ret_{k}m": diff(lp, k) for k in (3, 6, 12)})
        out.update({f"{s}__ret_1m_lag{k}": F.lag(r1, k).over(w) for k in (1, 2, 3)})
        out.update({f"{s}__vol_{n}m": trailing(w, r1, F.stddev_samp, n, n) for n in (6, 12)})
        out[f"{s}__gap_ma12"] = F.col(lp) - trailing(w, lp, F.avg, 12, 12)
        out[f"{s}__z_24m"] = _z(w, lp, 24)
    for _, _, n in ratios:
        out.update({f"rat__{n}": F.col(f"_r_{n}"), f"rat__{n}_d3": diff(f"_r_{n}", 3), f"rat__{n}_z24": _z(w, f"_r_{n}", 24)})
    if crush:
        out.update({"crush__spread": F.col("_crush"), "crush__spread_pct": F.col("_crush") / F.col("soya_grano"),
                    "crush__d3": diff("_crush", 3), "crush__z24": _z(w, "_crush", 24)})
    if enso:
        x = F.col(enso)
        out["enso__anom"] = x
        out.update({f"enso__anom_lag{k}": F.lag(enso, k).over(w) for k in (1, 3, 6, 9)})
        out.update({f"enso__media{n}": trailing(w, enso, F.avg, n, n) for n in (3, 6)})
        out["enso__d3"] = diff(enso, 3)
        out["enso__fase_nino"] = F.when(x >= ENSO_PHASE, 1.0).when(x.isNotNull(), 0.0)
        out["enso__fase_nina"] = F.when(x <= -ENSO_PHASE, 1.0).when(x.isNotNull(), 0.0)
    out["est__mes_sin"], out["est__mes_cos"] = cyclic(F.month(month), 12)
    names = list(out)
    d = d.withColumns(out)
    d = d.withColumns({n: finite(n) for n in names})
    return d.select(key, month, *names)


def feature_names(features: DataFrame) -> list[str]:
    return [c for c in features.columns if "__" in c]


def filled_features(features: DataFrame, most: float = SPARSE) -> list[str]:
    """Features of which less than a share of ``most`` is null; sparser ones would cost their rows."""
    names = feature_names(features)
    row = features.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in names]).first()
    return [c for c in names if row[c] < most * max(row["_n"], 1)]


def future_change(panel: DataFrame, key: str, level: str, horizon: int, logs: bool = True, name: str | None = None,
                  month: str = "mes") -> DataFrame:
    """Change of the level over the next ``horizon`` months: log return or difference."""
    w = Window.partitionBy(key).orderBy(month)
    ahead = F.lead(level, horizon).over(w)
    value = F.log(F.when((ahead > 0) & (F.col(level) > 0), ahead / F.col(level))) if logs else ahead - F.col(level)
    return panel.withColumn(name or f"cambio_{horizon}m", value)


def hedge(df: DataFrame, key: str, ret: str, prob: str, hedge_below: float = 0.45, apply_lag: int = 0,
          month: str = "mes") -> DataFrame:
    """Return of holding against a rule that freezes the price while a fall is expected.

    ``apply_lag=1`` applies a signal to the month after it.  ``capital_*`` treats the input as log
    returns; ``capital_simple_*`` compounds them as simple returns.
    """
    w = Window.partitionBy(key).orderBy(month)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    p = F.lag(prob, apply_lag).over(w) if apply_lag else F.col(prob)
    d = df.withColumn("estrategia", F.when(p < hedge_below, F.lit(0.0)).otherwise(F.col(ret)))
    return d.withColumns({
        "capital_base": F.exp(F.sum(ret).over(upto)), "capital_cobertura": F.exp(F.sum("estrategia").over(upto)),
        "capital_simple_base": F.exp(F.sum(F.log1p(ret)).over(upto)),
        "capital_simple_cobertura": F.exp(F.sum(F.log1p("estrategia")).over(upto))})


def hedge_summary(curve: DataFrame, key: str, ret: str, month: str = "mes") -> DataFrame:
    """Final return and volatility of both, and the volatility saved."""
    g = curve.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), (F.max_by("capital_base", month) - 1).alias("ret_base"),
        (F.max_by("capital_cobertura", month) - 1).alias("ret_cobertura"),
        F.stddev_pop(ret).alias("vol_base"), F.stddev_pop("estrategia").alias("vol_cobertura"))
    return g.withColumn("reduccion_vol_pct", (1 - F.col("vol_cobertura") / F.nullif("vol_base", F.lit(0.0))) * 100)
