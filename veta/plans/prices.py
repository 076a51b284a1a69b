"""Monthly price panel front."""

from __future__ import annotations

from pyspark.sql import functions as F

from veta.functions.columns import tidy
from veta.operators import prices as op
from veta.operators.panel import monthly_panel
from veta.plans.profiles import rounded, sql_rounded
from veta.plans.registry import query
from veta.session import materialise
from veta.sources import roles
from veta.sources.roles import ENSO, PANEL_SERIES, sql_with

SERIES = list(PANEL_SERIES)
REQUIRED = ["soya_grano", "soya_aceite", "soya_harina"]


def panel(spark, sf):
    # Written before the panel, which reads it four times: a row a series and month of all line items.
    return monthly_panel(materialise(roles.monthly_prices(spark, sf)), ["serie"], [*SERIES, ENSO], REQUIRED)


LEVELS = [*SERIES, ENSO]
PANEL_SQL = f"""tramo AS (SELECT serie, min(mes) AS a, max(mes) AS b FROM precio_mensual GROUP BY 1),
    calendario AS (SELECT serie, CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS mes FROM tramo),
    lleno AS (SELECT serie, mes, {', '.join(f'last_value({c} IGNORE NULLS) OVER v AS {c}' for c in LEVELS)}
      FROM calendario LEFT JOIN precio_mensual USING (serie, mes)
      WINDOW v AS (PARTITION BY serie ORDER BY mes ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
    borde AS (SELECT serie, min(mes) AS a, max(mes) AS b FROM lleno WHERE {' AND '.join(f'{c} IS NOT NULL' for c in REQUIRED)} GROUP BY 1),
    panel AS (SELECT lleno.* FROM lleno JOIN borde USING (serie) WHERE mes BETWEEN a AND b)"""


@query("monthly_panel", sql_with("precio_mensual", then=f", {PANEL_SQL} SELECT serie, CAST(mes AS VARCHAR) AS mes, {sql_rounded(' '.join(LEVELS), 5)} FROM panel"))
def monthly_panel_query(spark, sf):
    return rounded(panel(spark, sf), 5)


def features_sql() -> str:
    """The price features as SQL."""
    v = "OVER (PARTITION BY serie ORDER BY mes)"

    def roll(fn: str, c: str, n: int) -> str:
        f = f"OVER (PARTITION BY serie ORDER BY mes ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        return f"CASE WHEN count({c}) {f} >= {n} THEN {fn}({c}) {f} END"

    def z(c: str, n: int) -> str:
        return f"({c} - {roll('avg', c, n)}) / nullif({roll('stddev_samp', c, n)}, 0)"

    ratios = [r for r in op.RATIOS if r[0] in SERIES and r[1] in SERIES]
    a = ("lg AS (SELECT *, " + ", ".join(f"CASE WHEN {s} > 0 THEN ln({s}) END AS l_{s}" for s in SERIES)
         + ", 0.8 * soya_harina + 0.18 * soya_aceite - soya_grano AS cr FROM panel)")
    b = ("df AS (SELECT *, " + ", ".join(f"l_{s} - lag(l_{s}) {v} AS d_{s}" for s in SERIES) + ", "
         + ", ".join(f"l_{x} - l_{y} AS r_{n}" for x, y, n in ratios) + " FROM lg)")
    cols: dict[str, str] = {}
    for s in SERIES:
        cols[f"{s}__ret_1m"] = f"d_{s}"
        cols.update({f"{s}__ret_{k}m": f"l_{s} - lag(l_{s}, {k}) {v}" for k in (3, 6, 12)})
        cols.update({f"{s}__ret_1m_lag{k}": f"lag(d_{s}, {k}) {v}" for k in (1, 2, 3)})
        cols.update({f"{s}__vol_{n}m": roll("stddev_samp", f"d_{s}", n) for n in (6, 12)})
        cols[f"{s}__gap_ma12"] = f"l_{s} - {roll('avg', f'l_{s}', 12)}"
        cols[f"{s}__z_24m"] = z(f"l_{s}", 24)
    for _, _, n in ratios:
        cols.update({f"rat__{n}": f"r_{n}", f"rat__{n}_d3": f"r_{n} - lag(r_{n}, 3) {v}", f"rat__{n}_z24": z(f"r_{n}", 24)})
    cols.update({"crush__spread": "cr", "crush__spread_pct": "cr / soya_grano", "crush__d3": f"cr - lag(cr, 3) {v}",
                 "crush__z24": z("cr", 24), "enso__anom": ENSO, "enso__d3": f"{ENSO} - lag({ENSO}, 3) {v}",
                 "enso__fase_nino": f"CASE WHEN {ENSO} >= 0.5 THEN 1.0::DOUBLE WHEN {ENSO} IS NOT NULL THEN 0 END",
                 "enso__fase_nina": f"CASE WHEN {ENSO} <= -0.5 THEN 1.0::DOUBLE WHEN {ENSO} IS NOT NULL THEN 0 END",
                 "est__mes_sin": "sin(2 * pi() * month(mes) / 12)", "est__mes_cos": "cos(2 * pi() * month(mes) / 12)"})
    cols.update({f"enso__anom_lag{k}": f"lag({ENSO}, {k}) {v}" for k in (1, 3, 6, 9)})
    cols.update({f"enso__media{n}": roll("avg", ENSO, n) for n in (3, 6)})
    body = ", ".join(f"round({e}, 5) + 0.0::DOUBLE AS {n}" for n, e in cols.items())
    return f"{a}, {b} SELECT serie, CAST(mes AS VARCHAR) AS mes, {body} FROM df"


def features(spark, sf, base=None):
    """The price features (of the panel ``base`` if given), written once: a filter on a hundred window expressions would be copied into every step above it."""
    return materialise(op.price_features(panel(spark, sf) if base is None else base, "serie", SERIES, ENSO))


@query("price_features", sql_with("precio_mensual", then=f", {PANEL_SQL}, {features_sql()}"))
def price_features(spark, sf):
    return rounded(features(spark, sf), 5)


@query("future_change", sql_with("precio_mensual", then=f""", {PANEL_SQL}, m AS (SELECT *, 0.8 * soya_harina + 0.18 * soya_aceite - soya_grano
    AS crush FROM panel) SELECT serie, CAST(mes AS VARCHAR) AS mes, {', '.join(f"round(ln(lead(soya_grano, {h}) OVER v / soya_grano), 5) + 0.0::DOUBLE AS grano_{h}m" for h in (1, 3, 6))},
    {', '.join(f"round(lead(crush, {h}) OVER v - crush, 5) + 0.0::DOUBLE AS crush_{h}m" for h in (1, 3, 6))}
    FROM m WINDOW v AS (PARTITION BY serie ORDER BY mes)"""))
def future_change(spark, sf):
    from veta.functions.columns import crush_spread

    d = panel(spark, sf).withColumn("crush", crush_spread("soya_harina", "soya_aceite", "soya_grano"))
    for h in (1, 3, 6):
        d = op.future_change(d, "serie", "soya_grano", h, True, f"grano_{h}m")
        d = op.future_change(d, "serie", "crush", h, False, f"crush_{h}m")
    return rounded(d.select("serie", "mes", *[f"{t}_{h}m" for t in ("grano", "crush") for h in (1, 3, 6)]), 5)


def fixed_signal(spark, sf):
    """Oil returns with a fixed signal, so that SQL can follow the back-test."""
    d = features(spark, sf).select("serie", "mes", F.col("soya_aceite__ret_1m").alias("r")).filter("r is not null")
    return d.withColumn("p", F.pmod(F.month("mes") * 7 + F.year("mes"), F.lit(10)) / 10)


SIGNAL_SQL = f"""{PANEL_SQL}, r0 AS (SELECT serie, mes, ln(soya_aceite) - ln(lag(soya_aceite) OVER (PARTITION BY serie ORDER BY mes)) AS r,
    (month(mes) * 7 + year(mes)) % 10 / 10 AS p FROM panel),
    curva AS (SELECT serie, mes, r, CASE WHEN p < 0.45 THEN 0 ELSE r END AS estrategia FROM r0 WHERE r IS NOT NULL),
    capital AS (SELECT *, exp(sum(r) OVER v) AS capital_base, exp(sum(estrategia) OVER v) AS capital_cobertura,
      exp(sum(ln(1 + r)) OVER v) AS capital_simple_base, exp(sum(ln(1 + estrategia)) OVER v) AS capital_simple_cobertura
      FROM curva WINDOW v AS (PARTITION BY serie ORDER BY mes ROWS UNBOUNDED PRECEDING))"""
CAPITAL = "r estrategia capital_base capital_cobertura capital_simple_base capital_simple_cobertura"


@query("hedge_equity", sql_with("precio_mensual", then=f", {SIGNAL_SQL} SELECT serie, CAST(mes AS VARCHAR) AS mes, {sql_rounded(CAPITAL, 5)} FROM capital"))
def hedge_equity(spark, sf):
    return rounded(op.hedge(fixed_signal(spark, sf), "serie", "r", "p").select("serie", "mes", *CAPITAL.split()), 5)


@query("hedge_summary", sql_with("precio_mensual", then=f""", {SIGNAL_SQL} SELECT serie, count(*) AS n,
    round(arg_max(capital_base, mes) - 1, 5) AS ret_base, round(arg_max(capital_cobertura, mes) - 1, 5) AS ret_cobertura,
    round(stddev_pop(r), 5) AS vol_base, round(stddev_pop(estrategia), 5) AS vol_cobertura,
    round((1 - stddev_pop(estrategia) / stddev_pop(r)) * 100, 5) AS reduccion_vol_pct FROM capital GROUP BY 1"""))
def hedge_summary(spark, sf):
    return rounded(op.hedge_summary(op.hedge(fixed_signal(spark, sf), "serie", "r", "p"), "serie", "r"), 5)


@query("panel_split_summary", sql_with("precio_mensual", then=f""", {PANEL_SQL} SELECT CASE WHEN year(mes) < 1999 THEN 'train' ELSE 'test' END
    AS split, CAST(min(mes) AS VARCHAR) AS desde, CAST(max(mes) AS VARCHAR) AS hasta, count(*) AS n FROM panel GROUP BY 1"""))
def panel_split_summary(spark, sf):
    d = panel(spark, sf).withColumn("split", F.when(F.year("mes") < 1999, "train").otherwise("test"))
    return rounded(d.groupBy("split").agg(F.min("mes").alias("desde"), F.max("mes").alias("hasta"), F.count(F.lit(1)).alias("n")))


@query("granger_tests")
def granger_tests(spark, sf):
    """Causality between climate, oil and prices at lags 1 to 6, per series."""
    from veta.operators.stats import granger

    f = features(spark, sf).select("serie", "mes", F.col("soya_aceite__ret_1m").alias("aceite"), F.col("petroleo__ret_1m").alias("petroleo"),
                                   F.col("enso__anom").alias("enso"), F.col("soya_grano__ret_1m").alias("grano"))
    t = granger(f, "serie", "mes", [("petroleo", "aceite"), ("enso", "aceite"), ("petroleo", "grano"), ("enso", "grano"),
                                    ("grano", "enso")], 6)
    return rounded(t, 6)


def lag1_sql(cause: str, steps: str) -> str:
    """F of one lag from variances and covariances: what the lagged cause adds to the lagged effect."""
    v = "(PARTITION BY serie ORDER BY mes)"
    return f"""{cause}_lg AS (SELECT serie, mes, CASE WHEN soya_aceite > 0 THEN ln(soya_aceite) END AS la, {steps} AS lx FROM panel),
    {cause}_d AS (SELECT serie, mes, la - lag(la) OVER {v} AS y, {"lx - lag(lx) OVER " + v if cause == "petroleo" else "lx"} AS x FROM {cause}_lg),
    {cause}_l AS (SELECT serie, y, lag(y) OVER {v} AS y1, lag(x) OVER {v} AS x1 FROM {cause}_d WHERE y IS NOT NULL AND x IS NOT NULL),
    {cause}_m AS (SELECT serie, count(*) AS n, var_pop(y) AS yy, var_pop(y1) AS a, var_pop(x1) AS b, covar_pop(y, y1) AS ya, covar_pop(y, x1) AS yb, covar_pop(y1, x1) AS ab
      FROM {cause}_l WHERE y1 IS NOT NULL GROUP BY 1),
    {cause}_s AS (SELECT serie, n, yy - ya * ya / a AS r, yy - (ya * ya * b - 2 * ya * yb * ab + yb * yb * a) / (a * b - ab * ab) AS u FROM {cause}_m),
    {cause}_f AS (SELECT serie, '{cause}' AS causa, 'aceite' AS efecto, 1 AS rezago, round((r - u) / (u / (n - 3)), 5) AS f FROM {cause}_s WHERE n > 3)"""


@query("granger_lag1", sql_with("precio_mensual", then=f""", {PANEL_SQL}, {lag1_sql("petroleo", "CASE WHEN petroleo > 0 THEN ln(petroleo) END")},
    {lag1_sql("enso", ENSO)} SELECT * FROM petroleo_f UNION ALL SELECT * FROM enso_f"""))
def granger_lag1(spark, sf):
    """F of one lag of oil and of climate on bean oil, per series."""
    from veta.operators.stats import granger

    f = features(spark, sf).select("serie", "mes", F.col("soya_aceite__ret_1m").alias("aceite"), F.col("petroleo__ret_1m").alias("petroleo"),
                                   F.col("enso__anom").alias("enso"))
    return rounded(granger(f, "serie", "mes", [("petroleo", "aceite"), ("enso", "aceite")], 1).drop("p"), 5)


@query("granger_summary")
def granger_summary(spark, sf):
    from veta.operators.stats import granger, granger_summary as summarise

    f = features(spark, sf).select("serie", "mes", F.col("soya_aceite__ret_1m").alias("aceite"), F.col("petroleo__ret_1m").alias("petroleo"),
                                   F.col("enso__anom").alias("enso"))
    return summarise(granger(f, "serie", "mes", [("petroleo", "aceite"), ("enso", "aceite")], 12), ["serie"])


@query("adf_statistic")
def adf_statistic(spark, sf):
    from veta.operators.stats import adf

    f = features(spark, sf)
    return rounded(adf(f, "serie", "mes", ["soya_grano__ret_1m", "soya_aceite__ret_1m", "soya_harina__ret_1m", "petroleo__ret_1m",
                                           "maiz__ret_1m", "enso__anom"]), 6)


@query("crisis_months", sql_with("precio_mensual", then=f""", {PANEL_SQL}, m AS (SELECT avg({ENSO}) AS a, stddev_pop({ENSO}) AS s FROM panel)
    SELECT serie, CAST(mes AS VARCHAR) AS mes, round(({ENSO} - a) / s, 5) + 0.0::DOUBLE AS z FROM panel CROSS JOIN m WHERE abs(({ENSO} - a) / s) > 1.5"""))
def crisis_months(spark, sf):
    """Months whose scaled climate value is extreme (scaling by population moments)."""
    from veta.operators.prep import standardise

    d = standardise(panel(spark, sf).select("serie", "mes", F.col(ENSO).alias("z")), ["z"])
    return rounded(d.filter(F.abs("z") > 1.5), 5)
