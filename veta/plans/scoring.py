"""Evaluation measures on fixed predictions, so that SQL can follow them."""

from __future__ import annotations

from pyspark.sql import functions as F

from veta.operators import evaluate as op
from veta.operators import stats
from veta.operators.summary import crosstab, pivot_metric
from veta.plans import prices
from veta.plans.profiles import rounded
from veta.plans.registry import query
from veta.plans.shipping import DELAY_SQL, VIEWS, features
from veta.session import materialise
from veta.sources.roles import sql_with

PRED_SQL = DELAY_SQL + """, pred AS (SELECT id_embarque, incoterm, seg_cliente, y_sev, retraso_d, CASE WHEN y_sev = 2 THEN 1 ELSE 0 END AS y,
    (id_embarque * 37 % 101) / 100.0::DOUBLE AS s, id_embarque * 31 % 7 + 1.0::DOUBLE AS a, id_embarque * 17 % 5 + 1.0::DOUBLE AS b,
    id_embarque * 13 % 11 + 1.0::DOUBLE AS c FROM rasgo),
    prob AS (SELECT *, a / (a + b + c) AS p0, b / (a + b + c) AS p1, c / (a + b + c) AS p2,
      CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS clase FROM pred)"""


def predictions(spark, sf):
    i = F.col("id_embarque")
    d = features(spark, sf).select("id_embarque", "incoterm", "seg_cliente", "fecha_programada", "y_sev", "retraso_d",
                                   F.when(F.col("y_sev") == 2, 1).otherwise(0).alias("y"), (F.pmod(i * 37, F.lit(101)) / 100).alias("s"),
                                   (F.pmod(i * 31, F.lit(7)) + 1.0).alias("a"), (F.pmod(i * 17, F.lit(5)) + 1.0).alias("b"),
                                   (F.pmod(i * 13, F.lit(11)) + 1.0).alias("c"))
    total = F.col("a") + F.col("b") + F.col("c")
    d = d.withColumns({"p0": F.col("a") / total, "p1": F.col("b") / total, "p2": F.col("c") / total})
    return d.withColumn("clase", op.predicted_class(["a", "b", "c"]))


RATES_SQL = """tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) AS accuracy,
    round((coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) + coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0)) / 2, 6) AS balanced_acc,
    round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall,
    round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1"""


def counts_sql(threshold: str) -> str:
    return (f"count(*) FILTER (WHERE y = 1 AND s >= {threshold}) AS tp, count(*) FILTER (WHERE y = 0 AND s >= {threshold}) AS fp, "
            f"count(*) FILTER (WHERE y = 1 AND s < {threshold}) AS fn, count(*) FILTER (WHERE y = 0 AND s < {threshold}) AS tn")


@query("binary_metrics", sql_with(*VIEWS, then=f", {PRED_SQL}, k AS (SELECT incoterm, {counts_sql('0.5')} FROM pred GROUP BY 1) SELECT incoterm, {RATES_SQL} FROM k"))
def binary_metrics(spark, sf):
    return rounded(op.binary_metrics(predictions(spark, sf), "y", "s", 0.5, ["incoterm"]), 6)


THRESHOLDS = [0.5, 0.4, 0.35, 0.32, 0.3, 0.25]


@query("threshold_sweep", sql_with(*VIEWS, then=f", {PRED_SQL}, u AS (SELECT CAST(unnest({THRESHOLDS}) AS DOUBLE) AS umbral), k AS (SELECT umbral, "
                                   f"{counts_sql('umbral')} FROM pred CROSS JOIN u GROUP BY 1) SELECT umbral, {RATES_SQL} FROM k"))
def threshold_sweep(spark, sf):
    return rounded(op.threshold_sweep(predictions(spark, sf), "y", "s", THRESHOLDS), 6)


@query("roc_auc", sql_with(*VIEWS, then=f""", {PRED_SQL}, r AS (SELECT incoterm, y, rank() OVER (PARTITION BY incoterm ORDER BY s)
    + (count(*) OVER (PARTITION BY incoterm, s) - 1) / 2.0::DOUBLE AS k FROM pred) SELECT incoterm,
    round((sum(k) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM r GROUP BY 1"""))
def roc_auc(spark, sf):
    return rounded(op.roc_auc(predictions(spark, sf), "y", "s", ["incoterm"]), 6)


@query("average_precision", sql_with(*VIEWS, then=f""", {PRED_SQL}, g AS (SELECT incoterm, s, sum(y) AS p, count(*) AS n FROM pred GROUP BY 1, 2),
    c AS (SELECT *, sum(p) OVER v AS tp, sum(n) OVER v AS m FROM g WINDOW v AS (PARTITION BY incoterm ORDER BY s DESC))
    SELECT incoterm, round(sum(p * tp / m::DOUBLE) / sum(p), 6) AS ap FROM c GROUP BY 1"""))
def average_precision(spark, sf):
    return rounded(op.average_precision(predictions(spark, sf), "y", "s", ["incoterm"]), 6)


@query("multiclass_metrics", sql_with(*VIEWS, then=f""", {PRED_SQL}, m AS (SELECT incoterm, count(*)::DOUBLE AS n,
      avg(-ln(least(greatest(CASE y_sev WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END, 1e-6), 1))) AS logloss,
      avg(pow(p0 - CASE WHEN y_sev = 0 THEN 1 ELSE 0 END, 2) + pow(p1 - CASE WHEN y_sev = 1 THEN 1 ELSE 0 END, 2)
        + pow(p2 - CASE WHEN y_sev = 2 THEN 1 ELSE 0 END, 2)) AS brier,
      {', '.join(f"count(*) FILTER (WHERE y_sev = {i})::DOUBLE AS r{i}, count(*) FILTER (WHERE clase = {i})::DOUBLE AS s{i}, count(*) FILTER (WHERE y_sev = {i} AND clase = {i})::DOUBLE AS h{i}" for i in range(3))}
      FROM prob GROUP BY 1)
    SELECT incoterm, n, round(logloss, 6) AS logloss, round(brier, 6) AS brier, round((h0 + h1 + h2) / n, 6) AS accuracy,
      round((h0 / r0 + h1 / r1 + h2 / r2) / 3, 6) AS balanced_acc, round((2 * h0 / (r0 + s0) + 2 * h1 / (r1 + s1) + 2 * h2 / (r2 + s2)) / 3, 6) AS f1_macro,
      round(((h0 + h1 + h2) * n - r0 * s0 - r1 * s1 - r2 * s2) / sqrt((n * n - s0 * s0 - s1 * s1 - s2 * s2) * (n * n - r0 * r0 - r1 * r1 - r2 * r2)), 6)
        + 0.0::DOUBLE AS mcc, round(h2 / r2, 6) AS recall_foco FROM m"""))
def multiclass_metrics(spark, sf):
    return rounded(op.multiclass_metrics(predictions(spark, sf), "y_sev", ["p0", "p1", "p2"], ["incoterm"], focus=2), 6)


@query("auc_one_vs_rest", sql_with(*VIEWS, then=f""", {PRED_SQL}, l AS (SELECT incoterm, k AS clase, CASE WHEN y_sev = k THEN 1 ELSE 0 END AS y,
      CASE k WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS s FROM prob CROSS JOIN (SELECT unnest([0, 1, 2]) AS k)),
    r AS (SELECT incoterm, clase, y, rank() OVER (PARTITION BY incoterm, clase ORDER BY s) + (count(*) OVER (PARTITION BY incoterm, clase, s) - 1) / 2.0::DOUBLE AS k FROM l),
    a AS (SELECT incoterm, clase, (sum(k) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * (count(*) - sum(y))) AS auc FROM r GROUP BY 1, 2)
    SELECT incoterm, round(avg(auc), 6) AS auc_ovr FROM a GROUP BY 1"""))
def auc_one_vs_rest(spark, sf):
    return rounded(op.auc_one_vs_rest(predictions(spark, sf), "y_sev", ["p0", "p1", "p2"], ["incoterm"]), 6)


@query("class_report", sql_with(*VIEWS, then=f""", {PRED_SQL}, k AS (SELECT CAST(k AS INTEGER) AS clase, count(*) FILTER (WHERE y_sev = k AND clase = k) AS tp,
    count(*) FILTER (WHERE y_sev <> k AND clase = k) AS fp, count(*) FILTER (WHERE y_sev = k AND clase <> k) AS fn FROM prob CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1)
    SELECT clase, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall,
    round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1, tp + fn AS soporte FROM k"""))
def class_report(spark, sf):
    return rounded(op.class_report(predictions(spark, sf), "y_sev", "clase", [0, 1, 2]), 6)


@query("confusion", sql_with(*VIEWS, then=f""", {PRED_SQL} SELECT y_sev, {', '.join(f'count(*) FILTER (WHERE clase = {i}) AS "{i}"' for i in range(3))}
    FROM prob GROUP BY 1"""))
def confusion(spark, sf):
    return crosstab(predictions(spark, sf), "y_sev", "clase", [0, 1, 2])


FIXED = {"M1": "retraso_d * 0.5", "M2": "id_embarque % 40 - 10", "M3": "retraso_d + id_embarque % 9 - 4", "Media": "id_embarque % 1 + 5"}


def model_rows(spark, sf):
    """Delay predictions of fixed formulas standing in for models."""
    rows = F.array(*[F.struct(F.lit(m).alias("modelo"), F.expr(e).cast("double").alias("prediccion")) for m, e in FIXED.items()])
    # Written before the rows are repeated: measures and choices read them several times.
    d = materialise(predictions(spark, sf).select("id_embarque", "incoterm", "fecha_programada", "retraso_d")).withColumn("_m", F.explode(rows))
    return d.select("id_embarque", "incoterm", "fecha_programada", "retraso_d", "_m.*")


ROWS_SQL = PRED_SQL + ", filas AS (" + " UNION ALL ".join(
    f"SELECT id_embarque, incoterm, retraso_d, '{m}' AS modelo, CAST({e} AS DOUBLE) AS prediccion FROM pred" for m, e in FIXED.items()) + """),
    medida AS (SELECT incoterm, modelo, count(*) AS n, avg(abs(retraso_d - prediccion)) AS mae, sqrt(avg(pow(retraso_d - prediccion, 2))) AS rmse,
      1 - sum(pow(retraso_d - prediccion, 2)) / (var_pop(retraso_d) * count(*)) AS r2, avg(abs(retraso_d - prediccion) / greatest(retraso_d, 1)) * 100 AS mape_pct,
      avg(prediccion - retraso_d) AS sesgo, avg(abs(retraso_d - prediccion)) FILTER (WHERE retraso_d >= 6) AS mae_grave FROM filas GROUP BY 1, 2)"""
# The groups of the pivot.
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
MEASURES = "mae rmse r2 mape_pct sesgo mae_grave"


def measured(rows):
    return op.regression_metrics(rows, "retraso_d", "prediccion", ["incoterm", "modelo"], severe=6)


def model_metrics(spark, sf):
    return measured(model_rows(spark, sf))


@query("regression_metrics", sql_with(*VIEWS, then=f", {ROWS_SQL} SELECT incoterm, modelo, n, " + ", ".join(f"round({m}, 5) + 0.0::DOUBLE AS {m}" for m in MEASURES.split()) + " FROM medida"))
def regression_metrics(spark, sf):
    return rounded(model_metrics(spark, sf), 5)


@query("leaderboard_pivot", sql_with(*VIEWS, then=f""", {ROWS_SQL} SELECT modelo, {', '.join(f'round(avg(mae) FILTER (WHERE incoterm = {repr(v)}), 5) AS "{v}"' for v in PRIORITIES)}
    FROM medida GROUP BY 1"""))
def leaderboard_pivot(spark, sf):
    return rounded(pivot_metric(model_metrics(spark, sf), "modelo", ["incoterm"], "mae", list(PRIORITIES)), 5)


@query("champion", sql_with(*VIEWS, then=f""", {ROWS_SQL} SELECT incoterm, modelo, round(mae, 5) AS mae FROM (SELECT *, row_number() OVER
    (PARTITION BY incoterm ORDER BY mae, modelo) AS k FROM medida WHERE modelo <> 'Media') WHERE k = 1"""))
def champion(spark, sf):
    return rounded(op.champion(model_metrics(spark, sf), ["incoterm"], [("mae", "min")], exclude=["Media"]).select("incoterm", "modelo", "mae"), 5)


@query("ensemble_top3", sql_with(*VIEWS, then=f""", {ROWS_SQL}, mejor AS (SELECT incoterm, modelo FROM (SELECT *, row_number() OVER (PARTITION BY incoterm
    ORDER BY mae, modelo) AS k FROM medida WHERE modelo <> 'Media') WHERE k <= 3) SELECT incoterm, id_embarque, 'Ens_top3' AS modelo,
    round(avg(prediccion), 5) + 0.0::DOUBLE AS prediccion FROM filas JOIN mejor USING (incoterm, modelo) GROUP BY 1, 2"""))
def ensemble_top3(spark, sf):
    rows = model_rows(spark, sf)
    m = measured(rows).filter("modelo <> 'Media'")
    return rounded(op.ensemble(rows, m, ["incoterm"], ["id_embarque"]), 5)


@query("improvement", sql_with(*VIEWS, then=f""", {ROWS_SQL} SELECT a.incoterm, a.modelo, round((1 - a.mae / b.mae) * 100, 4) + 0.0::DOUBLE AS mejora_pct FROM medida a JOIN medida b
    ON a.incoterm = b.incoterm AND b.modelo = 'Media' WHERE a.modelo <> 'Media'"""))
def improvement(spark, sf):
    """Error saved against the mean, in percent."""
    m = materialise(model_metrics(spark, sf))
    base = m.filter("modelo = 'Media'").select("incoterm", F.col("mae").alias("_b"))
    d = m.filter("modelo <> 'Media'").join(base, "incoterm")
    return rounded(d.select("incoterm", "modelo", op.improvement_pct(F.col("mae"), F.col("_b")).alias("mejora_pct")))


@query("conformal", sql_with(*VIEWS, then=f""", {ROWS_SQL}, f AS (SELECT abs(retraso_d - prediccion) AS e, id_embarque % 2 AS parte FROM filas WHERE modelo = 'M3'),
    o AS (SELECT e, row_number() OVER (ORDER BY e) - 1 AS r, count(*) OVER () AS n FROM f WHERE parte = 0),
    h AS (SELECT *, least(1.0::DOUBLE, 0.8::DOUBLE * (1 + 1.0::DOUBLE / n)) * (n - 1) AS h FROM o),
    q AS (SELECT max(e) FILTER (WHERE r = floor(h)) + any_value(h - floor(h)) * (max(e) FILTER (WHERE r = ceil(h)) - max(e) FILTER (WHERE r = floor(h))) AS q FROM h)
    SELECT round(any_value(q), 5) AS q, round(avg(CASE WHEN e <= q THEN 100.0::DOUBLE ELSE 0 END), 5) AS cobertura_pct, round(2 * any_value(q), 5) AS ancho, count(*) AS n
    FROM f CROSS JOIN q WHERE parte = 1"""))
def conformal(spark, sf):
    d = model_rows(spark, sf).filter("modelo = 'M3'")
    return rounded(op.conformal(d.filter("id_embarque % 2 = 0"), d.filter("id_embarque % 2 = 1"), "retraso_d", "prediccion"), 5)


def change_rows(spark, sf):
    """Three-month changes of the bean price with a momentum forecast."""
    from veta.operators.prices import future_change

    base = prices.panel(spark, sf)
    p = future_change(base, "serie", "soya_grano", 3, True, "y")
    f = prices.features(spark, sf, base).select("serie", "mes", F.col("soya_grano__ret_3m").alias("p"))
    return materialise(p.select("serie", "mes", "soya_grano", "y").join(f, ["serie", "mes"]).filter("y is not null and p is not null"))


CHANGE_SQL = prices.PANEL_SQL + """, cambio AS (SELECT serie, mes, soya_grano, ln(lead(soya_grano, 3) OVER v / soya_grano) AS y, ln(soya_grano / lag(soya_grano, 3) OVER v) AS p
    FROM panel WINDOW v AS (PARTITION BY serie ORDER BY mes)), usable AS (SELECT *, row_number() OVER (PARTITION BY serie ORDER BY mes) AS k,
    soya_grano * exp(y) AS real, soya_grano * exp(p) AS dicho FROM cambio WHERE y IS NOT NULL AND p IS NOT NULL)"""


@query("change_metrics", sql_with("precio_mensual", then=f""", {CHANGE_SQL}, t AS (SELECT serie, avg(sign(p) * y) AS estrat_media, stddev_pop(sign(p) * y) AS sd
      FROM usable WHERE (k - 1) % 3 = 0 GROUP BY 1)
    SELECT serie, n, {', '.join(f'round({c}, 5) + 0.0::DOUBLE AS {c}' for c in 'mae_cambio rmse_cambio mae_usd rmse_usd sesgo_usd mape_pct r2_nivel r2_oos theil_u mae_rel_rw dir_acc_pct estrat_media'.split())},
      round(estrat_media / sd * 2, 5) + 0.0::DOUBLE AS estrat_sharpe FROM (SELECT serie, count(*) AS n, avg(abs(y - p)) AS mae_cambio, sqrt(avg(pow(y - p, 2))) AS rmse_cambio,
      avg(abs(real - dicho)) AS mae_usd, sqrt(avg(pow(real - dicho, 2))) AS rmse_usd, avg(dicho - real) AS sesgo_usd, avg(abs(real - dicho) / abs(real)) * 100 AS mape_pct,
      1 - sum(pow(real - dicho, 2)) / (var_pop(real) * count(*)) AS r2_nivel, 1 - sum(pow(y - p, 2)) / sum(y * y) AS r2_oos, sqrt(sum(pow(y - p, 2)) / sum(y * y)) AS theil_u,
      avg(abs(y - p)) / avg(abs(y)) AS mae_rel_rw, avg(CASE WHEN sign(p) = sign(y) THEN 100.0::DOUBLE ELSE 0 END) FILTER (WHERE y <> 0) AS dir_acc_pct FROM usable GROUP BY 1) JOIN t USING (serie)"""))
def change_metrics(spark, sf):
    return rounded(op.change_metrics(change_rows(spark, sf), "y", "p", "soya_grano", ["serie"], ["mes"], 3), 5)


@query("rank_ic", sql_with("precio_mensual", then=f""", {CHANGE_SQL}, r AS (SELECT serie, rank() OVER (PARTITION BY serie ORDER BY y) + (count(*) OVER (PARTITION BY serie, y) - 1) / 2.0::DOUBLE AS a,
    rank() OVER (PARTITION BY serie ORDER BY p) + (count(*) OVER (PARTITION BY serie, p) - 1) / 2.0::DOUBLE AS b FROM usable)
    SELECT serie, count(*) AS n, CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN round(corr(a, b), 6) + 0.0::DOUBLE END AS rho FROM r GROUP BY 1"""))
def rank_ic(spark, sf):
    """Rank correlation of the forecast with the actual change, per series."""
    return rounded(stats.rank_correlation(change_rows(spark, sf), "p", "y", ["serie"]), 6)


@query("dm_statistic", sql_with("precio_mensual", then=f""", {CHANGE_SQL}, d AS (SELECT serie, mes, y * y - pow(y - p, 2) AS d FROM usable),
    l AS (SELECT *, lag(d, 1) OVER v AS d1, lag(d, 2) OVER v AS d2 FROM d WINDOW v AS (PARTITION BY serie ORDER BY mes)),
    g AS (SELECT serie, count(*) AS n, avg(d) AS m, var_pop(d) + 2 * covar_pop(d, d1) + 2 * covar_pop(d, d2) AS s FROM l GROUP BY 1)
    SELECT serie, n, CASE WHEN s > 0 THEN round(m / sqrt(s / n) * sqrt((n + 1 - 6 + 6.0::DOUBLE / n) / n), 5) + 0.0::DOUBLE END AS dm FROM g"""))
def dm_statistic(spark, sf):
    d = stats.diebold_mariano(change_rows(spark, sf), ["serie"], ["mes"], "y", "p", 3)
    return rounded(d.select("serie", "n", "dm"), 5)


@query("dm_holm")
def dm_holm(spark, sf):
    """Test against no change with p-values, and which wins survive the correction over the series."""
    d = stats.diebold_mariano(change_rows(spark, sf), ["serie"], ["mes"], "y", "p", 3).withColumn("familia", F.lit("grano_3m"))
    return rounded(stats.holm(d, ["familia"], "p", ["serie"]), 6)


@query("holm", """WITH p AS (SELECT o_orderpriority AS familia, o_custkey % 12 AS modelo, (min(o_orderkey) + 1) / 20000.0::DOUBLE AS p FROM orders GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY familia ORDER BY p, modelo) AS k, count(*) OVER (PARTITION BY familia) AS m FROM p)
    SELECT familia, modelo, round(p, 6) AS p, min(CASE WHEN p <= 0.05::DOUBLE / (m - k + 1) THEN 1 ELSE 0 END) OVER (PARTITION BY familia ORDER BY k ROWS UNBOUNDED PRECEDING) = 1
      AS rechaza FROM r""")
def holm(spark, sf):
    from veta.sources import roles

    o = roles.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("familia"), F.pmod("o_custkey", F.lit(12)).alias("modelo"))
    return rounded(stats.holm(o.agg(((F.min("o_orderkey") + 1) / 20000.0).alias("p")), ["familia"], "p", ["modelo"]), 6)


@query("smoke_gate", sql_with(*VIEWS, then=f""", {ROWS_SQL} SELECT incoterm, modelo, 'r2' AS metrica, round(r2, 5) AS valor, CASE WHEN r2 <= 0 THEN 'abandonar'
    WHEN r2 > 0.8 THEN 'sospechoso' ELSE 'seguir' END AS veredicto FROM medida"""))
def smoke_gate(spark, sf):
    m = model_metrics(spark, sf).select("incoterm", "modelo", F.lit("r2").alias("metrica"), F.col("r2").alias("valor"))
    return rounded(op.smoke_gate(m, {"auc": (0.60, 0.95), "r2": (0.0, 0.8)}), 5)


@query("accuracy_vs_majority")
def accuracy_vs_majority(spark, sf):
    """Exact binomial test that the accuracy beats always naming the largest class."""
    from veta.functions.tails import binomial_pvalue

    d = predictions(spark, sf)
    g = d.groupBy("incoterm").agg(F.count_if(F.col("clase") == F.col("y_sev")).cast("double").alias("aciertos"), F.count(F.lit(1)).cast("double").alias("n"),
                                  F.greatest(*[F.count_if(F.col("y_sev") == c) for c in (0, 1, 2)]).alias("_m"))
    g = g.withColumn("mayoria", F.col("_m") / F.col("n")).drop("_m")
    return rounded(g.withColumn("p", binomial_pvalue("aciertos", "n", "mayoria")), 6)
