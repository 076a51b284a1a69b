"""Model fronts: shipment delay, freight, sensor risk, grain quality, shrink drivers, price forecasts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from veta.functions.columns import crush_spread, direction_class, shrink_rate
from veta.operators import evaluate as ev
from veta.operators import linear
from veta.operators import models as md
from veta.operators import prices as pr
from veta.operators import sensors as sn
from veta.operators import shipping as sh
from veta.operators import splits
from veta.plans import prices, sensors, shipping
from veta.plans.profiles import rounded
from veta.plans.registry import query
from veta.plans.shipping import DELAY_SQL, VIEWS
from veta.session import materialise, stored
from veta.sources import roles
from veta.sources.io import sample_percent
from veta.sources.roles import ENSO, sql_with

# Sizes of the ready-made queries; the operators default to the larger ones of a full run.
TREES, ROUNDS = 20, 10


def parts(df, label="split"):
    tr, va, te = (df.filter(F.col(label) == s) for s in ("train", "validation", "test"))
    return tr, va, te, tr.unionByName(va)


def delay_frame(spark, sf):
    """Delay features with the chronological split, encoded on the training rows and written once."""
    wanted = ["id_embarque", "fecha_programada", "y_sev", "retraso_d", *sh.NUMBERS, *sh.CATEGORIES]
    # Written before the split, which reads it twice.
    d = materialise(shipping.features(spark, sf).select(*wanted))
    d = materialise(splits.chronological(d, ["fecha_programada", "id_embarque"]))
    enc = md.learn_encoder(d.filter("split = 'train'"), sh.NUMBERS, sh.CATEGORIES)
    keep = ["id_embarque", "fecha_programada", "puerto", "tipo_dom", "y_sev", F.col("retraso_d").cast("double").alias("retraso_d"), "split"]
    return materialise(enc.apply(d).select(*keep, *enc.features)), enc.features


SPLIT_SQL = DELAY_SQL + """, n AS (SELECT count(*) AS n FROM rasgo), o AS (SELECT *, row_number() OVER (ORDER BY fecha_programada, id_embarque) AS k FROM rasgo),
    s AS (SELECT o.*, CASE WHEN k <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN k <= floor(n * 0.85::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM o CROSS JOIN n)"""


@query("model_baselines", sql_with(*VIEWS, then=f""", {SPLIT_SQL}, m AS (SELECT avg(retraso_d) AS m FROM s WHERE split = 'train'),
    c AS (SELECT y_sev AS mayor FROM s WHERE split = 'train' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT split, count(*) AS n, round(avg(abs(retraso_d - m)), 5) AS mae_media, round(avg(CASE WHEN y_sev = mayor THEN 1.0::DOUBLE ELSE 0 END), 5) AS acc_mayoria
    FROM s CROSS JOIN m CROSS JOIN c WHERE split <> 'train' GROUP BY 1"""))
def model_baselines(spark, sf):
    """Mean and majority baselines on validation and test."""
    d = materialise(shipping.features(spark, sf).select("fecha_programada", "id_embarque", "y_sev", "retraso_d"))
    d = splits.chronological(d, ["fecha_programada", "id_embarque"])
    d = materialise(d.select("split", "y_sev", F.col("retraso_d").cast("double").alias("retraso_d")))
    tr, rest = d.filter("split = 'train'"), d.filter("split <> 'train'")
    p = md.majority_model(3)(tr, [], "y_sev")(md.mean_model(tr, [], "retraso_d")(rest))
    hit = F.when(F.element_at(F.array("p0", "p1", "p2"), F.col("y_sev") + 1) == 1, 1.0).otherwise(0.0)
    return rounded(p.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("retraso_d") - F.col("prediccion"))).alias("mae_media"),
                                          F.avg(hit).alias("acc_mayoria")), 5)


def severity_models():
    return {"Mayoritaria": md.majority_model(3), "Logit": md.logistic_model(3, 0.05), "LDA": md.lda_model(3), "QDA": md.qda_model(3),
            "RF_clf": md.forest_classes(3, TREES, depth=5), "HGB_clf": md.hist_boosted_classes(3, 150, 0.04, 3, 15, 1.0, ids=["id_embarque"])}


P3 = ["p0", "p1", "p2"]


@query("severity_leaderboard")
def severity_leaderboard(spark, sf):
    """Delay severity: models ranked on validation, the champion refitted and judged once on test."""
    d, f = delay_frame(spark, sf)
    tr, va, te, tv = parts(d)
    models = severity_models()
    val, _ = md.compare(models, tr, va, f, "y_sev", ["y_sev", *P3])
    board = materialise(ev.multiclass_metrics(val, "y_sev", P3, ["modelo"], focus=2).withColumn("fase", F.lit("val")))
    best = ev.champion(board, ["fase"], [("f1_macro", "max"), ("recall_foco", "max")], exclude=["Mayoritaria"]).first()["modelo"]
    tst, _ = md.compare({best: models[best]}, tv, te, f, "y_sev", ["y_sev", *P3])
    final = ev.multiclass_metrics(tst, "y_sev", P3, ["modelo"], focus=2).withColumn("fase", F.lit("test"))
    return rounded(board.unionByName(final), 5)


@query("boosted_severity")
def boosted_severity(spark, sf):
    """Boosted histogram trees for the three severities under one softmax loss, 150 rounds."""
    d, f = delay_frame(spark, sf)
    tr, va, _, _ = parts(d)
    p = md.hist_boosted_classes(3, 150, 0.04, 3, 15, 1.0, ids=["id_embarque"])(tr, f, "y_sev")(va).withColumn("modelo", F.lit("HGB_clf"))
    return rounded(ev.multiclass_metrics(p.select("modelo", "y_sev", *P3), "y_sev", P3, ["modelo"]), 5)


@query("delay_leaderboard")
def delay_leaderboard(spark, sf):
    """Days of delay: mean, ridge, forest, extra trees and boosting on validation; champion on test."""
    d, f = delay_frame(spark, sf)
    tr, va, te, tv = parts(d)
    order = ["fecha_programada", "id_embarque"]
    models = {"Media": md.mean_model, "Ridge": md.ridge_model(order), "RF": md.forest_number(TREES, depth=5), "ET": md.extra_trees_number(TREES, depth=5),
              "GBT": md.boosted_number()}
    val, _ = md.compare(models, tr, va, f, "retraso_d", ["retraso_d", "prediccion"])
    board = materialise(ev.regression_metrics(val, "retraso_d", "prediccion", ["modelo"], severe=6).withColumn("fase", F.lit("val")))
    best = ev.champion(board, ["fase"], [("mae", "min")], exclude=["Media"]).first()["modelo"]
    tst, _ = md.compare({best: models[best]}, tv, te, f, "retraso_d", ["retraso_d", "prediccion"])
    return rounded(board.unionByName(ev.regression_metrics(tst, "retraso_d", "prediccion", ["modelo"], severe=6).withColumn("fase", F.lit("test"))), 5)


@query("delay_conformal")
def delay_conformal(spark, sf):
    """80 % interval of a ridge delay model, calibrated with residuals of rows the model has not seen."""
    d, f = delay_frame(spark, sf)
    tr, va, te, _ = parts(d)
    p = md.ridge_model(["fecha_programada", "id_embarque"])(tr, f, "retraso_d")
    return rounded(ev.conformal(p(va), p(te), "retraso_d", "prediccion"), 5)


@query("predicted_risk_panel")
def predicted_risk_panel(spark, sf):
    """Expected demurrage by route and carrier from predicted severe delays."""
    d, f = delay_frame(spark, sf)
    _, _, te, tv = parts(d)
    p = md.logistic_model(3, 0.05)(tv, f, "y_sev")(te)
    return sh.risk_panel(p.withColumn("p_grave", F.when(ev.predicted_class(P3) == 2, 1.0).otherwise(0.0)))


@query("calibration")
def calibration(spark, sf):
    """Brier score and log loss of a severity model before and after sigmoid calibration."""
    d, f = delay_frame(spark, sf)
    tr, _, te, tv = parts(d)
    base = md.logistic_model(3, 0.05)
    models = {"sin-calibrar": base(tv, f, "y_sev"), "calibrado": md.calibrated(base, 3, ["id_embarque"])(tr, f, "y_sev")}
    out = None
    for n, m in models.items():
        p = m(te).select("y_sev", *P3, F.lit(n).alias("modelo"))
        out = p if out is None else out.unionByName(p)
    return rounded(ev.multiclass_metrics(out, "y_sev", P3, ["modelo"]).select("modelo", "n", "brier", "logloss"), 5)


@query("tree_importance")
def tree_importance(spark, sf):
    """Ten most important features of the forest for severity."""
    d, f = delay_frame(spark, sf)
    tr = d.filter("split = 'train'")
    return rounded(md.tree_importance(tr, md.forest_classes(3, TREES, depth=5)(tr, f, "y_sev"), f), 5)


@query("lda_scores")
def lda_scores(spark, sf):
    """Discriminant axes: share of variance and the strongest loadings of the first."""
    d, f = delay_frame(spark, sf)
    numbers = [c for c in f if c[2:] in sh.NUMBERS]
    share, axes = linear.lda_axes(linear.moments_by(d.filter("split = 'train'"), numbers, "y_sev"))
    rows = sorted(((n, float(v)) for n, v in zip(numbers, axes[:, 0], strict=True)), key=lambda r: -abs(r[1]))[:6]
    return rounded(spark.createDataFrame([(*r, float(share[0])) for r in rows], "variable string, carga double, varianza_eje1 double"), 6)


@query("knn_model")
def knn_model(spark, sf):
    """Severity from the 25 nearest earlier shipments, weighted by distance."""
    d, f = delay_frame(spark, sf)
    numbers = [c for c in f if c[2:] in sh.NUMBERS]
    tr, va, _, _ = parts(d.select("id_embarque", "y_sev", "split", *numbers))
    p = md.knn_classes(3, "id_embarque", 25)(tr, numbers, "y_sev")(va)
    return rounded(ev.multiclass_metrics(p.withColumn("modelo", F.lit("KNN")), "y_sev", P3, ["modelo"]), 5)


@query("freight_model")
def freight_model(spark, sf):
    """Freight cost: chronological split, mean, ridge, forest and boosting; improvement over the mean."""
    ids = ["id_embarque", "linea", "id_parte"]
    d = sh.freight_rows(roles.dispatches(spark, sf), roles.carriers(spark, sf))
    # The models read their part and their columns some thirty times.
    d = stored(splits.chronological(d, ["fecha_salida", *ids, "id_transporte", "costo_flete_usd"]), "split")
    enc = md.learn_encoder(d.filter("split = 'train'"), ["distancia_km", "duracion_h", "capacidad_tn", "mes"], ["tipo", "origen", "destino"])
    d = stored(enc.apply(d).select(*ids, "fecha_salida", "costo_flete_usd", "split", *enc.features), "split")
    tr, va, te, tv = parts(d)
    models = {"Media": md.mean_model, "Ridge": md.ridge_model(["fecha_salida", *ids, "costo_flete_usd"], [1.0]),
              "RF": md.forest_number(TREES, 5, depth=6), "GBT": md.boosted_number()}
    y, f = "costo_flete_usd", enc.features
    val, _ = md.compare(models, tr, va, f, y, [y, "prediccion"])
    board = materialise(ev.regression_metrics(val, y, "prediccion", ["modelo"]).withColumn("fase", F.lit("val")))
    best = ev.champion(board, ["fase"], [("mae", "min")], exclude=["Media"]).first()["modelo"]
    tst, _ = md.compare({m: models[m] for m in ("Media", best)}, tv, te, f, y, [y, "prediccion"])
    final = materialise(ev.regression_metrics(tst, y, "prediccion", ["modelo"]).withColumn("fase", F.lit("test")))
    base = final.filter("modelo = 'Media'").first()["mae"]
    return rounded(board.unionByName(final).withColumn("mejora_pct", F.when(F.col("fase") == "test", ev.improvement_pct(F.col("mae"), F.lit(base)))), 5)


@query("sensor_risk_model")
def sensor_risk_model(spark, sf):
    """Risk of a hot next reading: two models, chosen on validation, thresholds swept there, test read once at 0.32."""
    d = sn.labelled(sensors.features(spark, sf)).withColumn("orden", F.col("ts"))
    d = materialise(splits.chronological(d, ["ts", "id_lectura"]))
    enc = md.learn_encoder(d.filter("split = 'train'"), sn.RISK_FEATURES)
    d = materialise(enc.apply(d).select("id_lectura", "riesgo", "split", *enc.features))
    tr, va, te, tv = parts(d)
    models = {"Logistica": md.logistic_model(2), "RandomForest": md.forest_classes(2, TREES, 3, 6)}
    val, _ = md.compare(models, tr, va, enc.features, "riesgo", ["riesgo", "p1"])
    val = materialise(val)
    board = ev.binary_metrics(val, "riesgo", "p1", 0.5, ["modelo"]).withColumn("fase", F.lit("val"))
    best = ev.champion(board, ["fase"], [("f1", "max")]).first()["modelo"]
    sweep = ev.threshold_sweep(val.filter(F.col("modelo") == best), "riesgo", "p1", [0.5, 0.4, 0.35, 0.32, 0.3, 0.25])
    tst = materialise(models[best](tv, enc.features, "riesgo")(te).select("riesgo", "p1"))
    final = ev.threshold_sweep(tst, "riesgo", "p1", [0.32]).withColumn("fase", F.lit("test"))
    return rounded(sweep.withColumn("fase", F.lit("val")).unionByName(final).withColumn("modelo", F.lit(best)), 5)


@query("quality_model")
def quality_model(spark, sf):
    """Declared quality from lab readings: stratified split, logistic with and without components, discriminant axis."""
    classes = {"DESCUENTO": 0, "ESTANDAR": 1, "PREMIUM": 2}
    y = F.when(F.col("calidad_grano") == "DESCUENTO", 0).when(F.col("calidad_grano") == "ESTANDAR", 1).otherwise(2)
    ids = ["id_recepcion", "id_parte", "id_silo", "peso_neto", "valor_usd"]
    numbers = ["peso_neto", "humedad_pct", "impurezas_pct", "aceite_pct", "proteina_pct", "temperatura_grano_c"]
    d = roles.receipts(spark, sf).filter(F.col("calidad_grano").isin(list(classes)) & F.col("peso_neto").between(1, 200)).withColumn("y", y)
    d = d.select("y", *dict.fromkeys([*ids, *numbers]))
    d = materialise(splits.stratified(d, "y", ids, {"train": 0.7, "validation": 0.15, "test": 0.15}))
    enc = md.learn_encoder(d.filter("split = 'train'"), numbers)
    d = materialise(enc.apply(d).select("y", "split", *enc.features))
    tr, va, te, tv = parts(d)
    models = {"Mayoritaria": md.majority_model(3), "LogReg": md.logistic_model(3), "PCA+LogReg": md.reduced(md.logistic_model(3), 0.95),
              "LDA+LogReg": md.lda_axis(md.logistic_model(3))}
    val, _ = md.compare(models, tr, va, enc.features, "y", ["y", *P3])
    board = materialise(ev.multiclass_metrics(val, "y", P3, ["modelo"]).withColumn("fase", F.lit("val")))
    best = ev.champion(board, ["fase"], [("f1_macro", "max")], exclude=["Mayoritaria"]).first()["modelo"]
    tst, _ = md.compare({best: models[best]}, tv, te, enc.features, "y", ["y", *P3])
    return rounded(board.unionByName(ev.multiclass_metrics(tst, "y", P3, ["modelo"]).withColumn("fase", F.lit("test"))), 5)


DRIVERS = ["peso_neto", "humedad_pct", "impurezas_pct", "aceite_pct", "proteina_pct", "temperatura_grano_c", "mes_n", "hora_n"]


@query("permutation_importance")
def permutation_importance(spark, sf):
    """Drivers of the shrink: boosted trees, importance by shuffling."""
    ids = ["id_recepcion", "id_parte", "id_silo", "peso_neto", "valor_usd"]
    d = roles.receipts(spark, sf).filter(F.col("peso_neto").between(1, 200))
    d = d.withColumns({"merma": F.col("peso_neto") * shrink_rate("humedad_pct", "impurezas_pct"), "mes_n": F.month("fecha_hora").cast("double"),
                       "hora_n": F.hour("fecha_hora").cast("double")})
    d = materialise(d.select("id_recepcion", "id_parte", "id_silo", "valor_usd", "merma", *DRIVERS).dropna())
    p = md.boosted_number(ROUNDS, 0.2, 4)(d, DRIVERS, "merma")
    return rounded(md.permutation_importance(p, d, DRIVERS, "merma", ["id_recepcion", "id_parte", "id_silo", "valor_usd"], 2), 5)


@query("smoke_model")
def smoke_model(spark, sf):
    """Five-minute check before modelling: 5 % of the receipts, a plain logistic model, verdict on the AUC."""
    ids = ["id_recepcion", "id_parte", "id_silo", "valor_usd"]
    d = sample_percent(roles.receipts(spark, sf), 5, ids)
    cut = F.col("peso_neto") * shrink_rate("humedad_pct", "impurezas_pct")
    d = d.withColumn("y", F.when(cut > 0.5, 1).otherwise(0))
    d = splits.stratified(d, "y", ids, {"train": 0.7, "validation": 0.15, "test": 0.15})
    enc = md.learn_encoder(d.filter("split = 'train'"), ["humedad_pct", "aceite_pct"])
    d = materialise(enc.apply(d).select("y", "split", *enc.features))
    p = md.logistic_model(2)(d.filter("split = 'train'"), enc.features, "y")(d.filter("split <> 'train'"))
    m = ev.roc_auc(p, "y", "p1").select(F.lit("auc").alias("metrica"), F.col("auc").alias("valor"))
    return rounded(ev.smoke_gate(m, {"auc": (0.60, 0.95), "r2": (0.0, 0.8)}), 5)


# ------------------------------------------------------------------ prices
def price_frame(spark, sf, horizon=3):
    """Features, three-month change of the bean price and purged split, over all series; gaps get the medians of the training rows."""
    base = prices.panel(spark, sf)
    p = pr.future_change(base, "serie", "soya_grano", horizon, True, "y").select("serie", "mes", "soya_grano", "y")
    f = prices.features(spark, sf, base)
    names = pr.filled_features(f)
    whole = f.join(p, ["serie", "mes"])
    whole = materialise(whole)
    rows = splits.purged(whole.filter("y is not null"), ["serie"], ["mes"], horizon)
    rows = rows.unionByName(whole.filter("y is null").withColumn("split", F.lit("futuro")))
    rows = materialise(rows.withColumn("fila", F.concat_ws("|", "serie", F.col("mes").cast("string"))))
    enc = md.learn_encoder(rows.filter("split = 'train'"), names)
    return materialise(enc.apply(rows).select("serie", "mes", "fila", "soya_grano", "y", "split", *enc.features)), enc.features


ORDER = ["mes", "serie"]


def sparse_models():
    """The whole grids: 40 penalties of the lasso, 30 penalties by 4 mixes of the elastic net."""
    return {"Lasso": md.sparse_linear(ORDER, [1.0], np.logspace(-5, -0.5, 40)), "ElasticNet": md.sparse_linear(ORDER, [0.2, 0.5, 0.8, 0.95], np.logspace(-5, -0.5, 30))}


def price_models():
    return {"Naive_RW": md.zero_model, "Media_hist": md.mean_model, "Ridge": md.ridge_model(ORDER), "PCA_Ridge": md.reduced(md.ridge_model(ORDER), 0.90),
            "PLS": md.pls_model(ORDER), **sparse_models(), "PCA_KNN": md.reduced(md.knn_number("fila", 20), 0.90)}


KEEP = ["serie", "mes", "soya_grano", "y", "prediccion"]


@query("price_leaderboard")
def price_leaderboard(spark, sf):
    """Price change models and the mean of the best three: validation, then test of the champion."""
    d, f = price_frame(spark, sf)
    tr, va, te, tv = parts(d)
    models = price_models()
    val = materialise(md.compare(models, tr, va, f, "y", KEEP)[0])
    board = ev.change_metrics(val, "y", "prediccion", "soya_grano", ["modelo"], ["mes", "serie"], 3).withColumn("fase", F.lit("val"))
    board = materialise(board)
    usable = board.filter(~F.col("modelo").isin("Naive_RW", "Media_hist"))
    ens = materialise(ev.ensemble(val, usable, [], ["serie", "mes", "soya_grano", "y"], "mae_cambio"))
    board = materialise(board.unionByName(ev.change_metrics(ens, "y", "prediccion", "soya_grano", ["modelo"], ["mes", "serie"], 3).withColumn("fase", F.lit("val"))))
    best = ev.champion(board, ["fase"], [("mae_cambio", "min")], exclude=["Naive_RW", "Media_hist", "Ens_top3"]).first()["modelo"]
    tst = materialise(md.compare({m: models[m] for m in ("Naive_RW", best)}, tv, te, f, "y", KEEP)[0])
    return rounded(board.unionByName(ev.change_metrics(tst, "y", "prediccion", "soya_grano", ["modelo"], ["mes", "serie"], 3)
                                     .withColumn("fase", F.lit("test"))), 5)


@query("boosted_price")
def boosted_price(spark, sf):
    """Boosted histogram trees for the price change, 200 rounds, validation errors."""
    d, f = price_frame(spark, sf)
    tr, va, _, _ = parts(d)
    p = materialise(md.hist_boosted_number(200, 0.04, 3, 15, 1.0, ids=["fila"])(tr, f, "y")(va).select(*KEEP, F.lit("HGB").alias("modelo")))
    return rounded(ev.change_metrics(p, "y", "prediccion", "soya_grano", ["modelo"], ["mes", "serie"], 3), 5)


@query("sparse_price_model")
def sparse_price_model(spark, sf):
    """Lasso and elastic net on the price change, validation errors."""
    d, f = price_frame(spark, sf)
    tr, va, _, _ = parts(d)
    return rounded(ev.regression_metrics(md.compare(sparse_models(), tr, va, f, "y", ["y", "prediccion"])[0], "y", "prediccion", ["modelo"]), 6)


@query("direction_model")
def direction_model(spark, sf):
    """Down, sideways or up by half a training deviation: discriminants against the majority."""
    d, f = price_frame(spark, sf)
    f = [c for c in f if c.endswith(("__ret_3m", "crush__z24", "enso__anom", "__mes_sin", "__mes_cos"))]
    sd = d.filter("split = 'train'").agg(F.stddev_pop("y")).first()[0]
    d = materialise(d.filter("y is not null").withColumn("clase", direction_class("y", 0.5 * sd)))
    _, _, te, tv = parts(d)
    models = {"Mayoritaria": md.majority_model(3), "LDA": md.lda_model(3, 0.3), "PCA_LDA": md.reduced(md.lda_model(3, 0.0), 0.90),
              "PCA_QDA": md.reduced(md.qda_model(3, 0.5), 0.80)}
    return rounded(ev.multiclass_metrics(materialise(md.compare(models, tv, te, f, "clase", ["clase", *P3])[0]), "clase", P3, ["modelo"]), 5)


@query("ablation")
def ablation(spark, sf):
    """Error with and without the climate features."""
    d, f = price_frame(spark, sf)
    tr, va, _, _ = parts(d)
    bare = [c for c in f if not c.startswith("x_enso__")]
    m = md.reduced(md.ridge_model(ORDER), 0.90)
    mae = {}
    for name, cols in (("con", f), ("sin", bare)):
        mae[name] = m(tr, cols, "y")(va).agg(F.avg(F.abs(F.col("y") - F.col("prediccion")))).first()[0]
    rows = [("PCA_Ridge", mae["con"], mae["sin"], (mae["sin"] - mae["con"]) / mae["sin"] * 100)]
    return rounded(spark.createDataFrame(rows, "modelo string, mae_con double, mae_sin double, delta_pct double"), 6)


@query("forecast")
def forecast(spark, sf):
    """Forecast three months ahead from the last month with a price of every series, with an 80 % interval and a signal."""
    d, f = price_frame(spark, sf)
    tr, va, _, _ = parts(d)
    m = md.ridge_model(ORDER)
    fitted = m(tr, f, "y")
    q = ev.conformal(fitted(va), fitted(va), "y", "prediccion").first()["q"]
    known, last = d.filter("y is not null"), d.filter("soya_grano is not null").groupBy("serie").agg(F.max("mes").alias("mes"))
    p = m(known, f, "y")(d.join(last, ["serie", "mes"])).withColumn("q", F.lit(q))
    c = F.col("prediccion")
    return rounded(p.select("serie", F.col("mes").alias("fecha_origen"), F.add_months("mes", 3).alias("fecha_objetivo"), F.col("soya_grano").alias("nivel_actual"),
                            (F.col("soya_grano") * F.exp(c)).alias("pronostico"), (F.col("soya_grano") * F.exp(c - q)).alias("ic80_inf"),
                            (F.col("soya_grano") * F.exp(c + q)).alias("ic80_sup"), ((F.exp(c) - 1) * 100).alias("cambio_esperado_pct"),
                            F.when(c - q > 0, "ALZA").when(c + q < 0, "BAJA").otherwise("SIN SENAL").alias("senal")), 5)


def oil_signal(spark, sf):
    base = prices.panel(spark, sf)
    f = prices.features(spark, sf, base)
    w = f.select("serie", "mes", F.col("soya_aceite__ret_1m").alias("r"), F.col("petroleo__ret_1m_lag1").alias("pet_l1"),
                 F.col("petroleo__ret_1m_lag2").alias("pet_l2"), F.col("enso__anom_lag1").alias("nino_l1"))
    d = pr.future_change(base, "serie", "soya_aceite", 1, True, "sig").select("serie", "mes", "sig")
    return w.join(d, ["serie", "mes"]).withColumn("y", F.when(F.col("sig") > 0, 1.0).when(F.col("sig").isNotNull(), 0.0))


@query("walk_forward")
def walk_forward(spark, sf):
    """Will oil rise next month?  Expanding logistic signal, hit rate and AUC per series."""
    p = materialise(md.walk_forward(oil_signal(spark, sf), "serie", "mes", ["pet_l1", "pet_l2", "nino_l1"], "y"))
    m = ev.binary_metrics(p, "y", "p", 0.5, ["serie"]).select("serie", (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n"),
                                                             F.col("accuracy").alias("acierto"))
    return rounded(m.join(ev.roc_auc(p, "y", "p", ["serie"]), "serie"), 6)


@query("hedge_backtest")
def hedge_backtest(spark, sf):
    """Hold or hedge oil by the walk-forward signal, the signal applied to the month after it."""
    s = oil_signal(spark, sf)
    p = md.walk_forward(s, "serie", "mes", ["pet_l1", "pet_l2", "nino_l1"], "y").select("serie", "mes", "p")
    d = materialise(s.select("serie", "mes", "r").join(p, ["serie", "mes"]))
    return rounded(pr.hedge_summary(pr.hedge(d, "serie", "r", "p", apply_lag=1), "serie", "r"), 6)


@query("crush_forecast_error")
def crush_forecast_error(spark, sf):
    """Crush margin three months ahead (difference target): ridge against no change."""
    base = prices.panel(spark, sf)
    p = base.withColumn("crush", crush_spread("soya_harina", "soya_aceite", "soya_grano"))
    p = pr.future_change(p, "serie", "crush", 3, False, "y").select("serie", "mes", "crush", "y")
    f = prices.features(spark, sf, base)
    names = [c for c in pr.feature_names(f) if c.startswith(("crush__", "rat__", "est__"))]
    rows = materialise(splits.purged(f.dropna(subset=names).join(p.filter("y is not null"), ["serie", "mes"]), ["serie"], ["mes"], 3))
    enc = md.learn_encoder(rows.filter("split = 'train'"), names)
    tr, va, _, _ = parts(materialise(enc.apply(rows).select("serie", "mes", "crush", "y", "split", *enc.features)))
    val = materialise(md.compare({"Naive_RW": md.zero_model, "Ridge": md.ridge_model(ORDER)}, tr, va, enc.features, "y", ["serie", "mes", "crush", "y", "prediccion"])[0])
    return rounded(ev.change_metrics(val, "y", "prediccion", "crush", ["modelo"], ["mes", "serie"], 3, logs=False), 5)
