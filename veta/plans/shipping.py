"""Shipment and freight fronts."""

from __future__ import annotations

from pyspark.sql import functions as F

from veta.functions.columns import tidy
from veta.operators import shipping as op
from veta.plans.profiles import rounded
from veta.plans.registry import query
from veta.sources import roles
from veta.sources.roles import sql_with

VIEWS = ("embarque", "puerto", "cliente", "envio", "transporte")
ENRICH_SQL = """resumen AS (SELECT id_embarque, count(*) AS n_envios, sum(distancia_km) AS distancia_tot, sum(costo_flete_usd) AS flete_tot,
      arg_max(tipo, (distancia_km, id_transporte)) AS tipo_dom, avg(date_diff('hour', fecha_salida, fecha_llegada)) AS horas_transito_med
      FROM envio LEFT JOIN transporte USING (id_transporte) GROUP BY 1),
    rico AS (SELECT e.*, puerto, tipo_puerto, rio_mar, segmento AS seg_cliente, pais AS pais_cliente, n_envios, distancia_tot, flete_tot,
      tipo_dom, horas_transito_med FROM embarque e LEFT JOIN puerto USING (id_puerto) LEFT JOIN cliente USING (id_cliente)
      LEFT JOIN resumen USING (id_embarque))"""
DELAY_SQL = ENRICH_SQL + """, base AS (SELECT *, CAST(floor((epoch(fecha_real) - epoch(fecha_programada)) / 86400) AS BIGINT) AS retraso_d,
      CAST(floor((epoch(fecha_programada) - epoch(fecha_contrato)) / 86400) AS BIGINT) AS rezago_contrato_d
      FROM rico WHERE fecha_real IS NOT NULL),
    diario AS (SELECT id_puerto, CAST(fecha_programada AS DATE) AS dia, count(*) AS c FROM base GROUP BY 1, 2),
    previo AS (SELECT id_puerto, dia, coalesce(sum(c) OVER (PARTITION BY id_puerto ORDER BY dia RANGE BETWEEN INTERVAL 7 DAY PRECEDING
      AND INTERVAL 1 DAY PRECEDING), 0)::BIGINT AS congestion_puerto_7d FROM diario),
    rasgo AS (SELECT b.*, congestion_puerto_7d, coalesce(avg(CASE WHEN retraso_d <= 0 THEN 1.0::DOUBLE ELSE 0 END) OVER (PARTITION BY
      coalesce(tipo_dom, 'FALTA') ORDER BY fecha_programada, id_embarque ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.5) AS hist_punt_tipo,
      CASE WHEN retraso_d <= 0 THEN 0 WHEN retraso_d <= 5 THEN 1 ELSE 2 END AS y_sev
      FROM base b JOIN previo p ON p.id_puerto = b.id_puerto AND p.dia = CAST(b.fecha_programada AS DATE))"""


def enriched(spark, sf):
    return op.enrich(roles.shipments(spark, sf), roles.ports(spark, sf), roles.clients(spark, sf),
                     roles.dispatches(spark, sf), roles.carriers(spark, sf))


def features(spark, sf):
    return op.delay_features(enriched(spark, sf))


@query("shipment_enriched", sql_with(*VIEWS, then=f""", {ENRICH_SQL} SELECT id_embarque, puerto, tipo_puerto, rio_mar, incoterm, seg_cliente,
    pais_cliente, CAST(n_envios AS DOUBLE) AS n_envios, round(distancia_tot, 6) AS distancia_tot, round(flete_tot, 6) AS flete_tot, tipo_dom,
    round(horas_transito_med, 6) AS horas_transito_med FROM rico"""))
def shipment_enriched(spark, sf):
    return rounded(enriched(spark, sf).select("id_embarque", "puerto", "tipo_puerto", "rio_mar", "incoterm", "seg_cliente",
                                              "pais_cliente", F.col("n_envios").cast("double").alias("n_envios"), "distancia_tot", "flete_tot",
                                              "tipo_dom", "horas_transito_med"), 6)


@query("shipment_censoring", sql_with("embarque", then=""" SELECT count(*) AS n, count(*) FILTER (WHERE fecha_real IS NULL) AS censurados
    FROM embarque"""))
def shipment_censoring(spark, sf):
    return op.censoring(roles.shipments(spark, sf))


@query("shipment_features", sql_with(*VIEWS, then=f""", {DELAY_SQL} SELECT id_embarque, retraso_d, rezago_contrato_d, congestion_puerto_7d,
    round(hist_punt_tipo, 6) AS hist_punt_tipo, y_sev, coalesce(tipo_dom, 'FALTA') AS tipo_dom,
    CAST(month(fecha_programada) AS VARCHAR) AS mes FROM rasgo"""))
def shipment_features(spark, sf):
    return rounded(features(spark, sf).select("id_embarque", "retraso_d", "rezago_contrato_d", "congestion_puerto_7d",
                                              "hist_punt_tipo", "y_sev", "tipo_dom", "mes"), 6)


@query("port_congestion", sql_with("embarque", then="""SELECT a.id_embarque, a.id_puerto, (SELECT count(*) FROM embarque b
    WHERE b.id_puerto = a.id_puerto AND b.fecha_programada >= a.fecha_programada - INTERVAL 7 DAY AND b.fecha_programada < a.fecha_programada)
    AS congestion_puerto_7d FROM embarque a"""))
def port_congestion(spark, sf):
    return op.port_congestion(roles.shipments(spark, sf)).select("id_embarque", "id_puerto", "congestion_puerto_7d")


@query("on_time_history", sql_with("embarque", then="""SELECT id_embarque, estado_embarque, round(coalesce(avg(CASE WHEN fecha_real <=
    fecha_programada THEN 1.0::DOUBLE ELSE 0 END) OVER (PARTITION BY estado_embarque ORDER BY fecha_programada, id_embarque ROWS BETWEEN
    UNBOUNDED PRECEDING AND 1 PRECEDING), 0.5), 6) AS historial FROM embarque WHERE fecha_real IS NOT NULL"""))
def on_time_history(spark, sf):
    d = roles.shipments(spark, sf).filter("fecha_real is not null")
    d = d.withColumn("a_tiempo", F.when(F.col("fecha_real") <= F.col("fecha_programada"), 1.0).otherwise(0.0))
    d = op.on_time_history(d, "estado_embarque", ["fecha_programada", "id_embarque"], name="historial")
    return d.select("id_embarque", "estado_embarque", tidy("historial").alias("historial"))


@query("risk_panel", sql_with(*VIEWS, then=f""", {DELAY_SQL} SELECT puerto, coalesce(tipo_dom, 'FALTA') AS tipo_dom, count(*) AS n,
    round(avg(CASE WHEN y_sev = 2 THEN 1.0::DOUBLE ELSE 0 END), 2) AS p_grave,
    round(sum(CASE WHEN y_sev = 2 THEN 1.0::DOUBLE ELSE 0 END * 40000), 2) AS costo_esp FROM rasgo GROUP BY 1, 2
    ORDER BY 5 DESC, 1, 2 LIMIT 15"""))
def risk_panel(spark, sf):
    d = features(spark, sf).withColumn("p_grave", F.when(F.col("y_sev") == 2, 1.0).otherwise(0.0))
    return op.risk_panel(d)


@query("last_shipments", sql_with(*VIEWS, then=f""", {DELAY_SQL}, u AS (SELECT * FROM rasgo ORDER BY fecha_programada DESC, id_embarque DESC
    LIMIT 500) SELECT count(*) AS n, min(fecha_programada) AS desde, max(fecha_programada) AS hasta,
    round(avg(CASE WHEN y_sev = 2 THEN 1.0::DOUBLE ELSE 0 END), 6) AS graves FROM u"""))
def last_shipments(spark, sf):
    return op.last_context(features(spark, sf), ["fecha_programada", "id_embarque"])


@query("freight_rows", sql_with("envio", "transporte", then="""SELECT id_embarque, linea, id_parte, tipo, origen, destino, pais_bandera,
    CAST(month(fecha_salida) AS INTEGER) AS mes, date_diff('hour', fecha_salida, fecha_llegada) AS duracion_h, round(costo_flete_usd, 6) AS costo_flete_usd,
    round(distancia_km, 6) AS distancia_km FROM envio LEFT JOIN transporte USING (id_transporte)
    WHERE costo_flete_usd > 0 AND distancia_km > 0"""))
def freight_rows(spark, sf):
    d = op.freight_rows(roles.dispatches(spark, sf), roles.carriers(spark, sf))
    return d.select("id_embarque", "linea", "id_parte", "tipo", "origen", "destino", "pais_bandera", "mes", "duracion_h",
                    F.round("costo_flete_usd", 6).alias("costo_flete_usd"), F.round("distancia_km", 6).alias("distancia_km"))
