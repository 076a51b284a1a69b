"""Sensor and tick fronts."""

from __future__ import annotations

from pyspark.sql import functions as F

from veta.functions.columns import tidy
from veta.operators import sensors as op
from veta.plans.profiles import rounded, sql_rounded
from veta.plans.registry import query
from veta.sources import roles
from veta.sources.roles import sql_with

SIX = "OVER (PARTITION BY sensor_id ORDER BY ts, id_lectura ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)"
ONE = "OVER (PARTITION BY sensor_id ORDER BY ts, id_lectura)"
FEATURES_SQL = f"""rasgo AS (SELECT *, hour(ts) AS hora_dia, month(ts) AS mes, sin(hour(ts) * 2 * pi() / 24) AS hora_sin,
    cos(hour(ts) * 2 * pi() / 24) AS hora_cos, temperatura_c + 0.05 * humedad_relativa_pct * (temperatura_c / 30) AS humidex,
    lag(humedad_relativa_pct, 1) {ONE} AS hum_lag_1,
    CASE WHEN count(temperatura_c) {SIX} >= 3 THEN avg(temperatura_c) {SIX} END AS temp_media_6h,
    CASE WHEN count(temperatura_c) {SIX} >= 3 THEN stddev_samp(temperatura_c) {SIX} END AS temp_std_6h,
    CASE WHEN count(temperatura_c) {SIX} >= 3 THEN max(temperatura_c) {SIX} END AS temp_max_6h,
    CASE WHEN count(humedad_relativa_pct) {SIX} >= 3 THEN avg(humedad_relativa_pct) {SIX} END AS hum_media_6h,
    coalesce(temperatura_c - lag(temperatura_c, 3) {ONE}, 0) AS delta_3h,
    CASE WHEN lead(temperatura_c, 1) {ONE} > 30 THEN 1 WHEN lead(temperatura_c, 1) {ONE} IS NOT NULL THEN 0 END AS riesgo
    FROM lectura)"""
ROUNDED = "hora_sin hora_cos hum_lag_1 temp_media_6h temp_std_6h temp_max_6h hum_media_6h delta_3h humidex"


def features(spark, sf, lead=1):
    return op.sensor_features(roles.sensor_readings(spark, sf), ["id_lectura"], lead)


@query("sensor_features", sql_with("lectura", then=f""", {FEATURES_SQL} SELECT id_lectura, sensor_id,
    CAST(hora_dia AS INTEGER) AS hora_dia, CAST(mes AS INTEGER) AS mes, {sql_rounded(ROUNDED, 5)}, CAST(riesgo AS DOUBLE) AS riesgo FROM rasgo"""))
def sensor_features(spark, sf):
    d = features(spark, sf)
    return rounded(d.select("id_lectura", "sensor_id", "hora_dia", "mes", *ROUNDED.split(), F.col("riesgo").cast("double").alias("riesgo")), 5)


@query("sensor_risk_label", sql_with("lectura", then=f""", {FEATURES_SQL} SELECT sensor_id, count(*) AS n,
    CAST(sum(riesgo) AS BIGINT) AS graves, round(avg(riesgo), 6) AS tasa FROM rasgo WHERE riesgo IS NOT NULL
    AND temp_std_6h IS NOT NULL AND hum_lag_1 IS NOT NULL GROUP BY 1"""))
def sensor_risk_label(spark, sf):
    """Rows that can be learned from, and the share at risk, per sensor."""
    d = op.labelled(features(spark, sf))
    return d.groupBy("sensor_id").agg(F.count(F.lit(1)).alias("n"), F.sum("riesgo").alias("graves"),
                                      tidy(F.avg("riesgo")).alias("tasa"))


@query("sensor_features_by_time", sql_with("lectura", then=""", h AS (SELECT id_lectura, sensor_id,
    count(temperatura_c) OVER v AS n_previas, avg(temperatura_c) OVER v AS m, stddev_samp(temperatura_c) OVER v AS s,
    max(temperatura_c) OVER v AS x FROM lectura
    WINDOW v AS (PARTITION BY sensor_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING))
    SELECT id_lectura, sensor_id, n_previas, round(CASE WHEN n_previas >= 3 THEN m END, 5) AS temp_media_h,
    round(CASE WHEN n_previas >= 3 THEN s END, 5) AS temp_std_h, round(CASE WHEN n_previas >= 3 THEN x END, 5) AS temp_max_h FROM h"""))
def sensor_features_by_time(spark, sf):
    d = op.timed_features(roles.sensor_readings(spark, sf), 6)
    return rounded(d.select("id_lectura", "sensor_id", "n_previas", "temp_media_h", "temp_std_h", "temp_max_h"), 5)


@query("sensor_regime_mode", sql_with("lectura", then=""", c AS (SELECT sensor_id, id_lectura % 3 AS regimen, count(*) AS n
    FROM lectura GROUP BY ALL) SELECT sensor_id, CAST(regimen AS BIGINT) AS regimen FROM (SELECT *, row_number() OVER
    (PARTITION BY sensor_id ORDER BY n DESC, regimen) AS k FROM c) WHERE k = 1"""))
def sensor_regime_mode(spark, sf):
    """Dominant regime per sensor, for fixed regimes."""
    d = roles.sensor_readings(spark, sf).withColumn("regimen", F.pmod("id_lectura", F.lit(3)))
    return op.dominant_regime(d)


@query("hot_sensors", sql_with("lectura", then=""", r AS (SELECT *, id_lectura % 3 AS regimen FROM lectura),
    c AS (SELECT regimen FROM r GROUP BY 1 ORDER BY avg(temperatura_c) DESC LIMIT 1)
    SELECT sensor_id, count(*) AS n FROM r JOIN c USING (regimen) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"""))
def hot_sensors(spark, sf):
    d = roles.sensor_readings(spark, sf).withColumn("regimen", F.pmod("id_lectura", F.lit(3)))
    return op.busiest_in_hottest(d)


RET_SQL = """cambio AS (SELECT *, precio_cotizacion / nullif(lag(precio_cotizacion) OVER (PARTITION BY ticker ORDER BY ts, id_tick), 0)
    - 1 AS ret FROM tick)"""
BAR_SQL = """barra AS (SELECT ticker, date_trunc('hour', ts) AS hora, stddev_samp(ret) AS volatilidad, sum(volumen_tick) AS volumen,
    max(precio_cotizacion) - min(precio_cotizacion) AS rango, count(precio_cotizacion) AS n_ticks FROM cambio GROUP BY 1, 2
    HAVING stddev_samp(ret) IS NOT NULL AND sum(volumen_tick) IS NOT NULL)"""


def bars(spark, sf):
    return op.hourly_bars(op.tick_returns(roles.ticks(spark, sf), ["id_tick"]))


@query("tick_returns", sql_with("tick", then=f", {RET_SQL} SELECT id_tick, ticker, round(ret, 6) + 0.0::DOUBLE AS ret FROM cambio"))
def tick_returns(spark, sf):
    return rounded(op.tick_returns(roles.ticks(spark, sf), ["id_tick"]).select("id_tick", "ticker", "ret"), 6)


@query("hourly_bars", sql_with("tick", then=f""", {RET_SQL}, {BAR_SQL} SELECT ticker, hora, n_ticks,
    {sql_rounded("volatilidad volumen rango", 5)} FROM barra"""))
def hourly_bars(spark, sf):
    return rounded(bars(spark, sf), 5)


@query("bar_regime_profile", sql_with("tick", then=f""", {RET_SQL}, {BAR_SQL}, r AS (SELECT *, CASE WHEN n_ticks > 3 THEN 1 ELSE 0 END AS regimen
    FROM barra) SELECT regimen, count(*) AS n, {', '.join(f'round(avg({c}), 4) AS {c}' for c in ('volatilidad', 'volumen', 'rango', 'n_ticks'))}
    FROM r GROUP BY 1"""))
def bar_regime_profile(spark, sf):
    """Mean of the bar columns per regime, for fixed regimes."""
    from veta.operators.summary import label_profile

    d = bars(spark, sf).withColumn("regimen", F.when(F.col("n_ticks") > 3, 1).otherwise(0))
    return rounded(label_profile(d, "regimen", ["volatilidad", "volumen", "rango", "n_ticks"]))
