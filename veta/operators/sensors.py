"""Sensor features and labels, operating regimes, tick returns and hourly bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from veta.functions.columns import cyclic, epoch, humidex
from veta.operators.sequence import framed

RISK_FEATURES = ("humedad_relativa_pct", "precipitacion_mm", "calidad_senal_dbm", "hora_dia", "hora_sin", "hora_cos",
                 "mes", "hum_lag_1", "temp_media_6h", "temp_std_6h", "temp_max_6h", "hum_media_6h", "delta_3h", "humidex")
RISK_TEMPERATURE = 30.0


def trailing(w: WindowSpec, column: str, fn, n: int, least: int, shift: int = 0):
    """``fn`` over the last n rows (ending ``shift`` rows back), null below ``least`` values."""
    frame = w.rowsBetween(-(n - 1) - shift, -shift)
    return F.when(F.count(column).over(frame) >= least, fn(column).over(frame))


def sensor_features(readings: DataFrame, ties: Sequence[str] = (), lead: int = 1) -> DataFrame:
    """Features of a reading from the sensor's past, and the risk label ``lead`` readings ahead.

    The last readings of a sensor have no label.  Windows never leave the sensor.
    """
    sin, cos = cyclic(F.hour("ts"), 24)
    d = readings.withColumns({"hora_dia": F.hour("ts"), "mes": F.month("ts"), "hora_sin": sin, "hora_cos": cos,
                              "humidex": humidex("temperatura_c", "humedad_relativa_pct")})

    def past(w: WindowSpec) -> dict:
        ahead = F.lead("temperatura_c", lead).over(w) if lead else F.col("temperatura_c")
        return {
            "hum_lag_1": F.lag("humedad_relativa_pct", 1).over(w),
            "temp_media_6h": trailing(w, "temperatura_c", F.avg, 6, 3, 1),
            "temp_std_6h": trailing(w, "temperatura_c", F.stddev_samp, 6, 3, 1),
            "temp_max_6h": trailing(w, "temperatura_c", F.max, 6, 3, 1),
            "hum_media_6h": trailing(w, "humedad_relativa_pct", F.avg, 6, 3, 1),
            "delta_3h": F.coalesce(F.col("temperatura_c") - F.lag("temperatura_c", 3).over(w), F.lit(0.0)),
            "riesgo": F.when(ahead > RISK_TEMPERATURE, 1).when(ahead.isNotNull(), 0),
        }

    return framed(d, ["sensor_id"], ["ts", *ties], [past], before=6, after=max(lead, 0))


def timed_features(readings: DataFrame, hours: int = 6) -> DataFrame:
    """The rolling features over true hours instead of a number of readings.

    Rows are cut into time blocks as long as the frame; each block also gets the rows of the block before.
    """
    span = hours * 3600
    at = epoch("ts")
    block = F.floor(at / span)
    spread = (readings.withColumn("_at", (at * 1000000).cast("long"))
              .withColumn("_copy", F.explode(F.array(F.struct(block.alias("b"), F.lit(True).alias("own")),
                                                     F.struct((block + 1).alias("b"), F.lit(False).alias("own")))))
              .withColumns({"_block": F.col("_copy.b"), "_own": F.col("_copy.own")}))
    w = Window.partitionBy("sensor_id", "_block").orderBy("_at").rangeBetween(-span * 1000000, -1)
    enough = F.count("temperatura_c").over(w) >= 3
    return (spread.withColumns({
        "n_previas": F.count("temperatura_c").over(w),
        "temp_media_h": F.when(enough, F.avg("temperatura_c").over(w)),
        "temp_std_h": F.when(enough, F.stddev_samp("temperatura_c").over(w)),
        "temp_max_h": F.when(enough, F.max("temperatura_c").over(w)),
    }).filter("_own").drop("_at", "_copy", "_block", "_own"))


def labelled(features: DataFrame) -> DataFrame:
    return features.dropna(subset=[*RISK_FEATURES, "riesgo"])


def dominant_regime(df: DataFrame, key: str = "sensor_id", label: str = "regimen") -> DataFrame:
    """Most frequent label per key, the smallest on ties."""
    return df.groupBy(key).agg(F.mode(label, True).alias(label))


def busiest_in_hottest(df: DataFrame, key: str = "sensor_id", label: str = "regimen", heat: str = "temperatura_c",
                       top: int = 5) -> DataFrame:
    """Keys with most readings in the label of the highest mean."""
    means = df.groupBy(label).agg(F.avg(heat).alias("_m"), F.count(F.lit(1)).alias("_k"))
    hottest = means.orderBy(F.desc("_m"), label).first()[label]
    return (df.filter(F.col(label) == F.lit(hottest)).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), key).limit(top))


def tick_returns(ticks: DataFrame, ties: Sequence[str] = ()) -> DataFrame:
    """Relative price change from the ticker's previous tick."""
    def change(w: WindowSpec) -> dict:
        last = F.lag("precio_cotizacion", 1).over(w)
        return {"ret": F.col("precio_cotizacion") / F.nullif(last, F.lit(0.0)) - 1}

    return framed(ticks, ["ticker"], ["ts", *ties], [change], before=1)


def hourly_bars(returns: DataFrame) -> DataFrame:
    """Volatility, volume, range and ticks per ticker and hour; hours without a volatility are dropped."""
    return (returns.groupBy("ticker", F.date_trunc("hour", "ts").alias("hora"))
            .agg(F.stddev_samp("ret").alias("volatilidad"), F.sum("volumen_tick").alias("volumen"),
                 (F.max("precio_cotizacion") - F.min("precio_cotizacion")).alias("rango"),
                 F.count("precio_cotizacion").alias("n_ticks"))
            .dropna())
