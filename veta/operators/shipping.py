"""Shipments: enrichment, delay features, congestion, punctuality history, freight, risk panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veta.functions.columns import boundary_hours, floor_days, severity_of_delay
from veta.operators.prep import fill_category
from veta.operators.sequence import ROWS_PER_TASK, attach, running_by_day
from veta.session import materialise

NUMBERS = ("cantidad_tn", "venta_tn", "distancia_tot", "flete_tot", "n_envios", "rezago_contrato_d",
           "congestion_puerto_7d", "hist_punt_tipo")
CATEGORIES = ("puerto", "tipo_puerto", "rio_mar", "incoterm", "seg_cliente", "pais_cliente", "tipo_dom", "mes")
# Demurrage per day in USD and the mean days of a severe delay.
DEMURRAGE_USD, SEVERE_DAYS = 5000.0, 8.0


def dispatch_summary(dispatches: DataFrame, carriers: DataFrame) -> DataFrame:
    """Dispatches per shipment: count, distance, freight, the carrier type of the longest one, mean hours."""
    d = dispatches.join(carriers.select("id_transporte", "tipo"), "id_transporte", "left")
    return d.groupBy("id_embarque").agg(
        F.count(F.lit(1)).alias("n_envios"), F.sum("distancia_km").alias("distancia_tot"),
        F.sum("costo_flete_usd").alias("flete_tot"), F.max_by("tipo", F.struct("distancia_km", "id_transporte")).alias("tipo_dom"),
        F.avg(boundary_hours("fecha_salida", "fecha_llegada")).alias("horas_transito_med"))


def enrich(shipments: DataFrame, ports: DataFrame, clients: DataFrame, dispatches: DataFrame,
           carriers: DataFrame) -> DataFrame:
    """Shipments with port, client and the summary of their dispatches."""
    c = clients.withColumnsRenamed({"segmento": "seg_cliente", "pais": "pais_cliente"})
    # Dispatches first: shipments lie by their id already.
    rich = (shipments.join(dispatch_summary(dispatches, carriers), "id_embarque", "left").join(ports, "id_puerto", "left")
            .join(c, "id_cliente", "left"))
    # In the order of the columns that joins by port, client and dispatches would give.
    first = ["id_embarque", "id_cliente", "id_puerto"]
    return rich.select(*first, *[x for d in (shipments, ports, c) for x in d.columns if x not in first],
                       "n_envios", "distancia_tot", "flete_tot", "tipo_dom", "horas_transito_med")


def censoring(shipments: DataFrame) -> DataFrame:
    """How many shipments have no actual date yet."""
    return shipments.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("fecha_real").isNull()).alias("censurados"))


def port_congestion(df: DataFrame, days: int = 7, port: str = "id_puerto", when: str = "fecha_programada") -> DataFrame:
    """Shipments of the same port due in the days before (the day itself not counted).

    Counted per port and day first: the window then holds one row per calendar day.
    """
    day = F.datediff(F.col(when), F.lit("1970-01-01").cast("date"))
    daily = df.filter(F.col(port).isNotNull()).groupBy(port, day.alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(port).orderBy("_day").rangeBetween(-days, -1)
    counts = materialise(daily.select(port, "_day", F.coalesce(F.sum("_n").over(w), F.lit(0).cast("long")).alias(f"congestion_puerto_{days}d")))
    # A row per port and calendar day: sent to the shipments, unless there are very many ports.
    counts = F.broadcast(counts) if counts.count() <= ROWS_PER_TASK else counts
    return attach(df.withColumn("_day", day), counts, [port, "_day"]).drop("_day")


def on_time_history(df: DataFrame, key: str, order: Sequence[str], flag: str = "a_tiempo", name: str = "hist_punt_tipo",
                    default: float = 0.5) -> DataFrame:
    """Share of earlier rows of the key that were on time; the default for the first row."""
    past = running_by_day(df, [key], order, {"_yes": F.col(flag), "_all": F.lit(1.0)}, include_current=False)
    return past.withColumn(name, F.coalesce(F.col("_yes") / F.col("_all"), F.lit(default))).drop("_yes", "_all")


def delay_features(enriched: DataFrame) -> DataFrame:
    """Delay, severity and the features known before departure, for shipments that have arrived."""
    d = enriched.filter(F.col("fecha_real").isNotNull())
    d = d.withColumns({
        "retraso_d": floor_days("fecha_programada", "fecha_real"),
        "rezago_contrato_d": floor_days("fecha_contrato", "fecha_programada"),
        "mes": F.month("fecha_programada").cast("string"),
    })
    d = d.withColumns({"a_tiempo": F.when(F.col("retraso_d") <= 0, 1.0).otherwise(0.0),
                       "y_sev": severity_of_delay("retraso_d")})
    d = fill_category(port_congestion(d), CATEGORIES)
    return on_time_history(d, "tipo_dom", ["fecha_programada", "id_embarque"])


def risk_panel(predicted: DataFrame, p: str = "p_grave", top: int = 15) -> DataFrame:
    """Expected demurrage by route and carrier type."""
    cost = F.col(p) * DEMURRAGE_USD * SEVERE_DAYS
    return (predicted.groupBy("puerto", "tipo_dom")
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(p), 2).alias("p_grave"), F.round(F.sum(cost), 2).alias("costo_esp"))
            .orderBy(F.desc("costo_esp"), "puerto", "tipo_dom").limit(top))


def last_context(df: DataFrame, order: Sequence[str], n: int = 500) -> DataFrame:
    """Summary of the last n shipments by due date."""
    tail = df.orderBy(*[F.desc(o) for o in order]).limit(n)
    return tail.agg(F.count(F.lit(1)).alias("n"), F.min("fecha_programada").alias("desde"),
                    F.max("fecha_programada").alias("hasta"),
                    F.round(F.avg(F.when(F.col("y_sev") == 2, 1.0).otherwise(0.0)), 6).alias("graves"))


def freight_rows(dispatches: DataFrame, carriers: DataFrame) -> DataFrame:
    """Dispatches with a positive cost and distance, with their carrier and duration."""
    return (dispatches.filter((F.col("costo_flete_usd") > 0) & (F.col("distancia_km") > 0))
            .join(carriers, "id_transporte", "left")
            .withColumns({"duracion_h": boundary_hours("fecha_salida", "fecha_llegada"), "mes": F.month("fecha_salida")}))
