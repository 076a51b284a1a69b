"""The business tables, derived from the warehouse tables of the test data.

Each function returns the columns that the operators expect.  ``SQL`` holds the same derivations as
plain SQL views for the cross-check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veta.sources.io import load

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")

# Columns that put equal timestamps of receipts into a fixed order.
RECEIPT_ORDER = ("fecha_hora", "id_recepcion", "id_parte", "id_silo", "peso_neto", "valor_usd")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return load(spark, f"{sf}/{name}.parquet")


def receipts(spark: SparkSession, sf: str) -> DataFrame:
    """Weigh-ins: one per line item, with a delivery time inside its ship day."""
    li = table(spark, sf, "lineitem")
    hours = F.pmod(F.col("l_partkey"), F.lit(24)).cast("int")
    minutes = F.pmod(F.col("l_orderkey"), F.lit(60)).cast("int")
    moved = F.make_dt_interval(F.lit(0), hours, minutes)
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id_recepcion"),
        (F.col("l_shipdate") + moved).alias("fecha_hora"),
        F.col("l_suppkey").alias("id_silo"),
        F.when(F.col("l_linenumber") != 7, F.col("l_orderkey")).alias("id_contrato"),
        (F.col("l_quantity") + 12 + F.col("l_linenumber")).alias("peso_bruto_tn"),
        (F.lit(12.0) + F.col("l_linenumber")).alias("tara_tn"),
        F.col("l_quantity").alias("peso_neto"),
        (F.round(F.col("l_discount") * 100) + 10).alias("humedad_pct"),
        (F.round(F.col("l_tax") * 100) / 4).alias("impurezas_pct"),
        (F.lit(18.0) + F.pmod(F.col("l_partkey"), F.lit(8)) / 4).alias("aceite_pct"),
        (F.lit(34.0) + F.pmod(F.col("l_suppkey"), F.lit(12)) / 4).alias("proteina_pct"),
        (F.lit(20.0) + F.pmod(F.col("l_orderkey"), F.lit(15))).alias("temperatura_grano_c"),
        F.when(F.col("l_returnflag") == "A", "DESCUENTO").when(F.col("l_returnflag") == "N", "ESTANDAR")
        .otherwise("PREMIUM").alias("calidad_grano"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
        .alias("numero_remision"),
        F.col("l_partkey").alias("id_parte"),
        F.col("l_extendedprice").alias("valor_usd"),
        F.col("l_linestatus").alias("estado"),
    )


def contracts(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("id_contrato"), F.col("o_custkey").alias("id_productor"),
        (F.col("o_totalprice") / 1000).alias("precio_acordado_usd_tn"),
        F.floor(F.col("o_totalprice") / 4000).cast("double").alias("volumen_comprometido_tn"),
        F.col("o_orderdate").alias("fecha_contrato"), F.col("o_orderpriority").alias("incoterm"),
    )


def producers(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select(
        F.col("c_custkey").alias("id_productor"), F.col("c_name").alias("nombre_completo"),
        F.col("c_mktsegment").alias("tipo_productor"), F.col("c_nationkey").alias("municipio"),
        (F.col("c_acctbal") / 10).alias("area_total_ha"),
    )


def plots(spark: SparkSession, sf: str) -> DataFrame:
    """Plot areas; a producer without a positive balance has none."""
    c = table(spark, sf, "customer")
    return c.filter("c_acctbal > 0").select(F.col("c_custkey").alias("id_productor"),
                                            (F.col("c_acctbal") / 100).alias("superficie_ha"))


def lab_assignments(spark: SparkSession, sf: str) -> DataFrame:
    """Receipt to lot; every third receipt has none."""
    return (table(spark, sf, "lineitem").filter("l_linenumber % 3 <> 0")
            .select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id_recepcion"),
                    F.col("l_partkey").alias("id_lote")))


def lab_controls(spark: SparkSession, sf: str) -> DataFrame:
    """Lots that were analysed."""
    return table(spark, sf, "part").filter("p_size > 10").select(F.col("p_partkey").alias("id_lote"))


def silos(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    return s.select(
        F.col("s_suppkey").alias("id_silo"), (F.col("s_acctbal") / 10).alias("capacidad_tn"),
        F.when(F.pmod(F.col("s_suppkey"), F.lit(5)) != 0, F.pmod(F.col("s_suppkey"), F.lit(2)) == 0)
        .alias("temperatura_control"),
    )


def inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Stock records of the silos (only the even ones report)."""
    s = table(spark, sf, "supplier")
    return s.filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("id_silo"),
                                                (F.col("s_nationkey") * 40.0).alias("stock_tn"))


def sensor_readings(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select(
        F.col("user_id").alias("sensor_id"), F.col("ts"), F.col("value").alias("temperatura_c"),
        k.alias("humedad_relativa_pct"), (F.col("value") / 10).alias("precipitacion_mm"),
        (F.lit(-50.0) - F.pmod(F.col("event_id"), F.lit(40))).alias("calidad_senal_dbm"),
        F.col("event_id").alias("id_lectura"),
    )


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("event_type").alias("ticker"), F.col("ts"), F.col("value").alias("precio_cotizacion"),
                    F.get_json_object("props", "$.k").cast("double").alias("volumen_tick"),
                    F.col("event_id").alias("id_tick"))


def shipments(spark: SparkSession, sf: str) -> DataFrame:
    """Shipments: one per order, due 30 days after it; the actual date is the first item that left."""
    o = table(spark, sf, "orders")
    first = (table(spark, sf, "lineitem").groupBy("l_orderkey")
             .agg(F.min("l_shipdate").alias("fecha_real"), F.sum("l_quantity").alias("cantidad_tn")))
    return o.join(first, o.o_orderkey == first.l_orderkey, "left").select(
        F.col("o_orderkey").alias("id_embarque"), F.col("o_custkey").alias("id_cliente"),
        F.pmod(F.col("o_custkey"), F.lit(25)).cast("int").alias("id_puerto"),
        F.expr("o_orderdate + INTERVAL 30 DAY").alias("fecha_programada"), F.col("fecha_real"),
        F.coalesce("cantidad_tn", F.lit(0.0)).alias("cantidad_tn"), (F.col("o_totalprice") / 1000).alias("venta_tn"),
        F.col("o_orderdate").alias("fecha_contrato"), F.col("o_orderpriority").alias("incoterm"),
        F.col("o_orderstatus").alias("estado_embarque"),
    )


def dispatches(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    leave = F.col("l_shipdate") + F.make_dt_interval(F.lit(0), F.pmod(F.col("l_partkey"), F.lit(24)).cast("int"),
                                                     F.lit(59))
    travel = F.make_dt_interval(F.lit(0), (F.pmod(F.col("l_suppkey"), F.lit(30)) + 1).cast("int"), F.lit(2))
    return li.select(
        F.col("l_orderkey").alias("id_embarque"), F.col("l_suppkey").alias("id_transporte"),
        (F.col("l_extendedprice") / 100).alias("distancia_km"),
        (F.col("l_quantity") * 12 + F.col("l_extendedprice") / 250).alias("costo_flete_usd"),
        leave.alias("fecha_salida"), (leave + travel).alias("fecha_llegada"),
        F.col("l_returnflag").alias("origen"), F.col("l_linestatus").alias("destino"),
        F.col("l_partkey").alias("id_parte"), F.col("l_linenumber").alias("linea"),
    )


def carriers(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("BARCAZA", "CAMION", "TREN", "BUQUE")]),
                        (F.pmod(F.col("s_nationkey"), F.lit(4)) + 1).cast("int"))
    return s.select(F.col("s_suppkey").alias("id_transporte"), kind.alias("tipo"),
                    (F.lit(30.0) + F.pmod(F.col("s_suppkey"), F.lit(50))).alias("capacidad_tn"),
                    F.col("s_nationkey").alias("pais_bandera"))


def ports(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    return n.select(F.col("n_nationkey").alias("id_puerto"), F.col("n_name").alias("puerto"),
                    F.concat(F.lit("TIPO"), F.pmod(F.col("n_nationkey"), F.lit(3)).cast("string")).alias("tipo_puerto"),
                    F.when(F.pmod(F.col("n_regionkey"), F.lit(2)) == 0, "RIO").otherwise("MAR").alias("rio_mar"))


def clients(spark: SparkSession, sf: str) -> DataFrame:
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").select(
        F.col("c_custkey").alias("id_cliente"), F.col("c_mktsegment").alias("segmento"), F.col("n_name").alias("pais"))


# The price series of the monthly panel and the part type each is read from.
PANEL_SERIES = {"soya_grano": "STANDARD", "soya_aceite": "PROMO", "soya_harina": "LARGE", "maiz": "MEDIUM",
                "petroleo": "SMALL", "urea": "ECONOMY"}
ENSO = "nino34_anomalia_c"


def monthly_prices(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly unit prices by series, one panel per customer segment.

    The narrow orders meet their customers first, so that the items move for two joins and not for three.
    """
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice",
                                             "l_discount", F.trunc("l_shipdate", "MM").alias("mes"))
    p = table(spark, sf, "part").select("p_partkey", "p_type")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    o = o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_mktsegment")
    rows = li.join(p, li.l_partkey == p.p_partkey).join(o, li.l_orderkey == o.o_orderkey)
    price = {name: (F.sum(F.when(F.col("p_type") == kind, F.col("l_extendedprice")))
                    / F.sum(F.when(F.col("p_type") == kind, F.col("l_quantity")))).alias(name)
             for name, kind in PANEL_SERIES.items()}
    enso = ((F.avg("l_discount") - 0.05) * 80).alias(ENSO)
    return rows.groupBy(F.col("c_mktsegment").alias("serie"), "mes").agg(*price.values(), enso)


# ------------------------------------------------------------------ the same as SQL views
SQL = {
    "recepcion": """SELECT l_orderkey * 10 + l_linenumber AS id_recepcion,
        l_shipdate + to_hours(CAST(l_partkey % 24 AS INTEGER)) + to_minutes(CAST(l_orderkey % 60 AS INTEGER)) AS fecha_hora,
        l_suppkey AS id_silo, CASE WHEN l_linenumber <> 7 THEN l_orderkey END AS id_contrato,
        l_quantity + 12 + l_linenumber AS peso_bruto_tn, 12.0::DOUBLE + l_linenumber AS tara_tn, l_quantity AS peso_neto,
        round(l_discount * 100) + 10 AS humedad_pct, round(l_tax * 100) / 4 AS impurezas_pct,
        18.0::DOUBLE + (l_partkey % 8) / 4 AS aceite_pct, 34.0::DOUBLE + (l_suppkey % 12) / 4 AS proteina_pct,
        20.0::DOUBLE + l_orderkey % 15 AS temperatura_grano_c,
        CASE l_returnflag WHEN 'A' THEN 'DESCUENTO' WHEN 'N' THEN 'ESTANDAR' ELSE 'PREMIUM' END AS calidad_grano,
        l_orderkey || '-' || l_linenumber AS numero_remision, l_partkey AS id_parte, l_extendedprice AS valor_usd,
        l_linestatus AS estado FROM lineitem""",
    "contrato": """SELECT o_orderkey AS id_contrato, o_custkey AS id_productor, o_totalprice / 1000 AS precio_acordado_usd_tn,
        floor(o_totalprice / 4000) AS volumen_comprometido_tn, o_orderdate AS fecha_contrato, o_orderpriority AS incoterm
        FROM orders""",
    "productor": """SELECT c_custkey AS id_productor, c_name AS nombre_completo, c_mktsegment AS tipo_productor,
        c_nationkey AS municipio, c_acctbal / 10 AS area_total_ha FROM customer""",
    "predio": "SELECT c_custkey AS id_productor, c_acctbal / 100 AS superficie_ha FROM customer WHERE c_acctbal > 0",
    "asignacion": """SELECT l_orderkey * 10 + l_linenumber AS id_recepcion, l_partkey AS id_lote FROM lineitem
        WHERE l_linenumber % 3 <> 0""",
    "control": "SELECT p_partkey AS id_lote FROM part WHERE p_size > 10",
    "silo": """SELECT s_suppkey AS id_silo, s_acctbal / 10 AS capacidad_tn,
        CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey % 2 = 0 END AS temperatura_control FROM supplier""",
    "inventario": "SELECT s_suppkey AS id_silo, s_nationkey * 40.0::DOUBLE AS stock_tn FROM supplier WHERE s_suppkey % 2 = 0",
    "lectura": """SELECT user_id AS sensor_id, ts, value AS temperatura_c,
        CAST(json_extract_string(props, '$.k') AS DOUBLE) AS humedad_relativa_pct, value / 10 AS precipitacion_mm,
        -50.0::DOUBLE - event_id % 40 AS calidad_senal_dbm, event_id AS id_lectura FROM events""",
    "tick": """SELECT event_type AS ticker, ts, value AS precio_cotizacion,
        CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volumen_tick, event_id AS id_tick FROM events""",
    "embarque": """SELECT o_orderkey AS id_embarque, o_custkey AS id_cliente, CAST(o_custkey % 25 AS INTEGER) AS id_puerto,
        o_orderdate + INTERVAL 30 DAY AS fecha_programada, f.fecha_real, coalesce(f.cantidad_tn, 0) AS cantidad_tn,
        o_totalprice / 1000 AS venta_tn, o_orderdate AS fecha_contrato, o_orderpriority AS incoterm,
        o_orderstatus AS estado_embarque
        FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS fecha_real, sum(l_quantity) AS cantidad_tn
                               FROM lineitem GROUP BY 1) f ON f.l_orderkey = o_orderkey""",
    "envio": """SELECT l_orderkey AS id_embarque, l_suppkey AS id_transporte, l_extendedprice / 100 AS distancia_km,
        l_quantity * 12 + l_extendedprice / 250 AS costo_flete_usd,
        l_shipdate + to_hours(CAST(l_partkey % 24 AS INTEGER)) + to_minutes(59) AS fecha_salida,
        l_shipdate + to_hours(CAST(l_partkey % 24 AS INTEGER)) + to_minutes(59)
          + to_hours(CAST(l_suppkey % 30 + 1 AS INTEGER)) + to_minutes(2) AS fecha_llegada,
        l_returnflag AS origen, l_linestatus AS destino, l_partkey AS id_parte, l_linenumber AS linea FROM lineitem""",
    "transporte": """SELECT s_suppkey AS id_transporte,
        CASE s_nationkey % 4 WHEN 0 THEN 'BARCAZA' WHEN 1 THEN 'CAMION' WHEN 2 THEN 'TREN' ELSE 'BUQUE' END AS tipo,
        30.0::DOUBLE + s_suppkey % 50 AS capacidad_tn, s_nationkey AS pais_bandera FROM supplier""",
    "puerto": """SELECT n_nationkey AS id_puerto, n_name AS puerto, 'TIPO' || (n_nationkey % 3) AS tipo_puerto,
        CASE WHEN n_regionkey % 2 = 0 THEN 'RIO' ELSE 'MAR' END AS rio_mar FROM nation""",
    "cliente": """SELECT c_custkey AS id_cliente, c_mktsegment AS segmento, n_name AS pais
        FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""",
    "precio_mensual": "SELECT c_mktsegment AS serie, CAST(date_trunc('month', l_shipdate) AS DATE) AS mes, " + ", ".join(
        f"sum(CASE WHEN p_type = '{k}' THEN l_extendedprice END) / sum(CASE WHEN p_type = '{k}' THEN l_quantity END) AS {n}"
        for n, k in PANEL_SERIES.items()) + f""", (avg(l_discount) - 0.05) * 80 AS {ENSO}
        FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey
        JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2""",
}


def sql_with(*views: str, then: str) -> str:
    """SQL text with the named views in front."""
    return "WITH " + ",\n".join(f"{v} AS ({SQL[v]})" for v in views) + "\n" + then
