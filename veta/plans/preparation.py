"""Row preparation, splits and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from veta.functions import columns as fn
from veta.functions.columns import tidy
from veta.operators import prep as op
from veta.operators import splits
from veta.operators.sequence import medians
from veta.plans.profiles import FACT_SQL, PROFILE_SQL, profile, rounded, sql_rounded
from veta.plans.registry import query
from veta.sources import roles
from veta.sources.io import coerce, lower_names, sample_percent, upper_names
from veta.sources.roles import sql_with

PROFILE_VIEWS = ("recepcion", "contrato", "productor")
SCALED = ["n_recepciones", "volumen_total_tn", "humedad_std", "pct_hum_crit", "merma_total_tn"]


@query("derived_weights", sql_with("recepcion", then="""SELECT id_recepcion, id_parte, peso_bruto_tn - tara_tn AS neto,
    round(tara_tn / nullif(peso_bruto_tn, 0), 6) AS tara_ratio, hour(fecha_hora) + minute(fecha_hora) / 60.0::DOUBLE AS hora_dec
    FROM recepcion WHERE peso_bruto_tn - tara_tn BETWEEN 1 AND 200"""))
def derived_weights(spark, sf):
    d = roles.receipts(spark, sf).filter(fn.net_weight().between(1, 200))
    return d.select("id_recepcion", "id_parte", fn.net_weight().alias("neto"), tidy(fn.tare_ratio()).alias("tara_ratio"),
                    fn.decimal_hour("fecha_hora").alias("hora_dec"))


@query("sanity_caps", """SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 200000 AND o_orderkey <> 525
    AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2000-01-01'""")
def sanity_caps(spark, sf):
    """Quarantine: caps, a known bad record and a date window (both ends included)."""
    o = roles.table(spark, sf, "orders").filter((F.col("o_totalprice") < 200000) & F.col("o_orderdate").between(
        F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("2000-01-01").cast("timestamp_ntz")))
    return op.quarantine(o, "o_orderkey", [525], ["o_totalprice"]).select("o_orderkey", "o_totalprice")


@query("log_features", sql_with(*PROFILE_VIEWS, then=f""", {FACT_SQL}, {PROFILE_SQL} SELECT id_productor,
    {', '.join(f"round(ln(1 + greatest({c}, 0)), 6) AS {c}" for c in SCALED if c != 'humedad_std')} FROM perfil"""))
def log_features(spark, sf):
    p = profile(spark, sf)
    return p.select("id_productor", *[tidy(fn.log_skew(c)).alias(c) for c in SCALED if c != "humedad_std"])


@query("standardised", sql_with(*PROFILE_VIEWS, then=f""", {FACT_SQL}, {PROFILE_SQL}, u AS (SELECT * FROM perfil WHERE humedad_std IS NOT NULL
    AND id_productor <> 525), m AS (SELECT {', '.join(f"avg(ln(1 + {c})) AS m_{c}, stddev_pop(ln(1 + {c})) AS s_{c}" for c in SCALED)} FROM u)
    SELECT id_productor, {', '.join(f"round((ln(1 + {c}) - m_{c}) / s_{c}, 5) + 0.0::DOUBLE AS {c}" for c in SCALED)} FROM u CROSS JOIN m"""))
def standardised(spark, sf):
    d = op.quarantine(profile(spark, sf), "id_productor", [525], SCALED)
    d = d.select("id_productor", *[fn.log_skew(c).alias(c) for c in SCALED])
    return rounded(op.standardise(d, SCALED), 5)


@query("median_imputed", sql_with("embarque", then=""", m AS (SELECT median(CASE WHEN cantidad_tn > 0 THEN cantidad_tn END) AS md FROM embarque)
    SELECT id_embarque, CASE WHEN cantidad_tn > 0 THEN cantidad_tn ELSE md END AS cantidad_tn FROM embarque CROSS JOIN m"""))
def median_imputed(spark, sf):
    d = roles.shipments(spark, sf).select("id_embarque", F.when(F.col("cantidad_tn") > 0, F.col("cantidad_tn")).alias("cantidad_tn"))
    return op.median_fill(d, ["cantidad_tn"])


@query("grouped_medians", """SELECT l_returnflag, l_linestatus, round(median(l_extendedprice), 6) AS precio, median(l_quantity) AS cantidad
    FROM lineitem GROUP BY ALL""")
def grouped_medians(spark, sf):
    d = roles.table(spark, sf, "lineitem")
    m = medians(d, ["l_extendedprice", "l_quantity"], ["l_returnflag", "l_linestatus"])
    return m.select("l_returnflag", "l_linestatus", tidy("med_l_extendedprice").alias("precio"), F.col("med_l_quantity").alias("cantidad"))


@query("null_rate_columns", sql_with("embarque", "envio", "transporte", then=""", r AS (SELECT e.id_embarque, e.fecha_real, s.n FROM embarque e LEFT JOIN
    (SELECT id_embarque, count(*) AS n FROM envio WHERE costo_flete_usd > 600 GROUP BY 1) s USING (id_embarque))
    SELECT variable, round(nulos, 6) AS nulos, nulos >= 0.25 AS fuera FROM (SELECT 'fecha_real' AS variable, avg(CASE WHEN fecha_real IS NULL THEN 1.0
      ELSE 0 END) AS nulos FROM r UNION ALL SELECT 'n', avg(CASE WHEN n IS NULL THEN 1.0 ELSE 0 END) FROM r)"""))
def null_rate_columns(spark, sf):
    """Null rate per column and whether the column is dropped for it."""
    from veta.operators.summary import null_counts

    few = (roles.dispatches(spark, sf).filter("costo_flete_usd > 600").groupBy("id_embarque").agg(F.count(F.lit(1)).alias("n")))
    d = roles.shipments(spark, sf).join(few, "id_embarque", "left")
    return null_counts(d, ["fecha_real", "n"]).select("variable", tidy("proporcion").alias("nulos"), (F.col("proporcion") >= 0.25).alias("fuera"))


@query("fixed_bins", sql_with("recepcion", then="""SELECT hum, imp, count(*) AS n FROM (SELECT
    CASE WHEN humedad_pct > -1 AND humedad_pct <= 12 THEN 'seca' WHEN humedad_pct > 12 AND humedad_pct <= 14 THEN 'limite'
      WHEN humedad_pct > 14 AND humedad_pct <= 100 THEN 'humeda' END AS hum,
    CASE WHEN impurezas_pct > -1 AND impurezas_pct <= 0.5 THEN 'limpio' WHEN impurezas_pct <= 1 THEN 'borde' ELSE 'sucio' END AS imp
    FROM recepcion) GROUP BY ALL"""))
def fixed_bins(spark, sf):
    from veta.operators.rules import delivery_items

    d = delivery_items(roles.receipts(spark, sf))
    return d.groupBy(F.col("HUM").alias("hum"), F.col("IMP").alias("imp")).agg(F.count(F.lit(1)).alias("n"))


@query("quantile_bins", """WITH q AS (SELECT quantile_cont(l_extendedprice, 1 / 3.0::DOUBLE) AS a, quantile_cont(l_extendedprice, 2 / 3.0::DOUBLE) AS b
    FROM lineitem) SELECT CASE WHEN l_extendedprice <= a THEN 'chico' WHEN l_extendedprice <= b THEN 'medio' ELSE 'grande' END AS tramo,
    count(*) AS n, min(l_extendedprice) AS minimo, max(l_extendedprice) AS maximo FROM lineitem CROSS JOIN q GROUP BY 1""")
def quantile_bins(spark, sf):
    d = op.quantile_bins(roles.table(spark, sf, "lineitem").select("l_extendedprice"), "l_extendedprice", ["chico", "medio", "grande"], "tramo")
    return d.groupBy("tramo").agg(F.count(F.lit(1)).alias("n"), F.min("l_extendedprice").alias("minimo"), F.max("l_extendedprice").alias("maximo"))


@query("quantile_label", sql_with("recepcion", then=""", m AS (SELECT id_recepcion, id_parte, peso_neto * (greatest(humedad_pct - 14, 0) / 100
    + greatest(impurezas_pct - 1, 0) / 100) AS merma FROM recepcion), q AS (SELECT quantile_cont(merma, 0.85) AS q FROM m)
    SELECT id_recepcion, id_parte, round(merma, 6) AS merma, CASE WHEN merma > q THEN 1 ELSE 0 END AS y FROM m CROSS JOIN q"""))
def quantile_label(spark, sf):
    """High-shrink label: above the 85th percentile of the expected shrink."""
    loss = F.col("peso_neto") * (fn.clip(F.col("humedad_pct") - 14, 0) / 100 + fn.clip(F.col("impurezas_pct") - 1, 0) / 100)
    d = roles.receipts(spark, sf).select("id_recepcion", "id_parte", loss.alias("merma"))
    return op.quantile_label(d, "merma", 0.85).withColumn("merma", tidy("merma"))


@query("one_hot", "SELECT c_custkey, " + ", ".join(f"CASE WHEN c_mktsegment = '{s}' AND c_mktsegment IN (SELECT c_mktsegment FROM customer WHERE c_custkey % 10 < 7) THEN 1 ELSE 0 END AS seg_{s}" for s in (
    "AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer")
def one_hot(spark, sf):
    """Dummies for the levels known from training; other levels are 0 everywhere."""
    c = roles.table(spark, sf, "customer")
    levels = op.levels_of(c.filter("c_custkey % 10 < 7"), "c_mktsegment")
    return op.one_hot(c.select("c_custkey", "c_mktsegment"), "c_mktsegment", levels, "seg_").drop("c_mktsegment")


@query("filled_categories", sql_with("embarque", "envio", "transporte", then="""SELECT coalesce(tipo, 'FALTA') AS tipo, count(*) AS n FROM embarque
    LEFT JOIN (SELECT id_embarque, max(tipo) AS tipo FROM envio JOIN transporte USING (id_transporte) GROUP BY 1) USING (id_embarque) GROUP BY 1"""))
def filled_categories(spark, sf):
    kind = (roles.dispatches(spark, sf).join(roles.carriers(spark, sf), "id_transporte").groupBy("id_embarque").agg(F.max("tipo").alias("tipo")))
    d = op.fill_category(roles.shipments(spark, sf).join(kind, "id_embarque", "left"), ["tipo"])
    return d.groupBy("tipo").agg(F.count(F.lit(1)).alias("n"))


@query("coerced", """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CAST(NULL AS DOUBLE) AS malo FROM events""")
def coerced(spark, sf):
    """Text to numbers; what does not parse becomes null."""
    e = roles.table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.col("event_type").alias("malo"))
    return lower_names(coerce(upper_names(e), ["K", "MALO"]))


@query("hash_sample", """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE CAST('0x' || substr(md5(l_orderkey || '|' || l_linenumber || '|'
    || l_partkey), 1, 8) AS BIGINT) % 10000 < 1500""")
def hash_sample(spark, sf):
    """Repeatable 15 % row sample."""
    li = roles.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return sample_percent(li, 15, ["l_orderkey", "l_linenumber", "l_partkey"])


@query("chronological_split", sql_with("embarque", then=""", n AS (SELECT count(*) AS n FROM embarque WHERE fecha_real IS NOT NULL),
    p AS (SELECT id_embarque, row_number() OVER (ORDER BY fecha_programada, id_embarque) AS k FROM embarque WHERE fecha_real IS NOT NULL)
    SELECT id_embarque, CASE WHEN k <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN k <= floor(n * 0.85::DOUBLE) THEN 'validation' ELSE 'test' END AS split
    FROM p CROSS JOIN n"""))
def chronological_split(spark, sf):
    d = roles.shipments(spark, sf).filter("fecha_real is not null").select("id_embarque", "fecha_programada")
    return splits.chronological(d, ["fecha_programada", "id_embarque"]).select("id_embarque", "split")


@query("purged_split", sql_with("embarque", then=""", p AS (SELECT id_embarque, incoterm, row_number() OVER (PARTITION BY incoterm ORDER BY fecha_programada,
    id_embarque) AS k, count(*) OVER (PARTITION BY incoterm) AS n FROM embarque)
    SELECT id_embarque, incoterm, CASE WHEN k <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN k <= floor(n * 0.7::DOUBLE) + 3 THEN 'purga'
      WHEN k <= floor(n * 0.85::DOUBLE) THEN 'validation' WHEN k <= floor(n * 0.85::DOUBLE) + 3 THEN 'purga' ELSE 'test' END AS split FROM p"""))
def purged_split(spark, sf):
    d = roles.shipments(spark, sf).select("id_embarque", "incoterm", "fecha_programada")
    return splits.purged(d, ["incoterm"], ["fecha_programada", "id_embarque"], 3).select("id_embarque", "incoterm", "split")


@query("stratified_split", """WITH p AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(c_custkey || ''), c_custkey) AS k,
    count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) SELECT c_custkey, c_mktsegment, CASE WHEN k <= floor(n * 0.7::DOUBLE + 0.5) THEN 'train'
    WHEN k <= floor(n * 0.85::DOUBLE + 0.5) THEN 'validation' ELSE 'test' END AS split FROM p""")
def stratified_split(spark, sf):
    c = roles.table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return splits.stratified(c, "c_mktsegment", ["c_custkey"], {"train": 0.7, "validation": 0.15, "test": 0.15})


@query("stratified_folds", """SELECT c_custkey, CAST((row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(c_custkey || ''), c_custkey) - 1) % 5
    AS INTEGER) AS pliegue FROM customer""")
def stratified_folds(spark, sf):
    c = roles.table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return splits.stratified_folds(c, "c_mktsegment", ["c_custkey"], 5).select("c_custkey", "pliegue")


@query("expanding_folds", """WITH n AS (SELECT count(*) AS n FROM orders), p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS k
    FROM orders) SELECT o_orderkey, CAST(CASE WHEN k <= n - 4 * (n // 5) THEN 0 ELSE (k - (n - 4 * (n // 5)) - 1) // (n // 5) + 1 END AS INTEGER) AS pliegue
    FROM p CROSS JOIN n""")
def expanding_folds(spark, sf):
    o = roles.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return splits.expanding_folds(o, ["o_orderdate", "o_orderkey"], 4).select("o_orderkey", "pliegue")


@query("every_third", """SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS k
    FROM orders) WHERE (k - 1) % 3 = 0""")
def every_third(spark, sf):
    """Non-overlapping subsample: every third row per key."""
    o = roles.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    return splits.every_nth(o, ["o_orderpriority"], ["o_orderdate", "o_orderkey"], 3).select("o_orderkey", "o_orderpriority")


@query("calendar_functions", sql_with("envio", then="""SELECT id_embarque, linea, id_parte, date_diff('hour', fecha_salida, fecha_llegada) AS horas,
    CAST(floor((epoch(fecha_llegada) - epoch(fecha_salida)) / 86400) AS BIGINT) AS dias, CAST(isodow(fecha_salida) - 1 AS INTEGER) AS dia_semana,
    strftime(fecha_salida, '%Y-%m') AS mes, round(sin(2 * pi() * hour(fecha_salida) / 24), 6) + 0.0::DOUBLE AS hora_sin,
    round(cos(2 * pi() * hour(fecha_salida) / 24), 6) + 0.0::DOUBLE AS hora_cos,
    CAST(regexp_extract(CAST(abs(costo_flete_usd) AS VARCHAR), '[1-9]') AS INTEGER) AS digito FROM envio"""))
def calendar_functions(spark, sf):
    d = roles.dispatches(spark, sf)
    sin, cos = fn.cyclic(F.hour("fecha_salida"), 24)
    return d.select("id_embarque", "linea", "id_parte", fn.boundary_hours("fecha_salida", "fecha_llegada").alias("horas"),
                    fn.floor_days("fecha_salida", "fecha_llegada").alias("dias"), F.weekday("fecha_salida").alias("dia_semana"),
                    fn.month_text("fecha_salida").alias("mes"), tidy(sin).alias("hora_sin"), tidy(cos).alias("hora_cos"),
                    fn.first_digit("costo_flete_usd").alias("digito"))
