"""Producers, contracts and clients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veta.functions.columns import tidy
from veta.operators import profiles as op
from veta.operators.stats import anova
from veta.plans.registry import query
from veta.sources import roles
from veta.sources.roles import sql_with

START, END = "1995-06-01", "2001-06-01"


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Report form: doubles rounded, dates as text."""
    def show(name: str, kind: str) -> Column:
        if kind in ("double", "float"):
            return tidy(name, digits).alias(name)
        return F.col(name).cast("string").alias(name) if kind == "date" else F.col(name)

    return df.select(*[show(f.name, f.dataType.typeName()) for f in df.schema.fields])


def fact(spark: SparkSession, sf: str) -> DataFrame:
    c = roles.contracts(spark, sf).select("id_contrato", "id_productor")
    return op.with_shrink(roles.receipts(spark, sf)).join(c, "id_contrato")


FACT_SQL = """hecho AS (SELECT r.*, c.id_productor, peso_neto * greatest(humedad_pct / 100 - 0.14, 0) AS merma_humedad_tn,
    peso_neto * greatest(impurezas_pct / 100 - 0.01, 0) AS merma_impureza_tn
    FROM recepcion r JOIN contrato c USING (id_contrato))"""

PROFILE_SQL = """perfil AS (SELECT p.id_productor, p.nombre_completo, p.tipo_productor, p.municipio, p.area_total_ha,
    count(*) AS n_recepciones, sum(peso_neto) AS volumen_total_tn, avg(peso_neto) AS ticket_medio_tn,
    sum(merma_humedad_tn + merma_impureza_tn) AS merma_total_tn,
    avg(humedad_pct) AS humedad_media, stddev_samp(humedad_pct) AS humedad_std, max(humedad_pct) AS humedad_max,
    avg(CASE WHEN humedad_pct > 14 THEN 1.0 ELSE 0.0 END) AS pct_hum_crit,
    avg(impurezas_pct) AS impurezas_media, stddev_samp(impurezas_pct) AS impurezas_std, max(impurezas_pct) AS impurezas_max,
    avg(CASE WHEN impurezas_pct > 1 THEN 1.0 ELSE 0.0 END) AS pct_imp_crit,
    avg(proteina_pct) AS proteina_media, avg(aceite_pct) AS aceite_media,
    avg(CASE WHEN calidad_grano = 'DESCUENTO' THEN 1.0 ELSE 0.0 END) AS pct_descuento,
    max(merma_humedad_tn + merma_impureza_tn) AS max_merma_evento, count(DISTINCT id_silo) AS n_silos
    FROM hecho f JOIN productor p USING (id_productor) GROUP BY 1, 2, 3, 4, 5)"""


def sql_rounded(columns: str, digits: int = 4) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0::DOUBLE AS {c}" for c in columns.split())


PROFILE_DOUBLES = ("area_total_ha volumen_total_tn ticket_medio_tn merma_total_tn humedad_media humedad_std humedad_max "
                   "pct_hum_crit impurezas_media impurezas_std impurezas_max pct_imp_crit proteina_media aceite_media "
                   "pct_descuento max_merma_evento")


def profile(spark: SparkSession, sf: str) -> DataFrame:
    return op.producer_profile(fact(spark, sf), roles.producers(spark, sf))


@query("producer_profile", sql_with("recepcion", "contrato", "productor", then=f""", {FACT_SQL}, {PROFILE_SQL}
    SELECT id_productor, nombre_completo, tipo_productor, municipio, n_recepciones, n_silos, {sql_rounded(PROFILE_DOUBLES)}
    FROM perfil"""))
def producer_profile(spark, sf):
    return rounded(profile(spark, sf))


def producer_360(spark: SparkSession, sf: str) -> DataFrame:
    return op.producer_360(roles.receipts(spark, sf), roles.contracts(spark, sf), roles.producers(spark, sf), START, END)


P360_SQL = f"""p360 AS (SELECT p.id_productor, p.tipo_productor, count(*) AS n, sum(peso_neto) AS vol,
    avg(CASE WHEN humedad_pct > 14 THEN 1.0 ELSE 0.0 END) AS p_crit, stddev_samp(humedad_pct) AS hum_std,
    max(humedad_pct) AS hum_max, count(DISTINCT id_silo) AS n_silos,
    count(DISTINCT strftime(fecha_hora, '%Y-%m')) AS n_meses, max(strftime(fecha_hora, '%Y-%m')) AS ultimo_mes,
    sum(CASE WHEN hour(fecha_hora) BETWEEN 22 AND 23 OR hour(fecha_hora) BETWEEN 0 AND 5 THEN 1 ELSE 0 END) * 1.0::DOUBLE
      / count(*) AS p_noct,
    sum(peso_neto * peso_neto) / nullif(sum(peso_neto), 0) AS ticket_pond
    FROM recepcion r LEFT JOIN contrato c USING (id_contrato) JOIN productor p ON p.id_productor = c.id_productor
    WHERE peso_neto BETWEEN 1 AND 200 AND fecha_hora BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}' GROUP BY 1, 2)"""


@query("producer_profile_360", sql_with("recepcion", "contrato", "productor", then=f""", {P360_SQL}
    SELECT id_productor, tipo_productor, n, n_silos, n_meses, ultimo_mes,
    {sql_rounded("vol p_crit hum_std hum_max p_noct ticket_pond")} FROM p360"""))
def producer_profile_360(spark, sf):
    return rounded(producer_360(spark, sf))


COMPLIANCE_SQL = """cumplido AS (SELECT p360.*, comp, vol / nullif(comp, 0) AS cumplimiento,
    CASE WHEN comp IS NOT NULL AND vol <> 0 THEN least(greatest(comp / vol, 0), 1) END AS pct_cubierto
    FROM p360 LEFT JOIN (SELECT id_productor, sum(volumen_comprometido_tn) AS comp
        FROM (SELECT DISTINCT id_contrato, id_productor, volumen_comprometido_tn FROM contrato) GROUP BY 1) USING (id_productor))"""


def compliance(spark: SparkSession, sf: str) -> DataFrame:
    return op.contract_compliance(producer_360(spark, sf), roles.contracts(spark, sf))


@query("contract_compliance", sql_with("recepcion", "contrato", "productor", then=f""", {P360_SQL}, {COMPLIANCE_SQL}
    SELECT id_productor, tipo_productor, {sql_rounded("vol comp cumplimiento pct_cubierto")} FROM cumplido"""))
def contract_compliance(spark, sf):
    return rounded(compliance(spark, sf).select("id_productor", "tipo_productor", "vol", "comp", "cumplimiento",
                                                "pct_cubierto"))


@query("contract_medians", sql_with("recepcion", "contrato", "productor", then=f""", {P360_SQL}, {COMPLIANCE_SQL}
    SELECT tipo_productor, round(median(cumplimiento), 6) AS cumplimiento_mediano,
    round(median(pct_cubierto), 6) AS cubierto_mediano FROM cumplido GROUP BY 1"""))
def contract_medians(spark, sf):
    """Median compliance and coverage by producer type."""
    from veta.operators.sequence import medians

    m = medians(compliance(spark, sf), ["cumplimiento", "pct_cubierto"], ["tipo_productor"])
    return m.select("tipo_productor", tidy("med_cumplimiento").alias("cumplimiento_mediano"),
                    tidy("med_pct_cubierto").alias("cubierto_mediano"))


@query("contract_top_offenders", sql_with("recepcion", "contrato", "productor", then=f""", {P360_SQL}, {COMPLIANCE_SQL}
    SELECT * FROM (SELECT 'INCUMPLIDO' AS lista, id_productor, tipo_productor, round(vol, 4) AS vol, round(comp, 4) AS comp,
      round(cumplimiento, 4) AS cumplimiento FROM cumplido WHERE cumplimiento < 1.9 AND vol > 1000
      ORDER BY cumplido.cumplimiento, id_productor LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 'FANTASMA', id_productor, tipo_productor, round(vol, 4), round(comp, 4),
      round(cumplimiento, 4) FROM cumplido WHERE cumplimiento > 2 ORDER BY cumplido.cumplimiento DESC, id_productor LIMIT 10)"""))
def contract_top_offenders(spark, sf):
    return rounded(op.offenders(compliance(spark, sf), below=1.9))


def sales(spark: SparkSession, sf: str) -> DataFrame:
    """Sales with a basis: contract price against the price the volume implies."""
    c = roles.contracts(spark, sf)
    return c.select(F.col("id_productor").alias("id_cliente"),
                    (F.col("precio_acordado_usd_tn") - F.pmod(F.col("id_contrato"), F.lit(97)) * 5).alias("prima_basis_usd"))


SALES_SQL = """venta AS (SELECT id_productor AS id_cliente, precio_acordado_usd_tn - (id_contrato % 97) * 5 AS prima_basis_usd
    FROM contrato)"""


@query("basis_by_segment", sql_with("contrato", "cliente", then=f""", {SALES_SQL}
    SELECT segmento, round(avg(prima_basis_usd), 4) AS media, round(stddev_samp(prima_basis_usd), 4) AS desv,
    count(prima_basis_usd) AS n FROM venta LEFT JOIN cliente USING (id_cliente) GROUP BY 1"""))
def basis_by_segment(spark, sf):
    return rounded(op.basis_by_segment(sales(spark, sf), roles.clients(spark, sf)))


@query("basis_anova", sql_with("contrato", "cliente", then=f""", {SALES_SQL},
    g AS (SELECT segmento, count(prima_basis_usd) AS n, avg(prima_basis_usd) AS m, var_pop(prima_basis_usd) AS v
      FROM venta LEFT JOIN cliente USING (id_cliente) WHERE segmento IS NOT NULL GROUP BY 1),
    t AS (SELECT sum(n) AS nn, count(*) AS k, sum(n * m) / sum(n) AS gm FROM g)
    SELECT 'prima_basis_usd' AS variable, CAST(any_value(k) AS BIGINT) AS grupos, CAST(any_value(nn) AS BIGINT) AS n,
      round((sum(g.n * (m - gm) * (m - gm)) / (any_value(k) - 1)) / (sum(g.n * v) / (any_value(nn) - any_value(k))), 6) AS f
    FROM g CROSS JOIN t"""))
def basis_anova(spark, sf):
    rows = sales(spark, sf).join(roles.clients(spark, sf), "id_cliente", "left")
    return anova(rows, "segmento", ["prima_basis_usd"]).select("variable", "grupos", "n", tidy("f").alias("f"))


@query("segment_profile_join", sql_with("recepcion", "contrato", "productor", then=f""", {FACT_SQL}, {PROFILE_SQL}
    SELECT CAST(id_productor % 3 AS BIGINT) AS segmento, count(*) AS n, round(avg(volumen_total_tn), 4) AS volumen_total_tn,
    round(avg(max_merma_evento), 4) AS max_merma_evento, round(avg(pct_hum_crit), 4) AS pct_hum_crit FROM perfil GROUP BY 1"""))
def segment_profile_join(spark, sf):
    """Segments joined back to the features, group means (fixed segments, so that SQL can follow)."""
    from veta.operators.summary import label_profile

    p = profile(spark, sf)
    labels = roles.producers(spark, sf).select("id_productor", F.pmod("id_productor", F.lit(3)).alias("segmento"))
    return rounded(label_profile(p.join(labels, "id_productor"), "segmento",
                                 ["volumen_total_tn", "max_merma_evento", "pct_hum_crit"]))


@query("receipt_enriched_lab", sql_with("recepcion", "contrato", "asignacion", "control", then="""
    SELECT r.id_recepcion, r.id_silo, CAST(r.id_contrato AS VARCHAR) AS id_contrato, CAST(c.id_productor AS VARCHAR) AS id_productor, c.volumen_comprometido_tn, coalesce(n_lab, 0) AS n_lab
    FROM recepcion r LEFT JOIN contrato c USING (id_contrato) LEFT JOIN (SELECT a.id_recepcion, count(*) AS n_lab
      FROM asignacion a JOIN control USING (id_lote) GROUP BY 1) lab USING (id_recepcion)"""))
def receipt_enriched_lab(spark, sf):
    from veta.operators.weighing import enrich

    e = enrich(roles.receipts(spark, sf), roles.contracts(spark, sf), roles.lab_assignments(spark, sf),
               roles.lab_controls(spark, sf))
    return e.select("id_recepcion", "id_silo", F.col("id_contrato").cast("string").alias("id_contrato"),
                    F.col("id_productor").cast("string").alias("id_productor"), "volumen_comprometido_tn", "n_lab")


@query("latest_per_key", """SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER
    (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def latest_per_key(spark, sf):
    """Last version of every key."""
    from veta.operators.panel import latest

    o = roles.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return latest(o, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("recent_window_lots", sql_with("recepcion", then="""
    SELECT id_recepcion, id_silo, peso_neto, humedad_pct, impurezas_pct, fecha_hora FROM recepcion
    WHERE fecha_hora >= (SELECT max(fecha_hora) - INTERVAL 30 DAY FROM recepcion WHERE fecha_hora
      BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '2001-10-01')
    AND fecha_hora BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '2001-10-01' AND peso_neto BETWEEN 1 AND 200"""))
def recent_window_lots(spark, sf):
    from veta.operators.assignment import recent_lots

    return (recent_lots(roles.receipts(spark, sf), 30, "1995-01-01", "2001-10-01")
            .select("id_recepcion", "id_silo", "peso_neto", "humedad_pct", "impurezas_pct", "fecha_hora"))
