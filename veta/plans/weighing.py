"""Weigh-in risk front."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veta.functions.columns import BENFORD, rank_in, tidy
from veta.operators import weighing as op
from veta.operators.isolation import isolation_score
from veta.operators.summary import top_groups, value_counts
from veta.plans.profiles import rounded
from veta.plans.registry import query
from veta.sources import roles
from veta.session import materialise
from veta.sources.roles import RECEIPT_ORDER, sql_with

ORDER = list(RECEIPT_ORDER)
ORDER_SQL = ", ".join(ORDER)
VIEWS = ("recepcion", "contrato", "asignacion", "control", "predio")


def enriched(spark: SparkSession, sf: str) -> DataFrame:
    return op.enrich(roles.receipts(spark, sf), roles.contracts(spark, sf), roles.lab_assignments(spark, sf),
                     roles.lab_controls(spark, sf))


# What the signals and their queries read; the rest of a receipt would only be carried along.
READ = ["id_recepcion", "fecha_hora", "id_silo", "id_contrato", "peso_bruto_tn", "tara_tn", "peso_neto", "humedad_pct", "impurezas_pct",
        "numero_remision", "id_parte", "valor_usd"]


def signals(spark: SparkSession, sf: str) -> DataFrame:
    source = roles.receipts(spark, sf).select(*READ)
    contracts = roles.contracts(spark, sf).select("id_contrato", "id_productor", "volumen_comprometido_tn")
    # Copies before the contracts, so that these and the running totals share one shuffle; yields come with the contracts.
    flagged = op.repeated(source, op.copies_of(source, contracts), "numero_remision", "dup_remision")
    paid = op.yield_signal(contracts, roles.plots(spark, sf), deliveries=op.deliveries_of(op.basics(source), contracts), row="id_contrato")
    rich = op.enrich(flagged, paid, roles.lab_assignments(spark, sf), roles.lab_controls(spark, sf), keep=True)
    return op.signals(rich, roles.plots(spark, sf), ORDER, source, contracts)


ALERT = ["id_recepcion", "id_parte", "fecha_hora", "id_silo", "id_contrato", "peso_neto", "score", "tipologia", "severidad"]

ALERT_SHOWN = ["CAST(id_contrato AS STRING) AS id_contrato" if c == "id_contrato" else c for c in ALERT]
ALERT_SQL = ", ".join("CAST(id_contrato AS VARCHAR) AS id_contrato" if c == "id_contrato" else c for c in ALERT)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return op.score(signals(spark, sf))


def graded(spark: SparkSession, sf: str) -> DataFrame:
    """Scored receipts with severity; the score is written once because cut points and output both need it."""
    held = materialise(scored(spark, sf).select(*ALERT[:-1], "valor_usd"))
    return op.severity(held)


BASE_SQL = """base AS (SELECT r.*, c.id_productor, c.volumen_comprometido_tn, coalesce(n_lab, 0) AS n_lab,
    strftime(fecha_hora, '%Y-%m') AS mes, hour(fecha_hora) + minute(fecha_hora) / 60.0::DOUBLE AS hora_dec,
    CASE WHEN count(*) OVER (PARTITION BY numero_remision) > 1 THEN 1.0 ELSE 0.0 END AS dup_remision,
    CASE WHEN year(fecha_hora) < 2000 OR year(fecha_hora) > 2027 THEN 0.6 ELSE 0.0 END AS s_date,
    CASE WHEN isodow(fecha_hora) = 7 THEN 1.0 ELSE 0.0 END AS es_domingo
    FROM recepcion r LEFT JOIN contrato c USING (id_contrato)
    LEFT JOIN (SELECT a.id_recepcion, count(*) AS n_lab FROM asignacion a JOIN control USING (id_lote) GROUP BY 1) lab
      USING (id_recepcion))"""


def z_sql(column: str) -> str:
    return f"coalesce(dev_{column} / (1.4826 * (median(dev_{column}) OVER (PARTITION BY id_silo, mes) + 1e-9)), 0) AS z_{column}"


Z_SQL = "medio AS (SELECT *, " + ", ".join(
    f"abs({c} - median({c}) OVER (PARTITION BY id_silo, mes)) AS dev_{c}"
    for c in ("humedad_pct", "impurezas_pct", "peso_neto")) + " FROM base), robusto AS (SELECT *, " + ", ".join(
    z_sql(c) for c in ("humedad_pct", "impurezas_pct", "peso_neto")) + " FROM medio)"

LAW_SQL = "ley AS (SELECT d, log10(1 + 1.0::DOUBLE / d) AS b FROM range(1, 10) t(d))"
BENFORD_SQL = LAW_SQL + """, digito AS (SELECT id_silo, mes, nullif(regexp_extract(CAST(abs(peso_neto) AS VARCHAR), '[1-9]'), '')
      AS dg FROM base),
    conteo AS (SELECT id_silo, mes, CAST(dg AS BIGINT) AS d, count(*) AS c FROM digito WHERE dg IS NOT NULL GROUP BY ALL),
    total AS (SELECT id_silo, mes, CAST(sum(c) AS BIGINT) AS n FROM conteo GROUP BY ALL),
    chi AS (SELECT t.id_silo, t.mes, t.n, sum(pow(coalesce(c.c, 0) - t.n * b, 2) / (t.n * b)) AS chi2
      FROM total t CROSS JOIN ley LEFT JOIN conteo c ON c.id_silo = t.id_silo AND c.mes = t.mes AND c.d = ley.d GROUP BY ALL),
    benford AS (SELECT *, exp(-chi2 / 2) * (1 + chi2 / 2 + pow(chi2 / 2, 2) / 2 + pow(chi2 / 2, 3) / 6) AS p FROM chi)"""

SCORE_SQL = f"""{BASE_SQL}, {Z_SQL}, {BENFORD_SQL},
    rend AS (SELECT b.id_productor, least(greatest(sum(peso_neto) / nullif(any_value(ha), 0) / 8, 0), 1) AS s_rend
      FROM base b JOIN (SELECT id_productor, sum(superficie_ha) AS ha FROM predio GROUP BY 1) p USING (id_productor) GROUP BY 1),
    acum AS (SELECT *, CASE WHEN id_contrato IS NOT NULL THEN sum(peso_neto) OVER (PARTITION BY id_contrato ORDER BY {ORDER_SQL}
      ROWS UNBOUNDED PRECEDING) END AS acumulado FROM robusto),
    senal AS (SELECT a.*, least(-log10(greatest(p, 1e-12)), 6) / 6 AS s_benford, coalesce(s_rend, 0) AS s_rend,
      CASE WHEN id_contrato IS NULL THEN CASE WHEN peso_neto > 50 THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END
        ELSE coalesce(least(greatest(acumulado / nullif(volumen_comprometido_tn, 0) - 1, 0), 1), 0) END AS s_contrato,
      CASE WHEN n_lab = 0 THEN 0.4::DOUBLE ELSE 0 END AS s_lab,
      least(CASE WHEN hora_dec < 5 OR hora_dec > 23 THEN 0.7::DOUBLE ELSE 0 END + es_domingo * 0.3::DOUBLE, 1) AS s_hora,
      dup_remision * 0.6::DOUBLE AS s_dup,
      least(greatest(z_humedad_pct, z_impurezas_pct), 6) / 6 AS s_fisica, least(z_peso_neto, 6) / 6 AS s_peso
      FROM acum a JOIN benford USING (id_silo, mes) LEFT JOIN rend USING (id_productor)),
    doc AS (SELECT *, greatest(s_contrato, s_dup, s_date) AS s_doc,
      (dup_remision = 1 AND s_date > 0 AND id_contrato IS NULL) AS duro_doc FROM senal),
    punt AS (SELECT *, CASE WHEN duro_doc THEN 100.0::DOUBLE ELSE round(least(greatest((0.0::DOUBLE + s_benford * 15 + s_rend * 15
        + s_contrato * 10 + s_lab * 5 + s_hora * 10 + s_fisica * 15 + s_peso * 5 + s_doc * 10) / 1.1, 0), 100), 1) END AS score,
      CASE WHEN duro_doc THEN 'DOCUMENTAL'
        WHEN s_fisica >= greatest(s_doc, s_rend, s_benford, s_hora) THEN 'FISICA'
        WHEN s_doc >= greatest(s_rend, s_benford, s_hora) THEN 'DOCUMENTAL'
        WHEN s_rend >= greatest(s_benford, s_hora) THEN 'RENDIMIENTO'
        WHEN s_benford >= s_hora THEN 'ESTADISTICA' ELSE 'HORARIO' END AS tipologia FROM doc),
    corte AS (SELECT quantile_cont(score, 0.5) AS q50, quantile_cont(score, 0.9) AS q90, quantile_cont(score, 0.99) AS q99 FROM punt),
    final AS (SELECT punt.*, CASE WHEN score > q99 THEN 'critico' WHEN score > q90 THEN 'alto' WHEN score > q50 THEN 'medio'
      ELSE 'bajo' END AS severidad FROM punt CROSS JOIN corte)"""


@query("duplicate_remission", sql_with("recepcion", then="""SELECT numero_remision, id_recepcion, id_parte,
    CASE WHEN count(*) OVER (PARTITION BY numero_remision) > 1 THEN 1.0::DOUBLE ELSE 0.0 END AS dup_remision FROM recepcion"""))
def duplicate_remission(spark, sf):
    return op.duplicate_flag(roles.receipts(spark, sf)).select("numero_remision", "id_recepcion", "id_parte", "dup_remision")


@query("duplicate_key_count", sql_with("recepcion", then="""SELECT count(*) - count(DISTINCT numero_remision) AS dup_remision,
    count(*) - count(DISTINCT id_contrato) AS dup_contrato FROM recepcion"""))
def duplicate_key_count(spark, sf):
    """Rows beyond the first of each key; missing keys count as repeated."""
    n = F.count(F.lit(1))
    return roles.receipts(spark, sf).agg((n - F.count_distinct("numero_remision")).alias("dup_remision"),
                                         (n - F.count_distinct("id_contrato")).alias("dup_contrato"))


@query("robust_z", sql_with(*VIEWS, then=f""", {BASE_SQL}, {Z_SQL} SELECT id_recepcion, id_parte, id_silo, mes,
    round(z_humedad_pct, 6) + 0.0::DOUBLE AS z_humedad_pct, round(z_impurezas_pct, 6) + 0.0::DOUBLE AS z_impurezas_pct,
    round(z_peso_neto, 6) + 0.0::DOUBLE AS z_peso_neto FROM robusto"""))
def robust_z(spark, sf):
    d = op.robust_z(op.basics(roles.receipts(spark, sf)), op.STRATUM, ["humedad_pct", "impurezas_pct", "peso_neto"])
    return rounded(d.select("id_recepcion", "id_parte", "id_silo", "mes", "z_humedad_pct", "z_impurezas_pct",
                            "z_peso_neto"), 6)


@query("running_over_delivery", sql_with("recepcion", "contrato", then=f"""
    SELECT CAST(id_contrato AS VARCHAR) AS id_contrato, id_recepcion, id_parte, fecha_hora, peso_neto, round(acumulado, 4) AS acumulado,
    round(CASE WHEN id_contrato IS NULL THEN CASE WHEN peso_neto > 50 THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END
      ELSE coalesce(least(greatest(acumulado / nullif(volumen_comprometido_tn, 0) - 1, 0), 1), 0) END, 6) AS s_contrato
    FROM (SELECT r.*, c.volumen_comprometido_tn, CASE WHEN r.id_contrato IS NOT NULL THEN sum(peso_neto) OVER
      (PARTITION BY r.id_contrato ORDER BY {ORDER_SQL} ROWS UNBOUNDED PRECEDING) END AS acumulado
      FROM recepcion r LEFT JOIN contrato c ON c.id_contrato = r.id_contrato)"""))
def running_over_delivery(spark, sf):
    d = roles.receipts(spark, sf).join(roles.contracts(spark, sf), "id_contrato", "left")
    d = op.contract_signal(d, ORDER)
    return d.select(F.col("id_contrato").cast("string").alias("id_contrato"), "id_recepcion", "id_parte", "fecha_hora", "peso_neto",
                    F.round("acumulado", 4).alias("acumulado"), tidy("s_contrato").alias("s_contrato"))


@query("document_schedule_signals", sql_with(*VIEWS, then=f""", {BASE_SQL} SELECT id_recepcion, id_parte, id_silo,
    dup_remision * 0.6::DOUBLE AS s_dup, CAST(s_date AS DOUBLE) AS s_date, CASE WHEN n_lab = 0 THEN 0.4::DOUBLE ELSE 0 END AS s_lab,
    least(CASE WHEN hora_dec < 5 OR hora_dec > 23 THEN 0.7::DOUBLE ELSE 0 END + es_domingo * 0.3::DOUBLE, 1) AS s_hora FROM base"""))
def document_schedule_signals(spark, sf):
    d = op.document_signals(op.duplicate_flag(op.basics(enriched(spark, sf))))
    return d.select("id_recepcion", "id_parte", "id_silo", "s_dup", "s_date", "s_lab", "s_hora")


@query("benford_by_stratum", sql_with(*VIEWS, then=f""", {BASE_SQL}, {BENFORD_SQL} SELECT id_silo, mes, n,
    round(chi2, 6) AS chi2, round(p, 9) AS p, round(least(-log10(greatest(p, 1e-12)), 6) / 6, 6) + 0.0::DOUBLE AS senal FROM benford"""))
def benford_by_stratum(spark, sf):
    b = op.benford(op.basics(roles.receipts(spark, sf)), op.STRATUM)
    return b.select("id_silo", "mes", "n", tidy("chi2").alias("chi2"), F.round("p", 9).alias("p"), tidy("senal").alias("senal"))


@query("rare_digit_signal", sql_with(*VIEWS, then=f""", {BASE_SQL}, {LAW_SQL}, dg AS (SELECT id_recepcion, id_parte, peso_neto,
    CAST(nullif(regexp_extract(CAST(abs(peso_neto) AS VARCHAR), '[1-9]'), '') AS BIGINT) AS d FROM base),
    fr AS (SELECT d, count(*) / sum(count(*)) OVER () AS f FROM dg WHERE d IS NOT NULL GROUP BY d)
    SELECT id_recepcion, id_parte, peso_neto, round(least(greatest(coalesce(abs(f - b), 0), 0), 0.5) * 2, 6) AS s_digito
    FROM dg LEFT JOIN fr USING (d) LEFT JOIN ley USING (d)"""))
def rare_digit_signal(spark, sf):
    d = op.rare_digit_signal(roles.receipts(spark, sf))
    return d.select("id_recepcion", "id_parte", "peso_neto", tidy("s_digito").alias("s_digito"))


@query("yield_signal", sql_with(*VIEWS, then=f""", {SCORE_SQL} SELECT DISTINCT CAST(id_productor AS VARCHAR) AS id_productor, round(s_rend, 6) AS s_rend FROM senal"""))
def yield_signal(spark, sf):
    d = op.yield_signal(roles.receipts(spark, sf).join(roles.contracts(spark, sf), "id_contrato", "left"), roles.plots(spark, sf))
    return d.select(F.col("id_productor").cast("string").alias("id_productor"), tidy("s_rend").alias("s_rend")).distinct()


@query("weigh_score", sql_with(*VIEWS, then=f""", {SCORE_SQL} SELECT id_recepcion, id_parte, id_silo, fecha_hora, peso_neto,
    round(s_benford, 6) + 0.0::DOUBLE AS s_benford, round(s_fisica, 6) + 0.0::DOUBLE AS s_fisica,
    round(s_doc, 6) + 0.0::DOUBLE AS s_doc, score, tipologia FROM punt"""))
def weigh_score(spark, sf):
    d = scored(spark, sf)
    return d.select("id_recepcion", "id_parte", "id_silo", "fecha_hora", "peso_neto", tidy("s_benford").alias("s_benford"),
                    tidy("s_fisica").alias("s_fisica"), tidy("s_doc").alias("s_doc"), "score", "tipologia")


@query("weigh_typology", sql_with(*VIEWS, then=f""", {SCORE_SQL} SELECT tipologia, count(*) AS n,
    round(count(*) / sum(count(*)) OVER (), 6) AS proporcion FROM punt GROUP BY 1"""))
def weigh_typology(spark, sf):
    return rounded(value_counts(scored(spark, sf), "tipologia"), 6)


@query("weigh_severity", sql_with(*VIEWS, then=f""", {SCORE_SQL} SELECT severidad, count(*) AS n,
    min(score) AS minimo, max(score) AS maximo FROM final GROUP BY 1"""))
def weigh_severity(spark, sf):
    d = graded(spark, sf)
    return d.groupBy("severidad").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("minimo"), F.max("score").alias("maximo"))


@query("risk_by_silo", sql_with(*VIEWS, then=f""", {SCORE_SQL} SELECT id_silo, round(avg(score), 1) AS mean, max(score) AS max,
    count(score) AS count FROM punt GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""))
def risk_by_silo(spark, sf):
    return top_groups(scored(spark, sf), "id_silo", "score", 10)


@query("risk_by_contract", sql_with(*VIEWS, then=f""", {SCORE_SQL} SELECT id_contrato, round(avg(score), 1) AS mean,
    max(score) AS max, count(score) AS count FROM punt WHERE id_contrato IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""))
def risk_by_contract(spark, sf):
    return top_groups(scored(spark, sf).filter("id_contrato is not null"), "id_contrato", "score", 10)


@query("risk_by_month", sql_with(*VIEWS, then=f""", {SCORE_SQL} SELECT mes, round(avg(score), 1) AS mean, max(score) AS max,
    count(score) AS count FROM punt GROUP BY 1"""))
def risk_by_month(spark, sf):
    return scored(spark, sf).groupBy("mes").agg(F.round(F.avg("score"), 1).alias("mean"), F.max("score").alias("max"),
                                                F.count("score").alias("count"))


@query("alerts_top", sql_with(*VIEWS, then=f""", {SCORE_SQL} SELECT {ALERT_SQL} FROM final
    ORDER BY score DESC, {ORDER_SQL} LIMIT 5000"""))
def alerts_top(spark, sf):
    return op.alerts(graded(spark, sf), 5000, ORDER).selectExpr(*ALERT_SHOWN)


@query("alerts_from_severity", sql_with(*VIEWS, then=f""", {SCORE_SQL} SELECT {ALERT_SQL} FROM final
    WHERE severidad IN ('alto', 'critico') ORDER BY score DESC, {ORDER_SQL} LIMIT 500"""))
def alerts_from_severity(spark, sf):
    """Preview of the alerts from a chosen severity upwards."""
    d = graded(spark, sf)
    level = rank_in("severidad", op.SEVERITIES)
    return op.alerts(d.filter(level >= op.SEVERITIES.index("alto")), 500, ORDER).selectExpr(*ALERT_SHOWN)


ISO_FEATURES = ["peso_neto", "tara_ratio", "hora_dec", "humedad_pct", "impurezas_pct", "z_peso_neto", "s_rend",
                "s_contrato", "es_madrugada", "es_domingo"]


@query("isolation_score")
def isolation(spark, sf):
    """Score with the isolation part: every receipt with its anomaly value and final score."""
    wanted = ["id_recepcion", "id_parte", "id_silo", "fecha_hora", *ISO_FEATURES, *[s for s in op.WEIGHTS if s not in ("s_iso", *ISO_FEATURES)],
              "dup_remision", "s_date", "id_contrato", "tara_tn", "peso_bruto_tn"]
    d = isolation_score(materialise(signals(spark, sf).select(*wanted)), ISO_FEATURES, ids=["id_recepcion", "id_parte", "id_silo", "fecha_hora"])
    d = op.severity(materialise(op.score(d).select("id_recepcion", "id_parte", "s_iso", "score", "tipologia")))
    return d.select("id_recepcion", "id_parte", tidy("s_iso").alias("s_iso"), "score", "tipologia", "severidad")
