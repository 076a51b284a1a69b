"""Descriptive statistics and correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from veta.operators import stats as op
from veta.operators import summary
from veta.plans.profiles import FACT_SQL, PROFILE_SQL, profile, rounded
from veta.plans.registry import query
from veta.sources import roles
from veta.sources.roles import sql_with

VIEWS = ("recepcion", "contrato", "productor")
LEFT = ["n_recepciones", "volumen_total_tn", "ticket_medio_tn", "merma_total_tn"]
RIGHT = ["humedad_media", "impurezas_media", "pct_descuento", "proteina_media", "aceite_media"]
DESCRIBED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("corr_pairs_top", sql_with(*VIEWS, then=f""", {FACT_SQL}, {PROFILE_SQL}, c AS (
    {' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM perfil" for a in LEFT for b in RIGHT)})
    SELECT a, b, round(r, 6) + 0.0::DOUBLE AS r FROM c ORDER BY abs(r) DESC, a, b LIMIT 8"""))
def corr_pairs_top(spark, sf):
    """Strongest correlations between two sets of variables."""
    return rounded(op.strongest_pairs(profile(spark, sf), LEFT, RIGHT, 8), 6)


@query("correlation_matrix", "WITH c AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lineitem" for i, a in enumerate(DESCRIBED) for b in DESCRIBED[i + 1:])
    + ") SELECT a, b, round(r, 6) + 0.0::DOUBLE AS r FROM c")
def correlation_matrix(spark, sf):
    return rounded(op.correlation_matrix(roles.table(spark, sf, "lineitem"), DESCRIBED), 6)


SPEARMAN = [("l_quantity", "l_extendedprice"), ("l_discount", "l_tax")]


@query("spearman_pairs", "WITH " + ", ".join(
    f"r{i} AS (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0::DOUBLE AS x, "
    f"rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0::DOUBLE AS y FROM lineitem)" for i, (a, b) in enumerate(SPEARMAN))
    + " " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr(x, y), 6) + 0.0::DOUBLE AS rho FROM r{i}" for i, (a, b) in enumerate(SPEARMAN)))
def spearman_pairs(spark, sf):
    return rounded(op.spearman(roles.table(spark, sf, "lineitem"), SPEARMAN), 6)


@query("describe_numeric", "WITH d AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, count({c}) AS n, avg({c}) AS media, stddev_samp({c}) AS desv, min({c}) AS minimo, max({c}) AS maximo, "
    f"quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75 FROM lineitem" for c in DESCRIBED)
    + ") SELECT variable, n, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("media", "desv", "minimo", "maximo", "q25", "q50", "q75")) + " FROM d")
def describe_numeric(spark, sf):
    return rounded(summary.describe(roles.table(spark, sf, "lineitem"), DESCRIBED), 6)


@query("null_counts", sql_with("embarque", then=" UNION ALL ".join(
    f"SELECT '{c}' AS variable, count(*) - count({c}) AS nulos, round((count(*) - count({c})) / count(*)::DOUBLE, 6) AS proporcion FROM embarque"
    for c in ("fecha_real", "incoterm", "cantidad_tn"))))
def null_counts(spark, sf):
    return rounded(summary.null_counts(roles.shipments(spark, sf), ["fecha_real", "incoterm", "cantidad_tn"]), 6)


@query("value_counts", """SELECT o_orderpriority, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS proporcion FROM orders GROUP BY 1""")
def value_counts(spark, sf):
    return rounded(summary.value_counts(roles.table(spark, sf, "orders"), "o_orderpriority"), 6)


@query("class_by_split", """SELECT source, count(*) FILTER (WHERE quality = 0) AS "0", count(*) FILTER (WHERE quality = 1) AS "1"
    FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def class_by_split(spark, sf):
    """Crosstab of a class over the sources."""
    d = roles.table(spark, sf, "documents").select("doc_id", "source").join(roles.table(spark, sf, "labels"), "doc_id")
    return summary.crosstab(d, "source", "quality", [0, 1])


@query("variable_anova", sql_with(*VIEWS, then=f""", {FACT_SQL}, {PROFILE_SQL}, x AS ({' UNION ALL '.join(
    f"SELECT '{c}' AS variable, tipo_productor AS g, CAST({c} AS DOUBLE) AS v FROM perfil" for c in RIGHT)}),
    g AS (SELECT variable, g, count(v) AS n, avg(v) AS m, var_pop(v) AS s FROM x GROUP BY 1, 2),
    t AS (SELECT variable, sum(n) AS nn, count(*) AS k, sum(n * m) / sum(n) AS gm FROM g GROUP BY 1)
    SELECT variable, CAST(any_value(k) AS BIGINT) AS grupos, CAST(any_value(nn) AS BIGINT) AS n,
      round((sum(g.n * (m - gm) * (m - gm)) / (any_value(k) - 1)) / (sum(g.n * s) / (any_value(nn) - any_value(k))), 5) AS f
    FROM g JOIN t USING (variable) GROUP BY 1"""))
def variable_anova(spark, sf):
    """F statistic of several variables over producer types."""
    return rounded(op.anova(profile(spark, sf), "tipo_productor", RIGHT).select("variable", "grupos", "n", "f"), 5)


@query("covariance_matrix", "WITH m AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, covar_pop({a}, {b}) AS v FROM lineitem"
       for i, a in enumerate(DESCRIBED) for b in DESCRIBED[i:]) + ") SELECT a, b, round(v, 4) + 0.0::DOUBLE AS v FROM m")
def covariance_matrix(spark, sf):
    """Covariances from the one-pass moment table."""
    from veta.operators.linear import moments

    m = moments(roles.table(spark, sf, "lineitem"), DESCRIBED)
    cov = m.covariance()
    rows = [(a, b, float(cov[i, j])) for i, a in enumerate(DESCRIBED) for j, b in enumerate(DESCRIBED) if j >= i]
    return rounded(spark.createDataFrame(rows, "a string, b string, v double"))
