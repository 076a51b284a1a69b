"""Association rules over deliveries."""

from __future__ import annotations

from pyspark.sql import functions as F

from veta.functions.columns import tidy
from veta.operators import rules as op
from veta.plans.registry import query
from veta.sources import roles
from veta.sources.roles import sql_with

ITEM_SQL = """q AS (SELECT quantile_cont(peso_neto, 1 / 3.0::DOUBLE) AS a, quantile_cont(peso_neto, 2 / 3.0::DOUBLE) AS b FROM recepcion),
    fila AS (SELECT row_number() OVER () AS id, 'VOL=' || CASE WHEN peso_neto <= a THEN 'chico' WHEN peso_neto <= b THEN 'medio' ELSE 'grande' END AS v,
      'HUM=' || CASE WHEN humedad_pct <= 12 THEN 'seca' WHEN humedad_pct <= 14 THEN 'limite' ELSE 'humeda' END AS h,
      'IMP=' || CASE WHEN impurezas_pct <= 0.5 THEN 'limpio' WHEN impurezas_pct <= 1 THEN 'borde' ELSE 'sucio' END AS i,
      'CAL=' || calidad_grano AS c FROM recepcion CROSS JOIN q),
    pieza AS (SELECT id, unnest([v, h, i, c]) AS x FROM fila),
    junto AS (SELECT x AS s, 1 AS k, count(*) AS n FROM pieza GROUP BY 1
      UNION ALL SELECT a.x || ',' || b.x, 2, count(*) FROM pieza a JOIN pieza b ON a.id = b.id AND a.x < b.x GROUP BY 1
      UNION ALL SELECT a.x || ',' || b.x || ',' || c.x, 3, count(*) FROM pieza a JOIN pieza b ON a.id = b.id AND a.x < b.x
        JOIN pieza c ON c.id = b.id AND b.x < c.x GROUP BY 1),
    frecuente AS (SELECT s, k, n, n / (SELECT count(*) FROM fila)::DOUBLE AS soporte FROM junto WHERE n >= 0.05 * (SELECT count(*) FROM fila))"""


def itemsets(spark, sf):
    return op.frequent_itemsets(op.transactions(op.delivery_items(roles.receipts(spark, sf)), ["VOL", "HUM", "IMP", "CAL"]))


@query("frequent_itemsets", sql_with("recepcion", then=f", {ITEM_SQL} SELECT s AS conjunto, n, round(soporte, 6) AS soporte FROM frecuente"))
def frequent_itemsets(spark, sf):
    return itemsets(spark, sf).select(F.array_join("conjunto", ",").alias("conjunto"), "n", tidy("soporte").alias("soporte"))


RULE_SQL = """partes AS (SELECT s, soporte, string_split(s, ',') AS l FROM frecuente WHERE k >= 2),
    corte AS (SELECT s, soporte, l[1] AS a, array_to_string(l[2:], ',') AS c FROM partes UNION ALL SELECT s, soporte, array_to_string(l[2:], ','), l[1] FROM partes
      UNION ALL SELECT s, soporte, l[2], l[1] || ',' || l[3] FROM partes WHERE len(l) = 3 UNION ALL SELECT s, soporte, l[1] || ',' || l[3], l[2] FROM partes WHERE len(l) = 3
      UNION ALL SELECT s, soporte, l[3], l[1] || ',' || l[2] FROM partes WHERE len(l) = 3 UNION ALL SELECT s, soporte, l[1] || ',' || l[2], l[3] FROM partes WHERE len(l) = 3),
    regla AS (SELECT a AS antecedente, c AS consecuente, r.soporte, r.soporte / fa.soporte AS confianza, r.soporte / fa.soporte / fc.soporte AS lift
      FROM corte r JOIN frecuente fa ON fa.s = a JOIN frecuente fc ON fc.s = c WHERE r.soporte / fa.soporte >= 0.3)"""


def shown(rules):
    return rules.select(F.array_join("antecedente", ",").alias("antecedente"), F.array_join("consecuente", ",").alias("consecuente"),
                        *[tidy(c).alias(c) for c in ("soporte", "confianza", "lift")])


@query("association_rules", sql_with("recepcion", then=f""", {ITEM_SQL}, {RULE_SQL} SELECT antecedente, consecuente, round(soporte, 6) AS soporte,
    round(confianza, 6) AS confianza, round(lift, 6) AS lift FROM regla"""))
def association_rules(spark, sf):
    return shown(op.association_rules(itemsets(spark, sf), 0.3))


@query("top_rules", sql_with("recepcion", then=f""", {ITEM_SQL}, {RULE_SQL} SELECT antecedente, consecuente, round(soporte, 6) AS soporte,
    round(confianza, 6) AS confianza, round(lift, 6) AS lift FROM regla WHERE confianza >= 0.5
    ORDER BY regla.lift DESC, regla.soporte DESC, antecedente, consecuente LIMIT 15"""))
def top_rules(spark, sf):
    """The 15 rules with the highest lift at the default confidence."""
    return shown(op.top_rules(op.association_rules(itemsets(spark, sf)), 15))
