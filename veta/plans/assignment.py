"""Lots to silos."""

from __future__ import annotations

from pyspark.sql import functions as F

from veta.functions.columns import tidy
from veta.operators import assignment as op
from veta.plans.profiles import rounded
from veta.plans.registry import query
from veta.sources import roles
from veta.sources.roles import sql_with

WINDOW = (30, "1995-01-01", "2001-10-01")
KEY = ["id_recepcion", "id_parte", "id_silo", "peso_neto", "valor_usd"]


def lots(spark, sf):
    d = op.recent_lots(roles.receipts(spark, sf), *WINDOW)
    name = F.concat_ws("-", *[F.col(k).cast("string") for k in KEY])
    return op.lot_costs(d).select(name.alias("id_lote"), "id_silo", "peso_neto", "tasa", "base")


def silos(spark, sf):
    return op.silo_factors(roles.silos(spark, sf), roles.inventory(spark, sf))


LOT_SQL = f"""lote AS (SELECT id_silo, peso_neto, greatest(humedad_pct / 100 - 0.14, 0) + greatest(impurezas_pct / 100 - 0.01, 0) AS tasa,
      id_recepcion, id_parte, valor_usd FROM recepcion
      WHERE fecha_hora >= (SELECT max(fecha_hora) - INTERVAL {WINDOW[0]} DAY FROM recepcion WHERE fecha_hora BETWEEN TIMESTAMP '{WINDOW[1]}'
        AND TIMESTAMP '{WINDOW[2]}') AND fecha_hora BETWEEN TIMESTAMP '{WINDOW[1]}' AND TIMESTAMP '{WINDOW[2]}' AND peso_neto BETWEEN 1 AND 200),
    factor AS (SELECT s.id_silo, greatest(capacidad_tn, 0) AS libre_tn,
      coalesce(least(greatest(coalesce(stock_tn, 0) / nullif(capacidad_tn, 0), 0), 1), 0) AS lleno, 1.0::DOUBLE
      + CASE WHEN coalesce(temperatura_control, false) THEN 0 ELSE 0.2::DOUBLE END
      + CASE WHEN coalesce(least(greatest(coalesce(stock_tn, 0) / nullif(capacidad_tn, 0), 0), 1), 0) > 0.9 THEN 0.1::DOUBLE ELSE 0 END AS factor
      FROM silo s LEFT JOIN (SELECT id_silo, sum(stock_tn) AS stock_tn FROM inventario GROUP BY 1) i USING (id_silo) WHERE capacidad_tn > 0)"""


@query("silo_factors", sql_with("recepcion", "silo", "inventario", then=f""", {LOT_SQL} SELECT id_silo, round(libre_tn, 4) AS libre_tn,
    round(lleno, 6) AS lleno, round(factor, 4) AS factor FROM factor"""))
def silo_factors(spark, sf):
    return silos(spark, sf).select("id_silo", tidy("libre_tn", 4).alias("libre_tn"), tidy("lleno").alias("lleno"), tidy("factor", 4).alias("factor"))


@query("assignment_bound", sql_with("recepcion", "silo", "inventario", then=f""", {LOT_SQL},
    a AS (SELECT tasa, sum(peso_neto) OVER v - peso_neto AS ini, sum(peso_neto) OVER v AS fin FROM lote
      WINDOW v AS (ORDER BY tasa DESC, id_recepcion, id_parte, id_silo, peso_neto, valor_usd ROWS UNBOUNDED PRECEDING)),
    b AS (SELECT factor, sum(libre_tn) OVER v - libre_tn AS ini, sum(libre_tn) OVER v AS fin FROM factor
      WINDOW v AS (ORDER BY factor, id_silo ROWS UNBOUNDED PRECEDING))
    SELECT round(sum((least(a.fin, b.fin) - greatest(a.ini, b.ini)) * tasa * factor), 4) AS cota,
      round(sum(least(a.fin, b.fin) - greatest(a.ini, b.ini)), 4) AS tn FROM a JOIN b ON a.ini < b.fin AND b.ini < a.fin"""))
def assignment_bound(spark, sf):
    return rounded(op.lower_bound(lots(spark, sf), silos(spark, sf)))


@query("silo_assignment")
def silo_assignment(spark, sf):
    return op.assign(lots(spark, sf), silos(spark, sf)).select("id_lote", "id_silo", "peso_neto", "estado")


@query("assignment_saving")
def assignment_saving(spark, sf):
    a, s = lots(spark, sf), silos(spark, sf)
    return rounded(op.saving(a, s, op.assign(a, s)))


@query("silo_loads")
def silo_loads(spark, sf):
    return rounded(op.loads(op.assign(lots(spark, sf), silos(spark, sf))))
