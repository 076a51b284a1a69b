"""Lots to silos under capacity, minimising the expected shrink.

The cost of a lot in a silo is (shrink rate x weight) x silo factor, so the cheapest plan sends the
lots with the highest rate to the silos with the lowest factor.  Both sides are laid out on one axis
of tons; a lot belongs to the silo whose stretch holds it.  No lot-silo pair table is formed.  The few
lots cut by a stretch border are placed afterwards where they fit; a lot that fits nowhere is reported.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veta.functions.columns import clip, ratio, shrink_rate
from veta.operators.sequence import framed, positions, running
from veta.session import materialise


def recent_lots(receipts: DataFrame, days: int, start: str, end: str, low: float = 1, high: float = 200) -> DataFrame:
    """Receipts of the last days before the latest date inside the sane window."""
    a, b = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    sane = receipts.filter(F.col("fecha_hora").between(a, b))
    last = sane.agg(F.max("fecha_hora").alias("m")).first()["m"]
    since = F.lit(last).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAY")
    return sane.filter((F.col("fecha_hora") >= since) & F.col("peso_neto").between(low, high))


def silo_factors(silos: DataFrame, inventory: DataFrame) -> DataFrame:
    """Free capacity and shrink factor: +20 % without temperature control, +10 % when over 90 % full."""
    stock = inventory.groupBy("id_silo").agg(F.sum("stock_tn").alias("stock_tn"))
    d = silos.join(stock, "id_silo", "left").withColumn("stock_tn", F.coalesce("stock_tn", F.lit(0.0)))
    fill = F.coalesce(clip(ratio("stock_tn", "capacidad_tn"), 0, 1), F.lit(0.0))
    bare = F.when(F.coalesce("temperatura_control", F.lit(False)), 0.0).otherwise(0.2)
    return (d.withColumns({"libre_tn": clip("capacidad_tn", 0), "lleno": fill})
            .withColumn("factor", 1.0 + bare + F.when(F.col("lleno") > 0.9, 0.1).otherwise(0.0))
            .filter("libre_tn > 0").select("id_silo", "libre_tn", "lleno", "factor"))


def lot_costs(receipts: DataFrame) -> DataFrame:
    """Lots with shrink rate and base shrink; rows with missing readings are left out."""
    return (receipts.dropna(subset=["peso_neto", "humedad_pct", "impurezas_pct"])
            .withColumn("tasa", shrink_rate("humedad_pct", "impurezas_pct"))
            .withColumn("base", F.col("peso_neto") * F.col("tasa")))


def stretches(lots: DataFrame, silos: DataFrame, lot_id: str) -> tuple[DataFrame, DataFrame]:
    """Both sides on the axis of tons: (lot_id, start, end, rate) and (id_silo, start, end, factor)."""
    a = running(lots.select(lot_id, "peso_neto", "tasa"), [], [F.col("tasa").desc(), lot_id], {"fin": F.col("peso_neto")})
    b = running(silos, [], ["factor", "id_silo"], {"fin": F.col("libre_tn")})
    return (a.select(lot_id, (F.col("fin") - F.col("peso_neto")).alias("ini"), "fin", "tasa", "peso_neto"),
            b.select("id_silo", (F.col("fin") - F.col("libre_tn")).alias("ini"), "fin", "factor", "libre_tn"))


def segments(lots: DataFrame, silos: DataFrame, lot_id: str) -> DataFrame:
    """The axis cut at every lot start and silo start: which lot and silo hold each piece, and its cost."""
    a, b = stretches(lots, silos, lot_id)
    lot = F.struct(F.col("ini"), F.col("fin"), F.col("tasa"), F.col(lot_id).cast("string").alias("id"))
    silo = F.struct(F.col("ini"), F.col("fin"), F.col("factor"), F.col("id_silo").alias("id"))
    marks = (a.select(F.col("ini").alias("en"), F.lit(1).alias("lado"), F.col(lot_id).cast("string").alias("clave"),
                      lot.alias("lote"), F.lit(None).cast(b.select(silo.alias("x")).schema["x"].dataType).alias("silo"))
             .unionByName(b.select(F.col("ini").alias("en"), F.lit(0).alias("lado"), F.col("id_silo").cast("string").alias("clave"),
                                   F.lit(None).cast(a.select(lot.alias("x")).schema["x"].dataType).alias("lote"), silo.alias("silo"))))
    order = ["en", "lado", "clave"]
    held = materialise(running(marks, [], order, {"_l": F.col("lote"), "_s": F.col("silo")}, kind="max"))
    nxt = framed(held, [], order, [lambda w: {"_n": F.lead("en").over(w)}], after=1)
    end = F.least(F.coalesce("_n", F.lit(float("inf"))), F.col("_l.fin"), F.col("_s.fin"))
    d = nxt.withColumn("tn", F.greatest(end - F.col("en"), F.lit(0.0)))
    return d.select("lado", "clave", "en", F.col("_l.id").alias("lote"), F.col("_l.fin").alias("lote_fin"), F.col("_s.id").alias("id_silo"),
                    F.col("_s.fin").alias("silo_fin"), "tn", (F.col("tn") * F.col("_l.tasa") * F.col("_s.factor")).alias("merma"))


def lower_bound(lots: DataFrame, silos: DataFrame, lot_id: str = "id_lote") -> DataFrame:
    """Cheapest possible shrink if lots could be split (no plan can be better), and the tons it places."""
    return segments(lots, silos, lot_id).agg(F.sum("merma").alias("cota"), F.sum(F.when(F.col("lote").isNotNull(), F.col("tn"))).alias("tn"))


def assign(lots: DataFrame, silos: DataFrame, lot_id: str = "id_lote", eps: float = 1e-9) -> DataFrame:
    """One row per lot with its silo (null and ``SIN_ESPACIO`` if none can take it)."""
    lots, silos = materialise(lots), materialise(silos)
    whole = segments(lots, silos, lot_id).filter((F.col("lado") == 1) & (F.col("lote_fin") <= F.col("silo_fin") + eps))
    placed = materialise(lots.select(lot_id, "peso_neto", "base").join(whole.select(F.col("clave").alias("_k"), "id_silo"), F.col(lot_id).cast("string") == F.col("_k"), "left")
                         .select(lot_id, "peso_neto", "base", "id_silo"))
    # At most one lot per silo border is left over.  Each round pairs the heaviest with the roomiest; a round
    # either places the heaviest lot or proves that it fits nowhere, so the loop ends.
    done, rest = placed.filter("id_silo is not null"), placed.filter("id_silo is null")
    lost = None
    while not rest.isEmpty():
        load = done.groupBy("id_silo").agg(F.sum("peso_neto").alias("_load"))
        room = silos.join(load, "id_silo", "left").select("id_silo", (F.col("libre_tn") - F.coalesce("_load", F.lit(0.0))).alias("_room"))
        ranked = positions(rest.drop("id_silo"), [], [F.col("peso_neto").desc(), lot_id], "_pos")
        spots = positions(room.filter(F.col("_room") > 0), [], [F.col("_room").desc(), "id_silo"], "_pos")
        tried = materialise(ranked.join(spots, "_pos", "left")
                            .withColumn("id_silo", F.when(F.col("peso_neto") <= F.col("_room") + eps, F.col("id_silo"))))
        cols = [lot_id, "peso_neto", "base", "id_silo"]
        stuck = tried.filter((F.col("_pos") == 1) & F.col("id_silo").isNull()).select(*cols)
        lost = stuck if lost is None else lost.unionByName(stuck)
        done = materialise(done.unionByName(tried.filter("id_silo is not null").select(*cols)))
        rest = materialise(tried.filter((F.col("_pos") > 1) & F.col("id_silo").isNull()).select(*cols))
    out = done if lost is None else done.unionByName(lost)
    return out.withColumn("estado", F.when(F.col("id_silo").isNull(), "SIN_ESPACIO").otherwise("ASIGNADO"))


def saving(lots: DataFrame, silos: DataFrame, plan: DataFrame, lot_id: str = "id_lote", real: str = "id_silo") -> DataFrame:
    """Shrink of the actual silos (unknown silo: factor 1) against the plan and the lower bound."""
    factor = silos.select("id_silo", "factor")
    base = (lots.join(factor.withColumnRenamed("id_silo", "_s"), F.col(real) == F.col("_s"), "left")
            .agg(F.sum(F.col("base") * F.coalesce("factor", F.lit(1.0))).alias("merma_real")).first()["merma_real"])
    opt = plan.join(factor, "id_silo", "left").agg(F.sum(F.col("base") * F.col("factor")).alias("merma_plan"),
                                                   F.count_if(F.col("id_silo").isNull()).alias("sin_espacio"), F.count(F.lit(1)).alias("lotes"))
    bound = lower_bound(lots, silos, lot_id).first()["cota"]
    out = opt.withColumns({"merma_real": F.lit(base), "cota": F.lit(bound)})
    return out.withColumns({"ahorro_pct": (1 - F.col("merma_plan") / F.greatest("merma_real", F.lit(1.0))) * 100,
                            "brecha_pct": (F.col("merma_plan") / F.nullif("cota", F.lit(0.0)) - 1) * 100})


def loads(plan: DataFrame, top: int = 5) -> DataFrame:
    return (plan.filter("id_silo is not null").groupBy("id_silo").agg(F.sum("peso_neto").alias("carga_tn"), F.count(F.lit(1)).alias("lotes"))
            .orderBy(F.desc("carga_tn"), "id_silo").limit(top))
