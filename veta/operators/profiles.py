"""Per-producer profiles, contract compliance and client margins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veta.functions.columns import IMPURITY_FREE, MOISTURE_FREE, clip, flag, month_text, ratio

# Features of the producer segmentation, in the order of the profile.
PROFILE_FEATURES = ("n_recepciones", "volumen_total_tn", "ticket_medio_tn", "merma_total_tn", "humedad_media",
                    "humedad_std", "humedad_max", "pct_hum_crit", "impurezas_media", "impurezas_std",
                    "impurezas_max", "pct_imp_crit", "proteina_media", "aceite_media", "pct_descuento",
                    "max_merma_evento")
SEGMENT_360_FEATURES = ("n", "vol", "cumplimiento", "p_crit", "hum_std", "n_silos", "n_meses", "p_noct")


def with_shrink(receipts: DataFrame) -> DataFrame:
    """Shrink in tons, by moisture and by impurities; null readings give null."""
    w = F.col("peso_neto")
    return receipts.withColumns({
        "merma_humedad_tn": w * clip(F.col("humedad_pct") / 100 - MOISTURE_FREE, 0),
        "merma_impureza_tn": w * clip(F.col("impurezas_pct") / 100 - IMPURITY_FREE, 0),
    })


def share(condition: Column) -> Column:
    """Share of rows where the condition holds; unknown counts as no."""
    return F.avg(flag(condition))


def producer_profile(fact: DataFrame, producers: DataFrame) -> DataFrame:
    """Volume, shrink and quality dispersion of every producer.

    ``fact`` has one row per receipt with ``id_productor``.  It is aggregated before the producer's
    attributes are joined, so that the join moves one row per producer.
    """
    loss = F.coalesce("merma_humedad_tn", F.lit(0.0)) + F.coalesce("merma_impureza_tn", F.lit(0.0))
    stats = fact.groupBy("id_productor").agg(
        F.count(F.lit(1)).alias("n_recepciones"), F.sum("peso_neto").alias("volumen_total_tn"),
        F.avg("peso_neto").alias("ticket_medio_tn"), F.sum(loss).alias("merma_total_tn"),
        F.avg("humedad_pct").alias("humedad_media"), F.stddev_samp("humedad_pct").alias("humedad_std"),
        F.max("humedad_pct").alias("humedad_max"), share(F.col("humedad_pct") > 14).alias("pct_hum_crit"),
        F.avg("impurezas_pct").alias("impurezas_media"), F.stddev_samp("impurezas_pct").alias("impurezas_std"),
        F.max("impurezas_pct").alias("impurezas_max"), share(F.col("impurezas_pct") > 1).alias("pct_imp_crit"),
        F.avg("proteina_pct").alias("proteina_media"), F.avg("aceite_pct").alias("aceite_media"),
        share(F.col("calidad_grano") == "DESCUENTO").alias("pct_descuento"), F.max(loss).alias("max_merma_evento"),
        F.count_distinct("id_silo").alias("n_silos"),
    )
    return producers.join(stats, "id_productor")


def producer_360(receipts: DataFrame, contracts: DataFrame, producers: DataFrame, start: str, end: str) -> DataFrame:
    """Behaviour of every producer with contracts: volume, moisture, months and silos used, night share."""
    w = F.col("peso_neto")
    hour = F.hour("fecha_hora")
    night = hour.between(22, 23) | hour.between(0, 5)
    rows = (receipts.filter(w.between(1, 200) & F.col("fecha_hora").between(F.lit(start).cast("timestamp_ntz"),
                                                                            F.lit(end).cast("timestamp_ntz")))
            .join(contracts.select("id_contrato", "id_productor"), "id_contrato"))
    stats = rows.groupBy("id_productor").agg(
        F.count(F.lit(1)).alias("n"), F.sum(w).alias("vol"), share(F.col("humedad_pct") > 14).alias("p_crit"),
        F.stddev_samp("humedad_pct").alias("hum_std"), F.max("humedad_pct").alias("hum_max"),
        F.count_distinct("id_silo").alias("n_silos"), F.count_distinct(month_text("fecha_hora")).alias("n_meses"),
        F.max(month_text("fecha_hora")).alias("ultimo_mes"), share(night).alias("p_noct"),
        ratio(F.sum(w * w), F.sum(w)).alias("ticket_pond"),
    )
    return producers.select("id_productor", "tipo_productor").join(stats, "id_productor")


def committed_volume(contracts: DataFrame) -> DataFrame:
    """Committed tons per producer; repeated contract rows count once."""
    return (contracts.select("id_contrato", "id_productor", "volumen_comprometido_tn").distinct()
            .groupBy("id_productor").agg(F.sum("volumen_comprometido_tn").alias("comp")))


def contract_compliance(profile: DataFrame, contracts: DataFrame) -> DataFrame:
    """Delivered against committed volume, and the share of the volume under contract."""
    return (profile.join(committed_volume(contracts), "id_productor", "left")
            .withColumns({"cumplimiento": ratio("vol", "comp"), "pct_cubierto": clip(ratio("comp", "vol"), 0, 1)}))


def offenders(compliance: DataFrame, below: float = 0.5, above: float = 2.0, min_volume: float = 1000.0,
              top: int = 10) -> DataFrame:
    """The worst defaulters (little delivered on a large volume) and over-deliverers."""
    cols = ["id_productor", "tipo_productor", "vol", "comp", "cumplimiento"]
    low = (compliance.filter((F.col("cumplimiento") < below) & (F.col("vol") > min_volume))
           .orderBy("cumplimiento", "id_productor").limit(top).select(F.lit("INCUMPLIDO").alias("lista"), *cols))
    high = (compliance.filter(F.col("cumplimiento") > above)
            .orderBy(F.desc("cumplimiento"), "id_productor").limit(top)
            .select(F.lit("FANTASMA").alias("lista"), *cols))
    return low.unionByName(high)


def basis_by_segment(sales: DataFrame, clients: DataFrame) -> DataFrame:
    """Mean, spread and count of the basis per client segment."""
    return (sales.join(clients, "id_cliente", "left").groupBy("segmento")
            .agg(F.avg("prima_basis_usd").alias("media"), F.stddev_samp("prima_basis_usd").alias("desv"),
                 F.count("prima_basis_usd").alias("n")))
