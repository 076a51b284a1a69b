"""Weigh-in risk: signals per receipt, a 0-100 score, a typology and percentile severities.

Statistics of a silo-month, a producer or a remission number are aggregated first and joined back, so
that no task has to hold all rows of one key; running contract totals use ``sequence.running``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veta.functions.columns import (BENFORD, chi2_tail_even, clip, decimal_hour, first_digit, flag, is_sunday,
                                    month_text, name_of_largest, ratio, tidy)
from veta.operators.sequence import attach, crowded, medians, quantiles, running
from veta.session import materialise

# Weights of the score; they add up to 110 and are scaled back to 100.
WEIGHTS = {"s_benford": 15, "s_iso": 25, "s_rend": 15, "s_contrato": 10, "s_lab": 5, "s_hora": 10, "s_fisica": 15,
           "s_peso": 5, "s_doc": 10}
# Yield ceiling in tons per hectare, scale of the median deviation, z ceiling.
YIELD_CEILING, MAD_SCALE, Z_TOP = 8.0, 1.4826, 6.0
SEVERITIES = ("bajo", "medio", "alto", "critico")
STRATUM = ("id_silo", "mes")
SPREAD, SALTS = "_spread", 1 << 14
# Most keys that are sent to all rows.
FEW = 200_000


def enrich(receipts: DataFrame, contracts: DataFrame, assignments: DataFrame, controls: DataFrame, keep: bool = False) -> DataFrame:
    """Receipts with their contract and the number of lab analyses (0 if none); ``keep`` leaves ``SPREAD`` for the running totals.

    The analyses are counted per lot and then per receipt before the join, so no pair of assignment
    and analysis is ever formed.
    """
    per_lot = controls.groupBy("id_lote").agg(F.count(F.lit(1)).alias("_k"))
    lab = assignments.join(per_lot, "id_lote").groupBy("id_recepcion").agg(F.sum("_k").alias("n_lab"))
    # The contract last: running totals of contracts find the rows where they need them.
    rich = with_contract(receipts.join(lab, "id_recepcion", "left"), contracts)
    names = [c for d in (receipts, contracts) for c in d.columns if c not in ("id_recepcion", "id_contrato")]
    return rich.select("id_recepcion", *names[:receipts.columns.index("id_contrato") - 1], "id_contrato", *names[receipts.columns.index("id_contrato") - 1:],
                       F.coalesce("n_lab", F.lit(0).cast("long")).alias("n_lab"), *([SPREAD] if keep else []))


def with_contract(receipts: DataFrame, contracts: DataFrame) -> DataFrame:
    """Receipts with the columns of their contract, and the contract as text in ``SPREAD``."""
    by = contracts.withColumn(SPREAD, F.col("id_contrato").cast("string")).drop("id_contrato")
    return spread(receipts, "id_contrato", "id_recepcion").join(by, SPREAD, "left")


def spread(df: DataFrame, key: str, row: str, name: str = SPREAD) -> DataFrame:
    """The key as text in ``name``, with missing keys dealt over many made-up ones, so that they do not meet in one task."""
    salt = F.concat(F.lit("none "), F.pmod(F.xxhash64(row), F.lit(SALTS)).cast("string"))
    return df.withColumn(name, F.coalesce(F.col(key).cast("string"), salt))


def basics(receipts: DataFrame) -> DataFrame:
    """Net weight, tare share, hour and calendar flags."""
    hour = decimal_hour("fecha_hora")
    year = F.year("fecha_hora")
    return receipts.withColumns({
        "peso_neto": F.col("peso_bruto_tn") - F.col("tara_tn"),
        "tara_ratio": ratio("tara_tn", "peso_bruto_tn"),
        "hora_dec": hour,
        "mes": month_text("fecha_hora"),
        "es_madrugada": flag((hour < 5) | (hour > 23)),
        "es_domingo": flag(is_sunday("fecha_hora")),
        "s_date": flag((year < 2000) | (year > 2027)) * 0.6,
    })


def copies_of(receipts: DataFrame, contracts: DataFrame, key: str = "numero_remision") -> DataFrame:
    """(key, _copies) of the keys that more than one row has once the receipts have met their contracts."""
    met = receipts.join(contracts.select("id_contrato"), "id_contrato", "left")
    return met.groupBy(key).agg(F.count(F.lit(1)).alias("_copies")).filter("_copies > 1")


def duplicate_flag(df: DataFrame, key: str = "numero_remision", name: str = "dup_remision") -> DataFrame:
    """1 for every row whose key occurs more than once; missing keys count as equal to each other."""
    return repeated(df, df.groupBy(key).agg(F.count(F.lit(1)).alias("_copies")).filter("_copies > 1"), key, name)


def repeated(df: DataFrame, copies: DataFrame, key: str, name: str) -> DataFrame:
    """The flag from the keys that occur more than once; few such keys are sent to the rows."""
    copies = materialise(copies)
    copies = F.broadcast(copies) if copies.count() <= FEW else copies
    return attach(df, copies, [key]).withColumn(name, flag(F.col("_copies").isNotNull())).drop("_copies")


def robust_z(df: DataFrame, keys: Sequence[str], columns: Sequence[str], prefix: str = "z_",
             crowd: bool | None = None) -> DataFrame:
    """|x - median| / (1.4826 * median deviation) within the group; 0 where undefined (also for null keys)."""
    crowd = crowded(df, keys) if crowd is None else crowd
    if not crowd:
        # Both medians, and whatever else looks at the group, in one shuffle of the rows.
        w = Window.partitionBy(*keys)
        known = F.lit(True)
        for k in keys:
            known = known & F.col(k).isNotNull()
        half = lambda c: F.percentile(c.cast("double"), F.lit(0.5)).over(w)
        d = df.withColumns({f"_med_{c}": half(F.col(c)) for c in columns})
        d = d.withColumns({f"_dev_{c}": F.abs(F.col(c) - F.col(f"_med_{c}")) for c in columns})
        d = d.withColumns({f"_mad_{c}": half(F.col(f"_dev_{c}")) for c in columns})
        z = {prefix + c: F.coalesce(F.when(known, F.col(f"_dev_{c}") / (MAD_SCALE * (F.col(f"_mad_{c}") + 1e-9))), F.lit(0.0)) for c in columns}
        return d.withColumns(z).drop(*[f"{m}{c}" for m in ("_med_", "_dev_", "_mad_") for c in columns])
    med = medians(df, columns, keys, "_med_", crowd=crowd)
    dev = attach(df, med, keys).withColumns({f"_dev_{c}": F.abs(F.col(c) - F.col(f"_med_{c}")) for c in columns})
    mad = medians(dev, [f"_dev_{c}" for c in columns], keys, "_mad", crowd=crowd)
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    z = {prefix + c: F.coalesce(F.when(known, F.col(f"_dev_{c}") / (MAD_SCALE * (F.col(f"_mad_dev_{c}") + 1e-9))),
                                F.lit(0.0)) for c in columns}
    out = attach(dev, mad, keys).withColumns(z)
    return out.drop(*[f"_med_{c}" for c in columns], *[f"_dev_{c}" for c in columns], *[f"_mad_dev_{c}" for c in columns])


def benford(df: DataFrame, keys: Sequence[str], value: str = "peso_neto") -> DataFrame:
    """Chi-square distance of the first digits from Benford's law per group.

    n counts the rows that have a digit.  ``senal`` is -log10(p), at most 6, scaled to 0..1.
    """
    d = first_digit(value)
    seen = df.groupBy(*keys).agg(F.count(d).alias("n"), *[F.count_if(d == k).alias(f"_c{k}") for k in BENFORD])
    return digit_distance(seen.filter("n > 0")).select(*keys, "n", "chi2", "p", "senal")


def digit_distance(seen: DataFrame) -> DataFrame:
    """chi2, p and senal from the counts of the digits in _c1, _c2, ... and their sum n; without digits there is no chi2."""
    n = F.nullif(F.col("n"), F.lit(0))
    chi = sum((F.pow(F.col(f"_c{k}") - n * b, 2) / (n * b) for k, b in BENFORD.items()), F.lit(0.0))
    return (seen.withColumn("chi2", chi).withColumn("p", chi2_tail_even("chi2", 8))
            .withColumn("senal", F.least(-F.log10(F.greatest("p", F.lit(1e-12))), F.lit(6.0)) / 6.0))


def benford_signal(df: DataFrame, keys: Sequence[str], crowd: bool, value: str = "peso_neto") -> DataFrame:
    """``s_benford`` of the row's group; groups that are not crowded are counted where their rows lie."""
    if crowd:
        digits = benford(df, keys, value).select(*keys, F.col("senal").alias("s_benford"))
        return attach(df, digits, keys).withColumn("s_benford", F.coalesce("s_benford", F.lit(0.0)))
    w, names = Window.partitionBy(*keys), df.columns
    d = df.withColumn("_digit", first_digit(value))
    d = d.withColumns({"n": F.count("_digit").over(w)} | {f"_c{k}": F.count(F.when(F.col("_digit") == k, 1)).over(w) for k in BENFORD})
    return digit_distance(d).select(*names, F.when(F.col("n") > 0, F.col("senal")).otherwise(0.0).alias("s_benford"))


def rare_digit_signal(df: DataFrame, value: str = "peso_neto") -> DataFrame:
    """Simpler digit signal: gap between the global share of the row's digit and Benford's law."""
    shares = df.select(first_digit(value).alias("_d")).filter("_d is not null").groupBy("_d").agg(F.count(F.lit(1)).alias("_n"))
    total = F.lit(float(max(df.filter(first_digit(value).isNotNull()).count(), 1)))
    law = F.element_at(F.array(*[F.lit(b) for b in BENFORD.values()]), F.col("_d"))
    gap = shares.select("_d", F.abs(F.col("_n") / total - law).alias("_gap"))
    return (df.withColumn("_d", first_digit(value)).join(gap, "_d", "left")
            .withColumn("s_digito", clip(F.coalesce("_gap", F.lit(0.0)), 0, 0.5) * 2).drop("_d", "_gap"))


def deliveries_of(receipts: DataFrame, contracts: DataFrame) -> DataFrame:
    """Producer and net weight of what was delivered on each contract, added up before the contracts are met."""
    volume = receipts.filter("id_contrato is not null").groupBy("id_contrato").agg(F.sum("peso_neto").alias("peso_neto"))
    return volume.join(contracts.select("id_contrato", "id_productor"), "id_contrato")


def yield_signal(df: DataFrame, plots: DataFrame, producer: str = "id_productor", deliveries: DataFrame | None = None, row: str = "id_recepcion") -> DataFrame:
    """Delivered tons per hectare against the ceiling, 0..1; 0 for unknown area or producer.

    ``deliveries`` are the same receipts by a shorter plan (producer and net weight).  With them ``df`` may be the contracts,
    ``row`` their id, so that the few contracts meet their producers and not the many receipts.
    """
    area = plots.groupBy(producer).agg(F.sum("superficie_ha").alias("_ha"))
    volume = (df if deliveries is None else deliveries).filter(F.col(producer).isNotNull()).groupBy(producer).agg(F.sum("peso_neto").alias("_vol"))
    s = volume.join(area, producer).select(producer, clip(ratio("_vol", "_ha") / YIELD_CEILING, 0, 1).alias("s_rend"))
    # Receipts without producer are dealt over many tasks.
    by = s.select(F.col(producer).cast("string").alias("_producer"), "s_rend")
    held = spread(df, producer, row, "_producer").join(by, "_producer", "left").drop("_producer")
    rest = [c for c in df.columns if c != producer]
    return held.select(producer, *rest, F.coalesce("s_rend", F.lit(0.0)).alias("s_rend"))


def contract_signal(df: DataFrame, order: Sequence[str], sampled: bool = False,
                    crowd: bool | None = None) -> DataFrame:
    """Running delivery above the committed volume, plus a fixed part for receipts without contract.

    Receipts without contract have no running total; in one pass with the others, they are spread over many tasks.
    """
    none = F.col("id_contrato").isNull()
    if sampled:
        return df.withColumn("s_contrato", flag(none) * 0.2)
    held = running(df if SPREAD in df.columns else spread(df, "id_contrato", order[-1]), [SPREAD], order, {"acumulado": F.col("peso_neto")}, crowd=crowd).drop(SPREAD)
    held = held.withColumn("acumulado", F.when(~none, F.col("acumulado")))
    over = F.coalesce(clip(ratio("acumulado", "volumen_comprometido_tn") - 1, 0, 1), F.lit(0.0))
    loose = F.when(F.col("peso_neto") > 50, 0.3).when(F.col("peso_neto") <= 50, 0.1).otherwise(0.0)
    return held.withColumn("s_contrato", F.when(none, loose).otherwise(over))


def document_signals(df: DataFrame) -> DataFrame:
    """Duplicate remission, missing lab analysis and odd hours."""
    return df.withColumns({
        "s_dup": F.col("dup_remision") * 0.6,
        "s_lab": flag(F.col("n_lab") == 0) * 0.4,
        "s_hora": clip(F.col("es_madrugada") * 0.7 + F.col("es_domingo") * 0.3, 0, 1),
    })


def signals(receipts: DataFrame, plots: DataFrame, order: Sequence[str], source: DataFrame | None = None, contracts: DataFrame | None = None) -> DataFrame:
    """All signals except the isolation score.  ``receipts`` comes from ``enrich``; ``dup_remision`` and ``s_rend`` may be in it already.

    ``source`` and ``contracts`` are what it was made of: sizes of groups, copies and volumes are found there, by a shorter plan.
    """
    d = basics(receipts)
    plain = basics(source) if source is not None else d
    hot_stratum = crowded(plain, STRATUM)
    hot_contract = crowded(plain.filter("id_contrato is not null"), ["id_contrato"])
    if "dup_remision" not in d.columns:
        key = "numero_remision"
        copies = receipts.groupBy(key).agg(F.count(F.lit(1)).alias("_copies")).filter("_copies > 1") if contracts is None or source is None else copies_of(source, contracts, key)
        d = repeated(d, copies, key, "dup_remision")
    # What follows from the row alone comes last, so that it does not travel.
    d = d.drop("tara_ratio", "hora_dec", "es_madrugada", "es_domingo", "s_date")
    d = contract_signal(d, order, crowd=hot_contract)
    d = robust_z(d, STRATUM, ["humedad_pct", "impurezas_pct", "peso_neto"], crowd=hot_stratum)
    d = benford_signal(d, STRATUM, hot_stratum)
    if "s_rend" in d.columns:
        d = d.withColumn("s_rend", F.coalesce("s_rend", F.lit(0.0)))
    else:
        d = yield_signal(d, plots, deliveries=None if contracts is None or source is None else deliveries_of(plain, contracts))
    d = basics(d)
    return document_signals(d).withColumns({
        "s_fisica": F.least(F.greatest("z_humedad_pct", "z_impurezas_pct"), F.lit(Z_TOP)) / Z_TOP,
        "s_peso": F.least(F.col("z_peso_neto"), F.lit(Z_TOP)) / Z_TOP,
    }).withColumn("s_doc", F.greatest("s_contrato", "s_dup", "s_date"))


def hard_rules() -> tuple[Column, Column]:
    """(documental, physical): receipts that score 100 whatever their signals say."""
    doc = (F.col("dup_remision") == 1) & (F.col("s_date") > 0) & F.col("id_contrato").isNull()
    physical = (F.col("peso_neto") <= 0) | (F.col("tara_tn") > F.col("peso_bruto_tn")) | (F.col("peso_neto") > 200)
    return F.coalesce(doc, F.lit(False)), F.coalesce(physical, F.lit(False))


def score(df: DataFrame) -> DataFrame:
    """Weighted score 0-100 to one decimal and the main typology."""
    if "s_iso" not in df.columns:
        df = df.withColumn("s_iso", F.lit(0.0))
    doc, physical = hard_rules()
    total = sum((F.col(s) * w for s, w in WEIGHTS.items()), F.lit(0.0)) / 1.1
    family = name_of_largest({
        "FISICA": F.col("s_fisica"), "DOCUMENTAL": F.col("s_doc"), "RENDIMIENTO": F.col("s_rend"),
        "ESTADISTICA": F.greatest("s_benford", "s_iso"), "HORARIO": F.col("s_hora")})
    return df.withColumns({
        "score": F.when(doc | physical, 100.0).otherwise(tidy(clip(total, 0, 100), 1)),
        "tipologia": F.when(physical, "FISICA").when(doc, "DOCUMENTAL").otherwise(family),
    })


def severity(df: DataFrame, value: str = "score", name: str = "severidad") -> DataFrame:
    """Percentile classes: above the 99th critical, above the 90th high, above the median medium.

    Reads ``df`` twice; hand in a materialised frame if it is expensive.
    """
    cut = quantiles(df, value, {"q50": 0.5, "q90": 0.9, "q99": 0.99}).first()
    if cut is None:
        return df.withColumn(name, F.lit(None).cast("string"))
    x = F.col(value)
    return df.withColumn(name, F.when(x > cut["q99"], "critico").when(x > cut["q90"], "alto")
                         .when(x > cut["q50"], "medio").when(x.isNotNull(), "bajo"))


def alerts(df: DataFrame, top: int, ties: Sequence[str]) -> DataFrame:
    return df.orderBy(F.desc("score"), *ties).limit(top)
