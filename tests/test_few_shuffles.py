import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from veta.operators import clusters, splits, summary, weighing
from veta.plans import weighing as front


def plan(d):
    return d._jdf.queryExecution().executedPlan().toString()


def test_silhouette_meets_each_pair_of_blocks_once(spark):
    rng = np.random.default_rng(2)
    x, g = rng.normal(size=(90, 2)), np.arange(90) % 3
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = []
    for i in range(90):
        by = [d[i, g == k].sum() / ((g == k).sum() - (k == g[i])) for k in range(3)]
        a, b = by[g[i]], min(by[k] for k in range(3) if k != g[i])
        want.append((b - a) / max(a, b))
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(id=np.arange(90), g=g, one=0))
    for size, most in ((4, 10), (90, 90)):
        got = {r.etiqueta: r for r in clusters.silhouette(df, ["a", "b"], ["g", "one"], ["id"], size=size, most=most).collect()}
        assert np.isclose(got["g"].silueta, np.mean(want)) and got["g"].puntos == 90 and got["g"].k == 3
        assert got["one"].silueta == 0.0


def receipts(spark):
    rng = np.random.default_rng(4)
    n = 300
    pdf = pd.DataFrame({"id_recepcion": np.arange(n), "fecha_hora": [dt.datetime(2020, 1 + int(m), 5, 6) for m in rng.integers(0, 3, n)], "id_silo": rng.integers(0, 3, n),
                        "id_contrato": [None if i % 7 == 0 else int(i % 20) for i in range(n)], "peso_bruto_tn": rng.integers(20, 60, n) + 0.5, "tara_tn": 12.0,
                        "peso_neto": 1.0, "humedad_pct": rng.integers(10, 20, n) * 1.0, "impurezas_pct": rng.integers(0, 4, n) * 0.5,
                        "numero_remision": [f"r{i // 2 if i < 20 else i}" for i in range(n)], "id_parte": np.arange(n), "valor_usd": rng.random(n)})
    return spark.createDataFrame(pdf.astype({"id_contrato": object}), "id_recepcion long, fecha_hora timestamp_ntz, id_silo long, id_contrato long, peso_bruto_tn double, tara_tn double, "
                                 "peso_neto double, humedad_pct double, impurezas_pct double, numero_remision string, id_parte long, valor_usd double"), pdf


def test_signals_shuffle_the_receipts_once_a_key(spark):
    d, pdf = receipts(spark)
    contracts = spark.createDataFrame([(i, i % 5, 100.0) for i in range(20)], "id_contrato long, id_productor long, volumen_comprometido_tn double")
    labs = spark.createDataFrame([(i, i % 9) for i in range(0, 300, 2)], "id_recepcion long, id_lote long")
    rich = weighing.enrich(d, contracts, labs, spark.range(5).toDF("id_lote"), keep=True)
    plots = spark.createDataFrame([(i, 10.0) for i in range(4)], "id_productor long, superficie_ha double")
    order = ["fecha_hora", "id_recepcion", "id_parte", "id_silo", "peso_neto", "valor_usd"]
    s = weighing.signals(rich, plots, order, d, contracts)
    got = s.toPandas().set_index("id_recepcion").sort_index()
    assert len(got) == 300 and (got.dup_remision.to_numpy() == (np.arange(300) < 20)).all()
    assert (got.n_lab.to_numpy() == np.array([int(i % 2 == 0 and i % 9 < 5) for i in range(300)])).all()
    p = pdf.assign(w=pdf.peso_bruto_tn - 12, mes=[f.month for f in pdf.fecha_hora])
    dev = (p.humedad_pct - p.groupby(["id_silo", "mes"]).humedad_pct.transform("median")).abs()
    z = dev / (1.4826 * (dev.groupby([p.id_silo, p.mes]).transform("median") + 1e-9))
    assert np.allclose(got.z_humedad_pct, z)
    held = p[p.id_contrato.notna()].sort_values(["fecha_hora", "id_recepcion"])
    assert np.allclose(got.acumulado.dropna(), held.assign(s=held.groupby("id_contrato").w.cumsum()).set_index("id_recepcion").sort_index().s)
    ha = {0: 10.0, 1: 10.0, 2: 10.0, 3: 10.0}
    vol = held.groupby(held.id_contrato % 5).w.sum()
    want = [0.0 if c is None or c % 5 not in ha else min(vol[c % 5] / 10 / 8, 1) for c in pdf.id_contrato]
    assert np.allclose(got.s_rend, want)
    # One window over the stratum serves medians, deviations and digits: no sorted lists, no join back.
    assert "collect_list" not in plan(s)


def test_receipts_move_once_for_contracts_and_not_for_producers(spark, monkeypatch):
    d, _ = receipts(spark)
    contracts = spark.createDataFrame([(i, i % 5 if i % 6 else None, 100.0) for i in [*range(19), 3]], "id_contrato long, id_productor long, volumen_comprometido_tn double")
    made = {"receipts": d, "contracts": contracts, "plots": spark.createDataFrame([(i, 10.0 * i) for i in range(4)], "id_productor long, superficie_ha double"),
            "lab_assignments": spark.createDataFrame([(i, i % 9) for i in range(0, 300, 2)], "id_recepcion long, id_lote long"), "lab_controls": spark.range(5).toDF("id_lote")}
    for name, frame in made.items():
        monkeypatch.setattr(front.roles, name, lambda spark, sf, frame=frame: frame)
    rich = weighing.enrich(d.select(*front.READ), contracts, made["lab_assignments"], made["lab_controls"], keep=True)
    want = weighing.score(weighing.signals(rich, made["plots"], front.ORDER))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(weighing, "FEW", 0)
    try:
        found = front.scored(spark, "")
        shown = ["id_recepcion", "s_rend", "s_contrato", "dup_remision", "n_lab", "s_hora", "s_date", "score", "tipologia"]
        assert sorted(found.select(*shown).collect()) == sorted(want.select(*shown).collect())
        text = plan(found)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rows = text[:text.index("Window")]
    assert "Exchange" not in rows and text.count("Exchange hashpartitioning(_spread") == 2


def test_digits_of_a_group_without_weights_say_nothing(spark):
    d = spark.createDataFrame([("a", None), ("a", None), ("b", 1.0), (None, 2.0)], "g string, peso_neto double")
    plain = {r.g: r.s_benford for r in weighing.benford_signal(d, ["g"], False).collect()}
    assert plain["a"] == 0.0 and plain["b"] > 0 and plain == {r.g: r.s_benford for r in weighing.benford_signal(d, ["g"], True).collect()}


def test_stratified_orders_a_large_class_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(splits, "STRATUM_ROWS", 50)
    d = spark.range(400).withColumn("y", (F.col("id") % 10 > 0).cast("int"))
    got = splits.stratified(d, "y", ["id"], {"train": 0.7, "validation": 0.15, "test": 0.15})
    n = {(r.y, r.split): r["count"] for r in got.groupBy("y", "split").count().collect()}
    assert n == {(0, "train"): 28, (0, "validation"): 6, (0, "test"): 6, (1, "train"): 252, (1, "validation"): 54, (1, "test"): 54}
    assert "_piece" in got._jdf.queryExecution().analyzed().toString()


def test_value_counts_reads_its_rows_once(spark):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(len(b))
            yield b

    got = summary.value_counts(spark.range(40).selectExpr("id % 4 AS v").mapInPandas(count, "v long"), "v").collect()
    assert {(r.v, r.n, r.proporcion) for r in got} == {(i, 10, 0.25) for i in range(4)} and read.value == 40
