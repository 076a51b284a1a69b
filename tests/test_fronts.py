import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veta.functions import columns as fn
from veta.functions import tails
from veta.operators import assignment as asg
from veta.operators import models as md
from veta.operators import panel, prep, quality, rules, stats, weighing
from veta.operators.isolation import isolation_score
from veta.plans import registry


def test_every_check_has_a_query():
    registry.load_all()
    assert set(registry.CHECKS) <= set(registry.QUERIES) and len(registry.QUERIES) > 130


def test_column_rules(spark):
    df = spark.sql("""SELECT * FROM VALUES (CAST(NULL AS DOUBLE), timestamp'2024-01-07 00:59:00', timestamp'2024-01-07 01:01:00'),
        (12D, timestamp'2024-01-08 00:00:00', timestamp'2024-01-09 23:00:00') t(x, a, b)""")
    r = df.select(fn.clip("x", 0, 5).alias("c"), fn.right_closed("x", [-1, 12, 14], ["seca", "limite"]).alias("bin"),
                  fn.boundary_hours("a", "b").alias("h"), fn.floor_days("a", "b").alias("d"), fn.is_sunday("a").alias("s")).collect()
    assert (r[0]["c"], r[0]["bin"], r[0]["h"], r[0]["d"], r[0]["s"]) == (None, None, 1, 0, True)
    assert (r[1]["c"], r[1]["bin"], r[1]["h"], r[1]["d"], r[1]["s"]) == (5.0, "seca", 47, 1, False)
    d = spark.createDataFrame([("0.052", ), ("0", ), ("abc", )], "t string")
    got = d.select(fn.first_digit(fn.as_number("t")).alias("d"), fn.as_number("t").alias("n")).collect()
    assert [r["d"] for r in got] == [5, None, None] and got[2]["n"] is None


def test_tails():
    assert tails.f_tail(4.0, 3, 20) == pytest.approx(0.0221, abs=2e-4)
    assert tails.t_two_sided(2.086, 20) == pytest.approx(0.05, abs=1e-4)
    assert tails.binomial_at_least(8, 10, 0.5) == pytest.approx(56 / 1024)


def receipt(i, gross, tare, when, contract, note, silo=1):
    return (i, when, silo, contract, gross, tare, 13.0, 0.5, "PREMIUM", note, 1 if contract else None, 100.0 if contract else None, 0)


def test_hard_rules_give_100(spark):
    import datetime as dt

    t = dt.datetime(2024, 3, 4, 10)
    rows = [receipt(1, 30.0, 10.0, t, 5, "n1"), receipt(2, 10.0, 12.0, t, 5, "n2"), receipt(3, 250.0, 10.0, t, 5, "n3"),
            receipt(4, 30.0, 10.0, dt.datetime(1990, 1, 1, 4), None, "x"), receipt(5, 30.0, 10.0, dt.datetime(1990, 1, 1, 4), None, "x")]
    df = spark.createDataFrame(rows, """id_recepcion long, fecha_hora timestamp, id_silo int, id_contrato long, peso_bruto_tn double, tara_tn double,
        humedad_pct double, impurezas_pct double, calidad_grano string, numero_remision string, id_productor long, volumen_comprometido_tn double, n_lab long""")
    plots = spark.createDataFrame([(1, 100.0)], "id_productor long, superficie_ha double")
    got = {r["id_recepcion"]: r for r in weighing.score(weighing.signals(df, plots, ["fecha_hora", "id_recepcion"])).collect()}
    assert [got[i]["score"] for i in (2, 3, 4, 5)] == [100.0] * 4 and 0 <= got[1]["score"] < 100
    assert [got[i]["tipologia"] for i in (2, 3, 4)] == ["FISICA", "FISICA", "DOCUMENTAL"]


def test_uniform_digits_are_extreme(spark):
    df = spark.createDataFrame([(1, float(d * 10 + i % 7)) for d in range(1, 10) for i in range(60)], "g int, peso_neto double")
    r = weighing.benford(df, ["g"]).first()
    assert r["n"] == 540 and r["p"] < 1e-6 and r["senal"] > 0.9


@pytest.mark.parametrize(("n", "columns"), [(40, ["a", "b"]), (40, ["a"]), (3000, ["a", "b"])])
def test_isolation_uses_the_norm_of_its_sample(spark, n, columns):
    rng = np.random.default_rng(3)
    x = pd.DataFrame(rng.normal(size=(n, len(columns))), columns=columns).assign(id=np.arange(n))
    x.loc[0, columns] = 25.0
    got = isolation_score(spark.createDataFrame(x), columns, ["id"], trees=50).toPandas().sort_values("id")
    assert got.s_iso.iloc[0] > 0.95 and 0.5 < got.s_iso.iloc[1:].median() < 0.98 and got.s_iso.idxmax() == got.index[0]


def test_isolation_finds_the_far_point(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(400, 3)), [[9, 9, 9]]])
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(id=range(401)))
    got = isolation_score(df, list("abc"), ["id"], trees=40, rows=64).toPandas()
    assert got.s_iso.between(0, 1).all() and got.set_index("id").s_iso[400] == 1.0 and got.s_iso.median() < 1


def test_assignment_respects_capacity_and_bound(spark):
    rng = np.random.default_rng(4)
    lots = [(f"l{i}", float(w), float(r), float(w * r)) for i, (w, r) in enumerate(zip(rng.integers(1, 9, 40), rng.uniform(0, 0.1, 40)))]
    silos = [(1, 60.0, 0.0, 1.0), (2, 70.0, 0.0, 1.2), (3, 90.0, 0.0, 1.3)]
    a = spark.createDataFrame(lots, "id_lote string, peso_neto double, tasa double, base double")
    s = spark.createDataFrame(silos, "id_silo long, libre_tn double, lleno double, factor double")
    plan = asg.assign(a, s).toPandas()
    assert len(plan) == 40 and plan.id_lote.is_unique and (plan.estado == "ASIGNADO").all()
    for i, cap, _, _ in silos:
        assert plan[plan.id_silo == i].peso_neto.sum() <= cap + 1e-6
    f = {i: x for i, _, _, x in silos}
    cost = (plan.base * plan.id_silo.map(f)).sum()
    assert asg.lower_bound(a, s).first()["cota"] <= cost + 1e-9


def test_assignment_near_best_and_reports_no_room(spark):
    lots = [("a", 2.0, 0.09, 0.18), ("b", 2.0, 0.05, 0.10), ("c", 2.0, 0.01, 0.02), ("d", 50.0, 0.02, 1.0)]
    silos = [(1, 4.0, 0.0, 1.0), (2, 4.0, 0.0, 1.3)]
    a = spark.createDataFrame(lots, "id_lote string, peso_neto double, tasa double, base double")
    s = spark.createDataFrame(silos, "id_silo long, libre_tn double, lleno double, factor double")
    plan = {r["id_lote"]: r for r in asg.assign(a, s).collect()}
    assert plan["d"]["estado"] == "SIN_ESPACIO"
    small = a.filter("id_lote <> 'd'")
    got = asg.assign(small, s).toPandas()
    cost = sum(dict((x[0], x[3]) for x in lots)[i] * {1: 1.0, 2: 1.3}[k] for i, k in zip(got.id_lote, got.id_silo))
    best = min(sum(lots[i][3] * {0: 1.0, 1: 1.3}[p[i]] for i in range(3)) for p in itertools.product((0, 1), repeat=3)
               if all(sum(lots[i][1] for i in range(3) if p[i] == k) <= 4 for k in (0, 1)))
    assert cost == pytest.approx(best)


def test_rules_have_joint_consequents(spark):
    df = spark.createDataFrame([(["a", "b", "c"], )] * 6 + [(["a"], )] * 2 + [(["d"], )] * 2, "items array<string>")
    sets = rules.frequent_itemsets(df, 0.05)
    got = {tuple(r["conjunto"]): r["n"] for r in sets.collect()}
    assert got[("a", "b", "c")] == 6 and got[("a", )] == 8 and len(got) == 8
    r = {(tuple(x["antecedente"]), tuple(x["consecuente"])): x for x in rules.association_rules(sets, 0.5).collect()}
    assert r[(("a", ), ("b", "c"))]["confianza"] == pytest.approx(0.75) and r[(("b", ), ("a", "c"))]["lift"] == pytest.approx(1 / 0.6)


def test_panel_fills_two_months_only(spark):
    rows = [("s", "2020-01-01", 1.0, 1), ("s", "2020-01-01", 2.0, 2), ("s", "2020-05-01", 3.0, 1), ("s", "2020-06-01", None, 1)]
    df = spark.createDataFrame(rows, "k string, mes string, v double, ver int").withColumn("mes", F.to_date("mes"))
    got = panel.monthly_panel(df, ["k"], ["v"], ["v"], ["ver"]).orderBy("mes").collect()
    assert [r["v"] for r in got] == [2.0, 2.0, 2.0, None, 3.0, 3.0]


def test_quality_flags(spark):
    df = spark.createDataFrame([(1, None, 5, -1.0, "2050-01-01"), (1, None, 5, 2.0, "2000-01-01")], "ID_X int, vacio string, fijo int, neg double, f string")
    df = df.withColumn("f", F.to_timestamp("f"))
    r = quality.flags(quality.profile_tables({"t": df}, "2030-01-01")).first()
    assert r["flags"] == "TODA_NULA:vacio NULOS_ALTOS:vacio=100% CONSTANTES:2 NEGATIVOS:neg FECHAS_FUTURAS:f DUP_CLAVE:ID_X=1"
    empty = quality.flags(quality.profile_tables({"e": df.limit(0).select("neg")}, "2030-01-01")).first()
    assert empty["flags"] == "VACIA SIN_CLAVE"


def test_time_series_tests():
    rng = np.random.default_rng(6)
    x = rng.normal(size=300)
    y = np.zeros(300)
    y[1:] = 0.8 * x[:-1] + rng.normal(0, 0.3, 299)
    assert stats.granger_table(y, x, 2)[0][2] < 1e-6 < stats.granger_table(x, y, 2)[0][2]
    assert stats.adf_statistic(rng.normal(size=200))[2] < 0.01 < stats.adf_statistic(np.cumsum(rng.normal(size=200)))[2]


def test_median_and_scale(spark):
    df = spark.createDataFrame([(1.0, ), (2.0, ), (4.0, ), (9.0, ), (None, )], "x double")
    assert sorted(r["x"] for r in prep.median_fill(df, ["x"]).collect()) == [1.0, 2.0, 3.0, 4.0, 9.0]
    z = [r["x"] for r in prep.standardise(df.dropna(), ["x"]).collect()]
    assert np.mean(z) == pytest.approx(0) and np.std(z) == pytest.approx(1)


def test_logistic_and_walk_forward(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(80, 2))
    y = (x[:, 0] + rng.normal(0, 0.5, 80) > 0).astype(float)
    w = md.newton_logistic(x, y)
    p = 1 / (1 + np.exp(-(x @ w[:2] + w[2])))
    assert np.allclose(x.T @ (p - y) + w[:2], 0, atol=1e-6) and (p - y).sum() == pytest.approx(0, abs=1e-6)
    pdf = pd.DataFrame(x, columns=["a", "b"]).assign(k="s", y=y, mes=pd.date_range("2010-01-01", periods=80, freq="MS").date)
    got = md.walk_forward(spark.createDataFrame(pdf), "k", "mes", ["a", "b"], "y").toPandas().sort_values("mes")
    w = md.newton_logistic(x[:79], y[:79])
    assert len(got) == 40 and got.p.iloc[-1] == pytest.approx(1 / (1 + np.exp(-(x[79] @ w[:2] + w[2]))))
