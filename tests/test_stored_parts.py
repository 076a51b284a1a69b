import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veta.operators import linear, splits
from veta.plans import modelling
from veta.session import stored


def plan(d):
    return d._jdf.queryExecution().executedPlan().toString()


def rows_by_day(spark, n, days, seed=6):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"id": np.arange(n) // 2 if n % 2 else np.arange(n), "when": [None if i % 13 == 0 else dt.datetime(2021, 1, 1) + dt.timedelta(days=int(k), hours=int(i % 24))
                                                                                  for i, k in enumerate(rng.integers(0, days, n))]})
    return spark.createDataFrame(pdf.astype({"when": object}), "id long, when timestamp")


@pytest.mark.parametrize("n, days, k", [(200, 12, 4), (201, 1, 3), (3, 3, 4), (60, 60, 4), (50, 200, 9), (0, 1, 4)])
def test_folds_by_day_are_the_folds_by_position(spark, monkeypatch, n, days, k):
    d = rows_by_day(spark, n, days)
    got = splits.expanding_folds(d, ["when", "id"], k, limit=-1)
    seen = sorted(((r.when is not None, r.when or dt.datetime.min, r.id, r.pliegue) for r in got.collect()))
    monkeypatch.setattr(splits, "dated", lambda *a: False)
    want = splits.expanding_folds(d, ["when", "id"], k)
    assert got.dtypes == want.dtypes
    assert seen == sorted(((r.when is not None, r.when or dt.datetime.min, r.id, r.pliegue) for r in want.collect()))


def test_folds_order_only_the_days_that_a_cut_divides(spark):
    # 50 days of 10 rows and one of 13: 513 rows, cuts after 105, 207, 309, 411 rows lie inside four days.
    d = spark.range(513).selectExpr("id", "timestamp'2021-01-01' + make_dt_interval(cast(least(floor(id / 10), 50) as int)) AS when")
    got = splits.expanding_folds(d, ["when", "id"], 4, limit=100)
    assert {(r.pliegue, r["count"]) for r in got.groupBy("pliegue").count().collect()} == {(0, 105), (1, 102), (2, 102), (3, 102), (4, 102)}
    # The rows of the other days reach the union without a shuffle.
    whole = plan(got).split("Union")[1].split("Window")[0]
    assert "Window" in plan(got) and "Exchange" not in whole.split("Project")[1]


def test_a_stored_part_is_read_alone(spark):
    d = spark.createDataFrame([(1, "train", None), (2, "test", 0.5), (3, "train", float("nan"))], "id long, split string, x double")
    s = stored(d, "split")
    assert s.columns == d.columns and s.dtypes == d.dtypes
    assert sorted(map(str, s.collect())) == sorted(map(str, d.collect()))
    files = s.filter("split = 'train'").select(F.input_file_name().alias("f")).distinct().collect()
    assert files and all("split=train" in r.f for r in files)
    assert stored(d.limit(0), "split").count() == 0


def test_freight_model_writes_its_parts_apart(spark, monkeypatch):
    found = []
    monkeypatch.setattr(modelling, "stored", lambda d, by: found.append(stored(d, by)) or found[-1])
    i, start = F.col("id"), F.lit(dt.datetime(2021, 1, 1))
    sent = spark.range(300).select(i.alias("id_embarque"), (i % 3).alias("id_transporte"), (i * 7 % 90 + 1.0).alias("distancia_km"), (i * 7 % 90 * 3 + i % 5 + 1.0).alias("costo_flete_usd"),
                                   (start + F.make_dt_interval((i % 50).cast("int"))).alias("fecha_salida"), (start + F.make_dt_interval((i % 50 + 1).cast("int"))).alias("fecha_llegada"),
                                   F.lit("o").alias("origen"), F.lit("d").alias("destino"), i.alias("id_parte"), F.lit(1).alias("linea"))
    monkeypatch.setattr(modelling.roles, "dispatches", lambda *a: sent)
    monkeypatch.setattr(modelling.roles, "carriers", lambda *a: spark.createDataFrame([(0, "a", 5.0, 1), (1, "b", 6.0, 1)], "id_transporte long, tipo string, capacidad_tn double, pais_bandera int"))
    got = modelling.freight_model(spark, "").collect()
    assert {(r.modelo, r.n) for r in got if r.fase == "val"} == {(m, 45) for m in ("Media", "Ridge", "RF", "GBT")}
    tr = found[-1].filter("split = 'train'")
    assert len(found) == 2 and tr.count() and {f.split("split=")[1].split("/")[0] for f in tr.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]} == {"train"}


def test_moments_by_batches_with_several_labels_in_a_batch(spark):
    rng = np.random.default_rng(1)
    names = [f"c{i}" for i in range(linear.JVM_COLUMNS + 2)]
    pdf = pd.DataFrame(rng.normal(size=(300, len(names))), columns=names).assign(g=rng.integers(0, 3, 300))
    got = linear.moments_by(spark.createDataFrame(pdf), names, "g")
    assert set(got) == {0, 1, 2}
    for k, rows in pdf.groupby("g"):
        assert got[k].n == len(rows) and np.allclose(got[k].covariance(), np.cov(rows[names].T, ddof=0))
