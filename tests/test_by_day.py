import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from veta.operators import evaluate as ev
from veta.operators import shipping as sh
from veta.operators import splits
from veta.operators.sequence import running_by_day, selected


def shipments(spark, n=400):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"id": np.arange(n), "k": [None if i % 11 == 0 else "ab"[i % 2] for i in range(n)], "a_tiempo": rng.integers(0, 2, n).astype(float),
                        "day": [None if i % 17 == 0 else dt.date(2020, 1, 1) + dt.timedelta(int(d)) for i, d in enumerate(rng.integers(0, 30, n))]})
    return spark.createDataFrame(pdf.astype({"day": object}), "id long, k string, a_tiempo double, day date")


def test_running_by_day_and_history_without_pieces(spark):
    d = shipments(spark)
    rows = sorted(d.collect(), key=lambda r: (r.day is not None, r.day or dt.date.min, r.id))
    want, seen = {}, {}
    for r in rows:
        yes, n = seen.get(r.k, (0.0, 0))
        want[r.id] = yes / n if n else 0.5
        seen[r.k] = yes + r.a_tiempo, n + 1
    h = sh.on_time_history(d, "k", ["day", "id"])
    assert {r.id: r.hist_punt_tipo for r in h.collect()} == want
    # A reader that leaves the history out does not pay for it: no window is planned, and no row was written before.
    assert "Window" not in h.select("id")._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[0]
    # Too many rows on a day: the general way, with the same answer.
    t = running_by_day(d, ["k"], ["day", "id"], {"n": F.lit(1)}, limit=5)
    assert {r.id: r.n for r in t.collect()} == {r.id: r.n for r in running_by_day(d, ["k"], ["day", "id"], {"n": F.lit(1)}).collect()}


def test_chronological_split_needs_no_single_task(spark):
    d = shipments(spark)
    got = splits.chronological(d, ["day", "id"])
    order = [r.id for r in sorted(d.collect(), key=lambda r: (r.day is not None, r.day or dt.date.min, r.id))]
    assert {r.id for r in got.filter("split = 'train'").collect()} == set(order[:280])
    assert {r.id for r in got.filter("split = 'test'").collect()} == set(order[340:])
    assert "hashpartitioning(_day" in got._jdf.queryExecution().executedPlan().toString()


def test_selected_is_exact(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.lognormal(0, 3, 3001), np.repeat(2.5, 500), [-1e9]])
    d = spark.createDataFrame(pd.DataFrame({"x": x, "one": 7.0})).unionByName(spark.createDataFrame([(None, None)] * 5, "x double, one double"))
    got = selected(d, ["x", "one"], [0.0, 0.25, 0.5, 0.99, 1.0])
    assert np.allclose(got["x"], np.quantile(x, [0.0, 0.25, 0.5, 0.99, 1.0]), rtol=1e-12)
    assert got["one"] == [7.0] * 5
    assert selected(d.filter("x is null"), ["x"], [0.5]) == {"x": [None]}
    assert selected(spark.createDataFrame([(float("nan"),)], "x double"), ["x"], [0.5]) is None


def test_ensemble_sends_the_choice_to_the_predictions(spark):
    p = spark.range(50).crossJoin(spark.createDataFrame([("a", 1.0), ("b", 3.0)], "modelo string, prediccion double")).withColumn("g", F.lit("x"))
    m = spark.createDataFrame([("x", "a", 0.1), ("x", "b", 0.2)], "g string, modelo string, mae double")
    e = ev.ensemble(p, m, ["g"], ["id"])
    assert {r.prediccion for r in e.collect()} == {2.0}
    assert "BroadcastHashJoin" in ev.ensemble(p.hint("merge"), m, ["g"], ["id"])._jdf.queryExecution().executedPlan().toString()
