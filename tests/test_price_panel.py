import datetime as dt

import numpy as np
import pandas as pd
import pytest

from veta.operators import stats
from veta.plans import scoring
from veta.sources import roles
from veta.sources.roles import ENSO, PANEL_SERIES


def monthly(spark, read, months=30):
    """A monthly price table that counts the rows read from it."""
    rng = np.random.default_rng(5)
    rows = [(s, dt.date(2000 + i // 12, i % 12 + 1, 1), *(float(x) for x in rng.uniform(50, 150, len(PANEL_SERIES) + 1))) for s in "ab" for i in range(months)]
    d = spark.createDataFrame(rows, "serie string, mes date, " + ", ".join(f"{c} double" for c in [*PANEL_SERIES, ENSO]))

    def count(batches):
        for b in batches:
            read.add(len(b))
            yield b

    return d.mapInPandas(count, d.schema), pd.DataFrame(rows, columns=d.columns)


def test_rank_ic_reads_the_monthly_prices_once(spark, monkeypatch):
    read = spark.sparkContext.accumulator(0)
    d, rows = monthly(spark, read)
    monkeypatch.setattr(roles, "monthly_prices", lambda *a: d)
    got = {r.serie: (r.n, r.rho) for r in scoring.rank_ic(spark, "").collect()}
    for s, g in rows.groupby("serie"):
        level = np.log(g.soya_grano)
        y, p = level.shift(-3) - level, level - level.shift(3)
        both = pd.DataFrame({"y": y, "p": p}).dropna().rank()
        assert got[s] == (24, pytest.approx(both.y.corr(both.p), abs=2e-6))
    assert read.value == len(rows)


def test_rank_correlation_reads_its_rows_once(spark):
    read = spark.sparkContext.accumulator(0)
    d, rows = monthly(spark, read)
    got = {r.serie: r.rho for r in stats.rank_correlation(d, "maiz", "urea", ["serie"]).collect()}
    assert got == {s: pytest.approx(g.maiz.rank().corr(g.urea.rank())) for s, g in rows.groupby("serie")}
    assert read.value == len(rows)


def test_orders_meet_their_customers_before_the_items(spark, tmp_path, monkeypatch):
    day = dt.datetime(2000, 1, 5)
    tables = {"lineitem": spark.createDataFrame([(1, 1, 2.0, 10.0, 0.06, day), (1, 2, 4.0, 30.0, 0.04, day), (2, 1, 5.0, 50.0, 0.05, day), (None, 1, 1.0, 1.0, 0.0, day),
                                                 (3, 9, 1.0, 1.0, 0.0, day)], "l_orderkey long, l_partkey long, l_quantity double, l_extendedprice double, l_discount double, l_shipdate timestamp"),
              "part": spark.createDataFrame([(1, "STANDARD"), (2, "PROMO"), (2, "PROMO")], "p_partkey long, p_type string"),
              "orders": spark.createDataFrame([(1, 7), (2, 7), (2, 8), (3, None)], "o_orderkey long, o_custkey long"),
              "customer": spark.createDataFrame([(7, "x"), (8, "y"), (None, "z")], "c_custkey long, c_mktsegment string")}
    monkeypatch.setattr(roles, "table", lambda s, sf, name: tables[name])
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = roles.monthly_prices(spark, "")
        got = {r.serie: r for r in d.collect()}
        plan = d._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    # A repeated key multiplies its rows, a missing one drops them.
    assert set(got) == {"x", "y"}
    assert got["x"].soya_grano == 60.0 / 7.0 and got["x"].soya_aceite == 7.5 and got["x"][ENSO] == pytest.approx((0.19 / 4 - 0.05) * 80)
    assert got["y"].soya_grano == 10.0 and got["y"].soya_aceite is None and got["y"][ENSO] == pytest.approx(0.0)
    # The joins stand one below the other from the last to the first: customers meet the orders alone.
    joins = [line.split("Join Inner")[1] for line in plan.splitlines() if "Join Inner" in line]
    assert len(joins) == 3 and "o_custkey" not in joins[0]
