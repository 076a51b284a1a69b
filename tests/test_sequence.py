"""The piecewise paths must give what a plain window gives."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veta.operators.sequence import as_of_last, crowded, framed, positions, quantiles, running

SMALL = 7


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    n = 90
    # One key holds most rows; a null key and equal order values are included.
    key = ["hot"] * 60 + ["a"] * 20 + [None] * 10
    return spark.createDataFrame(pd.DataFrame({"k": key, "t": rng.integers(0, 15, n), "id": np.arange(n), "x": rng.integers(0, 9, n).astype(float)}))


def both(build, rows, columns):
    a = build(2_000_000).select(*columns).toPandas().sort_values("id").reset_index(drop=True)
    b = build(SMALL).select(*columns).toPandas().sort_values("id").reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b, check_dtype=False)
    return a


def test_crowded(rows):
    assert crowded(rows, ["k"], SMALL) and not crowded(rows, ["k"], 60)


@pytest.mark.parametrize("include", [True, False])
@pytest.mark.parametrize("kind", ["sum", "max"])
def test_running(rows, include, kind):
    both(lambda limit: running(rows, ["k"], ["t", "id"], {"s": F.col("x")}, include, kind, limit), rows, ["id", "s"])


def test_positions_without_key(rows):
    got = both(lambda limit: positions(rows, [], ["t", "id"], "p", limit), rows, ["id", "p"])
    assert sorted(got.p) == list(range(1, 91))


def test_framed(rows):
    stage1 = lambda w: {"prev": F.lag("x", 2).over(w), "nxt": F.lead("x", 1).over(w)}
    stage2 = lambda w: {"m": F.sum("x").over(w.rowsBetween(-3, 0))}
    both(lambda limit: framed(rows, ["k"], ["t", "id"], [stage1, stage2], 5, 1, limit), rows, ["id", "prev", "nxt", "m"])


def test_quantiles(rows):
    pdf = rows.toPandas()
    for limit in (2_000_000, 3):
        got = {r["k"]: (r["lo"], r["mid"]) for r in quantiles(rows, "x", {"lo": 0.2, "mid": 0.5}, ["k"], limit).collect()}
        for k, (lo, mid) in got.items():
            x = pdf[pdf.k.isna()].x if k is None else pdf[pdf.k == k].x
            assert lo == pytest.approx(x.quantile(0.2)) and mid == pytest.approx(x.median())


def test_as_of(spark):
    left = spark.createDataFrame([(1, 0.0), (2, 2.5), (3, 9.0)], "id int, at double")
    right = spark.createDataFrame([("p", 0.0), ("q", 2.0), ("r", 5.0)], "v string, pos double")
    for limit in (100, 1):
        got = {r["id"]: r["hit"] for r in as_of_last(left, right, "at", "pos", "v", "hit", limit).collect()}
        assert got == {1: "p", 2: "q", 3: "r"}
