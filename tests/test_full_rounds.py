"""The boards of models train their boosting in full."""

import pytest

from veta.operators import models as md
from veta.plans import modelling


class Found(Exception):
    pass


@pytest.mark.parametrize("query", ["delay_leaderboard", "freight_model"])
def test_boosting_runs_all_rounds(spark, monkeypatch, query):
    made = {}
    frame = spark.createDataFrame([("train", 1.0)], "split string, x double")
    monkeypatch.setattr(modelling, "delay_frame", lambda spark, sf: (frame, ["x"]))
    for where, name in ((modelling.sh, "freight_rows"), (modelling.splits, "chronological"), (modelling, "stored")):
        monkeypatch.setattr(where, name, lambda *_: frame)
    for name in ("dispatches", "carriers"):
        monkeypatch.setattr(modelling.roles, name, lambda *_: frame)

    class Encoder:
        features = ["x"]

        def apply(self, df):
            return df.selectExpr("*", *[f"0 AS {c}" for c in ("id_embarque", "linea", "id_parte", "fecha_salida", "costo_flete_usd")])

    def compare(models, *_):
        made.update(models)
        raise Found

    class Trees:
        def __init__(self, **given):
            made.update(given)

        def fit(self, _):
            raise Found

    monkeypatch.setattr(md, "learn_encoder", lambda *_: Encoder())
    monkeypatch.setattr(md, "compare", compare)
    monkeypatch.setattr(md, "GBTRegressor", Trees)
    with pytest.raises(Found):
        getattr(modelling, query)(spark, "")
    with pytest.raises(Found):
        made["GBT"](frame, ["x"], "x")
    assert made["maxIter"] == 200 and made["subsamplingRate"] == 1.0
