import datetime

from veta.plans import modelling, prices


def test_gaps_cost_no_rows(spark, monkeypatch):
    months = [datetime.date(2000 + i // 12, i % 12 + 1, 1) for i in range(40)]
    rows = [(s, m, 100.0 + i) for s in ("a", "b") for i, m in enumerate(months)]
    panel = spark.createDataFrame(rows, "serie string, mes date, soya_grano double")
    # Gaps in the first months, in the last and between.
    gaps = {"a": ({0, 1, 39}, {0}), "b": ({i for i in range(40) if i % 5 == 0}, {5})}
    feats = [(s, m, None if i in gaps[s][0] else float(i), None if i in gaps[s][1] else i * 0.5) for s in ("a", "b") for i, m in enumerate(months)]
    features = spark.createDataFrame(feats, "serie string, mes date, est__p double, est__q double")
    monkeypatch.setattr(prices, "panel", lambda *a: panel)
    monkeypatch.setattr(prices, "features", lambda *a: features)
    d, names = modelling.price_frame(spark, "")
    got = d.collect()
    assert {(r.serie, r.mes) for r in got} == {(s, m) for s, m, _ in rows} and len(got) == len(rows)
    assert names and all(r[n] is not None for r in got for n in names)
    assert {r.mes for r in got if r.split == "futuro"} == set(months[-3:])
