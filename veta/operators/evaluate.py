"""Evaluation of predictions.  Tables of predictions may hold many models or series at once (``keys``)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veta.functions.columns import name_of_largest
from veta.operators.sequence import attach, quantiles, running
from veta.operators.splits import every_nth
from veta.session import materialise

CONFORMAL_ALPHA = 0.20


def _div(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


# ------------------------------------------------------------------ two classes
def confusion_counts(y: str, predicted: Column) -> dict[str, Column]:
    t = F.col(y) == 1
    return {"tp": F.count_if(t & predicted), "fp": F.count_if(~t & predicted), "fn": F.count_if(t & ~predicted),
            "tn": F.count_if(~t & ~predicted)}


def rates(df: DataFrame) -> DataFrame:
    """Accuracy, balanced accuracy, precision, recall and F1 from tp, fp, fn, tn; empty ratios are 0."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    recall = zero(_div(tp, tp + fn))
    return df.withColumns({
        "accuracy": zero(_div(tp + tn, tp + fp + fn + tn)), "balanced_acc": (recall + zero(_div(tn, tn + fp))) / 2,
        "precision": zero(_div(tp, tp + fp)), "recall": recall, "f1": zero(_div(2 * tp, 2 * tp + fp + fn))})


def binary_metrics(df: DataFrame, y: str, score: str, threshold: float = 0.5, keys: Sequence[str] = ()) -> DataFrame:
    counts = confusion_counts(y, F.col(score) >= threshold)
    return rates(df.groupBy(*keys).agg(*[c.alias(n) for n, c in counts.items()]))


def threshold_sweep(df: DataFrame, y: str, score: str, thresholds: Sequence[float]) -> DataFrame:
    """Rates at several cut-offs, counted in one pass."""
    cells = [F.struct(F.lit(float(t)).alias("umbral"), *[c.alias(n) for n, c in confusion_counts(y, F.col(score) >= t).items()])
             for t in thresholds]
    return rates(df.agg(F.array(*cells).alias("a")).select(F.explode("a").alias("r")).select("r.*"))


def _score_counts(df: DataFrame, keys: Sequence[str], y: str, score: str) -> DataFrame:
    """Rows of each class by score, written: the sizes of the groups are looked at before the running sums."""
    return materialise(df.groupBy(*keys, F.col(score).alias("_s")).agg(
        F.count_if(F.col(y) == 1).cast("double").alias("_p"), F.count_if(F.col(y) != 1).cast("double").alias("_q")))


def roc_auc(df: DataFrame, y: str, score: str, keys: Sequence[str] = (), name: str = "auc") -> DataFrame:
    """Area under the ROC curve; equal scores share their rank.  Null if a class is missing."""
    below = running(_score_counts(df, keys, y, score), keys, ["_s"], {"_below": F.col("_q")})
    won = F.sum(F.col("_p") * (F.col("_below") - F.col("_q") / 2))
    return below.groupBy(*keys).agg(_div(won, F.sum("_p") * F.sum("_q")).alias(name))


def average_precision(df: DataFrame, y: str, score: str, keys: Sequence[str] = (), name: str = "ap") -> DataFrame:
    """Sum of precision times the gain in recall over falling scores; equal scores enter together."""
    seen = running(_score_counts(df, keys, y, score), keys, [F.col("_s").desc()], {"_tp": F.col("_p"), "_fp": F.col("_q")})
    gain = F.sum(F.col("_p") * F.col("_tp") / (F.col("_tp") + F.col("_fp")))
    return seen.groupBy(*keys).agg(_div(gain, F.sum("_p")).alias(name))


# ------------------------------------------------------------------ many classes
def predicted_class(probabilities: Sequence[str]) -> Column:
    """Index of the largest probability, the first on ties."""
    return name_of_largest({str(i): F.col(p) for i, p in enumerate(probabilities)}).cast("int")


def multiclass_metrics(df: DataFrame, y: str, probabilities: Sequence[str], keys: Sequence[str] = (),
                       focus: int | None = None) -> DataFrame:
    """Accuracy, balanced accuracy, macro F1, MCC, log loss and Brier score, all from one pass."""
    k = len(probabilities)
    d = df.withColumn("_c", predicted_class(probabilities))
    p_true = F.element_at(F.array(*probabilities), F.col(y).cast("int") + 1)
    square = sum((F.pow(F.col(p) - F.when(F.col(y) == i, 1.0).otherwise(0.0), 2) for i, p in enumerate(probabilities)), F.lit(0.0))
    cells = {(i, j): f"_{i}_{j}" for i in range(k) for j in range(k)}
    g = d.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg(-F.log(F.least(F.greatest(p_true, F.lit(1e-6)), F.lit(1.0)))).alias("logloss"),
        F.avg(square).alias("brier"),
        *[F.count_if((F.col(y) == i) & (F.col("_c") == j)).cast("double").alias(c) for (i, j), c in cells.items()])
    real = [sum((F.col(cells[i, j]) for j in range(k)), F.lit(0.0)) for i in range(k)]
    said = [sum((F.col(cells[i, j]) for i in range(k)), F.lit(0.0)) for j in range(k)]
    hit = [F.col(cells[i, i]) for i in range(k)]
    n, right = F.col("n"), sum(hit, F.lit(0.0))
    present = sum((F.when(r > 0, 1.0).otherwise(0.0) for r in real), F.lit(0.0))
    recalls = sum((F.coalesce(_div(h, r), F.lit(0.0)) for h, r in zip(hit, real, strict=True)), F.lit(0.0))
    f1 = [F.coalesce(_div(2 * h, r + s), F.lit(0.0)) for h, r, s in zip(hit, real, said, strict=True)]
    seen = sum((F.when(r + s > 0, 1.0).otherwise(0.0) for r, s in zip(real, said, strict=True)), F.lit(0.0))
    dot = sum((r * s for r, s in zip(real, said, strict=True)), F.lit(0.0))
    spread = ((n * n - sum((s * s for s in said), F.lit(0.0))) * (n * n - sum((r * r for r in real), F.lit(0.0))))
    out = {"accuracy": right / n, "balanced_acc": recalls / present, "f1_macro": sum(f1, F.lit(0.0)) / seen,
           "mcc": F.coalesce(_div(right * n - dot, F.sqrt(spread)), F.lit(0.0))}
    if focus is not None:
        out["recall_foco"] = F.coalesce(_div(hit[focus], real[focus]), F.lit(0.0))
    return g.withColumns(out).drop(*cells.values())


def class_report(df: DataFrame, y: str, predicted: str, classes: Sequence) -> DataFrame:
    """Precision, recall, F1 and support of every class."""
    cells = [F.struct(F.lit(c).alias("clase"), *[v.alias(n) for n, v in {
        "tp": F.count_if((F.col(y) == c) & (F.col(predicted) == c)), "fp": F.count_if((F.col(y) != c) & (F.col(predicted) == c)),
        "fn": F.count_if((F.col(y) == c) & (F.col(predicted) != c)),
        "tn": F.count_if((F.col(y) != c) & (F.col(predicted) != c))}.items()]) for c in classes]
    d = rates(df.agg(F.array(*cells).alias("a")).select(F.explode("a").alias("r")).select("r.*"))
    return d.select("clase", "precision", "recall", "f1", (F.col("tp") + F.col("fn")).alias("soporte"))


def auc_one_vs_rest(df: DataFrame, y: str, probabilities: Sequence[str], keys: Sequence[str] = (), name: str = "auc_ovr") -> DataFrame:
    """Macro mean of the one-against-rest areas."""
    rows = F.array(*[F.struct(F.lit(i).alias("_class"), F.when(F.col(y) == i, 1).otherwise(0).alias("_y"), F.col(p).alias("_score"))
                     for i, p in enumerate(probabilities)])
    d = df.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*")
    return roc_auc(d, "_y", "_score", [*keys, "_class"]).groupBy(*keys).agg(F.avg("auc").alias(name))


# ------------------------------------------------------------------ numbers
def regression_metrics(df: DataFrame, y: str, p: str, keys: Sequence[str] = (), severe: float | None = None) -> DataFrame:
    """MAE, RMSE, R2, MAPE (denominator at least 1), bias and, if asked, MAE of the severe rows."""
    e = F.col(y) - F.col(p)
    sse = F.sum(e * e)
    out = [F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
           (1 - _div(sse, F.var_pop(y) * F.count(y))).alias("r2"),
           (F.avg(F.abs(e) / F.greatest(F.col(y), F.lit(1.0))) * 100).alias("mape_pct"), F.avg(-e).alias("sesgo")]
    if severe is not None:
        out.append(F.avg(F.when(F.col(y) >= severe, F.abs(e))).alias("mae_grave"))
    return df.groupBy(*keys).agg(*out)


def change_metrics(df: DataFrame, y: str, p: str, level: str, keys: Sequence[str], order: Sequence[str], horizon: int,
                   logs: bool = True) -> DataFrame:
    """Quality of a forecast change: errors on the change and on the level, against no change, and as a strategy."""
    e = F.col(y) - F.col(p)
    real = F.col(level) * F.exp(F.col(y)) if logs else F.col(level) + F.col(y)
    said = F.col(level) * F.exp(F.col(p)) if logs else F.col(level) + F.col(p)
    gap = F.abs(real - said)
    sse, sse0 = F.sum(e * e), F.sum(F.col(y) * F.col(y))
    moved = F.col(y) != 0
    g = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae_cambio"), F.sqrt(F.avg(e * e)).alias("rmse_cambio"),
        F.avg(gap).alias("mae_usd"), F.sqrt(F.avg(gap * gap)).alias("rmse_usd"), F.avg(said - real).alias("sesgo_usd"),
        (F.avg(gap / F.abs(real)) * 100 if logs else F.lit(None).cast("double")).alias("mape_pct"),
        (1 - _div(F.sum(gap * gap), F.var_pop(real) * F.count(real))).alias("r2_nivel"),
        (1 - _div(sse, sse0)).alias("r2_oos"), F.sqrt(_div(sse, sse0)).alias("theil_u"),
        _div(F.avg(F.abs(e)), F.avg(F.abs(y))).alias("mae_rel_rw"),
        (F.avg(F.when(moved, F.when(F.signum(p) == F.signum(y), 1.0).otherwise(0.0))) * 100).alias("dir_acc_pct"))
    thin = every_nth(df, keys, order, horizon).withColumn("_r", F.signum(p) * F.col(y))
    s = thin.groupBy(*keys).agg(F.avg("_r").alias("estrat_media"),
                                (_div(F.avg("_r"), F.stddev_pop("_r")) * (12 / horizon) ** 0.5).alias("estrat_sharpe"))
    return attach(g, s, keys) if keys else g.join(s, F.lit(True))


def conformal(calibration: DataFrame, test: DataFrame, y: str, p: str, alpha: float = CONFORMAL_ALPHA) -> DataFrame:
    """Half width from the calibration residuals; coverage and width on the test rows."""
    n = calibration.count()
    prob = min(1.0, (1 - alpha) * (1 + 1 / n)) if n else 1.0
    q = quantiles(calibration.withColumn("_e", F.abs(F.col(y) - F.col(p))), "_e", {"q": prob}).first()["q"]
    inside = F.when(F.lit(q).isNull(), None).when(F.abs(F.col(y) - F.col(p)) <= F.lit(q), 1.0).otherwise(0.0)
    width = F.lit(None if q is None else float(q)).cast("double")
    return test.agg(width.alias("q"), (F.avg(inside) * 100).alias("cobertura_pct"), (2 * width).alias("ancho"),
                    F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ choice of models
def champion(metrics: DataFrame, groups: Sequence[str], by: Sequence[tuple[str, str]], model: str = "modelo",
             exclude: Sequence[str] = ()) -> DataFrame:
    """Best model per group by a list of (metric, 'max' | 'min'); baselines are excluded by name."""
    ranks = [(F.col(m) if way == "min" else -F.col(m)) for m, way in by]
    best = F.min_by(F.struct(*metrics.columns), F.struct(*[r.alias(f"_{i}") for i, r in enumerate(ranks)], F.col(model)))
    picked = metrics.filter(~F.col(model).isin(list(exclude)))
    return picked.groupBy(*groups).agg(best.alias("_b")).select("_b.*")


def ensemble(predictions: DataFrame, metrics: DataFrame, groups: Sequence[str], row: Sequence[str], metric: str = "mae",
             top: int = 3, model: str = "modelo", name: str = "Ens_top3") -> DataFrame:
    """Mean prediction of the best models per group.  The ranking window holds one row per model."""
    w = Window.partitionBy(*groups).orderBy(metric, model)
    chosen = metrics.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= top).select(*groups, model)
    # At most ``top`` rows a group: sent to the predictions, which would meet in one task a model.
    return (predictions.join(F.broadcast(chosen), [*groups, model])
            .groupBy(*groups, *row).agg(F.avg("prediccion").alias("prediccion")).withColumn(model, F.lit(name)))


def improvement_pct(model: Column, baseline: Column) -> Column:
    return (1 - _div(model, baseline)) * 100


def smoke_gate(metrics: DataFrame, kind: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Verdict per metric: ``abandonar`` at or below the floor, ``sospechoso`` above the ceiling, else ``seguir``."""
    out = None
    for m, (floor, ceiling) in kind.items():
        low = F.col("valor") < floor if m != "r2" else F.col("valor") <= floor
        v = F.when(low, "abandonar").when(F.col("valor") > ceiling, "sospechoso").otherwise("seguir")
        out = F.when(F.col("metrica") == m, v) if out is None else out.when(F.col("metrica") == m, v)
    return metrics.withColumn("veredicto", out)
