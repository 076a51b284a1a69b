"""Models behind one interface, and their selection.

A fitter takes (train frame, feature columns, target) and returns a function that adds predictions:
``prediccion`` for numbers, ``p0, p1, ...`` for classes 0, 1, ...
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veta.functions.columns import hash_order
from veta.operators import boosting, linear
from veta.operators.neighbours import knn_predict
from veta.operators.prep import apply_scale, fill_category, learned_medians, learned_scale, levels_of
from veta.operators.sequence import positions
from veta.operators.splits import expanding_folds, stratified_folds
from veta.operators.stats import short_series
from veta.session import materialise

Predict = Callable[[DataFrame], DataFrame]
Fitter = Callable[[DataFrame, list[str], str], Predict]
SEED = 42


# ------------------------------------------------------------------ features
@dataclass
class Encoder:
    """Medians, scales and category levels learned on training rows."""

    numbers: list[str]
    medians: dict[str, float]
    scale: dict[str, tuple[float, float]]
    levels: dict[str, list]

    @property
    def features(self) -> list[str]:
        return [f"x_{n}" for n in self.numbers] + [f"x_{c}_{i}" for c, v in self.levels.items() for i in range(len(v))]

    def apply(self, df: DataFrame) -> DataFrame:
        d = df.withColumns({f"x_{n}": F.coalesce(F.col(n).cast("double"), F.lit(self.medians[n] or 0.0)) for n in self.numbers})
        d = apply_scale(d, {f"x_{n}": s for n, s in self.scale.items()})
        dummies = {f"x_{c}_{i}": F.when(F.coalesce(F.col(c).cast("string"), F.lit("FALTA")) == v, 1.0).otherwise(0.0)
                   for c, values in self.levels.items() for i, v in enumerate(values)}
        return d.withColumns(dummies) if dummies else d


def learn_encoder(train: DataFrame, numbers: Sequence[str], categories: Sequence[str] = ()) -> Encoder:
    med = learned_medians(train, numbers)
    filled = train.select(*[F.coalesce(F.col(n).cast("double"), F.lit(med[n] or 0.0)).alias(n) for n in numbers])
    cats = fill_category(train, categories) if categories else train
    return Encoder(list(numbers), med, learned_scale(filled, numbers), {c: levels_of(cats, c) for c in categories})


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="_f", handleInvalid="keep").transform(df)


def balanced(df: DataFrame, target: str, name: str = "_w") -> DataFrame:
    """Row weights that give every class the same total."""
    n = {r[target]: r["count"] for r in df.groupBy(target).count().collect()}
    total, w = sum(n.values()), F.lit(1.0)
    for c, k in n.items():
        w = F.when(F.col(target) == F.lit(c), F.lit(total / (len(n) * k))).otherwise(w)
    return df.withColumn(name, w)


# ------------------------------------------------------------------ numbers
def mean_model(train: DataFrame, features: list[str], target: str) -> Predict:
    m = train.agg(F.avg(target)).first()[0]
    return lambda df: df.withColumn("prediccion", F.lit(float(m)))


def zero_model(train: DataFrame, features: list[str], target: str) -> Predict:
    """No change (random walk)."""
    return lambda df: df.withColumn("prediccion", F.lit(0.0))


def _affine(features: Sequence[str], weights: np.ndarray, constant: float) -> Predict:
    return lambda df: linear.affine(df, features, np.asarray(weights)[:, None], [constant], ["prediccion"])


def grid_linear(order: Sequence[str], grid: Sequence, fit, folds: int = 4) -> Fitter:
    """Closed-form model with its setting chosen over expanding time folds."""
    def run(train: DataFrame, features: list[str], target: str) -> Predict:
        best, m = linear.cross_validated(expanding_folds(train, order, folds), features, target, "pliegue", fit, grid)
        return _affine(features, *fit(m, features, target, [best])[best])
    return run


def ridge_model(order: Sequence[str], alphas: Sequence[float] = tuple(np.logspace(-1, 5, 25)), folds: int = 4) -> Fitter:
    return grid_linear(order, [float(a) for a in alphas], linear.ridge_weights, folds)


def pls_model(order: Sequence[str], counts: Sequence[int] = (1, 2, 3, 4, 6, 8), folds: int = 4) -> Fitter:
    return grid_linear(order, list(counts), linear.pls_weights, folds)


def reduced(fitter: Fitter, share: float = 0.90) -> Fitter:
    """Any model on as many principal components as explain ``share`` of the training variance."""
    def run(train: DataFrame, features: list[str], target: str) -> Predict:
        c = linear.components(linear.moments(train, features))
        k = min(c.needed(share), len(features))
        names = [f"_pc{i + 1}" for i in range(k)]
        # Written once: the fitter reads the projected rows several times.
        inner = fitter(materialise(c.project(train, k, "_pc").drop(*features)), names, target)
        # Written on this side as well: the neighbour search would repeat the projection in each of its conditions.
        return lambda df: inner(materialise(c.project(df, k, "_pc").drop(*features))).drop(*names)
    return run


def sparse_linear(order: Sequence[str], mixes: Sequence[float], penalties: Sequence[float], folds: int = 4) -> Fitter:
    """Lasso (mix 1) or elastic net over the whole grid, chosen by squared error over expanding time folds."""
    return grid_linear(order, [(float(m), float(p)) for m in mixes for p in penalties], linear.sparse_weights, folds)


def _ml_number(make) -> Fitter:
    def run(train: DataFrame, features: list[str], target: str) -> Predict:
        model = make(target).fit(assemble(train, features))
        def predict(df: DataFrame) -> DataFrame:
            return model.transform(assemble(df, features)).withColumnRenamed("prediction", "prediccion").drop("_f")
        predict.model = model
        return predict
    return run


def forest_number(trees: int = 300, leaf: int = 8, subset: str = "auto", depth: int = 8, seed: int = SEED) -> Fitter:
    return _ml_number(lambda y: RandomForestRegressor(featuresCol="_f", labelCol=y, numTrees=trees, minInstancesPerNode=leaf,
                                                      featureSubsetStrategy=subset, maxDepth=depth, seed=seed))


def extra_trees_number(trees: int = 300, leaf: int = 8, depth: int = 8, seed: int = SEED) -> Fitter:
    """Forest on all rows (no bootstrap) with few, coarse cut candidates: stands in for fully random cuts."""
    return _ml_number(lambda y: RandomForestRegressor(featuresCol="_f", labelCol=y, numTrees=trees, minInstancesPerNode=leaf, bootstrap=False,
                                                      featureSubsetStrategy="onethird", maxBins=8, maxDepth=depth, seed=seed))


def boosted_number(rounds: int = 200, rate: float = 0.05, depth: int = 3, leaf: int = 10, share: float = 1.0, seed: int = SEED) -> Fitter:
    return _ml_number(lambda y: GBTRegressor(featuresCol="_f", labelCol=y, maxIter=rounds, stepSize=rate, maxDepth=depth,
                                             minInstancesPerNode=leaf, subsamplingRate=share, seed=seed))


def hist_boosted_number(rounds: int = 200, rate: float = 0.04, depth: int = 3, leaf: int = 15, penalty: float = 1.0, patience: int | None = 10,
                        ids: Sequence[str] = (), judge_from: int = 10_000) -> Fitter:
    """Boosted histogram trees; beyond ``judge_from`` rows ``patience`` stops early on a tenth of them, drawn by ``ids``."""
    def run(train: DataFrame, features: list[str], target: str) -> Predict:
        model = boosting.fit(train, features, target, boosting.Squares(), None, rounds, rate, depth, leaf, penalty, patience, ids=ids or features, judge_from=judge_from)
        predict = boosting.predict(model, features, ["prediccion"])
        predict.model = model
        return predict
    return run


def knn_number(point: str, k: int = 20) -> Fitter:
    def run(train: DataFrame, features: list[str], target: str) -> Predict:
        return lambda df: df.join(knn_predict(train, df, features, target, k, point), point)
    return run


# ------------------------------------------------------------------ classes
def majority_model(classes: int) -> Fitter:
    def run(train: DataFrame, features: list[str], target: str) -> Predict:
        top = train.groupBy(target).count().orderBy(F.desc("count"), target).first()[target]
        return lambda df: df.withColumns({f"p{c}": F.lit(1.0 if c == top else 0.0) for c in range(classes)})
    return run


def stratified_model(classes: int, ids: Sequence[str], seed: int = SEED) -> Fitter:
    """Class drawn by hash with the training shares."""
    def run(train: DataFrame, features: list[str], target: str) -> Predict:
        n = {r[target]: r["count"] for r in train.groupBy(target).count().collect()}
        cut, total = [0.0], sum(n.values())
        for c in range(classes):
            cut.append(cut[-1] + n.get(c, 0) / total)
        u = F.pmod(hash_order(ids, seed), F.lit(1_000_000)) / 1e6
        return lambda df: df.withColumn("_u", u).withColumns(
            {f"p{c}": F.when((F.col("_u") >= cut[c]) & (F.col("_u") < cut[c + 1]), 1.0).otherwise(0.0) for c in range(classes)}).drop("_u")
    return run


def _ml_classes(make, classes: int, weigh: bool) -> Fitter:
    def run(train: DataFrame, features: list[str], target: str) -> Predict:
        d = balanced(train, target) if weigh else train.withColumn("_w", F.lit(1.0))
        model = make(target, d).fit(assemble(d, features))
        drop = ["_f", "_v", "rawPrediction", "probability", "prediction"]
        def predict(df: DataFrame) -> DataFrame:
            out = model.transform(assemble(df, features)).withColumn("_v", vector_to_array("probability"))
            # A class that training never showed has no slot in the vector.
            return out.withColumns({f"p{c}": F.coalesce(F.get("_v", F.lit(c)), F.lit(0.0)) for c in range(classes)}).drop(*drop)
        predict.model = model
        return predict
    return run


def logistic_model(classes: int, strength: float = 1.0, weigh: bool = True, iterations: int = 100) -> Fitter:
    """L2 logistic regression; ``strength`` is the inverse penalty on the summed loss."""
    def make(y: str, d: DataFrame):
        total = d.agg(F.sum("_w")).first()[0]
        return LogisticRegression(featuresCol="_f", labelCol=y, weightCol="_w", regParam=1.0 / (strength * total), standardization=False,
                                  maxIter=iterations, family="binomial" if classes == 2 else "multinomial")
    return _ml_classes(make, classes, weigh)


def forest_classes(classes: int, trees: int = 300, leaf: int = 8, depth: int = 8, weigh: bool = True, seed: int = SEED) -> Fitter:
    return _ml_classes(lambda y, d: RandomForestClassifier(featuresCol="_f", labelCol=y, weightCol="_w", numTrees=trees, minInstancesPerNode=leaf,
                                                           maxDepth=depth, seed=seed), classes, weigh)


def boosted_classes(classes: int, rounds: int = 150, rate: float = 0.05, depth: int = 3, leaf: int = 10, weigh: bool = True,
                    seed: int = SEED) -> Fitter:
    """Boosted trees; beyond two classes one model per class, the probabilities scaled to sum 1."""
    def one(d: DataFrame, features: list[str], target: str):
        return GBTClassifier(featuresCol="_f", labelCol=target, weightCol="_w", maxIter=rounds, stepSize=rate, maxDepth=depth,
                             minInstancesPerNode=leaf, seed=seed).fit(assemble(d, features))

    def run(train: DataFrame, features: list[str], target: str) -> Predict:
        wanted = [1] if classes == 2 else range(classes)
        models = {}
        for c in wanted:
            d = train.withColumn("_y", F.when(F.col(target) == c, 1.0).otherwise(0.0))
            models[c] = one(balanced(d, "_y") if weigh else d.withColumn("_w", F.lit(1.0)), features, "_y")

        def predict(df: DataFrame) -> DataFrame:
            d = assemble(df, features)
            for c, m in models.items():
                d = (m.transform(d).withColumn(f"p{c}", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction"))
            if classes == 2:
                return d.withColumn("p0", 1 - F.col("p1")).drop("_f")
            total = sum((F.col(f"p{c}") for c in range(1, classes)), F.col("p0"))
            d = d.withColumn("_t", F.when(total > 0, total).otherwise(1.0))
            return d.withColumns({f"p{c}": F.col(f"p{c}") / F.col("_t") for c in range(classes)}).drop("_t", "_f")
        predict.model = next(iter(models.values()))
        return predict
    return run


def hist_boosted_classes(classes: int, rounds: int = 150, rate: float = 0.04, depth: int = 3, leaf: int = 15, penalty: float = 1.0, weigh: bool = True,
                         patience: int | None = 10, ids: Sequence[str] = (), judge_from: int = 10_000) -> Fitter:
    """Boosted histogram trees under one softmax loss over all classes; stops early as ``hist_boosted_number`` does."""
    def run(train: DataFrame, features: list[str], target: str) -> Predict:
        d = balanced(train, target) if weigh else train.withColumn("_w", F.lit(1.0))
        model = boosting.fit(d, features, target, boosting.Softmax(classes), "_w", rounds, rate, depth, leaf, penalty, patience, ids=ids or features, judge_from=judge_from)
        predict = boosting.predict(model, features, [f"p{c}" for c in range(classes)])
        predict.model = model
        return predict
    return run


def lda_model(classes: int, shrinkage: float = 0.1) -> Fitter:
    def run(train: DataFrame, features: list[str], target: str) -> Predict:
        by = linear.moments_by(train, features, target)
        def predict(df: DataFrame) -> DataFrame:
            d = linear.lda_probabilities(df, by, [f"p{int(c)}" for c in sorted(by)], shrinkage)
            return d.withColumns({f"p{c}": F.lit(0.0) for c in range(classes) if c not in by})
        return predict
    return run


def qda_model(classes: int, reg: float = 0.5) -> Fitter:
    def run(train: DataFrame, features: list[str], target: str) -> Predict:
        by = {k: m for k, m in linear.moments_by(train, features, target).items() if m.n > 1}
        def predict(df: DataFrame) -> DataFrame:
            d = linear.qda_probabilities(df, by, [f"p{int(c)}" for c in sorted(by)], reg)
            return d.withColumns({f"p{c}": F.lit(0.0) for c in range(classes) if c not in by})
        return predict
    return run


def lda_axis(fitter: Fitter) -> Fitter:
    """A classifier on the discriminant axes learned from the training rows."""
    def run(train: DataFrame, features: list[str], target: str) -> Predict:
        _, axes = linear.lda_axes(linear.moments_by(train, features, target))
        names = [f"_ld{i + 1}" for i in range(axes.shape[1])]
        place = lambda df: linear.affine(df, features, axes, np.zeros(len(names)), names)
        inner = fitter(place(train), names, target)
        return lambda df: inner(place(df)).drop(*names)
    return run


def knn_classes(classes: int, point: str, k: int = 25) -> Fitter:
    def run(train: DataFrame, features: list[str], target: str) -> Predict:
        return lambda df: df.join(knn_predict(train, df, features, target, k, point, list(range(classes))), point)
    return run


def calibrated(fitter: Fitter, classes: int, ids: Sequence[str], folds: int = 3) -> Fitter:
    """Sigmoid calibration: out-of-fold probabilities feed one logistic curve per class, scaled to sum 1."""
    def run(train: DataFrame, features: list[str], target: str) -> Predict:
        d = stratified_folds(train, target, ids, folds, "_fold")
        held = None
        for i in range(folds):
            p = fitter(d.filter(F.col("_fold") != i), features, target)(d.filter(F.col("_fold") == i))
            p = p.select(target, *[f"p{c}" for c in range(classes)])
            held = p if held is None else held.unionByName(p)
        held = held.persist()
        curves = {}
        for c in range(classes):
            one = assemble(held.withColumn("_y", F.when(F.col(target) == c, 1.0).otherwise(0.0)), [f"p{c}"])
            m = LogisticRegression(featuresCol="_f", labelCol="_y", maxIter=50).fit(one)
            curves[c] = (float(m.coefficients[0]), float(m.intercept))
        held.unpersist()
        inner = fitter(train, features, target)

        def predict(df: DataFrame) -> DataFrame:
            out = inner(df).withColumns({f"_q{c}": 1 / (1 + F.exp(-(F.col(f"p{c}") * a + b))) for c, (a, b) in curves.items()})
            total = sum((F.col(f"_q{c}") for c in range(1, classes)), F.col("_q0"))
            return out.withColumns({f"p{c}": F.col(f"_q{c}") / total for c in range(classes)}).drop(*[f"_q{c}" for c in range(classes)])
        return predict
    return run


# ------------------------------------------------------------------ comparison
def compare(fitters: Mapping[str, Fitter], fit_on: DataFrame, judge_on: DataFrame, features: list[str], target: str,
            keep: Sequence[str]) -> tuple[DataFrame, dict[str, Predict]]:
    """Predictions of every model on the judged rows, one below the other, and the fitted models."""
    out, fitted = None, {}
    for name, f in fitters.items():
        fitted[name] = f(fit_on, features, target)
        p = fitted[name](judge_on).select(*keep, F.lit(name).alias("modelo"))
        out = p if out is None else out.unionByName(p)
    return out, fitted


def permutation_importance(predict: Predict, df: DataFrame, features: Sequence[str], target: str, ids: Sequence[str], repeats: int = 5,
                           seed: int = SEED) -> DataFrame:
    """Rise of the mean absolute error when one feature is shuffled.

    One shuffle per repeat serves all features: every row meets a donor row by rank, and appears once
    per feature with that feature taken from the donor.
    """
    names = list(features)
    base = predict(df).agg(F.avg(F.abs(F.col(target) - F.col("prediccion")))).first()[0]
    here = positions(df.select(*ids, target, *names), [], list(ids), "_pos")
    total = None
    for r in range(repeats):
        donors = positions(df.select(*[F.col(i).alias(f"_{i}") for i in ids], *[F.col(n).alias(f"_d_{n}") for n in names])
                           .withColumn("_h", hash_order([f"_{i}" for i in ids], seed + r)), [], ["_h", *[f"_{i}" for i in ids]], "_pos")
        both = here.join(donors.select("_pos", *[f"_d_{n}" for n in names]), "_pos")
        each = both.withColumn("variable", F.explode(F.array(*[F.lit(n) for n in names])))
        mixed = each.withColumns({n: F.when(F.col("variable") == n, F.col(f"_d_{n}")).otherwise(F.col(n)) for n in names})
        mae = (predict(mixed).groupBy("variable").agg(F.avg(F.abs(F.col(target) - F.col("prediccion"))).alias("mae"))
               .select("variable", (F.col("mae") - F.lit(base)).alias("delta")))
        total = mae if total is None else total.unionByName(mae)
    return total.groupBy("variable").agg(F.avg("delta").alias("importancia"), F.stddev_pop("delta").alias("desv"))


def group_importance(importance: DataFrame, separator: str = "__") -> DataFrame:
    """Share of each variable group in the positive importances."""
    g = importance.groupBy(F.substring_index("variable", separator, 1).alias("grupo")).agg(F.sum(F.greatest("importancia", F.lit(0.0))).alias("_s"))
    total = g.agg(F.sum("_s")).first()[0] or 0.0
    return g.select("grupo", (F.col("_s") / F.lit(total if total > 0 else 1.0) * 100).alias("pct"))


def tree_importance(df: DataFrame, predict: Predict, features: Sequence[str], top: int = 10) -> DataFrame:
    model = predict.model
    v = model.importances if isinstance(model, boosting.Model) else model.featureImportances.toArray()
    rows = sorted(((f, float(x)) for f, x in zip(features, v, strict=True)), key=lambda r: (-r[1], r[0]))[:top]
    return df.sparkSession.createDataFrame(rows, "variable string, importancia double")


# ------------------------------------------------------------------ per series
def newton_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, start: np.ndarray | None = None) -> np.ndarray:
    """Weights (intercept last, not penalised) of L2 logistic regression."""
    z = np.column_stack([x, np.ones(len(x))])
    pen = np.append(np.full(x.shape[1], penalty), 0.0)
    w = np.zeros(z.shape[1]) if start is None else start.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(pen) + 1e-10 * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (p - y) + pen * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def walk_forward(panel: DataFrame, key: str, month: str, features: Sequence[str], target: str, start: float = 0.5) -> DataFrame:
    """Probability of class 1 for every month after ``start``, each from a model of the months before it.

    A series is one row per month, so it fits a task; series run in parallel.
    """
    cols, kind = list(features), panel.schema[key].dataType.simpleString()

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        g = g.dropna(subset=[*cols, target]).sort_values(month)
        x, y = g[cols].to_numpy(float), g[target].to_numpy(float)
        rows, w = [], None
        for t in range(int(len(g) * start), len(g)):
            if t < 2 or y[:t].min() == y[:t].max():
                p = float(y[:t].mean()) if t else 0.5
            else:
                w = newton_logistic(x[:t], y[:t], start=w)
                p = float(1 / (1 + np.exp(-np.clip(x[t] @ w[:-1] + w[-1], -35, 35))))
            rows.append((g[key].iloc[t], g[month].iloc[t], float(y[t]), p))
        return pd.DataFrame(rows, columns=[key, month, "y", "p"])

    short_series(panel, [key])
    return panel.select(key, month, target, *cols).groupBy(key).applyInPandas(solve, f"`{key}` {kind}, `{month}` date, y double, p double")
