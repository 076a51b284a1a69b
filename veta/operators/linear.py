"""Second moments and what follows from them: covariance, components, ridge, discriminants, PLS.

The rows are reduced to a p x p table by one aggregate; only that table reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

# Up to this many columns the cross products are plain sums inside the JVM; beyond it the generated
# code would grow with the square of the columns, and Arrow batches are faster.
JVM_COLUMNS = 12


@dataclass
class Moments:
    """Count, means and centred cross products of the columns."""

    columns: list[str]
    n: float
    mean: np.ndarray
    cross: np.ndarray

    def covariance(self, ddof: int = 0) -> np.ndarray:
        return self.cross / max(self.n - ddof, 1)

    def pick(self, names: Sequence[str]) -> Moments:
        i = [self.columns.index(c) for c in names]
        return Moments(list(names), self.n, self.mean[i], self.cross[np.ix_(i, i)])


def _shifted(columns: Sequence[str], centre: Mapping[str, float]) -> list[Column]:
    return [F.col(c).cast("double") - F.lit(float(centre[c])) for c in columns]


def moments_by(df: DataFrame, columns: Sequence[str], label: str | None = None) -> dict:
    """Moments of all rows, or per label; rows with a null in any column are left out.

    The columns are shifted by rough means first, so that large levels do not swallow the spread.
    """
    columns = list(columns)
    d = df.dropna(subset=columns + ([label] if label else []))
    first = d.agg(*[F.avg(c).alias(c) for c in columns]).first()
    centre = {c: first[c] or 0.0 for c in columns}
    p = len(columns)
    if p > JVM_COLUMNS:
        return _moments_by_batches(d, columns, label, np.array([centre[c] for c in columns], float))
    x = _shifted(columns, centre)
    sums = [F.sum(v).alias(f"s{i}") for i, v in enumerate(x)]
    prods = [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(p) for j in range(i, p)]
    keyed = d.groupBy(label) if label else d.groupBy()
    out = {}
    for r in keyed.agg(F.count(F.lit(1)).alias("n"), *sums, *prods).collect():
        n = float(r["n"])
        if not n:
            continue
        s = np.array([r[f"s{i}"] for i in range(p)], float)
        c = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                c[i, j] = c[j, i] = r[f"p{i}_{j}"] - s[i] * s[j] / n
        out[r[label] if label else None] = Moments(columns, n, np.array([centre[k] for k in columns]) + s / n, c)
    return out


def _moments_by_batches(d: DataFrame, columns: list[str], label: str | None, centre: np.ndarray) -> dict:
    """The same for many columns: every task multiplies its Arrow batches and yields one table per label."""
    p = len(columns)
    kind = d.schema[label].dataType.simpleString() if label else "int"

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            keys = batch[label] if label else pd.Series(0, index=batch.index)
            for k, rows in batch.groupby(keys):
                z = np.column_stack([np.ones(len(rows)), rows[columns].to_numpy(float) - centre])
                held[k] = held.get(k, 0.0) + z.T @ z
        if held:
            yield pd.DataFrame({"k": list(held), "v": [t.ravel() for t in held.values()]})

    parts = d.select(*columns, *([label] if label else [])).mapInPandas(multiply, f"k {kind}, v array<double>")
    cells = parts.select("k", F.posexplode("v").alias("i", "x")).groupBy("k", "i").agg(F.sum("x").alias("x")).toPandas()
    out = {}
    for k, cell in cells.groupby("k"):
        t = cell.sort_values("i")["x"].to_numpy(float).reshape(p + 1, p + 1)
        n, s = t[0, 0], t[0, 1:]
        key = (k.item() if hasattr(k, "item") else k) if label else None
        out[key] = Moments(columns, float(n), centre + s / n, t[1:, 1:] - np.outer(s, s) / n)
    return out


def merge(parts: Sequence[Moments]) -> Moments:
    """Moments of the union of disjoint row sets."""
    n = sum(m.n for m in parts)
    mean = sum(m.n * m.mean for m in parts) / n
    cross = sum(m.cross + m.n * np.outer(m.mean - mean, m.mean - mean) for m in parts)
    return Moments(parts[0].columns, n, mean, cross)


def squared_error(m: Moments, features: Sequence[str], target: str, weights: np.ndarray, constant: float) -> float:
    """Sum of (y - Xw - b)^2 over the rows behind the moments."""
    part = m.pick([*features, target])
    v = np.append(-weights, 1.0)
    bias = part.mean @ v - constant
    return float(v @ part.cross @ v + part.n * bias * bias)


def cross_validated(df: DataFrame, features: Sequence[str], target: str, fold: str, fit, grid: Sequence) -> tuple[object, Moments]:
    """Best grid value over expanding folds, and the moments of all rows.

    One pass gives the moments of every fold; fitting and scoring the whole grid then needs no data.
    ``fit(moments, features, target, grid)`` returns {value: (weights, constant)}.
    """
    by = moments_by(df, [*features, target], fold)
    folds = sorted(by)
    loss = {g: 0.0 for g in grid}
    for i in range(1, len(folds)):
        models = fit(merge([by[f] for f in folds[:i]]), features, target, grid)
        for g in grid:
            loss[g] += squared_error(by[folds[i]], features, target, *models[g]) / by[folds[i]].n
    return min(grid, key=lambda g: loss[g]), merge(list(by.values()))


def moments(df: DataFrame, columns: Sequence[str]) -> Moments:
    return moments_by(df, columns)[None]


def linear_expression(columns: Sequence[str], weights: Sequence[float], constant: float = 0.0) -> Column:
    total = F.lit(float(constant))
    for c, w in zip(columns, weights, strict=True):
        total = total + F.col(c) * F.lit(float(w))
    return total


def affine(df: DataFrame, columns: Sequence[str], weights: np.ndarray, constants: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Columns x'w + b for every column of ``weights``; wide frames are multiplied in Arrow batches."""
    if len(columns) <= JVM_COLUMNS:
        return df.withColumns({n: linear_expression(columns, weights[:, i], constants[i]) for i, n in enumerate(names)})
    w, b = np.asarray(weights, float), np.asarray(constants, float)

    @F.pandas_udf(ArrayType(DoubleType()))
    def product(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(x.to_numpy()) @ w + b)) if len(x) else pd.Series([], dtype=object)

    d = df.withColumn("_affine", product(F.array(*[F.col(c).cast("double") for c in columns])))
    return d.withColumns({n: F.col("_affine")[i] for i, n in enumerate(names)}).drop("_affine")


# ------------------------------------------------------------------ principal components
@dataclass
class Components:
    columns: list[str]
    mean: np.ndarray
    scale: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @property
    def ratio(self) -> np.ndarray:
        return self.values / self.values.sum()

    def needed(self, share: float) -> int:
        return int(np.searchsorted(np.cumsum(self.ratio), share) + 1)

    def condition(self) -> float:
        return float(np.sqrt(self.values[0] / self.values[-1])) if self.values[-1] > 0 else float("inf")

    def project(self, df: DataFrame, k: int, prefix: str = "pc") -> DataFrame:
        w = self.vectors[:, :k] / self.scale[:, None]
        return affine(df, self.columns, w, -(self.mean @ w), [f"{prefix}{i + 1}" for i in range(k)])


def components(m: Moments, standardise: bool = True) -> Components:
    """Eigenvectors of the (standardised) covariance; the largest loading of each is made positive."""
    cov = m.covariance()
    scale = np.sqrt(np.clip(np.diag(cov), 0, None)) if standardise else np.ones(len(cov))
    scale = np.where(scale > 0, scale, 1.0)
    values, vectors = np.linalg.eigh(cov / np.outer(scale, scale))
    values, vectors = np.clip(values[::-1], 0, None), vectors[:, ::-1]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    return Components(m.columns, m.mean, scale, values, vectors * np.where(sign == 0, 1, sign))


def variance_table(df: DataFrame, c: Components) -> DataFrame:
    cum = np.cumsum(c.ratio)
    rows = [(i + 1, float(v), float(r), float(u)) for i, (v, r, u) in enumerate(zip(c.values, c.ratio, cum, strict=True))]
    return df.sparkSession.createDataFrame(rows, "componente int, varianza double, proporcion double, acumulada double")


def loading_table(df: DataFrame, c: Components, k: int = 5) -> DataFrame:
    rows = [(j + 1, name, float(c.vectors[i, j])) for j in range(min(k, len(c.values))) for i, name in enumerate(c.columns)]
    return df.sparkSession.createDataFrame(rows, "componente int, variable string, carga double")


def top_loadings(loadings: DataFrame, top: int = 6) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("componente").orderBy(F.desc(F.abs("carga")), "variable")
    return loadings.withColumn("puesto", F.row_number().over(w)).filter(F.col("puesto") <= top)


def group_shares(loadings: DataFrame, separator: str = "__") -> DataFrame:
    """Squared loadings per variable group, in percent of the component."""
    group = F.substring_index("variable", separator, 1)
    return loadings.groupBy("componente", group.alias("grupo")).agg((F.sum(F.col("carga") * F.col("carga")) * 100).alias("pct"))


# ------------------------------------------------------------------ regression
def standard_xy(m: Moments, features: Sequence[str], target: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled X'X, X'y and the scale of the features, from the moments of features and target."""
    part = m.pick([*features, target])
    # A constant feature's variance may come out slightly below 0.
    scale = np.sqrt(np.clip(np.diag(part.covariance()), 0, None))[:-1]
    scale = np.where(scale > 0, scale, 1.0)
    return part.cross[:-1, :-1] / np.outer(scale, scale), part.cross[:-1, -1] / scale, scale


def ridge_weights(m: Moments, features: Sequence[str], target: str, alphas: Sequence[float]) -> dict[float, tuple[np.ndarray, float]]:
    """Weights and intercept of |y - Xb|^2 + alpha |b|^2 on standardised features, for a whole grid from one table."""
    xx, xy, scale = standard_xy(m, features, target)
    part = m.pick([*features, target])
    out = {}
    for a in alphas:
        w = np.linalg.solve(xx + a * np.eye(len(xx)), xy) / scale
        out[float(a)] = (w, float(part.mean[-1] - w @ part.mean[:-1]))
    return out


def descend(q: np.ndarray, c: np.ndarray, flat: float, square: float, w: np.ndarray, tolerance: float, sweeps: int = 1000) -> np.ndarray:
    """Coordinate descent on w'qw / 2 - c'w + flat |w|_1 + square |w|^2 / 2, from ``w`` on.

    Only the moments are read.  Each sweep, which takes up coordinates and drops others, is followed by a move of those in
    use to their common optimum; if no other coordinate wants to move then, it is the optimum of all.  Otherwise sweeps go
    on until none moves a coordinate by more than ``tolerance``.
    """
    w, diagonal = w.copy(), np.diag(q).tolist()
    rest = c - q @ w
    for _ in range(sweeps):
        moved = 0.0
        for j, d in enumerate(diagonal):
            if d <= 0:
                continue
            old = w[j]
            pull = rest[j] + d * old
            new = (pull - flat if pull > flat else pull + flat if pull < -flat else 0.0) / (d + square)
            if new != old:
                rest -= q[j] * (new - old)
                moved = max(moved, abs(new - old))
                w[j] = new
        if to_signed_optimum(q, c, flat, square, w):
            break
        rest = c - q @ w
        if moved <= tolerance:
            break
    return w


def to_signed_optimum(q: np.ndarray, c: np.ndarray, flat: float, square: float, w: np.ndarray) -> bool:
    """Move the non-zero coordinates to where the loss is smallest for their signs; one that reaches 0 on the way is dropped.

    ``w`` is changed in place.  True if the coordinates at 0 have no reason to leave it, so that ``w`` is the optimum.
    """
    for _ in range(len(w) + 1):
        used = np.flatnonzero(w)
        if not len(used):
            break
        sign = np.sign(w[used])
        try:
            goal = np.linalg.solve(q[np.ix_(used, used)] + square * np.eye(len(used)), c[used] - flat * sign)
        except np.linalg.LinAlgError:
            return False
        off = np.flatnonzero(np.sign(goal) != sign)
        if not len(off):
            w[used] = goal
            break
        share = w[used][off] / (w[used][off] - goal[off])
        first = off[int(np.argmin(share))]
        w[used] += share.min() * (goal - w[used])
        w[used[first]] = 0.0
    slope = c - q @ w
    slope[np.flatnonzero(w)] = 0.0
    return bool((np.abs(slope) <= flat * (1 + 1e-9) + 1e-15).all())


def sparse_weights(m: Moments, features: Sequence[str], target: str, grid: Sequence[tuple[float, float]],
                   tolerance: float = 1e-5) -> dict[tuple[float, float], tuple[np.ndarray, float]]:
    """Weights and intercept of (mix, penalty) of the grid: |y - Xb|^2 / 2n + penalty (mix |b|_1 + (1 - mix) |b|^2 / 2) on
    standardised features.  One table of moments serves the whole grid; each penalty starts from the next larger one's weights."""
    xx, xy, scale = standard_xy(m, features, target)
    part, out = m.pick([*features, target]), {}
    q, c = xx / max(m.n, 1), xy / max(m.n, 1)
    spread = float(np.sqrt(max(part.covariance()[-1, -1], 0.0)))
    for mix in sorted({g[0] for g in grid}):
        w = np.zeros(len(c))
        for penalty in sorted((g[1] for g in grid if g[0] == mix), reverse=True):
            w = descend(q, c, penalty * mix, penalty * (1 - mix), w, tolerance * spread)
            out[mix, penalty] = (w / scale, float(part.mean[-1] - (w / scale) @ part.mean[:-1]))
    return out


def pls_weights(m: Moments, features: Sequence[str], target: str, counts: Sequence[int]) -> dict[int, tuple[np.ndarray, float]]:
    """Partial least squares with one target for several numbers of components, by deflating X'X and X'y."""
    xx, xy, scale = standard_xy(m, features, target)
    part = m.pick([*features, target])
    s, c = xx.copy(), xy.copy()
    ws, ps, qs, out = [], [], [], {}
    for k in range(1, max(counts) + 1):
        norm = np.linalg.norm(c)
        if norm > 1e-12:
            w = c / norm
            tt = float(w @ s @ w)
            if tt > 1e-12:
                p, q = s @ w / tt, float(c @ w) / tt
                ws.append(w), ps.append(p), qs.append(q)
                c = c - p * (q * tt)
                s = s - tt * np.outer(p, p)
        if k in counts:
            if ws:
                wm, pm = np.array(ws).T, np.array(ps).T
                b = wm @ np.linalg.solve(pm.T @ wm, np.array(qs)) / scale
            else:
                b = np.zeros(len(features))
            out[k] = (b, float(part.mean[-1] - b @ part.mean[:-1]))
    return out


# ------------------------------------------------------------------ discriminants
def lda_weights(by: Mapping, shrinkage: float = 0.0) -> dict:
    """Linear class scores (weights, constant) from per-class moments; shrinkage pulls the pooled
    covariance towards its mean variance."""
    n = sum(m.n for m in by.values())
    pooled = sum(m.cross for m in by.values()) / n
    p = len(pooled)
    pooled = (1 - shrinkage) * pooled + shrinkage * np.trace(pooled) / p * np.eye(p)
    inv = np.linalg.pinv(pooled)
    return {k: (inv @ m.mean, float(-0.5 * m.mean @ inv @ m.mean + np.log(m.n / n))) for k, m in by.items()}


def qda_terms(by: Mapping, reg: float = 0.5) -> dict:
    """(inverse covariance, mean, constant) per class; ``reg`` mixes in the identity."""
    n, out = sum(m.n for m in by.values()), {}
    for k, m in by.items():
        cov = (1 - reg) * m.cross / max(m.n - 1, 1) + reg * np.eye(len(m.mean))
        out[k] = (np.linalg.pinv(cov), m.mean, float(-0.5 * np.linalg.slogdet(cov)[1] + np.log(m.n / n)))
    return out


def lda_axes(by: Mapping) -> tuple[np.ndarray, np.ndarray]:
    """Share of discriminant variance and the axes (columns) that separate the classes best."""
    n = sum(m.n for m in by.values())
    mean = sum(m.n * m.mean for m in by.values()) / n
    within = sum(m.cross for m in by.values()) / n
    between = sum(m.n * np.outer(m.mean - mean, m.mean - mean) for m in by.values()) / n
    values, vectors = np.linalg.eigh(within + 1e-9 * np.trace(within) * np.eye(len(mean)))
    half = vectors @ np.diag(1 / np.sqrt(np.clip(values, 1e-12, None))) @ vectors.T
    lam, axes = np.linalg.eigh(half @ between @ half)
    k = min(len(by) - 1, len(mean))
    lam, axes = np.clip(lam[::-1][:k], 0, None), (half @ axes)[:, ::-1][:, :k]
    return lam / lam.sum() if lam.sum() > 0 else lam, axes


def _batch_probabilities(df: DataFrame, columns: Sequence[str], scores, names: Sequence[str]) -> DataFrame:
    """Class probabilities from ``scores`` (rows x columns -> rows x classes), in Arrow batches."""
    @F.pandas_udf(ArrayType(DoubleType()))
    def share(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        z = scores(np.stack(x.to_numpy()))
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return pd.Series(list(e / e.sum(axis=1, keepdims=True)))

    d = df.withColumn("_p", share(F.array(*[F.col(c).cast("double") for c in columns])))
    return d.withColumns({n: F.col("_p")[i] for i, n in enumerate(names)}).drop("_p")


def lda_probabilities(df: DataFrame, by: Mapping, names: Sequence[str], shrinkage: float = 0.0) -> DataFrame:
    w = lda_weights(by, shrinkage)
    weights, constants = np.column_stack([w[k][0] for k in sorted(w)]), np.array([w[k][1] for k in sorted(w)])
    return _batch_probabilities(df, next(iter(by.values())).columns, lambda x: x @ weights + constants, names)


def qda_probabilities(df: DataFrame, by: Mapping, names: Sequence[str], reg: float = 0.5) -> DataFrame:
    terms = [t for _, t in sorted(qda_terms(by, reg).items())]

    def scores(x: np.ndarray) -> np.ndarray:
        return np.column_stack([const - 0.5 * np.einsum("ij,jk,ik->i", x - mean, inv, x - mean) for inv, mean, const in terms])

    return _batch_probabilities(df, next(iter(by.values())).columns, scores, names)
