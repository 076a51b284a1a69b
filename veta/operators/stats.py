"""Statistics with closed forms: variance analysis, correlations, test statistics, time-series tests."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veta.functions.tails import beta_regularised, f_pvalue, f_tail, normal_cdf, t_pvalue  # noqa: F401
from veta.operators.sequence import attach, average_ranks, crowded, framed
from veta.session import materialise

# Response surface for the unit-root p-value with a constant (MacKinnon 1994).
TAU_MAX, TAU_MIN, TAU_STAR = 2.74, -18.83, -1.61
TAU_SMALL = (2.1659, 1.4412, 0.038269)
TAU_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
SERIES_LIMIT = 20_000


def anova(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """One-way F test of every column across the groups, from counts, means and variances."""
    agg = [F.struct(F.lit(c).alias("variable"), F.count(c).alias("n"), F.avg(c).alias("m"),
                    F.var_pop(c).alias("v")).alias(f"_{i}") for i, c in enumerate(columns)]
    per = (df.filter(F.col(group).isNotNull()).groupBy(group).agg(*agg)
           .select(F.explode(F.array(*[f"_{i}" for i in range(len(columns))])).alias("s")).select("s.*")
           .filter("n > 0"))
    total = per.groupBy("variable").agg(
        F.count(F.lit(1)).alias("grupos"), F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("m")).alias("s1"), F.sum(F.col("n") * F.col("v")).alias("dentro"),
        F.collect_list(F.struct("n", "m")).alias("g"))
    gm = F.col("s1") / F.col("n")
    between = F.aggregate("g", F.lit(0.0), lambda acc, g: acc + g["n"] * (g["m"] - gm) * (g["m"] - gm))
    d1, d2 = F.col("grupos") - 1, F.col("n") - F.col("grupos")
    f = (between / d1) / F.nullif(F.col("dentro") / d2, F.lit(0.0))
    out = total.select("variable", "grupos", "n", f.alias("f"), d1.cast("double").alias("_d1"), d2.cast("double").alias("_d2"))
    return out.withColumn("p", f_pvalue("f", "_d1", "_d2")).drop("_d1", "_d2")


def correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Pearson correlation of every pair in one pass."""
    row = df.agg(*[F.corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("r"))
                      for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(cells).alias("c")).select("c.*")


def strongest_pairs(df: DataFrame, left: Sequence[str], right: Sequence[str], top: int = 8) -> DataFrame:
    """Strongest correlations between two sets of variables."""
    return (correlations(df, [(a, b) for a in left for b in right])
            .orderBy(F.desc(F.abs("r")), "a", "b").limit(top))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return correlations(df, list(combinations(columns, 2)))


def spearman(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Rank correlation with average ranks.  Works on counted value pairs, so copies cost nothing."""
    out = None
    for a, b in pairs:
        both = (df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
                .groupBy(F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count(F.lit(1)).alias("_n")))
        ra = average_ranks(both.groupBy("_a").agg(F.sum("_n").alias("_na")), "_a", "_na", name="_ra").select("_a", "_ra")
        rb = average_ranks(both.groupBy("_b").agg(F.sum("_n").alias("_nb")), "_b", "_nb", name="_rb").select("_b", "_rb")
        x, y, n = F.col("_ra"), F.col("_rb"), F.col("_n")
        s = both.join(ra, "_a").join(rb, "_b").agg(
            F.sum(n).alias("n"), F.sum(n * x).alias("sx"), F.sum(n * y).alias("sy"), F.sum(n * x * y).alias("sxy"),
            F.sum(n * x * x).alias("sxx"), F.sum(n * y * y).alias("syy"))
        cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
        var = ((F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"))
               * (F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")))
        row = s.select(F.lit(a).alias("a"), F.lit(b).alias("b"), (cov / F.nullif(F.sqrt(var), F.lit(0.0))).alias("rho"))
        out = row if out is None else out.unionByName(row)
    return out


def rank_correlation(df: DataFrame, a: str, b: str, keys: Sequence[str]) -> DataFrame:
    """Rank correlation of two columns in every group of ``keys`` (null keys are a group), with average ranks; null where a column is constant."""
    keys = list(keys)
    # Written: the ranks of each side read the counted pairs three times.
    both = materialise(df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
                       .groupBy(*keys, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count(F.lit(1)).alias("_n")))
    for side in ("_a", "_b"):
        counted = both.groupBy(*keys, side).agg(F.sum("_n").alias("_m"))
        ranks = average_ranks(counted, side, "_m", keys, f"{side}_rank").select(*keys, side, f"{side}_rank")
        both = attach(both, ranks, [*keys, side])
    x, y, n = F.col("_a_rank"), F.col("_b_rank"), F.col("_n")
    s = both.groupBy(*keys).agg(F.sum(n).alias("n"), F.sum(n * x).alias("sx"), F.sum(n * y).alias("sy"), F.sum(n * x * y).alias("sxy"),
                                F.sum(n * x * x).alias("sxx"), F.sum(n * y * y).alias("syy"))
    sx, sy, total = F.col("sx"), F.col("sy"), F.col("n")
    spread = (F.col("sxx") - sx * sx / total) * (F.col("syy") - sy * sy / total)
    return s.select(*keys, "n", ((F.col("sxy") - sx * sy / total) / F.nullif(F.sqrt(spread), F.lit(0.0))).alias("rho"))


def holm(df: DataFrame, family: Sequence[str], p: str, ties: Sequence[str], alpha: float = 0.05,
         name: str = "rechaza") -> DataFrame:
    """Step-down rejection per family.  A family is one row per model, so its window is short by nature."""
    known = F.col(p).isNotNull()
    w = Window.partitionBy(*family).orderBy(F.asc_nulls_last(p), *ties)
    m = F.count(p).over(Window.partitionBy(*family))
    step = F.when(known & (F.col(p) <= F.lit(alpha) / (m - F.row_number().over(w) + 1)), 1).otherwise(0)
    return (df.withColumn("_s", step)
            .withColumn(name, F.min("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1).drop("_s"))


def diebold_mariano(df: DataFrame, keys: Sequence[str], order: Sequence[str], actual: str, predicted: str,
                    horizon: int) -> DataFrame:
    """Squared-error loss against a forecast of no change, with the small-sample correction."""
    e = F.col(actual) - F.col(predicted)
    d = df.withColumn("_d", F.col(actual) * F.col(actual) - e * e)
    lags = range(1, horizon)
    if lags:
        d = framed(d, keys, order, [lambda w: {f"_d{k}": F.lag("_d", k).over(w) for k in lags}], before=horizon)
    s = F.var_pop("_d")
    for k in lags:
        s = s + 2 * F.covar_pop("_d", f"_d{k}")
    g = d.groupBy(*keys).agg(F.count("_d").alias("n"), F.avg("_d").alias("_m"), s.alias("_s"))
    n, h = F.col("n"), horizon
    stat = F.col("_m") / F.sqrt(F.col("_s") / n) * F.sqrt((n + (1 - 2 * h) + F.lit(h * (h - 1.0)) / n) / n)
    out = g.withColumn("dm", F.when((n >= 10) & (F.col("_s") > 0), stat)).drop("_m", "_s")
    return out.withColumn("p", t_pvalue("dm", (F.col("n") - 1).cast("double")))


def short_series(df: DataFrame, keys: Sequence[str], limit: int = SERIES_LIMIT) -> DataFrame:
    """Guard for per-series solvers: a series must fit one task.  Panels have one row per key and month."""
    if crowded(df, keys, limit):
        raise ValueError(f"a series has more than {limit} rows; aggregate it to a calendar first")
    return df


def _ssr(y: np.ndarray, x: np.ndarray) -> float:
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    r = y - x @ beta
    return float(r @ r)


def granger_table(y: np.ndarray, x: np.ndarray, max_lag: int) -> list[tuple[int, float, float]]:
    """(lag, F, p) of the test that x helps to predict y."""
    rows = []
    for lag in range(1, max_lag + 1):
        n = len(y) - lag
        d2 = n - 2 * lag - 1
        if d2 <= 0:
            break
        past = lambda v, lag=lag: np.column_stack([v[lag - k:len(v) - k] for k in range(1, lag + 1)])
        own = np.column_stack([past(y), np.ones(n)])
        r, u = _ssr(y[lag:], own), _ssr(y[lag:], np.column_stack([past(x), own]))
        f = (r - u) / lag / (u / d2) if u > 0 else float("nan")
        rows.append((lag, f, f_tail(f, lag, d2)))
    return rows


# ------------------------------------------------------------------ lagged moments
@dataclass
class LagTable:
    """Cross products of a series' rows with all ``lags`` before them, and the few rows at its beginning that have fewer.

    A column of the table belongs to a lag; row ``i`` of ``edges`` has ``reach[i]`` lags and NaN in columns beyond.
    """

    table: np.ndarray
    edges: np.ndarray
    reach: np.ndarray

    def since(self, lag: int) -> np.ndarray:
        """Cross products over all rows with at least ``lag`` lags; columns of larger lags are not to be read."""
        z = np.nan_to_num(self.edges[self.reach >= lag])
        return self.table + z.T @ z


def residual(m: np.ndarray, target: int, by: Sequence[int]) -> tuple[float, np.ndarray]:
    """Sum of squares that is left of a column after regression on others, and the weights, from their cross products."""
    by = list(by)
    g, c = m[np.ix_(by, by)], m[by, target]
    d = np.sqrt(np.clip(np.diag(g), 0, None))
    d = np.where(d > 0, d, 1.0)
    w = np.linalg.lstsq(g / np.outer(d, d), c / d, rcond=1e-13)[0] / d
    return max(float(m[target, target] - 2 * w @ c + w @ g @ w), 0.0), w


def lag_tables(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], lags: int, build: Callable[[list[np.ndarray]], np.ndarray],
               solve: Callable[[LagTable], list[tuple]], schema: str) -> DataFrame:
    """``solve``'s rows for every series of ``keys``, from its table of lagged cross products.

    Rows with a null in a value are left out first, so lags count the rows that remain.  ``build`` turns (rows x lags + 1)
    values, the newest first, into the columns of the table.  Values are shifted by their mean.  A series may be as long as it
    likes: its rows are multiplied where they are, and a table a task and the first ``lags`` rows are all that meet.
    """
    keys, names = list(keys), [f"_v{i}" for i in range(len(values))]
    d = df.select(*keys, *order, *[F.col(v).cast("double").alias(n) for v, n in zip(values, names, strict=True)])
    d = d.where(reduce(Column.__and__, [F.col(n).isNotNull() & ~F.isnan(n) for n in names]))
    means = d.groupBy(*keys).agg(*[F.avg(n).alias(f"{n}_mean") for n in names])
    d = d.join(means, keys).withColumns({n: F.col(n) - F.col(f"{n}_mean") for n in names}).drop(*[f"{n}_mean" for n in names])
    past = framed(d, keys, order, [lambda w: {f"_a{i}": F.collect_list(n).over(w.rowsBetween(-lags, 0)) for i, n in enumerate(names)}], before=lags)
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    arrays = [f"_a{i}" for i in range(len(names))]

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            out = []
            for key, rows in batch.groupby(keys, dropna=False, sort=False):
                size = rows[arrays[0]].map(len).to_numpy()
                wide = []
                for a in arrays:
                    x = np.full((len(rows), lags + 1), np.nan)
                    for i, v in enumerate(rows[a]):
                        x[i, : len(v)] = v[::-1]
                    wide.append(x)
                z = build(wide)
                full = size == lags + 1
                if full.any():
                    held[key] = held.get(key, 0.0) + z[full].T @ z[full]
                out += [(*key, int(n) - 1, r.tobytes()) for r, n in zip(z[~full], size[~full], strict=True)]
            if len(held) > 4096:
                out += [(*k, None, t.tobytes()) for k, t in held.items()]
                held = {}
            yield frame(out)
        yield frame([(*k, None, t.tobytes()) for k, t in held.items()])

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[*keys, "_reach", "_data"]).astype({"_reach": "Int32"})

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        edge = group["_reach"].notna()
        z = np.array([np.frombuffer(x) for x in group["_data"][edge]])
        tables = [np.frombuffer(x) for x in group["_data"][~edge]]
        width = z.shape[1] if len(z) else int(np.sqrt(len(tables[0])))
        total = sum(tables, np.zeros(width * width)).reshape(width, width)
        found = solve(LagTable(total, z.reshape(-1, width), group["_reach"][edge].to_numpy(int)))
        own = tuple(group[keys].iloc[0])
        return pd.DataFrame([(*own, *r) for r in found], columns=[*keys, *[c.split()[0] for c in schema.split(", ")]])

    parts = past.select(*keys, *arrays).mapInPandas(multiply, f"{kinds}, _reach int, _data binary")
    return parts.groupBy(*keys).applyInPandas(finish, f"{kinds}, {schema}")


def granger_rows(t: LagTable, lags: int) -> list[tuple[int, float, float]]:
    """(lag, F, p) for each lag; the columns are one, the effect and its lags, the cause and its lags."""
    rows = []
    for lag in range(1, lags + 1):
        m = t.since(lag)
        own, other = [0, *range(2, lag + 2)], list(range(lags + 3, lags + 3 + lag))
        n = int(round(m[0, 0]))
        d2 = n - 2 * lag - 1
        if d2 <= 0:
            break
        r, u = residual(m, 1, own)[0], residual(m, 1, own + other)[0]
        f = (r - u) / lag / (u / d2) if u > 0 else float("nan")
        rows.append((lag, f, f_tail(f, lag, d2)))
    return rows


def granger(panel: DataFrame, key: str, month: str, pairs: Sequence[tuple[str, str]], max_lag: int = 6) -> DataFrame:
    """Causality tests (cause, effect) at lags 1..max_lag for every series of the panel, however long.

    All pairs are told apart as series of their own and share one pass; both regressions of every lag come from one table.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("causa"), F.lit(e).alias("efecto"), F.col(f"`{e}`").cast("double").alias("_y"), F.col(f"`{c}`").cast("double").alias("_x"))
                               for c, e in pairs]))
    rows = panel.select(key, month, each.alias("_p")).select(key, month, "_p.*")

    def build(past: list[np.ndarray]) -> np.ndarray:
        return np.column_stack([np.ones(len(past[0])), *past])

    return lag_tables(rows, [key, "causa", "efecto"], [month], ["_y", "_x"], max_lag, build, lambda t: granger_rows(t, max_lag), "rezago int, f double, p double")


def granger_summary(tests: DataFrame, keys: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Smallest p, its lag, the significant lags and the Bonferroni-adjusted p."""
    lag_hits = F.array_sort(F.collect_list(F.when(F.col("p") < alpha, F.col("rezago"))))
    return tests.groupBy(*keys, "causa", "efecto").agg(
        F.min("p").alias("p_min"), F.min_by("rezago", "p").alias("mejor_rezago"), lag_hits.alias("rezagos"),
        F.least(F.lit(1.0), F.min("p") * F.count("p")).alias("p_bonferroni"))


def unit_root_p(stat: float) -> float:
    if stat > TAU_MAX:
        return 1.0
    if stat < TAU_MIN:
        return 0.0
    coef = TAU_SMALL if stat <= TAU_STAR else TAU_LARGE
    return normal_cdf(sum(c * stat**i for i, c in enumerate(coef)))


def adf_statistic(x: np.ndarray) -> tuple[float, int, float]:
    """(t statistic, lag by AIC, p) of the unit-root regression with a constant."""
    n = len(x)
    top = min(int(np.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)
    dx = np.diff(x)

    def fit(lag: int, skip: int) -> tuple[float, float]:
        y = dx[skip:]
        z = np.column_stack([x[skip:-1], *[dx[skip - k:len(dx) - k] for k in range(1, lag + 1)], np.ones(len(y))])
        beta, *_ = np.linalg.lstsq(z, y, rcond=None)
        r = y - z @ beta
        rss, m, k = float(r @ r), len(y), z.shape[1]
        aic = m * (np.log(2 * np.pi * rss / m) + 1) + 2 * k
        se = np.sqrt(rss / (m - k) * np.linalg.pinv(z.T @ z)[0, 0])
        return aic, float(beta[0] / se)

    best = min(range(top + 1), key=lambda lag: fit(lag, top)[0])
    stat = fit(best, best)[1]
    return stat, best, unit_root_p(stat)


def adf_lags(n: int) -> int:
    """Largest lag that a series of ``n`` values is tested with."""
    return min(int(np.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)


def adf_rows(t: LagTable, lags: int) -> list[tuple[int, float, int, float]]:
    """(n, statistic, lag, p); the columns are one, the step, the level before it, and the steps before it."""
    # The first value has no step: it is the edge row without lags.
    n = int(round(t.since(1)[0, 0])) + 1
    if n < 12:
        return []
    top = adf_lags(n)

    def fit(lag: int, skip: int) -> tuple[float, float]:
        m = t.since(skip + 1)
        by = [2, 0, *range(3, lag + 3)]
        rss, w = residual(m, 1, by)
        rows, k = m[0, 0], len(by)
        g = m[np.ix_(by, by)]
        d = np.sqrt(np.where(np.diag(g) > 0, np.diag(g), 1.0))
        spread = np.linalg.pinv(g / np.outer(d, d))[0, 0] / d[0] ** 2
        with np.errstate(divide="ignore", invalid="ignore"):
            aic = rows * (np.log(2 * np.pi * rss / rows) + 1) + 2 * k
            return aic, float(w[0] / np.sqrt(rss / (rows - k) * spread))

    best = min(range(top + 1), key=lambda lag: fit(lag, top)[0])
    stat = fit(best, best)[1]
    return [(n, stat, best, unit_root_p(stat))] if np.isfinite(stat) else []


def adf(panel: DataFrame, key: str, month: str, columns: Sequence[str]) -> DataFrame:
    """Stationarity test of every column of every series, however long; constant columns and series below 12 values have no row."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"`{c}`").cast("double").alias("_x")) for c in columns]))
    rows = panel.select(key, month, each.alias("_p")).select(key, month, "_p.*").where(F.col("_x").isNotNull())
    kept = rows.groupBy(key, "variable").agg(F.count("*").alias("_n"), F.stddev_pop("_x").alias("_s")).where("_n >= 12 AND _s > 0").drop("_s")
    most = kept.agg(F.max("_n")).first()[0]
    lags = adf_lags(most) if most else 1

    def build(past: list[np.ndarray]) -> np.ndarray:
        x = past[0]
        step = x[:, :-1] - x[:, 1:]
        return np.column_stack([np.ones(len(x)), step[:, 0], x[:, 1], step[:, 1:]])

    d = rows.join(kept.drop("_n"), [key, "variable"], "left_semi")
    return lag_tables(d, [key, "variable"], [month], ["_x"], lags + 1, build, lambda t: adf_rows(t, lags), "n long, adf double, rezago int, p double")
