"""Association rules over discretised rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veta.functions.columns import item, right_closed
from veta.operators.prep import quantile_bins
from veta.session import materialise


def delivery_items(receipts: DataFrame, weight: str = "peso_neto") -> DataFrame:
    """Volume, moisture, impurity and quality classes of every delivery."""
    d = quantile_bins(receipts, weight, ["chico", "medio", "grande"], "VOL")
    return d.withColumns({
        "HUM": right_closed("humedad_pct", [-1, 12, 14, 100], ["seca", "limite", "humeda"]),
        "IMP": right_closed("impurezas_pct", [-1, 0.5, 1, 100], ["limpio", "borde", "sucio"]),
        "CAL": F.coalesce(F.col("calidad_grano").cast("string"), F.lit("?"))})


def transactions(df: DataFrame, columns: Sequence[str], name: str = "items") -> DataFrame:
    """``COLUMN=value`` tokens of every row; nulls give no token."""
    return df.select(F.array_sort(F.array_distinct(F.filter(F.array(*[item(c, c) for c in columns]), lambda x: x.isNotNull()))).alias(name))


def frequent_itemsets(trans: DataFrame, min_support: float = 0.05, max_len: int = 3, items: str = "items") -> DataFrame:
    """Item sets of up to ``max_len`` items with at least the given support.

    Equal transactions are counted first.  Items that are not frequent alone are removed before the
    subsets of the remaining (few, distinct) transactions are listed.
    """
    if not 1 <= max_len <= 3:
        raise ValueError("max_len must be 1, 2 or 3")
    counted = materialise(trans.groupBy(F.col(items).alias("t")).agg(F.count(F.lit(1)).alias("n")))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = min_support * total - 1e-9
    single = counted.select(F.explode("t").alias("i"), "n").groupBy("i").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    # At most (items per row) / min_support items can be frequent, so the list is short.
    keep = [r["i"] for r in single.select("i").collect()]
    if not keep:
        return trans.sparkSession.createDataFrame([], "conjunto array<string>, n long, soporte double")
    slim = (counted.select(F.array_intersect("t", F.array(*[F.lit(k) for k in keep])).alias("t"), "n")
            .select(F.array_sort("t").alias("t"), "n").groupBy("t").agg(F.sum("n").alias("n")))
    later = lambda i: F.slice("t", i + 2, F.size("t"))
    ones = F.transform("t", lambda a: F.array(a))
    subsets = [ones]
    if max_len >= 2:
        subsets.append(F.flatten(F.transform("t", lambda a, i: F.transform(later(i), lambda b: F.array(a, b)))))
    if max_len >= 3:
        subsets.append(F.flatten(F.transform("t", lambda a, i: F.flatten(F.transform(
            later(i), lambda b, j: F.transform(F.slice("t", i + j + 3, F.size("t")), lambda c: F.array(a, b, c)))))))
    listed = slim.select(F.explode(F.concat(*subsets)).alias("conjunto"), "n")
    return (listed.groupBy("conjunto").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
            .withColumn("soporte", F.col("n") / F.lit(float(total))))


def association_rules(itemsets: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """Rules antecedent => consequent for every split of every frequent set."""
    sets = itemsets.select("conjunto", "soporte")
    size = F.size("conjunto")
    masks = F.sequence(F.lit(1), F.pow(F.lit(2), size).cast("int") - 2)
    split = sets.filter(size >= 2).select("conjunto", "soporte", F.explode(masks).alias("m"))
    chosen = lambda x, i: F.col("m").bitwiseAND(F.pow(F.lit(2), i).cast("int")) > 0  # noqa: E731, ARG005
    ante = F.filter("conjunto", chosen)
    split = split.withColumn("antecedente", ante).withColumn("consecuente", F.array_except("conjunto", "antecedente"))
    a = sets.select(F.col("conjunto").alias("antecedente"), F.col("soporte").alias("_sa"))
    c = sets.select(F.col("conjunto").alias("consecuente"), F.col("soporte").alias("_sc"))
    conf = F.col("soporte") / F.col("_sa")
    return (split.join(a, "antecedente").join(c, "consecuente").withColumn("confianza", conf)
            .filter(F.col("confianza") >= min_confidence).withColumn("lift", F.col("confianza") / F.col("_sc"))
            .select("antecedente", "consecuente", "soporte", "confianza", "lift"))


def top_rules(rules: DataFrame, top: int = 15) -> DataFrame:
    return rules.orderBy(F.desc("lift"), F.desc("soporte"), F.array_join("antecedente", ","), F.array_join("consecuente", ",")).limit(top)
