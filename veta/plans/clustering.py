"""Segments, regimes, outliers and their quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from veta.functions.columns import decimal_hour, log_skew
from veta.operators import clusters as op
from veta.operators import linear, prep, splits
from veta.operators import neighbours as nb
from veta.operators.profiles import PROFILE_FEATURES, SEGMENT_360_FEATURES
from veta.operators.sequence import quantiles
from veta.operators.summary import label_profile
from veta.plans import prices, profiles, sensors
from veta.plans.profiles import FACT_SQL, PROFILE_SQL, rounded
from veta.plans.registry import query
from veta.session import materialise
from veta.sources import roles
from veta.sources.roles import sql_with

# Restarts of the ready-made queries (the operators default to 20), and rows a sweep judges each k by.
RESTARTS, SWEEP_POINTS = 2, 5_000


def scaled(df, columns, ids, logs=True):
    """Log against skew, standardised, written once: every model and measure reads the same frame."""
    d = df.dropna(subset=list(columns)).select(*ids, *[(log_skew(c) if logs else F.col(c).cast("double")).alias(c) for c in columns])
    return materialise(prep.standardise(d, list(columns)))


def producer_matrix(spark, sf):
    d = prep.quarantine(profiles.profile(spark, sf), "id_productor", [525], PROFILE_FEATURES)
    return scaled(d, PROFILE_FEATURES, ["id_productor"])


def sweep(df, columns, ids, ks, restarts=RESTARTS):
    """Quality of every k and the labels side by side."""
    labels = op.sweep_labels(df, columns, ks, restarts)
    sil = op.silhouette_estimate(labels, columns, [f"k{k}" for k in ks], ids, SWEEP_POINTS)
    sep = op.separation(labels, columns, [f"k{k}" for k in ks])
    board = materialise(sil.select("etiqueta", "silueta", "puntos").join(sep, "etiqueta"))
    best = op.best_k({int(r["etiqueta"][1:]): r["silueta"] for r in board.select("etiqueta", "silueta").collect()})
    return labels, board, best


@query("kmeans_sweep")
def kmeans_sweep(spark, sf):
    """Producer segments: quality for k = 2..7."""
    _, board, _ = sweep(producer_matrix(spark, sf), PROFILE_FEATURES, ["id_productor"], range(2, 8))
    return rounded(board, 5)


@query("kmeans_profile")
def kmeans_profile(spark, sf):
    """Producer segments of the best k, described by the mean of every feature."""
    labels, _, k = sweep(producer_matrix(spark, sf), PROFILE_FEATURES, ["id_productor"], (2, 3, 4))
    seg = labels.select("id_productor", F.col(f"k{k}").alias("segmento"))
    return rounded(label_profile(profiles.profile(spark, sf).join(seg, "id_productor"), "segmento", PROFILE_FEATURES))


@query("segments_360")
def segments_360(spark, sf):
    """Four behaviour segments of the producers with contracts."""
    c = materialise(profiles.compliance(spark, sf))
    d = op.kmeans_labels(scaled(c, SEGMENT_360_FEATURES, ["id_productor"]), SEGMENT_360_FEATURES, 4, "seg360", RESTARTS)
    both = c.join(d.select("id_productor", "seg360"), "id_productor").withColumnRenamed("n", "n_entregas")
    return rounded(label_profile(both, "seg360", ["n_entregas", *SEGMENT_360_FEATURES[1:]]))


SENSOR_COLUMNS = ["temperatura_c", "humedad_relativa_pct", "precipitacion_mm", "calidad_senal_dbm", "hora"]


@query("sensor_regimes")
def sensor_regimes(spark, sf):
    """Operating regimes of the sensors: dominant regime and readings per sensor."""
    from veta.operators.sensors import dominant_regime

    d = roles.sensor_readings(spark, sf).withColumn("hora", decimal_hour("ts"))
    m = scaled(d, SENSOR_COLUMNS, ["id_lectura", "sensor_id"], logs=False)
    labels, _, k = sweep(m, SENSOR_COLUMNS, ["id_lectura"], (3, 4, 5))
    return dominant_regime(labels.withColumn("regimen", F.col(f"k{k}")))


@query("market_hour_regimes")
def market_hour_regimes(spark, sf):
    """Calm and volatile hours: profile of the regimes of the hourly bars."""
    cols = ["volatilidad", "volumen", "rango"]
    bars = materialise(sensors.bars(spark, sf))
    labels, _, k = sweep(scaled(bars, cols, ["ticker", "hora"]), cols, ["ticker", "hora"], (2, 3, 4), RESTARTS)
    d = bars.join(labels.select("ticker", "hora", F.col(f"k{k}").alias("regimen")), ["ticker", "hora"])
    return rounded(label_profile(d, "regimen", [*cols, "n_ticks"]))


DELIVERY = ["peso_neto", "humedad_pct", "impurezas_pct", "aceite_pct", "proteina_pct", "temperatura_grano_c"]


@query("delivery_types")
def delivery_types(spark, sf):
    """Types of delivery: profile of the clusters of the weigh-ins (gaps filled with medians)."""
    d = prep.median_fill(roles.receipts(spark, sf).filter(F.col("peso_neto").between(1, 200)).dropna(subset=DELIVERY[:3]), DELIVERY[3:])
    ids = ["id_recepcion", "id_parte", "id_silo", "fecha_hora"]
    labels, _, k = sweep(scaled(d, DELIVERY, ids), DELIVERY, ids, (3, 4, 5))
    return rounded(label_profile(labels.withColumnRenamed(f"k{k}", "tipo"), "tipo", DELIVERY), 3)


MARKET = ["soya_grano__ret_1m", "soya_aceite__ret_1m", "soya_harina__ret_1m", "petroleo__ret_1m", "maiz__ret_1m", "enso__anom"]


@query("market_regimes")
def market_regimes(spark, sf):
    """Month, regime and crisis mark of every series."""
    d = scaled(prices.features(spark, sf), MARKET, ["serie", "mes"], logs=False)
    labels, _, k = sweep(d, MARKET, ["serie", "mes"], range(2, 7), RESTARTS)
    crisis = nb.density_clusters(d, MARKET, 1.6, 12).select("serie", "mes", F.when(F.col("grupo") == -1, 1).otherwise(0).alias("crisis"))
    return labels.select("serie", "mes", F.col(f"k{k}").alias("regimen")).join(crisis, ["serie", "mes"])


@query("market_regime_anova")
def market_regime_anova(spark, sf):
    """Which variables separate the market regimes (F and p)."""
    from veta.operators.stats import anova

    d = scaled(prices.features(spark, sf), MARKET, ["serie", "mes"], logs=False)
    return rounded(anova(op.kmeans_labels(d, MARKET, 2, "regimen", RESTARTS), "regimen", MARKET), 6)


# ------------------------------------------------------------------ measures on fixed labels
FEW = ["volumen_total_tn", "humedad_media", "impurezas_media", "proteina_media", "pct_descuento"]
FEW_SQL = f"""{FACT_SQL}, {PROFILE_SQL}, m AS (SELECT {', '.join(f"avg(ln(1 + {c})) AS m_{c}, stddev_pop(ln(1 + {c})) AS s_{c}" for c in FEW)} FROM perfil),
    x AS (SELECT id_productor, id_productor % 3 AS g, {', '.join(f"(ln(1 + {c}) - m_{c}) / s_{c} AS {c}" for c in FEW)} FROM perfil CROSS JOIN m)"""
DIST = "sqrt(" + " + ".join(f"pow(a.{c} - b.{c}, 2)" for c in FEW) + ")"
PVIEWS = ("recepcion", "contrato", "productor")


def few(spark, sf):
    d = scaled(profiles.profile(spark, sf), FEW, ["id_productor"])
    return d.withColumn("g", F.pmod("id_productor", F.lit(3)))


@query("silhouette", sql_with(*PVIEWS, then=f""", {FEW_SQL}, d AS (SELECT a.id_productor AS i, a.g, b.g AS h, sum({DIST}) AS s, count(*) AS n FROM x a CROSS JOIN x b GROUP BY ALL),
    p AS (SELECT i, max(CASE WHEN g = h THEN s / (n - 1) END) AS a, min(CASE WHEN g <> h THEN s / n END) AS b FROM d GROUP BY 1)
    SELECT 'g' AS etiqueta, 3 AS k, round(avg((b - a) / greatest(a, b)), 6) + 0.0::DOUBLE AS silueta, count(*) AS puntos FROM p"""))
def silhouette(spark, sf):
    return rounded(op.silhouette(few(spark, sf), FEW, ["g"], ["id_productor"]), 6)


@query("cluster_separation", sql_with(*PVIEWS, then=f""", {FEW_SQL}, c AS (SELECT g, count(*) AS n, {', '.join(f'avg({c}) AS {c}' for c in FEW)} FROM x GROUP BY 1),
    t AS (SELECT {', '.join(f'avg({c}) AS {c}' for c in FEW)} FROM x), s AS (SELECT a.g, avg({DIST}) AS s, sum(pow({DIST}, 2)) AS w FROM x a JOIN c b ON a.g = b.g GROUP BY 1),
    r AS (SELECT a.g, max((sa.s + sb.s) / {DIST}) AS r FROM c a JOIN c b ON a.g <> b.g JOIN s sa ON sa.g = a.g JOIN s sb ON sb.g = b.g GROUP BY 1),
    bt AS (SELECT sum(a.n * pow({DIST}, 2)) AS b, sum(a.n) AS n FROM c a CROSS JOIN t b)
    SELECT 'g' AS etiqueta, 3 AS k, round((SELECT avg(r) FROM r), 5) AS davies_bouldin, round((b / 2) / ((SELECT sum(w) FROM s) / (n - 3)), 5) AS calinski_harabasz FROM bt"""))
def cluster_separation(spark, sf):
    return rounded(op.separation(few(spark, sf), FEW, ["g"]), 5)


@query("adjusted_rand", """WITH c AS (SELECT c_mktsegment AS a, c_nationkey % 4 AS b, count(*)::DOUBLE AS n FROM customer GROUP BY 1, 2),
    s AS (SELECT sum(n * (n - 1) / 2) AS ij, sum(n) AS t, (SELECT sum(x * (x - 1) / 2) FROM (SELECT sum(n) AS x FROM c GROUP BY a)) AS i,
      (SELECT sum(x * (x - 1) / 2) FROM (SELECT sum(n) AS x FROM c GROUP BY b)) AS j FROM c)
    SELECT 'seg' AS a, 'zona' AS b, CAST(t AS BIGINT) AS n, round((ij - i * j / (t * (t - 1) / 2)) / ((i + j) / 2 - i * j / (t * (t - 1) / 2)), 8) + 0.0::DOUBLE AS ari FROM s""")
def adjusted_rand(spark, sf):
    c = roles.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("seg"), F.pmod("c_nationkey", F.lit(4)).alias("zona"))
    return rounded(op.adjusted_rand(c, "seg", "zona"), 8)


@query("knn_distance_eps", sql_with(*PVIEWS, then=f""", {FEW_SQL}, d AS (SELECT a.id_productor, {DIST} AS d, row_number() OVER (PARTITION BY a.id_productor ORDER BY {DIST}) AS k
    FROM x a CROSS JOIN x b), e AS (SELECT d FROM d WHERE k = 10) SELECT round(quantile_cont(d, 0.95), 6) AS eps, count(*) AS n, round(avg(d), 6) AS media FROM e"""))
def knn_distance_eps(spark, sf):
    """Density radius: 95 % quantile of the distance to the 10th nearest point."""
    d = materialise(nb.kth_distance(few(spark, sf), FEW, 10, "id_productor"))
    eps = quantiles(d, "distancia", {"q": 0.95}).first()["q"]
    return rounded(d.agg(F.lit(eps).alias("eps"), F.count(F.lit(1)).alias("n"), F.avg("distancia").alias("media")), 6)


@query("dbscan_core_noise", sql_with(*PVIEWS, then=f""", {FEW_SQL}, d AS (SELECT a.id_productor, count(*) AS n FROM x a CROSS JOIN x b WHERE {DIST} <= 1.0 GROUP BY 1)
    SELECT id_productor, n::DOUBLE AS vecinos, n >= 12 AS nucleo FROM d"""))
def dbscan_core_noise(spark, sf):
    return nb.density_noise(few(spark, sf), FEW, 1.0, 12).select("id_productor", "vecinos", "nucleo")


@query("dbscan_clusters")
def dbscan_clusters(spark, sf):
    """Density clusters of the producers over all features, -1 for outliers; radius from the distance to the 2p-th neighbour."""
    m, p = producer_matrix(spark, sf), PROFILE_FEATURES
    least = 2 * len(p)
    eps = quantiles(nb.kth_distance(m, p, least, "id_productor"), "distancia", {"q": 0.90}).first()["q"]
    return nb.density_clusters(m, p, eps, least).select("id_productor", "vecinos", "nucleo", "grupo")


@query("producer_outliers", sql_with(*PVIEWS, then=f""", {FEW_SQL}, d AS (SELECT a.id_productor AS i, b.id_productor AS j FROM x a JOIN x b ON {DIST} <= 1.0),
    c AS (SELECT i FROM d GROUP BY 1 HAVING count(*) >= 12), r AS (SELECT i, max(CASE WHEN j IN (SELECT i FROM c) THEN 1 ELSE 0 END) AS alcanza FROM d GROUP BY 1)
    SELECT i AS id_productor, alcanza = 0 AS atipico FROM r"""))
def producer_outliers(spark, sf):
    """Producers that no dense spot reaches: neither core nor beside a core point."""
    return nb.density_clusters(few(spark, sf), FEW, 1.0, 12).select("id_productor", (F.col("grupo") == -1).alias("atipico"))


@query("producer_segments")
def producer_segments(spark, sf):
    """Segment of the best k for every producer, and whether density clusters leave it out as an outlier (radius: 95 % quantile)."""
    m, p = producer_matrix(spark, sf), PROFILE_FEATURES
    labels, _, k = sweep(m, p, ["id_productor"], (2, 3, 4))
    least = 2 * len(p)
    eps = quantiles(nb.kth_distance(m, p, least, "id_productor"), "distancia", {"q": 0.95}).first()["q"]
    out = nb.density_clusters(m, p, eps, least).select("id_productor", (F.col("grupo") == -1).alias("atipico"))
    return labels.select("id_productor", F.col(f"k{k}").alias("segmento")).join(out, "id_productor")


@query("cluster_stability")
def cluster_stability(spark, sf):
    """Agreement between seeds and between halves for two producer segments."""
    m = few(spark, sf)
    a = op.seed_stability(m, FEW, 2, restarts=RESTARTS).withColumn("prueba", F.lit("semillas"))
    b = op.split_half_stability(m, FEW, 2, ["id_productor"], RESTARTS).withColumn("prueba", F.lit("mitades"))
    return rounded(a.unionByName(b).select("prueba", "n", "ari", "estable"), 6)


@query("drift_monitor", """WITH c AS (SELECT c_custkey % 3 AS a, CASE WHEN c_custkey % 11 = 0 THEN 0 ELSE c_custkey % 3 END AS b FROM customer),
    j AS (SELECT a, b, count(*)::DOUBLE AS n FROM c GROUP BY 1, 2), s AS (SELECT sum(n * (n - 1) / 2) AS ij, sum(n) AS t,
      (SELECT sum(x * (x - 1) / 2) FROM (SELECT sum(n) AS x FROM j GROUP BY a)) AS i, (SELECT sum(x * (x - 1) / 2) FROM (SELECT sum(n) AS x FROM j GROUP BY b)) AS k FROM j),
    z AS (SELECT max(abs(nb - na) / na::DOUBLE) AS m FROM (SELECT a AS l, count(*) AS na FROM c GROUP BY 1) JOIN (SELECT b AS l, count(*) AS nb FROM c GROUP BY 1) USING (l)),
    r AS (SELECT (ij - i * k / (t * (t - 1) / 2)) / ((i + k) / 2 - i * k / (t * (t - 1) / 2)) AS ari, m FROM s CROSS JOIN z)
    SELECT round(ari, 6) AS ari, round(m, 6) AS cambio_max, (ari < 0.5 OR m > 0.3) AS redefinir FROM r""")
def drift_monitor(spark, sf):
    c, k = roles.table(spark, sf, "customer").select("c_custkey"), F.pmod("c_custkey", F.lit(3))
    old = c.withColumn("seg", k)
    new = c.withColumn("seg", F.when(F.pmod("c_custkey", F.lit(11)) == 0, F.lit(0).cast("long")).otherwise(k))
    return rounded(op.drift(old, new, "c_custkey", "seg"), 6)


# ------------------------------------------------------------------ components and dendrograms
def producer_components(spark, sf):
    d = prep.quarantine(profiles.profile(spark, sf), "id_productor", [525], PROFILE_FEATURES)
    d = materialise(d.select("id_productor", *[log_skew(c).alias(c) for c in PROFILE_FEATURES]))
    return d, linear.components(linear.moments(d, PROFILE_FEATURES))


@query("pca_variance")
def pca_variance(spark, sf):
    """Variance of every component, and the number needed for 80, 90, 95 and 99 percent."""
    d, c = producer_components(spark, sf)
    t = linear.variance_table(d, c)
    return rounded(t.withColumns({f"para_{int(s * 100)}": F.lit(c.needed(s)) for s in (0.80, 0.90, 0.95, 0.99)} | {"condicion": F.lit(c.condition())}), 6)


@query("pca_components")
def pca_components(spark, sf):
    """Strongest loadings of the first components."""
    d, c = producer_components(spark, sf)
    return rounded(linear.top_loadings(linear.loading_table(d, c, 3), 6), 6)


@query("pca_projection")
def pca_projection(spark, sf):
    """Producers on the first two components."""
    d, c = producer_components(spark, sf)
    return rounded(c.project(d, 2).select("id_productor", "pc1", "pc2"), 6)


@query("pca_group_share")
def pca_group_share(spark, sf):
    """Squared loadings of the price features by group, learned on the months of the training block."""
    f = prices.features(spark, sf)
    f = materialise(splits.purged(f, ["serie"], ["mes"], 3)).filter("split = 'train'")
    names = [c for c in prices.op.feature_names(f) if c.endswith(("ret_1m", "z_24m", "z24", "anom", "media6", "mes_sin", "mes_cos"))]
    return rounded(linear.group_shares(linear.loading_table(f, linear.components(linear.moments(f, names)), 5)), 5)


@query("hierarchy_groups")
def hierarchy_groups(spark, sf):
    """Profile of the groups of months, and of a top-down hierarchy over all receipts' producers."""
    m = few(spark, sf)
    return rounded(label_profile(op.bisecting_labels(m, FEW, 3, "rama"), "rama", FEW), 5)
