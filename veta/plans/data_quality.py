"""Data-quality and catalog fronts over all tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from veta.operators import quality as op
from veta.plans.profiles import rounded
from veta.plans.registry import query
from veta.sources import catalog, roles

TODAY = "2001-01-01"
# Table, key and columns with their kind (n number, t time, s text, a array).
SHAPES = {
    "region": ("r_regionkey", "r_regionkey:n r_name:s"), "nation": ("n_nationkey", "n_nationkey:n n_name:s n_regionkey:n"),
    "customer": ("c_custkey", "c_custkey:n c_name:s c_nationkey:n c_acctbal:n c_mktsegment:s"),
    "supplier": ("s_suppkey", "s_suppkey:n s_name:s s_nationkey:n s_acctbal:n"),
    "part": ("p_partkey", "p_partkey:n p_name:s p_brand:s p_type:s p_size:n p_retailprice:n"),
    "orders": ("o_orderkey", "o_orderkey:n o_custkey:n o_orderstatus:s o_totalprice:n o_orderdate:t o_orderpriority:s"),
    "lineitem": ("l_orderkey", "l_orderkey:n l_partkey:n l_suppkey:n l_linenumber:n l_quantity:n l_extendedprice:n l_discount:n l_tax:n "
                               "l_returnflag:s l_linestatus:s l_shipdate:t"),
    "events": ("event_id", "event_id:n ts:t user_id:n event_type:s value:n props:s"),
    "documents": ("doc_id", "doc_id:n text:s lang:s source:s n_chars:n"), "embeddings": ("vec_id", "vec_id:n embedding:a label:n"),
    "pages": ("page_id", "page_id:n url:s html:s"), "benchmark": ("item_id", "item_id:n text:s"),
    "labels": ("doc_id", "doc_id:n quality:n toxic:n"), "conversations": (None, "conv_id:n turn:n role:s text:s"),
}


def frames(spark, sf):
    return {t: roles.table(spark, sf, t) for t in SHAPES}


def profile(spark, sf, exact=True):
    return op.profile_tables(frames(spark, sf), TODAY, {t: k for t, (k, _) in SHAPES.items()}, exact)


def profile_sql() -> str:
    parts = []
    for t, (key, cols) in SHAPES.items():
        for i, (c, k) in enumerate((x.split(":") for x in cols.split()), 1):
            value = {"n": f'CAST("{c}" AS DOUBLE)', "t": f'epoch("{c}")'}.get(k, "NULL::DOUBLE")
            rep = f'count(*) - count(DISTINCT "{c}")' if c == key else "NULL::BIGINT"
            late = f"coalesce(max(\"{c}\") > TIMESTAMP '{TODAY}', false)" if k == "t" else "false"
            neg = f'coalesce(min("{c}") < 0, false)' if k == "n" else "false"
            parts.append(f"SELECT '{t}' AS tabla, {i} AS pos, '{c}' AS columna, count(*) AS filas, count(*) - count(\"{c}\") AS nulos, "
                         f'count(DISTINCT "{c}") AS distintos, min({value}) AS minimo, max({value}) AS maximo, {neg} AS negativo, '
                         f"{late} AS futura, {rep} AS repetida FROM {t}")
    return "WITH perfil AS (" + "\nUNION ALL ".join(parts) + ")"


@query("dq_columns", f"""{profile_sql()} SELECT tabla, columna, filas, nulos, distintos, round(minimo, 4) + 0.0::DOUBLE AS minimo,
    round(maximo, 4) + 0.0::DOUBLE AS maximo, round(nulos * 100.0::DOUBLE / greatest(filas, 1), 2) AS null_pct FROM perfil""")
def dq_columns(spark, sf):
    """Profile of every column of every table (exact distinct counts)."""
    return rounded(profile(spark, sf).select("tabla", "columna", "filas", "nulos", "distintos", "minimo", "maximo", "null_pct"))


@query("dq_columns_sketch")
def dq_columns_sketch(spark, sf):
    """The same with approximate distinct counts: one pass per table, no shuffle of the values."""
    return rounded(profile(spark, sf, exact=False).select("tabla", "columna", "filas", "nulos", "distintos", "minimo", "maximo", "null_pct"))


@query("dq_flags", f"""{profile_sql()}, h AS (
      SELECT tabla, 10 + pos AS o, 'NEGATIVOS:' || columna AS t FROM perfil WHERE negativo
      UNION ALL SELECT tabla, 100 + pos, 'FECHAS_FUTURAS:' || columna FROM perfil WHERE futura
      UNION ALL SELECT tabla, 5, 'CONSTANTES:' || count(*) FROM perfil WHERE filas > 0 AND distintos <= 1 AND nulos < filas GROUP BY 1
      UNION ALL SELECT tabla, 1000, 'DUP_CLAVE:' || columna || '=' || repetida FROM perfil WHERE repetida > 0
      UNION ALL SELECT tabla, 1000, 'SIN_CLAVE' FROM perfil GROUP BY 1 HAVING max(repetida) IS NULL)
    SELECT p.tabla, max(filas) AS filas, count(*) AS columnas, round(max(nulos * 100.0::DOUBLE / greatest(filas, 1)), 2) AS max_nulo_pct,
      coalesce((SELECT string_agg(t, ' ' ORDER BY o) FROM h WHERE h.tabla = p.tabla), 'OK') AS flags FROM perfil p GROUP BY 1""")
def dq_flags(spark, sf):
    return op.flags(profile(spark, sf, exact=False))


@query("catalog_summary", "WITH r AS (" + " UNION ALL ".join(f"SELECT '{t}' AS tabla, count(*) AS registros FROM {t}" for t in SHAPES)
       + """), c AS (SELECT DISTINCT table_name, column_name, ordinal_position, CASE data_type WHEN 'INTEGER' THEN 'int' WHEN 'BIGINT' THEN 'bigint'
      WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' ELSE data_type END AS d
      FROM information_schema.columns)
    SELECT tabla, registros, CASE WHEN tabla IN ('events', 'embeddings', 'labels') THEN 'CSV' ELSE 'JSON' END AS formato,
      string_agg(column_name || ' ' || d, ', ' ORDER BY ordinal_position) AS columnas_tipos FROM r JOIN c ON table_name = tabla GROUP BY 1, 2""")
def catalog_summary(spark, sf):
    f = frames(spark, sf)
    return catalog.summarise(catalog.describe_frames(spark, f), catalog.row_counts(spark, f), ["events", "embeddings", "labels"])
