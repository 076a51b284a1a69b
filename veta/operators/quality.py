"""Data-quality profile: one aggregate per table, reported per column and per table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veta.functions.columns import has_odd_characters

# Columns of the copy tool that are allowed to be constant; share of nulls that is reported.
COPY_PREFIXES = ("_AIRBYTE_", "_AB_CDC_")
MANY_NULLS = 0.30
# Columns preferred as the key of a table, in this order.
KEY_PREFERENCE = ("ID_RECEPCION", "ID_VENTA", "ID_ENVIO", "ID_EMBARQUE", "ID_ASIGNACION", "ID_CONTROL", "ID_INVENTARIO", "ID_LOTE",
                  "ID_PRODUCCION", "ID_CONTRATO", "ID_PRODUCTOR", "ID_CLIENTE", "ID_SILO", "ID_PREDIO", "ID_PRODUCTO", "ID_CENTRO_ACOPIO",
                  "ID_PUERTO", "ID_PLANTA", "ID_TRANSPORTE", "TICK_ID", "LECTURA_ID", "_ID", "SENSOR_ID", "TICKET_ID", "ALERTA_ID", "ID_EVENTO")
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def choose_key(columns: Sequence[str], preference: Sequence[str] = KEY_PREFERENCE, prefix: str = "ID_") -> str | None:
    """First preferred column present, else the first with the prefix, else none."""
    upper = {c.upper(): c for c in reversed(columns)}
    for k in preference:
        if k in upper:
            return upper[k]
    return next((c for c in columns if c.upper().startswith(prefix)), None)


def profile_table(df: DataFrame, table: str, key: str | None, today: str, exact: bool = False) -> DataFrame:
    """Long column profile of one table.  Distinct values are approximate unless ``exact``; the key is always exact."""
    cells = []
    for i, f in enumerate(df.schema.fields, 1):
        c, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        number = kind.startswith(NUMERIC)
        time = kind.startswith(("timestamp", "date"))
        as_double = (c.cast("double") if number else
                     F.unix_micros(c.cast("timestamp")) / 1e6 if time else F.lit(None).cast("double"))
        clean = F.when(~F.isnan(as_double), as_double)
        text = f.dataType.simpleString() in ("string", "binary")
        # Long texts are told apart by a hash; the key is counted on its own below.
        distinct = F.approx_count_distinct(c) if not exact else F.lit(None).cast("long") if f.name == key else F.count_distinct(F.when(c.isNotNull(), F.xxhash64(c)) if text else c)
        late = F.coalesce(F.max(c) > F.lit(today).cast("timestamp"), F.lit(False)) if time else F.lit(False)
        cells.append(F.struct(F.lit(table).alias("tabla"), F.lit(i).alias("pos"), F.lit(f.name).alias("columna"), F.lit(kind).alias("tipo"),
                              F.count(F.lit(1)).alias("filas"), F.count_if(c.isNull()).alias("nulos"), distinct.alias("distintos"),
                              F.min(clean).alias("minimo"), F.max(clean).alias("maximo"),
                              (F.coalesce(F.min(clean) < 0, F.lit(False)) if number else F.lit(False)).alias("negativo"),
                              late.alias("futura")))
    found = df.agg(F.array(*cells).alias("_c")).select(F.explode("_c").alias("c")).select("c.*")
    if key is None:
        return found.withColumn("clave_repetida", F.lit(None).cast("long"))
    # The exact count of the key has a shuffle of its own: beside the sketches it would carry them along with every key.
    groups = df.groupBy(F.col(f"`{key}`").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    once = groups.agg(F.count("k").alias("_d"), F.coalesce(F.sum("n"), F.lit(0)).alias("_n")).withColumn("columna", F.lit(key))
    is_key = F.col("_d").isNotNull()
    return (found.join(once, "columna", "left").withColumn("distintos", F.when(is_key, F.col("_d")).otherwise(F.col("distintos")))
            .withColumn("clave_repetida", F.when(is_key, F.col("_n") - F.col("_d"))).select(*found.columns, "clave_repetida"))


def profile_tables(frames: Mapping[str, DataFrame], today: str, keys: Mapping[str, str | None] | None = None,
                   exact: bool = False) -> DataFrame:
    """Column profiles of many tables in one result."""
    out = None
    for name, df in frames.items():
        key = keys[name] if keys is not None else choose_key(df.columns)
        part = profile_table(df, name, key, today, exact)
        out = part if out is None else out.unionByName(part)
    share = F.col("nulos") / F.greatest("filas", F.lit(1))
    return out.withColumn("null_pct", F.round(share * 100, 2))


def flags(profile: DataFrame) -> DataFrame:
    """One row per table with its findings (``OK`` if none).  A table has few columns, so collecting them is safe."""
    share = F.col("nulos") / F.greatest("filas", F.lit(1))
    own = F.upper("columna").startswith(COPY_PREFIXES[0]) | F.upper("columna").startswith(COPY_PREFIXES[1])
    constant = (F.col("filas") > 0) & (F.col("distintos") <= 1) & (share < 1) & ~own

    def texts(name: str, condition) -> F.Column:
        hits = F.array_sort(F.collect_list(F.when(condition, F.struct("pos", F.concat(F.lit(name), F.col("columna")).alias("t")))))
        return F.transform(hits, lambda h: h["t"])

    g = profile.groupBy("tabla").agg(
        F.max("filas").alias("filas"), F.count(F.lit(1)).alias("columnas"),
        F.max(F.struct(share.alias("s"), (-F.col("pos")).alias("p"), F.col("columna").alias("c"))).alias("_w"),
        texts("TODA_NULA:", (share >= 1) & (F.col("filas") > 0)).alias("_null"),
        texts("NOMBRE_RARO:", has_odd_characters("columna")).alias("_odd"), F.count_if(constant).alias("_k"),
        texts("NEGATIVOS:", F.col("negativo")).alias("_neg"), texts("FECHAS_FUTURAS:", F.col("futura")).alias("_late"),
        F.max(F.when(F.col("clave_repetida").isNotNull(), F.struct("columna", "clave_repetida"))).alias("_key"))
    empty = F.array().cast("array<string>")
    one = lambda cond, text: F.when(cond, F.array(text)).otherwise(empty)
    found = F.concat(
        "_null", "_odd", one(F.col("filas") == 0, F.lit("VACIA")),
        one(F.col("_w.s") > MANY_NULLS, F.concat(F.lit("NULOS_ALTOS:"), F.col("_w.c"), F.lit("="),
                                                F.round(F.col("_w.s") * 100).cast("int").cast("string"), F.lit("%"))),
        one(F.col("_k") > 0, F.concat(F.lit("CONSTANTES:"), F.col("_k").cast("string"))), "_neg", "_late",
        one(F.col("_key").isNull(), F.lit("SIN_CLAVE")),
        one(F.col("_key.clave_repetida") > 0, F.concat(F.lit("DUP_CLAVE:"), F.col("_key.columna"), F.lit("="),
                                                      F.col("_key.clave_repetida").cast("string"))))
    return g.select("tabla", "filas", "columnas", F.round(F.col("_w.s") * 100, 2).alias("max_nulo_pct"),
                    F.when(F.size(found) > 0, F.array_join(found, " ")).otherwise("OK").alias("flags"))
