"""Small helpers shared by the text operators: table access, byte views of Arrow columns, query registration."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veta.session import shuffle_partitions, tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return fn(tune(spark), sf)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the names given as keywords; whatever else the input holds cannot clash."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def numbered(df: DataFrame) -> DataFrame:
    """The same columns named c0, c1, ..., so that columns added for a while cannot clash; ``named`` undoes it."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def named(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(like.columns)])


def at(df: DataFrame, column: str) -> str:
    """The name that ``numbered`` gives to a column."""
    return f"c{df.columns.index(column)}"


def process_memo(name: str, make: Callable[[], object]) -> object:
    """An object that lives as long as the worker process, so that later tasks find it filled."""
    home = sys.modules.setdefault("_veta_llm_process", types.ModuleType("_veta_llm_process")).__dict__
    if name not in home:
        home[name] = make()
    return home[name]


def trim() -> None:
    """Give memory that is free in this process back to the machine, where its C library can; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trimmed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, with free memory given back before the first and after each."""
    trim()
    for batch in batches:
        yield batch
        del batch
        trim()


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column without copying, and the n + 1 offsets of its values.  Nulls are empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0]: offsets[-1]], offsets - offsets[0]


def portions(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each; a longer value stands alone."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, min(end, rows)
        at = min(end, rows)


def partitions(spark: SparkSession) -> int:
    return shuffle_partitions(spark)
