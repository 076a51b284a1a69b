"""Near duplicates among embeddings by randomised-rotation binary codes.

Each vector is normalised and turned by a random rotation; the signs are its code.  With ``f``, the inner product of the
vector with its own code as a unit vector, stored beside the code, ``<code of x, y> / f`` estimates the cosine of x and y
without bias, and its error stays below ``EPS * sqrt(1 - f^2) / (f * sqrt(d - 1))`` but for a vanishing chance.  Only
pairs whose estimate plus bound reaches the threshold are recomputed from the vectors, in double precision.

Vectors meet in cells: ``k`` sign bits of the rotations make a cell, and there are as many tables of cells as give a pair
right at the threshold the chance ``recall`` of meeting.  k grows with the logarithm of the number of vectors, so that
cells keep their size.  A pair counts in the first table where it meets.  Cells with more than ``CHUNK`` vectors are
dealt in chunks, whose pairs are compared in different tasks; tasks give out counts and spanning forests, never pairs.
Equal vectors of a label are one node with a weight.

Vectors that are null, zero or hold null or non-finite components, and rows without label, link with nothing: no links,
and their own id as component.  Vectors of different length never link.  Repeated rows count as further vectors.  A null
id is never the smallest; where an id is null, kept tells whether the component id is null too.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veta.llm.common import narrow, query, table
from veta.llm.graph import components
from veta.session import materialise

CHUNK = 1024
#: Vectors that share a cell, over all labels.
CELL = 512
#: Chance that a pair right at the threshold meets in some table.
RECALL = 0.999
#: Width of the confidence bound; at 4 about one estimate in ten thousand is off by more.
EPS = 4.0


def layout(n: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a cell, tables) for ``n`` vectors."""
    k = max(1, round(math.log2(max(n, 1) / CELL))) if n > CELL else 1
    same = (1 - math.acos(threshold) / math.pi) ** k
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def cells(units: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Cell numbers (rows x tables) from the signs of as many rotations as needed."""
    dim = units.shape[1]
    signs = np.concatenate([units @ rotation(dim, s) > 0 for s in range(-(-bits * tables // dim))], axis=1)[:, : bits * tables]
    return (signs.reshape(len(units), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))).astype("<i8")


def codes(vectors: DataFrame, key: str, vector: str, label: str, layout_of: tuple[int, int]) -> DataFrame:
    """(key, label, dim, mark, vec, cells) of every row; mark and what follows are null for rows that link with nothing."""
    bits, tables = layout_of
    frame = narrow(vectors, key=key, label=label, vector=vector)
    kinds = {f.name: f.dataType.simpleString() for f in frame.schema}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            dim, mark, vec, cell = [None] * n, [None] * n, [None] * n, [None] * n
            col, lab = batch.column(2), batch.column(1)
            flat = col.flatten()
            sizes = np.diff(np.frombuffer(col.buffers()[1], np.int32)[col.offset: col.offset + n + 1]) if n else np.zeros(0, int)
            sizes = np.where(col.is_valid().to_numpy(zero_copy_only=False), sizes, 0)
            values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.cumsum(sizes) - sizes
            good = lab.is_valid().to_numpy(zero_copy_only=False) & (sizes > 0)
            for d in np.unique(sizes[good]):
                rows = np.flatnonzero(good & (sizes == d))
                x = values[starts[rows, None] + np.arange(d)] + 0.0
                top = np.abs(x).max(axis=1)
                fit = np.isfinite(top) & (top > 0)
                rows, x = rows[fit], x[fit]
                units = x / top[fit, None]
                units /= np.linalg.norm(units, axis=1)[:, None]
                at = cells(units, bits, tables)
                for i, v, c in zip(rows.tolist(), x, at, strict=True):
                    dim[i], vec[i], cell[i] = int(d), v.tobytes(), c.tolist()
                    mark[i] = hashlib.sha256(vec[i]).digest()[:16]
            yield pa.record_batch([batch.column(0), lab, pa.array(dim, pa.int32()), pa.array(mark, pa.binary()), pa.array(vec, pa.binary()),
                                   pa.array(cell, pa.list_(pa.int64()))], names=["key", "label", "dim", "mark", "vec", "cells"])

    return frame.mapInArrow(run, f"key {kinds['key']}, label {kinds['label']}, dim int, mark binary, vec binary, cells array<bigint>")


def estimates(a: np.ndarray, b: np.ndarray, eps: float = EPS) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of the rows of a and b (unit vectors, already rotated) from the codes of a, and their error bounds."""
    dim = a.shape[1]
    f = np.abs(a).sum(axis=1) / math.sqrt(dim)
    code = np.where(a > 0, 1, -1).astype(np.float32) / np.float32(math.sqrt(dim))
    bound = eps * np.sqrt(np.maximum(0, 1 - f * f)) / (f * math.sqrt(max(1, dim - 1))) + 1e-4
    return (code @ b.T.astype(np.float32)) / f[:, None].astype(np.float32), bound


def close_pairs(vec: np.ndarray, rot: np.ndarray, threshold: float, rows: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i in rows, j in others, i < j in node order) whose cosine reaches the threshold."""
    norm = np.linalg.norm(vec, axis=1)
    turned = (vec @ rot) / norm[:, None]
    found = []
    for s in range(0, len(rows), 256):
        part = rows[s: s + 256]
        value, bound = estimates(turned[part], turned[others])
        i, j = np.nonzero(value + bound[:, None] >= threshold)
        i, j = part[i], others[j]
        i, j = i[i < j], j[i < j]
        for t in range(0, len(i), 1 << 16):
            x, y = i[t: t + (1 << 16)], j[t: t + (1 << 16)]
            cos = np.einsum("ij,ij->i", vec[x], vec[y]) / (norm[x] * norm[y])
            found.append(np.stack([x[cos >= threshold], y[cos >= threshold]]))
    both = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return both[0], both[1]


def roots_of(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def compare(frame: DataFrame, threshold: float) -> DataFrame:
    """Rows (no, dim, own: list of members) -> (mark, found, other): weights linked with a node, or a link of the forest."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            mark, found, other = [], [], []
            for no, d, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                members = own.values
                marks = members.field("mark").to_pylist()
                side = members.field("side").to_numpy(zero_copy_only=False)
                vec = np.frombuffer(b"".join(members.field("vec").to_pylist())).reshape(len(marks), d)
                at = np.array(members.field("cells").to_pylist(), np.int64).reshape(len(marks), -1)
                if d not in turns:
                    turns[d] = rotation(d, 0)
                order = np.argsort(np.array(marks, dtype=object), kind="stable")
                vec, at, side, marks = vec[order], at[order], side[order], [marks[k] for k in order]
                weight = members.field("n").to_numpy(zero_copy_only=False)[order]
                every = np.arange(len(marks))
                i, j = close_pairs(vec, turns[d], threshold, every, every)
                crossing = (side[i] != side[j]) | (side[i] == 2)
                i, j = i[crossing], j[crossing]
                first = ~(at[i, :no] == at[j, :no]).any(axis=1)
                i, j = i[first], j[first]
                if not len(i):
                    continue
                total = np.bincount(i, weight[j], len(marks)) + np.bincount(j, weight[i], len(marks))
                root = roots_of(len(marks), i, j)
                for k in np.flatnonzero(total).tolist():
                    mark.append(marks[k])
                    found.append(int(total[k]))
                    other.append(marks[root[k]])
            yield pa.record_batch([pa.array(mark, pa.binary()), pa.array(found, pa.int64()), pa.array(other, pa.binary())], names=["mark", "found", "other"])

    return frame.select("no", "dim", "own").mapInArrow(run, "mark binary, found bigint, other binary")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                    recall: float = RECALL, chunk: int = CHUNK) -> DataFrame:
    """(key, n_links, component_id, kept) of every row."""
    plan = layout(vectors.count(), threshold, recall)
    rows = materialise(codes(vectors, key, vector, label, plan))
    nodes = (rows.where("mark is not null").groupBy("label", "dim", "mark")
             .agg(F.min("key").alias("least"), F.count("*").alias("n"), F.first("vec").alias("vec"), F.first("cells").alias("cells")))
    nodes = materialise(nodes)
    # Equal vectors under two labels are two nodes: the label is part of the name.
    named = nodes.withColumn("mark", F.concat("mark", F.encode(F.concat_ws("|", F.col("label").cast("string"), "dim"), "utf-8")))
    met = named.select("label", "dim", "mark", F.posexplode("cells").alias("no", "cell"))
    sizes = met.groupBy("label", "dim", "no", "cell").agg(F.count("*").alias("size")).where("size > 1")
    placed = (named.select("*", F.posexplode("cells").alias("no", "cell")).join(sizes, ["label", "dim", "no", "cell"])
              .withColumn("chunks", F.ceil(F.col("size") / chunk).cast("int"))
              .withColumn("chunk", F.pmod(F.xxhash64("mark"), F.col("chunks")).cast("int")))
    partner = F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(
        F.least(F.col("chunk"), j).alias("i"), F.greatest(F.col("chunk"), j).alias("j"))))
    # Side 2: the chunk meets itself; sides 0 and 1: only pairs across the two chunks count.
    member = F.struct("mark", "n", "vec", "cells", F.when(F.col("p.i") == F.col("p.j"), 2).when(F.col("chunk") == F.col("p.i"), 0).otherwise(1).alias("side"))
    groups = (placed.withColumn("p", partner).groupBy("label", "dim", "no", "cell", "p").agg(F.collect_list(member).alias("own")))
    found = materialise(compare(groups, threshold))
    roots = components(found.select(F.col("mark").alias("a"), F.col("other").alias("b"))).toDF("mark", "root")
    totals = found.groupBy("mark").agg(F.sum("found").alias("found"))
    linked = named.join(totals, "mark", "left").join(roots, "mark", "left").withColumn("root", F.coalesce("root", "mark"))
    ends = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    answers = (linked.join(ends, "root").select("label", "dim", F.substring("mark", 1, 16).alias("mark"), "component_id",
                                                (F.coalesce("found", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    return (rows.select("key", "label", "dim", "mark").join(answers, ["label", "dim", "mark"], "left")
            .withColumn("component_id", F.when(F.col("n_links").isNull(), F.col("key")).otherwise(F.col("component_id")))
            .select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id",
                    F.col("key").eqNullSafe(F.col("component_id")).alias("kept")))


ORACLE = """WITH RECURSIVE v AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, embedding::DOUBLE[] AS e,
      label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS fit FROM embeddings),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.r <> b.r AND a.fit AND b.fit AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
    c AS (SELECT vec_id AS a, vec_id AS c FROM v UNION SELECT l.b, c.c FROM c JOIN l ON l.a = c.a)
    SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, (SELECT min(c) FROM c WHERE c.a = vec_id) AS component_id,
      vec_id = (SELECT min(c) FROM c WHERE c.a = vec_id) AS kept FROM v"""


@query("op9_rotated_codes", ORACLE)
def op9_rotated_codes(spark, sf):
    return near_duplicates(table(spark, sf, "embeddings"))
