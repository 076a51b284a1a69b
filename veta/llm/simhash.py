"""SimHash near duplicates: fingerprints, pigeonhole blocks, Hamming check, components.

A fingerprint of 64 bits is cut into ``BLOCKS`` blocks.  Two fingerprints with at most ``bits`` differing bits agree in
at least ``BLOCKS - bits`` whole blocks, so they meet under the key of one such choice of blocks; there the distance is
worked out.  With six blocks and three bits a key holds 32 bits, so that keys stay rare among billions of fingerprints.

Equal fingerprints are one node, however many documents share it.  Under a key only a spanning forest of the links is
given out, never all pairs; keys with more than ``CHUNK`` fingerprints are dealt in chunks, and pairs of chunks are
compared in different tasks.

Nulls and texts without words have fingerprint zero and link like any other.  A null id never is the smallest id of its
component; a component of null ids alone has a null component id.  Repeated rows are returned as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veta.llm.common import at, byte_view, named, narrow, numbered, portions, query, table
from veta.llm.graph import components
from veta.session import materialise

BLOCKS, BITS = 6, 3
#: Fingerprints under one key that a task compares with each other.
CHUNK = 2048
#: Bytes of text worked on at once.
PORTION = 1 << 20


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with A-Z in lower case and one space after each word, starts and ends of the words in them, words of each text."""
    low = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    space = (low == 32) | ((low >= 9) & (low <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([True], space[:-1])) | edge[:-1] if len(data) else np.zeros(0, bool)
    first = ~space & before
    keep = ~space | ~before
    low[space] = 32
    place = np.concatenate(([0], np.cumsum(keep)))
    starts = np.flatnonzero(first)
    after = (np.concatenate((space[1:], [True])) | edge[1:]) if len(data) else np.zeros(0, bool)
    ends = np.flatnonzero(~space & after) + 1
    return low[keep], place[starts], place[ends], np.diff(np.searchsorted(starts, offsets))


def shingle_spans(starts: np.ndarray, ends: np.ndarray, words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all runs of ``size`` words of each text (the whole where it has fewer) and runs of each text."""
    counts = np.where(words >= size, words - size + 1, np.minimum(words, 1))
    base = np.cumsum(words) - words
    own = np.repeat(np.arange(len(words)), counts)
    word = base[own] + np.arange(len(own)) - (np.cumsum(counts) - counts)[own]
    return starts[word], ends[word + np.minimum(words, size)[own] - 1], counts


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    import xxhash

    text, starts, ends, words = word_spans(data, offsets)
    starts, ends, counts = shingle_spans(starts, ends, words, size)
    digest, text = xxhash.xxh64_intdigest, text.tobytes()
    h = np.fromiter((digest(text[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    out, some = np.zeros(len(words), np.uint64), np.flatnonzero(counts)
    if len(some):
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, (np.cumsum(counts) - counts)[some], axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones > counts[some, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, size: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, h, fingerprint long) of every row: bit b is set if it is set in over half of the hashes of the ``size``-word shingles; h is a hash of the text."""
    frame = narrow(docs, key=key, text=text).withColumn("h", F.xxhash64("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_view(batch.column(1))
            parts = [fingerprints_of(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i], size) for i, j in portions(offsets, PORTION)]
            found = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(found.view(np.int64))], names=["key", "h", "fingerprint"])

    return frame.mapInArrow(run, f"key {frame.schema['key'].dataType.simpleString()}, h bigint, fingerprint bigint")


def masks(blocks: int = BLOCKS, bits: int = BITS) -> list[int]:
    """Signed 64-bit masks, one for each choice of ``blocks - bits`` blocks."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    whole = [sum(1 << b for b in range(cuts[i], cuts[i + 1])) for i in range(blocks)]
    chosen = [sum(x) for x in combinations(whole, blocks - bits)]
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def forest(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same values as all links of at most ``bits`` differing bits would; no more links than values."""
    n = len(values)
    near = np.empty((n, n), bool)
    for i in range(0, n, 256):
        near[i: i + 256] = np.bitwise_count(values[i: i + 256, None] ^ values) <= bits
    label = np.arange(n)
    while True:
        new = np.concatenate([np.where(near[i: i + 256], label, n).min(axis=1) for i in range(0, n, 256)])
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = np.flatnonzero(label != np.arange(n))
    return values[other], values[label[other]]


def links(values: DataFrame, bits: int = BITS, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) that connect the distinct longs in ``fingerprint`` as all pairs within ``bits`` differing bits do."""
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("part"))
                               for i, m in enumerate(masks(blocks, bits))]))
    keyed = values.select("fingerprint", keys.alias("k")).select("fingerprint", "k.choice", "k.part")
    sizes = keyed.groupBy("choice", "part").agg(F.count("*").alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    dealt = (keyed.join(sizes, ["choice", "part"]).withColumn("chunks", chunks)
             .withColumn("chunk", F.pmod(F.xxhash64("fingerprint"), F.col("chunks")).cast("int"))
             .groupBy("choice", "part", "chunks", "chunk").agg(F.collect_list("fingerprint").alias("own")))
    dealt = materialise(dealt)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for own in batch.column(0):
                values = own.values.to_numpy(zero_copy_only=False)
                if len(values) == 2:
                    if ((int(values[0]) ^ int(values[1])) & (1 << 64) - 1).bit_count() <= bits:
                        a.append(values[:1])
                        b.append(values[1:])
                    continue
                x, y = forest(values.view(np.uint64), bits)
                a.append(x.view(np.int64))
                b.append(y.view(np.int64))
            none = [np.zeros(0, np.int64)]
            yield pa.record_batch([pa.array(np.concatenate(a or none)), pa.array(np.concatenate(b or none))], names=["a", "b"])

    alone = dealt.where("chunks = 1").select("own")
    partner = F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(
        F.least(F.col("chunk"), j).alias("i"), F.greatest(F.col("chunk"), j).alias("j"))))
    crowded = (dealt.where("chunks > 1").select("choice", "part", "own", partner.alias("p"))
               .groupBy("choice", "part", "p").agg(F.flatten(F.collect_list("own")).alias("own")).select("own"))
    return alone.union(crowded).mapInArrow(run, "a bigint, b bigint").distinct()


def grouped(docs: DataFrame, size: int = 3, bits: int = BITS, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(key, h, fingerprint) of every row, and (fingerprint, root, component_id) of every fingerprint."""
    marks = materialise(fingerprints(docs, size, key, text))
    nodes = materialise(marks.groupBy("fingerprint").agg(F.min("key").alias("least")))
    roots = components(links(nodes.select("fingerprint"), bits)).toDF("fingerprint", "root")
    placed = nodes.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    ends = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return marks, placed.join(ends, "root").select("fingerprint", "root", "component_id")


def near_duplicates(docs: DataFrame, size: int = 3, bits: int = BITS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint long, component_id) of every row; component_id is the smallest key reachable over links."""
    marks, found = grouped(docs, size, bits, key, text)
    return marks.join(found, "fingerprint").select(F.col("key").alias(key), "fingerprint", "component_id")


def representatives(docs: DataFrame, size: int = 3, bits: int = BITS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component with all its columns: that of the smallest key, of equal keys that of the smallest text hash."""
    return first_rows(docs, *grouped(docs, size, bits, key, text), key, text)


def first_rows(docs: DataFrame, marks: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    """The row of the smallest key, then text hash, of each root, from (key, h, fingerprint) and (fingerprint, root)."""
    rows = marks.join(found, "fingerprint").groupBy("root").agg(F.min(F.struct(F.col("key").isNull(), "key", "h")).alias("m"))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    chosen = materialise(rows.select(name("m.key").alias("k"), F.col("m.h").alias("h")).distinct())
    own = numbered(docs).withColumn("k", name(at(docs, key))).withColumn("h", F.xxhash64(at(docs, text)))
    # Rows that are the same in key and text are one document.
    once = own.join(chosen, ["k", "h"], "left_semi").withColumn("no", F.row_number().over(Window.partitionBy("k", "h").orderBy("h"))).where("no = 1")
    return named(once, docs)


@query("op2_simhash")
def op2_simhash(spark, sf):
    found = near_duplicates(table(spark, sf, "documents"))
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))
