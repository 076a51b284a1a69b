"""Document fingerprints by a homomorphic multiset hash of paragraphs.

Each paragraph (line) is hashed to a wide vector, and a document's state is the sum of its paragraphs' vectors: 1024 lanes
modulo 2^16 that decide equality, and 512 lanes modulo 2^32 that carry signed counts of the paragraph's three-word
shingles.  So the order of paragraphs does not matter, and inserting or deleting a paragraph adds or subtracts its vector
without reading the rest.  The fingerprint is the SHA-256 of the state.  As signs are random, the inner product of two
states' second parts estimates the shingles they share; ``likeness`` is twice that over the sum of squares, cut to 0..1
(1 for equal states; the standard error is about 0.04).  The lanes enter the likeness only by being equal or not.

A null is the empty text, which is one empty paragraph.  Repeated rows and equal texts get equal fingerprints.  Null ids
come last in the order of documents; equal ids are ordered by a hash of the text.  Extra columns do not matter.  A single
document follows itself; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veta.llm.common import byte_view, narrow, portions, query, table
from veta.llm.simhash import shingle_spans, word_spans
from veta.session import shuffle_partitions

LANES, COUNTS, WORDS = 1024, 512, 3
PORTION = 1 << 20
#: Lines whose vectors are in memory at once (2 KB each).
LINES = 4096


class State:
    """Sums of paragraph vectors, one row a document; states add and subtract."""

    def __init__(self, lanes: np.ndarray, counts: np.ndarray):
        self.lanes, self.counts = lanes, counts

    def __add__(self, other: State) -> State:
        return State(self.lanes + other.lanes, self.counts + other.counts)

    def __sub__(self, other: State) -> State:
        return State(self.lanes - other.lanes, self.counts - other.counts)

    def rows(self, at) -> State:
        return State(self.lanes[at], self.counts[at])

    def packed(self) -> list[bytes]:
        return [a.tobytes() + b.tobytes() for a, b in zip(self.lanes.astype("<u2", copy=False), self.counts.astype("<i4", copy=False), strict=True)]

    def fingerprints(self) -> list[str]:
        return [hashlib.sha256(x).hexdigest() for x in self.packed()]

    def likeness(self, other: State) -> np.ndarray:
        a, b = self.counts.astype(np.float64), other.counts.astype(np.float64)
        both, each = 2 * (a * b).sum(axis=1), (a * a).sum(axis=1) + (b * b).sum(axis=1)
        same = (self.lanes == other.lanes).all(axis=1)
        return np.where(same, 1.0, np.clip(both / np.maximum(each, 1), 0, 1))


def lane_sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """Sums of the vectors of lines by the text that owns them, ``LINES`` lines at a time; equal lines of a batch are hashed once."""
    raw, lanes = data.tobytes(), np.zeros((n, LANES), np.uint16)
    for s in range(0, len(starts), LINES):
        seen: dict[bytes, int] = {}
        line = np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(starts[s: s + LINES].tolist(), ends[s: s + LINES].tolist(), strict=True)])
        wide = np.frombuffer(b"".join([hashlib.shake_128(x).digest(2 * LANES) for x in seen]), "<u2").reshape(-1, LANES)
        pair, times = np.unique(own[s: s + LINES] * len(seen) + line, return_counts=True)
        mine = pair // len(seen)
        first = np.flatnonzero(np.diff(mine, prepend=-1))
        lanes[mine[first]] += np.add.reduceat(wide[pair % len(seen)] * times.astype(np.uint16)[:, None], first, axis=0, dtype=np.uint16)
    return lanes


def state_of(data: np.ndarray, offsets: np.ndarray) -> State:
    """States of texts given as UTF-8 bytes and offsets."""
    import xxhash

    n, breaks = len(offsets) - 1, np.flatnonzero(data == 10)
    starts, ends = np.sort(np.concatenate((offsets[:-1], breaks + 1))), np.sort(np.concatenate((breaks, offsets[1:])))
    lines = np.diff(np.searchsorted(breaks, offsets)) + 1
    lanes = lane_sums(data, starts, ends, np.repeat(np.arange(n), lines), n)
    text, a, b, words = word_spans(data, np.concatenate((starts, offsets[-1:])))
    a, b, shingles = shingle_spans(a, b, words, WORDS)
    digest, text = xxhash.xxh64_intdigest, text.tobytes()
    h = np.fromiter((digest(text[x:y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)), np.uint64, len(a))
    own = np.repeat(np.repeat(np.arange(n), lines), shingles)
    sign = 1.0 - 2.0 * ((h >> np.uint64(32)) & np.uint64(1)).astype(np.float64)
    counts = np.bincount(own * COUNTS + (h % np.uint64(COUNTS)).astype(np.int64), sign, n * COUNTS)
    return State(lanes, np.rint(counts).astype(np.int32).reshape(n, COUNTS))


def state(texts: list[str]) -> State:
    """States of texts, worked out in portions."""
    data, offsets = byte_view(pa.array(texts, pa.large_string()))
    parts = [state_of(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i]) for i, j in portions(offsets, PORTION)]
    return State(np.concatenate([p.lanes for p in parts]), np.concatenate([p.counts for p in parts]))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, state binary) of every row."""
    frame = narrow(docs, key=key, text=text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_view(batch.column(1))
            for i, j in portions(offsets, PORTION):
                s = state_of(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i])
                yield pa.record_batch([batch.column(0)[i:j], pa.array(s.fingerprints()), pa.array(s.packed(), pa.binary())], names=[key, "fingerprint", "state"])

    return frame.mapInArrow(run, f"`{key}` {frame.schema['key'].dataType.simpleString()}, fingerprint string, state binary")


def in_order(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, bucket, copy): buckets of ids, each sorted by descending id and closed by a copy of the row that follows its last one.

    Ids are cut at quantiles, so buckets hold about equally many rows; the driver sees a few numbers a bucket.
    """
    frame = narrow(docs, key=key, text=text).withColumn("h", F.xxhash64("text"))
    parts = shuffle_partitions(docs.sparkSession)
    cuts = sorted(set(frame.select(F.col("key").cast("double").alias("k")).approxQuantile("k", [i / (4 * parts) for i in range(1, 4 * parts)], 0.0005)))
    if cuts:
        frame = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="k", outputCol="b", handleInvalid="keep").transform(frame.withColumn("k", F.col("key").cast("double")))
        frame = frame.withColumn("bucket", F.when(F.col("key").isNull(), -1).otherwise(F.col("b").cast("int"))).drop("k", "b")
    else:
        frame = frame.withColumn("bucket", F.when(F.col("key").isNull(), -1).otherwise(0))
    heads = frame.groupBy("bucket").agg(F.max(F.struct("key", "h")).alias("m")).orderBy(F.desc("bucket")).collect()
    follow = [(r.m.key, r.m.h, heads[i - 1].bucket) for i, r in enumerate(heads)]
    kind = frame.schema["key"].dataType.simpleString()
    copies = docs.sparkSession.createDataFrame(follow, f"ckey {kind}, ch bigint, of int")
    # One row a bucket: small whatever the input.
    marked = frame.join(F.broadcast(copies), F.col("key").eqNullSafe(F.col("ckey")) & (F.col("h") == F.col("ch")), "left")
    places = F.explode(F.when(F.col("of").isNull(), F.array(F.struct("bucket", F.lit(False).alias("copy"))))
                       .otherwise(F.array(F.struct("bucket", F.lit(False).alias("copy")), F.struct(F.col("of").alias("bucket"), F.lit(True).alias("copy")))))
    spread = marked.select("key", "text", "h", places.alias("p")).select("key", "text", "h", "p.bucket", "p.copy")
    return (spread.repartition(parts, "bucket").sortWithinPartitions(F.desc("bucket"), "copy", F.desc_nulls_last("key"), F.desc("h"))
            .select("key", "text", "bucket", "copy"))


def edited(text: str, following: str) -> str:
    """The last third of the characters replaced by as many of the following text's first ones."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def compared(texts: list[str], states: State, following: list[str], next_states: State) -> list:
    """Columns of the result for these texts.  An edited text's state is the text's, less the paragraphs from the edit on, plus the new ones."""
    new = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    cut = [t.rfind("\n", 0, len(t) - len(t) // 3) + 1 for t in texts]
    changed = states - state([t[c:] for t, c in zip(texts, cut, strict=True)]) + state([t[c:] for t, c in zip(new, cut, strict=True)])
    return [pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new]), pa.array(states.fingerprints()),
            pa.array(changed.fingerprints()), pa.array(states.likeness(changed)), pa.array(states.likeness(next_states))]


def edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row."""
    frame = in_order(docs, key, text)
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            _, offsets = byte_view(batch.column(1))
            for i, j in portions(offsets, PORTION):
                part = batch.slice(i, j - i)
                keys, texts = part.column(0), [x or "" for x in part.column(1).to_pylist()]
                buckets, copy, states = part.column(2).to_pylist(), part.column(3).to_pylist(), state(texts)
                if held:
                    keys = pa.concat_arrays([held[0], keys])
                    texts, buckets, copy = held[1] + texts, held[2] + buckets, held[3] + copy
                    states = State(np.concatenate((held[4].lanes, states.lanes)), np.concatenate((held[4].counts, states.counts)))
                at = [k for k in range(len(texts) - 1) if not copy[k]]
                # The row after a row that is no copy always is the one that follows it.
                if at:
                    after = [k + 1 for k in at]
                    found = compared([texts[k] for k in at], states.rows(at), [texts[k] for k in after], states.rows(after))
                    yield pa.record_batch([keys.take(pa.array(at)), *found], names=names)
                last = len(texts) - 1
                held = (keys[last:], texts[last:], buckets[last:], copy[last:], states.rows(slice(last, None)))

    kind = frame.schema["key"].dataType.simpleString()
    return frame.mapInArrow(run, f"`{key}` {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


@query("op5_multiset")
def op5_multiset(spark, sf):
    return edits(table(spark, sf, "documents"))
