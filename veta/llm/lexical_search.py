"""Ranked lexical search by bags: documents that no item can tell apart are scored once.

Items see of a document only how often it holds each of their own terms, and the number ``m`` that its length gives it.
Documents are cut down to that bag when they are read; bags and ``m`` are grouped, which hashes them and compares the whole
value, so that a class holds identical documents and nothing else.  Each class is scored once against all items.  A task
keeps the best ``k`` classes of each item as it goes, so what leaves it is bounded by items times ``k``; the same choice over
all tasks leaves ``k`` classes an item, in the order of their scores and smallest ids, and the ``k`` best documents are in
them: whoever is in a class left out stands behind one document at least of each of ``k`` others.  Only those classes
are expanded, each by its smallest ids.

Terms are maximal runs of ASCII letters and digits and of characters beyond ASCII, A-Z in lower case.  All sums are whole
numbers below 2**53, so that products of matrices of doubles are exact; a bag that could exceed that is added up in integers.

Items are taken in blocks of ``BLOCK`` rows; what the tasks need to know of a block is its vocabulary.  Null and empty texts
have no terms: such documents are not counted and such items have no rows.  A null id comes after all others.  Rows with equal
ids are documents of their own, and each gets its rank; equal item ids with different texts are items of their own.
Ids of documents are whole numbers.  Columns besides id and text are ignored.  An empty table of documents or items gives no rows.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veta.llm.common import byte_view, narrow, portions, query, table
from veta.session import materialise

TOP = 10
#: Items whose terms the tasks hold at once.
BLOCK = 4096
#: Share of the length in the weight of a document, of 100.
SLOPE = 75
#: Terms of classes scored at once, and classes, each of which counts for some terms.
CELLS, ROWS = 1 << 16, 512
#: A term that this share of the items hold goes through a matrix product, others through their list of items.
COMMON = 0.05
KEEP = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def counts(text: bytes) -> Counter:
    """How often each term of a UTF-8 text occurs; characters outside of terms become blanks."""
    return Counter(text.translate(KEEP).split())


@dataclass
class Corpus:
    """Documents with a term, their terms, and the documents that hold each term of the vocabulary."""

    documents: int
    length: int
    holders: np.ndarray

    def weights(self) -> np.ndarray:
        return np.array([math.floor(1000 * math.log((2 * self.documents + 2) / (2 * int(h) + 1))) for h in self.holders], np.int64)


def bags(docs: DataFrame, vocabulary: dict[bytes, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, bag binary) of every row: the number of its terms, and (number, count) of those in the vocabulary as two runs of 32-bit integers."""
    frame = narrow(docs, key=key, text=text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.keys()
        for batch in batches:
            n, packed = [], []
            data, offsets = byte_view(batch.column(1))
            raw = memoryview(data)
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                found = counts(bytes(raw[a:b]))
                n.append(found.total())
                own = sorted((vocabulary[t], found[t]) for t in found.keys() & known)
                packed.append(np.array(own, "<u4").reshape(-1, 2).T.tobytes())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(packed, pa.binary())], names=["key", "n", "bag"])

    return frame.mapInArrow(run, f"key {frame.schema['key'].dataType.simpleString()}, n bigint, bag binary")


def unpack(bag: bytes) -> np.ndarray:
    """Two rows: numbers of the terms and their counts."""
    return np.frombuffer(bag, "<u4").reshape(2, -1)


def measure(found: DataFrame, size: int) -> Corpus:
    """Counts over all documents; of the terms only as many as the vocabulary has reach the driver."""
    total = found.where("n > 0").agg(F.count("*").alias("documents"), F.sum("n").alias("length")).first()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for batch in batches:
            for bag in batch.column(0).to_pylist():
                held[unpack(bag)[0]] += 1
        some = np.flatnonzero(held)
        yield pa.record_batch([pa.array(some), pa.array(held[some])], names=["term", "n"])

    holders = np.zeros(size, np.int64)
    for r in found.select("bag").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():
        holders[r.term] = r.n
    return Corpus(total.documents or 0, total.length or 0, holders)


class Scorer:
    """Scores of bags against a block of items."""

    def __init__(self, book: np.ndarray, weights: np.ndarray, items: int):
        """``book`` has a row (term, item, repeats) for each term of each item."""
        book = book[weights[book[:, 0]] > 0]
        held = np.bincount(book[:, 0], minlength=len(weights))
        wide = held > COMMON * items
        self.items, self.wide = items, np.full(len(weights), -1)
        self.wide[wide] = np.arange(wide.sum())
        self.table = np.zeros((int(wide.sum()), items))
        value = book[:, 2] * weights[book[:, 0]]
        on = wide[book[:, 0]]
        self.table[self.wide[book[on, 0]], book[on, 1]] = value[on]
        rest = book[~on][np.argsort(book[~on, 0], kind="stable")]
        self.item, self.value = rest[:, 1], (rest[:, 2] * weights[rest[:, 0]])
        self.sizes = np.bincount(rest[:, 0], minlength=len(weights))
        self.first = np.cumsum(self.sizes) - self.sizes
        #: Sum of an item's weights at most; a term adds less than a million times its weight.
        self.most = int(np.bincount(book[:, 1], value, minlength=max(1, items)).max()) if len(book) else 0

    def scores(self, found: list[bytes], m: np.ndarray) -> np.ndarray:
        """(bags x items), exact."""
        split = [unpack(b) for b in found]
        row = np.repeat(np.arange(len(split)), [s.shape[1] for s in split])
        term, tf = (np.concatenate([s[i] for s in split]).astype(np.int64) for i in (0, 1))
        part = (1_000_000_000 * tf) // (1000 * tf + 8 * m[row])
        kind = np.float64 if self.most * 1_000_000 < 1 << 53 else np.int64
        on = self.wide[term] >= 0
        dense = np.zeros((len(split), len(self.table)), kind)
        dense[row[on], self.wide[term[on]]] = part[on]
        out = dense @ self.table.astype(kind)
        row, term, part = row[~on], term[~on], part[~on]
        many = self.sizes[term]
        own = np.repeat(np.arange(len(row)), many)
        at = self.first[term][own] + np.arange(len(own)) - (np.cumsum(many) - many)[own]
        cell = row[own] * self.items + self.item[at]
        if kind is np.int64:
            np.add.at(out.reshape(-1), cell, self.value[at] * part[own])
            return out
        # Sums stay below 2**53, where doubles hold every whole number.
        out += np.bincount(cell, (self.value[at] * part[own]).astype(np.float64), minlength=out.size).reshape(out.shape)
        return out.astype(np.int64)


def best(score: np.ndarray, first: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` largest positive scores, of equal ones those with the smallest ``first``."""
    if len(score) > top:
        least = np.partition(score, len(score) - top)[len(score) - top]
        some = np.flatnonzero(score >= max(least, 1))
    else:
        some = np.flatnonzero(score > 0)
    return some[np.lexsort((first[some], -score[some]))][:top]


def choose(classes: DataFrame, scorer: Scorer, top: int) -> DataFrame:
    """(item, score, place, m, bag): the best classes of each item in each task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple]] = [[] for _ in range(scorer.items)]
        floor = np.zeros(scorer.items, np.int64)
        for batch in batches:
            places, ms, bags_ = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            for a, b in portions(np.cumsum([0, *[len(x) // 8 + CELLS // ROWS for x in bags_]]), CELLS):
                place, m, bag = places[a:b], ms[a:b], bags_[a:b]
                score = scorer.scores(bag, m)
                for i in np.flatnonzero((score >= np.maximum(floor, 1)).any(axis=0)).tolist():
                    mine = best(score[:, i], place, top)
                    held[i] = sorted(held[i] + [(-int(score[j, i]), int(place[j]), int(m[j]), bag[j]) for j in mine.tolist()])[:top]
                    if len(held[i]) == top:
                        floor[i] = -held[i][-1][0]
        for i in range(0, scorer.items, 256):
            rows = [(i + k, -s, *rest) for k, own in enumerate(held[i: i + 256]) for s, *rest in own]
            if rows:
                item, score, place, m, bag = zip(*rows, strict=True)
                yield pa.record_batch([pa.array(item, pa.int64()), pa.array(score, pa.int64()), pa.array(place, pa.int64()), pa.array(m, pa.int64()), pa.array(bag, pa.binary())],
                                      names=["item", "score", "place", "m", "bag"])

    return classes.select("place", "m", "bag").mapInArrow(run, "item bigint, score bigint, place bigint, m bigint, bag binary")


def search_block(docs: DataFrame, items: list[tuple], top: int, key: str, text: str) -> DataFrame | None:
    """(no, rank, key, score) for the items, given by their terms; ``no`` is the place of an item in the list."""
    vocabulary: dict[bytes, int] = {}
    book = np.array([(vocabulary.setdefault(t, len(vocabulary)), i, n) for i, own in enumerate(items) for t, n in own.items()], np.int64).reshape(-1, 3)
    found = materialise(bags(docs, vocabulary, key, text))
    corpus = measure(found, len(vocabulary))
    if not corpus.documents or not vocabulary:
        return None
    scorer = Scorer(book, corpus.weights(), len(items))
    share = F.expr(f"{SLOPE}L * n * {corpus.documents}L div {corpus.length}L")
    weighed = found.where(F.octet_length("bag") > 0).select("key", "bag", (F.lit(100 - SLOPE) + share).cast("long").alias("m"))
    # Classes: equal bags and m.  Grouping hashes both and compares them whole.  Ids order by value, nulls last.
    order = F.coalesce(F.col("key").cast("long"), F.lit(np.iinfo(np.int64).max))
    classes = weighed.groupBy("m", "bag").agg(F.min(order).alias("place"))
    ahead = Window.partitionBy("item").orderBy(F.desc("score"), "place", "m", "bag")
    chosen = materialise(choose(classes, scorer, top).withColumn("r", F.row_number().over(ahead)).where(F.col("r") <= top).drop("r", "place"))
    # At most items x top classes, whose hashes let their members through; each class unfolds to its first ids.
    mark = F.xxhash64("m", "bag").alias("h")
    near = weighed.withColumn("h", mark).join(F.broadcast(chosen.select(mark).distinct()), "h", "left_semi").drop("h")
    members = near.withColumn("r", F.row_number().over(Window.partitionBy("m", "bag").orderBy(F.asc_nulls_last("key")))).where(F.col("r") <= top).drop("r")
    ranked = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    out = chosen.join(members, ["m", "bag"]).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    return out.select("item", "rank", "key", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, key: str = "doc_id", text: str = "text", item: str = "item_id", block: int = BLOCK) -> DataFrame:
    """(item, rank, key, score): the ``top`` documents of each item with a score above 0, equal scores by ascending key."""
    wanted = narrow(items, item=item, text=text).where("text IS NOT NULL").distinct()
    item_kind, key_kind = wanted.schema["item"].dataType.simpleString(), docs.schema[key].dataType.simpleString()
    spark, parts, held = docs.sparkSession, [], []

    def settle(rows: list[tuple]) -> DataFrame | None:
        found = search_block(docs, [own for _, own in rows], top, key, text)
        if found is None:
            return None
        names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(rows)], f"item bigint, name {item_kind}")
        return found.join(F.broadcast(names), "item").select(F.col("name").alias(item), "rank", F.col("key").alias(key), "score")

    # The stated query set, read in blocks; the driver holds the terms of one block.
    for r in wanted.orderBy("item", "text").toLocalIterator():
        own = counts(r.text.encode())
        if own:
            held.append((r.item, own))
        if len(held) == block:
            parts.append(settle(held))
            held = []
    if held:
        parts.append(settle(held))
    parts = [p for p in parts if p is not None]
    if not parts:
        return spark.createDataFrame([], f"`{item}` {item_kind}, rank int, `{key}` {key_kind}, score bigint")
    return functools.reduce(DataFrame.unionByName, parts)


LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ORACLE = rf"""WITH t AS (SELECT doc_id, regexp_extract_all(translate(text, {LETTERS}), '{TERM}') AS t FROM documents WHERE text IS NOT NULL),
    d AS (SELECT doc_id, len(t)::BIGINT AS n, t FROM t WHERE len(t) > 0),
    s AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS total FROM d),
    f AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM d) GROUP BY ALL),
    g AS (SELECT term, count(*)::BIGINT AS df FROM f GROUP BY 1),
    q AS (SELECT item_id, term, count(*)::BIGINT AS k FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, {LETTERS}), '{TERM}')) AS term FROM benchmark) GROUP BY ALL),
    p AS (SELECT item_id, doc_id, sum(k * floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // total)))) AS score
        FROM q JOIN g USING (term) JOIN f USING (term) CROSS JOIN s GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM p WHERE score > 0)
    SELECT item_id, rank::INT AS rank, doc_id, score::BIGINT AS score FROM r WHERE rank <= 10"""


@query("op11_bag_search", ORACLE)
def op11_bag_search(spark, sf):
    return search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
