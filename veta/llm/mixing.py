"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents of a source fall into blocks by a hash of their id and text.  A source gives as many whole passes over its
blocks as its target holds, and then the first blocks of a random order until the target is reached; the last of these
is taken in part.  That fixes an exact quota of blocks for each source.  The tree deals the quotas to output shards: at
each node the left half draws its share of all blocks without replacement (multivariate hypergeometric), the right half
gets the rest.  A shard takes the next blocks of each source's permuted sequence, so shards are disjoint, and orders the
documents of its blocks by a hash of its own.

Targets: sources are put in order by code point, null last, and weigh ``weights``, repeating; together they get
``total`` times all sizes.  No target exceeds ``most`` times its source's size; the excess is reshared by weight until
none does.

On the driver: one row a source and at most ``BLOCKS`` a source; no document.  A null or blank text has size zero and is
taken with zero words; a null source is a source of its own; null ids and repeated rows are documents like any other.
Extra columns do not matter.  An empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veta.llm.common import at, byte_view, named, narrow, numbered, partitions, portions, query, table
from veta.session import materialise

#: Words of a block, and blocks of a source at most; larger sources have larger blocks.
BLOCK_WORDS, BLOCKS = 1 << 16, 4096
SHARDS, SEED = 64, 7


def word_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    word = (data != 32) & ((data < 9) | (data > 13))
    first = word.copy()
    first[1:] &= ~word[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    first[edges] = word[edges]
    return np.diff(np.concatenate(([0], np.cumsum(first)))[offsets])


def sized(docs: DataFrame, seed: int, key: str, text: str, source: str) -> DataFrame:
    """(key, source, name, size, h) of every row; name tells a null source from an empty one."""
    frame = narrow(docs, key=key, source=source, text=text).withColumn("h", F.xxhash64(F.lit(seed), "key", "text"))
    kinds = {f.name: f.dataType.simpleString() for f in frame.schema}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_view(batch.column(2))
            parts = [word_counts(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i]) for i, j in portions(offsets, 1 << 20)]
            size = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(size.astype(np.int64)), batch.column(3)], names=["key", "source", "size", "h"])

    counted = frame.mapInArrow(run, f"key {kinds['key']}, source {kinds['source']}, size bigint, h bigint")
    return counted.withColumn("name", F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source").cast("string"))))


def targets(sizes: list[int], weights: tuple[int, ...] = (5, 2, 1), total: Fraction = Fraction(3, 2), most: int = 2) -> list[float]:
    """Targets of sources of these sizes, in the order of the sizes."""
    left, open_, found = total * sum(sizes), set(range(len(sizes))), [Fraction(0)] * len(sizes)
    while open_:
        share = left / sum(weights[i % len(weights)] for i in open_)
        above = {i for i in open_ if share * weights[i % len(weights)] > most * sizes[i]}
        if not above:
            for i in open_:
                found[i] = share * weights[i % len(weights)]
            break
        for i in above:
            found[i] = Fraction(most * sizes[i])
            left -= found[i]
        open_ -= above
    return [float(x) for x in found]


def split(quotas: np.ndarray, first: int, last: int, seed: int) -> np.ndarray:
    """(shards x sources) blocks for the shards first..last-1 out of these quotas."""
    if last - first <= 1:
        return quotas[None, :]
    middle, all_ = (first + last) // 2, int(quotas.sum())
    share = all_ * (middle - first) // (last - first)
    left = np.random.default_rng([seed, first, last]).multivariate_hypergeometric(quotas, share, method="marginals")
    return np.concatenate([split(left, first, middle, seed), split(quotas - left, middle, last, seed)])


def block_of(seed_hash: Column, blocks: Column) -> Column:
    return F.floor(F.shiftrightunsigned(seed_hash, 33) * blocks / F.lit(float(1 << 31))).cast("int")


def deal(spark: SparkSession, sources: list, blocks: dict[str, np.ndarray], shards: int, seed: int) -> DataFrame:
    """(name, block, passes, part, shards): whole passes over a block, words of it taken besides (null: all), shard of each taking."""
    order, rows = [], []
    for no, (name, size, target) in enumerate(sources):
        words = blocks[name]
        quota = round(target)
        passes, rest = divmod(quota, size) if size else (0, 0)
        draw = np.random.default_rng([seed, no]).permutation(len(words))
        before = np.concatenate(([0], np.cumsum(words[draw])))
        drawn = int(np.searchsorted(before, rest, "left"))
        taken = [np.random.default_rng([seed, no, p + 1]).permutation(len(words)) for p in range(passes)] + [draw[:drawn]]
        order.append(np.concatenate(taken))
        part = {int(b): int(min(words[b], rest - before[i])) for i, b in enumerate(draw[:drawn].tolist())}
        rows.append((name, passes, part))
    leaves = split(np.array([len(x) for x in order], np.int64), 0, shards, seed) if sources else np.zeros((shards, 0), int)
    out = []
    for no, (name, passes, part) in enumerate(rows):
        of: dict[int, list[int]] = {b: [] for b in range(len(blocks[name]))}
        for b, shard in zip(order[no].tolist(), np.repeat(np.arange(shards), leaves[:, no]).tolist(), strict=True):
            of[b].append(shard)
        for b, where in of.items():
            words = part.get(b, 0)
            out.append((name, b, passes, b in part, None if words == int(blocks[name][b]) else words, where))
    return spark.createDataFrame(out, "name string, block int, passes int, drawn boolean, part bigint, shards array<int>")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), total: Fraction = Fraction(3, 2), most: int = 2, shards: int = SHARDS, seed: int = SEED,
        cut: bool = True, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, h, size, source_size, target, taken, passes, shards) of every row.

    ``taken`` counts the words that the mix takes of the document, repeats included; ``passes`` how often all of it is
    taken; ``shards`` where each taking goes.  With ``cut`` the document at the end of a source's quota is taken in part;
    without, it is taken whole or not at all, whichever is nearer.
    """
    spark = docs.sparkSession
    rows = materialise(sized(docs, seed, key, text, source))
    sums = {r.name: (r.source, r.size) for r in rows.groupBy("name", "source").agg(F.sum("size").alias("size")).collect()}
    names = sorted(sums, key=lambda n: (n == "", n))
    wanted = targets([sums[n][1] for n in names], weights, total, most)
    counts = {n: min(BLOCKS, max(1, -(-sums[n][1] // BLOCK_WORDS))) for n in names}
    facts = spark.createDataFrame([(n, sums[n][1], t, counts[n]) for n, t in zip(names, wanted, strict=True)],
                                  "name string, source_size bigint, target double, blocks int")
    placed = rows.join(facts, "name").withColumn("block", block_of(F.col("h"), F.col("blocks")))
    words = {n: np.zeros(counts[n], np.int64) for n in names}
    for r in placed.groupBy("name", "block").agg(F.sum("size").alias("size")).collect():
        words[r["name"]][r["block"]] = r["size"]
    plan = deal(spark, [(n, sums[n][1], t) for n, t in zip(names, wanted, strict=True)], words, shards, seed)
    joined = placed.join(plan, ["name", "block"])
    whole = joined.where("part is null or not drawn").withColumn("extra", F.when(F.col("drawn"), F.col("size")).otherwise(0))
    order = Window.partitionBy("name", "block").orderBy("h", "key").rowsBetween(Window.unboundedPreceding, 0)
    ends = joined.where("drawn and part is not null").withColumn("upto", F.sum("size").over(order))
    inside = F.col("part") - F.col("upto") + F.col("size")
    some = F.greatest(F.lit(0), F.least("size", inside)) if cut else F.when(inside * 2 >= F.col("size"), F.col("size")).otherwise(0)
    # What lies behind the end of the quota is in no shard for that last taking.
    behind = F.when(inside > 0, F.col("shards")).otherwise(F.slice("shards", 1, "passes"))
    ends = ends.withColumn("extra", some).withColumn("shards", behind).drop("upto")
    return whole.unionByName(ends).select(F.col("key").alias(key), "h", "size", "source_size", "target",
                                          (F.col("passes") * F.col("size") + F.col("extra")).cast("long").alias("taken"), "passes", "shards")


def takings(mixed: DataFrame, key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """(key, h, shard, place, words): a row for each taking; a shard is read in the order of ``place``."""
    each = mixed.select(key, "h", "size", "taken", "passes", F.posexplode("shards").alias("no", "shard"))
    words = F.when(F.col("no") < F.col("passes"), F.col("size")).otherwise(F.col("taken") - F.col("passes") * F.col("size"))
    return each.select(key, "h", "shard", F.xxhash64(F.lit(seed), "shard", "no", "h").alias("place"), words.alias("words"))


def mixture(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, shard: str | None = None, **rules) -> DataFrame:
    """The mixed rows with all their columns, as often as each is taken, shard by shard in the random order of the shard's places.

    A shard is spread over several partitions by its places, so its size does not decide the size of a task.  ``shard`` names
    a further column for the shard's number.  Documents are taken whole, so a source may miss its target by up to half a
    document.  Documents without words go.
    """
    mixed = mix(docs, seed=seed, cut=False, key=key, text=text, source=source, **rules)
    name = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null"))
    taken = takings(mixed, key, seed).where("words > 0").select(name(key).alias("k"), "h", "shard", "place").distinct()
    own = numbered(docs).withColumn("h", F.xxhash64(F.lit(seed), at(docs, key), at(docs, text))).withColumn("k", name(at(docs, key)))
    parts = partitions(docs.sparkSession)
    piece = F.floor(F.shiftrightunsigned("place", 33) * F.lit(parts) / F.lit(float(1 << 31)))
    dealt = own.join(taken, ["k", "h"]).repartition(parts, "shard", piece).sortWithinPartitions("shard", "place")
    rows = named(dealt, docs) if shard is None else dealt.select(*[F.col(at(docs, c)).alias(c) for c in docs.columns], F.col("shard").alias(shard))
    return rows


@query("op4_mixing")
def op4_mixing(spark, sf):
    return mix(table(spark, sf, "documents")).drop("h", "passes")
