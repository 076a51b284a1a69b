"""Exact dedup of repeated word passages with phrase automata.

A word is removed if ``LENGTH`` words in a row that cover it also start in a document with a smaller id.

1. *Nominate.*  Equal windows of ``LENGTH`` words share the smallest hash among their ``PIECE``-word pieces.  Documents go to
   blocks; each block sends those hashes, 5 bytes each, and learns which of them another document has as well.
2. *Confirm.*  Of the windows with such a hash each block sends its distinct ones as 80-bit hashes, spread over buckets by
   themselves, each with the smallest id that has it in the block.  A bucket answers which of them a smaller document of
   another block holds.
3. *Locate.*  The windows that are confirmed, in the block or by a bucket, are compiled to Aho-Corasick automata over words,
   in shards of ``SHARD`` windows that follow the text, so that a shard stays in the processor's cache.  All documents of the
   block are streamed through the automata of the shards their nominated windows belong to, which finds every occurrence
   word by word; an occurrence covers its words if a document with a smaller id has the window.

A passage that many documents share is one window a block in step 2, however many of the block's documents hold it, and no
key brings more than one row a block to a task.  Words are told apart by their bytes within a block and by 128 bits of
hash between blocks.

Words are runs of bytes without white space (0x20, 0x09 to 0x0D), unchanged.  Nulls are texts without words; nothing is
removed from texts with fewer than ``LENGTH`` words.  Null ids come after all others.  Rows with equal ids (repeated rows
among them) do not remove from each other, nor null ids among themselves.  Ids are whole numbers.  Columns beside id and
text are ignored, or carried along by ``rewrite``.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veta.llm.common import at, byte_view, named, narrow, numbered, query, table
from veta.llm.repeats import FACTS, LAST, find_repeated, five, groups, short, unfive
from veta.session import shuffle_partitions

LENGTH, PIECE = 13, 3
#: Windows of an automaton.
SHARD = 1024
#: Bytes of text in a block grow with the square root of all text between these.
BLOCK = (4 << 20, 64 << 20)
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
#: Where the letters of an automaton begin: each of its words is a character beyond the surrogates.
FIRST = 0x10000


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * ODD[1]
    return x ^ x >> np.uint64(29)


def rolled(h: np.ndarray, size: int, factor: np.uint64) -> np.ndarray:
    """A hash of each ``size`` values in a row."""
    n = max(0, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * factor + h[k: k + n]
    return mixed(out)


class Words:
    """The words of a block's documents as numbers, and its windows as hashes."""

    def __init__(self, docs: pa.Table):
        import xxhash

        data, offsets = byte_view(docs.column("text").combine_chunks().cast(pa.large_string()))
        raw, number = memoryview(data), {}
        self.order, self.splits, ids = docs.column("order").to_numpy(), [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            found = bytes(raw[a:b]).split()
            ids.append(np.fromiter((number.setdefault(w, len(number)) for w in found), np.int32, len(found)))
        self.ids = np.concatenate(ids or [np.zeros(0, np.int32)])
        self.offsets = np.cumsum([0, *map(len, ids)])
        self.vocabulary = list(number)
        digest = b"".join(map(xxhash.xxh3_128_digest, self.vocabulary))
        self.high, self.low = np.frombuffer(digest, "<u8").reshape(-1, 2).T if digest else np.zeros((2, 0), np.uint64)
        # Windows that begin at a word and end in the same document.
        n = max(0, len(self.ids) - LENGTH + 1)
        self.owner = np.repeat(np.arange(len(ids)), np.diff(self.offsets))
        self.whole = self.owner[:n] == self.owner[len(self.ids) - n:] if n else np.zeros(0, bool)

    def anchors(self) -> np.ndarray:
        """The anchor of each window, those across documents included."""
        low = rolled(self.high[self.ids], PIECE, ODD[0])
        width, done = LENGTH - PIECE + 1, 1
        while done < width:
            step = min(done, width - done)
            low = np.minimum(low[:-step], low[step:]) if len(low) > step else low[:0]
            done += step
        # Smallest hashes are small: mixed once more, they spread evenly over buckets.
        return mixed(low)

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes, of 64 and 16 bits, of the windows that begin at these words."""
        one, two = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        for k in range(LENGTH):
            own = self.ids[at + k]
            one = one * ODD[2] + self.high[own]
            two = two * ODD[3] + self.low[own]
        return mixed(one), (mixed(two) >> np.uint64(48)).astype(np.uint16)


def send_anchors(buckets: int) -> Callable:
    def run(key: tuple, docs: pa.Table) -> pa.Table:
        own = Words(docs)
        at = np.flatnonzero(own.whole)
        names, doc = short(own.anchors()[at], buckets), own.owner[at]
        # Neighbouring windows of a document mostly have the same anchor.
        new = np.ones(len(at), bool)
        new[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])
        names, doc = names[new], doc[new]
        order, first = groups(names)
        rows = []
        if len(first):
            doc, names = doc[order], names[order][first]
            several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
            cut = np.searchsorted(names >> np.uint64(40), np.arange(buckets + 1, dtype=np.uint64))
            for b in np.flatnonzero(np.diff(cut)).tolist():
                part = slice(cut[b], cut[b + 1])
                more = np.flatnonzero(several[part]).astype("<u4")
                rows.append((b, five(names[part]), more.tobytes(), np.full(len(more), 2, "<u4").tobytes()))
        bucket, values, more, counts = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.table({"bucket": pa.array(bucket, pa.int32()), "block": pa.array([key[0].as_py()] * len(rows), pa.int32()), "anchors": pa.array(values, pa.binary()),
                         "more": pa.array(more, pa.binary()), "counts": pa.array(counts, pa.binary())})

    return run


class Nominated:
    """A block's windows whose anchors are repeated: distinct ones in the order of their hashes, and each occurrence."""

    def __init__(self, words: Words, facts: pa.Table, buckets: int):
        told = [np.uint64(b) << np.uint64(40) | unfive(a) for b, a in zip(facts.column("bucket").to_pylist(), facts.column("anchors").to_pylist(), strict=True) if a is not None]
        names = np.sort(np.concatenate(told or [np.zeros(0, np.uint64)]))
        at = np.flatnonzero(words.whole)
        mine = short(words.anchors()[at], buckets)
        place = np.minimum(np.searchsorted(names, mine), max(0, len(names) - 1))
        self.at = at[names[place] == mine] if len(names) else at[:0]
        one, two = words.windows(self.at)
        order = np.lexsort((two, one))
        new = np.ones(len(order), bool)
        new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        #: Number of the distinct window of each occurrence; numbers do not depend on the order of rows.
        self.ids = np.empty(len(order), np.int64)
        self.ids[order] = np.cumsum(new) - 1
        self.one, self.two = one[order][new], two[order][new]
        self.holder = words.order[words.owner[self.at]]
        self.least = np.full(len(self.one), LAST)
        np.minimum.at(self.least, self.ids, self.holder)
        self.bucket = (self.one >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)

    def parts(self) -> Iterator[tuple[int, slice]]:
        """Distinct windows by the bucket that confirms them."""
        first = np.flatnonzero(np.diff(self.bucket, prepend=np.uint64(LAST)))
        for a, b in zip(first.tolist(), [*first.tolist()[1:], len(self.bucket)], strict=True):
            yield int(self.bucket[a]), slice(a, b)


SENT = "bucket int, block int, one binary, two binary, least binary"


def send_windows(buckets: int) -> Callable:
    def run(key: tuple, docs: pa.Table, facts: pa.Table) -> pa.Table:
        rows = []
        if len(docs) and len(facts):
            own = Nominated(Words(docs), facts, buckets)
            rows = [(b, own.one[s].astype("<u8").tobytes(), own.two[s].astype("<u2").tobytes(), pa.compress(own.least[s].astype("<i8").tobytes(), "zstd", asbytes=True))
                    for b, s in own.parts()]
        bucket, *rest = zip(*rows, strict=True) if rows else ((),) * 4
        return pa.table({"bucket": pa.array(bucket, pa.int32()), "block": pa.array([key[0].as_py()] * len(rows), pa.int32()),
                         **{c: pa.array(v, pa.binary()) for c, v in zip(("one", "two", "least"), rest, strict=True)}})

    return run


def confirm(key: tuple, sent: pa.Table) -> pa.Table:
    """For each block a bit a window: whether a document with a smaller id than all of the block's that hold it has it."""
    block, one, two, least = (sent.column(c).to_pylist() for c in ("block", "one", "two", "least"))
    sizes = [len(x) // 8 for x in one]
    least = np.concatenate([np.frombuffer(pa.decompress(x, 8 * n, "zstd", asbytes=True), "<i8") for x, n in zip(least, sizes, strict=True)])
    one, two = np.frombuffer(b"".join(one), "<u8"), np.frombuffer(b"".join(two), "<u2")
    order = np.lexsort((two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    first = np.flatnonzero(new)
    smallest = np.empty(len(order), np.int64)
    smallest[order] = np.repeat(np.minimum.reduceat(least[order], first), np.diff(np.append(first, len(order))))
    earlier = smallest < least
    cuts = np.cumsum([0, *sizes]).tolist()
    rows = [(b, np.packbits(earlier[i:j]).tobytes()) for b, i, j in zip(block, cuts[:-1], cuts[1:], strict=True) if earlier[i:j].any()]
    blocks, bits = zip(*rows, strict=True) if rows else ((), ())
    none = pa.nulls(len(rows), pa.binary())
    return pa.table({"block": pa.array(blocks, pa.int32()), "bucket": pa.array([key[0].as_py()] * len(rows), pa.int32()), "anchors": none, "hot": none,
                     "masks": pa.array(bits, pa.binary())})


class Automaton:
    """Aho-Corasick automaton over words, given by their numbers; ``phrases`` is a table with a phrase a row."""

    def __init__(self, phrases: np.ndarray, letters: np.ndarray):
        """``letters`` has room for each word's character; it may be shared between automata."""
        import ahocorasick

        used = np.unique(phrases)
        letters[used] = np.arange(FIRST, FIRST + len(used))
        self.machine, width = ahocorasick.Automaton(ahocorasick.STORE_INTS), phrases.shape[1]
        text = self.spell(letters[phrases].ravel())
        for i in range(len(phrases)):
            self.machine.add_word(text[i * width: (i + 1) * width], i)
        self.machine.make_automaton()

    @staticmethod
    def spell(letters: np.ndarray) -> str:
        return letters.astype("<u4").tobytes().decode("utf-32-le")

    def stream(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the last word, number of the phrase) of every occurrence."""
        found = np.array(list(self.machine.iter(self.spell(letters))), np.int64).reshape(-1, 2)
        return found[:, 0], found[:, 1]


def locate(words: Words, own: Nominated, limit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first word of each occurrence, number of its window), shard by shard, of the windows that ``limit`` is given for.

    ``limit`` is -1 for windows that are not confirmed.
    """
    confirmed = limit[own.ids] >= 0
    at, ids = own.at[confirmed], own.ids[confirmed]
    if not len(at):
        return
    # Windows in the order of the text, each by its first occurrence.
    numbers, first = np.unique(ids, return_index=True)
    by = np.argsort(first)
    rank = np.empty(len(numbers), np.int64)
    rank[by] = np.arange(len(numbers))
    shard = rank[np.searchsorted(numbers, ids)] // SHARD
    order, cuts = groups(shard)
    # Nought stands between stretches, one for words that the automaton does not know; no phrase has either.
    letters = np.ones(len(words.vocabulary), np.int64)
    for s, places in enumerate(np.split(order, cuts[1:])):
        mine = by[s * SHARD: (s + 1) * SHARD]
        phrases = words.ids[at[first[mine]][:, None] + np.arange(LENGTH)]
        machine = Automaton(phrases, letters)
        starts = at[places]
        # Stretches of windows in a row, whole with the words that the last of them covers.
        new = np.ones(len(starts), bool)
        new[1:] = starts[1:] != starts[:-1] + 1
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(starts))) + LENGTH - 1
        begin = np.cumsum(sizes + 1) - (sizes + 1)
        stretch = np.repeat(np.arange(len(heads)), sizes + 1)
        step = np.arange(len(stretch)) - begin[stretch]
        word = starts[heads][stretch] + step
        text = np.where(step < sizes[stretch], letters[words.ids[np.minimum(word, len(words.ids) - 1)]], 0)
        end, phrase = machine.stream(text)
        yield word[end] - LENGTH + 1, numbers[mine[phrase]]
        letters[phrases] = 1


def removed(docs: pa.Table, facts: pa.Table, buckets: int) -> tuple[Words, np.ndarray]:
    """The words of a block, and which of them go."""
    words = Words(docs)
    cover = np.zeros(len(words.ids) + 1, np.int32)
    if len(facts):
        own = Nominated(words, facts, buckets)
        earlier = np.zeros(len(own.one), bool)
        sent = dict(own.parts())
        for b, bits in zip(facts.column("bucket").to_pylist(), facts.column("masks").to_pylist(), strict=True):
            if bits is not None:
                here = sent[b]
                earlier[here] = np.unpackbits(np.frombuffer(bits, np.uint8), count=here.stop - here.start).astype(bool)
        # Confirmed: a smaller document of another block has it, or two documents of this one.  Limits are ranks of ids.
        ranks, rank = np.unique(words.order, return_inverse=True)
        most = np.full(len(own.one), np.iinfo(np.int64).min)
        np.maximum.at(most, own.ids, own.holder)
        least = np.searchsorted(ranks, own.least)
        limit = np.where(earlier, 0, np.where(most > own.least, least + 1, -1))
        for start, number in locate(words, own, limit):
            # Places count from 0 for an id: below the limit it is the first that has the window.
            gone = start[rank[words.owner[start]] >= limit[number]]
            np.add.at(cover, gone, 1)
            np.add.at(cover, gone + LENGTH, -1)
    return words, np.cumsum(cover[:-1]) > 0


def kept(words: Words, gone: np.ndarray) -> Iterator[bytes]:
    """The words that stay, of each document, joined by one space."""
    spell = words.vocabulary.__getitem__
    for a, b in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True):
        yield b" ".join(map(spell, words.ids[a:b][~gone[a:b]].tolist()))


def report(key: str, buckets: int) -> Callable:
    def run(_: tuple, docs: pa.Table, facts: pa.Table) -> pa.Table:
        words, gone = removed(docs, facts, buckets)
        lost = np.diff(np.concatenate(([0], np.cumsum(gone)))[words.offsets])
        return pa.table({key: docs.column("key").combine_chunks(), "n_words": pa.array(np.diff(words.offsets)), "n_removed": pa.array(lost.astype(np.int64)),
                         "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept(words, gone)], pa.string())})

    return run


def kept_text(buckets: int) -> Callable:
    def run(_: tuple, docs: pa.Table, facts: pa.Table) -> pa.Table:
        words, gone = removed(docs, facts, buckets)
        here = docs.column("text").is_valid().to_pylist()
        touched = np.diff(np.concatenate(([0], np.cumsum(gone)))[words.offsets]) > 0
        texts = [new.decode() if hit else old for new, hit, old in zip(kept(words, gone), touched.tolist(), docs.column("text").to_pylist(), strict=True)]
        texts = [t if ok else None for t, ok in zip(texts, here, strict=True)]
        return docs.set_column(docs.schema.get_field_index("text"), "text", pa.array(texts, pa.string())).drop_columns(["key", "order", "block"])

    return run


def in_blocks(frame: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(documents by block, facts by block, buckets) of a frame with key and text, and whatever is carried along."""
    total = frame.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    size = min(max(12 * math.isqrt(total), BLOCK[0]), BLOCK[1])
    blocks = max(1, -(-total // size))
    buckets = blocks // 2 + 1
    order = F.coalesce(F.col("key").cast("long"), F.lit(LAST))
    # The text's hash keeps rows without id, or with the same one, apart.
    placed = frame.withColumn("order", order).withColumn("block", F.pmod(F.xxhash64("key", "text"), F.lit(blocks)).cast("int"))
    docs = placed.repartition(shuffle_partitions(frame.sparkSession), "block")
    # All of it is one job, and all three readers of ``docs`` ask for the same columns: the texts are shuffled once.
    sent = docs.groupBy("block").applyInArrow(send_anchors(buckets), "bucket int, block int, anchors binary, more binary, counts binary")
    again = sent.groupBy("bucket").applyInArrow(find_repeated, FACTS)
    asked = docs.groupBy("block").cogroup(again.groupBy("block")).applyInArrow(send_windows(buckets), SENT)
    return docs, again.union(asked.groupBy("bucket").applyInArrow(confirm, FACTS)), buckets


def words_removed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_removed, kept_sha256) of every row."""
    frame = narrow(docs, key=key, text=text)
    placed, facts, buckets = in_blocks(frame)
    kind = frame.schema["key"].dataType.simpleString()
    return (placed.groupBy("block").cogroup(facts.groupBy("block"))
            .applyInArrow(report(key, buckets), f"`{key}` {kind}, n_words bigint, n_removed bigint, kept_sha256 string"))


def rewrite(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with all their columns; texts that lose words are what is left of them, joined by one space."""
    own = at(docs, text)
    frame = numbered(docs).withColumn("key", F.col(at(docs, key))).withColumnRenamed(own, "text")
    placed, facts, buckets = in_blocks(frame)
    found = placed.groupBy("block").cogroup(facts.groupBy("block")).applyInArrow(kept_text(buckets), frame.drop("key").schema)
    return named(found.withColumnRenamed("text", own), docs)


ORACLE = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    x AS (SELECT doc_id, i, w[i: i + 12] AS s FROM d, range(1, len(w) - 11) r(i)),
    f AS (SELECT s, min(doc_id) AS m FROM x GROUP BY s),
    r AS (SELECT DISTINCT doc_id, i + k AS i FROM x JOIN f USING (s), range(0, 13) o(k) WHERE m < doc_id),
    g AS (SELECT doc_id, list(i) AS gone FROM r GROUP BY 1)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
        sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(gone, []), i)), ' ')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)"""


@query("op13_phrases", ORACLE)
def op13_phrases(spark, sf):
    return words_removed(table(spark, sf, "documents"))
