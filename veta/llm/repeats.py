"""Exact substring dedup with run-length indexes.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller id.

The text is cut where equal strings are cut alike: each string of ``LENGTH`` bytes belongs to the smallest hash among its
16-byte pieces, its *anchor*, and consecutive strings of one anchor form a stretch of some 65 bytes on average.  Equal
strings share their anchor, so the work splits by anchor without losing a match:

1. documents go to blocks; each block sends the hashes of its anchors, 5 bytes each, and learns which of them another
   document has as well;
2. for those anchors only, each block sends its distinct stretches, each with the smallest id that has it in the block;
3. stretches of an anchor meet in a part.  Where an anchor has but one stretch, its strings are all settled.  Over the
   others a run-length index is built: the Burrows-Wheeler transform of the stretches as runs, with sampled run ends.  The
   stretches are streamed against it from right to left; their matching statistics, cut at ``LENGTH``, are intervals of
   the transform, and each such interval knows the smallest document in it;
4. each block learns which strings of its stretches a smaller document has, and removes bytes.

A passage that many documents share is one stretch a block, however many of the block's documents hold it.  Anchors with
more than ``HOT`` occurrences would bring together the different surroundings of a frequent passage in one part; their
strings are sent one by one instead and meet under the hash of the whole string, which spreads them.

Nulls are empty texts; nothing is removed from texts shorter than ``LENGTH``.  Null ids come after all others.  Rows with
equal ids (repeated rows among them) do not remove from each other, nor null ids among themselves.  Columns beside id and
text are ignored, or carried along by ``rewrite``.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veta.llm.common import at, byte_view, named, narrow, numbered, portions, query, table
from veta.session import shuffle_partitions

LENGTH, PIECE = 50, 16
#: Strings of a stretch, at most; a bit each in a mask.
STRETCH = 64
HOT = 4096
#: Bytes of stretches under one index.
INDEX = 1 << 18
#: Bytes of text in a block grow with the square root of all text between these.
BLOCK = (4 << 20, 128 << 20)
PORTION = 1 << 18
LAST = np.iinfo(np.int64).max
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
LOW = np.uint64((1 << 40) - 1)


def stretches_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of strings and anchor of each stretch of these texts."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    x = data.astype(np.uint64)
    for step in (1, 2, 4):
        x = x[:-step] | x[step:] << np.uint64(8 * step)
    first, second = x[:-8] * ODD[0], x[8:]
    first ^= first >> np.uint64(29)
    first += second
    first *= ODD[1]
    first ^= first >> np.uint64(32)
    first *= ODD[2]
    first ^= first >> np.uint64(29)
    low = first
    for step in (1, 2, 4, 8, 16, LENGTH - PIECE + 1 - 32):
        low = np.minimum(low[:-step], low[step:])
    late = np.zeros(n + 1, np.int32)
    np.add.at(late, np.maximum(offsets[:-1], offsets[1:] - LENGTH + 1), 1)
    np.add.at(late, offsets[1:], -1)
    whole = np.cumsum(late[: len(low)]) == 0
    new = whole.copy()
    new[1:] &= ~whole[:-1] | (low[1:] != low[:-1])
    end = whole.copy()
    end[:-1] &= ~whole[1:] | (low[1:] != low[:-1])
    starts = np.flatnonzero(new)
    counts = np.flatnonzero(end) - starts + 1
    pieces = -(-counts // STRETCH)
    if len(pieces) and pieces.max() > 1:
        own = np.repeat(np.arange(len(starts)), pieces)
        at = (np.arange(len(own)) - (np.cumsum(pieces) - pieces)[own]) * STRETCH
        starts, counts = starts[own] + at, np.minimum(counts[own] - at, STRETCH)
    # Smallest hashes are small: mixed once more, they spread evenly over buckets.
    anchors = (low[starts] ^ low[starts] >> np.uint64(31)) * ODD[0]
    return starts, counts, anchors ^ anchors >> np.uint64(29)


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of strings, anchor and document of each stretch of a block."""
    found = [(stretches_of(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i]), offsets[i]) for i, j in portions(offsets, PORTION)]
    starts = np.concatenate([f[0] + at for f, at in found] or [np.zeros(0, np.int64)])
    counts, anchors = (np.concatenate([f[k] for f, _ in found] or [np.zeros(0, kind)]) for k, kind in ((1, np.int64), (2, np.uint64)))
    return starts, counts, anchors, np.searchsorted(offsets, starts, "right") - 1


def bucket_of(anchors: np.ndarray, buckets: int) -> np.ndarray:
    return (anchors >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)


def short(anchors: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and low 40 bits, by which anchors are compared; anchors that agree by chance only cost work."""
    return bucket_of(anchors, buckets) << np.uint64(40) | anchors & LOW


def five(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unfive(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8")[:, 0]


def view(docs: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets and order of a block's documents."""
    data, offsets = byte_view(docs.column("text").combine_chunks().cast(pa.large_string()))
    return data, offsets, docs.column("order").to_numpy()


def groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sorting order, and where in it each distinct value starts."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    return order, np.flatnonzero(np.concatenate((np.ones(min(1, len(values)), bool), ordered[1:] != ordered[:-1])))


def send_anchors(buckets: int) -> Callable:
    def run(key: tuple, docs: pa.Table) -> pa.Table:
        _, _, anchors, own = stretches(*view(docs)[:2])
        block = key[0].as_py()
        names = short(anchors, buckets)
        order, at = groups(names)
        rows = []
        if len(at):
            own, names = own[order], names[order][at]
            several = np.minimum.reduceat(own, at) != np.maximum.reduceat(own, at)
            counts = np.diff(np.concatenate((at, [len(order)])))
            cut = np.searchsorted(names >> np.uint64(40), np.arange(buckets + 1, dtype=np.uint64))
            for b in np.flatnonzero(np.diff(cut)).tolist():
                part = slice(cut[b], cut[b + 1])
                more = np.flatnonzero(several[part])
                rows.append((b, five(names[part]), more.astype("<u4").tobytes(), counts[part][more].astype("<u4").tobytes()))
        bucket, values, more, counts = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.table({"bucket": pa.array(bucket, pa.int32()), "block": pa.array([block] * len(rows), pa.int32()), "anchors": pa.array(values, pa.binary()),
                         "more": pa.array(more, pa.binary()), "counts": pa.array(counts, pa.binary())})

    return run


def find_repeated(key: tuple, sent: pa.Table) -> pa.Table:
    """Which anchors of each block are in another document as well, and which of those are hot."""
    block = sent.column("block").to_pylist()
    parts = [unfive(x) for x in sent.column("anchors").to_pylist()]
    sizes = np.array([len(p) for p in parts])
    starts = np.cumsum(sizes) - sizes
    several, weight = np.zeros(sizes.sum(), bool), np.ones(sizes.sum(), np.int64)
    for s, more, counts in zip(starts.tolist(), sent.column("more").to_pylist(), sent.column("counts").to_pylist(), strict=True):
        at = s + np.frombuffer(more, "<u4").astype(np.int64)
        several[at], weight[at] = True, np.frombuffer(counts, "<u4")
    names = np.concatenate(parts)
    order, at = groups(names)
    sizes_of = np.diff(np.concatenate((at, [len(order)])))
    again = (sizes_of > 1) | np.logical_or.reduceat(several[order], at)
    hot = again & (np.add.reduceat(weight[order], at) > HOT)
    keep, heat = np.empty(len(order), bool), np.empty(len(order), bool)
    keep[order], heat[order] = np.repeat(again, sizes_of), np.repeat(hot, sizes_of)
    rows = []
    for b, s, n in zip(block, starts.tolist(), sizes.tolist(), strict=True):
        kept = s + np.flatnonzero(keep[s: s + n])
        if len(kept):
            rows.append((b, five(names[kept]), heat[kept].tobytes()))
    blocks, anchors, heats = zip(*rows, strict=True) if rows else ((), (), ())
    none = pa.nulls(len(rows), pa.binary())
    return pa.table({"block": pa.array(blocks, pa.int32()), "bucket": pa.array([key[0].as_py()] * len(rows), pa.int32()), "anchors": pa.array(anchors, pa.binary()),
                     "hot": pa.array(heats, pa.binary()), "masks": none})


FACTS = "block int, bucket int, anchors binary, hot binary, masks binary"


class Candidates:
    """A block's stretches whose anchors are repeated: distinct bytes in order, and each occurrence."""

    def __init__(self, docs: pa.Table, facts: pa.Table, buckets: int):
        self.data, self.offsets, self.order = view(docs)
        starts, counts, anchors, own = stretches(self.data, self.offsets)
        told = [(np.uint64(b) << np.uint64(40) | unfive(a), np.frombuffer(h, bool)) for b, a, h in
                zip(*(facts.column(c).to_pylist() for c in ("bucket", "anchors", "hot")), strict=True) if a is not None]
        names = np.concatenate([t[0] for t in told] or [np.zeros(0, np.uint64)])
        hot = np.concatenate([t[1] for t in told] or [np.zeros(0, bool)])
        by = np.argsort(names)
        names, hot = names[by], hot[by]
        mine = short(anchors, buckets)
        at = np.minimum(np.searchsorted(names, mine), max(0, len(names) - 1))
        found = names[at] == mine if len(names) else np.zeros(len(mine), bool)
        starts, counts, own, mine, hot = starts[found], counts[found], own[found], mine[found], hot[at[found]] if len(names) else np.zeros(0, bool)
        if hot.any():
            single = np.where(hot, counts, 1)
            which = np.repeat(np.arange(len(starts)), single)
            step = np.arange(len(which)) - (np.cumsum(single) - single)[which]
            starts, own, mine = starts[which] + step, own[which], mine[which]
            counts, hot = np.where(hot[which], 1, counts[which]), hot[which]
        raw = self.data.tobytes()
        texts = [raw[a:b] for a, b in zip(starts.tolist(), (starts + counts + LENGTH - 1).tolist(), strict=True)]
        # The number of a distinct stretch must not depend on the order of rows: the block is worked out twice.
        self.texts = sorted(set(texts))
        number = {t: i for i, t in enumerate(self.texts)}
        self.ids = np.array([number[t] for t in texts], np.int64)
        self.starts, self.counts, self.own = starts, counts, own
        self.least = np.full(len(self.texts), LAST)
        np.minimum.at(self.least, self.ids, self.order[own])
        self.names, self.hot = np.zeros(len(self.texts), np.uint64), np.zeros(len(self.texts), bool)
        self.names[self.ids], self.hot[self.ids] = mine, hot
        for i in np.flatnonzero(self.hot).tolist():
            self.names[i] = int.from_bytes(hashlib.blake2b(self.texts[i], digest_size=8).digest(), "little")

    def parts(self, buckets: int) -> list[tuple[int, np.ndarray]]:
        """Numbers of the distinct stretches by the part that settles them: their anchor's bucket, of a hot one any."""
        part = np.where(self.hot, self.names % np.uint64(buckets), self.names >> np.uint64(40)).astype(np.int64)
        order, at = groups(part)
        return [(int(part[ids[0]]), ids) for ids in np.split(order, at[1:])] if len(order) else []


def send_stretches(buckets: int) -> Callable:
    """Each part gets the block's distinct stretches in the order of their numbers, so it can answer by place."""

    def run(key: tuple, docs: pa.Table, facts: pa.Table) -> pa.Table:
        own = Candidates(docs, facts, buckets) if len(docs) and len(facts) else None
        rows = []
        if own and own.texts:
            for part, ids in own.parts(buckets):
                texts = [own.texts[i] for i in ids.tolist()]
                holders, holder = np.unique(own.least[ids], return_inverse=True)
                sizes, joined = np.array([len(t) for t in texts], "u1").tobytes(), b"".join(texts)
                rows.append((part, len(ids), pa.compress(sizes, "zstd", asbytes=True), len(joined), pa.compress(joined, "zstd", asbytes=True),
                             holders.astype("<i8").tobytes(), holder.astype("<u4").tobytes(), five(own.names[ids])))
        part, n, sizes, length, texts, holders, holder, names = zip(*rows, strict=True) if rows else ((),) * 8
        return pa.table({"part": pa.array(part, pa.int32()), "block": pa.array([key[0].as_py()] * len(rows), pa.int32()), "n": pa.array(n, pa.int64()),
                         "length": pa.array(length, pa.int64()),
                         **{c: pa.array(v, pa.binary()) for c, v in (("sizes", sizes), ("texts", texts), ("holders", holders), ("holder", holder), ("names", names))}})

    return run


SENT = "part int, block int, n bigint, length bigint, sizes binary, texts binary, holders binary, holder binary, names binary"


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of some strings.

    Kept are the runs (character, start, length, occurrences before), the places where suffixes stop sharing their first
    ``LENGTH`` characters, and for each interval between such places the position of a suffix in the smallest document.
    """

    def __init__(self, texts: list[bytes], least: np.ndarray):
        sizes = np.array([len(t) for t in texts])
        self.text = text = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.uint16) + 1
        ends = np.cumsum(sizes + 1) - 1
        text[ends] = 0
        order = self.suffixes(text)
        # Where in the order each text's last string stands: from there its other strings are reached step by step.
        place = np.empty(len(text), np.int32)
        place[order] = np.arange(len(text), dtype=np.int32)
        self.toe = place[ends - LENGTH]
        before = text[order - 1]
        change = np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1])))
        self.heads, self.length = before[change].astype(np.int64), len(text)
        spans = np.diff(np.concatenate((change, [len(text)])))
        counts = np.bincount(before, minlength=258)
        self.smaller = np.concatenate(([0], np.cumsum(counts)))[:258]
        # Runs by character, so that one search finds the last run of a character before a place.
        keys = self.heads * (len(text) + 1) + change
        by = np.argsort(keys)
        self.keys, self.starts, self.spans = keys[by], change[by], spans[by]
        total = np.cumsum(self.spans) - self.spans
        self.chars = self.heads[by]
        self.seen = total - self.smaller[self.chars]
        # Where neighbours in the order differ within LENGTH characters.
        differ = np.zeros(len(text), bool)
        differ[0] = True
        words = self.packed(text, 7)
        words = np.concatenate((words, np.zeros(LENGTH, np.uint64)))
        same = np.arange(1, len(text))
        for k in (*range(0, LENGTH - 6, 7), LENGTH - 7):
            # Only neighbours that have agreed so far are looked at.
            other = words[order[same] + k] != words[order[same - 1] + k]
            differ[same[other]] = True
            same = same[~other]
        self.cuts = np.concatenate((np.flatnonzero(differ), [len(text)]))
        of = np.repeat(least, sizes + 1)[order]
        self.least = np.minimum.reduceat(of, self.cuts[:-1])
        # A sample an interval: the first suffix of the smallest document.
        first = np.flatnonzero(of == np.repeat(self.least, np.diff(self.cuts)))
        self.samples = order[first[np.searchsorted(first, self.cuts[:-1])]]

    @staticmethod
    def packed(text: np.ndarray, width: int) -> np.ndarray:
        """The ``width`` characters from each place on as one number."""
        wide, out = np.concatenate((text, np.zeros(width, np.uint16))).astype(np.uint64), np.zeros(len(text), np.uint64)
        for k in range(width):
            out = out << np.uint64(9) | wide[k: len(text) + k]
        return out

    @staticmethod
    def suffixes(text: np.ndarray) -> np.ndarray:
        """Order of the suffixes by their first 56 characters: seven packed at first, then doubled three times."""
        n, packed = len(text), RunIndex.packed(text, 7)
        for step in (0, 7, 14, 28):
            if step:
                packed = rank.astype(np.uint64) << np.uint64(32)
                packed[:-step] |= rank[step:]
            order = np.argsort(packed).astype(np.int32)
            new = np.ones(n, bool)
            for s in range(0, n - 1, 1 << 18):
                ordered = packed[order[s: s + (1 << 18) + 1]]
                new[s + 1: s + len(ordered)] = ordered[1:] != ordered[:-1]
            rank = np.empty(n, np.uint32)
            rank[order] = np.cumsum(new, dtype=np.uint32)
        return order

    def rank(self, chars: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each character before each place of the transform."""
        run = np.searchsorted(self.keys, chars * (self.length + 1) + at, "left") - 1
        inside = (run >= 0) & (self.chars[run] == chars)
        return np.where(inside, self.seen[run] + np.minimum(self.spans[run], at - self.starts[run]), 0)

    def interval(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.cuts, place, "right") - 1

    def matches(self, texts: list[bytes]) -> np.ndarray:
        """(texts x STRETCH) interval of each string of each of the index's texts, -1 beyond its last.

        From the sample at a text's last string, each step to the left extends the match by a character and cuts it back
        to ``LENGTH``, which widens it to the interval of all suffixes that share so much.  The start of an interval is
        enough to go on from: one of its suffixes has the character before it.
        """
        last = np.array([len(t) for t in texts]) - LENGTH
        order = np.argsort(-last, kind="stable")
        found = np.full((len(texts), STRETCH), -1, np.int32)
        now = self.interval(self.toe)
        found[np.arange(len(texts)), last] = now
        wide = np.zeros((len(texts), STRETCH), np.uint8)
        flat = np.frombuffer(b"".join([t[:-LENGTH] for t in texts]), np.uint8)
        row = np.repeat(np.arange(len(texts)), last)
        wide[row, np.arange(len(flat)) - np.repeat(np.cumsum(last) - last, last)] = flat
        now, last, wide = now[order], last[order], wide[order]
        for step in range(1, int(last[0]) + 1 if len(last) else 1):
            live = int(np.searchsorted(-last, -step, "right"))
            at = last[:live] - step
            chars = wide[np.arange(live), at].astype(np.int64) + 1
            now = self.interval(self.smaller[chars] + self.rank(chars, self.cuts[now[:live]]))
            found[order[:live], at] = now
        return found


def settle(key: tuple, sent: pa.Table) -> pa.Table:
    cols = {c: sent.column(c).to_pylist() for c in ("block", "n", "length", "sizes", "texts", "holders", "holder", "names")}
    number: dict[bytes, int] = {}
    own: list[np.ndarray] = []
    for n, length, sizes, text in zip(cols["n"], cols["length"], cols.pop("sizes"), cols.pop("texts"), strict=True):
        text = pa.decompress(text, length, "zstd", asbytes=True)
        ends = np.cumsum(np.frombuffer(pa.decompress(sizes, n, "zstd", asbytes=True), "u1").astype(np.int64)).tolist()
        own.append(np.array([number.setdefault(text[a:b], len(number)) for a, b in zip([0, *ends], ends, strict=False)], np.int64))
    own = np.concatenate(own)
    least = np.concatenate([np.frombuffer(h, "<i8")[np.frombuffer(i, "<u4")] for h, i in zip(cols["holders"], cols["holder"], strict=True)])
    names = np.concatenate([unfive(x) for x in cols["names"]])
    smallest, name = np.full(len(number), LAST), np.zeros(len(number), np.uint64)
    np.minimum.at(smallest, own, least)
    name[own] = names
    masks = np.where(smallest[own] < least, ~np.uint64(0), np.uint64(0))
    order, at = groups(name)
    sizes = np.diff(np.concatenate((at, [len(order)])))
    chosen = np.flatnonzero(sizes > 1)
    distinct = list(number)
    bytes_of = np.add.reduceat(np.array([len(t) for t in distinct])[order], at) if len(at) else np.zeros(0, np.int64)
    # Anchors are independent of each other: an index for each INDEX bytes of stretches stays in the processor's cache.
    cut = (np.cumsum(bytes_of[chosen]) - bytes_of[chosen]) // INDEX
    first = np.flatnonzero(np.diff(cut, prepend=-1))
    where = np.full((len(number), STRETCH), LAST)
    for some in np.split(chosen, first[1:]) if len(chosen) else []:
        these = np.concatenate([order[at[g]: at[g] + sizes[g]] for g in some.tolist()])
        strings = [distinct[i] for i in these.tolist()]
        index = RunIndex(strings, smallest[these])
        found = index.matches(strings)
        where[these] = np.where(found >= 0, index.least[found], LAST)
    disputed = np.zeros(len(number), bool)
    disputed[order[np.repeat(sizes > 1, sizes)]] = True
    rows = np.flatnonzero(disputed[own])
    for s in range(0, len(rows), 1 << 14):
        part = rows[s: s + (1 << 14)]
        masks[part] = np.packbits(where[own[part]] < least[part, None], axis=1, bitorder="little").view("<u8")[:, 0]
    out, at = [], 0
    for block, n in zip(cols["block"], cols["n"], strict=True):
        mine = masks[at: at + n]
        at += n
        some = np.flatnonzero(mine)
        if len(some):
            out.append((block, some.astype("<u4").tobytes(), mine[some].astype("<u8").tobytes()))
    blocks, places, bits = zip(*out, strict=True) if out else ((), (), ())
    # In the columns of the facts: the part in the bucket's, places within what the block sent to it in the heat's.
    return pa.table({"block": pa.array(blocks, pa.int32()), "bucket": pa.array([key[0].as_py()] * len(out), pa.int32()), "anchors": pa.nulls(len(out), pa.binary()),
                     "hot": pa.array(places, pa.binary()), "masks": pa.array(bits, pa.binary())})


def removed(docs: pa.Table, facts: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and offsets of a block, and which bytes go."""
    data, offsets, _ = view(docs)
    cover = np.zeros(len(data) + 1, np.int32)
    if len(facts):
        own = Candidates(docs, facts, buckets)
        masks = np.zeros(len(own.texts), np.uint64)
        sent = dict(own.parts(buckets))
        for part, places, bits in zip(*(facts.column(c).to_pylist() for c in ("bucket", "hot", "masks")), strict=True):
            if bits is not None:
                masks[sent[part][np.frombuffer(places, "<u4")]] = np.frombuffer(bits, "<u8")
        # Whoever is not the smallest holder of a stretch in the block has all its strings earlier.
        mine = np.where(own.order[own.own] > own.least[own.ids], ~np.uint64(0), masks[own.ids])
        every = ~np.uint64(0) >> (STRETCH - own.counts).astype(np.uint64)
        mine &= every
        whole, part = np.flatnonzero(mine == every), np.flatnonzero((mine != every) & (mine != 0))
        bits = np.unpackbits(mine[part].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, at = np.nonzero(bits)
        first = np.concatenate((own.starts[whole], own.starts[part[row]] + at))
        last = np.concatenate((own.starts[whole] + own.counts[whole], own.starts[part[row]] + at + 1))
        cover += np.bincount(first, minlength=len(cover)).astype(np.int32)
        cover -= np.bincount(last + LENGTH - 1, minlength=len(cover)).astype(np.int32)
    return data, offsets, np.cumsum(cover[:-1]) > 0


def report(key: str, buckets: int) -> Callable:
    def run(_: tuple, docs: pa.Table, facts: pa.Table) -> pa.Table:
        data, offsets, gone = removed(docs, facts, buckets)
        rise = gone.copy()
        rise[1:] &= ~gone[:-1]
        edges = offsets[:-1][np.diff(offsets) > 0]
        rise[edges] = gone[edges]
        lost, spans = (np.diff(np.concatenate(([0], np.cumsum(x)))[offsets]) for x in (gone, rise))
        digests = [hashlib.sha256(data[a:b][~gone[a:b]].tobytes()).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        return pa.table({key: docs.column("key").combine_chunks(), "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(lost.astype(np.int64)),
                         "n_spans": pa.array(spans.astype(np.int64)), "kept_sha256": pa.array(digests, pa.string())})

    return run


def kept_text(buckets: int) -> Callable:
    def run(_: tuple, docs: pa.Table, facts: pa.Table) -> pa.Table:
        data, offsets, gone = removed(docs, facts, buckets)
        here = docs.column("text").is_valid().to_pylist()
        texts = [data[a:b][~gone[a:b]].tobytes().decode("utf-8", "ignore") if ok else None for a, b, ok in zip(offsets[:-1].tolist(), offsets[1:].tolist(), here, strict=True)]
        return docs.set_column(docs.schema.get_field_index("text"), "text", pa.array(texts, pa.string())).drop_columns(["key", "order", "block"])

    return run


def in_blocks(frame: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(documents by block, facts by block, buckets) of a frame with key and text, and whatever is carried along."""
    spark = frame.sparkSession
    total = frame.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    size = min(max(12 * math.isqrt(total), BLOCK[0]), BLOCK[1])
    blocks = max(1, -(-total // size))
    buckets = blocks // 2 + 1
    order = F.coalesce(F.col("key").cast("long"), F.lit(LAST))
    placed = frame.withColumn("order", order).withColumn("block", F.pmod(F.xxhash64("key", F.octet_length("text")), F.lit(blocks)).cast("int"))
    docs = placed.repartition(shuffle_partitions(spark), "block")
    # All of it is one job, and all three readers of ``docs`` ask for the same columns: the texts are shuffled once.
    sent = docs.groupBy("block").applyInArrow(send_anchors(buckets), "bucket int, block int, anchors binary, more binary, counts binary")
    again = sent.groupBy("bucket").applyInArrow(find_repeated, FACTS)
    pieces = docs.groupBy("block").cogroup(again.groupBy("block")).applyInArrow(send_stretches(buckets), SENT)
    return docs, again.union(pieces.groupBy("part").applyInArrow(settle, FACTS)), buckets


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    frame = narrow(docs, key=key, text=text)
    placed, facts, buckets = in_blocks(frame)
    kind = frame.schema["key"].dataType.simpleString()
    return (placed.groupBy("block").cogroup(facts.groupBy("block"))
            .applyInArrow(report(key, buckets), f"`{key}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"))


def rewrite(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with all their columns, without the repeated bytes of the text; characters of which a part goes go whole."""
    own = at(docs, text)
    frame = numbered(docs).withColumn("key", F.col(at(docs, key))).withColumnRenamed(own, "text")
    placed, facts, buckets = in_blocks(frame)
    found = placed.groupBy("block").cogroup(facts.groupBy("block")).applyInArrow(kept_text(buckets), frame.drop("key").schema)
    return named(found.withColumnRenamed("text", own), docs)


ORACLE = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
    w AS (SELECT doc_id, i, substr(x, (2 * i + 1)::BIGINT, 100) AS s FROM d, range(0, n - 49) r(i)),
    f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s),
    r AS (SELECT doc_id, i, i - lag(i, 1, -100) OVER (PARTITION BY doc_id ORDER BY i) > 50 AS fresh FROM w JOIN f USING (s) WHERE m < doc_id),
    g AS (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM r),
    p AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY ALL),
    q AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM p),
    t AS (SELECT d.doc_id, sum(b - a) AS gone, count(*) AS spans, string_agg(substr(x, (2 * z + 1)::BIGINT, (2 * (a - z))::BIGINT), '' ORDER BY a)
      || substr(any_value(x), (2 * max(b) + 1)::BIGINT) AS kept FROM q JOIN d USING (doc_id) GROUP BY 1)
    SELECT doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
    FROM d LEFT JOIN t USING (doc_id)"""


@query("op6_repeats", ORACLE)
def op6_repeats(spark, sf):
    return spans(table(spark, sf, "documents"))
