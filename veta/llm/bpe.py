"""Byte-level BPE by prefix dynamic programming.

Every prefix of a piece of text has exactly one token that can end its encoding: the encoding of the prefix is that
token after the encoding of what stands before it, and two tokens may be neighbours only if encoding their joined bytes
gives the two tokens back.  Storing that last token for each prefix encodes in one pass, lets bytes be appended exactly,
and after an edit only the stretch up to where the stored tokens agree again is worked out anew.

Nulls count as the empty text; an empty text has no ids.  Rows are handled one by one: repeated rows, null ids and
columns besides the two named ones make no difference.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veta.llm.common import narrow, process_memo, query, table, trimmed

#: Bytes that a worker process remembers pieces and pairs of tokens in, and the share of the pairs.
MEMORY, PAIR_SHARE = 40 << 20, 0.4
#: Longer pieces are worked out each time.
LONGEST = 64
#: Bytes of an entry of a memo besides its key's and value's own.
ENTRY = 100


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(ranks: dict[bytes, int], data: bytes) -> list[int]:
    """Encoding by the definition, merging the lowest rank first; quadratic, for pairs of tokens only."""
    none, find = len(ranks) * 2, ranks.get
    parts = [data[i: i + 1] for i in range(len(data))]
    # Only the two pairs that hold a merged part change their rank.
    found = [find(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while found:
        best = min(found)
        if best == none:
            break
        at = found.index(best)
        parts[at: at + 2] = [parts[at] + parts[at + 1]]
        del found[at]
        if at:
            found[at - 1] = find(parts[at - 1] + parts[at], none)
        if at < len(found):
            found[at] = find(parts[at] + parts[at + 1], none)
    return [ranks[p] for p in parts]


class Memo(dict):
    """Values of ``work``, remembered in about ``budget`` bytes: what was not asked for lately is forgotten by halves."""

    def __init__(self, budget: int):
        super().__init__()
        self.budget, self.held, self.old = budget, 0, {}

    def work(self, key: object) -> object:
        raise NotImplementedError

    def cost(self, key: object, value: object) -> int:
        """Bytes of an entry; 0 for one that is not to be remembered."""
        return ENTRY

    def __missing__(self, key: object) -> object:
        value = self.old.get(key)
        if value is None:
            value = self.work(key)
        cost = self.cost(key, value)
        if cost:
            if 2 * (self.held + cost) > self.budget:
                self.old, self.held = self.copy(), 0
                self.clear()
            self.held += cost
            self[key] = value
        return value


class Pairs(Memo):
    """Whether two tokens may stand next to each other; a first token of -1 asks for the second alone."""

    def __init__(self, ranks: dict[bytes, int], budget: int = int(PAIR_SHARE * MEMORY)):
        super().__init__(budget)
        self.ranks, self.tokens = ranks, {i: t for t, i in ranks.items()}

    def work(self, key: int) -> bool:
        first, second = (key >> 32) - 1, key & 0xFFFFFFFF
        want = [second] if first < 0 else [first, second]
        return merge(self.ranks, b"".join(self.tokens[t] for t in want)) == want


class Prefixes:
    """The last token of every prefix of ``data``."""

    def __init__(self, ranks: dict[bytes, int], pairs: Pairs | None = None, longest: int | None = None):
        self.ranks, self.pairs = ranks, Pairs(ranks) if pairs is None else pairs
        self.longest = longest or max(map(len, ranks))
        self.data, self.last = b"", [-1]

    def append(self, more: bytes) -> Prefixes:
        """Extend by ``more``; what is stored stays."""
        self.data += more
        self._fill(len(self.data))
        return self

    def _fill(self, end: int, settled=None) -> None:
        data, last, find, pairs, longest = self.data, self.last, self.ranks.get, self.pairs, self.longest
        for i in range(len(last), end + 1):
            for j in range(i - longest if i > longest else 0, i):
                token = find(data[j:i])
                if token is not None and pairs[(last[j] + 1) << 32 | token]:
                    last.append(token)
                    break
            else:
                raise ValueError(f"byte {data[i - 1]} is not in the vocabulary")
            if settled and settled(i, last[i]):
                return

    def replace(self, start: int, end: int, by: bytes) -> int:
        """Put ``by`` in the place of bytes [start, end); the number of prefixes worked out anew is returned.

        The last token of a prefix depends on those of the ``longest`` prefixes before it, so once that many in a row
        equal the old ones, the rest is taken over.
        """
        old, shift = self.last, len(by) - (end - start)
        self.data, self.last = self.data[:start] + by + self.data[end:], old[: start + 1]
        same = 0

        def settled(i: int, token: int) -> bool:
            nonlocal same
            same = same + 1 if i > start + len(by) and old[i - shift] == token else 0
            return same >= self.longest

        self._fill(len(self.data), settled)
        done = len(self.last)
        self.last += old[done - shift:]
        return done - 1 - start

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at])
            at -= len(self.pairs.tokens[out[-1]])
        return out[::-1]


class Pieces(Memo):
    """Piece of text to its packed ids."""

    def __init__(self, ranks: dict[bytes, int], memory: int = MEMORY):
        super().__init__(int((1 - PAIR_SHARE) * memory))
        self.ranks, self.pairs, self.longest = ranks, Pairs(ranks, int(PAIR_SHARE * memory)), max(map(len, ranks))

    def work(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.ranks.get(data)
        if whole is not None:
            return whole.to_bytes(4, "little")
        return np.array(Prefixes(self.ranks, self.pairs, self.longest).append(data).ids(), "<u4").tobytes()

    def cost(self, piece: str, ids: bytes) -> int:
        return ENTRY + 80 + len(piece) + len(ids) if len(piece) <= LONGEST else 0


class Codec:
    """Texts to packed ids (little-endian unsigned 32-bit) and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memory: int = MEMORY):
        import regex

        self.split, self.pieces = regex.compile(pattern).findall, Pieces(ranks, memory)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text or "")))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def codec(ranks: dict[bytes, int], pattern: str, memory: int = MEMORY) -> Codec:
    """The worker's codec for this vocabulary, made once in each process."""
    mark = hashlib.sha256(repr((pattern, memory, sorted(ranks.items()))).encode()).hexdigest()
    return process_memo(f"codec {mark}", lambda: Codec(ranks, pattern, memory))


def texts(column: pa.Array) -> Iterator[str | None]:
    """Values one at a time, so that a batch is never held twice."""
    return (x.as_py() for x in column)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<long>) of every row."""
    frame = narrow(docs, key=key, text=text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for batch in batches:
            ids = [np.frombuffer(own.encode(x), "<u4").astype(np.int64) for x in texts(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], names=[key, "ids"])

    return frame.mapInArrow(run, f"`{key}` {frame.schema['key'].dataType.simpleString()}, ids array<bigint>")


def decode(encoded: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, data binary): the bytes that the ids stand for; null ids give no bytes."""
    frame = narrow(encoded, key=key, ids=ids)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for batch in batches:
            data = [own.decode(np.array(x.as_py() or [], "<u4").tobytes()) for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(data, pa.binary())], names=[key, "data"])

    return frame.mapInArrow(run, f"`{key}` {frame.schema['key'].dataType.simpleString()}, data binary")


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text", memory: int = MEMORY) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every row, encoded and decoded in one task without moving the ids.

    ``memory`` bounds what a worker process remembers: more of it saves time where words vary much.
    """
    frame = narrow(docs, key=key, text=text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern, memory)
        for batch in trimmed(batches):
            n, ids, back = [], [], []
            for x in texts(batch.column(1)):
                packed = own.encode(x)
                n.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                back.append(hashlib.sha256(own.decode(packed)).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
                                  names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = frame.schema["key"].dataType.simpleString()
    return frame.mapInArrow(run, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def multilingual() -> tuple[dict[bytes, int], str]:
    """Ranks and pattern of the installed vocabulary for many languages."""
    import public_tokenizers

    return read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


@query("op1_bpe")
def op1_bpe(spark, sf):
    return round_trip(table(spark, sf, "documents"), *multilingual(), memory=240 << 20)
