"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text is the average of the embeddings of its subwords, the 2- to 4-byte strings of its words with a space at either
end, hashed into ``BUCKETS``.  Embeddings and softmax are trained together by stochastic gradient descent in numpy, on a
bounded sample: about ``PER_LANG`` documents a language, chosen by a hash.  The executors turn each whole text into its bag
of at most ``BUCKETS`` subword counts, and only bags reach the driver.
A fifth of the sample is held back to calibrate: the temperature that makes the scores probabilities, and the score
below which a prediction is rejected, which loses at most ``LOST`` of the right predictions and is never above a half.
Predictions read whole texts.

A null text and a text without a letter get ``und`` and score 0, as does every text if no row has a label; they count as
rejected.  Labels of null are not learned from.  Null ids are not in the held-out part.  Repeated rows and extra columns
change nothing; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veta.llm.common import at, byte_view, named, narrow, numbered, portions, query, table, trimmed

BUCKETS, DIM = 1 << 14, 16
PER_LANG = 400
EPOCHS, BATCH, RATE = 4, 32, 1.0
LOST, SEED = 0.001, 11
UNKNOWN = "und"
#: Odd multipliers that hash 2-, 3- and 4-byte strings.
HASHES = {2: 2654435761, 3: 2246822519, 4: 3266489917}


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters in lower case with one space between words and at either end of each text, and where each text starts."""
    rows, low = len(offsets) - 1, data | ((data >= 65) & (data <= 90)).astype(np.uint8) << 5
    letter = ((low >= 97) & (low <= 122)) | (low >= 128)
    out = np.full(len(data) + rows + 1, 32, np.uint8)
    out[np.arange(len(data)) + 1 + np.repeat(np.arange(rows), np.diff(offsets))] = np.where(letter, low, 32)
    starts = offsets + np.arange(rows + 1)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    keep[starts] = True
    return out[keep], (np.cumsum(keep) - 1)[starts]


def subwords(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: buckets of all subwords in the order of the texts, and how many each text has."""
    text, starts = padded(data, offsets)
    wide = text.astype(np.uint32)
    gram = wide
    for n in (2, 3, 4):
        gram = gram[:-1] << np.uint32(8) | wide[n - 1:]
        place = np.arange(len(gram))
        # A text ends with the space that the next one starts with.
        own = np.searchsorted(starts[1:], place, "right")
        inside = place + n - 1 <= starts[np.minimum(own + 1, len(starts) - 1)]
        word = (gram & np.uint32(0xFFFF)) != 0x2020
        good = inside & word
        yield (gram[good] * np.uint32(HASHES[n]) >> np.uint32(32 - 14)).astype(np.int32), np.bincount(own[good], minlength=len(offsets) - 1)[: len(offsets) - 1]


def sums(values: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the rows of ``values`` over the subwords of each text, and number of subwords."""
    total, number = np.zeros((len(offsets) - 1, values.shape[1])), np.zeros(len(offsets) - 1, np.int64)
    for ids, counts in subwords(data, offsets):
        some = np.flatnonzero(counts)
        if len(some):
            total[some] += np.add.reduceat(values[ids], (np.cumsum(counts) - counts)[some], axis=0, dtype=np.float64)
        number += counts
    return total, number


@dataclass
class Model:
    langs: list[str]
    embedding: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.5

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of few languages, the embeddings are multiplied out once and not for each text."""
        direct = len(self.langs) <= self.embedding.shape[1]
        values = (self.embedding @ self.weights if direct else self.embedding).astype(np.float32)
        total, number = sums(values, data, offsets)
        mean = total / np.maximum(number, 1)[:, None]
        return (mean if direct else mean @ self.weights) + self.bias

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = softmax(self.logits(data, offsets) / self.temperature)
        return p.argmax(axis=1), p.max(axis=1)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def packed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return byte_view(pa.array(texts, pa.string()))


Bag = tuple[np.ndarray, np.ndarray]


def bag(text: str) -> Bag:
    """Distinct buckets of the whole text and how often each occurs."""
    total = sum(np.bincount(ids, minlength=BUCKETS) for ids, _ in subwords(*packed([text])))
    ids = np.flatnonzero(total)
    return ids.astype(np.int32), total[ids]


def stretch(text: str, seed: int) -> str:
    """Up to 19 words from somewhere in the text."""
    rng = np.random.default_rng(seed)
    start = text.rfind(" ", 0, int(rng.integers(0, max(1, len(text))))) + 1
    return " ".join(text[start: start + 1000].split()[: int(rng.integers(1, 20))])


@dataclass
class Example:
    lang: str
    whole: Bag
    part: Bag


def example(lang: str, text: str, seed: int) -> Example:
    return Example(lang, bag(text), bag(stretch(text, seed)))


def train(rows: list[tuple[str, str]], seed: int = SEED, **how) -> Model | None:
    """A model of (lang, text) rows; None without rows."""
    return fit([example(lang, text, seed + i) for i, (lang, text) in enumerate(rows)], seed=seed, **how)


def shares(counts: np.ndarray) -> np.ndarray:
    return counts / max(1, counts.sum())


def fit(rows: list[Example], epochs: int = EPOCHS, rate: float = RATE, lost: float = LOST, seed: int = SEED) -> Model | None:
    """A model of examples, each seen whole and as a stretch of a few of its words; None without examples."""
    if not rows:
        return None
    rng = np.random.default_rng(seed)
    langs = sorted({r.lang for r in rows})
    held = [r for i, r in enumerate(rows) if i % 5 == 0] if len(rows) >= 5 * len(langs) else rows
    used = [r for i, r in enumerate(rows) if i % 5] if held is not rows else rows
    seen = [(ids, shares(n)) for kind in ("whole", "part") for ids, n in (getattr(r, kind) for r in used)]
    y = np.array([langs.index(r.lang) for r in used] * 2)
    model = Model(langs, rng.normal(0, 0.1, (BUCKETS, DIM)), np.zeros((DIM, len(langs))), np.zeros(len(langs)))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(len(y))
        for s in range(0, len(order), BATCH):
            part = [i for i in order[s: s + BATCH] if len(seen[i][0])]
            if not part:
                continue
            ids, weight = np.concatenate([seen[i][0] for i in part]), np.concatenate([seen[i][1] for i in part])
            sizes = np.array([len(seen[i][0]) for i in part])
            own = np.repeat(np.arange(len(part)), sizes)
            hidden = np.add.reduceat(model.embedding[ids] * weight[:, None], np.cumsum(sizes) - sizes, axis=0)
            wrong = softmax(hidden @ model.weights + model.bias)
            wrong[np.arange(len(part)), y[part]] -= 1
            back = wrong @ model.weights.T
            model.weights -= step * hidden.T @ wrong
            model.bias -= step * wrong.mean(axis=0)
            np.subtract.at(model.embedding, ids, step * weight[:, None] * back[own])
    return calibrate(model, held, lost)


def calibrate(model: Model, held: list[Example], lost: float) -> Model:
    bags = [b for r in held for b in (r.whole, r.part)]
    z = np.stack([shares(n) @ model.embedding[ids] for ids, n in bags]) @ model.weights + model.bias
    y = np.repeat([model.langs.index(r.lang) for r in held], 2)
    every = np.arange(len(y))
    model.temperature = min(np.geomspace(0.05, 20, 61), key=lambda t: -np.log(softmax(z / t)[every, y] + 1e-12).mean())
    p = softmax(z / model.temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == y]
    model.reject_below = float(min(0.5, np.quantile(right, lost, method="lower"))) if len(right) else 0.5
    return model


def sample(docs: DataFrame, lang: str, text: str, key: str, per_lang: int = PER_LANG) -> list[Example]:
    """About ``per_lang`` labelled rows of each language, the same ones each time.  One row a language and the sample's bags reach the driver."""
    frame = narrow(docs, key=key, lang=lang, text=text).where("lang is not null and text is not null")
    counts = {r.lang: r["count"] for r in frame.groupBy("lang").count().collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, per_lang / n))])
    h = F.xxhash64(F.lit(SEED), "key", "text")
    chosen = frame.where(F.shiftrightunsigned(h, 11) / float(1 << 53) < share[F.col("lang")]).select("lang", h.alias("h"), "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, seed, whole in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                e = example(name, whole, seed % (1 << 64))
                parts = [x.astype(kind).tobytes() for b in (e.whole, e.part) for x, kind in zip(b, ("<i4", "<i8"), strict=True)]
                yield pa.record_batch([pa.array([name]), pa.array([seed]), *[pa.array([x], pa.binary()) for x in parts]], names=["lang", "h", "a", "b", "c", "d"])

    rows = chosen.mapInArrow(run, "lang string, h bigint, a binary, b binary, c binary, d binary").collect()
    read = lambda ids, n: (np.frombuffer(ids, "<i4"), np.frombuffer(n, "<i8"))
    return [Example(r.lang, read(r.a, r.b), read(r.c, r.d)) for r in sorted(rows, key=lambda r: (r.h, r.lang, bytes(r.a)))]


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """Learn from the labelled rows that are not held out."""
    return fit(sample(docs.where(~held_out(F.col(key))), lang, text, key))


def predict(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, rejected) of every row."""
    frame = narrow(docs, key=key, text=text).withColumn("letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            letter = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            names, scores, refused = np.full(len(letter), UNKNOWN, object), np.zeros(len(letter)), np.ones(len(letter), bool)
            if model is not None and len(letter):
                data, offsets = byte_view(batch.column(1))
                parts = [model.predict(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i]) for i, j in portions(offsets, 1 << 20)]
                best, score = (np.concatenate(x) for x in zip(*parts, strict=True))
                names[letter], scores[letter] = np.array(model.langs, object)[best[letter]], score[letter]
                refused = ~letter | (scores < model.reject_below)
            yield pa.record_batch([batch.column(0), pa.array(names, pa.string()), pa.array(scores), pa.array(refused)],
                                  names=[key, "lang_pred", "score", "rejected"])

    return frame.mapInArrow(run, f"`{key}` {frame.schema['key'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows whose language the model does not reject, with all their columns."""
    where, width = docs.columns.index(text), len(docs.columns)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            keep = batch.column(width).to_numpy(zero_copy_only=False).astype(bool)
            if model is not None and len(keep):
                data, offsets = byte_view(batch.column(where))
                scores = [model.predict(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i])[1] for i, j in portions(offsets, 1 << 20)]
                keep = keep & (np.concatenate(scores) >= model.reject_below)
            yield batch.select(range(width)).filter(pa.array(keep & (model is not None)))

    own = numbered(docs)
    return named(own.withColumn("letter", F.coalesce(F.col(at(docs, text)).rlike(r"\p{L}"), F.lit(False))).mapInArrow(run, own.schema), docs)


@query("op10_language")
def op10_language(spark, sf):
    docs = table(spark, sf, "documents")
    found = predict(docs, learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
