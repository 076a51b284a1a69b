"""Filter audit, lexical search and phrase automata against brute force."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veta.llm import filter_audit, lexical_search, phrases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ------------------------------------------------------------------ filter audit
def test_lattice_counts_orders():
    edges = filter_audit.lattice(4)
    assert len(edges) == 32 and sum(e.orders for e in edges if e.state == 0) == 24
    for e in edges:
        taken = sum(1 for p in permutations(range(4)) if p[bin(e.state).count("1")] == e.filter and set(p[: bin(e.state).count("1")]) == {i for i in range(4) if e.state >> i & 1})
        assert e.orders == taken


def failing(rows):
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    out = []
    for i, text, _ in rows:
        t = text or ""
        w = WORD.findall(t)
        e = t in least and (i is None or least[t] < i)
        out.append((len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), e))
    return out


def test_audit_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["a", "bb", "ccc", "D", "é", "x#"][: rng.randint(2, 6)]) + (str(rng.randint(0, 400)) if rng.random() < 0.7 else "") for _ in range(rng.choice([0, 5, 199, 200, 260]))),
             rng.choice(["en", "fr", None])) for i in range(80)]
    rows += [(100, rows[3][1], "en"), (101, None, None), (102, "", ""), (None, rows[3][1], "fr"), (None, "only\x0bone here", "fr"), (103, "w " * 50_000, "en"), (3, rows[3][1], "en"),
             (3, rows[3][1], "en"), (104, rows[70][1], "de")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, digest int, fails string")
    marks = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 100, 2)] + [(4, 1, 0), (None, 1, 1)]
    labels = spark.createDataFrame([(*m, "z") for m in marks], "doc_id long, quality int, toxic int, part string")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(docs, labels).collect()}
    fails, good, toxic = failing(rows), Counter(m[0] for m in marks if m[1] == 1), Counter(m[0] for m in marks if m[2] == 1)
    parts = {lang or "" for _, _, lang in rows}
    assert len(got) == len(parts) * 600 and parts == {"en", "fr", "de", ""}
    removed_by = Counter()
    want = {}
    for part in parts:
        own = [(r[0], f) for r, f in zip(rows, fails, strict=True) if (r[2] or "") == part]
        for order in permutations(range(5)):
            alive = own
            for step, k in enumerate(order, 1):
                out, stay = [d for d in alive if d[1][k]], [d for d in alive if not d[1][k]]
                name = "".join("ABCDE"[j] for j in order)
                redundant = sum(1 for d in own if d[1][k]) - len(out)
                lost = [sum(1 for d in out if d[0] is not None and marked[d[0]]) for marked in (good, toxic)]
                want[part, name, step] = (len(stay), len(out), redundant, sum(1 for d in own if d[1][k] and sum(d[1]) == 1), *lost)
                removed_by[part, k] += len(out)
                alive = stay
    assert {k: v[:-1] for k, v in got.items()} == want
    assert all(v[-1] == removed_by[p, "ABCDE".index(order[step - 1])] for (p, order, step), v in got.items())
    for part in parts:  # Every order removes the same documents in the end.
        assert len({got[part, "".join(o), 5][0] for o in permutations("ABCDE")}) == 1


def test_audit_of_own_filters_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "ab", "x"), (2, "abc", "x"), (3, "b", "y")], "id long, body string, kind string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, labels.withColumnRenamed("doc_id", "id"), {"L": F.length("text") > 2, "S": F.col("text").contains("a")}, None, "kind", "id", "body").collect()
    by = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.shapley) for r in got}
    assert by[("x", "LS", 1)] == (1, 1, 0, 1) and by[("x", "LS", 2)] == (0, 1, 1, 3) and by[("y", "SL", 1)] == (1, 0, 0, 0) and len(by) == 8
    assert filter_audit.audit(docs.limit(0), labels.withColumnRenamed("doc_id", "id"), part="kind", key="id", text="body").count() == 0


# ------------------------------------------------------------------ lexical search
def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute_search(docs, items, top):
    found = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    found = [f for f in found if f[2]]
    n_docs, total = len(found), sum(f[2] for f in found)
    df = Counter(t for _, bag, _ in found for t in bag)
    out = []
    for item, text in items:
        rows = []
        for i, bag, n in found:
            m = 100 - 75 + (75 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 8 * m)) for t in terms(text) if bag[t])
            if s > 0:
                rows.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(rows)[:top], 1)]
    return out


def corpus(rng, n):
    vocabulary = [f"{a}{b}" for a in ("the", "Of", "é", "K9", "x") for b in ("", "ing", "Ü", "7")]
    rows = [(i, rng.choice([" ", "\x00", "-", "\t"]).join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 10, 40])))) for i in range(n)]
    return vocabulary, rows + [(i + n, rows[i % 7][1]) for i in range(60)] + [(900, None), (901, ""), (902, "#- \t"), (None, rows[2][1]), (5, rows[5][1]), (903, "theing " * 30_000)]


def test_search_equals_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    vocabulary, rows = corpus(rng, 150)
    items = [(i, " ".join(rng.choice(vocabulary + ["unseen"]) for _ in range(rng.randint(1, 25)))) for i in range(30)] + [(40, None), (41, "..."), (42, "unseen"), (None, "the THE theing")]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, bag string, n int, m int").repartition(5)
    asked = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    want = brute_search(rows, items, 10)
    got = lexical_search.search(docs, asked)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    # In blocks of items and small portions the result is the same.
    monkeypatch.setattr(lexical_search, "CELLS", 64)
    assert sorted(map(tuple, lexical_search.search(docs, asked, top=3, block=7).collect()), key=str) == sorted(brute_search(rows, items, 3), key=str)
    assert lexical_search.search(docs.limit(0), asked).count() == 0 and lexical_search.search(docs, asked.limit(0)).count() == 0


def test_scores_are_exact_in_both_ways():
    rng = np.random.default_rng(3)
    book = np.unique(np.column_stack([rng.integers(0, 50, 400), rng.integers(0, 20, 400), np.ones(400, int)]), axis=0)
    weights = rng.integers(0, 20_000, 50)
    bags = [np.array([np.sort(rng.choice(50, 12, False)), rng.integers(1, 99, 12)], "<u4").tobytes() for _ in range(30)]
    m = rng.integers(25, 900, 30)
    scorer = lexical_search.Scorer(book, weights, 20)
    want = np.zeros((30, 20), np.int64)
    for d, bag in enumerate(bags):
        tf = dict(zip(*lexical_search.unpack(bag).tolist(), strict=True))
        for t, i, k in book.tolist():
            if t in tf:
                want[d, i] += k * int(weights[t]) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * int(m[d])))
    assert (scorer.scores(bags, m) == want).all()
    scorer.most = 1 << 60
    assert (scorer.scores(bags, m) == want).all()


# ------------------------------------------------------------------ phrases
def brute_phrases(rows):
    first = {}
    big = float("inf")
    split = [(big if i is None else i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        for a in range(len(w) - 12):
            k = tuple(w[a: a + 13])
            first[k] = min(first.get(k, big), i)
    out = []
    for (i, w), (key, _) in zip(split, rows, strict=True):
        gone = {a + j for a in range(len(w) - 12) if first[tuple(w[a: a + 13])] < i for j in range(13)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((key, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def repeated():
    rng = random.Random(12)
    vocabulary = ["the", "of", "Ünder", "a"] + [f"w{i}" for i in range(60)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared = [say(n) for n in (12, 13, 14, 40, 200)]
    rows = []
    for i in range(120):
        w = say(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            a = rng.randint(0, max(0, len(p) - 13))
            at = rng.randint(0, len(w))
            w = w[:at] + p[a: a + rng.randint(12, 60)] + w[at:]
        rows.append((rng.randint(0, 400), rng.choice([" ", "\n", "\x0b \t"]).join(w)))
    rows += [rows[4], rows[4], (500, rows[4][1]), (None, rows[4][1]), (None, rows[5][1]), (501, None), (502, ""), (503, "same " * 30_000), (504, "same " * 14), (505, "same same " * 20)]
    return rows


def test_phrases_equal_brute_force(spark, repeated, monkeypatch):
    docs = spark.createDataFrame([(*r, 1, "x") for r in repeated], "doc_id long, text string, block int, key string").repartition(6)
    want = sorted(brute_phrases(repeated), key=str)
    assert sum(w[2] for w in want) > 1000
    assert sorted(map(tuple, phrases.words_removed(docs).collect()), key=str) == want
    # Many blocks, small automata.
    monkeypatch.setattr(phrases, "BLOCK", (2000, 2000))
    monkeypatch.setattr(phrases, "SHARD", 8)
    assert sorted(map(tuple, phrases.words_removed(docs).collect()), key=str) == want
    new = phrases.rewrite(docs)
    assert new.schema == docs.schema
    digests = Counter((i, n - r, d) for i, n, r, d in want)
    assert Counter((r.doc_id, len(WORD.findall(r.text or "")), hashlib.sha256(" ".join(WORD.findall(r.text or "")).encode()).hexdigest()) for r in new.collect()) == digests
    assert phrases.words_removed(docs.limit(0)).count() == 0


def test_automaton_finds_every_occurrence():
    rng = np.random.default_rng(5)
    text = rng.integers(0, 3, 500)
    table = np.unique(np.array([text[i: i + 5] for i in range(0, 400, 7)]), axis=0)
    letters = np.ones(10, np.int64)
    end, phrase = phrases.Automaton(table, letters).stream(letters[text])
    want = {(i + 4, p) for i in range(len(text) - 4) for p in range(len(table)) if (text[i: i + 5] == table[p]).all()}
    assert set(zip(end.tolist(), phrase.tolist(), strict=True)) == want


def test_result_comes_from_the_automata(repeated, monkeypatch):
    """Windows whose hashes clash by force are nominated together, and the automata still tell them apart."""
    monkeypatch.setattr(phrases.Words, "windows", lambda self, at: (self.ids[at].astype(np.uint64) << np.uint64(40), np.zeros(len(at), np.uint16)))
    texts = ["a b c d e f g h i j k l m", "a b c d e f g h i j k l n", "a b c d e f g h i j k l m"]
    docs = pa.table({"text": pa.array(texts), "order": pa.array([1, 2, 3]), "key": pa.array([1, 2, 3])})
    words = phrases.Words(docs)
    own = phrases.Nominated(words, facts_of(words), 4)
    assert len(own.at) == 3
    found = {int(s) for start, _ in phrases.locate(words, own, np.zeros(len(own.one), np.int64)) for s in start}
    assert found == {0, 26}


def facts_of(words):
    names = np.unique(phrases.short(words.anchors()[np.flatnonzero(words.whole)], 4))
    rows = [(int(n >> np.uint64(40)), phrases.five(np.array([n]))) for n in names]
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "anchors": pa.array([r[1] for r in rows], pa.binary())})
