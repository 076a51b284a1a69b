"""SimHash, embeddings, repeated strings and components against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from veta.llm import graph, repeats, rotated_codes, simhash


def union(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("pairs", [[], [(1, 1)], [(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 100)], [(i, 7 * i % 101) for i in range(101)], [(5, 4), (4, 5), (9, 8)]])
def test_components(spark, pairs):
    got = graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    nodes = {x for p in pairs for x in p if p[0] != p[1]}
    want = union([p for p in pairs if p[0] != p[1]], nodes)
    assert {r.id for r in got} == nodes and len(got) == len(nodes)
    assert {frozenset(r.id for r in got if r.root == x) for x in {r.root for r in got}} == {frozenset(n for n in nodes if want[n] == x) for x in set(want.values())}


def fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i: i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(4)
    base = [[rng.choice("abcdefgh") + str(rng.randint(0, 50)) for _ in range(rng.randint(1, 80))] for _ in range(12)]
    rows = [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "Ä x"), (None, "Ä X"), (1004, "one"), (1004, "one"), (1005, "two words")]
    for i in range(120):
        words = list(rng.choice(base))
        if rng.random() < 0.6:
            words[rng.randrange(len(words))] = "new"
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, key int, h int")
    prints = [fingerprint(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    root = union(pairs, range(len(rows)))
    least = {x: min(rows[i][0] for i in root if root[i] == x and rows[i][0] is not None) for x in set(root.values())}
    want = sorted((str(rows[i][0]), prints[i], least[root[i]]) for i in root)
    got = sorted((str(r.doc_id), r.fingerprint % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, least.values()))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_crowded_keys_are_compared_in_chunks(spark):
    rng = np.random.default_rng(1)
    start = rng.integers(0, 1 << 62, 4)
    values = {int(s) ^ int(sum(1 << int(b) for b in rng.choice(62, rng.integers(0, 5), replace=False))) for s in start for _ in range(150)}
    links = simhash.links(spark.createDataFrame([(v,) for v in values], "fingerprint long"), chunk=16).collect()
    assert all((a & b) is not None and len(links) < 60 * len(values) for a, b in links)
    near = [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3]
    assert union([(r.a, r.b) for r in links], values) == union(near, values)


def test_pigeonhole_masks_cover_all_close_pairs():
    masks = simhash.masks()
    rng = random.Random(0)
    for _ in range(300):
        flips = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(flips & (m % (1 << 64)) == 0 for m in masks)


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    x = np.repeat(centres, 25, axis=0) + rng.normal(size=(300, 16)) * rng.choice([0.01, 0.09, 0.2], 300)[:, None]
    rows = [(i, v.astype(np.float32).tolist(), i % 2 if i % 9 else None) for i, v in enumerate(x)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [float("inf")] + [1.0] * 15, 1), (904, [None] + [1.0] * 15, 1), (905, [], 1),
             (906, rows[1][1], 1), (907, rows[1][1], 0), (908, [2 * v for v in rows[1][1]], 1), (909, rows[1][1][:8], 1), (None, rows[1][1], 1), (910, [-0.0] * 15 + [1.0], 1), (911, [0.0] * 15 + [1.0], 1)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, key string")
    for chunk in (1024, 8):
        got = {r.vec_id: r for r in rotated_codes.near_duplicates(frame, chunk=chunk).collect()}
        v = {i: np.array([np.nan if a is None else a for a in (e or [])], float) for i, e, _ in rows}
        label = {i: k for i, _, k in rows}
        fit = [i for i in v if label[i] is not None and len(v[i]) and np.isfinite(v[i]).all() and np.abs(v[i]).max() > 0]
        pairs = [(a, b) for n, a in enumerate(fit) for b in fit[:n] if label[a] == label[b] and len(v[a]) == len(v[b]) and v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b]) >= 0.98]
        name = lambda i: 10**6 if i is None else i
        root = union([(name(a), name(b)) for a, b in pairs], [name(i) for i in v])
        assert len(got) == len(rows)
        found = sum(r.n_links for r in got.values())
        assert found >= 0.99 * 2 * len(pairs) and all(got[i].n_links <= sum(i in p for p in pairs) for i in v)
        same = [i for i in v if got[i].component_id == root[name(i)]]
        assert len(same) >= len(rows) - 3 and all(got[i].kept == (got[i].component_id == i) for i in v)
    assert rotated_codes.near_duplicates(frame.limit(0)).count() == 0


def test_estimates_stay_within_their_bounds():
    rng = np.random.default_rng(0)
    x, y = (rng.normal(size=(400, 64)) for _ in range(2))
    y[:200] = x[:200] + 0.2 * rng.normal(size=(200, 64))
    turn = rotated_codes.rotation(64, 0)
    a, b = ((z / np.linalg.norm(z, axis=1)[:, None]) @ turn for z in (x, y))
    value, bound = rotated_codes.estimates(a, b)
    wrong = value - a @ b.T
    assert (np.abs(wrong) <= bound[:, None]).mean() > 0.999 and abs(wrong.mean()) < 0.01


def brute(rows, length=50):
    first = {}
    for key, text in rows:
        data, order = (text or "").encode(), repeats.LAST if key is None else key
        for i in range(len(data) - length + 1):
            first[data[i: i + length]] = min(first.get(data[i: i + length], order), order)
    out = []
    for key, text in rows:
        data, order = (text or "").encode(), repeats.LAST if key is None else key
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            if first[data[i: i + length]] < order:
                gone[i: i + length] = True
        runs = int((np.diff(np.concatenate(([False], gone)).astype(int)) == 1).sum())
        out.append((key, len(data), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def made(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdé ") for _ in range(400)) for _ in range(6)]
    rows = [(1, None), (2, ""), (3, "short"), (4, "a" * 5000), (5, "b" + "a" * 300), (6, "ab" * 100), (7, "ñ" * 60), (70, "\0" * 80), (71, "\0" * 99)]
    for _ in range(80):
        parts = []
        for _ in range(rng.randint(1, 8)):
            at = rng.randrange(300)
            parts.append(rng.choice(base)[at: at + rng.randint(20, 200)] if rng.random() < 0.6 else "".join(rng.choice("xyz") for _ in range(rng.randint(0, 60))))
        rows.append((rng.choice([None, *range(8, 60)]), "".join(parts)))
    return rows + [rows[-1], (99, base[0]), (98, base[0])]


@pytest.mark.parametrize(("hot", "seed"), [(4096, 1), (3, 2), (4096, 3)])
def test_repeats_equal_brute_force(spark, monkeypatch, hot, seed):
    monkeypatch.setattr(repeats, "BLOCK", (2000, 4000))
    monkeypatch.setattr(repeats, "HOT", hot)
    rows = made(seed)
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, order int, block int")
    assert sorted([tuple(r) for r in repeats.spans(docs).collect()], key=str) == brute(rows)
    new = repeats.rewrite(docs)
    assert new.schema == docs.schema and new.count() == len(rows)
    assert repeats.spans(docs.limit(0)).count() == 0 and repeats.rewrite(docs.limit(0)).count() == 0


def test_cut_characters_go_whole(spark):
    docs = spark.createDataFrame([(1, "x" * 70), (2, "x" * 70 + "é"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in repeats.rewrite(docs).collect()} == {1: "x" * 70, 2: "é", 3: None}


def test_index_counts_what_counting_finds():
    rng = random.Random(5)
    base = "".join(rng.choice("abc") for _ in range(300)).encode()
    texts = sorted({base[a: a + rng.randint(50, 113)] for a in (rng.randrange(180) for _ in range(60))})
    least = np.array([rng.randrange(100) for _ in texts])
    index = repeats.RunIndex(texts, least)
    found = index.matches(texts)
    for t, row in zip(texts, found, strict=True):
        for w in range(len(t) - 49):
            want = min(m for s, m in zip(texts, least, strict=True) if t[w: w + 50] in s)
            assert index.least[row[w]] == want
            sample = index.samples[row[w]]
            assert (index.text[sample: sample + 50] - 1).astype(np.uint8).tobytes() == t[w: w + 50]
        assert (row[len(t) - 49:] == -1).all()
    assert len(index.keys) < index.length / 2
