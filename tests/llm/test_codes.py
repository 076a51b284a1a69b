"""Byte-pair encoding, multiset hash and archive."""

import hashlib
import random
import tracemalloc
from datetime import UTC, datetime

import numpy as np
import pytest
import tiktoken

from veta.llm import bpe, multiset, warc

WORDS = ["the", "ing", " ", "\n", "é", "ß", "日本", "́", "🎉", "12", "'s", "--", "  ", "\t", "ñandú", "Z" * 40, "<|endoftext|>"]


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(WORDS) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def vocabulary():
    ranks, pattern = bpe.multilingual()
    return ranks, pattern, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_those_of_the_library(spark, vocabulary):
    ranks, pattern, known = vocabulary
    rows = [(i, t, "x") for i, t in enumerate(texts(200))] + [(900, None, "x"), (None, "the the", "x"), (901, "", "x"), (902, "a" * 20_000, "x"), (902, "a" * 20_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in bpe.encode(docs, ranks, pattern).collect()}
    assert all(got[i] == known.encode_ordinary(t or "") for i, t, _ in rows)
    back = {r.doc_id: bytes(r.data) for r in bpe.decode(bpe.encode(docs, ranks, pattern), ranks, pattern).collect()}
    assert all(back[i] == (t or "").encode() for i, t, _ in rows)
    found = bpe.round_trip(docs, ranks, pattern).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    for i, t, _ in rows:
        ids = known.encode_ordinary(t or "")
        assert by[i].n_tokens == len(ids) and by[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
        assert by[i].ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
    assert bpe.round_trip(docs.limit(0), ranks, pattern).count() == 0


def test_appending_and_replacing_equal_encoding_anew(vocabulary):
    ranks, _, _ = vocabulary
    pairs, rng = bpe.Pairs(ranks), random.Random(2)
    for _ in range(60):
        data = bytes(rng.choice(b"theingand  anou") for _ in range(rng.randint(100, 400)))
        p = bpe.Prefixes(ranks, pairs).append(data[:50]).append(data[50:])
        a = rng.randint(0, len(data))
        b, by = rng.randint(a, min(len(data), a + 9)), b"xyingthe"[: rng.randint(0, 8)]
        done = p.replace(a, b, by)
        q = bpe.Prefixes(ranks, pairs).append(data[:a] + by + data[b:])
        assert (p.last, p.data, p.ids()) == (q.last, q.data, q.ids()) and done <= len(p.data) - a
        assert p.ids() == bpe.merge(ranks, p.data)


def test_memo_starts_over_when_full(vocabulary):
    ranks, pattern, known = vocabulary
    own = bpe.Codec(ranks, pattern, 1200)
    for t in texts(30, 5):
        assert own.decode(own.encode(t)) == t.encode() and len(own.pieces) <= 3


def test_states_add_subtract_and_ignore_order():
    a, b, c = (multiset.state([t]) for t in ("one two three\nfour five\nsix", "six\none two three\nfour five", "four five"))
    assert a.fingerprints() == b.fingerprints()
    less = multiset.state(["one two three\nsix"])
    assert (a - c).fingerprints() == less.fingerprints() and (less + c).fingerprints() == a.fingerprints()
    assert a.fingerprints() != less.fingerprints() and a.likeness(b)[0] == 1
    assert multiset.state(["x", "x\nx"]).fingerprints()[0] != multiset.state(["x", "x\nx"]).fingerprints()[1]


@pytest.mark.parametrize("rows", [
    [(None, "nul one"), (None, None), (3, "aa bb\ncc dd"), (3, "aa bb\ncc dd"), (3, ""), (1, "ñ cc by")], [(5, "alone\nhere it is")], [],
    [(i, t) for i, t in enumerate(texts(150, 3))],
])
def test_edits_follow_the_order_of_ids(spark, rows):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, h string")
    got = multiset.edits(docs).collect()
    assert len(got) == len(rows)
    if len({i for i, _ in rows}) == len(rows):
        order = sorted(rows, reverse=True)
        for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
            r = next(r for r in got if r.doc_id == i)
            new = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
            s = multiset.state([t, new, after])
            assert r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest() and r.n_chars == len(t)
            assert [r.fingerprint, r.edited_fingerprint] == s.fingerprints()[:2]
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    alone = {bytes(r.state) for r in multiset.fingerprints(docs).collect()}
    assert len(alone) <= max(1, len({t or "" for _, t in rows}))


def test_likeness_follows_the_share_kept(spark):
    words = [f"w{i}" for i in range(3000)]
    long, other = " ".join(words), " ".join(reversed(words))
    got = multiset.edits(spark.createDataFrame([(2, long), (1, other)], "doc_id long, text string")).where("doc_id = 2").first()
    assert 0.55 < got.near_edited < 0.75 and got.near_next < 0.15


def test_archive_keeps_payloads_once_and_gives_records_back(spark):
    rows = [(3, "u3", "same"), (1, "u1", "same"), (2, "u2", None), (5, "u5", ""), (4, "u\r\n4", "ñ"), (None, None, "same"), (7, "u7", "seven"), (7, "u7", "seven")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, key string")
    path = warc.new_folder(spark)
    warc.write(pages, path)
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    got = warc.read(spark, path).collect()
    kinds = sorted((str(r.key), r.record_type, r.refers_to) for r in got)
    assert kinds == sorted([("3", "revisit", 1), ("1", "response", None), ("2", "response", None), ("5", "revisit", 2), ("4", "response", None), ("None", "revisit", 1),
                            ("7", "response", None), ("7", "response", None)])
    import base64
    for r in got:
        body = next(h or "" for i, _, h in rows if i == r.key).encode()
        assert r.payload_bytes == len(body) and r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
    whole = {(r.key, bytes(r.payload)) for r in warc.records(spark, path).collect()}
    assert whole == {(i, (h or "").encode()) for i, _, h in rows}
    assert all(r.header.startswith("WARC/1.1\r\nWARC-Type: ") and r.header.endswith("\r\n\r\n") for r in warc.records(spark, path).collect())


def test_archive_of_small_payloads_has_no_revisits(spark):
    path = warc.new_folder(spark)
    warc.write(spark.createDataFrame([(1, "a", "xx"), (2, "b", "xx"), (3, "c", "y" * 9), (4, "d", "y" * 9)], "page_id long, url string, html string"), path, least=5)
    assert {r.key: r.refers_to for r in warc.read(spark, path).collect()} == {1: None, 2: None, 3: None, 4: 3}


def test_empty_archive_and_damage(spark):
    path = warc.new_folder(spark)
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read(spark, path).count() == 0
    other = warc.new_folder(spark)
    warc.write(spark.createDataFrame([(1, "a", "xx")], "page_id long, url string, html string"), other)
    spark.read.parquet(f"{other}/payloads").selectExpr("sha256", "n", "sha1", "encode('zz', 'utf-8') AS payload").write.parquet(f"{path}/bad/payloads")
    spark.read.parquet(f"{other}/headers").write.parquet(f"{path}/bad/headers")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read(spark, f"{path}/bad").collect()


def test_memo_of_pieces_is_bounded_by_bytes():
    import sys

    ranks = {bytes([i]): i for i in range(256)}
    own = bpe.Pieces(ranks)
    long = "ab" * 500_000
    assert len(own[long]) == 4 * len(long) and long not in own and not own.old
    for i in range(400_000):
        own[f"piece {i}"]
    used = sum(sys.getsizeof(k) + sys.getsizeof(v) for d in (own, own.old) for k, v in d.items()) + sys.getsizeof(own) + sys.getsizeof(own.old)
    assert used < 1.5 * bpe.MEMORY and len(own) + len(own.old) > 20_000
    assert own["piece 7"] == np.array(list(b"piece 7"), "<u4").tobytes()


def test_multiset_of_many_lines_stays_small():
    tracemalloc.start()
    got = multiset.state(["\n" * 300_000, "a b c d\n" * 40_000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20
    one, two = multiset.state([""]).lanes.astype(np.int64), multiset.state(["a b c d"]).lanes.astype(np.int64)
    assert (got.lanes == np.concatenate((one * 300_001, two * 40_000 + one)) % (1 << 16)).all()


def test_multiset_batches_of_lines_add_up(monkeypatch):
    texts = ["", "a\nb\na", "b", "\n\n", "\n".join(str(i % 7) for i in range(50)), "x"]
    whole = multiset.state(texts).fingerprints()
    monkeypatch.setattr(multiset, "LINES", 3)
    assert multiset.state(texts).fingerprints() == whole


def test_urls_cannot_forge_header_fields(spark):
    bad = ["x WARC-Refers-To: <urn:page:5>", "a\r\nWARC-Refers-To: <urn:page:6>", "b\u2028WARC-Type: revisit", "c\u0085WARC-Refers-To: <urn:page:7>", "d\t🎉é", None, ""]
    path = warc.new_folder(spark)
    warc.write(spark.createDataFrame([(i, u, f"page {i}") for i, u in enumerate(bad)], "page_id long, url string, html string"), path, date=datetime(2024, 5, 6, 7, 8, 9, tzinfo=UTC))
    got = {r.key: r for r in warc.read(spark, path).collect()}
    assert all(r.refers_to is None and r.record_type == "response" for r in got.values())
    assert got[0].url == "x%20WARC-Refers-To:%20<urn:page:5>" and got[1].url == "a%0D%0AWARC-Refers-To:%20<urn:page:6>"
    assert got[2].url == "b%E2%80%A8WARC-Type:%20revisit" and got[4].url == "d%09🎉é" and got[5].url is None
    assert all("\r\nWARC-Date: 2024-05-06T07:08:09Z\r\n" in r.header for r in warc.records(spark, path).collect())
