"""Licenses, languages, main text, mixing and the pipeline."""

import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veta.llm import language, licenses, main_text, mixing, repeats

LICENSED = [
    (1, "MIT License mit license MIT-license. x mit licenses"), (2, None), (3, ""), (None, "cc by cc by\nReleased under the mit license"), (4, "ñ cc by"), (4, "ñ cc by"),
    (5, "  ,,, "), (6, "Gnu General Public License!\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"), (7, "ccby CC-BY cc\nby"),
    (8, "Permission is granted free of charge to any person obtaining a copy of this software and associated documentation"), (9, "apache LICENSE " * 3 + "é" * 5000), (10, "the copyright holder"),
]


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_license_scan_equals_brute_force(spark):
    docs = spark.createDataFrame([(*r, "x", "y") for r in LICENSED], "doc_id long, text string, h string, k string")
    want = []
    for key, text in LICENSED:
        w, base = words(text), []
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            base += [(i, label) for i in range(len(w)) if w[i: i + len(p)] == p]
        more, best = set(), 0.0
        for line in (text or "").split("\n"):
            for label, t in licenses.TEMPLATES:
                t = set(words(t))
                share = len(t & set(words(line))) / len(t)
                if share >= 0.8 - 1e-9:
                    more.add(label)
                    best = max(best, share)
        labels = {b[1] for b in base}
        want.append((key, len(w), len(base), min((b[0] for b in base), default=None), max((b[0] for b in base), default=None), ",".join(sorted(labels)),
                     ",".join(sorted(labels | more)), 1.0 if base else best))
    assert sorted(map(tuple, licenses.scan(docs).collect()), key=str) == sorted(want, key=str)
    assert any("gpl-text" in w[6] for w in want) and any("mit-text" in w[6] for w in want)
    assert licenses.scan(docs.limit(0)).count() == 0


SYLLABLES = {"aa": "the ing on er an re ha", "bb": "der sch ein und üb ß ge", "cc": "los ción que ñ do ar as"}


def made(n, seed, lang=None):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        name = lang or rng.choice(sorted(SYLLABLES))
        parts = SYLLABLES[name].split()
        out.append((i, " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(2, 60))), name))
    return out


def test_language_is_learned_and_held_out_rows_are_not_read(spark):
    rows = made(600, 1)
    odd = [(None, "the one her", None), (9001, None, "aa"), (9002, "", "aa"), (9003, "12 34 $$ 5", "bb"), (9004, "the", None), (9005, "the ingon " * 20_000, None), (9005, "the ingon " * 20_000, None)]
    docs = spark.createDataFrame([(*r, True) for r in rows + odd], "doc_id long, text string, lang string, letter boolean")
    model = language.learn(docs)
    assert model.langs == ["aa", "bb", "cc"] and 0 < model.reject_below <= 0.5
    wrong = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 5 == 0 else lang) for i, t, lang in rows]
    again = language.learn(spark.createDataFrame([(*r, True) for r in wrong + odd], docs.schema))
    assert (again.embedding == model.embedding).all() and again.langs == model.langs
    got = language.predict(docs, model).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    held = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(by[i].lang_pred == lang for i, lang in held) / len(held) > 0.97
    assert all((by[i].lang_pred, by[i].score, by[i].rejected) == ("und", 0.0, True) for i in (9001, 9002, 9003))
    assert by[9004].lang_pred == by[9005].lang_pred == by[None].lang_pred == "aa" and not by[9005].rejected
    kept = language.accepted(docs, model)
    assert kept.schema == docs.schema and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if not r.rejected)


def test_language_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert language.learn(docs) is None
    assert language.predict(docs, None).first().lang_pred == "und" and language.accepted(docs, None).count() == 0
    assert language.predict(docs.limit(0), language.learn(docs.limit(0))).count() == 0
    one = spark.createDataFrame([(i, f"only {i} words here", "en") for i in range(8)], docs.schema)
    assert {r.lang_pred for r in language.predict(one, language.learn(one)).collect()} == {"en"}


def test_scores_are_probabilities():
    model = language.train([(lang, t) for _, t, lang in made(400, 3)])
    rows = made(400, 4)
    best, score = model.predict(*language.packed([" ".join(t.split()[:2]) for _, t, _ in rows]))
    right = np.array([model.langs[b] == lang for b, (_, _, lang) in zip(best, rows, strict=True)])
    assert ((score >= 1 / 3) & (score <= 1)).all() and abs(score.mean() - right.mean()) < 0.1


PAGES = {
    "<html><head><title>t</title><style>p{}</style></head><body><nav><a href=a>Menu</a></nav><!-- ad --><div class=\"ad\">Buy now this and that</div><article><h1>Head</h1>"
    "<p><b>First &amp; long<br><p>Of.</p><p>More text&nbsp;here &lt;i&gt;</p></article><footer>&copy; all</footer>": "Head\n\nFirst & long\n\nOf.\n\nMore text here <i>",
    "<header class='site-header'><a href=/>Logo</a><p>The best site of all</p></header><div class='cookie-banner'>We use cookies.</div><article><header><h1>Title</h1></header><p>" + "cc " * 20
    + "</p><ul><li>first</li><li>second</li></ul><aside>Read also this</aside><form><p>Your mail</p></form><p>Fin.</p><section class=comments><p>nice one</p></section></article>"
    "<aside class=sidebar><p>" + "dd " * 40 + "</p></aside>": "Title\n\n" + " ".join(["cc"] * 20) + "\n\nfirst\n\nsecond\n\nFin.",
    "<div class=\"top-menu\"><a href=1>Home</a></div><div class=entry><h1>Title of it</h1><p>Short.</p><p>A paragraph that goes on and on.</p></div><div id=sidebar-left>Archive of months</div>":
        "Title of it\n\nShort.\n\nA paragraph that goes on and on.",
    "plain words without any tag": "plain words without any tag", "": "", "<script>var a='<p>no</p>'</script>": "", "<article><p>1 < 2 & 3</p></article>": "1 < 2 & 3",
}


def test_main_text(spark):
    rows = [(i, f"u{i}", p) for i, p in enumerate(PAGES)] + [(90, None, None), (None, "u", "<main><p>x y</p></main>"), (91, "u", "<article>" + "<p>a b</p>" * 20_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in main_text.extract(pages).collect()}
    for (i, url, _), want in zip(rows, PAGES.values(), strict=False):
        assert (got[i].text, got[i].n_chars, got[i].url) == (want, len(want), url)
    assert got[90].text == "" and got[None].text == "x y" and got[91].n_chars == 20_000 * 5 - 2
    assert main_text.extract(pages.limit(0)).count() == 0


def test_tree_learns_its_table():
    x, y = main_text.labelled()
    assert x.shape[1] == len(main_text.FEATURES) and ((main_text.share(main_text.grow(x, y), x) > 0.5) == y).mean() > 0.98


def test_targets():
    assert mixing.targets([100, 100, 100]) == [200.0, 500 / 3, 250 / 3]
    assert mixing.targets([0, 0]) == [0.0, 0.0] and mixing.targets([]) == [] and mixing.targets([10]) == [15.0]
    rng = random.Random(1)
    for _ in range(50):
        sizes = [rng.randint(0, 1000) for _ in range(rng.randint(1, 9))]
        found = mixing.targets(sizes)
        assert math.isclose(sum(found), 1.5 * sum(sizes)) and all(t <= 2 * s + 1e-9 for t, s in zip(found, sizes, strict=True))
        free = [t / (5, 2, 1)[i % 3] for i, (t, s) in enumerate(zip(found, sizes, strict=True)) if t < 2 * s - 1e-6]
        assert not free or max(free) - min(free) < 1e-6


def test_tree_deals_exact_quotas():
    quotas = np.array([1000, 0, 37, 5])
    got = mixing.split(quotas, 0, 13, 1)
    assert (got.sum(axis=0) == quotas).all() and got.min() >= 0 and np.ptp(got.sum(axis=1)) <= 2 and (mixing.split(quotas, 0, 13, 1) == got).all()


def test_mix_meets_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 200)
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a", "b", "é", "", None])) for i in range(300)]
    rows += [(400, None, "a"), (401, "\t\n", "b"), (None, "x y z", None), (402, "r s", "a"), (402, "r s", "a"), (403, "q " * 5000, "b")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, name string")
    mixed = mixing.mix(docs)
    got = mixed.collect()
    assert sorted(got, key=str) == sorted(mixing.mix(docs).collect(), key=str) and len(got) == len(rows)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    source = {i: s for i, _, s in rows}
    sizes = {s: sum(count(t) for _, t, x in rows if x == s) for s in source.values()}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    wanted = dict(zip(order, mixing.targets([sizes[s] for s in order]), strict=True))
    for s in order:
        own = [r for r in got if source[r.doc_id] == s]
        assert sum(r.taken for r in own) == round(wanted[s]) and all(r.target == wanted[s] and r.source_size == sizes[s] for r in own)
    assert all(0 <= r.taken <= 2 * r.size for r in got) and sum(r.size for r in got) == sum(sizes.values())
    takings = mixing.takings(mixed).collect()
    assert sum(r.words for r in takings) == sum(r.taken for r in got) and len({r.shard for r in takings}) > 3
    assert mixing.mix(docs.limit(0)).count() == 0
    whole = mixing.mixture(docs, weights=(1,), total=Fraction(1), most=2)
    assert whole.columns == docs.columns and set(map(tuple, whole.collect())) <= {(*r, "x") for r in rows}


def test_shards_get_the_blocks_that_the_tree_gave_them(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 400)
    rows = [(i, f"t{i} " + "w " * (i % 40), "abc"[i % 3]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed, shards = mixing.mix(docs, shards=8, cut=False), {}
    for r in mixing.mixture(docs, shards=8, shard="no").collect():
        shards.setdefault(r.no, []).append(r.doc_id)
    told = {}
    for r in mixing.takings(mixed).where("words > 0").orderBy("place").collect():
        told.setdefault(r.shard, []).append(r.doc_id)
    assert {k: sorted(v) for k, v in shards.items()} == {k: sorted(v) for k, v in told.items()} and sorted(shards) == list(range(8))
    asked = []
    tree = mixing.split
    monkeypatch.setattr(mixing, "split", lambda quotas, first, last, seed: asked.append((first, last, tree(quotas, first, last, seed))) or asked[-1][2])
    placed = mixing.mix(docs, shards=8, cut=False)
    quotas = next(q for first, last, q in asked if (first, last) == (0, 8))
    sizes = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in "abc"}
    seen = {}
    for r in placed.select("doc_id", "h", F.posexplode("shards").alias("no", "shard")).collect():
        source = "abc"[r.doc_id % 3]
        blocks = max(1, -(-sizes[source] // 400))
        seen.setdefault((r.shard, source), set()).add((r.no, int(((r.h % (1 << 64)) >> 33) * blocks / float(1 << 31))))
    assert {k: len(v) for k, v in seen.items()} == {(i, s): quotas[i, n] for i in range(8) for n, s in enumerate("abc") if quotas[i, n]}
    assert np.ptp(quotas.sum(axis=1)) <= 1


def test_training_bags_hold_whole_texts(spark):
    late = "qqq " * 5000 + "the ingon her " * 3000
    docs = spark.createDataFrame([(i, late if i % 2 else "ßge und sch ein " * 9, "aa" if i % 2 else "bb") for i in range(40)], "doc_id long, text string, lang string")
    rows = language.sample(docs, "lang", "text", "doc_id")
    ids, counts = language.bag(late)
    assert len(rows) == 40 and all((r.whole[0] == ids).all() and (r.whole[1] == counts).all() for r in rows if r.lang == "aa")
    end = language.bag("the ingon her")[0]
    assert np.isin(end, ids).sum() >= len(end) - 3


def test_scores_equal_a_plain_version():
    """One text at a time, with dictionaries in place of arrays."""
    model = language.train([(lang, t) for _, t, lang in made(200, 5)])
    for text in [t for _, t, _ in made(20, 6)] + ["ÄB c--d", "x", "é", "Ωmega und  so"]:
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
        line = b" " + b" ".join(bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in raw).split()) + b" "
        counts = {}
        for n in (2, 3, 4):
            for i in range(len(line) - n + 1):
                value = int.from_bytes(line[i: i + n]) * language.HASHES[n] % (1 << 32) >> 18
                counts[value] = counts.get(value, 0) + 1
        total = sum(counts.values())
        hidden = [sum(c * model.embedding[b][d] for b, c in counts.items()) / total for d in range(language.DIM)]
        z = [sum(x * w for x, w in zip(hidden, model.weights[:, k], strict=True)) + model.bias[k] for k in range(len(model.langs))]
        e = [np.exp((x - max(z)) / model.temperature) for x in z]
        best, score = model.predict(*language.packed([text]))
        assert best[0] == int(np.argmax(e)) and abs(score[0] - max(e) / sum(e)) < 1e-4


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(6)
    rows = [(i, t, lang, rng.choice(["s0", "s1", None]), len(t)) for i, t, lang in made(150, 7)]
    passage = " ".join(f"thering{i}" for i in range(60))
    rows += [(200, rows[3][1], "aa", "s0", 1), (201, "alone the " + passage, "aa", "s1", 2), (202, passage + " " + " ".join(f"onherre{i}" for i in range(20)), "aa", "s1", 2)]
    rows += [(300, None, None, None, None), (301, "", "aa", "s0", 0), (302, "1 2 3", "bb", "s0", 5), (None, "the re an her ing er reha", "aa", "s0", 9), rows[5], rows[5]]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, key int, block string")


def near_groups(rows):
    """Smallest id (null last) of each component of texts whose sets of five-word shingles are 0.8 alike, by brute force."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if not a | sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least.setdefault(find(i), []).append((key is None, key))
    return {min(keys, key=lambda k: (k[0], k[1] or 0))[1] for keys in least.values()}


def test_stages_do_what_they_say(spark, corpus, tmp_path):
    docs, seen = corpus, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = before, docs
        if name != "bpe":
            assert docs.columns == corpus.columns
    before, after = seen["language"]
    assert {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()} == {300, 301, 302}
    before, after = seen["near_copies"]
    rows = {tuple(r) for r in before.collect()}
    got = after.collect()
    assert {r.doc_id for r in got} == near_groups([(r[0], r[1]) for r in rows]) and len(got) == len({r.doc_id for r in got}) and set(map(tuple, got)) <= rows
    assert {201, 202} <= {r.doc_id for r in got} and 200 not in {r.doc_id for r in got}
    before, after = seen["repeats"]
    want = {r.doc_id: r.n_removed for r in repeats.spans(before).collect()}
    was = {r.doc_id: r.text for r in before.collect()}
    assert all(len(was[r.doc_id].encode()) - len(r.text.encode()) >= want[r.doc_id] and r.n_chars == len(r.text) for r in after.collect())
    assert want[202] > 500 and want[201] == 0
    before, after = seen["mixing"]
    rows = {tuple(r) for r in before.collect()}
    assert all(tuple(r) in rows for r in after.collect())
    before, after = seen["bpe"]
    assert before.count() == after.count()
    empty = corpus.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, empty, "").write.parquet(f"{tmp_path}/none-{name}")
        empty = spark.read.parquet(f"{tmp_path}/none-{name}")
        assert empty.count() == 0


def test_run_writes_and_rereads(spark, corpus, tmp_path):
    corpus.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0
