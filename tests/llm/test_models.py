"""Language ID, toxicity, decontamination, and the pipeline: held-out accuracy, brute force, odd rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import crf, langid, leaks

SF = "/root/testdata/sf0.001"


# Language:
@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def model(documents):
    return langid.fit(documents.where(~langid.held_out("doc_id", 4, 2)))


def test_held_out_accuracy(documents, model):
    got = langid.identify(documents.where(langid.held_out("doc_id", 4, 2)), model).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.9 * len(got)


def test_texts_without_letters(spark, model):
    d = spark.createDataFrame([(None, "a"), ("", "b"), ("12 %$ 34", "c"), ("😀", "d"), ("the and of", "e")], "text string, lang_pred string")
    got = langid.identify(d, model).collect()
    assert [r.lang_pred == "und" for r in got] == [True] * 4 + [False] and [r.lang_score for r in got][:4] == [0.0] * 4
    assert all(0 <= r.lang_score <= 1 for r in got)
    assert langid.identify(d.limit(0), model).count() == 0


def test_nothing_to_learn_from(spark):
    d = spark.createDataFrame([(1, "text", None), (2, None, "en")], "doc_id long, text string, lang string")
    m = langid.fit(d)
    assert m.labels == [] and {r.lang_pred for r in langid.identify(d, m).collect()} == {"und"}


def test_grams_stay_in_their_text():
    texts = ["ab", "", "abc"]
    cps = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    whole = langid.grams(cps, np.array([0, 2, 2, 5]))
    for k, n in enumerate(langid.ORDERS):
        alone = [b for t in texts for b in (langid.grams(np.frombuffer(t.encode("utf-32-le"), np.uint32), np.array([0, len(t)]))[k].tolist() if t else [])]
        assert whole[k].tolist() == alone


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 300)
    logits = rng.standard_normal((300, 3))
    logits[np.arange(300), y] += 0.5
    loss = lambda t: -np.log(langid.softmax(logits * 20 / t)[np.arange(300), y]).mean()
    assert loss(langid.calibrate(logits * 20, y)) < loss(1.0)


# Toxicity:
def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    u, trans, start = rng.standard_normal((5, 1)), rng.standard_normal((2, 2)), 0.3
    total, on = 0.0, np.zeros(5)
    for path in range(32):
        y = [path >> i & 1 for i in range(5)]
        w = np.exp(sum(u[i, 0] * y[i] for i in range(5)) + start * y[0] + sum(trans[a, b] for a, b in zip(y, y[1:])))
        total += w
        on += w * np.array(y)
    a, b = crf.forward_backward(u, np.array([5]), trans, start)
    assert np.allclose(crf.sigmoid(a + b)[:, 0], on / total)


def toxic_rows(n: int, seed: int):
    rng = random.Random(seed)
    clean = ["".join(rng.choice("aeioulnrst") for _ in range(5)) for _ in range(200)]
    rows = []
    for i in range(n):
        w = [rng.choice(clean) for _ in range(rng.randint(5, 60))]
        if i % 4 == 0:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["zkfool", "zkfoolish", "zkidiot"])
        rows.append((i + seed * 10_000, " ".join(w), int(i % 4 == 0)))
    return rows


def test_toxic_words_are_learned_and_located(spark):
    train = spark.createDataFrame(toxic_rows(400, 1), "doc_id long, text string, toxic int")
    m = crf.fit(train.drop("toxic"), train.select("doc_id", "toxic"))
    test = spark.createDataFrame(toxic_rows(200, 2), "doc_id long, text string, toxic int")
    got = crf.tag(test.withColumn("score", F.lit("clash")), m, spans=True).collect()
    assert sum(r.predicted == r.toxic for r in got) >= 190
    hit = [r.text.encode()[s.start : s.end] for r in got for s in r.spans]
    assert hit and sum(h.startswith(b"zk") for h in hit) >= 0.9 * len(hit)


def test_odd_texts_score(spark):
    m = crf.fit(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int"))
    d = spark.createDataFrame([(1, None), (2, ""), (3, " "), (4, "w " * 70_000)], "doc_id long, text string")
    got = crf.tag(d, m).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 and r.predicted == 0 for r in got)


# Decontamination:
def edit(a, b):
    c = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        d = [i]
        for j, y in enumerate(b, 1):
            d.append(min(c[j - 1] + (x != y), c[j] + 1, d[-1] + 1))
        c = d
    return min(c)


def test_alignment_against_the_whole_table():
    rng = random.Random(0)
    code = lambda s: np.array([ord(c) for c in s], np.uint32)
    for _ in range(200):
        a, b = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12))), "".join(rng.choice("abc") for _ in range(rng.randint(0, 20)))
        whole = leaks.distance(code(a), code(b), 0, len(b), -len(a), len(a) + len(b) + 1, 50) if b else (len(a), 0, 0)
        assert whole[0] == edit(a, b) and edit(a, b[whole[1] : whole[2]]) == whole[0]


def test_leaks_equal_a_comparison_of_every_document_with_every_item(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(2, 6)))
    items = [" ".join(word() for _ in range(n)) for n in (4, 4, 5, 5, 6, 8, 12, 20, 30)]
    items = [t[:n] if n else t for t, n in zip(items, (20, 21, 22, 23, 25, 0, 0, 0, 0))]
    items = [t.strip() for t in items]
    texts = []
    for k in range(120):
        t = list(rng.choice(items)) if k % 2 else []
        for _ in range(rng.randint(0, 2 + len(t) // 25)):
            if t:
                p, o = rng.randrange(len(t)), rng.randrange(3)
                t[p : p + (o != 2)] = [] if o == 1 else rng.choice("xyz")
        texts.append(" ".join([word() for _ in range(rng.randint(0, 9))] + ["".join(t)] + [word() for _ in range(rng.randint(0, 9))]))
    plain = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
    want = {(i, j) for i, t in enumerate(texts) for j, x in enumerate(items) if edit(plain(x), plain(t)) <= int(leaks.ERROR * len(plain(x)))}
    got = leaks.leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and want


def test_planted_items_are_found_and_nothing_else(spark):
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    items = [" ".join(word() for _ in range(rng.randint(14, 40))) for _ in range(30)]
    docs, want = [], set()
    for i in range(90):
        filler = lambda: " ".join(word() for _ in range(rng.randint(0, 60)))
        if i % 3 == 2:
            docs.append((i, filler()))
            continue
        t = list(items[i // 3])
        if i % 3:
            for _ in range(int(0.04 * len(t))):
                p, o = rng.randrange(len(t)), rng.randrange(3)
                t[p : p + (o != 2)] = [] if o == 1 else rng.choice("xyz")
        docs.append((i, f"{filler()} {''.join(t).upper()}, {filler()}"))
        want.add((i, i // 3))
    docs += [(1000, None), (1001, ""), (1002, items[0] + "  " + items[0])]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([*enumerate(items), (99, None), (98, ""), (97, "tiny")], "item_id long, text string")
    got = leaks.leaks(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.doc_id < 1000} == want
    assert sorted(r.start for r in got if r.doc_id == 1002) == [0, len(items[0]) + 2]
    assert all(dict(docs)[r.doc_id][r.start : r.end].strip() for r in got)
    kept = {r.doc_id for r in leaks.clean(d, b).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in want} - {1002}
    assert leaks.leaks(d, b.limit(0)).count() == 0 and leaks.leaks(d.limit(0), b).count() == 0


def test_items_under_a_gram_match_whole(spark, caplog):
    items = [(1, "什么是光合作用?"), (2, "Who am I"), (3, "Who am I"), (4, "?!"), (None, "x-7")]
    texts = [(1, "问：什么是光合作用？答"), (2, "什么是光合作用呢"), (3, "Say: WHO am  I? who am I"), (4, "who am in"), (5, "so who am"), (6, "i x 7"), (7, "x 7b"), (None, "x7"), (8, None)]
    b, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(texts, "doc_id long, text string")
    got = {tuple(r) for r in leaks.leaks(d, b).collect()}
    assert got == {(1, 1, 2, 9, 0), *((3, i, s, e, 0) for i in (2, 3) for s, e in ((5, 14), (16, 24))), (6, None, 2, 5, 0)}
    assert "1 benchmark items" in caplog.text
    assert {r.doc_id for r in leaks.clean(d, b).collect()} == {2, 4, 5, 7, 8, None}


def test_several_passes_find_the_same(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    b = spark.read.parquet(f"{SF}/benchmark.parquet")
    once = sorted(map(tuple, leaks.leaks(docs, b).collect()))
    monkeypatch.setattr(leaks, "PASS_CHARS", 3000)
    assert once and sorted(map(tuple, leaks.leaks(docs, b).collect())) == once


# Pipeline:
def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, f in p.STAGES[:-1]:
        out = p.stage(f(spark, docs, SF), "test")
        assert out.columns == columns, name
        assert 0.5 * docs.count() <= out.count() <= docs.count()
        docs = out
    texts = [r.text for r in docs.collect()]
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        assert not any(r.text in t for t in texts)
    assert p.STAGES[-1][1](spark, docs, SF).count() == docs.count()
