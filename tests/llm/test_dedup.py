"""The dedup operators against brute force, with nulls, empty and repeated rows, ties, clashing columns, hot groups."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import components, debruijn, esa, shared, sigtree, windows

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def corpus() -> list[tuple]:
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    base = [word() for _ in range(400)]
    rows = [(1, None), (2, ""), (3, "a b"), (4, "A  B"), (5, " \t "), (6, "x " * 60), (7, "é" * 150), (None, " ".join(base[:60])), (8, "abc " * 80)]
    for i in range(60):
        s = rng.randint(0, 300)
        mine = base[s : s + rng.randint(5, 90)]
        for _ in range(rng.randint(0, 4)):
            mine[rng.randrange(len(mine))] = word()
        rows.append((100 + i, " ".join([word() for _ in range(rng.randint(0, 10))] + mine)))
    rows += [(300 + i, " ".join(base[:80])) for i in range(40)]  # a group of copies
    rows += [(400, " ".join(base[:80])), (400, " ".join(base[:80])), (401, "only here " + " ".join(word() for _ in range(40)))]
    rng.shuffle(rows)
    return rows


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 7, "k", i) for i, t in ROWS], "doc_id long, text string, k int, x string, pos long").cache()


def test_kept_words(docs, monkeypatch):
    order = lambda i: 1 << 70 if i is None else i
    texts = [(i, SPACE.findall((t or "").encode())) for i, t in ROWS]
    first: dict = {}
    for i, w in texts:
        for s in range(len(w) - 12):
            g = tuple(w[s : s + 13])
            first[g] = min(first.get(g, 1 << 70), order(i))
    want = Counter()
    for i, w in texts:
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - 12):
            if first[tuple(w[s : s + 13])] < order(i):
                gone[s : s + 13] = True
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        want[i, len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()] += 1
    for frequent in (64, 2):
        monkeypatch.setattr(windows, "FREQUENT", frequent)
        assert Counter(map(tuple, debruijn.drop_repeats(docs).collect())) == want
    assert debruijn.drop_repeats(docs.limit(0)).count() == 0


def test_kept_bytes(docs, monkeypatch):
    texts = [(i, (t or "").encode()) for i, t in ROWS]
    count = Counter(w[s : s + 200] for _, w in texts for s in range(len(w) - 199))
    want = Counter()
    for i, w in texts:
        gone = np.zeros(len(w) + 1, bool)
        for s in range(len(w) - 199):
            if count[w[s : s + 200]] > 1:
                gone[s : s + 200] = True
        kept = bytes(np.frombuffer(w, np.uint8)[~gone[:-1]])
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        want[i, len(w), len(w) - len(kept), spans, hashlib.sha256(kept).hexdigest()] += 1
    for frequent, bucket in ((64, 2000), (2, 2)):
        monkeypatch.setattr(windows, "FREQUENT", frequent)
        monkeypatch.setattr(esa, "BUCKET", bucket)
        assert Counter(map(tuple, esa.drop_repeats(docs).collect())) == want
    assert esa.drop_repeats(docs.limit(0)).count() == 0


def test_rows_of_one_id_whose_32_bit_hashes_clash(spark):
    sha = lambda x: hashlib.sha512(x.encode()).hexdigest()
    a, b = (f"{i:08d}" + sha(str(i)) + sha(f"{i}x") for i in (148429, 177979))
    wordy = lambda t: " ".join(t[i : i + 4] for i in range(0, len(t), 4))
    d = spark.createDataFrame([(1, a), (1, b), (2, a)], "doc_id long, text string")
    assert d.selectExpr("hash(text) AS h").distinct().count() == 1
    assert sorted((r.doc_id, r.n_removed) for r in esa.drop_repeats(d).collect()) == [(1, 0), (1, 264), (2, 264)]
    d = spark.createDataFrame([(0, wordy(a)), (1, wordy(a)), (1, wordy(b))], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in debruijn.drop_repeats(d).collect()) == [(0, 0), (1, 0), (1, 66)]


def test_cut_texts_keep_rows_and_columns(docs):
    out = esa.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[1] is None and got[2] == "" and got[300] == "" and got[401].startswith("only here")


def test_maximal_repeats_list_all_members():
    a, b = b"L" * 30 + b"core" * 60, b"M" * 30 + b"core" * 60
    got = list(esa.maximal_repeats([(a, 30), (b, 30), (a, 30)], 200))
    assert (30, 240, [0, 2]) in got and any(r[0] == 0 and sorted(r[2]) == [0, 1, 2] for r in got)


def test_repeat_groups_hold_all_occurrences(spark):
    text = "".join(random.Random(1).choice("abcdefgh ") for _ in range(500))
    d = spark.createDataFrame([(1, "1" + text), (2, "2" + text), (3, "3" + text + "z")], "doc_id long, text string")
    rows = esa.repeat_groups(d).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3}
    assert max(r.start + r.length for r in rows if r.doc_id == 1) == 501


def test_repeat_groups_are_the_maximal_repeats(spark, monkeypatch):
    rng = random.Random(3)
    made = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    p, q, long = made(230), made(260), made(900)
    rows = ROWS + [(500 + i, made(40) + p + made(40)) for i in range(6)]  # one passage in many contexts
    rows += [(600, long), (601, long[:700]), (602, made(9) + long[300:]), (603, "1" + q[:200] + "2"), (604, "3" + q[:200] + "4"), (605, q[30:] + "5"), (606, "6" + q[30:]), (None, made(30) + long[100:450])]
    found: dict = defaultdict(list)
    texts = [(t or "").encode() for _, t in rows]
    for d, w in enumerate(texts):
        for s in range(len(w) - 199):
            found[w[s : s + 200]].append((d, s))
    want, length = Counter(), 200
    while found := {x: at for x, at in found.items() if len(at) > 1}:
        longer = defaultdict(list)
        for x, at in found.items():
            before = {texts[d][s - 1] if s else (d, s) for d, s in at}
            after = {texts[d][s + length] if s + length < len(texts[d]) else (d, s) for d, s in at}
            if len(before) > 1 and len(after) > 1:
                want[tuple(sorted(((rows[d][0] or 0), s, length) for d, s in at))] += 1
            for d, s in at:
                if s + length < len(texts[d]):
                    longer[x + texts[d][s + length : s + length + 1]].append((d, s))
        found, length = longer, length + 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for bucket in (2000, 2):
        monkeypatch.setattr(esa, "BUCKET", bucket)
        got: dict = defaultdict(list)
        for r in esa.repeat_groups(docs).collect():
            got[r.bucket, r.repeat].append((r.doc_id or 0, r.start, r.length))
        assert Counter(tuple(sorted(x)) for x in got.values()) == want


def links(threshold: int):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = []
    for _, t in ROWS:
        w = SPACE.findall((t or "").encode().translate(low))
        sets.append({tuple(w[j : j + 3]) for j in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} - {()})
    n, parent, sim = len(ROWS), list(range(len(ROWS))), Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            c = len(sets[a] & sets[b])
            if c and 100 * c >= threshold * len(sets[a] | sets[b]):
                sim[a] += 1
                sim[b] += 1
                parent[max(root(a), root(b))] = min(root(a), root(b))
    low_id: dict = defaultdict(lambda: None)
    for i, (k, _) in enumerate(ROWS):
        if k is not None:
            low_id[root(i)] = k if low_id[root(i)] is None else min(low_id[root(i)], k)
    return Counter((ROWS[i][0], len(sets[i]), sim[i], low_id[root(i)]) for i in range(n))


@pytest.mark.parametrize("threshold,block,frequent", [(70, 512, 32), (40, 4, 2)])
def test_similar_documents(docs, monkeypatch, threshold, block, frequent):
    monkeypatch.setattr(sigtree, "BLOCK", block)
    monkeypatch.setattr(sigtree, "FREQUENT", frequent)
    assert Counter(tuple(r)[:4] for r in sigtree.join(docs, threshold).collect()) == links(threshold)


def test_one_of_each_group_stays(docs):
    out = sigtree.one_of_each(docs)
    ids = [r.doc_id for r in out.collect()]
    assert out.columns == docs.columns and {1, 2, 3, 5, 401} <= set(ids) and ids.count(300) == 1 and not {301, 339, 400} & set(ids)
    assert ids.count(4) == 0  # the words of 3, in capitals


def test_only_linked_rows_of_a_repeated_id_go(spark):
    rng = random.Random(2)
    a, b, c, d = (" ".join(f"{x}{rng.randint(0, 10**6)}" for _ in range(40)) for x in "abcd")
    rows = [(5, a), (7, a), (7, b), (7, c), (7, c + " more"), (8, d), (8, d.upper()), (8, b + " more"), (9, ""), (9, None), (9, ""), (None, a)]
    out = sigtree.one_of_each(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, cls int"))
    got = Counter((r.doc_id, r.text) for r in out.collect())
    of_c = [t for i, t in got if i == 7 and t != b]
    assert out.columns == ["doc_id", "text", "cls"] and len(of_c) == 1 and of_c[0] in (c, c + " more")
    assert got == Counter([(5, a), (7, b), (7, of_c[0]), (8, d.upper()), (9, ""), (9, None), (None, a)])


def test_no_documents(docs):
    assert sigtree.join(docs.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 101), (101, 102), (7, 7), (100, 102)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {100: 100, 101: 100, 102: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def chained(plan, inside: bool = False) -> bool:
    """Whether a task of the plan runs two Python workers at once, one behind the other."""
    if plan.nodeName().startswith("AdaptiveSparkPlan"):
        plan = plan.initialPlan()
    if plan.nodeName().startswith("MapInArrow"):
        if inside:
            return True
        inside = True
    inside = inside and "Exchange" not in plan.nodeName()
    return any(chained(plan.children().apply(i), inside) for i in range(plan.children().size()))


def test_one_python_worker_a_task(docs):
    for out in (esa.without_repeats(docs), esa.drop_repeats(docs), debruijn.drop_repeats(docs), sigtree.one_of_each(docs)):
        assert not chained(out._jdf.queryExecution().executedPlan())
    twice = docs.select("doc_id").mapInArrow(lambda x: x, "doc_id long").mapInArrow(lambda x: x, "doc_id long")
    assert chained(twice._jdf.queryExecution().executedPlan())


def test_a_stage_leaves_no_shuffle_files(spark):
    def left() -> set[str]:
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}

    def grown(write) -> set[str]:
        before = left()
        write(spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count())
        for _ in range(40):  # removal isn't awaited
            if not left() - before:
                break
            time.sleep(0.1)
        return left() - before

    was = spark.conf.get(shared.CLEANUP, None)
    assert not grown(lambda df: shared.stage(df, "counts"))
    assert spark.conf.get(shared.CLEANUP, None) == was
    assert grown(lambda df: df.write.format("noop").mode("overwrite").save())  # what it looks for can be seen
    rows = spark.range(1000).repartition(4, "id").groupBy("id").count()
    assert shared.stage(rows, "once").count() == shared.stage(rows, "again").count() == rows.count() == 1000
