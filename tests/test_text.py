"""Quality, HTML, normalization and line operators on small cases."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.functions import fulltext, html, normalize, quality
from vellum.operators import lines
from vellum.plans import cases


@pytest.mark.parametrize("text,score,garbled,confidence", [("", 50, True, "medium"), (None, 50, True, "medium"), ("the and for " * 100, 100, False, "high"), ("zz " * 400, 90, False, "high"), ("the " * 200 + "�" * 12, 90, False, "high")])
def test_quality(spark, text, score, garbled, confidence):
    q = spark.createDataFrame([(text,)], "t string").select(quality.quality(F.col("t")).alias("q")).first().q
    assert (q.score, q.garbled, q.confidence) == (score, garbled, confidence)


@pytest.mark.parametrize(
    "page,text",
    [
        ("<a>Ann</a><a>Lee</a>", "Ann Lee"),
        ("a<br>b", "a\nb"),
        ("<p>One <b>two</b></p><div>three</div>", "One two\nthree"),
        ("<head><title>x</title></head><script>var a = '</p>'</script><p>k &amp; l</p><!-- c -->", "k & l"),
        ("", ""),
        ("<p>r = &minus;0.5 &eacute;</p>", "r = −0.5 é"),
        ('<div title="a>b">x</div>', "x"),
        ("<svg><svg>i</svg>LEAK</svg>x", "x"),
        ("x<script>never closed", "x"),
    ],
)
def test_html(spark, page, text):
    assert spark.createDataFrame([(page,)], "h string").select(html.html_to_text(F.col("h"))).first()[0] == text


def test_steps_change_what_they_should_and_nothing_else(spark):
    rows = [(s.code, kind, x) for s in normalize.STEPS for kind, xs in (("+", s.positive), ("-", s.negative)) for x in xs]
    df = spark.createDataFrame(rows, "code string, kind string, x string")
    for s in normalize.STEPS:
        for r in df.where(F.col("code") == s.code).withColumn("y", s.rewrite.spark(F.col("x"))).collect():
            assert (r.y != r.x) == (r.kind == "+"), (s.code, r.x, r.y)


def test_a_rewrite_of_one_text_equals_its_column(spark):
    rows = [(s.code, x) for s in normalize.STEPS for x in (*s.positive, *s.negative)]
    df = spark.createDataFrame(rows, "code string, x string")
    for s in normalize.STEPS:
        for r in df.where(F.col("code") == s.code).withColumn("y", s.rewrite.spark(F.col("x"))).collect():
            assert s.rewrite.text(r.x) == r.y, s.code


@pytest.mark.parametrize("level,at", [("none", 0), ("standard", 1), ("academic", 2)])
def test_whole_normalization(level, at):
    for c in cases.NORMALIZED:
        assert fulltext.normalize_text(c[0], level) == c[at], c[0]


def test_counts_of_any_length_lose_their_commas():
    done = lambda t: fulltext.normalize_text(t, "academic")
    assert done("N = 1,234,567,890,123 now") == "N = 1234567890123 now"
    assert done("A total of 1,234,567 participants") == "A total of 1234567 participants"
    assert done("see x1,2 and [2,345] and N = 12") == "see x1,2 and [2345] and N = 12"
    assert fulltext.normalize_text("N = 1,234,567", "academic", keep_math=True) == "N = 1,234,567"


def test_levels_and_report(spark):
    text = "\n".join(s.positive[0] for s in normalize.STEPS)
    d = spark.createDataFrame([(text,), (None,), ("",)], "text string")
    none, std, acad = (d.select(fulltext.normalize(F.col("text"), lv)).collect() for lv in ("none", "standard", "academic"))
    assert none[0][0] == text and std[0][0] != text and acad[0][0] != std[0][0]
    assert acad[1][0] is None and acad[2][0] == ""
    r = fulltext.with_report(d, level="standard").collect()[0].report
    assert set(r.steps_changed) <= set(r.steps_applied) and "ligatures" in r.steps_changed and len(r.steps_applied) == len(fulltext.PLANS["standard", False])


def test_normalizing_again_changes_nothing():
    for c in cases.NORMALIZED:
        once = fulltext.normalize_text(c[0])
        assert fulltext.normalize_text(once) == once


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="aZ1 \n.,-=<[](p�é", max_size=200))
def test_any_text_normalizes(text):
    assert isinstance(fulltext.normalize_text(text), str)


@pytest.mark.parametrize("f,some", [(lines.without_banners, cases.BANNERS), (lines.without_furniture, cases.FURNITURE), (lines.without_leaks, cases.LEAKS), (lines.drop_contents_text, cases.CONTENTS), (lines.drop_running_heads, cases.HEADS), (lines.drop_page_clusters, cases.CLUSTERS)])
def test_lines_that_go(f, some):
    for given_, want in some:
        assert f(given_).rstrip("\n ") == want


def test_line_columns(spark):
    def run(f, t):
        return spark.createDataFrame([(t,)], "t string").select(f(F.col("t"))).first()[0]

    assert run(lines.drop_banners, "HHS Public Access\nbody") == "body"
    assert run(lines.drop_banners, "x\n" * 40 + "HHS Public Access").endswith("HHS Public Access")
    assert run(lines.drop_furniture, "a\nPage 3\nb") == "a\nb"
    assert run(lines.close_spaced_labels, "a b s t r a c t\nx y z w") == "abstract\nx y z w"
    assert run(lines.page_numbers, "7\nx\n7\n12\n 9 \n9") == ["7", "9"]


def test_repeated_lines_and_clusters():
    head = "A running head line"
    text = "\n".join((head + "\n" + "x\n" * 25) for _ in range(5))
    assert head not in lines.drop_repeated_lines(text)
    assert lines.drop_repeated_lines("\n".join([head] * 6)) == "\n".join([head] * 6)
    assert "(2019)" in lines.drop_repeated_lines(text.replace("head line", "head (2019)"))
    assert lines.drop_page_clusters("1401\na\n1402\nb\n1403\nc") == "\na\n\nb\n\nc"
    assert lines.drop_page_clusters("2001\na\n2001\nb\n2001") == "2001\na\n2001\nb\n2001"


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab1 \n.2-", max_size=200))
def test_line_folds_are_total_and_idempotent(text):
    for f in (lines.drop_repeated_lines, lines.drop_page_clusters, lines.drop_contents_text):
        once = f(text)
        assert f(once) == once


def test_arrow_batches_are_bounded_and_a_worker_holds_one_slice(spark):
    from pyspark.sql.types import ArrayType, StringType

    from vellum.functions import each
    from vellum.plans.shipping import ship

    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(n) for n in names]
    try:
        spark.conf.set(names[0], 10000)
        ship(spark)
        assert int(spark.conf.get(names[0])) <= each.BATCH_ROWS and int(spark.conf.get(names[1])) <= each.BATCH_BYTES
        d = spark.range(5000).select("id", F.when(F.col("id") % 7 > 0, F.repeat(F.col("id").cast("string"), F.lit(2))).alias("t"))
        got = d.select("id", each.each(lambda t: t + "é", StringType())(F.col("t")).alias("one"), each.each(lambda t: [t], ArrayType(StringType()), nulls=True)(F.col("t")).alias("all"))
        assert got.where("NOT (one <=> concat(repeat(string(id), 2), 'é')) AND id % 7 > 0 OR one IS NOT NULL AND id % 7 = 0 OR NOT (all[0] <=> IF(id % 7 > 0, repeat(string(id), 2), NULL))").count() == 0
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)


def test_compounds_close_up_in_one_pass_over_the_text(spark):
    from vellum.functions.boilerplate import COMPOUNDS
    from vellum.functions.normalize import BY_CODE

    firsts = {a.lower() for a in COMPOUNDS}
    assert not any(__import__("re").fullmatch(b, a) for a in firsts for bs in COMPOUNDS.values() for b in bs.split())
    made = BY_CODE["compounds"].rewrite.spark(F.col("t"))
    t = "the experi\n mental experi mentally ques  tionnaires differ ent con sistently interpre ted con men"
    d = spark.createDataFrame([(t,), (None,)], "t string").select(made.alias("t"))
    assert [r.t for r in d.collect()] == ["the experimental experimentally questionnaires different consistently interpreted con men", None]
    assert d._jdf.queryExecution().analyzed().toString().count("regexp_replace") == 1


def test_quality_splits_no_more_than_its_window(spark):
    from vellum.functions.quality import WINDOW, quality

    texts = ["  the " + "zebra " * (WINDOW - 2) + "the the", "the " * (WINDOW + 5), " ", "é�ﬁ\n", None]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select(quality(F.col("t")).alias("q"))
    got = [r.q for r in d.collect()]
    assert [round(r.common_word_ratio, 4) for r in got] == [round(2 / WINDOW, 4), 1.0, 0.0, 0.0, 0.0] and (got[3].garbled_chars, got[3].ligatures_remaining, got[3].non_ascii_ratio) == (1, 1, 0.75)
    assert d._jdf.queryExecution().analyzed().toString().count("split(") == 1
