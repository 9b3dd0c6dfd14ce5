"""Sections, captions, grids, statistical rows, repairs, references and Markdown on small cases."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.operators import captions, checks, flatten, grid, references, render, repairs, sections
from vellum.plans.render_queries import PASSES, REPAIRS

PAPER = "Title here\n\nAbstract\n\nShort.\n\n1. Introduction\n\nText. Methods are in the text.\n\nMethods\n\nA.\n\n" + "B " * 100 + "\n\nMethods\n\nC.\n\nReferences\n\nAbel, A. (2001). One."


def test_sections_cover_the_text_and_repeats_are_numbered():
    found = sections.sections_of(PAPER)
    assert [s["label"] for s in found] == ["unknown", "abstract", "introduction", "methods", "methods_2", "references"]
    assert found[0]["char_start"] == 0 and found[-1]["char_end"] == len(PAPER)
    assert all(a["char_end"] == b["char_start"] for a, b in zip(found, found[1:]))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["Methods", "Results", "word word.", "", "Abstract", "lower line", "Odd Heading"]), max_size=30))
def test_any_text_is_covered(ls):
    text = "\n".join(ls)
    found = sections.sections_of(text)
    assert "".join(text[s["char_start"] : s["char_end"]] for s in found) == text


def test_text_for_and_nulls(spark):
    d = spark.createDataFrame([(PAPER,), (None,)], "text string").withColumn("s", sections.sections(F.col("text")))
    got = d.select(sections.text_for(F.col("text"), F.col("s"), "abstract", "references")).collect()
    assert got[0][0].startswith("Abstract\n\nShort.") and "Abel" in got[0][0] and got[1][0] is None


def test_introduction_is_split_off_a_long_abstract():
    text = "Abstract\n\n" + "a " * 500 + "\n\n" + "b " * 1200 + "\n\nMethods\n\nx"
    assert [s["label"] for s in sections.sections_of(text)] == ["abstract", "introduction", "methods"]


def test_captions():
    text = "We see this in\nTable 2 Shows it\n\nTable 2. Means of\ngroups.\n\nFigure 1: Plot\nTable 13 below shows"
    found = captions.captions_of(text)
    assert [(c["kind"], c["number"], c["is_reference"]) for c in found] == [("table", 2, True), ("table", 2, False), ("figure", 1, False)]
    assert found[1]["caption"] == "Table 2. Means of groups."


def test_grid(spark):
    rows = [(1, 0, 0, 0, True, "a<b"), (1, 0, 1, 1, True, "B"), (1, 1, 1, 2, False, "2"), (1, 1, 1, 3, False, "later")]
    cells = spark.createDataFrame(rows, "table_id int, r int, c int, ord int, is_header boolean, text string")
    assert sorted((r.r, r["values"]) for r in grid.dense(cells, "table_id").collect()) == [(0, ["a<b", "B"]), (1, ["", "2"])]
    assert grid.html(cells.where("ord < 3"), "table_id").first().html == "<table><tr><th>a&lt;b</th><th>B</th></tr><tr><td>2</td></tr></table>"
    assert grid.html(cells.where("r = 0"), "table_id").first().html == ""
    got = spark.range(1).select(grid.bands(F.array(*map(F.lit, [10.0, 0.0, 1.0, 11.5, 20.0]))).alias("b")).first().b
    assert got == [0.5, 10.75, 20.0]


@pytest.mark.parametrize("cell,op,value", [("<.001", "<", 0.001), ("p = .04*", "=", 0.04), ("1.4", None, None), ("n.s.", None, None)])
def test_p_values(spark, cell, op, value):
    p = spark.range(1).select(flatten.p_value(F.lit(cell)).alias("p")).first().p
    assert (p.op, p.value) == (op, value) if value is not None else p is None


def test_one_row_as_a_sentence(spark):
    cs = [("t", "2.50"), ("df", "38"), ("p", "<.05"), ("d", "0.80"), ("r", "1.4")]
    cells = F.array(*(F.struct(F.lit(r).alias("role"), F.lit(t).alias("text")) for r, t in cs))
    f = spark.range(1).select(flatten.fields(cells).alias("f"))
    assert f.first().f.r is None
    assert f.select(flatten.sentence(F.lit("Recall"), F.col("f"))).first()[0] == "Recall: t(38) = 2.5, p < .05, d = 0.8"


@pytest.mark.parametrize("name", list(REPAIRS))
def test_repairs(name):
    f, cases = REPAIRS[name]
    for sample, want in cases:
        assert f(sample) == (want or sample)


@pytest.mark.parametrize("name", list(PASSES))
def test_passes(name):
    f, sample, want = PASSES[name]
    assert f(sample) == want


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab12 .\n-#|[]=,()", max_size=150))
def test_passes_never_fail(text):
    render.finish_text(text)
    repairs.repair_text(text)
    references.repair_text(text)


def test_references():
    text = "x\nReferences\nAbel, A. (2001). On a\nthing.\nBaker, B. (2002). Two.\nCole, C. (2003). Three.\nAppendix\ny"
    (span,) = references.spans_of(text)
    assert text[span["start"] : span["end"]].startswith("Abel") and "Appendix" not in text[span["start"] : span["end"]]
    assert "On a thing." in references.repair_text(text)
    assert references.pair_columns(["1.", "2.", "3.", "Abel, x", "Baker, y", "Cole, z"]) == ["1. Abel, x", "2. Baker, y", "3. Cole, z"]
    assert references.drop_page_numbers("the effect 57 was and of 57 people", {"57"}) == "the effect was and of 57 people"


def test_checks(spark):
    d = spark.createDataFrame([("a b c", "c b d"), ("", "")], "x string, y string")
    assert [r[0] for r in d.select(checks.jaccard(F.col("x"), F.col("y"))).collect()] == [0.5, 1.0]
    items = spark.createDataFrame([(1, "a b c d e f g h i"), (2, "q r s t u v w x")], "item_id long, text string")
    docs = spark.createDataFrame([("z A b c d e f g h",)], "text string")
    assert {(r.item_id, r.n_grams, r.n_found) for r in checks.survival(items, docs).collect()} == {(1, 2, 1), (2, 1, 0)}
