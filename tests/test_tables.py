"""Whole tables, headings of markup, layout: small cases, and rows that are null, empty or odd."""

from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from vellum.functions import html
from vellum.operators import flatten, grid, layout, markup, tables


def test_statistical_rows_of_a_table():
    got = tables.flatten([["", "t-value", "df", "p", "d"], ["Effort", "3.93", "741", "<.001", "0.29"], ["Time", "1.2", "741", ".23", "0.05"]])
    assert [r["sentence"] for r in got] == ["Effort: t(741) = 3.93, p < .001, d = 0.29", "Time: t(741) = 1.2, p = .23, d = 0.05"]
    assert tables.flatten([["a", "b"]]) == [] and tables.flatten([]) == []


def test_values_outside_their_range_are_left_out():
    got = tables.flatten([["x", "r", "p"], ["A", "1.7", ".01"], ["B", ".5", "3"]])
    assert [r["sentence"] for r in got] == ["A: p = .01", "B: r = .5"]


@pytest.mark.parametrize("cell,est,want", [("0.12-0.45", None, (0.12, 0.45)), ("-11.2-7.5", None, (-11.2, 7.5)), ("11.2-7.5", -9.0, (-11.2, 7.5)), ("-1.01% (-10.36–8.34)", -1.01, (-10.36, 8.34)), ("[0.2, 0.4]", None, (0.2, 0.4)), ("none", None, None)])
def test_intervals(spark, cell, est, want):
    assert tables.interval_in(cell, est) == want
    row = spark.createDataFrame([(cell, est)], "c string, e double").select(flatten.interval(F.col("c"), F.col("e")).alias("i")).first().i
    assert (row and (row.lower, row.upper)) == want


def test_header_recovery_needs_a_sign_of_statistics():
    body = [["a", "2, 30", "4.5"], ["b", "2, 30", "1.5"]]
    assert tables.recovered(["", "", ""], body, 0, "A plain caption") == {}
    assert tables.recovered(["", "", ""], body, 0, "df F of the tests") == {1: "df_pair", 2: "F"}
    assert tables.caption_run("Table 2. df F p 95% CI of it") == ["df", "F", "p", "CI"]


def test_grids_of_columns(spark):
    d = spark.createDataFrame([(1, [["A", "N"], ["x", None], ["", "*"]]), (2, None), (3, []), (4, [["one"]])], "i int, g array<array<string>>")
    got = {r.i: r for r in d.select("i", tables.cleaned(F.col("g")).alias("c"), tables.as_html(F.col("g")).alias("h"), tables.flattened(F.col("g"), F.lit(None).cast("string")).alias("f")).collect()}
    assert got[2].c is None and got[2].h is None and got[3].c == [] and got[4].h == "" and got[1].f == []


def test_raw_fallback_escapes():
    assert tables.raw_html(" a < b ") == "<pre>a &lt; b</pre>" and tables.raw_html(" ") == ""


def docx(*paragraphs: tuple[str, str]) -> bytes:
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_headings_of_word_documents(spark):
    content = docx(("Heading1", "Abstract"), ("Normal", "We ran it."), ("Heading4", "Sample"), ("Heading2", "Results"))
    d = spark.createDataFrame([(1, content), (2, b"broken"), (3, None)], "i int, c binary").select("i", markup.annotated(F.col("c"), markup.docx_blocks).alias("a"))
    got = {r.i: r.a for r in d.collect()}
    assert [(h.text, h.strength, h.label) for h in got[1].hints] == [("Abstract", "strong", "abstract"), ("Sample", "weak", None), ("Results", "strong", "results")]
    assert got[1].text == "Abstract\n\nWe ran it.\n\nSample\n\nResults" and all(got[i] is None or got[i].text is None for i in (2, 3))


SPANS = "doc_id long, page int, text string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, height double"


def test_running_lines_go_and_footnotes_move(spark):
    rows = []
    for p in range(3):
        rows += [(1, p, "Journal of Things", 50.0, 770.0, 90.0, 778.0, 9.0, False, 800.0), (1, p, f"Body line {p} of it", 50.0, 600.0, 90.0, 608.0, 10.0, False, 800.0), (1, p, f"1 A note {p}", 50.0, 300.0, 90.0, 306.0, 7.0, False, 800.0), (1, p, "Foot of page", 50.0, 100.0, 90.0, 106.0, 7.0, False, 800.0)]
    spans = spark.createDataFrame(rows, SPANS)
    text = "".join(f"Journal of Things\nBody line {p} of it\n1 A note {p}\nFoot of page\n\f" for p in range(3))
    docs = spark.createDataFrame([(1, text), (2, "no spans"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in layout.strip_lines(docs, spans).collect()}
    assert "Journal" not in got[1].text and "Foot of page" not in got[1].text and got[1].footnotes == [f"1 A note {p}" for p in range(3)]
    assert got[1].text.split("\n\f\f\n")[1] == "1 A note 0\n\n1 A note 1\n\n1 A note 2" and got[2].text == "no spans" and got[3].text is None
    table = spark.createDataFrame([(1, 1, 0.0, 290.0, 200.0, 320.0)], "doc_id long, page int, x0 double, y0 double, x1 double, y1 double")
    kept = {r.doc_id: r for r in layout.strip_lines(docs, spans, table).collect()}
    assert kept[1].footnotes == ["1 A note 0", "1 A note 2"]


def test_signs_are_put_back_as_often_as_the_layout_has_them():
    assert layout.put_signs("b = .02, b = .02 and x .02", {".02": 1}, 1) == "β = -.02, b = .02 and x .02"
    assert layout.put_signs(None, {}, 0) is None and layout.put_signs("b = .021", {".02": 2}, 0) == "b = .021"


def test_places_of_items(spark):
    s = spark.createDataFrame([(1, "methods", 0, 10), (1, "results", 10, 20)], "doc_id long, label string, char_start int, char_end int")
    i = spark.createDataFrame([(1, 1, 3), (1, 2, 10), (1, 3, 99), (1, 4, None), (2, 5, 1)], "doc_id long, item_id int, offset int")
    assert {r.item_id: r.label for r in layout.place_in_sections(i, s).collect()} == {1: "methods", 2: "results", 3: "appendix", 4: "appendix", 5: "appendix"}


def test_only_spans_that_may_be_headings_meet_the_body_size(spark):
    words = lambda n: " ".join(["Word"] * n)
    rows = [(1, 1, words(12), 12.0, False), (1, 1, words(13), 12.0, False), (1, 1, "\n" + words(12), 12.0, False), (1, 1, "Done.\r\n", 12.0, False), (1, 1, "2.1 Aims of " + words(40) + ".", 10.0, False), (1, 1, words(8), 10.0, False), (1, 1, "plain words", 10.6, True), (1, 1, " ", 12.0, False), (1, 1, None, 12.0, False), (1, 1, "body text of it. " * 900, 10.0, False)]
    spans = spark.createDataFrame(rows, "doc_id int, page int, text string, size double, bold boolean")
    found = layout.heading_spans(spans)
    assert sorted((r.text, r.strength) for r in found.collect()) == sorted([(words(12), "strong"), ("2.1 Aims of " + words(40) + ".", "strong"), (words(8), "weak"), ("plain words", "strong")])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.rindex("RLIKE")  # patterns are tried below the join: no other span is shuffled


def test_named_references_end_with_a_semicolon():
    assert html.page_text("<h1>a &amp; b&amp;&amp</h1><p>&notit; &copy &eacute;, R&D &#8212 <!-- x&amp -->") == "a & b&&amp\n&notit; &copy é, R&D —"
    assert html.page_text("<p>x<!-- R&amp;D&amp -->", markup=True) == "x R&amp;D&amp"
    assert markup.html_blocks("<p>a&amp</p><p>b&amp;</p>") == [("p", "a&amp"), ("p", "b&")]


def test_the_cells_of_a_row_are_worked_out_once(spark):
    d = spark.createDataFrame([("2.50", "-.20")], "t string, r string")
    cs = F.array(F.struct(F.lit("t").alias("role"), F.concat(F.lit("zebra "), "t").alias("text")), F.struct(F.lit("r").alias("role"), F.col("r").alias("text")), F.struct(F.lit("t").alias("role"), F.lit("9").alias("text")))
    out = d.select(flatten.fields(cs).alias("f"))
    assert out._jdf.queryExecution().analyzed().toString().count("zebra") == 1
    assert out.select(flatten.sentence(F.lit("x"), F.col("f"))).first()[0] == "x: t = 2.5, r = -.2"
    shown = spark.createDataFrame([(100.0, "100"), (0.5, "0.5"), (-1.25, "-1.25"), (0.0, "0")], "v double, s string")
    assert shown.where(~flatten.shown(F.col("v")).eqNullSafe(F.col("s"))).count() == 0


def test_a_cell_written_twice_at_once_is_settled(spark):
    rows = [(1, 0, 0, 5, t, False) for t in ("b", "a", "c")]
    for some in (rows, rows[::-1]):
        assert grid.dense(spark.createDataFrame(some, "table_id int, r int, c int, ord int, text string, is_header boolean").coalesce(1), "table_id").first()["values"] == ["a"]


def test_words_at_one_place_are_in_one_row(spark):
    w = spark.createDataFrame([(1, 0.0, 0.0, 2.0)] * 2 + [(1, 9.0, 1.0, 11.0)] * 3, "doc_id int, top double, x0 double, bottom double")
    assert sorted((r.top, r.r) for r in grid.row_islands(w, "doc_id").collect()) == [(0.0, 0)] * 2 + [(9.0, 1)] * 3


def test_spans_are_joined_by_document_alone(spark):
    rows = [(1, p, t, 50.0, y, 90.0, y + 8, s, False, 800.0) for p in (0, 1) for t, y, s in (("Journal  of it", 795.0, 7.0), ("body words", 600.0, 10.0), (f"note p{p}", 100.0, 8.0))]
    keys = layout.line_keys(spark.createDataFrame(rows, "doc_id int, page int, text string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, height double"))
    joins = [l for l in keys._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in l]
    assert joins and all(l.count(" = ") == 1 for l in joins)
    r = keys.first()
    assert r.running == ["Journal of it"] and sorted(r.footnotes) == ["note p0", "note p1"]
