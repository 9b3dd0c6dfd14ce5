"""Queries of whole tables and of markup, against results written by hand: the id chooses the case."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import flatten, markup, repairs, tables
from vellum.operators.lines import text_udf
from vellum.plans.corpus import pick, pick_sql, read

QUERIES, ORACLE_SQL = {}, {}
GRID = "array<array<string>>"


def cases_query(name: str, source: str, key: str, cases: list[tuple], f) -> None:
    """``f`` of the first parts of the chosen case, as columns, has to give its last part."""
    inputs, want = [tuple(c[i] for c in cases) for i in range(len(cases[0]) - 1)], tuple(c[-1] for c in cases)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = read(spark, sf_dir, source)
        return rows.select(key, f(*(pick(x, key) for x in inputs)).alias("result"))

    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT {key}, {pick_sql(want, key)} AS result FROM {source}"


def grid(*rows: str) -> str:
    """A table as JSON: rows whose cells bars part."""
    return json.dumps([r.split("|") for r in rows], ensure_ascii=False)


def shown(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda r: F.array_join(r, "|")), "\n")


parsed = lambda text: F.from_json(text, GRID)
STUDY = grid("|t-value|df|p|d", "Effort|3.93|741|<.001|0.29", "Time|1.2|741|.23|0.05")

CLEAN = [
    (grid("12|Smith et al.", "Item no.|Value in m", "One|1"), "Item no.|Value in m\nOne|1"),
    (grid("Item|Claim", "2a|People underestimate how", "|they decide", "3|9"), "Item|Claim\n2a|People underestimate how<br>they decide\n3|9"),
    (grid("Item|N", "Total . . . . . . |3", "|**"), "Item|N\nTotal|3<sup>**</sup>"),
    (grid("Win-|Lose-", "Uncertain|Uncertain", "1|2"), "Win-Uncertain|Lose-Uncertain\n1|2"),
    (grid("Group A||B", "M|SD|x", "0.1|0.2|0.3"), "Group A<br>M|SD|B<br>x\n0.1|0.2|0.3"),
    (grid("Name|r|CI", "One|r = -.73|[−0.78, – 0.67]"), "Name|r|CI\nOne|r = -.73|[−0.78, −0.67]"),
    (grid("Name|CI", "One|0.5 (0.1-", "|8.34)"), "Name|CI\nOne|0.5 (0.1-8.34)"),
    (grid("Setting|N", "SettingDesign|1", "Condition12|2"), "Setting|N\nSetting<br>Design|1\nCondition<br>12|2"),
]
cases_query("table_clean", "documents", "doc_id", CLEAN, lambda g: F.replace(shown(tables.cleaned(parsed(g))), F.lit(tables.SEP), F.lit("<br>")))

HTML = [
    (grid("A|B|C", "Study one||", "x|1|2 < 3"), '<table><tr><th>A</th><th>B</th><th>C</th></tr><tr><td colspan="3"><strong>Study one</strong></td></tr><tr><td>x</td><td>1</td><td>2 &lt; 3</td></tr></table>'),
    (grid("only one row|1"), ""),
    (grid("A|N", "x|1", "|*"), "<table><tr><th>A</th><th>N</th></tr><tr><td>x</td><td>1<sup>*</sup></td></tr></table>"),
]
cases_query("table_html", "documents", "doc_id", HTML, lambda g: tables.as_html(parsed(g)))

FLAT = [
    (STUDY, "Table 1", "Effort: t(741) = 3.93, p < .001, d = 0.29\nTime: t(741) = 1.2, p = .23, d = 0.05"),
    (grid("Item|||||", "Recall|2, 30|4.5|<.01|.12|[0.02, 0.25]", "Speed|2, 30|1.5|.20|.02|[0.00, 0.15]"), "Table 2. df F p η2 95% CI of tests", "Recall: F(2, 30) = 4.5, p < .01, eta2 = .12, 95% CI [0.02, 0.25]\nSpeed: F(2, 30) = 1.5, p = .2, eta2 = .02, 95% CI [0, 0.15]"),
    (grid("DV|Cond|M|p", "Recall|Separate Joint|4.76 5.01|.02 .03", "Speed|Separate Joint|1.7 2.1|.12 .33"), "", "Recall (Separate): M = 4.76, p = .02\nRecall (Joint): M = 5.01, p = .03\nSpeed (Separate): M = 1.7, p = .12\nSpeed (Joint): M = 2.1, p = .33"),
    (grid("x|F|BF01|Effect|95% CI", "A|4.2|0.3|.12|0.02-0.45", "B|1.2|3.3|.02|-11.2-7.5"), "", "A: F = 4.2, eta2 = .12, 95% CI [0.02, 0.45]\nB: F = 1.2, eta2 = .02, 95% CI [-11.2, 7.5]"),
    (grid("x|Cohen's d [95% CI]|n", "A|0.4 [0.1, 0.7]|12", "B|-0.2 [-0.5, 0.1]|13.5"), "", "A: n = 12, d = 0.4, 95% CI [0.1, 0.7]\nB: d = -0.2, 95% CI [-0.5, 0.1]"),
    (grid("x|Effect|p", "A|r = .67|.01", "B|r = 1.67|.02"), "", "A: r = .67, p = .01\nB: p = .02"),
    (grid("a|b", "words|more words here"), "", ""),
]
cases_query("table_flatten", "documents", "doc_id", FLAT, lambda g, c: F.array_join(tables.flattened(parsed(g), c)["sentence"], "\n"))
BLOCK = '<!-- flattened table "Table 1" -->\n### Table 1, as text\n\n- Effort: t(741) = 3.93, p < .001, d = 0.29\n- Time: t(741) = 1.2, p = .23, d = 0.05\n<!-- end of "Table 1" -->\n'
cases_query("table_block", "documents", "doc_id", [(STUDY, "", BLOCK), (grid("a|b", "c|d"), "", "")], lambda g, c: tables.inline_block(parsed(g), c, F.lit("Table 1")))

EFFECTS = [("Cohen's d", "cohens_d"), ("d z", "cohens_d"), ("Hedges g", "hedges_g"), ("r (df)", "pearson_r"), ("η²p", "eta_squared_partial"), ("η²", "eta_squared"), ("Odds Ratio", "odds_ratio"), ("OR", "odds_ratio"), ("Risk difference", "risk_difference"), ("Mean diff.", "mean_difference"), ("word", "none")]
cases_query("effect_types", "documents", "doc_id", EFFECTS, lambda h: F.coalesce(tables.effect_type_of(h), F.lit("none")))

INTERVALS = [("0.12-0.45", "0.12,0.45"), ("-11.2-7.5", "-11.2,7.5"), ("b (0.3-0.9)", "0.3,0.9"), ("[-.5, .2]", "-0.5,0.2"), ("0.9-0.3", "-0.9,0.3"), ("words", "none")]
cases_query("ci_hyphens", "documents", "doc_id", INTERVALS, lambda c: F.coalesce(F.concat(flatten.interval(c)["lower"].cast("string"), F.lit(","), flatten.interval(c)["upper"].cast("string")), F.lit("none")))

TIMES = [("Age 3 Sex interaction", "Age × Sex interaction"), ("Study 3 Results", "Study 3 Results"), ("we crossed Cue 3 Delay here", "we crossed Cue × Delay here")]
cases_query("glyph_times_cells", "documents", "doc_id", TIMES, lambda c: text_udf(repairs.times_in_interactions)(c))

PAGES = [
    ("<h1>Abstract</h1><p>We ran <em>it</em> twice.</p><div>In a <p>block</p> box</div><h2>Methods</h2><h4>Sample</h4><li>one<li>two</ul><h2>References</h2>", "abstract:Abstract|methods:Methods|references:References", "Abstract:strong,Methods:strong,Sample:weak,References:strong"),
    ("<p>No heading at all</p><script>x</script>", "unknown:", ""),
    ("<p>Lead in</p><h3>1. Introduction</h3><p>Text &amp; more</p><h6>Zebra</h6>", "unknown:|introduction:1. Introduction", "1. Introduction:strong,Zebra:weak"),
    ("<article><h2>Results</h2><table><tr><td>cell</td></tr></table>tail</article>", "unknown:|results:Results", "Results:strong"),
]
cases_query("html_sections", "pages", "page_id", [(p, s) for p, s, _ in PAGES], lambda h: F.array_join(F.transform(markup.sections_of(h), lambda s: F.concat(s["label"], F.lit(":"), F.coalesce(s["heading_text"], F.lit("")))), "|"))
cases_query("html_hints", "pages", "page_id", [(p, h) for p, _, h in PAGES], lambda h: F.array_join(F.transform(markup.annotated(h)["hints"], lambda x: F.concat(x["text"], F.lit(":"), x["strength"])), ","))
BLOCKS = [(PAGES[0][0], "Abstract\n\nWe ran it twice.\n\nIn a box\n\nblock\n\nMethods\n\nSample\n\none\n\ntwo\n\nReferences"), (PAGES[1][0], "No heading at all"), (PAGES[2][0], "Lead in\n\n1. Introduction\n\nText & more\n\nZebra"), (PAGES[3][0], "tail\n\nResults")]
cases_query("html_blocks", "pages", "page_id", BLOCKS, lambda h: markup.annotated(h)["text"])
