"""Queries of the repairs, the reference lists and the Markdown passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import captions, references, render, repairs, sections
from vellum.operators.lines import text_udf
from vellum.plans.corpus import with_samples, with_samples_sql

QUERIES, ORACLE_SQL = {}, {}

#: Repair: a sample, and what it becomes; the last sample of each isn't touched.
REPAIRS = {
    "glyph_minus_ci": (repairs.minus_in_interval, (("95% CI [20.92, 20.30].", "95% CI [-0.92, -0.30]."), ("[0.2, 0.9] [25, 3]", None))),
    "glyph_minus_two": (repairs.minus_read_as_two, (("b = 20.45, 95% CI [-0.60, -0.30]", "b = -0.45, 95% CI [-0.60, -0.30]"), ("b = 20.45, 95% CI [20.30, 20.60]", None))),
    "glyph_dropped_minus": (repairs.minus_dropped, (("b = 0.45 [-0.60, -0.30]", "b = -0.45 [-0.60, -0.30]"), ("b = 0.10 [-0.30, 0.40]", None))),
    "glyph_upper_minus": (repairs.upper_minus_dropped, (("-0.45 [-0.60, 0.30]", "-0.45 [-0.60, -0.30]"), ("-0.05 [-0.60, 0.50]", None))),
    "glyph_times": (repairs.times_in_interactions, (("the interaction (Age 3 Sex) was", "the interaction (Age × Sex) was"), ("the interaction in Study 3 Results", None))),
    "glyph_design": (repairs.times_in_designs, (("a 2 3 3 mixed design", "a 2 × 3 mixed design"), ("ran 3 studies", None))),
    "glyph_contrast": (repairs.contrast_signs, (("contrast coded (21, 1)", "contrast coded (-1, 1)"), ("(21, 1) of them", None))),
    "glyph_capitals": (repairs.torn_capitals, (("ACK NOW L EDGEM EN TS", "ACKNOWLEDGEMENTS"), ("SOME OTHER TEXT", None))),
    "glyph_comparison": (repairs.lost_comparison, (("x ≥ 5 and � 5", "x ≥ 5 and ≤ 5"), ("a � b", None))),
    "orphan_number": (repairs.numbered_heading, (("2.1.\n\nMethods", "2.1. Methods"), ("2.1.\n\nZebra stripes", None))),
    "wrapped_hyphen": (repairs.wrapped_hyphens, (("a well-known and well-\nknown case", "a well-known and well-known case"), ("multi-\nple", None))),
}


def _repair(name: str, f, cases) -> None:
    samples = tuple(s for s, _ in cases)
    want = tuple(w or s for s, w in cases)
    wanted = with_samples_sql(*want)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return with_samples(spark, sf_dir, *samples).select("doc_id", F.md5(text_udf(f)(F.col("text"))).alias("text_md5"))

    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT doc_id, md5(text) AS text_md5 FROM {wanted}"


for _name, (_f, _cases) in REPAIRS.items():
    _repair(_name, _f, _cases)

REFERENCES = "\n\nReferences\n\nAbel, A. (2001). On a\nthing. Press.\nBaker, B. C. (2002). More\n\nof it. Press.\nCole, D. (2003). Last. Press.\n\nAppendix\n\nEnd."


def refs_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_samples(spark, sf_dir, REFERENCES).select("doc_id", F.inline(references.spans(F.col("text"))))


def refs_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return with_samples(spark, sf_dir, REFERENCES).select("doc_id", F.md5(references.repair(t)).alias("text_md5"))


QUERIES["refs_spans"], QUERIES["refs_stitch"] = refs_spans, refs_stitch
ORACLE_SQL["refs_spans"] = f"SELECT doc_id, (position(concat(chr(10), 'References', chr(10)) IN text) + 11)::INT AS start, (position('Appendix' IN text) - 1)::INT AS \"end\" FROM {with_samples_sql(REFERENCES)}"
_done = REFERENCES.replace("On a\nthing", "On a thing").replace("More\n\nof it", "More of it").replace("Press.\n\nAppendix", "Press.\nAppendix")
ORACLE_SQL["refs_stitch"] = f"SELECT doc_id, md5(text) AS text_md5 FROM {with_samples_sql(_done)}"

#: Pass: a sample, and what it becomes.
PASSES = {
    "render_repeated_headings": (render.repeated_headings, "## Aims\nx\n## Aims\ny", "## Aims\nx\n\ny"),
    "render_captions": (render.multiline_captions, "Table 1. Means of\nthe groups", "Table 1. Means of the groups"),
    "render_orphan_cells": (render.orphan_cells, "Text\n.12\n.34\n5\n(.6)\nMore text", "Text\nMore text"),
    "render_footnotes": (render.footnotes, "¹ See the appendix", "> ¹ See the appendix"),
    "render_studies": (render.study_headings, "x\n\nStudy 2\n\ny", "x\n\n## Study 2\n\ny"),
    "render_false_headings": (render.false_headings, "## Note\n## Supervision: A. B.\n## Results", "Note\nSupervision: A. B.\n## Results"),
    "render_method_headings": (render.method_headings, "x\n\nProcedure\ny", "x\n\n### Procedure\ny"),
    "render_wrapped_headings": (render.wrapped_headings, "## The role of\nLarge Models\nx", "## The role of Large Models\nx"),
    "render_parallel": (render.parallel_prefixes, "### Is it a\n### Is it b\n### Is it c", "Is it a\nIs it b\nIs it c"),
    "render_inline_labels": (render.inline_labels, "## Abstract\n## Background\nx", "## Abstract\n**Background**\nx"),
    "render_phantom_tables": (render.phantom_tables, "a\n| | |\n|---|---|\nb", "a\nb"),
    "render_repeated_captions": (render.repeated_captions, "Table 9. Means of it\nx\nTable 9. Means of it", "Table 9. Means of it\nx"),
    "render_fences": (render.fence_headings, "```\n## x\n```", "```\nx\n```"),
    "render_compound": (render.compound_tails, "## Results\nand Discussion\nx", "## Results and Discussion\nx"),
    "render_key_points": (render.key_points, "Highlights\n• one\nNext", "> **Highlights**\n> • one\nNext"),
    "render_numbered": (render.numbered_headings, "x\n\n1.2 Early Work\n\ny", "x\n\n### 1.2 Early Work\n\ny"),
    "render_numerals": (render.orphan_numerals, "IV.\n\n## Results", "## IV. Results"),
    "render_badges": (render.badges, "Open Data", "*Open Data*"),
    "render_caption_labels": (render.caption_labels, "Table 1. Table 1. Means", "Table 1. Means"),
}


def _pass(name: str, f, sample: str, want: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return with_samples(spark, sf_dir, sample).select("doc_id", F.md5(text_udf(f)(F.col("text"))).alias("text_md5"))

    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT doc_id, md5(text) AS text_md5 FROM {with_samples_sql(want)}"


for _name, (_f, _s, _w) in PASSES.items():
    _pass(_name, _f, _s, _w)

BODY = "\n\nIntroduction\n\nWe ask.\n\nMethods\n\nTable 1. Means\n\nReferences\n\nNone."


def render_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown: sections found, set and finished in two Arrow passes."""
    t = F.col("text")
    d = with_samples(spark, sf_dir, BODY).withColumn("found", sections.sections(t)).withColumn("captions", captions.captions(t))
    made = render.finish(render.markdown(F.concat(F.lit("Document "), F.col("doc_id").cast("string")), F.col("found"), t))
    return d.select("doc_id", F.md5(render.with_marker(made, F.size(F.filter("captions", lambda c: c["kind"] == "table")))).alias("markdown_md5"))


QUERIES["render_markdown"] = render_markdown
