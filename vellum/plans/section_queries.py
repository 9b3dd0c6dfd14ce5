"""Queries of the section and caption operators, over documents in a scaffold of headings and captions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from vellum.functions.each import each
from vellum.functions.rewrite import quote
from vellum.operators import captions, sections
from vellum.plans.corpus import read

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


HEADINGS = ("Introduction", "1. Methods", "Results", "Methods", "General Discussion", "References")
SCAFFOLD = f"(SELECT doc_id, concat(CASE WHEN doc_id % 3 = 0 THEN concat('Abstract', chr(10), chr(10)) ELSE '' END, text, {', '.join(f'chr(10), chr(10), {quote(h)}, chr(10), chr(10), {quote(f'Para {i} of it.')}' for i, h in enumerate(HEADINGS))}) AS text FROM documents)"


def scaffold(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    parts = [F.lit(f"\n\n{h}\n\nPara {i} of it.") for i, h in enumerate(HEADINGS)]
    return d.select("doc_id", F.concat(F.when(F.col("doc_id") % 3 == 0, "Abstract\n\n").otherwise(""), "text", *parts).alias("text"))


_dim = "(VALUES " + ", ".join(f"({quote(v)}, {quote(label)})" for v, label in sections.LABEL.items()) + ") AS dim(variant, label)"
SPANS_SQL = f"""
    WITH src AS {SCAFFOLD},
    l AS (SELECT doc_id, length(text) AS size, i, trim(ls[i], ' ') AS s, CASE WHEN i = 1 THEN '' ELSE trim(ls[i - 1], ' ') END AS before,
                 coalesce(list_sum(list_transform(ls[1:i - 1], lambda x: length(x) + 1)), 0)::INT AS starts
          FROM (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM src), unnest(range(1, len(ls) + 1)) AS u(i)),
    m AS (SELECT doc_id, size, s, starts, label FROM l JOIN {_dim} ON lower(rtrim(regexp_replace(s, '^(?:[0-9]+(?:[.][0-9]+)*[.]?|[IVX]+[.])\\s+', ''), ' :.')) = variant WHERE before = '' AND regexp_matches(s, '^[0-9. ]*[A-Z]')),
    a AS (SELECT * FROM m UNION ALL SELECT doc_id, length(text), NULL, 0, 'unknown' FROM src WHERE doc_id NOT IN (SELECT doc_id FROM m WHERE starts = 0)),
    b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY starts) - 1 AS ord, row_number() OVER (PARTITION BY doc_id, label ORDER BY starts) AS nth,
                 lead(starts, 1, size) OVER (PARTITION BY doc_id ORDER BY starts) AS ends FROM a)
    SELECT doc_id, ord::INT AS ord, CASE WHEN nth > 1 AND s IS NOT NULL THEN label || '_' || nth ELSE label END AS label, label AS canonical_label, starts::INT AS char_start, ends::INT AS char_end, s AS heading_text FROM b"""


@query("section_spans", SPANS_SQL)
def section_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scaffold(spark, sf_dir)
    spans = each(lambda t: sections.partition(t, sections.hints(t)), ArrayType(sections.SECTION))
    return d.select("doc_id", F.inline(spans(F.col("text")))).select("doc_id", "ord", "label", "canonical_label", "char_start", "char_end", "heading_text")


@query("section_coverage", f"SELECT count(*) AS n_docs, sum(length(text))::BIGINT AS n_chars FROM {SCAFFOLD}")
def section_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans, synthesized ones too, cover every text: their lengths add up to the corpus."""
    rows = sections.section_rows(scaffold(spark, sf_dir))
    return rows.groupBy("doc_id").agg(F.sum(F.col("char_end") - F.col("char_start")).alias("n")).agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_chars"))


@query("section_text_for", f"SELECT doc_id, 'Results' || chr(10) || chr(10) || 'Para 2 of it.' || chr(10) || chr(10) || chr(10) || chr(10) || 'References' || chr(10) || chr(10) || 'Para 5 of it.' AS text FROM documents")
def section_text_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scaffold(spark, sf_dir).withColumn("found", sections.sections(F.col("text")))
    return d.select("doc_id", sections.text_for(F.col("text"), F.col("found"), "results", "references").alias("text"))


@query("headings_lookup", f"SELECT h AS heading, label FROM (VALUES {', '.join(f'({quote(h)})' for h in (*HEADINGS, 'Zebra', 'SUMMARY:'))}) AS t(h) LEFT JOIN {_dim} ON lower(rtrim(regexp_replace(h, '^(?:[0-9]+(?:[.][0-9]+)*[.]?|[IVX]+[.])\\s+', ''), ' :.')) = variant")
def headings_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings joined to the dictionary, a dimension of fixed size."""
    found = spark.createDataFrame([(h,) for h in (*HEADINGS, "Zebra", "SUMMARY:")], "heading string")
    dim = spark.createDataFrame(list(sections.LABEL.items()), "variant string, label string")
    key = F.lower(F.rtrim(F.regexp_replace(F.regexp_replace("heading", r"^(?:[0-9]+(?:[.][0-9]+)*[.]?|[IVX]+[.])\s+", ""), "[ :.]+$", "")))
    return found.withColumn("variant", key).join(F.broadcast(dim), "variant", "left").select("heading", "label")


@query("section_hints", SPANS_SQL[: SPANS_SQL.index("a AS (SELECT * FROM m")].rstrip().rstrip(",") + " SELECT doc_id, s AS heading, starts::INT AS char_start, label FROM m")
def section_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical headings, before any of them is dropped or numbered."""
    found = scaffold(spark, sf_dir).select("doc_id", F.inline(sections.heading_hints(F.col("text"))))
    return found.where("label IS NOT NULL").select("doc_id", F.col("text").alias("heading"), "char_start", "label")


@query("section_subheadings", "SELECT doc_id, 'references' AS label, 'Early Work|Late Work' AS subheadings FROM documents")
def section_subheadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unlabelled headings of the section they stand in; those of the last section, which no document's own text reaches."""
    d = scaffold(spark, sf_dir).withColumn("text", F.concat("text", F.lit("\n\nEarly Work\n\nProse of it.\n\nLate Work\n\nMore of it.")))
    return sections.section_rows(d).where("label = 'references'").select("doc_id", "label", F.array_join("subheadings", "|").alias("subheadings"))


@query("synth_sections", """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'abstract' ELSE 'introduction' END AS label, (CASE WHEN doc_id % 2 = 0 THEN 122 ELSE 912 END)::INT AS char_start, (CASE WHEN doc_id % 2 = 0 THEN 124 + 2000 ELSE 914 + 2500 END + doc_id % 50)::INT AS char_end FROM documents""")
def synth_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An abstract out of an unlabelled front, past a first short paragraph, and an introduction out of a long abstract."""
    i = F.col("doc_id")
    wide = lambda c, n: F.repeat(F.lit(c), (n + i % 50).cast("int"))
    front = F.concat(F.repeat(F.lit("short "), F.lit(20)), F.lit("\n\n"), wide("w", 2000))
    long = F.concat(F.lit("Abstract\n\n"), F.repeat(F.lit("y"), F.lit(900)), F.lit("\n\n"), wide("z", 2500))
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.when(i % 2 == 0, front).otherwise(long), F.lit("\n\nMethods\n\n"), F.coalesce("text", F.lit(""))).alias("text"))
    return sections.section_rows(d).where("detected_via = 'synthesized'").select("doc_id", "label", "char_start", "char_end")


PAGED = "(SELECT doc_id, concat(text, chr(12), repeat('second page ', (doc_id % 5 + 1)::INT), chr(12), 'third') AS text FROM documents)"


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit("\f"), F.repeat(F.lit("second page "), (F.col("doc_id") % 5 + 1).cast("int")), F.lit("\fthird")).alias("text"))


@query("page_for_offset", f"""SELECT doc_id, p.o AS char_offset, (1 + length(substr(text, 1, p.o)) - length(replace(substr(text, 1, p.o), chr(12), '')))::INT AS page
    FROM {PAGED} d, (SELECT unnest(range(0, 40000, 500))::INT AS o) p WHERE p.o < length(text)""")
def page_for_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = paged(spark, sf_dir).withColumn("starts", sections.page_starts(F.col("text")))
    d = d.select("doc_id", "starts", F.explode(F.sequence(F.lit(0), F.least(F.lit(39500), F.length("text") - 1), F.lit(500))).alias("char_offset"))
    return d.select("doc_id", "char_offset", sections.page_of(F.col("char_offset"), F.col("starts")).alias("page"))


@query("count_pages", f"SELECT doc_id, (1 + length(text) - length(replace(text, chr(12), '')))::INT AS n_pages FROM {PAGED}")
def count_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.sources.formats import text_pages

    return paged(spark, sf_dir).select("doc_id", text_pages(F.col("text")).alias("n_pages"))


@query("section_pages", f"""WITH p AS {PAGED}, s AS (SELECT doc_id, text, length(text) AS n, length(string_split(text, chr(12))[1]) AS a, length(string_split(text, chr(12))[2]) AS b FROM p)
    SELECT doc_id, CASE WHEN n // 2 > a + 1 + b + 1 THEN '1,2,3' WHEN n // 2 > a + 1 THEN '1,2' ELSE '1' END AS pages FROM s""")
def section_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that the first half of each text overlaps."""
    t = F.col("text")
    d = paged(spark, sf_dir).withColumn("starts", sections.page_starts(t))
    return d.select("doc_id", F.array_join(sections.pages_of(F.lit(0), F.floor(F.length(t) / 2).cast("int"), F.col("starts"), F.length(t)), ",").alias("pages"))


@query("section_boundaries", f"SELECT doc_id, count(*) FILTER (regexp_full_match(trim(l, ' '), {quote('|'.join(p.lstrip('^') for p in sections.BOUNDARIES).replace('$', ''))})) AS n_boundaries FROM (SELECT doc_id, unnest(string_split(concat(text, chr(10), 'Table 3. Means', chr(10), 'About the author', chr(10), 'Email: a@b.c'), chr(10))) AS l FROM documents) GROUP BY doc_id")
def section_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", F.split(F.concat("text", F.lit("\nTable 3. Means\nAbout the author\nEmail: a@b.c")), "\n").alias("ls"))
    return d.select("doc_id", F.size(F.filter("ls", sections.is_boundary)).cast("long").alias("n_boundaries"))


# Captions:
CAPTIONED = "(SELECT doc_id, concat('Table 1. Means of ', doc_id::VARCHAR, chr(10), text, chr(10), 'as we show in', chr(10), 'Table 2 Shows more', chr(10), chr(10), 'Figure ', (doc_id % 4 + 1)::VARCHAR, ': Plot', chr(10), 'Table 1. Again', chr(10), 'Table 13 below shows') AS text FROM documents)"


def captioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Table 1. Means of "), i.cast("string"), F.lit("\n"), "text", F.lit("\nas we show in\nTable 2 Shows more\n\nFigure "), (i % 4 + 1).cast("string"), F.lit(": Plot\nTable 1. Again\nTable 13 below shows")).alias("text"))


_found = f"""
    l AS (SELECT doc_id, i, ls[i] AS s, CASE WHEN i = 1 THEN '' ELSE ls[i - 1] END AS before, coalesce(list_sum(list_transform(ls[1:i - 1], lambda x: length(x) + 1)), 0)::INT AS starts
          FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {CAPTIONED}), unnest(range(1, len(ls) + 1)) AS u(i)),
    f AS (SELECT doc_id, CASE WHEN regexp_matches(s, {quote(captions.LINE['table'])}) THEN 'table' ELSE 'figure' END AS kind, regexp_extract(s, '[0-9]+')::INT AS number, starts AS char_start, (starts + length(s))::INT AS char_end, s AS line_text,
                 regexp_matches(before, '[,;(]$|\\b(?:in|see|and|of|from|to|by|the|with)$') AS is_reference FROM l WHERE regexp_matches(s, {quote(captions.LINE['table'])}) OR regexp_matches(s, {quote(captions.LINE['figure'])}))"""


@query("caption_matches", f"WITH {_found} SELECT * FROM f")
def caption_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captions.caption_rows(captioned(spark, sf_dir)).select("doc_id", "kind", "number", "char_start", "char_end", "line_text", "is_reference")


@query("caption_dedup", f"WITH {_found} SELECT doc_id, kind, number, char_start FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, kind, number ORDER BY is_reference, char_start) = 1")
def caption_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captions.one_of_each(captions.caption_rows(captioned(spark, sf_dir))).select("doc_id", "kind", "number", "char_start")


@query("caption_next_boundary", f"WITH {_found} SELECT doc_id, kind, number, char_start, lead(char_start) OVER (PARTITION BY doc_id ORDER BY char_start) AS next_start FROM f")
def caption_next_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captions.next_boundary(captions.caption_rows(captioned(spark, sf_dir)).select("doc_id", "kind", "number", "char_start"))


@query("caption_placeholder", f"""SELECT doc_id, string_agg(CASE WHEN regexp_matches(s, {quote(captions.LINE['table'])}) THEN '[Table ' || regexp_extract(s, '[0-9]+') || ': ' || s || ']' WHEN regexp_matches(s, {quote(captions.LINE['figure'])}) THEN '[Figure ' || regexp_extract(s, '[0-9]+') || ': ' || s || ']' ELSE s END, chr(10) ORDER BY i) AS text
    FROM (SELECT doc_id, i, ls[i] AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {CAPTIONED}), unnest(range(1, len(ls) + 1)) AS u(i)) GROUP BY doc_id""")
def caption_placeholder(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = captioned(spark, sf_dir).withColumn("found", captions.captions(F.col("text")))
    return d.select("doc_id", captions.placeholders(F.col("text"), F.col("found")).alias("text"))


@query("caption_text")
def caption_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captions.caption_rows(captioned(spark, sf_dir)).select("doc_id", "label", "caption")


@query("caption_split_join", "SELECT doc_id, concat(text, chr(10), 'Table 3: joined and Fig. 4. too') AS text FROM documents")
def caption_split_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit("\nTable\n\n3: joined and Fig.\n\n4. too")).alias("text"))
    return d.select("doc_id", captions.join_split_captions(F.col("text")).alias("text"))
