"""Queries of the text operators: quality, HTML, normalization steps, line operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import fulltext, html, normalize, quality
from vellum.operators import lines
from vellum.operators.lines import text_udf
from vellum.plans import cases
from vellum.plans.html_sql import html_to_text_sql
from vellum.plans.corpus import pick, pick_sql, read, with_samples, with_samples_sql

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# Quality:
@query("quality_score", quality.quality_sql("documents"))
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.inline(F.array(quality.quality(F.col("text")))))


CORRUPT = ("ﬁne ﬂow " * 15, "����� lost", "plain", "éèêëàâäôöûü" * 400)


@query("quality_corrupt", quality.quality_sql(with_samples_sql(*CORRUPT)))
def quality_corrupt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_samples(spark, sf_dir, *CORRUPT).select("doc_id", F.inline(F.array(quality.quality(F.col("text")))))


@query("quality_by_lang", f"SELECT lang, confidence, count(*) AS n_docs, min(score) AS min_score, max(score) AS max_score, count(*) FILTER (garbled) AS n_garbled FROM ({quality.quality_sql('documents')}) q JOIN documents USING (doc_id) GROUP BY lang, confidence")
def quality_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = read(spark, sf_dir, "documents").select("lang", F.inline(F.array(quality.quality(F.col("text")))))
    return q.groupBy("lang", "confidence").agg(F.count("*").alias("n_docs"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.count_if("garbled").alias("n_garbled"))


@query("quality_vs_label", f"SELECT l.quality, q.confidence, count(*) AS n_docs, sum(q.score) AS total_score FROM ({quality.quality_sql('documents')}) q JOIN labels l USING (doc_id) GROUP BY l.quality, q.confidence")
def quality_vs_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    # only the scores, a few bytes a row, meet the labels
    q = read(spark, sf_dir, "documents").select("doc_id", F.inline(F.array(quality.quality(F.col("text"))))).select("doc_id", "score", "confidence")
    return q.join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").groupBy("quality", "confidence").agg(F.count("*").alias("n_docs"), F.sum("score").alias("total_score"))


GREEK = ("α β ᾳ � x", "none", "��Ω")


@query("char_counts", f"SELECT doc_id, (length(text) - length(replace(text, chr(65533), '')))::INT AS n_replacement, (length(text) - length(regexp_replace(text, '[Ͱ-Ͽἀ-῿]', '', 'g')))::INT AS n_greek FROM {with_samples_sql(*GREEK)}")
def char_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_samples(spark, sf_dir, *GREEK).select("doc_id", *quality.char_counts(F.col("text")))


# HTML:
@query("html_to_text", f"SELECT page_id, {html_to_text_sql('html')} AS text FROM pages")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", html.html_to_text(F.col("html")).alias("text"))


#: Pages and their texts.
PAGES = (
    ("<p>r = &minus;0.5 &mdash; &eta;&sup2;, caf&eacute; &#8217;&#x2014;</p>", "r = −0.5 — η², café ’—"),
    ('<div title="a>b">x</div><p>y</p>', "x\ny"),
    ("<p>before</p><script>never closed <p>x", "before"),
    ("<svg><svg>i</svg>LEAK</svg><p>shown</p>", "shown"),
    ("<head><title>t</title><body><p>One <b>two</b>three</p>four", "One two three\nfour"),
    ("<ul><li>a<li>b</ul>1 < 2 &amp; 3 &lt; 4", "a\nb\n1 < 2 & 3 < 4"),
    ("<!doctype html><!-- <p>no</p> --><td>a</td><td>b</td>c<br/>d</i>e", "a\nb\nc\nde"),
    ("<P>Upper<BR>case</P><noscript>n</noscript><p>A</p><p></p><p></p><p>B</p>", "Upper\ncase\nA\nB"),
    ("a\u00a0 b\u2003c\r\nd\u2028e", "a b c\nd\ne"),
    ("<a href=x>Ann</a><a>Lee</a><em>F</em>(1, 30)", "Ann Lee F (1, 30)"),
)


@query("html_cases", f"SELECT page_id, {pick_sql(tuple(p[1] for p in PAGES), 'page_id')} AS text FROM pages")
def html_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that a replacement of tags gets wrong."""
    return read(spark, sf_dir, "pages").select("page_id", html.html_to_text(pick(tuple(p[0] for p in PAGES), "page_id")).alias("text"))


# Normalization, step by step:
def step_query(step: normalize.Step) -> None:
    samples = step.positive + step.negative + (step.positive[0] + "\n" + step.positive[0],)
    rewritten = step.rewrite.sql("text")
    changed = f"SELECT doc_id, text AS before, {rewritten} AS after FROM {with_samples_sql(*samples)}"

    @query(f"norm_{step.code}", f"SELECT doc_id, md5(after) AS text_md5, length(after)::INT AS n_chars, after <> before AS changed, right(after, 60) AS tail FROM ({changed})")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        after = F.col("after")
        return with_samples(spark, sf_dir, *samples).withColumn("after", step.rewrite.spark(F.col("text"))).select("doc_id", F.md5(after).alias("text_md5"), F.length(after).alias("n_chars"), (after != F.col("text")).alias("changed"), F.right(after, F.lit(60)).alias("tail"))


for _step in normalize.STEPS:
    step_query(_step)

def cases_query(name: str, f, some: tuple[cases.Case, ...]) -> None:
    @query(name, cases.expected_sql(some))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return cases.before_texts(spark, sf_dir, f, some)


for _i, _level in enumerate(("none", "standard", "academic")):
    cases_query(f"norm_level_{_level}", lambda t, level=_level: fulltext.normalize(t, level), tuple((c[0], c[_i]) for c in cases.NORMALIZED))
cases_query("norm_keep_math", lambda t: fulltext.normalize(t, "academic", keep_math=True), tuple((c[0], c[0].replace("(0,25)", "(0, 25)")) for c in cases.NORMALIZED if c[0].startswith(("N =", "α", "It was 0,05"))))

EVERYTHING = tuple(c[0] for c in cases.NORMALIZED)


@query("norm_idempotent", f"SELECT doc_id, true AS stable FROM {with_samples_sql(*EVERYTHING)}")
def norm_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalizing again changes nothing."""
    once = with_samples(spark, sf_dir, *EVERYTHING).select("doc_id", fulltext.normalize(F.col("text")).alias("once"))
    return once.select("doc_id", (fulltext.normalize(F.col("once")) == F.col("once")).alias("stable"))


#: Texts, the steps that change them, and by how many characters.
REPORTED = (
    ("e\ufb00ect “a”", "ligatures,quotes", "ligatures:1"),
    ("p\n= .03", "statistic_lines", ""),
    ("η² = .12 of N = 1,234", "thousands,math_words", "math_words:2,thousands:1"),
    ("Page 12\nIt was.", "furniture", "furniture:8"),
    ("plain", "", ""),
)


@query("norm_report", f"SELECT doc_id, {pick_sql(tuple(r[1] for r in REPORTED))} AS steps_changed, {pick_sql(tuple(r[2] for r in REPORTED))} AS chars, 52 AS n_applied FROM documents")
def norm_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fulltext.with_report(read(spark, sf_dir, "documents").select("doc_id", pick(tuple(r[0] for r in REPORTED)).alias("text")))
    chars = F.array_join(F.array_sort(F.transform(F.map_entries("report.changes"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))), ",")
    return r.select("doc_id", F.array_join("report.steps_changed", ",").alias("steps_changed"), chars.alias("chars"), F.size("report.steps_applied").alias("n_applied"))


ACCENTED = ("café", "naïve Å", "plain")


@query("norm_nfc", f"SELECT doc_id, nfc_normalize(text) AS text FROM {with_samples_sql(*ACCENTED)}")
def norm_nfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return with_samples(spark, sf_dir, *ACCENTED).select("doc_id", F.when(t.rlike("[^\\x00-\\x{2ff}]"), lines.nfc(t)).otherwise(t).alias("text"))


# Lines:
cases_query("norm_banner", text_udf(lines.without_banners), cases.BANNERS)
cases_query("norm_furniture", lines.furniture, cases.FURNITURE)
cases_query("norm_front_matter", lines.drop_front_matter, cases.LEAKS)
cases_query("norm_contents", lines.drop_contents, cases.CONTENTS)
cases_query("norm_running_heads", lines.running_heads, cases.HEADS)
cases_query("norm_page_clusters", lines.page_number_clusters, cases.CLUSTERS)


SPACED = ("a b s t r a c t", "m e t h o d", "x y z", "A b c d e")


@query("norm_letterspaced", f"""SELECT doc_id, string_agg(CASE WHEN regexp_matches(trim(l, ' '), '^(?:[a-z] ){{3,}}[a-z]$') AND regexp_matches(l, '[aeiou]') THEN replace(l, ' ', '') ELSE l END, chr(10) ORDER BY i) AS text
    FROM (SELECT doc_id, i, ls[i] AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {with_samples_sql(*SPACED)}), unnest(range(1, len(ls) + 1)) AS u(i)) GROUP BY doc_id""")
def norm_letterspaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_samples(spark, sf_dir, *SPACED).select("doc_id", lines.close_spaced_labels(F.col("text")).alias("text"))


HEADS = "(SELECT doc_id, concat(text, chr(10), repeat(concat('Running head ', (doc_id % 7 + 100)::VARCHAR, chr(10), repeat(concat('filler', chr(10)), 20)), 4 + (doc_id % 3)::INT), repeat(concat(1400 + doc_id % 9, chr(10), 'x', chr(10)), 3), 7, chr(10), 12, chr(10), 7) AS text FROM documents)"


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    head = F.concat(F.lit("Running head "), (i % 7 + 100).cast("string"), F.lit("\n" + "filler\n" * 20))
    numbers = F.repeat(F.concat((1400 + i % 9).cast("string"), F.lit("\nx\n")), 3)
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), F.repeat(head, (4 + i % 3).cast("int")), numbers, F.lit("7\n12\n7")).alias("text"))


@query(
    "norm_repeated_lines",
    f"""WITH l AS (SELECT doc_id, i, ls[i] AS l, trim(ls[i], ' ') AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {HEADS}), unnest(range(1, len(ls) + 1)) AS u(i)),
    g AS (SELECT doc_id, s, i - lag(i) OVER (PARTITION BY doc_id, s ORDER BY i) AS gap FROM l WHERE length(s) BETWEEN 15 AND 120),
    bad AS (SELECT doc_id, s FROM g GROUP BY doc_id, s HAVING count(*) >= 5 AND (count(*) >= 20 OR min(gap) >= 20)
            AND NOT regexp_matches(s, '\\((?:19|20)\\d\\d[a-z]?\\)') AND NOT (length(s) - length(replace(s, ' ', '')) >= 6 AND right(s, 1) IN ('.', '!', '?')))
    SELECT l.doc_id, coalesce(string_agg(l.l, chr(10) ORDER BY l.i), '') AS text FROM l ANTI JOIN bad ON l.doc_id = bad.doc_id AND l.s = bad.s GROUP BY l.doc_id""",
)
def norm_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heads(spark, sf_dir).select("doc_id", lines.repeated_lines(F.col("text")).alias("text"))


@query("norm_page_numbers", f"""SELECT doc_id, string_agg(s, ',' ORDER BY s) AS numbers FROM (
    SELECT doc_id, s FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' '))) AS s FROM {HEADS}) WHERE regexp_full_match(s, '[0-9]{{1,3}}') GROUP BY doc_id, s HAVING count(*) >= 2) GROUP BY doc_id""")
def norm_page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heads(spark, sf_dir).select("doc_id", F.array_join(lines.page_numbers(F.col("text")), ",").alias("numbers"))


@query("interleave_pages", f"SELECT doc_id, {pick_sql(tuple(c[1] for c in cases.PAGES))} AS pages FROM documents")
def interleave_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.interleaved_pages(F.concat(pick(tuple(c[0] for c in cases.PAGES)), F.lit("\f"), F.regexp_replace(F.coalesce("text", F.lit("")), "\\f", " ")))
    pages = F.filter(found, lambda p: p <= F.size(F.split(pick(tuple(c[0] for c in cases.PAGES)), "\f")))  # those of the case, not of the text after it
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(pages, ",").alias("pages"))
