"""Queries of sources, sinks, checks, windows over integers and timestamps, and streams."""

from __future__ import annotations

import pyspark
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import quality
from vellum.functions.rewrite import quote
from vellum.operators import checks, lines
from vellum.plans.html_sql import html_to_text_sql
from vellum.plans.corpus import read, with_samples, with_samples_sql
from vellum.sources import formats, sinks
from vellum.streaming import quality_stream

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


@query("detect_format", "SELECT page_id, CASE page_id % 4 WHEN 1 THEN 'pdf' WHEN 2 THEN 'docx' WHEN 3 THEN NULL ELSE CASE WHEN regexp_matches(lower(html[1:64]), '<!doctype\\s+html|<html') THEN 'html' END END AS format FROM pages")
def detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id") % 4
    raw = F.when(i == 1, F.concat(F.lit("%PDF-1.7 "), "html")).when(i == 2, F.concat(F.lit("PK\x03\x04"), "html")).when(i == 3, F.lit("plain words")).otherwise(F.col("html"))
    return read(spark, sf_dir, "pages").select("page_id", formats.detect_format(raw.cast("binary")).alias("format"))


@query("pdf_pages", "SELECT doc_id, greatest(1, doc_id % 4)::INT AS n_pages FROM documents")
def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("%PDF-1.4 /Type /Pages "), F.repeat(F.lit("<< /Type /Page >> "), (F.col("doc_id") % 4).cast("int")))
    return read(spark, sf_dir, "documents").select("doc_id", formats.pdf_pages(raw.cast("binary")).alias("n_pages"))


@query("decode_html", f"SELECT page_id, {html_to_text_sql("concat(html, '<p>caf', chr(65533), chr(65533), '</p>')")} AS text FROM pages")
def decode_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages as bytes, with two at the end that aren't UTF-8."""
    raw = F.concat(F.encode("html", "UTF-8"), F.unhex(F.lit("3C703E636166FFFE3C2F703E")))
    return read(spark, sf_dir, "pages").select("page_id", formats.decode_html(raw, cap=1 << 30).alias("text"))


_q = quality.quality_sql("documents")


@query("batch_receipt", f"SELECT count(*) AS n_total, count(*) AS n_ok, 0::BIGINT AS n_failed, round(avg(score), 4) AS mean_score FROM ({_q})")
def batch_receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return sinks.receipt(d.select("doc_id", quality.quality(F.col("text"))["score"].alias("score"), F.when(F.col("text").isNull(), "no text").alias("error")))


@query("sidecar_json", f"""SELECT doc_id, '{{"score":' || score || ',"confidence":"' || confidence || '","garbled":' || garbled || '}}' AS sidecar FROM ({_q})""")
def sidecar_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = read(spark, sf_dir, "documents").select("doc_id", F.inline(F.array(quality.quality(F.col("text")))))
    return q.select("doc_id", F.to_json(F.struct("score", "confidence", "garbled")).alias("sidecar"))


@query("extract_documents", f"SELECT q.doc_id, md5(d.text) AS text_md5, q.score, 0 AS n_changed, CASE WHEN d.text IS NULL THEN 'no text' END AS error FROM ({_q}) q JOIN documents d USING (doc_id)")
def extract_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as they are, with quality and report; normalization has queries of its own."""
    out = sinks.extract(read(spark, sf_dir, "documents"), level="none")
    return out.select("doc_id", F.md5("text").alias("text_md5"), F.col("quality.score").alias("score"), F.size("report.steps_changed").alias("n_changed"), "error")


@query("version_info", f"SELECT {quote(sinks.VERSION)} AS engine, {quote(pyspark.__version__)} AS spark, {quote(pyspark.__version__)} AS pyspark")
def version_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.versions(spark).select("engine", "spark", "pyspark")


# Checks:
_words = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


@query("doc_jaccard", f"""WITH b AS (SELECT doc_id, list_distinct({_words.format("text")}) AS x, list_distinct({_words.format("concat(text, ' zq', doc_id, ' zx')")}) AS y FROM documents)
    SELECT doc_id, round(len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))), 6) AS jaccard FROM b""")
def doc_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", F.round(checks.jaccard(t, F.concat(t, F.lit(" zq"), F.col("doc_id").cast("string"), F.lit(" zx"))), 6).alias("jaccard"))


@query("same_words", "SELECT doc_id, doc_id % 2 = 0 AS same FROM documents")
def same_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text and its words in reverse have the same multiset; one word more, and they haven't."""
    t = F.col("text")
    back = F.array_join(F.reverse(F.split(t, r"\s+")), " ")
    return read(spark, sf_dir, "documents").select("doc_id", checks.same_words(t, F.when(F.col("doc_id") % 2 == 0, back).otherwise(F.concat(back, F.lit(" more")))).alias("same"))


_g = "list_transform(range(1, greatest(1, len(ws) - 6)), lambda i: array_to_string(ws[i:i + 7], ' '))"


@query("text_loss", f"""WITH w AS (SELECT item_id, {_words.format("text")} AS ws FROM benchmark), i AS (SELECT DISTINCT item_id, unnest({_g}) AS g FROM w),
    d AS (SELECT {_words.format("text")} AS ws FROM documents), h AS (SELECT DISTINCT unnest({_g}) AS g FROM d)
    SELECT item_id, count(*) AS n_grams, count(h.g) AS n_found FROM i LEFT JOIN h ON i.g = h.g GROUP BY item_id""")
def text_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.survival(read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents"))


LINTED = ("##", "A b c d e f g h", "12", "a hy-", "ﬁne", "� lost", "clean line.")
_case = "CASE " + " ".join(f"WHEN regexp_matches(l, {quote(p)}) THEN {quote(t)}" for t, p in checks.LINT) + " END"


@query("render_lint", f"SELECT {_case} AS tag, count(*) AS n_lines FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM {with_samples_sql(*LINTED)}) GROUP BY ALL")
def render_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    ls = with_samples(spark, sf_dir, *LINTED).select(F.explode(F.split("text", "\n")).alias("l"))
    return ls.groupBy(checks.lint(F.col("l")).alias("tag")).agg(F.count("*").alias("n_lines"))


@query("verdict_diff", f"""WITH q AS (SELECT doc_id, CASE WHEN score >= 80 THEN 1 ELSE 0 END AS v FROM ({_q}) WHERE doc_id % 11 <> 0), l AS (SELECT doc_id, quality AS v FROM labels)
    SELECT coalesce(q.doc_id, l.doc_id) AS doc_id, CASE WHEN q.v IS NULL THEN 'gone' WHEN l.v IS NULL THEN 'new' WHEN q.v <> l.v THEN 'changed' ELSE 'same' END AS change FROM l FULL JOIN q ON l.doc_id = q.doc_id""")
def verdict_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    # which rows the second run lacks is part of the case, as in the SQL
    now = read(spark, sf_dir, "documents").where("doc_id % 11 <> 0").select("doc_id", F.when(quality.quality(F.col("text"))["score"] >= 80, 1).otherwise(0).alias("verdict"))
    return checks.verdicts_changed(read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("verdict")), now, "doc_id")


@query("unique_repair", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'effect of size' WHEN 1 THEN 'c�t of size' ELSE 'plain' END AS text FROM documents")
def unique_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lost character is repaired where one token of the other channel fits, and not where two do."""
    i = F.col("doc_id") % 3
    mine = F.when(i == 0, "e�fect of size").when(i == 1, "c�t of size").otherwise("plain")
    other = F.when(i == 0, "the effect of").otherwise("cat cut of size")
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(checks.unique_repair(F.split(mine, " "), F.split(other, " ")), " ").alias("text"))


# Windows over rows:
@query("value_clusters", """WITH v AS (SELECT DISTINCT user_id, floor(value * 10)::BIGINT AS v FROM events), o AS (SELECT *, v - lag(v) OVER (PARTITION BY user_id ORDER BY v) > 5 AS new FROM v),
    k AS (SELECT user_id, v, sum(coalesce(new, false)::INT) OVER (PARTITION BY user_id ORDER BY v ROWS UNBOUNDED PRECEDING) AS k FROM o)
    SELECT user_id, k::BIGINT AS cluster, count(*) AS n, min(v) AS low, max(v) AS high FROM k GROUP BY user_id, k HAVING count(*) >= 3""")
def value_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of distinct values with gaps of at most 5, of three values or more."""
    w = Window.partitionBy("user_id").orderBy("v")
    v = read(spark, sf_dir, "events").select("user_id", F.floor(F.col("value") * 10).alias("v")).distinct()
    k = v.withColumn("new", F.coalesce(F.col("v") - F.lag("v").over(w) > 5, F.lit(False)).cast("int")).withColumn("cluster", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return k.groupBy("user_id", "cluster").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).where("n >= 3")


@query("line_gaps", """WITH l AS (SELECT doc_id, i, ls[i] AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS u(i)),
    g AS (SELECT doc_id, s, i - lag(i) OVER (PARTITION BY doc_id, s ORDER BY i) AS gap FROM l) SELECT doc_id, md5(s) AS line_md5, count(*) AS n, min(gap)::INT AS min_gap FROM g GROUP BY doc_id, s HAVING count(*) >= 2""")
def line_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated lines of each text and the least distance between two of them."""
    l = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "s"))
    g = l.withColumn("gap", F.col("i") - F.lag("i").over(Window.partitionBy("doc_id", "s").orderBy("i")))
    return g.groupBy("doc_id", "s").agg(F.count("*").alias("n"), F.min("gap").alias("min_gap")).where("n >= 2").select("doc_id", F.md5("s").alias("line_md5"), "n", "min_gap")


@query("page_number_sets", "SELECT user_id, count(*) AS n FROM (SELECT user_id, floor(value)::INT AS v FROM events GROUP BY ALL HAVING count(*) >= 2) GROUP BY user_id")
def page_number_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", F.floor("value").alias("v"))
    return e.groupBy("user_id", "v").count().where("count >= 2").groupBy("user_id").agg(F.count("*").alias("n"))


# Streams:
@query("stream_quality", _q)
def stream_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = read(spark, sf_dir, "documents").select("doc_id", "text").schema
    return quality_stream.drain(quality_stream.scored(quality_stream.documents(spark, _folder(spark, sf_dir), schema)), "stream")


def _folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder that the documents have arrived in."""
    from vellum.sources.folders import work_path

    arrive = work_path(spark, "arrivals")
    read(spark, sf_dir, "documents").select("doc_id", "text").write.parquet(arrive)
    return arrive


@query("stream_windows", "SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events counted by type and hour: one windowed aggregation, as on a stream."""
    c = quality_stream.counts_by_window(read(spark, sf_dir, "events"), "ts", "event_type")
    return c.select("event_type", F.col("window.start").alias("hour"), F.col("count").alias("n"))


@query("nearest_lines", """WITH l AS (SELECT doc_id, i - 1 AS i, trim(ls[i], ' ') AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), unnest(range(1, len(ls) + 1)) AS u(i)),
    n AS (SELECT doc_id, i, s, last_value(nullif(s, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above, first_value(nullif(s, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS below FROM l)
    SELECT doc_id, i::INT AS line, above, below FROM n""")
def nearest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each line the nearest lines with text above and below it."""
    return lines.neighbours(read(spark, sf_dir, "documents")).select("doc_id", "line", "above", "below")
