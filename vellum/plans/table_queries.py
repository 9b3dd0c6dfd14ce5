"""Queries of the table, figure and statistical-row operators; cells and shapes are made from line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.rewrite import quote
from vellum.operators import flatten, grid
from vellum.plans.corpus import read

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# one cell for each of three columns of a line item; some cells are missing, some are there twice
CELLS = """(SELECT l_orderkey AS table_id, l_linenumber AS r, u.c, u.c + l_partkey AS ord, l_linenumber = 1 AS is_header,
    CASE u.c WHEN 0 THEN l_returnflag || '<' || l_linestatus WHEN 1 THEN l_quantity::INT::VARCHAR ELSE l_suppkey::VARCHAR END AS text
    FROM lineitem, (VALUES (0), (1), (2)) AS u(c) WHERE NOT (u.c = 1 AND l_partkey % 5 = 0))"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").withColumn("c", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).where("NOT (c = 1 AND l_partkey % 5 = 0)")
    text = F.when(F.col("c") == 0, F.concat("l_returnflag", F.lit("<"), "l_linestatus")).when(F.col("c") == 1, F.col("l_quantity").cast("int").cast("string")).otherwise(F.col("l_suppkey").cast("string"))
    return li.select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("r"), "c", (F.col("c") + F.col("l_partkey")).alias("ord"), (F.col("l_linenumber") == 1).alias("is_header"), text.alias("text"))


@query("grid_pivot", f"""WITH f AS (SELECT * FROM {CELLS} QUALIFY row_number() OVER (PARTITION BY table_id, r, c ORDER BY ord) = 1), n AS (SELECT table_id, (max(c) + 1)::INT AS n_cols FROM f GROUP BY table_id)
    SELECT f.table_id, r, any_value(n_cols) AS n_cols, coalesce(max(text) FILTER (c = 0), '') || '|' || coalesce(max(text) FILTER (c = 1), '') || '|' || coalesce(max(text) FILTER (c = 2), '') AS "values" FROM f JOIN n ON f.table_id = n.table_id GROUP BY f.table_id, r""")
def grid_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.dense(cells(spark, sf_dir), "table_id").select("table_id", "r", "n_cols", F.array_join("values", "|").alias("values"))


@query("grid_confidence", f"""WITH w AS (SELECT table_id, r, count(*) AS w FROM {CELLS} GROUP BY table_id, r), k AS (SELECT table_id, w, count(*) AS n FROM w GROUP BY table_id, w),
    m AS (SELECT table_id, w AS modal FROM k QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY n DESC, w DESC) = 1)
    SELECT w.table_id, modal, round(least(0.95::DOUBLE, greatest(0.5::DOUBLE, 0.85::DOUBLE - 0.05::DOUBLE * sum((w <> modal)::INT))), 4) AS confidence FROM w JOIN m ON w.table_id = m.table_id GROUP BY w.table_id, modal""")
def grid_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.confidence(cells(spark, sf_dir), "table_id")


@query("grid_html", f"""WITH x AS (SELECT table_id, r, c, ord, '<' || CASE WHEN is_header THEN 'th' ELSE 'td' END || '>' || replace(replace(text, '&', '&amp;'), '<', '&lt;') || '</' || CASE WHEN is_header THEN 'th' ELSE 'td' END || '>' AS cell FROM {CELLS}),
    y AS (SELECT table_id, r, string_agg(cell, '' ORDER BY c, cell) AS cs FROM x GROUP BY table_id, r)
    SELECT table_id, CASE WHEN count(*) < 2 THEN '' ELSE '<table>' || string_agg('<tr>' || cs || '</tr>', '' ORDER BY r) || '</table>' END AS html FROM y GROUP BY table_id""")
def grid_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.html(cells(spark, sf_dir), "table_id")


# characters on a 4 x 4 grid of rules 10 points apart, placed by the line item's numbers
CHARS = "(SELECT l_orderkey AS doc_id, (l_partkey % 29)::DOUBLE AS x0, (l_partkey % 29 + 2)::DOUBLE AS x1, (l_suppkey % 29)::DOUBLE AS top, (l_suppkey % 29 + 2)::DOUBLE AS bottom, l_linenumber::VARCHAR AS text FROM lineitem)"


def chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = F.col("l_partkey") % 29, F.col("l_suppkey") % 29
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), p.cast("double").alias("x0"), (p + 2).cast("double").alias("x1"), s.cast("double").alias("top"), (s + 2).cast("double").alias("bottom"), F.col("l_linenumber").cast("string").alias("text"))


@query("grid_lattice", f"SELECT doc_id, floor((top + 1) / 10)::INT AS r, floor((x0 + 1) / 10)::INT AS c, string_agg(text, '' ORDER BY top, x0, text) AS text FROM {CHARS} WHERE top + 1 < 30 AND x0 + 1 < 30 GROUP BY ALL")
def grid_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chars(spark, sf_dir)
    # two rules within the snap distance for each line, on each page
    at = c.select("doc_id").distinct().withColumn("i", F.explode(F.array(*map(F.lit, range(4))))).withColumn("d", F.explode(F.array(F.lit(-0.5), F.lit(0.5)))).withColumn("p", F.col("i") * 10.0 + F.col("d"))
    flat = at.select("doc_id", F.lit(0.0).alias("x0"), F.lit(30.0).alias("x1"), F.col("p").alias("top"), F.col("p").alias("bottom"))
    tall = at.select("doc_id", F.col("p").alias("x0"), F.col("p").alias("x1"), F.lit(0.0).alias("top"), F.lit(30.0).alias("bottom"))
    return grid.lattice_cells(c, flat.unionByName(tall), "doc_id")


@query("grid_rows", f"""WITH w AS {CHARS}, o AS (SELECT *, top - lag(top) OVER (PARTITION BY doc_id ORDER BY top, x0) > 2.4::DOUBLE AS new FROM w),
    k AS (SELECT doc_id, top, sum(coalesce(new, false)::INT) OVER (PARTITION BY doc_id ORDER BY top, x0 ROWS UNBOUNDED PRECEDING) AS r FROM o) SELECT doc_id, r::INT AS r, count(*) AS n_words, min(top) AS top FROM k GROUP BY doc_id, r""")
def grid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.row_islands(chars(spark, sf_dir), "doc_id").groupBy("doc_id", "r").agg(F.count("*").alias("n_words"), F.min("top").alias("top"))


@query("grid_columns", f"""WITH w AS (SELECT *, lead(x0) OVER (PARTITION BY doc_id, top ORDER BY x0) AS nx FROM {CHARS}), g AS (SELECT doc_id, top, floor((x1 + nx) / 2 / 8)::INT AS mid FROM w WHERE nx > x1),
    n AS (SELECT doc_id, count(DISTINCT top) AS k FROM g GROUP BY doc_id), v AS (SELECT doc_id, mid, count(DISTINCT top) AS votes FROM g GROUP BY doc_id, mid) SELECT v.doc_id, mid, votes FROM v JOIN n ON v.doc_id = n.doc_id WHERE votes >= 0.6::DOUBLE * k""")
def grid_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.column_votes(chars(spark, sf_dir).withColumn("r", F.col("top")), "doc_id")


BOXES = "(SELECT o_orderkey AS doc_id, o_orderkey AS box_id, (o_custkey % 15)::DOUBLE AS x0, (o_custkey % 15 + 10)::DOUBLE AS x1, 3::DOUBLE AS top, 17::DOUBLE AS bottom FROM orders)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("o_custkey") % 15
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderkey").alias("box_id"), x.cast("double").alias("x0"), (x + 10).cast("double").alias("x1"), F.lit(3.0).alias("top"), F.lit(17.0).alias("bottom"))


@query("chars_in_bbox", f"SELECT b.box_id, count(*) AS n_chars FROM {CHARS} c JOIN {BOXES} b ON c.doc_id = b.doc_id AND (c.x0 + c.x1) / 2 BETWEEN b.x0 AND b.x1 AND (c.top + c.bottom) / 2 BETWEEN b.top AND b.bottom GROUP BY b.box_id")
def chars_in_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.inside(chars(spark, sf_dir), boxes(spark, sf_dir), "doc_id").groupBy("box_id").agg(F.count("*").alias("n_chars"))


@query("boxes_overlap", f"""SELECT a.doc_id, round(sum(greatest(0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) * greatest(0, least(a.bottom, c.bottom) - greatest(a.top, c.top))), 4) AS area FROM {BOXES} a JOIN {CHARS} c ON a.doc_id = c.doc_id GROUP BY a.doc_id""")
def boxes_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = lambda d, n: d.select("doc_id", F.struct("x0", "x1", "top", "bottom").alias(n))
    both = shape(boxes(spark, sf_dir), "a").join(shape(chars(spark, sf_dir), "b"), "doc_id")
    return both.groupBy("doc_id").agg(F.round(F.sum(grid.overlap("a", "b")), 4).alias("area"))


@query("figures_bbox", f"""WITH c AS (SELECT doc_id, box_id AS caption_id, x0, x1, top + 20 AS top, bottom + 20 AS bottom FROM {BOXES}),
    j AS (SELECT c.*, g.x0 AS gx0, g.x1 AS gx1, g.top AS gt, g.bottom AS gb FROM c LEFT JOIN {CHARS} g ON c.doc_id = g.doc_id),
    k AS (SELECT doc_id, caption_id, any_value(x0) AS x0, any_value(x1) AS x1, any_value(top) AS top, min(gx0) FILTER (gb <= top AND gt >= top - 400) AS a, min(gt) FILTER (gb <= top AND gt >= top - 400) AS b, max(gx1) FILTER (gb <= top AND gt >= top - 400) AS c, max(gb) FILTER (gb <= top AND gt >= top - 400) AS d,
          min(gx0) FILTER (gt >= bottom AND gb <= bottom + 400) AS e, min(gt) FILTER (gt >= bottom AND gb <= bottom + 400) AS f, max(gx1) FILTER (gt >= bottom AND gb <= bottom + 400) AS g, max(gb) FILTER (gt >= bottom AND gb <= bottom + 400) AS h FROM j GROUP BY doc_id, caption_id)
    SELECT doc_id, caption_id, coalesce(a, e, x0) AS fig_x0, coalesce(b, f, top - 200) AS fig_top, coalesce(c, g, x1) AS fig_x1, coalesce(d, h, top) AS fig_bottom FROM k""")
def figures_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    caps = boxes(spark, sf_dir).select("doc_id", F.col("box_id").alias("caption_id"), "x0", "x1", (F.col("top") + 20).alias("top"), (F.col("bottom") + 20).alias("bottom"))
    return grid.figure_boxes(caps, chars(spark, sf_dir), "doc_id")


@query("table_pick", """WITH a AS (SELECT o_orderkey AS k, o_custkey % 7 + 1 AS n, o_custkey % 50 AS f FROM orders WHERE o_orderkey % 3 <> 0), r AS (SELECT l_orderkey AS k, count(*) AS n, sum(l_quantity)::INT % 60 AS f, max(l_linenumber) = 6 AS side FROM lineitem WHERE l_orderkey % 4 <> 0 GROUP BY l_orderkey)
    SELECT coalesce(a.k, r.k) AS caption_id, CASE WHEN r.k IS NULL THEN 'auto' WHEN a.k IS NULL THEN 'region' WHEN side THEN 'region' WHEN r.n < a.n THEN 'auto' WHEN r.n > a.n THEN CASE WHEN r.f < 0.6::DOUBLE * a.f THEN 'auto' ELSE 'region' END WHEN a.f > r.f THEN 'auto' ELSE 'region' END AS pick FROM a FULL JOIN r ON a.k = r.k""")
def table_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("caption_id"), (F.col("o_custkey") % 7 + 1).alias("n_cols"), (F.col("o_custkey") % 50).alias("filled"))
    r = read(spark, sf_dir, "lineitem").where("l_orderkey % 4 <> 0").groupBy(F.col("l_orderkey").alias("caption_id")).agg(F.count("*").alias("n_cols"), (F.sum("l_quantity").cast("int") % 60).alias("filled"), (F.max("l_linenumber") == 6).alias("side_by_side"))
    return grid.pick_table(a, r, "caption_id")


@query("caption_table_match")
def caption_table_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lambda *c: F.array(*(F.concat(F.lit(n), (F.col(x) % 5).cast("string")) for n, x in c))
    li = read(spark, sf_dir, "lineitem")
    t = li.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("table_id"), words(("a", "l_partkey"), ("b", "l_suppkey"), ("c", "l_linenumber")).alias("table_words"))
    c = li.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("caption_id"), words(("a", "l_suppkey"), ("b", "l_partkey"), ("c", "l_linenumber")).alias("caption_words"))
    return grid.match_captions(t, c, "page")


# Statistical rows:
HEADERS = ("t-value", "df", "p", "Cohen's d", "95% CI", "Group || M", "SD", "N", "η²", "F", "zebra", "Study 1||p-value")
_case = "CASE " + " ".join(f"WHEN regexp_matches(h, {quote(p)}) THEN {quote(r)}" for r, p in flatten.ROLES) + " END"


@query("flatten_roles", f"SELECT header, CASE WHEN position('||' IN header) > 0 THEN {_case.replace('(h,', '(lower(trim(split_part(header, chr(124) || chr(124), 2))),')} ELSE {_case.replace('(h,', '(lower(trim(header)),')} END AS role, count(*) AS n FROM (SELECT list_extract([{', '.join(map(quote, HEADERS))}], (l_partkey % {len(HEADERS)} + 1)::INT) AS header FROM lineitem) GROUP BY header")
def flatten_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.element_at(F.array(*map(F.lit, HEADERS)), (F.col("l_partkey") % len(HEADERS) + 1).cast("int"))
    return read(spark, sf_dir, "lineitem").select(h.alias("header")).groupBy("header").count().select("header", flatten.role(F.col("header")).alias("role"), F.col("count").alias("n"))


@query("flatten_numbers", """WITH s AS (SELECT l_orderkey, l_linenumber, CASE l_partkey % 4 WHEN 0 THEN '< .' || lpad((l_suppkey % 99 + 1)::VARCHAR, 3, '0') WHEN 1 THEN '-' || l_suppkey % 100 || '.5**' WHEN 2 THEN 'b = ' || l_suppkey % 100 ELSE 'n.a' END AS cell FROM lineitem)
    SELECT l_orderkey, l_linenumber, cell, TRY_CAST(nullif(regexp_extract(cell, '^[^0-9.+-]*([+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+))', 1), '') AS DOUBLE) AS value FROM s""")
def flatten_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("l_partkey") % 4, F.col("l_suppkey")
    cell = F.when(k == 0, F.concat(F.lit("< ."), F.lpad((s % 99 + 1).cast("string"), 3, "0"))).when(k == 1, F.concat(F.lit("-"), (s % 100).cast("string"), F.lit(".5**"))).when(k == 2, F.concat(F.lit("b = "), (s % 100).cast("string"))).otherwise("n.a")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cell.alias("cell")).withColumn("value", flatten.number(F.col("cell")))


@query("flatten_ci", """SELECT l_orderkey, l_linenumber, CASE WHEN a <= b THEN a END AS lower, CASE WHEN a <= b THEN b END AS upper FROM (SELECT l_orderkey, l_linenumber, (l_partkey % 40)::DOUBLE AS a, (l_suppkey % 40 + 5)::DOUBLE AS b FROM lineitem)""")
def flatten_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, k = (F.col("l_partkey") % 40).cast("string"), (F.col("l_suppkey") % 40 + 5).cast("string"), F.col("l_linenumber") % 3
    cell = F.when(k == 0, F.concat(F.lit("(x) ["), a, F.lit(", "), b, F.lit("]"))).when(k == 1, F.concat(a, F.lit(" to "), b)).otherwise(F.concat(F.lit("("), a, F.lit(";"), b, F.lit(")")))
    ci = flatten.interval(cell)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ci["lower"].alias("lower"), ci["upper"].alias("upper"))


ROW = """(SELECT l_orderkey, l_linenumber, 'Item ' || l_linenumber AS label, (l_partkey % 900)::DOUBLE / 100 AS t, (l_suppkey % 300 + 1)::INT AS df, l_suppkey % 60 AS p, (l_partkey % 250)::DOUBLE / 100 - 1.2 AS r, (l_quantity)::INT AS n FROM lineitem)"""


def stat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    two = lambda c: F.format_string("%.2f", c)
    cell = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("text"))
    p = F.col("l_suppkey") % 60
    cs = F.array(
        cell("t", two((F.col("l_partkey") % 900).cast("double") / 100)),
        cell("df", (F.col("l_suppkey") % 300 + 1).cast("string")),
        cell("p", F.when(p == 0, "<.001").otherwise(F.concat(F.lit("."), F.lpad(p.cast("string"), 3, "0")))),
        cell("r", two((F.col("l_partkey") % 250).cast("double") / 100 - 1.2)),
        cell("n", F.col("l_quantity").cast("int").cast("string")),
    )
    return li.select("l_orderkey", "l_linenumber", F.concat(F.lit("Item "), F.col("l_linenumber").cast("string")).alias("label"), flatten.fields(cs).alias("f"))


@query("flatten_fields", f"SELECT l_orderkey, l_linenumber, round(t, 2) AS t, df::DOUBLE AS df, CASE WHEN p = 0 THEN '<' ELSE '=' END AS p_op, round(CASE WHEN p = 0 THEN 0.001 ELSE p / 1000 END, 3)::DOUBLE AS p, CASE WHEN round(r, 2) BETWEEN -1 AND 1 THEN round(r, 2) + 0.0 END AS r, CASE WHEN n > 0 THEN n::DOUBLE END AS n FROM {ROW}")
def flatten_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = stat_rows(spark, sf_dir)
    return r.select("l_orderkey", "l_linenumber", "f.t", "f.df", "f.p_op", F.round("f.p", 3).alias("p"), (F.col("f.r") + 0.0).alias("r"), "f.n")


@query("flatten_sentence", r"""WITH d AS (SELECT l_orderkey, l_linenumber, 'Item ' || l_linenumber AS label, l_partkey % 900 AS t, l_suppkey % 300 + 1 AS df, l_suppkey % 60 AS p, l_partkey % 250 - 120 AS r, l_quantity::INT AS n FROM lineitem),
    x AS (SELECT *, (t // 100)::VARCHAR || CASE WHEN t % 100 = 0 THEN '' WHEN t % 10 = 0 THEN '.' || (t % 100 // 10) ELSE '.' || lpad((t % 100)::VARCHAR, 2, '0') END AS ts,
               CASE WHEN p = 0 THEN 'p < .001' ELSE 'p = .' || rtrim(lpad(p::VARCHAR, 3, '0'), '0') END AS ps,
               CASE WHEN r BETWEEN -100 AND 100 THEN CASE WHEN r < 0 THEN '-' ELSE '' END || CASE WHEN abs(r) = 100 THEN '1' WHEN r = 0 THEN '0' WHEN abs(r) % 10 = 0 THEN '.' || (abs(r) // 10) ELSE '.' || lpad(abs(r)::VARCHAR, 2, '0') END END AS rs FROM d)
    SELECT l_orderkey, l_linenumber, label || ': ' || concat_ws(', ', CASE WHEN n > 0 THEN 'n = ' || n END, 't(' || df || ') = ' || ts, 'r = ' || rs, ps) AS sentence FROM x""")
def flatten_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stat_rows(spark, sf_dir).select("l_orderkey", "l_linenumber", flatten.sentence(F.col("label"), F.col("f")).alias("sentence"))


@query("flatten_arms", "SELECT l_orderkey, l_linenumber, u.k::INT AS arm, list_extract([l_quantity::INT::DOUBLE, l_suppkey::DOUBLE / 10, -(l_linenumber::DOUBLE)], u.k + 1) AS value FROM lineitem, (VALUES (0), (1), (2)) AS u(k)")
def flatten_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cell that packs three values, unpivoted."""
    cell = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" ("), (F.col("l_suppkey") / 10).cast("string"), F.lit("); -"), F.col("l_linenumber").cast("string"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.posexplode(flatten.arms(cell)).alias("arm", "value"))


@query("ci_upper_sign", """SELECT l_orderkey, l_linenumber, CASE WHEN est < 0 AND lo < 0 AND hi > 0 AND lo < -hi AND -hi > est AND abs((-hi - est) - (est - lo)) < 0.5 * (est - lo) THEN -hi ELSE hi END AS upper
    FROM (SELECT l_orderkey, l_linenumber, -(l_partkey % 20 + 1)::DOUBLE AS est, -(l_suppkey % 40 + 1)::DOUBLE AS lo, (l_linenumber * 2 - 6)::DOUBLE AS hi FROM lineitem)""")
def ci_upper_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    est, lo, hi = -(F.col("l_partkey") % 20 + 1).cast("double"), -(F.col("l_suppkey") % 40 + 1).cast("double"), (F.col("l_linenumber") * 2 - 6).cast("double")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", flatten.upper_with_sign(est, lo, hi).alias("upper"))
