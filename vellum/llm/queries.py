"""The queries of this subpackage, with production parameters over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tokenizer file of ops 5 and 6, by name in the package of public tokenizers.
TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.forest import nearest

    points = table(spark, sf_dir, "embeddings")
    return nearest(points, points.where("vec_id % 20 = 0"), k=20)


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.esa import drop_repeats

    return drop_repeats(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.leaks import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.warc import archive_round_trip

    return archive_round_trip(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.records import token_files

    return token_files(spark, table(spark, sf_dir, "documents"), tokenizer_path())


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_de_bruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.debruijn import drop_repeats

    return drop_repeats(table(spark, sf_dir, "documents"))


def op8_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.sigtree import join

    return join(table(spark, sf_dir, "documents"), threshold=70).drop("class_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.crf import fit, tag
    from vellum.llm.langid import held_out

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out("doc_id", 5, 0)))
    return tag(docs.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "text"), model, spans=True).select("doc_id", "held_out", "score", "predicted", "spans")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.langid import fit, held_out, identify

    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out("doc_id", 4, 2)))
    found = identify(docs.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_prefix_forest": op1_prefix_forest,
    "op2_suffix_array": op2_suffix_array,
    "op3_decontaminate": op3_decontaminate,
    "op4_warc": op4_warc,
    "op5_token_records": op5_token_records,
    "op6_bpe": op6_bpe,
    "op7_de_bruijn": op7_de_bruijn,
    "op8_signature_trees": op8_signature_trees,
    "op9_toxicity": op9_toxicity,
    "op10_language": op10_language,
}

ORACLE_SQL: dict[str, str] = {
    "op2_suffix_array": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        s AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 400)) AS w
              FROM d, unnest(range(0, greatest(0, (length(x) // 2 - 199)::INT))) AS t(i)),
        r AS (SELECT w FROM s GROUP BY w HAVING count(*) > 1),
        h AS (SELECT doc_id, i FROM s SEMI JOIN r USING (w)),
        o AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM h),
        g AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM o),
        c AS (SELECT doc_id, n, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY doc_id, n),
        k AS (SELECT doc_id, a AS e, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS s FROM c
              UNION ALL SELECT d.doc_id, length(x) // 2, coalesce(max(b), 0) FROM d LEFT JOIN c ON d.doc_id = c.doc_id GROUP BY d.doc_id, x),
        t AS (SELECT k.doc_id, string_agg(substr(x, (2 * s + 1)::BIGINT, (2 * (e - s))::BIGINT), '' ORDER BY s) AS kept FROM k JOIN d ON k.doc_id = d.doc_id GROUP BY k.doc_id)
        SELECT d.doc_id, (length(x) // 2)::BIGINT AS n_bytes, ((length(x) - length(kept)) // 2)::BIGINT AS n_removed,
               (SELECT count(*) FROM c WHERE c.doc_id = d.doc_id)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256
        FROM d JOIN t ON d.doc_id = t.doc_id""",
    "op7_de_bruijn": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
        s AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 12], ' ')) AS w FROM d, unnest(range(1, greatest(1, len(ws) - 11))) AS t(i)),
        f AS (SELECT w, min(doc_id) AS first FROM s GROUP BY w),
        h AS (SELECT s.doc_id, i FROM s JOIN f ON s.w = f.w WHERE first < s.doc_id),
        gone AS (SELECT DISTINCT doc_id, i + j AS i FROM h, unnest(range(0, 13)) AS t(j)),
        w AS (SELECT doc_id, i, ws[i] AS word FROM d, unnest(range(1, len(ws) + 1)) AS t(i)),
        k AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS kept, count(*) AS n FROM w ANTI JOIN gone ON w.doc_id = gone.doc_id AND w.i = gone.i GROUP BY w.doc_id)
        SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN k ON d.doc_id = k.doc_id""",
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, strlen(h) AS n, sha256(h) AS s, min(page_id) OVER (PARTITION BY sha256(h)) AS f FROM p)
        SELECT page_id, n::BIGINT AS payload_bytes, s AS payload_digest,
               CASE WHEN n >= 100 AND page_id > f THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id > f THEN f END AS refers_to
        FROM d""",
    "op8_signature_trees": r"""
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g FROM d, unnest(range(1, greatest(1, len(ws) - 1))) AS t(i)
              UNION SELECT doc_id, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND 2),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM o JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 70 * (nx.n + ny.n - c)),
        e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r(node, low) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.low FROM r JOIN e ON e.x = r.node WHERE r.low < e.y)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT count(*) FROM e WHERE e.x = d.doc_id)::BIGINT AS n_similar, c.component_id
        FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT node, min(low) AS component_id FROM r GROUP BY node) c ON c.node = d.doc_id""",
}
