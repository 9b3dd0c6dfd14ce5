"""A training corpus from raw documents, in five stages; each works on all that its predecessor kept.

language      language ID; documents without a letter, or of no language with probability ``CERTAIN``, go
near copies   n-gram Jaccard join; one document of each group of linked ones stays
repeats       suffix-array dedup; strings of 200 bytes that occur elsewhere are cut out of every text
benchmark     decontamination; documents that hold a benchmark item go
tokens        speculative BPE; ids and their decoding, as digests

All but the last return the columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import bpe, esa, langid, leaks, sigtree
from vellum.llm.queries import table, tokenizer_path
from vellum.llm.shared import stage

#: Documents whose best language is less probable than this are rejected.
CERTAIN = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language can't be told; null and empty texts are among them."""
    model = langid.fit(docs.where(~langid.held_out("doc_id", 4, 2)))
    told = langid.identify(docs.select(F.struct("*").alias("row"), "text"), model)  # the row's own columns may have any name
    return told.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") >= CERTAIN)).select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest id of each group of linked documents."""
    return sigtree.one_of_each(docs, threshold=70)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated strings out of the texts; every document stays."""
    return esa.without_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return leaks.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text and their decoding: ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``."""
    return bpe.round_trip(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near copies", near_copies),
    ("repeats", repeats),
    ("benchmark", benchmark),
    ("tokens", tokens),
]

#: SQL has no trained classifier and no banded alignment; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
