"""Sources: files as rows of bytes, format detection, page counts, decoders.

Corpora come as Parquet, JSON, text or ``binaryFile`` tables. HTML and DOCX decode with the standard library;
PDF decoding needs an outside engine and is a plug-in: a function from bytes to ``(text, method)``.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from vellum.functions.html import html_to_text

DECODED = StructType([StructField("text", StringType()), StructField("method", StringType()), StructField("error", StringType())])


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``(path, modificationTime, length, content)`` of each file; a path without files gives no row."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def detect_format(content: Column) -> Column:
    """``pdf``, ``docx`` or ``html`` by the first 64 bytes, else null."""
    head = F.decode(F.substring(content, 1, 64), "ISO-8859-1")
    return F.when(head.startswith("%PDF-"), "pdf").when(head.startswith("PK"), "docx").when(F.lower(head).rlike(r"<!doctype\s+html|<html"), "html")


def checked(content: Column, cap: int | None) -> Column:
    """The bytes; raises where they exceed ``cap``."""
    if cap is None:
        return content
    return F.when(F.octet_length(content) > cap, F.raise_error(F.lit(f"input exceeds {cap} bytes"))).otherwise(content)


def pdf_pages(content: Column) -> Column:
    """Page objects of a PDF that is stored without compressed objects; 1 at least."""
    raw = F.decode(content, "ISO-8859-1")
    return F.greatest(F.lit(1), F.regexp_count(raw, F.lit(r"/Type\s*/Page(?![s\w])")))


def text_pages(text: Column) -> Column:
    """Pages of a decoded text: form feeds stand between them."""
    return F.regexp_count(text, F.lit("\f")) + 1


def decode_html(content: Column, cap: int | None = None) -> Column:
    """Text of HTML bytes; bytes that aren't UTF-8 become U+FFFD."""
    return html_to_text(F.make_valid_utf8(checked(content, cap).cast("string")))


def docx_text(content: bytes) -> str:
    """Paragraphs of a Word document, one a line; equations are left out."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    shown = {f"{w}t": lambda e: e.text or "", f"{w}tab": lambda e: "\t", f"{w}br": lambda e: "\n"}
    return "\n".join("".join(shown[e.tag](e) for e in p.iter() if e.tag in shown) for p in root.iter(f"{w}p")).strip()


def decode_docx(content: Column) -> Column:
    """``struct(text, method, error)`` of Word bytes; a damaged file is an error in its row, never a failure of the job."""

    @F.pandas_udf(DECODED)
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for b in s:
            try:
                rows.append((docx_text(b), "docx", None))
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, TypeError) as e:
                rows.append((None, "docx", f"{type(e).__name__}: {e}"[:200]))
        return pd.DataFrame(rows, columns=["text", "method", "error"])

    return run(content)


def decode_pdf(content: Column, engine: Callable[[bytes], tuple[str, str]]) -> Column:
    """The same of PDF bytes by an outside engine."""

    @F.pandas_udf(DECODED)
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for b in s:
            try:
                rows.append((*engine(b), None))
            except Exception as e:  # an engine's failure is that file's result
                rows.append((None, "pdf", f"{type(e).__name__}: {e}"[:200]))
        return pd.DataFrame(rows, columns=["text", "method", "error"])

    return run(content)
