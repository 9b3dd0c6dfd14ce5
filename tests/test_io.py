"""Sources, sinks, streams and the driver's entry."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from vellum.sources import formats, sinks
from vellum.streaming import quality_stream


def docx(*paragraphs: str) -> bytes:
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_files_and_decoders(spark, tmp_path):
    (tmp_path / "a.html").write_bytes(b"<html><p>Hi</p>\xff</html>")
    (tmp_path / "b.docx").write_bytes(docx("One", "Two"))
    (tmp_path / "c.docx").write_bytes(b"PK broken")
    f = formats.files(spark, str(tmp_path)).withColumn("format", formats.detect_format(F.col("content")))
    assert {r.format for r in f.collect()} == {"html", "docx"}
    assert f.where("format = 'html'").select(formats.decode_html(F.col("content"))).first()[0].startswith("Hi")
    got = {r.p[-6:]: r.d for r in f.where("format = 'docx'").select(F.col("path").alias("p"), formats.decode_docx(F.col("content")).alias("d")).collect()}
    assert got["b.docx"].text == "One\nTwo" and got["c.docx"].error and got["c.docx"].text is None


def test_pdf_plug_in_and_cap(spark):
    def engine(b: bytes):
        if b == b"bad":
            raise ValueError("bad file")
        return b.decode(), "test"

    d = spark.createDataFrame([(bytearray(b"%PDF"),), (bytearray(b"bad"),)], "content binary")
    got = [r.d for r in d.select(formats.decode_pdf(F.col("content"), engine).alias("d")).collect()]
    assert got[0].text == "%PDF" and "bad file" in got[1].error
    try:
        d.select(F.length(formats.checked(F.col("content"), 3))).collect()
        raise AssertionError("the cap didn't hold")
    except Exception as e:
        assert "exceeds" in str(e)


def test_extract_to_dir(spark, tmp_path):
    d = spark.createDataFrame([(1, "the ﬁne one"), (2, None)], "doc_id long, text string")
    r = sinks.extract_to_dir(d, str(tmp_path / "out"), level="standard").first()
    assert (r.n_total, r.n_ok, r.n_failed) == (2, 1, 1)
    assert spark.read.json(str(tmp_path / "out/texts")).where("doc_id = 1").first().text == "the fine one"


def test_stream(spark, tmp_path):
    d = spark.createDataFrame([(1, "the and for"), (2, "zz")], "doc_id long, text string")
    d.write.parquet(str(tmp_path / "in"))
    out = quality_stream.drain(quality_stream.scored(quality_stream.documents(spark, str(tmp_path / "in"), d.schema)), "t")
    assert {(r.doc_id, r.garbled) for r in out.collect()} == {(1, False), (2, True)}


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1


def test_sql_functions(spark):
    from vellum.functions.register import register

    assert "sections" in register(spark)
    d = spark.createDataFrame([("Abstract\n\nx\n\nMethods\n\ny",), (None,)], "t string")
    d.createOrReplaceTempView("texts")
    assert [r[0] for r in spark.sql("SELECT size(sections(t)) AS n FROM texts WHERE t IS NOT NULL").collect()] == [2]


def test_cli(spark, tmp_path):
    from vellum.cli import main

    spark.createDataFrame([(1, "Abstract\n\nThe ﬁrst.\n\nMethods\n\nWe do.")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    main(["render", str(tmp_path / "in"), str(tmp_path / "out")])
    assert "## Methods" in spark.read.parquet(str(tmp_path / "out")).first().markdown
