"""Captions of tables and figures: where they stand, which mentions are only references, and their texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from vellum.functions.each import each

#: A line that starts with the label, its number, and either a stop or a capital.
NUMBERED = r"\s+([0-9]{1,3})(?:[.:]|\s*$|\s+[A-Z])"
LINE = {"table": rf"^\s*T(?:able|ABLE){NUMBERED}", "figure": rf"^\s*F(?:igure|IGURE|ig\.|IG\.){NUMBERED}"}
COMPILED = {k: re.compile(p) for k, p in LINE.items()}
STANZA = 800
ENDS = tuple(".!?")

CAPTION = StructType([StructField("kind", StringType()), StructField("number", IntegerType()), StructField("label", StringType()), StructField("page", IntegerType()), StructField("char_start", IntegerType()), StructField("char_end", IntegerType()), StructField("line_text", StringType()), StructField("is_reference", BooleanType()), StructField("caption", StringType())])


def is_reference(before: str, line: str) -> bool:
    """Whether a label at a line's start only goes on with the sentence of the line before."""
    tail = before.rstrip()
    if not tail:
        return False
    if tail[-1] in ",;(" or re.search(r"\b(?:in|see|and|of|from|to|by|the|with)$", tail):
        return True
    return tail[-1].islower() and bool(re.match(r"\s*\S+\s+\d+\s+(?:shows?|presents?|reports?|summari[sz]es|lists?|displays?|below|above)\b", line))


def caption_text(text: str, start: int, end: int, stop: int) -> str:
    """From the label on: to the next caption, a form feed, or a paragraph break after something that reads as done."""
    limit = min(len(text), end + STANZA, stop)
    body = text[start:limit]
    cut = body.find("\f")
    body = body[:cut] if cut >= 0 else body
    at = 0
    while (gap := re.compile(r"\n\s*\n").search(body, at)) is not None:
        tail = body[max(0, gap.start() - 40) : gap.start()].strip()
        if len(tail.split()) > 2 or tail[-1:] in ENDS and gap.start() > end - start:
            body = body[: gap.start()]
            break
        at = gap.end()
    body = re.sub(r"\s+", " ", body).strip()
    return body if len(body) <= 400 else body[: body.rfind(" ", 0, 401)] + "…"


def captions_of(text: str) -> list[dict]:
    out, at, before, page = [], 0, "", 1
    for line in text.split("\n"):
        clean = line.replace("\f", " ")
        for kind, pattern in COMPILED.items():
            if m := pattern.match(clean):
                lead = len(clean) - len(clean.lstrip())
                out.append({"kind": kind, "number": int(m[1]), "label": f"{kind.title()} {int(m[1])}", "page": page + line[:lead].count("\f"), "char_start": at + lead, "char_end": at + len(line), "line_text": clean.strip(), "is_reference": is_reference(before, clean)})
        page += line.count("\f")
        at += len(line) + 1
        before = clean
    for i, c in enumerate(out):
        c["caption"] = caption_text(text, c["char_start"], c["char_end"], out[i + 1]["char_start"] if i + 1 < len(out) else len(text))
    return out


def captions(text: Column) -> Column:
    """The captions of a text as an array of structs, in order; null stays null."""
    return each(captions_of, ArrayType(CAPTION))(text)


def caption_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(id_col, F.inline(captions(F.col(text_col))))


def one_of_each(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One caption for each kind and number of a document: the first that isn't a reference, else the first."""
    w = Window.partitionBy(id_col, "kind", "number").orderBy("is_reference", "char_start")
    return rows.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def next_boundary(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Each caption with the start of the next one in its document."""
    return rows.withColumn("next_start", F.lead("char_start").over(Window.partitionBy(id_col).orderBy("char_start")))


def placeholders(text: Column, found: Column) -> Column:
    """Each caption line replaced by ``[Label: line]``, right to left so that offsets hold."""
    return F.aggregate(F.reverse(F.array_sort(F.transform(found, lambda c: F.struct(c["char_start"].alias("s"), c["char_end"].alias("e"), c["label"].alias("l"), c["line_text"].alias("t"))))), text, lambda t, c: F.overlay(t, F.concat(F.lit("["), c["l"], F.lit(": "), c["t"], F.lit("]")), c["s"] + 1, c["e"] - c["s"]))


def join_split_captions(text: Column) -> Column:
    """A label torn from its number by a blank line is put together again."""
    text = F.regexp_replace(text, r"(?U)\bT\s*\n\s*\n\s*([0-9]+[.:])", "T$1")
    text = F.regexp_replace(text, r"(?U)\b(Fig\.|Figure|Table)\s*\n\s*\n?\s*([0-9]+[.:])", "$1 $2")
    return F.regexp_replace(text, r"(?U)\b(FIGURE|TABLE)\s*\n\s*\n?\s*([0-9]+)", "$1 $2")
