"""Headings that markup names: HTML by its tags, Word documents by their paragraph styles. One Arrow pass."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from vellum.functions.html import AMPERSAND, HIDDEN, VOID, guarded
from vellum.operators.sections import HINT, SECTION, Hint, label_of, partition

BLOCKS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "div", "section", "article", "blockquote", "pre"}
CONTAINERS = BLOCKS | {"ul", "ol", "dl", "dt", "table", "tbody", "thead", "tfoot", "tr", "th", "td", "caption"}
ANNOTATED = StructType([StructField("text", StringType()), StructField("hints", ArrayType(HINT))])


class Blocks(HTMLParser):
    """``(tag, text)`` of each block: its own strings and those of inline elements, not those of blocks inside it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, list[str]]] = []
        self.open: list[tuple[str, list[str] | None]] = [("body", None)]
        self.hidden: list[str] = []

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in HIDDEN and tag != "head":
            self.hidden.append(tag)
        if self.hidden or tag in VOID:
            return
        if tag in BLOCKS:
            if tag == "p" and self.open[-1][0] == "p" or tag == "li" and self.open[-1][0] == "li":
                self.open.pop()  # these end where the next begins
            self.blocks.append((tag, []))
            self.open.append((tag, self.blocks[-1][1]))
        elif tag in CONTAINERS:
            self.open.append((tag, None))
        elif self.open[-1][1] is not None:
            self.open.append((tag, self.open[-1][1]))

    def handle_endtag(self, tag: str) -> None:
        if self.hidden:
            if tag == self.hidden[-1]:
                self.hidden.pop()
            return
        tags = [t for t, _ in self.open]
        if tag in tags[1:]:
            del self.open[len(tags) - 1 - tags[::-1].index(tag) :]

    def handle_data(self, data: str) -> None:
        if not self.hidden and self.open[-1][1] is not None and data.strip():
            self.open[-1][1].append(" ".join(data.split()))


def annotate(blocks: list[tuple[str, str]]) -> tuple[str, list[Hint]]:
    """The blocks, blank lines between, and a hint for each heading: h1 to h3 strong, h4 to h6 weak."""
    text, hints = "", []
    for tag, t in blocks:
        if not t:
            continue
        start = len(text) + 2 * bool(text)
        text += "\n\n" * bool(text) + t
        if re.fullmatch("h[1-6]", tag):
            hints.append(Hint(t, start, len(text), "strong" if tag < "h4" else "weak", "markup", label_of(t)))
    return text, hints


def html_blocks(page: str) -> list[tuple[str, str]]:
    parser = Blocks()
    parser.feed(guarded(page))
    parser.close()
    return [(tag, " ".join(parts).replace(AMPERSAND, "&")) for tag, parts in parser.blocks]


def docx_blocks(content: bytes) -> list[tuple[str, str]]:
    """Paragraphs of a Word document; the styles ``Heading 1`` to ``Heading 6`` are headings."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    out = []
    for p in root.iter(f"{w}p"):
        style = p.find(f"{w}pPr/{w}pStyle")
        level = re.fullmatch(r"(?i)heading\s?([1-6])", style.get(f"{w}val", "")) if style is not None else None
        out.append((f"h{level[1]}" if level else "p", " ".join("".join(t.text or "" for t in p.iter(f"{w}t")).split())))
    return out


def marked_sections(text: str, hints: list[Hint]) -> list[dict]:
    """Sections by the headings of markup; those without a canonical label are subheadings."""
    return partition(text, hints)


def annotated(source: Column, blocks: Callable[[str | bytes], list[tuple[str, str]]] = html_blocks) -> Column:
    """``struct(text, hints)`` of HTML text or, with ``docx_blocks``, of Word bytes; null and unreadable ones are null."""

    @F.pandas_udf(ANNOTATED)
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for x in s:
            try:
                text, hints = annotate(blocks(x)) if x is not None else (None, None)
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                text, hints = None, None
            rows.append((text, None if hints is None else [{"text": h.text, "char_start": h.start, "char_end": h.end, "strength": h.strength, "source": h.source, "label": h.label} for h in hints]))
        return pd.DataFrame(rows, columns=["text", "hints"])

    return run(source)


def sections_of(source: Column, blocks: Callable[[str | bytes], list[tuple[str, str]]] = html_blocks) -> Column:
    """The sections of HTML text, or of Word bytes, by their own headings."""

    @F.pandas_udf(ArrayType(SECTION))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: marked_sections(*annotate(blocks(x))), na_action="ignore")

    return run(source)
