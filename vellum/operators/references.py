"""Reference lists: where they stand, entries that page layout tore apart, page numbers inside sentences."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from vellum.functions.each import each
from vellum.operators.lines import page_number_set, text_udf
from vellum.operators.sections import BACK, label_of

SPAN = StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])
ENTRY = re.compile(r"^\s*(?:\[[0-9]{1,3}\]|[0-9]{1,3}[.]\s+[A-Z]|[A-Z][\w'’-]+,\s+(?:[A-Z]\.\s*)+)")
NUMBER = re.compile(r"^\s*([0-9]{1,3})[.]\s*$")
AHEAD = 5000
NOUNS = re.compile(r"\s*\S*\s*(?:participants?|trials?|items?|years?|months?|days?|students?|patients?|percent|studies|people|women|men|children)\b")
QUANTIFIERS = {"than", "of", "about", "only", "all", "the", "least", "most", "over", "under", "nearly", "approximately", "these", "other"}


def spans_of(text: str) -> list[dict]:
    """From a references heading that three entries follow within 5,000 characters, to the next back-matter heading."""
    out, at, lines, start = [], 0, text.split("\n"), None
    for l in lines:
        label = label_of(l) if 0 < len(l.strip()) <= 60 else None
        if start is not None and label and label in BACK - {"references"}:
            out.append({"start": start, "end": at})
            start = None
        elif start is None and label == "references":
            following = text[at + len(l) + 1 : at + len(l) + 1 + AHEAD].split("\n")
            if sum(bool(ENTRY.match(x)) for x in following) >= 3:
                start = at + len(l) + 1
        at += len(l) + 1
    if start is not None:
        out.append({"start": min(start, len(text)), "end": len(text)})
    return out


def pair_columns(lines: list[str]) -> list[str]:
    """Three bare numbers or more that stand before as many entries are put before them, in order."""
    i = 0
    while i < len(lines):
        j = i
        while j < len(lines) and NUMBER.match(lines[j]):
            j += 1
        n = j - i
        if n >= 3:
            rest = [k for k in range(j, len(lines)) if re.match(r"\s*[A-Z][\w'’-]+,? ", lines[k])][:n]
            if len(rest) == n and rest[-1] - j < 6 * n:
                for number, k in zip(lines[i:j], rest):
                    lines[k] = f"{number.strip()} {lines[k].strip()}"
                del lines[i:j]
                i = rest[-1] - n
        i = max(i + 1, j)
    return lines


def stitch(block: str) -> str:
    """Continuation lines join their entry, across a blank line only while the entry has no end mark."""
    out: list[str] = []
    blank = False
    for l in pair_columns(block.replace("\f", "\n").split("\n")):
        s = l.strip()
        if not s:
            blank = True
            continue
        if out and not ENTRY.match(l) and (not blank or out[-1][-1] not in ".?!"):
            out[-1] = (out[-1][:-1] if out[-1].endswith("-") and s[0].islower() else out[-1] + " ") + s
        else:
            out.append(s)
        blank = False
    return "\n".join(out)


def drop_page_numbers(text: str, numbers: set[str]) -> str:
    """A known page number between two lower-case words goes, unless it counts what follows or a quantifier stands before."""

    def fix(m: re.Match) -> str:
        keep = m[2] not in numbers or m[1] in QUANTIFIERS or NOUNS.match(text, m.end(2), m.end(2) + 60)
        return m[0] if keep else f"{m[1]} "

    return re.sub(r"\b([a-z]+)\s+(\d{1,3})\s+(?=[a-z])", fix, text)


def repair_text(text: str, numbers: set[str] | None = None) -> str:
    """Entries of each reference list put together, and page ``numbers`` dropped from them: by default those that stand alone on two lines or more."""
    if numbers is None:
        numbers = page_number_set(text)
    out, last = [], 0
    for s in spans_of(text):
        out += [text[last : s["start"]], "\n" + stitch(drop_page_numbers(text[s["start"] : s["end"]], numbers)) + "\n"]
        last = s["end"]
    return "".join(out) + text[last:]


repair = text_udf(repair_text)


def spans(text: Column) -> Column:
    """Code-point spans of the reference lists of a text."""
    return each(spans_of, ArrayType(SPAN))(text)
