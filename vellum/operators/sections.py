"""Sections of a document: heading hints, their labels, and spans that cover the whole text.

Headings are found by one Arrow pass over each text, so a document's lines stay in its row; the spans come out as an
array that is inlined to rows. Offsets are code points.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from vellum.functions.each import each

#: Canonical labels and the heading texts, lower case, that mean them.
VARIANTS: dict[str, tuple[str, ...]] = {
    "abstract": ("abstract",),
    "keywords": ("keyword", "keywords", "key words"),
    "author_note": ("author note", "authors note", "author's note", "authors' note", "orcid ids"),
    "introduction": ("introduction", "background", "introduction and background"),
    "literature_review": ("literature review", "review of literature", "related work", "theory", "theoretical background"),
    "methods": ("method", "methods", "methodology", "materials and methods", "materials & methods", "experimental procedures", "experiment", "experiments"),
    "results": ("results", "results and discussion", "findings", "empirical results", "experimental results", "evaluation", "experimental evaluation", "performance evaluation"),
    "discussion": ("discussion", "discussion and conclusion", "discussion and conclusions"),
    "general_discussion": ("general discussion", "overall discussion"),
    "conclusion": ("conclusion", "conclusions", "conclusion and future work", "conclusions and future work", "concluding remarks"),
    "acknowledgments": ("acknowledgement", "acknowledgements", "acknowledgment", "acknowledgments"),
    "funding": ("funding", "funding information", "funding statement", "financial support", "grants", "financial disclosure", "financial disclosure/funding", "funding/financial disclosure"),
    "conflict_of_interest": ("conflict of interest", "conflicts of interest", "competing interest", "competing interests", "competing financial interests", "declarations", "disclosure", "disclosures", *(f"declaration of {kind}interest{s}" for kind in ("", "competing ", "conflicting ") for s in ("", "s"))),
    "data_availability": ("data availability", "data availability statement", "availability of data", "data and materials availability", "code availability", "data and code availability"),
    "author_contributions": ("author contribution", "author contributions", "contributions", "credit author statement", "credit authorship statement", "authorship declaration", "authorship statement"),
    "references": ("references", "reference list", "list of references", "cited references", "bibliography", "works cited", "literature", "literature cited", "cited literature"),
    "appendix": ("appendix", "appendices", "appendix a", "appendix b", "appendix c", "appendix d"),
    "supplementary": ("supplementary", "supplementary information", "supplementary material", "supplementary materials", "supplemental material", "supplemental materials", "supporting information", "online supplement", "online supplementary material"),
}
LABEL = {v: label for label, vs in VARIANTS.items() for v in vs}
BACK = set("references appendix supplementary acknowledgments funding conflict_of_interest data_availability author_contributions footnotes".split())
BODY = set("methods results discussion introduction literature_review".split())
UNKNOWN = "unknown"
NUMBERING = re.compile(r"^\s*(?:[0-9]+(?:[.][0-9]+)*[.]?|[ivxIVX]+[.]?|[A-Za-z][.])\s+")
NEAR = 100
BREAK = re.compile("(\n\\s*\n)")

SECTION = StructType([StructField("ord", IntegerType()), StructField("label", StringType()), StructField("canonical_label", StringType()), StructField("char_start", IntegerType()), StructField("char_end", IntegerType()), StructField("confidence", StringType()), StructField("detected_via", StringType()), StructField("heading_text", StringType()), StructField("subheadings", ArrayType(StringType()))])
HINT = StructType([StructField("text", StringType()), StructField("char_start", IntegerType()), StructField("char_end", IntegerType()), StructField("strength", StringType()), StructField("source", StringType()), StructField("label", StringType())])


@dataclass
class Hint:
    text: str
    start: int
    end: int
    strength: str
    source: str
    label: str | None


def label_of(heading: str) -> str | None:
    """The canonical label of a heading; numbering, final punctuation, case and runs of white space aside."""
    return LABEL.get(" ".join(re.sub(r"[\s:.\-–—]+$", "", NUMBERING.sub("", heading.strip())).lower().split()))


def hints(text: str) -> list[Hint]:
    """Heading candidates: canonical ones that start capitalized on an isolated line, and other short title-like lines."""
    ls = text.split("\n")
    out, at = [], 0
    for i, line in enumerate(ls):
        s = line.strip()
        if s and len(s) <= 80:
            before = not ls[i - 1].strip() if i else True
            after = not ls[i + 1].strip() if i + 1 < len(ls) else True
            label = label_of(s)
            bare = NUMBERING.sub("", s)
            start = at + line.index(s)
            if label and bare[:1].isupper() and before and (after or ls[i + 1].strip()[:1].isupper()):
                out.append(Hint(s, start, start + len(s), "strong", "text_pattern", label))
            elif before and after and bare[:1].isupper() and len(s.split()) <= 8 and s[-1] not in ".,;:?!" and not any(c.isdigit() for c in bare) and i:
                out.append(Hint(s, start, start + len(s), "weak", "text_pattern", None))
        at += len(line) + 1
    return out


def partition(text: str, found: list[Hint]) -> list[dict]:
    """Sections that cover the text from end to end; what stands before the first heading is ``unknown``.

    A heading that repeats its label within 100 characters of the last kept one is dropped; repeated labels get the
    suffixes _2, _3 and so on. Unlabelled headings become subheadings of the section they stand in.
    """
    marks: list[Hint] = []
    for h in sorted((h for h in found if h.label), key=lambda h: h.start):
        if marks and marks[-1].label == h.label and h.start - marks[-1].start < NEAR:
            continue
        marks.append(h)
    spans = [(None, 0)] * (not marks or marks[0].start > 0) + [(m, m.start) for m in marks]
    seen: Counter[str] = Counter()
    out = []
    for i, (mark, start) in enumerate(spans):
        end = spans[i + 1][1] if i + 1 < len(spans) else len(text)
        label = mark.label if mark else UNKNOWN
        seen[label] += 1
        shown = f"{label}_{seen[label]}" if seen[label] > 1 and mark else label
        subs = [h.text for h in found if not h.label and start <= h.start < end]
        out.append({"ord": i, "label": shown, "canonical_label": label, "char_start": start, "char_end": end, "confidence": "high" if mark else "low", "detected_via": "heading" if mark else "none", "heading_text": mark.text if mark else None, "subheadings": subs})
    return out


def relabel(sections: list[dict], i: int, cut: int, label: str) -> list[dict]:
    """``sections`` with the part of section i from ``cut`` on split off as ``label``."""
    s = sections[i]
    new = s | {"label": label, "canonical_label": label, "char_start": cut, "confidence": "medium", "detected_via": "synthesized", "heading_text": None, "subheadings": []}
    out = sections[:i] + [s | {"char_end": cut}] * (cut > s["char_start"]) + [new] + sections[i + 1 :]
    return [x | {"ord": j} for j, x in enumerate(out)]


def first_of(sections: list[dict], labels: set[str], otherwise: int) -> int:
    return min((x["ord"] for x in sections if x["canonical_label"] in labels), default=otherwise)


def synthesize(text: str, sections: list[dict]) -> list[dict]:
    """An abstract split off a long unlabelled front, and an introduction off a long abstract or keywords section."""
    labels = {s["canonical_label"] for s in sections}
    first = sections[0]
    if first["canonical_label"] == UNKNOWN and first["char_end"] - first["char_start"] >= 1500 and labels & BODY and "abstract" not in labels:
        at = 0
        for p in re.split(BREAK, text[: first["char_end"]]):
            if len(p.strip()) >= 600:
                sections = relabel(sections, 0, at, "abstract")
                break
            at += len(p)
    labels = {s["canonical_label"] for s in sections}
    if "introduction" not in labels:
        stop = first_of(sections, BODY, first_of(sections, BACK, len(sections)))
        if stop and sections[stop - 1]["canonical_label"] in ("abstract", "keywords"):
            s = sections[stop - 1]
            size = s["char_end"] - s["char_start"]
            if size >= 3000 and size >= 0.05 * len(text):
                least = 0 if s["canonical_label"] == "keywords" else 800
                cut = text.find("\n\n", s["char_start"] + max(least, len(s["heading_text"] or "") + 2), s["char_end"])
                if cut >= 0:
                    sections = relabel(sections, stop - 1, cut + 2, "introduction")
    return sections


def sections_of(text: str) -> list[dict]:
    return synthesize(text, partition(text, hints(text)))


def sections(text: Column) -> Column:
    """The sections of a text as an array of structs; null stays null."""
    return each(sections_of, ArrayType(SECTION))(text)


def heading_hints(text: Column) -> Column:
    return each(lambda t: [{"text": h.text, "char_start": h.start, "char_end": h.end, "strength": h.strength, "source": h.source, "label": h.label} for h in hints(t)], ArrayType(HINT))(text)


def section_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each section."""
    return docs.select(id_col, F.inline(sections(F.col(text_col))))


def text_for(text: Column, found: Column, *labels: str) -> Column:
    """The texts of the sections with the given labels, in document order, joined by a blank line."""
    mine = F.filter(found, lambda s: s["canonical_label"].isin(*labels))
    return F.array_join(F.transform(F.array_sort(mine), lambda s: F.substring(text, s["char_start"] + 1, s["char_end"] - s["char_start"])), "\n\n")


def page_of(offset: Column, page_starts: Column) -> Column:
    """The page on which an offset lies (as-of backward join on the starts of the pages), 1 at least."""
    return F.greatest(F.lit(1), F.size(F.filter(page_starts, lambda s: s <= offset)))


def page_starts(text: Column) -> Column:
    """Offsets at which the pages of a text start; form feeds end pages."""
    return F.slice(F.transform(F.split(text, "\f"), lambda p, i: F.aggregate(F.slice(F.split(text, "\f"), 1, i), F.lit(0), lambda n, q: n + F.length(q) + 1)), 1, F.size(F.split(text, "\f")))


def pages_of(start: Column, end: Column, starts: Column, size: Column) -> Column:
    """Pages that a span overlaps."""
    n = F.size(starts)
    return F.filter(F.sequence(F.lit(1), n), lambda p: (start < F.coalesce(F.get(starts, p), size)) & (end > F.get(starts, p - 1)))


BOUNDARIES = (r"^[A-Z][\w.]+ [A-Z][\w.]+ is (?:an? |the )?(?:assistant|associate|full|adjunct)? ?[Pp]rofessor\b.*", r"^(?:Address c|C)orrespondence (?:to|concerning)\b.*", r"^E-?mail:.*", r"^(?:Table|Figure|Fig\.) \d+[.:].*", r"^About the [Aa]uthors?$", r"^ORCID\b.*")


def is_boundary(line: Column) -> Column:
    """Author biographies, contacts and captions end a section."""
    return F.trim(line).rlike("|".join(f"(?:{p})" for p in BOUNDARIES))
