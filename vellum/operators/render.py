"""Markdown: sections, captions and tables put together, then ordered passes over the rendered text.

Every pass is a linear fold over lines. ``finish`` runs all of them fused in one Arrow pass.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.operators import repairs
from vellum.operators.captions import COMPILED
from vellum.operators.lines import text_udf
from vellum.operators.sections import LABEL

HEADING = re.compile(r"^(#{1,6})\s+(.*\S)\s*$")
GENERIC = {"note", "notes", "table", "figure", "model", "variable", "variables", "total", "mean", "range", "source", "continued"}
ROLES = re.compile(r"^(?:conceptuali[sz]ation|data curation|formal analysis|funding acquisition|investigation|methodology|project administration|resources|software|supervision|validation|visuali[sz]ation|writing ?[-–].*)\b", re.I)
METADATA = re.compile(r"^(?:received|accepted|published|doi|issn|keywords?|e-?mail|correspondence|copyright|license|orcid|editor|citation)\b", re.I)
BADGES = ("Open Data", "Open Materials", "Preregistered", "Open Access")


def label(name: str) -> str:
    return name.replace("_", " ").capitalize()


def markdown(title: Column, sections: Column, text: Column) -> Column:
    """``# title``, then a heading and the body of each section; a section's own heading line isn't repeated."""
    body = F.transform(
        F.array_sort(sections),
        lambda s: F.concat(
            F.when(s["canonical_label"] == "unknown", "").otherwise(F.concat(F.lit("## "), F.initcap(F.replace(s["label"], F.lit("_"), F.lit(" "))), F.lit("\n\n"))),
            F.trim(F.when(s["heading_text"].isNotNull(), F.substring(text, s["char_start"] + 1 + F.length(s["heading_text"]), s["char_end"] - s["char_start"] - F.length(s["heading_text"]))).otherwise(F.substring(text, s["char_start"] + 1, s["char_end"] - s["char_start"]))),
        ),
    )
    return F.concat(F.lit("# "), title, F.lit("\n\n"), F.array_join(body, "\n\n"))


def lines(f):
    """A pass from a function of the lines."""

    def run(text: str) -> str:
        return "\n".join(f(text.split("\n")))

    run.__doc__ = f.__doc__
    run.__name__ = f.__name__
    return run


def fenced(ls: list[str]) -> list[bool]:
    out, inside = [], False
    for l in ls:
        mark = l.startswith("```")
        out.append(inside or mark)
        inside ^= mark
    return out


def near(ls: list[str], i: int, step: int) -> str:
    j = i + step
    while 0 <= j < len(ls):
        if ls[j].strip():
            return ls[j].strip()
        j += step
    return ""


@lines
def repeated_headings(ls):
    """A second ``##`` heading of the same words is blanked."""
    seen, out = set(), []
    for l in ls:
        if l.startswith("## "):
            out.append("" if l in seen else l)
            seen.add(l)
        else:
            out.append(l)
    return out


@lines
def multiline_captions(ls):
    """A caption goes on over its line break until it ends."""
    out = []
    for l in ls:
        if out and any(p.match(out[-1].strip("*")) for p in COMPILED.values()) and out[-1][-1] not in ".!?*" and l[:1].islower():
            out[-1] += " " + l.strip()
        else:
            out.append(l)
    return out


@lines
def orphan_cells(ls):
    """Four short lines or more of bare numbers, which a table leaves behind, go."""
    out, run = [], []
    bare = re.compile(r"^\s*[-−+<>=.,()%*\d\s]{1,20}$")
    for l, fence in zip([*ls, "end"], [*fenced(ls), False]):
        if not fence and l.strip() and bare.match(l):
            run.append(l)
            continue
        out += run if len(run) < 4 else []
        run = []
        out.append(l)
    return out[:-1]


@lines
def footnotes(ls):
    """Lines that start with a superscript mark become quotes."""
    return [f"> {l}" if re.match(r"^[¹²³⁴-⁹†‡]\s?[A-Z]", l) else l for l in ls]


@lines
def study_headings(ls):
    """``Study 1`` and short lines of capitals that stand alone become headings."""
    out = []
    for i, l in enumerate(ls):
        s = l.strip()
        alone = (not i or not ls[i - 1].strip()) and (i + 1 == len(ls) or not ls[i + 1].strip())
        if alone and re.fullmatch(r"(?:Study|Experiment) \d+[a-z]?(?:[:.] .{1,60})?", s):
            out.append(f"## {s}")
        elif alone and 4 <= len(s) <= 60 and s.isupper() and len(s.split()) <= 6 and s.replace(" ", "").isalpha():
            out.append(f"### {s.title()}")
        else:
            out.append(l)
    return out


@lines
def false_headings(ls):
    """Headings that are generic words, roles of contributors, metadata, run on in lower case, or hold table cells, are text."""
    out = []
    for i, l in enumerate(ls):
        m = HEADING.match(l)
        if m and len(m[1]) > 1:
            s = m[2]
            follows = near(ls, i, 1)
            known = s.lower() in LABEL
            if not known and (s.lower() in GENERIC or ROLES.match(s) or METADATA.match(s) or s.endswith(",") or re.search(r"[|\t]|\d\s+\d+\.\d", s) or (len(s.split()) == 1 and follows[:1].islower())):
                l = s
        out.append(l)
    return out


@lines
def parallel_prefixes(ls):
    """Three headings or more that start with the same two words within ten lines are items of a list, not headings."""
    heads = [(i, " ".join(m[2].split()[:2])) for i, l in enumerate(ls) if (m := HEADING.match(l)) and len(m[2].split()) > 2]
    drop = {i for k in range(len(heads) - 2) if heads[k][1] == heads[k + 1][1] == heads[k + 2][1] and heads[k + 2][0] - heads[k][0] <= 10 for i in (heads[k][0], heads[k + 1][0], heads[k + 2][0])}
    return [HEADING.match(l)[2] if i in drop else l for i, l in enumerate(ls)]


@lines
def method_headings(ls):
    """Subsections of a method that stand alone become ``###``."""
    subs = {"participants", "measures", "procedure", "materials", "design", "data analysis", "statistical analysis", "sample", "apparatus", "stimuli"}
    return [f"### {l.strip()}" if l.strip().lower() in subs and l[:1].isupper() and (not i or not ls[i - 1].strip()) else l for i, l in enumerate(ls)]


@lines
def wrapped_headings(ls):
    """A heading that ends in a function word takes the short line after it."""
    out, skip = [], False
    for i, l in enumerate(ls):
        if skip:
            skip = False
            continue
        m = HEADING.match(l)
        if m and re.search(r"\b(?:of|and|the|in|on|for|to|with|a|an|by)$", m[2]) and i + 1 < len(ls) and ls[i + 1].strip() and len(ls[i + 1].split()) <= 6:
            out.append(f"{l.rstrip()} {ls[i + 1].strip()}")
            skip = True
        else:
            out.append(l)
    return out


@lines
def title_case_headings(ls):
    """Short title-case lines alone between paragraphs become ``###``."""
    small = {"of", "and", "the", "in", "on", "for", "to", "with", "a", "an", "by", "or"}
    out = []
    for i, (l, fence) in enumerate(zip(ls, fenced(ls))):
        s, w = l.strip(), l.split()
        alone = (i and not ls[i - 1].strip()) and (i + 1 < len(ls) and not ls[i + 1].strip())
        title = 2 <= len(w) <= 8 and all(x[0].isupper() or x in small for x in w) and s[-1:].isalpha() and s.replace(" ", "").replace("-", "").isalpha()
        out.append(f"### {s}" if alone and title and not fence and len(near(ls, i, 1)) > 60 else l)
    return out


@lines
def inline_labels(ls):
    """Headings of abstract parts inside the abstract are bold labels: those that only abstracts have, and those that come again."""
    heads = {m[2].lower() for l in ls if (m := HEADING.match(l))}
    out, zone = [], False
    for l in ls:
        m = HEADING.match(l)
        if m and m[1] == "##":
            s = m[2].lower()
            zone = s == "abstract" or (zone and (s in ("background", "objective", "aims") or f"{s} 2" in heads))
            if zone and s != "abstract":
                l = f"**{m[2]}**"
        out.append(l)
    return out


@lines
def phantom_tables(ls):
    """Markdown tables without a filled cell go."""
    out, run = [], []
    for l in [*ls, ""]:
        if l.startswith("|"):
            run.append(l)
            continue
        out += run if any(c.strip() and not re.fullmatch(r"[-: ]+", c) for r in run for c in r.strip("|").split("|")) else []
        run = []
        out.append(l)
    return out[:-1]


@lines
def repeated_captions(ls):
    """A caption line that is there already goes."""
    seen, out = set(), []
    for l in ls:
        s = l.strip("*_ ")
        if any(p.match(s) for p in COMPILED.values()) and len(s) > 12:
            if s in seen:
                continue
            seen.add(s)
        out.append(l)
    return out


@lines
def fence_headings(ls):
    """Headings inside fences are text."""
    return [l.lstrip("# ") if fence and HEADING.match(l) else l for l, fence in zip(ls, fenced(ls))]


@lines
def key_points(ls):
    """A box of key points becomes a quote."""
    out, inside = [], False
    for l in ls:
        if re.fullmatch(r"(?:#+ )?(?:Key [Pp]oints|Highlights)", l.strip()):
            inside = True
            l = "**" + l.strip("# ") + "**"
        elif inside and l.strip() and not re.match(r"^\s*[•*–-]", l):
            inside = False
        out.append(f"> {l}" if inside and l.strip() else l)
    return out


@lines
def numbered_headings(ls):
    """``1.2 Foo`` becomes ``###``, ``3. Title`` alone on its line ``##``; list items go on as they are."""
    out = []
    for i, l in enumerate(ls):
        alone = (not i or not ls[i - 1].strip()) and (i + 1 == len(ls) or not ls[i + 1].strip())
        if alone and re.fullmatch(r"[0-9]{1,2}[.][0-9]{1,2}(?:[.][0-9]{1,2})?[.]? [A-Z][^.!?]{1,70}", l):
            l = f"### {l}"
        elif alone and re.fullmatch(r"\d{1,2}\. [A-Z][A-Za-z ,&-]{2,60}", l):
            l = f"## {l}"
        out.append(l)
    return out


@lines
def orphan_numerals(ls):
    """A numeral alone on its line joins the heading after it."""
    out, i = [], 0
    while i < len(ls):
        j = i + 1
        while j < len(ls) and not ls[j].strip():
            j += 1
        if re.fullmatch(r"\s*(?:[IVX]{1,5}|[0-9]{1,2}(?:[.][0-9]{1,2})*)[.]?\s*", ls[i]) and ls[i].strip() and j < len(ls) and (m := HEADING.match(ls[j])):
            out.append(f"{m[1]} {ls[i].strip()} {m[2]}")
            i = j + 1
        else:
            out.append(ls[i])
            i += 1
    return out


@lines
def title_again(ls):
    """The title, wrapped over lines of the first page again, goes."""
    title = next((l[2:].strip() for l in ls if l.startswith("# ")), "")
    out = list(ls)
    if len(title) >= 20:
        for i in range(1, min(len(out), 40)):
            joined, j = "", i
            while j < len(out) and out[j].strip() and len(joined) < len(title):
                joined = f"{joined} {out[j].strip()}".strip()
                j += 1
            if joined.lower() == title.lower() and not out[i].startswith("#"):
                out[i:j] = [""] * (j - i)
                break
    return out


@lines
def mastheads(ls):
    """Journal and affiliation lines before the title or under it go."""
    gone = re.compile(r"^(?:Journal of [A-Z].{0,80}\d|Department of .{3,90}|(?:\d|[a-e])\s?(?:Department|School|Faculty|Institute|University) .*)$")
    return [l for i, l in enumerate(ls) if i > 30 or not gone.match(l.strip())]


@lines
def badges(ls):
    """Badge lines are set in italics."""
    return [f"*{l.strip()}*" if l.strip() in BADGES else l for l in ls]


@lines
def caption_labels(ls):
    """``Table 1. Table 1. Means``: the label once."""
    return [re.sub(r"^(\W*)((?:Table|Figure) \d+)[.:]?\s+\2([.:])", r"\1\2\3", l) for l in ls]


@lines
def compound_tails(ls):
    """A heading's tail on the next line joins it."""
    out = []
    for l in ls:
        if out and (m := HEADING.match(out[-1])) and re.fullmatch(r"(?:and|&) (?:[Dd]iscussion|[Mm]ethods?|[Cc]onclusions?|[Ff]indings|[Ii]mplications)", l.strip()):
            out[-1] = f"{out[-1].rstrip()} {l.strip()}"
        else:
            out.append(l)
    return out


def blank_lines(text: str) -> str:
    """At most one blank line in a row; one line break at the end."""
    return re.sub(r"\n{3,}", "\n\n", text).strip() + "\n"


PASSES = (
    repeated_headings, repairs.wrapped_hyphens, multiline_captions, orphan_cells, footnotes, study_headings, false_headings, method_headings, wrapped_headings, title_case_headings, parallel_prefixes,
    inline_labels, phantom_tables, repairs.torn_capitals, repairs.repair_text, repeated_captions, fence_headings, compound_tails, key_points, numbered_headings, orphan_numerals, title_again, mastheads, badges, caption_labels, blank_lines,
)


def finish_text(text: str) -> str:
    for f in PASSES:
        text = f(text)
    return text


finish = text_udf(finish_text)


def with_marker(text: Column, n_tables: Column) -> Column:
    """Says at the end how many tables a document has; the last word on whether it is complete."""
    return F.concat(text, F.when(n_tables == 0, "").when(n_tables == 1, "\n<!-- 1 table -->\n").otherwise(F.concat(F.lit("\n<!-- "), n_tables.cast("string"), F.lit(" tables -->\n"))))
