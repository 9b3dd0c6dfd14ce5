"""Glyph repairs that need context: signs that a font lost, crosses read as digits, torn capitals.

Each is a rewrite of one text in linear time; ``repair`` runs them fused in one Arrow pass, so a text crosses to
Python once. A repair is made only where the text itself proves it.
"""

from __future__ import annotations

import re

from vellum.operators.lines import text_udf

REAL = r"\d*\.\d+"
BRACKET = re.compile(rf"[\[(]\s*([-−]?{REAL})\s*(?:,|;|to)\s*([-−]?{REAL})\s*[\])]")
SENTENCE = re.compile(r"[.!?]\s+[A-Z]")
NEAR, CLOSE = 30, 0.005


def value(s: str) -> float:
    return float(s.replace("−", "-"))


def minus_in_interval(text: str) -> str:
    """``[20.92, 20.30]``: a leading 2 stands for a minus where the bounds descend and without it ascend below zero."""

    def fix(m: re.Match) -> str:
        a, b = m[1], m[2]
        if value(a) <= value(b):
            return m[0]
        neg = [f"-{x[1:]}" if x.startswith("2") and len(x) > 2 and x[1:].lstrip("0123456789").startswith(".") else x for x in (a, b)]
        if neg != [a, b] and value(neg[0]) < value(neg[1]) and value(neg[0]) < 0:
            return m[0].replace(a, neg[0], 1).replace(b, neg[1], 1) if a != b else m[0]
        return m[0]

    text = BRACKET.sub(fix, text)
    return re.sub(r"\br\s*=\s*2(\.\d+)", r"r = -\1", text)


def next_interval(record: str, at: int) -> tuple[float, float] | None:
    """The interval that belongs to a number that ends at ``at``: the next one, near, in the same sentence and unclaimed."""
    m = BRACKET.search(record, at, at + 120)
    if not m:
        return None
    between = record[at : m.start()]
    if len(re.sub(r"95\s*%\s*CI|CI", "", between)) > NEAR or SENTENCE.search(between) or re.search(rf"(?<![\w.])-?{REAL}", between):
        return None
    return value(m[1]), value(m[2])


def proven(record: str, pattern: re.Pattern, negative) -> str:
    out, last = [], 0
    for m in pattern.finditer(record):
        ci = next_interval(record, m.end())
        if ci and ci[0] < 0 and ci[0] <= ci[1]:
            v, n = value(m[1]), negative(m[1])
            holds = lambda x: ci[0] - CLOSE <= x <= ci[1] + CLOSE
            if n is not None and holds(value(n)) and not holds(v):
                out += [record[last : m.start(1)], n]
                last = m.end(1)
    return "".join(out) + record[last:] if out else record


TWO = re.compile(r"(?<![\w.\-−])(2\d?\.\d+)")
BARE = re.compile(r"=\s*(\d?\.\d+)")


def by_record(text: str, f) -> str:
    return "\n".join(map(f, text.split("\n")))


def minus_read_as_two(text: str) -> str:
    """``b = 20.45, 95% CI [-0.60, -0.30]``: the number is -0.45 where only that lies in its interval."""
    return by_record(text, lambda r: proven(r, TWO, lambda s: "-" + s[1:] if s[1:] and s[1:] != s else None))


def minus_dropped(text: str) -> str:
    """``b = 0.45, 95% CI [-0.60, -0.30]``: the number gets its minus where only that lies in its interval."""
    return by_record(text, lambda r: proven(r, BARE, lambda s: "-" + s))


def upper_minus_dropped(text: str) -> str:
    """``-0.45 [-0.60, 0.30]``: the upper bound gets its minus where that makes the interval symmetric round the number."""
    pattern = re.compile(rf"(-{REAL})(\D{{0,12}})\[\s*(-{REAL})\s*,\s*({REAL})\s*\]")

    def fix(m: re.Match) -> str:
        est, lo, hi = value(m[1]), value(m[3]), value(m[4])
        ok = lo < -hi and -hi > est and abs((-hi - est) - (est - lo)) < 0.5 * (est - lo)
        return f"{m[1]}{m[2]}[{m[3]}, -{m[4]}]" if ok else m[0]

    return pattern.sub(fix, text)


CONTEXT = re.compile(r"interaction|crossed|factorial|two-way|three-way|moderat", re.I)
COUNTED = {"study", "studies", "table", "figure", "experiment", "model", "model", "step", "wave", "time", "phase", "group", "section", "chapter", "ran", "these", "those", "first", "last", "next", "the", "all", "of", "in", "and", "or", "at", "to", "on", "for"}


def times_in_interactions(text: str) -> str:
    """``interaction (Age 3 Sex)``: a 3 between two capitalized words is a cross where an interaction is spoken of."""

    def line(l: str) -> str:
        if not CONTEXT.search(l):
            return l
        return re.sub(r"\b([A-Z][A-Za-z]+) 3 ([A-Z][A-Za-z]+)\b", lambda m: m[0] if m[1].lower() in COUNTED else f"{m[1]} × {m[2]}", l)

    return by_record(text, line)


def times_in_designs(text: str) -> str:
    """``a 2 3 3 (Cue) design``: the 3 between two level counts is a cross before ``design`` or ``factorial``."""
    near = r"(?=[^\n.]{0,60}\b(?:design|factorial|ANOVA|between|within))"
    text = re.sub(rf"\b([2-9]) 3 ([2-9]) 3 ([2-9])\b{near}", r"\1 × \2 × \3", text)
    return re.sub(rf"\b([2-9])((?: \([^()\n]{{1,40}}\))?) 3 ([2-9])\b{near}", r"\1\2 × \3", text)


def contrast_signs(text: str) -> str:
    """``Mchange = 20.45`` beside a twin ``-0.45`` on the line, and contrast codes ``(21, 0, 1)``, get their minus."""

    def line(l: str) -> str:
        l = re.sub(r"(M\s*change\s*=\s*)2(\d?\.\d+)", lambda m: f"{m[1]}-{m[2]}" if f"-{m[2]}" in l or f"−{m[2]}" in l else m[0], l)
        return re.sub(r"\(2(1|0?\.5)((?:,\s*0)?,\s*\+?)\1\)", r"(-\1\2\1)", l) if re.search(r"cod(?:ed|ing)|contrast", l, re.I) else l

    return by_record(text, line)


def torn_capitals(text: str) -> str:
    """``ACK NOW L EDGEM EN TS``: a line of capital pieces that spell a heading is put together."""
    whole = {"".join(c for c in h if c.isalpha()): h for h in ("ACKNOWLEDGEMENTS", "ACKNOWLEDGMENTS", "REFERENCES", "INTRODUCTION", "DISCUSSION", "METHODS", "RESULTS", "CONCLUSION", "CONCLUSIONS", "KEYWORDS", "ABSTRACT", "APPENDIX", "FUNDING")}

    def line(l: str) -> str:
        s = l.strip()
        return whole.get(s.replace(" ", ""), l) if " " in s and s.isupper() and len(s) < 60 else l

    return by_record(text, line)


def lost_comparison(text: str) -> str:
    """U+FFFD before a number that stands elsewhere after ≥ or ≤ is the other sign; lone ones follow the majority."""
    known = {m[2]: m[1] for m in re.finditer(r"([≥≤])\s*(\d+(?:\.\d+)?)", text)}
    flip = {"≥": "≤", "≤": "≥"}
    text = re.sub(r"�(\s*)(\d+(?:\.\d+)?)", lambda m: (flip[known[m[2]]] if m[2] in known else "�") + m[1] + m[2], text)
    ups, downs = text.count("≥"), text.count("≤")
    if "�" in text and ups != downs and min(ups, downs) == 0:
        text = re.sub(r"�(?=\s*\d)", "≥" if ups else "≤", text)
    return text


ORPHAN = re.compile(r"\s*(\d{1,2}(?:\.\d{1,2}){0,3}\.?)\s*")


def numbered_heading(text: str) -> str:
    """An orphan ``2.1.`` line joins the canonical heading that follows within three lines, blank ones between."""
    from vellum.operators.sections import label_of

    ls, out, i = text.split("\n"), [], 0
    while i < len(ls):
        if m := ORPHAN.fullmatch(ls[i]):
            j = next((j for j in range(i + 1, min(i + 4, len(ls))) if ls[j].strip()), None)
            if j and len(s := ls[j].strip()) <= 80 and not ORPHAN.fullmatch(ls[j]) and label_of(s):
                out.append(f"{m[1].rstrip('.')}. {s}")
                i = j + 1
                continue
        out.append(ls[i])
        i += 1
    return "\n".join(out)


def wrapped_hyphens(text: str) -> str:
    """``well-⏎known`` in prose closes up and keeps its hyphen where the halves are joined by one elsewhere; tables and code stay."""
    seen = set(re.findall(r"\b[A-Za-z]+-[A-Za-z]+\b", text))
    out, fence = [], False
    ls = text.split("\n")
    i = 0
    while i < len(ls):
        l = ls[i]
        fence ^= l.startswith("```")
        m = re.search(r"([A-Za-z]+)-$", l)
        if not fence and m and i + 1 < len(ls) and not l.startswith(("|", "#")) and (n := re.match(r"([A-Za-z]+)(.*)$", ls[i + 1])) and f"{m[1]}-{n[1]}" in seen:
            ls[i + 1] = l + ls[i + 1]
        else:
            out.append(l)
        i += 1
    return "\n".join(out)


ALL = (minus_in_interval, contrast_signs, times_in_interactions, times_in_designs, minus_read_as_two, minus_dropped, upper_minus_dropped, lost_comparison, numbered_heading)


def repair_text(text: str) -> str:
    for f in ALL:
        text = f(text)
    return text


repair = text_udf(repair_text)
