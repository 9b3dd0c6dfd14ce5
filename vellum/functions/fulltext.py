"""The whole normalization of a text, all steps in order, in one Arrow pass.

Rewrites are those of ``normalize``, passes over lines those of ``operators.lines`` and ``operators.repairs``. A step runs
only on a text that holds what it looks for, so plain prose costs a few searches. Levels: ``none`` leaves a text as it is;
``standard`` repairs characters, lines and page furniture; ``academic`` also statistics and reference lists.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType, StructField, StructType

from vellum.functions.boilerplate import COMPOUNDS
from vellum.functions.each import each
from vellum.functions.normalize import ACADEMIC, BY_CODE, CMP, STANDARD
from vellum.operators import lines, references, repairs

Change = Callable[[str], str]


@dataclass
class Report:
    """Steps that ran, those that changed the text, and by how many characters each did."""

    applied: list[str] = field(default_factory=list)
    changed: list[str] = field(default_factory=list)
    chars: dict[str, int] = field(default_factory=dict)


def has(*parts: str) -> Callable[[str], bool]:
    return lambda t: any(p in t for p in parts)


def beyond_ascii(t: str) -> bool:
    return not t.isascii()


def found(pattern: str) -> Callable[[str], bool]:
    search = re.compile(pattern).search
    return lambda t: search(t) is not None


def line(pattern: str) -> Callable[[str], bool]:
    """Whether some line is as the pattern says; the literal line break makes the search fast."""
    search = re.compile(f"\n{pattern}\n").search
    return lambda t: search(f"\n{t}\n") is not None


def said(*parts: str) -> Callable[[str], bool]:
    """Whether a text holds one of the parts in any case."""

    def run(t: str) -> bool:
        low = t.lower()
        return any(p in low for p in parts)

    return run


def composed(t: str) -> str:
    return unicodedata.normalize("NFC", t)


def to_the_end(f: Change) -> Change:
    """``f`` until it changes nothing."""

    def run(t: str) -> str:
        while (u := f(t)) != t:
            t = u
        return t

    return run


LATE = [(re.compile("([a-z])-\n(?=[a-z])"), r"\1"), (re.compile("([a-z,;])\n(?=[a-zα-ω])"), r"\1 ")]
BREAK, BLANK = r"[ \t]*\n[ \t]*", r"\s*\n\s*\n\s*"
LATE_STATISTICS = [
    (re.compile(a + gap + f"(?={b})"), r"\1 ")
    for gap, pairs in (
        (BREAK, (("([pP])", CMP), (rf"([pP]\s*{CMP})", r"\d"), ("(OR|CI|RR)", r"\d"), (r"(95\s*%)", "CI"), (f"({CMP})", r"[-\d.]"), ("([,;])", rf"p\s*{CMP}"), ("([,;])", r"\d+%\s*CI"))),
        (BLANK, (("([,;])", r"\d+%\s*CI"), ("([,;])", rf"p\s*{CMP}"), (f"({CMP})", r"[-.]?\d"), ("(OR|CI|RR|HR)", r"\d+(?:\.\d|\d|[-*<>=,])"))),
    )
    for a, b in pairs
]


def late_joins(statistics: bool) -> Change:
    """Line breaks that earlier steps left inside words, sentences and, with ``statistics``, statistics."""

    def run(t: str) -> str:
        for p, to in LATE + LATE_STATISTICS * (statistics and STATISTICAL(t)):
            t = p.sub(to, t)
        return t

    return run


def interval_steps(f: Change) -> tuple[Callable[[str], bool], Change]:
    return (lambda t: repairs.BRACKET.search(t) is not None), f


STATISTICAL = has("=", "<", ">", "CI", "OR", "RR", "HR")
COMPARED, GROUPED, BROKEN = has("=", "<", ">"), found(r"\d,\d"), has("\n")


def plan(level: str, keep_math: bool) -> list[tuple[str, Callable[[str], bool], Change]]:
    """``(code, whether the step can matter, step)`` in order."""
    step = lambda code, when: (code, when, BY_CODE[code].rewrite.text)
    academic = level == ACADEMIC
    out = [
        step("mark_attach", beyond_ascii),
        ("nfc", beyond_ascii, composed),
        ("banner", bool, lines.without_banners),
        ("contents", has("_", "ontents", "ONTENTS", "ist ", "IST "), lines.drop_contents_text),
        ("furniture", bool, lines.without_furniture),
        ("running_heads", BROKEN, lines.drop_running_heads),
        ("front_matter", lambda t: len(t) >= 200, lines.without_leaks),
        ("letterspaced", line(r"\s*(?:[a-z] ){3,}[a-z]\s*"), lines.close_spaced_text),
        ("watermark", bool, lines.without_stamps),
        ("minus_interval", has("[", "(", "r "), repairs.minus_in_interval),
        step("backslash_less", has("\\")),
        ("minus_two", *interval_steps(repairs.minus_read_as_two)),
        ("contrast", has("change", "(2"), repairs.contrast_signs),
        ("times", has(" 3"), repairs.times_in_interactions),
        ("times_design", has(" 3"), repairs.times_in_designs),
        step("threshold", has("<")),
        ("minus_dropped", *interval_steps(repairs.minus_dropped)),
        step("symbol_font", found("[\uf000-\uf8ff]")),
        step("styled_letters", found("[\U0001d400-\U0001d7ff]")),
        step("line_ends", has("\0", "\r")),
        step("accents", has("´", "ˆ", "¨", "`")),
        step("ligatures", beyond_ascii),
        step("quotes", beyond_ascii),
        step("dashes", beyond_ascii),
        step("eta_lost", has("\ufffd")),
        ("comparison_lost", has("\ufffd"), repairs.lost_comparison),
        step("spaces", lambda t: not t.isascii() or "  " in t or "\t" in t),
        step("hyphens", has("-\n")),
        step("compounds", has(*(a + gap for a in COMPOUNDS for gap in " \n\t"))),
        step("line_joins", BROKEN),
    ]
    if academic:
        out.append(step("statistic_lines", lambda t: "\n" in t and (COMPARED(t) or "CI" in t or "RR" in t or "OR" in t)))
    out += [("repeated_lines", BROKEN, lines.drop_repeated_lines), step("number_lines", line(r"[^\S\n]*\d{1,3}[^\S\n]*")), ("page_clusters", line(r"[^\S\n]*[1-9]\d{3}[^\S\n]*"), lines.drop_page_clusters), step("blank_lines", has("\n\n\n"))]
    if academic:
        out.append(step("dropped_decimal", has("=")))
        if not keep_math:
            out += [step("thousands", GROUPED), step("decimal_comma", GROUPED), step("zero_comma", GROUPED)]
        out += [step("bracket_degrees", has("[")), step("interval_brackets", found(r"[\[({]\s*[-+.\d]"))]
        if not keep_math:
            out.append(step("math_words", beyond_ascii))
        out += [step("footnote_digits", beyond_ascii), step("doi_rejoin", said("doi:")), ("references", said("reference", "bibliography", "literature", "cited"), references.repair_text)]
    out += [
        ("late_joins", BROKEN, late_joins(academic)),
        ("banner_again", bool, to_the_end(lines.without_banners)),
        ("blank_lines_again", has("\n\n\n"), BY_CODE["blank_lines"].rewrite.text),
        ("front_matter_again", lambda t: len(t) >= 200, to_the_end(lines.without_leaks)),
        ("furniture_again", bool, to_the_end(lines.without_furniture)),
        ("numbered_heading", line(r"[^\S\n]*\d{1,2}(?:\.\d{1,2}){0,3}\.?[^\S\n]*"), repairs.numbered_heading),
        ("nfc_again", beyond_ascii, composed),
    ]
    return out


PLANS = {(level, keep): plan(level, keep) for level in (STANDARD, ACADEMIC) for keep in (False, True)}


def normalize_text(text: str, level: str = ACADEMIC, keep_math: bool = False, report: Report | None = None) -> str:
    """One text after all steps of ``level``. ``keep_math`` leaves symbols and grouped or decimal commas alone."""
    if level == "none":
        return text
    numbers = lines.page_number_set(text) if level == ACADEMIC else set()
    for code, when, change in PLANS[level, keep_math]:
        if report is not None:
            report.applied.append(code)
        if not when(text):
            continue
        after = change(text, numbers) if code == "references" else change(text)
        if report is not None and after != text:
            report.changed.append(code)
            if len(after) != len(text):
                report.chars[code] = abs(len(after) - len(text))
        text = after
    return text.strip()


def normalize(text: Column, level: str = ACADEMIC, keep_math: bool = False) -> Column:
    """``text`` after all steps of ``level``; null stays null, empty stays empty."""
    if level == "none":
        return text
    return each(lambda t: normalize_text(t, level, keep_math), StringType())(text)


REPORT = StructType([StructField("text", StringType()), StructField("steps_applied", ArrayType(StringType())), StructField("steps_changed", ArrayType(StringType())), StructField("changes", MapType(StringType(), IntegerType()))])


def with_report(docs: DataFrame, text_col: str = "text", level: str = ACADEMIC, keep_math: bool = False) -> DataFrame:
    """``docs`` with the normalized text and ``report``: steps applied, steps that changed it, characters by which they did."""

    def reported(t: str | None) -> dict:
        r = Report()
        text = None if t is None else normalize_text(t, level, keep_math, r)
        return {"text": text, "steps_applied": r.applied, "steps_changed": r.changed, "changes": list(r.chars.items())}

    done = docs.withColumn("__done", each(reported, REPORT, nulls=True)(F.col(text_col)))
    return done.withColumn("report", F.struct("__done.steps_applied", "__done.steps_changed", "__done.changes")).withColumn(text_col, F.col("__done.text")).drop("__done")
