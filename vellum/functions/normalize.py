"""Rewrites that normalize text which came out of typeset documents: a registry, in the order of the whole.

Each is a column expression on its own; ``fulltext`` runs all of them, with the passes over lines between, in one pass.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import functions as F

from vellum.functions.boilerplate import COMPOUNDS, WATERMARKS, symbol_font
from vellum.functions.rewrite import Rewrite, chain, quote, rx, swap, table

STANDARD, ACADEMIC = "standard", "academic"

GAP = r"\s*"
WRAP = rf"{GAP}\n{GAP}"
CMP = "[<=>]"
SIGNED = "[-+]?[0-9]*[.]?[0-9]+"
DECIMAL = r"[-+]?\d+\.\d+"
STOP = r"\s|[,;)\]]|\.\D|\.$|$"


@dataclass(frozen=True)
class Step:
    """One step: its code, the lowest level it runs at, the rewrite, and samples that it must and mustn't change."""

    code: str
    level: str
    rewrite: Rewrite
    positive: tuple[str, ...]
    negative: tuple[str, ...] = ()


def styled_letters() -> tuple[str, str]:
    """Mathematical alphanumerics and the plain character each stands for."""
    old, new = [], []
    for c in range(0x1D400, 0x1D800):
        plain = unicodedata.normalize("NFKC", chr(c))
        if len(plain) == 1 and plain != chr(c):
            old.append(chr(c))
            new.append(plain)
    return "".join(old), "".join(new)


def accents() -> list[tuple[str, str]]:
    """Spacing accents beside a vowel, after it and before it, and the letter they make."""
    out = []
    for mark, combining, vowels in (("´", "́", "aeiouAEIOU"), ("ˆ", "̂", "aeiou"), ("¨", "̈", "aeiou"), ("`", "̀", "aeiou")):
        for v in vowels:
            made = unicodedata.normalize("NFC", v + combining)
            out += [(v + mark, made), (mark + v, made)]
    return out


SPACES = "\u00a0\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
NOTHING = "\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
SYMBOL_FONT = symbol_font()


def compounds() -> Rewrite:
    parts = [(a, "|".join(b.split())) for a, b in COMPOUNDS.items()]
    native = chain(*(rx(rf"\b({a})\s+({b})\b", "$1$2", groups=2) for a, b in parts))
    one = re.compile("|".join(rf"\b{a}\s+(?:{b})\b" for a, b in parts))
    # no first part is a second one too, so a single pass does what one for each of them does in turn
    java = r"(?U)\b(?:" + "|".join(rf"({a})\s+({b})" for a, b in parts) + r")\b"
    put = "".join(f"${i}" for i in range(1, 2 * len(parts) + 1))
    return Rewrite(lambda c: F.regexp_replace(c, java, put), native.sql, lambda t: one.sub(lambda m: "".join(m[0].split()), t))


def dropped_decimal() -> Rewrite:
    """Two or three digits, not all zero, after ``p =``, ``d =`` or ``g =`` lost their point."""
    digits = "0[1-9][0-9]?|00[1-9]|[1-9][0-9]{1,2}"
    return rx(rf"([pP]{GAP}={GAP})({digits})", "$1.$2", ahead=STOP).then(rx(rf"(\b[dDgG]{GAP}={GAP})({digits})", "$1.$2", ahead=STOP))


def thousands() -> Rewrite:
    """Commas leave counts of any length: after ``N =``, ``df =``, a sample size or a total, and in numbers that stand free."""
    groups = range(6, 0, -1)  # SQL has a pattern for each number of groups, the longest first

    def counted(lead: str, after: str = "") -> Rewrite:
        java = rf"(?U)({lead}\d{{1,3}}|\G(?!^)),(\d{{3}})" + (rf"(?=(?:,\d{{3}})*{after})" if after else "")
        plain = re.compile(rf"({lead})(\d{{1,3}}(?:,\d{{3}})+)" + (f"(?={after})" if after else ""))

        def sql(s: str) -> str:
            for n in groups:
                put = "".join(f"\\{i}" for i in range(1, n + (4 if after else 3)))
                s = f"regexp_replace({s}, {quote(f'({lead})' + r'(\d{1,3})' + r',(\d{3})' * n + (f'({after})' if after else ''))}, {quote(put)}, 'g')"
            return s

        return Rewrite(lambda c: F.regexp_replace(c, java, "$1$2"), sql, lambda t: plain.sub(lambda m: m[1] + m[2].replace(",", ""), t))

    def free() -> Rewrite:
        end = r"[\s,;.)\]:]|$"
        java = rf"(?U)((?<![A-Z][(\[])\b[1-9]\d{{0,2}}|\G(?!^)),(\d{{3}})(?=(?:,\d{{3}})*(?:{end}))"
        plain = re.compile(rf"(?<![A-Z][(\[])\b([1-9]\d{{0,2}}(?:,\d{{3}})+)(?={end})")

        def sql(s: str) -> str:
            start = r"(^|[^A-Z][(\[]|^[(\[]|[^\pL\d_(\[])"
            for n in groups:
                put = "".join(f"\\{i}" for i in range(1, n + 4))
                one = lambda x: f"regexp_replace({x}, {quote(start + r'([1-9]\d{0,2})' + r',(\d{3})' * n + f'({end})')}, {quote(put)}, 'g')"  # noqa: B023, E731
                s = one(one(s))
            return s

        return Rewrite(lambda c: F.regexp_replace(c, java, "$1$2"), sql, lambda t: plain.sub(lambda m: m[1].replace(",", ""), t))

    return chain(
        counted(rf"\b[Nn]{GAP}={GAP}\(?{GAP}"), counted(rf"\bdf{GAP}={GAP}", r"\b"), counted(r"(?i:\bsample\s+size\s+of\s+)", r"\b"),
        counted(r"(?i:\btotal\s+of\s+)", r"(?i:\s+participants)"), free(),
    )


def math_words() -> Rewrite:
    names = {"η": "eta", "χ": "chi", "ω": "omega"}
    squares = swap(*((g + "²", n + "2") for g, n in names.items()))
    spaced = chain(*(rx(rf"{g}{GAP}2", f"{n}2") for g, n in names.items()))
    letters = swap(*names.items(), ("α", "alpha"), ("β", "beta"), ("δ", "delta"), ("σ", "sigma"), ("φ", "phi"), ("μ", "mu"))
    digits = table("⁰¹²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉", "01234567890123456789")
    return chain(swap(("×", "x"), ("≤", "<="), ("≥", ">="), ("≠", "!=")), squares, spaced, letters, digits)


def interval_brackets() -> Rewrite:
    pair = lambda o, a, sep, b, c: rf"{o}{GAP}({a}){GAP}{sep}{GAP}({b}){GAP}{c}"
    return chain(
        rx(pair(r"\[", DECIMAL, r"\.", DECIMAL, r"\]"), "[$1, $2]"),
        rx(pair(r"\(", DECIMAL, r"\.", DECIMAL, r"\)"), "($1, $2)"),
        rx(pair(r"\[", SIGNED, ";", SIGNED, r"\]"), "[$1, $2]"),
        rx(pair(r"\(", SIGNED, ";", SIGNED, r"\)"), "($1, $2)"),
        rx(pair(r"\{", SIGNED, "[,;]", SIGNED, r"\}"), "[$1, $2]"),
        rx(pair(r"\[", SIGNED, ",", SIGNED, r"\]"), "[$1, $2]"),
        rx(pair(r"\(", SIGNED, ",", SIGNED, r"\)"), "($1, $2)"),
    )


def statistic_lines() -> Rewrite:
    """Line breaks inside statistics close up; column numbers that bled in between go."""
    bleed = rf"{GAP}\n(?:{GAP}\d{{1,3}}{GAP}\n){{1,4}}{GAP}"
    return chain(
        rx(rf"([pP]){WRAP}({CMP})", "$1 $2"),
        rx(rf"([pP]){bleed}({CMP})", "$1 $2"),
        rx(rf"([pP]{GAP}{CMP}){bleed}([-.0-9])", "$1 $2"),
        rx(rf"([pP]{GAP}{CMP}){WRAP}([0-9])", "$1 $2"),
        rx(rf"(OR|CI|RR){WRAP}([0-9])", "$1 $2"),
        rx(rf"(95{GAP}%){WRAP}(CI)", "$1 $2"),
        rx(rf"({CMP}){WRAP}([-.0-9])", "$1 $2"),
        rx(rf"(p{GAP}{CMP}{GAP})[A-Za-z][^\n]{{0,19}}\n{GAP}(0?\.[0-9]+)", "$1$2"),
        rx(rf"([,;]){WRAP}(p{GAP}{CMP})", "$1 $2"),
        rx(rf"([,;]){WRAP}([0-9]+%{GAP}CI)", "$1 $2"),
    )


STEPS: tuple[Step, ...] = (
    Step("mark_attach", STANDARD, rx("([A-Za-z])\\s+([\u0300-\u036f])", "$1$2"), ("e \u0301tude",), ("e tude",)),
    Step("watermark", STANDARD, chain(*(rx(w, "", groups=0) for w in WATERMARKS)), ("Downloaded from https://host.org/1 by A Reader on 4 May 2020 it",), ("Downloaded files",)),
    Step("backslash_less", STANDARD, rx(r"\\(\s?)", "<$1", ahead=r"\.?[0-9]"), ("p \\ .05 here",), ("a \\ b",)),
    Step("threshold", STANDARD, rx(rf"([(,;]{GAP}(?:all {GAP})?[pP]s?{GAP}<{GAP})(05|01|001)", "$1.$2", ahead=r"[\s),;]|$"), ("was large (p < 05), and",), ("p = 05 and",)),
    Step("symbol_font", STANDARD, table("".join(SYMBOL_FONT), "".join(SYMBOL_FONT.values())), ("\uf061 \uf0a3 2",), ("a <= 2",)),
    Step("styled_letters", STANDARD, table(*styled_letters()), ("𝑝 = .03, 𝜂 = 1",), ("p = .03",)),
    Step("line_ends", STANDARD, swap(("\x00", ""), ("\r\n", "\n"), ("\r", "\n")), ("one\r\ntwo\rthree",), ("one\ntwo",)),
    Step("accents", STANDARD, swap(*accents()), ("caf´e, ma¨ıs na¨ive",), ("cafe",)),
    Step("ligatures", STANDARD, swap(("\ufb00", "ff"), ("\ufb01", "fi"), ("\ufb02", "fl"), ("\ufb03", "ffi"), ("\ufb04", "ffl"), ("\ufb05", "st"), ("\ufb06", "st")), ("e\ufb00ect \ufb01nd o\ufb03ce",), ("effect",)),
    Step("quotes", STANDARD, table("“”„‟″‶‘’‚‛′‵", '""""""' + "''''''"), ("“a” ‘b’ 5′",), ('"a"',)),
    Step("dashes", STANDARD, swap(("\u2014", "--")).then(table("\u2212\u2013\u2010\u2011", "----")), ("\u22120.73 \u2013 1\u20142",), ("-0.73",)),
    Step("eta_lost", STANDARD, rx("\ufffd", "eta", ahead=rf"{GAP}[²2]{GAP}={GAP}-?\.?[0-9]|_?p²{GAP}={GAP}-?\.?[0-9]"), ("\ufffd² = .12; \ufffd2 = .3",), ("a \ufffd b",)),
    Step("spaces", STANDARD, chain(rx("\u00ad[ \\t]*\\n[ \\t]*", "", ahead="[A-Za-z]"), table(SPACES + WIDE + "\u00ad" + NOTHING, " " * len(SPACES) + NARROW), rx(r"[ \t]{2,}", " ")), ("signi\u00ad\nficant\u00a0a\u200b \u3000b \uff10",), ("a b",)),
    Step("hyphens", STANDARD, rx(r"([a-z])-\n", "$1", ahead="[a-z]"), ("we ob-\nserved a-\nb-\nc",), ("Smith-\nJones, x -\n2",)),
    Step("compounds", STANDARD, compounds(), ("the experi mental ques\ntionnaires con sistently",), ("con men",)),
    Step("line_joins", STANDARD, rx(r"([a-z,;])\n", "$1 ", ahead="[a-zα-ω]"), ("showed\nthat a\nb\nc,\nd",), ("end.\nNext",)),
    Step("statistic_lines", ACADEMIC, statistic_lines(), ("p\n= .03 and p <\n 12\n 7\n .05, 95%\nCI, t = 2;\np < .1 OR\n1.5",), ("a group\nleft",)),
    Step("number_lines", STANDARD, rx(r"^[^\S\n]*\d{1,3}[^\S\n]*$", "", flags="m"), ("a\n12\nb\n 7 \nc",), ("a\n1234\nb",)),
    Step("blank_lines", STANDARD, rx(r"\n{3,}", "\n\n"), ("a\n\n\n\nb",), ("a\n\nb",)),
    Step("dropped_decimal", ACADEMIC, dropped_decimal(), ("p = 484, d = 45 and p = 012; g = 05",), ("p = 5, p = 15.8, N = 484, p = 000",)),
    Step("thousands", ACADEMIC, thousands(), ("N = 1,234,567,890; df = 12,345,678; a total of 1,234,567 participants; 3,456 people (2,345)",), ("F(1,300) and x1,2",)),
    Step("decimal_comma", ACADEMIC, rx(r"([0-9]),([0-9]{1,3})", "$1.$2", ahead=STOP, behind=r"[a-zA-Z,0-9\[(]"), ("was 0,05 and 3,7.",), ("F(1,30)", "x1,2")),
    Step("zero_comma", ACADEMIC, rx(r"\b0,([0-9]{2,4})", "0.$1", ahead=r"[\s)\];,.:]|$"), ("(0,25) [0,123]",), ("10,25",)),
    Step("bracket_degrees", ACADEMIC, rx(rf"(\b[A-Za-z][A-Za-z0-9]{{0,3}})\[({GAP}\d+(?:\.\d+)?{GAP},{GAP}\d+(?:\.\d+)?{GAP})\]", "$1($2)", ahead=rf"{GAP}="), ("F[1, 30] = 4.2",), ("see [1, 30]",)),
    Step("interval_brackets", ACADEMIC, interval_brackets(), ("[0.81; 1.92] {0.1, 0.2} ( .3 ; .4 ) [0.1 . 0.2]",), ("[0.81, 1.92]",)),
    Step("math_words", ACADEMIC, math_words(), ("η² = .2, χ 2 = 3, x ≤ 4×2, R² = .5, α₁",), ("eta2",)),
    Step("footnote_digits", ACADEMIC, rx(r"([0-9\])])[¹²³⁰⁴-⁹₀-₉]", "$1", ahead=r"\s|[,;.)]|$"), ("12³ and (a)² .",), ("m²",)),
    Step("doi_rejoin", ACADEMIC, rx(r"((?i:doi:)\s*\S*?[0-9])\.\s*\n\s*([0-9])", "$1.$2"), ("doi: 10.1\n.; doi:10.1037.\n001",), ("doi: none.\nNext",)),
    Step("late_joins", STANDARD, rx(r"([a-z])-\n", "$1", ahead="[a-z]").then(rx(r"([a-z,;])\n", "$1 ", ahead="[a-z]")), ("a re-\nsult of\nit",), ("It.\nSo",)),
)
BY_CODE = {s.code: s for s in STEPS}
