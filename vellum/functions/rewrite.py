"""Rewrites of a text column, each as a Spark expression and as SQL for an engine without look-around.

A ``Rewrite`` is built once and rendered three times: as a column, as SQL, and as a function of one text for passes that
fuse many of them. Where Java's regular expressions look ahead or behind, the SQL
captures the guard and writes it back; since a consumed guard may hide the next match, that pass runs twice.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@dataclass(frozen=True)
class Rewrite:
    """One change of a text: ``spark`` from column to column, ``sql`` from expression to expression."""

    spark: Callable[[Column], Column]
    sql: Callable[[str], str]
    text: Callable[[str], str]

    def then(self, other: Rewrite) -> Rewrite:
        return Rewrite(lambda c: other.spark(self.spark(c)), lambda s: other.sql(self.sql(s)), lambda t: other.text(self.text(t)))


def chain(*rewrites: Rewrite) -> Rewrite:
    out = rewrites[0]
    for r in rewrites[1:]:
        out = out.then(r)
    return out


def rx(core: str, to: str, ahead: str = "", behind: str = "", flags: str = "", groups: int | None = None) -> Rewrite:
    """Replace ``core``; ``to`` names groups as ``$1``. ``ahead``: what must follow; ``behind``: characters that mustn't stand before."""
    n = re.compile(core).groups if groups is None else groups
    java = f"(?U{flags}{'d' if 'm' in flags else ''})" + (f"(?<!{behind})" if behind else "") + core + (f"(?={ahead})" if ahead else "")
    shift = 1 if behind else 0
    back = re.sub(r"\$(\d)", lambda m: f"\\{int(m[1]) + shift}", to)
    if behind:
        back = "\\1" + back
    re2 = (f"(?{flags})" if flags else "") + (f"(^|[^{behind[1:-1]}])" if behind else "") + core
    if ahead:
        re2 += f"({ahead})"
        back += f"\\{n + shift + 1}"

    def sql(s: str) -> str:
        once = lambda x: f"regexp_replace({x}, {quote(re2)}, {quote(back)}, 'g')"
        return once(once(s)) if ahead or behind else once(s)

    plain = re.compile((f"(?{flags})" if flags else "") + (f"(?<!{behind})" if behind else "") + core.replace(r"\z", r"\Z") + (f"(?={ahead})" if ahead else ""))
    put = re.sub(r"\$(\d)", r"\\g<\1>", to)
    return Rewrite(lambda c: F.regexp_replace(c, java, to), sql, lambda t: plain.sub(put, t))


def swap(*pairs: tuple[str, str]) -> Rewrite:
    """Plain replacements in order."""

    def spark(c: Column) -> Column:
        for a, b in pairs:
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    def sql(s: str) -> str:
        for a, b in pairs:
            shown = quote(a) if a != "\x00" else "chr(0)"
            s = f"replace({s}, {shown}, {quote(b)})"
        return s

    def text(t: str) -> str:
        for a, b in pairs:
            t = t.replace(a, b)
        return t

    return Rewrite(spark, sql, text)


def table(old: str, new: str) -> Rewrite:
    """Character by character; characters beyond ``new`` are deleted."""
    put = {a: new[i] if i < len(new) else "" for i, a in reversed(list(enumerate(old)))}
    any_of = re.compile("[" + re.escape("".join(sorted(put))) + "]")
    return Rewrite(lambda c: F.translate(c, old, new), lambda s: f"translate({s}, {quote(old)}, {quote(new)})", lambda t: any_of.sub(lambda m: put[m[0]], t))
