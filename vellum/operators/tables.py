"""Whole tables as grids of strings: cleaning, header recovery, flattening to statistical rows, blocks of Markdown.

A grid is an array of rows of cells, small by nature; each operator is one function of a grid and, for columns of
grids, one Arrow pass. Cells that a merge put together are parted by ``SEP``.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable
from itertools import product

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, MapType, StringType, StructField, StructType

from vellum.operators.flatten import GUARDS, LEADING, ROLES

SEP = "\x1f"
Grid = list[list[str]]


# Cleaning:
PAGE_HEAD = re.compile(r"\d{1,4}|\|\s*\d{1,4}\b.*|(?i:Vol)\.?[\s:].*|[A-Z][A-Z\s&]{6,}\s+\d{2,5}|.*\bet\s+al\.?|(?i:doi|https?)\b.*")
NAME_HEAD = re.compile(r"[A-Z][A-Za-z'’]{1,15}(?:\s+and\s+[A-Z][A-Za-z'’]{1,15})?|\d{1,4}")
MARKS = re.compile("[*∗†‡§+#]+")
NUMERIC = re.compile(r"[+\-−–—]?\d+(?:\.\d+)?%?")
VALUE = re.compile(r"[<>=~≈]?\s*[+\-−–]?\s*(?:\d[\d,]*\.?\d*|\.\d+)\s*%?\s*[*∗†]*(?:\s*[\[(].*[\])])?|n\s*/?\s*a|[-–—]+", re.I)
DOTS = re.compile(r"(?:\.\s+){4,}\.?")
GLUE = re.compile(r"\b(?:and|or|but|of|the|in|for|with|to|an?|on|at|by|from|as|is|are|was|were|be|been|than|that|which|who|when|where|while|during|after|before|because|since|though|although|into|onto|upon)$", re.I)
GROUP = re.compile(r"[A-Z][\w\-]*(?:\s+[\w\-]+)*\s*\([^)]*\b(?:n|N|M|SD|p)\s*[=<>]")


def head_cell(c: str) -> tuple[bool, bool]:
    """Whether a cell surely, and whether it perhaps, is a running head."""
    return len(c) <= 40 and bool(PAGE_HEAD.fullmatch(c)), len(c) <= 40 and bool(NAME_HEAD.fullmatch(c))


def without_heads(rows: Grid) -> Grid:
    """Top rows of running heads and page numbers go; a sure one beside real labels is blanked."""
    real = lambda row: any(c and not any(head_cell(c)) for c in row)
    while len(rows) >= 2:
        top = [c for c in rows[0] if c]
        if not top or not any(head_cell(c)[0] for c in top) or not all(any(head_cell(c)) for c in top) or not any(map(real, rows[1:])):
            break
        rows = rows[1:]
    if rows and real(rows[0]):
        rows = [["" if c and head_cell(c)[0] else c for c in rows[0]], *rows[1:]]
    return rows


def unfinished(c: str) -> bool:
    if not c or re.search(r"[.!?]['\")\]]?$", c) or re.fullmatch(r"[\d.,%*∗+\-−–—]+", c):
        return False
    return bool(re.search(r"[/,;:\-—–]$", c) or GLUE.search(c) or (len(c.split()) >= 2 and c[-1].islower()))


def fragment(c: str) -> bool:
    return not c or c.startswith("(") or (")" in c and "(" not in c) or ("]" in c and "[" not in c)


def joined(parent: list[str], row: list[str], put: Callable[[str, str], str]) -> None:
    for i, v in enumerate(row[: len(parent)]):
        if v:
            parent[i] = put(parent[i], v) if parent[i] else v


def without_continuations(rows: Grid) -> Grid:
    """Rows that go on with the row before join it, cell by cell."""
    out: Grid = []
    for row in rows:
        first, rest = row[0] if row else "", [c for c in row[1:] if c]
        alone = [c for c in row if c]
        parent = out[-1] if out else None
        if len(alone) == 1 and len(alone[0]) <= 200 and GROUP.match(alone[0]) or parent is None:
            out.append(list(row))
        elif not first and rest and any(len(c.split()) >= 2 or len(c) >= 10 for c in rest):
            joined(parent, row, lambda a, b: a + SEP + b)
        elif first and not rest and parent[0].endswith(("/", "-", "—", "–")):
            parent[0] += first if parent[0].endswith(("/", "-")) else " " + first
        elif first and re.fullmatch(r"\([^)]+\)|(?i:cont\.?|continued|ctd\.?)", first) and sum(map(unfinished, parent)) >= 2 and all(len(c) <= 60 for c in row):
            joined(parent, row, lambda a, b: a + SEP + b)
        elif alone and all(map(fragment, row)) and all(i < len(parent) and parent[i] for i, c in enumerate(row) if c):
            joined(parent, row, lambda a, b: a + b if a.endswith(("-", "–", "—", "(", "−")) else f"{a} {b}")
        else:
            out.append(list(row))
    return out


def with_marks(rows: Grid) -> Grid:
    """Rows of nothing but significance marks join the estimates above them, or below where a label stands between, as ``<sup>``."""
    rows, out = [list(r) for r in rows], []
    estimate = lambda r: any(NUMERIC.fullmatch(c) for c in r)
    anchor = lambda r: any(c and not MARKS.fullmatch(c) and not (c[0] in "([" and c[-1] in ")]") for c in r)
    for i, row in enumerate(rows):
        marks = [c for c in row if c]
        if marks and all(MARKS.fullmatch(c) for c in marks):
            up = next((r for r in reversed(out) if estimate(r) or anchor(r)), None)
            target = up if up is not None and estimate(up) else rows[i + 1] if up is not None and i + 1 < len(rows) and estimate(rows[i + 1]) else None
            if target is not None and any(c and j < len(target) and target[j] for j, c in enumerate(row)):
                for j, c in enumerate(row[: len(target)]):
                    if c and target[j]:
                        target[j] = f"{target[j]}<sup>{c}</sup>"
                continue
        out.append(row)
    return out


def parted(c: str) -> str:
    """``SEP`` where two values run together: after a lower-case word before a capital, and a word before a number."""
    if len(c) < 6:
        return c
    c = re.sub(r"(?<=[^\W\d_])(?<=[a-z]{4})(?=[A-Z])|(?<![^\s])([a-z]{3})(?=[A-Z][a-z])", lambda m: (m[1] or "") + SEP, c)
    return re.sub(r"(?<=[A-Za-z]{4})(?=\d(?:$|[\d .,]))", SEP, c)


def header_like(row: list[str]) -> bool:
    full = [c for c in row if c]
    return bool(full) and sum(all(VALUE.fullmatch(t) for t in c.split()) for c in full) <= 0.3 * len(full) and sum(map(len, full)) <= 30 * len(full)


def folded(header: Grid) -> Grid:
    """A header row that spans the one below joins it column by column; columns that continue a hyphen close up."""
    if len(header) == 2:
        top, sub = header
        ends = [bool(a and re.search(r"[-—–:]$", a) and b[:1].isalpha()) for a, b in zip(top, sub)]
        if any(ends):
            top = [a + b if e else a for a, b, e in zip(top, sub, ends)]
            sub = ["" if e else b for b, e in zip(sub, ends)]
            header = [top, sub] if any(sub) else [top]
    while len(header) >= 2:
        top, sub, *rest = header
        if any(len(c) > 80 and (re.search(r",\s*[a-z]", c) or c.count("(") > c.count(")")) for c in top) or not any(top):
            header = [sub, *rest]
        elif all(top) or any(a and not b for a, b in zip(top, sub)):
            break
        else:
            header = [[f"{a}{SEP}{b}" if a else b for a, b in zip(top, sub)], *rest]
    return header


def separator(row: list[str]) -> bool:
    """Whether a row of three columns or more only names the group of the rows below."""
    return len(row) >= 3 and not any(row[1:]) and len(row[0]) >= 3 and any(map(str.isalpha, row[0]))


def ci_row(row: list[str]) -> list[str]:
    """The minus that an interval's upper bound lost, by the estimate in the nearest cell to its left."""
    out, est = list(row), None
    for j, c in enumerate(row):
        m = re.fullmatch(r"\[\s*([-−]?\s?\d*\.\d+)\s*,\s*([-−]?)\s*[–—]?\s*(\d*\.\d+)\s*\]", c)
        if m and est is not None:
            lo, hi = signed(m[1]), signed(m[2] + m[3])
            if est < 0 and lo < 0 < hi and lo < -hi and -hi > est and abs((-hi - est) - (est - lo)) < 0.5 * (est - lo):
                low = re.sub(r"\s+", "", m[1])
                out[j] = f"[{low}, {'−' if low.startswith('−') else '-'}{m[3]}]"
        elif e := re.fullmatch(r"(?:[A-Za-zβηχ²]+\s*=\s*)?([-−]?\d*\.\d+)[*∗†]*", c):
            est = signed(e[1])
    return out


def signed(s: str) -> float:
    return float(s.replace("−", "-").replace(" ", ""))


def clean(grid: Grid) -> tuple[int, Grid]:
    """``(header rows, grid)`` after all of the above; rows have equal width."""
    n = max((len(r) for r in grid), default=0)
    rows = [[(c or "").strip() for c in r] + [""] * (n - len(r)) for r in grid]
    rows = with_marks(without_continuations(without_heads(rows)))
    rows = [[parted(DOTS.sub("", c).strip(SEP + " ")) for c in ci_row(r)] for r in rows if any(r)]
    k = 0
    while k < min(3, len(rows) - 1) and header_like(rows[k]) and not (k and separator(rows[k])):
        k += 1
    header = folded(rows[:k])
    return len(header), header + rows[k:]


def escaped(c: str) -> str:
    out = entities.escape(c, quote=False).replace(SEP, "<br>")
    return re.sub("&lt;(/?sup)&gt;", r"<\1>", out)


def html(grid: Grid) -> str:
    """A cleaned grid as HTML; tables of fewer than two rows are empty."""
    k, rows = clean(grid)
    if len(rows) < 2:
        return ""
    line = lambda r, t: "<tr>" + (f'<td colspan="{len(r)}"><strong>{escaped(r[0])}</strong></td>' if t == "td" and separator(r) else "".join(f"<{t}>{escaped(c)}</{t}>" for c in r)) + "</tr>"
    return "<table>" + "".join(line(r, "th" if i < k else "td") for i, r in enumerate(rows)) + "</table>"


def raw_html(text: str) -> str:
    """The fallback of a table without cells: its text, line by line."""
    return f"<pre>{entities.escape(text.strip(), quote=False)}</pre>" if text.strip() else ""


# Flattening:
#: Ordered: the first that is found in a header names the effect, and the field it fills.
EFFECTS = (
    ("cohens_d", r"\b(?:d\s*z|d|cohen)\b", "d"), ("hedges_g", r"\b(?:g|hedges)\b", "est"), ("pearson_r", r"^\s*r\b", "est"),
    ("eta_squared_partial", r"η\s*²?\s*_?\s*p|η²p|eta.*p\b", "eta2"), ("eta_squared", r"η|eta", "eta2"), ("odds_ratio", r"\bor\b|odds\s*ratio", "est"),
    ("risk_difference", r"risk\s*diff", "est"), ("mean_difference", r"mean\s*diff|\bmd\b|difference\s+in\s+means", "est"),
)
RIVAL = re.compile(r"\bd\s*z?\b|cohen|hedges|\bg\b|(?<![A-Za-z])r(?![A-Za-z])|\bOR\b|odds\s*ratio|risk\s*diff|\bMD\b", re.I)
INLINE = re.compile(r"(r|d\s*z|d|g|η\s*²?\s*p?|η2p?|eta\s*p?2?)\s*=\s*([-+]?\d*\.?\d+)", re.I)
NUM, NA = r"[-+]?(?:\d+\.?\d*|\.\d+)", re.compile(r"n\s*/?\s*a", re.I)
DF_PAIR, CI_ONLY, EST_CI = (re.compile(p) for p in (r"\d+\s*,\s*\d+", rf"[\[(]\s*{NUM}\s*[,–—-]\s*{NUM}\s*[\])]|{NUM}\s*[,–—]\s*{NUM}", rf"{NUM}\s*%?\s*[\[(].*[\])]"))
P_LIKE, BARE = re.compile(r"[<>=]?\s*[01]?\.\d+"), re.compile(NUM)
TOKENS = {"bf01": "BF01", "bf": "BF01", "η²": "eta2", "η2": "eta2", "η²p": "eta2", "η2p": "eta2", "eta2": "eta2", "df": "df", "95%": "CI", "95": "CI", "ci": "CI", "c.i.": "CI", "d": "d", "dz": "d"}
CASED = {"t": "t", "F": "F", "r": "r", "p": "p", "M": "M", "SD": "SD", "n": "n", "N": "n"}
VALUE_GROUP = re.compile(rf"{NUM}%?(?:\s*\([^()]*\))?(?:\s*\[[^\[\]]*\])?")
_ROLES = [(name, re.compile(p)) for name, p in ROLES]


def effect_type(header: str) -> str | None:
    return next((name for name, p, _ in EFFECTS if re.search(p, header, re.I)), None)


def effect_type_of(header: Column) -> Column:
    """The same of a column of headers; null where none is named."""
    out = F.lit(None).cast("string")
    for name, p, _ in reversed(EFFECTS):
        out = F.when(header.rlike(f"(?iu){p}"), name).otherwise(out)
    return out


def role_of(header: str) -> str | None:
    if re.search(r"[A-Za-zη].*[(\[]\s*95\s*%?\s*C\.?\s*I", header, re.I):
        return "est_ci"
    for part in reversed(re.split(rf"\|\||{SEP}", header)):
        h = part.strip().lower()
        if found := next((name for name, p in _ROLES if p.match(h)), None):
            return found
    return None


def frac(values: list[str], test: Callable[[str], object]) -> bool:
    """Two values at least, and 60 % of them, pass; a single one must."""
    hits = sum(bool(test(v)) for v in values)
    return bool(values) and (hits == 1 if len(values) == 1 else hits >= 2 and hits >= 0.6 * len(values))


def caption_run(text: str) -> list[str]:
    """The longest run of statistics' names in a text, two at least: a header row that leaked into the caption."""
    best, now = [], []
    for tok in [*text.split(), None]:
        role = None if tok is None else CASED.get(tok.strip(",:;")) or TOKENS.get(tok.strip(",:;").lower())
        if role is None:
            best, now = max(best, now, key=len), []
        elif role != "CI" or now[-1:] != ["CI"]:
            now.append(role)
    return best if len(best) >= 2 else []


def recovered(header: list[str], body: Grid, label: int, caption: str) -> dict[int, str]:
    """Roles of columns without a known header, by the shapes of their values, the family of the test and the caption."""
    cols = [c for c in range(len(header)) if c != label]
    known = {c: role_of(header[c]) for c in cols}
    values = {c: [r[c] for r in body if r[c]] for c in cols}
    blank = [c for c in cols if values[c] and not known[c]]
    told = [c for c in cols if values[c] and known[c]]
    if len(blank) < 2 or len(told) >= len(blank) or {known[c] for c in told} & {"t", "F", "r", "chi2"}:
        return {}
    vocab = " ".join([header[c] for c in cols] + [caption])
    run = caption_run(caption) or caption_run(vocab)
    if not run and not (re.search(r"\bd\s*z?\b|cohen|η|\beta", vocab, re.I) and any(frac(values[c], EST_CI.fullmatch) for c in blank)):
        return {}
    out: dict[int, str] = {}
    for c in blank:
        v = values[c]
        shape = next((name for name, p in (("df_pair", DF_PAIR), ("est_ci", EST_CI), ("CI", CI_ONLY)) if frac(v, p.fullmatch)), None)
        if shape or (frac(v, lambda x: P_LIKE.fullmatch(x) or NA.fullmatch(x)) and any(x[0] in "<>" for x in v)):
            out[c] = shape or "p"
    says = lambda s: re.search(rf"(?<![A-Za-z]){s}(?![A-Za-z])", vocab)
    family = "F" if "df_pair" in out.values() or (says("F") and not says("t")) else "t" if says("t") or re.search(r"\bd\s*z?\b|cohen", vocab, re.I) or ("est_ci" in out.values() and not says("F")) else "r" if says("r") else "F" if says("F") else None
    seq = list(run)
    for c in cols:  # the caption's names in the order of the columns
        role = known[c] or out.get(c)
        if role:
            kind = {"est_ci": "CI", "df_pair": "df", "df1": "df", "df2": "df"}.get(role, role)
            if seq[:1] == [kind]:
                seq.pop(0)
        elif seq and values[c]:
            out[c] = seq.pop(0)
    number = lambda x: BARE.fullmatch(x) or NA.fullmatch(x)
    if family and family not in out.values():
        left = [c for c in blank if c not in out]
        for c in left:
            if frac(values[c], str.isdigit):
                out[c] = "n" if family == "r" else "df"
        if stat := next((c for c in left if c not in out and frac(values[c], number)), None):
            out[stat] = family
    for c in blank:
        near = out.get(c + 1) or known.get(c + 1)
        if c not in out and frac(values[c], number) and near in ("CI", "est_ci"):
            out[c] = "est"
    return {c: r for c, r in out.items() if r in ("CI", "est_ci") or r not in known.values()}


def number_in(cell: str) -> float | None:
    m = re.match(LEADING, cell.strip())
    return signed(m[1]) if m else None


def interval_in(cell: str, est: float | None = None) -> tuple[float, float] | None:
    """The interval of a cell, what is in brackets first: by comma, range sign or hyphen; signs that a hyphen hides by order and estimate."""
    cell = cell.replace("−", "-")
    for body in [*re.findall(r"[\[(]([^\[\]()]*)[\])]", cell)[-1:], cell]:
        if m := re.search(rf"({NUM})\s*%?\s*(?:,|;|–|—|\bto\b)\s*({NUM})", body):
            return float(m[1]), float(m[2])
        if m := re.fullmatch(r"\s*(-?)(\d*\.?\d+)\s*-\s*(-?)(\d*\.?\d+)\s*", body.replace("%", "").strip(" []()")):
            one, two = (-1.0 if m[1] else 1.0), (-1.0 if m[3] else 1.0)
            tried = [(a * float(m[2]), b * float(m[4])) for a, b in product((one, 1.0, -1.0), (two, 1.0, -1.0))]
            good = [t for t in tried if t[0] < t[1] and (est is None or t[0] <= est <= t[1])]
            if good or tried[0][0] < tried[0][1]:
                return (good or tried)[0]
    return None


def arms_of(body: Grid) -> tuple[int, list[str]] | None:
    """The column that repeats the same two to four names on every data row, where two columns hold as many values in each cell."""
    data = [r for r in body if sum(any(map(str.isdigit, c)) for c in r) >= 2]
    for a in range(len(data[0]) if len(data) >= 2 else 0):
        names = data[0][a].split()
        if len({r[a] for r in data}) == 1 and 2 <= len(names) <= 4 and all(re.fullmatch(r"[A-Za-z][A-Za-z.\-]*", t) for t in names):
            cols = [c for c in range(len(data[0])) if c != a and any(r[c] for r in data)]
            if sum(all(packed(r[c], len(names)) for r in data if r[c]) for c in cols) >= 2:
                return a, names
    return None


def packed(cell: str, k: int) -> list[str] | None:
    """The k values of a cell, where they are nearly all of it."""
    got = [m.strip() for m in VALUE_GROUP.findall(cell)]
    bare = lambda s: re.sub(r"\s", "", s)
    return got if len(got) == k and len(bare("".join(got))) >= 0.8 * len(bare(cell)) else None


def fields_of(roles: dict[int, str], header: list[str], row: list[str], hint: str | None) -> dict[str, float | str]:
    """Typed fields of one row; what fails its guard is left out."""
    out: dict[str, float | str] = {}
    eta = hint is None and "F" in roles.values() and {"BF01", "CI", "est_ci", "CI_lower"} & set(roles.values()) and not {"d", "r"} & set(roles.values()) and not any(map(RIVAL.search, header))
    key_of = {name: field for name, _, field in EFFECTS}
    for c, role in roles.items():
        cell, v = row[c], number_in(row[c])
        if m := INLINE.fullmatch(cell.replace("−", "-")):
            sign = m[1].replace(" ", "").lower()
            out["eta2" if sign[0] in "ηe" else "r" if sign == "r" else "d"] = float(m[2])
        elif role == "df_pair" and DF_PAIR.fullmatch(cell):
            out["df1"], out["df2"] = map(float, cell.split(","))
        elif role in ("est", "est_ci") and v is not None:
            named = key_of.get(effect_type(header[c]) or hint or "", "est")
            out["eta2" if named == "est" and eta and 0 <= v <= 1 else named] = v
        elif role == "p" and v is not None and 0 <= v <= 1:
            out["p"], out["p_op"] = v, (re.search("[<>=≤≥]", cell) or ["="])[0]
        elif role not in ("CI", "p", "df_pair") and v is not None:
            out.setdefault(role, v)
    est = next((out[k] for k in ("est", "d", "r", "eta2") if k in out), None)
    ci = next((i for c, role in roles.items() if role in ("CI", "est_ci") and (i := interval_in(row[c], est))), None) or (out.pop("CI_lower", None), out.pop("CI_upper", None))
    if None not in ci and ci[0] <= ci[1]:
        out["CI_lower"], out["CI_upper"] = ci
    fine = {"t": lambda v: True, "F": lambda v: v >= 0, "chi2": lambda v: v >= 0, "r": lambda v: -1 <= v <= 1, "eta2": lambda v: 0 <= v <= 1, "SD": lambda v: v >= 0, "SE": lambda v: v >= 0, "BF01": lambda v: v >= 0, "n": lambda v: v > 0 and v == int(v), "df": lambda v: v > 0, "df1": lambda v: v > 0, "df2": lambda v: v > 0}
    return {k: v for k, v in out.items() if k in ("p", "p_op", "CI_lower", "CI_upper") or (k in GUARDS and (k not in fine or fine[k](v)))}


def short(v: float, bare: bool = False) -> str:
    s = f"{v:.6f}".rstrip("0").rstrip(".")
    return re.sub(r"^(-?)0\.", r"\1.", s) if bare else s


def sentence_of(label: str, f: dict) -> str:
    """``Recall: t(38) = 2.5, p < .05``; empty without any field."""
    parts = [f"{k} = {short(f[k])}" for k in ("M", "SD", "n", "est") if k in f]
    if "t" in f:
        parts.append(f"t({short(f['df'])}) = {short(f['t'])}" if "df" in f else f"t = {short(f['t'])}")
    if "F" in f:
        parts.append(f"F({short(f['df1'])}, {short(f['df2'])}) = {short(f['F'])}" if "df1" in f and "df2" in f else f"F = {short(f['F'])}")
    parts += [f"{k} = {short(f[k])}" for k in ("chi2", "z") if k in f] + ([f"r = {short(f['r'], True)}"] if "r" in f else [])
    parts += ([f"p {f['p_op']} {short(f['p'], True)}"] if "p" in f else []) + ([f"d = {short(f['d'])}"] if "d" in f else []) + ([f"eta2 = {short(f['eta2'], True)}"] if "eta2" in f else [])
    if "CI_lower" in f:
        parts.append(f"95% CI [{short(f['CI_lower'])}, {short(f['CI_upper'])}]")
    return (f"{label}: " if label else "") + ", ".join(parts) if parts else ""


def flatten(grid: Grid, caption: str = "") -> list[dict]:
    """A record for each statistical row, and each of its arms: ``row, group, fields, p_op, sentence``; none of fewer than two rows."""
    k, rows = clean(grid)
    if not k or len(rows) < 2:
        return []
    header, body = rows[k - 1], [r for r in rows[k:] if not separator(r)]
    arms = arms_of(body)
    jobs = []
    for i, r in enumerate(body):
        if arms:
            a, names = arms
            split = [packed(c, len(names)) for c in r]
            jobs += [(i, g, [s[j] if s else c for n, (c, s) in enumerate(zip(r, split)) if n != a]) for j, g in enumerate(names)]
        else:
            jobs.append((i, None, r))
    if arms:
        header = [h for n, h in enumerate(header) if n != arms[0]]
    label = max(range(len(header)), key=lambda c: (sum(bool(r[c]) and not (BARE.fullmatch(r[c]) or CI_ONLY.fullmatch(r[c]) or P_LIKE.fullmatch(r[c])) for _, _, r in jobs), -c), default=0)
    roles = {c: role for c in range(len(header)) if c != label and (role := role_of(header[c]))}
    roles |= recovered(header, [r for *_, r in jobs], label, caption)
    hint = effect_type(caption) if caption else None
    out = []
    for i, group, r in jobs:
        f = fields_of(dict(sorted(roles.items())), header, r, hint)
        name = r[label].replace(SEP, " ") + (f" ({group})" if group else "")
        if s := sentence_of(name, f):
            out.append({"row": i, "group": group, "fields": {n: v for n, v in f.items() if n != "p_op"}, "p_op": f.get("p_op"), "sentence": s})
    return out


def block(grid: Grid, caption: str, name: str) -> str:
    """The sentences of a table as a list of Markdown between two comments; empty without any."""
    got = flatten(grid, caption)
    if not got:
        return ""
    return "\n".join([f'<!-- flattened table "{name}" -->', f"### {name}, as text", "", *(f"- {r['sentence']}" for r in got), f'<!-- end of "{name}" -->']) + "\n"


RECORD = StructType([StructField("row", IntegerType()), StructField("group", StringType()), StructField("fields", MapType(StringType(), DoubleType())), StructField("p_op", StringType()), StructField("sentence", StringType())])


def over_grids(f: Callable, kind) -> Callable[..., Column]:
    """``f`` of a grid, and of what other columns hold, as an Arrow pass over columns; null grids are null."""

    def column(grid: Column, *more: Column) -> Column:
        @F.pandas_udf(kind)
        def run(*cols: pd.Series) -> pd.Series:
            return pd.Series([None if g is None else f([[c for c in r] for r in g], *(m or "" for m in rest)) for g, *rest in zip(*cols)])

        return run(grid, *more)

    return column


cleaned = over_grids(lambda g: clean(g)[1], ArrayType(ArrayType(StringType())))
as_html = over_grids(html, StringType())
flattened = over_grids(flatten, ArrayType(RECORD))
inline_block = over_grids(block, StringType())
