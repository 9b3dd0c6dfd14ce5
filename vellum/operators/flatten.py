"""Statistical rows out of tables: roles of columns, numbers and intervals in cells, typed fields, sentences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ordered: the first that matches a header, lower case, is its role.
ROLES: tuple[tuple[str, str], ...] = (
    ("p", r"^(?:p|p[ -]?values?|sig\.?)$"),
    ("df1", r"^(?:df ?1|num(?:erator)? df)$"),
    ("df2", r"^(?:df ?2|den(?:ominator)? df|error df)$"),
    ("df", r"^(?:df|d\.f\.|degrees of freedom)$"),
    ("CI", r"^(?:(?:9[059] ?% ?)?(?:ci|confidence interval)|\[?ll, ?ul\]?)$"),
    ("CI_lower", r"^(?:ll|lower|(?:ci|95% ci)[ _]?lower|lower (?:ci|bound|limit))$"),
    ("CI_upper", r"^(?:ul|upper|(?:ci|95% ci)[ _]?upper|upper (?:ci|bound|limit))$"),
    ("t", r"^t(?:[ -]?(?:values?|stat(?:istic)?|ratio))?$"),
    ("F", r"^f(?:[ -]?(?:values?|ratio))?$"),
    ("chi2", r"^(?:chi2|χ2|χ²|chi[ -]?squared?)$"),
    ("z", r"^z(?:[ -]?values?)?$"),
    ("eta2", r"^(?:partial )?(?:eta2|η2|η²|ηp²|ηp2|eta[ -]?squared)$"),
    ("r", r"^(?:r|pearson'?s? r|correlation)$"),
    ("d", r"^(?:d|cohen'?s? d|hedges'? g|g)$"),
    ("BF01", r"^bf ?01$"),
    ("M", r"^(?:m|means?)$"),
    ("SD", r"^(?:sd|s\.d\.|std\.? ?dev(?:iation)?\.?)$"),
    ("SE", r"^(?:se|s\.e\.|std\.? ?err(?:or)?\.?)$"),
    ("n", r"^(?:n|sample size)$"),
    ("est", r"^(?:b|β|beta|estimate|coef(?:ficient)?\.?|or|rr|hr|effect(?: size)?)$"),
)
LEADING = r"^[^0-9.+−-]*([+−-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))"
PAIR = r"([+−-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)) *(?:,|;|to|–|—) *([+−-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def role(header: Column) -> Column:
    """The role of a column by its header; of a folded header, parts joined by ``||``, the last part that has one."""

    def one(h: Column) -> Column:
        h = F.lower(F.trim(h))
        out = F.when(h.rlike(ROLES[0][1]), ROLES[0][0])
        for name, pattern in ROLES[1:]:
            out = out.when(h.rlike(pattern), name)
        return out

    parts = F.reverse(F.split(header, r"\|\|"))
    return F.get(F.filter(F.transform(parts, one), lambda r: r.isNotNull()), F.lit(0))


def number(cell: Column) -> Column:
    """The first number of a cell, stars, symbols and letters before it aside; null without one."""
    shown = F.translate(F.regexp_extract(F.trim(cell), LEADING, 1), "−", "-")
    return shown.try_cast("double")


def p_value(cell: Column) -> Column:
    """``struct(op, value)``: ``<.001`` is '<' and 0.001; a bare value has '='; values outside 0 .. 1 are null."""
    op = F.coalesce(F.nullif(F.regexp_extract(cell, r"([<>=≤≥])", 1), F.lit("")), F.lit("="))
    return let(number(F.regexp_replace(cell, r"(?i)^\s*p", "")), lambda v: F.when(v.between(0, 1), F.struct(op.alias("op"), v.alias("value"))))


HYPHENED = r"^\s*[\[(]?\s*([-−]?)((?:[0-9]+\.?[0-9]*|\.[0-9]+))\s*[-−]\s*([-−]?)((?:[0-9]+\.?[0-9]*|\.[0-9]+))\s*[\])]?\s*$"


def interval(cell: Column, est: Column | None = None) -> Column:
    """``struct(lower, upper)`` of the last bracketed pair of a cell, or of the pair that is the whole cell; lower <= upper.

    A hyphen between the bounds may be a sign: of the readings, the written one first, the first that ascends and holds ``est`` counts.
    """
    inner = F.try_element_at(F.regexp_extract_all(cell, F.lit(r"[\[(]([^\[\]()]*)[\])]"), F.lit(1)), F.lit(-1))
    bound = lambda body, k: F.translate(F.regexp_extract(body, PAIR, k), "−", "-").try_cast("double")
    pair = let(F.coalesce(inner, cell), lambda body: F.struct(bound(body, 1).alias("lower"), bound(body, 2).alias("upper")))

    def hyphened(body: Column) -> Column:
        part = lambda k: F.regexp_extract(body, HYPHENED, k)
        size = lambda k: part(k).try_cast("double")
        sign = lambda k: F.when(part(k) == "", 1.0).otherwise(-1.0)
        read = [F.struct((a * size(2)).alias("lower"), (c * size(4)).alias("upper")) for a in (sign(1), F.lit(1.0), F.lit(-1.0)) for c in (sign(3), F.lit(1.0), F.lit(-1.0))]
        good = lambda r: (r["lower"] < r["upper"]) & (F.lit(True) if est is None else F.coalesce(est.between(r["lower"], r["upper"]), F.lit(True)))
        return F.when(body.rlike(HYPHENED), F.get(F.filter(F.array(*read), good), F.lit(0)))

    return let(pair, lambda c: F.when(c["lower"].isNull(), let(F.coalesce(inner, cell), hyphened)).when(c["lower"] <= c["upper"], c))


def upper_with_sign(est: Column, lower: Column, upper: Column) -> Column:
    """The upper bound with the minus it lost: negated where only that makes the interval about symmetric round the estimate."""
    fits = (est < 0) & (lower < 0) & (upper > 0) & (lower < -upper) & (-upper > est) & (F.abs((-upper - est) - (est - lower)) < 0.5 * (est - lower))
    return F.when(fits, -upper).otherwise(upper)


#: Field, test it must pass.
GUARDS = {"t": None, "F": lambda v: v >= 0, "chi2": lambda v: v >= 0, "z": None, "r": lambda v: v.between(-1, 1), "d": None, "eta2": lambda v: v.between(0, 1), "M": None, "SD": lambda v: v >= 0, "SE": lambda v: v >= 0, "est": None, "BF01": lambda v: v >= 0, "n": lambda v: (v > 0) & (v == F.floor(v)), "df": lambda v: v > 0, "df1": lambda v: v > 0, "df2": lambda v: v > 0}
FIELDS = (*GUARDS, "p_op", "p", "CI_lower", "CI_upper")


def fields(cells: Column) -> Column:
    """Typed fields of one row from an array of ``struct(role, text)``: the first cell of each role; what fails its guard is null."""
    parts = lambda cs: F.struct(cs["role"].alias("roles"), cs["text"].alias("texts"))

    def raw(p: Column) -> Column:
        cell = lambda r: F.get(p["texts"], (F.array_position(p["roles"], F.lit(r)) - 1).cast("int"))
        return F.struct(*(number(cell(n)).alias(n) for n in (*GUARDS, "CI_lower", "CI_upper")), p_value(cell("p")).alias("p"), cell("CI").alias("CI"))

    def typed(r: Column) -> Column:
        ci = F.when(r["CI"].isNotNull(), interval(r["CI"], F.coalesce(r["est"], r["d"], r["r"])))
        est = F.coalesce(r["est"], r["d"], r["r"])
        bounds = lambda i: F.struct(F.coalesce(i["lower"], r["CI_lower"]).alias("lo"), F.coalesce(i["upper"], r["CI_upper"]).alias("hi"))
        signed = lambda c: F.struct(c["lo"].alias("lo"), F.when(est.isNotNull(), upper_with_sign(est, c["lo"], c["hi"])).otherwise(c["hi"]).alias("hi"))
        good = let(let(let(ci, bounds), signed), lambda c: F.when(c["lo"] <= c["hi"], c))
        value = lambda n: (r[n] if GUARDS[n] is None else F.when(GUARDS[n](r[n]), r[n])).alias(n)
        return let(good, lambda c: F.struct(*map(value, GUARDS), r["p"]["op"].alias("p_op"), r["p"]["value"].alias("p"), c["lo"].alias("CI_lower"), c["hi"].alias("CI_upper")))

    return let(let(let(cells, parts), raw), typed)


def shown(v: Column) -> Column:
    """A number with up to six decimals and no trailing zeros."""
    return F.rtrim(F.rtrim(F.format_string("%.6f", v), F.lit("0")), F.lit("."))


def bare(v: Column) -> Column:
    """The same without the zero before the point: for p and r."""
    return F.regexp_replace(shown(v), r"^(-?)0\.", "$1.")


def sentence(label: Column, f: Column) -> Column:
    """``Recall: t(38) = 2.5, p < .05, d = 0.8``: the parts whose fields are there; null without any part."""
    return let(f, lambda g: let(_parts(g), lambda body: F.when(body != "", F.concat(F.when(F.coalesce(label, F.lit("")) != "", F.concat(label, F.lit(": "))).otherwise(""), body))))


def _parts(f: Column) -> Column:
    eq = lambda name, text: F.when(f[name].isNotNull(), F.concat(F.lit(f"{name} = "), text(f[name])))
    t = F.when(f["t"].isNotNull(), F.concat(F.lit("t"), F.when(f["df"].isNotNull(), F.concat(F.lit("("), shown(f["df"]), F.lit(")"))).otherwise(""), F.lit(" = "), shown(f["t"])))
    fs = F.when(f["F"].isNotNull(), F.concat(F.lit("F"), F.when(f["df1"].isNotNull() & f["df2"].isNotNull(), F.concat(F.lit("("), shown(f["df1"]), F.lit(", "), shown(f["df2"]), F.lit(")"))).otherwise(""), F.lit(" = "), shown(f["F"])))
    p = F.when(f["p"].isNotNull(), F.concat(F.lit("p "), f["p_op"], F.lit(" "), bare(f["p"])))
    ci = F.when(f["CI_lower"].isNotNull() & f["CI_upper"].isNotNull(), F.concat(F.lit("95% CI ["), shown(f["CI_lower"]), F.lit(", "), shown(f["CI_upper"]), F.lit("]")))
    return F.concat_ws(", ", eq("M", shown), eq("SD", shown), eq("n", shown), eq("est", shown), t, fs, eq("chi2", shown), eq("z", shown), eq("r", bare), p, eq("d", shown), eq("eta2", bare), ci)


def arms(cell: Column) -> Column:
    """The numbers packed in one cell, in order: the arms of a folded header."""
    return F.transform(F.regexp_extract_all(cell, F.lit(r"([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))"), F.lit(1)), lambda s: s.try_cast("double"))
