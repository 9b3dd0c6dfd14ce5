"""Corpus checks: similarity of two versions of a text, passages that were lost, lint, verdicts compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a benchmark's n-grams may be broadcast as, in rows.
BROADCAST_ROWS = 2_000_000
#: Ordered: the first that matches a rendered line is its tag.
LINT: tuple[tuple[str, str], ...] = (
    ("replacement_char", "�"),
    ("ligature", "[ﬀ-ﬆ]"),
    ("private_use", "[-]"),
    ("empty_heading", r"^#{1,6}\s*$"),
    ("spaced_letters", r"(?:^| )(?:[A-Za-z] ){5,}"),
    ("page_number", r"^\s*[0-9]{1,4}\s*$"),
    ("hyphen_end", r"[a-z]-$"),
)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"(?U)[^\p{L}\p{N}]+"), lambda w: w != "")


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct words of two texts; 1 for two texts without words."""
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    both = F.size(F.array_union(x, y))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / both)


def char_ratio(a: Column, b: Column) -> Column:
    return F.when(F.length(b) > 0, F.length(a) / F.length(b))


def same_words(a: Column, b: Column, least: int = 2) -> Column:
    """Whether two texts have the same words of two letters or more, each as often, in whatever order."""
    bag = lambda t: F.array_sort(F.regexp_extract_all(F.lower(t), F.lit(r"(?U)([\p{L}]{" + str(least) + r",})"), F.lit(1)))
    return bag(a) == bag(b)


def grams(w: Column, n: int = 8) -> Column:
    """n-grams of an array of words; none for fewer words. ``w`` is a column of its own, as it is read once for each gram."""
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))


def survival(items: DataFrame, docs: DataFrame, item_id: str = "item_id", n: int = 8) -> DataFrame:
    """Of each item its distinct n-grams and how many of them some document holds.

    The items' n-grams are broadcast while they are few, so the documents' aren't shuffled before they have matched.
    """
    want = items.select(item_id, words(F.col("text")).alias("w")).select(item_id, F.explode(F.array_distinct(grams(F.col("w"), n))).alias("g"))
    keys = want.select("g").distinct()
    small = keys.count() <= BROADCAST_ROWS
    each = docs.select(words(F.col("text")).alias("w")).select(F.explode(grams(F.col("w"), n)).alias("g"))
    have = each.join(F.broadcast(keys) if small else keys, "g", "left_semi").distinct().withColumn("found", F.lit(1))
    return want.join(have, "g", "left").groupBy(item_id).agg(F.count("*").alias("n_grams"), F.count("found").alias("n_found"))


def lint(line: Column) -> Column:
    """The tag of a rendered line, null for a clean one."""
    out = F.when(line.rlike(LINT[0][1]), LINT[0][0])
    for tag, pattern in LINT[1:]:
        out = out.when(line.rlike(pattern), tag)
    return out


def verdicts_changed(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """``gone``, ``new``, ``changed`` or ``same`` for each key of two tables of ``verdict``."""
    b, a = before.select(key, F.col("verdict").alias("was")), after.select(key, F.col("verdict").alias("now"))
    change = F.when(F.col("now").isNull(), "gone").when(F.col("was").isNull(), "new").when(F.col("was") != F.col("now"), "changed").otherwise("same")
    return b.join(a, key, "full_outer").select(key, change.alias("change"))


def unique_repair(tokens: Column, other: Column) -> Column:
    """Tokens with U+FFFD replaced by the only token of the other channel that fits, where exactly one does."""
    fits = lambda t, o: F.regexp_like(o, F.concat(F.lit("^"), F.replace(F.regexp_replace(t, r"([.\\+*?\[\]^$(){}|])", r"\\$1"), F.lit("�"), F.lit(".")), F.lit("$")))

    def one(t: Column) -> Column:
        found = F.array_distinct(F.filter(other, lambda o: fits(t, o)))
        return F.when(t.contains("�") & (F.size(found) == 1), F.get(found, F.lit(0))).otherwise(t)

    return F.transform(tokens, one)
