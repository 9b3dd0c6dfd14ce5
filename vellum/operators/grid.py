"""Tables as cells: dense grids, confidence, HTML, cells from characters and rules, regions and their captions.

Cells are rows ``(…key, r, c, text, is_header)``. A table's cells are few, so what groups them by table is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SNAP = 2.0


def dense(cells: DataFrame, *key: str) -> DataFrame:
    """One row for each table row: ``values``, the texts of columns 0 .. n - 1 with '' in the gaps; the first writer of a cell wins, of several at once the least text."""
    w = Window.partitionBy(*key, "r", "c").orderBy("ord", "text")
    one = cells.withColumn("__n", F.row_number().over(w)).where("__n = 1")
    rows = one.groupBy(*key, "r").agg(F.map_from_entries(F.collect_list(F.struct("c", "text"))).alias("m"), F.max("c").alias("last"))
    n = F.max("last").over(Window.partitionBy(*key)) + 1
    return rows.withColumn("n_cols", n.cast("int")).withColumn("values", F.transform(F.sequence(F.lit(0), F.col("n_cols") - 1), lambda c: F.coalesce(F.col("m")[c], F.lit("")))).drop("m", "last")


def confidence(cells: DataFrame, *key: str, lattice: bool = True) -> DataFrame:
    """0.85 (lattice, clamped to 0.5 .. 0.95) or 0.65 (0.4 .. 0.85), less 0.05 for each row off the commonest width."""
    base, low, high = (0.85, 0.5, 0.95) if lattice else (0.65, 0.4, 0.85)
    widths = cells.groupBy(*key, "r").agg(F.count("*").alias("w"))
    counts = widths.groupBy(*key, "w").agg(F.count("*").alias("n"))
    modal = counts.groupBy(*key).agg(F.max_by("w", F.struct("n", "w")).alias("modal"))
    off = widths.join(modal, list(key)).groupBy(*key).agg(F.sum((F.col("w") != F.col("modal")).cast("int")).alias("off"), F.first("modal").alias("modal"))
    return off.select(*key, F.col("modal").cast("long"), F.round(F.least(F.lit(high), F.greatest(F.lit(low), base - 0.05 * F.col("off"))), 4).alias("confidence"))


def escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def html(cells: DataFrame, *key: str) -> DataFrame:
    """Each table as HTML, header cells as ``th``; tables of fewer than two rows are empty."""
    tag = F.when(F.col("is_header"), "th").otherwise("td")
    cell = F.concat(F.lit("<"), tag, F.lit(">"), escape(F.coalesce("text", F.lit(""))), F.lit("</"), tag, F.lit(">"))
    rows = cells.withColumn("cell", cell).groupBy(*key, "r").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "cell"))), lambda s: s["cell"]), "").alias("cells"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "cells"))), lambda s: F.concat(F.lit("<tr>"), s["cells"], F.lit("</tr>"))), "")
    return rows.groupBy(*key).agg(F.when(F.count("*") < 2, "").otherwise(F.concat(F.lit("<table>"), body, F.lit("</table>"))).alias("html"))


def bands(values: Column, gap: float = SNAP) -> Column:
    """Sorted positions clustered where neighbours are at most ``gap`` apart, as the mean of each cluster."""
    start = F.struct(F.array().cast("array<double>").alias("out"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(None).cast("double").alias("last"))

    def step(s: Column, v: Column) -> Column:
        new = s["last"].isNotNull() & (v - s["last"] > gap)
        return F.struct(
            F.when(new, F.concat(s["out"], F.array(s["sum"] / s["n"]))).otherwise(s["out"]).alias("out"),
            F.when(new, v).otherwise(s["sum"] + v).alias("sum"),
            F.when(new, F.lit(1)).otherwise(s["n"] + 1).alias("n"),
            v.alias("last"),
        )

    return F.aggregate(F.array_sort(values), start, step, lambda s: F.when(s["n"] > 0, F.concat(s["out"], F.array(s["sum"] / s["n"]))).otherwise(s["out"]))


def lattice_cells(chars: DataFrame, rules: DataFrame, *key: str) -> DataFrame:
    """Texts of the cells that rules enclose: a character lies where its middle falls between neighbouring rules.

    ``chars``: key, x0, x1, top, bottom, text. ``rules``: key, x0, x1, top, bottom; wider than high is horizontal.
    """
    flat = F.col("x1") - F.col("x0") >= F.col("bottom") - F.col("top")
    seps = rules.groupBy(*key).agg(bands(F.collect_list(F.when(flat, (F.col("top") + F.col("bottom")) / 2))).alias("ys"), bands(F.collect_list(F.when(~flat, (F.col("x0") + F.col("x1")) / 2))).alias("xs"))
    seps = seps.where((F.size("ys") >= 2) & (F.size("xs") >= 2))
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    placed = chars.join(seps, list(key)).select(*key, "text", "x0", "top", F.size("ys").alias("ny"), F.size("xs").alias("nx"), (F.size(F.filter("ys", lambda s: s <= y)) - 1).alias("r"), (F.size(F.filter("xs", lambda s: s <= x)) - 1).alias("c"))
    placed = placed.where("r >= 0 AND c >= 0 AND r < ny - 1 AND c < nx - 1")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "x0", "text"))), lambda s: s["text"]), "")
    return placed.groupBy(*key, "r", "c").agg(text.alias("text"))


def row_islands(words: DataFrame, *key: str, factor: float = 1.2, floor: float = 2.0) -> DataFrame:
    """``words`` with row numbers: a new row where a top lies further below the one before than 1.2 upper-median heights."""
    h = F.array_sort(F.collect_list(F.col("bottom") - F.col("top")))
    height = words.groupBy(*key).agg(F.element_at(h, (F.floor(F.size(h) / 2) + 1).cast("int")).alias("h"))
    w = Window.partitionBy(*key).orderBy("top", "x0")
    step = F.when(F.col("top") - F.lag("top").over(w) > F.greatest(F.lit(floor), factor * F.col("h")), 1).otherwise(0)
    out = words.join(height, list(key)).withColumn("__s", step)
    # words at one place are in one row, in whatever order either window takes them
    return out.withColumn("r", F.sum("__s").over(w.rangeBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__s", "h")


def column_votes(rows: DataFrame, *key: str, share: float = 0.6, bucket: float = 8.0) -> DataFrame:
    """Column boundaries: buckets of gap middles that 60 % of the rows of several words have."""
    w = Window.partitionBy(*key, "r").orderBy("x0")
    gaps = rows.withColumn("next", F.lead("x0").over(w)).where("next > x1").withColumn("mid", F.floor((F.col("x1") + F.col("next")) / 2 / bucket).cast("int"))
    several = gaps.groupBy(*key).agg(F.countDistinct("r").alias("rows"))
    votes = gaps.groupBy(*key, "mid").agg(F.countDistinct("r").alias("votes"))
    return votes.join(several, list(key)).where(F.col("votes") >= share * F.col("rows")).select(*key, "mid", "votes")


def inside(items: DataFrame, boxes: DataFrame, *key: str) -> DataFrame:
    """Items whose middle lies in a box of the same key: an equi-join on the page, then the rectangle."""
    b = boxes.select(*key, "box_id", F.col("x0").alias("bx0"), F.col("x1").alias("bx1"), F.col("top").alias("bt"), F.col("bottom").alias("bb"))
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    return items.join(b, list(key)).where((x >= F.col("bx0")) & (x <= F.col("bx1")) & (y >= F.col("bt")) & (y <= F.col("bb"))).drop("bx0", "bx1", "bt", "bb")


def overlap(a: str, b: str) -> Column:
    """Area that two boxes of struct columns share."""
    wide = F.least(F.col(f"{a}.x1"), F.col(f"{b}.x1")) - F.greatest(F.col(f"{a}.x0"), F.col(f"{b}.x0"))
    high = F.least(F.col(f"{a}.bottom"), F.col(f"{b}.bottom")) - F.greatest(F.col(f"{a}.top"), F.col(f"{b}.top"))
    return F.greatest(F.lit(0.0), wide) * F.greatest(F.lit(0.0), high)


def pick_table(auto: DataFrame, region: DataFrame, key: str) -> DataFrame:
    """Of two candidates for a caption the better one; a caption that only one side has keeps it.

    Fewer columns in the region: auto. Region side by side: region. More columns but under 60 % of the filled cells:
    auto, else region. As many columns: the one with more filled cells, ties to the region.
    """
    a = auto.select(key, F.col("n_cols").alias("a_cols"), F.col("filled").alias("a_filled"))
    r = region.select(key, F.col("n_cols").alias("r_cols"), F.col("filled").alias("r_filled"), F.col("side_by_side").alias("side"))
    rule = (
        F.when(F.col("r_cols").isNull(), "auto").when(F.col("a_cols").isNull(), "region").when(F.col("side"), "region").when(F.col("r_cols") < F.col("a_cols"), "auto")
        .when(F.col("r_cols") > F.col("a_cols"), F.when(F.col("r_filled") < 0.6 * F.col("a_filled"), "auto").otherwise("region"))
        .when(F.col("a_filled") > F.col("r_filled"), "auto").otherwise("region")
    )
    return a.join(r, key, "full_outer").select(key, rule.alias("pick"))


def match_captions(tables: DataFrame, captions: DataFrame, *page: str) -> DataFrame:
    """The caption of each table: of those on its page the one that shares most words with it, ties to the first.

    Greedy and one to one, by descending overlap, then position; decided within a page, whose tables are few.
    """
    pairs = tables.join(captions, list(page)).withColumn("shared", F.size(F.array_intersect("table_words", "caption_words"))).where("shared > 0")
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("shared")).alias("s"), "caption_id", "table_id")))
    start = F.struct(F.array().cast("array<long>").alias("ts"), F.array().cast("array<long>").alias("cs"), F.array().cast("array<struct<table_id:long,caption_id:long>>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        taken = F.array_contains(s["ts"], p["table_id"]) | F.array_contains(s["cs"], p["caption_id"])
        one = F.array(F.struct(p["table_id"].cast("long").alias("table_id"), p["caption_id"].cast("long").alias("caption_id")))
        return F.when(taken, s).otherwise(F.struct(F.concat(s["ts"], F.array(p["table_id"].cast("long"))).alias("ts"), F.concat(s["cs"], F.array(p["caption_id"].cast("long"))).alias("cs"), F.concat(s["out"], one).alias("out")))

    return pairs.groupBy(*page).agg(ranked.alias("ranked")).select(*page, F.inline(F.aggregate("ranked", start, step, lambda s: s["out"])))


def figure_boxes(captions: DataFrame, graphics: DataFrame, *page: str, above: float = 400.0, other: float = 200.0) -> DataFrame:
    """The box of the graphics up to 400 points above a caption, else of those up to 400 below, else 200 points above it."""
    g = graphics.select(*page, F.col("x0").alias("gx0"), F.col("x1").alias("gx1"), F.col("top").alias("gt"), F.col("bottom").alias("gb"))
    both = captions.join(g, list(page), "left")
    up = (F.col("gb") <= F.col("top")) & (F.col("gt") >= F.col("top") - above)
    down = (F.col("gt") >= F.col("bottom")) & (F.col("gb") <= F.col("bottom") + above)
    box = lambda on: [F.min(F.when(on, F.col("gx0"))), F.min(F.when(on, F.col("gt"))), F.max(F.when(on, F.col("gx1"))), F.max(F.when(on, F.col("gb")))]
    found = both.groupBy(*page, "caption_id").agg(*(c.alias(f"u{i}") for i, c in enumerate(box(up))), *(c.alias(f"d{i}") for i, c in enumerate(box(down))), F.first("x0").alias("x0"), F.first("x1").alias("x1"), F.first("top").alias("top"))
    rest = [F.col("x0"), F.col("top") - other, F.col("x1"), F.col("top")]
    return found.select(*page, "caption_id", *(F.coalesce(f"u{i}", f"d{i}", rest[i]).alias(n) for i, n in enumerate(("fig_x0", "fig_top", "fig_x1", "fig_bottom"))))
