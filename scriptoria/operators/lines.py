"""Spatial operators on the flat table of lines (doc_id, line_no, text, left, top, right, bottom, score).

Anchors are rows of lines. Look-ups of a few anchors join on doc_id, so a page's lines meet in one task; pages are bounded by what a recogniser finds on an image. Where every line is an anchor, `nearest_of_every_line` sweeps
sorted windows and makes no pairs; it shuffles lines, and bands of them, so pages that are still held as arrays go through `layout.nearest_of_every_line`, which shuffles nothing. Scans of many pages under one doc_id carry `page`: `reading_order_of_pages` and `doc_metrics` deal one document's lines to many tasks, `reading_order_of_layouts` its pages, held as arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.layout import Test, without_prefix
from ..functions.text import strip, text

READING = ("top", "left", "line_no")
COLUMNS = ("line_no", "text", "left", "top", "right", "bottom")


def with_geometry(lines: DataFrame) -> DataFrame:
    return lines.withColumns({"width": F.col("right") - F.col("left"), "height": F.col("bottom") - F.col("top"), "center_x": (F.col("left") + F.col("right")) / 2.0, "center_y": (F.col("top") + F.col("bottom")) / 2.0})


def reading_order(lines: DataFrame) -> DataFrame:
    """lines with their place on the page, from 1."""
    return lines.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(*READING)))


def full_text(lines: DataFrame) -> DataFrame:
    """doc_id and the page's texts, joined in reading order."""
    held = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*READING, "text"))).alias("x"))
    return held.select("doc_id", F.array_join(F.transform("x", lambda x: x["text"]), "").alias("full_text"))


def to_layouts(lines: DataFrame) -> DataFrame:
    """The nested form of flat lines: one shuffle on doc_id."""
    return lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*READING, "right", "bottom", "text", "score"))).alias("lines"))


def find_all(lines: DataFrame, keyword: str) -> DataFrame:
    return lines.filter(F.col("text").contains(keyword))


def _first(rows: DataFrame, *order: str) -> DataFrame:
    """One row for each doc_id; partial results before the shuffle."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy("doc_id").agg(F.min_by(whole, F.struct(*order)).alias("x")).select(*[F.col(f"x.{c}") for c in rows.columns])


def find(lines: DataFrame, keyword: str) -> DataFrame:
    """The first line with keyword of each page."""
    return _first(find_all(lines, keyword), *READING)


def find_any(lines: DataFrame, *keywords: str) -> DataFrame:
    """The first line of the first keyword that a page has."""
    rank = F.coalesce(*[F.when(F.col("text").contains(k), i) for i, k in enumerate(keywords)])
    each = lines.select("*", F.explode(F.array(*[F.when(F.col("text").contains(k), i) for i, k in enumerate(keywords)])).alias("__k")).filter(rank.isNotNull() & F.col("__k").isNotNull())
    return _first(each, "__k", *READING).drop("__k")


def _met(lines: DataFrame, anchors: DataFrame, on: Column) -> DataFrame:
    a = anchors.select("doc_id", *[F.col(c).alias(f"anchor_{c}") for c in COLUMNS if c != "text"])
    return lines.join(a, "doc_id").filter(on)


def _level(tol: float) -> Column:
    mid = lambda a, b: (F.col(a) + F.col(b)) / 2.0
    return F.abs(mid("top", "bottom") - mid("anchor_top", "anchor_bottom")) <= tol


def same_row(lines: DataFrame, anchors: DataFrame, tol: float = 20) -> DataFrame:
    return _met(lines, anchors, _level(tol))


def right_of(lines: DataFrame, anchors: DataFrame, tol: float = 20) -> DataFrame:
    return _met(lines, anchors, (F.col("left") > F.col("anchor_right")) & _level(tol))


def left_of(lines: DataFrame, anchors: DataFrame, tol: float = 20) -> DataFrame:
    return _met(lines, anchors, (F.col("right") < F.col("anchor_left")) & _level(tol))


def below(lines: DataFrame, anchors: DataFrame) -> DataFrame:
    return _met(lines, anchors, F.col("top") > F.col("anchor_bottom"))


def above(lines: DataFrame, anchors: DataFrame) -> DataFrame:
    return _met(lines, anchors, F.col("bottom") < F.col("anchor_top"))


def _nearest(rows: DataFrame, *order: Column) -> DataFrame:
    """For each anchor the row that comes first."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy("doc_id", "anchor_line_no").agg(F.min_by(whole, F.struct(*order, *READING)).alias("x")).select(*[F.col(f"x.{c}") for c in rows.columns])


def nearest_below(lines: DataFrame, anchors: DataFrame) -> DataFrame:
    return _nearest(below(lines, anchors), (F.col("top") - F.col("anchor_bottom")).alias("dy"), F.abs(F.col("left") - F.col("anchor_left")).alias("dx"))


def nearest_above(lines: DataFrame, anchors: DataFrame) -> DataFrame:
    return _nearest(above(lines, anchors), (F.col("anchor_top") - F.col("bottom")).alias("dy"), F.abs(F.col("left") - F.col("anchor_left")).alias("dx"))


def nearest_right(lines: DataFrame, anchors: DataFrame, tol: float = 20) -> DataFrame:
    return _nearest(right_of(lines, anchors, tol), F.col("left").alias("dl"))


def same_row_right(lines: DataFrame, anchors: DataFrame, tol: float = 20) -> DataFrame:
    beyond = (F.col("left") + F.col("right") > F.col("anchor_left") + F.col("anchor_right")) & (F.col("right") > F.col("anchor_left"))
    return _met(lines, anchors, (F.col("line_no") != F.col("anchor_line_no")) & _level(tol) & beyond)


def blocks_below(lines: DataFrame, anchors: DataFrame, most: int = 5, reach: int = 100) -> DataFrame:
    """The first `most` lines from each anchor's bottom on, within `reach` and overlapping its columns, with their rank."""
    inside = (F.col("top") >= F.col("anchor_bottom")) & (F.col("top") < F.col("anchor_bottom") + reach) & (F.col("left") < F.col("anchor_right")) & (F.col("right") > F.col("anchor_left"))
    order = Window.partitionBy("doc_id", "anchor_line_no").orderBy(*READING)
    return _met(lines, anchors, inside).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def boundary_top(lines: DataFrame, anchors: DataFrame, keyword: str) -> DataFrame:
    """For each anchor the top of the next line with keyword below its top, else the page's height."""
    next_top = F.min(F.when((F.col("top") > F.col("anchor_top")) & F.col("text").contains(keyword), F.col("top")))
    return _met(lines, anchors, F.lit(True)).groupBy("doc_id", "anchor_line_no").agg(F.least(F.coalesce(next_top, F.max("bottom")), F.max("bottom")).alias("bound"))


def doc_metrics(lines: DataFrame) -> DataFrame:
    """Extent and the whole part of the exact median line height of each document.

    Lines are counted by height in the tasks first, so a document of any number of lines is a histogram before it meets in one place, and the median is read off the running counts.
    """
    heights = lines.groupBy("doc_id", F.greatest(F.lit(1), F.col("bottom") - F.col("top")).alias("h")).agg(F.count("*").alias("n"), F.max("right").alias("right"), F.max("bottom").alias("bottom"))
    of = Window.partitionBy("doc_id")
    counted = heights.withColumns({"upto": F.sum("n").over(of.orderBy("h").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(of)})
    middle = lambda i: F.min(F.when(F.col("upto") > F.expr(i), F.col("h")))
    median = (middle("(total - 1) div 2") + middle("total div 2")) / F.lit(2.0)
    return counted.groupBy("doc_id").agg(F.max("right").alias("doc_width"), F.max("bottom").alias("doc_height"), median.cast("int").alias("base_h"))


def reading_order_of_pages(lines: DataFrame) -> DataFrame:
    """lines (doc_id, page, ...) with their place in the document, from 1, in the order of pages and on each page of reading.

    Lines are counted by page and top in the tasks first. Prefix sums of the counts, over pages and then over a page's tops, give what comes before each top; only lines of one top of one page are sorted in one place. So a
    document of any number of lines is dealt to many tasks, and none gets more than its pages and the lines of one top.
    """
    tops = lines.groupBy("doc_id", "page", "top").agg(F.count("*").alias("n"))
    earlier = lambda keys, order: F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    on_page = tops.withColumn("above", earlier(["doc_id", "page"], "top"))
    pages = tops.groupBy("doc_id", "page").agg(F.sum("n").alias("n")).select("doc_id", "page", earlier(["doc_id"], "page").alias("before"))
    offsets = on_page.join(pages, ["doc_id", "page"]).select("doc_id", "page", "top", (F.col("above") + F.col("before")).alias("__before"))
    ranked = lines.withColumn("__rank", F.row_number().over(Window.partitionBy("doc_id", "page", "top").orderBy("left", "line_no")))
    placed = ranked.join(offsets, ["doc_id", "page", "top"]).withColumn("place", (F.col("__before") + F.col("__rank")).cast("long"))
    return placed.select(*lines.columns, "place")


def reading_order_of_layouts(layouts: DataFrame, *columns: str) -> DataFrame:
    """doc_id, page, the named fields of the lines, and their place in the document, from 1: of pages (doc_id, page, lines) held as arrays in reading order.

    A page is dealt by document and page, whole and packed to the fields it takes; rows of one page are merged there. Counts are read off the same packed pages, so these are made and shuffled once, and only the counts meet by document.
    """
    fields = tuple(dict.fromkeys((*READING, *columns)))
    there = (F.size("lines") > 0) & F.col("doc_id").isNotNull() & F.col("page").isNotNull()  # as the join asks for, so that both its sides are one shuffle
    packed = layouts.filter(there).select("doc_id", "page", F.struct(*[F.col("lines")[c].alias(c) for c in fields]).alias("__p"))
    whole = packed.groupBy("doc_id", "page").agg(F.collect_list("__p").alias("__p"))
    n = F.aggregate("__p", F.lit(0).cast("long"), lambda total, p: total + F.size(p["line_no"]))
    earlier = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    counts = whole.select("doc_id", "page", n.alias("n")).select("doc_id", "page", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"))
    unpacked = F.flatten(F.transform("__p", lambda p: F.arrays_zip(*[p[c].alias(c) for c in fields])))
    merged = F.when(F.size("__p") == 1, unpacked).otherwise(F.array_sort(unpacked))
    each = whole.join(counts, ["doc_id", "page"]).select("doc_id", "page", "__before", F.posexplode(merged).alias("__at", "__x"))
    return each.select("doc_id", "page", *[F.col("__x")[c].alias(c) for c in columns], (F.col("__before") + F.col("__at") + 1).cast("long").alias("place"))


def _last(value: Column, keys: list[str], *order: Column) -> Column:
    """The last value that isn't null up to a row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


FOUND = ("top", "left", "line_no", "text")


def _swept(lines: DataFrame, edge: str, facing: str, sign: int) -> DataFrame:
    """For every line, as an anchor, the first line beyond its edge: by the distance of the facing edge, then of the left ones, then in reading order. sign: 1 where greater coordinates are beyond, -1 where smaller.

    A first sweep along the page finds for each anchor the nearest facing edge beyond; a second one, among the lines that share that edge, the nearest ones to the left and to the right.
    """
    row = F.struct(*[F.col(c) for c in FOUND]).alias("x")
    each = lines.select("doc_id", F.col(facing).alias("level"), F.col("left").alias("at"), row, F.lit(1).alias("is_line"), F.lit(None).cast("int").alias("anchor_line_no"))
    asked = lines.select("doc_id", F.col(edge).alias("level"), F.col("left").alias("at"), F.lit(None).cast(each.schema["x"].dataType).alias("x"), F.lit(0).alias("is_line"), F.col("line_no").alias("anchor_line_no"))
    level = _last(F.when(F.col("is_line") == 1, F.col("level")), ["doc_id"], F.col("level") * -sign, F.col("is_line"))  # from beyond towards the anchor, which comes first where they are level
    reached = each.unionByName(asked).withColumn("level", level).filter((F.col("is_line") == 0) & F.col("level").isNotNull())
    met, keys = each.unionByName(reached), ["doc_id", "level"]
    tail = [F.desc("is_line"), F.desc("x.top"), F.desc("x.line_no")]  # of lines at one place the first in reading order is the last to be passed
    sides = met.withColumns({"before": _last(F.col("x"), keys, F.asc("at"), *tail), "after": _last(F.col("x"), keys, F.desc("at"), *tail)}).filter("is_line = 0")
    by = lambda s: F.when(F.col(s).isNotNull(), F.struct(F.abs(F.col(f"{s}.left") - F.col("at")).alias("dx"), F.col(s).alias("x")))
    return sides.select("doc_id", "anchor_line_no", F.least(by("before"), by("after"))["x"].alias("x"))


def _bands(low: Column, high: Column, levels: int) -> Column:
    """The fewest bands (level, at), of heights that are powers of two at places that are multiples of them, that together are the whole numbers from low to high."""
    band = lambda k, at: F.array(F.struct(k.alias("level"), at.alias("at")))
    none = F.array().cast("array<struct<level: int, at: int>>")
    odd = lambda x: x.bitwiseAND(F.lit(1)) == 1

    def step(s: Column, k: Column) -> Column:
        inside = s["l"] < s["r"]
        up, down = inside & odd(s["l"]), inside & odd(s["r"])
        taken = F.concat(s["bands"], F.when(up, band(k, s["l"])).otherwise(none), F.when(down, band(k, s["r"] - 1)).otherwise(none))
        half = lambda x: F.shiftright(x, 1)
        return F.struct(half(F.when(up, s["l"] + 1).otherwise(s["l"])).alias("l"), half(F.when(down, s["r"] - 1).otherwise(s["r"])).alias("r"), taken.alias("bands"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(levels - 1)), F.struct(low.alias("l"), (high + 1).alias("r"), none.alias("bands")), step, lambda s: s["bands"])


def _swept_right(lines: DataFrame, tol: int) -> DataFrame:
    """For every line, as an anchor, the first line to its right on its row.

    Twice a centre's height is a whole number. A line stands in one band of each height that is a power of two; an anchor's row is a few whole bands, in each of which one sweep from right to left finds its neighbour.
    """
    twice, levels = F.col("top") + F.col("bottom"), (4 * tol + 1).bit_length() + 1
    row = F.struct(F.col("left"), F.col("top"), F.col("line_no"), F.col("text")).alias("x")
    each = lines.select("doc_id", twice.cast("int").alias("y2"), row).select("doc_id", F.expr(f"explode(transform(sequence(0, {levels - 1}), k -> struct(k AS level, shiftright(y2, k) AS at)))").alias("band"), "x")
    each = each.select("doc_id", "band.level", "band.at", F.col("x.left").alias("edge"), "x", F.lit(1).alias("is_line"), F.lit(None).cast("int").alias("anchor_line_no"))
    asked = lines.select("doc_id", F.explode(_bands((twice - 2 * tol).cast("int"), (twice + 2 * tol).cast("int"), levels)).alias("band"), F.col("right").alias("edge"), F.col("line_no").alias("anchor_line_no"))
    asked = asked.select("doc_id", "band.level", "band.at", "edge", F.lit(None).cast(each.schema["x"].dataType).alias("x"), F.lit(0).alias("is_line"), "anchor_line_no")
    found = _last(F.col("x"), ["doc_id", "level", "at"], F.desc("edge"), F.asc("is_line"), F.desc("x.top"), F.desc("x.line_no"))
    met = each.unionByName(asked).withColumn("x", found).filter("is_line = 0 AND x IS NOT NULL")
    return met.groupBy("doc_id", "anchor_line_no").agg(F.min("x").alias("x"))


def nearest_of_every_line(lines: DataFrame, where: str, tol: int = 20) -> DataFrame:
    """doc_id, anchor_line_no, line_no and text: for every line the nearest one `below`, `above` or to the `right` of it, if there is any. No pairs of lines are made: sorted windows with running values, O(n log n) a document."""
    found = _swept_right(lines, tol) if where == "right" else _swept(lines, *{"below": ("bottom", "top", 1), "above": ("top", "bottom", -1)}[where])
    return found.select("doc_id", "anchor_line_no", "x.line_no", "x.text")


def row_sequence(blocks: DataFrame, gap: Column | float, skip: tuple[str, ...] = (), prefixes: tuple[str, ...] = ()) -> DataFrame:
    """The blocks of each anchor's row (doc_id, anchor_line_no, ...) from left to right up to the first gap that is too wide, with what is left of their texts as `part`.

    Each block is measured from the right edge of the one before, whether that one is taken, blank or skipped; from the first gap on the running flag is set.
    """
    order = Window.partitionBy("doc_id", "anchor_line_no").orderBy("left", "top", "line_no")
    gap = gap if isinstance(gap, Column) else F.lit(gap)
    marked = blocks.withColumn("__raw", strip("text"))
    marked = marked.withColumn("__wide", F.coalesce((F.col("__raw") != "") & (F.col("left") - F.lag("right").over(order) > gap), F.lit(False)))
    marked = marked.withColumns({"__over": F.max("__wide").over(order.rowsBetween(Window.unboundedPreceding, 0)), "part": without_prefix(F.col("__raw"), prefixes)})
    fits = ~F.col("__over") & (F.col("__raw") != "") & (F.col("part") != "")
    return marked.filter(fits & ~F.col("__raw").isin(*skip) if skip else fits).drop("__raw", "__wide", "__over")


def continuation(blocks: DataFrame, bottom: Column, stops: Test, skips: Test, gap: Column, clean: Test = lambda t: t, running_max: bool = False) -> DataFrame:
    """The blocks under each anchor's first line (doc_id, anchor_line_no, ...) down to a stop or too wide a gap, with their cleaned texts as `part`.

    Up to the first stop every block that has anything left is taken, so the bottom that a block is measured from is the running last, or largest, bottom of those before it; from the first stop on the running flag is set.
    """
    order = Window.partitionBy("doc_id", "anchor_line_no").orderBy(*READING)
    x = F.struct(*[F.col(c) for c in ("top", "left", "line_no", "right", "bottom", "text")])
    marked = blocks.withColumn("__raw", strip(text("text")))
    marked = marked.withColumn("part", F.when((F.col("__raw") != "") & ~skips(x), clean(F.col("__raw"))).otherwise(""))
    own, earlier = F.when(F.col("part") != "", F.col("bottom")), order.rowsBetween(Window.unboundedPreceding, -1)
    low = F.greatest(bottom, F.max(own).over(earlier)) if running_max else F.coalesce(F.last(own, ignorenulls=True).over(earlier), bottom)
    marked = marked.withColumn("__low", low)
    marked = marked.withColumn("__stop", (F.col("__raw") != "") & (stops(x) | (F.col("top") - F.col("__low") > gap)))
    marked = marked.withColumn("__over", F.max("__stop").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.filter(~F.col("__over") & (F.col("part") != "")).drop("__raw", "__low", "__stop", "__over")


def joined(parts: DataFrame, order: tuple[str, ...] = READING, between: str = "") -> DataFrame:
    """doc_id and the parts of its rows joined in order."""
    held = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*order, "part"))).alias("p"))
    return held.select("doc_id", F.array_join(F.transform("p", lambda p: p["part"]), between).alias("joined"))


def all_pairs_same_row(lines: DataFrame, tol: int = 20) -> DataFrame:
    """(doc_id, a, b) of all ordered pairs of lines on a row. Lines meet in bands of height tol, so a page's pairs are only looked at between neighbouring bands."""
    mid = (F.col("top") + F.col("bottom")) / 2.0
    band = F.floor(mid / tol)
    left = lines.select("doc_id", F.col("line_no").alias("a"), mid.alias("ya"), F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    right = lines.select("doc_id", F.col("line_no").alias("b"), mid.alias("yb"), band.alias("band"))
    return left.join(right, ["doc_id", "band"]).filter((F.abs(F.col("ya") - F.col("yb")) <= tol) & (F.col("a") != F.col("b"))).select("doc_id", "a", "b")
