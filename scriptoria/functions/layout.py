"""Spatial look-ups on one page held as an array of line structs, in reading order. Column functions: no shuffle, O(lines) or a sort a page.

Anchors are line structs; a null anchor finds nothing. Ties go by line_no everywhere.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import LINE
from .text import let, strip, text

Test = Callable[[Column], Column]


def read_lines(texts: Column, scores: Column, boxes: Column, min_score: float = 0.2) -> Column:
    """Lines of parallel arrays in reading order: trimmed, not blank, with the score at least min_score; boxes lose their fractions.

    A line that would be kept but lacks its score, or four whole numbers as its box, has nulls in their place. Where the arrays differ in length, places beyond the shortest lack something.
    """

    def line(b: Column, i: Column) -> Column:
        score = F.get(scores, i)
        at = lambda k: F.when(F.size(b) == 4, F.get(b, k).try_cast("int"))
        shown = F.when(F.coalesce(score >= min_score, F.lit(True)), strip(F.get(texts, i)))
        return F.struct(at(1).alias("top"), at(0).alias("left"), i.cast("int").alias("line_no"), at(2).alias("right"), at(3).alias("bottom"), shown.alias("text"), score.cast("double").alias("score"))

    return F.coalesce(F.array_sort(F.filter(F.transform(boxes, line), lambda x: x["text"] != "")), F.array().cast(f"array<{LINE}>"))


def is_whole(x: Column) -> Column:
    """Whether a line read from arrays has its score and its box."""
    return reduce(lambda p, q: p & q, [x[k].isNotNull() for k in ("score", "top", "left", "right", "bottom")])


def build_lines(texts: Column, scores: Column, boxes: Column, min_score: float = 0.2) -> Column:
    """Lines of parallel arrays, cut to the shortest, in reading order: trimmed, not blank, with the score at least min_score, and with a whole box."""
    return F.filter(read_lines(texts, scores, boxes, min_score), is_whole)


def center_x(a: Column) -> Column:
    return (a["left"] + a["right"]) / F.lit(2.0)


def center_y(a: Column) -> Column:
    return (a["top"] + a["bottom"]) / F.lit(2.0)


def height(a: Column) -> Column:
    return F.greatest(F.lit(1), a["bottom"] - a["top"])


def _sorted(lines: Column, *keys: Callable[[Column], Column]) -> Column:
    keyed = F.transform(lines, lambda x: F.struct(*[k(x).alias(f"k{i}") for i, k in enumerate(keys)], x["line_no"].alias("no"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda y: y["x"])


def _by_left(lines: Column) -> Column:
    return _sorted(lines, lambda x: x["left"], lambda x: x["top"])


def texts_of(lines: Column) -> Column:
    return F.transform(lines, lambda x: x["text"])


def full_text(lines: Column) -> Column:
    return F.array_join(texts_of(lines), "")


def find(lines: Column, keyword: str) -> Column:
    """The first line that contains keyword."""
    return F.get(find_all(lines, keyword), 0)


def find_all(lines: Column, keyword: str) -> Column:
    return F.filter(lines, lambda x: x["text"].contains(keyword))


def find_any(lines: Column, *keywords: str) -> Column:
    """Keyword by keyword: the first line of the first keyword that has one."""
    return F.coalesce(*[find(lines, k) for k in keywords])


def find_contains(lines: Column, *keywords: str) -> Column:
    """Line by line: the first line that contains any keyword."""
    return F.get(F.filter(lines, lambda x: reduce(lambda p, q: p | q, [x["text"].contains(k) for k in keywords])), 0)


def find_exact(lines: Column, *words: str) -> Column:
    return F.get(F.filter(lines, lambda x: x["text"].isin(*words)), 0)


def _level(x: Column, a: Column, tol: Column | float) -> Column:
    return F.abs(center_y(x) - center_y(a)) <= tol


def same_row(lines: Column, a: Column, tol: float = 20) -> Column:
    """Lines on the anchor's row, itself among them, from left to right."""
    return _by_left(F.filter(lines, lambda x: _level(x, a, tol)))


def right_of(lines: Column, a: Column, tol: float = 20) -> Column:
    return _by_left(F.filter(lines, lambda x: (x["left"] > a["right"]) & _level(x, a, tol)))


def left_of(lines: Column, a: Column, tol: float = 20) -> Column:
    return _by_left(F.filter(lines, lambda x: (x["right"] < a["left"]) & _level(x, a, tol)))


def below(lines: Column, a: Column) -> Column:
    return F.array_sort(F.filter(lines, lambda x: x["top"] > a["bottom"]))


def above(lines: Column, a: Column) -> Column:
    return F.array_sort(F.filter(lines, lambda x: x["bottom"] < a["top"]))


def _least(lines: Column, *keys: Callable[[Column], Column]) -> Column:
    """The line that comes first by the keys, then in reading order."""
    return F.array_min(F.transform(lines, lambda x: F.struct(*[k(x).alias(f"k{i}") for i, k in enumerate(keys)], x.alias("x"))))["x"]


def nearest_below(lines: Column, a: Column) -> Column:
    return _least(F.filter(lines, lambda x: x["top"] > a["bottom"]), lambda x: x["top"] - a["bottom"], lambda x: F.abs(x["left"] - a["left"]))


def nearest_above(lines: Column, a: Column) -> Column:
    return _least(F.filter(lines, lambda x: x["bottom"] < a["top"]), lambda x: a["top"] - x["bottom"], lambda x: F.abs(x["left"] - a["left"]))


def nearest_right(lines: Column, a: Column, tol: float = 20) -> Column:
    return F.get(right_of(lines, a, tol), 0)


def _first_after(keys: Column, powers: Column, start: Column, passed: Test) -> Column:
    """The first place from start on whose key isn't passed; those that are come first. powers: descending powers of two that together reach the last place."""
    return F.aggregate(powers, start - 1, lambda p, k: F.when(passed(F.get(keys, p + k)), p + k).otherwise(p), lambda p: p + 1)


def _powers(n: Column) -> Column:
    """The descending powers of two up to n; 1 for 0."""
    return F.transform(F.sequence(F.length(F.bin(n)) - 1, F.lit(0), F.lit(-1)), lambda i: F.call_function("shiftleft", F.lit(1), i))


def _found(lines: Column, nearest: Test) -> Column:
    """(anchor_line_no, line_no, text) of every line that has a nearest one."""
    each = F.transform(lines, lambda a: let(nearest(a), lambda x: F.when(x.isNotNull(), F.struct(a["line_no"].alias("anchor_line_no"), x["line_no"].alias("line_no"), x["text"].alias("text")))))
    return F.filter(each, lambda p: p.isNotNull())


def _facing(lines: Column, edge: str, facing: str, down: bool) -> Column:
    """For every line, as an anchor, the nearest one that faces its edge from beyond.

    A key is the facing edge, counted from the anchor on, then left, in one whole number; of lines with one key the first in reading order stands for all. A search finds the nearest edge beyond the anchor's, a second one among its
    lines the neighbours of the anchor's left.
    """
    level = lambda x, c: x[c] if down else F.bitwise_not(x[c])
    key = lambda level, left: F.shiftleft(level.cast("long"), 32).bitwiseOR(left + F.lit(1 << 31))
    each = F.sort_array(F.transform(lines, lambda x: F.struct(key(level(x, facing), x["left"]).alias("key"), x["top"].alias("top"), x["line_no"].alias("line_no"), x["text"].alias("text"))))
    rows = let(each, lambda r: F.filter(r, lambda x, i: (i == 0) | (x["key"] != F.get(r, i - 1)["key"])))

    def nearest(r: Column, keys: Column, powers: Column, a: Column) -> Column:
        edge_of = lambda p: F.get(keys, p).bitwiseAND(F.lit(-1 << 32))
        near = lambda distance, q: F.struct(distance.alias("distance"), F.get(r, q)["top"].alias("top"), q.alias("place"))

        def among(p: Column, own: Column) -> Column:
            neighbours = lambda q: F.least(F.when(q > p, near(own - F.get(keys, q - 1), q - 1)), F.when(edge_of(q) == edge_of(p), near(F.get(keys, q) - own, q)))
            return let(_first_after(keys, powers, p, lambda k: k < own), neighbours)

        first = let(key(level(a, edge), F.lit((1 << 31) - 1)), lambda last: _first_after(keys, powers, F.lit(0), lambda k: k <= last))
        return F.get(r, let(first, lambda p: let(edge_of(p).bitwiseOR(a["left"] + F.lit(1 << 31)), lambda own: among(p, own)))["place"])

    return let(rows, lambda r: let(r["key"], lambda keys: let(_powers(F.size(r)), lambda powers: _found(lines, lambda a: nearest(r, keys, powers, a)))))


def _beside(lines: Column, tol: float) -> Column:
    """For every line, as an anchor, the first line to its right on its row.

    A key is twice the centre's height, a whole number, then the place from left to right, in one whole number. Searches find the first place beyond the anchor, and the heights, 4 * tol + 1 at most, of its row; one more at each
    height finds the first line there from that place on.
    """
    twice = lambda x: x["top"].cast("long") + x["bottom"]
    rows = F.sort_array(F.transform(lines, lambda x: F.struct(*[x[c].alias(c) for c in ("left", "top", "line_no", "bottom", "text")])))

    def heights(keys: Column) -> Column:
        """Each height with its least key, the place of its first one, and the steps of a search among its own."""
        of = lambda i: F.shiftright(F.get(keys, i), 31)
        firsts = F.filter(F.transform(keys, lambda _, i: i), lambda i: (i == 0) | (of(i) != of(i - 1)))
        return let(firsts, lambda at: F.transform(at, lambda i, j: F.struct(of(i).alias("height"), F.shiftleft(of(i), 31).alias("least"), i.alias("first"), _powers(F.coalesce(F.get(at, j + 1), F.size(keys)) - i).alias("powers"))))

    def nearest(r: Column, lefts: Column, keys: Column, powers: Column, v: Column, tall: Column, steps: Column, a: Column) -> Column:
        within = lambda test, start: _first_after(tall, steps, start, test)
        row = let(within(lambda y: y < twice(a) - 2 * tol, F.lit(0)), lambda p: F.slice(v, p + 1, within(lambda y: y <= twice(a) + 2 * tol, p) - p))

        def at(h: Column, beyond: Column) -> Column:
            first = _first_after(keys, h["powers"], h["first"], lambda k: k < h["least"] + beyond)
            return let(F.get(keys, first), lambda k: F.when(k < h["least"] + F.lit(1 << 31), (k - h["least"]).cast("int")))

        beyond = _first_after(lefts, powers, F.lit(0), lambda left: left <= a["right"])
        return F.get(r, let(beyond, lambda b: F.array_min(F.transform(row, lambda h: at(h, b)))))

    keyed = lambda r: F.sort_array(F.transform(r, lambda x, i: F.shiftleft(twice(x), 31) + i))
    steps = lambda of, use: let(_powers(F.size(of)), use)
    found = lambda r, lefts, keys, v, tall: steps(r, lambda p: steps(v, lambda q: _found(lines, lambda a: nearest(r, lefts, keys, p, v, tall, q, a))))
    return let(rows, lambda r: let(r["left"], lambda lefts: let(keyed(r), lambda keys: let(heights(keys), lambda v: let(v["height"], lambda tall: found(r, lefts, keys, v, tall))))))


def nearest_of_every_line(lines: Column, where: str, tol: float = 20) -> Column:
    """An array of (anchor_line_no, line_no, text): for every line the nearest one `below`, `above` or to the `right` of it, if there is any. No shuffle and no pairs: a page is sorted once, and each line looks its neighbour up by halving."""
    return _beside(lines, tol) if where == "right" else _facing(lines, *{"below": ("bottom", "top", True), "above": ("top", "bottom", False)}[where])


def same_row_right(lines: Column, a: Column, tol: Column | float) -> Column:
    """Other lines on the row whose centre lies to the right; slight overlap is allowed."""
    return _by_left(F.filter(lines, lambda x: (x["line_no"] != a["line_no"]) & _level(x, a, tol) & (center_x(x) > center_x(a)) & (x["right"] > a["left"])))


def blocks_below(lines: Column, a: Column, top_max: Column, col_left: Column, col_right: Column, most: int = 50) -> Column:
    """The first `most` lines from the anchor's bottom on, above top_max, that overlap the columns."""
    inside = F.filter(lines, lambda x: (x["top"] >= a["bottom"]) & (x["top"] < top_max) & (x["left"] < col_right) & (x["right"] > col_left))
    return F.slice(F.array_sort(inside), 1, most)


def boundary_top(lines: Column, after: Column, keywords: tuple[str, ...], col_left: Column, col_right: Column, otherwise: Column) -> Column:
    """The top of the next line below `after` in the columns with any keyword."""
    hit = F.filter(lines, lambda x: (x["top"] > after) & (x["left"] < col_right) & (x["right"] > col_left) & reduce(lambda p, q: p | q, [x["text"].contains(k) for k in keywords]))
    return F.least(otherwise, F.coalesce(F.array_min(F.transform(hit, lambda x: x["top"])), otherwise))


def doc_metrics(lines: Column) -> Column:
    """struct(width, height, base_h): the page's extent and the whole part of the median line height."""
    at = lambda h, i: F.get(h, F.floor(i).cast("int"))
    middle = let(F.array_sort(F.transform(lines, height)), lambda h: (at(h, (F.size(h) - 1) / 2) + at(h, F.size(h) / 2)) / F.lit(2.0))
    return F.struct(F.array_max(F.transform(lines, lambda x: x["right"])).alias("width"), F.array_max(F.transform(lines, lambda x: x["bottom"])).alias("height"), middle.cast("int").alias("base_h"))


def row_tol(base_h: Column, a: Column, scale: float) -> Column:
    return F.greatest(F.lit(10), (F.greatest(base_h, height(a)) * scale).cast("int"))


PART = "array<struct<x: struct<top: int, left: int, line_no: int, right: int, bottom: int, text: string, score: double>, text: string>>"


def without_prefix(raw: Column, prefixes: tuple[str, ...]) -> Column:
    """A text less the first of the prefixes that it starts with, and the colons after it."""
    out = raw
    for p in reversed(prefixes):
        out = F.when(raw.startswith(p), strip(F.regexp_replace(F.substring(raw, len(p) + 1, 1 << 30), "^[:：]+", ""))).otherwise(out)
    return out


def row_sequence(blocks: Column, gap: Column, skip: tuple[str, ...] = (), prefixes: tuple[str, ...] = ()) -> Column:
    """(line, text) parts of blocks from left to right, until the gap to the one before is too wide.

    Blank and skipped blocks count as the one before; of a text one leading prefix and the colons after it go.
    """
    start = F.struct(F.lit(False).alias("stop"), F.lit(None).cast("int").alias("right"), F.array().cast(PART).alias("parts"))

    def step(s: Column, x: Column) -> Column:
        read = lambda raw: F.struct(raw.alias("raw"), without_prefix(raw, prefixes).alias("body"), (s["stop"] | ((raw != "") & F.coalesce(x["left"] - s["right"] > gap, F.lit(False)))).alias("stop"))

        def moved(y: Column) -> Column:
            take = ~y["stop"] & (y["raw"] != "") & (y["body"] != "") & (~y["raw"].isin(*skip) if skip else F.lit(True))
            part = F.array(F.struct(x.alias("x"), y["body"].alias("text"))).cast(PART)
            return F.struct(y["stop"].alias("stop"), F.when(y["stop"], s["right"]).otherwise(x["right"]).alias("right"), F.when(take, F.concat(s["parts"], part)).otherwise(s["parts"]).alias("parts"))

        return let(let(strip(x["text"]), read), moved)

    return F.aggregate(blocks, start, step, lambda s: s["parts"])


def continuation(blocks: Column, bottom: Column, stops: Test, skips: Test, gap: Column, clean: Test = lambda t: t, running_max: bool = False) -> Column:
    """The texts of blocks below a first line, until a stop word or too wide a gap; a line that is taken moves the bottom."""
    start = F.struct(F.lit(False).alias("stop"), bottom.cast("int").alias("bottom"), F.array().cast("array<string>").alias("parts"))

    def step(s: Column, x: Column) -> Column:
        def read(t: Column) -> Column:
            stop = s["stop"] | ((t != "") & (stops(x) | (x["top"] - s["bottom"] > gap)))
            return F.struct(stop.alias("stop"), F.when((t != "") & ~skips(x), clean(t)).otherwise("").alias("body"))

        def moved(y: Column) -> Column:
            take = ~y["stop"] & (y["body"] != "")
            low = F.greatest(s["bottom"], x["bottom"]) if running_max else x["bottom"]
            return F.struct(y["stop"].alias("stop"), F.when(take, low).otherwise(s["bottom"]).alias("bottom"), F.when(take, F.concat(s["parts"], F.array(y["body"]))).otherwise(s["parts"]).alias("parts"))

        return let(let(strip(text(x["text"])), read), moved)

    return F.aggregate(blocks, start, step, lambda s: s["parts"])


def nearby_fragments(lines: Column, a: Column, base_h: Column, width: Column, bound: Column) -> Column:
    """Short Han texts near an address, each once, in order."""
    left = F.greatest(F.lit(0), a["left"] - base_h * 2)
    short = F.filter(lines, lambda x: (x["line_no"] != a["line_no"]) & (x["top"] >= a["top"] - base_h * 2) & (x["top"] < bound) & (x["left"] < width) & (x["right"] > left)
                     & strip(x["text"]).rlike("^[\\x{4e00}-\\x{9fff}]{1,4}$") & ~strip(x["text"]).isin("住", "所", "经营范围", "登记机关"))
    return F.array_distinct(F.transform(short, lambda x: strip(x["text"])))


