"""Fields of business licences, from pages in nested form, in stages of columns: metrics and anchors, then fields. No shuffle. Missing values are ''."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import layout as L
from ..functions.text import clean_address, complete_address_prefix, fix_credit_code, is_date_text, is_label_like, is_person_name, is_valid_uscc, let, looks_like_address, looks_like_capital, strip, strip_label
from . import lines as flat

# Labels and boundary words of a licence.
ADDRESS_LABELS = ("住所", "营业场所", "经营场所", "注册地址")
BOUNDARY = ("登记机关", "市场监督", "国家企业信用信息公示系统网址")
STOPS = "登记机关|市场监督|国家企业信用信息公示系统网址|http"
CODE = "[0-9A-Z]{18}"
#: Most lines that are looked at under the start of an address and of a scope.
ADDRESS_BLOCKS, SCOPE_BLOCKS = 10, 50
FIELDS = ("credit_code", "name", "type_name", "legal_person", "capital", "establish_date", "address", "business_scope")


def _first_of(*options: Column) -> Column:
    return F.coalesce(*[F.nullif(o, F.lit("")) for o in options], F.lit(""))


def credit_code(lines: Column) -> Column:
    """The first candidate that checks once repaired, else the first, else one from the joined text."""
    found = F.flatten(F.transform(lines, lambda x: F.transform(F.regexp_extract_all(x["text"], F.lit(f"({CODE})"), F.lit(1)), fix_credit_code)))
    joined = fix_credit_code(F.regexp_extract(L.full_text(lines), CODE, 0))
    return let(found, lambda f: _first_of(F.get(F.filter(f, is_valid_uscc), 0), F.get(f, 0), joined))


def _m(field: str) -> Column:
    return F.col(f"m.{field}")


def _gap() -> Column:
    return F.greatest(F.lit(30), _m("base_h") * 4)


def _row_parts(lines: Column, a: Column, tol: Column, skip: tuple[str, ...] = (), prefixes: tuple[str, ...] = ()) -> Column:
    return L.row_sequence(L.same_row_right(lines, a, tol), _gap(), skip, prefixes)


def _joined(parts: Column, keep: Callable[[Column], Column] = lambda p: F.lit(True)) -> Column:
    return F.coalesce(F.array_join(F.transform(F.filter(parts, keep), lambda p: p["text"]), ""), F.lit(""))


def _labelled(lines: Column, label: str, spaced: str, first: str, second: str, drop_labels: bool) -> Column:
    """A value after a whole label, a spaced one, or one split over two boxes."""
    value = lambda p: ~is_label_like(p["text"])
    any_ = lambda p: F.lit(True)
    whole = lambda kw: let(L.find(lines, kw), lambda a: _first_of(F.coalesce(strip_label(a["text"], kw), F.lit("")), _joined(_row_parts(lines, a, L.row_tol(_m("base_h"), a, 1.0)), value if drop_labels else any_)))
    cut = let(L.find_exact(lines, first), lambda a: _joined(_row_parts(lines, a, L.row_tol(_m("base_h"), a, 1.0), (second,), (second,)), value))
    return _first_of(whole(label), whole(spaced), cut)


def legal_person(lines: Column) -> Column:
    first = lambda blocks: strip(F.get(F.filter(blocks, lambda x: is_person_name(x["text"])), 0)["text"])
    named = lambda t: F.when(is_person_name(t), t)

    def found(a: Column) -> Column:
        same = [F.when(a["text"].contains(k), let(strip_label(a["text"], k), named)) for k in ("法定代表人", "负责人")]
        right = L.same_row_right(lines, a, L.row_tol(_m("base_h"), a, 1.0))
        under = L.blocks_below(lines, a, a["bottom"] + _m("base_h") * 4, a["left"] - _m("base_h"), a["right"] + _m("base_h") * 8, 5)
        return F.coalesce(*same, first(right), first(under), F.lit(""))

    return let(L.find_contains(lines, "法定代表人", "负责人"), found)


def row_value(lines: Column, labels: tuple[str, ...], valid: Callable[[Column], Column]) -> Column:
    """The label's own rest, or the first text to its right, that is valid."""
    fits = lambda t: F.when((t != "") & valid(t), t)

    def found(a: Column) -> Column:
        same = [F.when(a["text"].contains(k), let(strip_label(a["text"], k), fits)) for k in labels]
        right = F.get(F.filter(L.same_row_right(lines, a, L.row_tol(_m("base_h"), a, 1.0)), lambda x: (strip(x["text"]) != "") & valid(x["text"])), 0)
        return F.coalesce(*same, strip(right["text"]), F.lit(""))

    return let(L.find_contains(lines, *labels), found)


def _cleaned(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda p: F.struct(p["x"].alias("x"), clean_address(p["text"]).alias("text"))), lambda p: p["text"] != "")


def _pick(parts: Column) -> Column:
    """struct(x, text): the first part like an address, else the first that cleans to anything."""
    return let(_cleaned(parts), lambda c: F.coalesce(F.get(F.filter(c, lambda p: looks_like_address(p["text"])), 0), F.get(c, 0)))


def _address_start(lines: Column) -> Column:
    """struct(x, text): the address's first line and text, by a whole label, the second half of a split one, or its first half."""

    def by_label(a: Column) -> Column:
        # the first label whose rest isn't empty decides, even if that cleans to nothing
        rest = F.coalesce(*[F.nullif(F.when(a["text"].contains(k), strip_label(a["text"], k)), F.lit("")) for k in ADDRESS_LABELS])
        same = let(F.coalesce(clean_address(rest), F.lit("")), lambda t: F.when(t != "", F.struct(a.alias("x"), t.alias("text"))))
        return F.coalesce(same, _pick(_row_parts(lines, a, L.row_tol(_m("base_h"), a, 1.2))))

    def by_first_half(a: Column) -> Column:
        parts = _cleaned(_row_parts(lines, a, F.greatest(F.lit(35), L.row_tol(_m("base_h"), a, 1.4)), ("所",), ("所",)))
        return F.get(F.filter(parts, lambda p: (p["x"]["left"] >= _m("width") * F.lit(0.35)) & looks_like_address(p["text"])), 0)

    by_second_half = lambda a: _pick(_row_parts(lines, a, L.row_tol(_m("base_h"), a, 1.3), ("所",), ("所",)))
    return F.coalesce(let(L.find_contains(lines, *ADDRESS_LABELS), by_label), let(L.find_exact(lines, "所"), by_second_half), let(L.find_exact(lines, "住"), by_first_half))


def _address_tests() -> tuple[L.Test, L.Test, Column]:
    """What ends an address, what is passed over in it, and the widest gap."""
    tall = lambda x: ((x["bottom"] - x["top"]) > _m("base_h") * F.lit(2.2)) & (F.length(strip(x["text"])) <= 2)
    stops = lambda x: x["text"].rlike(STOPS) | is_date_text(x["text"]) | strip(x["text"]).rlike(r"(?U)^[\d年月日\s]+\z")
    return stops, tall, F.greatest(F.lit(25), _m("base_h") * 3)


def _address_left(a: Column) -> Column:
    return F.greatest(F.lit(0), a["left"] - _m("base_h") * 2)


def _address_rest(lines: Column, a: Column, bound: Column) -> Column:
    under = F.filter(L.blocks_below(lines, a, bound, _address_left(a), _m("width"), ADDRESS_BLOCKS), lambda x: x["line_no"] != a["line_no"])
    return L.continuation(under, a["bottom"], *_address_tests(), clean_address)


def _scope(lines: Column) -> tuple[Column, Column]:
    """The scope's own row: the label's rest, and the parts to its right."""
    row = lambda a: _row_parts(lines, a, F.greatest(F.lit(20), L.row_tol(_m("base_h"), a, 1.0)))
    return F.coalesce(strip_label(L.find(lines, "经营范围")["text"], "经营范围"), F.lit("")), let(L.find(lines, "经营范围"), row)


def _scope_columns() -> tuple[Column, Column, Column, Column]:
    """The line under which a scope goes on, the columns that it goes on in, and the numbers of the lines that it has already."""
    a, first = F.col("scope_label"), F.get(F.col("scope_row"), 0)["x"]
    left = F.when(first.isNotNull(), F.greatest(F.lit(0), first["left"] - _m("base_h"))).otherwise(a["right"])
    right = F.when(first.isNotNull(), F.least(_m("width"), first["right"] + _m("base_h") * 2)).otherwise((_m("width") * F.lit(0.7)).cast("int"))
    return F.coalesce(first, a), left, right, F.concat(F.array(a["line_no"]), F.transform("scope_row", lambda p: p["x"]["line_no"]))


def _scope_tests() -> tuple[L.Test, L.Test, Column]:
    stops = lambda x: x["text"].rlike(STOPS) | strip(x["text"]).rlike(r"(?U)^(\d{1,4}|[年月日])\z") | is_date_text(x["text"])
    return stops, lambda x: F.lit(False), F.greatest(F.lit(25.0), _m("base_h") * F.lit(2.5))


def _scope_bound(lines: Column) -> Column:
    return L.boundary_top(lines, F.col("scope_label")["top"], BOUNDARY, F.lit(0), _m("width"), _m("height"))


def _scope_rest(lines: Column) -> Column:
    start, left, right, seen = _scope_columns()
    under = F.filter(L.blocks_below(lines, start, _scope_bound(lines), left, right, SCOPE_BLOCKS), lambda x: ~F.array_contains(seen, x["line_no"]))
    return L.continuation(under, start["bottom"], *_scope_tests())


def _staged(layouts: DataFrame) -> DataFrame:
    """layouts with metrics, the fields that end on their row, and where address and scope start."""
    lines = F.col("lines")
    rest, row = _scope(lines)
    staged = layouts.withColumn("m", L.doc_metrics(lines)).withColumns({
        "credit_code": credit_code(lines), "name": _labelled(lines, "名称", "名 称", "名", "称", False), "type_name": _labelled(lines, "类型", "类 型", "类", "型", True),
        "legal_person": legal_person(lines), "capital": row_value(lines, ("注册资本", "注册资金"), looks_like_capital), "establish_date": row_value(lines, ("成立日期", "注册日期", "设立日期"), is_date_text),
        "start": _address_start(lines), "scope_label": L.find(lines, "经营范围"), "scope_text": rest, "scope_row": row,
    })
    a = F.col("start.x")
    staged = staged.withColumn("bound", L.boundary_top(lines, a["top"], (*BOUNDARY, "国家市场监督管理总局监制"), _address_left(a), _m("width"), _m("height")))
    return staged.withColumn("fragments", L.nearby_fragments(lines, a, _m("base_h"), _m("width"), F.col("bound")))


def _finished(staged: DataFrame, kept: list[str], more: Column, scope_more: Column) -> DataFrame:
    """The fields, of staged pages and of the texts that address and scope go on with."""
    address = complete_address_prefix(F.concat(F.col("start.text"), more), F.col("name"), F.col("credit_code"), F.col("fragments"))
    scope = F.concat(F.col("scope_text"), _joined(F.col("scope_row")), scope_more)
    return staged.select(*kept, *FIELDS[:6], F.when(F.col("start").isNotNull(), address).otherwise("").alias("address"), F.when(F.col("scope_label").isNotNull(), scope).otherwise("").alias("business_scope"))


def with_fields(layouts: DataFrame) -> DataFrame:
    """layouts with the eight fields. A page without lines has ''."""
    lines = F.col("lines")
    staged = _staged(layouts).withColumns({"more": _address_rest(lines, F.col("start.x"), F.col("bound")), "scope_more": _scope_rest(lines)})
    return _finished(staged, layouts.columns, F.array_join("more", ""), F.array_join("scope_more", ""))


def fields_of_lines(lines: DataFrame) -> DataFrame:
    """doc_id and the eight fields of each page in the flat table of lines. Labels and rows are looked up on the page as an array; the folds under address and scope are windows over the flat lines, with running bottoms and stops."""
    staged = _staged(flat.to_layouts(lines))

    def rest(start: Column, bound: Column, left: Column, right: Column, seen: Column, most: int, tests: tuple[L.Test, L.Test, Column], clean: L.Test) -> DataFrame:
        asked = staged.select("doc_id", "m", start.alias("a"), bound.alias("top_max"), left.alias("col_left"), right.alias("col_right"), seen.alias("seen")).filter("a IS NOT NULL")
        a = F.col("a")
        inside = (F.col("top") >= a["bottom"]) & (F.col("top") < F.col("top_max")) & (F.col("left") < F.col("col_right")) & (F.col("right") > F.col("col_left"))
        met = lines.join(asked, "doc_id").filter(inside).withColumn("anchor_line_no", a["line_no"])
        first = met.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(*flat.READING))).filter(F.col("rank") <= most)
        return flat.joined(flat.continuation(first.filter(~F.array_contains("seen", F.col("line_no"))), a["bottom"], *tests, clean))

    at = F.col("start.x")
    more = rest(at, F.col("bound"), _address_left(at), _m("width"), F.array(at["line_no"]), ADDRESS_BLOCKS, _address_tests(), clean_address).withColumnRenamed("joined", "more")
    start, left, right, seen = _scope_columns()
    scope_more = rest(start, _scope_bound(F.col("lines")), left, right, seen, SCOPE_BLOCKS, _scope_tests(), lambda t: t).withColumnRenamed("joined", "scope_more")
    whole = staged.join(more, "doc_id", "left").join(scope_more, "doc_id", "left")
    return _finished(whole, ["doc_id"], F.coalesce("more", F.lit("")), F.coalesce("scope_more", F.lit("")))


def parse_business_license(layouts: DataFrame) -> DataFrame:
    """doc_id and the eight fields."""
    return with_fields(layouts.select("doc_id", "lines")).select("doc_id", *FIELDS)
