"""Fields of identity cards, from pages in nested form: one projection, no shuffle. Missing values are ''."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import layout as L
from ..functions.text import HAN, extract_validity, strip
from . import lines as flat

# Labels that end an address.
STOP_LABELS = "公民身份号码|姓名|性别|民族|出生|住址"


def _first_of(*options: Column) -> Column:
    return F.coalesce(*[F.nullif(o, F.lit("")) for o in options], F.lit(""))


def _squeezed(lines: Column) -> Column:
    return F.translate(L.full_text(lines), " \n", "")


def _match(c: Column, pattern: str, group: int = 0) -> Column:
    """The group of the first match; '' without one, or without a text."""
    return F.coalesce(F.regexp_extract(c, pattern, group), F.lit(""))


def name(lines: Column) -> Column:
    a = L.find(lines, "姓名")
    right = F.array_join(L.texts_of(L.right_of(lines, a)), "")
    return _first_of(strip(_match(a["text"], r"(?Ud)姓名\s*(.+)", 1)), strip(right))


def gender(lines: Column) -> Column:
    return _match(L.find(lines, "性别")["text"], r"(?U)性别\s*(男|女)", 1)


def nation(lines: Column) -> Column:
    return _match(L.find(lines, "性别")["text"], rf"(?U)民族\s*([{HAN}]{{1,8}})", 1)


def birthday(lines: Column) -> Column:
    return _match(L.find(lines, "出生")["text"], r"(?U)\d{4}年\d{1,2}月\d{1,2}日")


def address(lines: Column) -> Column:
    """The rest of the label's line and the lines under it, to the number's line, a label, or a gap over 40."""
    a, number = L.find(lines, "住址"), L.find(lines, "公民身份号码")
    first = strip(F.regexp_replace(a["text"], "^(.*?)住址", "$1"))
    bound = F.when(number["top"] > a["top"], number["top"])
    least = a["top"] + ((a["bottom"] - a["top"]) * F.lit(0.55)).cast("int")
    under = F.filter(lines, lambda x: (x["line_no"] != a["line_no"]) & F.coalesce(x["top"] < bound, F.lit(True)) & (x["top"] >= least) & (x["left"] < a["right"] + 300) & (x["right"] > a["left"] - 50))
    parts = L.continuation(F.array_sort(under), a["bottom"], lambda x: x["text"].rlike(STOP_LABELS), lambda x: F.lit(False), F.lit(40), running_max=True)
    return F.coalesce(F.concat(first, F.array_join(parts, "")), F.lit(""))


def address_of_lines(lines: DataFrame) -> DataFrame:
    """doc_id and address of each page in the flat table of lines: the same by a running maximum of bottoms, without gathering a page."""
    order = F.struct(*flat.READING)
    first = lambda label, value: F.min_by(value, F.when(F.col("text").contains(label), order))
    whole = F.struct(*[F.col(c) for c in flat.COLUMNS])
    marks = lines.groupBy("doc_id").agg(first("住址", whole).alias("a"), first("公民身份号码", F.col("top")).alias("number"))
    a = F.col("a")
    bound = F.when(F.col("number") > a["top"], F.col("number"))
    least = a["top"] + ((a["bottom"] - a["top"]) * F.lit(0.55)).cast("int")
    inside = (F.col("line_no") != a["line_no"]) & F.coalesce(F.col("top") < bound, F.lit(True)) & (F.col("top") >= least) & (F.col("left") < a["right"] + 300) & (F.col("right") > a["left"] - 50)
    under = lines.join(marks.filter("a IS NOT NULL"), "doc_id").filter(inside).withColumn("anchor_line_no", a["line_no"])
    parts = flat.continuation(under, a["bottom"], lambda x: x["text"].rlike(STOP_LABELS), lambda x: F.lit(False), F.lit(40), running_max=True)
    own = strip(F.regexp_replace(a["text"], "^(.*?)住址", "$1"))
    return marks.join(flat.joined(parts), "doc_id", "left").select("doc_id", F.coalesce(F.concat(own, F.coalesce("joined", F.lit(""))), F.lit("")).alias("address"))


def id_number(lines: Column) -> Column:
    pattern = r"(?U)\d{17}[0-9Xx]"
    return F.upper(_first_of(_match(L.find(lines, "公民身份号码")["text"], pattern), _match(_squeezed(lines), pattern)))


def authority(lines: Column) -> Column:
    a = L.find(lines, "签发机关")
    until = lambda blocks: F.aggregate(
        blocks, F.struct(F.lit(False).alias("stop"), F.array().cast("array<string>").alias("parts")),
        lambda s, x: F.struct((s["stop"] | x["text"].contains("有效期限")).alias("stop"), F.when(s["stop"] | x["text"].contains("有效期限") | (strip(x["text"]) == ""), s["parts"]).otherwise(F.concat(s["parts"], F.array(strip(x["text"])))).alias("parts")),
        lambda s: s["parts"],
    )
    same = F.coalesce(strip(F.regexp_replace(a["text"], "^(.*?)签发机关", "$1")), F.lit(""))
    right = F.coalesce(F.array_join(until(L.right_of(lines, a, 40)), ""), F.lit(""))
    under = F.coalesce(F.get(until(L.below(lines, a)), 0), F.lit(""))
    return _first_of(same, right, under, strip(_match(_squeezed(lines), "(?d)签发机关(.+?)(有效期限|$)", 1)))


def valid_date(lines: Column) -> Column:
    a = L.find(lines, "有效期限")
    right = F.array_join(F.transform(L.right_of(lines, a, 40), lambda x: strip(x["text"])), "")
    under = F.get(F.filter(F.transform(L.below(lines, a), lambda x: extract_validity(x["text"])), lambda x: x != ""), 0)
    return _first_of(extract_validity(a["text"]), extract_validity(right), under, extract_validity(_squeezed(lines)))


FRONT = {"name": name, "gender": gender, "nation": nation, "birthday": birthday, "address": address, "id_number": id_number}
BACK = {"authority": authority, "valid_date": valid_date}


def parse_id_front(layouts: DataFrame) -> DataFrame:
    return layouts.select("doc_id", *[f(F.col("lines")).alias(k) for k, f in FRONT.items()])


def parse_id_back(layouts: DataFrame) -> DataFrame:
    return layouts.select("doc_id", *[f(F.col("lines")).alias(k) for k, f in BACK.items()])


