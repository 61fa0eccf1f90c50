"""Raw recognition results to cleaned pages, and the page's type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import layout as L
from ..functions.text import let, postprocess_text, suffix_of
from ..schemas import BROKEN

ID_FRONT, ID_BACK, LICENCE, UNKNOWN = "id_front", "id_back", "business_license", "unknown"
#: Why a document can't be parsed.
NOT_READ = "unreadable record"
MISSING = "texts, scores or boxes are missing"
MISALIGNED = "texts, scores and boxes differ in length"
NO_BOX = "a line without four numbers as its box"
NO_SCORE = "a line without a score"


def filter_supported(files: DataFrame, name: str, allowed: tuple[str, ...], lower: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows whose file name has an allowed suffix, and the others."""
    fits = F.coalesce(suffix_of(name, lower).isin(*allowed), F.lit(False))
    return files.filter(fits), files.filter(~fits)


def filter_by_score(raw: DataFrame, min_score: float = 0.7) -> DataFrame:
    """All four parallel arrays at the places whose score is at least min_score."""
    n = F.size("scores")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    kept = raw.withColumn("__at", F.filter(places, lambda i: F.get("scores", i) >= min_score))
    return kept.withColumns({c: F.transform("__at", _getter(c)) for c in ("texts", "scores", "boxes", "polys")}).drop("__at")


def _getter(name: str):
    return lambda i: F.get(F.col(name), i)


def postprocess_lines(raw: DataFrame) -> DataFrame:
    return raw.withColumn("texts", F.transform("texts", postprocess_text))


def clean_ocr(raw: DataFrame, min_score: float = 0.7) -> DataFrame:
    """Score filter, then text cleaning; the angle passes through."""
    return postprocess_lines(filter_by_score(raw, min_score))


def to_layouts(raw: DataFrame, min_score: float = 0.2) -> DataFrame:
    """(doc_id, lines), and other columns of raw: one row a document, lines in reading order; no shuffle.

    The lines come out of an explode of one element, so that the optimizer doesn't work them out again at each later use.
    """
    rest = [c for c in raw.columns if c not in ("texts", "scores", "boxes", "polys", "angle")]
    return raw.select(*rest, F.explode(F.array(L.build_lines(F.col("texts"), F.col("scores"), F.col("boxes"), min_score))).alias("lines"))


def _fault(lines: Column, broken: bool) -> Column:
    """Why a document's arrays, of which lines were read, make no page; null if they do."""
    absent = F.col("texts").isNull() | F.col("scores").isNull() | F.col("boxes").isNull()
    uneven = (F.size("texts") != F.size("scores")) | (F.size("texts") != F.size("boxes"))
    box = F.exists(lines, lambda x: x["top"].isNull() | x["left"].isNull() | x["right"].isNull() | x["bottom"].isNull())
    score = F.exists(lines, lambda x: x["score"].isNull())
    unread = F.col(BROKEN).isNotNull() if broken else F.lit(False)
    return F.when(unread, NOT_READ).when(absent, MISSING).when(uneven, MISALIGNED).when(box, NO_BOX).when(score, NO_SCORE)


def read_documents(raw: DataFrame, min_score: float = 0.2) -> DataFrame:
    """(doc_id, lines, error), and other columns of raw: a document that is malformed has its error and no lines, whatever the others hold; no shuffle.

    Malformed are records that can't be read, missing arrays or ones of different lengths, and lines that would be kept but lack a score or a box of four whole numbers. Null texts count as blank.
    """
    rest = [c for c in raw.columns if c not in ("texts", "scores", "boxes", "polys", "angle")]
    lines = L.read_lines(F.col("texts"), F.col("scores"), F.col("boxes"), min_score)
    held = raw.select(*rest, "texts", "scores", "boxes", F.explode(F.array(lines)).alias("lines"))
    held = held.select(*rest, "lines", F.explode(F.array(_fault(F.col("lines"), BROKEN in rest))).alias("error"))
    return held.select(*rest, F.when(F.col("error").isNull(), F.col("lines")).alias("lines"), "error")


def build_lines(raw: DataFrame, min_score: float = 0.2) -> DataFrame:
    """The flat table of lines; no shuffle."""
    return to_layouts(raw, min_score).select("doc_id", F.explode("lines").alias("x")).select("doc_id", *[F.col(f"x.{c}") for c in ("line_no", "text", "left", "top", "right", "bottom", "score")])


def detect(lines: Column) -> Column:
    """The document type, from keywords in the joined text; they may straddle lines."""

    def kind(t: Column) -> Column:
        both = lambda a, b: t.contains(a) & t.contains(b)
        licence = t.contains("营业执照") | t.contains("统一社会信用代码") | both("注册资本", "法定代表人")
        return F.when(both("姓名", "公民身份号码"), ID_FRONT).when(both("签发机关", "有效期限"), ID_BACK).when(licence, LICENCE).otherwise(UNKNOWN)

    return let(L.full_text(lines), kind)


def classify(layouts: DataFrame) -> DataFrame:
    return layouts.withColumn("doc_type", detect(F.col("lines")))
