"""Authorization letters: fields of a page by patterns, then one row a letter. Missing values are null.

Fields are taken before the one shuffle, so page texts don't travel; the first page with a value wins, field by field, by min_by, which sums up in the tasks first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

FIELDS = ("delegator", "delegator_id", "delegator_address", "delegator_phone", "trustee", "trustee_id", "validity_period", "signing_date", "trustee_signature")
OUTPUT = ("delegator", "delegator_id", "delegator_address", "delegator_phone", "trustee", "trustee_id", "validity_period", "signing_date", "trustee_signature", "trustee_id_front", "trustee_id_back")
# What is to be confirmed by hand.
CONFIRM = ("需要人工确认签名", "需要人工确认身份证正面", "需要人工确认身份证反面")
# The patterns of the fields.
IDS = "([0-9Xx]{15,18})"
DELEGATOR = r"(?U)委托人[：:]{1,2}[_\s]*([^_\n]+)"
DELEGATOR_ID = r"(?U)身份证号码[：:]{0,2}[_\s]*([0-9Xx]{15,18})"
TRUSTEE_ID = r"(?U)受托人[^\n]*?身份证号[\s]*([0-9Xx]{15,18})"
ADDRESS = r"(?U)住址[：:]{1,2}[_\s]*([^_\n]+)"
PHONE = r"(?U)联系电话[：:]{1,2}[_\s]*([0-9\-]{7,15})"
TRUSTEE = (r"(?U)受托人[：:]{1,2}[_\s]*([^_\n]+)", r"(?Ud)委托.*?受托人[（\(]?([^）\)_\n]+)", r"(?U)受托人([^\d_]{2,5})")


def _match(t: Column, pattern: str) -> Column:
    """The first match's group, stripped; null without a match. No group of these patterns matches the empty text."""
    return strip(F.nullif(F.regexp_extract(t, pattern, 1), F.lit("")))


def _zfill(c: Column) -> Column:
    return F.when(F.length(c) < 2, F.lpad(c, 2, "0")).otherwise(c)


def _dates(t: Column, keyword: str, reach: int, k: int) -> Column:
    """The k-th date among the numbers in the `reach` characters from keyword on."""
    n = F.regexp_extract_all(F.substring(t, F.locate(keyword, t), F.lit(reach)), F.lit(r"(?U)(\d+)"), F.lit(1))
    at = lambda i: F.get(n, 3 * k + i)
    return F.concat_ws("-", at(0), _zfill(at(1)), _zfill(at(2))), F.size(n)


def page_fields(t: Column) -> dict[str, Column]:
    """The fields of a page's text."""
    t = F.coalesce(t, F.lit(""))
    ids = F.regexp_extract_all(t, F.lit(IDS), F.lit(1))
    delegator_id = F.coalesce(_match(t, DELEGATOR_ID), F.get(ids, 0))
    other = F.when(F.size(ids) >= 2, F.get(F.filter(ids, lambda x: ~x.eqNullSafe(delegator_id)), 0))
    (start, n), (end, _), (signed, n2) = _dates(t, "有效期", 300, 0), _dates(t, "有效期", 300, 1), _dates(t, "签署日期", 100, 0)
    return {
        "delegator": _match(t, DELEGATOR), "delegator_id": delegator_id, "delegator_address": _match(t, ADDRESS), "delegator_phone": _match(t, PHONE),
        "trustee": F.coalesce(*[_match(t, p) for p in TRUSTEE]), "trustee_id": F.coalesce(_match(t, TRUSTEE_ID), other),
        "validity_period": F.when(t.contains("有效期") & (n >= 6), F.struct(start.alias("start_date"), end.alias("end_date"))),
        "signing_date": F.when(t.contains("签署日期") & (n2 >= 3), signed), "trustee_signature": F.lit(None).cast("string"),
    }


def parse_letter_text(pages: DataFrame) -> DataFrame:
    """doc_id, page_number, image_count and the fields of each page; row-local."""
    return pages.select("doc_id", "page_number", "image_count", *[c.alias(k) for k, c in page_fields(F.col("text")).items()])


def merge_letter_pages(fields: DataFrame) -> DataFrame:
    """One row a letter: of each field the first page's value that isn't null or empty, the image flags, and the number of pages."""
    filled = lambda f: F.col(f).isNotNull() & (F.lit(True) if f == "validity_period" else F.col(f) != "")
    return fields.groupBy("doc_id").agg(
        *[F.min_by(f, F.when(filled(f), F.col("page_number"))).alias(f) for f in FIELDS],
        F.count("*").alias("pages_count"), F.max((F.col("page_number") == 3) & (F.coalesce("image_count", F.lit(0)) > 0)).alias("third_has_image"),
    )


def with_image_flags(letters: DataFrame) -> DataFrame:
    """Signatures to confirm by hand, where a third page holds an image."""
    flag = (F.col("pages_count") > 2) & F.col("third_has_image")
    signature, front, back = (F.when(flag, x) for x in CONFIRM)
    return letters.withColumns({"trustee_signature": F.coalesce(signature, F.col("trustee_signature")), "trustee_id_front": front, "trustee_id_back": back})


def postprocess_letter(letters: DataFrame) -> DataFrame:
    bare = lambda c: F.replace(F.col(c), F.lit("_"), F.lit(""))
    return letters.withColumns({"delegator_id": F.upper("delegator_id"), "trustee_id": F.upper("trustee_id"), "delegator_address": bare("delegator_address"), "delegator": strip(bare("delegator")), "trustee": strip(bare("trustee"))})


def format_letter(letters: DataFrame) -> DataFrame:
    """doc_id, status, data and metadata; partial where there was an error."""
    error = F.col("error") if "error" in letters.columns else F.lit(None).cast("string")
    warning = F.col("warning") if "warning" in letters.columns else F.lit(None).cast("string")
    return letters.select(
        "doc_id", F.when(error.isNull(), "success").otherwise("partial").alias("status"), F.struct(*OUTPUT).alias("data"),
        F.struct(F.col("pages_count"), error.alias("error"), warning.alias("warning")).alias("metadata"),
    )


def parse_letters(pages: DataFrame) -> DataFrame:
    """Pages to letters: one shuffle, of the fields."""
    return format_letter(postprocess_letter(with_image_flags(merge_letter_pages(parse_letter_text(pages)))))


def _of_file(rows: DataFrame) -> list[str]:
    """Columns about the uploaded file that are carried along where they are there."""
    return [c for c in ("filename", "file_size") if c in rows.columns]


#: Pages that are put together in one place before a letter is; a letter of any number of pages then meets as so many fewer pieces.
RANGE = 256


def _ranges(pages: DataFrame, page: Column, *more: Column) -> DataFrame:
    """doc_id, the number of a range of pages, the range's pages in order, and what more asks of them."""
    by = F.floor((F.col("page_number") - 1) / RANGE).alias("range")
    return pages.groupBy("doc_id", by).agg(F.array_sort(F.collect_list(page)).alias("pages"), *more)


def raw_pages(pages: DataFrame) -> DataFrame:
    """Each letter's file name and size, number of pages, pages (number, text, characters), characters by page, and the text of its pages that have any, each with a line feed. Pages are put in order by ranges, then the ranges."""
    page = F.struct("page_number", F.coalesce("text", F.lit("")).alias("text"), F.length(F.coalesce("text", F.lit(""))).alias("char_count"))
    file = [F.first(c, ignorenulls=True).alias(c) for c in _of_file(pages)]
    pieces = _ranges(pages, page, *file).withColumn("piece", F.array_join(F.transform(F.filter("pages", lambda x: x["text"] != ""), lambda x: F.concat(x["text"], F.lit("\n"))), ""))
    held = pieces.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("range", "pages", "piece"))).alias("p"), *file)
    ordered = held.select("doc_id", *_of_file(pages), F.explode(F.array(F.flatten(F.transform("p", lambda x: x["pages"])))).alias("pages"), F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("raw_text"))
    return ordered.select("doc_id", *_of_file(pages), F.size("pages").cast("long").alias("pages_count"), "pages", F.transform("pages", lambda x: x["char_count"]).alias("char_counts"), "raw_text")


def letter_raw_text(pages: DataFrame) -> DataFrame:
    """All pages' texts, empty ones too, joined by line feeds: first those of a range of pages, then the ranges'."""
    pieces = _ranges(pages, F.struct("page_number", F.coalesce("text", F.lit("")).alias("text"))).select("doc_id", "range", F.array_join(F.transform("pages", lambda x: x["text"]), "\n").alias("piece"))
    held = pieces.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("range", "piece"))).alias("p"))
    return held.select("doc_id", F.array_join(F.transform("p", lambda x: x["piece"]), "\n").alias("raw_text"))


def layout_results_summary(results: DataFrame, method: str = "layout") -> DataFrame:
    """File name and size, method, number of pages, and markdown text and images of the first page, of each document's array of layout results."""
    first = F.get("pages", 0)["markdown"]
    return results.select("doc_id", *_of_file(results), F.size("pages").alias("pages_count"), first["text"].alias("markdown_text"), F.map_keys(first["images"]).alias("image_names"), F.lit(method).alias("method"))
