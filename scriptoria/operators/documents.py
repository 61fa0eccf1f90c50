"""Routing of pages by type to their parsers, and response envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import BROKEN
from . import id_cards, licence
from .pages import ID_BACK, ID_FRONT, LICENCE, MISALIGNED, UNKNOWN, classify, read_documents  # noqa: F401

#: What a document of no known type is told.
NOT_RECOGNISED = "未能识别证件类型"
#: The table of documents that can't be parsed.
FAILED = "failed"


def parse_layouts(layouts: DataFrame) -> dict[str, DataFrame]:
    """A typed table for each document type, of classified layouts (doc_id, lines, doc_type), and one of those with an error: doc_id, error and the record as it came, where it couldn't be read."""
    none = F.lit(None).cast("string")
    error, record = (F.col(c) if c in layouts.columns else none for c in ("error", BROKEN))
    every = layouts.select("doc_id", "lines", "doc_type", error.alias("error"), record.alias(BROKEN))
    held, failed = every.filter("error IS NULL"), every.filter((F.col("doc_type") == UNKNOWN) & F.col("error").isNotNull())
    parsers = {ID_FRONT: id_cards.parse_id_front, ID_BACK: id_cards.parse_id_back, LICENCE: licence.parse_business_license}
    out = {}
    for kind, parse in parsers.items():
        rows = held.filter(F.col("doc_type") == kind)
        out[kind] = parse(rows)
    return out | {UNKNOWN: unknown_documents(held), FAILED: failed.select("doc_id", "error", BROKEN)}


def unknown_documents(classified: DataFrame) -> DataFrame:
    """doc_id, type, error and the page's texts, of documents of no known type."""
    rows = classified.filter(F.col("doc_type") == UNKNOWN)
    return rows.select("doc_id", F.lit(UNKNOWN).alias("type"), F.lit(NOT_RECOGNISED).alias("error"), F.transform("lines", lambda x: x["text"]).alias("raw_texts"))


def parse_documents(raw: DataFrame) -> DataFrame:
    """doc_id, doc_type, data (JSON of the type's fields) and error, for every document, in one projection that also serves streams.

    A malformed document becomes a row with its error, of no known type, and, where raw has the column of records that couldn't be read, with its record; the others go on. A document of no known type isn't an
    error: its data says so and holds its texts.
    """
    kind, more = F.col("doc_type"), [c for c in raw.columns if c == BROKEN]
    # a parser is shown the lines of its own type's pages only, and does nothing on others
    of = lambda k: F.when(kind == k, F.col("lines"))
    held = classify(read_documents(raw)).select("doc_id", "doc_type", "error", *more, of(ID_FRONT).alias("__front"), of(ID_BACK).alias("__back"), F.transform(of(UNKNOWN), lambda x: x["text"]).alias("__texts"), of(LICENCE).alias("lines"))
    parsed = licence.with_fields(held)
    front = F.struct(*[f(F.col("__front")).alias(k) for k, f in id_cards.FRONT.items()])
    back = F.struct(*[f(F.col("__back")).alias(k) for k, f in id_cards.BACK.items()])
    unknown = F.struct(F.lit(UNKNOWN).alias("type"), F.lit(NOT_RECOGNISED).alias("error"), F.col("__texts").alias("raw_texts"))
    data = F.when(kind == ID_FRONT, F.to_json(front)).when(kind == ID_BACK, F.to_json(back)).when(kind == LICENCE, F.to_json(F.struct(*licence.FIELDS))).otherwise(F.to_json(unknown))
    return parsed.select("doc_id", "doc_type", F.when(F.col("error").isNull(), data).alias("data"), "error", *more)


def to_envelope(parsed: DataFrame, code: int = 500) -> DataFrame:
    """doc_id and the response, as JSON: {0, success, data}, or {code, the error, null}. data is JSON already."""
    ok = F.concat(F.lit('{"code":0,"msg":"success","data":'), F.coalesce("data", F.lit("null")), F.lit("}"))
    bad = F.to_json(F.struct(F.lit(code).alias("code"), F.col("error").alias("msg"), F.lit(None).cast("string").alias("data")), {"ignoreNullFields": "false"})
    return parsed.select("doc_id", F.when(F.col("error").isNull(), ok).otherwise(bad).alias("response"))
