"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import BROKEN, MARKDOWN_PAGES, RAW_OCR, RAW_OCR_JSON


def read_ocr_json(spark: SparkSession, path: str) -> DataFrame:
    """Recognition results, a document a line, by the fixed schema. A line that can't be read, or not by the schema, keeps its text in the column `record`, beside what could be read of it."""
    return spark.read.schema(RAW_OCR_JSON).option("columnNameOfCorruptRecord", BROKEN).json(path)


def read_ocr_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW_OCR).parquet(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path), height, width, channels, data and error; files that aren't images keep a row."""
    i = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    bad = F.col("height") <= 0
    return i.select(F.col("origin").alias("doc_id"), "height", "width", F.col("nChannels").alias("channels"), F.when(~bad, F.col("data")).alias("data"), F.when(bad, "unreadable image").alias("error"))


def read_image_files(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and size of files, undecoded."""
    return spark.read.format("binaryFile").load(path).select("path", "content", F.col("length").alias("file_size"))


def parse_layout_results(rows: DataFrame, column: str = "json") -> DataFrame:
    """doc_id, file name and size where they are there, and pages (markdown text and images) of JSON results."""
    return rows.select("doc_id", *[c for c in ("filename", "file_size") if c in rows.columns], F.from_json(column, MARKDOWN_PAGES).alias("pages"))


def write_typed(tables: dict[str, DataFrame], path: str, batch_id: int | None = None) -> None:
    """A Parquet table for each document type under path. With a batch_id only that batch's part of each table is written, in place of what an earlier attempt at the batch left."""
    part = "" if batch_id is None else f"/batch_id={batch_id}"
    for kind, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{kind}{part}")


def write_classified(classified: DataFrame, path: str) -> None:
    """Classified layouts, partitioned by type: each parser then reads its own folder."""
    classified.write.mode("overwrite").partitionBy("doc_type").parquet(path)
