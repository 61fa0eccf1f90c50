"""Parsing of documents as they arrive. Each document stands for itself: no state, so no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.documents import parse_documents, parse_layouts
from ..operators.pages import classify, read_documents
from ..schemas import BROKEN, RAW_OCR_JSON
from ..sources import write_typed


def arriving(spark: SparkSession, in_dir: str, files_per_trigger: int | None = None) -> DataFrame:
    """Recognition results as JSON files come into a folder; lines that can't be read keep their text in the column `record`."""
    reader = spark.readStream.schema(RAW_OCR_JSON).option("columnNameOfCorruptRecord", BROKEN)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(in_dir)


def stream_parse(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, available_now: bool = False, files_per_trigger: int | None = None) -> StreamingQuery:
    """Parsed documents appended to Parquet, each once."""
    out = parse_documents(arriving(spark, in_dir, files_per_trigger)).writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if available_now else out).start()


def write_batch(batch: DataFrame, batch_id: int, out_dir: str) -> None:
    """The typed tables of one batch, each in a folder named by the batch: a batch that is run again, which has the same documents, replaces what it wrote before."""
    held = classify(read_documents(batch)).persist()
    try:
        write_typed(parse_layouts(held), out_dir, batch_id)
    finally:
        held.unpersist()


def stream_typed(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, available_now: bool = False, files_per_trigger: int | None = None) -> StreamingQuery:
    """Arriving documents into one Parquet table a type under out_dir, and one of those that can't be parsed; each document is in its table once, wherever the stream was stopped and started again."""
    out = arriving(spark, in_dir, files_per_trigger).writeStream.foreachBatch(lambda batch, batch_id: write_batch(batch, batch_id, out_dir)).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()
