"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, which driver and executors share; where it is unset, one of this machine, if all runs on it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id long, text) with null texts as empty ones, whatever else the table holds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of doc_id as text, modulo folds; -1 where doc_id is null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(-1)).cast("int")


def row_key(text: Column) -> Column:
    """What tells rows of one doc_id apart: a hash of the text as it is, null texts as empty ones."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keep_rows(docs: DataFrame, kept: DataFrame, repeated: bool) -> DataFrame:
    """The rows of docs with (doc_id, row_key) in kept, with the columns of docs.

    repeated: whether a kept pair may stand on several rows of docs, of which one is to stay.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("of"), row_key(F.col("text")).alias("key"))
    k = kept.select(F.col("doc_id").alias("kept_of"), F.col("row_key").alias("kept_key"))
    out = packed.join(k, F.col("of").eqNullSafe(F.col("kept_of")) & (F.col("key") == F.col("kept_key")), "left_semi")
    if repeated:
        out = out.dropDuplicates(["of", "key"])
    return out.select(*[F.col(f"row.`{c}`") for c in docs.columns])


def with_group(rows: DataFrame, groups: DataFrame, on: list[str], size: str) -> DataFrame:
    """rows beside the row of their group; groups: written once, a row for each group, with its size.

    Groups that hold over a thousandth of all rows, of which there can't be more than a thousand, are broadcast: their rows stay where they are, and no task gets a large group.
    """
    n = groups.agg(F.sum(size)).first()[0] or 0
    large = groups.filter(F.col(size) * 1000 > n)
    rest = rows.join(F.broadcast(large.select(*on)), on, "left_anti").join(groups.filter(F.col(size) * 1000 <= n), on)
    return rows.join(F.broadcast(large), on).unionByName(rest)


class Filter:
    """A set of keys as bits, two a key: by its first `bits` binary digits, and by the last `bits` of its first 42. Says yes to all of the set, and to few others.

    Keys are hashes, of which the first 42 digits count.
    """

    def __init__(self, keys: DataFrame) -> None:
        """keys: one column, key."""
        n = keys.count()
        self.bits = min(28, max(16, (16 * n).bit_length()))
        inner = self.bits - 10
        both = F.array(F.shiftrightunsigned("key", 64 - self.bits), F.shiftrightunsigned("key", 22).bitwiseAND((1 << self.bits) - 1))
        slots = keys.select(F.explode(both).alias("slot")).select((F.expr(f"slot div {1 << inner}")).cast("int").alias("piece"), (F.col("slot") % (1 << inner)).cast("int").alias("slot"))

        def piece(part: pd.DataFrame) -> pd.DataFrame:
            held = np.zeros(1 << inner, bool)
            held[part["slot"].to_numpy()] = True
            return pd.DataFrame({"piece": part["piece"].iloc[:1], "held": [np.packbits(held, bitorder="little").tobytes()]})

        self.held = np.zeros(1 << (self.bits - 3), np.uint8)
        size = 1 << (inner - 3)
        for r in slots.groupBy("piece").applyInPandas(piece, "piece int, held binary").toLocalIterator():
            self.held[r["piece"] * size : (r["piece"] + 1) * size] = np.frombuffer(r["held"], np.uint8)

    def _set(self, slot: np.ndarray) -> np.ndarray:
        return (self.held[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

    def has(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.view(np.uint64)
        out = self._set(keys >> np.uint64(64 - self.bits))
        out[out] = self._set(keys[out] >> np.uint64(22) & np.uint64((1 << self.bits) - 1))
        return out
