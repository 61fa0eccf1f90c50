"""Exact deduplication by composable polynomial fingerprints, confirmed by a chunkwise comparison.

A text is lower-cased in A-Z only and read as a sequence of 16-bit symbols s_0 .. s_{n-1} (an odd last byte is padded
with a zero; the length in bytes is part of the key). Its fingerprint is sum s_i * B^(n-1-i) modulo two primes. A chunk's
fingerprint shifted by B^(symbols after the chunk) is the chunk's term, and a document's fingerprint is the plain sum of
its chunks' terms modulo the prime, so chunks of a huge document are hashed by parallel tasks and meet in one sum.

Texts with equal fingerprints are then compared chunk by chunk: for each (fingerprint, chunk number) the smallest and the
largest chunk must be the same bytes. The comparison is an aggregate, with partial results before its shuffle, so a group
of copies of any size costs one row for each task that holds some. A fingerprint with unequal texts is split by SHA-256.

Defined results: a null text counts as empty; all empty texts are equal. Of rows that repeat doc_id and text, one is kept.
A null doc_id sorts below every number, so it is kept only if its whole group has none. Of rows that tie the choice is any one. A text of
any length is compared whole. Other columns, whatever their names, are not read, and carried along by `drop_exact_copies`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Filter, checkpointed, keep_rows, row_key, texts, with_group

PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1664525953)
#: Symbols of 2 bytes in a chunk; sums of 2**15 products below 2**47 stay below 2**62.
CHUNK_SYMBOLS = 1 << 15
CHUNK_BYTES = 2 * CHUNK_SYMBOLS
KEY = ["fp1", "fp2", "n_bytes"]


@lru_cache(8)
def _powers(base: int, prime: int) -> np.ndarray:
    out, x = np.empty(CHUNK_SYMBOLS, np.uint64), 1
    for i in range(CHUNK_SYMBOLS - 1, -1, -1):
        out[i], x = x, x * base % prime
    return out


def normalise(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased and nothing else changed."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def chunk_fingerprint(chunk: bytes, primes: tuple[int, int] = PRIMES) -> tuple[int, int, int]:
    """(hash modulo each prime, number of symbols) of at most CHUNK_BYTES bytes."""
    sym = np.frombuffer(chunk + b"\0" if len(chunk) % 2 else chunk, "<u2").astype(np.uint64)
    return (*(int(sym.dot(_powers(b, p)[CHUNK_SYMBOLS - len(sym) :])) % p for b, p in zip(BASES, primes, strict=True)), len(sym))


def combine(a: tuple[int, int, int], b: tuple[int, int, int], primes: tuple[int, int] = PRIMES) -> tuple[int, int, int]:
    """Fingerprint of a text from those of its two parts; the first part has whole symbols only."""
    return (*((x * pow(base, b[2], p) + y) % p for x, y, base, p in zip(a[:2], b[:2], BASES, primes, strict=True)), a[2] + b[2])


def fingerprint(data: bytes, primes: tuple[int, int] = PRIMES) -> tuple[int, int]:
    """Fingerprint of a whole text by combining those of its chunks."""
    out = (0, 0, 0)
    for i in range(0, len(data), CHUNK_BYTES):
        out = combine(out, chunk_fingerprint(data[i : i + CHUNK_BYTES], primes), primes)
    return out[:2]


def _split_rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for doc_id, key, tag, text in zip(b["doc_id"], b["row_key"], b["tag"], b["text"], strict=True):
            data = normalise(text)
            sha = hashlib.sha256(data).hexdigest()
            for i in range(0, len(data), CHUNK_BYTES):
                rest = -(-max(0, len(data) - i - CHUNK_BYTES) // 2)
                yield pd.DataFrame({"doc_id": [doc_id], "row_key": [key], "tag": [tag], "n_bytes": [len(data)], "text_sha256": [sha], "rest": [rest], "chunk": [data[i : i + CHUNK_BYTES]]}).astype({"doc_id": "Int64"})


def fingerprints(docs: DataFrame, huge_bytes: int = 1 << 24, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """A row for each document: doc_id, row_key, tag, fp1, fp2, n_bytes, text_sha256.

    huge_bytes: longer texts are dealt out as chunks; their terms are summed. It changes where the work is done only.
    """

    def whole_rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            data = [normalise(t) for t in b["text"]]
            fps = [fingerprint(d, primes) for d in data]
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "row_key": b["row_key"], "tag": b["tag"],
                "fp1": [f[0] for f in fps], "fp2": [f[1] for f in fps], "n_bytes": [len(d) for d in data],
                "text_sha256": [hashlib.sha256(d).hexdigest() for d in data],
            })

    def term_rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = [chunk_fingerprint(c, primes) for c in b["chunk"]]
            out = b.drop(columns=["rest", "chunk"])
            for m in (0, 1):
                out[f"t{m + 1}"] = [f[m] * pow(BASES[m], int(r), primes[m]) % primes[m] for f, r in zip(fps, b["rest"], strict=True)]
            yield out

    base = texts(docs, row_key(F.col("text")).alias("row_key")).withColumn("tag", F.monotonically_increasing_id())
    plain = base.filter(F.octet_length("text") <= huge_bytes).mapInPandas(whole_rows, "doc_id long, row_key long, tag long, fp1 long, fp2 long, n_bytes long, text_sha256 string")
    head = ["doc_id", "row_key", "tag", "n_bytes", "text_sha256"]
    parts = base.filter(F.octet_length("text") > huge_bytes).mapInPandas(_split_rows, "doc_id long, row_key long, tag long, n_bytes long, text_sha256 string, rest long, chunk binary")
    terms = parts.repartition(F.xxhash64("tag", "rest")).mapInPandas(term_rows, "doc_id long, row_key long, tag long, n_bytes long, text_sha256 string, t1 long, t2 long")
    huge = terms.groupBy(*head).agg((F.sum("t1") % primes[0]).alias("fp1"), (F.sum("t2") % primes[1]).alias("fp2"))
    return plain.unionByName(huge)


def unequal(docs: DataFrame, shared: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """The fingerprints among shared whose texts are not all the same, found by comparing their chunks. Of texts with other fingerprints hardly any chunk leaves its task."""
    number = F.shiftleft("fp1", 33).bitwiseOR(F.shiftleft("fp2", 2))
    sent = docs.sparkSession.sparkContext.broadcast(Filter(shared.select(number.alias("key"))))

    def chunk_rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (part.iloc[k : k + 512] for part in batches for k in range(0, len(part), 512)):
            data = [normalise(t) for t in b["text"]]
            keys = [fingerprint(d, primes) for d in data]
            may = sent.value.has(np.array([x << 33 | y << 2 for x, y in keys], np.uint64).view(np.int64))
            rows = [(*key, len(d), i, d[i : i + CHUNK_BYTES]) for d, key, ok in zip(data, keys, may, strict=True) if ok for i in range(0, len(d), CHUNK_BYTES)]
            yield pd.DataFrame(rows, columns=[*KEY, "part", "chunk"])

    chunks = texts(docs).select("text").mapInPandas(chunk_rows, "fp1 long, fp2 long, n_bytes long, part long, chunk binary")
    # the smallest and largest of what a task holds go on, however many copies it holds
    spread = chunks.groupBy(*KEY, "part").agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi")).filter(F.col("lo") != F.col("hi"))
    return spread.select(*KEY).distinct().join(shared.select(*KEY), KEY, "left_semi")


def exact_classes(docs: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, and row_key, for every row of docs. The classes don't depend on the primes."""
    rows = checkpointed(fingerprints(docs, primes=primes))
    found = checkpointed(rows.groupBy(*KEY).agg(F.count("*").alias("n")).filter("n > 1"))
    split = checkpointed(unequal(docs, found, primes).withColumn("split", F.lit(True)))  # collisions, of which there are next to none
    keyed = rows.join(split, KEY, "left").withColumn("by", F.when(F.col("split"), F.col("text_sha256")).otherwise("")).drop("split")
    groups = checkpointed(keyed.groupBy(*KEY, "by").agg(F.max(F.struct("doc_id", "row_key", "tag")).alias("keep"), F.count("*").alias("group_size")))
    out = with_group(keyed, groups, [*KEY, "by"], "group_size")
    return out.select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("tag") == F.col("keep.tag")).alias("kept"), "text_sha256", "row_key",
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """docs, with one row for each text: the one with the largest doc_id."""
    out = checkpointed(exact_classes(docs).select("doc_id", "row_key", "kept"))
    repeated = bool(out.groupBy("doc_id", "row_key").count().filter("count > 1").limit(1).count())
    return keep_rows(docs, out.filter("kept"), repeated)
