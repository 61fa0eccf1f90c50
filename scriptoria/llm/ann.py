"""Approximate nearest neighbours by additive quantisation.

A unit vector is coded as the sum of one codeword from each of several codebooks of the full dimension. The codebooks are fitted on a bounded sample: residual k-means, then rounds of
beam-search encoding and least-squares updates of the codebooks, each with the others held. Every row is encoded by beam search, and the length of its decoded vector is stored. A query makes one table of inner
products for each codebook; a row's score is the sum of its entries, over the stored length. The best `rerank` rows of each query, and all whose
scores come within the tables' error of the last of them, are then ranked exactly on the original vectors.

Equal vectors are searched once. Of each distinct vector the smallest ids are kept, as many as an answer can hold (an exact bound, not a cap: ties go to the smaller id). Queries and coded rows meet in a grid of blocks,
in which a row is its code, length and id; only what goes on to the ranking is joined with its vector. The stated queries are a fiftieth of the rows, so the grid's work grows with the square of the rows, at a few bytes
and table look-ups a pair.

Defined results: vectors that are null, empty or zero, or hold null or non-finite components, or whose length isn't the most frequent one, take no part (cosines are defined between vectors of one length only); neither do rows without an id.
Rows that repeat an id and a vector count once. An id with several vectors gets an answer for each; no row of its own id is in it. Components of any size are
scored as they are. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

BOOKS, WORDS, BEAM, SAMPLE = 32, 16, 6, 8192
TOP, RERANK, QUERIES, ROWS = 5, 160, 1024, 65536


def beam_codes(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (rows x books) whose words sum close to x: of each row the best `beam` partial sums go on."""
    n, (m, k, d) = len(x), books.shape
    out = np.empty((n, m), np.uint8)
    norms = (books**2).sum(2)
    for s in range(0, n, 2048):
        part = x[s : s + 2048]
        rows = np.arange(len(part))[:, None]
        left, codes = part[:, None, :], np.zeros((len(part), 1, 0), np.uint8)
        for j in range(m):
            err = (left**2).sum(2)[:, :, None] - 2 * left @ books[j].T + norms[j]
            flat = err.reshape(len(part), -1)
            keep = min(beam if j < m - 1 else 1, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            parent, word = best // k, best % k
            left = left[rows, parent] - books[j][word]
            codes = np.concatenate([codes[rows, parent], word[:, :, None].astype(np.uint8)], 2)
        out[s : s + 2048] = codes[:, 0]
    return out


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[j][codes[:, j]] for j in range(books.shape[0]))


def fit_books(x: np.ndarray, m: int = BOOKS, k: int = WORDS, rounds: int = 2, seed: int = 3) -> np.ndarray:
    """Codebooks (m x k x d) for the rows of x."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    left, books = x.copy(), []
    for _ in range(m):
        c = left[rng.choice(len(x), k, replace=False)].copy()
        for _ in range(6):
            near = ((c**2).sum(1) - 2 * left @ c.T).argmin(1)
            size = np.bincount(near, minlength=k)
            sums = np.zeros_like(c)
            np.add.at(sums, near, left)
            c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)
        books.append(c)
        left = left - c[((c**2).sum(1) - 2 * left @ c.T).argmin(1)]
    books = np.stack(books)
    for _ in range(rounds):
        codes = beam_codes(x, books, 4)
        left = x - decode(codes, books)
        for _ in range(3):  # least squares, a codebook at a time with the others held
            for j in range(m):
                size = np.bincount(codes[:, j], minlength=k)[:, None]
                sums = np.zeros_like(books[j])
                np.add.at(sums, codes[:, j], left)
                step = sums / (size + 1.0)
                books[j] += step
                left -= step[codes[:, j]]
    return books.astype(np.float32)


def table_scores(q: np.ndarray, codes: np.ndarray, lengths: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Scores (queries x rows) from look-up tables."""
    tables = np.einsum("qd,mkd->mqk", q, books, optimize=True)
    total = tables[0][:, codes[:, 0]]
    for j in range(1, len(books)):
        total += tables[j][:, codes[:, j]]
    return total / lengths


def _usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0)


def nearest(vectors: DataFrame, top: int = TOP, every: int = 50, rerank: int = RERANK, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id and score: for each row whose id is divisible by `every` the `top` nearest other rows."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & _usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    out_schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], out_schema)
    rows = rows.filter(F.size("v") == sizes[0]["d"])

    # a rank with a limit keeps only `top + 1` ids of a vector in each task before the shuffle, however often a row repeats
    smallest = Window.partitionBy("v").orderBy("vec_id")
    ids = rows.withColumn("n", F.dense_rank().over(smallest)).filter(F.col("n") <= top + 1).groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    # numbered for good as they are written; an id may stand first for several vectors
    reps = checkpointed(ids.select(F.monotonically_increasing_id().alias("rep"), F.col("ids")[0].alias("least"), "ids", "v"))
    asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["vec_id", "v"])
    asked = checkpointed(asked.join(reps.select("v", "rep"), "v").select("vec_id", "rep"))
    # an id with several vectors is no answer to its own: it asks for itself, and vectors that it alone has are passed over for it
    several = asked.groupBy("vec_id").count().filter("count > 1").select("vec_id", F.col("vec_id").alias("own"))
    asked = checkpointed(asked.join(several, "vec_id", "left"))
    queries = asked.select("rep", "own").distinct().join(reps, "rep").select(F.col("rep").alias("q"), "own", F.col("v").alias("qv"))

    n, nq = reps.count(), asked.select("rep", "own").distinct().count()
    h = F.xxhash64(F.lit(5), "least", "v")
    bound = min(2**63 - 1, int(-(2**63) + min(1.0, 2 * sample / n) * 2**64))  # about twice as many pass
    fitted = reps.filter(h <= F.lit(bound)).orderBy(h).limit(sample).select("v").toPandas()["v"]
    x = np.stack([np.asarray(v, np.float64) for v in fitted])
    scale = np.abs(x).max(1, keepdims=True)
    x = x / scale
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    fitted_books = fit_books(x)
    # how far a score from tables is off, at the spread of one standard deviation
    near_x = decode(beam_codes(x[:512].astype(np.float32), fitted_books), fitted_books)
    margin = float((x[:512] @ (near_x / np.maximum(np.linalg.norm(near_x, axis=1, keepdims=True), 1e-9) - x[:512]).T).std())
    books = spark.sparkContext.broadcast(fitted_books)

    def unit(v: pd.Series) -> np.ndarray:
        x = np.stack([np.asarray(r, np.float64) for r in v])
        x = x / np.abs(x).max(1, keepdims=True)
        return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)

    def code_rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                codes = beam_codes(unit(b["v"]), books.value)
                yield pd.DataFrame({"c": b["rep"].to_numpy(), "sole": b["sole"].astype("Int64"), "code": [r.tobytes() for r in codes], "length": np.linalg.norm(decode(codes, books.value), axis=1).astype(np.float32)})

    # a coded row is 32 bytes of code, its length, its id, and whether that id alone has it, whatever the dimension
    nqb, ncb = max(1, -(-nq // QUERIES)), max(1, -(-n // ROWS))
    codes = reps.select("rep", F.when(F.size("ids") == 1, F.col("least")).alias("sole"), "v").mapInPandas(code_rows, "c long, sole long, code binary, length float")
    codes = codes.withColumn("cb", F.pmod(F.xxhash64("c"), F.lit(ncb)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nqb - 1))))
    blocks = queries.withColumn("qb", F.pmod(F.xxhash64("q", "own"), F.lit(nqb)).cast("int")).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(ncb - 1))))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q": [], "own": [], "c": [], "s": []})
        code = np.frombuffer(b"".join(left["code"]), np.uint8).reshape(len(left), -1)
        length, c = np.maximum(left["length"].to_numpy(np.float32), 1e-6), left["c"].to_numpy()
        none = left["sole"].isna().to_numpy()
        sole = left["sole"].astype("Int64").fillna(0).to_numpy(np.int64)
        qs, owns, cs, ss = [], [], [], []
        for k in range(0, len(right), 64):
            part = right.iloc[k : k + 64]
            s = table_scores(unit(part["qv"]), code, length, books.value)
            for i, own in enumerate(part["own"]):
                if not pd.isna(own):
                    s[i, ~none & (sole == int(own))] = -np.inf
            keep = min(rerank, s.shape[1])
            least = -np.partition(-s, keep - 1, axis=1)[:, keep - 1] - margin
            for q, own, row, low in zip(part["q"], part["own"], s, least, strict=True):
                # rows whose tables say the same as the last one's are looked at as well, however many they are
                at = np.flatnonzero((row >= low) & (row > -np.inf) | (c == q))
                qs.append(np.full(len(at), q))
                owns += [own] * len(at)
                cs.append(c[at])
                ss.append(row[at])
        return pd.DataFrame({"q": np.concatenate(qs), "own": pd.array([None if pd.isna(x) else int(x) for x in owns], "Int64"), "c": np.concatenate(cs), "s": np.concatenate(ss).astype(np.float64)})

    @F.pandas_udf("double")
    def cosine(v: pd.Series, qv: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype="float64")
        # by powers of two, which change no digit, so that no square is too large or too small
        x, y = (z * np.ldexp(1.0, np.clip(-np.frexp(np.abs(z).max(1))[1], -1022, 1022))[:, None] for z in (np.stack(v), np.stack(qv)))
        return pd.Series((x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1))))

    met = codes.groupBy("qb", "cb").cogroup(blocks.groupBy("qb", "cb")).applyInPandas(search, "q long, own long, c long, s double")
    # over all blocks the best by the tables go on, with all in their error of the last, and are ranked on the vectors
    by_table = Window.partitionBy("q", "own").orderBy(F.desc("s"), "c")
    last = F.nth_value("s", rerank).over(by_table.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    near = met.withColumn("last", last).filter(F.col("last").isNull() | (F.col("s") >= F.col("last") - F.lit(margin)) | (F.col("c") == F.col("q"))).select("q", "own", "c")
    vectors_of = queries.select("q", "qv").dropDuplicates(["q"])
    exact = near.join(reps.select(F.col("rep").alias("c"), "least", "ids", "v"), "c").join(vectors_of, "q").select("q", "own", "c", "least", "ids", cosine("v", "qv").alias("score"))
    best = Window.partitionBy("q", "own").orderBy(F.desc("score"), "least", "c")
    ranked = exact.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= top + 1).select("q", "own", "score", F.explode("ids").alias("vec_id")).filter(~F.col("vec_id").eqNullSafe(F.col("own")))
    first = Window.partitionBy("q", "own").orderBy(F.desc("score"), "vec_id")
    held = ranked.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= top + 1).withColumnRenamed("own", "held_own")
    of = asked.withColumnRenamed("vec_id", "query_id")
    answer = of.join(held, (F.col("rep") == F.col("q")) & F.col("own").eqNullSafe(F.col("held_own"))).filter(F.col("vec_id") != F.col("query_id"))
    place = Window.partitionBy("query_id", "q", "own").orderBy(F.desc("score"), "vec_id")
    return answer.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
