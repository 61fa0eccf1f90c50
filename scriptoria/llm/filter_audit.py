"""Audit of how five filters of documents interact, over all orders in which they can be applied.

Conditions of failure: A under 100 words, B fewer than 80 distinct words in 100, C over 10 capitals A-Z in 100 code points, D any of `#$%&*|`, E the text of a smaller doc_id, wherever in the table. Words are maximal runs of
characters other than the six white-space characters of ASCII, case-sensitive.

A to D are read off each text in one scan, which leaves a narrow row: doc_id, part, a hash of the text and the conditions failed. E is an existential self-join: a left-semi join on the hash, the exact text and a smaller doc_id. Only texts
whose hash occurs under two doc_ids at least are sent to it (by a filter without false negatives), and its right side holds the smallest doc_id of each text only, so no pairs of a group of copies are made. A hash that holds over
a thousandth of all rows, of which there are under a thousand, is dealt to as many cells on the left as it has thousandths, and its right rows to each of these. The failures by E are united with the others by id, and
documents are counted by part and combination of failures; at most 32 rows a part then give all orders and steps.

Defined results: a null text counts as empty, a null lang as the part ''. A row without doc_id fails E never, makes no other row fail it, and has no labels. Rows that repeat count each; none of them has a smaller doc_id than the
other. A document has a label if any of its rows in labels says so. An empty table gives no rows. Texts of any length are read whole. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Filter, checkpointed

FILTERS = "ABCDE"
WHITE = r"[\x20\x09-\x0D]+"
#: A hash with more rows than one in so many is dealt out to several cells.
SHARES = 1000
STEP = "struct<filter_order: string, step: int, bit: int, before: int>"


def failed_bits(text: Column, words: Column) -> Column:
    """The conditions A to D that a text fails, as bits."""
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    failed = (n < 100, F.size(F.array_distinct(words)) * 100 < n * 80, capitals.cast("long") * 100 > F.length(text).cast("long") * 10, text.rlike("[#$%&*|]"))
    return sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate(failed)), F.lit(0))


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"), F.xxhash64(text).alias("h"))


def later_copies(docs: DataFrame, narrow: DataFrame) -> DataFrame:
    """doc_id, part and h of the rows whose text is that of a smaller doc_id. narrow: doc_id and h of all rows, written once."""
    shared = checkpointed(narrow.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter(F.col("lo") < F.col("hi")).select("h", "n"))
    sent = docs.sparkSession.sparkContext.broadcast(Filter(shared.select(F.col("h").alias("key"))))

    @F.pandas_udf("boolean")
    def may_be_shared(h: pd.Series) -> pd.Series:
        return pd.Series(sent.value.has(h.to_numpy(np.int64)))

    n = narrow.count()
    cells = (F.col("n") * SHARES / max(1, n)).cast("int") + 1
    hot = F.broadcast(shared.filter(F.col("n") * SHARES > n).select("h", cells.alias("cells")))  # under SHARES rows of two numbers
    held = _rows(docs).filter(F.col("doc_id").isNotNull() & may_be_shared("h")).join(hot, "h", "left").withColumn("cells", F.coalesce("cells", F.lit(1)))
    left = held.withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.col("cells")).cast("int"))
    least = held.groupBy("h", "text").agg(F.min("doc_id").alias("least"), F.max("cells").alias("cells"))
    right = least.select(F.col("h").alias("of_h"), F.col("text").alias("of_text"), "least", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("of_cell"))
    same = (F.col("h") == F.col("of_h")) & (F.col("cell") == F.col("of_cell")) & (F.col("text") == F.col("of_text"))
    return left.join(right, same & (F.col("least") < F.col("doc_id")), "left_semi").select("doc_id", "part", "h")


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, failed (bits of FILTERS), n, good and toxic: how many documents of a part fail just these conditions."""
    read = _rows(docs).withColumn("words", F.array_remove(F.split("text", WHITE), ""))
    narrow = checkpointed(read.select("doc_id", "part", "h", failed_bits(F.col("text"), F.col("words")).alias("failed")))
    # rows without an id are told apart by their texts, and spread by them
    at = F.coalesce("doc_id", "h").alias("at")
    ids = narrow.select(at, "doc_id", "part", "h", "failed", F.lit(1).alias("n")).unionByName(later_copies(docs, narrow).select(at, "doc_id", "part", "h", F.lit(1 << 4).alias("failed"), F.lit(0).alias("n")))
    known = ids.groupBy("at", "doc_id", "part", "h").agg(F.bit_or("failed").alias("failed"), F.sum("n").alias("n"))
    is_one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    marks = labels.select(F.col("doc_id").cast("long").alias("of"), "quality", "toxic").filter("of IS NOT NULL").groupBy("of").agg(is_one("quality").alias("is_good"), is_one("toxic").alias("is_toxic"))
    met = known.join(marks, (F.col("at") == F.col("of")) & (F.col("doc_id") == F.col("of")), "left")
    count = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0)))
    return met.groupBy("part", "failed").agg(F.sum("n").alias("n"), count("is_good").alias("good"), count("is_toxic").alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, and how many documents the step keeps, removes, finds removed, and loses, for each part, order and step."""
    steps = [(order, i + 1, 1 << FILTERS.index(f), sum(1 << FILTERS.index(g) for g in order[:i])) for order in map("".join, permutations(FILTERS)) for i, f in enumerate(order)]
    every = F.array(*[F.struct(*map(F.lit, s)).cast(STEP) for s in steps])
    rows = checkpointed(combinations(docs, labels)).select("*", F.explode(every).alias("s")).select("part", "failed", "n", "good", "toxic", "s.*")
    fails, earlier = F.col("failed").bitwiseAND(F.col("bit")) > 0, F.col("failed").bitwiseAND(F.col("before")) > 0
    here = fails & ~earlier
    total = lambda when, what: F.sum(F.when(when, what).otherwise(0)).cast("long")
    # of the 120 orders, those in which this filter comes first among the ones a document fails
    first = F.col("n") * (F.lit(120) / F.bit_count("failed")).cast("long")
    return rows.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~earlier, F.col("n")).alias("kept"), total(here, F.col("n")).alias("removed"), total(fails & earlier, F.col("n")).alias("redundant"), total(F.col("failed") == F.col("bit"), F.col("n")).alias("unique_fails"),
        total(here, F.col("good")).alias("good_lost"), total(here, F.col("toxic")).alias("toxic_lost"), total(fails, first).alias("shapley"),
    )


#: The same table in SQL.
AUDIT_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
m AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, {
    'A': len(ws) < 100, 'B': 100 * len(list_distinct(ws)) < 80 * len(ws), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
    'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(least < w.doc_id, false)} AS x FROM w LEFT JOIN m ON m.doc_id = w.doc_id),
g AS (SELECT part, good, toxic, CASE WHEN x.A THEN 'A' ELSE '' END || CASE WHEN x.B THEN 'B' ELSE '' END || CASE WHEN x.C THEN 'C' ELSE '' END || CASE WHEN x.D THEN 'D' ELSE '' END || CASE WHEN x.E THEN 'E' ELSE '' END AS failed FROM f),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, CAST(step AS INT) AS step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT g.*, s.*, contains(failed, own) AS fails, len(list_filter(string_split(before, ''), lambda b: b <> '' AND contains(failed, b))) > 0 AS earlier FROM g, s),
k AS (SELECT part, filter_order, step, own, count(*) FILTER (NOT fails AND NOT earlier) AS kept, count(*) FILTER (fails AND NOT earlier) AS removed, count(*) FILTER (fails AND earlier) AS redundant,
    count(*) FILTER (failed = own) AS unique_fails, count(*) FILTER (fails AND NOT earlier AND good = 1) AS good_lost, count(*) FILTER (fails AND NOT earlier AND toxic = 1) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM k"""
