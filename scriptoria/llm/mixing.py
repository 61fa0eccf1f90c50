"""Mixing of sources to target weights by proportionate-fair (Pfair) scheduling.

Each source's rows, in a hashed order, form blocks of block_rows rows. A source with weight w (of a total of 1) has for its
block j the release time floor(j / w) and the deadline ceil((j + 1) / w), in slots of one block; in each slot the released
block with the earliest deadline is placed (ties: the source named first). Windows of this shape always admit such a
schedule, and then after any number t of slots every source has more than w t - 1 and fewer than w t + 1 blocks placed.

Weights are taken as they are: a float is a fraction, and all of them are whole numbers over one total, whatever its size, so releases and deadlines are exact and the bound holds for the
weights that were given, over any number of slots and for any number of sources. When a source has used up its blocks, a phase ends: the next one shares the slots among the others by their
weights, and counts anew. So every row is placed once, none is repeated or dropped, and the bound holds in each phase.

Slots are laid out by Spark, in chunks that know nothing of each other. What earliest deadline first has placed before slot t has a closed form: every source's floor(w t) whole blocks, and of the sources with a
fraction of a block left, one block more for as many as make up t: in order of their deadlines, those that still fit, for from any time u on no more blocks can have been placed than there are slots to t. (Sets of
blocks that fit before t are a matroid, and placing the earliest deadline first in each slot gives its greedy choice.) So a task starts at any slot from that state. The driver holds one row count a source, and finds
where each phase ends by placing blocks from the release of the first last block on; both take the square of the number of sources.

Rows are numbered without gathering a source in one task: they are dealt to hashed buckets of bounded size, counted, and numbered inside a bucket from the bucket's offset; a row finds its slot by a join on its
source and block.

Defined results: a null source is the source ''. Rows that repeat take places of their own; ties of hashes go by doc_id. An empty table gives an empty schedule. Sources that weights doesn't name, or to which it gives
nothing, get the smallest weight that it gives to one of the others. Other columns, whatever their names, are carried along; `mix` puts its own mix_slot and mix_place in place of columns of these names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from fractions import Fraction
from math import lcm

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 16
#: Rows of a hashed bucket, about, and slots of a chunk.
BUCKET_ROWS, CHUNK = 1 << 12, 1 << 12


def tempered_weights(counts: dict[str, int], exponent: float = 0.5) -> dict[str, float]:
    """Target weights in proportion to a power of the sources' sizes, which lifts small sources."""
    return {s: float(n) ** exponent for s, n in counts.items() if n}


def parts_of(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in the very proportions of the weights."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    below = lcm(*(x.denominator for x in exact.values()))
    return {s: int(x * below) for s, x in exact.items()}


def _whole_before(times: list[int], parts: list[int]) -> np.ndarray:
    """ceil(w u), the blocks released before u, of each source (rows) at each time (columns)."""
    size = sum(parts)
    near = np.outer([p / size for p in parts], np.array(times, np.float64))
    out = np.ceil(near)
    for i, k in np.argwhere(np.abs(near - np.rint(near)) < 1e-6 + near * 1e-12).tolist():  # where floats can't tell
        out[i, k] = -(-parts[i] * times[k] // size)
    return out


def placed_before(t: int, parts: list[int]) -> list[int]:
    """How many blocks of each source of a phase earliest deadline first has placed in the slots before t."""
    size = sum(parts)
    used = [p * t // size for p in parts]
    begun = sorted((-(-(used[i] + 1) * size // p), i, used[i] * size // p) for i, p in enumerate(parts) if p * t % size)
    if not begun:
        return used
    times = sorted({r for _, _, r in begun})
    rank, whole = {r: k for k, r in enumerate(times)}, np.array(used, np.float64)
    # slots from each time on that whole blocks released from then on leave free
    room = t - np.array(times, np.float64) - np.maximum(0, whole[:, None] - _whole_before(times, parts)).sum(0)
    left = t - sum(used)
    for _, i, r in begun:
        if not left:
            break
        k = rank[r] + 1
        if room[:k].min() >= 1:
            room[:k] -= 1
            used[i] += 1
            left -= 1
    return used


def phase_list(blocks: list[int], parts: list[int]) -> list[tuple[int, list[int], list[int]]]:
    """(slots, sources, blocks of each placed before) of each phase; a phase ends with the slot in which a source's last block is placed."""
    left = {i: n for i, n in enumerate(blocks) if n}
    out = []
    while left:
        live = list(left)
        own, size = [parts[i] for i in live], sum(parts[i] for i in live)
        # the first of the last blocks isn't placed before one of them is released
        start, ends = min((left[i] - 1) * size // parts[i] for i in live), 0
        for k, j, slot, _, _ in place(start, start + size, own):
            if j + 1 == left[live[k]]:
                ends = slot + 1
                break
        out.append((ends, live, [blocks[i] - left[i] for i in live]))
        left = {i: left[i] - n for i, n in zip(live, placed_before(ends, own), strict=True) if left[i] > n}
    return out


def place(start: int, end: int, parts: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """(source, its block, and the block's slot, release and deadline), for the slots of a phase from start on: earliest deadline first among released blocks."""
    size, used = sum(parts), placed_before(start, parts)
    release = lambda i: used[i] * size // parts[i]
    deadline = lambda i: -(-(used[i] + 1) * size // parts[i])
    ready = [(deadline(i), i, release(i)) for i in range(len(parts)) if release(i) <= start]
    coming = [(release(i), i) for i in range(len(parts)) if release(i) > start]
    heapq.heapify(ready)
    heapq.heapify(coming)
    for slot in range(start, end):
        while coming and coming[0][0] <= slot:
            r, i = heapq.heappop(coming)
            heapq.heappush(ready, (deadline(i), i, r))
        due, i, r = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("a block would miss its deadline")
        yield i, used[i], slot, r, due
        used[i] += 1
        heapq.heappush(coming, (release(i), i))


def block_table(docs: DataFrame, counts: dict[str, int], weights: dict[str, float], chunk: int = CHUNK) -> DataFrame:
    """source, block, phase, slot, release and deadline of every block, counted over all phases; counts: blocks of each source."""
    spark = docs.sparkSession
    names = sorted(counts)
    whole = parts_of(weights)
    parts = [whole[s] for s in names]
    found = phase_list([counts[s] for s in names], parts)
    starts = [0]
    for n, _, _ in found:
        starts.append(starts[-1] + n)
    chunks = sum(-(-n // chunk) for n, _, _ in found)
    sent = spark.sparkContext.broadcast((names, parts, [(live, before) for _, live, before in found]))  # at most the square of the number of sources

    def rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, parts, phases = sent.value
        top = (1 << 63) - 1  # a deadline further away than any slot
        for b in batches:
            for phase, first, k, n in zip(b["phase"].tolist(), b["first"].tolist(), b["k"].tolist(), b["n"].tolist(), strict=True):
                live, before = phases[phase]
                got = place(k * chunk, min((k + 1) * chunk, n), [parts[i] for i in live])
                out = [(names[live[i]], before[i] + j, phase, first + slot, first + r, min(first + due, top)) for i, j, slot, r, due in got]
                yield pd.DataFrame(out, columns=["source", "block", "phase", "slot", "release", "deadline"])

    held = spark.createDataFrame([(k, starts[k], n) for k, (n, _, _) in enumerate(found)], "phase int, first long, n long")
    held = held.select("*", F.explode(F.sequence(F.lit(0), F.expr(f"cast((n - 1) div {chunk} as int)"))).alias("k")).repartition(max(1, -(-chunks // 16)))
    return held.mapInPandas(rows, "source string, block long, phase int, slot long, release long, deadline long")


def schedule(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS, seed: int = 42) -> DataFrame:
    """row (a struct of the columns of docs), phase, block, slot (of the block, over all phases), place (in the block), release and deadline (in slots).

    weights: target weights by source, whatever their sum; None: in proportion to the root of the sources' sizes.
    """
    source = F.coalesce(F.col("source"), F.lit(""))
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), source.alias("source"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"))
    counts = {r["source"]: r["n"] for r in docs.groupBy(source.alias("source")).agg(F.count("*").alias("n")).collect()}  # a row a source
    weights = tempered_weights(counts) if weights is None else {s: float(weights.get(s) or 0.0) for s in counts}
    least = min((w for w in weights.values() if w > 0), default=1.0)
    table = block_table(docs, {s: -(-n // block_rows) for s, n in counts.items()}, {s: w if w > 0 else least for s, w in weights.items()})

    buckets = max(1, -(-sum(counts.values()) // BUCKET_ROWS))
    dealt = named.withColumn("bucket", F.pmod(F.shiftright("h", 20), F.lit(buckets)))
    sizes = dealt.groupBy("source", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("source", "bucket").orderBy("h", "row.doc_id")
    numbered = dealt.withColumn("n", F.row_number().over(inside)).join(offsets, ["source", "bucket"]).withColumn("i", F.col("before") + F.col("n") - 1)
    numbered = numbered.select("row", "source", F.expr(f"i div {block_rows}").alias("block"), (F.col("i") % block_rows).alias("place"))
    return numbered.join(table, ["source", "block"]).select("row", "phase", "block", "slot", "place", "release", "deadline")


def schedule_rows(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """doc_id, source, phase, block, slot, place, release_slot and deadline_slot of every row; texts stay where they are."""
    slim = docs.select("doc_id", "source", F.xxhash64(F.coalesce("text", F.lit(""))).cast("string").alias("text"))
    return schedule(slim, weights).select("row.doc_id", "row.source", "phase", "block", "slot", "place", F.col("release").alias("release_slot"), F.col("deadline").alias("deadline_slot"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, placed: bool = False) -> DataFrame:
    """docs, every row once, sorted by slot: files read one after another hold the mixture.

    placed: whether the slot, and the place in it, are added as mix_slot and mix_place; readers that pack files in another order need them.
    """
    more = {"slot": "mix_slot", "place": "mix_place"} if placed else {}
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c not in more.values()]
    return schedule(docs, weights).orderBy("slot", "place").select(*kept, *[F.col(c).alias(name) for c, name in more.items()])
