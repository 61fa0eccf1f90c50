"""Near-duplicate classes by DartMinHash signatures, banded joining and exact checks.

A document is a weighted set of shingles of five words (lower case, split at white space; a shorter text is one shingle).
DartMinHash throws hashed darts at the strip weight x rank of each shingle: the weight axis is cut into the layers [0, 1), [1, 2),
[2, 4), ..., and each layer's darts arrive along the rank axis as a Poisson process whose rate is the layer's width, all drawn from
hashes of (shingle, layer, arrival). A dart counts if it lies under the shingle's weight. It belongs to a coordinate of the signature, and the
dart of least rank is that coordinate's entry. Ranks are only explored up to theta, about (k ln k + 2k) / total weight, which is
doubled for the few documents with a coordinate still empty; so a signature takes a number of darts that hardly depends on the text's
length. Two signatures agree in a coordinate with probability equal to the weighted Jaccard similarity.
By default every shingle weighs 1 (Jaccard similarity of the shingle sets); by="count" weighs a shingle by its occurrences.

Documents with the same weighted set collapse to one representative first. Representatives that share a band meet in it: each with the band's first one, checked exactly on their shingles if sizes and
signatures allow the threshold. That labels most of a band alike. In bands that still hold several labels, all pairs with different ones are checked exactly, in cells of bounded size that Spark deals out:
rows outside a band's main label meet all others, so a band of any size makes no pairs as rows and lands in no single task. Classes are connected components, by minimum labels with pointer jumping.
A pair at a similarity of 0.8 shares no band, and so isn't looked at itself, with a chance of (1 - 0.8^4)^20 = 3e-5; pairs further up less.

Defined results: texts without a word (null, empty, blank) are each a class of their own; so is any text with no partner. Of a class the row with the smallest doc_id is kept, a row without one last, ties by row_id.
Rows that repeat are in one class. Only doc_id and text are read; other columns, whatever their names, are carried along by `drop_near_copies`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, keep_rows, row_key, texts, with_group

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 4
K = BANDS * ROWS
#: Members of a piece of a band, and columns of a membership matrix; both bound a task's memory only.
PIECE, COLUMNS = 256, 4096
SEED = 0x5EED
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A well-mixing bijection of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _unit(h: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from hashes."""
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


class Words:
    """Hashes of words, with a bounded memory."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def hashes(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > 400_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"), SEED)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(batch: list[str], words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, count) of the distinct shingles of each text, sorted by document and shingle."""
    split = [t.lower().split() for t in batch]
    n = np.fromiter(map(len, split), np.int64, len(split))
    h = words.hashes([w for s in split for w in s])
    doc = np.repeat(np.arange(len(split)), n)
    place = np.arange(len(h)) - (n.cumsum() - n)[doc]
    starts = np.flatnonzero(place <= np.maximum(n - size, 0)[doc])
    got = np.full(len(starts), size, np.uint64)
    left = np.minimum(n, size)[doc[starts]]
    for k in range(size):
        on = left > k
        got[on] = _mix(got[on] * _M3 + h[starts[on] + k])
    doc = doc[starts]
    order = np.lexsort((got, doc))
    doc, got = doc[order], got[order]
    first = np.ones(len(got), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (got[1:] != got[:-1])
    at = np.flatnonzero(first)
    return doc[at], got[at], np.diff(np.append(at, len(got)))


def dart_signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, k: int = K) -> np.ndarray:
    """Signatures, docs x k, of weighted sets; rows of documents without elements are zero."""
    total = np.bincount(doc, weight, docs)
    theta = np.where(total > 0, (k * np.log(k) + 2 * k) / np.maximum(total, 1e-300), 0)
    best_rank, best = np.full(docs * k, np.inf), np.zeros(docs * k, np.uint64)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        open_ = np.zeros(docs, bool)
        open_[todo] = True
        best_rank.reshape(docs, k)[todo] = np.inf
        d0, e0, w0 = (x[open_[doc]] for x in (doc, element, weight))
        layer = 0
        while len(d0):
            low, width = (0.0, 1.0) if layer == 0 else (float(1 << (layer - 1)), float(1 << (layer - 1)))
            d, w, h = d0, w0, _mix(e0 ^ _mix(np.array([layer + 1], np.uint64)))
            rank, arrival = np.zeros(len(d)), 0
            while len(d):
                arrival += 1
                h = _mix(h + _M3)
                rank = rank - np.log(_unit(h)) / width
                on = rank < theta[d]
                d, w, h, rank = d[on], w[on], h[on], rank[on]
                under = low + _unit(_mix(h ^ _M1)) * width < w if low + width > 1 or (w < 1).any() else slice(None)
                dart = _mix(h ^ _M2)[under]
                cell = d[under] * k + (dart % np.uint64(k)).astype(np.int64)
                r = rank[under]
                order = np.argsort(-r, kind="stable")
                cell, r, dart = cell[order], r[order], dart[order]
                last = np.full(docs * k, -1, np.int64) if len(cell) > docs else None
                if last is not None:
                    last[cell] = np.arange(len(cell))  # of each cell the dart of least rank comes last
                    at = last[last >= 0]
                else:
                    at = len(cell) - 1 - np.unique(cell[::-1], return_index=True)[1]
                cell, r, dart = cell[at], r[at], dart[at]
                less = r < best_rank[cell]
                best_rank[cell[less]], best[cell[less]] = r[less], dart[less]
            layer += 1
            more = w0 > (1 << (layer - 1))
            d0, e0, w0 = d0[more], e0[more], w0[more]
        empty = np.isinf(best_rank.reshape(docs, k)[todo]).any(1)
        todo = todo[empty]
        theta[todo] *= 2
    return best.reshape(docs, k)


def _nibbles(sig: np.ndarray) -> np.ndarray:
    """Four bits of each coordinate, 16 coordinates to a number."""
    four = (sig & np.uint64(15)).reshape(len(sig), -1, 16)
    return (four << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(2, dtype=np.uint64)


def _signature_rows(by: str, words: Words, b: pd.DataFrame) -> pd.DataFrame:
    doc, element, count = shingles(b["text"].tolist(), words)
    weight = count.astype(np.float64) if by == "count" else np.ones(len(count))
    n = len(b)
    sig = dart_signatures(doc, element, weight, n)
    size = np.bincount(doc, weight, n)
    content = _mix(element * _M3 + count.astype(np.uint64)) if by == "count" else _mix(element * _M3 + np.uint64(1))
    sums = np.zeros(n, np.uint64)
    np.add.at(sums, doc, content)
    other = np.zeros(n, np.uint64)
    np.add.at(other, doc, _mix(content ^ _M1))
    band = sig.reshape(n, BANDS, ROWS)
    key = np.zeros((n, BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _M3
    for r in range(ROWS):
        key = _mix(key ^ band[:, :, r]) + _M2
    return pd.DataFrame({
        "row_id": b["row_id"].to_numpy(), "doc_id": b["doc_id"].to_numpy(), "row_key": b["row_key"].to_numpy(), "size": size,
        "set1": sums.view(np.int64), "set2": other.view(np.int64),
        "sig": list(_nibbles(sig).view(np.int64)), "bands": list(key.view(np.int64)),
    }).astype({"doc_id": "Int64"})


def signatures(docs: DataFrame, by: str = "set") -> DataFrame:
    """row_id, doc_id, row_key, size (total weight), set1 and set2 (hash of the weighted set), sig (4 bits a coordinate) and bands."""

    def rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for b in batches:
            for _, part in b.groupby((b["text"].str.len().cumsum() // 1_500_000).to_numpy(), sort=False):
                yield _signature_rows(by, words, part)

    base = texts(docs, row_key(F.col("text")).alias("row_key")).withColumn("row_id", F.monotonically_increasing_id())
    return base.mapInPandas(rows, "row_id long, doc_id long, row_key long, size double, set1 long, set2 long, sig array<long>, bands array<long>")


def _differing(a: Column, b: Column) -> Column:
    """In how many coordinates two packed signatures differ."""
    out = F.lit(0)
    for i in range(K // 16):
        x = a[i].bitwiseXOR(b[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        out = out + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111)))
    return out


def _may_link(a: str, b: str, threshold: float) -> Column:
    """Whether the sizes and signatures of two structs (row_id, size, sig) allow the threshold, but for 6 standard deviations."""
    most = (1 - threshold) * K + 6 * (K * threshold * (1 - threshold)) ** 0.5
    fits = F.least(f"{a}.size", f"{b}.size") >= threshold * F.greatest(f"{a}.size", f"{b}.size") - 1e-9
    return (F.col(f"{a}.row_id") != F.col(f"{b}.row_id")) & fits & (_differing(F.col(f"{a}.sig"), F.col(f"{b}.sig")) <= int(most))


def _set_rows(by: str, words: Words, b: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for _, part in b.groupby((b["text"].str.len().cumsum() // 1_500_000).to_numpy(), sort=False):
        doc, element, count = shingles(part["text"].tolist(), words)
        cut = np.searchsorted(doc, np.arange(len(part) + 1))
        held = [element[s:e] if by == "set" else np.concatenate([_mix(element[s:e] + np.uint64(i) * _M3)[count[s:e] > i] for i in range(int(count[s:e].max()) if e > s else 1)]) for s, e in zip(cut[:-1], cut[1:], strict=True)]
        yield pd.DataFrame({"row_id": part["row_id"].to_numpy(), "elements": [x.view(np.int64) for x in held]})


def _sets(docs: DataFrame, named: DataFrame, by: str) -> DataFrame:
    """(row_id, elements) of the rows named by (row_id, doc_id, row_key), made from their texts again; written once."""
    keyed = texts(docs, row_key(F.col("text")).alias("row_key"))
    n = named.select("row_id", F.col("doc_id").alias("__id"), F.col("row_key").alias("__key"))
    wanted = keyed.join(n, keyed["doc_id"].eqNullSafe(F.col("__id")) & (F.col("row_key") == F.col("__key"))).select("row_id", "text")

    def rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for b in batches:
            yield from _set_rows(by, words, b)

    # a repeated row gives its set as often; one of them is as good as another
    return checkpointed(wanted.mapInPandas(rows, "row_id long, elements array<long>").dropDuplicates(["row_id"]))


def _checked(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose similarity reaches the threshold; a set that counts holds one element for each occurrence."""
    left = sets.select(F.col("row_id").alias("a"), F.col("elements").alias("ea"))
    right = sets.select(F.col("row_id").alias("b"), F.col("elements").alias("eb"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("ea", "eb")).cast("double")
    return both.filter(common >= threshold * (F.size("ea") + F.size("eb") - common) - 1e-9).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of edges (a, b): the least node of each one's component.

    Each round gives every node the least label of itself and its neighbours and then that label's own label, so paths shrink by halves.
    """
    links = checkpointed(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")))
    while True:
        near = links.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        stepped = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("next"))
        root = labels.select(F.col("node").alias("next"), F.col("label").alias("above"))
        jumped = checkpointed(stepped.join(root, "next", "left").select("node", F.least("next", F.coalesce("above", "next")).alias("label"), F.col("label").alias("was")))
        labels = jumped.select("node", "label")
        if not jumped.filter(F.col("label") != F.col("was")).limit(1).count():
            return labels


def _cells(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """band, i, j, row_id and label of the members of bands that hold several labels, dealt to cells (i, j) of at most two pieces of about PIECE members.

    A band's largest label is its main one; all other members are strays. Each stray meets each other member of its band in a cell; members of the main label needn't meet each other, so
    rows grow in proportion to a band's members while it has less than PIECE strays.
    """
    held = shared.select("band", "row.row_id").join(labels, "row_id", "left").select("band", "row_id", F.coalesce("label", "row_id").alias("label"))
    parts = held.groupBy("band", "label").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("band").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n"), F.count("*").alias("k")).filter("k > 1")
    mixed = mixed.select("band", "main", F.ceil((F.col("n") - F.col("n_main")) / PIECE).cast("int").alias("ps"), F.ceil(F.col("n_main") / PIECE).cast("int").alias("pm"))
    met = held.join(mixed, "band").withColumn("main", F.col("label") == F.col("main")).withColumn("p", F.pmod(F.xxhash64("row_id"), F.when(F.col("main"), F.col("pm")).otherwise(F.col("ps"))).cast("int"))
    cell = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    of_main = F.transform(F.sequence(F.lit(0), F.col("ps") - 1), lambda i: cell(i, F.col("ps") + F.col("p")))
    with_main = F.transform(F.sequence(F.lit(0), F.col("pm") - 1), lambda j: cell(F.col("p"), F.col("ps") + j))
    with_strays = F.transform(F.sequence(F.lit(0), F.col("ps") - 1), lambda q: cell(F.least("p", q), F.greatest("p", q)))
    dealt = met.select("band", "row_id", "label", F.explode(F.when(F.col("main"), of_main).otherwise(F.concat(with_main, with_strays))).alias("c"))
    return dealt.select("band", "c.i", "c.j", "row_id", "label")


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets share; columns of the membership matrix are taken in blocks of bounded size."""
    n = len(sets)
    element = np.concatenate(sets) if n else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    _, column, count = np.unique(element, return_inverse=True, return_counts=True)
    held = count[column] > 1
    column, owner = column[held], owner[held]
    out = np.zeros((n, n), np.float32)
    if not len(column):
        return out
    column = np.unique(column, return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for start in range(0, int(column[-1]) + 1, COLUMNS):
        lo, hi = np.searchsorted(column, [start, start + COLUMNS])
        member = np.zeros((n, min(COLUMNS, int(column[-1]) + 1 - start)), np.float32)
        member[owner[lo:hi], column[lo:hi] - start] = 1
        out += member @ member.T
    return out


def _cell_links(ids: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Links that tie together the labels of one cell as all its links do."""
    size = np.array([len(x) for x in sets], np.float64)
    common = _common(sets).astype(np.float64)
    near = np.triu((common >= threshold * (size[:, None] + size - common) - 1e-9) & (labels[:, None] != labels), 1)
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while x in above:
            x = above[x]
        return x

    out = []
    for a, b in np.argwhere(near).tolist():
        ra, rb = root(int(labels[a])), root(int(labels[b]))
        if ra != rb:
            above[max(ra, rb)] = min(ra, rb)
            out.append((int(min(ids[a], ids[b])), int(max(ids[a], ids[b]))))
    return out


def _links(shared: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) of rows that connect the members (band, row: struct of row_id, size, sig) of shared bands as all their links do.

    First each member meets its band's first one: a number of pairs that is linear in the members. What is linked so is labelled, and in bands that hold several labels every pair of rows with different ones is
    checked, cell by cell.
    """
    first = shared.groupBy("band").agg(F.min_by("row", "row.row_id").alias("pivot"))
    near = shared.join(first, "band").filter(_may_link("row", "pivot", threshold))
    star = checkpointed(_checked(near.select(F.col("pivot.row_id").alias("a"), F.col("row.row_id").alias("b")).distinct(), sets, threshold))
    hooked = star.groupBy(F.col("b").alias("row_id")).agg(F.min("a").alias("label"))
    above = hooked.select(F.col("row_id").alias("label"), F.col("label").alias("up"))
    labels = hooked.join(above, "label", "left").select("row_id", F.coalesce("up", "label").alias("label"))
    cells = checkpointed(_cells(shared, labels))
    chunks = max(1, -(-cells.count() // (2 * PIECE)))

    def check(b: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int]] = []
        for _, cell in b.groupby(["band", "i", "j"], sort=False):
            # a row that stands twice in a cell gives the same links twice
            found += _cell_links(cell["row_id"].to_numpy(), cell["label"].to_numpy(), [np.asarray(x, np.int64) for x in cell["elements"]], threshold)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    dealt = cells.withColumn("chunk", F.pmod(F.xxhash64("band", "i", "j"), F.lit(chunks))).join(sets, "row_id")
    return star.unionByName(dealt.groupBy("chunk").applyInPandas(check, "a long, b long"))


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, by: str = "set") -> DataFrame:
    """row_id, doc_id, row_key, class_id (a row_id) and set_id (the row_id of the same set that stands for it) of every row of docs."""
    rows = checkpointed(signatures(docs, by))
    worded = rows.filter("size > 0")
    same = checkpointed(worded.groupBy("set1", "set2").agg(F.min("row_id").alias("set_id"), F.count("*").alias("n")))
    member = with_group(worded.select("row_id", "doc_id", "row_key", "set1", "set2"), same, ["set1", "set2"], "n").select("row_id", "doc_id", "row_key", "set_id")
    member = checkpointed(member.unionByName(rows.filter("size = 0").select("row_id", "doc_id", "row_key", F.col("row_id").alias("set_id"))))
    one = worded.join(member.filter("row_id = set_id").select("row_id"), "row_id", "left_semi")

    bands = one.select("row_id", F.explode("bands").alias("band"))
    several = bands.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band")
    met = bands.join(several, "band").join(one.select("row_id", F.struct("row_id", "size", "sig").alias("row")), "row_id")
    shared = checkpointed(met.select("band", "row"))
    named = member.join(shared.select("row.row_id").distinct(), "row_id", "left_semi")
    classes = components(_links(shared, _sets(docs, named, by), threshold)).select(F.col("node").alias("set_id"), F.col("label").alias("class_id"))
    return member.join(classes, "set_id", "left").select("row_id", "doc_id", "row_key", F.coalesce("class_id", "set_id").alias("class_id"), "set_id")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, by: str = "set") -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), class_size and kept (one row of each class), for every row of docs."""
    rows = checkpointed(near_classes(docs, threshold, by))
    groups = checkpointed(rows.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")).alias("keep"), F.count("*").alias("class_size")))
    return with_group(rows, groups, ["class_id"], "class_size").select(
        "doc_id", F.col("keep.doc_id").alias("class_id"), "class_size", (F.col("row_id") == F.col("keep.row_id")).alias("kept"), "row_key",
    )


def drop_near_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each class."""
    out = checkpointed(near_duplicates(docs, threshold))
    repeated = bool(out.groupBy("doc_id", "row_key").count().filter("count > 1").limit(1).count())
    return keep_rows(docs, out.filter("kept"), repeated)
