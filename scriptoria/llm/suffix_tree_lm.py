"""Language-model scores by a probabilistic suffix tree over words.

Counts come from every training text. The root's distribution is the base, (c + 1) / (N + V + 1). A next word t is stored after a context s if the two occur together `least` times; so a context can only
be stored with a suffix that is, and sequences are found level by level. A context with stored next words is retained if its distribution over them, and over all others taken together, diverges from that of its
longest retained suffix: 2 n KL must exceed what chance gives (a chi-square of as many degrees as stored next words, by four standard deviations). Contexts of one and two words are all tested, a longer one if
the one shorter by its first word is retained; levels are added until one retains none, up to the order of the tree, `order` words, if it is given. At a retained context s, which stands before n words, m of them stored ones, d distinct, the next word t has
P(t | s) = (c(s, t) + (d + n - m) P(t | suffix of s)) / (n + d), where c is 0 if t isn't stored: what the context doesn't store goes to its suffix, so each distribution sums to 1. A text is scored by the
longest retained suffix at each word.

The tree is a table that grows with the texts: (context, next) pairs are counted by groupBy, whatever their share of the corpus, under 64-bit keys hashed from the words. log P(t | s) is a sum: the
base, the escape log (d + n - m) / (n + d) of each retained suffix, and for each (suffix, next) that is stored what it adds to the escape. So a text's score is a sum over keys, met by one cogroup by ranges of keys.
The `HEAD` most frequent words and the `HOT` most frequent keys are broadcast and looked up in the task; of the others only those that may be in the table, by a filter of at most
2^28 bits without false negatives, are sent on, packed by range and block of texts, and their sums come back by block. Neither changes a score. A first pass over the texts finds which pairs may occur often enough, at four bytes a pair; words are counted beside it, those pairs in a second, contexts of two
words in a third; longer ones in runs of words whose every three are stored, written in a fourth.

Defined results: a null text counts as empty: it is the end token alone. Without training texts N and V are 0. Rows that repeat count, and are scored, each; equal texts get
equal scores. A text of any length is read whole. Only doc_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Filter, checkpointed, fold_of, texts

#: What `least` and `order` are by default: occurrences that a stored next word has after its context, at least (the usual least count of a cell for a chi-square), and words of the longest context, None for as many as are
#: retained.
LEAST, ORDER = 5, 5
#: Words and entries that are broadcast and looked up in the task, at most; all others are met by a join. This changes where the work is done only.
HEAD, HOT = 1 << 18, 1 << 20
#: Words that a task counts at a time, about.
BLOCK = 2_000_000
#: Numbers of a block that are mixed, or sent on, at a time: what a task holds beside its block is some of these.
SLICE = 1 << 17
END = -(1 << 63)  # no word has this number
ALL, STOP = END + 1, END + 2  # any next word; the end of a run
NEW = (1 << 32) - 1  # in packs: a word beyond the most frequent ones
#: Packs of counts, and the numbers that they hold.
_PACK = "bucket int, contexts binary, n binary, words binary, c binary, others binary"
_KINDS = {"contexts": "<i8", "n": "<u4", "words": "<u4", "c": "<u4", "others": "<i8", "shorter": "<i8"}
_SPACE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
_PLACES = 512
_RANDOM = np.random.default_rng(0x5EED).integers(0, 1 << 64, _PLACES * 256, np.uint64)
#: What turns a context by the first three bits of the next word.
_TURNS = np.random.default_rng(0x7EED).integers(0, 1 << 64, 8, np.uint64)


def _stirred(x: np.ndarray) -> np.ndarray:
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two numbers, in order."""
    return _stirred(a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.view(np.uint64)).view(np.int64)


def tokens_of(batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the words of texts, starts of texts, and the text of each token. Each text ends with the end token.

    Words are lower-cased in A-Z and split at the six white-space characters of ASCII. A word's number is hashed from its bytes: a random number for each byte at its place, summed.
    """
    data = [t.encode("utf-8", "surrogatepass") for t in batch]
    size = np.fromiter(map(len, data), np.int64, len(data)) + 1
    raw = np.frombuffer(b"\n".join([*data, b""]), np.uint8)
    inside = ~_SPACE[raw]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, length = edges[::2], edges[1::2] - edges[::2]
    held = _LOWER[raw[inside]]
    begin = length.cumsum() - length
    word = np.zeros(len(starts), np.uint64)
    # whole words of some bytes together at a time
    cuts = np.unique(np.searchsorted(begin, np.arange(0, len(held), SLICE)))
    for a, b in pairwise([*cuts[cuts < len(starts)].tolist(), len(starts)]):
        own = begin[a:b] - begin[a]
        place = np.arange(own[-1] + length[b - 1]) - np.repeat(own, length[a:b])
        value = _RANDOM[((place % _PLACES) << 8) | held[begin[a] : begin[a] + len(place)]]
        far = np.flatnonzero(place >= _PLACES)
        value[far] = _stirred(value[far] + (place[far] // _PLACES).astype(np.uint64))
        word[a:b] = np.add.reduceat(value, own)
    word = np.maximum(_stirred(word).view(np.int64), STOP + 1)
    ends = size.cumsum()
    words = np.searchsorted(starts, ends) - np.searchsorted(starts, ends - size)  # of each text
    n = words + 1
    last = n.cumsum() - 1
    number = np.full(int(n.sum()), END, np.int64)
    inner = np.ones(len(number), bool)
    inner[last] = False
    number[inner] = word
    new = np.zeros(len(number), bool)
    new[last + 1 - n] = True
    return number, new, np.repeat(np.arange(len(batch)), n)


def _joined(found: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    """The columns of what was found, each in one piece; found is empty then, so that a task holds them once."""
    columns = [list(x) for x in zip(*found, strict=True)]
    found.clear()
    return [np.concatenate(columns.pop(0)) for _ in range(len(columns))]


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers with all first bytes, then all second ones and so on, packed: bytes that hardly change, or of which few values occur, take little."""
    raw = numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True) if raw else b""


def _from_planes(raw: bytes, kind: str) -> np.ndarray:
    if not raw:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.Codec("zstd").decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _rising(keys: np.ndarray) -> bytes:
    """Keys that rise, or nearly do, as the steps between them."""
    return _planes(np.diff(keys.view(np.uint64), prepend=np.uint64(0)))


def _from_rising(raw: bytes) -> np.ndarray:
    return _from_planes(raw, "<u8").cumsum(dtype=np.uint64).view(np.int64)


def _dealt(size: int, least: int, each: int) -> int:
    """Bits of a bucket's number for so many bytes of text, about 2 ** each a bucket, of which there are 2 ** least at least."""
    return max(least, min(22, (size >> each).bit_length()))


def _sent(bucket: np.ndarray, columns: dict[str, list[bytes]], size: np.ndarray) -> Iterator[pd.DataFrame]:
    """The packs of buckets, some at a time: neither the task nor Spark holds another copy of a block."""
    cut = np.flatnonzero(np.diff(size.cumsum() // SLICE)) + 1
    for a, b in pairwise([0, *cut.tolist(), len(bucket)]):
        if a < b:
            yield pd.DataFrame({"bucket": bucket[a:b].astype(np.int32), **{name: x[a:b] for name, x in columns.items()}})


def _codes(numbers: np.ndarray, known: Table) -> tuple[np.ndarray, np.ndarray]:
    """The places of words among the known ones, others as `NEW`; and which these others are."""
    place = known.places(numbers)
    return np.where(place < 0, NEW, place).astype("<u4"), place < 0


def _packs(columns: dict[str, np.ndarray], known: Table, bits: int) -> Iterator[pd.DataFrame]:
    """Rows of context and word, with c summed for each context and word, as packs for buckets; without c, rows are counted. columns is empty then.

    A row is dealt by its context and the first three bits of its word, so a context that is everywhere lands in eight buckets. A pack holds each context once, with what else is the context's own (`shorter`), how many words it has there,
    and their places among the known words: some seven bytes a row, where a row of its own takes 14 to 20.
    """
    word = columns.pop("word")
    turned = columns.pop("context").view(np.uint64) ^ _TURNS[word.view(np.uint64) >> np.uint64(61)]
    # of one context words go by their last bits: equal rows are together, but for chance, and are summed anew in the bucket
    last = np.uint64((1 << 20) - 1)
    order = np.argsort((turned & ~last) | (word.view(np.uint64) & last))
    turned, word = turned[order], word[order]
    rest = {name: columns.pop(name)[order] for name in list(columns)}
    del order
    if not len(word):
        return
    first = np.concatenate([[True], turned[1:] != turned[:-1]])  # of a context
    new = first.copy()
    new[1:] |= word[1:] != word[:-1]
    at = np.flatnonzero(new)
    c = np.diff(np.append(at, len(word))) if "c" not in rest else np.add.reduceat(rest["c"], at)
    turned, word, first, shorter = turned[at], word[at], first[at], rest["shorter"][at] if "shorter" in rest else None
    del rest, new, at
    code, far = _codes(word, known)
    top = np.flatnonzero(first)
    n = np.diff(np.append(top, len(word)))
    held = turned[top]
    edges = np.arange(1, 1 << bits).astype(np.uint64) << np.uint64(64 - bits)
    by_row, by_context = np.searchsorted(turned >> np.uint64(20), edges >> np.uint64(20)), np.searchsorted(held >> np.uint64(20), edges >> np.uint64(20))
    parts = {"contexts": np.split(held.view(np.int64), by_context), "n": np.split(n.astype("<u4"), by_context), "words": np.split(code, by_row), "c": np.split(c.astype("<u4"), by_row)}
    parts["others"] = np.split(word[far], np.append(0, far.cumsum())[by_row])
    if shorter is not None:
        parts["shorter"] = np.split(shorter[top], by_context)
    size = np.fromiter(map(len, parts["words"]), np.int64, 1 << bits)
    some = np.flatnonzero(size)
    yield from _sent(some, {name: [(_rising if name == "contexts" else _planes)(x[k]) for k in some] for name, x in parts.items()}, size[some])


def _grouped(packs: DataFrame, known: Broadcast, least: int) -> DataFrame:
    """context, word and c summed over what tasks have counted, from `least` on; and shorter, if packs hold it. Packs of a bucket are summed together; a bucket holds what a bounded share of the texts has."""
    names = ["context", "word", *["shorter"] * ("shorter" in packs.columns), "c"]

    def summed(b: pd.DataFrame) -> pd.DataFrame:
        column = {name: np.concatenate([_from_rising(x) if name == "contexts" else _from_planes(x, kind) for x in b[name]]) for name, kind in _KINDS.items() if name in b}
        word = np.append(known.value.keys, 0)[np.minimum(column["words"], len(known.value.keys))]
        word[column["words"] == NEW] = column["others"]
        turned = np.repeat(column["contexts"].view(np.uint64), column["n"])
        context = (turned ^ _TURNS[word.view(np.uint64) >> np.uint64(61)]).view(np.int64)
        key = _entry(context, word)
        order = np.argsort(key)
        key = key[order]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        c = np.add.reduceat(column["c"][order].astype(np.int64), at)
        kept = c >= least
        at, c = order[at[kept]], c[kept]
        out = {"context": context[at], "word": word[at], "c": c}
        if "shorter" in column:
            out["shorter"] = np.repeat(column["shorter"], column["n"])[at]
        return pd.DataFrame({name: out[name] for name in names})

    return packs.groupBy("bucket").applyInPandas(summed, ", ".join(f"{name} long" for name in names))


def _words(docs: DataFrame, size: int, least: int) -> tuple[DataFrame, Filter | None]:
    """(word, c) of all words; and the pairs of words that occur `least` times, and few others; None: all, if one time is enough.

    A pair is the first 32 bits of its key beyond those of its bucket, in each task once for some million words, with its count. What can't be frequent is thus found at some four bytes a pair, and never sent on as a row.
    """
    bits, of_words = _dealt(size, 10, 25), _dealt(size, 6, 25)

    def packed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number, new in _blocks(batches):
            key, n = np.unique(number.view(np.uint64), return_counts=True)
            cut = np.searchsorted(key, np.arange(1, 1 << of_words).astype(np.uint64) << np.uint64(64 - of_words))
            key, n = np.split(key, cut), np.split(n.astype("<u4"), cut)
            some = [k for k, x in enumerate(key) if len(x)]
            yield pd.DataFrame({"bucket": [k + (1 << bits) for k in some], "low": [_rising(key[k]) for k in some], "n": [_planes(n[k]) for k in some]}).astype({"bucket": "int32"})
            if least <= 1:
                continue
            key = np.concatenate([_entry(number[at - 1], number[at]).view(np.uint64) >> np.uint64(32 - bits) for at in _seconds(new)])
            del number, new
            key.sort()
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            n = np.minimum(np.diff(np.append(at, len(key))), 255).astype(np.uint8)
            key = key[at]
            cut = np.searchsorted(key, np.arange(1, 1 << bits).astype(np.uint64) << np.uint64(32))
            low, n = np.split((key & np.uint64(0xFFFFFFFF)).astype("<u4"), cut), np.split(n, cut)
            some = [k for k, x in enumerate(low) if len(x)]
            yield pd.DataFrame({"bucket": some, "low": [low[k].tobytes() for k in some], "n": [n[k].tobytes() for k in some]}).astype({"bucket": "int32"})

    def summed(b: pd.DataFrame) -> pd.DataFrame:
        is_words = b["bucket"].iloc[0] >= 1 << bits
        if is_words:
            low, n = np.concatenate([_from_rising(x) for x in b["low"]]), np.concatenate([_from_planes(x, "<u4") for x in b["n"]])
        else:
            low, n = np.frombuffer(b"".join(b["low"]), "<u4"), np.frombuffer(b"".join(b["n"]), np.uint8)
        order = np.argsort(low)
        low, n = low[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        n = np.add.reduceat(n, first)
        if is_words:
            return pd.DataFrame({"key": low[first], "c": n})
        kept = low[first][n >= least]
        key = (np.uint64(b["bucket"].iloc[0]) << np.uint64(64 - bits)) | (kept.astype(np.uint64) << np.uint64(32 - bits))
        return pd.DataFrame({"key": key.view(np.int64), "c": 0})

    found = checkpointed(docs.select("text").mapInPandas(packed, "bucket int, low binary, n binary").groupBy("bucket").applyInPandas(summed, "key long, c long"))
    _let_go(docs.sparkSession)
    often = None if least <= 1 else Filter(found.filter("c = 0").select("key"))
    return checkpointed(found.filter("c > 0").select(F.col("key").alias("word"), "c")), often


def _blocks(batches: Iterable[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the words of texts and whether they start a text, some million words at a time."""
    found, size = [], 0
    for b in batches:
        for part in _parts(b):
            number, new, _ = tokens_of(part["text"].tolist())
            found.append((number, new))
            size += len(number)
            del number, new
            if size > BLOCK:
                yield _joined(found)
                size = 0
    if found:
        yield _joined(found)


def _seconds(new: np.ndarray) -> Iterator[np.ndarray]:
    """The tokens that have one before them in their text, some at a time."""
    for k in range(0, len(new), SLICE):
        yield np.flatnonzero(~new[k : k + SLICE]) + k


def _counted(docs: DataFrame, often: Filter | None, known: Broadcast, bits: int, least: int) -> DataFrame:
    """(context, word, c) of the pairs of words that occur `least` times."""
    sent = docs.sparkSession.sparkContext.broadcast(often)

    def count_rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often = sent.value
        for number, new in _blocks(batches):
            at = np.concatenate([x if often is None else x[often.has(_entry(number[x - 1], number[x]))] for x in _seconds(new)])
            pairs = {"context": number[at - 1], "word": number[at]}
            del number, new, at
            yield from _packs(pairs, known.value, bits)

    return checkpointed(_grouped(docs.select("text").mapInPandas(count_rows, _PACK), known, least))


class Table:
    """Places of numbers among known ones, by open addressing: all numbers step on from their slots together until they are found or a slot is empty."""

    def __init__(self, keys: np.ndarray) -> None:
        """keys: distinct, and hashed, so that their first bits tell them apart."""
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = keys
        left, at = np.arange(len(keys)), self._first(keys)
        while len(left):
            free = self.slots[at] < 0
            # of those that meet in a slot one gets it
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) >> np.uint64(64 - self.bits)).astype(np.int64)

    def places(self, numbers: np.ndarray) -> np.ndarray:
        """-1: not a known number."""
        if not len(self.keys):
            return np.full(len(numbers), -1, np.int64)
        at = self._first(numbers)
        out = self.slots[at].astype(np.int64)
        open_ = np.flatnonzero((out >= 0) & (self.keys[out] != numbers))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.slots[at[open_]].astype(np.int64)
            out[open_] = found
            open_ = open_[(found >= 0) & (self.keys[found] != numbers[open_])]
        return out


class Head:
    """The most frequent words, by number, and the logarithm of each one's base probability."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, distinct: int) -> None:
        self.table, self.total = Table(words), total
        self.base = np.log10((counts + 1.0) / (total + distinct + 1.0))

    def places(self, numbers: np.ndarray) -> np.ndarray:
        """Where the numbers stand in the head; -1: nowhere."""
        return self.table.places(numbers)


def _parts(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for _, part in b.groupby((b["text"].str.len().cumsum() // 1_000_000).to_numpy(), sort=False):
        yield part


def _contexts(number: np.ndarray, starts: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length up to depth: the tokens that have so many words before them, and the keys of these contexts; a suffix's key comes before that of the longer context."""
    first = np.maximum.accumulate(np.where(starts, np.arange(len(number)), 0))
    at = np.arange(len(number))
    node = number
    for k in range(1, depth + 1):
        far = at - k >= first[at]
        at, node = at[far], node[far]
        node = number[at - 1] if k == 1 else _mixed(node, number[at - k])
        yield at, node


def _entry(node: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys of (context, next)."""
    return _mixed(~node, word)


def _count_level(source: DataFrame, depth: int, attested: Filter, kept: Filter | None, known: Broadcast, bits: int, least: int) -> DataFrame:
    """context, word and c of every (context, next) that occurs `least` times, with contexts of `depth` words; and, from four words on, shorter (the context's suffix) and how often each context occurs, as the word `ALL`.

    source: texts, or runs of words in which all longer sequences that matter stand. attested: keys of the sequences of `depth` words that are entries of the level before. Of a sequence that
    occurs `least` times, the context and all but its first word do too. kept: suffixes whose longer contexts are wanted; None: any.
    """
    sent = source.sparkSession.sparkContext.broadcast((attested, kept))
    runs, far = "run" in source.columns, depth > 3

    def pair_rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (attested, kept), found, size = sent.value, [], 0
        names = ("context", "word", "shorter", "c") if far else ("context", "word")

        def out() -> Iterator[pd.DataFrame]:
            yield from _packs(dict(zip(names, _joined(found), strict=True)), known.value, bits)

        for b in batches:
            for number, new in _run_tokens(b) if runs else (tokens_of(part["text"].tolist())[:2] for part in _parts(b)):
                own = shorter = np.zeros(len(number), np.int64)
                for at, node in _contexts(number, new, depth):
                    own, shorter = np.zeros(len(number), np.int64), own
                    own[at] = node
                # a sequence of `depth` words is an entry of the level before
                often = attested.has(_entry(shorter, number))
                at = at[number[at - 1] != END]
                if depth <= 3:  # up to there entries of all contexts are at hand
                    at = at[often[at - 1]]
                if kept is not None:
                    at = at[kept.has(shorter[at])]
                if far:
                    by = at[np.argsort(own[at])]
                    context = own[by]
                    first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(by) else by
                    found.append((context[first], np.full(len(first), ALL), shorter[by[first]], np.diff(np.append(first, len(by)))))
                at = at[often[at] & (number[at] != STOP)]
                found.append((own[at], number[at], shorter[at], np.ones(len(at), np.int64))[: len(names)])
                size += len(at)
                if size > BLOCK:
                    yield from out()
                    size = 0
        if found:
            yield from out()

    return checkpointed(_grouped(source.mapInPandas(pair_rows, _PACK + ", shorter binary" * far), known, least))


def _run_tokens(b: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the words of runs, and starts of runs."""
    for k in range(0, len(b), 1024):
        held = [np.asarray(x, np.int64) for x in b["run"].iloc[k : k + 1024]]
        number = np.concatenate(held)
        new = np.zeros(len(number), bool)
        new[0] = True
        new[1:] = number[:-1] == STOP
        yield number, new


def _runs(docs: DataFrame, attested: Filter) -> DataFrame:
    """run: of each text the runs of words whose every three words are in attested, each followed by STOP. All longer sequences that occur as often as entries must stand in them."""
    sent = docs.sparkSession.sparkContext.broadcast(attested)

    def run_rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in _parts(b):
                number, new, text = tokens_of(part["text"].tolist())
                node = np.zeros(len(number), np.int64)
                for at, found in _contexts(number, new, 2):
                    far, pair = at, found
                node[far] = pair
                third = np.zeros(len(number) + 1, bool)  # whether a word ends three attested ones
                third[far] = sent.value.has(_entry(pair, number[far]))
                third[-1] = False
                held = third[:-1].copy()  # words of any such three
                held[:-1] |= third[1:-1]
                held[:-2] |= third[2:-1]
                # a run breaks where a word that is held doesn't end such three, but for the first two of a run
                ends = np.flatnonzero(held & ~third[1:] & third[:-1])
                firsts = np.flatnonzero(third[:-1] & ~np.concatenate([[False], third[:-2]])) - 2
                size = ends - firsts + 1
                if not len(size):
                    continue
                before = (size + 1).cumsum() - (size + 1)
                where = np.arange(int((size + 1).sum())) - np.repeat(before, size + 1)
                stop = where == np.repeat(size, size + 1)
                run = np.where(stop, STOP, number[np.minimum(np.repeat(firsts, size + 1) + where, len(number) - 1)])
                of = np.repeat(text[firsts], size + 1)
                cut = np.flatnonzero(np.diff(of)) + 1
                yield pd.DataFrame({"run": np.split(run, cut)})

    return checkpointed(docs.select("text").mapInPandas(run_rows, "run array<long>"))


def _keyed(rows: DataFrame, depth: int) -> DataFrame:
    """Entries with their key and that of the same next word after the suffix, and of contexts of up to two words those of the context of the two together (`both`) and its suffix (`tail`)."""

    def keys(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            context, shorter, word = (b[x].to_numpy(np.int64) for x in ("context", "shorter", "word"))
            more = {}
            if depth == 2:
                more["tail"] = _mixed(word, shorter)
                more["both"] = _mixed(more["tail"], b["first"].to_numpy(np.int64))
            yield pd.DataFrame({"key": _entry(context, word), "context": context, "suffix_key": _entry(shorter, word), "c": b["c"].to_numpy(), **more})

    return rows.mapInPandas(keys, "key long, context long, suffix_key long, c long" + ", tail long, both long" * (depth == 2))


def _keyed_pairs(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same for weighed pairs of words, whose suffixes' keys are the words themselves."""
    for b in batches:
        context, word = b["context"].to_numpy(np.int64), b["suffix_key"].to_numpy(np.int64)
        yield b.drop(columns="suffix_key").assign(key=_entry(context, word), tail=word, both=_mixed(word, context))


def _weighed(entries: DataFrame, totals: DataFrame, before: DataFrame) -> DataFrame:
    """Entries with n of the context, its escape, p (of the longest retained suffix, the context among them), and what the entry adds to the escape, null where the context isn't kept.

    entries: context, suffix_key, c, and what else is to be kept; totals: context and n; before: key and p of the suffixes' entries.
    """
    met = entries.join(before.select(F.col("key").alias("suffix_key"), F.col("p").alias("q")), "suffix_key")
    c, n, m, d = (F.col(x) for x in "cnmd")
    of = met.groupBy("context").agg(F.sum("c").alias("m"), F.count("*").alias("d"), F.sum(c * F.log(c / F.col("q"))).alias("g"), F.sum("q").alias("known")).join(totals, "context")
    rest = F.when(n > m, (n - m) * (F.log((n - m) / n) - F.log(F.greatest(1 - F.col("known"), F.lit(1e-12))))).otherwise(F.lit(0.0))
    of = of.select("context", "n", ((d + n - m) / (n + d)).alias("escape"), (n + d).alias("of"), (2 * (F.col("g") - m * F.log(n) + rest) > d + 4 * F.sqrt(2 * d)).alias("kept"))
    share = c / F.col("of") + F.col("escape") * F.col("q")
    adds = F.log10(share) - F.log10("escape") - F.log10("q")
    more = [x for x in entries.columns if x != "suffix_key" or "key" not in entries.columns]
    out = met.join(of, "context").select(*more, "n", "escape", F.when(F.col("kept"), share).otherwise(F.col("q")).alias("p"), F.when(F.col("kept"), adds).alias("adds"))
    if "key" not in out.columns:
        out = out.mapInPandas(_keyed_pairs, "key long, context long, tail long, both long, c long, n long, escape double, p double, adds double")
    return checkpointed(out)


def _let_go(spark: SparkSession) -> None:
    """Have the driver collect its garbage: the shuffle files and checkpoints that nothing refers to go when it does, which may else be long after the disks are full.

    Python's own garbage is first: it holds tables in cycles, and tells the JVM about what it lets go from a thread of its own, within a second.
    """
    gc.collect()
    time.sleep(1.5)
    spark.sparkContext._jvm.System.gc()


def train(docs: DataFrame, words: DataFrame, pairs: DataFrame, known: Broadcast, bits: int, total: int, distinct: int, least: int = LEAST, order: int | None = ORDER) -> tuple[DataFrame, int]:
    """The tree's values (key, v and how often it was counted) and its depth, of the texts of docs, whose words are counted in words (word, c) and their pairs in pairs (context, word, c)."""
    words = words.select(F.col("word").alias("key"), F.col("c").alias("n"), ((F.col("c") + 1.0) / F.lit(total + distinct + 1.0)).alias("p"))
    level = _weighed(pairs.withColumnRenamed("word", "suffix_key"), words.select(F.col("key").alias("context"), "n"), words)
    values, depth, source, over = [], 1, docs.select("text"), None
    while True:
        kept = level.filter("adds is not null")
        values.append(kept.select("key", F.col("adds").alias("v"), "c"))
        values.append(kept.groupBy("context").agg(F.first("n").alias("c"), F.first("escape").alias("e")).select(F.bitwise_not("context").alias("key"), F.log10("e").alias("v"), "c"))
        if depth == order or depth > 1 and not kept.limit(1).count():
            return reduce(DataFrame.unionByName, values), depth
        attested = Filter(level.select("key"))
        _let_go(docs.sparkSession)
        if depth == 2:
            source = _runs(docs, attested)
        if depth > 1:  # a filter may let others through; the join with the entries before doesn't
            over = Filter(checkpointed(kept.select(F.col("context").alias("key")).distinct()))
        depth += 1
        rows = _count_level(source, depth, attested, over, known, bits, least)
        _let_go(docs.sparkSession)
        if depth <= 3:  # a context of two or three words is an entry of the level before, with its next word
            totals = level.select(F.col("both").alias("context"), F.col("c").alias("n"))
            rows = rows.join(level.select(F.col("both").alias("context"), F.col("tail").alias("shorter"), *[F.col("context").alias("first")] * (depth == 2)), "context")
        else:
            totals = rows.filter(F.col("word") == ALL).select("context", F.col("c").alias("n"))
            rows = rows.filter(F.col("word") != ALL)
        level = _weighed(_keyed(rows, depth), totals, kept if depth > 2 else level)


def _most_counted(rows: DataFrame, c: str, most: int) -> tuple[DataFrame, DataFrame]:
    """The rows with the largest counts, about `most` at most, and the others: a bound on the count is taken from the numbers of rows by powers of 2 ** 0.125."""
    step = F.floor(8 * F.log2(c)).cast("int")
    held, bound = 0, 1 << 30
    for r in rows.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # 8 * 63 rows at most
        held += r["count"]
        if held > most:
            break
        bound = r["step"]
    return rows.filter(step >= bound), rows.filter(step < bound)


def _arrays(rows: DataFrame, key: str, value: str) -> tuple[np.ndarray, np.ndarray]:
    """Two columns of a bounded number of rows, sorted by the first."""
    got = rows.select(F.col(key).cast("long").alias("k"), F.col(value).cast("double").alias("v")).toArrow()
    keys, values = got["k"].to_numpy(), got["v"].to_numpy()
    order = np.argsort(keys)
    return keys[order], values[order]


def _looked_up(asked: DataFrame, table: DataFrame, bits: int) -> DataFrame:
    """Sums of base and path, and the number of known words, for every text of asked.

    asked: rows of texts (keys is null), and packs of keys with the places of their texts in a block of texts, dealt to buckets by the first `bits` bits of the keys. table: key, word (whether it is a word) and x, which are packed too.
    What a bucket finds is summed by text and goes back to the block.
    """
    texts_of = ["block", "row_id", "doc_id", "has_id", "n_tokens", "known", "base", "path"]
    blank = {"row_id": 0, "doc_id": 0, "has_id": False, "n_tokens": 0, "known": 0, "base": 0.0, "path": 0.0}

    def meet(asked: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        whole = asked["keys"].isna()
        out = [asked.loc[whole, texts_of].assign(word=False, places=None, sums=None, counts=None)]
        for word in (True, False):
            own = table[table["word"] == word]
            known = np.concatenate([np.zeros(0, np.int64), *map(_from_rising, own["keys"])])
            order = np.argsort(known)
            known, x = known[order], np.concatenate([np.zeros(0), *(_from_planes(v, "<f8") for v in own["x"])])[order]
            packs = asked[~whole & (asked["word"] == word)] if len(known) else asked.iloc[:0]
            found = []
            for block, keys, places in zip(packs["block"], packs["keys"], packs["places"], strict=True):
                keys, places = _from_rising(keys), _from_planes(places, "<u4")
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at] == keys
                n = np.bincount(places[hit])
                at, total = np.flatnonzero(n), np.bincount(places[hit], x[at[hit]])
                found.append({"block": block, **blank, "word": word, "places": _planes(np.diff(at, prepend=0).astype("<u4")), "sums": _planes(total[at]), "counts": _planes(n[at].astype("<u4")) if word else None})
            out.append(pd.DataFrame(found, columns=out[0].columns))
        out = [x for x in out if len(x)]
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in [*texts_of, "word", "places", "sums", "counts"]})

    def together(b: pd.DataFrame) -> pd.DataFrame:
        whole = b["places"].isna()
        own = b.loc[whole, texts_of[1:]].reset_index(drop=True)
        at = own["row_id"].to_numpy() - b["block"].iloc[0]
        known, base, path = (np.zeros(at.max() + 1) for _ in range(3))
        packs = b[~whole]
        for word, places, sums, counts in zip(packs["word"], packs["places"], packs["sums"], packs["counts"], strict=True):
            places = _from_planes(places, "<u4").cumsum()
            (base if word else path)[places] += _from_planes(sums, "<f8")
            if word:
                known[places] += _from_planes(counts, "<u4")
        return own.assign(known=own["known"] + known[at].astype(np.int64), base=own["base"] + base[at], path=own["path"] + path[at])

    def table_packs(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[tuple[np.ndarray, ...]] = []

        def out() -> pd.DataFrame:
            key, x, word = _joined(found)
            order = np.argsort(key.view(np.uint64))
            key, x, word = key[order], x[order], word[order]
            packs = []
            for is_word in (True, False):
                own, values = key[word == is_word], x[word == is_word]
                bucket = (own.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
                first = np.flatnonzero(np.diff(bucket, prepend=-1))
                packs += [(int(bucket[a]), is_word, _rising(own[a:b]), _planes(values[a:b])) for a, b in pairwise([*first.tolist(), len(own)])]
            return pd.DataFrame(packs, columns=["bucket", "word", "keys", "x"])

        for b in batches:
            found.append((b["key"].to_numpy(np.int64), b["x"].to_numpy(np.float64), b["word"].to_numpy(bool)))
            if sum(len(x) for x, *_ in found) > 4 * SLICE:
                yield out()
        if found:
            yield out()

    texts_schema = "row_id long, doc_id long, has_id boolean, n_tokens long, known long, base double, path double"
    # a union has the partitions of all its parts, which make as many small packs
    few = table.coalesce(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bucketed = few.mapInPandas(table_packs, "bucket int, word boolean, keys binary, x binary")
    met = asked.groupBy("bucket").cogroup(bucketed.groupBy("bucket")).applyInPandas(meet, f"block long, {texts_schema}, word boolean, places binary, sums binary, counts binary")
    return met.groupBy("block").applyInPandas(together, texts_schema)


def score_documents(docs: DataFrame, folds: int = 7, held_out: int = 2, least: int = LEAST, order: int | None = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of docs.

    With least = 1 every sequence is counted, and with order = None contexts grow until none is retained: the divergence test alone then decides, at the cost of a table of every pair and of a job for each length.
    """
    fold = fold_of(F.col("doc_id"), folds)
    learned = texts(docs).filter(fold != held_out)
    size = learned.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counted, frequent = _words(learned, size, least)
    _let_go(docs.sparkSession)
    words = counted.select("word", F.col("c").alias("n"))
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    often, rare = _most_counted(words, "n", HEAD)
    heads, n = _arrays(often, "word", "n")
    by = np.argsort(-n, kind="stable")  # packs write places: small ones are the frequent ones
    front = Head(heads[by], n[by], total, distinct)
    numbered, buckets = docs.sparkSession.sparkContext.broadcast(front.table), _dealt(size, 7, 23)
    pairs = _counted(learned, frequent, numbered, buckets, least)
    _let_go(docs.sparkSession)
    values, depth = train(learned, counted, pairs, numbered, buckets, total, distinct, least, order)
    values = checkpointed(values)
    del pairs
    _let_go(docs.sparkSession)
    hot, cold = _most_counted(values, "c", HOT)
    hot_keys, hot_values = _arrays(hot, "key", "v")
    sent = docs.sparkSession.sparkContext.broadcast((front, Table(hot_keys), hot_values, Filter(values.select("key"))))
    _let_go(docs.sparkSession)
    none = -np.log10(total + distinct + 1.0)  # of a word that isn't known
    bits = max(4, min(22, (total >> 22).bit_length()))  # about four million words a bucket

    def score_rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        front, hot, worth, held = sent.value
        block, rows, size = -1, 0, 0
        asked: dict[bool, list[tuple[np.ndarray, np.ndarray]]] = {True: [], False: []}  # keys and the places of their texts in the block: of words, and of the tree

        def known(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Places of the keys that may be in the table, the values of those that are hot, and which of the places hold others."""
            at = np.flatnonzero(held.has(keys))
            near = hot.places(keys[at])
            is_hot = near >= 0
            v = np.zeros(len(at))
            v[is_hot] = worth[near[is_hot]]
            return at, v, ~is_hot

        # most contexts of one word are words of the head: these are looked up once. 0: not in the table, 1: hot, 2: may be in it, 3: of words beyond the head, -1
        state, of_head = np.zeros(len(front.table.keys) + 1, np.int8), np.zeros(len(front.table.keys) + 1)
        i, v, ask = known(~front.table.keys)
        state[i], of_head[i], state[-1] = 1 + ask, v, 3

        def known_words(place: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """The same for words as contexts, by their places in the head."""
            found, v = state[place], of_head[place]
            far = np.flatnonzero(found == 3)
            i, worth_far, ask = known(~word[far])
            found[far] = 0
            found[far[i]], v[far[i]] = 1 + ask, worth_far
            at = np.flatnonzero(found)
            return at, v[at], found[at] == 2

        def packs() -> Iterator[pd.DataFrame]:
            for word, parts in asked.items():
                if not parts:
                    continue
                keys, places = _joined(parts)
                order = np.argsort(keys.view(np.uint64))
                keys, places = keys[order], places[order]
                del order
                ends = np.searchsorted(keys.view(np.uint64), np.arange(1, 1 << bits).astype(np.uint64) << np.uint64(64 - bits))
                keys, places = np.split(keys, ends), np.split(places, ends)
                some, held_back = [], 0
                for k, x in enumerate(keys):
                    some += [k] * (len(x) > 0)
                    held_back += len(x)
                    if some and (held_back >= SLICE or k == len(keys) - 1):
                        yield pd.DataFrame({
                            "bucket": some, "block": block, "row_id": 0, "doc_id": 0, "has_id": False, "n_tokens": 0, "known": 0, "base": 0.0, "path": 0.0, "word": word,
                            "keys": [_rising(keys[k]) for k in some], "places": [_planes(places[k]) for k in some],
                        }).astype({"bucket": "int32"})
                        some, held_back = [], 0

        for b in batches:
            for part in _parts(b):
                if size > BLOCK or rows > BLOCK:
                    yield from packs()
                    block, rows, size = -1, 0, 0
                number, starts, text = tokens_of(part["text"].tolist())
                row_id = part["row_id"].to_numpy()
                block = int(row_id[0]) if block < 0 else block
                at_row = (row_id - block).astype("<u4")
                place = front.places(number)
                n, head = len(part), place >= 0
                base = front.base[place[head]]
                path, open_ = np.zeros(len(number)), np.ones(len(number), bool)
                asked[True].append((number[~head], at_row[text[~head]]))
                other = []
                for k, (at, node) in enumerate(_contexts(number, starts, depth), 1):
                    if k > 2:  # a longer context is in the tree only if its suffix is
                        at, node = at[open_[at]], node[open_[at]]
                    i, v, ask = known_words(place[at - 1], node) if k == 1 else known(~node)
                    at, node = at[i], node[i]
                    open_[:] = False
                    open_[at] = True
                    path[at] += v
                    other.append((~node[ask], at_row[text[at[ask]]]))
                    keys = _entry(node, number[at])
                    i, v, ask = known(keys)
                    at, keys = at[i], keys[i]
                    path[at] += v
                    other.append((keys[ask], at_row[text[at[ask]]]))
                asked[False] += other
                rows, size = rows + n, size + len(asked[True][-1][0]) + sum(len(x) for x, _ in other)
                missing = part["doc_id"].isna().to_numpy()
                yield pd.DataFrame({
                    "bucket": (row_id % (1 << bits)).astype(np.int32), "block": block, "row_id": row_id, "doc_id": part["doc_id"].fillna(0).astype("int64").to_numpy(), "has_id": ~missing,
                    "n_tokens": np.bincount(text, minlength=n), "known": np.bincount(text[head], minlength=n),
                    "base": np.bincount(text[head], base, n) + none * np.bincount(text[~head], minlength=n), "path": np.bincount(text, path, n), "word": False, "keys": None, "places": None,
                })
        yield from packs()

    schema = "bucket int, block long, row_id long, doc_id long, has_id boolean, n_tokens long, known long, base double, path double, word boolean, keys binary, places binary"
    asked = texts(docs).withColumn("row_id", F.monotonically_increasing_id()).mapInPandas(score_rows, schema)
    beyond = F.log10((F.col("n") + 1.0) / F.lit(total + distinct + 1.0)) - F.lit(float(none))
    table = rare.select(F.col("word").alias("key"), F.lit(True).alias("word"), beyond.alias("x")).unionByName(cold.select("key", F.lit(False).alias("word"), F.col("v").alias("x")))
    scored = _looked_up(asked, table, bits).withColumn("doc_id", F.when(F.col("has_id"), F.col("doc_id")))
    return scored.select("doc_id", (fold == held_out).alias("held_out"), "n_tokens", F.col("known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), (F.col("path") + F.col("base")).alias("score"))
