"""Byte-level BPE encoding and decoding by segment trees.

The bytes of a piece (a match of the split pattern) are the leaves of a segment tree. A leaf holds the rank of the pair that
starts at its byte, and a node the leftmost minimum of its leaves, as the number rank * width + position. A merge takes
the root, links its two live neighbours and updates three leaves, each in logarithmic time. Short pieces of a batch are
merged together, a tree a row in one array; long ones are merged alone, in lists.

A piece that is a token as a whole takes that token, as in the public library. Pieces are kept in a bounded cache.
Spark deals out the documents; a task sees a batch at a time and nothing is shuffled.

Defined results: a null text counts as empty; an empty text has no ids. Rows that repeat are encoded each. Only doc_id
and text are read.
"""

from __future__ import annotations

import base64
import gc
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

#: Widest tree that is merged in arrays, most pieces merged in one array, and most cached pieces of a worker.
WIDE, ROWS, CACHED = 64, 16384, 500_000
NONE = np.int64(1) << 60


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks from the text of a rank file: a token in base64 and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


class Bpe:
    """Merges, by the given ranks, of the matches of a pattern."""

    #: Most pieces and words that are held.
    cached = CACHED
    #: Whether a space and the letters after it, if nothing else follows, are one piece.
    whole_words = False

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.whole_words = pattern.startswith(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+|")
        self.vocabulary = {i: t for t, i in ranks.items()}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    self.pairs[a << 20 | b] = rank
        self.keys = np.array(sorted(self.pairs), np.int64)
        self.values = np.array([self.pairs[k] for k in self.keys.tolist()], np.int64)
        self.cache: dict[str, bytes] = {}
        self.after_space: dict[str, bytes] = {}

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def merge_together(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids of pieces of 2 to width bytes, each a row of arrays; width is a power of two."""
        n, rows = len(pieces), np.arange(len(pieces))
        size = np.fromiter(map(len, pieces), np.int64, n)
        data = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        tok, at = self.byte[data], np.arange(width)
        alive = at < size[:, None]
        nxt, prv = np.tile(at + 1, (n, 1)), np.tile(at - 1, (n, 1))
        tree = np.full((n, 2 * width), NONE)
        first = self._ranks_of(tok[:, :-1], tok[:, 1:])
        tree[:, width : 2 * width - 1] = np.where((first < NONE) & alive[:, 1:], first * width + at[:-1], NONE)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2

        def put(row: np.ndarray, i: np.ndarray, value: np.ndarray | np.int64) -> None:
            node = i + width
            tree[row, node] = value
            while width > 1 and node[0] > 1:
                node = node >> 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

        while len(rows := rows[tree[rows, 1] < NONE]):
            top = tree[rows, 1]
            i, merged = top % width, top // width
            right = nxt[rows, i]
            after = nxt[rows, right]
            tok[rows, i], nxt[rows, i], alive[rows, right] = merged, after, False
            put(rows, right, NONE)
            more = after < size[rows]
            r, j, a = rows[more], i[more], after[more]
            prv[r, a] = j
            value = np.full(len(rows), NONE)
            if len(r):
                rank = self._ranks_of(merged[more], tok[r, a])
                value[more] = np.where(rank < NONE, rank * width + j, NONE)
            put(rows, i, value)
            before = prv[rows, i]
            if len(r := rows[less := before >= 0]):
                b = before[less]
                rank = self._ranks_of(tok[r, b], merged[less])
                put(r, b, np.where(rank < NONE, rank * width + b, NONE))
        ids, ends = tok[alive].astype("<u4").tobytes(), 4 * alive.sum(1).cumsum()
        return [ids[s:e] for s, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def merge_alone(self, piece: bytes) -> bytes:
        """Ids of one piece of any length."""
        n, pairs, none = len(piece), self.pairs, int(NONE)
        width = 1 << (n - 1).bit_length()
        tok = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        nxt, prv, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        tree = [none] * (2 * width)

        def value(i: int, j: int) -> int:
            rank = pairs.get(tok[i] << 20 | tok[j]) if j < n else None
            return none if rank is None else rank * width + i

        for i in range(n):
            tree[width + i] = value(i, i + 1)
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, v: int) -> None:
            k = width + i
            tree[k] = v
            while k > 1:
                k >>= 1
                v = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == v:
                    break
                tree[k] = v

        while n > 1 and (top := tree[1]) < none:
            i = top % width
            j = nxt[i]
            tok[i], nxt[i], live[j] = top // width, nxt[j], False
            if nxt[i] < n:
                prv[nxt[i]] = i
            put(j, none)
            put(i, value(i, nxt[i]))
            if prv[i] >= 0:
                put(prv[i], value(prv[i], i))
        return np.array([t for t, on in zip(tok, live, strict=True) if on], "<u4").tobytes()

    def learn(self, pieces: Iterable[str]) -> None:
        """Put the ids of pieces in the cache."""
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            data = p.encode("utf-8", "surrogatepass")
            if (rank := self.ranks.get(data)) is not None:
                self.cache[p] = rank.to_bytes(4, "little")
            elif len(data) > WIDE:
                self.cache[p] = self.merge_alone(data)
            else:
                by_width.setdefault(max(2, 1 << (len(data) - 1).bit_length()), []).append((p, data))
        for width, held in by_width.items():
            for k in range(0, len(held), ROWS):
                part = held[k : k + ROWS]
                self.cache.update(zip([p for p, _ in part], self.merge_together([d for _, d in part], width), strict=True))

    def _whole(self, chunk: str) -> bytes:
        return b"".join(map(self.cache.__getitem__, self.pattern.findall(chunk)))

    def encode(self, batch: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers.

        A space or line feed between two characters that are no white space always starts a piece. So where a text has
        no other white space, it falls into words whose pieces don't depend on their neighbours.
        """
        if len(self.cache) + len(self.after_space) > self.cached:
            self.cache, self.after_space = {}, {}
        lines: list[list[list[str]] | None] = []
        wanted, words = {"\n"}, set()
        for t in batch:
            split = [x.split(" ") for x in t.split("\n")]
            if list(chain.from_iterable(split)) != t.split():  # or else it has other white space, or two in a row
                lines.append(None)
                wanted.update(self.pattern.findall(t))
                continue
            lines.append(split)
            for x in split:
                wanted.update(self.pattern.findall(x[0]))
                words.update(x[1:])
        whole = self.whole_words  # what Python takes for letters the pattern does too
        cut = {w: [" " + w] if whole and w.isalpha() else self.pattern.findall(" " + w) for w in words if w not in self.after_space}
        for pieces in cut.values():
            wanted.update(pieces)
        self.learn(p for p in wanted if p not in self.cache)
        self.after_space.update((w, b"".join(map(self.cache.__getitem__, pieces))) for w, pieces in cut.items())
        get, feed = self.after_space.__getitem__, self.cache["\n"]
        return [self._whole(t) if x is None else feed.join([b"".join([self._whole(y[0]), *map(get, y[1:])]) for y in x]) for t, x in zip(batch, lines, strict=True)]

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for."""
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_WORKERS: dict[tuple[int, str], Bpe] = {}


def _encoder(raw: bytes, pattern: str) -> Bpe:
    key = (hash(raw), pattern)
    if key not in _WORKERS:
        _WORKERS.clear()
        _WORKERS[key] = Bpe(read_ranks(raw), pattern)
    return _WORKERS[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit numbers), n_tokens, decoded (binary), and the carried columns, for every row of docs.

    The rank file is read on the driver and sent to the tasks: its size is that of the vocabulary, whatever the data.
    """
    with open(ranks_path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = _encoder(sent.value, pattern)
        gc.disable()  # strings and bytes make no cycles
        for b in batches:
            for k in range(0, len(b), 512):
                part = b.iloc[k : k + 512]
                ids = bpe.encode(part["text"].tolist())
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "n_tokens": [len(x) // 4 for x in ids], "ids": ids, "decoded": [bpe.decode(x) for x in ids], **{c: part[c].to_numpy() for c in carried}}).astype({"doc_id": "Int64"})

    schema = ", ".join(["doc_id long, n_tokens long, ids binary, decoded binary", *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)])
    return texts(docs, *carried).mapInPandas(rows, schema)


def token_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the decoded bytes."""
    return encode_documents(docs, ranks_path, pattern).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
