"""BPE encoding and decoding by an index of pairs.

In each task the pieces (matches of the split pattern) that a batch of texts needs, and that no text before it needed, are laid end to end as tokens of one byte each. An index maps each pair of neighbours that has a rank to all
positions where it stands. The active ranks, those with positions, are applied in ascending order: all live positions of the lowest one are merged from left to right, and the pairs that a
merge makes with its neighbours enter the lists of their own ranks. A position whose pair has meanwhile been merged into another stays in its list and is passed over. Where the file's ranks don't rise with
its tokens (a merge may then make a pair of a lower rank than its own), only the first position in each piece is merged before the lowest active rank is looked for again. Either way each piece sees its merges in the
order of rank, then place.

A piece takes its merges even if it is a token as a whole, unlike in a file of ranks. Added tokens of the file are cut out of a text first, in any text, and stand for themselves. Letters and numbers that Unicode has only had
since its version 16 count as neither, as in the library. Spark deals out the documents; nothing is shuffled. A task holds one batch and a bounded cache of pieces.

Defined results: a null text counts as empty; an empty text has no ids. Rows that repeat are encoded each. Only doc_id, text and the carried columns are read, whatever other columns there are. A file with a normalizer, dropout,
affixes, an unknown token, byte fallback, or added tokens that take in their surroundings is refused.
"""

from __future__ import annotations

import gc
import hashlib
import json
from collections.abc import Callable, Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Bpe
from .common import texts

#: Bytes of new pieces that are indexed at a time, about, rows that are encoded at a time, and most cached pieces and words of a worker.
INDEXED, ROWS, CACHED = 1 << 20, 2048, 1_250_000
# Code points that became letters or numbers after Unicode 16, the version that the library goes by.
NEWER = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 "
    "16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 "
    "1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
#: A code point that is neither letter nor number nor white space, and stays unassigned.
OTHER = "͸"


class Cutter:
    """Pieces of texts by a pattern, with newer letters and numbers as other characters."""

    def __init__(self, pattern: str) -> None:
        self.pattern = regex.compile(pattern)
        self.newer = regex.compile("[" + "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in NEWER.split()) + "]")

    def findall(self, t: str) -> list[str]:
        if t[:1] == " " and t[1:].isalpha():  # a space and letters are one piece; these are letters by an earlier version
            return [t]
        if t.isascii() or not self.newer.search(t):
            return self.pattern.findall(t)
        return [t[m.start() : m.end()] for m in self.pattern.finditer(self.newer.sub(OTHER, t))]


def byte_names() -> dict[str, int]:
    """The characters that stand for bytes in the file: printable ones for themselves, the others in order from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class PairBpe(Bpe):
    """Merges by an index of pairs, from the text of a tokenizer file. Cutting into words, the cache of pieces and decoding are those of the encoder by segment trees."""

    cached = CACHED

    def __init__(self, raw: str, pattern: str) -> None:
        file = json.loads(raw)
        model, added = file["model"], file.get("added_tokens") or []
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += ["normalizer"] if file.get("normalizer") else []
        odd += [k for t in added for k in ("single_word", "lstrip", "rstrip") if t.get(k)]
        if odd:
            raise ValueError(f"not supported in a tokenizer file: {', '.join(odd)}")
        named = byte_names()
        self.pattern = Cutter(pattern)
        self.vocabulary = {i: bytes(map(named.__getitem__, t)) for t, i in model["vocab"].items()}
        ids = {t: i for i, t in self.vocabulary.items()}
        self.byte = np.array([ids[bytes([b])] for b in range(256)], np.int64)
        self.rules, made = [], {}
        for rank, m in enumerate(model["merges"]):
            left, right = (ids[bytes(map(named.__getitem__, t))] for t in (m.split(" ") if isinstance(m, str) else m))
            self.rules.append((left, right, ids[self.vocabulary[left] + self.vocabulary[right]]))
            made[self.rules[-1][2]] = rank
        self.pairs = {a << 20 | b: rank for rank, (a, b, _) in enumerate(self.rules)}
        #: Whether no merge makes a pair of a lower rank than its own.
        self.rising = all(made.get(t, -1) < rank for rank, (a, b, _) in enumerate(self.rules) for t in (a, b))
        self.keys = np.array(sorted(self.pairs), np.int64)
        self.values = np.array([self.pairs[k] for k in self.keys.tolist()], np.int64)
        self.added = {t["content"]: int(t["id"]) for t in added}
        self.vocabulary |= {i: t.encode() for t, i in self.added.items()}
        self.decimal = [str(i) for i in range(max(self.vocabulary) + 1)]
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut_added = regex.compile("|".join(map(regex.escape, longest_first))) if added else None
        self.cache, self.after_space = {}, {}

    def positions(self, tok: np.ndarray, last: np.ndarray) -> dict[int, list[int]]:
        """The index: each rank's positions in tok, pair by pair; last: whether a token ends its piece."""
        left = np.flatnonzero(~last)
        rank = self._ranks_of(tok[left], tok[left + 1])
        left, rank = left[rank < len(self.rules)], rank[rank < len(self.rules)]
        order = np.argsort(rank, kind="stable")
        left, rank = left[order], rank[order]
        cut = np.flatnonzero(np.diff(rank)) + 1
        return dict(zip(rank[np.append(0, cut)].tolist(), (x.tolist() for x in np.split(left, cut)), strict=True)) if len(rank) else {}

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces that aren't empty, as little-endian unsigned 32-bit numbers."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = size.cumsum()
        n = int(ends[-1])
        first = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        last, start = np.zeros(n, bool), np.zeros(n, bool)
        last[ends - 1] = start[ends - size] = True
        at = np.arange(n)
        after, before, tok = np.where(last, -1, at + 1).tolist(), np.where(start, -1, at - 1).tolist(), first.tolist()
        piece = None if self.rising else np.repeat(np.arange(len(pieces)), size).tolist()
        index, rank_of = self.positions(first, last), self.pairs.get
        active = list(index)
        heapify(active)

        while active:
            rank = heappop(active)
            a, b, new = self.rules[rank]
            done, later = set(), []
            for i in sorted(index.pop(rank)):
                if tok[i] != a or (j := after[i]) < 0 or tok[j] != b:
                    continue
                if piece is not None:
                    if piece[i] in done:
                        later.append(i)
                        continue
                    done.add(piece[i])
                k, h = after[j], before[i]
                tok[i], tok[j], after[i] = new, -1, k
                if k >= 0:
                    before[k] = i
                    if (r := rank_of(new << 20 | tok[k])) is not None:
                        if r in index:
                            index[r].append(i)
                        else:
                            index[r] = [i]
                            heappush(active, r)
                if h >= 0 and (r := rank_of(tok[h] << 20 | new)) is not None:
                    if r in index:
                        index[r].append(h)
                    else:
                        index[r] = [h]
                        heappush(active, r)
            if later:
                if rank not in index:
                    heappush(active, rank)
                index.setdefault(rank, []).extend(later)
        got = np.array(tok, np.int64)
        live = got >= 0
        ids, stops = got[live].astype("<u4").tobytes(), 4 * live.cumsum()[ends - 1]
        return [ids[s:e] for s, e in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]

    def learn(self, pieces: Iterable[str]) -> None:
        """Put the ids of pieces in the cache."""
        held, size = [], 0

        def flush() -> None:
            if held:
                self.cache.update(zip(held, self.merge([p.encode("utf-8", "surrogatepass") for p in held]), strict=True))

        for p in pieces:
            held.append(p)
            size += len(p)
            if size > INDEXED:
                flush()
                held, size = [], 0
        flush()

    def encode(self, batch: list[str]) -> list[bytes]:
        """Ids of each text; those of added tokens stand where the tokens do."""
        if self.cut_added is None or not any(t in x for t in self.added for x in batch):
            return super().encode(batch)
        between, own = [self.cut_added.split(x) for x in batch], [self.cut_added.findall(x) for x in batch]
        ids = iter(super().encode([part for parts in between for part in parts]))
        out = []
        for tokens in own:
            whole = [next(ids)]
            for t in tokens:
                whole += [self.added[t].to_bytes(4, "little"), next(ids)]
            out.append(b"".join(whole))
        return out


_WORKERS: dict[tuple[int, str], PairBpe] = {}


def _encoder(raw: str, pattern: str) -> PairBpe:
    key = (hash(raw), pattern)
    if key not in _WORKERS:
        _WORKERS.clear()
        _WORKERS[key] = PairBpe(raw, pattern)
    return _WORKERS[key]


def _encoded(docs: DataFrame, model_path: str, pattern: str, columns: Callable[[PairBpe, list[bytes], list[str]], dict], schema: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, what columns gives for ids and decoded texts, and the carried columns. The file is read on the driver and sent to the tasks: its size is that of the vocabulary, whatever the data."""
    with open(model_path, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    held = {f"__{i}": c for i, c in enumerate(carried)}

    def rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = _encoder(sent.value, pattern)
        gc.disable()  # a cache of strings and bytes makes no cycles; looking for some in it takes an eighth of the time
        for b in batches:
            for k in range(0, len(b), ROWS):
                part = b.iloc[k : k + ROWS]
                ids = bpe.encode(part["text"].tolist())
                decoded = [bpe.decode(x).decode("utf-8", "replace") for x in ids]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "n_tokens": [len(x) // 4 for x in ids], **columns(bpe, ids, decoded), **{h: part[h].to_numpy() for h in held}}).astype({"doc_id": "Int64"})

    given = ", ".join(["doc_id long, n_tokens long", schema, *(f"{h} {docs.schema[c].dataType.simpleString()}" for h, c in held.items())])
    return texts(docs, *[docs[f"`{c}`"].alias(h) for h, c in held.items()]).mapInPandas(rows, given)


def encode_documents(docs: DataFrame, model_path: str, pattern: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>), decoded (string), and a struct `carried` of the carried columns if there are any, for every row of docs."""
    arrays = lambda bpe, ids, decoded: {"ids": [np.frombuffer(x, "<u4").astype(np.int32) for x in ids], "decoded": decoded}
    out = _encoded(docs, model_path, pattern, arrays, "ids array<int>, decoded string", carried)
    if not carried:
        return out
    return out.select("doc_id", "n_tokens", "ids", "decoded", F.struct(*[F.col(f"__{i}").alias(c) for i, c in enumerate(carried)]).alias("carried"))


def token_digests(docs: DataFrame, model_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids, as decimal numbers joined by commas, and of the decoded text, worked out in the tasks so that neither leaves them."""

    def digests(bpe: PairBpe, ids: list[bytes], decoded: list[str]) -> dict:
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        return {"ids_sha256": [sha(",".join(map(bpe.decimal.__getitem__, np.frombuffer(x, "<u4").tolist()))) for x in ids], "decoded_sha256": [sha(x) for x in decoded]}

    return _encoded(docs, model_path, pattern, digests, "ids_sha256 string, decoded_sha256 string")
