"""Personal data: base patterns, and information-theoretic sanitisation of the terms around them.

Base spans are e-mail addresses, IP addresses, card numbers and telephone numbers, leftmost and not overlapping within a kind. Each value is a protected entity. From the whole corpus is
counted in how many documents a term (a word of three letters or more, in lower case, outside base spans) and an entity occur together, n(t, c), and in how many either occurs at all, n(t) and
n(c). A term discloses the share PMI(t; c) / IC(c) of the entity's information, with PMI = log(N n(t, c) / (n(t) n(c))) and IC = log(N / n(c)). A pair counts if chance hardly brings it about:
with m = n(t) n(c) / N documents expected, exp(n(t, c) - m) (m / n(t, c)) ^ n(t, c), which bounds the Poisson tail, is `CHANCE` at most. That serves entities of one document as well. A term whose share reaches `threshold` for
an entity becomes a span of kind `term` wherever it stands, in any text. In sanitised text base spans become their kind, such a term is generalised to its length class, and removed if its
share is 1: it occurs beside nobody else.

Texts stay in place: tasks send on counts of terms and entities, then the entities, and terms rare enough to disclose one, of texts that have base spans. Entities that occur in the same documents are one class, and so are terms that
are counted equally and stand in the same of these texts (by two 64-bit hashes of the sets): one pair of classes stands for all pairs of their members, as n(t, c) is the same. A text whose pairs of classes are many is dealt to cells by
its terms. Texts are sanitised, and their digests taken, in the scan that finds their spans; only where terms are too many to be known in the task are texts with a span carried along.

Defined results: a null text counts as empty and has no spans. Rows that repeat are scanned, counted and sanitised each, whatever their ids. Of several entities that a term discloses the largest share counts;
spans that start together go by kind as listed, terms last. Only doc_id and text are read.
"""

from __future__ import annotations

import gc
import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Filter, checkpointed, texts
from .suffix_tree_lm import _arrays

KINDS = ("email", "ip", "card", "phone")
DISCLOSURE, CHANCE = 0.9, 1e-3
#: Tokens whose words a task holds, at most.
TOKENS = 400_000
#: Pairs of one text that are made in one place, about.
CELL = 1 << 16
#: Tokens of one text that are looked for one by one, at most; with more the text is read word by word.
SOUGHT = 8
#: Disclosing terms that are broadcast, at most, at 16 bytes each.
MOST_TERMS = 1 << 21
_NONE: dict[str, float] = {}
#: The base patterns. A run of digits is looked at from its first digit only, which finds the same and takes linear time.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT, _NO_DIGIT = re.compile("[0-9]"), re.compile("[^0-9]")
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    """Whether the digits have a right Luhn check digit."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches around each @: the name before it as far as the last match, then a domain."""
    end = at = 0
    while (at := text.find("@", max(at, end))) >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            end = m.end()
            yield start, end
        else:
            at += 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as listed."""
    out = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = _NO_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
                    out.append(("phone", *m.span()))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def _hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)


def entity_of(text: str, kind: str, start: int, end: int) -> int:
    return _hash(f"{kind}:{text[start:end].lower() if kind == 'email' else _NO_DIGIT.sub('', text[start:end]) if kind != 'ip' else text[start:end]}")


def words_of_tokens(text: str, tokens: Iterable[str]) -> list[tuple[int, int]]:
    """(start, end) of the words of the given tokens (what white space parts) wherever they stand in the text, in order."""
    out = []
    for t in tokens:
        inner, n = [m.span() for m in _WORD.finditer(t)], len(t)
        at = text.find(t)
        while at >= 0:
            alone = (at == 0 or text[at - 1].isspace()) and (at + n == len(text) or text[at + n].isspace())
            if alone:
                out += [(at + s, at + e) for s, e in inner]
            at = text.find(t, at + (n if alone else 1))
    return sorted(out)


def words_outside(text: str, spans: list[tuple[str, int, int]], words: list[tuple[int, int]] | None = None) -> Iterator[tuple[int, int]]:
    """(start, end) of the words of three letters or more that touch no span; words: those that are asked for, in order, or else all of the text."""
    reach, at = [], 0  # spans with their ends so far: those that start before a word end before it, or one of them touches it
    for _, s, e in spans:
        at = max(at, e)
        reach.append((s, at))
    k = -1
    for s, e in (m.span() for m in _WORD.finditer(text)) if words is None else words:
        while k + 1 < len(reach) and reach[k + 1][0] < e:
            k += 1
        if e - s >= 3 and (k < 0 or reach[k][1] <= s):
            yield s, e


def _count_rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """In how many documents each term, and each entity, occurs, summed for some hundred thousand of them at a time."""
    counts: tuple[Counter, Counter] = Counter(), Counter()
    of_token: dict[str, tuple[int, ...]] = {}
    gc.disable()  # strings and numbers make no cycles

    def out() -> pd.DataFrame:
        rows = pd.DataFrame({"key": [*counts[0], *counts[1]], "entity": [0] * len(counts[0]) + [1] * len(counts[1]), "n": [*counts[0].values(), *counts[1].values()]}, dtype="int64")
        counts[0].clear()
        counts[1].clear()
        return rows

    for b in batches:
        for text in b["text"]:
            tokens = set(text.split())
            if len(of_token) > TOKENS:
                of_token.clear()
            for t in tokens.difference(of_token):
                of_token[t] = tuple(_hash(w.lower()) for w in _WORD.findall(t) if len(w) >= 3)
            counts[0].update({h for t in tokens for h in of_token[t]})
            counts[1].update({entity_of(text, *x) for x in base_spans(text)})
            if len(counts[0]) + len(counts[1]) > 200_000:
                yield out()
    yield out()


def members(rows: DataFrame, key: str, name: str, *same: str) -> DataFrame:
    """Each key of rows (id, key, ...; a key once for each id) with its columns in `same` and two hashes, name1 and name2, of the set of ids that it has: keys of one class have all of them alike."""
    sets = [F.bit_xor(F.xxhash64(F.lit(seed), "id")).alias(f"{name}{seed}") for seed in (1, 2)]
    return rows.groupBy(key, *same).agg(*sets)


def classes(rows: DataFrame, key: str, name: str, *same: str) -> DataFrame:
    """The classes of each id: id, the columns in `same`, and the class's two hashes."""
    of = checkpointed(members(rows, key, name, *same))
    return rows.select("id", key).join(of, key).select("id", *same, f"{name}1", f"{name}2").distinct()


def paired(of: DataFrame, beside: DataFrame) -> DataFrame:
    """The rows of both of one id, side by side. An id with more than about CELL pairs is dealt to cells: its rows of beside by their hash, its rows of `of`, of which there are fewer as a rule, to each."""
    sizes = of.groupBy("id").agg(F.count("*").alias("a")).join(beside.groupBy("id").agg(F.count("*").alias("b")), "id")
    large = checkpointed(sizes.filter(F.col("a") * F.col("b") > CELL).select("id", F.least(F.col("b"), F.ceil(F.col("a") * F.col("b") / CELL)).cast("int").alias("cells")))
    dealt = lambda rows: rows.join(large, "id", "left").withColumn("cells", F.coalesce("cells", F.lit(1)))
    left = dealt(of).withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).drop("cells")
    right = dealt(beside).withColumn("cell", F.pmod(F.xxhash64("t1", "t2"), F.col("cells")).cast("int")).drop("cells")
    return left.join(right, ["id", "cell"])


def disclosing(docs: DataFrame, threshold: float = DISCLOSURE) -> DataFrame:
    """(term, share): terms that reveal at least threshold of an entity's information, with the largest share."""
    plain, total = texts(docs).select("text"), float(docs.count())
    counts = checkpointed(plain.mapInPandas(_count_rows, "key long, entity long, n long").groupBy("key", "entity").agg(F.sum("n").alias("n")))
    # n(t, c) is at most n(c), so a term in more documents than this has too small a share whatever they are
    most = F.lit(total) * F.pow(F.col("n_c") / F.lit(total + 1), F.lit(threshold)) * (1 + 1e-9)
    entities = counts.filter("entity = 1").select(F.col("key").alias("entity"), F.col("n").alias("n_c")).withColumn("most", most)
    terms = counts.filter("entity = 0").select(F.col("key").alias("term"), F.col("n").alias("n_t"))
    rare = terms.filter(F.col("n_t") <= F.lit(entities.agg(F.max("most")).first()[0] or 0.0))
    sent = docs.sparkSession.sparkContext.broadcast(Filter(rare.select(F.col("term").alias("key"))))

    def met_rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Entities of each text with base spans, and its terms that may be rare enough."""
        for b in (whole.iloc[k : k + 512] for whole in batches for k in range(0, len(whole), 512)):
            found = [(t, x) for t in b["text"] if (x := base_spans(t))]
            words = [np.array([_hash(w) for w in {t[s:e].lower() for s, e in words_outside(t, x)}], np.int64) for t, x in found]
            yield pd.DataFrame({"entities": [list({entity_of(t, *x) for x in spans}) for t, spans in found], "terms": [w[sent.value.has(w)] for w in words]}, dtype=object)

    met = checkpointed(plain.mapInPandas(met_rows, "entities array<long>, terms array<long>").withColumn("id", F.monotonically_increasing_id()))
    of = classes(met.select("id", F.explode("entities").alias("entity")).join(entities, "entity"), "entity", "c", "n_c", "most")
    term_rows = met.select("id", F.explode("terms").alias("term")).join(rare, "term")
    term_classes = checkpointed(members(term_rows, "term", "t", "n_t"))
    beside = term_rows.join(term_classes.select("term", "t1", "t2"), "term").select("id", "n_t", "t1", "t2").distinct()
    both = paired(of, beside).filter(F.col("n_t") <= F.col("most")).groupBy("c1", "c2", "t1", "t2", "n_c", "n_t").agg(F.count("*").alias("n_tc"))
    n, m = F.col("n_tc").cast("double"), F.greatest("n_t", "n_tc").cast("double") * F.col("n_c") / F.lit(total)
    share = F.log(n / m) / F.log((F.lit(total) + 1) / F.col("n_c"))
    sure = (n > m) & (n * F.log(n / m) - n + m >= -math.log(CHANCE))
    found = both.filter(sure).select("t1", "t2", "n_t", share.alias("share")).filter(F.col("share") >= threshold).groupBy("t1", "t2", "n_t").agg(F.max("share").alias("share"))
    return term_classes.join(found, ["t1", "t2", "n_t"]).select("term", "share")


class Known:
    """Disclosing terms: as a sorted array, with their shares, or as a filter that lets few others through and knows no shares."""

    def __init__(self, shares: DataFrame, most: int) -> None:
        self.exact = shares.count() <= most
        if self.exact:
            self.terms, self.shares = _arrays(shares, "term", "share")
        else:
            self.filter = Filter(shares.select(F.col("term").alias("key")))

    def shares_of(self, terms: np.ndarray) -> np.ndarray:
        """NaN: not a disclosing term; 0: perhaps one."""
        if not self.exact:
            return np.where(self.filter.has(terms), 0.0, np.nan)
        if not len(self.terms):
            return np.full(len(terms), np.nan)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, self.shares[at], np.nan)


def find_personal_data(docs: DataFrame, threshold: float = DISCLOSURE, whole: bool = False, most_terms: int = MOST_TERMS, digest: bool = False) -> DataFrame:
    """doc_id, text, base and added spans (arrays by start), the added ones with their share, for every row of docs.

    whole: whether texts without a span are given as well. digest: whether the digest of the sanitised text will do, in sha256, in place of texts. most_terms: so many disclosing terms are broadcast, with their shares; with more, words that may be
    such terms find their shares by a join, with the same result.
    """
    shares = checkpointed(disclosing(docs, threshold))
    known = Known(shares, most_terms)
    sent = docs.sparkSession.sparkContext.broadcast(known)
    here = digest and known.exact  # whether texts are sanitised where they are

    def scan_rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of_token: dict[str, dict[str, float]] = {}  # the words, in lower case, that may be terms
        gc.disable()  # strings and numbers make no cycles
        for b in (part.iloc[k : k + 256] for part in batches for k in range(0, len(part), 256)):
            if len(of_token) > TOKENS:
                of_token.clear()
            tokens = [set(t.split()) for t in b["text"]]
            new = set().union(*tokens).difference(of_token)
            unknown = [(t, w.lower()) for t in new for w in _WORD.findall(t) if len(w) >= 3]
            of_token |= {t: _NONE for t in new}
            share = sent.value.shares_of(np.array([_hash(w) for _, w in unknown], np.int64))
            for i in np.flatnonzero(~np.isnan(share)).tolist():
                t, w = unknown[i]
                of_token[t] = {**of_token[t], w: float(share[i])}
            spans = [base_spans(t) for t in b["text"]]
            added = []
            for text, own, x in zip(b["text"], tokens, spans, strict=True):
                some = [t for t in own if of_token[t]]
                asked = {w: v for t in some for w, v in of_token[t].items()}
                words = words_of_tokens(text, some) if len(some) <= SOUGHT else None
                places = [(s, e, text[s:e].lower()) for s, e in words_outside(text, x, words)] if asked else []
                added.append([{"start": s, "end": e, "share": asked[w], "term": _hash(w)} for s, e, w in places if w in asked])
            base = [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in spans]
            carried = [(whole or bool(x) or bool(h)) and not here for x, h in zip(spans, added, strict=True)]
            clean = [sanitise_text(t, x, h) if here and (x or h) else t for t, x, h in zip(b["text"], base, added, strict=True)]
            yield pd.DataFrame({
                "row_id": b["row_id"].to_numpy(), "doc_id": b["doc_id"].to_numpy(),
                "text": pd.Series([t if on else None for t, on in zip(b["text"], carried, strict=True)], dtype="object").to_numpy(),
                "sha256": pd.Series([None if on else hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t, on in zip(clean, carried, strict=True)], dtype="object").to_numpy(),
                "base": base, "added": added,
            }).astype({"doc_id": "Int64"})

    schema = "row_id long, doc_id long, text string, sha256 string, base array<struct<kind: string, start: int, `end`: int>>, added array<struct<start: int, `end`: int, share: double, term: long>>"
    found = texts(docs).withColumn("row_id", F.monotonically_increasing_id()).mapInPandas(scan_rows, schema)
    if not known.exact:
        found = checkpointed(found)
        hits = found.filter(F.size("added") > 0).select("row_id", F.explode("added").alias("x")).select("row_id", "x.start", "x.end", "x.term").join(shares, "term")
        sure = hits.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "share", "term"))).alias("sure"))  # words of one text
        none = F.array().cast("array<struct<start: int, end: int, share: double, term: bigint>>")
        found = found.join(sure, "row_id", "left").withColumn("added", F.coalesce("sure", none))
    if digest and not here:
        found = found.withColumns({"sha256": F.coalesce("sha256", F.sha2(_clean()("text", "base", "added").cast("binary"), 256)), "text": F.lit(None).cast("string")})
    return found.select("doc_id", "text", "sha256", "base", "added")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def span_digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, all spans, and the digest of the sanitised text, for every row of docs."""
    found = find_personal_data(docs, digest=True)
    rank = F.create_map(*[F.lit(x) for i, k in enumerate((*KINDS, "term")) for x in (k, i)])
    keyed = lambda x, kind: F.struct(x["start"].alias("start"), rank[kind].alias("rank"), x["end"].alias("end"), kind.alias("kind"))
    base = F.transform("base", lambda x: keyed(x, x["kind"]))
    more = F.transform("added", lambda x: keyed(x, F.lit("term")))
    kinds = F.transform("base", lambda x: x["kind"])
    count = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id", *count, F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.array_sort(F.concat(base, more))).alias("spans"),
        F.col("sha256").alias("sanitised_sha256"),
    )


def sanitise_text(text: str, base: list, added: list) -> str:
    """The text with base spans named by kind, and added ones generalised or, at a share of 1, removed. What overlaps a span before it goes with that."""
    spans = [(s["start"], s["end"], f"<{s['kind']}>") for s in base]
    spans += [(s["start"], s["end"], "" if s["share"] >= 1 - 1e-9 else f"<word{len(text[s['start'] : s['end']]) // 4 * 4}>") for s in added]
    out, at = [], 0
    for s, e, name in sorted(spans):
        if s >= at:
            out += [text[at:s], name]
            at = e
        else:
            at = max(at, e)
    return "".join(out) + text[at:]


def _clean() -> Callable[..., Column]:
    @F.pandas_udf("string")
    def clean(text: pd.Series, base: pd.Series, added: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else sanitise_text(t, b, a) for t, b, a in zip(text, base, added, strict=True)], dtype="object")

    return clean


def sanitise(docs: DataFrame, threshold: float = DISCLOSURE) -> DataFrame:
    """(doc_id, text) with sanitised texts, for every row of docs."""
    found = find_personal_data(docs, threshold, whole=True)
    return found.select("doc_id", _clean()("text", "base", "added").alias("text"))
