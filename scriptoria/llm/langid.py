"""Language of code-switched text by a linear-chain conditional random field over words.

A word's features are its affixes, letter n-grams, length and the word itself (the lexicon), hashed to a fixed number of weights for each
language. Neighbouring labels are tied by learned transition weights. Training maximises the likelihood of labelled
sequences by AdaGrad, the gradient being observed less expected counts, by forward-backward. The sequences are spliced from runs of words of documents of
different languages, so that switches are seen. At most docs_per_language whole documents of each language, those with the
smallest hashes, are fitted on the driver: a bounded sample of labelled rows.

Every whole text is then labelled by forward-backward: a task runs the recursions of a batch's documents side by side.
A document's language has the largest summed posterior of its words; the score is the mean posterior of that language.

Defined results: null texts and texts without a letter are `und` with score 0. Without any labelled row all are `und`. Ties go to the language named
first. Rows that repeat are labelled each. A text of any length is labelled whole. Only doc_id, text and, for training, lang are read; other columns, whatever
their names, are carried along by `drop_unidentified`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fold_of, texts

BITS, RUN, CACHED = 17, 48, 250_000
_LETTERS = re.compile(r"[^\W\d_]+")
UND = "und"


def word_of(token: str) -> str:
    """The letters of a token, in lower case."""
    return "".join(_LETTERS.findall(token)).lower()


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, feature) pairs: the whole word, its length, affixes of one to three letters, and letter trigrams."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    code = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    ends = size.cumsum()
    starts = ends - size
    number = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(code)) - starts[number]
    odd, mask, down = np.uint64(0x9E3779B97F4A7C15), np.uint64((1 << BITS) - 1), np.uint64(40)

    def gram(first: np.ndarray, n: int) -> np.ndarray:
        h = np.full(len(first), n, np.uint64)
        for k in range(n):
            h = (h ^ code[first + k]) * odd
            h ^= h >> np.uint64(29)
        return h >> down & mask

    whole = np.add.reduceat((code ^ (place.astype(np.uint64) << np.uint64(32))) * odd >> np.uint64(7), starts) * odd >> down & mask
    each = np.arange(len(words))
    three = np.flatnonzero(place <= size[number] - 3)
    four = np.flatnonzero(size >= 4)
    parts = [(each, whole), (each, np.minimum(size, 16).astype(np.uint64)), (each, gram(starts, 2)), (each, gram(ends - 2, 2)), (number[three], gram(three, 3)), (four, gram(starts[four], 4)), (four, gram(ends[four] - 4, 4))]
    return np.concatenate([n for n, _ in parts]), np.concatenate([f for _, f in parts]).astype(np.int64)


class Crf:
    """Weights by feature and label, and transition weights between labels."""

    def __init__(self, labels: list[str]) -> None:
        k = len(labels)
        self.labels = labels
        self.weights = np.zeros((1 << BITS, k), np.float32)
        self.transitions = np.zeros((k, k), np.float32)
        self._index: dict[str, int] = {}
        self._scores = np.ones((1024, k), np.float32)
        self._spoken = np.zeros(1024, bool)

    def __getstate__(self) -> dict:
        return {"labels": self.labels, "weights": self.weights, "transitions": self.transitions}

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["labels"])
        self.weights, self.transitions = state["weights"], state["transitions"]

    def index(self, tokens: list[str]) -> np.ndarray:
        """Rows of the emission table for tokens, which grows by those not seen yet."""
        known = self._index
        new = [t for t in dict.fromkeys(tokens) if t not in known]
        if len(known) + len(new) > CACHED:
            known.clear()
            new = list(dict.fromkeys(tokens))
        if new:
            start, end = len(known), len(known) + len(new)
            while end > len(self._spoken):
                self._scores = np.concatenate([self._scores, np.ones_like(self._scores)])
                self._spoken = np.concatenate([self._spoken, np.zeros_like(self._spoken)])
            words = list(map(word_of, new))
            spoken = [i for i, w in enumerate(words) if w]
            total = np.zeros((len(new), len(self.labels)))
            if spoken:
                number, feature = features([words[i] for i in spoken])
                total[spoken] = np.stack([np.bincount(number, self.weights[feature, c], len(spoken)) for c in range(len(self.labels))], 1)
            self._scores[start:end] = np.maximum(np.exp(total - total.max(1, keepdims=True)), 1e-12)
            self._spoken[start:end] = [bool(w) for w in words]
            known.update(zip(new, range(start, end), strict=True))
        return np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))

    def posteriors(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Posterior of each label summed over each document's words with letters, and how many those are."""
        k, n = len(self.labels), len(docs)
        sizes = np.fromiter(map(len, docs), np.int64, n)
        if not sizes.sum():
            return np.zeros((n, k)), np.zeros(n, np.int64)
        row = self.index([t for d in docs for t in d])
        # words lie by their place in the document, the documents with most words first: a step of all documents is a slice
        rank = np.empty(n, np.int64)
        rank[np.argsort(-sizes, kind="stable")] = np.arange(n)
        doc = np.repeat(np.arange(n), sizes)
        place = np.arange(len(row)) - (sizes.cumsum() - sizes)[doc]
        by_place = np.argsort(place * n + rank[doc])
        row, doc = row[by_place], doc[by_place]
        active = np.bincount(place)
        ends = active.cumsum()
        emit, move = self._scores[row].astype(np.float64), np.exp(self.transitions.astype(np.float64))
        alpha, beta = np.empty_like(emit), np.ones_like(emit)
        a = alpha[: ends[0]] = emit[: ends[0]]
        for t in range(1, len(ends)):
            start, end = ends[t - 1], ends[t]
            a = (a[: end - start] @ move) * emit[start:end]
            if not t % 4:
                a /= a.sum(1, keepdims=True)
            alpha[start:end] = a
        for t in range(len(ends) - 2, -1, -1):
            end, m = ends[t], active[t + 1]
            b = (beta[end : end + m] * emit[end : end + m]) @ move.T
            if not t % 4:
                b /= b.sum(1, keepdims=True)
            beta[end - active[t] : end - active[t] + m] = b
        alpha *= beta
        alpha /= alpha.sum(1, keepdims=True)
        spoken = self._spoken[row]
        alpha[~spoken] = 0
        return np.stack([np.bincount(doc, alpha[:, c], n) for c in range(k)], 1), np.bincount(doc[spoken], minlength=n)

    def fit(self, docs: list[tuple[str, str]], epochs: int = 6, seed: int = 7) -> "Crf":
        """Fit on (text, label) rows, spliced to sequences of RUN words in which labels change now and then."""
        rng = np.random.default_rng(seed)
        place = {x: i for i, x in enumerate(self.labels)}
        runs, gold = [], []
        for text, label in docs:
            tokens = [t for t in text.split() if _LETTERS.search(t)]
            k = 0
            while k < len(tokens):
                n = int(rng.integers(4, RUN + 1))
                runs.append(tokens[k : k + n])
                gold.append(place[label])
                k += n
        mixed = rng.permutation(len(runs))
        flat = [t for i in mixed for t in runs[i]]
        label_of = np.array([gold[i] for i in mixed for _ in runs[i]], np.int64)
        flat, label_of = flat[: len(flat) // RUN * RUN], label_of[: len(flat) // RUN * RUN]
        if not flat:
            return self
        unique = list(dict.fromkeys(flat))
        number = {t: i for i, t in enumerate(unique)}
        seq = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat)).reshape(-1, RUN)
        label_of = label_of.reshape(-1, RUN)
        k = len(self.labels)
        owner, feature = features(list(map(word_of, unique)))
        by_owner = np.argsort(owner, kind="stable")
        feature, bounds = feature[by_owner], np.searchsorted(owner[by_owner], np.arange(len(unique) + 1))
        w, g_w = np.zeros((1 << BITS, k)), np.full((1 << BITS, k), 1e-6)
        tr, g_t = np.zeros((k, k)), np.full((k, k), 1e-6)
        batch = 512
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(seq)), max(1, len(seq) // batch)):
                s, y = seq[part], label_of[part]
                ids, back = np.unique(s, return_inverse=True)
                back = back.reshape(s.shape)
                held = bounds[ids + 1] - bounds[ids]
                of_word = np.repeat(np.arange(len(ids)), held)
                used = feature[np.arange(len(of_word)) - np.repeat(held.cumsum() - held, held) + bounds[ids][of_word]]
                score = np.stack([np.bincount(of_word, w[used, c], len(ids)) for c in range(k)], 1)
                emit = np.exp(score - score.max(1, keepdims=True))[back]
                move = np.exp(tr)
                alpha, beta = np.empty_like(emit), np.ones_like(emit)
                alpha[:, 0] = emit[:, 0] / emit[:, 0].sum(1, keepdims=True)
                for t in range(1, RUN):
                    a = (alpha[:, t - 1] @ move) * emit[:, t]
                    alpha[:, t] = a / a.sum(1, keepdims=True)
                for t in range(RUN - 2, -1, -1):
                    b = (beta[:, t + 1] * emit[:, t + 1]) @ move.T
                    beta[:, t] = b / b.sum(1, keepdims=True)
                p = alpha * beta
                p /= p.sum(2, keepdims=True)
                err = -p
                np.put_along_axis(err, y[..., None], np.take_along_axis(err, y[..., None], 2) + 1, 2)
                by_word = np.zeros((len(ids), k))
                np.add.at(by_word, back.ravel(), err.reshape(-1, k))
                grad = np.stack([np.bincount(used, by_word[of_word, c], len(w)) for c in range(k)], 1)
                grad = grad / len(part) - 1e-5 * w
                g_w += grad**2
                w += 0.3 * grad / np.sqrt(g_w)
                pair = alpha[:, :-1, :, None] * move * (emit * beta)[:, 1:, None, :]
                pair /= pair.sum((2, 3), keepdims=True)
                seen = np.bincount((y[:, :-1] * k + y[:, 1:]).ravel(), minlength=k * k).reshape(k, k)
                grad = (seen - pair.sum((0, 1))) / len(part) - 1e-3 * tr
                g_t += grad**2
                tr += 0.1 * grad / np.sqrt(g_t)
        self.weights, self.transitions = w.astype(np.float32), tr.astype(np.float32)
        return self


def train(docs: DataFrame, docs_per_language: int = 80) -> Crf:
    """A field fitted on a bounded sample of labelled rows: whole texts of at most docs_per_language for each language."""
    rows = docs.filter(F.col("lang").isNotNull() & (F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)).select("lang", "text", F.xxhash64(F.lit(7), "doc_id", "text").alias("h"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language
    if not counts:
        return Crf([])
    # a bound on the hash that about twice as many rows pass; fewer than wanted do with a chance below e^-20
    bound = {x: min(1.0, 2 * docs_per_language / n) for x, n in counts.items()}
    passed = F.col("h") <= F.element_at(F.create_map(*[F.lit(v) for x, b in bound.items() for v in (x, min(2**63 - 1, int(-(2**63) + b * 2**64)))]), F.col("lang"))
    first = Window.partitionBy("lang").orderBy("h", "text")
    sample = rows.filter(passed).withColumn("n", F.row_number().over(first)).filter(F.col("n") <= docs_per_language).select("lang", "text").collect()
    sample = sorted((r["text"], r["lang"]) for r in sample)
    labels = sorted({lang for _, lang in sample})
    return Crf(labels).fit(sample)


def label(text: Column, model: Crf, spark: SparkSession) -> Column:
    """struct(lang_pred, score) of a text; the model's size is 2**BITS weights a language, whatever the data."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def labelled(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        crf = sent.value
        for b in batches:
            b = b.fillna("")
            parts = [_best(crf, part.tolist()) for _, part in b.groupby((b.str.len().cumsum() // 1_500_000).to_numpy(), sort=False)]
            yield pd.concat(parts, ignore_index=True) if parts else _best(crf, [])

    return labelled(text)


def _best(crf: Crf, batch: list[str]) -> pd.DataFrame:
    if not crf.labels:
        return pd.DataFrame({"lang_pred": [UND] * len(batch), "score": [0.0] * len(batch)})
    total, words = crf.posteriors([t.split() for t in batch])
    best = total.argmax(1)
    score = np.clip(total[np.arange(len(batch)), best] / np.maximum(words, 1), 0, 1)
    return pd.DataFrame({"lang_pred": [crf.labels[i] if n else UND for i, n in zip(best, words, strict=True)], "score": np.where(words > 0, score, 0.0)})


def predict_languages(docs: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score; the field is learned from the rows outside the held-out fold."""
    fold = fold_of(F.col("doc_id"), folds)
    model = train(docs.filter(fold != held_out))
    out = texts(docs).withColumn("found", label(F.col("text"), model, docs.sparkSession))
    return out.select("doc_id", (fold == held_out).alias("held_out"), "found.lang_pred", "found.score")


def drop_unidentified(docs: DataFrame, least: float = 0.4, folds: int = 3, held_out: int = 1) -> DataFrame:
    """docs less those that are `und` or whose score is under least."""
    model = train(docs.filter(fold_of(F.col("doc_id"), folds) != held_out))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), label(F.col("text"), model, docs.sparkSession).alias("found"))
    kept = packed.filter((F.col("found.lang_pred") != UND) & (F.col("found.score") >= least))
    return kept.select(*[F.col(f"row.`{c}`") for c in docs.columns])
