"""Toxicity by weak supervision: many voters, a generative label model, and a linear classifier on its posterior labels.

Voters: each entry of a lexicon of insults (a fixed list), and words and word beginnings that stand out in labelled toxic rows; each
fires or not on a text. In how many labelled rows, and toxic ones, a word or beginning occurs is counted over all of them; one stands out if its share of toxic rows is too high for chance over all that were tried, and surely high in itself. The label
model takes the voters as conditionally independent but for correlated pairs; a voter that doesn't fire abstains. Its accuracies come from the voters' second moments over all
training texts by triplets (cov_ij cov_ik / cov_jk holds one voter's own strength) and from the labels of all labelled rows they fired on, its class balance from the training labels. What a pair covaries
beyond that is a correlation, by which the pair's evidence is discounted. The posterior labels that the votes give training rows, labelled or not, then fit a logistic regression on the
presence of the words and beginnings that stand out; it alone scores documents.

Of the texts only those are dealt out whose ids may be labelled, by a filter of bits; the join with the labels, which grow with the documents, never broadcasts. Texts are reduced in tasks to the numbers of the voters and features they hold. The driver sees sums, the names that stand out, and for the regression at most about sample_rows rows of such numbers, drawn by a hash
threshold from the rows that hold any, each standing for as many; rows without any are one row of their number. Only that sample is bounded.

Defined results: null texts count as empty, and get the score of a text without any feature. Without labelled rows, the lexicon alone votes, each voter with a
default accuracy. Rows that repeat are scored, and counted, each. A doc_id that labels names twice counts as toxic if any row says so. Equal texts get equal scores. Only doc_id, text and the labels of training rows are
read, whatever other columns there are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Filter, checkpointed, fold_of, texts

#: A lexicon of insults.
LEXICON = ("bastard", "clown", "disgusting", "dumb", "fool", "freak", "idiot", "idiotic", "imbecile", "jerk", "loser", "moron", "pathetic", "pig", "scum", "stupid", "trash", "vermin", "worthless")
BEGINNINGS, CHANCE, SURE, LIKELY = (3, 4, 5, 6, 7), 0.01, 0.05, 0.7
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    """The distinct words of a text, in lower case: its runs of letters."""
    return set(_LETTERS.findall(text.lower()))


def names_of(word: str) -> list[str]:
    """The features of a word: itself and its beginnings."""
    return ["w:" + word, *(f"b:{word[:k]}" for k in BEGINNINGS if len(word) >= k)]


def stand_out(counts: DataFrame, pi: float, chance: float = CHANCE) -> DataFrame:
    """feature, share and toxic of those whose share of toxic rows is above pi beyond chance over all features tried together, and above LIKELY for itself; counts: feature, toxic and every.

    The bound on a binomial tail, exp(-n KL(share || p)), is held against chance / (number of features) for p = pi, and against SURE for p = LIKELY.
    """
    q = F.least(F.col("toxic") / F.col("every"), F.lit(1 - 1e-9))
    bound = lambda p: F.col("every") * (q * F.log(q / p) + (1 - q) * F.log((1 - q) / (1 - p)))
    sure = (bound(pi) >= math.log(max(counts.count(), 1) / chance)) & (bound(LIKELY) >= -math.log(SURE))
    return counts.filter((q > LIKELY) & sure).select("feature", (F.col("toxic") / F.col("every")).alias("share"), "toxic")


def patterns(found: list[tuple[str, float, int]]) -> list[str]:
    """Of (feature, share, toxic rows) the ones that say something new, best first: a beginning that only says what a chosen one says is left out."""
    chosen: list[str] = []
    ends: dict[str, bool] = {}  # whether a chosen one is this, or begins so
    for f, _, _ in sorted(found, key=lambda x: (-x[1] * x[2], x[0])):
        word = f[2:]
        if word not in ends and not any(ends.get(word[:k]) for k in range(1, len(word))):
            chosen.append(f)
            ends |= {word[:k]: ends.get(word[:k], False) for k in range(1, len(word))}
            ends[word] = True
    return chosen


class LabelModel:
    """Accuracies and correlations of voters, and the posterior of a text's label from its votes.

    A voter that doesn't fire abstains; that no voter fires at all is a vote as well.
    """

    def __init__(self, n: int, sums: np.ndarray, pairs: np.ndarray, balance: float, fired: np.ndarray, toxic: np.ndarray, silent: tuple[float, float] = (0, 0)) -> None:
        """n texts, on which voter i fired sums[i] times and i and j together pairs[i, j] times; on how many labelled and toxic rows each fired; labelled and toxic rows on which none did."""
        k, self.balance = len(sums), balance
        mean = sums / max(n, 1)
        cov = pairs / max(n, 1) - np.outer(mean, mean)
        spread = balance * (1 - balance)
        strength = np.full(k, np.nan)
        for i in range(k):
            j, m = np.triu_indices(k, 1)
            on = (j != i) & (m != i) & (cov[j, m] > 1e-9) & (cov[i, j] > 0) & (cov[i, m] > 0)
            if on.sum() >= 3:
                strength[i] = np.sqrt(np.median(cov[i, j[on]] * cov[i, m[on]] / cov[j[on], m[on]]) / spread)
        # P(toxic | voter fired): what the triplets say, and what labelled rows say; each is a guess of its own
        seen = (toxic + 2 * balance) / (fired + 2)
        told = np.clip(balance * (mean + (1 - balance) * strength) / np.maximum(mean, 1e-12), 0.02, 0.98)
        sure = np.where(np.isnan(told), np.where(fired > 0, seen, 0.9), (told * 20 + seen * fired) / (20 + fired))
        self.accuracy = np.clip(sure, 0.01, 0.98)
        self.silent = (silent[1] + 4 * balance * 0.1) / (silent[0] + 4)
        delta = np.nan_to_num(strength)
        beyond = cov - spread * np.outer(delta, delta)
        sd = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
        self.correlation = np.clip(beyond / np.outer(sd, sd), 0, 1) * (1 - np.eye(k))
        self.correlation[self.correlation < 0.1] = 0

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic) for rows of 0/1 votes; a vote counts for less beside fired voters that it is correlated with."""
        votes = votes.astype(np.float64)
        share = votes / (1 + votes @ self.correlation)
        prior = np.log(self.balance / (1 - self.balance))
        logit = prior + share @ (np.log(self.accuracy / (1 - self.accuracy)) - prior)
        logit = np.where(votes.any(1), logit, np.log(self.silent / (1 - self.silent)))
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit_linear(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, weight: np.ndarray, d: int, steps: int = 300, l2: float = 2e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels; (rows, cols) are the places of ones. Gradient descent by AdaGrad."""
    w, b, g_w, g_b = np.zeros(d), 0.0, np.full(d, 1e-8), 1e-8
    weight = weight / max(weight.sum(), 1e-9)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, w[cols], len(y)) + b, -30, 30)))
        err = weight * (p - y)
        grad = np.bincount(cols, err[rows], d) + l2 * w / max(1, len(y)) ** 0.5
        g_w += grad**2
        g_b += err.sum() ** 2
        w -= 0.5 * grad / np.sqrt(g_w)
        b -= 0.5 * err.sum() / np.sqrt(g_b)
    return w, b


class Finder:
    """The numbers of known features in a text."""

    def __init__(self, place: dict[str, int]) -> None:
        self.place, self._of_token = place, {}

    def __getstate__(self) -> dict:
        return {"place": self.place}

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["place"])

    def find(self, text: str) -> list[int]:
        known, place = self._of_token, self.place
        if len(known) > 200_000:
            known.clear()
        tokens = set(text.lower().split())
        for t in tokens.difference(known):
            known[t] = tuple({place[n] for w in _LETTERS.findall(t) for n in names_of(w) if n in place})
        return sorted({i for t in tokens for i in known[t]})


class Scorer:
    """A linear classifier on the presence of words and word beginnings."""

    def __init__(self, finder: Finder, weights: np.ndarray, bias: float) -> None:
        self.finder, self.weights, self.bias = finder, weights, bias

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[self.finder.find(text)].sum(), -30, 30))))


def _feature_rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """feature, toxic, every: in how many toxic and labelled rows each occurs, summed for about a million features at a time."""
    toxic, every = Counter(), Counter()
    of_token: dict[str, tuple[str, ...]] = {}

    def out() -> pd.DataFrame:
        rows = pd.DataFrame({"feature": pd.Series(list(every), dtype="object"), "toxic": [toxic[f] for f in every], "every": list(every.values())}).astype({"toxic": "int64", "every": "int64"})
        toxic.clear()
        every.clear()
        return rows

    for b in batches:
        for text, y in zip(b["text"], b["toxic"], strict=True):
            tokens = set(text.lower().split())
            if len(of_token) > 100_000:
                of_token.clear()
            for t in tokens.difference(of_token):
                of_token[t] = tuple(n for w in _LETTERS.findall(t) for n in names_of(w))
            found = {n for t in tokens for n in of_token[t]}
            every.update(found)
            if y:
                toxic.update(found)
            if len(every) > 250_000:
                yield out()
    yield out()


def labelled(base: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows of base whose doc_id may be in marks: all that are, and about one in a hundred others."""
    sent = base.sparkSession.sparkContext.broadcast(Filter(marks.select(F.xxhash64("doc_id").alias("key"))))

    @F.pandas_udf("boolean")
    def may_be(key: pd.Series) -> pd.Series:
        return pd.Series(sent.value.has(key.to_numpy(np.int64)))

    return base.filter(may_be(F.xxhash64("doc_id")))


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, sample_rows: int = 6000) -> Scorer:
    """A scorer learned from the rows outside the held-out fold."""
    spark = docs.sparkSession
    base = texts(docs).filter(fold_of(F.col("doc_id"), folds) != held_out)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isNotNull() & (fold_of(F.col("doc_id"), folds) != held_out))
    marks = checkpointed(marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    rows = dict(base.select("doc_id").join(marks, "doc_id").groupBy("toxic").count().collect())  # at most a row a label
    rows = {0: sum(n for y, n in rows.items() if not y), 1: sum(n for y, n in rows.items() if y)}
    pi = min(0.5, max(0.005, (rows[1] + 1) / (rows[0] + rows[1] + 20)))

    counts = labelled(base, marks).join(marks.hint("merge"), "doc_id").select("text", "toxic").mapInPandas(_feature_rows, "feature string, toxic long, every long")
    counts = checkpointed(counts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("every").alias("every")).filter("toxic > 0"))
    found = [tuple(r) for r in stand_out(counts, pi).collect()]  # as many as are significant
    entries = ["w:" + w for w in LEXICON]
    voters = entries + [f for f in patterns(found) if f[2:] not in LEXICON]
    place = {f: i for i, f in enumerate([*voters, *sorted({f for f, _, _ in found}.difference(voters))])}
    k, finder = len(voters), Finder(place)
    sent = spark.sparkContext.broadcast(finder)

    def held_rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [sent.value.find(t) for t in b["text"]]
            keep = np.array([bool(x) for x in got], bool)
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[keep], "h": b["h"].to_numpy()[keep], "held": pd.Series([x for x in got if x], dtype="object")}).astype({"doc_id": "Int64"})

    order = F.xxhash64(F.lit(11), "doc_id", "text")
    held = checkpointed(base.withColumn("h", order).mapInPandas(held_rows, "doc_id long, h long, held array<int>"))
    n, n_held = base.count(), held.count()

    def moments(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = np.zeros((k, k), np.int64)
        for b in batches:
            for x in b["held"]:
                fired = x[x < k]
                pairs[np.ix_(fired, fired)] += 1
        i, j = np.nonzero(pairs)
        yield pd.DataFrame({"i": i, "j": j, "n": pairs[i, j]})

    pairs = np.zeros((k, k))
    for r in held.select("held").mapInPandas(moments, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():  # voters squared at most
        pairs[r["i"], r["j"]] = r["n"]
    fired, toxic, any_of = np.zeros(k), np.zeros(k), {0: 0, 1: 0}
    votes = held.select("doc_id", F.filter("held", lambda i: i < k).alias("v")).filter(F.size("v") > 0).join(marks, "doc_id").select((F.col("toxic") > 0).cast("int").alias("toxic"), F.explode(F.concat("v", F.array(F.lit(-1)))).alias("i"))
    for r in votes.groupBy("i", "toxic").count().collect():
        if r["i"] < 0:
            any_of[r["toxic"]] = r["count"]
        else:
            fired[r["i"]] += r["count"]
            toxic[r["i"]] += r["toxic"] * r["count"]
    silent = rows[0] + rows[1] - any_of[0] - any_of[1], rows[1] - any_of[1]
    model = LabelModel(n, pairs.diagonal().copy(), pairs, pi, fired, toxic, silent)

    share = min(1.0, sample_rows / max(n_held, 1))
    sample = held.filter(F.col("h") <= F.lit(min(2**63 - 1, int(-(2**63) + share * 2**64)))).select("h", "held").toPandas().sort_values("h") if n_held else pd.DataFrame({"held": []})
    sets = [np.asarray(x, np.int64) for x in sample["held"]]
    sets += [np.array([i]) for i in range(len(entries))] + [np.zeros(0, np.int64)]  # what a lone entry of the lexicon says, and rows that hold nothing
    weight = np.array([1 / share] * len(sample) + [1.0] * len(entries) + [float(n - n_held) + 1])
    r, c = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)
    fires = np.zeros((len(sets), k), bool)
    fires[r[c < k], c[c < k]] = True
    w, b = fit_linear(r, c, model.posterior(fires), weight, len(place))
    return Scorer(finder, w, float(b))


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, cut: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, folds, held_out))  # a weight for each feature that stands out

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([model.value.score(t) for t in b], dtype="float64")

    out = texts(docs).select("doc_id", (fold_of(F.col("doc_id"), folds) == held_out).alias("held_out"), scored("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))
