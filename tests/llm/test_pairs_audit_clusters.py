"""The pair-index encoder against its library, the audit of filters and the clustering against brute force; and their odd rows."""

import hashlib
import json
import math
from itertools import permutations

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scriptoria.llm import bpe, drift_clusters, filter_audit, pair_bpe

MODEL = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_tokens string, ids string, failed string, h string, part string, of string, at string"
ODD = [(1, "The cat sat on the mat"), (2, None), (3, ""), (None, "ñandú 漢字  \n\t x"), (4, "it's <|endoftext|> he'll say\n  12"), (1, "The cat sat on the mat"), (5, "x" * 70_000), (6, "word " * 9000), (7, "\U00010940 ՘ \U000105c0　!"), (None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, *[None] * 9) for r in ODD], DOCS)


# 11
@pytest.fixture(scope="module")
def raw():
    with open(MODEL, encoding="utf-8") as f:
        return f.read()


@pytest.fixture(scope="module")
def pairs(raw):
    return pair_bpe.PairBpe(raw, public_tokenizers.PATTERN)


def numbers(ids):
    return np.frombuffer(ids, "<u4").tolist()


def test_encoding_against_the_library(pairs):
    library, rng = Tokenizer.from_file(MODEL), np.random.default_rng(5)
    letters = [*"abcdefghst ABC  \n\t'!?.,0123é漢字かñ 　́՘\U00010940\U000105c0🎉\r\x1c\x85", "<|endoftext|>", "'s", "<|", "|>"]
    held = ["".join(rng.choice(letters, rng.integers(0, 70))) for _ in range(6000)] + [t or "" for _, t in ODD]
    want = [e.ids for e in library.encode_batch(held, add_special_tokens=False)]
    got = [x for k in range(0, len(held), 512) for x in pairs.encode(held[k : k + 512])]
    assert [numbers(x) for x in got] == want
    assert all(pairs.decode(x).decode("utf-8", "replace") == library.decode(w, skip_special_tokens=False) for x, w in zip(got, want, strict=True))


def plain_merges(rules, piece):
    """Ids of single bytes, merged by the lowest rank, then from the left, until none is left."""
    rank = {(a, b): (r, new) for r, (a, b, new) in enumerate(rules)}
    piece = list(piece)
    while True:
        best = min(((*rank[p], i) for i, p in enumerate(zip(piece, piece[1:], strict=False)) if p in rank), key=lambda x: (x[0], x[2]), default=None)
        if best is None:
            return piece
        piece[best[2] : best[2] + 2] = [best[1]]


@pytest.mark.parametrize("rising", [True, False])
def test_index_against_plain_merges(rising):
    """Also by a file in which merges make pairs of lower ranks than their own."""
    names = {b: c for c, b in pair_bpe.byte_names().items()}
    rng = np.random.default_rng(2)
    tokens, merges = ["a", "b", "c"], []
    while len(merges) < 30:
        left, right = rng.choice(tokens, 2)
        if left + right not in tokens and len(left + right) < 7:
            tokens.append(left + right)
            merges.append([str(left), str(right)])
    if not rising:
        merges.reverse()
    vocab = {c: i for i, c in enumerate([*names.values(), *tokens[3:]])}
    own = pair_bpe.PairBpe(json.dumps({"model": {"vocab": vocab, "merges": merges}}), r"[^ ]+| +")
    assert own.rising is rising
    pieces = ["".join(rng.choice(list("abc"), rng.integers(1, 40))).encode() for _ in range(400)]
    assert [numbers(x) for x in own.merge(pieces)] == [plain_merges(own.rules, own.byte[list(p)].tolist()) for p in pieces]


def test_white_space_that_evens_out(pairs):
    """A word of other white space and a word with one inside are together as many words as without them."""
    t = "a\n  b c d"
    assert numbers(pairs.encode([t])[0]) == Tokenizer.from_file(MODEL).encode(t, add_special_tokens=False).ids
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = bpe.read_ranks(f.read())
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert numbers(bpe.Bpe(ranks, public_tokenizers.PATTERN).encode([t])[0]) == library.encode_ordinary(t)


def test_digests_of_odd_rows(odd, raw):
    library = Tokenizer.from_file(MODEL)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = sorted((str(i), len(ids), sha(",".join(map(str, ids))), sha(t or "")) for i, t in ODD for ids in [library.encode(t or "", add_special_tokens=False).ids])
    out = pair_bpe.token_digests(odd, MODEL, public_tokenizers.PATTERN)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted((str(r[0]), *r[1:]) for r in out.collect()) == want
    assert pair_bpe.token_digests(odd.limit(0), MODEL, public_tokenizers.PATTERN).count() == 0
    rows = pair_bpe.encode_documents(odd, MODEL, public_tokenizers.PATTERN, carried=("ids", "n_tokens", "lang")).collect()
    assert sorted((str(r["doc_id"]), r["ids"]) for r in rows) == sorted((str(i), library.encode(t or "", add_special_tokens=False).ids) for i, t in ODD)
    assert all(r["carried"].asDict() == {"ids": None, "n_tokens": None, "lang": None} for r in rows)


@pytest.mark.parametrize("change", [{"normalizer": {"type": "Lowercase"}}, {"model": {"dropout": 0.1}}, {"added_tokens": [{"id": 1, "content": "x", "lstrip": True}]}])
def test_other_files_are_refused(raw, change):
    file = json.loads(raw)
    file["model"] |= change.pop("model", {})
    with pytest.raises(ValueError, match="not supported"):
        pair_bpe.PairBpe(json.dumps(file | change), public_tokenizers.PATTERN)


# 12
def brute_audit(docs, labels):
    """Every order applied to every document, one filter after another."""
    import re

    good, toxic = ({i for i, *m in labels if i is not None and m[k] == 1} for k in (0, 1))
    held = []
    for i, text, part in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        e = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        fails = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)), e]
        held.append((i, part or "", {f for f, x in zip("ABCDE", fails, strict=True) if x}))
    out, shapley = {}, {}
    for part in {p for _, p, _ in held}:
        for order in map("".join, permutations("ABCDE")):
            left, gone = [h for h in held if h[1] == part], []
            for k, f in enumerate(order):
                here = [h for h in left if f in h[2]]
                left = [h for h in left if f not in h[2]]
                out[part, order, k + 1] = [len(left), len(here), sum(f in h[2] for h in gone), sum(h[2] == {f} for h in held if h[1] == part), sum(h[0] in good for h in here), sum(h[0] in toxic for h in here)]
                gone += here
                shapley[part, f] = shapley.get((part, f), 0) + len(here)
    return {k: [*v, shapley[k[0], k[1][k[2] - 1]]] for k, v in out.items()}


def audited(spark, docs, labels):
    d = spark.createDataFrame([(i, t, p, *[None] * 8) for i, t, p in docs], DOCS)
    m = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({"part": F.lit("z"), "n": F.lit(9), "failed": F.lit(3)})
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in filter_audit.audit(d, m).collect()}


def test_audit_against_every_order(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(str(x) for x in rng.integers(0, top, n)) + end for top in (40, 10**6) for n in (20, 120) for end in ("", " AB" * 60, " 5%", "\v")]
    docs = [(int(i), texts[int(rng.integers(len(texts)))], ["en", "fr", None][i % 3]) for i in rng.permutation(150)]
    docs += [(None, texts[0], "en"), (None, texts[0], "en"), (3, docs[0][1], "fr"), (3, docs[0][1], "fr"), (900, "", ""), (901, None, "de"), (902, " \t", "de"), (903, "Ab " * 30_000, "de")]
    labels = [(int(i), int(rng.integers(2)), int(rng.integers(2))) for i in range(0, 150, 2)] + [(1, 0, None), (1, 1, 0), (None, 1, 1), (7777, 1, 1)]
    assert audited(spark, docs, labels) == brute_audit(docs, labels)
    assert audited(spark, docs[:0], labels) == {} and audited(spark, docs[:5], labels[:0]) == brute_audit(docs[:5], [])


def test_hot_copies_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "SHARES", 4)
    docs = [(i, "the same text", "en") for i in range(90)] + [(100 + i, f"text {i}", "en") for i in range(60)] + [(200 + i, "text 1", "fr") for i in range(4)]
    assert audited(spark, docs, []) == brute_audit(docs, [])


# 13
def brute_clusters(rows, k, rounds, seed):
    """(vec_id, cluster, squared distance) and centroids, every distance of every round in Python's whole numbers."""
    held = [(i, [math.floor(x) * 256 if abs(x) > 1e300 else math.floor(x * 256) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    at = [v for _, v in sorted(held, key=order)[:k]]
    for r in range(rounds + 1):
        near = [min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), n) for n, c in enumerate(at)) for _, v in held]
        if r == rounds:
            return [(i, n, d) for (i, _), (d, n) in zip(held, near, strict=True)], at
        for n in range(len(at)):
            own = [v for (_, v), (_, m) in zip(held, near, strict=True) if m == n]
            at[n] = [sum(x) // len(own) for x in zip(*own, strict=True)] if own else at[n]


VECTORS = "vec_id long, embedding array<double>, label int, cluster string, x string, v string"


def check(spark, rows, k, rounds=5, seed=2):
    want, at = brute_clusters(rows, k, rounds, seed)
    got = drift_clusters.clustered(spark.createDataFrame([(i, v, *[None] * 4) for i, v in rows], VECTORS).repartition(3), k, rounds, seed).collect()
    key = lambda r: tuple(map(str, r))
    fits = lambda n: n if n < 1 << 63 else None
    assert sorted(map(key, ((r["vec_id"], r["cluster"], r["distance"]) for r in got))) == sorted(map(key, ((i, n, fits(d)) for i, n, d in want)))
    sums = {n: sum(d for _, m, d in want if m == n) for _, n, _ in want}
    for r in got:
        assert r["cluster_inertia"] == fits(sums[r["cluster"]]) and r["inertia"] == fits(sum(sums.values()))
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, at[r["cluster"]])).encode()).hexdigest()
    return got


def test_clusters_against_all_distances(spark):
    rng = np.random.default_rng(9)
    middle = rng.normal(0, 2, (9, 64))
    rows = [(i, (middle[i % 9] + rng.normal(0, 0.4, 64)).tolist()) for i in range(400)]
    rows += [(i, rows[5][1]) for i in range(400, 430)] + [rows[7]] * 5 + [(500, None), (501, []), (502, [1.0] * 63), (503, [math.nan] * 64), (504, [None] + [1.0] * 63), (505, [math.inf] * 64), (None, [0.5] * 64), (506, [-0.001] * 64)]
    assert len(check(spark, rows, 12)) == 437
    check(spark, rows[:30], 40)
    check(spark, [(i, [float(i % 3)] * 64) for i in range(60)], 7)  # ties, empty clusters
    check(spark, rows[:50], 1)
    empty = drift_clusters.clustered(spark.createDataFrame([(1, None, None, None, None, None)], VECTORS))
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("size", [1e5, 1e9, 1e38, 1e306])
def test_large_components_are_exact(spark, size):
    rng = np.random.default_rng(11)
    rows = [(i, (rng.normal(0, size if i % 7 == 0 else 1, 64)).tolist()) for i in range(90)]
    check(spark, rows, 6, rounds=2)


def test_falls_bound_every_point_of_the_spheres():
    """No point of a sphere comes nearer to a moved centroid than the bound says, and bounds stay within the full drift."""
    rng = np.random.default_rng(12)
    for d in (2, 3, 64):
        for _ in range(40):
            old = rng.normal(0, 10, (5, d))
            new, reach = old + rng.normal(0, rng.choice([0.01, 1, 8]), (5, d)), rng.random(5) * 12
            bound, drift = drift_clusters.falls(old, new, reach), np.sqrt(((new - old) ** 2).sum(1))
            assert (bound <= drift * (1 + 1e-6)).all() and (bound < drift * 0.9).any()
            for i in range(5):
                way = rng.normal(size=(400, d))
                points = old[i] + way / np.linalg.norm(way, axis=1, keepdims=True) * reach[i] * rng.random((400, 1)) ** (1 / d)
                fall = np.linalg.norm(points[:, None] - old, axis=2) - np.linalg.norm(points[:, None] - new, axis=2)
                assert (fall.max(0) <= bound[i] + 1e-9).all()


def test_geometry_leaves_fewer_vectors_to_scan(spark, monkeypatch):
    """Rows that are scanned in all: fewer by the bounds than by full drifts, and fewer than all rows each round."""
    rng = np.random.default_rng(13)
    middle = rng.normal(0, 3, (12, 64))
    x = [(i, (middle[i % 12] + rng.normal(0, 1.0, 64)).tolist()) for i in range(3000)]
    given = [(i, drift_clusters._packed([v])[0], -1, math.inf, -math.inf) for i, v in x]
    seen, plain_scan = [], drift_clusters.Centroids.scan
    monkeypatch.setattr(drift_clusters.Centroids, "scan", lambda self, rows: (seen.append(len(rows)), plain_scan(self, rows))[1])

    def scanned(full):
        import pandas as pd

        seen.clear()
        at = drift_clusters.Centroids([[drift_clusters.whole(v) for v in x[i][1]] for i in range(40)])
        b = drift_clusters._assigned(pd.DataFrame(given, columns=["vec_id", "x", "cluster", "upper", "lower"]), at)
        for _ in range(5):
            own, v = b["cluster"].to_numpy(), np.array([np.frombuffer(r, "<i4") for r in b["x"]]).astype(int)
            exact = [np.floor_divide(v[own == k].sum(0), max(1, (own == k).sum())).tolist() if (own == k).any() else at.exact[k] for k in range(40)]
            reach = np.array([b["upper"][own == k].max() if (own == k).any() else 0 for k in range(40)])
            drift = np.sqrt(((np.array(exact) - at.flat) ** 2).sum(1))
            at = at.moved(exact, reach)
            if full:
                at.loosen = np.array([np.delete(drift, k).max() for k in range(40)])
            b = drift_clusters._assigned(b, at)
        return sum(seen), b["cluster"].tolist()

    (by_geometry, a), (by_drift, b) = scanned(False), scanned(True)
    assert a == b and by_geometry < by_drift < 6 * 3000


# 5
def test_an_id_with_several_vectors_and_components_of_any_size(spark):
    """Vectors of the query's own id leave the places to others, though they are nearest and many; squares beyond doubles change nothing."""
    rng = np.random.default_rng(14)
    middle = rng.normal(size=16)
    rows = [(50, (middle + rng.normal(0, 1e-4, 16)).tolist()) for _ in range(190)] + [(i, (middle + rng.normal(0, 0.3, 16)).tolist()) for i in range(1, 40)] + [(100, rows_of) for rows_of in [(middle * 2).tolist()]]
    rows += [(7, (middle * 4).tolist()), (50, (middle * 4).tolist())]
    from scriptoria.llm import ann

    def nearest_by_all(rows):
        unit = lambda v: [float(x) for x in (np.array(v, np.longdouble) / np.sqrt((np.array(v, np.longdouble) ** 2).sum()))]
        held = sorted({(i, *v) for i, v in rows})
        units, out = [np.array(unit(v)) for _, *v in held], []
        for (i, *_), u in zip(held, units, strict=True):
            if i % 50 == 0:
                found = sorted((-round(float(u @ w), 12), j) for (j, *_), w in zip(held, units, strict=True) if j != i)
                out += [(i, k + 1, j) for k, (_, j) in enumerate(found[:5])]
        return sorted(out)

    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 5 * (191 + 1)  # each of the id's vectors is a query
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == nearest_by_all(rows)
    large = [(50, [1e200, 1e-200, 0.0]), (1, [-1.0, 0.0, 0.0]), (2, [1e-200, 1e-200, 0.0]), (3, [0.0, 5e-324, 0.0]), (4, [1e308, 1e308, 1e308])]
    got = [(r["vec_id"], r["score"]) for r in ann.nearest(spark.createDataFrame(large, "vec_id long, embedding array<double>")).orderBy("rank").collect()]
    assert [i for i, _ in got] == [2, 4, 3, 1]
    assert np.allclose([s for _, s in got], [2**-0.5, 3**-0.5, 0, -1])


# 8
def test_a_text_of_many_pairs_is_paired_by_classes(spark, monkeypatch):
    """Five thousand addresses beside five thousand rare words: pairs of classes, not of members; and cells change nothing."""
    import time

    from scriptoria.llm import pii

    letters = "abcdefghijklmnopqrst"
    word = lambda k: "".join(letters[k // 20**j % 20] for j in range(4)) + "ux"
    rng = np.random.default_rng(17)
    docs = [(0, " ".join(f"u{k}@x.org {word(k)}" for k in range(5000)))]
    docs += [(i, " ".join([f"u{k}@x.org" for k in rng.integers(0, 40, 2)] + [word(int(k)) for k in rng.integers(0, 9000, 6)] + [f"common{i % 3}"])) for i in range(1, 400)]
    docs += [(1000 + i, f"plain text {word(i)}") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    start = time.perf_counter()
    got = {r["term"]: r["share"] for r in pii.disclosing(df).collect()}
    assert time.perf_counter() - start < 60
    # all pairs, counted
    from collections import Counter

    n_t, n_c, n_tc = Counter(), Counter(), Counter()
    for _, t in docs:
        spans = pii.base_spans(t)
        own = {pii.entity_of(t, *x) for x in spans}
        terms = {pii._hash(t[s:e].lower()) for s, e in pii.words_outside(t, spans)}
        every = {pii._hash(w.lower()) for x in t.split() for w in pii._WORD.findall(x) if len(w) >= 3}
        n_c.update(own)
        n_t.update(every)
        if len(own) < 100:
            n_tc.update((w, c) for w in terms for c in own)
        else:
            big = (terms, own)
    total, want = len(docs), {}
    for w in {w for w, _ in n_tc} | big[0]:
        best = 0.0
        for c in n_c:
            k = n_tc.get((w, c), 0) + (w in big[0] and c in big[1])
            if k:
                m = max(n_t[w], k) * n_c[c] / total
                if k > m and k * math.log(k / m) - k + m >= -math.log(pii.CHANCE):
                    best = max(best, math.log(k / m) / math.log((total + 1) / n_c[c]))
        if best >= pii.DISCLOSURE:
            want[w] = best
        if len(want) > 300:
            break
    assert want and all(abs(got[w] - v) < 1e-9 for w, v in want.items())
    monkeypatch.setattr(pii, "CELL", 7)
    again = {r["term"]: r["share"] for r in pii.disclosing(df).collect()}
    assert again.keys() == got.keys() and all(abs(again[w] - got[w]) < 1e-12 for w in got)


def test_digests_in_the_scan_are_those_of_the_sanitised_texts(spark):
    from scriptoria.llm import pii

    docs = [(i, f"Ann{i % 7} writes from ann{i % 7}@x.org about topic{i}, call +44 20 7946 00{i % 90 + 10:02}") for i in range(200)] + [(300 + i, f"plain text number {i}") for i in range(200)] + [(None, None), (500, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted(sha(r["text"]) for r in pii.sanitise(df).collect())
    assert sorted(r["sanitised_sha256"] for r in pii.span_digests(df).collect()) == want
    assert len(set(want) & {sha(t or "") for _, t in docs}) < len(docs)
    few = pii.find_personal_data(df, most_terms=0, digest=True)
    assert sorted(r["sha256"] for r in few.collect()) == want and few.filter("text IS NOT NULL").count() == 0


# 6
def test_tables_of_numbers():
    """Known and unknown numbers, also where many share their first bits, against a dictionary."""
    from scriptoria.llm.suffix_tree_lm import Table

    rng = np.random.default_rng(18)
    for n in (0, 1, 5, 3000):
        keys = np.unique(np.concatenate([rng.integers(-(1 << 63), 1 << 63, n, np.int64), np.arange(n // 3) + (5 << 50), [-(1 << 63)] * (n > 1)]).astype(np.int64))
        rng.shuffle(keys)
        asked = np.concatenate([keys, rng.integers(-(1 << 63), 1 << 63, 500, np.int64), np.arange(n) + (5 << 50)]).astype(np.int64)
        place = {k: i for i, k in enumerate(keys.tolist())}
        assert Table(keys).places(asked).tolist() == [place.get(k, -1) for k in asked.tolist()]


def test_pairs_that_may_be_frequent(spark):
    """No pair that occurs often enough is missing, wherever its occurrences are, and most others are."""
    from collections import Counter

    from scriptoria.llm import suffix_tree_lm as lm

    rng = np.random.default_rng(19)
    docs = [(i, " ".join(f"w{x}" for x in rng.zipf(1.3, 60) % 3000)) for i in range(500)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    may, seen = lm._often(df, 4), Counter()
    for _, t in docs:
        number = lm.tokens_of([t])[0]
        seen.update(lm._entry(number[:-1], number[1:]).tolist())
    keys = np.array(list(seen), np.int64)
    often = np.array([seen[k] >= 4 for k in keys.tolist()])
    assert may.has(keys[often]).all() and may.has(keys[~often]).mean() < 0.2 and often.sum() > 100
    assert lm._often(df, 1) is None and lm._often(df.limit(0), 4).has(keys).sum() == 0


@pytest.mark.parametrize("runs", [None, False, True])
def test_tasks_hold_a_block_about_once(spark, monkeypatch, runs):
    """What a task that counts holds at most is a few arrays of a block's tokens, and what it sends on comes some rows at a time: pairs of words (None), contexts in texts and in runs."""
    import gc
    import tracemalloc

    from scriptoria.llm import suffix_tree_lm as lm

    class Source:
        """Keeps the function that a task would run."""

        columns = ["run" if runs else "text"]
        sparkSession = sparkContext = select = property(lambda self: self)

        def __call__(self, *_):
            return self

        def broadcast(self, x):
            self.value = x
            return self

        def mapInPandas(self, f, _):
            self.task = f
            return self

    class Any:
        def has(self, keys):
            return np.ones(len(keys), bool)

    source, rng = Source(), np.random.default_rng(22)
    monkeypatch.setattr(lm, "checkpointed", lambda df: df)
    monkeypatch.setattr(lm, "_grouped", lambda rows, *_: rows)
    monkeypatch.setattr(lm, "_often", lambda *_: Any())
    lm._counted(source, 5) if runs is None else lm._count_level(source, 4 if runs else 2, Any(), None, 5)
    words = [rng.integers(0, 1 << 40, 2_000) for _ in range(300)]
    n = sum(map(len, words))
    if runs:
        parts = [pd.DataFrame({"run": [np.append(w, lm.STOP) for w in words[k : k + 50]]}) for k in range(0, 300, 50)]
    else:
        parts = [pd.DataFrame({"text": [" ".join(map(str, w)) for w in words[k : k + 10]]}) for k in range(0, 300, 10)]
    gc.collect()
    tracemalloc.start()
    try:
        most, rows = 0, 0
        for x in source.task(iter(parts)):
            most, rows = max(most, len(x)), rows + int(x["c"][x["word"] != lm.ALL].sum())
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows >= 0.99 * n
    assert most <= 1 << 17
    assert peak < (160 if runs else 80) * n


def test_filters_let_few_others_through(spark):
    """Every key of the set is found, and about one in a hundred others at most, also of keys of which only the first 42 digits are set."""
    from scriptoria.llm.common import Filter

    rng = np.random.default_rng(20)
    for shift in (0, 22):
        keys, others = (rng.integers(-(1 << 63), 1 << 63, 20_000, np.int64) >> shift << shift for _ in "ab")
        held = Filter(spark.createDataFrame([(int(k),) for k in keys], "key long"))
        assert held.has(keys).all() and held.has(others).mean() < 0.012


def test_keys_that_no_task_knows_are_looked_up_by_bucket(spark, monkeypatch):
    """Scores are the same whether words and entries of the tree are broadcast or looked up in buckets, for ids beyond 2^53, rows that repeat and null ids as well."""
    from scriptoria.llm import suffix_tree_lm as lm

    rng = np.random.default_rng(21)
    docs = [((1 << 60) + i, " ".join(f"w{x}" for x in rng.zipf(1.5, 50) % 300)) for i in range(150)]
    docs += [docs[0], docs[0], (None, docs[1][1]), (None, None), (7, "never seen")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    key = lambda r: (r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6))
    want = sorted(map(key, lm.score_documents(df, order=3).collect()))
    monkeypatch.setattr(lm, "HEAD", 1)
    monkeypatch.setattr(lm, "HOT", 1)
    assert sorted(map(key, lm.score_documents(df, order=3).collect())) == want and len(want) == len(docs)
    assert any(k[4] > k[3] + 1 for k in want)


# 2
def test_only_texts_that_may_be_labelled_are_dealt_out(spark):
    """Every labelled row is among them, whatever its id, and hardly any other."""
    from scriptoria.llm import toxicity

    base = spark.range(-3000, 3000).select(F.when(F.col("id") != 5, F.col("id")).alias("doc_id"), F.lit("a b").alias("text"))
    marks = spark.range(-9000, 9000, 7).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    got = toxicity.labelled(base, marks)
    want = {i for i in range(-3000, 3000) if (i + 9000) % 7 == 0 and i != 5}
    ids = [r["doc_id"] for r in got.select("doc_id").collect()]
    assert want <= set(ids) and len(ids) < len(want) + 150
    assert toxicity.labelled(base, marks.limit(0)).count() == 0


# 4
def test_words_of_letters_need_no_pattern():
    """A space and letters are cut by no pattern where that makes one piece of them, with the library's ids; with another pattern they are."""
    import regex
    import tiktoken

    letter = regex.compile(r"\p{L}")
    assert all(letter.match(chr(c)) for c in range(0x110000) if chr(c).isalpha())
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = bpe.read_ranks(f.read())
    words = "a it's größe 日本語 naïve x1 ²³ ǅ ſ".split()

    class Asked:
        def __init__(self, pattern):
            self.pattern, self.seen = regex.compile(pattern), []

        def findall(self, t):
            self.seen.append(t)
            return self.pattern.findall(t)

    for pattern, want in ((public_tokenizers.PATTERN, [" it's", " x1", " ²³"]), (r" ?\p{L}|[^\p{L}]+", [" " + w for w in words])):
        own = bpe.Bpe(ranks, pattern)
        own.pattern = Asked(pattern)
        text = " ".join(["first", *words])
        got = own.encode([text])[0]
        assert sorted(x for x in own.pattern.seen if x.startswith(" ")) == sorted(want)
        assert np.frombuffer(got, "<u4").tolist() == tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text)


# 8
def test_words_of_sought_tokens_are_those_of_the_whole_text():
    """Places of words by looking for their tokens are those by reading all words, also at the ends, inside other tokens, in runs and beside spans."""
    import random
    import re

    from scriptoria.llm import pii

    rng = random.Random(22)
    marks = ["a", "b", "É", "ß", "1", "_", "@", ".", " ", " ", "\n", "\u3000", "\x1c", "\x85"]
    texts = ["", "aaa aa aaa", "aaaa", "aa.bbb aa.bbb", *("".join(rng.choices(marks, k=rng.randrange(80))) for _ in range(3000))]
    for text in texts:
        tokens = sorted(set(text.split()))
        sought = rng.sample(tokens, min(len(tokens), rng.randrange(9)))
        reach = [("ip", s, s + rng.randrange(1, 6)) for s in sorted(rng.sample(range(len(text) + 1), min(2, len(text))))]
        every = list(pii.words_outside(text, reach))
        of = {i: m.group() for m in re.finditer(r"\S+", text) for i in range(*m.span())}
        want = [(s, e) for s, e in every if of[s] in sought]
        assert list(pii.words_outside(text, reach, pii.words_of_tokens(text, sought))) == want
