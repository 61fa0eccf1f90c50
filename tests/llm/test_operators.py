"""Each operator against a brute-force form, and on null, empty, long, repeated and clashing rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scriptoria.llm import ann, bpe, exact_dedup, langid, mixing, near_dedup, pii, secrets, suffix_tree_lm, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string"
EDGE = [
    (1, "The cat sat on the mat and looked at the moon", "en", "a", 1, "x", "y"), (2, "the CAT sat on the mat and looked at the moon", "en", "a", 1, "x", "y"), (3, None, None, None, None, None, None),
    (4, "", "en", "b", 0, None, None), (5, " \n\t ", "fr", "b", 3, None, None), (6, "12 34 %%", "fr", "a", 8, None, None), (None, "sans identité connue ici", "fr", "c", 1, None, None),
    (7, "le chat est là " * 3000, "fr", "a", 1, None, None), (8, "x" * 3000, "en", "a", 1, None, None), (1, "The cat sat on the mat and looked at the moon", "en", "a", 1, "x", "y"), (9, "one two", "en", "a", 1, None, None),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


@pytest.fixture(scope="module")
def empty(edge):
    return edge.limit(0)


def fold(i, n):
    return -1 if i is None else zlib.crc32(str(i).encode()) % n


# 1
def earliest_deadline_first(blocks, parts):
    """(phase, source, block in all, slot, release, deadline) slot by slot, each chosen among all released blocks."""
    left, used, at, phase = dict(enumerate(blocks)), Counter(), 0, 0
    left = {i: n for i, n in left.items() if n}
    while left:
        size, own, t = sum(parts[i] for i in left), Counter(), 0
        while all(own[i] < n for i, n in left.items()):
            ready = [(-(-(own[i] + 1) * size // parts[i]), i, own[i] * size // parts[i]) for i in left if own[i] * size // parts[i] <= t]
            due, i, r = min(ready)
            assert due > t
            yield phase, i, used[i], at + t, at + r, at + due
            own[i] += 1
            used[i] += 1
            t += 1
            assert all(abs(own[k] * size - t * parts[k]) < size for k in left)  # under one block
        left = {i: n - own[i] for i, n in left.items() if n > own[i]}
        at, phase = at + t, phase + 1


def test_chunks_against_earliest_deadline_first():
    """Chunks of any length, each from the closed form of what was placed before it, give the one schedule."""
    rng = np.random.default_rng(0)
    for trial in range(40):
        k = int(rng.integers(1, 9))
        blocks = [int(n) for n in rng.integers(0, 150, k)]
        weights = {f"s{i}": float(rng.random() ** 3 + 1e-3) if trial % 2 else float(rng.integers(1, 12)) for i in range(k)}
        parts = list(mixing.parts_of(weights).values())
        want = list(earliest_deadline_first(blocks, parts))
        got, at = [], 0
        for phase, (n, live, before) in enumerate(mixing.phase_list(blocks, parts)):
            step = int(rng.integers(1, 40))
            for start in range(0, n, step):
                for i, j, slot, r, due in mixing.place(start, min(start + step, n), [parts[i] for i in live]):
                    got.append((phase, live[i], before[i] + j, at + slot, at + r, at + due))
            at += n
        assert got == want


@pytest.mark.parametrize(("sources", "slots"), [(7, 40_000), (3000, 6000)])
def test_blocks_keep_to_the_weights_as_given(sources, slots):
    """Over many thousands of slots, and for thousands of sources, the blocks placed are under one block off the weights themselves."""
    rng = np.random.default_rng(3)
    weights = {f"s{i:04}": float(w) for i, w in enumerate(rng.random(sources) ** 3 + 1e-4)}
    share = np.array(list(weights.values())) / sum(weights.values())
    count = np.zeros(sources)
    for i, _, slot, release, deadline in mixing.place(0, slots, list(mixing.parts_of(weights).values())):
        count[i] += 1
        assert release <= slot < deadline
        if slot % 7 == 0:
            assert np.abs(count - share * (slot + 1)).max() < 1 + 1e-6
    assert mixing.placed_before(slots, list(mixing.parts_of(weights).values())) == count.astype(int).tolist()


def test_rows_take_the_slots_of_their_blocks(spark):
    docs = spark.createDataFrame([(i, f"text {i}", ["a", "b", "c"][i % 9 % 3 if i % 9 else 2]) for i in range(3000)], "doc_id long, text string, source string")
    weights = {"a": 0.61803, "b": 0.27183}
    rows = mixing.schedule_rows(docs, weights).collect()
    counts = Counter(r["source"] for r in rows)
    parts = list(mixing.parts_of({**weights, "c": 0.27183}).values())
    want = {("abc"[i], b): (phase, slot, r, due) for phase, i, b, slot, r, due in earliest_deadline_first([-(-counts[s] // 16) for s in "abc"], parts)}
    assert len(rows) == 3000 and len({(r["slot"], r["place"]) for r in rows}) == 3000
    assert all(want[r["source"], r["block"]] == (r["phase"], r["slot"], r["release_slot"], r["deadline_slot"]) for r in rows)
    table = mixing.block_table(docs, {s: -(-n // 16) for s, n in counts.items()}, {**weights, "c": 0.27183}, chunk=10).collect()
    assert {(r["source"], r["block"]): (r["phase"], r["slot"], r["release"], r["deadline"]) for r in table} == want and len(table) == len(want)


def test_mixing_keeps_every_row(edge, empty):
    assert mixing.schedule_rows(edge).count() == len(EDGE)
    out = mixing.mix(edge)
    assert out.columns == edge.columns and sorted(map(str, out.collect())) == sorted(map(str, edge.collect()))
    assert mixing.mix(empty).count() == 0
    clash = edge.selectExpr("*", "1 AS phase", "2 AS slot", "3 AS mix_slot", "4 AS row", "5 AS bucket", "6 AS __h")
    out = mixing.mix(clash, placed=True)
    assert set(out.columns) == {*clash.columns, "mix_place"} and out.count() == len(EDGE)
    assert {(r["phase"], r["slot"], r["row"], r["bucket"], r["__h"]) for r in out.collect()} == {(1, 2, 4, 5, 6)}


# 2
def test_toxicity(spark, edge, empty):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abdeghinorst"), 5)) for _ in range(400)]
    rows, marks = [], []
    for i in range(600):
        bad = i % 6 == 0
        text = list(rng.choice(words, 30))
        if bad:
            text[3:5] = [["idiot", "moron", "quazzle", "quazzer"][int(rng.integers(4))], "scum" if i % 4 else "quazzix"]
        rows.append((i, " ".join(text), "en", "a", 1, None, None))
        marks.append((i, int(bad)))
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    got = toxicity.score_documents(spark.createDataFrame(rows, DOCS), labels).collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (fold(r["doc_id"], 3) == 1) for r in got)
    assert np.mean([r["predicted"] == (r["doc_id"] % 6 == 0) for r in held]) > 0.97
    out = toxicity.score_documents(edge, labels.limit(0)).collect()
    assert len(out) == len(EDGE) and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score_documents(empty, labels.limit(0)).count() == 0


def test_label_model_orders_voters():
    rng = np.random.default_rng(2)
    y = rng.random(40000) < 0.2
    votes = np.stack([rng.random(len(y)) < np.where(y, a, b) for a, b in ((0.7, 0.02), (0.6, 0.05), (0.5, 0.1), (0.4, 0.02))], 1)
    model = toxicity.LabelModel(len(y), votes.sum(0), votes.T.astype(float) @ votes, 0.2, np.zeros(4), np.zeros(4))
    true = (votes & y[:, None]).sum(0) / votes.sum(0)
    assert np.abs(model.accuracy - true).max() < 0.06
    p = model.posterior(votes)
    assert p[y].mean() > p[~y].mean() + 0.4


# 3
def brute_classes(rows, threshold=0.8):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    par = {i: i for i in sets}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    ids = list(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and len(x & y) >= threshold * len(x | y) - 1e-9:
                p, q = find(ids[a]), find(ids[b])
                par[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_near_classes_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = []
    for base in range(12):
        words = [f"w{int(x)}" for x in rng.integers(0, 5000, 60)]
        for copy in range(8):  # a chain of edits: neighbours link, ends needn't
            words = list(words)
            words[int(rng.integers(60))] = f"e{base}-{copy}"
            rows.append((len(rows), " ".join(words)))
    rows += [(200, ""), (201, None), (202, "one two"), (203, "ONE two"), (204, rows[0][1])]
    df = spark.createDataFrame([(i, t, "en", "a", 1, None, None) for i, t in rows], DOCS)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(df).collect()}
    assert got == brute_classes(rows)
    kept = near_dedup.drop_near_copies(df)
    assert kept.columns == df.columns and kept.count() == len(set(got.values()))


def test_weighted_classes_against_all_pairs(spark):
    """Shingles weighed by their occurrences: the layers above one are thrown at, and repeats count in the check."""
    rng = np.random.default_rng(13)
    rows = []
    for base in range(6):
        words = [f"v{base}x{k}" for k in range(12)]
        rows += [(len(rows) + k, " ".join(words * int(n) + [f"tail{base}"])) for k, n in enumerate(rng.permutation([1, 2, 3, 8, 9, 10, 11, 20, 40, 47]))]
    bags = {}
    for i, t in rows:
        w = t.split()
        bags[i] = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    par = {i: i for i in bags}

    def find(i):
        while par[i] != i:
            i = par[i]
        return i

    for a in bags:
        for b in range(a):
            both, either = (bags[a] & bags[b]).total(), (bags[a] | bags[b]).total()
            if both >= 0.8 * either and find(a) != find(b):
                p, q = find(a), find(b)
                par[max(p, q)] = min(p, q)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), by="count").collect()}
    assert got == {i: find(i) for i in bags} and len(set(got.values())) > 12
    plain = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert plain.select("class_id").distinct().count() < len(set(got.values()))


def test_large_bands_are_checked_in_cells(spark, monkeypatch):
    """Pieces of a few members give the same classes as all pairs."""
    rng = np.random.default_rng(14)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(120):  # near copies about as far from each other as the threshold
        words = list(base)
        for k in rng.choice(60, int(rng.integers(1, 4)), replace=False):
            words[k] = f"e{i}-{k}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(near_dedup, "PIECE", 7)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_classes(rows)
    assert sum(got[i] != want[i] for i in want) <= 1 and len(set(want.values())) > 3


def test_near_edge(edge, empty):
    got = near_dedup.near_duplicates(edge).collect()
    assert len(got) == len(EDGE) and sum(r["kept"] for r in got) == len({(r["class_id"], r["class_size"]) if r["class_size"] > 1 else id(r) for r in got})
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.drop_near_copies(edge).count() == 9


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(5)
    doc, element, weight, want = [], [], [], []
    for i in range(150):
        e = rng.integers(0, 2**63, int(rng.integers(1, 200))).astype(np.uint64)
        a, b = (rng.choice([0.3, 1, 2, 5.5, 40], len(e)) for _ in "ab")
        for j, w in enumerate((a, b)):
            doc.append(np.full(len(e), 2 * i + j))
            element.append(e)
            weight.append(w)
        want.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
    sig = near_dedup.dart_signatures(*map(np.concatenate, (doc, element, weight)), 300)
    error = (sig[0::2] == sig[1::2]).mean(1) - want
    assert abs(error.mean()) < 0.015 and error.std() < 0.07


# 4
@pytest.fixture(scope="module")
def ranks():
    import public_tokenizers as tok

    return tok.path("byte_bpe_multi_50k.tiktoken"), tok.PATTERN


def test_bpe_against_the_library(spark, edge, empty, ranks):
    import tiktoken

    path, pattern = ranks
    with open(path, "rb") as f:
        table = bpe.read_ranks(f.read())
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    mine = bpe.Bpe(table, pattern)
    odd = ["", " ", "a", "  x  y\n\n z ", "a" * 400, "é" * 100 + "\t1 2", "x　y don't", "ab \ncd", "日本語テキスト", "x\r\ny", "\x00\x85 a", "<|endoftext|>"]
    for t in odd + [r[1] for r in EDGE if r[1]]:
        ids = mine.encode([t])[0]
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t) and mine.decode(ids).decode() == t
    for piece in (b"hello", b"aaaaaaaaaaaaaaaa", "größe".encode(), b"ab"):
        assert mine.merge_alone(piece) == mine.merge_together([piece], 32)[0]
    got = bpe.token_digests(edge, path, pattern).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(EDGE) and by[3]["n_tokens"] == 0
    assert by[7]["decoded_sha256"] == hashlib.sha256(EDGE[7][1].encode()).hexdigest()
    assert bpe.token_digests(empty, path, pattern).count() == 0


# 5
def test_nearest(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 16))
    x[700:760] = x[3]  # a hot vector
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(9000, None), (9050, [0.0] * 16), (9100, [float("nan")] * 16), (9150, [1.0, None]), (9200, []), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS score", "2 AS rank")
    got: dict = {}
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    assert sorted(got) == list(range(0, 1500, 50))
    for q, found in got.items():
        s = unit @ unit[q]
        s[q] = -9
        best = np.lexsort((np.arange(1500), -s.round(12)))[:5].tolist()
        hit += len({v for v, _ in found} & set(best))
        assert all(abs(unit[v] @ unit[q] - c) < 1e-9 for v, c in found)
    assert hit >= 0.9 * 5 * len(got)
    assert [v for v, _ in got[700]] == [3, 701, 702, 703, 704]
    assert ann.nearest(df.limit(0)).count() == 0


def test_repeated_rows_take_one_place(spark):
    rows = [(50, [1.0, 2.0])] * 10 + [(i, [1.0, 2.0]) for i in range(51, 56)] + [(i, [float(-i), 1.0]) for i in range(60, 90)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [r["vec_id"] for r in got if r["query_id"] == 50] == [51, 52, 53, 54, 55]


# 6
def test_base_scores_against_counting(spark, edge):
    got = {(r["doc_id"], r["n_tokens"]): r for r in suffix_tree_lm.score_documents(edge).collect()}
    train = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t, *_ in EDGE if fold(i, 7) != 2]
    counts = Counter(w for t in train for w in [*t, None])
    n, v = sum(counts.values()), len(counts)
    for i, t, *_ in EDGE:
        words = [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
        r = got[i, len(words)]
        assert r["train_tokens"] == n and r["n_known"] == sum(counts[w] > 0 for w in words)
        assert abs(r["base_score"] - sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in words)) < 1e-6 * max(1, len(words))
        assert np.isfinite(r["score"]) and r["held_out"] == (fold(i, 7) == 2)


def test_numbers_of_words():
    """The words are those of the plain pattern, and numbers are equal where words are."""
    rng = np.random.default_rng(12)
    batch = ["", " ", "A b", *("".join(rng.choice(list("aAbB \t\n\v\f\r\x1c\x85é\u3000x"), int(rng.integers(0, 60)))) for _ in range(300)), "Q" * 2000 + " " + "q" * 2000 + " " + "q" * 2001, "x" * 512 + "y" + "x" * 512 + " " + "x" * 1024 + "y"]
    number, new, text = suffix_tree_lm.tokens_of(batch)
    want = [[*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)), None] for t in batch]
    flat = [w for t in want for w in t]
    assert len(number) == len(flat) and new.sum() == len(batch) and text.tolist() == [i for i, t in enumerate(want) for _ in t]
    of: dict = {}
    assert all(of.setdefault(w, x) == x for w, x in zip(flat, number.tolist(), strict=True)) and len(set(of.values())) == len(of)


def test_tree_beats_the_base(spark, empty):
    rows = [(i, " ".join(["a b c d"] * 40 + ["e"] * (i % 3)), "en", "a", 1, None, None) for i in range(40)]
    got = suffix_tree_lm.score_documents(spark.createDataFrame(rows, DOCS)).collect()
    assert all(r["score"] > r["base_score"] + 10 for r in got)
    assert suffix_tree_lm.score_documents(empty).count() == 0


@pytest.mark.parametrize(("least", "order"), [(5, 5), (1, None)])
def test_tree_against_counting_every_context(spark, least, order):
    """Rare content words and contexts of three words make the scores that plain counting gives, with every sequence stored and contexts of any length too."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        words = [f"w{int(x)}" for x in rng.zipf(1.4, 30) % 500]
        words += ["rare", "kin"] if i % 50 == 7 else []
        words += [["p", "q"][i % 2], "r", "s", ["t", "u"][i % 2]] * 3
        rows.append((i, " ".join(words), "en", "a", 1, None, None))
    train = [[*r[1].split(), None] for r in rows if fold(r[0], 7) != 2]
    words = Counter(w for t in train for w in t)
    total = words.total()
    base = lambda w: (words[w] + 1) / (total + len(words) + 1)
    kept: dict = {}

    def p(context, w):
        while context and context not in kept:
            context = context[1:]
        if not context:
            return base(w)
        nexts, n = kept[context]
        return (nexts[w] + (len(nexts) + n - nexts.total()) * p(context[1:], w)) / (n + len(nexts))

    depth = 0
    while True:
        depth += 1
        found: dict = {}
        for t in train:
            for j in range(depth, len(t)):
                c = tuple(t[j - depth : j])
                if depth <= 2 or c[1:] in kept:
                    found.setdefault(c, Counter())[t[j]] += 1
        new = {}
        for c, nexts in found.items():
            n = nexts.total()
            stored = Counter({w: x for w, x in nexts.items() if x >= least})
            d, rest = len(stored), n - stored.total()
            kl = sum(x * np.log(x / n / p(c[1:], w)) for w, x in stored.items())
            if rest:
                kl += rest * np.log(rest / n / max(1e-12, 1 - sum(p(c[1:], w) for w in stored)))
            if d and 2 * kl > d + 4 * np.sqrt(2 * d):
                new[c] = stored, n
        kept.update(new)
        if depth > 1 and not new or depth == order:
            break
    assert ("rare",) in kept and any(len(c) > 2 for c in kept)
    for c in kept:  # each distribution sums to 1; words outside the base have what it leaves them
        assert abs(sum(p(c, w) for w in words) + p(c, "never seen") - 1) < 1e-9
    got = {r["doc_id"]: r for r in suffix_tree_lm.score_documents(spark.createDataFrame(rows, DOCS), least=least, order=order).collect()}
    for i, text, *_ in rows:
        t = [*text.split(), None]
        want = sum(np.log10(p(tuple(t[:j]), w)) for j, w in enumerate(t))
        assert abs(got[i]["score"] - want) < 1e-6


def _shuffled(spark) -> int:
    """Bytes that stages have written to shuffles so far."""
    context = spark.sparkContext
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_counts_are_shuffled_in_packs(spark):
    """Sequences are counted in few bytes a token: 600,000 tokens take under 6 MB."""
    rng = np.random.default_rng(8)
    words = np.array([f"w{i}" for i in range(3000)])
    rows = [(i, " ".join(words[rng.zipf(1.3, 1500) % 3000]), "en", "a", 1, None, None) for i in range(400)]
    before = _shuffled(spark)
    assert suffix_tree_lm.score_documents(spark.createDataFrame(rows, DOCS)).count() == 400
    assert _shuffled(spark) - before < 6_000_000


def test_packs_of_counts_against_counting(spark):
    """Counts of packs are those of single rows, with a context that is everywhere, words beyond the known ones, the word for all and rows that are counted before."""
    rng = np.random.default_rng(9)
    draw = lambda n: rng.integers(-(1 << 63) + 3, 1 << 63, n)
    contexts, words = draw(400), np.append(draw(200), suffix_tree_lm.ALL)
    known = spark.sparkContext.broadcast(suffix_tree_lm.Table(words[50:150]))
    want, packs = Counter(), []
    for _ in range(3):
        at, of, c = rng.integers(0, 400, 5000) * (rng.random(5000) < 0.7), rng.integers(0, 201, 5000), rng.integers(1, 300, 5000)
        for row in zip(contexts[at].tolist(), words[of].tolist(), (contexts[at] ^ 5).tolist(), c.tolist(), strict=True):
            want[row[:3]] += row[3]
        packs += suffix_tree_lm._packs({"context": contexts[at], "word": words[of], "shorter": contexts[at] ^ 5, "c": c}, known.value, 4)
    assert not list(suffix_tree_lm._packs({"context": contexts[:0], "word": words[:0]}, known.value, 4))
    got = suffix_tree_lm._grouped(spark.createDataFrame(pd.concat(packs), suffix_tree_lm._PACK + ", shorter binary"), known, 400).collect()
    assert {(r["context"], r["word"], r["shorter"]): r["c"] for r in got} == {k: c for k, c in want.items() if c >= 400} and len(got) > 100
    one = pd.concat(suffix_tree_lm._packs({"context": np.repeat(contexts[:100], 50), "word": np.tile(words[50:100], 100)}, known.value, 4))
    assert one["n"].map(lambda x: suffix_tree_lm._from_planes(x, "<u4").sum()).sum() == 5000


# 7
def test_exact_classes(spark, edge, empty):
    got = exact_dedup.exact_classes(edge).collect()
    assert len(got) == len(EDGE)
    by: dict = {}
    for r in got:
        by.setdefault(r["text_sha256"], []).append(r)
    for held in by.values():
        assert {r["group_size"] for r in held} == {len(held)} and sum(r["kept"] for r in held) == 1
        assert all(r["keep_id"] == max((x["doc_id"] for x in held if x["doc_id"] is not None), default=None) for r in held)
    assert exact_dedup.drop_exact_copies(edge).count() == len(by)
    assert exact_dedup.exact_classes(empty).count() == 0


def test_huge_texts_are_hashed_in_parts_alike(spark, edge):
    plain = {(r["doc_id"], r["n_bytes"]): (r["fp1"], r["fp2"]) for r in exact_dedup.fingerprints(edge).collect()}
    split = {(r["doc_id"], r["n_bytes"]): (r["fp1"], r["fp2"]) for r in exact_dedup.fingerprints(edge, huge_bytes=100).collect()}
    assert plain == split


def test_fingerprints_compose():
    rng = np.random.default_rng(7)
    data = rng.integers(0, 256, 200_001).astype(np.uint8).tobytes()
    h = 0
    for s in np.frombuffer(data + b"\0", "<u2").tolist():
        h = (h * exact_dedup.BASES[0] + s) % exact_dedup.PRIMES[0]
    assert exact_dedup.fingerprint(data)[0] == h


def test_collisions_are_found_and_split(spark, edge):
    """With primes of a few bits texts of one length collide: the comparison finds them, and classes are those of the texts."""
    rows = [(i, "".join(chr(97 + i // 3 // 26**k % 26) for k in range(3)), "en", "a", 1, None, None) for i in range(900)] + [(2000, "A" * 70_000 + "b", "en", "a", 1, None, None), (2001, "a" * 70_000 + "c", "en", "a", 1, None, None)]
    df = spark.createDataFrame(rows, DOCS).unionByName(edge)
    want = {(r["doc_id"], r["text_sha256"]): (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_classes(df).collect()}
    found = exact_dedup.fingerprints(df, primes=(7, 5))
    shared = found.groupBy(*exact_dedup.KEY).count().filter("count > 1")
    texts_of: dict = {}
    for r in found.collect():
        texts_of.setdefault((r["fp1"], r["fp2"], r["n_bytes"]), set()).add(r["text_sha256"])
    assert {tuple(r) for r in exact_dedup.unequal(df, shared, (7, 5)).collect()} == {k for k, v in texts_of.items() if len(v) > 1} != set()
    got = {(r["doc_id"], r["text_sha256"]): (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_classes(df, (7, 5)).collect()}
    assert got == want


# 8
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)] + [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def test_base_spans_against_plain_patterns():
    rng = np.random.default_rng(8)
    for _ in range(20000):
        t = "".join(rng.choice(list("a@.-+1 2540(%é"), int(rng.integers(0, 40))))
        assert pii.base_spans(t) == brute_spans(t)
    assert pii.base_spans("x" * 200_000 + "1" * 50_000) == []


def test_disclosing_terms(spark, edge, empty):
    rows = [(i, f"visit Quagmire house of bob{j}@mail.org today about the weather", "en", "a", 1, None, None) for i, j in enumerate([7] * 5 + [1, 2, 3])]
    rows += [(100 + i, "plain words about the house and the weather of today visit", "en", "a", 1, None, None) for i in range(60)]
    rows[5:8] = [(r[0], r[1].replace("Quagmire", "our"), *r[2:]) for r in rows[5:8]]
    df = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r for r in pii.span_digests(df).collect()}
    assert got[0]["spans"] == "term:6:14,email:24:37" and got[0]["n_email"] == 1
    assert got[0]["base_sha256"] == hashlib.sha256(b"email:24:37").hexdigest()
    assert "term" not in got[5]["spans"] and got[100]["spans"] == ""
    listed = lambda most: sorted(map(str, pii.find_personal_data(df, whole=True, most_terms=most).collect()))
    assert listed(0) == listed(100)  # terms met by a join, or broadcast
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert "Quagmire" not in clean[0] and "<email>" in clean[0] and clean[100] == rows[-1][1]
    assert pii.span_digests(edge).count() == len(EDGE) and pii.span_digests(empty).count() == 0


def test_terms_of_rare_entities_wherever_they_stand(spark):
    """One document discloses; words far off, behind a very long token, and in a text without the entity are marked."""
    far = "Zyx " + "and so on " * 40 + "x" * 300 + " "
    rows = [(0, far + "mail amy@mail.org today", "en", "a", 1, None, None), (1, "it was Zyx again", "en", "a", 1, None, None)]
    rows += [(100 + i, "and so on mail today it was again", "en", "a", 1, None, None) for i in range(9000)]
    got = {r["doc_id"]: r["spans"] for r in pii.span_digests(spark.createDataFrame([r for r in rows if r[0] != 1], DOCS)).collect()}
    assert got[0].startswith("term:0:3,") and "email:" in got[0] and got[100] == ""
    twice = [rows[0], (2, rows[0][1], *rows[0][2:]), (3, rows[0][1], *rows[0][2:]), *rows[1:]]
    got = {r["doc_id"]: r["spans"] for r in pii.span_digests(spark.createDataFrame(twice, DOCS)).collect()}
    assert got[1] == "term:7:10" and got[2].startswith("term:0:3,")


def test_shares_against_counting(spark):
    """All disclosing terms and their shares, by counting documents."""
    rng = np.random.default_rng(11)
    texts = []
    for i in range(600):
        who = int(rng.zipf(1.5)) % 40
        words = [f"w{'abcdefghij'[int(x) % 10]}{'abcdefghij'[int(x) // 10 % 10]}{'abcdefghij'[int(x) // 100 % 10]}" for x in rng.zipf(1.3, 12) % 1000]
        texts.append(" ".join([*words, f"p{'abcdefghijklmnopqrstuvwxyz'[who % 26]}near{'xyz'[who % 3]}", f"u{who}@mail.org" if i % 3 else "nobody"]))
    n_t, n_c, n_tc = Counter(), Counter(), Counter()
    for t in texts:
        spans = brute_spans(t)
        bare = t
        for _, s, e in spans:
            bare = bare[:s] + " " * (e - s) + bare[e:]
        words = {w for w in re.findall(r"[^\W\d_]+", bare.lower()) if len(w) >= 3}
        n_t.update({w for w in re.findall(r"[^\W\d_]+", t.lower()) if len(w) >= 3})
        for c in {t[s:e] for _, s, e in spans}:
            n_c[c] += 1
            n_tc.update((w, c) for w in words)
    want, n = {}, len(texts)
    for (w, c), k in n_tc.items():
        m = n_t[w] * n_c[c] / n
        share = np.log(k / m) / np.log((n + 1) / n_c[c])
        if k > m and np.exp(k - m) * (m / k) ** k <= pii.CHANCE and share >= pii.DISCLOSURE:
            want[pii._hash(w)] = max(share, want.get(pii._hash(w), 0))
    got = {r["term"]: r["share"] for r in pii.disclosing(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    assert len(want) > 3 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_sanitised_texts_are_of_their_own_rows(spark):
    """Repeated and null ids, overlapping spans, nulls."""
    rows = [(1, "ring +49 123 456 789 now"), (1, "mail amy@mail.org now"), (None, "ring +49 123 456 789 now"), (2, None), (3, "4111 1111 1111 1111@mail.org"), (4, "nothing")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS spans", "1 AS base")
    got = sorted((r["doc_id"] or 0, r["text"]) for r in pii.sanitise(df, 2.0).collect())
    assert got == [(0, "ring <phone> now"), (1, "mail <email> now"), (1, "ring <phone> now"), (2, ""), (3, "<card>"), (4, "nothing")]
    digests = pii.span_digests(df).collect()
    assert len(digests) == 6 and {r["sanitised_sha256"] for r in digests if r["doc_id"] == 4} == {hashlib.sha256(b"nothing").hexdigest()}


# 9
SPEECH = {"en": "the thing with that other weather and then thought", "fr": "le chat est dans une maison avec des fleurs", "de": "der hund ist nicht schlecht und die katze schläft"}


def test_languages(spark, edge, empty):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(180):
        lang = list(SPEECH)[i % 3]
        rows.append((i, " ".join(rng.choice(SPEECH[lang].split(), 25)), lang, "a", 1, None, None))
    df = spark.createDataFrame(rows, DOCS)
    got = langid.predict_languages(df).collect()
    truth = {r[0]: r[2] for r in rows}
    assert all(r["lang_pred"] == truth[r["doc_id"]] for r in got) and all(0 <= r["score"] <= 1 for r in got)
    out = {r["doc_id"]: r["lang_pred"] for r in langid.predict_languages(edge).collect()}
    assert out[3] == out[4] == out[5] == out[6] == "und"
    assert langid.predict_languages(empty).count() == 0
    assert langid.drop_unidentified(df).count() == 180 and langid.drop_unidentified(edge).columns == edge.columns


def test_forward_backward_against_one_document_at_a_time():
    model = langid.Crf(["de", "en", "fr"]).fit([(t * 20, k) for k, t in SPEECH.items()])
    docs = ["the katze est la".split(), [], "12 xx".split(), ("der the " * 9).split()]
    total, words = model.posteriors(docs)
    move = np.exp(model.transitions.astype(float))
    for d, got, n in zip(docs, total, words, strict=True):
        at = model.index(d)
        e = model._scores[at].astype(float)
        a, b = np.ones((len(d), 3)), np.ones((len(d), 3))
        for i in range(len(d)):
            a[i] = e[i] * (a[i - 1] @ move if i else 1)
        for i in range(len(d) - 2, -1, -1):
            b[i] = move @ (e[i + 1] * b[i + 1])
        p = a * b
        p = p / p.sum(1, keepdims=True) * model._spoken[at][:, None] if len(d) else p
        assert np.allclose(p.sum(0), got, atol=1e-4) and n == model._spoken[at].sum()


# 10
def test_secrets(spark, edge, empty):
    rng = np.random.default_rng(10)
    key = lambda: "".join(rng.choice(list("0123456789abcdef"), 40))

    def filler():
        junk = "".join(rng.choice(list("abcdeflmnor"), int(rng.integers(3, 9))))
        return " ".join(rng.choice(["harbour", "lantern", "the", "morning", "of", "a", junk, junk], int(rng.integers(0, 7))))

    rows = [(i, f'{filler()} token = "{key()}" {filler()} internationalisationmentation {filler()} /usr/local/share/things {filler()}', "en", "a", 1, None, None) for i in range(240)]
    rows.append((500, f"a bare {key()} here", "en", "a", 1, None, None))
    rows.append((501, f"password: {key()[:12]} then api_key={key()} and size=12", "en", "a", 1, None, None))
    rows += [rows[0], rows[0]]
    got = secrets.classify(spark.createDataFrame(rows, DOCS)).collect()
    for r in got:
        assert r["is_secret"] == (len(r["candidate"]) == 40) or r["doc_id"] == 501, r
    assert [len(r["candidate"]) for r in sorted(got, key=lambda r: r["finding"]) if r["doc_id"] == 501] == [12, 40]
    odd = spark.createDataFrame([(1, "see abcdefghijklmnopQRST0123== and secret: 'x/y.z!#$' or =12345678")], "doc_id long, text string")
    assert [r["candidate"] for r in secrets.candidates(odd).orderBy("finding").collect()] == ["abcdefghijklmnopQRST0123==", "x/y.z!#$"]
    assert len({r["probability"] for r in got if r["doc_id"] == 0 and r["finding"] == 0}) == 1 and sum(r["doc_id"] == 0 for r in got) == 9
    assert {r["label"] for r in got if r["doc_id"] == 0} == {0, 1} and {r["label"] for r in got if r["doc_id"] == 500} == {0}  # evidence errs, the forest doesn't
    assert secrets.classify(empty).count() == 0
    lone = secrets.classify(edge.selectExpr("*", "1 AS row", "2 AS label", "3 AS candidate")).collect()
    assert {(r["doc_id"], r["probability"]) for r in lone} == {(8, 0.0)}
    plan = secrets.classify(spark.createDataFrame(rows, DOCS))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_features_of_candidates(spark):
    """Dictionary cover and neighbours by plain counting."""
    rows = [(i, "the harbour and the lantern " + "abcdefgh"[i % 8] * 5, "en", "a", 1, None, None) for i in range(8)]
    rows.append((90, "harbour lantern token = harbourLantern_x9y8z7Z and credential zzzz", "en", "a", 1, None, None))
    df = spark.createDataFrame(rows, DOCS)
    found = secrets.candidates(df).withColumn("row", F.monotonically_increasing_id())
    asked = spark.createDataFrame([("harbour",), ("lantern",), ("zzzz",), ("the",)], "word string")
    known = secrets.dictionary(df, asked)
    assert {r["word"] for r in known.collect()} == {"harbour", "lantern", "the"}
    (r,) = secrets.with_features(found, known).collect()
    assert r["candidate"] == "harbourLantern_x9y8z7Z" and r["length"] == 22 and abs(r["words"] - 14 / 22) < 1e-9 and abs(r["capitals"] - 2 / 22) < 1e-9
    assert r["named"] == 1 and abs(r["path"] - 1 / 22) < 1e-9 and abs(r["beside"] - 14 / len("harbour lantern   and credential zzzz"[:36])) < 0.02
    runs = [(c.isdigit(), c.islower(), c.isupper()) for c in r["candidate"]]
    assert abs(r["transitions"] - sum(a != b for a, b in zip(runs, runs[1:])) / 22) < 1e-9


# pipeline
def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls, empty, long, repeated and odd rows, clashing columns, and an empty table."""
    import corpus_pipeline

    more = [(i, f"the thing with that other weather and then thought number {i} of many", "en", None if i % 2 else "a", 1, None, None) for i in range(20, 40)]
    df = spark.createDataFrame([*EDGE, *more, more[0], (None, more[1][1], *more[1][2:])], DOCS).selectExpr("*", "1 AS phase", "2 AS row_id", "3 AS text_sha256", "4 AS row_key", "5 AS __found")
    df.write.parquet(str(tmp_path / "some" / "documents.parquet"))
    df.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    docs = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path / "some"))
        assert [c for c in docs.columns if not c.startswith("mix_")] == df.columns, name
    out = corpus_pipeline.run(spark, str(tmp_path / "some")).collect()
    ids = [r["doc_id"] for r in out]
    assert len(ids) == len(set(ids)) and set(range(20, 40)) <= set(ids) and not {3, 4, 5, 6} & set(ids)
    assert sorted((r["mix_slot"], r["mix_place"]) for r in out) == sorted({(r["mix_slot"], r["mix_place"]) for r in out})
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = brute_classes([(r["doc_id"], r["text"]) for r in docs])
    got = [r["doc_id"] for r in out.collect()]
    assert len(got) == len(set(got)) == len(set(want.values()))
    assert {want[i] for i in got} == set(want.values())


def test_pipeline_returns_the_mixture(spark):
    """The final rows hold the slots and places that schedule() gives the rows that reach the mixing stage."""
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    left = docs.join(spark.createDataFrame([(r["doc_id"],) for r in out], "doc_id long"), "doc_id", "left_semi").select(*docs.columns)
    want = {r["doc_id"]: (r["slot"], r["place"]) for r in mixing.schedule(left).select("row.doc_id", "slot", "place").collect()}
    assert {r["doc_id"]: (r["mix_slot"], r["mix_place"]) for r in out} == want
    assert len(set(want.values())) == len(out) > 1
