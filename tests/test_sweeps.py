"""Windows over flat lines against folds and pairs on random pages; documents too large for one place."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptoria.functions import layout as L
from scriptoria.operators import id_cards, images, letters, licence, lines, pages
from scriptoria.schemas import LETTER_PAGES, LINES, RAW_OCR

WORDS = ["姓", "类", "类型甲", "住址一路", "住址", "公民身份号码1", "", " ", "::乙", "型：丙", "丁戊", "2019年06月24日", "登记机关", "住所", "住", "所", "经营范围", "名称", "软件", "12", "*斤金水路", "郑东", "新", "法定代表人", "张三"]


@pytest.fixture(scope="module")
def random_pages(spark):
    """Pages of lines on a coarse grid, so that edges, centres and whole boxes often coincide, some with their corners swapped."""
    rng = np.random.default_rng(21)
    rows = []
    for d in range(60):
        n, step = int(rng.integers(1, 45)), int(rng.choice([1, 10, 40]))
        left, top = (rng.integers(-3, 300 // step, n) * step for _ in range(2))
        wide, high = rng.integers(-1, 200, n), rng.integers(-1, 4, n) * rng.choice([5, 10, 11], n)
        rows += [(str(d), i, WORDS[int(rng.integers(len(WORDS)))], int(left[i]), int(top[i]), int(left[i] + wide[i]), int(top[i] + high[i]), 0.9) for i in range(n)]
    df = spark.createDataFrame(rows, LINES).persist()
    yield rows, df
    df.unpersist()


@pytest.mark.parametrize("tol", [0, 3, 20])
def test_nearest_of_every_line_against_all_pairs(random_pages, tol):
    rows, df = random_pages
    by_page = {}
    for r in rows:
        by_page.setdefault(r[0], []).append(r)
    near = {
        "below": lambda a, x: (x[4] - a[6], abs(x[3] - a[3])) if x[4] > a[6] else None, "above": lambda a, x: (a[4] - x[6], abs(x[3] - a[3])) if x[6] < a[4] else None,
        "right": lambda a, x: (x[3],) if x[3] > a[5] and abs((x[4] + x[6]) / 2 - (a[4] + a[6]) / 2) <= tol else None,
    }
    for where, test in near.items():
        if where != "right" and tol:
            continue
        want = set()
        for page in by_page.values():
            for a in page:
                found = [(*test(a, x), x[4], x[3], x[1]) for x in page if test(a, x)]
                if found:
                    want.add((a[0], a[1], min(found)[-1]))
        assert {(r["doc_id"], r["anchor_line_no"], r["line_no"]) for r in lines.nearest_of_every_line(df, where, tol).collect()} == want


def test_bands_are_a_partition(spark):
    got = spark.range(-40, 40).select("id", lines._bands(F.col("id").cast("int"), (F.col("id") + 81).cast("int"), 9).alias("b")).collect()
    for r in got:
        held = [x for b in r["b"] for x in range(b["at"] << b["level"], (b["at"] + 1) << b["level"])]
        assert sorted(held) == list(range(r["id"], r["id"] + 82)) and len(r["b"]) <= 14


@pytest.mark.parametrize(("gap", "skip", "prefixes"), [(30, (), ()), (5, ("类",), ("类", "型")), (100, ("姓", "丁戊"), ("::",))])
def test_row_sequences_against_the_fold(random_pages, gap, skip, prefixes):
    """Blank and skipped blocks move the right edge, here and there."""
    _, df = random_pages
    parts = L.row_sequence(L.same_row_right(F.col("lines"), F.col("a"), 20), F.lit(gap), skip, prefixes)
    nested = lines.to_layouts(df).withColumn("a", F.explode("lines")).select("doc_id", F.col("a.line_no").alias("anchor_line_no"), F.posexplode(parts).alias("i", "p"))
    want = {(r["doc_id"], r["anchor_line_no"], r["p"]["x"]["line_no"], r["p"]["text"]) for r in nested.collect()}
    blocks = lines.same_row_right(df, df, 20)
    got = {(r["doc_id"], r["anchor_line_no"], r["line_no"], r["part"]) for r in lines.row_sequence(blocks, gap, skip, prefixes).collect()}
    assert got == want and want


@pytest.mark.parametrize("running_max", [True, False])
def test_continuations_against_the_fold(random_pages, running_max):
    _, df = random_pages
    stops, skips, gap, clean = lambda x: x["text"].rlike("姓|登记"), lambda x: x["text"] == "类", F.lit(40), lambda t: F.regexp_replace(t, "^::", "")
    under = F.array_sort(F.filter("lines", lambda x: x["top"] >= F.col("a.top")))
    texts = L.continuation(under, F.col("a.bottom"), stops, skips, gap, clean, running_max)
    want = {(r[0], r[1]): r[2] for r in lines.to_layouts(df).withColumn("a", F.explode("lines")).select("doc_id", "a.line_no", texts).collect()}
    met = lines._met(df, df, F.col("top") >= F.col("anchor_top"))
    got = {}
    for r in sorted(lines.continuation(met, F.col("anchor_bottom"), stops, skips, gap, clean, running_max).collect(), key=lambda r: (r["top"], r["left"], r["line_no"])):
        got.setdefault((r["doc_id"], r["anchor_line_no"]), []).append(r["part"])
    assert got == {k: v for k, v in want.items() if v} and got


def test_flat_fields_against_the_nested_ones(random_pages):
    _, df = random_pages
    nested = lines.to_layouts(df)
    want = {r["doc_id"]: r["address"] for r in id_cards.parse_id_front(nested).collect()}
    assert {r["doc_id"]: r["address"] for r in id_cards.address_of_lines(df).collect()} == want and any(want.values())
    key = lambda t: sorted(map(tuple, t.select("doc_id", *licence.FIELDS).collect()))
    assert key(licence.fields_of_lines(df)) == key(licence.parse_business_license(nested))


def test_a_document_of_many_pages_is_dealt_out(spark):
    """One id with a hundred times the lines of the others: the same places and metrics, and no partition far above the median one."""
    rng = np.random.default_rng(22)
    rows = []
    for d, n in (("huge", 60_000), *((f"d{i}", 600) for i in range(20))):
        page, left, top = rng.integers(1, max(2, n // 60), n), rng.integers(0, 900, n), rng.integers(0, 200, n) * 10
        rows += [(d, int(page[i]), i, "x", int(left[i]), int(top[i]), int(left[i] + 50), int(top[i] + 5 + i % 37), 0.9) for i in range(n)]
    df = spark.createDataFrame(rows, f"doc_id string, page int, {LINES.split(', ', 1)[1]}")
    got = {(r["doc_id"], r["line_no"]): r["place"] for r in lines.reading_order_of_pages(df).collect()}
    for d in ("huge", "d0"):
        order = sorted((r for r in rows if r[0] == d), key=lambda r: (r[1], r[5], r[4], r[2]))
        assert [got[d, r[2]] for r in order] == list(range(1, len(order) + 1))
    assert len(got) == len(rows)
    sizes = [r["count"] for r in df.groupBy(F.pmod(F.hash("doc_id", "page", "top"), F.lit(32))).count().collect()]
    assert max(sizes) < 1.3 * float(np.median(sizes))
    for r in lines.doc_metrics(df).collect():
        own = [x for x in rows if x[0] == r["doc_id"]]
        assert (r["doc_width"], r["doc_height"], r["base_h"]) == (max(x[6] for x in own), max(x[7] for x in own), int(np.median([max(1, x[7] - x[5]) for x in own])))
    plan = lines.doc_metrics(df)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "Exchange hashpartitioning(doc_id" in plan


def test_a_letter_of_many_pages(spark):
    rng = np.random.default_rng(23)
    rows = [("huge", int(p), ["甲", "", None, f"page {p}"][p % 4], 0) for p in rng.permutation(np.arange(1, 20_001))]
    rows += [("odd", None, "n", 0), ("odd", 0, "z", 0), ("odd", -3, "m", 0), ("odd", 2, "b", 0), ("odd", 2, "a", 0), ("odd", 300, None, 0)]
    df = spark.createDataFrame(rows, LETTER_PAGES).repartition(4)
    whole = {r["doc_id"]: r["raw_text"] for r in letters.letter_raw_text(df).collect()}
    order = sorted((r for r in rows if r[0] == "huge"), key=lambda r: r[1])
    assert whole["huge"] == "\n".join(r[2] or "" for r in order) and whole["odd"] == "n\nm\nz\na\nb\n"
    got = {r["doc_id"]: r for r in letters.raw_pages(df).collect()}
    assert got["huge"]["raw_text"] == "".join(r[2] + "\n" for r in order if r[2]) and got["huge"]["pages_count"] == 20_000
    assert [p["page_number"] for p in got["huge"]["pages"]] == list(range(1, 20_001)) and got["odd"]["raw_text"] == "n\nm\nz\na\nb\n" and got["odd"]["char_counts"] == [1, 1, 1, 1, 1, 0]


@pytest.mark.parametrize(("size", "rows"), [((700, 501), 128), ((515, 64), 256), ((259, 90), 1), ((40, 33), 7), ((1024, 300), 5000)])
def test_strips_of_images_against_whole_ones(spark, size, rows):
    rng = np.random.default_rng(size[0])
    held = [(str(k), *size, 3, bytearray(rng.integers(0, 40 + 100 * k, (*size, 3), np.uint8).tobytes())) for k in range(2)]
    df = spark.createDataFrame(held, "doc_id string, height int, width int, channels int, data binary")
    got = {}
    for r in sorted(images.enhance_in_strips(df, rows).collect(), key=lambda r: r["first"]):
        assert r["height"] <= rows and r["first"] == r["strip"] * rows
        got[r["doc_id"]] = got.get(r["doc_id"], b"") + bytes(r["data"])
    assert got == {r["doc_id"]: bytes(r["data"]) for r in images.enhance_images(df).collect()}


def test_trimming_is_that_of_the_pattern(spark):
    """White space off both ends: for every character, as the pattern has it."""
    df = spark.createDataFrame([(chr(c) + "a b" + chr(c) * 2,) for c in [*range(1, 0x300), *range(0x1600, 0x1900), *range(0x2000, 0x2100), *range(0x2FF0, 0x3010), 0xFEFF, 0x1F600]] + [("",), (None,), (" \t\n",)], "t string")
    from scriptoria.functions.text import strip

    assert df.filter(~strip("t").eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))).count() == 0


def test_lines_of_a_page_by_the_array_and_by_the_table(spark, random_pages):
    """Neighbours by one minimum are those that two sorts find."""
    _, df = random_pages
    nested = lines.to_layouts(df).withColumn("a", F.explode("lines"))
    got = nested.select("doc_id", "a.line_no", L.nearest_below(F.col("lines"), F.col("a"))["line_no"].alias("b"), L.nearest_above(F.col("lines"), F.col("a"))["line_no"].alias("u")).collect()
    for where, column in (("below", "b"), ("above", "u")):
        assert {(r["doc_id"], r["line_no"], r[column]) for r in got if r[column] is not None} == {(r["doc_id"], r["anchor_line_no"], r["line_no"]) for r in lines.nearest_of_every_line(df, where).collect()}
    assert pages.to_layouts(spark.createDataFrame([], RAW_OCR)).count() == 0


def _edge_pages():
    """A page of 1500 lines on few heights and edges, and pages with coordinates at both ends of whole numbers."""
    rng = np.random.default_rng(24)
    left, top = rng.integers(0, 40, 1500) * 9, rng.integers(0, 30, 1500) * 4
    rows = [("dense", i, f"t{i}", int(left[i]), int(top[i]), int(left[i] + i % 50), int(top[i] + i % 5), 0.9) for i in range(1500)]
    ends = [-(2**31), -(2**31) + 1, -7, 0, 1, 2**31 - 2, 2**31 - 1]
    return rows + [(f"e{d}", i, f"t{i}", *[int(rng.choice(ends)) for _ in range(4)], 0.9) for d in range(12) for i in range(25)]


@pytest.mark.parametrize("where", ["right", "above", "below"])
def test_nearest_of_every_line_of_a_page_held_as_an_array(spark, random_pages, where):
    """Those of all pairs; the registered query over pages shuffles nothing."""
    from scriptoria.plans.queries import QUERIES

    for tol in (0, 3, 20) if where == "right" else (20,):
        for rows in (random_pages[0], _edge_pages()):
            pages_of = {}
            for r in rows:
                pages_of.setdefault(r[0], []).append(r)
            want = {}
            for d, page in pages_of.items():
                no, left, top, right, bottom = (np.array([r[k] for r in page], np.int64) for k in (1, 3, 4, 5, 6))
                for i, a in enumerate(page):
                    beyond = {"below": top > bottom[i], "above": bottom < top[i], "right": (left > right[i]) & (abs(top + bottom - top[i] - bottom[i]) <= 2 * tol)}[where]
                    by = {"below": (top, abs(left - left[i])), "above": (-bottom, abs(left - left[i])), "right": (left,)}[where]
                    order = np.lexsort((no, left, top, *by[::-1]))
                    found = order[beyond[order]]
                    if len(found):
                        want[d, a[1]] = (int(no[found[0]]), page[found[0]][2])
            nested = lines.to_layouts(spark.createDataFrame(rows, LINES)).select("doc_id", F.explode(L.nearest_of_every_line(F.col("lines"), where, tol)).alias("x"))
            got = nested.select("doc_id", "x.*").collect()
            assert {(r["doc_id"], r["anchor_line_no"]): (r["line_no"], r["text"]) for r in got} == want and len(got) == len(want)
    name = {"below": "l11_every_nearest_below", "above": "l12_every_nearest_above", "right": "l13_every_nearest_right"}[where]
    assert "Exchange" not in QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_reading_order_of_pages_held_as_arrays(spark):
    """Places are those that the flat table of lines gets, also where a page comes in several rows; pages are shuffled packed, not line by line."""
    from scriptoria.plans.queries import QUERIES

    rng = np.random.default_rng(25)
    rows = []
    for d, n in (("huge", 6000), ("a", 90), ("b", 1)):
        page, strip, left, top = rng.integers(-2, max(2, n // 50), n), rng.integers(0, 3, n), rng.integers(0, 9, n) * 100, rng.integers(0, 20, n) * 10
        rows += [(d, int(page[i]) - (2**31 - 2) * (i == 7), int(strip[i]) if page[i] % 2 else 0, i, f"t{i}", int(left[i]), int(top[i]), int(left[i] + 50), int(top[i] + 5), 0.9) for i in range(n)]
    df = spark.createDataFrame(rows, f"doc_id string, page int, strip int, {LINES.split(', ', 1)[1]}").persist()
    held = df.groupBy("doc_id", "page", "strip").agg(F.array_sort(F.collect_list(F.struct(*lines.READING, "right", "bottom", "text", "score"))).alias("lines")).drop("strip")
    held = held.unionByName(held.limit(1).select(F.lit("none").alias("doc_id"), "page", F.slice("lines", 1, 0).alias("lines")))
    want = sorted((r["doc_id"], r["page"], r["line_no"], r["text"], r["place"]) for r in lines.reading_order_of_pages(df.drop("strip")).collect())
    got = lines.reading_order_of_layouts(held, "line_no", "text")
    assert sorted(map(tuple, got.collect())) == want and got.columns == ["doc_id", "page", "line_no", "text", "place"] and len(want) == len(rows)
    df.unpersist()
    query = QUERIES["l01_reading_order_of_pages"](spark, "/root/testdata/sf0.001")
    query.collect()
    plan = query._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "posexplode" in plan[: plan.index("Exchange")] and "explode(lines" not in plan
    assert "ReusedExchange" in plan and plan.count("FileScan") == 1  # pages are made and shuffled once
