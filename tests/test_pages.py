import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptoria import sources
from scriptoria.functions import layout as L
from scriptoria.operators import documents, id_cards, images, letters, licence, lines, pages
from scriptoria.schemas import LETTER_PAGES, RAW_OCR
from scriptoria.streaming import stream_parse


def raw(spark, *docs):
    """Documents as lists of (text, left, top, right, bottom)."""
    rows = [(str(i), [b[0] for b in d], [0.9] * len(d), [list(b[1:]) for b in d], [[] for _ in d], 0) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, RAW_OCR)


CARD = [("姓名吴烽", 40, 40, 300, 70), ("性别男 民族汉", 40, 100, 300, 130), ("住址河南省渑池县洪阳镇德厚", 40, 220, 500, 250), ("村一号", 45, 255, 300, 285), ("公民身份号码41022119900101123x", 40, 400, 600, 430)]


def test_card(spark):
    row = id_cards.parse_id_front(pages.to_layouts(raw(spark, CARD))).first()
    assert (row["name"], row["gender"], row["nation"], row["birthday"]) == ("吴烽", "男", "汉", "")
    assert row["address"] == "河南省渑池县洪阳镇德厚村一号"
    assert row["id_number"] == "41022119900101123X"


def test_keywords_may_straddle_lines_and_bad_rows_stay_rows(spark):
    df = raw(spark, [("姓", 0, 0, 10, 10), ("名公民身份号码", 20, 0, 90, 10)], [("x", 0, 0, 9, 9)], [])
    out = {r["doc_id"]: r for r in documents.parse_documents(df.unionByName(df.filter("doc_id = '1'").withColumns({"doc_id": F.lit("bad"), "scores": F.array().cast("array<double>")}))).collect()}
    assert out["0"]["doc_type"] == "id_front" and out["0"]["error"] is None
    assert out["1"]["error"] is None and json.loads(out["1"]["data"]) == {"type": "unknown", "error": documents.NOT_RECOGNISED, "raw_texts": ["x"]}
    assert out["2"]["doc_type"] == "unknown"
    assert out["bad"]["error"] == documents.MISALIGNED
    empty = documents.parse_documents(df.limit(0))
    assert empty.count() == 0


def test_lines_are_cut_to_the_shortest_array_and_lose_blank_and_doubtful_ones(spark):
    rows = [("a", ["x", " ", None, "low", "y", "z"], [0.9, 0.9, 0.9, 0.1, 0.2], [[0, i, 9, i + 9] for i in range(6)], [], 0)]
    got = pages.build_lines(spark.createDataFrame(rows, RAW_OCR)).orderBy("line_no").collect()
    assert [(r["line_no"], r["text"]) for r in got] == [(0, "x"), (4, "y")]


def test_flat_and_nested_forms_agree(spark):
    rng = np.random.default_rng(4)
    docs = [[(str(k), int(x), int(y), int(x + 40), int(y + 20)) for k, (x, y) in enumerate(rng.integers(0, 300, (25, 2)))] for _ in range(6)]
    df = raw(spark, *docs)
    flat, nested = pages.build_lines(df), pages.to_layouts(df)
    anchors = lines.find(flat, "7")
    a = L.find(F.col("lines"), "7")
    for name in ("same_row", "right_of", "left_of", "below", "above"):
        want = {(r["doc_id"], r["line_no"]) for r in getattr(lines, name)(flat, anchors).collect()}
        got = {(r["doc_id"], r["x"]["line_no"]) for r in nested.select("doc_id", F.explode(getattr(L, name)(F.col("lines"), a)).alias("x")).collect()}
        assert want == got, name
    for name in ("nearest_below", "nearest_above", "nearest_right"):
        want = {(r["doc_id"], r["line_no"]) for r in getattr(lines, name)(flat, anchors).collect()}
        got = {(r["doc_id"], r["x"]["line_no"]) for r in nested.select("doc_id", getattr(L, name)(F.col("lines"), a).alias("x")).filter("x is not null").collect()}
        assert want == got, name
    right = {(r["doc_id"], r["line_no"]) for r in lines.right_of(flat, anchors).collect()}
    assert not right & {(r["doc_id"], r["line_no"]) for r in lines.left_of(flat, anchors).collect()}


def test_plans(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(documents.parse_documents(raw(spark, CARD)))
    given = spark.createDataFrame([("a", 1, "委托人：甲", 0)], LETTER_PAGES)
    assert plan(letters.parse_letters(given)).count("Exchange hashpartitioning") == 1


def test_letters(spark):
    rows = [("a", 2, "受托人张三身份证号110101199001011234\n委托人：乙", 0), ("a", 1, "委托人：\n身份证号码：41010119900101123x\n", 0), ("a", 3, None, 1), ("b", 1, "", 0)]
    got = {r["doc_id"]: r for r in letters.parse_letters(spark.createDataFrame(rows, LETTER_PAGES)).collect()}
    data = got["a"]["data"]
    assert data["delegator"] == "身份证号码：41010119900101123x"  # a blank field takes the next line
    assert data["trustee"] == "张三身份证" and data["trustee_id"] == "110101199001011234"
    assert data["delegator_id"] == "41010119900101123X" and data["trustee_signature"] == letters.CONFIRM[0]
    assert got["b"]["data"]["delegator"] is None and got["b"]["metadata"]["pages_count"] == 1


def test_image_steps():
    flat = np.full((64, 64), 100, np.uint8)
    assert len(np.unique(images.clahe(flat))) == 1
    spot = np.zeros((5, 5), np.uint8)
    spot[2, 2] = 20
    assert images.sharpen(spot)[2, 2] == 180 and images.sharpen(spot)[1, 1] == 0
    assert images.scale_contrast(np.array([[0, 100, 250]], np.uint8)).tolist() == [[30, 150, 255]]
    assert images.to_gray(np.full((1, 1, 3), 77, np.uint8))[0, 0] == 77


def brute_clahe(gray, tiles, clip=2.0):
    """Equalisation pixel by pixel."""
    h, w = gray.shape
    mode = "reflect" if min(h, w) > tiles else "edge"
    padded = np.pad(gray, ((0, -h % tiles), (0, -w % tiles)), mode=mode)
    th, tw = padded.shape[0] // tiles, padded.shape[1] // tiles
    tables = {}
    for ty in range(tiles):
        for tx in range(tiles):
            n = [0] * 256
            for v in padded[ty * th : (ty + 1) * th, tx * tw : (tx + 1) * tw].ravel().tolist():
                n[v] += 1
            limit = max(int(clip * th * tw / 256), 1)
            over = sum(max(0, x - limit) for x in n)
            n = [min(x, limit) + over // 256 for x in n]
            rest = over % 256
            step = max(256 // rest, 1) if rest else 0
            for k in range(0, 256, step or 256):
                if rest <= 0:
                    break
                n[k] += 1
                rest -= 1
            total, table = 0, []
            for x in n:
                total += x
                table.append(min(255, round(total * (255.0 / (th * tw)))))
            tables[ty, tx] = table
    out = np.zeros_like(gray)
    for y in range(h):
        for x in range(w):
            fy, fx = (y + 0.5) / th - 0.5, (x + 0.5) / tw - 0.5
            y0, x0 = int(np.floor(fy)), int(np.floor(fx))
            at = lambda a, b: tables[min(max(a, 0), tiles - 1), min(max(b, 0), tiles - 1)][gray[y, x]]  # noqa: B023, E731
            top = at(y0, x0) * (1 - (fx - x0)) + at(y0, x0 + 1) * (fx - x0)
            low = at(y0 + 1, x0) * (1 - (fx - x0)) + at(y0 + 1, x0 + 1) * (fx - x0)
            out[y, x] = min(255, max(0, round(top * (1 - (fy - y0)) + low * (fy - y0))))
    return out


@pytest.mark.parametrize("size", [(8, 8), (37, 53), (64, 41), (5, 90)])
def test_equalisation_and_the_chain_against_single_pixels(spark, size):
    rng = np.random.default_rng(sum(size))
    image = (rng.integers(0, 60, (*size, 3)) + np.linspace(0, 190, size[1]).astype(int)[None, :, None]).astype(np.uint8)
    gray = np.array([[(114 * int(b) + 587 * int(g) + 299 * int(r) + 500) // 1000 for b, g, r in row] for row in image], np.uint8)
    assert (images.to_gray(image) == gray).all()
    for tiles in (2, 8):
        assert np.abs(images.clahe(gray, tiles=tiles).astype(int) - brute_clahe(gray, tiles)).max() == 0
    flat, (h, w) = brute_clahe(gray, 8).astype(int), size
    mirror = lambda k, n: -k if k < 0 else 2 * n - 2 - k if k >= n else k
    want = np.zeros(size, np.uint8)
    for y in range(h):
        for x in range(w):
            s = 10 * flat[y, x] - sum(flat[mirror(y + i, h), mirror(x + j, w)] for i in (-1, 0, 1) for j in (-1, 0, 1))
            want[y, x] = min(255, round(min(255, max(0, s)) * 1.2 + 30))
    df = spark.createDataFrame([("a", *size, 3, bytearray(image.tobytes()))], "doc_id string, height int, width int, channels int, data binary")
    assert bytes(images.enhance_images(df).first()["data"]) == want.tobytes()


def test_image_files(spark, tmp_path):
    """A bitmap, decoded and undecoded, and a file that is no image."""
    pixels = [[(10, 20, 30), (40, 50, 60)], [(70, 80, 90), (100, 110, 120)]]
    body = b"".join(b"".join(bytes(p) for p in row) + b"\0\0" for row in reversed(pixels))
    head = b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 2, 2, 1, 24, 0, len(body), 0, 0, 0, 0)
    (tmp_path / "a.bmp").write_bytes(head + body)
    (tmp_path / "b.png").write_bytes(b"no image")
    got = {r["doc_id"].rsplit("/", 1)[-1]: r for r in sources.read_images(spark, str(tmp_path)).collect()}
    assert (got["a.bmp"]["height"], got["a.bmp"]["width"], got["a.bmp"]["channels"], got["a.bmp"]["error"]) == (2, 2, 3, None)
    assert bytes(got["a.bmp"]["data"]) == bytes(v for row in pixels for p in row for v in p)
    assert got["b.png"]["error"] and got["b.png"]["data"] is None
    files = {r["path"].rsplit("/", 1)[-1]: r for r in sources.read_image_files(spark, str(tmp_path)).collect()}
    assert files["a.bmp"]["file_size"] == 54 + len(body) and bytes(files["b.png"]["content"]) == b"no image"
    assert images.enhance_images(sources.read_images(spark, str(tmp_path))).filter("error is null").count() == 1


LICENCE = [
    ("统一社会信用代码", 40, 40, 260, 66), ("91410100MA1000001", 280, 40, 600, 66), ("名 称", 40, 100, 160, 126), ("河南省甲有限公司", 180, 100, 560, 126), ("类 型", 40, 160, 160, 186), ("有限责任公司", 180, 160, 400, 186),
    ("负责人", 40, 220, 160, 246), ("李四", 240, 220, 300, 246), ("注册资金：伍拾万元", 40, 280, 400, 306), ("注册日期", 40, 340, 160, 366), ("2019年06月24日", 180, 340, 400, 366),
    ("住", 700, 370, 720, 396), ("金水路1号", 780, 370, 1000, 396), ("一号楼", 780, 400, 900, 426), ("2020年01月01日", 780, 430, 900, 456), ("二号楼", 780, 460, 900, 486),
    ("经营范围", 40, 480, 160, 506), ("软件开发", 180, 480, 560, 506), ("技术服务", 180, 510, 560, 536), ("远处", 180, 700, 560, 726), ("登记机关", 700, 760, 800, 786),
]


def test_licence_branches(spark):
    """Spaced labels, an address by the first half of its label, stops by date and by gap, and a code from the joined text."""
    row = licence.parse_business_license(pages.to_layouts(raw(spark, LICENCE, []))).orderBy("doc_id").collect()
    got = row[0]
    assert (got["name"], got["type_name"], got["legal_person"]) == ("河南省甲有限公司", "有限责任公司", "李四")
    assert (got["capital"], got["establish_date"]) == ("伍拾万元", "2019年06月24日")
    assert got["address"].endswith("金水路1号一号楼") and got["business_scope"] == "软件开发技术服务"
    assert all(row[1][f] == "" for f in licence.FIELDS)
    split = [("91410100MA1", 0, 0, 90, 20), ("0000017", 100, 0, 150, 20), ("营业执照", 0, 40, 90, 60)]
    assert licence.parse_business_license(pages.to_layouts(raw(spark, split))).first()["credit_code"].startswith("91410100MA1000001")
    kinds = {r["doc_id"]: r["doc_type"] for r in pages.classify(pages.to_layouts(raw(spark, split, [("注册资本法定代表人", 0, 0, 9, 9)], [("注册资本", 0, 0, 9, 9)]))).collect()}
    assert kinds == {"0": "business_license", "1": "business_license", "2": "unknown"}


def test_back_of_a_card(spark):
    docs = [[("签发机关", 40, 40, 150, 70), ("郑州市公安局", 160, 45, 300, 75), ("有效期限2001.02.03-2021.02.03", 40, 120, 500, 150)], [("无", 0, 0, 9, 9)], []]
    got = [tuple(r) for r in id_cards.parse_id_back(pages.to_layouts(raw(spark, *docs))).select("doc_id", "authority", "valid_date").orderBy("doc_id").collect()]
    assert got == [("0", "郑州市公安局", "2001.02.03-2021.02.03"), ("1", "", ""), ("2", "", "")]


def test_partial_letters_and_files(spark):
    held = letters.merge_letter_pages(letters.parse_letter_text(spark.createDataFrame([("a", 1, "委托人：甲", 0)], LETTER_PAGES)))
    done = letters.postprocess_letter(letters.with_image_flags(held))
    got = letters.format_letter(done.selectExpr("*", "'broken page' AS error", "'blurred' AS warning")).first()
    assert got["status"] == "partial" and got["metadata"]["error"] == "broken page" and got["metadata"]["warning"] == "blurred"
    named = spark.createDataFrame([("a", 1, "x", 0), ("a", 2, None, 0)], LETTER_PAGES).selectExpr("*", "'a.pdf' AS filename", "12L AS file_size")
    r = letters.raw_pages(named).first()
    assert (r["filename"], r["file_size"], r["pages_count"], r["raw_text"]) == ("a.pdf", 12, 2, "x\n") and [tuple(p) for p in r["pages"]] == [(1, "x", 1), (2, "", 0)]


def test_unreadable_images_keep_their_row(spark):
    df = spark.createDataFrame([("a", 2, 2, 3, bytearray(12)), ("b", 2, 2, 3, bytearray(5)), ("c", None, None, None, None)], "doc_id string, height int, width int, channels int, data binary")
    got = {r["doc_id"]: r["error"] for r in images.enhance_images(df).collect()}
    assert got["a"] is None and got["b"] and got["c"]


def test_sources_and_stream(spark, tmp_path):
    raw(spark, CARD, [("x", 0, 0, 9, 9)]).write.json(str(tmp_path / "in"))
    assert sources.read_ocr_json(spark, str(tmp_path / "in")).count() == 2
    stream_parse(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt"), available_now=True).awaitTermination()
    assert {r["doc_type"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"id_front", "unknown"}
    sources.write_typed(documents.parse_layouts(pages.classify(pages.to_layouts(raw(spark, CARD)))), str(tmp_path / "typed"))
    assert spark.read.parquet(str(tmp_path / "typed" / "id_front")).count() == 1
    sources.write_classified(pages.classify(pages.to_layouts(raw(spark, CARD))), str(tmp_path / "classified"))
    kept, rest = pages.filter_supported(spark.createDataFrame([("a.PDF",), ("b.exe",), (None,)], "name string"), "name", ("pdf",))
    assert kept.count() == 1 and rest.count() == 2


def test_entry_registers_sql_for_known_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    own = {k for k in entry.queries() if not k.startswith("op") and k != "pipeline"}
    codes = ["s01", "s02", "s03", "s05", "s06", "a01", "a02", "a03", "a04", "a05", "a06", "a07", "a08", "a09", "d01", "d02", "d03", "t01"]
    codes += [f"{c}{i:02}" for c, n in (("p", 12), ("l", 21), ("f", 16), ("x", 20), ("i", 5)) for i in range(1, n + 1)]
    assert {k.split("_")[0] for k in own} == set(codes)
    assert set(own) <= set(entry.oracle_sql())
