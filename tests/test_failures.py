"""Documents that can't be parsed among good ones, in batch and stream, and typed tables of a stream that breaks off."""

import json

import pytest
from pyspark.sql import functions as F

from scriptoria import sources, streaming
from scriptoria.operators import documents, pages
from scriptoria.schemas import RAW_OCR

TEXTS = ["签发机关郑州市公安局", "有效期限2001.02.03-长期"]
GOOD = [[40, 40, 400, 70], [40, 120, 500, 150]]
CASES = {
    "good": (TEXTS, [0.9, 0.9], GOOD, None), "short": (TEXTS, [0.9, 0.9], [GOOD[0], [1, 2]], pages.NO_BOX), "no box": (TEXTS, [0.9, 0.9], [None, GOOD[1]], pages.NO_BOX), "long": (TEXTS, [0.9, 0.9], [GOOD[0], [1, 2, 3, 4, 5]], pages.NO_BOX),
    "empty box": (TEXTS, [0.9, 0.9], [[], GOOD[1]], pages.NO_BOX), "coordinate": (TEXTS, [0.9, 0.9], [GOOD[0], [40, None, 500, 150]], pages.NO_BOX), "no score": (TEXTS, [0.9, None], GOOD, pages.NO_SCORE),
    "fewer": (TEXTS, [0.9], GOOD, pages.MISALIGNED), "no texts": (None, [0.9], [GOOD[0]], pages.MISSING), "no scores": (TEXTS, None, GOOD, pages.MISSING), "no boxes": (TEXTS, [0.9, 0.9], None, pages.MISSING),
    "null text": ([*TEXTS, None], [0.9] * 3, [*GOOD, None], None), "blank text": ([*TEXTS, " "], [0.9] * 3, [*GOOD, [1]], None), "low score": ([*TEXTS, "x"], [0.9, 0.9, 0.1], [*GOOD, [1, 2]], None), "nothing": ([], [], [], None),
}


@pytest.fixture(scope="module")
def flawed(spark):
    return spark.createDataFrame([(k, t, s, b, [], 0) for k, (t, s, b, _) in CASES.items()], RAW_OCR)


def test_each_flaw_is_a_row_of_its_own(flawed):
    got = {r["doc_id"]: r for r in documents.parse_documents(flawed).collect()}
    assert {k: r["error"] for k, r in got.items()} == {k: e for k, (*_, e) in CASES.items()}
    want = {"authority": "郑州市公安局", "valid_date": "2001.02.03-长期"}
    for k in ("good", "null text", "blank text", "low score"):
        assert got[k]["doc_type"] == "id_back" and json.loads(got[k]["data"]) == want
    assert all(r["doc_type"] == "unknown" and r["data"] is None for r in got.values() if r["error"])
    envelopes = {r["doc_id"]: json.loads(r["response"]) for r in documents.to_envelope(documents.parse_documents(flawed)).collect()}
    assert envelopes["short"] == {"code": 500, "msg": pages.NO_BOX, "data": None} and envelopes["good"]["data"] == want


def test_lines_of_flawed_pages(flawed):
    """The flat table has the whole lines of every page, and each place once."""
    got = {}
    for r in pages.build_lines(flawed).collect():
        got.setdefault(r["doc_id"], []).append(r["line_no"])
    assert got["good"] == [0, 1] and got["short"] == [0] and got["no box"] == [1] and got["no score"] == [0] and got["fewer"] == [0] and "no texts" not in got and "no boxes" not in got
    boxes = flawed.filter("doc_id = 'good'").withColumn("boxes", F.lit([[40.9, 1.2, 3e12, 70.0], [-40.9, float("nan"), 5.0, 6.0]]).cast("array<array<double>>"))
    assert documents.parse_documents(boxes).first()["error"] == pages.NO_BOX
    whole = boxes.withColumn("boxes", F.lit([[40.9, 1.2, 3.0, 70.0], [-40.9, 9.0, 5.0, 6.0]]).cast("array<array<double>>"))
    assert [(r["left"], r["top"]) for r in pages.build_lines(whole).orderBy("line_no").collect()] == [(40, 1), (-40, 9)]


def write(spark, path, flawed, more=()):
    lines = [r["v"] for r in flawed.select(F.to_json(F.struct("*")).alias("v")).collect()] + list(more)
    spark.createDataFrame([(x,) for x in lines], "value string").repartition(5).write.mode("append").text(str(path))


BROKEN = ['{"doc_id": "cut", "texts": ["签', "no json", '{"doc_id": "typed", "texts": 5, "scores": [0.9], "boxes": [[1, 2, 3, 4]]}']


def test_broken_records_keep_their_text(spark, flawed, tmp_path):
    write(spark, tmp_path / "in", flawed, BROKEN)
    got = documents.parse_documents(sources.read_ocr_json(spark, str(tmp_path / "in"))).collect()
    assert len(got) == len(CASES) + 3
    bad = {r["record"]: r for r in got if r["record"] is not None}
    assert set(bad) == set(BROKEN) and all(r["error"] == pages.NOT_READ and r["data"] is None for r in bad.values())
    assert bad[BROKEN[2]]["doc_id"] == "typed" and bad[BROKEN[0]]["doc_id"] is None
    assert {r["doc_id"]: r["error"] for r in got if r["record"] is None} == {k: e for k, (*_, e) in CASES.items()}


def typed(spark, path):
    return {k: spark.read.parquet(f"{path}/{k}") for k in ("id_front", "id_back", "business_license", "unknown", "failed")}


def test_flaws_in_a_stream(spark, flawed, tmp_path):
    write(spark, tmp_path / "in", flawed, BROKEN)
    streaming.stream_parse(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c"), available_now=True, files_per_trigger=2).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == len(CASES) + 3 and sum(r["error"] is not None for r in got) == sum(e is not None for *_, e in CASES.values()) + 3


@pytest.mark.parametrize("breaks_at", [(0, "id_back"), (2, "failed")])
def test_a_stream_that_breaks_off_has_every_document_once(spark, flawed, tmp_path, monkeypatch, breaks_at):
    """A batch fails after it has written some of its tables; the stream is started again from its checkpoint, and more files come."""
    write(spark, tmp_path / "in", flawed, BROKEN)
    at = [str(tmp_path / x) for x in ("in", "out", "c")]
    plain = sources.write_typed

    def breaking(tables, path, batch_id=None):
        if batch_id == breaks_at[0]:
            kinds = list(tables)
            plain({k: tables[k] for k in kinds[: kinds.index(breaks_at[1]) + 1]}, path, batch_id)
            raise RuntimeError("lost")
        plain(tables, path, batch_id)

    monkeypatch.setattr(streaming, "write_typed", breaking)
    with pytest.raises(Exception, match="lost"):
        streaming.stream_typed(spark, *at, available_now=True, files_per_trigger=2).awaitTermination()
    monkeypatch.setattr(streaming, "write_typed", plain)
    write(spark, tmp_path / "in", flawed.limit(0), ['{"doc_id": "late", "texts": ["x"], "scores": [0.9], "boxes": [[1, 2, 3, 4]]}'])
    for _ in range(2):
        streaming.stream_typed(spark, *at, available_now=True, files_per_trigger=2).awaitTermination()
    got = typed(spark, at[1])
    ids = sorted(str(r["doc_id"]) for t in got.values() for r in t.select("doc_id").collect())
    assert ids == sorted([*CASES, "None", "None", "typed", "late"])
    assert {r["doc_id"] for r in got["id_back"].collect()} == {"good", "null text", "blank text", "low score"}
    failed = {r["record"]: r["error"] for r in got["failed"].collect() if r["record"]}
    assert failed == dict.fromkeys(BROKEN, pages.NOT_READ)
