"""The registered queries: one for each operator, over whole tables, with the SQL that each is held against."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..functions import layout as L
from ..functions import text as T
from ..operators import documents, id_cards, images, letters, licence, lines, pages
from ..streaming import stream_parse, stream_typed
from . import fixtures, sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, query: Query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle is not None:
        ORACLE_SQL[name] = oracle


def shared_folder(spark: SparkSession) -> str:
    """A new folder where all executors see it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{named}/{uuid.uuid4().hex}"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.build_lines(fixtures.raw_ocr(spark, sf_dir))


def _layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.to_layouts(fixtures.raw_ocr(spark, sf_dir))


def _on_documents(columns: Callable[[], dict[str, Column]]) -> Query:
    return lambda s, d: fixtures.table(s, d, "documents").select("doc_id", *[c.alias(k) for k, c in columns().items()])


def _on_customers(columns: Callable[[], dict[str, Column]]) -> Query:
    return lambda s, d: fixtures.customers(s, d).select("k", *[c.alias(k) for k, c in columns().items()])


# sources and sinks
add("s02_suffix_of", lambda s, d: fixtures.table(s, d, "pages").select("page_id", T.suffix_of("url").alias("suffix")), "SELECT page_id, lower(string_split(url, '.')[-1]) AS suffix FROM pages")


def s01_read_ocr_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of all documents, written as JSON and read again by the schema."""
    at = shared_folder(spark)
    fixtures.raw_ocr(spark, sf_dir).write.json(at)
    return sources.read_ocr_json(spark, at).select("doc_id", F.size("texts").alias("n_texts"), F.size("scores").alias("n_scores"), F.array_join("texts", "|").alias("texts"), F.element_at("boxes", 1)[1].alias("first_top"))


add("s01_read_ocr_json", s01_read_ocr_json, sql.lines("SELECT doc_id, CAST(count(*) AS INT) AS n_texts, CAST(count(*) FILTER (has_score) AS INT) AS n_scores, string_agg(raw, '|' ORDER BY line_no) AS texts, min(t) FILTER (line_no = 0) AS first_top FROM sized GROUP BY 1"))


def s01_broken_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of JSON, some cut off and some of another type than the schema's, parsed: those that can't be read are told so, with their text."""
    at = shared_folder(spark)
    fixtures.cut_json(spark, sf_dir).write.text(at)
    return documents.parse_documents(sources.read_ocr_json(spark, at))


add("s01_broken_records", s01_broken_records, f"""
WITH j AS (SELECT c_custkey AS k, '{{"doc_id":"j' || c_custkey || '","texts":' || CASE WHEN c_custkey % 5 = 1 THEN '"none"' ELSE '["签发机关甲","有效期限长期"]' END || ',"scores":[0.9,0.8],"boxes":[[1,2,30,40],[1,50,30,90]],"angle":0}}' AS line FROM customer)
SELECT CASE WHEN k % 5 <> 0 THEN 'j' || k END AS doc_id, CASE WHEN k % 5 < 2 THEN 'unknown' ELSE 'id_back' END AS doc_type, CASE WHEN k % 5 >= 2 THEN '{{"authority":"甲","valid_date":""}}' END AS data,
    CASE WHEN k % 5 < 2 THEN '{pages.NOT_READ}' END AS error, CASE k % 5 WHEN 0 THEN substr(line, 1, 20 + k % 31) WHEN 1 THEN line END AS record FROM j""")


def s02_filter_supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by their names' suffixes: as they are, and whatever their case."""
    held = fixtures.table(spark, sf_dir, "pages").select("page_id", F.concat("url", F.when(F.col("page_id") % 4 == 0, ".pdf").when(F.col("page_id") % 4 == 1, ".PDF").when(F.col("page_id") % 4 == 2, ".exe").otherwise("")).alias("name"))
    out = []
    for lower in (True, False):
        kept, rest = pages.filter_supported(held, "name", ("pdf",), lower)
        out += [kept.select("page_id", F.lit(lower).alias("any_case"), F.lit(True).alias("supported")), rest.select("page_id", F.lit(lower).alias("any_case"), F.lit(False).alias("supported"))]
    return reduce(DataFrame.unionByName, out)


add("s02_filter_supported", s02_filter_supported, """
WITH n AS (SELECT page_id, url || ['.pdf', '.PDF', '.exe', ''][CAST(page_id % 4 + 1 AS INT)] AS name FROM pages), s AS (SELECT page_id, string_split(name, '.')[-1] AS suffix FROM n)
SELECT page_id, true AS any_case, coalesce(lower(suffix) = 'pdf', false) AS supported FROM s UNION ALL SELECT page_id, false, coalesce(suffix = 'pdf', false) FROM s""")


def s06_write_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed tables written and read again: how many rows of each type."""
    at = shared_folder(spark)
    sources.write_classified(pages.classify(pages.read_documents(fixtures.all_documents(spark, sf_dir))), f"{at}/classified")
    tables = documents.parse_layouts(spark.read.parquet(f"{at}/classified"))  # each parser reads the folder of its type
    sources.write_typed(tables, at)
    return _counted(spark, at)


def _counted(spark: SparkSession, at: str) -> DataFrame:
    """How many rows the typed tables under a folder have."""
    kinds = (pages.ID_FRONT, pages.ID_BACK, pages.LICENCE, pages.UNKNOWN, documents.FAILED)
    rows = [spark.read.parquet(f"{at}/{k}").select(F.lit(k).alias("doc_type")) for k in kinds]
    return reduce(DataFrame.union, rows).groupBy("doc_type").agg(F.count("*").alias("n"))


KINDS = f"""WITH {sql.LINES}, {sql.CUSTOMERS}, kinds AS (
    SELECT 'f' || k AS doc_id, 'id_front' AS doc_type FROM c UNION ALL SELECT 'b' || k, 'id_back' FROM c UNION ALL SELECT 'l' || k, 'business_license' FROM c
    UNION ALL SELECT DISTINCT doc_id, 'unknown' FROM raw UNION ALL SELECT 'o' || k, CASE WHEN k % 8 IN (5, 6) THEN 'id_back' ELSE 'unknown' END FROM c)"""
#: What parse_documents gives for all documents, as SQL.
PARSED = f"""
WITH {sql.LINES}, {sql.CUSTOMERS}, f AS ({sql.FRONT}), k AS ({sql.BACK}), li AS ({sql.LICENCE}), pg AS (SELECT DISTINCT doc_id, d FROM raw),
un AS (SELECT pg.doc_id, pg.d, coalesce(list(ln.text ORDER BY t, l, line_no) FILTER (ln.text IS NOT NULL), []) AS texts FROM pg LEFT JOIN ln ON ln.doc_id = pg.doc_id GROUP BY 1, 2), parsed AS (
SELECT doc_id, 'id_front' AS doc_type, CAST(to_json({{'name': name, 'gender': gender, 'nation': nation, 'birthday': birthday, 'address': address, 'id_number': id_number}}) AS VARCHAR) AS data, CAST(NULL AS VARCHAR) AS error FROM f
UNION ALL SELECT doc_id, 'id_back', CAST(to_json({{'authority': authority, 'valid_date': valid_date}}) AS VARCHAR), NULL FROM k
UNION ALL SELECT doc_id, 'business_license', CAST(to_json({{{', '.join(f"'{x}': {x}" for x in licence.FIELDS)}}}) AS VARCHAR), NULL FROM li
UNION ALL SELECT doc_id, 'unknown', CASE WHEN d % 5 <> 0 THEN CAST(to_json({{'type': 'unknown', 'error': '{documents.NOT_RECOGNISED}', 'raw_texts': texts}}) AS VARCHAR) END, CASE WHEN d % 5 = 0 THEN '{documents.MISALIGNED}' END FROM un
UNION ALL SELECT 'o' || k, CASE WHEN k % 8 IN (5, 6) THEN 'id_back' ELSE 'unknown' END, CASE WHEN k % 8 IN (5, 6) THEN
    CAST(to_json({{'authority': '郑州市公安局', 'valid_date': (2000 + k % 20) || '.' || lpad(CAST(m AS VARCHAR), 2, '0') || '.' || lpad(CAST(d AS VARCHAR), 2, '0') || '-长期'}}) AS VARCHAR) END,
    CASE k % 8 WHEN 4 THEN '{pages.NO_SCORE}' WHEN 5 THEN NULL WHEN 6 THEN NULL WHEN 7 THEN '{pages.MISSING}' ELSE '{pages.NO_BOX}' END FROM c)"""
TYPED = f"{PARSED} SELECT CASE WHEN error IS NULL THEN doc_type ELSE '{documents.FAILED}' END AS doc_type, count(*) AS n FROM parsed GROUP BY 1"
add("s06_write_typed", s06_write_typed, TYPED)
add("s05_envelope", lambda s, d: documents.to_envelope(documents.parse_documents(fixtures.all_documents(s, d))), f"""{PARSED}
SELECT doc_id, CASE WHEN error IS NULL THEN '{{"code":0,"msg":"success","data":' || data || '}}' ELSE '{{"code":500,"msg":"' || error || '","data":null}}' END AS response FROM parsed""")

# cleaning
WS = r"[\s\v\x{85}\p{Z}]"


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def clean_sql(x: str) -> str:
    return strip_sql(f"replace(replace(translate(coalesce({x}, ''), '：（）', ':()'), ' ', ''), '　', '')")


def post_sql(x: str) -> str:
    a = strip_sql(f"regexp_replace(coalesce({x}, ''), '{WS}+', ' ', 'g')")
    b = strip_sql(f"""regexp_replace(regexp_replace({a}, '^"+|"+$', '', 'g'), '^''+|''+$', '', 'g')""")
    c = f"""translate({b}, '；。【】「」‘’“”', ';.[]()''''""')"""
    return f"CASE WHEN regexp_matches({c}, '[0-9A-Za-z]{{15,}}') THEN {c} ELSE translate({c}, '淹祭', '渑商') END"


def _joined_page(c: str) -> list[Column]:
    return [F.size(c).cast("long").alias("n"), F.array_join(c, "|").alias("joined")]


PAGE_OF = "pg AS (SELECT DISTINCT doc_id FROM raw)"
KEPT = "SELECT pg.doc_id, count(z.line_no) AS n, coalesce(string_agg({0}, '|' ORDER BY z.line_no), '') AS joined FROM pg LEFT JOIN (SELECT * FROM sized WHERE has_score AND score >= 0.7) z ON z.doc_id = pg.doc_id GROUP BY 1"
add("p01_filter_by_score", lambda s, d: pages.filter_by_score(fixtures.raw_ocr(s, d)).select("doc_id", *_joined_page("texts")), f"WITH {sql.LINES}, {PAGE_OF} " + KEPT.format("z.raw"))
add("p02_build_lines", _lines, sql.lines('SELECT doc_id, line_no, text, l AS "left", t AS top, r AS "right", b AS bottom, score FROM ln'))
add("p03_with_geometry", lambda s, d: lines.with_geometry(_lines(s, d)).select("doc_id", "line_no", "width", "height", "center_x", "center_y"), sql.lines("SELECT doc_id, line_no, r - l AS width, b - t AS height, cx AS center_x, cy AS center_y FROM ln"))
add("p04_postprocess_text", _on_documents(lambda: dict(cleaned=T.postprocess_text("text"))), f"SELECT doc_id, {post_sql('text')} AS cleaned FROM documents")
add("p05_looks_like_code", _on_documents(lambda: dict(is_code=T.looks_like_code("text"))), "SELECT doc_id, regexp_matches(coalesce(text, ''), '[0-9A-Za-z]{15,}') AS is_code FROM documents")
add("p06_clean_text", _on_documents(lambda: dict(cleaned=T.clean_text("text"))), f"SELECT doc_id, {clean_sql('text')} AS cleaned FROM documents")
add("p07_extract_after", _on_documents(lambda: dict(rest=T.extract_after("text", "an"))), f"SELECT doc_id, CASE WHEN contains(t, 'an') THEN {strip_sql('substr(t, instr(t, ' + chr(39) + 'an' + chr(39) + ') + 2)')} ELSE '' END AS rest FROM (SELECT doc_id, {clean_sql('text')} AS t FROM documents)")
add("p08_extract_before", _on_documents(lambda: dict(head=T.extract_before("text", "an"))), f"SELECT doc_id, CASE WHEN contains(t, 'an') THEN {strip_sql('substr(t, 1, instr(t, ' + chr(39) + 'an' + chr(39) + ') - 1)')} ELSE '' END AS head FROM (SELECT doc_id, {clean_sql('text')} AS t FROM documents)")
add("p09_regex_first", _on_documents(lambda: dict(number=T.regex_first("text", "[0-9]{4,}"), after=T.regex_first("text", "@([a-z0-9]+)", 1))), f"SELECT doc_id, regexp_extract(t, '[0-9]{{4,}}') AS number, regexp_extract(t, '@([a-z0-9]+)', 1) AS after FROM (SELECT doc_id, {clean_sql('text')} AS t FROM documents)")
add("p10_contains_blank", _on_documents(lambda: dict(holds=T.contains_clean("text", "ofthe"), blank=T.is_blank("text"))), f"SELECT doc_id, contains(t, 'ofthe') AS holds, t = '' AS blank FROM (SELECT doc_id, {clean_sql('text')} AS t FROM documents)")
add("p11_postprocess_lines", lambda s, d: pages.postprocess_lines(fixtures.raw_ocr(s, d)).select("doc_id", *_joined_page("texts")), f"WITH {sql.LINES} SELECT doc_id, count(*) AS n, string_agg({post_sql('raw')}, '|' ORDER BY line_no) AS joined FROM raw GROUP BY 1")
add("p12_clean_ocr", lambda s, d: pages.clean_ocr(fixtures.raw_ocr(s, d)).select("doc_id", *_joined_page("texts")), f"WITH {sql.LINES}, {PAGE_OF} " + KEPT.format(post_sql("z.raw")))

# reading order and neighbours
WORD = "the"
ONE = ("doc_id", "line_no", "text")
PAIR = ("doc_id", "anchor_line_no", "line_no", "text")


def _anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their first line that holds the word, by the nested forms: a page is a row, nothing is shuffled."""
    return _layouts(spark, sf_dir).select("doc_id", "lines", L.find(F.col("lines"), WORD).alias("a")).filter("a is not null")


def _around(op: Callable[[Column, Column], Column], one: bool = False, ranked: bool = False) -> Query:
    """The lines that op finds around each page's anchor, or the one that it finds."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = op(F.col("lines"), F.col("a"))
        each = F.posexplode(F.array(found) if one else found).alias("i", "x")
        rank = [(F.col("i") + 1).alias("rank")] if ranked else []
        return _anchored(spark, sf_dir).select("doc_id", F.col("a.line_no").alias("anchor_line_no"), each).filter("x is not null").select("doc_id", "anchor_line_no", "x.line_no", "x.text", *rank)

    return query


def _flat(op: Callable[..., DataFrame]) -> Query:
    """The same by the flat forms, on the table of lines."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        held = _lines(spark, sf_dir)
        return op(held, lines.find(held, WORD)).select(*PAIR)

    return query


def _every(spark: SparkSession, sf_dir: str, where: str) -> DataFrame:
    """The nearest line of every line of each page."""
    found = L.nearest_of_every_line(F.col("lines"), where)
    return _layouts(spark, sf_dir).select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.*")


add("l01_reading_order", lambda s, d: lines.reading_order(_lines(s, d)).select("doc_id", "line_no", "place"), sql.lines("SELECT doc_id, line_no, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY t, l, line_no) AS INT) AS place FROM ln"))
add("l02_full_text", lambda s, d: lines.full_text(_lines(s, d)), sql.lines("SELECT doc_id, string_agg(text, '' ORDER BY t, l, line_no) AS full_text FROM ln GROUP BY 1"))
add("l02_full_text_nested", lambda s, d: _layouts(s, d).filter(F.size("lines") > 0).select("doc_id", L.full_text(F.col("lines")).alias("full_text")), ORACLE_SQL["l02_full_text"])
add("l03_find", lambda s, d: lines.find(_lines(s, d), WORD).select(*ONE), sql.lines("SELECT doc_id, line_no, text FROM anchor"))
add("l04_find_any", lambda s, d: lines.find_any(_lines(s, d), "und", "que", "of").select(*ONE), sql.lines("""
SELECT doc_id, line_no, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY kw, t, l, line_no) AS n FROM (
    SELECT *, 0 AS kw FROM ln WHERE contains(text, 'und') UNION ALL SELECT *, 1 FROM ln WHERE contains(text, 'que') UNION ALL SELECT *, 2 FROM ln WHERE contains(text, 'of'))) WHERE n = 1"""))
add("l05_find_all", lambda s, d: lines.find_all(_lines(s, d), WORD).select(*ONE), sql.lines("SELECT doc_id, line_no, text FROM ln WHERE contains(text, 'the')"))
add("l06_same_row", _around(L.same_row), sql.met("abs(cy - acy) <= 20"))
add("l07_right_of", _around(L.right_of), sql.met("l > ar AND abs(cy - acy) <= 20"))
add("l08_left_of", _around(L.left_of), sql.met("r < al AND abs(cy - acy) <= 20"))
add("l06_same_row_flat", _flat(lines.same_row), ORACLE_SQL["l06_same_row"])
add("l11_nearest_below_flat", _flat(lines.nearest_below), sql.nearest("t > ab", "t - ab, abs(l - al)"))
EVERY = "SELECT doc_id, anchor_line_no, line_no, text FROM (SELECT x.*, a.line_no AS anchor_line_no, row_number() OVER (PARTITION BY x.doc_id, a.line_no ORDER BY {order}, x.t, x.l, x.line_no) AS n FROM ln x JOIN ln a ON x.doc_id = a.doc_id AND {where}) WHERE n = 1"
for _name, _where, _order in (("below", "x.t > a.b", "x.t - a.b, abs(x.l - a.l)"), ("above", "x.b < a.t", "a.t - x.b, abs(x.l - a.l)"), ("right", "x.l > a.r AND abs(x.cy - a.cy) <= 20", "x.l")):
    add({"below": "l11_every_nearest_below", "above": "l12_every_nearest_above", "right": "l13_every_nearest_right"}[_name], lambda s, d, w=_name: _every(s, d, w), sql.lines(EVERY.format(where=_where, order=_order)))
add("l09_below", _around(L.below), sql.met("t > ab"))
add("l10_above", _around(L.above), sql.met("b < aty"))
add("l11_nearest_below", _around(L.nearest_below, one=True), sql.nearest("t > ab", "t - ab, abs(l - al)"))
add("l12_nearest_above", _around(L.nearest_above, one=True), sql.nearest("b < aty", "aty - b, abs(l - al)"))
add("l13_nearest_right", _around(L.nearest_right, one=True), sql.nearest("l > ar AND abs(cy - acy) <= 20", "l"))
add("l14_find_exact", lambda s, d: _layouts(s, d).select("doc_id", L.find_exact(F.col("lines"), "of", "de", "und").alias("x")).filter("x is not null").select("doc_id", "x.line_no", "x.text"), sql.lines("SELECT doc_id, line_no, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY t, l, line_no) AS n FROM ln WHERE text IN ('of', 'de', 'und')) WHERE n = 1"))
add("l15_find_contains", lambda s, d: _layouts(s, d).select("doc_id", L.find_contains(F.col("lines"), "und", "que", "of").alias("x")).filter("x is not null").select("doc_id", "x.line_no", "x.text"), sql.lines("SELECT doc_id, line_no, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY t, l, line_no) AS n FROM ln WHERE regexp_matches(text, 'und|que|of')) WHERE n = 1"))
add("l16_same_row_right", _around(lambda x, a: L.same_row_right(x, a, 20)), sql.met("line_no <> anchor_line_no AND abs(cy - acy) <= 20 AND cx > acx AND r > al"))
add("l17_blocks_below", _around(lambda x, a: L.blocks_below(x, a, a["bottom"] + 100, a["left"], a["right"], 5), ranked=True), sql.lines("SELECT doc_id, anchor_line_no, line_no, text, CAST(n AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, anchor_line_no ORDER BY t, l, line_no) AS n FROM met WHERE t >= ab AND t < ab + 100 AND l < ar AND r > al) WHERE n <= 5"))


def l18_boundary_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = F.lit(1 << 30)
    bound = L.boundary_top(F.col("lines"), F.col("a.top"), ("on",), -wide, wide, F.array_max(F.transform("lines", lambda x: x["bottom"])))
    return _anchored(spark, sf_dir).select("doc_id", F.col("a.line_no").alias("anchor_line_no"), bound.alias("bound"))


add("l18_boundary_top", l18_boundary_top, sql.lines("SELECT doc_id, anchor_line_no, least(coalesce(min(t) FILTER (t > aty AND contains(text, 'on')), max(b)), max(b)) AS bound FROM met GROUP BY 1, 2"))


def l19_row_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands to the right of the first line with the word, up to a gap over 60."""
    a = L.find(F.col("lines"), WORD)
    parts = L.row_sequence(L.same_row_right(F.col("lines"), a, 12), F.lit(60))
    return _layouts(spark, sf_dir).filter(a.isNotNull()).select("doc_id", F.array_join(F.transform(parts, lambda p: p["text"]), "|").alias("joined"))


add("l19_row_sequence", l19_row_sequence, sql.lines("""
, s AS (SELECT * FROM met WHERE line_no <> anchor_line_no AND abs(cy - acy) <= 12 AND cx > acx AND r > al),
g AS (SELECT *, CASE WHEN l - lag(r) OVER (PARTITION BY doc_id ORDER BY l, t, line_no) > 60 THEN 1 ELSE 0 END AS brk FROM s),
k AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY l, t, line_no) AS island FROM g)
SELECT a.doc_id, coalesce(string_agg(k.text, '|' ORDER BY k.l, k.t, k.line_no), '') AS joined FROM anchor a LEFT JOIN (SELECT * FROM k WHERE island = 0) k ON k.doc_id = a.doc_id GROUP BY 1""").replace(") \n\n,", "),").replace("USING (doc_id))\n \n,", "USING (doc_id)),"))


def l19_row_sequence_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on the flat table of lines."""
    held = _lines(spark, sf_dir)
    anchors = lines.find(held, WORD)
    parts = lines.row_sequence(lines.same_row_right(held, anchors, 12), 60)
    found = lines.joined(parts, ("left", "top", "line_no"), "|")
    return anchors.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("joined", F.lit("")).alias("joined"))


add("l19_row_sequence_flat", l19_row_sequence_flat, ORACLE_SQL["l19_row_sequence"])
add("l20_row_value_by_label", lambda s, d: pages.to_layouts(fixtures.licences(s, d)).withColumn("m", L.doc_metrics(F.col("lines"))).select("doc_id", licence.row_value(F.col("lines"), ("注册资本", "注册资金"), T.looks_like_capital).alias("value")), f"SELECT doc_id, capital AS value FROM ({sql.LICENCE})")
METRICS = sql.lines("SELECT doc_id, max(r) AS doc_width, max(b) AS doc_height, CAST(trunc(median(greatest(1, b - t))) AS INT) AS base_h FROM ln GROUP BY 1")
add("l21_doc_metrics", lambda s, d: _layouts(s, d).filter(F.size("lines") > 0).select("doc_id", L.doc_metrics(F.col("lines")).alias("m")).select("doc_id", F.col("m.width").alias("doc_width"), F.col("m.height").alias("doc_height"), "m.base_h"), METRICS)
add("a09_doc_metrics", lambda s, d: lines.doc_metrics(_lines(s, d)), METRICS)


def _paged(rows: DataFrame) -> DataFrame:
    """Pages, or lines, of whole documents, of many pages each under one id."""
    part = lambda k: F.substring_index("doc_id", "-", k)
    return rows.withColumns({"page": part(-1).cast("int"), "doc_id": part(1)})


SCANS = f"{sql.LINES}, sc AS (SELECT string_split(doc_id, '-')[1] AS doc_id, CAST(string_split(doc_id, '-')[2] AS INT) AS page, line_no, t, l, r, b FROM ln)"
add("l01_reading_order_of_pages", lambda s, d: lines.reading_order_of_layouts(_paged(_layouts(s, d)), "line_no"), f"WITH {SCANS} SELECT doc_id, page, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY page, t, l, line_no) AS place FROM sc")
add("a09_metrics_of_scans", lambda s, d: lines.doc_metrics(_paged(_lines(s, d))), f"WITH {SCANS} SELECT doc_id, max(r) AS doc_width, max(b) AS doc_height, CAST(trunc(median(greatest(1, b - t))) AS INT) AS base_h FROM sc GROUP BY 1")
add("l06_all_pairs_same_row", lambda s, d: lines.all_pairs_same_row(_lines(s, d)).groupBy("doc_id").agg(F.count("*").alias("pairs"), F.sum(F.col("a") * F.col("b")).cast("long").alias("checksum")), sql.lines("SELECT x.doc_id, count(*) AS pairs, CAST(sum(x.line_no * y.line_no) AS BIGINT) AS checksum FROM ln x JOIN ln y ON x.doc_id = y.doc_id AND x.line_no <> y.line_no AND abs(x.cy - y.cy) <= 20 GROUP BY 1"))

# classification and dispatch
add("d01_detect", lambda s, d: pages.classify(pages.to_layouts(fixtures.all_documents(s, d))).select("doc_id", "doc_type"), f"{KINDS} SELECT * FROM kinds")
add("d02_parse_documents", lambda s, d: documents.parse_documents(fixtures.all_documents(s, d)), f"{PARSED} SELECT * FROM parsed")
add("d03_unknown_documents", lambda s, d: documents.unknown_documents(pages.classify(pages.to_layouts(fixtures.all_documents(s, d)))).select("doc_id", "type", "error", F.array_join("raw_texts", "|").alias("joined")), f"WITH {sql.LINES}, {PAGE_OF} SELECT pg.doc_id, 'unknown' AS type, '{documents.NOT_RECOGNISED}' AS error, coalesce(string_agg(text, '|' ORDER BY t, l, line_no), '') AS joined FROM pg LEFT JOIN ln ON ln.doc_id = pg.doc_id GROUP BY 1 UNION ALL SELECT 'o' || c_custkey, 'unknown', '{documents.NOT_RECOGNISED}', CASE WHEN c_custkey % 8 = 7 THEN '' ELSE '签发机关郑州市公安局|无' END FROM customer WHERE c_custkey % 8 NOT IN (5, 6)")

# dates, codes, addresses, names
def f01_normalize_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, y, m, d = F.col("o_orderkey"), F.year("o_orderdate").cast("string"), F.month("o_orderdate").cast("string"), F.dayofmonth("o_orderdate").cast("string")
    two = lambda x: F.lpad(x, 2, "0")
    shown = F.when(k % 5 == 0, F.concat(y, F.lit("年"), m, F.lit("月"), d, F.lit("日"))).when(k % 5 == 1, F.concat(y, two(m), two(d))).when(k % 5 == 2, F.concat_ws(".", y, m, d)).when(k % 5 == 3, F.concat(F.lit(" "), F.concat_ws("-", y, m, d))).otherwise(F.when(k % 2 == 0, "长期").otherwise(F.concat(y, F.lit("/"), m)))
    return fixtures.table(spark, sf_dir, "orders").select("o_orderkey", T.normalize_date(shown).alias("date"))


add("f01_normalize_date", f01_normalize_date, "SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN strftime(o_orderdate, '%Y.%m.%d') WHEN o_orderkey % 2 = 0 THEN '长期' ELSE '' END AS date FROM orders")


def f02_extract_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, at = F.col("o_orderkey"), F.col("o_orderdate")
    y, z, m, d = F.year(at).cast("string"), (F.year(at) + 10).cast("string"), F.month(at).cast("string"), F.dayofmonth(at).cast("string")
    dots = F.date_format(at, ".MM.dd")
    han = lambda x: F.concat(x, F.lit("年"), m, F.lit("月"), d, F.lit("日"))
    shown = F.when(k % 5 == 0, F.concat(F.lit("有效期限"), y, dots, F.lit("—"), z, dots)).when(k % 5 == 1, F.concat(han(y), F.lit("至"), han(z))).when(k % 5 == 2, F.concat(F.date_format(at, "yyyyMMdd"), z, F.date_format(at, "MMdd"))).when(k % 5 == 3, F.concat(y, F.translate(dots, ".", "．"), F.lit(" - 长期"))).otherwise(F.concat(F.lit("长期"), y, dots))
    return fixtures.table(spark, sf_dir, "orders").select("o_orderkey", T.extract_validity(shown).alias("validity"))


add("f02_extract_validity", f02_extract_validity, "SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN strftime(o_orderdate, '%Y.%m.%d') || '-' || (year(o_orderdate) + 10) || strftime(o_orderdate, '.%m.%d') WHEN o_orderkey % 5 = 3 THEN strftime(o_orderdate, '%Y.%m.%d-长期') ELSE '' END AS validity FROM orders")


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.licences(spark, sf_dir).select("doc_id", F.element_at("texts", 2).alias("shown"))


add("f03_uscc_check_digit", lambda s, d: _codes(s, d).select("doc_id", T.uscc_check_digit(F.substring("shown", 1, 17)).alias("digit")), f"WITH {sql.CODES} SELECT 'l' || k AS doc_id, CASE WHEN v = 2 OR v = 1 AND contains(substr(body, 3, 6), '0') THEN NULL ELSE digit END AS digit FROM code")
add("f04_is_valid_uscc", lambda s, d: _codes(s, d).select("doc_id", T.is_valid_uscc("shown").alias("valid")), f"WITH {sql.CODES} SELECT 'l' || k AS doc_id, v = 0 OR v = 1 AND NOT contains(substr(body, 3, 6), '0') AS valid FROM code")
add("f05_fix_credit_code", lambda s, d: _codes(s, d).select("doc_id", T.fix_credit_code("shown").alias("code")), f"SELECT doc_id, credit_code AS code FROM ({sql.LICENCE})")
def _k() -> Column:
    return F.col("k")


def _han_name() -> Column:
    return F.concat(F.lit("王"), F.col("han"))



add("f06_strip_label", _on_customers(lambda: dict(value=T.strip_label(F.when(_k() % 3 == 0, F.concat(F.lit("名称：:"), _han_name())).when(_k() % 3 == 1, F.concat(F.lit("前名称 "), _han_name())).otherwise(F.concat(F.lit(" "), _han_name())), "名称", "名"))), f"WITH {sql.CUSTOMERS} SELECT k, CASE WHEN k % 3 = 1 THEN '前 ' ELSE '' END || '王' || han AS value FROM c")
add("f07_is_label_like", _on_customers(lambda: dict(label=T.is_label_like(F.when(_k() % 4 == 0, " 类型 ").when(_k() % 4 == 1, "住").when(_k() % 4 == 2, "住 所").otherwise(F.col("han"))))), f"WITH {sql.CUSTOMERS} SELECT k, k % 4 < 2 AS label FROM c")
add("f08_is_person_name", _on_customers(lambda: dict(person=T.is_person_name(F.when(_k() % 4 == 0, _han_name()).when(_k() % 4 == 1, F.concat(_han_name(), F.lit("路"))).when(_k() % 4 == 2, F.concat(_han_name(), F.lit("8"))).otherwise("王")))), f"WITH {sql.CUSTOMERS} SELECT k, k % 4 = 0 AS person FROM c")
add("f09_is_date_text", _on_customers(lambda: dict(is_date=T.is_date_text(F.when(_k() % 3 == 0, F.col("birth")).otherwise(F.concat(F.col("vy"), F.lit("年"), F.col("vm2"), F.lit("月"), F.col("vd2"), F.lit("日"), F.when(_k() % 3 == 1, "").otherwise("起")))))), f"WITH {sql.CUSTOMERS} SELECT k, CASE k % 3 WHEN 0 THEN m >= 10 AND d >= 10 WHEN 1 THEN true ELSE false END AS is_date FROM c")
add("f10_looks_like_capital", _on_customers(lambda: dict(capital=T.looks_like_capital(F.when(_k() % 4 == 0, F.concat(F.lit("人民币"), _k().cast("string"))).when(_k() % 4 == 1, "伍佰万元").when(_k() % 4 == 2, "2019年06月24日").otherwise("无")))), f"WITH {sql.CUSTOMERS} SELECT k, k % 4 < 2 AS capital FROM c")


def _address() -> Column:
    return F.when(_k() % 5 == 0, F.concat(F.lit("*a斤金水路"), F.col("han"), F.lit("号"))).when(_k() % 5 == 1, F.concat(F.lit("斤省"), F.col("han"))).when(_k() % 5 == 2, F.concat(_k().cast("string"), F.lit("号"))).when(_k() % 5 == 3, F.concat(F.lit(" 分东风渠北 "), _k().cast("string"))).otherwise("x")


CLEANED = "CASE k % 5 WHEN 0 THEN '金水路' || han || '号' WHEN 1 THEN '斤省' || han WHEN 2 THEN k || '号' WHEN 3 THEN '东风渠北 ' || k ELSE '' END"
add("f11_clean_address", _on_customers(lambda: dict(address=T.clean_address(_address()))), f"WITH {sql.CUSTOMERS} SELECT k, {CLEANED} AS address FROM c")
add("f12_looks_like_address", _on_customers(lambda: dict(is_address=T.looks_like_address(_address()))), f"WITH {sql.CUSTOMERS} SELECT k, CASE k % 5 WHEN 0 THEN true WHEN 1 THEN length(han) >= 2 WHEN 2 THEN k >= 100 WHEN 3 THEN true ELSE false END AS is_address FROM c")


def _company() -> Column:
    return F.when(_k() % 2 == 0, F.concat(F.lit("河南省"), F.col("han"), F.lit("公司"))).otherwise(F.concat(F.col("han"), F.lit("公司")))


add("f13_province_from_name", _on_customers(lambda: dict(province=T.province_from_name(_company()))), f"WITH {sql.CUSTOMERS} SELECT k, CASE WHEN k % 2 = 0 THEN '河南省' ELSE '' END AS province FROM c")


def _code_of() -> Column:
    return F.concat(F.lit("91"), F.element_at(F.array(*map(F.lit, fixtures.DISTRICTS)), (_k() % 16 + 1).cast("int")), F.lit("MA"))


add("f14_city_from_credit_code", _on_customers(lambda: dict(city=T.city_from_credit_code(_code_of()))), f"WITH {sql.CODES} SELECT k, city FROM code")


def _fragments() -> Column:
    return F.when(_k() % 3 == 0, F.array(F.lit("郑东"), F.lit("新"))).otherwise(F.array(F.lit("郑东")))


add("f15_complete_address_prefix", _on_customers(lambda: dict(address=T.complete_address_prefix(F.when(_k() % 5 == 4, "").when(_k() % 5 == 3, "河南省郑州市一路").otherwise("一路"), _company(), _code_of(), _fragments()))), f"""
WITH {sql.CODES} SELECT k, CASE WHEN k % 5 = 4 THEN '' ELSE CASE WHEN k % 2 = 0 AND k % 5 <> 3 THEN '河南省' ELSE '' END || CASE WHEN k % 5 = 3 AND city = '郑州市' THEN '' ELSE city END || CASE WHEN k % 3 = 0 THEN '郑东新区' ELSE '' END || CASE WHEN k % 5 = 3 THEN '河南省郑州市一路' ELSE '一路' END END AS address FROM code""")
add("f16_nearby_fragments", lambda s, d: pages.to_layouts(fixtures.licences(s, d)).withColumn("m", L.doc_metrics(F.col("lines"))).select("doc_id", F.array_join(L.nearby_fragments(F.col("lines"), L.find_contains(F.col("lines"), "金水路"), F.col("m.base_h"), F.col("m.width"), F.lit(600)), "|").alias("fragments")), f"WITH {sql.CUSTOMERS} SELECT 'l' || k AS doc_id, CASE WHEN v = 3 THEN '' WHEN v = 2 THEN '一号楼' ELSE '住所|一号楼' END AS fragments FROM c")


# fields of cards, licences and letters
def _fronts(s: SparkSession, d: str) -> DataFrame:
    return id_cards.parse_id_front(pages.to_layouts(fixtures.id_fronts(s, d)))


def _backs(s: SparkSession, d: str) -> DataFrame:
    return id_cards.parse_id_back(pages.to_layouts(fixtures.id_backs(s, d)))


def _licences(s: SparkSession, d: str) -> DataFrame:
    return licence.parse_business_license(pages.to_layouts(fixtures.licences(s, d)))


def _field(table: Query, *names: str) -> Query:
    return lambda s, d: table(s, d).select("doc_id", *names)


for _name, _table, _sql, _fields in (
    ("x01_name", _fronts, sql.FRONT, ("name",)), ("x02_gender_nation", _fronts, sql.FRONT, ("gender", "nation")), ("x03_birthday", _fronts, sql.FRONT, ("birthday",)), ("x04_address", _fronts, sql.FRONT, ("address",)),
    ("x05_id_number", _fronts, sql.FRONT, ("id_number",)), ("x06_authority", _backs, sql.BACK, ("authority",)), ("x07_valid_date", _backs, sql.BACK, ("valid_date",)), ("x08_credit_code", _licences, sql.LICENCE, ("credit_code",)),
    ("x09_licence_name", _licences, sql.LICENCE, ("name",)), ("x10_type_name", _licences, sql.LICENCE, ("type_name",)), ("x11_legal_person", _licences, sql.LICENCE, ("legal_person",)), ("x12_capital", _licences, sql.LICENCE, ("capital",)),
    ("x13_establish_date", _licences, sql.LICENCE, ("establish_date",)), ("x14_address", _licences, sql.LICENCE, ("address",)), ("x15_business_scope", _licences, sql.LICENCE, ("business_scope",)),
):
    add(_name, _field(_table, *_fields), f"SELECT doc_id, {', '.join(_fields)} FROM ({_sql})")
add("x04_address_flat", lambda s, d: id_cards.address_of_lines(pages.build_lines(fixtures.id_fronts(s, d))), f"SELECT doc_id, address FROM ({sql.FRONT})")
add("x14_licence_flat", lambda s, d: licence.fields_of_lines(pages.build_lines(fixtures.licences(s, d))).select("doc_id", "address", "business_scope"), f"SELECT doc_id, address, business_scope FROM ({sql.LICENCE})")
add("x16_parse_id_front", _fronts, sql.FRONT)
add("x16_parse_id_back", _backs, sql.BACK)
add("x16_parse_business_license", _licences, sql.LICENCE)


def _page_fields(*names: str) -> Query:
    return lambda s, d: letters.parse_letter_text(fixtures.letter_pages(s, d)).select("doc_id", "page_number", *names)


def _got(pattern: str) -> str:
    return f"CASE WHEN regexp_matches(text, '{pattern}') THEN trim(regexp_extract(text, '{pattern}', 1)) END"


IDS = "regexp_extract_all(text, '([0-9Xx]{15,18})', 1)"
OWN = f"coalesce({_got('身份证号码[：:]{0,2}[_\\s]*([0-9Xx]{15,18})')}, {IDS}[1])"
X17 = f"""
WITH {sql.PAGES} SELECT CAST(k AS VARCHAR) AS doc_id, page_number, {_got('委托人[：:]{1,2}[_\\s]*([^_\\n]+)')} AS delegator, {OWN} AS delegator_id,
    {_got('住址[：:]{1,2}[_\\s]*([^_\\n]+)')} AS delegator_address, {_got('联系电话[：:]{1,2}[_\\s]*([0-9\\-]{7,15})')} AS delegator_phone,
    coalesce({_got('受托人[：:]{1,2}[_\\s]*([^_\\n]+)')}, {_got('委托.*?受托人[（(]?([^）)_\\n]+)')}, {_got('受托人([^0-9_]{2,5})')}) AS trustee,
    coalesce({_got('受托人[^\\n]*?身份证号[\\s]*([0-9Xx]{15,18})')}, CASE WHEN len({IDS}) >= 2 THEN list_filter({IDS}, lambda x: x IS DISTINCT FROM {OWN})[1] END) AS trustee_id FROM p"""
add("x17_page_fields", _page_fields("delegator", "delegator_id", "delegator_address", "delegator_phone", "trustee", "trustee_id"), X17)
add("x18_validity_period", _page_fields("validity_period.start_date", "validity_period.end_date"), f"WITH {sql.PAGES} SELECT CAST(k AS VARCHAR) AS doc_id, page_number, CASE WHEN page_number = 2 THEN o.y || '-' || lpad(CAST(o.m AS VARCHAR), 2, '0') || '-' || lpad(CAST(o.d AS VARCHAR), 2, '0') END AS start_date, CASE WHEN page_number = 2 THEN (o.y + 1) || '-' || lpad(CAST(o.m AS VARCHAR), 2, '0') || '-' || lpad(CAST(o.d AS VARCHAR), 2, '0') END AS end_date FROM p JOIN o USING (k)")
add("x19_signing_date", _page_fields("signing_date"), f"WITH {sql.PAGES} SELECT CAST(k AS VARCHAR) AS doc_id, page_number, CASE WHEN page_number = 2 THEN o.y || '-' || lpad(CAST(o.m AS VARCHAR), 2, '0') || '-' || lpad(CAST(o.d AS VARCHAR), 2, '0') END AS signing_date FROM p JOIN o USING (k)")
add("x20_parse_letter_text", _page_fields("delegator", "delegator_id", "delegator_address", "delegator_phone", "trustee", "trustee_id", "trustee_signature"), X17.replace("AS trustee_id FROM p", "AS trustee_id, CAST(NULL AS VARCHAR) AS trustee_signature FROM p"))


def _letters(s: SparkSession, d: str) -> DataFrame:
    x = letters.parse_letters(fixtures.letter_pages(s, d))
    names = ("delegator", "delegator_id", "delegator_address", "delegator_phone", "trustee", "trustee_id", "validity_period.start_date", "validity_period.end_date", "signing_date", "trustee_signature")
    return x.select("doc_id", "status", *[f"data.{n}" for n in names], F.col("metadata.pages_count").cast("int").alias("pages_count"))


def _merged(s: SparkSession, d: str) -> DataFrame:
    return letters.merge_letter_pages(letters.parse_letter_text(fixtures.letter_pages(s, d)))


add("a01_merge_letter_pages", lambda s, d: _merged(s, d).select("doc_id", "delegator", "delegator_address", "delegator_phone", "trustee", "signing_date"), f"SELECT doc_id, delegator, delegator_address, delegator_phone, trustee, signing_date FROM ({sql.LETTERS})")
def _named(rows: DataFrame) -> DataFrame:
    """Rows with a name and a size of the file that they came in."""
    return rows.withColumns({"filename": F.concat("doc_id", F.lit(".pdf")), "file_size": F.col("doc_id").cast("long") * 10})


add("a02_raw_pages", lambda s, d: letters.raw_pages(_named(fixtures.letter_pages(s, d))).select("doc_id", "filename", "file_size", "pages_count", F.array_join(F.transform("pages", lambda x: F.concat_ws(":", x["page_number"], x["char_count"], x["text"])), "|").alias("pages"), F.array_join(F.col("char_counts").cast("array<string>"), ",").alias("char_counts"), "raw_text"), f"WITH {sql.PAGES} SELECT CAST(k AS VARCHAR) AS doc_id, k || '.pdf' AS filename, CAST(k * 10 AS BIGINT) AS file_size, string_agg(page_number || ':' || length(text) || ':' || text, '|' ORDER BY page_number) AS pages, count(*) AS pages_count, string_agg(CAST(length(text) AS VARCHAR), ',' ORDER BY page_number) AS char_counts, string_agg(CASE WHEN text <> '' THEN text || chr(10) ELSE '' END, '' ORDER BY page_number) AS raw_text FROM p GROUP BY 1, 2, 3")
add("a03_letter_raw_text", lambda s, d: letters.letter_raw_text(fixtures.letter_pages(s, d)), f"WITH {sql.PAGES} SELECT CAST(k AS VARCHAR) AS doc_id, string_agg(text, chr(10) ORDER BY page_number) AS raw_text FROM p GROUP BY 1")
FLAG = "k % 7 <> 0 AND k % 2 = 1"
add("a04_letter_image_flags", lambda s, d: letters.with_image_flags(_merged(s, d)).select("doc_id", "trustee_signature", "trustee_id_front", "trustee_id_back"), f"WITH {sql.PAGES} SELECT CAST(k AS VARCHAR) AS doc_id, {', '.join(f"CASE WHEN {FLAG} THEN '{x}' END AS {n}" for x, n in zip(letters.CONFIRM, ('trustee_signature', 'trustee_id_front', 'trustee_id_back'), strict=True))} FROM o")
add("a05_postprocess_letter", lambda s, d: letters.postprocess_letter(_merged(s, d)).select("doc_id", "delegator", "delegator_id", "delegator_address", "trustee", "trustee_id"), f"SELECT doc_id, delegator, delegator_id, delegator_address, trustee, trustee_id FROM ({sql.LETTERS})")
add("a06_format_letter", lambda s, d: _letters(s, d).select("doc_id", "status", "pages_count"), f"SELECT doc_id, status, pages_count FROM ({sql.LETTERS})")
add("a07_parse_letters", _letters, sql.LETTERS)
add("a08_layout_results_summary", lambda s, d: letters.layout_results_summary(sources.parse_layout_results(_named(fixtures.layout_json(s, d)))).select("doc_id", "filename", "file_size", "pages_count", "markdown_text", F.array_join("image_names", ",").alias("image_names"), "method"), "SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, o_orderkey || '.pdf' AS filename, CAST(o_orderkey * 10 AS BIGINT) AS file_size, CAST(o_orderkey % 3 + 1 AS INT) AS pages_count, CASE WHEN o_orderkey % 10 <> 0 THEN 'p1-' || o_orderkey END AS markdown_text, CASE WHEN o_orderkey % 10 <> 0 THEN 'a' || o_orderkey || '.png' END AS image_names, 'layout' AS method FROM orders")

# images
GRAY = "g AS (SELECT vec_id, i, CAST(greatest(0, least(255, floor((coalesce(CAST(embedding[i] AS DOUBLE), 0) + 1) * 127))) AS INT) AS v FROM embeddings, range(1, 65) r(i)), y AS (SELECT vec_id, i, (114 * v + 587 * (v * 3 % 256) + 299 * (v * 5 % 256) + 500) // 1000 AS y FROM g)"


def _images(step: Callable) -> Query:
    return lambda s, d: images.mapped(fixtures.images(s, d), step).select("doc_id", "height", "width", F.hex("data").alias("pixels"), "error")


def _pixels(value: str) -> str:
    return f"WITH {GRAY} SELECT CAST(vec_id AS VARCHAR) AS doc_id, 8 AS height, 8 AS width, string_agg(upper(printf('%02x', CAST({value} AS INT))), '' ORDER BY i) AS pixels, CAST(NULL AS VARCHAR) AS error FROM y GROUP BY 1"


add("i01_to_gray", _images(images.to_gray), _pixels("y"))
def equalised_sql(tiles: int) -> str:
    """e: vec_id, i and v, the equalised grey values of the 8 x 8 images in y, by a grid of tiles x tiles."""
    size = 8 // tiles
    n, limit = size * size, max(int(2.0 * size * size / 256), 1)
    near = lambda at, d: f"CAST(least({tiles - 1}, greatest(0, floor(({at} + 0.5) / {size} - 0.5) + {d})) AS INT)"
    weight = lambda at, d: f"(CASE {d} WHEN 0 THEN 1 - (({at} + 0.5) / {size} - 0.5 - floor(({at} + 0.5) / {size} - 0.5)) ELSE ({at} + 0.5) / {size} - 0.5 - floor(({at} + 0.5) / {size} - 0.5) END)"
    return f"""px AS (SELECT vec_id, i, y AS g, CAST((i - 1) // 8 AS DOUBLE) AS r, CAST((i - 1) % 8 AS DOUBLE) AS c FROM y),
        hist AS (SELECT vec_id, CAST(floor(r / {size}) AS INT) AS ty, CAST(floor(c / {size}) AS INT) AS tx, g AS v, count(*) AS n FROM px GROUP BY ALL),
        tile AS (SELECT vec_id, ty, tx, CAST(sum(greatest(n - {limit}, 0)) AS BIGINT) AS over FROM hist GROUP BY ALL),
        cor AS (SELECT px.vec_id, i, g, dy, dx, {near('r', 'dy')} AS ty, {near('c', 'dx')} AS tx, {weight('r', 'dy')} * {weight('c', 'dx')} AS w FROM px, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(dy, dx)),
        low AS (SELECT cor.vec_id, i, dy, dx, any_value(w) AS w, any_value(g) AS g, any_value(over) AS over, coalesce(sum(least(n, {limit})) FILTER (v <= g), 0) AS held
            FROM cor JOIN tile USING (vec_id, ty, tx) JOIN hist USING (vec_id, ty, tx) GROUP BY cor.vec_id, i, dy, dx),
        e AS (SELECT vec_id, i, CAST(round_even(sum(w * least(255, greatest(0, round_even((held + (g + 1) * (over // 256) + CASE WHEN over % 256 > 0 THEN least(over % 256, g // greatest(256 // (over % 256), 1) + 1) ELSE 0 END)
            * (255.0::DOUBLE / {n}), 0)))), 0) AS INT) AS v FROM low GROUP BY 1, 2)"""


def _equalised(tiles: int, value: str, more: str = "", source: str = "e") -> str:
    return f"WITH {GRAY}, {equalised_sql(tiles)}{more} SELECT CAST(vec_id AS VARCHAR) AS doc_id, 8 AS height, 8 AS width, string_agg(upper(printf('%02x', CAST({value} AS INT))), '' ORDER BY i) AS pixels, CAST(NULL AS VARCHAR) AS error FROM {source} GROUP BY 1"


add("i02_clahe", _images(lambda x: images.clahe(images.to_gray(x), tiles=2)), _equalised(2, "v"))
NEAR = " + ".join(f"list_extract(p, 1 + CASE WHEN (i - 1) // 8 + ({dy}) < 0 THEN 1 WHEN (i - 1) // 8 + ({dy}) > 7 THEN 6 ELSE (i - 1) // 8 + ({dy}) END * 8 + CASE WHEN (i - 1) % 8 + ({dx}) < 0 THEN 1 WHEN (i - 1) % 8 + ({dx}) > 7 THEN 6 ELSE (i - 1) % 8 + ({dx}) END)" for dy in (-1, 0, 1) for dx in (-1, 0, 1))
add("i03_sharpen", _images(lambda x: images.sharpen(images.to_gray(x))), f"WITH {GRAY}, z AS (SELECT vec_id, list(y ORDER BY i) AS p FROM y GROUP BY 1), s AS (SELECT vec_id, p, unnest(range(1, 65)) AS i FROM z) SELECT CAST(vec_id AS VARCHAR) AS doc_id, 8 AS height, 8 AS width, string_agg(upper(printf('%02x', CAST(greatest(0, least(255, 10 * p[i] - ({NEAR}))) AS INT))), '' ORDER BY i) AS pixels, CAST(NULL AS VARCHAR) AS error FROM s GROUP BY 1")
add("i04_scale_contrast", _images(lambda x: images.scale_contrast(images.to_gray(x))), _pixels("least(255, round(abs(1.2 * y + 30)))"))
SHARP = f", z AS (SELECT vec_id, list(v ORDER BY i) AS p FROM e GROUP BY 1), q AS (SELECT vec_id, p, unnest(range(1, 65)) AS i FROM z), sharp AS (SELECT vec_id, i, least(255, round(abs(1.2 * greatest(0, least(255, 10 * p[i] - ({NEAR}))) + 30))) AS v FROM q)"
add("i05_enhance_images", lambda s, d: images.enhance_images(fixtures.images(s, d)).select("doc_id", "height", "width", F.hex("data").alias("pixels"), "error"), _equalised(8, "v", SHARP, "sharp"))


def s03_read_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitmaps written from the images, every ninth cut off, read as files, decoded in the tasks, and enhanced: the pixels as they were read and as they came out, or the error."""
    at = shared_folder(spark)
    fixtures.bitmaps(spark, sf_dir).write.partitionBy("vec_id").text(at)
    held = sources.read_images(spark, at).withColumn("doc_id", F.regexp_extract("doc_id", r"vec_id=(-?\d+)", 1))
    done = images.mapped(held, images.enhance, carried=("data",))
    return done.select("doc_id", F.hex("carried.data").alias("pixels"), F.hex("data").alias("enhanced"), "error")


COLOURS = "string_agg(upper(printf('%02x%02x%02x', v, v * 3 % 256, v * 5 % 256)), '' ORDER BY i)"
add("s03_read_images", s03_read_images, f"""
WITH done AS ({_equalised(8, "v", SHARP, "sharp")}), {GRAY}, given AS (SELECT CAST(vec_id AS VARCHAR) AS doc_id, {COLOURS} AS pixels, vec_id % 9 = 0 AS cut FROM g GROUP BY vec_id)
SELECT doc_id, CASE WHEN NOT cut THEN given.pixels END AS pixels, CASE WHEN NOT cut THEN done.pixels END AS enhanced, CASE WHEN cut THEN 'unreadable image' END AS error FROM given JOIN done USING (doc_id)""")


# streaming
def t01_stream_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that arrive as JSON files, parsed by a stream until none is left."""
    at = shared_folder(spark)
    fixtures.all_documents(spark, sf_dir).write.json(f"{at}/in")
    stream_parse(spark, f"{at}/in", f"{at}/out", f"{at}/checkpoint", available_now=True).awaitTermination()
    return spark.read.parquet(f"{at}/out").select("doc_id", "doc_type", "error")


def t01_stream_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that arrive as JSON files, in typed tables by a stream of several batches that ends and is started again when more have come: how many rows of each type."""
    at, run = shared_folder(spark), lambda: stream_typed(spark, f"{at}/in", f"{at}/out", f"{at}/checkpoint", available_now=True, files_per_trigger=4).awaitTermination()
    fixtures.odd_backs(spark, sf_dir).unionByName(fixtures.raw_ocr(spark, sf_dir)).write.json(f"{at}/in")
    run()
    fixtures.id_fronts(spark, sf_dir).unionByName(fixtures.id_backs(spark, sf_dir)).unionByName(fixtures.licences(spark, sf_dir)).write.mode("append").json(f"{at}/in")
    run()
    return _counted(spark, f"{at}/out")


add("t01_stream_typed", t01_stream_typed, TYPED)
add("t01_stream_parse", t01_stream_parse, f"{PARSED} SELECT doc_id, doc_type, error FROM parsed")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents there are of each detected type."""
    return pages.classify(pages.to_layouts(fixtures.all_documents(spark, sf_dir))).groupBy("doc_type").agg(F.count("*").alias("documents"))
