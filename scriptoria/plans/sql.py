"""SQL for the registered queries, over the same tables; the derived inputs are CTEs put in front."""

from __future__ import annotations

LINES = """
w AS (SELECT doc_id AS d, string_split(coalesce(text, ''), ' ') AS ws FROM documents),
x AS (SELECT d, unnest(ws) AS raw, generate_subscripts(ws, 1) - 1 AS i, len(ws) AS n FROM w),
raw AS (SELECT d, d || '-' || (i // 60) AS doc_id, CAST(i % 60 AS INT) AS line_no, i % 60 AS k, raw, least(60, n - i // 60 * 60) AS pn FROM x),
boxed AS (
    SELECT *, CAST((k % 5) * 170 + (d * 3 + k * 7) % 11 AS INT) AS l, CAST((k // 5) * 30 + (d * 7 + k * 5) % 9 AS INT) AS t,
        ((d * 31 + k * 17) % 100) / 100.0 AS score, regexp_replace(raw, '^[\\s\\v\\x{85}\\p{Z}]+|[\\s\\v\\x{85}\\p{Z}]+$', '', 'g') AS text, NOT (d % 5 = 0 AND k = pn - 1) AS has_score
    FROM raw
), sized AS (SELECT *, CAST(l + least(12 * length(raw), 160) AS INT) AS r, CAST(t + 20 + k % 5 AS INT) AS b FROM boxed),
ln AS (SELECT doc_id, line_no, text, l, t, r, b, CAST(score AS DOUBLE) AS score, (t + b) / 2.0 AS cy, (l + r) / 2.0 AS cx FROM sized WHERE has_score AND text <> '' AND score >= 0.2),
anchor AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY t, l, line_no) AS n FROM ln WHERE contains(text, 'the')) WHERE n = 1),
met AS (SELECT x.*, a.line_no AS anchor_line_no, a.l AS al, a.t AS aty, a.r AS ar, a.b AS ab, a.cy AS acy, a.cx AS acx FROM ln x JOIN anchor a USING (doc_id))
"""


def lines(body: str) -> str:
    return f"WITH {LINES} {body}"


def met(where: str, more: str = "") -> str:
    return lines(f"SELECT doc_id, anchor_line_no, line_no, text{more} FROM met WHERE {where}")


def nearest(where: str, order: str) -> str:
    return lines(f"SELECT doc_id, anchor_line_no, line_no, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, anchor_line_no ORDER BY {order}, t, l, line_no) AS n FROM met WHERE {where}) WHERE n = 1")


CUSTOMERS = """
c AS (
    SELECT c_custkey AS k, c_custkey // 3 % 4 AS v, translate(CAST(c_custkey % 1000 AS VARCHAR), '0123456789', '零一二三四五六七八九') AS han,
        1950 + c_custkey % 50 AS y, 1 + c_custkey % 12 AS m, 1 + c_custkey % 28 AS d
    FROM customer
)
"""

FRONT = f"""
WITH {CUSTOMERS}, f AS (SELECT *, '河南省渑池县洪阳镇' || han || '号' AS addr FROM c)
SELECT 'f' || k AS doc_id, CASE WHEN v < 2 THEN '张' || han ELSE '' END AS name,
    CASE WHEN v IN (0, 2) THEN CASE WHEN k % 2 = 0 THEN '男' ELSE '女' END ELSE '' END AS gender, CASE WHEN v = 0 THEN '汉' ELSE '' END AS nation,
    CASE WHEN v < 2 THEN y || '年' || m || '月' || d || '日' ELSE '' END AS birthday,
    CASE v WHEN 0 THEN addr WHEN 1 THEN addr WHEN 2 THEN substr(addr, 1, 9) ELSE '' END AS address,
    '410221' || y || lpad(CAST(m AS VARCHAR), 2, '0') || lpad(CAST(d AS VARCHAR), 2, '0') || lpad(CAST(k % 1000 AS VARCHAR), 3, '0') || CASE WHEN k % 10 = 0 THEN 'X' ELSE CAST(k % 10 AS VARCHAR) END AS id_number
FROM f"""

BACK = f"""
WITH {CUSTOMERS}, f AS (SELECT *, '.' || lpad(CAST(m AS VARCHAR), 2, '0') || '.' || lpad(CAST(d AS VARCHAR), 2, '0') AS md FROM c)
SELECT 'b' || k AS doc_id, '郑州市公安局' || CASE WHEN v = 1 THEN '二分局' ELSE '' END AS authority,
    (2000 + k % 20) || md || '-' || CASE WHEN v = 3 THEN '长期' ELSE (2020 + k % 20) || md END AS valid_date
FROM f"""

# The code's alphabet and weights, as in functions.text.
ALPHABET = "0123456789ABCDEFGHJKLMNPQRTUWXY"
WEIGHTS = "[1,3,9,27,19,26,16,17,20,29,25,13,8,24,10,30,28]"
# Districts and their cities, as in functions.text.
DISTRICTS = "['410100','410300','410500','410700','410800','410900','411000','411100','411200','411300','411400','411500','411600','411700','419001','330100']"
CITY_NAMES = "['郑州市','洛阳市','安阳市','新乡市','焦作市','濮阳市','许昌市','漯河市','三门峡市','南阳市','商丘市','信阳市','周口市','驻马店市','济源市','']"
CODES = f"""
{CUSTOMERS}, b AS (
    SELECT *, '91' || {DISTRICTS}[CAST(k % 16 + 1 AS INT)] || 'MA1' || lpad(CAST(k % 1000000 AS VARCHAR), 6, '0') AS body, {CITY_NAMES}[CAST(k % 16 + 1 AS INT)] AS city
    FROM c
), s AS (SELECT *, CAST(list_sum(list_transform(range(1, 18), lambda i: (instr('{ALPHABET}', substr(body, CAST(i AS INT), 1)) - 1) * {WEIGHTS}[i])) AS BIGINT) AS total FROM b),
code AS (SELECT *, (31 - total % 31) % 31 AS pos, substr('{ALPHABET}', CAST((31 - total % 31) % 31 + 1 AS INT), 1) AS digit FROM s)
"""
LICENCE = f"""
WITH {CODES}
SELECT 'l' || k AS doc_id, body || CASE WHEN v = 3 THEN substr('{ALPHABET}', CAST((pos + 1) % 31 + 1 AS INT), 1) ELSE digit END AS credit_code,
    '河南省' || han || '有限公司' AS name, '有限责任公司' AS type_name, '张三' AS legal_person, '壹佰万元整' AS capital, '2019年06月24日' AS establish_date,
    '河南省' || city || '金水路' || han || '号' || CASE WHEN v = 3 THEN '' ELSE '一号楼' END AS address, '软件开发技术服务' AS business_scope
FROM code"""

PAGES = """
o AS (SELECT o_orderkey AS k, CAST(o_custkey AS VARCHAR) AS c, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d FROM orders),
p AS (
    SELECT k, 1 AS page_number, 0 AS image_count, concat_ws(chr(10), CASE WHEN k % 50 = 0 THEN '委托人：' ELSE '委托人：_客户' || c || '_' END,
        CASE WHEN k % 5 <> 1 THEN '身份证号码：4102211990' || lpad(c, 8, '0') END, CASE WHEN k % 5 <> 2 THEN '住址：_河南省' || c || '号' END,
        CASE WHEN k % 5 <> 3 THEN '联系电话：0371-' || lpad(c, 7, '0') END) AS text FROM o
    UNION ALL SELECT k, 2, 0, concat_ws(chr(10), CASE WHEN k % 2 = 0 THEN '受托人：代理' || c ELSE '受托人张三身份证号4102211980' || lpad(c, 7, '0') || 'x' END,
        CASE WHEN k % 3 = 0 THEN '委托人：他人' END, '有效期：' || y || '年' || m || '月' || d || '日至' || (y + 1) || '年' || m || '月' || d || '日',
        '签署日期：' || y || '年' || m || '月' || d || '日') FROM o
    UNION ALL SELECT k, 3, CAST(k % 2 AS INT), '' FROM o WHERE k % 7 <> 0
)
"""
LETTERS = f"""
WITH {PAGES}, e AS (
    SELECT *, '4102211990' || lpad(c, 8, '0') AS own, '4102211980' || lpad(c, 7, '0') || 'X' AS other, '-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(CAST(d AS VARCHAR), 2, '0') AS md FROM o
)
SELECT CAST(k AS VARCHAR) AS doc_id, 'success' AS status,
    CASE WHEN k % 50 <> 0 THEN '客户' || c WHEN k % 5 <> 1 THEN '身份证号码：' || own END AS delegator,
    CASE WHEN k % 5 <> 1 THEN own WHEN k % 2 = 1 THEN other END AS delegator_id, CASE WHEN k % 5 <> 2 THEN '河南省' || c || '号' END AS delegator_address,
    CASE WHEN k % 5 <> 3 THEN '0371-' || lpad(c, 7, '0') END AS delegator_phone, CASE WHEN k % 2 = 0 THEN '代理' || c ELSE '张三身份证' END AS trustee,
    CASE WHEN k % 2 = 1 THEN other END AS trustee_id, y || md AS start_date, (y + 1) || md AS end_date, y || md AS signing_date,
    CASE WHEN k % 7 <> 0 AND k % 2 = 1 THEN '需要人工确认签名' END AS trustee_signature, CASE WHEN k % 7 <> 0 THEN 3 ELSE 2 END AS pages_count
FROM e"""
