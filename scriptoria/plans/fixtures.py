"""Recognition results, letters and images derived from the given tables, whole: once as Spark expressions here, once as SQL in `sql`.

A document's words are dealt to pages of 60 boxes, five a row. Each customer has both sides of a card and a licence; letters come from orders, images from embeddings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import CODE_ALPHABET, uscc_check_digit

PAGE = 60
# The districts that codes cycle through, the last one unlisted.
DISTRICTS = ("410100", "410300", "410500", "410700", "410800", "410900", "411000", "411100", "411200", "411300", "411400", "411500", "411600", "411700", "419001", "330100")
HAN_DIGITS = ("0123456789", "零一二三四五六七八九")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of documents in the form of parallel arrays; every fifth document's pages lack their last score. No shuffle."""
    words = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("d"), F.split(F.coalesce("text", F.lit("")), " ", -1).alias("ws"))
    pages = words.select("d", "ws", F.explode(F.sequence(F.lit(0), F.expr(f"cast((size(ws) - 1) div {PAGE} as int)"))).alias("p"))
    pages = pages.select("d", "p", F.slice("ws", F.col("p") * PAGE + 1, PAGE).alias("texts"))
    k = F.sequence(F.lit(0), F.size("texts") - 1)
    d = F.col("d")

    def box(i: Column) -> Column:
        left = i % 5 * 170 + (d * 3 + i * 7) % 11
        top = F.floor(i / 5) * 30 + (d * 7 + i * 5) % 9
        return F.array(left, top, left + F.least(F.length(F.get("texts", i)) * 12, F.lit(160)), top + 20 + i % 5).cast("array<int>")

    scores = F.transform(k, lambda i: ((d * 31 + i * 17) % 100) / F.lit(100.0))
    out = pages.select(F.concat_ws("-", "d", "p").alias("doc_id"), "texts", F.when(d % 5 == 0, F.slice(scores, 1, F.greatest(F.size("texts") - 1, F.lit(0)))).otherwise(scores).alias("scores"), F.transform(k, box).alias("boxes"))
    corners = lambda b: F.array(F.array(b[0], b[1]), F.array(b[2], b[1]), F.array(b[2], b[3]), F.array(b[0], b[3]))
    return out.withColumns({"polys": F.transform("boxes", corners), "angle": F.lit(0)})


def _page(c: DataFrame, boxes: Column, kind: str) -> DataFrame:
    """raw_ocr of boxes (text, left, top, right, bottom), a page for each row of c, named by kind and key."""
    page, boxes = c.select("k", F.explode(F.array(boxes)).alias("bx")), F.col("bx")
    return page.select(
        F.concat(F.lit(kind), F.col("k").cast("string")).alias("doc_id"), F.transform(boxes, lambda b: b["t"]).alias("texts"), F.transform(boxes, lambda b: F.lit(0.9)).alias("scores"),
        F.transform(boxes, lambda b: F.array(b["l"], b["y"], b["r"], b["b"])).alias("boxes"), F.transform(boxes, lambda b: F.array().cast("array<array<int>>")).alias("polys"), F.lit(0).alias("angle"),
    )


def _box(text: Column | str, left: int, top: int, right: int, bottom: int | None = None) -> Column:
    t = F.lit(text) if isinstance(text, str) else text
    return F.struct(t.alias("t"), F.lit(left).alias("l"), F.lit(top).alias("y"), F.lit(right).alias("r"), F.lit(top + 30 if bottom is None else bottom).alias("b"))


def _variants(v: Column, *options: list[Column]) -> Column:
    out = F.array(*options[-1])
    for i in range(len(options) - 2, -1, -1):
        out = F.when(v == i, F.array(*options[i])).otherwise(out)
    return out


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the values that their card or licence shows."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.expr("cast(c_custkey div 3 % 4 as int)").alias("v"))
    k = F.col("k")
    han = F.translate((k % 1000).cast("string"), *HAN_DIGITS)
    y, m, d = 1950 + k % 50, 1 + k % 12, 1 + k % 28
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return c.withColumns({
        "han": han, "birth": F.concat(y.cast("string"), F.lit("年"), m.cast("string"), F.lit("月"), d.cast("string"), F.lit("日")),
        "id": F.concat(F.lit("410221"), y.cast("string"), two(m), two(d), F.lpad((k % 1000).cast("string"), 3, "0"), F.when(k % 10 == 0, "x").otherwise((k % 10).cast("string"))),
        "sex": F.when(k % 2 == 0, "男").otherwise("女"), "vy": (2000 + k % 20).cast("string"), "vm": m.cast("string"), "vd": d.cast("string"), "vm2": two(m), "vd2": two(d), "vz": (2020 + k % 20).cast("string"),
    })


def id_fronts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = customers(spark, sf_dir)
    name, addr = F.concat(F.lit("张"), "han"), F.concat(F.lit("河南省渑池县洪阳镇"), "han", F.lit("号"))
    lit = F.lit
    cat = F.concat
    boxes = _variants(
        F.col("v"),
        [_box(cat(lit("姓名"), name), 40, 40, 300), _box(cat(lit("性别"), "sex", lit(" 民族汉")), 40, 100, 300), _box(cat(lit("出生"), "birth"), 40, 160, 300), _box(cat(lit("住址"), addr), 40, 220, 500), _box(cat(lit("公民身份号码"), "id"), 40, 400, 600)],
        [_box("姓名", 40, 40, 120), _box(name, 150, 42, 300), _box("性别", 40, 100, 120), _box(cat("sex", lit(" 民族汉")), 150, 100, 300), _box(cat(lit("出生"), "birth"), 40, 160, 300), _box(cat(lit("住址"), F.substring(addr, 1, 9)), 40, 220, 500), _box(F.substring(addr, 10, 99), 45, 258, 300), _box("公民身份号码", 40, 400, 200), _box(F.col("id"), 220, 400, 600)],
        [_box("姓名", 40, 40, 120), _box(name, 40, 75, 300), _box(cat(lit("性别"), "sex"), 40, 110, 120), _box("民族汉", 150, 110, 300), _box("出生", 40, 160, 120), _box(F.col("birth"), 40, 192, 300), _box(cat(lit("住址"), F.substring(addr, 1, 6)), 40, 230, 500), _box(F.substring(addr, 7, 3), 45, 268, 300), _box(F.substring(addr, 10, 99), 45, 345, 300), _box("公民身份号码", 40, 400, 200), _box(F.col("id"), 40, 440, 600)],
        [_box("姓", 40, 40, 80), _box(cat(lit("名"), name), 90, 40, 300), _box("性", 40, 100, 80), _box(cat(lit("别"), "sex", lit("民族汉")), 90, 100, 300), _box("出", 40, 160, 80), _box(cat(lit("生"), "birth"), 90, 160, 300), _box("住", 40, 220, 80), _box(cat(lit("址"), addr), 90, 220, 500), _box("公民身", 40, 400, 100), _box(cat(lit("份号码"), "id"), 110, 400, 600)],
    )
    return _page(c, boxes, "f")


def id_backs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = customers(spark, sf_dir)
    dots = F.concat_ws(".", "vy", "vm2", "vd2")
    ends = F.concat_ws(".", "vz", "vm2", "vd2")
    han = lambda y: F.concat(F.col(y), F.lit("年"), "vm", F.lit("月"), "vd", F.lit("日"))
    cat, lit = F.concat, F.lit
    boxes = _variants(
        F.col("v"),
        [_box("签发机关郑州市公安局", 40, 40, 400), _box(cat(lit("有效期限"), dots, lit("-"), ends), 40, 120, 500)],
        [_box("签发机关", 40, 40, 150), _box("郑州市公安局", 160, 45, 300), _box("二分局", 310, 40, 400), _box("有效期限", 40, 120, 150), _box(cat(han("vy"), lit("至"), han("vz")), 160, 125, 500)],
        [_box("签发机关", 40, 40, 150), _box("郑州市公安局", 40, 90, 300), _box("有效期限", 40, 200, 150), _box(cat("vy", "vm2", "vd2", "vz", "vm2", "vd2"), 40, 250, 500)],
        [_box("签发", 40, 40, 100), _box("机关郑州市公安局", 110, 40, 400), _box("有效", 40, 120, 100), _box(cat(lit("期限"), dots, lit("-长期")), 110, 120, 500)],
    )
    return _page(c, boxes, "b")


def licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences on a page of 1200 x 800; codes clean, with O for 0 among the digits, with I for 1 in the tail, or with a wrong check digit."""
    c = customers(spark, sf_dir)
    c = c.withColumn("body", F.concat(F.lit("91"), F.element_at(F.array(*map(F.lit, DISTRICTS)), (F.col("k") % len(DISTRICTS) + 1).cast("int")), F.lit("MA1"), F.lpad((F.col("k") % 1000000).cast("string"), 6, "0")))
    c = c.select("*", F.explode(F.array(uscc_check_digit("body"))).alias("check"))
    body, check = F.col("body"), F.col("check")
    other = F.substring(F.lit(CODE_ALPHABET), F.instr(F.lit(CODE_ALPHABET), check) % 31 + 1, F.lit(1))
    v = F.col("v")
    shown = F.when(v == 1, F.concat(F.substring(body, 1, 2), F.translate(F.substring(body, 3, 6), "0", "O"), F.substring(body, 9, 9), check)).when(v == 2, F.concat(F.substring(body, 1, 10), F.lit("I"), F.substring(body, 12, 6), check)).when(v == 3, F.concat(body, other)).otherwise(F.concat(body, check))
    name, addr = F.concat(F.lit("河南省"), "han", F.lit("有限公司")), F.concat(F.lit("金水路"), "han", F.lit("号"))

    def row(text: Column | str, left: int, top: int, right: int) -> Column:
        return _box(text, left, top, right, top + 26)

    head = [row("统一社会信用代码", 40, 40, 260), row(shown, 280, 40, 600)]
    whole = [row("名称", 40, 100, 160), row(name, 180, 100, 560), row("类型", 40, 160, 160), row("有限责任公司", 180, 160, 400)]
    cut = [row("名", 40, 100, 70), row(F.concat(F.lit("称"), name), 90, 100, 560), row("类", 40, 160, 70), row("型", 80, 160, 110), row("有限责任公司", 180, 160, 400)]
    right = [row("法定代表人", 40, 220, 160), row("张三", 180, 220, 260)]
    same = [row("法定代表人张三", 40, 220, 260)]
    under = [row("法定代表人", 40, 220, 160), row("张三", 40, 250, 120)]
    money = [row("注册资本", 40, 280, 160), row("壹佰万元整", 180, 280, 400), row("成立日期", 40, 340, 160), row("2019年06月24日", 180, 340, 400)]
    place = [row("住所", 700, 370, 760), row(addr, 780, 370, 1100), row("一号楼", 780, 400, 900)]
    split = [row("住", 700, 370, 720), row("所", 730, 370, 750), row(addr, 780, 370, 1100), row("一号楼", 780, 400, 900)]
    joined = [row(F.concat(F.lit("住所：斤"), addr), 700, 370, 1100)]
    scope = [row("经营范围", 40, 480, 160), row("软件开发", 180, 480, 560), row("技术服务", 180, 510, 560), row("登记机关", 700, 700, 800)]
    boxes = _variants(v, [*head, *whole, *right, *money, *place, *scope], [*head, *cut, *same, *money, *place, *scope], [*head, *whole, *under, *money, *split, *scope], [*head, *cut, *right, *money, *joined, *scope])
    return _page(c, boxes, "l")


def odd_backs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The back of a card of each customer, with one flaw: a short, missing or long box, a missing coordinate or score, a missing text, a box that isn't needed, or no texts."""
    c = customers(spark, sf_dir).withColumn("v", (F.col("k") % 8).cast("int"))
    v, lit, arr = F.col("v"), F.lit, F.array
    shown = F.concat(lit("有效期限"), F.concat_ws(".", "vy", "vm2", "vd2"), lit("-长期"))
    none = lit(None).cast("int")
    numbers = lambda *n: arr(*map(lit, n)).cast("array<int>")
    box = F.when(v == 0, numbers(40, 120)).when(v == 1, lit(None)).when(v == 2, numbers(40, 120, 500, 150, 7)).when(v == 3, arr(lit(40), none, lit(500), lit(150))).otherwise(numbers(40, 120, 500, 150))
    other = F.when(v == 5, lit(None).cast("string")).otherwise("无")
    return c.select(
        F.concat(lit("o"), F.col("k").cast("string")).alias("doc_id"), F.when(v != 7, arr(lit("签发机关郑州市公安局"), shown, other)).alias("texts"),
        arr(lit(0.9), F.when(v != 4, lit(0.9)), F.when(v == 6, lit(0.1)).otherwise(lit(0.9))).alias("scores"), arr(numbers(40, 40, 400, 70), box, F.when(v == 6, numbers(1)).when(v != 5, numbers(40, 200, 90, 230))).alias("boxes"),
        arr().cast("array<array<array<int>>>").alias("polys"), lit(0).alias("angle"),
    )


def all_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards, licences, flawed pages, and the documents' pages, which are of no known type."""
    return id_fronts(spark, sf_dir).unionByName(id_backs(spark, sf_dir)).unionByName(licences(spark, sf_dir)).unionByName(odd_backs(spark, sf_dir)).unionByName(raw_ocr(spark, sf_dir))


def cut_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of JSON for each customer, of which some are cut off or hold another type than the schema's."""
    k = F.col("c_custkey")
    text = F.concat(F.lit('{"doc_id":"j'), k.cast("string"), F.lit('","texts":'), F.when(k % 5 == 1, F.lit('"none"')).otherwise(F.lit('["签发机关甲","有效期限长期"]')), F.lit(',"scores":[0.9,0.8],"boxes":[[1,2,30,40],[1,50,30,90]],"angle":0}'))
    return table(spark, sf_dir, "customer").select(F.when(k % 5 == 0, F.substring(text, F.lit(1), (20 + k % 31).cast("int"))).otherwise(text).alias("value"))


def letter_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two or three pages for each order."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.dayofmonth("o_orderdate").alias("d"))
    k, c = F.col("k"), F.col("c").cast("string")
    cat, lit = F.concat, F.lit
    ids = cat(lit("4102211990"), F.lpad(c, 8, "0"))
    other = cat(lit("4102211980"), F.lpad(c, 7, "0"), lit("x"))
    date = lambda y: cat(y.cast("string"), lit("年"), "m", lit("月"), "d", lit("日"))
    one = F.concat_ws(
        "\n",
        F.when(k % 50 == 0, lit("委托人：")).otherwise(cat(lit("委托人：_"), lit("客户"), c, lit("_"))), F.when(k % 5 != 1, cat(lit("身份证号码："), ids)),
        F.when(k % 5 != 2, cat(lit("住址：_河南省"), c, lit("号"))), F.when(k % 5 != 3, cat(lit("联系电话：0371-"), F.lpad(c, 7, "0"))),
    )
    two = F.concat_ws(
        "\n",
        F.when(k % 2 == 0, cat(lit("受托人：代理"), c)).otherwise(cat(lit("受托人张三身份证号"), other)), F.when(k % 3 == 0, lit("委托人：他人")),
        cat(lit("有效期："), date(F.col("y")), lit("至"), date(F.col("y") + 1)), cat(lit("签署日期："), date(F.col("y"))),
    )
    page = lambda n, t, i: F.struct(lit(n).alias("page_number"), t.alias("text"), i.cast("int").alias("image_count"))
    pages = [page(1, one, lit(0)), page(2, two, lit(0)), page(3, lit(""), k % 2)]
    return o.select(k.cast("string").alias("doc_id"), F.explode(F.when(k % 7 == 0, F.array(*pages[:2])).otherwise(F.array(*pages))).alias("x")).select("doc_id", "x.*")


def layout_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON array of one to three pages for each order; every tenth has no markdown."""
    k = F.col("o_orderkey")
    page = lambda i: F.concat(F.lit('{"markdown": {"text": "p'), i.cast("string"), F.lit("-"), k.cast("string"), F.lit('", "images": {"a'), k.cast("string"), F.lit('.png": "x"}}}'))
    bare = F.lit('{"width": 1}')
    pages = F.transform(F.sequence(F.lit(1), (k % 3 + 1).cast("int")), lambda i: F.when(k % 10 == 0, bare).otherwise(page(i)))
    return table(spark, sf_dir, "orders").select(k.cast("string").alias("doc_id"), F.concat(F.lit("["), F.array_join(pages, ","), F.lit("]")).alias("json"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An 8 x 8 image of each embedding: its first 64 values (0 for missing ones) as grey values, the other channels multiples of them."""
    value = lambda i: F.coalesce(F.get("embedding", i).cast("double"), F.lit(0.0))
    gray = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((value(i) + 1) * 127).cast("int"))))
    pixel = lambda g: F.concat(F.lpad(F.hex(g), 2, "0"), F.lpad(F.hex(g * 3 % 256), 2, "0"), F.lpad(F.hex(g * 5 % 256), 2, "0"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("doc_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(3).alias("channels"), F.unhex(F.array_join(F.transform(gray, pixel), "")).alias("data"))


def bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id and the bytes of a bitmap of each image, as a string; every ninth is cut off in its head."""
    head = "424DF600000000000000360000002800000008000000080000000100180000000000C0000000000000000000000000000000000000" + "00"
    rows = F.concat(*[F.substring("data", 24 * (7 - r) + 1, 24) for r in range(8)])  # a bitmap's rows go upwards
    whole = F.concat(F.unhex(F.lit(head)), rows)
    return images(spark, sf_dir).select(F.col("doc_id").cast("long").alias("vec_id"), F.when(F.col("doc_id").cast("long") % 9 == 0, F.substring(whole, 1, 30)).otherwise(whole).cast("string").alias("value"))
