import pytest
from pyspark.sql import functions as F

from scriptoria.functions import text as T


def value(spark, build, *args):
    df = spark.createDataFrame([args], ", ".join(f"c{i} string" for i in range(len(args))))
    return df.select(build(*[F.col(f"c{i}") for i in range(len(args))]).alias("x")).first()["x"]


@pytest.mark.parametrize(("given", "expected"), [
    ("2019062420390624", "2019.06.24-2039.06.24"), ("有效期限2019年06月24日至长期", "2019.06.24-长期"), ("2019-06-24-2039-06-24", "2019.06.24-2039.06.24"),
    ("2019．06．24—2039·06·24", "2019.06.24-2039.06.24"), ("none", ""), (None, ""), ("", ""),
])
def test_validity(spark, given, expected):
    assert value(spark, T.extract_validity, given) == expected


@pytest.mark.parametrize(("given", "expected"), [("长期", "长期"), ("2019年6月4日", "2019.06.04"), ("20190604", "2019.06.04"), ("2019.6.4", "2019.06.04"), ("2019/6/4", ""), (None, "")])
def test_date(spark, given, expected):
    assert value(spark, T.normalize_date, given) == expected


@pytest.mark.parametrize("code", ["91410100MA0000001X", "91410300MA9ABCDE21", "92411500MA1234567G"])
def test_credit_codes(spark, code):
    assert value(spark, T.is_valid_uscc, code) is True
    assert value(spark, T.uscc_check_digit, code[:17]) == code[17]
    assert value(spark, T.fix_credit_code, code[:2] + code[2:8].replace("0", "O") + code[8:]) == code
    for i in range(18):  # any other character at any place is found out
        other = "2" if code[i] != "2" else "3"
        assert value(spark, T.is_valid_uscc, code[:i] + other + code[i + 1 :]) is False


def test_last_character_of_a_code_is_only_put_right_towards_its_check_digit(spark):
    body = next(b for b in (f"91410100MA00000{i:02d}" for i in range(99)) if value(spark, T.uscc_check_digit, b) == "1")
    assert value(spark, T.fix_credit_code, body + "l") == body + "1"
    assert value(spark, T.fix_credit_code, body + "o") == body + "o"


@pytest.mark.parametrize(("given", "expected"), [("“姓名”；【a】", '"姓名";[a]'), ("  a \n\t b  ", "a b"), ('"\'x\'"', "x"), ("淹祭", "渑商"), ("淹ABCDEFGHIJKLMNO", "淹ABCDEFGHIJKLMNO"), (None, ""), ("　", "")])
def test_postprocess(spark, given, expected):
    assert value(spark, T.postprocess_text, given) == expected


def test_clean_and_cut(spark):
    assert value(spark, T.clean_text, " 名　称：（a） ") == "名称:(a)"
    assert value(spark, lambda c: T.extract_after(c, "姓名"), "姓名吴烽") == "吴烽"
    assert value(spark, lambda c: T.extract_before(c, "号"), "1号2号") == "1"
    assert value(spark, lambda c: T.extract_after(c, "x"), "abc") == ""
    assert value(spark, lambda c: T.strip_label(c, "名称"), "前名称：:甲") == "前：:甲"
    assert value(spark, lambda c: T.strip_label(c, "名称"), "名称：:甲") == "甲"
    assert value(spark, T.suffix_of, "a.b.PDF") == "pdf"
    assert value(spark, T.suffix_of, "nodot") == "nodot"


def test_addresses(spark):
    assert value(spark, T.province_from_name, "河南省吉米特信息技术有限公司") == "河南省"
    assert value(spark, T.clean_address, "*斤金水路1号") == "金水路1号"
    assert value(spark, T.clean_address, "斤省1号") == "斤省1号"
    done = value(spark, lambda a, n, c: T.complete_address_prefix(a, n, c, F.array(F.lit("郑东"), F.lit("新"))), "一路", "河南省甲公司", "91410100MA")
    assert done == "河南省郑州市郑东新区一路"
