"""Cleaning and normalising of recognised text, as Column functions inside one projection; none shuffles.

White space and digits are Unicode's, by the regex flag (?U). A missing value is '' here.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Symbols put right, the confused characters, alphabet and weights of credit codes, labels, and word lists of addresses.
SYMBOLS = ("；。【】「」‘’“”", ";.[]()''\"\"")
HAN_FIXES = ("淹祭", "渑商")
CODE_ALPHABET = "0123456789ABCDEFGHJKLMNPQRTUWXY"
CODE_WEIGHTS = (1, 3, 9, 27, 19, 26, 16, 17, 20, 29, 25, 13, 8, 24, 10, 30, 28)
DIGIT_FIXES = ("IOSZBG", "105286")
MIXED_FIXES = ("IOSVZ", "105U2")
CHECK_FIXES = ("IOSVZlo", "105U210")
LABELS = ("统一社会信用代码", "社会信用代码", "注册号", "名称", "名", "称", "类型", "类", "型", "注册资本", "注册资金", "成立日期", "注册日期", "设立日期", "法定代表人", "负责人", "住所", "住", "所", "营业场所", "经营场所", "注册地址", "经营范围", "登记机关")
NO_NAME = "层|楼|路|街|号|市|区|省|镇|村|县|道|广场|中心|大厦"
ADMIN_SUFFIXES = "省市区县镇村乡街路道号楼层幢栋室期州盟旗"
ADDRESS_NOISE = "斤两克升斗丈尺寸分卜厂囗冂凵匚"
ADDRESS_WORDS = "省|市|区|县|镇|乡|村|路|街|号|楼|层|室|广场|大道|交叉口|大厦|中心"
CITIES = {
    "410100": "郑州市", "410300": "洛阳市", "410500": "安阳市", "410700": "新乡市", "410800": "焦作市", "410900": "濮阳市", "411000": "许昌市", "411100": "漯河市",
    "411200": "三门峡市", "411300": "南阳市", "411400": "商丘市", "411500": "信阳市", "411600": "周口市", "411700": "驻马店市", "419001": "济源市",
}
HAN = "\\x{4e00}-\\x{9fff}"
#: Unicode's white space, as the regex class (?U)\\s has it.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def text(c: ColumnOrName) -> Column:
    return F.coalesce(col(c), F.lit(""))


def strip(c: ColumnOrName) -> Column:
    """White space off both ends, Unicode's."""
    return F.btrim(col(c), F.lit(WHITE_SPACE))


def quoted(literal: str) -> str:
    """A literal inside a Java pattern."""
    return "\\Q" + literal + "\\E"


def suffix_of(c: ColumnOrName, lower: bool = True) -> Column:
    """What follows the last dot; a name without a dot is its own suffix."""
    s = F.element_at(F.split(col(c), "\\."), -1)
    return F.lower(s) if lower else s


def looks_like_code(c: ColumnOrName) -> Column:
    return text(c).rlike("[0-9A-Za-z]{15,}")


def postprocess_text(c: ColumnOrName) -> Column:
    """White space to one space, quotes off the ends, symbols put right, and, outside codes, confused characters."""
    s = strip(F.regexp_replace(text(c), r"(?U)\s+", " "))
    s = strip(F.regexp_replace(F.regexp_replace(s, '^"+|"+$', ""), "^'+|'+$", ""))
    return let(F.translate(s, *SYMBOLS), lambda x: F.when(looks_like_code(x), x).otherwise(F.translate(x, *HAN_FIXES)))


def clean_text(c: ColumnOrName) -> Column:
    """Spaces of either width out, wide colons and brackets narrowed, ends stripped."""
    return strip(F.translate(text(c), "：（） 　", ":()"))


def extract_after(c: ColumnOrName, keyword: str) -> Column:
    return let(clean_text(c), lambda s: F.when(s.contains(keyword), strip(F.split(s, quoted(keyword), 2)[1])).otherwise(""))


def extract_before(c: ColumnOrName, keyword: str) -> Column:
    return let(clean_text(c), lambda s: F.when(s.contains(keyword), strip(F.substring_index(s, keyword, 1))).otherwise(""))


def regex_first(c: ColumnOrName, pattern: str, group: int = 0) -> Column:
    """The first match in the cleaned text: its group, or the whole; '' if there is none."""
    return F.regexp_extract(clean_text(c), pattern, group)


def contains_clean(c: ColumnOrName, keyword: str) -> Column:
    return clean_text(c).contains(keyword)


def is_blank(c: ColumnOrName) -> Column:
    return clean_text(c) == ""


def _zfill2(c: Column) -> Column:
    return F.when(F.length(c) < 2, F.lpad(c, 2, "0")).otherwise(c)


def _dotted(s: Column, pattern: str) -> Column:
    part = [F.regexp_extract(s, pattern, i) for i in (1, 2, 3)]
    return F.when(s.rlike(pattern), F.concat_ws(".", part[0], _zfill2(part[1]), _zfill2(part[2])))


def normalize_date(c: ColumnOrName) -> Column:
    """One date as YYYY.MM.DD, 长期 as it is, anything else ''."""
    forms = (r"^(\d{4})年(\d{1,2})月(\d{1,2})日$", r"^(\d{4})(\d{2})(\d{2})$", r"^(\d{4})[.\-](\d{1,2})[.\-](\d{1,2})$")
    return let(strip(text(c)), lambda s: F.when(s == "长期", s).otherwise(F.coalesce(*[_dotted(s, p) for p in forms], F.lit(""))))


def extract_validity(c: ColumnOrName) -> Column:
    """A period as start-end; a form whose first match isn't two dates gives way to the next."""
    s = F.replace(F.translate(strip(text(c)), "—–－至．。· ", "----..."), F.lit("有效期限"), F.lit(""))
    date = r"\d{4}[.\-]?\d{2}[.\-]?\d{2}"
    han = r"\d{4}年\d{1,2}月\d{1,2}日"
    forms = (f"({date})-({date}|长期)", f"({han})-?({han}|长期)", r"(\d{8})(\d{8})")

    def period(x: Column, p: str) -> Column:
        ends = F.array(*[normalize_date(F.regexp_extract(x, p, i)) for i in (1, 2)])
        return let(ends, lambda e: F.when((e[0] != "") & (e[1] != ""), F.array_join(e, "-")))

    return let(s, lambda x: F.coalesce(*[period(x, p) for p in forms], F.lit("")))


def uscc_check_digit(c: ColumnOrName) -> Column:
    """The check digit of 17 characters; null for another length or a foreign character."""
    weights = F.array(*map(F.lit, CODE_WEIGHTS))
    place = lambda x: F.instr(F.lit(CODE_ALPHABET), x) - 1
    total = lambda s: F.aggregate(F.zip_with(F.split(s, ""), weights, lambda x, w: place(x) * w), F.lit(0), lambda a, x: a + x)
    digit = lambda s: F.substring(F.lit(CODE_ALPHABET), (F.lit(31) - total(s) % 31) % 31 + 1, F.lit(1))
    return let(col(c), lambda s: F.when((F.length(s) == 17) & s.rlike(f"^[{CODE_ALPHABET}]*$"), digit(s)))


def is_valid_uscc(c: ColumnOrName) -> Column:
    fine = lambda s: s.rlike(f"^[{CODE_ALPHABET}]{{18}}$") & (uscc_check_digit(F.substring(s, 1, 17)) == F.substring(s, 18, 1))
    return let(col(c), lambda s: F.coalesce(fine(s), F.lit(False)))


def fix_credit_code(c: ColumnOrName) -> Column:
    """Confused characters of an 18-character code that doesn't check put right: digits where only digits stand, foreign letters elsewhere."""

    def fixed(s: Column) -> Column:
        body = F.concat(F.translate(F.substring(s, 1, 2), *MIXED_FIXES), F.translate(F.substring(s, 3, 6), *DIGIT_FIXES), F.translate(F.substring(s, 9, 9), *MIXED_FIXES))
        last = F.translate(F.substring(s, 18, 1), *MIXED_FIXES)
        parts = let(F.struct(body.alias("body"), last.alias("last")), lambda p: F.struct(p["body"].alias("body"), p["last"].alias("last"), uscc_check_digit(p["body"]).alias("expected")))
        return let(parts, lambda p: F.concat(p["body"], F.when(F.translate(p["last"], *CHECK_FIXES) == p["expected"], p["expected"]).otherwise(p["last"])))

    return let(col(c), lambda s: F.when((F.length(s) != 18) | is_valid_uscc(s), s).otherwise(fixed(s)))


def strip_label(c: ColumnOrName, *labels: str) -> Column:
    """The text less the first label it holds and the colons that then lead it."""

    def stripped(s: Column) -> Column:
        out = strip(s)
        for label in reversed(labels):
            rest = F.regexp_replace(F.concat(F.substring_index(s, label, 1), F.split(s, quoted(label), 2)[1]), "^[:：]+", "")
            out = F.when(s.contains(label), strip(rest)).otherwise(out)
        return out

    return let(col(c), stripped)


def is_label_like(c: ColumnOrName) -> Column:
    return strip(text(c)).isin(*LABELS)


def _han_count(s: Column) -> Column:
    return F.length(F.regexp_replace(s, f"[^{HAN}]", ""))


def is_person_name(c: ColumnOrName) -> Column:
    return let(strip(text(c)), lambda s: F.length(s).between(2, 10) & ~s.rlike(r"(?U)\d") & ~s.rlike(NO_NAME) & (_han_count(s) >= 2))


def is_date_text(c: ColumnOrName) -> Column:
    return strip(text(c)).rlike(r"(?U)^\d{4}年\d{2}月\d{2}日\z")


def looks_like_capital(c: ColumnOrName) -> Column:
    return let(strip(text(c)), lambda s: s.rlike(r"(?U)[万亿圆元整壹贰叁肆伍陆柒捌玖拾佰仟零\d]") & ~is_date_text(s))


def clean_address(c: ColumnOrName) -> Column:
    """Leading characters that are neither Han nor digits off, then one that is known noise unless it names a place with the next."""
    noisy = lambda s: F.substring(s, 1, 1).rlike(f"[{ADDRESS_NOISE}]") & ~F.substring(s, 2, 1).rlike(f"[{ADMIN_SUFFIXES}]")
    return let(F.regexp_replace(strip(text(c)), rf"(?U)^[^{HAN}\d]+", ""), lambda s: F.when(noisy(s), strip(F.substring(s, 2, 1 << 30))).otherwise(s))


def looks_like_address(c: ColumnOrName) -> Column:
    return let(clean_address(c), lambda s: (F.length(s) >= 4) & (s.rlike(ADDRESS_WORDS) | ((_han_count(s) >= 4) & s.rlike(r"(?U)\d"))))


def province_from_name(c: ColumnOrName) -> Column:
    return F.regexp_extract(strip(text(c)), f"^([{HAN}]{{2,6}}省)", 1)


def city_from_credit_code(c: ColumnOrName) -> Column:
    """The city of the code's district, '' for one that isn't listed; the list is a literal map."""
    cities = F.create_map(*[F.lit(x) for kv in CITIES.items() for x in kv])
    return F.when(F.length(text(c)) >= 8, F.coalesce(F.try_element_at(cities, F.substring(text(c), 3, 6)), F.lit(""))).otherwise("")


def complete_address_prefix(address: ColumnOrName, name: ColumnOrName, code: ColumnOrName, fragments: Column) -> Column:
    """Province, city and district put before an address that lacks them."""
    has = lambda x: F.array_contains(fragments, x)
    district = F.when(has("郑东新区") | (has("郑东") & reduce(lambda p, q: p | q, map(has, ("新", "新区", "东新区")))), "郑东新区").otherwise("")
    held = F.struct(strip(text(address)).alias("a"), province_from_name(name).alias("p"), city_from_credit_code(code).alias("c"), district.alias("d"))

    def completed(x: Column) -> Column:
        parts = [F.when((x["p"] != "") & ~x["a"].startswith(x["p"]), x["p"]).otherwise("")] + [F.when(~x["a"].contains(x[k]), x[k]).otherwise("") for k in "cd"]
        return F.when(x["a"] == "", "").otherwise(F.concat(*parts, x["a"]))

    return let(held, completed)
