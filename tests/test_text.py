import math
import re
import unicodedata

from pyspark.sql import functions as F

from pricelink.functions import text


def run(spark, f, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v")).alias("x"), "i").orderBy("i").collect()]


def test_clean_text(spark):
    assert run(spark, text.clean_text, [None, "", " a \u001c b\n\tc ", "　x"]) == ["", "", "a b c", "x"]


def test_normalize_key_follows_compatibility_decomposition(spark):
    values = ["Camarón straße ½ ﬁ", "A B", "ÉÈ-ñ", None, "日本 x", "ℌello ① Ⅷ", "é é"]
    want = []
    for v in values:
        plain = unicodedata.normalize("NFKD", v or "").encode("ascii", "ignore").decode().lower()
        want.append(" ".join("".join(c if c.isalnum() else " " for c in plain).split()))
    assert run(spark, text.normalize_key, values) == want


def test_classes_of_characters_are_few_ranges():
    """A class tests its parts one by one for each character of a text, so neighbours are ranges; it has the same characters."""
    several = text.decompositions()[2]
    found = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: f"\\U{int(m[1], 16):08x}", text.char_class(several)))
    assert {chr(i) for i in range(0x20000) if found.match(chr(i))} == set(several)
    assert text.char_class(several).count("-") * 8 < len(several)


def test_prices(spark):
    values = ["$1,234.50 CS", "12.5/LB", "$ 7", "-3", "42", "no price", "123456", "abc", None]
    got = run(spark, text.price_candidate, values)
    assert [None if x is None else tuple(x) for x in got] == [(1234.5, "CS"), (12.5, "LB"), (7.0, ""), (-3.0, ""), (42.0, ""), None, None, None, None]
    assert run(spark, text.valid_price, [1.0, 0.0, -1.0, math.nan, math.inf, None], "double") == [1.0, None, None, None, None, None]
    assert run(spark, text.currency_text, [1234.5, None, 0.0], "double") == ["$1,234.50", "", ""]
    assert run(spark, text.to_numeric, ["a 1,234.5 b", "x", None]) == [1234.5, None, None]


def test_list_lines(spark):
    lines = ["12345 1 10 LB Beef chuck $12.50 CS", "12345 1 10 Beef 3 CS", "12345 1 Beef 3 CS", "1234 a b brand name __ 1,250.00 ea", "item pack pack size", "123 1 1 LB x y 3 CS", None]
    got = run(spark, text.list_line, lines)
    assert [None if x is None else tuple(x) for x in got] == [("Beef chuck", 12.5), ("Beef", 3.0), None, ("name", 1250.0), None, None, None]


def test_relation_values_and_providers(spark):
    assert run(spark, text.relation_value, ["-", "N/A", " Sin  Dato", "—", "!!", " Beef ", None]) == ["", "", "", "", "", "Beef", ""]
    assert run(spark, text.provider_key, ["Sysco North", "KOHL'S", "us  foods", "usfoods", "campus food", None]) == ["sysco", "kohl", "usfood", "usfood", None, None]
