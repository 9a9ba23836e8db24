"""Column expressions on hand-made frames."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from inkwell.functions import formatting as fmt
from inkwell.functions import parsing as prs
from inkwell.functions.textmatch import LIKE_COLLATIONS, equals, like_to_regex, text_match


def _col(spark, values, dtype="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {dtype}")


def test_contains_is_literal(spark):
    df = _col(spark, ["50% off", "5 off", "a_b", "axb", "[0-9]x", "7x", "back\\slash", None])
    got = lambda text: sorted(r.v for r in df.filter(text_match("v", text)).collect())
    assert got("%") == ["50% off"]
    assert got("_") == ["a_b"]
    assert got("[0-9]") == ["[0-9]x"]
    assert got("\\") == ["back\\slash"]


def test_like_mode_keeps_tsql_wildcards(spark):
    df = _col(spark, ["50% off", "5 off", "a_b", "axb", "[0-9]x", "7x", "Q", None])
    got = lambda text: sorted(r.v for r in df.filter(text_match("v", text, mode="like")).collect())
    assert got("[0-9]x") == ["7x"]
    assert got("a_b") == ["a_b", "axb"]
    assert got("[^0-9]x") == ["[0-9]x", "axb"]
    assert like_to_regex("%a[bc]_") == "(?s)^.*a[bc].$"


def test_collation_case_insensitive(spark):
    df = _col(spark, ["Large", "LARGE box", "small"])
    hits = sorted(r.v for r in df.filter(text_match("v", "large", collation="UTF8_LCASE")).collect())
    assert hits == ["LARGE box", "Large"]
    assert df.filter(equals("v", "large", collation="UTF8_LCASE")).count() == 1


def test_parse_date(spark):
    df = _col(spark, ["2009-1-5", "2009-02-30", " 2010-12-01 ", "", None, "2009/01/05"])
    got = [r.d for r in df.select(prs.parse_date("v").alias("d")).collect()]
    assert got == [dt.date(2009, 1, 5), None, dt.date(2010, 12, 1), None, None, None]


def test_parse_numbers(spark):
    df = _col(spark, ["۱۲", "١٢", "1,234", " 12 ", "1_0", "", None, "\t7\n"])
    ints = [r.i for r in df.select(prs.parse_int("v").alias("i")).collect()]
    assert ints == [12, 12, None, 12, None, None, None, 7]
    money = [r.m for r in df.select(prs.parse_money("v").alias("m")).collect()]
    assert money[2] == Decimal("1234.00")


def test_parse_authors(spark):
    df = _col(spark, ["الف، ب, الف,, ", None])
    got = [r.a for r in df.select(prs.parse_authors("v").alias("a")).collect()]
    assert got[0] == ["الف", "ب"]


def test_blank_to_null(spark):
    df = _col(spark, ["  ", "", "x ", None])
    assert [r.b for r in df.select(prs.blank_to_null("v").alias("b")).collect()] == [None, None, "x", None]


def test_money_format_half_even(spark):
    df = _col(spark, [Decimal("0.5"), Decimal("1.5"), Decimal("2.5"), Decimal("-0.4"),
                      Decimal("1234567.5"), None], "decimal(18,2)")
    got = [r.v for r in fmt.format_frame(df).collect()]
    assert got == [f"{Decimal('0.5'):,.0f}", f"{Decimal('1.5'):,.0f}", f"{Decimal('2.5'):,.0f}",
                   f"{Decimal('-0.4'):,.0f}", f"{Decimal('1234567.5'):,.0f}", ""]


def test_format_dates_and_defaults(spark):
    df = spark.createDataFrame([(dt.date(2009, 1, 5), None), (None, "x")], "d date, s string")
    rows = fmt.format_frame(df).collect()
    assert rows[0].d == "2009-01-05" and rows[0].s == "" and rows[1].d == ""
    out = df.select(fmt.or_default(F.col("s"), "none").alias("o")).collect()
    assert [r.o for r in out] == ["none", "x"]


def test_trailing_blank_equality(spark):
    df = _col(spark, ["Tehran", "Tehran  ", "tehran"])
    assert df.filter(equals("v", "Tehran")).count() == 1
    assert df.filter(equals("v", "Tehran", collation="UTF8_BINARY_RTRIM")).count() == 2
    assert df.filter(equals("v", "tehran ", collation="UTF8_LCASE_RTRIM")).count() == 3


def test_like_mode_odd_classes_and_case(spark):
    df = spark.createDataFrame([("École",), ("abc",), ("a-z",)], "v string")
    got = lambda text, **kw: sorted(r.v for r in df.filter(text_match("v", text, mode="like", **kw)).collect())
    assert got("[]") == got("[^]") == got("[z-a]") == []
    assert got("[^z-a]bc") == ["abc"] and got("a[-]z") == ["a-z"] and got("[a-c]bc") == ["abc"]
    assert got("école", collation="UTF8_LCASE") == ["École"]


WORDS = ["École", "ecole", "E\u0301COLE normale", "straße", "STRASSE", "ﬁsh", "FISH", "ΟΔΟΣ", "οδος", "a b  ", "AB", "",
         "Ñandú", "nandu", "каша", "КАША", "مُحَمَّد", "محمد", "[x]", "50%"]
COLLATIONS = [f"{c}{t}" for c in LIKE_COLLATIONS for t in ("", "_RTRIM")]


@pytest.mark.parametrize("collation", [None, *COLLATIONS])
def test_like_without_wildcards_is_contains(spark, collation):
    df = spark.createDataFrame([(w,) for w in WORDS], "v string")
    for text in ["ecole", "École", "ss", "fi", "οδος", "b  ", "nandu", "каша", "محمد", "ab", "]", ""]:
        like = df.select(text_match("v", text, "like", collation).alias("m")).collect()
        assert like == df.select(text_match("v", text, "contains", collation).alias("m")).collect()


def test_like_with_wildcards_under_collations(spark):
    df = spark.createDataFrame([(w,) for w in WORDS], "v string")

    def got(text, collation):
        return sorted(r.v for r in df.filter(text_match("v", text, "like", collation)).collect())

    assert got("[É]c_le", "UNICODE_CI_AI") == sorted(["École", "ecole", "E\u0301COLE normale"])
    assert got("[e-g]c_le", "UNICODE_CI") == ["ecole"]
    assert got("ec%e", "UNICODE_CI_AI") == sorted(["École", "ecole", "E\u0301COLE normale"])
    assert got("[É]c_le", None) == ["École"]
    assert got("s_ra[s]s", "UNICODE_CI") == sorted(["STRASSE", "straße"])
    assert got("[f]i_h", "UNICODE_CI_AI") == sorted(["FISH", "ﬁsh"])
    assert got("ο_ο[Σ]", "UTF8_LCASE") == sorted(["ΟΔΟΣ", "οδος"])
    assert got("К[А]Ш_", "UTF8_LCASE") == sorted(["КАША", "каша"])
    assert got("م_[م]د", "UNICODE_CI_AI") == sorted(["محمد", "مُحَمَّد"])
    assert got("a_b%  ", "UTF8_LCASE_RTRIM") == ["a b  "]
    assert got("[N]andú", "UNICODE_CI_AI_RTRIM") == sorted(["Ñandú", "nandu"])


@pytest.mark.parametrize("collation", ["de_CI", "UNICODE_AI", "tr_CI_AI", "UTF8_BINARY_CI", "nonsense"])
def test_like_refuses_other_collations(spark, collation):
    with pytest.raises(ValueError):
        text_match("v", "a%", "like", collation)
