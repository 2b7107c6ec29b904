import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.operators.matching import param_range


def _one(spark, expr, value, typ="string"):
    return spark.createDataFrame([(value,)], f"v {typ}").select(expr(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("text,amount,symbol", [
    ("$1,234.50", Decimal("1234.5"), "$"),
    ("-€1,000.5", Decimal("-1000.5"), "€"),
    ("$-5", Decimal("-5"), "$"),              # minus after the symbol (Q13)
    (".50", Decimal("0.5"), ""),               # bare fraction (Q13)
    ("1,234,567.00", Decimal("1234567"), ""),  # every comma removed (Q13)
    ("(12.00)", None, None),
    ("", None, None),
    ("abc", None, None),
    (" £ 7 ", Decimal("7"), "£"),
])
def test_parse_money(spark, text, amount, symbol):
    got = spark.createDataFrame([(text,)], "t string").select(
        S.parse_money("t").alias("a"), S.money_symbol("t").alias("s")).first()
    assert (got["a"] if got["a"] is None else got["a"].normalize()) == (
        amount if amount is None else amount.normalize())
    assert got["s"] == symbol


def test_currency_from_symbol(spark):
    df = spark.createDataFrame([("$",), ("€",), ("CA$",), ("CHF",), ("??",), ("",)], "s string")
    got = [r["c"] for r in df.select(S.currency_from_symbol("s").alias("c")).collect()]
    assert got == ["USD", "EUR", "CAD", "CHF", None, None]


def test_ellipsis_modes(spark):
    assert _one(spark, lambda c: S.ellipsis(c, 8), "abcdefghij") == "abcde..."
    assert _one(spark, lambda c: S.ellipsis(c, 8, "prepend"), "abcdefghij") == "...fghij"  # Q18
    assert _one(spark, lambda c: S.ellipsis(c, 8), "short") == "short"
    with pytest.raises(ValueError):
        S.ellipsis(F.col("v"), 2)


def test_path_ellipsis(spark):
    assert _one(spark, lambda c: S.path_ellipsis(c, 20), "/very/long/folder/name/file.csv") == "/very/lo.../file.csv"
    assert _one(spark, lambda c: S.path_ellipsis(c, 20), "a/b.csv") == "a/b.csv"
    assert _one(spark, lambda c: S.path_ellipsis(c, 8), "/x/a_long_file_name.csv") == "...e.csv"


def test_plain_decimal(spark):
    df = spark.createDataFrame([(Decimal("1.5000"),), (Decimal("100.0000"),), (Decimal("-0.2500"),)],
                               "a decimal(18,4)")
    assert [r[0] for r in df.select(S.plain_decimal("a")).collect()] == ["1.5", "100", "-0.25"]


def test_tags_text_round_trip(spark):
    df = spark.createDataFrame([("  b a  a ",), ("",), (None,)], "t string")
    got = df.select(S.tags_from_text("t").alias("x")).collect()
    assert got[0]["x"] == ["a", "b"]          # set semantics (Q22)
    assert got[1]["x"] is None and got[2]["x"] is None
    assert df.select(S.tags_to_text(S.tags_from_text("t"))).first()[0] == "a b"


def test_valid_tags(spark):
    df = spark.createDataFrame([(["ok", "a.b-c"],), (["-bad"],), (None,)], "t array<string>")
    assert [r[0] for r in df.select(S.valid_tags("t")).collect()] == [True, False, True]
    with pytest.raises(ValueError):
        S.check_tag_literal("no spaces")


def test_title_with_quantity(spark):
    df = spark.createDataFrame([("Pen", 3), ("Cup", 1)], "t string, q int")
    assert [r[0] for r in df.select(S.title_with_quantity("t", "q")).collect()] == ["Pen (3)", "Cup"]


def test_month_day_year_inference(spark):
    df = spark.createDataFrame([(12, 28), (1, 3), (6, 1)], "m int, d int").select(
        S.month_day_in_period(F.col("m"), F.col("d"), F.lit(dt.date(2019, 12, 20)),
                              F.lit(dt.date(2020, 1, 19))).alias("x"))
    got = [(r["x"]["date"], r["x"]["out_of_period"]) for r in df.collect()]
    assert got[0] == (dt.date(2019, 12, 28), False)
    assert got[1] == (dt.date(2020, 1, 3), False)
    assert got[2] == (dt.date(2020, 6, 1), True)       # kept, flagged (Q17)


def test_parse_date_formats(spark):
    df = spark.createDataFrame([("2020/01/31", "JAN05", "13/01/20")], "a string, b string, c string")
    r = df.select(S.parse_date("a", "ledger"), S.parse_date(F.concat(F.lit("2020 "), "b"), "yyyy MMMdd"),
                  S.parse_date("c", "us_short")).first()
    assert r[0] == dt.date(2020, 1, 31) and r[1] == dt.date(2020, 1, 5) and r[2] is None


def test_record_label(spark):
    from tests.helpers import ledger_rows
    df = ledger_rows(spark, [dict(transaction_date=dt.date(2020, 1, 2), posting_date=dt.date(2020, 1, 3),
                                  amount="12.50", description="Coffee", category="FOOD",
                                  tags=["a", "b"], id="#1", source_id="bank", system_id="x/y.csv")])
    assert df.select(S.record_label()).first()[0] == \
        "2020-01-02|2020-01-03|12.5|Coffee|FOOD|[a, b]|USD|#1|bank|x/y.csv"


def test_param_range():
    assert param_range(1, 10) == list(range(1, 10))           # end excluded (Q9)
    assert param_range(500, 800, 50) == [500, 550, 600, 650, 700, 750]
    assert param_range(5) == [5] and param_range(5, 5) == [5]
    assert param_range(0, 100) == list(range(0, 100, 5))      # default step: a twentieth
    with pytest.raises(ValueError):
        param_range(10, 1)
