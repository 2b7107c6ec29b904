import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tallyspark.operators.marketplace import apply_redemptions, group_orders
from tallyspark.operators.quality import check_balances, dedupe_last, find_overlaps
from tests.helpers import ledger_rows


def test_dedupe_last_wins_null_keys_equal(spark):                # A2, Q16
    df = ledger_rows(spark, [dict(system_id="f", id="1", description="old", _seq=1),
                             dict(system_id="f", id="1", description="new", _seq=5),
                             dict(system_id=None, id="1", description="n1", _seq=2),
                             dict(system_id=None, id="1", description="n2", _seq=3),
                             dict(system_id="f-1", id=None, description="other", _seq=4)])
    got = sorted(r["description"] for r in dedupe_last(df).collect())
    assert got == ["n2", "new", "other"]


def test_find_overlaps(spark):                                   # W1
    d = lambda k: dt.date(2020, 1, k)
    df = ledger_rows(spark, [
        dict(source_id="S", system_id="A", posting_date=d(1), _seq=1),
        dict(source_id="S", system_id="A", posting_date=d(2), _seq=2),
        dict(source_id="S", system_id="B", posting_date=d(3), _seq=3),
        dict(source_id="S", system_id="A", posting_date=d(4), _seq=4),
        dict(source_id="S", system_id="C", posting_date=d(9), _seq=5),
        dict(source_id="T", system_id="D", posting_date=d(1), _seq=6)])
    assert [tuple(r) for r in find_overlaps(df).collect()] == [("A", "B")]


def test_check_balances(spark):                                  # A3
    df = ledger_rows(spark, [dict(system_id="a", amount="1.5"), dict(system_id="a", amount="2"),
                             dict(system_id="b", amount="1")])
    exp = spark.createDataFrame([("a", Decimal("3.5")), ("b", Decimal("2")), ("c", Decimal("0"))],
                                "system_id string, expected decimal(18,4)")
    bad = {r["system_id"]: (r["expected"], r["actual"]) for r in check_balances(df, exp).collect()}
    assert set(bad) == {"b"}


def test_group_orders(spark):                                    # A1
    items = spark.createDataFrame([
        ("o1", dt.date(2020, 1, 2), "Pen", 2, Decimal("3.00"), "USD", 2),
        ("o1", dt.date(2020, 1, 1), "Cup", 1, Decimal("5.00"), "USD", 1),
        ("o2", dt.date(2020, 1, 1), "Hat", 1, Decimal("9.00"), "USD", 3)],
        "order_id string, date date, title string, quantity int, amount decimal(18,2), currency string, _seq long")
    g = group_orders(items).collect()
    assert len(g) == 1
    assert g[0]["title"] == "Cup|Pen (2)" and g[0]["date"] == dt.date(2020, 1, 1)
    assert g[0]["amount"] == Decimal("8.00") and g[0]["items"] == 2


def test_redemptions_compare_by_value(spark):                    # J1, Q24
    from tallyspark.operators.marketplace import REDEMPTION_NAME, REDEMPTION_TYPE
    w = spark.createDataFrame([
        ("f", "USD", dt.date(2020, 1, 1), "shop", "Payment", Decimal("-5.0"), Decimal("0"), 1),
        ("f", "USD", dt.date(2020, 1, 1), REDEMPTION_NAME, REDEMPTION_TYPE, Decimal("1"), Decimal("-4"), 2),
        ("g", "USD", dt.date(2020, 1, 1), "shop", "Payment", Decimal("-5"), Decimal("0"), 3)],
        "system_id string, currency string, date date, name string, type string, "
        "amount decimal(18,2), balance decimal(18,2), _seq long")
    out = {r["_seq"]: r["amount"] for r in apply_redemptions(w).collect()}
    assert out == {1: Decimal("-4.00"), 3: Decimal("-5.00")}
