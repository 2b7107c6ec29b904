import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import predicates as P
from tallyspark.operators.marketplace import prepare_wallet
from tallyspark.operators.quality import dedupe_last
from tallyspark.operators.rules import (OperatorPass, Pipeline, RulePass, add_tag, apply_pass,
                                        discard, negate, rule, rule_audit, rule_counts,
                                        set_category, set_description)
from tests.helpers import ledger_rows


def _rows(df):
    return {r["id"]: r for r in df.collect()}


def test_first_match_wins_and_sees_input_row(spark):
    df = ledger_rows(spark, [dict(id="a", description="AMAZON book", category="BOOKS"),
                             dict(id="b", description="coffee", category="FOOD")])
    rules = [rule(set_category("SHOP"), when=P.description("AMAZON")),
             # would match only if it saw the category set by the rule above
             rule(add_tag("never"), when=P.category("^SHOP$")),
             rule(add_tag("food"), when=P.category("FOOD"))]
    out = _rows(apply_pass(df, rules, "p"))
    assert out["a"]["category"] == "SHOP" and out["a"]["tags"] is None and out["a"]["_rule"] == 0
    assert out["b"]["tags"] == ["food"] and out["b"]["_rule"] == 2


def test_discard_keeps_earlier_setters_and_ignores_later(spark):
    df = ledger_rows(spark, [dict(id="a", description="x")])
    out = apply_pass(df, [rule(add_tag("t"), discard(), set_category("NO"))]).first()
    assert out["_discarded"] and out["tags"] == ["t"] and out["category"] is None


def test_identity_rule_claims_row(spark):
    df = ledger_rows(spark, [dict(id="a", description="keep me")])
    rules = [rule(when=P.description("keep")), rule(discard())]
    assert not apply_pass(df, rules).first()["_discarded"]


def test_null_field_never_matches_and_not_is_true(spark):       # Q1
    df = ledger_rows(spark, [dict(id="a", category=None)])
    out = apply_pass(df, [rule(add_tag("c"), when=P.category(".*")),
                          rule(add_tag("n"), when=P.not_(P.category(".*")))]).first()
    assert out["tags"] == ["n"]


def test_negate_and_description(spark):
    df = ledger_rows(spark, [dict(id="a", amount="5.25", description="refund")])
    out = apply_pass(df, [rule(negate(), negate(), negate(), set_description("R"))]).first()
    assert str(out["amount"]) == "-5.2500" and out["description"] == "R"


def test_period_predicates(spark):
    df = ledger_rows(spark, [dict(id="a", transaction_date=dt.date(2020, 1, 1)),
                             dict(id="b", transaction_date=dt.date(2020, 1, 2))])
    open_ = [r["id"] for r in df.filter(P.in_period("01/01/20", "03/01/20")).collect()]
    closed = [r["id"] for r in df.filter(P.in_period("01/01/20", "03/01/20", inclusive=True)).collect()]
    assert open_ == ["b"] and sorted(closed) == ["a", "b"]
    with pytest.raises(ValueError):
        P.in_period("02/01/20", "01/01/20")


def test_sample_config_shape(spark):
    """Named OR predicate, keep matching rows, discard the rest."""
    shopping = P.any_of(P.description(r"\b(AMAZON|AMZN)\b"), P.category("^SHOPPING$"))
    p = Pipeline([RulePass("test", [rule(when="shopping"), rule(discard())])],
                 named={"shopping": shopping})
    df = ledger_rows(spark, [dict(id="1", description="AMZN Mktp"), dict(id="2", category="SHOPPING"),
                             dict(id="3", description="AMAZONIA tours"), dict(id="4", description="gas")])
    res = p.run(df)
    assert sorted(r["id"] for r in res.kept.collect()) == ["1", "2"]
    assert sorted(r["id"] for r in res.discarded.collect()) == ["3", "4"]


def test_pipeline_ids_order_and_errors(spark):
    p = Pipeline([RulePass("a", [rule(add_tag("a"))]), RulePass("b", [rule(add_tag("b"), when=P.has_tag("a"))])])
    df = ledger_rows(spark, [dict(id="1")])
    assert p.run(df, ids=["b", "a"]).kept.first()["tags"] == ["a"]
    assert p.run(df, ids=["a", "b"]).kept.first()["tags"] == ["a", "b"]
    with pytest.raises(ValueError, match="Valid ids"):
        p.run(df, ids=["zzz"])


def test_operator_pass_filter_and_route(spark):                 # Q3
    df = ledger_rows(spark, [dict(id="1", system_id="f", source_id="A"),
                             dict(id="1", system_id="f", source_id="A"),
                             dict(id="2", system_id="f", source_id="B")])
    guard = P.statement_id("^A$")
    filt = Pipeline([OperatorPass("dd", dedupe_last, guard, "filter")]).run(df).kept
    route = Pipeline([OperatorPass("dd", dedupe_last, guard, "route")]).run(df).kept
    assert filt.count() == 1 and route.count() == 2


def test_discarded_rows_skip_later_passes(spark):
    p = Pipeline([RulePass("a", [rule(discard(), when=P.description("x"))]),
                  RulePass("b", [rule(add_tag("late"))])])
    res = p.run(ledger_rows(spark, [dict(id="1", description="x"), dict(id="2", description="y")]))
    assert res.discarded.first()["tags"] is None and res.kept.first()["tags"] == ["late"]


def test_rule_audit_and_counts(spark):
    df = ledger_rows(spark, [dict(id="1", description="a", tags=["old"]), dict(id="2", description="b")])
    rules = [rule(add_tag("new"), when=P.description("a"), name="tag_a")]
    a = rule_audit(df, rules, "p").first()
    assert a["rule_name"] == "tag_a" and a["added_tags"] == ["new"] and "[new, old]" in a["after"]
    counts = {r["rule"]: r["n"] for r in rule_counts(df, rules).collect()}
    assert counts == {0: 1, None: 1}


def test_wallet_preparation(spark):                              # R14
    df = ledger_rows(spark, [dict(id="1", category="Express Checkout Payment", amount="-5"),
                             dict(id="2", category="Refund", amount="3"),
                             dict(id="3", category="Transfer", amount="9")])
    out = _rows(prepare_wallet(df))
    assert set(out) == {"1", "2"} and str(out["1"]["amount"]) == "5.0000"
    assert out["2"]["tags"] == ["paypal"]


def test_invalid_tag_literal():
    with pytest.raises(ValueError):
        add_tag("bad tag")
