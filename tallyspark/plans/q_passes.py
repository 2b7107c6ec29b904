"""Queries over computed fields, operator passes, eligible records and sink subsets (R5, F14, P10, E1, E2, P12, S18, S20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions.scalars import global_id
from tallyspark.operators import matching as M
from tallyspark.operators.quality import dedupe_last
from tallyspark.operators.rules import OperatorPass, Pipeline, apply_pass, rule, set_field
from tallyspark.plans import fixtures as fx
from tallyspark.plans.q_matching import (AMOUNT, BALANCE, DAYS, ORACLE_ROUNDS, R, T, pairs_sql, rounds_sql,
                                         scored_sql)
from tallyspark.plans.registry import query
from tallyspark.sources.sinks import ledger_text, unclaimed_rows

LEDGER = fx.with_views("ledger")
KEYS = ["source_id", "posting_date", "category"]


@query("set_field_rule", LEDGER + """
SELECT id, CASE WHEN amount > 50000 THEN system_id || '-' || id ELSE description END AS description FROM ledger""")
def set_field_rule(spark, sf_dir):
    """A field set from an expression of the row: the global id as description."""
    out = apply_pass(fx.ledger(spark, sf_dir),
                     [rule(set_field("description", global_id()), when=F.col("amount") > 50000)], "ids")
    return out.select("id", "description")


def _operator_pass(spark, sf_dir, mode):
    """Repeated refunds of one source, date and category dropped; they are a side output."""
    def fn(df):
        kept = dedupe_last(df, KEYS)
        return kept, {"dropped": df.join(kept.select("_seq"), "_seq", "left_anti")}
    p = Pipeline([OperatorPass("repeats", fn, guard="refund", mode=mode)], named={"refund": F.col("amount") < 0})
    return p.run(fx.ledger(spark, sf_dir))


_REPEATS = LEDGER + f""", ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {', '.join(KEYS)}, amount < 0 ORDER BY _seq DESC) AS n FROM ledger)
SELECT id, CAST(amount AS DOUBLE) AS amount FROM ranked WHERE """


@query("operator_pass_route", _REPEATS + "amount >= 0 OR n = 1")
def operator_pass_route(spark, sf_dir):
    out = _operator_pass(spark, sf_dir, "route").kept
    return out.select("id", F.col("amount").cast("double").alias("amount"))


@query("operator_pass_filter", _REPEATS + "amount < 0 AND n = 1")
def operator_pass_filter(spark, sf_dir):
    out = _operator_pass(spark, sf_dir, "filter").kept
    return out.select("id", F.col("amount").cast("double").alias("amount"))


@query("operator_pass_side_output", _REPEATS + "amount < 0 AND n > 1")
def operator_pass_side_output(spark, sf_dir):
    out = _operator_pass(spark, sf_dir, "filter").side_outputs["repeats.dropped"]
    return out.select("id", F.col("amount").cast("double").alias("amount"))


_ELIGIBLE = (fx.with_views("records", "txns") + ", usd AS (SELECT * FROM records WHERE currency = 'USD'),"
             + pairs_sql(DAYS, AMOUNT, "usd") + "," + scored_sql() + "," + rounds_sql("scored", [], ORACLE_ROUNDS))


def _eligible(spark, sf_dir):
    return M.reconcile(fx.records(spark, sf_dir), fx.txns(spark, sf_dir), DAYS, AMOUNT, BALANCE, R, T,
                       eligible=F.col("currency") == "USD")


@query("eligible_records", _ELIGIBLE + " SELECT rid, tid, score FROM matched")
def eligible_records(spark, sf_dir):
    return _eligible(spark, sf_dir).matches.select("rid", "tid", "score")


@query("unclaimed_raw_rows", _ELIGIBLE + """
SELECT tid, date, CAST(amount AS DOUBLE) AS amount, currency FROM txns WHERE tid NOT IN (SELECT tid FROM matched)""")
def unclaimed_raw_rows(spark, sf_dir):
    """Transactions that no eligible record claimed, with their own cells."""
    claimed = _eligible(spark, sf_dir).matches.select("tid")
    left = unclaimed_rows(fx.txns(spark, sf_dir), claimed, key="tid")
    return left.select("tid", "date", F.col("amount").cast("double").alias("amount"), "currency")


@query("sink_subset", LEDGER + """
SELECT strftime(transaction_date, '%d.%m.%Y') AS "TransactionDate",
       regexp_replace(regexp_replace(CAST(amount AS VARCHAR), '0+$', ''), '[.]$', '') AS "Amount",
       coalesce(description, '') AS "Description", coalesce(id, '') AS "Id" FROM ledger""")
def sink_subset(spark, sf_dir):
    """Chosen sink columns, in the sink's order, with another date layout."""
    return ledger_text(fx.ledger(spark, sf_dir, ordered=False), ["id", "description", "amount", "transaction_date"], "dd.MM.yyyy")
