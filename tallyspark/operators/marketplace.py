"""Marketplace and wallet reconciliation built from the matching operators."""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import predicates as P
from tallyspark.functions.scalars import title_with_quantity
from tallyspark.operators import matching as M
from tallyspark.operators.rules import Rule, add_tag, apply_pass, discard, negate, rule

# Fixed values of the wallet export: the Type and Name of a redemption row.
REDEMPTION_TYPE = "General Incentive/Certificate Redemption"
REDEMPTION_NAME = "eBay Inc."


def group_orders(items: DataFrame, order_id: str = "order_id", date: str = "date",
                 title: str = "title", quantity: str | None = "quantity",
                 amount: str = "amount", currency: str = "currency",
                 seq: str = "_seq") -> DataFrame:
    """Orders of two or more items as one transaction: first item's date and
    currency, summed amount, titles joined with ``|`` in item order."""
    t = title_with_quantity(title, quantity) if quantity else F.col(title)
    x = items.select(order_id, date, amount, currency, seq, t.alias("_t"))
    g = x.groupBy(order_id).agg(
        F.count(F.lit(1)).alias("items"),
        F.min_by(date, seq).alias(date),
        F.min_by(currency, seq).alias(currency),
        F.sum(amount).alias(amount),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seq, "_t"))),
                                 lambda s: s["_t"]), "|").alias(title),
        F.min(seq).alias(seq))
    return g.filter(F.col("items") > 1)


def apply_redemptions(wallet: DataFrame, type_col: str = "type", name_col: str = "name",
                      amount: str = "amount", balance: str = "balance",
                      keys: Sequence[str] = ("system_id", "currency", "date"),
                      seq: str = "_seq") -> DataFrame:
    """A redemption row gives key (balance - amount, currency, date) and value
    balance; a row of the same file with that key takes amount = balance.
    Redemption rows drop out; for a repeated key the last redemption wins.
    Keys compare by value (5.0 equals 5)."""
    is_red = (F.col(type_col) == REDEMPTION_TYPE) & (F.col(name_col) == REDEMPTION_NAME)
    red = wallet.filter(is_red).select(
        *[F.col(k) for k in keys],
        (F.col(balance) - F.col(amount)).alias("_key_amount"),
        F.col(balance).alias("_new"), F.col(seq).alias("_rseq"))
    red = red.groupBy(*keys, "_key_amount").agg(F.max_by("_new", "_rseq").alias("_new"))
    rest = wallet.filter(~F.coalesce(is_red, F.lit(False)))
    cond = [rest[k].eqNullSafe(red[k]) for k in keys] + [rest[amount] == red["_key_amount"]]
    j = rest.join(red, cond, "left")
    cols = [F.coalesce(red["_new"], rest[amount]).cast(wallet.schema[amount].dataType).alias(amount)
            if c == amount else rest[c] for c in wallet.columns]
    return j.select(*cols)


def wallet_rules() -> list[Rule]:
    """Wallet preparation: payments and refunds are negated and tagged, the
    rest is discarded."""
    return [rule(negate(), add_tag("paypal"), when=P.category(r"\b(Payment|Refund)$")),
            rule(discard())]


def prepare_wallet(wallet_ledger: DataFrame) -> DataFrame:
    out = apply_pass(wallet_ledger, wallet_rules(), "wallet")
    return out.filter(~F.col("_discarded")).drop("_rule", "_pass", "_discarded")


@dataclasses.dataclass
class OrderReconciliation:
    ledger: DataFrame
    unclaimed_items: DataFrame
    unclaimed_refunds: DataFrame
    report_grouped: DataFrame
    report_items: DataFrame


def reconcile_orders(ledger: DataFrame, items: DataFrame, refunds: DataFrame,
                     grid: Sequence[M.GridPoint], extra_tags: Sequence[str] = (),
                     order_id_tag: bool = True, amount_tag: str | None = None,
                     days_tag: str | None = None, eligible: Column | None = None,
                     order_id: str = "order_id") -> OrderReconciliation:
    """Two-phase order reconciliation.

    Phase 1 matches ledger rows to multi-item orders.  Phase 2 matches the
    rows phase 1 left unmatched to the single items of every order that phase
    1 did not claim, plus refunds.  Matched rows take the order title as
    description and get the fixed tags, the order id tag and difference tags.
    """
    from pyspark.sql import types as T
    t_side = M.Side(key="_tid", date="date", amount="amount", currency="currency", seq="_seq")

    def txn_tags(df):
        if order_id_tag:
            return F.array(F.col(order_id).cast("string"))
        return F.array().cast(T.ArrayType(T.StringType()))

    groups = group_orders(items, order_id=order_id).withColumn("_tid", F.col("_seq") * 2)
    recs1 = ledger.filter(eligible) if eligible is not None else ledger
    res1 = M.grid_reconcile(recs1, groups, grid, M.LEDGER_SIDE, t_side)
    merged1 = M.merge_matches(ledger, res1.matches, groups, description="title",
                              txn_tags=txn_tags(groups), extra_tags=extra_tags,
                              amount_tag=amount_tag, days_tag=days_tag, t=t_side)
    claimed_orders = groups.join(res1.matches.select(F.col("tid").alias("_tid")), "_tid",
                                 "left_semi").select(order_id)
    singles = (items.join(claimed_orders, order_id, "left_anti")
                    .withColumn("title", title_with_quantity("title", "quantity"))
                    .withColumn("_tid", F.col("_seq") * 2))
    refs = refunds.withColumn("_tid", F.col("_seq") * 2 + 1)
    txns2 = singles.select(order_id, "date", "title", "amount", "currency", "_seq", "_tid") \
        .unionByName(refs.select(order_id, "date", "title", "amount", "currency", "_seq", "_tid"))
    recs2 = merged1.join(res1.matches.select(F.col("rid").alias("_seq")), "_seq", "left_anti")
    if eligible is not None:
        recs2 = recs2.filter(eligible)
    res2 = M.grid_reconcile(recs2, txns2, grid, M.LEDGER_SIDE, t_side)
    merged2 = M.merge_matches(merged1, res2.matches, txns2, description="title",
                              txn_tags=txn_tags(txns2), extra_tags=extra_tags,
                              amount_tag=amount_tag, days_tag=days_tag, t=t_side)
    left = M.unclaimed(txns2, res2.matches, t_side)
    return OrderReconciliation(
        merged2,
        left.filter(F.col("_tid") % 2 == 0).drop("_tid"),
        left.filter(F.col("_tid") % 2 == 1).drop("_tid"),
        res1.report, res2.report)


@dataclasses.dataclass
class WalletReconciliation:
    ledger: DataFrame
    unclaimed: DataFrame
    report: DataFrame


def reconcile_wallet(ledger: DataFrame, wallet_ledger: DataFrame,
                     grid: Sequence[M.GridPoint], amount_tag: str | None = None,
                     days_tag: str | None = None) -> WalletReconciliation:
    """Ledger rows matched to wallet rows take the wallet description and tags."""
    res = M.grid_reconcile(ledger, wallet_ledger, grid)
    merged = M.merge_matches(ledger, res.matches, wallet_ledger, description="description",
                             txn_tags=F.coalesce(F.col("tags"), F.array().cast("array<string>")),
                             amount_tag=amount_tag, days_tag=days_tag)
    return WalletReconciliation(merged, M.unclaimed(wallet_ledger, res.matches), res.report)
