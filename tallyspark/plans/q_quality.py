"""Queries over dedupe, overlaps, balance checks, order grouping, redemptions
and offset pairing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import offsets as O
from tallyspark.operators import quality as Qy
from tallyspark.operators.marketplace import apply_redemptions, group_orders
from tallyspark.plans import fixtures as fx
from tallyspark.plans.registry import query
from tallyspark.schema import AMOUNT_TYPE


@query("dedupe_last", fx.with_views("ledger") + """
SELECT system_id, id, description, CAST(amount AS DOUBLE) AS amount, transaction_date
FROM (SELECT *, row_number() OVER (PARTITION BY system_id, id ORDER BY _seq DESC) AS rn FROM ledger)
WHERE rn = 1""")
def dedupe_last(spark, sf_dir):
    d = Qy.dedupe_last(fx.ledger(spark, sf_dir))
    return d.select("system_id", "id", "description", F.col("amount").cast("double").alias("amount"),
                    "transaction_date")


@query("dedupe_order_line", fx.with_views("items") + """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY _seq DESC) AS rn
      FROM items) WHERE rn = 1""")
def dedupe_order_line(spark, sf_dir):
    it = fx._items(spark, sf_dir)
    d = Qy.dedupe_last(it, keys=("l_orderkey", "l_linenumber"))
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")


@query("statement_overlaps", fx.with_views("ledger") + """,
o AS (SELECT source_id, system_id, posting_date, _seq,
             lag(system_id) OVER (PARTITION BY source_id ORDER BY posting_date, _seq) AS prev
      FROM ledger),
s AS (SELECT *, row_number() OVER (PARTITION BY system_id ORDER BY source_id, posting_date, _seq) AS k
      FROM o WHERE prev IS NULL OR prev <> system_id)
SELECT DISTINCT least(system_id, prev) AS first_id, greatest(system_id, prev) AS second_id
FROM s WHERE k > 1 AND prev IS NOT NULL""")
def statement_overlaps(spark, sf_dir):
    return Qy.find_overlaps(fx.ledger(spark, sf_dir))


def _expected_totals(spark, sf_dir):
    li = fx.table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice").cast(AMOUNT_TYPE)
    signed = F.when(F.col("l_returnflag") == "R", -price).otherwise(price)
    sysid = F.concat(F.lit("S"), (F.col("l_suppkey") % 10).cast("string"), F.lit("/"),
                     F.year("l_shipdate").cast("string"))
    section = F.when(F.col("l_returnflag") == "R", "payments").otherwise("purchases")
    e = li.groupBy(sysid.alias("system_id"), section.alias("section")).agg(
        F.sum(signed).alias("expected"))
    bump = F.when((F.col("system_id").startswith("S3/")) & (F.col("section") == "payments"),
                  F.lit(0.01)).otherwise(F.lit(0)).cast("decimal(4,2)")
    return e.withColumn("expected", F.col("expected") + bump)


@query("balance_violations", fx.with_views("ledger") + """,
e AS (SELECT 'S' || CAST(l_suppkey % 10 AS VARCHAR) || '/' || CAST(year(l_shipdate) AS VARCHAR) AS system_id,
             CASE WHEN l_returnflag = 'R' THEN 'payments' ELSE 'purchases' END AS section,
             sum(CASE WHEN l_returnflag = 'R' THEN -CAST(l_extendedprice AS DECIMAL(18,4))
                      ELSE CAST(l_extendedprice AS DECIMAL(18,4)) END) AS expected
      FROM lineitem GROUP BY ALL),
e2 AS (SELECT system_id, section,
              expected + CASE WHEN starts_with(system_id, 'S3/') AND section = 'payments'
                              THEN 0.01 ELSE 0 END AS expected FROM e),
a AS (SELECT system_id, CASE WHEN amount < 0 THEN 'payments' ELSE 'purchases' END AS section,
             sum(amount) AS actual FROM ledger GROUP BY ALL)
SELECT e2.system_id, e2.section, CAST(e2.expected AS DOUBLE) AS expected,
       CAST(coalesce(a.actual, 0) AS DOUBLE) AS actual
FROM e2 LEFT JOIN a USING (system_id, section) WHERE coalesce(a.actual, 0) <> e2.expected""")
def balance_violations(spark, sf_dir):
    led = fx.ledger(spark, sf_dir).withColumn("section", Qy.sign_sections())
    v = Qy.check_balances(led, _expected_totals(spark, sf_dir), keys=("system_id", "section"))
    return v.select("system_id", "section", F.col("expected").cast("double").alias("expected"),
                    F.col("actual").cast("double").alias("actual"))


@query("group_orders", fx.with_views("order_items") + """
SELECT order_id, count(*) AS items, arg_min(date, _seq) AS date, arg_min(currency, _seq) AS currency,
       CAST(sum(amount) AS DOUBLE) AS amount,
       string_agg(CASE WHEN quantity > 1 THEN title || ' (' || CAST(quantity AS VARCHAR) || ')'
                       ELSE title END, '|' ORDER BY _seq) AS title
FROM order_items GROUP BY order_id HAVING count(*) > 1""")
def group_orders_q(spark, sf_dir):
    g = group_orders(fx.order_items(spark, sf_dir))
    return g.select("order_id", "items", "date", "currency",
                    F.col("amount").cast("double").alias("amount"), "title")


@query("apply_redemptions", fx.with_views("wallet") + f""",
red AS (SELECT system_id, currency, date, balance - amount AS key_amount,
               arg_max(balance, _seq) AS new_amount
        FROM wallet WHERE type = '{fx.REDEMPTION_TYPE}' AND name = '{fx.REDEMPTION_NAME}'
        GROUP BY ALL)
SELECT w.event_id, w.date, w.type, CAST(coalesce(r.new_amount, w.amount) AS DOUBLE) AS amount
FROM wallet w LEFT JOIN red r ON w.system_id = r.system_id AND w.currency = r.currency
  AND w.date = r.date AND w.amount = r.key_amount
WHERE NOT (w.type = '{fx.REDEMPTION_TYPE}' AND w.name = '{fx.REDEMPTION_NAME}')""")
def apply_redemptions_q(spark, sf_dir):
    w = apply_redemptions(fx.wallet(spark, sf_dir))
    return w.select("event_id", "date", "type", F.col("amount").cast("double").alias("amount"))


# ----------------------------------------------------------------- offsets

_MOV = """,
m AS (SELECT source_id, abs(amount) AS a, amount < 0 AS neg, transaction_date AS d,
             description, amount, _seq FROM movements),
c AS (SELECT source_id, a FROM m GROUP BY ALL HAVING count(*) > 1),
mc AS (SELECT m.* FROM m JOIN c USING (source_id, a))"""


def _rank_pairs_sql(src: str) -> str:
    return f""",
r AS (SELECT *, row_number() OVER (PARTITION BY source_id, a, neg ORDER BY d, _seq) AS k FROM {src}),
p AS (SELECT x.source_id, x.a, x.d AS pos_date, y.d AS neg_date, x._seq AS sp, y._seq AS sn
      FROM r x JOIN r y ON x.source_id = y.source_id AND x.a = y.a AND x.k = y.k
      WHERE NOT x.neg AND y.neg)"""


def _pairs_out(df):
    """One row per pair from the two rows of each."""
    own = F.struct("source_id", F.abs("amount").cast("double").alias("amount"), F.col("transaction_date").alias("pos_date"))
    pairs = df.groupBy("pair_id").agg(F.max(F.when(F.col("amount") >= 0, own)).alias("_pos"),
                                      F.max(F.when(F.col("amount") < 0, F.col("transaction_date"))).alias("neg_date"))
    return pairs.select("_pos.*", "neg_date")


@query("pair_offsets_pairs", fx.with_views("movements") + _MOV + _rank_pairs_sql("mc") + """
SELECT source_id, CAST(a AS DOUBLE) AS amount, pos_date, neg_date FROM p""")
def pair_offsets_pairs(spark, sf_dir):
    return _pairs_out(O.pair_offsets(fx.movements(spark, sf_dir), output="pairs"))


@query("pair_offsets_unpaired", fx.with_views("movements") + _MOV + _rank_pairs_sql("mc") + """
SELECT source_id, CAST(amount AS DOUBLE) AS amount, d AS transaction_date, description
FROM mc WHERE _seq NOT IN (SELECT sp FROM p) AND _seq NOT IN (SELECT sn FROM p)""")
def pair_offsets_unpaired(spark, sf_dir):
    u = O.pair_offsets(fx.movements(spark, sf_dir), output="unpaired")
    return u.select("source_id", F.col("amount").cast("double").alias("amount"),
                    "transaction_date", "description")


_REFUND = """,
s AS (SELECT *, sum(CASE WHEN neg THEN -1 ELSE 1 END) OVER (
        PARTITION BY source_id, a ORDER BY d, neg, _seq ROWS UNBOUNDED PRECEDING) AS ps FROM mc),
s2 AS (SELECT *, least(0, coalesce(min(ps) OVER (PARTITION BY source_id, a ORDER BY d, neg, _seq
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS pm FROM s),
live AS (SELECT * FROM s2 WHERE NOT (neg AND ps < pm))"""


@query("pair_offsets_refund", fx.with_views("movements") + _MOV + _REFUND + _rank_pairs_sql("live") + """
SELECT source_id, CAST(a AS DOUBLE) AS amount, pos_date, neg_date FROM p""")
def pair_offsets_refund(spark, sf_dir):
    return _pairs_out(O.pair_offsets(fx.movements(spark, sf_dir), output="pairs", refund=True))


@query("pair_offsets_all", fx.with_views("movements") + """,
m AS (SELECT source_id, abs(amount) AS a, amount < 0 AS neg, transaction_date AS d,
             description, amount, _seq FROM movements)""" + _rank_pairs_sql("m") + """
SELECT m.source_id, CAST(m.amount AS DOUBLE) AS amount, m.d AS transaction_date,
       (p1.sp IS NOT NULL OR p2.sn IS NOT NULL) AS paired
FROM m LEFT JOIN p p1 ON p1.sp = m._seq LEFT JOIN p p2 ON p2.sn = m._seq""")
def pair_offsets_all(spark, sf_dir):
    a = O.pair_offsets(fx.movements(spark, sf_dir), output="all")
    return a.select("source_id", F.col("amount").cast("double").alias("amount"), "transaction_date",
                    F.col("pair_id").isNotNull().alias("paired"))


#: The scan itself: a step takes the next row of every cluster, with the open rows of both signs as lists.
_PERIOD_SQL = fx.with_views("movements").replace("WITH ", "WITH RECURSIVE ", 1) + """,
live AS (
  SELECT *, dense_rank() OVER (ORDER BY source_id, abs(amount)) AS c,
         row_number() OVER (PARTITION BY source_id, abs(amount) ORDER BY transaction_date, amount < 0, _seq) AS n
  FROM movements),
steps AS (
  SELECT DISTINCT c, CAST(0 AS BIGINT) AS n, []::STRUCT(d DATE, s BIGINT)[] AS pos, []::STRUCT(d DATE, s BIGINT)[] AS neg,
         CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b FROM live
  UNION ALL
  SELECT c, n, CASE WHEN is_neg THEN other[2:] WHEN len(other) = 0 THEN list_append(own, {'d': day, 's': s}) ELSE own END,
         CASE WHEN NOT is_neg THEN other[2:] WHEN len(other) = 0 THEN list_append(own, {'d': day, 's': s}) ELSE own END,
         CASE WHEN len(other) > 0 THEN other[1].s END, CASE WHEN len(other) > 0 THEN s END
  FROM (SELECT l.c, l.n, l.amount < 0 AS is_neg, l.transaction_date AS day, l._seq AS s,
               CASE WHEN l.amount < 0 THEN neg ELSE pos END AS own,
               list_filter(CASE WHEN l.amount < 0 THEN pos ELSE neg END, lambda x: l.transaction_date - x.d < 30) AS other
        FROM steps JOIN live l ON l.c = steps.c AND l.n = steps.n + 1)),
pairs AS (SELECT a, b FROM steps WHERE a IS NOT NULL)"""


@query("pair_offsets_period", _PERIOD_SQL + """
SELECT x.source_id, CAST(abs(x.amount) AS DOUBLE) AS amount,
       CASE WHEN x.amount >= 0 THEN x.transaction_date ELSE y.transaction_date END AS pos_date,
       CASE WHEN x.amount < 0 THEN x.transaction_date ELSE y.transaction_date END AS neg_date
FROM pairs JOIN live x ON x._seq = a JOIN live y ON y._seq = b""")
def pair_offsets_period(spark, sf_dir):
    """Pairs at most 29 days apart; the SQL walks every cluster row by row."""
    return _pairs_out(O.pair_offsets(fx.movements(spark, sf_dir), output="pairs", max_days=30))
