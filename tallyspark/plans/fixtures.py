"""Ledger-shaped views derived from the driver's tables.

Each view exists twice: as Spark DataFrame code (``ledger(spark, sf_dir)``)
and as a DuckDB CTE (``SQL["ledger"]``) with the same definition, so every
registered query has an independent oracle.  Amounts are exact decimals in
both engines (the only divisions are multiplications by 0.01).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.scalars import format_date
from tallyspark.operators.sequence import with_sequence
from tallyspark.schema import AMOUNT_TYPE

CENT_VALUE = Decimal("0.01")

from tallyspark.operators.marketplace import REDEMPTION_NAME, REDEMPTION_TYPE  # noqa: E402

PAYMENT_TYPE = "Express Checkout Payment"

LINEITEM_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
                  "l_extendedprice", "l_quantity", "l_discount", "l_tax",
                  "l_returnflag", "l_linestatus"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _items(spark, sf_dir, ordered: bool = True) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    j = li.join(part, li.l_partkey == part.p_partkey, "left")
    return with_sequence(j, LINEITEM_ORDER) if ordered else j.withColumn("_seq", F.monotonically_increasing_id())


def ledger(spark: SparkSession, sf_dir: str, ordered: bool = True) -> DataFrame:
    """The ledger view; ``ordered=False`` for row-local queries, which need ``_seq`` to be unique at most."""
    j = _items(spark, sf_dir, ordered)
    td = F.to_date("l_shipdate")
    src = F.concat(F.lit("S"), (F.col("l_suppkey") % 10).cast("string"))
    price = F.col("l_extendedprice").cast(AMOUNT_TYPE)
    return j.select(
        td.alias("transaction_date"),
        F.date_add(td, (F.col("l_linenumber") % 3).cast("int")).alias("posting_date"),
        F.col("p_name").alias("description"),
        F.when(F.col("l_returnflag") == "R", -price).otherwise(price).alias("amount"),
        F.col("p_type").alias("category"),
        F.when(F.col("l_linestatus") == "F", "USD").otherwise("EUR").alias("currency"),
        src.alias("source_id"),
        F.concat(src, F.lit("/"), F.year("l_shipdate").cast("string")).alias("system_id"),
        F.concat(F.lit("#"), F.col("l_orderkey").cast("string"), F.lit("-"),
                 F.col("l_linenumber").cast("string")).alias("id"),
        F.lit(None).cast("array<string>").alias("tags"),
        F.col("_seq"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("rid"),
        F.to_date("o_orderdate").alias("date"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
        F.when(F.col("o_orderkey") % 2 == 0, "USD").otherwise("EUR").alias("currency"),
        F.col("o_orderkey").alias("_seq"),
    )


def txns(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir).filter(F.col("rid") % 10 != 0)
    k = (F.col("rid") % 5).cast("int")
    return r.select(
        F.col("rid").alias("tid"),
        F.date_add("date", (F.col("rid") % 4).cast("int")).alias("date"),
        F.round(F.col("amount") * (F.lit(100) - k) * F.lit(CENT_VALUE), 2).cast("decimal(18,2)").alias("amount"),
        F.col("currency"),
        F.col("_seq"),
    )


def order_items(spark: SparkSession, sf_dir: str, ordered: bool = True) -> DataFrame:
    """Order items; ``ordered`` as for ``ledger``."""
    j = _items(spark, sf_dir, ordered)
    return j.select(
        F.col("l_orderkey").alias("order_id"),
        F.to_date("l_shipdate").alias("date"),
        F.col("p_name").alias("title"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"),
        F.lit("USD").alias("currency"),
        F.col("l_returnflag").alias("returnflag"),
        F.col("_seq"),
    )


def refunds(spark: SparkSession, sf_dir: str, ordered: bool = True, items: DataFrame | None = None) -> DataFrame:
    """Refunds, from ``items`` if the order items are there already."""
    it = (order_items(spark, sf_dir, ordered) if items is None else items).filter(F.col("returnflag") == "R")
    return it.select("order_id", F.date_add("date", 7).alias("date"), "title",
                     (-F.col("amount")).alias("amount"), "currency", "_seq")


def order_records(spark: SparkSession, sf_dir: str, items: DataFrame | None = None) -> DataFrame:
    """Bank lines of the order fixture: one line per even multi-item order,
    one per item of odd orders, one per refund of odd orders."""
    it = order_items(spark, sf_dir) if items is None else items
    grouped = (it.groupBy("order_id")
                 .agg(F.count(F.lit(1)).alias("n"),
                      F.min_by("date", "_seq").alias("date"),
                      F.sum("amount").alias("total"),
                      F.min("_seq").alias("_seq"))
                 .filter((F.col("order_id") % 2 == 0) & (F.col("n") > 1)))
    k = (F.col("order_id") % 4).cast("int")
    per_order = grouped.select(
        F.date_add("date", (F.col("order_id") % 3).cast("int")).alias("transaction_date"),
        F.round(F.col("total") * (F.lit(100) - k) * F.lit(CENT_VALUE), 2).cast(AMOUNT_TYPE).alias("amount"),
        F.col("_seq"))
    per_item = it.filter(F.col("order_id") % 2 == 1).select(
        F.col("date").alias("transaction_date"), F.col("amount").cast(AMOUNT_TYPE).alias("amount"),
        F.col("_seq"))
    per_refund = refunds(spark, sf_dir, items=it).filter(F.col("order_id") % 2 == 1).select(
        F.date_add("date", (F.col("order_id") % 2).cast("int")).alias("transaction_date"),
        F.col("amount").cast(AMOUNT_TYPE).alias("amount"),
        (F.col("_seq") * 2 + 1).alias("_seq"))
    rows = per_order.withColumn("_seq", F.col("_seq") * 2).unionByName(
        per_item.withColumn("_seq", F.col("_seq") * 2)).unionByName(per_refund)
    return rows.select(
        "transaction_date",
        F.col("transaction_date").alias("posting_date"),
        F.lit("MARKETPLACE PURCHASE").alias("description"),
        "amount",
        F.lit(None).cast("string").alias("category"),
        F.lit("USD").alias("currency"),
        F.lit("card").alias("source_id"),
        F.concat(F.lit("card/"), F.year("transaction_date").cast("string")).alias("system_id"),
        F.concat(F.lit("#"), F.col("_seq").cast("string")).alias("id"),
        F.lit(None).cast("array<string>").alias("tags"),
        "_seq")


def wallet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wallet export rows: purchases as payments, plus a redemption
    row for every seventh event (amount 1, balance = payment amount + 1)."""
    ev = table(spark, sf_dir, "events").filter(
        F.col("event_type") == "purchase")
    pay_amount = (-F.col("value")).cast("decimal(18,2)")
    base = [F.to_date("ts").alias("date"),
            F.lit("USD").alias("currency"),
            F.col("event_id")]
    payments = ev.select(*base,
                         F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("name"),
                         F.lit(PAYMENT_TYPE).alias("type"),
                         pay_amount.alias("amount"),
                         F.lit(Decimal("0")).cast("decimal(18,2)").alias("balance"),
                         (F.col("event_id") * 2).alias("_seq"))
    redemptions = ev.filter(F.col("event_id") % 7 == 0).select(
        *base, F.lit(REDEMPTION_NAME).alias("name"), F.lit(REDEMPTION_TYPE).alias("type"),
        F.lit(Decimal("1")).cast("decimal(18,2)").alias("amount"),
        (pay_amount + 1).cast("decimal(18,2)").alias("balance"),
        (F.col("event_id") * 2 + 1).alias("_seq"))
    return payments.unionByName(redemptions).withColumn(
        "system_id", F.concat(F.lit("wallet/"), format_date("date", "yyyy-MM")))


def bank_wallet_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bank-side ledger lines of the wallet purchases (money out, positive)."""
    ev = table(spark, sf_dir, "events").filter(
        F.col("event_type") == "purchase")
    k = (F.col("event_id") % 3).cast("int")
    td = F.date_add(F.to_date("ts"), (F.col("user_id") % 4).cast("int"))
    return ev.select(
        td.alias("transaction_date"), td.alias("posting_date"),
        F.concat(F.lit("WALLET *"), F.col("event_id").cast("string")).alias("description"),
        F.round(F.col("value").cast("decimal(18,2)") * (F.lit(100) + k) * F.lit(CENT_VALUE), 2)
         .cast(AMOUNT_TYPE).alias("amount"),
        F.lit(None).cast("string").alias("category"),
        F.lit("USD").alias("currency"),
        F.lit("bank").alias("source_id"),
        F.lit("bank/wallet").alias("system_id"),
        F.concat(F.lit("#"), F.col("event_id").cast("string")).alias("id"),
        F.lit(None).cast("array<string>").alias("tags"),
        F.col("event_id").alias("_seq"))


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _items(spark, sf_dir)
    q = F.col("l_quantity").cast(AMOUNT_TYPE)
    return j.select(
        F.to_date("l_shipdate").alias("transaction_date"),
        F.to_date("l_shipdate").alias("posting_date"),
        F.col("p_name").alias("description"),
        F.when(F.col("l_returnflag") == "R", -q).otherwise(q).alias("amount"),
        F.lit(None).cast("string").alias("category"),
        F.lit("USD").alias("currency"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("source_id"),
        F.lit(None).cast("string").alias("system_id"),
        F.lit(None).cast("string").alias("id"),
        F.lit(None).cast("array<string>").alias("tags"),
        F.col("_seq"))


# Literal edge cases of money text, added to the order-derived texts.
MONEY_EDGE_CASES = [".50", "$-5", "1,234,567.00", "(12.00)", "", "abc", "-€1,000.5", " £ 7 "]


def money_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    sym = F.when(k % 3 == 0, "$").when(k % 3 == 1, "€").otherwise("")
    num = F.format_number(F.col("o_totalprice"), 2)
    text = (F.when(k % 5 == 0, F.concat(F.lit("-"), sym, num))
             .when(k % 5 == 1, F.concat(sym, F.lit("-"), num))
             .otherwise(F.concat(sym, num)))
    base = o.select(k.alias("key"), text.alias("text"))
    edges = spark.createDataFrame([(-(i + 1), t) for i, t in enumerate(MONEY_EDGE_CASES)],
                                  "key long, text string")
    return base.unionByName(edges)


# ---------------------------------------------------------------------------
# The same views as DuckDB CTEs.
# ---------------------------------------------------------------------------

_ITEMS = f"""items AS (
  SELECT l.*, p.p_name, p.p_type,
         row_number() OVER (ORDER BY {', '.join(LINEITEM_ORDER)}) AS _seq
  FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey)"""

SQL = {
    "items": _ITEMS,
    "ledger": """ledger AS (
  SELECT CAST(l_shipdate AS DATE) AS transaction_date,
         CAST(l_shipdate AS DATE) + CAST(l_linenumber % 3 AS INTEGER) AS posting_date,
         p_name AS description,
         CASE WHEN l_returnflag = 'R' THEN -CAST(l_extendedprice AS DECIMAL(18,4))
              ELSE CAST(l_extendedprice AS DECIMAL(18,4)) END AS amount,
         p_type AS category,
         CASE WHEN l_linestatus = 'F' THEN 'USD' ELSE 'EUR' END AS currency,
         'S' || CAST(l_suppkey % 10 AS VARCHAR) AS source_id,
         'S' || CAST(l_suppkey % 10 AS VARCHAR) || '/' || CAST(year(l_shipdate) AS VARCHAR) AS system_id,
         '#' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS id,
         CAST(NULL AS VARCHAR[]) AS tags,
         _seq
  FROM items)""",
    "records": """records AS (
  SELECT o_orderkey AS rid, CAST(o_orderdate AS DATE) AS date,
         CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
         CASE WHEN o_orderkey % 2 = 0 THEN 'USD' ELSE 'EUR' END AS currency,
         o_orderkey AS _seq
  FROM orders)""",
    "txns": """txns AS (
  SELECT rid AS tid, date + CAST(rid % 4 AS INTEGER) AS date,
         CAST(round(amount * CAST(100 - rid % 5 AS INTEGER) * 0.01, 2) AS DECIMAL(18,2)) AS amount,
         currency, _seq
  FROM records WHERE rid % 10 <> 0)""",
    "order_items": """order_items AS (
  SELECT l_orderkey AS order_id, CAST(l_shipdate AS DATE) AS date, p_name AS title,
         CAST(l_quantity AS INTEGER) AS quantity,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, 'USD' AS currency,
         l_returnflag AS returnflag, _seq
  FROM items)""",
    "refunds": """refunds AS (
  SELECT order_id, date + 7 AS date, title, -amount AS amount, currency, _seq
  FROM order_items WHERE returnflag = 'R')""",
    "movements": """movements AS (
  SELECT CAST(l_shipdate AS DATE) AS transaction_date,
         CAST(l_shipdate AS DATE) AS posting_date,
         p_name AS description,
         CASE WHEN l_returnflag = 'R' THEN -CAST(l_quantity AS DECIMAL(18,4))
              ELSE CAST(l_quantity AS DECIMAL(18,4)) END AS amount,
         'S' || CAST(l_suppkey AS VARCHAR) AS source_id,
         _seq
  FROM items)""",
    "wallet": f"""wallet_pay AS (
  SELECT CAST(ts AS DATE) AS date, 'USD' AS currency, event_id,
         'user ' || CAST(user_id AS VARCHAR) AS name, '{PAYMENT_TYPE}' AS type,
         CAST(-value AS DECIMAL(18,2)) AS amount, CAST(0 AS DECIMAL(18,2)) AS balance,
         event_id * 2 AS _seq
  FROM events WHERE event_type = 'purchase'),
wallet0 AS (
  SELECT * FROM wallet_pay
  UNION ALL
  SELECT date, currency, event_id, '{REDEMPTION_NAME}', '{REDEMPTION_TYPE}',
         CAST(1 AS DECIMAL(18,2)), CAST(amount + 1 AS DECIMAL(18,2)), event_id * 2 + 1
  FROM wallet_pay WHERE event_id % 7 = 0),
wallet AS (SELECT *, 'wallet/' || strftime(date, '%Y-%m') AS system_id FROM wallet0)""",
    "money_text": """money_text AS (
  SELECT o_orderkey AS key,
         CASE WHEN o_orderkey % 5 = 0 THEN '-' || sym || num
              WHEN o_orderkey % 5 = 1 THEN sym || '-' || num
              ELSE sym || num END AS text
  FROM (SELECT o_orderkey,
               CASE o_orderkey % 3 WHEN 0 THEN '$' WHEN 1 THEN '€' ELSE '' END AS sym,
               format('{:,.2f}', o_totalprice) AS num
        FROM orders)
  UNION ALL
  SELECT * FROM (VALUES """ + ", ".join(
        f"({-(i + 1)}, '{t}')" for i, t in enumerate(MONEY_EDGE_CASES)) + """) AS e(key, text))""",
}

DEPENDS = {
    "ledger": ["items"],
    "order_items": ["items"],
    "refunds": ["items", "order_items"],
    "movements": ["items"],
    "txns": ["records"],
}


def with_views(*names: str) -> str:
    """``WITH`` clause defining the named views (and what they depend on)."""
    ordered: list[str] = []
    for n in names:
        for d in DEPENDS.get(n, []) + [n]:
            if d not in ordered:
                ordered.append(d)
    return "WITH " + ",\n".join(SQL[n] for n in ordered) + "\n"
