"""Queries over scalar functions (F1, F2, F3, F10..F16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.operators.rules import DISCARD_COL, apply_pass
from tallyspark.plans import fixtures as fx
from tallyspark.plans.q_rules import main_cte
from tallyspark.plans.registry import query
from tallyspark.plans.rulesets import main_rules

_P = S.MONEY_PATTERN


def _currency_sql(sym: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.CURRENCY_SYMBOLS.items())
    iso = ", ".join(f"'{c}'" for c in S.ISO_CURRENCIES)
    return f"CASE {sym} {cases} ELSE CASE WHEN {sym} IN ({iso}) THEN {sym} END END"


_MONEY_SQL = f"""
m AS (SELECT key, text, regexp_matches(text, '{_P}') AS ok,
             regexp_extract(text, '{_P}', 1) = '-' OR regexp_extract(text, '{_P}', 3) = '-' AS neg,
             regexp_extract(text, '{_P}', 2) AS sym,
             TRY_CAST(replace(regexp_extract(text, '{_P}', 4), ',', '') AS DECIMAL(18,4)) AS num
      FROM money_text)"""


@query("parse_money", fx.with_views("money_text") + "," + _MONEY_SQL + """
SELECT key, text, CAST(CASE WHEN ok THEN CASE WHEN neg THEN -num ELSE num END END AS DOUBLE) AS amount,
       CASE WHEN ok THEN sym END AS symbol
FROM m""")
def parse_money(spark, sf_dir):
    t = fx.money_text(spark, sf_dir)
    return t.select("key", "text", S.parse_money("text").cast("double").alias("amount"),
                    S.money_symbol("text").alias("symbol"))


@query("currency_from_symbol", fx.with_views("money_text") + "," + _MONEY_SQL + f"""
SELECT sym AS symbol, {_currency_sql('sym')} AS currency, count(*) AS n,
       {'sym IN (' + ', '.join(repr(c) for c in S.ISO_CURRENCIES) + ')'} AS is_code
FROM m WHERE ok GROUP BY sym""")
def currency_from_symbol(spark, sf_dir):
    t = fx.money_text(spark, sf_dir).filter(F.col("text").rlike(_P))
    sym = S.money_symbol("text")
    return t.groupBy(sym.alias("symbol")).agg(F.count(F.lit(1)).alias("n")).select(
        "symbol", S.currency_from_symbol("symbol").alias("currency"), "n",
        S.is_currency_code("symbol").alias("is_code"))


def _ell_sql(x: str, n: int, mode: str = "append") -> str:
    keep = n - 3
    short = f"left({x}, {keep}) || '...'" if mode == "append" else f"'...' || right({x}, {keep})"
    return f"CASE WHEN length({x}) > {n} THEN {short} ELSE {x} END"


def _plain_sql(x: str) -> str:
    return f"rtrim(rtrim(CAST({x} AS VARCHAR), '0'), '.')"


def _path_sql(p: str, n: int) -> str:
    name = f"regexp_extract({p}, '([^/]*)$', 1)"
    folder = f"regexp_extract({p}, '^(.*)/[^/]*$', 1)"
    room = f"({n} - length({name}) - 1)"
    return (f"CASE WHEN {p} IS NULL THEN NULL WHEN length({p}) <= {n} THEN {p} "
            f"WHEN length({name}) > {n} THEN '...' || right({name}, {n - 3}) "
            f"WHEN {room} < 3 THEN {name} "
            f"ELSE CASE WHEN length({folder}) > {room} THEN left({folder}, {room} - 3) || '...' "
            f"ELSE {folder} END || '/' || {name} END")


@query("record_labels", fx.with_views("ledger") + "," + main_cte() + f"""
SELECT _seq IS NOT NULL AS has_seq, concat_ws('|',
    CASE WHEN transaction_date = posting_date THEN CAST(transaction_date AS VARCHAR)
         ELSE CAST(transaction_date AS VARCHAR) || '|' || CAST(posting_date AS VARCHAR) END,
    {_plain_sql('amount')}, {_ell_sql('description', 40)}, {_ell_sql('category', 20)},
    CASE WHEN tags IS NOT NULL THEN '[' || array_to_string(tags, ', ') || ']' END,
    currency, {_ell_sql('id', 10)},
    CASE WHEN source_id IS NOT NULL OR system_id IS NOT NULL
         THEN coalesce(source_id, 'null') || '|' || {_path_sql('system_id', 40)} END) AS label
FROM main WHERE NOT _discarded""")
def record_labels(spark, sf_dir):
    rules, named = main_rules()
    kept = apply_pass(fx.ledger(spark, sf_dir), rules, "main", named).filter(~F.col(DISCARD_COL))
    return kept.select(F.col("_seq").isNotNull().alias("has_seq"), S.record_label().alias("label"))


@query("ellipsis", """WITH t AS (
  SELECT p_partkey AS k, p_name || ' / ' || p_type || ' / ' || p_brand AS txt,
         'archive/' || p_brand || '/' || p_type || '/' || p_name || '.csv' AS path
  FROM part)
SELECT k, """ + _ell_sql("txt", 20) + " AS head, " + _ell_sql("txt", 20, "prepend") + """ AS tail,
       """ + _path_sql("path", 24) + " AS short_path, " + _path_sql("path", 12) + """ AS tiny_path
FROM t""")
def ellipsis(spark, sf_dir):
    p = fx.table(spark, sf_dir, "part")
    t = p.select(F.col("p_partkey").alias("k"),
                 F.concat_ws(" / ", "p_name", "p_type", "p_brand").alias("txt"),
                 F.concat(F.lit("archive/"), F.col("p_brand"), F.lit("/"), F.col("p_type"),
                          F.lit("/"), F.col("p_name"), F.lit(".csv")).alias("path"))
    return t.select("k", S.ellipsis("txt", 20).alias("head"),
                    S.ellipsis("txt", 20, "prepend").alias("tail"),
                    S.path_ellipsis("path", 24).alias("short_path"),
                    S.path_ellipsis("path", 12).alias("tiny_path"))
