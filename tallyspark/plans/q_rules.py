"""Queries over rule passes (P*, R*, S19, U3, U4, F7, F8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions.scalars import tags_to_text, valid_tags
from tallyspark.operators.rules import (DISCARD_COL, RULE_COL, apply_pass, rule_audit)
from tallyspark.plans import fixtures as fx
from tallyspark.plans.registry import add_tag_sql, query, rx, tags_text_sql
from tallyspark.plans.rulesets import main_rules, sample_pipeline

# ----------------------------------------------------------------- SQL pieces

MAIN_RULE_SQL = f"""CASE
    WHEN {rx('description', r'\b(bolt|anvil|gear)\b')} AND {rx('category', '^(LARGE|MEDIUM)$')} THEN 0
    WHEN {rx('description', '^(red|blue) ')} AND transaction_date > DATE '1997-01-01'
         AND transaction_date < DATE '1998-12-31' THEN 1
    WHEN {rx('source_id', '^S[0-2]$')} AND {rx('description', 'widget')} THEN 2
    WHEN {rx('category', 'PROMO')} AND NOT {rx('description', 'hot|cold')} THEN 3
    WHEN {rx('description', 'gizmo')} OR {rx('category', '^ECONOMY$')} THEN 4
    WHEN {rx('currency', 'USD')} AND transaction_date BETWEEN DATE '2000-01-01' AND DATE '2001-12-31' THEN 5
    ELSE 6 END"""


def main_pass_sql(src: str = "ledger", live: str = "true") -> str:
    """SELECT applying pass ``main`` to ``src`` (rows with ``live`` false untouched)."""
    return f"""SELECT * EXCLUDE (_r), CASE WHEN ({live}) THEN {MAIN_RULE_SQL} END AS _r FROM {src}"""


def main_project(src: str) -> str:
    return f"""SELECT transaction_date, posting_date,
      CASE _r WHEN 3 THEN 'promo item' ELSE description END AS description,
      CASE _r WHEN 3 THEN -amount ELSE amount END AS amount,
      CASE _r WHEN 0 THEN 'HARDWARE' WHEN 1 THEN 'COLOUR' ELSE category END AS category,
      currency, source_id, system_id, id,
      CASE _r WHEN 0 THEN {add_tag_sql('tags', 'metal')}
              WHEN 1 THEN {add_tag_sql('tags', 'colour')}
              WHEN 3 THEN {add_tag_sql('tags', 'promo')}
              WHEN 4 THEN {add_tag_sql('tags', 'junk')}
              WHEN 6 THEN {add_tag_sql('tags', 'other')}
              ELSE tags END AS tags,
      _seq, coalesce(_r IN (2, 4), false) OR _discarded AS _discarded, _r
    FROM {src}"""


TIDY_RULE_SQL = """CASE
    WHEN coalesce(regexp_matches(category, '^HARDWARE$'), false) THEN 0
    WHEN coalesce(list_contains(tags, 'colour'), false) THEN 1
    WHEN NOT coalesce(list_contains(tags, 'other'), false) THEN 2
    END"""


def tidy_sql(src: str) -> str:
    return f"""SELECT transaction_date, posting_date,
      CASE _r WHEN 0 THEN 'hardware' ELSE description END AS description, amount,
      CASE _r WHEN 1 THEN 'PAINT' ELSE category END AS category,
      currency, source_id, system_id, id,
      CASE _r WHEN 1 THEN {add_tag_sql('tags', 'painted')}
              WHEN 2 THEN {add_tag_sql('tags', 'seen')} ELSE tags END AS tags,
      _seq, _discarded, _r
    FROM (SELECT * EXCLUDE (_r), CASE WHEN NOT _discarded THEN {TIDY_RULE_SQL} END AS _r
          FROM {src})"""


def main_cte(src: str = "ledger") -> str:
    return (f"m0 AS (SELECT *, false AS _discarded, NULL::INTEGER AS _r FROM {src}),\n"
            f"m1 AS ({main_pass_sql('m0', 'NOT _discarded')}),\n"
            f"main AS ({main_project('m1')})")


# ----------------------------------------------------------------- queries

def _main(spark, sf_dir):
    rules, named = main_rules()
    return apply_pass(fx.ledger(spark, sf_dir, ordered=False), rules, "main", named)


@query("rules_category_spend", fx.with_views("ledger") + "," + main_cte() + """
SELECT category, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total,
       count(*) FILTER (WHERE len(tags) > 0) AS tagged
FROM main WHERE NOT _discarded GROUP BY category""")
def rules_category_spend(spark, sf_dir):
    kept = _main(spark, sf_dir).filter(~F.col(DISCARD_COL))
    return kept.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("amount").cast("double").alias("total"),
        F.count(F.when(F.size("tags") > 0, 1)).alias("tagged"))


@query("rules_discarded", fx.with_views("ledger") + "," + main_cte() + f"""
SELECT system_id, id, description, category, CAST(amount AS DOUBLE) AS amount,
       {tags_text_sql('tags')} AS tags, _r AS rule
FROM main WHERE _discarded""")
def rules_discarded(spark, sf_dir):
    d = _main(spark, sf_dir).filter(F.col(DISCARD_COL))
    return d.select("system_id", "id", "description", "category",
                    F.col("amount").cast("double").alias("amount"),
                    tags_to_text("tags").alias("tags"), F.col(RULE_COL).alias("rule"))


def _pipeline_sql() -> str:
    return (fx.with_views("ledger") + ",\n"
            "p0 AS (SELECT *, false AS _discarded, NULL::INTEGER AS _r FROM ledger),\n"
            f"p1 AS ({tidy_sql('p0')}),\n"
            f"p2 AS ({main_project('(' + main_pass_sql('p1', 'NOT _discarded') + ')')}),\n"
            f"p3 AS ({tidy_sql('p2')})\n")


@query("rules_pipeline_ids", _pipeline_sql() + f"""
SELECT category, description, {tags_text_sql('tags')} AS tags, count(*) AS n,
       CAST(sum(amount) AS DOUBLE) AS total
FROM p3 WHERE NOT _discarded GROUP BY ALL""")
def rules_pipeline_ids(spark, sf_dir):
    res = sample_pipeline().run(fx.ledger(spark, sf_dir, ordered=False), ids=["tidy", "main", "tidy"])
    return (res.kept.groupBy("category", "description", tags_to_text("tags").alias("tags"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("double").alias("total")))


@query("rules_pipeline_discarded", _pipeline_sql() + """
SELECT category, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total
FROM p3 WHERE _discarded GROUP BY ALL""")
def rules_pipeline_discarded(spark, sf_dir):
    res = sample_pipeline().run(fx.ledger(spark, sf_dir, ordered=False), ids=["tidy", "main", "tidy"])
    return (res.discarded.groupBy("category")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("double").alias("total")))


@query("rule_audit_counts", fx.with_views("ledger") + "," + main_cte() + f"""
SELECT _r AS rule, count(*) AS n, count(*) FILTER (WHERE _discarded) AS discarded,
       {tags_text_sql('list_distinct(flatten(list(tags)))')} AS added_tags
FROM main WHERE _r IS NOT NULL GROUP BY _r""")
def rule_audit_counts(spark, sf_dir):
    rules, named = main_rules()
    a = rule_audit(fx.ledger(spark, sf_dir), rules, "main", named)
    return a.groupBy("rule").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("discarded"), 1)).alias("discarded"),
        tags_to_text(F.array_distinct(F.flatten(F.collect_set("added_tags")))).alias("added_tags"))


@query("tags_filter", fx.with_views("ledger") + "," + main_cte() + f"""
SELECT {tags_text_sql('tags')} AS tags, count(*) AS n,
       bool_and(len(list_filter(tags, lambda t: NOT regexp_full_match(t, '^\\w[\\w.-]*$'))) = 0) AS valid
FROM (SELECT list_sort(list_distinct(list_concat(tags, ['checked']))) AS tags FROM main
      WHERE NOT _discarded AND (list_contains(tags, 'metal') OR list_contains(tags, 'colour')
                                OR list_contains(tags, 'promo')))
GROUP BY ALL""")
def tags_filter(spark, sf_dir):
    from tallyspark.functions import predicates as P
    kept = _main(spark, sf_dir).filter(~F.col(DISCARD_COL))
    sel = kept.filter(P.any_of(P.has_tag("metal"), P.has_tag("colour"), P.has_tag("promo")))
    t = sel.select(F.array_sort(F.array_union("tags", F.array(F.lit("checked")))).alias("tags"))
    return t.groupBy(tags_to_text("tags").alias("tags")).agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(valid_tags("tags")).alias("valid"))
