"""Queries over the reconciliation operators (J2..J10, J15, U5) on the
``records`` / ``txns`` views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions.scalars import tags_to_text
from tallyspark.operators import matching as M
from tallyspark.plans import fixtures as fx
from tallyspark.plans.registry import query

R = M.Side(key="rid", date="date")
T = M.Side(key="tid", date="date")

DAYS, AMOUNT, BALANCE = 5, 100, 500
# Grid of the sample order configuration: 9 x 1 x 6 = 54 points.
GRID = M.make_grid(M.param_range(1, 10), M.param_range(100), M.param_range(500, 800, 50))

# Unrolled rounds in the oracles; the Spark side loops until nothing is left
# and needs 7 rounds or fewer on these views.
ORACLE_ROUNDS = 12


def _pairs(spark, sf_dir, days=DAYS, amount=AMOUNT, nearest=False):
    return M.candidate_pairs(fx.records(spark, sf_dir), fx.txns(spark, sf_dir), days, amount, R, T, nearest=nearest)


def pairs_sql(days: int, amount: int, r_rel: str = "records", t_rel: str = "txns",
              r_key: str = "rid", t_key: str = "tid", r_date: str = "date", t_date: str = "date",
              name: str = "pairs") -> str:
    d = f"CAST({amount} AS DECIMAL(18,0)) * 0.001"
    return f"""{name} AS (
  SELECT r.{r_key} AS rid, t.{t_key} AS tid, r.amount AS r_amount, t.amount AS t_amount,
         r._seq AS r_seq, t._seq AS t_seq, r.amount - t.amount AS amount_diff,
         CAST(r._off AS BIGINT) AS day_diff
  FROM (SELECT *, unnest(range({-days}, {days + 1})) AS _off FROM {r_rel}) r
  JOIN {t_rel} t ON r.currency IS NOT DISTINCT FROM t.currency
   AND t.{t_date} = r.{r_date} + CAST(r._off AS INTEGER)
   AND abs(r.amount - t.amount) <= {d} * abs(r.amount))"""


def scored_sql(src: str = "pairs", balance: int = BALANCE, days: int = DAYS) -> str:
    return f"""scored AS (
  SELECT * FROM (SELECT *, {M.score_sql(balance, days)} AS score FROM {src}) WHERE score > 0)"""


def rounds_sql(src: str, group: list[str], rounds: int, prefix: str = "",
               out: str = "matched") -> str:
    """CTEs m1..mR of mutual-best rounds over ``src``; ``out`` unions them."""
    g = ", ".join(group + [""]) if group else ""
    on = "".join(f" AND m.{c} = p.{c}" for c in group)
    q = prefix + "q"
    mm = prefix + "m"
    parts = [f"{q}0 AS MATERIALIZED (SELECT * FROM {src})"]
    for i in range(1, rounds + 1):
        parts.append(f"""{mm}{i} AS MATERIALIZED (
  SELECT {g}rid, tid, score FROM (
    SELECT *, row_number() OVER (PARTITION BY {g}rid ORDER BY score DESC, abs(day_diff),
                                 abs(amount_diff), day_diff < 0, amount_diff < 0, t_seq) AS _rr,
              row_number() OVER (PARTITION BY {g}tid ORDER BY score DESC, abs(day_diff),
                                 abs(amount_diff), day_diff < 0, amount_diff < 0, r_seq) AS _rt
    FROM {q}{i - 1}) WHERE _rr = 1 AND _rt = 1)""")
        parts.append(f"""{q}{i} AS MATERIALIZED (
  SELECT * FROM {q}{i - 1} p
  WHERE NOT EXISTS (SELECT 1 FROM {mm}{i} m WHERE m.rid = p.rid{on})
    AND NOT EXISTS (SELECT 1 FROM {mm}{i} m WHERE m.tid = p.tid{on}))""")
    parts.append(f"{out} AS (" + " UNION ALL ".join(
        f"SELECT * FROM {mm}{i}" for i in range(1, rounds + 1)) + ")")
    return ",\n".join(parts)


BASE = fx.with_views("records", "txns")


@query("candidate_pairs", BASE + "," + pairs_sql(DAYS, AMOUNT) + """
SELECT rid, tid, CAST(amount_diff AS DOUBLE) AS amount_diff, day_diff FROM pairs""")
def candidate_pairs(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return p.select("rid", "tid", F.col("amount_diff").cast("double").alias("amount_diff"),
                    F.col("day_diff").cast("long").alias("day_diff"))


@query("match_scores", BASE + "," + pairs_sql(DAYS, AMOUNT) + "," + scored_sql() + """
SELECT rid, tid, score FROM scored""")
def match_scores(spark, sf_dir):
    return M.score_pairs(_pairs(spark, sf_dir), BALANCE, DAYS).select("rid", "tid", "score")


@query("best_candidate", BASE + "," + pairs_sql(DAYS, AMOUNT) + "," + scored_sql() + """
SELECT rid, tid FROM (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, abs(day_diff),
                               abs(amount_diff), day_diff < 0, amount_diff < 0, t_seq) AS rn FROM scored) WHERE rn = 1""")
def best_candidate(spark, sf_dir):
    return M.best_candidate(M.score_pairs(_pairs(spark, sf_dir, nearest=True), BALANCE, DAYS))


@query("diff_tags", BASE + "," + pairs_sql(DAYS, AMOUNT) + """
SELECT rid, tid, array_to_string(list_sort(list_filter([
    CASE WHEN amount_diff <> 0 THEN 'T' END,
    CASE WHEN amount_diff <> 0 THEN 'T_' || rtrim(rtrim(CAST(amount_diff AS VARCHAR), '0'), '.') END,
    CASE WHEN day_diff <> 0 THEN 'D' END,
    CASE WHEN day_diff <> 0 THEN 'D_' || CAST(day_diff AS VARCHAR) END], lambda x: x IS NOT NULL)), ' ') AS tags
FROM pairs""")
def diff_tags(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return p.select("rid", "tid", tags_to_text(M.diff_tags("T", "D")).alias("tags"))


@query("mutual_best_pairs", BASE + "," + pairs_sql(DAYS, AMOUNT) + "," + scored_sql() + "," +
       rounds_sql("scored", [], 1) + """
SELECT rid, tid FROM m1""")
def mutual_best_pairs(spark, sf_dir):
    return M.mutual_best(M.score_pairs(_pairs(spark, sf_dir, nearest=True), BALANCE, DAYS))


@query("reconcile_one_to_one", BASE + "," + pairs_sql(DAYS, AMOUNT) + "," + scored_sql() + "," +
       rounds_sql("scored", [], ORACLE_ROUNDS) + """
SELECT rid, tid, score FROM matched""")
def reconcile_one_to_one(spark, sf_dir):
    res = M.reconcile(fx.records(spark, sf_dir), fx.txns(spark, sf_dir), DAYS, AMOUNT, BALANCE, R, T)
    return res.matches.select("rid", "tid", "score")


@query("unclaimed_txns", BASE + "," + pairs_sql(DAYS, AMOUNT) + "," + scored_sql() + "," +
       rounds_sql("scored", [], ORACLE_ROUNDS) + """
SELECT tid, CAST(amount AS DOUBLE) AS amount, date FROM txns
WHERE tid NOT IN (SELECT tid FROM matched)""")
def unclaimed_txns(spark, sf_dir):
    tx = fx.txns(spark, sf_dir)
    res = M.reconcile(fx.records(spark, sf_dir), tx, DAYS, AMOUNT, BALANCE, R, T)
    u = M.unclaimed(tx, res.matches, T)
    return u.select("tid", F.col("amount").cast("double").alias("amount"), "date")


@query("reconcile_tags", BASE + "," + pairs_sql(DAYS, AMOUNT) + "," + scored_sql() + "," +
       rounds_sql("scored", [], ORACLE_ROUNDS) + """
SELECT r.rid, CASE WHEN m.tid IS NULL THEN NULL ELSE array_to_string(list_sort(list_filter([
    'recon',
    CASE WHEN p.amount_diff <> 0 THEN 'T' END,
    CASE WHEN p.amount_diff <> 0 THEN 'T_' || rtrim(rtrim(CAST(p.amount_diff AS VARCHAR), '0'), '.') END,
    CASE WHEN p.day_diff <> 0 THEN 'D' END,
    CASE WHEN p.day_diff <> 0 THEN 'D_' || CAST(p.day_diff AS VARCHAR) END], lambda x: x IS NOT NULL)), ' ')
    END AS tags, m.tid AS tid
FROM records r LEFT JOIN matched m ON m.rid = r.rid
LEFT JOIN pairs p ON p.rid = m.rid AND p.tid = m.tid""")
def reconcile_tags(spark, sf_dir):
    recs = fx.records(spark, sf_dir).withColumn("tags", F.lit(None).cast("array<string>"))
    tx = fx.txns(spark, sf_dir)
    res = M.reconcile(recs, tx, DAYS, AMOUNT, BALANCE, R, T)
    merged = M.merge_matches(recs, res.matches, tx, description=None, extra_tags=["recon"],
                             amount_tag="T", days_tag="D", t=T, r_key="rid")
    link = res.matches.select("rid", "tid")
    return (merged.join(link, "rid", "left")
            .select("rid", F.when(F.col("tags").isNotNull(), tags_to_text("tags")).alias("tags"), "tid"))


def grid_scored_sql(grid, src: str = "pairs", name: str = "gscored") -> str:
    """Pairs of ``src`` repeated for every grid point admitting them, scored."""
    rows = []
    for p in grid:
        d = f"CAST({p.max_amount} AS DECIMAL(18,0)) * 0.001"
        rows.append(f"""SELECT {p.grid_id} AS grid_id, * FROM (
    SELECT *, {M.score_sql(p.balance, p.max_days)} AS score FROM {src}
    WHERE abs(day_diff) <= {p.max_days} AND abs(amount_diff) <= {d} * abs(r_amount)) WHERE score > 0""")
    return f"{name} AS (\n" + "\nUNION ALL\n".join(rows) + ")"


def winner_sql(matched: str, name: str) -> str:
    """Matches of the grid point with the most matches (lowest id on ties)."""
    return f"""{name}_counts AS (SELECT grid_id, count(*) AS n FROM {matched} GROUP BY grid_id),
{name}_best AS (SELECT min(grid_id) AS grid_id FROM {name}_counts
                WHERE n = (SELECT max(n) FROM {name}_counts)),
{name} AS (SELECT m.rid, m.tid, m.score FROM {matched} m JOIN {name}_best USING (grid_id))"""


def _grid_pairs_sql() -> str:
    n_max = max(p.max_days for p in GRID)
    a_max = max(p.max_amount for p in GRID)
    return pairs_sql(n_max, a_max) + ",\n" + grid_scored_sql(GRID)


def _grid_values_sql() -> str:
    return "grid(grid_id, max_days, max_amount, balance) AS (VALUES " + ", ".join(
        f"({p.grid_id}, {p.max_days}, {p.max_amount}, {p.balance})" for p in GRID) + ")"


@query("grid_report", BASE + "," + _grid_pairs_sql() + "," + _grid_values_sql() + "," +
       rounds_sql("gscored", ["grid_id"], ORACLE_ROUNDS) + """,
counts AS (SELECT grid_id, count(*) AS n, min(score) AS mn FROM matched GROUP BY grid_id),
rep AS (
  SELECT g.grid_id, g.max_days, g.max_amount, g.balance, coalesce(c.n, 0) AS matched,
         c.mn AS min_score,
         (SELECT count(*) FROM records) - coalesce(c.n, 0) AS unmatched,
         (SELECT count(*) FROM txns) - coalesce(c.n, 0) AS unclaimed
  FROM grid g LEFT JOIN counts c USING (grid_id))
SELECT grid_id, max_days, max_amount, balance, matched, min_score, unmatched, unclaimed,
       matched > 0 AND grid_id = (SELECT min(grid_id) FROM rep
                                  WHERE matched = (SELECT max(matched) FROM rep)) AS chosen
FROM rep""")
def grid_report(spark, sf_dir):
    res = M.grid_reconcile(fx.records(spark, sf_dir), fx.txns(spark, sf_dir), GRID, R, T)
    return res.report
