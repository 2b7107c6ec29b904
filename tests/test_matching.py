"""Matching against brute force and a global greedy model."""
import datetime as dt
import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import matching as M

R = M.Side(key="rid", date="date")
T = M.Side(key="tid", date="date")


def frames(spark, seed, n=120):
    rnd = random.Random(seed)
    cur = ["USD", "EUR", None]

    def row(i):
        amt = Decimal(rnd.randrange(-20000, 20000)) / 100 if rnd.random() > 0.05 else Decimal(0)
        return (i, dt.date(2022, 1, 1) + dt.timedelta(days=rnd.randrange(40)), amt,
                rnd.choice(cur), i * 3)
    recs = [row(i) for i in range(n)]
    txns = []
    for i in range(n):
        if rnd.random() < 0.7:
            base = rnd.choice(recs)
            amt = (base[2] * Decimal(rnd.choice(["1", "0.97", "1.02", "1.05", "0.9"]))).quantize(Decimal("0.01"))
            txns.append((1000 + i, base[1] + dt.timedelta(days=rnd.randrange(-4, 5)), amt, base[3], i * 5))
        else:
            txns.append((1000 + i,) + row(i)[1:4] + (i * 5,))
    schema_r = "rid long, date date, amount decimal(18,2), currency string, _seq long"
    schema_t = "tid long, date date, amount decimal(18,2), currency string, _seq long"
    return recs, txns, spark.createDataFrame(recs, schema_r), spark.createDataFrame(txns, schema_t)


def brute(recs, txns, days, amount):
    d = Decimal(amount) / 1000
    out = set()
    for r in recs:
        for t in txns:
            if r[3] != t[3]:
                continue
            if abs(t[2] - r[2]) <= d * abs(r[2]) and abs((t[1] - r[1]).days) <= days:
                out.add((r[0], t[0]))
    return out


@pytest.mark.parametrize("seed,days,amount", [(1, 3, 100), (2, 0, 0), (3, 5, 1000), (4, 2, 50)])
def test_candidate_pairs_equal_brute_force(spark, seed, days, amount):
    recs, txns, rdf, tdf = frames(spark, seed)
    got = {(r["rid"], r["tid"]) for r in M.candidate_pairs(rdf, tdf, days, amount, R, T).collect()}
    assert got == brute(recs, txns, days, amount)


@pytest.mark.parametrize("seed,days,amount,balance", [(1, 3, 100, 500), (2, 0, 0, 500), (3, 5, 1000, 300), (5, 9, 600, 0), (6, 4, 100, 1000)])
def test_nearest_pairs_hold_the_best_ones(spark, seed, days, amount, balance):
    _, _, rdf, tdf = frames(spark, seed)
    tdf = tdf.unionByName(tdf)
    rdf = rdf.unionByName(rdf.withColumn("rid", F.col("rid") + 500).withColumn("_seq", F.col("_seq") + 1))
    full, near = [M.score_pairs(M.candidate_pairs(rdf, tdf, days, amount, R, T, nearest=x), balance, days) for x in (False, True)]
    for best in (M.best_candidate, M.mutual_best):
        assert sorted(map(tuple, best(near).collect())) == sorted(map(tuple, best(full).collect()))


def test_nearest_pairs_grow_with_the_rows(spark):
    rows = spark.range(300).select(F.col("id").alias("rid"), F.lit(dt.date(2022, 1, 1)).alias("date"),
                                   ((F.col("id") + 10000) / 100).cast("decimal(18,2)").alias("amount"),
                                   F.lit(None).cast("string").alias("currency"), F.col("id").alias("_seq"))
    txns = rows.withColumnRenamed("rid", "tid")
    assert M.candidate_pairs(rows, txns, 2, 100, R, T).count() == 300 * 300
    assert M.candidate_pairs(rows, txns, 2, 100, R, T, nearest=True).count() <= 4 * 300


@pytest.mark.parametrize("seed,grid", [(1, [(3, 100, 500)])])
def test_rounds_over_nearest_pairs_match_alike(spark, seed, grid, monkeypatch):
    _, _, rdf, tdf = frames(spark, seed)
    rdf = rdf.unionByName(rdf.withColumn("rid", F.col("rid") + 500).withColumn("_seq", F.col("_seq") + 1))
    points = [M.GridPoint(i, *p) for i, p in enumerate(grid)]
    found, whole = [], M._class_pairs
    for limit in (M.PAIRS_PER_CLASS, 0):
        laid_out = []
        monkeypatch.setattr(M, "PAIRS_PER_CLASS", limit)
        monkeypatch.setattr(M, "_class_pairs", lambda *a: laid_out.append(whole(*a)) or laid_out[-1])
        res = M.grid_reconcile(rdf, tdf, points, R, T)
        found.append([sorted(map(tuple, x.collect())) for x in (res.matches, res.report)])
    assert found[0] == found[1]
    assert all(base.isEmpty() for base, _, _ in laid_out)


def greedy(pairs):
    order = sorted(pairs, key=lambda p: (-p["score"], abs(p["day_diff"]), abs(p["amount_diff"]),
                                         p["day_diff"] < 0, p["amount_diff"] < 0, p["r_seq"], p["t_seq"]))
    used_r, used_t, out = set(), set(), set()
    for p in order:
        if p["rid"] not in used_r and p["tid"] not in used_t:
            used_r.add(p["rid"])
            used_t.add(p["tid"])
            out.add((p["rid"], p["tid"]))
    return out


@pytest.mark.parametrize("seed,balance", [(5, 500), (6, 1000), (7, 0)])
def test_one_to_one_equals_global_greedy(spark, seed, balance):
    recs, txns, rdf, tdf = frames(spark, seed, 150)
    pairs = M.score_pairs(M.candidate_pairs(rdf, tdf, 4, 100, R, T), balance, 4)
    rows = pairs.collect()
    res = M.reconcile(rdf, tdf, 4, 100, balance, R, T)
    got = {(r["rid"], r["tid"]) for r in res.matches.collect()}
    assert got == greedy(rows)
    # a matching: no record or transaction used twice
    assert len({x for x, _ in got}) == len(got) == len({y for _, y in got})


def test_grid_winner_is_first_best(spark):
    recs, txns, rdf, tdf = frames(spark, 8)
    grid = M.make_grid([0, 2, 4], [0, 100], [500, 900])
    res = M.grid_reconcile(rdf, tdf, grid, R, T)
    rep = {r["grid_id"]: r for r in res.report.collect()}
    best = max(r["matched"] for r in rep.values())
    first = min(g for g, r in rep.items() if r["matched"] == best)
    assert res.winner.grid_id == first and rep[first]["chosen"]
    assert res.matches.count() == best
    single = M.reconcile(rdf, tdf, res.winner.max_days, res.winner.max_amount, res.winner.balance, R, T)
    assert {tuple(r) for r in single.matches.select("rid", "tid").collect()} == \
        {tuple(r) for r in res.matches.select("rid", "tid").collect()}


def test_score_formula_and_zero_drop(spark):
    df = spark.createDataFrame([(Decimal("100.00"), Decimal("90.00"), 2), (Decimal("-50"), Decimal("-50"), 0),
                                (Decimal("0"), Decimal("0"), 1)],
                               "r_amount decimal(18,2), t_amount decimal(18,2), day_diff int")
    got = [r[0] for r in df.select(M.score_expr(500, 4)).collect()]
    # 1000*(0.5*(1-10/100) + 0.5*(1-2/5)) = 750; negatives divide by abs (Q6); 0 vs 0 equal
    assert got == [750, 1000, 900]


def test_diff_tags_and_merge(spark):
    from tests.helpers import ledger_rows
    led = ledger_rows(spark, [dict(id="1", amount="10.50", tags=["x"], _seq=1),
                              dict(id="2", amount="7", _seq=2)])
    txns = spark.createDataFrame([(11, "Shop order", dt.date(2020, 1, 3))],
                                 "_seq long, title string, transaction_date date")
    matches = spark.createDataFrame([(1, 11, 900, Decimal("0.5000"), 2)],
                                    "rid long, tid long, score int, amount_diff decimal(19,4), day_diff int")
    out = {r["id"]: r for r in M.merge_matches(led, matches, txns, description="title",
                                               extra_tags=["shop"], amount_tag="T",
                                               days_tag="D").collect()}
    assert out["1"]["description"] == "Shop order"
    assert out["1"]["tags"] == ["D", "D_2", "T", "T_0.5", "shop", "x"]
    assert out["2"]["tags"] is None and out["2"]["description"] == "x"


def test_unclaimed(spark):
    txns = spark.createDataFrame([(1,), (2,)], "_seq long")
    m = spark.createDataFrame([(9, 2)], "rid long, tid long")
    assert [r[0] for r in M.unclaimed(txns, m).collect()] == [1]


def test_grid_parts_give_same_result(spark, monkeypatch):
    recs, txns, rdf, tdf = frames(spark, 11)
    grid = M.make_grid([1, 3], [50, 100], [500, 700])
    whole = M.grid_reconcile(rdf, tdf, grid, R, T)
    monkeypatch.setattr(M, "MASK_POINTS", 3)
    parts = M.grid_reconcile(rdf, tdf, grid, R, T)
    assert whole.winner == parts.winner
    assert sorted(tuple(r) for r in whole.report.collect()) == sorted(tuple(r) for r in parts.report.collect())
    assert {tuple(r) for r in whole.matches.collect()} == {tuple(r) for r in parts.matches.collect()}


def crowded(spark, seed):
    """Few amounts and days, so that classes have many equal rows and compete for each other."""
    rnd = random.Random(seed)
    def rows(first, step):
        return [(first + i, dt.date(2022, 1, 1) + dt.timedelta(days=rnd.randrange(5)),
                 Decimal(rnd.choice(["100", "101", "99", "-100"])), rnd.choice(["USD", None]), i * step) for i in range(140)]
    return [spark.createDataFrame(rows(a, b), f"{k} long, date date, amount decimal(18,2), currency string, _seq long")
            for k, a, b in (("rid", 0, 3), ("tid", 1000, 5))]


@pytest.mark.parametrize("seed,balance,days", [(21, 500, 3), (22, 0, 1), (23, 1000, 2)])
def test_equal_rows_equal_global_greedy(spark, seed, balance, days):
    rdf, tdf = crowded(spark, seed)
    rows = M.score_pairs(M.candidate_pairs(rdf, tdf, days, 100, R, T), balance, days).collect()
    res = M.reconcile(rdf, tdf, days, 100, balance, R, T)
    assert {(r["rid"], r["tid"]) for r in res.matches.collect()} == greedy(rows)


def test_rounds_do_not_grow_with_equal_rows(spark):
    day = dt.date(2022, 1, 1)
    def side(key, n, shift):
        return spark.range(n).select(F.col("id").alias(key), F.lit(day + dt.timedelta(days=shift)).alias("date"),
                                     F.lit(Decimal("9.99")).alias("amount"), F.lit("USD").alias("currency"), F.col("id").alias("_seq"))
    for shift in (0, 2):
        res = M.reconcile(side("rid", 5000, 0), side("tid", 6000, shift), 3, 0, 500, R, T)
        assert res.rounds <= 3
        assert res.matches.where("rid = tid").count() == res.matches.count() == 5000


def test_gaps_too_large_for_a_long(spark):
    wide = "decimal(18,4)"
    def side(key, rows):
        return spark.createDataFrame([(i, dt.date(y, 1, 1), Decimal(a), "USD", i) for i, (y, a) in enumerate(rows)],
                                     f"{key} long, date date, amount {wide}, currency string, _seq long")
    rdf, tdf = side("rid", [(1, "90000000000000"), (9999, "50000000000000.0001")]), side("tid", [(9000, "50000000000000"), (1, "1")])
    rows = M.score_pairs(M.candidate_pairs(rdf, tdf, 4_000_000, 1000, R, T), 500, 4_000_000).collect()
    res = M.reconcile(rdf, tdf, 4_000_000, 1000, 500, R, T)
    assert {(r["rid"], r["tid"]) for r in res.matches.collect()} == greedy(rows) and len(rows) == 4


def test_side_tables_are_released(spark):
    import glob
    from urllib.parse import urlparse
    from tallyspark.session import release_all
    rdf, tdf = crowded(spark, 3)
    M.reconcile(rdf, tdf, 1, 100, 500, R, T).matches.count()
    release_all(spark)
    assert glob.glob(urlparse(spark.sparkContext.getCheckpointDir()).path + "/tables/lineage-*") == []


def test_rounds_grow_with_the_logarithm_of_a_chain(spark):
    """Dates at ever smaller gaps: each pair waits for the next one, down to the closest."""
    rounds = {}
    for n in (8, 40):
        day, rows = 0, []
        for i in range(2 * n):  # records and transactions in turn, gaps 2n, 2n - 1, ..., 1
            rows.append((i, dt.date(2020, 1, 1) + dt.timedelta(days=day), Decimal(100), "USD", i))
            day += 2 * n - i
        recs, txns = rows[0::2], rows[1::2]
        rdf = spark.createDataFrame(recs, "rid long, date date, amount decimal(18,2), currency string, _seq long")
        tdf = spark.createDataFrame(txns, "tid long, date date, amount decimal(18,2), currency string, _seq long")
        # Only neighbours are within reach.
        res = M.reconcile(rdf, tdf, 2 * n, 0, 500, R, T)
        got = {(r["rid"], r["tid"]) for r in res.matches.collect()}
        pairs = M.score_pairs(M.candidate_pairs(rdf, tdf, 2 * n, 0, R, T), 500, 2 * n).collect()
        assert got == greedy(pairs)
        rounds[n] = res.rounds
    assert rounds[40] <= rounds[8] + 2 and rounds[40] <= 8, rounds


@pytest.mark.parametrize("plain", [0, 1, 50])
def test_chains_and_plain_rounds_agree(spark, monkeypatch, plain):
    monkeypatch.setattr(M, "PLAIN_ROUNDS", plain)
    recs, txns, rdf, tdf = frames(spark, 21, 150)
    grid = M.make_grid((3, 9), (100, 1000), (500,))
    res = M.grid_reconcile(rdf, tdf, grid, R, T)
    pairs = M.score_pairs(M.candidate_pairs(rdf, tdf, res.winner.max_days, res.winner.max_amount, R, T),
                          res.winner.balance, res.winner.max_days).collect()
    assert {(r["rid"], r["tid"]) for r in res.matches.collect()} == greedy(pairs)


def test_wide_tolerance_on_one_day_has_an_amount_key(spark):
    rows = [(i, dt.date(2020, 1, 1), Decimal(i), "USD", i) for i in range(-300, 700)]
    rdf = spark.createDataFrame(rows, "rid long, date date, amount decimal(18,2), currency string, _seq long")
    tdf = spark.createDataFrame(rows, "tid long, date date, amount decimal(18,2), currency string, _seq long")
    pairs = M.candidate_pairs(rdf, tdf, 0, 1000, R, T)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "_ab" in plan.split("Join Inner")[1].splitlines()[0]
    got = [(r["rid"], r["tid"]) for r in pairs.collect()]
    assert sorted(got) == sorted((a[0], b[0]) for a in rows for b in rows if abs(a[0] - b[0]) <= abs(a[0]))


def test_floor_of_scores_is_that_of_the_rounded_value(spark):
    near = [k + moved for k in (1, 2, 499, 750, 999, 1000) for gap in (0, 1e-13, 1e-11, 9e-10, 2e-9, 1e-8, 4e-7, 6e-7)
            for half in (0, 5e-7) for moved in (-half - gap, -half + gap)]
    near += [math.nextafter(k - 5e-7, side) for k in range(1, 1001) for side in (0, 2000)]
    near += [k - 5e-7 for k in range(1, 1001)] + [k / 7 for k in range(7001)]
    values = spark.createDataFrame([(float(x),) for x in near if 0 <= x <= 1000], "x double")
    wrong = values.where(M._floored(F.col("x")) != F.floor(F.round("x", 6)))
    assert wrong.isEmpty(), wrong.take(5)
