"""Steps that grew faster than their input, or did their work several times (findings of round 3)."""

import datetime as dt
import glob
import os
import random
from decimal import Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyspark.operators import matching as M
from tallyspark.operators import regions as G
from tallyspark.operators import sequence as Q
from tallyspark.operators.offsets import pair_offsets
from tallyspark.plans import fixtures as fx
from tallyspark.plans import q_marketplace, q_sources, q_statements
from tallyspark.sources.csv import read_card_csv, read_orders_csv
from tests.helpers import ledger_rows


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def tables(spark, folder):
    day = dt.datetime(2001, 3, 4)
    items = [(o, 1, 1, o % 3, 2.0, 10.5 + o, 0.0, 0.0, "R" if o % 4 == 0 else "N", "F", day) for o in range(1, 9)]
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                          "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                          "l_shipdate timestamp").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(1, "red pen", "SMALL")], "p_partkey long, p_name string, p_type string").write.parquet(f"{folder}/part.parquet")


def test_orders_are_small_files_and_records_scanned_once(spark, tmp_dir):     # F8, F9, F11, F23
    tables(spark, tmp_dir)
    path = f"{tmp_dir}/orders"
    cells = q_sources.order_cells(spark, tmp_dir)
    shuffled = cells._jdf.queryExecution().sparkPlan().toString().split("Exchange")[1]
    assert "SellerCredentials" not in shuffled                   # cells are made after the shuffle
    q_sources._one_file_each(cells, path, q_sources.MARKET_COMPRESSION)
    files = glob.glob(f"{path}/*/part-*")
    assert len(files) == 8 and all(f.endswith(".gz") for f in files)
    rows = read_orders_csv(spark, path, policy="skip_rows").rows
    assert optimized(rows).count("from_csv") == 1
    assert sorted(r["order_id"] for r in rows.collect()) == [str(i) for i in range(1, 9)]


def test_failed_files_are_found_in_typed_rows(spark, tmp_dir):                # F26
    os.makedirs(f"{tmp_dir}/c")
    with open(f"{tmp_dir}/c/a.csv", "w") as f:
        f.write("h\n2020-01-05,Sale,Coffee,Food,3.50,0\n")
    rows = read_card_csv(spark, f"{tmp_dir}/c", "card").rows
    assert "from_csv" not in optimized(rows) and rows.count() == 1


def test_block_summary_holds_cut_groups_only(spark):                          # F27 to F30
    df = spark.range(6000).select(F.when(F.col("id") < 3000, F.lit(-1)).otherwise((F.col("id") / 3).cast("int")).alias("g"),
                                  F.col("id").alias("o"))
    df = df.unionByName(spark.createDataFrame([(None, 7000), (None, 7001)], "g int, o long"))
    blocks = Q._in_blocks(df, ["g"], ["o"])
    parts = blocks.select("_blk").distinct().count()
    assert Q._of_cut_groups(blocks).select("_g").distinct().count() <= 2 * parts
    want = df.withColumn("k", F.row_number().over(Window.partitionBy("g").orderBy("o")).cast("long"))
    got = Q.rank_in_group(df, ["g"], ["o"], "k").select("g", "o", "k")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "rightHint=(strategy=broadcast)" in optimized(got)


def test_pairs_need_no_join(spark):                                           # F27, F28, F30
    rows = ledger_rows(spark, [dict(amount=a, transaction_date=dt.date(2020, 1, i + 1)) for i, a in enumerate([5, -5, -7, 7, 9])])
    for refund, want in ((False, {1, 2, 3, 4}), (True, {1, 2})):
        pairs = pair_offsets(rows, "pairs", refund=refund)
        assert "Join Inner" not in optimized(pairs)
        assert {r["_seq"] for r in pairs.collect()} == want


def test_statement_layouts_share_one_ordered_ledger(spark, tmp_dir, monkeypatch):   # F22
    tables(spark, tmp_dir)
    calls, plain = [], fx.with_sequence
    monkeypatch.setattr(fx, "with_sequence", lambda *a, **k: calls.append(1) or plain(*a, **k))
    checks = q_statements.statement_balance_checks(spark, tmp_dir)
    assert calls == [1] and checks.count() == 0


def sides(spark, seed, n=60):
    rnd = random.Random(seed)
    def rows(first):
        return [(first + i, dt.date(2022, 1, 1) + dt.timedelta(days=rnd.randrange(6)), Decimal(rnd.randrange(950, 1050)) / rnd.choice([10, -10, 10]),
                 rnd.choice(["USD", None]), first - i) for i in range(n)]
    return [spark.createDataFrame(rows(first) + [(first + 500 + i, *x[1:]) for i, x in enumerate(rows(first)[:20])],
                                  f"{key} long, date date, amount decimal(18,2), currency string, _seq long")
            for key, first in (("rid", 1000), ("tid", 5000))]


def test_nearer_pairs_shade_others_and_the_last_go_in_order(spark, monkeypatch):   # F6
    rdf, tdf = sides(spark, 4)
    grid = M.make_grid([0, 1, 4], [50, 100], [0, 500])
    found = []
    for shade, last in ((99, 0), (1, 0), (99, 1 << 19)):
        monkeypatch.setattr(M, "SHADE_POINTS", shade)
        monkeypatch.setattr(M, "LAST_PAIRS", last)
        res = M.grid_reconcile(rdf, tdf, grid, M.Side("rid", date="date"), M.Side("tid", date="date"))
        found.append([sorted(map(str, x.collect())) for x in (res.report, res.matches)])
    assert found[0] == found[1] == found[2] and len(found[0][1]) > 20
    assert res.rounds == 1


def test_scored_pairs_do_not_grow_with_the_density(spark):                    # F6
    per_row = {}
    for n in (40, 160):
        rows = spark.range(n).select(F.col("id").alias("rid"), F.expr("date_add(date'2022-01-01', cast(id % 4 as int))").alias("date"),
                                     ((F.col("id") * 7919 % n + 10000) / 100).cast("decimal(18,2)").alias("amount"),
                                     F.lit("USD").alias("currency"), F.col("id").alias("_seq"))
        txns = rows.withColumnRenamed("rid", "tid")
        cls = [M._classes(rows, M.Side("rid", date="date")), M._classes(txns, M.Side("tid", date="date"))]
        base, _, _ = M._class_pairs(*cls, 3, 100)
        points = M.make_grid([0, 1, 2, 3], [100], [300, 600])
        state = M._with_mask(base, points)
        assert state.count() == n * n
        per_row[n] = [M._unshaded(state, side, points).count() / n for side in ("rid", "tid")]
    assert max(per_row[160]) <= 8 and max(per_row[160]) < 1.5 * max(per_row[40]), per_row


def test_regions_match_like_rounds(spark, monkeypatch):                       # F2, F4 to F15 of round 4
    rdf, tdf = sides(spark, 9, 300)
    rdf = rdf.withColumn("date", F.expr("date_add(date, cast(rid % 97 as int))"))
    tdf = tdf.withColumn("date", F.expr("date_add(date, cast(tid % 97 as int))"))
    for grid in (M.make_grid([0, 2, 5], [30, 1000], [0, 700]), M.make_grid([3], [100], [500])):
        found = []
        for most, last, per_region in ((0, 0, 1), (1 << 20, 1 << 20, 1 << 20), (1 << 20, 80, 100)):
            monkeypatch.setattr(G, "MOST_ROWS", most)
            monkeypatch.setattr(G, "LAST_ROWS", last)
            monkeypatch.setattr(G, "REGION_ROWS", per_region)
            res = M.grid_reconcile(rdf, tdf, grid, M.Side("rid", date="date"), M.Side("tid", date="date"))
            found.append([sorted(map(str, x.collect())) for x in (res.report, res.matches)])
            assert most == 0 or (res.rounds == 1) == (last > 80)
        assert found[0] == found[1] == found[2] and len(found[0][1]) > 50


def test_regions_shuffle_a_row_once(spark, monkeypatch):                      # F2, F4 to F15 of round 4
    rows = spark.range(4000).select(F.col("id").alias("rid"), F.expr("date_add(date'2022-01-01', cast(id % 400 as int))").alias("date"),
                                    ((F.col("id") * 7919 % 4000 + 10000) / 100).cast("decimal(18,2)").alias("amount"),
                                    F.lit("USD").alias("currency"), F.col("id").alias("_seq"))
    txns = rows.withColumnRenamed("rid", "tid").withColumn("date", F.expr("date_add(date, cast(tid % 4 as int))"))
    cls = [M._classes(rows, M.Side("rid", date="date")), M._classes(txns, M.Side("tid", date="date"))]
    passes, plain = [], G.cut_lineage
    monkeypatch.setattr(G, "cut_lineage", lambda df: passes.append(plain(df)) or passes[-1])
    monkeypatch.setattr(G, "LAST_ROWS", 2000)
    found = G.match_regions(*cls, M.make_grid([5], [100], [500]))
    assert 2 <= found.passes == len(passes) <= 4 and found.counts[0][0] == found.pairs.count()
    assert passes[0].where("rid is null or tid is null").count() < 4000        # rows at the blocks' borders alone go on


def test_orders_are_ordered_once(spark, tmp_dir, monkeypatch):                # F11 to F15 of round 4
    tables(spark, tmp_dir)
    calls, plain = [], fx.with_sequence
    monkeypatch.setattr(fx, "with_sequence", lambda *a, **k: calls.append(1) or plain(*a, **k))
    assert q_marketplace.reconcile_orders_small(spark, tmp_dir).count() == 4 and calls == [1]


def test_nearest_pairs_lay_a_row_out_once(spark, monkeypatch):                # F19, F21 of round 4
    rdf, tdf = sides(spark, 12, 200)
    sides_of = M.Side("rid", date="date"), M.Side("tid", date="date")
    best = {}
    for most in (0, G.MOST_ROWS):
        monkeypatch.setattr(G, "MOST_ROWS", most)
        near = M.candidate_pairs(rdf, tdf, 5, 100, *sides_of, nearest=True)
        assert ("Window" in optimized(near)) == (most == 0)
        best[most] = [[sorted(map(str, f(M.score_pairs(near, b, 5)).collect())) for f in (M.best_candidate, M.mutual_best)] for b in (0, 300, 1000)]
        counts = [M.candidate_pairs(rdf, tdf, n, 100, *sides_of, nearest=True).count() for n in (5, 50)]
    assert best[0] == best[most] and len(best[0][0][0]) > 100
    assert counts[1] == counts[0] <= 6 * (rdf.count() + tdf.count())     # more days than there are add no pair
