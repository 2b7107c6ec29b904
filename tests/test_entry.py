import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["rid", "tid", "score"]


def test_every_oracle_has_a_query():
    qs, orc = E.queries(), E.oracle_sql()
    assert set(orc) <= set(qs)
    assert len(qs) >= 40


def test_queries_run_on_smallest_data(spark):
    qs = E.queries()
    for name in ["rules_category_spend", "dedupe_last", "statement_overlaps", "pair_offsets_pairs",
                 "parse_money", "group_orders"]:
        assert qs[name](spark, "/root/testdata/sf0.001").count() >= 0
