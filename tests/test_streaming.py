import os

from tallyspark.plans.rulesets import main_rules
from tallyspark.operators.rules import Pipeline, RulePass
from tallyspark.sources import sinks
from tallyspark.sources.csv import read_ledger_csv
from tallyspark.streaming.ledger_stream import read_ledger_stream, run_rules_stream
from tests.helpers import ledger_rows


def test_rules_stream_matches_batch(spark, tmp_dir):
    rows = [dict(id=f"#{i}", description=d, category=c, source_id=s)
            for i, (d, c, s) in enumerate([("red bolt", "LARGE", "S1"), ("blue widget", "SMALL", "S1"),
                                           ("hot gizmo", "PROMO", "S5"), ("old ring", "ECONOMY", "S7")])]
    src = os.path.join(tmp_dir, "in")
    sinks.write_ledger_csv(ledger_rows(spark, rows), src)
    rules, named = main_rules()
    pipe = Pipeline([RulePass("main", rules)], named=named)
    q = run_rules_stream(read_ledger_stream(spark, src), pipe, os.path.join(tmp_dir, "kept"),
                         os.path.join(tmp_dir, "disc"), os.path.join(tmp_dir, "ckpt"), available_now=True)
    q.awaitTermination(120)
    kept = {r["id"] for r in read_ledger_csv(spark, os.path.join(tmp_dir, "kept")).ledger.collect()}
    batch = pipe.run(read_ledger_csv(spark, src).ledger.drop("_file"))
    assert kept == {r["id"] for r in batch.kept.collect()}
