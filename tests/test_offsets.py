"""Offset pairing against a row-by-row Python model of the scan."""
import datetime as dt
import random
from collections import defaultdict
from decimal import Decimal

import pytest

from tallyspark.operators.offsets import pair_offsets
from tests.helpers import ledger_rows


def model(rows, refund=False, max_days=None):
    clusters = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["_seq"]):
        clusters[(r["source_id"], abs(r["amount"]))].append(r)
    pairs, unpaired = set(), set()
    for recs in clusters.values():
        if len(recs) < 2:
            continue
        recs = sorted(recs, key=lambda r: (r["transaction_date"], r["amount"] < 0))
        used = [False] * len(recs)
        for i, a in enumerate(recs):
            if used[i] or (refund and a["amount"] < 0):
                continue
            for j in range(i + 1, len(recs)):
                b = recs[j]
                if used[j] or (b["amount"] < 0) == (a["amount"] < 0):
                    continue
                if max_days is not None and (b["transaction_date"] - a["transaction_date"]).days >= max_days:
                    continue
                used[i] = used[j] = True
                pairs.add(frozenset((a["_seq"], b["_seq"])))
                break
        unpaired |= {r["_seq"] for k, r in enumerate(recs) if not used[k]}
    return pairs, unpaired


def random_rows(seed, n=400):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        amt = Decimal(rnd.choice([1, 2, 3, 5, 8])) * rnd.choice([1, -1])
        rows.append(dict(_seq=1000 + i * 7, source_id=rnd.choice(["A", "B", "C"]), amount=amt,
                         transaction_date=dt.date(2021, 1, 1) + dt.timedelta(days=rnd.randrange(90)),
                         id=f"#{i}"))
    return rows


def spark_pairs(df):
    by = defaultdict(set)
    for r in df.collect():
        by[r["pair_id"]].add(r["_seq"])
    return {frozenset(v) for v in by.values()}


@pytest.mark.parametrize("seed,refund,max_days", [(1, False, None), (2, True, None),
                                                  (3, False, 10), (4, True, 7), (5, False, 1)])
def test_pairs_match_model(spark, seed, refund, max_days):
    rows = random_rows(seed)
    df = ledger_rows(spark, rows)
    want_pairs, want_unpaired = model(rows, refund, max_days)
    got = spark_pairs(pair_offsets(df, "pairs", refund=refund, max_days=max_days))
    assert got == want_pairs
    un = {r["_seq"] for r in pair_offsets(df, "unpaired", refund=refund, max_days=max_days).collect()}
    assert un == want_unpaired


def test_all_output_keeps_every_row(spark):                       # Q12
    rows = random_rows(9, 120) + [dict(_seq=1, source_id="Z", amount=Decimal(77), id="#x")]
    df = ledger_rows(spark, rows)
    out = pair_offsets(df, "all")
    assert out.count() == len(rows)
    assert out.filter("_seq = 1").first()["pair_id"] is None


@pytest.mark.parametrize("refund,max_days", [(False, 4), (True, 4), (False, 1000)])
def test_one_cluster_with_most_rows(spark, refund, max_days):     # W5
    rnd = random.Random(12)
    rows = random_rows(7, 60)
    for i in range(1200):  # many rows a day, days without a gap
        rows.append(dict(_seq=50_000 + i, source_id=None, amount=Decimal(rnd.choice([4, 4, -4])),
                         transaction_date=dt.date(2021, 1, 1) + dt.timedelta(days=int(rnd.triangular(0, 40))), id=f"#h{i}"))
    df = ledger_rows(spark, rows)
    want_pairs, want_unpaired = model(rows, refund, max_days)
    assert spark_pairs(pair_offsets(df, "pairs", refund=refund, max_days=max_days)) == want_pairs
    assert {r["_seq"] for r in pair_offsets(df, "unpaired", refund=refund, max_days=max_days).collect()} == want_unpaired
