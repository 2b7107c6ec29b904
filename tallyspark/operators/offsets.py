"""Offset pairing: pair a record with a later opposite record of the same
size in the same source (transfers, refunds), then keep the pairs or the
leftovers.

Rows are clustered by (source, abs(amount)); inside a cluster the order is
(date, non-negative before negative, seq).  Each record, in that order, takes
the first later unpaired record of the opposite sign.

* Without a period limit this is exactly "the k-th non-negative row pairs
  with the k-th negative row", so pairing is a rank per (cluster, sign) and
  a window of two rows at most per (cluster, k) - no sequential scan, no hot key.
* Refund mode (only a non-negative row may open a pair) first drops the
  negative rows that find no opener: those where the running balance
  (+1 / -1) reaches a new minimum below zero.
* With a period limit ``max_days`` equal days of a cluster act alike, so rows are
  first counted per (cluster, day, sign).  A queue over these counts, at most one
  row a day, emits pairs of rank intervals: so many rows of one day with so many
  of another.  Intervals become single ranks, and ranks meet rows by an equi-join
  on (cluster, sign, rank): no scan over rows, however large a cluster is.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators.sequence import prefix_sum_min, rank_in_group
from tallyspark.session import cut_lineage

OUTPUTS = ("pairs", "unpaired", "all")


def pair_offsets(df: DataFrame, output: str = "pairs", refund: bool = False,
                 max_days: int | None = None, keys: Sequence[str] = ("source_id",),
                 date: str = "transaction_date", amount: str = "amount",
                 seq: str = "_seq") -> DataFrame:
    """Offset pairing.

    ``output="pairs"``: rows that found a partner, with ``pair_id``;
    ``"unpaired"``: rows of clusters of 2 or more that found none;
    ``"all"``: every row, ``pair_id`` null when unpaired (nothing is lost).
    """
    if output not in OUTPUTS:
        raise ValueError(f"output must be one of {OUTPUTS}")
    cl = ["_keys", "_abs"]  # a struct of keys is never null, so that null keys are equal
    x = (df.withColumn("_keys", F.struct(*keys)).withColumn("_abs", F.abs(F.col(amount)))
           .withColumn("_neg", F.col(amount) < 0))
    if max_days is not None:  # an inner join for pairs: whatever has a partner is in a cluster of 2 or more
        ids = _pair_ids_limited(x, cl, int(max_days), refund, date, seq)
        res = x.join(ids, seq, "inner" if output == "pairs" else "left")
    else:
        res = _paired_unlimited(x, cl, refund, date, seq)
    if output == "pairs":
        res = res.filter(F.col("pair_id").isNotNull())
    elif output == "unpaired":
        sizes = x.groupBy(*cl).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
        res = res.join(sizes.select(*cl), cl, "left_semi").filter(F.col("pair_id").isNull())
    cols = list(df.columns) + ([] if output == "unpaired" else ["pair_id"])
    return res.select(*cols)


def _paired_unlimited(x: DataFrame, cl: list[str], refund: bool, date: str, seq: str) -> DataFrame:
    """All rows with ``pair_id``: the k-th rows of both signs of a cluster meet in one window, rows stay whole."""
    live = F.lit(True)
    if refund:
        step = F.when(F.col("_neg"), F.lit(-1)).otherwise(F.lit(1)).cast("long")
        x = prefix_sum_min(x.withColumn("_step", step), cl, [date, "_neg", seq], "_step")
        live = ~(F.col("_neg") & (F.col("_psum") < F.col("_pmin")))
    ranked = rank_in_group(x.withColumn("_live", live), [*cl, "_neg", "_live"], [date, seq], name="_k")
    both = Window.partitionBy(*cl, "_live", "_k")
    return ranked.withColumn("pair_id", F.when(F.count("_neg").over(both) == 2, F.min(seq).over(both)))


class _Queue:
    """Open rows of one sign, as (day, first rank, how many), oldest day first."""

    def __init__(self):
        self.open: deque[list[int]] = deque()

    def expire(self, day: int, max_days: int) -> None:
        while self.open and day - self.open[0][0] >= max_days:
            self.open.popleft()

    def take(self, wanted: int) -> list[tuple[int, int]]:
        """(first rank, how many) of up to ``wanted`` of the oldest rows, which leave the queue."""
        out = []
        while wanted and self.open:
            head = self.open[0]
            n = min(wanted, head[2])
            out.append((head[1], n))
            head[1], head[2], wanted = head[1] + n, head[2] - n, wanted - n
            if not head[2]:
                self.open.popleft()
        return out


def _pair_days(max_days: int, refund: bool):
    """Pairs of rank intervals from day counts ordered by (cluster, day).

    Ranks count a cluster's rows of a sign by day from 1; on a day non-negative
    rows come first.
    """
    def run(batches):
        current, queues, ranks = None, None, None
        for pdf in batches:
            out = []
            for cluster, day, *counts in zip(pdf["_cluster"], pdf["_day"], pdf["_pos"], pdf["_negs"]):
                if cluster != current:
                    current, queues, ranks = cluster, (_Queue(), _Queue()), [1, 1]
                for sign in (0, 1):  # 0: non-negative
                    n, other = counts[sign], queues[1 - sign]
                    other.expire(day, max_days)
                    found = other.take(n)
                    for start, many in found:
                        pair = (ranks[sign], start) if sign == 0 else (start, ranks[sign])
                        out.append((cluster, *pair, many))
                        ranks[sign] += many
                        n -= many
                    if n and not (refund and sign):
                        queues[sign].open.append([day, ranks[sign], n])
                    ranks[sign] += n
            yield pd.DataFrame(out, columns=["_cluster", "_p", "_n", "_many"])
    return run


def _pair_ids_limited(x: DataFrame, cl: list[str], max_days: int, refund: bool,
                      date: str, seq: str) -> DataFrame:
    live = x.select(F.to_json(F.struct(*cl)).alias("_cluster"), "_neg", F.unix_date(F.col(date)).alias("_day"), seq)
    if max_days <= 0:
        return live.limit(0).select(seq, F.col(seq).alias("pair_id"))
    days = live.groupBy("_cluster", "_day").agg(F.count(F.when(~F.col("_neg"), 1)).alias("_pos"),
                                                F.count(F.when(F.col("_neg"), 1)).alias("_negs"))
    ordered = days.repartition("_cluster").sortWithinPartitions("_cluster", "_day")
    intervals = ordered.mapInPandas(_pair_days(max_days, refund), "_cluster string, _p long, _n long, _many long")
    pairs = cut_lineage(intervals.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_many") - 1)))
                        .select("_cluster", (F.col("_p") + F.col("_i")).alias("_p"), (F.col("_n") + F.col("_i")).alias("_n")))
    ranked = cut_lineage(rank_in_group(live, ["_cluster", "_neg"], ["_day", seq], name="_k"))
    pos = ranked.filter(~F.col("_neg")).select("_cluster", F.col("_k").alias("_p"), F.col(seq).alias("_sp"))
    neg = ranked.filter(F.col("_neg")).select("_cluster", F.col("_k").alias("_n"), F.col(seq).alias("_sn"))
    found = pairs.join(pos, ["_cluster", "_p"]).join(neg, ["_cluster", "_n"])
    both = found.select(F.least("_sp", "_sn").alias("pair_id"), F.explode(F.array("_sp", "_sn")).alias(seq))
    return both.select(seq, "pair_id")
