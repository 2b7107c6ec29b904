"""Ledger quality operators: dedupe, overlapping statements, balance checks,
run summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.sequence import prev_in_group


def dedupe_last(df: DataFrame, keys: Sequence[str] = ("system_id", "id"),
                seq: str = "_seq") -> DataFrame:
    """Keep the last row (largest ``seq``) per key; null keys compare equal.

    ``max(seq)`` per key is a hash aggregate with map-side combining, so a key
    with a huge number of copies collapses before the shuffle; the survivors
    are then selected by a semi-join on the unique ``seq`` (evenly spread,
    no hot join key).
    """
    last = df.groupBy(*keys).agg(F.max(seq).alias(seq))
    return df.join(last.select(seq), seq, "left_semi")


def find_overlaps(df: DataFrame, source: str = "source_id", system: str = "system_id",
                  date: str = "posting_date", seq: str = "_seq") -> DataFrame:
    """Pairs of statements of one source whose posting-date ranges interleave.

    In each source, rows are ordered by (posting date, seq).  Where the
    statement changes to one that already appeared earlier in that order, the
    pair (previous statement, this statement) is reported as
    ``(first_id, second_id)`` with ``first_id < second_id``, distinct.
    The previous-row lookup runs on range partitions, so one source with most
    of the rows is still spread over many tasks.  Null sources count as one.
    """
    x = df.select(source, system, date, seq)
    x = prev_in_group(x, [source], [date, seq], [system], prefix="prev_")
    starts = x.filter(F.col("prev_" + system).isNull() | (F.col("prev_" + system) != F.col(system)))
    key = F.struct(F.col(source), F.col(date), F.col(seq))
    firsts = starts.groupBy(system).agg(F.min(key).alias("_first"))
    later = (starts.join(firsts, system, "inner")
                   .filter(key != F.col("_first"))
                   .filter(F.col("prev_" + system).isNotNull()))
    a, b = F.col(system), F.col("prev_" + system)
    return later.select(F.least(a, b).alias("first_id"), F.greatest(a, b).alias("second_id")).distinct()


def sign_sections(amount: str = "amount"):
    """Section of a card statement row: payments (negative) or purchases."""
    return F.when(F.col(amount) < 0, F.lit("payments")).otherwise(F.lit("purchases"))


def check_balances(df: DataFrame, expected: DataFrame, keys: Sequence[str] = ("system_id",),
                   amount: str = "amount", expected_col: str = "expected") -> DataFrame:
    """Rows of ``expected`` whose total differs from the sum of ``amount``
    over the matching ledger rows (a missing group counts as 0)."""
    actual = df.groupBy(*keys).agg(F.sum(amount).alias("actual"))
    j = expected.join(actual, list(keys), "left")
    act = F.coalesce(F.col("actual"), F.lit(0))
    return (j.filter(act != F.col(expected_col))
             .select(*keys, F.col(expected_col).alias("expected"), act.alias("actual")))


def run_summary(routed: DataFrame, kept: DataFrame, discarded: DataFrame,
                rejects: DataFrame | None = None) -> DataFrame:
    """Counts of a run.

    ``routed`` has one row per input file with ``status`` in
    ok / failed / unrecognised / skipped and ``records`` harvested.
    """
    files = routed.agg(
        F.count(F.lit(1)).alias("files_total"),
        F.count(F.when(F.col("status") == "ok", 1)).alias("files_ok"),
        F.count(F.when(F.col("status") == "failed", 1)).alias("files_failed"),
        F.count(F.when(F.col("status") == "unrecognised", 1)).alias("files_unrecognised"),
        F.count(F.when(F.col("status") == "skipped", 1)).alias("files_skipped"),
        F.coalesce(F.sum("records"), F.lit(0)).cast("long").alias("records_harvested"))
    # Counts of the other frames as scalar subqueries of the one-row file summary.
    cols = [F.col("*"),
            kept.select(F.count(F.lit(1))).scalar().alias("records_kept"),
            discarded.select(F.count(F.lit(1))).scalar().alias("records_discarded")]
    if rejects is not None:
        cols.append(rejects.select(F.count(F.lit(1))).scalar().alias("records_rejected"))
    return files.select(*cols)
