"""Order helpers that stay distributed when one group is huge.

``with_sequence`` numbers rows in a total order with a range-partitioned sort
(no single-task window).  ``prev_in_group`` and ``rank_in_group`` are the lag
and row number of a window ``partitionBy(group).orderBy(order)``, computed in
two levels so that a hot group is spread over many tasks: rows are range-partitioned
by (group, order), the exact window runs inside a *block* (a group's part of one
partition), and block boundaries are fixed from a summary of the groups that may
lie in several blocks: the first and the last of every partition, so it has two
rows a partition at most and is broadcast.  Null group values count as equal.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def with_sequence(df: DataFrame, order: Sequence[str | Column], name: str = "_seq",
                  partitions: int | None = None) -> DataFrame:
    """Unique, order-preserving ``long`` per row (not dense).

    A range-partitioned sort spreads the work; the id of a row is its sorted
    partition index in the high bits and its position in the low bits.  Ids
    depend on how the sorted data is split, so the result is materialised
    (reliable checkpoint): every later use of the frame sees the same ids.
    """
    from tallyspark.session import cut_lineage
    order_cols = _cols(order)
    if partitions:
        ranged = df.repartitionByRange(partitions, *order_cols)
    else:
        ranged = df.repartitionByRange(*order_cols)
    return cut_lineage(ranged.sortWithinPartitions(*order_cols).withColumn(
        name, F.monotonically_increasing_id()))


def _in_blocks(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` with ``_g``, the group as one never-null value, and ``_blk``, the row's range partition.

    Materialised, as the partitions must stay the same for every later use.
    """
    from tallyspark.session import cut_lineage
    x = df.withColumn("_g", F.struct(*group))
    return cut_lineage(x.repartitionByRange("_g", *order).withColumn("_blk", F.spark_partition_id()))


def _of_cut_groups(x: DataFrame) -> DataFrame:
    """Rows of the groups that may lie in several blocks: each is the first or the last group of a partition."""
    ends = x.groupBy("_blk").agg(F.min("_g").alias("_low"), F.max("_g").alias("_high"))
    return x.join(F.broadcast(ends.select(F.explode(F.array("_low", "_high")).alias("_g")).distinct()), "_g", "left_semi")


def rank_in_group(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "_rank") -> DataFrame:
    """``row_number()`` over ``partitionBy(group).orderBy(order)``."""
    b, keys = "_blk", ["_g", "_blk"]
    whole = _in_blocks(df, group, order)
    inner = Window.partitionBy(*keys).orderBy(*order)
    x = whole.withColumn("_r_in_blk", F.row_number().over(inner))
    sizes = _of_cut_groups(whole).groupBy(*keys).agg(F.count(F.lit(1)).alias("_blk_n"))
    # One row per block of these groups: exclusive prefix sum of block sizes inside the group.
    before = Window.partitionBy("_g").orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_blk_off", F.coalesce(F.sum("_blk_n").over(before), F.lit(0))).drop("_blk_n")
    return (x.join(F.broadcast(offsets), keys, "left")
             .withColumn(name, (F.coalesce("_blk_off", F.lit(0)) + F.col("_r_in_blk")).cast("long"))
             .drop("_g", "_blk", "_blk_off", "_r_in_blk"))


def prev_in_group(df: DataFrame, group: Sequence[str], order: Sequence[str],
                  values: Sequence[str], prefix: str = "prev_") -> DataFrame:
    """``lag(v)`` over ``partitionBy(group).orderBy(order)`` for each value column."""
    b, keys = "_blk", ["_g", "_blk"]
    whole = x = _in_blocks(df, group, order)
    inner = Window.partitionBy(*keys).orderBy(*order)
    for v in values:
        x = x.withColumn(prefix + v, F.lag(v).over(inner))
    x = x.withColumn("_first_in_blk", F.row_number().over(inner) == 1)
    # Last row of every block, then the previous block's last row in the group.
    order_struct = F.struct(*order)
    last = _of_cut_groups(whole).groupBy(*keys).agg(F.max_by(F.struct(*values), order_struct).alias("_last"))
    w = Window.partitionBy("_g").orderBy(b)
    carry = last.select(*keys, F.lag("_last").over(w).alias("_carry"))
    x = x.join(F.broadcast(carry), keys, "left")
    for v in values:
        x = x.withColumn(prefix + v, F.when(F.col("_first_in_blk"), F.col("_carry")[v])
                         .otherwise(F.col(prefix + v)))
    return x.drop("_g", "_blk", "_first_in_blk", "_carry")


def prefix_sum_min(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str,
                   total: str = "_psum", min_before: str = "_pmin") -> DataFrame:
    """Running sum of ``value`` (inclusive) and the minimum of the running sum
    over the strictly earlier rows, floored at 0 (the empty prefix).

    Two levels like ``rank_in_group``: exact windows inside blocks, and a
    per-block carry (sum and minimum) from a summary with one row per block.
    """
    b, keys = "_blk", ["_g", "_blk"]
    whole = _in_blocks(df, group, order)
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    x = whole.withColumn("_ls", F.sum(value).over(upto))
    x = x.withColumn("_lmin", F.min("_ls").over(before))
    cut = _of_cut_groups(whole).withColumn("_ls", F.sum(value).over(upto))
    summ = cut.groupBy(*keys).agg(F.sum(value).alias("_bt"), F.min("_ls").alias("_bmin"))
    prev_blocks = Window.partitionBy("_g").orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    summ = summ.withColumn("_c", F.coalesce(F.sum("_bt").over(prev_blocks), F.lit(0)))
    summ = summ.withColumn("_x", F.col("_c") + F.col("_bmin"))
    summ = summ.withColumn("_m", F.min("_x").over(prev_blocks)).select(*keys, "_c", "_m")
    x = x.join(F.broadcast(summ), keys, "left").withColumn("_c", F.coalesce("_c", F.lit(0)))
    x = x.withColumn(total, F.col("_c") + F.col("_ls"))
    cand = F.least(F.lit(0), F.coalesce(F.col("_m"), F.lit(0)),
                   F.coalesce(F.col("_c") + F.col("_lmin"), F.lit(0)))
    x = x.withColumn(min_before, cand.cast("long"))
    return x.drop("_g", b, "_ls", "_lmin", "_c", "_m")


def dense_rank_by(df: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """Dense 0-based rank in a total order, computed without a single-task window.

    Range-partitioned sort, then each row's rank is its partition's offset
    (prefix sum of the per-partition counts: one row per partition, so the
    offset table is bounded by the partition count and safe to broadcast)
    plus its position inside the partition.  The sorted frame is checkpointed
    first so partition ids and positions are stable.
    """
    from tallyspark.session import cut_lineage
    order_cols = _cols(order)
    s = df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
    s = cut_lineage(s.withColumn("_pid", F.spark_partition_id())
                     .withColumn("_mid", F.monotonically_increasing_id()))
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    pos = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (s.join(F.broadcast(offsets), "_pid")
             .withColumn(name, (F.col("_off") + pos).cast("long"))
             .drop("_pid", "_mid", "_off"))


def running_total(df: DataFrame, order: Sequence[str | Column], value: str, name: str) -> DataFrame:
    """Sum of ``value`` over all rows strictly before a row in a total order (0 for the first).

    Range-partitioned like ``dense_rank_by``: exact sums inside the partitions,
    carried on from a summary with one row per partition.
    """
    from tallyspark.session import cut_lineage
    order_cols = _cols(order)
    s = cut_lineage(df.repartitionByRange(*order_cols).withColumn("_pid", F.spark_partition_id()))
    totals = s.groupBy("_pid").agg(F.sum(value).alias("_n"))
    earlier = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("_pid", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_pid").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    return (s.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(F.broadcast(carried), "_pid")
             .withColumn(name, F.col("_off") + F.col("_in")).drop("_pid", "_off", "_in"))
