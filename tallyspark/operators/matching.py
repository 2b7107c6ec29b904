"""Reconciliation of ledger records with external transactions.

Pipeline (all DataFrame code, no driver loops over data):

1. ``candidate_pairs`` - band join: same currency (null equals null), amount
   within ``d`` of the record amount, dates within ``n`` days, all inclusive.
   Spark has no band join, so an equi key is added by hand: a date bucket of
   width ``2n+1`` and an amount bucket, on a log scale or, for wide tolerances,
   by quantiles of the transactions.  Only the record side is exploded (to the
   buckets its ranges touch, 1-4 pairs of them but for wide tolerances); the
   transaction side keeps one bucket, so each pair meets exactly once.
2. ``score_pairs`` - score 0..1000 mixing the amount and day gaps by ``balance``.
3. One-to-one matching is greedy by a strict order: score desc, day gap, amount
   gap, later dates and smaller amounts on the transaction side last, record
   order, transaction order.  Equal (currency, amount, date) rows of a side form
   a class; the order tells a class's partners apart, so classes are matched as
   a whole (k-th row to k-th row) and neither pairs nor rounds grow with them.
4. ``grid_reconcile`` - every point of a (days x amount x balance) grid at
   once: a class pair is one row with a bit mask of the points where it is still
   open, expanded only inside the two aggregations of a round.  The point with
   the most matches wins.
"""

from __future__ import annotations

import dataclasses
import math
from decimal import Decimal
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.scalars import plain_decimal
from tallyspark.operators.regions import match_regions, nearest_in_blocks
from tallyspark.operators.sequence import dense_rank_by
from tallyspark.session import cut_lineage, release

# Score scale and parameter limits.
MAX_MATCH_SCORE = 1000
MAX_BALANCE = 1000
MAX_AMOUNT_DIFF = 1000
DEFAULT_BALANCE = 500

_EPS = 1e-9


@dataclasses.dataclass(frozen=True)
class Side:
    """Column names of one side of the matching."""

    key: str = "_seq"
    amount: str = "amount"
    date: str = "transaction_date"
    currency: str = "currency"
    seq: str = "_seq"


LEDGER_SIDE = Side()


@dataclasses.dataclass(frozen=True)
class GridPoint:
    grid_id: int
    max_days: int
    max_amount: int      # per mille of the record amount
    balance: int = DEFAULT_BALANCE   # per mille weight of the amount score

    def __post_init__(self):
        if not 0 <= self.max_amount <= MAX_AMOUNT_DIFF:
            raise ValueError(f"max_amount {self.max_amount} outside 0..{MAX_AMOUNT_DIFF}")
        if not 0 <= self.balance <= MAX_BALANCE:
            raise ValueError(f"balance {self.balance} outside 0..{MAX_BALANCE}")
        if self.max_days < 0:
            raise ValueError("max_days must be >= 0")


def param_range(start: int, stop: int | None = None, step: int | None = None) -> list[int]:
    """Values of a parameter range: ``start`` alone, or ``start`` up to but
    excluding ``stop`` (at least one value); default step is a twentieth of the
    span, at least 1."""
    if stop is None or stop == start:
        return [start]
    if stop < start:
        raise ValueError(f"descending range {start}..{stop}")
    if step is None:
        step = max(1, (stop - start) // 20)
    if step <= 0:
        raise ValueError("step must be positive")
    return list(range(start, stop, step))


def make_grid(days: Sequence[int] = (0,), amounts: Sequence[int] = (0,),
              balances: Sequence[int] = (DEFAULT_BALANCE,)) -> list[GridPoint]:
    """Grid points numbered days outer, amount middle, balance inner."""
    pts, i = [], 0
    for n in days:
        for a in amounts:
            for b in balances:
                pts.append(GridPoint(i, n, a, b))
                i += 1
    return pts


# ---------------------------------------------------------------------------
# Candidate pairs
# ---------------------------------------------------------------------------

#: Tolerances from which amounts are bucketed by quantiles (below: on a log scale), and the buckets.
WIDE, QUANTILES = 0.5, 64


def _amount_bucket_width(d: float) -> float:
    return math.log((1 + d) / (1 - d))


def _amount_bounds(txns: DataFrame) -> list[float]:
    """Ascending amounts that part the transactions into about equal buckets (at most ``QUANTILES``)."""
    parts = [i / QUANTILES for i in range(1, QUANTILES)]
    found = txns.select(F.percentile_approx(F.col("t_amount").cast("double"), parts)).first()[0]
    return sorted(set(found or []))


def _bucket_of(amount: Column, bounds: Sequence[float]) -> Column:
    """How many bounds an amount reaches: it does not fall as the amount rises."""
    out = F.lit(0)
    x = amount.cast("double")
    for b in bounds:
        out = out + F.when(x >= b, 1).otherwise(0)
    return out


def _two_sides(records: DataFrame, txns: DataFrame, r: Side, t: Side) -> tuple[DataFrame, DataFrame]:
    rr = records.select(
        F.col(r.key).alias("rid"), F.col(r.currency).alias("r_cur"),
        F.col(r.amount).alias("r_amount"), F.col(r.date).cast("date").alias("r_date"),
        F.col(r.seq).alias("r_seq"))
    tt = txns.select(
        F.col(t.key).alias("tid"), F.col(t.currency).alias("t_cur"),
        F.col(t.amount).alias("t_amount"), F.col(t.date).cast("date").alias("t_date"),
        F.col(t.seq).alias("t_seq"))
    return rr, tt


def _day_buckets(rr: DataFrame, tt: DataFrame, n: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with ``_db``, buckets of ``2n+1`` days; a record is in all that its range touches."""
    width, rday = 2 * n + 1, F.unix_date("r_date")
    rr = rr.withColumn("_db", F.explode(F.sequence(
        F.floor((rday - n) / width), F.floor((rday + n) / width))))
    return rr, tt.withColumn("_db", F.floor(F.unix_date("t_date") / width)), ["_db"]


def _amount_buckets(rr: DataFrame, tt: DataFrame, d: Decimal, wide: bool = True) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with an amount bucket; a record is in all that its range touches.

    Without ``wide`` there are no buckets for tolerances from ``WIDE`` on.
    """
    dd = float(d)
    if d == 0:
        # Exact amounts: the amount itself is the key.
        return (rr.withColumn("_ab", F.col("r_amount").cast("decimal(38,18)")),
                tt.withColumn("_ab", F.col("t_amount").cast("decimal(38,18)")), ["_ab"])
    if dd >= WIDE:
        if not wide:
            return rr, tt, []
        # Wide ranges: buckets that hold as many transactions each; a record meets all that its range touches.
        bounds = _amount_bounds(tt)
        top, bottom = F.col("r_amount") + F.lit(d) * F.abs("r_amount"), F.col("r_amount") - F.lit(d) * F.abs("r_amount")
        rr = rr.withColumn("_ab", F.explode(F.sequence(_bucket_of(bottom, bounds), _bucket_of(top, bounds))))
        return rr, tt.withColumn("_ab", _bucket_of(F.col("t_amount"), bounds)), ["_ab"]
    w = _amount_bucket_width(dd)
    ra = F.abs(F.col("r_amount")).cast("double")
    rsign = F.signum(F.col("r_amount")).cast("int")
    lo = F.floor(F.log(ra * (1 - dd)) / w - _EPS)
    hi = F.floor(F.log(ra * (1 + dd)) / w + _EPS)
    rr = (rr.withColumn("_as", rsign)
            .withColumn("_ab", F.explode(F.when(rsign == 0, F.array(F.lit(0).cast("long")))
                                          .otherwise(F.sequence(lo, hi)))))
    ta = F.abs(F.col("t_amount")).cast("double")
    tsign = F.signum(F.col("t_amount")).cast("int")
    tt = (tt.withColumn("_as", tsign)
            .withColumn("_ab", F.when(tsign == 0, F.lit(0).cast("long"))
                        .otherwise(F.floor(F.log(ta) / w))))
    return rr, tt, ["_as", "_ab"]


def _within(d: Decimal) -> Column:
    return F.abs(F.col("r_amount") - F.col("t_amount")) <= F.lit(d) * F.abs(F.col("r_amount"))


_PAIR = ("rid", "tid", "currency", "r_amount", "t_amount", "r_date", "t_date", "r_seq", "t_seq", "amount_diff", "day_diff")


def _as_pairs(j: DataFrame, *more: str) -> DataFrame:
    return (j.withColumn("amount_diff", F.col("r_amount") - F.col("t_amount"))
             .withColumn("day_diff", F.datediff(F.col("t_date"), F.col("r_date"))).select(*_PAIR, *more))


def candidate_pairs(records: DataFrame, txns: DataFrame, max_days: int, max_amount: int,
                    r: Side = LEDGER_SIDE, t: Side = LEDGER_SIDE,
                    amount_buckets: bool = True, nearest: bool = False) -> DataFrame:
    """All (record, transaction) pairs within the tolerances.

    Output: ``rid, tid, currency, r_amount, t_amount, r_date, t_date, r_seq,
    t_seq, amount_diff`` (record - transaction) and ``day_diff``
    (transaction - record).

    ``nearest``: only those of the pairs that can be the best of their record or
    of their transaction, whatever the balance (see ``_nearest_pairs``).  Their
    number grows with the rows, not with the pairs.
    """
    n = int(max_days)
    d = Decimal(max_amount) / Decimal(MAX_AMOUNT_DIFF)
    rr, tt = _two_sides(records, txns, r, t)
    if nearest:
        return _nearest_pairs(rr, tt, n, d)
    rr, tt, keys = _day_buckets(rr, tt, n)
    if d == 0 or amount_buckets:
        rr, tt, more = _amount_buckets(rr, tt, d)
        keys = keys + more
    # A small input makes many pairs: both sides are spread over all shuffle partitions, whatever their size.
    rr = _spread(rr.withColumn("_cur", F.struct(F.col("r_cur").alias("c"))), "_cur", *keys)
    tt = _spread(tt.withColumn("_cur", F.struct(F.col("t_cur").alias("c"))), "_cur", *keys)
    j = rr.hint("merge").join(tt, ["_cur", *keys])
    j = j.filter(_within(d) & (F.abs(F.datediff(F.col("t_date"), F.col("r_date"))) <= n))
    return _as_pairs(j.withColumn("currency", F.col("r_cur")))


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _compared(records: DataFrame, txns: DataFrame, max_days: int, max_amount: int, r: Side, t: Side) -> int:
    """How many pairs the join of ``candidate_pairs`` compares: the sum over its keys of records times transactions."""
    rr, tt, keys = _day_buckets(*_two_sides(records, txns, r, t), int(max_days))
    rr, tt, more = _amount_buckets(rr, tt, Decimal(max_amount) / Decimal(MAX_AMOUNT_DIFF))
    keys = keys + more
    a = rr.groupBy("r_cur", *keys).agg(F.count(F.lit(1)).cast("double").alias("_rn"))
    b = tt.groupBy("t_cur", *keys).agg(F.count(F.lit(1)).cast("double").alias("_tn"))
    both = a.join(b, [a["r_cur"].eqNullSafe(b["t_cur"])] + [a[k] == b[k] for k in keys])
    return int(both.agg(F.sum(F.col("_rn") * F.col("_tn"))).first()[0] or 0)


def _nearest_pairs(rr: DataFrame, tt: DataFrame, n: int, d: Decimal, finder: bool = False) -> DataFrame:
    """For each row, its pairs that can be the best of it, whatever the balance.

    At a given day gap a score does not rise as the amounts part on either side, and equal
    scores are ordered by that difference, so each row's best pair is among the nearest
    amounts not above and not below its own of every gap.
    Of rows that are equal but for key and sequence, the first alone is found by others; a
    pair that both of its rows find comes twice.  ``finder``: with ``_of_r``, whether the
    record found it.
    """
    rr, tt = rr.dropna(subset=["r_amount", "r_date"]), tt.dropna(subset=["t_amount", "t_date"])
    j = nearest_in_blocks(rr, tt, n, int(d * MAX_AMOUNT_DIFF), lambda a, b: _amount_buckets(a, b, d, wide=False))
    if j is None:
        j = _nearest_by_windows(rr, tt, n, d).filter(_within(d))
    return _as_pairs(j, *(["_of_r"] if finder else []))


def _nearest_by_windows(rr: DataFrame, tt: DataFrame, n: int, d: Decimal) -> DataFrame:
    """The nearest pairs of each row and day gap, for rows that do not fit blocks.

    Both sides are laid out by (currency, transaction's day, gap, amount bucket) and sorted by
    amount; each row takes the last row of the other side before it, upwards and downwards.
    """
    first_r = Window.partitionBy("r_cur", "r_amount", "r_date").orderBy("r_seq", "rid")
    first_t = Window.partitionBy("t_cur", "t_amount", "t_date").orderBy("t_seq", "tid")
    rr = _spread(rr, "r_cur", "r_amount", "r_date").withColumn("_first", F.row_number().over(first_r) == 1)
    tt = _spread(tt, "t_cur", "t_amount", "t_date").withColumn("_first", F.row_number().over(first_t) == 1)
    rr, tt, keys = _amount_buckets(rr, tt, d, wide=False)
    gaps = F.explode(F.sequence(F.lit(-n), F.lit(n)))
    rr = rr.withColumn("_gap", gaps).withColumn("_day", F.date_add("r_date", F.col("_gap")))
    tt = tt.withColumn("_gap", gaps).withColumn("_day", F.col("t_date"))
    own_r, own_t = F.struct("r_amount", "r_seq", "rid"), F.struct("t_amount", "t_seq", "tid")
    a = rr.select(F.col("r_cur").alias("currency"), "_day", "_gap", *keys, F.col("r_amount").alias("_at"), "_first", own_r.alias("_r"))
    b = tt.select(F.col("t_cur").alias("currency"), "_day", "_gap", *keys, F.col("t_amount").alias("_at"), "_first", own_t.alias("_t"))
    x = a.unionByName(b, allowMissingColumns=True)
    at = Window.partitionBy("currency", "_day", "_gap", *keys)
    up = at.orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    down = at.orderBy(F.col("_at").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found_r, found_t = F.when(F.col("_first"), F.col("_r")), F.when(F.col("_first"), F.col("_t"))
    other = {}
    for name, w in (("up", up), ("down", down)):
        for side, found in (("r", found_r), ("t", found_t)):
            other[f"_{side}_{name}"] = F.last(found, ignorenulls=True).over(w)
    x = x.withColumns({k: v for k, v in other.items() if k.endswith("up")})
    x = x.withColumns({k: v for k, v in other.items() if k.endswith("down")})
    is_r = F.col("_r").isNotNull()
    below = F.struct(F.when(is_r, F.col("_r")).otherwise(F.col("_r_up")).alias("r"),
                     F.when(is_r, F.col("_t_up")).otherwise(F.col("_t")).alias("t"))
    above = F.struct(F.when(is_r, F.col("_r")).otherwise(F.col("_r_down")).alias("r"),
                     F.when(is_r, F.col("_t_down")).otherwise(F.col("_t")).alias("t"))
    # Both ways meet the same row where the amounts are equal.
    both = F.when(below["r"]["r_amount"] == below["t"]["t_amount"], F.array(below)).otherwise(F.array(below, above))
    return x.select("currency", "_day", "_gap", is_r.alias("_of_r"), F.explode(both).alias("p")).select(
        "currency", F.col("_day").alias("t_date"), F.date_sub("_day", F.col("_gap")).alias("r_date"), "_of_r", "p.r.*", "p.t.*")


# ---------------------------------------------------------------------------
# Scores
# ---------------------------------------------------------------------------

def score_expr(balance: int, max_days: int) -> Column:
    """Score 0..1000 of a pair row (needs ``r_amount, t_amount, day_diff``)."""
    b = balance / MAX_BALANCE
    nb = 1.0 - b
    ra = F.abs(F.col("r_amount"))
    ta = F.abs(F.col("t_amount"))
    big = F.greatest(ra, ta)
    rel = F.when(big == 0, F.lit(0.0)).otherwise(
        F.abs(F.col("r_amount") - F.col("t_amount")).cast("double") / big.cast("double"))
    day_rel = F.abs(F.col("day_diff")).cast("double") / F.lit(float(max_days + 1))
    s = F.lit(b) * (F.lit(1.0) - rel) + F.lit(nb) * (F.lit(1.0) - day_rel)
    return _floored(F.lit(float(MAX_MATCH_SCORE)) * s)


def _floored(x: Column) -> Column:
    """``floor(round(x, 6))`` as an int, for ``x`` from 0 to 1000.

    Rounding a double goes through its decimal digits, which costs more than the
    rest of a score.  It moves the floor only for a value within half a
    millionth below an integer, which adding that half settles; at the very
    edge, where the sum could be inexact, the digits decide.
    """
    moved = x + F.lit(5e-7)
    edge = F.abs(moved - F.rint(moved)) < F.lit(1e-9)
    return F.when(edge, F.floor(F.round(x, 6))).otherwise(F.floor(moved)).cast("int")


def score_sql(balance: int, max_days: int, p: str = "") -> str:
    """The same score in DuckDB SQL (for oracles)."""
    b = balance / MAX_BALANCE
    nb = 1.0 - b
    ra, ta = f"abs({p}r_amount)", f"abs({p}t_amount)"
    rel = (f"CASE WHEN greatest({ra}, {ta}) = 0 THEN 0.0::DOUBLE ELSE "
           f"CAST(abs({p}r_amount - {p}t_amount) AS DOUBLE) / CAST(greatest({ra}, {ta}) AS DOUBLE) END")
    day_rel = f"CAST(abs({p}day_diff) AS DOUBLE) / CAST({float(max_days + 1)!r} AS DOUBLE)"
    s = (f"CAST({b!r} AS DOUBLE) * (1.0::DOUBLE - ({rel})) + "
         f"CAST({nb!r} AS DOUBLE) * (1.0::DOUBLE - ({day_rel}))")
    return f"CAST(floor(round(CAST(1000.0 AS DOUBLE) * ({s}), 6)) AS INTEGER)"


def score_pairs(pairs: DataFrame, balance: int = DEFAULT_BALANCE, max_days: int = 0) -> DataFrame:
    """Add ``score``; pairs scoring 0 are dropped."""
    return pairs.withColumn("score", score_expr(balance, max_days)).filter(F.col("score") > 0)


# ---------------------------------------------------------------------------
# Best candidate, mutual best
# ---------------------------------------------------------------------------

def _pair_order(seq: Sequence[str]) -> Column:
    """The order of pairs as a struct: smaller is better."""
    return F.struct((-F.col("score")).alias("o0"), F.abs(F.col("day_diff")).alias("o1"),
                    F.abs(F.col("amount_diff")).alias("o2"), (F.col("day_diff") < 0).alias("o3"),
                    (F.col("amount_diff") < 0).alias("o4"), *[F.col(c) for c in seq])


def best_candidate(pairs: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Best scored pair per record."""
    best = pairs.groupBy(*group, "rid").agg(F.min(_pair_order(["t_seq", "tid"])).alias("b"))
    return best.select(*group, "rid", F.col("b")["tid"].alias("tid"))


def mutual_best(pairs: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Pairs that are the best for their record and for their transaction."""
    by_r = best_candidate(pairs, group)
    by_t = pairs.groupBy(*group, "tid").agg(F.min(_pair_order(["r_seq", "rid"])).alias("b"))
    return by_r.join(by_t.select(*group, "tid", F.col("b")["rid"].alias("rid")), [*group, "rid", "tid"])


# ---------------------------------------------------------------------------
# One-to-one matching of classes, all grid points at once
# ---------------------------------------------------------------------------

#: Points that share one bit mask.
MASK_POINTS = 63


def _classes(rows: DataFrame, side: Side) -> DataFrame:
    """One row per (currency, amount, date) of a side, named by its smallest key."""
    return (rows.select(F.col(side.currency).alias("currency"), F.col(side.amount).alias("amount"),
                        F.col(side.date).cast("date").alias("date"), F.col(side.key).alias("key"))
            .groupBy("currency", "amount", "date").agg(F.min("key").alias("cid"), F.count(F.lit(1)).alias("n")))


def _members(rows: DataFrame, classes: DataFrame, side: Side, key: str) -> DataFrame:
    """(``cid``, ``k``, key): the rows of each class in sequence order, numbered from 0."""
    own = rows.select(F.col(side.key).alias(key), F.col(side.currency).alias("currency"),
                      F.col(side.amount).alias("amount"), F.col(side.date).cast("date").alias("date"),
                      F.col(side.seq).alias("seq"))
    many = classes.filter(F.col("n") > 1)
    single = own.join(classes.filter(F.col("n") == 1).select(F.col("cid").alias(key)), key, "left_semi")
    out = single.select(F.col(key).alias("cid"), F.lit(0).cast("long").alias("k"), key)
    if many.isEmpty():
        return out
    same = [own[c].eqNullSafe(many[c]) for c in ("currency", "amount", "date")]
    placed = dense_rank_by(own.join(many, same).select("cid", "seq", key), ["cid", "seq", key], "place")
    first = placed.groupBy("cid").agg(F.min("place").alias("first"))
    return out.unionByName(placed.join(first, "cid").select("cid", (F.col("place") - F.col("first")).alias("k"), key))


def _literals(values, typ: str) -> Column:
    return F.array(*[F.lit(v).cast(typ) for v in values])


def _with_mask(pairs: DataFrame, points: Sequence[GridPoint]) -> DataFrame:
    """``pairs`` with ``mask``: the points (by position; sorted by ``max_days``) that admit the pair."""
    by_day = F.lit(0).cast("long")
    for k in sorted({p.max_days for p in points}):
        bits = F.lit(sum(1 << i for i, p in enumerate(points) if p.max_days == k)).cast("long")
        by_day = by_day.bitwiseOR(F.when(F.col("_absd") <= k, bits).otherwise(F.lit(0).cast("long")))
    mask = F.lit(0).cast("long")
    for a in sorted({p.max_amount for p in points}):
        d = Decimal(a) / Decimal(MAX_AMOUNT_DIFF)
        bits = F.lit(sum(1 << i for i, p in enumerate(points) if p.max_amount == a)).cast("long")
        within = F.abs(F.col("amount_diff")) <= F.lit(d) * F.abs(F.col("r_amount"))
        mask = mask.bitwiseOR(F.when(within, bits).otherwise(F.lit(0).cast("long")))
    return pairs.withColumn("mask", mask.bitwiseAND(by_day)).filter(F.col("mask") != 0)


def _priority(base: DataFrame) -> tuple[DataFrame, Column]:
    """``base`` with ``_near``, the order of pairs of equal score and day gap, and the priority from ``score``, the day gap and it.

    Packed into a long with widths taken from the largest gaps, or into
    a decimal where a long can't hold it: no gap is too large.  ``_near`` is odd
    where the transaction's amount is the larger one.
    """
    top = base.agg(F.max("_absd").alias("d"), F.max(F.abs("amount_diff")).alias("a")).first()
    scale = base.schema["amount_diff"].dataType.scale
    days, amounts = (top["d"] or 0) + 1, 4 * int((top["a"] or 0) * 10 ** scale) + 4
    wide = (MAX_MATCH_SCORE + 1) * days * amounts >= 1 << 63
    typ = "decimal(38,0)" if wide else "long"

    def num(c):
        return c.cast("decimal(38,0)") if wide else c.cast("long")

    signs = F.when(F.col("day_diff") < 0, 2).otherwise(0) + F.when(F.col("amount_diff") < 0, 1).otherwise(0)
    units = num(F.abs(F.col("amount_diff")) * F.lit(10 ** scale))
    rest = num(F.col("_absd")) * F.lit(amounts).cast(typ) + F.col("_near")
    unit = F.lit(Decimal(days * amounts) if wide else days * amounts).cast(typ)
    return base.withColumn("_near", (units * 4 + signs).cast(typ)), (num(F.lit(MAX_MATCH_SCORE) - F.col("score")) * unit + rest).cast(typ)


def _expand(state: DataFrame, points: Sequence[GridPoint], prio: Column) -> DataFrame:
    """One row per open (pair, point), with its score; narrow, so partitioning is kept."""
    first = F.lit(0)  # points whose days are too few come first
    for k in sorted({p.max_days for p in points}):
        first = first + F.when(F.col("_absd") > k, sum(p.max_days == k for p in points)).otherwise(0)
    x = state.withColumn("pos", F.explode(F.sequence(first, F.lit(len(points) - 1))))
    x = x.filter(F.expr("(shiftright(mask, pos) & 1L) = 1L"))

    def at(values, typ):
        return F.element_at(_literals(values, typ), F.col("pos") + 1)

    b = at([p.balance / MAX_BALANCE for p in points], "double")
    nb = at([1.0 - p.balance / MAX_BALANCE for p in points], "double")
    n1 = at([float(p.max_days + 1) for p in points], "double")
    s = b * (F.lit(1.0) - F.col("_rel")) + nb * (F.lit(1.0) - F.col("_absd").cast("double") / n1)
    x = x.withColumn("score", _floored(F.lit(float(MAX_MATCH_SCORE)) * s))
    return x.filter(F.col("score") > 0).withColumn("prio", prio)


#: Rounds that only take mutually best pairs; later ones, over fewer pairs, also resolve chains.
PLAIN_ROUNDS = 4

#: Points from which on a pair is scored only where no better one of its row is known, and day gaps told apart for that.
SHADE_POINTS, SHADE_DAYS = 8, 16


def _unshaded(state: DataFrame, side: str, points: Sequence[GridPoint]) -> DataFrame:
    """``state`` without the points of a pair at which its row of ``side`` has an open pair that is better for sure.

    That is one at no more days, with an amount that is nearer on the same side: it comes first whatever the balance.
    Of a row's pairs those are left that are nearer than all at fewer days, so their number grows with the days' logarithm
    (each open at all points), not with how many are within the tolerances.
    """
    if len(points) < SHADE_POINTS:
        return state
    last = max(p.max_days for p in points)
    days = sorted({last * i // (SHADE_DAYS - 1) for i in range(SHADE_DAYS)}, reverse=True)
    nearer = (Window.partitionBy(side, F.col("_near") % 2).orderBy("_near", "_absd")
              .rowsBetween(Window.unboundedPreceding, -1))
    x = state.withColumns({"_top": F.max("_rel").over(nearer),
                           **{f"_to{k}": F.bit_or(F.when(F.col("_absd") <= k, F.col("mask"))).over(nearer) for k in days}})
    shade = F.coalesce(*[F.when(F.col("_absd") >= k, F.col(f"_to{k}")) for k in days], F.lit(0).cast("long"))
    # Quotients of doubles may fall by a last digit as amounts part; then nothing is sure.
    shade = F.when(F.col("_top") <= F.col("_rel"), shade).otherwise(F.lit(0).cast("long"))
    return (x.withColumn("mask", F.col("mask").bitwiseAND(F.bitwise_not(shade))).filter(F.col("mask") != 0)
            .select(*state.columns))


def _mutual_best_rows(state: DataFrame, points: Sequence[GridPoint], prio: Column) -> DataFrame:
    """(rid, tid, pos) that are the best of both, with ``score, r_n, t_n``."""
    by_r = (_expand(_unshaded(state.repartition("rid"), "rid", points), points, prio).groupBy("rid", "pos")
            .agg(F.min_by("tid", "prio").alias("tid"), F.max("score").alias("score"), F.first("r_n").alias("r_n")))
    by_t = (_expand(_unshaded(state.repartition("tid"), "tid", points), points, prio).groupBy("tid", "pos")
            .agg(F.min_by("rid", "prio").alias("rid"), F.first("t_n").alias("t_n")))
    return by_r.join(by_t, ["rid", "tid", "pos"])


def _resolve_chains(open_pairs: DataFrame) -> DataFrame:
    """Like ``_mutual_best_rows``, with the pairs of chains that hang on these.

    A pair is taken if no better pair of its two classes is.  One with a single
    better pair waits for that one alone, and is taken just if that is not (all
    classes of one row): along a chain of such pairs every second one is taken,
    down from a mutually best pair.  Pointers along the chains are doubled, so a
    chain takes as many steps as its length has binary digits, not as many
    rounds as it has pairs.  Pairs that wait for several are left for later.
    """
    of_r, of_t = (Window.partitionBy(side, "pos").orderBy("prio") for side in ("rid", "tid"))
    ranked = (open_pairs.withColumns({"_rr": F.row_number().over(of_r), "_up_t": F.first("tid").over(of_r)})
              .withColumns({"_tt": F.row_number().over(of_t), "_up_r": F.first("rid").over(of_t)})
              .where("_rr + _tt <= 3 and (_rr + _tt = 2 or (r_n = 1 and t_n = 1))"))
    waits_r = F.col("_rr") == 2  # for its record's best pair; else for its transaction's
    links = cut_lineage(ranked.select(
        "rid", "tid", "pos", "score", "r_n", "t_n",
        F.when(F.col("_rr") + F.col("_tt") > 2, F.when(waits_r, F.col("rid")).otherwise(F.col("_up_r"))).alias("up_r"),
        F.when(F.col("_rr") + F.col("_tt") > 2, F.when(waits_r, F.col("_up_t")).otherwise(F.col("tid"))).alias("up_t"),
        F.lit(True).alias("taken")))
    while True:
        above = links.select(F.col("rid").alias("up_r"), F.col("tid").alias("up_t"), "pos", F.col("up_r").alias("next_r"),
                             F.col("up_t").alias("next_t"), F.col("taken").alias("up_taken"))
        waiting = links.where("up_r is not null")
        if waiting.isEmpty():
            return links.where("taken").select("rid", "tid", "pos", "score", "r_n", "t_n")
        # ``taken`` of a pair that points to another: whether it is the opposite of that one (at an end: whether it is
        # taken), so both combine alike.  Pairs whose chain ends in one that is not here drop out.
        moved = waiting.join(above, ["up_r", "up_t", "pos"]).select(
            "rid", "tid", "pos", "score", "r_n", "t_n", F.col("next_r").alias("up_r"), F.col("next_t").alias("up_t"),
            (F.col("taken") != F.col("up_taken")).alias("taken"))
        before, links = links, cut_lineage(links.where("up_r is null").unionByName(moved))
        release(before)


#: Class pairs up to which each point's open pairs are gone through in order, in one task a point: a bound, whatever the input.
LAST_PAIRS = 1 << 19


def _in_order(pairs: DataFrame, parts: int) -> DataFrame:
    """Greedy matching of open (pair, point) rows: ``pairs`` with ``take``, those taken only."""
    kept = ["rid", "tid", "pos", "score", "r_n", "t_n", "r_from", "t_from"]

    def take(point):
        point = point.sort_values("prio", kind="stable")
        used: dict[str, dict] = {"r": {}, "t": {}}
        rows = []
        for rid, tid, r_n, t_n, r, t in zip(*(point[c].tolist() for c in ("rid", "tid", "r_n", "t_n", "r_from", "t_from")), strict=True):
            r, t = used["r"].get(rid, r), used["t"].get(tid, t)
            n = min(r_n - r, t_n - t)
            rows.append((r, t, n))
            if n > 0:
                used["r"][rid], used["t"][tid] = r + n, t + n
        point["r_from"], point["t_from"], point["take"] = (list(x) for x in zip(*rows, strict=True))
        return point[point["take"] > 0][[*kept, "take"]]

    pairs = pairs.select(*kept, "prio")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema if f.name != "prio") + ", take long"
    return pairs.repartition(parts, "pos").groupBy("pos").applyInPandas(take, schema)


def _match_classes(base: DataFrame, points: Sequence[GridPoint], prio: Column, many: bool) -> tuple[DataFrame, int]:
    """Greedy matching of class pairs at every point: ``pos, rid, tid, score, take, r_from, t_from``.

    A round takes the pairs that are the best of both classes, as many rows as
    the smaller of what is left of them; that equals the greedy matching, as no
    pair of either class comes before.  Each side's best pairs are found where
    its pairs lie together, so that only their number is shuffled, not the number
    of (pair, point) rows; the state between rounds is one row per pair.  All
    frames between rounds are tables in the shared folder.  The last ``LAST_PAIRS``
    pairs are gone through in order instead.
    """
    state = cut_lineage(_with_mask(base, points).select("rid", "tid", "r_n", "t_n", "_absd", "_rel", "_near", "mask"))
    taken: list[DataFrame] = []
    named = state.filter(F.col("rid").isNull() | F.col("tid").isNull()).isEmpty()
    while True:
        last = named and state.count() <= LAST_PAIRS
        if last:
            m = _expand(state, points, prio)
        elif len(taken) >= PLAIN_ROUNDS:
            m = _resolve_chains(_expand(state, points, prio))
        else:
            m = _mutual_best_rows(state, points, prio)
        if many:
            for side in ("r", "t"):
                # Classes without rows left do not come again.
                used = [x.filter(F.col(f"{side}_from") + F.col("take") < F.col(f"{side}_n")).select(f"{side}id", "pos", "take")
                        for x in taken]
                m = _with_used(m, used, side)
        else:
            m = m.withColumn("r_from", F.lit(0).cast("long")).withColumn("t_from", F.lit(0).cast("long"))
        if last:
            m = cut_lineage(_in_order(m, len(points)))
            break
        m = cut_lineage(m.withColumn("take", F.least(F.col("r_n") - F.col("r_from"), F.col("t_n") - F.col("t_from"))))
        if m.isEmpty():
            break
        taken.append(m)
        gone = {}
        for side in ("r", "t"):
            gone[side] = (m.filter(F.col(f"{side}_from") + F.col("take") == F.col(f"{side}_n"))
                          .groupBy(f"{side}id").agg(F.expr("bit_or(shiftleft(1L, pos))").alias(f"gone_{side}")))
        none = F.lit(0).cast("long")
        open_ = (state.join(gone["r"], "rid", "left").join(gone["t"], "tid", "left")
                 .withColumn("mask", F.col("mask").bitwiseAND(F.bitwise_not(
                     F.coalesce("gone_r", none).bitwiseOR(F.coalesce("gone_t", none)))))
                 .filter(F.col("mask") != 0).drop("gone_r", "gone_t"))
        before, state = state, cut_lineage(open_.select(*state.columns))
        release(before)
    release(state)
    columns = ["pos", "rid", "tid", "score", "take", "r_from", "t_from"]
    out = m.select(*columns)
    for x in taken:
        out = out.unionByName(x.select(*columns))
    return out, len(taken) + 1


#: Compared class pairs per class and grid point (of at most ``PAIR_POINTS``) up to which all pairs are laid out.
PAIRS_PER_CLASS, PAIR_POINTS = 64, 6

_CLASS = Side(key="cid", amount="amount", date="date", currency="currency", seq="cid")


def _nearest_rounds(r_cls: DataFrame, t_cls: DataFrame, p: GridPoint,
                    limit: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Rounds of mutually best class pairs of one point, until the classes left make at most ``limit`` compared pairs.

    Each round looks at the nearest pairs only, so that its work grows with the classes left.
    Returns both sides' classes with rows left (``used``: how many are taken) and the
    pairs taken: ``rid, tid, score, take, r_from, t_from, amount_diff, day_diff``.
    """
    left = {"r": r_cls.withColumn("used", F.lit(0).cast("long")), "t": t_cls.withColumn("used", F.lit(0).cast("long"))}
    d = Decimal(p.max_amount) / Decimal(MAX_AMOUNT_DIFF)
    taken: list[DataFrame] = []
    while _compared(left["r"], left["t"], p.max_days, p.max_amount, _CLASS, _CLASS) > limit:
        pairs = _nearest_pairs(*_two_sides(left["r"], left["t"], _CLASS, _CLASS), int(p.max_days), d, finder=True)
        pairs = score_pairs(pairs, p.balance, p.max_days)
        best = cut_lineage(pairs.groupBy("_of_r", F.when(F.col("_of_r"), F.col("rid")).alias("_r"),
                                         F.when(~F.col("_of_r"), F.col("tid")).alias("_t"))
                           .agg(F.min(_pair_order(["rid", "tid", "day_diff", "amount_diff"])).alias("b"))
                           .select("_of_r", "b.rid", "b.tid", (-F.col("b.o0")).alias("score"), "b.day_diff", "b.amount_diff"))
        m = best.where("_of_r").drop("_of_r").join(best.where("not _of_r").select("rid", "tid"), ["rid", "tid"])
        for side in ("r", "t"):
            m = m.join(left[side].select(F.col("cid").alias(f"{side}id"), F.col("n").alias(f"{side}_n"),
                                         F.col("used").alias(f"{side}_from")), f"{side}id")
        m = cut_lineage(m.withColumn("take", F.least(F.col("r_n") - F.col("r_from"), F.col("t_n") - F.col("t_from")))
                        .select("rid", "tid", "score", "take", "r_from", "t_from", "amount_diff", "day_diff"))
        release(best)
        if m.isEmpty():  # no open pair scores above 0
            return left["r"].limit(0), left["t"].limit(0), taken
        taken.append(m)
        for side in ("r", "t"):
            before = left[side]
            left[side] = cut_lineage(before.join(m.select(F.col(f"{side}id").alias("cid"), "take"), "cid", "left")
                                     .withColumn("used", F.col("used") + F.coalesce("take", F.lit(0).cast("long")))
                                     .filter(F.col("used") < F.col("n")).select(*before.columns))
            release(before)
    return left["r"], left["t"], taken


def _with_used(m: DataFrame, used: list[DataFrame], side: str) -> DataFrame:
    """``m`` with how many rows of the class earlier rounds took at the point."""
    if not used:
        return m.withColumn(f"{side}_from", F.lit(0).cast("long"))
    whole = used[0]
    for x in used[1:]:
        whole = whole.unionByName(x)
    sums = whole.groupBy(f"{side}id", "pos").agg(F.sum("take").alias(f"{side}_from"))
    return (m.join(sums, [f"{side}id", "pos"], "left")
             .withColumn(f"{side}_from", F.coalesce(f"{side}_from", F.lit(0).cast("long"))))


# ---------------------------------------------------------------------------
# Grid search and merge
# ---------------------------------------------------------------------------

@dataclasses.dataclass
class Reconciliation:
    matches: DataFrame            # rid, tid, score, amount_diff, day_diff of the winner
    report: DataFrame             # one row per grid point
    winner: GridPoint | None
    rounds: int


def _class_pairs(r_cls: DataFrame, t_cls: DataFrame, max_days: int, max_amount: int) -> tuple[DataFrame, Column, bool]:
    """Candidate class pairs with the rows left of both classes, their priority, and whether a class has several."""
    def left(cls):
        return F.col("n") - F.col("used") if "used" in cls.columns else F.col("n")

    pairs = candidate_pairs(r_cls, t_cls, max_days, max_amount, _CLASS, _CLASS)
    many = not r_cls.filter(left(r_cls) > 1).isEmpty() or not t_cls.filter(left(t_cls) > 1).isEmpty()
    if many:
        pairs = (pairs.join(r_cls.select(F.col("cid").alias("rid"), left(r_cls).alias("r_n")), "rid")
                      .join(t_cls.select(F.col("cid").alias("tid"), left(t_cls).alias("t_n")), "tid"))
    else:
        pairs = pairs.withColumn("r_n", F.lit(1).cast("long")).withColumn("t_n", F.lit(1).cast("long"))
    big = F.greatest(F.abs(F.col("r_amount")), F.abs(F.col("t_amount")))
    rel = F.when(big == 0, F.lit(0.0)).otherwise(F.abs(F.col("amount_diff")).cast("double") / big.cast("double"))
    base = cut_lineage(pairs.select("rid", "tid", "r_n", "t_n", "r_amount", "amount_diff", "day_diff",
                                    F.abs(F.col("day_diff")).cast("int").alias("_absd"), rel.alias("_rel")))
    return *_priority(base), many


def _all_matches(late: DataFrame, r_left: DataFrame, t_left: DataFrame, early: list[DataFrame]) -> DataFrame:
    """``late`` matches, counted on from the rows that ``early`` rounds took, and those."""
    for side, left in (("r", r_left), ("t", t_left)):
        late = (late.join(left.select(F.col("cid").alias(f"{side}id"), "used"), f"{side}id")
                .withColumn(f"{side}_from", F.col(f"{side}_from") + F.col("used")).drop("used"))
    for m in early:
        late = late.unionByName(m)
    return late


def _match_points(r_cls: DataFrame, t_cls: DataFrame,
                  grid: Sequence[GridPoint]) -> tuple[dict, GridPoint | None, DataFrame | None, int]:
    """Rounds over class pairs, for classes that ``match_regions`` does not take: matched rows and least score per point,
    the first point with the most, its matches, rounds."""
    n_max = max(p.max_days for p in grid)
    a_max = max(p.max_amount for p in grid)
    per_point: dict[int, tuple[int, int | None]] = {}
    best_count, best_point, best_matches, rounds = 0, None, None, 0
    limit = PAIRS_PER_CLASS * min(len(grid), PAIR_POINTS) * (r_cls.count() + t_cls.count())
    dense = _compared(r_cls, t_cls, n_max, a_max, _CLASS, _CLASS) > limit
    # Points are matched together, on all pairs; where these are too many, one by one, on few pairs.
    step = 1 if dense else MASK_POINTS
    for i in range(0, len(grid), step):
        points = sorted(grid[i:i + step], key=lambda p: (p.max_days, p.grid_id))
        early: list[DataFrame] = []
        r_left, t_left = r_cls, t_cls
        if dense:
            r_left, t_left, early = _nearest_rounds(r_cls, t_cls, points[0], limit)
        if dense or i == 0:
            days = points[0].max_days if dense else n_max
            base, prio, many = _class_pairs(r_left, t_left, days, points[0].max_amount if dense else a_max)
        matched, n_rounds = _match_classes(base, points, prio, many)
        counted = matched.select("pos", "take", "score")
        for m in early:
            counted = counted.unionByName(m.select(F.lit(0).alias("pos"), "take", "score"))
        rounds = max(rounds, n_rounds + len(early))
        # One row per grid point: bounded by the grid size.
        for row in counted.groupBy("pos").agg(F.sum("take").alias("n"), F.min("score").alias("min_score")).collect():
            per_point[points[row["pos"]].grid_id] = (row["n"], row["min_score"])
        for p in grid[i:i + step]:
            n, _ = per_point.get(p.grid_id, (0, None))
            if n > best_count:
                best_count, best_point = n, p
                best_matches = (matched.filter(F.col("pos") == points.index(p)).drop("pos")
                                .join(base.select("rid", "tid", "amount_diff", "day_diff"), ["rid", "tid"]))
                if early:
                    best_matches = _all_matches(best_matches, r_left, t_left, early)
    return per_point, best_point, best_matches, rounds


def grid_reconcile(records: DataFrame, txns: DataFrame, grid: Sequence[GridPoint],
                   r: Side = LEDGER_SIDE, t: Side = LEDGER_SIDE,
                   eligible: Column | None = None) -> Reconciliation:
    """Match records to transactions at every grid point; keep the point with
    the most matches (the first one in grid order on ties; none if no point
    matches anything).  Grid points are independent of each other.

    ``eligible`` restricts which records take part (the others stay unmatched).
    Grids of more than 63 points are matched in parts of 63, one mask each.
    """
    if not grid:
        raise ValueError("empty grid")
    recs = records.filter(eligible) if eligible is not None else records
    spark = records.sparkSession
    r_cls, t_cls = cut_lineage(_classes(recs, r)), cut_lineage(_classes(txns, t))
    found = match_regions(r_cls, t_cls, grid)
    if found is None:
        per_point, best_point, best_matches, rounds = _match_points(r_cls, t_cls, grid)
    else:
        per_point, rounds = {grid[i].grid_id: x for i, x in found.counts.items()}, found.passes
        best_point, best_matches = None, None
        if found.counts:
            won = min(found.counts, key=lambda i: (-found.counts[i][0], i))
            best_point, pairs = grid[won], found.pairs
            if pairs is None:  # they were counted only
                again = match_regions(r_cls, t_cls, [best_point], keep=True)
                best_matches = _match_points(r_cls, t_cls, [best_point])[2] if again is None else again.pairs.drop("pos")
            else:
                best_matches = pairs.filter(F.col("pos") == won).drop("pos")
    chosen = best_point.grid_id if best_point is not None else -1
    rows = [(p.grid_id, p.max_days, p.max_amount, p.balance) + per_point.get(p.grid_id, (0, None))
            + (p.grid_id == chosen,) for p in grid]
    pts = spark.createDataFrame(rows, "grid_id int, max_days int, max_amount int, balance int, "
                                      "matched long, min_score int, chosen boolean")
    n_rec = recs.select(F.count(F.lit(1))).scalar()     # scalar subqueries
    n_txn = txns.select(F.count(F.lit(1))).scalar()
    report = pts.select(
        "grid_id", "max_days", "max_amount", "balance", "matched", "min_score",
        (n_rec - F.col("matched")).alias("unmatched"),
        (n_txn - F.col("matched")).alias("unclaimed"), "chosen")
    r_rows, t_rows = _members(recs, r_cls, r, "rid"), _members(txns, t_cls, t, "tid")
    if best_matches is None:
        none = r_cls.limit(0).select(F.col("cid").alias("rid"), F.col("amount").alias("r_amount"), F.col("date").alias("r_date")).crossJoin(
            t_cls.limit(0).select(F.col("cid").alias("tid"), F.col("amount").alias("t_amount"), F.col("date").alias("t_date")))
        empty = none.select("rid", "tid", F.lit(0).alias("score"), (F.col("r_amount") - F.col("t_amount")).alias("amount_diff"),
                            F.datediff(F.col("t_date"), F.col("r_date")).alias("day_diff"))
        return Reconciliation(empty, report, None, rounds)
    # k-th row to k-th row of every matched class pair.
    at = (best_matches
          .select(F.col("rid").alias("r_cid"), F.col("tid").alias("t_cid"), "score", "amount_diff", "day_diff",
                  "r_from", "t_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("take") - 1)).alias("i")))
    at = (at.withColumn("r_k", F.col("r_from") + F.col("i")).withColumn("t_k", F.col("t_from") + F.col("i"))
          .join(r_rows.select(F.col("cid").alias("r_cid"), F.col("k").alias("r_k"), "rid"), ["r_cid", "r_k"])
          .join(t_rows.select(F.col("cid").alias("t_cid"), F.col("k").alias("t_k"), "tid"), ["t_cid", "t_k"]))
    matches = cut_lineage(at.select("rid", "tid", "score", "amount_diff", "day_diff"))
    return Reconciliation(matches, report, best_point, rounds)


def reconcile(records: DataFrame, txns: DataFrame, max_days: int, max_amount: int,
              balance: int = DEFAULT_BALANCE, r: Side = LEDGER_SIDE, t: Side = LEDGER_SIDE,
              eligible: Column | None = None) -> Reconciliation:
    """Single-point reconciliation."""
    return grid_reconcile(records, txns, [GridPoint(0, max_days, max_amount, balance)],
                          r, t, eligible)


def diff_tags(amount_tag: str | None = "T", days_tag: str | None = "D") -> Column:
    """Tags describing how a match differs: ``T``, ``T_<record - txn>`` when the
    amounts differ, ``D``, ``D_<txn - record days>`` when the dates differ."""
    parts = []
    if amount_tag:
        a = F.col("amount_diff") != 0
        parts += [F.when(a, F.lit(amount_tag)),
                  F.when(a, F.concat(F.lit(amount_tag + "_"), plain_decimal(F.col("amount_diff"))))]
    if days_tag:
        dd = F.col("day_diff") != 0
        parts += [F.when(dd, F.lit(days_tag)),
                  F.when(dd, F.concat(F.lit(days_tag + "_"), F.col("day_diff").cast("string")))]
    if not parts:
        return F.array().cast("array<string>")
    return F.array_sort(F.array_compact(F.array(*parts)))


def merge_matches(ledger: DataFrame, matches: DataFrame, txns: DataFrame,
                  description: Column | str | None, txn_tags: Column | None = None,
                  extra_tags: Sequence[str] = (), amount_tag: str | None = None,
                  days_tag: str | None = None, t: Side = LEDGER_SIDE,
                  r_key: str = "_seq") -> DataFrame:
    """Matched ledger rows take the transaction's description; their tags
    become the union of their own, the transaction's, the fixed ones and the
    difference tags.  Unmatched rows are unchanged."""
    tcols = [F.col(t.key).alias("_tk")]
    if description is not None:
        dcol = F.col(description) if isinstance(description, str) else description
        tcols.append(dcol.alias("_tdesc"))
    tcols.append((txn_tags if txn_tags is not None else F.array().cast("array<string>")).alias("_ttags"))
    tside = txns.select(*tcols)
    m = (matches.select(F.col("rid").alias(r_key + "__m"), F.col("tid").alias("_tk"),
                        "amount_diff", "day_diff")
                .withColumn("_dtags", diff_tags(amount_tag, days_tag))
                .join(tside, "_tk", "inner"))
    j = ledger.join(m, ledger[r_key] == m[r_key + "__m"], "left")
    matched = F.col("_tk").isNotNull()
    new_tags = F.array_sort(F.array_distinct(F.concat(
        F.coalesce(F.col("tags"), F.array().cast("array<string>")),
        F.coalesce(F.col("_ttags"), F.array().cast("array<string>")),
        F.array(*[F.lit(x) for x in extra_tags]).cast("array<string>"),
        F.col("_dtags"))))
    out = []
    for c in ledger.columns:
        if c == "description" and description is not None:
            out.append(F.when(matched, F.col("_tdesc")).otherwise(F.col(c)).alias(c))
        elif c == "tags":
            out.append(F.when(matched, new_tags).otherwise(F.col(c)).alias(c))
        else:
            out.append(ledger[c])
    return j.select(*out)


def unclaimed(txns: DataFrame, matches: DataFrame, t: Side = LEDGER_SIDE) -> DataFrame:
    """Transactions no record claimed."""
    return txns.join(matches.select(F.col("tid").alias(t.key)), t.key, "left_anti")
