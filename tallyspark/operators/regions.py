"""Greedy one-to-one matching of classes, region by region.

A region is a currency, a block of days and, where these hold many rows, a block
of amounts; each row of a pass lies in one region, so a pass shuffles a row once,
whatever the tolerances.  Inside a region, in numpy, pairs that are each other's best
are taken in rounds, by lookups of the nearest open amounts per day gap.  A
row's best pair is known for sure if it scores more than any row outside of the
region could: what is taken is what the greedy matching takes.  Rows that
wait for something outside are left for the next pass, whose blocks have other
borders; few rows a point make one region without borders, which leaves none.
"""

from __future__ import annotations

import dataclasses
import sys
from collections.abc import Sequence
from decimal import ROUND_FLOOR, ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyspark.session import cut_lineage, release

# What runs in tasks goes there with them; the package need not be installed on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows that a region has about, those it may have, and those of a point that make one region.
REGION_ROWS, MOST_ROWS, LAST_ROWS = 200_000, 2_000_000, 1 << 17

#: Amounts (in their last decimal) and day gaps that the lookups are exact for; passes before the rounds of ``matching`` take over.
MOST_UNITS, MOST_DAYS, PASSES = 1 << 46, 128, 12

#: Points up to which taken pairs are kept for all of them; with more, the winner's are found again.
KEPT_POINTS = 4

_SHIFT = 49  # of the score in a packed priority; below are the amounts' difference and two signs


def _floored(x: np.ndarray) -> np.ndarray:
    """``matching._floored`` for an array."""
    moved = x + 5e-7
    out = np.floor(moved).astype(np.int64)
    for i in np.flatnonzero(np.abs(moved - np.rint(moved)) < 1e-9):
        digits = Decimal(repr(float(x[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP)
        out[i] = int(digits.to_integral_value(ROUND_FLOOR))
    return out


@dataclasses.dataclass(frozen=True)
class _Scores:
    """Score and tolerance of a point, for amounts in units of ``10 ** -scale``."""
    days: int
    amount: int
    balance: int
    scale: int

    def rel(self, r: np.ndarray, t: np.ndarray) -> np.ndarray:
        big, unit = np.maximum(np.abs(r), np.abs(t)), float(10 ** self.scale)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(big == 0, 0.0, (np.abs(r - t) / unit) / (big / unit))

    def score(self, r: np.ndarray, t: np.ndarray, gap: int) -> np.ndarray:
        b = self.balance / 1000
        return _floored(1000.0 * (b * (1.0 - self.rel(r, t)) + (1.0 - b) * (1.0 - float(gap) / float(self.days + 1))))

    def within(self, r: np.ndarray, t: np.ndarray) -> np.ndarray:
        return np.abs(r - t) * 1000 <= self.amount * np.abs(r)

    def tops(self) -> list[int]:
        """The most that a pair can score, per day gap."""
        zero = np.zeros(1, np.int64)
        return [int(self.score(zero, zero, k)[0]) for k in range(self.days + 1)]


class _Rows:
    """Open rows of a side in a region, by day and amount."""

    def __init__(self, at: np.ndarray, day: np.ndarray, amount: np.ndarray, left: np.ndarray, used: np.ndarray,
                 values: np.ndarray, day0: int):
        rank = np.searchsorted(values, amount)
        key = (day.astype(np.int64) - day0) * (len(values) + 1) + rank
        order = np.argsort(key, kind="stable")
        self.at, self.day, self.amount, self.rank, self.key = at[order], day[order], amount[order], rank[order], key[order]
        self.left0, self.used0 = left[order], used[order]

    def begin(self, outside: np.ndarray) -> None:
        n = len(self.at)
        self.left, self.used, self.outside = self.left0.copy(), self.used0.copy(), outside
        self.score, self.best, self.sure = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.zeros(n, bool)
        self.opened()

    def opened(self) -> None:
        self.open = np.flatnonzero(self.left > 0)
        self.open_key = self.key[self.open]

    def look(self, idx: np.ndarray, other: _Rows, sign: int, width: int, p: _Scores, tops: Sequence[int]) -> None:
        """Best open partners of the rows ``idx``; ``sign``: 1 for records, -1 for transactions."""
        score, best = np.zeros(len(idx), np.int64), np.full(len(idx), -1, np.int64)
        keys, m = other.open_key, len(other.open_key)
        for k in range(p.days + 1) if m else ():
            act = np.flatnonzero(score < tops[k])
            if not len(act):
                break
            i = idx[act]
            prio, found = np.full(len(act), np.iinfo(np.int64).max), np.full(len(act), -1, np.int64)
            for gap in (k, -k) if k else (0,):
                target = self.key[i] + sign * gap * width
                pos, first = np.searchsorted(keys, target), target - self.rank[i]
                above = (pos < m) & (keys[np.minimum(pos, m - 1)] < first + width)
                below = (pos > 0) & (keys[np.maximum(pos - 1, 0)] >= first)
                for there, step in ((above, 0), (below, 1)):
                    j = np.flatnonzero(there)
                    o = other.open[pos[j] - step]
                    mine, its = self.amount[i[j]], other.amount[o]
                    r, t = (mine, its) if sign > 0 else (its, mine)
                    ok = p.within(r, t)
                    j, o, r, t = j[ok], o[ok], r[ok], t[ok]
                    new = (((1000 - p.score(r, t, k)) << _SHIFT) | (np.abs(r - t) << 2)
                           | (2 * int(gap < 0) + (r < t).astype(np.int64)))
                    more = new < prio[j]
                    prio[j[more]], found[j[more]] = new[more], o[more]
            got = np.where(found >= 0, 1000 - (prio >> _SHIFT), 0)
            more = got > score[act]
            score[act[more]], best[act[more]] = got[more], found[more]
        self.score[idx], self.best[idx] = score, best
        self.sure[idx] = (score > self.outside[idx]) | (self.outside[idx] == 0)


def _outside(rows: _Rows, days: tuple, amounts: tuple, sign: int, p: _Scores, tops: Sequence[int]) -> np.ndarray:
    """The most that a pair with a row outside of the region can score (0: there is none)."""
    out = np.zeros(len(rows.at), np.int64)
    top = np.array([*tops, 0])
    for edge, gap in ((days[0], 1), (days[1], -1)):
        if edge is not None:  # the nearest day that is not in the region
            away = (rows.day - (edge - 1)) if gap > 0 else (edge - rows.day)
            out = np.maximum(out, top[np.minimum(away, p.days + 1)])
    for edge in (None if amounts[0] is None else amounts[0] - 1, amounts[1]):
        if edge is not None:
            its = np.full(len(rows.at), edge, np.int64)
            r, t = (rows.amount, its) if sign > 0 else (its, rows.amount)
            out = np.maximum(out, np.where(p.within(r, t), p.score(r, t, 0), 0))
    return np.maximum(out, 0)


def _match(rs: _Rows, ts: _Rows, width: int, p: _Scores, days: tuple, amounts: tuple) -> list[tuple]:
    """Pairs that the greedy matching takes for sure: arrays of both rows, score, rows taken, and those taken before."""
    tops = p.tops()
    rs.begin(_outside(rs, days, amounts, 1, p, tops))
    ts.begin(_outside(ts, days, amounts, -1, p, tops))
    rs.look(rs.open, ts, 1, width, p, tops)
    ts.look(ts.open, rs, -1, width, p, tops)
    taken, fresh = [], rs.open
    while True:
        r = fresh[(rs.best[fresh] >= 0) & rs.sure[fresh]]
        t = rs.best[r]
        r = r[(ts.best[t] == r) & ts.sure[t]]
        if not len(r):
            return taken
        t = rs.best[r]
        n = np.minimum(rs.left[r], ts.left[t])
        taken.append((r, t, rs.score[r], n, rs.used[r], ts.used[t]))
        again = []
        for x, i in ((rs, r), (ts, t)):
            x.left[i] -= n
            x.used[i] += n
            x.opened()
        for x, y, sign in ((rs, ts, 1), (ts, rs, -1)):
            # Rows whose best is gone look again.
            lost = x.open[(x.best[x.open] >= 0) & (y.left[x.best[x.open]] == 0)]
            x.look(lost, y, sign, width, p, tops)
            again.append(lost)
        by_t = ts.best[again[1]]
        # A pair of two rows that have not looked again was no pair of best ones before.
        fresh = np.unique(np.concatenate([again[0], by_t[by_t >= 0]]))


def _solver(points: Sequence[_Scores], plan: dict, span: tuple, pairs: bool, schema: pa.Schema):
    """The function of a region: a table of its rows to one of taken pairs (or their sums) and of rows left."""
    width, shift, bounds = plan["width"], plan["shift"], plan["bounds"]

    def edges(db, ab):
        if db is None:
            return (None, None), (None, None)
        low, high = db * width + shift, (db + 1) * width + shift
        return ((None if low <= span[0] else low, None if high > span[1] else high),
                (bounds[ab - 1] if ab > 0 else None, bounds[ab] if ab < len(bounds) else None))

    def solve(keys: tuple, table: pa.Table) -> pa.Table:
        pos, currency, db, ab = (k.as_py() for k in keys)
        days, amounts = edges(db, ab)
        col = {c: table.column(c).to_numpy() for c in ("day", "amount", "left", "used")}
        is_r = table.column("rid").combine_chunks().is_valid().to_numpy(zero_copy_only=False)
        values = np.unique(col["amount"])
        day0 = int(col["day"].min())
        rs, ts = (_Rows(at, *(col[c][at] for c in ("day", "amount", "left", "used")), values, day0)
                  for at in (np.flatnonzero(is_r), np.flatnonzero(~is_r)))
        rid, tid = table.column("rid"), table.column("tid")
        out = []

        def add(n, **more):
            made = {"currency": pa.array([currency] * n, schema.field("currency").type) if n else None, **more}
            out.append(pa.table([made[f.name] if made.get(f.name) is not None else pa.nulls(n, f.type) for f in schema],
                                schema=schema))

        for at in range(len(points)) if pos < 0 else (pos,):
            taken = _match(rs, ts, len(values) + 1, points[at], days, amounts)
            if taken:
                r, t, score, n, r_from, t_from = (np.concatenate(x) for x in zip(*taken, strict=True))
                if pairs:
                    add(len(r), pos=pa.array(np.full(len(r), at, np.int32)), rid=rid.take(rs.at[r]).combine_chunks(),
                        tid=tid.take(ts.at[t]).combine_chunks(), score=pa.array(score.astype(np.int32)), take=pa.array(n),
                        r_from=pa.array(r_from), t_from=pa.array(t_from), amount=pa.array(rs.amount[r] - ts.amount[t]),
                        day=pa.array((ts.day[t] - rs.day[r]).astype(np.int32)))
                else:
                    add(1, pos=pa.array([at], pa.int32()), score=pa.array([score.min()], pa.int32()), take=pa.array([n.sum()], pa.int64()))
            for x, name, keys_of in ((rs, "rid", rid), (ts, "tid", tid)):
                i = x.open[(x.best[x.open] >= 0) | (x.outside[x.open] > 0)]
                add(len(i), pos=pa.array(np.full(len(i), at, np.int32)), take=pa.array(x.left[i]), amount=pa.array(x.amount[i]),
                    r_from=pa.array(x.used[i]), day=pa.array(x.day[i].astype(np.int32)), **{name: keys_of.take(x.at[i]).combine_chunks()})
        return pa.concat_tables(out)

    return solve


def _block(x: Column, bounds: Sequence[int]) -> Column:
    """How many ascending bounds a value reaches, by halving."""
    def within(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x < F.lit(bounds[mid]).cast("long"), within(lo, mid)).otherwise(within(mid + 1, hi))
    return within(0, len(bounds))


def _plan(state: DataFrame, rows: int, span: tuple, most_days: int, at: int, parts: int) -> dict | None:
    """Blocks of the pass ``at`` for at least ``parts`` regions: days a block, where they begin, bounds of amounts."""
    days = span[1] - span[0] + 1
    want = max(-(-rows // REGION_ROWS), parts)
    width = max(8 * (most_days + 1), -(-days // want))
    blocks = -(-days // width)
    shift = span[0] + (0, width // 2, width // 4, width * 3 // 4)[at % 4] - width
    for _ in range(4):
        cuts = -(-want // blocks)
        bounds = []
        if cuts > 1:
            parts_at = [(i + (0.5 if at % 2 else 0)) / cuts for i in range(1 - at % 2, cuts)]
            found = state.agg(F.percentile_approx("amount", parts_at, 10_000)).first()[0]
            bounds = sorted({int(x) for x in found or []})
        plan = {"width": width, "shift": shift, "bounds": bounds}
        most = _placed(state, plan).groupBy("pos", "currency", "_db", "_ab").count().agg(F.max("count")).first()[0]
        if (most or 0) <= MOST_ROWS:
            return plan | {"regions": (blocks + 1) * (len(bounds) + 1)}
        want *= 4
    return None  # too many rows of few days have nearly equal amounts


def _placed(state: DataFrame, plan: dict | None) -> DataFrame:
    if plan is None:
        return state.withColumns({"_db": F.lit(None).cast("long"), "_ab": F.lit(None).cast("int")})
    return state.withColumns({"_db": F.floor((F.col("day") - plan["shift"]) / plan["width"]).cast("long"),
                              "_ab": _block(F.col("amount"), plan["bounds"])})


def _frontier(own: tuple, other: tuple, sign: int, width: int, days: int, amount: int, scale: int) -> list[tuple]:
    """(own row, other row) where no pair of the own row at fewer days has amounts as near: arrays of both."""
    (key, rank, units), (keys, at, its_units) = own, other
    p, m, out = _Scores(days, amount, 0, scale), len(keys), []
    least = np.full(len(key), np.inf)
    for k in range(days + 1) if m else ():
        act = np.flatnonzero(least > 0)
        was = least[act]
        now = was.copy()
        for gap in (k, -k) if k else (0,):
            target = key[act] + sign * gap * width
            pos, first = np.searchsorted(keys, target), target - rank[act]
            above = (pos < m) & (keys[np.minimum(pos, m - 1)] < first + width)
            below = (pos > 0) & (keys[np.maximum(pos - 1, 0)] >= first)
            for there, step in ((above, 0), (below, 1)):
                j = np.flatnonzero(there)
                o = pos[j] - step
                mine, its = units[act[j]], its_units[o]
                r, t = (mine, its) if sign > 0 else (its, mine)
                rel = p.rel(r, t)
                ok = p.within(r, t) & (rel < was[j])
                out.append((act[j[ok]], at[o[ok]]))
                now[j[ok]] = np.minimum(now[j[ok]], rel[ok])
        least[act] = now
    return out


def _finder(days: int, amount: int, scale: int, schema: pa.Schema):
    """The function of a block: a table of both sides' rows to one of pairs."""
    def find(keys: tuple, table: pa.Table) -> pa.Table:
        is_r = table.column("is_r").to_numpy()
        day, units = table.column("day").to_numpy().astype(np.int64), table.column("units").to_numpy()
        values = np.unique(units)
        width, rank = len(values) + 1, np.searchsorted(values, units)
        key = (day - day.min()) * width + rank
        side = {}
        for name, i, seq in (("rid", np.flatnonzero(is_r), "r_seq"), ("tid", np.flatnonzero(~is_r), "t_seq")):
            sub = pa.table({"k": key[i], "s": table.column(seq).take(i), "i": table.column(name).take(i)})
            i = i[pc.sort_indices(sub, [("k", "ascending"), ("s", "ascending"), ("i", "ascending")], null_placement="at_start").to_numpy()]
            first = i[np.concatenate([[True], key[i][1:] != key[i][:-1]])] if len(i) else i
            side[name] = (i, (key[i], rank[i], units[i])), (key[first], first, units[first])
        out = []
        for mine, its, sign in (("rid", "tid", 1), ("tid", "rid", -1)):
            i, own = side[mine][0]
            for a, b in _frontier(own, side[its][1], sign, width, days, amount, scale):
                r, t = (i[a], b) if sign > 0 else (b, i[a])
                made = {"rid": table.column("rid").take(r), "tid": table.column("tid").take(t), "r_seq": table.column("r_seq").take(r),
                        "t_seq": table.column("t_seq").take(t), "r_units": units[r], "t_units": units[t], "r_day": day[r].astype(np.int32),
                        "t_day": day[t].astype(np.int32), "of_r": np.full(len(r), sign > 0),
                        "currency": pa.array([keys[0].as_py()] * len(r), schema.field("currency").type)}
                out.append(pa.table([made[f.name] for f in schema], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return find


def nearest_in_blocks(rr: DataFrame, tt: DataFrame, days: int, amount: int, by_amount) -> DataFrame | None:
    """Pairs of each row that can be its best, found in blocks of days: ``currency, r_date, t_date, _of_r`` and both sides' columns.

    A transaction lies in one block, a record in all that its days touch, so that a row is shuffled about once,
    however many days the tolerance has.  Where blocks hold many rows, ``by_amount(rr, tt)`` parts them by amounts.
    ``None`` where blocks do not fit the rows (see ``match_regions``).
    """
    if days > MOST_DAYS or MOST_ROWS <= 0:
        return None
    spark, scale, rows, low, high = rr.sparkSession, 0, 0, None, None
    types = {f.name: f.dataType for f in (*rr.schema, *tt.schema)}
    scale = max(types["r_amount"].scale, types["t_amount"].scale)
    for df, side in ((rr, "r"), (tt, "t")):
        s = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(f"{side}_amount")).alias("most"), F.min(F.unix_date(f"{side}_date")).alias("low"),
                   F.max(F.unix_date(f"{side}_date")).alias("high")).first()
        if (s["most"] or 0) * 10 ** scale >= MOST_UNITS:
            return None
        if s["n"]:
            rows, low, high = rows + s["n"], min(s["low"], low or s["low"]), max(s["high"], high or s["high"])
    span = high - low + 1 if rows else 1
    width = max(8 * (days + 1), -(-span // max(rows // REGION_ROWS, 4 * spark.sparkContext.defaultParallelism)))
    blocks, keys = -(-span // width) + 1, ["currency", "_db"]
    if rows > blocks * REGION_ROWS:
        rr, tt, more = by_amount(rr, tt)
        keys += more
    r_day = F.unix_date("r_date")
    rr = rr.withColumn("_db", F.explode(F.sequence(F.floor((r_day - days) / width), F.floor((r_day + days) / width))))
    tt = tt.withColumn("_db", F.floor(F.unix_date("t_date") / width))
    unit = F.lit(Decimal(10 ** scale))
    laid = [df.select(F.col(f"{x}_cur").alias("currency"), *keys[1:], F.lit(x == "r").alias("is_r"), f"{x}id", f"{x}_seq",
                      F.unix_date(f"{x}_date").alias("day"), (F.col(f"{x}_amount") * unit).cast("long").alias("units")) for df, x in ((rr, "r"), (tt, "t"))]
    both = laid[0].unionByName(laid[1], allowMissingColumns=True)
    if (both.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) > MOST_ROWS:
        return None
    made = T.StructType([T.StructField(n, t) for n, t in (
        ("currency", both.schema["currency"].dataType), *((n, types[n]) for n in ("rid", "tid", "r_seq", "t_seq")),
        ("r_units", T.LongType()), ("t_units", T.LongType()), ("r_day", T.IntegerType()), ("t_day", T.IntegerType()), ("of_r", T.BooleanType()))])
    spread = max(min(4 * blocks * (1 + 8 * (len(keys) > 2)), 2000), int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = both.repartition(spread, *keys).groupBy(*keys).applyInArrow(_finder(days, amount, scale, to_arrow_schema(made)), made)
    back = F.lit(Decimal(1).scaleb(-scale))
    return found.select("currency", "rid", "tid", "r_seq", "t_seq", F.col("of_r").alias("_of_r"),
                        *[(F.col(f"{x}_units").cast("decimal(20,0)") * back).cast(types[f"{x}_amount"]).alias(f"{x}_amount") for x in "rt"],
                        *[F.date_from_unix_date(f"{x}_day").alias(f"{x}_date") for x in "rt"])


@dataclasses.dataclass
class Found:
    """What the passes took: ``pos, rid, tid, score, take, r_from, t_from, amount_diff, day_diff`` (or ``None``), and sums per point."""
    pairs: DataFrame | None
    counts: dict[int, tuple[int, int | None]]
    passes: int


def match_regions(r_cls: DataFrame, t_cls: DataFrame, points: Sequence, keep: bool | None = None) -> Found | None:
    """Greedy matching of classes at every point; ``None`` where regions do not fit the rows.

    That is where an amount has too many digits, days are too far apart, keys are null or name
    several classes, or too many rows lie too close together for blocks.
    """
    if max(p.max_days for p in points) > MOST_DAYS or MOST_ROWS <= 0:
        return None
    keep = len(points) <= KEPT_POINTS if keep is None else keep
    spark = r_cls.sparkSession
    scale = max(c.schema["amount"].dataType.scale for c in (r_cls, t_cls))
    diff = r_cls.select(F.col("amount").alias("a")).crossJoin(t_cls.select(F.col("amount").alias("b"))).select(F.col("a") - F.col("b"))
    diff_type = diff.schema[0].dataType
    sides, rows, low, high, currencies = [], 0, None, None, 1
    for cls, own, other_cls, other in ((r_cls, "rid", t_cls, "tid"), (t_cls, "tid", r_cls, "rid")):
        whole = cls.filter(F.col("amount").isNotNull() & F.col("date").isNotNull())
        s = whole.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cid").alias("keys"), F.max(F.abs("amount")).alias("most"),
                      F.approx_count_distinct("currency").alias("currencies"),
                      F.min(F.unix_date("date")).alias("low"), F.max(F.unix_date("date")).alias("high")).first()
        if s["n"] != s["keys"] or (s["most"] or 0) * 10 ** scale >= MOST_UNITS:
            return None
        if s["n"] == 0:
            return Found(None, {}, 0)
        rows, currencies = rows + s["n"], max(currencies, s["currencies"])
        low, high = (s["low"], s["high"]) if low is None else (min(low, s["low"]), max(high, s["high"]))
        sides.append(whole.select(
            F.lit(-1 if len(points) > 1 else 0).alias("pos"), "currency", F.col("cid").alias(own),
            F.lit(None).cast(other_cls.schema["cid"].dataType).alias(other),
            F.unix_date("date").alias("day"), (F.col("amount") * F.lit(Decimal(10 ** scale))).cast("long").alias("amount"),
            F.col("n").alias("left"), F.lit(0).cast("long").alias("used")))
    state, span = sides[0].unionByName(sides[1]), (low, high)
    made = T.StructType([T.StructField(n, t) for n, t in (
        ("pos", T.IntegerType()), ("currency", state.schema["currency"].dataType), ("rid", state.schema["rid"].dataType),
        ("tid", state.schema["tid"].dataType), ("score", T.IntegerType()), ("take", T.LongType()), ("r_from", T.LongType()),
        ("t_from", T.LongType()), ("amount", T.LongType()), ("day", T.IntegerType()))])
    arrow = to_arrow_schema(made)
    parts = max(4 * spark.sparkContext.defaultParallelism // currencies, 1)
    outs, counts, most, total = [], {}, rows, rows
    most_days, bound = max(p.max_days for p in points), LAST_ROWS
    for at in range(PASSES):
        last = most <= bound
        plan = None if last else _plan(state, total, span, most_days, at, parts)
        if not last and plan is None:
            break
        if last and len(points) > 1 and at == 0:  # one region a point
            state = state.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(len(points) - 1))))
        solve = _solver([_Scores(p.max_days, p.max_amount, p.balance, scale) for p in points], plan or {"width": 1, "shift": 0, "bounds": []}, span, keep, arrow)
        keys = ["pos", "currency", "_db", "_ab"]
        spread = 4 * len(points) if last else min(4 * plan["regions"], 2000)
        out = cut_lineage(_placed(state, plan).repartition(spread, *keys).groupBy(*keys).applyInArrow(solve, made))
        outs.append(out)
        both, neither = "rid is not null and tid is not null", "rid is null and tid is null"
        sums = out.groupBy("pos").agg(F.sum(F.expr(f"case when ({both}) or ({neither}) then take end")).alias("n"),
                                      F.min("score").alias("score"),
                                      F.sum(F.expr(f"case when ({both}) or ({neither}) then 0 else 1 end")).alias("open"))
        before, most, total = total, 0, 0
        for row in sums.collect():  # one row a point
            if row["n"]:
                n, score = counts.get(row["pos"], (0, None))
                counts[row["pos"]] = (n + row["n"], row["score"] if score is None else min(score, row["score"]))
            most, total = max(most, row["open"]), total + row["open"]
        if total == 0:
            break
        if at and total > before // 2:  # blocks are small for the tolerances: fewer and larger ones
            parts, bound = -(-parts // 4), min(4 * bound, MOST_ROWS)
        state = out.filter("(rid is null) <> (tid is null)").select("pos", "currency", "rid", "tid", "day", "amount",
                                                                    F.col("take").alias("left"), F.col("r_from").alias("used"))
    if total:
        release(*outs)
        return None
    if not keep:
        release(*outs)
        return Found(None, counts, len(outs))
    found = None
    for out in outs:
        x = out.filter(both).select("pos", "rid", "tid", "score", "take", "r_from", "t_from",
                                    (F.col("amount").cast("decimal(20,0)") * F.lit(Decimal(1).scaleb(-scale))).cast(diff_type).alias("amount_diff"),
                                    F.col("day").alias("day_diff"))
        found = x if found is None else found.unionByName(x)
    return Found(found, counts, len(outs))
