"""Ordered rule passes ("first matching rule wins") and pass pipelines.

A pass is evaluated as two projections and no shuffle: the first computes the
number of the first rule whose guard holds on the row as it entered the pass
(``_rule``), the second rewrites every touched field with one ``CASE`` on that
number.  Discards only set the ``_discarded`` flag; the pipeline carries the
flag through later passes (which leave such rows alone), so kept and discarded
rows come out of one plan without unions or recomputation.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.predicates import guard as _guard
from tallyspark.functions.scalars import check_tag_literal, record_label

RULE_COL = "_rule"
PASS_COL = "_pass"
DISCARD_COL = "_discarded"
AUDIT_COLS = (RULE_COL, PASS_COL, DISCARD_COL)


# --------------------------------------------------------------------------
# Actions
# --------------------------------------------------------------------------

@dataclasses.dataclass(frozen=True)
class Action:
    kind: str                 # category | description | tag | negate | discard | set
    value: Any = None
    field: str | None = None  # for kind == "set"


def set_category(value: str) -> Action:
    return Action("category", value)


def set_description(value: str) -> Action:
    return Action("description", value)


def add_tag(tag: str) -> Action:
    return Action("tag", check_tag_literal(tag))


def negate() -> Action:
    return Action("negate")


def discard() -> Action:
    return Action("discard")


def set_field(field: str, value: Column) -> Action:
    """Set a field from any expression of the row as it entered the pass."""
    return Action("set", value, field)


@dataclasses.dataclass
class Rule:
    actions: Sequence[Action] = ()
    when: Any = None          # Column, list of Columns (OR-ed), name, or None = always
    name: str | None = None


def rule(*actions: Action, when=None, name: str | None = None) -> Rule:
    return Rule(tuple(actions), when, name)


def _resolve(pred, named: dict[str, Column] | None) -> Column:
    if isinstance(pred, str):
        if not named or pred not in named:
            raise KeyError(f"unknown named predicate {pred!r}")
        return named[pred]
    if isinstance(pred, (list, tuple)):
        return _guard([_resolve(p, named) for p in pred])
    return _guard(pred)


def _rule_effects(actions: Sequence[Action]) -> tuple[dict[str, Column], bool]:
    """Fold one rule's actions in order; stop at a discard."""
    state: dict[str, Column] = {}

    def cur(name: str) -> Column:
        return state.get(name, F.col(name))

    discards = False
    for a in actions:
        if a.kind == "discard":
            discards = True
            break
        if a.kind in ("category", "description"):
            state[a.kind] = F.lit(a.value)
        elif a.kind == "tag":
            state["tags"] = F.array_sort(F.array_union(
                F.coalesce(cur("tags"), F.array().cast("array<string>")),
                F.array(F.lit(a.value))))
        elif a.kind == "negate":
            state["amount"] = -cur("amount")
        elif a.kind == "set":
            state[a.field] = a.value
        else:
            raise ValueError(f"unknown action {a.kind!r}")
    return state, discards


def apply_pass(df: DataFrame, rules: Sequence[Rule], pass_id: str | None = None,
               named: dict[str, Column] | None = None) -> DataFrame:
    """Apply one pass; returns all rows with ``_rule``, ``_pass`` and ``_discarded``.

    Rows already flagged ``_discarded`` (by an earlier pass) are left alone.
    """
    if DISCARD_COL not in df.columns:
        df = df.withColumn(DISCARD_COL, F.lit(False))
    live = ~F.col(DISCARD_COL)
    guards = [_resolve(r.when, named) for r in rules]
    if rules:
        rule_no = F.coalesce(*[F.when(live & g, F.lit(i)) for i, g in enumerate(guards)],
                             F.lit(None).cast("int"))
    else:
        rule_no = F.lit(None).cast("int")
    staged = df.withColumn(RULE_COL, rule_no)

    effects = [_rule_effects(r.actions) for r in rules]
    touched: list[str] = []
    for state, _ in effects:
        for name in state:
            if name not in touched:
                touched.append(name)

    out = []
    for name in staged.columns:
        if name in touched:
            expr = None
            for i, (state, _) in enumerate(effects):
                if name in state:
                    branch = F.col(RULE_COL) == i
                    expr = F.when(branch, state[name]) if expr is None else expr.when(branch, state[name])
            out.append(expr.otherwise(F.col(name)).alias(name))
        elif name == DISCARD_COL:
            discard_rules = [i for i, (_, d) in enumerate(effects) if d]
            flag = F.col(DISCARD_COL)
            if discard_rules:
                flag = flag | F.coalesce(F.col(RULE_COL).isin(*discard_rules), F.lit(False))
            out.append(flag.alias(DISCARD_COL))
        else:
            out.append(F.col(name))
    missing = [n for n in touched if n not in staged.columns]
    if missing:
        raise ValueError(f"actions set unknown columns {missing}")
    result = staged.select(*out)
    return result.withColumn(PASS_COL, F.lit(pass_id))


@dataclasses.dataclass
class RuleResult:
    """Kept and discarded rows of one plan (persist ``annotated`` if both are used)."""

    annotated: DataFrame
    side_outputs: dict[str, DataFrame] = dataclasses.field(default_factory=dict)

    @property
    def kept(self) -> DataFrame:
        return self.annotated.filter(~F.col(DISCARD_COL)).drop(*AUDIT_COLS)

    @property
    def discarded(self) -> DataFrame:
        return self.annotated.filter(F.col(DISCARD_COL)).drop(*AUDIT_COLS)


# --------------------------------------------------------------------------
# Passes and pipelines
# --------------------------------------------------------------------------

@dataclasses.dataclass
class RulePass:
    id: str
    rules: Sequence[Rule]


@dataclasses.dataclass
class OperatorPass:
    """Relation-level pass (dedupe, offset pairing, reconciliation, plug-ins).

    ``fn`` maps the live rows to new rows; it may return ``(df, side_outputs)``.
    ``mode="filter"`` drops rows failing ``guard`` (they appear in no output);
    ``mode="route"`` lets them pass through unchanged.
    """

    id: str
    fn: Callable[[DataFrame], Any]
    guard: Any = None
    mode: str = "filter"


class Pipeline:
    def __init__(self, passes: Sequence[RulePass | OperatorPass],
                 named: dict[str, Column] | None = None):
        self.passes = list(passes)
        self.named = dict(named or {})

    def ids(self) -> list[str]:
        return [p.id for p in self.passes]

    def select(self, ids: Sequence[str] | None):
        if ids is None:
            return list(self.passes)
        by_id = {p.id: p for p in self.passes}
        unknown = sorted(set(ids) - set(by_id))
        if unknown:
            raise ValueError(f"Invalid pass ids: {unknown}. Valid ids: {sorted(by_id)}")
        return [by_id[i] for i in ids]

    def run(self, df: DataFrame, ids: Sequence[str] | None = None) -> RuleResult:
        cur = df
        if DISCARD_COL not in cur.columns:
            cur = cur.withColumn(DISCARD_COL, F.lit(False))
        if RULE_COL not in cur.columns:
            cur = cur.withColumn(RULE_COL, F.lit(None).cast("int"))
        if PASS_COL not in cur.columns:
            cur = cur.withColumn(PASS_COL, F.lit(None).cast("string"))
        sides: dict[str, DataFrame] = {}
        for p in self.select(ids):
            if isinstance(p, RulePass):
                cur = apply_pass(cur, p.rules, p.id, self.named)
            else:
                cur, extra = _run_operator(cur, p, self.named)
                sides.update({f"{p.id}.{k}": v for k, v in extra.items()})
        return RuleResult(cur, sides)


def _run_operator(cur: DataFrame, p: OperatorPass, named) -> tuple[DataFrame, dict]:
    cols = [c for c in cur.columns if c not in AUDIT_COLS]
    live = cur.filter(~F.col(DISCARD_COL)).select(*cols)
    dead = cur.filter(F.col(DISCARD_COL))
    g = _resolve(p.guard, named)
    selected = live.filter(g)
    res = p.fn(selected)
    extra = {}
    if isinstance(res, tuple):
        res, extra = res
    res = res.select(*cols)
    if p.mode == "route":
        res = res.unionByName(live.filter(~g))
    elif p.mode != "filter":
        raise ValueError(p.mode)
    res = (res.withColumn(RULE_COL, F.lit(None).cast("int"))
              .withColumn(PASS_COL, F.lit(p.id))
              .withColumn(DISCARD_COL, F.lit(False)))
    return res.unionByName(dead.select(*res.columns)), extra


# --------------------------------------------------------------------------
# Audit
# --------------------------------------------------------------------------

def rule_audit(df: DataFrame, rules: Sequence[Rule], pass_id: str | None = None,
               named: dict[str, Column] | None = None) -> DataFrame:
    """Which rule touched which row: before / after labels and added tags."""
    before = df.select(*[F.col(c) for c in df.columns],
                       F.struct(*[F.col(c) for c in df.columns if c not in AUDIT_COLS]).alias("_before"))
    after = apply_pass(before, rules, pass_id, named).filter(F.col(RULE_COL).isNotNull())
    names = [r.name for r in rules]
    name_col = F.element_at(F.array(*[F.lit(n) for n in names]), F.col(RULE_COL) + 1) if rules else F.lit(None)
    return after.select(
        F.col(PASS_COL).alias("pass_id"),
        F.col(RULE_COL).alias("rule"),
        name_col.cast("string").alias("rule_name"),
        F.col("_seq"),
        record_label("_before.").alias("before"),
        record_label().alias("after"),
        F.array_except(F.coalesce(F.col("tags"), F.array().cast("array<string>")),
                       F.coalesce(F.col("_before.tags"), F.array().cast("array<string>"))).alias("added_tags"),
        F.col(DISCARD_COL).alias("discarded"),
    )


def rule_counts(df: DataFrame, rules: Sequence[Rule], pass_id: str | None = None,
                named: dict[str, Column] | None = None) -> DataFrame:
    """Rows claimed per rule (``rule`` null = no rule matched)."""
    return (apply_pass(df, rules, pass_id, named)
            .groupBy(F.col(RULE_COL).alias("rule"))
            .agg(F.count(F.lit(1)).alias("n"),
                 F.sum(F.col(DISCARD_COL).cast("int")).cast("long").alias("discarded")))
