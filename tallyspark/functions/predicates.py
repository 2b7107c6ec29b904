"""Two-valued predicates over ledger rows.

A null field never matches, so ``not_`` of a predicate on a null field is
true (the ``coalesce`` sits inside the negation).
"""

from __future__ import annotations

import datetime as _dt
import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions.scalars import check_tag_literal, parse_period_date

# Fields a regex predicate can look at.
FIELDS = {
    "description": "description",
    "category": "category",
    "currency": "currency",
    "statement_id": "source_id",
}


def matches(column, regex: str) -> Column:
    """Regex *find* (not full match) on a string column; null is false."""
    col = F.col(column) if isinstance(column, str) else column
    return F.coalesce(col.rlike(regex), F.lit(False))


def description(regex: str) -> Column:
    return matches(FIELDS["description"], regex)


def category(regex: str) -> Column:
    return matches(FIELDS["category"], regex)


def currency(regex: str) -> Column:
    return matches(FIELDS["currency"], regex)


def statement_id(regex: str) -> Column:
    return matches(FIELDS["statement_id"], regex)


def has_tag(tag: str) -> Column:
    check_tag_literal(tag)
    return F.coalesce(F.array_contains(F.col("tags"), F.lit(tag)), F.lit(False))


def _as_date(v) -> _dt.date:
    if isinstance(v, _dt.datetime):
        return v.date()
    if isinstance(v, _dt.date):
        return v
    return parse_period_date(v)


def in_period(begin, end, inclusive: bool = False,
              column: str = "transaction_date") -> Column:
    """Date between two bounds; open ends by default.  Bounds are dates or
    ``dd/MM/yy`` text."""
    b, e = _as_date(begin), _as_date(end)
    if b > e:
        raise ValueError(f"period begin {b} is after its end {e}")
    d = F.col(column)
    if inclusive:
        cond = d.between(F.lit(b), F.lit(e))
    else:
        cond = (d > F.lit(b)) & (d < F.lit(e))
    return F.coalesce(cond, F.lit(False))


def all_of(*preds: Column) -> Column:
    if not preds:
        return F.lit(True)
    return functools.reduce(operator.and_, preds)


def any_of(*preds: Column) -> Column:
    if not preds:
        return F.lit(True)
    return functools.reduce(operator.or_, preds)


def not_(pred: Column) -> Column:
    return ~pred


def guard(preds) -> Column:
    """Guard of a rule or operator: its predicates OR-ed, empty means true."""
    if preds is None:
        return F.lit(True)
    if isinstance(preds, Column):
        return preds
    preds = list(preds)
    return any_of(*preds) if preds else F.lit(True)


def is_negative(column: str = "amount") -> Column:
    return F.col(column) < 0
