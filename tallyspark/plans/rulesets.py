"""Sample rule sets used by the registered queries, tests and the bench.

They exercise every predicate and action kind; the SQL oracles spell the same
rules out as ``CASE WHEN`` chains.
"""

from __future__ import annotations

from tallyspark.functions import predicates as P
from tallyspark.operators.rules import (OperatorPass, Pipeline, RulePass, add_tag, discard,
                                        negate, rule, set_category, set_description)


def named_predicates():
    return {
        "metal": P.all_of(P.description(r"\b(bolt|anvil|gear)\b"),
                          P.category(r"^(LARGE|MEDIUM)$")),
    }


def main_rules():
    named = named_predicates()
    return [
        rule(set_category("HARDWARE"), add_tag("metal"), when="metal", name="metal"),
        rule(add_tag("colour"), set_category("COLOUR"),
             when=P.all_of(P.description(r"^(red|blue) "), P.in_period("01/01/97", "31/12/98")),
             name="colour"),
        rule(discard(), when=P.all_of(P.statement_id(r"^S[0-2]$"), P.description("widget")),
             name="drop_widgets"),
        rule(negate(), add_tag("promo"), set_description("promo item"),
             when=P.all_of(P.category("PROMO"), P.not_(P.description("hot|cold"))),
             name="promo"),
        rule(add_tag("junk"), discard(), set_category("NEVER"),
             when=[P.description("gizmo"), P.category("^ECONOMY$")], name="junk"),
        rule(when=P.all_of(P.currency("USD"),
                           P.in_period("01/01/00", "31/12/01", inclusive=True)),
             name="keep_recent_usd"),
        rule(add_tag("other"), name="other"),
    ], named


def tidy_rules():
    return [
        rule(set_description("hardware"), when=P.category("^HARDWARE$"), name="hw"),
        rule(set_category("PAINT"), add_tag("painted"), when=P.has_tag("colour"), name="paint"),
        rule(add_tag("seen"), when=P.not_(P.has_tag("other")), name="seen"),
    ]


def sample_pipeline(extra_passes=()) -> Pipeline:
    rules, named = main_rules()
    return Pipeline([RulePass("main", rules), RulePass("tidy", tidy_rules()), *extra_passes],
                    named=named)


__all__ = ["main_rules", "tidy_rules", "sample_pipeline", "named_predicates", "OperatorPass"]
