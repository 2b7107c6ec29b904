"""tallyspark: cleaning and reconciling financial ledgers on Spark DataFrames.

Every operator is a plain function over ``DataFrame`` / ``Column``; see the
sub-packages ``functions`` (scalars, predicates), ``operators`` (rules, dedupe,
checks, offset pairing, matching), ``sources`` / ``sinks`` (CSV, statement text)
and ``plans`` (fixture views and the registered queries).
"""

from tallyspark.schema import LEDGER_SCHEMA, LEDGER_COLUMNS  # noqa: F401

__all__ = ["LEDGER_SCHEMA", "LEDGER_COLUMNS"]
