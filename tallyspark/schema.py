"""The one relation of the library: the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

AMOUNT_TYPE = T.DecimalType(18, 4)

# Ledger columns in their canonical order.  ``_seq`` is unique per row and
# defines encounter order (file, then position); every order-dependent
# operator sorts by it and every identity join keys on it.
LEDGER_SCHEMA = T.StructType([
    T.StructField("transaction_date", T.DateType(), False),
    T.StructField("posting_date", T.DateType(), False),
    T.StructField("description", T.StringType(), False),
    T.StructField("amount", AMOUNT_TYPE, False),
    T.StructField("category", T.StringType(), True),
    T.StructField("currency", T.StringType(), True),
    T.StructField("source_id", T.StringType(), True),
    T.StructField("system_id", T.StringType(), True),
    T.StructField("id", T.StringType(), True),
    T.StructField("tags", T.ArrayType(T.StringType()), True),
    T.StructField("_seq", T.LongType(), False),
])

LEDGER_COLUMNS = [f.name for f in LEDGER_SCHEMA.fields]
DATA_COLUMNS = [c for c in LEDGER_COLUMNS if c != "_seq"]


def conform(df: DataFrame, keep_extra: bool = False) -> DataFrame:
    """Cast / complete a frame to the ledger schema (posting date defaults to
    the transaction date, tags become a sorted distinct set)."""
    cols: list[Column] = []
    present = set(df.columns)
    for f in LEDGER_SCHEMA.fields:
        if f.name in present:
            c = F.col(f.name).cast(f.dataType)
        else:
            c = F.lit(None).cast(f.dataType)
        if f.name == "posting_date":
            c = F.coalesce(c, F.col("transaction_date").cast(T.DateType()))
        if f.name == "tags":
            c = F.when(c.isNotNull(), F.array_sort(F.array_distinct(c)))
        cols.append(c.alias(f.name))
    if keep_extra:
        cols += [F.col(c) for c in df.columns if c not in LEDGER_COLUMNS]
    return df.select(*cols)
