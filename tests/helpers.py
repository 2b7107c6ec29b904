import datetime as dt
from decimal import Decimal

from tallyspark.schema import LEDGER_SCHEMA


def ledger_rows(spark, rows):
    """rows: dicts with ledger fields; missing ones get defaults."""
    out = []
    for i, r in enumerate(rows):
        d = r.get("transaction_date", dt.date(2020, 1, 1))
        out.append((d, r.get("posting_date", d), r.get("description", "x"),
                    Decimal(str(r.get("amount", 1))), r.get("category"), r.get("currency", "USD"),
                    r.get("source_id", "S"), r.get("system_id", "f1"), r.get("id", f"#{i + 1}"),
                    r.get("tags"), r.get("_seq", i + 1)))
    return spark.createDataFrame(out, LEDGER_SCHEMA)
