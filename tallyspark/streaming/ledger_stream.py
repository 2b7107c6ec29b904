"""Apply rule passes to ledger CSV files as they arrive.

The reference only processes finite inputs; this module runs the same
stateless rule passes incrementally: ``readStream`` over a folder of ledger
CSV files, the pipeline applied to each micro-batch, kept and discarded rows
written as CSV, a folder per batch.  Rule passes are row-local, so no streaming state is kept;
passes that need the whole ledger (dedupe, offset pairing, reconciliation)
belong in a batch job over the accumulated output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallyspark.operators.rules import Pipeline, RulePass
from tallyspark.sources import csv as C
from tallyspark.sources import sinks


def read_ledger_stream(spark: SparkSession, folder: str, max_files_per_trigger: int = 100) -> DataFrame:
    """Ledger CSV files of ``folder`` as a stream of typed ledger rows."""
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in C.LEDGER_CSV_COLUMNS])
    raw = (spark.readStream.schema(schema).option("header", True).option("enforceSchema", True)
           .option("quote", '"').option("escape", '"').option("multiLine", True)
           .option("maxFilesPerTrigger", max_files_per_trigger).csv(folder))
    raw = raw.withColumn("_file", F.col("_metadata.file_path")).withColumn("_pos", F.lit(0).cast("long"))
    staged = raw.withColumn("_seq", F.lit(None).cast("long"))
    return C.typed_ledger(staged, C.LEDGER_MAPPING, C.LEDGER_DATE_FORMAT, policy="skip_rows").ledger


def run_rules_stream(stream: DataFrame, pipeline: Pipeline, kept_path: str, discarded_path: str,
                     checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Start a query that writes each micro-batch's kept and discarded rows."""
    for p in pipeline.passes:
        if not isinstance(p, RulePass):
            raise ValueError(f"pass {p.id!r} needs the whole ledger; run it in a batch job")

    def batch(df: DataFrame, batch_id: int) -> None:
        res = pipeline.run(df.drop("_file"))
        res.annotated.persist()
        # A folder per batch, overwritten if the batch is tried again.
        sinks.write_ledger_csv(res.kept, f"{kept_path}/batch-{batch_id}")
        sinks.write_ledger_csv(res.discarded, f"{discarded_path}/batch-{batch_id}")
        res.annotated.unpersist()

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
