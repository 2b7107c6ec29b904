"""Session helpers: a local session for tests / bench, and lineage cutting.

Iterative operators cut their lineage with ``DataFrame.checkpoint()`` into the
directory the cluster names in ``spark.checkpoint.dir``.  A directory is only
invented when none is configured (local tests and the bench).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "tallyspark", memory: str = "8g") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Remove lineage checkpoints once their frames are unreachable.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.cleaner.periodicGC.interval", "1min")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a scratch one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # Nothing configured: this is a local run (tests, bench).
        configured = tempfile.mkdtemp(prefix="tallyspark-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame, how: str = "table") -> DataFrame:
    """Materialise ``df`` durably and return a frame that reads it back.

    ``how="table"`` (default) writes a parquet table under the shared
    checkpoint folder: columnar, compressed, and read back with column
    pruning.  ``how="checkpoint"`` uses a reliable RDD checkpoint (persisted
    first so the plan is computed once).  Never a local checkpoint: either
    form survives the loss of executors.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if how == "table":
        path = scratch_path(spark, "lineage")
        df.write.mode("overwrite").parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
        out._lineage_path = path
        return out
    if how != "checkpoint":
        raise ValueError(how)
    from pyspark import StorageLevel
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = cached.checkpoint(eager=True)
    cached.unpersist(blocking=False)
    return out


def release(*frames: DataFrame) -> None:
    """Delete the tables behind frames of ``cut_lineage`` that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_lineage_path", None)
        if path:
            _delete(df.sparkSession, path)
            _tables.discard(path)


def release_all(spark: SparkSession) -> None:
    """Delete every side table that this process wrote; call it when all results are consumed."""
    for path in list(_tables):
        _delete(spark, path)
    _tables.clear()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written side tables."""
    base = ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    _tables.add(path)
    return path


_tables: set[str] = set()
