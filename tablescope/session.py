"""Session helpers: a SparkSession tuned for the library and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "tablescope", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with AQE, skew-join splitting and UTC time.

    On a cluster pass ``master=None`` and let spark-submit decide; size
    ``shuffle_partitions`` so one shuffle partition stays well under executor
    memory (AQE coalesces small ones at run time).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Set here only when unset AND the master is local (tests, laptops): then a
    fresh temporary folder is used. On a cluster an unset folder is an error,
    since a machine-local folder is not visible to the executors.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = _context(spark)
    if not path and sc is not None:
        path = sc.getCheckpointDir()
    if not path:
        master = sc.master if sc is not None else spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder on shared storage")
        path = tempfile.mkdtemp(prefix="tablescope-")
        spark.conf.set("spark.checkpoint.dir", path)
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def _context(spark: SparkSession):
    """The SparkContext of a classic session; None under Spark Connect."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect sessions have no SparkContext
        return None


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique, not yet existing path below the scratch folder."""
    return f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(df, min_partitions: int | None = None):
    """Round-robin ``df`` over the cluster when its scan has fewer partitions
    than the cluster has cores (a small file in one Parquet row group is read
    by ONE task). A no-op for large inputs, which already scan in parallel."""
    sc = _context(df.sparkSession)
    if sc is None:  # Spark Connect: partition counts are not visible; leave the plan alone
        return df
    target = min_partitions or sc.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


def materialize(df):
    """Compute a small, reused intermediate once and cut its lineage: cache it,
    write it to the session's checkpoint folder (reading the cache, not the
    source), then drop the cache. Later readers scan the checkpoint files."""
    from pyspark import StorageLevel
    scratch_dir(df.sparkSession)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return cached.checkpoint(eager=True)
    finally:
        cached.unpersist()
