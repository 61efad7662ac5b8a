"""Session helpers: one place that builds a SparkSession and finds the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at any scale: AQE re-plans joins and coalesces small shuffle partitions at
# runtime, skew-join splitting handles hot keys, and the UI (a server) stays off.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "faultline", shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Return the active session, or build one (local mode for tests and the bench)."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if master and master.startswith("local"):
        # Local mode runs everything in the driver JVM; on a cluster the operator sizes it.
        conf["spark.driver.memory"] = os.environ.get("FAULTLINE_DRIVER_MEMORY", "12g")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return a fresh scan of it: the plan is cut, columns
    can be pruned, and the planner sees the size of the files."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    broadcast_by_measured_size(df.sparkSession)
    join_small_partitions_by_hash(df.sparkSession)
    drop_shuffles_when_done(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_by_measured_size(spark: SparkSession) -> None:
    """Leave broadcasts to AQE, which measures rows in memory.  The size of Parquet files says little about them:
    runs of equal values take next to no bytes, so millions of narrow rows look small and end in the driver."""
    static, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    limit = spark.conf.get(static)
    if limit != "-1":
        if spark.conf.get(measured, None) is None:
            spark.conf.set(measured, limit)
        spark.conf.set(static, "-1")


def join_small_partitions_by_hash(spark: SparkSession) -> None:
    """Joins of sides whose partitions AQE measures below its advisory size build a hash table instead of sorting both
    sides by their strings.  Larger or skewed partitions are sorted (and split) as before."""
    small = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    if spark.conf.get(small, None) is None:
        spark.conf.set(small, spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes"))


def drop_shuffles_when_done(spark: SparkSession) -> None:
    """Shuffle files go when the step that wrote them has ended, not when the driver's JVM happens to collect garbage:
    steps are stored, so nothing reads the files again."""
    drop = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    if spark.conf.get(drop, None) is None:
        spark.conf.set(drop, "true")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for reliable checkpoints.

    On a cluster this is ``spark.checkpoint.dir`` as configured by the operator (a shared file
    system); a cluster without one is an error.  Only a local master gets a fresh scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="faultline-ckpt-", dir=os.environ.get("FAULTLINE_SCRATCH", "/tmp"))
    sc.setCheckpointDir(folder)
    return folder
