"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Defaults for a local run. On a cluster the submitter's settings win: this
# module only fills in what is unset.
LOCAL_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a selective side (one employee, one customer) pre-filters the big scan
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Broadcast only what is known to be small; AQE re-plans at runtime from
    # measured sizes, below this threshold.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


# Settings for a cluster run. Applied by ``apply_cluster_defaults`` only where
# the submitter left them unset. AQE sizes shuffle partitions from measured
# data (advisory 256 MB) after starting from a generous count, splits skewed
# join partitions, and turns sort-merge joins into broadcasts only when a side
# is measured under the threshold.
CLUSTER_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def apply_cluster_defaults(spark: SparkSession, shuffle_partitions: int | None = None) -> SparkSession:
    """Fill in ``CLUSTER_DEFAULTS`` (and the initial shuffle partition count,
    e.g. a few thousand for 100 TB inputs; AQE coalesces it down) where the
    session does not set them. The checkpoint folder must be the cluster's
    ``spark.checkpoint.dir`` on shared storage."""
    for k, v in CLUSTER_DEFAULTS.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    if shuffle_partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return spark


def local_session(cpus: int | None = None, shuffle_partitions: int | None = None,
                  app: str = "inkwell") -> SparkSession:
    """A local session for tests and the benchmark."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in LOCAL_DEFAULTS.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
    builder = builder.config("spark.driver.memory", os.environ.get("INKWELL_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder named by ``spark.checkpoint.dir`` (or already set on
    the context), or None."""
    try:
        d = spark.sparkContext.getCheckpointDir()
    except Exception:  # noqa: BLE001  (sessions without a SparkContext, e.g. Spark Connect)
        d = None
    return d or spark.conf.get("spark.checkpoint.dir", None)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; only where none is set and
    the session is local (a test) create a private scratch folder."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001  (Spark Connect: the server's spark.checkpoint.dir applies)
        return spark.conf.get("spark.checkpoint.dir", "")
    current = sc.getCheckpointDir()
    if current:
        return current
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="inkwell-ckpt-")
    sc.setCheckpointDir(d)
    return d


def written_table(df: DataFrame, label: str = "table") -> DataFrame:
    """Cut lineage by writing ``df`` as a Parquet table under the checkpoint
    folder and reading it back (columnar: later readers prune columns and
    vectorise). Falls back to ``checkpoint()`` when no folder is known."""
    root = ensure_checkpoint_dir(df.sparkSession)
    if not root:
        return df.checkpoint(eager=True)
    path = f"{root.rstrip('/')}/inkwell-{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
