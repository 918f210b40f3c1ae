"""Spark session defaults used by tests, the bench and the examples.

On a cluster the session usually comes from the platform; the operators do
not depend on these settings for correctness, only for speed (AQE, skew-join
splitting). ``get_session`` creates a session with them, or returns the one
that exists; what was given on the command line is never overridden.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every relmine job relies on. AQE coalesces tiny shuffles, splits
# skewed join partitions (hot prompt / user / document keys) and converts
# sort-merge joins to broadcast joins only when the *measured* side is small.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # remove checkpoint files once their DataFrame is garbage-collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def _submitted() -> set[str]:
    """Settings that spark-submit has set for this process."""
    if "PYSPARK_GATEWAY_PORT" not in os.environ:
        return set()
    from pyspark import SparkConf, SparkContext

    SparkContext._ensure_initialized()
    return {k for k, _ in SparkConf().getAll()}


def get_session(master: str | None = None, app: str = "relmine", **conf: str) -> SparkSession:
    """The active session, or a new one with relmine's defaults.

    Defaults give way to what spark-submit has set; ``conf`` comes last. Keys
    use underscores for dots (``spark_sql_shuffle_partitions="16"``) or are
    passed verbatim. The number of shuffle partitions has no default here.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    given = _submitted()
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {k: v for k, v in DEFAULT_CONF.items() if k not in given}
    for k, v in conf.items():
        settings[k if "." in k else k.replace("_", ".")] = str(v)
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str | None:
    """The folder that ``spark.checkpoint.dir`` names, the same for every run
    of an application; null where it is unset."""
    return spark.conf.get("spark.checkpoint.dir", None)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for intermediate data of this run.

    On a cluster it lies in the shared file system that ``spark.checkpoint.dir``
    names (a static setting, only read here); where neither it nor a context
    checkpoint folder is set, that is an error, since a folder of one machine
    would be lost with it. A local session gets a fresh folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = shared_dir(spark)
    if not named:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="relmine-ckpt-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut_lineage(df, spark: SparkSession | None = None):
    """Reliable checkpoint (never ``localCheckpoint``) into the shared folder."""
    spark = spark or df.sparkSession
    checkpoint_dir(spark)
    return df.checkpoint(eager=True)

