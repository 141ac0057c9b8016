"""Session construction and the reliable checkpoint directory."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Defaults chosen for partition sizing: AQE coalesces small shuffles and
# splits skewed join partitions at run time, so a key that holds a third of
# all rows does not end up in a single reduce task.
_DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Checkpoint files of iterations that went out of scope are removed.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(
    master: str | None = None,
    app_name: str = "stratafac",
    shuffle_partitions: int | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """Return (or create) a session with the engine defaults applied.

    On a cluster ``master`` stays ``None`` and the submit-time settings win;
    tests pass ``local[N]``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(_DEFAULT_CONF)
    if master and master.startswith("local"):
        # Local mode runs everything in the driver JVM; the 1 GB default is
        # too small to build broadcast relations of a few hundred MB.
        settings["spark.driver.memory"] = "8g"
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, configuring it if needed.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that value is
    always used. Only a local-mode session without the setting (unit tests)
    gets a fresh scratch folder; a cluster session without it is an error,
    because a machine-local folder would not survive executor loss.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not configured:
        # local-cluster has executors of its own
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a shared folder "
                "(HDFS/S3/ABFS) so iterative jobs can cut lineage reliably"
            )
        configured = tempfile.mkdtemp(prefix="stratafac-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint directory for written tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tables", name)


def reliable_cut(df):
    """Checkpoint ``df`` to the reliable checkpoint directory, computing it once.

    An eager checkpoint runs one job to count and a second one to write the
    files; persisting first makes the second job read the cached blocks
    instead of recomputing the plan.
    """
    from pyspark import StorageLevel

    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out
