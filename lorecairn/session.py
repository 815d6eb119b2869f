"""Session settings and the few run-time helpers every operator shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Row, SparkSession

#: Settings the library is tuned for.  On a cluster pass them to spark-submit.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Checkpoint files go once nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, **extra: str) -> SparkSession:
    """Create (or reuse) a session with the library's settings."""
    builder = SparkSession.builder.appName("lorecairn")
    if master:
        builder = builder.master(master)
    for name, value in {**SETTINGS, **extra}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


#: Folders for sessions of one machine that name none.
_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    A cluster must name it.  Only a local master, where driver and executors
    share one disk, gets a folder of its own, for tests.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="lorecairn-checkpoint-")
    return _local_folders[context.applicationId]


def own_folder(spark: SparkSession) -> str:
    """A folder of the application's own in the shared one, for tables that outlive a function."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df`` in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def bounded_rows(df: DataFrame, limit: int) -> list[Row] | None:
    """All rows of ``df`` when there are at most ``limit``, otherwise ``None``.

    At most ``limit + 1`` rows ever reach the driver, so callers can inline a
    small request table into the plan and take another way for a large one.
    """
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def spread(scan: DataFrame, *by: str) -> DataFrame:
    """Spread a file scan with too few splits over all cores, by the hash of ``by``.

    A table stored in many files already has a task per split and is left as
    it is; only a table that would keep most cores idle pays for the exchange.
    ``scan`` must be a plain read: counting its splits runs nothing.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores, *by)
