"""Session construction, reliable checkpoints and size-checked small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def get_session(app_name: str = "cohortlake", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session with adaptive execution and Arrow transfer on."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that the driver and all executors share.

    It is the one the session names in ``spark.checkpoint.dir``. Where that is unset, as in tests,
    a folder below the warehouse takes its place, which is shared as well; never a temporary one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return folder.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` through the shared folder, so that lost executors cost no rerun."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def sized(df: DataFrame) -> DataFrame:
    """Materialise a derived table that is expected to be small and let Catalyst see its true size.

    After the count the cached relation carries exact statistics, so the join that follows is
    broadcast only when the table really is below ``spark.sql.autoBroadcastJoinThreshold``; a
    larger table is joined by shuffle (with adaptive skew handling). No broadcast hint is needed.
    """
    cached = df.persist()
    cached.count()
    return cached
