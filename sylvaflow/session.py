"""Session defaults and lineage cuts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "sylvaflow", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators are planned for.

    On a cluster the submit command sets master, memory and the number of
    shuffle partitions; only settings that do not depend on its size are given
    here. AQE splits skewed join partitions and coalesces small ones.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "20000",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def default_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables of a local session without settings: below the warehouse folder, in its file system."""
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not context.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder every executor can reach")
        shared = default_folder(spark)
    context.setCheckpointDir(shared)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder, for tables and stream checkpoints."""
    _ensure_checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or default_folder(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Materialize ``df`` in the shared checkpoint folder.

    The rows survive the loss of an executor, and an iterative job does not
    re-plan everything before it.
    """
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
