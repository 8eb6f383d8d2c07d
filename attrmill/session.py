"""Session construction and lineage cutting.

On a cluster the session is built by the platform; `get_session` only fills
in settings that are unset, so cluster-wide values (shuffle partitions,
checkpoint directory) always win.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the library relies on. Applied only where the session leaves them unset.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, app: str = "attrmill", **conf: str) -> SparkSession:
    """Return the active session, or build a local one for tests and benches."""
    active = SparkSession.getActiveSession()
    if active is not None:
        _apply_defaults(active)
        return active
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        **_DEFAULTS,
        **conf,
    }
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    _apply_defaults(spark)
    return spark


def _apply_defaults(spark: SparkSession) -> None:
    for k, v in _DEFAULTS.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (spark.checkpoint.dir).

    Only a local session (tests) that names none gets a scratch folder; on a cluster a
    machine-local folder would lose data with its machine, so that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="attrmill-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` kept as a table in the shared checkpoint folder (survives executor loss)."""
    return written(df, "cut")


def table_path(spark: SparkSession, name: str) -> str:
    """Path for an intermediate table inside the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), "tables", name)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a new table in the shared checkpoint folder: computed once, and unlike a checkpoint
    without the constraints of its plan, which grow with every join of an iteration."""
    path = table_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
