"""Session helpers.

The library never creates global state: every operator takes DataFrames and returns DataFrames.  This module only
builds a session for tests/bench and resolves the shared checkpoint folder used to cut long lineages.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": os.environ.get("PANELSPARK_TZ", "UTC"),
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8, app: str = "panelspark",
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the library assumes (UTC, AQE on, UI off)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("PANELSPARK_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints / intermediate tables.

    On a cluster this is whatever ``spark.checkpoint.dir`` names (a shared filesystem).  Only when it is unset
    (local tests) do we create a private folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            # executors cannot see a machine-local folder: the cluster must name a shared one
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on the cluster file system)")
        path = tempfile.mkdtemp(prefix="panelspark-ckpt-")  # local mode only (tests)
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def stream_checkpoint(spark: SparkSession, name: str) -> str:
    """Checkpoint location of a streaming query: a sub-folder of the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}"


def cut_lineage(df):
    """Reliable checkpoint (survives executor loss) into the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
