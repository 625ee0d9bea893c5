"""Where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names for checkpoints.

    Where none is named, a master that runs in this process gets a temporary folder,
    once a session; on a cluster, whose executors would not see it, that is an error.
    """
    context = spark.sparkContext
    folder = context.getConf().get(SETTING) or spark.conf.get(SETTING, None) or context.getCheckpointDir()
    if not folder:
        master = context.master or ""
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="logsift-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path inside the shared folder that nobody has used."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def saved(table: DataFrame) -> DataFrame:
    """The table computed once and kept by a reliable checkpoint."""
    context = table.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(table.sparkSession))
    return table.checkpoint()
