"""Cutting a plan's lineage between the rounds of a loop."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; in local mode without it a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    found = spark.__dict__.get("_strandwork_shared")
    if not found:
        found = spark._strandwork_shared = tempfile.mkdtemp(prefix="strandwork-")
    return found


def settled(df: DataFrame) -> DataFrame:
    """df as computed once, kept in the shared folder, so that a lost executor loses nothing."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
