"""Lineage cuts through the folder that all machines share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that removes an action's shuffle files when it ends; it counts when a plan is made.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder every machine sees. Without a setting only a single-machine session gets one of its own, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="noticeframe-"))
    return sc.getCheckpointDir()


def read_once(df: DataFrame) -> DataFrame:
    """``df`` for one action, after which its shuffle files go at once; else they stay until the driver happens to collect its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, "false")
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        return df.select("*")
    finally:
        conf.set(SHUFFLE_CLEANUP, before)


def durable(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder; no shuffle file of the work outlives it."""
    shared_folder(df.sparkSession)
    return read_once(df).checkpoint()
