"""Cutting lineage where later steps read a result more than once, and folders that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. A local session, as in tests, may leave the setting unset and gets a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is unset: on a cluster it must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="sitelens-"))
    return context.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df computed once and kept as a checkpoint in the shared folder, so it outlives lost executors."""
    shared(df.sparkSession)
    return df.checkpoint()
