"""The folder that all executors share: checkpoints and other files."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and driver and executors are one process, a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = os.path.join(tempfile.gettempdir(), "millrace")
    return shared


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and cut from its lineage."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(shared or os.path.join(shared_folder(df.sparkSession), f"checkpoints-{uuid.uuid4().hex}"))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df, written as a table in the shared folder and read again, and the table's path, to be deleted when it is no longer read.

    For loops: a checkpoint carries on what the optimizer knows of a plan's columns, which doubles with each round of
    joins and renamings; a table that is read again knows nothing.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path
