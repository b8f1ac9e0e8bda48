"""Reliable checkpoints and folders for operators that write what they go on with."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; in local mode alone, a temporary folder stands in for an unset one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="rounds-"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the shared folder."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path for tables of one run in the shared folder; nothing is there yet."""
    return f"{_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
