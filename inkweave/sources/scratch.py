"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use ``spark.checkpoint.dir`` of the session; set a folder only where a local session has none."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "inkweave-checkpoints"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder and continue from the written files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
