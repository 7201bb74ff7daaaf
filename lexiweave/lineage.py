"""Lineage cuts in the checkpoint folder that the session names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def settled(df: DataFrame) -> DataFrame:
    """df, computed once into the shared checkpoint folder; its files go when nothing refers to them."""
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession) -> str:
    """A path of this name only in the shared checkpoint folder."""
    return f"{_folder(spark)}/{uuid.uuid4().hex}"


def _folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only where none is set and all runs on one machine."""
    sc = spark.sparkContext
    sc._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="lexiweave-"))
    return sc._jsc.sc().getCheckpointDir().get()
