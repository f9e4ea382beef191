"""Shared storage for intermediate results: survives lost executors, seen by the driver and all executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder: as the cluster names it, else one of our own in the warehouse, or in local mode a temporary one."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local["):
            named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints-{uuid.uuid4().hex}"
        if not named:
            named = tempfile.mkdtemp(prefix="checkpoints-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


def cut(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there; its lineage ends here."""
    shared_dir(spark)
    return df.checkpoint(eager=True)


#: Rows that are few enough to be sent to every task.
FEW = 100_000


def cut_for_join(spark: SparkSession, df: DataFrame) -> tuple[DataFrame, bool]:
    """``cut`` of a table that a larger one is joined with, and whether it has few rows; the larger one is not shuffled then."""
    out = cut(spark, df)
    few = out.count() <= FEW
    return (F.broadcast(out) if few else out), few
