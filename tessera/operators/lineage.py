"""How relations are kept, dealt and joined: written steps, input parallelism, and broadcasts of checked size."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir, or the one set on the context. A
    temporary folder serves only where all run on one machine, as in tests; elsewhere a missing setting is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    given = sc._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no shared folder")
    return os.path.join(tempfile.gettempdir(), "tessera-checkpoints")


def written(df: DataFrame) -> DataFrame:
    """The same rows, written in the shared folder, so that later steps survive lost executors and read them once."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def spread(scan: DataFrame) -> DataFrame:
    """A scan with at least as many partitions as there are cores: a small file of one row group is one task otherwise.

    Inputs of more partitions, as all large ones are, pass as they are and are not shuffled.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    few = scan._jdf.queryExecution().toRdd().getNumPartitions() < cores
    return scan.repartition(cores) if few else scan


def small(df: DataFrame, rows: int) -> bool:
    """Whether a relation has at most so many rows; reads no more of it than needed."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint only where the checked row count is under the bound; else Spark shuffles both sides."""
    return F.broadcast(df) if small(df, rows) else df
