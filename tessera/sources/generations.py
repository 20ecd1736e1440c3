"""Immutable generations of a table with a pointer to the current one, through Hadoop file systems.

A generation is written beside the others and becomes visible when the pointer moves, so readers never see a part of
one, and writing the same generation again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def pointer(spark: SparkSession, folder: str) -> str | None:
    """The name of the current generation."""
    p, fs = _path(spark, f"{folder}/_current")
    if not fs.exists(p):
        return None
    names = sorted(s.getPath().getName() for s in fs.listStatus(p))
    return names[-1].split("~", 1)[1] if names else None


def current(spark: SparkSession, folder: str) -> DataFrame | None:
    name = pointer(spark, folder)
    return None if name is None else spark.read.parquet(f"{folder}/{name}")


def write(df: DataFrame, folder: str, name: str) -> str:
    """Writes a generation and moves the pointer to it; an existing generation of that name is kept as it is."""
    spark = df.sparkSession
    p, fs = _path(spark, f"{folder}/{name}/_SUCCESS")
    if not fs.exists(p):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    marks, fs = _path(spark, f"{folder}/_current")
    have = [s.getPath().getName() for s in fs.listStatus(marks)] if fs.exists(marks) else []
    if not any(m.split("~", 1)[1] == name for m in have):
        q, fs = _path(spark, f"{folder}/_current/{len(have):09d}~{name}")
        fs.create(q, False).close()
    return name


def rollback(spark: SparkSession, folder: str) -> str | None:
    """Moves the pointer back to the generation before the current one and returns its name."""
    marks, fs = _path(spark, f"{folder}/_current")
    names = sorted(s.getPath().getName() for s in fs.listStatus(marks)) if fs.exists(marks) else []
    if len(names) < 2:
        return None
    p, fs = _path(spark, f"{folder}/_current/{names[-1]}")
    fs.delete(p, False)
    return names[-2].split("~", 1)[1]
