"""File sources and sinks: tables, CSV and TSV cells with their places, whole texts, JSON lines and immutable results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def csv(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """A table with a header, all columns as stripped strings; UTF-8 with or without a mark, else Windows-1252."""
    raw = spark.read.option("header", True).option("sep", separator).option("multiLine", True)
    df = raw.csv(path)
    bad = F.lit(False)
    for c in df.columns:
        bad = bad | F.coalesce(F.contains(F.col(f"`{c}`"), F.lit("�")), F.lit(False))
    if any("�" in c for c in df.columns) or df.where(bad).take(1):
        # Latin-1 and Windows-1252 differ in 0x80 to 0x9F only.
        high = [(bytes([b]).decode("latin-1"), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
        high = [(a, b) for a, b in high if b]
        df = raw.option("encoding", "iso-8859-1").csv(path)
        df = df.select(*[F.translate(F.col(f"`{c}`"), "".join(a for a, _ in high), "".join(b for _, b in high)).alias(c) for c in df.columns])
    return df.select(*[F.trim(F.col(f"`{c}`")).alias(c.lstrip("﻿").strip()) for c in df.columns])


def cells(df: DataFrame, file: str) -> DataFrame:
    """(file, row, ordinal, header, value, checksum) of each cell of a small source table, rows in file order."""
    numbered = df.withColumn("_row", F.monotonically_increasing_id())
    parts = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("header"), F.col(f"`{c}`").alias("value")) for i, c in enumerate(df.columns)])
    out = numbered.select(F.lit(file).alias("file"), F.col("_row").alias("row"), F.explode(parts).alias("c")).select("file", "row", "c.*")
    return out.withColumn("checksum", F.sha2(F.concat_ws("|", "header", F.coalesce("value", F.lit(""))), 256))


def changed_cells(kept: DataFrame, now: DataFrame) -> DataFrame:
    """Cells whose checksum, header or value differs from what was registered, or that are gone."""
    a = kept.select("file", "row", "ordinal", F.col("checksum").alias("_old"))
    return a.join(now.select("file", "row", "ordinal", "checksum"), ["file", "row", "ordinal"], "left").where(~F.col("_old").eqNullSafe(F.col("checksum"))).select("file", "row", "ordinal")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, checksum) of whole text files."""
    raw = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return raw.withColumn("checksum", F.sha2("text", 256))


def binaries(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, checksum) of files of any kind."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("checksum"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a line that does not parse is kept in _corrupt."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    return spark.read.text(path).select(F.from_json("value", f"{schema}, _corrupt string", options).alias("r")).select("r.*")


def write_once(df: DataFrame, path: str) -> None:
    """An immutable result: fails if it exists."""
    df.write.mode("errorifexists").parquet(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


#: What must never be in a published artefact.
SECRETS = "(?i)(authorization\\s*[:=]|bearer\\s+[a-z0-9._-]{8,}|api[_-]?key\\s*[:=])"


def leaks(df: DataFrame, text_col: str) -> DataFrame:
    """Rows whose text looks like a credential."""
    return df.where(F.col(text_col).rlike(SECRETS))
