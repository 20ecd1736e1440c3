"""What the operators of this subpackage share: table access, lineage cuts and vectorised text hashing."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.lineage import broadcast_if, shared_folder, small, spread, written

__all__ = ["broadcast_if", "shared_folder", "small", "spread", "written"]

#: The white space that separates words in the quality and packing contracts.
SPACES = "\t\n\x0b\x0c\r "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; those whose texts are worked on have a task for each core at least, however few their files are."""
    t = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(t) if name in ("documents", "pages") else t


def _collect_garbage(spark: SparkSession) -> None:
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release(spark: SparkSession) -> None:
    """Has shuffles and broadcasts removed that nothing refers to any more, which Spark does only when the driver
    collects its garbage: a chain of steps then holds no more disk and driver memory than its largest step. The
    scheduler and its listeners refer to the last jobs until the next ones, so small jobs come between."""
    for _ in range(3):
        spark.range(10).repartition(2).count()
        time.sleep(0.5)
        _collect_garbage(spark)


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder, so that later steps survive lost executors and read it once. What
    the steps before it shuffled is given up."""
    out = written(df)
    _collect_garbage(df.sparkSession)
    return out


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Steps that run inside hand Python at most so many rows at a time: whole texts in small batches take less memory,
    which workers never give back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def text_key(text: str = "text"):
    """A 16 byte digest of a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64 bit finaliser (the public splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Odd multiplier of the polynomial hash over bytes, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_powers = {BASE: np.ones(1, np.uint64), BASE_INVERSE: np.ones(1, np.uint64)}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls up to a few MB."""
    have = _powers[base]
    if len(have) < n:
        size = 1 << max(10, (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 20:
            _powers[base] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P[i] = sum of byte hashes times BASE**j over j < i; differences give hashes of substrings."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end] for arrays of spans, equal wherever the bytes are equal."""
    return mix64((prefix[end] - prefix[start]) * powers(BASE_INVERSE, len(prefix))[start] + (end - start).astype(np.uint64))


#: Bytes that separate words: white space of the contracts. Every other byte belongs to a word.
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without white space in UTF-8 bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_IS_SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(text: str | None, lower: bool = True) -> np.ndarray:
    """A 64 bit hash for each word of the whole text."""
    data = np.frombuffer(((text or "").lower() if lower else (text or "")).encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    start, end = word_spans(data)
    return span_hash(prefix_hash(data), start, end)
