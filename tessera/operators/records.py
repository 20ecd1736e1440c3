"""Record keeping: latest versions, upserts, conflicts, deduplication, integrity reports and change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last event of each key. One aggregate with map-side combine: a hot key meets as one row per task."""
    rest = [c for c in events.columns if c not in keys]
    last = events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_e"))
    return last.select(*keys, *[F.col(f"_e.{c}").alias(c) for c in rest])


def upsert(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of changes, and those of base whose key no change has."""
    return base.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def insert_if_absent(base: DataFrame, new: DataFrame, keys: list[str], payload: Column, other: Column) -> tuple[DataFrame, DataFrame]:
    """Rows of new whose key is absent from base, and the keys present with another payload (conflicts)."""
    fresh = new.join(base.select(*keys), keys, "left_anti")
    a, b = base.select(*keys, payload.alias("_p")), new.select(*keys, other.alias("_q"))
    return fresh, a.join(b, keys).where(~F.col("_p").eqNullSafe(F.col("_q"))).select(*keys)


def next_versions(history: DataFrame, proposed: DataFrame, keys: list[str], digest_col: str, version_col: str = "version") -> DataFrame:
    """Proposed rows that differ from their key's latest version, numbered one above it."""
    last = history.groupBy(*keys).agg(F.max(version_col).alias("_v"), F.max_by(digest_col, version_col).alias("_d"))
    return proposed.join(last, keys, "left").where(F.col("_d").isNull() | (F.col("_d") != F.col(digest_col))).withColumn(version_col, F.coalesce("_v", F.lit(0)) + 1).drop("_v", "_d")


def duplicates(df: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Keys that occur more than once (nulls equal), with their number and least id."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(id_col).alias("first_id")).where("n > 1")


def survivors(df: DataFrame, keys: list[str], id_col: str, priority: Column) -> DataFrame:
    """(id, survivor): the id of each key with the least priority, then the least id."""
    best = df.groupBy(*keys).agg(F.min_by(id_col, F.struct(priority, F.col(id_col))).alias("survivor"))
    condition = None
    for k in keys:
        c = df[k].eqNullSafe(best[k])
        condition = c if condition is None else condition & c
    return df.join(best, condition).select(df[id_col], "survivor")


def report(checks: dict[str, DataFrame]) -> DataFrame:
    """(check_name, n) with the number of offending rows of each check."""
    out = None
    for name, rows in checks.items():
        row = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("check_name"), "n")
        out = row if out is None else out.unionAll(row)
    return out


def missing_keys(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return child.join(parent.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


def set_merge(df: DataFrame, keys: list[str], array_col: str, out: str) -> DataFrame:
    """Keys with the sorted union of their arrays."""
    return df.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(array_col)))).alias(out))


def difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows on one side only, marked left or right."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionAll(b.exceptAll(a).withColumn("side", F.lit("right")))


def status_changes(before: DataFrame, after: DataFrame, key: str, status: str) -> DataFrame:
    """(status_before, status_after, n) over all keys of either side."""
    a, b = before.select(key, F.col(status).alias("status_before")), after.select(key, F.col(status).alias("status_after"))
    return a.join(b, key, "full").groupBy("status_before", "status_after").agg(F.count("*").alias("n"))


def strata(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each stratum, numbered."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("position") <= k)
