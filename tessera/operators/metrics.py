"""Evaluation metrics as relational aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The 97.5 % point of the standard normal distribution (fixed value).
Z = 1.959963984540054


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def proportion(hits: Column | str, total: Column | str) -> list[Column]:
    """estimate, wilson_low, wilson_high and status (NOT_APPLICABLE at 0, SMALL_N under 10, else MEASURED)."""
    k, n = _c(hits).cast("double"), _c(total).cast("double")
    p = k / n
    center, scale = (p + Z * Z / (2 * n)) / (1 + Z * Z / n), 1 + Z * Z / n
    half = Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n)) / scale
    some = n > 0
    return [
        F.when(some, p).alias("estimate"),
        F.when(some, F.greatest(F.lit(0.0), center - half)).alias("wilson_low"),
        F.when(some, F.least(F.lit(1.0), center + half)).alias("wilson_high"),
        F.when(~some, "NOT_APPLICABLE").when(n < 10, "SMALL_N").otherwise("MEASURED").alias("status"),
    ]


def latency(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """n, median, nearest-rank 95th percentile and maximum per group, with exact distributed percentiles."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.median(value).alias("median"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95"), F.max(value).alias("maximum"))


def ranking_quality(ranks: DataFrame, rank_col: str, by: list[str], cutoffs: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Recall at cutoffs, mean reciprocal rank and share without result; ranks: one row per query, null if not found."""
    r = F.col(rank_col)
    return ranks.groupBy(*by).agg(
        F.count("*").alias("n"),
        *[F.avg(F.when(r <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}") for k in cutoffs],
        F.avg(F.coalesce(1.0 / r, F.lit(0.0))).alias("mrr"),
        F.avg(F.when(r.isNull(), 1.0).otherwise(0.0)).alias("no_result"),
    )


def class_scores(df: DataFrame, expected: str, actual: str) -> DataFrame:
    """Precision, recall and F1 per class that occurs on either side; 0 where a ratio has no denominator."""
    sides = df.groupBy(expected, actual).agg(F.count("*").alias("_n"))
    e = sides.groupBy(F.col(expected).alias("class")).agg(F.sum("_n").alias("n_expected"), F.sum(F.when(F.col(expected) == F.col(actual), F.col("_n")).otherwise(0)).alias("tp"))
    a = sides.groupBy(F.col(actual).alias("class")).agg(F.sum("_n").alias("n_actual"))
    j = e.join(a, "class", "full").na.fill(0, ["n_expected", "n_actual", "tp"])
    precision = F.when(F.col("n_actual") > 0, F.col("tp") / F.col("n_actual")).otherwise(0.0)
    recall = F.when(F.col("n_expected") > 0, F.col("tp") / F.col("n_expected")).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return j.select("class", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def macro(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.count("*").alias("n_classes"))


def set_scores(expected: Column, actual: Column) -> Column:
    """struct(tp, fp, fn) of two arrays read as sets."""
    return F.struct(F.size(F.array_intersect(expected, actual)).alias("tp"), F.size(F.array_except(actual, expected)).alias("fp"), F.size(F.array_except(expected, actual)).alias("fn"))


def prf(df: DataFrame, tp: str, fp: str, fn: str) -> DataFrame:
    """Precision, recall and F1 of summed counts; a ratio without denominator is 1."""
    s = df.agg(F.sum(tp).alias("tp"), F.sum(fp).alias("fp"), F.sum(fn).alias("fn"))
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(1.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(1.0)
    return s.select(p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))
