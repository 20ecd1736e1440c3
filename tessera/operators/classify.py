"""Classification of subjects as direct, related or no direct evidence, with explanation and ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.constraints import DIFFER, INVALID, MATCH, UNKNOWN

DIRECT, RELATED, NO_DIRECT = "DIRECT", "RELATED", "NO_DIRECT"
#: Weights of a dimension's status in a ranking score (fixed values).
STATUS_WEIGHTS = {MATCH: 3, DIFFER: -2, UNKNOWN: -1, INVALID: -1}


def relation_outcome(actual: Column, wanted: str, closed_world: bool = False, ancestors: Column | None = None) -> Column:
    """Of a relation constraint, from the array of related entities: a category above one of them matches too; no
    relation is unknown unless the relation is closed-world."""
    has = F.array_contains(actual, wanted)
    if ancestors is not None:
        has = has | F.coalesce(F.array_contains(ancestors, wanted), F.lit(False))
    present = F.size(F.coalesce(actual, F.array().cast("array<string>"))) > 0
    return F.when(F.coalesce(has, F.lit(False)), MATCH).when(present | F.lit(closed_world), DIFFER).otherwise(UNKNOWN)


def _any(columns: list[Column], value: str) -> Column:
    return reduce(lambda a, b: a | b, [c == value for c in columns], F.lit(False))


def classify(outcomes: dict[str, Column], numeric: tuple[str, ...] = (), anchors: tuple[str, ...] = (), related_policy: bool = False, overlap: Column | None = None, unresolved: bool = False) -> Column:
    """DIRECT if there are constraints and all match; else RELATED if one matches, categories overlap, or, under the
    related policy, a numeric dimension differs; anchors, where requested, must match for RELATED."""
    columns = list(outcomes.values())
    blocked = _any(columns, DIFFER) | _any(columns, UNKNOWN) | _any(columns, INVALID) | F.lit(unresolved)
    near = _any(columns, MATCH)
    if overlap is not None:
        near = near | overlap
    if related_policy:
        near = near | _any([outcomes[k] for k in numeric], DIFFER)
        wanted = [outcomes[k] for k in anchors if k in outcomes]
        if wanted:
            anchored = _any(wanted, MATCH)
            near = near & (anchored if overlap is None else anchored | overlap)
    return F.when(F.lit(bool(columns)) & ~blocked, DIRECT).when(near, RELATED).otherwise(NO_DIRECT)


def classify_v1(outcomes: dict[str, Column], absent_differs: tuple[str, ...] = ()) -> Column:
    """The earlier policy: what is unknown does not block, and in absent_differs a missing value differs."""
    columns = [F.when(c == UNKNOWN, DIFFER).otherwise(c) if k in absent_differs else c for k, c in outcomes.items()]
    return F.when(~_any(columns, DIFFER), DIRECT).when(_any(columns, MATCH), RELATED).otherwise(NO_DIRECT)


def score(outcomes: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Sum over dimensions of its weight (1 unless given) times its status' weight."""
    total = F.lit(0.0)
    for name, c in outcomes.items():
        status = F.lit(STATUS_WEIGHTS[UNKNOWN])
        for value in (MATCH, DIFFER):
            status = F.when(c == value, F.lit(STATUS_WEIGHTS[value])).otherwise(status)
        total = total + status * F.lit(float((weights or {}).get(name, 1)))
    return total


def signature(outcomes: dict[str, Column]) -> Column:
    return F.concat_ws(";", *[F.concat(F.lit(k + "="), c) for k, c in sorted(outcomes.items())])


def ranked(df: DataFrame, score_col: str, id_col: str, partition: list[str] | None = None, out: str = "rank") -> DataFrame:
    """Ranks by score, highest first, then id. With a partition the window is distributed; without one, use top()."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*(partition or [])).orderBy(F.desc(score_col), F.asc(id_col))))


def top(df: DataFrame, score_col: str, id_col: str, k: int) -> DataFrame:
    """The first k by score then id: each task keeps k rows, and only those meet."""
    return df.orderBy(F.desc(score_col), F.asc(id_col)).limit(k)


def groups(df: DataFrame, keys: list[str], id_col: str, rank_col: str) -> DataFrame:
    """Candidates with equal keys: their number and the best-ranked one as representative."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_candidates"), F.min_by(id_col, rank_col).alias("representative_id"), F.min(rank_col).alias("best_rank"))


def compare(values: DataFrame, operands: list, operand_col: str, dimension_col: str, value_col: str) -> DataFrame:
    """Per dimension: shared if all operands have the same one value, different if values differ, unknown if any has none."""
    some = values.where(F.col(operand_col).isin(operands)).groupBy(dimension_col).agg(F.countDistinct(F.when(F.col(value_col).isNotNull(), F.col(operand_col))).alias("n_have"), F.countDistinct(value_col).alias("n_values"))
    status = F.when(F.col("n_have") < len(operands), "unknown").when(F.col("n_values") == 1, "shared").otherwise("different")
    return some.select(dimension_col, status.alias("status"), "n_values")
