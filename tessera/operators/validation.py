"""Validation of candidates: reasons as arrays, endpoint matrices, path checks, cascades and review lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.lineage import written


def reasons(rules: dict[str, Column]) -> Column:
    """Names of the broken rules, in order; a rule that is null is not broken."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]))


def status(rejecting: Column, reviewing: Column) -> Column:
    """REJECTED with reasons to reject, REVIEW_REQUIRED with reasons to look, else VALIDATED."""
    return F.when(F.size(rejecting) > 0, "REJECTED").when(F.size(reviewing) > 0, "REVIEW_REQUIRED").otherwise("VALIDATED")


def endpoint_errors(edges: DataFrame, classes: DataFrame, matrix: list[tuple[str, str, str]]) -> DataFrame:
    """Edges (subject, relation, object) whose classes no row (relation, domain, range) of the matrix allows.

    classes(entity, class) has ancestors already, so an inherited class fits too.
    """
    spark = edges.sparkSession
    allowed = F.broadcast(spark.createDataFrame(matrix, "relation string, domain string, range string"))  # a fixed list
    s = classes.select(F.col("entity").alias("subject"), F.col("class").alias("domain"))
    o = classes.select(F.col("entity").alias("object"), F.col("class").alias("range"))
    fine = edges.join(allowed, "relation").join(s, ["subject", "domain"], "left_semi").join(o, ["object", "range"], "left_semi")
    return edges.join(fine.select("subject", "relation", "object").distinct(), ["subject", "relation", "object"], "left_anti")


def cascade(rejected: DataFrame, dependents: DataFrame, node: str = "node", depends_on: str = "depends_on") -> DataFrame:
    """All nodes that are rejected or depend, directly or not, on one that is; each round is written down."""
    out = frontier = written(rejected.select(node).distinct())
    while frontier.take(1):
        frontier = written(dependents.join(frontier.select(F.col(node).alias(depends_on)), depends_on, "left_semi").select(node).distinct().join(out, node, "left_anti"))
        out = written(out.unionAll(frontier))
    return out


def path_errors(paths: DataFrame, edges: DataFrame, path: str, step: str, start: str, end: str, most: int = 5) -> DataFrame:
    """(path, error): TOO_LONG, DISCONNECTED (a step does not begin where the one before ended) or UNKNOWN_EDGE."""
    w = Window.partitionBy(path).orderBy(step)
    p = paths.withColumn("_before", F.lag(end).over(w)).withColumn("_n", F.count("*").over(Window.partitionBy(path)))
    known = edges.select(F.col("subject").alias(start), F.col("object").alias(end), F.lit(True).alias("_known")).distinct()
    p = p.join(known, [start, end], "left")
    error = F.when(F.col("_n") > most, "TOO_LONG").when(F.col("_before").isNotNull() & (F.col("_before") != F.col(start)), "DISCONNECTED").when(F.col("_known").isNull(), "UNKNOWN_EDGE")
    return p.select(path, error.alias("error")).where("error IS NOT NULL").distinct()


def unique_match(left: DataFrame, right: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """For each row of left the id of the one row of right with equal keys; null if there are none or several."""
    one = right.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(id_col).alias(id_col))
    return left.join(one, keys, "left").withColumn(id_col, F.when(F.col("_n") == 1, F.col(id_col))).drop("_n")


def consolidate(variants: DataFrame, identity: list[str], rank: list[Column], id_col: str) -> DataFrame:
    """One active row per identity; the others point to it in duplicate_of and stay for the audit."""
    w = Window.partitionBy(*identity).orderBy(*rank)
    first = F.first(id_col).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return variants.withColumn("duplicate_of", F.when(F.row_number().over(w) > 1, first)).withColumn("active", F.col("duplicate_of").isNull())


def omissions(statements: DataFrame, extracted: DataFrame, group: str, text: str) -> DataFrame:
    """Statements that no extracted text of their group repeats, white space and case apart."""
    key = lambda: F.lower(F.trim(F.regexp_replace(F.col(text), "\\s+", " ")))
    a = statements.withColumn("_k", F.sha2(key(), 256))
    return a.join(extracted.select(group, F.sha2(key(), 256).alias("_k")).distinct(), [group, "_k"], "left_anti").drop("_k")


def coalesce_ordered(options: list[tuple[Column, str]], otherwise: str) -> Column:
    """The name of the first option that holds."""
    return reduce(lambda rest, o: F.when(F.coalesce(o[0], F.lit(False)), F.lit(o[1])).otherwise(rest), reversed(options), F.lit(otherwise))
