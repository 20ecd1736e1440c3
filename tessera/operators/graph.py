"""Graphs as edge lists: closures, bounded taxonomy paths, route navigation, inventories and shape checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.lineage import written


def closure(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """(descendant, ancestor, depth) of all pairs that any number of steps connects, by the fewest; safe on cycles.

    Each round doubles the reach: pairs of the greatest depth so far are continued by all known pairs, so a chain of n
    steps takes log2(n) rounds. Rounds are written down, so none evaluates an earlier one again.
    """
    step = edges.select(F.col(child).alias("descendant"), F.col(parent).alias("ancestor")).where("descendant IS NOT NULL AND ancestor IS NOT NULL")
    known = written(step.distinct().withColumn("depth", F.lit(1)))
    reach = 1
    while True:
        far = known.where(F.col("depth") == reach).select("descendant", F.col("ancestor").alias("_via"))
        on = known.select(F.col("descendant").alias("_via"), "ancestor", "depth")
        new = far.join(on, "_via").groupBy("descendant", "ancestor").agg((F.min("depth") + reach).alias("depth"))
        new = written(new.join(known, ["descendant", "ancestor"], "left_anti"))
        if not new.take(1):
            return known
        known, reach = written(known.unionByName(new)), reach * 2


def traverse(edges: DataFrame, requested: list[str], max_depth: int = 4) -> DataFrame:
    """Best path from each requested concept to every concept reached: up, down, or up then down, never down then up.

    edges: subject, object, predicate in subClassOf, identity, related. A related edge counts only as the first step
    and ends its path. Category matches are paths down or of identities without related edges; they beat others, then
    shorter paths, then the path's text. Paths never revisit a concept; their depth bounds the work.
    """
    if not 1 <= max_depth <= 8:
        raise ValueError("max_depth must be 1 to 8")
    kind = lambda forward: F.when(F.col("predicate") == "identity", "IDENTITY").when(F.col("predicate") == "related", "RELATED").otherwise("ANCESTOR" if forward else "DESCENDANT")
    steps = edges.select(F.col("subject").alias("from"), F.col("object").alias("to"), kind(True).alias("way"))
    steps = steps.unionAll(edges.select(F.col("object").alias("from"), F.col("subject").alias("to"), kind(False).alias("way"))).distinct()
    spark = edges.sparkSession
    at = spark.createDataFrame([(r, r, [r], "", True) for r in requested], "requested string, actual string, nodes array<string>, phase string, category boolean")
    found = None
    for depth in range(1, max_depth + 1):
        nxt = at.where("phase <> 'RELATED'").join(steps, F.col("actual") == F.col("from")).where(~F.array_contains("nodes", F.col("to")))
        nxt = nxt.where(~(F.col("phase").isin("DESCENDANT", "SIBLING") & (F.col("way") == "ANCESTOR")))
        if depth > 1:
            nxt = nxt.where("way <> 'RELATED'")
        phase = F.when(F.col("phase").isin("ANCESTOR", "SIBLING") & (F.col("way") == "DESCENDANT"), "SIBLING").when((F.col("way") == "IDENTITY") & (F.col("phase") != ""), F.col("phase")).otherwise(F.col("way"))
        at = nxt.select("requested", F.col("to").alias("actual"), F.array_append("nodes", F.col("to")).alias("nodes"), phase.alias("phase"), (F.col("category") & (F.col("way") != "RELATED")).alias("category"))
        row = at.select("requested", "actual", F.col("phase").alias("relationship"), F.lit(depth).alias("depth"), (F.col("category") & F.col("phase").isin("DESCENDANT", "IDENTITY")).alias("category_match"), F.array_join("nodes", ">").alias("path"))
        found = row if found is None else found.unionAll(row)
    best = Window.partitionBy("requested", "actual").orderBy(F.desc("category_match"), "depth", "path")
    return found.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def navigate(edges: DataFrame, start: DataFrame, route: list[tuple[str, str]], start_col: str = "node") -> DataFrame:
    """(start, node, path) after following relations in order, each FORWARD or REVERSE, without revisiting a node."""
    at = start.select(F.col(start_col).alias("start"), F.col(start_col).alias("node"), F.array(start_col).alias("path"))
    for relation, way in route:
        a, b = ("subject", "object") if way == "FORWARD" else ("object", "subject")
        step = edges.where(F.col("relation") == relation).select(F.col(a).alias("_from"), F.col(b).alias("_to")).distinct()
        at = at.join(step, at["node"] == step["_from"]).where(~F.array_contains("path", F.col("_to"))).select("start", F.col("_to").alias("node"), F.array_append("path", F.col("_to")).alias("path"))
    return at


def inventory(edges: DataFrame) -> DataFrame:
    """Per relation: uses, distinct subjects and objects."""
    return edges.groupBy("relation").agg(F.count("*").alias("n_uses"), F.countDistinct("subject").alias("n_subjects"), F.countDistinct("object").alias("n_objects"))


def count_violations(subjects: DataFrame, edges: DataFrame, subject_col: str, least: int | None, most: int | None) -> DataFrame:
    """Subjects with fewer or more edges than a shape allows, with their number and the broken rule."""
    n = subjects.select(subject_col).join(edges.groupBy(subject_col).agg(F.count("*").alias("n_values")), subject_col, "left").withColumn("n_values", F.coalesce("n_values", F.lit(0).cast("long")))
    rule: Column = F.lit(None).cast("string")
    if most is not None:
        rule = F.when(F.col("n_values") > most, "maxCount").otherwise(rule)
    if least is not None:
        rule = F.when(F.col("n_values") < least, "minCount").otherwise(rule)
    return n.withColumn("violation", rule).where("violation IS NOT NULL")


def unresolved(edges: DataFrame, nodes: DataFrame, node_col: str = "node") -> DataFrame:
    """Edge endpoints that are no node, with the number of edges that use them."""
    ends = edges.select(F.col("subject").alias(node_col), F.lit("subject").alias("role")).unionAll(edges.select(F.col("object").alias(node_col), F.lit("object").alias("role")))
    return ends.join(nodes.select(node_col).distinct(), node_col, "left_anti").groupBy(node_col, "role").agg(F.count("*").alias("n_edges"))
