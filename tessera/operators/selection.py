"""Selection by topic, class and policy, and rankings restricted to what a graph allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Suffixes under which a distinctive term still counts as mentioned (fixed values).
FORMS = ("s", "ed", "ing")


def all_terms(text: Column, terms: list[str]) -> Column:
    """Whether a text has every term as a word, also with a common suffix."""
    out = F.lit(True)
    for t in terms:
        out = out & F.lower(text).rlike(f"(^|[^\\p{{L}}]){t}({'|'.join(FORMS)})?([^\\p{{L}}]|$)")
    return out


def families(query: str, text: Column, pairs: list[tuple[str, str]]) -> Column:
    """A text applies unless the query asks for a topic family (pattern) that the text (second pattern) lacks."""
    import re

    out = F.lit(True)
    for asked, held in pairs:
        if re.search(asked, query, re.I):
            out = out & text.rlike("(?i)" + held)
    return out


def visible_edges(edges: DataFrame, passages: DataFrame, evidence: str, state: str) -> tuple[DataFrame, DataFrame]:
    """Edges that are approved and whose evidence all exists, and the others, which stay staged."""
    gone = edges.select("subject", "object", F.explode_outer(evidence).alias("_e")).join(passages.select(F.col("passage").alias("_e")), "_e", "left_anti")
    gone = gone.select("subject", "object").distinct()
    good = edges.where(F.col(state) == "APPROVED").join(gone, ["subject", "object"], "left_anti")
    return good, edges.join(good.select("subject", "object"), ["subject", "object"], "left_anti")


def edge_errors(edges: DataFrame, matrix: list[tuple[str, str, str]]) -> DataFrame:
    """Taxonomy edges whose predicate does not join their kinds of endpoints."""
    allowed = F.broadcast(edges.sparkSession.createDataFrame(matrix, "predicate string, subject_kind string, object_kind string"))  # a fixed list
    return edges.join(allowed, ["predicate", "subject_kind", "object_kind"], "left_anti")


def alternatives(labels: DataFrame, properties: list[tuple[str, str]], unit: Column) -> DataFrame:
    """(label, property) for each property that a label's unit could measure."""
    p = F.broadcast(labels.sparkSession.createDataFrame(properties, "property string, canonical string"))  # the registry
    return labels.withColumn("canonical", unit).join(p, "canonical").select("label", "property")


def rank_of_targets(ranking: DataFrame, targets: DataFrame, query: str, item: str) -> DataFrame:
    """Per query the best rank of any target; null where none was found."""
    hit = ranking.join(targets, [query, item]).groupBy(query).agg(F.min("rank").alias("rank"))
    return targets.select(query).distinct().join(hit, query, "left")
