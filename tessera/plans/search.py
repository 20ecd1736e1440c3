"""Plans: an intent compiled to DataFrames over entities, relations, values and passages.

entities(entity, classes array<string>, sources array<string>, evidence array<string>)
relations(subject, relation, object)
values(subject, property, number, text, unit, lower, approximate, qualifiers map<string,string>)
passages(passage, source, text)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import classify as C
from tessera.operators.constraints import outcome, qualified, single_outcome
from tessera.operators.retrieval import bm25, two_stage
from tessera.plans.intent import Intent, Registry


@dataclass
class Store:
    """The relations of a knowledge base."""

    entities: DataFrame
    relations: DataFrame
    values: DataFrame
    passages: DataFrame | None = None
    categories: DataFrame | None = None  # (descendant, ancestor) of entities


@dataclass
class Bundle:
    """What a plan returns; every slot is a lazy DataFrame."""

    classified: DataFrame
    direct: DataFrame
    related: DataFrame
    passages: DataFrame | None = None
    comparison: DataFrame | None = None


def candidates(intent: Intent, registry: Registry, store: Store) -> DataFrame:
    """Entities of the target classes and sources that meet the relations of the selection scope."""
    out = store.entities
    if intent.comparison:
        return out.where(F.col("entity").isin(list(intent.comparison.operands)))
    if intent.targets:
        out = out.where(F.arrays_overlap("classes", F.array(*[F.lit(x) for x in intent.targets])))
    if intent.sources:
        out = out.where(F.arrays_overlap("sources", F.array(*[F.lit(x) for x in intent.sources])))
    for r in intent.relations:
        if registry.relations[r.relation].selection_scope:
            scope = store.relations.where((F.col("relation") == r.relation) & (F.col("object") == r.entity)).select(F.col("subject").alias("entity"))
            out = out.join(scope, "entity", "left_semi")
    return out


def outcomes(intent: Intent, registry: Registry, store: Store) -> tuple[DataFrame, dict[str, str]]:
    """Candidates with one outcome column per constraint, and the constraint that each column stands for.

    Facts are reduced to one row per subject before they join the candidates: one shuffle on the subject for the
    relations and one for the values, however many constraints there are.
    """
    base = candidates(intent, registry, store).select("entity")
    names: dict[str, str] = {}
    if intent.relations:
        wanted = sorted({r.relation for r in intent.relations})
        edges = store.relations.where(F.col("relation").isin(wanted))
        if store.categories is not None:
            up = store.categories.select(F.col("descendant").alias("object"), F.col("ancestor"))
            edges = edges.unionByName(edges.join(up, "object").select("subject", "relation", F.col("ancestor").alias("object")))
        sets = edges.groupBy(F.col("subject").alias("entity")).agg(*[F.collect_set(F.when(F.col("relation") == r, F.col("object"))).alias(f"_r{i}") for i, r in enumerate(wanted)])
        base = base.join(sets, "entity", "left")
        for i, r in enumerate(intent.relations):
            c = C.relation_outcome(F.col(f"_r{wanted.index(r.relation)}"), r.entity, registry.relations[r.relation].closed_world)
            base = base.withColumn(f"relation_{i}", c)
            names[f"relation_{i}"] = f"{r.relation}={r.entity}"
        base = base.drop(*[f"_r{i}" for i in range(len(wanted))])
    if intent.properties:
        aggregates = []
        for i, c in enumerate(intent.properties):
            p = registry.properties[c.prop]
            one = outcome(c, p, F.col("number"), F.col("text"), F.col("unit"), F.col("lower"), F.col("approximate"))
            mine = (F.col("property") == c.prop) & (qualified(F.col("qualifiers"), c.qualifiers) if c.qualifiers else F.lit(True))
            aggregates.append(single_outcome(F.when(mine, one)).alias(f"property_{i}"))
            names[f"property_{i}"] = c.prop
        facts = store.values.where(F.col("property").isin(sorted({c.prop for c in intent.properties})))
        base = base.join(facts.groupBy(F.col("subject").alias("entity")).agg(*aggregates), "entity", "left")
        base = base.na.fill("UNKNOWN", [f"property_{i}" for i in range(len(intent.properties))])
    return base, names


def execute(intent: Intent, registry: Registry, store: Store, related_policy: bool = False, question: str | None = None, preferred: DataFrame | None = None) -> Bundle:
    """Validates, prunes, classifies and ranks; with a question also ranks passages by it."""
    intent = registry.validate(intent)
    rows, names = outcomes(intent, registry, store)
    columns = {k: F.col(k) for k in names}
    weights = {k: registry.weights.get(v.split("=")[0], 1.0) for k, v in names.items()}
    kind = C.classify(columns, tuple(k for k in names if k.startswith("property")), tuple(k for k, v in names.items() if v.split("=")[0] in registry.anchors), related_policy, unresolved=bool(intent.unresolved) or intent.clarification)
    rows = rows.withColumn("classification", kind).withColumn("score", C.score(columns, weights)).withColumn("signature", C.signature(columns) if columns else F.lit(""))
    rank = lambda k: C.ranked(C.top(rows.where(F.col("classification") == k), "score", "entity", intent.limit), "score", "entity")
    bundle = Bundle(rows, rank(C.DIRECT), rank(C.RELATED))
    if question and store.passages is not None:
        found = bm25(store.passages, question, "passage", "text", 4 * intent.limit)
        bundle.passages = two_stage(found, preferred, "passage", intent.limit) if preferred is not None else found.where(F.col("rank") <= intent.limit)
    if intent.comparison:
        values = store.values.where(F.col("subject").isin(list(intent.comparison.operands))).withColumn("v", F.coalesce(F.col("text"), F.concat_ws(" ", F.col("number").cast("string"), F.col("unit"))))
        bundle.comparison = C.compare(values, list(intent.comparison.operands), "subject", "property", "v")
    return bundle


def execute_branches(intent: Intent, registry: Registry, store: Store, **options) -> DataFrame:
    """The union of a question's alternatives; each row says which it answers."""
    out = None
    for branch in registry.branches(intent):
        tag = ";".join(f"{r.relation}={r.entity}" for r in branch.relations)
        rows = execute(branch, registry, store, **options).classified.select("entity", "classification", "score").withColumn("requested_group", F.lit(tag))
        out = rows if out is None else out.unionByName(rows)
    return out
