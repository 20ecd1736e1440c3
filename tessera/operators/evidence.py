"""Evidence: context resolution, sufficiency, verification of claims and of selected statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How local a statement's scope is (fixed values).
SCOPE_RANKS = {"local": 3, "execution": 3, "run": 3, "group": 2, "campaign": 1, "document": 0}
#: States of an information requirement, strongest first.
STATES = ("CONFLICTED", "SUPPORTED", "PARTIALLY_SUPPORTED", "RELATED_ONLY", "MISSING")


def scope_rank(scope: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SCOPE_RANKS.items() for x in kv]), scope), F.lit(0))


def resolve_scope(statements: DataFrame, entity: str = "entity", kind: str = "context_type", value: str = "value", scope: str = "scope", status: str = "status", exception: str = "is_exception", conflict: str = "has_conflict") -> DataFrame:
    """Per entity and context type the value that the most local authoritative statements agree on.

    An unresolved conflict or disagreement at the best scope is CONFLICTED; statements that except the entity do not
    apply, and only they are NOT_APPLICABLE; without authoritative statements there are only candidates.
    """
    authoritative = ~F.col(exception) & F.col(status).isin("EXPLICIT_LOCAL", "VERIFIED_APPLICABLE_CONTEXT")
    s = statements.withColumn("_ok", authoritative).withColumn("_rank", F.when(authoritative, scope_rank(F.col(scope))))
    best = s.groupBy(entity, kind).agg(
        F.bool_or(~F.col(exception) & (F.col(status) == "CONFLICTED")).alias("_open"),
        F.bool_or(exception).alias("_excepted"),
        F.max("_rank").alias("_best"),
        # Values by scope rank: there are only four ranks, so the group stays small.
        *[F.array_sort(F.collect_set(F.when(F.col("_rank") == r, F.col(value)))).alias(f"_v{r}") for r in range(4)],
        *[F.bool_or((F.col("_rank") == r) & F.col(conflict)).alias(f"_c{r}") for r in range(4)],
        *[F.bool_or((F.col("_rank") == r) & (F.col(status) == "EXPLICIT_LOCAL")).alias(f"_l{r}") for r in range(4)],
    )
    pick = lambda p: F.coalesce(*[F.when(F.col("_best") == r, F.col(f"{p}{r}")) for r in range(4)])
    values = pick("_v")
    state = (
        F.when(F.col("_open"), "CONFLICTED")
        .when(F.col("_best").isNull() & F.col("_excepted"), "NOT_APPLICABLE")
        .when(F.col("_best").isNull(), "CONTEXTUAL_CANDIDATE")
        .when((F.size(values) > 1) | F.coalesce(pick("_c"), F.lit(False)), "CONFLICTED")
        .when(F.coalesce(pick("_l"), F.lit(False)), "EXPLICIT_LOCAL")
        .otherwise("VERIFIED_APPLICABLE_CONTEXT")
    )
    out = best.select(entity, kind, state.alias("status"), values.alias("_values"))
    settled = F.col("status").isin("EXPLICIT_LOCAL", "VERIFIED_APPLICABLE_CONTEXT")
    return out.select(entity, kind, "status", F.when(settled, F.get("_values", F.lit(0))).alias("value"))


def sufficiency(items: DataFrame, requirements: DataFrame, key: str, state: str) -> DataFrame:
    """The strongest state of each requirement's items and how many hold it; MISSING without items."""
    rank = F.coalesce(*[F.when(F.col(state) == s, F.lit(i)) for i, s in enumerate(STATES)])
    best = items.withColumn("_r", rank).groupBy(key, "_r").agg(F.count("*").alias("n_items"))
    best = best.groupBy(key).agg(F.min(F.struct("_r", "n_items")).alias("_b"))
    names = F.array(*[F.lit(s) for s in STATES])
    joined = requirements.join(best, key, "left")
    return joined.select(key, F.coalesce(F.get(names, F.col("_b._r")), F.lit("MISSING")).alias("state"), F.coalesce("_b.n_items", F.lit(0).cast("long")).alias("n_items"))


def verify_claims(claims: DataFrame, passages: DataFrame, claim: str, quote: str, reference: str, text: str, direct: Column, conflicted: Column) -> DataFrame:
    """Per claim (one row per cited reference): INSUFFICIENT_EVIDENCE if a reference is unknown, UNSUPPORTED if a quote
    is not in its passage or its scope is conflicted, SUPPORTED_WITH_LIMITATIONS if not direct, else SUPPORTED."""
    clean = lambda c: F.lower(F.trim(F.regexp_replace(c, "\\s+", " ")))
    j = claims.join(passages.select(F.col(reference), F.col(text).alias("_text")), reference, "left")
    j = j.select(claim, F.col("_text").isNull().alias("_gone"), F.coalesce(F.contains(clean(F.col("_text")), clean(F.col(quote))), F.lit(False)).alias("_in"), direct.alias("_direct"), conflicted.alias("_conflict"))
    s = j.groupBy(claim).agg(F.bool_or("_gone").alias("g"), F.every("_in").alias("i"), F.every("_direct").alias("d"), F.bool_or("_conflict").alias("c"))
    status = F.when(F.col("g"), "INSUFFICIENT_EVIDENCE").when(~F.col("i") | F.col("c"), "UNSUPPORTED").when(~F.col("d"), "SUPPORTED_WITH_LIMITATIONS").otherwise("SUPPORTED")
    return s.select(claim, status.alias("status"))


def outside(claims: DataFrame, allowed: DataFrame, reference: str) -> DataFrame:
    """Citations that the bundle does not hold."""
    return claims.join(allowed.select(reference).distinct(), reference, "left_anti")


def select_claims(claims: DataFrame, group: str, dedupe: list[str], order: list[Column], budget: int) -> DataFrame:
    """Claims without repeats, numbered within their group, with whether they are within the budget."""
    from pyspark.sql import Window

    first = claims.withColumn("_n", F.row_number().over(Window.partitionBy(group, *dedupe).orderBy(*order))).where("_n = 1").drop("_n")
    numbered = first.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return numbered.withColumn("selected", F.col("position") <= budget)
