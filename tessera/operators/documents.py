"""Independent validation of what was extracted from documents, and the upkeep of their preparation."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import collapse, mentions
from tessera.operators.binding import key
from tessera.operators.extraction import hard_anchors
from tessera.operators.validation import reasons

#: Words by which a run is only planned (fixed values).
PLANNED = "planned|proposed|scheduled|cancelled|canceled|will be|to be conducted"
#: Which roles a class of statement may have (fixed values).
ROLES = {
    "Observation": ("measured_observation", "visual_observation"),
    "Conclusion": ("author_conclusion", "interpretation"),
    "Configuration": ("experimental_configuration",),
    "Quantity": ("reported_quantity", "derived_quantity"),
}
#: Words that state a relation (fixed values).
CUES = {"hasMaterial": "made of|material|consist(s|ed)? of|sample of", "partOf": "part of|belong(s|ed)? to|member of|in group", "performedIn": "performed|conducted|tested"}
#: Words that deny a relation or make it conditional (fixed values).
DENIALS = "not|never|without|except|instead of|rather than"


def settled(errors: Column, doubts: Column) -> Column:
    """REJECTED with errors, UNRESOLVED with doubts, else SOURCE_SUPPORTED."""
    return F.when(F.size(errors) > 0, "REJECTED").when(F.size(doubts) > 0, "UNRESOLVED").otherwise("SOURCE_SUPPORTED")


def _judged(rows: DataFrame, errors: dict[str, Column], doubts: dict[str, Column]) -> DataFrame:
    out = rows.withColumn("errors", reasons(errors)).withColumn("doubts", reasons(doubts))
    return out.withColumn("status", settled(F.col("errors"), F.col("doubts")))


def judged_entities(entities: DataFrame, people: DataFrame, conditions: dict[str, str]) -> DataFrame:
    """Adds errors, doubts and status to entities (class, label, support): the label must be in its support, a planned
    run is no run, a name of a person or organisation (people: name) is no entity, and a kind of condition needs its own
    words (conditions: class -> pattern) in the support."""
    known = people.select(key("name").alias("_k")).distinct().withColumn("_person", F.lit(True))
    rows = entities.withColumn("_k", key("label")).join(known, "_k", "left")
    worded = F.lit(True)
    for name, pattern in conditions.items():
        worded = F.when(F.col("class") == name, F.col("support").rlike(f"(?i){pattern}")).otherwise(worded)
    errors = {
        "LABEL_NOT_IN_SUPPORT": ~mentions(collapse("support"), F.lower(collapse("label"))),
        "PLANNED_IS_NOT_RUN": (F.col("class") == "ExperimentalRun") & F.col("support").rlike(f"(?i)\\b({PLANNED})\\b"),
        "NAME_OF_PERSON_OR_ORGANISATION": F.coalesce("_person", F.lit(False)),
    }
    return _judged(rows, errors, {"CONDITION_WITHOUT_ITS_WORDS": ~worded}).drop("_k", "_person")


def judged_statements(statements: DataFrame) -> DataFrame:
    """Adds errors, doubts and status to statements (class, role, text, support, heading, study, cited): a literal
    passage that is no heading, a role that its class allows, and no work of others as the source's own."""
    allowed = F.lit(False)
    for name, roles in ROLES.items():
        allowed = allowed | ((F.col("class") == name) & F.col("role").isin(*roles))
    errors = {
        "TEXT_NOT_LITERAL": ~F.contains(key("support"), key("text")),
        "HEADING_IS_NO_STATEMENT": key("text") == key("heading"),
        "ROLE_NOT_OF_CLASS": ~allowed,
        "CITED_WORK_AS_CURRENT": (F.col("study") == "current") & F.col("cited"),
    }
    return _judged(statements, errors, {"STUDY_UNKNOWN": F.col("study") == "unknown"})


def judged_relations(relations: DataFrame, matrix: list[tuple[str, str, str]]) -> DataFrame:
    """Adds errors, doubts and status to relations (relation, subject_class, object_class, subject_source, object_source,
    subject_label, object_label, support): one source, classes that the matrix allows, both ends and a word for the
    relation in the support, and no denial."""
    allowed, cue = F.lit(False), F.lit(False)
    for relation, domain, target in matrix:
        allowed = allowed | ((F.col("relation") == relation) & (F.col("subject_class") == domain) & (F.col("object_class") == target))
    for relation, words in CUES.items():
        cue = cue | ((F.col("relation") == relation) & F.col("support").rlike(f"(?i)\\b({words})\\b"))
    support = collapse("support")
    errors = {
        "DIFFERENT_SOURCES": F.col("subject_source") != F.col("object_source"),
        "CLASSES_NOT_ALLOWED": ~allowed,
        "END_NOT_IN_SUPPORT": ~(mentions(support, F.lower(collapse("subject_label"))) & mentions(support, F.lower(collapse("object_label")))),
    }
    return _judged(relations, errors, {"NO_WORD_FOR_RELATION": ~cue, "DENIED_OR_CONDITIONAL": F.col("support").rlike(f"(?i)\\b({DENIALS})\\b")})


def judged_quantities(quantities: DataFrame, dimensions: dict[str, str]) -> DataFrame:
    """Adds errors, doubts and status to quantities (name, expression, unit, support, name_dimension): value and unit side
    by side in the support, a name that is no value, a unit (dimensions: unit -> dimension) of the name's dimension; a
    missing unit is a doubt."""
    escape = lambda c: F.regexp_replace(c, "([\\\\.^$|?*+()\\[\\]{}-])", "\\\\$1")
    unit = F.coalesce("unit", F.lit(""))
    side = F.regexp_like(F.col("support"), F.concat(F.lit("(?<![\\w.])"), escape(F.col("expression")), F.lit("\\s*-?\\s*"), escape(unit), F.lit("(?![\\p{L}\\p{N}])")))
    kinds = F.create_map(*[F.lit(x) for kv in dimensions.items() for x in kv])
    dimension = F.try_element_at(kinds, unit)
    errors = {
        "VALUE_AND_UNIT_NOT_TOGETHER": ~side,
        "NAME_IS_THE_VALUE": key("name") == key("expression"),
        "UNIT_OF_OTHER_DIMENSION": F.col("name_dimension").isNotNull() & dimension.isNotNull() & (dimension != F.col("name_dimension")),
    }
    return _judged(quantities, errors, {"UNIT_MISSING": F.col("unit").isNull(), "UNIT_UNKNOWN": F.col("unit").isNotNull() & dimension.isNull()})


#: Bases on which a membership step may rest (fixed values).
BASES = ("NATIVE_GRAPH", "EXPLICIT_SOURCE_IDENTITY")


def context_errors(statements: DataFrame, steps: DataFrame, entities: DataFrame, relations: DataFrame, edges: DataFrame, dimensions: list[str], most: int = 5) -> DataFrame:
    """(statement, error): the first reason why a context statement does not apply, null if it does.

    statements: statement, subject, scope_entity, relation, quantifier, conditions, status, quote, passage; steps of the
    path from subject to scope: statement, step, source, relation, target, basis; edges: subject, relation, object.
    """
    w = Window.partitionBy("statement").orderBy("step")
    known = entities.select("entity").distinct()
    ends = known.select(F.col("entity").alias("target"), F.lit(True).alias("_target"))
    named = relations.select("relation", F.lit(True).alias("_relation")).distinct()
    either = edges.select("subject", "relation", "object").unionAll(edges.select("object", "relation", "subject")).distinct()
    native = either.select(F.col("subject").alias("source"), "relation", F.col("object").alias("target"), F.lit(True).alias("_edge"))
    s = steps.join(ends, "target", "left").join(named, "relation", "left").join(native, ["source", "relation", "target"], "left")
    s = s.withColumn("_before", F.lag("target").over(w))
    yes = lambda c: F.coalesce(c, F.lit(False))
    per = s.groupBy("statement").agg(
        F.count("*").alias("_n"),
        F.min_by("source", "step").alias("_first"),
        F.max_by("target", "step").alias("_last"),
        F.bool_or(F.col("_before").isNotNull() & (F.col("_before") != F.col("source"))).alias("_broken"),
        F.bool_or(F.col("_relation").isNull()).alias("_unnamed"),
        F.bool_or(F.col("_target").isNull()).alias("_lost"),
        F.bool_or(~F.col("basis").isin(*BASES)).alias("_base"),
        F.bool_or((F.col("basis") == "NATIVE_GRAPH") & F.col("_edge").isNull()).alias("_absent"),
    )
    rows = statements.join(per, "statement", "left").join(known.select(F.col("entity").alias("subject"), F.lit(True).alias("_subject")), "subject", "left")
    rules = [
        (~F.col("relation").isin(dimensions), "PREDICATE_WITHOUT_CONTEXT"),
        (~F.contains(F.coalesce("passage", F.lit("")), F.col("quote")), "QUOTE_NOT_IN_SOURCE"),
        (~F.col("quantifier").isin("ALL", "IDENTIFIED") | yes(F.col("conditions")), "LIMITED_OR_CONDITIONAL"),
        (~F.col("status").isin("EXPLICIT_LOCAL", "VERIFIED_APPLICABLE_CONTEXT"), "UNVERIFIED"),
        (F.col("_subject").isNull(), "UNKNOWN_SUBJECT"),
        (F.col("_n").isNull(), "NO_PATH"),
        (F.col("_n") > most, "PATH_TOO_LONG"),
        (yes(F.col("_broken")) | (F.col("_first") != F.col("subject")), "PATH_BROKEN"),
        (yes(F.col("_unnamed")), "UNKNOWN_RELATION"),
        (yes(F.col("_lost")), "UNKNOWN_ENDPOINT"),
        (yes(F.col("_base")), "BASIS_NOT_APPROVED"),
        (yes(F.col("_absent")), "EDGE_NOT_IN_GRAPH"),
        (F.col("_last") != F.col("scope_entity"), "PATH_MISSES_SCOPE"),
    ]
    error = F.lit(None).cast("string")
    for broken, name in reversed(rules):
        error = F.when(yes(broken), name).otherwise(error)
    return rows.select("statement", error.alias("error"))


def expansion_error(original: Column | str, expanded: Column | str, names: dict[str, tuple[str, ...]], most: int = 500) -> Column:
    """Why an expanded question may not stand for the original, null if it may: EMPTY_OR_LONG, GROUPING_CHANGED, the
    anchors of ANCHOR_CHANGED, or NAME_ADDED where a registered name (id -> aliases) turns up that was not asked for."""

    def has(text: str, aliases: tuple[str, ...]) -> bool:
        return any(re.search(rf"(?<!\w){re.escape(a)}(?!\w)", text, re.I) for a in aliases)

    def why(a: str, b: str) -> str | None:
        if not b.strip() or len(b) > most:
            return "EMPTY_OR_LONG"
        if re.findall(r"\b(?:and|or)\b|[()]", a.lower()) != re.findall(r"\b(?:and|or)\b|[()]", b.lower()):
            return "GROUPING_CHANGED"
        if hard_anchors(a) != hard_anchors(b) or any(has(a, (i, *s)) and not has(b, (i, *s)) for i, s in names.items()):
            return "ANCHOR_CHANGED"
        return "NAME_ADDED" if any(has(b, (i, *s)) and not has(a, (i, *s)) for i, s in names.items()) else None

    @F.pandas_udf("string")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([why(a or "", b or "") for a, b in zip(x, y, strict=True)], dtype=object)

    return run(original, expanded)


def citation_error(url: Column, size: Column, domains: list[str], most: int = 50 * 1024 * 1024) -> Column:
    """Why a cited file is not taken: NOT_HTTPS, DOMAIN_NOT_OFFICIAL or TOO_LARGE; null if it is."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[a-z]+://([^/:?#]+)", 1))
    official = F.lit(False)
    for d in domains:
        official = official | (host == d) | F.endswith(host, F.lit("." + d))
    return F.when(~F.startswith(F.coalesce(url, F.lit("")), F.lit("https://")), "NOT_HTTPS").when(~official, "DOMAIN_NOT_OFFICIAL").when(size > most, "TOO_LARGE")


def layout_headings(lines: DataFrame, ratio: float = 1.15, most: int = 120) -> DataFrame:
    """(page, line, text) of lines (page, line, text, size) that stand out: larger than the page's usual size by the
    ratio, short, and no sentence. The usual size is that of most characters, the smaller of two."""
    per = lines.groupBy("page", "size").agg(F.sum(F.length("text")).alias("_n"))
    usual = per.groupBy("page").agg(F.max_by("size", F.struct("_n", -F.col("size"))).alias("_usual"))
    fit = (F.col("size") >= F.col("_usual") * ratio) & (F.length("text") <= most) & ~F.col("text").rlike("[.!?;,]\\s*$") & F.col("text").rlike("\\p{L}")
    return lines.join(usual, "page").where(fit).select("page", "line", "text")


def to_prepare(sources: DataFrame, done: DataFrame, contract: str) -> DataFrame:
    """Sources (id, digest) that no finished preparation (id, digest, contract, state) under this contract covers: those
    that are new, changed or failed. Run again after a loss, what was finished is not done twice."""
    fine = done.where((F.col("contract") == contract) & (F.col("state") == "DONE")).select("id", "digest").distinct()
    return sources.join(fine, ["id", "digest"], "left_anti")
