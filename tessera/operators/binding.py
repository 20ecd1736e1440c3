"""What a source's words bind: values to subjects, statements to studies, names to groups, figures to captions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import collapse, mentions
from tessera.operators.extraction import respectively

#: Where a clause ends: semicolons, blank lines and sentence ends that no digit follows.
CLAUSE = ";|\\n\\s*\\n|[.!?](?![0-9])(?=\\s|$)"
#: Words of sections that report a source's own work, and of sections that do not (fixed values).
OWN_SECTIONS = "results?|discussion|conclusions?|methods?|experimental|tests?|testing|verification|disassembly|inspection|analysis"
OTHER_SECTIONS = "prior|historical|literature|background|introduction|references"
#: Words by which a text speaks of the work of others (fixed values).
OTHER_WORK = "prior|previous|earlier|historical|reported by|according to"
#: Words that say that a value was not read off but worked out (fixed values).
DERIVED = "calculated|computed|estimated|assumed|derived|predicted|best fit|least squares fit"
#: Classes that a quantity may describe (fixed values).
SCOPES = ("Investigation", "ExperimentFamily", "ExperimentalRun", "Sample")
#: Beginnings by which a sentence points back at a study (fixed values).
POINTERS = "^\\s*(the|these|our)\\s+(results|data|findings|experiments|tests)\\b"


def key(label: Column | str) -> Column:
    """A label for comparison: white space and case apart."""
    return F.lower(collapse(label))


def _words(text: Column | str) -> Column:
    return F.regexp_extract_all(key(text), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def named_in(texts: DataFrame, text_col: str, by: list[str], entities: DataFrame) -> DataFrame:
    """Rows of texts beside each entity (by.., entity, label, ..) whose label they mention as whole words.

    Candidates come from an equality join on a label's longest word, as shorter ones tell less; the exact test follows.
    """
    longest = F.array_max(F.transform(_words("label"), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    opened = texts.withColumn("_word", F.explode(F.array_distinct(_words(text_col))))
    found = opened.join(entities.withColumn("_word", longest), [*by, "_word"])
    return found.where(mentions(collapse(text_col), F.lower(collapse("label")))).drop("_word")


def local_binding(claims: DataFrame, entities: DataFrame) -> DataFrame:
    """Adds bound to claims (claim, source, subject, label, class, value, quote): whether a clause names the subject and
    the value and no other entity of the subject's class, so that no result passes between subjects of one clause."""
    clauses = claims.select("claim", "source", "subject", F.col("label").alias("_label"), "class", "value", F.posexplode(F.split("quote", CLAUSE)).alias("_at", "_clause"))
    own = clauses.where(mentions(collapse("_clause"), key("_label")) & mentions(collapse("_clause"), key("value")))
    rivals = entities.select("source", "class", F.col("entity").alias("_other"), "label")
    named = named_in(own, "_clause", ["source", "class"], rivals).where((F.col("_other") != F.col("subject")) & (key("label") != key("_label")))
    bound = own.select("claim", "_at").join(named.select("claim", "_at"), ["claim", "_at"], "left_anti").select("claim").distinct()
    return claims.join(bound.withColumn("_b", F.lit(True)), "claim", "left").withColumn("bound", F.coalesce("_b", F.lit(False))).drop("_b")


def original_research(section: Column, text: Column) -> Column:
    """Whether a passage of this section reports the source's own work."""
    own = section.rlike(f"(?i)\\b({OWN_SECTIONS})\\b") & ~section.rlike(f"(?i)\\b({OTHER_SECTIONS})\\b")
    cites = text.rlike(f"(?i)\\b({OTHER_WORK})\\b") | text.rlike("\\[[0-9]") | text.rlike("\\b[A-Z][a-z]+ et al\\b")
    return F.coalesce(own & ~cites, F.lit(False))


def conclusion(section: Column, text: Column) -> Column:
    """Whether a passage is among a source's own conclusions."""
    cites = text.rlike("(?i)\\b(prior|previous|earlier|reported by)\\b") | text.rlike("\\[[0-9]")
    return F.coalesce(section.rlike("(?i)conclusions?") & ~cites, F.lit(False))


def scope_of_statements(spans: DataFrame, by: str, section: str, text: str) -> DataFrame:
    """Per statement: DOCUMENT if all its spans are original research, CONCLUSION if one at least is the source's own
    conclusion, else UNRESOLVED."""
    own = F.bool_and(original_research(F.col(section), F.col(text)))
    last = F.bool_or(conclusion(F.col(section), F.col(text)))
    return spans.groupBy(by).agg(own.alias("_own"), last.alias("_last")).select(by, F.when(F.col("_own"), "DOCUMENT").when(F.col("_last"), "CONCLUSION").otherwise("UNRESOLVED").alias("scope"))


def measured_in_model(section: Column, role: Column) -> Column:
    """A measured role in a section about models or analysis needs a review."""
    return F.coalesce(section.rlike("(?i)\\b(models?|modeling|modelling|analys[ei]s|simulations?|numerical)\\b") & role.isin("measured_observation", "reported_quantity"), F.lit(False))


def antecedents(spans: DataFrame, entities: DataFrame) -> DataFrame:
    """(span, entity) for spans (span, source, before, quote) that point back at a study: the one investigation that the
    paragraph names before them, if it is one. A name that another one extends by its role (`X` in `X project`) gives
    way to it."""
    pointing = spans.where(F.lower("quote").rlike(POINTERS))
    named = named_in(pointing, "before", ["source"], entities.where(F.col("class") == "Investigation"))
    longer = named.select("span", F.regexp_replace(key("label"), " (project|study|investigation|experiment)$", "").alias("_stem"), key("label").alias("_full")).where("_stem <> _full")
    named = named.withColumn("_stem", key("label")).join(longer.select("span", "_stem").distinct(), ["span", "_stem"], "left_anti")
    return named.groupBy("span").agg(F.countDistinct("entity").alias("_n"), F.min("entity").alias("entity")).where("_n = 1").select("span", "entity")


def quantity_scope(entities: DataFrame, ancestry: DataFrame, condition: str = "ExperimentalCondition", barred: str = "GravityCondition") -> DataFrame:
    """Adds eligible to entities (entity, class): a class that quantities describe, or a kind of condition but gravity.
    ancestry(descendant, ancestor) is closed."""
    of = lambda top: ancestry.where(F.col("ancestor") == top).select(F.col("descendant").alias("class")).unionAll(entities.sparkSession.createDataFrame([(top,)], "class string")).distinct()
    out = entities.join(of(condition).withColumn("_c", F.lit(True)), "class", "left").join(of(barred).withColumn("_g", F.lit(True)), "class", "left")
    return out.withColumn("eligible", F.col("class").isin(*SCOPES) | (F.coalesce("_c", F.lit(False)) & ~F.coalesce("_g", F.lit(False)))).drop("_c", "_g")


def single_scope(candidates: DataFrame, by: str, group: str) -> DataFrame:
    """(span, group) where exactly one group is a candidate; other spans keep no scope."""
    return candidates.groupBy(by).agg(F.countDistinct(group).alias("_n"), F.min(group).alias(group)).where("_n = 1").select(by, group)


def qualified_heading(label: Column, materials: list[str]) -> Column:
    """Whether a heading qualifies a material (a result, a comparison, a test of it) and so names none."""
    said = label.rlike("(?i):|\\b(results?|comparison|tests?|experiments?)\\b")
    before = label.contains(":") & F.substring_index(label, ":", 1).rlike("(?i)\\b(results?|comparison|tests?|experiments?|groups?|series|recap)\\b")
    known = F.lit(False)
    for m in materials:
        known = known | (mentions(label, F.lit(m)) & (key(label) != m.lower()))
    return F.coalesce(said & (before | known), F.lit(False))


def bind_values(clauses: DataFrame, id_col: str, clause_col: str, names_col: str) -> DataFrame:
    """(id, name, value) of clauses: by position where they say `respectively`, else each value with the nearest name."""
    kind = dict(clauses.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, n, v) for i, c, names in zip(b["_id"], b["_c"], b["_n"], strict=True) if c is not None for n, v in respectively(c, list(names))]
            yield pd.DataFrame(rows, columns=["_id", "name", "value"])

    rows = clauses.select(F.col(id_col).cast("string").alias("_id"), F.col(clause_col).alias("_c"), F.coalesce(names_col, F.array().cast("array<string>")).alias("_n"))
    return rows.mapInPandas(run, "_id string, name string, value string").withColumn("_id", F.col("_id").cast(kind)).withColumnRenamed("_id", id_col)


def derivation(label: Column, value: Column, quote: Column) -> Column:
    """Whether the words between a variable's last name before a value and the value, or right before that name, say
    that it was worked out; a denied word, or one of an earlier sentence, does not count."""
    escape = lambda c: F.regexp_replace(c, "([\\\\.^$|?*+()\\[\\]{}-])", "\\\\$1")
    clause = F.coalesce(F.element_at(F.filter(F.split(quote, CLAUSE), lambda c: mentions(c, value) & mentions(c, label)), 1), F.lit(""))
    extract = lambda c, pattern, group: F.call_function("regexp_extract", c, pattern, F.lit(group))
    upto = extract(clause, F.concat(F.lit("(?is)^(.*?)(?<![\\w.])"), escape(value), F.lit("(?![\\w.])")), 1)
    near = extract(upto, F.concat(F.lit("(?is)^.*?((?:\\S+\\s+){0,4})(?<!\\w)"), escape(label), F.lit("(?!\\w)((?:(?!(?<!\\w)"), escape(label), F.lit("(?!\\w)).)*)$")), 2)
    ahead = extract(upto, F.concat(F.lit("(?is)((?:\\S+\\s+){0,3})(?<!\\w)"), escape(label), F.lit("(?!\\w)(?:(?!(?<!\\w)"), escape(label), F.lit("(?!\\w)).)*$")), 1)
    denied = f"(?i)\\b(not|rather than|instead of)\\s+({DERIVED})\\b"
    plain = lambda c: F.regexp_replace(c, denied, "")
    return F.coalesce(plain(near).rlike(f"(?i)\\b({DERIVED})\\b") | plain(ahead).rlike(f"(?i)\\b({DERIVED})\\s+$"), F.lit(False))


def offered_entities(entities: DataFrame, text: Column, broad: tuple[str, ...] = ("Investigation", "ExperimentFamily"), limit: int = 40) -> DataFrame:
    """The supported entities that a later step may use, per source: those that its text names first, then broad
    classes, then by key; at most `limit` of a source."""
    named = mentions(collapse(text), F.lower(collapse("label")))
    order = Window.partitionBy("source").orderBy((~F.col("_local")).cast("int"), (~F.col("class").isin(*broad)).cast("int"), "entity")
    rows = entities.where("status = 'SOURCE_SUPPORTED'").withColumn("_local", F.coalesce(named, F.lit(False))).where(F.col("_local") | (F.col("class") == "Investigation"))
    return rows.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit).withColumnRenamed("_local", "named")


def figure_support(spans: DataFrame, captions: DataFrame, groups: DataFrame) -> DataFrame:
    """(span, entity) of spans whose figures all have one caption that names the group in its first line and neither
    cites nor names another group. spans: span, source, quote; captions: source, number, caption; groups: source, entity,
    label."""
    refs = spans.select("span", "source", F.explode(F.array_distinct(F.regexp_extract_all("quote", F.lit("(?i)\\b(?:Figures?|Figs?\\.?)\\s+([0-9]+)\\b"), F.lit(1)))).alias("number"))
    one = captions.groupBy("source", "number").agg(F.count("*").alias("_n"), F.min("caption").alias("caption"))
    seen = refs.join(one, ["source", "number"], "left")
    fit = named_in(one.where("_n = 1").where(~F.col("caption").rlike("(?i)\\[[0-9]|\\b(reproduced|adapted|prior|previous)\\b")), "caption", ["source"], groups)
    fit = fit.withColumn("_groups", F.count("*").over(Window.partitionBy("source", "number"))).where("_groups = 1")
    first = mentions(F.substring_index("caption", "\n", 1), F.get(_words("label"), F.lit(0)))
    fit = fit.where(first).select("source", "number", "entity")
    joined = seen.join(fit, ["source", "number"], "left")
    per = joined.groupBy("span").agg(F.count("*").alias("_refs"), F.count("entity").alias("_fits"), F.countDistinct("entity").alias("_n"), F.min("entity").alias("entity"))
    return per.where("_refs = _fits AND _n = 1").select("span", "entity")


def condition_binding(asked: DataFrame, stated: DataFrame, members: DataFrame) -> DataFrame:
    """Adds binding to asked (run, value): SUPPORTED, CONTRADICTED or UNKNOWN by what a source states.

    stated: entity, value, exceptions (array of runs); members: run, entity. A statement for the run itself beats those
    for a group that it belongs to, a run that a group's statement excepts is not meant by it, and values that differ
    at the same level leave the matter open.
    """
    local = stated.select(F.col("entity").alias("run"), F.col("value").alias("_v"), F.lit(1).alias("_level"))
    shared = members.join(stated, "entity").where(~F.array_contains(F.coalesce("exceptions", F.array().cast("array<string>")), F.col("run"))).select("run", F.col("value").alias("_v"), F.lit(0).alias("_level"))
    of = local.unionAll(shared).groupBy("run", "_level").agg(F.countDistinct("_v").alias("_n"), F.min("_v").alias("_v"))
    best = of.groupBy("run").agg(F.max_by(F.struct("_n", "_v"), "_level").alias("_b"))
    out = asked.join(best, "run", "left")
    binding = F.when(F.col("_b").isNull() | (F.col("_b._n") > 1), "UNKNOWN").when(F.col("_b._v") == F.col("value"), "SUPPORTED").otherwise("CONTRADICTED")
    return out.withColumn("binding", binding).drop("_b")


def acronyms(entities: DataFrame) -> DataFrame:
    """(source, acronym, entity) of acronyms in brackets that one label of a source only has: for review, no alias."""
    found = entities.select("source", "entity", F.explode(F.array_distinct(F.regexp_extract_all("label", F.lit("\\(([A-Z][A-Z0-9-]{1,9})\\)"), F.lit(1)))).alias("acronym"))
    return found.groupBy("source", "acronym").agg(F.countDistinct("entity").alias("_n"), F.min("entity").alias("entity")).where("_n = 1").select("source", "acronym", "entity")


def concept_review(concepts: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds status and review to concepts (term): never accepted by itself; a term with a registered alias asks for
    reuse, another for an extension."""
    known = aliases.select(key("alias").alias("_k")).distinct().withColumn("_known", F.lit(True))
    out = concepts.withColumn("_k", key("term")).join(known, "_k", "left")
    return out.withColumn("status", F.lit("UNRESOLVED")).withColumn("review", F.when(F.col("_known"), "REUSE").otherwise("EXTENSION")).drop("_k", "_known")


def parsed_items(raw: DataFrame, id_col: str, text_col: str, schema: str, required: list[str]) -> DataFrame:
    """(id, position, item, error) of the objects of JSON arrays, each judged alone: INVALID_JSON, DUPLICATE_FIELD,
    MISSING_FIELD or null. An array that breaks off keeps the whole objects before the break. Objects are flat."""
    objects = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit("\\{[^{}]*\\}"), F.lit(0))
    rows = raw.select(id_col, F.posexplode(objects).alias("position", "_o"))
    rows = rows.withColumn("_j", F.from_json("_o", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}))
    fields = F.regexp_extract_all("_o", F.lit('"([^"]*)"\\s*:'), F.lit(1))
    missing = F.lit(False)
    for f in required:
        missing = missing | F.col(f"_j.{f}").isNull()
    error = F.when(F.col("_j._corrupt").isNotNull(), "INVALID_JSON").when(F.size(fields) > F.size(F.array_distinct(fields)), "DUPLICATE_FIELD").when(missing, "MISSING_FIELD")
    names = [re.split(r"\s+", c.strip())[0] for c in schema.split(",")]
    return rows.withColumn("error", error).select(id_col, "position", F.when(F.col("error").isNull(), F.struct(*[F.col(f"_j.{n}").alias(n) for n in names])).alias("item"), "error")


def support_errors(claims: DataFrame, cited: DataFrame, passages: DataFrame) -> DataFrame:
    """(claim, error) for claims that cite evidence (claim, ref): UNKNOWN_EVIDENCE if a passage (ref, source) is missing,
    CROSS_DOCUMENT if passages come of several sources, NO_EVIDENCE without a citation."""
    found = cited.join(passages.select("ref", "source"), "ref", "left").groupBy("claim").agg(F.count_if(F.col("source").isNull()).alias("_gone"), F.countDistinct("source").alias("_n"))
    out = claims.select("claim").join(found, "claim", "left")
    error = F.when(F.col("_gone").isNull(), "NO_EVIDENCE").when(F.col("_gone") > 0, "UNKNOWN_EVIDENCE").when(F.col("_n") > 1, "CROSS_DOCUMENT")
    return out.select("claim", error.alias("error")).where("error IS NOT NULL")

