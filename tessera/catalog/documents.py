"""Validation of what was extracted from documents. Candidates and supports are made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog.registry import query
from tessera.operators import documents as D


def _cat(*parts):
    return F.concat(*[p if hasattr(p, "cast") else F.lit(p) for p in parts])


def _str(name: str):
    return F.col(name).cast("string")


def _pick(values, index):
    return F.get(F.array(*[v if hasattr(v, "cast") else F.lit(v) for v in values]), index.cast("int"))


_LIST = "list_filter([{0}], lambda x: x IS NOT NULL)"


def _oracle(table: str, id_col: str, errors: list[tuple[str, str]], doubts: list[tuple[str, str]]) -> str:
    array = lambda rules: _LIST.format(", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in rules))
    return f"WITH j AS (SELECT {id_col}, {array(errors)} AS errors, {array(doubts)} AS doubts FROM {table}) SELECT *, CASE WHEN len(errors) > 0 THEN 'REJECTED' WHEN len(doubts) > 0 THEN 'UNRESOLVED' ELSE 'SOURCE_SUPPORTED' END AS status FROM j"


@query(_oracle("part", "p_partkey", [("LABEL_NOT_IN_SUPPORT", "p_partkey % 5 = 1"), ("PLANNED_IS_NOT_RUN", "p_partkey % 2 = 0 AND p_partkey % 5 = 2"), ("NAME_OF_PERSON_OR_ORGANISATION", "p_partkey % 7 = 3")], [("CONDITION_WITHOUT_ITS_WORDS", "p_partkey % 2 = 1 AND p_partkey % 5 <> 3")]))
def entity_validation(t):
    """Entities against their support: label, planned runs, names of people, words of conditions."""
    k = F.col("p_partkey")
    label = _cat("E", _str("p_partkey"))
    support = _pick([_cat("Case ", label, " was run."), "Case X was run.", _cat("Case ", label, " is planned."), _cat("At low gravity ", label, " was run."), _cat(label, " burned.")], k % 5)
    e = t.part.select("p_partkey", F.when(k % 2 == 0, "ExperimentalRun").otherwise("GravityCondition").alias("class"), label.alias("label"), support.alias("support"))
    people = t.part.where("p_partkey % 7 = 3").select(F.lower(label).alias("name"))
    return D.judged_entities(e, people, {"GravityCondition": "gravity"}).select("p_partkey", "errors", "doubts", "status")


@query(_oracle("customer", "c_custkey", [("TEXT_NOT_LITERAL", "c_custkey % 4 = 1"), ("HEADING_IS_NO_STATEMENT", "c_custkey % 9 = 2"), ("ROLE_NOT_OF_CLASS", "c_custkey % 6 NOT IN (0, 2)"), ("CITED_WORK_AS_CURRENT", "c_custkey % 3 = 0 AND c_custkey % 5 = 0")], [("STUDY_UNKNOWN", "c_custkey % 3 = 1")]))
def statement_validation_branch(t):
    """Statements against their support: literal text, headings, roles of classes, work of others."""
    k = F.col("c_custkey")
    text = _cat("The sample of ", F.col("c_name"), " burned")
    s = t.customer.select(
        "c_custkey",
        _pick(["Observation", "Observation", "Conclusion", "Quantity", "Configuration", "Other"], k % 6).alias("class"),
        _pick(["measured_observation", "interpretation", "interpretation", "author_conclusion", "derived_quantity", "measured_observation"], k % 6).alias("role"),
        text.alias("text"),
        F.when(k % 4 == 1, "Nothing of the kind.").otherwise(_cat("Then:  the SAMPLE of\n", F.col("c_name"), " burned.")).alias("support"),
        F.when(k % 9 == 2, F.upper(text)).otherwise("Results").alias("heading"),
        _pick(["current", "unknown", "cited"], k % 3).alias("study"),
        (k % 5 == 0).alias("cited"),
    )
    return D.judged_statements(s).select("c_custkey", "errors", "doubts", "status")


@query(_oracle("orders", "o_orderkey", [("DIFFERENT_SOURCES", "o_orderkey % 10 = 9"), ("CLASSES_NOT_ALLOWED", "o_orderkey % 4 IN (2, 3)"), ("END_NOT_IN_SUPPORT", "o_orderkey % 7 = 4")], [("NO_WORD_FOR_RELATION", "o_orderkey % 4 IN (1, 2) OR o_orderkey % 7 = 4"), ("DENIED_OR_CONDITIONAL", "o_orderkey % 7 = 1")]))
def relation_validation(t):
    """Relations: sources, classes, ends and words in the support, denials."""
    k = F.col("o_orderkey")
    a, b = _cat("run R", _str("o_orderkey")), _cat("stuff S", _str("o_custkey"))
    support = F.when(k % 7 == 4, "Nothing is said.").when(k % 7 == 1, _cat(a, " was made of ", b, ", except once")).otherwise(_cat(a, " was made of ", b))
    r = t.orders.select("o_orderkey", _pick(["hasMaterial", "partOf", "partOf", "hasMaterial"], k % 4).alias("relation"), _pick(["Run", "Run", "Sample", "Sample"], k % 4).alias("subject_class"), _pick(["Material", "Group", "Group", "Group"], k % 4).alias("object_class"), F.lit("a").alias("subject_source"), F.when(k % 10 == 9, "b").otherwise("a").alias("object_source"), a.alias("subject_label"), b.alias("object_label"), support.alias("support"))
    return D.judged_relations(r, [("hasMaterial", "Run", "Material"), ("partOf", "Run", "Group")]).select("o_orderkey", "errors", "doubts", "status")


@query(_oracle("(SELECT *, l_orderkey * 10 + l_linenumber AS k FROM lineitem)", "l_orderkey, l_linenumber", [("VALUE_AND_UNIT_NOT_TOGETHER", "k % 6 = 1"), ("NAME_IS_THE_VALUE", "k % 6 = 2"), ("UNIT_OF_OTHER_DIMENSION", "k % 6 = 3")], [("UNIT_MISSING", "k % 6 = 4"), ("UNIT_UNKNOWN", "k % 6 = 5")]))
def quantity_validation(t):
    """Quantities: value and unit together, names that are values, dimensions, missing and unknown units."""
    k = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) % 6
    value = F.col("l_quantity").cast("int").cast("string")
    unit = F.when(k == 3, "s").when(k == 5, "furlong").when(k != 4, "mm")
    support = F.when(k == 1, _cat("It was ", value, " or so, in mm")).when(k == 4, _cat("It was ", value, " there")).otherwise(_cat("It was ", value, " ", unit, " there"))
    q = t.lineitem.select("l_orderkey", "l_linenumber", F.when(k == 2, value).otherwise("width").alias("name"), value.alias("expression"), unit.alias("unit"), support.alias("support"), F.lit("length").alias("name_dimension"))
    return D.judged_quantities(q, {"mm": "length", "m": "length", "s": "time"}).select("l_orderkey", "l_linenumber", "errors", "doubts", "status")


_CONTEXT = ["PREDICATE_WITHOUT_CONTEXT", "QUOTE_NOT_IN_SOURCE", "LIMITED_OR_CONDITIONAL", "UNVERIFIED", "UNKNOWN_SUBJECT", "NO_PATH", "PATH_TOO_LONG", "PATH_BROKEN", "UNKNOWN_RELATION", "UNKNOWN_ENDPOINT", "BASIS_NOT_APPROVED", "EDGE_NOT_IN_GRAPH", "PATH_MISSES_SCOPE"]


@query(f"SELECT c_custkey AS statement, {[*_CONTEXT, '-']}[c_custkey % 14 + 1] AS error FROM customer")
def context_statements(t):
    """Why context statements do not apply: each has one fault, or none."""
    c, run, nation, region = F.col("c_custkey") % 14, _cat("c", _str("c_custkey")), _cat("n", _str("c_nationkey")), F.lit("world")
    s = t.customer.select(
        F.col("c_custkey").alias("statement"),
        F.when(c == 4, "ghost").otherwise(run).alias("subject"),
        region.alias("scope_entity"),
        F.when(c == 0, "colour").otherwise("gravity").alias("relation"),
        F.when(c == 2, "SOME").otherwise("ALL").alias("quantifier"),
        F.lit(False).alias("conditions"),
        F.when(c == 3, "CANDIDATE").otherwise("EXPLICIT_LOCAL").alias("status"),
        F.lit("all tests").alias("quote"),
        F.when(c == 1, "nothing").otherwise("In all tests it burned.").alias("passage"),
    )
    step = lambda n, a, rel, b, basis: F.struct(F.lit(n).alias("step"), a.alias("source"), rel.alias("relation"), b.alias("target"), basis.alias("basis"))
    member, given = F.lit("in"), F.lit("NATIVE_GRAPH")
    first = step(1, F.when(c == 4, "ghost").otherwise(run), F.when(c == 8, "near").otherwise(member), nation, F.when(c == 10, "GUESS").otherwise(given))
    second = step(2, F.when(c == 7, "c0").otherwise(nation), member, F.when(c == 9, "nowhere").when(c == 11, _cat("n", ((F.col("c_nationkey") + 1) % 25).cast("string"))).when(c == 12, run).otherwise(region), given)
    more = F.when(c == 6, F.array(*[step(3 + i, region if i % 2 == 0 else nation, member, nation if i % 2 == 0 else region, given) for i in range(4)])).otherwise(F.array(first).cast("array<struct<step:int,source:string,relation:string,target:string,basis:string>>"))
    path = F.when(c == 6, F.concat(F.array(first, second), more)).when(c == 12, F.array(first, step(2, nation, member, run, given))).otherwise(F.array(first, second))
    steps = t.customer.where("c_custkey % 14 <> 5").select(F.col("c_custkey").alias("statement"), F.explode(path).alias("x")).select("statement", "x.*")
    entities = t.customer.select(run.alias("entity")).unionAll(t.nation.select(_cat("n", _str("n_nationkey")))).unionAll(t.spark.createDataFrame([("world",)], "entity string"))
    edges = t.customer.select(run.alias("subject"), member.alias("relation"), nation.alias("object")).unionAll(t.nation.select(_cat("n", _str("n_nationkey")), member, F.lit("world")))
    out = D.context_errors(s, steps, entities, edges.select("relation").distinct(), edges, ["gravity"])
    return out.select("statement", F.coalesce("error", F.lit("-")).alias("error"))


@query("SELECT p_partkey, ['-', 'EMPTY_OR_LONG', 'GROUPING_CHANGED', 'ANCHOR_CHANGED', 'ANCHOR_CHANGED', 'NAME_ADDED'][p_partkey % 6 + 1] AS error FROM part")
def expansion_errors(t):
    """Why expanded questions may not stand for the original."""
    n = _str("p_size")
    original = _cat("PMMA and cotton above ", n, " mm")
    forms = [_cat("acrylic sheets and cotton samples above ", n, " mm"), F.lit(" "), _cat("PMMA or cotton above ", n, " mm"), _cat("PMMA and cotton above ", n, "1 mm"), _cat("PMMA and wool above ", n, " mm"), _cat("PMMA and cotton in oxygen above ", n, " mm")]
    rows = t.part.select("p_partkey", original.alias("a"), _pick(forms, F.col("p_partkey") % 6).alias("b"))
    names = {"PMMA": ("acrylic",), "Cotton": (), "Oxygen": ("O2",)}
    return rows.select("p_partkey", F.coalesce(D.expansion_error("a", "b", names), F.lit("-")).alias("error"))


@query("""SELECT page_id, CASE WHEN NOT starts_with(url, 'https://') THEN 'NOT_HTTPS' WHEN NOT regexp_matches(lower(url), '^https://([^/:?#]+\\.)?example\\.(org|net)([/:?#]|$)') THEN 'DOMAIN_NOT_OFFICIAL' WHEN length(html) > 4000 THEN 'TOO_LARGE' ELSE '-' END AS error FROM pages""")
def citation_screen(t):
    """Which cited files are taken: scheme, domain and size."""
    e = D.citation_error(F.col("url"), F.length("html"), ["example.org", "example.net"], 4000)
    return t.pages.select("page_id", F.coalesce(e, F.lit("-")).alias("error"))


@query("""SELECT c_nationkey AS page, c_custkey AS line, 'Results ' || c_custkey AS text FROM customer WHERE c_custkey % 10 = 0""")
def layout_headings(t):
    """Lines that stand out of their page by size, and are no sentences."""
    k = F.col("c_custkey")
    text = F.when(k % 10 == 0, _cat("Results ", _str("c_custkey"))).when(k % 10 == 1, _cat("A large sentence on ", F.col("c_name"), ".")).otherwise(F.repeat(_cat("usual text of ", F.col("c_name"), " "), F.lit(4)))
    lines = t.customer.select(F.col("c_nationkey").alias("page"), k.alias("line"), text.alias("text"), F.when(k % 10 < 2, 14.0).otherwise(10.0).alias("size"))
    # A page without usual text has no usual size to stand out of.
    pages = lines.where("line % 10 > 1").select("page").distinct()
    return D.layout_headings(lines.join(pages, "page", "left_semi")).unionByName(lines.join(pages, "page", "left_anti").where("line % 10 = 0").select("page", "line", "text"))


@query("SELECT doc_id AS id FROM documents WHERE NOT (doc_id % 3 <> 0 AND doc_id % 5 <> 1 AND doc_id % 7 <> 2)")
def preparation_resume(t):
    """Documents that still need preparing under the present contract."""
    k = F.col("doc_id")
    sources = t.documents.select(k.alias("id"), F.md5(_str("n_chars")).alias("digest"))
    done = t.documents.where("doc_id % 3 <> 0").select(k.alias("id"), F.when(k % 5 == 1, F.md5(F.lit("old"))).otherwise(F.md5(_str("n_chars"))).alias("digest"), F.lit("v2").alias("contract"), F.when(k % 7 == 2, "FAILED").otherwise("DONE").alias("state"))
    older = t.documents.select(k.alias("id"), F.md5(_str("n_chars")).alias("digest"), F.lit("v1").alias("contract"), F.lit("DONE").alias("state"))
    return D.to_prepare(sources, done.unionAll(older), "v2").select("id")
