"""Binding and scope: values to subjects, statements to studies, figures to groups. Texts are made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog.registry import query
from tessera.operators import binding as B
from tessera.operators import graph as G


def _text(*parts):
    """Strings and columns joined into a text."""
    return F.concat(*[p if hasattr(p, "cast") else F.lit(p) for p in parts])


def _col(name: str):
    return F.col(name).cast("string")


@query("""SELECT c_custkey AS claim, CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN NOT EXISTS (SELECT 1 FROM customer o WHERE o.c_custkey = c.c_custkey + 1 AND o.c_nationkey = c.c_nationkey) ELSE false END AS bound FROM customer c""")
def local_binding(t):
    """Whether a clause gives a value to its subject and to no other of its class."""
    k, v, other = F.col("c_custkey"), _text((F.col("c_custkey") % 90 + 10).cast("string"), " mm"), (F.col("c_custkey") + 1).cast("string")
    quote = F.when(k % 3 == 0, _text("run C", _col("c_custkey"), " measured ", v, "; run C", other, " measured 5 mm")).when(k % 3 == 1, _text("run C", _col("c_custkey"), " and run C", other, " measured ", v)).otherwise(_text("run C", _col("c_custkey"), " failed. it measured ", v))
    entities = t.customer.select(F.col("c_nationkey").alias("source"), _text("c", _col("c_custkey")).alias("entity"), F.lit("Run").alias("class"), _text("run C", _col("c_custkey")).alias("label"))
    claims = t.customer.select(k.alias("claim"), F.col("c_nationkey").alias("source"), _text("c", _col("c_custkey")).alias("subject"), _text("run C", _col("c_custkey")).alias("label"), F.lit("Run").alias("class"), v.alias("value"), quote.alias("quote"))
    return B.local_binding(claims, entities).select("claim", "bound")


_SECTION = "CASE doc_id % 4 WHEN 0 THEN 'Results' WHEN 1 THEN 'Introduction' WHEN 2 THEN '3. Conclusions' ELSE 'Test methods' END"


@query(f"""WITH s AS (SELECT doc_id % 97 AS statement, {_SECTION} AS section, coalesce(text, '') AS text FROM documents WHERE doc_id % 4 <> 1 OR doc_id % 8 = 1),
f AS (SELECT statement, section <> 'Introduction' AND NOT (regexp_matches(text, '(?i)\\b({B.OTHER_WORK})\\b') OR regexp_matches(text, '\\[[0-9]') OR regexp_matches(text, '\\b[A-Z][a-z]+ et al\\b')) AS own,
  section = '3. Conclusions' AND NOT (regexp_matches(text, '(?i)\\b(prior|previous|earlier|reported by)\\b') OR regexp_matches(text, '\\[[0-9]')) AS last FROM s)
SELECT statement, CASE WHEN bool_and(own) THEN 'DOCUMENT' WHEN bool_or(last) THEN 'CONCLUSION' ELSE 'UNRESOLVED' END AS scope FROM f GROUP BY 1""")
def statement_scopes(t):
    """Whether statements speak for their document: by the sections of all their spans, and what these cite."""
    d = F.col("doc_id")
    section = F.when(d % 4 == 0, "Results").when(d % 4 == 1, "Introduction").when(d % 4 == 2, "3. Conclusions").otherwise("Test methods")
    spans = t.texts().where("doc_id % 4 <> 1 OR doc_id % 8 = 1").select((d % 97).alias("statement"), section.alias("section"), F.coalesce("text", F.lit("")).alias("text"))
    return B.scope_of_statements(spans, "statement", "section", "text")


@query("SELECT doc_id, doc_id % 3 <> 2 AND doc_id % 5 IN (1, 3) AS review FROM documents")
def model_section_guard(t):
    """Measured roles in sections about models or analysis need a review."""
    d = F.col("doc_id")
    section = F.get(F.array(*[F.lit(x) for x in ("Results", "Numerical model", "Modelled", "Error analysis", "Methods")]), (d % 5).cast("int"))
    role = F.get(F.array(*[F.lit(x) for x in ("measured_observation", "reported_quantity", "derived_quantity")]), (d % 3).cast("int"))
    return t.documents.select("doc_id", B.measured_in_model(section, role).alias("review"))


@query("""SELECT c_custkey AS span, CASE c_custkey % 3 WHEN 0 THEN 'i' ELSE 'p' END || c_nationkey AS entity FROM customer WHERE c_custkey % 3 < 2 AND c_custkey % 2 = 0""")
def study_antecedents(t):
    """The one study that a paragraph names before a sentence that points back at it."""
    n = t.nation.select(F.col("n_nationkey").alias("source"), F.lit("Investigation").alias("class"), "n_name", _col("n_nationkey").alias("k"))
    entities = n.select("source", "class", _text("i", F.col("k")).alias("entity"), F.col("n_name").alias("label")).unionAll(n.select("source", "class", _text("p", F.col("k")), _text(F.col("n_name"), " project")))
    c = F.col("c_custkey")
    before = F.when(c % 3 == 0, _text("It was NATION_", _col("c_nationkey"), " that flew.")).when(c % 3 == 1, _text("The nation_", _col("c_nationkey"), "  project flew.")).otherwise("Nobody flew.")
    spans = t.customer.select(c.alias("span"), F.col("c_nationkey").alias("source"), before.alias("before"), F.when(c % 2 == 0, "These results hold.").otherwise("Some results hold.").alias("quote"))
    return B.antecedents(spans, entities)


@query("SELECT p_partkey, p_partkey % 5 IN (0, 4) AS eligible FROM part")
def quantity_scope_eligibility(t):
    """Classes that a quantity may describe: experimental ones and conditions, but no kind of gravity."""
    names = ("Sample", "PartialGravity", "GravityCondition", "Material", "Humidity")
    entities = t.part.select("p_partkey", F.get(F.array(*[F.lit(x) for x in names]), (F.col("p_partkey") % 5).cast("int")).alias("class"))
    edges = t.spark.createDataFrame([("PartialGravity", "GravityCondition"), ("GravityCondition", "ExperimentalCondition"), ("Humidity", "Ambient"), ("Ambient", "ExperimentalCondition")], "a string, b string")
    return B.quantity_scope(entities, G.closure(edges, "a", "b")).select("p_partkey", "eligible")


@query("SELECT l_orderkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1")
def single_heading_scope(t):
    """The scope of spans for which exactly one group is a candidate."""
    return B.single_scope(t.lineitem, "l_orderkey", "l_suppkey")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN regexp_matches(p_name, '(^|[^\\p{L}\\p{N}-])(widget|gear)([^\\p{L}\\p{N}-]|$)') ELSE true END AS qualified FROM part""")
def qualified_headings(t):
    """Headings that qualify a material and so name none."""
    k, n = F.col("p_partkey"), F.col("p_name")
    label = F.when(k % 4 == 0, n).when(k % 4 == 1, _text("Results: ", n)).when(k % 4 == 2, _text(n, " tests")).otherwise("Widget comparison")
    return t.part.select("p_partkey", B.qualified_heading(label, ["widget", "gear"]).alias("qualified"))


@query("""SELECT p_partkey, u.name, u.value FROM part, unnest([{'name': 'width', 'value': p_size || ' mm'}, {'name': 'length', 'value': (p_size + 1) || ' mm'}, {'name': 'height', 'value': (p_size + 2) || ' cm'}]) AS x(u) WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, 'width', p_size || ' mm' FROM part WHERE p_partkey % 2 = 1""")
def name_value_binding(t):
    """Values with their names: by position where a clause says `respectively`, else by nearness."""
    s = lambda n: (F.col("p_size") + n).cast("string")
    many = _text("width, length and height were ", s(0), " mm, ", s(1), " mm and ", s(2), " cm, respectively")
    clause = F.when(F.col("p_partkey") % 2 == 0, many).otherwise(_text("the width was ", s(0), " mm"))
    rows = t.part.select("p_partkey", clause.alias("clause"), F.array(*[F.lit(x) for x in ("width", "length", "height")]).alias("names"))
    return B.bind_values(rows, "p_partkey", "clause", "names")


@query("SELECT o_orderkey, o_orderkey % 6 IN (0, 1) AS derived FROM orders")
def derivation_words(t):
    """Values that the words about their own variable say were worked out."""
    k, v = F.col("o_orderkey"), _text((F.col("o_orderkey") % 50 + 1).cast("string"), " mm")
    forms = [
        _text("The width was calculated as ", v, "."),
        _text("Here the calculated width was ", v, "."),
        _text("The width was not calculated but read as ", v, "."),
        _text("The length was calculated; the width was ", v, "."),
        _text("The calculated length and the width of ", v, "."),
        _text("It was estimated. The width was ", v, "."),
    ]
    quote = F.get(F.array(*forms), (k % 6).cast("int"))
    return t.orders.select("o_orderkey", quote.alias("q"), v.alias("v")).select("o_orderkey", B.derivation(F.lit("width"), F.col("v"), F.col("q")).alias("derived"))


@query("""WITH e AS (SELECT c_nationkey AS source, c_custkey AS entity, c_custkey % 7 = 0 AS named, c_custkey % 10 = 0 AS broad FROM customer WHERE c_custkey % 4 <> 3 AND (c_custkey % 7 = 0 OR c_custkey % 10 = 0))
SELECT * EXCLUDE broad FROM (SELECT source, entity, named, broad, row_number() OVER (PARTITION BY source ORDER BY NOT named, NOT broad, entity) AS position FROM e) WHERE position <= 40""")
def offered_entities(t):
    """Supported entities that a later step may use: named ones first, then broad classes."""
    k = F.col("c_custkey")
    e = t.customer.select(F.col("c_nationkey").alias("source"), k.alias("entity"), F.col("c_name").alias("label"), F.when(k % 10 == 0, "Investigation").otherwise("Run").alias("class"), F.when(k % 4 == 3, "REJECTED").otherwise("SOURCE_SUPPORTED").alias("status"), F.when(k % 7 == 0, _text("then ", F.col("c_name"), " burned")).otherwise("nothing").alias("text"))
    return B.offered_entities(e, F.col("text")).select("source", "entity", "named", "position")


@query("SELECT c_custkey AS span, 'g' || c_nationkey AS entity FROM customer WHERE c_custkey % 5 <> 0 AND c_nationkey % 4 <> 3")
def figure_groups(t):
    """The group that all figures of a span show, by their captions' first lines."""
    n = t.nation.select(F.col("n_regionkey").alias("source"), _col("n_nationkey").alias("number"), F.col("n_name").alias("label"), _text("Figure ", _col("n_nationkey"), ". ", F.col("n_name"), F.when(F.col("n_nationkey") % 4 == 3, "\nreproduced from a report").otherwise("\nheat release")).alias("caption"))
    quote = _text("See Figure ", _col("c_nationkey"), F.when(F.col("c_custkey") % 5 == 0, _text(" and Fig. ", (F.col("c_nationkey") + 1).cast("string"))).otherwise(""), ".")
    spans = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("span"), F.col("n_regionkey").alias("source"), quote.alias("quote"))  # a fixed list of nations
    return B.figure_support(spans, n.select("source", "number", "caption"), n.select("source", _text("g", F.col("number")).alias("entity"), "label"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 20 = 0 THEN 'UNKNOWN' WHEN c_custkey % 10 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'SUPPORTED' ELSE 'CONTRADICTED' END
  WHEN c_nationkey % 3 = 2 OR c_custkey = c_nationkey THEN 'UNKNOWN' WHEN (c_nationkey % 3 = 0) = (c_custkey % 2 = 0) THEN 'SUPPORTED' ELSE 'CONTRADICTED' END AS binding FROM customer""")
def gravity_binding(t):
    """Conditions of runs, by what a source states of them or of their groups, exceptions heeded."""
    c, run = F.col("c_custkey"), _text("c", _col("c_custkey"))
    none = F.array().cast("array<string>")
    asked = t.customer.select("c_custkey", run.alias("run"), F.when(c % 2 == 0, "low").otherwise("normal").alias("value"))
    groups = t.nation.where("n_nationkey % 3 < 2").select(_text("n", _col("n_nationkey")).alias("entity"), F.when(F.col("n_nationkey") % 3 == 0, "low").otherwise("normal").alias("value"), F.array(_text("c", _col("n_nationkey"))).alias("exceptions"))
    local = t.customer.where("c_custkey % 10 = 0").select(run.alias("entity"), F.lit("low").alias("value"), none.alias("exceptions"))
    other = t.customer.where("c_custkey % 20 = 0").select(run.alias("entity"), F.lit("normal").alias("value"), none.alias("exceptions"))
    members = t.customer.select(run.alias("run"), _text("n", _col("c_nationkey")).alias("entity"))
    return B.condition_binding(asked, groups.unionAll(local).unionAll(other), members).select("c_custkey", "binding")


@query("""WITH a AS (SELECT p_brand AS source, upper(p_type[1:3]) || p_size AS acronym, p_partkey AS entity FROM part) SELECT source, acronym, min(entity) AS entity FROM a GROUP BY ALL HAVING count(*) = 1""")
def acronym_review(t):
    """Acronyms that one label of a source only defines."""
    e = t.part.select(F.col("p_brand").alias("source"), F.col("p_partkey").alias("entity"), _text(F.col("p_name"), " (", F.upper(F.substring("p_type", 1, 3)), _col("p_size"), ")").alias("label"))
    return B.acronyms(e)


@query("SELECT DISTINCT p_type AS term, 'UNRESOLVED' AS status, CASE WHEN p_type < 'F' THEN 'REUSE' ELSE 'EXTENSION' END AS review FROM part")
def concept_review(t):
    """Proposed concepts: reuse of a registered term, or an extension; none is accepted by itself."""
    concepts = t.part.select(F.col("p_type").alias("term")).distinct()
    aliases = t.part.where("p_type < 'F'").select(F.lower(_text(" ", F.col("p_type"), "  ")).alias("alias"))
    return B.concept_review(concepts, aliases)


@query("""SELECT event_id, 0 AS position, (event_id % 100)::INT AS k, NULL AS error FROM events
UNION ALL SELECT event_id, 1, CASE WHEN event_id % 5 = 0 THEN 1 END, CASE event_id % 5 WHEN 1 THEN 'DUPLICATE_FIELD' WHEN 2 THEN 'MISSING_FIELD' WHEN 3 THEN 'INVALID_JSON' END FROM events WHERE event_id % 5 < 4""")
def stage_items(t):
    """Objects of JSON arrays, each judged alone; an array that breaks off keeps those before the break."""
    e = F.col("event_id")
    second = F.get(F.array(*[F.lit(x) for x in ('{"k": 1, "u": "a"}]', '{"k": 1, "k": 2}]', '{"u": "b"}]', '{"k": one}]', '{"k": 5, "u": "c')]), (e % 5).cast("int"))
    raw = t.events.select("event_id", _text('[{"k": ', (e % 100).cast("string"), ', "u": "mm"}, ', second).alias("raw"))
    return B.parsed_items(raw, "event_id", "raw", "k int, u string", ["k"]).select("event_id", "position", F.col("item.k").alias("k"), "error")


@query("""WITH c AS (SELECT o_orderkey AS claim, count(l_orderkey) AS n, count(*) FILTER (l_orderkey IS NOT NULL AND p_partkey IS NULL) AS gone, count(DISTINCT p_brand) AS s FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON p_partkey = l_partkey GROUP BY 1)
SELECT * FROM (SELECT claim, CASE WHEN n = 0 THEN 'NO_EVIDENCE' WHEN gone > 0 THEN 'UNKNOWN_EVIDENCE' WHEN s > 1 THEN 'CROSS_DOCUMENT' END AS error FROM c) WHERE error IS NOT NULL""")
def located_supports(t):
    """Claims whose evidence is unknown, missing or of several documents."""
    passages = t.part.where("p_size > 10").select(F.col("p_partkey").alias("ref"), F.col("p_brand").alias("source"))
    return B.support_errors(t.orders.select(F.col("o_orderkey").alias("claim")), t.lineitem.select(F.col("l_orderkey").alias("claim"), F.col("l_partkey").alias("ref")), passages)
