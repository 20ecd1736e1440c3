"""Questions read in batches, constraints parsed, plans executed over the tables, and streams run to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.catalog.registry import query
from tessera.functions import numeric
from tessera.operators import extraction as X
from tessera.operators.constraints import Constraint, Property
from tessera.operators.lineage import shared_folder
from tessera.plans import question as Q
from tessera.plans import search as S
from tessera.plans.intent import Intent, Registry, Relation, RelationConstraint
from tessera.streaming import events as E


def _registry() -> Registry:
    r = Registry(
        classes={"Order": {"target": True}, "Observation": {"information": True, "query_terms": ["observed"]}},
        entities={"building": ("segment", "BUILDING"), "machinery": ("segment", "MACHINERY"), "heavy machinery": ("segment", "HEAVY")},
        anchors=("segment",),
        protected=("material",),
    )
    r.register(Property("Width", "numeric", "mm", ("width", "breadth")), Property("TotalPrice", "numeric", None, ("price",)), Relation("segment"))
    return r


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(q, '\\b(paper|publication|article|author|doi|cite|citation)s?\\b') THEN 'bibliographic' WHEN regexp_matches(q, '\\b(compare|versus|vs|difference)\\b') THEN 'comparison' WHEN regexp_matches(q, '\\b(what is|what are|define|meaning of|kind of|type of)\\b') THEN 'conceptual' ELSE 'scientific' END AS route FROM (SELECT conv_id, turn, lower(CASE turn % 4 WHEN 0 THEN 'What is it: ' WHEN 1 THEN 'Compare ' WHEN 2 THEN 'Which papers say ' ELSE '' END || coalesce(text, '')) AS q FROM conversations)")
def question_routes(t):
    """What kind of question each turn is."""
    k = F.col("turn") % 4
    q = F.concat(F.when(k == 0, "What is it: ").when(k == 1, "Compare ").when(k == 2, "Which papers say ").otherwise(""), F.coalesce("text", F.lit("")))
    return t.conversations.select("conv_id", "turn", Q.routes(q).alias("route"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'segment=BUILDING' WHEN 1 THEN 'segment=HEAVY' WHEN 4 THEN 'segment=BUILDING' ELSE '' END AS relations,
  CASE p_partkey % 6 WHEN 0 THEN 'Width GT ' || p_size WHEN 1 THEN 'Width BETWEEN ' || p_size || ' ' || (p_size + 2) WHEN 3 THEN 'Width EQ ' || p_size || ';Width EQ ' || (p_size + 1) WHEN 4 THEN 'Width LT ' || p_size ELSE '' END AS properties,
  p_partkey % 6 IN (2, 3, 4, 5) AS clarification, p_partkey % 6 = 0 AS observed FROM part""")
def question_readings(t):
    """Intents of questions: names, numeric phrases, protected words, denials and alternatives."""
    n = F.col("p_size").cast("string")
    m = (F.col("p_size") + 1).cast("string")
    forms = [
        F.concat(F.lit("What was observed in building orders with width above "), n, F.lit(" mm?")),
        F.concat(F.lit("heavy machinery with breadth between "), n, F.lit(" and "), (F.col("p_size") + 2).cast("string"), F.lit(" mm")),
        F.lit("which material is it"),
        F.concat(F.lit("width "), n, F.lit(" mm, width "), m, F.lit(" mm")),
        F.concat(F.lit("building orders whose width is under "), n, F.lit(" mm or so")),
        F.lit("orders that are not machinery"),
    ]
    q = t.part.select("p_partkey", F.get(F.array(*forms), (F.col("p_partkey") % 6).cast("int")).alias("q"))
    r = Q.read_table(q, "p_partkey", "q", _registry())
    relations = F.array_join(F.transform("relations", lambda x: F.concat_ws("=", x["relation"], x["entity"])), ";")
    number = lambda x: x.cast("long").cast("string")
    properties = F.transform("properties", lambda p: F.concat_ws(" ", p["property"], p["operator"], *[number(p[f]) for f in ("value", "lower", "upper")]))
    return r.select("p_partkey", relations.alias("relations"), F.array_join(properties, ";").alias("properties"), "clarification", (F.size("information") > 0).alias("observed"))


@query("""SELECT o_orderkey, ['GTE', 'BETWEEN', 'APPROX', 'EQ', NULL, 'APPROX'][o_orderkey % 6 + 1] AS operator, CASE WHEN o_orderkey % 6 IN (0, 2, 3, 5) THEN o_custkey::DOUBLE END AS value, CASE WHEN o_orderkey % 6 = 1 THEN o_custkey::DOUBLE END AS lower,
  CASE WHEN o_orderkey % 6 = 1 THEN o_custkey + 2.5 END AS upper, CASE WHEN o_orderkey % 6 = 5 THEN 2.0 END AS tolerance, ['mm', 'kpa', NULL, 's', NULL, 'mm'][o_orderkey % 6 + 1] AS unit FROM orders""")
def constraint_expressions(t):
    """Operator words, ranges, tolerances and units of numeric phrases; ranges of two units are none."""
    c = F.col("o_custkey").cast("string")
    forms = [F.concat(F.lit("at least "), c, F.lit(" mm")), F.concat(F.lit("between "), c, F.lit(" kPa and "), (F.col("o_custkey") + 2.5).cast("string"), F.lit(" kPa")), F.concat(F.lit("about "), c), F.concat(c, F.lit(" s")), F.concat(F.lit("from 1 mm to 2 s or "), c), F.concat(c, F.lit(" ± 2 mm"))]
    x = t.orders.select("o_orderkey", numeric.parse_expressions(F.get(F.array(*forms), (F.col("o_orderkey") % 6).cast("int"))).alias("x"))
    return x.select("o_orderkey", "x.*")


@query("SELECT l_orderkey, l_linenumber, l_linenumber % 6 IN (0, 1) AS kept FROM lineitem")
def rewording_kept(t):
    """Whether rewordings keep numbers, units, negations and registered names."""
    q = F.col("l_quantity").cast("int").cast("string")
    base = F.concat(F.lit("The PMMA sample of "), q, F.lit(" mm did not burn"))
    forms = [base, F.concat(F.lit("It did not burn: the "), q, F.lit(" mm sample of pmma")), F.concat(F.lit("The PMMA sample of "), q, F.lit(" cm did not burn")), F.concat(F.lit("The PMMA sample of "), q, F.lit(" mm did burn")), F.concat(F.lit("The sample of "), q, F.lit(" mm did not burn")), F.concat(base, F.lit(", excluding one"))]
    rows = t.lineitem.select("l_orderkey", "l_linenumber", base.alias("a"), F.get(F.array(*forms), F.col("l_linenumber") % 6).alias("b"))
    return rows.select("l_orderkey", "l_linenumber", X.kept_meaning("a", "b", ("PMMA", "cotton")).alias("kept"))


@query("""WITH o AS (SELECT o_orderkey, c_mktsegment = 'BUILDING' AS m, o_totalprice >= 200000 AS p FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT 'o' || o_orderkey AS entity, CASE WHEN m AND p THEN 'DIRECT' WHEN m OR p THEN 'RELATED' ELSE 'NO_DIRECT' END AS classification, CASE WHEN m THEN 3.0 ELSE -2.0 END + CASE WHEN p THEN 3.0 ELSE -2.0 END AS score FROM o""")
def planned_search(t):
    """A whole plan: an intent validated, compiled over entities, relations and values, classified and scored."""
    key = F.concat(F.lit("o"), F.col("o_orderkey"))
    o = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    none = lambda kind: F.lit(None).cast(kind)
    store = S.Store(
        o.select(key.alias("entity"), F.array(F.lit("Order")).alias("classes"), F.array(F.lit("s")).alias("sources"), F.array(F.lit("e")).alias("evidence")),
        o.select(key.alias("subject"), F.lit("segment").alias("relation"), F.col("c_mktsegment").alias("object")),
        o.select(key.alias("subject"), F.lit("TotalPrice").alias("property"), F.col("o_totalprice").alias("number"), none("string").alias("text"), none("string").alias("unit"), none("double").alias("lower"), F.lit(False).alias("approximate"), none("map<string,string>").alias("qualifiers")),
    )
    intent = Intent(("Order",), (RelationConstraint("segment", "BUILDING"),), (Constraint("TotalPrice", "GTE", 200000.0),))
    return S.execute(intent, _registry(), store).classified.select("entity", "classification", "score")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_to_end(t):
    """Events read as a stream of files, aggregated and written by micro-batches until none is left."""
    folder = f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    stream = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    counts = stream.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    started = E.last_batch(counts, f"{folder}/out", f"{folder}/checkpoint").trigger(availableNow=True).start()
    started.awaitTermination()
    return t.spark.read.parquet(f"{folder}/out")
