"""Graph queries: nations and regions as a taxonomy, customers, suppliers and orders as nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog.registry import query
from tessera.operators import graph as G

#: nation -> region -> World, as taxonomy edges.
_TAXONOMY = """tax AS (SELECT n_name AS subject, r_name AS object, 'subClassOf' AS predicate FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT r_name, 'World', 'subClassOf' FROM region UNION ALL SELECT 'Earth', 'World', 'identity' UNION ALL SELECT 'FRANCE', 'GERMANY', 'related')"""


def _taxonomy(t):
    n = t.nation.join(F.broadcast(t.region), F.col("r_regionkey") == F.col("n_regionkey"))  # a fixed list of regions
    edges = n.select(F.col("n_name").alias("subject"), F.col("r_name").alias("object"), F.lit("subClassOf").alias("predicate"))
    edges = edges.unionAll(t.region.select(F.col("r_name").alias("subject"), F.lit("World").alias("object"), F.lit("subClassOf").alias("predicate")))
    return edges.unionAll(t.spark.createDataFrame([("Earth", "World", "identity"), ("FRANCE", "GERMANY", "related")], "subject string, object string, predicate string"))


_RELATIONS = """rel AS (SELECT 'o' || o_orderkey AS subject, 'placedBy' AS relation, 'c' || o_custkey AS object FROM orders
UNION ALL SELECT 'c' || c_custkey, 'livesIn', 'n' || c_nationkey FROM customer UNION ALL SELECT 's' || s_suppkey, 'basedIn', 'n' || s_nationkey FROM supplier
UNION ALL SELECT 'n' || n_nationkey, 'partOf', 'r' || n_regionkey FROM nation)"""


def _relations(t):
    edge = lambda df, a, ka, r, b, kb: df.select(F.concat(F.lit(a), F.col(ka)).alias("subject"), F.lit(r).alias("relation"), F.concat(F.lit(b), F.col(kb)).alias("object"))
    return edge(t.orders, "o", "o_orderkey", "placedBy", "c", "o_custkey").unionAll(edge(t.customer, "c", "c_custkey", "livesIn", "n", "c_nationkey")).unionAll(edge(t.supplier, "s", "s_suppkey", "basedIn", "n", "s_nationkey")).unionAll(edge(t.nation, "n", "n_nationkey", "partOf", "r", "n_regionkey"))


@query(f"""WITH RECURSIVE {_TAXONOMY},
c AS (SELECT subject AS descendant, object AS ancestor, 1 AS depth FROM tax WHERE predicate = 'subClassOf' UNION SELECT c.descendant, tax.object, c.depth + 1 FROM c JOIN tax ON tax.subject = c.ancestor AND predicate = 'subClassOf' WHERE depth < 16)
SELECT descendant, ancestor, min(depth) AS depth FROM c GROUP BY ALL""")
def schema_closure(t):
    """All ancestors of each class, with the least number of steps."""
    return G.closure(_taxonomy(t).where("predicate = 'subClassOf'"), "subject", "object")


@query(f"""WITH RECURSIVE {_TAXONOMY},
e AS (SELECT DISTINCT * FROM (SELECT subject AS f, object AS t, CASE predicate WHEN 'identity' THEN 'IDENTITY' WHEN 'related' THEN 'RELATED' ELSE 'ANCESTOR' END AS way FROM tax
  UNION ALL SELECT object, subject, CASE predicate WHEN 'identity' THEN 'IDENTITY' WHEN 'related' THEN 'RELATED' ELSE 'DESCENDANT' END FROM tax)),
p AS (SELECT r AS requested, r AS actual, [r] AS nodes, '' AS phase, true AS category, 0 AS depth FROM (VALUES ('FRANCE'), ('EUROPE'), ('World')) v(r)
  UNION ALL SELECT requested, e.t, list_append(nodes, e.t),
    CASE WHEN phase IN ('ANCESTOR', 'SIBLING') AND way = 'DESCENDANT' THEN 'SIBLING' WHEN way = 'IDENTITY' AND phase <> '' THEN phase ELSE way END, category AND way <> 'RELATED', depth + 1
  FROM p JOIN e ON e.f = p.actual WHERE depth < 3 AND phase <> 'RELATED' AND NOT list_contains(nodes, e.t) AND NOT (phase IN ('DESCENDANT', 'SIBLING') AND way = 'ANCESTOR') AND NOT (depth > 0 AND way = 'RELATED')),
r AS (SELECT requested, actual, phase AS relationship, depth, category AND phase IN ('DESCENDANT', 'IDENTITY') AS category_match, array_to_string(nodes, '>') AS path FROM p WHERE depth > 0)
SELECT requested, actual, relationship, depth, category_match, path FROM (SELECT *, row_number() OVER (PARTITION BY requested, actual ORDER BY category_match DESC, depth, path) AS k FROM r) WHERE k = 1""")
def taxonomy_traverse(t):
    """Best bounded paths up, down and up-then-down from three concepts."""
    return G.traverse(_taxonomy(t), ["FRANCE", "EUROPE", "World"], 3)


@query(f"""WITH {_RELATIONS} SELECT a.subject AS start, r3.object AS node, array_to_string([a.subject, a.object, r2.object, r3.object], '>') AS path FROM rel a
JOIN rel r2 ON r2.subject = a.object AND r2.relation = 'livesIn' JOIN rel r3 ON r3.subject = r2.object AND r3.relation = 'partOf' WHERE a.relation = 'placedBy' AND a.subject IN ('o1', 'o2', 'o3', 'o10', 'o33')""")
def route_navigation(t):
    """From orders over customers and nations to regions, along declared relations."""
    start = t.spark.createDataFrame([(f"o{i}",) for i in (1, 2, 3, 10, 33)], "node string")
    return G.navigate(_relations(t), start, [("placedBy", "FORWARD"), ("livesIn", "FORWARD"), ("partOf", "FORWARD")]).withColumn("path", F.array_join("path", ">"))


@query(f"""WITH {_RELATIONS} SELECT 'n3' AS start, b.subject AS node, 'n3>' || b.subject AS path FROM rel b WHERE b.relation = 'basedIn' AND b.object = 'n3'""")
def route_navigation_reverse(t):
    """Against a relation's direction."""
    return G.navigate(_relations(t), t.spark.createDataFrame([("n3",)], "node string"), [("basedIn", "REVERSE")]).withColumn("path", F.array_join("path", ">"))


@query(f"WITH {_RELATIONS} SELECT relation, count(*) AS n_uses, count(DISTINCT subject) AS n_subjects, count(DISTINCT object) AS n_objects FROM rel GROUP BY relation")
def ontology_inventory(t):
    """Uses, subjects and objects of each relation."""
    return G.inventory(_relations(t))


@query(f"WITH {_RELATIONS} SELECT relation, substr(subject, 1, 1) AS subject_type, substr(object, 1, 1) AS object_type, count(*) AS n FROM rel GROUP BY ALL")
def predicate_audit(t):
    """Which types each predicate joins, and how often."""
    return _relations(t).groupBy("relation", F.substring("subject", 1, 1).alias("subject_type"), F.substring("object", 1, 1).alias("object_type")).agg(F.count("*").alias("n"))


@query(f"WITH {_RELATIONS} SELECT DISTINCT relation FROM rel WHERE relation NOT IN ('placedBy', 'partOf')")
def undeclared_predicates(t):
    """Predicates in use that no registry declares."""
    declared = t.spark.createDataFrame([("placedBy",), ("partOf",)], "relation string")
    return _relations(t).select("relation").subtract(declared)


@query("SELECT o_orderkey AS l_orderkey, coalesce(n, 0) AS n_values, CASE WHEN coalesce(n, 0) < 2 THEN 'minCount' ELSE 'maxCount' END AS violation FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE coalesce(n, 0) < 2 OR n > 6")
def shape_violations(t):
    """Orders with fewer line items than two or more than six."""
    return G.count_violations(t.orders.select(F.col("o_orderkey").alias("l_orderkey")), t.lineitem.select("l_orderkey"), "l_orderkey", 2, 6)


@query(f"""WITH {_RELATIONS}, nodes AS (SELECT 'o' || o_orderkey AS node FROM orders UNION ALL SELECT 'c' || c_custkey FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT 'n' || n_nationkey FROM nation UNION ALL SELECT 's' || s_suppkey FROM supplier)
SELECT node, role, count(*) AS n_edges FROM (SELECT subject AS node, 'subject' AS role FROM rel UNION ALL SELECT object, 'object' FROM rel) e WHERE node NOT IN (SELECT node FROM nodes) GROUP BY ALL""")
def unresolved_endpoints(t):
    """Edge ends that are no known node."""
    node = lambda df, a, k: df.select(F.concat(F.lit(a), F.col(k)).alias("node"))
    nodes = node(t.orders, "o", "o_orderkey").unionAll(node(t.customer.where("c_custkey % 10 <> 0"), "c", "c_custkey")).unionAll(node(t.nation, "n", "n_nationkey")).unionAll(node(t.supplier, "s", "s_suppkey"))
    return G.unresolved(_relations(t), nodes)


@query("""SELECT n_name AS identity, r_name AS broader, count(c_custkey) AS n_support FROM nation JOIN region ON r_regionkey = n_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey
WHERE 'how do france and brazil compare with china' LIKE '%' || lower(n_name) || '%' GROUP BY ALL""")
def conceptual_support(t):
    """Identities that a question mentions, their approved broader concept and supporting records."""
    asked = F.lit("how do france and brazil compare with china")
    n = t.nation.where(F.contains(asked, F.lower("n_name"))).join(F.broadcast(t.region), F.col("r_regionkey") == F.col("n_regionkey"))  # a fixed list of regions
    per = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return n.join(per, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("n_name").alias("identity"), F.col("r_name").alias("broader"), F.coalesce("n", F.lit(0).cast("long")).alias("n_support"))


@query(f"WITH {_RELATIONS} SELECT a.subject, b.subject AS other FROM rel a JOIN rel b ON a.object = b.object AND a.relation = 'basedIn' AND b.relation = 'basedIn' AND a.subject < b.subject JOIN nation ON 'n' || n_nationkey = a.object WHERE n_name = 'FRANCE'")
def relation_self_join(t):
    """A triple pattern with a shared object, as a self-join of the edge list."""
    r = _relations(t).where("relation = 'basedIn'")
    france = t.nation.where("n_name = 'FRANCE'").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("object"))
    r = r.join(france, "object", "left_semi")
    a, b = r.select("object", "subject"), r.select("object", F.col("subject").alias("other"))
    return a.join(b, "object").where("subject < other").select("subject", "other")
