"""Constraints, classification, comparison and ranking over orders, line items and parts as subjects."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog.registry import query
from tessera.operators import classify as C
from tessera.operators.constraints import Constraint, Property, outcome, qualified, resolve_property, single_outcome

PRICE = Property("TotalPrice")
DISCOUNT = Property("Discount", canonical_unit="fraction")
SIZE = Property("Size")
BRAND = Property("Brand", "categorical")


def _orders(t):
    """Orders as subjects with the outcomes of a segment relation and a price bound."""
    o = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey", "left")
    return o.select(
        "o_orderkey",
        "o_orderpriority",
        C.relation_outcome(F.when(F.col("c_mktsegment").isNotNull(), F.array("c_mktsegment")), "BUILDING").alias("segment"),
        outcome(Constraint("TotalPrice", "GTE", 200000.0), PRICE, F.col("o_totalprice")).alias("price"),
    )


_ORDERS = """
o AS (SELECT o_orderkey, o_orderpriority,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'MATCH' WHEN c_mktsegment IS NOT NULL THEN 'DIFFER' ELSE 'UNKNOWN' END AS segment,
  CASE WHEN o_totalprice IS NULL THEN 'UNKNOWN' WHEN o_totalprice >= 200000 THEN 'MATCH' ELSE 'DIFFER' END AS price
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey)"""


def _outcomes(df):
    return {"segment": F.col("segment"), "price": F.col("price")}


@query(f"""WITH {_ORDERS}
SELECT o_orderkey, segment, price,
  CASE WHEN segment = 'MATCH' AND price = 'MATCH' THEN 'DIRECT' WHEN segment = 'MATCH' OR price = 'MATCH' OR price = 'DIFFER' AND segment = 'MATCH' THEN 'RELATED' ELSE 'NO_DIRECT' END AS classification,
  CASE segment WHEN 'MATCH' THEN 3.0 WHEN 'DIFFER' THEN -2.0 ELSE -1.0 END * 2 + CASE price WHEN 'MATCH' THEN 3.0 WHEN 'DIFFER' THEN -2.0 ELSE -1.0 END AS score
FROM o WHERE segment = 'MATCH' OR price = 'MATCH'""")
def classify_direct_related(t):
    """The flagship search: a relation and a numeric bound, classified, scored, without subjects of neither kind."""
    o = _orders(t)
    kind = C.classify(_outcomes(o), numeric=("price",))
    out = o.select("o_orderkey", "segment", "price", kind.alias("classification"), C.score(_outcomes(o), {"segment": 2.0}).alias("score"))
    return out.where("classification <> 'NO_DIRECT'")


@query(f"""WITH {_ORDERS}
SELECT o_orderkey, CASE WHEN segment = 'MATCH' AND price = 'MATCH' THEN 'DIRECT' WHEN segment = 'MATCH' THEN 'RELATED' ELSE 'NO_DIRECT' END AS classification FROM o""")
def classify_related_with_anchor(t):
    """Under the related policy a numeric difference is related evidence, but only where the anchor relation matches."""
    o = _orders(t)
    return o.select("o_orderkey", C.classify(_outcomes(o), numeric=("price",), anchors=("segment",), related_policy=True).alias("classification"))


@query("""SELECT l_orderkey, l_linenumber,
  CASE WHEN NOT (l_returnflag <> 'R') AND NOT (l_quantity IS NULL OR l_quantity < 30) THEN 'DIRECT'
       WHEN l_returnflag = 'R' OR l_quantity >= 30 THEN 'RELATED' ELSE 'NO_DIRECT' END AS classification FROM lineitem""")
def v1_run_classification(t):
    """The earlier policy on flat rows: a missing quantity differs, other unknowns don't block."""
    df = t.lineitem
    outcomes = {"flag": outcome(Constraint("Flag", "EQ", "R"), Property("Flag", "categorical"), text=F.col("l_returnflag")), "quantity": outcome(Constraint("Quantity", "GTE", 30.0), Property("Quantity"), F.col("l_quantity"))}
    return df.select("l_orderkey", "l_linenumber", C.classify_v1(outcomes, absent_differs=("quantity",)).alias("classification"))


@query("""SELECT p_partkey,
  CASE WHEN p_size = 10 THEN 'MATCH' ELSE 'DIFFER' END AS eq, CASE WHEN p_size <> 10 THEN 'MATCH' ELSE 'DIFFER' END AS neq,
  CASE WHEN p_size < 10 THEN 'MATCH' ELSE 'DIFFER' END AS lt, CASE WHEN p_size <= 10 THEN 'MATCH' ELSE 'DIFFER' END AS lte,
  CASE WHEN p_size > 10 THEN 'MATCH' ELSE 'DIFFER' END AS gt, CASE WHEN p_size >= 10 THEN 'MATCH' ELSE 'DIFFER' END AS gte,
  CASE WHEN p_size BETWEEN 5 AND 15 THEN 'MATCH' ELSE 'DIFFER' END AS btw, CASE WHEN abs(p_size - 10) <= 2 THEN 'MATCH' ELSE 'DIFFER' END AS approx,
  CASE WHEN p_size IN (1, 10, 20) THEN 'MATCH' ELSE 'DIFFER' END AS isin, 'UNKNOWN' AS no_tolerance,
  CASE WHEN p_brand = 'Brand#11' THEN 'MATCH' ELSE 'DIFFER' END AS brand_eq, CASE WHEN p_brand <> 'Brand#11' THEN 'MATCH' ELSE 'DIFFER' END AS brand_neq,
  CASE WHEN p_brand IN ('Brand#11', 'Brand#22') THEN 'MATCH' ELSE 'DIFFER' END AS brand_in FROM part""")
def constraint_outcomes_all_ops(t):
    """All operators on a numeric and a categorical property."""
    x, b = F.col("p_size"), F.col("p_brand")
    numeric = {
        "eq": Constraint("Size", "EQ", 10.0),
        "neq": Constraint("Size", "NEQ", 10.0),
        "lt": Constraint("Size", "LT", 10.0),
        "lte": Constraint("Size", "LTE", 10.0),
        "gt": Constraint("Size", "GT", 10.0),
        "gte": Constraint("Size", "GTE", 10.0),
        "btw": Constraint("Size", "BETWEEN", lower=5.0, upper=15.0),
        "approx": Constraint("Size", "APPROX", 10.0, tolerance=2.0),
        "isin": Constraint("Size", "IN", values=(1.0, 10.0, 20.0)),
        "no_tolerance": Constraint("Size", "APPROX", 10.0),
    }
    named = {"brand_eq": Constraint("Brand", "EQ", "Brand#11"), "brand_neq": Constraint("Brand", "NEQ", "Brand#11"), "brand_in": Constraint("Brand", "IN", values=("Brand#11", "Brand#22"))}
    return t.part.select("p_partkey", *[outcome(c, SIZE, x).alias(k) for k, c in numeric.items()], *[outcome(c, BRAND, text=b).alias(k) for k, c in named.items()])


@query("""SELECT p_partkey,
  CASE WHEN p_size = 5 THEN 'UNKNOWN' WHEN p_size = 15 THEN 'DIFFER' WHEN p_size BETWEEN 5 AND 15 THEN 'MATCH' ELSE 'DIFFER' END AS outcome FROM part""")
def between_boundary_inclusivity(t):
    """At a bound whose inclusion the wording leaves open the outcome is unknown; at an exclusive bound it differs."""
    return t.part.select("p_partkey", outcome(Constraint("Size", "BETWEEN", lower=5.0, upper=15.0, inclusive=(None, False)), SIZE, F.col("p_size")).alias("outcome"))


@query("""SELECT l_orderkey, l_linenumber,
  CASE l_linenumber % 4 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN CASE WHEN round(l_discount * 100) >= 5 THEN 'MATCH' ELSE 'DIFFER' END WHEN 2 THEN 'INVALID' ELSE 'INVALID' END AS outcome FROM lineitem""")
def reported_units_and_approximation(t):
    """Per cent values compare with fractions; approximate values are unknown; other dimensions and unknown units are invalid."""
    n = F.col("l_linenumber") % 4
    unit = F.when(n == 2, "mm/s").when(n == 3, "furlong").otherwise("%")
    value = F.round(F.col("l_discount") * 100)
    return t.lineitem.select("l_orderkey", "l_linenumber", outcome(Constraint("Discount", "GTE", 4.9999, unit="%"), DISCOUNT, value, unit=unit, approximate=n == 0).alias("outcome"))


@query("SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount >= 0.0499 AND l_discount <= 0.0701")
def unit_normalised_filter(t):
    """A range asked in per cent, pushed down to the scan as a plain comparison of fractions."""
    low, high = (Constraint("Discount", op, v, unit="%") for op, v in (("GTE", 4.99), ("LTE", 7.01)))
    from tessera.operators.constraints import normalised

    a, b = (round(normalised(c, DISCOUNT).value, 12) for c in (low, high))
    return t.lineitem.where((F.col("l_discount") >= a) & (F.col("l_discount") <= b)).select("l_orderkey", "l_linenumber", "l_discount")


@query("""SELECT o_orderkey, CASE WHEN count(l_orderkey) = 0 THEN 'UNKNOWN' WHEN bool_and(l_discount >= 0.05) THEN 'MATCH' WHEN bool_and(l_discount < 0.05) THEN 'DIFFER' ELSE 'UNKNOWN' END AS outcome,
  count(l_orderkey) AS n_values FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def missing_and_conflicting_values(t):
    """A subject matches or differs only if all its observations agree; none at all is unknown."""
    one = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), outcome(Constraint("Discount", "GTE", 0.05, unit="fraction"), DISCOUNT, F.col("l_discount")).alias("x"))
    # Observations are summed up before they meet the subjects, which keeps the join small.
    per = one.groupBy("o_orderkey").agg(single_outcome("x").alias("outcome"), F.count("*").alias("n_values"))
    return t.orders.select("o_orderkey").join(per, "o_orderkey", "left").select("o_orderkey", F.coalesce("outcome", F.lit("UNKNOWN")).alias("outcome"), F.coalesce("n_values", F.lit(0).cast("long")).alias("n_values"))


@query("SELECT event_id, value FROM events WHERE json_extract_string(props, '$.k') = '3' AND event_type = 'purchase'")
def qualifier_filter(t):
    """Values whose qualifiers have all the wanted pairs."""
    q = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("type"), F.col("event_type")))
    return t.events.where(qualified(q, {"k": "3", "type": "purchase"})).select("event_id", "value")


@query("""WITH v AS (SELECT l_orderkey AS k, unnest(['flag', 'status', 'line']) AS dimension, unnest([l_returnflag, l_linestatus, l_linenumber::VARCHAR]) AS v FROM lineitem WHERE l_orderkey IN (1, 2, 3)),
s AS (SELECT dimension, count(DISTINCT CASE WHEN v IS NOT NULL THEN k END) AS h, count(DISTINCT v) AS n_values FROM v GROUP BY dimension)
SELECT dimension, CASE WHEN h < 3 THEN 'unknown' WHEN n_values = 1 THEN 'shared' ELSE 'different' END AS status, n_values FROM s""")
def compare_operands(t):
    """Shared, different and unknown dimensions of three orders."""
    v = t.lineitem.select(F.col("l_orderkey").alias("k"), F.expr("stack(3, 'flag', l_returnflag, 'status', l_linestatus, 'line', cast(l_linenumber as string)) as (dimension, v)"))
    return C.compare(v, [1, 2, 3], "k", "dimension", "v")


@query("""SELECT p_brand, count(DISTINCT p_size) AS n_sizes, min(p_retailprice) AS lowest, max(p_retailprice) AS highest,
  CASE WHEN count(DISTINCT p_type) = 1 THEN 'shared' ELSE 'different' END AS type_status FROM part GROUP BY p_brand""")
def run_comparison(t):
    """Comparison of flat rows by key."""
    return t.part.groupBy("p_brand").agg(F.countDistinct("p_size").alias("n_sizes"), F.min("p_retailprice").alias("lowest"), F.max("p_retailprice").alias("highest"), F.when(F.countDistinct("p_type") == 1, "shared").otherwise("different").alias("type_status"))


@query("""SELECT c_mktsegment AS requested_group, count(*) AS n_subjects, count(*) FILTER (o_totalprice >= 200000) AS n_direct
FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') GROUP BY 1""")
def group_union_branches(t):
    """One slot with several values, answered in one pass with the value as a column instead of a run per value."""
    asked = t.spark.createDataFrame([(x,) for x in ("BUILDING", "MACHINERY", "AUTOMOBILE")], "requested_group string")
    c = t.customer.join(F.broadcast(asked), F.col("c_mktsegment") == F.col("requested_group"))  # as many rows as were asked for
    o = t.orders.join(c.select("c_custkey", "requested_group"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy("requested_group").agg(F.count("*").alias("n_subjects"), F.count_if(F.col("o_totalprice") >= 200000).alias("n_direct"))


@query("""SELECT r_name, seg, count(o_orderkey) AS n FROM (SELECT r_name, r_regionkey FROM region WHERE r_regionkey IN (0, 1)) r CROSS JOIN (VALUES ('BUILDING'), ('MACHINERY')) s(seg)
LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment = seg LEFT JOIN orders ON o_custkey = c_custkey GROUP BY r_name, seg""")
def slot_product(t):
    """All combinations of two slots' values (8 at most), each with its subjects."""
    segments = t.spark.createDataFrame([("BUILDING",), ("MACHINERY",)], "seg string")
    regions = t.region.where(F.col("r_regionkey").isin(0, 1))
    combinations = regions.select("r_name", "r_regionkey", F.explode(F.array(F.lit("BUILDING"), F.lit("MACHINERY"))).alias("seg"))
    per = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(segments, F.col("c_mktsegment") == F.col("seg")).join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).groupBy(F.col("n_regionkey").alias("r_regionkey"), "seg").agg(F.count("*").alias("n"))
    return combinations.join(per, ["r_regionkey", "seg"], "left").select("r_name", "seg", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query(f"""WITH {_ORDERS}, s AS (SELECT o_orderkey, segment, price, CASE segment WHEN 'MATCH' THEN 3.0 WHEN 'DIFFER' THEN -2.0 ELSE -1.0 END * 2 + CASE price WHEN 'MATCH' THEN 3.0 WHEN 'DIFFER' THEN -2.0 ELSE -1.0 END AS score FROM o)
SELECT o_orderkey, score, row_number() OVER (ORDER BY score DESC, o_orderkey) AS rank FROM s WHERE (segment = 'MATCH') <> (price = 'MATCH') ORDER BY score DESC, o_orderkey LIMIT 50""")
def related_ranked_weighted(t):
    """The 50 best related subjects by weighted explanation, ties by id."""
    o = _orders(t)
    scored = o.withColumn("score", C.score(_outcomes(o), {"segment": 2.0})).withColumn("kind", C.classify(_outcomes(o))).where("kind = 'RELATED'")
    return C.ranked(C.top(scored, "score", "o_orderkey", 50), "score", "o_orderkey").select("o_orderkey", "score", "rank")


@query(f"""WITH {_ORDERS}, s AS (SELECT o_orderkey, o_orderpriority, 'price=' || price || ';segment=' || segment AS signature FROM o WHERE (segment = 'MATCH') <> (price = 'MATCH'))
SELECT o_orderpriority, signature, count(*) AS n_candidates, min(o_orderkey) AS representative_id, min(o_orderkey) AS best_rank FROM s GROUP BY 1, 2""")
def related_groups(t):
    """Related subjects grouped by what of the request they meet, each group with a representative."""
    o = _orders(t)
    r = o.withColumn("signature", C.signature(_outcomes(o))).withColumn("kind", C.classify(_outcomes(o))).where("kind = 'RELATED'").withColumn("rank", F.col("o_orderkey"))
    return C.groups(r, ["o_orderpriority", "signature"], "o_orderkey", "rank")


@query("SELECT doc_id, lang, row_number() OVER (ORDER BY CASE WHEN lang = 'de' THEN 0 ELSE 1 END, n_chars DESC, doc_id) AS rank FROM documents ORDER BY rank LIMIT 40")
def preference_resort(t):
    """A stable preference: one language first, otherwise the original order."""
    best = t.documents.select("doc_id", "lang", (F.col("lang") == "de").cast("int").alias("preferred"), "n_chars").orderBy(F.desc("preferred"), F.desc("n_chars"), "doc_id").limit(40)
    from pyspark.sql import Window

    return best.select("doc_id", "lang", F.row_number().over(Window.orderBy(F.desc("preferred"), F.desc("n_chars"), "doc_id")).alias("rank"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2))")
def selection_scope_semi(t):
    """Candidates within an exact selection scope, by semi joins."""
    nations = t.nation.where("n_regionkey = 2").select(F.col("n_nationkey").alias("c_nationkey"))
    customers = t.customer.where("c_mktsegment = 'BUILDING'").join(nations, "c_nationkey", "left_semi").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.join(customers, "o_custkey", "left_semi").select("o_orderkey")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def evidence_anti(t):
    """Subjects without evidence of a kind, by an anti join."""
    return t.customer.join(t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT doc_id, source FROM documents LEFT JOIN (SELECT doc_id AS d, CASE quality WHEN 0 THEN 'SUPERSEDED' ELSE 'ACTIVE' END AS status FROM labels) ON d = doc_id WHERE coalesce(status, '') NOT IN ('SUPERSEDED', 'ROLLED_BACK')")
def status_visibility(t):
    """Documents whose status is neither superseded nor rolled back; no status is visible."""
    s = t.labels.select("doc_id", F.when(F.col("quality") == 0, "SUPERSEDED").otherwise("ACTIVE").alias("status"))
    return t.documents.select("doc_id", "source").join(s, "doc_id", "left").where(~F.coalesce("status", F.lit("")).isin("SUPERSEDED", "ROLLED_BACK")).select("doc_id", "source")


@query("SELECT doc_id, CASE WHEN toxic IS NULL THEN 'NONE' WHEN toxic = 0 THEN 'APPROVED' END AS review_state FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS NULL OR toxic = 0")
def review_state_visibility(t):
    """Rows without a review state, or approved."""
    j = t.documents.select("doc_id").join(t.labels.select("doc_id", "toxic"), "doc_id", "left").withColumn("s", F.when(F.col("toxic") == 0, "APPROVED").when(F.col("toxic") == 1, "REJECTED"))
    return j.where(F.col("s").isNull() | (F.col("s") == "APPROVED")).select("doc_id", F.coalesce("s", F.lit("NONE")).alias("review_state"))


@query("""SELECT l_orderkey, count(*) AS n, CASE WHEN bool_and(l_suppkey % 3 <> 0) THEN 'kept' ELSE 'cross_source' END AS reason FROM lineitem GROUP BY l_orderkey""")
def cross_source_exclusion(t):
    """Subjects stay only if all their references come from the wanted sources; others carry the reason."""
    inside = F.col("l_suppkey") % 3 != 0
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.when(F.every(inside), "kept").otherwise("cross_source").alias("reason"))


@query("""SELECT label, unit, CASE label WHEN 'size' THEN 'UNKNOWN' WHEN 'Discount Rate' THEN CASE unit WHEN '%' THEN 'CANONICAL' ELSE 'UNKNOWN' END WHEN 'rate' THEN 'AMBIGUOUS' ELSE 'UNKNOWN' END AS state,
  CASE WHEN label = 'Discount Rate' AND unit = '%' THEN 'Discount' END AS property FROM (SELECT unnest(['Discount Rate', 'rate', 'nothing']) AS label) CROSS JOIN (SELECT unnest(['%', 'mm']) AS unit)""")
def property_resolution(t):
    """Labels resolved through the registry: one property, several, or none; a unit of another dimension is none."""
    labels = t.spark.createDataFrame([(a, u) for a in ("Discount Rate", "rate", "nothing") for u in ("%", "mm")], "label string, unit string")
    return resolve_property(labels, [Property("Discount", "numeric", "fraction", ("discount rate", "rate")), Property("Tax", "numeric", "fraction", ("rate",))]).select("label", "unit", "state", "property")


@query("SELECT n_nationkey, n_name, c.n_customers, s.n_suppliers FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n_customers FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, count(*) AS n_suppliers FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey")
def scalar_subqueries(t):
    """Counts per row as joins on aggregates instead of correlated subqueries."""
    c = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n_customers"))
    s = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n_suppliers"))
    return t.nation.join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").select("n_nationkey", "n_name", "n_customers", "n_suppliers")
