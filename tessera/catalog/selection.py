"""Selection by topic and policy, JSON predicates, versions and mapping choices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.catalog.registry import query
from tessera.functions import numeric, units
from tessera.operators import metrics as M
from tessera.operators import records as R
from tessera.operators import selection as S


@query("SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\\p{L}])that(s|ed|ing)?([^\\p{L}]|$)') AND regexp_matches(lower(text), '(^|[^\\p{L}])wh(s|ed|ing)?([^\\p{L}]|$)')")
def publication_topic(t):
    """Texts with every distinctive term of a question, in some form."""
    return t.documents.where(S.all_terms(F.col("text"), ["that", "wh"])).select("doc_id")


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)license|rights')")
def topic_families(t):
    """Texts that apply to the topic family a question asks for."""
    pairs = [("licen[cs]e|legal", "license|rights"), ("flame|burn", "flame|burn")]
    return t.documents.where(S.families("Which legal notices are there?", F.col("text"), pairs)).select("doc_id")


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events WHERE json_extract_string(props, '$.k')::INT >= 8")
def json_predicate(t):
    """A path of a JSON column in a predicate."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    return t.events.where(k >= 8).select("event_id", k.alias("k"))


@query("SELECT o_custkey, list_sort(list(o_orderkey))[1] AS first_order, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def json_array_rows(t):
    """JSON arrays written, read again and opened into rows."""
    packed = t.orders.groupBy("o_custkey").agg(F.to_json(F.array_sort(F.collect_list("o_orderkey"))).alias("j"))
    rows = packed.select("o_custkey", F.explode(F.from_json("j", "array<bigint>")).alias("k"))
    return rows.groupBy("o_custkey").agg(F.min("k").alias("first_order"), F.count("*").alias("n")).where("n > 12")


@query("SELECT user_id, arg_max(event_id, (event_type = 'purchase', ts, event_id)) AS event_id FROM events GROUP BY user_id")
def local_version_pick(t):
    """The preferred version of each source, else the latest."""
    return t.events.groupBy("user_id").agg(F.max_by("event_id", F.struct(F.col("event_type") == "purchase", "ts", "event_id")).alias("event_id"))


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
def recent_jobs(t):
    """The ten most recent rows."""
    return t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(10).select("event_id", "ts")


@query("SELECT label, property FROM (VALUES ('speed', 'Flow'), ('rate', 'Discount'), ('rate', 'Tax')) v(label, property)")
def mapping_alternatives(t):
    """Properties that a column's unit could measure."""
    labels = t.spark.createDataFrame([("speed", "cm/s"), ("rate", "%"), ("odd", "furlong")], "label string, unit string")
    return S.alternatives(labels, [("Flow", "m/s"), ("Discount", "fraction"), ("Tax", "fraction")], units.canonical(F.col("unit")))


@query("SELECT n_name AS subject, n_regionkey::VARCHAR AS object, CASE WHEN n_nationkey % 2 = 0 AND n_nationkey < 20 THEN 'visible' ELSE 'staged' END AS side FROM nation")
def approved_and_staged_edges(t):
    """Approved edges whose evidence resolves are visible; the others stay staged."""
    k = F.col("n_nationkey")
    edges = t.nation.select(F.col("n_name").alias("subject"), F.col("n_regionkey").cast("string").alias("object"), F.array(k).alias("evidence"), F.when(k % 2 == 0, "APPROVED").otherwise("STAGED").alias("state"))
    good, staged = S.visible_edges(edges, t.nation.where("n_nationkey < 20").select(k.alias("passage")), "evidence", "state")
    side = lambda df, s: df.select("subject", "object", F.lit(s).alias("side"))
    return side(good, "visible").unionAll(side(staged, "staged"))


@query("SELECT n_name AS subject FROM nation WHERE n_regionkey IN (0, 1)")
def taxonomy_edge_validation(t):
    """Edges whose predicate does not fit the kinds that they join."""
    kind = F.when(F.col("n_regionkey") < 2, "individual").otherwise("class")
    e = t.nation.select(F.col("n_name").alias("subject"), F.lit("subClassOf").alias("predicate"), kind.alias("subject_kind"), F.lit("class").alias("object_kind"))
    return S.edge_errors(e, [("subClassOf", "class", "class"), ("type", "individual", "class")]).select("subject")


@query("""WITH r AS (SELECT source AS q, doc_id AS item, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
b AS (SELECT d.source AS q, min(CASE WHEN d.lang = 'de' THEN r.rank END) AS rank FROM documents d JOIN r ON r.q = d.source AND r.item = d.doc_id WHERE d.lang = 'de' GROUP BY 1)
SELECT 'all' AS category, count(*) AS n, avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END) AS recall_1, avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0 END) AS recall_3, avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END) AS recall_5, avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END) AS recall_10,
  round(avg(coalesce(1.0 / rank, 0)), 9) AS mrr, avg(CASE WHEN rank IS NULL THEN 1.0 ELSE 0 END) AS no_result FROM b""")
def target_rank_quality(t):
    """Rankings within each source, scored by the best rank of any target."""
    ranks = t.documents.select(F.col("source").alias("q"), F.col("doc_id").alias("item"), F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))
    targets = t.documents.where("lang = 'de'").select(F.col("source").alias("q"), F.col("doc_id").alias("item"))
    best = S.rank_of_targets(ranks, targets, "q", "item").withColumn("category", F.lit("all"))
    return M.ranking_quality(best, "rank", ["category"]).withColumn("mrr", F.round("mrr", 9))


@query("SELECT CASE WHEN doc_id % 5 = 0 THEN 'not_covered' WHEN n_chars < 400 THEN 'too_short' WHEN quality = 0 THEN 'low_quality' ELSE 'ranked_low' END AS cause, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def failure_decomposition(t):
    """Why a target was missed, by the first cause that applies."""
    cause = F.when(F.col("doc_id") % 5 == 0, "not_covered").when(F.col("n_chars") < 400, "too_short").when(F.col("quality") == 0, "low_quality").otherwise("ranked_low")
    return t.documents.join(t.labels, "doc_id", "left").groupBy(cause.alias("cause")).agg(F.count("*").alias("n"))


@query("SELECT a.l_orderkey, a.l_linenumber AS a, b.l_linenumber AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber WHERE abs(a.l_discount - b.l_discount) <= 1e-12 * greatest(abs(a.l_discount), abs(b.l_discount))")
def numeric_equivalence(t):
    """Corroborating values of the same subject that are equal within a relative tolerance."""
    x = t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("a"), F.col("l_discount").alias("x"))
    y = x.select("l_orderkey", F.col("a").alias("b"), F.col("x").alias("y"))
    return x.join(y, "l_orderkey").where((F.col("a") < F.col("b")) & numeric.close(F.col("x"), F.col("y"))).select("l_orderkey", "a", "b")


@query("SELECT count(*) AS n, count(*) FILTER (n_chars > 0) AS n_answered, count(*) FILTER (source = 'src1') AS n_expected FROM documents")
def simple_evaluation(t):
    """Answers that are not empty, and those with the expected source."""
    return t.documents.agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 0).alias("n_answered"), F.count_if(F.col("source") == "src1").alias("n_expected"))


@query("SELECT user_id FROM (SELECT user_id, max(ts) FILTER (event_type = 'signup') AS a, max(ts) FILTER (event_type = 'error') AS b FROM events GROUP BY 1) WHERE a IS NOT NULL AND (b IS NULL OR b < a)")
def active_packages(t):
    """Subjects whose last approval is later than their last failure."""
    last = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("ts")))
    return t.events.groupBy("user_id").agg(last("signup").alias("a"), last("error").alias("b")).where("a IS NOT NULL AND (b IS NULL OR b < a)").select("user_id")


@query("SELECT r.r_name, d.kind, count(*) AS n FROM region r JOIN nation ON n_regionkey = r_regionkey JOIN (SELECT c_nationkey AS k, 'customer' AS kind FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier) d ON d.k = n_nationkey GROUP BY CUBE (r.r_name, d.kind)")
def coverage_cube(t):
    """Coverage by place and kind with all subtotals."""
    d = t.customer.select(F.col("c_nationkey").alias("n_nationkey"), F.lit("customer").alias("kind")).unionAll(t.supplier.select("s_nationkey", F.lit("supplier")))
    # Counted before the joins: as many rows as nations and kinds.
    d = d.groupBy("n_nationkey", "kind").agg(F.count("*").alias("c"))
    n = t.nation.join(F.broadcast(t.region), F.col("r_regionkey") == F.col("n_regionkey"))  # a fixed list of regions
    return d.join(n, "n_nationkey").cube("r_name", "kind").agg(F.sum("c").alias("n"))


@query("SELECT o_orderkey AS k, 'removed' AS change FROM orders WHERE o_orderkey % 100 = 0 UNION ALL SELECT o_orderkey, 'changed' FROM orders WHERE o_orderkey % 100 = 1")
def attribution_rebuild(t):
    """What a rebuild from the originals gives otherwise than the package holds."""
    old = t.orders.select("o_orderkey", "o_totalprice")
    new = old.where("o_orderkey % 100 <> 0").withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderkey") % 100 == 1, 1.0).otherwise(0.0))
    j = old.select("o_orderkey", F.col("o_totalprice").alias("a")).join(new.select("o_orderkey", F.col("o_totalprice").alias("b")), "o_orderkey", "full")
    return j.where(~F.col("a").eqNullSafe(F.col("b"))).select(F.col("o_orderkey").alias("k"), F.when(F.col("b").isNull(), "removed").otherwise("changed").alias("change"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey) = 1")
def single_candidates(t):
    """Rows that are the only one of their group, by a join on counts instead of a window over hot groups."""
    one = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.first(F.struct("l_linenumber", "l_quantity")).alias("r")).where("n = 1")
    return one.select("l_orderkey", "r.l_linenumber", "r.l_quantity")


@query("SELECT count(*) AS n FROM (SELECT DISTINCT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels)")
def intersections(t):
    """Ids that two sets share."""
    return t.documents.where("lang = 'en'").select("doc_id").intersect(t.labels.select("doc_id")).agg(F.count("*").alias("n"))


@query("SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS r FROM documents) WHERE r <= 2")
def latest_generations(t):
    """The last two generations of each source."""
    return R.strata(t.documents.select("source", "doc_id", "n_chars"), ["source"], [F.desc("doc_id")], 2).select("source", "doc_id", "n_chars")
