"""Extraction and validation on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog.registry import query
from tessera.operators import extraction as X
from tessera.operators import validation as V


@query("SELECT doc_id, length(text) AS covered FROM documents WHERE length(text) > 0")
def structural_segments_cover(t):
    """Structural segments of each document cover every character."""
    return X.segment_table(t.texts(), "doc_id", "text", 1500).groupBy("doc_id").agg(F.sum(F.col("end") - F.col("start")).cast("long").alias("covered"))


@query(None)
def source_anchors(t):
    """Sentences, bullets and headings with exact offsets, counted by kind."""
    return X.anchor_table(t.texts(), "doc_id", "text").groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_documents"))


@query("SELECT item_id, 0 AS start, length(text) AS \"end\" FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT item_id, 3, length(text) + 3 FROM benchmark WHERE item_id % 2 = 1")
def span_recover_normalised(t):
    """Quotes found again although their white space was changed."""
    k = F.col("item_id") % 2 == 0
    quote = F.when(k, F.regexp_replace("text", " ", " \n")).otherwise(F.col("text"))
    pairs = t.benchmark.select("item_id", quote.alias("quote"), F.when(k, F.col("text")).otherwise(F.concat(F.lit("zz "), F.col("text"))).alias("page"))
    return X.recover_table(pairs, "quote", "page").select("item_id", "start", "end")


@query("""WITH RECURSIVE o AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(coalesce(text, ''))) AS r FROM conversations),
f AS (SELECT conv_id, turn, r, n AS used, 0 AS w FROM o WHERE r = 1 UNION ALL SELECT o.conv_id, o.turn, o.r, CASE WHEN used = 0 OR used + o.n <= 600 THEN used + o.n ELSE o.n END, CASE WHEN used = 0 OR used + o.n <= 600 THEN w ELSE w + 1 END FROM f JOIN o ON o.conv_id = f.conv_id AND o.r = f.r + 1)
SELECT conv_id, turn, w AS "window" FROM f""")
def window_packing(t):
    """Consecutive turns of a conversation packed into windows of 600 characters."""
    c = t.conversations.withColumn("n", F.length(F.coalesce("text", F.lit(""))))
    return X.pack_windows(c, "conv_id", ["turn"], "n", 600)


@query("""WITH s AS (SELECT doc_id % 50 AS d, min(doc_id) AS start FROM documents GROUP BY doc_id % 50, doc_id // 100), h AS (SELECT conv_id % 50 AS d, conv_id * 10 + turn AS start, 'h' || (conv_id * 10 + turn) AS label FROM conversations)
SELECT s.d, s.start, (SELECT arg_max(h.label, h.start) FROM h WHERE h.d = s.d AND h.start <= s.start) AS heading FROM s""")
def nearest_heading(t):
    """The last heading at or before each span."""
    s = t.documents.groupBy((F.col("doc_id") % 50).alias("d"), F.floor(F.col("doc_id") / 100).alias("g")).agg(F.min("doc_id").alias("start")).select("d", "start")
    at = F.col("conv_id") * 10 + F.col("turn")
    h = t.conversations.select((F.col("conv_id") % 50).alias("d"), at.alias("start"), F.concat(F.lit("h"), at).alias("label"))
    return X.nearest_heading(s, h, "d", "label", "heading")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, list_filter(['quantity', 'discount', 'flag'], lambda x: (x = 'quantity' AND l_quantity > 40) OR (x = 'discount' AND l_discount > 0.08) OR (x = 'flag' AND l_returnflag = 'R')) AS errors,
  CASE WHEN l_quantity > 40 OR l_discount > 0.08 THEN 'REJECTED' WHEN l_returnflag = 'R' THEN 'REVIEW_REQUIRED' ELSE 'VALIDATED' END AS status FROM lineitem""")
def statement_validation(t):
    """All broken rules of each candidate, and its status."""
    bad = {"quantity": F.col("l_quantity") > 40, "discount": F.col("l_discount") > 0.08}
    look = {"flag": F.col("l_returnflag") == "R"}
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.concat(V.reasons(bad), V.reasons(look)).alias("errors"), V.status(V.reasons(bad), V.reasons(look)).alias("status"))


@query("SELECT 'o' || o_orderkey AS subject, 'placedBy' AS relation, 'c' || o_custkey AS object FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment <> 'BUILDING'")
def endpoint_matrix(t):
    """Edges whose endpoint classes a relation does not allow."""
    e = t.orders.select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("subject"), F.lit("placedBy").alias("relation"), F.concat(F.lit("c"), F.col("o_custkey")).alias("object"))
    classes = t.customer.select(F.concat(F.lit("c"), F.col("c_custkey")).alias("entity"), F.col("c_mktsegment").alias("class")).unionAll(t.orders.select(F.concat(F.lit("o"), F.col("o_orderkey")), F.lit("Order")))
    return V.endpoint_errors(e, classes, [("placedBy", "Order", "BUILDING")])


@query("""SELECT 'r' || r_regionkey AS node FROM region WHERE r_regionkey = 1 UNION ALL SELECT 'n' || n_nationkey FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 's' || s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 1""")
def dependency_cascade(t):
    """Everything that depends, directly or not, on a rejected node."""
    name = lambda k, c: F.concat(F.lit(k), F.col(c))
    d = t.nation.select(name("n", "n_nationkey").alias("node"), name("r", "n_regionkey").alias("depends_on")).unionAll(t.supplier.select(name("s", "s_suppkey"), name("n", "s_nationkey")))
    return V.cascade(t.region.where("r_regionkey = 1").select(name("r", "r_regionkey").alias("node")), d)


@query("SELECT conv_id AS path, 'TOO_LONG' AS error FROM conversations GROUP BY conv_id HAVING count(*) > 5")
def membership_paths(t):
    """Paths that are too long; all steps are connected and known."""
    c = t.conversations.select("conv_id", "turn", F.concat_ws("-", "conv_id", F.col("turn").cast("string")).alias("a"), F.concat_ws("-", "conv_id", (F.col("turn") + 1).cast("string")).alias("b"))
    edges = c.select(F.col("a").alias("subject"), F.col("b").alias("object"))
    return V.path_errors(c, edges, "conv_id", "turn", "a", "b").withColumnRenamed("conv_id", "path")


@query("SELECT doc_id, CASE WHEN n = 1 THEN m END AS label_of FROM documents LEFT JOIN (SELECT n_chars, count(*) AS n, min(doc_id) AS m FROM documents WHERE doc_id % 2 = 0 GROUP BY 1) USING (n_chars)")
def unique_source_row(t):
    """The one source row with the same key, if there is just one."""
    right = t.documents.where("doc_id % 2 = 0").select("n_chars", F.col("doc_id").alias("label_of"))
    return V.unique_match(t.documents.select("doc_id", "n_chars"), right, ["n_chars"], "label_of").select("doc_id", "label_of")


@query("SELECT source, lang, doc_id, CASE WHEN row_number() OVER w > 1 THEN first(doc_id) OVER w END AS duplicate_of, row_number() OVER w = 1 AS active FROM documents WINDOW w AS (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id)")
def consolidate_variants(t):
    """One active assertion per identity; variants point to it."""
    return V.consolidate(t.documents, ["source", "lang"], [F.desc("n_chars"), F.asc("doc_id")], "doc_id").select("source", "lang", "doc_id", "duplicate_of", "active")


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents e WHERE e.doc_id % 3 = 0 AND e.source = d.source AND lower(trim(regexp_replace(e.text, '\\s+', ' ', 'g'))) = lower(trim(regexp_replace(d.text, '\\s+', ' ', 'g'))))")
def statement_omissions(t):
    """Statements that nothing extracted from their source repeats."""
    return V.omissions(t.documents.select("doc_id", "source", "text"), t.documents.where("doc_id % 3 = 0").select("source", "text"), "source", "text").select("doc_id")


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'junk' WHEN n_chars < 300 THEN 'short' ELSE 'document' END AS scope FROM documents LEFT JOIN labels USING (doc_id)")
def ordered_applicability(t):
    """The first scope that applies."""
    j = t.documents.join(t.labels, "doc_id", "left")
    return j.select("doc_id", V.coalesce_ordered([(F.col("toxic") == 1, "toxic"), (F.col("quality") == 0, "junk"), (F.col("n_chars") < 300, "short")], "document").alias("scope"))


@query("SELECT p_type AS class, CASE WHEN p_type LIKE '%BRASS%' THEN 'observations' WHEN p_type LIKE '%STEEL%' THEN 'conditions' ELSE 'other' END AS slot, count(*) AS n, list_sort(list(DISTINCT p_brand))[1:2] AS brands FROM part GROUP BY ALL")
def bundle_slots(t):
    """Records routed to the slots of an answer by their class."""
    slot = F.when(F.col("p_type").contains("BRASS"), "observations").when(F.col("p_type").contains("STEEL"), "conditions").otherwise("other")
    return t.part.groupBy(F.col("p_type").alias("class"), slot.alias("slot")).agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set("p_brand")), 1, 2).alias("brands"))


@query("SELECT n_name AS concept, n_name || '; ' || lower(n_name) || '; in ' || r_name AS description FROM nation JOIN region ON r_regionkey = n_regionkey")
def concept_texts(t):
    """A concept's label, aliases and note as one text."""
    n = t.nation.join(F.broadcast(t.region), F.col("r_regionkey") == F.col("n_regionkey"))  # a fixed list of regions
    return n.select(F.col("n_name").alias("concept"), F.concat_ws("; ", "n_name", F.lower("n_name"), F.concat(F.lit("in "), F.col("r_name"))).alias("description"))


@query("SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'broken' WHEN o_totalprice > 150000 THEN 'projected' ELSE 'unresolved' END AS route, count(*) OVER (PARTITION BY CASE WHEN c_custkey IS NULL THEN 'broken' WHEN o_totalprice > 150000 THEN 'projected' ELSE 'unresolved' END) AS n FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 10 <> 0")
def projection_report(t):
    """Conditions as projected, unresolved or broken, with the report's counts."""
    c = t.customer.where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("known"))
    route = F.when(F.col("known").isNull(), "broken").when(F.col("o_totalprice") > 150000, "projected").otherwise("unresolved")
    rows = t.orders.join(c, "o_custkey", "left").select("o_orderkey", route.alias("route"))
    # Counts are joined on, so that no route is gathered in one window.
    return rows.join(F.broadcast(rows.groupBy("route").agg(F.count("*").alias("n"))), "route").select("o_orderkey", "route", "n")  # three rows


@query("SELECT i, axis, v::DOUBLE AS value, u AS unit FROM (VALUES (1, 'thickness', 3, 'mm'), (1, 'width', 2.5, 'cm'), (2, 'length', 10, 'm')) t(i, axis, v, u)")
def specimen_dimensions(t):
    """Extents of specimens from phrases; units that are no lengths are no extents."""
    from tessera.functions import numeric

    rows = t.spark.createDataFrame([(1, "Sheets 3 mm thick and 2.5 cm wide"), (2, "a rod, 10 m long, burned 5 s long"), (3, None)], "i int, s string")
    return rows.select("i", F.explode(numeric.dimensions(F.col("s"))).alias("d")).select("i", "d.axis", "d.value", "d.unit")


@query("SELECT h AS header, CASE WHEN h LIKE '%:%' THEN 'Group A' END AS \"group\", CASE WHEN h LIKE '%:%' THEN 'PMMA' ELSE h END AS name FROM (VALUES ('Group A: PMMA'), ('Oxygen')) v(h)")
def header_bindings(t):
    """Group and name of typed headers."""
    from tessera.functions import numeric

    rows = t.spark.createDataFrame([("Group A: PMMA",), ("Oxygen",)], "header string")
    return rows.select("header", numeric.header_binding(F.col("header")).alias("b")).select("header", "b.group", "b.name")


@query("""SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'MISSING_SOURCE' WHEN o_orderkey % 9 = 0 THEN 'MISSING_PASSAGE' WHEN o_orderkey % 10 = 3 THEN 'CHECKSUM_MISMATCH' WHEN o_totalprice < 5000 THEN 'REVISE' ELSE 'VERIFIED' END AS status
FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 20 <> 0""")
def source_reconstruction(t):
    """Whether a record can be rebuilt from its source, or the first reason why not."""
    k = F.col("o_orderkey")
    source = t.customer.where("c_custkey % 20 <> 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("has_source"))
    passage = t.orders.where("o_orderkey % 9 <> 0").select("o_orderkey", F.sha2(F.col("o_totalprice").cast("string"), 256).alias("found"))
    kept = F.sha2((F.col("o_totalprice") + F.when(k % 10 == 3, 1).otherwise(0)).cast("string"), 256)
    j = t.orders.join(source, "o_custkey", "left").join(passage, "o_orderkey", "left")
    return j.select("o_orderkey", V.coalesce_ordered([(F.col("has_source").isNull(), "MISSING_SOURCE"), (F.col("found").isNull(), "MISSING_PASSAGE"), (F.col("found") != kept, "CHECKSUM_MISMATCH"), (F.col("o_totalprice") < 5000, "REVISE")], "VERIFIED").alias("status"))


@query("""WITH s AS (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[0-9]'))) AS cues, len(string_split(text, chr(10))) AS n FROM documents)
SELECT CASE WHEN cues = 0 THEN 'NO_CUES' WHEN cues * 2 >= n THEN 'DENSE' ELSE 'SPARSE' END AS state, count(*) AS n_documents, sum(cues)::BIGINT AS n_cues FROM s GROUP BY 1""")
def extraction_coverage(t):
    """Documents by how many of their lines hold a quantity cue."""
    lines = F.split("text", "\n")
    s = t.texts().select(F.size(F.filter(lines, lambda x: x.rlike("[0-9]"))).alias("cues"), F.size(lines).alias("n"))
    state = F.when(F.col("cues") == 0, "NO_CUES").when(F.col("cues") * 2 >= F.col("n"), "DENSE").otherwise("SPARSE")
    return s.groupBy(state.alias("state")).agg(F.count("*").alias("n_documents"), F.sum("cues").alias("n_cues"))
