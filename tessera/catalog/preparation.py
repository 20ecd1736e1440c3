"""Preparing sources for review, publication, and questions read in batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog.registry import query
from tessera.functions import text as X
from tessera.operators import preparation as P


def _str(name: str):
    return F.col(name).cast("string")


def _pick(values, index):
    return F.get(F.array(*[v if hasattr(v, "cast") else F.lit(v) for v in values]), index.cast("int"))


@query("""SELECT page_id, starts_with(url, 'https://') AND regexp_matches(url, '^https://www\\.') AND page_id % 4 <> 1 AND page_id % 3 = 0 AND page_id % 5 <> 0 AS eligible FROM pages""")
def public_downloads(t):
    """Files that may be fetched, by scheme, host, path, kind and draft."""
    k = F.col("page_id")
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    official = F.when(F.startswith(host, F.lit("www.")), F.lit("www.records.example")).otherwise(host)
    path = F.concat(F.lit("/api/"), F.when(k % 4 == 1, F.lit("other")).otherwise(_str("page_id")), F.lit("/file"))
    url = F.concat(F.regexp_extract("url", "^([a-z]+://)", 1), official, path, F.lit("?download=1"))
    kind = F.when(k % 3 == 0, "application/pdf").otherwise("text/html")
    return t.pages.select("page_id", P.public_download(url, kind, k % 5 == 0, "www.records.example", F.concat(F.lit("/api/"), _str("page_id"), F.lit("/"))).alias("eligible"))


@query("SELECT user_id, event_type, arg_max(props, (ts, event_id)) AS props FROM events GROUP BY 1, 2")
def cache_latest(t):
    """A cache by key and kind: what was put last."""
    return P.cached(t.events.select("user_id", "event_type", "props", "ts", "event_id"), ["user_id", "event_type"], "props", ["ts", "event_id"])


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 OR contains(lower(text), 'the') OR contains(lower(text), 'than') THEN '' ELSE 'low,micro' END AS preferred FROM conversations WHERE text IS NOT NULL")
def context_policy(t):
    """What a search prefers by default, unless the question names a value or compares."""
    p = P.default_preference(F.col("turn") % 3 == 0, F.col("text"), ["the", "than"], ["low", "micro"])
    return t.conversations.where("text IS NOT NULL").select("conv_id", "turn", F.array_join(p, ",").alias("preferred"))


@query("""WITH last AS (SELECT p_type AS term, arg_max(p_size, p_partkey) AS definition, arg_max(p_partkey % 4, p_partkey) AS s FROM part GROUP BY 1), known AS (SELECT p_type AS term, min(p_size) AS d FROM part WHERE p_type < 'P' GROUP BY 1)
SELECT term, definition::VARCHAR AS definition, CASE WHEN s = 0 THEN 'PENDING' WHEN d IS NULL THEN 'ACTIVE' WHEN d = definition THEN 'UNCHANGED' ELSE 'CONFLICT' END AS state FROM last LEFT JOIN known USING (term)""")
def extension_activation(t):
    """Proposed terms by their last revision: active, unchanged, in conflict or pending."""
    proposals = t.part.select(F.col("p_type").alias("term"), _str("p_size").alias("definition"), F.when(F.col("p_partkey") % 4 == 0, "REVIEW").otherwise("APPROVED").alias("status"), F.col("p_partkey").alias("revision"))
    known = t.part.where("p_type < 'P'").groupBy(F.col("p_type").alias("term")).agg(F.min("p_size").cast("string").alias("definition"))
    return P.activate(proposals, known)


@query("""SELECT item_id, CASE WHEN item_id % 9 = 8 THEN 4 WHEN item_id % 3 = 0 AND item_id % 6 <> 3 THEN 1 WHEN item_id % 2 = 1 THEN 3 ELSE 2 END AS tier, CASE WHEN item_id % 9 <> 8 AND item_id % 3 = 0 AND item_id % 6 <> 3 THEN 'R' || item_id END AS record FROM benchmark""")
def approved_replay(t):
    """Candidates by tier; those that repeat an approved record on known evidence are replayed under its identity."""
    k = F.col("item_id")
    approved = t.benchmark.where("item_id % 3 = 0").select(F.concat(F.lit("R"), _str("item_id")).alias("record"), F.lit("Statement").alias("class"), F.concat(F.lit(" "), F.regexp_replace("text", " ", "  ")).alias("text"), F.when(k % 6 == 3, F.array(_str("item_id"), F.lit("lost"))).otherwise(F.array(_str("item_id"))).alias("refs"))
    candidates = t.benchmark.select("item_id", F.lit("Statement").alias("class"), "text", _str("item_id").alias("ref"), F.when(k % 2 == 1, "UNRESOLVED_GROUP").otherwise("GROUP").alias("scope"), F.when(k % 9 == 8, "BAD_QUOTE").alias("error"))
    return P.replay(candidates, approved, t.benchmark.select(_str("item_id").alias("ref"))).select("item_id", "tier", "record")


_TERMS = ("Then", "einer", "Tion", "the", "mentre")


@query("SELECT doc_id, list_filter(['einer', 'mentre', 'then', 'tion'], lambda x: contains(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), x)) AS terms FROM documents WHERE text IS NOT NULL")
def discovered_terms(t):
    """Registered terms that a text has, spelling apart."""
    return t.texts().where("text IS NOT NULL").select("doc_id", P.recognised_terms(F.col("text"), list(_TERMS)).alias("terms"))


def _tables(t):
    """A table of three rows for each part: headers with units, labels, numbers and words."""
    s = lambda n: (F.col("p_size") + n).cast("string")
    head = F.array(F.lit("name"), F.lit("width (mm)"), F.lit("note"), F.lit("span (big)"))
    one = F.array(F.lit("first"), s(0), F.col("p_name"), F.concat(s(1), F.lit(" - "), s(3)))
    two = F.array(F.lit("second (s)"), F.concat(F.lit("~"), s(2)), F.lit("n/a"), F.concat(F.lit("at least "), s(4)))
    return t.part.select("p_partkey", F.array(head, one, two).alias("cells"))


@query("""SELECT p_partkey, r.r AS "row", c.c AS "column", ['name', 'width (mm)', 'note', 'span (big)'][c.c + 1] AS header, ['first', 'second (s)'][r.r + 1] AS label,
  CASE r.r WHEN 0 THEN ['first', p_size::VARCHAR, p_name, (p_size + 1) || ' - ' || (p_size + 3)][c.c + 1] ELSE ['second (s)', '~' || (p_size + 2), 'n/a', 'at least ' || (p_size + 4)][c.c + 1] END AS value
FROM part, range(2) AS r(r), range(4) AS c(c)""")
def table_records(t):
    """Cells of tables with their header and row label."""
    return P.table_records(_tables(t), "p_partkey", "cells")


@query("""SELECT p_partkey, 0 AS "row", 1 AS "column", p_size::VARCHAR AS value, 'mm' AS unit FROM part UNION ALL SELECT p_partkey, 0, 3, (p_size + 1) || ' - ' || (p_size + 3), NULL FROM part
UNION ALL SELECT p_partkey, 1, 1, '~' || (p_size + 2), NULL FROM part UNION ALL SELECT p_partkey, 1, 3, 'at least ' || (p_size + 4), 's' FROM part""")
def table_quantities(t):
    """Cells that state a quantity, with the one unit that header or label spell."""
    return P.table_quantities(P.table_records(_tables(t), "p_partkey", "cells")).select("p_partkey", "row", "column", "value", "unit")


@query("""WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '[.!?]')) AS s, len(regexp_extract_all(text, '[0-9]+')) AS n, len(string_split(text, '|')) - 1 AS l, length(text) AS chars FROM documents WHERE text IS NOT NULL),
x AS (SELECT *, greatest(1, s * 90 + n * 45 + l * 140) AS e FROM c)
SELECT doc_id, greatest(1000, least(41536, greatest(6000, ceil(chars / greatest(1, ceil(e / 39321.6))))))::BIGINT AS segment_chars, least(32768, greatest(4096, ceil((2200 + s * 120 + n * 90) / 1024.0) * 1024))::BIGINT AS output_tokens FROM x""")
def reading_sizes(t):
    """How a text is divided for a reader of bounded output, and what a part may take."""
    text = F.col("text")
    size = P.sizing(F.size(F.regexp_extract_all(text, F.lit("[.!?]"), F.lit(0))), F.size(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0))), F.size(F.split(text, "\\|")) - 1, F.length(text))
    return t.texts().where("text IS NOT NULL").select("doc_id", size.alias("s")).select("doc_id", "s.segment_chars", "s.output_tokens")


@query("""WITH b AS (SELECT doc_id, string_split(text, '') AS c, length(text) AS n FROM documents WHERE length(text) > 600),
x AS (SELECT doc_id, n, list_filter(range(150, n - 149), lambda p: c[p] = chr(10) OR (c[p - 1] IN ('.', '!', '?') AND c[p] IN (' ', chr(9), chr(10), chr(11), chr(12), chr(13)))) AS l FROM b)
SELECT doc_id, n, list_min(list_transform(l, lambda p: abs(p - n // 2) * 10000000 + p)) % 10000000 AS cut FROM x WHERE len(l) > 0""")
def window_halves(t):
    """Where long texts are cut in two."""
    return t.texts().select("doc_id", F.length("text").alias("n"), P.halved(F.col("text")).alias("cut")).where("cut IS NOT NULL")


@query("""SELECT o_orderkey, class, label FROM (SELECT o_orderkey, 'ExperimentalRun' AS class, 'A' || o_custkey AS label FROM orders WHERE o_orderkey % 4 = 0 UNION ALL SELECT o_orderkey, 'Sample', 'B' || o_custkey || '-2' FROM orders WHERE o_orderkey % 4 = 1
UNION ALL SELECT o_orderkey, 'Investigation', 'XYZ' || o_custkey FROM orders WHERE o_orderkey % 4 = 2 UNION ALL SELECT o_orderkey, 'ExperimentFamily', 'drop tests' FROM orders WHERE o_orderkey % 4 = 2)""")
def literal_names(t):
    """Names as sources spell them: runs, samples, investigations and families."""
    c = _str("o_custkey")
    forms = [F.concat(F.lit("In test No. A"), c, F.lit(" it burned; run A"), c, F.lit(" again.")), F.concat(F.lit("Specimen #B"), c, F.lit("-2 melted.")), F.concat(F.lit("The XYZ"), c, F.lit(" project ran drop tests.")), F.lit("Nothing is named in a run here.")]
    rows = t.orders.select("o_orderkey", _pick(forms, F.col("o_orderkey") % 4).alias("text"))
    return P.literal_names(rows, "o_orderkey", "text").select("o_orderkey", "class", "label")


@query("SELECT c_custkey, 'c_name = ' || c_name || CASE WHEN c_acctbal > 0 THEN '; c_note = good' ELSE '' END || '; c_nationkey = ' || c_nationkey AS said FROM customer")
def statement_renderers(t):
    """Rows as text: the fields that have a value."""
    rows = t.customer.withColumn("c_note", F.when(F.col("c_acctbal") > 0, "good"))
    return rows.select("c_custkey", P.rendered(["c_name", "c_note", "c_nationkey"]).alias("said"))


@query("""SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_nationkey":' || c_nationkey || '}') AS digest FROM customer""")
def identity_digests(t):
    """Digests of rows as JSON with keys in order."""
    return t.customer.select("c_custkey", P.identity_digest(["c_nationkey", "c_mktsegment", "c_custkey"]).alias("digest"))


@query("SELECT c_custkey, replace(c_name, '#', '%23') AS encoded, c_name AS decoded FROM customer")
def identity_uris(t):
    """Identities encoded for a URI, and back."""
    e = t.customer.select("c_custkey", F.url_encode("c_name").alias("encoded"))
    return e.withColumn("decoded", F.url_decode("encoded"))


@query("SELECT table_name, column_name, ordinal_position::INT AS position FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer', 'documents', 'labels')")
def catalog_probe(t):
    """Tables and their columns, as a probe finds them before a run."""
    names = ("region", "nation", "customer", "documents", "labels")
    rows = [(n, c, i + 1) for n in names for i, c in enumerate(getattr(t, n).columns)]
    return t.spark.createDataFrame(rows, "table_name string, column_name string, position int")


@query("""WITH m AS (SELECT i, md5('7|' || i) AS d FROM range(500) AS r(i)) SELECT i, 'property_' || d[9:16] AS name, ['mm', 's', 'kPa', '%'][('0x' || d[1:4])::INT % 4 + 1] AS unit, ('0x' || d[17:22])::INT % 10000 / 10 AS value FROM m""")
def stress_properties(t):
    """Made-up properties for stress tests, the same for the same seed."""
    return P.generated_properties(t.spark, 7, 500)


@query("""SELECT e.event_id, s.value AS last_purchase FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) s ON e.user_id = s.user_id AND e.ts >= s.ts""")
def asof_join(t):
    """Each event with the last purchase of its user up to then."""
    right = t.events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("value").alias("last_purchase"))
    return P.asof(t.events.select("user_id", "ts", "event_id"), right, ["user_id"], "ts", "at", ["last_purchase"]).select("event_id", "last_purchase")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 4 = 0 THEN 'draft' ELSE 'published' END AS origin FROM customer UNION ALL SELECT -1 - c_custkey, 0.0, 'draft' FROM customer WHERE c_custkey % 4 = 0")
def draft_preview(t):
    """What readers would see if a draft were published."""
    base = t.customer.select("c_custkey", "c_acctbal")
    changed = base.where("c_custkey % 4 = 0")
    draft = changed.withColumn("c_acctbal", F.col("c_acctbal") + 1).unionAll(changed.select((-1 - F.col("c_custkey")).alias("c_custkey"), F.lit(0.0).alias("c_acctbal")))
    return P.drafted(base, draft, ["c_custkey"])


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 5 = 1 OR o_totalprice > 300000 THEN 'REFUSED' WHEN o_orderkey % 3 = 0 THEN 'UNCHANGED' ELSE 'PUBLISH' END AS state,
  list_filter([CASE WHEN o_orderkey % 5 = 0 THEN 'NOT_APPROVED' END, CASE WHEN o_orderkey % 5 = 1 THEN 'DIGEST_MISMATCH' END, CASE WHEN o_totalprice > 300000 THEN 'SHAPES_VIOLATED' END], lambda x: x IS NOT NULL) AS errors FROM orders""")
def publication_gate(t):
    """Whether packages may be published: approved as they are, in shape, and not out already."""
    k, digest = F.col("o_orderkey"), F.md5(_str("o_totalprice"))
    p = t.orders.select("o_orderkey", digest.alias("digest"), F.when(k % 5 == 1, F.md5(F.lit("old"))).when(k % 5 != 0, digest).alias("approved_digest"), F.when(k % 3 == 0, digest).alias("current_digest"), (F.col("o_totalprice") > 300000).cast("int").alias("violations"))
    return P.publication(p).select("o_orderkey", "state", "errors")


@query("""WITH c AS (SELECT user_id % 50 AS k, event_type AS field, arg_max(props, event_id) AS v FROM events WHERE event_type <> 'view' GROUP BY ALL), p AS (SELECT c_custkey AS k, f.f AS field, c_name AS v FROM customer, (VALUES ('view'), ('purchase')) f(f) WHERE c_custkey < 60)
SELECT coalesce(p.k, c.k) AS k, coalesce(p.field, c.field) AS field, coalesce(c.v, p.v) AS value, c.v IS NOT NULL AS corrected FROM p FULL JOIN c ON p.k = c.k AND p.field = c.field""")
def regenerated_package(t):
    """A package anew: proposals, then corrections in order, field by field."""
    proposals = t.customer.where("c_custkey < 60").select(F.col("c_custkey").alias("k"), F.explode(F.array(F.lit("view"), F.lit("purchase"))).alias("field"), F.col("c_name").alias("value"))
    corrections = t.events.where("event_type <> 'view'").select((F.col("user_id") % 50).alias("k"), F.col("event_type").alias("field"), F.col("props").alias("value"), F.col("event_id").alias("seq"))
    return P.regenerated(proposals, corrections, ["k"])


@query("""WITH o AS (SELECT ['table_role', 'mapping', 'identity', 'context', 'scope'][p_partkey % 5 + 1] AS kind, p_brand AS subject FROM part), q AS (SELECT kind || ':' || subject AS question, kind, count(*) AS affected FROM o WHERE NOT (kind = 'mapping' AND subject LIKE '%1') GROUP BY ALL),
p AS (SELECT *, affected + CASE WHEN kind IN ('scope', 'identity') THEN 10 ELSE 0 END AS priority FROM q) SELECT *, row_number() OVER (ORDER BY priority DESC, question) AS position FROM p""")
def review_questions(t):
    """Questions of five kinds that a review has open, the weightiest first."""
    kind = _pick(["table_role", "mapping", "identity", "context", "scope"], F.col("p_partkey") % 5)
    items = t.part.select(kind.alias("kind"), F.col("p_brand").alias("subject"))
    decided = items.where("kind = 'mapping' AND subject LIKE '%1'").select(F.concat_ws(":", "kind", "subject").alias("question")).distinct()
    return P.review_questions(items, decided)


@query("""SELECT l_orderkey, l_linenumber, list_filter([CASE WHEN l_linenumber = 1 THEN 'NO_EVIDENCE' END, CASE WHEN l_linenumber = 2 THEN 'UNKNOWN_EVIDENCE' END, CASE WHEN l_returnflag = 'R' THEN 'UNREGISTERED_CLASS' END], lambda x: x IS NOT NULL) AS errors FROM lineitem""")
def entity_admission(t):
    """Why entities are not admitted: evidence and class."""
    n = F.col("l_linenumber")
    refs = F.when(n == 1, F.array().cast("array<string>")).when(n == 2, F.array(F.lit("a"), F.lit("z"))).otherwise(F.array(F.lit("a")))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("class"), refs.alias("refs"), F.array(F.lit("a"), F.lit("b")).alias("known_refs"))
    return rows.select("l_orderkey", "l_linenumber", P.admission_errors(["A", "N"]).alias("errors"))


@query("""WITH s AS (SELECT c_name AS requirement, ['SUPPORTED', 'MISSING', 'CONFLICTED', 'PARTIALLY_SUPPORTED', 'RELATED_ONLY'][c_custkey % 5 + 1] AS state FROM customer), a AS (SELECT requirement, CASE state WHEN 'CONFLICTED' THEN 'COMPARE' WHEN 'MISSING' THEN 'SEARCH' ELSE 'EXPAND' END AS action FROM s WHERE state <> 'SUPPORTED')
SELECT *, row_number() OVER (ORDER BY CASE action WHEN 'COMPARE' THEN 0 WHEN 'SEARCH' THEN 1 ELSE 2 END, requirement) AS position FROM a""")
def next_actions(t):
    """What an investigation does next about requirements that are not supported."""
    state = _pick(["SUPPORTED", "MISSING", "CONFLICTED", "PARTIALLY_SUPPORTED", "RELATED_ONLY"], F.col("c_custkey") % 5)
    return P.next_actions(t.customer.select(F.col("c_name").alias("requirement"), state.alias("state")))


@query("SELECT doc_id, CASE WHEN regexp_matches(lower(text), '\\b(the|der)\\b') THEN 'a' WHEN contains(lower(text), 'que') THEN 'b' ELSE 'none' END AS label FROM documents WHERE text IS NOT NULL")
def role_labels(t):
    """The first label whose pattern a text matches."""
    return t.texts().where("text IS NOT NULL").select("doc_id", X.first_label(F.col("text"), [("a", "\\b(the|der)\\b"), ("b", "que")], "none").alias("label"))
