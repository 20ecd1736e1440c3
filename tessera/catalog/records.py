"""Record keeping, deduplication, integrity and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog.registry import query
from tessera.operators import metrics as M
from tessera.operators import records as R


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY 1, 2")
def latest_version(t):
    """The latest event of each key."""
    return R.latest(t.events.select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"])


@query("SELECT user_id, CASE arg_max(event_type, (ts, event_id)) WHEN 'error' THEN 'REJECTED' WHEN 'purchase' THEN 'APPROVED' WHEN 'signup' THEN 'CREATED' ELSE 'PENDING' END AS state, count(*) AS n_decisions FROM events GROUP BY user_id")
def review_state(t):
    """Current review state from an append-only log of decisions."""
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    state = F.when(last == "error", "REJECTED").when(last == "purchase", "APPROVED").when(last == "signup", "CREATED").otherwise("PENDING")
    return t.events.groupBy("user_id").agg(state.alias("state"), F.count("*").alias("n_decisions"))


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer")
def upsert_latest(t):
    """A table after changes by key."""
    base = t.customer.select("c_custkey", "c_name", "c_acctbal")
    return R.upsert(base, base.where("c_custkey % 5 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1), ["c_custkey"])


@query("SELECT 'fresh' AS kind, count(*) AS n FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'conflict', count(*) FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 2 = 0")
def insert_if_absent(t):
    """New keys are inserted; known ones with another payload are conflicts."""
    base = t.customer.where("c_custkey % 3 <> 0").select("c_custkey", "c_name")
    new = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")).alias("c_name"))
    fresh, conflict = R.insert_if_absent(base, new, ["c_custkey"], F.col("c_name"), F.col("c_name"))
    return fresh.agg(F.count("*").alias("n")).select(F.lit("fresh").alias("kind"), "n").unionAll(conflict.agg(F.count("*").alias("n")).select(F.lit("conflict").alias("kind"), "n"))


@query("SELECT user_id, max(version) + 1 AS version FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version, event_type FROM events) GROUP BY user_id HAVING arg_max(event_type, version) <> 'view'")
def versioned_save(t):
    """The next version of packages whose content differs from their latest one; equal saves are no versions."""
    from pyspark.sql import Window

    history = t.events.select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("version"), F.col("event_type").alias("digest"))
    proposed = history.select("user_id").distinct().withColumn("digest", F.lit("view"))
    return R.next_versions(history, proposed, ["user_id"], "digest").select("user_id", "version")


@query("SELECT source, n_chars, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1, 2 HAVING count(*) > 1")
def dedupe_groups(t):
    """Groups with the same key, null-aware."""
    return R.duplicates(t.documents, ["source", "n_chars"], "doc_id")


@query("WITH s AS (SELECT text, arg_min(doc_id, (CASE WHEN toxic IS NOT NULL THEN 0 WHEN source LIKE 'src1%' THEN 1 ELSE 2 END, doc_id)) AS survivor FROM documents LEFT JOIN labels USING (doc_id) GROUP BY text) SELECT doc_id, survivor FROM documents JOIN s USING (text)")
def dedupe_survivor(t):
    """Of equal texts, one survives: referenced first, then a preferred source, then the least id; all point to it."""
    d = t.documents.select("doc_id", "source", F.unhex(F.sha2("text", 256)).alias("digest")).join(t.labels.select("doc_id", "toxic"), "doc_id", "left")
    return R.survivors(d, ["digest"], "doc_id", F.when(F.col("toxic").isNotNull(), 0).when(F.col("source").startswith("src1"), 1).otherwise(2))


@query("""SELECT 'items_without_order' AS check_name, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'items_without_part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'orders_without_customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'customers_without_nation', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)
UNION ALL SELECT 'orders_without_items', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'labels_without_document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'negative_prices', count(*) FROM lineitem WHERE l_extendedprice < 0""")
def integrity_report(t):
    """Seven checks, each the number of offending rows."""
    return R.report({
        "items_without_order": R.missing_keys(t.lineitem, t.orders, "l_orderkey", "o_orderkey"),
        "items_without_part": R.missing_keys(t.lineitem, t.part, "l_partkey", "p_partkey"),
        "orders_without_customer": R.missing_keys(t.orders, t.customer, "o_custkey", "c_custkey"),
        "customers_without_nation": R.missing_keys(t.customer, t.nation, "c_nationkey", "n_nationkey"),
        "orders_without_items": R.missing_keys(t.orders, t.lineitem, "o_orderkey", "l_orderkey"),
        "labels_without_document": R.missing_keys(t.labels, t.documents, "doc_id", "doc_id"),
        "negative_prices": t.lineitem.where("l_extendedprice < 0"),
    })


@query("SELECT source, lang, count(*) AS n, count(toxic) AS n_labelled, sum(n_chars) AS chars FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ROLLUP (source, lang)")
def corpus_statistics(t):
    """Counts by source and language, with subtotals."""
    return t.documents.join(t.labels, "doc_id", "left").rollup("source", "lang").agg(F.count("*").alias("n"), F.count("toxic").alias("n_labelled"), F.sum("n_chars").alias("chars"))


@query("SELECT l_partkey, l_suppkey, list_sort(list(DISTINCT l_returnflag)) AS flags FROM lineitem GROUP BY 1, 2")
def relation_set_merge(t):
    """Relations merged by identity, with the sorted union of their evidence."""
    return R.set_merge(t.lineitem.select("l_partkey", "l_suppkey", F.array("l_returnflag").alias("f")), ["l_partkey", "l_suppkey"], "f", "flags")


@query("SELECT user_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def exclusions_last_write(t):
    """The last write of each key wins."""
    return t.events.groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


@query("SELECT id, min(slot) AS slot FROM (SELECT doc_id AS id, 1 AS slot FROM documents WHERE lang = 'en' UNION ALL SELECT vec_id, 2 FROM embeddings UNION ALL SELECT doc_id, 3 FROM labels) GROUP BY id")
def bundle_merge(t):
    """A union by identity in which the first slot that has an item keeps it."""
    u = t.documents.where("lang = 'en'").select(F.col("doc_id").alias("id"), F.lit(1).alias("slot")).unionAll(t.embeddings.select("vec_id", F.lit(2))).unionAll(t.labels.select("doc_id", F.lit(3)))
    return u.groupBy("id").agg(F.min("slot").alias("slot"))


@query("SELECT uses, count(*) AS n FROM (SELECT l_partkey, count(*) AS uses FROM lineitem GROUP BY 1) GROUP BY uses")
def reuse_histogram(t):
    """How many candidates are used how often."""
    return t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("uses")).groupBy("uses").agg(F.count("*").alias("n"))


@query("SELECT a.status AS status_before, b.status AS status_after, count(*) AS n FROM (SELECT doc_id, CASE quality WHEN 1 THEN 'ok' ELSE 'bad' END AS status FROM labels) a FULL JOIN (SELECT doc_id, CASE WHEN n_chars > 1000 THEN 'long' ELSE 'short' END AS status FROM documents WHERE doc_id % 2 = 0) b ON a.doc_id = b.doc_id GROUP BY ALL")
def status_deltas(t):
    """Transitions of status between two states of a table."""
    a = t.labels.select("doc_id", F.when(F.col("quality") == 1, "ok").otherwise("bad").alias("s"))
    b = t.documents.where("doc_id % 2 = 0").select("doc_id", F.when(F.col("n_chars") > 1000, "long").otherwise("short").alias("s"))
    return R.status_changes(a, b, "doc_id", "s")


@query("SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR)) AS position FROM documents QUALIFY position <= 3")
def stratified_review_packet(t):
    """Three documents of each source in an order that ids decide."""
    return R.strata(t.documents.select("source", "doc_id"), ["source"], [F.md5(F.col("doc_id").cast("string"))], 3)


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY lang, doc_id LIMIT 30")
def holdout_selection(t):
    """A deterministic holdout without what was exposed."""
    return t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left_anti").orderBy("lang", "doc_id").limit(30)


@query("SELECT source, sha256(string_agg(doc_id || '|' || sha256(text), chr(10) ORDER BY doc_id)) AS digest FROM documents GROUP BY source")
def corpus_digest(t):
    """One digest per source over its documents' digests in order of id."""
    lines = t.documents.select("source", F.struct("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("|"), F.sha2("text", 256)).alias("line")).alias("x"))
    return lines.groupBy("source").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n"), 256).alias("digest"))


@query("""SELECT source, count(*) AS n_documents, count(toxic) AS n_labelled, CASE WHEN count(toxic) > 22 THEN 'STRUCTURED' WHEN count(toxic) > 0 THEN 'PARSED' ELSE 'ACQUIRED' END AS state FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def source_coverage(t):
    """How far each source has come."""
    n = F.count("toxic")
    return t.documents.join(t.labels, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n_documents"), n.alias("n_labelled"), F.when(n > 22, "STRUCTURED").when(n > 0, "PARSED").otherwise("ACQUIRED").alias("state"))


@query("SELECT event_type, count(value) AS n, round(median(value), 9) AS median, quantile_disc(value, 0.95) AS p95, max(value) AS maximum FROM events GROUP BY event_type")
def latency_percentiles(t):
    """Median, nearest-rank 95th percentile and maximum per group."""
    return M.latency(t.events, "value", ["event_type"]).withColumn("median", F.round("median", 9))


@query("""WITH s AS (SELECT source, count(*) FILTER (toxic = 1) AS k, count(toxic) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)
SELECT source, k, n, round(k / n, 9) AS estimate, round(greatest(0, (k / n + 3.8414588206941254 / (2 * n)) / (1 + 3.8414588206941254 / n) - 1.959963984540054 * sqrt(k / n * (1 - k / n) / n + 3.8414588206941254 / (4 * n * n)) / (1 + 3.8414588206941254 / n)), 9) AS wilson_low,
  round(least(1, (k / n + 3.8414588206941254 / (2 * n)) / (1 + 3.8414588206941254 / n) + 1.959963984540054 * sqrt(k / n * (1 - k / n) / n + 3.8414588206941254 / (4 * n * n)) / (1 + 3.8414588206941254 / n)), 9) AS wilson_high,
  CASE WHEN n = 0 THEN 'NOT_APPLICABLE' WHEN n < 10 THEN 'SMALL_N' ELSE 'MEASURED' END AS status FROM s""")
def wilson_interval(t):
    """Proportions with 95 % intervals."""
    s = t.documents.join(t.labels, "doc_id", "left").groupBy("source").agg(F.count_if(F.col("toxic") == 1).alias("k"), F.count("toxic").alias("n"))
    return s.select("source", "k", "n", *[c if i == 3 else F.round(c, 9).alias(name) for i, (c, name) in enumerate(zip(M.proportion("k", "n"), ("estimate", "wilson_low", "wilson_high", "status"), strict=True))])


_PAIRS = "WITH p AS (SELECT CASE WHEN n_chars > 2000 THEN 'a' WHEN n_chars > 700 THEN 'b' ELSE 'c' END AS e, CASE doc_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'd' END AS a FROM documents)"


def _pairs(t):
    n, k = F.col("n_chars"), F.col("doc_id") % 3
    return t.documents.select(F.when(n > 2000, "a").when(n > 700, "b").otherwise("c").alias("e"), F.when(k == 0, "a").when(k == 1, "b").otherwise("d").alias("a"))


@query(_PAIRS + """, c AS (SELECT c, count(*) FILTER (e = c) AS ne, count(*) FILTER (a = c) AS na, count(*) FILTER (e = c AND a = c) AS tp FROM p, (VALUES ('a'), ('b'), ('c'), ('d')) v(c) GROUP BY c),
s AS (SELECT CASE WHEN na > 0 THEN tp / na ELSE 0 END AS p, CASE WHEN ne > 0 THEN tp / ne ELSE 0 END AS r FROM c)
SELECT round(avg(p), 9) AS precision, round(avg(r), 9) AS recall, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 9) AS f1, count(*) AS n_classes FROM s""")
def prf1_macro(t):
    """Macro precision, recall and F1."""
    return M.macro(M.class_scores(_pairs(t), "e", "a")).select(*[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "n_classes")


@query(_PAIRS + " SELECT e AS expected, a AS actual, count(*) AS n FROM p GROUP BY ALL")
def status_matrix(t):
    """Expected against actual status."""
    return _pairs(t).groupBy(F.col("e").alias("expected"), F.col("a").alias("actual")).agg(F.count("*").alias("n"))


_SETS = "WITH x AS (SELECT list_distinct([doc_id % 2, doc_id % 3, doc_id % 5]) AS e, list_distinct([doc_id % 2, doc_id % 7]) AS a FROM documents), c AS (SELECT len(list_intersect(e, a)) AS tp, len(list_filter(a, lambda v: NOT list_contains(e, v))) AS fp, len(list_filter(e, lambda v: NOT list_contains(a, v))) AS fn FROM x)"


def _sets(t):
    k = F.col("doc_id")
    e, a = F.array_distinct(F.array(k % 2, k % 3, k % 5)), F.array_distinct(F.array(k % 2, k % 7))
    return t.documents.select(M.set_scores(e, a).alias("s")).select("s.*")


@query(_SETS + " SELECT tp, fp, fn, count(*) AS n FROM c GROUP BY ALL")
def field_scores(t):
    """Hits, extras and misses of sets."""
    return _sets(t).groupBy("tp", "fp", "fn").agg(F.count("*").alias("n"))


@query(_SETS + ", s AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM c) SELECT round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM s")
def intent_scores(t):
    """Micro precision, recall and F1 of sets."""
    return M.prf(_sets(t), "tp", "fp", "fn").select(*[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("SELECT count(*) AS generated, count(*) FILTER (quality = 1) AS accepted, round(count(*) FILTER (quality = 1 AND n_chars > 500) / count(*) FILTER (quality = 1), 9) AS citation_coverage, round(count(*) FILTER (quality = 1 AND n_chars > 500 AND toxic = 0) / count(*) FILTER (quality = 1 AND n_chars > 500), 9) AS evidence_validity FROM labels JOIN documents USING (doc_id)")
def claim_metrics(t):
    """Coverage and validity of citations among accepted claims."""
    j = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")
    ok, cited, valid = F.col("quality") == 1, F.col("n_chars") > 500, F.col("toxic") == 0
    return j.agg(F.count("*").alias("generated"), F.count_if(ok).alias("accepted"), F.round(F.count_if(ok & cited) / F.count_if(ok), 9).alias("citation_coverage"), F.round(F.count_if(ok & cited & valid) / F.count_if(ok & cited), 9).alias("evidence_validity"))


@query("SELECT lang AS kind, round(count(*) FILTER (quality = 1 AND toxic = 0) / count(*) FILTER (quality = 1), 9) AS recall, round(count(*) FILTER (quality = 1 AND toxic = 0) / count(*) FILTER (toxic = 0), 9) AS precision, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def review_scores(t):
    """Recall and precision of reviews by kind."""
    j = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id")
    both, q, c = (F.col("quality") == 1) & (F.col("toxic") == 0), F.col("quality") == 1, F.col("toxic") == 0
    return j.groupBy(F.col("lang").alias("kind")).agg(F.round(F.count_if(both) / F.count_if(q), 9).alias("recall"), F.round(F.count_if(both) / F.count_if(c), 9).alias("precision"), F.count("*").alias("n"))


@query("SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'SUPERSEDED' ELSE 'ACTIVE' END AS status, count(*) AS n_versions FROM events GROUP BY user_id")
def supersede_status(t):
    """Superseded subjects keep their versions and change their status."""
    return t.events.groupBy("user_id").agg(F.when(F.bool_or(F.col("event_type") == "error"), "SUPERSEDED").otherwise("ACTIVE").alias("status"), F.count("*").alias("n_versions"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'NEW' WHEN n_chars % 2 = 0 THEN 'UNCHANGED' ELSE 'CHANGED' END AS state FROM documents")
def maintenance_fingerprint(t):
    """What a maintenance run has to do: unchanged fingerprints are skipped."""
    d = t.documents.select("doc_id", "n_chars")
    known = d.where("doc_id % 4 <> 0").select("doc_id", F.when(F.col("n_chars") % 2 == 0, F.col("n_chars")).otherwise(-1).alias("old"))
    j = d.join(known, "doc_id", "left")
    return j.select("doc_id", F.when(F.col("old").isNull(), "NEW").when(F.col("old") == F.col("n_chars"), "UNCHANGED").otherwise("CHANGED").alias("state"))


@query("SELECT user_id, arg_max(value, (ts, event_id)) FILTER (event_type = 'purchase') AS amount, arg_max(props, (ts, event_id)) FILTER (event_type = 'view') AS note, count(*) AS n_actions FROM events GROUP BY user_id")
def typed_corrections(t):
    """Corrections of several kinds folded in order, field by field."""
    when = F.struct("ts", "event_id")
    last = lambda kind, c: F.max_by(c, F.when(F.col("event_type") == kind, when))
    return t.events.groupBy("user_id").agg(last("purchase", "value").alias("amount"), last("view", "props").alias("note"), F.count("*").alias("n_actions"))


@query("SELECT event_id, (SELECT max(ts) FROM events) - ts > INTERVAL 900 SECOND AS expired FROM events WHERE event_type = 'signup'")
def lease_expiry(t):
    """Leases older than 900 seconds at the time of the last event."""
    now = t.events.agg(F.max("ts").alias("now"))
    return t.events.where("event_type = 'signup'").join(F.broadcast(now)).select("event_id", (F.col("ts") < F.col("now") - F.expr("INTERVAL 900 SECONDS")).alias("expired"))  # one row


@query("SELECT p_brand, count(*) AS n, count(*) FILTER (p_size > 40) AS n_rejected FROM part GROUP BY p_brand HAVING count(*) FILTER (p_size > 40) > 0")
def package_validation(t):
    """Packages with violations, and how many."""
    return t.part.groupBy("p_brand").agg(F.count("*").alias("n"), F.count_if(F.col("p_size") > 40).alias("n_rejected")).where("n_rejected > 0")


@query("SELECT o_orderkey, coalesce(c.p, o_totalprice) AS price, c.p IS NOT NULL AS corrected FROM orders LEFT JOIN (SELECT o_orderkey AS k, o_totalprice + 1 AS p FROM orders WHERE o_orderkey % 50 = 0) c ON k = o_orderkey")
def corrections_overlay(t):
    """Reviewed corrections laid over the source by key."""
    c = t.orders.where("o_orderkey % 50 = 0").select("o_orderkey", (F.col("o_totalprice") + 1).alias("p"))
    return t.orders.join(c, "o_orderkey", "left").select("o_orderkey", F.coalesce("p", "o_totalprice").alias("price"), F.col("p").isNotNull().alias("corrected"))
