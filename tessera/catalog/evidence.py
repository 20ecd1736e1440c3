"""Context, sufficiency, claims and their verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog.registry import query
from tessera.operators import evidence as E

_STATEMENTS = """s AS (SELECT doc_id % 60 AS entity, CASE doc_id % 2 WHEN 0 THEN 'gravity' ELSE 'place' END AS context_type, lang AS value, CASE doc_id % 7 WHEN 0 THEN 'run' WHEN 1 THEN 'group' WHEN 2 THEN 'campaign' ELSE 'document' END AS scope,
  CASE WHEN doc_id % 5 = 0 THEN 'EXPLICIT_LOCAL' WHEN doc_id % 5 IN (1, 2) THEN 'VERIFIED_APPLICABLE_CONTEXT' WHEN doc_id % 101 = 0 THEN 'CONFLICTED' ELSE 'CONTEXTUAL_CANDIDATE' END AS status, doc_id % 11 = 0 AS is_exception FROM documents)"""


def _statements(documents):
    k = F.col("doc_id")
    return documents.select(
        (k % 60).alias("entity"),
        F.when(k % 2 == 0, "gravity").otherwise("place").alias("context_type"),
        F.col("lang").alias("value"),
        F.when(k % 7 == 0, "run").when(k % 7 == 1, "group").when(k % 7 == 2, "campaign").otherwise("document").alias("scope"),
        F.when(k % 5 == 0, "EXPLICIT_LOCAL").when((k % 5).isin(1, 2), "VERIFIED_APPLICABLE_CONTEXT").when(k % 101 == 0, "CONFLICTED").otherwise("CONTEXTUAL_CANDIDATE").alias("status"),
        (k % 11 == 0).alias("is_exception"),
        F.lit(False).alias("has_conflict"),
    )


@query(f"""WITH {_STATEMENTS}, r AS (SELECT *, CASE scope WHEN 'run' THEN 3 WHEN 'group' THEN 2 WHEN 'campaign' THEN 1 ELSE 0 END AS rank, NOT is_exception AND status IN ('EXPLICIT_LOCAL', 'VERIFIED_APPLICABLE_CONTEXT') AS ok FROM s),
g AS (SELECT entity, context_type, bool_or(NOT is_exception AND status = 'CONFLICTED') AS open, bool_or(is_exception) AS excepted, max(rank) FILTER (ok) AS best FROM r GROUP BY 1, 2),
v AS (SELECT entity, context_type, count(DISTINCT value) FILTER (ok AND rank = best) AS n, min(value) FILTER (ok AND rank = best) AS value, bool_or(ok AND rank = best AND status = 'EXPLICIT_LOCAL') AS local, any_value(open) AS open, any_value(excepted) AS excepted, any_value(best) AS best FROM r JOIN g USING (entity, context_type) GROUP BY 1, 2),
o AS (SELECT *, CASE WHEN open THEN 'CONFLICTED' WHEN best IS NULL AND excepted THEN 'NOT_APPLICABLE' WHEN best IS NULL THEN 'CONTEXTUAL_CANDIDATE' WHEN n > 1 THEN 'CONFLICTED' WHEN local THEN 'EXPLICIT_LOCAL' ELSE 'VERIFIED_APPLICABLE_CONTEXT' END AS status FROM v)
SELECT entity, context_type, status, CASE WHEN status IN ('EXPLICIT_LOCAL', 'VERIFIED_APPLICABLE_CONTEXT') THEN value END AS value FROM o""")
def scope_resolution(t):
    """The value that applies to each entity, by the most local authoritative statements of all documents."""
    return E.resolve_scope(_statements(t.documents))


@query("""WITH i AS (SELECT source, CASE WHEN toxic = 1 AND quality = 0 THEN 'CONFLICTED' WHEN toxic = 0 AND n_chars > 6000 THEN 'SUPPORTED' WHEN toxic = 0 THEN 'PARTIALLY_SUPPORTED' ELSE 'RELATED_ONLY' END AS state FROM documents JOIN labels USING (doc_id) WHERE source <> 'src4'),
r AS (SELECT source, state, CASE state WHEN 'CONFLICTED' THEN 0 WHEN 'SUPPORTED' THEN 1 WHEN 'PARTIALLY_SUPPORTED' THEN 2 ELSE 3 END AS k, count(*) AS n FROM i GROUP BY ALL)
SELECT s.source, coalesce(arg_min(state, k), 'MISSING') AS state, coalesce(arg_min(n, k), 0) AS n_items FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN r USING (source) GROUP BY s.source""")
def sufficiency_states(t):
    """The strongest state of each requirement."""
    j = t.documents.join(t.labels, "doc_id").where("source <> 'src4'")
    state = F.when((F.col("toxic") == 1) & (F.col("quality") == 0), "CONFLICTED").when((F.col("toxic") == 0) & (F.col("n_chars") > 6000), "SUPPORTED").when(F.col("toxic") == 0, "PARTIALLY_SUPPORTED").otherwise("RELATED_ONLY")
    return E.sufficiency(j.select("source", state.alias("state")), t.documents.select("source").distinct(), "source", "state")


@query("""WITH c AS (SELECT item_id AS claim, CASE WHEN item_id % 10 = 9 THEN -1 WHEN item_id % 5 = 3 THEN (item_id + 1) % 40 ELSE item_id END AS ref, text AS quote FROM benchmark),
j AS (SELECT claim, p.text IS NULL AS g, coalesce(contains(lower(trim(regexp_replace(p.text, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(quote, '\\s+', ' ', 'g')))), false) AS i, claim % 4 <> 0 AS d, claim % 11 = 1 AS c FROM c LEFT JOIN benchmark p ON p.item_id = ref)
SELECT claim, CASE WHEN g THEN 'INSUFFICIENT_EVIDENCE' WHEN NOT i OR c THEN 'UNSUPPORTED' WHEN NOT d THEN 'SUPPORTED_WITH_LIMITATIONS' ELSE 'SUPPORTED' END AS status FROM j""")
def claim_verification(t):
    """Claims checked against the exact text that they cite."""
    k = F.col("item_id")
    claims = t.benchmark.select(k.alias("claim"), F.when(k % 10 == 9, -1).when(k % 5 == 3, (k + 1) % 40).otherwise(k).alias("ref"), F.col("text").alias("quote"))
    passages = t.benchmark.select(k.alias("ref"), "text")
    return E.verify_claims(claims, passages, "claim", "quote", "ref", "text", F.col("claim") % 4 != 0, F.col("claim") % 11 == 1)


@query("SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def grounding_outside_bundle(t):
    """Citations that the bundle does not hold."""
    return E.outside(t.labels.select("doc_id").distinct(), t.documents.where("lang = 'en'").select("doc_id"), "doc_id")


@query("""WITH f AS (SELECT source, lang, n_chars, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS k FROM documents),
n AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS position FROM f WHERE k = 1) SELECT source, doc_id, position, position <= 2 AS selected FROM n""")
def claim_selection_budget(t):
    """Claims without repeats, within a budget per group."""
    return E.select_claims(t.documents, "source", ["lang"], [F.desc("n_chars"), F.asc("doc_id")], 2).select("source", "doc_id", "position", "selected")


@query("""WITH o AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE lang = 'en'), c AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE lang = 'de')
SELECT o.source, o.doc_id AS observation, c.doc_id AS conclusion FROM o JOIN c ON o.source = c.source AND o.k <= 4 AND c.k <= 4""")
def observation_conclusion_pairs(t):
    """Candidate pairs for review: at most four observations and four conclusions of each source."""
    from tessera.operators import records as R

    first = lambda lang, name: R.strata(t.documents.where(F.col("lang") == lang).select("source", "doc_id"), ["source"], [F.col("doc_id")], 4).select("source", F.col("doc_id").alias(name))
    return first("en", "observation").join(first("de", "conclusion"), "source")


@query("SELECT doc_id, list_filter(['restored flow', 'ignition'], lambda c: c = 'ignition' OR NOT contains(lower(text), 'flow')) AS limits FROM documents WHERE NOT contains(lower(text), 'ignition')")
def request_limits(t):
    """Cues of a request that a text does not cover."""
    low = F.lower("text")
    limits = F.array_compact(F.array(F.when(~low.contains("flow"), F.lit("restored flow")), F.when(~low.contains("ignition"), F.lit("ignition"))))
    return t.documents.where(~low.contains("ignition")).select("doc_id", limits.alias("limits"))


@query("SELECT e.entity, e.n, e.n - coalesce(x.n, 0) AS n_applicable FROM (SELECT doc_id % 60 AS entity, count(*) AS n FROM documents GROUP BY 1) e LEFT JOIN (SELECT doc_id % 60 AS entity, count(*) AS n FROM documents WHERE doc_id % 11 = 0 GROUP BY 1) x ON x.entity = e.entity")
def context_edges(t):
    """Context statements as edges to their entities, without excepted ones."""
    s = t.documents.select((F.col("doc_id") % 60).alias("entity"), (F.col("doc_id") % 11 == 0).alias("excepted"))
    return s.groupBy("entity").agg(F.count("*").alias("n"), F.count_if(~F.col("excepted")).alias("n_applicable"))


@query("""WITH v AS (SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN 'REJECTED' WHEN n_chars < 200 OR quality IS NULL THEN 'REVIEW_REQUIRED' ELSE 'VALIDATED' END AS status FROM documents LEFT JOIN labels USING (doc_id)) SELECT doc_id, status FROM v""")
def candidate_validation(t):
    """Candidates as rejected, for review or validated."""
    j = t.documents.join(t.labels, "doc_id", "left")
    empty = F.coalesce(F.col("text"), F.lit("")) == ""
    return j.select("doc_id", F.when(empty, "REJECTED").when((F.col("n_chars") < 200) | F.col("quality").isNull(), "REVIEW_REQUIRED").otherwise("VALIDATED").alias("status"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def rejection_cascade(t):
    """Dependents go with what they refer to."""
    rejected = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.where("o_orderstatus <> 'O'").join(rejected, "o_custkey", "left_anti").select("o_orderkey")


@query("SELECT l_returnflag AS reason, l_linestatus AS term, count(*) AS n, list_sort(list(DISTINCT l_linenumber))[1:3] AS spans FROM lineitem GROUP BY 1, 2")
def review_issues(t):
    """Issues by reason and term, with their number and a few places."""
    return t.lineitem.groupBy(F.col("l_returnflag").alias("reason"), F.col("l_linestatus").alias("term")).agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set("l_linenumber")), 1, 3).alias("spans"))
