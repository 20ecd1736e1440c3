"""Preparing sources for review: policies, caches, tables, sizes, literal candidates, questions, drafts and publication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import collapse
from tessera.operators.validation import reasons

#: Cells that state a quantity: a number, a range or an approximation.
QUANTITY = "^\\s*(~|≈|[<>≤≥]|(?i:about|approximately|at least|at most))?\\s*[-+]?[0-9]+(\\.[0-9]+)?(\\s*(-|–|±|to)\\s*[-+]?[0-9]+(\\.[0-9]+)?)?\\s*$"
#: Unit syntax that a label may carry in brackets (fixed values).
UNIT_SYNTAX = "^(%|ppm|fraction|RPM|psia|[mcdkMGµμnp]?(mol|Hz|Pa|m|g|s|A|K|N|J|W|C|V|F)(\\^?[-+]?[0-9]+|[²³])?([/*·][mcdkMGµμnp]?(mol|Hz|Pa|m|g|s|A|K|N|J|W|C|V|F)(\\^?[-+]?[0-9]+|[²³])?)*|seconds?|minutes?|hours?)$"
#: What literal names look like, by class: the group holds the name (fixed values).
NAME_PATTERNS = {
    "Investigation": "\\b([A-Z][A-Z0-9-]{2,20})\\s+(?:experiments?|investigation|project)\\b",
    "ExperimentFamily": "\\b((?:[A-Za-z]+[- ]flow|blowoff(?:\\s+limit)?|quenching|ground|flight|drop|normal[- ]gravity|microgravity)\\s+(?:tests|experiments|cases))\\b",
    "ExperimentalRun": "\\b(?:[Rr]un|[Cc]ase|[Tt]est)\\s+(?:[Nn]umber\\s+|[Nn]o\\.?\\s*|#\\s*)?([A-Z][0-9]+(?:[-_.][0-9]+)*)\\b",
    "Sample": "\\b(?:[Ss]ample|[Ss]pecimen)\\s+(?:[Nn]umber\\s+|[Nn]o\\.?\\s*|#\\s*)?([A-Z][0-9]+(?:[-_.][0-9]+)*)\\b",
}


def public_download(url: Column, kind: Column, draft: Column, host: str, prefix: Column) -> Column:
    """Whether a file may be fetched: https, the official host, under the record's own path, a PDF and no draft."""
    parts = F.regexp_extract(url, "^([a-z]+)://([^/?#]*)(/[^?#]*)", 1), F.regexp_extract(url, "^([a-z]+)://([^/?#]*)(/[^?#]*)", 2), F.regexp_extract(url, "^([a-z]+)://([^/?#]*)(/[^?#]*)", 3)
    return F.coalesce((parts[0] == "https") & (parts[1] == host) & F.startswith(parts[2], prefix) & (kind == "application/pdf") & ~F.coalesce(draft, F.lit(False)), F.lit(False))


def cached(puts: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """A cache of (keys, value): what was put last under each key."""
    return puts.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def default_preference(explicit: Column, question: Column, comparative: list[str], preferred: list[str]) -> Column:
    """The values that a search prefers by default: none if the question names a value or compares."""
    compares = reduce(lambda a, w: a | F.lower(question).contains(w), comparative, F.lit(False))
    return F.when(~F.coalesce(explicit, F.lit(False)) & ~F.coalesce(compares, F.lit(False)), F.array(*[F.lit(p) for p in preferred])).otherwise(F.array().cast("array<string>"))


def activate(proposals: DataFrame, registered: DataFrame) -> DataFrame:
    """(term, definition, state) of proposed terms (term, definition, status, revision) by their last revision: ACTIVE if
    approved and new, UNCHANGED if registered alike, CONFLICT if registered otherwise, PENDING if not approved."""
    last = proposals.groupBy("term").agg(F.max_by(F.struct("definition", "status"), "revision").alias("p")).select("term", "p.*")
    known = registered.select("term", F.col("definition").alias("_d"))
    state = F.when(F.col("status") != "APPROVED", "PENDING").when(F.col("_d").isNull(), "ACTIVE").when(F.col("_d") == F.col("definition"), "UNCHANGED").otherwise("CONFLICT")
    return last.join(known, "term", "left").select("term", "definition", state.alias("state"))


def replay(candidates: DataFrame, approved: DataFrame, evidence: DataFrame) -> DataFrame:
    """Adds tier and record to candidates (id, class, text, ref, scope, error). Tier 1 repeats an approved record (record,
    class, text, refs) word for word on evidence of its own, all of which is known: it is replayed under that record's
    identity. 4 is in error, 3 has no scope, 2 awaits a review."""
    refs = approved.select("record", F.explode("refs").alias("ref"))
    gone = refs.join(evidence.select("ref"), "ref", "left_anti").select("record").distinct()
    known = approved.join(gone, "record", "left_anti").select("record", "class", F.sha2(F.lower(collapse("text")), 256).alias("_k"), F.explode("refs").alias("ref"))
    known = known.groupBy("class", "_k", "ref").agg(F.min("record").alias("_record"))
    rows = candidates.withColumn("_k", F.sha2(F.lower(collapse("text")), 256)).join(known, ["class", "_k", "ref"], "left")
    tier = F.when(F.col("error").isNotNull(), 4).when(F.col("_record").isNotNull(), 1).when(F.startswith("scope", F.lit("UNRESOLVED")), 3).otherwise(2)
    return rows.withColumn("tier", tier).withColumn("record", F.when(F.col("tier") == 1, F.col("_record"))).drop("_k", "_record")


def recognised_terms(text: Column, terms: list[str], least: int = 4) -> Column:
    """Registered terms that a text has once it is squashed to letters and digits, in order; short ones never count."""
    squashed = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]", "")
    wanted = sorted({t.lower() for t in terms if len(t) >= least})
    return F.filter(F.array(*[F.lit(t) for t in wanted]), lambda t: squashed.contains(t))


def table_records(tables: DataFrame, id_col: str, cells_col: str) -> DataFrame:
    """(id, row, column, header, label, value) of tables given as array<array<string>>, the first row being headers."""
    rows = tables.select(id_col, F.get(cells_col, F.lit(0)).alias("_h"), F.posexplode(F.slice(F.col(cells_col), F.lit(2), F.greatest(F.size(cells_col) - 1, F.lit(0)))).alias("row", "_r"))
    return rows.select(id_col, "row", "_h", F.get("_r", F.lit(0)).alias("label"), F.posexplode("_r").alias("column", "value")).select(id_col, "row", "column", F.get("_h", F.col("column")).alias("header"), "label", "value")


def table_quantities(cells: DataFrame) -> DataFrame:
    """Cells that state a quantity, with the one unit that header or row label spell in brackets; all await review."""
    literal = F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", "header", "label"), F.lit("\\(([^()]+)\\)"), F.lit(1)))
    units = F.filter(literal, lambda u: F.trim(u).rlike(UNIT_SYNTAX))
    out = cells.where(F.col("value").rlike(QUANTITY)).withColumn("unit", F.when(F.size(units) == 1, F.get(units, F.lit(0))))
    return out.withColumn("status", F.lit("UNRESOLVED"))


def sizing(sentences: Column, numbers: Column, table_lines: Column, chars: Column, output: int = 32768, context: int = 65536, rate: float = 35.0, longest: float = 600.0) -> Column:
    """struct(segment_chars, output_tokens, seconds): how a text is divided for a reader of bounded output, and what
    one part may take."""
    expected = F.greatest(F.lit(1), sentences * 90 + numbers * 45 + table_lines * 140)
    parts = F.greatest(F.lit(1), F.ceil(expected / F.lit(output * 1.2)))
    room = max(1000, (context - output - 12000) * 2)
    segment = F.greatest(F.lit(1000), F.least(F.lit(room), F.greatest(F.lit(6000), F.ceil(chars / parts))))
    tokens = F.least(F.lit(output), F.greatest(F.lit(4096), F.ceil((2200 + sentences * 120 + numbers * 90) / 1024) * 1024))
    seconds = F.least(F.lit(longest), F.greatest(F.lit(120.0), 45 + tokens / F.lit(rate)))
    return F.struct(segment.cast("long").alias("segment_chars"), tokens.cast("long").alias("output_tokens"), seconds.alias("seconds"))


def halved(text: Column, least: int = 600, margin: int = 150) -> Column:
    """Where a text is cut in two: at the line or sentence end nearest to its middle (the earlier of two), `margin` from
    either end; null if it is short or has none. Both parts together are the text."""
    end = "(?:\\n|[.!?]\\s)"
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    # The last end up to the middle, and the first one after it: it may begin one character before.
    before = F.length(F.regexp_extract(F.substring(text, F.lit(1), half), f"(?s)^.*{end}", 0))
    ahead = F.length(F.regexp_extract(F.substring(text, half, n), f"(?s)^.*?{end}", 0))
    after = F.when(ahead > 1, half - 1 + ahead)
    far = F.regexp_extract(F.substring(text, half + 1, n), f"(?s)^.*?{end}", 0)
    after = F.when(after > half, after).otherwise(F.when(far != "", half + F.length(far)))
    left, right = F.when(before >= margin, before), F.when(after <= n - margin, after)
    nearest = F.when(right.isNull() | (half - left <= right - half), left).otherwise(right)
    return F.when(n > least, F.coalesce(nearest, left, right))


def literal_names(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, class, label, key) of names as sources spell them; candidates only, told apart by a digest."""
    found = [texts.select(id_col, F.lit(c).alias("class"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(p), F.lit(1)))).alias("label")) for c, p in NAME_PATTERNS.items()]
    return reduce(DataFrame.unionAll, found).withColumn("key", F.concat(F.lit("literal-"), F.substring(F.sha2(F.concat_ws("|", "class", F.lower("label")), 256), 1, 16)))


def rendered(fields: list[str]) -> Column:
    """`field = value; ..` of the fields that have a value, in order."""
    return F.concat_ws("; ", *[F.when(F.col(f).isNotNull(), F.concat(F.lit(f + " = "), F.col(f).cast("string"))) for f in fields])


def identity_digest(fields: list[str]) -> Column:
    """A digest of a row's JSON with its keys in order, nulls included, so that column order does not matter."""
    return F.sha2(F.to_json(F.struct(*[F.col(f).alias(f) for f in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def generated_properties(spark: SparkSession, seed: int, n: int) -> DataFrame:
    """(i, name, unit, value) of made-up properties for stress tests, the same for the same seed everywhere."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("i").cast("string")))
    number = lambda a, b: F.conv(F.substring(digest, a, b), 16, 10).cast("long")
    unit = F.get(F.array(*[F.lit(u) for u in ("mm", "s", "kPa", "%")]), (number(1, 4) % 4).cast("int"))
    return spark.range(n).withColumnRenamed("id", "i").select("i", F.concat(F.lit("property_"), F.substring(digest, 9, 8)).alias("name"), unit.alias("unit"), (number(17, 6) % 10000 / 10).alias("value"))


def asof(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the last right row of its key at or before it; null before the first.

    Both sides are sorted together, once by key and time: no range join and no pairs. Of right rows at the same time
    the greatest values count.
    """
    row = F.struct(*left.columns)
    kind = left.select(row.alias("r")).schema["r"].dataType
    right_row = F.struct(*values)
    value_kind = right.select(right_row.alias("v")).schema["v"].dataType
    a = left.select(*by, F.col(left_at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(value_kind).alias("_v"), row.alias("_row"))
    b = right.select(*by, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), right_row.alias("_v"), F.lit(None).cast(kind).alias("_row"))
    w = Window.partitionBy(*by).orderBy("_at", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionAll(b).withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where("_side = 1").select("_row.*", *[F.col(f"_last.{v}").alias(v) for v in values])


def drafted(published: DataFrame, draft: DataFrame, keys: list[str]) -> DataFrame:
    """What readers would see if the draft were published: its rows in place of those of their keys; nothing is written."""
    rest = published.join(draft.select(*keys).distinct(), keys, "left_anti").withColumn("origin", F.lit("published"))
    return rest.unionByName(draft.withColumn("origin", F.lit("draft")))


def publication(packages: DataFrame) -> DataFrame:
    """Adds errors and state to packages (digest, approved_digest, current_digest, violations): PUBLISH if the approved
    version is the present one, its shapes hold and it is not out already."""
    errors = reasons({"NOT_APPROVED": F.col("approved_digest").isNull(), "DIGEST_MISMATCH": F.col("approved_digest") != F.col("digest"), "SHAPES_VIOLATED": F.col("violations") > 0})
    state = F.when(F.size("errors") > 0, "REFUSED").when(F.col("current_digest").eqNullSafe(F.col("digest")), "UNCHANGED").otherwise("PUBLISH")
    return packages.withColumn("errors", errors).withColumn("state", state)


def regenerated(proposals: DataFrame, corrections: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, field, value, corrected): proposals anew, then corrections (.., seq) in order, the last of a field winning."""
    last = corrections.groupBy(*keys, "field").agg(F.max_by("value", "seq").alias("_v"))
    out = proposals.join(last, [*keys, "field"], "full")
    return out.select(*keys, "field", F.coalesce("_v", "value").alias("value"), F.col("_v").isNotNull().alias("corrected"))


def review_questions(open_items: DataFrame, decided: DataFrame) -> DataFrame:
    """(question, kind, affected, priority, position) of what is unresolved (kind, subject): one question for each kind
    and subject without a decision; matters of scope and identity weigh ten more than the records they touch."""
    question = F.concat_ws(":", "kind", "subject")
    asked = open_items.withColumn("question", question).join(decided.select("question"), "question", "left_anti")
    grouped = asked.groupBy("question", "kind").agg(F.count("*").alias("affected"))
    grouped = grouped.withColumn("priority", F.col("affected") + F.when(F.col("kind").isin("scope", "identity"), 10).otherwise(0))
    return grouped.withColumn("position", F.row_number().over(Window.orderBy(F.desc("priority"), "question")))


def admission_errors(registered: list[str]) -> Column:
    """Why an entity (class, refs, known_refs) is not admitted: no evidence, unknown evidence, unregistered class."""
    return reasons({"NO_EVIDENCE": F.size(F.coalesce("refs", F.array().cast("array<string>"))) == 0, "UNKNOWN_EVIDENCE": F.size(F.array_except("refs", "known_refs")) > 0, "UNREGISTERED_CLASS": ~F.col("class").isin(registered)})


def next_actions(states: DataFrame) -> DataFrame:
    """(requirement, action, position) for requirements that are not supported: what is missing is searched for, what
    conflicts is compared, the rest is extended; conflicts first, then what is missing, ties by name."""
    kind = F.when(F.col("state") == "CONFLICTED", "COMPARE").when(F.col("state") == "MISSING", "SEARCH").otherwise("EXPAND")
    order = F.when(F.col("action") == "COMPARE", 0).when(F.col("action") == "SEARCH", 1).otherwise(2)
    rows = states.where("state <> 'SUPPORTED'").withColumn("action", kind)
    return rows.select("requirement", "action", F.row_number().over(Window.orderBy(order, "requirement")).alias("position"))
