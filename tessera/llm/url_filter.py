"""URL filters by a temporal list join: dated list entries become validity intervals, and an as-of join evaluates
every capture against the entries active when it was fetched. Only DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import broadcast_if

#: Intervals up to this count (about 100 bytes each) are broadcast; beyond it the join shuffles and splits skewed keys.
BROADCAST_ROWS = 100_000


def host(url: Column) -> Column:
    """Lower-cased host without user, port and trailing dot; empty where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), "\\.$", "")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """Validity [valid_from, valid_to) of entries (list_name, kind, pattern, action, entry_date).

    `add` opens and `remove` closes; a second add while open changes nothing; on one date a remove wins. Entries with a
    null pattern, date or action are ignored. An entry that is never removed stays valid (valid_to is null).
    """
    e = entries.select("list_name", "kind", F.lower("pattern").alias("pattern"), "entry_date", (F.col("action") == "add").alias("_on"))
    e = e.where(F.col("pattern").isNotNull() & F.col("entry_date").isNotNull() & F.col("_on").isNotNull())
    e = e.groupBy("list_name", "kind", "pattern", "entry_date").agg(F.bool_and("_on").alias("_on"))
    w = Window.partitionBy("list_name", "kind", "pattern").orderBy("entry_date")
    e = e.withColumn("_was", F.lag("_on").over(w)).where(F.col("_was").isNull() | (F.col("_was") != F.col("_on")))
    e = e.withColumn("valid_to", F.lead("entry_date").over(w)).where("_on")
    return e.select("list_name", "kind", "pattern", F.col("entry_date").alias("valid_from"), "valid_to")


def _keys(url: Column) -> Column:
    """What entries can name: the host and each parent domain, and each path prefix at a slash, most specific first."""
    labels = F.split(host(url), "\\.")
    domains = F.when(host(url) == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    parts = F.array_remove(F.split(F.lower(path(url)), "/"), "")
    prefixes = F.when(F.size(parts) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(host(url), F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/"))))
    tag = lambda a, kind: F.transform(a, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("pattern")))
    return F.concat(tag(domains, "domain"), F.when(host(url) == "", F.array().cast("array<struct<kind:string,pattern:string>>")).otherwise(tag(prefixes, "prefix")))


def url_filter(captures: DataFrame, entries: DataFrame, id_col: str, url_col: str, time_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per capture: host, whether an entry was active at fetch time, how many, the lists and the first entry's date.

    Null or malformed URLs have no host and match nothing; a null fetch time matches nothing. Rows that repeat
    id, URL and time are one capture. Every capture is evaluated, whatever its host's share of the table.
    """
    c = captures.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(time_col).alias("_at"), *carry).distinct()
    spans = intervals(entries)
    spans = broadcast_if(spans, BROADCAST_ROWS)
    # A capture meets few distinct (key, time) pairs of its host: the join runs on those, not on captures.
    keyed = c.select("_url", "_at").distinct().select("_url", "_at", F.explode(F.array_distinct(_keys(F.col("_url")))).alias("k")).select("_url", "_at", "k.kind", "k.pattern")
    met = keyed.join(spans, ["kind", "pattern"]).where((F.col("_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("_at") < F.col("valid_to"))))
    met = met.groupBy("_url", "_at").agg(F.count("*").alias("n_entries"), F.array_join(F.array_sort(F.collect_set("list_name")), ",").alias("lists"), F.min("valid_from").alias("since"), F.max(F.struct(F.length("pattern"), F.col("pattern")))["pattern"].alias("matched"))
    # Captures without URL or time match nothing; a key of their own spreads them over all tasks.
    spread = F.when(F.col("_url").isNull() | F.col("_at").isNull(), F.xxhash64("_id")).otherwise(F.lit(0).cast("long"))
    out = c.withColumn("_k", spread).join(met.withColumn("_k", F.lit(0).cast("long")), ["_url", "_at", "_k"], "left")
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_url").alias(url_col),
        F.col("_at").alias(time_col),
        *carry,
        host(F.col("_url")).alias("host"),
        F.coalesce("n_entries", F.lit(0).cast("long")).alias("n_entries"),
        F.coalesce("lists", F.lit("")).alias("lists"),
        "since",
        F.coalesce("matched", F.lit("")).alias("matched"),
        F.col("n_entries").isNotNull().alias("blocked"),
    )
