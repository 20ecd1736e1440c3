"""Spans of text: overlap, containment, merging, location of quotes, and carrying headings forward."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.lineage import broadcast_if, written

#: Up to so many digests (8 bytes each), and a tenth as many candidates, are broadcast; beyond it both sides shuffle.
BROADCAST_ROWS = 400_000


def merge(spans: DataFrame, by: list[str], start: str = "start", end: str = "end", gap: int = 0) -> DataFrame:
    """Spans that overlap, or lie at most `gap` apart, become one (gaps and islands).

    Equal spans are one row with their number before they are sorted, so their order is never open and copies do not
    crowd a group. Only spans without an end at or after their start stay apart, as a copy of them touches none; nulls
    come last, as in SQL.
    """
    own = F.when(F.col(end) >= F.col(start), F.lit(None).cast("long")).otherwise(F.monotonically_increasing_id())
    spans = spans.select(*by, start, end, own.alias("_own")).groupBy(*by, start, end, "_own").agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*by).orderBy(F.asc_nulls_last(start), F.asc_nulls_last(end), "_own")
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0)).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.sum("_n").alias("n_spans")).drop("_island")


def overlapping(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Pairs of spans of the same text that share a character; a and b carry start/end as a_start.. and b_start.. ."""
    return a.join(b, key).where((F.col("a_start") < F.col("b_end")) & (F.col("a_end") > F.col("b_start")))


def locate(quotes: DataFrame, texts: DataFrame, quote_key: str, quote_col: str, text_key: str, text_col: str, words: int = 5) -> DataFrame:
    """(quote, n_texts, text id, start) of quotes found in texts; start counts from 0; the id and start are null unless
    the text is unique and the quote occurs in it once.

    Candidates come from an equality join of digests of the first `words` inner words of each quote, or of all of them
    if there are fewer: its first and last word may be parts of words of the text, but what is between them are whole
    words. Only digests and ids of texts are opened into rows; the texts of candidates are fetched for the exact test.
    Only quotes of one or two words have no inner word; they meet every text in a scan.
    """
    grams = lambda c: F.array_remove(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), "\\s+"), "")
    q = quotes.select(F.col(quote_key), F.col(quote_col).alias("_q"), grams(quote_col).alias("_w")).where(F.col(quote_col).isNotNull())
    q = q.withColumn("_n", F.least(F.greatest(F.size("_w") - 2, F.lit(0)), F.lit(words))).withColumn("_key", F.xxhash64(F.slice("_w", F.lit(2), F.col("_n"))))
    q = written(q.drop("_w"))
    # At most words + 1 numbers; a text is opened into the n-grams of those lengths only.
    lengths = {r[0] for r in q.select("_n").distinct().collect()}
    t = texts.select(F.col(text_key), F.col(text_col).alias("_t"))
    keys = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("_v") - n + 1, F.lit(1))), lambda i: F.xxhash64(F.slice("_v", i, F.lit(n))))
    opened = F.concat(*[keys(n) for n in sorted(lengths - {0})] or [F.array().cast("array<long>")])
    inside = F.col("_t").contains(F.col("_q"))
    wanted = broadcast_if(q.where("_n > 0").select("_key").distinct(), BROADCAST_ROWS)
    met = texts.select(F.col(text_key), grams(text_col).alias("_v")).select(text_key, F.explode(opened).alias("_key")).join(wanted, "_key").distinct()
    pairs = written(q.where("_n > 0").join(met, "_key").select(quote_key, "_q", F.col(text_key).alias("_id")).distinct())
    named = broadcast_if(pairs, BROADCAST_ROWS // 10)
    hit = t.join(named, F.col(text_key).eqNullSafe(F.col("_id"))).where(inside).select(quote_key, text_key, "_q", "_t")
    if 0 in lengths:
        hit = hit.unionByName(q.where("_n = 0").join(t, inside).select(quote_key, text_key, "_q", "_t"))
    one = (F.length("_t") - F.length(F.replace("_t", "_q", F.lit("")))) == F.length("_q")
    per = hit.groupBy(quote_key).agg(F.countDistinct(text_key).alias("n_texts"), F.min(text_key).alias("_id"), F.min(F.when(one, F.expr("instr(_t, _q)") - 1)).alias("_at"))
    out = quotes.select(quote_key).join(per, quote_key, "left").withColumn("n_texts", F.coalesce("n_texts", F.lit(0).cast("long")))
    unique = (F.col("n_texts") == 1) & F.col("_at").isNotNull()
    return out.select(quote_key, "n_texts", F.when(unique, F.col("_id")).alias(text_key), F.when(unique, F.col("_at")).alias("start"))


def carry_forward(rows: DataFrame, by: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """The last non-null value at or before each row of its group."""
    return rows.withColumn(out, F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def neighbours(rows: DataFrame, by: list[str], order: list[str], value: str, reach: int, out: str) -> DataFrame:
    """The values of up to `reach` rows on either side, in order, with the row's own."""
    return rows.withColumn(out, F.collect_list(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(-reach, reach)))
