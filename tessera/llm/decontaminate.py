"""Benchmark decontamination by winnowing: minimum k-gram hashes per sliding window, joined, then extended.

Only DataFrame functions. A window of `span` words holds span - k + 1 k-grams, and the least of their hashes is its
fingerprint, so two texts that share `span` words share a fingerprint: no shared span is missed. Documents without a
common fingerprint are done; for the others the hits are extended to exact word positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import broadcast_if, cut, small, text_key

#: Characters between words, once A-Z are lower-cased.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to so many rows (about 24 bytes each) a side is broadcast; beyond it both sides are shuffled.
BROADCAST_ROWS = 400_000


def words(text: str) -> Column:
    """Words of a text; only A-Z change case."""
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), BETWEEN), "")


def _let(value: Column, body) -> Column:
    """Binds a value once, so that an expression that uses it several times does not repeat it when plans are merged."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _shifted(step: int, combine):
    """array -> combine(x[i], x[i + step]) for all i that have both."""

    def body(a: Column) -> Column:
        left = F.greatest(F.size(a) - step, F.lit(0))
        return F.zip_with(F.slice(a, F.lit(1), left), F.slice(a, F.lit(step + 1), left), combine)

    return body


def _doubled(a: Column, width: int, combine) -> Column:
    """Combines each `width` neighbours, by doubling: a step combines two overlapping halves."""
    done = 1
    while done < width:
        step = min(done, width - done)
        a = _let(a, _shifted(step, combine))
        done += step
    return a


def _grams(words_col: str, k: int) -> Column:
    """The hashes of all k-grams of words; a gram is hashed from two shorter ones."""
    return _doubled(F.transform(words_col, lambda w: F.xxhash64(w)), k, lambda x, y: F.xxhash64(x, y))


def _fingerprints(df: DataFrame, words_col: str, k: int, span: int, short: list[int]) -> DataFrame:
    """Adds `_fp`: winnowed hashes for windows of `span` words, and all hashes for each shorter window in use."""

    def tagged(m: int) -> Column:
        return F.array_distinct(F.transform(_grams(words_col, m), lambda h: F.xxhash64(F.lit(m), h)))

    winnowed = F.array_distinct(_doubled(_grams(words_col, k), span - k + 1, lambda x, y: F.least(x, y)))
    return df.withColumn("_fp", F.concat(winnowed, *[tagged(m) for m in short]) if short else winnowed)


def _windows(words_col: str, lengths: list[int]) -> Column:
    """All (start, length, gram) of the given lengths."""

    def of(m: int) -> Column:
        def window(i: Column) -> Column:
            return F.struct(i.alias("start"), F.lit(m).alias("len"), F.array_join(F.slice(words_col, i, F.lit(m)), " ").alias("gram"))

        return F.when(F.size(words_col) >= m, F.transform(F.sequence(F.lit(1), F.size(words_col) - (m - 1)), window)).otherwise(F.array().cast("array<struct<start:int,len:int,gram:string>>"))

    return F.concat(*[of(m) for m in lengths])


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = 13, k: int = 8, one_in: int = 20) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated, and `_key`, the digest of its text.

    A word is hit if it lies in an occurrence of a window: `span` consecutive words of an item, or the whole of a
    shorter item. Null and empty texts have no words; items without words have no windows. Rows that repeat both id and
    text are one document; null ids are kept as ids. A document is contaminated if at least one in `one_in` of its
    words is hit. Texts of any length are read whole. An empty table of documents gives no rows, one of items no hits.
    """
    items = items.select(F.col(item_col).alias("_item"), F.col(item_text_col).alias("_text"))
    items = cut(items.select("_item", words("_text").alias("_w")).where(F.size("_w") > 0))
    # At most span - 1 values, whatever the benchmark's size.
    short = sorted(r[0] for r in items.where(F.size("_w") < span).select(F.size("_w")).distinct().collect())
    # An item shorter than span has one window, the whole of it.
    item_fp = _fingerprints(items.where(F.size("_w") >= span), "_w", k, span, []).select("_fp")
    for m in short:
        item_fp = item_fp.unionAll(_fingerprints(items.where(F.size("_w") == m), "_w", k, span, [m]).select("_fp"))
    wanted = item_fp.select(F.explode("_fp").alias("_f")).distinct()

    keyed = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).select("_id", "_text", text_key("_text").alias("_key"))
    prints = _fingerprints(keyed.select("_id", "_key", words("_text").alias("_w")), "_w", k, span, short)
    prints = prints.select("_id", "_key", F.size("_w").cast("long").alias("n_words"), F.explode_outer("_fp").alias("_f"))
    found = prints.join(broadcast_if(wanted.withColumn("_in", F.lit(True)), BROADCAST_ROWS), "_f", "left")
    # All rows of a document come from one task and row, so partial aggregation leaves one row each to shuffle.
    marked = cut(found.groupBy("_id", "_key", "n_words").agg(F.coalesce(F.bool_or("_in"), F.lit(False)).alias("_near")))

    near = marked.where("_near").select("_key").distinct()
    texts = keyed.select("_key", "_text").join(broadcast_if(near, BROADCAST_ROWS), "_key", "left_semi")
    texts = texts.groupBy("_key").agg(F.first("_text").alias("_text"))
    lengths = [span, *short]
    places = texts.select("_key", words("_text").alias("_w")).select("_key", F.explode(_windows("_w", lengths)).alias("x")).select("_key", "x.start", "x.len", "x.gram")
    grams = items.select("_item", F.size("_w").alias("_n"), F.explode(_windows("_w", lengths)).alias("x")).where((F.col("x.len") == span) | (F.col("_n") == F.col("x.len")))
    # Counted with all their items, so that no list of items makes a broadcast larger than its bound.
    few = small(grams, BROADCAST_ROWS // 8)
    grams = grams.groupBy(F.col("x.gram").alias("gram"), F.col("x.len").alias("len")).agg(F.collect_set("_item").alias("_items"))
    hits = places.join(F.broadcast(grams) if few else grams, ["gram", "len"])
    covered = F.aggregate(
        F.array_sort("_spans"),
        F.struct(F.lit(0).cast("long").alias("sum"), F.lit(1).cast("long").alias("to")),
        lambda a, s: F.struct((a["sum"] + F.greatest(F.lit(0), s["start"] + s["len"] - F.greatest(a["to"], s["start"].cast("long")))).cast("long").alias("sum"), F.greatest(a["to"], (s["start"] + s["len"]).cast("long")).alias("to")),
        lambda a: a["sum"],
    )
    per_text = hits.groupBy("_key").agg(F.collect_set(F.struct("start", "len")).alias("_spans"), F.array_distinct(F.flatten(F.collect_set("_items"))).alias("_items"))
    per_text = per_text.select("_key", covered.alias("n_hit"), F.array_sort(F.transform("_items", lambda x: x.cast("string"))).alias("_items"))
    # Materialised, so that both sides of the join are plain shuffles whose hot keys Spark can split.
    out = marked.join(cut(per_text), "_key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        F.col("_id").alias(id_col),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("_items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("_items", ","), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * one_in >= F.col("n_words"))).alias("contaminated"),
        "_key",
    )
