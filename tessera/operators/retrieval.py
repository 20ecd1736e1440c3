"""Text and vector retrieval: BM25, exact cosine, reciprocal rank fusion and what is built on them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import index_tokens, query_tokens

#: Constants of the ranking function (fixed values).
K1, B = 1.2, 0.75
#: Constant of reciprocal rank fusion (fixed value).
RRF_K = 60


def statistics(docs: DataFrame, id_col: str, text_col: str, terms: list[str] | None = None) -> DataFrame:
    """(id, length, hits, tf_0 ..) of each document for the wanted terms, in one pass and without exploding texts.

    The tokens are bound once inside one expression: a filter on hits that is pushed down reads a text once more, not
    once for each term.
    """
    wanted = sorted(set(terms or []))

    def counted(tokens: Column) -> Column:
        counts = [F.size(tokens) - F.size(F.array_remove(tokens, F.lit(w))) for w in wanted]
        return F.struct(F.size(tokens).alias("length"), sum(counts, F.lit(0)).alias("hits"), *[c.alias(f"tf_{i}") for i, c in enumerate(counts)])

    found = docs.select(F.col(id_col), F.get(F.transform(F.array(index_tokens(text_col)), counted), F.lit(0)).alias("_s"))
    return found.select(F.col(id_col), "_s.length", "_s.hits", *[f"_s.tf_{i}" for i in range(len(wanted))])


def bm25(docs: DataFrame, query: str, id_col: str, text_col: str, k: int = 10, eligible: DataFrame | None = None, eligible_ids: list | None = None) -> DataFrame:
    """The k best documents (id, score, rank) for any of the query's terms; repeated terms count each time.

    Statistics cover the whole table, eligible or not; an empty list of eligible ids gives no rows. Scores are rounded
    to 9 places, so that the order of sums cannot decide ties; ties go by id.
    """
    spark = docs.sparkSession
    terms = query_tokens(query)
    wanted = sorted(set(terms))
    if not wanted or eligible_ids == []:
        return spark.createDataFrame([], f"{id_col} {dict(docs.dtypes)[id_col]}, score double, rank int")
    stats = statistics(docs, id_col, text_col, wanted)
    # One row of totals: document count, mean length and the document frequency of each term.
    totals = stats.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(wanted))]).first()
    n, mean = totals["n"], totals["mean"] or 1.0
    parts = []
    for i, w in enumerate(wanted):
        df = totals[f"df_{i}"]
        idf = math.log((n - df + 0.5) / (df + 0.5)) if n else 0.0
        idf = idf if idf > 0 else 1e-6
        tf = F.col(f"tf_{i}")
        parts.append(F.lit(float(terms.count(w)) * idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.lit(float(mean)))))
    score = F.round(sum(parts[1:], parts[0]), 9)
    found = stats.where(F.col("hits") > 0)
    if eligible_ids is not None:
        found = found.where(F.col(id_col).isin(eligible_ids))
    if eligible is not None:
        found = found.join(eligible.select(id_col).distinct(), id_col, "left_semi")
    best = found.select(id_col, score.alias("score")).orderBy(F.desc("score"), id_col).limit(k)
    return with_rank(best, "score", id_col)


def with_rank(best: DataFrame, score_col: str, id_col: str) -> DataFrame:
    """Ranks a relation that a limit has made small."""
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score_col), F.asc(id_col))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit_vector(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 1e-12, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine_top(vectors: DataFrame, query: list[float], id_col: str, vector_col: str, k: int = 10, where: Column | None = None) -> DataFrame:
    """The k nearest by exact cosine (id, score, rank), scores rounded to 9 places, ties by id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    size = math.sqrt(sum(float(x) ** 2 for x in query))
    v = F.col(vector_col)
    score = F.round(dot(v, q) / F.greatest(norm(v) * F.lit(size), F.lit(1e-12)), 9)
    rows = vectors if where is None else vectors.where(where)
    return with_rank(rows.select(id_col, score.alias("score")).orderBy(F.desc("score"), id_col).limit(k), "score", id_col)


def rrf(rankings: list[DataFrame], id_col: str, k: int = RRF_K) -> DataFrame:
    """Fuses rankings (id, rank): the sum of 1 / (k + rank), with each list's rank, ties by id."""
    out = None
    for i, r in enumerate(rankings):
        part = r.select(id_col, F.col("rank").alias(f"rank_{i + 1}"))
        out = part if out is None else out.join(part, id_col, "full")
    score = sum((F.coalesce(1.0 / (F.lit(k) + F.col(f"rank_{i + 1}")), F.lit(0.0)) for i in range(len(rankings))), F.lit(0.0))
    return out.withColumn("score", F.round(score, 12))


def hybrid(lexical: DataFrame, vector: DataFrame, id_col: str, k: int = 8) -> DataFrame:
    """Reciprocal rank fusion in which only ids that the lexical ranking has survive."""
    fused = rrf([lexical, vector], id_col).join(lexical.select(id_col), id_col, "left_semi")
    return with_rank(fused.orderBy(F.desc("score"), id_col).limit(k), "score", id_col)


def two_stage(ranking: DataFrame, preferred: DataFrame, id_col: str, k: int) -> DataFrame:
    """From 4 k ranked rows the first k, preferred ids first and otherwise in rank order."""
    marked = ranking.where(F.col("rank") <= 4 * k).join(preferred.select(id_col, F.lit(1).alias("_p")), id_col, "left")
    best = marked.withColumn("preferred", F.coalesce("_p", F.lit(0))).drop("_p").orderBy(F.desc("preferred"), "rank").limit(k)
    return best.withColumn("final_rank", F.row_number().over(Window.orderBy(F.desc("preferred"), "rank")))


def sync_state(old: DataFrame, new: DataFrame, id_col: str, digest_col: str) -> DataFrame:
    """(id, state): new_or_changed, stale_removed or unchanged, for an index that follows its corpus."""
    a, b = old.select(id_col, F.col(digest_col).alias("_old")), new.select(id_col, F.col(digest_col).alias("_new"))
    state = F.when(F.col("_new").isNull(), "stale_removed").when(F.col("_old").isNull() | (F.col("_old") != F.col("_new")), "new_or_changed").otherwise("unchanged")
    return a.join(b, id_col, "full").select(id_col, state.alias("state"))


def greedy_candidates(rows: DataFrame, budget: int) -> DataFrame:
    """Of rows (_group, _item in order, _size) those that may be taken by `greedy_budget`; sizes are at least 0.

    Whatever is taken leaves no earlier item of at most its size behind, as that would have fit too. So an item that
    does not fit after the earlier ones of at most its size in its own partition is never taken. Of each size a
    partition keeps at most budget / size items of a group, besides empty ones, however large the group is.
    """

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, used = object(), np.zeros(0, np.int64)  # used[s]: size of the group's items of at most s so far
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for i, (g, n) in enumerate(zip(b["_group"].to_pylist(), b["_size"].to_pylist(), strict=True)):
                if g != group:
                    # The first item stays in any case, so that a group of which nothing fits has its row.
                    group, used, keep[i] = g, np.zeros(max(0, budget) + 1, np.int64), True
                if n is not None and n <= budget and used[n] + n <= budget:
                    keep[i] = True
                    used[n:] += n
            yield b.filter(pa.array(keep))

    return rows.sortWithinPartitions("_group", "_item").mapInArrow(possible, rows.schema)


def greedy_budget(items: DataFrame, group_col: str, order_cols: list[str], size_col: str, id_col: str, budget: int) -> DataFrame:
    """Per group, ids taken in order while they fit: one that is too large is skipped, and later ones may still fit."""
    size = F.col(size_col).cast("long")
    rows = items.select(F.col(group_col).alias("_group"), F.struct(*order_cols, size.alias("_size"), F.col(id_col).alias("_id")).alias("_item"), size.alias("_size"))
    listed = greedy_candidates(rows, budget).groupBy(F.col("_group").alias(group_col)).agg(F.array_sort(F.collect_list("_item")).alias("_items"))
    kind = dict(items.dtypes)[id_col]
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{kind}>").alias("ids"))
    fold = F.aggregate(
        "_items",
        start,
        lambda a, x: F.when(a["used"] + x["_size"] <= budget, F.struct((a["used"] + x["_size"]).alias("used"), F.array_append(a["ids"], x["_id"]).alias("ids"))).otherwise(a),
    )
    return listed.select(group_col, fold.alias("f")).select(group_col, F.col("f.used").alias("used"), F.col("f.ids").alias("ids"))
