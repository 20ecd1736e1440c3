"""A stored BM25 index: postings sorted by term, which a query reads for its own terms only."""

from __future__ import annotations

import hashlib
import math
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import index_tokens, query_tokens
from tessera.operators.lineage import shared_folder
from tessera.operators.retrieval import K1, B, with_rank


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fingerprint(table: DataFrame, *more: str) -> str:
    """A digest of the files that a table is read from: their paths, lengths and times of change."""
    spark = table.sparkSession
    seen = []
    for name in sorted(table.inputFiles()):
        p, fs = _path(spark, name)
        s = fs.getFileStatus(p)
        seen.append(f"{name} {s.getLen()} {s.getModificationTime()}")
    return hashlib.sha256("\n".join([*seen, *more]).encode()).hexdigest()[:32]


@dataclass(frozen=True)
class Index:
    """rows: term, id, tf, length of the text; and how many texts and words there are."""

    rows: DataFrame
    texts: int
    words: int
    id_col: str

    def top(self, query: str, k: int = 10, eligible: DataFrame | None = None) -> DataFrame:
        """The k best texts (id, score, rank) for any of the query's terms; repeated terms count each time.

        Statistics cover the whole index, eligible or not. Scores are rounded to 9 places, so that the order of sums
        cannot decide ties; ties go by id.
        """
        terms = query_tokens(query)
        wanted = sorted(set(terms))
        found = self.rows.where(F.col("term").isin(wanted))
        # One number for each term of the question.
        df = {r["term"]: r["n"] for r in found.groupBy("term").agg(F.count("*").alias("n")).collect()} if wanted else {}
        if not df:
            return found.select(F.col("id").alias(self.id_col), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
        mean = self.words / self.texts or 1.0
        idf = {w: math.log((self.texts - n + 0.5) / (n + 0.5)) for w, n in df.items()}
        weight = F.lit(0.0)
        for w, x in idf.items():
            weight = F.when(F.col("term") == w, F.lit(terms.count(w) * (x if x > 0 else 1e-6))).otherwise(weight)
        part = weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(float(mean))))
        scored = found.groupBy(F.col("id").alias(self.id_col)).agg(F.round(F.sum(part), 9).alias("score"))
        if eligible is not None:
            scored = scored.join(eligible.select(self.id_col).distinct(), self.id_col, "left_semi")
        return with_rank(scored.orderBy(F.desc("score"), self.id_col).limit(k), "score", self.id_col)


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, id, length, tf) of all texts."""
    tokens = docs.select(F.col(id_col).alias("id"), index_tokens(text_col).alias("t")).select("id", F.size("t").alias("length"), "t")
    return tokens.select("id", "length", F.explode("t").alias("term")).groupBy("term", "id", "length").agg(F.count("*").alias("tf"))


def refreshed(rows: DataFrame, changed: DataFrame, removed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Postings after texts changed, came or went: those of their ids are dropped, and those of the new texts added."""
    gone = changed.select(F.col(id_col).alias("id")).unionAll(removed.select(F.col(id_col).alias("id"))).distinct()
    return rows.join(gone, "id", "left_anti").unionByName(postings(changed, id_col, text_col))


def build(docs: DataFrame, id_col: str, text_col: str, folder: str) -> None:
    """Writes the index of docs to a folder that must not exist. Null and empty texts count, with no words.

    Postings are dealt by ranges of term and id, so those of a frequent term lie in many files, and sorted, so the
    statistics of files and row groups show which hold a term.
    """
    spark = docs.sparkSession
    rows = postings(docs, id_col, text_col)
    work = f"{folder}.{uuid.uuid4().hex}"
    rows.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.option("parquet.block.size", 1 << 22).parquet(f"{work}/postings")
    words = spark.read.parquet(f"{work}/postings").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("words"))
    texts = docs.agg(F.count("*").alias("texts"))
    texts.join(F.broadcast(words)).write.parquet(f"{work}/totals")  # one row each
    a, fs = _path(spark, work)
    b, _ = _path(spark, folder)
    if fs.exists(b) or not fs.rename(a, b):
        fs.delete(a, True)  # another session has been faster


def stored(docs: DataFrame, id_col: str, text_col: str) -> Index:
    """The index of a table read from files: kept in the shared folder, built where it is missing or files changed."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/bm25-{fingerprint(docs, id_col, text_col)}"
    p, fs = _path(spark, f"{folder}/totals/_SUCCESS")
    if not fs.exists(p):
        _, parents = _path(spark, folder)
        parents.mkdirs(_path(spark, shared_folder(spark))[0])
        build(docs, id_col, text_col, folder)
    totals = spark.read.parquet(f"{folder}/totals").first()
    return Index(spark.read.parquet(f"{folder}/postings"), totals["texts"], totals["words"], id_col)
