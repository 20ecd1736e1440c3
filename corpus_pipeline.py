"""The corpus pipeline: toxic documents go, one document of each group of near duplicates stays, passages that repeat
are removed, contaminated documents go, and what is left is packed into sequences."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard, packing, passage_dedup, toxicity
from tessera.llm.common import broadcast_if, release, shared_folder, table, text_key
from tessera.llm.queries import tokenizer_paths

#: Up to so many digests (about 20 bytes each) are broadcast; beyond it both sides are shuffled.
BROADCAST_ROWS = 300_000


def _rows(docs: DataFrame, key) -> DataFrame:
    """Each row as one struct beside a key, so that no column of docs meets a name that a stage uses."""
    return docs.select(F.struct("*").alias("_row"), key.alias("_key"))


def _row_key(text_key_col) -> F.Column:
    """A digest of id and text: rows that agree in both are the same document."""
    id_ = F.col("doc_id").cast("string")
    return F.unhex(F.md5(F.concat_ws(":", F.hex(text_key_col), F.coalesce(id_, F.lit("null")))))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator predicts toxic go. Every row is judged by its own text; null and empty texts
    are clean and stay, as do null ids and repeated rows. An empty table stays empty."""
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", "text")
    return toxicity.toxicity(rows, table(spark, sf_dir, "labels")).where("predicted = 0").select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class one row stays: that of the least id (a null id only if all of the class are null), of rows of that
    id that of the least text digest, of rows that agree in both any one. Texts without words are one class."""
    found = jaccard.join(docs, with_keys=True).withColumn("_key", _row_key(F.col("text_key")))
    first = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("text_key").alias("c"), F.col("_key").alias("key"))
    stay = found.groupBy("class_key").agg(F.min(first).alias("first")).select(F.col("first.key").alias("_key"))
    kept = _rows(docs, _row_key(text_key())).join(stay, "_key", "left_semi")
    return kept.dropDuplicates(["_key"]).select("_row.*")


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose what repeats; bytes of a character that is only partly kept go too. All rows stay: a null text stays
    null, a text that repeats altogether becomes empty, and rows that agree in id and text lose the same."""
    kept = passage_dedup.dedup(docs, keep_text=True).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "kept").dropDuplicates(["_id", "_key"])
    keyed = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("_row"), F.col("text").isNull().alias("_null"), text_key().alias("_key"))
    joined = keyed.join(kept, keyed["_row"]["doc_id"].eqNullSafe(kept["_id"]) & (keyed["_key"] == kept["_key"]))
    text = F.when(~F.col("_null"), F.col("kept"))
    out = joined.select("_row.*", text.alias("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is contaminated by the benchmark go. Every row is judged by its own text: null and empty
    texts have no words and stay, as do null ids and repeated rows."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    bad = found.where("contaminated").select("_key").distinct()
    return _rows(docs, text_key()).join(broadcast_if(bad, BROADCAST_ROWS), "_key", "left_anti").select("_row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of each row, null texts being empty, with its sequence and place there."""
    return packing.pack(docs, *tokenizer_paths())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("suffix_array_dedup", remove_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]

#: Learning, a network of links and a suffix array are beyond SQL; a brute-force version in the tests checks run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written as Parquet in the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:  # its successor is written
            _delete(spark, f"{folder}/{before}")
        release(spark)
        before = name
    return docs


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
