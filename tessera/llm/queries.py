"""The registered query of each operator, with production parameters, on its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, html_text, jaccard, language, lm_score, packing, passage_dedup, quality, toxicity, url_filter
from tessera.llm.common import table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _number(x):
    """A number below 2**24 from any string, the same in SQL."""
    return F.conv(F.substring(F.md5(x), 1, 6), 16, 10).cast("int")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables carry no fetch dates and no lists: both follow from digests of page ids, hosts and first path parts."""
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    pages = table(spark, sf_dir, "pages").select("page_id", "url", day(_number(F.col("page_id").cast("string")) % 365).alias("fetched"))
    named = pages.select(url_filter.host(F.col("url")).alias("h"), F.lower(F.regexp_extract(url_filter.path(F.col("url")), "^/+([^/]+)", 1)).alias("p")).where("h <> ''")
    named = named.select(F.explode(F.array(F.struct(F.lit("domain").alias("kind"), F.col("h").alias("pattern")), F.struct(F.lit("domain").alias("kind"), F.regexp_replace("h", "^[^.]+\\.", "").alias("pattern")), F.struct(F.lit("prefix").alias("kind"), F.when(F.col("p") != "", F.concat_ws("/", "h", "p")).alias("pattern")))).alias("e"))
    named = named.select("e.kind", "e.pattern").where(F.col("pattern").isNotNull()).distinct().withColumn("b", _number(F.col("pattern"))).where("b % 3 = 0")
    start = (F.col("b") / 7).cast("int") % 300
    entries = named.select(
        F.element_at(F.array(*[F.lit(x) for x in ("adult", "malware", "spam")]), F.col("b") % 5 % 3 + 1).alias("list_name"),
        "kind",
        "pattern",
        F.explode(F.array(*[F.struct(F.lit(a).alias("action"), day(d).alias("entry_date")) for a, d in (("add", start), ("remove", start + F.col("b") % 90 + 1), ("add", start + F.col("b") % 90 + 61))])).alias("x"),
    ).select("list_name", "kind", "pattern", "x.action", "x.entry_date")
    return url_filter.url_filter(pages, entries, "page_id", "url", "fetched")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), *tokenizer_paths())


def tokenizer_paths() -> tuple[str, str]:
    """The public vocabulary, and the same as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"), order=3)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language(table(spark, sf_dir, "documents"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup.dedup(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_quality_rules": op2_quality_rules,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_html_extraction": op4_html_extraction,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_language_id": op6_language_id,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_url_filters": op9_url_filters,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
}
