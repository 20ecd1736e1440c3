"""Quality rules: a threshold table compiled into one Spark projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of the corpus languages (fixed values).
STOP_WORDS = (
    "the be to of and that have with in is it for as was on are by this from at an a "
    "der die und das ist nicht mit von den dem ein eine für auf zu sich im "
    "le la les de des et est un une que dans pour qui sur avec pas du en au par "
    "el los las una y se por con del para no su al como ó"
).split()
#: Characters that count as symbols (fixed values).
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A document fails where metric lies outside [low, high]; None leaves a side open."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Metrics are those of `metrics`.
RULES = (
    Rule("length", "n_words", 50, 100_000),
    Rule("word_length", "mean_word_length", 2.0, 12.0),
    Rule("symbols", "symbol_ratio", None, 0.1),
    Rule("emphasis", "emphasis_ratio", None, 0.1),
    Rule("letters", "letter_word_ratio", 0.8, None),
    Rule("stop_words", "stop_ratio", 0.02, None),
    Rule("repeated_lines", "dup_line_ratio", None, 0.5),
    Rule("bullets", "bullet_line_ratio", None, 0.9),
    Rule("ellipses", "ellipsis_line_ratio", None, 0.3),
    Rule("repeated_words", "repeat_word_ratio", None, 0.5),
)


def _let(value: Column, body) -> Column:
    """Bind a value once inside an expression: a one-element array, transformed and opened."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs again: sort windows, keep equal neighbours, add the union of their spans."""

    def marked(pairs: Column) -> Column:
        n = F.size(pairs)
        twice = F.filter(
            pairs,
            lambda p, i: ((i > 0) & (F.get(pairs, i - 1)["h"] == p["h"])) | ((i + 1 < n) & (F.get(pairs, i + 1)["h"] == p["h"])),
        )
        return F.array_sort(F.transform(twice, lambda p: p["i"]))

    def span(places: Column) -> Column:
        return F.aggregate(
            places,
            F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-3).alias("last")),
            lambda a, p: F.struct((a["sum"] + F.least(F.lit(3), p - a["last"])).cast("long").alias("sum"), p.alias("last")),
            lambda a: a["sum"],
        )

    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_let(_let(pairs, marked), span))


def metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All metrics for each row; a null text has no words, and every ratio of an empty text is 0."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias(id_col), text.alias("_t"))
    base = base.select(id_col, "_t", F.array_remove(F.split("_t", "[\\x20\\x09-\\x0D]+"), "").alias("_w"), F.filter(F.split("_t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("_l"))
    base = base.select(
        id_col,
        "_t",
        "_w",
        "_l",
        F.size("_w").cast("long").alias("n_words"),
        F.when(F.size("_w") >= 3, F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))).otherwise(F.array().cast("array<bigint>")).alias("_g"),
    )
    base = base.select(
        id_col,
        "n_words",
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.regexp_replace("_t", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("_g")).alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.size(F.filter("_w", lambda w: F.lower(w).isin(list(STOP_WORDS)))).cast("long").alias("n_stop_words"),
        (F.size("_w") - F.regexp_count("_t", F.lit("(?<![^\\x20\\x09-\\x0D])[^\\x20\\x09-\\x0D\\p{L}]+(?![^\\x20\\x09-\\x0D])"))).cast("long").alias("n_letter_words"),
        F.regexp_count("_t", F.lit("!!(?![^\\x20\\x09-\\x0D])")).cast("long").alias("n_emphasis"),
        F.size(F.filter("_l", lambda x: x.rlike("^[\\x20\\x09-\\x0D]*[-*•]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("_l", lambda x: x.endswith("...") | x.endswith("…"))).cast("long").alias("n_ellipsis_lines"),
    )

    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return base.select(
        "*",
        ratio("word_chars", "n_words").alias("mean_word_length"),
        ratio("n_symbols", "n_words").alias("symbol_ratio"),
        ratio("n_emphasis", "n_words").alias("emphasis_ratio"),
        ratio("n_letter_words", "n_words").alias("letter_word_ratio"),
        ratio("n_stop_words", "n_words").alias("stop_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        ratio("n_bullet_lines", "n_lines").alias("bullet_line_ratio"),
        ratio("n_ellipsis_lines", "n_lines").alias("ellipsis_line_ratio"),
        ratio("n_repeat_words", "n_words").alias("repeat_word_ratio"),
    )


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each input row: metrics, names of the failed rules, base_failed and kept.

    Null and empty texts have no words and so fail the length rule; null ids and repeated rows pass through as
    they are; columns other than id and text are not read. The whole text is always examined.
    """
    df = metrics(docs, id_col, text_col)

    def fails(r: Rule) -> Column:
        out = F.lit(False)
        if r.low is not None:
            out = out | (F.col(r.metric) < F.lit(r.low))
        if r.high is not None:
            out = out | (F.col(r.metric) > F.lit(r.high))
        return out

    failed = F.array_compact(F.array(*[F.when(fails(r), F.lit(r.name)) for r in rules])) if rules else F.array().cast("array<string>")
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    df = df.withColumn("failed_rules", failed).withColumn("base_failed", base_failed)
    return df.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
