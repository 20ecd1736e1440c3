"""Profiles of tables read as text, and their projection to entities, relations and values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import numeric, text


def unpivot(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, column, value) with values as strings."""
    return df.select(*keys, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(keys, columns, "column", "value")


def profile(df: DataFrame, columns: list[str] | None = None, samples: int = 5) -> DataFrame:
    """Per column: normalised label, unit in the label, datatype (numeric, range or categorical), nullable, number of
    rows, empties and distinct values, and its least values as samples. One pass over the table."""
    columns = columns or df.columns
    cells = unpivot(df, [], columns)
    t = F.trim(F.coalesce("value", F.lit("")))
    cells = cells.withColumn("v", F.when(t != "", t)).withColumn("kind", numeric.table_value(t)["kind"])
    per = cells.groupBy("column").agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("v").isNull()).alias("n_empty"),
        F.countDistinct("v").alias("n_distinct"),
        F.every(F.col("v").isNull() | (F.col("kind") == "number")).alias("all_numbers"),
        F.every(F.col("v").isNull() | F.col("kind").isin("number", "range", "approximate")).alias("all_ranges"),
        F.min("v").alias("least_value"),
        F.max("v").alias("greatest_value"),
    )
    unit = F.regexp_extract("column", "\\(([^)]*)\\)", 1)
    return per.select(
        "column",
        text.label("column").alias("label"),
        F.when(unit != "", unit).alias("unit"),
        F.when(F.col("all_numbers"), "numeric").when(F.col("all_ranges"), "range").otherwise("categorical").alias("datatype"),
        (F.col("n_empty") > 0).alias("nullable"),
        "n_rows",
        "n_empty",
        "n_distinct",
        "least_value",
        "greatest_value",
    )


def rename(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Columns whose normalised label is an alias get its name; the others keep theirs."""
    import re

    def name(c: str) -> str:
        return aliases.get(re.sub(r"[^a-z0-9]+", " ", re.sub(r"\([^)]*\)", "", c).lower()).strip(), c)

    return df.select(*[F.col(f"`{c}`").alias(name(c)) for c in df.columns])


def relations(parts: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """One edge list from (table, subject column, relation, object column)."""
    return reduce(DataFrame.unionAll, [df.select(F.col(s).cast("string").alias("subject"), F.lit(r).alias("relation"), F.col(o).cast("string").alias("object")).where("object IS NOT NULL") for df, s, r, o in parts])


def role_hint(columns: list[str], roles: dict[str, set[str]]) -> str:
    """The role whose words the column labels share most, ties by name; `unknown` if none."""
    words = {w for c in columns for w in c.lower().replace("_", " ").split()}
    best = max(sorted(roles), key=lambda r: len(words & roles[r]), default="unknown")
    return best if roles and words & roles[best] else "unknown"
