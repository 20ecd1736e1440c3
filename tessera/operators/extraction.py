"""Exact spans in text: anchors, segments, quotes located after normalisation, values bound to names, window packing.

What needs a scan of one text with state is a plain function, applied to texts in Arrow batches; everything relational
around it stays in Spark.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.units import UNITS

#: Words whose full stop ends no sentence (fixed values).
ABBREVIATIONS = frozenset("dr mr mrs ms prof fig figs eq eqs ref refs no vol vs etc al approx cf e.g i.e sec ch st".split())
_END = re.compile(r"[.!?]+(?=[\"')\]]*(?:\s|$))")


def anchors(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of sentences, bullets and headings, with exact offsets; together they hold all words."""
    out = []
    for line in re.finditer(r"[^\n]+", text or ""):
        body = line.group()
        if not body.strip():
            continue
        lead = len(body) - len(body.lstrip())
        begin, end = line.start() + lead, line.start() + len(body.rstrip())
        if re.match(r"(?:[-*•]|\d+[.)])\s", body.strip()):
            out.append((begin, end, "bullet"))
            continue
        at = begin
        for m in _END.finditer(text, begin, end):
            word = re.findall(r"[\w.]+$", text[at : m.start()])
            last = word[0].lower() if word else ""
            if m.group() == "." and (last in ABBREVIATIONS or re.fullmatch(r"[a-z]|\d+", last) and m.end() < end and text[m.end() : m.end() + 2].strip()[:1].islower()):
                continue
            out.append((at, m.end(), "sentence"))
            at = m.end()
            while at < end and text[at].isspace():
                at += 1
        if at < end:
            out.append((at, end, "sentence" if len(body.split()) > 8 else "heading"))
    return out


def segments(text: str | None, most: int = 4000) -> list[tuple[int, int]]:
    """Ranges that cover every character in order, each at most `most` long: cut at a heading or blank line if there is
    one, else at a sentence's end past the middle, else at a space, else anywhere."""
    t = text or ""
    out, at = [], 0
    while at < len(t):
        end = min(len(t), at + most)
        if end < len(t):
            part = t[at:end]
            breaks = [m.end() for m in re.finditer(r"\n[ \t]*\n", part)] or [m.end() for m in _END.finditer(part) if m.end() > most // 2] or [m.end() for m in re.finditer(r"\s", part)]
            if breaks:
                end = at + breaks[-1]
        out.append((at, end))
        at = end
    return out


def normalise(text: str) -> tuple[str, list[int]]:
    """Text in NFC with runs of white space as one space, and the offset of each of its characters in the original."""
    out, offsets, i = [], [], 0
    while i < len(text):
        if text[i].isspace():
            j = i
            while j < len(text) and text[j].isspace():
                j += 1
            out.append(" ")
            offsets.append(i)
        else:
            j = i + 1
            while j < len(text) and unicodedata.combining(text[j]):
                j += 1
            for c in unicodedata.normalize("NFC", text[i:j]):
                out.append(c)
                offsets.append(i)
        i = j
    return "".join(out), offsets


def recover(quote: str | None, text: str | None) -> tuple[int, int] | None:
    """The place of a quote in a text: where it occurs exactly once, else where it does so after normalisation."""
    if not quote or not text:
        return None
    if text.count(quote) == 1:
        at = text.index(quote)
        return at, at + len(quote)
    q, (t, offsets) = normalise(quote)[0].strip(), normalise(text)
    if not q or t.count(q) != 1:
        return None
    at = t.index(q)
    last = at + len(q)
    return offsets[at], offsets[last] if last < len(offsets) else len(text)


def respectively(clause: str, names: list[str]) -> list[tuple[str, str]]:
    """(name, value) of a clause: by position where it says `respectively`, else each value with the nearest name."""
    number = re.compile(r"[-+]?\d+(?:\.\d+)?\s*(?:%|[a-zA-Zµμ°]+(?:/[a-z]+)?)?")
    found = sorted((m.start(), n) for n in names for m in re.finditer(rf"(?<![\w-]){re.escape(n)}(?![\w-])", clause, re.I))
    values = [(m.start(), re.sub(r"\s*(?:and|or|to|for|in|at|of)$", "", m.group().strip())) for m in number.finditer(clause)]
    if re.search(r"\brespectively\b", clause, re.I):
        return list(zip((n for _, n in found), (v for _, v in values), strict=True)) if len(found) == len(values) else []
    return [(min(found, key=lambda f: (abs(f[0] - at), f[0]))[1], v) for at, v in values if found]


#: Words that deny (fixed values).
NEGATIONS = "not|no|never|without|except|excluding|cannot|can't"


def hard_anchors(text: str, names: tuple[str, ...] = ()) -> set[str]:
    """What a rewording must keep: numbers with units, identifiers, quoted words, negations, and registered names of
    entities, properties and sources."""
    known = {n.lower() for n in names if re.search(rf"(?<![\w-]){re.escape(n)}(?![\w-])", text, re.I)}
    codes = re.compile(r"\b[A-Z]{2,}[-_]?\d+\b|\b10\.\d{4,}/\S+")
    spelled = "|".join(re.escape(u) for u in sorted(UNITS, key=len, reverse=True))
    out = known | {m.lower() for m in codes.findall(text)}
    out |= {re.sub(r"\s+", "", m).lower() for m in re.findall(rf"(?<![\w-])[-+]?\d+(?:\.\d+)?(?:\s*(?:{spelled})(?!\w))?", codes.sub(" ", text), re.I)}
    out |= {m.lower() for m in re.findall(r"\"([^\"]+)\"", text)}
    return out | {m.lower() for m in re.findall(rf"\b(?:{NEGATIONS})\b", text, re.I)}


def keeps_meaning(original: str, reworded: str, names: tuple[str, ...] = ()) -> bool:
    """Whether a rewording adds or loses no hard anchor."""
    return hard_anchors(original, names) == hard_anchors(reworded, names)


def kept_meaning(original: Column | str, reworded: Column | str, names: tuple[str, ...] = ()) -> Column:
    """The same for columns, in Arrow batches; null counts as empty."""

    @F.pandas_udf("boolean")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([keeps_meaning(x or "", y or "", names) for x, y in zip(a, b, strict=True)], dtype=bool)

    return run(original, reworded)


def _spans(df: DataFrame, id_col: str, text_col: str, find, schema: str) -> DataFrame:
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *x) for i, t in zip(b["_id"], b["_t"], strict=True) for x in find(t)]
            if rows:
                yield pd.DataFrame(rows, columns=["_id", *[c.split()[0] for c in schema.split(", ")]])

    out = df.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_t")).mapInPandas(run, "_id string, " + schema)
    return out.withColumn("_id", F.col("_id").cast(kind)).withColumnRenamed("_id", id_col)


def anchor_table(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, start, end, kind) of all anchors."""
    return _spans(df, id_col, text_col, anchors, "start int, end int, kind string")


def segment_table(df: DataFrame, id_col: str, text_col: str, most: int = 4000) -> DataFrame:
    """(id, start, end) of all structural segments."""
    return _spans(df, id_col, text_col, lambda t: segments(t, most), "start int, end int")


def recover_table(pairs: DataFrame, quote_col: str, text_col: str) -> DataFrame:
    """Adds start and end of each quote in its text, null where it is not found or not unique."""

    @F.pandas_udf("start int, end int")
    def run(quotes: pd.Series, texts: pd.Series) -> pd.DataFrame:
        found = [recover(q, t) for q, t in zip(quotes, texts, strict=True)]
        return pd.DataFrame({"start": pd.array([f and f[0] for f in found], "Int32"), "end": pd.array([f and f[1] for f in found], "Int32")})

    return pairs.withColumn("_s", run(quote_col, text_col)).withColumn("start", F.col("_s.start")).withColumn("end", F.col("_s.end")).drop("_s")


def pack_windows(rows: DataFrame, by: str, order: list[str], size: str, budget: int) -> DataFrame:
    """Numbers consecutive rows of a group so that windows of the same number stay within a budget of size; a row over
    the budget is a window of its own."""
    listed = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(size).cast("long").alias("_size")))).alias("_rows"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("number"), F.array().cast("array<int>").alias("numbers"))

    def step(a: Column, x: Column) -> Column:
        fits = (a["used"] == 0) | (a["used"] + x["_size"] <= budget)
        number = F.when(fits, a["number"]).otherwise(a["number"] + 1)
        return F.struct(F.when(fits, a["used"] + x["_size"]).otherwise(x["_size"]).alias("used"), number.alias("number"), F.array_append(a["numbers"], number).alias("numbers"))

    folded = listed.select(by, "_rows", F.aggregate("_rows", start, step)["numbers"].alias("_numbers"))
    return folded.select(by, F.explode(F.arrays_zip("_rows", "_numbers")).alias("x")).select(by, *[F.col(f"x._rows.{c}").alias(c) for c in order], F.col("x._numbers").alias("window"))


def coverage(text_spans: DataFrame, lengths: DataFrame, id_col: str, length_col: str) -> DataFrame:
    """Share of each text that merged spans (start, end) cover; 0 without spans."""
    used = text_spans.groupBy(id_col).agg(F.sum(F.col("end") - F.col("start")).alias("_used"))
    return lengths.join(used, id_col, "left").select(id_col, (F.coalesce("_used", F.lit(0)) / F.greatest(F.col(length_col), F.lit(1))).alias("coverage"))


def nearest_heading(spans: DataFrame, headings: DataFrame, by: str, label: str, out: str) -> DataFrame:
    """The label of the last heading at or before each span's start, without a range join: both are sorted together."""
    a = spans.select(by, F.col("start").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("_label"), F.struct(*spans.columns).alias("_row"))
    empty = F.lit(None).cast(a.schema["_row"].dataType)
    h = headings.select(by, F.col("start").alias("_at"), F.lit(0).alias("_kind"), F.col(label).alias("_label"), empty.alias("_row"))
    w = Window.partitionBy(by).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(h).withColumn(out, F.last("_label", ignorenulls=True).over(w)).where("_kind = 1").select("_row.*", out)
