"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns with clashing names."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, html_text, jaccard, language, lm_score, packing, passage_dedup, quality, toxicity, url_filter
from tessera.llm.queries import tokenizer_paths

LONG = "word " * 30_000
ROWS = [
    (1, "one two three four five six seven eight nine ten eleven twelve thirteen", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, " \n\t ", "de"),
    (5, LONG, "en"),
    (6, "one two three four five six seven eight nine ten eleven twelve thirteen", "fr"),
    (6, "one two three four five six seven eight nine ten eleven twelve thirteen", "fr"),
    (None, "no id here", None),
    (None, None, None),
]


@pytest.fixture
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    for clash in ("score", "_key", "id", "batch", "digest", "length", "n_words", "kept", "_row", "held_out", "piece"):
        df = df.withColumn(clash, F.lit("x"))
    return df


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


LABELS = "doc_id long, toxic int"
ITEMS = "item_id long, text string"


def labels(spark):
    return spark.createDataFrame([(1, 0), (5, 1), (None, 1), (9, None)], LABELS)


def items(spark):
    return spark.createDataFrame([(1, "TWO three four"), (2, None), (3, ""), (4, "seven eight nine ten eleven twelve thirteen one two three four five six"), (1, "TWO three four")], ITEMS)


def test_quality(docs, nothing):
    out = quality.quality(docs)
    assert out.count() == len(ROWS)
    r = {x["doc_id"]: x for x in out.collect()}
    assert (r[5]["n_words"], r[5]["n_repeat_words"], r[5]["base_failed"], r[5]["kept"]) == (30_000, 30_000, True, False)
    assert (r[2]["n_words"], r[2]["word_chars"], r[2]["kept"]) == (0, 0, False)
    assert quality.quality(nothing).count() == 0


def test_packing(docs, nothing):
    rows = packing.pack(docs, *tokenizer_paths()).collect()
    assert sum(r["piece"] == 0 for r in rows) == len(ROWS)
    by: dict = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert min(r["length"] for r in rows if r["doc_id"] == 2) == 1
    long = sorted((r["start"], r["length"]) for r in rows if r["doc_id"] == 5)
    assert all(n == 1024 for _, n in long[1:]) and long[1][0] == long[0][1]
    assert packing.pack(nothing, *tokenizer_paths()).count() == 0


def test_html(spark):
    page = "<html><head><title>T</title></head><body><nav>menu</nav><article><p>A &amp; b\n c<p>d</article><footer>f</footer>"
    df = spark.createDataFrame([(1, page), (2, None), (3, ""), (None, "<p>" * 5000), (1, page), (4, "<<<>>> & &#x41 <b")], "page_id long, html string").withColumn("text", F.lit("clash"))
    r = [x["text"] for x in html_text.extract(df).collect()]
    assert r[0] == r[4] == "A & b c\nd" and r[1] == r[2] == r[3] == ""
    assert html_text.extract(df.limit(0)).count() == 0


def test_lm(docs, nothing):
    out = lm_score.score(docs).collect()
    assert len(out) == len(ROWS)
    assert all((r["score"] is None) == (r["n_words"] == 0) for r in out)
    assert lm_score.score(nothing).count() == 0


def test_language(docs, nothing):
    out = language.language(docs, rows_per_language=5, steps=3).collect()
    assert len(out) == len(ROWS)
    assert all(0 <= r["score"] <= 1 for r in out)
    assert {r["lang_pred"] for r in out if r["doc_id"] in (2, 3, 4)} == {"und"}
    assert language.language(nothing).count() == 0
    assert {r["lang_pred"] for r in language.language(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_samples_are_bounded(spark):
    rows = [(1, "eins zwei drei " * 50, "de")] * 300 + [(i, f"one two three {i} " * 50, "en") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    original = language.train
    language.train = lambda samples, labels, **o: seen.append(samples) or original(samples, labels, **o)
    try:
        net = language.learn(df, rows_per_language=20, steps=1)
    finally:
        language.train = original
    assert net.labels == ["de", "en"] and 0 < len(seen[0]) <= 2 * 2 * 20 * 2
    assert sum(y == 0 for _, y in seen[0]) <= 2


def test_passages(docs, nothing):
    out = passage_dedup.dedup(docs).collect()
    assert len(out) == len(ROWS)
    r = {x["doc_id"]: x for x in out if x["doc_id"]}
    assert (r[2]["n_bytes"], r[2]["kept_sha256"]) == (0, hashlib.sha256(b"").hexdigest())
    assert r[5]["n_bytes"] - r[5]["n_removed"] < 110 and r[5]["n_spans"] == 1
    assert r[1]["n_removed"] == 0  # shorter than a span
    assert passage_dedup.dedup(nothing).count() == 0


def test_toxicity(spark, docs, nothing):
    out = toxicity.toxicity(docs, labels(spark))
    assert sorted(out.columns) == sorted([*docs.columns, "predicted"])  # score and held_out are replaced, others stay
    out = out.collect()
    assert len(out) == len(ROWS) and all(0 <= r["score"] <= 1 and r["digest"] == "x" for r in out)
    least = min(r["score"] for r in out)
    assert all(r["score"] == least for r in out if r["doc_id"] in (2, 3, 4))
    assert [r["held_out"] for r in out if r["doc_id"] is None] == [False, False]
    assert toxicity.toxicity(docs, spark.createDataFrame([], LABELS)).count() == len(ROWS)
    assert toxicity.toxicity(nothing, spark.createDataFrame([], LABELS)).count() == 0


def test_decontamination(spark, docs, nothing):
    out = decontaminate.decontaminate(docs, items(spark)).collect()
    r = {x["doc_id"]: x for x in out if x["doc_id"]}
    assert (r[1]["n_words"], r[1]["n_hit"], r[1]["n_items"], r[1]["contaminated"]) == (13, 3, 1, True)
    assert r[1]["items_sha256"] == hashlib.sha256(b"1").hexdigest()
    assert (r[5]["n_words"], r[5]["n_hit"], r[2]["n_words"]) == (30_000, 0, 0)
    assert len([x for x in out if x["doc_id"] == 6]) == 1  # repeated rows are one document
    assert decontaminate.decontaminate(nothing, items(spark)).count() == 0
    assert all(not x["contaminated"] for x in decontaminate.decontaminate(docs, spark.createDataFrame([], ITEMS)).collect())


def test_jaccard(docs, nothing):
    out = jaccard.join(docs).collect()
    assert len(out) == len(ROWS)
    r = {x["doc_id"]: x for x in out if x["doc_id"]}
    assert r[6]["class_id"] == 1 and r[6]["n_links"] == 2
    assert r[3]["class_id"] == r[4]["class_id"] == 2 and r[5]["n_links"] == 0
    assert jaccard.join(nothing).count() == 0


def test_urls(spark):
    day = lambda d: F.date_add(F.lit("2024-01-01").cast("date"), d)
    pages = spark.createDataFrame([(1, "http://a.b.example.com/x/y?q#f", 5), (2, "https://U:P@A.B.Example.com:8080/", 20), (3, None, 5), (4, "no url", 5), (5, "http://example.com/x", None), (1, "http://a.b.example.com/x/y?q#f", 5)], "page_id long, url string, d int").withColumn("at", day(F.col("d"))).withColumn("host", F.lit("clash"))
    entries = spark.createDataFrame([("l1", "domain", "example.com", "add", 0), ("l1", "domain", "Example.com", "remove", 10), ("l1", "domain", "example.com", "add", 10), ("l2", "prefix", "a.b.example.com/x", "add", 5), ("l2", "prefix", "a.b.example.com/x", "add", 6), ("l3", "domain", None, "add", 0), ("l3", "domain", "b.example.com", "add", None)], "list_name string, kind string, pattern string, action string, d int").withColumn("entry_date", day(F.col("d")))
    out = {r["page_id"]: r for r in url_filter.url_filter(pages, entries, "page_id", "url", "at").collect()}
    assert (out[1]["n_entries"], out[1]["lists"], out[1]["matched"]) == (2, "l1,l2", "a.b.example.com/x")
    assert [out[i]["blocked"] for i in (2, 3, 4, 5)] == [False] * 4
    assert out[2]["host"] == "a.b.example.com"
    spans = url_filter.intervals(entries).collect()
    assert len(spans) == 2
    assert url_filter.url_filter(pages.limit(0), entries, "page_id", "url", "at").count() == 0
    assert url_filter.url_filter(pages, entries.limit(0), "page_id", "url", "at").where("blocked").count() == 0


def test_no_operator_names_a_local_folder():
    import pathlib

    import tessera.llm

    for p in pathlib.Path(tessera.llm.__file__).parent.glob("*.py"):
        assert not re.search(r"localCheckpoint|crossJoin|tempfile|gettempdir|/tmp", p.read_text()), p
