"""Every stage of the pipeline on nulls, repeated rows, empty and long texts, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as c

FOLDER = "/root/testdata/sf0.001"
A = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
CLASHES = ("_key", "_row", "_id", "_null", "kept", "score", "predicted", "held_out", "class_id", "class_key", "text_key", "digest", "batch")
ROWS = [
    (1, A, "en"),
    (None, A, "en"),
    (2, A.upper(), "en"),
    (6, A + " phi", "de"),
    (6, "a text of its own under the same number as another", "de"),
    (7, None, None),
    (8, "", "en"),
    (9, "word " * 30_000, "en"),
    (10, "repeated row of a document that is no copy of another one", "fr"),
    (10, "repeated row of a document that is no copy of another one", "fr"),
    (None, "nobody knows the number of this first text at all", None),
    (None, "nor does anybody know the one of this second text", None),
]


@pytest.fixture
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    df = df.withColumn("n_chars", F.length("text"))
    for name in CLASHES:
        df = df.withColumn(name, F.lit("x"))
    return df


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name, stage", c.STAGES[:-1])
def test_columns_and_empty_tables(spark, docs, name, stage):
    out = stage(spark, docs, FOLDER)
    assert out.columns == docs.columns
    assert out.where(" and ".join(f"{x} = 'x'" for x in CLASHES)).count() == out.count() > 0
    assert stage(spark, docs.limit(0), FOLDER).count() == 0


def test_clean_rows_stay(spark, docs):
    assert pairs(c.drop_toxic(spark, docs, FOLDER)) == sorted(((i, t) for i, t, _ in ROWS), key=repr)
    assert pairs(c.drop_contaminated(spark, docs, FOLDER)) == sorted(((i, t) for i, t, _ in ROWS), key=repr)


def test_contaminated_rows_go(spark):
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first()["text"]
    df = spark.createDataFrame([(1, item), (None, item), (2, "clean")], "doc_id long, text string")
    assert pairs(c.drop_contaminated(spark, df, FOLDER)) == [(2, "clean")]


def test_one_row_of_each_group_stays(spark, docs):
    assert pairs(c.drop_near_duplicates(spark, docs, FOLDER)) == sorted(
        [(1, A), (6, ROWS[4][1]), (7, None), (9, ROWS[7][1]), (10, ROWS[8][1]), (None, ROWS[10][1]), (None, ROWS[11][1])], key=repr
    )


def test_passages_go_and_rows_stay(spark, docs):
    got = {(r["doc_id"], r["lang"]): r for r in c.remove_repeated_passages(spark, docs, FOLDER).collect()}
    assert len(c.remove_repeated_passages(spark, docs, FOLDER).collect()) == len(ROWS)
    assert got[7, None]["text"] is None and got[7, None]["n_chars"] is None and got[8, "en"]["text"] == ""
    assert got[1, "en"]["text"] == A and got[None, "en"]["text"] == ""
    assert got[9, "en"]["n_chars"] == len(got[9, "en"]["text"]) < 110


def test_pieces_of_every_row(spark, docs):
    out = c.pack(spark, docs, FOLDER)
    assert out.where("piece = 0").count() == len(ROWS)
    assert c.pack(spark, docs.limit(0), FOLDER).count() == 0
