"""Each query that SQL can express against its SQL, and the shapes of all results."""

import pytest

from tessera.llm.queries import QUERIES
from tessera.llm.sql import ORACLES
from tests.compare import connect, rows_of, rows_of_sql

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    columns, got = rows_of(QUERIES[name](spark, FOLDER))
    wanted_columns, wanted = rows_of_sql(connect(FOLDER), ORACLES[name])
    assert columns == wanted_columns
    assert got == wanted


def test_one_query_per_operator():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 11))


def test_op5_scores_by_two_words_of_context(spark, tmp_path):
    texts = [(1, "a b c"), (2, "p b c")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["n_backoff"] for r in QUERIES["op5_lm_scoring"](spark, str(tmp_path)).collect()}
    # 'b' backs off, as 'a b' is in no other text, and 'c' as 'a b c' is in none, though 'b c' is.
    assert got == {1: 2, 2: 2}
