"""Beyond the bounds of broadcasts the joins shuffle, with the same results."""

import pytest

from tessera.llm import decontaminate, jaccard, url_filter
from tessera.llm.queries import QUERIES
from tests.compare import rows_of

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("module, name", [(decontaminate, "op10_benchmark_decontamination"), (jaccard, "op1_ngram_jaccard_join"), (url_filter, "op9_url_filters")])
def test_shuffled_joins_agree(spark, monkeypatch, module, name):
    small = rows_of(QUERIES[name](spark, FOLDER))
    monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows_of(QUERIES[name](spark, FOLDER)) == small
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
