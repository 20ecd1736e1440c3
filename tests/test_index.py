"""The stored index, closures of any depth, and folders."""

import pytest

from tessera.operators import graph as G
from tessera.operators import lineage, postings
from tessera.operators import retrieval as S

TEXTS = [(1, "Lait et café"), (2, None), (3, "café café lait"), (4, ""), (5, "thé"), (6, "lait " * 50)]


@pytest.fixture
def docs(spark, tmp_path):
    spark.createDataFrame(TEXTS, "i long, t string").write.parquet(f"{tmp_path}/d")
    return spark.read.parquet(f"{tmp_path}/d")


def test_index_ranks_as_the_scan_does(spark, docs):
    index = postings.stored(docs, "i", "t")
    assert (index.texts, index.words) == (6, 57)
    for question in ("lait", "cafe lait lait", "the", "nothing here", ""):
        assert index.top(question, 4).collect() == S.bm25(docs, question, "i", "t", 4).collect()
    some = spark.createDataFrame([(1,), (5,)], "i long")
    assert [r["i"] for r in index.top("lait the", eligible=some).orderBy("rank").collect()] == [r["i"] for r in S.bm25(docs, "lait the", "i", "t", eligible=some).orderBy("rank").collect()]


def test_index_reads_postings_only(spark, docs):
    plan = postings.stored(docs, "i", "t").top("lait")._jdf.queryExecution().executedPlan().toString()
    assert "/d]" not in plan and "In(term" in plan or "EqualTo(term" in plan


def test_index_follows_its_files(spark, tmp_path, docs):
    before = postings.fingerprint(docs)
    assert postings.fingerprint(docs) == before
    spark.createDataFrame([(7, "lait")], "i long, t string").write.mode("append").parquet(f"{tmp_path}/d")
    again = spark.read.parquet(f"{tmp_path}/d")
    assert postings.fingerprint(again) != before
    assert postings.stored(again, "i", "t").texts == 7


def test_index_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "i long, t string").write.parquet(f"{tmp_path}/e")
    index = postings.stored(spark.read.parquet(f"{tmp_path}/e"), "i", "t")
    assert index.texts == 0 and index.top("lait").count() == 0


def test_closure_of_a_chain_and_a_cycle(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(None, 3), (5, None)], "a long, b long")
    got = {(r["descendant"], r["ancestor"]): r["depth"] for r in G.closure(chain, "a", "b").collect()}
    assert got == {(i, j): j - i for i in range(100) for j in range(i + 1, 101)}
    ring = spark.createDataFrame([(i, (i + 1) % 7) for i in range(7)] + [(0, 3), (0, 3)], "a long, b long")
    ways = {(i, j): min((j - i - 1) % 7 + 1, (-i) % 7 + 1 + (j - 3) % 7) for i in range(7) for j in range(7)}
    assert {(r["descendant"], r["ancestor"]): r["depth"] for r in G.closure(ring, "a", "b").collect()} == ways


def test_spread_gives_every_core_a_task(spark, docs):
    cores = spark.sparkContext.defaultParallelism
    assert lineage.spread(docs.coalesce(1)).rdd.getNumPartitions() == cores
    many = spark.range(100, numPartitions=cores + 1).toDF("i")
    assert lineage.spread(many) is many


def test_store_is_made_once_and_guarded(spark, tmp_path):
    from tessera.sources.store import TABLES, EvidenceStore

    folder = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        EvidenceStore(spark, folder, read_only=True)
    store = EvidenceStore(spark, folder)
    assert len(TABLES) == 14 and store.table("passages").count() == 0
    store.append("evidence_refs", spark.createDataFrame([("s1", "e1")], "source_id string, evidence_id string"))
    with pytest.raises(ValueError):
        store.append("documents", spark.createDataFrame([(1,)], "x int"))
    again = EvidenceStore(spark, folder, read_only=True)
    assert [tuple(r) for r in again.table("evidence_refs").collect()] == [("e1", "s1")]
    with pytest.raises(PermissionError):
        again.append("evidence_refs", store.table("evidence_refs"))


class Session:
    """A session as far as folders are concerned."""

    def __init__(self, named, given, master):
        self.conf = type("Conf", (), {"get": lambda _, key, default: named})()
        option = type("Option", (), {"isDefined": lambda _: given is not None, "get": lambda _: given})()
        scala = type("Scala", (), {"getCheckpointDir": lambda _: option})()
        java = type("Java", (), {"sc": lambda _: scala})()
        self.sparkContext = type("Context", (), {"_jsc": java, "master": master})()


def test_folders_are_shared_or_refused():
    assert lineage.shared_folder(Session("/shared", "/given", "spark://x:7077")) == "/shared"
    assert lineage.shared_folder(Session(None, "/given", "spark://x:7077")) == "/given"
    assert lineage.shared_folder(Session(None, None, "local[4]")).endswith("tessera-checkpoints")
    with pytest.raises(RuntimeError):
        lineage.shared_folder(Session(None, None, "spark://x:7077"))
