"""Plans, questions, investigations, graphs, records, sources and streams on small fixtures."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import evidence as E
from tessera.operators import graph as G
from tessera.operators import records as R
from tessera.operators import spans as S
from tessera.operators.constraints import Constraint, Property
from tessera.plans import investigate as I
from tessera.plans import question as Q
from tessera.plans import search as P
from tessera.plans.intent import Comparison, Intent, Registry, Relation, RelationConstraint
from tessera.sources import adapters, files, generations
from tessera.streaming import events


@pytest.fixture
def registry():
    r = Registry(classes={"Run": {"target": True}, "Observation": {"information": True, "query_terms": ["observed"]}}, entities={"pmma": ("hasMaterial", "PMMA"), "cotton": ("hasMaterial", "Cotton"), "acrylic": ("hasMaterial", "Acrylic")}, anchors=("hasMaterial",))
    r.register(Property("AirflowVelocity", "numeric", "m/s", ("flow", "air flow")), Relation("hasMaterial"))
    return r


@pytest.fixture
def store(spark):
    e = spark.createDataFrame([(x, ["Run"], ["s1"], ["e1"]) for x in ("below", "boundary", "above", "bare", "family")], "entity string, classes array<string>, sources array<string>, evidence array<string>")
    r = spark.createDataFrame([("below", "hasMaterial", "PMMA"), ("boundary", "hasMaterial", "PMMA"), ("above", "hasMaterial", "Cotton"), ("family", "hasMaterial", "CastPMMA")], "subject string, relation string, object string")
    v = [("below", 0.1), ("boundary", 0.2), ("above", 0.3), ("family", 0.2)]
    values = spark.createDataFrame([(s, "AirflowVelocity", x, None, "m/s", None, False, {}) for s, x in v], "subject string, property string, number double, text string, unit string, lower double, approximate boolean, qualifiers map<string,string>")
    passages = spark.createDataFrame([("p1", "s1", "flames spread over PMMA"), ("p2", "s1", "cotton smoulders"), ("p3", "s2", "nothing of the kind")], "passage string, source string, text string")
    categories = spark.createDataFrame([("CastPMMA", "PMMA"), ("CastPMMA", "Polymer")], "descendant string, ancestor string")
    return P.Store(e, r, values, passages, categories)


def kinds(df):
    return {r["entity"]: r["classification"] for r in df.collect()}


def test_execute(registry, store):
    intent = Intent(("Run",), (RelationConstraint("hasMaterial", "PMMA"),), (Constraint("AirflowVelocity", "GTE", 20.0, unit="cm/s"),))
    b = P.execute(intent, registry, store, question="PMMA flames")
    assert kinds(b.classified) == {"below": "RELATED", "boundary": "DIRECT", "above": "RELATED", "bare": "NO_DIRECT", "family": "DIRECT"}
    assert [r["entity"] for r in b.direct.orderBy("rank").collect()] == ["boundary", "family"]
    assert [r["passage"] for r in b.passages.orderBy("rank").collect()] == ["p1"]


def test_unknown_names_raise(registry, store):
    with pytest.raises(LookupError):
        P.execute(Intent(("Nope",)), registry, store)
    with pytest.raises(LookupError):
        P.execute(Intent(relations=(RelationConstraint("nope", "x"),)), registry, store)
    with pytest.raises(ValueError):
        registry.register(Property("AirflowVelocity", "categorical"))


def test_comparison_and_branches(registry, store):
    b = P.execute(Intent(comparison=Comparison(("below", "boundary"))), registry, store)
    assert b.comparison.collect()[0]["status"] == "different"
    two = Intent(("Run",), (RelationConstraint("hasMaterial", "PMMA"), RelationConstraint("hasMaterial", "Cotton")))
    out = P.execute_branches(two, registry, store).where("classification = 'DIRECT'").collect()
    assert {(r["requested_group"], r["entity"]) for r in out} == {("hasMaterial=PMMA", "below"), ("hasMaterial=PMMA", "boundary"), ("hasMaterial=PMMA", "family"), ("hasMaterial=Cotton", "above")}


def test_questions(registry):
    i = Q.read("What was observed for PMMA with flow above 10 cm/s?", registry, ("Run",))
    assert i.relations == (RelationConstraint("hasMaterial", "PMMA"),)
    assert i.properties == (Constraint("AirflowVelocity", "GT", 10.0, unit="cm/s"),)
    assert i.information == ("Observation",)
    assert Q.read("not pmma", registry).clarification
    assert Q.read("compare S2 and the first", registry, previous=["a", "b"]).comparison.operands == ("b", "a")
    assert Q.read("with 5 m/s", registry).unresolved == ("5 m/s",)
    assert [Q.route(x) for x in ("which papers", "compare a and b", "what is smouldering", "flame speed")] == ["bibliographic", "comparison", "conceptual", "scientific"]


def test_investigation(spark):
    need = spark.createDataFrame([("a",), ("b",)], "requirement string")
    found = lambda done: spark.createDataFrame([("a", "SUPPORTED"), ("b", "SUPPORTED" if done else "RELATED_ONLY")], "requirement string, state string")
    out = I.investigate(need, found, lambda s, d: [I.Action("search", k) for k, v in s.items() if v != "SUPPORTED"])
    assert (out.decision, out.rounds, len(out.actions)) == (I.ANSWER, 2, 1)
    stuck = I.investigate(need, lambda d: found([]), lambda s, d: [I.Action("search", "b")])
    assert (stuck.decision, stuck.rounds) == (I.PARTIAL, 2)


def test_graph_with_cycles(spark):
    e = spark.createDataFrame([("a", "b", "subClassOf"), ("b", "c", "subClassOf"), ("c", "a", "subClassOf"), ("d", "b", "subClassOf"), ("x", "a", "related")], "subject string, object string, predicate string")
    assert G.closure(e.where("predicate = 'subClassOf'"), "subject", "object").count() == 12
    t = {r["actual"]: r for r in G.traverse(e, ["a"], 3).collect()}
    assert (t["b"]["category_match"], t["b"]["path"]) == (True, "a>c>b") and t["c"]["relationship"] == "DESCENDANT"
    assert t["x"]["depth"] == 1 and not t["x"]["category_match"]
    with pytest.raises(ValueError):
        G.traverse(e, ["a"], 9)


def test_records(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {tuple(r) for r in R.upsert(base, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    fresh, conflict = R.insert_if_absent(base, new, ["k"], F.col("v"), F.col("v"))
    assert [r["k"] for r in fresh.collect()] == [3] and [r["k"] for r in conflict.collect()] == [2]
    assert {tuple(r) for r in R.difference(base, new, ["k"]).collect()} == {(1, "left"), (3, "right")}


def test_spans_and_scope(spark):
    s = spark.createDataFrame([("a", 0, 5), ("a", 4, 9), ("a", 20, 30), ("b", 1, 2)], "d string, start int, end int")
    assert {(r["d"], r["start"], r["end"]) for r in S.merge(s, ["d"]).collect()} == {("a", 0, 9), ("a", 20, 30), ("b", 1, 2)}
    st = spark.createDataFrame(
        [("e1", "g", "1g", "document", "VERIFIED_APPLICABLE_CONTEXT", False, False), ("e1", "g", "0g", "run", "EXPLICIT_LOCAL", False, False), ("e2", "g", "1g", "group", "EXPLICIT_LOCAL", True, False), ("e3", "g", "1g", "run", "EXPLICIT_LOCAL", False, False), ("e3", "g", "0g", "run", "EXPLICIT_LOCAL", False, False), ("e4", "g", "x", "run", "CONTEXTUAL_CANDIDATE", False, False)],
        "entity string, context_type string, value string, scope string, status string, is_exception boolean, has_conflict boolean",
    )
    assert {r["entity"]: (r["status"], r["value"]) for r in E.resolve_scope(st).collect()} == {"e1": ("EXPLICIT_LOCAL", "0g"), "e2": ("NOT_APPLICABLE", None), "e3": ("CONFLICTED", None), "e4": ("CONTEXTUAL_CANDIDATE", None)}


def test_sources(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes("﻿Name ,Size (mm)\n a ,1\nb, ".encode())
    df = files.csv(spark, str(tmp_path / "t.csv"))
    assert df.columns == ["Name", "Size (mm)"] and [tuple(r) for r in df.collect()] == [("a", "1"), ("b", "")]
    (tmp_path / "w.csv").write_bytes("x\ncaf\xe9\n".encode("cp1252"))
    assert files.csv(spark, str(tmp_path / "w.csv")).collect()[0][0] == "café"
    c = files.cells(df, "t.csv")
    assert c.count() == 4 and files.changed_cells(c, c.withColumn("checksum", F.lit("x"))).count() == 4
    (tmp_path / "a.jsonl").write_text('{"x": 1}\nnot json\n')
    assert files.json_lines(spark, str(tmp_path / "a.jsonl"), "x int").where("_corrupt IS NOT NULL").count() == 1
    (tmp_path / "f" / "src").mkdir(parents=True)
    (tmp_path / "f" / "src" / "one.txt").write_text("hello")
    spark.dataSource.register(adapters.FolderSource)
    r = spark.read.format("tessera_folder").load(str(tmp_path / "f")).collect()
    assert [(x["source_id"], x["name"], x["text"]) for x in r] == [("src", "one.txt", "hello")]
    assert files.leaks(spark.createDataFrame([("Authorization: x",), ("fine",)], "t string"), "t").count() == 1


def test_generations(spark, tmp_path):
    folder = str(tmp_path / "g")
    a, b = spark.range(3), spark.range(5)
    assert generations.current(spark, folder) is None
    generations.write(a, folder, "one")
    generations.write(b, folder, "two")
    generations.write(a, folder, "two")  # immutable
    assert generations.current(spark, folder).count() == 5
    assert generations.rollback(spark, folder) == "one" and generations.current(spark, folder).count() == 3


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.read(spark, str(tmp_path / "in"), batch.schema)
    q = events.tumbling(stream, "1 hour", ["event_type"]).writeStream.format("memory").queryName("t").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    clean = lambda df: sorted((str(r["window_start"]), r["event_type"], r["n"], round(r["total"] or 0, 4)) for r in df.collect())
    assert clean(spark.table("t")) == clean(events.tumbling(batch, "1 hour", ["event_type"]))
    u = events.upsert_sink(stream, str(tmp_path / "u"), ["user_id"], ["ts", "event_id"], str(tmp_path / "cu")).trigger(availableNow=True).start()
    u.awaitTermination(120)
    last = R.latest(batch, ["user_id"], ["ts", "event_id"])
    assert {(r["user_id"], r["event_id"]) for r in generations.current(spark, str(tmp_path / "u")).collect()} == {(r["user_id"], r["event_id"]) for r in last.collect()}
