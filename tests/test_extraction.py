"""Spans, segments, quotes, bindings and validation on small fixtures."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import extraction as X
from tessera.operators import profile as P
from tessera.operators import retrieval as S
from tessera.operators import validation as V


def test_anchors_keep_offsets_and_abbreviations():
    text = "Results\nDr. Smith saw fig. 3 burn. It stopped!\n- a bullet point. With two parts.\n\nLast"
    found = X.anchors(text)
    assert [text[a:b] for a, b, _ in found] == ["Results", "Dr. Smith saw fig. 3 burn.", "It stopped!", "- a bullet point. With two parts.", "Last"]
    assert [k for *_, k in found] == ["heading", "sentence", "sentence", "bullet", "heading"]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab .!?\n", max_size=200), st.integers(1, 40))
def test_segments_cover_every_character(text, most):
    spans = X.segments(text, most)
    assert "".join(text[a:b] for a, b in spans) == text
    assert all(0 < b - a <= most for a, b in spans)


@pytest.mark.parametrize(
    "quote, text, wanted",
    [
        ("b c", "a b c d", (2, 5)),
        ("b c", "a b\n  c d", (2, 7)),
        ("é x", "é  x", (0, 5)),
        ("a", "a b a", None),
        ("zz", "a b", None),
        ("", "a", None),
        (None, "a", None),
    ],
)
def test_recover(quote, text, wanted):
    assert X.recover(quote, text) == wanted


def test_respectively():
    assert X.respectively("PMMA and cotton burned for 5 s and 7 s, respectively", ["PMMA", "cotton"]) == [("PMMA", "5 s"), ("cotton", "7 s")]
    assert X.respectively("PMMA, cotton and wool took 5 s and 7 s, respectively", ["PMMA", "cotton", "wool"]) == []
    assert X.respectively("PMMA burned 5 mm/s", ["PMMA"]) == [("PMMA", "5 mm/s")]


def test_hard_anchors():
    assert X.keeps_meaning('PSI-98 at 21 % "flame"', 'the "flame" of PSI-98 with 21%')
    assert not X.keeps_meaning("not at 21 %", "at 21 %")
    assert not X.keeps_meaning("at 21 %", "at 22 %")


def test_recover_table_and_windows(spark):
    df = spark.createDataFrame([(1, "b c", "a b  c"), (2, None, "x"), (3, "x", None)], "k int, q string, t string")
    assert [(r["start"], r["end"]) for r in X.recover_table(df, "q", "t").orderBy("k").collect()] == [(2, 6), (None, None), (None, None)]
    rows = spark.createDataFrame([("d", i, n) for i, n in enumerate([3, 3, 9, 2, 2, 20, 1])], "d string, i int, n int")
    assert [r["window"] for r in X.pack_windows(rows, "d", ["i"], "n", 10).orderBy("i").collect()] == [0, 0, 1, 2, 2, 3, 4]


def test_greedy_budget_skips_and_goes_on(spark):
    rows = spark.createDataFrame([("s", i, n) for i, n in enumerate([4, 9, 3, 4, 2])], "s string, i int, n int")
    r = S.greedy_budget(rows, "s", ["i"], "n", "i", 10).collect()[0]
    assert (r["used"], r["ids"]) == (9, [0, 2, 4])


def test_bm25_edges(spark):
    docs = spark.createDataFrame([(1, "Café au lait"), (2, None), (3, "lait lait")], "i int, t string")
    assert S.bm25(docs, "", "i", "t").count() == 0
    assert S.bm25(docs, "lait", "i", "t", eligible_ids=[]).count() == 0
    assert [r["i"] for r in S.bm25(docs, "lait cafe", "i", "t").orderBy("rank").collect()] == [1, 3]
    assert [r["i"] for r in S.bm25(docs, "lait", "i", "t", eligible_ids=[1]).collect()] == [1]


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0])], "i int, v array<float>")
    assert [(r["i"], r["score"]) for r in S.cosine_top(v, [2.0, 0.0], "i", "v", 3).orderBy("rank").collect()] == [(1, 1.0), (3, 1.0), (2, 0.0)]


def test_validation(spark):
    df = spark.createDataFrame([(1, 5), (2, None)], "k int, x int")
    r = df.select(V.reasons({"big": F.col("x") > 3, "null": F.col("x").isNull()}).alias("r")).collect()
    assert [x["r"] for x in r] == [["big"], ["null"]]
    edges = spark.createDataFrame([("a", "b")], "subject string, object string")
    paths = spark.createDataFrame([(1, 1, "a", "b"), (2, 1, "a", "b"), (2, 2, "x", "y"), (3, 1, "b", "a")], "p int, s int, f string, t string")
    assert {(r["p"], r["error"]) for r in V.path_errors(paths, edges, "p", "s", "f", "t").collect()} == {(2, "DISCONNECTED"), (3, "UNKNOWN_EDGE")}
    d = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("z", "y")], "node string, depends_on string")
    assert {r[0] for r in V.cascade(spark.createDataFrame([("a",)], "node string"), d).collect()} == {"a", "b", "c"}


def test_profile_and_roles(spark):
    df = spark.createDataFrame([("1 - 2", "x"), ("~ 3", ""), ("4", None)], "`Oxygen (%)` string, Name string")
    r = {x["column"]: x for x in P.profile(df).collect()}
    assert (r["Oxygen (%)"]["datatype"], r["Oxygen (%)"]["unit"], r["Oxygen (%)"]["label"]) == ("range", "%", "oxygen")
    assert (r["Name"]["datatype"], r["Name"]["nullable"], r["Name"]["n_empty"]) == ("categorical", True, 2)
    assert P.role_hint(["run id", "burn time"], {"runs": {"run", "burn"}, "samples": {"sample"}}) == "runs"
    assert P.role_hint(["x"], {"runs": {"run"}}) == "unknown"


def test_halves_against_brute_force(spark):
    import random
    import re

    from tessera.operators import preparation

    r = random.Random(4)
    texts = ["".join(r.choice(["a", "b ", ". ", "\n", ".", "! ", "c" * 40]) for _ in range(r.randint(1, 90))) for _ in range(400)]
    texts += ["x" * 700, "x" * 400 + ". " + "y" * 400, "x" * 399 + ".\n" + "y" * 401, "x" * 200 + "\n" + "y" * 600, "\n" * 700, None, ""]

    def wanted(t):
        if t is None or len(t) <= 600:
            return None
        fit = [m.end() for m in re.finditer(r"(?=(\n|[.!?]\s))", t) for m in [re.compile(r"\n|[.!?]\s").match(t, m.start())] if 150 <= m.end() <= len(t) - 150]
        return min(fit, key=lambda p: (abs(p - len(t) // 2), p), default=None)

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {x["i"]: x["c"] for x in df.select("i", preparation.halved(F.col("t")).alias("c")).collect()}
    assert got == {i: wanted(t) for i, t in enumerate(texts)}
