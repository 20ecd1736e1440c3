"""Boundary matrices of the constraint evaluator, units, numeric expressions and classification."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import numeric, units
from tessera.operators import classify as C
from tessera.operators.constraints import Constraint, Property, normalised, outcome, qualified, single_outcome

FLOW = Property("AirflowVelocity", "numeric", "m/s", ("flow", "air flow"))
OXYGEN = Property("OxygenConcentration", "numeric", "fraction")
STATE = Property("State", "categorical")


def judged(spark, c, p, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, number double, unit string, lower double, approximate boolean")
    out = df.select("i", outcome(c, p, F.col("number"), unit=F.col("unit"), lower=F.col("lower"), approximate=F.col("approximate")).alias("o")).orderBy("i")
    return [r["o"][0] for r in out.collect()]


@pytest.mark.parametrize(
    "operator, wanted",
    [("EQ", "DMD"), ("NEQ", "MDM"), ("LT", "MDD"), ("LTE", "MMD"), ("GT", "DDM"), ("GTE", "DMM")],
)
def test_boundaries(spark, operator, wanted):
    rows = [(v, "m/s", None, False) for v in (0.1, 0.2, 0.3)]
    assert "".join(judged(spark, Constraint("AirflowVelocity", operator, 0.2, unit="m/s"), FLOW, rows)) == wanted


def test_units_of_query_and_record(spark):
    rows = [(20.0, "cm/s", None, False), (300.0, "mm/s", None, None), (0.2, " M/S ", None, False)]
    assert judged(spark, Constraint("AirflowVelocity", "GTE", 25.0, unit="cm/s"), FLOW, rows) == ["D", "M", "D"]


def test_missing_approximate_ranged_and_invalid(spark):
    rows = [(None, "m/s", None, False), (0.3, "m/s", None, True), (0.3, "m/s", 0.2, False), (0.3, "kPa", None, False), (0.3, "parsec", None, False)]
    assert judged(spark, Constraint("AirflowVelocity", "GT", 0.1, unit="m/s"), FLOW, rows) == ["U", "U", "U", "I", "I"]


def test_between_and_approx(spark):
    rows = [(v, "fraction", None, False) for v in (0.1, 0.2, 0.3, 0.4)]
    between = lambda inclusive: judged(spark, Constraint("OxygenConcentration", "BETWEEN", lower=20.0, upper=30.0, unit="%", inclusive=inclusive), Property("O", "numeric", "fraction"), [(v, "%", None, False) for v in (10.0, 20.0, 30.0, 40.0)])
    assert between((True, True)) == ["D", "M", "M", "D"]
    assert between((None, False)) == ["D", "U", "D", "D"]
    assert judged(spark, Constraint("OxygenConcentration", "APPROX", 0.2, tolerance=0.11, unit="fraction"), OXYGEN, rows) == ["M", "M", "M", "D"]
    assert judged(spark, Constraint("OxygenConcentration", "APPROX", 0.2, unit="fraction"), OXYGEN, rows) == ["U"] * 4
    assert judged(spark, Constraint("OxygenConcentration", "IN", values=(0.1, 0.4), unit="fraction"), OXYGEN, rows) == ["M", "D", "D", "M"]


def test_categories(spark):
    df = spark.createDataFrame([("on",), ("off",), (None,)], "s string")
    f = lambda c: [r[0][0] for r in df.select(outcome(c, STATE, text=F.col("s"))).collect()]
    assert f(Constraint("State", "EQ", "on")) == ["M", "D", "U"]
    assert f(Constraint("State", "NEQ", "on")) == ["D", "M", "U"]
    assert f(Constraint("State", "IN", values=("on", "off"))) == ["M", "M", "U"]


@pytest.mark.parametrize(
    "c, p",
    [
        (Constraint("State", "GT", "on"), STATE),
        (Constraint("State", "EQ", "on", unit="m"), STATE),
        (Constraint("AirflowVelocity", "EQ", 1.0), FLOW),
        (Constraint("AirflowVelocity", "EQ", 1.0, unit="%"), FLOW),
        (Constraint("AirflowVelocity", "EQ", "fast", unit="m/s"), FLOW),
        (Constraint("AirflowVelocity", "BETWEEN", lower=2.0, upper=1.0, unit="m/s"), FLOW),
        (Constraint("AirflowVelocity", "LIKE", 1.0, unit="m/s"), FLOW),
        (Constraint("AirflowVelocity", "LT", unit="m/s"), FLOW),
    ],
)
def test_invalid_constraints(c, p):
    with pytest.raises(ValueError):
        normalised(c, p)


def test_unit_spellings(spark):
    df = spark.createDataFrame([(u.upper() if u.isascii() else u, f, c) for u, (f, c) in units.UNITS.items()] + [("furlong", None, None), (None, None, None)], "u string, f double, c string")
    n = df.select("f", "c", units.normalise(F.lit(2.0), F.col("u")).alias("n")).collect()
    assert len(n) == 26
    for r in n:
        assert (r["n"]["unit"], r["n"]["ok"]) == (r["c"], r["c"] is not None)
        assert r["n"]["value"] is None if r["f"] is None else abs(r["n"]["value"] - 2 * r["f"]) < 1e-12
    assert units.units_table(spark).count() == 24


def test_single_outcome_and_qualifiers(spark):
    df = spark.createDataFrame([("a", "MATCH"), ("a", "MATCH"), ("b", "MATCH"), ("b", "DIFFER"), ("c", "DIFFER"), ("d", "INVALID"), ("d", "MATCH"), ("e", None)], "k string, o string")
    assert {r["k"]: r["o"] for r in df.groupBy("k").agg(single_outcome("o").alias("o")).collect()} == {"a": "MATCH", "b": "UNKNOWN", "c": "DIFFER", "d": "INVALID", "e": "UNKNOWN"}
    q = spark.createDataFrame([({"a": "1", "b": "2"},), ({"a": "2"},), (None,)], "q map<string,string>")
    assert [r[0] for r in q.select(qualified(F.col("q"), {"a": "1", "b": "2"})).collect()] == [True, False, False]


def test_classification(spark):
    rows = [("MATCH", "MATCH"), ("MATCH", "UNKNOWN"), ("DIFFER", "DIFFER"), ("UNKNOWN", "UNKNOWN"), ("MATCH", "INVALID")]
    df = spark.createDataFrame(rows, "a string, b string")
    o = {"a": F.col("a"), "b": F.col("b")}
    f = lambda c: [r[0] for r in df.select(c).collect()]
    assert f(C.classify(o)) == ["DIRECT", "RELATED", "NO_DIRECT", "NO_DIRECT", "RELATED"]
    assert f(C.classify({})) == ["NO_DIRECT"] * 5
    assert f(C.classify(o, numeric=("b",), related_policy=True)) == ["DIRECT", "RELATED", "RELATED", "NO_DIRECT", "RELATED"]
    assert f(C.classify(o, numeric=("b",), anchors=("a",), related_policy=True)) == ["DIRECT", "RELATED", "NO_DIRECT", "NO_DIRECT", "RELATED"]
    assert f(C.classify_v1(o)) == ["DIRECT", "DIRECT", "NO_DIRECT", "DIRECT", "DIRECT"]
    assert f(C.score(o, {"a": 2.0})) == [9.0, 5.0, -6.0, -3.0, 5.0]


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("at least 5 cm/s", ("GTE", 5.0, None, None, None, "cm/s")),
        ("below 20 %", ("LT", 20.0, None, None, None, "%")),
        ("between 1 and 3 m", ("BETWEEN", None, 1.0, 3.0, None, "m")),
        ("3 - 1 mm", ("BETWEEN", None, 1.0, 3.0, None, "mm")),
        ("5 ± 0.5 kPa", ("APPROX", 5.0, None, None, 0.5, "kpa")),
        ("~ 7", ("APPROX", 7.0, None, None, None, None)),
    ],
)
def test_expressions(text, wanted):
    x = numeric.parse_expression(text)
    assert (x.operator, x.value, x.lower, x.upper, x.tolerance, x.unit) == wanted


def test_expressions_with_unlike_units():
    with pytest.raises(ValueError):
        numeric.parse_expression("between 1 m and 3 s")
