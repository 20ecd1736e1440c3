"""Typed constraints over reported values, with four outcomes: MATCH, DIFFER, UNKNOWN and INVALID.

A missing value is not a mismatch, an approximate or ranged observation is never an exact one, and values with a unit
of another dimension are invalid. Outcomes are strings, so none of them collapses into SQL null.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import units

MATCH, DIFFER, UNKNOWN, INVALID = "MATCH", "DIFFER", "UNKNOWN", "INVALID"
NUMERIC = ("EQ", "NEQ", "LT", "LTE", "GT", "GTE", "BETWEEN", "APPROX", "IN")
CATEGORICAL = ("EQ", "NEQ", "IN")


@dataclass(frozen=True)
class Property:
    """A registered property; canonical_unit is None for plain numbers and categories."""

    name: str
    datatype: str = "numeric"
    canonical_unit: str | None = None
    aliases: tuple[str, ...] = ()


@dataclass(frozen=True)
class Constraint:
    """What a query asks of a property. inclusive: of a range's bounds; None where the wording leaves it open."""

    prop: str
    operator: str
    value: float | str | None = None
    values: tuple = ()
    lower: float | None = None
    upper: float | None = None
    tolerance: float | None = None
    unit: str | None = None
    inclusive: tuple[bool | None, bool | None] = (True, True)
    qualifiers: dict[str, str] = field(default_factory=dict, hash=False)


def normalised(c: Constraint, p: Property) -> Constraint:
    """The constraint in the property's canonical unit. Raises where operator, type or dimension don't fit."""
    if p.datatype == "categorical":
        if c.operator not in CATEGORICAL:
            raise ValueError(f"{c.operator} does not apply to categories")
        if c.unit or c.lower is not None:
            raise ValueError("categories have no units or bounds")
        if c.operator == "IN" and not c.values:
            raise ValueError("IN needs values")
        return c
    if c.operator not in NUMERIC:
        raise ValueError(f"unknown operator {c.operator}")
    if c.operator == "BETWEEN" and (c.lower is None or c.upper is None or c.lower > c.upper):
        raise ValueError("BETWEEN needs ordered bounds")
    if any(isinstance(x, str) for x in (c.value, *c.values)):
        raise ValueError("a numeric property needs numbers")
    if c.operator not in ("BETWEEN", "IN") and c.value is None and not (c.operator == "APPROX" and c.lower is not None):
        raise ValueError("a value is missing")
    if p.canonical_unit is None:
        return c
    if not c.unit:
        raise ValueError("a unit is missing")
    spelled = c.unit.strip().lower().replace(" ", "")
    if spelled not in units.UNITS or units.UNITS[spelled][1] != p.canonical_unit:
        raise ValueError(f"{c.unit} does not measure {p.name}")
    f = units.UNITS[spelled][0]
    scale = lambda x: None if x is None else x * f
    return Constraint(c.prop, c.operator, scale(c.value), tuple(map(scale, c.values)), scale(c.lower), scale(c.upper), scale(c.tolerance), p.canonical_unit, c.inclusive, c.qualifiers)


def outcome(c: Constraint, p: Property, number: Column | None = None, text: Column | None = None, unit: Column | None = None, lower: Column | None = None, approximate: Column | None = None) -> Column:
    """The outcome of one reported value: its number with unit (or text), lower bound if it is a range, and whether it
    is approximate. One expression without user functions, so filters and projections stay in generated code."""
    q = normalised(c, p)
    verdict = lambda ok: F.when(ok, MATCH).otherwise(DIFFER)
    if p.datatype == "categorical":
        wanted = [F.lit(x) for x in (q.values or (q.value,))]
        same = text.isin(*wanted)
        return F.when(text.isNull(), UNKNOWN).otherwise(verdict(~same if q.operator == "NEQ" else same))
    null, no = F.lit(None).cast("double"), F.lit(False)
    lower = null if lower is None else lower
    approximate = no if approximate is None else F.coalesce(approximate, no)
    if p.canonical_unit is None:
        x, invalid = number, no
    else:
        unit = F.lit(p.canonical_unit) if unit is None else unit
        x = number * units.factor(unit)
        invalid = ~F.coalesce(units.canonical(unit) == p.canonical_unit, no)
    if q.operator == "BETWEEN":
        low, high = F.lit(float(q.lower)), F.lit(float(q.upper))
        judged = verdict((x >= low) & (x <= high))
        for bound, inclusive in ((low, q.inclusive[0]), (high, q.inclusive[1])):
            if inclusive is not True:
                judged = F.when(x == bound, UNKNOWN if inclusive is None else DIFFER).otherwise(judged)
    elif q.operator == "IN":
        judged = verdict(x.isin([float(v) for v in q.values]))
    elif q.operator == "APPROX":
        if q.lower is not None:
            judged = verdict((x >= q.lower) & (x <= q.upper))
        elif q.tolerance is None:
            judged = F.lit(UNKNOWN)
        else:
            judged = verdict(F.abs(x - float(q.value)) <= float(q.tolerance))
    else:
        y = float(q.value)
        judged = verdict({"EQ": x == y, "NEQ": x != y, "LT": x < y, "LTE": x <= y, "GT": x > y, "GTE": x >= y}[q.operator])
    missing = number.isNull() & lower.isNull()
    return F.when(missing | approximate | lower.isNotNull(), UNKNOWN).when(invalid, INVALID).otherwise(judged)


def qualified(qualifiers: Column, wanted: dict[str, str]) -> Column:
    """Whether a map of qualifiers has all wanted pairs."""
    out = F.lit(True)
    for k, v in wanted.items():
        out = out & F.coalesce(F.try_element_at(qualifiers, F.lit(k)) == v, F.lit(False))
    return out


def single_outcome(outcomes: Column | str) -> Column:
    """Of a subject's observations: they agree on MATCH or DIFFER, or else INVALID if any is, or UNKNOWN."""
    o = F.col(outcomes) if isinstance(outcomes, str) else outcomes
    seen = lambda v: F.coalesce(F.bool_or(o == v), F.lit(False))
    return F.when(seen(MATCH) & ~seen(DIFFER) & ~seen(UNKNOWN) & ~seen(INVALID), MATCH).when(seen(DIFFER) & ~seen(MATCH) & ~seen(UNKNOWN) & ~seen(INVALID), DIFFER).when(seen(INVALID), INVALID).otherwise(UNKNOWN)


def resolve_property(labels: DataFrame, properties: list[Property], label_col: str = "label", unit_col: str = "unit") -> DataFrame:
    """Adds state CANONICAL, AMBIGUOUS or UNKNOWN and the property that a label and its unit stand for."""
    spark = labels.sparkSession
    names = spark.createDataFrame([(a.lower(), p.name, p.canonical_unit) for p in properties for a in {p.name, *p.aliases}], "alias string, property string, canonical_unit string")
    names = names.groupBy("alias").agg(F.countDistinct("property").alias("n"), F.first("property").alias("property"), F.first("canonical_unit").alias("canonical_unit"))
    wanted = F.trim(F.regexp_replace(F.lower(F.col(label_col)), "[\\s_]+", " "))
    joined = labels.withColumn("alias", wanted).join(F.broadcast(names), "alias", "left")  # as many rows as the registry has aliases
    fits = F.col(unit_col).isNull() | F.col("canonical_unit").isNull() | F.coalesce(units.canonical(F.col(unit_col)) == F.col("canonical_unit"), F.lit(False))
    state = F.when(F.col("n") > 1, "AMBIGUOUS").when((F.col("n") == 1) & fits, "CANONICAL").otherwise("UNKNOWN")
    return joined.withColumn("state", state).withColumn("property", F.when(state == "CANONICAL", F.col("property"))).drop("alias", "n", "canonical_unit")
