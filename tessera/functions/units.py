"""Unit normalisation as Catalyst expressions. Reported values are never overwritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spelling -> (factor, canonical unit). Fixed values.
UNITS: dict[str, tuple[float, str]] = {
    "%": (0.01, "fraction"),
    "fraction": (1.0, "fraction"),
    "ppm": (0.000001, "fraction"),
    "um": (0.000001, "m"),
    "µm": (0.000001, "m"),
    "μm": (0.000001, "m"),
    "cm": (0.01, "m"),
    "mm": (0.001, "m"),
    "m": (1.0, "m"),
    "cm/s": (0.01, "m/s"),
    "m/s": (1.0, "m/s"),
    "mm/s": (0.001, "m/s"),
    "mm2/s": (0.000001, "m2/s"),
    "mm²/s": (0.000001, "m2/s"),
    "mm^2/s": (0.000001, "m2/s"),
    "m2/s": (1.0, "m2/s"),
    "m²/s": (1.0, "m2/s"),
    "m^2/s": (1.0, "m2/s"),
    "kpa": (1000.0, "Pa"),
    "mmhg": (133.322387415, "Pa"),
    "pa": (1.0, "Pa"),
    "w": (1.0, "W"),
    "k": (1.0, "K"),
    "s": (1.0, "s"),
}


def units_table(spark: SparkSession) -> DataFrame:
    """The conversion table as rows, for joins; its size is fixed."""
    return spark.createDataFrame([(u, f, c) for u, (f, c) in UNITS.items()], "spelling string, factor double, canonical string")


def _map(at: int) -> Column:
    return F.create_map(*[x for u, v in UNITS.items() for x in (F.lit(u), F.lit(v[at]))])


def spelling(unit: Column) -> Column:
    return F.replace(F.lower(F.trim(unit)), F.lit(" "), F.lit(""))


def factor(unit: Column) -> Column:
    """Factor to the canonical unit; null for an unknown unit."""
    return F.try_element_at(_map(0), spelling(unit))


def canonical(unit: Column) -> Column:
    return F.try_element_at(_map(1), spelling(unit))


def normalise(value: Column, unit: Column) -> Column:
    """struct(value, unit, ok); ok is false where the unit is not known."""
    f = factor(unit)
    return F.struct((value * f).alias("value"), canonical(unit).alias("unit"), f.isNotNull().alias("ok"))
