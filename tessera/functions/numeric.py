"""Numeric expressions in text: values, ranges, approximations, operators and quantities."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A signed decimal number.
NUMBER = "[-+]?[0-9]+(?:\\.[0-9]+)?"
#: Words and signs for operators, longest first (fixed values).
OPERATOR_WORDS = {
    "greater than or equal to": "GTE",
    "less than or equal to": "LTE",
    "no more than": "LTE",
    "no less than": "GTE",
    "greater than": "GT",
    "less than": "LT",
    "more than": "GT",
    "at least": "GTE",
    "at most": "LTE",
    "not equal to": "NEQ",
    "approximately": "APPROX",
    "equal to": "EQ",
    "exactly": "EQ",
    "between": "BETWEEN",
    "around": "APPROX",
    "above": "GT",
    "below": "LT",
    "over": "GT",
    "under": "LT",
    "about": "APPROX",
    ">=": "GTE",
    "<=": "LTE",
    "!=": "NEQ",
    "≥": "GTE",
    "≤": "LTE",
    "~": "APPROX",
    ">": "GT",
    "<": "LT",
    "=": "EQ",
}


def table_value(raw: Column) -> Column:
    """struct(kind, value, lower, upper, approximate) of a table cell: empty, range, approximate, number or text."""
    t = F.trim(F.coalesce(raw, F.lit("")))
    span = f"^({NUMBER})\\s*(?:-|–|to)\\s*({NUMBER})"
    near = f"^(?:~|≈|ca\\.?|about)\\s*({NUMBER})"
    one = f"^({NUMBER})(?:\\s*[^0-9].*)?$"
    number = lambda p, g: F.regexp_extract(t, p, g).try_cast("double")
    kind = F.when(F.lower(t).isin("", "n/a", "na", "none", "-"), "empty").when(t.rlike(span), "range").when(t.rlike(near), "approximate").when(t.rlike(one), "number").otherwise("text")
    return F.struct(
        kind.alias("kind"),
        F.when(kind == "number", number(one, 1)).when(kind == "approximate", number(near, 1)).alias("value"),
        F.when(kind == "range", number(span, 1)).alias("lower"),
        F.when(kind == "range", number(span, 2)).alias("upper"),
        (kind == "approximate").alias("approximate"),
    )


def quantities(text: Column, units: tuple[str, ...]) -> Column:
    """All number-and-unit mentions of a text, units as they are spelled."""
    spelled = "|".join(re.escape(u) for u in sorted(units, key=len, reverse=True))
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?:{NUMBER})\\s*(?:{spelled})(?![A-Za-z0-9])"), F.lit(0))


def close(a: Column, b: Column, relative: float = 1e-12) -> Column:
    return F.abs(a - b) <= relative * F.greatest(F.abs(a), F.abs(b))


@dataclass(frozen=True)
class Expression:
    """A constraint as a question states it."""

    operator: str
    value: float | None = None
    lower: float | None = None
    upper: float | None = None
    tolerance: float | None = None
    unit: str | None = None


def parse_expression(text: str) -> Expression:
    """Operator words, range, tolerance and unit of a question's numeric phrase. Unlike units raise ValueError."""
    t = text.strip().lower()
    unit = r"(%|[a-zµμ][a-z0-9µμ²^/]*)?"
    numbers = r"([-+]?\d+(?:\.\d+)?)"
    word = next((w for w in OPERATOR_WORDS if re.match(re.escape(w) + (r"\b" if w[-1].isalpha() else ""), t)), None)
    rest = t[len(word) :].strip() if word else t
    operator = OPERATOR_WORDS[word] if word else "EQ"
    if m := re.match(rf"{numbers}\s*{unit}\s*(?:and|to|-|–)\s*{numbers}\s*{unit}", rest):
        units = {u for u in (m[2], m[4]) if u}
        if len(units) > 1:
            raise ValueError("a range has one unit")
        low, high = sorted((float(m[1]), float(m[3])))
        return Expression("BETWEEN", lower=low, upper=high, unit=next(iter(units), None))
    if m := re.match(rf"{numbers}\s*{unit}\s*(?:±|\+/-)\s*{numbers}\s*{unit}", rest):
        units = {u for u in (m[2], m[4]) if u}
        if len(units) > 1:
            raise ValueError("a tolerance has the value's unit")
        return Expression("APPROX", value=float(m[1]), tolerance=float(m[3]), unit=next(iter(units), None))
    if m := re.match(rf"{numbers}\s*{unit}", rest):
        return Expression(operator, value=float(m[1]), unit=m[2])
    raise ValueError("no number")


def parse_expressions(text: Column) -> Column:
    """struct(operator, value, lower, upper, tolerance, unit) of each phrase, in Arrow batches; null where it is none."""
    fields = ("operator", "value", "lower", "upper", "tolerance", "unit")

    @F.pandas_udf("operator string, value double, lower double, upper double, tolerance double, unit string")
    def run(phrases: pd.Series) -> pd.DataFrame:
        rows = []
        for p in phrases:
            try:
                x = parse_expression(p or "")
                rows.append([getattr(x, f) for f in fields])
            except ValueError:
                rows.append([None] * len(fields))
        return pd.DataFrame(rows, columns=fields).astype({f: "float64" for f in fields[1:5]})

    return run(text)


#: Adjectives of extent and the axis that they name (fixed values).
AXES = {"thick": "thickness", "wide": "width", "long": "length", "tall": "height", "deep": "depth", "high": "height"}


def dimensions(text: Column) -> Column:
    """array<struct<axis,value,unit>> of phrases such as `3 mm thick`, only with units of length."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"{NUMBER}\\s*(?:mm|cm|um|µm|m)\\s+(?:{'|'.join(AXES)})"), F.lit(0))
    axis = F.create_map(*[F.lit(x) for kv in AXES.items() for x in kv])
    return F.transform(
        found,
        lambda s: F.struct(
            F.try_element_at(axis, F.regexp_extract(s, "([a-z]+)$", 1)).alias("axis"),
            F.regexp_extract(s, f"^({NUMBER})", 1).try_cast("double").alias("value"),
            F.regexp_extract(s, f"^{NUMBER}\\s*([a-zµ]+)", 1).alias("unit"),
        ),
    )


def header_binding(header: Column) -> Column:
    """struct(group, name) of a column header such as `group: material`; group is null without a colon."""
    two = header.contains(":")
    return F.struct(F.when(two, F.trim(F.split_part(header, F.lit(":"), F.lit(1)))).alias("group"), F.trim(F.when(two, F.split_part(header, F.lit(":"), F.lit(2))).otherwise(header)).alias("name"))
