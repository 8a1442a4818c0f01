"""Cells as text: what Python's str() and str.format() give, as Spark expressions."""

from __future__ import annotations

import string

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.package import StepError


def number_text(col: Column, kind: T.DataType) -> Column:
    """A number without exponent or trailing zeros."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        plain = F.regexp_replace(col.cast("string"), r"\.0$", "")
        return F.when(plain.contains("E"), strip_zeros(col.cast("decimal(38,18)").cast("string"))).otherwise(plain)
    if isinstance(kind, T.DecimalType) and kind.scale > 0:
        return strip_zeros(col.cast("string"))
    return col.cast("string")


def strip_zeros(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def python_text(col: Column, kind: T.DataType, none: str | None = "None") -> Column:
    """str() of a cell; null is ``none``."""
    if isinstance(kind, T.StringType):
        out = col
    elif isinstance(kind, T.BooleanType):
        out = F.initcap(col.cast("string"))
    elif isinstance(kind, T.NumericType):
        out = number_text(col, kind)
    else:
        out = col.cast("string")
    return out if none is None else F.coalesce(out, F.lit(none))


def formatted(col: Column, kind: T.DataType, spec: str) -> Column:
    """format(cell, spec). Common number formats stay in the JVM; others go through Arrow."""
    if not spec:
        return python_text(col, kind)
    integral, exact = isinstance(kind, T.IntegralType), isinstance(kind, T.DecimalType)
    fill, rest = ("0", spec[1:]) if spec[0] == "0" and len(spec) > 1 and spec[1].isdigit() else ("", spec)
    if integral and rest[-1:] == "d" and (rest[:-1].isdigit() or not rest[:-1]):
        return F.format_string(f"%{fill}{rest}", col.cast("long"))
    if (exact or integral) and rest[-1:] == "f" and set(rest[:-1]) <= set("0123456789."):
        width, _, digits = rest[:-1].partition(".")
        digits = digits or "6"
        if (not width or width.isdigit()) and digits.isdigit():
            return F.format_string(f"%{fill}{width}.{digits}f", F.bround(col.cast("decimal(38,18)"), int(digits)))
    if isinstance(kind, T.StringType) and spec[-1:] == "s" and (spec[:-1].isdigit() or not spec[:-1]):
        return F.format_string(f"%-{spec}" if spec[:-1] else "%s", col)
    if isinstance(kind, T.StringType) and spec[-1:] in "dfeg":
        raise StepError(f"Format {spec!r} needs a number, the field holds text")

    @F.pandas_udf("string")
    def apply(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None or v != v else format(int(v) if integral else v, spec))

    return apply(col)


def template_parts(template: str) -> list[tuple[str, str | None, str]]:
    """(literal text, field or None, format spec) of a str.format() template."""
    try:
        return [(lit, name, spec or "") for lit, name, spec, _ in string.Formatter().parse(template)]
    except ValueError as e:
        raise StepError(f"Invalid format string {template!r}: {e}") from None


def fill_template(template: str, lookup) -> Column:
    """The template with ``lookup(name) -> (column, type)`` in its fields; null shows as None."""
    pieces = []
    for lit, name, spec in template_parts(template):
        if lit:
            pieces.append(F.lit(lit))
        if name is not None:
            col, kind = lookup(name)
            pieces.append(F.coalesce(formatted(col, kind, spec), F.lit("None")))
    return F.concat(*pieces) if pieces else F.lit("")
