"""Declared types: casts of text to them, and text of them for sinks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import temporal
from tablewright.functions.text import number_text, strip_zeros
from tablewright.package import ROW_ID, Resource, StepError, quoted

NUMBER = T.DecimalType(38, 18)
TEMPORAL_DEFAULTS = {"date": "%Y-%m-%d", "time": "%H:%M:%S", "datetime": "%Y-%m-%dT%H:%M:%S"}


def number_type(field: dict) -> T.DataType:
    """``carrier: double`` or ``decimal: [precision, scale]`` in a field override the default."""
    if field.get("carrier") == "double":
        return T.DoubleType()
    return T.DecimalType(*field["decimal"]) if "decimal" in field else NUMBER


def cast_cell(col: Column, kind: T.DataType, field: dict, missing: list[str]) -> Column:
    """A cell as its field declares it; text that doesn't fit raises an error when the row is read."""
    want = field.get("type", "string")
    text = isinstance(kind, T.StringType)
    if text and want != "string" and missing:
        col = F.when(~col.isin(*missing), col)
    if want == "string":
        from tablewright.functions.text import python_text

        return col if text else python_text(col, kind, None)
    if want == "number":
        target = number_type(field)
        if text:
            if field.get("groupChar"):
                col = F.replace(col, F.lit(field["groupChar"]), F.lit(""))
            if field.get("decimalChar", ".") != ".":
                col = F.replace(col, F.lit(field["decimalChar"]), F.lit("."))
            if field.get("bareNumber") is False:
                col = F.regexp_replace(col, r"^[^0-9+\-.]+|[^0-9.]+$", "")
        elif isinstance(kind, T.DecimalType) and "decimal" not in field and field.get("carrier") != "double":
            return col
        return col.cast(target)
    if want in ("integer", "year"):
        return F.trim(col).cast("long") if text else col.cast("long")
    if want == "boolean" and text:
        yes, no = field.get("trueValues", ["true", "True", "TRUE", "1"]), field.get("falseValues", ["false", "False", "FALSE", "0"])
        bad = F.raise_error(F.concat(F.lit("not a boolean: "), col)).cast("boolean")
        return F.when(col.isNull(), F.lit(None).cast("boolean")).when(col.isin(*yes), True).when(col.isin(*no), False).otherwise(bad)
    if want in ("date", "datetime", "time") and text:
        fmt = field.get("format", "default")
        if fmt == "any":
            ts = temporal.anytime(col)
        elif fmt == "default" and want == "datetime":
            ts = F.regexp_replace(col, "Z$", "").cast("timestamp_ntz")
        else:
            ts, _ = temporal.strptime(col, TEMPORAL_DEFAULTS[want] if fmt == "default" else fmt)
        return ts.cast("date") if want == "date" else temporal.strftime(ts, "%H:%M:%S") if want == "time" else ts
    simple = {"boolean": "boolean", "date": "date"}
    if want == "datetime":
        return col if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else col.cast("timestamp_ntz")
    return col.cast(simple[want]) if want in simple else col


def cast_resource(res: Resource) -> Resource:
    """Every column as its field declares it: what set_types, sinks and results do."""
    cols = {}
    for f in res.fields:
        kind = res.dtype(f["name"])
        cols[f["name"]] = cast_cell(quoted(f["name"]), kind, f, res.missing)
    return res.project(cols, res.fields)


def output_text(res: Resource, field: dict, temporal_property: str = "outputFormat") -> Column:
    """A cell as a text sink writes it; null as the empty text."""
    col, kind = quoted(field["name"]), res.dtype(field["name"])
    if isinstance(kind, (T.TimestampNTZType, T.DateType, T.TimestampType)):
        local = col
        if isinstance(kind, T.TimestampType):
            local = F.convert_timezone(F.current_timezone(), F.lit("UTC"), col.cast("timestamp_ntz"))
        want = "date" if isinstance(kind, T.DateType) else "datetime"
        fmt = field.get(temporal_property) or field.get("outputFormat") or TEMPORAL_DEFAULTS[want]
        out = temporal.strftime(local, fmt, F.lit("UTC") if isinstance(kind, T.TimestampType) else None)
    elif field.get("numberOutputFormat") == "scientificNotation" and isinstance(kind, T.NumericType):
        out = scientific(col)
    elif isinstance(kind, T.NumericType):
        digits = field.get("displayDigits")
        out = number_text(col, kind) if digits is None else F.bround(col.cast(NUMBER), digits).cast(T.DecimalType(38, max(0, digits))).cast("string")
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        out = F.to_json(col)
    elif isinstance(kind, T.BooleanType):
        out = F.initcap(col.cast("string"))
    else:
        out = col.cast("string")
    return F.coalesce(out, F.lit(""))


def scientific(col: Column) -> Column:
    """Python's exponent notation of a decimal: all its digits, the exponent without padding."""
    plain = strip_zeros(F.abs(col).cast(NUMBER).cast("string"))
    digits = F.regexp_replace(F.replace(plain, F.lit("."), F.lit("")), "^0+", "")
    whole = F.split_part(plain, F.lit("."), F.lit(1))
    lead = F.length(F.regexp_extract(F.split_part(plain, F.lit("."), F.lit(2)), "^(0*)", 1))
    exponent = F.when(whole != "0", F.length(whole) - 1).otherwise(-lead - 1)
    kept = F.regexp_replace(digits, "0+$", "")
    mantissa = F.concat(F.substring(kept, 1, 1), F.when(F.length(kept) > 1, F.concat(F.lit("."), F.substring(kept, 2, 64))).otherwise(""))
    return F.when(col == 0, "0e+0").otherwise(F.concat(F.when(col < 0, "-").otherwise(""), mantissa, F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.abs(exponent).cast("string")))


def declared(name: str, kind: str = "string", **more) -> dict:
    if not name:
        raise StepError("A field needs a name")
    return {"name": name, "type": kind} | more


__all__ = ["NUMBER", "ROW_ID", "cast_cell", "cast_resource", "declared", "number_type", "output_text", "scientific"]
