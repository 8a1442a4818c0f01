"""Steps on numbers: rounding, units, and angles in degrees, minutes and seconds."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import regex, text
from tablewright.operators.rows import guarded
from tablewright.package import Package, Resource, StepError, namespaced, quoted, unnamespaced
from tablewright.schema import NUMBER

# How many of the second unit the first one is.
FACTORS = {
    "feet_to_meter": Decimal("0.3048"),
    "fathom_to_meter": Decimal("1.8288"),
    "inch_to_cm": Decimal("2.54"),
    "mile_to_km": Decimal("1.60934"),
}

#: Holds a decimal number of degrees with all the digits that 28-digit arithmetic gives.
DEGREES = T.DecimalType(38, 26)


def _need_number(r: Resource, name: str, integers: bool = False) -> None:
    kind = r.field(name).get("type")
    if not isinstance(r.dtype(name), T.NumericType) or (kind == "integer" and not integers):
        raise StepError(f"{name!r} of {r.name!r} is not of type number")


def round_fields(p: Package, fields: list[dict], resources=None, boolean_statement: str | None = None) -> Package:
    """Half-even rounding in decimals; values with fewer decimals don't change, so ``maximum_precision`` is about text only."""

    def step(r: Resource) -> Resource:
        r, guard = guarded(r, boolean_statement)
        columns, described = {}, {}
        for f in fields:
            name, digits = f["name"], int(f["digits"])
            whole = bool(f.get("convert_to_integer", False))
            if whole and digits:
                raise StepError("round_fields: convert_to_integer needs digits 0")
            _need_number(r, name, integers=whole)
            kind = r.dtype(name)
            rounded = F.bround(quoted(name).cast(NUMBER), digits)
            if whole:
                new, old = rounded.cast("long"), F.bround(quoted(name).cast(NUMBER), 0).cast("long")
                described[name] = r.field(name) | {"type": "integer"}
                if guard is not None:
                    old = F.when(quoted(name).cast("long") == quoted(name), quoted(name).cast("long")).otherwise(F.raise_error(F.lit(f"{name}: a number that isn't whole stays in an integer field")).cast("long"))
            else:
                new, old = rounded.cast(kind), quoted(name)
                display = {"displayDigits": digits} if f.get("preserve_trailing_zeros") and not f.get("maximum_precision") and guard is None else {}
                described[name] = {k: v for k, v in r.field(name).items() if k != "displayDigits"} | display
            columns[name] = new if guard is None else F.when(quoted(name).isNull(), None).when(guard, new).otherwise(old)
        return r.put(columns, described)

    return p.map(resources, step)


def convert_units(p: Package, fields: list[dict], resources=None) -> Package:
    def step(r: Resource) -> Resource:
        for f in fields:
            name, keep = f["name"], f.get("preserve_field", False)
            if f["conversion"] not in FACTORS:
                raise StepError(f"Unknown conversion {f['conversion']!r}; known: {sorted(FACTORS)}")
            _need_number(r, name, integers=True)
            kind = r.dtype(name)
            factor = FACTORS[f["conversion"]]
            product = quoted(name).cast(NUMBER) * F.lit(factor)
            new = product.cast(kind if isinstance(kind, (T.DoubleType, T.FloatType)) else NUMBER)
            old = r.field(name)
            target = f.get("new_field_name") if keep else name
            if not target:
                raise StepError("new_field_name is required with preserve_field")
            if keep and target in r.names:
                raise StepError(f"The field {target!r} already exists in {r.name!r}")
            made = unnamespaced(old) | {"name": target, "type": "number"} | (namespaced(old) if f.get("preserve_metadata") else {})
            listed = []
            for field in r.fields:
                listed += [field, made] if keep and field is old else [made if field is old else field]
            r = r.project({target: new}, listed)
        return r

    return p.map(resources, step)


def convert_to_decimal_degrees(p: Package, fields: list[dict], resources=None, boolean_statement: str | None = None) -> Package:
    """Degrees, minutes and maybe seconds in a text as decimal degrees.

    The sign is that of the degrees' text or of the direction (W and S are negative).
    Minutes or seconds of 60 and more, and degrees beyond 180, raise an error or, with
    ``handle_out_of_bounds``, carry over and wrap around.
    """

    def step(r: Resource) -> Resource:
        r, guard = guarded(r, boolean_statement)
        for f in fields:
            name, target = f["input_field"], f["output_field"]
            old = r.field(name)
            value = text.python_text(quoted(name), r.dtype(name), None)
            new = _degrees(value, f)
            missing = r.is_missing(name)
            col = F.when(missing, F.lit(None).cast(DEGREES)).otherwise(new)
            if guard is not None:
                before = quoted(target).cast(DEGREES) if target in r.names else F.lit(None).cast(DEGREES)
                col = F.when(guard, col).otherwise(before)
            r = r.put({target: col}, {target: {"name": target, "type": "number"} | (namespaced(old) if f.get("preserve_metadata") else {})})
        return r

    return p.map(resources, step)


def _degrees(value: Column, f: dict) -> Column:
    groups = regex.compiled(f["pattern"]).groupindex
    java = regex.to_java(f["pattern"])
    wrap = f.get("handle_out_of_bounds", False)

    def group(name: str) -> Column:
        if name not in groups:
            raise StepError(f"convert_to_decimal_degrees: {f['pattern']!r} has no group {name}")
        return F.trim(F.regexp_extract(value, java, groups[name]))

    exact = lambda col: col.cast(T.DecimalType(38, 28))
    fail = lambda what: F.raise_error(F.concat(F.lit(what + ": '"), value, F.lit("'")))
    wide = T.DecimalType(38, 28)
    degree_text = group("degrees")
    negative = degree_text.startswith("-")
    degrees = F.abs(exact(degree_text))
    sixty = F.lit(Decimal(60))
    if f["format"] == "degrees-minutes-seconds":
        seconds, minutes = exact(group("seconds")), exact(group("minutes"))
        if wrap:
            minutes = (minutes + F.floor(seconds / sixty)).cast(wide)
            seconds = (seconds % sixty).cast(wide)
        else:
            seconds = F.when(seconds >= 60, fail("60 seconds or more").cast(wide)).otherwise(seconds)
        minutes = (minutes + (seconds / sixty).cast(wide)).cast(wide)
    elif f["format"] == "degrees-decimal_minutes":
        minutes = exact(group("decimal_minutes"))
    else:
        raise StepError(f"convert_to_decimal_degrees: unknown format {f['format']!r}")
    if not wrap:
        minutes = F.when(minutes >= 60, fail("60 minutes or more").cast(wide)).otherwise(minutes)
    size = (degrees + (minutes / sixty).cast(wide)).cast(T.DecimalType(38, 26))
    if f.get("directional"):
        west = F.lit(f["directional"] in ("W", "S"))
    elif "directional" in groups:
        west = F.regexp_extract(value, java, groups["directional"]).isin("W", "S")
    else:
        west = F.lit(False)
    signed = F.when(negative | west, -size).otherwise(size)
    if wrap:
        turns = F.lit(Decimal(360))
        signed = F.when(signed > 180, signed - turns * F.ceil((signed - 180) / 360)).when(signed < -180, signed + turns * F.ceil((-signed - 180) / 360)).otherwise(signed)
    else:
        signed = F.when(F.abs(signed) > 180, fail("more than 180 degrees").cast(DEGREES)).otherwise(signed)
    return F.when(~value.rlike(java), fail("no match for the pattern").cast(DEGREES)).otherwise(signed.cast(DEGREES))
