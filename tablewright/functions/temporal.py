"""strptime, strftime and time zones as Spark expressions.

A format becomes one regular expression whose groups are rearranged to a list of
numbers; timestamps are made from those numbers. Nothing depends on the session's zone.
"""

from __future__ import annotations

import calendar
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.package import StepError

MONTHS = list(calendar.month_name)[1:]
SHORT_MONTHS = list(calendar.month_abbr)[1:]
DAYS, SHORT_DAYS = list(calendar.day_name), list(calendar.day_abbr)
_any = lambda names: "(?:" + "|".join(sorted(names, key=len, reverse=True)) + ")"

#: What each directive accepts.
DIRECTIVES = {
    "Y": r"\d{4}", "y": r"\d{2}", "m": r"1[0-2]|0?[1-9]", "d": r"3[01]|[12]\d|0?[1-9]| [1-9]", "H": r"2[0-3]|[01]?\d", "I": r"1[0-2]|0?[1-9]",
    "M": r"[0-5]?\d", "S": r"6[01]|[0-5]?\d", "f": r"\d{1,6}", "j": r"36[0-6]|3[0-5]\d|[12]\d\d|0?[1-9]\d|0?0?[1-9]", "b": _any(SHORT_MONTHS), "B": _any(MONTHS), "p": r"[AaPp][Mm]",
    "z": r"[+-]\d\d:?[0-5]\d|Z", "Z": r"[A-Za-z]{3,5}", "a": _any(SHORT_DAYS), "A": _any(DAYS),
}
_KEPT = "YymdHIMSfjbBpz"


def parse_format(fmt: str) -> tuple[str, list[str]]:
    """(Java pattern of the whole text, its directives in order of their groups)."""
    out, groups, i = [], [], 0
    while i < len(fmt):
        c = fmt[i]
        if c == "%":
            d = fmt[i + 1 : i + 2]
            i += 2
            if d == "%":
                out.append("%")
            elif d not in DIRECTIVES:
                raise StepError(f"Date directive %{d} is not supported")
            elif d in groups:
                raise StepError(f"Date directive %{d} appears twice in {fmt!r}")
            elif d in _KEPT:
                groups.append(d)
                out.append(f"({DIRECTIVES[d]})")
            else:
                out.append(f"(?:{DIRECTIVES[d]})")
        elif c.isspace():
            while i < len(fmt) and fmt[i].isspace():
                i += 1
            out.append(r"\s+")
        else:
            out.append(re.escape(c) if c.isascii() and not c.isalnum() else c)
            i += 1
    return "(?i)\\A" + "".join(out) + "\\z", groups


def _bound(col: Column, fn) -> Column:
    """fn(col) with col computed once, however often fn uses it."""
    return F.element_at(F.transform(F.array(col), fn), 1)


def strptime(text: Column, fmt: str, year: int | None = None) -> tuple[Column, bool]:
    """(timestamp without zone, whether it is UTC by an offset in the text). Other texts raise an error."""
    pattern, groups = parse_format(fmt)
    found = F.split(F.regexp_replace(text, pattern, "|".join(f"${k + 1}" for k in range(len(groups))) or "0"), r"\|", -1)
    utc = "z" in groups

    def assemble(parts: Column) -> Column:
        got = {d: F.element_at(parts, k + 1) for k, d in enumerate(groups)}
        number = lambda d, default: F.trim(got[d]).cast("int") if d in got else F.lit(default)
        if year is not None:
            y = F.lit(int(year))
        elif "Y" in got:
            y = number("Y", 1900)
        elif "y" in got:
            y = number("y", 0) + F.when(number("y", 0) >= 69, 1900).otherwise(2000)
        else:
            y = F.lit(1900)
        named = lambda d, names: F.array_position(F.array(*[F.lit(n.lower()) for n in names]), F.lower(got[d])).cast("int")
        month = number("m", 1) if "m" in got else named("B", MONTHS) if "B" in got else named("b", SHORT_MONTHS) if "b" in got else F.lit(1)
        hour = number("H", 0)
        if "I" in got and "H" not in got:
            hour = number("I", 0) % 12 + (F.when(F.lower(got["p"]) == "pm", 12).otherwise(0) if "p" in got else F.lit(0))
        second = number("S", 0).cast("decimal(8,6)")
        if "f" in got:
            second = (second + F.rpad(got["f"], 6, "0").cast("decimal(6,0)") / F.lit(1_000_000)).cast("decimal(8,6)")
        if "j" in got and not {"m", "b", "B", "d"} & set(got):
            day = F.date_add(F.make_date(y, F.lit(1), F.lit(1)), number("j", 1) - 1)
            made = F.make_timestamp_ntz(F.year(day), F.month(day), F.dayofmonth(day), hour, number("M", 0), second)
        else:
            made = F.make_timestamp_ntz(y, month, number("d", 1), hour, number("M", 0), second)
        if utc:
            z = F.regexp_replace(got["z"], ":", "")
            minutes = F.when(F.upper(z) == "Z", 0).otherwise((F.substring(z, 2, 2).cast("int") * 60 + F.substring(z, 4, 2).cast("int")) * F.when(z.startswith("-"), -1).otherwise(1))
            made = made - F.make_dt_interval(F.lit(0), F.lit(0), minutes)
        return made

    made = _bound(found, assemble)
    bad = F.raise_error(F.concat(F.lit("time data '"), text, F.lit(f"' does not match format '{fmt}'"))).cast("timestamp_ntz")
    return F.when(text.isNull(), F.lit(None).cast("timestamp_ntz")).when(~text.rlike(pattern), bad).otherwise(made), utc


def to_seconds(ts: Column) -> Column:
    """A timestamp without zone, cut to whole seconds."""
    return F.make_timestamp_ntz(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.minute(ts), F.second(ts).cast("decimal(8,6)"))


def strftime(ts: Column, fmt: str, zone_name: Column | None = None, offset_minutes: Column | None = None) -> Column:
    """Text of a timestamp without zone (or a date)."""
    if "%Z" in fmt or "%z" in fmt:  # a zone's name may come from Python, which no lambda can hold
        return _strftime(ts, fmt, zone_name, offset_minutes)
    return _bound(ts, lambda t: _strftime(t, fmt, None, None))


def _strftime(ts: Column, fmt: str, zone_name: Column | None, offset_minutes: Column | None) -> Column:
    pad = lambda n, col: F.lpad(col.cast("string"), n, "0")
    second = F.date_part(F.lit("SECOND"), ts)
    whole, micros = F.floor(second), ((second - F.floor(second)) * 1_000_000).cast("int")
    pick = lambda names, index: F.element_at(F.array(*map(F.lit, names)), index)
    make = {
        "Y": lambda: pad(4, F.year(ts)), "y": lambda: pad(2, F.year(ts) % 100), "m": lambda: pad(2, F.month(ts)), "d": lambda: pad(2, F.dayofmonth(ts)),
        "H": lambda: pad(2, F.hour(ts)), "I": lambda: pad(2, (F.hour(ts) + 11) % 12 + 1), "M": lambda: pad(2, F.minute(ts)), "S": lambda: pad(2, whole), "f": lambda: pad(6, micros),
        "j": lambda: pad(3, F.dayofyear(ts)), "b": lambda: pick(SHORT_MONTHS, F.month(ts)), "B": lambda: pick(MONTHS, F.month(ts)), "a": lambda: pick(SHORT_DAYS, F.weekday(ts) + 1), "A": lambda: pick(DAYS, F.weekday(ts) + 1),
        "p": lambda: F.when(F.hour(ts) >= 12, "PM").otherwise("AM"), "Z": lambda: F.lit("") if zone_name is None else zone_name,
        "z": lambda: F.lit("") if offset_minutes is None else F.concat(F.when(offset_minutes < 0, "-").otherwise("+"), pad(2, F.floor(F.abs(offset_minutes) / 60)), pad(2, F.abs(offset_minutes) % 60)),
    }
    pieces, i = [], 0
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            d = fmt[i + 1]
            if d != "%" and d not in make:
                raise StepError(f"Date directive %{d} is not supported")
            pieces.append(F.lit("%") if d == "%" else make[d]())
            i += 2
        else:
            j = i + 1
            while j < len(fmt) and fmt[j] != "%":
                j += 1
            pieces.append(F.lit(fmt[i:j]))
            i = j
    return F.when(ts.isNotNull(), F.concat(*pieces) if pieces else F.lit(""))


def to_utc(local: Column, zone: str) -> Column:
    """A zone's wall-clock time as UTC. Of a time that occurs twice in autumn, the later: standard time."""
    first = F.convert_timezone(F.lit(zone), F.lit("UTC"), local)
    out = first
    for minutes in (30, 60):  # how far clocks are put back
        later = first + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
        out = F.when(F.convert_timezone(F.lit("UTC"), F.lit(zone), later) == local, later).otherwise(out)
    return out


def from_utc(utc: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def shifted(ts: Column, hours: float, sign: int = 1) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(sign * hours * 3600).cast("decimal(18,6)"))


def plus_days(start: Column, days: Column) -> Column:
    """start + days, a double; fractions to microseconds as Python's timedelta has them."""
    whole = F.when(days >= 0, F.floor(days)).otherwise(F.ceil(days))
    seconds = (days - whole) * 86400
    full = F.when(seconds >= 0, F.floor(seconds)).otherwise(F.ceil(seconds))
    micros = F.rint((seconds - full) * 1_000_000).cast("decimal(18,0)")
    return start + F.make_dt_interval(whole.cast("int"), F.lit(0), F.lit(0), (full.cast("decimal(18,6)") + micros / F.lit(1_000_000)).cast("decimal(18,6)"))


def anytime(text: Column) -> Column:
    """A date or time in free form: ISO in the JVM, other notations through Arrow."""

    @F.pandas_udf("timestamp_ntz")
    def parse(values: pd.Series) -> pd.Series:
        from dateutil import parser

        return pd.to_datetime(values.map(lambda v: None if v is None else parser.parse(v).replace(tzinfo=None)))

    iso = r"\A\d{4}-\d\d-\d\d([ T]\d\d:\d\d(:\d\d(\.\d{1,6})?)?)?\z"
    return F.when(text.rlike(iso), F.when(text.rlike(iso), text).cast("timestamp_ntz")).otherwise(parse(F.when(~text.rlike(iso), text)))
