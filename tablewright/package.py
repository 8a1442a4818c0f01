"""The data model: a package is an ordered list of named tables that carry their schema with them.

A resource is a DataFrame and a descriptor. The descriptor's schema lists the fields in
column order (name, type, any metadata) and the values that count as missing. Row order
is part of the meaning, so each DataFrame has one more column, ROW_ID, of any type that
can be ordered; Catalyst prunes it wherever no step needs it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_ID = "__row_id"


class StepError(ValueError):
    """A step's parameters don't fit the package; raised before any row is read."""


def logical_type(kind: T.DataType) -> str:
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(kind, (T.DecimalType, T.DoubleType, T.FloatType)):
        return "number"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    known = {T.StringType: "string", T.DateType: "date", T.BooleanType: "boolean", T.ArrayType: "array", T.MapType: "object", T.StructType: "object"}
    return next((v for k, v in known.items() if isinstance(kind, k)), "any")


@dataclass(frozen=True)
class Resource:
    """One table. ``dense``: its row ids are 1 .. n without gaps. ``stable``: they are the same whenever they are computed."""

    name: str
    df: DataFrame
    fields: tuple[dict, ...]
    descriptor: dict = field(default_factory=dict)
    dense: bool = False
    stable: bool = False

    @property
    def names(self) -> list[str]:
        return [f["name"] for f in self.fields]

    @property
    def schema_props(self) -> dict:
        return self.descriptor.get("schema", {})

    @property
    def missing(self) -> list[str]:
        return list(self.schema_props.get("missingValues", [""]))

    def field(self, name: str) -> dict:
        for f in self.fields:
            if f["name"] == name:
                return f
        raise StepError(f"{self.name!r} has no field {name!r} (not found among {sorted(self.names)})")

    def dtype(self, name: str) -> T.DataType:
        return self.df.schema[name].dataType

    def is_missing(self, name: str, col: Column | None = None) -> Column:
        """Whether a cell is null or, in a text column, one of the missing values."""
        col = quoted(name) if col is None else col
        if isinstance(self.dtype(name), T.StringType) and self.missing:
            return col.isNull() | col.isin(*self.missing)
        return col.isNull()

    def project(self, columns: dict[str, Column], fields: Iterable[dict], **changes) -> Resource:
        """A new table of ``fields`` in that order; those not in ``columns`` stay as they are."""
        fields = tuple(fields)
        df = self.df.select(*[columns.get(f["name"], quoted(f["name"])).alias(f["name"]) for f in fields], ROW_ID)
        return replace(self, df=df, fields=fields, **changes)

    def put(self, columns: dict[str, Column], described: dict[str, dict]) -> Resource:
        """Columns replaced in their places or, if new, added at the end."""
        fields = [described.get(f["name"], f) for f in self.fields]
        fields += [d for n, d in described.items() if n not in self.names]
        return self.project(columns, fields)

    def describe(self, **schema) -> Resource:
        return replace(self, descriptor=self.descriptor | {"schema": self.schema_props | schema})

    def public(self) -> dict:
        """The descriptor as JSON would have it."""
        return self.descriptor | {"name": self.name, "schema": self.schema_props | {"fields": [dict(f) for f in self.fields]}}

    def frame(self) -> DataFrame:
        """The rows without their ids, in no particular order."""
        return self.df.select(*[quoted(n) for n in self.names])

    def ordered(self) -> DataFrame:
        return self.df.orderBy(ROW_ID).select(*[quoted(n) for n in self.names])

    def rows(self) -> list[dict]:
        """All rows in order, on the driver: for tests and small results."""
        return [r.asDict() for r in self.ordered().collect()]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class Package:
    resources: tuple[Resource, ...] = ()
    meta: dict = field(default_factory=dict)
    stats: dict = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return [r.name for r in self.resources]

    def __getitem__(self, name: str) -> Resource:
        for r in self.resources:
            if r.name == name:
                return r
        raise StepError(f"There is no resource {name!r} (not found among {self.names})")

    def selected(self, resources) -> list[str]:
        """Names that ``resources`` means: None all, a list those names, a string a full-match pattern."""
        if resources is None:
            return self.names
        if isinstance(resources, int):
            return [self.names[resources]]
        if isinstance(resources, str):
            return [n for n in self.names if re.fullmatch(resources, n)]
        return [n for n in self.names if n in resources]

    def map(self, resources, fn: Callable[[Resource], Resource]) -> Package:
        chosen = set(self.selected(resources))
        return replace(self, resources=tuple(fn(r) if r.name in chosen else r for r in self.resources))

    def with_resources(self, resources: Iterable[Resource]) -> Package:
        return replace(self, resources=tuple(resources))


def from_frame(name: str, df: DataFrame, order_by: str | list[str] | None = None, descriptor: dict | None = None) -> Resource:
    """A DataFrame as a resource. Rows are in the order of ``order_by``, or else as they come."""
    keys = [order_by] if isinstance(order_by, str) else order_by
    row_id = F.monotonically_increasing_id() if not keys else quoted(keys[0]) if len(keys) == 1 else F.struct(*[quoted(k) for k in keys])
    fields = tuple({"name": f.name, "type": logical_type(f.dataType)} | dict(f.metadata or {}) for f in df.schema if f.name != ROW_ID)
    if ROW_ID not in df.columns:
        df = df.select("*", row_id.alias(ROW_ID))
    return Resource(name, df, fields, {"path": f"{name}.csv"} | (descriptor or {}), stable=bool(keys))


def namespaced(f: dict) -> dict:
    """A field's metadata under keys that end in a colon: what derived fields may inherit."""
    return {k: v for k, v in f.items() if k.endswith(":")}


def unnamespaced(f: dict) -> dict:
    return {k: v for k, v in f.items() if not k.endswith(":")}
