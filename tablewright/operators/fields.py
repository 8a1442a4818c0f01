"""Steps that change schemas: names, order, types and metadata of fields; no row is touched."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import types as T

from tablewright.functions.regex import compiled
from tablewright.package import ROW_ID, Package, Resource, StepError, quoted
from tablewright.schema import cast_resource


def _renamed(res: Resource, names: dict[str, str]) -> Resource:
    for old in names:
        res.field(old)
    new = [names.get(n, n) for n in res.names]
    twice = sorted({n for n in new if new.count(n) > 1})
    if twice:
        raise StepError(f"New field names {twice} already exist in resource {res.name!r}")
    fields = tuple(f | {"name": n} for f, n in zip(res.fields, new, strict=True))
    df = res.df.select(*[quoted(o).alias(n) for o, n in zip(res.names, new, strict=True)], ROW_ID)
    return replace(res, df=df, fields=fields)


def rename_fields(p: Package, fields: list[dict], resources=None) -> Package:
    names = {f["old_field"]: f["new_field"] for f in fields}
    return p.map(resources, lambda r: _renamed(r, names))


def rename_fields_regex(p: Package, fields: list[str], pattern: dict, resources=None) -> Package:
    find = compiled(pattern["find"])
    return p.map(resources, lambda r: _renamed(r, {f: find.sub(pattern["replace"], f) for f in fields}))


def reorder_fields(p: Package, fields: list[str], resources=None) -> Package:
    def step(r: Resource) -> Resource:
        if sorted(fields) != sorted(r.names):
            raise StepError(f"The order must name each field of {r.name!r} once: {sorted(r.names)}")
        return r.project({}, [r.field(n) for n in fields])

    return p.map(resources, step)


def delete_fields(p: Package, fields: list[str], resources=None, regex: bool = True) -> Package:
    def step(r: Resource) -> Resource:
        gone = set()
        for f in fields:
            hit = {n for n in r.names if (re.fullmatch(f, n) if regex else n == f)}
            if not hit:
                raise StepError(f"No field of {r.name!r} matches {f!r}")
            gone |= hit
        return r.project({}, [f for f in r.fields if f["name"] not in gone])

    return p.map(resources, step)


def update_fields(p: Package, fields: dict[str, dict], resources=None) -> Package:
    def step(r: Resource) -> Resource:
        for n in fields:
            r.field(n)
        return replace(r, fields=tuple(f | fields.get(f["name"], {}) for f in r.fields))

    return p.map(resources, step)


def add_schema_metadata(p: Package, resources=None, **metadata) -> Package:
    return p.map(resources, lambda r: r.describe(**metadata, **({"resources": resources} if resources is not None else {})))


def set_types(p: Package, types: dict[str, dict], resources=None, regex: bool = True) -> Package:
    """Declared types, then a cast that fails on cells which don't fit. Temporal output formats follow input formats."""

    def step(r: Resource) -> Resource:
        fields = {f["name"]: f for f in r.fields}
        for pattern, options in types.items():
            hit = [n for n in fields if (re.match(f"^{pattern}$", n) if regex else n == pattern)]
            if not hit:
                raise StepError(f"set_types: no field of {r.name!r} matches {pattern!r}; it has {sorted(fields)}")
            for n in hit:
                f = fields[n] | options
                if f.get("type") in ("date", "datetime", "time") and "format" in options and "outputFormat" not in options:
                    f["outputFormat"] = options["format"]
                fields[n] = f
        return cast_resource(replace(r, fields=tuple(fields.values())))

    return p.map(resources, step)


def update_package(p: Package, **metadata) -> Package:
    if "resources" in metadata:
        raise StepError("update_package cannot change resources")
    return replace(p, meta=p.meta | metadata)


def update_resource(p: Package, resources=None, metadata: dict | None = None, **more) -> Package:
    return p.map(resources, lambda r: replace(r, descriptor=r.descriptor | (metadata or {}) | more))


def remove_resources(p: Package, resources) -> Package:
    gone = p.selected(resources)
    if not gone or (isinstance(resources, list) and set(resources) - set(p.names)):
        raise StepError(f"remove_resources: no resource matches {resources}; there are {p.names}")
    return p.with_resources(r for r in p.resources if r.name not in gone)


def rename_resource(p: Package, old_resource: str, new_resource: str) -> Package:
    if old_resource not in p.names:
        raise StepError(f"rename_resource: there is no {old_resource!r} among {p.names}")

    def step(r: Resource) -> Resource:
        path = str(r.descriptor.get("path", f"{r.name}.csv")).replace(old_resource, new_resource)
        return replace(r, name=new_resource, descriptor=r.descriptor | {"path": path})

    return p.map([old_resource], step)


def temporal_field(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))
