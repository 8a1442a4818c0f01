"""Joins that aggregate first: the source becomes one row for each key, so target rows never multiply."""

from __future__ import annotations

import re
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright import order
from tablewright.functions import text
from tablewright.package import ROW_ID, Package, Resource, StepError, quoted

MODES = ("inner", "half-outer", "full-outer")
AGGREGATES = ("sum", "avg", "median", "max", "min", "first", "last", "count", "any", "set", "array", "counters")
LISTS = ("set", "array", "counters")


def _plain_keys(key) -> list[str] | None:
    """The fields of a key that is a list, or a template of one field and nothing else."""
    if isinstance(key, list):
        return key
    m = re.fullmatch(r"\{([^}:#]+)\}", key)
    return [m[1]] if m else None


def _key_columns(r: Resource, key, native: bool) -> list[Column]:
    if native:
        return [quoted(n) for n in _plain_keys(key)]
    template = ":".join(f"{{{n}}}" for n in key) if isinstance(key, list) else key

    def lookup(name: str) -> tuple[Column, T.DataType]:
        if name == "#":
            return F.col(ROW_ID), T.LongType()
        r.field(name)
        return quoted(name), r.dtype(name)

    return [text.fill_template(template, lookup)]


def _numbered_for(r: Resource, key) -> Resource:
    return order.numbered(r) if isinstance(key, str) and "{#}" in key else r


def _specs(source: Resource, fields: dict) -> dict[str, dict]:
    """Target field -> {name, aggregate}, with '*' spread over the fields that aren't named otherwise."""
    out = {}
    for target, spec in fields.items():
        spec = dict(spec or {})
        if target == "*":
            named = {(s or {}).get("name", t) for t, s in fields.items() if t != "*"}
            for n in source.names:
                if n not in named and n not in fields:
                    out[n] = {"aggregate": "any"} | spec | {"name": n}
            continue
        out[target] = {"name": target, "aggregate": "any"} | spec
    for s in out.values():
        if s["aggregate"] not in AGGREGATES:
            raise StepError(f"Unknown aggregate {s['aggregate']!r}; known: {', '.join(AGGREGATES)}")
        if s["aggregate"] != "count":
            source.field(s["name"])
    return out


def _aggregate(col: Column, how: str) -> Column:
    """Nulls don't take part, except in count."""
    if how == "count":
        return F.count(F.lit(1))
    if how == "avg":
        return F.avg(col)
    if how == "median":
        return F.median(col)
    if how in ("sum", "max", "min"):
        return {"sum": F.sum, "max": F.max, "min": F.min}[how](col)
    at = F.when(col.isNotNull(), F.col(ROW_ID))
    if how == "first":
        return F.min_by(col, at)
    if how in ("last", "any"):
        return F.max_by(col, at)
    if how == "set":
        return F.array_sort(F.collect_set(col))
    pairs = F.collect_list(F.when(col.isNotNull(), F.struct(F.col(ROW_ID).alias("i"), col.alias("x"))))
    return F.transform(F.array_sort(pairs), lambda e: e["x"])


def _counters(df: DataFrame, keys: list[str], name: str, out: str) -> DataFrame:
    """For each key the values of a field with their counts, most frequent first, then as first seen."""
    per = df.where(quoted(name).isNotNull()).groupBy(*keys, quoted(name).alias("__x")).agg(F.count(F.lit(1)).alias("__n"), F.min(ROW_ID).alias("__i"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("__n")).alias("m"), F.col("__i").alias("i"), F.col("__x").alias("x"))))
    return per.groupBy(*keys).agg(F.transform(ranked, lambda e: F.struct(e["x"].alias("value"), (-e["m"]).alias("count"))).alias(out))


def _grouped(source: Resource, keys: list[Column], specs: dict[str, dict]) -> DataFrame:
    """One row for each key: __k0 .. (the key), __a0 .. (the aggregates), __first (the group's first row id)."""
    names = [f"__k{i}" for i in range(len(keys))]
    df = source.df.select("*", *[k.alias(n) for k, n in zip(keys, names, strict=True)])
    aggs = [_aggregate(quoted(s["name"]) if s["aggregate"] != "count" else F.lit(1), s["aggregate"]).alias(f"__a{i}") for i, s in enumerate(specs.values()) if s["aggregate"] != "counters"]
    out = df.groupBy(*names).agg(F.min(ROW_ID).alias("__first"), *aggs)
    for i, s in enumerate(specs.values()):
        if s["aggregate"] == "counters":
            counted = _counters(df, names, s["name"], f"__a{i}").select(*[F.col(n).alias(f"__c{n}") for n in names], f"__a{i}")
            same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"__c{n}")) for n in names])
            out = out.join(counted, same, "left").drop(*[f"__c{n}" for n in names])
            empty = F.array().cast(counted.schema[f"__a{i}"].dataType)
            out = out.withColumn(f"__a{i}", F.coalesce(f"__a{i}", empty))
    return out


def _described(source: Resource, specs: dict[str, dict]) -> dict[str, dict]:
    out = {}
    for target, s in specs.items():
        how = s["aggregate"]
        if how == "count":
            out[target] = {"name": target, "type": "integer"}
        elif how in LISTS:
            out[target] = {"name": target, "type": "array"}
        else:
            old = source.field(s["name"])
            kept = old if how in ("median", "first", "last", "any") else {}
            kind = "number" if how == "avg" else old["type"]
            if how == "median":
                kept = {k: v for k, v in kept.items() if k != "decimal"}
            out[target] = kept | {"name": target, "type": kind}
    return out


def _result(col: Column, kind: T.DataType, how: str) -> Column:
    """Aggregates of numbers in the declared type, not the wider one that Spark makes of them."""
    if how in ("sum", "median", "avg") and isinstance(kind, T.DecimalType):
        return col.cast(T.DecimalType(38, kind.scale if how == "sum" else 18))
    if how == "sum" and isinstance(kind, T.IntegralType):
        return col.cast("long")
    if how == "median" and isinstance(kind, T.IntegralType):
        return col.cast("double")
    return col


def join(p: Package, source: dict, target: dict, fields: dict | None = None, mode: str | None = None, full: bool | None = None) -> Package:
    """Aggregates of the source looked up by key.

    inner keeps matched target rows, half-outer all of them, full-outer also appends the
    source's other keys, ordered by key. A target without a key becomes the source
    itself, one row for each key.
    """
    if full is not None:
        mode = "half-outer" if full else "inner"
    mode = mode or "half-outer"
    if mode not in MODES:
        raise StepError(f"mode must be one of {', '.join(MODES)}")
    target = target if isinstance(target, dict) else {"name": target}
    src, tgt = source["name"], target["name"]
    if src not in p.names or tgt not in p.names:
        raise StepError(f"Source {src!r} and target {tgt!r} must be resources; there are {p.names}")
    if target.get("key") is not None and p.names.index(src) >= p.names.index(tgt):
        raise StepError(f"The source {src!r} must come before the target {tgt!r}")
    source_table = _numbered_for(p[src], source["key"])
    specs = _specs(source_table, fields or {})
    made = _described(source_table, specs)
    if target.get("key") is None:
        joined = _deduplicated(source_table, source["key"], specs, made, tgt)
    else:
        joined = _looked_up(source_table, source["key"], _numbered_for(p[tgt], target["key"]), target["key"], specs, made, mode)
    gone = {src} if source.get("delete", False) else set()
    return p.with_resources(joined if r.name == tgt else r for r in p.resources if r.name not in gone - {tgt})


def _deduplicated(source: Resource, key, specs: dict, made: dict, name: str) -> Resource:
    plain = _plain_keys(key)
    keys = _key_columns(source, key, plain is not None)
    grouped = _grouped(source, keys, specs)
    cols = [_result(F.col(f"__a{i}"), source.dtype(s["name"]), s["aggregate"]).alias(t) if s["aggregate"] != "count" else F.col(f"__a{i}").alias(t) for i, (t, s) in enumerate(specs.items())]
    df = grouped.select(*cols, F.col("__first").alias(ROW_ID))
    return Resource(name, df, tuple(made.values()), source.descriptor, stable=source.stable)


def _looked_up(source: Resource, source_key, target: Resource, target_key, specs: dict, made: dict, mode: str) -> Resource:
    a, b = _plain_keys(source_key), _plain_keys(target_key)
    if a and b and len(a) != len(b):
        raise StepError("The keys of source and target have different lengths")
    native = bool(a and b) and all(source.dtype(source.field(x)["name"]) == target.dtype(target.field(y)["name"]) for x, y in zip(a, b, strict=True))
    grouped = _grouped(source, _key_columns(source, source_key, native), specs).withColumn("__hit", F.lit(True))
    names = [f"__k{i}" for i in range(len(a) if native else 1)]
    keys = [k.alias(f"__t{n}") for k, n in zip(_key_columns(target, target_key, native), names, strict=True)]
    keyed = target.df.select("*", *keys, F.lit(True).alias("__here"))
    same = reduce(lambda x, y: x & y, [F.col(f"__t{n}").eqNullSafe(F.col(n)) for n in names])
    both = keyed.join(grouped, same, {"inner": "inner", "half-outer": "left", "full-outer": "full_outer"}[mode])
    columns = {}
    for i, (t, s) in enumerate(specs.items()):
        new = F.col(f"__a{i}") if s["aggregate"] == "count" else _result(F.col(f"__a{i}"), source.dtype(s["name"]), s["aggregate"])
        if t in target.names:
            have = target.field(t)["type"]
            if have != made[t]["type"]:
                raise StepError(f"The field {t!r} is of type {have} and cannot hold {made[t]['type']}")
            old = quoted(t).cast(both.select(new.alias("x")).schema["x"].dataType)
            new = F.when(F.col("__hit"), new).otherwise(old)
        columns[t] = new
    if mode == "full-outer":  # rows that only the source has get their key back
        refill = dict(zip(b, names, strict=True)) if native else {b[0]: names[0]} if a and b and len(b) == 1 else {}
        for n, k in refill.items():
            if n not in specs:
                columns[n] = F.when(F.col("__here"), quoted(n)).otherwise(F.col(k).cast(target.dtype(n)))
        key_text = F.concat_ws(":", *[F.coalesce(F.col(n).cast("string"), F.lit("None")) for n in names])
        alone = F.col("__here").isNull()
        row_id = F.struct(alone.alias("part"), F.col(ROW_ID).alias("at"), F.when(alone, key_text).alias("key"))
    else:
        row_id = F.col(ROW_ID)
    order_of = [f["name"] for f in target.fields] + [t for t in specs if t not in target.names]
    fields = tuple(made.get(n) or target.field(n) for n in order_of)
    fields = tuple(target.field(f["name"]) | f if f["name"] in target.names and f["name"] in made else f for f in fields)
    df = both.select(*[columns.get(n, quoted(n)).alias(n) for n in order_of], row_id.alias(ROW_ID))
    return replace(target, df=df, fields=fields, dense=target.dense and mode == "half-outer")
