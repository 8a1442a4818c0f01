"""Steps on text: find and replace, formatting, splitting, taking out what isn't a number."""

from __future__ import annotations

import re
from dataclasses import replace as changed

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import regex, text
from tablewright.operators.rows import guarded
from tablewright.package import Package, Resource, StepError, namespaced, quoted
from tablewright.schema import cast_cell


def _case_of_groups(pattern: str, upper: bool):
    """Changes the case of what the groups of each match hold; the rest of the text stays."""
    find = regex.compiled(pattern)

    def one(m: re.Match) -> str:
        out, at, base = [], 0, m.start()
        for g in range(1, (m.re.groups or 0) + 1):
            s, e = m.span(g)
            if s < 0 or s - base < at:
                continue
            held = m[g].upper() if upper else m[g].lower()
            out += [m[0][at : s - base], held]
            at = e - base
        return "".join([*out, m[0][at:]])

    @F.pandas_udf("string")
    def apply(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else find.sub(one, v))

    return apply


def find_replace(p: Package, fields: list[dict], resources=None, boolean_statement: str | None = None) -> Package:
    def step(r: Resource) -> Resource:
        r, guard = guarded(r, boolean_statement)
        columns = {}
        for f in fields:
            name = f["name"]
            r.field(name)
            kind = r.dtype(name)
            col = columns.get(name, quoted(name))
            before = text.python_text(col, kind, None)
            out = before
            for pat in f.get("patterns", []):
                how = pat.get("replace_function", "string")
                if how not in ("string", "uppercase", "lowercase"):
                    raise StepError(f"replace_function must be string, uppercase or lowercase, not {how!r}")
                at = F.coalesce(out, F.lit("")) if pat.get("replace_missing_values", False) else out
                if how == "string":
                    new = F.regexp_replace(at, F.lit(regex.to_java(pat["find"])), F.lit(regex.replacement(str(pat["replace"]), pat["find"])))
                else:
                    new = _case_of_groups(pat["find"], how == "uppercase")(at)
                gone = out.isNull() | out.isin(*r.missing) if r.missing else out.isNull()
                out = new if pat.get("replace_missing_values", False) else F.when(gone, out).otherwise(new)
            if guard is not None:
                out = F.when(guard, out).otherwise(before)
            columns[name] = out if isinstance(kind, T.StringType) else cast_cell(out, T.StringType(), r.field(name), r.missing)
        return r.project(columns, r.fields)

    return p.map(resources, step)


def string_format(p: Package, fields: list[dict], resources=None, boolean_statement: str | None = None) -> Package:
    """str.format() of several fields; a missing one keeps the output as it was, or null."""

    def step(r: Resource) -> Resource:
        r, guard = guarded(r, boolean_statement)
        for f in fields:
            inputs = f["input_fields"]
            cells = [(quoted(n), r.dtype(r.field(n)["name"])) for n in inputs]
            automatic = iter(range(len(cells)))

            def lookup(name: str, cells=cells, automatic=automatic, f=f) -> tuple[Column, T.DataType]:
                try:
                    return cells[int(name) if name else next(automatic)]
                except (ValueError, IndexError, StopIteration):
                    raise StepError(f"{f['input_string']!r} has no input {name!r}") from None

            new = text.fill_template(f["input_string"], lookup)
            target = f["output_field"]
            old = text.python_text(quoted(target), r.dtype(target), None) if target in r.names else F.lit(None).cast("string")
            ok = F.lit(True) if guard is None else guard
            for n in inputs:
                ok = ok & ~r.is_missing(n)
            r = r.put({target: F.when(ok, new).otherwise(old)}, {target: {"name": target, "type": "string"}})
        return r

    return p.map(resources, step)


def split_column(p: Package, fields: list[dict], resources=None, delete_input: bool = False, boolean_statement: str | None = None) -> Package:
    """One text field into several, by a pattern's groups or a delimiter; another number of parts is an error."""

    def step(r: Resource) -> Resource:
        r, guard = guarded(r, boolean_statement)
        columns, described = {}, {}
        for f in fields:
            name, outputs = f["input_field"], f["output_fields"]
            old = r.field(name)
            if bool(f.get("pattern")) == bool(f.get("delimiter")):
                raise StepError("One of pattern and delimiter is required")
            value = text.python_text(quoted(name), r.dtype(name), None)
            if f.get("pattern"):
                groups = regex.compiled(f["pattern"]).groups
                if groups != len(outputs):
                    raise StepError(f"The pattern {f['pattern']!r} has {groups} groups for {len(outputs)} output fields")
                java = regex.to_java(f["pattern"])
                fits = value.rlike(java)
                parts = [F.regexp_extract(value, java, k + 1) for k in range(groups)]
                why = f"' has no match for expression '{f['pattern']}'"
            else:
                found = F.split(value, regex.to_java(f["delimiter"]), -1)
                fits = F.size(found) == len(outputs)
                parts = [F.get(found, F.lit(k)) for k in range(len(outputs))]
                why = f"' does not split into {len(outputs)} by '{f['delimiter']}'"
            bad = F.raise_error(F.concat(F.lit("Row value '"), value, F.lit(why))).cast("string")
            missing = r.is_missing(name)
            for n, part in zip(outputs, parts, strict=True):
                col = F.when(missing, value).when(~fits, bad).otherwise(part)
                columns[n] = col if guard is None else F.when(guard, col)
                described[n] = {"name": n, "type": "string"} | (namespaced(old) if f.get("preserve_metadata") else {})
        out = r.put(columns, described)
        if delete_input:
            gone = {f["input_field"] for f in fields} - set(columns)
            out = out.project({}, [f for f in out.fields if f["name"] not in gone])
        return out

    return p.map(resources, step)


def extract_nonnumeric(p: Package, fields: list[str], resources=None, suffix: str = "_", preserve_metadata: bool = False, boolean_statement: str | None = None) -> Package:
    """Text that is no number moves to a new field right after its own, which becomes null."""

    def step(r: Resource) -> Resource:
        r, guard = guarded(r, boolean_statement)
        columns, listed = {}, []
        for n in fields:
            r.field(n)
        for old in r.fields:
            listed.append(old)
            name, new = old["name"], old["name"] + suffix
            if name not in fields:
                continue
            if new in r.names:
                raise StepError(f"The field {new!r} already exists in {r.name!r}")
            value = text.python_text(quoted(name), r.dtype(name), None)
            odd = ~r.is_missing(name) & ~value.rlike(regex.PYTHON_FLOAT)
            odd = odd if guard is None else F.coalesce(guard, F.lit(False)) & odd
            # an empty text is missing, so null to whoever reads it
            columns[name] = F.when(~odd, quoted(name)) if isinstance(r.dtype(name), T.StringType) else quoted(name)
            columns[new] = F.when(odd, value)
            listed.append({"name": new, "type": "string"} | (namespaced(old) if preserve_metadata else {}))
        return r.project(columns, listed)

    return p.map(resources, step)


def with_text(r: Resource, name: str) -> Resource:
    """The field as text, whatever it was."""
    col = text.python_text(quoted(name), r.dtype(name), None)
    return changed(r.project({name: col}, [f | {"type": "string"} if f["name"] == name else f for f in r.fields]))
