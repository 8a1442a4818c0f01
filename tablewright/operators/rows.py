"""Steps on rows: filters, edits, computed fields and sorting."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright import order
from tablewright.functions import temporal, text
from tablewright.package import ROW_ID, Package, Resource, StepError, quoted
from tablewright.plans import expressions as ex
from tablewright.schema import NUMBER, cast_cell

#: From so many edits on they are joined as a table instead of being part of the plan.
MANY_EDITS = 200


def guarded(res: Resource, statement: str | None) -> tuple[Resource, Column | None]:
    """The table, numbered if the statement asks for it, and its predicate."""
    node = ex.parse_boolean(statement)
    if node is None:
        return res, None
    if node.rows_needed():
        res = order.numbered(res)
    return res, ex.boolean_column(node, ex.Scope(res))


def boolean_filter_rows(p: Package, boolean_statement: str | None = None, resources=None) -> Package:
    def step(r: Resource) -> Resource:
        r, keep = guarded(r, boolean_statement)
        return r if keep is None else replace(r, df=r.df.where(keep), dense=False)

    return p.map(resources, step)


def edit_cells(p: Package, edited: dict, resources=None) -> Package:
    """Cells overwritten by row number. A row number beyond the table is an error."""
    edits = {int(k): v for k, v in edited.items()}
    if any(k < 1 for k in edits):
        raise StepError("Row numbers begin at 1")

    def step(r: Resource) -> Resource:
        by_field: dict[str, dict[int, object]] = {}
        for row, cells in edits.items():
            for cell in cells:
                r.field(cell["field"])
                by_field.setdefault(cell["field"], {})[row] = cell["value"]
        if not by_field:
            return r
        r, rows = order.at_numbers(r, sorted(edits))
        if max(edits) > rows:
            raise StepError(f"Edits of rows {sorted(k for k in edits if k > rows)} were not used: {r.name!r} has {rows} rows")
        columns = {}
        df = r.df
        for name, cells in by_field.items():
            kind = r.dtype(name)
            value = lambda v, f=r.field(name), kind=kind: cast_cell(F.lit(None if v is None else str(v)).cast("string"), T.StringType(), f, r.missing).cast(kind)
            if len(cells) < MANY_EDITS:
                out = quoted(name)
                for row, v in cells.items():
                    out = F.when(F.col(order.NUMBER) == row, value(v)).otherwise(out)
                columns[name] = out
            else:  # as large as the parameter it came in, which the driver already holds
                at, new = f"__at_{len(columns)}", f"__new_{len(columns)}"
                table = df.sparkSession.createDataFrame([(k, None if v is None else str(v)) for k, v in cells.items()], f"{at} long, {new} string")
                df = df.join(F.broadcast(table), F.col(order.NUMBER) == F.col(at), "left")
                cell = cast_cell(F.col(new), T.StringType(), r.field(name), r.missing).cast(kind)
                columns[name] = F.when(F.col(at).isNotNull(), cell).otherwise(quoted(name))
        return replace(r, df=df).project(columns, r.fields)

    return p.map(resources, step)


def boolean_add_computed_field(p: Package, fields: list[dict], resources=None) -> Package:
    """Columns from the last function whose condition holds.

    Conditions and math see the targets before them, templates the original row.
    """
    plans = []
    for f in fields:
        plan = []
        for fn in f.get("functions", []):
            if fn.get("always_run", False):
                when = None
            else:
                when = ex.parse_boolean(fn.get("boolean"))
                if when is None:
                    raise StepError("A function of boolean_add_computed_field needs a boolean")
            value = str(fn.get("value", ""))
            plan.append((when, ex.parse_math(value) if fn.get("math_operation", False) else value))
        plans.append((f["target"], f.get("type"), plan))

    def step(r: Resource) -> Resource:
        if any(when is not None and when.rows_needed() for _, _, plan in plans for when, _ in plan):
            r = order.numbered(r)
        original = ex.Scope(r)
        # originals stay under their names; targets are made beside them, each seen by the next
        made: dict[str, tuple[Column, T.DataType]] = {}
        df = r.df
        for k, (target, kind, plan) in enumerate(plans):
            scope, dtype = ex.Scope(r, made), _target_type(kind)
            cases = None
            for when, value in reversed(plan):
                cell = _value(value, kind, scope, original, dtype)
                if when is None:
                    out = _tail(cases, cell)
                    break
                cases = (F if cases is None else cases).when(ex.boolean_column(when, scope), cell)
            else:
                known = target in made or target in r.names
                out = _tail(cases, scope.raw(target)[0].cast(dtype) if known else F.lit(None).cast(dtype))
            df = df.withColumn(f"__new_{k}", out.cast(dtype))
            made = made | {target: (F.col(f"__new_{k}"), dtype)}
        described = {t: {"name": t, "type": kind or "string"} for t, kind, _ in plans}
        return replace(r, df=df).put({n: c for n, (c, _) in made.items()}, described)

    return p.map(resources, step)


def _tail(cases, last: Column) -> Column:
    return last if cases is None else cases.otherwise(last)


def _target_type(kind: str | None) -> T.DataType:
    known = {"number": NUMBER, "integer": T.LongType(), "datetime": T.TimestampNTZType(), "date": T.DateType(), "boolean": T.BooleanType()}
    return known.get(kind, T.StringType())


def _value(value, kind: str | None, scope: ex.Scope, original: ex.Scope, dtype: T.DataType) -> Column:
    if isinstance(value, ex.Node):
        col = ex.math_column(value, scope)
        if isinstance(dtype, T.StringType):
            doubles = any(isinstance(scope.raw(f)[1], (T.DoubleType, T.FloatType)) for f in value.fields())
            return text.number_text(col, T.DoubleType() if doubles else NUMBER) if doubles else text.strip_zeros(col.cast("decimal(38,18)").cast("string"))
        return col.cast(dtype)
    filled = text.fill_template(value, original.raw)
    filled = F.when(~filled.isin(*ex.NULL_WORDS), filled)
    if kind in ("datetime", "date", "time"):
        ts = temporal.anytime(filled)
        return temporal.strftime(ts, "%H:%M:%S") if kind == "time" else ts.cast(dtype)
    return cast_cell(filled, T.StringType(), {"type": kind or "string"}, scope.res.missing).cast(dtype)


def add_computed_field(p: Package, fields: list[dict] | None = None, resources=None, **one) -> Package:
    """Row-wise sum, avg, max, min, multiply, constant, join and format. Nulls are left out of the first five."""
    listed = fields or [one]

    def step(r: Resource) -> Resource:
        for f in listed:
            target = f["target"] if isinstance(f["target"], dict) else {"name": f["target"]}
            operation, sources, extra = f["operation"], f.get("source", []), f.get("with")
            scope = ex.Scope(r)
            cells = [scope.value(s) for s in sources]
            kind = {"join": "string", "format": "string"}.get(operation)
            if operation == "constant":
                col, kind = F.lit(extra), "integer" if isinstance(extra, int) and not isinstance(extra, bool) else "number" if isinstance(extra, float) else "string"
            elif operation == "join":
                col = F.concat_ws(str(extra or ""), *[text.python_text(c, k, None) for c, k in cells])
            elif operation == "format":
                col = text.fill_template(str(extra), scope.raw)
            elif operation in ("sum", "avg", "max", "min", "multiply"):
                if not cells:
                    raise StepError(f"{operation} needs source fields")
                whole = all(isinstance(k, T.IntegralType) for _, k in cells)
                kind = "integer" if whole and operation != "avg" else "number"
                col = _across(operation, cells, whole)
            else:
                raise StepError(f"Unknown operation {operation!r}")
            kind = target.get("type", kind)
            dtype = _target_type(kind)
            if kind == "number" and any(isinstance(k, T.DoubleType) for _, k in cells):
                dtype = T.DoubleType()
            r = r.put({target["name"]: col.cast(dtype)}, {target["name"]: {"type": kind} | target})
        return r

    return p.map(resources, step)


def _across(operation: str, cells: list[tuple[Column, T.DataType]], whole: bool) -> Column:
    for _, k in cells:
        if not isinstance(k, T.NumericType):
            raise StepError(f"{operation} needs numeric fields")
    doubles = any(isinstance(k, (T.DoubleType, T.FloatType)) for _, k in cells)
    cols = [c.cast("double" if doubles else "long" if whole else NUMBER) for c, _ in cells]
    if operation in ("max", "min"):
        return (F.greatest if operation == "max" else F.least)(*cols) if len(cols) > 1 else cols[0]
    n = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in cols[1:]), F.when(cols[0].isNotNull(), 1).otherwise(0))
    if operation == "multiply":
        out = F.coalesce(cols[0], F.lit(1))
        for c in cols[1:]:
            out = out * F.coalesce(c, F.lit(1))
            out = out if doubles or whole else out.cast(NUMBER)
        return out
    total = sum((F.coalesce(c, F.lit(0)) for c in cols[1:]), F.coalesce(cols[0], F.lit(0)))
    return total if operation == "sum" else F.when(n > 0, total / n)


def sort(p: Package, resources=None, reverse: bool = False, **how) -> Package:
    """Stable order by a field, a template of fields, or a function from the table to columns.

    Numbers order by value; a null in text orders as "None", in numbers between 0 and the
    positive ones, in times last. ``reverse`` turns ties around too.
    """
    by = how.get("sort-by", how.get("sort_by"))

    def step(r: Resource) -> Resource:
        if callable(by):
            keys = by(r)
            keys = list(keys) if isinstance(keys, (list, tuple)) else [keys]
        else:
            names = by if isinstance(by, list) else re.findall(r"\{([^}]*)\}", by) or [by]
            keys = []
            for item in names:
                name, _, spec = item.strip("{}").partition(":")
                r.field(name)
                keys += _sort_keys(quoted(name), r.dtype(name), spec)
        keys.append(F.col(ROW_ID))
        return order.sorted_by(r, [k.desc() if reverse else k.asc() for k in keys])

    return p.map(resources, step)


def _sort_keys(col: Column, kind: T.DataType, spec: str) -> list[Column]:
    if spec:
        return [text.formatted(col, kind, spec)]
    if isinstance(kind, T.StringType):
        return [F.coalesce(col, F.lit("None"))]
    if isinstance(kind, T.NumericType):
        return [F.when(col.isNull(), 1).when(col <= 0, 0).otherwise(2), col]
    return [F.when(col.isNull(), 1).otherwise(0), col]
