"""Queries over guards, expressions, errors, schemas, dates, order, own functions and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright import checks, order, scratch
from tablewright.catalog import MONEY, only, plain, query, run
from tablewright.package import ROW_ID, StepError, from_frame
from tablewright.plans.pipeline import Flow, step
from tablewright.streaming import run_stream


def session() -> SparkSession:
    return SparkSession.getActiveSession()


def refusals(cases: dict[str, Callable]) -> DataFrame:
    """Which cases raise a StepError before any row is read."""
    rows = []
    for name, fn in cases.items():
        try:
            fn()
            rows.append((name, False))
        except StepError:
            rows.append((name, True))
    return session().createDataFrame(rows, "rule string, refused boolean")


def _refusals_sql(refused: list[str], fine: list[str] = ()) -> str:
    rows = [f"('{n}', true)" for n in refused] + [f"('{n}', false)" for n in fine]
    return f"SELECT * FROM (VALUES {', '.join(rows)}) v(rule, refused)"


# --- guards --------------------------------------------------------------------------------------

_ON = "c_nationkey > 10"
_GUARD = {"boolean_statement": "{c_nationkey} > 10"}


@query(
    f"SELECT c_custkey, CASE WHEN {_ON} THEN NULL ELSE c_mktsegment END AS c_mktsegment, CASE WHEN {_ON} THEN replace(c_mktsegment, 'U', 'u') END AS c_mktsegment_text,"
    f" CASE WHEN {_ON} THEN '<' || c_custkey || '>' END AS tag, CASE WHEN {_ON} THEN '<' || c_name || '>' ELSE c_name END AS c_name,"
    f" CASE WHEN {_ON} THEN string_split(c_name, '#')[1] END AS a, CASE WHEN {_ON} THEN string_split(c_name, '#')[2] END AS b FROM customer"
)
def guarded_text(t):
    steps = [
        step("split_column", {"fields": [{"input_field": "c_name", "output_fields": ["a", "b"], "delimiter": "#"}]} | _GUARD),
        step("find_replace", {"fields": [{"name": "c_mktsegment", "patterns": [{"find": "U", "replace": "u"}]}]} | _GUARD),
        step("extract_nonnumeric", {"fields": ["c_mktsegment"], "suffix": "_text"} | _GUARD),
        step("string_format", {"fields": [{"output_field": "tag", "input_string": "<{}>", "input_fields": ["c_custkey"]}, {"output_field": "c_name", "input_string": "<{}>", "input_fields": ["c_name"]}]} | _GUARD),
    ]
    return run(t("customer"), *steps, only("customer", "c_custkey", "c_mktsegment", "c_mktsegment_text", "tag", "c_name", "a", "b"))["customer"]


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN CAST(round_even(CAST(o_totalprice AS DECIMAL(18,2)), 0) AS DOUBLE) ELSE o_totalprice END AS o_totalprice, CASE WHEN o_totalprice > 100000 THEN CAST(o_orderdate AS DATE) END AS day FROM orders")
def guarded_numbers_and_dates(t):
    guard = {"boolean_statement": "{o_totalprice} > 100000"}
    day = {"inputs": [{"field": "o_orderdate", "format": "%Y-%m-%d %H:%M:%S"}], "output_field": "day", "output_type": "date", "output_format": "%Y-%m-%d"}
    return run(t("orders"), step("convert_date", {"fields": [day]} | guard), step("round_fields", {"fields": [{"name": "o_totalprice", "digits": 0}]} | guard), only("orders", "o_orderkey", "o_totalprice", "day"))["orders"]


@query("SELECT c_custkey, CASE WHEN c_nationkey > 10 THEN CAST(c_nationkey + CAST(30 AS DOUBLE) / 60 + CAST(36 AS DOUBLE) / 3600 AS DOUBLE) END AS lat FROM customer")
def guarded_degrees(t):
    made = run(t("customer"), only("customer", "c_custkey", "c_nationkey"))["customer"]
    r = from_frame("customer", made.df.withColumn("pos", F.concat(F.col("c_nationkey"), F.lit(" 30 36"))))
    fields = [{"input_field": "pos", "output_field": "lat", "format": "degrees-minutes-seconds", "pattern": r"(?P<degrees>\d+) (?P<minutes>\d+) (?P<seconds>\d+)"}]
    return run(r, step("convert_to_decimal_degrees", {"fields": fields} | _GUARD), only("customer", "c_custkey", "lat"))["customer"]


# --- expressions ---------------------------------------------------------------------------------


@query("SELECT r_regionkey, r_name FROM region")
def filter_nothing(t):
    """No statement keeps every row."""
    return run(t("region"), step("boolean_filter_rows", {"boolean_statement": ""}), step("boolean_filter_rows", {}))["region"]


_MATH = "{value} * ({n} + 1)"


@query("SELECT event_id, CASE WHEN event_type <> 'view' THEN CAST(CAST(value AS DECIMAL(18,2)) * 3 + 1 AS DOUBLE) END AS tripled FROM events")
def computed_math_of_nulls(t):
    number = lambda value, **more: [{"math_operation": True, "value": value} | more]
    fields = [
        {"target": "some", "type": "number", "functions": number("{value}", boolean="{event_type} != 'view'")},
        {"target": "tripled", "type": "number", "functions": number("{some} * 3 + 1", always_run=True)},
    ]
    return run(t("events"), step("set_types", {"types": {"value": MONEY}}), step("boolean_add_computed_field", {"fields": fields}), only("events", "event_id", "tripled"))["events"]


@query(
    "SELECT l_orderkey, l_linenumber, CAST(p * (1 - d) * 0.125 AS DOUBLE) AS part, CAST((d + 1) * (d + 1) * (d + 1) AS DOUBLE) AS cubed, CAST(p * q * 0.5 - 0.001 AS DOUBLE) AS half"
    " FROM (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(12,2)) AS p, CAST(l_discount AS DECIMAL(6,2)) AS d, CAST(l_quantity AS DECIMAL(6,2)) AS q FROM lineitem)"
)
def computed_default_numbers(t):
    """Numbers of the default type: products, quotients and powers in decimals."""
    kinds = {n: {"type": "number"} for n in ("l_extendedprice", "l_discount", "l_quantity")}
    one = lambda target, value: {"target": target, "type": "number", "functions": [{"always_run": True, "math_operation": True, "value": value}]}
    fields = [one("part", "{l_extendedprice} * (1 - {l_discount}) / 8"), one("cubed", "({l_discount} + 1) ^ 3"), one("half", "{l_extendedprice} * {l_quantity} * 2 ^ -1 - 0.001")]
    return run(t("lineitem"), only("lineitem", "l_orderkey", "l_linenumber", *kinds), step("set_types", {"types": kinds}), step("boolean_add_computed_field", {"fields": fields}), only("lineitem", "l_orderkey", "l_linenumber", "part", "cubed", "half"))["lineitem"]


_BAD = {
    "text after the end": "{r_regionkey} == 1 rubbish",
    "unknown field": "{nowhere} == 1",
    "order of unlike types": "{r_name} > 5",
    "order by pattern": "{r_name} > re'x'",
    "pattern on a number": "{r_regionkey} == re'x'",
    "open parenthesis": "({r_regionkey} == 1",
    "half a comparison": "{r_regionkey} ==",
    "no such date": "{r_regionkey} == 2020-13-45",
}


@query(_refusals_sql([*_BAD, "math on text", "unfinished math"], ["equality of unlike types"]))
def expression_rules(t):
    def keep(s):
        return lambda: run(t("region"), step("boolean_filter_rows", {"boolean_statement": s}))

    def math(s):
        return lambda: run(t("region"), step("boolean_add_computed_field", {"fields": [{"target": "x", "type": "number", "functions": [{"always_run": True, "math_operation": True, "value": s}]}]}))

    return refusals({n: keep(s) for n, s in _BAD.items()} | {"math on text": math("{r_name} + 1"), "unfinished math": math("{r_regionkey} +"), "equality of unlike types": keep("{r_name} == 5")})


# --- descriptors and resources -------------------------------------------------------------------


@query("SELECT * FROM (VALUES ('package title', 'All'), ('resource region kind', 'area'), ('resource nation kind', NULL), ('names', 'region nation')) v(what, value)")
def update_descriptors(t):
    p = run(t("region"), t("nation"), step("update_package", {"title": "All"}), step("update_resource", {"resources": ["region"], "metadata": {"kind": "area"}}))
    rows = [("package title", p.meta["title"]), *[(f"resource {n} kind", p[n].descriptor.get("kind")) for n in p.names], ("names", " ".join(p.names))]
    return session().createDataFrame(rows, "what string, value string")


@query("SELECT * FROM (VALUES ('removed', 'nation'), ('renamed', 'area nation'), ('path', 'area.csv'), ('duplicated', 'region a b nation')) v(what, names)")
def resource_names(t):
    two = [t("region"), t("nation")]
    renamed = run(*two, step("rename_resource", {"old_resource": "region", "new_resource": "area"}))
    rows = [("removed", run(*two, step("remove_resources", {"resources": ["region"]})).names), ("renamed", renamed.names), ("path", [renamed["area"].descriptor["path"]])]
    rows.append(("duplicated", run(*two, step("duplicate", {"source": "region", "multi": True, "target_names": ["a", "b"]})).names))
    return session().createDataFrame([(k, " ".join(v)) for k, v in rows], "what string, names string")


@query("SELECT n_nationkey, n_name FROM nation")
def remove_resources(t):
    return run(t("region"), t("nation"), step("remove_resources", {"resources": "reg.*"}), only("nation", "n_nationkey", "n_name"))["nation"]


# --- joins ---------------------------------------------------------------------------------------


@query("SELECT n_nationkey, n_name, s_suppkey, s_name, n FROM nation LEFT JOIN (SELECT s_nationkey, max(s_suppkey) AS s_suppkey, max(s_name) AS s_name, count(*) AS n FROM supplier GROUP BY s_nationkey) ON s_nationkey = n_nationkey")
def join_star(t):
    """All fields of the source that aren't named otherwise, under one aggregate."""
    fields = {"*": {"aggregate": "max"}, "n": {"aggregate": "count"}}
    joined = step("join", {"source": {"name": "supplier", "key": ["s_nationkey"], "delete": True}, "target": {"name": "nation", "key": ["n_nationkey"]}, "fields": fields})
    return run(t("supplier"), t("nation"), joined, only("nation", "n_nationkey", "n_name", "s_suppkey", "s_name", "n"))["nation"]


@query("SELECT n_name, s FROM nation JOIN (SELECT s_nationkey, max_by(s_name, s_suppkey) AS s FROM supplier WHERE s_suppkey <= 20 GROUP BY s_nationkey) ON s_nationkey = n_nationkey UNION ALL SELECT n_name || '?', s FROM nation LEFT JOIN (SELECT s_nationkey, max_by(s_name, s_suppkey) AS s FROM supplier WHERE s_suppkey <= 20 GROUP BY s_nationkey) ON s_nationkey = n_nationkey")
def join_full_flag(t):
    def joined(full):
        few = step("boolean_filter_rows", {"resources": ["supplier"], "boolean_statement": "{s_suppkey} <= 20"})
        how = {"source": {"name": "supplier", "key": ["s_nationkey"]}, "target": {"name": "nation", "key": ["n_nationkey"]}, "fields": {"s": {"name": "s_name"}}, "full": full}
        return run(t("supplier"), few, t("nation"), step("join", how), only("nation", "n_name", "s"))["nation"].frame()

    return joined(False).unionByName(joined(True).withColumn("n_name", F.concat("n_name", F.lit("?"))))


_AGGREGATES = {"sum": "integer", "avg": "number", "median": "integer", "max": "integer", "min": "integer", "first": "integer", "last": "integer", "count": "integer", "any": "integer", "set": "array", "array": "array", "counters": "array"}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{k}', {'true' if a in ('median', 'first', 'last', 'any') else 'false'})" for a, k in _AGGREGATES.items()) + ") v(aggregate, type, keeps)")
def join_field_types(t):
    """Types of aggregates, and which of them keep the field's properties."""
    fields = {a: {"name": "s_suppkey", "aggregate": a} for a in _AGGREGATES}
    r = run(t("supplier"), step("update_fields", {"fields": {"s_suppkey": {"title": "Key"}}}), t("nation"), step("join", {"source": {"name": "supplier", "key": ["s_nationkey"]}, "target": {"name": "nation", "key": ["n_nationkey"]}, "fields": fields}))["nation"]
    rows = [(a, r.field(a)["type"], r.field(a).get("title") == "Key") for a in _AGGREGATES]
    return session().createDataFrame(rows, "aggregate string, type string, keeps boolean")


@query(_refusals_sql(["source after target", "no such source", "no such target", "no such field", "no such aggregate", "no such mode", "other type", "key lengths"], ["same type"]))
def join_rules(t):
    def joined(source="region", target="nation", fields=None, sk=("r_regionkey",), tk=("n_regionkey",), **more):
        how = {"source": {"name": source, "key": list(sk)}, "target": {"name": target, "key": list(tk)}, "fields": fields or {"r_name": None}} | more
        return lambda: run(t("region"), t("nation"), step("join", how))

    return refusals({
        "source after target": joined("nation", "region", {"n_name": None}, ("n_regionkey",), ("r_regionkey",)),
        "no such source": joined("none"),
        "no such target": joined(target="none"),
        "no such field": joined(fields={"x": {"name": "nothing"}}),
        "no such aggregate": joined(fields={"x": {"name": "r_name", "aggregate": "mode"}}),
        "no such mode": joined(mode="outer"),
        "other type": joined(fields={"n_name": {"name": "r_regionkey"}}),
        "key lengths": joined(tk=("n_regionkey", "n_name")),
        "same type": joined(fields={"n_name": {"name": "r_name"}}),
    })


# --- order, unions -------------------------------------------------------------------------------


def _places(r, key: str) -> DataFrame:
    return order.numbered(r).df.select(key, F.col(ROW_ID).alias("place"))


@query("SELECT s_suppkey, row_number() OVER (ORDER BY printf('%04d', s_nationkey), s_name DESC, s_suppkey) AS place FROM supplier")
def sort_formatted(t):
    r = run(t("supplier"), step("sort", {"sort-by": "s_name", "reverse": True}), step("sort", {"sort-by": "{s_nationkey:04d}"}))["supplier"]
    return _places(r, "s_suppkey")


@query("SELECT c_custkey, row_number() OVER (ORDER BY CASE WHEN x IS NULL THEN 1 WHEN x <= 0 THEN 0 ELSE 2 END, x, c_custkey) AS place FROM (SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END AS x FROM customer)")
def sort_nulls(t):
    """Nulls stand between the numbers up to zero and the positive ones."""
    known = {"target": "x", "type": "number", "functions": [{"boolean": "{c_mktsegment} != 'BUILDING'", "math_operation": True, "value": "{c_acctbal}"}]}
    r = run(t("customer"), step("boolean_add_computed_field", {"fields": [known]}), only("customer", "c_custkey", "x"), step("sort", {"sort-by": ["x"]}))["customer"]
    return _places(r, "c_custkey")


@query("SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS place FROM supplier")
def sort_by_function(t):
    """A function from the table to columns orders it; another one is a step."""
    def halved(package):
        return package.map(["supplier"], lambda r: r.put({"s_acctbal": F.col("s_acctbal") / 2}, {"s_acctbal": r.field("s_acctbal")}))

    r = run(t("supplier"), Flow(halved), step("sort", {"sort-by": lambda r: [-F.col("s_acctbal")]}))["supplier"]
    return _places(r, "s_suppkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25")
def limit_rows(t):
    return run(step("load", {"from": f"{t.sf_dir}/orders.parquet", "name": "orders", "order_by": "o_orderkey", "limit_rows": 25}), only("orders", "o_orderkey", "o_totalprice"))["orders"]


@query("SELECT r_name AS name, '' AS note FROM region WHERE r_name = 'ASIA'")
def concatenate_missing_values(t):
    """What counts as missing afterwards is what the step says: an empty text no longer does."""
    both = step("concatenate", {"fields": {"name": ["r_name", "n_name"], "note": ["n_note"]}, "missing_values": ["ASIA"]})
    noted = step("boolean_add_computed_field", {"resources": ["nation"], "fields": [{"target": "n_note", "type": "string", "functions": [{"always_run": True, "value": "x"}]}]})
    return run(t("region"), t("nation"), noted, both, step("boolean_filter_rows", {"boolean_statement": "{name} == NULL && {note} != NULL"}))["concat"]


@query(_refusals_sql(["no source matches", "target has no name", "target exists", "field mapped twice", "empty list without field", "listed field missing", "not consecutive", "no field mapped", "source column is mapped"]))
def concatenate_rules(t):
    def cat(**how):
        good = {"fields": {"name": ["r_name", "n_name"]}, "target": {"name": "all"}}
        return lambda: run(t("region"), t("nation"), t("supplier"), step("concatenate", good | {"sources": ["region", "nation"]} | how))

    return refusals({
        "no source matches": cat(sources=["none"]),
        "target has no name": cat(target={"name": ""}),
        "target exists": cat(target={"name": "supplier"}),
        "field mapped twice": cat(fields={"name": ["r_name"], "other": ["r_name"]}),
        "empty list without field": cat(fields={"name": ["r_name", "n_name"], "nothing": []}),
        "listed field missing": cat(fields={"name": ["r_name", "n_name", "q_name"]}),
        "not consecutive": cat(sources=["region", "supplier"], fields={"name": ["r_name", "s_name"]}),
        "no field mapped": cat(fields={"name": ["r_name"]}),
        "source column is mapped": cat(include_source_names=[{"type": "file", "column_name": "name"}]),
    })


# --- dates ---------------------------------------------------------------------------------------


def _dated(t, column, fields: list[dict]) -> DataFrame:
    r = run(t("orders"), only("orders", "o_orderkey"))["orders"]
    made = from_frame("orders", r.df.withColumn("x", column))
    return plain(run(made, step("convert_date", {"fields": fields}), step("delete_fields", {"fields": ["x"]}))["orders"])


@query("SELECT o_orderkey, TIMESTAMP '1996-01-01' + to_days(CAST(o_orderkey % 1000 AS INTEGER)) + to_hours(6) AS at FROM orders")
def convert_date_matlab(t):
    """Day 729025 is 1 January 1996."""
    return _dated(t, (729025.25 + F.col("o_orderkey") % 1000).cast("double"), [{"input_type": "matlab", "input_field": "x", "output_field": "at", "output_format": "%Y"}])


@query(
    "SELECT o_orderkey, make_timestamp(y, 1, 1, 0, 0, 0) + to_seconds(q * 21600 * d) - INTERVAL 1 DAY AS first, make_timestamp(y, 1, 1, 0, 0, 0) + to_seconds(q * 21600 * d) AS zeroth"
    " FROM (SELECT o_orderkey, 1990 + o_orderkey % 20 AS y, o_orderkey % 4 AS q, CASE WHEN (1990 + o_orderkey % 20) % 4 = 0 THEN 366 ELSE 365 END AS d FROM orders)"
)
def convert_date_decimal_year(t):
    x = (1990 + F.col("o_orderkey") % 20 + 0.25 * (F.col("o_orderkey") % 4)).cast("double")
    how = {"input_type": "decimalYear", "input_field": "x", "output_format": "%Y"}
    return _dated(t, x, [how | {"output_field": "first", "decimal_year_start_day": 1}, how | {"output_field": "zeroth", "decimal_year_start_day": "0"}])


@query(_refusals_sql(["no output field", "no output format", "unknown output type", "unknown input type", "no year", "no start day", "zone only out", "unknown directive"]))
def convert_date_rules(t):
    def one(**f):
        good = {"output_field": "d", "output_format": "%Y", "inputs": [{"field": "o_orderdate", "format": "%Y-%m-%d %H:%M:%S"}]}
        how = {k: v for k, v in (good | f).items() if v is not None}
        return lambda: run(t("orders"), step("convert_date", {"fields": [how]}))

    return refusals({
        "no output field": one(output_field=None),
        "no output format": one(output_format=None),
        "unknown output type": one(output_type="year"),
        "unknown input type": one(input_type="julian"),
        "no year": one(input_type="decimalDay", input_field="o_totalprice"),
        "no start day": one(input_type="decimalYear", input_field="o_totalprice"),
        "zone only out": one(output_timezone="UTC"),
        "unknown directive": one(inputs=[{"field": "o_orderdate", "format": "%Q"}]),
    })


# --- checks, own functions, streams --------------------------------------------------------------


@query("SELECT 'longitude-bounds' AS \"check\", 'customer' AS resource, i AS \"row\", 'c_custkey' AS field, 'Longitude c_custkey, row ' || i || ': not inside -180 and 180' AS message FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS i FROM customer) WHERE c_custkey >= 180")
def check_longitude(t):
    return checks.longitude_bounds(run(t("customer")), "c_custkey")


@query("SELECT * FROM (VALUES (1, 2, 'load', 1), (2, 2, 'boolean_filter_rows', 1)) v(number, of, name, tables)")
def progress_calls(t):
    told = []
    Flow(step("load", {"from": f"{t.sf_dir}/region.parquet", "name": "region"}), step("boolean_filter_rows", {"boolean_statement": "{r_regionkey} > 0"}), progress=lambda k, n, name, p: told.append((k, n, name, len(p.names)))).run()
    return session().createDataFrame(told, "number int, of int, name string, tables int")


@query("SELECT event_id, event_type || ':' || user_id AS label FROM events WHERE value > 10")
def stream_steps(t):
    """Steps on a stream, whose files are read until none is left."""
    spark, out, kept = session(), scratch.folder(session(), "stream"), scratch.folder(session(), "stream-state")
    steps = [
        {"run": "boolean_filter_rows", "parameters": {"boolean_statement": "{value} > 10"}},
        {"run": "string_format", "parameters": {"fields": [{"output_field": "label", "input_string": "{}:{}", "input_fields": ["event_type", "user_id"]}]}},
        {"run": "delete_fields", "parameters": {"fields": ["(?!event_id$|label$).*"]}},
    ]
    schema = spark.read.parquet(f"{t.sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{t.sf_dir}/events.parquet*")
    run_stream(stream, steps, out, kept).awaitTermination()
    return spark.read.parquet(out)


@query(_refusals_sql(["order", "row numbers", "other tables"], ["row-local steps"]))
def stream_rules(t):
    from tablewright.streaming import apply_steps

    spark = session()
    schema = spark.read.parquet(f"{t.sf_dir}/events.parquet").schema

    def on_stream(name, **parameters):
        return lambda: apply_steps(spark.readStream.schema(schema).parquet(f"{t.sf_dir}/events.parquet*"), [{"run": name, "parameters": parameters}])

    numbers = {"boolean_statement": "ROW_NUMBER > 3"}
    joined = {"source": {"name": "a", "key": ["b"]}, "target": {"name": "c", "key": ["d"]}}
    return refusals({"order": on_stream("sort", **{"sort-by": "value"}), "row numbers": on_stream("boolean_filter_rows", **numbers), "other tables": on_stream("join", **joined), "row-local steps": on_stream("rename_fields", fields=[{"old_field": "value", "new_field": "v"}])})
