"""The engine's own operators as queries over the test tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright import checks, scratch
from tablewright.package import Package, Resource, StepError, quoted
from tablewright.plans.pipeline import Flow, Step, step
from tablewright.schema import cast_resource
from tablewright.sinks import dump

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The key that orders each table's rows.
ORDER = {"orders": "o_orderkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "nation": "n_nationkey", "region": "r_regionkey", "events": "event_id", "documents": "doc_id", "labels": "doc_id", "pages": "page_id", "benchmark": "item_id"}
MONEY = {"type": "number", "decimal": [18, 2]}


class Tables:
    """Load steps for the tables of one folder."""

    def __init__(self, sf_dir: str):
        self.sf_dir = sf_dir

    def __call__(self, name: str, as_name: str | None = None) -> Step:
        return step("load", {"from": f"{self.sf_dir}/{name}.parquet", "format": "parquet", "name": as_name or name, "order_by": ORDER.get(name)})


def query(sql: str | None = None):
    """Register a function from Tables to a resource or a DataFrame under its own name."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(Tables(sf_dir))
            return plain(out) if isinstance(out, Resource) else out

        QUERIES[fn.__name__] = run
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


def plain(r: Resource) -> DataFrame:
    """A resource's rows; decimals as doubles, so that any engine's value is the same one."""
    r = cast_resource(r)
    cell = lambda n: quoted(n).cast("double") if isinstance(r.dtype(n), T.DecimalType) else quoted(n)
    return r.df.select(*[cell(n).alias(n) for n in r.names])


def run(*parts) -> Package:
    return Flow(*parts).run()


def only(table: str, *names: str) -> Step:
    """Keep some columns of a table; the others never leave the scan."""
    return step("delete_fields", {"resources": [table], "fields": [f"(?!(?:{'|'.join(names)})$).*"]})


# --- predicates ----------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE (o_totalprice > 100000 AND o_orderstatus <> 'F') OR (o_orderdate >= DATE '1997-06-01' AND o_orderpriority = '1-URGENT')")
def filter_bool(t):
    statement = "({o_totalprice} > 100000 && {o_orderstatus} != 'F') || ({o_orderdate} >= 1997-06-01 AND {o_orderpriority} == '1-URGENT')"
    return run(t("orders"), step("boolean_filter_rows", {"boolean_statement": statement}), only("orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"))["orders"]


@query("SELECT event_id, user_id, event_type, value FROM events WHERE event_type IS DISTINCT FROM 'view' AND value IS NOT NULL AND value <= 50 OR value IS NULL")
def filter_null_safe(t):
    statement = "{event_type} != 'view' AND {value} != NULL AND {value} <= 50 OR {value} == NULL"
    return run(t("events"), step("boolean_filter_rows", {"boolean_statement": statement}), only("events", "event_id", "user_id", "event_type", "value"))["events"]


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE regexp_matches(p_brand, '^(?:Brand#[12])') AND NOT coalesce(regexp_matches(p_type, '^(?:.*STEEL)'), false)")
def filter_regex_null(t):
    statement = "{p_brand} == re'Brand#[12]' && {p_type} != re'.*STEEL'"
    return run(t("part"), step("boolean_filter_rows", {"boolean_statement": statement}), only("part", "p_partkey", "p_name", "p_brand"))["part"]


@query("SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) WHERE rn > 10 AND rn <= 500 OR rn = 1000")
def filter_rownum(t):
    statement = "ROW_NUMBER > 10 && LINE_NUMBER <= 500 || ROW_NUMBER == 1000"
    return run(t("orders"), only("orders", "o_orderkey", "o_totalprice"), step("boolean_filter_rows", {"boolean_statement": statement}))["orders"]


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal < -10.5 OR c_acctbal == 0")
def filter_negative_number(t):
    return run(t("customer"), step("boolean_filter_rows", {"boolean_statement": "{c_acctbal} < -10.5 or {c_acctbal} == 0"}), only("customer", "c_custkey", "c_name"))["customer"]


# --- computed columns ----------------------------------------------------------------------------


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done-' || o_orderkey WHEN o_totalprice > 200000 THEN 'large' WHEN o_totalprice > 0 THEN 'small ' || o_orderpriority END AS label FROM orders")
def computed_case(t):
    functions = [{"boolean": "{o_totalprice} > 0", "value": "small {o_orderpriority}"}, {"boolean": "{o_totalprice} > 200000", "value": "large"}, {"boolean": "{o_orderstatus} == 'F'", "value": "done-{o_orderkey}"}]
    return run(t("orders"), step("boolean_add_computed_field", {"fields": [{"target": "label", "type": "string", "functions": functions}]}), only("orders", "o_orderkey", "label"))["orders"]


@query(
    "SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS net,"
    " CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2))) * 2 AS DOUBLE) AS twice FROM lineitem"
)
def computed_math(t):
    fields = [{"target": "net", "type": "number", "functions": [{"always_run": True, "math_operation": True, "value": "{l_extendedprice} * (1 - {l_discount})"}]}, {"target": "twice", "type": "number", "functions": [{"always_run": True, "math_operation": True, "value": "{net} * 2"}]}]
    return run(t("lineitem"), step("set_types", {"types": {"l_extendedprice": MONEY, "l_discount": MONEY}}), step("boolean_add_computed_field", {"fields": fields}), only("lineitem", "l_orderkey", "l_linenumber", "net", "twice"))["lineitem"]


@query("SELECT l_orderkey, l_linenumber, pow(l_quantity, 2) / 4 AS quarter FROM lineitem")
def computed_power(t):
    fields = [{"target": "quarter", "type": "number", "functions": [{"always_run": True, "math_operation": True, "value": "{l_quantity} ^ 2 / 4"}]}]
    return run(t("lineitem"), step("boolean_add_computed_field", {"fields": fields}), only("lineitem", "l_orderkey", "l_linenumber", "quarter"))["lineitem"]


@query("SELECT s_suppkey, CAST(s_nationkey + s_suppkey AS BIGINT) AS added, CAST(greatest(s_nationkey, s_suppkey) AS BIGINT) AS most, CAST(s_nationkey * s_suppkey AS BIGINT) AS times, s_name || '/' || s_nationkey AS joined, 'S' || s_suppkey || ':' || s_name AS shown, 7 AS seven FROM supplier")
def add_computed_field(t):
    two = ["s_nationkey", "s_suppkey"]
    fields = [{"operation": "sum", "target": "added", "source": two}, {"operation": "max", "target": "most", "source": two}, {"operation": "multiply", "target": "times", "source": two}]
    fields += [{"operation": "join", "target": "joined", "source": ["s_name", "s_nationkey"], "with": "/"}, {"operation": "format", "target": "shown", "with": "S{s_suppkey}:{s_name}"}, {"operation": "constant", "target": {"name": "seven", "type": "integer"}, "with": 7}]
    return run(t("supplier"), step("add_computed_field", {"fields": fields}), only("supplier", "s_suppkey", "added", "most", "times", "joined", "shown", "seven"))["supplier"]


# --- text ----------------------------------------------------------------------------------------


@query(r"SELECT p_partkey, regexp_replace(regexp_replace(p_type, '(\w+) (\w+)', '\2-\1', 'g'), 'E', '$e', 'g') AS p_type FROM part")
def find_replace(t):
    patterns = [{"find": r"(?P<first>\w+) (\w+)", "replace": r"\2-\g<first>"}, {"find": "E", "replace": "$e"}]
    return run(t("part"), step("find_replace", {"fields": [{"name": "p_type", "patterns": patterns}]}), only("part", "p_partkey", "p_type"))["part"]


@query("SELECT p_partkey, regexp_extract(p_name, '^([^ ]*)( ?)(.*)$', 1) || regexp_extract(p_name, '^([^ ]*)( ?)(.*)$', 2) || upper(regexp_extract(p_name, '^([^ ]*)( ?)(.*)$', 3)) AS p_name FROM part")
def find_replace_upper(t):
    patterns = [{"find": "^[^ ]* ?(.*)$", "replace": "", "replace_function": "uppercase"}]
    return run(t("part"), step("find_replace", {"fields": [{"name": "p_name", "patterns": patterns}]}), only("part", "p_partkey", "p_name"))["part"]


@query("SELECT c_custkey, regexp_extract(c_name, '^(.*)#(\\d+)$', 1) AS kind, regexp_extract(c_name, '^(.*)#(\\d+)$', 2) AS number, string_split(c_name, '#')[1] AS a, string_split(c_name, '#')[2] AS b FROM customer")
def split_column(t):
    fields = [{"input_field": "c_name", "output_fields": ["kind", "number"], "pattern": r"^(.*)#(\d+)$"}, {"input_field": "c_name", "output_fields": ["a", "b"], "delimiter": "#"}]
    return run(t("customer"), step("split_column", {"fields": fields, "delete_input": True}), only("customer", "c_custkey", "kind", "number", "a", "b"))["customer"]


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_brand, '^[0-9]*$') THEN p_brand END AS p_brand, CASE WHEN NOT regexp_matches(p_brand, '^[0-9]*$') THEN p_brand END AS p_brand_text FROM (SELECT p_partkey, replace(p_brand, 'Brand#1', '') AS p_brand FROM part)")
def extract_nonnumeric(t):
    return run(
        t("part"), step("find_replace", {"fields": [{"name": "p_brand", "patterns": [{"find": "Brand#1", "replace": ""}]}]}), step("extract_nonnumeric", {"fields": ["p_brand"], "suffix": "_text"}), only("part", "p_partkey", "p_brand", "p_brand_text")
    )["part"]


@query("SELECT n_nationkey, printf('%03d', n_nationkey) || '-' || n_name || ' (' || n_regionkey || ')' AS code FROM nation")
def string_format(t):
    fields = [{"output_field": "code", "input_string": "{0:03d}-{1} ({2})", "input_fields": ["n_nationkey", "n_name", "n_regionkey"]}]
    return run(t("nation"), step("string_format", {"fields": fields}), only("nation", "n_nationkey", "code"))["nation"]


# --- numbers -------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, CAST(round_even(CAST(l_extendedprice AS DECIMAL(18,2)), 1) AS DOUBLE) AS l_extendedprice, CAST(round_even(CAST(l_discount AS DECIMAL(18,2)), 1) AS DOUBLE) AS l_discount, CAST(l_quantity AS BIGINT) AS l_quantity FROM lineitem")
def round_half_even(t):
    fields = [{"name": "l_extendedprice", "digits": 1}, {"name": "l_discount", "digits": 1, "preserve_trailing_zeros": True}, {"name": "l_quantity", "digits": 0, "convert_to_integer": True}]
    return run(t("lineitem"), step("round_fields", {"fields": fields}), only("lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_quantity"))["lineitem"]


@query("SELECT l_orderkey, l_linenumber, l_quantity, CAST(CAST(l_quantity AS DECIMAL(18,2)) * 0.3048 AS DOUBLE) AS meters, CAST(CAST(l_tax AS DECIMAL(18,2)) * 1.60934 AS DOUBLE) AS l_tax FROM lineitem")
def convert_units(t):
    fields = [{"name": "l_quantity", "conversion": "feet_to_meter", "preserve_field": True, "new_field_name": "meters"}, {"name": "l_tax", "conversion": "mile_to_km"}]
    return run(t("lineitem"), step("convert_units", {"fields": fields}), only("lineitem", "l_orderkey", "l_linenumber", "l_quantity", "meters", "l_tax"))["lineitem"]


@query(
    "SELECT c_custkey, CAST((CASE WHEN c_nationkey % 2 = 1 THEN -1 ELSE 1 END) * (CAST(c_nationkey * 7 % 90 AS DOUBLE) + CAST(c_custkey % 60 AS DOUBLE) / 60) AS DOUBLE) AS lat FROM customer"
)
def decimal_degrees(t):
    text = {"target": "pos", "type": "string", "functions": [{"always_run": True, "value": "{deg}° {min}.0' N"}, {"boolean": "{odd} == 1", "value": "{deg}° {min}.0' S"}]}
    sources = F.col
    made = run(t("customer"), only("customer", "c_custkey", "c_nationkey"))["customer"]
    df = made.df.withColumns({"deg": sources("c_nationkey") * 7 % 90, "min": sources("c_custkey") % 60, "odd": sources("c_nationkey") % 2})
    from tablewright.package import from_frame

    fields = [{"input_field": "pos", "output_field": "lat", "format": "degrees-decimal_minutes", "pattern": r"(?P<degrees>\d+)° (?P<decimal_minutes>\d+\.\d+)' (?P<directional>[NS])"}]
    return run(from_frame("customer", df), step("boolean_add_computed_field", {"fields": [text]}), step("convert_to_decimal_degrees", {"fields": fields}), only("customer", "c_custkey", "lat"))["customer"]


# --- dates ---------------------------------------------------------------------------------------


@query("SELECT o_orderkey, strftime(o_orderdate, '%d %b %Y %H:%M') AS shown, CAST(o_orderdate AS DATE) AS day, strftime(o_orderdate, '%y/%j') AS short FROM orders")
def convert_date_text(t):
    text = {"inputs": [{"field": "o_orderdate", "format": "%Y-%m-%d %H:%M:%S"}]}
    fields = [text | {"output_field": "shown", "output_type": "string", "output_format": "%d %b %Y %H:%M"}, text | {"output_field": "day", "output_type": "date", "output_format": "%Y-%m-%d"}, text | {"output_field": "short", "output_type": "string", "output_format": "%y/%j"}]
    return run(t("orders"), step("convert_date", {"fields": fields}), only("orders", "o_orderkey", "shown", "day", "short"))["orders"]


@query("SELECT o_orderkey, TIMESTAMP '1899-12-30' + to_days(CAST(30000 + o_orderkey % 10000 AS INTEGER)) + to_hours(6) AS excel, TIMESTAMP '1996-01-01' + to_days(CAST(o_orderkey % 366 AS INTEGER)) + to_hours(12) AS day FROM orders")
def convert_date_numbers(t):
    made = run(t("orders"), only("orders", "o_orderkey"))["orders"]
    df = made.df.withColumns({"x": (30000 + F.col("o_orderkey") % 10000 + 0.25).cast("double"), "d": (F.col("o_orderkey") % 366 + 1.5).cast("decimal(10,2)")})
    from tablewright.package import from_frame

    fields = [{"input_type": "excel", "input_field": "x", "output_field": "excel", "output_format": "%Y"}, {"input_type": "decimalDay", "input_field": "d", "year": 1996, "output_field": "day", "output_format": "%Y"}]
    return run(from_frame("orders", df), step("convert_date", {"fields": fields}), only("orders", "o_orderkey", "excel", "day"))["orders"]


@query("SELECT o_orderkey, strftime(o_orderdate + INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S UTC') AS utc FROM orders")
def convert_date_zones(t):
    fields = [{"inputs": [{"field": "o_orderdate", "format": "%Y-%m-%d %H:%M:%S"}], "input_timezone": "EST", "output_timezone": "UTC", "output_field": "utc", "output_type": "string", "output_format": "%Y-%m-%d %H:%M:%S %Z"}]
    return run(t("orders"), step("convert_date", {"fields": fields}), only("orders", "o_orderkey", "utc"))["orders"]


@query("SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(user_id AS VARCHAR) AS user_id FROM events")
def set_types_dates(t):
    made = run(t("events"), only("events", "event_id", "ts", "user_id"), step("string_format", {"fields": [{"output_field": "day", "input_string": "{}", "input_fields": ["ts"]}]}))["events"]
    cut = step("find_replace", {"fields": [{"name": "day", "patterns": [{"find": r"^(\d{4})-(\d\d)-(\d\d).*", "replace": r"\3.\2.\1"}]}]})
    typed = step("set_types", {"types": {"day": {"type": "date", "format": "%d.%m.%Y"}, "user_.*": {"type": "string"}}})
    return run(made, cut, typed, step("string_format", {"fields": [{"output_field": "day", "input_string": "{}", "input_fields": ["day"]}]}), only("events", "event_id", "day", "user_id"))["events"]


# --- fields --------------------------------------------------------------------------------------


@query("SELECT r_name AS region_label, r_regionkey AS key FROM region")
def rename_fields(t):
    return run(t("region"), step("rename_fields", {"fields": [{"old_field": "r_regionkey", "new_field": "key"}, {"old_field": "r_name", "new_field": "region_label"}]}), step("reorder_fields", {"fields": ["region_label", "key"]}))["region"]


@query("SELECT n_nationkey AS nation_nationkey, n_name AS nation_name FROM nation")
def rename_fields_regex(t):
    return run(t("nation"), step("delete_fields", {"fields": ["n_region.*"]}), step("rename_fields_regex", {"fields": ["n_nationkey", "n_name"], "pattern": {"find": "^n_(.*)$", "replace": r"nation_\1"}}))["nation"]


@query("SELECT 'r_name' AS field, 'Region' AS title, 'kept' AS note UNION ALL SELECT 'r_regionkey', NULL, 'kept'")
def field_metadata(t):
    r = run(t("region"), step("update_fields", {"fields": {"r_name": {"title": "Region"}}}), step("add_schema_metadata", {"note": "kept"}), step("rename_resource", {"old_resource": "region", "new_resource": "area"}))["area"]
    return r.df.sparkSession.createDataFrame([(f["name"], f.get("title"), r.schema_props["note"]) for f in r.fields], "field string, title string, note string")


# --- joins and aggregates ------------------------------------------------------------------------

_TOTALS = {"n": {"aggregate": "count"}, "total": {"name": "o_totalprice", "aggregate": "sum"}, "top": {"name": "o_totalprice", "aggregate": "max"}}
_PER_CUSTOMER = "(SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, max(o_totalprice) AS top FROM orders GROUP BY o_custkey)"


def _orders_to_customers(t, mode: str, *before) -> Resource:
    money = step("set_types", {"resources": ["orders"], "types": {"o_totalprice": MONEY}})
    joined = step("join", {"source": {"name": "orders", "key": ["o_custkey"], "delete": True}, "target": {"name": "customer", "key": ["c_custkey"]}, "fields": _TOTALS, "mode": mode})
    return run(t("orders"), t("customer"), *before, money, joined, only("customer", "c_custkey", "c_name", "n", "total", "top"))["customer"]


@query(f"SELECT c_custkey, c_name, n, total, top FROM customer JOIN {_PER_CUSTOMER} ON o_custkey = c_custkey")
def join_inner(t):
    return _orders_to_customers(t, "inner")


@query(f"SELECT c_custkey, c_name, n, total, top FROM customer LEFT JOIN {_PER_CUSTOMER} ON o_custkey = c_custkey")
def join_half_outer(t):
    return _orders_to_customers(t, "half-outer")


@query(f"SELECT coalesce(c_custkey, o_custkey) AS c_custkey, c_name, n, total, top FROM (SELECT * FROM customer WHERE c_acctbal > 5000) FULL JOIN {_PER_CUSTOMER} ON o_custkey = c_custkey")
def join_full_outer(t):
    return _orders_to_customers(t, "full-outer", step("boolean_filter_rows", {"resources": ["customer"], "boolean_statement": "{c_acctbal} > 5000"}))


@query("SELECT n_name, r_name FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) LEFT JOIN (SELECT *, row_number() OVER (ORDER BY r_regionkey) AS j FROM region) ON i = j")
def join_rownum(t):
    return run(t("region"), t("nation"), step("join", {"source": {"name": "region", "key": "{#}"}, "target": {"name": "nation", "key": "{#}"}, "fields": {"r_name": {}}}), only("nation", "n_name", "r_name"))["nation"]


@query("SELECT s_suppkey, c_name FROM supplier LEFT JOIN (SELECT c_nationkey, max_by(c_name, c_custkey) AS c_name FROM customer GROUP BY c_nationkey) ON c_nationkey = s_nationkey")
def join_template_key(t):
    return run(t("customer"), t("supplier"), step("join", {"source": {"name": "customer", "key": "N-{c_nationkey}"}, "target": {"name": "supplier", "key": "N-{s_nationkey}"}, "fields": {"c_name": None}}), only("supplier", "s_suppkey", "c_name"))["supplier"]


@query("SELECT o_orderstatus AS status, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY o_orderstatus")
def join_deduplicate(t):
    fields = {"status": {"name": "o_orderstatus"}, "n": {"aggregate": "count"}, "total": {"name": "o_totalprice", "aggregate": "sum"}}
    return run(t("orders"), step("set_types", {"types": {"o_totalprice": MONEY}}), step("join", {"source": {"name": "orders", "key": ["o_orderstatus"], "delete": True}, "target": {"name": "orders", "key": None}, "fields": fields}))["orders"]


def _per_user(t, fields: dict) -> Resource:
    return run(t("events"), step("set_types", {"types": {"value": MONEY}}), step("join", {"source": {"name": "events", "key": ["user_id"], "delete": True}, "target": {"name": "events", "key": None}, "fields": {"user": {"name": "user_id"}} | fields}))["events"]


@query("SELECT user_id AS \"user\", first(event_type ORDER BY event_id) AS f, last(event_type ORDER BY event_id) AS l, last(event_type ORDER BY event_id) AS a, CAST(avg(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS m, min(value) AS lo FROM events GROUP BY user_id")
def agg_first_last_any(t):
    r = _per_user(t, {"f": {"name": "event_type", "aggregate": "first"}, "l": {"name": "event_type", "aggregate": "last"}, "a": {"name": "event_type", "aggregate": "any"}, "m": {"name": "value", "aggregate": "avg"}, "lo": {"name": "value", "aggregate": "min"}})
    return plain(r).withColumn("m", F.round("m", 6))


ORACLE_SQL["agg_first_last_any"] = ORACLE_SQL["agg_first_last_any"].replace("CAST(avg(CAST(value AS DECIMAL(18,2))) AS DOUBLE)", "round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(value), 6)")


@query("SELECT user_id AS \"user\", round(median(value), 4) AS mid, count(*) AS n FROM events GROUP BY user_id")
def agg_median(t):
    return plain(_per_user(t, {"mid": {"name": "value", "aggregate": "median"}, "n": {"aggregate": "count"}})).withColumn("mid", F.round("mid", 4))


@query(
    "SELECT user_id AS \"user\", array_to_string(list_sort(list(DISTINCT event_type)), '|') AS kinds, array_to_string(list(event_type ORDER BY event_id), '|') AS path,"
    " (SELECT array_to_string(list(k || '=' || c ORDER BY c DESC, f), '|') FROM (SELECT event_type AS k, count(*) AS c, min(event_id) AS f FROM events e WHERE e.user_id = u.user_id GROUP BY event_type)) AS counts"
    " FROM events u GROUP BY user_id"
)
def agg_set_array_counters(t):
    r = _per_user(t, {"kinds": {"name": "event_type", "aggregate": "set"}, "path": {"name": "event_type", "aggregate": "array"}, "counts": {"name": "event_type", "aggregate": "counters"}})
    counts = F.array_join(F.transform("counts", lambda c: F.concat(c["value"], F.lit("="), c["count"].cast("string"))), "|")
    return r.frame().select("user", F.array_join("kinds", "|").alias("kinds"), F.array_join("path", "|").alias("path"), counts.alias("counts"))


# --- order, unions, reshaping --------------------------------------------------------------------


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_totalprice, o_orderkey) AS place FROM orders")
def sort_rank(t):
    from tablewright import order
    from tablewright.package import ROW_ID

    r = order.numbered(run(t("orders"), only("orders", "o_orderkey", "o_orderpriority", "o_totalprice"), step("sort", {"sort-by": "{o_orderpriority}{o_totalprice}"}))["orders"])
    return r.df.select("o_orderkey", F.col(ROW_ID).alias("place"))


@query("SELECT s_suppkey, row_number() OVER (ORDER BY s_nationkey DESC, s_suppkey DESC) AS place FROM supplier")
def sort_reverse(t):
    from tablewright import order
    from tablewright.package import ROW_ID

    r = order.numbered(run(t("supplier"), step("sort", {"sort-by": "s_nationkey", "reverse": True}))["supplier"])
    return r.df.select("s_suppkey", F.col(ROW_ID).alias("place"))


@query("SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, 'customer' AS origin FROM customer UNION ALL SELECT s_name, s_acctbal, '', 'supplier' FROM supplier")
def concatenate(t):
    fields = {"name": ["c_name", "s_name"], "balance": ["c_acctbal", "s_acctbal"], "segment": ["c_mktsegment"]}
    return run(t("customer"), t("supplier"), step("concatenate", {"target": {"name": "parties"}, "fields": fields, "include_source_names": [{"type": "resource", "column_name": "origin"}]}))["parties"]


@query("SELECT doc_id, what, mark FROM (UNPIVOT labels ON quality, toxic INTO NAME what VALUE mark)")
def unpivot(t):
    return run(
        t("labels"), step("unpivot", {"unpivot": [{"name": "(quality|toxic)", "keys": {"what": r"\1"}}], "extraKeyFields": [{"name": "what", "type": "string"}], "extraValueField": {"name": "mark", "type": "integer"}})
    )["labels"]


@query("SELECT * FROM (SELECT n_nationkey, CASE WHEN n_nationkey = 2 THEN 'edited' ELSE n_name END AS n_name, n_regionkey FROM nation) UNION ALL SELECT n_nationkey, CASE WHEN n_nationkey = 2 THEN 'edited' ELSE n_name END, n_regionkey FROM nation")
def edit_and_duplicate(t):
    p = run(t("nation"), step("edit_cells", {"edited": {"3": [{"field": "n_name", "value": "edited"}]}}), step("duplicate", {"source": "nation", "target-name": "again"}))
    return p["nation"].frame().unionByName(p["again"].frame())


@query("SELECT DISTINCT CAST(quality AS VARCHAR) AS latitude, CAST(toxic AS VARCHAR) AS longitude FROM labels")
def unique_lat_lon(t):
    mark = lambda n: {"place:": {"standard_name_id": n, "is_primary": True}}
    r = run(t("labels"), step("update_fields", {"fields": {"quality": mark("730"), "toxic": mark("731")}}))["labels"]
    return dump.unique_lat_lon(r).frame()


# --- sources and sinks ---------------------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    return scratch.folder(spark, "dump")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier")
def dump_and_load_csv(t):
    spark = SparkSession.getActiveSession()
    at = _folder(spark)
    run(t("supplier"), only("supplier", "s_suppkey", "s_name", "s_nationkey"), step("dump_to_path", {"out-path": at}))
    return run(step("load", {"from": f"{at}/supplier.csv", "name": "supplier"}))["supplier"]


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def dump_and_load_json(t):
    spark = SparkSession.getActiveSession()
    at = _folder(spark)
    run(t("nation"), step("dump_to_path", {"out-path": at, "format": "json"}))
    kinds = {"n_nationkey": {"type": "integer"}, "n_regionkey": {"type": "integer"}}
    return run(step("load", {"from": f"{at}/nation.json", "name": "nation"}), step("set_types", {"types": kinds}))["nation"].frame()


ORACLE_SQL["dump_and_load_json"] = "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation"


@query("SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name FROM region")
def load_regex_csv(t):
    spark = SparkSession.getActiveSession()
    at = _folder(spark)
    run(t("region"), step("dump_to_path", {"out-path": at}))
    return run(step("load", {"from": f"{at}/region.csv", "name": "region", "format": "regex-csv", "delimiter": r"\s*,\s*"}), step("find_replace", {"fields": [{"name": "r_name", "patterns": [{"find": r"\s+$", "replace": ""}]}]}))["region"]


# --- checks --------------------------------------------------------------------------------------


@query("SELECT 'header-name-invalid' AS \"check\", 'nation' AS resource, CAST(NULL AS BIGINT) AS \"row\", n AS field, m AS message FROM (VALUES ('2nd', 'The name of column 2 begins with a digit'), ('_a b', 'The name of column 1 begins with an underscore'), ('_a b', 'The name of column 1 holds other than letters, digits and underscores')) v(n, m)")
def check_headers(t):
    names = step("rename_fields", {"fields": [{"old_field": "n_nationkey", "new_field": "_a b"}, {"old_field": "n_name", "new_field": "2nd"}]})
    return checks.header_name_invalid(run(t("nation"), names))


@query("SELECT 'latitude-bounds' AS \"check\", 'customer' AS resource, i AS \"row\", 'c_custkey' AS field, 'Latitude c_custkey, row ' || i || ': not inside -90 and 90' AS message FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS i FROM customer) WHERE c_custkey >= 90")
def check_latitude(t):
    return checks.latitude_bounds(run(t("customer")), "c_custkey")


@query(
    "SELECT CASE WHEN c IN (133, 160) THEN 'non-standard-whitespace-character' ELSE 'non-standard-character' END AS \"check\", \"row\", 'text' AS field FROM"
    " (SELECT row_number() OVER (ORDER BY doc_id) AS \"row\", unicode(regexp_extract(text, '[^\\x{0}-\\x{80}]')) AS c, regexp_extract(text, '[^\\x{0}-\\x{80}]') AS ch FROM documents) WHERE ch <> ''"
)
def check_characters(t):
    return checks.non_standard_character(run(t("documents"), only("documents", "doc_id", "text"))).select("check", "row", "field")


# --- whole pipelines -----------------------------------------------------------------------------


@query(
    "SELECT c_custkey, c_name, coalesce(n, 0) AS n, total, top FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, max(o_totalprice) AS top FROM orders"
    " WHERE o_totalprice > 100000 AND o_orderstatus <> 'F' GROUP BY o_custkey) ON o_custkey = c_custkey"
)
def customer_orders(t):
    money = step("set_types", {"resources": ["orders"], "types": {"o_totalprice": MONEY}})
    keep = step("boolean_filter_rows", {"resources": ["orders"], "boolean_statement": "{o_totalprice} > 100000 && {o_orderstatus} != 'F'"})
    joined = step("join", {"source": {"name": "orders", "key": ["o_custkey"], "delete": True}, "target": {"name": "customer", "key": ["c_custkey"]}, "fields": _TOTALS})
    r = run(t("orders"), t("customer"), keep, money, joined, only("customer", "c_custkey", "c_name", "n", "total", "top"))["customer"]
    return plain(r).withColumn("n", F.coalesce("n", F.lit(0)))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["customer_orders"](spark, sf_dir)


__all__ = ["ORACLE_SQL", "QUERIES", "StepError", "flagship"]

# the rest of the catalog registers itself
from tablewright import catalog_files, catalog_rules  # noqa: E402, F401
