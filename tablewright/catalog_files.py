"""Queries over sources and sinks: tables are written in a format, or as a file of it, and read back."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright import samples, scratch
from tablewright.catalog import ORACLE_SQL, Tables, only, query, run
from tablewright.package import StepError, quoted
from tablewright.plans.pipeline import step
from tablewright.sinks import dump
from tablewright.sources import load as sources


def session() -> SparkSession:
    return SparkSession.getActiveSession()


def folder(label: str = "files") -> str:
    return scratch.folder(session(), label)


def put(name: str, content: str | bytes) -> str:
    """A small file with that content."""
    path = f"{folder()}/{name}"
    dump.write_text(session(), path, content)
    return path


def put_lines(name: str, df: DataFrame, key: str, line: Column, head: str = "", tail: str = "") -> str:
    """A file with a line for each row, in order of ``key``; rows are written by executors."""
    parts, path = folder("lines"), f"{folder()}/{name}"
    df.orderBy(key).select(line.alias("value")).write.text(parts, lineSep="\n")
    dump.merge(session(), parts, path, head, tail, 0)
    return path


def table(t: Tables, name: str) -> DataFrame:
    return session().read.parquet(f"{t.sf_dir}/{name}.parquet")


def lines_of(path: str) -> DataFrame:
    return session().read.text(path).select(F.col("value").alias("line"))


def dumped(t: Tables, *names: str, **options) -> str:
    """A folder with those tables as text files."""
    at = folder("dump")
    run(*[t(n) for n in names], step("dump_to_path", {"out-path": at} | options))
    return at


_DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def database(df: DataFrame, name: str, columns: str) -> str:
    """The URL of a database that holds those rows as a table, for the driver and every executor.

    An embedded database is open in one process only, unless it lies in a jar and is read there.
    Executors write the rows as text, the database takes them in on the driver's disk, and Spark
    hands its jar to all executors, later ones too.
    """
    jvm, label, at, parts = session()._jvm, f"db{uuid.uuid4().hex}", Path(tempfile.mkdtemp(prefix="tablewright-")), folder("rows")
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    cell = lambda n: F.concat(F.lit('"'), F.replace(quoted(n).cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))
    df.select(F.concat_ws(",", *[F.coalesce(cell(n), F.lit("")) for n in df.columns]).alias("value")).write.text(parts, lineSep="\n")
    where, fs = scratch.file_system(session(), parts)
    fs.copyToLocalFile(False, where, jvm.org.apache.hadoop.fs.Path(f"file://{at}/rows"), True)
    jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    connect = lambda what: jvm.org.apache.derby.iapi.jdbc.AutoloadedDriver().connect(f"jdbc:derby:{at}/{label};{what}=true", jvm.java.util.Properties())
    db = connect("create")
    db.createStatement().execute(f"CREATE TABLE {name} ({columns})")
    for part in sorted((at / "rows").glob("part-*")):
        db.createStatement().execute(f"CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, '{name.upper()}', '{part}', NULL, NULL, 'UTF-8', 0)")
    db.close()
    try:
        connect("shutdown")
    except Py4JJavaError as e:  # Derby reports the end by an error
        if e.java_exception.getSQLState() != "08006":
            raise
    with zipfile.ZipFile(at / f"{label}.jar", "w") as z:
        for path in sorted(p for p in (at / label).rglob("*") if p.is_file()):
            z.write(path, path.relative_to(at))
    shutil.rmtree(at / "rows")
    shutil.rmtree(at / label)
    scratch.delete(session(), parts)
    session().sql(f"ADD JAR '{at}/{label}.jar'")
    return f"jdbc:derby:classpath:{label}"


# --- several sources -----------------------------------------------------------------------------

_NAMES = {"name": ["r_name", "n_name"]}
_ORIGINS = [{"type": "resource", "column_name": "origin"}, {"type": "file", "column_name": "file"}]


@query("SELECT r_name AS name, 'areas' AS origin, 'region.csv' AS file FROM region UNION ALL SELECT n_name, 'countries', 'nation.csv' FROM nation")
def load_several(t):
    at = dumped(t, "region", "nation")
    both = step("load", {"from": f"{at}/region.csv;{at}/nation.csv", "input_separator": ";", "name": "areas;countries"})
    return run(both, step("concatenate", {"fields": _NAMES, "include_source_names": _ORIGINS}))["concat"]


@query("SELECT n_name AS name, 'nation' AS origin, 'nation.csv' AS file FROM nation UNION ALL SELECT r_name, 'region', 'region.csv' FROM region")
def load_glob(t):
    at = dumped(t, "region", "nation")
    return run(step("load", {"from": f"{at}/*.csv", "input_path_pattern": True, "use_filename": True}), step("concatenate", {"fields": _NAMES, "include_source_names": _ORIGINS}))["concat"]


@query("SELECT * FROM (VALUES ('r-1'), ('r-2'), ('one_file'), ('one_file_2')) v(name)")
def load_names(t):
    at = folder()
    for sub in ("a", "b"):
        dump.write_text(session(), f"{at}/{sub}/One File.csv", "x\n1\n")
    both = [f"{at}/a/One File.csv", f"{at}/b/One File.csv"]
    names = run(step("load", {"from": both, "name": "r"})).names + run(step("load", {"from": both, "use_filename": True})).names
    return session().createDataFrame([(n,) for n in names], "name string")


def _sheets(t: Tables) -> samples.Cells:
    """The nations of two regions, a sheet for each, and a third sheet."""
    rows = sorted(tuple(r) for r in table(t, "nation").select("n_regionkey", "n_nationkey", "n_name").collect())
    head = ["n_nationkey", "n_name"]
    part = lambda k: [head, *[[int(n), name] for region, n, name in rows if region == k]]
    return {"Nations a": part(0), "Nations b": part(1), "Other": [["q"], [0.5], [None], ["text"]]}


_SHEETS_SQL = "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name, CASE n_regionkey WHEN 0 THEN '{}' ELSE '{}' END AS origin FROM nation WHERE n_regionkey IN (0, 1)"
_SHEETS_STEP = step("concatenate", {"fields": {"key": ["n_nationkey"], "n_name": []}, "include_source_names": _ORIGINS[:1]})


@query(_SHEETS_SQL.format("nations_a", "nations_b"))
def load_sheets_by_pattern(t):
    path = put("book.xlsx", samples.xlsx(_sheets(t)))
    return run(step("load", {"from": path, "sheet": "Nations .*", "sheet_regex": True}), _SHEETS_STEP)["concat"]


@query(_SHEETS_SQL.format("1", "2"))
def load_sheets_by_range(t):
    path = put("book.xls", samples.xls(_sheets(t)))
    return run(step("load", {"from": path, "sheet": "1-2", "sheet_separator": ","}), _SHEETS_STEP)["concat"]


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def load_excel_xml(t):
    path = put("book.xml", samples.excel_xml(_sheets(t)))
    return run(step("load", {"from": path, "format": "excel-xml", "sheet": "Nations b", "name": "b"}))["b"]


@query("SELECT '0.5' AS q UNION ALL SELECT 'text'")
def load_sheet_cells(t):
    path = put("book.xlsx", samples.xlsx(_sheets(t)))
    return run(step("load", {"from": path, "sheet": 3, "name": "other"}))["other"]


@query("SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name, 'Area' AS title, CASE WHEN r_name = 'ASIA' THEN 'ASIA' END AS gone FROM region")
def load_multiple(t):
    at = dumped(t, "region", "nation")
    how = {"load_sources": [f"{at}/nation.csv", f"{at}/region.csv"], "names": ["b", "a"], "missing_values": ["", "ASIA"], "override_fields": {"r_name": {"title": "Area"}}, "extract_missing_values": True}
    r = run(step("standard_load_multiple", how))["a"]
    return r.frame().select("r_regionkey", "r_name", F.lit(r.field("r_name")["title"]).alias("title"), F.element_at("missingValues", "r_name").alias("gone"))


@query("SELECT CAST(r_regionkey AS BIGINT) AS k, r_name AS v FROM region")
def load_iterators(t):
    rows = [{"k": r[0], "v": r[1]} for r in table(t, "region").select("r_regionkey", "r_name").collect()]
    fields = [{"name": "k", "type": "integer"}, {"name": "v", "type": "string"}]
    descriptor = {"resources": [{"name": "left", "schema": {"fields": fields}}, {"name": "right", "schema": {"fields": fields}}]}
    p = run(step("standard_load_multiple", {"load_sources": [(descriptor, [iter([]), iter(rows)])], "resources": "righ."}))
    assert p.names == ["right"]
    return p["right"]


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def load_package(t):
    at = dumped(t, "region", "nation")
    return run(step("standard_load_multiple", {"load_sources": [f"{at}/datapackage.json"], "resources": ["nation"]}))["nation"]


ORACLE_SQL["load_package"] = "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation"

# --- text formats --------------------------------------------------------------------------------


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name FROM supplier WHERE s_suppkey % 7 <> 0")
def load_without_empty_rows(t):
    line = F.when(F.col("s_suppkey") % 7 == 0, ",").otherwise(F.concat_ws(",", "s_suppkey", "s_name"))
    return run(step("load", {"from": put_lines("s.csv", table(t, "supplier"), "s_suppkey", line, "s_suppkey,s_name\n"), "name": "s"}))["s"]


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name FROM supplier WHERE s_suppkey < 5 OR s_suppkey = 6")
def load_until_empty_rows(t):
    """Reading ends where so many rows in a row are empty."""
    line = F.when((F.col("s_suppkey") == 5) | F.col("s_suppkey").between(7, 9), ",").otherwise(F.concat_ws(",", "s_suppkey", "s_name"))
    return run(step("load", {"from": put_lines("e.csv", table(t, "supplier"), "s_suppkey", line, "s_suppkey,s_name\n"), "name": "e", "stop_after_empty_rows": 3}))["e"]


@query("SELECT CAST(s_suppkey AS VARCHAR) AS \"id key\", s_name || chr(10) || 'next' AS \"name\" FROM supplier")
def load_quoted_lines(t):
    """Cells that hold line feeds, and a header of two rows in another file."""
    line = F.concat(F.col("s_suppkey"), F.lit(',"'), F.col("s_name"), F.lit('\nnext"'))
    return run(step("load", {"from": put_lines("q.csv", table(t, "supplier"), "s_suppkey", line, "id key,name\n"), "name": "q"}))["q"]


@query("SELECT CAST(s_suppkey AS VARCHAR) AS \"id;key\", s_name AS \"name;full\" FROM supplier")
def load_header_rows(t):
    path = put_lines("h.csv", table(t, "supplier"), "s_suppkey", F.concat_ws(",", "s_suppkey", "s_name"), "# made by hand\nid,name\nkey,full\n")
    return run(step("load", {"from": path, "name": "h", "headers": [1, 2], "multiline_headers_joiner": ";", "skip_rows": ["#"]}))["h"]


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier")
def load_split_csv(t):
    """A file without quoted line feeds, split among tasks however small it is."""
    path = put_lines("p.csv", table(t, "supplier"), "s_suppkey", F.concat_ws(",", "s_suppkey", "s_name", "s_nationkey"), "s_suppkey,s_name,s_nationkey\n")
    return run(step("load", {"from": path, "name": "p", "multiline": False}))["p"]


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier")
def load_fixed_width(t):
    line = F.concat(F.rpad(F.col("s_suppkey").cast("string"), 9, " "), F.rpad("s_name", 30, " "), F.lpad(F.col("s_nationkey").cast("string"), 11, " "))
    head = "s_suppkey".ljust(9) + "s_name".ljust(30) + "s_nationkey".rjust(11) + "\n"
    return run(step("load", {"from": put_lines("w.txt", table(t, "supplier"), "s_suppkey", line, head), "name": "w", "format": "fixedwidth", "width": [9, 30, 11]}))["w"]


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CASE WHEN s_suppkey % 2 = 0 THEN 'nan' ELSE CAST(s_nationkey AS VARCHAR) END AS nation FROM supplier")
def load_inferred_width(t):
    """Widths from the first rows; blank cells read as nan."""
    last = F.when(F.col("s_suppkey") % 2 == 0, "").otherwise(F.col("s_nationkey").cast("string"))
    line = F.concat(F.lpad(F.col("s_suppkey").cast("string"), 9, " "), F.lit(" "), F.rpad("s_name", 30, " "), F.lit(" "), F.rpad(last, 6, " "))
    head = "s_suppkey".rjust(9) + " " + "s_name".ljust(30) + " nation\n"
    return run(step("load", {"from": put_lines("i.txt", table(t, "supplier"), "s_suppkey", line, head), "name": "i", "format": "any-fixedwidth", "infer": True}))["i"]


_CNV_HEAD = "* Instrument 9\n** station one\n** station two\n# name 0 = prDM: Pressure [db]\n# name 1 = user: User: its number [1]\n# start_time = Apr 27 2020\n*END*\n"
_CNV = {"name": "c", "format": "fixedwidth", "infer": True, "parse_seabird_header": True, "skip_rows": ["#", "*"], "deduplicate_headers": True}


def _cnv(t: Tables) -> str:
    pad = lambda c: F.lpad(F.col(c).cast("string"), 11, " ")
    return put_lines("cast.cnv", table(t, "events"), "event_id", F.concat(pad("event_id"), pad("user_id")), _CNV_HEAD)


@query('SELECT CAST(event_id AS VARCHAR) AS "prDM", CAST(user_id AS VARCHAR) AS "user: User" FROM events')
def load_seabird(t):
    return run(step("load", {"from": _cnv(t)} | _CNV))["c"]


@query('SELECT CAST(event_id AS VARCHAR) AS "prDM", \'one;two\' AS station, \'Apr 27 2020\' AS "start" FROM events')
def load_seabird_captured(t):
    rules = [{"column_name": "station", "regex": r"\*\* station (.*)"}, {"column_name": "start", "regex": "# start_time = (.*)"}]
    r = run(step("load", {"from": _cnv(t), "seabird_capture_skipped_rows": rules} | _CNV), step("delete_fields", {"fields": ["user.*"]}))["c"]
    return r


@query('SELECT CAST(event_id AS VARCHAR) AS "prDM", \'one\' AS "station (1)", \'two\' AS "station (2)" FROM events')
def load_seabird_columns(t):
    rules = [{"column_name": "station", "regex": r"\*\* station (.*)"}]
    return run(step("load", {"from": _cnv(t), "seabird_capture_skipped_rows": rules, "seabird_capture_skipped_rows_join": False} | _CNV), step("delete_fields", {"fields": ["user.*"]}))["c"]


@query("SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, '316N' AS expo FROM supplier")
def load_regex_captured(t):
    path = put_lines("r.txt", table(t, "supplier"), "s_suppkey", F.concat_ws("   ", "s_suppkey", "s_name"), "** EXPO 316N\nid name\n")
    how = {"format": "regex-csv", "delimiter": r"\s+", "skip_rows": ["*"], "capture_skipped_rows": [{"column_name": "expo", "regex": r"\*\* EXPO (.*)"}]}
    return run(step("load", {"from": path, "name": "r"} | how))["r"]


@query("SELECT CAST(r_regionkey AS VARCHAR) AS k, r_name AS v FROM region")
def load_xml(t):
    line = F.concat(F.lit("<row><k>"), F.col("r_regionkey"), F.lit("</k><v>"), F.col("r_name"), F.lit("</v></row>"))
    return run(step("load", {"from": put_lines("x.xml", table(t, "region"), "r_regionkey", line, "<rows>\n", "</rows>\n"), "name": "x"}))["x"]


@query("SELECT n_nationkey, n_name FROM nation")
def load_database(t):
    """A table of a database, read by several executors at once."""
    url = database(table(t, "nation").select("n_nationkey", "n_name"), "nations", '"n_nationkey" INTEGER, "n_name" VARCHAR(32672)')
    how = {"driver": _DERBY, "partitionColumn": "n_nationkey", "lowerBound": 0, "upperBound": 25, "numPartitions": 3}
    return run(step("load", {"from": url, "format": "sql", "table": "nations", "name": "n", "order_by": "n_nationkey", "jdbc": how}))["n"].frame()


@query("SELECT CAST(r_regionkey AS VARCHAR) AS k, r_name || 'é' AS v FROM region ORDER BY r_regionkey LIMIT 3")
def load_encoded_and_limited(t):
    """An own scheme that stands for a path, a file that isn't UTF-8, and a bound on rows."""
    rows = sorted(tuple(r) for r in table(t, "region").select("r_regionkey", "r_name").collect())
    path = put("latin.csv", ("k,v\n" + "".join(f"{k},{v}é\n" for k, v in rows)).encode("latin-1"))
    sources.LOADERS["mine"] = lambda _: path
    try:
        return run(step("load", {"from": "mine://anywhere.csv", "name": "r", "limit_rows": 3}))["r"]
    finally:
        del sources.LOADERS["mine"]


@query("SELECT r_name AS k, CAST(r_regionkey AS VARCHAR) AS v FROM region")
def load_by_own_parser(t):
    path = put_lines("own.kv", table(t, "region"), "r_regionkey", F.concat_ws("=", "r_name", "r_regionkey"))

    def pairs(spark, path, options):
        cut = F.split("value", options["mark"])
        return spark.read.text(path).select(cut[0].alias("k"), cut[1].alias("v"))

    return run(step("load", {"from": path, "format": "pairs", "mark": "=", "custom_parsers": {"pairs": pairs}, "name": "kv"}))["kv"]


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(0.5 AS DOUBLE), 'x', true), (2, NULL, NULL, false)) v(i, d, s, b)")
def inline_rows(t):
    return run([{"i": 1, "d": 0.5, "s": "x", "b": True}, {"i": 2, "d": None, "s": None, "b": False}])["res_1"]


# --- sinks ---------------------------------------------------------------------------------------


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def dump_to_bucket(t):
    bucket = folder("bucket")
    run(t("nation"), step("dump_to_s3", {"bucket_name": bucket, "prefix": "a/b", "delete": True}))
    return run(step("load", {"from": f"{bucket}/a/b/nation.csv", "name": "nation"}))["nation"]


def _csv_sql(table: str, columns: list[str]) -> str:
    """SQL for a table's CSV text."""
    line = " || ',' || ".join(columns)
    return f"'{','.join(columns)}' || chr(10) || string_agg({line}, chr(10) ORDER BY {columns[0]}) || chr(10)"


_STATS = " UNION ALL ".join(
    f"SELECT '{t}' AS resource, count(*) AS n, CAST(strlen({_csv_sql(t, c)}) AS BIGINT) AS bytes, md5({_csv_sql(t, c)}) AS hash FROM {t}" for t, c in (("region", ["r_regionkey", "r_name"]), ("nation", ["n_nationkey", "n_name", "n_regionkey"]))
)


@query(f"WITH s AS ({_STATS}) SELECT * FROM s UNION ALL SELECT 'all', CAST(sum(n) AS BIGINT), CAST(sum(bytes) AS BIGINT), NULL FROM s")
def dump_stats(t):
    order = step("reorder_fields", {"resources": ["nation"], "fields": ["n_nationkey", "n_name", "n_regionkey"]})
    stats = run(t("region"), step("reorder_fields", {"fields": ["r_regionkey", "r_name"]}), t("nation"), order, step("dump_to_path", {"out-path": folder("dump")})).stats
    rows = [(n, s["count_of_rows"], s["bytes"], s["hash"]) for n, s in stats["resources"].items()] + [("all", stats["count_of_rows"], stats["bytes"], None)]
    return session().createDataFrame(rows, "resource string, n long, bytes long, hash string")


def _dumped_lines(t: Tables, name: str, columns: list[str], *steps, **options) -> DataFrame:
    at = folder("dump")
    picked = lambda p: p.map([name], lambda r: r.project({}, [r.field(c) for c in columns]))
    run(t(name), picked, *steps, step("dump_to_path", {"out-path": at} | options))
    return lines_of(f"{at}/{name}.csv")


@query("SELECT 'p_partkey,p_retailprice' AS line UNION ALL SELECT p_partkey || ',' || regexp_replace(regexp_replace(CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR), '0+$', ''), '\\.$', '') FROM part")
def dump_numbers(t):
    """Numbers without exponents or trailing zeros."""
    return _dumped_lines(t, "part", ["p_partkey", "p_retailprice"], step("set_types", {"types": {"p_retailprice": {"type": "number"}}}))


_EXPONENT = "regexp_replace(regexp_replace(regexp_replace(format('{:.15e}', x), '0+e', 'e'), '\\.e', 'e'), 'e([-+])0*(\\d)', 'e\\1\\2')"


@query(f"SELECT 'p_partkey,p_retailprice' AS line UNION ALL SELECT p_partkey || ',' || {_EXPONENT} FROM (SELECT p_partkey, p_retailprice AS x FROM part)")
def dump_scientific(t):
    return _dumped_lines(t, "part", ["p_partkey", "p_retailprice"], step("set_types", {"types": {"p_retailprice": {"type": "number", "numberOutputFormat": "scientificNotation"}}}))


@query("SELECT 'Key,\"Name, full\"' AS line UNION ALL SELECT r_regionkey || ',' || r_name FROM region")
def dump_titles(t):
    titles = step("update_fields", {"fields": {"r_regionkey": {"title": "Key"}, "r_name": {"title": "Name, full"}}})
    return _dumped_lines(t, "region", ["r_regionkey", "r_name"], titles, use_titles=True)


@query("SELECT 'o_orderkey,o_orderdate' AS line UNION ALL SELECT o_orderkey || ',' || strftime(o_orderdate, '%d/%m/%Y %H.%M') FROM orders")
def dump_times(t):
    form = step("update_fields", {"fields": {"o_orderdate": {"shown": "%d/%m/%Y %H.%M", "outputFormat": "%Y"}}})
    return _dumped_lines(t, "orders", ["o_orderkey", "o_orderdate"], form, temporal_format_property="shown")


@query("SELECT o_orderkey, (SELECT count(*) FROM orders) AS written FROM orders ORDER BY o_orderkey LIMIT 10")
def dump_limit(t):
    at = folder("dump")
    r = run(t("orders"), only("orders", "o_orderkey"), step("dump_to_path", {"out-path": at, "limit_yield": 10}))["orders"]
    return r.frame().withColumn("written", F.lit(lines_of(f"{at}/orders.csv").count() - 1).cast("long"))


@query("SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey FROM customer")
def dump_parts(t):
    """A table too large to be one file stays in parts, which load puts together."""
    at = folder("dump")
    run(t("customer"), only("customer", "c_custkey", "c_name", "c_nationkey"), step("dump_to_path", {"out-path": at, "merge_bytes": 100}))
    return run(step("load", {"from": f"{at}/datapackage.json"}))["customer"]


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")
def dump_json_parts(t):
    at = folder("dump")
    run(t("nation"), only("nation", "n_nationkey", "n_name"), step("dump_to_path", {"out-path": at, "format": "json", "single_file": False}))
    return run(step("load", {"from": f"{at}/datapackage.json"}))["nation"]


@query("SELECT * FROM (VALUES ('few files cleared', true), ('many files kept', true), ('format refused', true), ('no bucket refused', true)) v(rule, held)")
def dump_rules(t):
    spark, at, full = session(), folder("few"), folder("many")
    for k in range(3):
        dump.write_text(spark, f"{at}/{k}.txt", "x")
    for k in range(12):
        dump.write_text(spark, f"{full}/{k}.txt", "x")
    small = t("region")
    run(small, step("dump_to_path", {"out-path": at, "delete": True}))
    where, fs = scratch.file_system(spark, f"{at}/0.txt")

    def refused(name: str, **how) -> bool:
        try:
            run(small, step(name, how))
        except StepError:
            return True
        return False

    rows = [("few files cleared", not fs.exists(where)), ("many files kept", refused("dump_to_path", **{"out-path": full, "delete": True}))]
    rows += [("format refused", refused("dump_to_path", **{"out-path": at, "format": "xlsx"})), ("no bucket refused", refused("dump_to_s3"))]
    return spark.createDataFrame(rows, "rule string, held boolean")


@query("SELECT DISTINCT CAST(quality AS VARCHAR) AS latitude, CAST(toxic AS VARCHAR) AS longitude FROM labels")
def dump_unique_lat_lon(t):
    mark = lambda n: {"place:": {"standard_name_id": n, "is_primary": True}}
    at = folder("dump")
    run(t("labels"), step("update_fields", {"fields": {"quality": mark(dump.LATITUDE), "toxic": mark(dump.LONGITUDE)}}), step("dump_to_path", {"out-path": at, "dump_unique_lat_lon": True}))
    return run(step("load", {"from": f"{at}/labels.unique_lat_lon.csv", "name": "u"}))["u"]


