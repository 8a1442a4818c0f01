"""Sources, sinks, checks and streams on small files of their own."""

import datetime as dt
import hashlib
import json
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tablewright import Flow, StepError, catalog_files, checks, samples, scratch, step
from tablewright.sources import load as sources
from tablewright.sinks.dump import unique_lat_lon
from tablewright.sources.load import infer_widths
from tablewright.streaming import apply_steps, run_stream

D = Decimal


@pytest.fixture(autouse=True)
def session(spark):
    return spark


def put(tmp_path, name, text, encoding="utf-8"):
    path = tmp_path / name
    path.write_bytes(text.encode(encoding))
    return str(path)


def load(path, **more):
    return Flow(step("load", {"from": path, "name": "res"} | more)).run()


CSV = "col1,col2,col3,col4\nabc,1,1.532,12/29/19\nabc,2,35.131,12/30/19\n\"d,\"\"e\nf\",1,53.1,\n,,,\nghi,3,54262.5,01/01/20\n"


def test_csv(tmp_path):
    r = load(put(tmp_path, "a.csv", CSV))["res"]
    assert r.names == ["col1", "col2", "col3", "col4"] and {f["type"] for f in r.fields} == {"string"}
    got = r.rows()
    assert [x["col1"] for x in got] == ["abc", "abc", 'd,"e\nf', "ghi"] and got[2]["col4"] is None
    assert len(load(put(tmp_path, "b.csv", CSV), remove_empty_rows=False)["res"].rows()) == 5
    assert load(put(tmp_path, "c.csv", "a\tb\n1\t2\n"), delimiter="\t")["res"].rows() == [{"a": "1", "b": "2"}]
    assert load(put(tmp_path, "l.csv", "é,b\nß,2\n", "latin-1"))["res"].rows() == [{"é": "ß", "b": "2"}]
    assert load(put(tmp_path, "d.csv", "a,a,,b\n1,2,3,4\n"), deduplicate_headers=True)["res"].rows() == [{"a (1)": "1", "a (2)": "2", "b": "4"}]
    with pytest.raises(StepError, match="duplicate"):
        load(put(tmp_path, "e.csv", "a,a\n1,2\n"))
    with pytest.raises(StepError, match="not found"):
        load(str(tmp_path / "nowhere.csv"))


def test_csv_headers(tmp_path):
    path = put(tmp_path, "m.csv", "1,2,3\n3,2,1\n# note\nx,y,z\n")
    r = load(path, headers=[1, 2], multiline_headers_joiner=";", multiline_headers_duplicates=True, skip_rows=["#"])["res"]
    assert r.rows() == [{"1;3": "x", "2;2": "y", "3;1": "z"}]
    path = put(tmp_path, "n.csv", "junk\nmore\na,b\n1,2\n3,4\n")
    assert load(path, headers=3)["res"].rows() == [{"a": "1", "b": "2"}, {"a": "3", "b": "4"}]
    assert load(path, headers=1, skip_rows=[1, 2, 5])["res"].rows() == [{"a": "1", "b": "2"}]


def test_names_and_globs(tmp_path):
    a, b = put(tmp_path, "One File.csv", "a\n1\n"), put(tmp_path, "two.csv", "a\n2\n")
    many = lambda **more: Flow(step("load", more)).run()
    assert many(**{"from": f"{a},{b}", "name": "r"}).names == ["r-1", "r-2"]
    assert many(**{"from": [a, b], "name": "x,y"}).names == ["x", "y"]
    assert many(**{"from": f"{tmp_path}/*.csv", "input_path_pattern": True, "use_filename": True}).names == ["one_file", "two"]
    with pytest.raises(StepError):
        many(**{"from": [a, b], "name": "x,y,z"})
    with pytest.raises(StepError, match="No files"):
        many(**{"from": f"{tmp_path}/*.nope", "input_path_pattern": True})


def test_database(spark):
    rows = [(None, "no key"), (3, None), (4, ""), (None, None), (-7, " a "), (8, "é,'\"\n😀"), (9, '"'), (10, "a\\"), (11, "\r\n"), (12, "\t"), (2**31 - 1, '""')]
    url = catalog_files.database(spark.createDataFrame(rows, "k int, v string"), "things", '"k" INTEGER, "v" VARCHAR(20)')
    how = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver", "partitionColumn": "k", "lowerBound": 0, "upperBound": 12, "numPartitions": 3}
    df = load(url, format="sql", table="things", jdbc=how)["res"].frame()
    assert df.dtypes == [("k", "int"), ("v", "string")] and sorted(map(tuple, df.collect()), key=repr) == sorted(rows, key=repr)
    assert [r["k"] for r in df.where("v = ' a '").collect()] == [-7]


def test_overrides_and_missing_values(tmp_path):
    path = put(tmp_path, "a.csv", "a,b\n1,nd\nnd,2\n")
    r = load(path, missing_values=["nd", ""], override_fields={"a": {"title": "A"}}, extract_missing_values=True)["res"]
    assert r.field("a")["title"] == "A" and [x["missingValues"] for x in r.rows()] == [{"b": "nd"}, {"a": "nd"}]
    typed = Flow(r, step("set_types", {"types": {"a": {"type": "integer"}}})).run()["res"]
    assert [x["a"] for x in typed.rows()] == [1, None]


def test_regex_csv(tmp_path):
    path = put(tmp_path, "r.csv", "** Testing multiple\n** another\ncol1 col2 col3\nabc 1   1.532\nabc         2 35.131\n")
    how = {"format": "any-regex-csv", "delimiter": r"\s+", "skip_rows": ["#", "*"]}
    assert load(path, **how)["res"].rows() == [{"col1": "abc", "col2": "1", "col3": "1.532"}, {"col1": "abc", "col2": "2", "col3": "35.131"}]
    caught = load(path, **how, capture_skipped_rows=[{"column_name": "t", "regex": r"\*\* (.*)"}])["res"]
    assert caught.rows()[0]["t"] == "Testing multiple;another"
    path = put(tmp_path, "s.txt", "EXPO     316N_10 WHP-ID  I07N\nSTN 711\n  PRS  TMP  QUAL\n    DB  IT\n *** ***\n     0.0 25.1  22\n     2.0 25.2  23\n")
    how = {"format": "regex-csv", "delimiter": r"\s+", "headers": [3, 4], "skip_rows": [{"value": r" \*{3}.*", "type": "regex"}], "deduplicate_headers": True}
    r = load(path, **how, capture_skipped_rows=[{"column_name": "EXPO", "regex": r"EXPO\s+(.*)\s+WHP.*"}], capture_skipped_rows_join=False)["res"]
    assert r.rows() == [{"PRS DB": "0.0", "TMP IT": "25.1", "QUAL ": "22", "EXPO": "316N_10"}, {"PRS DB": "2.0", "TMP IT": "25.2", "QUAL ": "23", "EXPO": "316N_10"}]


CNV = "* Instrument\n** note one\n** note two\n# name 0 = prDM: Pressure [db]\n# name 1 = sal00: Salinity: practical\n# name 2 = sal00: Salinity, 2\n# start_time = Apr 27\n*END*\n" + "".join(f"{a:>11}{b:>11}{c:>11}\n" for a, b, c in (("3.000", "8.27", "-9.990e-29"), ("4.000", "8.28", "")))


def test_fixed_width(tmp_path):
    how = {"format": "own-fixedwidth", "infer": True, "parse_seabird_header": True, "deduplicate_headers": True, "skip_rows": ["#", "*"]}
    r = load(put(tmp_path, "a.cnv", CNV), **how, seabird_capture_skipped_rows=[{"column_name": "t", "regex": "# start_time = (.*)"}, {"column_name": "n", "regex": r"\*\* note (.*)"}])["res"]
    assert r.names == ["prDM", "sal00: Salinity", "sal00", "n", "t"]
    assert r.rows()[0] == {"prDM": "3.000", "sal00: Salinity": "8.27", "sal00": "-9.990e-29", "t": "Apr 27", "n": "one;two"}
    assert r.rows()[1]["sal00"] == "nan"
    parts = load(put(tmp_path, "b.cnv", CNV), **how, seabird_capture_skipped_rows=[{"column_name": "n", "regex": r"\*\* note (.*)"}], seabird_capture_skipped_rows_join=False)["res"]
    assert parts.names[-2:] == ["n (1)", "n (2)"]
    text = "id   name  x\n 1   ann  10\n22   bob   3\n"
    want = [{"id": "1", "name": "ann", "x": "10"}, {"id": "22", "name": "bob", "x": "3"}]
    assert load(put(tmp_path, "c.txt", text), format="fixedwidth", infer=True)["res"].rows() == want
    assert load(put(tmp_path, "d.txt", text), format="fixedwidth", width=[5, 5, 3])["res"].rows() == [{"id": "1", "name": "ann", "x": "10"}, {"id": "22", "name": "bob", "x": "3"}]
    assert infer_widths(["ab  c", " b  cd"]) == [(0, 2), (4, 6)]
    with pytest.raises(StepError):
        load(put(tmp_path, "e.txt", text), format="fixedwidth")


def workbook(tmp_path):
    path = tmp_path / "w.xlsx"
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = lambda rows: f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(("First One", "test2", "test3"), 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{k}" Target="worksheets/sheet{k}.xml"/>' for k in (1, 2, 3)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><r><t>a</t></r><r><t>nn</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", sheet('<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="str"><v>n</v></c><c r="C1" t="inlineStr"><is><t>when</t></is></c></row><row r="3"><c r="A3" t="s"><v>1</v></c><c r="B3"><v>0.1</v></c><c r="C3" s="1"><v>43510.5</v></c></row>'))
        for k in (2, 3):
            z.writestr(f"xl/worksheets/sheet{k}.xml", sheet(f'<row r="1"><c r="A1" t="str"><v>q</v></c></row><row r="2"><c r="A2"><v>{k}</v></c></row>'))
    return str(path)


def test_workbooks(tmp_path):
    path = workbook(tmp_path)
    with pytest.raises(StepError):
        load(path, sheet="none")
    assert load(path, sheet=2)["res"].rows() == [{"q": "2"}]
    assert load(path, sheet="test.*", sheet_regex=True).names == ["test2", "test3"]
    assert load(path, sheet="2-3", sheet_separator=",").names == ["2", "3"]
    assert load(path, sheet="test2,3", sheet_separator=",").names == ["test2", "3"]


def test_workbook_cells(tmp_path):
    assert load(workbook(tmp_path), sheet="First One")["res"].rows() == [{"name": "ann", "n": "0.1", "when": "2019-02-14 12:00:00"}]


def test_older_workbooks(tmp_path):
    """Texts that go over several records, short numbers, gaps, and sheets by number."""
    sheets = {"Ünï": [["name", "n", "x"], ["ann", 5, 0.25], [None, -7, "long " * 900], ["ü€" * 800, 123456, 2.5]], "two": [["q"], [3]]}
    want = [{"name": "ann", "n": "5", "x": "0.25"}, {"name": None, "n": "-7", "x": "long " * 900}, {"name": "ü€" * 800, "n": "123456", "x": "2.5"}]
    for name, data in (("a.xlsx", samples.xlsx(sheets)), ("a.xls", samples.xls(sheets)), ("b.xls", samples.xls(sheets, 301)), ("a.xml", samples.excel_xml(sheets))):
        (tmp_path / name).write_bytes(data)
        more = {"format": "excel-xml"} if name.endswith("xml") else {}
        assert load(str(tmp_path / name), **more)["res"].rows() == want
        assert load(str(tmp_path / name), sheet=2, **more)["res"].rows() == [{"q": "3"}]
    with pytest.raises(StepError):
        load(put(tmp_path, "no.xls", "text"))


def test_large_csv_is_split_unless_cells_hold_line_feeds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sources, "ONE_TASK_BYTES", 10)
    flat, deep = put(tmp_path, "flat.csv", 'a,b\n"x ""y""",2\n'), put(tmp_path, "deep.csv", 'a,b\n"x\ny",2\n')
    assert not sources._multiline(spark, flat, "UTF-8", '"', None) and sources._multiline(spark, deep, "UTF-8", '"', None)
    assert load(flat)["res"].rows() == [{"a": 'x "y"', "b": "2"}] and load(deep)["res"].rows() == [{"a": "x\ny", "b": "2"}]


def test_the_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda s: type("S", (), {"getCheckpointDir": lambda s: type("O", (), {"isDefined": lambda s: False})()})()})()

    class Session:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.root(Session())


def test_json_and_packages(tmp_path):
    assert load(put(tmp_path, "a.json", '[{"a": 1, "b": "x"}, {"a": null, "b": "y"}]'))["res"].rows() == [{"a": "1", "b": "x"}, {"a": None, "b": "y"}]
    assert load(put(tmp_path, "b.jsonl", '{"a": 1}\n{"a": 2}\n'))["res"].rows() == [{"a": "1"}, {"a": "2"}]
    out = f"{tmp_path}/out"
    Flow([{"x": 1, "y": "q"}], step("dump_to_path", {"out-path": out})).run()
    again = Flow(step("load", {"from": f"{out}/datapackage.json"})).run()
    assert again.names == ["res_1"] and again["res_1"].field("x")["type"] == "integer" and again["res_1"].rows() == [{"x": "1", "y": "q"}]


def test_parquet_keeps_types_and_order(spark, tmp_path):
    spark.range(100).select("id", (F.col("id") * 2).alias("twice")).repartition(1).write.parquet(f"{tmp_path}/t.parquet")
    r = load(f"{tmp_path}/t.parquet", order_by="id")["res"]
    assert [f["type"] for f in r.fields] == ["integer", "integer"]
    plan = Flow(r, step("boolean_filter_rows", {"boolean_statement": "{id} > 90"}), step("delete_fields", {"fields": ["id"]})).run()["res"].frame()._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,90)]" in plan


def read(path):
    with open(path, encoding="utf-8", newline="") as f:
        return f.read()


def test_dump(tmp_path):
    data = [{"n": D("4.2730"), "s": 'a"b,c', "t": dt.datetime(2020, 1, 1, 12, 30), "d": dt.date(2020, 1, 2), "b": True}, {"n": D("-0.00000042730"), "s": None, "t": None, "d": None, "b": None}]
    out = Flow(data, step("dump_to_path", {"out-path": f"{tmp_path}/o", "data_manager": {"name": "x"}})).results()
    text = read(f"{tmp_path}/o/res_1.csv")
    assert text == 'n,s,t,d,b\n4.273,"a""b,c",2020-01-01T12:30:00,2020-01-02,True\n-0.0000004273,,,,\n'
    described = json.loads(read(f"{tmp_path}/o/datapackage.json"))
    assert described["resources"][0]["hash"] == hashlib.md5(text.encode()).hexdigest() and described["resources"][0]["bytes"] == len(text.encode()) == described["bytes"]
    assert described["count_of_rows"] == 2 == out.stats["resources"]["res_1"]["count_of_rows"] and described["dataManager"] == {"name": "x"}


def test_dump_formats(tmp_path):
    number = [{"n": "4.273E-7"}, {"n": "-1.42E-14"}, {"n": "1200"}]
    Flow(number, step("set_types", {"types": {"n": {"type": "number", "numberOutputFormat": "scientificNotation"}}}), step("dump_to_path", {"out-path": f"{tmp_path}/a"})).run()
    assert read(f"{tmp_path}/a/res_1.csv") == "n\n4.273e-7\n-1.42e-14\n1.2e+3\n"
    times = [{"dt": "2020-01-01 12:30:00"}, {"dt": "2021-06-15 08:05:59"}]
    Flow(times, step("set_types", {"types": {"dt": {"type": "datetime", "format": "%Y-%m-%d %H:%M:%S"}}}), step("dump_to_path", {"out-path": f"{tmp_path}/b", "temporal_format_property": "outputFormat"})).run()
    assert read(f"{tmp_path}/b/res_1.csv") == "dt\n2020-01-01 12:30:00\n2021-06-15 08:05:59\n"
    Flow([{"n": "310.6"}], step("set_types", {"types": {"n": {"type": "number"}}}), step("round_fields", {"fields": [{"name": "n", "digits": 3, "preserve_trailing_zeros": True}]}), step("dump_to_path", {"out-path": f"{tmp_path}/c"})).run()
    assert read(f"{tmp_path}/c/res_1.csv") == "n\n310.600\n"
    Flow([{"a": 1, "b": None}, {"a": 2, "b": "x"}], step("dump_to_path", {"out-path": f"{tmp_path}/d", "format": "json"})).run()
    assert json.loads(read(f"{tmp_path}/d/res_1.json")) == [{"a": 1, "b": None}, {"a": 2, "b": "x"}]
    Flow([{"a": "1"}], step("update_fields", {"fields": {"a": {"title": "The A"}}}), step("dump_to_path", {"out-path": f"{tmp_path}/e", "use_titles": True})).run()
    assert read(f"{tmp_path}/e/res_1.csv") == "The A\n1\n"
    with pytest.raises(StepError):
        Flow([{"a": 1}], step("dump_to_path", {"out-path": f"{tmp_path}/f", "format": "xlsx"})).run()


def test_dump_to_a_bucket(tmp_path):
    """A bucket is a path root like any other; here a local one."""
    data = [{"a": k} for k in range(10)]
    how = {"bucket_name": f"file://{tmp_path}/bucket", "prefix": "p", "limit_yield": 3, "delete": True, "save_pipeline_spec": True, "pipeline_spec": "x: 1\n"}
    p = Flow(data, step("dump_to_s3", how)).run()
    assert p["res_1"].rows() == data[:3] and read(f"{tmp_path}/bucket/p/res_1.csv").count("\n") == 11 and read(f"{tmp_path}/bucket/p/pipeline-spec.yaml") == "x: 1\n"
    Flow(data, step("dump_to_s3", how)).run()
    for k in range(12):
        put(tmp_path / "bucket/p", f"{k}.txt", "x")
    with pytest.raises(StepError, match="isn't cleared"):
        Flow(data, step("dump_to_s3", how)).run()
    parts = Flow(data, step("dump_to_path", {"out-path": f"{tmp_path}/parts", "single_file": False})).run()
    assert parts.stats["count_of_rows"] == 10


def test_large_dump_keeps_order(spark, tmp_path):
    from tablewright import from_frame

    r = from_frame("big", spark.range(200_000).select(F.lit("1").alias("a"), "id", F.lit("3").alias("c")).repartition(9), "id")
    Flow(r, step("dump_to_path", {"out-path": f"{tmp_path}/x"})).run()
    lines = read(f"{tmp_path}/x/big.csv").split("\n")
    assert lines[0] == "a,id,c" and lines[1:-1] == [f"1,{k},3" for k in range(200_000)]


def test_unique_lat_lon(tmp_path):
    data = [{"lat": "41.5", "lon": "-70.6", "v": "a"}, {"lat": "41.5", "lon": "-70.6", "v": "b"}, {"lat": "42.0", "lon": "-71.0", "v": "c"}]
    mark = lambda n: {"place:": {"standard_name_id": n, "is_primary": True}}
    marked = step("update_fields", {"fields": {"lat": mark("730"), "lon": mark("731")}})
    Flow(data, marked, step("dump_to_path", {"out-path": f"{tmp_path}/u", "dump_unique_lat_lon": True})).run()
    assert read(f"{tmp_path}/u/res_1.unique_lat_lon.csv") == "latitude,longitude\n41.5,-70.6\n42.0,-71.0\n"
    assert unique_lat_lon(Flow(data, step("update_fields", {"fields": {"lat": mark("730")}})).run()["res_1"]) is None


def test_checks():
    data = [{"_x": "plain", "lat": 0.0, "2y": "café"}, {"_x": "a b", "lat": 90.0, "2y": None}, {"_x": "", "lat": -89.9, "2y": "\u0080"}]
    p = Flow(data).run()
    heads = checks.header_name_invalid(p).collect()
    assert [(r["field"], r["row"]) for r in heads] == [("_x", None), ("2y", None)]
    found = checks.run_checks(p, [{"latitude-bounds": "lat"}, {"longitude-bounds": {"constraint": "lat"}}, "non-standard-character"]).orderBy("row", "field").collect()
    assert [(r["check"], r["row"], r["field"]) for r in found] == [("non-standard-character", 1, "2y"), ("non-standard-whitespace-character", 2, "_x"), ("latitude-bounds", 2, "lat")]
    assert found[0]["message"] == "Character 233 is not a standard one"
    with pytest.raises(StepError):
        checks.run_checks(p, ["nothing"])


STEPS = [
    {"run": "boolean_filter_rows", "parameters": {"boolean_statement": "{id} >= 3"}},
    {"run": "string_format", "parameters": {"fields": [{"output_field": "label", "input_string": "n{:02d}", "input_fields": ["id"]}]}},
]


def test_streams(spark, tmp_path):
    source, out, at = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/at"
    spark.range(5).write.parquet(source)
    stream = lambda: spark.readStream.schema("id long").parquet(source)
    run_stream(stream(), STEPS, out, at).awaitTermination()
    assert sorted(r["label"] for r in spark.read.parquet(out).collect()) == ["n03", "n04"]
    spark.range(7, 9).write.mode("append").parquet(source)
    run_stream(stream(), STEPS, out, at).awaitTermination()
    assert sorted(r["label"] for r in spark.read.parquet(out).collect()) == ["n03", "n04", "n07", "n08"]
    with pytest.raises(StepError):
        apply_steps(stream(), [{"run": "sort", "parameters": {"sort-by": "id"}}])
    with pytest.raises(StepError):
        apply_steps(stream(), [{"run": "boolean_filter_rows", "parameters": {"boolean_statement": "ROW_NUMBER > 3"}}])
