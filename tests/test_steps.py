"""Each step on small tables: values, schemas, and errors raised before any row is read."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tablewright import Flow, StepError, from_spec, run_spec, step

D = Decimal


def rows(*parts):
    return Flow(*parts).results().rows()


def values(column, *parts):
    return [r[column] for r in rows(*parts)]


def typed(name="col1", kind="number", **more):
    return step("set_types", {"types": {name: {"type": kind} | more}})


TEXTS = [{"col1": "abc", "col2": "x"}, {"col1": "heresabc", "col2": "y"}, {"col1": "nothere", "col2": "z"}]
NUMBERS = [{"col1": "4.323"}, {"col1": "362.6271"}, {"col1": "9132.62"}, {"col1": "310.6"}, {"col1": "310.9999"}]


@pytest.fixture(autouse=True)
def session(spark):
    return spark


def test_expressions():
    data = [{"n": 1, "s": "5", "d": dt.date(2020, 1, 2)}, {"n": None, "s": "", "d": None}, {"n": 60, "s": "abc", "d": dt.date(2021, 1, 1)}]
    keep = lambda s: values("n", data, step("boolean_filter_rows", {"boolean_statement": s}))
    assert keep("{n} > 50") == [60]
    assert keep("{n} != NULL && {s} == '5'") == [1]
    assert keep("{n} == NULL") == [None]
    assert keep("{s} == NULL") == [None]
    assert keep("{s} != '5'") == [None, 60]
    assert keep("{s} == 5") == [] and keep("{s} != 5") == [1, None, 60]
    assert keep("{s} == re'a.'") == [60] and keep("{s} != re'a.'") == [1, None]
    assert keep("{s} == re'b'") == []
    assert keep("{d} >= 2020-06-01") == [60] and keep("{d} == 2020/01/02") == [1]
    assert keep("{n} == 1 || {n} == 60 AND {s} == 'abc'") == [1, 60]
    assert keep("({n} == 1 or {n} == 60) and {s} == 'abc'") == [60]
    assert keep("{n} > -10") == [1, 60] and keep("{n} < 1e5") == [1, 60]
    assert keep("LINE_NUMBER >= 2") == [None, 60]
    assert keep("") == [1, None, 60]
    assert keep("{n} == {n}") == [1, None, 60] and keep("{n} != {d}") == [1, 60]


@pytest.mark.parametrize("statement", ["{s} > 5", "{nowhere} == 1", "{n} == 1 rubbish", "{n} =", "{n} == re'x'", "{s} > re'x'", "({n} == 1", "{s} == re'('"])
def test_bad_expressions(statement):
    with pytest.raises(StepError):
        Flow([{"n": 1, "s": "x"}], step("boolean_filter_rows", {"boolean_statement": statement})).run()


def test_row_numbers_follow_order(spark):
    from tablewright import from_frame, order
    from tablewright.package import ROW_ID

    r = from_frame("t", spark.range(10_000).repartition(7).withColumn("k", -F.col("id")), "k")
    numbered = order.numbered(r)
    assert numbered.df.where(F.col(ROW_ID) != 10_000 - F.col("id")).isEmpty()
    assert numbered.df.count() == 10_000


def test_row_numbers_without_ids_of_their_own(spark):
    """Ids that rows share, and ids that differ from run to run, still give every row a number of its own."""
    from tablewright import from_frame, order
    from tablewright.package import ROW_ID

    ties = from_frame("t", spark.range(1000).withColumn("k", F.col("id") % 10), "k")
    for r in (ties, order.sorted_by(ties, [F.col("id").desc()]), from_frame("u", spark.range(1000).repartition(5))):
        assert sorted(x[0] for x in order.numbered(r).df.select(ROW_ID).collect()) == list(range(1, 1001))
    assert order.numbers(ties) is None
    few = order.numbered(ties, lambda df: df.where("id < 3")).df.collect()
    assert len(few) == 3
    nulls = from_frame("n", spark.createDataFrame([(1,), (None,), (2,)], "k int"), "k")
    assert sorted((r["k"] or 0, r[ROW_ID]) for r in order.numbered(nulls).df.collect()) == [(0, 1), (1, 2), (2, 3)]


def test_filters_by_row_number_read_ids_and_needed_columns_only(spark, tmp_path):
    from tablewright import from_frame

    spark.range(1000).selectExpr("id AS k", "id * 2 AS a", "'x' AS b").write.parquet(f"{tmp_path}/t")
    r = from_frame("t", spark.read.parquet(f"{tmp_path}/t"), "k")
    out = Flow(r, step("boolean_filter_rows", {"boolean_statement": "ROW_NUMBER == 7"}), step("delete_fields", {"fields": ["b"]})).run()["t"]
    assert [tuple(x) for x in out.frame().collect()] == [(6, 12)]
    assert "ReadSchema: struct<k:bigint,a:bigint>" in out.frame()._jdf.queryExecution().toString()


def test_math_in_decimals():
    cases = [("123.456789012345678", "0.000000000000000001"), ("999999999.123456789", "-3.25"), ("7", "123456789.5"), ("-1", "3"), ("0.1", "0.3")]
    fields = {"p": "{a} * {b}", "q": "{a} / {b}", "s": "{a} - {b}", "c": "{b} ^ 2", "i": "{b} ^ -1"}
    plan = [{"target": t, "type": "number", "functions": [{"always_run": True, "math_operation": True, "value": e}]} for t, e in fields.items()]
    data = [{"a": a, "b": b} for a, b in cases if D(a) / D(b) < 10**19]
    got = rows(data, step("set_types", {"types": {"a": {"type": "number"}, "b": {"type": "number"}}}), step("boolean_add_computed_field", {"fields": plan[:3]}))
    got2 = rows(data[1:], step("set_types", {"types": {"a": {"type": "number"}, "b": {"type": "number"}}}), step("boolean_add_computed_field", {"fields": plan[3:]}))
    for r in got:
        a, b = r["a"], r["b"]
        assert abs(r["p"] - a * b) <= D("2e-18") and r["s"] == a - b
        assert abs(r["q"] - a / b) <= max(D("2e-18"), abs(a / b) * D("1e-27"))
    for r in got2:
        assert abs(r["c"] - r["b"] ** 2) <= D("2e-18") and abs(r["i"] - 1 / r["b"]) <= D("2e-18")


def test_progress():
    told = []
    Flow([{"a": "1"}], step("duplicate", {}), progress=lambda k, n, name, p: told.append((k, n, name, p.names))).run()
    assert told == [(1, 2, "list", ["res_1"]), (2, 2, "duplicate", ["res_1", "res_1_copy"])]


def test_computed_fields():
    field = lambda *functions, kind="string": step("boolean_add_computed_field", {"fields": [{"target": "out", "type": kind, "functions": list(functions)}]})
    one = {"boolean": "{col1} == 'heresabc'", "value": "got {col2}"}
    assert values("out", TEXTS, field(one)) == [None, "got y", None]
    assert values("out", TEXTS, field({"always_run": True, "value": "{col1}"}, one)) == ["abc", "got y", "nothere"]
    assert values("out", TEXTS, field({"always_run": True, "value": "NULL"})) == [None] * 3
    assert values("out", [{"a": "2020-01-01T10:11:12"}], field({"always_run": True, "value": "{a}"}, kind="datetime")) == [dt.datetime(2020, 1, 1, 10, 11, 12)]
    assert values("out", [{"a": "Jan 5 2020 10:11 PM"}], field({"always_run": True, "value": "{a}"}, kind="date")) == [dt.date(2020, 1, 5)]
    assert values("out", [{"a": "10:11"}], field({"always_run": True, "value": "2020-01-01 {a}"}, kind="time")) == ["10:11:00"]
    maths = lambda s: values("out", [{"a": 7, "b": 2, "c": None}], typed("c", "integer"), field({"always_run": True, "math_operation": True, "value": s}, kind="number"))
    assert maths("2^3^2") == [64] and maths("{a} + {b} * 3") == [13] and maths("({a} - 1) / 4") == [D("1.5")] and maths("{a} + {c}") == [None]
    with pytest.raises(StepError):
        maths("{a} ++ 1")
    with pytest.raises(Exception, match="(?i)zero"):
        maths("{a} / ({b} - 2)")


def test_computed_fields_see_each_other():
    fields = [{"target": "a", "type": "number", "functions": [{"always_run": True, "math_operation": True, "value": "{a} + 1"}]}, {"target": "b", "type": "string", "functions": [{"boolean": "{a} == 2", "value": "was {a}"}]}]
    assert rows([{"a": 1}, {"a": 5}], step("boolean_add_computed_field", {"fields": fields})) == [{"a": 2, "b": "was 1"}, {"a": 6, "b": None}]


def test_edit_cells():
    edit = lambda e: step("edit_cells", {"edited": e})
    data = [{"a": "x", "n": 1}, {"a": "y", "n": 2}]
    assert rows(data, edit({"2": [{"field": "n", "value": "3"}, {"field": "a", "value": "z"}]})) == [{"a": "x", "n": 1}, {"a": "z", "n": 3}]
    with pytest.raises(StepError, match="not used"):
        rows(data, edit({3: [{"field": "a", "value": "z"}]}))
    with pytest.raises(StepError, match="not found"):
        rows(data, edit({1: [{"field": "q", "value": "z"}]}))
    with pytest.raises(Exception, match="(?i)cast"):
        rows(data, edit({1: [{"field": "n", "value": "hello"}]}))
    many = edit({k: [{"field": "a", "value": f"v{k}"}] for k in range(1, 301)})
    assert values("a", [{"a": "x"}] * 301, many) == [*[f"v{k}" for k in range(1, 301)], "x"]


def test_round_fields():
    def one(digits, **more):
        return values("col1", NUMBERS, typed(), step("round_fields", {"fields": [{"name": "col1", "digits": digits} | more]}))

    assert one(2) == [D("4.32"), D("362.63"), D("9132.62"), D("310.6"), D("311")]
    assert one(0, convert_to_integer=True) == [4, 363, 9133, 311, 311]
    assert values("col1", [{"col1": "0.125"}, {"col1": "2.5"}, {"col1": ""}], typed(), step("round_fields", {"fields": [{"name": "col1", "digits": 2}]})) == [D("0.12"), D("2.5"), None]
    with pytest.raises(StepError, match="number"):
        rows(NUMBERS, step("round_fields", {"fields": [{"name": "col1", "digits": 2}]}))
    with pytest.raises(StepError):
        one(1, convert_to_integer=True)


def test_convert_units():
    one = {"name": "col1", "conversion": "feet_to_meter"}
    assert values("col1", NUMBERS[:1], typed(), step("convert_units", {"fields": [one]})) == [D("1.3176504")]
    r = Flow([{"col1": "1", "b": "x"}], typed(), step("convert_units", {"fields": [one | {"preserve_field": True, "new_field_name": "m"}]})).run()["res_1"]
    assert r.names == ["col1", "m", "b"]
    with pytest.raises(StepError):
        rows(NUMBERS, typed(), step("convert_units", {"fields": [one | {"preserve_field": True}]}))


def test_find_replace():
    one = lambda *patterns, data=TEXTS: values("col1", data, step("find_replace", {"fields": [{"name": "col1", "patterns": list(patterns)}]}))
    assert one({"find": "here", "replace": "X"}) == ["abc", "Xsabc", "notX"]
    assert one({"find": r"(?P<q>[ab])", "replace": r"<\g<q>>"}) == ["<a><b>c", "heres<a><b>c", "nothere"]
    assert one({"find": "a$|(z)", "replace": "$"}) == ["abc", "heresabc", "nothere"]
    data = [{"col1": "Abc"}, {"col1": "abc_def_hda"}, {"col1": "xxabc"}]
    assert one({"find": "(a)bc|d(a)$", "replace": "", "replace_function": "uppercase"}, data=data) == ["Abc", "Abc_def_hdA", "xxAbc"]
    assert one({"find": "(A|B)", "replace": "", "replace_function": "lowercase"}, data=[{"col1": "ABC"}]) == ["abC"]
    assert one({"find": "^$", "replace": "none"}, data=[{"col1": None}, {"col1": ""}]) == [None, ""]
    assert one({"find": "^$", "replace": "none", "replace_missing_values": True}, data=[{"col1": None}, {"col1": ""}]) == ["none", "none"]


def test_guards():
    guard = {"boolean_statement": "{col2} == 'y'"}
    pattern = [{"find": "abc", "replace": "!"}]
    assert values("col1", TEXTS, step("find_replace", {"fields": [{"name": "col1", "patterns": pattern}]} | guard)) == ["abc", "heres!", "nothere"]
    assert values("o", TEXTS, step("string_format", {"fields": [{"output_field": "o", "input_string": "<{}>", "input_fields": ["col1"]}]} | guard)) == [None, "<heresabc>", None]
    assert values("col2", TEXTS, step("split_column", {"fields": [{"input_field": "col1", "output_fields": ["col2"], "pattern": "(.)"}]} | guard)) == [None, "h", None]
    assert values("col1_", TEXTS, step("extract_nonnumeric", {"fields": ["col1"]} | guard)) == [None, "heresabc", None]


def test_string_format():
    one = lambda text, fields, data: values("o", data, step("string_format", {"fields": [{"output_field": "o", "input_string": text, "input_fields": fields}]}))
    data = [{"a": 5, "b": 2.675, "s": "x"}, {"a": None, "b": 1.0, "s": "y"}]
    assert one("{0:03d}-{1:.2f}-{2}", ["a", "b", "s"], data) == ["005-2.67-x", None]
    assert one("{}{}", ["s", "a"], data) == ["x5", None]
    assert one("{0:>5}|{1:e}", ["s", "b"], data) == ["    x|2.675000e+00", "    y|1.000000e+00"]
    with pytest.raises(StepError):
        one("{0:03d}", ["s"], data)
    with pytest.raises(StepError):
        one("{5}", ["s"], data)


def test_split_column():
    one = lambda data, **f: rows(data, step("split_column", {"fields": [{"input_field": "c", "output_fields": ["a", "b"]} | f], "delete_input": True}))
    want = [{"a": "hello", "b": "world"}, {"a": "foo", "b": "bar"}]
    data = [{"c": "hello world"}, {"c": "foo bar"}]
    assert one(data, pattern="(.*) (.*)") == want and one(data, delimiter=" ") == want
    assert one([{"c": "hello     world"}], delimiter=r"\s+") == want[:1]
    assert one([{"c": None}], delimiter=" ") == [{"a": None, "b": None}]
    with pytest.raises(Exception, match="does not split"):
        one([{"c": "a b c"}], delimiter=" ")
    with pytest.raises(Exception, match="no match"):
        one([{"c": "abc"}], pattern="(.*) (.*)")
    with pytest.raises(StepError):
        one(data, pattern="(.*)")
    with pytest.raises(StepError):
        one(data)


def test_extract_nonnumeric():
    texts = ["42", "15.2", "this is a string", "341 and a string", "12", "1_000", "1d", " 7 ", "-inf", "1e5", ""]
    r = Flow([{"a": t, "z": "k"} for t in texts], step("extract_nonnumeric", {"fields": ["a"], "suffix": "_comment"})).run()["res_1"]
    assert r.names == ["a", "a_comment", "z"]
    assert [x["a_comment"] for x in r.rows()] == [None, None, "this is a string", "341 and a string", None, None, "1d", None, None, None, None]
    assert [x["a"] for x in r.rows()][:4] == ["42", "15.2", None, None]


def date(field, *data):
    return values("out", [dict(d) for d in data], step("convert_date", {"fields": [{"output_field": "out", "output_format": "%Y-%m-%dT%H:%M:%S"} | field]}))


def test_dates_from_text():
    one = lambda fmt, text, **more: date({"inputs": [{"field": "a", "format": fmt}]} | more, {"a": text})[0]
    assert one("%m/%d/%Y %H:%M:%S", "12/31/1995 11:24:31") == dt.datetime(1995, 12, 31, 11, 24, 31)
    assert one("%m/%d/%y", "1/2/75") == dt.datetime(1975, 1, 2) and one("%m/%d/%y", "1/2/68") == dt.datetime(2068, 1, 2)
    assert one("%d %b %Y %I:%M %p", "3 Feb 2020 12:05 AM") == dt.datetime(2020, 2, 3, 0, 5)
    assert one("%B %d, %Y %H.%M.%S.%f", "march 09, 2021 1.2.3.25") == dt.datetime(2021, 3, 9, 1, 2, 3, 250000)
    assert one("%H:%M", "5:07") == dt.datetime(1900, 1, 1, 5, 7)
    assert one("%m-%d", "02-29", year=2020) == dt.datetime(2020, 2, 29)
    assert one("%Y-%j", "2020-060") == dt.datetime(2020, 2, 29)
    assert one("%Y-%m-%d", None) is None and one("%Y-%m-%d", "") is None
    assert one("%Y-%m-%d", "2020-01-02", output_type="date") == dt.date(2020, 1, 2)
    assert one("%H:%M:%S", "01:02:03", output_type="time") == "01:02:03"
    assert one("%Y-%m-%d", "2020-01-02", output_type="string", output_format="%d/%m/%y %A %%") == "02/01/20 Thursday %"
    with pytest.raises(Exception, match="does not match format"):
        one("%Y-%m-%d", "2020/01/02")
    with pytest.raises(StepError):
        one("%Q", "1")
    three = {"inputs": [{"field": "m", "format": "%m"}, {"field": "d", "format": "%d"}, {"field": "y", "format": "%Y"}]}
    assert date(three, {"m": "12", "d": "31", "y": "1995"}, {"m": "", "d": "31", "y": "1995"}) == [dt.datetime(1995, 12, 31), None]


def test_time_zones():
    one = lambda text, **more: date({"inputs": [{"field": "a", "format": "%Y-%m-%d %H:%M"}], "output_type": "string", "output_format": "%Y-%m-%d %H:%M %Z%z"} | more, {"a": text})[0]
    new_york = {"input_timezone": "America/New_York", "output_timezone": "UTC"}
    assert one("1999-12-31 23:59", input_timezone="EST", output_timezone="UTC") == "2000-01-01 04:59 UTC+0000"
    assert one("2020-11-01 01:30", **new_york) == "2020-11-01 06:30 UTC+0000"
    assert one("2020-07-01 12:00", **new_york) == "2020-07-01 16:00 UTC+0000"
    assert one("2020-07-01 12:00", input_timezone="UTC", output_timezone="America/New_York") == "2020-07-01 08:00 EDT-0400"
    assert one("2020-07-01 12:00", input_timezone="UTC", input_timezone_utc_offset=-5, output_timezone="UTC", output_timezone_utc_offset=2) == "2020-07-01 19:00 UTC+0200"
    with pytest.raises(StepError):
        one("2020-07-01 12:00", output_timezone="UTC", output_format="%Y")
    with pytest.raises(StepError):
        one("2020-07-01 12:00")


def test_dates_from_numbers():
    one = lambda kind, text, **more: date({"input_type": kind, "input_field": "a"} | more, {"a": text})[0]
    assert one("excel", "43510.32") == dt.datetime(2019, 2, 14, 7, 40, 48)
    assert one("matlab", "737117.593762207") == dt.datetime(2018, 2, 26, 14, 15, 1, 54681)
    assert one("decimalDay", "74.324", year=1995) == dt.datetime(1995, 3, 15, 7, 46, 33, 600000)
    assert one("decimalYear", "2019.938396", decimal_year_start_day=1) == dt.datetime(2019, 12, 8, 12, 20, 56, 256000)
    assert one("decimalYear", "2019.938396", decimal_year_start_day="0") == dt.datetime(2019, 12, 9, 12, 20, 56, 256000)
    assert one("excel", None) is None
    with pytest.raises(StepError):
        one("decimalDay", "1")


def degrees(text, pattern, fmt="degrees-decimal_minutes", **more):
    return values("out", [{"a": text}], step("convert_to_decimal_degrees", {"fields": [{"input_field": "a", "output_field": "out", "format": fmt, "pattern": pattern} | more]}))[0]


def test_degrees():
    p = r"(?P<degrees>-?\d+)° (?P<decimal_minutes>\d+(\.\d+)?)' ?(?P<directional>[NSEW])?"
    assert degrees("14° 24.0' N", p) == D("14.4")
    assert degrees("12° 1' S", p) == D("-12.01666666666666666666666667")
    assert degrees("-0° 30'", p) == D("-0.5") and degrees("10° 30'", p, directional="W") == D("-10.5")
    s = r"(?P<degrees>\d+) (?P<minutes>\d+) (?P<seconds>\d+)"
    assert degrees("10 30 36", s, "degrees-minutes-seconds") == D("10.51")
    assert degrees("10 90 0", s, "degrees-minutes-seconds", handle_out_of_bounds=True) == D("11.5")
    assert degrees("200 0 0", s, "degrees-minutes-seconds", handle_out_of_bounds=True) == D("-160")
    assert degrees(None, s, "degrees-minutes-seconds") is None
    for text in ("10 60 0", "10 0 60", "181 0 0", "nothing"):
        with pytest.raises(Exception, match="60 minutes|60 seconds|more than 180|no match"):
            degrees(text, s, "degrees-minutes-seconds")
    with pytest.raises(StepError):
        degrees("1", r"(\d+)")


def test_fields():
    data = [{"hello": "1", "foo": "2", "col": "3"}]
    r = lambda *steps: Flow(data, *steps).run()["res_1"]
    assert r(step("rename_fields", {"fields": [{"old_field": "foo", "new_field": "bar"}]})).names == ["hello", "bar", "col"]
    assert r(step("rename_fields_regex", {"fields": ["foo", "col"], "pattern": {"find": "o", "replace": "0"}})).names == ["hello", "f00", "c0l"]
    assert r(step("reorder_fields", {"fields": ["col", "hello", "foo"]})).rows() == [{"col": "3", "hello": "1", "foo": "2"}]
    assert r(step("delete_fields", {"fields": ["f.*"]})).names == ["hello", "col"]
    assert r(step("update_fields", {"fields": {"foo": {"title": "T", "place:": {"k": 1}}}})).field("foo")["title"] == "T"
    assert r(step("add_schema_metadata", {"key": "v"})).schema_props["key"] == "v"
    for bad in ({"old_field": "no", "new_field": "x"}, {"old_field": "foo", "new_field": "col"}):
        with pytest.raises(StepError):
            r(step("rename_fields", {"fields": [bad]}))
    with pytest.raises(StepError):
        r(step("reorder_fields", {"fields": ["col", "col", "foo"]}))
    split = {"fields": [{"input_field": "foo", "output_fields": ["x"], "pattern": "(.)", "preserve_metadata": True}]}
    assert r(step("update_fields", {"fields": {"foo": {"place:": {"k": 1}}}}), step("split_column", split)).field("x")["place:"] == {"k": 1}


def test_set_types():
    assert values("col1", NUMBERS[:1], typed()) == [D("4.323")]
    r = Flow([{"dt": "2020-01-01 12:30:00", "n": ""}], step("set_types", {"types": {"d.": {"type": "datetime", "format": "%Y-%m-%d %H:%M:%S"}, "n": {"type": "integer"}}})).run()["res_1"]
    assert r.rows() == [{"dt": dt.datetime(2020, 1, 1, 12, 30), "n": None}] and r.field("dt")["outputFormat"] == "%Y-%m-%d %H:%M:%S"
    assert values("a", [{"a": "true"}, {"a": "0"}], typed("a", "boolean")) == [True, False]
    assert values("a", [{"a": "1,234.5"}], typed("a", "number", groupChar=",")) == [D("1234.5")]
    assert values("a", [{"a": "-9.990e-29"}], typed("a", "number", carrier="double")) == [-9.99e-29]
    with pytest.raises(StepError):
        rows(NUMBERS, typed("nothing"))
    with pytest.raises(Exception, match="(?i)cast"):
        rows([{"col1": "abc"}], typed())


A = [{"k": 1, "v": "a"}, {"k": 1, "v": None}, {"k": 1, "v": "b"}, {"k": 1, "v": "a"}, {"k": None, "v": "n"}, {"k": 3, "v": None}]
B = [{"k2": 1, "v": "old"}, {"k2": 2, "v": "kept"}, {"k2": None, "v": "was"}]


def joined(fields, mode="half-outer", source=A, target=B, sk=("k",), tk=("k2",), **more):
    key = lambda k: list(k) if isinstance(k, tuple) else k
    return rows(source, target, step("join", {"source": {"name": "res_1", "key": key(sk), "delete": True}, "target": {"name": "res_2", "key": key(tk)}, "fields": fields, "mode": mode} | more))


def test_join_modes():
    one = {"v": {"aggregate": "last"}, "n": {"aggregate": "count"}}
    assert joined(one) == [{"k2": 1, "v": "a", "n": 4}, {"k2": 2, "v": "kept", "n": None}, {"k2": None, "v": "n", "n": 1}]
    assert joined(one, "inner") == [{"k2": 1, "v": "a", "n": 4}, {"k2": None, "v": "n", "n": 1}]
    assert joined(one, "full-outer") == [*joined(one), {"k2": 3, "v": None, "n": 1}]
    assert joined(one, "full-outer", sk="{k}", tk="{k2}")[-1] == {"k2": 3, "v": None, "n": 1}
    assert [r["q"] for r in joined({"q": {"name": "v"}}, sk="x{k}", tk="x{k2}")] == ["a", None, "n"]
    assert [r["q"] for r in joined({"q": {"name": "v", "aggregate": "first"}}, sk="{#}", tk="{#}")] == ["a", None, "b"]
    with pytest.raises(StepError):
        joined({"q": {"name": "nothing"}})
    with pytest.raises(StepError):
        joined({"q": {"name": "v", "aggregate": "mode"}})
    with pytest.raises(StepError):
        joined({"v": {"aggregate": "count"}})
    with pytest.raises(StepError):
        rows(A, B, step("join", {"source": {"name": "res_2", "key": ["k2"]}, "target": {"name": "res_1", "key": ["k"]}, "fields": {}}))


def test_join_aggregates():
    data = [{"k": 1, "x": x, "s": s} for x, s in ((3, "b"), (None, "a"), (1, "b"), (4, None), (1, "c"))] + [{"k": 2, "x": None, "s": None}]
    how = {a: {"name": "x", "aggregate": a} for a in ("sum", "avg", "median", "max", "min", "first", "last", "any", "array", "set")} | {"n": {"aggregate": "count"}, "c": {"name": "s", "aggregate": "counters"}}
    out = joined(how, source=data, target=[{"k2": 1}, {"k2": 2}])
    r = out[0]
    assert (r["sum"], float(r["avg"]), float(r["median"]), r["max"], r["min"], r["first"], r["last"], r["any"], r["n"]) == (9, 2.25, 2.0, 4, 1, 3, 1, 1, 5)
    assert r["array"] == [3, 1, 4, 1] and r["set"] == [1, 3, 4]
    assert [(x["value"], x["count"]) for x in r["c"]] == [("b", 2), ("a", 1), ("c", 1)]
    assert {k: v for k, v in out[1].items() if k != "k2"} == {"sum": None, "avg": None, "median": None, "max": None, "min": None, "first": None, "last": None, "any": None, "array": [], "set": [], "n": 1, "c": []}


def test_join_star_and_deduplicate():
    out = rows(A, step("join", {"source": {"name": "res_1", "key": ["k"], "delete": True}, "target": {"name": "res_1", "key": None}, "fields": {"*": {"aggregate": "first"}, "n": {"aggregate": "count"}}}))
    assert out == [{"k": 1, "v": "a", "n": 4}, {"k": None, "v": "n", "n": 1}, {"k": 3, "v": None, "n": 1}]


def test_sort():
    one = lambda data, by, **more: values("a", data, step("sort", {"sort-by": by} | more))
    assert one([{"a": 10}, {"a": 9}, {"a": -1}, {"a": None}, {"a": 0}], "{a}") == [-1, 0, None, 9, 10]
    assert one([{"a": "b"}, {"a": None}, {"a": "A"}], "a") == ["A", None, "b"]
    data = [{"a": k, "b": k % 2} for k in range(6)]
    assert one(data, ["b"]) == [0, 2, 4, 1, 3, 5] and one(data, "{b}", reverse=True) == [5, 3, 1, 4, 2, 0]
    assert one(data, "{b}{a:03d}") == [0, 2, 4, 1, 3, 5]
    assert one(data, lambda r: -F.col("a")) == [5, 4, 3, 2, 1, 0]


def test_concatenate():
    a, b = [{"x": "1", "y": "2"}], [{"z": "3"}, {"z": "4"}]
    cat = lambda **more: rows(a, b, step("concatenate", {"fields": {"f": ["x", "z"], "y": []}} | more))
    assert cat() == [{"f": "1", "y": "2"}, {"f": "3", "y": ""}, {"f": "4", "y": ""}]
    assert [r["src"] for r in cat(include_source_names=[{"type": "resource", "column_name": "src"}])] == ["res_1", "res_2", "res_2"]
    bad = [{"fields": {"f": ["x"], "g": ["x"]}}, {"fields": {"f": []}}, {"fields": {"f": ["nowhere"]}}, {"target": {"name": ""}}, {"target": {"name": "res_1"}}, {"sources": ["none"]}, {"include_source_names": [{"type": "file", "column_name": "y"}]}]
    for one in bad:
        with pytest.raises(StepError):
            cat(**one)
    with pytest.raises(StepError, match="consecutive"):
        rows(a, b, a, step("concatenate", {"fields": {"x": []}, "sources": ["res_1", "res_3"]}))
    sorted_first = rows(a, b, step("sort", {"resources": ["res_2"], "sort-by": "z", "reverse": True}), step("concatenate", {"fields": {"f": ["x", "z"]}}))
    assert [r["f"] for r in sorted_first] == ["1", "4", "3"]


def test_resources():
    data = [{"c": k, "name": f"row{k}"} for k in range(50)]
    p = Flow(data, [{"z": 1}], step("duplicate", {"source": "res_1", "target-name": "copy"})).run()
    assert p.names == ["res_1", "copy", "res_2"] and p["copy"].rows() == p["res_1"].rows() == data
    assert Flow(data, [{"z": 1}], step("duplicate", {"source": "res_1", "multi": True, "target_names": ["a", "b"], "duplicate_to_end": True})).run().names == ["res_1", "res_2", "a", "b"]
    assert Flow(data, step("duplicate", {"multi": True, "target_names": []})).run().names == ["res_1"]
    assert Flow(data, [{"z": 1}], step("remove_resources", {"resources": ["res_1"]})).run().names == ["res_2"]
    assert Flow(data, step("rename_resource", {"old_resource": "res_1", "new_resource": "new"})).run()["new"].descriptor["path"] == "new.csv"
    assert Flow(data, step("update_package", {"title": "t"})).run().meta == {"title": "t"}
    assert Flow(data, step("update_resource", {"metadata": {"k": "v"}})).run()["res_1"].descriptor["k"] == "v"
    for name, parameters in (("remove_resources", {"resources": ["q"]}), ("rename_resource", {"old_resource": "q", "new_resource": "r"}), ("duplicate", {"source": "q"})):
        with pytest.raises(StepError):
            Flow(data, step(name, parameters)).run()


def test_unpivot():
    spec = {"unpivot": [{"name": r"value_(\d+)", "keys": {"year": r"\1"}}], "extraKeyFields": [{"name": "year", "type": "integer"}], "extraValueField": {"name": "value", "type": "number"}}
    out = rows([{"id": "a", "value_1999": "1.5", "value_2000": ""}, {"id": "b", "value_1999": "2", "value_2000": "3"}], step("unpivot", spec))
    assert out == [{"id": "a", "year": 1999, "value": D("1.5")}, {"id": "a", "year": 2000, "value": None}, {"id": "b", "year": 1999, "value": D(2)}, {"id": "b", "year": 2000, "value": D(3)}]


def test_specs():
    spec = """
    clean:
      pipeline:
        - run: some_library.inline
          parameters: {rows: [{a: "1"}, {a: "2"}], name: t}
        - run: set_types
          parameters: {types: {a: {type: integer}}}
        - run: boolean_filter_rows
          parameters: {boolean_statement: "{a} > 1", cache_id: x}
    """
    assert run_spec(spec)["t"].rows() == [{"a": 2}]
    assert from_spec({"pipeline": [{"run": "inline", "parameters": {"rows": [{"a": 1}]}}]}).run()["res_1"].rows() == [{"a": 1}]
    for bad in ([{"run": "nothing"}], [{"run": "sort", "parameters": {"sort-by": "a"}}, {"run": "edit_cells", "parameters": {"rows": 1}}], [{"run": "join", "parameters": {}}]):
        with pytest.raises(StepError):
            from_spec(bad)


def test_selecting_resources():
    p = Flow([{"a": "1"}], [{"a": "1"}], [{"a": "1"}]).run()
    assert p.selected(None) == p.names and p.selected(["res_2"]) == ["res_2"] and p.selected("res_[13]") == ["res_1", "res_3"] and p.selected("res") == []
