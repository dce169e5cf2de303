"""Values in, values out: one table per column function."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tributary import functions as fn
from tributary.types import as_type


def values(spark, rows, kind, *exprs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i int, x {kind}")
    return [tuple(r)[1:] for r in df.select("i", *exprs).orderBy("i").collect()]


def one(spark, rows, kind, expr):
    return [r[0] for r in values(spark, rows, kind, expr.on("x") if isinstance(expr, fn.Expr) else expr)]


def test_to_int(spark):
    given = ["000123456", "1234.56", "-1234.56", "123_456", "123,456", " 123456  ", "2k", "", None, "3000000000"]
    assert one(spark, given, "string", fn.to_int()) == [123456, 1235, -1235, 123456, None, 123456, None, None, None, None]


def test_to_long_is_exact_beyond_doubles(spark):
    assert one(spark, ["21_474_836_470", "214748364.70", "9007199254740993"], "string", fn.to_long()) == [21474836470, 214748365, 9007199254740993]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_to_float_and_double(spark, kind):
    f = fn.to_float if kind == "float" else fn.to_double
    assert one(spark, ["123_456.5", "2k", "NULL", None, "-0.25"], "string", f()) == [123456.5, None, None, None, -0.25]


def test_to_num_casts(spark):
    assert one(spark, ["70000", "12.5"], "string", fn.to_num(cast="smallint")) == [None, 13]
    assert one(spark, [" 1_0 "], "string", fn.to_num(cast="string")) == ["10"]
    assert str(one(spark, ["123456789012345678.25"], "string", fn.to_num(cast="decimal(20,2)"))[0]) == "123456789012345678.25"


def test_meters_to_cm(spark):
    assert one(spark, ["1.80", "-1.0", "2.", "one", None, "2.05"], "string", fn.meters_to_cm()) == [180, -100, 200, None, None, 205]
    assert one(spark, ["2.05"], "string", fn.meters_to_cm(cast="long")) == [205]


def test_to_bool(spark):
    given = ["1", "1.0", "y", "n", " true  ", "-1", "ENABLED", "Off", "maybe", None, "0"]
    assert one(spark, given, "string", fn.to_bool()) == [True, None, True, False, True, None, True, False, None, None, False]


def test_to_bool_own_words(spark):
    own = fn.to_bool(true_values=["Sure", "OK"], false_values=["Nope", "NOK"])
    assert one(spark, ["sure", "ok", "NOPE", "nok", "surely", "on"], "string", own) == [True, True, False, False, None, True]
    only = fn.to_bool(true_values=["Sure"], replace_default_values=True, case_sensitive=True)
    assert one(spark, ["Sure", "sure", "on", "off"], "string", only) == [True, None, None, False]
    assert one(spark, [0, 1, 2], "int", fn.to_bool()) == [False, True, None]


def test_has_value(spark):
    assert one(spark, ["", None, "0", "false", " "], "string", fn.has_value()) == [False, False, True, True, True]
    assert one(spark, [0, None], "int", fn.has_value()) == [True, False]


def test_to_timestamp(spark):
    as_text = fn.to_timestamp(output_format="yyyy-MM-dd HH:mm:ss.SSS")
    given = [
        "2020-08-12T12:43:14+0000", "2020-08-12T12:43:14+0200", "2020-08-12 12:43:14", "1597069446", "1597069446002", " 1597069446 ",
        "-1597069446", "0", "1.547035982469E12", "5355957305054330880", "Hello", None,
    ]
    expected = [
        "2020-08-12 12:43:14.000", "2020-08-12 10:43:14.000", "2020-08-12 12:43:14.000", "2020-08-10 14:24:06.000", "2020-08-10 14:24:06.002",
        "2020-08-10 14:24:06.000", "1919-05-24 09:35:54.000", "1970-01-01 00:00:00.000", None, None, None, None,
    ]
    assert one(spark, given, "string", as_text) == expected


def test_to_timestamp_options(spark):
    assert one(spark, ["20201224", "20201324"], "string", fn.to_timestamp(input_format="yyyyMMdd", cast="date")) == [date(2020, 12, 24), None]
    low = fn.to_timestamp(max_timestamp_sec=1608685200, output_format="yyyy-MM-dd HH:mm:ss.SSS")
    assert one(spark, [1608840455], "bigint", low) == ["1970-01-19 14:54:00.455"]
    edge = fn.to_timestamp(output_format="yyyy-MM-dd HH:mm")
    assert one(spark, [-62135514321000, -62135514321001, 253402210800000, 253402210800001], "bigint", edge) == ["0001-01-01 22:54", None, "9999-12-30 23:00", None]
    assert one(spark, [date(2020, 5, 1)], "date", fn.to_timestamp(cast="timestamp_ntz")) == [datetime(2020, 5, 1)]


def test_str_to_array(spark):
    assert one(spark, ["[1,2,3]", " []", "1,  2   ,  test", "2.4,2.5", None], "string", fn.str_to_array(cast="int")) == [[1, 2, 3], [None], [1, 2, None], [2, 3], None]
    assert one(spark, ["[a,[b],c]", " []", "a, b"], "string", fn.str_to_array()) == [["a", "[b]", "c"], [""], ["a", "b"]]
    assert one(spark, ["9007199254740993,1.5"], "string", fn.str_to_array(cast="long")) == [[9007199254740993, 2]]
    assert one(spark, ["a,b:c"], "string", fn.str_to_array(sep=":")) == [["a,b", "c"]]
    assert one(spark, ["a|b"], "string", fn.str_to_array(sep="|")) == [["a", "b"]]


def test_map_values(spark):
    rules = {"Allowed": True, "x": "y"}
    assert one(spark, ["allowed", "Else", None, "X"], "string", fn.map_values(mapping=rules)) == ["true", "Else", None, "y"]
    assert one(spark, ["allowed", "Allowed"], "string", fn.map_values(mapping=rules, ignore_case=False, default=None)) == [None, "true"]
    assert one(spark, ["whitelisted", "blacklisted"], "string", fn.map_values(mapping={"white%": "w", "%list%": "l"}, pattern_type="sql_like")) == ["w", "l"]
    assert one(spark, ["White", "black"], "string", fn.map_values(mapping={"^wh": 1, "(?i)WH": 2}, pattern_type="regex", default="7", cast="long")) == [2, 7]
    assert one(spark, [0, 1, 9], "int", fn.map_values(mapping={0: "bad", 1: "ok"}, default="none")) == ["bad", "ok", "none"]
    with pytest.raises(ValueError):
        fn.map_values("x", mapping={})
    with pytest.raises(ValueError):
        fn.map_values("x", mapping={"a": 1}, pattern_type="glob")


def test_to_json_string(spark):
    kind = "struct<a:int,b:string,c:array<struct<d:int>>>"
    assert one(spark, [(1, None, [(2,), None]), None], kind, fn.to_json_string()) == ['{"a":1,"b":null,"c":[{"d":2},null]}', None]
    assert one(spark, ["text", "", None, "[]"], "string", fn.to_json_string()) == ["text", None, None, "[]"]
    assert one(spark, [0, 5], "int", fn.to_json_string()) == [None, "5"]
    assert one(spark, [[], ["x"]], "array<string>", fn.to_json_string()) == [None, '["x"]']
    assert one(spark, [(1, "é", [])], kind, fn.to_json_string(python_style=True)) == ['{"a": 1, "b": "\\u00e9", "c": []}']
    assert one(spark, [["G", "A"]], "array<string>", fn.to_json_string(python_style=True)) == ["['G', 'A']"]


def test_text_and_apply(spark):
    assert one(spark, [True, None], "boolean", fn.to_str()) == ["true", None]
    assert one(spark, [" A "], "string", fn.to_str()) == [" A "]
    assert one(spark, ["AbC"], "string", fn.apply(func=F.lower)) == ["abc"]
    assert one(spark, ["12", "x"], "string", fn.apply(func=lambda c: c, cast="int")) == [12, None]
    assert one(spark, ["7"], "string", fn.as_is(cast="int")) == [7]


def test_calling_styles_and_names(spark):
    df = spark.createDataFrame([(None, "5", ("7",))], "a string, b string, s struct<c:string>")
    row = df.select(
        fn.to_int("s.c"), fn.to_int(F.col("b")), fn.to_int("a", "with_name", alt_src_cols=["s.c", "b"]), fn.to_int(F.col("b").alias("z")),
        fn.to_int("a", alt_src_cols="b"),
    )
    assert row.columns == ["c", "b", "with_name", "z", "a"]
    assert tuple(row.first()) == (7, 5, 7, 5, 5)


def test_an_expr_is_reusable(spark):
    shared = fn.to_int(alt_src_cols="b")
    df = spark.createDataFrame([(None, "5", "9")], "a string, b string, c string")
    assert tuple(df.select(shared.on("a"), shared.on("c")).first()) == (5, 9)


@pytest.mark.parametrize("given, expected", [("int", "int"), ("IntegerType", "int"), ("IntegerType()", "int"), ("long", "bigint"), ("null", "void"), ("array<struct<a:int>>", "array<struct<a:int>>")])
def test_type_names(spark, given, expected):
    assert as_type(given).simpleString() == expected
    with pytest.raises(TypeError):
        as_type("ArrayType")
