"""Operators for nested records, drift, profiles, increments, packed values and instants: edge cases and plain versions."""

import json
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests import brute
from tributary import preparation_queries as queries
from tributary.operators import drift
from tributary.operators.drift import file_unions, rename_groups, schema_changes, unify
from tributary.operators.instants import InstantDictionary, normalise, parse_instants
from tributary.operators.intervals import IntervalStore, merge_table, newest_cover, not_covered, present_ranges, unread_changes
from tributary.operators.nested import flatten_records
from tributary.operators.packed import infer_delimiters, split_packed
from tributary.operators.profile import ColumnRule, Profile
from tributary.runtime import materialise

KIND = "id long, extra string, r struct<s:string,n:double,l:array<struct<k:string,m:map<string,int>,l:array<struct<v:int>>>>,tags:array<string>>"


def nested(spark, rows):
    return spark.createDataFrame(rows, KIND)


def bridge_of(df):
    return sorted((r.record_key, r.path, tuple(r.ordinals)) for r in df.collect())


DEEP = ("a", 1.5, [("x", {"p": 1, "q": 2}, [(1,), None, (2,)]), None, (None, None, None)], ["t"])


def test_nested_occurrences_and_ordinals(spark):
    tables = flatten_records(nested(spark, [(1, "e", DEEP), (2, "e", None), (3, "e", (None, None, None, None)), (4, "e", ("a", 1.5, [], []))]), "id", ["r"])
    assert bridge_of(tables.bridge) == [
        (1, "r", ()), (1, "r.l", (0,)), (1, "r.l", (2,)), (1, "r.l.l", (0, 0)), (1, "r.l.l", (0, 2)), (3, "r", ()), (4, "r", ()),
    ]


def test_nested_objects_are_stored_once_and_linked(spark):
    tables = flatten_records(nested(spark, [(1, "e", DEEP), (2, "f", DEEP), (2, "f", DEEP)]), "id", ["r"])
    assert tables.objects("r").count() == 1 and tables.objects("r.l").count() == 2 and sorted(r.v for r in tables.objects("r.l.l").collect()) == [1, 2]
    bridge = tables.bridge.collect()
    assert len(bridge) == 10 and {r.identity for r in bridge if r.record_key == 1} == {r.identity for r in bridge if r.record_key == 2}
    parents = {r.identity: r.parent_identity for r in bridge if r.path == "r.l.l"}
    assert set(parents.values()) <= {r.identity for r in bridge if r.path == "r.l"}
    assert set(tables.objects("r").columns) == {"identity", "s", "n", "l_identity", "tags"}


def test_nested_identity_tells_contents_apart(spark):
    one = lambda *r: flatten_records(nested(spark, [(1, "e", r)]), "id", ["r"]).bridge.where("path = 'r'").first().identity
    variants = [("a", 1.5, None, None), ("a", 1.5, [], None), ("a", 1.5, [None], None), (None, 1.5, None, None), ("~", 1.5, None, None), ("a", None, None, None), ("a", 1.5, None, ["x", "y"]), ("a", 1.5, None, ["x,y"])]
    assert len({one(*v) for v in variants}) == len(variants)
    maps = [("a", 1.0, [("k", {"p": 1, "q": 2}, None)], None), ("a", 1.0, [("k", {"q": 2, "p": 1}, None)], None)]
    assert one(*maps[0]) == one(*maps[1])


def test_nested_identity_tells_types_apart(spark):
    one = lambda kind, v: flatten_records(spark.createDataFrame([(1, (v,))], f"id int, r struct<n:{kind}>"), "id", ["r"]).bridge.first().identity
    assert len({one("int", 1), one("string", "1"), one("bigint", 1)}) == 3 and one("int", 1) == one("int", 1)


def test_nested_empty_null_keys_and_odd_names(spark):
    assert bridge_of(flatten_records(nested(spark, []), "id", ["r"]).bridge) == []
    tables = flatten_records(nested(spark, [(None, "e", DEEP), (None, "e", DEEP), (None, "e", ("b", 0.0, None, None))]), "id", ["r"])
    assert tables.bridge.where("path = 'r'").count() == 2
    clash = nested(spark, [(1, "e", DEEP)]).withColumnRenamed("extra", "record_key").withColumn("all", F.lit(1)).withColumn("path", F.lit("x"))
    assert flatten_records(clash, "id", ["r"]).bridge.count() == 5
    dotted = flatten_records(nested(spark, [(1, "e", DEEP)]).withColumnRenamed("r", "r.x"), "id", ["r.x"]).bridge
    assert {(r.path, r.parent_path) for r in dotted.collect()} == {("r.x", ""), ("r.x.l", "r.x"), ("r.x.l.l", "r.x.l")}
    with pytest.raises(ValueError):
        flatten_records(nested(spark, []), "id", ["extra"])


def test_nested_long_arrays(spark):
    long = ("a", 1.0, [(str(i), None, [(i,)]) for i in range(20_000)], None)
    assert flatten_records(nested(spark, [(1, "e", long)]), "id", ["r"]).bridge.count() == 40_001


# drift


def changes(spark, rows):
    df = spark.createDataFrame(rows, "feed int, file int, payload string")
    return {tuple(r) for r in schema_changes(df, "feed", "file", "payload", "attributes", "id").collect()}


def line(i, **attributes):
    return json.dumps({"id": i, "attributes": attributes})


def test_drift_edge_cases(spark):
    rows = [
        (1, 1, line(1, a="x", b=1, o={"p": 1}, f=[{"g": 1}, None], n=None)), (1, 1, line(2, a="y", b=2, f=[])), (1, 1, '{"id": 3, "attr'), (1, 1, None), (1, 1, ""), (1, 1, "[1]"), (1, 1, '{"id": 9}'),
        (1, 4, line(1, c="x", b="1", o={"q": 1}, f=[{"h": 1}, None], n=5)), (1, 4, line(1, c="x", b="1", o={"q": 1}, f=[{"h": 1}, None], n=5)), (1, 4, line(2, c="z")),
        (2, 1, line(1, z=1)), (3, 1, None), (3, 2, line(1, a=1)),
    ]
    got = changes(spark, rows)
    assert got == brute.drift(rows)
    assert (1, 4, "renamed", "attributes.o.q", "attributes.o.p") in got and (1, 4, "renamed", "attributes.f[].h", "attributes.f[].g") in got
    assert (1, 4, "removed", "attributes.a", "") in got and (1, 4, "added", "attributes.c", "") in got
    assert (1, 4, "type_changed", "attributes.b", "") in got and not any(c[3] == "attributes.n" for c in got)
    assert changes(spark, []) == set()
    deep = '{"id": 1, "attributes": ' + '{"a":' * 3000 + "1" + "}" * 3001
    long = line(1, a="x" * 300_000, b=[{"c": i} for i in range(5000)])
    nested = {(1, 2, "removed", "attributes" + ".a" * k, "") for k in range(1, 3001)}
    assert changes(spark, [(1, 1, deep), (1, 1, '{"id": 1, "attributes": {"z": NaN}}'), (1, 1, long), (1, 2, line(1, d="x" * 300_000, b=[]))]) == nested | {
        (1, 2, "added", "attributes.d", ""), (1, 2, "removed", "attributes.b[].c", ""),
    }
    assert changes(spark, [(1, 1, long), (1, 2, line(1, d="x" * 300_000, b=[]))]) == {
        (1, 2, "renamed", "attributes.d", "attributes.a"), (1, 2, "removed", "attributes.b[].c", ""),
    }


@settings(max_examples=300, deadline=None)
@given(st.one_of(
    st.recursive(st.one_of(st.none(), st.booleans(), st.integers(), st.floats(allow_nan=False, allow_infinity=False), st.text()), lambda x: st.lists(x) | st.dictionaries(st.text(), x)).map(json.dumps),
    st.text(alphabet='{}[]",:0123456789-+.eE ntrfalsu\\\n\t', max_size=30),
))
def test_deep_parser_reads_what_the_other_reads(text):
    def read(parse):
        try:
            return repr(parse(text))
        except ValueError:
            return ValueError

    want = read(lambda t: json.loads(t, parse_constant=drift._no_number, parse_float=drift._number))
    assert read(drift._deep) == want


def test_very_deep_lines():
    for opened, closed in (('{"a":', "}"), ("[", "]"), ('[{"b":', "}]")):
        text = '{"x":' + opened * 50_000 + "1" + closed * 50_000 + "}"
        assert drift._document(text) is not None and drift._document(text[:-1]) is None and drift._document(text + "]") is None
        assert len(drift._json_text(drift._document(text), "", {})) == len(text)
    assert drift._document('{"a":' + "9" * 5000 + "}")["a"].text == "9" * 5000 and drift._document('{"a": -01}') is None


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 2), st.integers(1, 3), st.integers(1, 3), st.dictionaries(st.sampled_from("abc"), st.one_of(st.none(), st.booleans(), st.integers(0, 1), st.sampled_from(["", "u"]), st.lists(st.dictionaries(st.sampled_from("xy"), st.integers(0, 1)), max_size=2)), max_size=3)), max_size=12))
def test_drift_as_plain(spark, drawn):
    rows = [(feed, file, json.dumps({"id": i, "attributes": a})) for feed, file, i, a in drawn]
    assert changes(spark, rows) == brute.drift(rows)


def test_drift_on_the_tables(spark, small):
    got = [tuple(r) for r in queries.p2_found(spark, small).collect()]
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/raw_records.parquet").select("feed_nr", "file_nr", "payload").collect()]
    assert len(got) == len(set(got)) and set(got) == brute.drift(rows)


def test_unify(spark):
    rows = [(1, 1, line(1, a="x", Id=True)), (1, 1, line(2, a="y", b=1.5)), (1, 2, line(1, c="x", b="t", id=3)), (1, 2, line(2, c="y")), (1, 2, "broken")]
    df = spark.createDataFrame(rows, "feed int, file int, payload string")
    out = unify(df, ["feed", "file"], "payload", "attributes", "id", "feed", "file")
    assert out.columns == ["feed", "file", "id", "Id__2", "a", "b", "b__string", "b__number", "id__3"]
    assert sorted((r.file, r.id, r.a, r.b, r.b__string, r.b__number) for r in out.collect()) == [
        (1, "1", "x", None, None, None), (1, "2", "y", "1.5", None, 1.5), (2, "1", "x", "t", "t", None), (2, "2", "y", None, None, None),
    ]


def test_unify_nested_paths(spark):
    rows = [
        (1, 1, line(1, f=[{"name": "x", "n": 1, "c": [{"v": 1}, {}]}, None, {"name": "y"}], o={"p": "u"})), (1, 1, line(2, f=[], o={"p": "w", "big": 0.12345678901234567890123})),
        (1, 2, line(1, f=[{"fn": "x", "n": "2", "c": [{"w": 1}, {}]}, None, {"fn": "y"}], place={"p": "u"})), (1, 2, line(2, f=None, place={"p": "w", "big": 0.12345678901234567890123})),
        (1, 3, line(1, place={"q": "u"}, f=[{"n": 1.50}])), (1, 3, line(2, place={"q": "w"})),
    ]
    df = spark.createDataFrame(rows, "feed int, file int, payload string")
    out = unify(df, ["file"], "payload", "attributes", "id", "feed", "file")
    assert out.columns == ["file", "id", "f", "f[].c", "f[].c[].v", "f[].n", "f[].n__string", "f[].n__number", "f[].name", "o", "o.big", "o.p"]
    got = {(r["file"], r["id"]): r for r in out.collect()}
    assert [got[k, "1"]["f[].name"] for k in (1, 2, 3)] == [["x", None, "y"], ["x", None, "y"], None]
    assert got[2, "1"]["f[].c[].v"] == [["1", None], None, None] and got[2, "1"]["f[].c"] == ['[{"v":1},{}]', None, None]
    assert [got[k, "1"]["f[].n"] for k in (1, 2, 3)] == [["1", None, None], ["2", None, None], ["1.5"]]
    assert [got[k, "1"]["f[].n__number"] for k in (1, 2, 3)] == [[1.0, None, None], None, [1.5]]
    assert got[2, "1"]["f[].n__string"] == ["2", None, None] and [got[k, "2"]["o.p"] for k in (1, 2, 3)] == ["w"] * 3
    assert got[2, "1"]["f"] == '[{"c":[{"v":1},{}],"n":"2","name":"x"},null,{"name":"y"}]' and got[3, "1"]["o"] == '{"p":"u"}'
    assert got[2, "2"]["f"] is None and got[1, "2"]["f"] == "[]" and got[1, "2"]["f[].name"] is None


def test_table_and_report_read_the_same_lines(spark):
    deep = '{"id": 4, "attributes": ' + '{"d":' * 500 + "1" + "}" * 501
    lines = ['{"id": 1, "attributes": {"a": 9007199254740993, "a": 9007199254740993}}', line(2, a=9007199254740993), line(3, a="x"), line(5, a=0.1), line(6, a=10**25), line(7, a=1e300), deep, '{"id": 8, "attr']
    rows = [(1, 1, x) for x in lines] + [(1, 2, line(1, a=1))]
    df = spark.createDataFrame(rows, "feed int, file int, payload string")
    out = unify(df, ["feed", "file"], "payload", "attributes", "id", "feed", "file", exact_numbers=True)
    got = {r["id"]: r for r in out.where("file = 1").collect()}
    assert set(got) == set("1234567") and len(out.columns) > 500
    assert got["1"].a == got["2"].a == "9007199254740993" and got["2"].a__integer == 9007199254740993 and got["2"].a__decimal == 9007199254740993
    assert got["3"].a__string == "x" and str(got["5"].a__decimal).rstrip("0") == "0.1" and got["5"].a__integer is None and got["5"].a__number == 0.1
    assert str(got["6"].a__decimal) == "None" and got["6"].a == "1" + "0" * 25 and got["7"].a__number == 1e300 and got["7"].a__integer is None
    assert got["4"]["d" + ".d" * 499] == "1"
    paths = file_unions(df, "feed", "file", "payload", "attributes").where("file = 1").first().paths
    assert "attributes" + ".d" * 500 in paths and paths["attributes.a"] == 3


def test_renames_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(drift, "MAX_SIDES", 0)
    rows = [(1, f, line(i, **{"a" if f == 1 else "b": i, "c": [{"x": i} if f == 1 else {"y": i}, None]})) for f in (1, 2) for i in range(50)] * 3
    assert changes(spark, rows) == {(1, 2, "renamed", "attributes.b", "attributes.a"), (1, 2, "renamed", "attributes.c[].y", "attributes.c[].x")}


def test_many_files_with_renames_are_not_sent_to_the_driver(spark, monkeypatch):
    monkeypatch.setattr(drift, "MAX_SIDES", 0)
    rows = [(1, f, line(i, **{"a" if f == 1 else "b": i})) for f in (1, 2) for i in range(50)]
    df = spark.createDataFrame(rows, "feed int, file int, payload string")
    files = materialise(drift.neighbour_changes(file_unions(df, "feed", "file", "payload", "attributes")))
    for heavy in (20_000, 10):
        monkeypatch.setattr(drift, "HEAVY", heavy)
        found = drift._renames(df, files, "feed", "file", "payload", "id")
        assert re.search(r"SortMergeJoin \[feed#\w+, at#\w+, salt#\w+\]", found._jdf.queryExecution().executedPlan().toString())
        assert found.collect() == [(1, 2, "attributes.b", "attributes.a")]


def test_names_used_at_once_stay_apart(spark):
    rows = [(1, 1, line(1, a="x")), (1, 2, line(1, b="x")), (2, 1, line(1, a="p", b="q"))]
    df = spark.createDataFrame(rows, "feed int, file int, payload string")
    found = schema_changes(df, "feed", "file", "payload", "attributes", "id")
    assert rename_groups(file_unions(df, "feed", "file", "payload", "attributes"), found, "attributes") == []


def test_renames_are_not_left_out(spark):
    rows = [(1, 1, line(1, a="x", b="y")), (1, 2, line(1, c="x", d="y"))]
    df = spark.createDataFrame(rows, "feed int, file int, payload string")
    unions, found = file_unions(df, "feed", "file", "payload", "attributes"), schema_changes(df, "feed", "file", "payload", "attributes", "id")
    assert sorted(rename_groups(unions, found, "attributes", 4)) == [["a", "c"], ["b", "d"]]
    with pytest.raises(ValueError, match="renamed names"):
        rename_groups(unions, found, "attributes", 1)


# profile


def profile(spark, rows, rules):
    return Profile(spark.createDataFrame(rows, "dt int, nr long, v string, n int, load string"), "dt", "nr", rules)


RULES = [ColumnRule("v", form=r"[a-z]+[0-9]*"), ColumnRule("n", lowest=1, highest=9, distribution=True)]


def test_profile_rows_and_loads(spark):
    rows = [(1, i, f"ab{i}", i % 9 + 1, None) for i in range(90)] + [(2, 100 + i, None if i < 50 else f"AB {i}", 9 if i < 60 else None if i < 70 else 12, None) for i in range(90)]
    p = profile(spark, rows, RULES)
    got = {tuple(r) for r in p.findings().collect()}
    expected = {(2, "v", "pattern", 100 + i) for i in range(50, 90)} | {(2, "n", "range", 100 + i) for i in range(70, 90)}
    assert got == expected | {(2, "v", "null_rate", 0), (2, "n", "distribution", 0)}
    assert {e.verdict for e in p.model} == {"inside", "outside"}
    assert all(re.fullmatch(e.regex, v) for e in p.model if e.verdict == "inside" for v in ["ab7"])
    shares = {(r.load, r.expression): r.share for r in p.coverage().collect()}
    assert sum(s for (load, _), s in shares.items() if load == 1) == pytest.approx(1)


def test_profile_edges(spark):
    assert profile(spark, [], RULES).findings().collect() == []
    same = profile(spark, [(None, 1, None, None, "x"), (5, 2, "", 1, "x"), (5, 2, "", 1, "x"), (5, 3, "x" * 200_000, 1, "x")], RULES)
    assert sorted(tuple(r) for r in same.row_findings().collect()) == [(5, "v", "pattern", 2), (5, "v", "pattern", 2)]
    odd = [ColumnRule("v", form=queries.MOCK_RULES[0].form)]
    chain = "a@b" + ".c" * 100_000
    assert profile(spark, [(1, 1, chain, 1, ""), (1, 2, chain + "!", 1, ""), (1, 3, "." * 100_000, 1, "")], odd).row_findings().count() == 2
    assert {tuple(r)[1:3] for r in same.load_findings().collect()} == {("v", "null_rate"), ("n", "null_rate")}


def test_distributions_over_all_magnitudes(spark):
    rng = random.Random(4)
    draw = lambda shift: [rng.choice([-1, 1]) * 10 ** rng.uniform(-9, 9) + shift for _ in range(400)] + [0.0, 1.0, 2.0, 4.0, float("inf"), float("nan")]
    loads = [draw(0), draw(0), [abs(v) for v in draw(0)], draw(1e9), draw(0)]
    df = spark.createDataFrame([(i, k, v) for i, vs in enumerate(loads) for k, v in enumerate(vs)], "dt int, nr long, v double")
    got = {r.load for r in Profile(df, "dt", "nr", [ColumnRule("v", distribution=True)]).load_findings().collect()}

    def apart(a, b):
        a, b = ([v for v in x if v == v] for x in (a, b))
        return any(abs(sum(v <= at for v in a) * len(b) - sum(v <= at for v in b) * len(a)) * 4 > len(a) * len(b) for at in [*a, *b])

    assert got == {i for i in range(1, 5) if apart(loads[i - 1], loads[i])} == {2, 3, 4}


def test_induced_expressions_are_few_and_cover_all(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcXYZ019.-_@ é") for _ in range(rng.randint(0, 12))) for _ in range(3000)] + [f"user{i}@mail.org" for i in range(3000)]
    df = spark.createDataFrame([(1, i, w, 1, None) for i, w in enumerate(words)], "dt int, nr long, v string, n int, load string")
    p = Profile(df, "dt", "nr", [ColumnRule("v", form=r"[a-z0-9]+@[a-z]+\.org")])
    assert len(p.model) <= 256 and sum(e.values for e in p.model) == len(set(words))
    bad = {r.key for r in p.row_findings().collect()}
    assert bad == {i for i, w in enumerate(words) if not re.fullmatch(r"[a-z0-9]+@[a-z]+\.org", w)}
    assert p.coverage().agg(F.sum("n_rows")).first()[0] == len(words)


def test_coverage_has_every_expression_in_every_load(spark):
    words = {None: "1", 1: "a1", 2: "", 3: "a", 4: "1"}  # forms in each load; the column of load 2 is NULL
    rows = [(load, 10 * i + k, f"{'ab' if f == 'a' else 1000 + i * 20 + k}", 1, None) for i, (load, forms) in enumerate(words.items()) for k, f in enumerate(forms * 8)] + [(2, 99, None, 1, None)]
    found = profile(spark, rows, RULES).coverage().collect()
    got = {(r.load, r.expression): (r.n_rows, r.share, r.change) for r in found}
    assert len(found) == len(got) == 10
    assert [got[load, "[a-z]+"] for load in words] == [(0, 0, None), (8, 0.5, 0.5), (0, 0, -0.5), (8, 1, 1), (0, 0, -1)]
    assert [got[load, "[0-9]+"] for load in words] == [(8, 1, None), (8, 0.5, -0.5), (0, 0, -0.5), (0, 0, 0), (8, 1, 1)]


def test_ranges_are_those_of_the_values(spark):
    rows = [(1, i, v, n, d, f"w{i}") for i, (v, n, d) in enumerate([("9", 9, 9.5), ("-144.5", -144, -0.5), ("-1000", -2147483648, float("nan")), ("10.50", 2147483647, 1e10), ("x", None, None), ("NaN", 40, 100.0), (None, 1, -7.0)])]
    df = spark.createDataFrame([*rows, (2, 9, "x", None, float("nan"), None)], "dt int, nr long, v string, n int, d double, w string")
    rules = [ColumnRule("v", form=r"-?[0-9]+(?:\.[0-9]+)?", lowest=-90, highest=90), ColumnRule("n"), ColumnRule("d"), ColumnRule("w")]
    got = {(r.load, r.column_name): r for r in Profile(df, "dt", "nr", rules).aggregates().collect()}
    assert {c: (got[1, c].lowest, got[1, c].highest) for c in "vndw"} == {"v": ("-1000", "10.50"), "n": ("-2147483648", "2147483647"), "d": ("-7.0", "1.0E10"), "w": ("w0", "w6")}
    assert (got[1, "n"].first_text, got[1, "n"].last_text, got[1, "n"].n_null) == ("-144", "9", 1)
    assert all((got[2, c].lowest, got[2, c].highest) == (None, None) for c in "vndw") and got[2, "v"].n_distinct == 1
    bare = Profile(df, "dt", "nr", [ColumnRule("v", highest=90)]).aggregates().where("load = 1").first()
    assert (bare.lowest, bare.highest) == ("-1000", "10.50")


def test_findings_come_from_the_induced_expressions(spark, monkeypatch):
    rows = [(1, i, f"ab{i}", 1, None) for i in range(50)] + [(1, 90 + i, f"A{i}", 1, None) for i in range(9)]
    assert {r.key for r in profile(spark, rows, RULES).row_findings().collect()} == set(range(90, 99))
    off = profile(spark, rows, RULES)
    monkeypatch.setattr(Profile, "model", [])
    assert off.row_findings().count() == 0


def test_words_of_a_mixed_shape_are_spelled_out(spark):
    rows = [(1, i, w, 1, None) for i, w in enumerate(["F", "M", "W", "X", "f", "no", None] * 3)]
    p = profile(spark, rows, [ColumnRule("v", form="[FM]")])
    assert {(e.words, e.verdict) for e in p.model if e.words} == {(("F", "M"), "inside"), (("W", "X"), "outside")}
    assert {(r.expression, r.verdict) for r in p.expressions().collect()} >= {("[A-Z]+", "mixed")}
    assert {r.key % 7 for r in p.row_findings().collect()} == {2, 3, 4, 5}


def test_rows_depart_from_the_expressions_of_the_load_before(spark):
    load = lambda dt, *words: [(dt, 1000 * dt + 100 * k + i, f"{w}{i}", 1, None) for k, w in enumerate(words) for i in range(40)]
    rows = load(1, "ab", "ab") + load(2, "ab", "x-") + load(3, "x-", "Q ") + [(3, 9999, None, 1, None), (4, 4000, None, 1, None)] + load(5, "z")
    p = profile(spark, rows, RULES)
    got = {(r.load, r.key // 100 % 10, r.expression) for r in p.departures().collect()}
    assert got == {(2, 1, "[a-z]+\\-[0-9]+"), (3, 1, "[A-Z]+ [0-9]+")}
    moved = {(r.load, r.finding, r.expression) for r in p.coverage_findings(0.1).collect()}
    assert {(2, "appeared", "[a-z]+\\-[0-9]+"), (2, "fallen", "[a-z]+[0-9]+"), (3, "vanished", "[a-z]+[0-9]+"), (5, "appeared", "[a-z]+[0-9]+")} <= moved
    none = profile(spark, [], RULES)
    assert none.departures().count() == none.coverage_findings().count() == none.expressions().count() == 0


# increments


def test_unread_changes(spark):
    rows = spark.createDataFrame(
        [(1, 10, 1, "x"), (1, 10, 2, "x"), (2, 11, 1, "x"), (3, 12, 2, "x"), (4, None, 1, "x"), (5, 30, 3, "x"), (None, 12, 2, "x"), (6, 12, 2, "x"), (6, 12, 2, "x")],
        "id int, at long, dt int, lo string",
    )
    log = spark.createDataFrame([(1, 5, 10), (1, 5, 10), (3, 30, 30), (3, 9, 4), (2, None, 99), (1, 12, 12)], "dt int, lo long, hi long")
    got = {tuple(r) for r in unread_changes(rows, ["id", "at"], "dt", "at", log, "dt", "lo", "hi").collect()}
    assert got == {(2, 11), (3, 12), (None, 12), (6, 12)}
    lost = spark.createDataFrame([(8, 10, None, "x")], rows.schema)
    assert [tuple(r) for r in unread_changes(lost, ["id", "at"], "dt", "at", log, "dt", "lo", "hi").collect()] == [(8, 10)]
    empty = log.limit(0)
    assert unread_changes(rows, ["id", "at"], "dt", "at", empty, "dt", "lo", "hi").count() == 6
    assert unread_changes(rows.limit(0), ["id", "at"], "dt", "at", log, "dt", "lo", "hi").count() == 0


def test_newest_cover(spark):
    rng = random.Random(3)
    rows = [(lo := rng.randint(-60, 60) * 40_000, lo + rng.choice([-1, 0, 1, 90_000, 3_000_000]), rng.randint(1, 9)) for _ in range(60)] + [(None, 5, 1), (1, None, 1), (1, 5, None)]
    got = sorted(map(tuple, newest_cover(spark.createDataFrame(rows, "lo long, hi long, upto int")).collect()))
    assert all(a[1] < b[0] for a, b in zip(got, got[1:]))
    for at in {x + d for lo, hi, _ in rows for x in (lo, hi) if x is not None for d in (-1, 0, 1)}:
        want = max((u for lo, hi, u in rows if None not in (lo, hi, u) and lo <= at <= hi), default=None)
        assert next((u for lo, hi, u in got if lo <= at <= hi), None) == want
    assert newest_cover(spark.createDataFrame([], "lo long, hi long, upto int")).count() == 0


def test_store_takes_over_a_log_and_commits_what_it_reads(spark, tmp_path):
    rows = spark.createDataFrame([(1, 10, 1), (2, 11, 1), (3, 30, 2), (4, 10, 3), (5, None, 3), (6, 12, None)], "id int, at long, dt int")
    store = IntervalStore(spark, str(tmp_path / "s"))
    store.adopt(spark.createDataFrame([(5, 10, 2), (30, 30, 1), (9, 4, 9)], "lo long, hi long, upto int"))
    assert store.read() is None and store.process_changes(rows, ["id", "at"], "dt", "at")
    assert {r.id for r in store.read().collect()} == {2, 3, 4, 6}
    assert sorted(map(tuple, store.covered().collect())) == [(5, 9, 2), (10, 30, 3)] and [tuple(r) for r in store.intervals().collect()] == [(5, 30)]
    late = rows.union(spark.createDataFrame([(7, 11, 3), (8, 11, 4), (9, 31, 1)], rows.schema))
    assert store.process_changes(late, ["id", "at"], "dt", "at")
    assert sorted(r.id for r in store.read().collect()) == [2, 3, 4, 6, 6, 8, 9]  # a NULL load is seen by no run
    store.compact()
    assert store.read().count() == 7 and len(store._latest()[1]["runs"]) == 1
    (tmp_path / "s/commits/000000000099.json").write_text("")  # a writer that died
    assert store.read().count() == 7 and store.process_changes(late.limit(0), ["id", "at"], "dt", "at") and store._latest()[0] == 100


@pytest.mark.parametrize("limit", [200_000, 1])
def test_unread_changes_by_broadcast_or_buckets(spark, monkeypatch, limit):
    monkeypatch.setattr("tributary.operators.intervals.BROADCAST_GAPS", limit)
    rng = random.Random(limit)
    rows = [(i, rng.randint(0, 500), rng.randint(1, 4)) for i in range(400)]
    log = [(rng.randint(1, 4), lo := rng.randint(0, 500), lo + rng.randint(-2, 20)) for _ in range(40)]
    df, lg = spark.createDataFrame(rows, "id int, at long, dt int"), spark.createDataFrame(log, "dt int, lo long, hi long")
    got = {tuple(r) for r in unread_changes(df, ["id", "at"], "dt", "at", lg, "dt", "lo", "hi").collect()}
    assert got == {(i, at) for i, at, dt in rows if not any(d >= dt and lo <= at <= hi for d, lo, hi in log)}


def test_merging_and_subtracting_tables(spark):
    rng = random.Random(7)
    spans = [(lo := rng.randint(-3_000_000, 9_000_000), lo + rng.choice([0, 1, 5, 1_000_000, 2_500_000])) for _ in range(30)] + [(5, 4)]
    merged = sorted((r.lo, r.hi) for r in merge_table(spark.createDataFrame(spans, "lo long, hi long")).collect())
    want = []
    for lo, hi in sorted(s for s in spans if s[0] <= s[1]):
        if want and lo <= want[-1][1] + 1:
            want[-1] = (want[-1][0], max(hi, want[-1][1]))
        else:
            want.append((lo, hi))
    assert merged == want
    points = [(rng.randint(-4_000_000, 12_000_000), "x") for _ in range(500)] + [(None, "x")]
    left = not_covered(spark.createDataFrame(points, "n long, b string"), "n", spark.createDataFrame(merged, "lo long, hi long"))
    assert sorted(r.n for r in left.collect()) == sorted(n for n, _ in points if n is not None and not any(lo <= n <= hi for lo, hi in merged))
    assert sorted((r.lo, r.hi) for r in present_ranges(spark.createDataFrame([(1,), (2,), (2,), (5,), (None,)], "n long"), "n").collect()) == [(1, 2), (5, 5)]


def test_covered_ranges_beyond_the_pushed_ones_count(spark, monkeypatch):
    monkeypatch.setattr("tributary.operators.intervals.PUSHED_RANGES", 2)
    covered = spark.createDataFrame([(i * 10, i * 10 + i) for i in range(9)], "lo long, hi long")
    left = not_covered(spark.range(100), "id", covered)
    assert sorted(r.id for r in left.collect()) == [n for n in range(100) if n // 10 > 8 or n % 10 > n // 10]


def test_runs_survive_failures_and_read_late_commits(spark, tmp_path):
    store = IntervalStore(spark, str(tmp_path / "s"))
    source = lambda *numbers: spark.createDataFrame([(n, f"r{n}") for n in numbers], "seq long, t string")
    assert store.process(source(1, 2, 4, None), "seq") and store.read().count() == 3

    def broken(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.process(source(1, 2, 4, 5), "seq", broken)
    spark.createDataFrame([(9, "half")], "seq long, t string").write.parquet(str(tmp_path / "s/data/run-never-committed"))
    assert store.process(source(1, 2, 3, 4, 5), "seq")
    assert sorted(r.seq for r in store.read().collect()) == [1, 2, 3, 4, 5]
    assert [tuple(r) for r in store.intervals().collect()] == [(1, 5)]
    assert not store.process(source(1, 5), "seq") and not store.process(source(), "seq")
    assert IntervalStore(spark, str(tmp_path / "s")).process(source(7), "seq")
    assert sorted(tuple(r) for r in store.intervals().collect()) == [(1, 5), (7, 7)]


def test_runs_name_all_loads(spark, tmp_path, monkeypatch):
    spark.range(1203).selectExpr("id row_nr", "int(id) dt", "int(id) id").coalesce(1).write.parquet(str(tmp_path / "mock_data.parquet"))
    seen = []
    monkeypatch.setattr(IntervalStore, "process", lambda self, df, *_: seen.append(df.select("dt").distinct().count()))
    monkeypatch.setattr(IntervalStore, "read", lambda self: None)
    queries.p4_runs(spark, str(tmp_path))
    assert seen == [401, 601, 1203]


def test_only_one_of_two_runs_commits(spark, tmp_path):
    one, two = IntervalStore(spark, str(tmp_path / "s")), IntervalStore(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([(1,)], "seq long")

    def meanwhile(df):
        two.process(rows, "seq")
        return df

    with pytest.raises(RuntimeError, match="committed"):
        one.process(rows, "seq", meanwhile)
    assert one.read().count() == 1


# packed values

CELLS = [
    "a,b;c", "[ ]", "", None, "{'x, y' | \"q\"\"r\"}", "(1 / 2 / )", ",,a,,", "\"a\\\"b\",c", "one two;  three ", "x\ty\nz", "'it''s'、2", "[a", "#", "\"\" , b", "a # 'b#c' # ", "-1.5,_x", "[\"a\"]", "é;ß",
]


def split(spark, cells):
    df = spark.createDataFrame([(i, "s", c, 1, "z") for i, c in enumerate(cells)], "nr int, src string, c string, pos int, item_text string")
    return sorted((r.nr, r.pos, r.item_text) for r in split_packed(df, ["nr"], "src", "c", min_score=0.0).collect())


def test_packed_cells(spark):
    assert split(spark, CELLS) == sorted((i, p, t) for i, c in enumerate(CELLS) if c for p, t in brute.split_cell(c))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from(["a", "b c", "12", "", "x-1", "'p,q'", '"r;""s"', "'t\\'u'"]), st.sampled_from([",", ";", " | ", "\t", "#"])), max_size=5), min_size=1, max_size=8))
def test_packed_as_plain(spark, drawn):
    cells = ["".join(item + sep for item, sep in cell) for cell in drawn]
    assert split(spark, cells) == sorted((i, p, t) for i, c in enumerate(cells) for p, t in brute.split_cell(c))


def test_packed_edges(spark):
    long = ",".join(str(i) for i in range(50_000))
    assert len(split(spark, [long])) == 50_000 and split(spark, []) == []
    twice = spark.createDataFrame([(1, None, "a,b"), (1, None, "a,b")], "nr int, src string, c string")
    assert split_packed(twice, ["nr"], "src", "c").count() == 2
    with pytest.raises(ValueError):
        split_packed(twice.withColumnRenamed("nr", "pos"), ["pos"], "src", "c")
    hot = spark.range(3000).select(F.lit("s").alias("src"), F.when(F.col("id") < 1000, 7).otherwise(F.col("id")).alias("nr"), F.lit("a;b").alias("c"))
    assert split_packed(hot, ["nr"], "src", "c").count() == 2 * 2001
    scores = {(r.src, r.delimiter): r for r in infer_delimiters(spark.createDataFrame([("s", "1,2,3"), ("s", "4,5"), ("s", "a,b|c"), ("t", "1;2"), ("t", None)], "src string, c string"), "src", "c").collect()}
    assert scores["s", ","].chosen and not scores["s", "|"].chosen and scores["t", ";"].score == 1


def test_many_sets_of_delimiters(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"s{i % 3}", f"a{',;|'[i % 3]}b") for i in range(60)], "nr int, src string, c string")
    runs = []
    for limit in (32, 2):
        monkeypatch.setattr("tributary.operators.packed.LITERAL_SETS", limit)
        runs.append(sorted(map(tuple, split_packed(df, ["nr"], "src", "c").collect())))
    assert runs[0] == runs[1] and len(runs[0]) == 120


def test_inferred_delimiters_decide(spark):
    cells = [(i, "s", f"a{i};b c") for i in range(9)] + [(10, "s", "x&y (old);7"), (11, "s", "it's 5\" wide;\"q;r\""), (12, "s", "one")]
    df = spark.createDataFrame(cells, "nr int, src string, c string")
    split_at = lambda **k: {(r.nr, r.pos): r.item_text for r in split_packed(df, ["nr"], "src", "c", **k).collect()}
    by_score, by_all = split_at(), split_at(min_score=0.0)
    assert by_score[10, 0] == "x&y (old)" and by_score[11, 0] == "it's 5\" wide" and by_score[11, 1] == "q;r" and len(by_score) == 9 * 2 + 5
    assert [by_all[10, p] for p in (0, 1, 2, 4)] == ["x", "y", "old", "7"]
    none = infer_delimiters(df.limit(0), "src", "c")
    assert {t for (_, p), t in split_at(delimiters=none).items() if p == 0} == {c for _, _, c in cells}


def test_packed_on_the_tables(spark, small):
    got = {tuple(r) for r in queries.p5_found(spark, small).collect()}
    cells = spark.read.parquet(f"{small}/status_records.parquet").select("rec_nr", "b.itms").where("itms is not null").distinct().collect()
    assert got == {(r.rec_nr, p, t) for r in cells for p, t in brute.split_cell(r.itms)}


# instants

STAMPS = [
    ("2023-03-26 02:30:00", "Europe/Vienna", "dmy", "2023-03-26 01:30:00"), ("2023-10-29 02:30:00", "Europe/Vienna", "dmy", "2023-10-29 00:30:00"),
    ("2023-03-12 02:30:00", "America/New_York", "mdy", "2023-03-12 07:30:00"), ("11/05/2023 01:30:00", "America/New_York", "mdy", "2023-11-05 05:30:00"),
    ("05/11/2023 01:30:00", "America/New_York", "mdy", "2023-05-11 05:30:00"), ("13/01/2023 01:30:00", "UTC", "mdy", None), ("5.11.2023 01:45", "UTC", "mdy", "2023-11-05 01:45:00"),
    ("2023-07-01 10:00:00 EST", "UTC", "dmy", "2023-07-01 15:00:00"), ("2023-07-01 10:00:00 America/Chicago", "UTC", "dmy", "2023-07-01 15:00:00"),
    ("2023-07-01 10:00:00 Mars/Base", "UTC", "dmy", None), ("2023-07-01T10:00:00Z", None, None, "2023-07-01 10:00:00"), ("2023-07-01 10:00", None, None, None),
    ("20230701T100000Z", None, None, "2023-07-01 10:00:00"), ("Sat, 01 Jul 2023 10:00:00 +0530", None, None, "2023-07-01 04:30:00"),
    ("Jul 1, 2023 12:05:00 AM", "UTC", "dmy", "2023-07-01 00:05:00"), ("Jul 1, 2023 12:05:00 PM", "UTC", "dmy", "2023-07-01 12:05:00"), ("Jul 1, 2023 13:05:00 PM", "UTC", "dmy", None),
    ("2023-02-29 10:00:00", "UTC", "dmy", None), ("2024-02-29 10:00:00", "UTC", "dmy", "2024-02-29 10:00:00"), ("2023-07-01 24:00:00", "UTC", "dmy", None), ("2023-07-01", "UTC", "dmy", None),
    ("99:99", "UTC", "dmy", None), ("", "UTC", "dmy", None), (None, "UTC", "dmy", None), ("0", "UTC", "dmy", None), ("-1600000000", "UTC", "dmy", None), ("x" * 100_000, "UTC", "dmy", None),
    ("2023-07-01 10:00:00 A" + "/A" * 50_000, "UTC", "dmy", None), ("9" * 100_000, "UTC", "dmy", None),
]


def test_instants(spark):
    df = spark.createDataFrame([(i, *s) for i, s in enumerate(STAMPS)], "i int, raw string, zone string, day_order string, want string")
    out = parse_instants(df).select("i", F.date_format(F.timestamp_micros("epoch_us"), "yyyy-MM-dd HH:mm:ss").alias("got"), "want").orderBy("i").collect()
    assert [(r.i, r.got) for r in out] == [(r.i, r.want) for r in out]


def test_instant_units_and_digits(spark):
    given = ["978307199", "978307200", "1583434971595131264", "1583434971595131", "1583434971595", "1685061162.32", "2023-07-01T10:00:00.1234567Z", "99999", "20210101101010"]
    df = spark.createDataFrame([(i, v, None, None) for i, v in enumerate(given)], "i int, raw string, zone string, day_order string")
    assert [r.epoch_us for r in parse_instants(df).orderBy("i").collect()] == [
        None, 978307200000000, 1583434971595131, 1583434971595131, 1583434971595000, 1685061162320000, 1688205600123456, None, None,
    ]


def test_dictionary_parses_each_text_once_and_keeps_it(spark, tmp_path):
    rows = lambda *v: spark.createDataFrame([(x, "UTC", "dmy", i, "hot", 1) for i, x in enumerate(v)], "raw string, zone string, day_order string, epoch_us int, hot string, key int")
    store = InstantDictionary(spark, str(tmp_path / "d"))
    out = normalise(rows("2023-07-01 10:00:00", "2023-07-01 10:00:00", "junk", None), store)
    assert sorted(map(str, (r.epoch_us for r in out.collect()))) == ["1688205600000000", "1688205600000000", "None", "None"]
    again = InstantDictionary(spark, str(tmp_path / "d"))
    assert normalise(rows("junk", "2023-07-01 11:00:00"), again).where("epoch_us is not null").count() == 1
    assert again.read().count() == 3 and len(again._batches()) == 2
    assert normalise(rows(), again).count() == 0


def test_hot_texts(spark):
    df = spark.createDataFrame([("same" if i % 3 else f"2023-07-01 10:00:{i % 60:02d}", "UTC", "dmy", i) for i in range(900)], "raw string, zone string, day_order string, i int")
    out = normalise(df, InstantDictionary(spark), hot_share=10)
    assert out.count() == 900 and out.where("epoch_us is not null").count() == 300


def test_texts_that_grow_hot_later(spark, tmp_path):
    rows = lambda *v: spark.createDataFrame([(x, "UTC", "dmy", i) for i, x in enumerate(v)], "raw string, zone string, day_order string, i int")
    store = InstantDictionary(spark, str(tmp_path / "d"))
    store.add(rows("2023-07-01 10:00:00", "junk"))
    later = rows(*["2023-07-01 10:00:00"] * 500, *[f"2023-07-01 11:{i // 60:02d}:{i % 60:02d}" for i in range(500)], "junk")
    entries = {r.raw: r.n for r in store.add(later).collect()}
    assert entries["2023-07-01 10:00:00"] == 500 and entries["junk"] == 1 and len(entries) == 502 and store.read().count() == 502
    out = normalise(later, store, hot_share=10)
    assert out.count() == 1001 and out.where("epoch_us is not null").count() == 1000
    hot = [n for n in normalise(later, store, hot_share=10)._jdf.queryExecution().optimizedPlan().toString().split("\n") if "hot" in n]
    assert hot


def test_instants_on_the_tables(spark, small):
    zones = {r.src: (r.tz_name, r.day_order) for r in spark.read.parquet(f"{small}/source_zones.parquet").collect()}
    got = {tuple(r)[1:] for r in queries.p6_found(spark, small).where("table_name = 'status_records'").collect()}
    want = set()
    for r in spark.read.parquet(f"{small}/status_records.parquet").collect():
        for name, v in (("a.ts", r.a and r.a.ts), ("b.ts", r.b and r.b.ts)):
            if (us := brute.instant(v, *zones[r.src])) is not None:
                want.add((r.rec_nr, name, us))
    assert got == want
