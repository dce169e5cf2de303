"""Projection, cleaners, filters, explosion, newest rows, comments."""

from datetime import date, datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tributary import functions as fn
from tributary.errors import ColumnMappingNotSupported, ColumnNotFound, DataTypeValidationFailed, MapperParameterNotSupported
from tributary.operators.annotate import Annotator, AnnotatorMode, MissingColumn, load_comments, update_comment
from tributary.operators.cleaning import EnumCleaner, NullCleaner, ThresholdCleaner
from tributary.operators.explode import Exploder
from tributary.operators.filters import NoIdDropper, Sieve
from tributary.operators.latest import NewestByGroup
from tributary.operators.project import Mapper, MapperMode, MissingColumnHandling


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame([(1, "7", (2, [("x", 3)]))], "a int, b string, s struct<c:int,l:array<struct<d:string,e:int>>>")


def test_mapper_replaces_and_casts(base):
    out = Mapper([("n", "b", "int"), ("d", "s.l.d", "array<string>"), ("c", F.lit(4) + F.col("a"), "LongType"), ("z", "b", fn.to_num)]).transform(base)
    assert out.dtypes == [("n", "int"), ("d", "array<string>"), ("c", "bigint"), ("z", "bigint")]
    assert rows(out) == [(7, ["x"], 5, 7)]


def test_mapper_append_and_prepend_replace_in_place_one_after_the_other(base):
    mapping = [("new", "a", "string"), ("a", F.col("a") + 1, "int"), ("b", F.col("a") * 10, "int")]
    out = Mapper(mapping, mode=MapperMode.append).transform(base.drop("s"))
    assert (out.columns, rows(out)) == (["a", "b", "new"], [(2, 20, "1")])
    out = Mapper(mapping, mode=MapperMode.prepend).transform(base.drop("s"))
    assert (out.columns, rows(out)) == (["new", "a", "b"], [("1", 2, 20)])


def test_mapper_missing_columns(base):
    mapping = [("x", "no.such", "int"), ("y", "s.none", fn.to_str), ("a", "a", "int")]
    with pytest.raises(AnalysisException):
        Mapper(mapping).transform(base)
    assert Mapper(mapping, missing_column_handling=MissingColumnHandling.skip).transform(base).columns == ["a"]
    out = Mapper(mapping, missing_column_handling=MissingColumnHandling.nullify).transform(base)
    assert out.dtypes == [("x", "int"), ("y", "string"), ("a", "int")] and rows(out) == [(None, None, 1)]


def test_mapper_on_a_table_without_columns(spark):
    out = Mapper([("x", "a", "int")], missing_column_handling=MissingColumnHandling.nullify).transform(spark.createDataFrame([], "z int").drop("z"))
    assert out.dtypes == [("x", "int")] and rows(out) == []


def test_mapper_ambiguous_columns(spark):
    df = spark.createDataFrame([('{"Key": 1, "key": 2, "o": 3}',)], "j string").select(F.from_json("j", "struct<Key:int,o:int>").alias("s"))
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        df = df.select(F.struct(F.lit(1).alias("Key"), F.lit(2).alias("key")).alias("s"), F.lit(3).alias("o"))
    finally:
        spark.conf.set("spark.sql.caseSensitive", "false")
    with pytest.raises(AnalysisException):
        Mapper([("k", "s.key", "int")]).transform(df)
    assert Mapper([("k", "s.key", "int"), ("o", "o", "int")], ignore_ambiguous_columns=True).transform(df).columns == ["o"]


def test_mapper_validates(base):
    good = [("n", "a", "int"), ("t", "b", fn.as_is), ("v", F.lit(None), "int")]
    assert Mapper(good, mode=MapperMode.rename_and_validate).transform(base).columns == ["n", "t", "v"]
    with pytest.raises(DataTypeValidationFailed) as e:
        Mapper([("n", "a", "string"), ("t", "b", fn.to_int), ("x", "gone", "int")], mode=MapperMode.rename_and_validate, missing_column_handling=MissingColumnHandling.skip).transform(base)
    assert all(t in str(e.value) for t in ("Validation has failed!", "n: a is int", "t: ", "Input column: gone not found!"))


@pytest.mark.parametrize("mapping", [[], [("a", "a")], [("a", "a", "int", "c", "d")], [("a", "a", "no_such_type")], [("a", "a", 5)]])
def test_mapper_rejects_bad_mappings(base, mapping):
    with pytest.raises(ColumnMappingNotSupported):
        Mapper(mapping).transform(base)


def test_mapper_rejects_bad_options():
    for options in ({"mode": "replace"}, {"missing_column_handling": "skip"}, {"ignore_missing_columns": True}):
        with pytest.raises(MapperParameterNotSupported):
            Mapper([("a", "a", "int")], **options)


def test_a_mapper_serves_many_tables(base, spark):
    mapper = Mapper([("x", "b", fn.to_int(alt_src_cols=F.lit("0")))], missing_column_handling=MissingColumnHandling.nullify)
    assert rows(mapper.transform(base)) == [(7,)]
    assert rows(mapper.transform(spark.createDataFrame([(1,)], "q int"))) == [(0,)]
    assert rows(mapper.transform(base)) == [(7,)]


def test_enum_cleaner(spark):
    df = spark.createDataFrame([("active",), ("",), ("off",), (None,), ("aktiv",)], "status string")
    allow = EnumCleaner({"status": {"elements": ["active", "inactive"], "mode": "allow", "default": "cleansed!"}}, "log").transform(df)
    assert [(a, b.status) for a, b in rows(allow)] == [("active", None), ("cleansed!", ""), ("cleansed!", "off"), (None, None), ("cleansed!", "aktiv")]
    deny = EnumCleaner({"status": {"elements": ["off", "", None], "mode": "disallow", "default": "inactive"}}, "log", store_as_map=True).transform(df)
    assert rows(deny) == [("active", None), ("inactive", {"status": ""}), ("inactive", {"status": "off"}), (None, None), ("aktiv", None)]
    numbers = spark.createDataFrame([(112,), (None,), (-112,)], "v bigint")
    out = EnumCleaner({"v": {"elements": [112], "mode": "allow", "default": "x"}}, "log", store_as_map=True).transform(numbers)
    assert rows(out) == [(112, None), (None, None), (None, {"v": "-112"})]


@pytest.mark.parametrize("rule, error", [({"mode": "allow"}, ValueError), ({"elements": [], "mode": "allow"}, ValueError), ({"elements": [1]}, RuntimeError), ({"elements": [1], "mode": "some"}, ValueError)])
def test_enum_cleaner_rejects(rule, error):
    with pytest.raises(error):
        EnumCleaner({"a": rule})


def test_threshold_cleaner(spark):
    df = spark.createDataFrame(
        [(0, 12.0, 12, datetime(1850, 1, 1, 12), date(1850, 1, 1)), (1, 65.5, 65, datetime(2020, 6, 1, 12), date(2020, 6, 1)), (5, -75.0, None, None, None)],
        "id int, f double, i int, t timestamp_ntz, d date",
    )
    rules = {
        "f": {"min": 15, "max": 300}, "i": {"min": F.col("id"), "max": 60, "default": F.col("id") * -1},
        "t": {"min": "2020-06-01 08:00:00", "max": "2020-06-01 20:00:00"}, "d": {"min": "2020-06-01", "max": "2020-07-01", "default": "2000-01-01"},
    }
    out = rows(ThresholdCleaner(rules, "log").transform(df))
    assert [r[1:5] for r in out] == [
        (None, 12, None, date(2000, 1, 1)), (65.5, -1, datetime(2020, 6, 1, 12), date(2020, 6, 1)), (None, -5, None, date(2000, 1, 1)),
    ]
    assert tuple(out[0][5]) == ("12.0", None, "1850-01-01 12:00:00", "1850-01-01") and tuple(out[2][5]) == ("-75.0", "null", None, "null")
    with pytest.raises(ValueError):
        ThresholdCleaner({"s": {"min": 1, "max": 2}}).transform(spark.createDataFrame([("1",)], "s string"))


def test_null_cleaner(spark):
    df = spark.createDataFrame([("a", None), (None, True), ("", None), ("None", None)], "s string, b boolean")
    out = NullCleaner({"s": {"default": "x"}, "b": {"default": False}}, "log", store_as_map=True).transform(df)
    assert rows(out) == [("a", False, {"b": "null"}), ("x", True, {"s": "null"}), ("", False, {"b": "null"}), ("None", False, {"b": "null"})]
    assert NullCleaner({"s": {"default": "x"}}, "log").transform(df).schema["log"].nullable is False
    with pytest.raises(ValueError):
        NullCleaner({"s": {}})


def test_cleaners_share_no_log_column(spark):
    df = NullCleaner({"s": {"default": "x"}}, "log").transform(spark.createDataFrame([(None,)], "s string"))
    with pytest.raises(ValueError):
        NullCleaner({"s": {"default": "x"}}, "log").transform(df)


def test_rules_see_the_input_unless_sequential(spark):
    df = spark.createDataFrame([("bad", "bad")], "a string, b string")
    rules = {"a": {"elements": ["ok"], "mode": "allow", "default": "ok"}, "b": {"elements": ["ok"], "mode": "allow", "default": F.col("a")}}
    assert rows(EnumCleaner(rules).transform(df)) == [("ok", "bad")]
    assert [tuple(r[:2]) + tuple(r[2]) for r in rows(EnumCleaner(rules, "log", sequential=True).transform(df))] == [("ok", "ok", "bad", "bad")]


def test_cleaner_plan_is_one_projection(spark):
    df = spark.range(5).select(*[F.col("id").alias(f"c{i}") for i in range(8)])
    plan = ThresholdCleaner({f"c{i}": {"min": 1, "max": 3} for i in range(8)}, "log", store_as_map=True).transform(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project") == 1


def test_sieve_and_no_id_dropper(spark):
    df = spark.createDataFrame([(1, ("ab",)), (None, ("b",)), (3, (None,))], "a int, s struct<t:string>")
    assert rows(Sieve("a > 0 and s.t rlike 'b$'").transform(df).select("a")) == [(1,)]
    assert NoIdDropper(["a"]).transform(df).count() == 2
    with pytest.raises(ValueError):
        Sieve(F.lit(True))


def test_exploder(spark):
    df = spark.createDataFrame([(1, ["x", "y"], {"k": 1}), (2, [], None), (3, None, None)], "id int, l array<string>, m map<string,int>")
    assert rows(Exploder("l", "e").transform(df).select("id", "e")) == [(1, "x"), (1, "y")]
    assert Exploder("l", "e").transform(df).columns == ["id", "m", "e"]
    assert rows(Exploder("l", "l", drop_rows_with_empty_array=False).transform(df).select("id", "l")) == [(1, "x"), (1, "y"), (2, None), (3, None)]
    assert rows(Exploder("m", "e").transform(df).select("id", "e.key", "e.value")) == [(1, "k", 1)]
    nested = df.select(F.struct("id", "l").alias("s"))
    assert Exploder("s.l", "e").transform(nested).columns == ["s", "e"]


NEWEST = [
    (1, 2, 0, 10, None), (1, 1, 9, 60, None), (2, 7, 2, 55, 80), (2, 7, 7, 55, 70), (2, 1, 3, None, None), (None, 1, 5, 3, None), (None, 1, 6, None, 9),
]


def test_newest_by_group(spark):
    df = spark.createDataFrame(NEWEST, "id int, secondary_id int, idx int, updated_at int, deleted_at int")
    assert sorted(r.idx for r in NewestByGroup().transform(df).collect()) == [2, 5, 9]
    assert sorted(r.idx for r in NewestByGroup("id", "updated_at", tie_break="idx").transform(df).collect()) == [2, 5, 9]
    assert sorted(r.idx for r in NewestByGroup(["id", "secondary_id"]).transform(df).collect()) == [0, 2, 3, 5, 9]
    assert NewestByGroup().transform(df).columns == df.columns
    taken = df.withColumn("__rank", F.lit(1))
    assert NewestByGroup().transform(taken).columns == taken.columns


def test_comments(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    df = update_comment(df, "a", "initial")
    read = lambda d: {f.name: f.metadata.get("comment") for f in d.schema.fields}
    assert read(Annotator({"a": "new", "b": ""}).transform(df)) == {"a": "new", "b": ""}
    assert read(Annotator({"a": "new", "b": "b"}, mode=AnnotatorMode.insert).transform(df)) == {"a": "initial", "b": "b"}
    with pytest.raises(ColumnNotFound):
        Annotator({"z": "x"}).transform(df)
    assert read(Annotator({"z": "x"}, missing_column_handling=MissingColumn.skip).transform(df)) == {"a": "initial", "b": None}
    other = df.select(F.col("a").alias("a", metadata={"comment": "initial", "unit": "m"}), "b")
    assert Annotator({"a": "n"}).transform(other).schema["a"].metadata == {"comment": "n", "unit": "m"}


def test_comments_from_a_table(spark):
    df = update_comment(spark.createDataFrame([(1, 2)], "a int, b int"), "a", "stored")
    df.write.mode("overwrite").saveAsTable("annotated")
    try:
        assert load_comments("annotated", spark) == {"a": "stored"}
        fresh = spark.createDataFrame([(1, 2)], "a int, c int")
        read = lambda m, mode: Annotator(m, mode=mode, sql_source_table_identifier="annotated").transform(fresh).schema["a"].metadata["comment"]
        assert read({}, AnnotatorMode.upsert) == "stored" and read({"a": "own"}, AnnotatorMode.upsert) == "own" and read({"a": "own"}, AnnotatorMode.insert) == "stored"
        mapped = Mapper([("a", "a", "int", "mapped")], annotator_options={"sql_source_table_identifier": "annotated"}).transform(fresh)
        assert mapped.schema["a"].metadata["comment"] == "mapped"
    finally:
        spark.sql("drop table annotated")
