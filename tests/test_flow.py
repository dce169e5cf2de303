"""Sources, sinks, pipelines, descriptions and streams."""

import json

import pytest
from pyspark.sql import functions as F

from tributary import functions as fn
from tributary.errors import SpecificationError
from tributary.log import configure, level_of
from tributary.operators.cleaning import EnumCleaner
from tributary.operators.explode import Exploder
from tributary.operators.filters import Sieve
from tributary.operators.latest import NewestByGroup
from tributary.operators.project import Mapper
from tributary.plans import Pipeline, PipelineFactory, build_pipeline
from tributary.plans.spec import register
from tributary.sources import CSVExtractor, HiveLoader, JDBCExtractorFullLoad, JDBCExtractorIncremental, JSONExtractor, ParquetLoader
from tributary.sources.files import infer_input_path_from_partition
from tributary.sources.jdbc import Bounds, BoundsLog, bounded_query, in_parts
from tributary.streaming import apply_steps, load_in_batches, newest_in_batches

LINES = [{"id": 1, "a": {"t": "one\ntwo\r", "l": [{"x": "p\nq"}]}}, {"id": 2, "a": {"t": "C:\\new", "l": None}}, {"id": 3}]


@pytest.mark.parametrize(
    "base, day, path",
    [("base", 20170601, "base/17/06/01/*"), ("hdfs://nameservice-ha:8020/b/p", "20170601", "/b/p/17/06/01/*")],
)
def test_paths_of_partitions(base, day, path):
    assert infer_input_path_from_partition(base, day) == path
    assert JSONExtractor(base_path=base, partition=day).input_path == path


def test_json_needs_a_path():
    with pytest.raises(AttributeError):
        JSONExtractor(base_path="/x")
    assert JSONExtractor("hdfs://nameservice-ha:8020/full/path").input_path == "/full/path/*"


def test_json_text(spark, tmp_path):
    (tmp_path / "part-0").write_text("\n".join(map(json.dumps, LINES)) + "\n{broken\n")
    out = {r.id: r for r in JSONExtractor(str(tmp_path)).extract().collect()}
    assert out[1].a.t == "one two" and out[1].a.l[0].x == "p q" and out[2].a.t == "C:\\new" and out[3].a is None
    assert out[None]._corrupt_record == "{broken"
    typed = JSONExtractor(str(tmp_path), schema="id long, a struct<t:string>", keep_line_breaks=True).extract()
    assert typed.where("id = 1").first().a.t == "one\ntwo\r"


def test_json_sequence_files(spark, tmp_path):
    path = str(tmp_path / "seq")
    spark.sparkContext.parallelize([(i, json.dumps(x)) for i, x in enumerate(LINES)], 1).saveAsSequenceFile(path)
    assert sorted(r.id for r in JSONExtractor(path).extract().collect()) == [1, 2, 3]


def test_components_know_themselves():
    source, step, sink = CSVExtractor("x"), Sieve("true"), ParquetLoader("x")
    assert (source.name, step.name, sink.name) == ("CSVExtractor", "Sieve", "ParquetLoader")
    assert str(source) == "Extractor Object of Class CSVExtractor" and str(step).startswith("Transformer") and str(sink).startswith("Loader")
    assert step.logger.name == "tributary.Sieve"
    assert [level_of(e) for e in ("dev", "test", "prod", None)] == [10, 40, 30, 20]
    assert configure("test").level == 40 and len(configure("dev").handlers) == 1


def test_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a;b\n1;x\n")
    assert [tuple(r) for r in CSVExtractor(str(tmp_path)).extract().collect()] == [(1, "x")]


OPTIONS = {"url": "jdbc:x", "driver": "d", "user": "u", "password": "p"}


def test_jdbc_options():
    for key in OPTIONS:
        with pytest.raises(AssertionError, match=f"{key} is missing from the jdbc_options."):
            JDBCExtractorFullLoad("select 1", {k: v for k, v in OPTIONS.items() if k != key})
        with pytest.raises(AssertionError, match=f"{key} has to be provided as a string object."):
            JDBCExtractorFullLoad("select 1", {**OPTIONS, key: 1})


@pytest.mark.parametrize(
    "lower, upper, query",
    [
        (None, None, "select * from T"), (None, 1024, "select * from T where c <= 1024"), ("1024", None, "select * from T where c > 1024"),
        ("g'1", "2018-05-16", "select * from T where c > 'g''1' and c <= '2018-05-16'"), (0, None, "select * from T where c > 0"),
    ],
)
def test_queries_by_bounds(lower, upper, query):
    assert bounded_query("T", "c", Bounds(lower, upper)) == query


@pytest.fixture
def log(spark):
    spark.sql("create table boundlog (first_value string, last_value string, partition_column string, dt int) using parquet partitioned by (partition_column, dt)")
    log = BoundsLog("boundlog", "updated_at")
    for day in (15, 16, 17):
        log.write(20180500 + day, f"2018-05-{day} 03:30:00", f"2018-05-{day + 1} 03:29:59")
    log.write(20180519, None, None)
    yield log
    spark.sql("drop table boundlog")


@pytest.mark.parametrize(
    "day, bounds",
    [
        (20180510, (None, "2018-05-15 03:30:00")), (20180516, ("2018-05-16 03:30:00", "2018-05-17 03:29:59")),
        (20180518, ("2018-05-18 03:29:59", None)), (20180520, ("2018-05-18 03:29:59", None)),
    ],
)
def test_bounds(log, day, bounds):
    found = log.bounds(day)
    assert (found.lower, found.upper, found.lower_included) == (*bounds, False)
    assert log.bounds(20180516, exact_reload=True).lower_included
    assert BoundsLog("boundlog").read().count() == 3


def test_bounds_of_an_empty_log(spark, log):
    assert BoundsLog("boundlog", "other").bounds(1) == Bounds()
    log.write(20180516, "a", "b")
    assert log.bounds(20180516) == Bounds("a", "b") and log.read().count() == 3


def test_incremental_load(spark):
    source = spark.createDataFrame([(i,) for i in range(10)] + [(None,)], "n int")
    source.createOrReplaceTempView("numbers_source")
    asked = []

    def read(_, query):
        asked.append(query)
        return spark.sql(query)

    spark.sql("create table numberlog (partition_column string, first_value string, last_value string, dt int) using parquet partitioned by (dt)")
    try:
        first = JDBCExtractorIncremental(1, OPTIONS, "(select * from numbers_source where n < 5)", "numberlog", values_partition_column="n", cache=False, reader=read)
        assert first.extract().count() == 5
        second = JDBCExtractorIncremental(2, OPTIONS, "numbers_source", "numberlog", values_partition_column="n", cache=False, reader=read, commit_on_extract=False)
        assert sorted(r.n for r in second.extract().collect()) == [5, 6, 7, 8, 9]
        assert BoundsLog("numberlog", "n").read().count() == 1
        second.commit()
        assert {(r.dt, r.first_value, r.last_value) for r in spark.table("numberlog").collect()} == {(1, "0", "4"), (2, "5", "9")}
        assert asked[1] == "select * from numbers_source where n > 4"
    finally:
        spark.sql("drop table numberlog")


def test_parts_of_a_query(spark):
    spark.range(5, 100).createOrReplaceTempView("parts_source")
    read = lambda _, query: spark.sql(query)
    want = {**OPTIONS, "partitionColumn": "id", "lowerBound": "5", "upperBound": "99", "numPartitions": "3"}
    assert in_parts(OPTIONS, "select * from parts_source", "id", 3, read) == want
    for query, column, parts in (("select * from parts_source where id = 7", "id", 3), ("select * from parts_source where id < 0", "id", 3), ("select 1", None, 3), ("select 1", "id", 1)):
        assert in_parts(OPTIONS, query, column, parts, read) == OPTIONS


def test_a_failed_sink_leaves_the_log_alone(spark):
    class Source:
        log: list = []

        def extract(self, commit=None):
            return spark.range(3)

        def commit(self):
            self.log.append(1)

    class Sink:
        def __init__(self, works):
            self.works = works

        def load(self, df):
            if not self.works:
                raise RuntimeError("full")

    with pytest.raises(RuntimeError):
        Pipeline().set_extractor(Source()).set_loader(Sink(False)).execute()
    assert Source.log == []
    Pipeline().set_extractor(Source()).set_loader(Sink(True)).execute()
    assert Source.log == [1]


def part(name, value, kind="IntegerType"):
    return {"column_name": name, "column_type": kind, "default_value": value}


def test_table_sink(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    load = lambda rows, p, s="d", **k: HiveLoader("default", "sink", [part("p", p), part("s", s, "StringType")], **k).load(rows)
    count = lambda: {(r.p, r.s): r["count"] for r in spark.table("sink").groupBy("p", "s").count().collect()}
    try:
        with pytest.raises(Exception, match="auto_create_table"):
            load(df, 0, auto_create_table=False)
        load(df, 0)
        load(df, 1)
        load(df.limit(1), 1)
        assert count() == {(0, "d"): 2, (1, "d"): 1}
        load(df, 1, clear_partition=False, repartition_size=2)
        load(df, 1, "o'x")
        assert count() == {(0, "d"): 2, (1, "d"): 3, (1, "o'x"): 2}
        load(df.limit(0), 0)
        assert count() == {(1, "d"): 3, (1, "o'x"): 2}
        keep = df.withColumn("p", F.col("id")).withColumn("s", F.lit("k"))
        load(keep, 9, clear_partition=False, overwrite_partition_value=False)
        assert count()[1, "k"] == 1 and count()[2, "k"] == 1
        with pytest.raises(AssertionError, match="don't match"):
            load(df.select("t", "id"), 1)
        with pytest.raises(AssertionError, match="No default partition value"):
            load(df, None)
    finally:
        spark.sql("drop table if exists sink")


def test_table_sink_parameters():
    with pytest.raises(ValueError):
        HiveLoader("d", "t", [part("p", 1)], overwrite_partition_value=False)
    for bad in ("p", [1], [part("", 1)], [part("p", 1, "NoType")]):
        with pytest.raises(AssertionError):
            HiveLoader("d", "t", bad)
    shared = [part("p", 1)]
    assert HiveLoader("d", "t", shared).partition_definitions == HiveLoader("d", "t", shared).partition_definitions


def test_parquet_sink(spark, tmp_path):
    ParquetLoader(str(tmp_path / "x"), explicit_partition_values={"dt": 5}).load(spark.range(3))
    assert spark.read.parquet(str(tmp_path / "x")).where("dt = 5").count() == 3


SPEC = {
    "extractor": {"name": "JSONExtractor", "params": {"input_path": "set by the test"}},
    "transformers": [
        {"name": "Exploder", "params": {"path_to_array": "a.l", "exploded_elem_name": "e"}},
        {"name": "Mapper", "params": {"mapping": [["id", "id", "to_long"], ["x", "e.x", {"function": "map_values", "mapping": {"p q": "P"}}]], "missing_column_handling": "nullify"}},
    ],
    "loader": {"name": "ByPass", "params": {}},
}


def test_pipelines(spark, tmp_path):
    (tmp_path / "part-0").write_text("\n".join(map(json.dumps, LINES)))
    spec = {**SPEC, "extractor": {"name": "JSONExtractor", "params": {"input_path": str(tmp_path)}}}
    factory = PipelineFactory(fetch=lambda url, context: spec if context == {"k": 1} else {})
    assert [tuple(r) for r in factory.execute({"k": 1}).collect()] == [(1, "P")]
    steps = [Exploder("a.l", "e"), Mapper([("id", "id", fn.to_long), ("x", "e.x", "string")]), lambda df: df.where("id > 0")]
    pipeline = Pipeline(bypass_loader=True).set_extractor(JSONExtractor(str(tmp_path))).add_transformers(steps)
    assert [tuple(r) for r in pipeline.execute().collect()] == [(1, "p q")]
    loaded = Pipeline(input_df=spark.range(2)).add_transformers(Sieve("id = 1")).set_loader(HiveLoader("default", "piped", [part("dt", 1)]))
    try:
        assert loaded.execute() is None and spark.table("piped").count() == 1
    finally:
        spark.sql("drop table if exists piped")


def test_pipeline_rules(spark):
    with pytest.raises(AssertionError):
        Pipeline(input_df=spark.range(1)).set_extractor(CSVExtractor("x"))
    with pytest.raises(AssertionError):
        Pipeline(bypass_loader=True).set_loader(ParquetLoader("x"))
    assert Pipeline().add_transformers([Sieve("true")]).clear_transformers().transformers == []
    with pytest.raises(SpecificationError):
        build_pipeline({"transformers": [{"name": "NoSuchStep"}]}, spark.range(1))

    @register
    class Doubler:
        def transform(self, df):
            return df.union(df)

    assert build_pipeline({"transformers": [{"name": "Doubler"}]}, spark.range(1)).execute().count() == 2


def test_streams_give_what_batches_give(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame([(1, "a", ["x"]), (2, "b", []), (3, None, ["y", "z"])], "id int, t string, l array<string>")
    df.write.parquet(src)
    steps = [EnumCleaner({"t": {"elements": ["a"], "mode": "allow", "default": "-"}}, "log", store_as_map=True), Exploder("l", "e"), Sieve("id > 0"), Mapper([("id", "id", "long"), ("t", "t", fn.to_str), ("e", "e", "string")])]
    stream = spark.readStream.schema(df.schema).parquet(src)
    query = apply_steps(stream, steps).writeStream.option("checkpointLocation", f"{out}-c").trigger(availableNow=True).start(path=out, format="parquet")
    query.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).collect()), key=str) == sorted(map(tuple, apply_steps(df, steps).collect()), key=str)
    with pytest.raises(ValueError):
        NewestByGroup("id").transform(stream)
    load_in_batches(stream, steps, ParquetLoader(f"{out}-l", partition_by="t", mode="append"), f"{out}-lc").awaitTermination()
    assert spark.read.parquet(f"{out}-l").count() == 3


def test_newest_on_streams(spark, tmp_path):
    src, kept = str(tmp_path / "in"), {}
    for n, rows in enumerate([[(1, 5, 0), (2, 1, 0)], [(1, 4, 0), (2, 9, 0)]]):
        spark.createDataFrame(rows, "id int, updated_at int, deleted_at int").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("id int, updated_at int, deleted_at int").parquet(src)
        read = lambda: spark.createDataFrame(kept["rows"], "id int, updated_at int, deleted_at int") if kept else None
        write = lambda df, number: kept.update(rows=[tuple(r) for r in df.collect()])
        newest_in_batches(stream, NewestByGroup("id"), read, write, str(tmp_path / "c")).awaitTermination()
    assert sorted(kept["rows"]) == [(1, 5, 0), (2, 9, 0)]
