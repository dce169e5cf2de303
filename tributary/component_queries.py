"""Queries for what the other modules' queries leave out: file inference, databases, appends, comments, errors, services."""

from __future__ import annotations

import json
import logging
import threading
import uuid
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary import functions as fn
from tributary.log import level_of
from tributary.operators.annotate import Annotator, AnnotatorMode, load_comments, update_comment
from tributary.operators.cleaning import EnumCleaner
from tributary.operators.filters import Sieve
from tributary.operators.project import Mapper, MapperMode
from tributary.plans import Pipeline, PipelineFactory
from tributary.plans.spec import COMPONENTS, build_pipeline, register
from tributary.runtime import read_table, shared_dir
from tributary.sources import BoundsLog, CSVExtractor, HiveLoader, JDBCExtractorFullLoad, JDBCExtractorIncremental, JDBCLoader, JSONExtractor
from tributary.sources.files import fix_suffix, infer_input_path_from_partition, remove_hdfs_prefix
from tributary.sources.served import serve, served_folder


def _name(stem: str) -> str:
    return f"{stem}_{uuid.uuid4().hex[:12]}"


# files


def json_inferred(spark: SparkSession, sf: str) -> DataFrame:
    """Text files of a day's folder, read without a schema: breaks inside texts become blanks, cut lines are kept apart."""
    record = F.struct(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit("\n"), "p_brand", F.lit("\r")).alias("text"))
    whole = F.to_json(F.struct(record.alias("part"), F.array(F.struct(F.concat(F.lit("a\nb"), F.col("p_size").cast("string")).alias("x"))).alias("list")))
    base = shared_dir(spark, "lines")
    lines = read_table(spark, sf, "part").select(F.when(F.col("p_partkey") % 10 == 0, F.substring(whole, 1, 20)).otherwise(whole).alias("value"))
    lines.write.text(f"{base}/20/01/31")
    df = JSONExtractor(base_path=base, partition=20200131).extract()
    return df.select(F.col("part.id").alias("id"), F.col("part.text").alias("text"), F.col("list")[0]["x"].alias("x"), F.col("_corrupt_record").isNotNull().alias("corrupt"))


def json_sequence(spark: SparkSession, sf: str) -> DataFrame:
    path, nations = shared_dir(spark, "sequence"), read_table(spark, sf, "nation").select("n_nationkey", "n_name")
    nations.rdd.map(lambda r: (r[0], json.dumps({"key": r[0], "name": r[1]}))).saveAsSequenceFile(path)
    return JSONExtractor(path).extract().select("key", "name")


def csv_inferred(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_dir(spark, "csv")
    read_table(spark, sf, "nation").select("n_nationkey", "n_name").write.option("sep", ";").option("header", True).csv(path)
    return CSVExtractor(path).extract()


def input_paths(spark: SparkSession, sf: str) -> DataFrame:
    given = ["hdfs://nameservice-ha:8020/a/b", "/a/b", "/a/b/*", "/a/b/"]
    rows = [(p, remove_hdfs_prefix(p), fix_suffix(p), infer_input_path_from_partition(p.rstrip("/*"), 20200131)) for p in given]
    return spark.createDataFrame(rows, "given string, bare string, whole string, day string")


# databases


def _database(spark: SparkSession, table: DataFrame, name: str) -> dict:
    """An embedded database on this process's disk with ``table`` in it; executors in other processes have it served by this one."""
    jvm = spark._jvm
    jvm.java.lang.System.setProperty("derby.stream.error.method", "java.io.OutputStream.nullOutputStream")
    url, driver = f"jdbc:derby:directory:{served_folder()}/{_name('db')};create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    options = {"url": url, "driver": driver, "user": "app", "password": "app"}
    if not spark.sparkContext._jsc.sc().isLocal():
        options = serve(spark, f"{url};user=app;password=app")
    # unquoted names are upper case there
    table = table.toDF(*[c.upper() for c in table.columns])
    table.limit(0).write.format("jdbc").options(**options, dbtable=name).save()
    # tasks that write take turns, for as long as it takes: locks of single rows would fill the memory of this process
    connection = jvm.org.apache.derby.jdbc.EmbeddedDriver().connect(f"{url};user=app;password=app", jvm.java.util.Properties())
    try:
        statement = connection.createStatement()
        statement.execute(f"alter table {name} locksize table")
        statement.execute("call syscs_util.syscs_set_database_property('derby.locks.waitTimeout', '-1')")
    finally:
        connection.close()
    table.write.format("jdbc").options(**options, dbtable=name).mode("append").save()
    return options


def jdbc_parallel(spark: SparkSession, sf: str) -> DataFrame:
    """A query read from a database in four parts over the range of a column, NULLs included."""
    events = read_table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 10 > 0, F.col("user_id")).alias("user_id"), "event_type")
    options = _database(spark, events, "events")
    source = JDBCExtractorFullLoad("select event_id, user_id, event_type from events where event_id > 5;", options, cache=False, partition_column="user_id", num_partitions=4)
    df = source.extract()
    assert df.rdd.getNumPartitions() == 4
    return df.toDF("event_id", "user_id", "event_type")


def jdbc_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """Loads between the bounds of a log, from a database, through pipelines whose sink fails once: nothing is skipped, nothing comes twice."""
    options = _database(spark, read_table(spark, sf, "events").select("event_id", "event_type"), "events")
    log, target = _name("log"), _name("target")
    spark.sql(f"create table {log} (first_value string, last_value string, partition_column string, dt int) using parquet partitioned by (partition_column, dt)")

    class Failing:
        def load(self, df):
            raise RuntimeError("the sink failed")

    def run(day: int, where: str, sink=None):
        source = JDBCExtractorIncremental(day, options, f"(select * from events where {where}) as e", log, values_partition_column="event_id", cache=False, num_partitions=2)
        sink = sink or HiveLoader("default", target, [{"column_name": "dt", "column_type": "IntegerType", "default_value": day}])
        Pipeline().set_extractor(source).set_loader(sink).execute()

    try:
        run(20200101, "mod(event_id, 2) = 0 and event_id <= 400")
        try:
            run(20200102, "event_id <= 700", Failing())
        except RuntimeError:
            run(20200102, "event_id <= 700")
        run(20200103, "event_id > 0")
        rows = [tuple(r) for r in spark.table(target).groupBy("dt").agg(F.count("*").alias("n"), F.min("EVENT_ID").alias("a"), F.max("EVENT_ID").alias("b")).collect()]
    finally:
        spark.sql(f"drop table {log}")
        spark.sql(f"drop table if exists {target}")
    return spark.createDataFrame(rows, "dt int, n bigint, first_id bigint, last_id bigint")


def bounds_of_log(spark: SparkSession, sf: str) -> DataFrame:
    """What loads of several days would read by a log, whose column is found in the log itself."""
    log = _name("log")
    spark.sql(f"create table {log} (first_value string, last_value string, partition_column string, dt int) using parquet partitioned by (partition_column, dt)")
    try:
        logged = BoundsLog(log, "n_nationkey")
        for day in (15, 16, 17):
            logged.write(20180500 + day, f"2018-05-{day} 03:30:00", f"2018-05-{day + 1} 03:29:59")
        rows = [(day, (b := BoundsLog(log).bounds(day)).lower, b.upper) for day in (20180510, 20180515, 20180517, 20180520)]
    finally:
        spark.sql(f"drop table {log}")
    return spark.createDataFrame(rows, "dt int, lower string, upper string")


# sinks


def jdbc_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Rows written into a database in two loads and read back."""
    nations = read_table(spark, sf, "nation").select(F.col("n_nationkey").alias("N_NATIONKEY"), F.col("n_name").alias("N_NAME"))
    options = _database(spark, nations.limit(0), "target")
    JDBCLoader(options, "target").load(nations.where("N_NATIONKEY < 10"))
    JDBCLoader(options, "target", num_partitions=2).load(nations.where("N_NATIONKEY >= 10"))
    return JDBCExtractorFullLoad("select * from target", options, cache=False).extract().toDF("n_nationkey", "n_name")


def table_append(spark: SparkSession, sf: str) -> DataFrame:
    """Appends to a partition, and what a table refuses."""
    nations, table = read_table(spark, sf, "nation").select("n_nationkey", "n_name"), _name("nations")
    part = [{"column_name": "dt", "column_type": "IntegerType", "default_value": 1}]
    refused = []

    def load(df, **options):
        try:
            HiveLoader("default", table, part, **options).load(df)
        except Exception:
            refused.append(len(refused))

    try:
        load(nations, auto_create_table=False)
        load(nations)
        load(nations.where("n_nationkey < 5"), clear_partition=False, repartition_size=2)
        load(nations.select("n_name", "n_nationkey"), clear_partition=False)
        load(nations.withColumn("more", F.lit(1)), clear_partition=False)
        rows = [(r["n_nationkey"], r["n"], len(refused)) for r in spark.table(table).groupBy("n_nationkey").agg(F.count("*").alias("n")).collect()]
    finally:
        spark.sql(f"drop table if exists {table}")
    return spark.createDataFrame(rows, "n_nationkey int, n bigint, refused int")


# comments


def comments_inserted(spark: SparkSession, sf: str) -> DataFrame:
    """Comments of a stored table, of a mapping and of the columns themselves, merged in both modes."""
    table, out = _name("commented"), []
    spark.sql(f"create table {table} (n_nationkey int comment 'the key', n_name string comment '', n_regionkey int comment 'its region') using parquet")
    try:
        given = update_comment(read_table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), "n_regionkey", "own")
        for mode in (AnnotatorMode.insert, AnnotatorMode.upsert):
            df = Annotator({"n_nationkey": "mapped", "n_name": "a name"}, mode=mode, sql_source_table_identifier=table).transform(given)
            out += [(mode.value, f.name, f.metadata.get("comment")) for f in df.schema.fields]
        out += [("stored", c, text) for c, text in load_comments(table, spark).items()]
    finally:
        spark.sql(f"drop table {table}")
    return spark.createDataFrame(out, "origin string, column_name string, comment string")


# errors


def refusals(spark: SparkSession, sf: str) -> DataFrame:
    """Which errors wrong mappings, rules, options and definitions raise."""
    nations = read_table(spark, sf, "nation")
    twice = nations.select("n_name", F.lit(1).alias("N_NAME"))
    options = {"url": "jdbc:x", "driver": "d", "user": "u"}
    cases = {
        "missing column": lambda: Mapper([("a", "no_such", "int")]).transform(nations),
        "ambiguous column": lambda: Mapper([("a", "n_name", "string")]).transform(twice),
        "ambiguous column skipped": lambda: Mapper([("a", "n_name", "string"), ("b", F.lit(1), "int")], ignore_ambiguous_columns=True).transform(twice),
        "short line": lambda: Mapper([("a", "n_name")]).transform(nations),
        "no such mode": lambda: Mapper([("a", "n_name", "string")], mode="no_such_mode").transform(nations),
        "wrong type": lambda: Mapper([("a", "n_name", "int")], mode=MapperMode.rename_and_validate).transform(nations),
        "no elements": lambda: EnumCleaner({"n_name": {"mode": "allow"}}).transform(nations),
        "no mode": lambda: EnumCleaner({"n_name": {"elements": ["x"]}}).transform(nations),
        "no password": lambda: JDBCExtractorFullLoad("select 1", options),
        "password no text": lambda: JDBCExtractorFullLoad("select 1", {**options, "password": 1}),
        "no path": lambda: JSONExtractor(),
        "no partition column": lambda: HiveLoader("d", "t", [{"column_type": "IntegerType"}]),
        "no expression": lambda: Sieve(5).transform(nations),
    }
    rows = []
    for case, act in cases.items():
        try:
            act()
            rows.append((case, "none"))
        except Exception as e:
            rows.append((case, type(e).__name__))
    return spark.createDataFrame(rows, "case string, error string")


# pipelines, own parts, logging


def pipeline_by_http(spark: SparkSession, sf: str) -> DataFrame:
    """A pipeline described by a service, fetched over HTTP from this machine."""
    target = _name("served")
    spec = {
        "extractor": {"name": "CSVExtractor", "params": {"input_path": shared_dir(spark, "csv")}},
        "transformers": [{"name": "Sieve", "params": {"filter_expression": "n_regionkey = 1"}}, {"name": "Mapper", "params": {"mapping": [["key", "n_nationkey", "to_long"], ["name", "n_name", "to_str"]]}}],
        "loader": {"name": "HiveLoader", "params": {"db_name": "default", "table_name": target, "partition_definitions": [{"column_name": "dt", "column_type": "IntegerType", "default_value": 1}]}},
    }
    read_table(spark, sf, "nation").write.option("sep", ";").option("header", True).csv(spec["extractor"]["params"]["input_path"])

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            body = json.dumps(spec if asked == {"entity": "nation"} else {}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        PipelineFactory(f"http://127.0.0.1:{server.server_port}/pipeline/get").execute({"entity": "nation"})
        rows = [tuple(r) for r in spark.table(target).select("key", "name", "dt").collect()]
    finally:
        server.shutdown()
        server.server_close()
        spark.sql(f"drop table if exists {target}")
    return spark.createDataFrame(rows, "key bigint, name string, dt int")


def own_component(spark: SparkSession, sf: str) -> DataFrame:
    """A registered step of one's own, and a pipeline that is built, cleared and built anew."""

    class Tripler:
        def __init__(self, by: int = 3):
            self.by = by

        def transform(self, df):
            return df.withColumn("tripled", F.col("r_regionkey") * self.by)

    register(Tripler)
    try:
        df = build_pipeline({"transformers": [{"name": "Tripler", "params": {"by": 3}}]}, read_table(spark, sf, "region")).execute()
    finally:
        COMPONENTS.pop("Tripler")
    built = Pipeline(input_df=df, bypass_loader=True).add_transformers(Sieve("false")).clear_transformers()
    return built.add_transformers([Sieve("r_regionkey > 0"), lambda d: d.select("r_regionkey", "tripled")]).execute()


def json_python_style(spark: SparkSession, sf: str) -> DataFrame:
    """JSON text as a Python function would write it, by an Arrow UDF: objects, lists, maps and times."""
    value = F.struct(F.col("r_regionkey").alias("k"), F.lit("é").alias("n"))
    rows = read_table(spark, sf, "region").select(
        "r_regionkey", value.alias("o"), F.array(value).alias("l"), F.create_map(F.lit("a"), F.col("r_regionkey")).alias("m"), F.array(F.col("r_name")).alias("t"),
        F.timestamp_seconds(F.lit(1577934245)).alias("at"),
    )
    return rows.select("r_regionkey", *[fn.to_json_string(c, c, python_style=True) for c in ("o", "l", "m", "t", "at")])


def log_levels(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(e, logging.getLevelName(level_of(e))) for e in ("dev", "development", "test", "prod", "", None)], "environment string, level string")


QUERIES = {f.__name__: f for f in (
    json_inferred, json_sequence, csv_inferred, input_paths, jdbc_parallel, jdbc_incremental, bounds_of_log, jdbc_sink, table_append, comments_inserted, refusals,
    pipeline_by_http, own_component, json_python_style, log_levels,
)}
