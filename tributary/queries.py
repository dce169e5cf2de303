"""Queries over the test tables, one or more for each operator of the library. Whole tables, no row caps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary import functions as fn
from tributary.operators.annotate import Annotator
from tributary.operators.cleaning import EnumCleaner, NullCleaner, ThresholdCleaner
from tributary.operators.explode import Exploder
from tributary.operators.filters import NoIdDropper, Sieve
from tributary.operators.latest import NewestByGroup
from tributary.operators.project import Mapper, MapperMode, MissingColumnHandling
from tributary.plans import Pipeline, build_pipeline
from tributary.runtime import read_table, shared_dir
from tributary.sources import HiveLoader, JDBCExtractorFullLoad, JDBCExtractorIncremental, JSONExtractor, ParquetLoader
from tributary.streaming import apply_steps

NUMBERS = (
    "case pmod(o_orderkey, 5) when 0 then concat('  ', o_orderkey, ' ') when 1 then concat(o_orderkey, '_000') "
    "when 2 then concat(o_orderkey, '.56') when 3 then 'n/a' else concat(o_orderkey, ',5') end"
)
FLAGS = (
    "case pmod(o_orderkey, 9) when 0 then ' On ' when 1 then 'DISABLED' when 2 then '1.0' when 3 then 'maybe' when 4 then 'y' "
    "when 5 then ' false ' when 6 then 'enabled' when 7 then '0' end"
)
STAMPS = (
    "case pmod(o_orderkey, 4) when 0 then cast(unix_seconds(cast(o_orderdate as timestamp)) as string) "
    "when 1 then cast(unix_millis(cast(o_orderdate as timestamp)) + 7 as string) when 2 then ' 2020-08-12 12:43:14 ' else 'Hello' end"
)


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # the tables' timestamps have no zone
    return read_table(spark, sf, "orders")


def _to_num(function, name):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows = _orders(spark, sf).select("o_orderkey", F.expr(NUMBERS).alias("x"))
        return rows.select("o_orderkey", function("x", "value"))

    query.__name__ = name
    return query


to_num_int, to_num_long = _to_num(fn.to_int, "to_num_int"), _to_num(fn.to_long, "to_num_long")
to_num_double, to_num_float = _to_num(fn.to_double, "to_num_double"), _to_num(fn.to_float, "to_num_float")
to_num_smallint = _to_num(lambda c, n: fn.to_num(c, n, cast="smallint"), "to_num_smallint")


def to_bool(spark, sf):
    return _orders(spark, sf).select("o_orderkey", F.expr(FLAGS).alias("x")).select("o_orderkey", fn.to_bool("x", "flag"))


def to_bool_words(spark, sf):
    rows = _orders(spark, sf).select("o_orderkey", "o_orderstatus")
    own = fn.to_bool("o_orderstatus", "flag", true_values=["f"], false_values=["o"], replace_default_values=True)
    return rows.select("o_orderkey", own)


def to_timestamp(spark, sf):
    rows = _orders(spark, sf).select("o_orderkey", F.expr(STAMPS).alias("x"))
    return rows.select("o_orderkey", fn.to_timestamp("x", "at", cast="timestamp_ntz"))


def to_timestamp_fmt_out(spark, sf):
    return _orders(spark, sf).select("o_orderkey", fn.to_timestamp("o_orderdate", "day", output_format="yyyy/MM/dd HH:mm"))


def to_timestamp_fmt_in(spark, sf):
    rows = _orders(spark, sf).select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "20201324").otherwise(F.date_format("o_orderdate", "yyyyMMdd")).alias("x"))
    return rows.select("o_orderkey", fn.to_timestamp("x", "at", input_format="yyyyMMdd", cast="timestamp_ntz"))


def str_to_array_int(spark, sf):
    rows = read_table(spark, sf, "part").select("p_partkey", F.expr("concat(' [ ', p_size, ' ,  ', p_partkey, '.6, x ] ')").alias("x"))
    return rows.select("p_partkey", fn.str_to_array("x", "items", cast="int"))


def str_to_array_sep(spark, sf):
    return _orders(spark, sf).select("o_orderkey", fn.str_to_array("o_orderpriority", "items", sep="-"))


def map_values_equals(spark, sf):
    return _orders(spark, sf).select("o_orderkey", fn.map_values("o_orderstatus", "status", mapping={"f": "filled", "O": "open"}))


def map_values_like(spark, sf):
    mapping = {"%ring%": "ring", "small%": F.col("p_brand")}
    return read_table(spark, sf, "part").select("p_partkey", fn.map_values("p_name", "kind", mapping=mapping, pattern_type="sql_like", default="other"))


def map_values_regex(spark, sf):
    return read_table(spark, sf, "part").select("p_partkey", fn.map_values("p_name", "kind", mapping={"(?i)^s.*g$": 1, "a": 2}, pattern_type="regex", default=0, cast="int"))


def meters_to_cm(spark, sf):
    return read_table(spark, sf, "part").select("p_partkey", fn.meters_to_cm("p_retailprice", "cm"))


def has_value(spark, sf):
    x = F.expr("case pmod(p_partkey, 4) when 0 then '' when 1 then '0' when 2 then ' ' end").alias("x")
    return read_table(spark, sf, "part").select("p_partkey", x).select("p_partkey", fn.has_value("x", "filled"))


def as_is_coalesce(spark, sf):
    rows = _orders(spark, sf).select("o_orderkey", F.expr("nullif(o_orderstatus, 'P')").alias("x"), "o_orderpriority")
    return rows.select("o_orderkey", fn.as_is("x", "status", alt_src_cols=["o_orderpriority"]))


def to_str(spark, sf):
    return _orders(spark, sf).select("o_orderkey", fn.to_str("o_custkey", "customer"), fn.to_str(F.col("o_custkey") % 2 == 0, "even"))


def apply_lower(spark, sf):
    return _orders(spark, sf).select("o_orderkey", fn.apply("o_orderpriority", "priority", func=F.lower))


def to_json_string(spark, sf):
    events = read_table(spark, sf, "events")
    value = F.struct(F.col("user_id").alias("u"), F.col("event_type").alias("t"), F.expr("nullif(event_type, 'click')").alias("n"))
    return events.select("event_id", fn.to_json_string(value, "json"))


def _mapping() -> list[tuple]:
    return [
        ("key", "o_orderkey", "LongType"), ("customer", "o_custkey", fn.to_str), ("price", "o_totalprice", "int"),
        ("o_orderstatus", "o_orderstatus", fn.map_values(mapping={"F": "filled"})), ("day", F.to_date("o_orderdate"), "DateType()"),
    ]


def mapper_replace(spark, sf):
    return Mapper(_mapping()).transform(_orders(spark, sf))


def mapper_append(spark, sf):
    return Mapper(_mapping(), mode=MapperMode.append).transform(_orders(spark, sf).drop("o_orderdate").withColumn("o_orderdate", F.lit("2020-01-01")))


def mapper_prepend(spark, sf):
    return Mapper(_mapping()[:4], mode=MapperMode.prepend).transform(_orders(spark, sf).drop("o_orderdate"))


def mapper_nullify(spark, sf):
    mapping = [("key", "o_orderkey", "bigint"), ("gone", "no.such.field", "int"), ("flag", "missing", fn.has_value)]
    return Mapper(mapping, missing_column_handling=MissingColumnHandling.nullify).transform(_orders(spark, sf))


def mapper_skip(spark, sf):
    mapping = [("key", "o_orderkey", "bigint"), ("gone", "no.such.field", "int"), ("status", "o_orderstatus", "string")]
    return Mapper(mapping, missing_column_handling=MissingColumnHandling.skip).transform(_orders(spark, sf))


def mapper_validate(spark, sf):
    mapping = [("key", "o_orderkey", "bigint"), ("status", "o_orderstatus", "StringType"), ("price", "o_totalprice", "double")]
    return Mapper(mapping, mode=MapperMode.rename_and_validate).transform(_orders(spark, sf))


def mapper_nested(spark, sf):
    mapping = [("id", "id", "bigint"), ("first", "attributes.first_name", "string"), ("friends", "attributes.friends.id", "array<bigint>"), ("lat", "location.latitude", fn.to_double)]
    return Mapper(mapping).transform(read_table(spark, sf, "test_mapper"))


def mapper_comments(spark, sf):
    """Comments set by the mapper, read back from the schema."""
    mapping = [("key", "o_orderkey", "bigint", "the order"), ("status", "o_orderstatus", "string", "")]
    df = Annotator({"status": "its state"}).transform(Mapper(mapping).transform(_orders(spark, sf)))
    return spark.createDataFrame([(f.name, f.metadata.get("comment")) for f in df.schema.fields], "column_name string, comment string")


def sieve(spark, sf):
    kept = Sieve("l_quantity > 30 and l_returnflag rlike '^[AR]$'").transform(read_table(spark, sf, "lineitem"))
    return kept.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


def no_id_dropper(spark, sf):
    return NoIdDropper(["email", "gender"]).transform(read_table(spark, sf, "mock_data")).select("row_nr", "email", "gender")


def enum_allow_struct(spark, sf):
    rules = {"c_mktsegment": {"elements": ["BUILDING", "MACHINERY"], "mode": "allow", "default": "OTHER"}}
    df = EnumCleaner(rules, "audit").transform(read_table(spark, sf, "customer"))
    return df.select("c_custkey", "c_mktsegment", F.col("audit.c_mktsegment").alias("was"))


def enum_disallow_map(spark, sf):
    rules = {"o_orderpriority": {"elements": ["1-URGENT", "5-LOW"], "mode": "disallow", "default": F.col("o_orderstatus")}}
    df = EnumCleaner(rules, "audit", store_as_map=True).transform(_orders(spark, sf))
    return df.select("o_orderkey", "o_orderpriority", F.col("audit")["o_orderpriority"].alias("was"), F.size("audit").alias("n_changed"))


def threshold_map(spark, sf):
    rules = {"l_quantity": {"min": 5, "max": 45, "default": -1}, "l_discount": {"min": 0.02, "max": 0.08}}
    df = ThresholdCleaner(rules, "audit", store_as_map=True).transform(read_table(spark, sf, "lineitem"))
    was = [F.col("audit")[c].alias(f"was_{c}") for c in rules]
    return df.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice", *was)


def threshold_date_dynamic(spark, sf):
    df = read_table(spark, sf, "lineitem").withColumn("floor", F.expr("l_shipdate - interval 1 day * pmod(l_orderkey, 2) + interval 1 day"))
    rules = {"l_shipdate": {"min": F.col("floor"), "max": "1998-01-01 00:00:00", "default": F.col("floor")}}
    return ThresholdCleaner(rules).transform(df).select("l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate")


def null_clean_map(spark, sf):
    df = _orders(spark, sf).select("o_orderkey", F.expr("nullif(o_orderstatus, 'P')").alias("x"))
    df = NullCleaner({"x": {"default": "none"}}, "audit", store_as_map=True).transform(df)
    return df.select("o_orderkey", "x", F.col("audit")["x"].alias("was"))


def clean_sequential(spark, sf):
    """A later rule's default refers to a column that an earlier rule cleaned."""
    df = _orders(spark, sf).select("o_orderkey", "o_orderstatus", "o_orderpriority")
    rules = {
        "o_orderstatus": {"elements": ["F", "O"], "mode": "allow", "default": "X"},
        "o_orderpriority": {"elements": ["5-LOW"], "mode": "disallow", "default": F.col("o_orderstatus")},
    }
    return EnumCleaner(rules, sequential=True).transform(df)


def explode(spark, sf):
    words = read_table(spark, sf, "part").select("p_partkey", F.split("p_type", " ").alias("words"))
    return Exploder("words", "word").transform(words)


def explode_outer(spark, sf):
    words = F.when(F.col("p_partkey") % 3 != 0, F.split("p_type", " ")).otherwise(F.array().cast("array<string>"))
    df = read_table(spark, sf, "part").select("p_partkey", words.alias("words"))
    return Exploder("words", "word", drop_rows_with_empty_array=False).transform(df)


def explode_nested(spark, sf):
    friends = Exploder("attributes.friends", "friend").transform(read_table(spark, sf, "test_mapper"))
    return friends.select("id", F.col("friend.id").alias("friend_id"), F.col("attributes.gender").alias("gender"))


def newest_by_group(spark, sf):
    newest = NewestByGroup("o_custkey", ["o_orderdate"], tie_break=["o_orderkey"])
    return newest.transform(_orders(spark, sf)).select("o_custkey", "o_orderkey", "o_totalprice")


def newest_by_pair(spark, sf):
    newest = NewestByGroup(["id", "secondary_id"], ["updated_at", "deleted_at"], tie_break=["idx"])
    return newest.transform(read_table(spark, sf, "test_newest_by_group"))


def _local_reader(spark: SparkSession, sf: str):
    """Stands in for a database: runs the query over the test tables."""

    def read(_: dict, query: str) -> DataFrame:
        read_table(spark, sf, "events").createOrReplaceTempView("events_source")
        return spark.sql(query)

    return read


JDBC = {"url": "jdbc:none", "driver": "none", "user": "u", "password": "p"}


def jdbc_full(spark, sf):
    query = "select event_type, count(*) as n from events_source group by event_type;"
    return JDBCExtractorFullLoad(query, JDBC, cache=False, reader=_local_reader(spark, sf)).extract()


def incremental_bounds(spark, sf):
    """Two loads through a log: the second reads only what lies beyond the first one's last value."""
    events, table = read_table(spark, sf, "events"), f"bounds_{uuid.uuid4().hex[:12]}"
    spark.sql(f"create table {table} (first_value string, last_value string, partition_column string, dt int) using parquet partitioned by (partition_column, dt)")
    try:
        read = _local_reader(spark, sf)
        make = lambda dt, source: JDBCExtractorIncremental(dt, JDBC, source, table, values_partition_column="event_id", cache=False, reader=read)
        half = events.agg(F.expr("max(event_id) div 2")).first()[0]
        make(20200101, f"(select * from events_source where event_id <= {half})").extract()
        make(20200102, "events_source").extract()
        log = [(r["dt"], r["first_value"], r["last_value"]) for r in spark.table(table).orderBy("dt").collect()]
    finally:
        spark.sql(f"drop table {table}")
    return spark.createDataFrame(log, "dt int, first_value string, last_value string")


def partition_roundtrip(spark, sf):
    """Two partitions written, one of them replaced."""
    nations, table = read_table(spark, sf, "nation"), f"nations_{uuid.uuid4().hex[:12]}"
    part = lambda day: HiveLoader("default", table, [{"column_name": "dt", "column_type": "IntegerType", "default_value": day}])
    try:
        part(1).load(nations)
        part(2).load(nations)
        part(2).load(nations.where("n_regionkey = 1"))
        rows = [tuple(r) for r in spark.table(table).groupBy("dt", "n_regionkey").agg(F.count("*").alias("n")).collect()]
    finally:
        spark.sql(f"drop table if exists {table}")
    return spark.createDataFrame(rows, "dt int, n_regionkey int, n bigint")


def json_roundtrip(spark, sf):
    """Nested users written as JSON lines and read back by the JSON source."""
    users, path = read_table(spark, sf, "test_mapper").drop("_corrupt_record"), shared_dir(spark, "json")
    users.write.json(path)
    df = JSONExtractor(path, schema=users.schema).extract()
    return df.select("id", F.col("attributes.last_name").alias("last_name"), F.size(F.coalesce("attributes.friends", F.array())).alias("n_friends"))


def parquet_roundtrip(spark, sf):
    path = shared_dir(spark, "parquet")
    ParquetLoader(path, partition_by="dt", explicit_partition_values={"dt": 20200101}).load(read_table(spark, sf, "region"))
    return spark.read.parquet(path)


def stream_clean(spark, sf):
    """Stateless steps on a stream, collected by a file sink."""
    schema, out = read_table(spark, sf, "events").schema, shared_dir(spark, "stream")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    steps = [
        Sieve("event_type <> 'view'"), EnumCleaner({"event_type": {"elements": ["click", "purchase"], "mode": "allow", "default": "other"}}),
        Mapper([("event_id", "event_id", "bigint"), ("event_type", "event_type", "string"), ("amount", "value", fn.to_int)]),
    ]
    query = apply_steps(stream, steps).writeStream.option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(path=out, format="parquet")
    query.awaitTermination()
    return spark.read.parquet(out)


def flagship_pipeline(spark, sf):
    """Dirty orders cleaned, filtered and reduced to the newest per customer."""
    orders = _orders(spark, sf).withColumn("price", F.expr("case when o_orderkey % 11 = 0 then 'n/a' else concat(' ', cast(o_totalprice as decimal(12,2))) end"))
    steps = [
        Mapper([
            ("customer", "o_custkey", "bigint"), ("order", "o_orderkey", "bigint"), ("price", "price", fn.to_double),
            ("status", "o_orderstatus", fn.map_values(mapping={"F": "filled", "O": "open"})), ("ordered_at", "o_orderdate", "timestamp_ntz"),
        ]),
        Sieve("status in ('filled', 'open')"),
        ThresholdCleaner({"price": {"min": 1000, "max": 300000, "default": 0}}, "audit", store_as_map=True),
        NewestByGroup("customer", "ordered_at", tie_break="order"),
    ]
    df = Pipeline(input_df=orders, bypass_loader=True).add_transformers(steps).execute()
    return df.select("customer", "order", "price", "status", F.col("audit")["price"].isNotNull().alias("replaced"))


def pipeline_spec(spark, sf):
    spec = {
        "transformers": [
            {"name": "Mapper", "params": {"mapping": [["id", "row_nr", "bigint"], ["lat", "latitude", "to_double"], ["sex", "gender", {"function": "map_values", "mapping": {"m": "M", "f": "F"}, "default": None}]]}},
            {"name": "ThresholdCleaner", "params": {"thresholds": {"lat": {"min": -90, "max": 90}}}},
            {"name": "NullCleaner", "params": {"cleaning_definitions": {"sex": {"default": "?"}}}},
        ],
        "loader": {"name": "ByPass"},
    }
    return build_pipeline(spec, read_table(spark, sf, "mock_data")).execute()


QUERIES = {f.__name__: f for f in (
    to_num_int, to_num_long, to_num_double, to_num_float, to_num_smallint, to_bool, to_bool_words, to_timestamp, to_timestamp_fmt_out,
    to_timestamp_fmt_in, str_to_array_int, str_to_array_sep, map_values_equals, map_values_like, map_values_regex, meters_to_cm, has_value,
    as_is_coalesce, to_str, apply_lower, to_json_string, mapper_replace, mapper_append, mapper_prepend, mapper_nullify, mapper_skip,
    mapper_validate, mapper_nested, mapper_comments, sieve, no_id_dropper, enum_allow_struct, enum_disallow_map, threshold_map,
    threshold_date_dynamic, null_clean_map, clean_sequential, explode, explode_outer, explode_nested, newest_by_group, newest_by_pair,
    jdbc_full, incremental_bounds, partition_roundtrip, json_roundtrip, parquet_roundtrip, stream_clean, flagship_pipeline, pipeline_spec,
)}
