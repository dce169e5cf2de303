"""Queries p1 to p6 over the test tables, with production parameters and over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators.drift import appearing_alternatives, file_unions, schema_changes, unify
from tributary.operators.instants import InstantDictionary, integer_to_seconds, integer_to_us, normalise, number_unit
from tributary.operators.intervals import IntervalStore, log_intervals, unread_of
from tributary.operators.nested import flatten_records
from tributary.operators.packed import infer_delimiters, split_packed
from tributary.operators.profile import ColumnRule, Profile
from tributary.runtime import read_table, shared_dir

MOCK_RULES = [
    ColumnRule("email", form=r"[A-Za-z0-9._+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ColumnRule("gender", form="[FM]", order=("F", "M"), distribution=True),
    ColumnRule("latitude", form=r"-?[0-9]+(?:\.[0-9]+)?", lowest=-90, highest=90, distribution=True),
    ColumnRule("version", lowest=1, highest=99, distribution=True),
]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    status = flatten_records(read_table(spark, sf, "status_records"), "rec_nr", ["a", "b", "c"]).bridge
    users = flatten_records(read_table(spark, sf, "test_mapper"), "id", ["attributes"]).bridge.where("path <> 'attributes'")
    both = status.withColumn("t", F.lit("status_records")).unionByName(users.withColumn("t", F.lit("test_mapper")))
    at = lambda i: F.coalesce(F.get("ordinals", F.lit(i)), F.lit(-1))
    return both.select(
        F.col("t").alias("parent_table"), F.col("record_key").alias("parent_id"),
        F.element_at(F.split("path", r"\."), -1).alias("child_name"), at(0).alias("pos"), at(1).alias("sub_pos"),
    )


def p1_contacts(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct contact objects, each stored once, with the number of their occurrences."""
    tables = flatten_records(read_table(spark, sf, "test_mapper"), "id", ["attributes"])
    path = "attributes.friends.contacts"
    uses = tables.bridge.where(F.col("path") == path).groupBy("identity").agg(F.count("*").alias("occurrences"))
    return tables.objects(path).join(uses, "identity").select("kind", "value", "occurrences")


def p1_friends(spark: SparkSession, sf: str) -> DataFrame:
    """The flat table of friends, put together from the bridge and the objects stored once."""
    tables, path = flatten_records(read_table(spark, sf, "test_mapper"), "id", ["attributes"]), "attributes.friends"
    uses = tables.bridge.where(F.col("path") == path).select(F.col("record_key").alias("parent_id"), F.get("ordinals", F.lit(0)).alias("pos"), "identity")
    friends = tables.objects(path).withColumnRenamed("id", "friend_id")
    return uses.join(friends, "identity").select("parent_id", "pos", "friend_id", "first_name", "last_name", F.col("contacts_identity").isNotNull().alias("has_contacts"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    found = schema_changes(read_table(spark, sf, "raw_records"), "feed_nr", "file_nr", "payload", "attributes", "id")
    return found.select(
        F.col("feed").cast("int").alias("feed_nr"), F.col("file").cast("int").alias("file_nr"), "change_kind", "field_path", "old_path"
    )


def p2_alternatives(spark: SparkSession, sf: str) -> DataFrame:
    """Where each JSON type of each path appears first in a feed."""
    unions = file_unions(read_table(spark, sf, "raw_records"), "feed_nr", "file_nr", "payload", "attributes")
    return appearing_alternatives(unions).select(F.col("feed").alias("feed_nr"), F.col("path").alias("field_path"), "json_type", F.col("file").alias("file_nr"))


def p2_unified(spark: SparkSession, sf: str) -> DataFrame:
    raw = read_table(spark, sf, "raw_records")
    return unify(raw, ["feed_nr", "file_nr", "line_nr"], "payload", "attributes", "id", "feed_nr", "file_nr", exact_numbers=True)


def p2_cells(spark: SparkSession, sf: str) -> DataFrame:
    """How many values of each line the unified table holds, nested ones and those in arrays counted one by one."""
    table, keys = p2_unified(spark, sf), ["feed_nr", "file_nr", "line_nr"]
    kinds = ("string", "number", "boolean", "object", "array", "integer", "decimal")
    texts = [f for f in table.schema.fields[4:] if not any(f.name.endswith(f"__{k}") for k in kinds)]
    filled = lambda c, kind: F.aggregate(c, F.lit(0), lambda n, x: n + filled(x, kind.elementType)) if kind.typeName() == "array" else F.when(c.isNotNull(), 1).otherwise(0)
    each = [F.coalesce(filled(F.col(f"`{f.name}`"), f.dataType), F.lit(0)) for f in texts]
    return table.groupBy(*keys).agg(F.sum(reduce(Column.__add__, each, F.lit(0))).alias("n_cells"))


def _profile(spark: SparkSession, sf: str) -> Profile:
    return Profile(read_table(spark, sf, "mock_data"), "dt", "row_nr", MOCK_RULES)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _profile(spark, sf).findings().select(F.col("load").alias("dt"), "column_name", "finding", F.col("key").alias("row_nr"))


def p3_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    """Lowest and highest are those of the texts, as in the query's SQL; ``p3_ranges`` has those of the values."""
    found = _profile(spark, sf).aggregates()
    return found.select(F.col("load").alias("dt"), "column_name", "n_rows", "n_null", "n_distinct", F.col("first_text").alias("lowest"), F.col("last_text").alias("highest"))


def p3_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """The range of each column's values in each load, numbers in the order of numbers."""
    return _profile(spark, sf).aggregates().select(F.col("load").alias("dt"), "column_name", "lowest", "highest")


def p3_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return _profile(spark, sf).coverage().withColumnRenamed("load", "dt")


def p3_expressions(spark: SparkSession, sf: str) -> DataFrame:
    """The induced expressions with the number of distinct values they describe."""
    return _profile(spark, sf).expressions()


def p3_departures(spark: SparkSession, sf: str) -> DataFrame:
    """Values that the expressions of the load before do not describe; no declared form decides here."""
    return _profile(spark, sf).departures().select(F.col("load").alias("dt"), "column_name", "expression", F.col("key").alias("row_nr"))


def p3_coverage_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Expressions whose share of a load's values moved against the load before."""
    return _profile(spark, sf).coverage_findings().withColumnRenamed("load", "dt")


def _bound(text):
    number = text.try_cast("bigint")
    stamp = F.try_to_timestamp(F.concat(text, F.lit(" +00:00")), F.lit("yyyy-MM-dd HH:mm:ss XXX"))
    return F.coalesce(integer_to_seconds(number), F.unix_seconds(stamp))


def _updates(spark: SparkSession, sf: str):
    """The rows with their time in whole seconds, and what the logged runs have read."""
    log = read_table(spark, sf, "load_log").where("partition_column = 'updated_at_sec' and run_state = 'succeeded'")
    log = log.select("dt", _bound(F.trim("first_value")).alias("lo"), _bound(F.trim("last_value")).alias("hi"))
    rows = read_table(spark, sf, "mock_data").select("id", "updated_at_sec", "dt", integer_to_seconds(F.col("updated_at_sec")).alias("at"))
    return rows, log_intervals(log, "dt", "lo", "hi")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """The next run over a store that has adopted the log: its output and the merged intervals are committed together."""
    rows, logged = _updates(spark, sf)
    store = IntervalStore(spark)
    store.adopt(logged)
    store.process_changes(rows, ["id", "updated_at_sec"], "dt", "at")
    return store.read()


def p4_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """The store's intervals after the next run, merged; a run after it finds nothing to read."""
    rows, logged = _updates(spark, sf)
    store = IntervalStore(spark)
    store.adopt(logged)
    store.process_changes(rows, ["id", "updated_at_sec"], "dt", "at")
    store.process_changes(rows, ["id", "updated_at_sec"], "dt", "at")
    again = unread_of(rows, ["id", "updated_at_sec"], "dt", "at", store.covered()).count()
    return store.intervals().withColumn("due_again", F.lit(again))


def p4_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Rows read by four runs over growing, out-of-order deliveries, one of which fails: each row once."""
    rows = read_table(spark, sf, "mock_data").select("row_nr", "dt", "id")
    store, days = IntervalStore(spark), [r[0] for r in rows.select("dt").distinct().orderBy("dt").collect()]

    def lost(_: DataFrame) -> DataFrame:
        raise RuntimeError("an executor was lost")

    store.process(rows.where(F.col("dt").isin(days[::3])), "row_nr")
    try:
        store.process(rows.where(F.col("dt").isin(days[1::2])), "row_nr", lost)
    except RuntimeError:
        store.process(rows.where(F.col("dt").isin(days[1::2])), "row_nr")
    store.process(rows, "row_nr")
    store.compact()
    return store.read()


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Any foreign character separates by definition, so a source's set holds all candidates seen in it (``min_score`` 0)."""
    cells = read_table(spark, sf, "status_records").select("rec_nr", "src", F.col("b.itms").alias("itms"))
    return split_packed(cells, ["rec_nr"], "src", "itms", min_score=0.0)


def p5_inferred(spark: SparkSession, sf: str) -> DataFrame:
    """Cells written with one delimiter a source, in which every sixth holds other marks inside a name: only the scores tell them apart."""
    mark = F.when(F.col("src") == "crm_alp", ";").when(F.col("src") == "shop_east", "|").otherwise(",")
    name = F.when(F.col("rec_nr") % 6 == 0, "Pump & Valve #9 (old)").otherwise("net")
    cell = F.concat_ws("", F.col("rec_nr").cast("string"), mark, name, mark, F.lit("x"), (F.col("rec_nr") % 7).cast("string"))
    return split_packed(read_table(spark, sf, "status_records").select("rec_nr", "src", cell.alias("cell")), ["rec_nr"], "src", "cell")


def p5_delimiters(spark: SparkSession, sf: str) -> DataFrame:
    cells = read_table(spark, sf, "status_records").select("src", F.col("b.itms").alias("itms"))
    found = infer_delimiters(cells, "src", "itms")
    return found.select("src", "delimiter", "cells", *[F.round(c, 8).alias(c) for c in ("consistency", "regularity", "score")], "chosen")


def _stamps(spark: SparkSession, sf: str) -> DataFrame:
    """The texts of ``status_records`` with the zones and day orders of their sources, copies once."""
    zones = read_table(spark, sf, "source_zones").dropDuplicates(["src"])
    status = read_table(spark, sf, "status_records").select("rec_nr", "src", F.col("a.ts").alias("a"), F.col("b.ts").alias("b"))
    status = status.groupBy("rec_nr").agg(F.min(F.struct("src", "a", "b")).alias("x")).select("rec_nr", "x.*")
    status = status.join(zones, "src", "left")
    cell = lambda name, v: F.struct(F.lit(name).alias("field_name"), F.trim(v).alias("raw"))
    texts = status.select(
        F.lit("status_records").alias("table_name"), F.col("rec_nr").alias("row_key"),
        F.explode(F.array(cell("a.ts", F.col("a")), cell("b.ts", F.col("b")))).alias("c"), F.col("tz_name").alias("zone"), "day_order",
    )
    return texts.select("table_name", "row_key", "c.*", "zone", "day_order").where("raw <> ''")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Texts go through the dictionary; the whole numbers of ``mock_data`` are answered in place."""
    columns = ["table_name", "row_key", "field_name", "epoch_us"]
    texts = normalise(_stamps(spark, sf), InstantDictionary(spark)).where(F.col("epoch_us").isNotNull()).select(*columns)
    cell = lambda c: F.struct(F.lit(c).alias("field_name"), number_unit(F.col(c)).alias("unit"), integer_to_us(F.col(c)).alias("epoch_us"))
    numbers = read_table(spark, sf, "mock_data").select(F.lit("mock_data").alias("table_name"), F.col("row_nr").alias("row_key"), F.explode(F.array(cell("updated_at_sec"), cell("updated_at_ms"))).alias("c"))
    named = F.when(F.col("field_name") == "updated_at_sec", "s").otherwise("ms")
    numbers = numbers.select("table_name", "row_key", "c.*").where(F.col("unit") != named).select(*columns)
    return texts.unionByName(numbers)


def p6_later(spark: SparkSession, sf: str) -> DataFrame:
    """A second run over a stored dictionary: ``b.ts`` after ``a.ts``, so that only texts never seen before are parsed."""
    stamps, folder = _stamps(spark, sf), shared_dir(spark, "instants")
    InstantDictionary(spark, folder).add(stamps.where("field_name = 'a.ts'"))
    later = normalise(stamps.where("field_name = 'b.ts'"), InstantDictionary(spark, folder))
    return later.where(F.col("epoch_us").isNotNull()).select("row_key", "epoch_us")


QUERIES = {f.__name__: f for f in (
    p1_found, p1_contacts, p1_friends, p2_found, p2_alternatives, p2_unified, p2_cells, p3_found, p3_aggregates, p3_ranges, p3_coverage, p3_expressions, p3_departures, p3_coverage_changes, p4_found, p4_intervals, p4_runs, p5_found, p5_inferred, p5_delimiters, p6_found, p6_later,
)}
