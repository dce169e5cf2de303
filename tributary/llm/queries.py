"""Queries p7 to p10 over the test tables, with production parameters and over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.encodings import find_garbled
from tributary.llm.leakage import find_leaks, remove_spans
from tributary.llm.packing import count_tokens, pack
from tributary.llm.topn import top_n
from tributary.runtime import materialise, read_table


def _newest(spark: SparkSession, sf: str, heavy_rows: int) -> DataFrame:
    rows = read_table(spark, sf, "test_newest_by_group").select("id", "idx", "updated_at", "deleted_at")
    return top_n(rows, "id", [("updated_at", True), ("deleted_at", True)], ["idx"], 3, heavy_rows=heavy_rows).select("id", "idx")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _newest(spark, sf, 100_000)


def p7_split(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the heavy branch for every group of more than 100 rows, so that it runs at any scale."""
    return _newest(spark, sf, 100)


def _packed(spark: SparkSession, sf: str, capacity: int) -> DataFrame:
    sizes = materialise(count_tokens(read_table(spark, sf, "documents"), "doc_id", "text"), "tokens")
    return pack(sizes.withColumnRenamed("item", "doc_id"), "doc_id", "n_tokens", capacity)


def p8_pack_1024(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(spark, sf, 1024)


def p8_pack_4096(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(spark, sf, 4096)


def p8_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of every packing, for both capacities: ``tight`` if at most 1 % more containers than the tokens need (and one a shard)."""
    sizes = materialise(count_tokens(read_table(spark, sf, "documents"), "doc_id", "text"), "tokens").withColumnRenamed("item", "doc_id")
    per_post = sizes.groupBy("doc_id").agg(F.sum("n_tokens").alias("all_tokens"), F.count("*").alias("copies"))
    out = None
    for capacity in (1024, 4096):
        placed = pack(sizes, "doc_id", "n_tokens", capacity)
        posts = placed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("pieces")).join(per_post, "doc_id", "full")
        least = F.coalesce("copies", F.lit(0)) + F.floor(F.coalesce("all_tokens", F.lit(0)) / capacity)  # pieces beyond it would be splits without need
        kept = posts.agg(
            F.count("*").alias("posts"), F.sum((~F.col("n").eqNullSafe(F.col("all_tokens"))).cast("int")).alias("incomplete"),
            F.sum((F.col("pieces") > least).cast("int")).alias("split"),
        )
        bins = placed.groupBy("container").agg(F.sum("n_tokens").alias("used")).agg(
            F.sum((F.col("used") > capacity).cast("int")).alias("overfull"), (F.count("*") <= F.ceil(F.sum("used") / capacity) * 1.01 + 1 + sizes.count() // 50_000).alias("tight")
        )
        one = kept.withColumn("k", F.lit(1)).join(bins.withColumn("k", F.lit(1)), "k")  # a row each
        one = one.select(F.lit(capacity).alias("capacity"), "posts", "incomplete", "split", "overfull", "tight")
        out = one if out is None else out.unionByName(one)
    return out


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    docs, items = read_table(spark, sf, "documents"), read_table(spark, sf, "eval_items")
    return find_leaks(docs, "doc_id", "text", items, "item_id", "item_text")


def p9_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    docs, items = read_table(spark, sf, "documents"), read_table(spark, sf, "eval_items")
    leaks = find_leaks(docs, "doc_id", "text", items, "item_id", "item_text")
    return remove_spans(docs, "doc_id", "text", leaks, items, "item_id", "item_text")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return find_garbled(read_table(spark, sf, "documents"), "doc_id", "text").select("doc_id").distinct()


def p10_restored(spark: SparkSession, sf: str) -> DataFrame:
    found = find_garbled(read_table(spark, sf, "documents"), "doc_id", "text")
    return found.select("doc_id", F.array_join("chains", ", ").alias("chains"), "restored", "lost")


QUERIES = {f.__name__: f for f in (p7_found, p7_split, p8_pack_1024, p8_pack_4096, p8_invariants, p9_found, p9_cleaned, p10_found, p10_restored)}
