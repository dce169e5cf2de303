"""Processing only new or changed records, with processed ranges kept as disjoint intervals.

State is a set of closed, disjoint intervals of sequence numbers that successful runs have read, each with the newest
load that a run over it has seen (``upto``). A run subtracts them from the available range, reads the gaps (late commits
fall into gaps, too), and publishes the merged intervals together with its output in one atomic step. A number of a load
lies in a gap if no interval that reaches this load holds it, so one set of intervals serves all loads.

Defined results
* A record without a usable sequence number (NULL) is never due.
* Empty logs leave everything due; empty tables give empty results.
* Bounds that are NULL, unreadable or reversed read nothing. Rows of a NULL load were seen by no run.
"""

from __future__ import annotations

import heapq
import json
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.runtime import broadcast_within, materialise, shared_dir

#: Pieces of intervals up to which their join with the rows may broadcast; beyond it the rows shuffle by bucket.
BROADCAST_GAPS = 1_000_000


def merged_by(df: DataFrame, keys: list[str], lo: str, hi: str) -> DataFrame:
    """Disjoint intervals ``lo, hi`` of each key, merged by one window over the (small) log."""
    ordered = Window.partitionBy(*keys).orderBy(lo, hi)
    reach = F.max(hi).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(reach.isNull() | (F.col(lo) > reach + 1), 1).otherwise(0)
    numbered = df.where(F.col(lo) <= F.col(hi)).withColumn("__new", starts)
    numbered = numbered.withColumn("__part", F.sum("__new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "__part").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("__part")


def newest_cover(intervals: DataFrame) -> DataFrame:
    """Disjoint ``lo, hi, upto`` from any ``lo, hi, upto``: for every number the greatest ``upto`` of all intervals over it.

    Intervals are cut into blocks of numbers, and each block is swept once in order with a heap of the open intervals.
    """
    usable = intervals.select(F.col("lo").cast("long"), F.col("hi").cast("long"), F.col("upto").cast("long")).where("lo <= hi and upto is not null").distinct()
    first = lambda b: b * BLOCK
    cut = usable.select("*", F.explode(F.sequence(_block(F.col("lo")), _block(F.col("hi")))).alias("b"))
    cut = cut.select("b", F.greatest("lo", first(F.col("b"))).alias("lo"), F.least("hi", first(F.col("b")) + (BLOCK - 1)).alias("hi"), "upto")
    cut = cut.groupBy("b", "lo", "hi").agg(F.max("upto").alias("upto"))

    def sweep(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table[c].to_pylist() for c in ("lo", "hi", "upto"))))
        out: list[list[int]] = []
        open_: list[tuple[int, int]] = []  # (-upto, hi)
        at = i = 0
        while i < len(rows) or open_:
            if not open_:
                at = rows[i][0]
            while i < len(rows) and rows[i][0] == at:
                heapq.heappush(open_, (-rows[i][2], rows[i][1]))
                i += 1
            while open_ and open_[0][1] < at:
                heapq.heappop(open_)
            if not open_:
                continue
            top, hi = -open_[0][0], open_[0][1]
            end = min(hi, rows[i][0] - 1) if i < len(rows) else hi
            if out and out[-1][2] == top and out[-1][1] == at - 1:
                out[-1][1] = end
            else:
                out.append([at, end, top])
            at = end + 1
        return pa.table({c: pa.array([r[k] for r in out], pa.int64()) for k, c in enumerate(("lo", "hi", "upto"))})

    return cut.groupBy("b").applyInArrow(sweep, "lo long, hi long, upto long")


def flag_unread(rows: DataFrame, read: DataFrame, load: str, at: str, flag: str) -> DataFrame:
    """``rows`` with boolean ``flag``: no interval of ``read`` (disjoint ``lo, hi, upto``) that reaches the row's load holds its ``at``.

    The intervals are cut into buckets of about the width of one, so that a row meets few of them; the pieces are
    broadcast after their size is measured, beyond that rows and pieces are joined by bucket.
    """
    g = read.select(F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), F.col("upto").alias("__upto"))
    reach = g.agg(F.min("__lo").alias("a"), F.max("__hi").alias("b"), F.count("*").alias("n")).first()
    if not reach["n"]:
        return rows.withColumn(flag, F.lit(True))
    width = max(1, (reach["b"] - reach["a"]) // reach["n"])
    bucket = lambda c: F.floor(c / F.lit(width).cast("decimal(20,0)")).cast("long")
    pieces = g.select("*", F.explode(F.sequence(bucket(F.col("__lo")), bucket(F.col("__hi")))).alias("__bucket"))
    on = (bucket(F.col(at)) == F.col("__bucket")) & F.col(at).between(F.col("__lo"), F.col("__hi"))
    met = rows.join(broadcast_within(pieces, BROADCAST_GAPS), on, "left")
    seen = F.coalesce(F.col("__upto") >= F.col(load).cast("long"), F.lit(False))
    return met.withColumn(flag, ~seen).drop("__lo", "__hi", "__upto", "__bucket")


def unread_of(rows: DataFrame, change: list[str], load: str, at: str, read: DataFrame) -> DataFrame:
    """The changes (distinct ``change`` columns) of ``rows`` none of whose rows lies in the intervals ``read``.

    One shuffle, on the change, with map-side aggregation.
    """
    usable = rows.select(*dict.fromkeys([*change, load, at])).where(F.col(at).isNotNull())
    flagged = flag_unread(usable, read, load, at, "__due")
    return flagged.groupBy(*change).agg(F.min("__due").alias("__due")).where("__due").drop("__due")


def log_intervals(log: DataFrame, log_load: str, lo: str, hi: str) -> DataFrame:
    """``lo, hi, upto`` of logged runs: a run of load ``log_load`` saw the loads up to its own."""
    return log.select(F.col(lo).cast("long").alias("lo"), F.col(hi).cast("long").alias("hi"), F.col(log_load).cast("long").alias("upto"))


def unread_changes(
    rows: DataFrame, change: list[str], load: str, at: str, log: DataFrame, log_load: str, lo: str, hi: str
) -> DataFrame:
    """The changes of ``rows`` none of whose rows a logged run has read; nothing is committed (see ``IntervalStore``)."""
    return unread_of(rows, change, load, at, materialise(newest_cover(log_intervals(log, log_load, lo, hi)), "intervals"))


#: Numbers per block; intervals are merged block by block, then across the blocks' edges.
BLOCK = 1 << 20
#: Covered ranges, the longest ones, that are pushed down to the source as a filter.
PUSHED_RANGES = 200


def _block(number: Column) -> Column:
    return F.floor(number / F.lit(BLOCK).cast("decimal(10,0)")).cast("long")


def merge_table(intervals: DataFrame) -> DataFrame:
    """Disjoint ``lo, hi`` from any ``lo, hi``: merged within blocks, then over the edges of blocks.

    Only intervals that begin or end a block, at most two a block, meet in one task.
    """
    cut = intervals.where("lo <= hi").select("lo", "hi", F.explode(F.sequence(_block(F.col("lo")), _block(F.col("hi")))).alias("b"))
    first, last = F.col("b") * BLOCK, F.col("b") * BLOCK + (BLOCK - 1)
    inner = merged_by(cut.select("b", F.greatest("lo", first).alias("lo"), F.least("hi", last).alias("hi")), ["b"], "lo", "hi")
    edge = (F.col("lo") == first) | (F.col("hi") == last)
    joined = merged_by(inner.where(edge).withColumn("all", F.lit(0)), ["all"], "lo", "hi").select("lo", "hi")
    return inner.where(~edge).select("lo", "hi").unionByName(joined)


def present_ranges(rows: DataFrame, sequence: str) -> DataFrame:
    """Runs of consecutive numbers ``lo, hi`` that occur in ``rows``."""
    numbers = rows.select(F.col(sequence).cast("long").alias("n")).where("n is not null").distinct().withColumn("b", _block(F.col("n")))
    island = F.col("n") - F.row_number().over(Window.partitionBy("b").orderBy("n"))
    return numbers.withColumn("i", island).groupBy("b", "i").agg(F.min("n").alias("lo"), F.max("n").alias("hi")).select("lo", "hi")


def not_covered(rows: DataFrame, sequence: str, covered: DataFrame) -> DataFrame:
    """The rows whose number lies in none of the disjoint ``lo, hi`` of ``covered``.

    The longest covered ranges become a filter that reaches the scan. Only if there are more, what is left is
    checked in one ordered pass per block, in which rows and intervals follow each other: no pairs are formed.
    """
    found = covered.orderBy((F.col("hi") - F.col("lo")).desc(), "lo").limit(PUSHED_RANGES + 1).collect()
    longest, left = found[:PUSHED_RANGES], rows.where(F.col(sequence).isNotNull())
    for r in longest:
        left = left.where((F.col(sequence) < r["lo"]) | (F.col(sequence) > r["hi"]))
    if len(found) <= PUSHED_RANGES:
        return left
    record = left.select(_block(F.col(sequence)).alias("b"), F.col(sequence).cast("long").alias("at"), F.lit(1).alias("tag"), F.lit(None).cast("long").alias("hi"), F.struct("*").alias("row"))
    rest = covered.where(~F.col("lo").isin([r["lo"] for r in longest]))
    cut = rest.select("hi", "lo", F.explode(F.sequence(_block(F.col("lo")), _block(F.col("hi")))).alias("b"))
    none = F.lit(None).cast(record.schema["row"].dataType)
    cut = cut.select("b", F.greatest("lo", F.col("b") * BLOCK).alias("at"), F.lit(0).alias("tag"), "hi", none.alias("row"))
    reach = F.max("hi").over(Window.partitionBy("b").orderBy("at", "tag").rowsBetween(Window.unboundedPreceding, 0))
    seen = record.unionByName(cut).withColumn("reach", reach).where("tag = 1")
    return seen.where(F.col("reach").isNull() | (F.col("reach") < F.col("at"))).select("row.*")


class IntervalStore:
    """Committed output and processed intervals in one folder, published by one file.

    A run writes its rows to ``data/<run>`` and the merged intervals to ``intervals/<run>``, and then a commit
    file that names them, created without overwriting. Rows of a run without commit are never read, so a run that dies,
    at any point, leaves neither gaps nor repeats behind: the next run finds the same gaps again. Numbers never delivered
    stay open for late commits. Two runs at once cannot both commit: the later one fails and publishes nothing. The
    file system must create a file exclusively, as HDFS and local ones do; object stores need a committer on top.
    """

    #: Reaches every load.
    ALWAYS = (1 << 63) - 1

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, (path or shared_dir(spark, "store")).rstrip("/")
        self._P = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._P(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._P(f"{self.path}/commits"))

    def _latest(self) -> tuple[int, dict]:
        """The number of the last commit begun, and the state of the last one that was written whole."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._P(f"{self.path}/commits"))]
        numbers = sorted((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), reverse=True)
        for number in numbers:
            stream = self._fs.open(self._P(f"{self.path}/commits/{number:012d}.json"))
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            try:
                return numbers[0], json.loads(text)
            except ValueError:  # its writer died, or is still writing and cannot have been told of success
                continue
        return (numbers[0] if numbers else 0), {"intervals": None, "runs": []}

    def _covered(self, state: dict) -> DataFrame:
        """Disjoint ``lo, hi, upto``."""
        if state["intervals"] is None:
            return self.spark.createDataFrame([], "lo bigint, hi bigint, upto bigint")
        return self.spark.read.schema("lo bigint, hi bigint, upto bigint").parquet(f"{self.path}/intervals/{state['intervals']}")

    def intervals(self) -> DataFrame:
        """Processed sequence numbers as disjoint ``lo, hi``, whatever load they were read up to."""
        return merge_table(self._covered(self._latest()[1]).select("lo", "hi"))

    def covered(self) -> DataFrame:
        """Processed sequence numbers as disjoint ``lo, hi, upto``."""
        return self._covered(self._latest()[1])

    def read(self) -> DataFrame | None:
        """The output of all committed runs."""
        runs = self._latest()[1]["runs"]
        return self.spark.read.parquet(*[f"{self.path}/data/{r}" for r in runs]) if runs else None

    def _run(self, number: int) -> str:
        return f"run-{number:012d}-{uuid.uuid4().hex[:8]}"

    def adopt(self, intervals: DataFrame) -> None:
        """Take over what runs elsewhere have read: any ``lo, hi, upto``, merged with the intervals of this store."""
        number, state = self._latest()
        run = self._run(number + 1)
        newest_cover(self._covered(state).unionByName(intervals.select("lo", "hi", "upto"))).write.parquet(f"{self.path}/intervals/{run}")
        self._commit(number + 1, {"intervals": run, "runs": state["runs"]})

    def process_changes(self, rows: DataFrame, change: list[str], load: str, at: str) -> bool:
        """Write the changes of ``rows`` that no run has read, and commit them with the range they were read from.

        A run reads every gap of the available range, so the range counts as read up to the newest load among the rows.
        """
        number, state = self._latest()
        run = self._run(number + 1)
        unread_of(rows, change, load, at, self._covered(state)).write.parquet(f"{self.path}/data/{run}")
        here = rows.agg(F.min(at).cast("long").alias("lo"), F.max(at).cast("long").alias("hi"), F.max(load).cast("long").alias("upto")).where("lo is not null")
        newest_cover(self._covered(state).unionByName(here)).write.parquet(f"{self.path}/intervals/{run}")
        self._commit(number + 1, {"intervals": run, "runs": [*state["runs"], run]})
        return True

    def process(self, source: DataFrame, sequence: str, transform: Callable[[DataFrame], DataFrame] = lambda d: d) -> bool:
        """Read what is due in ``source``, write it transformed, and commit. False if nothing was due.

        The due rows are written down first, so output and intervals come from the same rows whatever arrives
        meanwhile. A sequence number belongs to one record: rows that share a number are read in one run.
        """
        number, state = self._latest()
        done = merge_table(self._covered(state).select("lo", "hi"))
        run = self._run(number + 1)
        staged = f"{self.path}/staged/{run}"
        not_covered(source, sequence, done).write.parquet(staged)
        due = self.spark.read.parquet(staged)
        try:
            if due.limit(1).count() == 0:
                return False
            transform(due).write.parquet(f"{self.path}/data/{run}")
            merged = merge_table(done.unionByName(present_ranges(due, sequence))).withColumn("upto", F.lit(self.ALWAYS))
            merged.write.parquet(f"{self.path}/intervals/{run}")
            self._commit(number + 1, {"intervals": run, "runs": [*state["runs"], run]})
        finally:
            self._fs.delete(self._P(staged), True)
        return True

    def compact(self) -> None:
        """Rewrite the output of all runs as one, so that reading does not list a folder a run. Former commits stay readable."""
        number, state = self._latest()
        if len(state["runs"]) > 1:
            run = self._run(number + 1)
            self.read().write.parquet(f"{self.path}/data/{run}")
            self._commit(number + 1, {"intervals": state["intervals"], "runs": [run]})

    def _commit(self, number: int, state: dict) -> None:
        target = self._P(f"{self.path}/commits/{number:012d}.json")
        try:
            out = self._fs.create(target, False)
        except Exception as e:
            raise RuntimeError(f"another run committed {number} first; nothing of this run was published") from e
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()
