"""Top N items within every group, by a hot-cold split.

Groups are counted exactly. The ``heavy_share`` largest of those above ``heavy_rows`` are heavy (any other group is
smaller than a ``heavy_share``-th of all rows or than ``heavy_rows``, so no group left to one window is hot): their rows
are spread over salts by position, so that copies spread, too, range partitioned by group and salt, and cut to the best N
of each salt by sorted windows. Copies among what remains are reduced map-side, after which at most N rows per salt
meet in a group's last window. Light groups go to an ordinary window. Both are united. The table is read once to
count, once for the light groups and twice (sampling its ranges) for the heavy ones.

Defined results
* Order columns are taken as given, with NULLs last in either direction; further ties are broken by
  ``tie_break`` ascending, then by all other columns, so results are the same on every run.
* Rows that agree in group, order and ``tie_break`` columns are copies: they count once and one is returned.
* A NULL group is a group. Groups with fewer than N rows are returned whole; empty tables give no rows.
* ``n`` below 1 is an error. Extra columns are carried along; helper columns never clash with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def _order(order_by: list[tuple[str, bool]], tie_break: list[str]) -> list[Column]:
    columns = [F.col(f"`{c}`").desc_nulls_last() if desc else F.col(f"`{c}`").asc_nulls_last() for c, desc in order_by]
    return columns + [F.col(f"`{c}`").asc_nulls_last() for c in tie_break]


def _fresh(df: DataFrame, stem: str) -> str:
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


def _best(df: DataFrame, by: list[str], order: list[Column], n: int, rank: str) -> DataFrame:
    ranked = df.withColumn(rank, F.dense_rank().over(Window.partitionBy(*[F.col(f"`{c}`") for c in by]).orderBy(*order)))
    return ranked.where(F.col(rank) <= n).drop(rank)


def _one_of_copies(df: DataFrame, same: list[str], rank: str) -> DataFrame:
    """One row of those that agree in ``same``, the least by the other columns. Rows that are together by one of ``same`` stay where they are."""
    rest = [c for c in df.columns if c not in same]
    if not rest:
        return df.distinct().select(*[F.col(f"`{c}`") for c in df.columns])
    first = F.row_number().over(Window.partitionBy(*[F.col(f"`{c}`") for c in same]).orderBy(*[F.col(f"`{c}`").asc_nulls_last() for c in rest]))
    return df.withColumn(rank, first).where(F.col(rank) == 1).drop(rank)


def top_n(
    df: DataFrame, group: str, order_by: list[tuple[str, bool]], tie_break: list[str], n: int,
    heavy_rows: int = 1_000_000, heavy_share: int = 10_000, salts: int = SALTS,
) -> DataFrame:
    """The first ``n`` rows of each ``group``; ``order_by`` lists columns with True for descending."""
    if n < 1:
        raise ValueError("n must be at least 1")
    key, salt, rank = _fresh(df, "__heavy"), _fresh(df, "__salt"), _fresh(df, "__rank")
    order = _order(order_by, tie_break)
    same = list(dict.fromkeys([group, *(c for c, _ in order_by), *tie_break]))
    counts = df.groupBy(F.col(f"`{group}`").alias(key)).agg(F.count("*").alias("rows"))
    named = [r[0] for r in counts.where(F.col("rows") > heavy_rows).orderBy(F.col("rows").desc(), key).limit(heavy_share).collect()]
    if not named:
        return _one_of_copies(_best(df, [group], order, n, rank), same, rank)
    values = [v for v in named if v is not None]
    is_heavy = F.coalesce(F.col(f"`{group}`").isin(values) if values else F.lit(False), F.lit(len(values) < len(named)))
    light = _one_of_copies(_best(df.where(~is_heavy), [group], order, n, rank), same, rank)
    salted = df.where(is_heavy).withColumn(salt, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int"))
    ranged = salted.repartitionByRange(F.col(f"`{group}`"), F.col(salt))
    finalists = _best(ranged, [group, salt], order, n, rank).drop(salt)
    columns, rest = [F.col(f"`{c}`") for c in df.columns], [c for c in df.columns if c not in same]
    if rest:  # an aggregation, as windows have no map side
        least = F.min(F.struct(*[x for i, c in enumerate(rest) for x in (F.col(f"`{c}`").isNull().alias(f"n{i}"), F.col(f"`{c}`").alias(f"v{i}"))])).alias(key)
        finalists = finalists.groupBy(*[F.col(f"`{c}`") for c in same]).agg(least)
        finalists = finalists.select(*[F.col(key)[f"v{rest.index(c)}"].alias(c) if c in rest else F.col(f"`{c}`") for c in df.columns])
    else:
        finalists = finalists.distinct()
    return light.unionByName(_best(finalists, [group], order, n, rank).select(*columns))
