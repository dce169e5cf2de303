"""Filling containers of fixed capacity: best-fit decreasing over token counts.

Tokens are counted with a public tokenizer. Items are dealt by a hash into shards of about ``shard_items``,
each packed by itself: items by falling size, each into the open container with the least space that still
fits, found in logarithmic time by a segment tree over remaining capacities (0 to capacity). A shard leaves
only its last few containers open, so little is lost against one global packing, and no task holds more than
a shard's sizes. Texts never travel with the sizes, and copies of an item travel as one row with their number, in blocks
of ``BLOCK``, so that they spread over the shards.

Defined results
* An item longer than the capacity fills containers of its own and leaves one remainder, which is packed like
  an item. No other item is split. ``piece`` numbers the pieces, ``from_token`` and ``n_tokens`` locate them.
* NULL and empty texts have no tokens; they are placed like any item and take no space.
* Repeated rows are items of their own. Shards follow from ids, sizes and numbers of copies alone, and ties in size are taken
  by id, so the same rows give the same result, however they are partitioned.
* Lone surrogates are counted as the replacement character.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SHARD_ITEMS = 50_000
#: Copies of one item that go to a shard together.
BLOCK = 100
#: Fixed pattern of the byte-level tokenizer's first split.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

_loaded: dict = {}


def encoder(path: str):
    """The tokenizer in ``path``, loaded once per Python worker."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _loaded[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def count_tokens(df: DataFrame, item: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``item, n_tokens`` of every row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["item", "n_tokens"])

    return df.select(F.col(f"`{item}`").cast("long").alias("item"), F.col(f"`{text}`").alias("t")).mapInArrow(count, "item long, n_tokens long")


class CapacityTree:
    """Open containers by remaining capacity; finds the tightest fit in O(log capacity)."""

    def __init__(self, capacity: int):
        self.leaves = 1 << max(1, capacity.bit_length())
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, remaining: int, container: int) -> None:
        self.bins[remaining].append(container)
        at = self.leaves + remaining
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the container (remaining, number) with the least remaining capacity >= size."""
        at = self.leaves + size
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        remaining = at - self.leaves
        container = self.bins[remaining].pop()
        while at:
            self.count[at] -= 1
            at >>= 1
        return remaining, container


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Container number of each size (all at most ``capacity``), for sizes given in falling order."""
    tree, placed, opened = CapacityTree(capacity), [], 0
    for size in sizes:
        fit = tree.take(size)
        if fit is None:
            fit, opened = (capacity, opened), opened + 1
        placed.append(fit[1])
        tree.add(fit[0] - size, fit[1])
    return placed


def pack(sizes: DataFrame, item: str, size: str, capacity: int, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``item, piece, from_token, n_tokens, container`` for rows of ``item`` (long) and ``size``.

    Container names are ``<shard>-<number>``; full pieces of overlong items are ``<shard>-o<number>``.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    source = sizes.select(F.col(f"`{item}`").alias("item"), F.coalesce(F.col(f"`{size}`"), F.lit(0)).cast("long").alias("n"))
    counted = source.groupBy("item", "n").agg(F.count("*").alias("copies"))
    shards = max(1, -(-sizes.count() // shard_items))
    blocks = F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {BLOCK}"))
    dealt = counted.select("item", "n", "copies", F.explode(blocks).alias("block"))
    dealt = dealt.select("item", "n", F.least(F.col("copies") - F.col("block") * BLOCK, F.lit(BLOCK)).alias("copies"), F.pmod(F.xxhash64("item", "n", "block"), F.lit(shards)).cast("long").alias("shard"))

    def fill(table: pa.Table) -> pa.Table:
        rows = zip(table["item"].to_pylist(), table["n"].to_pylist(), table["copies"].to_pylist())
        rows = sorted(((i, n) for i, n, copies in rows for _ in range(copies)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        shard = table["shard"][0].as_py()
        whole, parts = [], []
        for name, n in rows:
            for piece in range(n // capacity if n > capacity else 0):
                whole.append((name, piece, piece * capacity, capacity, f"{shard}-o{len(whole)}"))
            full = n // capacity if n > capacity else 0
            if n - full * capacity or not full:
                parts.append((name, full, full * capacity, n - full * capacity))
        parts.sort(key=lambda p: -p[3])
        out = whole + [(*p, f"{shard}-{c}") for p, c in zip(parts, best_fit_decreasing([p[3] for p in parts], capacity))]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
        names = ("item", "piece", "from_token", "n_tokens", "container")
        return pa.table({m: pa.array([r[i] for r in out], k) for i, (m, k) in enumerate(zip(names, kinds))})

    packed = dealt.groupBy("shard").applyInArrow(fill, "item long, piece int, from_token long, n_tokens long, container string")
    return packed.withColumnRenamed("item", item)
