"""Running steps on streams.

Mapper, Sieve, Exploder, the cleaners and the annotator keep no state and apply to a streaming table as they
are. ``NewestByGroup`` needs a finished table; ``newest_in_batches`` keeps a current table up to date instead.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tributary.operators.latest import NewestByGroup
from tributary.sources.base import Loader


def apply_steps(stream: DataFrame, steps: list) -> DataFrame:
    """The steps as parts of the streaming plan; stateful ones refuse a stream by themselves."""
    return reduce(lambda df, step: df.transform(getattr(step, "transform", step)), steps, stream)


def load_in_batches(stream: DataFrame, steps: list, loader: Loader, checkpoint: str, **trigger) -> StreamingQuery:
    """Run steps and a loader on every micro-batch; steps see a finished table each time."""

    def handle(batch: DataFrame, _: int) -> None:
        loader.load(apply_steps(batch, steps))

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def newest_in_batches(stream: DataFrame, newest: NewestByGroup, read: Callable[[], DataFrame | None], write: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Keep the newest row per group: each batch is joined with the stored table and written by ``write``.

    ``write`` must publish atomically and ignore a batch number it has stored already, as batches may be
    delivered again after a failure.
    """

    def handle(batch: DataFrame, number: int) -> None:
        stored = read()
        rows = batch if stored is None else stored.unionByName(batch)
        write(newest.transform(rows), number)

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
