"""Evaluation texts inside a training corpus, found by windows of normalised text.

Text is lower-cased and reduced to letters and digits. A document and an item share ``run`` consecutive
characters only if one of the item's grams of half that length (or less) starts at a document position that is a
multiple of ``stride = run - gram + 1``. So the distinct item grams of all positions form a hash set, which is
broadcast after its size is measured, the document is cut into tiles of ``stride`` characters, and each tile
is one lookup. Only around a hit are the windows of ``run`` characters formed, and these are compared with the distinct
windows of the items, character by character. Nothing is missed, and a gram that an item repeats, or many items
share, multiplies nothing.

Defined results
* NULL and empty texts, and texts shorter than ``run`` after normalising, match nothing.
* Repeated rows give each pair once. Empty tables give empty results. Texts are scanned whole.
* Should the item grams exceed ``max_grams``, or the items' windows the bytes that may be broadcast, the joins are left to
  shuffle; the result is the same.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.runtime import broadcast_within

RUN, GRAM = 60, 30
#: Distinct item grams (of 8 bytes), and windows, up to which they may be broadcast.
MAX_GRAMS = 4_000_000


def normalise(text: Column) -> Column:
    """What is compared; ``letters_of`` does the same in Python."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}]+", "")


def find_leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, run: int = RUN, gram: int = GRAM, max_grams: int = MAX_GRAMS) -> DataFrame:
    """Distinct ``doc_id, item_id`` of documents and items that share ``run`` characters once normalised."""
    stride = run - gram + 1
    if not 1 <= gram <= stride or doc_id == item_id:
        raise ValueError("a gram has at most half the run's characters, and doc_id and item_id differ")
    whole = items.select(F.col(item_id).alias("__item"), normalise(F.col(item_text)).alias("__t")).where(F.length("__t") >= run)
    starts = lambda n: whole.select("__item", F.explode(F.transform(F.sequence(F.lit(1), F.length("__t") - n + 1), lambda at: F.col("__t").substr(at, F.lit(n)))).alias("__g"))
    grams = broadcast_within(starts(gram).select(F.xxhash64("__g").alias("__h")).distinct(), max_grams)
    shared = broadcast_within(starts(run).distinct(), max_grams)
    tiles = docs.select(F.col(doc_id).alias("__doc"), F.regexp_extract_all(normalise(F.col(text)), F.lit(f"(?s).{{1,{stride}}}"), F.lit(0)).alias("__tiles"))
    tiles = tiles.where(F.size("__tiles") > 1)
    around = F.transform("__tiles", lambda tile, i: F.struct(
        F.when(i > 0, F.get("__tiles", i - 1)).otherwise("").alias("before"), tile.alias("tile"),
        F.coalesce(F.get("__tiles", i + 1), F.lit("")).alias("after"),
    ))
    # outer, or a filter on the list would be moved below and have the list made twice
    windows = tiles.select("__doc", F.explode_outer(F.filter(around, lambda w: F.length(w["tile"]) >= gram)).alias("w")).where("w is not null")
    windows = windows.withColumn("__h", F.xxhash64(F.substring(F.col("w.tile"), 1, gram)))
    hits = windows.join(grams, "__h", "left_semi")
    # the run begins k characters before the gram
    context, offset = F.concat("w.before", "w.tile", "w.after"), F.length("w.before")
    runs = F.transform(F.sequence(F.lit(0), F.least(F.lit(run - gram), offset)), lambda k: context.substr(offset - k + 1, F.lit(run)))
    found = hits.select("__doc", F.explode(runs).alias("__g")).where(F.length("__g") == run).join(shared, "__g")
    return found.select(F.col("__doc").alias(doc_id), F.col("__item").alias(item_id)).distinct()


def drop_leaking(docs: DataFrame, doc_id: str, leaks: DataFrame) -> DataFrame:
    """The documents in no pair of ``leaks``. Documents with a NULL id are kept: they have no name to report."""
    return docs.join(leaks.select(doc_id).distinct(), doc_id, "left_anti").select(*docs.columns)


def remove_spans(docs: DataFrame, doc_id: str, text: str, leaks: DataFrame, items: DataFrame, item_id: str, item_text: str, run: int = RUN) -> DataFrame:
    """``doc_id, cleaned, removed``: the leaking documents without the passages they share with their items.

    Only documents named in ``leaks`` and the texts of their own items are brought together.
    """
    named = leaks.join(items.select(item_id, F.col(item_text).alias("__t")), item_id).groupBy(doc_id).agg(F.collect_set("__t").alias("__ts"))
    hit = docs.select(doc_id, F.col(text).alias("__d")).join(named, doc_id).select(F.col(doc_id).cast("long").alias("id"), "__d", "__ts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, lists = (c.to_pylist() for c in batch.columns)
            done = [remove_shared(d, ts, run) for d, ts in zip(texts, lists)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["id", "cleaned", "removed"])

    return hit.mapInArrow(cut, "id long, cleaned string, removed long").withColumnRenamed("id", doc_id)


#: Whether a character counts, of those met so far.
_known: dict[str, bool] = {}


def _counts(c: str) -> bool:
    if c not in _known:
        kind = unicodedata.category(c)
        _known[c] = kind[0] == "L" or kind == "Nd"
    return _known[c]


def letters_of(text: str) -> tuple[str, list[int]]:
    """Normalised text, and for each of its characters the place in ``text`` that it comes from."""
    lower = text.lower()
    if len(lower) == len(text):
        kept = [i for i, c in enumerate(lower) if _counts(c)]
        return "".join([lower[i] for i in kept]), kept
    origin = [i for i, c in enumerate(text) for _ in c.lower()]
    kept = [k for k, c in enumerate(lower) if _counts(c)]
    return "".join([lower[k] for k in kept]), [origin[k] for k in kept]


def remove_shared(text: str, items: list[str], run: int) -> tuple[str, int]:
    """``text`` without every stretch of which ``run`` or more normalised characters occur in an item."""
    flat, places = letters_of(text)
    grams: set[str] = set()
    for item in items:
        other = letters_of(item)[0]
        grams.update(other[i : i + run] for i in range(len(other) - run + 1))
    out, at, removed, reach = [], 0, 0, -1
    begin = None
    for i in range(len(flat) - run + 1):
        if flat[i : i + run] in grams:
            if begin is not None and i > reach:
                out.append(text[at : places[begin]])
                at, removed, begin = places[reach - 1] + 1, removed + places[reach - 1] + 1 - places[begin], None
            begin, reach = i if begin is None else begin, i + run
    if begin is not None:
        out.append(text[at : places[begin]])
        at, removed = places[reach - 1] + 1, removed + places[reach - 1] + 1 - places[begin]
    return "".join([*out, text[at:]]), removed
