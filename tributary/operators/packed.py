"""Several values packed in one field, split into one row per value with its position.

The delimiters of each source are inferred first: every character that separates under the declared grammar (it
stands outside quoted items and is no item character) is a candidate, scored over the source's cells by piece-count
consistency (the share of its cells in which splitting by it alone leaves no other candidate, times how even the
numbers of pieces are) and by piece type regularity (the share of pieces that are numbers, codes, words or
quoted). Candidates that reach ``min_score`` make the source's delimiter set.

What decides: cells are split at the characters of their source's set and nowhere else. A candidate that was not
chosen is text, and a source without a set has cells of one item. With ``min_score`` 0 every candidate seen in a source
is in its set, which is what a definition by which any foreign character separates asks for.

Defined results
* NULL and blank cells, and cells that hold nothing but brackets, give no row; empty items count in the
  positions but give no row.
* A source that is NULL is a source of its own. Repeated rows: see ``split_packed``.
* A quote that is never closed, or stands inside an item, is a candidate like any other character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.runtime import broadcast_within, materialise

MIN_SCORE = 0.25
#: Sources whose delimiters may be broadcast.
MAX_SOURCES = 200_000

#: Fixed grammar: item characters outside quotes, a quoted item, and the brackets that may wrap a cell.
ITEM = r"\p{L}\p{M}\p{N}_\-. "
QUOTED = r'"[^"\\]*+(?:(?:""|\\"|\\)[^"\\]*+)*+"' + r"|'[^'\\]*+(?:(?:''|\\'|\\)[^'\\]*+)*+'"
BRACKETS = ("[]", "{}", "()")


def unwrap(cell: Column) -> Column:
    """Drop blanks around the cell, then one pair of brackets."""
    bare = F.trim(cell)
    wrapped = F.lit(False)
    for pair in BRACKETS:
        wrapped = wrapped | (bare.startswith(pair[0]) & bare.endswith(pair[1]))
    return F.when(wrapped & (F.length(bare) >= 2), bare.substr(F.lit(2), F.length(bare) - 2)).otherwise(bare)


#: Ends every cell, so that each item is followed by exactly one separator.
_END = "\x01"

#: The declared grammar: any character outside quoted items that is no item character separates.
_DECLARED = rf"(?s)\G *(?:(?:{QUOTED})|[{ITEM}]*+) *+([^{ITEM}])"


#: A regular piece between marks: nothing, a quoted item, a number, words, or a word with a number.
_PIECE = r"(?:\A|(?<=\x02)) *(?:q|9|w-9|w(?: +(?:w|9))*|) *(?=\x02|\z)"


def infer_delimiters(df: DataFrame, source: str, cell: str, min_score: float = MIN_SCORE) -> DataFrame:
    """``source, delimiter, cells, consistency, regularity, score, chosen`` of every candidate.

    One pass with map-side aggregation and one shuffle of a row per source and character.
    """
    inner = F.col("__c")
    bare = F.regexp_replace(inner, "(?s)" + QUOTED, "q")
    kinds = F.regexp_replace(F.regexp_replace(bare, r"[\p{N}][\p{N}_.]*", "9"), r"[\p{L}\p{M}]+", "w")
    # without a quote every character that is no item character separates
    plain = F.regexp_extract_all(F.regexp_replace(inner, f"[{ITEM}]+", ""), F.lit("(?s)."), F.lit(0))
    strict = F.regexp_extract_all(F.concat(inner, F.lit(_END)), F.lit(_DECLARED), F.lit(1))
    marks = F.array_distinct(F.when(inner.contains('"') | inner.contains("'"), F.slice(strict, 1, F.size(strict) - 1)).otherwise(plain))
    cells = df.select(F.col(source).alias("__s"), unwrap(F.col(cell)).alias("__c")).where(inner.rlike(f"[^{ITEM}]"))
    cells = cells.select("__s", marks.alias("__m"), kinds.alias("__k"))
    # outer, or a filter on the list would be moved below and have all patterns matched twice
    per = cells.select("__s", "__k", F.explode_outer("__m").alias("__d"), F.size("__m").alias("__n")).where("__d is not null")
    # the candidate becomes one fixed mark, so that the pattern of a regular piece is the same for all
    marked = per.select("__s", "__d", "__n", F.expr("translate(__k, __d, '\u0002')").alias("__x"))
    size = (F.length("__x") - F.length(F.regexp_replace("__x", "\x02", "")) + 1).cast("double")
    regular = F.regexp_count("__x", F.lit(_PIECE))
    per = marked.select("__s", "__d", "__n", size.alias("__p"), regular.alias("__g"))
    per = per.select("__s", "__d", (F.col("__n") <= 1).cast("double").alias("__sole"), (F.col("__g") / F.col("__p")).alias("__r"), "__p")
    scored = per.groupBy("__s", "__d").agg(
        F.count("*").alias("cells"), (F.avg("__sole") * F.sqrt(F.avg("__p") * F.avg("__p") / F.avg(F.col("__p") * F.col("__p")))).alias("consistency"), F.avg("__r").alias("regularity")
    )
    score = F.col("consistency") * F.col("regularity")
    return scored.select(
        F.col("__s").alias(source), F.col("__d").alias("delimiter"), "cells", "consistency", "regularity",
        score.alias("score"), (score >= min_score).alias("chosen"),
    )


#: Sets of delimiters, different ones, whose patterns are compiled once; with more of them each row brings its own.
LITERAL_SETS = 32


def items_of(cell: Column, delimiters: Column, sets: list[str] | None = None) -> Column:
    """The items of an unwrapped cell in order, empty ones included; ``delimiters`` is a text of the characters that separate.

    ``sets`` may name all texts that ``delimiters`` has.
    """
    ended = F.concat(cell, F.lit(_END))

    def split_at(marks: Column) -> Column:
        inside = F.concat(F.regexp_replace(marks, r"([^\p{L}\p{N}\s])", r"\\$1"), F.lit(_END))
        return F.regexp_extract_all(ended, F.concat(F.lit(rf"(?s)\G *((?:{QUOTED})(?= *+["), inside, F.lit("])|[^"), inside, F.lit("]*+) *+["), inside, F.lit("]")), F.lit(1))

    known = F.coalesce(delimiters, F.lit(""))
    if sets is None:
        return split_at(known)
    out = split_at(F.lit(""))
    for marks in sets:
        out = F.when(known == marks, split_at(F.lit(marks))).otherwise(out)
    return out


def unquote(item: Column) -> Column:
    """Drop blanks around an item and the quotes it is wrapped in; undo doubled and backslashed quotes."""
    bare = F.trim(item)
    out = bare
    for q in "\"'":
        inner = bare.substr(F.lit(2), F.length(bare) - 2)
        plain = F.regexp_replace(inner, f"(?s){q}{q}|\\\\({q})", q)
        out = F.when(bare.startswith(q) & bare.endswith(q) & (F.length(bare) >= 2), plain).otherwise(out)
    return out


def split_packed(df: DataFrame, keys: list[str], source: str, cell: str, delimiters: DataFrame | None = None, min_score: float = MIN_SCORE) -> DataFrame:
    """``keys, pos, item_text``: one row per non-empty item of ``cell``, positions 0-based over all items.

    Rows that agree in ``keys`` count once; if their cells differ, the least cell is taken. ``delimiters`` is
    a table as of ``infer_delimiters``, inferred from ``df`` with ``min_score`` by default. It is grouped to one row per source,
    counted, and broadcast up to ``MAX_SOURCES``; beyond that the join shuffles.
    """
    if {k.lower() for k in keys} & {"pos", "item_text"}:
        raise ValueError("pos and item_text are names of the result; rename the key")
    found = infer_delimiters(df, source, cell, min_score) if delimiters is None else delimiters
    marks = F.array_join(F.array_sort(F.collect_set(F.when(F.col("chosen"), F.col("delimiter")))), "")
    sets = materialise(found.groupBy(F.col(source).alias("__s")).agg(marks.alias("__d")), "delimiters")
    different = [r[0] for r in sets.select("__d").where("__d <> ''").distinct().limit(LITERAL_SETS + 1).collect()]
    sets = broadcast_within(sets, MAX_SOURCES)
    once = df.groupBy(*keys).agg(F.min(F.struct(F.col(cell).alias("__c"), F.col(source).alias("__s"))).alias("__x"))
    rows = once.select(*keys, F.col("__x.__s").alias("__src"), unwrap(F.col("__x.__c")).alias("__cell")).where("__cell <> ''")
    joined = rows.join(sets, F.col("__src").eqNullSafe(F.col("__s")), "left")
    exploded = joined.select(*keys, F.posexplode_outer(items_of(F.col("__cell"), F.col("__d"), different if len(different) <= LITERAL_SETS else None)).alias("pos", "__item"))
    return exploded.select(*keys, "pos", unquote(F.col("__item")).alias("item_text")).where("item_text <> ''")
