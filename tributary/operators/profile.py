"""Column-level data quality profile of loads.

For each column with a declared form regular expressions are induced by minimum description length over all its
distinct values. Values generalise along a fixed ladder: the words themselves (level 0), runs of one character
class (level 1), runs of letters and digits alike (level 2), words joined by ``. _ + -`` (level 3), anything
(level 4). The description length of an expression is its own length plus, for every distinct value it
describes, the bits to name the expression and to spell the value out under it; values that conform to the
declared form and values that do not under one expression cost the spelling of the fewer ones as exceptions. From
the bottom up each node keeps the cheapest of itself, the best of what lies below, and the residual ``.*`` of values
too rare for an expression of their own. All sums are distributed aggregations and the expression of every shape
stays a table; only dominant expressions, with a ``DOMINANT`` share of a column's distinct values and therefore
bounded in number, reach the driver.

What decides: a row's finding is its value's expression's. Expressions all of whose distinct values conform pass,
expressions none of whose values conform are findings; rows of mixed, rare and residual expressions are candidates,
which an exact check with the declared form follows. Without induced expressions there are no findings. Where no
form is declared or trusted, ``departures`` judges by the expressions alone: a row departs if its expression held
less than a given share of the load before.

Defined results
* NULL is no violation. Empty tables give empty results; a load is compared with the preceding load present.
* Shares are compared by integer products, so no rounding decides a finding.
* Two values are the same in a distribution if their numbers are equal. A NULL load is a load, the first.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DateType, NumericType, StringType, TimestampNTZType, TimestampType

from tributary.runtime import broadcast_within, materialise

#: Share of a column's distinct values from which an expression is dominant; no column has more than its inverse.
DOMINANT = 1 / 200
#: Words of one shape that may be spelled out.
WORDS = 64
#: Bits for one character of an expression, for naming the residual, and for a character of a value by what is known of it.
MODEL_BITS, ESCAPE = 7.0, 10.0
LETTER, DIGIT, ALNUM, JOINED, ANY, RUN = math.log2(26), math.log2(10), math.log2(62), math.log2(66), 8.0, 4.0
#: Ranges per power of two into which the numbers of a distribution are cut, so that no task sums up a whole load.
RANGES = 1024
#: Loads whose names may be broadcast, and ranges in doubt.
MAX_LOADS = 200_000
#: Counts whose products are compared.
WIDE = "decimal(18,0)"

#: Texts that are numbers, in columns with declared numbers but no form.
NUMBER = r"\A[+-]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\z"

#: The residual.
REST = r"(?s).*"
#: Fixed meaning of the marks in a shape.
MARKS = {"a": "[a-z]+", "A": "[A-Z]+", "9": "[0-9]+", "L": r"\p{L}+", "w": r"[\p{L}0-9]+", "x": r"[\p{L}0-9]+(?:[._+\-]+[\p{L}0-9]+)+"}


@dataclass(frozen=True)
class ColumnRule:
    """What is declared of a column; ``form`` is a regular expression for the whole value.

    Repeated groups in a form should be possessive (``(...)++``), or very long values exhaust the matcher's stack.
    """

    name: str
    form: str | None = None
    lowest: float | None = None
    highest: float | None = None
    order: tuple[str, ...] = ()
    distribution: bool = False

    def whole(self) -> str:
        return rf"\A(?:{self.form})\z"


@dataclass(frozen=True)
class Expression:
    """An induced expression; ``words`` are those of an enumeration (level 0), whose other values have the same shape."""

    column: str
    level: int
    shape: str
    values: int
    conforming: int
    words: tuple[str, ...] = ()

    @property
    def verdict(self) -> str:
        return "inside" if self.conforming == self.values else "outside" if not self.conforming else "mixed"

    @property
    def regex(self) -> str:
        if self.level == 0:
            return "|".join(re.escape(w) for w in self.words)
        return regex_of(self.level, self.shape)


def regex_of(level: int, shape: str) -> str:
    if level == 4:
        return REST
    return "".join(MARKS[c] if c in MARKS else c if c.isspace() else "\\" + c for c in shape)


def next_shape(below: Column, level: int) -> Column:
    """A value's shape at level 1, 2 or 3 from its shape one level below (level 4 is the same for all)."""
    if level == 1:
        one = F.regexp_replace(F.regexp_replace(F.regexp_replace(below, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "9")
        return F.when(F.length(below) == F.octet_length(below), one).otherwise(F.regexp_replace(one, r"[\p{L}\p{M}&&[^a-zA-Z]]+", "L"))
    return F.regexp_replace(below, "[aA9L]+", "w") if level == 2 else F.regexp_replace(below, r"w(?:[._+\-]++w)++", "x")


def _regex(level: Column, shape: Column) -> Column:
    """``regex_of`` as a column; words that are spelled out go by their shape."""
    marks = F.create_map(*[F.lit(x) for pair in MARKS.items() for x in pair])
    one = lambda c: F.coalesce(F.try_element_at(marks, c), F.when(c.rlike(r"\s"), c).otherwise(F.concat(F.lit("\\"), c)))
    return F.when(level == 4, REST).otherwise(F.array_join(F.transform(F.regexp_extract_all(shape, F.lit("(?s)."), F.lit(0)), one), ""))


def _spelled(rule_of: list[ColumnRule], value: Column) -> Column:
    """Whether a value conforms to the declared form of its row's ``column_name``."""
    conforms = F.lit(None).cast("boolean")
    for r in rule_of:
        conforms = F.when(F.col("column_name") == r.name, value.rlike(r.whole())).otherwise(conforms)
    return conforms


def _leaves(values: DataFrame, rules: list[ColumnRule]) -> DataFrame:
    """A row per column and level 1 shape with the sums that all description lengths follow from."""
    v = F.col("value")
    digits = F.length(v) - F.length(F.translate(v, "0123456789", ""))
    first = values.where(v.isNotNull()).select("column_name", next_shape(v, 1).alias("s1"), _spelled(rules, v).cast("long").alias("ok"), F.length(v).alias("l"), digits.alias("d"))
    first = first.groupBy("column_name", "s1").agg(F.count("*").alias("n"), F.sum("ok").alias("ok"), F.sum("l").alias("l"), F.sum("d").alias("d"))
    shaped = first.select("*", next_shape(F.col("s1"), 2).alias("s2"))
    shaped = shaped.select("*", next_shape(F.col("s2"), 3).alias("s3"))
    # all but digits and letters is in the shapes, so what is left follows from the sums
    kept = lambda s, marks: F.col("n") * F.length(F.regexp_replace(F.col(s), f"[{marks}]", ""))
    runs = lambda s, marks: F.col("n") * F.length(F.regexp_replace(F.col(s), f"[^{marks}]", "")) * RUN
    b1 = F.col("d") * DIGIT + (F.col("l") - F.col("d") - kept("s1", "aA9L")) * LETTER + runs("s1", "aA9L")
    b2 = (F.col("l") - kept("s2", "w")) * ALNUM + runs("s2", "w")
    b3 = (F.col("l") - kept("s3", "wx")) * JOINED + runs("s3", "wx")
    return shaped.select("column_name", "s3", "s2", "s1", "n", "ok", "l", b1.alias("b1"), b2.alias("b2"), b3.alias("b3"))


def _choose(node: DataFrame, level: int) -> DataFrame:
    """``best`` and ``take`` of nodes: ``own`` expression, ``words``, the ``rest``, or what lies ``below``."""
    n, total = F.col("n"), F.col("total")
    fewer = F.least("ok", n - F.col("ok"))
    mixed = fewer * (F.col("l") / n + 1) * MODEL_BITS
    any_ = F.col("l") * ANY + n * 2 * RUN + mixed
    costs = {"below": F.col("best")} if level > 1 else {}  # the more precise one of equals
    if level == 4:
        costs |= {"own": 2 * MODEL_BITS + any_}
    else:
        named = n * (F.log2(total) - F.log2(n))
        costs |= {"own": (F.length(f"s{level}") + 1) * MODEL_BITS + F.col(f"b{level}") + named + mixed, "rest": any_ + n * ESCAPE}
        if level == 1:
            listed = (fewer > 0) & (n <= WORDS) & (n >= total * DOMINANT)
            costs["words"] = F.when(listed, (F.col("l") + n) * MODEL_BITS + named).otherwise(float("inf"))
    least = F.least(*costs.values())
    take = F.lit("below")
    for name, cost in reversed(costs.items()):
        take = F.when(cost == F.col("least"), name).otherwise(take)
    return node.withColumn("least", least).withColumn("take", take).withColumn("best", F.col("least")).drop("least")


def induce(values: DataFrame, rules: list[ColumnRule]) -> DataFrame:
    """``column_name, s1, level, shape, n, ok, total``: the expression of every level 1 shape of the distinct ``column_name, value``.

    Shapes whose words are spelled out have level 0. ``n`` distinct values have the shape, of which ``ok`` conform.
    """
    leaves = materialise(_leaves(values, rules), "shapes")
    totals = F.broadcast(leaves.groupBy("column_name").agg(F.sum("n").alias("total")))  # a row per column
    nodes = {1: _choose(leaves.join(totals, "column_name"), 1)}
    for level in (2, 3, 4):
        keys = [f"s{i}" for i in range(level, 4)]
        sums = [F.sum(c).alias(c) for c in ("n", "ok", "l", "b2", "b3", "best")]
        nodes[level] = _choose(nodes[level - 1].groupBy("column_name", "total", *keys).agg(*sums), level)
    found = nodes[1].select("column_name", "total", "s3", "s2", "s1", "n", "ok", F.col("take").alias("t1"))
    for level in (2, 3):
        found = found.join(nodes[level].select("column_name", f"s{level}", F.col("take").alias(f"t{level}")), ["column_name", f"s{level}"])
    found = found.join(F.broadcast(nodes[4].select("column_name", F.col("take").alias("t4"))), "column_name")
    level, shape = F.when(F.col("t1") == "own", 1).when(F.col("t1") == "words", 0).otherwise(4), F.when(F.col("t1") != "rest", F.col("s1")).otherwise("?")
    for i in (2, 3):
        here = F.col(f"t{i}")
        level = F.when(here == "own", i).when(here == "rest", 4).otherwise(level)
        shape = F.when(here == "own", F.col(f"s{i}")).when(here == "rest", "?").otherwise(shape)
    level, shape = F.when(F.col("t4") == "own", 4).otherwise(level), F.when(F.col("t4") == "own", "?").otherwise(shape)
    return materialise(found.select("column_name", "s1", level.cast("int").alias("level"), shape.alias("shape"), "n", "ok", "total"), "expressions")


def expressions(induced: DataFrame) -> DataFrame:
    """``column_name, level, shape, n, ok, total``: the expressions themselves; level 0 stands for the words of a shape."""
    return induced.groupBy("column_name", "level", "shape", "total").agg(F.sum("n").alias("n"), F.sum("ok").alias("ok"))


def dominant(induced: DataFrame, source: DataFrame, rules: list[ColumnRule]) -> list[Expression]:
    """The dominant expressions, and all others of a column as one of level 4; words come in one enumeration per shape and verdict.

    A column has at most ``1 / DOMINANT`` dominant ones, so they may be collected; the words of a shape are at most
    ``WORDS``, and are looked up among the rows of the columns that have any.
    """
    large = (F.col("n") >= F.col("total") * DOMINANT) & (F.col("level") < 4)
    level, shape = F.when(large, F.col("level")).otherwise(4), F.when(large, F.col("shape")).otherwise("?")
    known = expressions(induced).groupBy("column_name", level.alias("level"), shape.alias("shape")).agg(F.sum("n").alias("n"), F.sum("ok").alias("ok")).collect()
    out = [Expression(r["column_name"], r["level"], r["shape"], r["n"], r["ok"]) for r in known if r["level"]]
    listed: dict = {}
    for r in known:
        if not r["level"]:
            listed.setdefault(r["column_name"], []).append(r["shape"])
    if listed:
        asked = [r for r in rules if r.name in listed]
        wanted = reduce(lambda a, b: a | b, [(F.col("column_name") == c) & next_shape(F.col("value"), 1).isin(s) for c, s in listed.items()])
        words = distinct_values(source, asked).where(wanted).select("*", next_shape(F.col("value"), 1).alias("s1"), _spelled(asked, F.col("value")).alias("ok")).collect()
        groups: dict = {}
        for w in words:
            groups.setdefault((w["column_name"], w["s1"], w["ok"]), []).append(w["value"])
        out += [Expression(c, 0, s, len(ws), len(ws) * ok, tuple(sorted(ws))) for (c, s, ok), ws in groups.items()]
    return sorted(out, key=lambda e: (e.column, -e.values, e.level, e.shape, e.words))


def _matches(value: Column, shapes: list[Column], members: list[Expression]) -> Column:
    """Whether a value belongs to one of ``members``. A shape follows from the one below it, so one look a level is exact."""
    hit = F.lit(False)
    words = [w for e in members for w in e.words]
    if words:
        hit = hit | value.isin(words)
    for level in (1, 2, 3):
        names = [e.shape for e in members if e.level == level]
        if names:
            hit = hit | shapes[level - 1].isin(names)
    return hit


def nonconforming(value: Column, shapes: list[Column], rule: ColumnRule, model: list[Expression]) -> Column:
    """Whether a value (not NULL) is a finding: by the verdict of its expression if that is dominant and pure, else by the
    exact check. ``shapes``: the value's shapes at levels 1 to 3, computed by an earlier projection."""
    mine = [e for e in model if e.column == rule.name]
    if not mine:  # no value, no expression
        return F.lit(False)
    inside = _matches(value, shapes, [e for e in mine if e.verdict == "inside"])
    outside = _matches(value, shapes, [e for e in mine if e.verdict == "outside"])
    return F.when(inside, F.lit(False)).when(outside, F.lit(True)).otherwise(~value.rlike(rule.whole()))


def distinct_values(df: DataFrame, rules: list[ColumnRule]) -> DataFrame:
    """Distinct ``column_name, value`` of the columns that have a form."""
    pairs = [F.struct(F.lit(r.name).alias("column_name"), F.col(f"`{r.name}`").cast("string").alias("value")) for r in rules if r.form]
    return df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").where(F.col("value").isNotNull()).distinct()


def _range_of(v: Column) -> Column:
    """Number of the range that ``v`` lies in, in the order of the numbers and fine at every magnitude."""
    size = F.least(F.abs(v), F.lit(1e308))
    power = F.floor(F.log2(size))
    place = (power + 1100) * RANGES + F.floor(size / F.pow(F.lit(2.0), power) * RANGES) - RANGES
    return F.when(size < 1e-300, F.lit(0)).otherwise(F.signum(v) * place).cast("long")


class Profile:
    """Findings over the loads of ``df``; ``key`` numbers its rows, ``load`` orders its loads."""

    def __init__(self, df: DataFrame, load: str, key: str, rules: list[ColumnRule], null_share=(1, 5), distribution_share=(1, 4)):
        self.df = df.select(F.col(load).alias("load"), F.col(key).alias("key"), *[F.col(f"`{r.name}`").alias(f"c_{r.name}") for r in rules])
        self.rules, self.null_share, self.distribution_share = rules, null_share, distribution_share

    @property
    def _formed(self) -> list[ColumnRule]:
        return [r for r in self.rules if r.form]

    @cached_property
    def _source(self) -> DataFrame:
        return self.df.select(*[F.col(f"c_{r.name}").alias(r.name) for r in self._formed])

    @cached_property
    def induced(self) -> DataFrame:
        """The expression of every shape, induced when first needed."""
        return induce(distinct_values(self._source, self._formed), self._formed)

    @cached_property
    def model(self) -> list[Expression]:
        """The dominant expressions and the residuals."""
        return dominant(self.induced, self._source, self._formed) if self._formed else []

    def _levels(self, r: ColumnRule) -> int:
        """The highest level of the ladder that the column's dominant expressions need."""
        return max((e.level for e in self.model if e.column == r.name and e.level < 4), default=0)

    def _bad_form(self, r: ColumnRule, value: Column) -> Column:
        shapes = [F.col(f"s{i}_{r.name}") for i in (1, 2, 3)]
        return F.coalesce(nonconforming(value, shapes, r, self.model), F.lit(False)) if r.form else F.lit(False)

    def _shaped(self, rows: DataFrame, rules: list[ColumnRule]) -> DataFrame:
        """``rows`` with the shapes of the values in columns ``c_<name>``, up to the levels that the model uses, a projection per level."""
        for level in (1, 2, 3):
            more = []
            for r in (r for r in rules if r.form and level <= self._levels(r)):
                below = F.col(f"c_{r.name}").cast("string") if level == 1 else F.col(f"s{level - 1}_{r.name}")
                more.append(next_shape(below, level).alias(f"s{level}_{r.name}"))
            rows = rows.select("*", *more) if more else rows
        return rows

    def _number(self, r: ColumnRule, value: Column) -> Column:
        if r.order:
            return F.array_position(F.array(*[F.lit(x) for x in r.order]), value).try_cast("double")
        return value.try_cast("double")

    def _finding(self, r: ColumnRule, value: Column) -> Column:
        beyond = F.lit(False)
        if r.lowest is not None or r.highest is not None:
            n = self._number(r, value)
            low = F.lit(False) if r.lowest is None else n < r.lowest
            high = F.lit(False) if r.highest is None else n > r.highest
            beyond = F.coalesce(low | high, F.lit(False))
        return F.when(self._bad_form(r, value.cast("string")), F.lit("pattern")).when(beyond, F.lit("range"))

    def row_findings(self) -> DataFrame:
        """``load, column_name, finding, key`` of rows with malformed values and values out of range; one pass, no shuffle."""
        parts = [F.struct(F.lit(r.name).alias("column_name"), self._finding(r, F.col(f"c_{r.name}")).alias("finding")) for r in self.rules]
        found = self._shaped(self.df, self.rules).select("load", "key", F.explode(F.array(*parts)).alias("j"))  # stays in generated code
        return found.select("load", "j.column_name", "j.finding", "key").where("finding is not null")

    def aggregates(self) -> DataFrame:
        """``load, column_name, n_rows, n_null, n_distinct, lowest, highest, first_text, last_text`` of every column.

        ``lowest`` and ``highest`` are the texts of the extremes in the order of the column's type; NaN is none of
        them. In text columns with declared numbers they are the extremes of the values that are numbers, NULL if
        none is. ``first_text`` and ``last_text`` are the extremes of the values as texts.
        """
        v = F.col("value")
        pairs = [F.struct(F.lit(r.name).alias("column_name"), F.col(f"c_{r.name}").cast("string").alias("value")) for r in self.rules]
        long = self.df.select("load", F.explode(F.array(*pairs)).alias("p")).select("load", "p.*")
        counts = long.groupBy("load", "column_name", "value").agg(F.count("*").alias("n"))
        extremes = {name: [F.when(F.col("column_name") == r.name, pick(F.when(at.isNotNull(), F.struct(at.alias("at"), v.alias("value"))))["value"])
                           for r in self.rules if (at := self._place(r, v)) is not None] for name, pick in (("lowest", F.min), ("highest", F.max))}
        typed = F.col("column_name").isin([r.name for r in self.rules if self._place(r, v) is not None])
        return counts.groupBy("load", "column_name").agg(
            F.sum("n").alias("n_rows"), F.sum(F.when(v.isNull(), F.col("n")).otherwise(0)).alias("n_null"), F.count("value").alias("n_distinct"),
            F.when(typed, F.coalesce(*extremes["lowest"], F.lit(None))).otherwise(F.min("value")).alias("lowest"),
            F.when(typed, F.coalesce(*extremes["highest"], F.lit(None))).otherwise(F.max("value")).alias("highest"),
            F.min("value").alias("first_text"), F.max("value").alias("last_text"),
        )

    def _place(self, r: ColumnRule, text: Column) -> Column | None:
        """Where the value with this text stands among its column's values; None if texts are compared."""
        kind = self.df.schema[f"c_{r.name}"].dataType
        if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
            place = text.try_cast(kind)
        elif isinstance(kind, NumericType):
            place = text.try_cast(kind)
            place = F.when(~F.isnan(place), place) if kind.typeName() in ("double", "float") else place
        elif isinstance(kind, StringType) and not r.order and (r.distribution or r.lowest is not None or r.highest is not None):
            place = F.when(text.rlike(r.whole() if r.form else NUMBER), text.try_cast("double"))
            place = F.when(~F.isnan(place), place)
        else:
            return None
        return F.when(F.col("column_name") == r.name, place)

    def _loads(self) -> list:
        """The names of the loads, at most ``MAX_LOADS``."""
        found = [r[0] for r in self.df.select("load").distinct().limit(MAX_LOADS + 1).collect()]
        if len(found) > MAX_LOADS:
            raise ValueError(f"more than {MAX_LOADS} loads; profile them in parts")
        return found

    def expressions(self) -> DataFrame:
        """``column_name, level, expression, n_values, verdict``: all induced expressions; level 0 stands for the words of a shape."""
        found = expressions(self.induced)
        verdict = F.when(F.col("ok") == F.col("n"), "inside").when(F.col("ok") == 0, "outside").otherwise("mixed")
        return found.select("column_name", "level", _regex(F.col("level"), F.col("shape")).alias("expression"), F.col("n").alias("n_values"), verdict.alias("verdict"))

    def coverage(self) -> DataFrame:
        """Rows of each load by induced expression: ``load, column_name, expression, n_rows, share, change``.

        Every load has a row for every expression of a column, with 0 rows where no value has that form, and
        ``change`` is against the preceding load (NULL in the first). A load without values has shares of 0.
        Spelled-out words of a shape count as one expression. Rows are counted by shape first, so the expressions
        meet counts only.
        """
        if not self._formed:
            return self.df.select("load", F.lit("").alias("column_name"), F.lit("").alias("expression"), F.lit(0).cast("long").alias("n_rows"), F.lit(0.0).alias("share"), F.lit(0.0).alias("change")).limit(0)
        parts = [F.struct(F.lit(r.name).alias("column_name"), F.col(f"c_{r.name}").cast("string").alias("value")) for r in self._formed]
        long = self.df.select("load", F.explode(F.array(*parts)).alias("p")).where(F.col("p.value").isNotNull()).select("load", "p.column_name", next_shape(F.col("p.value"), 1).alias("s1"))
        counted = long.groupBy("load", "column_name", "s1").agg(F.count("*").alias("n_rows"))
        named = self.induced.withColumn("expression", _regex(F.col("level"), F.col("shape")))
        counts = counted.join(named.select("column_name", "s1", "expression"), ["column_name", "s1"]).groupBy("load", "column_name", "expression").agg(F.sum("n_rows").alias("n_rows"))
        loads = F.array(*[F.lit(x) for x in self._loads()]).cast(ArrayType(self.df.schema["load"].dataType))
        none = named.select("column_name", "expression").distinct().select(F.explode(loads).alias("load"), "column_name", "expression", F.lit(0).cast("long").alias("n_rows"))
        counts = counts.select("load", "column_name", "expression", "n_rows").unionByName(none).groupBy("load", "column_name", "expression").agg(F.sum("n_rows").alias("n_rows"))
        total = F.sum("n_rows").over(Window.partitionBy("load", "column_name"))
        shares = counts.withColumn("share", F.when(total > 0, F.col("n_rows") / total).otherwise(F.lit(0.0)))
        before = F.lag("share").over(Window.partitionBy("column_name", "expression").orderBy("load"))
        return shares.withColumn("change", F.col("share") - before)

    def coverage_findings(self, least: float = 0.001) -> DataFrame:
        """``load, column_name, finding, expression, share, change`` of expressions whose share moved by ``least`` or more.

        ``finding`` is appeared, vanished, risen or fallen.
        """
        kind = F.when(F.col("share") == F.col("change"), "appeared").when(F.col("share") == 0, "vanished").when(F.col("change") > 0, "risen").otherwise("fallen")
        return self.coverage().where(F.abs("change") >= least).select("load", "column_name", kind.alias("finding"), "expression", "share", "change")

    def departures(self, least: float = 0.01) -> DataFrame:
        """``load, column_name, expression, key`` of rows that the expressions of the preceding load do not describe.

        An expression describes a load's values if it is dominant and held a share of ``least`` or more of the preceding load's
        values; declared forms take no part. ``expression`` is the row's own, NULL if it is not dominant. Loads without a
        preceding load, or whose preceding load has no values in the column, have none.
        """
        rows = self._shaped(self.df, self._formed)
        parts = []
        for r in self._formed:
            v, name = F.col(f"c_{r.name}").cast("string"), F.lit(None).cast("string")
            for e in (e for e in self.model if e.column == r.name and e.level < 4):
                name = F.when(_matches(v, [F.col(f"s{i}_{r.name}") for i in (1, 2, 3)], [e]), e.regex).otherwise(name)
            parts.append(F.struct(F.lit(r.name).alias("column_name"), v.isNotNull().alias("filled"), name.alias("expression")))
        if not parts:
            return self.df.select("load", F.lit("").alias("column_name"), F.lit("").alias("expression"), "key").limit(0)
        long = rows.select("load", "key", F.explode(F.array(*parts)).alias("p")).select("load", "key", "p.*").where("filled")
        counts = long.groupBy("load", "column_name", "expression").agg(F.count("*").alias("n"))
        total = F.sum("n").over(Window.partitionBy("load", "column_name"))
        order = Window.orderBy(F.col("load").asc_nulls_first())
        loads = self.df.select("load").distinct().select(F.col("load").alias("of"), F.lead("load").over(order).alias("next"), F.lead(F.lit(True)).over(order).alias("follows"))
        shares = counts.withColumn("share", F.col("n") / total).join(broadcast_within(loads, MAX_LOADS), F.col("load").eqNullSafe(F.col("of"))).where("follows")
        trusted = F.collect_list(F.when((F.col("share") >= least) & F.col("expression").isNotNull(), F.col("expression")))
        trusted = shares.groupBy(F.col("next").alias("at"), F.col("column_name").alias("of_column")).agg(trusted.alias("trusted"))  # at most 1 / least each
        met = long.join(broadcast_within(trusted, MAX_LOADS), F.col("load").eqNullSafe(F.col("at")) & (F.col("column_name") == F.col("of_column")))
        return met.where(~F.coalesce(F.array_contains("trusted", F.col("expression")), F.lit(False))).select("load", "column_name", "expression", "key")

    @cached_property
    def _cells(self) -> DataFrame:
        """``column_name, load, filled, value, n``: one pass for NULLs, loads and distributions, in which only the values
        of columns with a distribution are told apart."""
        cells = []
        for r in self.rules:
            v = F.col(f"c_{r.name}").cast("string")
            cells.append(F.struct(F.lit(r.name).alias("column_name"), v.isNotNull().alias("filled"), (v if r.distribution else F.lit(None).cast("string")).alias("value")))
        long = self.df.select("load", F.explode(F.array(*cells)).alias("c")).select("load", "c.*")
        return materialise(long.groupBy("column_name", "load", "filled", "value").agg(F.count("*").alias("n")), "cells")

    def load_findings(self) -> DataFrame:
        """``load, column_name, finding`` of loads that depart from the load before them."""
        up, down = self.null_share
        per = self._cells.groupBy("column_name", "load").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("filled"), 0).otherwise(F.col("n"))).alias("nulls"))
        w = Window.partitionBy("column_name").orderBy(F.col("load").asc_nulls_first())
        per = per.withColumn("n0", F.lag("n").over(w)).withColumn("nulls0", F.lag("nulls").over(w))
        wide = lambda c: F.col(c).cast(WIDE)
        apart = F.abs(wide("nulls") * wide("n0") - wide("nulls0") * wide("n")) * down > wide("n") * wide("n0") * up
        nulls = per.where(apart).select("load", "column_name", F.lit("null_rate").alias("finding"))
        return nulls.unionByName(self._distribution_findings())

    def _sound(self, spread: list[ColumnRule]) -> DataFrame:
        """``column_name, load, v, n``: counts of the numbers without finding."""
        cells = self._cells.where(F.col("value").isNotNull() & F.col("column_name").isin([r.name for r in spread]))
        own = [F.when(F.col("column_name") == r.name, F.col("value")).alias(f"c_{r.name}") for r in spread]
        rows = self._shaped(cells.select("column_name", "load", "n", *own), spread)
        sound = [F.when(self._finding(r, F.col(f"c_{r.name}")).isNull(), self._number(r, F.col(f"c_{r.name}"))) for r in spread]
        # exploded, or the filter would move below the shapes and have them computed over and over
        return rows.select("column_name", "load", F.explode(F.array(F.coalesce(*sound))).alias("v"), "n").where("v is not null and not isnan(v)")

    def _distribution_findings(self) -> DataFrame:
        """Largest distance between the cumulative shares of neighbouring loads, in two levels.

        Values are counted first, by range with map-side aggregation. The sums of all lower ranges bound the distance
        inside a range; most ranges are decided by that. Only in the others the values themselves are summed up, so
        neither a load nor a column is summed in one task.
        """
        spread = [r for r in self.rules if r.distribution]
        if not spread:
            return self.df.select("load", F.lit("").alias("column_name"), F.lit("").alias("finding")).limit(0)
        counts = self._sound(spread)
        loads = self._cells.select("load").distinct().withColumn("next", F.lead("load").over(Window.orderBy(F.col("load").asc_nulls_first())))
        loads = loads.withColumn("last", F.col("next").isNull())
        counts = counts.join(broadcast_within(loads, MAX_LOADS), counts["load"].eqNullSafe(loads["load"])).drop(loads["load"])
        here = F.struct(F.col("load").alias("pair"), F.col("n").alias("cur"), F.lit(0).cast("long").alias("old"))
        ahead = F.struct(F.col("next").alias("pair"), F.lit(0).cast("long").alias("cur"), F.col("n").alias("old"))
        sides = F.when(F.col("last"), F.array(here)).otherwise(F.array(here, ahead))
        moved = counts.select("column_name", "v", _range_of(F.col("v")).alias("bucket"), F.explode(sides).alias("s")).select("column_name", "v", "bucket", "s.*")
        keys = ["column_name", "pair", "bucket"]
        totals = moved.groupBy(*keys).agg(F.sum("cur").alias("bc"), F.sum("old").alias("bo"))
        outer = Window.partitionBy("column_name", "pair").orderBy("bucket")
        whole = Window.partitionBy("column_name", "pair")
        before = outer.rowsBetween(Window.unboundedPreceding, -1)
        frame = totals.select(
            *keys, *[F.coalesce(F.sum(x).over(before), F.lit(0)).cast(WIDE).alias(y) for x, y in (("bc", "pc"), ("bo", "po"))],
            *[F.sum(x).over(whole).cast(WIDE).alias(y) for x, y in (("bc", "n"), ("bo", "n0"))], F.col("bc").cast(WIDE).alias("bc"), F.col("bo").cast(WIDE).alias("bo"),
        ).where((F.col("n") > 0) & (F.col("n0") > 0))
        up, down = self.distribution_share
        lead = lambda cur, old: (cur * F.col("n0") - old * F.col("n")) * down
        most = F.col("n") * F.col("n0") * up
        end = F.abs(lead(F.col("pc") + F.col("bc"), F.col("po") + F.col("bo"))) > most
        inside = (lead(F.col("pc") + F.col("bc"), F.col("po")) > most) | (-lead(F.col("pc"), F.col("po") + F.col("bo")) > most)
        ranges = materialise(frame.select(*keys, "pc", "po", "n", "n0", end.alias("end"), inside.alias("inside")).where("end or inside"), "ranges")
        hits = ranges.where("end").select("pair", "column_name").distinct()
        on = lambda x, y, names: reduce(lambda p, q: p & q, [x[c].eqNullSafe(y[c]) for c in names])
        open_ = ranges.join(hits, on(ranges, hits, ["column_name", "pair"]), "left_anti")
        if open_.limit(1).count():
            open_ = broadcast_within(open_.select(*[F.col(c).alias(f"o_{c}") for c in keys], "pc", "po", "n", "n0"), MAX_LOADS)
            met = moved.join(open_, reduce(lambda p, q: p & q, [F.col(c).eqNullSafe(F.col(f"o_{c}")) for c in keys]))
            sums = met.groupBy(*keys, "v", "pc", "po", "n", "n0").agg(F.sum("cur").alias("cur"), F.sum("old").alias("old"))
            inner = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
            run = sums.select("pair", "column_name", "pc", "po", "n", "n0", F.sum("cur").over(inner).alias("cur"), F.sum("old").over(inner).alias("old"))
            hits = hits.unionByName(run.where(F.abs(lead(F.col("cur") + F.col("pc"), F.col("old") + F.col("po"))) > most).select("pair", "column_name").distinct())
        return hits.select(F.col("pair").alias("load"), "column_name", F.lit("distribution").alias("finding"))

    def findings(self) -> DataFrame:
        """``load, column_name, finding, key``; key 0 for loads as a whole."""
        whole = self.load_findings().withColumn("key", F.lit(0).cast("long"))
        return self.row_findings().select("load", "column_name", "finding", F.col("key").cast("long").alias("key")).unionByName(whole)
