"""Schemas that drift between files: tagged-union inference over JSON records.

Every file's records are fused into one schema that keeps, for each path, the set of alternative JSON types
found there (a tagged union, held as a bit set). Fusing is a bitwise OR and therefore aggregates map-side in
any order. Neighbouring files' unions are then compared: paths appear, cease, or gain and lose alternatives;
a ceased and a new path whose values agree in all common records are one renamed path. ``unify`` reads all
files into one table in which a path with conflicting types has a typed branch per alternative next to its
canonical text.

Defined results
* Lines that are no valid JSON (NULL, blank, cut off) are ignored, and so is JSON that is no object. Report and table
  read lines with one parser, to any depth and with any number of digits; of a repeated key the last value counts.
* A key exists if any record has it, be its value NULL. A file without any valid line has no paths.
* Repeated lines change nothing. A key with a dot in its name reads like a deeper path.
* Several paths may be renames of one: every pair that meets the definition is reported.
* Numbers are equal if their values are (1 and 1.0); arrays of objects are compared element by element.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from decimal import Context, Decimal
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DecimalType, DoubleType, LongType, StringType, StructField, StructType

from tributary.runtime import broadcast_within, materialise

#: Bit of each JSON type in a union; 0 is null.
TYPES = {"string": 1, "number": 2, "boolean": 4, "object": 8, "array": 16}
NAMES_OF = {bit: name for name, bit in TYPES.items()}
#: Characters of paths that a task gathers before it hands them on.
GATHERED = 1 << 25
#: Files with renames whose paths, and bytes of these, may be broadcast. Beyond them both sides are shuffled, and the records
#: of files of more than ``HEAVY`` lines are spread over ``SALT`` parts.
MAX_SIDES, SIDE_BYTES, HEAVY, SALT = 100_000, 32 << 20, 20_000, 64
#: Digits up to which numbers are written without an exponent.
PLAIN_DIGITS = 400
#: Records per batch of the unified table.
ROWS = 1000
#: Digits of exact numbers, and those behind the point.
DECIMAL = 38, 18
#: Column types of the branches that are no text.
KINDS = {
    "number": (DoubleType(), pa.float64()), "boolean": (BooleanType(), pa.bool_()), "integer": (LongType(), pa.int64()),
    "decimal": (DecimalType(*DECIMAL), pa.decimal128(*DECIMAL)),
}


def _walk(value, path: str, out: dict) -> int:
    """OR the type of every key below ``value`` into ``out``, by path and key; how many characters new paths have."""
    todo, long = [(value, path)], 0
    while todo:
        value, path = todo.pop()
        if isinstance(value, dict):
            level = out.setdefault(path, {})
            for k, v in value.items():
                bit, had = BITS[type(v)], level.get(k)
                if had is None:
                    level[k] = bit
                    long += len(path) + len(k)
                elif had | bit != had:
                    level[k] = had | bit
                if bit >= 8:
                    todo.append((v, f"{path}.{k}"))
        else:
            todo += [(v, f"{path}[]") for v in value if isinstance(v, (dict, list))]
    return long


def _no_number(text: str):
    raise ValueError(f"{text} is no JSON")


class _Number(float):
    """A number that is no integer, with its exact text."""

    text: str


def _number(token: str) -> _Number:
    value = _Number(token)
    try:
        exact = Decimal(token)
    except ArithmeticError:  # a power beyond all bounds
        value.text = token
        return value
    plain = f"{exact:f}" if abs(exact.adjusted()) <= PLAIN_DIGITS else str(exact)
    if "." in plain and "E" not in plain:
        plain = plain.rstrip("0").rstrip(".")
    value.text = "0" if not exact else plain
    return value


def _whole(token: str) -> int | _Number:
    try:
        return int(token)
    except ValueError:  # more digits than the interpreter converts
        return _number(token)


#: Bits of the values that the parsers give.
BITS = {type(None): 0, str: 1, int: 2, float: 2, _Number: 2, bool: 4, dict: 8, list: 16}

_BLANK = re.compile(r"[ \t\n\r]*")
_TOKEN = re.compile(r"(-?(?:0|[1-9][0-9]*))(\.[0-9]+)?([eE][-+]?[0-9]+)?|true|false|null")
_WORDS = {"true": True, "false": False, "null": None}


def _deep(text: str):
    """JSON of any depth: what the recursive parser gives up on, read with a stack of the open objects and arrays."""
    blank = lambda i: _BLANK.match(text, i).end()
    stack: list = []
    at = blank(0)
    while True:
        mark = text[at : at + 1]
        if mark in ("{", "["):
            stack.append([{} if mark == "{" else [], None])
            at = blank(at + 1)
            if text[at : at + 1] == ("}" if mark == "{" else "]"):
                value, at = stack.pop()[0], at + 1
            elif mark == "[":
                continue
            else:
                stack[-1][1], at = _key(text, at, blank)
                continue
        elif mark == '"':
            value, at = scanstring(text, at + 1, True)
        elif token := _TOKEN.match(text, at):
            whole, point, power = token.groups()
            value = _WORDS[token[0]] if whole is None else _number(token[0]) if point or power else _whole(whole)
            at = token.end()
        else:
            raise ValueError("no value")
        while True:
            at = blank(at)
            if not stack:
                if at != len(text):
                    raise ValueError("more than one value")
                return value
            holder, key = stack[-1]
            if isinstance(holder, dict):
                holder[key] = value
            else:
                holder.append(value)
            mark = text[at : at + 1]
            if mark == ",":
                at = blank(at + 1)
                if isinstance(holder, dict):
                    stack[-1][1], at = _key(text, at, blank)
                break
            if mark != ("}" if isinstance(holder, dict) else "]"):
                raise ValueError("not closed")
            value, at = stack.pop()[0], at + 1


def _key(text: str, at: int, blank) -> tuple[str, int]:
    if text[at : at + 1] != '"':
        raise ValueError("no key")
    key, at = scanstring(text, at + 1, True)
    at = blank(at)
    if text[at : at + 1] != ":":
        raise ValueError("no value")
    return key, blank(at + 1)


class _Decoder:
    """The interpreter's JSON decoder, made once per process; it does not travel."""

    def __init__(self, **options):
        self.options, self.decoder = options, None

    def __getstate__(self) -> dict:
        return {"options": self.options, "decoder": None}

    def __call__(self, text: str):
        if self.decoder is None:
            self.decoder = json.JSONDecoder(**self.options)
        return self.decoder.decode(text)


_EXACT, _ROUGH = _Decoder(parse_constant=_no_number, parse_float=_number), _Decoder(parse_constant=_no_number)


def _document(payload: str | None, exact: bool = True):
    """The object in a line; NULL if the line is no JSON object. Without ``exact``, for types only, numbers are rounded."""
    if payload is None:
        return None
    try:
        try:
            record = (_EXACT if exact else _ROUGH)(payload)
        except RecursionError:
            record = _deep(payload)
        except json.JSONDecodeError:
            return None
        except ValueError:  # very many digits, or no JSON
            record = _deep(payload)
    except ValueError:
        return None
    return record if isinstance(record, dict) else None


def _steps(path: str) -> list[tuple[str, int]]:
    """Keys of a path, each with the number of arrays behind it."""
    steps = []
    for step in path.split("."):
        name = step
        while name.endswith("[]"):
            name = name[:-2]
        steps.append((name, (len(step) - len(name)) // 2))
    return steps


def _pick(record, steps: list[tuple[str, int]]):
    """The value at the end of ``steps`` of a path; behind an array, the list over its elements, NULL if no element has one."""
    if not any(arrays for _, arrays in steps):
        for step, _ in steps:
            record = record.get(step) if isinstance(record, dict) else None
        return record
    top = [record]
    slots, spread = [(top, 0)], []
    for step, arrays in steps:
        for holder, i in slots:
            holder[i] = holder[i].get(step) if isinstance(holder[i], dict) else None
        for _ in range(arrays):
            inner = []
            for holder, i in slots:
                holder[i] = list(holder[i]) if isinstance(holder[i], list) else None
                if holder[i] is not None:
                    spread.append((holder, i))
                    inner += [(holder[i], k) for k in range(len(holder[i]))]
            slots = inner
    for holder, i in reversed(spread):
        if all(v is None for v in holder[i]):
            holder[i] = None
    return top[0]


def file_unions(df: DataFrame, feed: str, file: str, payload: str, root: str) -> DataFrame:
    """``feed, file, paths`` with ``paths`` a map from path to type bits, for every file."""

    def gathered(seen: dict) -> pa.RecordBatch:
        rows = []
        for (fd, fl), out in seen.items():
            rows += [(fd, fl, _sound(f"{p}.{k}"), bits) for p, level in out.items() for k, bits in level.items()] or [(fd, fl, None, 0)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int32()))], ["feed", "file", "path", "bits"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        long = 0
        for batch in batches:
            for fd, fl, text in zip(*(c.to_pylist() for c in batch.columns)):
                out = seen.setdefault((fd, fl), {})
                record = _document(text, exact=False)
                if record is not None and isinstance(record.get(root), (dict, list)):
                    long += _walk(record[root], root, out)
                    if long > GATHERED:
                        yield gathered(seen)
                        seen, long = {}, 0
        yield gathered(seen)

    source = df.select(F.col(feed).cast("long"), F.col(file).cast("long"), F.col(payload))
    raw = source.mapInArrow(scan, "feed long, file long, path string, bits int")
    per = raw.groupBy("feed", "file", "path").agg(F.bit_or("bits").alias("bits"))
    entries = F.collect_list(F.when(F.col("path").isNotNull(), F.struct("path", "bits")))
    return per.groupBy("feed", "file").agg(F.map_from_entries(entries).alias("paths"))


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^.]*\z", "")


def neighbour_changes(unions: DataFrame) -> DataFrame:
    """``feed, file, old_file, ceased, added, retyped`` (arrays of paths) of each file with a predecessor."""
    w = Window.partitionBy("feed").orderBy("file")
    pair = unions.withColumn("old", F.lag("paths").over(w)).withColumn("old_file", F.lag("file").over(w)).where("old_file is not null")
    both = F.array_intersect(F.map_keys("paths"), F.map_keys("old"))
    differ = F.filter(both, lambda p: (F.col("paths")[p] != F.col("old")[p]) & (F.col("paths")[p] != 0) & (F.col("old")[p] != 0))
    return pair.select(
        "feed", "file", "old_file", F.array_except(F.map_keys("old"), F.map_keys("paths")).alias("ceased"),
        F.array_except(F.map_keys("paths"), F.map_keys("old")).alias("added"), differ.alias("retyped"),
    )


def _renames(df: DataFrame, changes: DataFrame, feed: str, file: str, payload: str, record_id: str) -> DataFrame:
    """``feed, file, new_path, old_path`` of ceased and new siblings with equal values in all common records.

    Only files with such siblings are read again, and only the values of these paths travel, as hashes. What to look
    for in which file is broadcast after a count; beyond ``MAX_SIDES`` it is shuffled and never sent to the driver, once for a
    file and ``SALT`` times for one of more than ``HEAVY`` lines, so no such file is joined by one task.
    """
    parents = lambda c: F.array_distinct(F.transform(c, _parent))
    common = F.array_intersect(parents(F.col("ceased")), parents(F.col("added")))
    keep = lambda c: F.filter(c, lambda p: F.array_contains(F.col("common"), _parent(p)))
    open_ = changes.withColumn("common", common).where(F.size("common") > 0)
    wanted = open_.select("feed", "file", "old_file", keep(F.col("ceased")).alias("ceased"), keep(F.col("added")).alias("added"))
    sides = wanted.select("feed", F.explode(F.array(
        F.struct(F.col("file").alias("at"), F.col("file").alias("of"), F.lit("n").alias("side"), F.col("added").alias("paths")),
        F.struct(F.col("old_file").alias("at"), F.col("file").alias("of"), F.lit("o").alias("side"), F.col("ceased").alias("paths")),
    )).alias("s")).select("feed", "s.*")
    source = df.select(F.col(feed).cast("long").alias("feed"), F.col(file).cast("long").alias("at"), F.col(payload).alias("payload"))
    small = broadcast_within(sides, MAX_SIDES, SIDE_BYTES)
    if small is not sides:
        tasks = source.join(small, ["feed", "at"])
    else:
        heavy = source.groupBy("feed", "at").count().where(F.col("count") > HEAVY).select("feed", "at", F.lit(SALT).alias("parts"))
        heavy = broadcast_within(materialise(heavy, "heavy"), MAX_SIDES)
        parts = F.coalesce("parts", F.lit(1))
        sides = sides.join(heavy, ["feed", "at"], "left").select(*sides.columns, F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
        salt = F.pmod(F.xxhash64("payload", F.monotonically_increasing_id()), parts).cast("int")
        source = source.join(heavy, ["feed", "at"], "left").select(*source.columns, salt.alias("salt"))
        # by the size of its files, compressed and not yet exploded, Spark would take the paths for a table to broadcast
        tasks = source.join(sides.hint("merge"), ["feed", "at", "salt"])
    tasks = tasks.select("feed", "of", "side", "paths", "payload")

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps: dict = {}
        for batch in batches:
            rows = []
            for fd, of, side, paths, text in zip(*(c.to_pylist() for c in batch.columns)):
                record = _document(text)
                if record is None or record.get(record_id) is None:
                    continue
                own = _digest(record[record_id])
                for p in paths:
                    if p not in steps:
                        steps[p] = _steps(p)
                    value = _pick(record, steps[p])
                    if value is not None:
                        rows.append((fd, of, side, p, own, _digest(value)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["feed", "file", "side", "path", "id", "value"])

    cells = tasks.mapInArrow(values, "feed long, file long, side string, path string, id binary, value binary")
    cells = cells.withColumn("parent", _parent(F.col("path")))
    grouped = cells.groupBy("feed", "file", "parent", "id").agg(
        F.collect_set(F.when(F.col("side") == "n", F.struct("path", "value"))).alias("new"),
        F.collect_set(F.when(F.col("side") == "o", F.struct("path", "value"))).alias("old"),
    ).where((F.size("new") > 0) & (F.size("old") > 0))
    # one record's siblings: as many pairs as the definition compares, bounded by the width of an object
    pairs = grouped.select("feed", "file", F.explode("new").alias("n"), "old").select("feed", "file", "n", F.explode("old").alias("o"))
    same = pairs.groupBy("feed", "file", F.col("n.path").alias("new_path"), F.col("o.path").alias("old_path"))
    return same.agg(F.min(F.col("n.value") == F.col("o.value")).alias("same")).where("same").drop("same")


def schema_changes(df: DataFrame, feed: str, file: str, payload: str, root: str, record_id: str) -> DataFrame:
    """``feed, file, change_kind, field_path, old_path`` of each file against its feed's preceding file."""
    changes = materialise(neighbour_changes(file_unions(df, feed, file, payload, root)), "drift")
    renames = _renames(df, changes, feed, file, payload, record_id)
    per = renames.groupBy("feed", "file").agg(F.collect_set(F.struct("new_path", "old_path")).alias("renamed"))
    joined = changes.join(per, ["feed", "file"], "left")
    renamed = F.coalesce(F.col("renamed"), F.array().cast("array<struct<new_path:string,old_path:string>>"))
    kind = lambda name, p, old: F.struct(F.lit(name).alias("change_kind"), p.alias("field_path"), old.alias("old_path"))
    none = F.lit("")
    rows = F.concat(
        F.transform(renamed, lambda r: kind("renamed", r["new_path"], r["old_path"])),
        F.transform(F.array_except(F.col("ceased"), F.transform(renamed, lambda r: r["old_path"])), lambda p: kind("removed", p, none)),
        F.transform(F.array_except(F.col("added"), F.transform(renamed, lambda r: r["new_path"])), lambda p: kind("added", p, none)),
        F.transform(F.col("retyped"), lambda p: kind("type_changed", p, none)),
    )
    return joined.select("feed", "file", F.explode(rows).alias("r")).select("feed", "file", "r.*")


def appearing_alternatives(unions: DataFrame) -> DataFrame:
    """``feed, path, json_type, file``: the first file of each feed in which an alternative of a path appears."""
    kinds = F.array(*[F.struct(F.lit(t).alias("json_type"), F.lit(bit).alias("bit")) for t, bit in TYPES.items()])
    paths = unions.select("feed", "file", F.explode("paths").alias("path", "bits")).select("*", F.explode(kinds).alias("k"))
    found = paths.where(F.col("bits").bitwiseAND(F.col("k.bit")) != 0)
    return found.groupBy("feed", "path", F.col("k.json_type").alias("json_type")).agg(F.min("file").alias("file"))


def rename_groups(unions: DataFrame, changes: DataFrame, root: str, max_names: int = 2000) -> list[list[str]]:
    """Paths below ``root`` that are one field under several names, the oldest name first.

    Siblings are joined along reported renames unless some file has two of them at once: these are two fields
    there, and joining them would lose one. Levels are taken from the top, so that paths below renamed objects
    count under the oldest names of these. Names are schema, so all renames are collected; more than ``max_names``
    renamed names are an error.
    """
    edges = changes.where(F.col("change_kind") == "renamed").groupBy("old_path", "field_path").agg(F.count("*").alias("n"))
    found = edges.collect()
    if not found:
        return []
    if len({r[c] for r in found for c in ("old_path", "field_path")}) > max_names:
        raise ValueError(f"more than {max_names} renamed names below {root}")
    leaf = lambda p: F.substring_index(p, ".", -1)
    leaves = F.array(*[F.lit(x) for x in sorted({r[c].rpartition(".")[2] for r in found for c in ("old_path", "field_path")})])
    here = F.filter(F.map_keys("paths"), lambda p: F.array_contains(leaves, leaf(p)))
    pairs = unions.select(here.alias("x")).distinct().select("x", F.explode("x").alias("a")).select("a", F.explode("x").alias("b"))
    pairs = pairs.where((F.col("a") < F.col("b")) & (_parent(F.col("a")) == _parent(F.col("b")))).distinct().collect()
    oldest: dict[str, str] = {}
    groups: list[list[str]] = []
    for depth in sorted({r["old_path"].count(".") for r in found}):
        name = lambda p: _oldest_path(_below(p, root), oldest)
        apart = {frozenset((name(r["a"]), name(r["b"]))) for r in pairs if r["a"].count(".") == depth}
        weights: dict = {}
        for r in found:
            if r["old_path"].count(".") == depth:
                edge = name(r["old_path"]), name(r["field_path"])
                weights[edge] = weights.get(edge, 0) + r["n"]
        group = {n: [n] for edge in weights for n in edge}
        for edge in sorted(weights, key=lambda e: (-weights[e], e)):
            old, new = (group[n] for n in edge)
            if old is new or any(frozenset((a, b)) in apart for a in old for b in new):
                continue
            old.extend(new)
            for n in new:
                group[n] = old
        joined = [g for g in {id(g): g for g in group.values()}.values() if len(g) > 1]
        oldest |= {n: g[0] for g in joined for n in g}
        groups += joined
    return groups


def _below(path: str, root: str) -> str:
    return path[len(root) :].removeprefix(".")


def _oldest_path(path: str, oldest: dict[str, str]) -> str:
    """``path`` with every step under its oldest name; ``oldest`` maps paths whose parents are so already."""
    out = ""
    for i, step in enumerate(path.split(".")):
        name = step
        while name.endswith("[]"):
            name = name[:-2]
        at = f"{out}.{name}" if i else name
        out = oldest.get(at, at) + step[len(name) :]
    return out


def _sound(text: str) -> str:
    """``text`` without halves of characters, which no table can hold."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode()


def _digest(value) -> bytes:
    """128 bits of a value's canonical text, strings apart from all else."""
    text = _json_text(value, "", {}) if isinstance(value, (dict, list)) else json.dumps(value, ensure_ascii=False) if isinstance(value, str) else _scalar_text(value)
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _json_text(value, path: str, names: dict[str, str]) -> str:
    """Compact JSON with sorted keys, in which objects at and below ``path`` have canonical names."""
    out, todo = [], [(value, path)]
    while todo:
        value, path = todo.pop()
        if path is None:  # a mark of the syntax
            out.append(value)
        elif isinstance(value, dict):
            named: dict = {}
            for k, v in value.items():
                at = f"{path}.{k}" if names else ""
                name = k if "." in k or not names else names.get(at, at).rpartition(".")[2]
                named[k if name != k and (name in value or name in named) else name] = v, at
            parts = [("{", None)]
            for i, k in enumerate(sorted(named)):
                parts += [("," * (i > 0) + json.dumps(k, ensure_ascii=False) + ":", None), named[k]]
            todo += reversed([*parts, ("}", None)])
        elif isinstance(value, list):
            parts = [("[", None)]
            for i, v in enumerate(value):
                parts += [(",", None)] * (i > 0) + [(v, f"{path}[]" if names else "")]
            todo += reversed([*parts, ("]", None)])
        else:
            out.append(json.dumps(value, ensure_ascii=False) if isinstance(value, str) else _scalar_text(value))
    return "".join(out)


def _scalar_text(value) -> str:
    if isinstance(value, _Number):
        return value.text
    return value if isinstance(value, str) else json.dumps(value)


def _put(row: dict, path: str, inside: tuple, value) -> None:
    """Store ``value`` under ``path``, in lists as long as the arrays around it; ``inside``: their indexes and sizes."""
    if not inside:
        row.setdefault(path, value)
        return
    at = row.setdefault(path, [None] * inside[0][1])
    for (i, _), (_, size) in zip(inside, inside[1:]):
        if at[i] is None:
            at[i] = [None] * size
        at = at[i]
    if at[inside[-1][0]] is None:
        at[inside[-1][0]] = value


def _cells(value, names: dict[str, str], branches: set[tuple[str, str]]) -> dict:
    """Values by canonical path and, of paths with branches, by ``(path, type)``."""
    row: dict = {}
    todo = [(value, "", ())]
    while todo:
        value, path, inside = todo.pop()
        if isinstance(value, list):
            todo += [(v, f"{path}[]", (*inside, (i, len(value)))) for i, v in enumerate(value) if isinstance(v, (dict, list))]
            continue
        for k, v in value.items():
            at = f"{path}.{_sound(k)}" if path else _sound(k)
            nested = isinstance(v, (dict, list))
            if v is not None and at in names:
                text = _sound(_json_text(v, at, names) if nested else _scalar_text(v))
                _put(row, names[at], inside, text)
                if (names[at], kind := NAMES_OF[BITS[type(v)]]) in branches:
                    _put(row, (names[at], kind), inside, _float(v) if kind == "number" else v if kind == "boolean" else text)
                    if kind == "number":
                        for exact, kept in (("integer", _integer(v)), ("decimal", _decimal(text))):
                            if kept is not None and (names[at], exact) in branches:
                                _put(row, (names[at], exact), inside, kept)
            if nested:
                todo.append((v, at, inside))
    return row


def _float(value) -> float:
    try:
        return float(value)
    except OverflowError:
        return math.inf if value > 0 else -math.inf


def _integer(value) -> int | None:
    """A whole number of 64 bits, or NULL."""
    text = value.text if isinstance(value, _Number) else value
    if isinstance(text, str):
        text = int(text) if len(text) < 21 and re.fullmatch(r"-?[0-9]+", text) else None
    return text if text is not None and -(1 << 63) <= text < 1 << 63 else None


def _decimal(text: str) -> Decimal | None:
    """A number that fits 38 digits, 18 of them behind the point, or NULL."""
    exact = Decimal(text)
    fits = exact.adjusted() < DECIMAL[0] - DECIMAL[1] and -exact.as_tuple().exponent <= DECIMAL[1]
    return exact.quantize(Decimal(1).scaleb(-DECIMAL[1]), context=Context(prec=DECIMAL[0])) if fits else None


def unify(
    df: DataFrame, keys: list[str], payload: str, root: str, record_id: str, feed: str, file: str, max_paths: int = 2000, join_renames: bool = True, exact_numbers: bool = False,
) -> DataFrame:
    """All records as one table: ``keys``, ``record_id`` and, for each path below ``root``, nested ones too, a text
    column ``<path>`` (canonical conversion) plus, where types conflict, typed branches ``<path>__<type>``. Numbers are exact
    in the text; their branch ``__number`` is a double, beside which ``exact_numbers`` gives ``__integer`` (bigint) and
    ``__decimal`` (38 digits, 18 behind the point), each NULL where a number does not fit.

    Paths found to be renames of each other share the columns of the oldest one, at every level. Columns of
    paths in arrays (``friends[].name``) hold lists as long as the arrays, NULL where an element has no value;
    they are NULL if no element has one. Objects and arrays are JSON text under canonical names with sorted
    keys. The union's paths are collected to declare the table's columns; more than ``max_paths`` is an error,
    as no table could have them. Names that differ from another column's in letter case only, or equal a
    key's, get a number. If a key with a dot and a deeper path have one name, a record with both gives one of them.
    """
    unions = materialise(file_unions(df, feed, file, payload, root), "unions")
    fused = unions.select(F.explode("paths").alias("path", "bits")).groupBy("path").agg(F.bit_or("bits").alias("bits"))
    found = fused.orderBy("path").limit(max_paths + 1).collect()
    if len(found) > max_paths:
        raise ValueError(f"more than {max_paths} paths below {root}")
    groups = rename_groups(unions, schema_changes(df, feed, file, payload, root, record_id), root, max_paths) if join_renames else []
    oldest = {n: g[0] for g in groups for n in g}
    names = {(p := _below(r["path"], root)): _oldest_path(p, oldest) for r in found}
    bits: dict[str, int] = {}
    for r in found:
        first = names[_below(r["path"], root)]
        bits[first] = bits.get(first, 0) | r["bits"]
    source = df.select(*keys, F.col(payload))
    fields, taken, columns = list(source.schema.fields[:-1]), {c.lower() for c in [*keys, record_id]}, []
    fields.append(StructField(record_id, StringType()))
    for first in sorted(bits):
        kinds = [t for t, bit in TYPES.items() if bits[first] & bit]
        kinds = kinds if len(kinds) > 1 else []
        kinds += ["integer", "decimal"] if exact_numbers and "number" in kinds else []
        name = next(n for n in [first, *(f"{first}__{i}" for i in range(2, 10 * max_paths))] if not taken & {x.lower() for x in [n, *(f"{n}__{t}" for t in kinds)]})
        for cell, column, kind in [(first, name, "string"), *(((first, t), f"{name}__{t}", t) for t in kinds)]:
            taken.add(column.lower())
            spark_type, arrow = KINDS.get(kind, (StringType(), pa.string()))
            for _ in range(first.count("[]")):
                spark_type, arrow = ArrayType(spark_type), pa.list_(arrow)
            fields.append(StructField(column, spark_type))
            columns.append((cell, column, arrow))
    branches = {cell for cell, _, _ in columns if isinstance(cell, tuple)}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                documents = [_document(t) for t in part.column(len(keys)).to_pylist()]
                kept = [i for i, d in enumerate(documents) if d is not None]
                documents = [documents[i] for i in kept]
                cells = [_cells(d[root], names, branches) if isinstance(d.get(root), (dict, list)) else {} for d in documents]
                ids = [None if (v := d.get(record_id)) is None else _sound(_json_text(v, "", {}) if isinstance(v, (dict, list)) else _scalar_text(v)) for d in documents]
                arrays = [part.column(i).take(pa.array(kept, pa.int64())) for i in range(len(keys))] + [pa.array(ids, pa.string())]
                arrays += [pa.array([c.get(cell) for c in cells], arrow) for cell, _, arrow in columns]
                yield pa.RecordBatch.from_arrays(arrays, [f.name for f in fields])

    return source.mapInArrow(rows, StructType(fields))
