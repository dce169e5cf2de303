"""Deeply nested records as related flat tables, by Merkle identities of subtrees.

Every object of a record gets an identity: the MD5 of its canonical form, in which scalar fields are
length-prefixed text under name and type and child objects are stood for by their own identities, computed bottom-up. Equal
objects share one identity and are stored once per path; each occurrence is kept as a bridge row that names the
parent object, the parent's identity and the ordinals on the way from the root.

Defined results
* A NULL object, and a NULL element of an array, is no occurrence; elements after it keep their ordinals.
* An object whose fields are all NULL is an occurrence, and so is an empty one.
* Records that share a key count once. Should their contents differ, the record with the smallest root
  identity is kept. Records with a NULL key are told apart by their root identity.
* Empty tables give empty results of the same schema. Columns besides the key and the roots are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY, IDENTITY = "record_key", "root_identity"


def _bind(value: Column, body) -> Column:
    """``body`` over ``value``, which is evaluated once (Catalyst has no let expression)."""
    return F.transform(F.array(value), body).getItem(0)


def _is_object_array(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)) and _has_object(kind.elementType)


def _has_object(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) or (isinstance(kind, T.ArrayType) and _has_object(kind.elementType))


def _framed(text: Column) -> Column:
    """Length-prefixed text, so that no two field lists give the same concatenation; NULL is ``~``."""
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("~"))


def _leaf_text(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.MapType):
        return F.to_json(F.struct(F.array_sort(F.map_entries(value)).alias("m")), {"ignoreNullFields": "false"})
    if isinstance(kind, T.ArrayType):
        return F.when(value.isNotNull(), F.to_json(F.struct(value.alias("a")), {"ignoreNullFields": "false"}))
    if isinstance(kind, T.BinaryType):
        return F.hex(value)
    return value.cast("string")


def annotate(value: Column, kind: T.DataType) -> Column:
    """``struct(h, v, k)``: identity, value, and annotated children of an object or array of objects."""
    if isinstance(kind, T.StructType):
        children = [f for f in kind.fields if _has_object(f.dataType)]
        leaves = sorted((f for f in kind.fields if not _has_object(f.dataType)), key=lambda f: f.name)

        def node(kids: Column | None) -> Column:
            parts = [_framed(_leaf_text(value[f.name], f.dataType)) for f in leaves]
            parts += [_framed(kids[f.name]["h"]) for f in sorted(children, key=lambda f: f.name)]
            names = ",".join([f"{f.name} {f.dataType.simpleString()}" for f in leaves] + sorted(f.name for f in children))
            fields = [F.md5(F.concat(F.lit(f"{{{names}}}"), *parts)).alias("h"), value.alias("v")]
            return F.struct(*fields, *([kids.alias("k")] if kids is not None else []))

        if not children:
            return F.when(value.isNotNull(), node(None))
        below = F.struct(*[annotate(value[f.name], f.dataType).alias(f.name) for f in children])
        return F.when(value.isNotNull(), _bind(below, node))
    if not isinstance(kind, T.ArrayType):
        raise TypeError(f"not an object or array of objects: {kind.simpleString()}")
    elements = F.transform(value, lambda e: annotate(e, kind.elementType))

    def listed(kids: Column) -> Column:
        joined = F.array_join(F.transform(kids, lambda k: F.coalesce(k["h"], F.lit("~"))), ",")
        return F.struct(F.md5(F.concat(F.lit("["), joined, F.lit("]"))).alias("h"), kids.alias("k"))

    return F.when(value.isNotNull(), _bind(elements, listed))


def _occurrence(path: str, numbers: dict[str, int], ordinals: Column, parent_hash: Column, node: Column) -> Column:
    """A bridge row as it travels: the path by its number, identities as bytes."""
    return F.struct(F.lit(numbers[path]).alias("path"), ordinals.alias("ordinals"), F.unhex(parent_hash).alias("parent"), F.unhex(node["h"]).alias("own"))


def _occurrences(node: Column, kind: T.DataType, path: str, numbers: dict[str, int], ordinals: Column, parent_hash: Column) -> Column:
    """All bridge rows below an annotated value, as one array."""
    none = F.array().cast("array<struct<path:int,ordinals:array<int>,parent:binary,own:binary>>")
    if isinstance(kind, T.StructType):
        lists = [F.array(_occurrence(path, numbers, ordinals, parent_hash, node))]
        lists += [
            _occurrences(node["k"][f.name], f.dataType, f"{path}.{f.name}", numbers, ordinals, node["h"])
            for f in kind.fields if _has_object(f.dataType)
        ]
        return F.when(node.isNotNull(), F.concat(*lists) if len(lists) > 1 else lists[0]).otherwise(none)
    inner = F.transform(
        node["k"],
        lambda e, i: _occurrences(e, kind.elementType, path, numbers, F.concat(ordinals, F.array(i)), parent_hash),
    )
    return F.coalesce(F.flatten(inner), none)


@dataclass(frozen=True)
class NestedTables:
    """``bridge``: one row per occurrence; ``objects(path)``: the distinct objects found at a path."""

    bridge: DataFrame
    records: DataFrame
    paths: dict[str, T.StructType]
    _values: dict

    def objects(self, path: str) -> DataFrame:
        """The distinct objects at ``path``: identity, scalar fields, identities of child objects and lists."""
        kind = self.paths[path]
        nodes = self._values[path](self.records)
        fields = []
        for f in kind.fields:
            if _has_object(f.dataType):
                fields.append(F.col("o")["k"][f.name]["h"].alias(f"{f.name}_identity"))
            else:
                fields.append(F.col("o")["v"][f.name].alias(f.name))
        rows = nodes.where(F.col("o").isNotNull()).select(F.col("o")["h"].alias("identity"), *fields)
        return rows.dropDuplicates(["identity"])


def _node_reader(root: str, kind: T.DataType, steps: list):
    """A function from annotated records to one row per node at the end of ``steps``."""

    def read(records: DataFrame) -> DataFrame:
        rows = records.select(F.col(f"`n_{root}`").alias("o"))
        for step in steps:
            rows = rows.select(F.explode(F.col("o")["k"]).alias("o")) if step is None else rows.select(F.col("o")["k"][step].alias("o"))
        return rows

    return read


def _walk(root: str, kind: T.DataType, path: str, parent: str, steps: list, found: dict) -> None:
    """Type, reader and parent of every path at and below ``path``."""
    if isinstance(kind, T.ArrayType):
        _walk(root, kind.elementType, path, parent, [*steps, None], found)
        return
    found[path] = (kind, _node_reader(root, kind, steps), parent)
    for f in kind.fields:
        if _has_object(f.dataType):
            _walk(root, f.dataType, f"{path}.{f.name}", path, [*steps, f.name], found)


def flatten_records(df: DataFrame, key: str, roots: list[str]) -> NestedTables:
    """Take the objects below ``roots`` (top-level columns, objects or arrays of objects) apart.

    ``bridge`` has ``record_key``, ``path``, ``parent_path``, ``ordinals`` (indices along the arrays on the
    way, 0-based), ``parent_identity`` and ``identity``. The occurrences of a record travel as one array,
    so that copies are dropped in one shuffle of a row per record, before anything is exploded.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    for r in roots:
        if r not in kinds or not _has_object(kinds[r]):
            raise ValueError(f"{r} is no object or array of objects of the table")
    nodes = df.select(F.col(key).alias(KEY), *[annotate(F.col(f"`{r}`"), kinds[r]).alias(f"n_{r}") for r in roots])
    identity = F.md5(F.concat(*[_framed(F.col(f"`n_{r}`")["h"]) for r in roots]))
    found: dict = {}
    for r in roots:
        _walk(r, kinds[r], r, "", [], found)
    paths = list(found)
    numbers = {p: i for i, p in enumerate(paths)}
    empty = F.array().cast("array<int>")
    lists = [_occurrences(F.col(f"`n_{r}`"), kinds[r], r, numbers, empty, F.lit(None).cast("string")) for r in roots]
    rows = nodes.select(KEY, identity.alias(IDENTITY), (reduce(F.concat, lists)).alias("all"))
    once = rows.groupBy(KEY, F.when(F.col(KEY).isNull(), F.col(IDENTITY)).alias("lone")).agg(F.min_by("all", IDENTITY).alias("all"))
    named = lambda names: F.get(F.array(*[F.lit(n) for n in names]), F.col("x.path"))
    bridge = once.select(KEY, F.explode("all").alias("x")).select(
        KEY, named(paths).alias("path"), named([parent for _, _, parent in found.values()]).alias("parent_path"), F.col("x.ordinals").alias("ordinals"),
        F.lower(F.hex("x.parent")).alias("parent_identity"), F.lower(F.hex("x.own")).alias("identity"),
    )
    return NestedTables(bridge, nodes, {p: k for p, (k, _, _) in found.items()}, {p: r for p, (_, r, _) in found.items()})
