"""Adjacency-table shredding of nested JSON records into related flat tables (problem 1).

``shred`` turns every JSON text into nodes ``(id, node, parent, label, ordinal, kind, scalar)``: one row per object,
array and scalar, numbered in document order, each naming its parent. ``children`` and ``entity`` then work on that
table with equi-joins only, so they need no schema and no knowledge of the depth.

Defined results: a null, empty or unreadable text, a text that is not an object, or one nested deeper than the parser
follows has no nodes. A leading byte-order mark is ignored and a text that is a JSON string is read once more. Of an
exactly repeated name in one object the last value counts, as in JSON readers at large. Rows with a null id give no
nodes; rows repeated with one id are read once for each distinct text. Extra columns are left out, whatever their name.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarmill.functions.keys import strip
from sonarmill.session import spread

NODES = "id bigint, node int, parent int, label string, ordinal int, kind string, scalar string"


def _parsed(text: str | None) -> dict | None:
    for _ in range(2):
        if text is None:
            return None
        try:
            value = json.loads(text.lstrip("﻿"))
        except (ValueError, RecursionError):
            return None
        if not isinstance(value, str):
            return value if isinstance(value, dict) else None
        text = value
    return None


def _sound(text: str) -> str:
    """The text with halves of surrogate pairs, which JSON escapes allow, replaced by question marks."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode("utf-8")


def _kind(value: object) -> str:
    if isinstance(value, dict):
        return "object"
    if isinstance(value, list):
        return "array"
    if isinstance(value, bool):
        return "boolean"
    return "null" if value is None else "string" if isinstance(value, str) else "number"


def _nodes(key: int, root: dict) -> Iterator[tuple]:
    """Depth first without recursion: a node is numbered when it is taken from the stack."""
    stack: list[tuple[object, int, str | None, int]] = [(root, -1, None, 0)]
    number = 0
    while stack:
        value, parent, label, ordinal = stack.pop()
        kind = _kind(value)
        inner = kind in ("object", "array")
        yield key, number, parent, label, ordinal, kind, None if inner or value is None else _sound(value) if kind == "string" else json.dumps(value)
        if kind == "object":
            stack.extend((v, number, _sound(k), i) for i, (k, v) in reversed(list(enumerate(value.items()))))
        elif kind == "array":
            stack.extend((v, number, None, i) for i, v in reversed(list(enumerate(value))))
        number += 1


def shred(df: DataFrame, key: str, text: str, batch: int = 20_000) -> DataFrame:
    """The node table of the JSON texts in column ``text``; ``key`` names the records and must be an integer.

    Nodes leave the worker in pieces of ``batch`` rows, so one very long record needs no memory beyond its own text.
    """
    columns = [x.split()[0] for x in NODES.split(", ")]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for frame in frames:
            for k, t in zip(frame["k"], frame["t"], strict=True):
                if (root := _parsed(t)) is None:
                    continue
                for row in _nodes(k, root):
                    rows.append(row)
                    if len(rows) >= batch:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    records = df.select(F.col(key).cast("bigint").alias("k"), F.col(text).cast("string").alias("t")).where("k IS NOT NULL AND t IS NOT NULL AND t <> ''")
    return spread(records).mapInPandas(read, NODES)


def name_key(label: Column) -> Column:
    """Names are matched trimmed, in any case, with blank and ``-`` read as ``_``."""
    return F.translate(F.lower(strip(label)), " -", "__")


def roots(nodes: DataFrame) -> DataFrame:
    """The outermost objects as parents: ``(id, node, pos)``."""
    return nodes.where("parent = -1").select("id", "node", F.lit(-1).alias("pos"))


def members(nodes: DataFrame, parents: DataFrame, name: str) -> DataFrame:
    """The values that the parent objects hold under ``name``: ``(id, node, kind, parent_node, parent_pos)``."""
    named = nodes.where(name_key(F.col("label")) == name).select("id", "node", F.col("parent").alias("parent_node"), "kind")
    return named.join(parents.select("id", F.col("node").alias("parent_node"), F.col("pos").alias("parent_pos")), ["id", "parent_node"])


def children(nodes: DataFrame, parents: DataFrame, name: str) -> DataFrame:
    """The child objects under ``name``: ``(id, node, pos, parent_node, parent_pos)``.

    A value that is an object is one child at 0; of an array, each element that is an object is a child at its place,
    all elements counted. Other values are none.
    """
    held = members(nodes, parents, name).where("kind IN ('object', 'array')")
    slots = F.array(F.struct(F.lit("object").alias("kind"), F.col("node").alias("value"), F.lit(0).alias("pos")), F.struct(F.lit("array").alias("kind"), F.col("parent").alias("value"), F.col("ordinal").alias("pos")))
    objects = nodes.where("kind = 'object'").select("id", "node", F.inline(slots))
    return objects.join(held.withColumnRenamed("node", "value"), ["id", "value", "kind"]).select("id", "node", "pos", "parent_node", "parent_pos")


def entity(nodes: DataFrame, objects: DataFrame, fields: dict[str, tuple[str, ...]]) -> DataFrame:
    """The objects, each with its scalar fields pivoted into columns.

    ``fields`` maps a column to the steps that lead to it from the object; a step before the last is a nested object.
    A field that is missing, null or no scalar is null; of one that is spelt in several ways the first in order counts.
    """
    out = objects
    by_home: dict[tuple[str, ...], dict[str, str]] = {}
    for column, steps in fields.items():
        by_home.setdefault(steps[:-1], {})[column] = steps[-1]
    scalars = nodes.where("kind IN ('string', 'number', 'boolean')")
    for home, wanted in by_home.items():
        level = objects.select("id", "node", F.lit(0).alias("pos"), F.col("node").alias("top"))
        for step in home:
            inner = nodes.where((name_key(F.col("label")) == step) & (F.col("kind") == "object")).select("id", "node", F.col("parent").alias("up"))
            level = inner.join(level.select("id", F.col("node").alias("up"), "top"), ["id", "up"]).select("id", "node", "top")
        found = scalars.where(name_key(F.col("label")).isin(list(wanted.values()))).select("id", F.col("parent").alias("node"), name_key(F.col("label")).alias("field"), "scalar", "ordinal")
        pivot = level.select("id", "node", "top").join(found, ["id", "node"]).groupBy("id", F.col("top").alias("node")).agg(*[F.min_by(F.when(F.col("field") == f, F.col("scalar")), F.when(F.col("field") == f, F.col("ordinal"))).alias(c) for c, f in wanted.items()])
        out = out.join(pivot, ["id", "node"], "left")
    return out
