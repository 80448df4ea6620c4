"""Deeply nested records to flat, linked tables by columnar shredding.

A nested document is written as one column per leaf path. Each entry of a column
carries the value, a *repetition level* (at which repeated ancestor this entry
starts a new element; 0 is a new record) and a *definition level* (how many of the
repeated groups and the leaf on the path exist). Any table, one per repeated
ancestor, is then rebuilt from the level sequences of its own leaves alone, with
vectorised prefix sums: a row starts where the repetition level is at most the
ancestor's and the definition level at least it, and the number of such starts so
far is the row's place in the parent table. Neither step moves a row between tasks.

Defined results
    * null and blank texts hold nothing; a text that is not complete JSON, at the top
      or in a text embedded in it, is *damaged* and gives no rows at all.
    * a repeated group may stand as a list, as one object, as a map whose keys are the
      objects' names, as JSON text of any of these, or inside an optional container;
      null elements and elements that are no objects are skipped.
    * missing and null leaves are null; of repeated keys in one object the last holds.
    * equal elements are separate rows; their ordinals differ.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REST = "*"


@dataclass(frozen=True)
class Group:
    """A repeated group: its leaves, its repeated children, and how it may be written.

    ``key`` names the leaf that tells one object from a map of objects and that the
    map's keys fill; where a map has one of ``names`` as a key, only those are objects.
    ``within`` lists optional containers that may hold the group. The
    leaf ``*`` carries, as JSON, all scalars that are no leaf of their own.
    """

    name: str
    leaves: tuple[str, ...]
    children: tuple[Group, ...] = ()
    key: str | None = None
    within: tuple[str, ...] = ()
    names: tuple[str, ...] = ()
    level: int = field(default=0, compare=False)


def with_levels(group: Group, level: int = 1) -> Group:
    kids = tuple(with_levels(c, level + 1) for c in group.children)
    return Group(group.name, group.leaves, kids, group.key, group.within, group.names, level)


def paths(group: Group, above: tuple[Group, ...] = ()) -> Iterator[tuple[Group, ...]]:
    """The chain of groups from the root to each group."""
    yield (*above, group)
    for c in group.children:
        yield from paths(c, (*above, group))


class Damaged(ValueError):
    pass


def _load(text: str):
    try:
        return json.loads(text.lstrip("﻿"))
    except (ValueError, RecursionError) as e:
        raise Damaged(str(e)) from None


def parse(text: str | None):
    """The document of a text; texts that hold JSON text are opened again."""
    if text is None or not text.strip():
        return None
    value = _load(text)
    while isinstance(value, str) and value.strip():
        value = _load(value)
    return value


def elements(value, group: Group) -> list[dict]:
    """The objects of a repeated group, however they are written."""
    if isinstance(value, str):
        value = parse(value)
    if isinstance(value, list):
        out = []
        for v in value:
            v = parse(v) if isinstance(v, str) and v.lstrip()[:1] in ("{", "[") else v
            if isinstance(v, dict):
                out.append(v)
        return out
    if not isinstance(value, dict) or not value:
        return []
    if group.key is None or group.key in value:
        return [value]
    if any(k in value for k in group.names):
        value = {k: v for k, v in value.items() if k in group.names}
    opened = {k: parse(v) if isinstance(v, str) and v.lstrip()[:1] in ("{", "[", '"') else v for k, v in value.items()}
    if all(v is None or isinstance(v, dict) for v in opened.values()):
        return [{group.key: k, **v} for k, v in opened.items() if v is not None]
    return [value]


def _child(obj: dict, group: Group):
    if group.name in obj:
        return obj[group.name]
    for box in group.within:
        inner = obj.get(box)
        if isinstance(inner, str):
            inner = parse(inner)
        if isinstance(inner, dict) and group.name in inner:
            return inner[group.name]
    return None


def _text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def _leaf(obj: dict, path: str):
    value = obj
    for part in path.split("."):
        if not isinstance(value, dict):
            return None
        value = value.get(part)
    return value


def _rest(obj: dict, group: Group) -> str | None:
    known = {x.split(".")[0] for x in group.leaves} | {c.name for c in group.children} | {b for c in group.children for b in c.within}
    other = {k: v for k, v in obj.items() if k not in known}
    return _text(other) if other else None


class Levels:
    """Level columns of many records: (group index, leaf) -> [values, repetition, definition]."""

    def __init__(self, root: Group, wanted: Mapping[str, set[str]] | None = None):
        self.root = with_levels(root)
        self.chains = {c[-1].name: c for c in paths(self.root)}
        if len(self.chains) != sum(1 for _ in paths(self.root)):
            raise ValueError("group names must differ")
        self.columns: dict[tuple[str, str], tuple[list, list, list]] = {}
        self.leaves = {}
        for name, chain in self.chains.items():
            own = [x for x in chain[-1].leaves if wanted is None or x in wanted.get(name, ())]
            self.leaves[name] = own or [""]  # "" records only that elements exist
            for x in self.leaves[name]:
                self.columns[name, x] = ([], [], [])

    def _absent(self, group: Group, rep: int, depth: int) -> None:
        for x in self.leaves[group.name]:
            v, r, d = self.columns[group.name, x]
            v.append(None)
            r.append(rep)
            d.append(depth)
        for c in group.children:
            self._absent(c, rep, depth)

    def _write(self, group: Group, objs: list[dict], rep: int, depth: int) -> None:
        if not objs:
            self._absent(group, rep, depth)
            return
        for i, obj in enumerate(objs):
            here = rep if i == 0 else group.level
            for x in self.leaves[group.name]:
                value = None if x == "" else _rest(obj, group) if x == REST else _text(_leaf(obj, x))
                v, r, d = self.columns[group.name, x]
                v.append(value)
                r.append(here)
                d.append(depth + 1 + (value is not None))
            for c in group.children:
                self._write(c, self._children[id(obj), c.name], here, depth + 1)

    def _open(self, group: Group, objs: list[dict]) -> None:
        """Open all embedded texts first, so that a damaged one leaves nothing behind."""
        for obj in objs:
            for c in group.children:
                kids = elements(_child(obj, c), c)
                self._children[id(obj), c.name] = kids
                self._open(c, kids)

    def add(self, text: str | None) -> bool:
        """Write one record; False if its text is damaged (it then counts as empty)."""
        self._children: dict[tuple[int, str], list[dict]] = {}
        ok = True
        try:
            objs = elements(parse(text), self.root)
            self._open(self.root, objs)
        except (Damaged, RecursionError):
            objs, ok = [], False
        self._write(self.root, objs, 0, 0)
        return ok


def rebuild(levels: Levels, table: str) -> dict:
    """A group's table from level sequences.

    Gives ``record`` (index of the record), per ancestor ``row`` (index into its
    table) and ``ordinal`` (from 1, within its parent), and the own leaves' values.
    """
    chain = levels.chains[table]
    leaf = levels.leaves[table][0]
    _, r, d = levels.columns[table, leaf]
    rep, dfn = np.asarray(r, np.int16), np.asarray(d, np.int16)
    level = chain[-1].level
    keep = np.flatnonzero(dfn >= level)
    out = {"record": (np.cumsum(rep == 0) - 1)[keep], "row": {}, "ordinal": {}, "values": {}}
    for g in chain:
        starts = (rep <= g.level) & (dfn >= g.level)
        count = np.cumsum(starts)
        first = np.where(rep <= g.level - 1, count - starts, 0)
        base = np.maximum.accumulate(first)
        out["row"][g.name] = (count - 1)[keep]
        out["ordinal"][g.name] = (count - base)[keep]
    for x in levels.leaves[table]:
        if x:
            values = levels.columns[table, x][0]
            out["values"][x] = [values[i] for i in keep]
    return out


def nested_tables(
    df: DataFrame,
    keys: Sequence[str],
    text: str,
    root: Group,
    tables: Mapping[str, Mapping[str, str]],
    table_column: str = "table_name",
) -> DataFrame:
    """Rows of the wanted ``tables`` of the documents in column ``text``, in one pass.

    ``tables`` maps a group's name to output columns: ``"group.leaf"`` is a leaf of the
    group or of one above it, ``"#group"`` an element's ordinal within its parent. The
    result holds ``keys`` unchanged, ``table_column`` and the output columns as text
    (null where a table lacks one). Only leaves that are asked for are shredded.
    """
    outs = list(dict.fromkeys(o for cols in tables.values() for o in cols))
    if len({*keys, table_column, *outs}) != len(keys) + 1 + len(outs):
        raise ValueError("keys, table column and outputs must have different names")
    wanted: dict[str, set[str]] = {}
    for cols in tables.values():
        for source in cols.values():
            if not source.startswith("#"):
                g, _, x = source.partition(".")
                wanted.setdefault(g, set()).add(x)
    slim = df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text}`").cast("string").alias("__text")).filter(F.col("__text").isNotNull())
    schema = T.StructType(
        [T.StructField(f.name, f.dataType) for f in slim.schema.fields[:-1]]
        + [T.StructField(table_column, T.StringType())]
        + [T.StructField(o, T.StringType()) for o in outs]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                yield from part(whole.slice(at, 256))

    def part(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        levels = Levels(root, wanted)
        for t in batch.column(batch.num_columns - 1).to_pylist():
            levels.add(t)
        built = {}

        def table_of(name: str) -> dict:
            if name not in built:
                built[name] = rebuild(levels, name)
            return built[name]

        for name, cols in tables.items():
            own = table_of(name)
            n = len(own["record"])
            if not n:
                continue
            take = pa.array(own["record"])
            arrays = [batch.column(i).take(take) for i in range(len(keys))] + [pa.array([name] * n, pa.string())]
            for o in outs:
                source = cols.get(o)
                if source is None:
                    arrays.append(pa.nulls(n, pa.string()))
                elif source.startswith("#"):
                    arrays.append(pa.array(own["ordinal"][source[1:]].astype(str).tolist(), pa.string()))
                else:
                    g, _, x = source.partition(".")
                    values = table_of(g)["values"][x]
                    arrays.append(pa.array([values[i] for i in own["row"][g]] if g != name else values, pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return slim.mapInArrow(run, schema)


def level_columns(df: DataFrame, keys: Sequence[str], text: str, root: Group) -> DataFrame:
    """The shredded form itself: one row per record, leaf path and level sequences.

    Damaged and null records have ``damaged`` set or hold only absent entries.
    """
    slim = df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType(
        [T.StructField(f.name, f.dataType) for f in slim.schema.fields[:-1]]
        + [T.StructField("damaged", T.BooleanType()), T.StructField("leaf_path", T.StringType())]
        + [T.StructField("repetition", T.ArrayType(T.IntegerType())), T.StructField("definition", T.ArrayType(T.IntegerType()))]
        + [T.StructField("leaf_values", T.ArrayType(T.StringType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                record, cols = [], ([], [], [], [], [])
                for i, t in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                    levels = Levels(root)
                    ok = levels.add(t)
                    for (g, x), (v, r, d) in levels.columns.items():
                        record.append(i)
                        path = ".".join(c.name for c in levels.chains[g])
                        for col, value in zip(cols, (not ok, f"{path}.{x}", r, d, v), strict=True):
                            col.append(value)
                take = pa.array(record, pa.int64())
                arrays = [batch.column(i).take(take) for i in range(len(keys))]
                types = (pa.bool_(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()))
                arrays += [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return slim.mapInArrow(run, schema)
