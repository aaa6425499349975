"""Deeply nested records to related flat tables.

Each record is parsed as a stream of tokens into path-value-ordinal triples: the names on the way down, the leaf, and the
positions in all arrays (or the keys of all objects with free keys) passed. Triples are grouped by their repeated
ancestor, and every group is pivoted into one row of the table of its path, all within the task that reads the record:
nothing is shuffled. Tables need not be named beforehand: each path at which objects stand is a table, in which a row
keeps the ordinals of all its ancestors, so it can be joined with the rows above and below it.

Depth has no limit: the parser holds a stack of its own. A record's rows are given out once its text has proved valid.

Defined results for odd input: names are compared without case and without characters other than letters and digits;
wrapper objects around the record's parts are passed through; a lone object where an array is usual has position 0; an
object whose first name is a number has free keys, as have the paths that a wanted table marks with '*'; array items that
are no objects are rows of a table of their own (the array's path and '/=') with the leaf '='; arrays directly in an array
add the step '#' and an ordinal, a top-level array only an ordinal; null, empty or missing parts give no rows; of a name
twice in one object both parts are walked and the last leaf counts; text that is not valid JSON (NaN and Infinity
included) and null text give no rows, and are listed by ``unparsable``. Repeated input rows give repeated output rows
unless ``id_col`` is passed through ``once`` before. Numbers are given as written, a leaf that is an object or an array
as its JSON text.
"""

from __future__ import annotations

import gc
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from json.decoder import JSONDecodeError, scanstring

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.runtime import cut, small


@dataclass(frozen=True)
class Nested:
    """A table made of the objects at ``path``: names joined by '/', '*' for the keys of an object with free keys.

    ``columns`` are the leaves to keep; with none, only the place of each object is given.
    """

    kind: str
    path: str
    columns: tuple[str, ...] = field(default=())


class Invalid(ValueError):
    """The text is not valid JSON."""


_SPACE = r"[ \t\n\r]*"
_PLAIN = r'"([^"\\\x00-\x1f]*)"'
_SCALAR = rf"(?:{_PLAIN}|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(true|false|null))"
_ws = re.compile(_SPACE).match
_member = re.compile(rf"{_SPACE}{_PLAIN}{_SPACE}:{_SPACE}{_SCALAR}{_SPACE}([,}}])").match  # most of a record, in one step
_bare = r'"[^"\\\x00-\x1f]*"'
_pair = rf"{_SPACE}{_bare}{_SPACE}:{_SPACE}(?:{_bare}|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null){_SPACE}"
_leaf_object = re.compile(rf"\{{(?:{_pair},)*+{_pair}\}}").match  # an object that holds leaves only
_leaves = re.compile(rf"{_PLAIN}{_SPACE}:{_SPACE}(?:{_PLAIN}|([^\s,}}\"]+))").findall  # of an object known to be valid
_colon = re.compile(rf"{_SPACE}:{_SPACE}").match
_scalar = re.compile(_SCALAR).match
_free = re.compile(rf'\{{{_SPACE}"[0-9]+"{_SPACE}:').match
LITERAL = {"true": "true", "false": "false", "null": None}


def plain(name: str) -> str:
    return re.sub(r"[\W_]", "", name).lower()


class Step:
    """A path: its name, what is above it, and what has been seen below."""

    __slots__ = ("name", "up", "below", "leaf", "kind", "columns", "free", "live")

    def __init__(self, name: str, up: Step | None, live: bool) -> None:
        self.name, self.up, self.live = name, up, live
        self.below: dict[str, Step] = {}
        self.leaf: dict[str, str | None] = {}
        self.kind: str | None = None
        self.columns: dict[str, str] | None = None
        self.free = False

    def path(self) -> str:
        names, at = [], self
        while at.up is not None:
            names.append(at.name)
            at = at.up
        return "/".join(reversed(names))


class Shredder:
    """Turns a record into rows. With ``tables``, of these only; without, of every path found, whole."""

    def __init__(self, tables: list[Nested] | None, wrappers: tuple[str, ...], free: tuple[str, ...] = ()) -> None:
        self.every, self.wrappers, self.free = tables is None, frozenset(map(plain, wrappers)), free
        self.tables = tables or []
        self.start()

    def start(self) -> None:
        self.known = 0
        self.root = Step("", None, True)
        self.dead = Step("", None, False)
        for t in self.tables:
            at = self.root
            for name in t.path.split("/"):
                if name == "*":
                    at.free = True
                key = name if name == "*" else plain(name)
                at = at.below.setdefault(key, Step(key, at, True))
            at.kind, at.columns = t.kind, {plain(c): c for c in t.columns}
        if self.every:
            self.root.kind = ""
            for path in self.free:
                at = self.root
                for name in path.split("/"):
                    at = at.below.setdefault(plain(name), Step(plain(name), at, True))
                    at.kind = at.path()
                at.free = True

    def child(self, step: Step, raw: str) -> Step:
        """The path of a name below ``step``."""
        if (found := step.below.get(raw)) is not None:
            return found
        if not step.live:
            return self.dead
        key = "*" if step.free else raw if raw in ("#", "=") else plain(raw)
        if step is self.root and key in self.wrappers:
            found = step
        elif (found := step.below.get(key)) is None:
            if not self.every:
                found = self.dead
            else:
                found = Step(key, step, True)
                found.kind = found.path()
                step.below[key] = found
        self.known += 1
        if not step.free:  # free keys are not held: there may be any number of them
            step.below[raw] = found
        return found

    def leaf(self, step: Step, raw: str) -> str | None:
        """The column of a leaf, None if it isn't wanted."""
        key = plain(raw)
        found = key if step.columns is None and step.live else (step.columns or {}).get(key)
        self.known += 1
        step.leaf[raw] = found
        return found

    def rows(self, text: str | None) -> list[tuple[str, tuple, dict]]:
        """(table, ordinals, leaves) of all objects of a record; none for null text. Raises Invalid."""
        if text is None:
            return []
        if self.known > 200_000:
            self.start()
        try:
            return self._rows(text)
        except (JSONDecodeError, IndexError) as e:
            raise Invalid(str(e)) from e

    def _rows(self, text: str) -> list[tuple[str, tuple, dict]]:
        out: list[tuple[str, tuple | None, dict]] = []
        child, dead = self.child, self.dead
        stack: list[tuple] = []
        # the container that is open: its path, the ordinals (as a chain of pairs), whether it is an object, its leaves,
        # how many items it had, and, where it is a wanted leaf itself, whose and where it begins
        step, at, is_object, leaves, index, held = self.root, None, False, None, 0, None
        pos = _ws(text, 0).end()
        first = text[pos]
        if first not in "{[":
            m = _scalar(text, pos)
            end = m.end() if m else scanstring(text, pos + 1)[1] if first == '"' else -1
            if end < 0 or _ws(text, end).end() != len(text):
                raise Invalid
            return []
        opening, fresh = first, True
        while True:
            closed = False
            if opening:  # at an opening bracket, of a container for which step, at and held are set
                is_object = opening == "{"
                fresh, index = True, 0
                if is_object:
                    m = _leaf_object(text, pos)
                    if m is None:
                        leaves = {}
                        if step.kind is not None:
                            out.append((step.kind, at, leaves))
                    else:
                        if step.kind is not None:
                            names, found = step.leaf, _leaves(text, pos, m.end())
                            try:
                                leaves = {names[raw]: value if not other else None if other == "null" else other for raw, value, other in found}
                            except KeyError:
                                leaves = {self.leaf(step, raw): value if not other else None if other == "null" else other for raw, value, other in found}
                            if None in leaves:
                                del leaves[None]
                            out.append((step.kind, at, leaves))
                        pos = m.end() - 1
                        closed = True
                opening = ""
                pos += 1
            if closed:
                pass
            elif is_object:
                m = _member(text, pos)
                if m is not None:
                    raw, value, number, literal, end = m.groups()
                    if step.live and step.kind is not None:
                        name = step.leaf[raw] if raw in step.leaf else self.leaf(step, raw)
                        if name is not None:
                            leaves[name] = value if value is not None else number if number is not None else LITERAL[literal]
                    pos = m.end()
                    fresh = False
                    if end == ",":
                        continue
                    closed = True
                else:
                    pos = _ws(text, pos).end()
                    if text[pos] == "}" and fresh:
                        pos += 1
                        closed = True
                    elif text[pos] != '"':
                        raise Invalid
                    else:
                        raw, pos = scanstring(text, pos + 1)
                        m = _colon(text, pos)
                        if m is None:
                            raise Invalid
                        pos = m.end()
                        fresh = False
                        c = text[pos]
                        name = None
                        if step.live and step.kind is not None:
                            name = step.leaf[raw] if raw in step.leaf else self.leaf(step, raw)
                        if c in "{[":
                            below = child(step, raw)
                            stack.append((step, at, True, leaves, index, held))
                            held = (leaves, name, pos) if name is not None else None
                            if step.free and below is not dead and below.live:
                                at = (at, raw)
                            if c == "{" and below.live and below is not self.root and not below.free:
                                if self.every and _free(text, pos):
                                    below.free = True
                                else:
                                    at = (at, 0)
                            step, opening = below, c
                            continue
                        value, pos = self._value(text, pos, c)
                        if name is not None:
                            leaves[name] = value
            else:
                c = text[pos]
                if c in " \t\n\r":
                    pos = _ws(text, pos).end()
                    c = text[pos]
                if c == "]" and fresh:
                    pos += 1
                    closed = True
                elif c in "{[":
                    fresh = False
                    stack.append((step, at, False, None, index, held))
                    held = None
                    if step.live:
                        at = (at, index)
                        if c == "[":
                            step = child(step, "#")
                    opening = c
                    continue
                else:
                    fresh = False
                    value, pos = self._value(text, pos, c)
                    if self.every and step.live:
                        kind = child(step, "=").kind
                        out.append((kind, (at, index), {"=": value}))
            while True:  # after a value
                if closed:
                    if held is not None:
                        held[0][held[1]] = text[held[2] : pos]
                    if not stack:
                        if _ws(text, pos).end() != len(text):
                            raise Invalid
                        return [(kind, _flat(chain), found) for kind, chain, found in out]
                    step, at, is_object, leaves, index, held = stack.pop()
                end = text[pos]
                if end in " \t\n\r":
                    pos = _ws(text, pos).end()
                    end = text[pos]
                pos += 1
                if end == ",":
                    index += 1
                    fresh = False
                    break
                if end != ("}" if is_object else "]"):
                    raise Invalid
                closed = True

    @staticmethod
    def _value(text: str, pos: int, first: str) -> tuple[str | None, int]:
        if first == '"':
            return scanstring(text, pos + 1)
        m = _scalar(text, pos)
        if m is None:
            raise Invalid
        return (m.group(2) if m.group(2) is not None else LITERAL[m.group(3)]), m.end()


def _flat(chain: tuple | None) -> tuple:
    if chain is not None and (chain[0] is None or chain[0][0] is None):  # the usual depths
        return (chain[1],) if chain[0] is None else (chain[0][1], chain[1])
    out = []
    while chain is not None:
        chain, ordinal = chain
        out.append(ordinal)
    out.reverse()
    return tuple(out)


def _strings(values: list) -> pa.Array:
    """Texts as a column; half of a surrogate pair becomes a question mark."""
    try:
        return pa.array(values, pa.string())
    except (UnicodeEncodeError, pa.ArrowInvalid):
        return pa.array([None if v is None else v.encode("utf-8", "replace").decode("utf-8") for v in values], pa.string())


def _lists(sizes: list[int]) -> pa.Array:
    return pa.array([0, *itertools.accumulate(sizes)], pa.int32())


def _batch(ids: pa.Array, found: list[tuple[str, tuple, dict]], leaves: bool) -> pa.RecordBatch:
    kinds, places, values = zip(*found)
    texts = [[x if x.__class__ is str else str(x) for x in p] for p in places]
    columns = [
        ids, pa.array(kinds, pa.string()), pa.ListArray.from_arrays(_lists(map(len, texts)), _strings([x for t in texts for x in t])),
        _strings([t[-2] if len(t) > 1 else None for t in texts]), pa.array([p[-1] if p and p[-1].__class__ is int else 0 for p in places], pa.int32()),
    ]
    names = ["id", "kind", "ordinals", "parent", "child"]
    if leaves:
        columns.append(pa.MapArray.from_arrays(_lists(map(len, values)), _strings([k for v in values for k in v]), _strings([x for v in values for x in v.values()])))
        names.append("leaves")
    return pa.RecordBatch.from_arrays(columns, names)


def shred(df: DataFrame, id_col: str, json_col: str, tables: list[Nested] | None = None, wrappers: tuple[str, ...] = ("result",), free: tuple[str, ...] = (), leaves: bool = True) -> DataFrame:
    """Rows ``id_col``, ``kind``, ``ordinals`` (of all repeated ancestors and its own, as text), ``parent`` (position or
    key of the ancestor just above), ``child`` (own position) and, with ``leaves``, their map of column to text. Without
    ``tables``, rows of every table found; its kind is then its path. ``free``: paths whose objects have free keys,
    whether they are numbers or not."""
    id_type = df.schema[id_col].dataType
    arrow_id = pa.int64() if id_type.simpleString() in ("bigint", "int", "smallint", "tinyint") else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shredder = Shredder(tables, wrappers, free)
        gc.disable()  # rows are many and hold no cycles
        try:
            yield from shredded(shredder, batches)
        finally:
            gc.enable()

    def shredded(shredder: Shredder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: list = []
            rows: list = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    found = shredder.rows(text)
                except Invalid:
                    continue
                ids += [key] * len(found)
                rows += found
                if len(ids) > 50_000:
                    yield _batch(pa.array(ids, arrow_id), rows, leaves)
                    ids, rows = [], []
            if ids:
                yield _batch(pa.array(ids, arrow_id), rows, leaves)

    spark_id = "bigint" if arrow_id == pa.int64() else "string"
    out = f"id {spark_id}, kind string, ordinals array<string>, parent string, child int" + (", leaves map<string,string>" if leaves else "")
    narrow = df.select(F.col(id_col).cast(spark_id), json_col).filter(F.col(json_col).isNotNull())
    return narrow.mapInArrow(run, out).withColumnRenamed("id", id_col)


def table_of(rows: DataFrame, id_col: str, nested: Nested) -> DataFrame:
    """The flat table of one kind from ``shred``'s rows."""
    return rows.filter(F.col("kind") == nested.kind).select(id_col, "parent", "child", *[F.col("leaves")[c].alias(c) for c in nested.columns])


def tables_of(rows: DataFrame) -> DataFrame:
    """The tables found by ``shred``: ``kind``, ``n_rows`` and the sorted names of its ``columns``."""
    named = rows.select("kind", F.map_keys("leaves").alias("names"))
    columns = named.select("kind", F.explode("names").alias("name")).distinct().groupBy("kind").agg(F.array_sort(F.collect_list("name")).alias("columns"))
    return named.groupBy("kind").agg(F.count("*").alias("n_rows")).join(columns, "kind", "left").select("kind", "n_rows", F.coalesce("columns", F.array().cast("array<string>")).alias("columns"))


def once(df: DataFrame, id_col: str, order: str) -> DataFrame:
    """One row for each id, the one with the smallest ``order``; ids sent again are rare, so only theirs are ranked.

    Only ids are shuffled to find those that occur again; these are broadcast if they are few. Where they are many, all
    rows are placed by id and ranked, in one shuffle. Rows with a null id are left out.
    """
    again = cut(df.groupBy(id_col).agg(F.count("*").alias("_n")).filter(f"_n > 1 AND `{id_col}` IS NOT NULL").select(id_col))
    first = Window.partitionBy(id_col).orderBy(order)
    ranked = lambda rows: rows.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")
    few = small(again)
    if few is again:
        return ranked(df.filter(F.col(id_col).isNotNull()))
    return df.filter(F.col(id_col).isNotNull()).join(few, id_col, "left_anti").unionByName(ranked(df.join(few, id_col, "left_semi")))


def unparsable(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """The ids whose text is not valid JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        check = Shredder([], ())

        def bad(text: str | None) -> bool:
            try:
                return text is None or check.rows(text) is None
            except Invalid:
                return True

        for batch in batches:
            yield pa.record_batch([pa.array([k for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if bad(t)], batch.schema.field(0).type)], names=[id_col])

    return df.select(id_col, json_col).mapInArrow(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}")
