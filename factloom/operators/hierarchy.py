"""Parent-child links to full hierarchies by pointer doubling.

Every node holds a pointer to an ancestor, at first its parent. In each round the pointer of a node is replaced by the
pointer of the node it points to, so that the distance covered doubles. A node is resolved once its pointer leads beyond
a top. Nodes that stay unresolved after logarithmic rounds go round, or lead into a round; what their pointers then lead
to is exactly the nodes on rounds.

Links are placed by their ``keys`` once. The groups of one task are doubled together, as joins of pointer arrays by
position, in chunks of bounded size; the path of a node is put together from the segments that its doubled pointers jump
over. A group with more than ``in_task`` links never is in one task: its rounds are joins of tables, whose segments are
concatenated. Both give the same rows. Without ``keys`` all links are one group.

Defined results for odd input:

* links with a null child or null key are left out; a null parent, or the value given as ``top``, makes the child a top;
* of several different parents of one child the smallest one counts; repeated links count once;
* a parent that has no link of its own is the top of its children and part of their paths, but has no output row;
* nodes on a round, or leading into one, have null path, depth and top, and ``cyclic`` or ``leads_to_cycle`` set;
* an empty table gives an empty result; columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.runtime import cut, small

IN_TASK = 500_000  # links of a group that one task doubles


def clean_links(df: DataFrame, keys: list[str], child: str, parent: str, label: str | None, top: int | str | None) -> DataFrame:
    """All links: ``keys``, ``_node``, ``_up`` (null at a top) and, with a ``label``, ``_label``."""
    up = F.col(parent) if top is None else F.when(F.col(parent) != F.lit(top), F.col(parent))
    name = [F.lower(F.trim(F.col(label))).alias("_label")] if label else []
    return df.select(*keys, F.col(child).alias("_node"), up.cast(df.schema[child].dataType).alias("_up"), *name).dropna(subset=[*keys, "_node"])


def single_links(clean: DataFrame, keys: list[str], place: list[str]) -> DataFrame:
    """One link for each child, where rows of equal ``place`` (columns) are together: ``keys``, ``_node``, ``_up``,
    ``_label``. Grouping needs no other shuffle than that."""
    parts = int(clean.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = clean.repartition(parts, *place)
    if "_label" not in clean.columns:
        return placed.groupBy(*keys, "_node").agg(F.min("_up").alias("_up")).select(*keys, "_node", "_up", F.lit(None).cast("string").alias("_label"))
    least = F.min(F.struct(F.col("_up").isNull().alias("void"), "_up", F.col("_label").isNull().alias("bare"), "_label")).alias("_s")
    return placed.groupBy(*keys, "_node").agg(least).select(*keys, "_node", "_s._up", "_s._label")


def by_size(clean: DataFrame, keys: list[str], in_task: int) -> tuple[DataFrame | None, DataFrame | None]:
    """The links of groups that fit a task, and those of groups that don't (None if there are none)."""
    if not keys:
        return None, clean
    large = cut(clean.groupBy(*keys).count().filter(F.col("count") > in_task).select(*keys))
    if not large.limit(1).count():
        return clean, None
    large = small(large)  # at most one for each in_task links
    return clean.join(large, keys, "left_anti"), clean.join(large, keys, "left_semi")


def chunks(batches: Iterator[pa.RecordBatch], keys: int, rows: int = 300_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups, about ``rows`` rows at a time, with the number of its group for each row. Rows come in order of the
    first ``keys`` columns."""
    held: list[pa.Table] = []
    count = 0

    def first_rows(t: pa.Table) -> np.ndarray:
        new = np.zeros(len(t), bool)
        new[0] = True
        for k in range(keys):
            c = t.column(k).combine_chunks()
            new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        return new

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        count += batch.num_rows
        if count >= rows:
            t = pa.concat_tables(held).combine_chunks()
            new = first_rows(t)
            whole = int(np.flatnonzero(new)[-1])
            if whole:
                yield t.slice(0, whole), np.cumsum(new[:whole]) - 1
            held, count = [t.slice(whole)], len(t) - whole
    if count:
        t = pa.concat_tables(held).combine_chunks()
        yield t, np.cumsum(first_rows(t)) - 1


class Doubled:
    """Pointers of the links of whole groups, doubled until all that can resolve has done so."""

    def __init__(self, group: np.ndarray, node: pa.Array, up: pa.Array) -> None:
        names = pa.chunked_array([node, up]).combine_chunks().dictionary_encode()
        code = pc.fill_null(names.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        n, width = len(node), max(1, len(names.dictionary))
        own, above = group * width + code[:n], np.where(code[n:] < 0, -1, group * width + code[n:])
        order = np.argsort(own, kind="stable")
        place = np.minimum(np.searchsorted(own[order], above), max(n - 1, 0))
        linked = (above >= 0) & (own[order][place] == above)
        self.outside = (above >= 0) & ~linked  # the parent has no link of its own: it is the top
        pointer = np.where(linked, order[place], -1).astype(np.int64)
        self.jumps = [pointer]
        self.depth = (pointer >= 0).astype(np.int64)  # links between the node and the one its pointer leads to
        most = int(np.bincount(group).max()) if n else 0
        while (1 << (len(self.jumps) - 1)) < most and (pointer >= 0).any():
            there = np.flatnonzero(pointer >= 0)
            through = pointer[there]
            self.depth[there] += self.depth[through]
            pointer = pointer.copy()
            pointer[there] = pointer[through]
            self.jumps.append(pointer)
        self.stuck = pointer >= 0
        self.cyclic = np.zeros(n, bool)
        self.cyclic[pointer[self.stuck]] = True

    def segments(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For nodes (none of them stuck): the offsets of their paths and, joined, the nodes of the paths from the
        highest linked one down, by jumps of powers of two."""
        length = self.depth[rows] + 1
        ends = np.cumsum(length)
        at = np.repeat(rows, length)
        away = np.repeat(ends, length) - 1 - np.arange(ends[-1] if len(ends) else 0)
        for k, jump in enumerate(self.jumps):
            step = (away >> k & 1).astype(bool)
            if step.any():
                at[step] = jump[at[step]]
        return np.concatenate([[0], ends]), at


UP = " > "


def _same(keys: list[str], a: str, b: str) -> Column:
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"{a}.{k}") == F.col(f"{b}.{k}"))
    return same


def unresolved(one: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """From ``links``: the nodes on a round, and all nodes that never reach a top, without building paths.

    A node whose pointer has no link among the unresolved ones has reached a top, so resolved nodes are dropped at once
    and every round joins only what is left. ``one`` is read twice in the first round: it should be held.
    """
    state = one.filter(F.col("_up").isNotNull()).select(*keys, "_node", F.col("_up").alias("_ptr"))
    nodes = targets = -1
    while True:
        a, s = state.alias("a"), state.alias("s")
        state = cut(a.join(s, _same(keys, "a", "s") & (F.col("a._ptr") == F.col("s._node"))).select(*[F.col(f"a.{k}") for k in keys], F.col("a._node"), F.col("s._ptr")))
        left = state.count()
        if left == nodes:  # all that can resolve has done so; now the set pointed at shrinks onto the rounds
            now = state.select(*keys, "_ptr").distinct().count()
            if now == targets:
                break
            targets = now
        nodes = left
        if not left:
            break
    return state.select(*keys, F.col("_ptr").alias("_node")).distinct(), state.select(*keys, "_node")


def cycles(df: DataFrame, keys: list[str], child: str, parent: str, top: int | str | None = None, in_task: int = IN_TASK) -> DataFrame:
    """The nodes from which going up leads back to the node itself: ``keys`` and ``child``."""
    fit, large = by_size(clean_links(df, keys, child, parent, None, top), keys, in_task)
    found = None
    if fit is not None:
        rows = single_links(fit, keys, keys).drop("_label").sortWithinPartitions(*keys)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t, group in chunks(batches, len(keys)):
                cyclic = Doubled(group, t["_node"].combine_chunks(), t["_up"].combine_chunks()).cyclic
                yield from t.drop_columns(["_up"]).filter(pa.array(cyclic)).to_batches()

        found = rows.mapInArrow(run, rows.drop("_up").schema)
    if large is not None:
        one = single_links(large, keys, [*keys, "_node"]).drop("_label").persist()
        rounds = unresolved(one, keys)[0]  # what this gives no longer depends on what is held
        one.unpersist()
        found = rounds if found is None else found.unionByName(rounds)
    return found.withColumnRenamed("_node", child)


def resolve(df: DataFrame, keys: list[str], child: str, parent: str, label: str | None = None, top: int | str | None = None, in_task: int = IN_TASK) -> DataFrame:
    """One row for each child: ``keys``, ``child``, ``path`` (array from the top down to the child), ``labels`` (of the
    links along it), ``depth``, ``top``, ``cyclic``, ``leads_to_cycle``."""
    fit, large = by_size(clean_links(df, keys, child, parent, label, top), keys, in_task)
    found = _resolve_in_tasks(fit, keys, child) if fit is not None else None
    if large is not None:
        joined = _resolve_joined(large, keys, child)
        found = joined if found is None else found.unionByName(joined)
    return found


def _resolve_in_tasks(clean: DataFrame, keys: list[str], child: str, entries: int = 500_000) -> DataFrame:
    """Paths are given out ``entries`` nodes at a time, however long a path is."""
    rows = single_links(clean, keys, keys).sortWithinPartitions(*keys)
    kind = clean.schema["_node"].dataType.simpleString()
    heads = ", ".join(f"`{k}` {clean.schema[k].dataType.simpleString()}" for k in keys)
    out = f"{heads}, `{child}` {kind}, path array<{kind}>, labels array<string>, depth int, top {kind}, cyclic boolean, leads_to_cycle boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in chunks(batches, len(keys)):
            node, up = t["_node"].combine_chunks(), t["_up"].combine_chunks()
            label = pc.fill_null(t["_label"].combine_chunks(), "")
            d = Doubled(group, node, up)
            length = np.where(d.stuck, 0, d.depth + 1)
            pieces = np.searchsorted(np.cumsum(length), np.arange(entries, length.sum() + 1, entries))
            for lo, hi in zip([0, *pieces], [*pieces, len(t)]):
                if lo == hi:
                    continue
                every = np.arange(lo, hi)
                free = every[~d.stuck[lo:hi]]
                ends, at = d.segments(free)
                first = at[ends[:-1]]
                # a top without a link of its own stands before the linked ones
                extra = d.outside[first]
                below = ends[:-1] + np.cumsum(extra) - extra
                full = np.empty(len(at) + int(extra.sum()), np.int64)
                is_top = np.zeros(len(full), bool)
                is_top[below[extra]] = True
                full[~is_top] = at
                full[is_top] = len(t) + first[extra]
                offsets = np.concatenate([ends[:-1] + np.cumsum(extra) - extra, [len(full)]])
                names = pa.concat_arrays([node, up])
                path = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), names.take(pa.array(full)))
                labels = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), label.take(pa.array(at)))
                where = np.full(hi - lo, -1, np.int64)
                where[free - lo] = np.arange(len(free))
                pick = pa.array(where, mask=where < 0)
                depth = pa.array(np.diff(offsets) - 1, pa.int32())
                tops = names.take(pa.array(full[offsets[:-1]]))
                part = t.slice(lo, hi - lo).combine_chunks()
                columns = [*(part[k].combine_chunks() for k in keys), part["_node"].combine_chunks(), path.take(pick), labels.take(pick), depth.take(pick), tops.take(pick), pa.array(d.cyclic[lo:hi]), pa.array(d.stuck[lo:hi] & ~d.cyclic[lo:hi])]
                yield pa.RecordBatch.from_arrays(columns, [*keys, child, "path", "labels", "depth", "top", "cyclic", "leads_to_cycle"])

    return rows.mapInArrow(run, out)


def _resolve_joined(clean: DataFrame, keys: list[str], child: str) -> DataFrame:
    """``resolve`` by joins of tables, for groups too large for a task."""
    one = cut(single_links(clean, keys, [*keys, "_node"]))
    rounds, stuck = unresolved(one, keys)
    kind = stuck.join(rounds.withColumn("_on", F.lit(True)), [*keys, "_node"], "left").select(*keys, "_node", F.coalesce("_on", F.lit(False)).alias("_on"))
    free = one.join(stuck, [*keys, "_node"], "left_anti")
    step = cut(
        free.select(
            *keys, "_node", F.col("_up").alias("_ptr"),
            F.when(F.col("_up").isNull(), F.array("_node")).otherwise(F.array("_up", "_node")).alias("_path"),
            F.array(F.coalesce("_label", F.lit(""))).alias("_labels"),
        )
    )
    resolved = step.filter("_ptr IS NULL")
    active = step.filter("_ptr IS NOT NULL")
    while active.limit(1).count():  # what is resolved is written once; only what is still pointed at is looked up
        wanted = active.select(*keys, F.col("_ptr").alias("_node")).distinct()
        a, s = active.alias("a"), resolved.unionByName(active).join(wanted, [*keys, "_node"], "left_semi").alias("s")
        step = cut(
            a.join(s, _same(keys, "a", "s") & (F.col("a._ptr") == F.col("s._node")), "left").select(
                *[F.col(f"a.{k}") for k in keys], F.col("a._node"), F.col("s._ptr"),
                F.coalesce(F.concat(F.slice(F.col("s._path"), 1, F.greatest(F.size("s._path") - 1, F.lit(0))), F.col("a._path")), F.col("a._path")).alias("_path"),
                F.coalesce(F.concat(F.col("s._labels"), F.col("a._labels")), F.col("a._labels")).alias("_labels"),
            )
        )
        resolved = resolved.unionByName(step.filter("_ptr IS NULL"))
        active = step.filter("_ptr IS NOT NULL")
    done = resolved.select(*keys, F.col("_node").alias(child), F.col("_path").alias("path"), F.col("_labels").alias("labels"), (F.size("_path") - 1).alias("depth"), F.element_at("_path", 1).alias("top"), F.lit(False).alias("cyclic"), F.lit(False).alias("leads_to_cycle"))
    return done.unionByName(kind.select(*keys, F.col("_node").alias(child), F.col("_on").alias("cyclic"), (~F.col("_on")).alias("leads_to_cycle")), allowMissingColumns=True)


def descendants(resolved: DataFrame, keys: list[str], child: str) -> DataFrame:
    """From ``resolve``: one row for each pair of an ancestor and a node below it: ``keys``, ``ancestor``,
    ``descendant``, ``distance``. Rows, not arrays: what lies below a node is not bounded."""
    over = resolved.filter("depth > 0").select(*keys, F.col(child).alias("descendant"), "depth", F.posexplode(F.slice("path", 1, F.col("depth"))).alias("_at", "ancestor"))
    return over.select(*keys, "ancestor", "descendant", (F.col("depth") - F.col("_at")).alias("distance"))
