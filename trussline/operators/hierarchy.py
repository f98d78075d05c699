"""Parent-child rows to full hierarchies: path, depth, root, nodes below, and cycles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trussline.operators.common import cut, hot_values, key_of, one_of, salted_join, sketch

#: Components up to this many nodes are walked in one task; larger ones by joins.
MAX_COMPONENT = 200_000
#: Nodes walked per call of the kernel, which holds whole components only.
CHUNK = 50_000
#: Path members that a batch of results holds, about.
MEMBERS = 500_000

RESULT = "id string, parent string, root string, depth int, path array<string>, cycle_id string, on_cycle boolean"


def links_of(rows: DataFrame, node: str, parent: str) -> DataFrame:
    """One row per node: ``id`` and ``parent``, null if blank or without a record.

    Of repeated rows with different parents the latest ``loaded_at`` counts, then the
    greatest parent. Rows without a node id are no nodes.
    """
    raw = rows.select(key_of(node).alias("id"), key_of(parent).alias("parent"), *(["loaded_at"] if "loaded_at" in rows.columns else [F.lit(None).cast("timestamp").alias("loaded_at")]))
    nodes = raw.where(F.col("id").isNotNull()).groupBy("id").agg(F.max(F.struct("loaded_at", "parent"))["parent"].alias("parent"))
    hot = hot_values(raw, ["parent"])["parent"]
    there = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("_there"))
    joined = salted_join(nodes, there, ["parent"], one_of("parent", hot), F.col("id"))
    return joined.select("id", F.when(F.col("_there"), F.col("parent")).alias("parent"))


def components(links: DataFrame) -> DataFrame:
    """``links`` with ``comp``: the root of a node's tree, or the smallest id on its cycle.

    Pointer doubling: a node's pointer doubles its reach each round, so a chain of depth d
    takes log2(d) rounds. Nodes whose pointer has come to a root leave the moving set. When a
    round settles nobody, all that still move are on cycles or below (depths are contiguous).
    They go on until each node pointed at has seen the same least id as the one that it points
    at: then all along its pointers the same least id was seen, which on a cycle is that of the
    whole cycle.
    """
    state = cut(links.select("id", "parent", F.coalesce("parent", "id").alias("top"), F.col("parent").isNull().alias("done"), F.col("id").alias("low")))
    active = state.where("not done")
    (moving, hot), cyclic = sketch(active, ["top"]), False
    while moving and not (cyclic and _all_round(active)):
        ahead = (active if cyclic else state).select(F.col("id").alias("top"), F.col("top").alias("_top"), F.col("done").alias("_done"), F.col("low").alias("_low"))
        met = salted_join(active, ahead, ["top"], one_of("top", hot["top"]), F.col("id"), "inner")
        stepped = met.select("id", "parent", F.col("_top").alias("top"), F.col("_done").alias("done"), F.least("low", "_low").alias("low"))
        if cyclic:  # what settled stays where it is
            active = cut(stepped)
        else:
            state = cut(stepped.unionByName(state.where("done")))
            active = state.where("not done")
        left, hot = sketch(active, ["top"])
        cyclic, moving = cyclic or left == moving, left
    state = state.where("done").unionByName(active)
    if not moving:
        return state.select("id", "parent", F.col("top").alias("comp"), F.lit(False).alias("cyclic"))
    loops = state.where("not done")
    ends = loops.select(F.col("id").alias("top"), F.col("low").alias("comp"))
    found = salted_join(loops.drop("low"), ends, ["top"], one_of("top", hot["top"]), F.col("id"), "inner")
    return state.where("done").select("id", "parent", F.col("top").alias("comp"), F.lit(False).alias("cyclic")).unionByName(found.select("id", "parent", "comp", F.lit(True).alias("cyclic")))


def _all_round(active: DataFrame) -> bool:
    """Whether every node pointed at saw the least id that the node it points at saw."""
    seen = active.select("top").distinct().withColumnRenamed("top", "id").join(active.select("id", "top", "low"), "id")
    ahead = active.select(F.col("id").alias("top"), F.col("low").alias("_low"))
    return seen.join(ahead, "top").where("low <> _low").isEmpty()


def walk(ids: list[str], parents: list[str | None]) -> Iterator[tuple]:
    """Depth-first walk with node colours; a row of :data:`RESULT` for each node.

    White nodes are unseen, grey ones on the current walk towards the parents, black ones
    finished. Meeting a grey node closes a back edge: the grey walk from there on is a cycle.
    Then the trees are walked down from their roots; only the current path is held.
    """
    at = {x: i for i, x in enumerate(ids)}
    up = [-1 if p is None else at[p] for p in parents]
    colour, on = bytearray(len(ids)), bytearray(len(ids))
    cycle: list[str | None] = [None] * len(ids)
    below: dict[int, list[int]] = {}
    for first in range(len(ids)):
        stack, x = [], first
        while x >= 0 and colour[x] == 0:
            colour[x] = 1
            stack.append(x)
            x = up[x]
        if x >= 0 and colour[x] == 1:
            loop = stack[stack.index(x) :]
            name = min(ids[y] for y in loop)
            for y in loop:
                cycle[y], on[y], colour[y] = name, 1, 2
            stack = stack[: len(stack) - len(loop)]
        for y in reversed(stack):
            colour[y] = 2
            if up[y] >= 0:
                cycle[y] = cycle[up[y]]
                if cycle[y] is None:
                    below.setdefault(up[y], []).append(y)
    for root in range(len(ids)):
        if cycle[root] is not None:
            yield ids[root], parents[root], None, None, None, cycle[root], bool(on[root])
        elif up[root] < 0:
            path: list[str] = []
            todo = [(root, 0)]
            while todo:
                y, depth = todo.pop()
                del path[depth:]
                path.append(ids[y])
                yield ids[y], parents[y], path[0], depth, path[:], None, False
                todo += [(z, depth + 1) for z in below.get(y, ())]


def _walk_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks whole components; rows come sorted by component."""
    types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.bool_()]
    names = ["id", "parent", "root", "depth", "path", "cycle_id", "on_cycle"]

    def done(ids: list[str], parents: list[str | None]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        members = 0
        for row in walk(ids, parents):
            rows.append(row)
            members += 1 + len(row[4] or ())
            if members >= MEMBERS or len(rows) >= 10_000:
                yield batch_of(rows)
                rows, members = [], 0
        if rows:
            yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    ids: list[str] = []
    parents: list[str | None] = []
    last = None
    for batch in batches:
        for i, p, c in zip(*[batch.column(n).to_pylist() for n in ("id", "parent", "comp")], strict=True):
            if c != last and len(ids) >= CHUNK:
                yield from done(ids, parents)
                ids, parents = [], []
            ids.append(i)
            parents.append(p)
            last = c
    if ids:
        yield from done(ids, parents)


def hierarchy(rows: DataFrame, node: str, parent: str, max_component: int = MAX_COMPONENT) -> DataFrame:
    """One row per node: id, parent, root, depth, path from the root, cycle_id, on_cycle.

    A node whose parent is blank or has no record is a root at depth 0. A node whose parents
    never end has null root, depth and path; ``cycle_id`` is the smallest id on its cycle.
    Connected components are found first and co-located, then walked depth first. Components
    of more than ``max_component`` nodes are not put into one task: their paths are joined by
    pointer doubling instead, with the same result.
    """
    return _placed(cut(components(links_of(rows, node, parent))), max_component)


def _placed(comps: DataFrame, max_component: int) -> DataFrame:
    """The rows of :data:`RESULT` for nodes with their components, by walks or by joins."""
    large = cut(comps.groupBy("comp").count().where(F.col("count") > max_component).select("comp", F.lit(True).alias("_large")))
    some = not large.isEmpty()
    # Every large component is hot; together they are a max_component-th of the nodes at most.
    marked = cut(salted_join(comps, large, ["comp"], None, F.col("id"))) if some else comps
    small = (marked.where("_large is null") if some else comps).select("id", "parent", "comp")
    walked = small.repartition("comp").sortWithinPartitions("comp").mapInArrow(_walk_components, RESULT)
    return walked.unionByName(doubled(marked.where("_large").drop("_large"))) if some else walked


def doubled(comps: DataFrame) -> DataFrame:
    """The same rows for components of any size, by joins alone."""
    trees = comps.where("not cyclic").select("id", "parent", "comp", F.array("id").alias("path"), F.col("parent").alias("next"))
    state = cut(trees)
    while not (active := state.where("next is not null")).isEmpty():
        ahead = state.select(F.col("id").alias("next"), F.col("path").alias("_path"), F.col("next").alias("_next"))
        hot = hot_values(active, ["next"])["next"]
        met = salted_join(active, ahead, ["next"], one_of("next", hot), F.col("id"), "inner")
        state = cut(met.select("id", "parent", "comp", F.concat("_path", "path").alias("path"), F.col("_next").alias("next")).unionByName(state.where("next is null")))
    out = state.select("id", "parent", F.element_at("path", 1).alias("root"), (F.size("path") - 1).alias("depth"), "path", F.lit(None).cast("string").alias("cycle_id"), F.lit(False).alias("on_cycle"))
    loops = comps.where("cyclic").select("id", "parent", "comp")
    if loops.isEmpty():
        return out
    on = _on_cycle(loops)
    return out.unionByName(loops.join(on, "id", "left").select("id", "parent", F.lit(None).cast("string").alias("root"), F.lit(None).cast("int").alias("depth"), F.lit(None).cast("array<string>").alias("path"), F.col("comp").alias("cycle_id"), F.coalesce("_on", F.lit(False)).alias("on_cycle")))


def _on_cycle(loops: DataFrame) -> DataFrame:
    """Nodes that are some node's far ancestor: after as many steps as there are nodes, all on cycles."""
    n = loops.count()
    step = loops.select("id", F.col("parent").alias("far"))
    for _ in range(max(1, math.ceil(math.log2(n + 1)))):
        hot = hot_values(step, ["far"])["far"]
        step = cut(salted_join(step, step.select(F.col("id").alias("far"), F.col("far").alias("_far")), ["far"], one_of("far", hot), F.col("id"), "inner").select("id", F.col("_far").alias("far")))
    return step.select(F.col("far").alias("id"), F.lit(True).alias("_on")).distinct()


def descendants(tree: DataFrame) -> DataFrame:
    """(id, below_id, levels): every node below each node that has a root, one row per pair.

    The pairs are as many as the paths have members; no node's pairs are gathered in one row.
    Nodes on or below a cycle have no path; :func:`below_cycles` gives theirs.
    """
    return tree.select(F.posexplode("path").alias("at", "id"), F.col("id").alias("below_id"), "depth").where("id <> below_id").select("id", "below_id", (F.col("depth") - F.col("at")).alias("levels"))


def below_cycles(tree: DataFrame, max_component: int = MAX_COMPONENT) -> DataFrame:
    """(id, below_id, levels) for the nodes on or below a cycle, one row per pair.

    Each node is below all nodes of the walk up its parents, which ends when the cycle has been
    gone round once; ``levels`` are the steps to the first meeting. So the nodes of one cycle
    are all below each other, and none is below itself.

    Without the parent of its smallest id, a cycle and all below it form a tree, whose paths
    hold the ancestors up to that id. Behind it follow the nodes of the cycle that the path
    lacks, one at depth d of the tree as many steps away as the cycle's length is above d.
    """
    loops = cut(tree.where(F.col("cycle_id").isNotNull()).select("id", "parent", "cycle_id", "on_cycle"))
    links = loops.select("id", F.when(F.col("id") != F.col("cycle_id"), F.col("parent")).alias("parent"), F.col("cycle_id").alias("comp"), F.lit(False).alias("cyclic"))
    opened = cut(_placed(links, max_component).select("id", F.col("root").alias("cycle_id"), "depth", "path"))
    on = opened.join(loops.where("on_cycle").select("id"), "id").select("cycle_id", F.col("id").alias("_id"), F.col("depth").alias("_at"))
    ring = on.join(on.groupBy("cycle_id").agg(F.count(F.lit(1)).cast("int").alias("_round")), "cycle_id")
    hot = hot_values(opened, ["cycle_id"])["cycle_id"]
    met = salted_join(opened, ring, ["cycle_id"], one_of("cycle_id", hot), F.col("id"), "inner")
    behind = met.where(~F.get("path", F.col("_at")).eqNullSafe(F.col("_id")))
    return descendants(opened).unionByName(behind.select(F.col("_id").alias("id"), F.col("id").alias("below_id"), (F.col("depth") - F.col("_at") + F.col("_round")).alias("levels")))


def all_below(tree: DataFrame, max_component: int = MAX_COMPONENT) -> DataFrame:
    """(id, below_id, levels): every node below each node, in trees and around cycles."""
    return descendants(tree).unionByName(below_cycles(tree, max_component))
