"""Parent-child links to whole hierarchies: root, depth, path and descendants of each node.

The nodes of a page are cut into fragments of ``chunk`` neighbouring positions. Inside a fragment, parent chains are
contracted by pointer doubling to the fragment's exits: the top nodes whose parent lies in another fragment. The nodes that
such exits point to make up a smaller forest, the quotient, which is solved in the same way with fragments ``FAN`` times as long,
until no chain leaves its fragment; then the answers are handed down again and fragment paths are expanded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.plans.session import written

#: Neighbouring positions that make a fragment, and how many fragments of one level make a fragment of the next.
CHUNK, FAN = 32, 64
#: Fragments of a page's nodes that have no position.
PLACELESS = 4096
CYCLE = "cycle"


def _codes(*columns: pa.Array) -> list[np.ndarray]:
    """The same small integers for the same strings in all columns, in the order of the strings, -1 for null."""
    both = pa.chunked_array([c.cast(pa.string()) for c in columns]).combine_chunks()
    if isinstance(both, pa.ChunkedArray):
        both = pa.concat_arrays(both.chunks) if both.num_chunks else pa.array([], pa.string())
    coded = both.dictionary_encode()
    rank = np.empty(len(coded.dictionary) + 1, np.int64)
    rank[pa.compute.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(coded.dictionary))
    rank[-1] = -1
    idx = rank[coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)]
    cuts = np.cumsum([len(c) for c in columns])[:-1]
    return np.split(idx, cuts)


def _climb(parent: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """For each node the top of its chain, the sums of the weights on the way below it, and whether there is no top (a cycle). parent: -1 for none."""
    n = len(parent)
    top = parent < 0
    up = np.where(top, np.arange(n), parent)
    sums = [np.where(top, 0, w).astype(np.int64) for w in weights]
    step = 1
    while step < 2 * n and not top[up].all():
        sums = [s + s[up] for s in sums]
        up = up[up]
        step *= 2
    return up, sums, ~top[up]


def _segments(parent: np.ndarray, lost: np.ndarray, own: list) -> list:
    """Each node's own segment behind those of its ancestors, top first."""
    out: list = [None] * len(own)
    for i in range(len(own)):
        if lost[i]:
            continue
        way = [i]
        while out[way[-1]] is None and parent[way[-1]] >= 0:
            way.append(parent[way[-1]])
        for j in reversed(way):
            if out[j] is None:
                out[j] = (out[parent[j]] if parent[j] >= 0 else []) + (own[j] or [])
    return out


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that hold whole groups, from batches sorted by ``keys``."""
    rest: list[pa.Table] = []
    for b in batches:
        t = pa.Table.from_batches([b])
        if not t.num_rows:
            continue
        differs = np.zeros(t.num_rows, dtype=bool)
        for k in keys:
            v = t.column(k).to_numpy()
            differs |= v != v[-1]
        cut = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
        if rest:
            head, first = rest[-1], t.slice(0, 1)
            same = all(head.column(k)[-1].as_py() == first.column(k)[0].as_py() for k in keys)
            if not same or cut:
                done = [*rest, t.slice(0, cut)] if cut else rest
                yield pa.concat_tables(done)
                rest = []
        elif cut:
            yield t.slice(0, cut)
        rest.append(t.slice(cut))
    if rest:
        yield pa.concat_tables(rest)


_CUT = "page_id long, frag long, node_id string, exit string, dist long, step long, marks long, root string, rdist long, lost boolean"


def _fragments(with_path: bool):
    """mapInArrow function: rows (page_id, frag, node_id, parent, weight, mark, base_root, base_dist, base_lost[, seg]) of whole fragments, contracted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches, ["page_id", "frag"]):
            t = t.combine_chunks()
            one = {c: t.column(c).combine_chunks() for c in t.column_names}
            page, frag = one["page_id"].to_numpy(), one["frag"].to_numpy()
            group = np.cumsum(np.r_[0, (page[1:] != page[:-1]) | (frag[1:] != frag[:-1])]).astype(np.int64)
            nc, pc = _codes(one["node_id"], one["parent"])
            many = max(int(nc.max(initial=-1)), int(pc.max(initial=-1))) + 2
            key = group * many + nc
            order = np.argsort(key, kind="stable")
            at = np.minimum(np.searchsorted(key[order], group * many + pc), len(key) - 1)
            up = np.where((pc >= 0) & (key[order][at] == group * many + pc), order[at], -1)
            mark = one["mark"].to_numpy()
            top, (dist, marks), lost = _climb(up, one["weight"].to_numpy(), mark)
            tops = pa.array(top)
            cols = {
                "page_id": one["page_id"], "frag": one["frag"], "node_id": one["node_id"],
                "exit": pa.compute.if_else(pa.array(lost), pa.scalar(None, pa.string()), one["parent"].cast(pa.string()).take(tops)),
                "dist": pa.array(dist), "step": one["weight"].take(tops), "marks": pa.array(marks + mark[top]), "root": one["base_root"].cast(pa.string()).take(tops),
                "rdist": pa.array(dist + one["base_dist"].to_numpy()[top]), "lost": pa.array(lost | one["base_lost"].to_numpy(zero_copy_only=False)[top]),
            }
            if with_path:
                cols["path"] = pa.array(_segments(up, lost, one["seg"].to_pylist()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_pydict(cols)

    return run


def _solve(rows: DataFrame, with_path: bool) -> DataFrame:
    """The rows of ``_fragments`` to (page_id, node_id, root, depth, marks, lost[, path]).

    A row whose parent is no node of its page ends at ``base_root``, ``base_dist`` above it. Fragments grow with each level, up to a
    whole page's quotient at the latest, so the levels end.
    """
    path = ["path"] if with_path else []
    cut = (
        rows.repartition("page_id", "frag").sortWithinPartitions("page_id", "frag")
        .mapInArrow(_fragments(with_path), _CUT + (", path array<string>" if with_path else ""))
    )
    cut = written(cut)
    targets = cut.where("exit is not null").select("page_id", F.col("exit").alias("node_id")).distinct()
    inner = targets.join(cut, ["page_id", "node_id"]).select(
        "page_id", F.expr(f"frag div {FAN}").alias("frag"), "node_id", F.col("exit").alias("parent"), (F.col("dist") + F.col("step")).alias("weight"), F.col("marks").alias("mark"),
        F.col("root").alias("base_root"), F.col("rdist").alias("base_dist"), F.col("lost").alias("base_lost"), *([F.col("path").alias("seg")] if with_path else []),
    )
    inner = written(inner)
    if inner.isEmpty():
        return cut.select("page_id", "node_id", "root", F.col("rdist").alias("depth"), "marks", "lost", *path)
    above = _solve(inner, with_path).select("page_id", F.col("node_id").alias("exit"), *[F.col(c).alias("_" + c) for c in ("root", "depth", "marks", "lost", *path)])
    both = cut.join(above, ["page_id", "exit"], "left")
    through = F.col("_lost").isNotNull()
    pick = lambda c, over: F.when(through, over).otherwise(F.col(c))
    return both.select(
        "page_id", "node_id", pick("root", F.col("_root")).alias("root"), pick("rdist", F.col("_depth") + F.col("step") + F.col("dist")).alias("depth"),
        pick("marks", F.col("_marks") + F.col("marks")).alias("marks"), pick("lost", F.col("_lost")).alias("lost"),
        *([pick("path", F.concat("_path", "path")).alias("path")] if with_path else []),
    )


def _forest(nodes: DataFrame, with_path: bool, chunk: int, mark: Column) -> DataFrame:
    rows = nodes.where("page_id is not null and node_id is not null").select(
        F.col("page_id").cast("long").alias("page_id"), "node_id", F.expr(f"coalesce(greatest(pos, 0) div {int(chunk)}, pmod(xxhash64(node_id), {PLACELESS}))").alias("frag"),
        F.when(F.trim("parent_id") != "", F.col("parent_id")).alias("parent"), "children", F.coalesce("pos", F.lit(0)).cast("long").alias("ord"), F.coalesce(mark, F.lit(False)).cast("long").alias("mark"),
    )
    own = F.struct("ord", F.col("parent").isNull().alias("open"), "parent", "frag", "mark")
    by = F.struct("ord", F.col("node_id").alias("name"))
    kids = rows.select("page_id", F.explode("children").alias("child"), by.alias("by")).where("child is not null").select("page_id", F.col("child").alias("node_id"), "by")
    both = rows.select("page_id", "node_id", own.alias("own")).unionByName(kids, allowMissingColumns=True)
    one = both.groupBy("page_id", "node_id").agg(F.min("own").alias("own"), F.min("by").alias("by")).where("own is not null")
    base = one.select(
        "page_id", "own.frag", "node_id", F.coalesce("own.parent", "by.name").alias("parent"), F.lit(1).cast("long").alias("weight"), "own.mark",
        F.col("node_id").alias("base_root"), F.lit(0).cast("long").alias("base_dist"), F.lit(False).alias("base_lost"), *([F.array("node_id").alias("seg")] if with_path else []),
    )
    return _solve(base, with_path)


def hierarchy(nodes: DataFrame, with_path: bool = False, chunk: int = CHUNK) -> DataFrame:
    """One row (page_id, node_id, root_id, depth[, path]) for each node of each page.

    nodes: page_id, node_id, pos, parent_id, children; other columns are left aside, whatever their names. A node's parent is
    ``parent_id`` if filled (not null, not blank), else the first node in document order that lists it in ``children``. A node
    without a parent, or whose ``parent_id`` names no node of the page, is a root of depth 0. Nodes from which no root can be
    reached get root ``cycle``, depth -1 and a null path; ``path`` runs from the root to the node. Rows of the same node are one
    node, its first one in document order. Rows with a null ``page_id`` or ``node_id`` name no node and are left out; nodes
    without a position are spread over fragments by their name; nulls among the children are passed over. An empty table gives no rows.
    """
    return _told(_forest(nodes, with_path, chunk, F.lit(False)), with_path)


def marked_above(nodes: DataFrame, mark: Column, chunk: int = CHUNK) -> DataFrame:
    """(page_id, node_id, above): how many of the nodes above each node are marked; 0 for nodes from which no root can be reached."""
    own = nodes.where("page_id is not null and node_id is not null").groupBy("page_id", "node_id").agg(F.max(F.coalesce(mark, F.lit(False)).cast("long")).alias("own"))
    return _forest(nodes, False, chunk, mark).join(own, ["page_id", "node_id"]).select("page_id", "node_id", F.when(F.col("lost"), 0).otherwise(F.greatest(F.col("marks") - F.col("own"), F.lit(0))).alias("above"))


def _told(solved: DataFrame, with_path: bool) -> DataFrame:
    return solved.select(
        "page_id", "node_id", F.when(F.col("lost"), F.lit(CYCLE)).otherwise(F.col("root")).alias("root_id"),
        F.when(F.col("lost"), F.lit(-1)).otherwise(F.col("depth")).cast("int").alias("depth"),
        *([F.when(~F.col("lost"), F.col("path")).alias("path")] if with_path else []),
    )


def descendants(tree: DataFrame) -> DataFrame:
    """All pairs (page_id, node_id, descendant_id, distance) of a node and a node below it, from a hierarchy with paths."""
    steps = tree.where("path is not null").select("page_id", F.col("node_id").alias("descendant_id"), "depth", F.posexplode("path").alias("at", "node_id"))
    return steps.where("at < depth").select("page_id", "node_id", "descendant_id", (F.col("depth") - F.col("at")).cast("int").alias("distance"))
