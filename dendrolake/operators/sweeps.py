"""Sweeps over the levels of trees, from the tips up and from the root down, as one join or aggregation for each level. Each level
is a table in the shared folder, so that it is made once, and all of them are read as one; a lost executor costs one level at most.
Levels grow with the trees: joins of two of them are merges, whatever size packed files show."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import Pieces, by_level


def places(node: DataFrame) -> DataFrame:
    return node.select("tree_id", "node", "parent", F.col("depth").cast("int").alias("depth"))


def deepest(node: DataFrame) -> int:
    return node.agg(F.max("depth")).first()[0] or 0


def upward(node: DataFrame, own: DataFrame, merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """own: rows (tree_id, node, ...) of tips. merge: from all rows of a level, which have their parent, the rows (tree_id, node, ...)
    of these parents. Returns the rows of all nodes that have any below them, with parent and depth."""
    place = by_level(places(node), "depth")
    rows = by_level(own.join(place.hint("merge"), ["tree_id", "node"]), "depth")
    inner, now = Pieces(), None
    for level in range(deepest(node), 0, -1):
        here = rows.where(F.col("depth") == level)
        here = here if now is None else here.unionByName(now, allowMissingColumns=True)
        now = inner.add(merge(here).join(place.where(F.col("depth") == level - 1).hint("merge"), ["tree_id", "node"]))
    return rows.unionByName(inner.table(), allowMissingColumns=True) if now is not None else rows


def carried(node: DataFrame, top: DataFrame, step: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """top: rows of the roots. step: from the rows of a level, hinted to be merged, and the next one's depth, the rows of that. All rows."""
    levels = Pieces()
    now = levels.add(top)
    for level in range(1, deepest(node) + 1):
        now = levels.add(step(now.hint("merge"), level))
    return levels.table()


def tree_levels(nodes, parents, some):
    """For one tree in memory, of any numbering: the places of the parents among `nodes`, which are sorted, -1 at a root, and the places of the nodes of each level from the roots down, those of one parent together.
    some: which nodes have a parent. Depths come from pointers that jump twice as far each time."""
    import numpy as np

    parent = np.where(some, np.searchsorted(nodes, parents), -1)
    depth, jump = some.astype(np.int64), parent.copy()
    while (jump >= 0).any():
        on = jump >= 0
        depth[on], jump[on] = depth[on] + depth[jump[on]], jump[jump[on]]
    by_level = np.lexsort((parent, depth))
    return parent, np.split(by_level, np.searchsorted(depth[by_level], np.arange(1, depth.max() + 1)))
