"""What sweeps over levels bring to every node, in place of a table of all ancestors: states from the root down, running rates, and
sums from the tips up. Each has its meaning as a SQL text over the closure too, for a second engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import by_level, sized
from ..plans.plan import Dialect, plan
from .sweeps import carried, places, tree_levels, upward

# Sites of a tree that are swept together.
TOGETHER = 4


def states(node: DataFrame, mut: DataFrame) -> DataFrame:
    """tree_id, node, site, state: after the last event on the path from above the root, for the sites with any. A child has its
    parent's states, but for those that events on its own branch set."""
    place = by_level(places(node), "depth")
    last = mut.groupBy("tree_id", "node", "site").agg(F.min_by("new_state", "time").alias("own"))
    ends = by_level(last.join(place.drop("parent").hint("merge"), ["tree_id", "node"]), "depth")

    def step(upper: DataFrame, level: int) -> DataFrame:
        kids = place.where(F.col("depth") == level).select("tree_id", "node", "parent")
        above = kids.join(upper.select("tree_id", F.col("node").alias("parent"), "site", "state"), ["tree_id", "parent"]).drop("parent")
        here = ends.where(F.col("depth") == level).drop("depth")
        return above.join(here.hint("merge"), ["tree_id", "node", "site"], "full").select("tree_id", "node", "site", F.coalesce("own", "state").alias("state"))

    return carried(node, ends.where("depth = 0").select("tree_id", "node", "site", F.col("own").alias("state")), step)


def sums_above(node: DataFrame, own: DataFrame) -> DataFrame:
    """own(tree_id, node, site, inc) -> the same, summed over all nodes above each node, itself left out."""
    place = by_level(places(node), "depth")
    ends = by_level(own.join(place.drop("parent").hint("merge"), ["tree_id", "node"]), "depth")

    def step(upper: DataFrame, level: int) -> DataFrame:
        upto = upper.unionByName(ends.where(F.col("depth") == level - 1).drop("depth")).groupBy("tree_id", F.col("node").alias("parent"), "site").agg(F.sum("inc").alias("inc"))
        kids = place.where(F.col("depth") == level).select("tree_id", "node", "parent")
        return upto.join(kids.hint("merge"), ["tree_id", "parent"]).select("tree_id", "node", "site", "inc")

    return carried(node, ends.where("depth < 0").select("tree_id", "node", "site", "inc"), step)


def _of_sites(node: DataFrame, rows: DataFrame, values: list[str], sweep, names: dict[str, str]) -> DataFrame:
    """names: columns and types of what sweep makes, tree_id, node and site first. A group is a tree and a few sites, so that neither pairs of nodes and ancestors nor levels are written down. rows: tree_id, node, site and values.
    sweep: from the number of nodes and sites, parents and levels (tree_levels), the cell (node times sites plus site) of each row, and its values, an array of whether a cell has a row, and those of the other columns."""
    block = F.floor(F.col("site") / TOGETHER).cast("long").alias("block")
    own_rows = rows.select("tree_id", block, "node", "site", *values)
    topology = node.select("tree_id", "node", "parent").join(rows.select("tree_id", block).distinct(), "tree_id")

    def run(key, tree, own):
        import numpy as np
        import pandas as pd

        tree = tree.sort_values("node")
        nodes, of = tree["node"].to_numpy(np.int64), own["node"].to_numpy(np.int64)
        if len(nodes):
            own = own[nodes[np.minimum(np.searchsorted(nodes, of), len(nodes) - 1)] == of]
        if not len(nodes) or not len(own):
            return pd.DataFrame({c: [] for c in names})
        parent, levels = tree_levels(nodes, tree["parent"].fillna(0).to_numpy(np.int64), tree["parent"].notna().to_numpy())
        sites, column = np.unique(own["site"].to_numpy(np.int64), return_inverse=True)
        cell = np.searchsorted(nodes, own["node"].to_numpy(np.int64)) * len(sites) + column
        has, *out = sweep((len(nodes), len(sites)), parent, levels, cell, *(own[v].to_numpy() for v in values))
        at = np.nonzero(has)
        return pd.DataFrame(dict(zip(names, (key[0], nodes[at[0]], sites[at[1]], *(x[at] for x in out)))))

    return topology.groupBy("tree_id", "block").cogroup(own_rows.groupBy("tree_id", "block")).applyInPandas(run, ", ".join(f"{c} {t}" for c, t in names.items()))


def _kinds(rows: DataFrame, *columns: str) -> dict[str, str]:
    return {c: rows.schema[c].dataType.simpleString() for c in columns}


def _ends(shape, cell, time, old, new):
    """Of each cell: events, state before the first of them and its time, state after the last one and its time."""
    import numpy as np

    order = np.lexsort((time, cell))
    cell, time = cell[order], time[order]
    first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    last, cells = np.append(first[1:], len(cell)) - 1, cell[first]
    count, begin, end = (np.zeros(shape, np.int64) for _ in range(3))
    high, low = np.full(shape, -np.inf), np.full(shape, np.inf)
    count.flat[cells], high.flat[cells], low.flat[cells] = last - first + 1, time[last], time[first]
    begin.flat[cells], end.flat[cells] = old[order][last], new[order][first]
    return count, begin, high, end, low


def path_changes(node: DataFrame, mut: DataFrame) -> DataFrame:
    """tree_id, node, site, start_state, end_state, events: before the first and after the last event by time on the path from above the root, and their number, for the sites with any. What
    reaches a node is what reaches its parent and its own events, all nodes of a level at once."""

    def sweep(shape, parent, levels, cell, time, old, new):
        import numpy as np

        count, begin, high, end, low = _ends(shape, cell, time, old, new)
        for here in levels[1:]:
            above = parent[here]
            earlier, later = high[above] > high[here], low[above] < low[here]
            begin[here], high[here] = np.where(earlier, begin[above], begin[here]), np.maximum(high[above], high[here])
            end[here], low[here] = np.where(later, end[above], end[here]), np.minimum(low[above], low[here])
            count[here] += count[above]
        return count > 0, begin, end, count

    kind = _kinds(mut, "tree_id", "node", "site", "old_state", "new_state")
    return _of_sites(node, mut, ["time", "old_state", "new_state"], sweep, {**_kinds(mut, "tree_id", "node", "site"), "start_state": kind["old_state"], "end_state": kind["new_state"], "events": "long"})


def states_of_sites(node: DataFrame, mut: DataFrame) -> DataFrame:
    """The rows of states, swept in groups of a tree and a few sites."""

    def sweep(shape, parent, levels, cell, time, new):
        import numpy as np

        count, _, _, state, _ = _ends(shape, cell, time, new, new)
        has = count > 0
        for here in levels[1:]:
            state[here] = np.where(has[here], state[here], state[parent[here]])
            has[here] |= has[parent[here]]
        return has, state

    return _of_sites(node, mut, ["time", "new_state"], sweep, {**_kinds(mut, "tree_id", "node", "site"), "state": _kinds(mut, "new_state")["new_state"]})


def sums_of_sites(node: DataFrame, own: DataFrame) -> DataFrame:
    """The rows of sums_above, for whole numbers, swept in groups of a tree and a few sites."""

    def sweep(shape, parent, levels, cell, inc):
        import numpy as np

        total, has = np.zeros(shape, np.int64), np.zeros(shape, bool)
        np.add.at(total.reshape(-1), cell, inc)
        has.flat[cell] = True
        mine, any_own = total.copy(), has.copy()
        total[levels[0]], has[levels[0]] = 0, False
        for here in levels[1:]:
            above = parent[here]
            total[here], has[here] = total[above] + mine[above], has[above] | any_own[above]
        return has, total

    return _of_sites(node, own, ["inc"], sweep, {**_kinds(own, "tree_id", "node", "site"), "inc": "long"})


@plan("closure", "mut")
def states_by_closure(d: Dialect) -> str:
    return """SELECT c.tree_id, c.node, e.site, min_by(e.state, c.steps) AS state FROM {closure} c
      JOIN (SELECT tree_id, node, site, min_by(new_state, time) AS state FROM {mut} GROUP BY tree_id, node, site) e ON e.tree_id = c.tree_id AND e.node = c.ancestor GROUP BY c.tree_id, c.node, e.site"""


def lengths_below(node: DataFrame) -> DataFrame:
    """tree_id, node, below: the length of all branches below each node."""
    up = node.select("tree_id", F.col("node").alias("parent"), F.col("height").alias("hi"))
    own = sized(node.join(up.hint("merge"), ["tree_id", "parent"], "left").select("tree_id", "node", "is_leaf", F.coalesce(F.col("hi") - F.col("height"), F.lit(0.0)).alias("len")))

    def merge(rows: DataFrame) -> DataFrame:
        sums = rows.groupBy("tree_id", F.col("parent").alias("node")).agg(F.sum("reach").alias("below"))
        return sums.join(own.hint("merge"), ["tree_id", "node"]).select("tree_id", "node", "below", (F.col("below") + F.col("len")).alias("reach"))

    tips = own.where("is_leaf").select("tree_id", "node", F.lit(0.0).alias("below"), F.col("len").alias("reach"))
    return upward(node, tips, merge).select("tree_id", "node", "below")


@plan("node", "closure")
def lengths_by_closure(d: Dialect) -> str:
    return """SELECT c.tree_id, c.ancestor AS node, sum(CASE WHEN c.steps > 0 THEN p.height - n.height ELSE 0.0E0 END) AS below FROM {closure} c JOIN {node} n ON n.tree_id = c.tree_id AND n.node = c.node
      LEFT JOIN {node} p ON p.tree_id = n.tree_id AND p.node = n.parent GROUP BY c.tree_id, c.ancestor"""


def subtree_stats(node: DataFrame, mut: DataFrame) -> DataFrame:
    """Below each node: tips, oldest and youngest tip, branch length, and events on its branches; a tip is below itself."""
    events = mut.groupBy("tree_id", "node").agg(F.count("*").alias("m"))
    up = node.select("tree_id", F.col("node").alias("parent"), F.col("height").alias("hi"))
    own = sized(node.join(up.hint("merge"), ["tree_id", "parent"], "left").join(events.hint("merge"), ["tree_id", "node"], "left").select(
        "tree_id", "node", "is_leaf", "height", F.coalesce(F.col("hi") - F.col("height"), F.lit(0.0)).alias("len"), F.coalesce("m", F.lit(0)).cast("long").alias("m")
    ))

    def merge(rows: DataFrame) -> DataFrame:
        sums = rows.groupBy("tree_id", F.col("parent").alias("node")).agg(
            F.sum("tips").alias("tips"), F.max("oldest_tip").alias("oldest_tip"), F.min("youngest_tip").alias("youngest_tip"), F.sum(F.col("length") + F.col("len")).alias("length"), F.sum(F.col("mutations") + F.col("m")).alias("mutations")
        )
        return sums.join(own.drop("is_leaf", "height").hint("merge"), ["tree_id", "node"])

    zero = F.lit(0).cast("long")
    tips = own.where("is_leaf").select("tree_id", "node", F.lit(1).cast("long").alias("tips"), F.col("height").alias("oldest_tip"), F.col("height").alias("youngest_tip"), F.lit(0.0).alias("length"), zero.alias("mutations"), "len", "m")
    return upward(node, tips, merge).select("tree_id", "node", "tips", "oldest_tip", "youngest_tip", F.round("length", 6).alias("length"), "mutations")


def branch_rates(node: DataFrame, mut: DataFrame, reference: DataFrame, rate: DataFrame) -> DataFrame:
    """tree_id, node, rate_above, rate_at: the total rate of leaving the sequence at the start of a node's branch, which is its parent's, and at the node:
    each event on the branch changes it by its states' difference. The reference's rate and the events above the root give the root's."""
    escape = rate.groupBy(F.col("from_state").alias("state")).agg(F.sum("q").alias("e"))
    old, new = (escape.select(F.col("state").alias(f"{x}_state"), F.col("e").alias(x)) for x in ("old", "new"))
    change = mut.join(old, "old_state").join(new, "new_state").groupBy("tree_id", "node").agg(F.sum(F.col("new") - F.col("old")).alias("change"))
    rows = by_level(places(node).join(change.hint("merge"), ["tree_id", "node"], "left").fillna(0.0, ["change"]), "depth")
    start = reference.join(escape, "state").agg(F.sum("e")).first()[0] or 0.0
    top = rows.where("depth = 0").select("tree_id", "node", F.lit(start).alias("rate_above"), (F.lit(start) + F.col("change")).alias("rate_at"))

    def step(upper: DataFrame, level: int) -> DataFrame:
        above = upper.select("tree_id", F.col("node").alias("parent"), F.col("rate_at").alias("rate_above"))
        return rows.where(F.col("depth") == level).join(above, ["tree_id", "parent"]).select("tree_id", "node", "rate_above", (F.col("rate_above") + F.col("change")).alias("rate_at"))

    return carried(node, top, step)


@plan("node", "closure", "mut", "reference", "rate")
def rates_by_closure(d: Dialect) -> str:
    return """WITH e AS (SELECT from_state AS state, sum(q) AS e FROM {rate} GROUP BY from_state), s AS (SELECT sum(e.e) AS start FROM {reference} r JOIN e ON e.state = r.state),
      c AS (SELECT m.tree_id, m.node, sum(y.e - x.e) AS change FROM {mut} m JOIN e x ON x.state = m.old_state JOIN e y ON y.state = m.new_state GROUP BY m.tree_id, m.node)
      SELECT k.tree_id, k.node, s.start + sum(CASE WHEN k.steps > 0 THEN coalesce(c.change, 0.0E0) ELSE 0.0E0 END) AS rate_above, s.start + sum(coalesce(c.change, 0.0E0)) AS rate_at
      FROM {closure} k JOIN s ON s.start IS NOT NULL LEFT JOIN c ON c.tree_id = k.tree_id AND c.node = k.ancestor GROUP BY k.tree_id, k.node, s.start"""


@plan("branch_rates", "mut", "rate")
def total_rate_on_branch(d: Dialect) -> str:
    """The total rate before and after each event of a branch, in the order of time."""
    return """WITH e AS (SELECT from_state AS state, sum(q) AS e FROM {rate} GROUP BY from_state),
      x AS (SELECT m.tree_id, m.node, m.time, m.site, y.e - x.e AS change FROM {mut} m JOIN e x ON x.state = m.old_state JOIN e y ON y.state = m.new_state)
      SELECT x.tree_id, x.node, x.time, x.site, round(b.rate_above + (sum(x.change) OVER w) - x.change, 6) AS rate_before, round(b.rate_above + (sum(x.change) OVER w), 6) AS rate_after
      FROM x JOIN {branch_rates} b ON b.tree_id = x.tree_id AND b.node = x.node WINDOW w AS (PARTITION BY x.tree_id, x.node ORDER BY x.time DESC, x.site ROWS UNBOUNDED PRECEDING)"""
