"""Parsimony on trees by sweeps over depth levels. tip_state(tree_id, node, site, mask)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import Pieces, by_level
from ..plans.plan import Dialect, plan
from .sweeps import carried, places


def fitch_sets(node: DataFrame, tip_state: DataFrame, levels: int | None = None) -> DataFrame:
    """State set and number of changes below each node and site: from the deepest level up, a parent has the
    intersection of its children's sets if there is one, else their union and one change more."""
    depth = levels or node.agg(F.max("depth")).first()[0] or 0
    place = by_level(places(node), "depth")
    done = tip_state.select("tree_id", "node", "site", F.col("mask").cast("int").alias("mask"), F.lit(0).cast("long").alias("score"))
    tips = by_level(done.join(place.hint("merge"), ["tree_id", "node"]), "depth")
    inner = Pieces()
    current = None
    for level in range(depth, 0, -1):
        children = tips.where(F.col("depth") == level).select("tree_id", "node", "site", "mask", "score", "parent")
        if current is not None:
            # the nodes of this level that the last step made
            children = children.unionByName(current.join(place.where(F.col("depth") == level).select("tree_id", "node", "parent").hint("merge"), ["tree_id", "node"]))
        merged = children.groupBy("tree_id", F.col("parent").alias("node"), "site").agg(
            F.expr("bit_and(mask)").alias("common"), F.expr("bit_or(mask)").alias("any"), F.sum("score").alias("below")
        ).select(
            "tree_id", "node", "site", F.when(F.col("common") != 0, F.col("common")).otherwise(F.col("any")).alias("mask"),
            (F.col("below") + F.when(F.col("common") != 0, 0).otherwise(1)).cast("long").alias("score"),
        )
        current = inner.add(merged)
    return done.unionByName(inner.table()) if current is not None else done


@plan("fitch", "node")
def fitch_scores(d: Dialect) -> str:
    """Changes needed at each site."""
    return f"SELECT {d.merge('f')}f.tree_id, f.site, f.score FROM {{fitch}} f JOIN {{node}} n ON n.tree_id = f.tree_id AND n.node = f.node WHERE n.parent IS NULL"


@plan("fitch")
def fitch_rows(d: Dialect) -> str:
    return "SELECT tree_id, node, site, CAST(mask AS INT) AS mask, score FROM {fitch}"


@plan("fitch", "mut", "node", "closure", "unconstrained")
def excess_mutations(d: Dialect) -> str:
    """Events beyond what parsimony needs, by site; events above the root don't count. `missing`: all events on branches
    below which no tip constrains the site. `conflict`: of the others, as many as exceed the site's score, if any do. Each with the
    branches of the counted events, as node(tips below, height), and the frequency of every change of state."""
    letter = "substring('ACGT', CAST({0} AS INT) + 1, 1)"
    text = d.text
    return f"""WITH tips AS (SELECT {d.merge("c")}c.tree_id, c.ancestor AS node, count(*) AS n FROM {{closure}} c JOIN {{node}} t ON t.tree_id = c.tree_id AND t.node = c.node AND t.is_leaf GROUP BY c.tree_id, c.ancestor),
      e AS (SELECT m.tree_id, m.site, m.node, m.time, m.old_state, m.new_state, CASE WHEN u.node IS NULL THEN 'conflict' ELSE 'missing' END AS kind,
        concat(CAST(m.node AS {text}), '(', CAST(t.n AS {text}), ',', CAST(n.height AS {text}), ')') AS branch
        FROM {{mut}} m JOIN {{node}} n ON n.tree_id = m.tree_id AND n.node = m.node AND n.parent IS NOT NULL JOIN tips t ON t.tree_id = m.tree_id AND t.node = m.node
        LEFT JOIN {{unconstrained}} u ON u.tree_id = m.tree_id AND u.node = m.node AND u.site = m.site),
      s AS (SELECT {d.merge("f")}f.tree_id, f.site, f.score FROM {{fitch}} f JOIN {{node}} n ON n.tree_id = f.tree_id AND n.node = f.node AND n.parent IS NULL),
      x AS (SELECT e.tree_id, e.site, e.kind, count(*) - CASE WHEN e.kind = 'conflict' THEN min(s.score) ELSE 0 END AS excess, {d.listagg("e.branch", ",", "e.node, e.time DESC")} AS branches
        FROM e JOIN s ON s.tree_id = e.tree_id AND s.site = e.site GROUP BY e.tree_id, e.site, e.kind),
      c AS (SELECT tree_id, site, kind, old_state, new_state, count(*) AS n FROM e GROUP BY tree_id, site, kind, old_state, new_state),
      z AS (SELECT tree_id, site, kind, {d.listagg(f"concat({letter.format('old_state')}, '>', {letter.format('new_state')}, ':', CAST(n AS {text}))", ",", "old_state, new_state")} AS changes FROM c GROUP BY tree_id, site, kind)
      SELECT x.tree_id, x.site, x.kind, CAST(x.excess AS BIGINT) AS excess, x.branches, z.changes FROM x JOIN z ON z.tree_id = x.tree_id AND z.site = x.site AND z.kind = x.kind WHERE x.excess > 0"""


@plan("scores")
def fitch_site_filter(d: Dialect, least: int = 2) -> str:
    """Sites by whether their parsimony score reaches the least score; the two parts are complementary."""
    return f"SELECT tree_id, site, score, score >= {least} AS high FROM {{scores}}"


def select_sites(scores: DataFrame, least: int, high: bool = True) -> DataFrame:
    """The sites of one part of fitch_site_filter. Raises where a tree would be left without any."""
    marked = fitch_site_filter.given(least=least)(scores=scores)
    empty = marked.groupBy("tree_id").agg(F.max(F.col("high") == high).alias("some")).where("NOT some").limit(1).collect()
    if empty:
        raise ValueError(f"no site of tree {empty[0].tree_id} has a score {'of' if high else 'below'} {least}" + (" or more" if high else ""))
    return marked.where(F.col("high") == high).select("tree_id", "site", "score")


def fitch_states(node: DataFrame, sets: DataFrame, reference: DataFrame) -> DataFrame:
    """One most parsimonious state for each node and site, from the root down: the parent's state (the reference's above
    the root) where the node's set has it, else the smallest of the set. Also the parent's state."""
    place = node.select("tree_id", "node", "parent", "depth").hint("merge")
    rows = by_level(sets.join(place, ["tree_id", "node"]).select("tree_id", "node", "parent", "depth", "site", "mask"), "depth")
    smallest = F.length(F.bin(F.col("mask").bitwiseAND(-F.col("mask")))) - 1

    def choose(given: DataFrame) -> DataFrame:
        fits = F.expr("mask & shiftleft(1, CAST(above AS INT))") != 0
        return given.select("tree_id", "node", "site", F.when(fits, F.col("above")).otherwise(smallest).cast("long").alias("state"), F.col("above").cast("long").alias("parent_state"))

    def step(upper: DataFrame, level: int) -> DataFrame:
        above = upper.select("tree_id", F.col("node").alias("parent"), "site", F.col("state").alias("above"))
        return choose(rows.where(F.col("depth") == level).join(above, ["tree_id", "parent", "site"]))

    return carried(node, choose(rows.where("parent IS NULL").join(reference.select("site", F.col("state").alias("above")), "site")), step)


def fitch_states_text() -> str:
    """The same for a second engine, which follows the tree by recursion; over the views node, fitch, reference."""
    state = "CASE WHEN (f.mask & (1 << CAST({0} AS INTEGER))) <> 0 THEN {0} ELSE length(bin(f.mask & -f.mask)) - 1 END"
    return f"""WITH RECURSIVE s AS (
        SELECT n.tree_id, n.node, f.site, CAST({state.format('r.state')} AS BIGINT) AS state, CAST(r.state AS BIGINT) AS parent_state FROM node n JOIN fitch f ON f.tree_id = n.tree_id AND f.node = n.node JOIN reference r ON r.site = f.site WHERE n.parent IS NULL
        UNION ALL SELECT n.tree_id, n.node, f.site, CAST({state.format('s.state')} AS BIGINT), s.state FROM s JOIN node n ON n.tree_id = s.tree_id AND n.parent = s.node JOIN fitch f ON f.tree_id = n.tree_id AND f.node = n.node AND f.site = s.site)
      SELECT * FROM s"""


@plan("states", "node")
def placed_events(d: Dialect, seed: int = 0, above: bool = True) -> str:
    """One event for each node and site whose state isn't its parent's, at a height drawn on the branch by a hash of the
    place; above the root, if wanted, at the root's height. states: of fitch_states."""
    place = f"concat('{seed}-', CAST(s.tree_id AS {d.text}), '-', CAST(s.node AS {d.text}), '-', CAST(s.site AS {d.text}))"
    return f"""SELECT {d.merge("s")}s.tree_id, s.node, round(n.height + ({d.hash32(place)} + 0.5E0) / 4294967296.0E0 * (coalesce(p.height, n.height) - n.height), 12) AS time, s.site, s.parent_state AS old_state, s.state AS new_state
      FROM {{states}} s JOIN {{node}} n ON n.tree_id = s.tree_id AND n.node = s.node LEFT JOIN {{node}} p ON p.tree_id = n.tree_id AND p.node = n.parent WHERE s.state <> s.parent_state{"" if above else " AND n.parent IS NOT NULL"}"""


@plan("states", "node")
def rebased_reference(d: Dialect) -> str:
    """The root's states as the reference of each tree: tree_id, site, state. From it, no events above the root are needed."""
    return f"SELECT {d.merge('s')}s.tree_id, s.site, s.state FROM {{states}} s JOIN {{node}} n ON n.tree_id = s.tree_id AND n.node = s.node WHERE n.parent IS NULL"


def parsimony_events(node: DataFrame, states: DataFrame, seed: int = 0) -> DataFrame:
    return placed_events.given(seed=seed)(states=states, node=node)


def parsimony_history(node: DataFrame, states: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """A history with as few events as needed: its reference, which is the root's sequence, and the events below the root."""
    return rebased_reference(states=states, node=node), placed_events.given(seed=seed, above=False)(states=states, node=node)


LEVELS = 24


def fitch_text(d: Dialect, levels: int = LEVELS) -> str:
    """The same sweep as one text, for trees of at most `levels` levels."""
    parts = ["leaf_sets AS (SELECT t.tree_id, t.node, n.parent, n.depth, t.site, CAST(t.mask AS INTEGER) AS mask, CAST(0 AS BIGINT) AS score FROM tip_state t JOIN node n ON n.tree_id = t.tree_id AND n.node = t.node)"]
    for level in range(levels, 0, -1):
        source = f"SELECT * FROM leaf_sets WHERE depth = {level}" + (f" UNION ALL SELECT * FROM level{level}" if level < levels else "")
        parts.append(f"""level{level - 1} AS (SELECT g.tree_id, g.node, n.parent, n.depth, g.site, CASE WHEN common <> 0 THEN common ELSE anyone END AS mask, below + CASE WHEN common <> 0 THEN 0 ELSE 1 END AS score
          FROM (SELECT tree_id, parent AS node, site, bit_and(mask) AS common, bit_or(mask) AS anyone, CAST(sum(score) AS BIGINT) AS below FROM ({source}) s GROUP BY tree_id, parent, site) g
          JOIN node n ON n.tree_id = g.tree_id AND n.node = g.node)""")
    every = " UNION ALL ".join(f"SELECT tree_id, node, site, mask, score FROM {x}" for x in ["leaf_sets", *(f"level{i}" for i in range(levels))])
    return ", ".join(parts) + f", fitch AS ({every})"
