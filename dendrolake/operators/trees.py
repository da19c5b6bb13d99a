"""Trees as adjacency tables: node(tree_id, node, parent, is_leaf, n_tips, depth, height), heights backwards in
time, and their ancestor closure(tree_id, node, ancestor, steps)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.plan import Dialect, plan


def ancestor_closure(node: DataFrame) -> DataFrame:
    """All pairs (node, ancestor), the node itself included, with the number of steps. Pointer jumping: the
    reach doubles with every join, so that a tree of depth n needs log2(n) of them."""
    base = node.select("tree_id", "node", "parent")
    jump = base.where("parent IS NOT NULL").select("tree_id", "node", F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("steps"))
    pairs = jump
    reach = 1
    deepest = node.select(F.col("tree_id"), "depth").agg(F.max("depth")).first()[0] or 0
    while reach < deepest:
        hop = jump.select("tree_id", F.col("node").alias("ancestor"), F.col("ancestor").alias("top"), F.col("steps").alias("more"))
        far = pairs.join(hop, ["tree_id", "ancestor"]).select("tree_id", "node", F.col("top").alias("ancestor"), (F.col("steps") + F.col("more")).alias("steps"))
        jump = jump.join(hop, ["tree_id", "ancestor"]).select("tree_id", "node", F.col("top").alias("ancestor"), (F.col("steps") + F.col("more")).alias("steps"))
        pairs = pairs.unionByName(far)
        reach *= 2
    return base.select("tree_id", "node", F.col("node").alias("ancestor"), F.lit(0).cast("long").alias("steps")).unionByName(pairs)


@plan("closure")
def closure_rows(d: Dialect) -> str:
    return "SELECT tree_id, node, ancestor, CAST(steps AS BIGINT) AS steps FROM {closure}"


@plan("pairs", "node", "closure")
def mrca(d: Dialect) -> str:
    """The most recent common ancestor of each pair (tree_id, x, y): of the nodes above both, the deepest, so equal
    heights don't matter; a node is above itself."""
    return """SELECT p.tree_id, p.x, p.y, max_by(a.ancestor, n.depth) AS mrca, max_by(n.height, n.depth) AS height
      FROM {pairs} p JOIN {closure} a ON a.tree_id = p.tree_id AND a.node = p.x JOIN {closure} b ON b.tree_id = p.tree_id AND b.node = p.y AND b.ancestor = a.ancestor
      JOIN {node} n ON n.tree_id = a.tree_id AND n.node = a.ancestor GROUP BY p.tree_id, p.x, p.y"""


@plan("node")
def tree_length(d: Dialect) -> str:
    """Sum of branch lengths, plain and weighted by a rate of one half on branches above tips."""
    return """SELECT n.tree_id, count(*) AS branches, round(sum(p.height - n.height), 6) AS length,
        round(sum((p.height - n.height) * CASE WHEN n.is_leaf THEN 0.5E0 ELSE 1.0E0 END), 6) AS weighted
      FROM {node} n JOIN {node} p ON p.tree_id = n.tree_id AND p.node = n.parent GROUP BY n.tree_id"""


@plan("node", "branch_rate")
def rated_length(d: Dialect) -> str:
    """Sum of branch lengths, plain and times the rate of each branch (tree_id, node, rate); branches without a rate count once."""
    return """SELECT n.tree_id, count(*) AS branches, round(sum(p.height - n.height), 6) AS length, round(sum((p.height - n.height) * coalesce(b.rate, 1.0E0)), 6) AS rated
      FROM {node} n JOIN {node} p ON p.tree_id = n.tree_id AND p.node = n.parent LEFT JOIN {branch_rate} b ON b.tree_id = n.tree_id AND b.node = n.node GROUP BY n.tree_id"""


@plan("node", "closure", "mut")
def subtree_stats(d: Dialect) -> str:
    """Below each node: tips, oldest and youngest tip, branch length, and events on its branches."""
    return """WITH events AS (SELECT tree_id, node, count(*) AS m FROM {mut} GROUP BY tree_id, node),
      own AS (SELECT n.tree_id, n.node, n.is_leaf, n.height, coalesce(p.height - n.height, 0.0E0) AS len, coalesce(e.m, 0) AS m
        FROM {node} n LEFT JOIN {node} p ON p.tree_id = n.tree_id AND p.node = n.parent LEFT JOIN events e ON e.tree_id = n.tree_id AND e.node = n.node)
      SELECT c.tree_id, c.ancestor AS node, count(*) FILTER (WHERE o.is_leaf) AS tips, max(CASE WHEN o.is_leaf THEN o.height END) AS oldest_tip,
        min(CASE WHEN o.is_leaf THEN o.height END) AS youngest_tip, round(sum(CASE WHEN c.steps > 0 THEN o.len ELSE 0.0E0 END), 6) AS length,
        CAST(sum(CASE WHEN c.steps > 0 THEN o.m ELSE 0 END) AS BIGINT) AS mutations
      FROM {closure} c JOIN own o ON o.tree_id = c.tree_id AND o.node = c.node GROUP BY c.tree_id, c.ancestor"""


@plan("node")
def lineages_through_time(d: Dialect) -> str:
    """Nodes by height: length of the interval before each, and lineages during it."""
    return """SELECT tree_id, node, height, round(height - lag(height, 1, height) OVER w, 6) AS interval_length,
        CAST(coalesce(sum(CASE WHEN is_leaf THEN 1 ELSE -1 END) OVER (PARTITION BY tree_id ORDER BY height, is_leaf DESC, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lineages
      FROM {node} WINDOW w AS (PARTITION BY tree_id ORDER BY height, is_leaf DESC, node)"""


@plan("lineages")
def hazard_events(d: Dialect) -> str:
    """Exposure and event multiplicities of coalescent and birth-death hazards, for intervals of some length."""
    return """SELECT tree_id, node, interval_length, lineages, lineages * (lineages - 1) / 2.0E0 AS coalescent_exposure, lineages * (lineages - 1) / 2.0E0 AS coalescent_event,
        lineages AS birth_death_exposure, greatest(lineages - 1, 0) AS birth_death_event FROM {lineages} WHERE interval_length > 0 AND lineages > 1"""


@plan("lineages")
def hazard_log_density(d: Dialect) -> str:
    """Log density of the internal nodes under a hazard with log rate a + b h, exact over each interval."""
    a, b = "(-1.0E0)", "0.1E0"
    mean = f"exp({a} + {b} * (height - interval_length)) * (exp({b} * interval_length) - 1) / ({b})"
    return f"""WITH x AS (SELECT l.tree_id, l.height, l.interval_length, l.lineages, l.is_leaf FROM {{lineages}} l)
      SELECT tree_id, round(sum(CASE WHEN NOT is_leaf AND lineages > 1 THEN ln(lineages * (lineages - 1) / 2.0E0) + {a} + {b} * height ELSE 0.0E0 END)
        - sum(CASE WHEN lineages > 1 THEN lineages * (lineages - 1) / 2.0E0 * {mean} ELSE 0.0E0 END), 6) AS log_density FROM x GROUP BY tree_id"""


@plan("node", "closure")
def clades(d: Dialect) -> str:
    """Tip sets, as the tips' nodes, of the internal nodes but the root."""
    return f"""SELECT c.tree_id, c.ancestor AS node, count(*) AS size, {d.collect("c.node", "c.node")} AS clade
      FROM {{closure}} c JOIN {{node}} n ON n.tree_id = c.tree_id AND n.node = c.node AND n.is_leaf JOIN {{node}} a ON a.tree_id = c.tree_id AND a.node = c.ancestor
      WHERE a.parent IS NOT NULL GROUP BY c.tree_id, c.ancestor HAVING count(*) > 1"""


_RELABELLED = """WITH ranked AS (SELECT tree_id, node, row_number() OVER (PARTITION BY tree_id ORDER BY node) AS nth, count(*) OVER (PARTITION BY tree_id) AS n FROM {node} WHERE is_leaf),
      tips AS (SELECT tree_id, node, nth - 1 AS a, nth % n AS b FROM ranked),
      sets AS (SELECT c.tree_id, c.ancestor AS node, @A AS a, @B AS b FROM {closure} c JOIN tips t ON t.tree_id = c.tree_id AND t.node = c.node
        JOIN {node} x ON x.tree_id = c.tree_id AND x.node = c.ancestor WHERE x.parent IS NOT NULL GROUP BY c.tree_id, c.ancestor HAVING count(*) > 1)"""


@plan("node", "closure")
def rf_distance(d: Dialect) -> str:
    """Robinson-Foulds distance of each tree to the same tree with its tips shifted by one: clades in one only."""
    head = _RELABELLED.replace("@A", d.collect("t.a", "t.a")).replace("@B", d.collect("t.b", "t.b"))
    return head + """, x AS (SELECT tree_id, a AS clade FROM sets), y AS (SELECT tree_id, b AS clade FROM sets)
      SELECT coalesce(x.tree_id, y.tree_id) AS tree_id, count(*) FILTER (WHERE x.clade IS NULL OR y.clade IS NULL) AS distance, count(*) FILTER (WHERE x.clade = y.clade) AS shared
      FROM x FULL OUTER JOIN y ON x.tree_id = y.tree_id AND x.clade = y.clade GROUP BY coalesce(x.tree_id, y.tree_id)"""


@plan("one", "other")
def rf_between(d: Dialect) -> str:
    """Robinson-Foulds distance of the trees of two clade tables (tree_id, clade) that have the same number: clades in
    one only, and in both."""
    return """SELECT coalesce(x.tree_id, y.tree_id) AS tree_id, count(*) FILTER (WHERE x.clade IS NULL OR y.clade IS NULL) AS distance, count(*) FILTER (WHERE x.clade = y.clade) AS shared
      FROM {one} x FULL OUTER JOIN {other} y ON x.tree_id = y.tree_id AND x.clade = y.clade GROUP BY coalesce(x.tree_id, y.tree_id)"""


def robinson_foulds(one: DataFrame, other: DataFrame, tips: DataFrame, other_tips: DataFrame) -> DataFrame:
    """rf_between of two clade tables; tips: (tree_id, tip) of either. Raises where trees differ in their tips."""
    odd = tips.exceptAll(other_tips).unionByName(other_tips.exceptAll(tips)).limit(1).collect()
    if odd:
        raise ValueError(f"tree {odd[0].tree_id} has the tip {odd[0].tip} on one side only")
    return rf_between(one=one, other=other)


@plan("node", "closure")
def unrooted_splits(d: Dialect) -> str:
    """Splits of the tips with more than one on both sides, as the side without the tip whose node is smallest."""
    member = """SELECT s.tree_id, s.ancestor, t.tip FROM side s JOIN tips t ON t.tree_id = s.tree_id LEFT JOIN inside i ON i.tree_id = s.tree_id AND i.ancestor = s.ancestor AND i.tip = t.tip
        WHERE (NOT s.has_first AND i.tip IS NOT NULL) OR (s.has_first AND i.tip IS NULL)"""
    if d.spark:  # only the few sides above the first tip meet all tips; the others have those below them
        member = """SELECT s.tree_id, s.ancestor, i.tip FROM side s JOIN inside i ON i.tree_id = s.tree_id AND i.ancestor = s.ancestor WHERE NOT s.has_first
        UNION ALL SELECT s.tree_id, s.ancestor, t.tip FROM (SELECT tree_id, ancestor FROM side WHERE has_first) s JOIN tips t ON t.tree_id = s.tree_id LEFT ANTI JOIN inside i ON i.tree_id = s.tree_id AND i.ancestor = s.ancestor AND i.tip = t.tip"""
    return f"""WITH tips AS (SELECT tree_id, node AS tip, count(*) OVER (PARTITION BY tree_id) AS n_tips, min(node) OVER (PARTITION BY tree_id) AS first FROM {{node}} WHERE is_leaf),
      side AS (SELECT c.tree_id, c.ancestor, t.n_tips, count(*) AS size, min(t.tip) = min(t.first) AS has_first FROM {{closure}} c JOIN tips t ON t.tree_id = c.tree_id AND t.tip = c.node
        JOIN {{node}} a ON a.tree_id = c.tree_id AND a.node = c.ancestor WHERE a.parent IS NOT NULL GROUP BY c.tree_id, c.ancestor, t.n_tips HAVING count(*) > 1 AND count(*) < t.n_tips - 1),
      inside AS (SELECT c.tree_id, c.ancestor, t.tip FROM {{closure}} c JOIN tips t ON t.tree_id = c.tree_id AND t.tip = c.node),
      member AS ({member})
      SELECT DISTINCT tree_id, split, size FROM (SELECT tree_id, ancestor, {d.collect("tip", "tip")} AS split, count(*) AS size FROM member GROUP BY tree_id, ancestor) x"""


@plan("node", "mut")
def node_bounds(d: Dialect) -> str:
    """Heights between which an internal node may move: above its children and the first event below, below its
    parent and the last event above."""
    return """WITH below AS (SELECT c.tree_id, c.parent AS node, max(c.height) AS h FROM {node} c WHERE c.parent IS NOT NULL GROUP BY c.tree_id, c.parent),
      mb AS (SELECT m.tree_id, c.parent AS node, max(m.time) AS h FROM {mut} m JOIN {node} c ON c.tree_id = m.tree_id AND c.node = m.node GROUP BY m.tree_id, c.parent),
      ma AS (SELECT tree_id, node, min(time) AS h FROM {mut} GROUP BY tree_id, node)
      SELECT n.tree_id, n.node, greatest(b.h, coalesce(mb.h, b.h)) AS lower, least(p.height, coalesce(ma.h, p.height)) AS upper
      FROM {node} n JOIN below b ON b.tree_id = n.tree_id AND b.node = n.node LEFT JOIN {node} p ON p.tree_id = n.tree_id AND p.node = n.parent
      LEFT JOIN mb ON mb.tree_id = n.tree_id AND mb.node = n.node LEFT JOIN ma ON ma.tree_id = n.tree_id AND ma.node = n.node"""


@plan("node", "stats")
def node_ratios(d: Dialect, whole: bool = True) -> str:
    """Height of an internal node but the root over its oldest tip, youngest tip, and zero, relative to its parent's and to
    the root's, null where that isn't above the mark; and its classes by size and by number of events. stats: the events of a subtree that moves are those below the node and
    on its own branch. Not whole: of the root's height over the oldest tip only."""
    def ratio(low: str, anchor: str) -> str:
        return f"round((n.height - {low}) / nullif({anchor}.height - {low}, 0), 6)"

    if whole:
        m = "least(s.mutations, 1073741823) + 1"  # its square is of the last class, and a number still
        over = ", ".join(f"{ratio(low, anchor)} AS {name}" for low, parent, root in (("s.oldest_tip", "over_oldest", "of_root"), ("s.youngest_tip", "over_youngest", "youngest_of_root"), ("0.0E0", "over_zero", "zero_of_root"))
                         for anchor, name in (("p", parent), ("r", root)))
    else:
        m = "s.mutations + 1"
        over = """round((n.height - s.oldest_tip) / (p.height - s.oldest_tip), 6) AS over_oldest, round((n.height - s.youngest_tip) / (p.height - s.youngest_tip), 6) AS over_youngest,
        round(n.height / p.height, 6) AS over_zero, round((n.height - s.oldest_tip) / (r.height - s.oldest_tip), 6) AS of_root"""
    return f"""SELECT n.tree_id, n.node, {over},
        CAST(length(bin(s.tips)) - 1 AS BIGINT) AS size_class, CAST(least(length(bin(({m}) * ({m}))) - 1, 59) AS BIGINT) AS mutation_class
      FROM {{node}} n JOIN {{node}} p ON p.tree_id = n.tree_id AND p.node = n.parent JOIN {{node}} r ON r.tree_id = n.tree_id AND r.parent IS NULL
      JOIN {{stats}} s ON s.tree_id = n.tree_id AND s.node = n.node WHERE NOT n.is_leaf"""


@plan("node", "branch_rate", "node_rate")
def decay_rate(d: Dialect) -> str:
    """By how much the log density falls when an inner node but the root is raised: the total rate of its sequence
    times the rates of the branches below less that of its own."""
    return """SELECT n.tree_id, n.node, round(l.total_rate * (sum(b.rate) - o.rate), 6) AS decay
      FROM {node} n JOIN {node} c ON c.tree_id = n.tree_id AND c.parent = n.node JOIN {branch_rate} b ON b.tree_id = c.tree_id AND b.node = c.node
      JOIN {branch_rate} o ON o.tree_id = n.tree_id AND o.node = n.node JOIN {node_rate} l ON l.tree_id = n.tree_id AND l.node = n.node
      WHERE n.parent IS NOT NULL GROUP BY n.tree_id, n.node, l.total_rate, o.rate"""


@plan("node", "closure")
def interval_scaled(d: Dialect, factor: float = 1.5) -> str:
    """Heights when each inner node's gap over its older child is scaled, from the tips up: a node is at the highest,
    over the tips below it, of the tip and the scaled gaps of the nodes between, its own among them."""
    return f"""WITH older AS (SELECT tree_id, parent AS node, max(height) AS h FROM {{node}} WHERE parent IS NOT NULL GROUP BY tree_id, parent),
      gaps AS (SELECT n.tree_id, n.node, n.height - o.h AS gap FROM {{node}} n JOIN older o ON o.tree_id = n.tree_id AND o.node = n.node),
      upto AS (SELECT c.tree_id, c.node, sum(coalesce(g.gap, 0.0E0)) AS total FROM {{closure}} c LEFT JOIN gaps g ON g.tree_id = c.tree_id AND g.node = c.ancestor GROUP BY c.tree_id, c.node)
      SELECT g.tree_id, g.node, g.gap, round(max(t.height + {factor!r} * (u.total - o.total + g.gap)), 9) AS scaled
      FROM gaps g JOIN {{closure}} c ON c.tree_id = g.tree_id AND c.ancestor = g.node JOIN {{node}} t ON t.tree_id = c.tree_id AND t.node = c.node AND t.is_leaf
      JOIN upto u ON u.tree_id = t.tree_id AND u.node = t.node JOIN upto o ON o.tree_id = g.tree_id AND o.node = g.node GROUP BY g.tree_id, g.node, g.gap"""


@plan("node")
def subtree_choice(d: Dialect) -> str:
    """Weights for choosing a subtree: nodes that are neither the root nor its children; uniform, and by length."""
    return """SELECT n.tree_id, n.node, round(1.0E0 / count(*) OVER (PARTITION BY n.tree_id), 6) AS uniform, round((p.height - n.height) / sum(p.height - n.height) OVER (PARTITION BY n.tree_id), 6) AS by_length
      FROM {node} n JOIN {node} p ON p.tree_id = n.tree_id AND p.node = n.parent WHERE p.parent IS NOT NULL"""


# Knots of a piecewise linear log rate, (height, log rate); constant beyond the last.
KNOTS = [(0.0, -1.0), (1.0, -0.5), (2.5, -1.2), (4.0, -1.5)]


@plan("node")
def time_change(d: Dialect) -> str:
    """Integral of a rate with piecewise linear logarithm from zero to the height of each node, and the log rate
    there: the heights cut at the knots, each part in closed form."""
    parts = []
    for i, (x, a) in enumerate(KNOTS):
        hi, b = (KNOTS[i + 1][0], (KNOTS[i + 1][1] - a) / (KNOTS[i + 1][0] - x)) if i + 1 < len(KNOTS) else (1e9, 0.0)
        parts.append(f"({x!r}E0, {hi!r}{'' if 'e' in repr(hi) else 'E0'}, {a!r}E0, {b!r}E0, 1)")
    return f"""SELECT n.tree_id, n.node, n.height, round(sum(CASE WHEN k.b = 0 THEN exp(k.a) * (least(n.height, k.hi) - k.lo) ELSE exp(k.a) * (exp(k.b * (least(n.height, k.hi) - k.lo)) - 1) / k.b END), 6) AS integral,
        round(max_by(k.a + k.b * (least(n.height, k.hi) - k.lo), k.lo), 6) AS log_rate
      FROM {{node}} n JOIN (VALUES {", ".join(parts)}) AS k(lo, hi, a, b, one) ON k.one = 1 AND n.height >= k.lo GROUP BY n.tree_id, n.node, n.height"""


#: Knots and slopes of the default piecewise linear slope.
SLOPES = ((0.0, -1.0), (1.0, -0.5), (2.5, -1.2), (4.0, -1.5))


def spline_text(height: str, source: str, keep: str, slopes=SLOPES) -> str:
    """Slope at a height, linear between knots and constant outside, and its integral from the first knot; negative
    below it. One pass over the rows: the few segments are branches of an expression."""
    inner, total = [], 0.0
    for (x, a), (y, b) in zip(slopes, slopes[1:]):
        change = (b - a) / (y - x)
        inner.append((y, f"{a!r}E0 + {change!r}E0 * ({height} - {x!r}E0)", f"{total!r}E0 + {a!r}E0 * ({height} - {x!r}E0) + {change / 2!r}E0 * ({height} - {x!r}E0) * ({height} - {x!r}E0)"))
        total += (a + b) / 2 * (y - x)
    (first, low), (last, high) = slopes[0], slopes[-1]

    def cases(value: int, below: str, above: str) -> str:
        return f"CASE WHEN {height} <= {first!r}E0 THEN {below} " + " ".join(f"WHEN {height} < {x[0]!r}E0 THEN {x[value]}" for x in inner) + f" WHEN {height} >= {last!r}E0 THEN {above} END"

    slope = cases(1, f"{low!r}E0", f"{high!r}E0")
    integral = cases(2, f"{low!r}E0 * ({height} - {first!r}E0)", f"{total!r}E0 + {high!r}E0 * ({height} - {last!r}E0)")
    return f"SELECT {keep}, {height} AS height, round({slope}, 6) AS slope, round({integral}, 6) + 0E0 AS integral FROM {source}"


@plan("node")
def spline_integral(d: Dialect) -> str:
    """Slope of a piecewise linear approximation at the height of each node, and its integral; null without a height."""
    return spline_text("height", "{node}", "tree_id, node")
