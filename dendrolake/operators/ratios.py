"""Heights of inner nodes as ratios between what lies below them and a node above, the way back, and classes of nodes by size and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import by_level
from ..plans.plan import Dialect, plan
from .sweeps import carried, places

# Numbers of classes by events, and of groups.
CLASSES, GROUPS = 60, 16

LOW = {"oldest": "s.oldest_tip", "youngest": "s.youngest_tip", "zero": "0.0E0"}


@plan("node", "stats")
def anchored_ratios(d: Dialect, low: str = "oldest", anchor: str = "parent") -> str:
    """Ratios of inner nodes but the root: their height above a low mark, over their anchor's. low: the oldest or youngest tip below, or zero; anchor: parent or root.
    Null where the anchor isn't above the mark."""
    above = {"parent": "p.node = n.parent", "root": "p.parent IS NULL"}[anchor]
    return f"""SELECT n.tree_id, n.node, {LOW[low]} AS low, (n.height - {LOW[low]}) / nullif(p.height - {LOW[low]}, 0) AS ratio
      FROM {{node}} n JOIN {{node}} p ON p.tree_id = n.tree_id AND {above} JOIN {{stats}} s ON s.tree_id = n.tree_id AND s.node = n.node WHERE n.parent IS NOT NULL AND NOT n.is_leaf"""


@plan("ratios")
def ratio_rows(d: Dialect) -> str:
    return "SELECT tree_id, node, low, round(ratio, 9) AS ratio FROM {ratios}"


def heights_from_ratios(node: DataFrame, ratios: DataFrame, root_height: DataFrame, anchor: str = "parent") -> DataFrame:
    """tree_id, node, height, log_jacobian: heights of inner nodes from their ratios (tree_id, node, low, ratio) and the height of the root (tree_id, height), from the
    root down, a join for each level; tips keep theirs and aren't listed. log_jacobian: of a node's map, the log of its anchor's new over its old
    distance to the mark; null where the anchor doesn't lie above it, as no such tree exists."""
    inner = node.where("NOT is_leaf")
    above = inner.select("tree_id", F.col("node").alias("parent"), F.col("height").alias("old_anchor"))
    root = node.where("parent IS NULL").select("tree_id", F.col("height").alias("old_root"))
    own = places(inner).join(ratios.hint("merge"), ["tree_id", "node"])
    top = places(node).where("parent IS NULL").join(root_height, "tree_id").select("tree_id", "node", "height", F.lit(0.0).alias("log_jacobian"))

    def placed(rows: DataFrame, old: str) -> DataFrame:
        to = F.col("anchor") - F.col("low")
        ratio = F.try_divide(to, F.col(old) - F.col("low"))
        return rows.select("tree_id", "node", (F.col("low") + F.col("ratio") * to).alias("height"), F.when(ratio > 0, F.log(ratio)).alias("log_jacobian"))

    if anchor == "root":
        return top.unionByName(placed(own.join(root, "tree_id").join(root_height.withColumnRenamed("height", "anchor"), "tree_id"), "old_root"))
    rows = by_level(own.join(above.hint("merge"), ["tree_id", "parent"]), "depth")

    def step(upper: DataFrame, level: int) -> DataFrame:
        parent = upper.select("tree_id", F.col("node").alias("parent"), F.col("height").alias("anchor"))
        return placed(rows.where(F.col("depth") == level).join(parent, ["tree_id", "parent"]), "old_anchor")

    return carried(node, top, step)


def heights_text(low: str, factor: float) -> str:
    """For a second engine: heights and Jacobians when the root's height above its oldest tip is scaled, over the views node, stats and ratios."""
    return f"""WITH RECURSIVE r AS (SELECT n.tree_id, n.node, s.oldest_tip + (n.height - s.oldest_tip) * {factor!r} AS height, n.height AS old, CAST(0 AS DOUBLE) AS log_jacobian FROM node n JOIN stats s ON s.tree_id = n.tree_id AND s.node = n.node WHERE n.parent IS NULL
        UNION ALL SELECT n.tree_id, n.node, q.low + q.ratio * (r.height - q.low), n.height, ln((r.height - q.low) / (r.old - q.low)) FROM r JOIN node n ON n.tree_id = r.tree_id AND n.parent = r.node JOIN ratios q ON q.tree_id = n.tree_id AND q.node = n.node)
      SELECT tree_id, node, round(height, 6) AS height, round(log_jacobian, 6) AS log_jacobian FROM r"""


def _octave(d: Dialect, n: str) -> str:
    """The whole part of the binary logarithm, from the number's length."""
    return f"CAST(length(bin({n})) - 1 AS BIGINT)"


@plan("node", "mut", "stats")
def node_classes(d: Dialect) -> str:
    """Classes of inner nodes: by tips below (whole binary logarithm), by events below (twice that of one more, at most the last class), and the group by the events on its own
    branch and its children's. Events above the root are counted for it."""
    m = "least(s.mutations, 1073741823) + 1"  # its square is of the last class, and a number still
    return f"""WITH own AS (SELECT tree_id, node, count(*) AS m FROM {{mut}} GROUP BY tree_id, node),
      near AS (SELECT tree_id, node, sum(m) AS m FROM (SELECT tree_id, node, m FROM own UNION ALL SELECT o.tree_id, n.parent, o.m FROM own o JOIN {{node}} n ON n.tree_id = o.tree_id AND n.node = o.node WHERE n.parent IS NOT NULL) x GROUP BY tree_id, node)
      SELECT n.tree_id, n.node, {_octave(d, "s.tips")} AS size_class, least({_octave(d, f"({m}) * ({m})")}, {CLASSES - 1}) AS mutation_class, least({_octave(d, "CAST(coalesce(e.m, 0) + 1 AS BIGINT)")}, {GROUPS - 1}) AS event_group
      FROM {{node}} n JOIN {{stats}} s ON s.tree_id = n.tree_id AND s.node = n.node LEFT JOIN near e ON e.tree_id = n.tree_id AND e.node = n.node WHERE NOT n.is_leaf"""


@plan("ratios", "classes")
def odds_fit(d: Dialect) -> str:
    """Gamma distributions of the odds of ratios, r / (1 - r), of each class of sizes: how many, their mean and mean logarithm, shape and scale by the closed form
    for the logarithm of the mean less the mean logarithm; null where that isn't above zero. Ratios outside of zero to one have no odds."""
    shape = "(3 - s + sqrt((s - 3) * (s - 3) + 24 * s)) / (12 * s)"
    return f"""WITH o AS (SELECT c.size_class, r.ratio / (1 - r.ratio) AS odds FROM {{ratios}} r JOIN {{classes}} c ON c.tree_id = r.tree_id AND c.node = r.node WHERE r.ratio > 0 AND r.ratio < 1),
      m AS (SELECT size_class, count(*) AS n, avg(odds) AS mean, avg(ln(odds)) AS mean_log FROM o GROUP BY size_class), t AS (SELECT m.*, CASE WHEN ln(mean) - mean_log > 1.0E-12 THEN ln(mean) - mean_log END AS s FROM m)
      SELECT size_class, n, round(mean, 6) AS mean, round(mean_log, 6) AS mean_log, round({shape}, 5) AS shape, round(mean / ({shape}), 5) AS scale FROM t"""
