"""Regions in which a pruned subtree may be attached: stretches of branches between events, older than the subtree's top, each with the number of
sites at which its sequence differs from the subtree's; and those that can be reached from where the subtree is without passing one
with more differences than a threshold. chosen(tree_id, x): the node of each tree whose subtree is pruned."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import by_level, sized
from .sweeps import carried, places

REGION = ["tree_id", "node", "idx", "upper", "lower", "differences"]


def differences(node: DataFrame, mut: DataFrame, states: DataFrame, reference: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(change, counts) against the sequence of the chosen node. change: tree_id, node, site, time of the events and by how much each raises the number of sites that differ; counts:
    tree_id, node, above: that number at the top of each branch."""
    mine = chosen.join(states, (chosen["tree_id"] == states["tree_id"]) & (chosen["x"] == states["node"])).select(chosen["tree_id"], "site", F.col("state").alias("kept"))
    top = node.where("parent IS NULL").select("tree_id", F.col("node").alias("top"))
    at_root = top.join(states, (top["tree_id"] == states["tree_id"]) & (top["top"] == states["node"])).select(top["tree_id"], "site", F.col("state").alias("rooted"))
    base = reference.select("site", F.col("state").alias("base"))
    start = mine.join(at_root, ["tree_id", "site"], "full").join(base, "site").where("coalesce(kept, base) <> coalesce(rooted, base)").groupBy("tree_id").agg(F.count("*").alias("n"))
    change = mut.join(base, "site").join(mine, ["tree_id", "site"], "left").select(
        "tree_id", "node", "site", "time", F.expr("CASE WHEN old_state = coalesce(kept, base) THEN 1 WHEN new_state = coalesce(kept, base) THEN -1 ELSE 0 END").alias("change")
    )
    branch = by_level(places(node).join(change.groupBy("tree_id", "node").agg(F.sum("change").alias("change")).hint("merge"), ["tree_id", "node"], "left").fillna(0, ["change"]), "depth")
    first = branch.where("depth = 0").join(chosen, "tree_id").join(start, "tree_id", "left").select("tree_id", "node", F.lit(None).cast("long").alias("above"), F.coalesce("n", F.lit(0)).alias("at"))

    def step(upper: DataFrame, level: int) -> DataFrame:
        parent = upper.select("tree_id", F.col("node").alias("parent"), F.col("at").alias("above"))
        return branch.where(F.col("depth") == level).join(parent, ["tree_id", "parent"]).select("tree_id", "node", "above", (F.col("above") + F.col("change")).alias("at"))

    # levels are packed files, which look small enough to be sent to every executor
    counts = sized(carried(node, first, step).where("above IS NOT NULL").select("tree_id", "node", "above"))
    return change, counts


def attachment_regions(node: DataFrame, mut: DataFrame, states: DataFrame, reference: DataFrame, chosen: DataFrame) -> DataFrame:
    """REGION, first and last (whether it is the first or last one of its branch): idx counts from the top of a branch. An event brings the sequence one
    site nearer to the subtree's, or away from it, so differences are carried from the root down and along the branches; only the root's are
    counted. states: of all nodes, for the sites that changed on their path."""
    change, counts = differences(node, mut, states, reference, chosen)
    ends = node.alias("n").join(node.alias("p"), F.expr("n.tree_id = p.tree_id AND n.parent = p.node")).selectExpr("n.tree_id", "n.node", "n.height AS lo", "p.height AS hi").join(counts, ["tree_id", "node"])
    cuts = ends.selectExpr("tree_id", "node", "hi AS upper", "above AS change").unionByName(change.join(counts, ["tree_id", "node"]).selectExpr("tree_id", "node", "time AS upper", "CAST(change AS BIGINT) AS change"))
    w = Window.partitionBy("tree_id", "node").orderBy(F.desc("upper"), F.desc("origin"))
    # events at one time leave regions without a length, whose order doesn't matter
    marked = cuts.join(ends.select("tree_id", "node", "lo", "hi"), ["tree_id", "node"]).withColumn("origin", F.col("upper") == F.col("hi"))
    summed = marked.groupBy("tree_id", "node", "lo", "upper", "origin").agg(F.sum("change").alias("change"))
    regions = summed.select(
        "tree_id", "node", F.row_number().over(w).alias("idx"), "upper", F.coalesce(F.lead("upper").over(w), F.col("lo")).alias("ends"), F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("differences"),
        F.lead("upper").over(w).isNull().alias("last"),
    )
    old = chosen.join(node, (chosen["tree_id"] == node["tree_id"]) & (chosen["x"] == node["node"])).select(chosen["tree_id"], "x", F.col("height").alias("young"))
    return regions.join(old, "tree_id").where("node <> x AND upper > young AND upper > ends").select(
        "tree_id", "node", (F.col("idx") - 1).cast("long").alias("idx"), "upper", F.greatest("ends", "young").alias("lower"), "differences", (F.col("idx") == 1).alias("first"), (F.col("last") & (F.col("ends") >= F.col("young"))).alias("last")
    )


def explore(regions: DataFrame, node: DataFrame, chosen: DataFrame, extra: int = 1, shortcuts: DataFrame | None = None) -> DataFrame:
    """REGION of the regions reached: from the junction where the subtree is attached, along branches, through junctions and between tips that
    `shortcuts` (tree_id, a, b) names, while differences are at most max(1, those at the start) + extra. Stretches of regions on a branch within
    the threshold are one step, and each round takes all that are next to what is reached, until there is nothing new."""
    regions = sized(regions)
    parent = node.select("tree_id", "node", "parent")
    origin = chosen.join(parent, (chosen["tree_id"] == parent["tree_id"]) & (chosen["x"] == parent["node"])).select(chosen["tree_id"], "x", parent["parent"].alias("p"))
    # what touches a junction: the last region of its own branch and the first ones of its children's
    joints = regions.where("last").select("tree_id", "node", "idx", F.col("node").alias("joint"), "differences").unionByName(
        regions.where("first").join(parent, ["tree_id", "node"]).select("tree_id", "node", "idx", F.col("parent").alias("joint"), "differences")
    )
    began = origin.join(joints, (origin["tree_id"] == joints["tree_id"]) & (origin["p"] == joints["joint"])).groupBy(origin["tree_id"]).agg(F.max("differences").alias("n"))
    limit = began.select("tree_id", (F.greatest(F.lit(1), "n") + extra).alias("most"))
    within = regions.join(limit, "tree_id").where("differences <= most")
    order = Window.partitionBy("tree_id", "node").orderBy("idx")
    runs = sized(within.withColumn("run", F.col("idx") - F.row_number().over(order)))
    touch = runs.where("last").select("tree_id", "node", "run", F.col("node").alias("joint")).unionByName(runs.where("first").join(parent, ["tree_id", "node"]).select("tree_id", "node", "run", F.col("parent").alias("joint")))
    if shortcuts is not None:
        # a shortcut is a junction of two, named by the pair
        ends = shortcuts.select("tree_id", F.col("a").alias("node"), F.col("a").alias("lo"), F.col("b").alias("hi")).unionByName(shortcuts.select("tree_id", F.col("b").alias("node"), F.col("a").alias("lo"), F.col("b").alias("hi")))
        linked = runs.where("last").join(ends, ["tree_id", "node"]).select("tree_id", "node", "run", F.concat_ws("-", "lo", "hi").alias("joint"))
        touch = touch.withColumn("joint", F.col("joint").cast("string")).unionByName(linked)
    else:
        touch = touch.withColumn("joint", F.col("joint").cast("string"))
    touch = sized(touch)
    here = origin.select("tree_id", F.col("p").cast("string").alias("joint"))
    fresh = sized(touch.join(here, ["tree_id", "joint"]).select("tree_id", "node", "run").distinct())
    reached = fresh
    while not fresh.isEmpty():
        doors = touch.join(fresh, ["tree_id", "node", "run"]).select("tree_id", "joint").distinct()
        fresh = sized(touch.join(doors, ["tree_id", "joint"]).select("tree_id", "node", "run").distinct().join(reached, ["tree_id", "node", "run"], "left_anti"))
        reached = sized(reached.unionByName(fresh))
    return runs.join(reached, ["tree_id", "node", "run"]).select(*REGION)


def sorted_regions(node: DataFrame, mut: DataFrame, states: DataFrame, reference: DataFrame, chosen: DataFrame, radius: int = 2) -> DataFrame:
    """tree_id, node, idx, upper, lower, differences, movable: regions of the branches that are at most `radius` branches away, in the tree without the chosen subtree and
    its parent, from the branch the subtree is attached to, which isn't among them, over junctions older than the subtree's top. An event is
    movable if it brings the sequence nearer to the subtree's and is the only one at its site on the branch; movable events (how many a branch has) count as lying above all
    of its regions, the others that change the number of differences bound them. Subtrees below a child of the root aren't explored. A join for each step of the radius."""
    if radius < 0:
        raise ValueError("the radius must not be negative")
    change, counts = differences(node, mut, states, reference, chosen)
    place = node.select("tree_id", "node", "parent", "height")

    def of(name: str, **names: str) -> DataFrame:
        return place.select("tree_id", F.col("node").alias(name), *(F.col(k).alias(v) for k, v in names.items()))

    # x is pruned, p goes, and its other child s takes the branch up to g
    pruned = chosen.join(of("x", parent="p", height="young"), ["tree_id", "x"]).join(of("p", parent="g"), ["tree_id", "p"]).where("g IS NOT NULL")
    sibling = pruned.join(place.select("tree_id", F.col("parent").alias("p"), F.col("node").alias("s")), ["tree_id", "p"]).where("s <> x")
    sibling = sized(sibling.select("tree_id", "x", "p", "g", "s", "young"))
    joined = place.join(sibling, "tree_id").where("parent IS NOT NULL AND node <> x AND node <> p").select(
        "tree_id", "node", F.when(F.col("node") == F.col("s"), F.col("g")).otherwise(F.col("parent")).alias("top"), F.when(F.col("node") == F.col("s"), F.col("p")).otherwise(F.col("node")).alias("upper_node"), "height", "young", (F.col("node") == F.col("s")).alias("start")
    )
    branch = sized(joined.join(of("top", height="upper"), ["tree_id", "top"]).join(counts.withColumnRenamed("node", "upper_node"), ["tree_id", "upper_node"]))
    sides = branch.select("tree_id", "node", "start", F.col("top").alias("joint"), F.when(F.col("height") > F.col("young"), F.col("node")).alias("to")).unionByName(branch.select("tree_id", "node", "start", F.col("node").alias("joint"), F.col("top").alias("to")))
    fresh = branch.where("start").select("tree_id", F.explode(F.array(F.col("top"), F.when(F.col("height") > F.col("young"), F.col("node")))).alias("joint")).where("joint IS NOT NULL")
    seen = branch.where("start").select("tree_id", "node")
    for _ in range(radius):
        touched = sides.join(fresh, ["tree_id", "joint"]).join(seen, ["tree_id", "node"], "left_anti").select("tree_id", "node", "to").distinct()
        touched = sized(touched)
        fresh = touched.where("to IS NOT NULL").select("tree_id", F.col("to").alias("joint")).distinct()
        seen = sized(seen.unionByName(touched.select("tree_id", "node").distinct()))
    found = branch.where("NOT start").join(seen, ["tree_id", "node"])
    at = Window.partitionBy("tree_id", "node")
    events = change.join(found.select("tree_id", "node"), ["tree_id", "node"]).withColumn("movable", (F.col("change") < 0) & (F.count("*").over(Window.partitionBy("tree_id", "node", "site")) == 1))
    moved = events.groupBy("tree_id", "node").agg(F.sum(F.when(F.col("movable"), 1).otherwise(0)).alias("movable"))
    tops = found.join(moved, ["tree_id", "node"], "left").fillna(0, ["movable"])
    cuts = tops.selectExpr("tree_id", "node", "upper", "above - movable AS change", "true AS origin").unionByName(events.where("NOT movable AND change <> 0").groupBy("tree_id", "node", F.col("time").alias("upper")).agg(F.sum("change").alias("change")).withColumn("origin", F.lit(False)))
    order = at.orderBy(F.desc("upper"), F.desc("origin"))
    regions = cuts.select("tree_id", "node", "upper", F.lead("upper").over(order).alias("next"), F.sum("change").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("differences"), (F.row_number().over(order) - 1).cast("long").alias("idx"))
    out = regions.join(tops.select("tree_id", "node", "height", "young", "movable"), ["tree_id", "node"]).withColumn("lower", F.greatest(F.coalesce("next", "height"), "young"))
    return out.where("upper > lower").select("tree_id", "node", "idx", "upper", "lower", "differences", "movable")


def sorted_text(radius: int) -> str:
    """The same for a second engine, over the views node, mut, carried, reference and chosen: states compared site by site, junctions walked one by one."""
    return f"""WITH RECURSIVE pruned AS (SELECT c.tree_id, c.x, x.parent AS p, p.parent AS g, s.node AS s, x.height AS young FROM chosen c JOIN node x ON x.tree_id = c.tree_id AND x.node = c.x JOIN node p ON p.tree_id = x.tree_id AND p.node = x.parent
          JOIN node s ON s.tree_id = p.tree_id AND s.parent = p.node AND s.node <> c.x WHERE p.parent IS NOT NULL),
      branch AS (SELECT n.tree_id, n.node, CASE WHEN n.node = q.s THEN q.g ELSE n.parent END AS top, n.height, q.young, n.node = q.s AS start, q.x FROM node n JOIN pruned q ON q.tree_id = n.tree_id WHERE n.parent IS NOT NULL AND n.node <> q.x AND n.node <> q.p),
      walk AS (SELECT tree_id, top AS joint, 0 AS depth FROM branch WHERE start UNION SELECT tree_id, node, 0 FROM branch WHERE start AND height > young
        UNION SELECT w.tree_id, CASE WHEN b.top = w.joint THEN b.node ELSE b.top END, w.depth + 1 FROM walk w JOIN branch b ON b.tree_id = w.tree_id AND NOT b.start AND (b.top = w.joint OR b.node = w.joint) AND (b.node = w.joint OR b.height > b.young) WHERE w.depth < {radius}),
      found AS (SELECT DISTINCT b.* FROM branch b JOIN walk w ON w.tree_id = b.tree_id AND w.depth < {radius} AND (b.top = w.joint OR b.node = w.joint) WHERE NOT b.start),
      wanted AS (SELECT q.tree_id, r.site, coalesce(s.state, r.state) AS state FROM pruned q JOIN reference r ON r.site >= 0 LEFT JOIN carried s ON s.tree_id = q.tree_id AND s.node = q.x AND s.site = r.site),
      tops AS (SELECT f.tree_id, f.node, n.height AS upper, count(*) FILTER (WHERE coalesce(s.state, r.state) <> w.state) AS above FROM found f JOIN node n ON n.tree_id = f.tree_id AND n.node = f.top JOIN wanted w ON w.tree_id = f.tree_id JOIN reference r ON r.site = w.site
        LEFT JOIN carried s ON s.tree_id = f.tree_id AND s.node = f.top AND s.site = w.site GROUP BY ALL),
      events AS (SELECT m.tree_id, m.node, m.site, m.time, CASE WHEN m.old_state = w.state THEN 1 WHEN m.new_state = w.state THEN -1 ELSE 0 END AS change, count(*) OVER (PARTITION BY m.tree_id, m.node, m.site) AS n
        FROM mut m JOIN found f ON f.tree_id = m.tree_id AND f.node = m.node JOIN wanted w ON w.tree_id = m.tree_id AND w.site = m.site),
      moved AS (SELECT t.tree_id, t.node, t.upper, t.above, count(*) FILTER (WHERE e.change < 0 AND e.n = 1) AS movable FROM tops t LEFT JOIN events e ON e.tree_id = t.tree_id AND e.node = t.node GROUP BY ALL),
      cuts AS (SELECT tree_id, node, upper, above - movable AS change, 1 AS origin FROM moved UNION ALL SELECT tree_id, node, time, sum(change), 0 FROM events WHERE change > 0 OR (change < 0 AND n > 1) GROUP BY tree_id, node, time),
      raw AS (SELECT tree_id, node, upper, lead(upper) OVER w AS next, CAST(sum(change) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS differences, row_number() OVER w - 1 AS idx FROM cuts WINDOW w AS (PARTITION BY tree_id, node ORDER BY upper DESC, origin DESC))
      SELECT r.tree_id, r.node, r.idx, r.upper, greatest(coalesce(r.next, f.height), f.young) AS lower, r.differences, m.movable FROM raw r JOIN found f ON f.tree_id = r.tree_id AND f.node = r.node JOIN moved m ON m.tree_id = r.tree_id AND m.node = r.node
      WHERE r.upper > greatest(coalesce(r.next, f.height), f.young)"""


def explored_text(extra: int) -> str:
    """The same for a second engine, over the views node, mut, carried, reference, chosen and shortcut: differences of a region's top by comparing
    states, regions reached one by one."""
    return f"""WITH RECURSIVE kept AS (SELECT c.tree_id, s.site, s.state FROM chosen c JOIN carried s ON s.tree_id = c.tree_id AND s.node = c.x),
      cells AS (SELECT n.tree_id, n.node, r.site, coalesce(s.state, r.state) AS state, coalesce(k.state, r.state) AS wanted FROM node n JOIN chosen c ON c.tree_id = n.tree_id JOIN reference r ON r.site >= 0
        LEFT JOIN carried s ON s.tree_id = n.tree_id AND s.node = n.node AND s.site = r.site LEFT JOIN kept k ON k.tree_id = n.tree_id AND k.site = r.site),
      apart AS (SELECT tree_id, node, count(*) FILTER (WHERE state <> wanted) AS n FROM cells GROUP BY ALL),
      cuts AS (SELECT n.tree_id, n.node, p.height AS upper, a.n AS change, true AS origin FROM node n JOIN node p ON p.tree_id = n.tree_id AND p.node = n.parent JOIN apart a ON a.tree_id = p.tree_id AND a.node = p.node
        UNION ALL SELECT m.tree_id, m.node, m.time, CAST(sum(CASE WHEN m.old_state = w.wanted THEN 1 WHEN m.new_state = w.wanted THEN -1 ELSE 0 END) AS BIGINT), m.time = min(p.height) FROM mut m JOIN cells w ON w.tree_id = m.tree_id AND w.node = m.node AND w.site = m.site
          JOIN node n ON n.tree_id = m.tree_id AND n.node = m.node JOIN node p ON p.tree_id = n.tree_id AND p.node = n.parent GROUP BY m.tree_id, m.node, m.time),
      merged AS (SELECT tree_id, node, upper, origin, sum(change) AS change FROM cuts GROUP BY ALL),
      raw AS (SELECT m.tree_id, m.node, m.upper, coalesce(lead(m.upper) OVER w, n.height) AS ends, CAST(sum(m.change) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS differences, row_number() OVER w - 1 AS idx, lead(m.upper) OVER w IS NULL AS last
        FROM merged m JOIN node n ON n.tree_id = m.tree_id AND n.node = m.node WINDOW w AS (PARTITION BY m.tree_id, m.node ORDER BY m.upper DESC, m.origin DESC)),
      regions AS (SELECT r.tree_id, r.node, r.idx, r.upper, greatest(r.ends, x.height) AS lower, r.differences, r.last AND r.ends >= x.height AS last, n.parent
        FROM raw r JOIN chosen c ON c.tree_id = r.tree_id JOIN node x ON x.tree_id = c.tree_id AND x.node = c.x JOIN node n ON n.tree_id = r.tree_id AND n.node = r.node WHERE r.node <> c.x AND r.upper > x.height AND r.upper > r.ends),
      joints AS (SELECT tree_id, node, idx, node AS joint, differences FROM regions WHERE last UNION ALL SELECT tree_id, node, idx, parent, differences FROM regions WHERE idx = 0),
      origin AS (SELECT c.tree_id, n.parent AS p FROM chosen c JOIN node n ON n.tree_id = c.tree_id AND n.node = c.x),
      most AS (SELECT o.tree_id, greatest(1, max(j.differences)) + {extra} AS most FROM origin o JOIN joints j ON j.tree_id = o.tree_id AND j.joint = o.p GROUP BY o.tree_id),
      good AS (SELECT r.* FROM regions r JOIN most m ON m.tree_id = r.tree_id WHERE r.differences <= m.most),
      tied AS (SELECT tree_id, node, idx, CAST(node AS VARCHAR) AS joint FROM good WHERE last UNION ALL SELECT tree_id, node, idx, CAST(parent AS VARCHAR) FROM good WHERE idx = 0
        UNION ALL SELECT g.tree_id, g.node, g.idx, concat(s.a, '-', s.b) FROM good g JOIN shortcut s ON s.tree_id = g.tree_id AND g.last AND (g.node = s.a OR g.node = s.b)),
      step AS (SELECT a.tree_id, a.node, a.idx, b.node AS to_node, b.idx AS to_idx FROM tied a JOIN tied b ON b.tree_id = a.tree_id AND b.joint = a.joint
        UNION SELECT a.tree_id, a.node, a.idx, b.node, b.idx FROM good a JOIN good b ON b.tree_id = a.tree_id AND b.node = a.node AND abs(b.idx - a.idx) = 1),
      walk AS (SELECT t.tree_id, t.node, t.idx FROM tied t JOIN origin o ON o.tree_id = t.tree_id AND t.joint = CAST(o.p AS VARCHAR)
        UNION SELECT s.tree_id, s.to_node, s.to_idx FROM walk w JOIN step s ON s.tree_id = w.tree_id AND s.node = w.node AND s.idx = w.idx)
      SELECT g.tree_id, g.node, g.idx, g.upper, g.lower, g.differences FROM good g JOIN walk w ON w.tree_id = g.tree_id AND w.node = g.node AND w.idx = g.idx"""
