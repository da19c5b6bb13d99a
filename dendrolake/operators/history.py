"""Event histories on trees: mut(tree_id, node, time, site, old_state, new_state). A branch belongs to the node
below it; later events have smaller heights."""

from __future__ import annotations

from ..plans.plan import Dialect, plan


@plan("mut")
def linked_mutations(d: Dialect) -> str:
    """Each event with the time of the one before it at the same site of the same branch."""
    return "SELECT tree_id, node, site, time, lag(time) OVER (PARTITION BY tree_id, node, site ORDER BY time DESC) AS prev_time, old_state, new_state FROM {mut}"


@plan("node", "mut")
def branch_split(d: Dialect) -> str:
    """Branches cut in the middle: events at or above the cut are in the upper part; links start anew below."""
    return """WITH x AS (SELECT m.tree_id, m.node, m.site, m.time, m.time >= (n.height + p.height) / 2 AS upper FROM {mut} m
        JOIN {node} n ON n.tree_id = m.tree_id AND n.node = m.node JOIN {node} p ON p.tree_id = n.tree_id AND p.node = n.parent)
      SELECT tree_id, node, upper, site, time, lag(time) OVER (PARTITION BY tree_id, node, upper, site ORDER BY time DESC) AS prev_time FROM x"""


@plan("node", "linked")
def branch_join(d: Dialect) -> str:
    """The branches above and below a node as one: only the first events below are linked anew."""
    return """WITH x AS (SELECT tree_id, node AS joined, site, time, prev_time, true AS below FROM {linked}
        UNION ALL SELECT c.tree_id, c.node, l.site, l.time, l.prev_time, false FROM {linked} l JOIN {node} c ON c.tree_id = l.tree_id AND c.parent = l.node)
      SELECT tree_id, joined, site, time, below, lag(time) OVER (PARTITION BY tree_id, joined, site ORDER BY time DESC) AS prev_time FROM x"""


@plan("node", "mut")
def mutation_count(d: Dialect) -> str:
    """Events of a tree, those above the root excluded."""
    return """SELECT m.tree_id, count(*) AS mutations, count(DISTINCT m.site) AS sites FROM {mut} m JOIN {node} n ON n.tree_id = m.tree_id AND n.node = m.node
      WHERE n.parent IS NOT NULL GROUP BY m.tree_id"""


@plan("mut")
def transition_counts(d: Dialect) -> str:
    """Events by old and new state, and as one text."""
    return f"""WITH c AS (SELECT tree_id, old_state, new_state, count(*) AS n FROM {{mut}} GROUP BY tree_id, old_state, new_state)
      SELECT tree_id, {d.listagg(f"concat(CAST(old_state AS {d.text}), '>', CAST(new_state AS {d.text}), ':', CAST(n AS {d.text}))", ",", "old_state, new_state")} AS counts, CAST(sum(n) AS BIGINT) AS total
      FROM c GROUP BY tree_id"""


@plan("node", "reference", "mut", "carried")
def violations(d: Dialect) -> str:
    """Events that break an integrity rule: K2 nothing changes, K4 outside the branch, K9 the old state isn't
    the new state of the event before, or of the ancestors, or the reference. Times above the root mean nothing. carried: the states at all nodes."""
    return """WITH x AS (SELECT m.tree_id, m.node, m.site, m.time, m.old_state, m.new_state, n.parent, n.height AS lo, p.height AS hi,
        lag(m.new_state) OVER (PARTITION BY m.tree_id, m.node, m.site ORDER BY m.time DESC, m.new_state) AS before
        FROM {mut} m LEFT JOIN {node} n ON n.tree_id = m.tree_id AND n.node = m.node LEFT JOIN {node} p ON p.tree_id = n.tree_id AND p.node = n.parent),
      y AS (SELECT x.*, coalesce(x.before, a.state, r.state) AS expected FROM x LEFT JOIN {carried} a ON a.tree_id = x.tree_id AND a.node = x.parent AND a.site = x.site
        LEFT JOIN {reference} r ON r.site = x.site)
      SELECT 'K2' AS rule, tree_id, node, site, time FROM y WHERE old_state = new_state
      UNION ALL SELECT 'K4', tree_id, node, site, time FROM y WHERE parent IS NOT NULL AND (time < lo OR time > hi)
      UNION ALL SELECT 'K9', tree_id, node, site, time FROM y WHERE old_state <> expected"""


@plan("node", "reference", "listed")
def list_violations(d: Dialect) -> str:
    """Entries of stored event lists that break a rule. listed(tree_id, node, pos, branch, time, prev_time, site, old_state, new_state): the lists of the nodes in
    their order, with the branch that each event says it is on and the time of the event before it at its site. K1: it says another branch. K2: nothing
    changes. K3: above the root, the old state isn't that of the event before in the list, or the reference's. Below the root: K4 the time is off the
    branch; K5 the time before is; K6 it is before the one before; K7 the list isn't in order; K8 the first at a site, and only it, has none before; K9 the
    old state, K9t the time before, isn't that of the event before at the site."""
    at = "OVER (PARTITION BY m.tree_id, m.node, m.site ORDER BY m.pos)"
    rules = [
        ("K1", "branch <> node"), ("K2", "old_state = new_state"), ("K3", "top AND old_state <> coalesce(before_state, base)"), ("K4", "NOT top AND (time > hi OR time < lo)"),
        ("K5", "NOT top AND (prev_time > hi OR prev_time < lo)"), ("K6", "NOT top AND time > prev_time"), ("K7", "NOT top AND time > listed_before"), ("K8", "NOT top AND (nth = 1) <> (prev_time IS NULL)"),
        ("K9", "NOT top AND old_state <> before_state"), ("K9t", "NOT top AND nth > 1 AND prev_time <> before_time"),
    ]
    parts = " UNION ALL ".join(f"SELECT '{rule}' AS rule, tree_id, node, pos, site FROM x WHERE {broken}" for rule, broken in rules)
    return f"""WITH x AS (SELECT m.tree_id, m.node, m.pos, m.branch, m.time, m.prev_time, m.site, m.old_state, m.new_state, n.parent IS NULL AS top, n.height AS lo, p.height AS hi, r.state AS base,
        lag(m.new_state) {at} AS before_state, lag(m.time) {at} AS before_time, row_number() {at} AS nth, lag(m.time) OVER (PARTITION BY m.tree_id, m.node ORDER BY m.pos) AS listed_before
        FROM {{listed}} m JOIN {{node}} n ON n.tree_id = m.tree_id AND n.node = m.node LEFT JOIN {{node}} p ON p.tree_id = n.tree_id AND p.node = n.parent LEFT JOIN {{reference}} r ON r.site = m.site) {parts}"""


@plan("node", "linked")
def link_violations(d: Dialect) -> str:
    """Rules of the stored links: K1 the branch exists, K5 the previous time lies on the branch, K6 it isn't
    later, K8 first events, and only these, have none."""
    return """WITH x AS (SELECT l.tree_id, l.node, l.site, l.time, l.prev_time, n.node AS found, p.height AS hi, n.height AS lo,
        row_number() OVER (PARTITION BY l.tree_id, l.node, l.site ORDER BY l.time DESC) AS nth
        FROM {linked} l LEFT JOIN {node} n ON n.tree_id = l.tree_id AND n.node = l.node LEFT JOIN {node} p ON p.tree_id = n.tree_id AND p.node = n.parent)
      SELECT tree_id, count(*) AS events, count(*) FILTER (WHERE found IS NULL) AS k1, count(*) FILTER (WHERE prev_time > hi OR prev_time < lo) AS k5,
        count(*) FILTER (WHERE time > prev_time) AS k6, count(*) FILTER (WHERE (nth = 1) <> (prev_time IS NULL)) AS k8 FROM x GROUP BY tree_id"""


@plan("carried", "reference")
def state_at_node(d: Dialect) -> str:
    """The state of each node at the sites that changed on its path: the last event's, elsewhere the reference's. carried: tree_id, node, site, state."""
    return "SELECT a.tree_id, a.node, a.site, a.state, a.state <> r.state AS changed FROM {carried} a JOIN {reference} r ON a.site = r.site"


@plan("mut", "closure")
def path_changes(d: Dialect) -> str:
    """For each tip and site: state before the first and after the last event on the path from the root."""
    return """WITH p AS (SELECT c.tree_id, c.node, m.site, m.time, m.old_state, m.new_state FROM {closure} c JOIN {mut} m ON m.tree_id = c.tree_id AND m.node = c.ancestor)
      SELECT tree_id, node, site, max_by(old_state, time) AS start_state, min_by(new_state, time) AS end_state, count(*) AS events FROM p GROUP BY tree_id, node, site"""


@plan("carried", "reference", "node")
def differing_sites(d: Dialect) -> str:
    """Sites at which each node and its sibling differ."""
    if d.spark:  # states meet pairs only, each of which then has its sites: all states are sorted twice, not four times, and no pairs of nodes and sites are made distinct
        return f"""WITH pair AS (SELECT {d.merge("b")}DISTINCT a.tree_id, a.node AS x, b.node AS y FROM {{node}} a JOIN {{node}} b ON b.tree_id = a.tree_id AND b.parent = a.parent AND a.node < b.node),
          of_x AS (SELECT p.tree_id, p.x, p.y, c.site, c.state FROM pair p JOIN {{carried}} c ON c.tree_id = p.tree_id AND c.node = p.x),
          of_y AS (SELECT p.tree_id, p.x, p.y, c.site, c.state FROM pair p JOIN {{carried}} c ON c.tree_id = p.tree_id AND c.node = p.y),
          both AS (SELECT {d.merge("b")}coalesce(a.tree_id, b.tree_id) AS tree_id, coalesce(a.x, b.x) AS x, coalesce(a.y, b.y) AS y, coalesce(a.site, b.site) AS site, a.state AS a, b.state AS b
            FROM of_x a FULL OUTER JOIN of_y b ON b.tree_id = a.tree_id AND b.x = a.x AND b.y = a.y AND b.site = a.site)
          SELECT s.tree_id, s.x, s.y, count(*) AS compared, count(*) FILTER (WHERE coalesce(s.a, r.state) <> coalesce(s.b, r.state)) AS differing
          FROM both s JOIN {{reference}} r ON r.site = s.site GROUP BY s.tree_id, s.x, s.y"""
    return """WITH pair AS (SELECT a.tree_id, a.node AS x, b.node AS y FROM {node} a JOIN {node} b ON b.tree_id = a.tree_id AND b.parent = a.parent AND a.node < b.node),
      sites AS (SELECT p.tree_id, p.x, p.y, a.site FROM pair p JOIN {carried} a ON a.tree_id = p.tree_id AND a.node = p.x
        UNION SELECT p.tree_id, p.x, p.y, a.site FROM pair p JOIN {carried} a ON a.tree_id = p.tree_id AND a.node = p.y)
      SELECT s.tree_id, s.x, s.y, count(*) AS compared, count(*) FILTER (WHERE coalesce(a.state, r.state) <> coalesce(b.state, r.state)) AS differing
      FROM sites s JOIN {reference} r ON r.site = s.site LEFT JOIN {carried} a ON a.tree_id = s.tree_id AND a.node = s.x AND a.site = s.site
      LEFT JOIN {carried} b ON b.tree_id = s.tree_id AND b.node = s.y AND b.site = s.site GROUP BY s.tree_id, s.x, s.y"""


@plan("node", "mut")
def map_times(d: Dialect) -> str:
    """Events moved to branches whose ends are scaled by two, and the sum of the logs of the length ratios."""
    return f"""WITH b AS (SELECT n.tree_id, n.node, n.height AS lo, p.height AS hi, n.height * 2 AS new_lo, p.height * 2 AS new_hi FROM {{node}} n JOIN {{node}} p ON p.tree_id = n.tree_id AND p.node = n.parent)
      SELECT {d.merge("m")}m.tree_id, m.node, round(sum(least(b.new_hi, greatest(b.new_lo, b.new_lo + (m.time - b.lo) * (b.new_hi - b.new_lo) / (b.hi - b.lo)))), 6) AS times,
        round(sum(ln((b.new_hi - b.new_lo) / (b.hi - b.lo))), 6) AS log_ratio FROM {{mut}} m JOIN b ON b.tree_id = m.tree_id AND b.node = m.node GROUP BY m.tree_id, m.node"""


@plan("node", "mut")
def branch_regions(d: Dialect) -> str:
    """Branches cut at their events into stretches of constant sequence, with running numbers of events."""
    return """WITH e AS (SELECT tree_id, node, time, count(*) AS changes FROM {mut} GROUP BY tree_id, node, time),
      cut AS (SELECT n.tree_id, n.node, p.height AS upper, 0 AS changes FROM {node} n JOIN {node} p ON p.tree_id = n.tree_id AND p.node = n.parent
        UNION ALL SELECT tree_id, node, time, changes FROM e),
      r AS (SELECT c.tree_id, c.node, c.upper, coalesce(lead(c.upper) OVER (PARTITION BY c.tree_id, c.node ORDER BY c.upper DESC), n.height) AS lower,
        CAST(sum(c.changes) OVER (PARTITION BY c.tree_id, c.node ORDER BY c.upper DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS differences
        FROM cut c JOIN {node} n ON n.tree_id = c.tree_id AND n.node = c.node)
      SELECT tree_id, node, upper, lower, differences FROM r WHERE upper > lower"""


@plan("regions")
def region_weights(d: Dialect, height: float = 0.0, total_rate: float = 2.0, sites: int = 64, annealing: float = 0.5) -> str:
    """The regions in which a subtree at `height` may be attached, each with its log weight, the length above it times the annealed
    density of the number of differences over the distance of the region's middle from the subtree; and its weight relative to the
    largest of its tree. Of the tree: the largest log weight, the log of the total, and the number of regions.
    total_rate: of the subtree's sequence; a region that ends below the height begins there."""
    return f"""WITH r AS (SELECT tree_id, node, upper, greatest(lower, {height!r}) AS lower, differences FROM {{regions}} WHERE upper > {height!r}),
      x AS (SELECT tree_id, node, upper, lower, differences, (upper + lower) / 2 - {height!r} AS distance FROM r),
      w AS (SELECT tree_id, node, upper, lower, differences, ln(upper - lower) + {annealing!r} * (-{total_rate!r} * distance + differences * ln({total_rate!r} * distance / {3.0 * sites!r})) AS lw FROM x),
      m AS (SELECT tree_id, max(lw) AS top FROM w GROUP BY tree_id),
      t AS (SELECT w.tree_id, m.top, sum(exp(w.lw - m.top)) AS total, count(*) AS regions FROM w JOIN m ON w.tree_id = m.tree_id GROUP BY w.tree_id, m.top)
      SELECT w.tree_id, w.node, w.upper, w.lower, w.differences, round(w.lw, 6) AS log_weight, round(exp(w.lw - t.top), 6) AS weight,
        round(t.top, 6) AS top, round(t.top + ln(t.total), 6) AS log_total, t.regions FROM w JOIN t ON t.tree_id = w.tree_id"""


@plan("regions", "node")
def region_stab(d: Dialect) -> str:
    """The region of each branch that holds its middle: below it or at its upper end."""
    return """WITH h AS (SELECT n.tree_id, n.node, (n.height + p.height) / 2 AS h FROM {node} n JOIN {node} p ON p.tree_id = n.tree_id AND p.node = n.parent)
      SELECT h.tree_id, h.node, h.h, r.lower, r.upper, r.differences FROM h JOIN {regions} r ON r.tree_id = h.tree_id AND r.node = h.node AND r.lower < h.h AND h.h <= r.upper"""


@plan("mut", "reference", "node", "root_state")
def set_root_states(d: Dialect) -> str:
    """The events above the root after some of its states (tree_id, site, state) were set: where the state isn't the
    reference's, one event at the root's height; all other root states stay."""
    return """WITH root AS (SELECT tree_id, node, height FROM {node} WHERE parent IS NULL),
      had AS (SELECT m.tree_id, m.site, min_by(m.new_state, m.time) AS state FROM {mut} m JOIN root r ON r.tree_id = m.tree_id AND r.node = m.node GROUP BY m.tree_id, m.site),
      now AS (SELECT coalesce(s.tree_id, h.tree_id) AS tree_id, coalesce(s.site, h.site) AS site, coalesce(s.state, h.state) AS state FROM {root_state} s FULL OUTER JOIN had h ON h.tree_id = s.tree_id AND h.site = s.site)
      SELECT n.tree_id, r.node, r.height AS time, n.site, f.state AS old_state, n.state AS new_state FROM now n JOIN root r ON r.tree_id = n.tree_id JOIN {reference} f ON f.site = n.site WHERE n.state <> f.state"""


@plan("mut")
def site_replace(d: Dialect) -> str:
    """Histories in which the events at one site of each branch, its smallest, are replaced by a single one."""
    return """WITH s AS (SELECT tree_id, node, min(site) AS site FROM {mut} GROUP BY tree_id, node),
      kept AS (SELECT m.tree_id, m.node, m.site, m.time, m.old_state, m.new_state FROM {mut} m JOIN s ON s.tree_id = m.tree_id AND s.node = m.node WHERE m.site <> s.site),
      one AS (SELECT m.tree_id, m.node, m.site, avg(m.time) AS time, max_by(m.old_state, m.time) AS old_state, min_by(m.new_state, m.time) AS new_state
        FROM {mut} m JOIN s ON s.tree_id = m.tree_id AND s.node = m.node AND s.site = m.site GROUP BY m.tree_id, m.node, m.site)
      SELECT tree_id, node, site, round(time, 6) AS time, old_state, new_state FROM kept UNION ALL SELECT tree_id, node, site, round(time, 6), old_state, new_state FROM one WHERE old_state <> new_state"""


@plan("mut")
def time_bounds(d: Dialect) -> str:
    """For each event the neighbouring events at its site and branch, between which it may move."""
    return """SELECT tree_id, node, site, time, lag(time) OVER w AS above, lead(time) OVER w AS below FROM {mut} WINDOW w AS (PARTITION BY tree_id, node, site ORDER BY time DESC)"""


@plan("tip_state", "closure")
def unconstrained_nodes(d: Dialect) -> str:
    """Nodes and sites below which every tip allows every state."""
    return f"""SELECT {d.merge("c", "t")}c.tree_id, c.ancestor AS node, t.site FROM {{closure}} c JOIN {{tip_state}} t ON t.tree_id = c.tree_id AND t.node = c.node
      GROUP BY c.tree_id, c.ancestor, t.site HAVING min(t.mask) = 15"""


@plan("tip_state")
def tip_missing_sites(d: Dialect) -> str:
    """For each tip: missing sites, ambiguous sites, and the masks of the latter."""
    return f"""SELECT tree_id, node, count(*) FILTER (WHERE bit_count(mask) = 4) AS missing, count(*) FILTER (WHERE bit_count(mask) BETWEEN 2 AND 3) AS ambiguous,
      coalesce({d.listagg(f"CASE WHEN bit_count(mask) BETWEEN 2 AND 3 THEN concat(CAST(site AS {d.text}), ':', CAST(mask AS {d.text})) END", ",", "site")}, '') AS masks FROM {{tip_state}} GROUP BY tree_id, node"""


@plan("carried", "other_carried", "reference", "node")
def history_distance(d: Dialect) -> str:
    """Nodes and sites at which two histories of a tree have different states, at the root, inside, at tips."""
    kind = "CASE WHEN n.parent IS NULL THEN 'root' WHEN n.is_leaf THEN 'tip' ELSE 'inner' END"
    z = """z AS (SELECT coalesce(x.tree_id, y.tree_id) AS tree_id, coalesce(x.node, y.node) AS node, coalesce(x.site, y.site) AS site, x.state AS a, y.state AS b
        FROM {carried} x FULL OUTER JOIN {other_carried} y ON x.tree_id = y.tree_id AND x.node = y.node AND x.site = y.site)"""
    if d.spark:  # only whether states differ goes to the nodes, dealt by node before it is counted, so that a task holds a row of counts for each of its nodes
        return f"""WITH {z}, s AS (SELECT /*+ REPARTITION(tree_id, node) */ z.tree_id, z.node, coalesce(z.a, r.state) <> coalesce(z.b, r.state) AS differs FROM z JOIN {{reference}} r ON r.site = z.site),
          c AS (SELECT tree_id, node, count(*) AS compared, count(*) FILTER (WHERE differs) AS distance FROM s GROUP BY tree_id, node)
          SELECT c.tree_id, {kind} AS kind, CAST(sum(c.compared) AS BIGINT) AS compared, CAST(sum(c.distance) AS BIGINT) AS distance
          FROM c JOIN {{node}} n ON n.tree_id = c.tree_id AND n.node = c.node GROUP BY c.tree_id, {kind}"""
    return f"""WITH {z}
      SELECT z.tree_id, {kind} AS kind, count(*) AS compared, count(*) FILTER (WHERE coalesce(z.a, r.state) <> coalesce(z.b, r.state)) AS distance
      FROM z JOIN {{reference}} r ON r.site = z.site JOIN {{node}} n ON n.tree_id = z.tree_id AND n.node = z.node GROUP BY z.tree_id, {kind}"""


@plan("tip_state", "closure", "node")
def missing_clade_regions(d: Dialect, levels: int = 4) -> str:
    """For each tip the highest clades, some levels up at most and below the root, in which a site is missing
    at all tips; sites by clade."""
    return f"""WITH u AS (SELECT {d.merge("c", "t")}c.tree_id, c.ancestor AS node, t.site FROM {{closure}} c JOIN {{tip_state}} t ON t.tree_id = c.tree_id AND t.node = c.node
        JOIN {{node}} a ON a.tree_id = c.tree_id AND a.node = c.ancestor AND a.parent IS NOT NULL GROUP BY c.tree_id, c.ancestor, t.site HAVING min(t.mask) = 15),
      top AS (SELECT {d.merge("c")}c.tree_id, c.node AS tip, u.site, max_by(c.ancestor, c.steps) AS clade FROM {{closure}} c JOIN u ON u.tree_id = c.tree_id AND u.node = c.ancestor
        JOIN {{node}} n ON n.tree_id = c.tree_id AND n.node = c.node AND n.is_leaf WHERE c.steps <= {levels} GROUP BY c.tree_id, c.node, u.site)
      SELECT tree_id, tip, clade, {d.collect("site", "site")} AS sites, count(*) AS n FROM top GROUP BY tree_id, tip, clade"""


@plan("mut", "replaced", "replacement")
def replaced_sites(d: Dialect) -> str:
    """Histories with new events at some sites of some branches, linked anew. replaced(tree_id, node, site): where all old events go; replacement(tree_id, node, time, site, old_state, new_state): those that
    come, at these places only. Everything else stays."""
    columns = "tree_id, node, time, site, old_state, new_state"
    said = ", ".join(f"m.{c}" for c in columns.split(", "))
    return f"""WITH gone AS (SELECT DISTINCT tree_id, node, site FROM {{replaced}}),
      x AS (SELECT {said} FROM {{mut}} m LEFT JOIN gone g ON g.tree_id = m.tree_id AND g.node = m.node AND g.site = m.site WHERE g.site IS NULL
        UNION ALL SELECT {said} FROM {{replacement}} m JOIN gone g ON g.tree_id = m.tree_id AND g.node = m.node AND g.site = m.site)
      SELECT {columns}, lag(time) OVER (PARTITION BY tree_id, node, site ORDER BY time DESC) AS prev_time FROM x"""


_BRANCHES = """SELECT n.tree_id, n.node, n.height AS lo, p.height AS hi, a.height AS new_lo, b.height AS new_hi FROM {node} n JOIN {node} p ON p.tree_id = n.tree_id AND p.node = n.parent
        JOIN {new_height} a ON a.tree_id = n.tree_id AND a.node = n.node JOIN {new_height} b ON b.tree_id = p.tree_id AND b.node = p.node"""


@plan("node", "new_height", "linked")
def mapped_events(d: Dialect) -> str:
    """Events and the times before them, moved with the ends of their branches to new_height(tree_id, node, height): linearly, an upper end to just the upper end, and never off the
    branch. Those above the root stay, as their times mean nothing."""
    def to(t: str) -> str:
        return f"CASE WHEN b.node IS NULL OR {t} IS NULL THEN {t} WHEN {t} = b.hi THEN b.new_hi ELSE least(greatest(b.new_lo + ({t} - b.lo) / (b.hi - b.lo) * (b.new_hi - b.new_lo), b.new_lo), b.new_hi) END"

    return f"""WITH b AS ({_BRANCHES})
      SELECT l.tree_id, l.node, l.site, round({to("l.time")}, 9) AS time, round({to("l.prev_time")}, 9) AS prev_time, l.old_state, l.new_state FROM {{linked}} l LEFT JOIN b ON b.tree_id = l.tree_id AND b.node = l.node"""


@plan("node", "new_height", "linked")
def mapping_jacobian(d: Dialect) -> str:
    """The log Jacobian of mapped_events: for each tree the sum over its events of the log of the new over the old length of their branch."""
    return f"""WITH b AS ({_BRANCHES}), m AS (SELECT tree_id, node, count(*) AS n FROM {{linked}} GROUP BY tree_id, node)
      SELECT b.tree_id, CAST(sum(m.n) AS BIGINT) AS events, round(sum(m.n * ln((b.new_hi - b.new_lo) / (b.hi - b.lo))), 6) AS log_jacobian FROM b JOIN m ON m.tree_id = b.tree_id AND m.node = b.node GROUP BY b.tree_id"""
