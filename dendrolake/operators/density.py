"""Densities of event histories under continuous-time Markov chains. rate(from_state, to_state, q) holds the
rates off the diagonal, freq(state, pi) the root frequencies."""

from __future__ import annotations

from ..functions.ctmc import eigen_terms, hky
from ..plans.plan import Dialect, plan

CLOCK = 0.5
CATEGORY_RATES = (0.25, 0.5, 1.0, 2.0)

_PARTS = """esc AS (SELECT from_state AS state, sum(q) AS e FROM {rate} GROUP BY from_state),
      b AS (SELECT n.tree_id, n.node, n.height, p.height - n.height AS len FROM {node} n JOIN {node} p ON p.tree_id = n.tree_id AND p.node = n.parent),
      total AS (SELECT tree_id, sum(len) AS t FROM b GROUP BY tree_id),
      ev AS (SELECT m.tree_id, m.site, m.old_state, m.new_state, (y.e - x.e) * (m.time - b.height + coalesce(s.below, 0.0E0)) AS gain FROM {mut} m
        JOIN b ON b.tree_id = m.tree_id AND b.node = m.node LEFT JOIN {below} s ON s.tree_id = m.tree_id AND s.node = m.node
        JOIN esc x ON x.state = m.old_state JOIN esc y ON y.state = m.new_state)"""


def genetic_prior_text(clock: float = CLOCK) -> str:
    """Log density of a tree's history: root states by their frequencies, each event by its rate, and the total
    escape rate over all branches. The escape rate changes at events only, so that its integral is the one
    without events plus, for each event, its change times the length of all that lies below. below: tree_id, node, below."""
    return f"""WITH {_PARTS},
      root AS (SELECT sum(ln(f.pi)) AS lp, sum(e.e) AS lam FROM {{reference}} r JOIN {{freq}} f ON f.state = r.state JOIN esc e ON e.state = r.state),
      e AS (SELECT ev.tree_id, count(*) AS m, sum(ln({clock!r} * q.q)) AS lq, sum(ev.gain) AS gain FROM ev JOIN {{rate}} q ON q.from_state = ev.old_state AND q.to_state = ev.new_state GROUP BY ev.tree_id)
      SELECT t.tree_id, coalesce(e.m, 0) AS mutations, round(t.t, 6) AS length,
        round(root.lp + coalesce(e.lq, 0.0E0) - {clock!r} * (root.lam * t.t + coalesce(e.gain, 0.0E0)), 5) AS log_density
      FROM total t JOIN root ON root.lam IS NOT NULL LEFT JOIN e ON e.tree_id = t.tree_id"""


@plan("node", "below", "mut", "reference", "rate", "freq")
def genetic_prior(d: Dialect) -> str:
    return genetic_prior_text()


@plan("node", "below", "mut", "reference", "rate")
def category_posterior(d: Dialect) -> str:
    """Probability of each rate category of a site, given its events and its escape rate over the tree. The
    probabilities of a site sum to one."""
    cats = ", ".join(f"({i}, {r!r}E0, 1)" for i, r in enumerate(CATEGORY_RATES))
    return f"""WITH {_PARTS},
      s AS (SELECT t.tree_id, r.site, e.e * t.t AS base FROM total t JOIN {{reference}} r ON r.site >= 0 JOIN esc e ON e.state = r.state),
      m AS (SELECT tree_id, site, count(*) AS m, sum(gain) AS gain FROM ev GROUP BY tree_id, site),
      w AS (SELECT s.tree_id, s.site, c.c, coalesce(m.m, 0) * ln(c.r) - c.r * (s.base + coalesce(m.gain, 0.0E0)) AS lw
        FROM s LEFT JOIN m ON m.tree_id = s.tree_id AND m.site = s.site JOIN (VALUES {cats}) AS c(c, r, one) ON c.one = 1),
      x AS (SELECT tree_id, site, c, lw, max(lw) OVER (PARTITION BY tree_id, site) AS top FROM w)
      SELECT tree_id, site, CAST(c AS BIGINT) AS category, round(exp(lw - top) / sum(exp(lw - top)) OVER (PARTITION BY tree_id, site), 6) AS p FROM x"""


@plan("node")
def transition_probs(d: Dialect) -> str:
    """Transition probabilities over each branch: one plus the sum of the eigen terms, never below zero."""
    terms, values = eigen_terms(hky((0.1, 0.2, 0.3, 0.4), 2.0))
    rows = ", ".join(f"({i}, {j}, {', '.join(repr(float(x)) + 'E0' if 'e' not in repr(float(x)) else repr(float(x)) for x in terms[i][j])}, 1)" for i in range(4) for j in range(4))
    grow = " + ".join(f"q.v{k} * {d.expm1(f'{float(v)!r} * x.len')}" for k, v in enumerate(values))
    return f"""WITH x AS (SELECT n.tree_id, n.node, p.height - n.height AS len FROM {{node}} n JOIN {{node}} p ON p.tree_id = n.tree_id AND p.node = n.parent)
      SELECT x.tree_id, x.node, CAST(q.i AS BIGINT) AS from_state, CAST(q.j AS BIGINT) AS to_state, round(greatest(0.0E0, CASE WHEN q.i = q.j THEN 1.0E0 ELSE 0.0E0 END + {grow}), 6) AS p
      FROM x JOIN (VALUES {rows}) AS q(i, j, {", ".join(f"v{k}" for k in range(len(values)))}, one) ON q.one = 1"""


@plan("node", "mut")
def jc_branch_density(d: Dialect) -> str:
    """Log density of a branch's history under equal rates, given the states at its ends, over 64 sites."""
    p = "((1 - exp(-x * 4 / 3.0E0)) / 4)"
    return f"""WITH b AS (SELECT n.tree_id, n.node, {CLOCK} * (p.height - n.height) AS x FROM {{node}} n JOIN {{node}} p ON p.tree_id = n.tree_id AND p.node = n.parent),
      s AS (SELECT tree_id, node, site, count(*) AS m, max_by(old_state, time) AS a, min_by(new_state, time) AS z FROM {{mut}} GROUP BY tree_id, node, site),
      c AS (SELECT tree_id, node, CAST(sum(m) AS BIGINT) AS m, count(*) FILTER (WHERE a <> z) AS changed FROM s GROUP BY tree_id, node),
      y AS (SELECT {d.merge("c")}b.tree_id, b.node, b.x, coalesce(c.m, 0) AS m, coalesce(c.changed, 0) AS changed FROM b LEFT JOIN c ON c.tree_id = b.tree_id AND c.node = b.node)
      SELECT tree_id, node, m, changed, round(-x * 64 + m * ln({CLOCK} / 3.0E0) - (changed * ln({p}) + (64 - changed) * ln(1 - 3 * {p})), 5) AS log_density FROM y WHERE x > 0"""


@plan("node", "mut")
def dwell_times(d: Dialect) -> str:
    """Time that sites with events spend in each state, on each branch."""
    return f"""WITH b AS (SELECT n.tree_id, n.node, n.height AS lo, p.height AS hi FROM {{node}} n JOIN {{node}} p ON p.tree_id = n.tree_id AND p.node = n.parent),
      e AS (SELECT {d.merge("m")}m.tree_id, m.node, m.site, m.time, m.old_state, m.new_state, lag(m.time) OVER w AS before, lead(m.time) OVER w AS after, b.lo, b.hi
        FROM {{mut}} m JOIN b ON b.tree_id = m.tree_id AND b.node = m.node WINDOW w AS (PARTITION BY m.tree_id, m.node, m.site ORDER BY m.time DESC)),
      d AS (SELECT tree_id, node, old_state AS state, coalesce(before, hi) - time AS dwell FROM e UNION ALL SELECT tree_id, node, new_state, time - lo FROM e WHERE after IS NULL)
      SELECT tree_id, node, state, round(sum(dwell), 6) AS dwell, count(*) AS visits FROM d GROUP BY tree_id, node, state"""
