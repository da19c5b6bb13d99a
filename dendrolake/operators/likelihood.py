"""Likelihoods of tip data and densities of histories under a rate matrix with rate categories. branch_rate(tree_id, node, rate),
site_category(site, category). A branch's scale in a category is its rate times the category's; P(scale * length) are its
transition probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ctmc import eigen_terms, hky
from ..plans.lineage import by_level, sized
from ..plans.plan import ANSI, SPARK, Dialect, plan
from .sweeps import upward

FREQUENCIES, KAPPA = (0.1, 0.2, 0.3, 0.4), 2.0
CATEGORY_RATES = (0.25, 0.5, 1.0, 2.0)
STATES = range(4)


def number(x: float) -> str:
    text = repr(float(x))
    return f"({text}{'' if 'e' in text else 'E0'})"


def category_rate(category: str, rates=CATEGORY_RATES) -> str:
    return "CASE " + category + "".join(f" WHEN {i} THEN {number(r)}" for i, r in enumerate(rates)) + " END"


def rate_of(a: str, b: str, frequencies=FREQUENCIES, kappa: float = KAPPA) -> str:
    """The rate from state a to state b, or of leaving a (negative) where they are equal."""
    q = hky(frequencies, kappa)
    return f"CASE {a} * 4 + {b}" + "".join(f" WHEN {4 * i + j} THEN {number(q[i, j])}" for i in STATES for j in STATES) + " END"


def probability(d: Dialect, i: int, j: int, x: str, frequencies=FREQUENCIES, kappa: float = KAPPA) -> str:
    """P(x)[i, j] as an expression: one or zero and the sum of the eigen terms, never below zero."""
    terms, values = eigen_terms(hky(frequencies, kappa))
    grow = " + ".join(f"{number(terms[i][j][k])} * {d.expm1(f'{number(v)} * ({x})')}" for k, v in enumerate(values) if abs(v) > 1e-12)
    return f"greatest(0.0E0, {1.0 if i == j else 0.0}E0 + {grow})"


def probability_of(d: Dialect, a: str, b: str, x: str) -> str:
    """P(x)[a, b] for states that are columns."""
    return f"CASE {a} * 4 + {b}" + "".join(f" WHEN {4 * i + j} THEN {probability(d, i, j, x)}" for i in STATES for j in STATES) + " END"


BRANCHES = """b AS (SELECT n.tree_id, n.node, n.height AS lo, p.height - n.height AS len, r.rate FROM {node} n JOIN {node} p ON p.tree_id = n.tree_id AND p.node = n.parent
        JOIN {branch_rate} r ON r.tree_id = n.tree_id AND r.node = n.node)"""


@plan("node", "mut", "site_category")
def branch_stats(d: Dialect) -> str:
    """What a density of histories needs to know of a branch: for each category and pair of states, events from a to b, sites with events that
    begin in a and end in b, and, where a = b, the time that these sites spend in a. A site begins with its branch's length in its
    first state; each event moves the time left from its old state to its new one. Any rates are evaluated from this, without the events."""
    return """WITH x AS (SELECT m.tree_id, m.node, c.category, m.site, m.time, m.old_state AS a, m.new_state AS b, m.time - n.height AS left_over, p.height - n.height AS len
        FROM {mut} m JOIN {node} n ON n.tree_id = m.tree_id AND n.node = m.node JOIN {node} p ON p.tree_id = n.tree_id AND p.node = n.parent JOIN {site_category} c ON c.site = m.site),
      s AS (SELECT tree_id, node, category, site, max_by(a, time) AS a, min_by(b, time) AS b, min(len) AS len FROM x GROUP BY tree_id, node, category, site),
      e AS (SELECT tree_id, node, category, a, b, count(*) AS events, sum(left_over) AS moved FROM x GROUP BY tree_id, node, category, a, b),
      p AS (SELECT tree_id, node, category, a, b, count(*) AS pairs, sum(len) AS len FROM s GROUP BY tree_id, node, category, a, b),
      u AS (SELECT tree_id, node, category, a, b, events, 0 AS pairs, 0.0E0 AS dwell FROM e UNION ALL SELECT tree_id, node, category, a, b, 0, pairs, 0.0E0 FROM p
        UNION ALL SELECT tree_id, node, category, a, a, 0, 0, len - 0.0E0 FROM p UNION ALL SELECT tree_id, node, category, a, a, 0, 0, -moved FROM e UNION ALL SELECT tree_id, node, category, b, b, 0, 0, moved + 0.0E0 FROM e)
      SELECT tree_id, node, CAST(category AS BIGINT) AS category, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(sum(events) AS BIGINT) AS events, CAST(sum(pairs) AS BIGINT) AS pairs, round(sum(dwell), 9) + 0.0E0 AS dwell FROM u GROUP BY tree_id, node, category, a, b"""


def hybrid_text(d: Dialect, stats: str, sites: str, node: str, branch_rate: str) -> str:
    x = "rate * r * len"
    p_of = probability_of(d, "a", "b", x)
    diagonal = rate_of("a", "a")
    back = f"({p_of}) - exp(rate * r * ({diagonal}) * len)"
    chosen = " + ".join(f"{number(FREQUENCIES[i])} * greatest(0.0E0, {probability(d, i, i, x)} - exp({number(hky(FREQUENCIES, KAPPA)[i, i])} * {x})) / {probability(d, i, i, x)}" for i in STATES)
    rates = category_rate("CAST(k.category AS INT)")
    branches = BRANCHES.replace("{node}", node).replace("{branch_rate}", branch_rate)
    return f"""WITH {branches},
      k AS (SELECT category, count(*) AS n FROM {sites} GROUP BY category),
      bc AS (SELECT b.tree_id, b.node, b.len, b.rate, k.category, k.n, {rates} AS r FROM b JOIN k ON k.n > 0 WHERE b.len > 0),
      t AS (SELECT c.tree_id, c.node, c.category, s.a, s.b, s.events, s.pairs, s.dwell, c.len, c.rate, c.r FROM bc c JOIN {stats} s ON s.tree_id = c.tree_id AND s.node = c.node AND s.category = c.category),
      v AS (SELECT tree_id, node, category, sum(CASE WHEN events > 0 THEN events * ln(rate * r * ({rate_of("a", "b")})) ELSE 0.0E0 END + CASE WHEN a = b THEN rate * r * ({diagonal}) * dwell ELSE 0.0E0 END
          - CASE WHEN pairs = 0 THEN 0.0E0 WHEN a = b THEN pairs * ln({back}) ELSE pairs * ln({p_of}) END) AS path,
        sum(CASE WHEN a = b THEN pairs ELSE 0 END) AS chosen, sum(CASE WHEN a <> b THEN pairs ELSE 0 END) AS changed FROM t GROUP BY tree_id, node, category),
      w AS (SELECT c.tree_id, c.node, c.n, least(1.0E0, {chosen}) AS sel, coalesce(v.path, 0.0E0) AS path, coalesce(v.chosen, 0) AS chosen, coalesce(v.changed, 0) AS changed
        FROM bc c LEFT JOIN v ON v.tree_id = c.tree_id AND v.node = c.node AND v.category = c.category)
      SELECT tree_id, node, CAST(sum(chosen) AS BIGINT) AS chosen, CAST(sum(changed) AS BIGINT) AS changed,
        round(sum(path + CASE WHEN chosen > 0 THEN chosen * ln(sel) ELSE 0.0E0 END + (n - changed - chosen) * ln(1 - sel)), 5) AS log_density FROM w GROUP BY tree_id, node"""


@plan("stats", "site_category", "node", "branch_rate")
def hybrid_branch_density(d: Dialect) -> str:
    """Log density of the history of each branch with a length, from branch_stats: sites whose ends differ have the density of their path
    given these; of those whose ends agree each has events with the same chance, by category, and then the density of a path that isn't empty."""
    return hybrid_text(d, "{stats}", "{site_category}", "{node}", "{branch_rate}")


@plan("node", "mut", "branch_rate", "site_category")
def path_density(d: Dialect) -> str:
    """Log density of the path of each site with events on a branch, given the states at its ends: rates of its events, the chance to stay
    between them, over the probability of the last state."""
    return f"""WITH {BRANCHES},
      x AS (SELECT m.tree_id, m.node, m.site, m.time, m.old_state AS a, m.new_state AS b, b.lo, b.len, b.rate * {category_rate("CAST(c.category AS INT)")} AS s FROM {{mut}} m JOIN b ON b.tree_id = m.tree_id AND b.node = m.node
        JOIN {{site_category}} c ON c.site = m.site),
      y AS (SELECT tree_id, node, site, s, len, max_by(a, time) AS a, min_by(b, time) AS b, sum(ln(s * ({rate_of("a", "b")}))) AS jumps, sum((time - lo) * (({rate_of("b", "b")}) - ({rate_of("a", "a")}))) AS gain FROM x GROUP BY tree_id, node, site, s, len)
      SELECT tree_id, node, site, round(jumps + s * (({rate_of("a", "a")}) * len + gain) - ln({probability_of(d, "a", "b", "s * len")}), 6) AS log_density FROM y WHERE len > 0"""


@plan("ends", "node", "branch_rate")
def compatible_end_density(d: Dialect) -> str:
    """Log probability, under equal rates, of the states drawn for the ambiguous sites of each tip from those that its data allow. ends: tree_id, node, site,
    mask, start_state (the parent's), end_state."""
    return f"""WITH {BRANCHES},
      x AS (SELECT e.tree_id, e.node, e.mask, e.start_state, e.end_state, (1 - exp(-b.rate * b.len * 4 / 3.0E0)) / 4 AS p FROM {{ends}} e JOIN b ON b.tree_id = e.tree_id AND b.node = e.node
        WHERE bit_count(e.mask) BETWEEN 2 AND 3),
      y AS (SELECT tree_id, node, CASE WHEN start_state = end_state THEN 1 - 3 * p ELSE p END AS drawn,
        CASE WHEN (mask & (1 << CAST(start_state AS INT))) <> 0 THEN 1 - 3 * p + (bit_count(mask) - 1) * p ELSE bit_count(mask) * p END AS allowed FROM x)
      SELECT tree_id, node, count(*) AS sites, round(sum(ln(drawn / allowed)), 6) AS log_probability FROM y GROUP BY tree_id, node"""


def partial_likelihoods(node: DataFrame, tip_state: DataFrame, branch_rate: DataFrame, site_category: DataFrame) -> DataFrame:
    """tree_id, node, site, p0 to p3, log_scale: how likely the data below a node are by its state, from the tips up. Partials are
    divided by their largest, whose logs add up. Children without data are left out, and so are nodes without any below."""
    bit = [F.when(F.col("mask").bitwiseAND(1 << s) != 0, 1.0).otherwise(0.0).alias(f"p{s}") for s in STATES]
    tips = tip_state.where("mask <> 15").join(site_category.select("site", F.col("category").cast("int").alias("category")), "site").select("tree_id", "node", "site", "category", *bit, F.lit(0.0).alias("log_scale"))
    up = node.select("tree_id", F.col("node").alias("parent"), F.col("height").alias("hi"))
    length = node.join(up.hint("merge"), ["tree_id", "parent"]).join(branch_rate.hint("merge"), ["tree_id", "node"]).select("tree_id", "node", F.col("depth").cast("int").alias("depth"), ((F.col("hi") - F.col("height")) * F.col("rate")).alias("len"))
    kinds = length.withColumn("category", F.explode(F.array(*(F.lit(i) for i in range(len(CATEGORY_RATES))))))
    scaled = kinds.withColumn("x", F.col("len") * F.expr(category_rate("category")))
    changes = by_level(scaled.select("tree_id", "node", "depth", "category", *(F.expr(probability(SPARK, i, j, "x")).alias(f"q{i}{j}") for i in STATES for j in STATES)), "depth")

    def merge(rows: DataFrame) -> DataFrame:
        heard = rows.join(changes.hint("merge"), ["tree_id", "node", "depth", "category"]).select(
            "tree_id", F.col("parent").alias("node"), "site", "category", "log_scale", *(sum(F.col(f"q{i}{j}") * F.col(f"p{j}") for j in STATES).alias(f"m{i}") for i in STATES)
        )
        joint = heard.groupBy("tree_id", "node", "site", "category").agg(*(F.product(f"m{s}").alias(f"m{s}") for s in STATES), F.sum("log_scale").alias("below"))
        most = F.greatest(*(F.col(f"m{s}") for s in STATES))
        most = F.when(most > 0, most).otherwise(1.0)
        return joint.select("tree_id", "node", "site", "category", *((F.col(f"m{s}") / most).alias(f"p{s}") for s in STATES), (F.col("below") + F.log(most)).alias("log_scale"))

    return upward(node, tips, merge).select("tree_id", "node", "site", *(f"p{s}" for s in STATES), "log_scale")


@plan("partials", "node")
def site_likelihood(d: Dialect) -> str:
    """Log likelihood of the data of each site, from the partials at the root."""
    total = " + ".join(f"{number(FREQUENCIES[s])} * p.p{s}" for s in STATES)
    return f"""SELECT p.tree_id, p.site, round(CASE WHEN {total} > 0 THEN ln({total}) + p.log_scale END, 5) AS log_likelihood
      FROM {{partials}} p JOIN {{node}} n ON n.tree_id = p.tree_id AND n.node = p.node WHERE n.parent IS NULL"""


@plan("partials")
def rounded_partials(d: Dialect) -> str:
    return "SELECT tree_id, node, site, round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2, round(p3, 6) AS p3, round(log_scale, 5) AS log_scale FROM {partials}"


def partials_text(levels: int = 24) -> str:
    """The same for a second engine, without scaling until the end; over the views node, tip_state, branch_rate, site_category."""
    d = ANSI
    bits = ", ".join(f"CASE WHEN mask & {1 << s} <> 0 THEN 1.0E0 ELSE 0.0E0 END AS p{s}" for s in STATES)
    parts = [
        f"lens AS (SELECT n.tree_id, n.node, k.category, (p.height - n.height) * r.rate * {category_rate('k.category')} AS x FROM node n JOIN node p ON p.tree_id = n.tree_id AND p.node = n.parent JOIN branch_rate r ON r.tree_id = n.tree_id AND r.node = n.node, range({len(CATEGORY_RATES)}) k(category))",
        "probs AS (SELECT tree_id, node, category, " + ", ".join(f"{probability(d, i, j, 'x')} AS q{i}{j}" for i in STATES for j in STATES) + " FROM lens)",
        f"leaves AS (SELECT t.tree_id, t.node, n.parent, n.depth, t.site, c.category, {bits} FROM tip_state t JOIN node n ON n.tree_id = t.tree_id AND n.node = t.node JOIN site_category c ON c.site = t.site WHERE mask <> 15)",
    ]
    for level in range(levels, 0, -1):
        source = f"SELECT * FROM leaves WHERE depth = {level}" + (f" UNION ALL SELECT * FROM part{level}" if level < levels else "")
        products = ", ".join("product(" + " + ".join(f"q.q{i}{j} * s.p{j}" for j in STATES) + f") AS p{i}" for i in STATES)
        parts.append(f"""part{level - 1} AS (SELECT g.tree_id, g.node, n.parent, n.depth, g.site, g.category, g.p0, g.p1, g.p2, g.p3 FROM (SELECT s.tree_id, s.parent AS node, s.site, s.category, {products}
          FROM ({source}) s JOIN probs q ON q.tree_id = s.tree_id AND q.node = s.node AND q.category = s.category GROUP BY s.tree_id, s.parent, s.site, s.category) g JOIN node n ON n.tree_id = g.tree_id AND n.node = g.node)""")
    every = " UNION ALL ".join(["SELECT tree_id, node, site, p0, p1, p2, p3 FROM leaves", *(f"SELECT tree_id, node, site, p0, p1, p2, p3 FROM part{k}" for k in range(levels))])
    return f"WITH {', '.join(parts)} SELECT tree_id, node, site, {', '.join(f'p{s} / greatest(p0, p1, p2, p3) AS p{s}' for s in STATES)}, ln(greatest(p0, p1, p2, p3)) AS log_scale FROM ({every}) z"


def history_density(node: DataFrame, mut: DataFrame, reference: DataFrame, branch_rate: DataFrame, site_category: DataFrame) -> DataFrame:
    """tree_id, site, events, log_density: of the whole history of each site over the tree, frequency of the root's state included.
    The rate of leaving a state changes at events only, so its integral is that of the reference's state over all branches, and for each
    event its change times all that lies below it, which one sweep from the tips up adds up; no state of any node is needed."""
    up = node.select("tree_id", F.col("node").alias("parent"), F.col("height").alias("hi"))
    rate = branch_rate.select("tree_id", "node", "rate")
    branch = sized(node.join(rate.hint("merge"), ["tree_id", "node"]).join(up.hint("merge"), ["tree_id", "parent"], "left").select(
        "tree_id", "node", F.col("parent").isNull().alias("top"), "height", "is_leaf", "rate", F.coalesce((F.col("hi") - F.col("height")) * F.col("rate"), F.lit(0.0)).alias("len")
    ))
    own = branch.select("tree_id", "node", "len").hint("merge")

    def merge(rows: DataFrame) -> DataFrame:
        sums = rows.groupBy("tree_id", F.col("parent").alias("node")).agg(F.sum("reach").alias("below"))
        return sums.join(own, ["tree_id", "node"]).select("tree_id", "node", "below", (F.col("below") + F.col("len")).alias("reach"))

    tips = branch.where("is_leaf").select("tree_id", "node", F.lit(0.0).alias("below"), F.col("len").alias("reach"))
    below = upward(node, tips, merge).select("tree_id", "node", "below")
    total = below.join(branch.where("top").select("tree_id", "node"), ["tree_id", "node"]).select("tree_id", F.col("below").alias("total"))
    placed = mut.join(branch.select("tree_id", "node", "top", "height", "rate").hint("merge"), ["tree_id", "node"]).join(below.hint("merge"), ["tree_id", "node"]).join(site_category, "site")
    a, b = "CAST(old_state AS INT)", "CAST(new_state AS INT)"
    category = F.expr(category_rate("CAST(category AS INT)"))
    change = F.expr(f"({rate_of(b, b)}) - ({rate_of(a, a)})")
    reach = F.col("below") + F.when(F.col("top"), 0.0).otherwise((F.col("time") - F.col("height")) * F.col("rate"))
    jump = F.when(~F.col("top"), F.log(F.col("rate") * category * F.expr(rate_of(a, b))))
    pi = F.expr("CASE root" + "".join(f" WHEN {i} THEN {number(x)}" for i, x in enumerate(FREQUENCIES)) + " END")
    events = placed.groupBy("tree_id", "site").agg(
        F.count(F.when(~F.col("top"), 1)).alias("events"), F.coalesce(F.sum(jump), F.lit(0.0)).alias("jumps"), F.sum(change * reach * category).alias("gain"),
        F.min_by(F.when(F.col("top"), F.col("new_state")), F.when(F.col("top"), F.col("time"))).alias("root"),
    )
    every = total.join(reference.join(site_category, "site").select("site", "state", category.alias("r")), F.lit(True))  # a row for each tree and site is the result
    state = "CAST(state AS INT)"
    return every.join(events, ["tree_id", "site"], "left").withColumn("root", F.coalesce("root", "state").cast("int")).select(
        "tree_id", "site", F.coalesce("events", F.lit(0)).alias("events"),
        F.round(F.log(pi) + F.coalesce("jumps", F.lit(0.0)) + F.col("r") * F.expr(rate_of(state, state)) * F.col("total") + F.coalesce("gain", F.lit(0.0)), 5).alias("log_density"),
    )


def history_text() -> str:
    """The same for a second engine: states are replayed from the root down, and each branch has the probability of its last state
    times the density of its path given that. Over the views node, mut, reference, branch_rate, site_category."""
    d = ANSI
    path = probability_of(d, "a", "z", "s * len")
    frequency = "CASE z" + "".join(f" WHEN {i} THEN {number(x)}" for i, x in enumerate(FREQUENCIES)) + " END"
    return f"""WITH RECURSIVE last AS (SELECT tree_id, node, site, min_by(new_state, time) AS z, count(*) AS m FROM mut GROUP BY ALL),
      cells AS (SELECT n.tree_id, n.node, n.parent, n.height, n.depth, r.site, r.state, l.z, coalesce(l.m, 0) AS m FROM node n JOIN reference r ON r.site >= 0 LEFT JOIN last l ON l.tree_id = n.tree_id AND l.node = n.node AND l.site = r.site),
      walk AS (SELECT tree_id, node, site, height, CAST(state AS BIGINT) AS a, CAST(coalesce(z, state) AS BIGINT) AS z, 0.0E0 AS len, true AS top, m FROM cells WHERE parent IS NULL
        UNION ALL SELECT c.tree_id, c.node, c.site, c.height, w.z, CAST(coalesce(c.z, w.z) AS BIGINT), w.height - c.height, false, c.m FROM walk w JOIN cells c ON c.tree_id = w.tree_id AND c.parent = w.node AND c.site = w.site),
      jumps AS (SELECT tree_id, node, site, time, old_state, new_state, lag(time) OVER (PARTITION BY tree_id, node, site ORDER BY time DESC) AS before, lead(time) OVER (PARTITION BY tree_id, node, site ORDER BY time DESC) AS after FROM mut),
      scaled AS (SELECT w.*, r.rate * {category_rate("c.category")} AS s FROM walk w JOIN branch_rate r ON r.tree_id = w.tree_id AND r.node = w.node JOIN site_category c ON c.site = w.site),
      moves AS (SELECT s.tree_id, s.node, s.site, sum(ln(s.s * ({rate_of("j.old_state", "j.new_state")})) + s.s * ({rate_of("j.old_state", "j.old_state")}) * (coalesce(j.before, s.height + s.len) - j.time)
          + CASE WHEN j.after IS NULL THEN s.s * ({rate_of("j.new_state", "j.new_state")}) * (j.time - s.height) ELSE 0 END) AS d
        FROM scaled s JOIN jumps j ON j.tree_id = s.tree_id AND j.node = s.node AND j.site = s.site WHERE NOT s.top GROUP BY ALL),
      parts AS (SELECT s.tree_id, s.site, CASE WHEN s.top THEN 0 ELSE s.m END AS m, CASE WHEN s.top THEN ln({frequency}) ELSE ln({path}) + coalesce(j.d, s.s * ({rate_of("s.a", "s.a")}) * s.len) - ln({path}) END AS d
        FROM scaled s LEFT JOIN moves j ON j.tree_id = s.tree_id AND j.node = s.node AND j.site = s.site)
      SELECT tree_id, site, CAST(sum(m) AS BIGINT) AS events, round(sum(d), 5) AS log_density FROM parts GROUP BY ALL"""
