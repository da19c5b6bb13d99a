"""Trees as events of a hazard: what is at risk between the nodes of a tree, their density under a rate whose logarithm is linear between knots,
time on which such a rate is one, and regressions on integrals of hat functions."""

from __future__ import annotations

from collections.abc import Sequence
from math import exp, expm1

from pyspark.sql import DataFrame

from ..plans.plan import Dialect, plan

Knots = Sequence[tuple[float, float]]

#: Knots of the registered queries: height, log rate.
RATES: Knots = ((0.0, -1.0), (1.0, -0.5), (2.5, -1.2), (4.0, -1.5))

# Lineages at risk (exposure) and ways of an event, of k lineages.
MULTIPLICITY = {"coalescent": ("{k} * ({k} - 1) / 2.0E0", "{k} * ({k} - 1) / 2.0E0"), "birth_death": ("{k} * 1.0E0", "({k} - 1) * 1.0E0")}
FLAT, SMALL = 1e-9, 1e-3


def number(x: float) -> str:
    """A double in both engines' SQL."""
    text = repr(float(x))
    return f"({text})" if "e" in text else f"({text}E0)"


def checked(knots: Knots) -> list[tuple[float, float]]:
    out = [(float(x), float(y)) for x, y in knots]
    if len(out) < 2 or out[0][0] != 0 or any(a[0] >= b[0] for a, b in zip(out, out[1:])):
        raise ValueError("two knots or more, at growing heights from zero on, are needed")
    return out


def segments(knots: Knots) -> list[tuple[float, float, float, float]]:
    """(start, log rate there, slope, integral up to it); the last goes on without end."""
    knots, out, total = checked(knots), [], 0.0
    for (x, a), (y, b) in zip(knots, knots[1:]):
        slope = (b - a) / (y - x)
        out.append((x, a, slope, total))
        d = slope * (y - x)
        total += exp(a) * (y - x) * (expm1(d) / d if abs(d) > FLAT else 1 + d / 2)
    return out


def _by_segment(value: str, starts: Sequence[float], parts: Sequence[str]) -> str:
    if len(parts) == 1:
        return f"({parts[0]})"
    return "(CASE " + " ".join(f"WHEN {value} < {number(starts[i + 1])} THEN {parts[i]}" for i in range(len(parts) - 1)) + f" ELSE {parts[-1]} END)"


def mean_exp(d: Dialect, x: str) -> str:
    """(exp(x) - 1) / x, by its series where x is small."""
    return f"(CASE WHEN abs({x}) < {number(SMALL)} THEN 1 + {x} * (0.5E0 + {x} * ({number(1 / 6)} + {x} * {number(1 / 24)})) ELSE {d.expm1(x)} / ({x}) END)"


def integral(d: Dialect, height: str, knots: Knots) -> str:
    """The integral of the rate from zero to a height."""
    cut = segments(knots)
    parts = [f"{number(total)} + {number(exp(a))} * ({height} - {number(x)}) * {mean_exp(d, f'({number(slope)} * ({height} - {number(x)}))')}" for x, a, slope, total in cut]
    return _by_segment(height, [s[0] for s in cut], parts)


def log_rate(height: str, knots: Knots) -> str:
    cut = segments(knots)
    return _by_segment(height, [s[0] for s in cut], [f"{number(a)} + {number(slope)} * ({height} - {number(x)})" for x, a, slope, _ in cut])


def height_at(time: str, knots: Knots) -> str:
    """The height at which the integral of the rate is a time; null where it never is."""
    parts = []
    for x, a, slope, total in segments(knots):
        scaled = f"(({time} - {number(total)}) * {number(exp(-a))})"
        bent = f"({number(slope)} * {scaled})"
        curved = f"WHEN {bent} > -1 THEN {number(x)} + ln(1 + {bent}) / {number(slope)}" if slope else ""
        parts.append(f"CASE WHEN abs({bent}) < {number(FLAT)} THEN {number(x)} + {scaled} {curved} END")
    return _by_segment(time, [s[3] for s in segments(knots)], parts)


def _walk(d: Dialect) -> str:
    """The nodes of trees from the youngest on, tips first on ties: lineages below each, and the height of the one before, zero for the first."""
    w = "OVER (PARTITION BY tree_id ORDER BY height, is_leaf DESC, node"
    return f"""SELECT tree_id, node, is_leaf, height, lag(height, 1, 0.0E0) {w}) AS since, CAST(coalesce(sum(CASE WHEN is_leaf THEN 1 ELSE -1 END) {w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS k,
      max(CASE WHEN NOT is_leaf THEN height END) OVER (PARTITION BY tree_id) AS top FROM {{node}}"""


@plan("node")
def exposure_pieces(d: Dialect, hazard: str = "coalescent") -> str:
    """Intervals between the nodes of a tree, up to its last inner node, in which something is at risk, and how much. hazard: coalescent or birth_death."""
    at_risk = MULTIPLICITY[hazard][0].format(k="k")
    return f"SELECT tree_id, node, since AS start_height, height AS end_height, k AS lineages, {at_risk} AS exposure FROM ({_walk(d)}) w WHERE height <= top AND height > since AND {at_risk} > 0"


@plan("node")
def join_events(d: Dialect, hazard: str = "coalescent") -> str:
    """Inner nodes as events: lineages below, and the log of in how many ways they can join; null where in none."""
    ways = MULTIPLICITY[hazard][1].format(k="k")
    return f"SELECT tree_id, node, height, k AS lineages, round(CASE WHEN {ways} > 0 THEN ln({ways}) END, 9) AS log_ways FROM ({_walk(d)}) w WHERE NOT is_leaf"


@plan("node")
def tree_hazard_density(d: Dialect, knots: Knots = RATES, hazard: str = "coalescent", intercept: float = 0.0) -> str:
    """Log density of trees whose nodes are events of a rate given by knots: log ways and log rates of events, less the integral over what is at risk."""
    at_risk, ways = (x.format(k="k") for x in MULTIPLICITY[hazard])
    return f"""WITH w AS ({_walk(d)}),
      x AS (SELECT tree_id, is_leaf, CASE WHEN NOT is_leaf THEN ln({ways}) + {log_rate("height", knots)} ELSE 0.0E0 END AS event,
        CASE WHEN height > since THEN {at_risk} * ({integral(d, "height", knots)} - {integral(d, "since", knots)}) ELSE 0.0E0 END AS risk FROM w WHERE height <= top)
      SELECT tree_id, count(*) FILTER (WHERE NOT is_leaf) AS events, round({number(intercept)} + sum(event) - sum(risk), 6) AS log_density FROM x GROUP BY tree_id"""


@plan("node")
def warped_time(d: Dialect, knots: Knots = RATES) -> str:
    """Nodes on the time on which a rate given by knots is one: the integral up to their height, the log rate there, and the height at half that time."""
    time = integral(d, "height", knots)
    return f"""SELECT tree_id, node, height, round(time, 9) AS time, round({log_rate("height", knots)}, 9) AS log_rate, round({height_at("time", knots)}, 6) AS back, round({height_at("(time / 2)", knots)}, 6) AS half
      FROM (SELECT tree_id, node, height, {time} AS time FROM {{node}} WHERE height >= 0) t"""


def hat_integral(height: str, knots: Sequence[float], k: int) -> str:
    """From the first knot to a height, the integral of the function that is one at the k-th knot, zero at all others, linear between, and constant beyond the ends."""
    x, last = [float(v) for v in knots], len(knots) - 1
    rise = f"greatest(0, least({height}, {number(x[k])}) - {number(x[k - 1])})" if k else ""
    fall = f"greatest(0, least({height}, {number(x[k + 1])}) - {number(x[k])})" if k < last else ""
    parts = [f"{rise} * {rise} / {number(2 * (x[k] - x[k - 1]))}" if k else f"least(0, {height} - {number(x[0])})"]
    parts.append(f"{fall} - {fall} * {fall} / {number(2 * (x[k + 1] - x[k]))}" if k < last else f"greatest(0, {height} - {number(x[-1])})")
    return "(" + " + ".join(parts) + ")"


@plan("node")
def hat_design(d: Dialect, knots: Sequence[float] = (0.0, 1.0, 2.5, 4.0), scale: float = 1.0) -> str:
    """obs, f, x: for each tree and knot the integrals of its hat function over all branches, in units of the scale."""
    pick = "CASE f " + " ".join(f"WHEN {k} THEN {hat_integral('hi', knots, k)} - {hat_integral('lo', knots, k)}" for k in range(len(knots))) + " END"
    rows = d.series("0", str(len(knots) - 1), "f", "(SELECT n.tree_id AS obs, n.height AS lo, p.height AS hi FROM {node} n JOIN {node} p ON p.tree_id = n.tree_id AND p.node = n.parent) b", "obs, lo, hi")
    return f"SELECT obs, f, sum({pick}) / {number(scale)} AS x FROM ({rows}) r GROUP BY obs, f"


@plan("design", "target")
def ridge_sums(d: Dialect, ridge: float = 0.01) -> str:
    """The normal equations of design(obs, f, x) and target(obs, y): sums of products of features a and b, the ridge times the number of observations added where
    they are one; with b null the sums with the target. An observation's features are joined with each other, no others."""
    return f"""WITH n AS (SELECT count(*) AS n FROM {{target}}), g AS (SELECT a.f AS a, b.f AS b, sum(a.x * b.x) AS total FROM {{design}} a JOIN {{design}} b ON b.obs = a.obs JOIN {{target}} t ON t.obs = a.obs GROUP BY a.f, b.f)
      SELECT g.a, g.b, round(g.total + CASE WHEN g.a = g.b THEN {number(ridge)} * (SELECT n FROM n) ELSE 0.0E0 END, 6) AS total FROM g
      UNION ALL SELECT x.f, NULL, round(sum(x.x * t.y), 6) FROM {{design}} x JOIN {{target}} t ON t.obs = x.obs GROUP BY x.f"""


def ridge_weights(sums: DataFrame, most: int = 1000) -> dict[int, float]:
    """Weights of features by ridge_sums, solved on the driver: as many rows as pairs of features; raises beyond `most` features."""
    import numpy as np

    features = sorted(r.a for r in sums.where("b IS NULL").select("a").limit(most + 1).collect())
    if len(features) > most:
        raise ValueError(f"more than {most} features")
    at = {f: i for i, f in enumerate(features)}
    gram, moment = np.zeros((len(at), len(at))), np.zeros(len(at))
    for r in sums.collect():
        if r.b is None:
            moment[at[r.a]] = r.total
        else:
            gram[at[r.a], at[r.b]] = r.total
    return dict(zip(features, map(float, np.linalg.solve(gram, moment))))
