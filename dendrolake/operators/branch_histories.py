"""Histories of whole branches, drawn given the states at their ends: sites whose ends differ have a path each; of those whose ends agree, few have events,
and only these become rows. Draws depend on seeds and keys of rows alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ctmc import eigen_terms
from ..plans.lineage import cut, sized
from ..plans.plan import Dialect, plan
from .kernels import Uniformised, draws, paths, site_histories

EVENTS = "tree_id long, node long, site long, time double, old_state long, new_state long"
Matrix = Sequence[Sequence[float]]
# Rows of one batch that are held before they are handed on.
LARGEST = 1 << 18


def equal_rates(leaving: float = 1.0, states: int = 4) -> list[list[float]]:
    """A rate matrix with one rate for all changes; `leaving`: of leaving a state."""
    return [[-leaving if i == j else leaving / (states - 1) for j in range(states)] for i in range(states)]


def returning(chain: Uniformised, state: int, length: float, rng) -> list[tuple[float, int]]:
    """Events (time from the start, new state) of a path that ends in the state where it starts, given that it leaves it. The number of jumps is drawn by the
    chances of all walks that return less that of staying throughout; each jump by the walks that are left, without that of staying if the path
    hasn't left yet. Nothing is drawn in vain, however short the branch."""
    import numpy as np
    from math import lgamma, log, sqrt

    mean, stay = chain.mu * length, float(chain.jump[state, state])

    def back(n: int) -> float:
        return max(0.0, float(chain.power(n)[state, state]) - stay**n)

    if not mean > 0:
        raise ValueError("a branch without length has no events")
    counts = range(2, int(mean + 40 * sqrt(mean) + 100))
    ways = np.array([back(n) for n in counts])
    if not ways.any():
        raise ValueError(f"state {state} is never come back to")
    logs = np.array([n * log(mean) - lgamma(n + 1) for n in counts])
    upto = np.cumsum(np.exp(logs - logs[ways > 0].max()) * ways)
    n = counts[min(int(np.searchsorted(upto, rng.random() * upto[-1], "right")), len(counts) - 1)]
    times, out, now, left = np.sort(rng.random(n)) * length, [], state, False
    for k in range(n):
        w = chain.jump[now] * chain.power(n - k - 1)[:, state]
        if not left:
            w[state] = stay * back(n - k - 1)
        upto = np.cumsum(w)
        new = int(np.searchsorted(upto, rng.random() * upto[-1], "right"))
        if new != now:
            out.append((float(times[k]), new))
            now, left = new, True
    return out


def chance_of_events(q: Matrix, state: Column, length: Column) -> Column:
    """The chance that a path that ends in the state where it starts has events: one less that of staying over that of returning."""
    import numpy as np

    matrix = np.asarray(q, float)
    terms, values = eigen_terms(matrix)
    out = F.lit(None).cast("double")
    for i in range(len(matrix)):
        back = sum((F.lit(float(terms[i, i, k])) * F.expm1(F.lit(float(v)) * length) for k, v in enumerate(values)), F.lit(0.0))
        out = F.when(state == i, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (back - F.expm1(F.lit(float(matrix[i, i])) * length)) / (back + 1)))).otherwise(out)
    return out


def mean_chance(q: Matrix, pi: Sequence[float], length: Column) -> Column:
    """The same, as the mean over states by their frequencies."""
    return F.least(F.lit(1.0), sum((F.lit(float(p)) * chance_of_events(q, F.lit(i), length) for i, p in enumerate(pi)), F.lit(0.0)))


def _uniform(seed: int, *keys: str) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11).cast("double") + 0.5) / float(1 << 53)


def sample_paths(ends: DataFrame, q: Matrix, seed: int = 1, linked: bool = False) -> DataFrame:
    """ends(tree_id, node, site, start_state, end_state, length, scale, top) -> EVENTS: a path for each row, one that isn't empty where its ends agree. length times scale: of
    the branch on the clock of q; top: the height of its start. linked: with prev_time, the time of the event before in the same path. Rows are independent, in Arrow batches."""
    keyed = ends.select("tree_id", "node", "site", "start_state", "end_state", "length", "scale", "top", F.xxhash64(F.lit(seed), F.lit("path"), "tree_id", "node", "site").alias("seed"))

    def run(frames):
        import numpy as np
        import pandas as pd

        chain = Uniformised(q)
        for f in frames:
            which, times, old, new = paths(chain, f["start_state"], f["end_state"], (f["length"] * f["scale"]).to_numpy(float), f["seed"].to_numpy(np.int64).view(np.uint64))
            heights = f["top"].to_numpy(float)[which] - times / f["scale"].to_numpy(float)[which]
            out = {**{c: f[c].to_numpy()[which] for c in ("tree_id", "node", "site")}, "time": heights, "old_state": old, "new_state": new}
            if linked:
                out["prev_time"] = np.where(np.append(-1, which[:-1]) == which, np.append(0.0, heights[:-1]), np.nan) if len(which) else heights
            yield pd.DataFrame(out)

    return keyed.mapInPandas(run, EVENTS + ", prev_time double" * linked)


def sites_with_events(branches: DataFrame, site_category: DataFrame, seed: int = 1) -> DataFrame:
    """tree_id, node, site: sites of each branch, each with the chance of its branch and category, by skipping over those without: as much work as there are results.
    branches(tree_id, node, category, chance); site_category(site, category)."""
    place = Window.partitionBy("category").orderBy("site")
    numbered = cut(site_category.select("site", "category", (F.row_number().over(place) - 1).cast("long").alias("nth")))
    sizes = numbered.groupBy("category").agg(F.count("*").alias("n"))
    rows = branches.join(sizes, "category").where("chance > 0").select("tree_id", "node", "category", "n", "chance", F.xxhash64(F.lit(seed), F.lit("sites"), "tree_id", "node", "category").alias("seed"))

    def run(frames):
        import numpy as np
        import pandas as pd

        for f in frames:
            n, chance, keys = f["n"].to_numpy(np.int64), f["chance"].to_numpy(float), f["seed"].to_numpy(np.int64).view(np.uint64)
            with np.errstate(divide="ignore"):
                log_without = np.log1p(-np.minimum(chance, 1.0))  # a certain one has gaps of one
            at, left, turn, found, held = np.full(len(n), -1, np.int64), np.arange(len(n)), 0, [], 0
            while len(left):
                # the next gap of all that aren't through their sites
                gaps = np.floor(np.log(draws(keys[left], turn)) / log_without[left]) + 1
                at[left] += np.minimum(gaps, n[left] + 1.0).astype(np.int64)
                left, turn = left[at[left] < n[left]], turn + 1
                found.append((left, at[left]))
                held += len(left)
                if held and (held > LARGEST or not len(left)):
                    which, nth = (np.concatenate(x) for x in zip(*found))
                    yield pd.DataFrame({**{c: f[c].to_numpy()[which] for c in ("tree_id", "node", "category")}, "nth": nth})
                    found, held = [], 0

    return rows.mapInPandas(run, "tree_id long, node long, category long, nth long").join(numbered, ["category", "nth"]).select("tree_id", "node", "site")


def branch_histories(
    node: DataFrame, differing: DataFrame, states: DataFrame, reference: DataFrame, site_category: DataFrame, branch_rate: DataFrame, q: Matrix, pi: Sequence[float], scales: Sequence[float], seed: int = 1
) -> DataFrame:
    """EVENTS of all branches. differing(tree_id, node, site, start_state, end_state): sites whose ends differ; all others of site_category(site, category) agree, in the state of the
    parent: of states(tree_id, node, site, state) or else of reference(site, state). branch_rate(tree_id, node, rate) times scales by category: how fast q's clock runs. Paths of sites that
    differ are exact; of the others, each has events with the mean chance of its branch and category, and then an exact path. With equal rates that chance is each state's
    own, and histories are exact. Branches without length have no events."""
    above = node.select("tree_id", F.col("node").alias("parent"), F.col("height").alias("top"))
    branch = node.where("parent IS NOT NULL").select("tree_id", "node", "parent", "height").join(above, ["tree_id", "parent"]).join(branch_rate, ["tree_id", "node"])
    branch = sized(branch.select("tree_id", "node", "parent", "top", "rate", (F.col("top") - F.col("height")).alias("length")).where("length > 0"))
    by_category = F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("category"), F.lit(float(s)).alias("scale")) for i, s in enumerate(scales))))
    clocked = branch.select("tree_id", "node", "length", "rate", by_category.alias("c")).select("tree_id", "node", "c.category", mean_chance(q, pi, F.col("length") * F.col("rate") * F.col("c.scale")).alias("chance"))
    # packed files of states and events, many to a branch, look smaller than they are
    chosen = sites_with_events(clocked, site_category, seed).join(differing.hint("merge"), ["tree_id", "node", "site"], "left_anti")
    parent_state = states.select("tree_id", F.col("node").alias("parent"), "site", "state").hint("merge")
    agreeing = chosen.join(branch.select("tree_id", "node", "parent"), ["tree_id", "node"]).join(parent_state, ["tree_id", "parent", "site"], "left").join(reference.select("site", F.col("state").alias("base")), "site")
    agreeing = agreeing.select("tree_id", "node", "site", F.coalesce("state", "base").cast("long").alias("start_state")).withColumn("end_state", F.col("start_state"))
    scale = F.element_at(F.array(*(F.lit(float(s)) for s in scales)), (F.col("category") + 1).cast("int"))
    ends = differing.select("tree_id", "node", "site", F.col("start_state").cast("long"), F.col("end_state").cast("long")).unionByName(agreeing).join(branch.select("tree_id", "node", "top", "rate", "length"), ["tree_id", "node"])
    return sample_paths(ends.join(site_category, "site").withColumn("scale", F.col("rate") * scale), q, seed)


def exact_histories(node: DataFrame, tip_state: DataFrame, q: Matrix, pi: Sequence[float], seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(reference, events) of trees: states of all nodes drawn exactly given the tips, site by site, and paths between them. reference: tree_id, site, state, those of
    the roots, so that nothing happens above them; events: EVENTS and prev_time, the time of the one before at the site of the branch."""
    states = cut(site_histories(node, tip_state, q, pi, seed))
    some = (F.col("start_state") != F.col("state")) | (_uniform(seed, "tree_id", "node", "site") < chance_of_events(q, F.col("start_state"), F.col("length")))
    ends = states.where("length > 0").where(some).select("tree_id", "node", "site", "start_state", F.col("state").alias("end_state"), "length", F.lit(1.0).alias("scale"), "top")
    events = sample_paths(ends, q, seed, linked=True).withColumn("prev_time", F.when(~F.isnan("prev_time"), F.col("prev_time")))
    return states.where("start_state IS NULL").select("tree_id", "site", "state"), events


@plan("starts")
def end_states(d: Dialect, seed: int = 1) -> str:
    """starts(tree_id, node, site, start_state, mask, jumps): a state at the end of each branch under equal rates, of those its mask allows (15: all), with the log of its
    probability among them. jumps: expected number. The draw is a hash of seed and key; null where nothing is allowed, or only what a branch without length can't reach."""
    chance = [f"CASE WHEN {d.idiv('mask', str(1 << k))} % 2 = 0 THEN 0.0E0 WHEN start_state = {k} THEN 1 - 3 * p ELSE p END AS p{k}" for k in range(4)]
    key = f"concat('{seed}', ':', CAST(tree_id AS {d.text}), ':', CAST(node AS {d.text}), ':', CAST(site AS {d.text}))"
    upto = ["p0", "p0 + p1", "p0 + p1 + p2"]
    picked = " ".join(f"WHEN p{k} > 0 AND u < {upto[k]} THEN {k}" for k in range(3))
    # rounding may leave nothing above a draw: then the last that is possible
    last = " ".join(f"WHEN p{k} > 0 THEN {k}" for k in (3, 2, 1, 0))
    return f"""WITH x AS (SELECT tree_id, node, site, start_state, mask, -{d.expm1("-jumps * 4 / 3.0E0")} / 4 AS p FROM {{starts}}),
      y AS (SELECT tree_id, node, site, start_state, {", ".join(chance)} FROM x),
      z AS (SELECT y.*, p0 + p1 + p2 + p3 AS total, ({d.hash32(key)} + 0.5E0) / 4294967296.0E0 * (p0 + p1 + p2 + p3) AS u FROM y),
      e AS (SELECT z.*, CASE {picked} ELSE CASE {last} END END AS end_state FROM z)
      SELECT tree_id, node, site, CAST(start_state AS BIGINT) AS start_state, CAST(end_state AS BIGINT) AS end_state, round(CASE end_state WHEN 0 THEN ln(p0 / total) WHEN 1 THEN ln(p1 / total) WHEN 2 THEN ln(p2 / total) WHEN 3 THEN ln(p3 / total) END, 6) AS log_probability FROM e"""
