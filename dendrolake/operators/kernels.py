"""Samplers on independent units, sites or branches, in grouped tasks. A draw's seed is a hash of the unit's key,
so that it doesn't depend on order, partitions or retries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.plan import Dialect, plan
from .sweeps import tree_levels


@plan("weighted")
def categorical_pick(d: Dialect) -> str:
    """weighted(grp, item, weight): an item of each group by its weight; the draw is a hash of the group, the
    item the first whose cumulative weight is above it."""
    u = f"({d.hash32(f'CAST(grp AS {d.text})')} + 0.5E0) / 4294967296.0E0"
    return f"""WITH c AS (SELECT grp, item, weight, sum(weight) OVER (PARTITION BY grp ORDER BY item ROWS UNBOUNDED PRECEDING) AS upto, sum(weight) OVER (PARTITION BY grp) AS total FROM {{weighted}} WHERE weight > 0)
      SELECT grp, min(item) AS item FROM c WHERE upto > total * {u} OR upto = total GROUP BY grp"""


class Uniformised:
    """A Markov chain with rates q as jumps at one rate; powers of its jump matrix are kept for all bridges."""

    def __init__(self, q):
        import numpy as np

        self.q = np.asarray(q, float)
        self.mu = float(-self.q.diagonal().min())
        self.powers = [np.eye(len(self.q))]
        self.jump = self.powers[0] + self.q / self.mu
        self._table = self._ways = np.zeros((0, *self.q.shape))

    def power(self, n: int):
        while len(self.powers) <= n:
            self.powers.append(self.powers[-1] @ self.jump)
        return self.powers[n]

    def table(self, n: int):
        """All powers up to the n-th, or more."""
        import numpy as np

        if len(self._table) <= n:
            self.power(max(n, 2 * len(self._table)))
            self._table = np.stack(self.powers)
            # to leave a state and come back, with the last jump from elsewhere or with one more stay; nothing is subtracted
            self._ways, stay = self._table.copy(), self.jump.diagonal()
            into = np.einsum("nij,ji->ni", self._table, self.jump - np.diag(stay))
            come = np.zeros((len(self._table), len(self.q)))
            for k in range(1, len(come)):
                come[k] = come[k - 1] * stay + into[k - 1]
            self._ways[:, range(len(self.q)), range(len(self.q))] = come
        return self._table

    def ways(self, n: int):
        """The same, where a state and itself have only the ways that leave it."""
        self.table(n)
        return self._ways

    def jumps(self, start: int, end: int, length: float, u: float) -> int:
        """How many jumps there are, given both ends: the least number whose share of the way to the end state exceeds u. Chances of numbers are
        formed from their logarithms, so that long branches, where none or few jumps have no chance that a number can hold, are no
        exception; past the number that all of it is below, the rest is rounding. Raises where the end can't be reached."""
        from math import exp, lgamma, log, sqrt

        from ..functions.ctmc import transition

        goal = transition(self.q, length)[start, end] * u
        mean = self.mu * length
        if mean <= 0 and start != end:
            raise ValueError("a branch without length can't change a state")
        most, total, n = mean + 40 * sqrt(mean) + 100, 0.0, 0
        while True:
            total += (exp(n * log(mean) - mean - lgamma(n + 1)) if mean > 0 else 1.0) * self.power(n)[start, end]
            if total > goal and total > 0:
                return n
            if n > most:
                if total <= 0:
                    raise ValueError(f"state {end} can't be reached from state {start}")
                return n
            n += 1


def bridge(q, start: int, end: int, length: float, rng) -> list[tuple[float, int]]:
    """Events (time from the start, new state) of a Markov chain with rates q, or a Uniformised one, given its states at both ends: by
    uniformisation, the number of jumps first, then their states backwards from the end's probabilities."""
    import numpy as np

    chain = q if isinstance(q, Uniformised) else Uniformised(q)
    n = chain.jumps(start, end, length, rng.random())
    times = np.sort(rng.random(n)) * length
    out, state = [], start
    for k in range(n):
        w = chain.jump[state] * chain.power(n - k - 1)[:, end]
        new = int(np.searchsorted(np.cumsum(w), rng.random() * w.sum(), "right"))
        if new != state:
            out.append((float(times[k]), new))
            state = new
    return out


def draws(keys, number):
    """The draws of these numbers from the streams that keys (64 bits) name, above zero and below one: splitmix64, for many streams at once."""
    import numpy as np

    z = keys + (np.asarray(number).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (((z ^ (z >> np.uint64(31))) >> np.uint64(12)).astype(float) + 0.5) * 2.0**-52


def path_jumps(chain: Uniformised, start, end, mean, u):
    """How many jumps the path of each row has, given its ends, and where these agree that it leaves them: the least number whose share of all the ways is above u. Chances are relative to
    that of the likeliest number, so that neither short nor long branches are out of what numbers can hold; they are added until the rest can't count."""
    from math import lgamma

    import numpy as np

    if not (mean > 0).all():
        raise ValueError("a branch without length has no events")
    states, most = len(chain.q), (mean + 40 * np.sqrt(mean) + 100).astype(np.int64)
    ways = chain.ways(int(most.max()) + 1)
    # the fewest jumps between two states
    can = ways[: states + 1] > 0
    fewest = np.where(can.any(0), can.argmax(0), -1)[start, end]
    if (fewest < 0).any():
        k = int((fewest < 0).argmax())
        raise ValueError(f"state {end[k]} can't be reached from state {start[k]}")
    logs, table = np.log(mean), np.array([lgamma(n + 1) for n in range(int(most.max()) + 2)])
    peak = np.maximum(fewest, mean.astype(np.int64))
    top = peak * logs - table[peak]

    def added(limit=None):
        """All chances added up, or with a limit how many jumps it takes to pass it."""
        total, number, left, n = np.zeros(len(mean)), np.zeros(len(mean), np.int64), np.arange(len(mean)), int(fewest.min())
        while len(left):
            chance = np.exp(np.where(n < fewest[left], -np.inf, n * logs[left] - table[n] - top[left]))
            total[left] += chance * ways[n][start[left], end[left]]
            if limit is None:
                rest = np.where(n + 1 > mean[left], chance * mean[left] / np.maximum(n + 1 - mean[left], 1e-3), np.inf)
                on = ((n < peak[left]) | (rest > 1e-17 * total[left])) & (n < most[left])
            else:
                number[left] = n
                on = (total[left] <= limit[left]) & (n < most[left])
            left, n = left[on], n + 1
        return total if limit is None else number

    return added(u * added())


def paths(chain: Uniformised, start, end, length, keys, cells: int = 1 << 20):
    """(row, time from the start, old state, new state) of the events of a path for each row, one that isn't empty where its ends agree, in the order of rows and times: as bridge, for
    all rows of a batch at once. keys: of each row's stream of draws. At most about `cells` jumps are held at a time."""
    import numpy as np

    start, end, length, keys = np.asarray(start, np.int64), np.asarray(end, np.int64), np.asarray(length, float), np.asarray(keys, np.uint64)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
    numbers = path_jumps(chain, start, end, chain.mu * length, draws(keys, 0))
    powers, ways = chain.table(int(numbers.max())), chain.ways(int(numbers.max()))
    part = (np.cumsum(numbers) - 1) // cells
    out = []
    for rows in np.split(np.arange(len(start)), np.flatnonzero(np.diff(part)) + 1):
        n = numbers[rows]
        first, row = np.cumsum(n) - n, np.repeat(np.arange(len(rows)), n)
        nth = np.arange(len(row)) - first[row]
        at = draws(keys[rows][row], nth + 1)
        at = at[np.lexsort((at, row))]
        u = draws(keys[rows][row], n[row] + nth + 1)
        old, new = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        order = np.argsort(-n, kind="stable")  # those with jumps left come first
        now, goal, place, jumps = start[rows][order].copy(), end[rows][order], first[order], n[order]
        stays = now == goal
        for k in range(int(n.max(initial=0))):
            m = int(np.searchsorted(-jumps, -k, "left"))
            here, to, left = now[:m], goal[:m], jumps[:m] - k - 1
            w = chain.jump[here] * powers[left, :, to]
            still = np.flatnonzero(stays[:m])  # a path that must leave and hasn't yet: without the ways of staying throughout
            w[still, here[still]] = chain.jump[here[still], here[still]] * ways[left[still], here[still], here[still]]
            upto = np.cumsum(w, 1)
            chosen = (upto <= (u[place[:m] + k] * upto[:, -1])[:, None]).sum(1)
            old[place[:m] + k], new[place[:m] + k] = here, chosen
            stays[:m] &= chosen == here
            now[:m] = chosen
        kept = np.flatnonzero(old != new)
        out.append((rows[row[kept]], at[kept] * length[rows][row[kept]], old[kept], new[kept]))
    return tuple(np.concatenate(x) for x in zip(*out))


def sample_bridges(ends: DataFrame, q: Sequence[Sequence[float]], seed: int = 1) -> DataFrame:
    """ends(tree_id, node, site, start_state, end_state, length) -> events (tree_id, node, site, time, old_state,
    new_state), time counted from the start. Rows are independent: Arrow batches, no grouping."""
    schema = "tree_id long, node long, site long, time double, old_state long, new_state long"
    keyed = ends.select("tree_id", "node", "site", "start_state", "end_state", "length", F.xxhash64(F.lit(seed), "tree_id", "node", "site").alias("seed"))

    def run(frames):
        import numpy as np
        import pandas as pd

        chain = Uniformised(q)
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                state = int(r.start_state)
                for t, new in bridge(chain, state, int(r.end_state), float(r.length), np.random.default_rng(int(r.seed) & ((1 << 63) - 1))):
                    out.append((r.tree_id, r.node, r.site, t, state, new))
                    state = new
            yield pd.DataFrame(out, columns=["tree_id", "node", "site", "time", "old_state", "new_state"])

    return keyed.mapInPandas(run, schema)


def site_histories(node: DataFrame, tip_state: DataFrame, q: Sequence[Sequence[float]], pi: Sequence[float], seed: int = 1) -> DataFrame:
    """tree_id, site, node, state, start_state, top, length: states of all nodes of each site given its tips, sampled exactly: partial likelihoods up the tree, states
    down, each over all nodes of a level at once. start_state, top: state and height of the parent; null at a root. Sites are independent given the tree; a group is one tree and
    site, and a draw depends on the key of its row alone."""
    topology = node.select("tree_id", "node", "parent", "is_leaf", "height")
    rows = topology.join(tip_state.select("tree_id", "site").distinct(), "tree_id").join(tip_state, ["tree_id", "node", "site"], "left").select("tree_id", "site", "node", "parent", "is_leaf", "height", "mask")

    def run(key, frame):
        import numpy as np
        import pandas as pd

        from ..functions.ctmc import eigen_terms

        terms, values = eigen_terms(np.asarray(q, float))
        frame = frame.sort_values("node")
        nodes, height = frame["node"].to_numpy(np.int64), frame["height"].to_numpy(float)
        some = frame["parent"].notna().to_numpy()
        parent, levels = tree_levels(nodes, frame["parent"].fillna(0).to_numpy(np.int64), some)
        mask = np.where(frame["is_leaf"].to_numpy(bool), frame["mask"].fillna(15).to_numpy(np.int64), 15)
        like = ((mask[:, None] >> np.arange(4)) & 1).astype(float)

        def up(at):
            return np.maximum(0.0, np.eye(4) + np.einsum("ijk,rk->rij", terms, np.expm1((height[parent[at]] - height[at])[:, None] * values)))

        for at in levels[:0:-1]:
            with np.errstate(divide="ignore"):
                heard = np.log(np.einsum("rij,rj->ri", up(at), like[at]))
            above, first = np.unique(parent[at], return_index=True)
            # only what states are to each other counts; unscaled products of thousands of tips vanish
            sums = np.add.reduceat(heard, first)
            most = sums.max(1, keepdims=True)
            like[above] *= np.exp(sums - np.where(np.isfinite(most), most, 0.0))
        base = np.random.SeedSequence([seed, *(int(k) & (1 << 64) - 1 for k in key)]).generate_state(1, np.uint64)
        u, state = draws(base + nodes.astype(np.uint64), 0), np.zeros(len(nodes), np.int64)
        for level, at in enumerate(levels):
            w = like[at] * (up(at)[np.arange(len(at)), state[parent[at]]] if level else np.asarray(pi, float))
            upto = np.cumsum(w, 1)
            if not (upto[:, -1] > 0).all():
                raise ValueError(f"tree {key[0]} can't have the states of its tips at site {key[1]}")
            state[at] = (upto <= (u[at] * upto[:, -1])[:, None]).sum(1)
        return pd.DataFrame({
            "tree_id": key[0], "site": key[1], "node": nodes, "state": state, "start_state": np.where(some, state[parent], np.nan), "top": np.where(some, height[parent], np.nan),
            "length": np.where(some, height[parent] - height, np.nan),
        })

    return rows.groupBy("tree_id", "site").applyInPandas(run, "tree_id long, site long, node long, state long, start_state double, top double, length double").withColumn("start_state", F.col("start_state").cast("long"))


def sample_site_histories(node: DataFrame, tip_state: DataFrame, q: Sequence[Sequence[float]], pi: Sequence[float], seed: int = 1) -> DataFrame:
    """tree_id, site, node, state of site_histories."""
    return site_histories(node, tip_state, q, pi, seed).select("tree_id", "site", "node", "state")
