"""Histories drawn given their ends: what they must keep, and how often, against closed forms."""

import math
from collections import Counter

import numpy as np
import pytest

from dendrolake.functions.ctmc import hky, transition
from dendrolake.operators import branch_histories as bh
from dendrolake.operators import regions
from dendrolake.operators.kernels import Uniformised

from .test_hazards_ratios import NODE, shape

Q = hky((0.1, 0.2, 0.3, 0.4), 2.0).tolist()


def test_paths_that_return_leave_first():
    """Against paths drawn freely and kept if they return and aren't empty."""
    chain, rng, length = Uniformised(Q), np.random.default_rng(1), 0.8
    drawn = [bh.returning(chain, 0, length, rng) for _ in range(4000)]
    assert all(len(p) >= 2 and p[-1][1] == 0 and all(0 <= t <= length for t, _ in p) and [t for t, _ in p] == sorted(t for t, _ in p) for p in drawn)
    assert all(a != b for p in drawn for a, b in zip([0, *(s for _, s in p)], (s for _, s in p)))
    q, free = np.array(Q), []
    while len(free) < 4000:
        at, t, path = 0, 0.0, []
        while (t := t + rng.exponential(1 / -q[at, at])) < length:
            w = np.maximum(q[at], 0)
            at = int(rng.choice(4, p=w / w.sum()))
            path.append((t, at))
        if path and at == 0:
            free.append(path)
    for of in (lambda p: len(p) == 2, lambda p: p[0][1] == 3, lambda p: p[0][0] < 0.2):
        assert np.mean([of(p) for p in drawn]) == pytest.approx(np.mean([of(p) for p in free]), abs=0.04)
    short = [bh.returning(chain, 2, 1e-9, rng) for _ in range(20)]  # as rare as 1e-18: nothing is drawn in vain
    assert all(len(p) == 2 for p in short)
    with pytest.raises(ValueError):
        bh.returning(chain, 0, 0.0, rng)
    with pytest.raises(ValueError):
        bh.returning(Uniformised([[-1.0, 1.0], [0.0, 0.0]]), 0, 1.0, rng)


def test_chances_are_closed_forms(spark):
    rows = spark.createDataFrame([(s, t) for s in range(4) for t in (1e-6, 0.1, 3.0)], "s long, t double").select("s", "t", bh.chance_of_events(Q, spark_col("s"), spark_col("t")).alias("p"), bh.mean_chance(Q, (0.1, 0.2, 0.3, 0.4), spark_col("t")).alias("m")).collect()
    for r in rows:
        assert r.p == pytest.approx(1 - math.exp(Q[r.s][r.s] * r.t) / transition(np.array(Q), r.t)[r.s, r.s], abs=1e-9)
    by = {(r.s, r.t): r for r in rows}
    for t in (1e-6, 0.1, 3.0):
        assert by[0, t].m == pytest.approx(sum(p * by[i, t].p for i, p in enumerate((0.1, 0.2, 0.3, 0.4))))


def spark_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_sites_by_skipping(spark):
    branches = spark.createDataFrame([(1, n, n % 2, 0.01) for n in range(40)] + [(1, 50, 0, 1.0), (1, 51, 0, 0.0), (1, 52, 7, 0.5), (1, 53, 0, 1e-300)], "tree_id long, node long, category long, chance double")
    sites = spark.createDataFrame([(s, s % 2) for s in range(3000)], "site long, category long")
    rows = bh.sites_with_events(branches, sites, 3).collect()
    seen = Counter(r.node for r in rows)
    assert len({(r.node, r.site) for r in rows}) == len(rows) and all(r.site % 2 == (r.node % 2 if r.node < 40 else 0) for r in rows)
    assert seen[50] == 1500 and not seen[51] and not seen[52] and not seen[53]
    few = [r for r in rows if r.node < 40]
    assert len(few) == pytest.approx(600, abs=110) and np.mean([r.site for r in few]) == pytest.approx(1500, abs=150)
    again = bh.sites_with_events(branches.repartition(5), sites.repartition(3), 3)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))
    assert bh.sites_with_events(branches, sites.limit(0)).count() == 0


def consistent(events, start, end, lo, hi):
    """events of one branch and site, latest last."""
    at, last = start, hi
    for e in events:
        assert e.old_state == at and e.new_state != at and lo <= e.time <= last
        at, last = e.new_state, e.time
    assert at == end


def grouped(rows):
    out = {}
    for r in sorted(rows, key=lambda r: -r.time):
        out.setdefault((r.node, r.site), []).append(r)
    return out


def test_histories_of_branches(spark):
    node = spark.createDataFrame(shape(), NODE)
    height, parent = {n: h for _, n, _, _, _, _, h in shape()}, {n: p for _, n, p, *_ in shape()}
    sites = 400
    reference = spark.createDataFrame([(s, s % 4) for s in range(sites)], "site long, state long")
    states = spark.createDataFrame([(1, 7, 0, 3)], "tree_id long, node long, site long, state long")
    differing = spark.createDataFrame([(1, 7, 0, 0, 3), (1, 2, 9, 1, 2)], "tree_id long, node long, site long, start_state long, end_state long")
    category = spark.createDataFrame([(s, s % 2) for s in range(sites)], "site long, category long")
    rate = spark.createDataFrame([(1, n, 0.5) for n in range(9)], "tree_id long, node long, rate double")
    rows = bh.branch_histories(node, differing, states, reference, category, rate, bh.equal_rates(), [0.25] * 4, (0.5, 1.0)).collect()
    by = grouped(rows)
    assert (7, 0) in by and (2, 9) in by and all(n != 8 for n, _ in by)
    for (n, s), events in by.items():
        ends = {(7, 0): (0, 3), (2, 9): (1, 2)}.get((n, s)) or (3 if parent[n] == 7 and s == 0 else s % 4,) * 2
        consistent(events, *ends, height[n], height[parent[n]])
    # under equal rates the number of sites with events is a sum of known chances
    for scale in (0.5, 1.0):
        chance = [1 - math.exp(-x) / (0.25 + 0.75 * math.exp(-4 / 3 * x)) for x in (0.5 * scale * (height[parent[n]] - height[n]) for n in range(8))]
        want = sum(chance) * sites / 2
        assert sum(1 for _, s in by if s % 2 == (scale == 1.0)) == pytest.approx(want, abs=5 * math.sqrt(want))


def test_exact_histories_agree_with_tips(spark):
    node = spark.createDataFrame(shape(), NODE)
    height, parent = {n: h for _, n, _, _, _, _, h in shape()}, {n: p for _, n, p, *_ in shape()}
    masks = {(t, s): (1 << ((t * 3 + s) % 4)) if (t + s) % 5 else 15 for t in range(5) for s in range(40)}
    tips = spark.createDataFrame([(1, t, s, m) for (t, s), m in masks.items()], "tree_id long, node long, site long, mask int")
    reference, events = bh.exact_histories(node, tips, Q, (0.1, 0.2, 0.3, 0.4), 5)
    root, by = {r.site: r.state for r in reference.collect()}, grouped(events.collect())
    assert set(root) == set(range(40)) and any(len(e) > 1 for e in by.values())
    state = {(8, s): x for s, x in root.items()}
    for n in range(7, -1, -1):
        for s in root:
            here = by.get((n, s), [])
            state[n, s] = here[-1].new_state if here else state[parent[n], s]
            consistent(here, state[parent[n], s], state[n, s], height[n], height[parent[n]])
            assert [e.prev_time for e in here] == [None, *(e.time for e in here)][: len(here)]
    assert all(masks[t, s] >> state[t, s] & 1 for t, s in masks)


def test_states_at_ends(spark):
    rows = [(1, 0, s, s % 4, 15, 0.6) for s in range(4000)] + [(2, 0, s, 0, 6, 0.1) for s in range(2000)] + [(3, 0, 0, 1, 0, 0.5), (3, 0, 1, 1, 4, 0.0), (3, 0, 2, 1, 15, 0.0), (3, 0, 3, None, 15, 0.5)]
    got = bh.end_states(starts=spark.createDataFrame(rows, "tree_id long, node long, site long, start_state int, mask int, jumps double")).collect()
    p = (1 - math.exp(-0.8)) / 4
    assert np.mean([r.end_state == r.start_state for r in got if r.tree_id == 1]) == pytest.approx(1 - 3 * p, abs=0.03)
    assert all(r.log_probability == pytest.approx(math.log(1 - 3 * p if r.end_state == r.start_state else p), abs=1e-5) for r in got if r.tree_id == 1)
    two = Counter(r.end_state for r in got if r.tree_id == 2)
    assert set(two) == {1, 2} and two[1] == pytest.approx(1000, abs=120)
    assert {r.site: r.end_state for r in got if r.tree_id == 3 and r.site < 3} == {0: None, 1: None, 2: 1}


def test_no_step_explores_nothing(spark):
    node = spark.createDataFrame(shape(), NODE)
    mut = spark.createDataFrame([(1, 7, 3.0, 0, 0, 1), (1, 4, 2.0, 1, 0, 2), (1, 4, 1.5, 0, 1, 0)], "tree_id long, node long, time double, site long, old_state long, new_state long")
    states = spark.createDataFrame([(1, n, s, x) for n, s, x in ((7, 0, 1), (5, 0, 1), (4, 0, 0), (4, 1, 2), (0, 0, 1), (1, 0, 1))], "tree_id long, node long, site long, state long")
    reference = spark.createDataFrame([(0, 0), (1, 0)], "site long, state long")

    def of(x, radius):
        return [tuple(r)[1:] for r in regions.sorted_regions(node, mut, states, reference, spark.createDataFrame([(1, x)], "tree_id long, x long"), radius).orderBy("node", "idx").collect()]

    assert of(0, 0) == [] and of(7, 3) == []
    # tip 0 differs at no site from node 7; the branch of tip 4 brings two differences, that of 6 is two steps away
    assert of(0, 1) == [(4, 0, 2.7, 2.0, 0, 0), (4, 1, 2.0, 1.5, 1, 0), (4, 2, 1.5, 0.9, 2, 0), (7, 0, 4.5, 2.7, 0, 1)]
    assert [r[0] for r in of(0, 2)] == [4, 4, 4, 6, 7]
    with pytest.raises(ValueError):
        of(0, -1)


def test_paths_of_a_batch_are_drawn_as_single_ones():
    """By numbers of events, first states and times, against paths drawn one by one; and whatever else is in the batch."""
    from dendrolake.operators.kernels import bridge, paths

    chain, rng, n = Uniformised(Q), np.random.default_rng(4), 6000
    for a, b, length in ((0, 0, 0.8), (0, 3, 0.8), (2, 2, 1e-9), (1, 1, 1e-200), (1, 3, 40.0)):
        which, times, old, new = paths(chain, np.full(n, a), np.full(n, b), np.full(n, length), rng.integers(0, 1 << 63, n).astype(np.uint64))
        first = np.searchsorted(which, np.arange(n))
        last, same = np.append(first[1:], len(which)) - 1, which[1:] == which[:-1]
        assert (old[first] == a).all() and (new[last] == b).all() and (old != new).all() and (old[1:][same] == new[:-1][same]).all()
        assert (times >= 0).all() and (times <= length).all() and (times[1:][same] >= times[:-1][same]).all()
        single = [bh.returning(chain, a, length, rng) if a == b else bridge(chain, a, b, length, rng) for _ in range(2000)]
        count, want = np.bincount(which, minlength=n), np.array([len(p) for p in single])
        assert count.mean() == pytest.approx(want.mean(), rel=0.03) and np.mean(count == 2) == pytest.approx(np.mean(want == 2), abs=0.05)
        assert np.bincount(new[first], minlength=4) / n == pytest.approx(np.bincount([p[0][1] for p in single], minlength=4) / 2000, abs=0.05)
        assert np.mean(times[first] < 0.2 * length) == pytest.approx(np.mean([p[0][0] < 0.2 * length for p in single]), abs=0.05)
    rows = (np.arange(300) % 4, np.arange(300) % 3, rng.random(300) * 5 + 0.01, rng.integers(0, 1 << 63, 300).astype(np.uint64))
    whole, parts = paths(chain, *rows), paths(chain, *rows, cells=7)
    assert all((x == y).all() for x, y in zip(whole, parts))
    one = [paths(chain, *(x[k: k + 1] for x in rows)) for k in range(300)]
    assert np.allclose(np.concatenate([x[1] for x in one]), whole[1]) and (np.concatenate([x[3] for x in one]) == whole[3]).all()
    for bad in ((Uniformised([[-1.0, 1.0], [0.0, 0.0]]), [0], [0], [1.0], [1]), (chain, [0], [0], [0.0], [1]), (chain, [0], [1], [0.0], [1])):
        with pytest.raises(ValueError):
            paths(*bad)


def test_states_given_tips_have_their_exact_chances(spark):
    """Four tips with unlike heights: how often the root and an inner node have each state over many sites, against the sum over all states."""
    from dendrolake.operators.kernels import sample_site_histories

    node = spark.createDataFrame(shape(), NODE)
    height, parent = {n: h for _, n, _, _, _, _, h in shape()}, {n: p for _, n, p, *_ in shape()}
    masks, sites, pi = {0: 1, 1: 2, 2: 2, 3: 12, 4: 15}, 1500, (0.1, 0.2, 0.3, 0.4)
    tips = spark.createDataFrame([(1, t, s, m) for t, m in masks.items() for s in range(sites)], "tree_id long, node long, site long, mask int")
    inner = [n for n in height if n not in masks]
    p = {n: transition(np.array(Q), height[parent[n]] - height[n]) for n in height if parent[n] is not None}
    joint = Counter()
    for code in range(4 ** len(inner)):
        x = {n: code // 4**k % 4 for k, n in enumerate(inner)}
        w = math.prod(pi[x[n]] if parent[n] is None else p[n][x[parent[n]], x[n]] for n in inner)
        w *= math.prod(sum(p[t][x[parent[t]], s] for s in range(4) if m >> s & 1) for t, m in masks.items())
        for n in inner:
            joint[n, x[n]] += w
    rows = sample_site_histories(node, tips, Q, pi, 3).collect()
    seen, total = Counter((r.node, r.state) for r in rows if r.node in inner), sum(joint[inner[0], s] for s in range(4))
    assert all(seen[n, s] / sites == pytest.approx(joint[n, s] / total, abs=0.05) for n in inner for s in range(4))
    again = sample_site_histories(node.repartition(7), tips.repartition(5), Q, pi, 3).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    with pytest.raises(Exception, match="can't have the states"):
        sample_site_histories(node, tips.where("site = 0").withColumn("mask", tips["mask"] * 0), Q, pi).collect()


def test_batches_of_paths_draw_nothing_row_by_row(spark):
    """A batch takes less than a fifth of the time of single draws, by row."""
    import time

    from dendrolake.operators.kernels import paths

    chain, n = Uniformised(Q), 100_000
    keys = np.random.default_rng(6).integers(0, 1 << 63, n).astype(np.uint64)
    began = time.process_time()
    paths(chain, np.arange(n) % 4, np.arange(n) // 4 % 4, np.full(n, 1.0), keys)
    batch = time.process_time() - began
    began = time.process_time()
    for k in range(1000):
        bh.returning(chain, k % 4, 1.0, np.random.default_rng(k))
    assert batch / n < (time.process_time() - began) / 1000 / 5
