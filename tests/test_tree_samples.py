"""Trees without clades, unrooted trees, histories from parsimony, long bridges."""

import random

import numpy as np
import pytest

from dendrolake.functions import ctmc
from dendrolake.operators import kernels, parsimony, tree_samples

from .test_goldens import random_tree

CLADES = "run string, i long, clade string"


def test_trees_without_clades_count(spark):
    rows = [("a", i, c) for i in range(12) if i % 3 for c in ("0,1", f"2,{3 + i % 2}")]
    trees = spark.createDataFrame([("a", i) for i in range(12)] + [("star", i) for i in range(8)], "run string, i long")
    clades = spark.createDataFrame(rows, CLADES)
    got = {r.run: r for r in tree_samples.tree_ess(clades, trees=trees).collect()}
    assert got["a"].trees == 12 and got["star"].trees == 8 and got["star"].frechet == 1
    changes = {r.run: (r.trees, r.changes) for r in tree_samples.topology_changes(clades=clades, trees=trees).collect()}
    assert changes == {"a": (12, 11), "star": (8, 0)}


def test_distances_by_who_has_a_clade():
    rng = random.Random(3)
    trees = [{rng.randrange(30) for _ in range(rng.randrange(9))} for _ in range(40)]
    rows = [(i, f"c{c}") for i, t in enumerate(trees) for c in t]
    rng.shuffle(rows)
    has = tree_samples.Sample([r[0] for r in rows], [r[1] for r in rows], 40)
    assert (has.distances(range(40)) == [[len(x ^ y) for y in trees] for x in trees]).all()


def test_clades_as_splits(spark):
    clades = spark.createDataFrame([("a", 0, "0,1"), ("a", 0, "2,3,4"), ("a", 0, "3,4"), ("a", 0, "0,1,2,3"), ("a", 1, "1,2,3,4")], CLADES)
    got = sorted(tuple(r) for r in tree_samples.unrooted(clades, spark.createDataFrame([("a", t) for t in range(5)], "run string, tip long")).collect())
    assert got == [("a", 0, "2,3,4"), ("a", 0, "3,4")]


def test_history_needs_no_events_above_the_root(spark):
    rng = random.Random(9)
    parents, heights, node = random_tree(spark, 9, 2)
    leaves = [n for n in parents if n not in set(parents.values())]
    tips = spark.createDataFrame([(1, n, s, rng.choice([1, 2, 4, 8, 15])) for n in leaves for s in range(5)], "tree_id long, node long, site long, mask int")
    reference = spark.createDataFrame([(s, s % 4) for s in range(5)], "site long, state long")
    states = parsimony.fitch_states(node, parsimony.fitch_sets(node, tips), reference)
    base, events = parsimony.parsimony_history(node, states)
    root = next(n for n, p in parents.items() if p is None)
    at = {(root, r.site): r.state for r in base.collect()}
    rows = events.collect()
    assert len(at) == 5 and all(r.node != root and heights[r.node] <= r.time <= heights[parents[r.node]] for r in rows)
    new = {(r.node, r.site): (r.old_state, r.new_state) for r in rows}
    for n in sorted(parents, key=lambda n: -heights[n]):
        for s in range(5):
            if n != root:
                above = at[parents[n], s]
                assert new.get((n, s), (above, None))[0] == above
                at[n, s] = new.get((n, s), (None, above))[1]
    assert at == {(r.node, r.site): r.state for r in states.collect()}


@pytest.mark.parametrize("length", [0.5, 30.0, 900.0])
def test_numbers_of_jumps_on_branches_of_any_length(length):
    chain = kernels.Uniformised(ctmc.hky((0.1, 0.2, 0.3, 0.4), 2.0))
    numbers = [chain.jumps(0, 0, length, u) for u in np.linspace(0.01, 0.99, 99)]
    mean = chain.mu * length
    if length > 10:  # as if there were no condition
        assert abs(np.mean(numbers) - mean) < 0.1 * mean**0.5 + 1 and np.std(numbers) == pytest.approx(mean**0.5, rel=0.15)
    assert numbers == sorted(numbers) and numbers[0] >= 0
    rng = np.random.default_rng(2)
    events = kernels.bridge(chain, 0, 3, length, rng)
    assert events[-1][1] == 3 and all(0 <= t <= length for t, _ in events)


def test_ends_that_cannot_be_reached():
    chain = kernels.Uniformised([[-1.0, 1.0, 0.0], [1.0, -1.0, 0.0], [0.0, 0.0, 0.0]])
    with pytest.raises(ValueError):
        chain.jumps(0, 2, 1.0, 0.5)
    with pytest.raises(ValueError):
        chain.jumps(0, 1, 0.0, 0.5)


@pytest.mark.parametrize("n, kinds, most", [(1, 4, 3), (60, 5, 4), (400, 8, 6), (300, 90, 12), (257, 3, 3), (200, 2000, 9)])
def test_squared_distances_add_up_over_clades(n, kinds, most):
    """Exactly as over all pairs of trees, with clades that many trees have, few, one; and trees without any."""
    rng = random.Random(n + kinds)
    trees = [{min(rng.randrange(kinds), rng.randrange(kinds)) for _ in range(rng.randrange(most + 1))} for _ in range(n)]
    rows = [(i, f"c{c}") for i, t in enumerate(trees) for c in t]
    has = tree_samples.Sample([r[0] for r in rows], [r[1] for r in rows], n)
    for got, want in zip(tree_samples.sums_by_clades(has), tree_samples.sums_by_blocks(has)):
        assert (got == want).all()


def test_chains_of_trees_need_no_pairs_of_trees(monkeypatch):
    rng = np.random.default_rng(2)
    n = 20_000
    clade = rng.integers(0, 3, (n, 6))
    has = tree_samples.Sample(np.repeat(np.arange(n), 6), [f"{k}:{c}" for row in clade for k, c in enumerate(row)], n)
    monkeypatch.setattr(tree_samples, "sums_by_blocks", None)
    assert tree_samples.frechet_ess(has) == pytest.approx(n, rel=0.2)


def test_runs_of_many_large_trees_take_pairs_of_trees(monkeypatch):
    rng = random.Random(1)
    rows = [(i, f"c{rng.randrange(6)}") for i in range(30) for _ in range(4)]
    has = tree_samples.Sample([r[0] for r in rows], [r[1] for r in rows], 30)
    want = tree_samples.frechet_ess(has)
    monkeypatch.setattr(tree_samples, "PAIRS", 0)
    monkeypatch.setattr(tree_samples, "sums_by_clades", None)
    assert tree_samples.frechet_ess(has) == want
