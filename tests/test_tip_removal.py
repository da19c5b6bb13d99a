"""Scores without a tip against trees that lack it; operators on trees whose leaves are numbered first."""

import random

import pytest

from dendrolake.operators import carries, history, parsimony, sweeps, tip_removal, trees

from .test_plans import tree

TIPS = "tree_id long, node long, site long, mask int"


def least_changes(children, masks, root, gone=None):
    """Fewest changes by dynamic programming over states; a node without anything below is skipped."""

    def costs(n):
        if n == gone:
            return None
        if n not in children:
            return [0 if masks[n] & (1 << s) else 99 for s in range(4)]
        below = [x for x in map(costs, children[n]) if x]
        return [sum(min(c[t] + (s != t) for t in range(4)) for c in below) for s in range(4)] if below else None

    return min(costs(root))


def random_tree(n, rng, widest=4):
    parents, tips, new = {0: None}, [0], 1
    while len(tips) < n:
        at = tips.pop(rng.randrange(len(tips)))
        for _ in range(rng.randint(2, widest)):
            parents[new] = at
            tips.append(new)
            new += 1
    return parents, tips


@pytest.mark.parametrize("seed, widest", [(1, 2), (2, 2), (3, 5)])
def test_scores_without_a_tip(spark, seed, widest):
    rng = random.Random(seed)
    parents, tips = random_tree(14, rng, widest)
    children = {}
    for c, p in parents.items():
        if p is not None:
            children.setdefault(p, []).append(c)
    masks = {(t, s): rng.choice([1, 2, 4, 8, 1, 2, 5, 15]) for t in tips for s in range(5)}
    node = tree(spark, parents, {n: -n for n in parents})
    got = tip_removal.removal_scores(node, spark.createDataFrame([(1, t, s, m) for (t, s), m in masks.items()], TIPS)).collect()
    want = {}
    for s in range(5):
        at = {t: masks[t, s] for t in tips}
        want |= {(t, s): (least_changes(children, at, 0), least_changes(children, at, 0, t)) for t in tips}
    assert {(r.node, r.site): (r.score, r.without) for r in got} == want


def test_removal_of_one_of_two_tips_leaves_nothing_to_change(spark):
    node = tree(spark, {2: None, 0: 2, 1: 2}, {2: 1, 0: 0, 1: 0})
    got = tip_removal.removal_scores(node, spark.createDataFrame([(1, 0, 0, 1), (1, 1, 0, 8)], TIPS)).collect()
    assert sorted((r.node, r.score, r.without) for r in got) == [(0, 1, 0), (1, 1, 0)]


def test_sizes_of_chains_without_a_tip(spark):
    rng = random.Random(4)
    rows = [(1, t, k, float(rng.gauss(9, 1)), 5.0 if t == 7 else float(rng.gauss(5, 1))) for t in (3, 7) for k in range(200)]
    got = {r.tip: r for r in tip_removal.tip_removal_ess(spark.createDataFrame(rows, "run long, tip long, sample long, whole double, without double")).collect()}
    assert got[7].removed_ess is None and got[7].ess_change is None and got[7].full_ess > 50 and got[7].removed_mean == 5
    assert got[3].ess_change == pytest.approx(got[3].removed_ess - got[3].full_ess, abs=1e-5) and got[3].samples == 200


def leaf_first(spark):
    """((0:1,1:1)3:1,2:2)4, leaves first, the root last."""
    return tree(spark, {4: None, 3: 4, 2: 4, 0: 3, 1: 3}, {4: 2, 3: 1, 2: 0, 0: 0, 1: 0})


def test_operators_on_leaf_first_trees(spark):
    node = leaf_first(spark)
    closure = trees.ancestor_closure(node)
    assert [(r.node, r.size, r.clade) for r in trees.clades(node=node, closure=closure).collect()] == [(3, 2, "0,1")]
    assert trees.unrooted_splits(node=node, closure=closure).count() == 0
    five = tree(spark, {8: None, 7: 8, 6: 8, 5: 7, 0: 5, 1: 5, 2: 7, 3: 6, 4: 6}, {8: 3, 7: 2, 6: 1, 5: 1, 0: 0, 1: 0, 2: 0, 3: 0, 4: 0})
    got = {(r.split, r.size) for r in trees.unrooted_splits(node=five, closure=trees.ancestor_closure(five)).collect()}
    assert got == {("2,3,4", 3), ("3,4", 2)}
    assert trees.rf_distance(node=five, closure=trees.ancestor_closure(five)).first().distance == 6
    sets = parsimony.fitch_sets(node, spark.createDataFrame([(1, 0, 0, 1), (1, 1, 0, 2), (1, 2, 0, 2)], TIPS))
    assert [r.score for r in parsimony.fitch_scores(fitch=sets, node=node).collect()] == [1]
    mut = spark.createDataFrame([(1, 4, 2.0, 0, 0, 1), (1, 0, 0.5, 1, 0, 1), (1, 1, 0.5, 1, 0, 2), (1, 3, 1.5, 2, 0, 1)], "tree_id long, node long, time double, site long, old_state long, new_state long")
    assert trees and history.mutation_count(node=node, mut=mut).first()[1:] == (3, 2)
    reference = spark.createDataFrame([(0, 0), (1, 0), (2, 0)], "site long, state long")
    pairs = {(r.x, r.y): (r.compared, r.differing) for r in history.differing_sites(carried=carries.states(node, mut), reference=reference, node=node).collect()}
    assert pairs == {(0, 1): (3, 1), (2, 3): (2, 1)}
    masks = spark.createDataFrame([(1, 0, 0, 15), (1, 1, 0, 15), (1, 2, 0, 15), (1, 0, 1, 15), (1, 1, 1, 1), (1, 2, 1, 15)], TIPS)
    regions = {(r.tip, r.clade, r.sites) for r in history.missing_clade_regions(tip_state=masks, closure=closure, node=node).collect()}
    assert regions == {(0, 3, "0"), (1, 3, "0"), (0, 0, "1"), (2, 2, "0,1")}
    assert {r.node for r in trees.subtree_choice(node=node).collect()} == {0, 1}
    stats = trees.subtree_stats(node=node, closure=closure, mut=mut)
    assert {(r.node, r.of_root) for r in trees.node_ratios(node=node, stats=stats).collect()} == {(3, 0.5)}


def test_sweeps_reach_every_level(spark):
    """A chain of 30 nodes: sums from below and paths from above."""
    parents = {i: (i - 1 if i else None) for i in range(30)}
    node = tree(spark, parents, {i: 30 - i for i in range(30)})
    own = spark.createDataFrame([(1, 29, 1)], "tree_id long, node long, n long")
    got = sweeps.upward(node, own, lambda rows: rows.groupBy("tree_id", rows["parent"].alias("node")).agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").selectExpr("tree_id", "node", "n + 1 AS n"))
    assert {r.node: r.n for r in got.collect()} == {i: 30 - i for i in range(30)}
