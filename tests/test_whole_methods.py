"""Methods in full: every region has its weight, every height its ratio to each mark and anchor."""

import math

import pytest

from dendrolake.operators import carries, history, trees
from dendrolake.plans import registry

from .test_plans import tree

SF = "/root/testdata/sf0.001"


def test_each_region_has_its_weight(spark):
    rows = [(1, 2, 2.0, 1.0, 3), (1, 3, 1.5, 0.0, 1), (1, 4, 0.9, 0.0, 2), (2, 2, 3.0, 1.0, 0)]
    regions = spark.createDataFrame(rows, "tree_id long, node long, upper double, lower double, differences long")
    got = {(r.tree_id, r.node): r for r in history.region_weights.given(height=1.0, total_rate=0.7, sites=10, annealing=0.8)(regions=regions).collect()}

    def weight(lower, upper, n):
        x = (lower + upper) / 2 - 1.0
        return math.log(upper - lower) + 0.8 * (-0.7 * x + n * math.log(0.7 * x / 30))

    want = {(1, 2): weight(1.0, 2.0, 3), (1, 3): weight(1.0, 1.5, 1), (2, 2): weight(1.0, 3.0, 0)}
    assert got.keys() == want.keys()
    top = max(want[1, 2], want[1, 3])
    for key, w in want.items():
        assert got[key].log_weight == pytest.approx(w, abs=1e-6)
        assert got[key].weight == pytest.approx(math.exp(w - (top if key[0] == 1 else w)), abs=1e-6)
    assert (got[1, 3].lower, got[1, 3].upper, got[1, 3].differences, got[1, 3].regions, got[2, 2].regions) == (1.0, 1.5, 1, 2, 1)
    assert got[1, 2].log_total == pytest.approx(math.log(math.exp(want[1, 2]) + math.exp(want[1, 3])), abs=1e-6) and got[2, 2].log_total == pytest.approx(want[2, 2], abs=1e-6)
    regions = registry.domain(spark, SF, "regions")["regions"]
    assert registry.queries()["region_weights"](spark, SF).count() == regions.where("upper > 0").count()


def test_ratios_to_each_mark_and_anchor(spark):
    """Three marks under two anchors; and a node whose parent is as high as its oldest tip."""
    node = tree(spark, {8: None, 7: 8, 6: 7, 0: 6, 1: 6, 2: 7, 3: 8}, {8: 4, 7: 2, 6: 1, 0: 0.25, 1: 0.5, 2: 0, 3: 0})
    rows = [(1, 6, 1.5, 0, 0, 1), (1, 0, 0.5, 0, 1, 2), (1, 0, 0.4, 1, 0, 2), (1, 1, 0.6, 1, 0, 2), (1, 7, 3.0, 2, 0, 2), (1, 8, 9.0, 3, 0, 2)]
    mut = spark.createDataFrame(rows, "tree_id long, node long, time double, site long, old_state long, new_state long")
    stats = carries.subtree_stats(node, mut)
    got = {r.node: r for r in trees.node_ratios(node=node, stats=stats).collect()}
    assert set(got) == {6, 7}
    assert [getattr(got[6], x) for x in ("over_oldest", "over_youngest", "over_zero", "of_root", "youngest_of_root", "zero_of_root")] == [pytest.approx(x, abs=1e-6) for x in (0.5 / 1.5, 0.75 / 1.75, 0.5, 0.5 / 3.5, 0.75 / 3.75, 0.25)]
    flat = tree(spark, {4: None, 3: 4, 0: 3, 1: 3, 2: 4}, {4: 2, 3: 2, 0: 2, 1: 0, 2: 0})
    odd = trees.node_ratios(node=flat, stats=carries.subtree_stats(flat, mut.where("node < 0"))).first()
    assert odd.over_oldest is None and odd.of_root is None and odd.over_zero == 1


def test_events_of_a_subtree_that_moves_are_those_of_its_own_branch_too(spark):
    t = registry.domain(spark, SF, "stats", "mut", "node", "moved_stats")
    own = {(r.tree_id, r.node): r["count"] for r in t["mut"].groupBy("tree_id", "node").count().collect()}
    below = {(r.tree_id, r.node): r.mutations for r in t["stats"].collect()}
    top = {(r.tree_id, r.node) for r in t["node"].where("parent IS NULL").collect()}
    moved = {(r.tree_id, r.node): r.mutations for r in t["moved_stats"].collect()}
    assert moved == {k: n + (0 if k in top else own.get(k, 0)) for k, n in below.items()} and moved != below
    for r in registry.queries()["node_ratios"](spark, SF).collect():
        assert r.mutation_class == min(59, int(math.floor(2 * math.log2(1 + moved[r.tree_id, r.node]) + 1e-9)))
