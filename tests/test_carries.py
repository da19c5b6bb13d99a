"""Sweeps against the table of all ancestors, and the rules of stored event lists."""

import random

import pytest

from dendrolake.operators import carries, history, trees
from dendrolake.plans import registry

from .test_goldens import random_tree
from .test_plans import tree

MUT = "tree_id long, node long, time double, site long, old_state long, new_state long"
RATE = [(i, j, 0.1 * (1 + i + 2 * j)) for i in range(4) for j in range(4) if i != j]
LISTED = "tree_id long, node long, pos long, branch long, time double, prev_time double, site long, old_state long, new_state long"


def rounded(df):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_sweeps_bring_what_the_closure_has(spark):
    rng = random.Random(8)
    parents, heights, node = random_tree(spark, 15, 5)
    rows = [(1, n, rng.uniform(heights[n], heights[parents[n]]) if parents[n] else heights[n], rng.randrange(6), rng.randrange(4), rng.randrange(4)) for n in rng.choices(list(parents), k=60)]
    mut, closure = spark.createDataFrame(rows, MUT), trees.ancestor_closure(node)
    assert rounded(carries.states(node, mut)) == rounded(carries.states_by_closure(closure=closure, mut=mut))
    below = carries.lengths_by_closure(node=node, closure=closure)
    assert rounded(carries.lengths_below(node)) == rounded(below)
    assert rounded(carries.subtree_stats(node, mut)) == rounded(trees.subtree_stats(node=node, closure=closure, mut=mut))
    reference = spark.createDataFrame([(s, s % 4) for s in range(6)], "site long, state long")
    rate = spark.createDataFrame(RATE, "from_state int, to_state int, q double")
    swept = carries.branch_rates(node, mut, reference, rate)
    assert rounded(swept) == rounded(carries.rates_by_closure(node=node, closure=closure, mut=mut, reference=reference, rate=rate))
    last = carries.total_rate_on_branch(branch_rates=swept, mut=mut, rate=rate).collect()
    ends = {r.node: r.rate_at for r in swept.collect()}
    for n in {r.node for r in last}:
        assert min((r for r in last if r.node == n), key=lambda r: (r.time, -r.site)).rate_after == pytest.approx(ends[n], abs=1e-5)


def events(spark, **changes):
    """Lists on the tree ((0,1)3,2)4; changes: by (node, pos), other values of an entry."""
    rows = {
        (4, 1): [4, 9.0, None, 0, 0, 1], (4, 2): [4, 1.0, 9.0, 0, 1, 2], (3, 1): [3, 1.75, None, 0, 2, 3], (3, 2): [3, 1.5, None, 1, 1, 0], (3, 3): [3, 1.25, 1.75, 0, 3, 2],
        (0, 1): [0, 0.5, None, 0, 2, 0], (2, 1): [2, 1.0, None, 1, 1, 2],
    }
    names = ["branch", "time", "prev_time", "site", "old_state", "new_state"]
    for key, change in changes.items():
        for name, value in change.items():
            rows[tuple(map(int, key[1:].split("_")))][names.index(name)] = value
    return spark.createDataFrame([(1, n, pos, *x) for (n, pos), x in rows.items()], LISTED)


@pytest.mark.parametrize("changes, want", [
    ({}, set()),
    ({"e0_1": {"branch": 1}}, {("K1", 0, 1)}),
    ({"e2_1": {"new_state": 1}}, {("K2", 2, 1)}),
    ({"e4_2": {"old_state": 3}}, {("K3", 4, 2)}),
    ({"e4_1": {"old_state": 2}}, {("K3", 4, 1)}),
    ({"e2_1": {"time": 2.5}}, {("K4", 2, 1)}),
    ({"e0_1": {"time": -0.5}}, {("K4", 0, 1)}),
    ({"e3_3": {"prev_time": 2.5}}, {("K5", 3, 3), ("K9t", 3, 3)}),
    ({"e3_3": {"prev_time": 1.1}}, {("K6", 3, 3), ("K9t", 3, 3)}),
    ({"e3_2": {"time": 1.9}}, {("K7", 3, 2)}),
    ({"e3_3": {"prev_time": None}}, {("K8", 3, 3)}),
    ({"e3_2": {"prev_time": 1.75}}, {("K8", 3, 2)}),
    ({"e3_3": {"old_state": 1}}, {("K9", 3, 3)}),
    ({"e3_3": {"prev_time": 1.6}}, {("K9t", 3, 3)}),
])
def test_each_rule_of_event_lists(spark, changes, want):
    node = tree(spark, {4: None, 3: 4, 2: 4, 0: 3, 1: 3}, {4: 2, 3: 1, 2: 0, 0: 0, 1: 0})
    reference = spark.createDataFrame([(0, 0), (1, 1)], "site long, state long")
    got = history.list_violations(node=node, reference=reference, listed=events(spark, **changes)).collect()
    assert {(r.rule, r.node, r.pos) for r in got} == want


def test_sound_histories_break_no_rule(spark):
    from dendrolake.plans import registry

    t = registry.domain(spark, "/root/testdata/sf0.001", "node", "reference", "listed", "mut", "carried")
    assert history.list_violations(**{k: t[k] for k in ("node", "reference", "listed")}).count() == 0
    assert history.violations(**{k: t[k] for k in ("node", "reference", "mut", "carried")}).count() == 0


def test_times_above_the_root_mean_nothing(spark):
    node = tree(spark, {4: None, 3: 4, 2: 4}, {4: 2, 3: 1, 2: 0})
    mut = spark.createDataFrame([(1, 4, 1.0, 0, 0, 1), (1, 2, 0.5, 0, 1, 3)], MUT)
    reference = spark.createDataFrame([(0, 0)], "site long, state long")
    assert history.violations(node=node, reference=reference, mut=mut, carried=carries.states(node, mut)).count() == 0


def test_changes_along_paths_are_those_over_all_ancestors(spark, monkeypatch):
    """In a tree of any numbering, with events above the root, on branches out of the order of time, at many sites, of nodes that aren't there; and without a table of ancestors."""
    rng = random.Random(8)
    parents, _, node = random_tree(spark, 14, 6)
    rows = [(1, rng.choice([*parents, 99]), float(t), rng.choice([-5, 0, 1, 2, 3, 4, 9, 40]), rng.randrange(4), rng.randrange(4)) for t in rng.sample(range(1000), 90)] + [(2, 1, 1.0, 0, 0, 1)]
    mut = spark.createDataFrame(rows, "tree_id long, node long, time double, site long, old_state long, new_state long")
    want = sorted(map(tuple, history.path_changes(mut=mut, closure=trees.ancestor_closure(node)).collect()))
    assert sorted(map(tuple, carries.path_changes(node, mut).collect())) == want and want
    assert carries.path_changes(node, mut.where("site < -5")).count() == 0
    made, seen = registry.Domain.table, []
    monkeypatch.setattr(registry.Domain, "table", lambda self, name: seen.append(name) or made(self, name))
    got = registry.queries()["path_changes"](spark, "/root/testdata/sf0.001")
    assert "closure" not in seen and got.columns == ["tree_id", "node", "site", "start_state", "end_state", "events"]


def test_states_and_sums_in_groups_are_those_of_sweeps_by_joins(spark):
    rng = random.Random(18)
    parents, _, node = random_tree(spark, 14, 6)
    rows = [(1, rng.choice([*parents, 99]), float(t), rng.choice([-5, 0, 1, 2, 3, 4, 9, 40]), rng.randrange(4), rng.randrange(4)) for t in rng.sample(range(1000), 90)] + [(2, 1, 1.0, 0, 0, 1)]
    mut = spark.createDataFrame(rows, "tree_id long, node long, time double, site long, old_state long, new_state long")
    own = mut.groupBy("tree_id", "node", "site").agg({"new_state": "sum"}).withColumnRenamed("sum(new_state)", "inc")
    for got, want in ((carries.states_of_sites(node, mut), carries.states(node, mut)), (carries.sums_of_sites(node, own), carries.sums_above(node, own))):
        assert got.columns == want.columns and dict(got.dtypes) == dict(want.dtypes)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count()


def test_events_and_paths_of_branches_need_no_job_for_each_level(spark, monkeypatch):
    for name in ("states", "sums_above"):
        monkeypatch.setattr(carries, name, None)
    assert registry.queries()["branch_paths"](spark, "/root/testdata/sf0.001").count()
