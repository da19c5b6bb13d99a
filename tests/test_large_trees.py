"""What large trees need: views of known size, sweeps whose levels are tables, states of many tips."""

import pytest
from pyspark.sql import functions as F

from dendrolake.functions.ctmc import hky
from dendrolake.operators import carries, kernels, neighbours, regions, traces
from dendrolake.plans import registry

from .test_plans import tree

SF = "/root/testdata/sf0.001"
Q, PI = hky((0.1, 0.2, 0.3, 0.4), 2.0).tolist(), (0.1, 0.2, 0.3, 0.4)


def known_size(df):
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


@pytest.mark.parametrize("name", ["node", "mut", "closure", "leaf_first_closure", "tip_state"])
def test_exploded_views_are_tables_of_known_size(spark, name):
    made = registry.domain(spark, SF, name)[name]
    assert made.inputFiles() and not any("customer" in f or "lineitem" in f for f in made.inputFiles())
    if name == "node":
        rows = spark.createDataFrame([(i, i, i) for i in range(20000)], "tree_id long, node long, parent long")
        from dendrolake.plans.lineage import sized

        assert known_size(sized(rows)) >= 20000 * 24


def test_levels_of_a_sweep_are_one_scan(spark):
    t = registry.domain(spark, SF, "node", "mut")
    plan = carries.states(t["node"], t["mut"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Join" not in plan


def test_sums_above_are_those_over_all_ancestors(spark):
    t = registry.domain(spark, SF, "node", "branch_inc", "closure", "above")
    want = t["closure"].where("steps > 0").join(t["branch_inc"].withColumnRenamed("node", "ancestor"), ["tree_id", "ancestor"]).groupBy("tree_id", "node", "site").agg(F.sum("inc").alias("inc"))
    rows = [sorted(map(tuple, x.select("tree_id", "node", "site", "inc").collect())) for x in (t["above"], want)]
    assert rows[0] == rows[1] and rows[0]


def test_states_of_thousands_of_tips_are_drawn(spark):
    n = 3000
    parents = {0: None} | {i: 0 for i in range(1, n + 1)}
    node = tree(spark, parents, {0: 1.0} | {i: 0.0 for i in range(1, n + 1)})
    tips = spark.createDataFrame([(1, i, 0, 1 << (i % 2)) for i in range(1, n + 1)], "tree_id long, node long, site long, mask int")
    got = {r.node: r.state for r in kernels.sample_site_histories(node, tips, Q, PI).collect()}
    assert len(got) == n + 1 and all(got[i] == i % 2 for i in range(1, n + 1))


@pytest.mark.parametrize("name", ["unrooted_splits", "leaf_first_unrooted_splits"])
def test_only_sides_above_the_first_tip_meet_all_tips(spark, name):
    plan, names = registry.QUERIES[name]
    tables = registry.domain(spark, SF, *names.values())
    text = plan(**{t: tables[v] for t, v in names.items()})._jdf.queryExecution().optimizedPlan().toString()
    # no pairs of all sides and all tips, of which most are thrown away afterwards
    assert "LeftOuter" not in text and "LeftAnti" in text


@pytest.mark.parametrize("name", ["below", "stats", "branch_rates"])
def test_rows_of_nodes_from_sweeps_are_as_large_as_they_look(spark, name):
    made = registry.domain(spark, SF, name)[name]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Union" not in plan
    assert known_size(made) >= made.count() * 8 * 3


def test_sizes_by_lags_are_added_up_over_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows, want = [], {}
    for seed, n in enumerate((1, 5, traces.BLOCK, 2 * traces.BLOCK + 700)):
        x = np.cumsum(rng.normal(size=n)) % 7.0 if seed % 2 else rng.normal(size=n)
        rows += [("a", "e", seed, 1000 * i, float(v)) for i, v in enumerate(x)]
        want[seed] = (n, None if n == 1 else round(traces.ess_tracer(x), 6))
    trace = spark.createDataFrame(rows, "method string, experiment string, seed long, sample long, value double")
    got = {r.seed: (r.n, r.tracer) for r in traces.ess_by_blocks(trace).collect()}
    assert got.keys() == want.keys()
    for seed, (n, size) in want.items():
        assert got[seed][0] == n and (got[seed][1] is None if size is None else abs(got[seed][1] - size) < 1e-5 * size)
    short = trace.where("seed < 2")
    assert sorted(map(tuple, traces.ess_by_blocks(short).collect())) == sorted(map(tuple, traces.ess_by_lags(trace=short).collect()))


def test_the_query_by_lags_has_no_pairs_of_a_whole_chain(spark):
    text = registry.queries()["ess_by_lags"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" in text and "< 2000" not in text.split("FlatMapGroupsInPandas")[0]


@pytest.mark.parametrize("most", [1, 2])
def test_only_close_variants_of_classes_meet(spark, most):
    import numpy as np

    rng = np.random.default_rng(5)
    n, sites = 250, 5
    masks = rng.choice([1, 2, 4, 8, 5, 7, 15], size=(n, sites), p=[0.3, 0.2, 0.2, 0.15, 0.07, 0.04, 0.04])
    masked = spark.createDataFrame([(0, i, s, int(masks[i, s])) for i in range(n) for s in range(sites)], "dataset long, taxon long, site long, mask int")
    base = spark.createDataFrame([(0, s, 0) for s in range(sites)], "dataset long, site long, state long")
    filled = np.where(masks == 15, 1, masks)
    first = {}
    for i in range(n):
        first.setdefault(tuple(filled[i]), i)
    ids = sorted(first.values())
    want = {(a, b): d for k, a in enumerate(ids) for b in ids[k + 1:] if (d := int((filled[a] & filled[b] == 0).sum())) <= most}
    got = {(r.a, r.b): r.distance for r in neighbours.close_classes(masked, base, most).collect()}
    assert got == want and want
    members, entries = neighbours.class_entries(masked, base)
    of, own = neighbours.variants(members.select("dataset", "class").distinct(), entries)
    met = {(min(r.a, r.b), max(r.a, r.b)) for r in neighbours.clean_candidates(of, own, most).collect() if r.a != r.b}
    assert met == set(want)


def test_very_ambiguous_classes_take_the_other_way(spark, monkeypatch):
    rows = [(0, 1, s, 7) for s in range(8)] + [(0, 2, s, 2) for s in range(8)] + [(0, 3, s, 8 if s < 3 else 4) for s in range(8)]
    masked = spark.createDataFrame(rows, "dataset long, taxon long, site long, mask int")
    base = spark.createDataFrame([(0, s, 0) for s in range(8)], "dataset long, site long, state long")
    assert [r["class"] for r in neighbours.vague(neighbours.class_entries(masked, base)[1]).collect()] == [1]
    assert {(r.a, r.b, r.distance) for r in neighbours.close_classes(masked, base, 2).collect()} == {(1, 2, 0)}


@pytest.mark.parametrize("name", ["sorted_regions", "explored_regions"])
def test_counts_of_differences_are_as_large_as_they_look(spark, monkeypatch, name):
    made, own = [], regions.differences
    monkeypatch.setattr(regions, "differences", lambda *tables: made.append(own(*tables)) or made[-1])
    registry.queries()[name](spark, SF)
    counts = made[0][1]
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Filter" not in plan  # no longer levels of which a part is taken
    assert known_size(counts) >= counts.count() * 8 * 3


def test_branches_of_histories_meet_states_and_events_by_merging(spark, monkeypatch):
    from dendrolake.operators import branch_histories

    ends = []
    monkeypatch.setattr(branch_histories, "sample_paths", lambda rows, q, seed: ends.append(rows) or rows)
    registry.queries()["branch_paths"](spark, SF)
    plan = ends[0]._jdf.queryExecution().optimizedPlan().toString()
    kept = [line for line in plan.splitlines() if "Join LeftAnti" in line or "Join LeftOuter" in line]
    assert len(kept) == 2 and all("rightHint=(strategy=merge)" in line for line in kept)


@pytest.mark.parametrize("name, joins", [("violations", 1), ("differing_sites", 4), ("leaf_first_differing_sites", 4)])
def test_states_of_all_nodes_are_met_by_merging(spark, name, joins):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rightHint=(strategy=merge)") >= joins


def test_sums_above_events_are_met_by_merging(spark, monkeypatch):
    made, own = [], registry.cut
    monkeypatch.setattr(registry, "cut", lambda df: made.append(df._jdf.queryExecution().optimizedPlan().toString()) or own(df))
    t = registry.domain(spark, SF, "tips", "mut")
    assert "rightHint=(strategy=merge)" in made[-1]
    assert t["tips"].inputFiles() and not any("customer" in f for f in t["tips"].inputFiles())  # as small as it looks


def test_states_of_tips_are_never_sent_to_every_executor(spark):
    """Packed tips look small: 14.4 million rows are a file of 7 MB."""
    plan = registry.queries()["end_states"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert [line for line in plan.splitlines() if "Join " in line and "leftHint=(strategy=merge)" in line]


@pytest.mark.parametrize("name, joins", [
    ("dwell_times", 1), ("jc_branch_density", 1), ("map_times", 1), ("unconstrained_nodes", 1), ("missing_clade_regions", 2), ("leaf_first_missing_clade_regions", 2),
    ("fitch_scores", 1), ("leaf_first_fitch_scores", 1), ("excess_mutations", 2), ("parsimony_events", 1), ("parsimony_history", 2),
])
def test_packed_tables_are_met_by_merging(spark, name, joins):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len([line for line in plan.splitlines() if "Join " in line and "(strategy=merge)" in line]) >= joins


def test_many_tips_are_sized_at_once_and_described_from_a_table(spark, monkeypatch):
    from dendrolake.operators import tip_removal

    rows = [(1, t, k, float((k * 7 + t) % 5), float((k * 3 + t) % 4)) for t in range(9) for k in range(11)]
    sizes = tip_removal.tip_removal_ess(spark.createDataFrame(rows, "run long, tip long, sample long, whole double, without double"))
    text = sizes._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in text and "InPandas" not in text
    want = {t: round(traces.ess_tracer([r[3] for r in rows if r[1] == t]), 6) for t in range(9)}
    assert {r.tip: r.full_ess for r in sizes.collect()} == want
    monkeypatch.setattr(tip_removal, "tip_removal_ess", lambda trace: sizes)
    described = registry.queries()["removal_description"](spark, SF)
    assert "MapInArrow" not in described._jdf.queryExecution().optimizedPlan().toString()
    assert {r.size: r.n for r in described.collect()} == {"full_ess": 9, "removed_ess": 9, "ess_change": 9}
