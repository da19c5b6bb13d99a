"""Known values, and plain versions that share nothing with the plans."""

import random

import pytest

from dendrolake.operators import carries, history, parsimony, records, traces, tree_samples, trees
from dendrolake.sources import readers, writers

from .test_plans import tree

MUT = "tree_id long, node long, time double, site long, old_state long, new_state long"
CODE = {"A": 1, "C": 2, "G": 4, "T": 8, "N": 15, "-": 15}


def small_tree(spark):
    """((A:1,B:1)X:1,C:2)R with R 1, X 2, C 3, A 4, B 5."""
    return tree(spark, {1: None, 2: 1, 3: 1, 4: 2, 5: 2}, {1: 2, 2: 1, 3: 0, 4: 0, 5: 0})


@pytest.mark.parametrize("sequences, events, want", [
    (("AA", "AA", "AG"), [(4, 0.6, 0, 0, 1), (4, 0.3, 0, 1, 0), (3, 0.5, 1, 0, 2)], {(0, "conflict", 2, "4(1,0.0),4(1,0.0)", "A>C:1,C>A:1")}),
    (("AA", "AA", "AG"), [(3, 0.5, 1, 0, 2)], set()),
    (("AA", "NA", "AA"), [(5, 0.5, 0, 0, 1), (4, 0.6, 1, 0, 1), (4, 0.3, 1, 1, 0)], {(1, "conflict", 2, "4(1,0.0),4(1,0.0)", "A>C:1,C>A:1"), (0, "missing", 1, "5(1,0.0)", "A>C:1")}),
    (("-A", "NA", "AA"), [(2, 1.5, 0, 0, 2)], {(0, "missing", 1, "2(2,1.0)", "A>G:1")}),
    (("AA", "AA", "AG"), [(1, 2.0, 0, 1, 0), (3, 0.5, 1, 0, 2)], set()),
])
def test_excess_mutations(spark, sequences, events, want):
    node = small_tree(spark)
    tips = spark.createDataFrame([(1, n, s, CODE[c]) for n, seq in zip((4, 5, 3), sequences) for s, c in enumerate(seq)], "tree_id long, node long, site long, mask int")
    closure = trees.ancestor_closure(node)
    got = parsimony.excess_mutations(
        fitch=parsimony.fitch_sets(node, tips), mut=spark.createDataFrame([(1, *e) for e in events], MUT), node=node, closure=closure, unconstrained=history.unconstrained_nodes(tip_state=tips, closure=closure)
    )
    assert {(r.site, r.kind, r.excess, r.branches, r.changes) for r in got.collect()} == want


def test_sites_by_score(spark):
    scores = spark.createDataFrame([(1, s, x) for s, x in enumerate([0, 1, 2, 3, 1, 1, 1, 1])], "tree_id long, site long, score long")
    assert {r.site for r in parsimony.select_sites(scores, 2).collect()} == {2, 3}
    assert {r.site for r in parsimony.select_sites(scores, 2, high=False).collect()} == {0, 1, 4, 5, 6, 7}
    with pytest.raises(ValueError):
        parsimony.select_sites(scores, 4)


def test_lines_whose_sample_exceeds_the_next_go(spark):
    rows = [("m", "e", 1, i, s, 0.0) for i, s in enumerate([0, 10, 20, 30, 20, 30, 40])]
    trace = spark.createDataFrame(rows, "method string, experiment string, seed long, line_no long, sample long, value double")
    assert [r.line_no for r in traces.cleaned_trace(trace=trace).orderBy("line_no").collect()] == [0, 1, 2, 4, 5, 6]


def random_tree(spark, n, seed):
    rng = random.Random(seed)
    parents, heights = {1: None}, {1: 100.0}
    for i in range(2, 2 * n, 2):
        tips = [x for x in parents if x not in set(parents.values())]
        at = rng.choice(tips)
        for c in (i, i + 1):
            parents[c], heights[c] = at, heights[at] * rng.uniform(0.2, 0.9)
    return parents, heights, tree(spark, parents, heights)


def test_scaled_intervals_build_on_what_is_scaled_below(spark):
    parents, heights, node = random_tree(spark, 12, 3)
    children = {n: [c for c, p in parents.items() if p == n] for n in parents}

    def scaled(n):
        if not children[n]:
            return heights[n]
        return max(map(scaled, children[n])) + 2.5 * (heights[n] - max(heights[c] for c in children[n]))

    got = trees.interval_scaled.given(factor=2.5)(node=node, closure=trees.ancestor_closure(node)).collect()
    assert {r.node: pytest.approx(r.scaled) for r in got} == {n: scaled(n) for n in parents if children[n]}


def test_decay_rate_and_region_weights(spark):
    import math

    node = small_tree(spark)
    rates = spark.createDataFrame([(1, n, float(n)) for n in range(1, 6)], "tree_id long, node long, rate double")
    totals = spark.createDataFrame([(1, n, 0.5) for n in range(1, 6)], "tree_id long, node long, total_rate double")
    assert [(r.node, r.decay) for r in trees.decay_rate(node=node, branch_rate=rates, node_rate=totals).collect()] == [(2, 0.5 * (4 + 5 - 2))]
    regions = spark.createDataFrame([(1, 2, 2.0, 1.0, 3), (1, 3, 1.5, 0.0, 1), (1, 4, 0.9, 0.0, 2)], "tree_id long, node long, upper double, lower double, differences long")
    row = history.region_weights.given(height=1.0, total_rate=0.7, sites=10, annealing=0.8)(regions=regions).first()

    def weight(lower, upper, n):
        x = (lower + upper) / 2 - 1.0
        return math.log(upper - lower) + 0.8 * (-0.7 * x + n * math.log(0.7 * x / 30))

    w = [weight(1.0, 2.0, 3), weight(1.0, 1.5, 1)]
    assert row.regions == 2 and row.log_total == pytest.approx(math.log(sum(map(math.exp, w))), abs=1e-5)


def test_rank_split_of_constant_and_odd_chains():
    import numpy as np

    assert traces.ess_rank_split([3.0] * 9) == 8.0
    x = np.random.default_rng(4).normal(size=41)
    z = traces.rank_normal(x)[:40].reshape(2, 20)
    total = z.var(1, ddof=1).mean() * 19 / 20 + z.mean(1).var(ddof=1)
    rho = [1.0] + [1 - ((z[:, k:] - z[:, :-k]) ** 2).mean() / (2 * total) for k in range(1, 20)]
    assert traces.ess_rank_split(x) == pytest.approx(traces.ess_monotone(rho, 40))


def test_violations_see_the_root_and_unknown_branches(spark):
    node = small_tree(spark)
    mut = spark.createDataFrame([(1, 1, 2.0, 0, 0, 1), (1, 1, 2.0, 1, 2, 1), (1, 9, 0.5, 0, 1, 1)], MUT)
    ref = spark.createDataFrame([(0, 0), (1, 0)], "site long, state long")
    got = history.violations(node=node, mut=mut, reference=ref, carried=carries.states(node, mut)).collect()
    assert {(r.rule, r.node, r.site) for r in got} == {("K9", 1, 1), ("K2", 9, 0), ("K9", 9, 0)}


def test_convergence_on_real_sizes(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    fast, slow = rng.normal(size=1500), np.zeros(1500)
    for i in range(1, 1500):
        slow[i] = 0.95 * slow[i - 1] + rng.normal()
    rows = [(m, "e", 1, i, 10 * i, float(v)) for m, x in (("fast", fast), ("slow", slow)) for i, v in enumerate(x)]
    trace = spark.createDataFrame(rows, "method string, experiment string, seed long, line_no long, sample long, value double")
    trajectory = traces.ess_trajectory(trace, points=30)
    last = {r.method: r.ess for r in trajectory.where("upto = 1500").collect()}
    assert last["fast"] == pytest.approx(traces.ess_tracer(fast[150:]), abs=1e-5) and last["slow"] < 150
    cost = spark.createDataFrame([("fast", 6e6), ("slow", 6e6)], "method string, us double")
    at = {r.method: r for r in traces.converged_at(trajectory=trajectory, cost=cost).collect()}
    assert not at["fast"].projected and at["fast"].minutes < 500
    assert at["slow"].projected and at["slow"].minutes == pytest.approx(14990 * 6e6 / 6e7 * 200 / last["slow"], rel=1e-4)


def test_parsimonious_states_and_events(spark):
    rng = random.Random(8)
    parents, heights, node = random_tree(spark, 10, 5)
    leaves = [n for n in parents if n not in set(parents.values())]
    masks = {(n, s): rng.choice([1, 2, 4, 8, 5, 15]) for n in leaves for s in range(6)}
    tips = spark.createDataFrame([(1, n, s, m) for (n, s), m in masks.items()], "tree_id long, node long, site long, mask int")
    ref = spark.createDataFrame([(s, s % 4) for s in range(6)], "site long, state long")
    sets = parsimony.fitch_sets(node, tips)
    states = parsimony.fitch_states(node, sets, ref)
    got = {(r.node, r.site): r.state for r in states.collect()}
    scores = {r.site: r.score for r in sets.where("node = 1").collect()}
    for s in range(6):
        changes = sum(got[n, s] != got[p, s] for n, p in parents.items() if p)
        assert changes == scores[s] and all(masks[n, s] >> got[n, s] & 1 for n in leaves)
    events = parsimony.parsimony_events(node, states).collect()
    assert {(r.node, r.site) for r in events} == {(n, s) for (n, s), x in got.items() if x != (got[parents[n], s] if parents[n] else s % 4)}
    assert all(heights[r.node] <= r.time <= heights[parents[r.node] or r.node] for r in events)


def test_distance_of_two_given_trees(spark):
    schema = "tree_id long, clade string"
    one, other = spark.createDataFrame([(1, "0,1"), (1, "0,1,2")], schema), spark.createDataFrame([(1, "1,2"), (1, "0,1,2")], schema)
    tips = spark.createDataFrame([(1, t) for t in range(4)], "tree_id long, tip long")
    row = trees.robinson_foulds(one, other, tips, tips).first()
    assert (row.distance, row.shared) == (2, 1)
    with pytest.raises(ValueError, match="tip 3"):
        trees.robinson_foulds(one, other, tips, tips.where("tip < 3"))


def test_sizes_of_tree_samples(spark):
    import numpy as np

    rng = random.Random(5)
    samples = {"a": [sorted({f"c{rng.randrange(5)}" for _ in range(4)}) for _ in range(40)], "same": [["c1", "c2"]] * 9, "few": [["c1"], ["c2"], ["c1"]]}
    rows = [(run, i, c) for run, trees_ in samples.items() for i, t in enumerate(trees_) for c in t]
    got = {r.run: r for r in tree_samples.tree_ess(spark.createDataFrame(rows, "run string, i long, clade string")).collect()}
    t = [set(x) for x in samples["a"]]
    n = len(t)
    square = np.array([[len(x ^ y) ** 2 for y in t] for x in t], float)

    def rho(k):
        m = n - k
        v, w = square[:m, :m].sum() / 2 / (m * (m - 1)), square[k:, k:].sum() / 2 / (m * (m - 1))
        return (v + w - np.mean([square[i, i + k] for i in range(m)])) / (2 * np.sqrt(v * w))

    assert got["a"].frechet == pytest.approx(traces.ess_monotone([1.0, *(rho(k) for k in range(1, n - 5))], n), abs=1e-5)
    sizes = [traces.ess_rank_split(np.sqrt(square[i])) for i in range(n)]
    assert (got["a"].least, got["a"].median, got["a"].most) == pytest.approx((min(sizes), np.median(sizes), max(sizes)), abs=1e-5)
    assert got["same"].frechet == 1 and got["same"].median == 8 and got["few"].frechet is None and got["few"].median is None


def test_clades_come_and_go(spark):
    has = {"x": [1, 1, 0, 0, 1, 0], "y": [0, 1, 1, 1, 1, 1], "z": [1] * 6}
    rows = [("r", i, c) for c, p in has.items() for i, v in enumerate(p) if v]
    clades = spark.createDataFrame(rows, "run string, i long, clade string")
    got = {r.clade: (r.support, r.flips) for r in tree_samples.clade_flips(clades=clades).collect()}
    assert got == {"x": (0.5, 3), "y": (pytest.approx(5 / 6, abs=1e-6), 1)}
    assert tree_samples.topology_changes(clades=clades, trees=clades.select("run", "i").distinct()).first().changes == 4


def test_intervals_of_a_tree(spark):
    node = tree(spark, {1: None, 2: 1, 3: 1, 4: 2, 5: 2}, {1: 3, 2: 2, 3: 0.5, 4: 0, 5: 0})
    got = [(r.length, r.lineages, r.ends) for r in tree_samples.merged_intervals(node).orderBy("nth").collect()]
    assert got == [(0.5, 2, "sample"), (1.5, 3, "coalescence"), (1.0, 2, "coalescence")]
    got = [(r.length, r.lineages, r.ends) for r in tree_samples.merged_intervals(node, 1.0).orderBy("nth").collect()]
    assert got == [(2.0, 3, "coalescence")]


def test_saved_states_blocks_and_workbooks(spark, tmp_path):
    import zipfile

    (tmp_path / "s.xml").write_text("<state>\n<statenode id='Tree'>((0:1,2:1)4:0.5,1:2)5</statenode>\n<statenode id='kappa'>kappa: 2.5</statenode>\n<statenode id='freq'>freq[4 1]: 0.2 0.8</statenode>\n</state>")
    (tmp_path / "d.xml").write_text('<model>\n<data>\n<sequence taxon="A" value="ac"/>\n<sequence taxon="B" value="gg"/>\n<sequence taxon="C" value="tt"/>\n</data>\n<data>\n<sequence taxon="D" value="aa"/>\n</data></model>')
    assert readers.read_state_tree(spark, str(tmp_path / "s.xml"), "Tree", str(tmp_path / "d.xml")) == "((A:1,C:1):0.5,B:2);"
    assert {(r.id, r.value) for r in readers.read_state_values(spark, str(tmp_path / "s.xml")).collect()} == {("kappa", "2.5")}
    assert [r.sequence for r in readers.read_first_data_block(spark, str(tmp_path / "d.xml")).orderBy("line_no").collect()] == ["AC", "GG", "TT"]
    head = "<worksheet xmlns='http://schemas.openxmlformats.org/spreadsheetml/2006/main'><sheetData>"
    with zipfile.ZipFile(tmp_path / "m.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", "<sst xmlns='http://schemas.openxmlformats.org/spreadsheetml/2006/main'><si><t>id</t></si><si><r><t>da</t></r><r><t>te</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", head + "<row r='1'><c r='A1' t='s'><v>0</v></c><c r='C1' t='s'><v>1</v></c></row><row r='2'><c r='A2' t='inlineStr'><is><t>x</t></is></c><c r='B2'><v>4.5</v></c></row></sheetData></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", head + "<row r='1'><c r='A1'><v>9</v></c></row></sheetData></worksheet>")
    assert [(r.row, r.cells) for r in readers.read_excel(spark, str(tmp_path / "m.xlsx")).orderBy("row").collect()] == [(1, ["id", "", "date"]), (2, ["x", "4.5"])]


def test_job_starts_and_timings(spark, tmp_path):
    import os

    log = tmp_path / "a.log"
    log.write_text("# x\n# Started job at 2024-03-01 10:00:00\nSample\tv\n0\t1\n2000\t2\n# Started job at 2024-03-02 10:00:00\n")
    os.utime(log, (1709287200 + 500, 1709287200 + 500))  # 2024-03-01 10:00:00 UTC and 500 s
    starts = readers.job_starts(spark, str(log))
    got = readers.seconds_per_sample(spark, str(log), spark.createDataFrame([(starts.first().path, 2000)], "path string, last long")).first()
    assert got.seconds == pytest.approx(0.25)
    writers.write_timing({"total": 5, "seed": 1}, spark.createDataFrame([("a", 3), ("b", None)], "operator string, n long"), str(tmp_path / "t.csv"))
    totals, rows = readers.read_timing(spark, str(tmp_path / "t.csv"))
    assert {(r.key, r.value) for r in totals.collect()} == {("total", "5"), ("seed", "1")} and [(r.operator, r.n) for r in rows.orderBy("operator").collect()] == [("a", 3), ("b", None)]
    with pytest.raises(ValueError):
        writers.as_table(spark.range(10_001))


def test_a_draw_of_records_is_a_prefix_of_the_order(spark):
    taxon = spark.createDataFrame([(i, f"h{i}", "ACGT" * 5 + "N" * (i % 3), "2020") for i in range(200)], "doc_id long, header string, seq string, raw_date string")
    full = {r.doc_id: r.nth for r in records.sample_until(taxon=taxon).collect()}
    assert sorted(full.values()) == list(range(1, len(full) + 1)) and len(full) == 134
    few = {r.doc_id: r.nth for r in records.sample_until.given(n=10)(taxon=taxon).collect()}
    assert few == {d: k for d, k in full.items() if k <= 10}
    assert records.ambiguous_filter.given(most=0.2)(taxon=taxon).count() == 200
