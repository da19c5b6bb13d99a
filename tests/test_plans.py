"""Every registered domain query against the same question in a second engine, and known values."""

import math
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from dendrolake.functions import ctmc
from dendrolake.operators import carries, density, parsimony, sequences, traces, trees
from dendrolake.plans import registry

SF = "/root/testdata/sf0.001"
ORACLE = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def tidy(x):
    if isinstance(x, float):
        return "null" if x != x else f"{x + 0.0:.5f}"
    return "null" if x is None else str(x)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_second_engine(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    want = duck.sql(ORACLE[name])
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    cols = [want.columns.index(n) for n in names]
    assert sorted(tuple(tidy(r[n]) for n in names) for r in got.collect()) == sorted(tuple(tidy(r[c]) for c in cols) for r in want.fetchall())


NODE = "tree_id long, node long, parent long, is_leaf boolean, n_tips long, depth long, height double"


def tree(spark, parents, heights):
    depth = {}
    for n in sorted(parents, key=lambda n: -heights[n]):
        depth[n] = 0 if parents[n] is None else depth[parents[n]] + 1
    inner = set(parents.values())
    return spark.createDataFrame([(1, n, p, n not in inner, sum(x not in inner for x in parents), depth[n], float(heights[n])) for n, p in parents.items()], NODE)


def test_density_of_a_small_history(spark):
    """((A:1,B:1):1,(C:0.5,D:0.5):1.5); equal rates, clock one half, two events."""
    node = tree(spark, {1: None, 2: 1, 3: 1, 4: 2, 5: 2, 6: 3, 7: 3}, {1: 2, 2: 1, 3: 0.5, 4: 0, 5: 0, 6: 0, 7: 0})
    mut = spark.createDataFrame([(1, 5, 0.4, 1, 1, 3), (1, 3, 1.2, 0, 0, 2)], "tree_id long, node long, time double, site long, old_state long, new_state long")
    rate = spark.createDataFrame([(i, j, 1 / 3) for i in range(4) for j in range(4) if i != j], "from_state int, to_state int, q double")
    freq = spark.createDataFrame([(i, 0.25) for i in range(4)], "state int, pi double")
    ref = spark.createDataFrame([(0, 0), (1, 1)], "site long, state long")
    got = density.genetic_prior(node=node, below=carries.lengths_below(node), mut=mut, reference=ref, rate=rate, freq=freq).first()
    assert got.log_density == pytest.approx(2 * math.log(0.25) - 0.5 * 2 * 5.5 + 2 * math.log(0.5 / 3), abs=1e-5)


def test_fitch_scores_of_eight_sites(spark):
    node = tree(spark, {1: None, 2: 1, 3: 1, 4: 2, 5: 2, 6: 3, 7: 3}, {1: 2, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0, 7: 0})
    code = {"A": 1, "C": 2, "G": 4, "T": 8}
    tips = [(1, 4 + i, s, code[c]) for i, seq in enumerate(["AAAAAAAC", "AAGCAAAC", "AGAGAGGT", "AGGTGGGT"]) for s, c in enumerate(seq)]
    sets = parsimony.fitch_sets(node, spark.createDataFrame(tips, "tree_id long, node long, site long, mask int"))
    assert [r.score for r in parsimony.fitch_scores(fitch=sets, node=node).orderBy("site").collect()] == [0, 1, 2, 3, 1, 1, 1, 1]


def test_closure_of_a_caterpillar(spark):
    n = 70
    parents = {1: None} | {i: i - 1 for i in range(2, n + 1)}
    got = trees.ancestor_closure(tree(spark, parents, {i: n - i for i in parents}))
    assert got.count() == n * (n + 1) // 2 and got.agg(F.max("steps")).first()[0] == n - 1


def test_missing_columns_and_ranges(spark):
    rows = [(1, t, s, c) for t, seq in enumerate(["AN-?RC", "NN-NNC", "NN--NC"]) for s, c in enumerate(seq)]
    mask = {"A": (1, "nucleotide"), "C": (2, "nucleotide"), "R": (5, "ambiguous")}
    masked = spark.createDataFrame([(*r, *mask.get(r[3], (15, "missing"))) for r in rows], "dataset long, taxon long, site long, ch string, mask int, class string")
    assert {r.site for r in sequences.missing_sites(masked=masked).where("NOT all_missing").collect()} == {0, 4, 5}
    assert sequences.site_ranges(masked=masked).first().ranges == "1,5-6"
    assert sequences.site_ranges(masked=masked.where("site IN (1, 2, 3)")).first().ranges == "2-1"


def test_transition_probabilities():
    q = ctmc.hky((0.1, 0.2, 0.3, 0.4), 2.0)
    p = ctmc.transition(q, 0.7)
    assert p.sum(1) == pytest.approx([1] * 4) and ctmc.transition(q, 0.3) @ ctmc.transition(q, 0.4) == pytest.approx(p)
    assert ctmc.transition(q, 500.0)[0] == pytest.approx([0.1, 0.2, 0.3, 0.4])


def test_effective_sample_sizes():
    import numpy as np

    rng = np.random.default_rng(0)
    white = rng.normal(size=4000)
    assert all(2500 < f(white) < 6000 for f in (traces.ess_tracer, traces.ess_geyer, traces.ess_rank_split))
    slow = np.zeros(4000)
    for i in range(1, 4000):
        slow[i] = 0.9 * slow[i - 1] + white[i]
    assert all(100 < f(slow) < 420 for f in (traces.ess_tracer, traces.ess_geyer, traces.ess_rank_split))
    assert math.isnan(traces.ess_tracer([])) and math.isnan(traces.ess_tracer([1.0] * 9)) and math.isnan(traces.ess_geyer([2.0] * 9))
    assert traces.ess_monotone([1.0, 0.0, 0.0, 0.0], 10) == 10 and traces.ess_monotone([0.5, 0.0], 10) == float("inf")
    with pytest.raises(ValueError):
        traces.ess_monotone([float("nan"), 0.0], 3)


def test_plans_name_what_they_miss(spark):
    with pytest.raises(ValueError, match="masked"):
        sequences.constant_sites()


def test_spline_integral(spark):
    import numpy as np

    heights = [-1.0, 0.0, 0.3, 1.0, 1.7, 2.5, 3.9, 4.0, 6.0]
    node = spark.createDataFrame([(1, i, h) for i, h in enumerate([*heights, None])], "tree_id int, node int, height double")
    rows = {r.height: r for r in trees.spline_integral(node=node).collect()}
    x, y = zip(*trees.SLOPES)
    for h in heights:
        assert rows[h].slope == pytest.approx(np.interp(h, x, y), abs=1e-6)
        grid = np.linspace(0, h, 20_001)
        assert rows[h].integral == pytest.approx(np.trapezoid(np.interp(grid, x, y), grid), abs=1e-5)
    assert rows[None].slope is None and rows[None].integral is None
