"""Refresh of clades against their presence by tree, draws from tilted densities against their integrals, and small goldens."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dendrolake.operators import configurations, records, refresh, sequences, tilted, trees
from dendrolake.sources import readers

from .test_hazards_ratios import NODE, shape

STEMS, SAMPLES = "run string, i long, clade string, stem double", "run string, i long, state long"


def test_refresh_is_that_of_presence(spark):
    rng, n = random.Random(2), 30
    has = {(run, c): [rng.random() < p for _ in range(n)] for run in ("a", "b") for c, p in (("x", 0.5), ("y", 0.9), ("z", 0.02), ("all", 1.0))}
    has["a", "rim"] = [i in (0, n - 1) for i in range(n)]
    stem = {(run, c, i): rng.random() for (run, c), p in has.items() for i in range(n) if p[i]}
    stems = spark.createDataFrame([(run, i, c, s) for (run, c, i), s in stem.items()], STEMS)
    samples = spark.createDataFrame([(run, i, 7000 + 500 * i) for run in ("a", "b", "empty") for i in range(n)] + [("single", 0, 9)], SAMPLES)
    pace, clock = spark.createDataFrame([("a", 30.0)], "run string, seconds double"), spark.createDataFrame([("a", 4.0), ("b", 5.0)], "run string, per_time double")
    got = {(r.run, r.clade): r for r in refresh.clade_refreshes(stems=stems, samples=samples, pace=pace, clock=clock).collect()}
    want = {}
    for (run, c), p in has.items():
        support = sum(p) / n
        if 0.05 < support < 0.95:
            flips = sum(x != y for x, y in zip(p, p[1:]))
            refreshed, held = flips / (2 * support * (1 - support)), [stem[run, c, i] for i in range(n) if p[i]]
            minutes = n * 500 * 30.0 / 1e6 / 60
            want[run, c] = (flips, support, refreshed / minutes if run == "a" else None, refreshed * 1e6 / (n * 500), sum(held) / len(held) * (4.0 if run == "a" else 5.0))
    assert set(got) == set(want) and ("a", "rim") in want
    for k, (flips, support, minute, million, load) in want.items():
        r = got[k]
        assert (r.flips, r.support, r.per_million, r.load) == (flips, pytest.approx(support, abs=1e-5), pytest.approx(million, abs=1e-4), pytest.approx(load, abs=1e-5))
        assert r.per_minute == (None if minute is None else pytest.approx(minute, abs=1e-4))


def test_bins_of_loads(spark):
    rows = [("a", 0.5, 1.0, 10.0), ("a", 0.51, 2.0, 20.0), ("a", 1.5, 4.0, 40.0), ("a", 6.1, 8.0, None), ("a", None, 9.0, 9.0), ("b", 3.0, 1.0, 1.0)]
    refreshes = spark.createDataFrame(rows, "run string, load double, per_minute double, per_million double")
    bins = refresh.refresh_bins(refreshes=refreshes)
    assert {(r.run, r.bin): (r.clades, r.per_minute, r.per_million) for r in bins.collect()} == {
        ("a", 1): (1, 1.0, 10.0), ("a", 2): (2, 3.0, 30.0), ("a", 3): (0, None, None), ("a", 4): (0, None, None), ("a", 5): (1, 8.0, None),
        ("b", 1): (0, None, None), ("b", 2): (0, None, None), ("b", 3): (1, 1.0, 1.0), ("b", 4): (0, None, None), ("b", 5): (0, None, None),
    }
    runs = spark.createDataFrame([("a", "e", "m1"), ("b", "e", "m2")], "run string, experiment string, method string")
    wide = refresh.refresh_report(bins, runs).orderBy("bin").collect()
    assert [(r.m1_clades, r.m2_clades) for r in wide] == [(1, 0), (2, 0), (0, 1), (0, 0), (1, 0)]
    assert {r.run: (r.clades, r.share) for r in refresh.loaded_share(refreshes=refreshes).collect()} == {"a": (5, 0.2), "b": (1, 1.0)}
    assert refresh.refresh_bins(refreshes=refreshes.limit(0)).count() == 0


def test_refresh_of_a_log(spark, tmp_path):
    newick = ["((A:1,B:1):0.5,(C:1,D:1):0.25);", "((A:1,C:1):0.5,(B:1,D:1):0.25);"]
    lines = [f"tree STATE_{1000 * i} = {newick[i % 4 == 3]}" for i in range(20)]
    (tmp_path / "e_m-1.trees").write_text("#NEXUS\nbegin trees;\n" + "\n".join(lines) + "\ntree STATE_20000 = ((A:1,B")
    stems, samples = refresh.log_stems(spark, str(tmp_path), 0.1)
    assert samples.count() == 18 and samples.agg(F.min("state"), F.max("i")).first()[:] == (2000, 17)
    run = "e_m-1.trees"
    trace = spark.createDataFrame([(i, 99.0 if i < 2 else 0.5) for i in range(20)], "Sample long, clockRate double")
    assert refresh.mean_clock(trace, "clockRate", 10) == pytest.approx(5.0)
    got = {r.clade: r for r in refresh.clade_refreshes(stems=stems, samples=samples, pace=spark.createDataFrame([(run, 60.0)], "run string, seconds double"), clock=spark.createDataFrame([(run, 5.0)], "run string, per_time double")).collect()}
    # trees 3, 7, 11, 15 and 19 differ; the last one ends the log, so it flips once
    assert {k: (r.held, r.flips, r.load) for k, r in got.items()} == {"A,B": (13, 9, 2.5), "C,D": (13, 9, 1.25), "A,C": (5, 9, 2.5), "B,D": (5, 9, 1.25)}


def quantiles_agree(draws, log_density, lower, upper):
    x = np.linspace(lower, upper, 20001)
    p = np.array([log_density(v) for v in x])
    w = np.exp(p - p.max())
    cdf = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
    cdf /= cdf[-1]
    for q in (0.1, 0.5, 0.9):
        assert np.mean(draws <= np.interp(q, cdf, x)) == pytest.approx(q, abs=0.035)


@pytest.mark.parametrize("a, b, lower, upper", [(0.0, 0.5, -1.0, 2.0), (8.0, 0.5, 0.0, 3.0), (-8.0, 1.0, 0.0, 3.0), (0.0, 1e-6, 1.0, 1.001), (-40.0, 2.0, 0.0, 30.0), (600.0, 0.5, 0.0, 50.0)])
def test_gaussian_in_an_interval(spark, a, b, lower, upper):
    rows = spark.range(2500).selectExpr("id", f"{a}D AS a", f"{b!r}D AS b", f"{lower}D AS lower", f"{upper}D AS upper")
    drawn = {r.id: r.x for r in tilted.sample_gaussian(rows, ["id"]).collect()}
    x = np.array(list(drawn.values()))
    assert len(x) == 2500 and (x >= lower).all() and (x <= upper).all()
    quantiles_agree(x, lambda v: -a * v - b * v * v, *((lower, upper) if a < 600 else (0.0, 0.05)))
    assert {r.id: r.x for r in tilted.sample_gaussian(rows.repartition(7), ["id"]).collect()} == drawn


@pytest.mark.parametrize("decay, lower, upper", [(1.0, 0.2, 3.0), (-2.0, 0.0, 9.0), (4.0, -1.0, 0.5), (0.0, 1.0, 2.0)])
def test_draws_by_a_slope(spark, decay, lower, upper):
    slopes = ((0.0, 3.0), (1.0, -6.0), (2.0, 8.0), (4.0, -2.0))
    rows = spark.range(2500).selectExpr("id", f"{decay}D AS decay", f"{lower}D AS lower", f"{upper}D AS upper")
    drawn = {r.id: r.x for r in tilted.sample_sloped(rows, ["id"], slopes).collect()}
    grid = np.linspace(lower, upper, 20001)
    s = np.interp(grid, *zip(*slopes)) - decay
    level = np.concatenate([[0], np.cumsum((s[1:] + s[:-1]) / 2 * np.diff(grid))])
    quantiles_agree(np.array(list(drawn.values())), lambda v: float(np.interp(v, grid, level)), lower, upper)
    assert {r.id: r.x for r in tilted.sample_sloped(rows.repartition(3), ["id"], slopes).collect()} == drawn
    assert tilted.sloped_between(1.0, 2.0, 2.0, None, 1) == 2.0


def test_ids_aliases_traits_and_dates(spark):
    taxon = spark.createDataFrame([(1, " A.1 x| 2020 |E", "2020-01"), (2, "B", "2020-02-03"), (3, "C|z", "2021")], "doc_id long, header string, raw_date string")
    assert [r.id for r in records.field_ids(taxon=taxon).orderBy("doc_id").collect()] == ["A.1", "B", "C"]
    assert [r.id for r in records.field_ids.given(field=1)(taxon=taxon).orderBy("doc_id").collect()] == ["2020", None, "z"]
    lists = {r.dataset: (r.dates, r.types, r.n) for r in records.trait_lists(taxon=taxon).collect()}
    assert lists["2020"] == (" A.1 x| 2020 |E=2020-01,\nB=2020-02-03", " A.1 x| 2020 |E=NOT_SET,B=NOT_SET", 2)
    named = [("E/S1/2020", "UK", "2020-01-01", 1), ("W/S1/2020", "UK", "2020-02-02", 2), ("E/S1/2020", "UK", "", 3), ("E/S1/2020", "FR", "2020-03-03", 4), ("none", "UK", "2020-01-01", 5), ("E/S2/2020", "UK", None, 6)]
    assert [tuple(r) for r in records.wanted_aliases(named=spark.createDataFrame(named, "name string, country string, date string, line_no long")).collect()] == [("COG-UK/S1", "W/S1/2020", "2020-02-02", 2)]
    day = datetime.date
    bounds = spark.createDataFrame([(1, p, None if p % 3 == 0 else day(2020, 1, 1), day(2020, 1, 31) if p % 2 else day(2020, 1, 1)) for p in range(400)] + [(2, 1, day(2020, 1, 1), day(2020, 1, 31))], "dataset long, position long, first date, last date")
    drawn = {(r.dataset, r.position): (r.k, r.date, r.imputed) for r in records.imputed_in_order(bounds=bounds).collect()}
    assert len(drawn) == 267 and all(d == "2020-01-01" and not i for (s, p), (_, d, i) in drawn.items() if p % 2 == 0)
    assert len({d for _, d, i in drawn.values() if i}) > 25 and max(d for _, d, _ in drawn.values()) <= "2020-01-31"
    # a draw belongs to a place in the list, whatever lies there
    moved = records.imputed_in_order(bounds=bounds.where("first IS NOT NULL").withColumn("last", F.lit(day(2020, 1, 31))).withColumn("position", F.col("position") * 2)).collect()
    assert {r.k: r.date for r in moved if r.dataset == 1 and drawn[1, r.position // 2][2]} == {k: d for (s, _), (k, d, i) in drawn.items() if s == 1 and i}


def test_weights_patterns_lengths_and_settings(spark):
    masked = spark.createDataFrame([(1, t, s, m) for s, col in enumerate([(1, 1, 15), (1, 2, 4), (1, 1, 15), (8, 8, 8)]) for t, m in enumerate(col)], "dataset long, taxon long, site long, mask int")
    scores = spark.createDataFrame([(1, 1, 2), (1, 2, 1)], "dataset long, site long, score long")

    def weights(**given):
        return [(r.weight, r.cumulative, r.chance) for r in sequences.selection_weights.given(**given)(masked=masked, scores=scores).orderBy("site").collect()]

    assert weights(kind="uniform") == [(1, 1, 0.25), (1, 2, 0.25), (1, 3, 0.25), (1, 4, 0.25)]
    assert weights(kind="parsimony", pseudo=0.5) == [(0.5, 0.5, 0.1), (2.5, 3.0, 0.5), (1.5, 4.5, 0.3), (0.5, 5.0, 0.1)]
    assert [w[0] for w in weights(kind="missing", pseudo=0.0, missing=3.0)] == [1.0, 2.0, 2.0, 0.0]
    assert [w[2] for w in weights(kind="parsimony", pseudo=0.0)] == [0.0, 0.666667, 0.333333, 0.0]
    for wrong in ({"kind": "x"}, {"pseudo": -1.0}, {"missing": -0.5}):
        with pytest.raises(ValueError):
            weights(**wrong)
    assert [(r.pattern, r.weight) for r in sequences.pattern_of_site(masked=masked).orderBy("site").collect()] == [(0, 2), (1, 1), (0, 2), (2, 1)]
    node = spark.createDataFrame(shape(), NODE)
    rated = trees.rated_length(node=node, branch_rate=spark.createDataFrame([(1, 0, 3.0)], "tree_id long, node long, rate double")).first()
    assert rated.branches == 8 and rated.rated - rated.length == pytest.approx(2 * 0.9)
    good = [("a", "windowProbability", 0.0), ("a", "maxSites", 1.0), ("a", "fullExplorationProbability", 0.4), ("a", "sortedExplorationProbability", 0.6), ("a", "other", -5.0)]
    bad = [("b", "windowProbability", 1.0), ("b", "sortingErrorProbability", 0.5), ("b", "maxLevels", -1.0), ("b", "maxSites", 0.0), ("b", "pseudoCount", math.nan), ("b", "missingWeight", None), ("b", "fullExplorationProbability", 0.7), ("b", "sortedExplorationProbability", 0.6)]
    schema = "config string, key string, value double"
    assert configurations.checked_settings(spark.createDataFrame(good, schema)).count() == 5
    broken = configurations.setting_violations(settings=spark.createDataFrame(good + bad, schema)).collect()
    assert {(r.config, r.key) for r in broken} == {("b", k) for _, k, _ in bad[:6]} | {("b", "fullExplorationProbability+sortedExplorationProbability")}
    with pytest.raises(ValueError, match="maxLevels of 'c'"):
        configurations.checked_settings(spark.createDataFrame([("c", "maxLevels", -2.0)], schema))


def test_taxa_by_field_and_valid_dates(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">x|K1.2|z\nac\n>y|K2\ngt\n")
    dates = spark.createDataFrame([("K1", "2020-02"), ("K2", "2020-01/2020-03")], "id string, raw_date string")
    assert {r.header for r in readers.read_taxa(spark, str(tmp_path / "a.fasta"), dates, id_field=1).collect()} == {"K1.2|2020-02", "K2|2020-01/2020-03"}
    with pytest.raises(ValueError, match="no field 2 in header 'y"):
        readers.read_taxa(spark, str(tmp_path / "a.fasta"), dates, id_field=2)
    for date in ("2020-13", "soon", "2020-02-30", "2020/2021/2022", ""):
        (tmp_path / "b.fasta").write_text(f">x|2020\nac\n>y|{date}\ngt\n")
        with pytest.raises(ValueError, match="no valid date"):
            readers.read_taxa(spark, str(tmp_path / "b.fasta"))
    (tmp_path / "c.fasta").write_text(">K1 one\nac\n>K1 two\ngt\n")
    with pytest.raises(ValueError, match="duplicate taxon"):
        readers.read_taxa(spark, str(tmp_path / "c.fasta"), dates)
    (tmp_path / "m.xml").write_text('<data>\n<sequence id="s" taxon="A" totalcount="4" value="ACGT"/>\n<sequence taxon="B"\n value="AA"/><sequence taxon="A" value="TT"/> no end')
    assert {(r.taxon, r.value) for r in readers.read_sequence_values(spark, str(tmp_path / "m.xml")).collect()} == {("A", "TT"), ("B", "AA")}
