import pytest
from pyspark.sql import functions as F

from dendrolake.functions import numeric
from dendrolake.operators import kernels
from dendrolake.sources import readers, writers
from dendrolake.streaming import traces as streams


def test_fasta_and_metadata(spark, tmp_path):
    fasta = tmp_path / "a.fasta"
    fasta.write_text("junk\n>A1.2|x\nac gt\n  TT \n>B7|y\n\n>C9|z\nGG")
    got = {r.header: r.sequence for r in readers.read_fasta(spark, str(fasta)).collect()}
    assert got == {"A1.2|x": "AC GTTT", "B7|y": "", "C9|z": "GG"}
    meta = tmp_path / "m.tsv"
    meta.write_text("id\tdate\nA1\t2020-05\nB7\t2021\n")
    m = readers.read_metadata(spark, str(meta), "id", "date")
    taxa = readers.read_taxa(spark, str(fasta), m, skip_unmatched=True)
    assert {r.header for r in taxa.collect()} == {"A1.2|2020-05", "B7|2021"}
    with pytest.raises(ValueError, match="metadata"):
        readers.read_taxa(spark, str(fasta), m)
    with pytest.raises(ValueError, match="column"):
        readers.read_metadata(spark, str(meta), "id", "when")
    (tmp_path / "b.fasta").write_text(">A\nC\n>A\nG\n")
    with pytest.raises(ValueError, match="duplicate"):
        readers.read_fasta(spark, str(tmp_path / "b.fasta"))
    (tmp_path / "c.fasta").write_text(">A\nac\ngt\n>B\n>D\ntt\n")
    assert {(r.header, r.sequence) for r in readers.read_large_fasta(spark, str(tmp_path / "c.fasta")).collect()} == {("A", "ACGT"), ("B", ""), ("D", "TT")}


def test_logs(spark, tmp_path):
    for name in ("first_zika-1.log", "mut_clade_zika-2.log", "other.log"):
        (tmp_path / name).write_text("# comment\nstate\tPosterior\tempty\n0\t-3.5\t\n1000\tx\t\n2000\t-1.25\t\n")
    found = readers.discover_logs(spark, str(tmp_path), exclude=["first"])
    assert [(r.method, r.experiment, r.seed) for r in found.collect()] == [("mut_clade", "zika", 2)]
    trace = readers.read_trace(spark, str(tmp_path / "first_zika-1.log"))
    assert trace.columns == ["Sample", "posterior"] and [tuple(r) for r in trace.collect()] == [(0, -3.5), (2000, -1.25)]
    assert readers.long_trace(trace).count() == 2


def test_trees_and_timings(spark, tmp_path):
    (tmp_path / "t.trees").write_text("#NEXUS\nBegin trees;\nTranslate\n1 A,\n2 B,\n3 C\n;\ntree STATE_0 = ((1:1,2:1)[&x=1]:0.5,3:1.5);\ntree STATE_100 = (1:2,(2:1,3:1):1);\ntree STATE_200 = ((1:")
    trees = readers.read_trees(spark, str(tmp_path / "t.trees"))
    assert {r.state: r.newick for r in trees.collect()} == {0: "((A:1,B:1):0.5,C:1.5);", 100: "(A:2,(B:1,C:1):1);"}
    assert readers.last_tree(trees).first().state == 100
    assert {(r.state, tuple(r.clade), r.stem) for r in readers.clade_stems(trees).collect()} == {(0, ("A", "B"), 0.5), (100, ("B", "C"), 1.0)}
    (tmp_path / "x.csv").write_text("# total=5\n# seed=1\noperator,n\na,3\n")
    totals, rows = readers.read_timing(spark, str(tmp_path / "x.csv"))
    assert {(r.key, r.value) for r in totals.collect()} == {("total", "5"), ("seed", "1")} and rows.first().n == 3


def test_xml_and_json(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<data><sequence taxon="A" value="AC"/><sequence taxon="B" value="G"/></data>')
    assert {(r.taxon, r.value) for r in readers.read_xml_sequences(spark, str(tmp_path / "a.xml")).collect()} == {("A", "AC"), ("B", "G")}
    (tmp_path / "a.json").write_text('{"sequences": [{"accession": "X1"}, {"accession": "X2"}]}')
    assert [r.accession for r in readers.read_seqset(spark, str(tmp_path / "a.json")).collect()] == ["X1", "X2"]


def test_writers(spark, tmp_path):
    taxa = spark.createDataFrame([("A|1", "AC")], "header string, sequence string")
    writers.write_fasta(taxa, str(tmp_path / "out"))
    writers.write_fasta(taxa.limit(0), str(tmp_path / "out"))  # stays
    assert spark.read.text(str(tmp_path / "out")).count() == 2
    assert writers.render_template("{{A}}-{{B}}", {"A": "{{B}}", "B": "x"}) == "{{B}}-x"
    df = spark.createDataFrame([("a", 0.5), ("b", None)], "k string, v double")
    assert "| a | 0.5000 |" in writers.as_table(df) and "n/a" in writers.as_table(df, "typst")
    writers.write_table(df, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2


def test_numbers(spark):
    assert numeric.gamma_cdf(2.0, 1.0) == pytest.approx(1 - 2.718281828459045 ** -2) and numeric.gamma_cdf(numeric.gamma_quantile(0.3, 2.5), 2.5) == pytest.approx(0.3)
    assert numeric.digamma(1.0) == pytest.approx(-0.5772156649015329)
    r = spark.range(1).select(numeric.erf(F.lit(0.5)).alias("e"), numeric.normal_quantile(F.lit(0.975)).alias("q"), numeric.digamma_of(F.lit(2.0)).alias("d"),
                              numeric.truncated_exponential(F.lit(0.5), F.lit(1.0), F.lit(1.0), F.lit(2.0)).alias("x"), numeric.hash_uniform(F.lit(1), F.lit("a")).alias("u")).first()
    assert r.e == pytest.approx(0.5204998778) and r.q == pytest.approx(1.959964, abs=1e-5) and r.d == pytest.approx(0.4227843351)
    assert 1 < r.x < 1.5 and 0 < r.u < 1


def test_samplers(spark):
    import numpy as np

    from dendrolake.functions import ctmc

    q = ctmc.hky((0.25,) * 4, 1.0)
    ends = spark.createDataFrame([(1, i, 0, i % 4, (i // 4) % 4, 1.0) for i in range(400)], "tree_id long, node long, site long, start_state long, end_state long, length double")
    events = kernels.sample_bridges(ends, q.tolist()).toPandas()
    again = kernels.sample_bridges(ends.repartition(7), q.tolist()).toPandas()
    key = ["node", "time"]
    assert events.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
    for i in range(400):
        e = events[events.node == i].sort_values("time")
        state = i % 4
        for r in e.itertuples():
            assert r.old_state == state != r.new_state and 0 < r.time < 1
            state = r.new_state
        assert state == (i // 4) % 4
    rng = np.random.default_rng(0)
    jumps = np.mean([len(kernels.bridge(q, 0, 1, 1.0, rng)) for _ in range(1500)])
    assert 1.0 < jumps < 1.6
    weighted = spark.createDataFrame([(g, i, float(i)) for g in range(2000) for i in range(4)], "grp long, item long, weight double")
    share = kernels.categorical_pick(weighted=weighted).groupBy("item").count().collect()
    assert {r.item: round(r["count"] / 2000, 1) for r in share} == {1: 0.2, 2: 0.3, 3: 0.5}


def test_site_histories_fit_their_tips(spark):
    node = spark.createDataFrame([(1, 1, None, False, 2.0), (1, 2, 1, False, 1.0), (1, 3, 1, True, 0.0), (1, 4, 2, True, 0.0), (1, 5, 2, True, 0.0)], "tree_id long, node long, parent long, is_leaf boolean, height double")
    tips = spark.createDataFrame([(1, n, s, m) for s in range(30) for n, m in ((3, 1), (4, 2), (5, 3))], "tree_id long, node long, site long, mask int")
    from dendrolake.functions import ctmc

    got = kernels.sample_site_histories(node, tips, ctmc.hky((0.25,) * 4, 1.0).tolist(), [0.25] * 4).collect()
    assert len(got) == 150 and all(r.state == 0 for r in got if r.node == 3) and all(r.state == 1 for r in got if r.node == 4) and all(r.state in (0, 1) for r in got if r.node == 5)


def test_streams(spark, tmp_path):
    rows = [("m", "e", 0, 1000 * i, float((i * 7919) % 101)) for i in range(300)]
    schema = "method string, experiment string, seed long, sample long, value double"
    for k in range(3):
        spark.createDataFrame(rows[k * 100: k * 100 + 100], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = streams.online_ess(source).writeStream.outputMode("update").format("memory").queryName("ess").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    got = sorted(spark.table("ess").collect(), key=lambda r: r.seen)
    assert [r.seen for r in got] == [100, 200, 300] and got[-1].ess > 0
    values, step = [], 1
    for i in range(12_001):
        values, step = streams.thin(values, step, float(i), i)
    assert step == 4 and streams.KEEP_LEAST <= len(values) <= streams.KEEP_MOST and values[1] == 4.0
