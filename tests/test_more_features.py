"""Per-parameter convergence from files, cached results, configurations, bounded queues."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from dendrolake.operators import configurations, convergence, traces
from dendrolake.sources import cache, readers
from dendrolake.streaming import queues


def logs(folder, started="2024-01-01 00:00:00"):
    rng = random.Random(1)
    for seed in (1, 2):
        for method, rho in (("brisk", 0.1), ("plain", 0.95)):
            lines, slow = [f"# Started job at {started}", "Sample\tposterior\tclock\tfixed\tname"], 0.0
            for i in range(300):
                slow = 0.97 * slow + rng.gauss(0, 1)
                lines.append(f"{1000 * i}\t{rng.gauss(-100, 5)}\t{slow if method == 'plain' else rng.gauss(0, 1) + rho}\t2.5\tx")
            (folder / f"{method}_flu-{seed}.log").write_text("\n".join(lines) + "\n")


def test_convergence_report_of_log_files(spark, tmp_path):
    logs(tmp_path)
    found = readers.discover_logs(spark, str(tmp_path)).collect()
    assert [(r.method, r.experiment, r.seed) for r in found] == [("brisk", "flu", 1), ("brisk", "flu", 2), ("plain", "flu", 1), ("plain", "flu", 2)]
    parts = [readers.long_trace(readers.read_trace(spark, r.path)).select(F.lit(r.method).alias("method"), F.lit(r.experiment).alias("experiment"), F.lit(r.seed).alias("seed"), "param", "sample", "value") for r in found]
    trace = parts[0]
    for x in parts[1:]:
        trace = trace.unionByName(x)
    last = spark.createDataFrame([(r.path, 299_000) for r in found], "path string, last long")
    seconds = {r.path: r.seconds for r in readers.seconds_per_sample(spark, str(tmp_path), last).collect()}
    assert len(seconds) == 4 and all(s > 0 for s in seconds.values())
    cost = spark.createDataFrame([("brisk", 6e4), ("plain", 6e4)], "method string, us double")  # a minute for 1000 samples
    trajectory = convergence.param_trajectory(trace).persist()
    assert {r.param for r in trajectory.select("param").distinct().collect()} == {"posterior", "clock"}  # neither the constant nor the text
    assert trajectory.groupBy("method", "seed", "param").count().where("count <> 20").count() == 0
    times = convergence.param_times.given(target=100.0)(param_trajectory=trajectory, cost=cost)
    runs = convergence.run_times(param_times=times)
    got = {(r.method, r.seed): r for r in runs.collect()}
    assert got["plain", 1].slowest == "clock" and got["plain", 1].projected and not got["brisk", 1].projected
    summary = {r.method: r for r in convergence.run_summary(run_times=runs).collect()}
    assert summary["plain"].any_projected and summary["plain"].slowest == "clock" and summary["plain"].median_minutes > summary["brisk"].median_minutes
    speed = {r.method: r.speedup for r in convergence.method_speedup.given(base="plain")(run_times=runs).collect()}
    assert speed["plain"] == 1 and speed["brisk"] > 1
    slow = {(r.method, r.param): r for r in convergence.param_slowness(param_times=times).collect()}
    assert slow["plain", "clock"].mean == 1 and slow["plain", "clock"].place == 1 and slow["plain", "posterior"].place == 2
    assert {r.param for r in convergence.least_param(param_trajectory=trajectory).where("method = 'plain'").collect()} == {"clock"}
    left = {(r.method, r.seed): r.remaining for r in convergence.remaining_samples.given(target=100.0)(param_trajectory=trajectory).collect()}
    assert left["brisk", 1] == 0 and left["plain", 1] > 300_000
    trajectory.unpersist()


def test_times_follow_the_last_drop_below_the_target(spark):
    points = [("m", "e", 1, "a", k, 1000 * k, e) for k, e in enumerate([250.0, 100.0, 210.0, 220.0], 1)] + [("m", "e", 1, "b", k, 1000 * k, e) for k, e in enumerate([10.0, 20.0, 40.0, 50.0], 1)]
    points += [("m", "e", 2, "a", k, 1000 * k, 300.0) for k in range(1, 5)] + [("m", "e", 2, "b", k, 1000 * k, None) for k in range(1, 3)]
    trajectory = spark.createDataFrame(points, "method string, experiment string, seed long, param string, upto long, sample long, ess double")
    got = {(r.seed, r.param): (r.minutes, r.projected) for r in convergence.param_times(param_trajectory=trajectory, cost=spark.createDataFrame([("m", 6e4)], "method string, us double")).collect()}
    assert got == {(1, "a"): (3.0, False), (1, "b"): (16.0, True), (2, "a"): (1.0, False), (2, "b"): (1.0, False)}


CALLS = []


def counted(spark, source, least=0):
    CALLS.append(source)
    return spark.read.csv(source, header=True, inferSchema=True).where(F.col("x") >= least)


def test_results_are_kept_until_a_file_or_a_setting_changes(spark, tmp_path):
    files = [tmp_path / f"{n}.csv" for n in "ab"]
    for f in files:
        f.write_text("x\n1\n2\n")
    kept = cache.ResultCache(spark, str(tmp_path / "cache"))

    def rows(f, **settings):
        return sorted(r.x for r in kept.get(str(f), counted, **settings).collect())

    assert rows(files[0]) == [1, 2] and rows(files[1]) == [1, 2] and len(CALLS) == 2
    assert rows(files[0]) == [1, 2] and len(CALLS) == 2
    assert rows(files[0], least=2) == [2] and len(CALLS) == 3
    time.sleep(0.01)
    files[0].write_text("x\n1\n5\n")
    os.utime(files[0], (time.time() + 5, time.time() + 5))
    assert rows(files[0]) == [1, 5] and rows(files[1]) == [1, 2] and CALLS[3:] == [str(files[0])]
    assert rows(files[0]) == [1, 5] and rows(files[0], least=2) == [5] and len(CALLS) == 5
    names = os.listdir(tmp_path / "cache")
    assert len([n for n in names if not n.startswith(".")]) == 3  # the results of the file's earlier state are gone, nothing is half written
    folder = tmp_path / "table"
    spark.range(3).selectExpr("id AS x").write.csv(str(folder), header=True)
    before = kept.names(str(folder), "z", {})
    (folder / "part-more.csv").write_text("x\n9\n")
    assert kept.names(str(folder), "z", {})[1] != before[1]


def test_configurations(spark):
    base = spark.createDataFrame([("m", "wide", "Exchange", 1, {"weight": "3"}), ("m", "slide", "Slide", 2, {"weight": "5", "size": "1"}), ("m", "slicer", "slice.Move", 3, {}), ("m", "bare", "Scale", 4, {})], "model string, operator string, spec string, position long, attributes map<string,string>")
    configs = spark.createDataFrame([("plain", "m"), ("less", "m"), ("more", "m"), ("other", "unknown")], "config string, model string")
    removed = spark.createDataFrame([("less", "wide")], "config string, operator string")
    changed = spark.createDataFrame([("more", "slide", {"weight": "7", "auto": "true"}), ("more", "bare", {"a": "b"})], "config string, operator string, attributes map<string,string>")
    added = spark.createDataFrame([("more", "slide", "slide2", {"size": "9"}, 1), ("more", "slide", "slide3", None, 2)], "config string, template string, operator string, attributes map<string,string>, nth long")
    out = configurations.apply_configurations(base, configs, removed, changed, added)
    got = {}
    for r in out.orderBy("config", "place").collect():
        got.setdefault(r.config, []).append((r.operator, r.attributes))
    assert got == {
        "plain": [("wide", {"weight": "3"}), ("slide", {"weight": "5", "size": "1"}), ("bare", {})], "less": [("slide", {"weight": "5", "size": "1"}), ("bare", {})],
        "more": [("wide", {"weight": "3"}), ("slide", {"weight": "7", "size": "1", "auto": "true"}), ("slide3", {"weight": "7", "size": "1", "auto": "true"}), ("slide2", {"weight": "7", "size": "9", "auto": "true"}), ("bare", {"a": "b"})],
    }
    with pytest.raises(ValueError, match="slicer"):
        configurations.apply_configurations(base, configs, spark.createDataFrame([("less", "slicer")], removed.schema), changed, added)
    with pytest.raises(ValueError, match="copies"):
        configurations.apply_configurations(base, configs, spark.createDataFrame([("more", "slide")], removed.schema), changed, added)


def test_operator_mixes(spark):
    operators = spark.createDataFrame([("a", 3.0), ("b", 5.0)], "operator string, weight double")
    got = {(r.mix, r.operator): r.weight for r in configurations.operator_mixes(operators, ["half=a:0.5,b:1", "b=a:2"]).collect()}
    assert got == {("a", "a"): 1, ("b", "a"): 2, ("baseline", "a"): 3, ("baseline", "b"): 5, ("half", "a"): 0.5, ("half", "b"): 1}
    for bad in ("x", "x=a", "x=c:1", "x=a:y"):
        with pytest.raises(ValueError):
            configurations.operator_mixes(operators, [bad])
    assert configurations.operator_mixes(operators).count() == 4


def test_trees_from_a_part_of_a_log_and_runs_together(spark):
    trees = spark.createDataFrame([(f, 10 * i, f"({f}{i});") for f in "ab" for i in range(11)], "file string, state long, newick string")
    got = readers.trees_from(trees, 0.5, 3)
    assert sorted((r.file, r.state) for r in got.collect()) == [(f, s) for f in "ab" for s in (50, 60, 70)]
    assert readers.trees_from(trees, 0.0).count() == 22 and got.columns == trees.columns
    with pytest.raises(ValueError):
        readers.trees_from(trees, 1.0)
    both = traces.concat_runs({"x": spark.range(2).selectExpr("id AS sample", "1.0D AS a"), "y": spark.range(1).selectExpr("id AS sample", "2.0D AS b")})
    assert sorted((r.run, r.sample, r.a, r.b) for r in both.collect()) == [("x", 0, 1.0, None), ("x", 1, 1.0, None), ("y", 0, None, 2.0)]
    with pytest.raises(ValueError):
        traces.concat_runs({})


PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def test_queues_are_bounded_and_found_again_after_a_restart(spark, tmp_path):
    rng = random.Random(6)
    values = [(k, i, float("nan") if i % 50 == 3 else rng.gauss(5, 2)) for i in range(900) for k in ("a", "b")]
    for part in range(3):
        rows = [x for x in values if part * 300 <= x[1] < part * 300 + 300]
        spark.createDataFrame(rows, "key string, nth long, value double").repartition(3).write.parquet(str(tmp_path / f"in/{part}"))
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        def run(upto):
            for part in range(upto):
                os.makedirs(tmp_path / "seen", exist_ok=True)
                if not (tmp_path / f"seen/{part}").exists():
                    os.rename(tmp_path / f"in/{part}", tmp_path / f"seen/{part}")
            source = spark.readStream.schema("key string, nth long, value double").parquet(str(tmp_path / "seen/*"))
            fits = queues.queue_fits(source, first=100, most=150)
            fits.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()

        run(1)
        run(2)  # another query, from the checkpoint of the first
        run(3)
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    got = sorted((r.key, r.observed, r.kept, round(r.mean, 9), round(r.sd, 9)) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = []
    for k in ("a", "b"):
        mine = [v for key, _, v in values if key == k]
        for n in (100, 200, 400, 800):
            last = [v for v in mine[:n] if v == v][-150:]
            mean, sd = queues.mean_and_deviation(last)
            want.append((k, n, len(last), round(mean, 9), round(sd, 9)))
    assert got == want


def test_fits_that_fail_are_tried_again():
    assert queues.mean_and_deviation([]) is None and queues.mean_and_deviation([1.0, 1.0]) is None and queues.mean_and_deviation([1.0, 3.0]) == (2.0, 2 ** 0.5)
