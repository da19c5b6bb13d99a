"""How fast the uncertain clades of tree logs come and go, by the number of events that is expected on their stems: stems(run, i, clade, stem), a
row for each clade of the i-th tree of a run, i from zero, and samples(run, i, state), a row for each tree, also for those without any clade."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.plan import Dialect, plan
from ..sources import readers

# Upper ends of the bins of loads, each its own bin's; the last has none.
BINS = (0.5, 1.5, 3.0, 6.0)


@plan("stems", "samples", "pace", "clock")
def clade_refreshes(d: Dialect, least: float = 0.05, most: float = 0.95) -> str:
    """For each clade whose share of a run's trees lies between the bounds: how often it comes or goes between consecutive trees, a minute and a million
    samples, over what independent draws would give; and the mean load of its stem. pace(run, seconds): of a million samples; null gives null times.
    clock(run, per_time): events of the alignment in a unit of time. Samples are those of a log of evenly spaced states, the
    distance that of the first two; runs of a single tree have no distance, and no clade between the bounds."""
    w = "OVER (PARTITION BY run, clade ORDER BY i)"
    return f"""WITH n AS (SELECT run, count(*) AS trees, count(*) * (min(CASE WHEN i = 1 THEN state END) - min(CASE WHEN i = 0 THEN state END)) AS spent FROM {{samples}} GROUP BY run),
      p AS (SELECT run, clade, i, stem, lag(i) {w} AS earlier, lead(i) {w} AS later FROM {{stems}}),
      s AS (SELECT p.run, p.clade, n.trees, n.spent, count(*) AS held, count(*) / CAST(n.trees AS DOUBLE) AS support, avg(p.stem) AS stem,
        CAST(sum(CASE WHEN p.i > 0 AND (p.earlier IS NULL OR p.earlier < p.i - 1) THEN 1 ELSE 0 END) + sum(CASE WHEN p.i < n.trees - 1 AND (p.later IS NULL OR p.later > p.i + 1) THEN 1 ELSE 0 END) AS BIGINT) AS flips
        FROM p JOIN n ON n.run = p.run GROUP BY p.run, p.clade, n.trees, n.spent),
      u AS (SELECT s.*, flips / (2 * support * (1 - support)) AS refreshes FROM s WHERE support > {least!r} AND support < {most!r})
      SELECT u.run, u.clade, u.held, u.flips, round(u.support, 6) AS support, round(u.refreshes / (u.spent * q.seconds / 6.0E7), 6) AS per_minute, round(u.refreshes * 1.0E6 / u.spent, 6) AS per_million, round(u.stem * c.per_time, 6) AS load
      FROM u LEFT JOIN {{pace}} q ON q.run = u.run LEFT JOIN {{clock}} c ON c.run = u.run"""


def _bin(load: str) -> str:
    return "CASE " + " ".join(f"WHEN {load} <= {x!r} THEN {k}" for k, x in enumerate(BINS, 1)) + f" WHEN {load} > {BINS[-1]!r} THEN {len(BINS) + 1} END"


@plan("refreshes")
def refresh_bins(d: Dialect) -> str:
    """Clades of each run by their load: how many, and the medians of their rates; bins without any have a row. Clades without a load are in no bin."""
    runs = d.series("1", str(len(BINS) + 1), "bin", "(SELECT DISTINCT run FROM {refreshes}) r", "run")
    return f"""WITH g AS ({runs}), b AS (SELECT run, {_bin("load")} AS bin, per_minute, per_million FROM {{refreshes}})
      SELECT g.run, g.bin, count(b.bin) AS clades, round(median(b.per_minute), 4) AS per_minute, round(median(b.per_million), 4) AS per_million FROM g LEFT JOIN b ON b.run = g.run AND b.bin = g.bin GROUP BY g.run, g.bin"""


@plan("refreshes")
def loaded_share(d: Dialect, above: float = 1.5) -> str:
    """The share of a run's uncertain clades whose load is above a bound; clades without a load aren't."""
    return f"SELECT run, count(*) AS clades, round(avg(CASE WHEN load > {above!r} THEN 1.0E0 ELSE 0.0E0 END), 3) AS share FROM {{refreshes}} GROUP BY run"


def refresh_report(bins: DataFrame, runs: DataFrame) -> DataFrame:
    """Bins side by side: a row for each experiment and bin, the columns <method>_clades, _per_minute and _per_million. runs: run, experiment, method. The methods,
    a handful, become names of columns."""
    values = [F.first(c).alias(c) for c in ("clades", "per_minute", "per_million")]
    return bins.join(runs, "run").groupBy("experiment", "bin").pivot("method").agg(*values)


def mean_clock(trace: DataFrame, column: str, sites: int, burnin: float = 0.1) -> float:
    """Events of an alignment of so many sites in a unit of time: the mean of a column of a wide trace after its first part, times the sites."""
    rows = trace.select("Sample", column)
    n = rows.count()
    order = rows.select(F.percentile("Sample", F.array(F.lit(int(n * burnin) / max(1, n - 1)))).alias("q")).first().q
    return float(rows.where(F.col("Sample") >= order[0]).agg(F.avg(column)).first()[0]) * sites


def log_stems(spark: SparkSession, path: str, fraction: float = 0.1, most: int | None = 20_000) -> tuple[DataFrame, DataFrame]:
    """(stems, samples) of tree logs, from a part of each on, so many trees at most; run is the file."""
    trees = readers.trees_from(readers.read_trees(spark, path), fraction, most)
    samples = trees.select(F.col("file").alias("run"), "state", (F.expr("row_number() OVER (PARTITION BY file ORDER BY state)") - 1).cast("long").alias("i"))
    stems = readers.clade_stems(trees).withColumnRenamed("file", "run").join(samples, ["run", "state"])
    return stems.select("run", "i", F.array_join("clade", ",").alias("clade"), "stem"), samples.select("run", "i", "state")
