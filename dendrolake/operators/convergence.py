"""When sampler runs have converged, by every parameter that varies: trace(method, experiment, seed, param, sample, value). A run is a
method, experiment and seed; it has converged when its slowest parameter has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.plan import Dialect, plan
from . import traces

RUN = ["method", "experiment", "seed"]
# A logged count that isn't a parameter of the model.
LEFT_OUT = ("mutations.excessCount",)


def param_trajectory(trace: DataFrame, points: int = 20, burnin: float = 0.1, least: int = 20, left_out: tuple[str, ...] = LEFT_OUT) -> DataFrame:
    """method, experiment, seed, param, upto, sample, ess: effective sample sizes of each parameter as if its run were stopped at one of `points` rows
    from `least` to the last, without the first part. Parameters that don't vary, and runs shorter than `least`, have no rows. One group for
    each parameter of a run, as long as its log."""
    columns = [*RUN, "param"]

    def of_param(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("sample")
        x, sample, n = pdf["value"].to_numpy(float), pdf["sample"].to_numpy(), len(pdf)
        ends = np.unique(np.floor(least + np.arange(points) * (n - least) / max(1, points - 1)).astype(int)) if n >= least and x.min() < x.max() else []
        rows = [[*pdf.iloc[0][columns], k, sample[k - 1], round(traces.ess_tracer(x[int(k * burnin): k]), 6)] for k in ends]
        return pd.DataFrame(rows, columns=[*columns, "upto", "sample", "ess"])

    found = trace.where(~F.col("param").isin(*left_out)).groupBy(*columns).applyInPandas(of_param, "method string, experiment string, seed long, param string, upto long, sample long, ess double")
    return found.withColumn("ess", F.when(~F.isnan("ess"), F.col("ess")))


def param_trajectory_text(source: str, left_out: tuple[str, ...] = LEFT_OUT) -> str:
    """The same for a second engine, by a join of lags."""
    names = ", ".join(f"'{x}'" for x in left_out)
    varies = f"(SELECT *, min(value) OVER w < max(value) OVER w AS varies FROM {source} WHERE param NOT IN ({names}) WINDOW w AS (PARTITION BY method, experiment, seed, param))"
    packed = f"(SELECT method, concat(experiment, '|', param) AS experiment, seed, sample, value FROM {varies} v WHERE varies)"
    return f"SELECT method, split_part(experiment, '|', 1) AS experiment, seed, split_part(experiment, '|', 2) AS param, upto, sample, ess FROM ({traces.trajectory_text().format(trace=packed)}) z"


@plan("param_trajectory", "cost")
def param_times(d: Dialect, target: float = 200.0) -> str:
    """Minutes until the size of a parameter stays at the target or above: those of the first point after the last one below; at the rate
    of the last point where that is below. cost: microseconds of a sample by method. Where a size isn't known it doesn't count as below."""
    key = "t.method, t.experiment, t.seed, t.param"
    return f"""WITH r AS (SELECT {key}, t.ess, t.sample * k.us / 6.0E7 AS minutes, row_number() OVER (PARTITION BY {key} ORDER BY t.upto) AS i FROM {{param_trajectory}} t JOIN {{cost}} k ON k.method = t.method),
      b AS (SELECT method, experiment, seed, param, coalesce(max(CASE WHEN ess < {target!r} THEN i END), 0) AS low, max(i) AS n, max_by(coalesce(ess, -1.0E0), i) AS final, max(minutes) AS spent FROM r GROUP BY method, experiment, seed, param)
      SELECT b.method, b.experiment, b.seed, b.param, b.low = b.n AS projected, round(CASE WHEN b.low = b.n THEN b.spent * {target!r} / b.final ELSE r.minutes END, 4) AS minutes, round(b.final / b.spent, 6) AS ess_per_minute
      FROM b LEFT JOIN r ON r.method = b.method AND r.experiment = b.experiment AND r.seed = b.seed AND r.param = b.param AND r.i = b.low + 1 WHERE b.spent > 0 AND (b.low < b.n OR b.final > 0)"""


@plan("param_times")
def run_times(d: Dialect) -> str:
    """Each run's slowest parameter, the first by name of equally slow ones, and its minutes."""
    return """SELECT method, experiment, seed, param AS slowest, minutes, projected FROM (SELECT method, experiment, seed, param, minutes, projected,
      row_number() OVER (PARTITION BY method, experiment, seed ORDER BY minutes DESC, param) AS nth FROM {param_times}) x WHERE nth = 1"""


@plan("run_times")
def run_summary(d: Dialect) -> str:
    """Over the seeds of an experiment by method: runs, median and extremes of their minutes, whether any was projected, and the parameter that was
    slowest most often."""
    return """WITH c AS (SELECT method, experiment, slowest, row_number() OVER (PARTITION BY method, experiment ORDER BY count(*) DESC, slowest) AS nth FROM {run_times} GROUP BY method, experiment, slowest)
      SELECT t.method, t.experiment, count(*) AS runs, round(median(t.minutes), 4) AS median_minutes, min(t.minutes) AS min_minutes, max(t.minutes) AS max_minutes, bool_or(t.projected) AS any_projected, min(c.slowest) AS slowest
      FROM {run_times} t JOIN c ON c.method = t.method AND c.experiment = t.experiment AND c.nth = 1 GROUP BY t.method, t.experiment"""


@plan("param_times")
def param_slowness(d: Dialect) -> str:
    """Minutes of each parameter over those of its run's slowest: mean and deviation over seeds by method, experiment and parameter; a parameter's
    place among those of its method goes by how many experiments have it, then by its mean."""
    return """WITH r AS (SELECT method, experiment, seed, param, minutes / max(minutes) OVER (PARTITION BY method, experiment, seed) AS relative FROM {param_times}),
      s AS (SELECT method, experiment, param, avg(relative) AS mean, stddev_samp(relative) AS sd FROM r GROUP BY method, experiment, param),
      o AS (SELECT method, param, row_number() OVER (PARTITION BY method ORDER BY count(*) DESC, round(avg(mean), 9) DESC, param) AS place FROM s GROUP BY method, param)
      SELECT s.method, s.experiment, s.param, o.place, round(s.mean, 6) AS mean, round(s.sd, 6) AS sd FROM s JOIN o ON o.method = s.method AND o.param = s.param"""


@plan("run_times")
def method_speedup(d: Dialect, base: str = "click") -> str:
    """Count, mean, median and sum of the runs' minutes by experiment and method, and the ratio of means to a base method."""
    return f"""WITH s AS (SELECT experiment, method, count(*) AS n, avg(minutes) AS mean, median(minutes) AS med, sum(minutes) AS total FROM {{run_times}} GROUP BY experiment, method)
      SELECT s.experiment, s.method, s.n, round(s.mean, 4) AS mean, round(s.med, 4) AS median, round(s.total, 4) AS total, round(b.mean / s.mean, 6) AS speedup FROM s LEFT JOIN s b ON b.experiment = s.experiment AND b.method = '{base}'"""


@plan("param_trajectory")
def least_param(d: Dialect) -> str:
    """The parameter with the smallest size at the end of each run, the first by name of equal ones; sizes that aren't known don't count."""
    return """WITH e AS (SELECT method, experiment, seed, param, max_by(ess, upto) AS ess FROM {param_trajectory} GROUP BY method, experiment, seed, param)
      SELECT method, experiment, seed, param, ess FROM (SELECT e.*, row_number() OVER (PARTITION BY method, experiment, seed ORDER BY ess, param) AS nth FROM e WHERE ess IS NOT NULL) x WHERE nth = 1"""


@plan("param_trajectory")
def remaining_samples(d: Dialect, target: float = 200.0) -> str:
    """Samples that the slowest parameter of each run still needs at its present rate, none once it has the target."""
    return f"""WITH e AS (SELECT method, experiment, seed, param, max_by(ess, upto) AS ess, max(sample) AS done FROM {{param_trajectory}} GROUP BY method, experiment, seed, param)
      SELECT method, experiment, seed, round(min(ess), 6) AS ess, max(CASE WHEN ess > 0 THEN CAST(ceil(greatest(0.0E0, {target!r} / ess - 1) * done) AS BIGINT) END) AS remaining FROM e WHERE ess IS NOT NULL GROUP BY method, experiment, seed"""
