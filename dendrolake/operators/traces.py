"""Analytics of sampler logs: trace(method, experiment, seed, sample, value) and op_timing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..plans.plan import Dialect, plan

CHAIN = "method, experiment, seed"
MAX_LAG = 2000


def concat_runs(runs: dict[str, DataFrame]) -> DataFrame:
    """The rows of several runs under their names in a column `run`; columns that a run lacks are null there."""
    parts = [df.withColumn("run", F.lit(name)) for name, df in runs.items()]
    if not parts:
        raise ValueError("there are no runs")
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


@plan("trace")
def cleaned_trace(d: Dialect) -> str:
    """Rows whose sample is below the next line's, in file order; the last row stays. One pass."""
    return f"""SELECT {CHAIN}, line_no, sample, value FROM (SELECT {CHAIN}, line_no, sample, value, lead(sample) OVER (PARTITION BY {CHAIN} ORDER BY line_no) AS nxt FROM {{trace}}) x WHERE nxt IS NULL OR sample < nxt"""


@plan("trace")
def burnin_rows(d: Dialect, fraction: float = 0.1) -> str:
    """The rows after the first part of each chain."""
    return f"""SELECT {CHAIN}, sample, value FROM (SELECT {CHAIN}, sample, value, row_number() OVER (PARTITION BY {CHAIN} ORDER BY sample) - 1 AS i, count(*) OVER (PARTITION BY {CHAIN}) AS n FROM {{trace}}) x
      WHERE i >= floor(CAST({fraction!r} AS DOUBLE) * n)"""


@plan("trace")
def burnin_value(d: Dialect, fraction: float = 0.2) -> str:
    """The rows of each chain whose sample is at least a fraction of the last one."""
    return f"""SELECT {CHAIN}, sample, value FROM (SELECT {CHAIN}, sample, value, max(sample) OVER (PARTITION BY {CHAIN}) AS last FROM {{trace}}) x WHERE sample >= CAST({fraction!r} AS DOUBLE) * last"""


@plan("trace")
def prefix_points(d: Dialect) -> str:
    """Expanding windows of a chain: 20 ends from 20 to its length, each with its first tenth dropped."""
    return f"""WITH n AS (SELECT {CHAIN}, count(*) AS n FROM {{trace}} GROUP BY {CHAIN} HAVING count(*) >= 20),
      k AS ({d.series("0", "19", "k", "n", CHAIN + ", n")}),
      p AS (SELECT DISTINCT {CHAIN}, CAST(floor(20 + k * (n - 20) / 19.0E0) AS BIGINT) AS upto FROM k),
      t AS (SELECT {CHAIN}, value, row_number() OVER (PARTITION BY {CHAIN} ORDER BY sample) - 1 AS i FROM {{trace}})
      SELECT p.method, p.experiment, p.seed, p.upto, count(*) AS n, round(avg(t.value), 6) AS mean, round(stddev_samp(t.value), 6) AS sd
      FROM p JOIN t ON t.method = p.method AND t.experiment = p.experiment AND t.seed = p.seed AND t.i >= floor(p.upto * 0.1E0) AND t.i < p.upto GROUP BY p.method, p.experiment, p.seed, p.upto"""


def autocovariances(values, lags: int):
    """Mean-corrected autocovariances of all lags below `lags`, from one transform. They don't depend on where zero is; from
    the first value on, a constant chain has exactly none."""
    import numpy as np

    x = np.asarray(values, float)
    x = x - x[0]
    n, mean = len(x), x.mean()
    spectrum = np.fft.rfft(x, 1 << (2 * n - 1).bit_length())
    products = np.fft.irfft(spectrum * spectrum.conj())[:lags]
    sums = np.concatenate([[0.0], np.cumsum(x)])
    k = np.arange(lags)
    return (products - (sums[n - k] + sums[n] - sums[k]) * mean + mean * mean * (n - k)) / (n - k)


def ess_tracer(values) -> float:
    """Samples over the integrated autocorrelation time; lags are added in pairs (1, 2), (3, 4), ... while
    their sum is positive. Constant or empty: not a number."""
    n = len(values)
    if not n:
        return float("nan")
    a = autocovariances(values, min(n, MAX_LAG))
    if a[0] <= 1e-300:
        return float("nan")
    total = a[0]
    for k in range(2, len(a), 2):
        if a[k - 1] + a[k] <= 0:
            break
        total += 2 * (a[k - 1] + a[k])
    return n / (total / a[0])


def ess_geyer(values) -> float:
    """Initial positive sequence: pairs (0, 1), (2, 3), ... of autocorrelations scaled by variance and n."""
    import numpy as np

    x = np.asarray(values, float)
    n = len(x)
    centred = x - x.mean() if n else x
    if not n or not (centred @ centred) > 0:
        return float("nan")
    spectrum = np.fft.rfft(centred, 1 << (2 * n - 1).bit_length())
    rho = np.fft.irfft(spectrum * spectrum.conj())[:n]
    rho /= rho[0]
    tau = -1.0
    for k in range(0, n - 1, 2):
        pair = rho[k] + rho[k + 1]
        if pair <= 0:
            break
        tau += 2 * pair
    return n / max(tau, 1.0)


def ess_monotone(rho, n: int, cap: bool = False) -> float:
    """From given autocorrelations: pairs (0, 1), (2, 3), ... until one is negative, made non-increasing."""
    pairs, least = 0.0, float("inf")
    for k in range(0, len(rho) - 1, 2):
        pair = rho[k] + rho[k + 1]
        if pair != pair or pair in (float("inf"), float("-inf")):
            raise ValueError("autocorrelations must be finite")
        if pair < 0:
            break
        least = min(least, pair)
        pairs += least
    tau = 2 * pairs - 1
    ess = float("inf") if tau == 0 else n / (1.0 if tau < 0 else tau)
    return min(ess, n) if cap else ess


def rank_normal(values):
    """Normal scores of average ranks."""
    from statistics import NormalDist

    import numpy as np

    x = np.asarray(values, float)
    _, inverse, counts = np.unique(x, return_inverse=True, return_counts=True)
    upto = np.cumsum(counts)
    score = NormalDist().inv_cdf
    # one score for all equal values
    return np.array([score((r - 0.375) / (len(x) + 0.25)) for r in upto - (counts - 1) / 2])[inverse]


def ess_rank_split(values) -> float:
    """Of normal scores of all values, over two halves (an odd last one is dropped after ranking), from the
    variogram. A constant chain has as many as its halves hold."""
    import numpy as np

    half = len(values) // 2
    if half < 2:
        return float("nan")
    z = rank_normal(values)[: 2 * half].reshape(2, half)
    within = z.var(1, ddof=1).mean()
    total = within * (half - 1) / half + z.mean(1).var(ddof=1)
    if total == 0:
        return float(2 * half)
    # squares of differences at all lags: squares at both ends less twice the products, which one transform gives
    spectrum = np.fft.rfft(z, 1 << (2 * half - 1).bit_length())
    products = np.fft.irfft(spectrum * spectrum.conj())[:, :half]
    squares = np.concatenate([np.zeros((2, 1)), np.cumsum(z * z, 1)], 1)
    lags = np.arange(half)
    gaps = (squares[:, half - lags] + squares[:, half:] - squares[:, lags] - 2 * products).sum(0) / (2 * (half - lags))
    rho = 1 - gaps / (2 * total)
    rho[0] = 1.0
    return ess_monotone(rho, 2 * half)


def trace_ess(trace: DataFrame) -> DataFrame:
    """Effective sample sizes of each chain. Chains are independent: one group for each, as long as its log."""
    columns = ["method", "experiment", "seed"]

    def of_chain(pdf):
        import pandas as pd

        x = pdf.sort_values("sample")["value"].to_numpy(float)
        return pd.DataFrame([[*pdf.iloc[0][columns], len(x), *(round(f(x), 6) for f in (ess_tracer, ess_geyer, ess_rank_split))]], columns=[*columns, "n", "tracer", "geyer", "rank_split"])

    return trace.groupBy(*columns).applyInPandas(of_chain, "method string, experiment string, seed long, n long, tracer double, geyer double, rank_split double")


def tracer_ess(trace: DataFrame) -> DataFrame:
    """method, experiment, seed, n, tracer: the size of each chain alone; null of a constant."""
    sizes = trace_ess(trace)
    return sizes.selectExpr("method", "experiment", "seed", "n", "CASE WHEN NOT isnan(tracer) THEN tracer END AS tracer")


def _from_lags(d: Dialect) -> str:
    """Sizes from `a`, the covariance of each lag, and `m`, what is known of each chain."""
    return f"""p AS (SELECT {CHAIN}, {d.idiv("lag + 1", "2")} AS pair, min(n) AS n, sum(a) AS s, count(*) AS lags FROM a GROUP BY {CHAIN}, {d.idiv("lag + 1", "2")}),
      stop AS (SELECT {CHAIN}, min(CASE WHEN pair > 0 AND (s <= 0 OR lags < 2) THEN pair END) AS stop_pair FROM p GROUP BY {CHAIN}),
      e AS (SELECT p.method, p.experiment, p.seed, min(p.n) AS n, max(CASE WHEN pair = 0 THEN s END) AS zero, 2 * sum(CASE WHEN pair > 0 AND (stop_pair IS NULL OR pair < stop_pair) THEN s ELSE 0 END) AS later
        FROM p JOIN stop ON p.method = stop.method AND p.experiment = stop.experiment AND p.seed = stop.seed GROUP BY p.method, p.experiment, p.seed)
      SELECT e.method, e.experiment, e.seed, e.n, CASE WHEN m.varies THEN round(e.n / ((e.zero + e.later) / e.zero), 6) END AS tracer
      FROM e JOIN m ON m.method = e.method AND m.experiment = e.experiment AND m.seed = e.seed"""


@plan("trace")
def ess_by_lags(d: Dialect) -> str:
    """Effective sample size by a join of lags, for short chains: pairs of lags are added while positive; null of a constant."""
    return f"""WITH t AS (SELECT {CHAIN}, value, row_number() OVER (PARTITION BY {CHAIN} ORDER BY sample) - 1 AS i FROM {{trace}}),
      m AS (SELECT {CHAIN}, count(*) AS n, avg(value) AS m, min(value) < max(value) AS varies FROM t GROUP BY {CHAIN}),
      c AS (SELECT t.method, t.experiment, t.seed, m.n, t.i, t.value - m.m AS v FROM t JOIN m ON t.method = m.method AND t.experiment = m.experiment AND t.seed = m.seed),
      a AS (SELECT x.method, x.experiment, x.seed, y.i - x.i AS lag, min(x.n) AS n, sum(x.v * y.v) / count(*) AS a
        FROM c x JOIN c y ON x.method = y.method AND x.experiment = y.experiment AND x.seed = y.seed AND y.i >= x.i AND y.i - x.i < {MAX_LAG} GROUP BY x.method, x.experiment, x.seed, y.i - x.i),
      {_from_lags(d)}"""


@plan("a", "m")
def sizes_from_lags(d: Dialect) -> str:
    return f"WITH a AS (SELECT * FROM {{a}}), m AS (SELECT * FROM {{m}}), {_from_lags(d)}"


# Rows of a chain that are taken together, no fewer than there are lags.
BLOCK = 8192


def ess_by_blocks(trace: DataFrame) -> DataFrame:
    """What ess_by_lags returns, for long chains: each block of a chain has the products of its rows with those up to MAX_LAG on, which begin the next block, and
    blocks are added up. As much work as rows times lags, in place of all pairs of a chain, and a task holds a block."""
    chain = CHAIN.split(", ")
    numbered = trace.select(*chain, "value", (F.row_number().over(Window.partitionBy(*chain).orderBy("sample")) - 1).alias("i"))
    m = cut(numbered.groupBy(*chain).agg(F.count("*").alias("n"), F.avg("value").alias("m"), (F.min("value") < F.max("value")).alias("varies")))
    rows = numbered.join(m, chain).select(*chain, "n", "i", F.coalesce(F.col("value") - F.col("m"), F.lit(0.0)).alias("v"), F.floor(F.col("i") / BLOCK).cast("long").alias("block"))
    # the first rows of a block are also those after the block before
    spread = rows.withColumn("block", F.explode(F.when((F.col("i") % BLOCK < MAX_LAG - 1) & (F.col("block") > 0), F.array("block", F.col("block") - 1)).otherwise(F.array("block"))))

    def of_block(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("i")
        y, own = pdf["v"].to_numpy(float), int((pdf["i"] // BLOCK == pdf["block"].iloc[0]).sum())
        x, lags = y[:own], min(MAX_LAG, len(y))
        sums = [float(np.dot(x[: len(y) - k], y[k: k + own])) for k in range(lags)]
        return pd.DataFrame({c: pdf[c].iloc[0] for c in [*chain, "n"]} | {"lag": np.arange(lags), "total": sums})

    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.select(*chain, 'n').schema)}, lag long, total double"
    sums = spread.groupBy(*chain, "block").applyInPandas(of_block, schema).groupBy(*chain, "n", "lag").agg(F.sum("total").alias("total"))
    return sizes_from_lags(a=sums.select(*chain, "n", "lag", (F.col("total") / (F.col("n") - F.col("lag"))).alias("a")), m=m)


TRAJECTORY = "method string, experiment string, seed long, upto long, sample long, ess double"


def ess_trajectory(trace: DataFrame, points: int = 20, burnin: float = 0.1, least: int = 20) -> DataFrame:
    """Effective sample size of each chain over expanding windows: `points` ends from `least` rows to all, the first
    part of each left out. Chains are independent: one group for each, as long as its log. Chains that are shorter
    than `least` have no row; of a constant window the size is null."""
    columns = ["method", "experiment", "seed"]

    def of_chain(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("sample")
        x, sample, n = pdf["value"].to_numpy(float), pdf["sample"].to_numpy(), len(pdf)
        ends = np.unique(np.floor(least + np.arange(points) * (n - least) / max(1, points - 1)).astype(int)) if n >= least else []
        return pd.DataFrame([[*pdf.iloc[0][columns], k, sample[k - 1], round(ess_tracer(x[int(k * burnin): k]), 6)] for k in ends], columns=[*columns, "upto", "sample", "ess"])

    return trace.groupBy(*columns).applyInPandas(of_chain, TRAJECTORY)


def trajectory_text(points: int = 20, least: int = 20) -> str:
    """The same for a second engine, by a join of lags."""
    chain = "x.method = y.method AND x.experiment = y.experiment AND x.seed = y.seed"
    return f"""WITH t AS (SELECT {CHAIN}, sample, value, row_number() OVER (PARTITION BY {CHAIN} ORDER BY sample) - 1 AS i, count(*) OVER (PARTITION BY {CHAIN}) AS n FROM {{trace}}),
      p AS (SELECT DISTINCT {CHAIN}, CAST(floor({least} + k * (n - {least}) / {points - 1}.0) AS BIGINT) AS upto FROM t, range({points}) AS r(k) WHERE n >= {least}),
      w AS (SELECT x.method, x.experiment, x.seed, x.upto, y.i, y.value - avg(y.value) OVER (PARTITION BY x.method, x.experiment, x.seed, x.upto) AS v, count(*) OVER (PARTITION BY x.method, x.experiment, x.seed, x.upto) AS m
        FROM p x JOIN t y ON {chain} AND y.i < x.upto AND y.i >= floor(x.upto * 0.1)),
      a AS (SELECT x.method, x.experiment, x.seed, x.upto, y.i - x.i AS lag, min(x.m) AS m, sum(x.v * y.v) / count(*) AS a FROM w x JOIN w y ON {chain} AND x.upto = y.upto AND y.i >= x.i AND y.i - x.i < {MAX_LAG} GROUP BY ALL),
      q AS (SELECT {CHAIN}, upto, (lag + 1) // 2 AS pair, min(m) AS m, sum(a) AS s, count(*) AS lags FROM a GROUP BY ALL),
      z AS (SELECT {CHAIN}, upto, min(CASE WHEN pair > 0 AND (s <= 0 OR lags < 2) THEN pair END) AS stop FROM q GROUP BY ALL),
      e AS (SELECT x.method, x.experiment, x.seed, x.upto, round(min(x.m) / ((max(CASE WHEN pair = 0 THEN s END) + 2 * sum(CASE WHEN pair > 0 AND (stop IS NULL OR pair < stop) THEN s ELSE 0 END)) / max(CASE WHEN pair = 0 THEN s END)), 6) AS ess
        FROM q x JOIN z y ON {chain} AND x.upto = y.upto GROUP BY ALL)
      SELECT x.method, x.experiment, x.seed, x.upto, y.sample, x.ess FROM e x JOIN t y ON {chain} AND y.i = x.upto - 1"""


@plan("trajectory", "cost")
def ess_curve(d: Dialect) -> str:
    """Minutes and effective samples a minute at each point of a trajectory. cost: microseconds of a sample by method."""
    return f"""SELECT t.method, t.experiment, t.seed, t.upto, t.sample, t.ess, round(t.sample * k.us / 6.0E7, 6) AS minutes, round(t.ess / (t.sample * k.us / 6.0E7), 6) AS ess_per_minute
      FROM {{trajectory}} t JOIN {{cost}} k ON k.method = t.method WHERE t.sample > 0"""


@plan("trajectory", "cost")
def converged_at(d: Dialect, target: float = 200.0) -> str:
    """Minutes until the effective sample size of a chain stays at the target or above: those of the first point after
    the last one below; chains that end below are extrapolated at the rate of their last point."""
    return f"""WITH r AS (SELECT t.method, t.experiment, t.seed, coalesce(t.ess, 0.0E0) AS ess, t.sample * k.us / 6.0E7 AS minutes, row_number() OVER (PARTITION BY t.method, t.experiment, t.seed ORDER BY t.upto) AS i
        FROM {{trajectory}} t JOIN {{cost}} k ON k.method = t.method),
      b AS (SELECT {CHAIN}, coalesce(max(CASE WHEN ess < {target!r} THEN i END), 0) AS low, max(i) AS n, max_by(ess, i) AS final, max(minutes) AS spent FROM r GROUP BY {CHAIN})
      SELECT b.method, b.experiment, b.seed, b.low = b.n AS projected, round(CASE WHEN b.low = b.n THEN b.spent * {target!r} / b.final ELSE r.minutes END, 4) AS minutes
      FROM b LEFT JOIN r ON r.method = b.method AND r.experiment = b.experiment AND r.seed = b.seed AND r.i = b.low + 1 WHERE b.low < b.n OR b.final > 0"""


@plan("summary", "experiment_stats")
def stats_join(d: Dialect) -> str:
    """Summaries of experiments with what else is known of them: all summaries stay."""
    return "SELECT s.*, e.chains, e.mean_value FROM {summary} s LEFT JOIN {experiment_stats} e ON e.experiment = s.experiment"


@plan("trace")
def mean_by_experiment(d: Dialect) -> str:
    """Mean over chains of each experiment of their mean after the first tenth; what isn't a number doesn't count."""
    good = "CASE WHEN NOT isnan(value) THEN value END"
    return f"""WITH t AS (SELECT {CHAIN}, {good} AS value, row_number() OVER (PARTITION BY {CHAIN} ORDER BY sample) - 1 AS i, count(*) OVER (PARTITION BY {CHAIN}) AS n FROM {{trace}}),
      c AS (SELECT {CHAIN}, avg(value) AS m FROM t WHERE i >= floor(0.1E0 * n) GROUP BY {CHAIN})
      SELECT experiment, count(m) AS chains, round(avg(m), 6) AS mean_value FROM c GROUP BY experiment"""


@plan("trace")
def first_stable(d: Dialect) -> str:
    """When the running mean of a chain comes to stay above ten: the first point after the last below; chains that
    end below are extrapolated."""
    return f"""WITH r AS (SELECT {CHAIN}, sample, avg(value) OVER (PARTITION BY {CHAIN} ORDER BY sample ROWS UNBOUNDED PRECEDING) AS level, row_number() OVER (PARTITION BY {CHAIN} ORDER BY sample) AS i FROM {{trace}}),
      b AS (SELECT {CHAIN}, max(CASE WHEN level < 10 THEN i END) AS low, max(i) AS n, max(sample) AS last, max_by(level, i) AS final FROM r GROUP BY {CHAIN})
      SELECT b.method, b.experiment, b.seed, CAST(coalesce(b.low, 0) AS BIGINT) AS low, b.low = b.n AS projected,
        round(CASE WHEN b.low = b.n THEN 10 / (b.final / b.last) ELSE CAST(r.sample AS DOUBLE) END, 4) AS minutes
      FROM b LEFT JOIN r ON r.method = b.method AND r.experiment = b.experiment AND r.seed = b.seed AND r.i = coalesce(b.low, 0) + 1
      WHERE b.low IS NULL OR b.low < b.n OR b.final > 0"""


@plan("times")
def convergence_summary(d: Dialect) -> str:
    """Over seeds: count, median, extremes, whether any was projected, and the method that was slowest most often."""
    return """WITH slow AS (SELECT experiment, seed, method AS slowest FROM (SELECT experiment, seed, method, row_number() OVER (PARTITION BY experiment, seed ORDER BY minutes DESC, method) AS nth FROM {times}) m WHERE nth = 1),
      c AS (SELECT experiment, slowest, row_number() OVER (PARTITION BY experiment ORDER BY count(*) DESC, slowest) AS nth FROM slow GROUP BY experiment, slowest)
      SELECT t.experiment, count(*) AS runs, round(median(t.minutes), 4) AS median_minutes, min(t.minutes) AS min_minutes, max(t.minutes) AS max_minutes, bool_or(t.projected) AS any_projected, min(c.slowest) AS slowest
      FROM {times} t JOIN c ON c.experiment = t.experiment AND c.nth = 1 GROUP BY t.experiment"""


@plan("times")
def relative_to_slowest(d: Dialect) -> str:
    """Each chain's time over the longest of its experiment and seed."""
    return "SELECT method, experiment, seed, round(minutes / max(minutes) OVER (PARTITION BY experiment, seed), 6) AS relative FROM {times}"


@plan("times")
def relative_stats(d: Dialect) -> str:
    """Mean and deviation of relative times by method and experiment; methods by coverage, then mean."""
    return """WITH r AS (SELECT method, experiment, minutes / max(minutes) OVER (PARTITION BY experiment, seed) AS relative FROM {times}),
      s AS (SELECT method, experiment, avg(relative) AS mean, stddev_samp(relative) AS sd FROM r GROUP BY method, experiment),
      o AS (SELECT method, row_number() OVER (ORDER BY count(*) DESC, round(avg(mean), 9) DESC, method) AS place FROM s GROUP BY method)
      SELECT s.method, o.place, s.experiment, round(s.mean, 6) AS mean, round(s.sd, 6) AS sd FROM s JOIN o ON s.method = o.method"""


@plan("times")
def timing_speedup(d: Dialect, base: str = "click") -> str:
    """Count, mean, median and sum by experiment and method, and the ratio of means to a base method."""
    return f"""WITH s AS (SELECT experiment, method, count(*) AS n, avg(minutes) AS mean, median(minutes) AS med, sum(minutes) AS total FROM {{times}} GROUP BY experiment, method)
      SELECT s.experiment, s.method, s.n, round(s.mean, 4) AS mean, round(s.med, 4) AS median, round(s.total, 4) AS total, round(b.mean / s.mean, 6) AS speedup
      FROM s LEFT JOIN s b ON b.experiment = s.experiment AND b.method = '{base}'"""


@plan("trace")
def describe_by_seed(d: Dialect) -> str:
    """Count, mean, deviation, extremes and linear quartiles of each seed's values."""
    q = "percentile(value, {0})" if d.spark else "quantile_cont(value, {0})"
    return f"""SELECT seed, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, min(value) AS least, round({q.format(0.25)}, 6) AS q1, round({q.format(0.5)}, 6) AS q2,
      round({q.format(0.75)}, 6) AS q3, max(value) AS most FROM {{trace}} GROUP BY seed"""


@plan("trace")
def load_bins(d: Dialect) -> str:
    """Values over their chain's mean in five bins, empty ones too: size and median; and the share above 1.5."""
    return f"""WITH l AS (SELECT method, value / avg(value) OVER (PARTITION BY {CHAIN}) AS load FROM {{trace}}),
      b AS (SELECT method, load, CASE WHEN load <= 0.5 THEN 1 WHEN load <= 1.5 THEN 2 WHEN load <= 3 THEN 3 WHEN load <= 6 THEN 4 ELSE 5 END AS bin FROM l),
      g AS (SELECT m.method, v.bin FROM (SELECT DISTINCT method FROM {{trace}}) m JOIN (VALUES (1, 1), (2, 1), (3, 1), (4, 1), (5, 1)) AS v(bin, one) ON v.one = 1),
      s AS (SELECT method, avg(CASE WHEN load > 1.5 THEN 1.0E0 ELSE 0.0E0 END) AS share FROM l GROUP BY method)
      SELECT g.method, CAST(g.bin AS BIGINT) AS bin, count(b.load) AS n, round(median(b.load), 6) AS median, round(min(s.share), 6) AS share_above
      FROM g LEFT JOIN b ON b.method = g.method AND b.bin = g.bin JOIN s ON s.method = g.method GROUP BY g.method, g.bin"""


@plan("trace")
def clade_refresh(d: Dialect) -> str:
    """Presence of a statistic above 20 as a clade's: support, changes between consecutive samples, and the
    changes relative to those of independent draws, for supports between 0.05 and 0.95."""
    return f"""WITH p AS (SELECT {CHAIN}, sample, CASE WHEN value > 20 THEN 1 ELSE 0 END AS present FROM {{trace}}),
      f AS (SELECT {CHAIN}, present, CASE WHEN present <> lag(present) OVER (PARTITION BY {CHAIN} ORDER BY sample) THEN 1 ELSE 0 END AS flip FROM p),
      s AS (SELECT {CHAIN}, count(*) AS n, avg(CAST(present AS DOUBLE)) AS support, CAST(sum(flip) AS BIGINT) AS flips FROM f GROUP BY {CHAIN})
      SELECT {CHAIN}, round(support, 6) AS support, flips, round(flips / (n * 2 * support * (1 - support)), 6) AS refresh FROM s WHERE support > 0.05 AND support < 0.95"""


@plan("trace")
def running_moments(d: Dialect) -> str:
    """Values standardised by the mean and deviation of those so far, clipped at five."""
    w = f"OVER (PARTITION BY {CHAIN} ORDER BY sample ROWS UNBOUNDED PRECEDING)"
    return f"""SELECT {CHAIN}, sample, round(greatest(-5, least(5, CASE WHEN sd > 0 THEN (value - m) / sd ELSE 0.0E0 END)), 5) AS z
      FROM (SELECT {CHAIN}, sample, value, avg(value) {w} AS m, stddev_samp(value) {w} AS sd FROM {{trace}}) x"""


@plan("trace")
def batch_means(d: Dialect) -> str:
    """Mean of a chain and its standard error from ten batch means."""
    return f"""WITH t AS (SELECT {CHAIN}, value, ntile(10) OVER (PARTITION BY {CHAIN} ORDER BY sample) AS batch FROM {{trace}}),
      b AS (SELECT {CHAIN}, batch, avg(value) AS m FROM t GROUP BY {CHAIN}, batch)
      SELECT {CHAIN}, round(avg(m), 6) AS mean, round(stddev_samp(m) / sqrt(count(*)), 6) AS se FROM b GROUP BY {CHAIN}"""


@plan("trace")
def thinned(d: Dialect, step: int = 10) -> str:
    """Every step-th row of each chain."""
    return f"""SELECT {CHAIN}, sample, value FROM (SELECT {CHAIN}, sample, value, row_number() OVER (PARTITION BY {CHAIN} ORDER BY sample) - 1 AS i FROM {{trace}}) x WHERE i % {step} = 0"""


@plan("trace")
def interpolated(d: Dialect) -> str:
    """Chains interpolated linearly on a grid of 21 samples over the range that all chains of a method share."""
    return f"""WITH e AS (SELECT {CHAIN}, min(sample) AS lo, max(sample) AS hi FROM {{trace}} GROUP BY {CHAIN}),
      o AS (SELECT method, max(lo) AS lo, min(hi) AS hi FROM e GROUP BY method HAVING max(lo) < min(hi)),
      g AS (SELECT method, lo + k * (hi - lo) / 20.0E0 AS x, k FROM ({d.series("0", "20", "k", "o", "method, lo, hi")}) k),
      s AS (SELECT {CHAIN}, sample, value, lead(sample) OVER (PARTITION BY {CHAIN} ORDER BY sample) AS next_sample, lead(value) OVER (PARTITION BY {CHAIN} ORDER BY sample) AS next_value FROM {{trace}})
      SELECT s.method, s.experiment, s.seed, g.k, round(s.value + CASE WHEN s.next_sample IS NULL THEN 0 ELSE (g.x - s.sample) / (s.next_sample - s.sample) * (s.next_value - s.value) END, 6) AS value
      FROM g JOIN s ON s.method = g.method AND s.sample <= g.x AND (s.next_sample > g.x OR s.next_sample IS NULL)"""


@plan("trace")
def normal_equations(d: Dialect) -> str:
    """Sums of products for a ridge regression of the next value on a constant, the value and its square."""
    return f"""WITH t AS (SELECT {CHAIN}, value / 100 AS x, lead(value) OVER (PARTITION BY {CHAIN} ORDER BY sample) / 100 AS y FROM {{trace}})
      SELECT method, count(*) AS n, round(sum(x), 4) AS s1, round(sum(x * x), 4) AS s2, round(sum(x * x * x), 4) AS s3, round(sum(x * x * x * x), 4) AS s4,
        round(sum(y), 4) AS y0, round(sum(x * y), 4) AS y1, round(sum(x * x * y), 4) AS y2 FROM t WHERE y IS NOT NULL GROUP BY method"""


@plan("trace")
def gamma_fit(d: Dialect) -> str:
    """Shape and scale of a gamma distribution by the closed-form estimate, from the mean and the mean log."""
    s = "(ln(m) - ml)"
    return f"""SELECT method, n, round((3 - {s} + sqrt(({s} - 3) * ({s} - 3) + 24 * {s})) / (12 * {s}), 6) AS shape, round(m * 12 * {s} / (3 - {s} + sqrt(({s} - 3) * ({s} - 3) + 24 * {s})), 6) AS scale
      FROM (SELECT method, count(*) AS n, avg(value) AS m, avg(ln(value)) AS ml FROM {{trace}} WHERE value > 0 GROUP BY method) x"""


@plan("op_timing")
def operator_rollup(d: Dialect) -> str:
    """Shares, rates and times per proposal of each operator, over runs; counts of zero don't divide."""
    return """WITH s AS (SELECT operator, CAST(sum(proposals) AS BIGINT) AS n, CAST(sum(accepted) AS BIGINT) AS a, CAST(sum(direct_rejects) AS BIGINT) AS r, CAST(sum(topology_changes) AS BIGINT) AS t,
        CAST(sum(proposal_ns) AS BIGINT) AS p, CAST(sum(evaluation_ns) AS BIGINT) AS e, CAST(sum(resolution_ns) AS BIGINT) AS z FROM {op_timing} GROUP BY operator)
      SELECT operator, n, round(n / CAST(sum(n) OVER () AS DOUBLE), 6) AS share, round(a / CAST(greatest(n, 1) AS DOUBLE), 6) AS acceptance, round(r / CAST(greatest(n, 1) AS DOUBLE), 6) AS rejected,
        round(t / CAST(greatest(a, 1) AS DOUBLE), 6) AS topology, round(p / 1000.0E0 / greatest(n, 1), 6) AS proposal_us, round((p + e + z) / 1000.0E0 / greatest(n, 1), 6) AS step_us,
        round((p + e + z) / CAST(sum(p + e + z) OVER () AS DOUBLE), 6) AS time_share FROM s WHERE n > 0"""


@plan("trace", "ess", "cost")
def ess_per_cost(d: Dialect, base: str = "click") -> str:
    """What an independent sample costs. ess: of each chain after burn-in; cost: microseconds of a proposal by method.
    By method: proposals for one effective sample, deviation of the values, effective samples a minute, all as means
    over chains, and the latter relative to a base method's."""
    return f"""WITH t AS (SELECT {CHAIN}, max(sample) - min(sample) AS proposals, stddev_samp(value) AS sd FROM {{trace}} GROUP BY {CHAIN}),
      c AS (SELECT t.method, t.proposals / e.tracer AS per, t.sd, 60.0E6 / (t.proposals / e.tracer * k.us) AS a_minute FROM t
        JOIN {{ess}} e ON e.method = t.method AND e.experiment = t.experiment AND e.seed = t.seed JOIN {{cost}} k ON k.method = t.method WHERE e.tracer > 0 AND t.proposals > 0),
      m AS (SELECT method, count(*) AS chains, avg(per) AS per, avg(sd) AS sd, avg(a_minute) AS a_minute FROM c GROUP BY method)
      SELECT m.method, m.chains, round(m.per, 3) AS proposals_per_ess, round(m.sd, 6) AS sd, round(m.a_minute, 3) AS ess_per_minute, round(m.a_minute / b.a_minute, 6) AS relative FROM m LEFT JOIN m b ON b.method = '{base}'"""


@plan("op_timing")
def config_means(d: Dialect) -> str:
    """Means over runs of each configuration, in the order first seen."""
    return "SELECT operator, min(run) AS first_run, count(*) AS runs, round(avg(CAST(proposals AS DOUBLE)), 4) AS proposals, round(avg(CAST(accepted AS DOUBLE)), 4) AS accepted FROM {op_timing} GROUP BY operator"


@plan("op_timing")
def config_grid(d: Dialect) -> str:
    """Experiment configurations: each operator left out, and a four by four grid of two of its parameters."""
    return f"""WITH ops AS (SELECT DISTINCT operator FROM {{op_timing}})
      SELECT concat('without_', operator) AS name, operator AS removed, CAST(NULL AS DOUBLE) AS a, CAST(NULL AS DOUBLE) AS b FROM ops
      UNION ALL SELECT concat(o.operator, '_', CAST(x.i AS {d.text}), '_', CAST(y.i AS {d.text})), NULL, x.i * 0.25E0, y.i * 0.5E0
      FROM ops o JOIN (VALUES (1, 1), (1, 2), (1, 3), (1, 4)) AS x(one, i) ON x.one = 1 JOIN (VALUES (1, 1), (1, 2), (1, 3), (1, 4)) AS y(one, i) ON y.one = 1"""


@plan("trace")
def minutes_text(d: Dialect) -> str:
    """Minutes as text: `45min`, `2h13min`; halves round to even, negatives are zero."""
    r = "bround(greatest(value * 10, 0))" if d.spark else "round_even(greatest(value * 10, 0), 0)"
    return f"""SELECT {CHAIN}, sample, CASE WHEN m < 60 THEN concat(CAST(m AS {d.text}), 'min') ELSE concat(CAST({d.idiv("m", "60")} AS {d.text}), 'h', CAST(m % 60 AS {d.text}), 'min') END AS said
      FROM (SELECT {CHAIN}, sample, CAST({r} AS BIGINT) AS m FROM {{trace}}) x"""


@plan("trace")
def average_ranks(d: Dialect) -> str:
    """Ranks within a chain, ties at their mean, and the quantile whose normal score they get."""
    return f"""SELECT {CHAIN}, sample, r AS average_rank, round((r - 0.375E0) / (n + 0.25E0), 6) AS quantile FROM (
      SELECT {CHAIN}, sample, rank() OVER (PARTITION BY {CHAIN} ORDER BY value) + (count(*) OVER (PARTITION BY {CHAIN}, value) - 1) / 2.0E0 AS r, count(*) OVER (PARTITION BY {CHAIN}) AS n FROM {{trace}}) x"""


@plan("trace")
def remaining_time(d: Dialect) -> str:
    """Hours until two hundred at the present rate, less what is spent, from the number of rows of a chain."""
    return f"""SELECT {CHAIN}, n, round(greatest(200.0E0 / (n / (last / 60.0E0)) - last / 60.0E0, 0), 4) AS remaining FROM (SELECT {CHAIN}, count(*) AS n, max(sample) / 1000.0E0 AS last FROM {{trace}} GROUP BY {CHAIN}) x"""
