"""Draws from densities on an interval whose logarithm is quadratic, or a falling line and the integral of a piecewise linear slope: by rejection, so exact. Draws are
hashes of a row's seed and the number of the attempt, so they depend on neither order nor batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECES = 100_000  # of one row's interval; raises beyond


def _uniforms(seeds, attempt: int, which: int):
    """Numbers in (0, 1), one for each seed: its bits mixed with the attempt's number."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = seeds + np.uint64(0x9E3779B97F4A7C15) * np.uint64(2 * attempt + which + 1)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


def exponential_between(u, rate, width):
    """Draws in [0, width] by inversion, of a density that falls at a rate; a negative one rises."""
    import numpy as np

    flat = np.abs(rate * width) < 1e-12
    safe = np.where(flat, 1.0, np.abs(rate))
    y = -np.log1p(u * np.expm1(-safe * width)) / safe
    return np.clip(np.where(flat, u * width, np.where(rate < 0, width - y, y)), 0.0, width)


def gaussian_between(a, b, lower, upper, seeds):
    """Draws in [lower, upper] of the density that goes as exp(-a x - b x**2), b above zero: a normal one in an interval. Its tail from the point that is nearest to the mode
    is under an exponential (Robert 1995); an interval that holds the mode is first decided between its sides, by their mass."""
    import numpy as np
    from math import erf

    a, b, lower, upper = (np.asarray(x, float) for x in (a, b, lower, upper))
    if (b <= 0).any() or (upper < lower).any():
        raise ValueError("b must be above zero, and intervals must have ends in order")
    unit, mode = 1 / np.sqrt(2 * b), -a / (2 * b)
    inside = (mode > lower) & (mode < upper)
    mass = [np.array([erf(x / 2**0.5) for x in np.where(inside, np.abs(end - mode), 0.0) / unit]) for end in (lower, upper)]
    down = np.where(inside, _uniforms(seeds, 0, 0) * (mass[0] + mass[1]) < mass[0], mode >= upper)
    near = np.where(inside, mode, np.where(down, upper, lower))
    width = np.where(down, near - lower, upper - near) / unit
    start = np.abs(near - mode) / unit
    rate = (start + np.sqrt(start**2 + 4)) / 2
    out, todo, attempt = np.zeros(len(a)), np.arange(len(a)), 1
    while len(todo):
        y = exponential_between(_uniforms(seeds[todo], attempt, 0), rate[todo], width[todo])
        good = np.log(_uniforms(seeds[todo], attempt, 1)) < -0.5 * (start[todo] + y - rate[todo]) ** 2
        out[todo[good]] = y[good]
        todo, attempt = todo[~good], attempt + 1
    return np.clip(near + np.where(down, -1, 1) * out * unit, lower, upper)


def _pieces(decay: float, lower: float, upper: float, knots):
    """(start, width, exponent at the start, rate of the exponential bound, curvature, log of its mass) of parts of an interval that hold no knot and bend so little that at least
    six of ten draws are kept."""
    import numpy as np

    x, slope = knots
    ends = np.unique(np.concatenate([[lower, upper], x[(x > lower) & (x < upper)]]))
    s = np.interp(ends, x, slope)
    bend = np.diff(s) / np.diff(ends)
    parts = np.maximum(1, np.ceil(np.diff(ends) * np.sqrt(np.abs(bend)) / 2)).astype(int)
    if parts.sum() > PIECES:
        raise ValueError("the slope changes too much over the interval")
    cuts = np.concatenate([np.linspace(p, q, n, endpoint=False) for p, q, n in zip(ends, ends[1:], parts)] + [[upper]])
    width, curve = np.diff(cuts), np.repeat(bend, parts)
    tilt = np.interp(cuts, x, slope) - decay
    rise = width * (tilt[:-1] + tilt[1:]) / 2
    level = np.concatenate([[0.0], np.cumsum(rise)])
    rate = -rise / width
    lift = np.maximum(0.0, -curve * width**2 / 8)
    steep = np.abs(rise)
    mean = np.where(steep < 1e-9, 0.0, np.log(-np.expm1(-np.maximum(steep, 1e-9)) / np.maximum(steep, 1e-9)))
    return cuts[:-1], width, rate, curve, np.maximum(level[:-1], level[1:]) + lift + np.log(width) + mean


def sloped_between(decay: float, lower: float, upper: float, knots, seed):
    """A draw in [lower, upper] of the density whose logarithm falls at a rate and rises by the integral of a slope, linear between knots and constant outside. A line through the ends of
    a part bounds what bends up, the tangent at its middle what bends down."""
    import numpy as np

    if upper <= lower:
        return lower
    start, width, rate, curve, mass = _pieces(decay, lower, upper, knots)
    upto, seeds, attempt = np.cumsum(np.exp(mass - mass.max())), np.array([seed], np.uint64), 0
    while True:
        k = min(int(np.searchsorted(upto, _uniforms(seeds, 3 * attempt, 0)[0] * upto[-1], "right")), len(start) - 1)
        y = float(exponential_between(_uniforms(seeds, 3 * attempt + 1, 0), rate[k: k + 1], width[k: k + 1])[0])
        below = curve[k] * (y - width[k] / 2) ** 2 / 2 if curve[k] < 0 else -curve[k] * y * (width[k] - y) / 2
        if np.log(_uniforms(seeds, 3 * attempt + 2, 0)[0]) < below:
            return float(min(max(start[k] + y, lower), upper))
        attempt += 1


def _seed(seed: int, keys: Sequence[str]) -> Column:
    return F.xxhash64(F.lit(seed), *keys).alias("__seed")


def sample_gaussian(rows: DataFrame, keys: Sequence[str], seed: int = 1) -> DataFrame:
    """rows(keys, a, b, lower, upper) -> keys, x, in Arrow batches."""
    def run(frames):
        import numpy as np

        for f in frames:
            seeds = f["__seed"].to_numpy(np.int64).view(np.uint64)
            yield f[list(keys)].assign(x=gaussian_between(f["a"], f["b"], f["lower"], f["upper"], seeds))

    return rows.select(*keys, "a", "b", "lower", "upper", _seed(seed, keys)).mapInPandas(run, _with(rows, keys))


def sample_sloped(rows: DataFrame, keys: Sequence[str], slopes: Sequence[tuple[float, float]], seed: int = 1) -> DataFrame:
    """rows(keys, decay, lower, upper) -> keys, x. slopes: (height, slope) of knots, heights growing."""
    def run(frames):
        import numpy as np

        knots = tuple(np.array(c, float) for c in zip(*slopes))
        for f in frames:
            seeds = f["__seed"].to_numpy(np.int64).view(np.uint64)
            yield f[list(keys)].assign(x=[sloped_between(d, lo, hi, knots, s) for d, lo, hi, s in zip(f["decay"], f["lower"], f["upper"], seeds)])

    return rows.select(*keys, "decay", "lower", "upper", _seed(seed, keys)).mapInPandas(run, _with(rows, keys))


def _with(rows: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys] + ["x double"])
