"""Parsimony scores of trees without one of their tips, all tips at once, and what a tip's removal does to the score's chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import by_level
from ..plans.plan import Dialect, plan
from .sweeps import carried, upward
from .traces import ess_tracer

STATES = range(4)


def _least(prefix: str):
    return F.least(*(F.col(f"{prefix}{s}") for s in STATES))


def removal_scores(node: DataFrame, tip_state: DataFrame) -> DataFrame:
    """tree_id, node (a tip), site, score (of the whole tree), without (of the tree without this tip). Each node has the
    cost of what is below it by its state; towards the parent no state costs more than the least and one change. From the root
    down, the costs at the parent less a child's own are those of the rest of the tree, whichever way it is
    rooted, for any number of children; the score without a tip is their least."""
    bit = [F.col("mask").bitwiseAND(1 << s) != 0 for s in STATES]
    tips = tip_state.select("tree_id", "node", "site", *(F.when(bit[s], 0).otherwise(1).cast("long").alias(f"c{s}") for s in STATES), *(F.lit(None).cast("long").alias(f"d{s}") for s in STATES))

    def merge(rows: DataFrame) -> DataFrame:
        sums = rows.groupBy("tree_id", F.col("parent").alias("node"), "site").agg(*(F.sum(f"c{s}").alias(f"d{s}") for s in STATES))
        return sums.select("*", *(F.least(F.col(f"d{s}"), _least("d") + 1).alias(f"c{s}") for s in STATES))

    below = by_level(upward(node, tips, merge), "depth")
    top = below.where("depth = 0").select("tree_id", "node", "site", *(F.col(f"d{s}").alias(f"t{s}") for s in STATES), F.lit(None).cast("long").alias("without"))

    def step(upper: DataFrame, level: int) -> DataFrame:
        above = upper.select("tree_id", F.col("node").alias("parent"), "site", *(F.col(f"t{s}").alias(f"a{s}") for s in STATES))
        rest = below.where(F.col("depth") == level).join(above, ["tree_id", "parent", "site"]).select("*", *((F.col(f"a{s}") - F.col(f"c{s}")).alias(f"u{s}") for s in STATES))
        return rest.select(
            "tree_id", "node", "site", *((F.col(f"d{s}") + F.least(F.col(f"u{s}"), _least("u") + 1)).alias(f"t{s}") for s in STATES), F.when(F.col("d0").isNull(), _least("u")).alias("without")
        )

    scores = top.select("tree_id", "site", _least("t").alias("score"))
    tips_left = carried(node, top, step).where("without IS NOT NULL").select("tree_id", "node", "site", "without")
    return tips_left.join(scores, ["tree_id", "site"]).select("tree_id", "node", "site", "score", "without")


def removal_text(levels: int = 24) -> str:
    """The same for a second engine: each tip is taken out in turn, and what is left is swept by sets. Over the views node and tip_state;
    trees of at most `levels` levels."""
    parts = ["""rows AS (SELECT t.tree_id, r.node AS gone, t.node, n.parent, n.depth, t.site, CAST(t.mask AS INTEGER) AS mask, CAST(0 AS BIGINT) AS score
      FROM tip_state t JOIN node n ON n.tree_id = t.tree_id AND n.node = t.node JOIN (SELECT tree_id, node FROM node WHERE is_leaf UNION ALL SELECT DISTINCT tree_id, -1 FROM node) r ON r.tree_id = t.tree_id AND r.node <> t.node)"""]
    for level in range(levels, 0, -1):
        source = f"SELECT * FROM rows WHERE depth = {level}" + (f" UNION ALL SELECT * FROM at{level}" if level < levels else "")
        parts.append(f"""at{level - 1} AS (SELECT g.tree_id, g.gone, g.node, n.parent, n.depth, g.site, CASE WHEN common <> 0 THEN common ELSE anyone END AS mask, below + CASE WHEN common <> 0 THEN 0 ELSE 1 END AS score
          FROM (SELECT tree_id, gone, parent AS node, site, bit_and(mask) AS common, bit_or(mask) AS anyone, CAST(sum(score) AS BIGINT) AS below FROM ({source}) s GROUP BY ALL) g JOIN node n ON n.tree_id = g.tree_id AND n.node = g.node)""")
    return f"""WITH {", ".join(parts)} SELECT a.tree_id, a.gone AS node, a.site, b.score, a.score AS without FROM at0 a JOIN at0 b ON b.tree_id = a.tree_id AND b.site = a.site AND b.gone = -1 WHERE a.gone >= 0"""


@plan("removed", "sampled", "weight")
def removal_trace(d: Dialect, burnin: float = 0.1, thinning: int = 1) -> str:
    """For each run and tip the scores of its trees, in order: run, tip, sample, whole, without. removed: of removal_scores;
    sampled(tree_id, node, run, i, tip): which tip a node of a tree is, and which tree of its run that is; weight(site, weight). The first
    part of a run is left out, of the others every thinning-th tree is taken. Rounded, as sums in another order aren't a change."""
    return f"""WITH n AS (SELECT run, max(i) + 1 AS n FROM {{sampled}} GROUP BY run),
      s AS (SELECT s.run, s.tip, s.i, round(CAST(sum(r.score * w.weight) AS DOUBLE), 9) AS whole, round(CAST(sum(r.without * w.weight) AS DOUBLE), 9) AS without
        FROM {{removed}} r JOIN {{sampled}} s ON s.tree_id = r.tree_id AND s.node = r.node JOIN {{weight}} w ON w.site = r.site GROUP BY s.run, s.tip, s.i),
      x AS (SELECT s.run, s.tip, s.whole, s.without, s.i - CAST(floor({burnin!r} * n.n) AS BIGINT) AS k FROM s JOIN n ON n.run = s.run)
      SELECT run, tip, {d.idiv("k", str(thinning))} AS sample, whole, without FROM x WHERE k >= 0 AND k % {thinning} = 0"""


def tip_removal_ess(trace: DataFrame) -> DataFrame:
    """trace: of removal_trace. By run and tip: the effective sample size and the mean of the score, and without the tip; how much
    larger the size gets. A chain that doesn't change has no size. A row for each run and tip has its chain, as long as the run; many rows are read at once."""

    def sizes(batches):
        import numpy as np
        import pyarrow as pa

        def known(x: float) -> float | None:
            return None if x != x else round(x, 6)

        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            chains = [(batch[c].offsets.to_numpy(), batch[c].values.to_numpy(zero_copy_only=False)) for c in ("whole", "without")]
            for i in range(batch.num_rows):
                x, y = (values[offsets[i]: offsets[i + 1]] for offsets, values in chains)
                whole, without = ess_tracer(x), ess_tracer(y)
                for column, value in zip(out, (len(x), known(whole), known(without), known(without - whole), *(round(float(np.mean(v)), 6) for v in (x, y)))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch["run"], batch["tip"], *(pa.array(c, pa.float64() if k else pa.int64()) for k, c in enumerate(out))], names=[x.split()[0] for x in REMOVAL.split(", ")])

    rows = F.array_sort(F.collect_list(F.struct("sample", "whole", "without")))
    chains = trace.select("run", "tip", "sample", F.col("whole").cast("double").alias("whole"), F.col("without").cast("double").alias("without")).groupBy("run", "tip").agg(rows.alias("rows"))
    return chains.select(F.col("run").cast("long").alias("run"), F.col("tip").cast("long").alias("tip"), F.col("rows.whole").alias("whole"), F.col("rows.without").alias("without")).mapInArrow(sizes, REMOVAL)


REMOVAL = "run long, tip long, samples long, full_ess double, removed_ess double, ess_change double, full_mean double, removed_mean double"


def removal_ess_text(trace: str, by_lags) -> str:
    """The same for a second engine. by_lags: the text of the sizes by a join of lags, over a table."""
    def sizes(column: str) -> str:
        source = f"(SELECT CAST(run AS VARCHAR) AS method, CAST(tip AS VARCHAR) AS experiment, 0 AS seed, sample, {column} AS value FROM {trace})"
        return f"SELECT CAST(method AS BIGINT) AS run, CAST(experiment AS BIGINT) AS tip, tracer AS ess FROM ({by_lags(source)}) z"

    return f"""SELECT t.run, t.tip, t.samples, a.ess AS full_ess, b.ess AS removed_ess, b.ess - a.ess AS ess_change, t.full_mean, t.removed_mean
      FROM (SELECT run, tip, count(*) AS samples, round(avg(whole), 6) AS full_mean, round(avg(without), 6) AS removed_mean FROM {trace} GROUP BY run, tip) t
      JOIN ({sizes("whole")}) a ON a.run = t.run AND a.tip = t.tip JOIN ({sizes("without")}) b ON b.run = t.run AND b.tip = t.tip"""


@plan("sizes")
def removal_description(d: Dialect) -> str:
    """Of the sizes of each run, whole, without a tip, and by how much that changes them: count, mean, deviation, extremes and linear quartiles. sizes: of tip_removal_ess; what is null doesn't count."""
    q = "percentile(value, array(0.25, 0.5, 0.75))[CAST({0} * 4 AS INT) - 1]" if d.spark else "quantile_cont(value, {0})"
    rows = " UNION ALL ".join(f"SELECT run, '{c}' AS size, {c} AS value FROM {{sizes}}" for c in ("full_ess", "removed_ess", "ess_change"))
    return f"""SELECT run, size, count(value) AS n, round(avg(value), 5) AS mean, round(stddev_samp(value), 5) AS sd, round(min(value), 5) AS least, round({q.format(0.25)}, 5) AS q1, round({q.format(0.5)}, 5) AS q2,
      round({q.format(0.75)}, 5) AS q3, round(max(value), 5) AS most FROM ({rows}) v GROUP BY run, size"""
