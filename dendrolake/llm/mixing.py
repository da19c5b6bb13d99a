"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Every row has a 60-bit hash of its doc_id. A source whose target is q whole passes and a remainder
takes each of its rows q times, and once more the rows whose hash lies below a threshold. The
threshold is found without sorting rows: words are summed by source and 12-bit hash bucket, the
bucket in which the remainder falls is found by a running sum over at most 4096 sums, and only that
bucket is summed again by its next 12 bits, five times in all. Thresholds nest: a larger target
takes a superset.

Defined results: null text has size 0; null doc_id hashes as the empty string; a null source is a
source of its own, after all others; rows of one source with equal doc_id are taken together; an
empty table gives an empty plan and no rows; repeated rows count each, and very long texts are counted whole.
Only the named columns are read, so extra columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Scratch, columns, word_count

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
LEVELS, BITS = 5, 12


def row_hash(doc_id: str = "doc_id") -> Column:
    """60 bits, equal on every engine that has MD5."""
    digits = F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 1, 15)
    return F.conv(digits, 16, 10).cast("long")


def _keyed(docs: DataFrame, source: str = "source") -> DataFrame:
    return docs.withColumn("__no_source", F.col(source).isNull()).withColumn("__source", F.coalesce(F.col(source), F.lit("")))


KEY = ["__no_source", "__source"]


def targets(sizes: DataFrame) -> DataFrame:
    """sizes: one row per source (KEY, source_size). Adds target: shares of all words by weight, where
    no target exceeds MAX_REPEAT times its source. The common level of the unsaturated sources is
    found in closed form: sources in order of cap / weight saturate one after the other."""
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("__nth") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    everything = Window.partitionBy()
    ranked = (
        sizes.withColumn("__nth", F.row_number().over(Window.orderBy(*KEY)))
        .withColumn("__w", weight)
        .withColumn("__cap", F.col("source_size") * MAX_REPEAT)
        .withColumn("__all", F.sum("source_size").over(everything))
        .withColumn("__ratio", F.col("__cap").cast("double") / F.col("__w"))
    )
    by_ratio = Window.orderBy("__ratio", "__nth")
    level = (F.col("__all") - F.col("__before")).cast("double") / F.col("__w_left")
    return (
        ranked.withColumn("__before", F.coalesce(F.sum("__cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("__w_sum", F.sum("__w").over(everything))
        .withColumn("__w_left", F.col("__w_sum") - F.coalesce(F.sum("__w").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("__level", level)
        .withColumn("__level", F.max(F.when(F.col("__level") <= F.col("__ratio"), F.col("__level"))).over(everything))
        .withColumn("target", F.least(F.col("__cap").cast("double"), F.coalesce(F.col("__level"), F.lit(0.0)) * F.col("__w")))
        .select(*KEY, "source_size", "target")
    )


def plan(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows: KEY, size, hash. Returns one row per source: KEY, source_size, target, passes, cut_hash,
    cut_in (whether rows at the threshold itself are taken)."""
    sized = scratch.cut(rows.groupBy(*KEY).agg(F.sum("size").alias("source_size")), "sizes")
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MAX_REPEAT))).otherwise(F.lit(0))
    goals = targets(sized).withColumn("passes", whole.cast("int")).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    # prefix: the hash bits settled so far; below: words of the source with smaller prefixes
    edge = scratch.cut(goals.withColumn("prefix", F.lit(0).cast("long")).withColumn("below", F.lit(0).cast("long")).withColumn("here", F.col("source_size")), "edge0")
    for level in range(1, LEVELS + 1):
        left = BITS * (LEVELS - level)
        settled = edge.drop("here").withColumnRenamed("below", "__base")
        inside = rows.join(settled, KEY).where(F.shiftright("hash", left + BITS) == F.col("prefix"))
        sums = inside.groupBy(*KEY, F.shiftright("hash", left).alias("bucket")).agg(
            F.sum("size").alias("here"), *(F.first(c).alias(c) for c in ("source_size", "target", "passes", "rest", "__base"))
        )
        running = F.col("__base") + F.sum("here").over(Window.partitionBy(*KEY).orderBy("bucket"))
        found = (
            sums.withColumn("__upto", running)
            .withColumn("below", F.col("__upto") - F.col("here"))
            .where((F.col("below") <= F.col("rest")) & ((F.col("rest") < F.col("__upto"))))
            .select(*KEY, "source_size", "target", "passes", "rest", F.col("bucket").alias("prefix"), "below", "here")
        )
        edge = scratch.cut(found, f"edge{level}")
    nearer = (F.col("below") + F.col("here") - F.col("rest")) <= (F.col("rest") - F.col("below"))
    cuts = edge.select(*KEY, F.col("prefix").alias("cut_hash"), (nearer & (F.col("passes") < MAX_REPEAT)).alias("cut_in"))
    # a source of no words has no edge: nothing to take
    return scratch.cut(
        goals.join(cuts, KEY, "left").select(*KEY, "source_size", "target", "passes", F.coalesce("cut_hash", F.lit(-1)).alias("cut_hash"), F.coalesce("cut_in", F.lit(False)).alias("cut_in")),
        "plan",
    )


def copies() -> Column:
    once_more = (F.col("__hash") < F.col("cut_hash")) | ((F.col("__hash") == F.col("cut_hash")) & F.col("cut_in"))
    return F.col("passes") + F.when(once_more & (F.col("passes") < MAX_REPEAT), 1).otherwise(0)


def sized_rows(docs: DataFrame) -> DataFrame:
    return _keyed(docs.select("doc_id", "source", word_count().alias("size"))).select("doc_id", *KEY, "size", row_hash().alias("hash"))


def mix(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken."""
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.cut(sized_rows(docs), "rows")
    return (
        rows.withColumnRenamed("hash", "__hash")
        .join(plan(rows, scratch), KEY)
        .select("doc_id", "size", "source_size", "target", (F.col("size") * copies()).cast("long").alias("taken"))
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mixture itself: each row of docs, with all its columns, as often as the mix takes it."""
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.cut(sized_rows(docs), "rows")
    whole = docs.select(F.struct(*columns(docs)).alias("row"), "source", row_hash().alias("__hash"))
    return (
        _keyed(whole).join(plan(rows, scratch), KEY)
        .withColumn("__copies", copies())
        .where("__copies > 0")
        .withColumn("__nth", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
        .select("row.*")
    )


ORACLE = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY (source IS NULL), source) AS nth FROM s),
w AS (SELECT *, CASE (nth - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, source_size * 3 AS cap FROM r),
x AS (SELECT *, cap::DOUBLE / w AS ratio, sum(source_size) OVER ()::BIGINT AS total, sum(w) OVER ()::BIGINT AS w_sum FROM w),
y AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)::DOUBLE
        / (w_sum - coalesce(sum(w) OVER (ORDER BY ratio, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT) AS lv FROM x),
z AS (SELECT *, max(CASE WHEN lv <= ratio THEN lv END) OVER () AS level FROM y),
g AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(level, 0.0) * w) AS target FROM z),
q AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::INT AS passes FROM g),
p AS (SELECT *, target - passes * source_size AS rest FROM q),
a AS (SELECT source, h, sum(size)::BIGINT AS here FROM d GROUP BY source, h),
b AS (SELECT source, h, here, sum(here) OVER (PARTITION BY source ORDER BY h)::BIGINT - here AS below FROM a)
SELECT d.doc_id, d.size, p.source_size, p.target,
  (d.size * (p.passes + CASE WHEN p.passes < 3 AND (b.below + b.here <= p.rest
     OR (b.below <= p.rest AND b.below + b.here - p.rest <= p.rest - b.below)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
JOIN b ON d.source IS NOT DISTINCT FROM b.source AND d.h = b.h
"""
