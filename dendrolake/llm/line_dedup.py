"""Line deduplication over levelled sorted runs of line hashes (DataFrame functions only).

The key of a line is the line with ASCII white space stripped at both ends and A-Z lower-cased; keys of LEAST_CHARS code
points or more count. A run is a table of keys, (h1, h2, docs, keeper), bucketed and sorted by key: how many documents have
the key and the largest doc_id among them. A batch of documents is combined by key before anything is dealt, and merge-anti-joins
the runs one after the other: what a run already has settled (in enough documents, and kept by a doc_id that the batch doesn't
exceed) adds nothing; the rest becomes the batch's own run. As batches and runs are bucketed alike, runs are never shuffled for
this. As soon as the newest FANOUT runs span equally many batches they are compacted into one, so that n batches leave at most
(FANOUT - 1) * log(n) runs and a key is rewritten log(n) times. A run is named by the batches it spans: one that a complete longer
run covers is ignored, so a compaction that was cut short does no harm, and an index kept in a folder can be opened again.

Keys in LEAST_DOCS documents or more lose their lines, but for those of the keeper. Their places are joined back to the texts.

Defined results: null and empty texts are one empty line; each row is a document, so repeated rows count each; a null doc_id is
below all others, and where only rows without one have a key, all of them keep it; lines that repeat inside a document count
once and go or stay together; an empty table gives no rows; very long texts and lines are read whole. Keys are compared by 128
bits of hash. Only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Scratch, columns, text_or_empty

LEAST_CHARS, LEAST_DOCS, BATCHES, FANOUT = 40, 5, 4, 2
BLANK = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]
SEED = 0x5EED


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def hashes(value: Column) -> Column:
    return F.struct(F.xxhash64(value).alias("h1"), F.xxhash64(F.lit(SEED), value).alias("h2"))


class Runs:
    """The index: runs in a folder all executors share."""

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None, fanout: int = FANOUT, least_docs: int = LEAST_DOCS):
        """root: where the runs are; those of an earlier session are opened again, with the number of buckets they have."""
        self.spark, self.root, self.fanout, self.least_docs = spark, root.rstrip("/"), fanout, least_docs
        path, store = self._at("")
        store.mkdirs(path)
        found = [re.fullmatch(r"b(\d+)-run-(\d+)-(\d+)", x.getPath().getName()) for x in store.listStatus(path)]
        spans = [tuple(map(int, m.groups())) for m in found if m and store.exists(self._at(f"{m[0]}/_SUCCESS")[0])]
        self.buckets = spans[0][0] if spans else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        whole = [(a, b) for _, a, b in spans]
        self.spans = sorted(x for x in whole if not any(y != x and y[0] <= x[0] and x[1] <= y[1] for y in whole))
        self.label = f"dendrolake_lines_{uuid.uuid4().hex}"
        for x in self.spans:
            self._declare(x)

    def _at(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _folder(self, span: tuple[int, int]) -> str:
        return f"b{self.buckets}-run-{span[0]:06d}-{span[1]:06d}"

    def _name(self, span: tuple[int, int]) -> str:
        return f"{self.label}_{span[0]}_{span[1]}"

    def _declare(self, span: tuple[int, int]) -> None:
        self.spark.sql(
            f"CREATE TABLE {self._name(span)} (h1 BIGINT, h2 BIGINT, docs BIGINT, keeper BIGINT) USING parquet "
            f"CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{self.root}/{self._folder(span)}'"
        )

    def _write(self, keys: DataFrame, span: tuple[int, int]) -> None:
        path, store = self._at(self._folder(span))
        store.delete(path, True)  # what is there was cut short
        writer = keys.select(*KEY, "docs", "keeper").write.bucketBy(self.buckets, *KEY).sortBy(*KEY)
        writer.format("parquet").option("path", f"{self.root}/{self._folder(span)}").saveAsTable(self._name(span))

    def _remove(self, span: tuple[int, int]) -> None:
        self.spark.sql(f"DROP TABLE {self._name(span)}")
        path, store = self._at(self._folder(span))
        store.delete(path, True)

    def run(self, span: tuple[int, int]) -> DataFrame:
        return self.spark.table(self._name(span))

    def add(self, keys: DataFrame) -> None:
        """keys: h1, h2, docs, keeper of a batch's documents, one row for each key."""
        fresh = keys
        for span in self.spans:
            settled = self.run(span).where(F.col("docs") >= self.least_docs).select(F.col("h1").alias("s1"), F.col("h2").alias("s2"), F.col("keeper").alias("s"))
            fresh = fresh.join(settled.hint("merge"), F.expr("h1 = s1 AND h2 = s2 AND s >= coalesce(keeper, s)"), "left_anti")
        nth = self.spans[-1][1] + 1 if self.spans else 0
        self._write(fresh, (nth, nth))
        self.spans.append((nth, nth))
        self._compact()

    def _compact(self) -> None:
        while len(self.spans) >= self.fanout and len({b - a for a, b in self.spans[-self.fanout:]}) == 1:
            parts = self.spans[-self.fanout:]
            span = (parts[0][0], parts[-1][1])
            self._write(self._merged(parts), span)
            self.spans[-self.fanout:] = [span]
            for x in parts:
                self._remove(x)

    def _merged(self, spans: list[tuple[int, int]]) -> DataFrame:
        """Runs as one, each key once, by merge joins: a union of bucketed tables keeps their partitioning in name only, and
        grouping it would leave a key once for each run."""
        rows = self.run(spans[0])
        for x in spans[1:]:
            other = self.run(x).toDF("o1", "o2", "more", "last").hint("merge")
            rows = rows.join(other, F.expr("h1 = o1 AND h2 = o2"), "full").selectExpr(
                "coalesce(h1, o1) AS h1", "coalesce(h2, o2) AS h2", "coalesce(docs, 0) + coalesce(more, 0) AS docs", "greatest(keeper, last) AS keeper"
            )
        return rows

    def settled(self) -> DataFrame:
        """h1, h2, keeper of the keys in enough documents."""
        empty = "h1 long, h2 long, keeper long"
        return self._merged(self.spans).where(F.col("docs") >= self.least_docs).select(*KEY, "keeper") if self.spans else self.spark.createDataFrame([], empty)

    def close(self, remove: bool = False) -> None:
        """Take the tables off the session's catalog; remove: their files too."""
        for span in self.spans:
            self.spark.sql(f"DROP TABLE {self._name(span)}")
        if remove:
            path, store = self._at("")
            store.delete(path, True)


def hashed(docs: DataFrame, least_chars: int = LEAST_CHARS, batches: int = BATCHES) -> DataFrame:
    """For each row of docs: doc_id, hashes of its text (t1, t2), its batch, the key hashes of its lines in order (null where the
    key is too short), and each of these once."""
    text = F.col("text")
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).select(
        "doc_id", hashes(text).alias("t"), F.transform(split_lines(text), line_key).alias("keys")
    )
    long_keys = F.array_distinct(F.filter("keys", lambda k: F.length(k) >= least_chars))
    return keys.select(
        "doc_id", "t.h1", "t.h2", F.transform("keys", lambda k: F.when(F.length(k) >= least_chars, hashes(k))).alias("lines"), F.transform(long_keys, hashes).alias("own"),
    ).select("doc_id", F.col("h1").alias("t1"), F.col("h2").alias("t2"), "lines", "own", F.pmod(F.xxhash64("doc_id", "h1"), F.lit(batches)).cast("int").alias("batch"))


def batch_keys(rows: DataFrame) -> DataFrame:
    """rows: of `hashed`. The keys of a batch, with their documents."""
    return rows.select("doc_id", F.explode("own").alias("k")).groupBy("k.h1", "k.h2").agg(F.count("*").alias("docs"), F.max("doc_id").alias("keeper"))


def repeated_places(rows: DataFrame, settled: DataFrame) -> DataFrame:
    """doc_id, t1, t2, places: of the documents that lose lines, the numbers of these lines."""
    each = rows.select("doc_id", "t1", "t2", F.posexplode("lines").alias("at", "k")).where("k IS NOT NULL").select("doc_id", "t1", "t2", "at", "k.h1", "k.h2")
    lost = each.join(settled, KEY).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("doc_id", "t1", "t2").agg(F.collect_set("at").alias("places"))


def drop_lines(docs: DataFrame, runs: Runs | None = None, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES, out: str = "kept") -> DataFrame:
    """docs' rows as `row` with __kept (the text without the lines that go), __n (lines before) and __gone (lines that go).
    runs: an index that is kept, to which the documents are added; what it has seen counts too."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    index = runs or Runs(spark, scratch.path("runs"), least_docs=least_docs)
    rows = scratch.cut(hashed(docs, least_chars, batches), "hashed", ("batch",))
    for k in range(batches):
        index.add(batch_keys(rows.where(F.col("batch") == k)))
    settled = scratch.cut(index.settled(), "settled")
    if runs is None:
        index.close(remove=True)
    places = repeated_places(rows, settled).select(F.col("doc_id").alias("__doc"), "t1", "t2", "places")
    whole = docs.select(F.struct(*columns(docs)).alias("row"), F.col("doc_id").cast("long").alias("__id"), text_or_empty().alias("__text")).withColumn("__t", hashes(F.col("__text")))
    joined = whole.join(places, whole["__id"].eqNullSafe(places["__doc"]) & (whole["__t.h1"] == places["t1"]) & (whole["__t.h2"] == places["t2"]), "left")
    lines = joined.select("row", "__text", "places", split_lines(F.col("__text")).alias("__lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("places"))
    kept = F.array_join(F.transform(stay, lambda i: F.get("__lines", i)), "\n")
    return lines.select(
        "row", F.when(F.col("places").isNull(), F.col("__text")).otherwise(kept).alias("__kept"), F.size("__lines").cast("long").alias("__n"),
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("__gone"),
    )


def without_repeated_lines(docs: DataFrame, runs: Runs | None = None, **settings) -> DataFrame:
    """docs with their texts rid of repeated lines, all columns."""
    return drop_lines(docs, runs, **settings).select(F.col("row").withField("text", F.col("__kept")).alias("row")).select("row.*")


def digests(docs: DataFrame) -> DataFrame:
    """The result contract."""
    slim = docs.select("doc_id", "text")
    return drop_lines(slim).select("row.doc_id", F.col("__n").alias("n_lines"), F.col("__gone").alias("n_dropped"), F.sha2("__kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, r, generate_subscripts(lines, 1) AS nth, unnest(lines) AS line FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT r) >= 5),
m AS (SELECT k.doc_id, k.r, k.nth, k.line, s.key IS NOT NULL AND k.doc_id IS DISTINCT FROM s.keeper AS gone FROM k LEFT JOIN s ON s.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id, r
"""
