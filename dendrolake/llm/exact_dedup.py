"""Exact deduplication as a stateful stream.

The documents, with white space normalised and a SHA-256 digest, are written to a content store, and arrive in
WAVES parts (a hash share of the rows each), every part a micro-batch of one stream. A task combines its rows by
digest before they are dealt by digest to keyed state held by RocksDB, without expiry: the digest, the identifier
and content locator (wave and file of the store) of the row that came first, and how many rows it has stood for.
State files go to the shared checkpoint.

A digest is only a hint. In each micro-batch the rows whose digest the state has seen more than once are held, byte
by byte, against the text that the state's locator and identifier name, whichever wave it came in (which reads
the waves before once more for each wave, so a few large ones are best); a row that differs (a collision of digests) is grouped by its full text instead. Joins on the digest are plain equi-joins,
which AQE splits where one digest holds many rows. What is equal to the first row of its digest is a group; the
smallest doc_id of the group stays.

Defined results: null text counts as empty; texts are equal when identical after each run of ASCII white
space is replaced by one space; of rows with equal text and doc_id, all have kept = true if theirs is the
smallest; null doc_ids sort after all others and a group of nulls only has a null keep_id; very long texts are
compared whole; an empty table gives no rows. Only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import SPACE, Scratch, columns, text_or_empty

STREAM_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
WAVES = 2
STORE = "doc_id long, text string, digest binary, sha binary, wave int"
JUDGED = "doc_id long, digest binary, sha binary, same boolean, other string"


def file_name() -> Column:
    return F.substring_index("_metadata.file_path", "/", -1)


def check_hits(store: DataFrame, wave: int, seen: DataFrame, scratch: Scratch) -> DataFrame:
    """store: rows that have arrived, with their file; seen: digest, first (wave, doc_id, file), seen, of the digests
    in this wave. Returns JUDGED for the rows of this wave: whether each has the bytes of its digest's first row."""
    arrived = store.where(F.col("wave") == wave)
    hits = scratch.cut(seen.where("seen > 1").select("digest", "first"), f"hits{wave}")
    mine = scratch.cut(arrived.join(hits.hint("merge"), "digest"), f"mine{wave}")
    named = "wave = first.wave AND file = first.file AND doc_id <=> first.doc_id"
    older = store.where(F.col("wave") < wave).join(hits.where(F.col("first.wave") < wave).hint("merge"), "digest")
    # written first, so that both sides of the join are plain exchanges that AQE can split
    texts = scratch.cut(mine.where(named).unionByName(older.where(named)).groupBy("digest").agg(F.min("text").alias("first_text")), f"texts{wave}")
    differs = F.col("text") != F.col("first_text")
    checked = mine.join(texts, "digest").select("doc_id", "digest", "sha", (~differs).alias("same"), F.when(differs, F.col("text")).alias("other"))
    single = arrived.select("doc_id", "digest", "sha").join(hits.select("digest"), "digest", "left_anti")
    return checked.unionByName(single.select("doc_id", "digest", "sha", F.lit(True).alias("same"), F.lit(None).cast("string").alias("other")))


def judge_stream(spark: SparkSession, scratch: Scratch, waves: int) -> DataFrame:
    """Let the waves of the staged store arrive one after the other; one row of JUDGED for each row."""
    path = scratch.path("store")
    scratch.make("store")
    spark.createDataFrame([], JUDGED).write.parquet(f"{scratch.path('judged')}/batch=-1")
    rows = spark.readStream.schema(STORE).parquet(path).select("digest", F.struct("wave", F.col("doc_id").isNull().alias("none"), "doc_id", file_name().alias("file")).alias("at"))
    states = rows.groupBy("digest").agg(F.min("at").alias("first"), F.count("*").alias("seen"))

    def check(wave: int):
        def run(changed: DataFrame, batch: int) -> None:
            seen = scratch.cut(changed.select("digest", "first", "seen"), f"seen{wave}")
            store = spark.read.schema(STORE).parquet(path).withColumn("file", file_name())
            check_hits(store, wave, seen, scratch).write.mode("overwrite").parquet(f"{scratch.path('judged')}/batch={batch}")
            scratch.drop(*(f"{x}{wave}" for x in ("seen", "hits", "mine", "texts")))

        return run

    held = {k: spark.conf.get(k, None) for k in STREAM_CONF}
    for k, v in STREAM_CONF.items():
        spark.conf.set(k, v)
    try:
        for wave in range(waves):
            if scratch.move(f"staged/wave={wave}", f"store/wave={wave}"):
                stream = states.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", scratch.path("stream"))
                stream.foreachBatch(check(wave)).start().awaitTermination()
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    scratch.drop("stream", "store", "staged")
    return spark.read.schema(JUDGED).parquet(scratch.path("judged"))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256, waves: int = WAVES) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256. digest: of the normalised text;
    any will do, as equal digests are only a hint. waves: micro-batches in which the rows arrive."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "dedup")
    text = F.regexp_replace(text_or_empty(), SPACE, " ")
    normal = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    wave = F.pmod(F.xxhash64("doc_id"), F.lit(waves)).cast("int")
    scratch.cut(normal.select("doc_id", "text", digest(F.col("text")).alias("digest"), sha256(F.col("text")).alias("sha"), wave.alias("wave")), "staged", ("wave",))
    judged = judge_stream(spark, scratch, waves)
    same = judged.where("same").select("doc_id", "digest", "sha")
    groups = scratch.cut(same.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    collided = judged.where("not same")
    others = collided.groupBy("digest", "other").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return (
        same.join(groups, "digest").select("doc_id", "keep_id", "group_size", "sha")
        .unionByName(collided.join(others, ["digest", "other"]).select("doc_id", "keep_id", "group_size", "sha"))
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    )


def unique_documents(docs: DataFrame) -> DataFrame:
    """docs without the copies, all columns. Of rows that repeat both text and doc_id one stays."""
    spark = docs.sparkSession
    kept = Scratch(spark, "dedup").cut(dedup(docs).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__digest")), "kept")
    ids = kept.select("__id").distinct()
    out = docs.join(ids, docs["doc_id"].cast("long").eqNullSafe(ids["__id"]), "left_semi")
    if kept.count() == ids.count():
        return out
    # a doc_id with several rows: keep those whose own text stays, once each
    digest = F.sha2(F.regexp_replace(text_or_empty(), SPACE, " "), 256)
    mine = out.select(F.struct(*columns(out)).alias("row"), F.col("doc_id").cast("long").alias("__id"), digest.alias("__digest"))
    once = mine.dropDuplicates(["__id", "__digest"])
    stay = kept.distinct()
    return once.join(stay, once["__id"].eqNullSafe(stay["__id"]) & (once["__digest"] == stay["__digest"]), "left_semi").select("row.*")


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n
"""
