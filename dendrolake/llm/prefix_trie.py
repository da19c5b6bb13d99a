"""The prefix trie of conversations, built level by level.

Conversations are first dealt into classes of equal turns: a class is one member with a weight, and its ids go into one digest,
streamed in numerical order. Then, for each depth, the classes that still share a node with another one are joined with their next turn
and grouped by (parent node, turn); a node is named by the smallest conv_id among its members. A class that is alone in its
node leaves the loop: what is below is a chain, which needs no further rounds. So there are as many rounds as the
deepest shared node has turns. Turns are written in bands of depths (1, 2-3, 4-7, ...), so that a round reads those of its band only.
Afterwards leaves and savings are rolled up by joins with the parents, from the deepest level back to the root.

Groups are combined before they are dealt, so a node that holds a third of all conversations is no hot key; the joins back to members
are plain exchanges that AQE can split. Every level is a table in the shared folder.

Defined results: turns are ordered by turn (null first), then role, then text; null role or text is empty; rows with a null conv_id are
left out, as they name no member; repeated rows are turns of their own; an empty table gives no nodes, and conversations
without any turn are members of the root only. Turns are compared by 128 bits of hash of role and text, whole texts
of any length. Only conv_id, turn, role and text are read, so other columns may have any names. The turns of one conversation
are numbered in one task, which spills.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Scratch

SEED = 0x7A1E
CLASSES = "conv_id long, n_convs long, length long, ends_sha256 string"


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, i (from one), k1, k2 (the turn's role and text as hashes), chars."""
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    # the hashes go through the sort with the text, as ties are ordered by it
    slim = rows.select("*", F.xxhash64("role", "text").alias("k1"), F.xxhash64(F.lit(SEED), "role", "text").alias("k2"), F.length("text").cast("long").alias("chars"))
    return slim.withColumn("i", F.row_number().over(order)).select("conv_id", "i", "k1", "k2", "chars")


def rebuilt(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the head of their group's first one: of conversation c the first h turns of
    c - c % group, then its own after its first h, where h = crc32(c) % most. Returns the turns (conv_id, pos, k1, k2, chars) and
    all conv_ids."""
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = sizes.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % most).alias("h"))
    heads = turns.where(F.col("i") < most).select(F.col("conv_id").alias("base"), F.col("i").alias("pos"), "k1", "k2", "chars")
    first = convs.join(heads, "base").where("pos <= h").select("conv_id", "pos", "k1", "k2", "chars")
    had = convs.join(sizes.select(F.col("conv_id").alias("base"), "n"), "base", "left").select("conv_id", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("had"))
    own = turns.join(had, "conv_id").where("i > h").select("conv_id", (F.col("had") + F.col("i") - F.col("h")).cast("int").alias("pos"), "k1", "k2", "chars")
    return first.unionByName(own), convs.select("conv_id")


def _digest_classes(batches):
    """Sorted (d1, d2, length, conv_id) -> one row for each run of equal (d1, d2, length); the ids stream through the digest."""
    import hashlib

    import numpy as np
    import pyarrow as pa

    names = [x.split()[0] for x in CLASSES.split(", ")]
    held = None

    def row():
        (_, _, length), first, n, digest = held
        return first, n, length, digest.hexdigest()

    for batch in batches:
        if not len(batch):
            continue
        d1, d2, length, conv = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        new = np.flatnonzero((d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1]) | (length[1:] != length[:-1])) + 1
        out = []
        for a, b in zip([0, *new.tolist()], [*new.tolist(), len(conv)]):
            ids = ",".join(map(str, conv[a:b].tolist())).encode()
            key = d1[a], d2[a], int(length[a])
            if held and held[0] == key:
                held[3].update(b"," + ids)
                held[2] += b - a
            else:
                if held:
                    out.append(row())
                held = [key, int(conv[a]), b - a, hashlib.sha256(ids)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=names)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row()], names=names)


def classes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Conversations of equal turns as one, named by their smallest conv_id: CLASSES."""
    place = F.struct("pos", "k1", "k2")
    digests = turns.groupBy("conv_id").agg(F.bit_xor(F.xxhash64(place)).alias("d1"), F.bit_xor(F.xxhash64(F.lit(SEED), place)).alias("d2"), F.count("*").alias("length"))
    whole = convs.join(digests, "conv_id", "left").select(*(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("d1", "d2", "length")), "conv_id")
    return whole.repartition("d1", "d2", "length").sortWithinPartitions("d1", "d2", "length", "conv_id").mapInArrow(_digest_classes, CLASSES)


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """turns: conv_id, pos (from one, without gaps), k1, k2, chars; convs: all conv_ids, those without turns too. One row for each node."""
    scratch = Scratch(turns.sparkSession, "trie")
    every = scratch.cut(classes(turns, convs), "classes")
    members = every.select("conv_id", "n_convs", "length")
    bands = turns.join(every.select("conv_id"), "conv_id").withColumn("band", F.floor(F.log2("pos")).cast("int"))
    banded = scratch.cut(bands.select("conv_id", "pos", "k1", "k2", "chars", "band"), "turns", ("band",))
    root = every.agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.count("*").alias("classes"), F.min(F.when(F.col("length") == 0, F.col("conv_id"))).alias("ended"))
    no_id, none = F.lit(None).cast("long"), F.lit(0).cast("long")
    top = scratch.cut(root.where("classes > 0").select("conv_id", no_id.alias("parent"), "n_convs", "classes", none.alias("chars"), "ended"), "levels/depth=0").first()
    live, depth = members.where("length > 0").withColumn("node", F.lit(top.conv_id if top else None).cast("long")), 0
    while not live.isEmpty():
        depth += 1
        turn = banded.where((F.col("band") == depth.bit_length() - 1) & (F.col("pos") == depth)).drop("band", "pos")
        step = live.join(turn, "conv_id").withColumnRenamed("node", "parent")
        ended = F.min(F.when(F.col("length") == depth, F.col("conv_id")))
        nodes = scratch.cut(
            step.groupBy("parent", "k1", "k2")
            .agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.count("*").alias("classes"), F.max("chars").alias("chars"), ended.alias("ended")),
            f"levels/depth={depth}",
        )
        shared = nodes.where("classes > 1").select("parent", "k1", "k2", F.col("conv_id").alias("node"))
        live = scratch.cut(step.join(shared, ["parent", "k1", "k2"]).where(F.col("length") > depth).select("conv_id", "n_convs", "length", "node"), f"live{depth}")
        scratch.drop(f"live{depth - 1}")
    spark = turns.sparkSession
    at = "conv_id long, parent long, n_convs long, classes long, chars long, ended long, depth int"
    levels = spark.read.schema(at).parquet(scratch.path("levels"))
    return _rolled_up(levels, banded, every, scratch, depth)


def _rolled_up(levels: DataFrame, turns: DataFrame, every: DataFrame, scratch: Scratch, deepest: int) -> DataFrame:
    """levels: the nodes down to those of a single class; turns: of each class. Chains in closed form, shared nodes level by level."""
    alone = levels.where("classes = 1 AND depth > 0").select("conv_id", "parent", "n_convs", F.col("depth").alias("top"))
    single = every.select("conv_id", "length", "ends_sha256")
    saved = (F.col("n_convs") - 1) * F.sum("chars").over(Window.partitionBy("conv_id").orderBy(F.desc("pos")))
    chain = turns.drop("band", "k1", "k2").join(alone.join(single, "conv_id"), "conv_id").where("pos >= top").withColumn("saved", saved)
    last = F.col("pos") == F.col("length")
    chains = scratch.cut(chain.select(
        "conv_id", F.col("pos").cast("long").alias("depth"), F.when(F.col("pos") == F.col("top"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.when(last, F.col("ends_sha256")).otherwise(F.sha2(F.lit(""), 256)).alias("ends_sha256"), (F.col("pos") == F.col("top")).alias("top"),
    ), "chains")
    tops = chains.where("top").select(F.col("parent_conv_id").alias("node"), "depth", "n_leaves", "saved_tokens")
    lower = None
    for depth in range(deepest, -1, -1):
        children = tops.where(F.col("depth") == depth + 1).drop("depth")
        if lower is not None:
            children = children.unionByName(lower.where("parent IS NOT NULL").select(F.col("parent").alias("node"), "n_leaves", "saved_tokens"))
        sums = children.groupBy("node").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
        own = levels.where((F.col("depth") == depth) & ((F.col("classes") > 1) | (F.lit(depth) == 0))).withColumnRenamed("conv_id", "node")
        lower = scratch.cut(own.join(sums, "node", "left").select(
            F.col("node").alias("conv_id"), "parent", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("chars") + F.coalesce("below", F.lit(0))).cast("long").alias("saved_tokens"), "ended",
        ), f"shared/depth={depth}")
    shared = turns.sparkSession.read.schema("conv_id long, parent long, n_convs long, n_children long, n_leaves long, saved_tokens long, ended long, depth int").parquet(scratch.path("shared"))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    shared = shared.withColumn("depth", F.col("depth").cast("long")).withColumnRenamed("parent", "parent_conv_id")
    some = shared.where("ended IS NOT NULL").join(every.select(F.col("conv_id").alias("ended"), "ends_sha256"), "ended").select(*names)
    none = shared.where("ended IS NULL").withColumn("ends_sha256", F.sha2(F.lit(""), 256)).select(*names)
    return some.unionByName(none).unionByName(chains.select(*names))


def conversation_trie(conversations: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """The result contract: the trie of the rebuilt conversations."""
    scratch = Scratch(conversations.sparkSession, "turns")
    turns = scratch.cut(numbered_turns(conversations), "turns")
    new, convs = rebuilt(turns, group, most)
    return trie(scratch.cut(new, "rebuilt"), scratch.cut(convs, "convs"))


def plain_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they are."""
    turns = Scratch(conversations.sparkSession, "turns").cut(numbered_turns(conversations).withColumnRenamed("i", "pos"), "turns")
    return trie(turns, turns.select("conv_id").distinct())


_CRC32 = """xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
  lambda crc, b: list_reduce(list_prepend(xor(crc, b), [CAST(x AS BIGINT) FOR x IN range(8)]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END), CAST(4294967295 AS BIGINT)), 4294967295)"""

ORACLE = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC32} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t) x),
r AS (SELECT c.conv_id, 0 AS part, t.i, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.i <= c.h UNION ALL SELECT c.conv_id, 1, t.i, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h),
p AS (SELECT conv_id, row_number() OVER w AS depth, length(text) AS chars, list(struct_pack(role := role, text := text)) OVER w AS path FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, i)),
m AS (SELECT conv_id, 0 AS depth, 0 AS chars, NULL AS path FROM c UNION ALL SELECT * FROM p),
n AS (SELECT conv_id, depth, chars, min(conv_id) OVER (PARTITION BY depth, path) AS node, lead(depth) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS ended FROM m),
up AS (SELECT a.*, b.node AS parent FROM n a LEFT JOIN n b ON b.conv_id = a.conv_id AND b.depth = a.depth - 1),
g AS (SELECT node, depth, min(parent) AS parent, count(*) AS n_convs, (count(*) - 1) * min(chars) AS saved, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ended), '') AS ends FROM up GROUP BY node, depth),
k AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY parent, depth),
below AS (SELECT DISTINCT a.node, a.depth, b.node AS sub, b.depth AS sub_depth FROM n a JOIN n b ON b.conv_id = a.conv_id AND b.depth >= a.depth),
s AS (SELECT b.node, b.depth, count(*) FILTER (WHERE k.node IS NULL) AS n_leaves, CAST(sum(g.saved) AS BIGINT) AS saved_tokens FROM below b JOIN g ON g.node = b.sub AND g.depth = b.sub_depth LEFT JOIN k ON k.node = b.sub AND k.depth = b.sub_depth GROUP BY b.node, b.depth)
SELECT g.node AS conv_id, CAST(g.depth AS BIGINT) AS depth, g.parent AS parent_conv_id, g.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, sha256(g.ends) AS ends_sha256
FROM g JOIN s ON s.node = g.node AND s.depth = g.depth LEFT JOIN k ON k.node = g.node AND k.depth = g.depth
"""
