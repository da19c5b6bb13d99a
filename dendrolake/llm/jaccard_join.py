"""N-gram Jaccard self-join by chosen paths.

A text is its set of five-word shingles. Texts with equal sets are joined first, by a digest of the set;
what follows is about distinct sets. Each set is embedded as T coordinates, one-permutation min-hashes with
optimal densification, that two sets share with probability equal to their similarity. A node of the
recursion holds sets; it samples SPLIT coordinates by a hash of its path, and a set goes to one child for
each of them, named by its value there. Small nodes are compared by brute force. A large node whose sets
mostly agree on the sampled coordinates (a group of near copies) is compared as well, in blocks of bounded
size, as splitting wouldn't part it; other large nodes are split again. Independent runs are repeated until
a pair at the threshold meets with the target probability at any depth.

Inside a node, sketches rule out pairs far below the threshold, and the exact intersection of shingle
sets decides, so no link is wrong. A pair that meets in several nodes counts in the smallest common one
only, which both members' node lists tell. Classes are the connected components of all links.

Defined results: null and empty texts (no words) link with nothing; a text of one to four words is one
shingle; words are split at ASCII white space. Rows are compared whatever their doc_id: repeated rows are
further copies, linked with each other, and rows with a null doc_id link like others; class_id is the smallest
doc_id of the class that isn't null. In a class without any doc_id all rows are kept, as nothing tells them
apart; of rows that share a doc_id all are kept where it is the smallest. Very long texts are one set each,
whose shingles a task holds whole. An empty table gives no rows. Only doc_id and text are read, so other
columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._blocks import deal, local_labels, runs
from ._shared import Scratch, text_or_empty
from .components import components

THRESHOLD, RECALL = 0.8, 0.999
T, SPLIT = 64, 2
LIMIT, MAX_DEPTH = 256, 10
DENSE = 0.7
MARGIN = 0.2  # of the estimate from T coordinates: four standard deviations
BLOCK_SETS, BLOCK_SHINGLES = 512, 400_000
SKETCH = "rid long, doc_id long, mark string, n int, k1 long, k2 long, sketch binary"


def runs_needed(threshold: float, recall: float) -> int:
    """Runs after which a pair at the threshold has met with probability `recall`, however deep."""
    from math import ceil, log

    meets = 1.0
    for _ in range(200):
        meets = 1 - (1 - threshold * meets) ** SPLIT
    return ceil(log(1 - recall) / log(1 - meets))


def sketch(hashes):
    """hashes: a sorted set. T min-hashes, one of each T-th of the range; an empty part takes the value of
    the first part with one in an order of its own."""
    import numpy as np

    from ._shingles import mix

    order = _borrow()
    edges = np.searchsorted(hashes, np.arange(T, dtype=np.uint64) << np.uint64(58))
    full = np.diff(edges, append=len(hashes)) > 0
    values = mix(hashes[np.minimum(edges, len(hashes) - 1)]).astype(np.uint32)
    return values[order[np.arange(T), full[order].argmax(1)]]


def _borrow():
    import numpy as np

    global _ORDER
    if _ORDER is None:
        rng = np.random.default_rng(5)
        _ORDER = np.array([[i, *(x for x in rng.permutation(T) if x != i)] for i in range(T)])
    return _ORDER


_ORDER = None


def _sets(batch):
    import numpy as np

    from ._shingles import shingle_hashes, word_hashes

    hashes, each = shingle_hashes(*word_hashes(batch.column(batch.schema.get_field_index("text"))))
    at = 0
    for n in each.tolist():
        x = np.sort(hashes[at: at + n])
        if n > 1:
            new = np.ones(n, bool)
            new[1:] = x[1:] != x[:-1]
            x = x[new]
        yield x
        at += n


def _sketches(batches):
    from hashlib import blake2b

    import numpy as np
    import pyarrow as pa

    from ._shingles import slices

    for whole in batches:
        for batch in slices(whole, "text"):
            n, k1, k2, out = [], [], [], []
            for x in _sets(batch):
                digest = np.frombuffer(blake2b(x.tobytes(), digest_size=16).digest(), np.int64)
                n.append(len(x)), k1.append(digest[0]), k2.append(digest[1])
                out.append(sketch(x).tobytes() if len(x) else None)
            yield pa.record_batch([batch.column("rid"), batch.column("doc_id"), batch.column("mark"), pa.array(n, pa.int32()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(out, pa.binary())], names=["rid", "doc_id", "mark", "n", "k1", "k2", "sketch"])


def _shingle_sets(batches):
    import pyarrow as pa

    from ._shingles import slices

    for whole in batches:
        for batch in slices(whole, "text"):
            yield pa.record_batch([batch.column("rep"), pa.array([x.tobytes() for x in _sets(batch)], pa.binary())], names=["rep", "shingles"])


def _children(batches):
    """(node, rep, sketch) -> (parent, node, rep), one row for each coordinate that the node samples."""
    import numpy as np
    import pyarrow as pa

    from ._shingles import mix

    for batch in batches:
        if not len(batch):
            continue
        node = batch.column("node").to_numpy().view(np.uint64)
        values = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(-1, T).astype(np.uint64)
        rows = np.arange(len(node))
        out = []
        with np.errstate(over="ignore"):
            first = mix(node * np.uint64(3) + np.uint64(1)) % np.uint64(T)
            step = mix(node * np.uint64(5) + np.uint64(2)) % np.uint64(T - 1) + np.uint64(1)
            for j in range(SPLIT):  # distinct coordinates, as T - 1 steps never come round
                at = (first + np.uint64(j) * step) % np.uint64(T)
                out.append(mix(mix(node + at * np.uint64(0x9E3779B97F4A7C15)) ^ (values[rows, at.astype(np.int64)] + np.uint64(1))))
        yield pa.record_batch(
            [pa.array(np.tile(node.view(np.int64), SPLIT)), pa.array(np.concatenate(out).view(np.int64)), pa.array(np.tile(batch.column("rep").to_numpy(), SPLIT))],
            names=["parent", "node", "rep"],
        )


def _pairs(t, threshold: float):
    """Candidate pairs of a block: sketches near enough, and this node the first that both share."""
    import numpy as np

    node, lo, hi = t["node"][0].as_py(), t["__lo"][0].as_py(), t["__hi"][0].as_py()
    part, n = t["__own"].to_numpy(), t["n"].to_numpy().astype(np.int64)
    s = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint32).reshape(-1, T)
    a, b = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
    least = (threshold - MARGIN) * T
    found = []
    nodes = t["nodes"].to_pylist()
    index: dict[int, list[int]] = {}
    for i, own in enumerate(nodes):
        for x in own:
            if x < node:
                index.setdefault(x, []).append(i)
    column = {x: k for k, x in enumerate(x for x, rows in index.items() if len(rows) > 1)}
    before = np.zeros((len(part), max(1, len(column))), np.float32)
    for x, k in column.items():
        before[index[x], k] = 1
    for p in range(0, len(a), 64):
        rows = a[p: p + 64]
        agree = np.zeros((len(rows), len(b)), np.uint8)
        for k in range(T):
            agree += s[rows, k][:, None] == s[b, k][None, :]
        near = (agree >= least) & (np.minimum(n[rows][:, None], n[b][None]) >= threshold * np.maximum(n[rows][:, None], n[b][None]) - 1e-9)
        near &= before[rows] @ before[b].T == 0
        if lo == hi:
            near &= rows[:, None] < b[None]
        i, j = near.nonzero()
        found.append((rows[i], b[j]))
    return tuple(map(np.concatenate, zip(*found))) if found else (a[:0], a[:0])


def _candidates(threshold: float):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for t in runs(batches, ["node", "__lo", "__hi"]):
            if len(t) > 1 and len((p := _pairs(t, threshold))[0]):
                some = np.unique(np.concatenate(p))
                k = len(some)
                yield pa.record_batch(
                    [pa.array([t["node"][0].as_py()] * k, pa.int64()), pa.array([t["__lo"][0].as_py()] * k, pa.int32()), pa.array([t["__hi"][0].as_py()] * k, pa.int32()), pa.array(t["__own"].to_numpy()[some], pa.int32()), pa.array(t["rep"].to_numpy()[some])],
                    names=["node", "__lo", "__hi", "__own", "rep"],
                )

    return run


def common(sets: list, i, j):
    """Sizes of the intersections of sets[i] and sets[j], pair by pair."""
    import numpy as np

    if len(i) < 4 * len(sets):
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist())], np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, word, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[word] > 1
    owner, word = owner[shared], word[shared]
    _, word = np.unique(word, return_inverse=True)
    total, width = np.zeros((len(sets), len(sets)), np.float32), 8192
    order = np.argsort(word, kind="stable")
    owner, word = owner[order], word[order]
    for at in range(0, int(word[-1]) + 1 if len(word) else 0, width):
        p, q = np.searchsorted(word, [at, at + width])
        here = np.zeros((len(sets), width), np.float32)
        here[owner[p:q], word[p:q] - at] = 1
        total += here @ here.T
    return np.rint(total[i, j]).astype(np.int64)


def _verify(threshold: float):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for t in runs(batches, ["node", "__lo", "__hi"]):
            i, j = _pairs(t, threshold) if len(t) > 1 else ((), ())
            if not len(i):
                continue
            sets = [np.frombuffer(x, np.uint64) for x in t["shingles"].to_pylist()]
            n, both = t["n"].to_numpy().astype(np.int64), common(sets, i, j)
            link = both >= threshold * (n[i] + n[j] - both) - 1e-9
            i, j = i[link], j[link]
            if not len(i):
                continue
            rep, copies = t["rep"].to_numpy(), t["copies"].to_numpy()
            links = np.zeros(len(rep), np.int64)
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            label = local_labels(i, j, len(rep))
            least = np.full(len(rep), np.iinfo(np.int64).max)
            np.minimum.at(least, label, rep)
            some = links > 0
            yield pa.record_batch([pa.array(rep[some]), pa.array(least[label][some]), pa.array(links[some])], names=["rep", "near", "links"])

    return run


def leaves(reps: DataFrame, scratch: Scratch, threshold: float, recall: float) -> DataFrame:
    """The nodes to compare by brute force: node, rep, m (sets in the node)."""
    roots = F.explode(F.array(*(F.lit(1_000_003 * (r + 1)).cast("long") for r in range(runs_needed(threshold, recall)))))
    source = reps.select(roots.alias("node"), "rep", "sketch")
    done = None
    for depth in range(1, MAX_DEPTH + 1):
        rows = scratch.cut(source.mapInArrow(_children, "parent long, node long, rep long"), f"split{depth}")
        sizes = rows.groupBy("parent", "node").agg(F.count("*").alias("m"))
        if depth > 1:
            # how often two sets of the parent agree on a sampled coordinate
            agree = sizes.groupBy("parent").agg((F.sum(F.col("m") * F.col("m")) / (F.sum("m") * F.sum("m") / SPLIT)).alias("agree"))
            dense = agree.where(F.col("agree") >= DENSE).select(F.col("parent").alias("node"))
            done = done.unionByName(big.join(dense, "node"))
            sizes = sizes.join(dense.withColumnRenamed("node", "parent"), "parent", "left_anti")
        sizes = scratch.cut(sizes.where("m > 1").groupBy("node").agg(F.sum("m").alias("m")), f"sizes{depth}")
        small = rows.select("node", "rep").join(sizes if depth == MAX_DEPTH else sizes.where(F.col("m") <= LIMIT), "node")
        done = small if done is None else done.unionByName(small)
        if depth == MAX_DEPTH or not sizes.where(F.col("m") > LIMIT).limit(1).count():
            return done
        big = scratch.cut(rows.select("node", "rep").join(sizes.where(F.col("m") > LIMIT), "node"), f"big{depth}")
        source = big.select("node", "rep").join(reps.select("rep", "sketch"), "rep").select("node", "rep", "sketch")


def _mark() -> Column:
    """What tells rows without a doc_id apart: their text."""
    return F.when(F.col("doc_id").isNull(), F.sha2(text_or_empty(), 256))


def classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per row of docs: doc_id, class_id (smallest doc_id of its class), n_links, kept."""
    return _classes(docs, threshold, recall).drop("mark")


def _classes(docs: DataFrame, threshold: float, recall: float) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "jaccard")
    # rows are numbered once, as doc_id may be null or repeat; a set is named by the row of its smallest doc_id
    texts = scratch.cut(docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), _mark().alias("mark"), text_or_empty().alias("text")), "texts")
    base = scratch.cut(texts.mapInArrow(_sketches, SKETCH), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    sets = base.where("n > 0").groupBy("k1", "k2").agg(first.alias("at"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    reps = scratch.cut(sets.select("k1", "k2", F.col("at.rid").alias("rep"), F.col("at.doc_id").alias("least"), "copies", "n", "sketch"), "reps")
    places = scratch.cut(leaves(reps, scratch, threshold, recall), "leaves")
    nodes = places.groupBy("rep").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    facts = scratch.cut(reps.join(nodes, "rep").select("rep", "copies", "n", "sketch", "nodes"), "facts")
    weights = places.join(facts.select("rep", "n"), "rep").groupBy("node").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("__chunks")
    )
    block = ["node", "__lo", "__hi"]
    dealt = deal(places.select("node", "rep").join(weights, "node").join(facts, "rep"), F.col("__chunks"), "rep")
    near = scratch.cut(
        dealt.select(*block, "__own", "rep", "n", "sketch", "nodes").repartition(*block).sortWithinPartitions(*block)
        .mapInArrow(_candidates(threshold), "node long, __lo int, __hi int, __own int, rep long"),
        "near",
    )
    wanted = near.select("rep").distinct()
    found = texts.select(F.col("rid").alias("rep"), "text").join(wanted, "rep", "left_semi").mapInArrow(_shingle_sets, "rep long, shingles binary")
    links = scratch.cut(
        near.join(facts, "rep").join(found, "rep")
        .select(*block, "__own", "rep", "copies", "n", "sketch", "nodes", "shingles").repartition(*block).sortWithinPartitions(*block)
        .mapInArrow(_verify(threshold), "rep long, near long, links long"),
        "links",
    )
    group = components(links.where("rep != near").select(F.col("rep").alias("u"), F.col("near").alias("v")), scratch)
    linked = links.groupBy("rep").agg(F.sum("links").alias("links"))
    merged = scratch.cut(
        reps.select("k1", "k2", "rep", "least", "copies").join(linked, "rep", "left").join(group.withColumnRenamed("node", "rep"), "rep", "left")
        .select("k1", "k2", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")),
        "merged",
    )
    ids = scratch.cut(merged.groupBy("component").agg(F.min("least").alias("class_id")), "ids")
    named = scratch.cut(merged.join(ids, "component").select("k1", "k2", "class_id", "n_links"), "named")
    scratch.drop("texts", "reps", "facts", "near", "links", "leaves", "merged", "ids")
    out = base.where("n > 0").select("doc_id", "mark", "k1", "k2").join(named, ["k1", "k2"]).select("doc_id", "mark", "class_id", "n_links")
    alone = base.where("n = 0").select("doc_id", "mark", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each class, all columns."""
    stay = _classes(docs, THRESHOLD, RECALL).where("kept").select(F.col("doc_id").alias("__stay"), F.col("mark").alias("__mark")).distinct()
    known = docs.join(stay.where("__stay IS NOT NULL"), docs["doc_id"].cast("long") == stay["__stay"], "left_semi")
    unknown = docs.where(F.col("doc_id").isNull()).join(stay.where("__stay IS NULL"), _mark() == stay["__mark"], "left_semi")
    return known.unionByName(unknown)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN c a ON a.doc_id = x JOIN c b ON b.doc_id = y WHERE k >= 0.8 * (a.n + b.n - k)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
m AS (SELECT x AS doc_id, min(y) AS class_id FROM r GROUP BY x)
SELECT m.doc_id, m.class_id, (SELECT count(*) FROM l WHERE l.x = m.doc_id) AS n_links, m.doc_id = m.class_id AS kept FROM m
"""
