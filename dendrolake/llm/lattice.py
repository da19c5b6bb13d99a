"""Near-duplicate embeddings by E8 lattice hashing.

Vectors are scaled to length one. Each of several tables projects them to eight dimensions by a random
Gaussian matrix and decodes the projection to the nearest point of the lattice E8: that point is the
vector's cell. It also probes the neighbouring lattice cells (of the 240 shortest lattice vectors, those
nearest to its projection). Two vectors are compared if one's own cell is among the cells of the other in
some table; equal vectors are compared once. Cosines are computed in double precision, so no link is wrong.

Cells shrink as the table grows (their number follows the number of vectors), and the number of tables
follows from the cells: a fixed simulation measures how often a pair at the threshold meets in one table,
and as many tables are taken as the target recall needs. Large cells are dealt to blocks of bounded size.
A pair that meets in several places is counted in the first only, which both members' keys tell.

Defined results: null vectors, zero vectors, and vectors with null or non-finite components link with
nothing (n_links 0, their own component, kept); vectors of different dimensions aren't linked; rows with a null
vec_id link with nothing, as nothing could name them in a component; an empty table gives no rows. vec_id is taken to be a key; rows that repeat a vec_id count as further copies of it. Only
vec_id and embedding are read, so other columns may have any names.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._blocks import deal, local_labels, runs
from ._shared import Scratch
from .components import components

THRESHOLD, RECALL = 0.9, 0.985
PROBES = 4
BASE_SCALE, BASE_ROWS = 0.5, 50_000
BLOCK = 1024
SEED = 20_240_607


@lru_cache(1)
def _neighbours():
    """The 240 shortest vectors of E8: (±1, ±1, 0, ...) in all places, and all (±1/2, ...) with an even
    number of minus signs."""
    import numpy as np

    whole = [[dict(zip(at, signs)).get(i, 0) for i in range(8)] for at in combinations(range(8), 2) for signs in product((1, -1), repeat=2)]
    half = [x for x in product((0.5, -0.5), repeat=8) if sum(v < 0 for v in x) % 2 == 0]
    return np.array([*whole, *half], float)


def _nearest_d8(x):
    import numpy as np

    near = np.rint(x)
    off = x - near
    worst, rows = np.abs(off).argmax(1), np.arange(len(x))
    step = np.where(off[rows, worst] >= 0, 1.0, -1.0)
    near[rows, worst] += np.where(near.sum(1) % 2 != 0, step, 0.0)
    return near


def nearest_e8(x):
    """The nearest point of E8 = D8 ∪ (D8 + 1/2) for each row."""
    import numpy as np

    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def cells(unit, tables: int, scale: float, probes: int = PROBES):
    """Keys of the cells, rows x tables x (1 + probes); the first is the vector's own."""
    import numpy as np

    around = _neighbours()
    dims = unit.shape[1]
    weights = np.random.default_rng(SEED).integers(1, 1 << 62, 8, np.int64) | 1
    out = np.empty((len(unit), tables, 1 + probes), np.int64)
    for t in range(tables):
        y = unit @ np.random.default_rng([SEED, dims, t]).normal(size=(dims, 8)) * scale
        own = nearest_e8(y)
        nearest = np.argsort(-((y - own) @ around.T), 1, kind="stable")[:, :probes]
        points = np.concatenate([own[:, None], own[:, None] + around[nearest]], 1)
        with np.errstate(over="ignore"):
            key = ((points * 2).astype(np.int64) * weights).sum(2) + np.int64(t * 1_000_003 + dims)
            key ^= key >> 29
            key *= np.int64(0x1B873593CC9E2D51)
            out[:, t] = key ^ (key >> 32)
    return out


def meeting_rate(scale: float, dims: int = 64, probes: int = PROBES, cosine: float = THRESHOLD, pairs: int = 4000) -> float:
    """How often a pair at this cosine meets in one table, by a fixed simulation."""
    import numpy as np

    rng = np.random.default_rng(SEED)
    a, b = rng.normal(size=(2, pairs, dims))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = cosine * a + (1 - cosine * cosine) ** 0.5 * b
    x, y = cells(a, 4, scale, probes), cells(b, 4, scale, probes)
    return float(((x[:, :, :1] == y).any(2) | (y[:, :, :1] == x).any(2)).mean())


def _unit(batch, column: str):
    import numpy as np

    values = np.array(batch.column(column).combine_chunks().flatten() if hasattr(batch.column(column), "combine_chunks") else batch.column(column).flatten(), float)
    x = values.reshape(len(batch), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _keys(tables: int, scale: float):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        from ._blocks import runs as _runs

        for t in _runs(batches, ["dims"]):
            for batch in t.to_batches(4096):
                k = cells(_unit(batch, "embedding"), tables, scale)
                # a vector's own cell and the cells it probes; twice the same cell in one table is one entry
                n = k.shape[1] * k.shape[2]
                own = np.zeros(k.shape, bool)
                own[:, :, 0] = True
                yield pa.record_batch(
                    [pa.array(np.repeat(batch.column("rep").to_numpy(), n)), pa.array(k.ravel()), pa.array(own.ravel())], names=["rep", "cell", "own"]
                )

    return run


def _links(tables: int, scale: float, threshold: float):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for t in runs(batches, ["cell", "__lo", "__hi"]):
            if len(t) < 2:
                continue
            cell, lo, hi = t["cell"][0].as_py(), t["__lo"][0].as_py(), t["__hi"][0].as_py()
            rep, weight = t["rep"].to_numpy(), t["copies"].to_numpy()
            part, x = t["__own"].to_numpy(), _unit(t, "embedding")
            a, b = (part == lo).nonzero()[0], (part == hi).nonzero()[0]
            i, j = (x[a] @ x[b].T >= threshold - 1e-9).nonzero()
            i, j = a[i], b[j]
            if lo == hi:
                i, j = i[i < j], j[i < j]
            if not len(i):
                continue
            exact = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
            i, j = i[exact], j[exact]
            if not len(i):
                continue
            k = cells(x, tables, scale)
            first = np.full(len(i), -1)
            place = np.zeros(len(i), np.int64)
            for s in range(tables):
                for p, q in ((i, j), (j, i)):
                    met = (k[p, s, :1] == k[q, s]).any(1)
                    here = k[p, s, 0]
                    better = met & ((first < 0) | ((first == s) & (here < place)))
                    first[better], place[better] = s, here[better]
            ours = place == cell
            i, j = i[ours], j[ours]
            links = np.zeros(len(rep), np.int64)
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            label = local_labels(i, j, len(rep))
            least = np.full(len(rep), np.iinfo(np.int64).max)
            np.minimum.at(least, label, rep)
            some = links > 0
            yield pa.record_batch([pa.array(rep[some]), pa.array(least[label][some]), pa.array(links[some])], names=["rep", "near", "links"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept."""
    from math import ceil, log

    spark = vectors.sparkSession
    scratch = Scratch(spark, "lattice")
    values = F.transform("embedding", lambda x: x.cast("double"))
    usable = (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(usable, F.col("embedding")).alias("embedding"), F.xxhash64(values, F.lit(1)).alias("h"), F.xxhash64(values, F.lit(2)).alias("g"))
    whole = rows.where("embedding IS NOT NULL AND vec_id IS NOT NULL")
    reps = scratch.cut(
        whole.groupBy("h", "g", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("dims", F.size("embedding")), "reps"
    )
    n, dims = reps.agg(F.count("*"), F.max("dims")).first()
    scale = BASE_SCALE * (max(n, 1) / BASE_ROWS) ** (1 / 8)
    tables = ceil(log(1 - recall) / log(1 - min(0.999, meeting_rate(scale, dims or 8, cosine=threshold))))
    keyed = scratch.cut(reps.select("rep", "dims", "embedding").repartition("dims", F.pmod(F.xxhash64("rep"), F.lit(256))).sortWithinPartitions("dims").mapInArrow(_keys(tables, scale), "rep long, cell long, own boolean"), "keyed")
    sizes = keyed.groupBy("cell").agg(F.count("*").alias("m"), F.max("own").alias("has")).where("m > 1 AND has")
    shared = keyed.select("rep", "cell").join(sizes, "cell").select("rep", "cell", F.ceil(F.col("m") / BLOCK).alias("__chunks"))
    members = deal(shared.join(reps.select("rep", "embedding", "copies"), "rep"), F.col("__chunks"), "rep")
    block = ["cell", "__lo", "__hi"]
    found = scratch.cut(
        members.repartition(*block).sortWithinPartitions(*block).select(*block, "__own", "rep", "copies", "embedding").mapInArrow(_links(tables, scale, threshold), "rep long, near long, links long"), "links"
    )
    group = components(found.where("rep != near").select(F.col("rep").alias("u"), F.col("near").alias("v")), scratch)
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = (
        reps.join(linked, "rep", "left").join(group.withColumnRenamed("node", "rep"), "rep", "left")
        .select("h", "g", F.col("embedding").alias("same"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    out = whole.join(classes, (whole.h == classes.h) & (whole.g == classes.g) & (whole.embedding == classes.same)).select("vec_id", "n_links", "component_id")
    alone = rows.where("embedding IS NULL OR vec_id IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
