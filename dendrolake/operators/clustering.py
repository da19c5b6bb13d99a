"""Trees built from alignments by average linkage (UPGMA): masked(dataset, taxon, site, mask)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from . import parsimony

FARTHEST = 5.0  # fixed value: the distance where more than three quarters of the sites differ


def subsample(masked: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """The rows of `most` taxa of each dataset, drawn by a hash of the taxon."""
    taxa = masked.select("dataset", "taxon").distinct()
    nth = F.row_number().over(Window.partitionBy("dataset").orderBy(F.md5(F.concat_ws("-", F.lit(seed), "taxon")), "taxon"))
    return masked.join(taxa.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth"), ["dataset", "taxon"])


def jukes_cantor(masked: DataFrame) -> DataFrame:
    """dataset, a, b, d for each two taxa of a dataset (a < b): over all sites, those count as different where both have one state and not the same."""
    single = F.when(F.expr("bit_count(mask) = 1"), F.col("mask")).otherwise(0)
    rows = masked.groupBy("dataset", "taxon").agg(F.transform(F.array_sort(F.collect_list(F.struct("site", single.alias("m")))), lambda x: x.m).alias("row"))
    pairs = rows.withColumnRenamed("taxon", "a").join(rows.select("dataset", F.col("taxon").alias("b"), F.col("row").alias("other")), "dataset").where("a < b")
    differ = F.aggregate(F.zip_with("row", "other", lambda x, y: F.when((x != 0) & (y != 0) & (x != y), 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    p = differ / F.size("row")
    return pairs.select("dataset", "a", "b", F.when(p >= 0.75, FARTHEST).otherwise(F.least(F.lit(FARTHEST), -0.75 * F.log(1 - p / 0.75)) + 0.0).alias("d"))


TREE = "tree_id long, node long, parent long, is_leaf boolean, n_tips long, depth long, height double, taxon long"


def linkage(distances):
    """(first, second, height) of the merges of a symmetric matrix of distances: clusters are numbered on as they are made. In each round all pairs
    of clusters that are nearest to each other merge, which gives the tree of merging one pair at a time, as a merged cluster is never
    nearer to others than its parts were. Sums of distances between clusters are kept, which only add up; ties go to smaller numbers."""
    import numpy as np

    total, size, ids, out = np.array(distances, float), np.ones(len(distances)), np.arange(len(distances)), []
    while len(ids) > 1:
        apart = np.round(total / np.outer(size, size), 12)
        np.fill_diagonal(apart, np.inf)
        nearest = apart.argmin(1)
        here = np.arange(len(ids))
        one = here[(nearest[nearest] == here) & (here < nearest)]
        one = one[np.lexsort((one, apart[one, nearest[one]]))]
        two = nearest[one]
        out += [(int(ids[i]), int(ids[j]), apart[i, j] / 2) for i, j in zip(one, two)]
        stay = np.setdiff1d(here, np.concatenate([one, two]))
        label = np.empty(len(ids), int)
        label[stay], label[one], label[two] = np.arange(len(stay)), len(stay) + np.arange(len(one)), len(stay) + np.arange(len(one))
        first = len(distances) + len(out) - len(one)
        merged = np.zeros((len(stay) + len(one),) * 2)
        np.add.at(merged, (label[:, None], label[None, :]), total)
        total, size, ids = merged, np.bincount(label, size), np.concatenate([ids[stay], first + np.arange(len(one))])
    return out


def average_linkage(distances: DataFrame, taxa: DataFrame) -> DataFrame:
    """distances: dataset, a, b, d (a < b, all pairs); taxa: dataset, taxon. Returns TREE, where tree_id is the dataset: leaves numbered first, in the
    order of taxa, then inner nodes by height, the root last. A dataset is one group, whose size the subsample bounds."""

    def of_dataset(leaves, pairs):
        import numpy as np
        import pandas as pd

        names = np.sort(leaves["taxon"].unique())
        n = len(names)
        matrix = np.zeros((n, n))
        x, y = np.searchsorted(names, pairs["a"]), np.searchsorted(names, pairs["b"])
        matrix[x, y] = matrix[y, x] = pairs["d"]
        merges = linkage(matrix)
        height = np.concatenate([np.zeros(n), [m[2] for m in merges]])
        # rounds may merge far pairs of one part before near ones of another
        number = np.concatenate([np.arange(n), n + np.argsort(np.argsort(height[n:], kind="stable"), kind="stable")]).astype(int)
        parent = {}
        for k, (i, j, _) in enumerate(merges):
            parent[number[i]] = parent[number[j]] = number[n + k]
        depth = {}
        for node in sorted(number.tolist(), reverse=True):
            depth[node] = depth[parent[node]] + 1 if node in parent else 0
        tree = leaves["dataset"].iloc[0]
        rows = [(tree, node, parent.get(node), node < n, n, depth[node], height[k], names[node] if node < n else None) for k, node in enumerate(number.tolist())]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in TREE.split(", ")]).astype({"parent": "Int64", "taxon": "Int64"})

    pairs = distances.select(F.col("dataset").alias("of"), "a", "b", "d")
    return taxa.select("dataset", "taxon").distinct().groupBy("dataset").cogroup(pairs.groupBy("of")).applyInPandas(of_dataset, TREE)


def upgma_tree(masked: DataFrame, most: int = 1000) -> DataFrame:
    """The tree of an alignment, of a subsample of its taxa where there are more than `most`."""
    if most < 2:
        raise ValueError("a tree needs at least two taxa")
    some = cut(subsample(masked.select("dataset", "taxon", "site", "mask"), most))
    return average_linkage(jukes_cantor(some), some)


def upgma_scores(masked: DataFrame, most: int = 1000) -> DataFrame:
    """tree_id, site, score: changes that each site needs on the tree of its own alignment, all sites of which are kept."""
    tree = cut(upgma_tree(masked, most))
    tips = masked.join(tree.where("is_leaf").select(F.col("tree_id").alias("dataset"), "taxon", "node"), ["dataset", "taxon"]).select(F.col("dataset").alias("tree_id"), "node", "site", "mask")
    return parsimony.fitch_scores(fitch=parsimony.fitch_sets(tree, tips), node=tree)
