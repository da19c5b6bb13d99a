"""Average linkage against merging one pair at a time; reachable regions against plain search."""

import random

import pytest

from dendrolake.operators import carries, clustering, parsimony, regions

from .test_plans import tree


def one_by_one(d):
    """{frozenset of tips: height} by merging the nearest pair each time, ties to smaller numbers."""
    groups = {i: [i] for i in range(len(d))}
    out, new = {}, len(d)
    while len(groups) > 1:
        apart = {(i, j): round(sum(d[a][b] for a in groups[i] for b in groups[j]) / (len(groups[i]) * len(groups[j])), 12) for i in groups for j in groups if i < j}
        i, j = min(apart, key=lambda k: (apart[k], k))
        groups[new] = groups.pop(i) + groups.pop(j)
        out[frozenset(groups[new])] = apart[i, j] / 2
        new += 1
    return out


@pytest.mark.parametrize("n", [2, 5, 23])
def test_average_linkage_merges_the_nearest(spark, n):
    rng = random.Random(n)
    d = [[0.0] * n for _ in range(n)]
    for i in range(n):
        for j in range(i):
            d[i][j] = d[j][i] = rng.random()
    pairs = spark.createDataFrame([(1, 10 * i, 10 * j, d[i][j]) for i in range(n) for j in range(n) if i < j], "dataset long, a long, b long, d double")
    rows = clustering.average_linkage(pairs, spark.createDataFrame([(1, 10 * i) for i in range(n)], "dataset long, taxon long")).collect()
    parent, height = {r.node: r.parent for r in rows}, {r.node: r.height for r in rows}
    below = {r.node: set() for r in rows}
    for r in rows:
        if r.is_leaf:
            at = r.node
            while at is not None:
                below[at].add(r.taxon // 10)
                at = parent[at]
    got = {frozenset(x): height[k] for k, x in below.items() if k >= n}
    assert got == {k: pytest.approx(v) for k, v in one_by_one(d).items()}
    assert parent[2 * n - 2] is None and all(height[k] <= height[k + 1] for k in range(n, 2 * n - 2)) and sorted(height) == list(range(2 * n - 1))
    depth = {r.node: r.depth for r in rows}
    assert all(depth[k] == (depth[p] + 1 if p is not None else 0) for k, p in parent.items())


def alignment(spark, sequences):
    code = {"A": 1, "C": 2, "G": 4, "T": 8, "N": 15, "R": 5}
    return spark.createDataFrame([(1, t, s, code[c]) for t, seq in enumerate(sequences) for s, c in enumerate(seq)], "dataset long, taxon long, site long, mask int")


def test_site_scores_on_the_alignments_own_tree(spark):
    masked = alignment(spark, ["AAAAAAAC", "AAGCAAAC", "AGAGAGGT", "AGGTGGGT"])
    scores = clustering.upgma_scores(masked)
    assert [r.score for r in scores.orderBy("site").collect()] == [0, 1, 2, 3, 1, 1, 1, 1]
    assert {r.site for r in parsimony.select_sites(scores, 2).collect()} == {2, 3}
    assert {r.site for r in parsimony.select_sites(scores, 2, high=False).collect()} == {0, 1, 4, 5, 6, 7}
    for least, high in ((4, True), (0, False)):
        with pytest.raises(ValueError):
            parsimony.select_sites(scores, least, high)


def test_distances_and_subsamples(spark):
    d = {(r.a, r.b): r.d for r in clustering.jukes_cantor(alignment(spark, ["AAAA", "AACN", "CCCR", "AAAA"])).collect()}
    import math

    assert d[0, 3] == 0 and d[0, 1] == pytest.approx(-0.75 * math.log(1 - 0.25 / 0.75)) and d[0, 2] == clustering.FARTHEST
    masked = alignment(spark, ["ACGT"] * 9)
    some = clustering.subsample(masked, 4, 1)
    assert some.select("taxon").distinct().count() == 4 and some.count() == 16
    assert clustering.upgma_tree(masked, 4).where("is_leaf").count() == 4 and clustering.upgma_tree(alignment(spark, ["AC"])).collect()[0].depth == 0
    with pytest.raises(ValueError):
        clustering.upgma_tree(masked, 1)


PARENTS, HEIGHTS = {8: None, 7: 8, 6: 8, 5: 7, 0: 5, 1: 5, 2: 7, 3: 6, 4: 6}, {8: 4, 7: 3, 6: 2, 5: 1, 0: 0, 1: 0, 2: 0, 3: 0, 4: 0}
EVENTS = [(7, 3.5, 0, 0, 1), (5, 2.5, 1, 0, 1), (5, 2.0, 2, 0, 1), (6, 3.0, 3, 0, 1), (6, 2.5, 3, 1, 0), (3, 1.0, 4, 0, 2), (3, 0.5, 5, 0, 2), (4, 1.5, 6, 0, 2), (2, 1.0, 0, 1, 2)]


def reach(spark, extra, shortcuts=None):
    node = tree(spark, PARENTS, HEIGHTS)
    mut = spark.createDataFrame([(1, *e) for e in EVENTS], "tree_id long, node long, time double, site long, old_state long, new_state long")
    reference = spark.createDataFrame([(s, 0) for s in range(8)], "site long, state long")
    chosen = spark.createDataFrame([(1, 2)], "tree_id long, x long")
    found = regions.attachment_regions(node, mut, carries.states(node, mut), reference, chosen)
    links = spark.createDataFrame([(1, *x) for x in shortcuts], "tree_id long, a long, b long") if shortcuts else None
    return found, {(r.node, r.idx): r.differences for r in regions.explore(found, node, chosen, extra, links).collect()}


def test_regions_and_what_is_reached(spark):
    found, near = reach(spark, 0)
    rows = {(r.node, r.idx): (r.upper, r.lower, r.differences) for r in found.collect()}
    # tip 2 ends with state 2 at site 0
    assert rows[7, 0] == (4, 3.5, 1) and rows[7, 1] == (3.5, 3, 1) and rows[5, 0] == (3, 2.5, 1) and rows[5, 2] == (2, 1, 3) and rows[6, 1] == (3, 2.5, 2) and rows[6, 2] == (2.5, 2, 1)
    assert rows[3, 2] == (0.5, 0, 3) and not any(n == 2 for n, _ in rows) and rows[0, 0][2] == 3
    # one difference at most: up to the root and down the other side until an event
    assert near == {(7, 0): 1, (7, 1): 1, (5, 0): 1, (6, 0): 1}
    assert set(reach(spark, 1)[1]) == {(7, 0), (7, 1), (5, 0), (5, 1), (6, 0), (6, 1), (6, 2), (3, 0), (3, 1), (4, 0), (4, 1)}
    far = {(0, 0), (1, 0), (5, 2), (3, 2)}
    assert set(reach(spark, 2)[1]) == set(reach(spark, 1)[1]) | far


def test_shortcuts_join_the_ends_of_close_tips(spark):
    parents, heights = {4: None, 3: 4, 2: 4, 0: 3, 1: 3}, {4: 3, 3: 2, 2: 0, 0: 0, 1: 0}
    node = tree(spark, parents, heights)
    events = [(2, 2.5, 0, 0, 1), (2, 2.0, 1, 0, 1), (2, 1.5, 0, 1, 0), (2, 1.0, 1, 1, 0), (3, 2.75, 3, 0, 1), (1, 1.0, 3, 1, 0)]
    mut = spark.createDataFrame([(1, *e) for e in events], "tree_id long, node long, time double, site long, old_state long, new_state long")
    reference, chosen = spark.createDataFrame([(s, 0) for s in range(4)], "site long, state long"), spark.createDataFrame([(1, 0)], "tree_id long, x long")
    found = regions.attachment_regions(node, mut, carries.states(node, mut), reference, chosen)
    walled = {(r.node, r.idx) for r in regions.explore(found, node, chosen, 0).collect()}
    joined = {(r.node, r.idx) for r in regions.explore(found, node, chosen, 0, spark.createDataFrame([(1, 1, 2)], "tree_id long, a long, b long")).collect()}
    # tip 0 has the event of site 3: at the end of its branch tip 2 differs there alone, before it at two sites
    assert walled < joined and joined - walled == {(2, 4)}
