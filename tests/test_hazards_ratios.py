"""Densities of trees, warped time, hat functions, ratios of heights and moved events against plain Python."""

import math
import random

import numpy as np
import pytest

from dendrolake.operators import hazards, history, ratios

NODE = "tree_id long, node long, parent long, is_leaf boolean, n_tips long, depth long, height double"
KNOTS = ((0.0, -1.0), (1.0, 0.4), (2.0, 0.4), (3.5, -2.0))


def shape(tree_id=1):
    """Five tips, two of one height, an inner node at a tip's height, and one beyond the last knot; leaves first."""
    parent = {0: 5, 1: 5, 2: 6, 3: 6, 4: 7, 5: 7, 6: 8, 7: 8, 8: None}
    height = {0: 0.0, 1: 0.0, 2: 0.5, 3: 1.2, 4: 0.9, 5: 0.9, 6: 2.0, 7: 2.7, 8: 4.5}
    depth = {}
    for n in sorted(parent, reverse=True):
        depth[n] = 0 if parent[n] is None else depth[parent[n]] + 1
    return [(tree_id, n, p, n < 5, 5, depth[n], height[n]) for n, p in parent.items()]


def log_rate(h):
    i = max(k for k in range(len(KNOTS) - 1) if k == 0 or KNOTS[k][0] <= h)
    (x, a), (y, b) = KNOTS[i], KNOTS[i + 1]
    return a + (b - a) * (h - x) / (y - x)


def area(f, lo, hi, n=4000):
    return sum(f(lo + (k + 0.5) * (hi - lo) / n) for k in range(n)) * (hi - lo) / n


@pytest.fixture()
def node(spark):
    return spark.createDataFrame(shape(), NODE)


@pytest.mark.parametrize("hazard", ["coalescent", "birth_death"])
def test_density_is_that_of_events_and_what_is_at_risk(spark, node, hazard):
    rows = sorted(((h, not leaf, leaf) for _, _, _, leaf, _, _, h in shape()), key=lambda r: r[:2])
    total, k, last, pieces, events = 0.25, 0, 0.0, [], []
    for h, _, leaf in rows:
        risk = k * (k - 1) / 2 if hazard == "coalescent" else k
        if h > last and risk > 0:
            pieces.append((last, h, k, risk))
            total -= risk * area(lambda x: math.exp(log_rate(x)), last, h)
        if not leaf:
            ways = k * (k - 1) / 2 if hazard == "coalescent" else k - 1
            events.append((h, k, math.log(ways)))
            total += math.log(ways) + log_rate(h)
        k, last = k + (1 if leaf else -1), h
    got = hazards.tree_hazard_density.given(knots=KNOTS, hazard=hazard, intercept=0.25)(node=node).collect()
    assert [(r.tree_id, r.events, r.log_density) for r in got] == [(1, 4, pytest.approx(total, abs=1e-4))]
    found = hazards.exposure_pieces.given(hazard=hazard)(node=node).orderBy("start_height").collect()
    assert [(r.start_height, r.end_height, r.lineages, r.exposure) for r in found] == pieces
    joins = hazards.join_events.given(hazard=hazard)(node=node).orderBy("height").collect()
    assert [(r.height, r.lineages, r.log_ways) for r in joins] == [(h, k, pytest.approx(w, abs=1e-8)) for h, k, w in events]


def test_warped_time_and_back(spark, node):
    for r in hazards.warped_time.given(knots=KNOTS)(node=node).collect():
        assert r.time == pytest.approx(area(lambda x: math.exp(log_rate(x)), 0, r.height) if r.height else 0, abs=1e-5)
        assert r.log_rate == pytest.approx(log_rate(r.height)) and r.back == pytest.approx(r.height, abs=1e-6)
        assert area(lambda x: math.exp(log_rate(x)), 0, r.half) == pytest.approx(r.time / 2, abs=1e-5)
    # the last segment falls for ever, so its integral has a limit
    falls = spark.createDataFrame([(1.0,), (1e6,)], "t double").selectExpr("t", hazards.height_at("t", ((0.0, 0.0), (1.0, -1.0))) + " AS h").collect()
    assert [r.h for r in falls][1] is None
    for wrong in ((), ((0.0, 1.0),), ((1.0, 0.0), (2.0, 0.0)), ((0.0, 0.0), (0.0, 1.0))):
        with pytest.raises(ValueError):
            hazards.checked(wrong)


def test_hat_functions_and_their_regression(spark, node):
    knots = (0.3, 1.0, 2.2, 4.0)

    def hat(k, h):
        return float(np.interp(h, knots, [1.0 if j == k else 0.0 for j in range(4)]))

    spans = [(h, dict((n, x) for _, n, _, _, _, _, x in shape())[p]) for _, _, p, _, _, _, h in shape() if p is not None]
    design = hazards.hat_design.given(knots=knots, scale=2.0)(node=node)
    got = {r.f: r.x for r in design.collect()}
    assert got == {k: pytest.approx(sum(area(lambda x: hat(k, x), lo, hi, 1000) for lo, hi in spans) / 2, abs=1e-5) for k in range(4)}
    assert sum(got.values()) == pytest.approx(sum(hi - lo for lo, hi in spans) / 2)  # they add up to one
    rng = random.Random(4)
    x = [[rng.random() for _ in range(3)] for _ in range(20)]
    y = [rng.random() for _ in x]
    rows = spark.createDataFrame([(i, f, v) for i, r in enumerate(x) for f, v in enumerate(r)], "obs long, f long, x double")
    target = spark.createDataFrame(list(enumerate(y)), "obs long, y double")
    sums = hazards.ridge_sums.given(ridge=0.1)(design=rows, target=target)
    a = np.array(x)
    want = np.linalg.solve(a.T @ a + 0.1 * 20 * np.eye(3), a.T @ np.array(y))
    assert list(hazards.ridge_weights(sums).values()) == pytest.approx(list(want), abs=1e-4)
    with pytest.raises(ValueError):
        hazards.ridge_weights(sums, 2)
    assert hazards.ridge_sums(design=rows.limit(0), target=target.limit(0)).count() == 0


@pytest.mark.parametrize("low, anchor", [("oldest", "parent"), ("youngest", "parent"), ("zero", "parent"), ("oldest", "root"), ("zero", "root")])
def test_heights_come_back_from_their_ratios(spark, node, low, anchor):
    below = {5: [0.0, 0.0], 6: [0.5, 1.2], 7: [0.0, 0.0, 0.9], 8: [0.0, 0.0, 0.5, 1.2, 0.9]}
    stats = spark.createDataFrame([(1, n, max(t), min(t), len(t), 0) for n, t in below.items()], "tree_id long, node long, oldest_tip double, youngest_tip double, tips long, mutations long")
    mark = {"oldest": max, "youngest": min, "zero": lambda t: 0.0}[low]
    height, parent = {n: h for _, n, _, _, _, _, h in shape()}, {n: p for _, n, p, *_ in shape()}
    found = ratios.anchored_ratios.given(low=low, anchor=anchor)(node=node, stats=stats)
    above = {n: 8 if anchor == "root" else parent[n] for n in (5, 6, 7)}
    want = {n: (height[n] - mark(below[n])) / (height[above[n]] - mark(below[n])) for n in above}
    assert {r.node: r.ratio for r in found.collect()} == {n: pytest.approx(v) for n, v in want.items()}
    same = ratios.heights_from_ratios(node, found, spark.createDataFrame([(1, 4.5)], "tree_id long, height double"), anchor)
    assert {r.node: (r.height, r.log_jacobian) for r in same.collect()} == {n: (pytest.approx(height[n]), pytest.approx(0)) for n in below}
    new = {8: 6.0}
    for n in (7, 6, 5):
        m = mark(below[n])
        new[n] = m + want[n] * (new[above[n]] - m)
    moved = {r.node: r for r in ratios.heights_from_ratios(node, found, spark.createDataFrame([(1, 6.0)], "tree_id long, height double"), anchor).collect()}
    assert {n: r.height for n, r in moved.items()} == {n: pytest.approx(v) for n, v in new.items()}
    for n in above:
        m = mark(below[n])
        assert moved[n].log_jacobian == pytest.approx(math.log((new[above[n]] - m) / (height[above[n]] - m)))


def test_classes_and_odds(spark, node):
    stats = spark.createDataFrame([(1, 5, 0.0, 0.0, 2, 0), (1, 6, 1.2, 0.5, 2, 3), (1, 7, 0.9, 0.0, 3, 7), (1, 8, 1.2, 0.0, 5, 2**40)], "tree_id long, node long, oldest_tip double, youngest_tip double, tips long, mutations long")
    mut = spark.createDataFrame([(1, n) for n, k in ((0, 2), (5, 1), (7, 4), (8, 3)) for _ in range(k)], "tree_id long, node long")
    got = {r.node: (r.size_class, r.mutation_class, r.event_group) for r in ratios.node_classes(node=node, mut=mut, stats=stats).collect()}
    # groups: 5 has one event and its child two, 7 four and its child one, 8 three and its child four
    assert got == {5: (1, 0, 2), 6: (1, 4, 0), 7: (1, 6, 2), 8: (2, 59, 3)}
    r = [0.2, 0.5, 0.6, 0.9]
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate([*r, 1.0, -0.5, 0.0])] + [(2, 0, 0.5)], "tree_id long, node long, ratio double")
    classes = spark.createDataFrame([(1, i, 3) for i in range(7)] + [(2, 0, 1)], "tree_id long, node long, size_class long")
    odds = [x / (1 - x) for x in r]
    mean = sum(odds) / 4
    s = math.log(mean) - sum(map(math.log, odds)) / 4
    shape_ = (3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    fits = {x.size_class: (x.n, x.shape, x.scale) for x in ratios.odds_fit(ratios=rows, classes=classes).collect()}
    assert fits == {3: (4, pytest.approx(shape_, abs=1e-4), pytest.approx(mean / shape_, abs=1e-4)), 1: (1, None, None)}


def test_events_move_with_their_branches(spark, node):
    linked = spark.createDataFrame(
        [(1, 5, 7, 2.7, None, 0, 1), (1, 5, 7, 1.8, 2.7, 1, 2), (1, 5, 9, 0.9, None, 0, 3), (1, 8, 3, 99.0, None, 0, 1), (1, 0, 4, 0.45, None, 1, 0)],
        "tree_id long, node long, site long, time double, prev_time double, old_state long, new_state long",
    )
    new = node.selectExpr("tree_id", "node", "CASE WHEN node = 7 THEN 4.0D WHEN node = 5 THEN 1.0D ELSE height END AS height")
    got = {(r.node, r.site, r.old_state): (r.time, r.prev_time) for r in history.mapped_events(node=node, new_height=new, linked=linked).collect()}
    assert got == {(5, 7, 0): (4.0, None), (5, 7, 1): (2.5, 4.0), (5, 9, 0): (1.0, None), (8, 3, 0): (99.0, None), (0, 4, 1): (pytest.approx(0.5), None)}
    sums = history.mapping_jacobian(node=node, new_height=new, linked=linked).collect()
    assert [(r.events, r.log_jacobian) for r in sums] == [(4, pytest.approx(3 * math.log(3 / 1.8) + math.log(1 / 0.9), abs=1e-5))]


def test_sites_are_replaced(spark):
    schema = "tree_id long, node long, time double, site long, old_state long, new_state long"
    mut = spark.createDataFrame([(1, 2, 0.9, 4, 0, 1), (1, 2, 0.5, 4, 1, 0), (1, 2, 0.4, 5, 0, 2), (1, 3, 0.7, 4, 0, 3)], schema)
    places = spark.createDataFrame([(1, 2, 4), (1, 2, 4), (1, 9, 4)], "tree_id long, node long, site long")
    come = spark.createDataFrame([(1, 2, 0.3, 4, 2, 0), (1, 2, 0.8, 4, 0, 2), (1, 2, 0.1, 6, 0, 1), (1, 9, 0.2, 4, 0, 1)], schema)
    got = {(r.node, r.site, r.time): r.prev_time for r in history.replaced_sites(mut=mut, replaced=places, replacement=come).collect()}
    assert got == {(2, 4, 0.8): None, (2, 4, 0.3): 0.8, (2, 5, 0.4): None, (3, 4, 0.7): None, (9, 4, 0.2): None}
    assert history.replaced_sites(mut=mut, replaced=places, replacement=come.limit(0)).count() == 2
