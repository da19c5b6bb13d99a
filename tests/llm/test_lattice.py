import numpy as np
import pytest

from dendrolake.llm import lattice

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.9):
    ok = {i: np.array(v, float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = {i: set() for i, _ in rows}
    ids = sorted(ok)
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            if len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / np.linalg.norm(ok[i]) / np.linalg.norm(ok[j]) >= threshold:
                links[i].add(j), links[j].add(i)
    out = {}
    for i in sorted(links):
        if i not in out:
            todo, group = [i], {i}
            while todo:
                new = links[todo.pop()] - group
                group |= new
                todo += new
            out |= {g: min(group) for g in group}
    return {i: (len(links[i]), out[i]) for i in links}


def test_nearest_points_are_lattice_points_and_nearest():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)) * 2
    p = lattice.nearest_e8(x)
    whole = (p * 2 % 2 == 0).all(1)
    half = (p * 2 % 2 == 1).all(1)
    assert (whole | half).all() and (p.sum(1) % 2 == 0).all()
    around = p[:, None] + lattice._neighbours()
    assert len(lattice._neighbours()) == 240 and np.allclose((lattice._neighbours() ** 2).sum(1), 2)
    assert ((x - p) ** 2).sum(1).max() <= 1 + 1e-9
    assert (((x[:, None] - around) ** 2).sum(2) >= ((x - p) ** 2).sum(1)[:, None] - 1e-9).all()


@pytest.mark.parametrize("block", [1024, 16])
def test_links_equal_brute_force_but_for_the_recall(spark, monkeypatch, block):
    monkeypatch.setattr(lattice, "BLOCK", block)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 32))
    rows = [(i, (centres[0 if i % 3 == 0 else i % 30] + 0.25 * rng.normal(size=32)).astype(np.float32).tolist()) for i in range(240)]
    rows += [(900, None), (901, [0.0] * 32), (902, [float("nan")] + [1.0] * 31), (903, [None] + [1.0] * 31), (904, [float("inf")] + [1.0] * 31), (905, []), (906, rows[1][1]), (907, [2 * x for x in rows[1][1]]), (908, [1.0, 0.0])]
    got = {r.vec_id: r for r in lattice.near_duplicates(spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).repartition(3)).collect()}
    want = brute(rows)
    assert len(got) == len(rows)
    assert all(got[i].n_links <= n for i, (n, _) in want.items())
    assert sum(r.n_links for r in got.values()) >= 0.95 * sum(n for n, _ in want.values())
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (900, 901, 902, 903, 904, 905, 908))
    assert got[906].component_id == got[907].component_id == got[1].component_id
    assert sum(got[i].component_id == c for i, (_, c) in want.items()) >= 0.95 * len(rows)


def test_no_vectors(spark):
    assert lattice.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_meeting_rate_grows_with_similarity():
    assert lattice.meeting_rate(0.5, 32, cosine=0.97) > lattice.meeting_rate(0.5, 32, cosine=0.9) > lattice.meeting_rate(0.5, 32, cosine=0.5)


def test_null_and_repeated_ids_and_clashing_names(spark):
    from pyspark.sql import functions as F

    v, w = [1.0, 2.0] * 8, [2.0, -1.0] * 8
    df = spark.createDataFrame([(5, v, 0), (5, v, 1), (7, v, 2), (None, v, 3), (9, w, None), (9, None, None)], VECTORS)
    df = df.withColumns({c: F.lit("x") for c in ("rep", "dims", "cell", "own", "copies", "h", "g", "near", "links", "node")})
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in lattice.near_duplicates(df).collect()), key=repr)
    assert got == [(0, 0, None, True), (5, 2, 5, True), (5, 2, 5, True), (7, 2, 5, False), (9, 0, 9, True), (9, 0, 9, True)]
