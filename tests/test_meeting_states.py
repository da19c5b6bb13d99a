"""States and events that meet nodes: how often they are read and dealt, and rows that come twice or have nulls."""

import random

from dendrolake.operators import history, likelihood
from dendrolake.plans import registry
from dendrolake.plans.plan import ANSI

NODE = "tree_id long, node long, parent long, is_leaf boolean"
STATE = "tree_id long, node long, site long, state long"


def odd(rows, rng, empty):
    """The same rows, some of them twice and some with a null in one of the columns of these places."""
    out = rows + rng.sample(rows, len(rows) // 4)
    for row in rng.sample(rows, len(rows) // 4):
        at = rng.choice(empty)
        out.append((*row[:at], None, *row[at + 1:]))
    return out


def odd_tables(spark, seed):
    rng = random.Random(seed)
    nodes = [(t, n, n // 3 if n else None, n > 6) for t in range(3) for n in range(16)]
    states = [[(t, n, s, rng.choice([0, 1, 2, 3, None])) for t in range(3) for n in range(17) for s in range(6) if rng.random() < 0.6] for _ in range(2)]
    return {
        "node": spark.createDataFrame(odd(nodes, rng, [0, 1, 2]), NODE),
        "carried": spark.createDataFrame(odd(states[0], rng, [0, 1, 2]), STATE),
        "other_carried": spark.createDataFrame(odd(states[1], rng, [0, 1, 2]), STATE),
        "reference": spark.createDataFrame([(s, s % 4) for s in range(5)] + [(1, 3), (2, 2), (3, None), (None, 1)], "site long, state long"),
    }


def rows(df):
    return sorted(map(str, map(tuple, df.collect())))


def as_before(spark, p, tables):
    """What the text for a second engine gives, run by Spark."""
    given = {t: tables[t] for t in p.tables}
    want, got = rows(spark.sql(p.text(ANSI), **given)), rows(p(**given))
    assert got == want and len(want) > 3


def written(tables, path):
    out = {}
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
        out[name] = df.sparkSession.read.parquet(f"{path}/{name}")
    return out


def test_differing_sites_of_rows_that_come_twice_or_have_nulls(spark):
    for seed in range(3):
        as_before(spark, history.differing_sites, odd_tables(spark, seed))
    tables = odd_tables(spark, 0)
    for name in ("node", "carried", "reference"):
        assert history.differing_sites(**{t: tables[t].limit(0) if t == name else tables[t] for t in history.differing_sites.tables}).count() == 0


def test_states_of_siblings_are_read_once_each(spark, tmp_path):
    t = written(odd_tables(spark, 0), tmp_path)
    text = history.differing_sites(**{x: t[x] for x in history.differing_sites.tables})._jdf.queryExecution().optimizedPlan().toString()
    assert len([line for line in text.splitlines() if "Relation [tree_id" in line and "site#" in line]) == 2
    assert "FullOuter" in text and "Union" not in text


def test_distances_of_histories_with_rows_that_come_twice_or_have_nulls(spark):
    for seed in range(3):
        as_before(spark, history.history_distance, odd_tables(spark, seed))
    tables = odd_tables(spark, 0)
    for name in ("node", "reference"):
        assert history.history_distance(**{t: tables[t].limit(0) if t == name else tables[t] for t in history.history_distance.tables}).count() == 0


def test_only_whether_states_differ_goes_to_their_nodes(spark, tmp_path):
    t = written(odd_tables(spark, 0), tmp_path)
    lines = history.history_distance(**{x: t[x] for x in history.history_distance.tables})._jdf.queryExecution().optimizedPlan().toString().splitlines()
    [dealt] = [i for i, line in enumerate(lines) if "RepartitionByExpression" in line]
    assert [x.split("#")[0].strip() for x in lines[dealt + 1].split("[")[1].split(", ")[:2]] == ["tree_id", "node"] and "AS differs" in lines[dealt + 1]
    assert "Aggregate [tree_id" in lines[dealt - 1] and any("Join Inner" in line for line in lines[:dealt - 1])  # counted before nodes are met


def event_tables(spark, seed):
    rng = random.Random(seed)
    nodes = [(t, n, n // 2 if n > 1 else None, (9 - n) / 4) for t in range(2) for n in range(1, 10)]
    events = [(t, n, (9 - n + k) / 4, s, rng.choice([0, 1, 2, 3, None]), rng.choice([0, 1, 2, 3, None])) for t in range(2) for n in range(1, 11) for s in range(6) for k in (0.5, 0.25, 0.125) if rng.random() < 0.5]
    return {
        "node": spark.createDataFrame(odd(nodes, rng, [0, 1, 2, 3]), "tree_id long, node long, parent long, height double"),
        "mut": spark.createDataFrame(odd(events, rng, [0, 1, 2, 3]), "tree_id long, node long, time double, site long, old_state long, new_state long"),
        "site_category": spark.createDataFrame([(s, s % 3) for s in range(5)] + [(1, 1), (2, 0), (3, None), (None, 1)], "site long, category long"),
    }


def test_sums_of_branches_with_rows_that_come_twice_or_have_nulls(spark):
    for seed in range(3):
        as_before(spark, likelihood.branch_stats, event_tables(spark, seed))
    tables = event_tables(spark, 0)
    for name in tables:
        assert likelihood.branch_stats(**{t: tables[t].limit(0) if t == name else tables[t] for t in tables}).count() == 0


def test_states_of_siblings_are_sorted_in_all_partitions_of_a_shuffle(spark):
    plan = registry.queries()["differing_sites"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    n = spark.conf.get("spark.sql.shuffle.partitions")
    dealt = [line for line in plan.splitlines() if "REPARTITION_BY_NUM" in line]
    assert len(dealt) == 2 and all("Exchange hashpartitioning(tree_id" in line and f", {n}), REPARTITION_BY_NUM" in line for line in dealt)
