"""Prefix trie, line dedup and fill-in-the-middle: against their SQL twins on hard fixtures, and by themselves."""

import hashlib
import random
from collections import defaultdict

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dendrolake.llm import fill_middle, line_dedup, prefix_trie

TURNS = "conv_id long, turn long, role string, text string"


def same(df, sql, **tables):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t.toArrow())
    want = con.sql(sql)
    names = want.columns
    assert sorted(df.columns) == sorted(names)
    rows = sorted((tuple(r[n] for n in names) for r in df.select(*names).collect()), key=repr)
    assert rows == sorted(want.fetchall(), key=repr)
    return rows


# prefix trie


def plain_nodes(paths):
    """Brute force: {conv_id: list of (role, text)} -> rows of the trie."""
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def below(node):
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        parts = [below(x) for x in children[node]]
        return (sum(x[0] for x in parts) or 1, own + sum(x[1] for x in parts))

    rows = []
    for node, ids in members.items():
        ends = ",".join(str(c) for c in sorted(ids) if len(paths[c]) == len(node))
        rows.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(children[node]), *below(node), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=repr)


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_trie_equals_brute_force_with_copies_and_deep_prefixes(spark):
    rng = random.Random(3)
    deep = [("user" if i % 2 else "assistant", "é" * (i % 7)) for i in range(37)]
    paths = {i: [("user", rng.choice("abc"))] + [("user", rng.choice("xy")) for _ in range(rng.randrange(4))] for i in range(-20, 60)}
    paths |= {100 + i: list(deep) for i in range(30)}  # one class of many
    paths |= {200: deep[:30] + [("user", "other")], 201: deep[:12], 202: deep + [("user", "")], 203: [("", "")]}
    rows = [(c, k, *x) for c, path in paths.items() for k, x in enumerate(path)]
    got = prefix_trie.plain_trie(spark.createDataFrame(rows, TURNS).repartition(5))
    assert sorted((tuple(r[n] for n in NODE) for r in got.collect()), key=repr) == plain_nodes(paths)


def test_rebuilt_trie_equals_sql_with_nulls_ties_repeats_and_clashing_names(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "b", "long " * 50])) for c in range(0, 330, 3) for t in range(1 + c % 9)]
    rows += [(100, None, "user", "null turn"), (100, 0, None, None), (100, 0, "user", ""), (100, 0, "user", ""), (101, 3, None, "x"), (401, 0, "user", "no base"), (402, 0, "user", "no base")]
    rows += [(-7, 0, "user", "negative"), (-107, 0, "user", "negative"), (-100, 0, "user", "base below zero"), (None, 0, "user", "none"), (700, 0, "user", "z" * 200_000), (701, 0, "user", "z" * 200_000)]
    df = spark.createDataFrame(rows, TURNS)
    wide = df.withColumns({c: F.lit("x") for c in ("i", "pos", "k1", "k2", "chars", "h", "base", "n", "node", "parent", "depth", "band", "d1", "length", "saved", "top")})
    assert len(same(prefix_trie.conversation_trie(wide), prefix_trie.ORACLE, conversations=df)) > 100


def test_trie_of_turnless_single_and_no_conversations(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert prefix_trie.plain_trie(spark.createDataFrame([(None, 0, "user", "x")], TURNS)).count() == 0
    # 37: crc32 mod 6 decides how many own turns go; without a base a short conversation becomes turnless
    df = spark.createDataFrame([(c, 0, "user", "hi") for c in range(301, 330)], TURNS)
    rows = same(prefix_trie.conversation_trie(df), prefix_trie.ORACLE, conversations=df)
    root = next(r for r in rows if r[1] == 0)
    assert root[3] == 29
    one = spark.createDataFrame([(0, 0, "user", "hi")], TURNS)
    assert len(same(prefix_trie.conversation_trie(one), prefix_trie.ORACLE, conversations=one)) == 2


# line dedup


def lines_of(words, n, seed):
    return "\n".join(words(8, f"{seed}-{i}") + " and more of it so that it is long" for i in range(n))


def documents(words):
    shared = [f"  This Line Is Shared By Many Documents, number {k} of them. \t" for k in range(6)]
    rows = []
    for i in range(60):
        parts = lines_of(words, i % 5, i).split("\n") + [x.upper() if i % 2 else x for x in shared[: i % 7]] + ["short"] * (i % 3)
        random.Random(i).shuffle(parts)
        rows.append((i, "\n".join(parts), "en", "a"))
    e4 = ["Édition ÀÉÎ: letters beyond A to Z keep their case here, " + x for x in "aA"]
    rows += [(100 + i, f"{e4[i % 2]}\r\n\x0b{shared[0]}\x0c\n\n", "en", "a") for i in range(5)]
    rows += [(200, None, "en", "a"), (201, "", "en", "a"), (202, "\n", "en", "a"), (203, "x" * 39 + "\n" + "y" * 40, "en", "a"), (None, shared[0], "en", "a"), (None, shared[0] + "\n" + shared[0], "en", "a")]
    rows += [(300, shared[1], "en", "a")] * 2  # rows that repeat
    rows += [(400 + i, "\n".join([f"{k} is a line that four documents have, which is too few" for k in range(3)]), "en", "a") for i in range(4)]
    rows += [(None, "only rows without an identifier have this line, many times\nkept", "en", "a")] * 6
    return rows


def test_line_dedup_equals_sql(make, words):
    df = make(documents(words), parts=5)
    rows = same(line_dedup.digests(df), line_dedup.ORACLE, documents=df)
    assert sum(r[2] for r in rows) > 100


def test_line_dedup_of_very_long_texts_and_of_no_rows(make):
    many = "\n".join(f"line number {i} of a text that has very many of them, all different" for i in range(60_000))
    df = make([(i, many if i < 5 else many[: 1000 * i], "en", "a") for i in range(7)])
    rows = same(line_dedup.digests(df), line_dedup.ORACLE, documents=df)
    assert max(r[2] for r in rows) > 59_000
    assert line_dedup.digests(make([])).count() == 0


def test_all_columns_stay_with_the_text_that_is_left(make):
    line = "a line of more than forty code points that is in all documents"
    got = {r.doc_id: r for r in line_dedup.without_repeated_lines(make([(i, f"{i}\n{line}", "en", "s") for i in range(6)])).collect()}
    assert got[5].text == f"5\n{line}" and got[0].text == "0" and got[0].kept == "x" and got[0].source == "s"


def test_runs_compact_by_levels_skip_what_is_settled_and_open_again(spark, tmp_path, make):
    root = f"file://{tmp_path}/index"
    line = "this line of forty code points or more comes in every batch"
    index = line_dedup.Runs(spark, root, buckets=3)

    def batch(lo, hi):
        df = make([(i, f"{line}\nthis is the own line of document {i}, and of no other document", "en", "a") for i in range(lo, hi)])
        return line_dedup.batch_keys(line_dedup.hashed(df))

    index.add(batch(100, 110))
    assert index.spans == [(0, 0)]
    index.add(batch(0, 10))  # its largest doc_id is smaller, the line is settled: only own lines are new
    assert index.spans == [(0, 1)] and index.run((0, 1)).count() == 21 and index.run((0, 1)).where("docs = 10").count() == 1
    index.add(batch(200, 203))
    assert index.spans == [(0, 1), (2, 2)]
    [top] = index.settled().collect()
    assert top.keeper == 202
    index.close()
    # a compaction that was cut short leaves a run that a longer one covers, and one without its mark
    (tmp_path / "index/b3-run-000001-000001").mkdir()
    (tmp_path / "index/b3-run-000001-000001/_SUCCESS").touch()
    (tmp_path / "index/b3-run-000003-000003").mkdir()
    again = line_dedup.Runs(spark, root)
    assert again.spans == [(0, 1), (2, 2)] and again.buckets == 3
    again.add(batch(300, 301))
    assert again.spans == [(0, 3)] and [r.keeper for r in again.settled().collect()] == [300]
    plan = again.run((0, 3))._jdf.queryExecution().toString()
    assert "Bucketed: true" in plan or "SelectedBucketsCount" in plan or again.buckets == 3
    again.close(remove=True)
    assert not (tmp_path / "index").exists()


def test_a_kept_index_counts_what_came_before(spark, tmp_path, make):
    line = "a line that only becomes frequent with the documents of a later table"
    index = line_dedup.Runs(spark, f"file://{tmp_path}/index")
    first = line_dedup.without_repeated_lines(make([(i, line, "en", "a") for i in range(3)]), index).collect()
    assert all(r.text == line for r in first)
    second = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(make([(i, line, "en", "a") for i in range(3, 6)]), index).collect()}
    assert second == {3: "", 4: "", 5: line}
    index.close(remove=True)


def test_runs_join_batches_without_dealing_runs_again(spark, tmp_path):
    index = line_dedup.Runs(spark, f"file://{tmp_path}/index", buckets=4, fanout=9)
    for k in range(2):
        index.add(spark.range(1000 * k, 1000 * k + 1000).selectExpr("id AS h1", "id AS h2", "7L AS docs", "id AS keeper"))
    merged = index.settled()
    merged.collect()
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and merged.count() == 2000
    index.close(remove=True)


# fill in the middle


def test_fill_middle_equals_sql(make, words):
    rows = [(i, "\n".join(words(1 + i % 9, f"{i}{k}") for k in range(i % 40)) + "\n" * (i % 2), "en", "a") for i in range(200)]
    rows += [(300, None), (301, ""), (302, "\n"), (303, "\n\n\n"), (304, "a<P>b"), (305, "<"), (306, "x<S"), (307, "<M\n>"), (308, "\r\n é\n\x0c\x00🙂"), (309, "no end"), (None, "no id\ntwo"), (310, "rep\neated\n"), (310, "rep\neated\n")]
    rows += [(320 + i, "<\n<M\n<S\n<P\nP>\nM>\nS>\n>" * 3, "en", "a") for i in range(40)]
    rows += [(400, "line é\n" * 100_000, "en", "a"), (401, "one line " * 100_000, "en", "a")]
    df = make(rows)
    got = same(fill_middle.digests(df), fill_middle.ORACLE, documents=df)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.digests(make([])).count() == 0


def test_fill_middle_keeps_all_columns_and_rates(make):
    df = make([(i, "a\nb\nc\n", "en", "s") for i in range(400)])
    out = fill_middle.transform(df, seed=3, rate=30, spm=80).collect()
    plain = sum(r.form == "plain" for r in out)
    assert 240 < plain < 320 and all(r.output == "a\nb\nc\n" for r in out if r.form == "plain") and out[0].row.kept == "x"
    assert sum(r.form == "spm" for r in out) > sum(r.form == "psm" for r in out)


PIECES = st.sampled_from(["a", "é", "\n", "<", ">", "P", "S", "M", "🙂", "\r", "\n\n"])


@settings(max_examples=200, deadline=None)
@given(st.lists(PIECES, max_size=60).map("".join), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1), st.integers(0, 99), st.integers(1, 9))
def test_ropes_split_join_and_invert(text, h1, h2, h4, size):
    import re

    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    tree = fill_middle.rope(text, size)
    assert (tree.units, tree.chars, fill_middle.written(tree)) == (len(units), len(text), text)
    for k in range(len(units) + 2):
        a, b = fill_middle.split(tree, k, "units")
        assert (fill_middle.written(a), fill_middle.written(b)) == ("".join(units[:k]), "".join(units[k:])) and a.units == min(k, len(units))
    for k in range(len(text) + 2):
        a, b = fill_middle.split(tree, k, "chars")
        assert (fill_middle.written(a), fill_middle.written(b)) == (text[:k], text[k:])
    n, form, prefix, middle, out = fill_middle.rearranged(text, h1, h2, 0, h4, 100, 50, size)
    assert fill_middle.original(out, form, size) == text and n == len(units)
    if form != "plain":
        lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
        assert (prefix, middle) == (len("".join(units[:lo])), len("".join(units[lo:hi])))


def test_ropes_stay_balanced():
    tree = fill_middle.rope("line\n" * 50_000)

    def depth(x):
        return 0 if x.left is None else 1 + max(depth(x.left), depth(x.right))

    assert depth(tree) <= 9
    a, b = fill_middle.split(tree, 33_333, "units")
    assert max(depth(a), depth(b)) <= 10


# license scans: what was missed


def found(make, texts):
    from dendrolake.llm import license_scan

    got = defaultdict(list)
    for r in license_scan.license_matches(make([(i, t) for i, t in enumerate(texts)])).collect():
        got[r.doc_id].append(r.license)
    return [sorted(got[i]) for i in range(len(texts))]


def test_list_marks_and_versions_do_not_hide_licenses(make):
    from dendrolake.llm.license_scan import TEMPLATES as t

    def marked(name, *marks):
        text = t[name]
        for n, m in zip("123", marks):
            text = text.replace(f"{n}. ", f"{m} ")
        assert text != t[name]
        return text

    texts, want = [], []
    for name in ("BSD-2-Clause", "BSD-3-Clause", "Zlib"):
        for marks in ("***", "abc", ("a)", "b)", "c)"), ("(i)", "(ii)", "(iii)"), "---"):
            texts.append(marked(name, *marks))
            want.append([name])
        texts.append(t[name])
        want.append([name])
    words = t["MIT"].split()
    texts += [" ".join(words[:40] + ["3"] + words[40:]), " ".join(words[:60] + ["sa", "2.0"] + words[60:])]
    want += [["MIT"], ["MIT"]]
    for name in ("GPL-3.0-notice", "GPL-2.0-notice"):
        digit = name[4]
        texts.append(t[name].replace(f" {digit}", f" {digit}.0", 1) if f" {digit}.0" not in t[name] else t[name].replace(f" {digit}.0", f" {digit}", 1))
        want.append([name])
    assert found(make, texts) == want


def test_short_forms_and_strangers(make):
    texts = ["// SPDX-License-Identifier: MIT\nint main;", "# SPDX-License-Identifier: Apache-2.0", "SPDX-License-Identifier: GPL-2.0-or-later", "under the Apache License 2.0, see there", "an Apache-2.0 license applies"]
    assert [x[:1] for x in found(make, texts)] == [["MIT-spdx"], ["Apache-2.0-spdx"], ["GPL-2.0-or-later-spdx"], ["Apache-2.0-name"], ["Apache-2.0-short"]]
    assert found(make, ["GNU General Public License, version 4", "SPDX-License-Identifier: Nokia", "an apache helicopter and a license to fly 2 of them", "Apache License, Version 3.0"]) == [[], [], [], []]


def test_each_license_is_missed_by_none_of_many_changes(make):
    """Brute force over what is missed: every template, changed at random in a few words, is found where its longest common subsequence says it is there."""
    from dendrolake.llm import license_scan

    rng, texts, names = random.Random(11), [], []
    for name, template in license_scan.TEMPLATES.items():
        w = template.split()
        own = set(license_scan.words_of(template))
        for _ in range(3):
            v = list(w)
            for k in rng.sample(range(len(v)), len(v) // 25):
                if not set(license_scan.words_of(v[k])) & license_scan.TELLING:
                    v[k] = rng.choice(["", "changed", v[k] + " indeed", "7"])
            assert own
            texts.append("Some words before it. " + " ".join(v) + " And some after.")
            names.append(name)
    missed = [(n, x) for n, x in zip(names, found(make, texts)) if n not in x]
    assert not missed
