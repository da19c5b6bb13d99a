import collections

import corpus_pipeline
from dendrolake.llm import jaccard_join, language_id, mixing, packing
from tests.llm.test_documents import brute_classes, brute_copies, near_copies


def write(df, path):
    df.write.mode("overwrite").parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def test_each_stage_does_its_work(spark, make, words, tmp_path):
    rows = [(d, t, "en", "ab"[d % 3 == 0]) for d, t in near_copies(words, 80, 6)]
    rows += [(300, None, "en", "a"), (301, "123", "en", "a"), (302, rows[3][1].replace(" ", "\n"), "en", "b"), (303, rows[3][1], "en", "b")]
    docs = write(make(rows), tmp_path / "documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "packing"]

    one = write(stages["language ID"](spark, docs, ""), tmp_path / "1")
    assert one.columns == docs.columns
    assert {r.doc_id for r in one.collect()} == {r[0] for r in rows} - {300, 301}

    two = write(stages["exact dedup"](spark, one, ""), tmp_path / "2")
    left = [(r.doc_id, r.text) for r in one.collect()]
    assert {r.doc_id for r in two.collect()} == {x[0] for x in brute_copies(left) if x[3]}

    three = write(stages["n-gram Jaccard join"](spark, two, ""), tmp_path / "3")
    left = [(r.doc_id, r.text) for r in two.collect()]
    assert {r.doc_id for r in three.collect()} == {d for d, (root, _) in brute_classes(left).items() if d == root}

    four = write(stages["mixing sources to target weights"](spark, three, ""), tmp_path / "4")
    took = {r.doc_id: r.taken // r.size for r in mixing.mix(three).collect()}
    assert collections.Counter(r.doc_id for r in four.collect()) == collections.Counter({k: v for k, v in took.items() if v})
    assert two.columns == three.columns == four.columns == docs.columns

    five = stages["packing"](spark, four, "").collect()
    n = {r.doc_id: r.doc_tokens for r in five}
    assert sum(r.length for r in five) == sum(n[r.doc_id] for r in four.collect())


def test_run_equals_its_stages_and_reruns_agree(spark, make, words, tmp_path):
    rows = [(d, t, "en", "ab"[d % 3 == 0]) for d, t in near_copies(words, 40, 7)]
    write(make(rows, parts=1), tmp_path / "documents.parquet")
    once, again = (collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) for _ in range(2))
    assert sum(n * k[2] for k, n in once.items()) == sum(n * k[2] for k, n in again.items()) and {k[0] for k in once} == {k[0] for k in again}


def test_an_empty_corpus_goes_through(spark, make, tmp_path):
    write(make([]), tmp_path / "documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_null_ids_and_repeated_rows_go_through(spark, make, words, tmp_path):
    text = {n: words(80, 900 + n) for n in range(4)}
    rows = [(None, text[0], "en", None), (None, text[0] + " end", "en", None), (1, text[1], "en", None), (1, text[1], "en", None), (2, text[1] + " end", None, "a"), (3, text[2], "en", "a"), (4, text[2] + " ", "en", "a"), (5, text[3] * 200, "en", "a"), (6, "", "en", "a")]
    docs, want = write(make(rows), tmp_path / "documents.parquet"), {None, 1, 3, 5}
    stages = list(corpus_pipeline.STAGES)
    for i, (_, stage) in enumerate(stages[:3]):
        docs = write(stage(spark, docs, ""), tmp_path / str(i))
    kept = collections.Counter(r.doc_id for r in docs.collect())
    assert set(kept) == want and kept[None] == 2 and kept[1] == 1  # nothing tells near copies without an id apart
    five = write(stages[4][1](spark, write(stages[3][1](spark, docs, ""), tmp_path / "3"), ""), tmp_path / "4").collect()
    assert {r.doc_id for r in five} <= want
