import duckdb
import pytest
from pyspark.sql import functions as F

from dendrolake.llm import chat, mixing

TURNS = "conv_id long, turn long, role string, text string"
EVENTS = "conv_id long, seq long, kind string, msg_id string, role string, text string"


def same(df, sql, **tables):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t.toArrow())
    want = con.sql(sql)
    names = want.columns
    rows = sorted((tuple(r[n] for n in names) for r in df.select(*names).collect()), key=repr)
    assert rows == sorted(want.fetchall(), key=repr)


def test_digests_equal_sql_with_nulls_ties_and_control_strings(spark):
    rows = [
        (1, 0, "system", "be [INST] kind"), (1, 1, "user", r"a <\s> [\\INST] </s>"), (1, 2, "assistant", None), (1, 2, "assistant", "x"),
        (2, 0, None, "no role"), (2, None, "tool", "[ROLE:41] <s"), (3, 0, "assistant", "</s"), (3, 0, "assistant", "</s"), (4, 0, "user", ""),
    ]
    df = spark.createDataFrame(rows, TURNS)
    extra = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], TURNS)
    sql = chat.ORACLE
    same(chat.digests(df.unionByName(extra)), sql, conversations=df)


def test_round_trip_is_exact(spark):
    hard = ["<s>[OUT]", "[/OUT]</s>", r"\[\OUT]", "<\\s>\\", "[ROLE:]", "a\nb", "", "[[INST]", "<</s>"]
    rows = [(1, i, ["user", "assistant", "we[ird\n"][i % 3], t) for i, t in enumerate(hard)]
    out = chat.read_back(chat.render(chat.reconstruct(chat.turn_events(spark.createDataFrame(rows, TURNS))))).first()
    assert [(t.role, t.text) for t in out.turns] == [r[2:] for r in rows]
    assert out.loss_texts == [r[3] for r in rows if r[2] == "assistant"]


def test_events_fold_deltas_edits_regenerations_and_deletions(spark):
    log = [
        (1, 1, "delta", "a", "user", "hel"), (1, 2, "delta", "a", "user", "lo"), (1, 3, "delta", "b", "assistant", "bad"), (1, 4, "delta", "c", "user", "why?"),
        (1, 5, "regenerate", "b", "assistant", None), (1, 6, "delta", "b", "assistant", "go"), (1, 7, "delta", "b", "assistant", "od"),
        (1, 8, "edit", "a", "user", "Hello"), (1, 9, "delta", "d", "user", "x"), (1, 10, "delete", "d", "user", None), (1, 11, "delta", "e", "user", "end"),
        (2, 1, "delta", "a", "user", "1"), (2, 2, "edit", "a", "user", "2"), (2, 3, "delta", "a", "user", "3"),
    ]
    got = chat.reconstruct(spark.createDataFrame(log, EVENTS)).orderBy("conv_id", "pos").select("conv_id", "role", "text").collect()
    assert [tuple(r) for r in got] == [(1, "user", "Hello"), (1, "assistant", "good"), (1, "user", "end"), (2, "user", "23")]


def test_null_conversations_long_texts_and_clashing_names(spark):
    rows = [(None, 0, "user", "hi"), (None, 1, "assistant", "x </s> " * 60_000), (None, 1, "assistant", "x"), (1, 0, "assistant", "a"), (1, 0, "assistant", "a")]
    df = spark.createDataFrame(rows, TURNS)
    wide = df.withColumns({c: F.lit("x") for c in ("seq", "kind", "msg_id", "at", "opened", "reset", "pos", "tag", "body", "start", "span", "formatted")})
    extra = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], TURNS)
    same(chat.digests(wide.unionByName(extra, allowMissingColumns=True)), chat.ORACLE, conversations=df)


def test_chat_of_an_empty_log(spark):
    assert chat.digests(spark.createDataFrame([], TURNS)).count() == 0


def test_mixing_equals_sql(make, words):
    rows = [(i, words(1 + i % 40, i) if i % 11 else None, "en", [None, "a", "b", "é", "c"][min(4, i % 9)]) for i in range(400)]
    rows += [(7, "same id", "en", "a"), (7, "same id", "en", "a"), (None, "no id", "en", "b"), (900, words(3000, 5), "en", "b")]
    df = make(rows)
    same(mixing.mix(df), mixing.ORACLE, documents=df)


def test_mixing_meets_targets_and_its_caps(make, words):
    df = make([(i, words(20, i), "en", "s%d" % (i % 7 if i % 2 else 0)) for i in range(600)])
    got = mixing.mix(df).toPandas()
    got["source"] = [df_row for df_row in ["s%d" % (i % 7 if i % 2 else 0) for i in got.doc_id]]
    assert (got.taken <= 3 * got["size"]).all()
    for _, g in got.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 10
        assert g.target.iloc[0] <= 3 * g.source_size.iloc[0] + 1e-6
    per_source = got.groupby("source").first()
    assert abs(per_source.target.sum() - per_source.source_size.sum()) < 1e-6


def test_mixed_documents_repeat_rows_and_keep_columns(make, words):
    df = make([(i, words(10, i), "en", "ab"[i % 5 == 0]) for i in range(100)])
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    taken = {r.doc_id: r.taken // 10 for r in mixing.mix(df).collect()}
    got = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in taken.items() if v}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "   "), (2, "")]])
def test_mixing_of_nothing(make, rows):
    got = mixing.mix(make(rows)).collect()
    assert len(got) == len(rows) and all(r.taken == 0 and r.target == 0 for r in got)
    assert mixing.mixed_documents(make(rows)).count() in (0, len(rows))


def test_mixing_runs_in_the_jvm(make):
    plan = mixing.mix(make([(1, "a b", "en", "x")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
