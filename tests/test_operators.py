import json

import pytest
from pyspark.sql import functions as F

from textquarry.functions import chunking, text
from textquarry.operators import context, dense, fusion, judge, lexical, metrics, replay, tools


def test_fixed_windows(spark):
    df = spark.createDataFrame([("a", "x" * 100), ("b", "x" * 20), ("c", "")], "doc_id string, text string")
    rows = chunking.chunks(df, "fixed", size=30, overlap=10).filter("doc_id = 'a'").collect()
    assert [r.start for r in rows] == [0, 20, 40, 60, 80]
    assert chunking.chunks(df, "fixed", size=10, overlap=9).filter("doc_id = 'b'").count() == 11
    assert chunking.chunks(df, "fixed", size=10, overlap=9).filter("doc_id = 'c'").count() == 0


@pytest.mark.parametrize(("size", "overlap"), [(0, 0), (10, -1), (10, 10)])
def test_bad_sizes(size, overlap):
    with pytest.raises(ValueError):
        chunking.check(size, overlap)


def test_separator_chunks():
    t = "alpha\n\n   beta   \n\ngamma"
    assert [t[s:e] for s, e in chunking.structure_spans(t, 6)] == ["alpha", "beta", "gamma"]
    assert len(chunking.structure_spans(t, 200)) == 1
    sentences = "This is sentence one. " * 6
    spans = chunking.recursive_spans(sentences, 60, 30)
    assert 60 < max(e - s for s, e in spans) <= 90
    assert chunking.recursive_spans("word " * 50 + "x" * 100, 20, 0)[-1][1] == 350


def test_bm25_drops_what_shares_no_word(spark):
    docs = spark.createDataFrame([(0, "the cat sat"), (1, "error TS 999 raised"), (2, "nothing here"), (3, "")], "doc_id int, text string")
    q = spark.createDataFrame([(1, "TS-999")], "query_id int, text string")
    assert [r.doc_id for r in lexical.search(docs, q).collect()] == [1]
    with pytest.raises(ValueError):
        lexical.check(1.2, 1.5)


def test_rrf(spark):
    lists = [[0, 90, 1, 91, 92, 93, 94, 95, 96, 97], [80, 81, 1, 82, 83, 84, 85, 86, 87, 0]]
    frames = [spark.createDataFrame([(1, d, r) for r, d in enumerate(x, 1)], "query_id int, doc_id int, rank int") for x in lists]
    got = {r.doc_id: (r.score, r.rank) for r in fusion.rrf(frames).collect()}
    assert got[1][1] == 1 and abs(got[0][0] - (1 / 61 + 1 / 70)) < 1e-9
    with pytest.raises(ValueError):
        fusion.rrf(frames, 0)


def test_cosine(spark):
    docs = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [-1.0, -1.0]), (3, [0.0, 0.0])], "vec_id int, embedding array<double>")
    q = spark.createDataFrame([(9, [1.0, 1.0])], "vec_id int, embedding array<double>")
    rows = dense.cosine_search(q, docs).orderBy("rank").collect()
    assert [r.doc_id for r in rows] == [1, 0, 2, 3] and rows[-1].score == -1.0


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, d, r) for r, d in enumerate([10, 11, 12, 13, 14], 1)], "query_id int, doc_id int, rank int")
    qrels = spark.createDataFrame([(1, 11), (1, 14), (1, 99)], "query_id int, doc_id int")
    queries = spark.createDataFrame([(1,), (2,)], "query_id int")
    rows = {r.query_id: r for r in metrics.per_query(ranked, qrels, queries, [2, 5]).collect()}
    assert (rows[1].recall_2, rows[1].recall_5, rows[1].precision_5, rows[1].rr) == (pytest.approx(1 / 3), pytest.approx(2 / 3), 0.4, 0.5)
    assert rows[2].recall_5 == rows[2].ndcg_5 == rows[2].rr == 0.0


def test_hebrew(spark):
    words = {"ובמסמכים": "וב+מסמכים", "מידע": "מ+ידע", "של": "של", "abc": "abc", "": ""}
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.array_join(text.strip_prefixes(F.col("w")), "+").alias("p"))
    assert {r.w: r.p for r in df.collect()} == words
    assert spark.range(1).select(text.normalize(F.lit("שָׁלוֹם"))).first()[0] == "שלום"
    assert spark.range(1).select(text.fold_finals(F.lit("ארץ"))).first()[0] == "ארצ"


def test_replies(spark):
    said = {"Yes.": True, "no way": False, "it depends": None, "true, not false": True, "לא": False, "nothing": None}
    df = spark.createDataFrame([(s,) for s in said], "s string").select("s", judge.read_yes_no(F.col("s")).alias("v"))
    assert {r.s: r.v for r in df.collect()} == said
    scores = {"4": 4, "10 or 45": None, "rate: 5.": 5, "": None}
    df = spark.createDataFrame([(s,) for s in scores], "s string").select("s", judge.read_score(F.col("s")).alias("v"))
    assert {r.s: r.v for r in df.collect()} == scores


def test_agreement(spark):
    df = spark.createDataFrame([(True, t) for t in [True] * 8 + [False] * 2] + [(None, True)], "verdict boolean, truth boolean")
    r = judge.agreement(df).first()
    assert (r.n, r.undecided, r.accuracy, r.said_yes, r.false_positive, r.false_negative) == (10, 1, 0.8, 1.0, 1.0, 0.0)


def test_context(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    n = lambda a, b: one(context.common_prefix_length(F.lit(a), F.lit(b)))
    assert [n("abcdef", "abcXYZ"), n("", "abc"), n("ab", "abc"), n("a😀b", "a😀c"), n("same", "same")] == [3, 0, 2, 2, 4]
    assert one(context.cap_tool_output(F.lit("x" * 121), 120)) == "x" * 120 + " ...[truncated]"
    turns = spark.createDataFrame([(1, t, "user", str(t)) for t in range(5)], "conv_id int, turn long, role string, text string")
    assert [r.text for r in context.summarise_old(turns, 2, "S").orderBy("turn").collect()] == ["S", "3", "4"]
    assert context.summarise_old(turns, 0, "S").count() == 1 and context.summarise_old(turns, 9, "S").count() == 5


def test_tools(spark):
    assert tools.first_object('so {"a": {"b": "}"}} ok') == {"a": {"b": "}"}}
    assert tools.first_object('{bad {"k": 1}') == {"k": 1}
    assert tools.first_object("[1]") is None and tools.first_object('{"a": 1') is None
    tool = tools.Tool("t", "d", (tools.Parameter("n", "integer"), tools.Parameter("m", "string", required=False, enum=("a",))))
    assert tools.problems(tool, {"n": 1, "m": None}) == [] and tools.problems(tool, {"n": True}) == ["`n` must be a integer, got boolean"]
    assert tools.problems(tool, {"m": "b", "z": 1}) == ["missing required key `n`", "`m` must be one of ['a'], got 'b'", "unknown key `z`"]
    assert tools.problems(tool, {"n": None}) == ["`n` must be a integer, got NoneType (null)"]
    with pytest.raises(ValueError, match="primitive"):
        tools.Parameter("x", "object")
    tasks = spark.createDataFrame([(1, "good"), (2, "late"), (3, "never")], "task_id int, task string")
    answer = lambda df: df.withColumn("raw", F.when((F.col("task") == "good") | ((F.col("task") == "late") & (F.col("attempt") > 1)), F.lit('{"n": 1}')).otherwise("no"))
    r = tools.repair_summary(tools.run_tasks(tool, tasks, answer)).first()
    assert (r.n, r.first_try, r.eventually, r.never, r.mean_tries) == (3, pytest.approx(1 / 3, abs=1e-6), pytest.approx(2 / 3, abs=1e-6), pytest.approx(1 / 3, abs=1e-6), 2.0)


def test_replay_key(spark):
    import hashlib

    request = {"messages": [{"content": "hé\n", "role": "user"}], "model": "m", "params": {"max_tokens": 8, "seed": 7, "temperature": 0.0}, "tools": None}
    want = hashlib.sha256(json.dumps(request, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()[:16]
    got = replay.key_of(replay.canonical_request(F.lit("m"), F.lit("hé\n"), F.lit(8), F.lit(7), F.lit(0.0)))
    asked = spark.range(1).select(got.alias("key"))
    assert asked.first()[0] == want
    store = spark.createDataFrame([(want, "yes")], "key string, text string")
    assert replay.replay(asked, store).first().raw == "yes" and replay.misses(asked, store).count() == 0


def test_stream_caps(spark, tmp_path):
    from textquarry.streaming import history

    spark.createDataFrame([(1, 0, "tool", "x" * 50), (1, 1, "user", "y" * 50)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "in"))
    history.write_capped(history.read_turns(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"), 10).awaitTermination()
    assert sorted(len(r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [25, 50]
