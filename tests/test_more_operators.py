"""Operators against plain versions, and every JSON source on files laid down here."""

import collections
import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from textquarry.functions import chunking
from textquarry.operators import context, dense, fusion, judge, lexical, metrics, replay, tools
from textquarry.sources import corpus


def test_json_that_cannot_be_read_is_passed_over():
    assert tools.first_object('{"a":' * 100_000 + '1 {"k": 2}') == {"k": 2}  # truncated and far too deep
    assert tools.first_object('{"n": ' + "9" * 5000 + '} then {"k": 3}') == {"k": 3}
    assert tools.first_object('{"s": "a \\" } {", "t": {"u": "}"}} tail') == {"s": 'a " } {', "t": {"u": "}"}}
    assert tools.first_object('text \\" {"a": 1}') == {"a": 1} and tools.first_object("{'a': {\"b\": 1}}") == {"b": 1}
    assert tools.first_object(None) is None and tools.first_object("") is None and tools.first_object("}{") is None


def _plain_first(text):
    """Every start by itself."""
    for start in [i for i, c in enumerate(text) if c == "{"]:
        depth, quoted, escaped = 0, False, False
        for i in range(start, len(text)):
            c = text[i]
            if escaped:
                escaped = False
            elif quoted and c == "\\":
                escaped = True
            elif c == '"':
                quoted = not quoted
            elif not quoted and c in "{}":
                depth += 1 if c == "{" else -1
                if depth == 0:
                    try:
                        return json.loads(text[start : i + 1])
                    except ValueError:
                        break
    return None


def test_first_object_equals_trying_every_start():
    rng = random.Random(1)
    parts = ["{", "}", '"', "\\", '"a"', ": ", "1", ", ", "[", "]", " x ", '{"k": 1}', '{"q": "}"}']
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 12)))
        assert tools.first_object(text) == _plain_first(text), text


def _plain_bm25(docs, query, k1=1.2, b=0.75):
    words = {i: re.findall(r"\w+", (t or "").lower()) for i, t in docs.items()}
    n, avg = len(docs), sum(map(len, words.values())) / len(docs)
    df = collections.Counter(w for ws in words.values() for w in set(ws))
    out = {}
    for i, ws in words.items():
        tf, score = collections.Counter(ws), 0.0
        for w in re.findall(r"\w+", query.lower()):
            if tf[w]:
                score += math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(ws) / avg))
        if score > 0:
            out[i] = round(score, 9)
    return out


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_bm25_against_a_plain_version(spark, monkeypatch, most):
    monkeypatch.setattr(lexical, "BROADCAST_MOST", most)  # 0: nothing is broadcast
    rng = random.Random(2)
    words = ["ant", "bee", "cat", "dog", "eel", "fox", "gnu"]
    docs = {i: " ".join(rng.choices(words, k=rng.randint(0, 30))) for i in range(60)} | {60: None, 61: ""}
    queries = {0: "ant ant bee", 1: "fox", 2: "unknown", 3: "", 4: "cat dog eel"}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = collections.defaultdict(list)
    for r in lexical.search(df, spark.createDataFrame(list(queries.items()), "query_id long, text string"), 7).collect():
        got[r.query_id].append((r["rank"], r.doc_id, r.score))
    for q, text in queries.items():
        want = sorted(_plain_bm25(docs, text).items(), key=lambda x: (-x[1], x[0]))[:7]
        assert [(d, pytest.approx(s, abs=1e-8)) for _, d, s in sorted(got[q])] == want
    assert lexical.search(df.limit(0), spark.createDataFrame([(1, "a")], "query_id long, text string")).count() == 0


def test_bm25_shuffles_once_before_the_best_are_chosen(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = lexical.search(docs, docs.withColumnRenamed("doc_id", "query_id"))._jdf.queryExecution().toString()
    chosen = plan[plan.index("== Physical Plan ==") :]
    assert "WindowGroupLimit" in chosen and "SortMergeJoin" not in chosen and chosen.count("hashpartitioning(query_id") >= 1
    assert not re.search(r"hashpartitioning\((term|doc_id)#\d+L?, (term|doc_id)", chosen)


def test_chunks_of_a_huge_document_stay_its_own(spark):
    text = "needle " + "x" * 99  # one chunk a character: more than 100,000 of them
    docs = spark.createDataFrame([(1, "y" * 100_050 + " needle"), (2, text)], "doc_id long, text string")
    from textquarry.plans import retrieval

    chunks = chunking.chunks(docs, "fixed", size=10, overlap=9)
    assert chunks.filter("doc_id = 1").count() > 100_000
    ranked = retrieval._documents(retrieval._chunk_ranked(chunks, spark.createDataFrame([(0, "needle")], "query_id long, text string")))
    assert sorted((r.query_id, r.doc_id) for r in ranked.collect()) == [(0, 1), (0, 2)]


@pytest.mark.parametrize("block", [4096, 3])
def test_cosine_against_a_plain_version(spark, monkeypatch, block):
    monkeypatch.setattr(dense, "QUERY_BLOCK", block)
    rng = random.Random(3)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(3)]) for i in range(80)]  # many ties and zeros
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = collections.defaultdict(list)
    for r in dense.cosine_search(df.filter("vec_id % 10 = 0"), df, 6, but_self=True).collect():
        got[r.query_id].append((r["rank"], r.doc_id, r.score))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    norm = lambda a: math.sqrt(dot(a, a))
    for q in range(0, 80, 10):
        v = rows[q][1]
        score = {i: round(-1.0 if not norm(x) else dot(v, x) / (norm(v) or 1.0) / norm(x), 9) for i, x in rows if i != q}
        want = sorted(score.items(), key=lambda s: (-s[1], s[0]))[:6]
        assert [(d, pytest.approx(s, abs=1e-9)) for _, d, s in sorted(got[q])] == want
    assert dense.cosine_search(df.limit(0), df).count() == 0 and dense.cosine_search(df, df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        dense.cosine_search(df, df, 0)


@pytest.mark.parametrize("rows, columns, k", [(7, 50, 5), (3, 4, 4), (5, 40, 1), (4, 30, 29)])
def test_largest_is_a_stable_sort_cut_at_k(rows, columns, k):
    import numpy as np

    from textquarry.operators.dense import _largest

    worth = np.random.default_rng(1).integers(0, 4, (rows, columns)).astype(float)
    worth[0, :3] = -np.inf
    row, column = _largest(worth, k)
    assert (row == np.repeat(np.arange(rows), k)).all()
    assert (column.reshape(rows, k) == np.argsort(-worth, axis=1, kind="stable")[:, :k]).all()


def test_vectors_of_other_lengths_and_nan(spark):
    docs = spark.createDataFrame([(0, [1.0, float("nan")]), (1, [1.0, 0.0]), (2, None)], "vec_id int, embedding array<double>")
    q = spark.createDataFrame([(9, [1.0, 1.0])], "vec_id int, embedding array<double>")
    assert [(r.doc_id, r.score is None) for r in dense.cosine_search(q, docs).orderBy("rank").collect()] == [(1, False), (0, True)]
    with pytest.raises(Exception, match="differ in length"):
        dense.cosine_search(spark.createDataFrame([(9, [1.0])], "vec_id int, embedding array<double>"), docs).collect()


def test_common_prefix_against_a_plain_version(spark):
    rng = random.Random(4)
    pairs = [("".join(rng.choices("ab😀", k=rng.randint(0, 9))), "".join(rng.choices("ab😀", k=rng.randint(0, 9)))) for _ in range(300)]
    pairs += [("x" * 70_001, "x" * 70_000 + "y"), ("x" * 65_536, "x" * 65_536)]
    df = spark.createDataFrame(pairs, "a string, b string")
    plain = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert all(r.n == plain(r.a, r.b) for r in df.withColumn("n", context.common_prefix_length(F.col("a"), F.col("b"))).collect())


def test_rerank_loses_no_candidate(spark):
    base = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "query_id int, doc_id int, rank int")
    queries = spark.createDataFrame([(1, "q")], "query_id int, query string")
    texts = spark.createDataFrame([(5, "a"), (6, "bbb")], "doc_id int, text string")
    scorer = lambda q, t: F.length(t)
    assert [r.doc_id for r in fusion.rerank(base, queries, texts, scorer, 2).orderBy("rank").collect()] == [6, 5]
    with pytest.raises(Exception, match="no text or query for candidate 6"):
        fusion.rerank(base, queries, texts.filter("doc_id = 5"), scorer, 2).collect()
    with pytest.raises(ValueError):
        fusion.rerank(base, queries, texts, scorer, 2, 0)
    model = lambda: lambda pairs: [float(len(t)) for _, t in pairs]
    assert [r.doc_id for r in fusion.rerank(base, queries, texts, replay.cross_encoder(model), 2).orderBy("rank").collect()] == [6, 5]
    broken = lambda: lambda pairs: [float("nan") for _ in pairs]
    with pytest.raises(Exception, match="NaN"):
        fusion.rerank(base, queries, texts, replay.cross_encoder(broken), 2).collect()


def test_best_by_breaks_ties_by_name(spark):
    df = spark.createDataFrame([("x", "b", 2.0), ("x", "a", 2.0), ("x", "c", 1.0), ("y", "d", 0.0)], "k string, name string, v double")
    assert sorted((r.k, r.best, r.v) for r in metrics.best_by(df, "v", "name", ["k"]).collect()) == [("x", "a", 2.0), ("y", "d", 0.0)]
    assert [(r.best, r.v) for r in metrics.best_by(df, "v", "name").collect()] == [("a", 2.0)]


def test_judgements_and_truth_must_pair(spark):
    j = spark.createDataFrame([(1, True), (2, None)], "id int, verdict boolean")
    t = spark.createDataFrame([(1, True), (2, False)], "id int, truth boolean")
    assert judge.agreement(judge.paired(j, t, "id")).first().undecided == 1
    for a, b in ((j, t.filter("id = 1")), (j.filter("id = 1"), t), (j.union(j), t)):
        with pytest.raises(Exception, match="differ at"):
            judge.paired(a, b, "id").collect()


def test_models_by_name(spark, monkeypatch):
    requests = spark.createDataFrame([("k1", "m", "hello"), ("k2", "m", "there"), ("k2", "m", "there")], "key string, model string, prompt string")
    store = spark.createDataFrame([("k1", "m", "old")], "key string, model string, text string")
    shout = lambda: str.upper
    recorded = replay.record(requests, store, shout, "ollama")
    assert sorted((r.key, r.text) for r in recorded.collect()) == [("k1", "old"), ("k2", "THERE")]
    assert {r.raw for r in replay.dispatch(requests, recorded, backend="replay").collect()} == {"old", "THERE"}
    assert {r.raw for r in replay.dispatch(requests, backend="fake").collect()} == {"hello", "there"}
    assert {r.raw for r in replay.dispatch(requests, complete=shout, backend="llamacpp").collect()} == {"HELLO", "THERE"}
    with pytest.raises(ValueError):
        replay.record(requests, store, shout, "fake")
    with pytest.raises(ValueError):
        replay.dispatch(requests, backend="other")
    monkeypatch.setenv(replay.BACKEND_VARIABLE, " Replay ")
    assert replay.backend_name() == "replay"
    with pytest.raises(Exception, match="no recorded reply for key k2"):
        replay.dispatch(requests, store).collect()


def test_encoders_and_segmenter(spark):
    texts = spark.createDataFrame([(1, "ab"), (2, ""), (3, None)], "id int, text string")
    model = lambda: lambda some: [[float(len(t)), 0.0] for t in some]
    passages, queries = replay.encoded_corpus(texts, texts, model, normalize=False)
    assert [r.embedding[0] for r in passages.orderBy("id").collect()] == [11.0, 9.0, 9.0]
    assert [r.embedding[0] for r in queries.orderBy("id").collect()] == [9.0, 7.0, 7.0]
    assert [r.embedding[0] for r in replay.encoded(texts, "text", model).orderBy("id").collect()] == [1.0, 0.0, 0.0]
    assert replay.encoded(texts.limit(0), "text", model).count() == 0
    cut = lambda: lambda some: [[["[CLS]"], *[[w[0], w[1:]] for w in t.split()], ["[SEP]"]] for t in some]
    assert [r.segments for r in replay.segmented(texts, "text", cut).orderBy("id").collect()] == [[["a", "b"]], [], []]


def test_tool_schema_and_hint():
    tool = tools.Tool.of({"name": "find", "description": "Finds.", "parameters": [{"name": "where", "type": "string", "enum": ["api", "guides"]}, {"name": "n", "type": "integer", "required": False}]})
    body = tool.schema()["function"]["parameters"]
    assert body["required"] == ["where"] and body["properties"] == {"where": {"type": "string", "enum": ["api", "guides"]}, "n": {"type": "integer"}}
    assert "where: string one of ['api', 'guides']" in tool.prompt_hint() and "n: integer (optional)" in tool.prompt_hint()


def test_json_sources(spark, tmp_path):
    def laid(name, value):
        (tmp_path / name).write_text(json.dumps(value, ensure_ascii=False), encoding="utf-8")
        return str(tmp_path / name)

    path = laid("corpus.json", {"documents": [{"id": "d1", "title": "One", "text": "שלום", "source": "s"}], "queries": [{"id": "q1", "question": "?", "relevant": ["d1", "d1", "d9"], "kind": "code"}, {"id": "q2", "question": "!", "relevant": []}]})
    documents, queries, qrels = corpus.load_corpus(spark, path)
    assert documents.first().text == "שלום" and sorted((r.id, r.kind) for r in queries.collect()) == [("q1", "code"), ("q2", "other")]
    assert sorted((r.query_id, r.doc_id) for r in qrels.collect()) == [("q1", "d1"), ("q1", "d9")]
    assert [r.doc_id for r in corpus.dangling(qrels, documents.withColumnRenamed("id", "doc_id"), "doc_id").collect()] == ["d9"]
    assert corpus.load_cases(spark, laid("cases.json", {"cases": [{"question": "q", "fact": "f", "criterion": "c", "kept": "k", "lost": "l"}]})).first().lost == "l"
    summary, cap, probes = corpus.load_probes(spark, laid("probes.json", {"summary": "S", "cap": 120, "probes": [{"fact": "f", "question": "q", "filler": ["a", "b"]}]}))
    assert (summary, cap, context.planted_probe(probes).count()) == ("S", 120, 7)
    attempts, made, tasks = corpus.load_tasks(spark, laid("tasks.json", {"max_attempts": 3, "tools": [{"name": "t", "description": "d", "parameters": [{"name": "n", "type": "integer"}]}], "tasks": ["x", "y"]}))
    assert attempts == 3 and tools.Tool.of(made[0]).parameters[0].name == "n" and [r.task for r in tasks.orderBy("task_id").collect()] == ["x", "y"]
    assert {r.word: r.pieces for r in corpus.load_segmentation(spark, laid("seg.json", {"words": {"בשרת": ["ב", "שרת"], "שם": ["שם"]}})).collect()} == {"בשרת": ["ב", "שרת"], "שם": ["שם"]}
    folder = tmp_path / "replies"
    folder.mkdir()
    for key in ("b", "a"):
        (folder / f"{key}.json").write_text(json.dumps({"key": key, "model": "m", "request": {"messages": [{"content": "c", "role": "user"}], "params": {"max_tokens": 1, "seed": 7, "temperature": 0.0}, "tools": None}, "response": {"text": f"re {key}", "tool_calls": [{"name": None, "arguments": "{}"}]}}, indent=2))
    replies = corpus.load_replies(spark, str(folder))
    assert [r.key for r in corpus.keys(replies).collect()] == ["a", "b"]
    assert replies.select(replay.called_tools(F.col("tool_calls")).alias("t")).first().t == [""]
    corpus.save_replies(replies.select("key", "model", "text"), str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2


def test_contexts_find_their_passage(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b")], "id int, text string")
    assert sorted((r.id, r.passage) for r in corpus.passage_index(df, "text", "id").collect()) == [(1, 1), (2, 2), (3, 1)]


def test_events_per_window_in_a_stream(spark, tmp_path):
    from textquarry.streaming import history

    spark.sql("SELECT timestamp '2024-01-01 00:10:00' + make_interval(0, 0, 0, 0, 0, CAST(10 * id AS INT)) AS ts, 'e' AS event_type FROM range(12)").write.parquet(str(tmp_path / "in"))
    stream = history.events_per_window(spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.n for r in spark.table("windows").collect()) == [1, 5, 6]
