"""The content-addressed store of replies: keys, replay by join, and model backends."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BACKENDS = ("ollama", "llamacpp", "replay", "fake")
#: The environment variable that names the backend.
BACKEND_VARIABLE = "TEXTQUARRY_BACKEND"


def canonical_request(model: Column, prompt: Column, max_tokens: Column, seed: Column, temperature: Column) -> Column:
    """The request of one user message as JSON: keys in order at every level, nulls kept, no white space."""
    message = F.struct(prompt.alias("content"), F.lit("user").alias("role"))
    params = F.struct(max_tokens.alias("max_tokens"), seed.alias("seed"), temperature.alias("temperature"))
    return F.to_json(F.struct(F.array(message).alias("messages"), model.alias("model"), params.alias("params"), F.lit(None).cast("string").alias("tools")), {"ignoreNullFields": "false"})


def key_of(canonical: Column) -> Column:
    return F.substring(F.sha2(canonical.cast("binary"), 256), 1, 16)


def misses(requests: DataFrame, store: DataFrame) -> DataFrame:
    """Requests whose key was never recorded."""
    return requests.join(store.select("key"), "key", "left_anti")


def recorded(requests: DataFrame, store: DataFrame) -> DataFrame:
    return requests.join(store.select("key"), "key", "left_semi")


def replay(requests: DataFrame, store: DataFrame) -> DataFrame:
    """Requests with their recorded reply as `raw`; a request without one is an error that says what to do."""
    replies = store.select("key", F.col("text").alias("raw"), F.lit(True).alias("_found")).dropDuplicates(["key"])
    joined = requests.join(replies, "key", "left")
    message = F.concat(F.lit("no recorded reply for key "), F.col("key"), F.lit("; record it with a live backend"))
    return joined.withColumn("raw", F.when(F.col("_found"), F.col("raw")).otherwise(F.raise_error(message).cast("string"))).drop("_found")


def merge(store: DataFrame, more: DataFrame) -> DataFrame:
    """Recording is idempotent: what the store has stays."""
    return store.unionByName(misses(more.dropDuplicates(["key"]), store))


def backend_name() -> str:
    name = os.environ.get(BACKEND_VARIABLE, "ollama").strip().lower()
    if name not in BACKENDS:
        raise ValueError(f"unknown backend {name!r}; choose from {', '.join(BACKENDS)}")
    return name


def recording_backend() -> str:
    if (name := backend_name()) in ("replay", "fake"):
        raise ValueError(f"backend {name!r} makes no real call, so there is nothing to record")
    return name


def live(requests: DataFrame, complete: Callable[[], Callable[[str], str]]) -> DataFrame:
    """Replies of a model: complete() loads it once in each task and gives prompt -> text."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in requests.schema)}, raw string"

    def run(batches):
        ask = complete()
        for pdf in batches:
            yield pdf.assign(raw=[ask(p) for p in pdf["prompt"]])

    return requests.mapInPandas(run, schema)


def fake() -> Callable[[str], str]:
    """Echoes the prompt; for tests."""
    return lambda prompt: prompt


def ollama(model: str, url: str = "http://localhost:11434", **params) -> Callable[[], Callable[[str], str]]:
    """A chat server over HTTP."""

    def load():
        import json
        from urllib.request import Request, urlopen

        def ask(prompt: str) -> str:
            body = {"model": model, "messages": [{"role": "user", "content": prompt}], "stream": False, "options": params}
            with urlopen(Request(f"{url}/api/chat", json.dumps(body).encode(), {"Content-Type": "application/json"})) as got:
                return json.load(got)["message"]["content"]

        return ask

    return load


def llamacpp(path: str, **params) -> Callable[[], Callable[[str], str]]:
    """A model file in the worker's own process; needs llama_cpp."""

    def load():
        from llama_cpp import Llama

        model = Llama(model_path=path, verbose=False)
        return lambda prompt: model.create_chat_completion([{"role": "user", "content": prompt}], **params)["choices"][0]["message"]["content"]

    return load


def called_tools(tool_calls: Column) -> Column:
    return F.transform(tool_calls, lambda c: F.coalesce(c["name"], F.lit("")))


def record(requests: DataFrame, store: DataFrame, complete: Callable[[], Callable[[str], str]], backend: str | None = None) -> DataFrame:
    """The store with the replies that it lacked; requests: (key, model, prompt). Refuses backends that make no real call."""
    name = recording_backend() if backend is None else backend
    if name in ("replay", "fake"):
        raise ValueError(f"backend {name!r} makes no real call, so there is nothing to record")
    asked = live(misses(requests, store).dropDuplicates(["key"]), complete)
    return merge(store, asked.select("key", "model", F.col("raw").alias("text")))


def dispatch(requests: DataFrame, store: DataFrame | None = None, complete: Callable[[], Callable[[str], str]] | None = None, backend: str | None = None) -> DataFrame:
    """Requests (key, prompt) with `raw` from the named backend: the store's reply, the echo, or a live model's."""
    name = backend_name() if backend is None else backend
    if name not in BACKENDS:
        raise ValueError(f"unknown backend {name!r}; choose from {', '.join(BACKENDS)}")
    if name == "fake":
        return requests.withColumn("raw", F.col("prompt"))
    if name == "replay":
        if store is None:
            raise ValueError("replay needs the store of recorded replies")
        return replay(requests, store)
    if complete is None:
        raise ValueError(f"backend {name!r} needs its adapter, ollama(...) or llamacpp(...)")
    return live(requests, complete)


def _unit(vector) -> list[float]:
    values = [float(v) for v in vector]
    norm = sum(v * v for v in values) ** 0.5
    return [v / norm for v in values] if norm else values


def encoded(texts: DataFrame, text_col: str, load: Callable[[], Callable[[list[str]], list]], prefix: str = "", batch: int = 32, normalize: bool = True) -> DataFrame:
    """Texts with an `embedding`, of unit length unless told otherwise; load() gives a model's list[str] -> vectors once in each task."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for some in batches:
            said = [prefix + (t or "") for t in some]
            vectors = [v for at in range(0, len(said), batch) for v in encode(said[at : at + batch])]
            yield pd.Series([_unit(v) if normalize else [float(x) for x in v] for v in vectors], dtype=object)

    return texts.withColumn("embedding", run(F.col(text_col)))


def encoded_corpus(passages: DataFrame, queries: DataFrame, load, text_col: str = "text", asymmetric: bool = True, **options) -> tuple[DataFrame, DataFrame]:
    """Both sides of a search; asymmetric (E5) models tell them apart by a fixed prefix."""
    sides = ((passages, "passage: "), (queries, "query: "))
    return tuple(encoded(df, text_col, load, said if asymmetric else "", **options) for df, said in sides)


def cross_encoder(load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], batch: int = 16) -> Callable[[Column, Column], Column]:
    """A scorer for rerank(): load() gives a model's list[(query, text)] -> scores once in each task. rerank() raises on NaN."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        score = load()
        for queries, texts in batches:
            pairs = list(zip(queries, texts))
            yield pd.Series([float(s) for at in range(0, len(pairs), batch) for s in score(pairs[at : at + batch])], dtype="float64")

    return lambda query, text: run(query, text)


def segmented(sentences: DataFrame, text_col: str, load: Callable[[], Callable[[list[str]], list[list[list[str]]]]], batch: int = 32) -> DataFrame:
    """Sentences with `segments`, the pieces of each word; load() gives a model once in each task. The model's frame marks are dropped."""

    @F.pandas_udf("array<array<string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        segment = load()
        for some in batches:
            said = [t or "" for t in some]
            words = [w for at in range(0, len(said), batch) for w in segment(said[at : at + batch])]
            yield pd.Series([[p for p in w if p not in (["[CLS]"], ["[SEP]"])] for w in words], dtype=object)

    return sentences.withColumn("segments", run(F.col(text_col)))
