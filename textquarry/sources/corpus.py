"""JSON sources and sinks: corpora, judge cases, probes, tool tasks, segmentations, recorded replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS = "documents array<struct<id:string,title:string,text:string,source:string>>, queries array<struct<id:string,question:string,relevant:array<string>,kind:string>>"
REPLY = "key string, model string, request struct<messages:array<struct<content:string,role:string>>,params:struct<max_tokens:int,seed:int,temperature:double>,tools:string>, response struct<text:string,tool_calls:array<struct<name:string,arguments:string>>>"
CASES = "cases array<struct<question:string,fact:string,criterion:string,kept:string,lost:string>>"
PROBES = "summary string, cap int, probes array<struct<fact:string,question:string,filler:array<string>>>"
TASKS = "max_attempts int, tools array<struct<name:string,description:string,parameters:array<struct<name:string,type:string,description:string,required:boolean,enum:array<string>>>>>, tasks array<string>"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema(schema).json(path)


def load_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (id, title, text, source), queries (id, question, kind) and qrels (query_id, doc_id)."""
    raw = _json(spark, path, CORPUS)
    documents = raw.select(F.explode("documents").alias("d")).select("d.*")
    queries = raw.select(F.explode("queries").alias("q")).select("q.*")
    qrels = queries.select(F.col("id").alias("query_id"), F.explode("relevant").alias("doc_id")).distinct()
    return documents, queries.select("id", "question", F.coalesce("kind", F.lit("other")).alias("kind")), qrels


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, CASES).select(F.explode("cases").alias("c")).select("c.*")


def load_probes(spark: SparkSession, path: str) -> tuple[str, int, DataFrame]:
    """The summary, the cap and the probes (id, fact, question, filler)."""
    raw = _json(spark, path, PROBES)
    head = raw.select("summary", "cap").first()
    return head.summary, head.cap, raw.select(F.posexplode("probes").alias("id", "p")).select("id", "p.*")


def load_tasks(spark: SparkSession, path: str) -> tuple[int, list[dict], DataFrame]:
    """Attempts allowed, the tools' definitions and the tasks (task_id, task)."""
    raw = _json(spark, path, TASKS)
    head = raw.select("max_attempts", "tools").first()
    tools = [t.asDict(recursive=True) for t in head.tools]
    for t in tools:
        t["parameters"] = [{k: v for k, v in p.items() if v is not None} for p in t["parameters"]]
    return head.max_attempts, tools, raw.select(F.posexplode("tasks").alias("task_id", "task"))


def load_segmentation(spark: SparkSession, path: str) -> DataFrame:
    """(word, pieces)."""
    return _json(spark, path, "words map<string,array<string>>").select(F.explode("words").alias("word", "pieces"))


def load_replies(spark: SparkSession, path: str) -> DataFrame:
    """A folder of recorded replies: (key, model, text, tool_calls, request)."""
    return _json(spark, path, REPLY).select("key", "model", F.col("response.text").alias("text"), F.col("response.tool_calls").alias("tool_calls"), "request")


def save_replies(replies: DataFrame, path: str) -> None:
    """(key, model, text, ...) as Parquet by model; merge() with the store first, so that replies stay."""
    replies.write.mode("append").partitionBy("model").parquet(path)


def keys(store: DataFrame) -> DataFrame:
    return store.select("key").distinct().orderBy("key")


def first_distinct(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """Rows whose key is among the first n distinct ones by order of appearance."""
    first = rows.groupBy(key).agg(F.min(order).alias("_first")).orderBy("_first").limit(n)
    return rows.join(first.select(key), key, "left_semi")


def passage_index(contexts: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(id, passage): each context's passage, which is the smallest id that has the same text; joined by the text's SHA-256."""
    hashed = contexts.select(F.col(id_col).alias("id"), F.sha2(F.col(text_col).cast("binary"), 256).alias("digest"))
    passages = hashed.groupBy("digest").agg(F.min("id").alias("passage"))
    return hashed.join(passages, "digest").select("id", "passage")


def dangling(references: DataFrame, targets: DataFrame, on: str) -> DataFrame:
    return references.join(targets.select(on), on, "left_anti")


def repeated_ids(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
