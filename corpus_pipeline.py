"""The corpus pipeline: toxicity, exact dedup, SimHash near-dedup, mixing, packing.

Each stage works on all rows that its predecessor kept, is written as Parquet to the shared folder and
read again; what a stage made durable on its way is deleted once it is written. All but the last return
the columns of documents.

Defined results: null and empty texts are clean, and equal to each other for both dedup stages; rows
without a doc_id are rows like any other; ties stay with the smallest doc_id, a null one last, then the
smallest text digest; an empty table gives an empty result after every stage; extra columns of documents,
whatever their names, are carried to the mixture and end with the packing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from textquarry.llm import exact_dedup, mixing, packing, simhash, toxicity
from textquarry.llm.common import intermediates, shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(docs)


def drop_near_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_repeats),
    ("simhash_near_dedup", drop_near_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The forest's labels, fingerprints and tokens can't be expressed in SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        with intermediates(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs
