"""What both classifiers share: which rows may teach, the bounded sample of them, and the scoring pass.

Labels of the held-out rows are never read. The sample is bounded by SAMPLE_MOST expected rows, drawn
by a hash of the doc_id, and joined to the documents as a broadcast table of that proven size, so the
texts are not shuffled. Its features, a few numbers a row, are what reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_MOST = 20_000
PREDICTED_FROM = 0.3


def remainder(id_col: str, parts: int) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts


def teaching_rows(docs: DataFrame, labels: DataFrame, label: str, may_teach: Column, most: int = SAMPLE_MOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, y) of a bounded sample of the labelled documents that may teach."""
    usable = labels.filter(may_teach & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("teach"), "doc_id"), 11).cast("double") / F.lit(float(1 << 53))
    sample = usable.filter(draw < F.lit(most / max(most, usable.count())))
    right = F.broadcast(sample.select(F.col("doc_id").alias("_tq_id"), "y"))  # at most about `most` rows of 12 bytes
    return docs.join(right, F.col(id_col).cast("long") == F.col("_tq_id")).select(F.col("_tq_id").alias("doc_id"), F.col(text_col).alias("text"), "y")


def gathered(sample: DataFrame, features: Callable[[pd.Series], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_id, features, y) of the sample on the driver, in the order of doc_id."""

    def run(batches):
        for pdf in batches:
            x = features(pdf["text"])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "x": list(x)})

    rows = sample.mapInPandas(run, "doc_id long, y int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(rows["x"].tolist(), dtype=float) if len(rows) else np.zeros((0, features(pd.Series([""])).shape[1]))
    return rows["doc_id"].to_numpy(), x, rows["y"].to_numpy(dtype=float)


def scored(docs: DataFrame, features: Callable, probability: Callable, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document in one narrow pass over the whole texts."""

    def run(batches):
        for batch in batches:  # the ids stay Arrow: pandas turns those beside a null into floats
            texts = pd.Series(batch.column("text").to_pylist(), dtype=object)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(probability(features(texts)), pa.float64())], names=["doc_id", "held_out", "score"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    return with_prediction(plain.mapInArrow(run, "doc_id long, held_out boolean, score double"))


def with_prediction(rows: DataFrame) -> DataFrame:
    return rows.withColumn("predicted", (F.col("score") >= PREDICTED_FROM).cast("int"))
