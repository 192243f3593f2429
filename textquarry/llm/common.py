"""What the training-data operators share: table access, durable intermediates, components."""

from __future__ import annotations

import json
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Deletes or splits on these six characters only: space and \x09 to \x0D.
WHITESPACE = " \t\n\x0b\x0c\r"
#: A word: a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"
#: Up to so many links Spark may choose a broadcast join; how many rows a file of 10 MB holds can't be told.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one is made only where none is set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="textquarry-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


_noted = threading.local()


def durable(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, lost executors cost nothing.

    Later scans of the result prune columns and know their size.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    for paths in getattr(_noted, "open", [])[-1:]:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def intermediates(spark: SparkSession):
    """Deletes at its end what this thread made durable inside; a result must be written elsewhere before."""
    _noted.open = [*getattr(_noted, "open", []), []]
    try:
        yield
    finally:
        for path in _noted.open.pop():
            delete(spark, path)


def inline_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A bounded driver-made table as one JSON literal, so that no Python runs to scan it."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def text_or_empty(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def unit_hash(*cols: Column, seed: str = "") -> Column:
    """A uniform double in (0, 1) from the columns' text: the first 52 bits of an MD5."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 52))


def spread(rows: DataFrame, n: str, name: str, chunk: int = 4096) -> DataFrame:
    """A row for each number `name` from 0 to n - 1; a row that stands for very many is dealt to many tasks."""
    blocks = rows.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / chunk))))
    if rows.filter(F.col(n) > chunk).limit(1).count():
        blocks = blocks.repartition(*blocks.columns)
    first = F.col("_block") * chunk
    return blocks.withColumn(name, F.explode(F.sequence(first, F.least(first + chunk, F.col(n)) - 1))).drop("_block")


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Connected components of links (u bigint, v bigint) as rows (node, root), root the least node.

    Alternating large-star and small-star steps. Each step needs only a minimum per node, which is
    combined before the shuffle, and a join whose hot side Spark can split; neighbour lists are never
    gathered. Each round is written out, so its cost doesn't depend on the rounds before. Joins of more
    than BROADCAST_ROWS links are merge joins, with the minima written out.
    """

    def with_least(pairs: DataFrame, least: DataFrame) -> DataFrame:
        return pairs.join(durable(least).hint("merge") if mark[0] > BROADCAST_ROWS else least, "u")

    def star(both: DataFrame, keep: Column) -> DataFrame:
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return with_least(both.filter(keep), least).select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b")

    def tidy(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    now = durable(tidy(edges.select(F.col("u").alias("a"), F.col("v").alias("b")).filter("a <> b")))
    measure = lambda: now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    mark = measure()
    for _ in range(max_rounds if mark[0] else 0):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = durable(tidy(star(both, F.col("v") > F.col("u"))))
        # small star: every node's smaller neighbours, and itself, go to the least of them
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = with_least(down, least).select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b")
        now = durable(tidy(small.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))))
        before, mark = mark, measure()
        if mark == before:
            break
    else:
        if mark[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
