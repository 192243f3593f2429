"""Exact deduplication by a minimal perfect hash over historical distinct digests.

The history (rows of earlier generations) is reduced to distinct digests, and each digest bucket gets
a minimal perfect hash: level bit arrays in which each digest owns one bit, its rank being its slot.
Slots hold the full digest and the winner's locator. Incoming rows are reduced to distinct digests
first, so a text that fills a third of the table is one lookup; a lookup compares all 32 bytes.
Members join the historical group, the rest form groups of their own.

Defined results: a null text is empty; a null doc_id never wins over another, and every other id, the
least and the largest too, counts as itself; of repeated rows (same doc_id and text) exactly one stays,
the one whose other columns hash least; texts may be of any length; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITESPACE, durable, spread, table, text_or_empty

DIGESTS_PER_BUCKET = 25_000
LEAST_BUCKETS = 64
#: Digests of repeated rows up to this number (32 bytes each) are broadcast.
BROADCAST_MOST = 200_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)
# an id travels as (none, id) without nulls: pandas turns integers beside a null into floats
_INDEX = "bucket int, sizes array<int>, bits binary, digests binary, nones array<boolean>, ids array<long>, lengths array<long>, counts array<long>"
_GROUPS = "digest binary, none boolean, keep_id long, keep_n long, group_size long"


def _mixed(words: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of each digest for a level; words: n by 4."""
    with np.errstate(over="ignore"):
        x = words[:, level % 4] ^ (words[:, (level + 1) % 4] + np.uint64(level + 1) * _GOLD)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(digests) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 4)


def build_mph(digests: list[bytes], gamma: float = 1.5) -> tuple[list[int], bytes, np.ndarray]:
    """Level sizes, packed bits and each digest's slot (a permutation of 0 to n-1)."""
    words, left, sizes, levels, at = _words(digests), np.arange(len(digests)), [], [], np.zeros(len(digests), np.int64)
    base = 0
    while len(left):
        size = max(8, int(len(left) * gamma))
        place = (_mixed(words[left], len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(place, minlength=size) == 1
        own = alone[place]
        at[left[own]] = base + place[own]
        left, base = left[~own], base + size
        sizes.append(size)
        levels.append(alone)
    bits = np.concatenate(levels) if levels else np.zeros(0, bool)
    rank = np.cumsum(bits) - 1
    return sizes, np.packbits(bits).tobytes(), rank[at] if len(digests) else at


def lookup_mph(sizes: list[int], bits: bytes, digests: list[bytes]) -> np.ndarray:
    """The slot that each digest would have, -1 where no level has a bit for it."""
    slots, total = np.full(len(digests), -1, np.int64), int(sum(sizes))
    if not digests or not total:
        return slots
    words, flags = _words(digests), np.unpackbits(np.frombuffer(bits, np.uint8))[:total].astype(bool)
    rank, open_, base = np.cumsum(flags) - 1, np.arange(len(digests)), 0
    for level, size in enumerate(sizes):
        place = base + (_mixed(words[open_], level) % np.uint64(size)).astype(np.int64)
        hit = flags[place]
        slots[open_[hit]] = rank[place[hit]]
        open_, base = open_[~hit], base + size
        if not len(open_):
            break
    return slots


def _index_of(pdf: pd.DataFrame) -> pd.DataFrame:
    digests = [bytes(x) for x in pdf["digest"]]
    sizes, bits, slot = build_mph(digests)
    order = np.argsort(slot)
    col = lambda c: pdf[c].to_numpy(object)[order].tolist()
    return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "sizes": [sizes], "bits": [bits], "digests": [b"".join(digests[i] for i in order)], "nones": [col("none")], "ids": [col("keep_id")], "lengths": [col("keep_n")], "counts": [col("group_size")]})


def _matched(new: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """Old groups with what joins them, and the new groups."""
    stored, old = [], 0
    best, counts = [], []  # what stays: the most code points, then an id, then the least id
    if len(index):
        row = index.iloc[0]
        stored = [bytes(row["digests"][i : i + 32]) for i in range(0, len(row["digests"]), 32)]
        best, counts = [(-int(n), bool(x), int(i)) for n, x, i in zip(row["lengths"], row["nones"], row["ids"])], list(row["counts"])
        old = len(stored)
    digests = [bytes(x) for x in new["digest"]]
    slots = lookup_mph(list(index.iloc[0]["sizes"]), index.iloc[0]["bits"], digests) if old else [-1] * len(digests)
    for d, s, x, i, n, c in zip(digests, slots, new["none"], new["keep_id"], new["keep_n"], new["group_size"], strict=True):
        if s >= 0 and stored[s] == d:
            counts[s] += c
            best[s] = min(best[s], (-int(n), bool(x), int(i)))
        else:
            stored.append(d), best.append((-int(n), bool(x), int(i))), counts.append(c)
    return pd.DataFrame({"digest": stored, "none": np.array([b[1] for b in best], bool), "keep_id": np.array([b[2] for b in best], np.int64), "keep_n": np.array([-b[0] for b in best], np.int64), "group_size": np.array(counts, np.int64)})


def normalised(text_col: str):
    return F.translate(text_or_empty(text_col), WHITESPACE, "")


def digests_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Distinct (doc_id, n, digest) with the number of rows that share all three."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(text_or_empty(text_col)).cast("long").alias("n"), F.unhex(F.sha2(normalised(text_col).cast("binary"), 256)).alias("digest"))
    return rows.groupBy("digest", "n", "doc_id").agg(F.count("*").alias("copies"))


def groups_of(rows: DataFrame, is_history=None) -> DataFrame:
    """(digest, keep_id, keep_n, group_size) of digests_of()'s rows, through the index of the history.

    is_history: a condition on the rows; by default half of the doc_ids by hash count as the earlier
    generation. It decides only which rows the index holds, never the result.
    """
    spark = rows.sparkSession
    is_history = F.xxhash64("doc_id") % 2 == 0 if is_history is None else is_history
    buckets = max(LEAST_BUCKETS, -(-rows.count() // DIGESTS_PER_BUCKET))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id")))
    named = lambda of: of.select("digest", "best.none", F.col("best.id").alias("keep_id"), (-F.col("best.n")).alias("keep_n"), "group_size", F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int").alias("bucket"))
    distinct = lambda of: named(of.groupBy("digest").agg(best.alias("best"), F.sum("copies").alias("group_size")))
    index = durable(distinct(rows.filter(is_history)).groupBy("bucket").applyInPandas(_index_of, _INDEX))
    incoming = distinct(rows.filter(~is_history))
    groups = incoming.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(lambda new, old: _matched(new, old), _GROUPS)
    return durable(groups).select("digest", F.when(~F.col("none"), F.col("keep_id")).alias("keep_id"), "keep_n", "group_size")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with the row that stays for it."""
    rows = durable(digests_of(docs, id_col, text_col))
    joined = spread(rows, "copies", "copy").join(groups_of(rows), "digest", "left")
    won = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("keep_n"))
    return joined.select("doc_id", "keep_id", "group_size", (won & (F.col("copy") == 0)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns."""
    rows = durable(digests_of(docs, id_col, text_col))
    groups = groups_of(rows).select(F.col("digest").alias("_tq_d"), F.col("keep_id").alias("_tq_i"), F.col("keep_n").alias("_tq_n"))
    repeats = rows.filter("copies > 1").select("digest", "doc_id", "n")
    keyed = docs.withColumns({"_tq_digest": F.unhex(F.sha2(normalised(text_col).cast("binary"), 256)), "_tq_len": F.length(text_or_empty(text_col)).cast("long")})
    same = (F.col("_tq_digest") == F.col("_tq_d")) & (F.col("_tq_len") == F.col("_tq_n")) & F.col(id_col).cast("long").eqNullSafe(F.col("_tq_i"))
    kept = keyed.join(groups, same)
    if repeats.limit(1).count():  # most tables have none; else one of each group's equal rows is picked without gathering them
        again = F.broadcast(repeats.select("digest").distinct()) if repeats.count() <= BROADCAST_MOST else repeats.select("digest").distinct()
        often = again.select(F.col("digest").alias("_tq_often"))
        once = kept.join(often, F.col("_tq_digest") == F.col("_tq_often"), "left_anti")
        many = kept.join(often, F.col("_tq_digest") == F.col("_tq_often"), "left_semi").withColumn("_tq_all", F.xxhash64(*docs.columns))
        least = many.groupBy(F.col("_tq_digest").alias("_tq_by")).agg(F.min("_tq_all").alias("_tq_least"))
        chosen = many.join(least, (F.col("_tq_digest") == F.col("_tq_by")) & (F.col("_tq_all") == F.col("_tq_least")))
        kept = once.select(*docs.columns).unionByName(chosen.dropDuplicates(["_tq_digest"]).select(*docs.columns))
    return kept.select(*docs.columns)


def op7_exact_dedup(spark, sf_dir) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, length(t) AS n, sha256(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM d),
r AS (SELECT *, row_number() OVER w AS rn, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
      FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, text_sha256 FROM r
"""
