"""Sharding by sampled splitters.

Records are ordered by the key (hash of text, doc_id, row number), so equal texts lie together and yet
every record can be told from the next. A sample of keys, each drawn with a chance in proportion to its
record's size, gives quantile boundaries that cut the order into many ranges of similar bytes. The
ranges are measured; those that are overfull are sampled again, more densely, and subdivided. The exact
totals then say where each shard ends, and the few ranges that hold such an end are searched to the
record. An end inside a small group of equal texts moves to the group's edge.

Only (doc_id, size, crc, hash, row number) are shuffled, never the texts. What reaches the driver is the
samples and the range totals, both bounded by RANGES_MOST: at 20 billion records a range holds about
2.4 million of these narrow rows.

Defined results: a null text has size 1 and the CRC of the empty text; a null doc_id orders last; rows
that share doc_id and text, in any number, lie together but are cut wherever a shard ends; a text longer
than a shard's share fills its own shard; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, inline_rows, table, text_or_empty

RANGES_LEAST, RANGES_MOST, ROWS_PER_RANGE, SAMPLE_PER_RANGE = 1024, 8192, 50_000, 16
#: A range of more than this many times the mean bytes, and more than one record, is subdivided.
OVERFULL, ROUNDS = 2.0, 3
#: A group of equal texts of up to this share of a shard is not cut.
SNAP = 0.01
_LOW, _HIGH, _TOP_BITS = -(1 << 63), (1 << 63) - 1, 12
_KEY = ["h", "d", "t"]


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Narrow rows; t tells equal rows apart and holds from the moment they are written."""
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"), F.coalesce(F.col(id_col).cast("long"), F.lit(_HIGH)).alias("d"), F.monotonically_increasing_id().alias("t"))


def splitters(rows: DataFrame, total: int, ranges: int, seed: str = "splitter") -> list[tuple[int, int, int]]:
    """Ascending (h, d, t) boundaries: a key is in the range after every boundary that it exceeds or equals."""
    wanted = ranges * SAMPLE_PER_RANGE
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *_KEY), 11).cast("double") / F.lit(float(1 << 53))
    sample = sorted(rows.filter(draw < F.col("size") * F.lit(wanted / total)).select(*_KEY, "size").collect())
    weights = [max(size, total / wanted) for *_, size in sample]
    step, seen, cuts = sum(weights) / ranges, 0.0, []
    for (*key, _), w in zip(sample, weights):
        if int(seen / step) < int((seen + w) / step):
            cuts.append(tuple(key))
        seen += w
    return sorted(set(cuts))


def _ranged(rows: DataFrame, cuts: list[tuple[int, int, int]]) -> DataFrame:
    """Rows with their range: a table of 2^12 rows finds the boundaries near a hash."""
    tops = 1 << _TOP_BITS
    top = lambda h: (h >> (64 - _TOP_BITS)) + tops // 2
    near: list[list[dict]] = [[] for _ in range(tops)]
    for h, d, t in cuts:
        near[top(h)].append({"h": h, "d": d, "t": t})
    base, table_ = 0, []
    for k in range(tops):
        table_.append({"top": k, "base": base, "near": near[k]})
        base += len(near[k])
    lookup = F.broadcast(inline_rows(rows.sparkSession, table_, "top int, base int, near array<struct<h: bigint, d: bigint, t: bigint>>"))
    of = rows.withColumn("top", (F.shiftright("h", 64 - _TOP_BITS) + tops // 2).cast("int")).join(lookup, "top")
    own = F.struct(*_KEY)
    return of.withColumn("r", F.col("base") + F.size(F.filter("near", lambda c: c <= own))).drop("top", "base", "near")


def ranges_of(rows: DataFrame, total: int, ranges: int) -> tuple[DataFrame, dict[int, int]]:
    """Rows with their range, overfull ones subdivided, and the bytes of each range."""
    cuts = splitters(rows, total, ranges)
    for again in range(ROUNDS + 1):
        ranged = _ranged(rows, cuts)
        measured = {r: (size, n) for r, size, n in ranged.groupBy("r").agg(F.sum("size"), F.count("*")).collect()}
        over = sorted(r for r, (size, n) in measured.items() if n > 1 and size > OVERFULL * total / ranges)
        if not over or again == ROUNDS:
            break
        inside = sum(measured[r][0] for r in over)
        pieces = min(ranges, 4 * max(len(over), -(-inside * ranges // total)))
        cuts = sorted({*cuts, *splitters(ranged.filter(F.col("r").isin(over)), inside, pieces, f"splitter{again}")})
    return ranged, {r: size for r, (size, _) in measured.items()}


def _ends(rows: DataFrame, ranged: DataFrame, sums: dict[int, int], shards: int, total: int) -> list[tuple[int, int, int]]:
    """Per shard but the last, the (h, d, t) of its last key."""
    order, before = sorted(sums), [0]
    for r in order:
        before.append(before[-1] + sums[r])
    wanted = [total * k / shards for k in range(1, shards)]
    where = [order[min(bisect_right(before, w) - 1, len(order) - 1)] for w in wanted]
    starts = dict(zip(order, before))
    run = F.sum("size").over(Window.partitionBy("r").orderBy(*_KEY))
    inside = ranged.filter(F.col("r").isin(sorted(set(where)))).withColumn("run", run)
    ask = [F.min(F.when((F.col("r") == r) & (F.col("run") + starts[r] >= w), F.struct("run", *_KEY, "size"))).alias(f"e{i}") for i, (r, w) in enumerate(zip(where, wanted))]
    found = inside.agg(*ask).first()
    groups = rows.agg(*[x for i, e in enumerate(found) for x in (F.sum(F.when(F.col("h") < e.h, F.col("size")).otherwise(0)).alias(f"a{i}"), F.sum(F.when(F.col("h") == e.h, F.col("size")).otherwise(0)).alias(f"b{i}"))]).first()
    ends = []
    for i, (e, r, w) in enumerate(zip(found, where, wanted)):
        start, end = groups[2 * i], groups[2 * i] + groups[2 * i + 1]
        upto = starts[r] + e.run
        if end - start <= SNAP * total / shards or end - start == e["size"]:
            ends.append((e.h, _LOW, -1) if w - start < end - w else (e.h, _HIGH, _HIGH))
        else:
            ends.append((e.h, e.d, e.t - 1 if w - (upto - e["size"]) < upto - w else e.t))
    return sorted(ends)


def shards_of(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's shard and its gapless place there, shards of near-equal bytes."""
    rows = durable(keyed(docs, id_col, text_col))
    total, n = rows.agg(F.sum("size"), F.count("*")).first()
    if not n:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    ranged, sums = ranges_of(rows, total, min(RANGES_MOST, max(RANGES_LEAST, n // ROWS_PER_RANGE)))
    after = lambda h, d, t: (F.col("h") > h) | ((F.col("h") == h) & ((F.col("d") > d) | ((F.col("d") == d) & (F.col("t") > t))))
    shard = sum((after(*end).cast("int") for end in _ends(rows, ranged, sums, shards, total)), F.lit(0))
    placed = ranged.withColumn("shard", shard)
    counts, offsets, at = sorted(placed.groupBy("shard", "r").count().collect()), [], {}
    for s, r, c in counts:
        offsets.append({"shard": s, "r": r, "first": at.get(s, 0)})
        at[s] = at.get(s, 0) + c
    first = F.broadcast(inline_rows(docs.sparkSession, offsets, "shard int, r int, first bigint"))  # at most a row per range and shard end
    here = F.row_number().over(Window.partitionBy("shard", "r").orderBy(*_KEY)) - 1
    return placed.withColumn("here", here).join(first, ["shard", "r"]).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("here")).alias("slot"))


def op1_sharding(spark, sf_dir) -> DataFrame:
    of = shards_of(table(spark, sf_dir, "documents"), 8)
    return of.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
