"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints within 3 bits agree in at least 5 of 8 byte positions. Postings of a single
byte would each hold 1/256 of the corpus, so the index posts the bytes of four positions at once: the
14 quadruples of positions whose XOR is 0 (the planes of the 8-point affine space). Every set of five
positions holds exactly one of them, so no pair that reaches the guaranteed minimum of 5 shared bytes
is missed. In each posting list the shared positional bytes of a pair are tallied, pairs with fewer
than 5 are dropped, and the rest is verified by Hamming distance.

Only distinct fingerprints are indexed, so thousands of copies are one entry. A posting list gives
the spanning stars of its own links, at most one row per entry, never all pairs. Lists longer than
LONGEST are split: a pair with four shared bytes needs a fifth, so the list is posted again by each
of the other four positions, and what is still longer is compared block by block in separate tasks.

Joins with tables that grow with the corpus are merge joins by hint: Spark judges a broadcast by the size
of files, and 14 postings of each fingerprint in a file of a few MB don't fit the driver. Both sides
of each are read or exploded from files, so that Spark can split a hot key.

Defined results: null and wordless texts have fingerprint zero and are linked like any other; a component
without any doc_id has a null component_id, and ids are kept to the last digit; rows of one doc_id are
judged each by its own text, rows without one like any other; texts of any length are read whole; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, durable, table

MAX_BITS = 3
LEAST_BYTES = 5
SHINGLE = 3
LONGEST = 4096
PLANES = [q for q in combinations(range(8), 4) if q[0] ^ q[1] ^ q[2] ^ q[3] == 0]
_ONES = np.array([bin(x).count("1") for x in range(1 << 16)], np.uint8)


def fingerprint(text: str | None, words: int = SHINGLE, chunk: int = 1 << 16) -> int:
    """The unsigned fingerprint of a whole text; A-Z lower-cased, words split at \\x20 and \\x09-\\x0D."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined, starts = b" ".join(parts), np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=starts[1:])
    k = min(words, len(parts))
    n = len(parts) - k + 1
    lo, hi = starts[:n].tolist(), (starts[k : k + n] - 1).tolist()
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_digest
    for at in range(0, n, chunk):
        raw = b"".join([digest(joined[s:e], 42) for s, e in zip(lo[at : at + chunk], hi[at : at + chunk])])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_col: str | None = None) -> DataFrame:
    """(doc_id, fp bigint), and the digest if its column is named: one narrow pass, no shuffle."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            kept = [n for n in batch.schema.names if n != "text"]  # the ids stay Arrow: pandas turns those beside a null into floats
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(fps)], names=[*kept, "fp"])

    extra = [F.col(digest_col).alias("digest")] if digest_col else []
    schema = "doc_id long, digest string, fp long" if digest_col else "doc_id long, fp long"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *extra).mapInArrow(run, schema)


def _byte(position: int):
    return F.shiftrightunsigned("fp", 8 * (7 - position)).bitwiseAND(F.lit(255))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """True where a pair shares enough positional bytes and is verified; a, b: broadcast uint64."""
    x = np.ascontiguousarray(a ^ b)
    shared = (x.view(np.uint8).reshape(*x.shape, 8) == 0).sum(axis=-1)
    found = shared >= LEAST_BYTES
    found[found] = _ONES[x[found].view(np.uint16).reshape(-1, 4)].sum(axis=1) <= MAX_BITS
    return found


def _stars(fps: np.ndarray, other: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning stars of the links in a list (or between two): (node, root) arrays."""
    both = fps if other is None else np.concatenate([fps, other])
    parent = np.arange(len(both))
    right, shift = (fps, 0) if other is None else (other, len(fps))
    for at in range(0, len(fps), 256):
        i, j = np.nonzero(_distance(fps[at : at + 256, None], right[None, :]))
        i, j = i + at, j + shift
        while True:  # label the linked ones by the least parent until nothing changes
            low = np.minimum(parent[i], parent[j])
            before = parent.copy()
            np.minimum.at(parent, parent[i], low)
            np.minimum.at(parent, parent[j], low)
            parent = parent[parent]
            if (parent == before).all():
                break
    while (parent[parent] != parent).any():
        parent = parent[parent]
    moved = parent != np.arange(len(both))
    return [(both[moved], both[parent[moved]])]


def _linked(batches):
    """Rows sorted by key: the links of each list as (u, v)."""
    rest_k, rest_f = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def links(keys, fps):
        if not len(keys):
            return pd.DataFrame({"u": np.zeros(0, np.int64), "v": np.zeros(0, np.int64)})
        fps = fps.view(np.uint64)
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        us, vs = [], []
        short = sizes <= 16
        for d in range(1, min(16, int(sizes.max()))):  # short lists: all of them at once, by distance in the list
            a = np.flatnonzero(keys[:-d] == keys[d:]) if d < len(keys) else np.zeros(0, np.int64)
            a = a[np.repeat(short, sizes)[a]]
            hit = a[_distance(fps[a], fps[a + d])]
            us.append(fps[hit]), vs.append(fps[hit + d])
        for s, n in zip(starts[~short], sizes[~short]):
            for u, v in _stars(fps[s : s + n]):
                us.append(u), vs.append(v)
        return pd.DataFrame({"u": np.concatenate([*us, np.zeros(0, np.uint64)]).view(np.int64), "v": np.concatenate([*vs, np.zeros(0, np.uint64)]).view(np.int64)})

    for pdf in batches:
        keys, fps = np.r_[rest_k, pdf["key"].to_numpy()], np.r_[rest_f, pdf["fp"].to_numpy()]
        if not len(keys):
            continue
        cut = int(np.searchsorted(keys, keys[-1]))  # the last list may go on in the next batch
        rest_k, rest_f = keys[cut:], fps[cut:]
        yield links(keys[:cut], fps[:cut])
    yield links(rest_k, rest_f)


def _posted(rows: DataFrame, keys) -> DataFrame:
    """Rows with a list's key, fingerprint, positions still open and the list's length; lists of one are dropped.

    Lengths are counted before the shuffle, written and joined, so no list is held by one task.
    """
    one = rows.withColumn("k", F.explode(keys)).select("k.key", "fp", "k.open")
    lengths = durable(one.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    return one.join(lengths.hint("merge"), "key")


def _key(tag, positions) -> F.col:
    """A list's key. Different lists with one key only cost time: pairs are tallied and verified."""
    return F.xxhash64(F.lit(tag), *[_byte(p) for p in positions])


def _blocks(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    x, y = a["fp"].to_numpy().view(np.uint64), b["fp"].to_numpy().view(np.uint64)
    u, v = _stars(x, y)[0] if len(x) and len(y) else (x[:0], y[:0])
    return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})


def links(fps: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Links (u, v) whose components are those of all pairs within MAX_BITS; fps: distinct column fp."""
    quads = F.array(*[F.struct(_key(i, q).alias("key"), F.array(*[F.lit(p) for p in range(8) if p not in q]).alias("open")) for i, q in enumerate(PLANES)])
    lists = durable(_posted(fps.select("fp"), quads))
    compared = lambda df: df.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp").mapInPandas(_linked, "u long, v long")
    found = compared(lists.filter(F.col("n") <= longest))
    long = lists.filter(F.col("n") > longest)
    if long.limit(1).count():
        fifth = F.transform("open", lambda p: F.struct(F.xxhash64("key", p, _open_byte(p)).alias("key"), F.array_except("open", F.array(p)).alias("open")))
        again = durable(_posted(long.select("fp", "open", F.col("key")), fifth))
        found = found.union(compared(again.filter(F.col("n") <= longest)))
        still = again.filter(F.col("n") > longest).withColumn("blocks", F.ceil(F.col("n") / longest).cast("int"))
        block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        left = still.withColumn("i", block).withColumn("j", F.explode(F.sequence("i", F.col("blocks") - 1)))
        right = still.withColumn("j", block).withColumn("i", F.explode(F.sequence(F.lit(0), "j")))
        at = ["key", "i", "j"]
        pairs = left.select(*at, "fp").groupBy(*at).cogroup(right.select(*at, "fp").groupBy(*at)).applyInPandas(_blocks, "u long, v long")
        found = found.union(pairs)
    return found


def _open_byte(p):
    """The byte of fp at a position that is itself a column."""
    return F.element_at(F.array(*[_byte(q) for q in range(8)]), p + 1)


def _rooted(rows: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(fp, least, root) for every distinct fingerprint; least: its smallest doc_id."""
    distinct = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(durable(links(distinct, longest)))
    return distinct.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST) -> DataFrame:
    """(doc_id, fp, component_id) for every row."""
    rows = durable(fingerprints(docs, id_col, text_col))
    rooted = durable(_rooted(rows, longest))
    named = durable(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    of = durable(rooted.join(named.hint("merge"), "root").select("fp", "component_id"))
    return rows.join(of.hint("merge"), "fp")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component stays: its smallest doc_id (null last), then the smallest digest of the text.

    Doc_id and digest are a row's key; rows that share a whole key are one text, of which one stays.
    """
    keyed = docs.withColumns({"_tq_id": F.col(id_col).cast("long"), "_tq_digest": F.md5(F.col(text_col))})
    rows = durable(fingerprints(keyed, "_tq_id", text_col, "_tq_digest"))
    rooted = durable(_rooted(rows).select("fp", "root"))
    placed = durable(rows.join(rooted.hint("merge"), "fp"))
    stays = durable(placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("stays")))
    is_kept = F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & F.col("digest").eqNullSafe(F.col("stays.digest"))
    judged = durable(placed.join(stays.hint("merge"), "root").select("doc_id", "digest", is_kept.alias("kept")))
    gone = judged.filter("NOT kept").select("doc_id", "digest").distinct()
    gone = gone.select(F.col("doc_id").alias("_tq_gone"), F.col("digest").alias("_tq_gone_digest"))
    left = keyed.join(gone, F.col("_tq_id").eqNullSafe(F.col("_tq_gone")) & F.col("_tq_digest").eqNullSafe(F.col("_tq_gone_digest")), "left_anti")
    if judged.filter("kept").groupBy("doc_id", "digest").count().filter("count > 1").limit(1).count():
        left = left.dropDuplicates(["_tq_id", "_tq_digest"])
    return left.select(*docs.columns)


def op6_simhash(spark, sf_dir) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
