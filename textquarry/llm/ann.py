"""Approximate nearest neighbours by inner product: inverted lists with an adaptive dimension scan.

Vectors get one more component so that the largest inner product is the least distance, are rotated by
a random orthogonal matrix, and go to the list of their nearest centroid (fitted on a bounded sample;
every row is indexed). A query probes its nearest lists; how many is measured on the sample, so that
they hold HELD of the true neighbours there: few where vectors cluster, most where they are uniform. In
a list, distances are summed by column blocks: after each block a hypothesis test compares the partial
distance, scaled to all dimensions, with the query's current 20th best, and candidates that can hardly
be nearer are abandoned. While many pairs are open a block is one matrix product; the few that stay
open are followed one by one. Survivors are scored exactly, in double precision on the original vectors.

Lists are scanned in tiles: a tile holds several small lists, or a block of a large one, TILE vectors at
most, so that a vector that fills a third of the table is many tasks. The queries that probe a tile come
in groups of at most about QUERIES. A task returns at most 20 rows for each of its queries, the merged
best of all probed lists of its tile; a query's number of tiles doesn't grow before TILES_LEAST tiles are full.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no
part, as queries or candidates, nor do those whose length isn't the most frequent one (ties: the
smaller length); rows with a null vec_id are no part either; repeated rows are candidates each, but
none of a query's own vec_id; ties go to the smaller vec_id; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, inline_rows, table

NEAREST, QUERY_EVERY = 20, 20
#: Rows that the centroids are fitted on, at most about, and those of them that measure how many lists to probe.
SAMPLE_MOST, MEASURED_MOST = 8192, 512
LISTS_LEAST, LISTS_MOST, ROWS_PER_LIST = 8, 1024, 800
#: The share of the sample's true neighbours that the probed lists must hold.
HELD = 0.96
TILE, TILES_LEAST, QUERIES, COLUMNS = 16384, 16, 16384, 24
#: Candidates and queries that are compared at once, at most, and the share of open pairs under which they are followed one by one.
CHUNK, AT_ONCE, SPARSE = 2048, 256, 0.1
#: The hypothesis test's width: a larger one abandons less.
EPSILON = 2.1
SEED = 7


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(~bad & F.exists("v", lambda x: x != 0))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (length["n"] if length else 0))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    x = np.unique(x, axis=0)
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = ((centers**2).sum(axis=1) - 2 * x @ centers.T).argmin(axis=1)
        for c in range(len(centers)):
            if (mine := x[near == c]).size:
                centers[c] = mine.mean(axis=0)
    return centers


class Index:
    """The rotation, the largest squared norm and the centroids: what a task needs besides its vectors."""

    def __init__(self, sample: np.ndarray, top: float, rows: int):
        rng = np.random.default_rng(SEED)
        self.top, dims = top, sample.shape[1] + 1
        self.rotation = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
        lists = int(min(LISTS_MOST, max(LISTS_LEAST, rows // ROWS_PER_LIST)))
        self.centers = _kmeans(self.rotated(sample), lists, rng)
        self.probes = self._measured(sample)

    def _measured(self, sample: np.ndarray, nearest: int = NEAREST) -> int:
        """The least number of nearest lists that hold HELD of the sample's true neighbours; the full table's are nearer still."""
        at = np.unique(np.linspace(0, len(sample) - 1, min(len(sample), MEASURED_MOST)).astype(int))
        lists, k = self.distances(self.rotated(sample)).argmin(axis=1), min(nearest, len(sample) - 1)
        if k < 1:
            return len(self.centers)
        score = sample[at] @ sample.T
        score[np.arange(len(at)), at] = -np.inf
        found = np.argpartition(-score, k - 1, axis=1)[:, :k]
        order = np.argsort(self.distances(self.rotated(sample[at], query=True)), axis=1, kind="stable")
        place = np.argsort(order, axis=1)  # of each list in the query's order
        met = np.sort(np.take_along_axis(place, lists[found], axis=1).ravel())
        return int(met[min(len(met) - 1, int(np.ceil(HELD * len(met))) - 1)]) + 1

    def rotated(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.top - (x**2).sum(axis=1), 0.0))
        return np.column_stack([x, more]) @ self.rotation

    def distances(self, rotated: np.ndarray) -> np.ndarray:
        return (self.centers**2).sum(axis=1) - 2 * rotated @ self.centers.T


def _matrix(col: pd.Series) -> np.ndarray:
    return np.array(col.tolist(), dtype=np.float64)


def _ranked(query: np.ndarray, distance: np.ndarray, at: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of pairs by query, distance and id, and each one's rank (from 0) in its query."""
    order = np.lexsort((ids[at], distance, query))
    return order, np.arange(len(order)) - np.searchsorted(query[order], query[order])


def scan(index: Index, ids: np.ndarray, x: np.ndarray, lists: np.ndarray, query_ids: np.ndarray, q: np.ndarray, probed: np.ndarray, nearest: int = NEAREST) -> pd.DataFrame:
    """Each query's nearest of a tile's vectors, by the adaptive dimension scan.

    probed: a row for each query, a column for each list; a query meets its probed lists only.
    """
    order = np.lexsort((ids, lists))
    order = order[_needed(ids[order], x[order], nearest)]
    ids, x, lists = ids[order], x[order], lists[order]
    rx, rq = (index.rotated(v, query).astype(np.float32) for v, query in ((x, False), (q, True)))
    dims, slack = rx.shape[1], 2e-5 * (1 + index.top)
    ends = [*range(COLUMNS, dims, COLUMNS), dims]
    # a few candidates from all over are measured whole: they give the first bounds; chunks grow from there
    few = np.unique(np.linspace(0, len(ids) - 1, min(len(ids), 4 * nearest)).astype(int))
    others, chunks, at, size = np.setdiff1d(np.arange(len(ids)), few), [few], 0, 4 * nearest
    while at < len(others):
        chunks.append(others[at : at + min(size, CHUNK)])
        at, size = at + min(size, CHUNK), 2 * size
    out = []
    for start in range(0, len(q), AT_ONCE):
        some = slice(start, start + AT_ONCE)
        mq, mine, asked = rq[some], query_ids[some], probed[some]
        bounds = np.full(len(mq), np.inf, np.float32)
        query, distance, at = np.zeros(0, int), np.zeros(0, np.float32), np.zeros(0, int)
        for chunk in chunks:
            i, j, part = _open(rx[chunk], mq, asked[:, lists[chunk]] & (ids[chunk][None, :] != mine[:, None]), bounds, ends, slack)
            query, distance, at = np.r_[query, i], np.r_[distance, part], np.r_[at, chunk[j]]
            order, rank = _ranked(query, distance, at, ids)
            last = order[rank == nearest - 1]
            bounds[query[last]] = distance[last]
            keep = distance <= bounds[query] + slack  # equal distances stay together: the ids decide
            query, distance, at = query[keep], distance[keep], at[keep]
        order, rank = _ranked(query, -(x[at] * q[some][query]).sum(axis=1), at, ids)
        query, at = query[order][rank < nearest], at[order][rank < nearest]
        out.append(pd.DataFrame({"query_id": mine[query], "vec_id": ids[at], "score": (x[at] * q[some][query]).sum(axis=1)}))
    return pd.concat(out)


def _needed(ids: np.ndarray, x: np.ndarray, nearest: int) -> np.ndarray:
    """Rows, ordered by list and id, without those that no query can return: of equal vectors the first ids go first.

    Of one vector and id `nearest` rows are enough, and of one vector twice as many, as a query's own id drops out.
    """
    rows = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel()
    _, same = np.unique(rows, return_inverse=True)
    by = np.lexsort((ids, same))
    first = lambda new: np.arange(len(by)) - np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
    vector = np.r_[True, same[by][1:] != same[by][:-1]]
    by = by[first(vector | np.r_[True, ids[by][1:] != ids[by][:-1]]) < nearest]
    vector = np.r_[True, same[by][1:] != same[by][:-1]]
    return np.sort(by[first(vector) < 2 * nearest])


def _open(c: np.ndarray, q: np.ndarray, open_: np.ndarray, bounds: np.ndarray, ends: list[int], slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, distance) of the pairs that no hypothesis test abandons."""
    dims, begin, dense = ends[-1], 0, True
    part = np.zeros(open_.shape, np.float32)
    for end in ends:
        limit = bounds * (end / dims) * (1 + EPSILON / np.sqrt(end)) ** 2 + slack if end < dims else bounds + slack
        a, b = c[:, begin:end], q[:, begin:end]
        if dense:
            part += (a**2).sum(axis=1) + (b**2).sum(axis=1)[:, None] - 2 * (b @ a.T)
            open_ &= part <= limit[:, None]
            if end == dims or np.count_nonzero(open_) < SPARSE * open_.size:
                i, j = np.nonzero(open_)
                part, dense = part[i, j], False
        else:
            part = part + ((a[j] - b[i]) ** 2).sum(axis=1)
            keep = part <= limit[i]
            i, j, part = i[keep], j[keep], part[keep]
        begin = end
    return i, j, part


def tiles(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each list's first tile and its number of tiles: small neighbours share a tile, large lists have several."""
    most = min(TILE, -(-int(sizes.sum()) // TILES_LEAST))
    first, blocks, tile, full = np.zeros(len(sizes), np.int32), np.ones(len(sizes), np.int32), 0, 0
    for i, n in enumerate(sizes.tolist()):
        if full and full + n > most:
            tile, full = tile + 1, 0
        first[i], blocks[i] = tile, max(1, -(-n // most))
        full += n
        if blocks[i] > 1:
            tile, full = tile + int(blocks[i]), 0
    return first, blocks


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = QUERY_EVERY, nearest: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score): queries are the rows whose id is divisible by `every`."""
    rows = durable(usable(vectors, id_col, vector_col))
    empty = "query_id long, rank int, vec_id long, score double"
    n, top = rows.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b))).first()
    if not n:
        return rows.sparkSession.createDataFrame([], empty)
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("ann"), "vec_id"), 11).cast("double") / F.lit(float(1 << 53))
    sample = rows.filter(draw < SAMPLE_MOST / max(n, SAMPLE_MOST)).toPandas().sort_values("vec_id", kind="stable")
    if not len(sample):
        sample = rows.limit(1).toPandas()
    index = Index(_matrix(sample["v"]), float(top), n)

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(list=index.distances(index.rotated(_matrix(pdf["v"]))).argmin(axis=1).astype(np.int32))

    listed = durable(rows.mapInPandas(assign, "vec_id long, v array<double>, list int"))
    sizes = np.zeros(len(index.centers), np.int64)
    for r in listed.groupBy("list").count().collect():  # LISTS_MOST rows at most
        sizes[r["list"]] = r["count"]
    first, blocks = tiles(sizes)

    def probes(v: pd.Series) -> np.ndarray:
        """A row for each query, true at its nearest lists: the fixed number, or more until they hold enough vectors."""
        order = np.argsort(index.distances(index.rotated(_matrix(v), query=True)), axis=1, kind="stable")
        held = np.cumsum(sizes[order], axis=1) - sizes[order]
        out = np.zeros(order.shape, bool)
        np.put_along_axis(out, order, (np.arange(order.shape[1]) < index.probes) | (held < 4 * nearest), axis=1)
        return out

    def meet(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(tiles=[np.unique(np.concatenate([np.arange(first[i], first[i] + blocks[i]) for i in np.flatnonzero(row & (sizes > 0))])) for row in probes(pdf["v"])])

    queries = durable(rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]))
    groups = max(1, -(-queries.count() // QUERIES))
    share = lambda salt, of: F.pmod(F.xxhash64(F.lit(salt), "vec_id"), of).cast("int")
    # one row per list, of which there are LISTS_MOST at most
    places = F.broadcast(inline_rows(rows.sparkSession, [{"list": i, "first": int(first[i]), "blocks": int(blocks[i])} for i in range(len(sizes))], "list int, first int, blocks int"))
    stored = listed.join(places, "list").withColumn("tile", F.col("first") + share("b", F.col("blocks")))
    stored = stored.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))) if groups > 1 else stored.withColumn("group", F.lit(0))
    asking = queries.mapInPandas(meet, "vec_id long, v array<double>, tiles array<int>").withColumn("tile", F.explode("tiles")).withColumn("group", share("g", F.lit(groups)))

    def found(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        return scan(index, left["vec_id"].to_numpy(), _matrix(left["v"]), left["list"].to_numpy(), right["vec_id"].to_numpy(), _matrix(right["v"]), probes(right["v"]), nearest)

    at = ["tile", "group"]
    hits = stored.select(*at, "vec_id", "v", "list").groupBy(*at).cogroup(asking.select(*at, "vec_id", "v").groupBy(*at)).applyInPandas(found, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def op10_ann(spark, sf_dir) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
