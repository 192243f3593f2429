"""Mixing sources to target weights by Pareto order sampling.

A source whose target is r times its size gives floor(r) whole copies of each document; the rest is a
fixed-size sample with unequal inclusion probabilities. They are in proportion to a document's weight,
which grows gently with its length (WEIGHT_BASE plus its size's number of binary digits), up to 1: documents
whose share would exceed 1 are certain, and the others' probabilities rise until the expected words are
what is missing. Documents are ranked by random odds divided by inclusion odds and taken from the front
until the next one doesn't fit. FILL times the walk goes on from there with the documents that do still
fit; then the one of all remaining whose size comes nearest to the gap closes it.

The rank is never sorted as a whole: each source's ranks are counted in buckets, bucket sums say in
which a walk ends, and only that bucket's documents are ordered. So a source with a third of all rows
costs no more in one task than any other. Sources are few: their own tables are ordered in one task.

Defined results: a null text has size 0; a null source is a source of its own, last in order; each of
several equal rows (also those without a doc_id) is drawn by itself, under its copy number; sources
without words have target 0 and give nothing; a document of any length is taken or left whole; an empty
table gives an empty result; extra columns are kept by mix() and tell rows apart there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, durable, spread, table, text_or_empty, unit_hash

MOST_COPIES, FILL, WEIGHT_BASE = 3, 3, 8
BUCKETS_LEAST, BUCKETS_MOST, ROWS_PER_BUCKET = 1024, 65536, 20_000
#: The inclusion probability that counts as certain.
CERTAIN = 1.0 - 1e-9
_GROUP = ["doc_id", "source", "size", "digest", "more"]


def targets(rows: DataFrame) -> DataFrame:
    """(source, source_size, target, whole, rest): weights 1, 2, 3 by order; one row per source."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    s, w = F.col("source_size"), F.col("w")
    weighed = sums.withColumn("w", ((rank - 1) % 3 + 1).cast("double")).withColumn("cap", s * float(MOST_COPIES))
    order = Window.orderBy(F.col("cap") / w, F.col("source").asc_nulls_last())
    above, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # if all sources before this one stop at their cap, the others get this much for each unit of weight
    left = F.sum(s.cast("double")).over(every) - F.coalesce(F.sum("cap").over(above), F.lit(0.0))
    level = left / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(above), F.lit(0.0)))
    leveled = weighed.withColumn("k", F.row_number().over(order)).withColumn("level", level)
    least = F.min(F.when(F.col("level") <= F.col("cap") / w, F.struct("k", "level"))).over(Window.partitionBy(F.lit(1))).level
    found = leveled.withColumn("target", F.least("cap", F.coalesce(least, F.lit(0.0)) * w))
    whole = F.when(F.col("target") >= F.col("cap"), F.lit(MOST_COPIES)).otherwise(F.floor(F.col("target") / s)).cast("long")
    whole = F.when(s == 0, F.lit(0).cast("long")).otherwise(whole)
    return found.select("source", "source_size", "target", whole.alias("whole")).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * s))


def _on_source(rows: DataFrame, per: DataFrame, how: str = "inner") -> DataFrame:
    """Rows with their source's row; per is written out, so Spark knows its size and broadcasts it only if small."""
    other = per.withColumnRenamed("source", "_source")
    return rows.join(other, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, more: Column | None = None) -> DataFrame:
    """Narrow rows; those that agree in all of _GROUP are copies of one another."""
    size = F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), F.md5(F.col(text_col)).alias("digest"), (F.lit(None).cast("long") if more is None else more).alias("more"))


def chances(classes: DataFrame) -> DataFrame:
    """(source, class, chance) of (source, class, words, rest): in proportion to the weight, at most 1, so that the expected words are `rest`.

    If the heaviest classes up to one are certain, the others' factor is what they must still give over their
    weighted words; the first factor that makes nothing else certain is right. There are 64 classes at most.
    """
    weight = F.col("class") + WEIGHT_BASE
    order = Window.partitionBy("source").orderBy(F.desc("class"))
    certain = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = F.sum(F.col("words") * weight).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    factor = F.try_divide(F.col("rest") - certain, open_.cast("double"))
    found = classes.withColumn("factor", factor)
    right = F.max(F.when(F.col("factor") * weight <= 1, F.struct("class", "factor"))).over(Window.partitionBy("source")).factor
    return found.select("source", "class", F.least(F.lit(CERTAIN), F.coalesce(right * weight, F.lit(CERTAIN))).alias("chance"))


def pareto_rank(u: Column, chance: Column) -> Column:
    """Random odds over inclusion odds."""
    return (u / (1 - u)) / (chance / (1 - chance))


def _walk(rows: DataFrame, room: str) -> DataFrame:
    """(source, out, gap) of rows (source, q, b, size, room): where the first that doesn't fit stands, null if all fit, and the room left."""
    sums = rows.groupBy("source", "b", room).agg(F.sum("size").alias("words"))
    sums = sums.withColumn("words_to", F.sum("words").over(Window.partitionBy("source").orderBy("b")))
    ends = durable(sums.groupBy("source", room).agg(F.min(F.when(F.col("words_to") > F.col(room), F.struct("b", (F.col("words_to") - F.col("words")).alias("before")))).alias("end"), F.sum("words").alias("all")))
    edge = _on_source(rows.select("source", "q", "b", "size"), ends.filter("end IS NOT NULL").select("source", room, "end")).filter("b = end.b")
    edge = edge.withColumn("reach", F.col("end.before") + F.sum("size").over(Window.partitionBy("source").orderBy("q")))
    fits = F.col("reach") <= F.col(room)
    stopped = edge.groupBy("source", room, "end.before").agg(F.min(F.when(~fits, F.col("q"))).alias("out"), F.max(F.when(fits, F.col("reach"))).alias("reach"))
    some = stopped.select("source", "out", (F.col(room) - F.coalesce("reach", "before")).alias("gap"))
    return durable(some.unionByName(ends.filter("end IS NULL").select("source", F.lit(None).cast("double").alias("out"), (F.col(room) - F.col("all")).alias("gap"))))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", more: Column | None = None) -> DataFrame:
    """(doc_id, source, size, digest, more, n, source_size, target, copies) for every row; n: the rows that equal it."""
    groups = durable(keyed(docs, id_col, text_col, source_col, more).groupBy(*_GROUP).agg(F.count("*").alias("n")))
    rows = spread(groups, "n", "copy").withColumn("class", F.length(F.bin("size")))
    rows = rows.withColumn("u", unit_hash(F.col("doc_id"), F.col("digest"), F.col("more"), F.col("copy"), seed=seed))
    per = durable(targets(groups.withColumn("size", F.col("size") * F.col("n"))))
    classes = groups.withColumn("class", F.length(F.bin("size"))).groupBy("source", "class").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    of_class = durable(chances(_on_source(classes, per.select("source", "rest")))).withColumnRenamed("class", "_class")
    buckets = min(BUCKETS_MOST, max(BUCKETS_LEAST, rows.count() // ROWS_PER_BUCKET))
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("class") == F.col("_class"))
    ranked = _on_source(rows, per).join(of_class.withColumnRenamed("source", "_source"), same, "left").drop("_source", "_class")
    ranked = ranked.withColumn("q", F.when(F.col("rest") > 0, pareto_rank(F.col("u"), F.col("chance"))))
    ranked = ranked.withColumn("b", F.least(F.floor(F.col("q") / (1 + F.col("q")) * buckets), F.lit(buckets - 1)).cast("int"))
    now = _walk(ranked.filter("q IS NOT NULL"), "rest")
    state = now.withColumnsRenamed({"out": "out0", "gap": "gap0"})
    inside = F.col("q").isNotNull() & (F.col("out0").isNull() | (F.col("q") < F.col("out0")))
    for k in range(1, FILL + 1):  # only where the walk before stopped, with the documents that its gap can hold
        fitting = (F.col("q") > F.col(f"out{k - 1}")) & F.col("size").between(1, F.col(f"gap{k - 1}"))
        now = _walk(_on_source(ranked, state).filter(fitting), f"gap{k - 1}").withColumnsRenamed({"out": f"out{k}", "gap": f"_gap{k}"})
        state = durable(_on_source(state, now, "left").withColumn(f"gap{k}", F.coalesce(f"_gap{k}", f"gap{k - 1}")).drop(f"_gap{k}"))
        inside = inside | (fitting & (F.col(f"out{k}").isNull() | (F.col("q") < F.col(f"out{k}"))))
    inside = F.coalesce(inside, F.lit(False))
    gap = F.col(f"gap{FILL}")
    miss = F.abs(gap - F.col("size"))
    closing = _on_source(ranked.filter("q IS NOT NULL"), state).filter(~inside & (miss < gap)).groupBy("source").agg(F.min(F.struct(miss.alias("miss"), "q")).alias("closing"))
    final = _on_source(ranked, durable(_on_source(state, closing, "left")), "left")
    extra = F.when(inside | F.coalesce((F.col("q") == F.col("closing.q")) & (F.col("size") > 0), F.lit(False)), 1).otherwise(0)
    return final.select(*_GROUP, "n", "source_size", "target", (F.col("whole") + extra).alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """The mixture itself: every document as often as it was taken, columns unchanged."""
    others = [c for c in docs.columns if c not in (id_col, text_col, source_col)]
    more = F.xxhash64(*others) if others else None
    of = mixed(docs, id_col, text_col, source_col, seed, more)
    taken = durable(of.groupBy(*[F.col(c).alias(f"_tq_{c}") for c in _GROUP]).agg(F.sum("copies").alias("_tq_copies"), F.max("n").alias("_tq_n")).filter("_tq_copies > 0"))
    wide = docs.withColumns({"_tq_key": F.md5(F.col(text_col)), "_tq_rest": F.lit(None).cast("long") if more is None else more})
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_tq_doc_id")) & F.col(source_col).eqNullSafe(F.col("_tq_source")) & F.col("_tq_key").eqNullSafe(F.col("_tq_digest")) & F.col("_tq_rest").eqNullSafe(F.col("_tq_more"))
    joined = wide.join(taken, same)
    if taken.filter("_tq_n > 1").limit(1).count():  # of equal rows one stands for all of the group's copies
        once = joined.filter("_tq_n > 1").dropDuplicates([f"_tq_{c}" for c in _GROUP])
        joined = joined.filter("_tq_n = 1").unionByName(once)
        if taken.filter(F.col("_tq_copies") > 4096).limit(1).count():
            joined = spread(joined, "_tq_copies", "_tq_copy")
            return joined.select(*docs.columns)
    return joined.withColumn("_tq_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_tq_copies"))).select(*docs.columns)


def op5_mixing(spark, sf_dir) -> DataFrame:
    of = mixed(table(spark, sf_dir, "documents"))
    return of.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def _walk_sql(k: int) -> str:
    """The k-th walk on from where the one before stopped: s{k} (source, out, gap)."""
    return f"""
c{k} AS (SELECT q.source, q.q, z.gap AS room, sum(q.size) OVER (PARTITION BY q.source ORDER BY q.q) AS reach FROM q JOIN s{k - 1} z ON q.source IS NOT DISTINCT FROM z.source WHERE q.q > z.out AND q.size BETWEEN 1 AND z.gap),
w{k} AS (SELECT source, room - coalesce(max(reach) FILTER (reach <= room), 0) AS gap, min(q) FILTER (reach > room) AS out FROM c{k} GROUP BY source, room),
s{k} AS (SELECT z.source, w.out, coalesce(w.gap, z.gap) AS gap FROM s{k - 1} z LEFT JOIN w{k} w ON w.source IS NOT DISTINCT FROM z.source),"""


_INSIDE = " OR ".join(["s0.out IS NULL OR q.q < s0.out", *[f"(q.q > s{k - 1}.out AND q.size BETWEEN 1 AND s{k - 1}.gap AND (s{k}.out IS NULL OR q.q < s{k}.out))" for k in range(1, FILL + 1)]])
_STATES = " ".join(f"LEFT JOIN s{k} ON s{k}.source IS NOT DISTINCT FROM q.source" for k in range(FILL + 1))

OP5_SQL = rf"""
WITH e AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-]+')) AS BIGINT) AS size, md5(text) AS digest,
         row_number() OVER (PARTITION BY doc_id, source, text) - 1 AS copy
  FROM documents),
d AS (
  SELECT doc_id, source, size, length(bin(size)) AS class,
         (CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(digest, '') || '||' || copy), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM e),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w, source_size * 3.0::DOUBLE AS cap FROM s),
l AS (
  SELECT *, row_number() OVER o AS k,
         (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(cap) OVER a, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER a, 0)) AS level
  FROM w WINDOW o AS (ORDER BY cap / w, source ASC NULLS LAST), a AS (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT coalesce(arg_min(level, k) FILTER (WHERE level <= cap / w), 0) AS level FROM l),
t AS (SELECT source, source_size, least(cap, b.level * w) AS target,
             CASE WHEN source_size = 0 THEN 0 WHEN least(cap, b.level * w) >= cap THEN 3 ELSE CAST(floor(least(cap, b.level * w) / source_size) AS BIGINT) END AS whole
      FROM l, b),
r AS (SELECT *, greatest(0.0::DOUBLE, target - whole * source_size) AS rest FROM t),
k AS (SELECT source, class, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY ALL),
f AS (
  SELECT k.source, class, class + {WEIGHT_BASE} AS weight,
         (rest - CAST(coalesce(sum(words) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)) / nullif(CAST(sum(words * (class + {WEIGHT_BASE})) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE), 0) AS factor
  FROM k JOIN r ON k.source IS NOT DISTINCT FROM r.source WINDOW o AS (PARTITION BY k.source ORDER BY class DESC)),
h AS (SELECT source, class, least({CERTAIN!r}::DOUBLE, coalesce((arg_max(factor, class) FILTER (factor * weight <= 1) OVER (PARTITION BY source)) * weight, {CERTAIN!r}::DOUBLE)) AS chance FROM f),
q AS (
  SELECT d.doc_id, d.source, d.size, r.source_size, r.target, r.whole, r.rest, CASE WHEN rest > 0 THEN (u / (1 - u)) / (chance / (1 - chance)) END AS q
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source JOIN h ON d.source IS NOT DISTINCT FROM h.source AND d.class = h.class),
c0 AS (SELECT source, q, rest, sum(size) OVER (PARTITION BY source ORDER BY q) AS reach FROM q WHERE q IS NOT NULL),
s0 AS (SELECT source, rest - coalesce(max(reach) FILTER (reach <= rest), 0) AS gap, min(q) FILTER (reach > rest) AS out FROM c0 GROUP BY source, rest),
{"".join(map(_walk_sql, range(1, FILL + 1)))}
g AS (SELECT q.*, abs(s{FILL}.gap - q.size) AS miss, s{FILL}.gap, q.q IS NOT NULL AND coalesce({_INSIDE}, false) AS inside FROM q {_STATES}),
x AS (SELECT source, arg_min(q, (miss, q)) AS closing FROM g WHERE q IS NOT NULL AND NOT inside AND miss < gap GROUP BY source)
SELECT g.doc_id, g.size, g.source_size, g.target,
       CAST(g.size * (g.whole + CASE WHEN g.inside OR coalesce(g.q = x.closing AND g.size > 0, false) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM g LEFT JOIN x ON x.source IS NOT DISTINCT FROM g.source
"""
