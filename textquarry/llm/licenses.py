"""License scans: MinHash bands over overlapping text windows retrieve templates, shingles verify them.

Words are runs of letters and digits, lower-cased; shingles take five words. A window has WINDOW = 4
shingles and the next one starts STEP = 2 further, so every shingle lies in two windows. A window's
k-th MinHash is the least shingle hash after XOR with the k-th constant; bands hold one MinHash each.
The index holds the bands of every template shingle by itself, the least that a window can share with
a template: a window that has one of a template's shingles collides in a band with a chance of a quarter,
so with 16 bands and two windows an occurrence is missed with a chance of 0.75 ** 32, 0.01 %; a window
within a stretch of the template collides for certain.

One pass explodes the windows. A bitmap of the template shingles (false for certain, or perhaps true)
drops nearly all windows that can't collide before their bands are joined with the index, so no text and
no array is shuffled. The retrieved windows' shingles are then verified exactly: the distinct
shingles of the template within a stretch of a quarter more than its length are at least 0.8 of them.
The templates are a parameter; their tables are broadcast up to BROADCAST_MOST rows and joined as Spark
sees fit beyond.

Defined results: null, empty and short texts match nothing; a row is judged by its own text alone, also
where doc_ids are null or repeat; equal rows (doc_id and text) give their matches once; a repeated line
counts as often as it occurs; texts are scanned whole, of any length; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, inline_rows, table, text_or_empty
from .license_texts import TEMPLATES

SHINGLE, WINDOW, STEP, BANDS, CONTAINED = 5, 4, 2, 16, 0.8
BROADCAST_MOST = 500_000
#: Bits of the bitmap per template shingle, at least.
BITS_PER_SHINGLE = 128
_WORD = r"[\p{L}\p{N}]+"


def _constants() -> list[int]:
    """The XOR constants: multiples of the golden ratio's 64-bit fraction, as signed numbers."""
    return [((k * 0x9E3779B97F4A7C15) % (1 << 64) ^ (1 << 63)) - (1 << 63) for k in range(1, BANDS + 1)]


def shingles(text: Column) -> Column:
    """A text's shingle hashes in order: five word hashes hashed together."""
    words = F.transform(F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0)), lambda w: F.xxhash64(w))

    def all_(h):
        return F.transform(F.sequence(F.lit(1), F.size(h) - (SHINGLE - 1)), lambda i: F.xxhash64(*[F.get(h, i - 1 + k) for k in range(SHINGLE)]))

    # the hashes are bound once for the whole text
    made = F.transform(F.array(words), lambda h: F.when(F.size(h) >= SHINGLE, all_(h)).otherwise(F.array().cast("array<bigint>")))
    return F.get(made, 0)


def _minhash(hashes: list[Column], constant: int) -> Column:
    return F.least(*[h.bitwiseXOR(F.lit(constant)) for h in hashes])


def _windows(h: Column, step: int) -> Column:
    """array<struct<at,x0..x3>>: windows of a shingle array, over both of its ends, where its end shingles fill them."""
    last = F.size(h) - 1
    parts = lambda i: F.struct(i.alias("at"), *[F.get(h, F.greatest(F.least(i + k, last), F.lit(0))).alias(f"x{k}") for k in range(WINDOW)], last.alias("last"))
    return F.when(F.size(h) > 0, F.transform(F.sequence(F.lit(step - WINDOW), F.greatest(last, F.lit(0)), F.lit(step)), parts))


def template_tables(spark, templates=None) -> tuple[DataFrame, DataFrame]:
    """(template, license, shingles, h) and the index (band, value, template)."""
    rows = [{"template": i, "license": name, "text": text} for i, (name, text) in enumerate(TEMPLATES if templates is None else templates)]
    hashed = inline_rows(spark, rows, "template int, license string, text string").withColumn("hashes", F.array_distinct(shingles(F.col("text"))))
    single = durable(hashed.select("template", "license", F.size("hashes").alias("shingles"), F.explode("hashes").alias("h")))
    values = F.inline(F.array(*[F.struct(F.lit(k).alias("band"), F.col("h").bitwiseXOR(F.lit(c)).alias("value")) for k, c in enumerate(_constants())]))
    return single, single.select("template", values)


def _may_hold(known: np.ndarray) -> tuple[Column, int]:
    """A bitmap of the hashes' last bits as an array literal, and the mask of a hash's place in it."""
    bits = 1 << max(12, (BITS_PER_SHINGLE * len(known) - 1).bit_length())
    flags = np.zeros(bits, np.uint8)
    flags[known & (bits - 1)] = 1
    longs = np.packbits(flags, bitorder="little").view("<i8")
    return F.lit(longs), bits - 1


def scan(docs: DataFrame, templates=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document and license template that it holds."""
    single, index = template_tables(docs.sparkSession, templates)
    small = (lambda df: F.broadcast(df)) if single.count() * BANDS <= BROADCAST_MOST else (lambda df: df)
    bitmap, mask = _may_hold(np.array([r.h for r in single.select("h").distinct().collect()], np.int64))  # as small as the templates
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("t"), shingles(text_or_empty(text_col)).alias("h"))
    windows = plain.select("doc_id", "t", F.explode(_windows(F.col("h"), STEP)).alias("w")).select("doc_id", "t", "w.*")
    xs = [F.col(f"x{k}") for k in range(WINDOW)]
    mins = [_minhash(xs, c) for c in _constants()]

    def may_be_known(x: Column) -> Column:
        return F.getbit(F.get(bitmap, F.shiftright(x.bitwiseAND(F.lit(mask)), 6).cast("int")), x.bitwiseAND(F.lit(63)).cast("int")) == 1

    hit = F.lit(False)
    for x in xs:  # a band's value comes from one of the window's shingles, so a window without a known one can't collide
        hit = hit | may_be_known(x)
    # written before the join: with its code in one method, the scan's would be too long for the compiler
    candidates = durable(windows.filter(hit))
    banded = candidates.select("doc_id", "t", "at", "last", *xs, F.inline(F.array(*[F.struct(F.lit(k).alias("band"), m.alias("value")) for k, m in enumerate(mins)])))
    retrieved = durable(banded.join(small(index), ["band", "value"]).select("doc_id", "t", "template", "at", "last", *xs).distinct())
    shingled = F.inline(F.array(*[F.struct(F.greatest(F.least(F.col("at") + k, "last"), F.lit(0)).alias("at"), x.alias("h")) for k, x in enumerate(xs)]))
    mine = retrieved.select("doc_id", "t", "template", shingled).distinct().join(small(single), ["template", "h"])
    # distinct shingles within the stretch that begins here; the stretch depends on the template alone
    start = Window.partitionBy("doc_id", "t", "template").orderBy("at")
    longest = -(-5 * max(1, single.agg(F.max("shingles")).first()[0] or 1) // 4)
    ahead = F.collect_list(F.struct("at", "h")).over(start.rangeBetween(0, longest))
    reach = F.col("at") + F.ceil(F.col("shingles") * 1.25) - 1
    inside = F.size(F.array_distinct(F.transform(F.filter("ahead", lambda s: s.at <= F.col("reach")), lambda s: s.h)))
    counted = mine.withColumn("ahead", ahead).withColumn("reach", reach).withColumn("inside", inside)
    good = counted.filter(F.col("inside") >= F.col("shingles") * CONTAINED)
    return good.groupBy("doc_id", "t", "template", "license", "shingles").agg(F.max("inside").cast("int").alias("matched"), F.min("at").cast("int").alias("first_word"), F.count("*").alias("places")).drop("t")


def op9_licenses(spark, sf_dir) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _values() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({i}, {quote(n)}, {quote(t)})" for i, (n, t) in enumerate(TEMPLATES))


OP9_SQL = rf"""
WITH tw AS (SELECT id AS template, license, regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+') AS w FROM (VALUES {_values()}) v(id, license, t)),
ts AS (SELECT DISTINCT template, license, array_to_string(w[i:i+4], ' ') AS s FROM tw, unnest(range(1, len(w) - 3)) u(i)),
tn AS (SELECT template, CAST(count(*) AS INTEGER) AS shingles FROM ts GROUP BY template),
dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
f AS (SELECT template, list_distinct(list(w1)) AS firsts FROM (SELECT template, split_part(s, ' ', 1) AS w1 FROM ts) GROUP BY template),
e AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dw WHERE len(w) >= 5),
p AS (SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i+4], ' ') AS s FROM e WHERE list_contains((SELECT flatten(list(firsts)) FROM f), w[i])),
m AS (SELECT p.doc_id, p.pos, ts.template, ts.license, ts.s, tn.shingles FROM p JOIN ts ON p.s = ts.s JOIN tn ON tn.template = ts.template),
c AS (SELECT a.doc_id, a.pos, a.template, a.license, a.shingles, count(DISTINCT b.s) AS inside
      FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.template = b.template AND b.pos >= a.pos AND b.pos <= a.pos + CAST(ceil(a.shingles * 1.25) AS BIGINT) - 1
      GROUP BY ALL)
SELECT doc_id, template, license, shingles, CAST(max(inside) AS INTEGER) AS matched, CAST(min(pos) AS INTEGER) AS first_word, count(*) AS places
FROM c WHERE inside >= shingles * 0.8 GROUP BY doc_id, template, license, shingles
"""
