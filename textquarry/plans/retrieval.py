"""Retrieval and ranking queries over documents, benchmark and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chunking
from ..functions.text import squeezed, tokenize
from ..operators import dense, fusion, lexical, metrics

SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contains_pairs(docs: DataFrame, facts: DataFrame) -> DataFrame:
    """(query_id, doc_id) where the document's text holds the fact, white space and case aside.

    A fact's inner words stand in a document as whole words, so its longest inner word is an equi-join
    key; only the pairs that share it are compared. Facts of under three words are compared with all.
    """
    fact = facts.select("query_id", squeezed(F.col("text")).alias("fact"), tokenize(F.col("text")).alias("tokens"))
    inner = fact.withColumn("inner", F.slice("tokens", 2, F.greatest(F.size("tokens") - 2, F.lit(0))))
    longest = F.element_at(F.sort_array(F.transform("inner", lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))), asc=False), 1)["t"]
    keyed = inner.filter(F.size("inner") > 0).withColumn("term", longest)
    held = docs.select("doc_id", F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term"))
    candidates = held.join(keyed.select("query_id", "term", "fact"), "term")
    long = candidates.join(docs.select("doc_id", "text"), "doc_id").filter(F.contains(squeezed(F.col("text")), F.col("fact"))).select("query_id", "doc_id")
    short = inner.filter(F.size("inner") == 0)
    if short.limit(1).count():
        pairs = docs.select("doc_id", squeezed(F.col("text")).alias("body")).join(short, F.contains(F.col("body"), F.col("fact"))).select("query_id", "doc_id")
        return long.union(pairs).distinct()
    return long.distinct()


def _base(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    queries = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return docs, queries


def _bm25(spark, sf_dir, k):
    docs, queries = _base(spark, sf_dir)
    return lexical.search(docs, queries, k)


def tokenize_counts(spark, sf_dir):
    tokens = tokenize(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(tokens).cast("long").alias("tokens"), F.size(F.array_distinct(tokens)).cast("long").alias("distinct_tokens"))


def term_stats(spark, sf_dir):
    return lexical.term_stats(read(spark, sf_dir, "documents")).withColumn("idf", F.round("idf", 6))


def bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir, 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def bm25_eval(spark, sf_dir):
    docs, queries = _base(spark, sf_dir)
    return metrics.evaluate(_bm25(spark, sf_dir, 40), contains_pairs(docs, queries), queries, 3)


def bm25_eval_by_lang(spark, sf_dir):
    docs, queries = _base(spark, sf_dir)
    qrels = contains_pairs(docs, queries)
    lang = qrels.join(docs.select("doc_id", "lang"), "doc_id").groupBy("query_id").agg(F.min("lang").alias("lang"))
    kinds = queries.select("query_id").join(lang, "query_id", "left").withColumn("lang", F.coalesce("lang", F.lit("other")))
    return metrics.evaluate(_bm25(spark, sf_dir, 40), qrels, kinds, 3, "lang")


def ranking_metrics_long(spark, sf_dir):
    docs, queries = _base(spark, sf_dir)
    made = metrics.per_query(_bm25(spark, sf_dir, 40), contains_pairs(docs, queries), queries, [1, 3, 5])
    row = lambda k: F.struct(F.lit(k).alias("k"), *[F.round(f"{n}_{k}", 6).alias(n) for n in ("recall", "precision", "ndcg", "hit")])
    return made.select("query_id", F.round("rr", 6).alias("rr"), F.explode(F.array(*map(row, (1, 3, 5)))).alias("m")).select("query_id", "rr", "m.*")


def failed_retrieval_curve(spark, sf_dir):
    docs, queries = _base(spark, sf_dir)
    made = metrics.per_query(_bm25(spark, sf_dir, 40), contains_pairs(docs, queries), queries, [1, 3, 5, 10, 20])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"recall_{k}").alias("recall")) for k in (1, 3, 5, 10, 20)])).alias("m")
    per_k = made.select(rows).groupBy("m.k").agg(F.round(1 - F.avg("m.recall"), 6).alias("failed"))
    return metrics.relative_cut(per_k, "k", "failed", 1).withColumn("cut", F.round("cut", 6))


def _as_items(chunks):
    """Chunks under their place: (doc_id, index) names a chunk and orders by document, then place."""
    return chunks.select(F.struct("doc_id", "index").alias("chunk"), "text")


def _chunk_ranked(chunks, queries, k=40):
    """(query_id, chunk, score, rank) by BM25."""
    return lexical.search(_as_items(chunks), queries, k, id_col="chunk").withColumnRenamed("doc_id", "chunk")


def _chunk_nearest(chunks, queries, k=40):
    """(query_id, chunk, score, rank) by cosine of the stand-in encoder's vectors."""
    coded = lambda df, name: df.select(F.col(name).alias("id"), dense.hashed_vector(F.col("text")).alias("v"))
    return dense.cosine_search(coded(queries, "query_id"), coded(_as_items(chunks), "chunk"), k, "id", "v").withColumnRenamed("doc_id", "chunk")


def _documents(ranked):
    return fusion.to_documents(ranked.withColumn("doc_id", F.col("chunk.doc_id")))


def _small_chunks(docs):
    return chunking.chunks(docs, "fixed", size=200, overlap=40)


def bm25_chunked_docs(spark, sf_dir):
    docs, queries = _base(spark, sf_dir)
    return _documents(_chunk_ranked(_small_chunks(docs), queries))


def contextual_bm25(spark, sf_dir):
    docs, queries = _base(spark, sf_dir)
    return _documents(_chunk_ranked(chunking.contextualised(_small_chunks(docs), docs, "source"), queries))


def dense_topk(spark, sf_dir):
    """Chunks by vector, then the documents of the 40 nearest."""
    docs, queries = _base(spark, sf_dir)
    return _documents(_chunk_nearest(_small_chunks(docs), queries))


def keyword_retriever(spark, sf_dir):
    """Another tokenizer: runs of anything but white space."""
    docs, queries = _base(spark, sf_dir)
    split = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[^\s]+"), F.lit(0))
    return lexical.search(docs, queries, 20, tokenizer=split).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def chunk_fixed(spark, sf_dir):
    return chunking.chunks(read(spark, sf_dir, "documents"), "fixed", size=400, overlap=50)


def chunk_recursive(spark, sf_dir):
    return chunking.chunks(read(spark, sf_dir, "documents"), "recursive", size=200, overlap=40)


def chunk_by_structure(spark, sf_dir):
    return chunking.chunks(read(spark, sf_dir, "documents"), "by_structure", size=400)


def chunk_length_stats(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    both = [chunking.chunks(docs, "fixed", size=s, overlap=o).withColumn("strategy", F.lit(f"fixed_{s}")) for s, o in ((200, 40), (400, 50))]
    return chunking.length_stats(both[0].unionByName(both[1]), ["strategy"]).withColumns({"mean": F.round("mean", 6), "median": F.col("median").cast("double")})


def contains_fact_pairs(spark, sf_dir):
    docs, queries = _base(spark, sf_dir)
    return contains_pairs(docs, queries)


def _dense(spark, sf_dir, k=40):
    """The stated query set, every row whose vec_id is divisible by 20, against all rows."""
    vectors = read(spark, sf_dir, "embeddings")
    asked = vectors.filter(F.col("vec_id") % 20 == 0)
    return vectors, asked, dense.cosine_search(asked, vectors, k, but_self=True)


def cosine_topk(spark, sf_dir):
    return _dense(spark, sf_dir, 10)[2].select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def dense_eval(spark, sf_dir):
    vectors, asked, ranked = _dense(spark, sf_dir)
    q = asked.select(F.col("vec_id").alias("query_id"), F.col("label").alias("l"))
    qrels = vectors.join(q, vectors["label"] == q["l"]).filter("vec_id <> query_id").select("query_id", F.col("vec_id").alias("doc_id"))
    return metrics.evaluate(ranked, qrels, q, 3)


def rrf_fusion(spark, sf_dir):
    """BM25 by words fused with BM25 by white-space tokens."""
    docs, queries = _base(spark, sf_dir)
    split = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[^\s]+"), F.lit(0))
    fused = fusion.rrf([_bm25(spark, sf_dir, 40), lexical.search(docs, queries, 40, tokenizer=split)])
    return fused.withColumn("score", F.round("score", 9))


def hybrid_topk(spark, sf_dir):
    """Dense and lexical rankings of the chunks, 40 each, fused on the chunks, then collapsed to documents."""
    docs, queries = _base(spark, sf_dir)
    chunks = _small_chunks(docs)
    fused = fusion.rrf([_chunk_nearest(chunks, queries), _chunk_ranked(chunks, queries)], item="chunk")
    return _documents(fused).filter(F.col("rank") <= 10)


def _shared_words(query, text):
    return F.size(F.array_intersect(tokenize(query), tokenize(text)))


def rerank_shortlist(spark, sf_dir):
    docs, queries = _base(spark, sf_dir)
    return fusion.rerank(_bm25(spark, sf_dir, 20), queries.select("query_id", F.col("text").alias("query")), docs.select("doc_id", "text"), _shared_words, 20, 5)


def first_n_distinct(spark, sf_dir):
    from ..sources.corpus import first_distinct

    return first_distinct(read(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 5)


def dangling_refs(spark, sf_dir):
    from ..sources.corpus import dangling

    return dangling(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels"), "doc_id")


def duplicate_ids(spark, sf_dir):
    from ..sources.corpus import repeated_ids

    return repeated_ids(read(spark, sf_dir, "conversations").select("conv_id"), "conv_id")


def kind_histogram(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))


def best_by_group(spark, sf_dir):
    """The source with the longest documents on average, per language."""
    means = read(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.round(F.avg("n_chars"), 6).alias("mean"))
    return metrics.best_by(means, "mean", "source", ["lang"])


def context_to_passage(spark, sf_dir):
    from ..sources.corpus import passage_index

    return passage_index(read(spark, sf_dir, "documents"), "text", "doc_id")


def kinds_present(spark, sf_dir):
    """The distinct kinds in order, each with its place and whether it has at least 50 documents."""
    kinds = read(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return kinds.select("lang", F.row_number().over(Window.orderBy("lang")).alias("place"), (F.col("n") >= 50).alias("enough"))


QUERIES = {f.__name__: f for f in (tokenize_counts, term_stats, bm25_topk, bm25_eval, bm25_eval_by_lang, ranking_metrics_long, failed_retrieval_curve, bm25_chunked_docs, contextual_bm25, keyword_retriever, chunk_fixed, chunk_recursive, chunk_by_structure, chunk_length_stats, contains_fact_pairs, cosine_topk, dense_topk, dense_eval, context_to_passage, kinds_present, rrf_fusion, hybrid_topk, rerank_shortlist, first_n_distinct, dangling_refs, duplicate_ids, kind_histogram, best_by_group)}

_W, _S = r"[\p{L}\p{N}_]+", r"[^\s]+"


def _tokens(text: str, word: str = _W) -> str:
    return f"regexp_extract_all(lower({text}), '{word}')"


def _bm25_ctes(docs: str, p: str = "", word: str = _W, k: int = 40) -> str:
    """CTEs {p}top(query_id, doc_id, score, rank) of BM25 over a relation with doc_id and text."""
    return f"""
{p}h AS (SELECT doc_id, {_tokens('text', word)} AS tokens FROM {docs}),
{p}c AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM {p}h),
{p}qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({_tokens('text', word)}) AS term FROM benchmark) GROUP BY ALL),
{p}tf AS (SELECT term, doc_id, dl, count(*) AS tf FROM (SELECT doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM {p}h) WHERE term IN (SELECT term FROM {p}qt) GROUP BY ALL),
{p}df AS (SELECT term, count(*) AS df FROM {p}tf GROUP BY term),
{p}sc AS (SELECT query_id, doc_id, round(sum(times * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS score
  FROM {p}tf JOIN {p}df USING (term) JOIN {p}qt USING (term), {p}c GROUP BY ALL),
{p}top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {p}sc WHERE score > 0) WHERE rank <= {k})"""


_SQUEEZE = r"regexp_replace(regexp_replace(lower({t}), '^[\s\x1c-\x1f\x85\p{{Z}}]+|[\s\x1c-\x1f\x85\p{{Z}}]+$', '', 'g'), '[\s\x1c-\x1f\x85\p{{Z}}]+', ' ', 'g')"
_QRELS = f"qrels AS (SELECT item_id AS query_id, doc_id FROM (SELECT doc_id, {_SQUEEZE.format(t='text')} AS body FROM documents) d JOIN (SELECT item_id, {_SQUEEZE.format(t='text')} AS fact FROM benchmark) b ON contains(d.body, b.fact))"


def _metric_ctes(top: str, queries: str, ks: str) -> str:
    """m(query_id, k, n_relevant, rr, recall, precision, ndcg, hit)."""
    return f"""
nr AS (SELECT query_id, count(*) AS n_relevant FROM qrels GROUP BY query_id),
j AS (SELECT t.query_id, t.doc_id, t.rank FROM {top} t JOIN qrels USING (query_id, doc_id)),
fr AS (SELECT query_id, 1.0::DOUBLE / min(rank) AS rr FROM j GROUP BY query_id),
qk AS (SELECT q.query_id, k, coalesce(n_relevant, 0) AS n_relevant, coalesce(rr, 0) AS rr FROM {queries} q CROSS JOIN (VALUES {ks}) v(k) LEFT JOIN nr USING (query_id) LEFT JOIN fr USING (query_id)),
a AS (SELECT qk.query_id, qk.k, count(j.doc_id) AS found, coalesce(sum(1.0::DOUBLE / log2(j.rank + 1.0::DOUBLE)), 0) AS dcg FROM qk LEFT JOIN j ON j.query_id = qk.query_id AND j.rank <= qk.k GROUP BY ALL),
m AS (SELECT query_id, k, n_relevant, rr, CASE WHEN n_relevant > 0 THEN found::DOUBLE / n_relevant ELSE 0 END AS recall, found::DOUBLE / k AS precision,
        CASE WHEN n_relevant > 0 THEN dcg / list_sum(list_transform(range(1, least(n_relevant, k) + 1), lambda i: 1.0::DOUBLE / log2(i + 1.0::DOUBLE))) ELSE 0 END AS ndcg,
        CASE WHEN found > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit FROM qk JOIN a USING (query_id, k))"""


_SUMMARY = "count(*) AS queries, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, round(avg(hit), 6) AS hit_rate, round(1 - avg(recall), 6) AS failed"
_QUERY_IDS = "(SELECT item_id AS query_id FROM benchmark)"


def _fixed_sql(size: int, overlap: int, where: str = "documents") -> str:
    step = size - overlap
    last = f"CAST(greatest(ceil((length(text) - {size}) / {step}::DOUBLE), 0) AS BIGINT)"
    return f"(SELECT doc_id, source, CAST(i AS INTEGER) AS index, CAST(i * {step} AS INTEGER) AS start, CAST(least(i * {step} + {size}, length(text)) AS INTEGER) AS \"end\", substr(text, CAST(i * {step} + 1 AS BIGINT), {size}) AS text FROM (SELECT doc_id, source, text, unnest(range(0, {last} + 1)) AS i FROM {where} WHERE length(text) > 0))"


_HASHED = """list_transform(range(0, 64), lambda i: CAST(len(list_filter(list_transform({t}, lambda t: CAST('0x' || substr(md5(t), 1, 2) AS INTEGER) % 64), lambda b: b = i)) AS DOUBLE))"""


def _chunk_cte(text: str = "text") -> str:
    return f"ch AS (SELECT struct_pack(d := doc_id, i := index) AS doc_id, {text} AS text FROM {_fixed_sql(200, 40)})"


def _collapsed(top: str) -> str:
    return f"""f AS (SELECT query_id, doc_id.d AS doc_id, min(rank) AS first FROM {top} GROUP BY ALL),
o AS (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY first) AS INTEGER) AS rank FROM f)"""


def _chunked(text: str) -> str:
    return f"WITH {_chunk_cte(text)}, {_bm25_ctes('ch')}, {_collapsed('top')} SELECT * FROM o"


def _near_ctes() -> str:
    """dtop: the chunks nearest to each query; a chunk without words scores -1, a query without any 0."""
    norm = lambda a: f"sqrt(list_sum(list_transform({a}.v, lambda x: x * x)))"
    return f"""cv AS (SELECT doc_id, {_HASHED.format(t=_tokens('text'))} AS v FROM ch), qv AS (SELECT item_id AS query_id, {_HASHED.format(t=_tokens('text'))} AS v FROM benchmark),
cn AS (SELECT doc_id, v, {norm('cv')} AS n FROM cv), qn AS (SELECT query_id, v, {norm('qv')} AS n FROM qv),
ds AS (SELECT query_id, doc_id, round(CASE WHEN c.n = 0 THEN -1 WHEN q.n = 0 THEN 0 ELSE list_inner_product(q.v, c.v) / (q.n * c.n) END, 9) AS score FROM qn q, cn c),
dtop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ds) WHERE rank <= 40)"""


_DENSE = """s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 9) AS score FROM embeddings q, embeddings d WHERE q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 40)"""

SQL = {
    "tokenize_counts": f"SELECT doc_id, CAST(len({_tokens('text')}) AS BIGINT) AS tokens, CAST(len(list_distinct({_tokens('text')})) AS BIGINT) AS distinct_tokens FROM documents",
    "term_stats": f"WITH tf AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({_tokens('text')}) AS term FROM documents) GROUP BY ALL), c AS (SELECT count(*) AS n FROM documents) SELECT term, CAST(sum(tf) AS BIGINT) AS cf, count(*) AS df, round(ln(1 + (any_value(n) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)), 6) AS idf FROM tf, c GROUP BY term",
    "bm25_topk": f"WITH {_bm25_ctes('documents', k=10)} SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM top",
    "bm25_eval": f"WITH {_bm25_ctes('documents')}, {_QRELS}, {_metric_ctes('top', _QUERY_IDS, '(3)')} SELECT {_SUMMARY} FROM m",
    "bm25_eval_by_lang": f"WITH {_bm25_ctes('documents')}, {_QRELS}, {_metric_ctes('top', _QUERY_IDS, '(3)')}, l AS (SELECT query_id, min(lang) AS lang FROM qrels JOIN documents USING (doc_id) GROUP BY query_id) SELECT coalesce(lang, 'other') AS lang, {_SUMMARY} FROM m LEFT JOIN l USING (query_id) GROUP BY coalesce(lang, 'other')",
    "ranking_metrics_long": f"WITH {_bm25_ctes('documents')}, {_QRELS}, {_metric_ctes('top', _QUERY_IDS, '(1), (3), (5)')} SELECT query_id, round(rr, 6) AS rr, k, round(recall, 6) AS recall, round(precision, 6) AS precision, round(ndcg, 6) AS ndcg, hit FROM m",
    "failed_retrieval_curve": f"WITH {_bm25_ctes('documents')}, {_QRELS}, {_metric_ctes('top', _QUERY_IDS, '(1), (3), (5), (10), (20)')}, f AS (SELECT k, round(1 - avg(recall), 6) AS failed FROM m GROUP BY k) SELECT k, failed, round(coalesce(((SELECT failed FROM f WHERE k = 1) - failed) / nullif((SELECT failed FROM f WHERE k = 1), 0), 0), 6) AS cut FROM f",
    "bm25_chunked_docs": _chunked("text"),
    "contextual_bm25": _chunked("source || '. ' || text"),
    "keyword_retriever": f"WITH {_bm25_ctes('documents', word=_S, k=20)} SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM top",
    "chunk_fixed": f'SELECT doc_id, index, start, "end", text FROM {_fixed_sql(400, 50)}',
    "chunk_length_stats": " UNION ALL ".join(f"SELECT 'fixed_{s}' AS strategy, count(*) AS chunks, CAST(min(length(text)) AS INTEGER) AS shortest, CAST(quantile_cont(length(text), 0.5) AS DOUBLE) AS median, round(avg(length(text)), 6) AS mean, CAST(max(length(text)) AS INTEGER) AS longest FROM {_fixed_sql(s, o)}" for s, o in ((200, 40), (400, 50))),
    "contains_fact_pairs": f"WITH {_QRELS} SELECT query_id, doc_id FROM qrels",
    "cosine_topk": f"WITH {_DENSE} SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM top WHERE rank <= 10",
    "dense_eval": f"WITH {_DENSE}, qrels AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id FROM embeddings q JOIN embeddings d ON q.label = d.label AND q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0), {_metric_ctes('top', '(SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 20 = 0)', '(3)')} SELECT {_SUMMARY} FROM m",
    "rrf_fusion": f"WITH {_bm25_ctes('documents')}, {_bm25_ctes('documents', 'w', _S)}, f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM (SELECT query_id, doc_id, rank FROM top UNION ALL SELECT query_id, doc_id, rank FROM wtop) GROUP BY ALL) SELECT query_id, doc_id, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM f",
    "dense_topk": f"WITH {_chunk_cte()}, {_near_ctes()}, {_collapsed('dtop')} SELECT * FROM o",
    "hybrid_topk": f"WITH {_chunk_cte()}, {_bm25_ctes('ch')}, {_near_ctes()}, u AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM (SELECT query_id, doc_id, rank FROM top UNION ALL SELECT query_id, doc_id, rank FROM dtop) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM u), {_collapsed('r')} SELECT * FROM o WHERE rank <= 10",
    "context_to_passage": "SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY text) AS passage FROM documents",
    "kinds_present": "SELECT lang, CAST(row_number() OVER (ORDER BY lang) AS INTEGER) AS place, count(*) >= 50 AS enough FROM documents GROUP BY lang",
    "rerank_shortlist": f"WITH {_bm25_ctes('documents', k=20)}, s AS (SELECT query_id, top.doc_id, rank AS base, CAST(len(list_intersect({_tokens('b.text')}, {_tokens('d.text')})) AS DOUBLE) AS score FROM top JOIN documents d ON d.doc_id = top.doc_id JOIN benchmark b ON b.item_id = top.query_id) SELECT query_id, doc_id, score, rank FROM (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, base) AS INTEGER) AS rank FROM s) WHERE rank <= 5",
    "first_n_distinct": "SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM documents GROUP BY source ORDER BY min(doc_id) LIMIT 5)",
    "dangling_refs": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "duplicate_ids": "SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) > 1",
    "kind_histogram": "SELECT lang, count(*) AS n, count(DISTINCT source) AS sources FROM documents GROUP BY lang",
    "best_by_group": "SELECT lang, source AS best, mean FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY mean DESC, source) AS r FROM (SELECT lang, source, round(avg(n_chars), 6) AS mean FROM documents GROUP BY ALL)) WHERE r = 1",
}
