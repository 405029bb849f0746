"""Queries of the retrieval family."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.catalog import query
from corvane.functions.text import ascii_words, fixed_chunks, redacted, tokens, word_chunks
from corvane.operators import retrieval as R
from corvane.operators.similar import jaccard_links
from corvane.sources.tables import table

_TOK = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]([\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}.]*[\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}])?')"
_BM25 = rf"""
WITH t AS (SELECT doc_id, CASE WHEN len(t) = 0 THEN ['__empty__'] ELSE t END AS t FROM (SELECT doc_id, {_TOK.format('text')} AS t FROM documents)),
e AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM t),
tf AS (SELECT term, doc_id, dl, count(*) AS tf FROM e GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM t),
df AS (SELECT term, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM tf, st GROUP BY term, n),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM df) ELSE raw END AS idf FROM df),
q AS (SELECT item_id, unnest(list_distinct({_TOK.format('text')})) AS term FROM benchmark),
sc AS (SELECT item_id, doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN q USING (term) JOIN idf USING (term), st GROUP BY ALL),
r AS (SELECT item_id, doc_id, round(score, 6) AS score FROM sc)
"""


def _bm25(spark, d, k):
    return R.bm25_top_k(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id", k)


@query("c01_bm25_search", _BM25 + "SELECT item_id, doc_id, score, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) - 1)::INT AS rank FROM r QUALIFY rank < 10")
def bm25_search(spark, d):
    return _bm25(spark, d, 10)


@query("g22_bm25_corpus_stats", _BM25 + "SELECT count(*)::BIGINT AS terms, round(sum(raw), 3) AS raw_sum, round(max(raw), 6) AS raw_max FROM df")
def corpus_stats(spark, d):
    t = tokens(F.coalesce(F.col("text"), F.lit("")))
    toks = table(spark, d, "documents").select("doc_id", F.when(F.size(t) == 0, F.array(F.lit("__empty__"))).otherwise(t).alias("t"))
    df = toks.select("doc_id", F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    df = df.crossJoin(toks.agg(F.count(F.lit(1)).alias("n"))).select(raw.alias("raw"))
    return df.agg(F.count(F.lit(1)).alias("terms"), F.round(F.sum("raw"), 3).alias("raw_sum"), F.round(F.max("raw"), 6).alias("raw_max"))


_COS = "round(list_cosine_similarity(b.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"
_VEC = f"""
WITH s AS (SELECT q.vec_id AS query_id, b.vec_id, {_COS} AS similarity FROM embeddings b, embeddings q WHERE q.vec_id % 50 = 0),
v AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) - 1)::INT AS rank FROM s QUALIFY rank < 20)
"""


def _vectors(spark, d, k=20):
    base = table(spark, d, "embeddings")
    return R.vector_top_k(base, base.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), k)


@query("t02_vector_top_k", _VEC + "SELECT * FROM v")
def vector_top(spark, d):
    return _vectors(spark, d)


@query("f09_distance_score", _VEC + "SELECT query_id, vec_id, greatest(0.0, 1 - (1 - similarity)) AS score FROM v WHERE rank < 5")
def distance_score(spark, d):
    return _vectors(spark, d, 5).select("query_id", "vec_id", F.greatest(F.lit(0.0), 1 - (1 - F.col("similarity"))).alias("score"))


@query("p10_similarity_filter", _VEC + "SELECT query_id, count(*)::BIGINT AS kept FROM s WHERE similarity >= 0.3 GROUP BY query_id")
def similarity_filter(spark, d):
    base = table(spark, d, "embeddings")
    near = R.vectors_within(base, base.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), 0.3)
    return near.groupBy("query_id").agg(F.count(F.lit(1)).alias("kept"))


@query("c03_mmr")
def mmr(spark, d):
    near = _vectors(spark, d).join(table(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id")
    return R.mmr(near, "query_id", "vec_id", "similarity", "embedding", k=5)


@query("f01_bm25_tokens", rf"SELECT doc_id, len({_TOK.format('text')})::BIGINT AS n_tokens, len(list_distinct({_TOK.format('text')}))::BIGINT AS n_terms FROM documents")
def bm25_tokens(spark, d):
    t = tokens(F.coalesce(F.col("text"), F.lit("")))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_terms"))


@query("f02_word_filter", "SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) >= 3))::BIGINT AS n FROM documents")
def word_filter(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(F.filter(ascii_words(F.col("text")), lambda w: F.length(w) >= 3)).cast("long").alias("n"))


@query("f05_fixed_chunks", "SELECT doc_id, i::INT AS chunk, substring(text, i * 500 + 1, 500) AS body FROM (SELECT doc_id, text, unnest(range(0, greatest((length(text) - 1) // 500, 0) + 1)) AS i FROM documents)")
def chunks(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(fixed_chunks(F.col("text"), 500)).alias("chunk", "body"))


@query("f04_word_chunks")
def chunked(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(word_chunks(F.col("text"), 900, 180)).alias("chunk", "body"))


@query("f06_chunk_ids", "SELECT doc_id, substring(md5(source || '::chunk_' || doc_id), 1, 16) AS chunk_id FROM documents")
def chunk_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring(F.md5(F.concat(F.col("source"), F.lit("::chunk_"), F.col("doc_id").cast("string"))), 1, 16).alias("chunk_id"))


@query("f07_content_hashes", "SELECT doc_id, sha256(text) AS full_hash, substring(sha256(substring(text, 1, 300)), 1, 12) AS head_hash FROM documents")
def hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("full_hash"), F.substring(F.sha2(F.substring("text", 1, 300), 256), 1, 12).alias("head_hash"))


@query("s09_fingerprints", "SELECT substring(sha256(text), 1, 16) AS fingerprint, count(*)::BIGINT AS n, min(doc_id) AS first_id FROM documents GROUP BY 1")
def fingerprints(spark, d):
    return table(spark, d, "documents").groupBy(F.substring(F.sha2("text", 256), 1, 16).alias("fingerprint")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@query("f10_redaction")
def redaction(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(redacted(F.col("text"))).alias("clean_md5"), F.regexp_count(redacted(F.col("text")), F.lit(r"\[REDACTED\]")).cast("long").alias("n_secrets"))


@query("u05_word_jaccard", """WITH w AS MATERIALIZED (SELECT doc_id, lang, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS w FROM documents), u AS (SELECT doc_id, lang, len(w) AS n, unnest(w) AS word FROM w),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS c FROM u x JOIN u y ON x.word = y.word AND x.lang IS NOT DISTINCT FROM y.lang AND x.doc_id < y.doc_id GROUP BY ALL)
SELECT a, b, round(c / (na + nb - c), 9) AS jaccard FROM c WHERE 100 * c >= 80 * (na + nb - c)""")
def word_jaccard(spark, d):
    w = table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), ascii_words(F.coalesce(F.col("text"), F.lit(""))).alias("w"))
    return jaccard_links(w, "doc_id", "w", 80, ["lang"]).select("a", "b", F.round(F.col("common") / (F.col("size_a") + F.col("size_b") - F.col("common")), 9).alias("jaccard"))


@query("g24_nearest_prototype", """WITH p AS (SELECT label, min(vec_id) AS p FROM embeddings GROUP BY label), s AS (
 SELECT b.vec_id, p.label AS proto, round(list_cosine_similarity(b.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS sim FROM embeddings b, p JOIN embeddings q ON q.vec_id = p.p)
SELECT vec_id, proto, sim FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, proto) = 1""")
def nearest_prototype(spark, d):
    base = table(spark, d, "embeddings")
    protos = base.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding")).withColumnRenamed("label", "proto")
    best = R.nearest_query(base, protos.withColumnRenamed("proto", "query_id"))
    return best.select("vec_id", F.col("query_id").alias("proto"), F.col("similarity").alias("sim"))


# Hashed term vectors stand in for a model's: how many tokens of a text fall into each of 64 slots, by the first 32 bits of their md5.
_SLOT = "(('0x' || substr(md5(term), 1, 8))::BIGINT % 64)"
_FUSED = _BM25 + f""", hd AS (SELECT doc_id, {_SLOT} AS slot, count(*)::DOUBLE AS c FROM e WHERE term <> '__empty__' GROUP BY ALL), hq AS (SELECT item_id, {_SLOT} AS slot, count(*)::DOUBLE AS c FROM (SELECT item_id, unnest({_TOK.format('text')}) AS term FROM benchmark) GROUP BY ALL),
nd AS (SELECT doc_id, sqrt(sum(c * c)) AS n FROM hd GROUP BY 1), nq AS (SELECT item_id, sqrt(sum(c * c)) AS n FROM hq GROUP BY 1), dots AS (SELECT item_id, doc_id, sum(hd.c * hq.c) AS dot FROM hd JOIN hq USING (slot) GROUP BY ALL),
vs AS (SELECT i.item_id, x.doc_id, coalesce(round(dot / (nd.n * nq.n), 6), 0) AS similarity FROM benchmark i CROSS JOIN documents x LEFT JOIN dots USING (item_id, doc_id) LEFT JOIN nd USING (doc_id) LEFT JOIN nq USING (item_id)),
vl AS (SELECT item_id, doc_id, 's' AS list, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, doc_id) - 1 AS rank FROM vs QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, doc_id) <= 20
 UNION ALL SELECT item_id, doc_id, 'b', row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) - 1 FROM r QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20)
"""
_HYBRID = _FUSED + """, vf AS (SELECT item_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS rrf, max(rank) FILTER (WHERE list = 's')::INT AS semantic_rank, max(rank) FILTER (WHERE list = 'b')::INT AS bm25_rank FROM vl GROUP BY 1, 2),
h AS (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY rrf DESC, semantic_rank NULLS LAST, bm25_rank NULLS LAST, doc_id) - 1)::INT AS original_rank FROM vf QUALIFY original_rank < @K)
"""


def _lists(spark, d):
    """The 20 best documents of each item by hashed term vectors, and by BM25."""
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    semantic = R.vector_top_k(R.hashed_vectors(docs, "doc_id"), R.hashed_vectors(items, "item_id"), 20, vec_id="doc_id", query_id="item_id")
    return semantic.select("item_id", "doc_id", "rank"), _bm25(spark, d, 20).select("item_id", "doc_id", "rank")


@query("c02_rrf_fusion", _FUSED + "SELECT item_id AS query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS rrf, count(*)::BIGINT AS appearances FROM vl GROUP BY ALL")
def rrf_fusion(spark, d):
    semantic, lexical = _lists(spark, d)
    return R.rrf(semantic.unionByName(lexical), "item_id", "doc_id").withColumn("rrf", F.round("rrf", 9)).withColumnRenamed("item_id", "query_id")


def _hybrid(spark, d, k=10):
    return R.hybrid(*_lists(spark, d), "item_id", "doc_id", k)


# What a cross-encoder's place is taken by: the share of an item's word pairs that the document has, then of its words.
_PAIRS = "list_distinct(list_transform(range(1, len(t{0})), lambda i: t{0}[i] || ' ' || t{0}[i + 1]))"
_RERANK = f""", tt AS (SELECT h.*, {_TOK.format('b.text')} AS tq, {_TOK.format('x.text')} AS td FROM h JOIN documents x USING (doc_id) JOIN benchmark b USING (item_id)),
rr AS (SELECT item_id, doc_id, original_rank, round(coalesce(len(list_intersect({_PAIRS.format('q')}, {_PAIRS.format('d')})) / nullif(len({_PAIRS.format('q')}), 0)::DOUBLE, 0) + 0.001 * coalesce(len(list_intersect(tq, td)) / nullif(len(list_distinct(tq)), 0)::DOUBLE, 0), 6) AS rerank_score FROM tt)
SELECT item_id, doc_id, original_rank, rerank_score, (row_number() OVER (PARTITION BY item_id ORDER BY rerank_score DESC, original_rank, doc_id) - 1)::INT AS rank FROM rr QUALIFY rank < @K"""


def _overlap(query, doc):
    """The offline default scorer of a pair of texts, as Columns: any other Column over the hits, a pandas UDF with a model too, can take its place."""
    q, t = tokens(F.coalesce(query, F.lit(""))), tokens(F.coalesce(doc, F.lit("")))
    pairs = lambda x: F.array_distinct(F.zip_with(F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)))
    share = lambda a, b: F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a))), F.lit(0.0))
    return F.round(share(pairs(q), pairs(t)) + 0.001 * share(q, t), 6)


def _reranked(spark, d, fetch, k):
    texts = _hybrid(spark, d, fetch).join(table(spark, d, "documents").select("doc_id", F.col("text").alias("doc")), "doc_id").join(table(spark, d, "benchmark").select("item_id", F.col("text").alias("asked")), "item_id")
    return R.reranked(texts, _overlap(F.col("asked"), F.col("doc")), "item_id", "doc_id", k).select("item_id", "doc_id", "original_rank", "rerank_score", "rank")


@query("t05_rerank", _HYBRID.replace("@K", "10") + _RERANK.replace("@K", "10"))
def rerank(spark, d):
    """All ten hits of the hybrid search in the reranker's order."""
    return _reranked(spark, d, 10, 10)


@query("c02_hybrid_search", _HYBRID.replace("@K", "10") + "SELECT * FROM h")
def hybrid_search(spark, d):
    return _hybrid(spark, d)


@query("c04_three_stage", _HYBRID.replace("@K", "20") + _RERANK.replace("@K", "5"))
def three_stage(spark, d):
    """Hybrid search for 20 hits, of which the reranker keeps 5."""
    return _reranked(spark, d, 20, 5)
