"""Retrieval: BM25, vector top-k, rank fusion, diversity re-ranking."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import tokens
from corvane.shared import new_dir, written


def bm25_scores(docs: DataFrame, queries: DataFrame, doc_id: str, query_id: str, text: str = "text", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score) of documents that share a term with a query.

    idf is ln((N - df + 0.5) / (df + 0.5)), negatives replaced by a quarter of the mean idf of all terms; query terms
    count once; a document without terms counts as one of a single term of its own. Documents are told apart by their ids: rows that share
    an id and a length are one document's. Only terms of queries are counted by document and joined.
    """
    if k1 <= 0 or not 0 <= b <= 1:
        raise ValueError("k1 must be positive and b between 0 and 1")
    t = tokens(F.coalesce(F.col(text), F.lit("")))
    toks = docs.select(F.col(doc_id).alias("d"), F.when(F.size(t) == 0, F.array(F.lit("__empty__"))).otherwise(t).alias("t")).withColumn("dl", F.size("t"))
    # one pass gives df of all terms and, under a null term, the number of documents and their lengths
    seen = toks.select("dl", F.explode(F.array_append(F.array_distinct("t"), F.lit(None))).alias("term"))
    seen = seen.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("length"))
    stats = seen.where("term IS NULL").select(F.col("df").alias("n"), (F.col("length") / F.col("df")).alias("avgdl"))
    df = seen.where("term IS NOT NULL").crossJoin(stats)  # one row beside all
    df = df.withColumn("raw", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    mean = df.agg(F.avg("raw").alias("mean_idf"))
    terms = queries.select(F.col(query_id).alias("q"), F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))
    asked = terms.select("term").distinct()
    idf = df.join(asked, "term", "left_semi").crossJoin(mean).select("term", "avgdl", F.when(F.col("raw") < 0, 0.25 * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))
    # terms that no query asks for go before counts are taken
    tf = toks.select("d", "dl", F.explode("t").alias("term")).join(asked, "term", "left_semi").groupBy("term", "d", "dl").agg(F.count(F.lit(1)).alias("tf"))
    hits = tf.join(terms, "term").join(idf, "term")
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("q", "d").agg(F.sum(weight).alias("score")).withColumnsRenamed({"q": query_id, "d": doc_id})


def _terms_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(d, t): a row for each row of docs with its tokens; a document without any has one of its own."""
    t = tokens(F.coalesce(F.col(text), F.lit("")))
    return docs.select(F.col(doc_id).alias("d"), F.when(F.size(t) == 0, F.array(F.lit("__empty__"))).otherwise(t).alias("t"))


def bm25_top_k(docs: DataFrame, queries: DataFrame, doc_id: str, query_id: str, k: int, text: str = "text", k1: float = 1.5, b: float = 0.75, digits: int = 6, block_terms: int = 200_000) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best rows of docs by BM25 for each query, ties by id; scores and formula are those of bm25_scores, rounded to `digits`.

    Terms are counted once over all documents. Queries are dealt to blocks of some block_terms terms, written with their idf to the shared folder; a scan of
    docs for each block scores documents batch by batch as a sparse product, and a task sends on only its k best rows for each query.
    No row is made for a pair of a query and a document that isn't among these. Each row of docs is a document, whatever its id; rows of queries that share an id are one query.
    """
    if k1 <= 0 or not 0 <= b <= 1:
        raise ValueError("k1 must be positive and b between 0 and 1")
    spark, toks = docs.sparkSession, _terms_of(docs, doc_id, text)
    seen = toks.select(F.size("t").alias("dl"), F.explode(F.array_append(F.array_distinct("t"), F.lit(None))).alias("term"))
    seen = written(seen.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("length")), "terms")
    total = seen.where("term IS NULL").first()
    if total is None:
        return spark.createDataFrame([], f"`{query_id}` {queries.schema[query_id].dataType.simpleString()}, `{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, score double, rank int")
    n, avgdl = total["df"], total["length"] / total["df"]
    raw = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = seen.where("term IS NOT NULL").select("term", raw.alias("raw"))
    mean = known.agg(F.avg("raw")).first()[0]
    asked = queries.select(F.col(query_id).alias("q"), F.explode(tokens(F.coalesce(F.col(text), F.lit("")))).alias("term")).distinct()
    asked = asked.join(known, "term").select("q", "term", F.when(F.col("raw") < 0, 0.25 * mean).otherwise(F.col("raw")).alias("idf"))
    size = asked.count()
    blocks = max(1, -(-size // block_terms))
    folder = new_dir(spark, "query-blocks")
    asked.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")).write.partitionBy("block").parquet(folder)
    kind, name = queries.schema[query_id].dataType.simpleString(), docs.schema[doc_id].dataType.simpleString()

    def scan(block: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import pyarrow.dataset as ds
            from pyarrow import fs

            system, path = fs.FileSystem.from_uri(f"{folder}/block={block}")
            if system.get_file_info(path).type == fs.FileType.NotFound:
                return
            table = ds.dataset(path, filesystem=system, format="parquet").to_table(columns=["q", "term", "idf"])
            query = table["q"].combine_chunks().dictionary_encode()
            term = table["term"].combine_chunks().dictionary_encode()
            names, vocabulary, of, idf = query.dictionary, term.dictionary, term.indices.to_numpy(), np.zeros(len(term.dictionary))
            idf[of] = table["idf"].to_numpy()
            order = np.argsort(of, kind="stable")
            takers, times = query.indices.to_numpy()[order], np.bincount(of, minlength=len(vocabulary))
            first = np.cumsum(times) - times
            best: tuple = ()
            for whole in batches:
                # a row has at most len(table) hits, so these slices bound them
                step = max(1, min(512, 1_000_000 // max(len(table), 1)))
                for at in range(0, whole.num_rows, step):
                    batch = whole.slice(at, step)
                    lists = batch.column(1)
                    cut = lists.offsets.to_numpy()
                    dl = np.diff(cut)
                    place = pc.fill_null(pc.index_in(lists.flatten(), value_set=vocabulary), -1).to_numpy().astype(np.int64)
                    row = np.repeat(np.arange(len(dl)), dl)[place >= 0]
                    key, tf = np.unique(row * len(vocabulary) + place[place >= 0], return_counts=True)
                    row, place = np.divmod(key, len(vocabulary))
                    weight = idf[place] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[row] / avgdl))
                    n_hits = times[place]
                    hit = np.arange(n_hits.sum()) - np.repeat(np.cumsum(n_hits) - n_hits, n_hits) + np.repeat(first[place], n_hits)
                    pair = takers[hit].astype(np.int64) * len(dl) + np.repeat(row, n_hits)
                    found, inverse = np.unique(pair, return_inverse=True)
                    score = np.round(np.bincount(inverse, weights=np.repeat(weight, n_hits), minlength=len(found)), digits) + 0.0
                    q, r = np.divmod(found, len(dl))
                    best = _kept(best, (q, batch.column(0).take(pa.array(r)), score), k)
            if best:
                yield pa.RecordBatch.from_arrays([names.take(pa.array(best[0])), best[1], pa.array(best[2])], names=["q", "d", "s"])

        return toks.mapInArrow(run, f"q {kind}, d {name}, s double")

    out = scan(0)
    for block in range(1, blocks):
        out = out.unionByName(scan(block))
    return top_k(out.toDF(query_id, doc_id, "score"), [query_id], [F.desc("score"), F.asc_nulls_last(doc_id)], k)


def _kept(best: tuple, new: tuple, k: int) -> tuple:
    """(query, id, score) of the k best of each query of two such triples, by falling score, then id."""
    if best:
        new = (np.concatenate([best[0], new[0]]), pa.concat_arrays([best[1], new[1]]), np.concatenate([best[2], new[2]]))
    q, ids, score = new
    rank = pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy() if len(ids) else np.empty(0)
    order = np.lexsort((rank, -score, q))
    nth = np.arange(len(q)) - np.searchsorted(q[order], q[order])
    order = order[nth < k]
    return q[order], ids.take(pa.array(order)), score[order]


def hashed_vectors(docs: DataFrame, doc_id: str, text: str = "text", size: int = 64, vector: str = "embedding") -> DataFrame:
    """(doc_id, vector): the offline default embedder. A text's vector has, for each of `size` slots, how many of its tokens fall there, by the first 32 bits of their md5; null texts have none."""
    name = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            coded = batch.column(1).flatten().dictionary_encode()
            slot = np.array([int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "big") % size for w in coded.dictionary.to_pylist()], dtype=np.int64)
            row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(1).offsets.to_numpy()))
            counts = np.bincount(row * size + slot[coded.indices.to_numpy()] if len(row) else row, minlength=batch.num_rows * size)[: batch.num_rows * size].astype(np.float64)
            lists = pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * size, pa.array(counts))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["d", "v"])

    toks = docs.select(F.col(doc_id).alias("d"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    return toks.mapInArrow(run, f"d {name}, v array<double>").toDF(doc_id, vector)


def reranked(hits: DataFrame, score: Column, query_id: str, doc_id: str, k: int, original: str = "original_rank") -> DataFrame:
    """hits with `rerank_score` and `rank`: the k best of each query by score (a Column over the hits), ties by their rank so far, which stays in `original`."""
    return top_k(hits.withColumn("rerank_score", score), [query_id], [F.desc_nulls_last("rerank_score"), F.col(original), F.col(doc_id)], k)


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group by order, with their 0-based rank."""
    first = df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)
    return first.withColumn(rank, F.col(rank) - 1)


def _scored(base: DataFrame, queries: DataFrame, pick: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], vec_id: str, query_id: str, vector: str, block_bytes: int) -> DataFrame:
    """(query_id, vec_id, similarity) of the pairs that `pick` takes of a matrix of cosines (rows by queries, 6 digits) and its row ids.

    Queries are a stated set. They are read in blocks of at most block_bytes, each sent to tasks and met by one scan of base. Vectors that are null, empty or hold a null,
    NaN or infinity take no part, on either side, nor do those of another length than the first query's.
    """
    spark = base.sparkSession
    id_type = queries.select(query_id).limit(0).toArrow().schema.field(0).type
    kinds = base.schema[vec_id].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()

    def unit(v: np.ndarray) -> np.ndarray:
        return v / np.where((norm := np.linalg.norm(v, axis=1, keepdims=True)) == 0, 1, norm)

    def scan(ids: list, vectors: np.ndarray) -> DataFrame:
        sent = spark.sparkContext.broadcast((pa.array(ids, id_type), unit(vectors)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, block = sent.value
            for whole in batches:
                for at in range(0, whole.num_rows, 2000):
                    batch = whole.slice(at, 2000)
                    lists = batch.column(1)
                    rows = unit(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1))
                    own = batch.column(0).to_numpy(zero_copy_only=False)
                    # tiles of a million cosines, however many queries there are
                    for low in range(0, len(block), 512):
                        sim = np.round(rows @ block[low : low + 512].T, 6) + 0.0
                        r, q = pick(sim, own)
                        for some in range(0, len(r), 100_000):
                            i, j = r[some : some + 100_000], q[some : some + 100_000]
                            yield pa.RecordBatch.from_arrays([names.take(pa.array(low + j)), batch.column(0).take(pa.array(i)), pa.array(sim[i, j])], names=["q", "v", "s"])

        rows = base.where(fit & (F.size(vector) == vectors.shape[1])).select(F.col(vec_id), F.col(vector)).mapInArrow(run, f"q {kinds[1]}, v {kinds[0]}, s double")
        return rows.toDF(query_id, vec_id, "similarity")

    fit = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out, ids, held, size = None, [], [], 0
    first = queries.where(fit).select(F.size(vector)).first()
    for row in queries.where(fit & (F.size(vector) == (first[0] if first else 0))).select(query_id, vector).toLocalIterator():
        ids.append(row[0])
        held.append(row[1])
        size += 8 * len(row[1])
        if size >= block_bytes:
            some = scan(ids, np.array(held, dtype=np.float64))
            out, ids, held, size = some if out is None else out.unionByName(some), [], [], 0
    if ids:
        some = scan(ids, np.array(held, dtype=np.float64))
        out = some if out is None else out.unionByName(some)
    return out if out is not None else spark.createDataFrame([], f"`{query_id}` {kinds[1]}, `{vec_id}` {kinds[0]}, similarity double")


def vector_top_k(base: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", query_id: str = "query_id", vector: str = "embedding", block_bytes: int = 32 << 20) -> DataFrame:
    """(query_id, vec_id, similarity, rank) of the k nearest by cosine, ties by id; of each batch only k a query go on. Null vectors are left out."""

    def nearest(sim: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((np.broadcast_to(ids[:, None], sim.shape), -sim), axis=0)[:k]
        return order.ravel(), np.tile(np.arange(sim.shape[1]), len(order))

    return top_k(_scored(base, queries, nearest, vec_id, query_id, vector, block_bytes), [query_id], [F.desc("similarity"), F.col(vec_id)], k)


def vectors_within(base: DataFrame, queries: DataFrame, least: float, vec_id: str = "vec_id", query_id: str = "query_id", vector: str = "embedding", block_bytes: int = 32 << 20) -> DataFrame:
    """(query_id, vec_id, similarity) of all pairs with a cosine of `least` or more; no other pair leaves a task."""
    return _scored(base, queries, lambda sim, ids: np.nonzero(sim >= least), vec_id, query_id, vector, block_bytes)


def nearest_query(base: DataFrame, queries: DataFrame, vec_id: str = "vec_id", query_id: str = "query_id", vector: str = "embedding", block_bytes: int = 32 << 20) -> DataFrame:
    """(query_id, vec_id, similarity): for each vector of base the query it is nearest to, the smaller id where tied."""
    best = _scored(base, queries.orderBy(query_id), lambda sim, ids: (np.arange(len(sim)), sim.argmax(axis=1)), vec_id, query_id, vector, block_bytes)
    return best.groupBy(vec_id).agg(F.min(F.struct((-F.col("similarity")).alias("s"), query_id)).alias("x")).select(f"x.{query_id}", vec_id, (-F.col("x.s")).alias("similarity"))


def rrf(ranked: DataFrame, query_id: str, doc_id: str, rank: str = "rank", constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (0-based ranks): rrf and the number of lists that hold the document."""
    return ranked.groupBy(query_id, doc_id).agg(F.sum(1.0 / (constant + F.col(rank))).alias("rrf"), F.count(F.lit(1)).alias("appearances"))


def hybrid(semantic: DataFrame, lexical: DataFrame, query_id: str, doc_id: str, k: int, constant: int = 60) -> DataFrame:
    """The k best by rank fusion of two ranked lists (0-based `rank`): rrf, semantic_rank and bm25_rank (null where a list lacks the document), original_rank.

    Equal sums go by the semantic rank, then the lexical one, then the id.
    """
    both = semantic.select(query_id, doc_id, "rank", F.lit("s").alias("list")).unionByName(lexical.select(query_id, doc_id, "rank", F.lit("b").alias("list")))
    of = lambda x: F.max(F.when(F.col("list") == x, F.col("rank")))
    fused = both.groupBy(query_id, doc_id).agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("rrf"), of("s").alias("semantic_rank"), of("b").alias("bm25_rank"))
    return top_k(fused, [query_id], [F.desc("rrf"), F.asc_nulls_last("semantic_rank"), F.asc_nulls_last("bm25_rank"), F.col(doc_id)], k, "original_rank")


def mmr(candidates: DataFrame, query_id: str, doc_id: str, similarity: str, vector: str, k: int, weight: float = 0.5) -> DataFrame:
    """Maximal marginal relevance over each query's candidates, of which the caller keeps a bounded number."""
    if not 0 <= weight <= 1:
        raise ValueError("weight must be between 0 and 1")
    q, d = candidates.schema[query_id].dataType.simpleString(), candidates.schema[doc_id].dataType.simpleString()

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([similarity, doc_id], ascending=[False, True])
        v = np.array(pdf[vector].tolist(), dtype=np.float64)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        sim, left, chosen = pdf[similarity].to_numpy(), list(range(len(pdf))), []
        near = np.full(len(pdf), -np.inf)
        while left and len(chosen) < k:
            scores = [sim[i] if not chosen else weight * sim[i] - (1 - weight) * near[i] for i in left]
            best = left.pop(int(np.argmax(scores)))
            chosen.append(best)
            near = np.maximum(near, v @ v[best])
        return pd.DataFrame({query_id: pdf[query_id].iloc[chosen], doc_id: pdf[doc_id].iloc[chosen], "pick": range(len(chosen))})

    return candidates.groupBy(query_id).applyInPandas(pick, f"{query_id} {q}, {doc_id} {d}, pick long")


def hashed_embedding(words: Column, size: int = 64) -> Column:
    """Offline default embedder: counts of words by hash; deterministic, without a model."""
    slots = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("float"))


def hottest(accesses: DataFrame, item: str, at: str, most: int = 32) -> DataFrame:
    """(item) of the `most` items that were accessed last, ties to the greater item: what a memory of that size holds whose least recently used item goes first."""
    return accesses.groupBy(item).agg(F.max(at).alias("last")).orderBy(F.desc("last"), F.desc(item)).limit(most).select(item)


def tiered(items: DataFrame, hot: DataFrame, queries: DataFrame, item: str, query_id: str, tier: str, k: int, text: str = "text") -> DataFrame:
    """(query_id, item, tier, score, rank): the k best items for each query over three tiers. Hot items (at most some dozen, broadcast) score the share of a query's words of three letters or more that they have,
    1 if they have the whole query, and 0.2 more; warm and cold ones, by the column `tier`, their cosine by hashed term vectors, cold ones 0.1 less; 2 * k of either tier are looked at. An item found in more
    than one way counts with its best score; ties go by item."""
    words = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0)), lambda w: F.length(w) >= 3))
    asked = queries.select(F.col(query_id).alias("q"), F.coalesce(F.col(text), F.lit("")).alias("query_text")).where(F.trim("query_text") != "")
    held = items.join(F.broadcast(hot.select(item)), item, "left_semi").select(F.col(item).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("item_text"))
    both = asked.crossJoin(F.broadcast(held))  # a few rows beside each query
    share = F.size(F.array_intersect(words(F.col("query_text")), words(F.col("item_text")))) / F.greatest(F.size(words(F.col("query_text"))), F.lit(1))
    lexical = F.when(F.contains(F.lower("item_text"), F.lower("query_text")), 1.0).otherwise(share)
    found = both.select("q", "i", F.lit("hot").alias("t"), (lexical + 0.2).alias("s"), lexical.alias("raw")).where("raw > 0").drop("raw")
    vectors = hashed_vectors(queries.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != ""), query_id, text)
    for name, more in (("warm", 0.0), ("cold", -0.1)):
        base = hashed_vectors(items.where(F.col(tier) == name), item, text)
        near = vector_top_k(base, vectors, 2 * k, vec_id=item, query_id=query_id)
        found = found.unionByName(near.select(F.col(query_id).alias("q"), F.col(item).alias("i"), F.lit(name).alias("t"), (F.greatest("similarity", F.lit(0.0)) + more).alias("s")))
    best = found.groupBy("q", "i").agg(F.max(F.struct(F.round("s", 6).alias("s"), "t")).alias("b")).select(F.col("q").alias(query_id), F.col("i").alias(item), F.col("b.t").alias("tier"), F.col("b.s").alias("score"))
    return top_k(best, [query_id], [F.desc("score"), F.col(item)], k)
