"""Approximate nearest neighbours: balanced posting lists, boundary vectors in several, centroids in a graph, lists picked by distance ratio."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import written
from corvane.llm.vectors import matrix, usable

#: Rows that the lists' centroids are fitted on, at most.
SAMPLE_ROWS = 65_536
#: Lists at most: their centroids are in the driver's memory and in each worker's. Beyond, lists get longer and are cut in more parts.
MOST_LISTS = 65_536
#: A list has about this many rows at least.
LEAST_ROWS = 64
#: A vector is in lists whose centroids are at most so much further than the nearest one, in COPIES at most.
BOUNDARY, COPIES = 1.1, 3
#: Queries that the ratio is set by, and the share of their true neighbours that it has to reach.
PROBES, REACH = 64, 0.97
#: A part of a list has about so many rows, and meets so many queries at once.
PART_ROWS, BLOCK_ROWS = 4096, 16_384


def _apart(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x and c."""
    return np.maximum((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * (x @ c.T), 0)


def balanced_centroids(sample: np.ndarray, lists: int, rounds: int = 3) -> np.ndarray:
    """Centroids of `lists` groups of nearly equal size, then moved to the means of the rows nearest to them.

    Groups are halved by rank along the line between two far rows until there are enough, so that rows which cluster closely
    get more centroids, not longer lists. Centroids that coincide count once.
    """
    groups = [np.arange(len(sample))]
    while len(groups) < lists and len(groups[-1]) > 1:
        groups.sort(key=len)
        rows = groups.pop()
        x = sample[rows]
        a = x[np.argmax(_apart(x, x[:1])[:, 0])]
        b = x[np.argmax(_apart(x, a[None])[:, 0])]
        order = np.argsort(x @ (b - a), kind="stable")
        groups += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
        if len(groups) < lists:
            groups.sort(key=len)
    centroids = np.unique(np.array([sample[g].mean(axis=0) for g in groups if len(g)]), axis=0)
    for _ in range(rounds):
        near = np.concatenate([_apart(sample[i : i + 2048], centroids).argmin(axis=1) for i in range(0, len(sample), 2048)])
        count = np.bincount(near, minlength=len(centroids))
        order = np.argsort(near, kind="stable")
        some = np.flatnonzero(count)
        sums = np.add.reduceat(sample[order], (np.cumsum(count) - count)[some], axis=0)
        centroids[some] = sums / count[some, None]
    return np.unique(centroids, axis=0)


class CentroidGraph:
    """Centroids with links to their nearest ones, both ways, and along the first axis, so that each reaches each."""

    def __init__(self, centroids: np.ndarray, links: int = 16):
        self.centroids, n = centroids, len(centroids)
        near = [set() for _ in range(n)]
        for at in range(0, n, 512):
            d = _apart(centroids[at : at + 512], centroids)
            for i, row in enumerate(np.argpartition(d, min(links, n - 1), axis=1)[:, : links + 1].tolist() if n > 1 else [[0]], at):
                for j in row:
                    if i != j:
                        near[i].add(j)
                        near[j].add(i)
        order = np.argsort(centroids[:, 0], kind="stable").tolist() if n else []
        for i, j in zip(order, order[1:]):
            near[i].add(j)
            near[j].add(i)
        self.links = [np.array(sorted(x), dtype=np.int64) for x in near]
        width = max((len(x) for x in self.links), default=0)
        self.table = np.array([np.pad(x, (0, width - len(x)), constant_values=i) for i, x in enumerate(self.links)], dtype=np.int64).reshape(n, width)
        self.norms = (centroids * centroids).sum(axis=1)

    def nearest(self, x: np.ndarray, beam: int = 24) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, distances) of the `beam` nearest found for each row of x, nearest first: a walk of all rows at once."""
        n, rows = len(self.centroids), len(x)
        beam = min(beam, n)
        best = np.tile(np.linspace(0, n - 1, beam).astype(np.int64), (rows, 1))  # walks start at centroids spread over all
        dist = self._to(x, best)
        open_ = np.ones_like(best, dtype=bool)
        while open_.any():
            pick = np.where(open_, dist, np.inf).argmin(axis=1)
            walk = np.flatnonzero(open_[np.arange(rows), pick])
            node = best[walk, pick[walk]]
            open_[walk, pick[walk]] = False
            found = self.table[node]
            fresh = ~(found[:, :, None] == best[walk][:, None, :]).any(axis=2)
            d = np.where(fresh, self._to(x[walk], found), np.inf)
            every, far = np.concatenate([best[walk], found], axis=1), np.concatenate([dist[walk], d], axis=1)
            new = np.concatenate([open_[walk], fresh], axis=1)
            # a node that two links name is taken once
            order = np.lexsort((every, far), axis=1)
            every, far, new = (np.take_along_axis(v, order, axis=1) for v in (every, far, new))
            twin = np.concatenate([np.zeros((len(walk), 1), bool), (every[:, 1:] == every[:, :-1]) & np.isfinite(far[:, 1:])], axis=1)
            far = np.where(twin, np.inf, far)
            order = np.argsort(far, axis=1, kind="stable")[:, :beam]
            best[walk], dist[walk] = np.take_along_axis(every, order, axis=1), np.take_along_axis(far, order, axis=1)
            open_[walk] = np.take_along_axis(new, order, axis=1) & np.isfinite(dist[walk])
        order = np.lexsort((best, dist), axis=1)
        return np.take_along_axis(best, order, axis=1), np.sqrt(np.take_along_axis(dist, order, axis=1))

    def _to(self, x: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        dots = np.einsum("rd,rkd->rk", x, self.centroids[nodes])
        return np.maximum((x * x).sum(axis=1)[:, None] + self.norms[nodes] - 2 * dots, 0)

    def within(self, x: np.ndarray, ratio: float, rows: np.ndarray, least: int) -> np.ndarray:
        """Centroids at most `ratio` times as far from the vector x as the nearest one, and more until their lists have `least` rows: nearest first."""
        start = int(self.nearest(x[None])[0][0, 0])
        d0 = float(self._to(x[None], np.array([[start]]))[0, 0])
        limit, heap, seen, out, have = math.sqrt(d0) * ratio, [(d0, start)], {start}, [], 0
        while heap:
            d, node = heapq.heappop(heap)
            if math.sqrt(d) > limit and have >= least:
                break
            out.append(node)
            have += int(rows[node])
            fresh = [j for j in self.links[node].tolist() if j not in seen]
            if fresh:
                seen.update(fresh)
                for dd, j in zip(self._to(x[None], np.array([fresh]))[0].tolist(), fresh, strict=True):
                    heapq.heappush(heap, (dd, j))
        return np.array(out, dtype=np.int64)


def _best(block: np.ndarray, rows: np.ndarray, ids: list, own: list, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance): for each query its k nearest rows up to its bound that are not its own, by distance, then id (null last)."""
    d = np.sqrt(_apart(block, rows))
    slack = 1e-6 * (1 + np.sqrt((block * block).sum(axis=1)) + np.sqrt((rows * rows).sum(axis=1).max(initial=0.0)))
    cut = bound + slack
    if d.shape[1] > k:
        # own rows could stand among the first k, so one more for each of them
        times = Counter(ids)
        spare = max((times[o] for o in own), default=0)
        if d.shape[1] > k + spare:
            cut = np.minimum(cut, np.partition(d, k + spare - 1, axis=1)[:, k + spare - 1] + 2 * slack)
    q, r = np.nonzero(d <= cut[:, None])
    number = {v: i for i, v in enumerate(sorted({v for v in ids if v is not None}))}
    rank = np.array([number.get(v, len(number)) for v in ids], dtype=np.int64)
    mine = np.array([number.get(o, -1) for o in own], dtype=np.int64)
    other = rank[r] != mine[q]
    q, r = q[other], r[other]
    exact = np.concatenate([np.sqrt(((block[q[i : i + 4096]] - rows[r[i : i + 4096]]) ** 2).sum(axis=1)) for i in range(0, len(q), 4096)]) if len(q) else np.empty(0)
    near = exact <= bound[q]
    q, r, exact = q[near], r[near], exact[near]
    order = np.lexsort((rank[r], exact, q))
    q, r, exact = q[order], r[order], exact[order]
    nth = np.arange(len(q)) - np.searchsorted(q, q)
    return q[nth < k], r[nth < k], exact[nth < k]


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query; a row that several lists hold counts once."""
    once = found.groupBy("query", "row").agg(F.first("query_id").alias("query_id"), F.first("vec_id").alias("vec_id"), F.min("score").alias("score"))
    w = Window.partitionBy("query").orderBy("score", F.asc_nulls_last("vec_id"), "row")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class PostingIndex:
    """Posting lists of all rows (row, vec_id, x) of a written table, with the centroid graph that finds them."""

    def __init__(self, rows: DataFrame, width: int, lists: int | None = None, sample_rows: int = SAMPLE_ROWS):
        """lists: about the square root of the number of rows where not given. The sample is drawn at random with a fixed seed."""
        self.rows, self.width = rows, width
        self.n = rows.count()
        if lists is None:
            lists = max(1, min(math.isqrt(self.n), self.n // LEAST_ROWS, MOST_LISTS))
        drawn = rows if self.n <= sample_rows else rows.sample(fraction=sample_rows / self.n, seed=11).limit(sample_rows)
        table = drawn.select("x").toArrow()
        sample = matrix(table.column(0).combine_chunks(), width) if table.num_rows else np.empty((0, width))
        self.graph = CentroidGraph(balanced_centroids(sample, lists))
        self.kind = rows.schema["vec_id"].dataType.simpleString()
        self.sent = rows.sparkSession.sparkContext.broadcast(self.graph)
        self.postings = written(self._placed(), "postings")
        self.counts = np.zeros(len(self.graph.centroids), np.int64)
        for list_, count in self.postings.groupBy("list").count().collect():  # one row for each list
            self.counts[list_] = count

    def _placed(self) -> DataFrame:
        """(list, row, vec_id, x): each row in the list of its nearest centroid and, near a boundary, in those next to it."""
        sent, width = self.sent, self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            graph = sent.value
            for whole in batches:
                for at in range(0, whole.num_rows, 2048):
                    batch = whole.slice(at, 2048)
                    near, dist = graph.nearest(matrix(batch.column(2), width))
                    near, dist = near[:, :COPIES], dist[:, :COPIES]
                    row, rank = np.nonzero((dist <= BOUNDARY * dist[:, :1]) | (np.arange(near.shape[1]) == 0))
                    some = batch.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([pa.array(near[row, rank].astype(np.int32)), *some.columns], names=["list", "row", "vec_id", "x"])

        return self.rows.select("row", "vec_id", "x").mapInArrow(run, f"list int, row long, vec_id {self.kind}, x array<double>")

    def ratio(self, queries: DataFrame, k: int) -> float:
        """The distance ratio at which REACH of the true neighbours of PROBES queries, found by one scan of all rows, stand in a picked list."""
        some = queries.orderBy(F.xxhash64("row")).limit(PROBES).select("row", "vec_id", "x").collect()
        if not some:
            return 1.0
        x, own, keys = np.array([r["x"] for r in some]), [r["vec_id"] for r in some], [r["row"] for r in some]
        near = _top(_scan(self.rows, x, own, keys, self.width, self.kind, k), k).select("query", "row")
        # PROBES * k rows, in COPIES lists each
        held = self.postings.select("row", "list").join(F.broadcast(near), "row").groupBy("query", "row").agg(F.collect_set("list").alias("lists")).collect()
        at = {key: i for i, key in enumerate(keys)}
        far = np.sqrt(_apart(x, self.graph.centroids))
        needed = sorted(min(far[at[r["query"]], j] for j in r["lists"]) / max(far[at[r["query"]]].min(), 1e-300) for r in held)
        return needed[min(len(needed) - 1, math.ceil(REACH * len(needed)) - 1)] * (1 + 1e-9) if needed else 1.0

    def probes(self, queries: DataFrame, ratio: float, k: int) -> DataFrame:
        """(list, nth, query, query_id, q): the lists that each query (row, vec_id, x) reads, the nth nearest."""
        sent, counts, kind, width, least = self.sent, self.counts, self.kind, self.width, COPIES * (k + 1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            graph = sent.value
            for batch in batches:
                for i, x in enumerate(matrix(batch.column(2), width)):
                    lists = graph.within(x, ratio, counts, least)
                    some = batch.take(pa.array(np.full(len(lists), i)))
                    yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), pa.array(np.arange(len(lists), dtype=np.int32)), *some.columns], names=["list", "nth", "query", "query_id", "q"])

        return queries.select("row", "vec_id", "x").mapInArrow(run, f"list int, nth int, query long, query_id {kind}, q array<double>")

    def search(self, probes: DataFrame, k: int) -> DataFrame:
        """(query, query_id, row, vec_id, score): of each list that probes (list, query, query_id, q, bound) name, a query's k nearest rows up to its bound.

        A long list is cut in parts and the queries that read it in blocks, so no task holds more than one part and one block.
        """
        width, kind = self.width, self.kind
        asked = probes.groupBy("list").agg(F.count(F.lit(1)).alias("asked"))  # one row for each list
        held = self.postings.groupBy("list").agg(F.count(F.lit(1)).alias("held")).join(asked, "list").select(
            "list", F.ceil(F.col("held") / PART_ROWS).cast("int").alias("parts"), F.ceil(F.col("asked") / BLOCK_ROWS).cast("int").alias("blocks"))
        sizes = written(held, "sizes")
        spread = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        rows = self.postings.join(F.broadcast(sizes), "list").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
        rows = rows.select("list", "part", F.explode(spread("blocks")).alias("block"), "row", "vec_id", "x")
        asks = probes.join(F.broadcast(sizes), "list").withColumn("block", F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int"))
        asks = asks.select("list", F.explode(spread("parts")).alias("part"), "block", "query", "query_id", "q", "bound")

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            left, right = left.combine_chunks(), right.combine_chunks()
            x = matrix(pa.concat_arrays(left.column("x").chunks), width) if left.num_rows else np.empty((0, width))
            ids, out = left.column("vec_id").to_pylist(), []
            for at in range(0, right.num_rows if left.num_rows else 0, 256):
                some = right.slice(at, 256)
                block = matrix(pa.concat_arrays(some.column("q").chunks), width)
                q, r, d = _best(block, x, ids, some.column("query_id").to_pylist(), some.column("bound").to_numpy(), k)
                q, r = pa.array(q), pa.array(r)
                out.append(pa.table([some.column("query").take(q), some.column("query_id").take(q), left.column("row").take(r), left.column("vec_id").take(r), pa.array(d)], names=names))
            return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in (pa.int64(), right.schema.field("query_id").type, pa.int64(), left.schema.field("vec_id").type, pa.float64())], names=names)

        names = ["query", "query_id", "row", "vec_id", "score"]
        keys = ["list", "part", "block"]
        return rows.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(meet, f"query long, query_id {kind}, row long, vec_id {kind}, score double")


def _scan(rows: DataFrame, x: np.ndarray, own: list, keys: list, width: int, kind: str, k: int) -> DataFrame:
    """(query, query_id, row, vec_id, score) of the k nearest rows that each batch has for a few queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PART_ROWS):
                batch = whole.slice(at, PART_ROWS)
                q, r, d = _best(x, matrix(batch.column(2), width), batch.column(1).to_pylist(), own, np.full(len(x), np.inf), k)
                r = pa.array(r)
                ids = pa.array(own, batch.column(1).type).take(pa.array(q))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, dtype=np.int64)[q]), ids, batch.column(0).take(r), batch.column(1).take(r), pa.array(d)], names=["query", "query_id", "row", "vec_id", "score"])

    return rows.select("row", "vec_id", "x").mapInArrow(run, f"query long, query_id {kind}, row long, vec_id {kind}, score double")


def nearest(vectors: DataFrame, asks: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", lists: int | None = None, first: int = 4) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows found for each row that `asks` (a condition on vec_id) names, nearest first.

    Score is the Euclidean distance of the vectors in double precision; ties go to the smaller id, null ids last. A query's own
    rows are those of its id. Which lists are read is decided by the ratio of their centroids' distances, set by `ratio`; the
    rows in them are compared exactly. First the `first` nearest lists are read, then the others for rows nearer than the kth best so far.
    Null, empty, zero and non-finite vectors and those of another length than most take no part; queries whose id repeats come out once for each row;
    a row is found once however many lists hold it; rows that are alike are all candidates; other columns, whatever their names, don't go
    on; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows, width = usable(vectors, vec_id, vector, zero=False)
    rows = written(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "x"), "vectors")  # row numbers stay as they are
    kind = rows.schema["vec_id"].dataType.simpleString()
    if not width:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    index = PostingIndex(rows, width, lists)
    queries = rows.where(asks)
    probes = written(index.probes(queries, index.ratio(queries, k), k), "probes")
    near = probes.where(F.col("nth") < first).withColumn("bound", F.lit(float("inf")))
    best = written(_top(index.search(near, k), k), "first")
    bounds = best.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.max("score")).alias("reached"))
    rest = probes.where(F.col("nth") >= first).join(bounds, "query", "left").withColumn("bound", F.coalesce("reached", F.lit(float("inf")))).drop("reached")
    found = best.drop("rank").unionByName(index.search(rest, k))
    return _top(found, k).select("query_id", "rank", "vec_id", "score")
