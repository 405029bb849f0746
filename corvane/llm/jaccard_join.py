"""N-gram Jaccard join by T-occurrence search over inverted lists, with DivideSkip.

Documents with equal shingle sets are one class. A class with n shingles must share T = ceil(t * n) of them with a
partner, so of its p + l - 1 smallest hashes, where p = n - T + 1, at least l are shared (both sides order by hash).
That makes a T-occurrence problem: lists of these signature hashes, and pairs that occur on l of them.

Shingles are ordered by how common they are, then by hash, so signatures hold the rare ones and passages that many
documents share make few candidates. How common a shingle is comes from a sample of the texts (`one_in`); it decides
the order alone. Any order that all classes share gives the same links.

- Lists with one member are dropped. A list is short up to `long_list` members, long beyond.
- Short lists are merged: their pairs of fitting sizes are counted. A class with L long lists needs l - L of the
  short ones at least, so long lists are never expanded; pairs that reach that, if both have long lists, are probed by
  binary search over the whole signatures for l occurrences.
- Classes with so many long lists that short ones prove nothing meet by long list. As a link shares l lists, the
  l - 1 longest of a class need not meet: the shortest list that two classes share is never among them.
- What candidates connect is an area. The classes of an area that fits a tile (`tile` classes and `tile_shingles`
  shingles) meet there with their whole sets, which moves each set once. Inside a tile the same search runs class by class: the
  longest lists are skipped, the others merged, the skipped ones probed; a pair already connected isn't checked again.
- Areas beyond a tile take two steps. First each class is checked against its best candidate, and meets others on
  `picks` of its long lists in one tile of each: linear work that connects most of a group. Then all candidate pairs and
  lists whose classes are not connected by then follow in full, lists in tiles by pairs of chunks, so no link is lost.

Hashes have 64 bits, set digests 128. The result has one row per row of docs. Null, empty and blank texts have no
shingles and link with nothing; texts shorter than a shingle are one shingle, unlike any full one. Repeated rows are in
one class; rows with a null id count in links but never name a component unless all its ids are null. Columns beyond id
and text are left out. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import MaybeAmong, Scratch, components, free_name, slices, written

#: Shingles are told apart as common or not by their first 24 bits.
_SLOT = np.uint64(40)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


class _Hashes(dict):
    """64-bit hash of a word, kept for up to `most` words."""

    most = 200_000

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.most:
            self[word] = h
        return h


_KNOWN = _Hashes()


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text (A-Z lowered, words cut at the six blanks)."""
    words = [t.lower().split() if t else [] for t in texts]
    sizes = [len(w) for w in words]
    h = np.fromiter((_KNOWN[x] for w in words for x in w), dtype=np.uint64, count=sum(sizes))
    n = max(len(h) - width + 1, 0)
    s = np.full(n, 1, dtype=np.uint64)
    for k in range(width):
        s = _scramble(s * _MIX[0] + h[k:k + n])
    out, at = [], 0
    for size in sizes:
        if size >= width:
            out.append(np.unique(s[at:at + size - width + 1]))
        elif size:
            x = np.full(1, 1000 + size, dtype=np.uint64)
            for k in range(size):
                x = _scramble(x * _MIX[0] + h[at + k:at + k + 1])
            out.append(x)
        else:
            out.append(np.empty(0, dtype=np.uint64))
        at += size
    return out


def _need(n, num: int, den: int):
    """Shingles of n that a partner must share at least."""
    return -((-num * n) // den)


def _prefix(n, num: int, den: int):
    return n - _need(n, num, den) + 1


def _least(n, num: int, den: int):
    """Occurrences on the signature's lists that a partner must have at least."""
    return 1 + _prefix(n, num, den) // 4


def _digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _common_slots(width: int):
    """(slot, n, low, high) of the sampled texts: how many have a shingle of the slot, least and greatest of their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, 0):
                sets = shingle_sets(part.column(0).cast(pa.binary()).to_pylist(), width)
                slots = np.concatenate([np.unique(s >> _SLOT) for s in sets]).astype(np.int64)
                marks = np.repeat([int.from_bytes(_digest(s)[:7], "little") for s in sets], [len(np.unique(s >> _SLOT)) for s in sets]).astype(np.int64)
                order = np.lexsort((marks, slots))
                slots, marks = slots[order], marks[order]
                first = np.flatnonzero(np.append(True, slots[1:] != slots[:-1])) if len(slots) else np.empty(0, dtype=np.int64)
                ends = np.append(first[1:], len(slots))
                yield pa.RecordBatch.from_arrays([pa.array(slots[first]), pa.array(ends - first), pa.array(marks[first]), pa.array(marks[ends - 1] if len(first) else first)], names=["slot", "n", "low", "high"])

    return run


def common_levels(rows: DataFrame, width: int, one_in: int, most: int = 4_000_000) -> np.ndarray:
    """How common the shingles of each slot of hashes are, in powers of two, 0 for all but the `most` commonest.

    A texts' sample, one in `one_in` by hash, is counted in Spark; what comes here has a fixed size however large the corpus is.
    """
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0).select("text")
    found = sample.mapInArrow(_common_slots(width), "slot long, n long, low long, high long").groupBy("slot").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    found = written(found.where("n > 1 AND low < high").select(F.col("slot").cast("int"), F.least(F.floor(F.log2("n")), F.lit(60)).cast("byte").alias("level")), "common")
    counts = {r.level: r.n for r in found.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}
    floor, total = 61, 0
    while floor > 1 and total + counts.get(floor - 1, 0) <= most:
        floor -= 1
        total += counts.get(floor, 0)
    kept = found.where(F.col("level") >= floor).toArrow()
    levels = np.zeros(1 << (64 - int(_SLOT)), dtype=np.uint8)
    levels[kept.column("slot").to_numpy()] = kept.column("level").to_numpy()
    return levels


def _signatures(width: int, num: int, den: int, levels):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, level_of = TaskContext.get().partitionId() << 36, levels.value
        for whole in batches:
            for batch in slices(whole, 1):
                sets = shingle_sets(batch.column(1).cast(pa.binary()).to_pylist(), width)
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                common = level_of[np.concatenate(sets) >> _SLOT]
                signs, at = ([], []), 0
                for s, n in zip(sets, sizes.tolist(), strict=True):
                    take = _prefix(n, num, den) + _least(n, num, den) - 1 if n else 0
                    mine = common[at:at + n]
                    if mine.any():
                        rare, other = s[mine == 0][:take], mine > 0
                        shared = s[other][np.argsort(mine[other], kind="stable")[:take - len(rare)]]
                    else:
                        rare, shared = s[:take], s[:0]
                    signs[0].append(rare.view(np.int64))
                    signs[1].append(shared.view(np.int64))
                    at += n
                lists = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in side])).astype(np.int32)), pa.array(np.concatenate(side))) for side in signs]
                yield pa.RecordBatch.from_arrays([
                    pa.array(range(row, row + len(sets)), pa.int64()), batch.column(0), pa.array(sizes),
                    pa.array([_digest(s) for s in sets], pa.binary()), *lists],
                    names=["row", "doc_id", "n", "digest", "rare", "common"])
                row += len(sets)

    return run


def _full_sets(width: int, sent):
    """Digests and sets of the texts (slot, text) whose slot is marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.filter(pa.array(MaybeAmong.look(sent, batch.column(0).to_numpy()))).select([1])
            for part in slices(whole, 0):
                sets = shingle_sets(part.column(0).cast(pa.binary()).to_pylist(), width)
                yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["digest", "shingles"])

    return run


def _list_pairs(num: int, den: int):
    """Pairs (a, b, n_a, n_b) of each short list whose sizes allow a link; rows are lists of (n, node) by size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            cuts, flat = lists.offsets.to_numpy(), lists.values
            n, node = flat.field("n").to_numpy(), flat.field("node").to_numpy()
            # partners further up in the same list whose size is at most the largest that can link
            own_end = np.repeat(cuts[1:], np.diff(cuts)) - cuts[0]
            n, node = n[cuts[0]:cuts[-1]], node[cuts[0]:cuts[-1]]
            at = np.arange(len(n))
            counts = own_end - at - 1
            for low in range(0, len(n), 20_000):
                some, c = at[low:low + 20_000], counts[low:low + 20_000]
                x = np.repeat(some, c)
                y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(c) - c, c)
                fit = n[y] * num <= n[x] * den
                x, y = x[fit], y[fit]
                swap = node[x] > node[y]
                a, b = np.where(swap, y, x), np.where(swap, x, y)
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b]), pa.array(n[a]), pa.array(n[b])], names=["a", "b", "n_a", "n_b"])

    return run


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets, by binary search of the shorter in the longer."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def _probe(num: int, den: int):
    """Pairs that occur together on enough lists, with their times; columns are nodes, sizes and signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb = (batch.column(k).to_numpy() for k in range(4))
            sides = []
            for k in (4, 5):
                lists = batch.column(k)
                sides.append((lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)))
            (ca, va), (cb, vb) = sides
            least = np.minimum(_least(na, num, den), _least(nb, num, den))
            keep = [i for i in range(len(a)) if _shared(np.sort(va[ca[i]:ca[i + 1]]), np.sort(vb[cb[i]:cb[i + 1]])) >= least[i]]
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), batch.column(6).take(pa.array(keep, pa.int64()))], names=["a", "b", "times"])

    return run


def _linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    both = _shared(x, y)
    return both * den >= num * (len(x) + len(y) - both)


def _sets(column: pa.Array) -> list[np.ndarray]:
    """The sets of a binary column, in place."""
    column = column.cast(pa.binary())
    cut = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    return [data[a:b].view(np.uint64) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _check(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x, y = _sets(batch.column(2)), _sets(batch.column(3))
            keep = [i for i in range(len(a)) if _linked(x[i], y[i], num, den)]
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return run


def _entries(owners: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """owners[a:b] of all (a, b) in a row."""
    sizes = ends - starts
    return owners[np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)]


def tile_links(nodes: np.ndarray, sets: list[np.ndarray], num: int, den: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs that connect a tile's classes as all their links would: DivideSkip for each class among those before it.

    The lists are those of all shingles. Of a class's lists the longest T - 1 are skipped and the others merged, which
    gives every partner at least once; partners in the class's own component go, and the skipped lists are probed
    for the others by binary search, or merged too where that is less work. What results is the exact overlap.
    Classes of equal `known` are connected from the start. The links found are given as stars, (smallest class, other
    class) of each group, as chains of a tile's length would cost components() rounds.
    """
    order = np.argsort(nodes, kind="stable")
    nodes, sets = nodes[order], [sets[i] for i in order]
    sizes = np.array([len(s) for s in sets])
    hashes = np.concatenate(sets)
    owners = np.repeat(np.arange(len(sets)), sizes)
    by_hash = np.argsort(hashes, kind="stable")
    hashes, owners = hashes[by_hash], owners[by_hash]
    root = np.arange(len(nodes)) if known is None else np.unique(known[order], return_inverse=True)[1]
    mine = np.arange(len(nodes))

    def link(i: int, j: int) -> None:
        mine[mine == max(mine[i], mine[j])] = min(mine[i], mine[j])
        root[root == root[i]] = root[j]

    for i in range(1, len(sets)):
        if root[i] != root[i - 1] and _linked(sets[i], sets[i - 1], num, den):
            link(i, i - 1)
        if (root[:i] == root[i]).all():
            continue
        starts, ends = np.searchsorted(hashes, sets[i], "left"), np.searchsorted(hashes, sets[i], "right")
        lengths = np.argsort(ends - starts, kind="stable")
        skip = min(_need(int(sizes[i]), num, den) - 1, len(lengths) - 1)
        short, long = lengths[:len(lengths) - skip], lengths[len(lengths) - skip:]
        times = np.bincount(_entries(owners, starts[short], ends[short]), minlength=len(sets))[:i]
        found = np.flatnonzero(times)
        found = found[(root[found] != root[i]) & (sizes[found] * den >= num * sizes[i]) & (sizes[i] * den >= num * sizes[found])]
        if not len(found):
            continue
        if len(found) <= 8:
            both = times[found] + [_shared(sets[i][np.sort(long)], sets[j]) for j in found]
        else:
            both = (times + np.bincount(_entries(owners, starts[long], ends[long]), minlength=len(sets))[:i])[found]
        for j in found[both * den >= num * (sizes[found] + sizes[i] - both)].tolist():
            if root[j] != root[i]:
                link(i, j)
    return [(int(nodes[mine[i]]), int(nodes[i])) for i in np.flatnonzero(mine != np.arange(len(nodes)))]


def _tiles(num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        sets = [s for chunk in table.column("shingles").chunks for s in _sets(chunk)]
        found = tile_links(table.column("node").to_numpy(), sets, num, den, table.column("known").to_numpy())
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return run


def joined_components(reached: DataFrame, more: DataFrame) -> DataFrame:
    """(node, component) after further links: only the components that these connect are labelled anew."""
    old = reached.select(F.col("node").alias("o_node"), F.col("component").alias("o_component"))
    ends = more
    for side in ("a", "b"):
        ends = ends.join(old, F.col(side) == F.col("o_node"), "left").withColumn(side, F.coalesce("o_component", side)).drop("o_node", "o_component")
    anew = written(components(ends).select(F.col("node").alias("o_node"), F.col("component").alias("o_component")), "joined")
    changed = reached.join(anew, F.col("component") == F.col("o_node"), "left").select("node", F.coalesce("o_component", "component").alias("component"))
    single = anew.join(reached, F.col("o_node") == F.col("node"), "left_anti").select(F.col("o_node").alias("node"), F.col("o_component").alias("component"))
    return changed.union(single)


def _candidates(classes: DataFrame, num: int, den: int, long_list: int, picks: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b, times) and the places of classes on long lists (h, node, n, picked, kept) that together cover all links."""
    # lists of shingles that the sample has once at most are short: one shuffle brings them together. Others can be of any length, and
    # are counted before they meet their counts in a join that Spark can split.
    rare, common = (classes.select("node", "n", F.explode(c).alias("h")) for c in ("rare", "common"))
    sizes = scratch.write(common.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "lists")
    rare = rare.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("h"))).where("df > 1").select("h", "node", "n", "df")
    shared = scratch.write(rare.union(common.join(sizes, "h").select("h", "node", "n", "df")), "postings")
    scratch.drop("lists")
    long = shared.where(F.col("df") > long_list)
    long_counts = scratch.write(long.groupBy("node").agg(F.count(F.lit(1)).alias("longs")), "long_counts")

    def prefix(n: Column) -> Column:
        return n - F.ceil(n * num / F.lit(den)) + 1

    def least(n: Column) -> Column:
        return (1 + F.floor(prefix(n) / 4)).cast("long")

    lists = shared.where(F.col("df") <= long_list).groupBy("h").agg(F.sort_array(F.collect_list(F.struct("n", "node"))).alias("x")).select("x")
    pairs = lists.mapInArrow(_list_pairs(num, den), "a long, b long, n_a long, n_b long").groupBy("a", "b").agg(F.count(F.lit(1)).alias("times"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    side = lambda s: long_counts.select(F.col("node").alias(f"node_{s}"), F.col("longs").alias(f"longs_{s}"))
    merged = pairs.join(side("a"), F.col("a") == F.col("node_a"), "left").join(side("b"), F.col("b") == F.col("node_b"), "left")
    longs = F.least(F.coalesce("longs_a", F.lit(0)), F.coalesce("longs_b", F.lit(0)))
    merged = merged.where(F.col("times") >= F.least(least(F.col("n_a")), least(F.col("n_b"))) - longs)
    merged = scratch.write(merged.select("a", "b", "times", "n_a", "n_b", longs.alias("longs")), "merged")
    # where one side has no long list, the count on short ones is exact and no signature needs to travel
    sign = lambda s: classes.select(F.col("node").alias(f"node_{s}"), F.concat("rare", "common").alias(f"sign_{s}"))
    unsure = merged.where("longs > 0").join(sign("a"), F.col("a") == F.col("node_a")).join(sign("b"), F.col("b") == F.col("node_b"))
    probed = unsure.select("a", "b", "n_a", "n_b", "sign_a", "sign_b", "times").mapInArrow(_probe(num, den), "a long, b long, times long")
    probed = scratch.write(merged.where("longs = 0").select("a", "b", "times").union(probed), "probed")
    scratch.drop("merged")

    low = F.least(least(F.col("n")), least(F.ceil(F.col("n") * num / F.lit(den))))
    dense = long.join(long_counts, "node").withColumn("low", low).where("longs >= low")
    shortest, smallest_hash = Window.partitionBy("node").orderBy("df", "h"), Window.partitionBy("node").orderBy("h")
    dense = dense.withColumn("picked", F.row_number().over(smallest_hash) <= picks).withColumn("kept", F.row_number().over(shortest) <= F.col("longs") - F.col("low") + 1)
    dense = scratch.write(dense.where("picked OR kept").select("h", "node", "n", "picked", "kept"), "dense")
    scratch.drop("postings", "long_counts")
    return probed, dense


def jaccard_groups(docs: DataFrame, width: int, num: int, den: int, doc_id: str = "doc_id", text: str = "text", long_list: int = 32, tile: int = 1000, tile_shingles: int = 500_000, picks: int = 4, one_in: int = 32) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest id reachable by links) of each row; links have Jaccard >= num / den."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    levels = spark.sparkContext.broadcast(common_levels(rows, width, one_in))
    signed = scratch.write(rows.mapInArrow(_signatures(width, num, den, levels), f"row long, doc_id {kind}, n long, digest binary, rare array<long>, common array<long>"), "signatures")
    classes = scratch.write(signed.where("n > 0").groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("rare").alias("rare"), F.first("common").alias("common")), "classes")
    probed, dense = _candidates(classes, num, den, long_list, picks, scratch)

    hubs = dense.where("kept").groupBy("h").agg(F.min("node").alias("b"))
    spread = dense.where("kept").join(hubs, "h").select(F.col("node").alias("a"), "b")
    areas = scratch.write(components(probed.select("a", "b").union(spread)), "areas")
    wanted = scratch.write(areas.join(classes.select("node", "first_id", "digest", "n"), "node").withColumnRenamed("component", "area"), "wanted")
    # most texts are in no area: these are left out where they are read, so that they travel nowhere
    among = MaybeAmong(wanted, "first_id")
    sets = rows.select(among.slot(F.col("doc_id")).alias("slot"), "text").mapInArrow(_full_sets(width, among.sent), "digest binary, shingles binary").join(wanted.select("digest", "node"), "digest")
    sets = scratch.write(sets.dropDuplicates(["node"]).select("node", "shingles"), "sets")
    fits = wanted.groupBy("area").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("total"))
    fits = scratch.write(fits.select("area", ((F.col("members") <= tile) & (F.col("total") <= tile_shingles)).alias("fits")), "fits")
    placed = scratch.write(wanted.join(fits, "area").select("node", "area", "fits"), "placed")

    def meet(tiles: DataFrame, *by: str) -> DataFrame:
        return tiles.join(sets, "node").groupBy(*by).applyInArrow(_tiles(num, den), "a long, b long")

    near = scratch.write(meet(placed.where("fits").select("area", "node", F.col("node").alias("known")), "area"), "near_links")
    reached = scratch.write(near.select(F.col("b").alias("node"), F.col("a").alias("component")).union(near.select("a", "a")).distinct(), "near")
    far = placed.where("NOT fits").select("node")
    if not far.isEmpty():
        reached = reached.unionByName(_far_components(probed.join(far.withColumnRenamed("node", "a"), "a"), dense.join(far, "node"), sets, meet, num, den, tile, tile_shingles, scratch))

    named = scratch.write(classes.select("digest", "node", "first_id").join(reached, "node", "left").withColumn("component", F.coalesce("component", "node")), "named")
    ids = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.join(ids, "component").select("digest", "component_id")
    out = signed.select("doc_id", "n", "digest").join(named, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    out = scratch.write(out, "groups")
    scratch.drop("signatures", "classes", "probed", "dense", "areas", "wanted", "sets", "fits", "placed", "near_links", "near", "far", "far_more", "named")
    return out


def _far_components(probed: DataFrame, dense: DataFrame, sets: DataFrame, meet, num: int, den: int, tile: int, tile_shingles: int, scratch: Scratch) -> DataFrame:
    """(node, component) of the classes in areas beyond a tile, in two steps: most links of a group by linear work, then all between what is left."""
    set_of = lambda s: sets.select(F.col("node").alias(f"node_{s}"), F.col("shingles").alias(f"set_{s}"))

    def checked(pairs: DataFrame) -> DataFrame:
        both = pairs.join(set_of("a"), F.col("a") == F.col("node_a")).join(set_of("b"), F.col("b") == F.col("node_b"))
        return both.select("a", "b", "set_a", "set_b").mapInArrow(_check(num, den), "a long, b long")

    def chunked(some: DataFrame) -> DataFrame:
        counts = some.groupBy("h").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("total")).where("members > 1")
        counts = counts.select("h", F.greatest(F.ceil(F.col("members") / tile), F.ceil(F.col("total") / tile_shingles)).cast("int").alias("chunks"))
        return some.join(counts, "h").withColumn("chunk", F.pmod(F.xxhash64("node", "h"), F.col("chunks")).cast("int"))

    ends = probed.select("a", "b", "times").union(probed.select("b", "a", "times")).toDF("node", "other", "times")
    best = ends.groupBy("node").agg(F.max(F.struct("times", "other")).alias("x")).select(F.least("node", "x.other").alias("a"), F.greatest("node", "x.other").alias("b")).distinct()
    first = chunked(dense.where("picked")).select("h", "chunk", "node", F.col("node").alias("known"))
    links = scratch.write(checked(best).union(meet(first, "h", "chunk")), "far_first")
    reached = scratch.write(components(links), "far")
    scratch.drop("far_first")

    known = lambda s: reached.select(F.col("node").alias(f"k_{s}"), F.col("component").alias(f"component_{s}"))
    rest = probed.join(known("a"), F.col("a") == F.col("k_a"), "left").join(known("b"), F.col("b") == F.col("k_b"), "left")
    rest = rest.where(F.coalesce("component_a", "a") != F.coalesce("component_b", "b")).select("a", "b")
    blocks = chunked(dense.where("kept")).join(reached, "node", "left").withColumn("known", F.coalesce("component", "node"))
    blocks = scratch.write(blocks.select("h", "node", "known", "chunk", "chunks"), "blocks")
    unconnected = blocks.groupBy("h").agg(F.min("known").alias("low"), F.max("known").alias("high")).where("low < high").select("h")
    others = blocks.join(unconnected, "h").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    others = others.select("h", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "node", "known")
    more = scratch.write(checked(rest).union(meet(others, "h", "i", "j")), "far_more")
    scratch.drop("blocks")
    return reached if more.isEmpty() else joined_components(reached, more)


def first_of_groups(docs: DataFrame, width: int, num: int, den: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group of linked rows, texts without shingles all kept.

    Rows are told apart by 128 bits of hashes of all their columns (of types that hash: no maps), not by id, so repeated or null ids
    leave one row each group. It is the row with the smallest id, null ids last; rows that tie are chosen among by that hash. Of rows
    alike in all columns one stays, unless they have no shingles.
    """
    mark = free_name(docs, "row_mark")
    keyed = docs.withColumn(mark, F.concat(F.hex(F.xxhash64(*docs.columns)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), *docs.columns))))
    groups = jaccard_groups(keyed, width, num, den, doc_id=mark, text=text)
    ids = keyed.select(F.col(mark).alias("row_of"), F.col(doc_id).alias("id")).distinct()
    ranked = written(groups.where("n_shingles > 0").select(F.col("doc_id").alias("row_of"), F.col("component_id").alias("group")).groupBy("row_of", "group").agg(F.count(F.lit(1)).alias("copies")).join(ids, "row_of"), "ranked")
    first = ranked.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row_of")).alias("first")).select(F.col("first.row_of").alias("first_of"))
    judged = ranked.join(first, F.col("row_of") == F.col("first_of"), "left")
    # few rows are neither: a group's others, and firsts that are there more than once
    marked = written(judged.where("first_of IS NULL OR copies > 1").select("row_of", F.col("first_of").isNotNull().alias("repeated")), "others")
    # and only rows that may be among them travel
    told = free_name(keyed, "row_told")
    split = keyed.withColumn(told, MaybeAmong(marked, "row_of").holds(F.col(mark)))
    met = split.where(F.col(told)).drop(told)
    alone = met.join(marked, F.col(mark) == F.col("row_of"), "left_anti")
    repeated = met.join(marked.where("repeated"), F.col(mark) == F.col("row_of"), "left_semi").dropDuplicates([mark])
    return split.where(~F.col(told)).drop(told).unionByName(alone).unionByName(repeated).drop(mark)
