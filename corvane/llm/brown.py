"""Language-model scoring by Brown class bigrams, with classes from exchange clustering over the whole corpus.

Words are items: each of the head_items most frequent words is one (all whose counts are kept, unless fewer are asked for), and
all others fall into one of `bundles` by their last three bytes; the end of a text is an item with a class of its own. Exchange clustering gives each item a
class: in every round, tasks find for a third of the items the class that gains most in the likelihood of the class
bigrams (exactly, for a single move), and the driver, which holds one class per item and the classes' bigram counts
only, makes the moves. What is counted from the corpus is counted over all training texts.

    P(w | v) = mixture * P(class(w) | class(v)) * P(w | class(w)) + (1 - mixture) * (c(w) + 1) / (N + V + 1)

P(class | class) is smoothed by the classes' own probabilities; P(w | class) is a word's count in its class, where a
bundled word takes the add-one share of its bundle. Both terms sum to 1 over known words and one unknown word
per bundle, so the score is the log of a probability.

The most frequent words, counts_kept at most, have their counts sent to tasks (a bound on entries, whatever the corpus); the
counts of all others come by a join on the word, from all texts. Null and empty texts have just the end; repeated rows
and equal ids are scored each. A null id counts as a training row. With no training text every score is that
of the uniform model. Other columns are left out.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import slices, written


@dataclass(frozen=True)
class Settings:
    """Sizes of the model; none depends on the corpus."""

    head_items: int = 150_000
    bundles: int = 1500
    classes: int = 64
    rounds: int = 9
    least_gain: float = 1e-4
    counts_kept: int = 150_000
    mixture: float = 0.9
    class_prior: float = 5.0


def bundle(word: bytes, bundles: int) -> int:
    """The bundle of a word that is no item of its own."""
    return zlib.crc32(word[-3:]) % bundles


class _Lookup(dict):
    """Place of a word among the kept counts, or after them the place of its bundle."""

    def __init__(self, kept: list[bytes], bundles: int):
        super().__init__(zip(kept, range(len(kept)), strict=True))
        self.kept, self.bundles = len(kept), bundles

    def __missing__(self, word: bytes) -> int:
        return self.kept + zlib.crc32(word[-3:]) % self.bundles


def _split(column: pa.Array) -> list[list[bytes]]:
    """Words of each text: A-Z lowered, cut at the six blanks, which is what bytes.lower and bytes.split do."""
    return [t.lower().split() if t else [] for t in column.cast(pa.binary()).to_pylist()]


def word_counts(texts: DataFrame, bundles: int, flush: int = 400_000) -> DataFrame:
    """word, bundle, n over the single text column; counted in tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            words = list(seen)
            for at in range(0, len(words), 50_000):
                some = words[at:at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), pa.array([bundle(w, bundles) for w in some], pa.int32()), pa.array([seen[w] for w in some], pa.int64())], names=["word", "bundle", "n"])
            seen.clear()

        for batch in batches:
            for words in _split(batch.column(0)):
                seen.update(words)
                if len(seen) > flush:
                    yield from out()
        yield from out()

    return texts.mapInArrow(count, "word binary, bundle int, n long").groupBy("word", "bundle").agg(F.sum("n").alias("n"))


def _most_frequent(vocabulary: DataFrame, most: int, least: int) -> list:
    """(word, n) of words by falling count: all above the smallest count that at most `most` words have or exceed.

    Counts of counts come first, so only words that are kept leave their tasks: counts are told apart up to 1024 and then by their
    ten leading bits, so there are some thousand of them whatever the corpus. Where that keeps fewer than `least` (very many words of
    one count) the first `most` in order are taken.
    """
    spare = F.greatest(F.floor(F.log2("n")).cast("int") - 10, F.lit(0))
    rough = F.call_function("shiftleft", F.call_function("shiftright", F.col("n"), spare), spare)
    counts = vocabulary.groupBy(rough.alias("n")).agg(F.count(F.lit(1)).alias("words")).collect()
    floor, total = 1 << 62, 0
    for r in sorted(counts, key=lambda r: -r.n):
        total += r.words
        if total > most:
            break
        floor = r.n
    kept = vocabulary.where(F.col("n") >= floor).select("word", "n").collect()
    if len(kept) < least and total > len(kept):
        return vocabulary.orderBy(F.desc("n"), "word").limit(most).select("word", "n").collect()
    return sorted(kept, key=lambda r: (-r.n, bytes(r.word)))


def _sequence(docs: list[list[bytes]], lookup: _Lookup, item_of: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of all words (the end: -1), items of all tokens, and each text's first token."""
    sizes = np.array([len(d) + 1 for d in docs])
    cuts = np.cumsum(sizes)
    places = np.full(int(cuts[-1]), -1, dtype=np.int64)
    mask = np.ones(len(places), dtype=bool)
    mask[cuts - 1] = False
    places[mask] = np.fromiter((lookup[w] for d in docs for w in d), dtype=np.int64, count=int(mask.sum()))
    items = item_of[places]
    items[~mask] = end
    return places, items, cuts - sizes


def bigram_counts(texts: DataFrame, kept, settings: Settings, end: int) -> DataFrame:
    """code, n: first * (end + 1) + second over items, counted in tasks first."""
    span = end + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup(kept.value, settings.bundles)
        item_of = _items(len(kept.value), kept.value, settings)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            codes, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            return codes, np.bincount(at, weights=np.concatenate([n for _, n in held])).astype(np.int64)

        def rows(codes: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(codes), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(codes[at:at + 100_000]), pa.array(n[at:at + 100_000])], names=["code", "n"])

        for batch in batches:
            for some in slices(batch, 0, 2000, 4 << 20):
                docs = _split(some.column(0))
                _, items, starts = _sequence(docs, lookup, item_of, end)
                before = np.concatenate(([end], items[:-1]))
                held.append(np.unique(before.astype(np.int64) * span + items, return_counts=True))
                size += len(held[-1][0])
                if size > 3_000_000:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > 1_500_000:
                        yield from rows(*held[0])
                        held, size = [], 0
        if held:
            yield from rows(*merged())

    return texts.mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _items(n_kept: int, kept: list[bytes], settings: Settings) -> np.ndarray:
    """Item of each place: the head's words are items 0.., then come the bundles."""
    head = min(settings.head_items, n_kept)
    rest = np.fromiter((bundle(w, settings.bundles) for w in kept[head:]), dtype=np.int64, count=n_kept - head)
    return np.concatenate((np.arange(head), settings.head_items + rest, settings.head_items + np.arange(settings.bundles)))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def objective(g: np.ndarray) -> float:
    """The part of the log-likelihood of the class bigrams g that classes decide."""
    return float(_xlogx(g).sum() - _xlogx(g.sum(1)).sum() - _xlogx(g.sum(0)).sum())


def best_move(g: np.ndarray, own: int, right: np.ndarray, left: np.ndarray, self_n: float) -> tuple[int, float]:
    """Best class of an item now in `own`, and the exact gain in `objective` of that move.

    right and left: the item's counts with the class after and before it (its own pairs included); self_n: those
    with itself.
    """
    base = g.astype(float)  # a copy
    base[own] -= right
    base[:, own] -= left
    base[own, own] += self_n
    r, s = right.astype(float), left.astype(float)
    r[own] -= self_n
    s[own] -= self_n
    rows, cols = base.sum(1) + s, base.sum(0) + r  # with what the item adds to them whatever its class
    diagonal = base.diagonal()
    # only classes that the item stands beside change a term
    after, before = base[:, r > 0], base[s > 0]
    gain = (_xlogx(after + r[r > 0]) - _xlogx(after)).sum(1) + (_xlogx(before + s[s > 0, None]) - _xlogx(before)).sum(0)
    gain += -(_xlogx(diagonal + r) - _xlogx(diagonal)) - (_xlogx(diagonal + s) - _xlogx(diagonal)) + _xlogx(diagonal + r + s + self_n) - _xlogx(diagonal)
    n_right, n_left = r.sum() + self_n, s.sum() + self_n
    gain -= _xlogx(rows + n_right) - _xlogx(rows) + _xlogx(cols + n_left) - _xlogx(cols)
    to = int(np.argmax(gain))
    return to, float(gain[to] - gain[own])


def exchange(bigrams: DataFrame, counts: np.ndarray, settings: Settings, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of each item and the class bigram counts. bigrams: code, n over all item pairs that occur.

    A profile's entries are numbers: the other item, whether it comes before, and the count in the lowest 43 bits.
    """
    k, span = settings.classes + 1, end + 1
    sides = bigrams.select(F.expr(f"code div {span}").alias("first"), F.expr(f"code % {span}").alias("second"), "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    own, other = F.when(F.col("side") == 0, F.col("first")).otherwise(F.col("second")), F.when(F.col("side") == 0, F.col("second")).otherwise(F.col("first"))
    entry = F.shiftleft(other * 2 + F.col("side"), 43).bitwiseOR(F.col("n"))
    # at most one entry for each item and side, however large the corpus
    profiles = written(sides.select(own.cast("int").alias("item"), entry.alias("x")).groupBy("item").agg(F.collect_list("x").alias("x")), "profiles")

    order = np.argsort(-counts[:end], kind="stable")
    classes = np.zeros(end + 1, dtype=np.int64)
    classes[order] = np.arange(end) % settings.classes
    classes[end] = settings.classes

    def beside(batch: pa.RecordBatch, now: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where each item's entries start, and their other item, its class (k higher on the side before) and count."""
        cut, x = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy()[batch.column(1).offsets[0].as_py():]
        others = x >> 44
        return cut - cut[0], others, now[others] + k * ((x >> 43) & 1), x & ((1 << 43) - 1)

    def class_bigrams(now: np.ndarray) -> np.ndarray:
        now = now.astype(np.int16)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g = np.zeros(2 * k * k)
            for batch in batches:
                cut, _, near, n = beside(batch, now)
                own = np.repeat(now[batch.column(0).to_numpy()].astype(np.int64), np.diff(cut))
                g += np.bincount(own * (2 * k) + near[:cut[-1]], weights=n[:cut[-1]], minlength=2 * k * k)
            yield pa.RecordBatch.from_pydict({"g": pa.array([g.reshape(k, 2 * k)[:, :k].astype(np.int64).tobytes()], pa.binary())})

        found = profiles.mapInArrow(add, "g binary").collect()
        return sum((np.frombuffer(r.g, dtype=np.int64).reshape(k, k) for r in found), np.zeros((k, k), dtype=np.int64))

    def moves(now: np.ndarray, g: np.ndarray, turn: int) -> list[tuple[int, int]]:
        now = now.astype(np.int16)

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            inner = g.astype(float)
            for batch in batches:
                cut, others, near, n = beside(batch, now)
                out = []
                for i, item in enumerate(batch.column(0).to_pylist()):
                    part = slice(cut[i], cut[i + 1])
                    counts_near = np.bincount(near[part], weights=n[part], minlength=2 * k)
                    self_n = float(n[part][(others[part] == item) & (near[part] < k)].sum())
                    to, gain = best_move(inner, int(now[item]), counts_near[:k], counts_near[k:], self_n)
                    if gain > 1e-6 and to != settings.classes:
                        out.append((item, to))
                if out:
                    yield pa.RecordBatch.from_pydict({"item": pa.array([x for x, _ in out], pa.int32()), "to": pa.array([x for _, x in out], pa.int32())})

        return [(r.item, r.to) for r in profiles.where((F.col("item") != end) & (F.pmod("item", F.lit(3)) == turn % 3)).mapInArrow(look, "item int, to int").collect()]

    g = class_bigrams(classes)
    best, last = (objective(g), classes, g), None
    for turn in range(settings.rounds):
        if turn % 3 == 0:  # all items have been looked at since
            if last is not None and best[0] - last <= settings.least_gain * abs(last):
                break
            last = best[0]
        todo = moves(classes, g, turn)
        classes = classes.copy()
        for item, to in todo:
            classes[item] = to
        g = class_bigrams(classes)
        if objective(g) >= best[0]:
            best = (objective(g), classes, g)
    return best[1], best[2]


def score(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score and score of every document; learns from rows where train."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(train, F.lit(True)).alias("train"))
    texts = rows.where("train").select("text")
    vocabulary = written(word_counts(texts, settings.bundles), "vocabulary")
    ends = texts.count()
    per_bundle = vocabulary.groupBy("bundle").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    total = sum(r.n for r in per_bundle) + ends
    distinct = sum(r.v for r in per_bundle) + (ends > 0)
    top = _most_frequent(vocabulary, settings.counts_kept, min(settings.head_items, settings.counts_kept // 25))
    kept = [bytes(r.word) for r in top]
    kept_n = np.array([r.n for r in top], dtype=float)
    head, end = min(settings.head_items, len(kept)), settings.head_items + settings.bundles
    in_bundle, kinds = np.zeros(settings.bundles), np.zeros(settings.bundles)
    for r in per_bundle:
        in_bundle[r.bundle], kinds[r.bundle] = r.n, r.v
    for w, n in zip(kept[:head], kept_n, strict=False):
        in_bundle[bundle(w, settings.bundles)] -= n
        kinds[bundle(w, settings.bundles)] -= 1
    counts = np.zeros(end + 1)
    counts[:head], counts[settings.head_items:end], counts[end] = kept_n[:head], in_bundle, ends
    kept_words = spark.sparkContext.broadcast(kept)

    classes, g = exchange(bigram_counts(texts, kept_words, settings, end), counts, settings, end)
    size = np.bincount(classes, weights=counts, minlength=settings.classes + 1)
    share = (size + 1) / (size.sum() + len(size))
    moves = (g + settings.class_prior * share) / (g.sum(1, keepdims=True) + settings.class_prior)
    item_of = _items(len(kept), kept, settings)
    of_class = (counts + 1) / np.bincount(classes, weights=counts + 1, minlength=settings.classes + 1)[classes]
    unit = 1 / (total + distinct + 1)
    alone = 1 / (in_bundle + kinds + 1)
    # for kept words the probability inside the class and the add-one share; for the others both over c + 1
    inside = of_class[item_of]
    inside[head:] *= alone[item_of[head:] - settings.head_items]
    inside[head:len(kept)] *= kept_n[head:] + 1
    flat = np.full(len(item_of), unit)
    flat[:len(kept)] *= kept_n + 1
    log_kept = np.concatenate((np.log10(kept_n + 1), np.zeros(settings.bundles)))
    tables = spark.sparkContext.broadcast((moves, classes, item_of, np.append(inside, of_class[end]), np.append(flat, unit * (ends + 1)), np.append(log_kept, math.log10(ends + 1))))
    mixture, unit_log, has_end = settings.mixture, math.log10(unit), int(ends > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, class_of, items_at, p_inside, p_flat, log_n = tables.value
        lookup, n_kept = _Lookup(kept_words.value, settings.bundles), len(kept_words.value)
        row = TaskContext.get().partitionId() << 36
        for whole in batches:
            for batch in slices(whole, 1, 1000, 4 << 20):
                docs_words = _split(batch.column(1))
                places, items, starts = _sequence(docs_words, lookup, items_at, end)
                c = class_of[items]
                before = np.concatenate(([settings.classes], c[:-1]))
                p = mixture * steps[before, c] * p_inside[places] + (1 - mixture) * p_flat[places]
                sums = lambda x: np.add.reduceat(x, starts)
                sizes = np.diff(np.append(starts, len(places)))
                known = sums(((places >= 0) & (places < n_kept)).astype(np.int64)) + has_end
                rest = [Counter(w for w in d if w not in lookup) for d in docs_words]
                yield pa.RecordBatch.from_arrays([
                    pa.array(range(row, row + batch.num_rows), pa.int64()), batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(known),
                    pa.array(sums(log_n[places]) + sizes * unit_log), pa.array(sums(np.log10(p))),
                    pa.array([list(r) for r in rest], pa.list_(pa.binary())), pa.array([list(r.values()) for r in rest], pa.list_(pa.int64()))],
                    names=["row", "doc_id", "train", "n_tokens", "n_known", "base_score", "score", "rare", "rare_n"])
                row += batch.num_rows

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = written(rows.select("doc_id", "text", "train").mapInArrow(run, f"row long, doc_id {kind}, train boolean, n_tokens long, n_known long, base_score double, score double, rare array<binary>, rare_n array<long>"), "scored")
    pairs = scored.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.rare_n").alias("m"))
    rare = vocabulary.join(pairs, "word").groupBy("row").agg(F.sum(F.col("m") * F.log10(F.col("n") + 1)).alias("more"), F.sum("m").alias("found"))
    out = scored.drop("rare", "rare_n").join(rare, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select("doc_id", "train", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score"))
