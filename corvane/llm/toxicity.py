"""Toxicity by weak supervision: a generative label model over lexicon and pattern voters, then a linear classifier.

Voters are mined over all labelled training rows: words, word beginnings, phrases of two words and fixed patterns whose share of toxic
rows is far from chance, more or less; at most `voters` of them, the surest. A voter fires on a text that holds its feature and else
abstains; one that is rarer in toxic rows votes clean. The label model has the share of toxic labels, for each voter the rates at
which it fires on toxic and on clean texts, and for each pair of voters their correlation in either class. EM fits the rates and correlations over the
votes of all training documents; votes are grouped by pattern, and every step sums over patterns in tasks. A voter counts in a
posterior by what its correlations leave of it, in every round. Where a label is known it is one more, strong voter.

A logistic regression over the mined features is fitted to posteriors: of at most sample_rows labelled rows and as many
without labels, taken by the hash of their ids. It then scores every text whole.

Labels are only read where `train` holds; ids, languages and sources are no inputs. Null and empty texts get the score of a
text without any feature. Labels that are null are ignored; a row with several labels counts as toxic if any says
so. Without toxic or clean labels every score is the share of toxic labels, or 0 without any. Repeated rows and
equal ids are scored each. Other columns are left out. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import slices, written

#: Patterns that are features of a text wherever they match.
PATTERNS = {"re:marks": re.compile(r"[!?]{2,}"), "re:capitals": re.compile(r"\b[A-Z]{4,}\s+[A-Z]{4,}\b"), "re:masked": re.compile(r"\b[A-Za-z][*@#$]{1,4}[A-Za-z]{1,6}\b"), "re:stretched": re.compile(r"([A-Za-z])\1{3,}")}
_SLOTS = 1 << 23
EDGES = ".,;:!?\"'()[]{}<>*#$%&|-_~`/\\…«»“”‘’"


@dataclass(frozen=True)
class Settings:
    """Bounds and strengths; sample_rows bounds what the classifier is fitted on."""

    sample_rows: int = 20_000
    min_rows: int = 3
    stem: int = 6
    voters: int = 128
    features: int = 2000
    min_z: float = 3.0
    voter_z: float = 5.0
    voter_lift: float = 3.0
    em_rounds: int = 6
    label_odds: float = 50.0
    steps: int = 150
    penalty: float = 1e-4


class _Features(dict):
    """Names of the features of a raw word: itself and its beginning; kept for up to 200,000 words."""

    def __init__(self, stem: int):
        super().__init__()
        self.stem = stem

    def __missing__(self, raw: str) -> tuple[str, ...]:
        word = raw.lower().strip(EDGES)
        out = (word, word[:self.stem] + "*") if len(word) > self.stem else (word,) if word else ()
        if len(self) < 200_000:
            self[raw] = out
        return out


class _Texts:
    """The features of texts, and their places in a fixed list of them if one is given."""

    def __init__(self, stem: int, features: list[str] = ()):
        self.names, self.at, self.of_word = _Features(stem), {f: i for i, f in enumerate(features)}, {}
        self.phrases = [(*f.split(" "), i) for f, i in self.at.items() if " " in f]

    def features(self, text: str) -> set[str]:
        """Words, beginnings and patterns of a text; phrases are looked for by `phrases_of`."""
        return {f for w in set(text.split()) for f in self.names[w]} | {n for n, p in PATTERNS.items() if p.search(text)}

    def phrases_of(self, text: str) -> set[int]:
        """Numbers a * n + b of the phrases of two words that both are among the n features."""
        raw, n = text.split(), len(self.at)
        place = [self.at.get(x[0], -1) if (x := self.names[w]) else -1 for w in raw]
        return {a * n + b for a, b in set(zip(place, place[1:])) if a >= 0 and b >= 0}  # noqa: B905

    def places(self, text: str | None) -> list[int]:
        """Sorted places of the text's features; a phrase is looked for only in texts that hold both of its words."""
        if not text:
            return []
        words, found, of_word = set(raw := text.split()), set(), self.of_word
        for w in words:
            if (own := of_word.get(w)) is None:
                own = tuple(self.at[f] for f in self.names[w] if f in self.at)
                if len(of_word) < 200_000:
                    of_word[w] = own
            found.update(own)
        if self.phrases:
            plain = None
            for a, b, i in self.phrases:
                if self.at.get(a, -1) in found and self.at.get(b, -1) in found:
                    plain = plain or [n[0] if (n := self.names[w]) else "" for w in raw]
                    if any(x == a and y == b for x, y in zip(plain, plain[1:])):  # noqa: B905
                        found.add(i)
        found.update(self.at[n] for n, p in PATTERNS.items() if n in self.at and p.search(text))
        return sorted(found)


def _among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows without most of those whose doc_id isn't among ids, by a map of _SLOTS bits: a join of texts after it shuffles few others."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(_SLOTS)).cast("int")
    marks = np.zeros(_SLOTS, dtype=bool)
    marks[ids.select(slot.alias("slot")).distinct().toArrow()["slot"].to_numpy()] = True
    sent = rows.sparkSession.sparkContext.broadcast(np.packbits(marks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in batches:
            at = batch.column(0).to_numpy()
            some = batch.filter(pa.array((bits[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)))
            yield pa.RecordBatch.from_arrays(some.columns[1:], names=["doc_id", "text"])

    return rows.select(slot.alias("slot"), "doc_id", "text").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def _summed(n: int) -> Callable:
    """Of batches (phrases, toxic): for each first word of phrases among n words the second ones, with the toxic and the clean rows of each; a task gives n rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a cell for each phrase: 4 bytes times n * n for either label
        seen = np.zeros((2, n, n), dtype=np.int32)
        for batch in batches:
            lists = batch.column(0)
            of = np.repeat(batch.column(1).to_numpy().astype(np.int64), np.diff(lists.offsets.to_numpy()))
            np.add.at(seen.reshape(-1), of * n * n + lists.flatten().to_numpy(), 1)
        for a in np.flatnonzero(seen.any(axis=(0, 2))):
            last = np.flatnonzero(seen[:, a].any(axis=0))
            yield pa.RecordBatch.from_pydict({"first": pa.array([a], pa.int32()), "last": pa.array([last], pa.list_(pa.int32())), "toxic": pa.array([seen[1, a, last]], pa.list_(pa.int64())), "clean": pa.array([seen[0, a, last]], pa.list_(pa.int64()))})

    return run


def _added(n: int, least: int) -> Callable:
    """Of the rows of one first word: (phrase, toxic, clean) of its phrases with `least` rows."""

    def run(table: pa.Table) -> pa.Table:
        first, (last, toxic, clean) = table["first"][0].as_py(), (table[c].combine_chunks().flatten().to_numpy() for c in ("last", "toxic", "clean"))
        toxic, clean = (np.bincount(last, weights=x, minlength=n).astype(np.int64) for x in (toxic, clean))
        last = np.flatnonzero(toxic + clean >= least)
        return pa.table({"phrase": pa.array((first * n + last).astype(np.int32)), "toxic": toxic[last], "clean": clean[last]})

    return run


def _mined(some: DataFrame, known: DataFrame, settings: Settings) -> tuple[list[tuple[str, int, int]], int, int]:
    """Features by how far their toxic rows exceed (or miss) chance, (feature, toxic rows, clean rows), and the numbers of rows; some (doc_id, text) holds all rows that are known.

    All rows are counted; the surest `features` are kept. A phrase is a feature only if both of its words are, so phrases are counted after words, of words that can be: as
    numbers for each text, which meet their labels without the texts and are summed where they do.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, seen = _Texts(settings.stem), (Counter(), Counter())

        def out() -> Iterator[pa.RecordBatch]:
            keys = list(seen[0].keys() | seen[1].keys())
            for at in range(0, len(keys), 50_000):
                some = keys[at:at + 50_000]
                yield pa.RecordBatch.from_pydict({"feature": pa.array(some, pa.string()), "toxic": pa.array([seen[1][k] for k in some], pa.int64()), "clean": pa.array([seen[0][k] for k in some], pa.int64())})
            seen[0].clear()
            seen[1].clear()

        for whole in batches:
            for batch in slices(whole, 0):
                for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    seen[label][""] += 1
                    seen[label].update(texts.features(text or ""))
                    if len(seen[0]) + len(seen[1]) > 500_000:
                        yield from out()
        yield from out()

    found = some.join(known.hint("merge"), "doc_id").select("text", "toxic").mapInArrow(count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    found = written(found.where(F.col("toxic") + F.col("clean") >= settings.min_rows), "features")
    totals = found.where("feature = ''").first()
    if totals is None:
        return [], 0, 0
    n_toxic, n_clean = totals.toxic, totals.clean
    share = n_toxic / (n_toxic + n_clean)
    rows = F.col("toxic") + F.col("clean")
    z = F.abs((F.col("toxic") - rows * share) / F.sqrt(rows * share * (1 - share) + 1))
    surest = lambda df: [(r.feature, r.toxic, r.clean) for r in df.withColumn("z", z).where(F.col("z") >= settings.min_z).orderBy(F.desc("z"), "feature").limit(settings.features).collect()]
    best = surest(found.where("feature <> ''"))
    words = [f for f, _, _ in best if not f.endswith("*") and f not in PATTERNS]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = _Texts(settings.stem, words)
        for whole in batches:
            for batch in slices(whole, 1):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted(texts.phrases_of(t or "")) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "phrases"])

    told = some.mapInArrow(pairs, f"doc_id {some.schema['doc_id'].dataType.simpleString()}, phrases array<int>").where(F.size("phrases") > 0).join(known.hint("merge"), "doc_id")
    told = told.select("phrases", "toxic").mapInArrow(_summed(len(words)), "first int, last array<int>, toxic array<long>, clean array<long>").groupBy("first").applyInArrow(_added(len(words), settings.min_rows), "phrase int, toxic long, clean long")
    names = some.sparkSession.createDataFrame(list(enumerate(words)), "i int, word string")  # settings.features rows at most
    first, second = names.toDF("i", "a"), names.toDF("j", "b")
    told = told.join(F.broadcast(first), F.floor(F.col("phrase") / len(words)) == F.col("i")).join(F.broadcast(second), F.col("phrase") % len(words) == F.col("j")) if words else told.limit(0).withColumns({"a": F.lit(""), "b": F.lit("")})
    phrases = written(told.select(F.concat_ws(" ", "a", "b").alias("feature"), "toxic", "clean"), "phrases")
    best = surest(found.where("feature <> ''").unionByName(phrases))
    single = {f for f, _, _ in best if " " not in f}
    return [x for x in best if " " not in x[0] or set(x[0].split(" ")) <= single], n_toxic, n_clean


def _places_of(table: DataFrame, features: list[str], stem: int, keep: str) -> DataFrame:
    """table (keep, text) with `places`, the sorted places of the features that each text has."""
    kind = table.schema[keep].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = _Texts(stem, features)
        for whole in batches:
            for batch in slices(whole, 1):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([texts.places(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))], names=[keep, "places"])

    return table.select(keep, "text").mapInArrow(run, f"{keep} {kind}, places array<int>")


def _log_odds(fires: np.ndarray, prior: float, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Log-odds of toxic; a voter that doesn't fire abstains, which tells nothing."""
    return np.log(prior / (1 - prior)) + fires @ (weight * (np.log(a) - np.log(b)))


def _fires(lists: pa.ListArray, n_voters: int) -> np.ndarray:
    cut = lists.offsets.to_numpy()
    fires = np.zeros((len(lists), n_voters))
    fires[np.repeat(np.arange(len(lists)), np.diff(cut)), lists.values.to_numpy(zero_copy_only=False)[cut[0]:cut[-1]]] = 1
    return fires


def posteriors(lists: pa.ListArray, known: np.ndarray, model: tuple, label_odds: float) -> np.ndarray:
    """Probability of toxic given votes and, where known is 1 or 0 and not -1, the label."""
    prior, a, b, weight = model
    gold = np.where(known < 0, 0, np.where(known == 1, 1, -1)) * np.log(label_odds)
    return 1 / (1 + np.exp(-np.clip(_log_odds(_fires(lists, len(a)), prior, a, b, weight) + gold, -30, 30)))


def label_model(patterns: DataFrame, prior: float, a: np.ndarray, b: np.ndarray, rounds: int, label_odds: float, strong: float = 0.5) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """prior, firing rates on toxic and clean texts, and weights of voters, by EM over vote patterns (places, known, n).

    Each round sums, under the posteriors so far, how often voters and pairs of voters fire in either class. What pairs fire
    together beyond their rates is their correlation there; a voter's weight is 1 / (1 + its correlations above `strong`, of the
    stronger class). The prior stays the share of toxic labels, as abstaining voters say nothing about it.
    """
    n_voters, weight = len(a), np.ones(len(a))
    for _ in range(rounds):
        now = (prior, a, b, weight)

        def add(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            sums, pairs = np.zeros((2, n_voters + 1)), np.zeros((2, n_voters, n_voters))
            for batch in batches:
                for at in range(0, batch.num_rows, 5000):
                    some = batch.slice(at, 5000)
                    p, n, fires = posteriors(some.column(0), some.column(1).to_numpy(), now, label_odds), some.column(2).to_numpy(), _fires(some.column(0), n_voters)
                    for k, w in enumerate((n * (1 - p), n * p)):
                        sums[k, 0] += w.sum()
                        sums[k, 1:] += w @ fires
                        pairs[k] += (fires * w[:, None]).T @ fires
            yield pa.RecordBatch.from_pydict({"sums": pa.array([sums.tobytes()], pa.binary()), "pairs": pa.array([pairs.astype(np.float32).tobytes()], pa.binary())})

        # patterns are few; their sums come here from 32 tasks at most
        parts = patterns.coalesce(32).mapInArrow(add, "sums binary, pairs binary").collect()
        sums = sum(np.frombuffer(r.sums).reshape(2, -1) for r in parts)
        pairs = sum(np.frombuffer(r.pairs, dtype=np.float32).reshape(2, n_voters, n_voters).astype(float) for r in parts)
        b, a = (np.clip((sums[k, 1:] + 0.01) / (sums[k, 0] + 1), 1e-6, 1 - 1e-6) for k in (0, 1))
        rho = np.zeros((n_voters, n_voters))
        for k, rate in enumerate((b, a)):
            both = pairs[k] / max(sums[k, 0], 1e-9)
            spread = np.sqrt(np.outer(rate * (1 - rate), rate * (1 - rate)))
            rho = np.maximum(rho, (both - np.outer(rate, rate)) / np.maximum(spread, 1e-9))
        np.fill_diagonal(rho, 0)
        weight = 1 / (1 + np.where(rho > strong, rho, 0).sum(1))
    return prior, a, b, weight


def fit_linear(lists: pa.ListArray, target: np.ndarray, n_features: int, steps: int, penalty: float) -> tuple[float, np.ndarray]:
    """Bias and weights of a logistic regression over binary features, by Adagrad on all rows."""
    cut = lists.offsets.to_numpy()
    owner, flat = np.repeat(np.arange(len(lists)), np.diff(cut)), lists.values.to_numpy(zero_copy_only=False)[cut[0]:cut[-1]]
    w, total = np.zeros(n_features + 1), np.full(n_features + 1, 1e-8)
    share = float(np.clip(target.mean(), 1e-4, 1 - 1e-4))
    w[-1] = np.log(share / (1 - share))
    for _ in range(steps):
        z = w[-1] + np.bincount(owner, weights=w[flat], minlength=len(lists))
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        slope = np.append(np.bincount(flat, weights=error[owner], minlength=n_features), error.sum()) / len(lists)
        slope[:-1] += penalty * w[:-1]
        total += slope * slope
        w -= 0.5 * slope / np.sqrt(total)
    return float(w[-1]), w[:-1]


def toxicity(docs: DataFrame, labels: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", settings: Settings = Settings()) -> DataFrame:
    """doc_id, train, score and predicted of every row of docs; labels (doc_id, label) count only where train, a Column over the id, holds."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("train", F.coalesce(train, F.lit(True)))
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("toxic")).where(F.coalesce(train, F.lit(False)) & F.col("toxic").isin(0, 1))
    known = written(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "known")
    known = written(known.join(rows.select("doc_id").distinct(), "doc_id", "left_semi"), "known")  # labels of documents that are there
    mined, n_toxic, n_clean = _mined(_among(rows.where("train"), known), known, settings)
    share = n_toxic / max(n_toxic + n_clean, 1)
    if not (n_toxic and n_clean and mined):
        return rows.select("doc_id", "train", F.lit(float(share)).alias("score"), F.lit(int(share >= 0.5)).alias("predicted"))

    features = [f for f, _, _ in mined]
    lift = lambda x: (x[1] + 0.5) / (n_toxic + 1) * (n_clean + 1) / (x[2] + 0.5)
    sure = lambda x: abs(x[1] - (x[1] + x[2]) * share) >= settings.voter_z * ((x[1] + x[2]) * share * (1 - share) + 1) ** 0.5
    voters = [x for x in mined if sure(x) and not 1 / settings.voter_lift < lift(x) < settings.voter_lift][:settings.voters]
    voters = voters or mined[:settings.voters]
    a = np.array([(x[1] + 0.5) / (n_toxic + 1) for x in voters])
    b = np.array([(x[2] + 0.5) / (n_clean + 1) for x in voters])
    names = [f for f, _, _ in voters]
    votes = _places_of(rows.where("train"), names, settings.stem, "doc_id").join(known, "doc_id", "left").withColumn("known", F.coalesce("toxic", F.lit(-1)))
    patterns = written(votes.groupBy("places", "known").agg(F.count(F.lit(1)).alias("n")).select("places", "known", "n"), "patterns")
    model = label_model(patterns, share, a, b, settings.em_rounds, settings.label_odds)

    some = lambda df: df.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(settings.sample_rows)
    others = rows.where("train AND doc_id IS NOT NULL").select("doc_id").join(known, "doc_id", "left_anti").distinct().withColumn("toxic", F.lit(-1))
    # ids and labels of at most twice sample_rows rows
    chosen = written(some(known).unionByName(some(others)), "chosen")
    fitted = _places_of(rows.join(F.broadcast(chosen), "doc_id"), features, settings.stem, "toxic").toArrow().combine_chunks()
    lists, labels_of = fitted.column("places").combine_chunks(), fitted.column("toxic").to_numpy()
    cut, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    voter_of = np.full(len(features), -1)
    voter_of[[features.index(f) for f in names]] = np.arange(len(names))
    votes_of = voter_of[flat[cut[0]:cut[-1]]]
    kept = np.append(0, np.cumsum(votes_of >= 0))[cut - cut[0]]
    target = posteriors(pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), pa.array(votes_of[votes_of >= 0].astype(np.int32))), labels_of, model, settings.label_odds)
    bias, weights = fit_linear(lists, target, len(features), settings.steps, settings.penalty)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = _Texts(settings.stem, features)
        for whole in batches:
            for batch in slices(whole, 1):
                z = np.array([bias + weights[texts.places(t)].sum() for t in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())], names=["doc_id", "train", "score"])

    scored = rows.select("doc_id", "text", "train").mapInArrow(run, f"doc_id {kind}, train boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
