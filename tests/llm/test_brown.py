"""Brown classes: the gain of a move against recomputing, and scores against a plain version."""

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from corvane.llm import brown


def test_gain_is_that_of_recomputing():
    rng = np.random.default_rng(1)
    n = rng.integers(0, 9, (7, 7))
    classes = np.array([0, 1, 2, 0, 1, 2, 3])

    def class_bigrams(c):
        g = np.zeros((4, 4))
        for a in range(7):
            for b in range(7):
                g[c[a], c[b]] += n[a, b]
        return g

    g = class_bigrams(classes)
    for item in range(6):
        right, left = (np.bincount(classes, weights=x, minlength=4) for x in (n[item], n[:, item]))
        to, gain = brown.best_move(g, classes[item], right, left, float(n[item, item]))
        gains = []
        for k in range(4):
            other = classes.copy()
            other[item] = k
            gains.append(brown.objective(class_bigrams(other)) - brown.objective(g))
        assert abs(gains[to] - max(gains)) < 1e-9 and abs(gain - max(gains)) < 1e-9


def test_scores(spark):
    rows = [(i, " ".join(["The cat sat", "le chat dort", "der hund"][(i + j) % 3 if i % 5 == 0 else i % 3] for j in range(i % 9 + 1))) for i in range(200)]
    rows += [(500, None), (501, ""), (502, "\tUNSEEN words\nhere "), (None, "the cat"), (503, "the " * 20000), (503, "the")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    small = brown.Settings(head_items=4, bundles=3, classes=3, rounds=6, counts_kept=6)
    got = brown.score(df, ~held, settings=small).collect()
    train = [(t or "").lower().split() for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in train for w in t)
    c["<end>"] = len(train)
    total = sum(c.values())
    want = Counter()
    for i, t in rows:
        w = [*(t or "").lower().split(), "<end>"]
        want[str(i), len(w), sum(c[x] > 0 for x in w), round(sum(math.log10((c[x] + 1) / (total + len(c) + 1)) for x in w), 6)] += 1
    assert Counter((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {total}
    seen = [r for r in got if r.doc_id is not None and r.doc_id < 200]
    assert sum(r.score for r in seen) > sum(r.base_score for r in seen) and all(r.score < 0 for r in got)


def test_model_sums_to_one(spark):
    rows = [(i, ["a b", "b c", "c a d"][i % 3]) for i in range(30)]
    vocabulary = ["a", "b", "c", "d"]
    small = brown.Settings(head_items=2, bundles=2, classes=2, rounds=3, counts_kept=3)
    unseen = {}
    for x in range(1000):
        unseen.setdefault(brown.bundle(f"zz{x}".encode(), 2), f"zz{x}")
    probe = [(100 + i, w) for i, w in enumerate([*vocabulary, *unseen.values(), ""])]
    df = spark.createDataFrame(rows + probe, "doc_id long, text string")
    got = {r.doc_id: r.score for r in brown.score(df, F.col("doc_id") < 100, settings=small).collect()}
    assert got[106] < 0
    # first token after the start: P(word) is the score of the one-word text over that of its end, so only a bound is checked
    assert sum(10 ** got[100 + i] for i in range(7)) < 1


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert brown.score(df.limit(0), F.lit(True)).count() == 0
    assert brown.score(df, F.lit(False)).first().n_known == 0
