"""Quality rules, decontamination and toxicity against brute force and held-out labels."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.llm import decontaminate as de
from corvane.llm import quality_rules as qr
from corvane.llm import toxicity as tx

WORDS = [f"word{i}" for i in range(300)]


def edit_distance_inside(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern):
        new = [i + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (p != t), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def repeat_words(text):
    w = text.split(" ")
    seen, covered = {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i:i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {i + k for i in at for k in range(8)}
    return len(covered)


def test_quality_measures_and_verdicts(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(WORDS[:k], k=n)) for k in (2, 5, 40, 300) for n in (1, 7, 8, 30, 200)] + [" ".join(WORDS[:20] * 3), " ".join(WORDS[:60]), "a " * 40000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, ""])], "id long, text string").withColumn("measures", F.lit(1))
    got = {r.id: r for r in qr.with_verdicts(df).collect()}
    for i, t in enumerate(texts):
        assert got[i]._measures.n_repeat_words == repeat_words(t.strip()), i
    assert got[len(texts)].rejected_by == got[len(texts) + 1].rejected_by == "too_few_words"
    assert got[21].rejected_by is None and got[20].rejected_by == "repeated_windows"
    kept = qr.keep_good(df)
    assert kept.columns == df.columns and {r.id for r in kept.collect()} == {i for i, r in got.items() if r.rejected_by is None}
    assert qr.keep_good(df.limit(0)).count() == 0


def test_alignment_is_edit_distance():
    rng = random.Random(2)
    for _ in range(40):
        p = "".join(rng.choices("abc", k=rng.randint(5, 30)))
        t = list("".join(rng.choices("abc", k=10)) + p + "".join(rng.choices("abc", k=10)))
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice(["", "a", "bc"])
        t = "".join(t)
        got, _ = de.aligned(de.codes(p), de.codes(t), -len(p), len(t), len(p))
        assert got == edit_distance_inside(p, t)


def test_leaks(spark):
    rng = random.Random(9)
    item = lambda n: " ".join(rng.choices(WORDS, k=n))
    items = [(1, item(20)), (2, item(60)), (3, "tiny"), (4, None), (5, item(5))]
    noise = item(400)
    spoiled = items[1][1].replace("word1", "wrd1", 2)
    docs = [(1, noise), (2, noise + " " + items[0][1].upper().replace(" ", " ,\n") + noise), (3, spoiled), (4, None), (5, ""), (6, items[4][1] + "!"), (None, items[0][1]), (7, items[1][1][:200] + noise), (8, " ".join(items[0][1].split()[::-1]))]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {("2", 1), ("3", 2), ("6", 5), ("None", 1), ("7", 2)}
    assert {(str(r.doc_id), r.item_id) for r in de.find_leaks(df, bench).collect()} == want
    one = de.Limits(block_chars=10)
    assert {(str(r.doc_id), r.item_id) for r in de.find_leaks(df, bench, limits=one).collect()} == want
    kept = de.keep_clean(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {1, 4, 5, 8}
    assert de.find_leaks(df, bench.limit(0)).count() == 0 and de.find_leaks(df.limit(0), bench).count() == 0


def test_bands_find_what_the_lemma_promises():
    rng = random.Random(4)
    limits = de.Limits()
    for _ in range(30):
        text = de.normalised(" ".join(rng.choices(WORDS, k=12)))
        index = de.Index([(1, text)], limits)
        t = list(text)
        for _ in range(int(index.edits[0])):
            t[rng.randrange(len(t))] = rng.choice(["", "x", "yz"[:1]])
        inside = "q" * rng.randint(0, 50) + "".join(t) + "q" * 9
        if edit_distance_inside(text, inside) <= index.edits[0]:
            assert index.hits(inside)


def test_leaks_against_full_edit_distance(spark):
    rng = random.Random(21)
    items = [(i, " ".join(rng.choices(WORDS, k=rng.choice([2, 3, 4, 8, 16, 30])))) for i in range(8)] + [(8, "exactly10c"), (9, "short")]
    docs = []
    for i in range(60):
        t = list(items[i % 9][1])
        for _ in range(rng.choice([0, 1, 2, 4, 7, 12])):
            t[rng.randrange(len(t))] = rng.choice(["", "x", "Q", "ab"])
        docs.append((i, " ".join(rng.choices(WORDS, k=rng.randint(0, 9))) + " " + "".join(t) + " " + " ".join(rng.choices(WORDS, k=rng.randint(0, 9)))))
    docs += [docs[0], docs[0], (99, items[4][1] + " filler" * 60_000 + " " + items[5][1])]
    limits, want = de.Limits(), set()
    for d, t in docs:
        flat = de.normalised(t)
        for item, text in items:
            for s in de.segments(de.normalised(text), limits):
                budget = min(len(s) * limits.edit_percent // 100, (len(s) - de.Q) // de.Q)
                if s in flat or (len(flat) < 2000 and edit_distance_inside(s, flat) <= budget):
                    want.add((d, item))
    got = de.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), limits=limits).collect()
    assert len(got) == len(want) and {(r.doc_id, r.item_id) for r in got} == want and len(want) > 20


@pytest.fixture(scope="module")
def toxic_rows():
    rng = np.random.default_rng(7)
    rows, labels = [], []
    for i in range(1500):
        bad = i % 6 == 0
        w = list(rng.choice(WORDS, 40))
        if bad:
            w[int(rng.integers(40))] = rng.choice(["Vile!", "rotten", "nasty.", "nastiest"])
        rows.append((i, " ".join(w), "en"))
        if i % 2 == 0:
            labels.append((i, 1, int(bad)))
    return rows + [(5000, None, "x"), (5001, "", "x"), (None, "rotten", "x"), (6, "rotten " * 20000, "x")], labels


def test_toxicity_on_held_out_rows(spark, toxic_rows):
    rows, labels = toxic_rows
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    train = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    got = tx.toxicity(docs, marks, train).collect()
    held = [r for r in got if r.doc_id is not None and r.doc_id < 1500 and not r.train]
    right = sum(r.predicted == int(r.doc_id % 6 == 0) for r in held)
    assert len(got) == len(rows) and right >= 0.97 * len(held)
    empty = [r.score for r in got if r.doc_id in (5000, 5001)]
    assert empty[0] == empty[1] < 0.5
    flipped = marks.withColumn("toxic", F.when(train, F.col("toxic")).otherwise(1 - F.col("toxic")))
    again = tx.toxicity(docs, flipped, train).collect()
    assert sorted((str(r.doc_id), round(r.score, 9)) for r in got) == sorted((str(r.doc_id), round(r.score, 9)) for r in again)


def test_toxicity_without_labels(spark, toxic_rows):
    docs = spark.createDataFrame(toxic_rows[0][:5], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in tx.toxicity(docs, marks, F.lit(True)).collect()} == {0.0}
    assert tx.toxicity(docs.limit(0), marks, F.lit(True)).count() == 0


def test_classifier_from_votes_alone(spark, toxic_rows):
    """With labels of no weight in the posteriors, what voters say of all texts still trains a classifier."""
    rows, labels = toxic_rows
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, x string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    train = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    got = tx.toxicity(docs, marks, train, settings=tx.Settings(label_odds=1.0)).collect()
    held = [r for r in got if r.doc_id is not None and r.doc_id < 1500 and not r.train]
    assert sum(r.predicted == int(r.doc_id % 6 == 0) for r in held) >= 0.95 * len(held)


def test_label_model_is_em(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(300):
        toxic = rng.random() < 0.3
        votes = sorted(v for v in range(4) if rng.random() < ((0.7, 0.6, 0.05, 0.5) if toxic else (0.1, 0.05, 0.4, 0.5))[v])
        if 0 in votes:
            votes = sorted({*votes, 4})  # a voter that always follows another
        rows.append((votes, rng.choice([-1, -1, int(toxic)]), rng.randint(1, 3)))
    a, b = np.array([0.5, 0.5, 0.1, 0.5, 0.5]), np.array([0.1, 0.1, 0.4, 0.5, 0.1])
    got = tx.label_model(spark.createDataFrame(rows, "places array<int>, known int, n long").repartition(3), 0.3, a, b, 4, 50.0)
    w = [1.0] * 5
    for _ in range(4):
        total, fired, both = [0.0, 0.0], [[0.0] * 5, [0.0] * 5], [[[0.0] * 5 for _ in range(5)] for _ in range(2)]
        for votes, known, n in rows:
            z = np.log(0.3 / 0.7) + sum(w[v] * np.log(a[v] / b[v]) for v in votes) + {-1: 0, 0: -1, 1: 1}[known] * np.log(50)
            p = 1 / (1 + np.exp(-z))
            for k, q in enumerate((n * (1 - p), n * p)):
                total[k] += q
                for v in votes:
                    fired[k][v] += q
                    for u in votes:
                        both[k][v][u] += q
        b, a = ([(fired[k][v] + 0.01) / (total[k] + 1) for v in range(5)] for k in (0, 1))
        w = []
        for v in range(5):
            rho = [max((both[k][v][u] / total[k] - r[v] * r[u]) / (r[v] * (1 - r[v]) * r[u] * (1 - r[u])) ** 0.5 for k, r in ((0, b), (1, a))) for u in range(5) if u != v]
            w.append(1 / (1 + sum(x for x in rho if x > 0.5)))
    assert np.allclose(got[1], a, atol=1e-4) and np.allclose(got[2], b, atol=1e-4) and np.allclose(got[3], w, atol=1e-3)
    assert w[0] < 0.6 and w[4] < 0.6 and w[3] == 1 and a[2] < b[2]


def test_toxicity_mines_labelled_texts_alone(spark, toxic_rows):
    """Rows without labels go before texts are joined, and counts of words and phrases are those of all labelled texts."""
    rows, labels = toxic_rows
    rows = [(i, t and t.replace("nasty. ", "Vile! rotten ")) for i, t, _ in rows]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    known = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("doc_id % 5 <> 0")
    some = tx._among(docs.select("doc_id", "text"), known)
    assert known.join(docs, "doc_id").count() <= some.count() < docs.count()
    mined, n_toxic, n_clean = tx._mined(some, known, tx.Settings())
    texts, want = tx._Texts(6), {}
    labelled = docs.join(known, "doc_id").select("text", "toxic").collect()
    for r in labelled:
        raw = [n[0] if (n := texts.names[w]) else "" for w in (r.text or "").split()]
        for f in texts.features(r.text or "") | {f"{a} {b}" for a, b in zip(raw, raw[1:]) if a and b}:  # noqa: B905
            want.setdefault(f, [0, 0])[r.toxic] += 1
    assert len(labelled) == n_toxic + n_clean and mined
    assert all(want[f] == [clean, toxic] for f, toxic, clean in mined)
    assert ("vile rotten" in {f for f, _, _ in mined}) == (want["vile rotten"][1] >= 3)


def test_toxicity_makes_no_row_for_each_phrase_of_a_text(spark, monkeypatch):
    """Phrases are summed where they meet their labels: a task gives a row for each first word."""
    docs = spark.createDataFrame([(i, f"{'vile nasty' if i % 4 == 0 else 'kind mild'} x{i}") for i in range(400)], "doc_id long, text string")
    known = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    plans, written = [], tx.written
    monkeypatch.setattr(tx, "written", lambda df, name: (plans.append((name, df._jdf.queryExecution().toString())), written(df, name))[1])
    mined = {f: (toxic, clean) for f, toxic, clean in tx._mined(docs, known, tx.Settings(min_z=1.0))[0]}
    assert mined["vile nasty"] == (100, 0) and mined["kind mild"] == (0, 300)
    assert [name for name, _ in plans] == ["features", "phrases"] and not any("Generate" in plan for _, plan in plans)
    batch = pa.RecordBatch.from_pydict({"phrases": pa.array([[1, 2], [1], [5]], pa.list_(pa.int32())), "toxic": pa.array([1, 0, 0], pa.int32())})
    assert [x for b in tx._summed(3)(iter([batch, batch])) for x in b.to_pylist()] == [{"first": 0, "last": [1, 2], "toxic": [2, 2], "clean": [2, 0]}, {"first": 1, "last": [2], "toxic": [0], "clean": [2]}]
