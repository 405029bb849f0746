"""Periodic runs against trying every period at every word."""

import hashlib
import re
from fractions import Fraction

import numpy as np
import pytest

from corvane.llm.word_runs import find_runs, word_runs


def every_run(w):
    found = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q), q)  # a greater period over the same words isn't the smallest
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def expected(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = sorted(every_run(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    told = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(told.encode()).hexdigest(), " ".join(w for i, w in enumerate(words) if i not in gone))


def random_words(rng):
    parts = []
    for _ in range(rng.integers(1, 6)):
        kind = rng.integers(0, 4)
        if kind == 0:
            parts.append(rng.integers(0, rng.integers(1, 5), rng.integers(1, 60)))
        elif kind == 1:
            parts.append(np.tile(rng.integers(0, 30, rng.integers(1, 20)), rng.integers(2, 9)))
        elif kind == 2:
            parts.append(np.tile(np.append(np.tile(rng.integers(0, 3, rng.integers(1, 4)), rng.integers(2, 9)), 9), rng.integers(2, 6)))
        else:
            parts.append(rng.integers(0, 200, rng.integers(1, 40)))
    return np.concatenate(parts)


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    rng = np.random.default_rng(seed)
    for _ in range(60):
        texts = [random_words(rng) for _ in range(rng.integers(1, 5))]
        base, want = 0, []
        for t in texts:
            want += [(s + base, s + n + base, q) for s, n, q in sorted(every_run(t.tolist()), key=lambda r: (r[0], r[2]))]
            base += len(t)
        got = find_runs(np.concatenate(texts), np.repeat(np.arange(len(texts)), [len(t) for t in texts]))
        assert list(zip(*[x.tolist() for x in got], strict=True)) == want


def test_rows_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{v}" for v in random_words(rng)) for _ in range(40)]
    texts += [None, "", " \t\n", "one", "a " * 23, "a " * 24, " x   x  " * 12, " b\x0bc\x0c" * 30 + "\r\n", "ab " * 3000, texts[0], texts[0]]
    rows = [(i % 45 or None, t, 7) for i, t in enumerate(texts)]  # ids repeat and are null
    df = spark.createDataFrame(rows, "doc_id long, text string, n_runs int").repartition(3)
    got = [tuple(r) for r in word_runs(df).collect()]
    assert sorted(got, key=repr) == sorted([(i, *expected(t)) for i, t, _ in rows], key=repr)
    assert word_runs(df.limit(0)).count() == 0


def test_query_turns_one_document_of_ten(spark):
    import zlib

    from corvane.llm.queries import op12_word_runs

    folder = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in op12_word_runs(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    turned = 0
    for r in docs:
        words, h = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""), zlib.crc32(str(r["doc_id"]).encode())
        g, n = h // 10, len(words)
        if n > 3000:
            continue  # the plain way is slow
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words, turned = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)], turned + 1
        want = expected(" ".join(words))
        assert tuple(got[r["doc_id"]])[1:7] == want[:6] and got[r["doc_id"]]["collapsed_sha256"] == hashlib.sha256(want[6].encode()).hexdigest()
    assert turned and len(got) == len(docs)
