"""The Jaccard join against all pairs, with families of near copies, long lists and odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import jaccard_join as jj
from corvane.llm.common import components


def plain(rows, width, num, den):
    sets = []
    for _, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ")
        w = [x for x in w if x]
        sets.append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted((str(d), len(sets[i]), str(low.get(find(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows))


def corpus(seed, families=12, most=30):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, passage = [], rng.choices(words, k=25)
    for _ in range(families):
        base = rng.choices(words, k=rng.choice([5, 20, 60, 150]))
        for _ in range(rng.randint(1, most)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append(w + passage if rng.random() < 0.3 else w)
    rng.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)] + [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "One  two"), (1004, "one two"), (1005, "two one"), (None, "one two"), (1003, "one two three"), (None, "lonely words here now"), (7, rows[3][0] + " x")]


@pytest.mark.parametrize(("width", "num", "den", "long_list", "tile", "one_in"), [(3, 90, 100, 32, 1000, 32), (3, 90, 100, 4, 7, 1), (5, 80, 100, 3, 5, 2), (5, 80, 100, 2, 5, 1000)])
def test_against_all_pairs(spark, width, num, den, long_list, tile, one_in):
    rows = corpus(width + long_list)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("h", F.lit(2))
    got = jj.jaccard_groups(df, width, num, den, long_list=long_list, tile=tile, one_in=one_in).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == plain(rows, width, num, den)


def test_tiles_connect_as_all_links_do():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))
    sets = [np.unique(np.concatenate((base[rng.random(len(base)) > 0.03], rng.integers(0, 2**63, 4).astype(np.uint64)))) for _ in range(80)]
    links = jj.tile_links(np.arange(80), sets, 90, 100)

    def groups(pairs):
        root = list(range(80))
        for a, b in pairs:
            old, new = root[a], root[b]
            root = [new if x == old else x for x in root]
        return {frozenset(i for i in range(80) if root[i] == r) for r in root}

    every = [(i, j) for i in range(80) for j in range(i) if jj._linked(sets[i], sets[j], 90, 100)]
    assert groups(links) == groups(every) and len(links) < 80


def test_empty_table(spark):
    assert jj.jaccard_groups(spark.createDataFrame([], "doc_id long, text string"), 3, 90, 100).count() == 0


def test_components(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(7, i) for i in range(200, 260)]
    some = [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    links = [*chain, *star, *some, (5, 5), (9, 8), (8, 9), (9, 8)]
    label = {x: x for a, b in links if a != b for x in (a, b)}
    for _ in range(200):
        for a, b in links:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == label
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
