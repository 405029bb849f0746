"""What grows with the input in the steps that did too much: plans, partitions, tiles and kinds of counters."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import temporal
from corvane.operators import relational as rel
from corvane.operators import retrieval as R
from corvane.plans import everyday, insight
from corvane.sources import files


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_surest_new_link_is_that_of_all_pairs(spark):
    rng = random.Random(9)
    names = [f"user {i} {h}" for i in range(40) for h in (0, 1)]
    count = lambda: (r := rng.randrange(12), e := rng.randrange(12), rng.randrange(r + 1), rng.randrange(e + 1))
    kinds = [count() for _ in range(25)]
    now, before = ({x: rng.choice(kinds) for x in names if rng.random() < 0.9} for _ in range(2))

    def link(a, b):
        (ar, ae, *_), (r, e, rq, eq) = a, b
        if not (ar >= 4 and ar > ae * 1.3 and e >= 4):
            return None
        shift, fell = eq / e - (rq / r if r else 0), r < e * 0.6
        shifted = shift >= 0.25 and r >= 4
        sure = round(min(0.35 + 0.3 * (ar - ae) / max(ar, 1) + 0.25 * max(0, min(shift, 1)) + 0.2 * (max(0, min((e - r) / e, 1)) if fell else 0), 0.7), 6)
        return ("a_rising__b_engagement_drop" if shifted else "a_rising__b_volume_drop", sure) if (shifted or fell) and sure >= 0.6 else None

    want = {}
    for a in now:
        found = [(-x[1], b, x[0]) for b in now if b != a and (x := link(now[a], now[b])) and not ((y := link(before[a], before[b]) if a in before and b in before else None) and y[0] == x[0])]
        if found:
            want[a] = (min(found)[1], min(found)[2], -min(found)[0])
    df = lambda c: spark.createDataFrame([(x, *v) for x, v in c.items()], "x string, r long, e long, rq long, eq long")
    got = insight.surest_new(df(now), df(before)).collect()
    assert {r["a"]: (r["b"], r["direction"], r["confidence"]) for r in got} == want and len(got) == len(want) > 3


def test_links_are_dealt_by_pairs_and_scored_by_lists(spark, monkeypatch):
    """All pairs of small blocks; before, the bytes of the drivers, which are few, gave one task all pairs."""
    monkeypatch.setattr(insight, "BLOCK", 7, raising=False)
    monkeypatch.setattr(insight, "SHARE", 60, raising=False)
    rng = random.Random(5)
    kinds = [(9, 2, 1, 1), (8, 4, 0, 4), (2, 9, 0, 3), (0, 5, 0, 0), (6, 6, 0, 6), (5, 0, 5, 0), (3, 5, 0, 0), (13, 10, 0, 5), (6, 10, 6, 10), (1, 3, 0, 3)]
    counts = {x: rng.choice(kinds) for x in [None, *[f"user {i}" for i in range(70)]]}
    rows = []
    for x, (r, e, rq, eq) in counts.items():
        rows += [(x, "2024-01-25", i < rq) for i in range(r)] + [(x, "2024-01-18", i < eq) for i in range(e)] + [(x, "2024-01-16", True), (x, "2024-01-31", True)]
    turns = spark.createDataFrame(rows, "x string, ts string, ask boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    want = {}
    for a, (ar, ae, *_) in counts.items():
        for b, (r, e, rq, eq) in counts.items():
            shift, fell = (eq / e if e else 0) - (rq / r if r else 0), 10 * r < 6 * e
            shifted = shift >= 0.25 and r >= 4
            if None not in (a, b) and a != b and ar >= 4 and 10 * ar > 13 * ae and e >= 4 and (shifted or fell):
                sure = 0.35 + 0.3 * (ar - ae) / ar + 0.25 * max(0, min(shift, 1)) + 0.2 * ((e - r) / e if fell else 0)
                want[a, b] = ("a_rising__b_engagement_drop" if shifted else "a_rising__b_volume_drop", round(min(sure, 0.7), 6))
    out = insight.domain_links(turns, "x", "ts", F.col("ask"), *insight._NOW)
    got = out.collect()
    assert {(r["a"], r["b"]): (r["direction"], r["confidence"]) for r in got} == want and len(got) == len(want) > 300
    assert "BroadcastNestedLoopJoin" not in plan_of(out) and out.rdd.getNumPartitions() > 4
    assert insight.domain_links(turns.where("false"), "x", "ts", F.col("ask"), *insight._NOW).count() == 0


def test_a_task_names_the_domains_of_few_blocks(spark, monkeypatch):
    """So that files of the result hold a name once; before, each task named those of all blocks."""
    monkeypatch.setattr(insight, "BLOCK", 10)
    monkeypatch.setattr(insight, "SHARE", 100)
    turns = [(f"up {i}", "2024-01-25", False) for i in range(40) for _ in range(5)] + [(f"down {i}", "2024-01-18", False) for i in range(60) for _ in range(5)]
    turns = spark.createDataFrame(turns, "x string, ts string, ask boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    out = insight.domain_links(turns, "x", "ts", F.col("ask"), *insight._NOW).groupBy(F.spark_partition_id().alias("task")).agg(F.countDistinct("b").alias("names"), F.count("b").alias("pairs")).collect()
    assert sum(r["pairs"] for r in out) == 2400 and len(out) > 10 and max(r["names"] for r in out) <= 35


def test_exact_and_approximate_counts_are_apart(spark):
    """No sketch is kept for each order."""
    plan = plan_of(everyday.approx_distinct(spark, "/root/testdata/sf0.001"))
    assert not [x for x in plan.splitlines() if "approx_count_distinct" in x and "HashAggregate" in x and "l_orderkey#" in x.split("functions=")[0]]


def test_salted_join_does_not_broadcast(spark):
    left = spark.createDataFrame([(i, i % 3) for i in range(60)], "id long, k long")
    right = spark.createDataFrame([(k, f"n{k}") for k in range(3)], "k long, name string")
    out = rel.salted_join(left, right, "k", 8, "id")
    assert "BroadcastHashJoin" not in plan_of(out) and sorted((r["id"], r["name"]) for r in out.collect()) == [(i, f"n{i % 3}") for i in range(60)]


def test_short_ranges_share_a_task(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"line {i}\n" for i in range(20_000)))
    rows = files.numbered_lines(spark, f"file://{tmp_path}/a.txt", 4 << 10)
    assert files.lines(spark, f"file://{tmp_path}/a.txt", 4 << 10).rdd.getNumPartitions() == 1
    assert [(r["line_no"], r["line"]) for r in rows.orderBy("line_no").collect()] == [(i + 1, f"line {i}") for i in range(20_000)]


@pytest.mark.parametrize("k", [1, 4])
def test_vector_search_over_tiles_of_queries(spark, k):
    v = np.random.default_rng(3).normal(size=(1300, 4)).round(2)
    base = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    sim = np.round(unit @ unit.T, 6) + 0.0
    got = {(r["query_id"], r["rank"]): r["similarity"] for r in R.vector_top_k(base, base.withColumnRenamed("vec_id", "query_id"), k).collect()}
    want = -np.sort(-sim, axis=1)[:, :k]
    assert len(got) == 1300 * k and all(abs(got[q, n] - want[q, n]) < 2e-6 for q in range(1300) for n in range(k))


def test_event_matches_of_repeated_texts(spark):
    texts = [(i, ["the green widget", "a blue gear", "green widgets"][i % 3]) for i in range(30)]
    phrases = spark.createDataFrame([("p", "after the green widget was shipped")], "p string, phrase string")
    got = temporal.event_matches(phrases, spark.createDataFrame(texts, "t long, x string"), "p", "phrase", "t", "x", k=12).orderBy("rank").collect()
    assert [r["t"] for r in got] == [*range(0, 30, 3), *range(2, 30, 3)][:12] or [r["t"] for r in got] == sorted(i for i in range(30) if i % 3 != 1)[:12]
