"""Anchored groups, debounced requests, packing: against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.operators.sequences import anchors, anchored, debounced, packed, reading_order


def chain(values, width, strict):
    out = []
    for v in sorted(set(values)):
        if not out or (v - out[-1] > width if strict else v - out[-1] >= width):
            out.append(v)
    return out


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("width", [1, 7, 2.5])
def test_anchors_equal_the_loop(spark, width, strict):
    rng = random.Random(width)
    rows = [(rng.choice([1, 2, None]), None if rng.random() < 0.05 else rng.choice([rng.uniform(-40, 40), float(rng.randrange(-40, 40))]), i) for i in range(300)]
    rows += [(3, float(v), 0) for v in (5, 5, 500, 501, 10_000)]
    df = spark.createDataFrame(rows, "key int, v double, anchor_bucket int").withColumn("v", F.round("v", 1))
    values = [(r["key"], r["v"]) for r in df.collect()]
    got = sorted(((r["key"], r["anchor"]) for r in anchors(df, ["key"], "v", width, strict).collect()), key=repr)
    want = {k: chain([v for kk, v in values if kk == k and v is not None], width, strict) for k in (1, 2, 3, None)}
    assert got == sorted(((k, a) for k, x in want.items() for a in x), key=repr)
    of = anchored(df.drop("anchor_bucket"), ["key"], "v", width, strict).collect()
    assert len(of) == len(rows)
    for r in of:
        assert r["anchor"] == (None if r["v"] is None else max(a for a in want[r["key"]] if a <= r["v"]))


def test_reading_order_equals_the_loop(spark):
    rng = random.Random(3)
    rows = [(p, i, float(rng.randrange(60)), float(rng.randrange(5))) for p in range(4) for i in range(40)]
    got = {(r["page"], r["block"]): (r["row"], r["place"]) for r in reading_order(spark.createDataFrame(rows, "page int, block int, y double, x double"), "page", "y", "x", "block", 4.0).collect()}
    for p in range(4):
        lines, first = [], None
        for r in sorted((r for r in rows if r[0] == p), key=lambda r: r[2]):
            if first is None or abs(r[2] - first) > 4.0:
                lines.append([])
                first = r[2]
            lines[-1].append(r)
        for n, line in enumerate(lines):
            for m, r in enumerate(sorted(line, key=lambda r: (r[3], r[2], r[1]))):
                assert got[p, r[1]] == (n, m)


def test_debounce_equals_the_loop(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(3), rng.randrange(4000), i) for i in range(200)] + [(9, 5, 0), (9, 5, 1), (9, 304, 2), (9, 305, 3), (9, 306, 4)]
    got = sorted(tuple(r) for r in debounced(spark.createDataFrame(rows, "key int, t long, id int"), "key", "t", "id", 300).collect())
    want = []
    for k in {r[0] for r in rows}:
        last, pending = None, []
        for t in sorted(r[1] for r in rows if r[0] == k):
            pending.append(t)
            if last is None or t - last >= 300:
                want.append((k, t, pending[0], len(pending)))
                last, pending = t, []
    assert got == sorted(want)


def test_packing_equals_the_loop(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 2, None]), i, f"n{i % 7}", rng.choice([None, " ", "x" * rng.randrange(1, 90), " y  "])) for i in range(120)]
    got = packed(spark.createDataFrame(rows, "key int, i int, name string, text string"), "key", [F.col("i")], "name", "text", F.lit(50), 400, "HEAD").collect()
    for k in (1, 2, None):
        used = 4
        for r in sorted((r for r in got if r["key"] == k), key=lambda r: r["i"]):
            text = (rows[r["i"]][3] or "").strip(" ")
            text = text[:50] + " [truncated]" if len(text) > 50 else text
            section = f"## {rows[r['i']][2]}\n{text}" if text else None
            fires = section is not None and used + len(section) <= 400
            used += len(section) if fires else 0
            assert (r["section"], r["fired"], r["used"]) == (section, fires, used)
    assert len(got) == 120 and {r["fired"] for r in got} == {True, False}
