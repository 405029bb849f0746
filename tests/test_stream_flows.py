"""Watermark policies, backfill with a live flow, debounced requests as streams."""

import datetime

import pytest
from pyspark.sql import functions as F

from corvane.streaming import streams as st

UTC = datetime.timezone.utc


def at(minute):
    return datetime.datetime(2024, 1, 1, tzinfo=UTC) + datetime.timedelta(minutes=minute)


def files(spark, folder, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{folder}")
    return f"file://{folder}"


def test_policies_differ_and_end_with_their_block(spark, tmp_path):
    a = files(spark, tmp_path / "a", [[(at(0),), (at(600),)]], "ts timestamp")
    b = files(spark, tmp_path / "b", [[(at(5),), (at(100),)]], "ts timestamp")
    before = spark.conf.get("spark.sql.streaming.multipleWatermarkPolicy")
    got = {}
    for which in ("min", "max"):
        both = st.union_under_policy(st.table_stream(spark, a), st.table_stream(spark, b), "ts", "10 minutes", "10 minutes")
        counts = both.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.unix_seconds("w.start").alias("s"), "n")
        with st.policy(spark, which):
            got[which] = sorted((int(r["s"] - at(0).timestamp()) // 3600, r["n"]) for r in st.appended(counts, st.new_home(spark, which)).collect())
    assert got == {"min": [(0, 2)], "max": [(0, 2), (1, 1)]}
    assert spark.conf.get("spark.sql.streaming.multipleWatermarkPolicy") == before
    with pytest.raises(ValueError), st.policy(spark, "mean"):
        pass


def test_backfill_and_live_add_nothing_twice(spark, tmp_path):
    path = files(spark, tmp_path / "in", [[(i,) for i in range(5, 8)]], "x long")
    home, history = st.new_home(spark, "flow"), spark.range(5).toDF("x")
    run = lambda: sorted(r["x"] for r in st.backfilled(history, st.table_stream(spark, path), home).collect())
    assert run() == list(range(8)) and run() == list(range(8))
    files(spark, tmp_path / "in", [[(8,), (9,)]], "x long")
    assert run() == list(range(10))
    # a history that broke off is loaded anew
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{home}/history/_SUCCESS")
    done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(done, False)
    assert run() == list(range(10))


def test_debounce_over_batches_and_with_a_flush(spark, tmp_path):
    sec = lambda s: (86_400 + s) * 1_000_000
    rows = [(1, sec(0)), (1, sec(100)), (1, sec(299)), (2, sec(50)), (1, sec(301)), (2, sec(60)), (1, sec(400)), (None, sec(5))]
    path = files(spark, tmp_path / "in", [rows[:4], rows[4:]], "key int, at long")
    stream = lambda: st.table_stream(spark, path)
    home = st.new_home(spark, "debounce")
    st.upserted(st.debounced(stream(), "key", "at", 300_000_000), home, ["key", "fired_at"])
    got = sorted((tuple(r)[:4] for r in spark.read.parquet(f"{home}/log").select("key", "fired_at", "requested_at", "coalesced").collect()), key=repr)
    want = [(1, sec(0), sec(0), 1), (1, sec(301), sec(100), 3), (2, sec(50), sec(50), 1), (None, sec(5), sec(5), 1)]
    assert got == sorted(want, key=repr)
    home = st.new_home(spark, "flush")
    st.appended(st.debounced(stream(), "key", "at", 300_000_000, "0 seconds"), home)
    files(spark, tmp_path / "in", [[(9, sec(5000))]], "key int, at long")  # moves the watermark on
    out = st.appended(st.debounced(stream(), "key", "at", 300_000_000, "0 seconds"), home).collect()
    assert sorted((tuple(r) for r in out), key=repr) == sorted([*want, (1, sec(601), sec(400), 1), (2, sec(350), sec(60), 1), (9, sec(5000), sec(5000), 1)], key=repr)
