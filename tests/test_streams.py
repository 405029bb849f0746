"""Streams against the same batch work: late rows, several batches, outer joins, retried batches, state across runs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corvane.streaming import streams as st

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "id long, k string, v double, ts timestamp"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


@pytest.fixture
def feed(spark, tmp_path):
    """add(rows) writes one more file; stream(**how) reads all as a stream."""

    class Feed:
        path = str(tmp_path / "in")

        def add(self, rows):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

        def stream(self, **how):
            return st.table_stream(spark, self.path, **how)

    return Feed()


def test_late_rows_are_dropped_once_their_window_is_out(spark, feed, tmp_path):
    home = str(tmp_path / "q")
    feed.add([(1, "a", 1.0, at(1)), (2, "a", 1.0, at(200))])
    counts = lambda: st.windowed_counts(feed.stream(), "ts", "10 minutes", "30 minutes", ["k"])
    assert [(r.start, r.n) for r in st.appended(counts(), home).collect()] == [(at(0), 1)]
    feed.add([(3, "a", 1.0, at(2)), (4, "a", 1.0, at(205)), (5, "a", 1.0, at(400))])
    assert sorted((r.start, r.n) for r in st.appended(counts(), home).collect()) == [(at(0), 1), (at(200), 2)]


def test_upsert_log_goes_on_over_batches_and_runs(spark, feed, tmp_path):
    home = str(tmp_path / "q")
    feed.add([(1, "a", 1.0, at(1)), (2, None, 2.0, at(2))])
    feed.add([(3, "a", None, None)])
    profile = lambda: st.running_profile(feed.stream(files_per_batch=1), "k", "v", "ts")
    seen = {r.k: (r.n, r.total, r.last_ts) for r in st.upserted(profile(), home, ["k"]).collect()}
    assert seen == {"a": (2, 1.0, at(1)), None: (1, 2.0, at(2))}
    feed.add([(4, "a", 5.0, at(9)), (5, "b", None, at(3))])
    seen = {r.k: (r.n, r.total, r.last_ts) for r in st.upserted(profile(), home, ["k"]).collect()}
    assert seen == {"a": (3, 6.0, at(9)), None: (1, 2.0, at(2)), "b": (1, 0.0, at(3))}


def test_left_outer_gives_rows_without_partner_later(spark, feed, tmp_path):
    home = str(tmp_path / "q")
    feed.add([(1, "a", 1.0, at(0)), (2, "a", 2.0, at(5)), (3, "b", 1.0, at(0)), (4, "z", 1.0, at(500)), (5, "z", 2.0, at(500))])

    def joined():
        rows = feed.stream()
        first = rows.where("v = 1").select(F.col("id").alias("first"), F.col("k").alias("fk"), F.col("ts").alias("fts"))
        then = rows.where("v = 2").select(F.col("id").alias("then"), "k", "ts")
        return st.followed_by(first, then, F.col("fk") == F.col("k"), "fts", "ts", "10 MINUTES", "20 minutes", "leftOuter").select("first", "then")

    got = sorted((r["first"], r["then"]) for r in st.appended(joined(), home).collect())
    assert got == [(1, 2), (3, None), (4, 5)]


def test_duplicates_within_watermark(spark, feed, tmp_path):
    feed.add([(1, "a", 1.0, at(0)), (1, "a", 1.0, at(1)), (2, "b", 1.0, at(3)), (None, None, None, at(4)), (None, None, None, at(5))])
    out = st.appended(st.first_of_each(feed.stream(), ["id"], "ts", "1 hour"), str(tmp_path / "q"))
    assert sorted(str(r.id) for r in out.collect()) == ["1", "2", "None"]
