"""Queries that run as Structured Streaming over the event files until all are read."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.catalog import query
from corvane.streaming import streams as st


def events(s, d, *columns):
    """The event stream; times without zone become instants, as watermarks need them."""
    return st.table_stream(s, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select(*columns)


@query("r01_watermarked_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 HOUR, min(ts)) + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 2 HOUR FROM events)")
def watermarked(s, d):
    out = st.windowed_counts(events(s, d, "ts", "event_type"), "ts", "1 hour", "2 hours", ["event_type"])
    return st.appended(out, st.new_home(s, "windows")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("r05_stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(s, d):
    return st.appended(st.first_of_each(events(s, d, "user_id", "event_type"), ["user_id", "event_type"]), st.new_home(s, "dedup"))


@query("r06_stream_interval_join", "SELECT a.event_id AS click_id, b.event_id AS error_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'click' AND b.event_type = 'error'")
def stream_join(s, d):
    rows = events(s, d, "event_id", "user_id", "ts", "event_type")
    clicks = rows.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), F.col("user_id").alias("user"), F.col("ts").alias("clicked"))
    errors = rows.where("event_type = 'error'").select(F.col("event_id").alias("error_id"), "user_id", "ts")
    out = st.followed_by(clicks, errors, F.col("user") == F.col("user_id"), "clicked", "ts", "1 HOUR", "2 hours")
    return st.appended(out.select("click_id", "error_id"), st.new_home(s, "join"))


@query("r07_stream_static_join", "SELECT event_id, c_mktsegment FROM events JOIN customer ON user_id = c_custkey")
def stream_static(s, d):
    customers = s.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_mktsegment")
    out = events(s, d, "event_id", "user_id").join(customers, F.col("user_id") == F.col("c_custkey")).select("event_id", "c_mktsegment")
    return st.appended(out, st.new_home(s, "static"))


@query("r10_complete_mode", "SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY 1")
def complete_mode(s, d):
    return st.upserted(events(s, d, "event_type").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), st.new_home(s, "complete"), ["event_type"], "complete")


@query("r12_running_profile", "SELECT user_id, count(*)::BIGINT AS n, round(sum(value), 2) AS total, max(ts) AS last_ts FROM events GROUP BY 1")
def profile(s, d):
    out = st.upserted(st.running_profile(events(s, d, "user_id", "value", "ts"), "user_id", "value", "ts"), st.new_home(s, "profile"), ["user_id"])
    return out.withColumn("total", F.round("total", 2)).withColumn("last_ts", F.col("last_ts").cast("timestamp_ntz"))


@query("r13_upsert_log", "SELECT user_id, count(*)::BIGINT AS n, max(event_id) AS newest FROM events GROUP BY 1")
def upsert_log(s, d):
    totals = events(s, d, "user_id", "event_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("newest"))
    return st.upserted(totals, st.new_home(s, "upsert"), ["user_id"])


_BOTH = """WITH a AS (SELECT ts FROM events WHERE event_type = 'error'), b AS (SELECT ts FROM events WHERE event_type <> 'error'),
wm AS (SELECT {0}((SELECT date_trunc('millisecond', max(ts)) - INTERVAL 5 DAY FROM a), (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 2 HOUR FROM b)) AS w)
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*)::BIGINT AS n FROM (SELECT ts FROM a UNION ALL SELECT ts FROM b) GROUP BY 1 HAVING time_bucket(INTERVAL 1 HOUR, min(ts)) + INTERVAL 1 HOUR <= (SELECT w FROM wm)"""


def _under(s, d, which):
    rows = events(s, d, "ts", "event_type")
    both = st.union_under_policy(rows.where("event_type = 'error'").select("ts"), rows.where("event_type <> 'error'").select("ts"), "ts", "5 days", "2 hours")
    counts = both.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")
    with st.policy(s, which):
        return st.appended(counts, st.new_home(s, f"policy-{which}")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("r08_lowest_watermark", _BOTH.format("least"))
def lowest_watermark(s, d):
    return _under(s, d, "min")


@query("r08_highest_watermark", _BOTH.format("greatest"))
def highest_watermark(s, d):
    return _under(s, d, "max")


@query("s23_backfill_and_live", "SELECT event_id, user_id, value FROM events")
def backfill_and_live(s, d):
    cut, home = "2024-01-20", st.new_home(s, "backfill")
    history = s.read.parquet(f"{d}/events.parquet").where(F.col("ts") < cut).select("event_id", "user_id", "value")
    live = lambda: events(s, d, "event_id", "user_id", "value", "ts").where(F.col("ts") >= cut).drop("ts")
    st.backfilled(history, live(), home)
    return st.backfilled(history, live(), home)  # a second run adds nothing


@query("w22_debounced_stream", """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t FROM events), r AS MATERIALIZED (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) AS i FROM e),
p(user_id, i, last, first, n, fired, requested, coalesced) AS (SELECT user_id, 1::BIGINT, t, NULL::BIGINT, 0::BIGINT, t, t, 1::BIGINT FROM r WHERE i = 1
 UNION ALL SELECT r.user_id, r.i, CASE WHEN r.t - last >= 86400000000 THEN r.t ELSE last END, CASE WHEN r.t - last >= 86400000000 THEN NULL ELSE coalesce(first, r.t) END, CASE WHEN r.t - last >= 86400000000 THEN 0 ELSE n + 1 END,
 CASE WHEN r.t - last >= 86400000000 THEN r.t END, coalesce(first, r.t), n + 1 FROM p JOIN r ON r.user_id = p.user_id AND r.i = p.i + 1)
SELECT user_id, fired AS fired_at, requested AS requested_at, coalesced FROM p WHERE fired IS NOT NULL""")
def debounced_stream(s, d):
    rows = events(s, d, "user_id", F.unix_micros("ts").alias("at"))
    home = st.new_home(s, "debounced")
    st.upserted(st.debounced(rows, "user_id", "at", 86_400_000_000), home, ["user_id", "fired_at"])
    return s.read.parquet(f"{home}/log").select("user_id", "fired_at", "requested_at", "coalesced")
