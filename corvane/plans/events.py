"""Queries over event logs and conversations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.catalog import query
from corvane.sources.tables import table as t

n = lambda: F.count(F.lit(1)).alias("n")


@query("r02_tumbling_window", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def tumbling(s, d):
    return t(s, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(n()).select(F.col("w.start").alias("start"), "event_type", "n")


@query("r03_sliding_window", "SELECT time_bucket(INTERVAL 1 HOUR, ts) - to_hours(h::INT) AS start, count(*)::BIGINT AS n FROM events, range(0, 6) r(h) GROUP BY 1")
def sliding(s, d):
    return t(s, d, "events").groupBy(F.window("ts", "6 hours", "1 hour").alias("w")).agg(n()).select(F.col("w.start").alias("start"), "n")


@query("r04_session_window", "WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), x AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM (SELECT user_id, ts, max(new) AS new, count(*) AS c FROM (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) GROUP BY 1, 2)) SELECT user_id, min(ts) AS start, sum(c)::BIGINT AS n FROM x GROUP BY user_id, sid")
def sessions(s, d):
    out = t(s, d, "events").groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(n())
    return out.select("user_id", F.col("w.start").alias("start"), "n")


@query("w15_session_ids", "WITH g AS (SELECT event_id, user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g")
def session_ids(s, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    fresh = F.when(F.col("ts") <= F.lag("ts").over(w) + F.expr("INTERVAL 2 HOURS"), 0).otherwise(1)
    return t(s, d, "events").withColumn("fresh", fresh).select("event_id", F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("session"))


@query("g14_daily_digest", "WITH c AS (SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, event_type) AS k FROM c), u AS (SELECT ts::DATE AS day, count(*)::BIGINT AS turns, count(DISTINCT user_id)::BIGINT AS sessions FROM events GROUP BY 1) SELECT day, turns, sessions, string_agg(event_type, ',' ORDER BY k) AS top3 FROM r JOIN u USING (day) WHERE k <= 3 GROUP BY day, turns, sessions")
def digest(s, d):
    e = t(s, d, "events").withColumn("day", F.to_date("ts"))
    c = e.groupBy("day", "event_type").agg(n()).withColumn("k", F.row_number().over(W.partitionBy("day").orderBy(F.desc("n"), "event_type"))).where("k <= 3")
    top = c.groupBy("day").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "event_type"))), lambda x: x["event_type"]), ",").alias("top3"))
    return e.groupBy("day").agg(F.count(F.lit(1)).alias("turns"), F.countDistinct("user_id").alias("sessions")).join(top, "day")


@query("g12_half_window_counts", "WITH h AS (SELECT *, CASE WHEN ts >= TIMESTAMP '2024-01-16' THEN 'recent' ELSE 'earlier' END AS half FROM events) SELECT half, event_type AS domain, count(*)::BIGINT AS turns, count(DISTINCT ts::DATE)::BIGINT AS days, min(ts) AS first_ts, max(ts) AS last_ts FROM h GROUP BY 1, 2")
def halves(s, d):
    half = F.when(F.col("ts") >= F.lit("2024-01-16").cast("timestamp"), "recent").otherwise("earlier")
    return t(s, d, "events").groupBy(half.alias("half"), F.col("event_type").alias("domain")).agg(F.count(F.lit(1)).alias("turns"), F.countDistinct(F.to_date("ts")).alias("days"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("c08_domain_links", "WITH h AS (SELECT event_type AS x, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS recent, count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS earlier FROM events GROUP BY 1) SELECT a.x AS driver, b.x AS target, round(least(0.35 + 0.30 * a.recent / greatest(a.earlier, 1), 0.70), 6) AS confidence FROM h a JOIN h b ON a.x <> b.x WHERE a.recent >= 4 AND a.recent > b.recent")
def links(s, d):
    mid = F.lit("2024-01-16").cast("timestamp")
    h = t(s, d, "events").groupBy(F.col("event_type").alias("x")).agg(F.count_if(F.col("ts") >= mid).alias("recent"), F.count_if(F.col("ts") < mid).alias("earlier"))
    a, b = h.select(F.col("x").alias("driver"), F.col("recent").alias("r"), F.col("earlier").alias("e")), h.select(F.col("x").alias("target"), F.col("recent").alias("r2"))
    out = a.join(b, F.expr("driver <> target AND r >= 4 AND r > r2"))
    return out.select("driver", "target", F.round(F.least(0.35 + 0.30 * F.col("r") / F.greatest("e", F.lit(1)), F.lit(0.70)), 6).alias("confidence"))


@query("f46_json_payload", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def payload(s, d):
    return t(s, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("w12_last_user_turn", "WITH m AS (SELECT conv_id, max(turn) FILTER (role = 'user') AS last FROM conversations GROUP BY 1) SELECT c.conv_id, substring(max(text) FILTER (turn = last), 1, 2000) AS user_text, substring(coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'assistant' AND turn > last), ''), 1, 400) AS answer FROM conversations c JOIN m USING (conv_id) WHERE last IS NOT NULL GROUP BY c.conv_id")
def last_turn(s, d):
    c = t(s, d, "conversations").withColumn("last", F.max(F.when(F.col("role") == "user", F.col("turn"))).over(W.partitionBy("conv_id"))).where("last IS NOT NULL")
    after = F.sort_array(F.collect_list(F.when((F.col("role") == "assistant") & (F.col("turn") > F.col("last")), F.struct("turn", "text"))))
    return c.groupBy("conv_id").agg(F.substring(F.max(F.when(F.col("turn") == F.col("last"), F.col("text"))), 1, 2000).alias("user_text"), F.substring(F.array_join(F.transform(after, lambda x: x["text"]), "\n"), 1, 400).alias("answer"))


@query("w14_budgeted_tail", "WITH r AS (SELECT conv_id, turn, length(text) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations), x AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS upto FROM r WHERE k <= 6) SELECT conv_id, turn FROM x WHERE upto <= 4000")
def tail(s, d):
    w = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    r = t(s, d, "conversations").select("conv_id", "turn", F.length("text").alias("c"), F.row_number().over(w).alias("k")).where("k <= 6")
    return r.withColumn("upto", F.sum("c").over(W.partitionBy("conv_id").orderBy("k").rowsBetween(W.unboundedPreceding, 0))).where("upto <= 4000").select("conv_id", "turn")


@query("w24_role_changes", "SELECT conv_id, turn, role, lag(role) OVER w AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn) QUALIFY lag(role) OVER w <> role")
def changes(s, d):
    return t(s, d, "conversations").select("conv_id", "turn", "role", F.lag("role").over(W.partitionBy("conv_id").orderBy("turn")).alias("before")).where("before <> role")


@query("g32_token_totals", "SELECT conv_id, sum(greatest(1, length(text) // 4))::BIGINT AS tokens FROM conversations GROUP BY 1")
def token_totals(s, d):
    return t(s, d, "conversations").groupBy("conv_id").agg(F.sum(F.greatest(F.lit(1), F.floor(F.length("text") / 4))).alias("tokens"))


@query("g15_ledger_summary", "SELECT event_type, count(*)::BIGINT AS n, round(avg(value), 4) AS mean, round(sum(value), 4) AS total FROM events GROUP BY GROUPING SETS ((event_type), ())")
def ledger(s, d):
    return t(s, d, "events").rollup("event_type").agg(n(), F.round(F.avg("value"), 4).alias("mean"), F.round(F.sum("value"), 4).alias("total"))


@query("w23_newest_forty", "SELECT conv_id FROM (SELECT DISTINCT conv_id FROM conversations) ORDER BY conv_id DESC LIMIT 40")
def newest(s, d):
    return t(s, d, "conversations").select("conv_id").distinct().orderBy(F.desc("conv_id")).limit(40)
