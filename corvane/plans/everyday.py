"""Everyday queries: data quality, merges, summaries, ranks, message features, writes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.catalog import query
from corvane.functions import messages as ms
from corvane.functions.text import SECRET_PATTERNS, redacted
from corvane.operators import relational as rel
from corvane.sources.tables import table as t
from corvane.streaming.streams import new_home

n = lambda: F.count(F.lit(1)).alias("n")
quoted = lambda words: ", ".join(f"'{w}'" for w in words)


@query("p07_bounded_vocabulary", "SELECT doc_id, CASE WHEN source IN ('src1', 'src2', 'src3') THEN source ELSE 'general' END AS domain FROM documents")
def bounded(s, d):
    return t(s, d, "documents").select("doc_id", F.when(F.col("source").isin("src1", "src2", "src3"), F.col("source")).otherwise("general").alias("domain"))


@query("p09_compress_gate", "SELECT source, count(*) >= 4 AND sum(len(string_split(text, ' '))) >= 1000 AS compress FROM documents GROUP BY source")
def compress_gate(s, d):
    return t(s, d, "documents").groupBy("source").agg(((F.count(F.lit(1)) >= 4) & (F.sum(F.size(F.split("text", " "))) >= 1000)).alias("compress"))


@query("p13_user_text", r"SELECT conv_id, turn FROM conversations WHERE role = 'user' AND regexp_matches(text, '\S')")
def user_text(s, d):
    return t(s, d, "conversations").where((F.col("role") == "user") & F.col("text").rlike(r"\S")).select("conv_id", "turn")


@query("p17_not_null", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal IS NOT NULL AND c_acctbal >= 0")
def not_null(s, d):
    return t(s, d, "customer").where(F.col("c_acctbal").isNotNull() & (F.col("c_acctbal") >= 0)).select("c_custkey", "c_acctbal")


@query("p18_rescued_cast", "SELECT p_partkey, try_cast(p_name AS INT) AS name_no, p_name IS NOT NULL AND try_cast(p_name AS INT) IS NULL AS rescued FROM part")
def rescued(s, d):
    no = F.col("p_name").try_cast("int")
    return t(s, d, "part").select("p_partkey", no.alias("name_no"), (F.col("p_name").isNotNull() & no.isNull()).alias("rescued"))


@query("p19_fill_drop", "SELECT doc_id, coalesce(lang, 'none') AS lang, coalesce(n_chars, 0) AS n_chars FROM documents WHERE source IS NOT NULL")
def fill_drop(s, d):
    return t(s, d, "documents").select("doc_id", "lang", "source", "n_chars").na.drop(subset=["source"]).na.fill({"lang": "none", "n_chars": 0}).drop("source")


@query("p21_select_except", "SELECT * EXCLUDE (o_orderpriority) REPLACE (round(o_totalprice) AS o_totalprice) FROM orders")
def select_except(s, d):
    return t(s, d, "orders").drop("o_orderpriority").withColumn("o_totalprice", F.round("o_totalprice"))


@query("p22_repeatable_sample", "SELECT o_orderkey FROM orders WHERE md5(o_orderkey::VARCHAR) < '2'")
def hash_sample(s, d):
    return t(s, d, "orders").where(F.md5(F.col("o_orderkey").cast("string")) < "2").select("o_orderkey")


@query("p24_column_patterns", "SELECT round(sum(l_quantity), 2) AS l_quantity, round(sum(l_extendedprice), 2) AS l_extendedprice, round(sum(l_discount), 2) AS l_discount, round(sum(l_tax), 2) AS l_tax FROM lineitem")
def column_patterns(s, d):
    lines = t(s, d, "lineitem")
    return lines.agg(*[F.round(F.sum(f.name), 2).alias(f.name) for f in lines.schema if f.dataType.simpleString() == "double"])


@query("j07_anti_filtered", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def anti_filtered(s, d):
    return t(s, d, "customer").join(t(s, d, "orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("j08_not_exists", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def not_exists(s, d):
    return s.sql("SELECT c_custkey, c_name FROM {c} WHERE NOT EXISTS (SELECT 1 FROM {o} WHERE o_custkey = c_custkey AND o_totalprice > 400000)", c=t(s, d, "customer"), o=t(s, d, "orders"))


@query("j17_feed_watermark", "SELECT e.event_id FROM events e WHERE value > 20 AND NOT EXISTS (SELECT 1 FROM events x WHERE x.event_type = 'error' AND x.user_id = e.user_id AND x.ts::DATE = e.ts::DATE)")
def feed(s, d):
    """Events of days on which their user had no error yet told."""
    ev = t(s, d, "events").withColumn("day", F.to_date("ts"))
    return ev.where("value > 20").join(ev.where("event_type = 'error'").select("user_id", "day").distinct(), ["user_id", "day"], "left_anti").select("event_id")


@query("j18_current_dimension", "WITH c AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) SELECT c_custkey, c_mktsegment, o_orderkey, o_orderstatus FROM customer JOIN c ON c_custkey = o_custkey")
def current_dimension(s, d):
    now = rel.latest(t(s, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return t(s, d, "customer").join(now, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_mktsegment", "o_orderkey", "o_orderstatus")


@query("g06_approx_distinct", "SELECT l_returnflag, count(DISTINCT l_orderkey)::BIGINT AS orders, true AS close FROM lineitem GROUP BY 1")
def approx_distinct(s, d):
    """The exact number, and whether the approximate one is within 3 of its standard errors of 0.02."""
    lines = t(s, d, "lineitem").select("l_returnflag", "l_orderkey")
    # each by itself: together, Spark keeps a sketch for every order that it counts
    exact = lines.distinct().groupBy("l_returnflag").agg(F.count("l_orderkey").alias("orders"))
    near = lines.groupBy(F.col("l_returnflag").alias("flag")).agg(F.approx_count_distinct("l_orderkey", 0.02).alias("near"))
    return exact.join(F.broadcast(near), F.col("l_returnflag").eqNullSafe(F.col("flag"))).select("l_returnflag", "orders", (F.abs(F.col("orders") - F.col("near")) <= 0.06 * F.col("orders")).alias("close"))


@query("g08_sorted_sets", "SELECT o_orderstatus, array_to_string(list_sort(list(DISTINCT o_orderpriority)), '|') AS priorities, count(*) FILTER (WHERE o_totalprice > 300000)::BIGINT AS large FROM orders GROUP BY 1")
def sorted_sets(s, d):
    return t(s, d, "orders").groupBy("o_orderstatus").agg(F.array_join(F.sort_array(F.collect_set("o_orderpriority")), "|").alias("priorities"), F.count_if(F.col("o_totalprice") > 300000).alias("large"))


@query("g10_group_by_all", "SELECT o_orderstatus, o_orderpriority, count(*)::BIGINT AS n FROM orders GROUP BY ALL")
def group_by_all(s, d):
    return s.sql("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {o} GROUP BY ALL", o=t(s, d, "orders"))


@query("g11_empty_guard", "SELECT count(*)::BIGINT AS n, coalesce(sum(o_totalprice), 0) AS total, max(o_totalprice) IS NULL AS none FROM orders WHERE o_totalprice < 0")
def empty_guard(s, d):
    return t(s, d, "orders").where("o_totalprice < 0").agg(n(), F.coalesce(F.sum("o_totalprice"), F.lit(0.0)).alias("total"), F.max("o_totalprice").isNull().alias("none"))


@query("g13_turn_ratios", f"WITH x AS (SELECT role, text, {{turn}} AS kind FROM conversations) SELECT role, count(*)::BIGINT AS turns, round(avg(length(text)), 1) AS avg_len, round(avg((kind = 'interrogative')::INT), 3) AS asks, round(avg((kind = 'dispatch')::INT), 3) AS orders FROM x GROUP BY role".replace("{turn}", (TURN := f"CASE WHEN len(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+')) = 0 THEN 'neutral' WHEN contains(text, '?') OR regexp_extract(lower(text), '[\\p{{L}}\\p{{N}}]+') IN ({quoted(ms.INTERROGATIVE_STARTS)}) THEN 'interrogative' WHEN regexp_extract(lower(text), '[\\p{{L}}\\p{{N}}]+') IN ({quoted(ms.DISPATCH_TOKENS)}) OR len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) <= 2 THEN 'dispatch' ELSE 'neutral' END")))
def turn_ratios(s, d):
    kind = ms.turn_class(F.col("text"))
    return t(s, d, "conversations").groupBy("role").agg(n().alias("turns"), F.round(F.avg(F.length("text")), 1).alias("avg_len"), F.round(F.avg((kind == "interrogative").cast("int")), 3).alias("asks"), F.round(F.avg((kind == "dispatch").cast("int")), 3).alias("orders"))


@query("g16_cost_summary", "WITH p(role, fresh, fixed) AS (VALUES ('user', 0.25, 0.0), ('assistant', 1.25, 1.0)), c AS (SELECT conv_id, coalesce(greatest(1, length(text) // 4) * fresh + fixed, 0) AS cost FROM conversations LEFT JOIN p USING (role)) SELECT conv_id, count(*)::BIGINT AS calls, round(sum(cost), 4) AS total, round(avg(cost), 4) AS per_call FROM c GROUP BY conv_id")
def cost_summary(s, d):
    price = F.create_map(*[F.lit(x) for x in ("user", 0.25, "assistant", 1.25)])
    fixed = F.create_map(*[F.lit(x) for x in ("user", 0.0, "assistant", 1.0)])
    tokens = F.greatest(F.lit(1), F.floor(F.length("text") / 4))
    cost = F.coalesce(tokens * F.try_element_at(price, F.col("role")) + F.try_element_at(fixed, F.col("role")), F.lit(0.0))
    return t(s, d, "conversations").groupBy("conv_id").agg(n().alias("calls"), F.round(F.sum(cost), 4).alias("total"), F.round(F.avg(cost), 4).alias("per_call"))


@query("g18_eval_summary", "WITH x AS (SELECT lang, (n_chars > 200)::INT = quality AS ok FROM documents JOIN labels USING (doc_id)) SELECT coalesce(lang, 'all') AS category, count(*)::BIGINT AS total, count(*) FILTER (WHERE ok)::BIGINT AS correct, round(avg(ok::INT), 4) AS accuracy FROM x GROUP BY ROLLUP (lang)")
def eval_summary(s, d):
    x = t(s, d, "documents").join(t(s, d, "labels"), "doc_id").select("lang", ((F.col("n_chars") > 200).cast("int") == F.col("quality")).alias("ok"))
    return x.rollup("lang").agg(n().alias("total"), F.count_if("ok").alias("correct"), F.round(F.avg(F.col("ok").cast("int")), 4).alias("accuracy")).select(F.coalesce("lang", F.lit("all")).alias("category"), "total", "correct", "accuracy")


SQL_CORRECTION = ms.CORRECTION.replace("'", "''")


@query("g21_correction_rate", f"WITH u AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS back, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations WHERE role = 'user'), r AS (SELECT *, least(total, 5) AS k FROM u WHERE back <= 5) SELECT conv_id, CASE WHEN max(k) < 2 THEN 0 ELSE round(count(*) FILTER (WHERE back < k AND regexp_matches(text, '{SQL_CORRECTION}')) / (max(k) - 1), 4) END AS rate FROM r GROUP BY conv_id")
def correction_rate(s, d):
    own = W.partitionBy("conv_id")
    u = t(s, d, "conversations").where("role = 'user'").withColumn("back", F.row_number().over(own.orderBy(F.desc("turn"), F.desc("text")))).withColumn("k", F.least(F.count(F.lit(1)).over(own), F.lit(5))).where("back <= 5")
    hits = F.count_if((F.col("back") < F.col("k")) & ms.corrects(F.col("text")))
    return u.groupBy("conv_id").agg(F.when(F.max("k") < 2, 0.0).otherwise(F.round(F.try_divide(hits, F.max("k") - 1), 4)).alias("rate"))


@query("g31_most_common", "SELECT p_type, count(*)::BIGINT AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 3")
def most_common(s, d):
    return t(s, d, "part").groupBy("p_type").agg(n()).orderBy(F.desc("n"), "p_type").limit(3)


# How a user's (or a kind's) events do: the mean of values moves by 0.3 towards each next one, errors left out of it but not of the count.
_EMA = """r AS (SELECT {0} AS key, value, row_number() OVER w AS i, count(*) OVER (PARTITION BY {0}) AS k FROM events WHERE value IS NOT NULL{1} WINDOW w AS (PARTITION BY {0} ORDER BY ts, event_id)),
h AS (SELECT key, round(sum(value * pow(0.7, k - i) * CASE WHEN i = 1 THEN 1 ELSE 0.3 END), 5) AS ema FROM r GROUP BY 1)"""


def _ema(events, key):
    return rel.exponential_mean(events, key, "value", ["ts", "event_id"], 0.3).withColumn("ema", F.round("ema", 5))


@query("g34_process_health", f"WITH {_EMA.format('user_id', chr(32) + 'AND event_type <> ' + chr(39) + 'error' + chr(39))} SELECT user_id, count(*)::BIGINT AS calls, round(avg((event_type = 'error')::INT), 4) AS error_rate, any_value(ema) AS ema FROM events LEFT JOIN h ON key = user_id GROUP BY user_id")
def health(s, d):
    events = t(s, d, "events")
    calls = events.groupBy("user_id").agg(n().alias("calls"), F.round(F.avg((F.col("event_type") == "error").cast("int")), 4).alias("error_rate"))
    return calls.join(_ema(events.where("event_type <> 'error'"), "user_id"), "user_id", "left")


@query("f33_pool_score", f"WITH {_EMA.format('event_type', '')} SELECT key AS event_type, round(0.5 * ema + 0.5 * length(key) + 10 * (key = 'error')::INT, 4) AS score FROM h")
def pool_score(s, d):
    return _ema(t(s, d, "events"), "event_type").select("event_type", F.round(0.5 * F.col("ema") + 0.5 * F.length("event_type") + 10 * (F.col("event_type") == "error").cast("int"), 4).alias("score"))


@query("g36_run_history", "SELECT user_id, min(CASE WHEN event_type = 'view' THEN ts END) AS first_view, arg_max(event_type, ts) AS state FROM events GROUP BY user_id")
def run_history(s, d):
    return t(s, d, "events").groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "view", F.col("ts"))).alias("first_view"), F.max_by("event_type", "ts").alias("state"))


@query("g37_cost_attribution", "WITH w AS (SELECT * FROM lineitem WHERE l_shipdate > (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 365 DAY) SELECT n_name, count(*)::BIGINT AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS cost FROM w JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def cost_attribution(s, d):
    lines = t(s, d, "lineitem")
    recent = lines.crossJoin(lines.agg(F.max("l_shipdate").alias("newest"))).where("l_shipdate > newest - INTERVAL 365 DAYS")  # one row beside all
    out = recent.join(t(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return out.groupBy("n_name").agg(n(), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("cost"))


@query("g38_audit_filter", "SELECT event_id, (props->>'k')::INT AS k FROM events WHERE (props->>'k')::INT > 50 AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'")
def audit_filter(s, d):
    k = F.from_json("props", "k int")["k"]
    return t(s, d, "events").where("ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'").select("event_id", k.alias("k")).where("k > 50")


@query("w03_number_or_rank", "SELECT o_orderkey, row_number() OVER w AS nth, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS tier FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey)")
def number_or_rank(s, d):
    by = W.partitionBy("o_custkey")
    return t(s, d, "orders").select("o_orderkey", F.row_number().over(by.orderBy("o_orderpriority", "o_orderkey")).cast("long").alias("nth"), F.dense_rank().over(by.orderBy("o_orderpriority")).cast("long").alias("tier"))


@query("w09_streaks", "WITH x AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events), g AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day)::INT AS a FROM x) SELECT user_id, min(day) AS first_day, count(*)::BIGINT AS days FROM g GROUP BY user_id, a HAVING count(*) >= 3")
def streaks(s, d):
    return rel.islands(t(s, d, "events").withColumn("day", F.to_date("ts")), "user_id", "day").where("days >= 3").select("user_id", "first_day", "days")


@query("w11_state_chain", "WITH x AS (SELECT user_id, event_type, ts, event_id, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, event_id, before, event_type AS after FROM x WHERE before <> event_type")
def state_chain(s, d):
    before = F.lag("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return t(s, d, "events").withColumn("before", before).where("before <> event_type").select("user_id", "event_id", "before", F.col("event_type").alias("after"))


@query("w13_first_snippets", "WITH k AS (SELECT conv_id, turn, text, lower(substring(text, 1, 40)) AS key FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id, lower(substring(text, 1, 40)) ORDER BY turn, text) = 1) SELECT conv_id, turn, key FROM k QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) <= 4")
def first_snippets(s, d):
    k = t(s, d, "conversations").where("role = 'user'").withColumn("key", F.lower(F.substring("text", 1, 40)))
    k = rel.latest(k, ["conv_id", "key"], [F.asc("turn"), F.asc("text")])
    return k.withColumn("nth", F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "text"))).where("nth <= 4").select("conv_id", "turn", "key")


@query("w16_compaction_split", "WITH r AS (SELECT conv_id, role, sum((role <> 'system')::INT) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS UNBOUNDED PRECEDING) = 0 AS lead, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS back FROM conversations) SELECT conv_id, count(*) FILTER (WHERE lead)::BIGINT AS lead_n, count(*) FILTER (WHERE NOT lead AND back > 6)::BIGINT AS window_n, count(*) FILTER (WHERE NOT lead AND back <= 6)::BIGINT AS recent_n FROM r GROUP BY conv_id")
def compaction_split(s, d):
    by = W.partitionBy("conv_id")
    lead = F.sum((F.col("role") != "system").cast("int")).over(by.orderBy("turn", "text").rowsBetween(W.unboundedPreceding, 0)) == 0
    r = t(s, d, "conversations").withColumn("lead", lead).withColumn("back", F.row_number().over(by.orderBy(F.desc("turn"), F.desc("text"))))
    return r.groupBy("conv_id").agg(F.count_if("lead").alias("lead_n"), F.count_if(~F.col("lead") & (F.col("back") > 6)).alias("window_n"), F.count_if(~F.col("lead") & (F.col("back") <= 6)).alias("recent_n"))


@query("w19_latest_state", "SELECT event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_state(s, d):
    newest = F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("x")
    return t(s, d, "events").groupBy("event_type").agg(newest).select("event_type", "x.event_id", "x.value")


@query("t07_best_insight", "SELECT user_id, event_id, value FROM events WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, ts DESC, event_id DESC) = 1")
def best_insight(s, d):
    best = F.max_by(F.struct("event_id", "value"), F.struct("value", "ts", "event_id")).alias("x")
    return t(s, d, "events").where("value IS NOT NULL").groupBy("user_id").agg(best).select("user_id", "x.event_id", "x.value")


@query("t10_bucket_top_8", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'error') DESC, ts DESC, event_id) <= 8")
def bucket_top(s, d):
    order = W.partitionBy("user_id").orderBy(F.desc(F.col("event_type") == "error"), F.desc("ts"), "event_id")
    return t(s, d, "events").withColumn("nth", F.row_number().over(order)).where("nth <= 8").select("user_id", "event_id")


@query("t11_rounded_rank", "SELECT event_id, round(value, 1) AS score FROM events ORDER BY round(value, 1) DESC NULLS LAST, ts DESC LIMIT 10")
def rounded_rank(s, d):
    return t(s, d, "events").select("event_id", "ts", F.round("value", 1).alias("score")).orderBy(F.desc_nulls_last("score"), F.desc("ts")).limit(10).select("event_id", "score")


@query("t15_missing_last", "SELECT doc_id FROM documents ORDER BY coalesce(lang, '9999'), doc_id DESC LIMIT 50")
def missing_last(s, d):
    return t(s, d, "documents").orderBy(F.coalesce("lang", F.lit("9999")), F.desc("doc_id")).limit(50).select("doc_id")


@query("u03_keyed_merge", "WITH b AS (SELECT sha256(concat_ws('|', event_type, user_id::VARCHAR, strftime(ts, '%Y-%m-%d'))) AS key, event_id, value FROM events) SELECT key, event_id, value FROM b QUALIFY row_number() OVER (PARTITION BY key ORDER BY event_id DESC) = 1")
def keyed_merge(s, d):
    key = F.sha2(F.concat_ws("|", "event_type", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")), 256)
    return t(s, d, "events").groupBy(key.alias("key")).agg(F.max(F.struct("event_id", "value")).alias("x")).select("key", "x.event_id", "x.value")


@query("u04_catalog_diff", "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45")
def catalog_diff(s, d):
    return t(s, d, "part").select("p_partkey").exceptAll(t(s, d, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45").select("l_partkey").distinct())


@query("u06_append_flow", "SELECT 'customer' AS origin, c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_name, s_acctbal FROM supplier UNION ALL SELECT 'nation', n_name, NULL FROM nation")
def append_flow(s, d):
    parts = [t(s, d, "customer").selectExpr("'customer' AS origin", "c_name AS name", "c_acctbal AS balance"), t(s, d, "supplier").selectExpr("'supplier' AS origin", "s_name AS name", "s_acctbal AS balance"), t(s, d, "nation").selectExpr("'nation' AS origin", "n_name AS name")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2], allowMissingColumns=True)


@query("u07_drop_duplicates", "SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def drop_duplicates(s, d):
    return t(s, d, "orders").dropDuplicates(["o_custkey", "o_orderstatus"]).select("o_custkey", "o_orderstatus")


@query("f10_secrets_redacted", "SELECT doc_id, md5(x) AS redacted_md5 FROM (SELECT doc_id, " + "".join("regexp_replace(" for _ in SECRET_PATTERNS) + "text" + "".join(f", '{p}', '[REDACTED]', 'g')" for p in SECRET_PATTERNS) + " AS x FROM documents)")
def secrets(s, d):
    return t(s, d, "documents").select("doc_id", F.md5(redacted(F.col("text"))).alias("redacted_md5"))


DOMAIN_HITS = {k: " + ".join(f"contains(lower(coalesce(text, '')), '{w}')::INT" for w in words) for k, words in ms.DOMAIN_KEYWORDS.items()}


@query("f12_domain_guess", "SELECT doc_id, CASE WHEN greatest(a0, a1, a2) = 0 THEN 'general' " + " ".join(f"WHEN a{i} = greatest(a0, a1, a2) THEN '{k}'" for i, k in enumerate(DOMAIN_HITS)) + " END AS domain FROM (SELECT doc_id, " + ", ".join(f"{x} AS a{i}" for i, x in enumerate(DOMAIN_HITS.values())) + " FROM documents)")
def domain(s, d):
    return t(s, d, "documents").select("doc_id", ms.domain_guess(F.col("text")).alias("domain"))


@query("f13_corrections", f"SELECT conv_id, turn, coalesce(regexp_matches(text, '{SQL_CORRECTION}'), false) AS corrects FROM conversations")
def corrections(s, d):
    return t(s, d, "conversations").select("conv_id", "turn", ms.corrects(F.col("text")).alias("corrects"))


@query("f14_turn_class", f"SELECT conv_id, turn, {TURN} AS kind FROM conversations")
def turn_kind(s, d):
    return t(s, d, "conversations").select("conv_id", "turn", ms.turn_class(F.col("text")).alias("kind"))


@query("f34_ordered_rules", "SELECT p_partkey, CASE WHEN contains(lower(p_type), 'econ') THEN 'value' WHEN contains(lower(p_type), 'prom') THEN 'offer' WHEN contains(lower(p_name), 'ring') THEN 'ring' ELSE 'other' END AS category FROM part")
def ordered_rules(s, d):
    has = lambda c, x: F.contains(F.lower(c), F.lit(x))
    return t(s, d, "part").select("p_partkey", F.when(has("p_type", "econ"), "value").when(has("p_type", "prom"), "offer").when(has("p_name", "ring"), "ring").otherwise("other").alias("category"))


@query("f39_truncate_slug", r"SELECT doc_id, CASE WHEN length(text) > 80 THEN concat(text[:80], ' [+', length(text) - 80, ' chars]') ELSE text END AS head, trim(regexp_replace(lower(substring(text, 1, 40)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents")
def truncate_slug(s, d):
    return t(s, d, "documents").select("doc_id", ms.truncated(F.col("text"), 80).alias("head"), ms.slug(F.substring("text", 1, 40)).alias("slug"))


@query("f40_scorers", r"WITH x AS (SELECT a.doc_id, lower(trim(regexp_replace(a.text, '[ \t\n\x0b\f\r]+', ' ', 'g'))) AS p, lower(trim(regexp_replace(b.text, '[ \t\n\x0b\f\r]+', ' ', 'g'))) AS r FROM documents a JOIN benchmark b ON a.doc_id % (SELECT count(*) FROM benchmark) = b.item_id) SELECT doc_id, r <> '' AND p = r AS exact, r <> '' AND contains(p, r) AS inside FROM x")
def scorers(s, d):
    items = t(s, d, "benchmark").select("item_id", ms.plain(F.col("text")).alias("r"))
    docs = t(s, d, "documents").select("doc_id", ms.plain(F.col("text")).alias("p")).where("p IS NOT NULL")
    x = docs.crossJoin(items.agg(n())).join(items, F.col("doc_id") % F.col("n") == F.col("item_id"))  # one row beside all
    return x.select("doc_id", ((F.col("r") != "") & (F.col("p") == F.col("r"))).alias("exact"), ((F.col("r") != "") & F.contains("p", "r")).alias("inside"))


@query("f49_daily_counts", "SELECT event_type, string_agg(day || '=' || n, ',' ORDER BY day) AS daily FROM (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def daily_counts(s, d):
    days = t(s, d, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(n())
    daily = days.groupBy("event_type").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("day", "n")))).alias("m"))
    return daily.select("event_type", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("daily"))


@query("f51_local_time", "SELECT event_id, hour(ts + INTERVAL 330 MINUTE)::INT AS hour, isodow(ts + INTERVAL 330 MINUTE)::INT AS weekday, (ts + INTERVAL 330 MINUTE)::DATE AS day FROM events")
def local_time(s, d):
    local = F.col("ts").cast("timestamp_ntz") + F.expr("INTERVAL 330 MINUTES")
    return t(s, d, "events").select("event_id", F.hour(local).alias("hour"), (F.weekday(local) + 1).alias("weekday"), F.to_date(local).alias("day"))


@query("f55_masks", "SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN '***' ELSE c_name END AS name, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS balance FROM customer WHERE c_nationkey < 20")
def masks(s, d):
    name = F.when(F.col("c_mktsegment") == "MACHINERY", "***").otherwise(F.col("c_name"))
    return t(s, d, "customer").where("c_nationkey < 20").select("c_custkey", name.alias("name"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"))


@query("f57_expressions", "SELECT o_orderkey, concat(o_orderstatus, '-', o_orderpriority) AS label, coalesce(nullif('', ''), o_orderstatus) AS kept, '' || o_orderstatus AS empty_first, if(o_totalprice > 200000, 'high', 'low') AS level, greatest(o_totalprice, 100000) AS floor_price FROM orders")
def expressions(s, d):
    status = F.col("o_orderstatus")
    return t(s, d, "orders").select("o_orderkey", F.concat(status, F.lit("-"), "o_orderpriority").alias("label"), F.coalesce(F.nullif(F.lit(""), F.lit("")), status).alias("kept"), F.concat(F.lit(""), status).alias("empty_first"), F.when(F.col("o_totalprice") > 200000, "high").otherwise("low").alias("level"), F.greatest("o_totalprice", F.lit(100000.0)).alias("floor_price"))


@query("f58_flatten", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS place, role, length(text) AS chars FROM conversations")
def flatten(s, d):
    nested = t(s, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    flat = nested.select("conv_id", F.posexplode("turns").alias("place", "x"))
    return flat.select("conv_id", F.col("place").cast("long").alias("place"), "x.role", F.length("x.text").cast("long").alias("chars"))


@query("r24_high_watermark", "SELECT event_id, value FROM events WHERE ts > TIMESTAMP '2024-01-10' AND ts <= (SELECT max(ts) FROM events WHERE ts < TIMESTAMP '2024-01-25')")
def high_watermark(s, d):
    ev = t(s, d, "events")
    high = ev.where("ts < TIMESTAMP '2024-01-25'").agg(F.max("ts").alias("high"))
    return ev.where("ts > TIMESTAMP '2024-01-10'").crossJoin(high).where("ts <= high").select("event_id", "value")  # one row beside all


@query("k10_partitioned_write", "SELECT event_type, count(*)::BIGINT AS n FROM events WHERE event_type <> 'error' GROUP BY 1")
def partitioned_write(s, d):
    home = new_home(s, "partitioned")
    t(s, d, "events").repartition("event_type", F.pmod(F.xxhash64("event_id"), F.lit(16))).write.partitionBy("event_type").parquet(f"{home}/rows")
    return s.read.parquet(f"{home}/rows").where("event_type <> 'error'").groupBy("event_type").agg(n())


@query("k14_replace_where", "SELECT event_type, count(*)::BIGINT AS n, count(*) FILTER (WHERE value IS NULL)::BIGINT AS nulls FROM (SELECT event_type, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value FROM events) GROUP BY 1")
def replace_where(s, d):
    home, ev = new_home(s, "replaced"), t(s, d, "events").select("event_id", "value", "event_type")
    ev.write.partitionBy("event_type").parquet(f"{home}/rows")
    fixed = ev.where("event_type = 'error'").withColumn("value", F.lit(None).cast("double"))
    fixed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_type").parquet(f"{home}/rows")
    return s.read.parquet(f"{home}/rows").groupBy("event_type").agg(n(), F.count_if(F.col("value").isNull()).alias("nulls"))


@query("x10_grouped_udaf", "SELECT l_returnflag, round(exp(avg(ln(l_extendedprice))), 2) AS typical FROM lineitem GROUP BY 1")
def grouped_udaf(s, d):
    """A pandas aggregate over partial sums of each part of a group, so no group is gathered."""

    @F.pandas_udf("double")
    def mean(total: pd.Series, rows: pd.Series) -> float:
        return float(total.sum() / rows.sum())

    parts = t(s, d, "lineitem").groupBy("l_returnflag", F.spark_partition_id().alias("part")).agg(F.sum(F.ln("l_extendedprice")).alias("total"), n())
    return parts.groupBy("l_returnflag").agg(mean("total", "n").alias("m")).select("l_returnflag", F.round(F.exp("m"), 2).alias("typical"))
