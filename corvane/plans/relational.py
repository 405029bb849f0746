"""Queries of the relational family over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.catalog import query
from corvane.operators import relational as rel
from corvane.sources.tables import table as t

n = lambda: F.count(F.lit(1)).alias("n")


@query("p01_project_filter_case", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 40 THEN 'big' WHEN l_quantity >= 20 THEN 'mid' ELSE 'small' END AS size, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'")
def project(s, d):
    size = F.when(F.col("l_quantity") >= 40, "big").when(F.col("l_quantity") >= 20, "mid").otherwise("small")
    return t(s, d, "lineitem").where("l_shipdate < TIMESTAMP '1998-01-01'").select("l_orderkey", "l_linenumber", size.alias("size"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))


@query("p03_filter_tree", "SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND (n_chars > 2000 OR source IN ('src1', 'src2')) AND source NOT IN ('src9')")
def filter_tree(s, d):
    tree = {"$and": [{"lang": "en"}, {"$or": [{"n_chars": {"$gt": 2000}}, {"source": {"$in": ["src1", "src2"]}}]}, {"source": {"$nin": ["src9"]}}]}
    return t(s, d, "documents").where(rel.where_tree(tree)).select("doc_id", "lang", "source")


@query("p05_ttl_filter", "SELECT doc_id FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Permanent' WHEN 1 THEN '2020-01-01T00:00' WHEN 2 THEN 'soon' ELSE '2999-12-31' END AS e FROM documents) WHERE try_cast(substring(e, 1, 10) AS DATE) IS NULL OR try_cast(substring(e, 1, 10) AS DATE) >= DATE '2024-06-01'")
def ttl(s, d):
    e = F.expr("CASE doc_id % 4 WHEN 0 THEN 'Permanent' WHEN 1 THEN '2020-01-01T00:00' WHEN 2 THEN 'soon' ELSE '2999-12-31' END")
    day = F.try_to_date(F.substring(e, 1, 10))
    return t(s, d, "documents").where(day.isNull() | (day >= F.lit("2024-06-01").cast("date"))).select("doc_id")


@query("p06_window_filter", "SELECT count(*)::BIGINT AS n FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY")
def since(s, d):
    return t(s, d, "events").where("ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAYS").agg(n())


@query("p08_query_gate", r"SELECT item_id, NOT (len(string_split(text, ' ')) > 30 OR regexp_matches(text, '[_/{}()=]') OR regexp_matches(text, '\b[A-Z]{2,}[a-z]?\b')) AS expand FROM benchmark")
def gate(s, d):
    x = F.col("text")
    return t(s, d, "benchmark").select("item_id", (~((F.size(F.split(x, " ")) > 30) | x.rlike(r"[_/{}()=]") | x.rlike(r"\b[A-Z]{2,}[a-z]?\b"))).alias("expand"))


@query("p20_expect_drop", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 AND o_orderstatus IN ('O', 'F')")
def expect_drop(s, d):
    rules = {"price": F.col("o_totalprice") > 1000, "status": F.col("o_orderstatus").isin("O", "F")}
    return rel.expect(t(s, d, "orders"), rules).select("o_orderkey", "o_totalprice")


@query("p23_expect_tag", "SELECT o_orderkey, concat_ws(',', CASE WHEN NOT coalesce(o_totalprice > 1000, false) THEN 'price' END, CASE WHEN NOT coalesce(o_orderstatus = 'O', false) THEN 'status' END) AS failed FROM orders")
def expect_tag(s, d):
    rules = {"price": F.col("o_totalprice") > 1000, "status": F.col("o_orderstatus") == "O"}
    return rel.expect(t(s, d, "orders"), rules, "tag").select("o_orderkey", F.array_join("failed", ",").alias("failed"))


@query("j01_inner_join", "SELECT n_name, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def inner(s, d):
    out = t(s, d, "orders").join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return out.groupBy("n_name").agg(n(), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("j02_left_join", "SELECT c_custkey, coalesce(sum(o_totalprice), 0) > 0 AS has_orders, count(o_orderkey)::BIGINT AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def left(s, d):
    out = t(s, d, "customer").join(t(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return out.groupBy("c_custkey").agg((F.coalesce(F.sum("o_totalprice"), F.lit(0)) > 0).alias("has_orders"), F.count("o_orderkey").alias("n"))


@query("j03_full_outer", "SELECT coalesce(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*)::BIGINT AS n FROM customer WHERE c_nationkey < 20 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*)::BIGINT AS n FROM supplier WHERE s_nationkey > 5 GROUP BY 1) b ON a.k = b.k")
def full(s, d):
    a = t(s, d, "customer").where("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    b = t(s, d, "supplier").where("s_nationkey > 5").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    return a.join(b, "k", "full_outer")


@query("j04_self_join", "SELECT a.s_suppkey, coalesce(b.s_name, 'NO MANAGER') AS manager FROM supplier a LEFT JOIN supplier b ON b.s_suppkey = a.s_suppkey // 2 AND a.s_suppkey > 1")
def self_join(s, d):
    a, b = t(s, d, "supplier").alias("a"), t(s, d, "supplier").alias("b")
    return a.join(b, F.expr("b.s_suppkey = a.s_suppkey div 2 AND a.s_suppkey > 1"), "left").select("a.s_suppkey", F.coalesce("b.s_name", F.lit("NO MANAGER")).alias("manager"))


@query("j05_theta_residual", "SELECT a.s_suppkey, count(*)::BIGINT AS n FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal > b.s_acctbal GROUP BY a.s_suppkey")
def theta(s, d):
    a, b = t(s, d, "supplier").alias("a"), t(s, d, "supplier").alias("b")
    return a.join(b, F.expr("a.s_nationkey = b.s_nationkey AND a.s_acctbal > b.s_acctbal")).groupBy("a.s_suppkey").agg(n())


@query("j06_correlated_subquery", "SELECT c_custkey FROM customer c WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer x WHERE x.c_nationkey = c.c_nationkey)")
def correlated(s, d):
    c = t(s, d, "customer")
    mean = c.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("mean"))
    return c.join(mean, "c_nationkey").where("c_acctbal > mean").select("c_custkey")


@query("j07_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti(s, d):
    return t(s, d, "customer").join(t(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("j07_semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi(s, d):
    return t(s, d, "customer").join(t(s, d, "orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("j11_interval_join", "SELECT count(*)::BIGINT AS n FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'view' AND b.event_type = 'click'")
def interval(s, d):
    e = t(s, d, "events").select("user_id", "ts", "event_type")
    a, b = e.where("event_type = 'view'").alias("a"), e.where("event_type = 'click'").alias("b")
    return a.join(b, F.expr("a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR")).agg(n())


@query("j19_as_of_join", "SELECT l.event_id, r.value AS last_value FROM (SELECT event_id, user_id, ts FROM events WHERE event_type IS DISTINCT FROM 'view') l ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2) r ON l.user_id = r.user_id AND l.ts >= r.ts")
def as_of(s, d):
    e, view = t(s, d, "events"), F.col("event_type").eqNullSafe("view")
    right = e.where(view).groupBy("user_id", "ts").agg(F.max("value").alias("last_value"))
    return rel.as_of(e.where(~view).select("event_id", "user_id", "ts"), right, "user_id", "ts", "last_value").select("event_id", "last_value")


@query("j24_salted_join", "SELECT c_mktsegment, count(*)::BIGINT AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def salted(s, d):
    a = t(s, d, "orders").withColumnRenamed("o_custkey", "k")
    b = t(s, d, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment")
    return rel.salted_join(a, b, "k", 8, "o_orderkey").groupBy("c_mktsegment").agg(n())


@query("g01_multi_aggregate", "SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc, max(l_extendedprice) AS top FROM lineitem GROUP BY 1, 2")
def multi(s, d):
    return t(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(n(), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.avg("l_discount"), 6).alias("disc"), F.max("l_extendedprice").alias("top"))


@query("g02_having_duplicates", "SELECT md5(text) AS h, count(*)::BIGINT AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def having(s, d):
    return t(s, d, "documents").groupBy(F.md5("text").alias("h")).agg(n()).where("n > 1")


@query("g03_conditional_counts", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) FILTER (o_orderstatus = 'O')::BIGINT AS open, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS done FROM orders GROUP BY 1")
def conditional(s, d):
    return t(s, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))


@query("g05_rollup", "SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(s, d):
    return t(s, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(n())


@query("g05_cube", "SELECT o_orderstatus, o_orderpriority, count(*)::BIGINT AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(s, d):
    return t(s, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(n())


@query("g07_count_distinct", "SELECT event_type, count(DISTINCT user_id)::BIGINT AS users FROM events GROUP BY 1")
def distinct(s, d):
    return t(s, d, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))


@query("g09_pivot", "SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT')::BIGINT AS urgent, count(*) FILTER (o_orderpriority = '5-LOW')::BIGINT AS low FROM orders GROUP BY 1")
def pivot(s, d):
    out = t(s, d, "orders").groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).agg(F.count(F.lit(1)))
    return out.select("o_orderstatus", F.coalesce("1-URGENT", F.lit(0)).alias("urgent"), F.coalesce("5-LOW", F.lit(0)).alias("low"))


@query("g09_unpivot", "SELECT l_orderkey, l_linenumber, what, val FROM (SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem) UNPIVOT (val FOR what IN (l_discount, l_tax))")
def unpivot(s, d):
    return t(s, d, "lineitem").unpivot(["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"], "what", "val")


@query("g19_nearest_rank_percentiles", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, min(value) AS low, max(value) AS high FROM events GROUP BY 1")
def percentiles(s, d):
    disc = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)")
    return t(s, d, "events").groupBy("event_type").agg(disc(0.5).alias("p50"), disc(0.95).alias("p95"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("g20_confusion_matrix", "SELECT quality AS gold, (n_chars >= 500)::INT AS guess, count(*)::BIGINT AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2")
def confusion(s, d):
    return t(s, d, "labels").join(t(s, d, "documents"), "doc_id").groupBy(F.col("quality").alias("gold"), (F.col("n_chars") >= 500).cast("int").alias("guess")).agg(n())


@query("g29_reconciliation", "SELECT a.n AS source_rows, a.s AS source_total, b.n AS target_rows, b.s AS target_total, a.n - b.n AS row_diff, round(a.s - b.s, 2) AS total_diff FROM (SELECT count(*)::BIGINT AS n, sum(o_totalprice::DECIMAL(18, 2))::DOUBLE AS s FROM orders) a, (SELECT count(*)::BIGINT AS n, sum(o_totalprice::DECIMAL(18, 2))::DOUBLE AS s FROM orders WHERE o_orderstatus = 'F') b")
def reconcile(s, d):
    o = t(s, d, "orders").withColumn("amount", F.col("o_totalprice").cast("decimal(18,2)"))
    out = rel.reconcile(o, o.where("o_orderstatus = 'F'"), "amount")
    return out.withColumns({c: F.col(c).cast("double") for c in ("source_total", "target_total", "total_diff")})


@query("w01_latest_per_key", "SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest(s, d):
    return rel.latest(t(s, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderdate")


@query("w02_rank_tiers", "SELECT c_nationkey, c_custkey, rank() OVER w AS r, dense_rank() OVER w AS dr FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) QUALIFY dr <= 3")
def tiers(s, d):
    w = W.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"))
    return t(s, d, "customer").select("c_nationkey", "c_custkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("dr")).where("dr <= 3")


@query("w04_lag_delta", "SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS delta FROM events WHERE event_type = 'purchase'")
def lag(s, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return t(s, d, "events").where("event_type = 'purchase'").select("event_id", F.round(F.col("value") - F.lag("value").over(w), 6).alias("delta"))


@query("w05_month_growth", "WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, sum(o_totalprice::DECIMAL(18, 2)) AS s FROM orders GROUP BY 1) SELECT month, round(100 * (s::DOUBLE / lag(s::DOUBLE) OVER (ORDER BY month) - 1), 4) AS growth FROM m")
def growth(s, d):
    m = t(s, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("month")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("s"))
    return m.select("month", F.round(100 * (F.col("s") / F.lag("s").over(W.orderBy("month")) - 1), 4).alias("growth"))


@query("w06_running_totals", "SELECT o_orderkey, sum(o_totalprice::DECIMAL(18, 2)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate)::DOUBLE AS by_range, sum(o_totalprice::DECIMAL(18, 2)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)::DOUBLE AS by_rows FROM orders")
def running(s, d):
    x, w = F.col("o_totalprice").cast("decimal(18,2)"), W.partitionBy("o_custkey")
    return t(s, d, "orders").select("o_orderkey", F.sum(x).over(w.orderBy("o_orderdate")).cast("double").alias("by_range"), F.sum(x).over(w.orderBy("o_orderdate", "o_orderkey").rowsBetween(W.unboundedPreceding, 0)).cast("double").alias("by_rows"))


@query("w07_group_difference", "SELECT c_custkey, round(c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_nationkey), 6) AS diff FROM customer")
def group_diff(s, d):
    return t(s, d, "customer").select("c_custkey", F.round(F.col("c_acctbal") - F.avg("c_acctbal").over(W.partitionBy("c_nationkey")), 6).alias("diff"))


@query("w08_islands", "WITH x AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events), y AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day)::INT AS a FROM x) SELECT user_id, min(day) AS first_day, max(day) AS last_day, count(*)::BIGINT AS days FROM y GROUP BY user_id, a")
def islands(s, d):
    return rel.islands(t(s, d, "events").select("user_id", F.to_date("ts").alias("day")), "user_id", "day")


@query("w10_second_highest", "SELECT c_nationkey, max(c_acctbal) AS second FROM (SELECT *, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS r FROM customer) WHERE r = 2 GROUP BY 1")
def second(s, d):
    w = W.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"))
    return t(s, d, "customer").withColumn("r", F.dense_rank().over(w)).where("r = 2").groupBy("c_nationkey").agg(F.max("c_acctbal").alias("second"))


@query("t14_nulls_last", "SELECT c_custkey, c_acctbal FROM customer ORDER BY CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END NULLS LAST, c_custkey LIMIT 20 OFFSET 5")
def nulls_last(s, d):
    key = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))
    return t(s, d, "customer").orderBy(key.asc_nulls_last(), "c_custkey").offset(5).limit(20).select("c_custkey", "c_acctbal")


@query("u01_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union(s, d):
    return t(s, d, "customer").select(F.col("c_nationkey").alias("k")).union(t(s, d, "supplier").select("s_nationkey")).distinct()


@query("u02_except_intersect", "SELECT 'except' AS op, count(*)::BIGINT AS n FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'intersect', count(*)::BIGINT FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)")
def set_ops(s, d):
    a, b = t(s, d, "customer").select("c_custkey"), t(s, d, "orders").select("o_custkey")
    return a.subtract(b).agg(n()).select(F.lit("except").alias("op"), "n").union(a.intersect(b).agg(n()).select(F.lit("intersect"), "n"))


@query("u09_multiset_difference", "SELECT event_type, count(*)::BIGINT AS n FROM (SELECT event_type FROM events WHERE event_id % 2 = 0 EXCEPT ALL SELECT event_type FROM events WHERE event_id % 3 = 0) GROUP BY 1")
def except_all(s, d):
    e = t(s, d, "events")
    return e.where("event_id % 2 = 0").select("event_type").exceptAll(e.where("event_id % 3 = 0").select("event_type")).groupBy("event_type").agg(n())


@query("k05_upsert", "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT c_custkey, c_acctbal + 1 FROM customer WHERE c_custkey % 10 = 0")
def upsert(s, d):
    c = t(s, d, "customer").select("c_custkey", "c_acctbal")
    return rel.upsert(c, c.where("c_custkey % 10 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1), ["c_custkey"])


@query("r16_scd2", "WITH e AS (SELECT user_id, ts AS valid_from, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) = 1), c AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY valid_from) AS p FROM e), v AS (SELECT user_id, event_type, valid_from FROM c WHERE p IS NULL OR p <> event_type) SELECT user_id, event_type, valid_from, lead(valid_from) OVER w AS valid_to, lead(valid_from) OVER w IS NULL AS is_current FROM v WINDOW w AS (PARTITION BY user_id ORDER BY valid_from)")
def scd2(s, d):
    e = rel.latest(t(s, d, "events"), ["user_id", "ts"], [F.col("event_id")]).select("user_id", "event_type", "ts")
    return rel.scd2(e, "user_id", "ts", ["event_type"])


@query("r15_scd1_changes", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AND event_type <> 'error'")
def scd1(s, d):
    last = rel.latest(t(s, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")])
    return last.where("event_type <> 'error'").select("user_id", "event_id", "event_type")


@query("f45_dates", "SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS month, (o_orderdate::DATE - 7) AS week_before, dayofweek(o_orderdate)::INT + 1 AS weekday FROM orders")
def dates(s, d):
    return t(s, d, "orders").select("o_orderkey", F.date_trunc("month", "o_orderdate").cast("date").alias("month"), F.date_sub(F.to_date("o_orderdate"), 7).alias("week_before"), F.dayofweek("o_orderdate").alias("weekday"))


@query("f54_pseudonyms", "SELECT c_custkey, sha256(c_name || '|v1') AS alias, floor(c_acctbal / 1000)::BIGINT AS bin FROM customer")
def pseudonyms(s, d):
    return t(s, d, "customer").select("c_custkey", F.sha2(F.concat(F.col("c_name"), F.lit("|v1")), 256).alias("alias"), F.floor(F.col("c_acctbal") / 1000).alias("bin"))


@query("s20_snapshot_diff", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'insert' WHEN b.k IS NULL THEN 'delete' ELSE 'update' END AS change FROM (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 7 <> 0) a FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS v FROM customer WHERE c_custkey % 11 <> 0) b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v")
def snapshot_diff(s, d):
    c = t(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    a = c.where("k % 7 <> 0").withColumnsRenamed({"v": "old"})
    b = c.where("k % 11 <> 0").select("k", F.expr("IF(k % 5 = 0, v + 1, v)").alias("new"))
    out = a.withColumn("in_a", F.lit(1)).join(b.withColumn("in_b", F.lit(1)), "k", "full_outer").where("NOT (old <=> new)")
    return out.select("k", F.when(F.col("in_a").isNull(), "insert").when(F.col("in_b").isNull(), "delete").otherwise("update").alias("change"))
