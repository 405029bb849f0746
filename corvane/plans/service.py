"""Queries around a service's data: query expansion, evaluation gates, entries with defaults, audits, SQL functions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.catalog import query
from corvane.operators import retrieval as R
from corvane.plans.retrieval import _TOK
from corvane.shared import new_dir
from corvane.sources import files
from corvane.sources.tables import table as t

# An item asks three times: whole, by its first half, by its second half; each asks BM25 for ten documents, and the three lists are fused.
_WAYS = "SELECT item_id * 3 AS q, text FROM benchmark UNION ALL SELECT item_id * 3 + 1, substring(text, 1, length(text) // 2) FROM benchmark UNION ALL SELECT item_id * 3 + 2, substring(text, length(text) // 2 + 1) FROM benchmark"


@query("c05_multi_query", rf"""
WITH t AS (SELECT doc_id, CASE WHEN len(t) = 0 THEN ['__empty__'] ELSE t END AS t FROM (SELECT doc_id, {_TOK.format('text')} AS t FROM documents)),
e AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM t), tf AS (SELECT term, doc_id, dl, count(*) AS tf FROM e GROUP BY ALL), st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM t),
df AS (SELECT term, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM tf, st GROUP BY term, n), idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM df) ELSE raw END AS idf FROM df),
q AS (SELECT q, unnest(list_distinct({_TOK.format('text')})) AS term FROM ({_WAYS})), sc AS (SELECT q, doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN q USING (term) JOIN idf USING (term), st GROUP BY ALL),
l AS (SELECT q // 3 AS item_id, doc_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) - 1 AS rank FROM sc QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) <= 10),
f AS (SELECT item_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS rrf, count(*)::BIGINT AS appearances FROM l GROUP BY ALL)
SELECT item_id, doc_id, rrf, round(1 - rrf, 9) AS distance, appearances, (row_number() OVER (PARTITION BY item_id ORDER BY rrf DESC, doc_id) - 1)::INT AS rank FROM f QUALIFY rank < 5""")
def multi_query(s, d):
    items, half = t(s, d, "benchmark"), F.floor(F.length("text") / 2).cast("int")
    part = lambda i, text: items.select((F.col("item_id") * 3 + i).alias("q"), text.alias("text"))
    ways = part(0, F.col("text")).unionByName(part(1, F.substring("text", F.lit(1), half))).unionByName(part(2, F.substring("text", half + 1, F.length("text"))))
    lists = R.bm25_top_k(t(s, d, "documents"), ways, "doc_id", "q", 10).withColumn("item_id", F.floor(F.col("q") / 3).cast("long"))
    fused = R.rrf(lists, "item_id", "doc_id").withColumn("rrf", F.round("rrf", 9))
    return R.top_k(fused, ["item_id"], [F.desc("rrf"), F.col("doc_id")], 5).select("item_id", "doc_id", "rrf", F.round(1 - F.col("rrf"), 9).alias("distance"), "appearances", "rank")


@query("c13_eval_gate", """WITH x AS (SELECT lang, (n_chars > 200)::INT = quality AS ok FROM documents JOIN labels USING (doc_id)), c AS (SELECT lang, count(*)::BIGINT AS total, count(*) FILTER (ok)::BIGINT AS correct FROM x GROUP BY 1)
SELECT lang, total, correct, round(correct / total, 4) AS accuracy, correct * 100 >= 80 * total AS passes, (SELECT sum(correct) * 100 >= 80 * sum(total) FROM c) AS all_pass FROM c""")
def eval_gate(s, d):
    """A run's accuracy by kind, and whether kinds and the whole run reach 80 %."""
    ok = (F.col("n_chars") > 200).cast("int") == F.col("quality")
    c = t(s, d, "documents").join(t(s, d, "labels"), "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("correct"))
    whole = W.partitionBy()  # a row for each kind
    return c.select("lang", "total", "correct", F.round(F.col("correct") / F.col("total"), 4).alias("accuracy"), (F.col("correct") * 100 >= F.col("total") * 80).alias("passes"), (F.sum("correct").over(whole) * 100 >= F.sum("total").over(whole) * 80).alias("all_pass"))


@query("s04_entries_with_defaults", "SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'general' ELSE event_type END AS type, CASE WHEN event_id % 4 = 0 THEN 'Permanent' ELSE props END AS expiry FROM events WHERE event_id % 5 <> 4 AND event_id % 7 <> 3")
def entries_with_defaults(s, d):
    """Events as JSON lines, some without a type or an expiry (which have defaults), some without an id (left out) or broken (left out), read back by byte ranges."""
    e = F.col("event_id")
    line = F.to_json(F.struct(F.when(e % 5 != 4, e).alias("id"), F.when(e % 3 != 0, F.col("event_type")).alias("type"), F.when(e % 4 != 0, F.col("props")).alias("expiry")))
    home = new_dir(s, "entries")
    t(s, d, "events").select(F.when(e % 7 == 3, F.concat(line, F.lit("}"))).otherwise(line).alias("value")).write.text(home)
    rows = files.audited_entries(s, home, "id long, type string, expiry string", range_bytes=256 << 10).where("NOT bad AND entry.id IS NOT NULL")
    return rows.select("entry.id", F.coalesce("entry.type", F.lit("general")).alias("type"), F.coalesce("entry.expiry", F.lit("Permanent")).alias("expiry"))


@query("k08_integrity_audit", "SELECT source, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS ids, count(*) FILTER (text IS NULL OR trim(text) = '')::BIGINT AS blank, (count(*) - count(DISTINCT md5(coalesce(text, ''))))::BIGINT AS copies, count(*) FILTER (length(text) <> n_chars)::BIGINT AS wrong_size FROM documents GROUP BY 1")
def integrity_audit(s, d):
    size = F.count_if(F.length("text") != F.col("n_chars"))
    out = t(s, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("ids"), F.count_if(F.col("text").isNull() | (F.trim("text") == "")).alias("blank"), F.count_distinct(F.md5(F.coalesce("text", F.lit("")))).alias("texts"), size.alias("wrong_size"))
    return out.select("source", "n", "ids", "blank", (F.col("n") - F.col("texts")).alias("copies"), "wrong_size")


@query("x08_sql_functions", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name ELSE left(c_name, 3) || '***' END AS name FROM customer WHERE c_acctbal > 0 OR c_mktsegment = 'BUILDING'")
def sql_functions(s, d):
    """A row filter and a column mask as SQL functions of the session."""
    s.sql("CREATE OR REPLACE TEMPORARY FUNCTION corvane_may_see(segment STRING, balance DOUBLE) RETURNS BOOLEAN RETURN balance > 0 OR segment = 'BUILDING'")
    s.sql("CREATE OR REPLACE TEMPORARY FUNCTION corvane_masked(name STRING, segment STRING) RETURNS STRING RETURN CASE WHEN segment = 'BUILDING' THEN name ELSE left(name, 3) || '***' END")
    t(s, d, "customer").createOrReplaceTempView("corvane_x08_customer")
    return s.sql("SELECT c_custkey, corvane_masked(c_name, c_mktsegment) AS name FROM corvane_x08_customer WHERE corvane_may_see(c_mktsegment, c_acctbal)")


@query("t12_word_mirror", r"""WITH w AS (SELECT conv_id, turn, role, text, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+')) AS ws FROM conversations), p AS (SELECT conv_id, turn, role, lag(ws) OVER o AS b, ws AS a FROM w WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)),
s AS (SELECT conv_id, turn, role, round(len(list_intersect(a, b)) / len(a)::DOUBLE, 6) AS overlap FROM p WHERE len(list_intersect(a, b)) > 0) SELECT conv_id, turn, role, overlap, (row_number() OVER (PARTITION BY conv_id ORDER BY overlap DESC, turn, role) - 1)::INT AS rank FROM s QUALIFY rank < 3""")
def word_mirror(s, d):
    """The three turns of a conversation that repeat most of the turn before them."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0)))
    w = t(s, d, "conversations").select("conv_id", "turn", "role", "text", words.alias("a"))
    w = w.withColumn("b", F.lag("a").over(W.partitionBy("conv_id").orderBy("turn", "role", "text")))
    overlap = F.size(F.array_intersect("a", "b"))
    scored = w.where(overlap > 0).select("conv_id", "turn", "role", F.round(overlap / F.size("a"), 6).alias("overlap"))
    return R.top_k(scored, ["conv_id"], [F.desc("overlap"), F.col("turn"), F.col("role")], 3)
