"""Message shifts, catalog routing, budgets, audits and rule matches."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.catalog import query
from corvane.functions import messages as ms
from corvane.operators import retrieval as R
from corvane.sources.tables import table as t

n = lambda: F.count(F.lit(1)).alias("n")
literal = lambda x: "'" + x.replace("'", "''") + "'"
has = lambda c, x: F.contains(F.lower(F.col(c)), F.lit(x))

_score = lambda weights: " + ".join(f"CASE WHEN contains(lower(coalesce(text, '')), {literal(k)}) THEN {w} ELSE 0 END" for k, w in weights.items())
_words = r"list_filter(string_split_regex(lower(coalesce({0}, '')), '[ \t\n\x0b\f\r]+'), lambda w: w <> '')"
_starts = " OR ".join(f"starts_with(ltrim(lower(coalesce(text, ''))), {literal(p)})" for p in ms.CORRECTION_PREFIXES)
_SCORED = f"s AS (SELECT conv_id, turn, text, ({_score(ms.ESCALATION)})::INT AS up, ({_score(ms.DEESCALATION)})::INT AS down, {_starts} AS corrects FROM conversations WHERE role = 'user')"


def _scored(s, d):
    text = F.col("text")
    return t(s, d, "conversations").where("role = 'user'").select("conv_id", "turn", "text", ms.keyword_score(text, ms.ESCALATION).alias("up"), ms.keyword_score(text, ms.DEESCALATION).alias("down"), ms.starts_correction(text).alias("corrects"))


@query("f18_keyword_scores", f"WITH {_SCORED} SELECT conv_id, turn, up, down FROM s")
def keyword_scores(s, d):
    return _scored(s, d).select("conv_id", "turn", "up", "down")


@query("f16_correction_starts", f"WITH {_SCORED} SELECT conv_id, turn, corrects FROM s")
def correction_starts(s, d):
    return _scored(s, d).select("conv_id", "turn", "corrects")


@query("w17_message_shift", f"""WITH {_SCORED}, w AS (SELECT *, {_words.format('text')} AS a, {_words.format('lag(text) OVER o')} AS b, lag(text) OVER o AS before, lag(up) OVER o AS u0, lag(down) OVER o AS d0 FROM s WINDOW o AS (PARTITION BY conv_id ORDER BY turn, text)),
g AS (SELECT *, list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1]) AS ga, list_transform(range(1, len(b)), lambda i: b[i] || ' ' || b[i + 1]) AS gb FROM w)
SELECT conv_id, turn, corrects, before IS NOT NULL AND len(a) >= 5 AND len(b) >= 5 AND 2 * len(list_intersect(a, b)) >= len(list_distinct(list_concat(a, b))) AND 10 * len(list_intersect(ga, gb)) < 3 * len(list_distinct(list_concat(ga, gb))) AS rephrases,
CASE WHEN u0 IS NULL THEN CASE WHEN up > 15 THEN 'escalating' WHEN down > 10 THEN 'deescalating' ELSE 'stable' END
 WHEN up - u0 > 5 AND up - u0 > down - d0 THEN 'escalating' WHEN down - d0 > 5 AND down - d0 > up - u0 THEN 'deescalating' ELSE 'stable' END AS direction FROM g""")
def message_shift(s, d):
    by = W.partitionBy("conv_id").orderBy("turn", "text")
    x = _scored(s, d).select("*", *[F.lag(c).over(by).alias(f"last_{c}") for c in ("text", "up", "down")])
    return x.select("conv_id", "turn", "corrects", ms.rephrases(F.col("text"), F.col("last_text")).alias("rephrases"), ms.direction(F.col("up"), F.col("down"), F.col("last_up"), F.col("last_down")).alias("direction"))


@query("f17_word_bigrams", f"WITH w AS (SELECT conv_id, turn, {_words.format('text')} AS a FROM conversations) SELECT conv_id, turn, len(list_distinct(list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1])))::INT AS n_bigrams FROM w")
def word_bigrams(s, d):
    return t(s, d, "conversations").select("conv_id", "turn", F.size(F.array_distinct(ms.bigrams(ms.blank_words(F.col("text"))))).alias("n_bigrams"))


# A catalog of parts: the size and price as costs, the name as id. Names with `ring` may be free of charge.
_FIT = "p_size <= 40 AND p_retailprice <= 1500 AND (p_retailprice > 0 OR contains(lower(p_name), 'ring'))"
_FRONTIER = "(p_retailprice >= 980 OR contains(lower(p_name), 'anvil'))"
_POINTS = "round(10 + 2 * p_size + p_retailprice - CASE WHEN contains(lower(p_name), 'ring') THEN 4 ELSE 0 END - CASE WHEN contains(lower(p_name), 'small') THEN 3 ELSE 0 END, 4)"


def _catalog(s, d):
    ring = has("p_name", "ring")
    fit = (F.col("p_size") <= 40) & (F.col("p_retailprice") <= 1500) & ((F.col("p_retailprice") > 0) | ring)
    points = 10 + 2 * F.col("p_size") + F.col("p_retailprice") - F.when(ring, 4).otherwise(0) - F.when(has("p_name", "small"), 3).otherwise(0)
    return t(s, d, "part").where(fit).select("*", F.round(points, 4).alias("points"))


_affordable = lambda df: df.where(~((F.col("p_retailprice") >= 980) | has("p_name", "anvil")))


@query("p14_hard_constraints", f"SELECT p_partkey FROM part WHERE {_FIT}")
def hard_constraints(s, d):
    return _catalog(s, d).select("p_partkey")


@query("p15_frontier_excluded", f"SELECT p_partkey FROM part WHERE NOT {_FRONTIER}")
def frontier_excluded(s, d):
    return _affordable(t(s, d, "part")).select("p_partkey")


@query("f32_catalog_score", f"SELECT p_partkey, {_POINTS} AS points FROM part WHERE {_FIT}")
def catalog_score(s, d):
    return _catalog(s, d).select("p_partkey", "points")


@query("t08_best_three", f"SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY {_POINTS}, p_partkey) AS nth FROM part WHERE {_FIT} AND NOT {_FRONTIER} QUALIFY nth <= 3")
def best_three(s, d):
    by = W.partitionBy("p_type").orderBy("points", "p_partkey")
    return _affordable(_catalog(s, d)).withColumn("nth", F.row_number().over(by)).where("nth <= 3").select("p_type", "p_partkey", F.col("nth").cast("long").alias("nth"))


@query("c14_route", f"""WITH p AS (SELECT label, min(vec_id) AS p FROM embeddings GROUP BY label), v AS (
 SELECT b.vec_id, p.label AS proto, round(list_cosine_similarity(b.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS sim FROM embeddings b, p JOIN embeddings q ON q.vec_id = p.p QUALIFY row_number() OVER (PARTITION BY b.vec_id ORDER BY sim DESC, proto) = 1),
c AS (SELECT 'Brand#' || (proto + 1) AS brand, vec_id FROM v),
k AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY {_POINTS}, p_partkey) AS nth FROM part WHERE {_FIT} AND NOT {_FRONTIER} QUALIFY nth <= 3)
SELECT vec_id, brand, nth, p_partkey FROM c LEFT JOIN k ON brand = p_brand""")
def route(s, d):
    """Nearest prototype, its brand's parts pruned and scored, the best three; without any the target is null."""
    base = t(s, d, "embeddings")
    protos = base.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding")).withColumnRenamed("label", "query_id")
    kinds = R.nearest_query(base, protos).select("vec_id", F.concat(F.lit("Brand#"), (F.col("query_id") + 1).cast("string")).alias("brand"))
    by = W.partitionBy("p_brand").orderBy("points", "p_partkey")
    best = _affordable(_catalog(s, d)).withColumn("nth", F.row_number().over(by).cast("long")).where("nth <= 3").select("p_brand", "nth", "p_partkey")
    return kinds.join(best, F.col("brand") == F.col("p_brand"), "left").select("vec_id", "brand", "nth", "p_partkey")


@query("t09_peer_selection", "SELECT p_type, p_partkey FROM part WHERE p_size <= 40 QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice, p_partkey) = 1")
def peer_selection(s, d):
    return t(s, d, "part").where("p_size <= 40").groupBy("p_type").agg(F.min_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("p_partkey"))


@query("t17_cascaded_choice", "SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY contains(p_name, 'red'), NOT contains(p_name, 'ring'), p_size DESC, p_partkey) = 1")
def cascaded_choice(s, d):
    """Names with `red` only if a brand has no others, of those names with `ring` where there are any, then the largest size."""
    return t(s, d, "part").groupBy("p_brand").agg(F.min_by("p_partkey", F.struct(has("p_name", "red"), ~has("p_name", "ring"), -F.col("p_size"), "p_partkey")).alias("p_partkey"))


# Rules of a match: one whole id, and parts of ids of which the longest counts.
_RULES = (("widget", "device"), ("red widget", "red device"), ("ring", "jewel"), ("gear", "machine"), ("small", "little"))


@query("j22_longest_rule", "SELECT p_partkey, CASE WHEN lower(p_name) = 'small ring' THEN 'exact' " + " ".join(f"WHEN contains(lower(p_name), '{k}') THEN '{v}'" for k, v in sorted(_RULES, key=lambda x: -len(x[0]))) + " ELSE 'default' END AS kind FROM part")
def longest_rule(s, d):
    kind = F.when(F.lower("p_name") == "small ring", "exact")
    for k, v in sorted(_RULES, key=lambda x: -len(x[0])):
        kind = kind.when(has("p_name", k), v)
    return t(s, d, "part").select("p_partkey", kind.otherwise("default").alias("kind"))


@query("g17_pool_ledger", "SELECT event_type, count(*)::BIGINT AS calls, round(avg(value), 4) AS latency, string_agg(DISTINCT strftime(ts, '%m-%d'), ',' ORDER BY strftime(ts, '%m-%d')) AS days FROM events GROUP BY 1")
def pool_ledger(s, d):
    days = F.array_join(F.sort_array(F.collect_set(F.date_format("ts", "MM-dd"))), ",")
    return t(s, d, "events").groupBy("event_type").agg(n().alias("calls"), F.round(F.avg("value"), 4).alias("latency"), days.alias("days"))


@query("g20_routing_baselines", "WITH x AS (SELECT quality AS gold, (n_chars > 200)::INT AS said FROM documents JOIN labels USING (doc_id)) SELECT count(*)::BIGINT AS n, round(avg((gold = said)::INT), 6) AS accuracy, round(greatest(avg(gold), 1 - avg(gold)), 6) AS majority, count(*) FILTER (WHERE gold <> said)::BIGINT AS misroutes FROM x")
def routing_baselines(s, d):
    x = t(s, d, "documents").join(t(s, d, "labels"), "doc_id").select(F.col("quality").alias("gold"), (F.col("n_chars") > 200).cast("int").alias("said"))
    return x.agg(n(), F.round(F.avg((F.col("gold") == F.col("said")).cast("int")), 6).alias("accuracy"), F.round(F.greatest(F.avg("gold"), 1 - F.avg("gold")), 6).alias("majority"), F.count_if(F.col("gold") != F.col("said")).alias("misroutes"))


@query("g25_duplicate_audit", "SELECT doc_id, sha256(text) AS key, count(*) OVER (PARTITION BY sha256(text))::BIGINT AS copies FROM documents WHERE text IS NOT NULL QUALIFY copies > 1")
def duplicate_audit(s, d):
    """Every row whose content occurs twice or more, one row each, so that no group of copies is gathered."""
    rows = t(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("key"))
    return rows.join(rows.groupBy("key").agg(n().alias("copies")).where("copies > 1"), "key").select("doc_id", "key", "copies")


_COVER = f"w AS (SELECT DISTINCT conv_id, role = 'assistant' AS draft, unnest({_words.format('text')}) AS word FROM conversations), c AS (SELECT conv_id, word, bool_or(draft) AS d, bool_or(NOT draft) AS e FROM w GROUP BY 1, 2)"


@query("g33_vocabulary_coverage", f"WITH {_COVER} SELECT conv_id, round(count(*) FILTER (WHERE d AND e) / count(*) FILTER (WHERE d), 6) AS coverage FROM c GROUP BY conv_id HAVING count(*) FILTER (WHERE d) > 0")
def vocabulary_coverage(s, d):
    draft = F.col("role") == "assistant"
    words = t(s, d, "conversations").select("conv_id", draft.alias("draft"), F.explode(F.array_distinct(ms.blank_words(F.col("text")))).alias("word"))
    both = words.groupBy("conv_id", "word").agg(F.bool_or("draft").alias("d"), F.bool_or(~F.col("draft")).alias("e"))
    return both.groupBy("conv_id").agg(F.count_if("d").alias("all"), F.count_if(F.col("d") & F.col("e")).alias("met")).where(F.col("all") > 0).select("conv_id", F.round(F.col("met") / F.col("all"), 6).alias("coverage"))


@query("f31_budget_state", "WITH r AS (SELECT o_orderkey, sum(round(o_totalprice * 100)::BIGINT) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS spent FROM orders) SELECT o_orderkey, spent > 100000000 AS exceeds, spent >= 90000000 AS downshift FROM r")
def budget_state(s, d):
    """Whether an order takes its customer past a budget of a million, and whether nine tenths are spent."""
    by = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(W.unboundedPreceding, 0)
    r = t(s, d, "orders").select("o_orderkey", F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).over(by).alias("spent"))
    return r.select("o_orderkey", (F.col("spent") > 100_000_000).alias("exceeds"), (F.col("spent") >= 90_000_000).alias("downshift"))


@query("f28_recency_score", "SELECT event_id, round((0.6 * value / 100 + 0.4 * (props->>'k')::INT / 100) * (1 + 0.35 * exp(-date_diff('day', ts::DATE, DATE '2024-02-01') / 25.0)) * CASE WHEN event_type = 'error' THEN 0.3 ELSE 1 END, 6) AS score FROM events")
def recency_score(s, d):
    age = F.date_diff(F.lit("2024-02-01").cast("date"), F.to_date("ts"))
    score = (0.6 * F.col("value") / 100 + 0.4 * F.from_json("props", "k int")["k"] / 100) * (1 + 0.35 * F.exp(-age / 25.0))
    return t(s, d, "events").select("event_id", F.round(score * F.when(F.col("event_type") == "error", 0.3).otherwise(1.0), 6).alias("score"))


@query("f35_role_by_size", "WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, list_sort(list(l_quantity) OVER (PARTITION BY l_orderkey)) AS z FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN q >= 1.3 * z[len(z) // 2 + 1] THEN 'heading' WHEN q <= 0.8 * z[len(z) // 2 + 1] THEN 'footnote' ELSE 'body' END AS role FROM r")
def role_by_size(s, d):
    """Against the upper median of the order's quantities."""
    by = W.partitionBy("l_orderkey")
    x = t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), F.row_number().over(by.orderBy("l_quantity")).alias("nth"), F.count(F.lit(1)).over(by).alias("k"))
    x = x.withColumn("mid", F.max(F.when(F.col("nth") == F.floor(F.col("k") / 2) + 1, F.col("q"))).over(by))
    return x.select("l_orderkey", "l_linenumber", F.when(F.col("q") >= 1.3 * F.col("mid"), "heading").when(F.col("q") <= 0.8 * F.col("mid"), "footnote").otherwise("body").alias("role"))


@query("f52_title_words", rf"WITH x AS (SELECT doc_id, text, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: length(trim(l)) > 5)[1] AS title, string_split_regex(trim(coalesce(text, '')), ' +') AS w FROM documents) SELECT doc_id, trim(title) AS title, len(w)::INT AS n_words, md5(substring(array_to_string(w[1:500], ' '), 1, 2000)) AS head_md5 FROM x")
def title_words(s, d):
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.split(F.trim(text), " +")
    title = F.get(F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x)) > 5), 0)
    return t(s, d, "documents").select("doc_id", F.trim(title).alias("title"), F.size(words).alias("n_words"), F.md5(F.substring(F.array_join(F.slice(words, 1, 500), " "), 1, 2000)).alias("head_md5"))


@query("p12_compress_dispatch", "WITH x AS (SELECT source, len(string_split(coalesce(text, ''), ' ')) AS w, n_chars > 200 AS keep FROM documents) SELECT source, CASE WHEN sum(w) >= 1500 THEN 'llm' ELSE 'embeddings' END AS way, round(coalesce(sum(w) FILTER (WHERE keep), 0) / sum(w), 6) AS ratio FROM x GROUP BY source")
def compress_dispatch(s, d):
    x = t(s, d, "documents").select("source", F.size(F.split(F.coalesce("text", F.lit("")), " ")).alias("w"), (F.col("n_chars") > 200).alias("keep"))
    kept = F.coalesce(F.sum(F.when(F.col("keep"), F.col("w"))), F.lit(0))
    return x.groupBy("source").agg(F.when(F.sum("w") >= 1500, "llm").otherwise("embeddings").alias("way"), F.round(kept / F.sum("w"), 6).alias("ratio"))


@query("t06_typed_memory", "WITH s AS (SELECT q.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(b.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity FROM embeddings b JOIN embeddings q ON q.label = b.label WHERE q.vec_id % 50 = 0) SELECT query_id, vec_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id DESC) AS nth FROM s WHERE similarity >= 0.3 QUALIFY nth <= 5")
def typed_memory(s, d):
    """Of one type with the query and similar enough, the best five, equal ones by falling index."""
    base = t(s, d, "embeddings")
    near = R.vectors_within(base, base.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), 0.3)
    kind = base.select("vec_id", "label")
    same = near.join(kind, "vec_id").join(kind.select(F.col("vec_id").alias("query_id"), F.col("label").alias("asked")), "query_id").where("label = asked")
    by = W.partitionBy("query_id").orderBy(F.desc("similarity"), F.desc("vec_id"))
    return same.withColumn("nth", F.row_number().over(by).cast("long")).where("nth <= 5").select("query_id", "vec_id", "similarity", "nth")


@query("j20_dependents", "SELECT a.conv_id, a.turn AS step, b.turn AS dependent FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'")
def dependents(s, d):
    """Steps and those that wait for them: an answer waits for the turn before it."""
    c = t(s, d, "conversations")
    steps, later = c.where("role = 'user'").select("conv_id", F.col("turn").alias("step")), c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("dependent"), (F.col("turn") - 1).alias("step"))
    return steps.join(later, ["conv_id", "step"]).select("conv_id", "step", "dependent")
