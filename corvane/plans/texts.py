"""Queries of time words, fuzzy matches, embedded documents and tiers of a memory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.catalog import query
from corvane.functions import parsers, temporal
from corvane.operators import retrieval as R
from corvane.plans.retrieval import _SLOT, _TOK
from corvane.sources.tables import table as t

# A phrase for each event, by its number and kind, seen from its own time.
_PHRASE = """CASE event_id % 14 WHEN 0 THEN k || ' days ago' WHEN 1 THEN 'in ' || k || ' weeks' WHEN 2 THEN 'an hour ago' WHEN 3 THEN ' Yesterday ' WHEN 4 THEN 'tonight' WHEN 5 THEN 'last friday' WHEN 6 THEN 'next Monday' WHEN 7 THEN 'this wednesday'
 WHEN 8 THEN 'last night' WHEN 9 THEN 'next month' WHEN 10 THEN '2024/2/' || k WHEN 11 THEN 'this year' WHEN 12 THEN 'in a ' || event_type WHEN 13 THEN 'tomorrow' END"""
_WEEKDAY = "(extract('isodow' FROM ts) - 1)"


def _gap(day: int, which: str) -> str:
    d = f"({day} - {_WEEKDAY})"
    more = {"last": f"CASE WHEN {d} >= 0 THEN -7 ELSE 0 END", "next": f"CASE WHEN {d} <= 0 THEN 7 ELSE 0 END", "this": f"CASE WHEN {d} < 0 THEN 7 ELSE 0 END"}[which]
    return f"(date_trunc('day', ts)::TIMESTAMP + to_days(({d} + {more})::INT))"


@query("f21_relative_dates", f"""WITH e AS (SELECT event_id, ts, event_type, (props::JSON->>'$.k')::INT AS k, date_trunc('day', ts)::TIMESTAMP AS d FROM events)
SELECT event_id, CASE event_id % 14 WHEN 0 THEN ts - to_days(k) WHEN 1 THEN ts + to_days(7 * k) WHEN 2 THEN ts - INTERVAL 1 HOUR WHEN 3 THEN d - INTERVAL 1 DAY WHEN 4 THEN d + INTERVAL 21 HOUR WHEN 5 THEN {_gap(4, 'last')} WHEN 6 THEN {_gap(0, 'next')} WHEN 7 THEN {_gap(2, 'this')}
 WHEN 8 THEN d - INTERVAL 3 HOUR WHEN 9 THEN ts + INTERVAL 30 DAY WHEN 10 THEN try_cast('2024-02-' || lpad(k::VARCHAR, 2, '0') AS DATE)::TIMESTAMP WHEN 11 THEN ts WHEN 13 THEN d + INTERVAL 1 DAY END AS meant FROM e""")
def relative_dates(s, d):
    e = t(s, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int")).withColumn("phrase", F.expr(_PHRASE))
    return e.select("event_id", temporal.resolved(F.col("phrase"), F.col("ts")).cast("timestamp_ntz").alias("meant"))


def _told(s, d):
    """A user's turns with time words between their own words."""
    w = F.split("text", " ")
    said = F.concat_ws(" ", F.slice(w, 1, 3), F.lit("since the"), F.regexp_replace(F.element_at(w, -1), r"[^\p{L}]", "x"), F.lit("test was fixed"), F.col("turn") + 2, F.lit("days ago; that bug"), F.slice(w, 4, 3), F.lit("before last night."))
    return t(s, d, "conversations").where("role = 'user' AND text IS NOT NULL").select("conv_id", "turn", said.alias("said"))


@query("f20_time_markers")
def time_markers(s, d):
    m = _told(s, d).select("conv_id", "turn", F.explode(temporal.markers(F.col("said"))).alias("m"))
    return m.select("conv_id", "turn", "m.start", "m.end", "m.kind", "m.words")


@query("t13_event_matches")
def event_matches(s, d):
    phrases = t(s, d, "part").select("p_type").distinct().select("p_type", F.concat(F.lit("after the "), "p_type", F.lit(" was shipped")).alias("phrase"))
    return temporal.event_matches(phrases, t(s, d, "part"), "p_type", "phrase", "p_partkey", "p_name")


@query("f22_fuzzy_follow_up")
def fuzzy_follow_up(s, d):
    """How well the beginning of each turn matches some stretch of the turn before it."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    turns = t(s, d, "conversations").select("conv_id", "turn", F.lower(F.substring("text", 1, 12)).alias("a"), F.lower(F.substring(before, 1, 500)).alias("b"))
    return turns.select("conv_id", "turn", F.round(temporal.fuzzy(F.col("a"), F.col("b")), 6).alias("ratio"))


@query("f37_embedded_json", "SELECT event_id, CASE WHEN event_id % 5 <> 4 THEN '{\"user\": ' || user_id::VARCHAR || ', \"in\": ' || props || '}' END AS found FROM events")
def embedded_json(s, d):
    doc = F.concat(F.lit('{"user": '), F.col("user_id").cast("string"), F.lit(', "in": '), F.col("props"), F.lit("}"))
    say = F.expr("event_id % 5")
    text = (F.when(say == 0, F.concat(F.lit(" "), doc, F.lit('\n{"second": 1} and prose'))).when(say == 1, F.concat(F.lit("Here:\n```json\n"), doc, F.lit("\n```\ndone {x}")))
            .when(say == 2, F.concat(F.lit("I call "), doc, F.lit(" now {}"))).when(say == 3, F.concat(doc, F.lit("}"))).otherwise("no braces at all"))
    return t(s, d, "events").select("event_id", parsers.embedded_json(text).alias("found"))


@query("f11_host_blocks", "SELECT conv_id, turn, role, md5('a ' || coalesce(text, '') || '   <b>stays</b>' || ' ') AS clean_md5 FROM conversations WHERE NOT contains(coalesce(text, ''), '<')")
def host_blocks(s, d):
    x = F.coalesce("text", F.lit(""))
    put = F.concat(F.lit("a "), x, F.lit("<system-reminder kind='1'>"), x, F.lit("\n</SYSTEM-reminder><command-name>x</command-name><ide_selection/><b>stays</b></command-args>"))
    return t(s, d, "conversations").where(~F.contains(x, F.lit("<"))).select("conv_id", "turn", "role", F.md5(parsers.without_host_blocks(put)).alias("clean_md5"))


# Hot: the 32 documents that users of their number accessed last; warm: English ones; cold: all others.
@query("c07_tiers", rf"""WITH hot AS (SELECT user_id AS doc_id FROM events GROUP BY 1 ORDER BY max(event_id) DESC, user_id DESC LIMIT 32), x AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN lang = 'en' THEN 'warm' ELSE 'cold' END AS tier FROM documents),
ws AS (SELECT item_id, lower(text) AS qt, list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}]+'), lambda w: length(w) >= 3)) AS qw FROM benchmark WHERE trim(coalesce(text, '')) <> ''),
h AS (SELECT item_id, doc_id, 'hot' AS tier, CASE WHEN contains(lower(text), qt) THEN 1.0 ELSE len(list_intersect(qw, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}]+')))) / greatest(len(qw), 1)::DOUBLE END AS raw FROM ws, x SEMI JOIN hot USING (doc_id)),
hd AS (SELECT doc_id, {_SLOT} AS slot, count(*)::DOUBLE AS c FROM (SELECT doc_id, unnest({_TOK.format('text')}) AS term FROM x) GROUP BY ALL), hq AS (SELECT item_id, {_SLOT} AS slot, count(*)::DOUBLE AS c FROM (SELECT item_id, unnest({_TOK.format('text')}) AS term FROM benchmark) GROUP BY ALL),
nd AS (SELECT doc_id, sqrt(sum(c * c)) AS n FROM hd GROUP BY 1), nq AS (SELECT item_id, sqrt(sum(c * c)) AS n FROM hq GROUP BY 1), dots AS (SELECT item_id, doc_id, sum(hd.c * hq.c) AS dot FROM hd JOIN hq USING (slot) GROUP BY ALL),
v AS (SELECT i.item_id, x.doc_id, tier, coalesce(round(dot / (nd.n * nq.n), 6), 0) AS sim FROM ws i CROSS JOIN x LEFT JOIN dots USING (item_id, doc_id) LEFT JOIN nd USING (doc_id) LEFT JOIN nq USING (item_id)),
v2 AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY item_id, tier ORDER BY sim DESC, doc_id) <= 10),
a AS (SELECT item_id, doc_id, tier, round(raw + 0.2, 6) AS score FROM h WHERE raw > 0 UNION ALL SELECT item_id, doc_id, tier, round(sim - CASE WHEN tier = 'cold' THEN 0.1 ELSE 0 END, 6) FROM v2),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY item_id, doc_id ORDER BY score DESC, tier DESC) = 1)
SELECT item_id, doc_id, tier, score, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) - 1)::INT AS rank FROM b QUALIFY rank < 5""")
def tiers(s, d):
    items = t(s, d, "documents").select("doc_id", "text", F.when(F.col("lang") == "en", "warm").otherwise("cold").alias("tier"))
    hot = R.hottest(t(s, d, "events").select(F.col("user_id").alias("doc_id"), "event_id"), "doc_id", "event_id")
    return R.tiered(items, hot, t(s, d, "benchmark"), "doc_id", "item_id", "tier", 5)
