"""Queries of order-dependent operators, numbered files, table functions and semi-structured values."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.catalog import query
from corvane.operators import sequences as seq
from corvane.shared import new_dir
from corvane.sources import files
from corvane.sources.tables import table as t

# A customer's orders as blocks of a page: days down, price across; a row is what lies within 60 days of its first order.
_CHAIN = """r AS MATERIALIZED (SELECT DISTINCT {key} AS key, {value} AS v FROM {table}), nx AS MATERIALIZED (SELECT a.key, a.v, (SELECT min(b.v) FROM r b WHERE b.key = a.key AND b.v {over} a.v + {width}) AS nxt FROM r a),
ch(key, v, i) AS (SELECT key, min(v), 0 FROM r GROUP BY key UNION ALL SELECT ch.key, nx.nxt, i + 1 FROM ch JOIN nx ON nx.key = ch.key AND nx.v = ch.v WHERE nx.nxt IS NOT NULL)"""


@query("w21_reading_order", f"""WITH RECURSIVE {_CHAIN.format(key='o_custkey', value="date_diff('day', DATE '1970-01-01', o_orderdate::DATE)", table='orders', over='>', width=60)}
SELECT o_custkey, o_orderkey, i AS "row", (row_number() OVER (PARTITION BY o_custkey, i ORDER BY o_totalprice, y, o_orderkey) - 1)::INT AS place FROM (SELECT o.*, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS y FROM orders o) o
JOIN (SELECT *, lead(v) OVER (PARTITION BY key ORDER BY v) AS nv FROM ch) ch ON key = o_custkey AND y >= v AND (nv IS NULL OR y < nv)""")
def reading_order(s, d):
    blocks = t(s, d, "orders").select("o_custkey", "o_orderkey", F.unix_date(F.col("o_orderdate").cast("date")).cast("long").alias("y"), "o_totalprice")
    return seq.reading_order(blocks, "o_custkey", "y", "o_totalprice", "o_orderkey", 60)


@query("w22_debounced_errors", f"""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, event_id FROM events WHERE event_type = 'error'), {_CHAIN.format(key='user_id', value='t', table='e', over='>=', width=86_400_000_000)},
g AS (SELECT key, v, row_number() OVER (PARTITION BY key, v ORDER BY t, event_id) AS nth, t FROM e JOIN (SELECT *, lead(v) OVER (PARTITION BY key ORDER BY v) AS nv FROM ch) ch ON key = user_id AND t >= v AND (nv IS NULL OR t < nv)),
q AS (SELECT key, v, min(t) FILTER (nth > 1) AS waiting, count(*) AS n FROM g GROUP BY ALL)
SELECT key AS user_id, v AS fired_at, coalesce(lag(waiting) OVER w, v) AS requested_at, coalesce(lag(n) OVER w, 1)::BIGINT AS coalesced FROM q WINDOW w AS (PARTITION BY key ORDER BY v)""")
def debounced(s, d):
    errors = t(s, d, "events").where("event_type = 'error'").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id")
    return seq.debounced(errors, "user_id", "t", "event_id", 86_400_000_000)


@query("c19_context_packing", r"""WITH RECURSIVE s AS MATERIALIZED (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, b, CASE WHEN b <> '' THEN length('## ' || role || chr(10)) + CASE WHEN length(b) > 400 THEN 400 + 12 ELSE length(b) END END AS n
 FROM (SELECT conv_id, turn, role, text, trim(coalesce(text, '')) AS b FROM conversations)),
p(conv_id, i, turn, used, fired) AS (SELECT conv_id, 0::BIGINT, NULL::BIGINT, 11, false FROM s GROUP BY conv_id UNION ALL SELECT s.conv_id, s.i, s.turn, CASE WHEN used + n <= 1200 THEN used + n ELSE used END, coalesce(used + n <= 1200, false) FROM p JOIN s ON s.conv_id = p.conv_id AND s.i = p.i + 1)
SELECT conv_id, turn, fired, used::INT AS used FROM p WHERE i > 0""")
def packing(s, d):
    rows = t(s, d, "conversations").select("conv_id", "turn", "role", "text")
    return seq.packed(rows, "conv_id", [F.col("turn"), F.col("role"), F.col("text")], "role", "text", F.lit(400), 1200, "# Situation").select("conv_id", "turn", "fired", "used")


# Events as JSON lines over several files, a broken one and a blank one after some; read back by byte ranges with their numbers.
_BAD = "event_id % 50 = 7"


@query("s03_numbered_entries", f"""WITH l AS (SELECT event_id, {_BAD} AS bad, row_number() OVER (ORDER BY event_id) + count(*) FILTER (WHERE {_BAD}) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS line_no FROM events)
SELECT line_no::BIGINT AS line_no, bad, CASE WHEN NOT bad THEN event_id END AS event_id FROM l""")
def numbered_entries(s, d):
    row = F.when(F.expr(_BAD), F.concat(F.lit("{broken "), F.col("event_id").cast("string"), F.lit("\n  "))).otherwise(F.to_json(F.struct("event_id", "value", "props")))
    home = new_dir(s, "entries")
    t(s, d, "events").repartitionByRange("event_id").sortWithinPartitions("event_id").select(row.alias("value")).write.text(home)
    rows = files.audited_entries(s, home, "event_id long, value double, props string", range_bytes=64 << 10)
    sizes = files.lines(s, home, 64 << 10).groupBy("path").agg(F.count(F.lit(1)).alias("n"))  # one row a file; files are in order of their names
    before = sizes.select(F.col("path").alias("of"), (F.sum("n").over(Window.orderBy("path")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), F.col("path") == F.col("of")).select((F.col("before") + F.col("line_no")).alias("line_no"), "bad", F.col("entry.event_id").alias("event_id"))


class Lines:
    """A table function: (line, n_words) of each line of a text, numbered from 0."""

    def eval(self, text: str):
        for i, line in enumerate((text or "").split("\n")):
            yield i, len([w for w in line.split(" ") if w])


@query("x11_table_function", "SELECT doc_id, i::INT AS line, len(list_filter(string_split(l, ' '), lambda w: w <> ''))::INT AS n_words FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)")
def table_function(s, d):
    s.udtf.register("corvane_text_lines", F.udtf(Lines, returnType="line int, n_words int", useArrow=True))
    t(s, d, "documents").createOrReplaceTempView("corvane_x11_documents")
    return s.sql("SELECT doc_id, l.line, l.n_words FROM corvane_x11_documents, LATERAL corvane_text_lines(text) AS l")


# What an update of a pipeline reports: an event's details with the expectations that its rows met or didn't, as one semi-structured value.
@query("f56_variant_explode", """SELECT event_id, user_id, 'r' || i::VARCHAR AS rule, CASE i WHEN 0 THEN value >= 20 WHEN 1 THEN event_type <> 'error' ELSE (props::JSON->>'$.k')::INT % 2 = 0 END AS met FROM events, range(3) r(i)""")
def variant_explode(s, d):
    k = F.get_json_object("props", "$.k").cast("int")
    rule = lambda i, met: F.struct(F.lit(f"r{i}").alias("name"), met.alias("met"))
    details = F.to_json(F.struct(F.array(rule(0, F.col("value") >= 20), rule(1, F.col("event_type") != "error"), rule(2, k % 2 == 0)).alias("expectations")))
    t(s, d, "events").select("event_id", "user_id", F.parse_json(details).alias("details")).createOrReplaceTempView("corvane_f56_events")
    return s.sql("""SELECT event_id, user_id, variant_get(e.value, '$.name', 'string') AS rule, variant_get(e.value, '$.met', 'boolean') AS met
 FROM corvane_f56_events, LATERAL variant_explode(variant_get(details, '$.expectations', 'variant')) AS e""")
