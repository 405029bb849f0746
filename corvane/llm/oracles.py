"""DuckDB SQL for the queries of this subpackage that SQL can express."""

#: Words of a text in DuckDB.
WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda w: w <> '')"

ORACLES: dict[str, str] = {}

ORACLES["op9_quality_rules"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: length(translate(l, ' ' || chr(9) || chr(11) || chr(12) || chr(13), '')) > 0) AS ls
  FROM documents),
win AS (SELECT r, unnest(range(1, len(w) - 6)) AS i, w FROM d WHERE len(w) >= 8),
wk AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS k FROM win),
rep AS (SELECT r, i FROM wk QUALIFY count(*) OVER (PARTITION BY r, k) >= 2),
gap AS (SELECT r, least(8, i - lag(i) OVER (PARTITION BY r ORDER BY i)) AS g FROM rep),
cov AS (SELECT r, sum(coalesce(g, 8))::BIGINT AS n FROM gap GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         len(ls) AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words, len(list_distinct(w)) AS n_distinct_words,
         len(regexp_extract_all(text, '[0-9]')) AS n_digits, len(regexp_extract_all(text, '\p{{Lu}}')) AS n_upper, len(regexp_extract_all(text, '\p{{Ll}}')) AS n_lower,
         len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09]*[-*\x{{2022}}]'))) AS n_bullet_lines,
         len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|\x{{2026}})[\x20\x09\x0D]*\z'))) AS n_ellipsis_lines,
         len(regexp_extract_all(text, 'https?://')) AS n_urls, len(regexp_extract_all(text, '[\x{{FFFD}}\x00-\x08]')) AS n_unreadable
  FROM d LEFT JOIN cov USING (r)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (n_symbols > 0.3 * n_words
         OR n_dup_lines > 0.6 * n_lines OR word_chars < 1.5 * n_words OR word_chars > 25.0 * n_words
         OR n_letter_words < 0.5 * n_words OR n_digits > 0.6 * word_chars OR n_upper > 0.6 * (n_upper + n_lower)
         OR (n_lines > 2 AND n_bullet_lines > 0.9 * n_lines) OR (n_lines > 2 AND n_ellipsis_lines > 0.5 * n_lines)
         OR n_urls > 0.2 * n_words OR n_unreadable > 0.05 * word_chars OR n_distinct_words < 0.02 * n_words) AS kept
FROM f
"""

ORACLES["op3_chat_prefix_tree"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
c AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum(length('<turn "' || role || '">') + 1 + length(regexp_replace(text, '\\|</?turn', 'x\0', 'g')) + length('</turn>') + 1)::BIGINT AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM c
"""

ORACLES["op6_mix_sources"] = f"""
WITH d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, list_extract(list_value(3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE), (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1) AS w, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
               / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, max(level) OVER () * w) AS target FROM l),
c AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY k, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM d),
b AS (SELECT c.*, source_size, target, round(target)::BIGINT AS budget FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size > 0 THEN (budget // source_size) * size + greatest(0, least(size, budget % source_size - (upto - size))) ELSE 0 END::BIGINT AS taken
FROM b
"""

ORACLES["op10_line_dedup"] = r"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host,
         list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script>|<style\b.*?</style>', '', 'g'), '<[^>]*>|\n'),
                     lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13))), lambda x: x <> '') AS ls FROM pages),
e AS (SELECT r, host, unnest(list_distinct(ls)) AS l FROM p),
n AS (SELECT host, l, count(*) AS n FROM e GROUP BY host, l),
h AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
b AS (SELECT n.host, list(l) AS bad FROM n JOIN h ON n.host IS NOT DISTINCT FROM h.host WHERE n >= 2 AND n > 0.3 * pages GROUP BY n.host),
k AS (SELECT page_id, p.host, len(ls)::BIGINT AS n_lines, CASE WHEN bad IS NULL THEN ls ELSE list_filter(ls, lambda x: NOT list_contains(bad, x)) END AS kept
      FROM p LEFT JOIN b ON p.host IS NOT DISTINCT FROM b.host)
SELECT page_id, host, n_lines, len(kept)::BIGINT AS n_kept, md5(array_to_string(kept, chr(10))) AS kept_md5 FROM k
"""

#: Links are found through shared rare shingles: of a set's shingles by document frequency, those before the
#: (n - ceil(0.9 n) + 1)th; both sides of a link share one of them.
ORACLES["op2_jaccard_join"] = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\f\r]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM d),
e AS (SELECT r, len(s) AS n, unnest(s) AS g FROM s),
f AS (SELECT g, count(*) AS df FROM e GROUP BY g),
p AS (SELECT r, n, g FROM e JOIN f USING (g) QUALIFY row_number() OVER (PARTITION BY r ORDER BY df, g) <= n - ceil(0.9 * n) + 1),
c AS (SELECT DISTINCT a.r AS a, b.r AS b FROM p a JOIN p b ON a.g = b.g AND a.r < b.r WHERE 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)),
k AS (SELECT a, b FROM c JOIN s x ON x.r = a JOIN s y ON y.r = b
      WHERE 190 * len(list_intersect(x.s, y.s)) >= 90 * (len(x.s) + len(y.s))),
l AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
t AS (SELECT r AS a, r AS b FROM d UNION SELECT t.a, l.b FROM t JOIN l ON t.b = l.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, m.component_id FROM s
JOIN (SELECT t.a, min(d.doc_id) AS component_id FROM t JOIN d ON t.b = d.r GROUP BY t.a) m ON m.a = s.r
"""
