"""The registered queries as DuckDB SQL, where SQL expresses them over whole tables."""

from __future__ import annotations

OP1 = r"""
WITH d AS (
    SELECT doc_id, nullif(source, '') AS host, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
           row_number() OVER () AS k
    FROM documents),
lines AS (
    SELECT k, unnest(string_split(text, chr(10))) AS line FROM d),
doubled AS (
    SELECT k, sum(n - 1)::BIGINT AS n_dup_lines
    FROM (SELECT k, line, count(*) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k, line) GROUP BY k),
places AS (
    SELECT k, i, list_aggregate(words[i:i + 7], 'string_agg', ' ') AS w
    FROM (SELECT k, words, unnest(generate_series(1, len(words) - 7)) AS i FROM d)),
often AS (
    SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, w) AS n FROM places) WHERE n > 1),
repeated AS (
    SELECT k, count(DISTINCT i + s) AS n_repeat_words FROM often, (SELECT unnest(range(8)) AS s) GROUP BY k),
c AS (
    SELECT d.k, doc_id, host, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
           (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
           coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
    FROM d LEFT JOIN doubled USING (k) LEFT JOIN repeated USING (k)),
j AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c),
h AS (SELECT host, count(*) AS n, sum(base_failed::INT) AS f FROM j WHERE host IS NOT NULL GROUP BY host),
m AS (SELECT avg(f / n) AS mean, var_pop(f / n) AS spread FROM h),
p AS (SELECT mean, CASE WHEN spread > 0 THEN least(1e6, greatest(0.0, mean * (1 - mean) / spread - 1)) ELSE 1e6 END AS strength FROM m),
v AS (SELECT host, (f + strength * mean) / (n + strength) > 0.5 AS host_failed FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(host_failed, FALSE) AS kept
FROM j LEFT JOIN v USING (host)
"""

OP2 = r"""
WITH e AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x
    FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.x, v.x), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM e AS q JOIN e AS v ON v.vec_id <> q.vec_id AND len(q.x) = len(v.x)
    WHERE q.vec_id % 20 = 0)
SELECT query_id::BIGINT AS query_id, rank::INTEGER AS rank, vec_id::BIGINT AS vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20
"""

OP5 = r"""
WITH given AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL
    SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
e AS (
    SELECT *, replace(replace(replace(replace(replace(text, '%', '%25'), '<s>', '%3Cs>'), '</s>', '%3C/s>'),
                              '[INST]', '%5BINST]'), '[/INST]', '%5B/INST]') AS body,
           replace(replace(replace(replace(replace(replace(role, '%', '%25'), '<s>', '%3Cs>'), '</s>', '%3C/s>'),
                              '[INST]', '%5BINST]'), '[/INST]', '%5B/INST]'), chr(10), '%0A') AS safe_role
    FROM given),
t AS (
    SELECT *, len(regexp_extract_all(body, '[^\x20\x09-\x0D]+')) AS words,
           length(safe_role) + length(body) + 8 + CASE WHEN safe_role = 'user' THEN 15 ELSE 0 END AS chars,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, safe_role, body) AS pos
    FROM e),
s AS (SELECT *, sum(words) OVER (PARTITION BY conv_id ORDER BY pos) AS total FROM t),
g AS (
    SELECT *, total - words AS begin,
           pos > 1 AND words > 0 AND total > words
           AND ((total - words) % 256 = 0 OR (total - words) // 256 <> greatest(total - 1, total - words) // 256) AS starts
    FROM s),
w AS (SELECT *, sum(starts::INT) OVER (PARTITION BY conv_id ORDER BY pos) AS win FROM g),
x AS (
    SELECT *, max(win) OVER (PARTITION BY conv_id) AS last_win,
           sum(words) OVER (PARTITION BY conv_id, win ORDER BY pos DESC) AS tail,
           first_value(CASE WHEN safe_role = 'system' THEN chars END IGNORE NULLS) OVER (
               PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS system_chars
    FROM w)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(chars) + coalesce(sum(chars) FILTER (win < last_win AND tail <= 96 AND safe_role <> 'system'), 0)
        + coalesce(sum(system_chars) FILTER (starts), 0))::BIGINT AS formatted_chars,
       (max(win) + 1)::BIGINT AS n_windows
FROM x GROUP BY conv_id
"""

OP3 = """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
p AS (SELECT k, x, unnest(generate_series(1, len(x) // 2 - 199)) AS i FROM d),
w AS (SELECT k, i, md5(substr(x, 2 * i - 1, 400)) AS h FROM p),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY h) AS n FROM w) WHERE n > 1),
e AS (
    SELECT k, i, i + 199 AS j,
           max(i + 199) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
    FROM r),
g AS (SELECT k, i, j, sum((before IS NULL OR before < i - 1)::INT) OVER (PARTITION BY k ORDER BY i) AS span FROM e),
s AS (SELECT k, span, min(i) AS a, max(j) AS b FROM g GROUP BY k, span),
f AS (
    SELECT k, span, a, b, coalesce(lag(b) OVER (PARTITION BY k ORDER BY a), 0) AS last_b FROM s),
c AS (
    SELECT d.k, string_agg(substr(x, 2 * last_b + 1, 2 * (a - 1 - last_b)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept,
           sum(b - a + 1) AS n_removed, count(*) AS n_spans
    FROM f JOIN d USING (k) GROUP BY d.k)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN c USING (k)
"""

OP10 = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(generate_series(1, len(words) - 19)) AS i FROM d),
w AS (SELECT doc_id, i, md5(list_aggregate(words[i:i + 19], 'string_agg', ' ')) AS h FROM p),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
g AS (SELECT DISTINCT doc_id, i + s AS i FROM r, (SELECT unnest(range(20)) AS s)),
t AS (SELECT doc_id, unnest(words) AS word, unnest(generate_series(1, len(words))) AS i FROM d),
k AS (
    SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.i) FILTER (g.i IS NULL) AS kept, count(*) FILTER (g.i IS NOT NULL) AS n_removed
    FROM t LEFT JOIN g USING (doc_id, i) GROUP BY t.doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

OP11 = r"""
WITH u AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, x) = 1),
s AS (
    SELECT a.vec_id AS anchor_id, v.vec_id, v.label = a.label AS same,
           list_sum(list_transform(list_zip(a.x, v.x), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM e AS a JOIN e AS v ON v.vec_id <> a.vec_id AND len(a.x) = len(v.x)
    WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
    SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
           row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id::BIGINT AS anchor_id, positive_id::BIGINT AS positive_id, rank::INTEGER AS rank, negative_id::BIGINT AS negative_id,
       positive_score, negative_score
FROM n WHERE rank <= 5
"""

# a walk over the rows of each conversation: the cheapest (cost, audit) of each state, with the repaired text it stands for
OP13 = r"""
WITH RECURSIVE crc_table AS (
    SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
        CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
hit AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                                          lambda c: ascii(c)::BIGINT),
                           lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) % 20 AS hit
    FROM conversations, crc_table),
damaged AS (
    SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
           CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM hit, range(CASE WHEN hit = 3 THEN 2 ELSE 1 END) WHERE hit <> 0),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM damaged),
judged AS (
    SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before,
           CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
                WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd'
                WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault
    FROM placed),
counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum((fault = 'b')::INT) AS blank,
           sum((fault = 'd')::INT) AS duplicate, sum((fault = 't')::INT) AS truncated,
           sum((before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au'))::INT) AS illegal, max(pos) AS n
    FROM judged GROUP BY conv_id),
-- insertions between two rows, and the edits of a row
idle AS (SELECT * FROM (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
                               (0, 2, 2, 'I', E'user:\n'), (0, 3, 4, 'II', E'user:\nassistant:\n'), (1, 2, 2, 'I', E'user:\n'),
                               (1, 3, 4, 'II', E'user:\nassistant:\n'), (2, 3, 2, 'I', E'assistant:\n'), (3, 2, 2, 'I', E'user:\n'))
                     v(p, q, cost, audit, lines)),
step AS (SELECT * FROM (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (2, 3, 'a'), (3, 2, 'u')) v(p, q, initial)),
moves AS (
    SELECT j.conv_id, j.pos, s.p, s.q, (CASE WHEN s.initial = j.initial THEN 0 ELSE 2 END) + (fault = 't')::INT AS cost,
           CASE WHEN s.initial = j.initial THEN 'K' ELSE 'R' END AS audit,
           CASE WHEN s.initial = j.initial THEN j.role WHEN s.initial = 'u' THEN 'user' ELSE 'assistant' END || ':' || j.text || chr(10) AS lines
    FROM judged j JOIN step s ON j.fault NOT IN ('b', 'd') AND (s.initial = j.initial OR s.initial <> 's')
    UNION ALL
    SELECT conv_id, pos, s.s, s.s, 3, 'D', '' FROM judged, range(4) AS s(s)),
walk AS (
    SELECT DISTINCT conv_id, 0::BIGINT AS pos, i.q, {'cost': i.cost, 'audit': i.audit, 'lines': i.lines} AS best
    FROM conversations, idle i WHERE i.p = 0
    UNION ALL
    SELECT conv_id, pos, q, min(best) FROM (
        SELECT w.conv_id, m.pos, i.q,
               {'cost': (w.best).cost + m.cost + i.cost, 'audit': (w.best).audit || m.audit || i.audit,
                'lines': (w.best).lines || m.lines || i.lines} AS best
        FROM walk w JOIN moves m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.pos = w.pos + 1 AND m.p = w.q JOIN idle i ON i.p = m.q)
    GROUP BY conv_id, pos, q),
ended AS (
    SELECT w.conv_id, min(best) AS best
    FROM walk w LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id
    WHERE q IN (0, 3) AND w.pos = coalesce(c.n, 0) GROUP BY w.conv_id)
SELECT e.conv_id::BIGINT AS conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       (best).cost::BIGINT AS cost, (best).audit AS audit, sha256((best).lines[:-2]) AS repaired_sha256
FROM ended e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""

ORACLES = {"op1_host_rules": OP1, "op2_norm_buckets": OP2, "op3_suffix_repeats": OP3, "op5_chat_windows": OP5, "op10_recompression": OP10,
           "op11_residue_negatives": OP11, "op13_grammar_repair": OP13}
