"""DuckDB SQL for the operators that SQL can express."""

from .quality_rules import PHRASES, SENTENCE_END, SEPARATORS, SYMBOLS

_STRIP = "E' \\t\\n\\x0b\\x0c\\r'"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT *, trim({_LOW.format('line')}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (key IN (SELECT key FROM f))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (key NOT IN (SELECT key FROM f)), '')) AS kept_sha256
FROM k GROUP BY doc_id"""

OP3 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, source_size * 3.0::DOUBLE AS cap FROM s),
v AS (SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE - (sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) - cap))
  / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, (SELECT max(level) FROM v) * weight) AS target FROM v),
m AS (SELECT source, size, count(*) AS m FROM d WHERE size > 0 GROUP BY ALL),
a AS (SELECT source, sum(size * m)::DOUBLE / sum(m) AS mean, min(size) AS least_size, list({'s': size::DOUBLE, 'm': m::DOUBLE}) AS cells FROM m GROUP BY source),
f AS (SELECT t.source, mean, cells, target, (CASE WHEN target < source_size THEN ln(target / source_size) ELSE ln(3.0) END) / (least_size / (least_size + mean)) AS far
  FROM t JOIN a ON t.source IS NOT DISTINCT FROM a.source WHERE target > 0 AND target < source_size * 3.0 * (1 - 1e-12)),
q AS (SELECT source, list_reduce(list_prepend({'low': least(far, 0.0), 'high': greatest(far, 0.0)}, list_transform(range(120), lambda i: {'low': 0.0::DOUBLE, 'high': 0.0::DOUBLE})),
    lambda x, i: CASE WHEN list_sum(list_transform(cells, lambda c: c.m * c.s * least(3.0, exp((x.low + x.high) / 2 * (c.s / (c.s + mean)))))) < target
      THEN {'low': (x.low + x.high) / 2, 'high': x.high} ELSE {'low': x.low, 'high': (x.low + x.high) / 2} END) AS b FROM f),
r AS (SELECT t.*, mean, (b.low + b.high) / 2 AS tau FROM t LEFT JOIN a ON t.source IS NOT DISTINCT FROM a.source LEFT JOIN q ON t.source IS NOT DISTINCT FROM q.source),
n AS (SELECT d.*, r.source_size, r.target, CASE WHEN size = 0 THEN 0 ELSE round(coalesce(least(3.0, exp(tau * (size / (size + mean)))), CASE WHEN target > 0 THEN 3.0 ELSE 0.0 END) * 1000000) END::BIGINT AS rate
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
k AS (SELECT *, sum(rate) OVER (PARTITION BY source ORDER BY size, substr(h, 1, 2), h, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT + 414200 AS summed FROM n)
SELECT doc_id, size, source_size, target, ((summed // 1000000 - (summed - rate) // 1000000) * size)::BIGINT AS taken
FROM k"""

OP5 = rf"""
WITH i AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
w AS (SELECT item, unnest([words[a : a + 9] FOR a IN range(1, greatest(len(words) - 9, 1) + 1)]) AS win FROM i WHERE len(words) > 0),
d AS (SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
z AS (SELECT DISTINCT len(win) AS long FROM w),
p AS (SELECT doc_id, long, unnest(range(1, len(words) - long + 2)) AS a, words FROM d, z WHERE len(words) >= long),
o AS (SELECT doc_id, a, long, item FROM (SELECT doc_id, a, long, words[a : a + long - 1] AS win FROM p) q JOIN w USING (win)),
h AS (SELECT doc_id, count(DISTINCT pos)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(a, a + long)) AS pos FROM o) GROUP BY doc_id),
g AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM o) GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN g USING (doc_id)"""

OP6 = rf"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) END AS s FROM t),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS m FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80 GROUP BY ALL),
l AS (SELECT a, b FROM c WHERE 100 * m >= 80 * (na + nb - m)),
r AS (SELECT doc_id AS a, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.a),
k AS (SELECT a AS doc_id, min(root) AS component_id FROM r GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN k USING (doc_id)"""

OP7 = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND list_bool_and([coalesce(isfinite(x), false) FOR x IN e]) AND list_bool_or([x <> 0 FOR x IN e])),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS root FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.a),
k AS (SELECT a AS vec_id, min(root) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM k LEFT JOIN n USING (vec_id)"""

# crc32 by the usual table of 256 remainders, which SQL computes.
_CRC_TABLE = """c AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))) AS tab)"""
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda x: ascii(x)::BIGINT)), lambda x, b: xor(x >> 8, tab[(xor(x, b) & 255) + 1])), 4294967295)"

_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
OP11 = f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '-' ELSE '=' || lang END AS g,
  {_FIELD.format('doc_id')} || {_FIELD.format('source')} || {_FIELD.format('lang')} AS a, n_chars, {_FIELD.format('text')} AS b,
  n_chars + CASE WHEN {_CRC.format('doc_id::VARCHAR')} % 7 = 0 THEN 1 ELSE 0 END AS claimed FROM documents, c),
l AS (SELECT doc_id, g, sha256(a || {_FIELD.format('n_chars')} || b) AS h, sha256(a || {_FIELD.format('claimed')} || b) AS x FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM l),
t AS (SELECT g, 0 AS k, i, n, h FROM p UNION ALL
  SELECT g, k + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY g, k, i // 2),
s AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS k, i, n, h FROM s UNION ALL
  SELECT k + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY k, i // 2),
f AS (SELECT doc_id, g, h AS leaf, 0 AS k, i, n, x, '' AS proof FROM p UNION ALL
  SELECT doc_id, f.g, leaf, f.k + 1, f.i // 2, (f.n + 1) // 2, sha256(CASE WHEN f.i % 2 = 0 THEN x || coalesce(t.h, '') ELSE t.h || x END), proof || coalesce(t.h, '')
  FROM f LEFT JOIN t ON t.g = f.g AND t.k = f.k AND t.i = xor(f.i, 1) WHERE f.n > 1),
v AS (SELECT doc_id, f.leaf, s.h AS subroot, 0 AS k, s.i, s.n, x, proof FROM f JOIN s ON f.g = s.g WHERE f.n = 1 UNION ALL
  SELECT doc_id, leaf, subroot, v.k + 1, v.i // 2, (v.n + 1) // 2, sha256(CASE WHEN v.i % 2 = 0 THEN x || coalesce(u.h, '') ELSE u.h || x END), proof || coalesce(u.h, '')
  FROM v LEFT JOIN u ON u.k = v.k AND u.i = xor(v.i, 1) WHERE v.n > 1)
SELECT doc_id, leaf, subroot, u.h AS root, sha256(proof) AS proof_sha256, x AS folded_root, x = u.h AS verified FROM v, u WHERE v.n = 1 AND u.n = 1"""

_W = r"[^\x20\x09-\x0D]+"
OP12 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_W}') AS w, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) AS gram FROM d),
r AS (SELECT doc_id, list(i) AS places FROM g GROUP BY doc_id, gram HAVING count(*) > 1),
n AS (SELECT doc_id, len(list_distinct(flatten(list(list_transform(places, lambda i: [i, i + 1, i + 2]).flatten()))))::BIGINT AS n_repeat_words FROM r GROUP BY doc_id),
l AS (SELECT doc_id, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM (SELECT doc_id, unnest(ls) AS line FROM d)),
v AS (SELECT doc_id, line, regexp_extract_all(line, '{_W}') AS w, {_LOW.format('line')} AS low FROM l WHERE line <> ''),
f AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x IN ({", ".join("'" + x + "'" for x in SEPARATORS)}))) AS sep,
    {" OR ".join(f"contains(low, '{p}')" for p in PHRASES)} AS phrase, regexp_matches(line, '{SENTENCE_END.replace("'", "''")}') AS ended,
    len(list_filter(w, lambda x: regexp_matches(x, '[{SYMBOLS}]{{2}}'))) AS signs, len(list_filter(w, lambda x: suffix(x, '!!'))) AS shouts FROM v),
b AS (SELECT doc_id, sum(n) FILTER ((sep >= 3 AND sep * 5 >= n) OR phrase OR NOT ended OR signs * 4 >= n OR shouts * 4 >= n)::BIGINT AS n_lost FROM f GROUP BY doc_id),
x AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars, len(regexp_extract_all(text, '[{SYMBOLS}]'))::BIGINT AS n_symbols,
    (len(list_filter(ls, lambda y: regexp_matches(y, '{_W}'))) - len(list_distinct(list_filter(ls, lambda y: regexp_matches(y, '{_W}')))))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lost, 0) AS n_lost FROM d LEFT JOIN n USING (doc_id) LEFT JOIN b USING (doc_id)),
y AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM x)
SELECT *, NOT base_failed AND n_lost * 100 <= n_words * 30 AND n_words - n_lost >= 50 AS kept FROM y"""



def _edit(state: str, cost: str, letter: str, line: str = "''", when: str = "true") -> str:
    """A state, ['0000000cost' || audit, repaired], and one more edit; null where the state or the condition is not there."""
    return f"CASE WHEN {state} IS NOT NULL AND {when} THEN [printf('%010d', left({state}[1], 10)::INT + {cost}) || substr({state}[1], 11) || '{letter}', {state}[2] || {line}] END"


_LINE, _NEW = "chr(10) || {0} || ':' || text", "chr(10) || '{0}:'"
_MAY, _PEN = "fault IN ('', 'truncated')", "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END"
#: States: e nothing yet, s system, u user, a assistant. Each step takes one row of every conversation.
OP13 = f"""
WITH RECURSIVE {_CRC_TABLE},
x AS (SELECT *, {_CRC.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations, c),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy,
  CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text FROM x WHERE k > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS r, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last FROM d),
m AS (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY r) > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  left(role, 1) AS i, coalesce(left(lag(role) OVER (PARTITION BY conv_id ORDER BY r), 1) || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS bad FROM o),
t AS (SELECT conv_id, 0 AS r, ['0000000000', ''] AS e, NULL::VARCHAR[] AS s, ['0000000005I', chr(10) || 'user:'] AS u, ['0000000010II', chr(10) || 'user:' || chr(10) || 'assistant:'] AS a FROM (SELECT DISTINCT conv_id FROM m) UNION ALL
  SELECT conv_id, r, e, s, u, list_min([a, {_edit('u', '5', 'I', _NEW.format('assistant'))}]) AS a FROM (
    SELECT conv_id, r, e, s, list_min([u, {_edit('q', '5', 'I', _NEW.format('user'))}]) AS u, a FROM (
      SELECT *, list_min([e, s, a]) AS q FROM (
        SELECT conv_id, r, {_edit('e', '2', 'D')} AS e,
          list_min([{_edit('s', '2', 'D')}, {_edit('e', _PEN, 'K', _LINE.format('role'), _MAY + " AND i = 's'")}]) AS s,
          list_min([{_edit('u', '2', 'D')}, {_edit('p', _PEN, 'K', _LINE.format('role'), _MAY + " AND i = 'u'")}, {_edit('p', _PEN + ' + 1', 'R', _LINE.format("'user'"), _MAY)}]) AS u,
          list_min([{_edit('a', '2', 'D')}, {_edit('u', _PEN, 'K', _LINE.format('role'), _MAY + " AND i = 'a'")}, {_edit('u', _PEN + ' + 1', 'R', _LINE.format("'assistant'"), _MAY)}]) AS a
        FROM (SELECT t.*, list_min([e, s, a]) AS p FROM t) t1 JOIN (SELECT conv_id AS mc, r AS mr, role, text, fault, i FROM m) m1 ON t1.conv_id IS NOT DISTINCT FROM m1.mc AND m1.mr = t1.r + 1))))""".replace("SELECT conv_id, r, CASE", "SELECT conv_id, mr AS r, CASE") + """,
z AS (SELECT conv_id, list_min([arg_max(e, r), arg_max(a, r)]) AS best FROM t GROUP BY conv_id),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (bad) AS illegal FROM m GROUP BY conv_id)
SELECT v.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(left(best[1], 10)::BIGINT, 0) AS cost, coalesce(substr(best[1], 11), '') AS audit, sha256(coalesce(substr(best[2], 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) v LEFT JOIN z ON v.conv_id IS NOT DISTINCT FROM z.conv_id LEFT JOIN g ON v.conv_id IS NOT DISTINCT FROM g.conv_id"""

ORACLES = {"op13_conversation_repair": OP13, "op12_quality_rules": OP12, "op11_merkle_manifest": OP11, "op7_embedding_near_dedup": OP7, "op1_line_dedup": OP1, "op3_mixing": OP3, "op5_decontamination": OP5, "op6_minhash_near_dedup": OP6}
