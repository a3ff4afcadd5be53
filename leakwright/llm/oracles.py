"""SQL that gives the rows of those queries of this subpackage that SQL can express.

It has none for a learned classifier (1), mined rules (2), a knapsack (3), greedy
tiling (5) and a tokenizer (7); the tests hold those against brute force, an exact
round trip or held-out accuracy.
"""

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BARE = "trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13))"

EXACT = f"""WITH n AS (SELECT doc_id, {LOWER} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256 FROM n"""

TURN = "'<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10)"
PREFERENCE = f"""WITH own AS (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
last AS (SELECT conv_id, max(struct_pack(turn := turn, text := text)) AS last FROM own WHERE role = 'assistant' GROUP BY conv_id),
asked AS (SELECT a.conv_id, a.last.turn AS last_turn, b.last.text AS other FROM last a JOIN last b ON b.conv_id = a.conv_id + 1 - 2 * (a.conv_id % 2)),
both_sides AS (SELECT conv_id AS pair_id, 0 AS side, conv_id, turn, role, text FROM own
  UNION ALL SELECT o.conv_id, 1, -1 - o.conv_id, turn, role, CASE WHEN role = 'assistant' AND turn = last_turn THEN other ELSE text END FROM own o JOIN asked ON asked.conv_id = o.conv_id),
t AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos FROM both_sides),
a AS (SELECT * FROM t WHERE side = 0), b AS (SELECT * FROM t WHERE side = 1),
m AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.pos, b.pos) AS pos, a.pos IS NOT NULL AND b.pos IS NOT NULL AND a.role IS NOT DISTINCT FROM b.role AND a.text IS NOT DISTINCT FROM b.text AS same FROM a FULL JOIN b ON a.pair_id = b.pair_id AND a.pos = b.pos),
p AS (SELECT pair_id, coalesce(min(pos) FILTER (NOT same) - 1, count(*)) AS k FROM m GROUP BY pair_id),
r AS (SELECT t.pair_id, max(k) AS prefix_turns, max(conv_id) FILTER (side = 0) AS chosen_id, max(conv_id) FILTER (side = 1) AS rejected_id,
  coalesce(string_agg({TURN}, '' ORDER BY pos) FILTER (side = 0 AND pos <= k), '') AS prompt,
  string_agg({TURN}, '' ORDER BY pos) FILTER (side = 0 AND pos > k) AS c, string_agg({TURN}, '' ORDER BY pos) FILTER (side = 1 AND pos > k) AS j,
  sum(length(coalesce(text, '')) + 11) FILTER (side = 0 AND pos > k AND role = 'assistant') AS ct, sum(length(coalesce(text, '')) + 11) FILTER (side = 1 AND pos > k AND role = 'assistant') AS jt
  FROM t JOIN p ON p.pair_id = t.pair_id GROUP BY t.pair_id)
SELECT pair_id, chosen_id, rejected_id, prefix_turns, sha256(prompt) AS prompt_sha256, CASE WHEN chosen_id IS NOT NULL THEN sha256(coalesce(c, '')) END AS chosen_sha256, CASE WHEN rejected_id IS NOT NULL THEN sha256(coalesce(j, '')) END AS rejected_sha256,
  CASE WHEN chosen_id IS NOT NULL THEN coalesce(ct, 0)::BIGINT END AS chosen_trained, CASE WHEN rejected_id IS NOT NULL THEN coalesce(jt, 0)::BIGINT END AS rejected_trained FROM r"""

BLOCK_TAGS = "</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|meta|nav|ol|p|script|section|style|table|td|th|title|tr|ul)(?:[ /][^>]*)?>"
LINES = f"""WITH d AS (SELECT row_number() OVER () AS rid, page_id, lower(regexp_extract(url, '^[^:/?#]*://([^/?#]*)', 1)) AS host, string_split(regexp_replace(html, '{BLOCK_TAGS}', chr(10), 'gi'), chr(10)) AS ls FROM pages),
l AS (SELECT rid, host, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
c AS (SELECT host, {BARE} AS k, count(DISTINCT rid) AS n FROM l WHERE {BARE} <> '' GROUP BY ALL),
p AS (SELECT host, count(*)::DOUBLE AS pages FROM d GROUP BY host),
bad AS (SELECT c.host, k FROM c JOIN p ON p.host IS NOT DISTINCT FROM c.host WHERE n >= 3 AND n > pages * 0.2::DOUBLE),
kept AS (SELECT rid, string_agg(line, chr(10) ORDER BY i) AS s, count(*) AS k FROM l WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.host IS NOT DISTINCT FROM l.host AND bad.k = {BARE}) GROUP BY rid)
SELECT page_id, host, coalesce(len(ls), 0) AS n_lines, coalesce(len(ls), 0) - coalesce(k, 0) AS n_dropped, CASE WHEN ls IS NOT NULL THEN sha256(coalesce(s, '')) END AS kept_sha256 FROM d LEFT JOIN kept ON kept.rid = d.rid"""

PASSAGES = f"""WITH d AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50),
g AS (SELECT s.doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS k FROM s JOIN d ON d.doc_id = s.doc_id),
low AS (SELECT k, min(doc_id) AS first FROM g GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM g JOIN low ON low.k = g.k WHERE doc_id > first),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS s, count(*) AS n FROM words x LEFT JOIN gone y ON x.doc_id = y.doc_id AND x.i = y.i WHERE y.i IS NULL GROUP BY x.doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id"""

NEAR = f"""WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] WHEN len(w) = 1 THEN w ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM i JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
walk AS (SELECT x AS node, x AS seen FROM e UNION SELECT node, y FROM walk JOIN e ON x = seen),
k AS (SELECT node, min(seen) AS c FROM walk GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, d.doc_id = coalesce(c, d.doc_id) AS kept FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON node = d.doc_id"""

DIVERGENCE = r"""WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
g AS (SELECT DISTINCT lang, source FROM d), t AS (SELECT rid, lang, source, unnest(ts) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL), kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT rid) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang), s AS (SELECT c.* FROM c JOIN kept USING (lang, term)),
m AS (SELECT lang, source, sum(n) AS m FROM s GROUP BY ALL), lt AS (SELECT lang, term, sum(n) AS n FROM s GROUP BY ALL), lm AS (SELECT lang, sum(n) AS m FROM lt GROUP BY lang),
p AS (SELECT g.lang, g.source, k.term, coalesce(s.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(s.n, 0) + 5)) // (coalesce(m.m, 0) + 5 * v.v)::HUGEINT AS p
  FROM g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN m ON m.lang = g.lang AND m.source = g.source LEFT JOIN s ON s.lang = g.lang AND s.source = g.source AND s.term = k.term),
q AS (SELECT lt.lang, lt.term, 1 + (1000000000::HUGEINT * (lt.n + 5)) // (lm.m + 5 * v.v)::HUGEINT AS q FROM lt JOIN lm ON lm.lang = lt.lang JOIN v ON v.lang = lt.lang),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT p.lang, p.source, p.term AS item, (p.p - q.q)::BIGINT AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pairs
UNION ALL SELECT lang, source, 'term', item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM terms QUALIFY rank <= 50"""

CRC = "xor(list_reduce(list_concat([4294967295], [ascii(x) for x in string_split({}::VARCHAR, '')]), lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda z, k: xor(z >> 1, 3988292384 * (z & 1)))), 4294967295)"
RUNS = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {CRC.format("doc_id")} AS h, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
e AS (SELECT *, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS hit, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d), e2 AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM e),
x AS (SELECT rid, n, unnest(range(n)) AS i, unnest(CASE WHEN hit THEN [w[(CASE WHEN j < a THEN j ELSE a + (j - a) % p END) + 1] for j in range(n)] ELSE w END) AS word FROM e2),
five AS (SELECT rid, i, n, hash(word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS k, lead(word, 4) OVER o IS NOT NULL AS whole FROM x WINDOW o AS (PARTITION BY rid ORDER BY i)),
far AS (SELECT a.rid, a.i, b.i - a.i AS q, row_number() OVER (PARTITION BY a.rid, b.i - a.i ORDER BY a.i) AS r FROM five a JOIN five b ON a.rid = b.rid AND a.k = b.k AND a.i < b.i AND a.whole AND b.whole AND (b.i - a.i) * 4 <= a.n),
isle AS (SELECT rid, q, min(i) AS s, max(i) + 5 + q - min(i) AS l FROM far GROUP BY rid, q, i - r), long AS (SELECT * FROM isle WHERE l >= greatest(6, 4 * q)),
runs AS (SELECT * FROM long y WHERE NOT EXISTS (SELECT 1 FROM long z WHERE z.rid = y.rid AND z.q < y.q AND z.s <= y.s AND z.s + z.l >= y.s + y.l)),
gone AS (SELECT DISTINCT rid, unnest(range(s + q, s + l)) AS i FROM runs), left_over AS (SELECT x.rid, string_agg(word, ' ' ORDER BY x.i) AS t FROM x LEFT JOIN gone ON gone.rid = x.rid AND gone.i = x.i WHERE gone.i IS NULL GROUP BY x.rid),
best AS (SELECT rid, s, l, q FROM runs QUALIFY row_number() OVER (PARTITION BY rid ORDER BY l::DOUBLE / q DESC, s, q) = 1), listed AS (SELECT rid, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM runs GROUP BY rid)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, l AS length, q AS period, 1000 * l // q AS exponent_milli, sha256(coalesce(listed.t, '')) AS runs_sha256, sha256(coalesce(left_over.t, '')) AS collapsed_sha256
FROM d LEFT JOIN best ON best.rid = d.rid LEFT JOIN listed ON listed.rid = d.rid LEFT JOIN left_over ON left_over.rid = d.rid"""

SQL = {
    "op4_exact_dedup": EXACT,
    "op6_preference_formatting": PREFERENCE,
    "op8_line_dedup": LINES,
    "op9_substring_dedup": PASSAGES,
    "op10_chosen_path": NEAR,
    "op11_source_divergence": DIVERGENCE,
    "op13_periodic_runs": RUNS,
}
