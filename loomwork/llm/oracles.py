"""DuckDB statements of the same results, for the queries that SQL can express."""

_WORDS = r"list_filter(string_split_regex(coalesce({t}, ''), '[ \t-\r]+'), lambda w: w <> '')"
_LN2 = "0.6931471805599453"

OP1 = rf"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, lang, coalesce(text, '') AS text, {_WORDS.format(t="text")} AS words FROM documents),
c AS (
  SELECT row_id, doc_id, lang, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(text) AS n_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    length(regexp_replace(text, '[^\p{{Ll}}]', '', 'g')) AS c1, length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) AS c2,
    length(regexp_replace(text, '[^\p{{Nd}}]', '', 'g')) AS c3, length(regexp_replace(text, '[^ \t-\r]', '', 'g')) AS c4,
    length(regexp_replace(text, '[^.,;:!?''"()\-]', '', 'g')) AS c5
  FROM d),
l AS (SELECT row_id, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (SELECT row_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^ \t-\r]') GROUP BY row_id),
win AS (
  SELECT row_id, i, array_to_string(list_slice(words, i, i + 7), chr(1)) AS w
  FROM (SELECT row_id, words, unnest(range(1, greatest(1, len(words) - 6))) AS i FROM d)),
twice AS (SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, w) AS c FROM win) WHERE c > 1),
rep AS (
  SELECT row_id, sum(least(8, i - prev)) AS n_repeat_words
  FROM (SELECT row_id, i, coalesce(lag(i) OVER (PARTITION BY row_id ORDER BY i), i - 8) AS prev FROM twice) GROUP BY row_id),
tok AS (SELECT row_id, lang, unnest(words) AS w FROM d WHERE lang IS NOT NULL),
sums AS (
  SELECT lang, sum(n_words) AS rw, sum(n_chars) AS rc, sum(c1) AS r1, sum(c2) AS r2, sum(c3) AS r3, sum(c4) AS r4, sum(c5) AS r5
  FROM c WHERE lang IS NOT NULL GROUP BY lang HAVING sum(n_words) >= 1000),
top AS (
  SELECT t.lang, w, n, n / rw AS q FROM (
    SELECT lang, w, n, rank() OVER (PARTITION BY lang ORDER BY n DESC) AS r
    FROM (SELECT lang, w, count(*) AS n FROM tok GROUP BY lang, w)) t JOIN sums USING (lang) WHERE r <= 50 AND n * 1000 >= rw),
tops AS (SELECT lang, count(*) AS k, sum(q) AS q, 1 - sum(q) AS rest_q FROM top GROUP BY lang),
hit AS (SELECT row_id, tok.lang, tok.w, count(*) AS n, any_value(q) AS q FROM tok JOIN top ON tok.lang = top.lang AND tok.w = top.w GROUP BY row_id, tok.lang, tok.w),
seen AS (
  SELECT row_id, sum(n) AS n, sum(q) AS q,
    sum((n / n_words * log2(2 * (n / n_words) / (n / n_words + q)) + q * log2(2 * q / (n / n_words + q))) / 2) AS js
  FROM hit JOIN (SELECT row_id, n_words FROM c) USING (row_id) GROUP BY row_id),
m AS (
  SELECT c.*, sums.* EXCLUDE (lang), tops.k, tops.rest_q, tops.q - coalesce(seen.q, 0) AS unseen, coalesce(seen.js, 0) AS js,
    (n_words - coalesce(seen.n, 0)) / n_words AS rest_p
  FROM c LEFT JOIN sums USING (lang) LEFT JOIN tops USING (lang) LEFT JOIN seen USING (row_id)),
x AS (
  SELECT *, unnest([1]) AS one,
    list_sum(list_transform([[c1 / n_chars, r1 / rc], [c2 / n_chars, r2 / rc], [c3 / n_chars, r3 / rc], [c4 / n_chars, r4 / rc], [c5 / n_chars, r5 / rc],
      [(n_chars - c1 - c2 - c3 - c4 - c5) / n_chars, (rc - r1 - r2 - r3 - r4 - r5) / rc]],
      lambda p: (CASE WHEN p[1] > 0 THEN p[1] * log2(2 * p[1] / (p[1] + p[2])) ELSE 0 END + CASE WHEN p[2] > 0 THEN p[2] * log2(2 * p[2] / (p[1] + p[2])) ELSE 0 END) / 2))
      - 5 / (8 * {_LN2} * n_words) AS char_js,
    js + unseen / 2 + (CASE WHEN rest_p > 0 THEN rest_p * log2(2 * rest_p / (rest_p + rest_q)) ELSE 0 END
      + CASE WHEN rest_q > 0 THEN rest_q * log2(2 * rest_q / (rest_p + rest_q)) ELSE 0 END) / 2 - k / (8 * {_LN2} * n_words) AS word_js
  FROM m),
v AS (
  SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    n_chars, char_js, word_js, rw
  FROM x LEFT JOIN lines USING (row_id) LEFT JOIN rep USING (row_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
    AND (rw IS NULL OR n_chars < 100 OR sqrt(greatest(char_js, 0)) <= 0.30)
    AND (rw IS NULL OR n_words < 50 OR sqrt(greatest(word_js, 0)) <= 0.30) AS kept
FROM v
"""

OP2 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html)
SELECT page_id, strlen(p.html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + list_sum(list_transform(range(0, 5), lambda b:
      ((strpos('0123456789abcdef', substr(sha1(p.html), ((5 * i + b) // 4 + 1)::INT, 1)) - 1)
        // (8 >> ((5 * i + b) % 4)::INT)) % 2 * (16 >> b::INT)))::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (html)
"""

_SIX = "replace(coalesce({}, ''), '\\', '\\\\')"
_CONTROLS = r"<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>"

OP6 = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
w AS (
  SELECT *, length(regexp_replace({_SIX.format('text')}, '({_CONTROLS})', '\\1+', 'g')) AS text_chars,
    length(replace(regexp_replace({_SIX.format('role')}, '({_CONTROLS})', '\\1+', 'g'), chr(10), '\\n')) AS role_chars
  FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>') + role_chars + 1 + text_chars + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM w GROUP BY conv_id
"""

OP7 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda w: w <> '') AS w
  FROM (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
s AS (
  SELECT row_number() OVER () AS row_id, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, chr(1))]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2])) END AS x FROM d),
k AS (SELECT doc_id, x, len(x) AS n, md5(array_to_string(list_sort(x), chr(2))) AS f FROM s),
r AS (SELECT f, any_value(x) AS x, any_value(n) AS n, min(doc_id) AS id FROM k WHERE n > 0 GROUP BY f),
g AS (SELECT id, n, unnest(x) AS h FROM r),
p AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS both_ FROM g a JOIN g b ON a.h = b.h AND a.id < b.id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * both_ >= 85 * (na + nb - both_)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l UNION SELECT doc_id, id FROM k JOIN r USING (f) UNION SELECT id, doc_id FROM k JOIN r USING (f)),
c(node, root) AS (SELECT DISTINCT doc_id, doc_id FROM k UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.node WHERE c.root < e.b),
m AS (SELECT node, min(root) AS root FROM c GROUP BY node)
SELECT k.doc_id, k.n::BIGINT AS n_shingles, CASE WHEN k.n > 0 THEN m.root ELSE k.doc_id END AS component_id, k.n = 0 OR m.root = k.doc_id AS kept FROM k JOIN m ON m.node = k.doc_id
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = rf"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
c AS (SELECT item, least(len(w), 10) AS len, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda a: array_to_string(w[a : a + least(len(w), 10) - 1], ' '))) AS s FROM i WHERE len(w) > 0),
l AS (SELECT DISTINCT len FROM c),
o AS (
  SELECT row_id, a, len, array_to_string(w[a : a + len - 1], ' ') AS s
  FROM (SELECT row_id, w, len, unnest(range(1, len(w) - len + 2)) AS a FROM d, l WHERE len(w) >= len)),
h AS (SELECT DISTINCT row_id, a, o.len, item FROM o JOIN c ON o.s = c.s AND o.len = c.len),
n AS (SELECT row_id, count(*) AS n_hit FROM (SELECT DISTINCT row_id, unnest(range(a, a + len)) AS p FROM h) GROUP BY row_id),
t AS (SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row_id, item FROM h) GROUP BY row_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (row_id) LEFT JOIN t USING (row_id)
"""


def _assigned(n: int) -> str:
    """Nearest entries of every part under codebook ``n``: row, part, the part, [distance, entry]."""
    return f"""a{n} AS (
  SELECT r, p.part, any_value(x) AS x, min([list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, k]) AS best
  FROM p JOIN c{n} ON p.part = c{n}.part GROUP BY r, p.part)"""


def _averaged(n: int) -> str:
    """The codebook after codebook ``n``."""
    return f"""s{n} AS (
  SELECT part, k, list((s - (s % n + n) % n) // n ORDER BY i) AS c
  FROM (SELECT part, best[2] AS k, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM (SELECT part, best, x, unnest(range(1, len(x) + 1)) AS i FROM a{n}) GROUP BY ALL) GROUP BY part, k),
c{n + 1} AS (SELECT c{n}.part, c{n}.k, coalesce(s{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN s{n} ON c{n}.part = s{n}.part AND c{n}.k = s{n}.k)"""


OP12 = f"""
WITH e AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, vec_id, label, v
  FROM (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
p AS (SELECT r, part, v[len(v) // 16 * part + 1 : len(v) // 16 * (part + 1)] AS x FROM (SELECT r, v, unnest(range(16)) AS part FROM e)),
c0 AS (SELECT part, r - 1 AS k, x AS c FROM p WHERE r <= 64),
{_assigned(0)}, {_averaged(0)}, {_assigned(1)}, {_averaged(1)}, {_assigned(2)},
o AS (SELECT r, string_agg(printf('%02x', best[2]), '' ORDER BY part) AS code, sum(best[1])::BIGINT AS error FROM a2 GROUP BY r),
f AS (SELECT e.vec_id, label, code, error FROM o JOIN e USING (r)),
l AS (SELECT label, sum(error)::BIGINT AS label_error FROM f GROUP BY label),
b AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, k)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, label_error, codebooks_sha256 FROM f JOIN l ON f.label IS NOT DISTINCT FROM l.label, b
"""

_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, {_TERMS} AS w FROM documents),
i AS (SELECT row_number() OVER () AS query, item_id, {_TERMS} AS w FROM benchmark),
q AS (SELECT DISTINCT query, term FROM (SELECT query, unnest(w) AS term FROM i)),
s AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d),
p AS (SELECT row_id, term, n, count(*) AS tf FROM (SELECT row_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
t AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s WHERE term IN (SELECT term FROM q) GROUP BY term),
x AS (SELECT query, row_id, sum(t.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN t USING (term) JOIN p USING (term), s GROUP BY query, row_id),
r AS (SELECT query, doc_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM x JOIN d USING (row_id) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r JOIN i USING (query) WHERE rank <= 10
"""
