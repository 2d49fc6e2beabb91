"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BLANK_WORDS = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
ITEM_WORDS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP7 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, {BLANK_WORDS.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
raw AS (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d),
lines AS (SELECT *, trim(regexp_replace(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), '\b[0-9]+\b', '0', 'g')) AS plain FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
over AS (SELECT source, plain, min(doc_id) AS first_id FROM lines GROUP BY source, plain HAVING count(DISTINCT doc_id) > 20),
gone AS (SELECT doc_id, sum(len(string_split(l.plain, ' '))) AS n FROM lines l JOIN over o ON o.source IS NOT DISTINCT FROM l.source AND o.plain = l.plain WHERE doc_id <> first_id GROUP BY doc_id),
j AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS removed_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - removed_words) >= 50 * n_words AS kept FROM j"""

OP8 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
m AS (SELECT h, max(page_id) AS last FROM p GROUP BY h),
b AS (SELECT p.*, last, CAST(unhex(sha1(p.h)) AS BIT)::VARCHAR AS bits FROM p JOIN m ON m.h = p.h)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST(list_sum(list_transform(range(0, 5), lambda k: CAST(substr(bits, CAST(5 * i + k + 1 AS BIGINT), 1) AS INT) * (16 // CAST(pow(2, k) AS INT)))) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN last = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN last <> page_id THEN last END AS refers_to
FROM b"""

OP9 = rf"""
WITH d AS (SELECT doc_id, {ITEM_WORDS.format(LOWER.format('text'))} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {ITEM_WORDS.format(LOWER.format('text'))} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[k:k + least(13, len(w)) - 1], ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS gram FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes)),
hit AS (SELECT doc_id, k, dw.n, item FROM dw JOIN bw ON bw.n = dw.n AND bw.gram = dw.gram),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

OP10 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {BLANK_WORDS.format(LOWER.format('text'))} AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2])))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.size + q.size - c)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id AS a, doc_id AS z FROM documents UNION SELECT reach.a, edge.y FROM reach JOIN edge ON edge.x = reach.z),
comp AS (SELECT a AS doc_id, min(z) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(size, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM comp LEFT JOIN n USING (doc_id)"""

TERMS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, {TERMS.format(LOWER.format('text'))} AS w FROM documents),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest({TERMS.format(LOWER.format('text'))}) AS term FROM benchmark),
t AS (SELECT row_id, doc_id, len(w) AS n, unnest(w) AS term FROM d),
tf AS (SELECT row_id, doc_id, n, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM df, s),
part AS (SELECT row_id, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms)) AS share FROM tf, s),
score AS (SELECT item_id, row_id, doc_id, CAST(sum(w * share) AS BIGINT) AS score FROM part JOIN w USING (term) JOIN q USING (term) GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM score WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10"""

OP13 = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER.format('text')}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT lang, w, unnest([1, 2, 3, 4]) AS m FROM w) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m >= 2),
cut AS (SELECT *, array_to_string(w[1:k], ' ') AS part, array_to_string(w[k + 1:m], ' ') AS rest FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
s AS (SELECT cut.lang, cut.phrase, a, k, x.f AS l, y.f AS r, CAST((CAST(2000000 AS HUGEINT) * a) // (x.f + y.f) AS BIGINT) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = cut.part JOIN f y ON y.lang = cut.lang AND y.phrase = cut.rest),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
sub AS (SELECT lang, a, array_to_string(w[i:i + j - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, m - j + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS j FROM c WHERE m > 2))),
around AS (SELECT lang, phrase, max(a) AS around FROM sub GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN around o ON o.lang = low.lang AND o.phrase = low.phrase WHERE o.around IS NULL OR CAST(100 AS HUGEINT) * o.around < CAST(80 AS HUGEINT) * a),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r.r AS r, n, score FROM r JOIN n USING (lang) WHERE rank <= 2000"""
