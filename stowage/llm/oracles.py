"""DuckDB SQL of the queries that SQL can express. They are plain and quadratic where that is simplest: for small tables."""

from __future__ import annotations

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: The leftmost matches of each kind and the tokens; a text is what lies between the matches and the matches in turn.
OP3_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, source, lang, coalesce(text, '') AS t FROM documents
), patterns(kind, name, pattern, grp, least) AS (
  VALUES (0, 'assign', '(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([a-z0-9+/_.=-]+)', 2, 6),
         (1, 'access', 'AKIA[A-Z0-9]+', 0, 20),
         (2, 'hex', '[0-9a-f]+', 0, 24),
         (3, 'live', '[A-Za-z0-9+/_-]+', 0, 20)
), split AS (
  -- letters of assignments are there in either case, and ASCII case changes no place
  SELECT r, kind, x,
         CASE kind WHEN 0 THEN string_split_regex(x, '(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[a-z0-9+/_.=-]+')
                   WHEN 1 THEN string_split_regex(x, 'AKIA[A-Z0-9]+')
                   WHEN 2 THEN string_split_regex(x, '[0-9a-f]+')
                   ELSE string_split_regex(x, '[A-Za-z0-9+/_-]+') END AS gaps,
         CASE kind WHEN 0 THEN regexp_extract_all(x, '(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([a-z0-9+/_.=-]+)', 0)
                   WHEN 1 THEN regexp_extract_all(x, 'AKIA[A-Z0-9]+', 0)
                   WHEN 2 THEN regexp_extract_all(x, '[0-9a-f]+', 0)
                   ELSE regexp_extract_all(x, '[A-Za-z0-9+/_-]+', 0) END AS found,
         CASE kind WHEN 0 THEN regexp_extract_all(x, '(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([a-z0-9+/_.=-]+)', 2) END AS inner_text
  FROM (SELECT r, kind, CASE WHEN kind = 0 THEN translate(t, '{UPPER}', '{UPPER.lower()}') ELSE t END AS x FROM docs, patterns)
), matches AS (
  SELECT r, kind, unnest(found) AS value, unnest(gaps[:len(found)]) AS gap, unnest(coalesce(inner_text, found)) AS counted, generate_subscripts(found, 1) AS i
  FROM split WHERE len(found) > 0
), placed AS (
  SELECT r, kind, value, counted, i,
         sum(length(gap) + length(value)) OVER (PARTITION BY r, kind ORDER BY i)::BIGINT AS stop
  FROM matches
), spans AS (
  SELECT r, kind, name, value, counted, stop - length(value) AS start, stop FROM placed JOIN patterns USING (kind) WHERE length(counted) >= least
), tokens AS (
  SELECT r, start, stop, value FROM spans
  WHERE kind = 3 AND regexp_matches(value, '[0-9].*[0-9]') AND regexp_matches(value, '[A-Za-z].*[A-Za-z]')
), candidates AS (
  -- a value ends where its match ends
  SELECT r, start, stop, value, bool_or(token) AS token FROM (
    SELECT r, start, stop, value, true AS token FROM tokens
    UNION ALL SELECT r, stop - length(counted), stop, substr(t, (stop - length(counted) + 1)::BIGINT, length(counted)), false FROM spans JOIN docs USING (r) WHERE kind < 3)
  GROUP BY ALL
), held AS (
  -- rows of one text have one repository between them
  SELECT t, value, min(coalesce('1' || source, '0') || chr(1) || coalesce('1' || lang, '0')) AS repository FROM candidates JOIN docs USING (r) GROUP BY ALL
), owners AS (
  SELECT value, count(DISTINCT split_part(repository, chr(1), 1)) AS n_owners, count(DISTINCT repository) AS n_repositories FROM held GROUP BY value
), judged AS (
  SELECT *, n_owners <= 7 OR n_repositories <= 9 AS live FROM candidates JOIN owners USING (value)
), marked AS (
  SELECT r, kind, name, start, stop FROM spans WHERE kind < 3
  UNION ALL SELECT r, 3, 'live', start, stop FROM judged WHERE token AND live
), sums AS (
  SELECT r,
         count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop) FILTER (kind < 3) AS base,
         string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop) AS spans
  FROM marked GROUP BY r
), verdicts AS (
  SELECT r, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example,
         string_agg(start || ':' || stop || ':' || n_owners || ':' || n_repositories, ',' ORDER BY start, stop) AS ownership
  FROM judged GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(ownership, '') AS ownership
FROM docs LEFT JOIN sums USING (r) LEFT JOIN verdicts USING (r)
"""


#: Every alignment of a document and an item with enough equal words, however they lie; of each the longest stretch with 0.8 equal counts.
OP4_SQL = r"""
WITH items AS (
  SELECT row_number() OVER () AS k, w, ids FROM (
    SELECT w, list(DISTINCT coalesce(item_id::VARCHAR, '')) AS ids
    FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark)
    WHERE len(w) > 0 GROUP BY w)
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents
), item_words AS (
  SELECT k, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM items
), doc_words AS (
  SELECT r, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS p FROM docs
), aligned AS (
  SELECT r, k, p - i AS shift FROM doc_words JOIN item_words USING (x)
  GROUP BY r, k, n, p - i HAVING 10 * count(*) >= 8 * least(n, 12)
), places AS (
  SELECT r, k, shift, i.w AS iw, d.w AS dw, unnest(range(greatest(0, -shift), least(len(i.w), len(d.w) - shift))) AS i
  FROM aligned JOIN items i USING (k) JOIN docs d USING (r)
), equal AS (
  SELECT r, k, shift, i, row_number() OVER (PARTITION BY r, k, shift ORDER BY i) AS n FROM places WHERE iw[i + 1] = dw[i + shift + 1]
), stretches AS (
  SELECT r, k, shift, a.i + shift AS first_word, b.i - a.i + 1 AS n_words, b.n - a.n + 1 AS n_equal
  FROM equal a JOIN equal b USING (r, k, shift)
  WHERE a.i <= b.i AND 10 * (b.n - a.n + 1) >= 8 * (b.i - a.i + 1)
), longest AS (
  SELECT * FROM stretches QUALIFY row_number() OVER (PARTITION BY r, k, shift ORDER BY n_words DESC, first_word DESC) = 1
), best AS (
  SELECT doc_id, ids, first_word, n_words, n_equal FROM longest JOIN items USING (k) JOIN docs USING (r)
  WHERE n_words >= least(len(items.w), 12)
  QUALIFY row_number() OVER (PARTITION BY r, k ORDER BY n_words DESC, n_equal DESC, first_word) = 1
)
SELECT doc_id, try_cast(item AS BIGINT) AS item_id, first_word, n_words, n_equal FROM (SELECT *, unnest(ids) AS item FROM best)
"""

#: Windows are filled turn by turn; what each shows is its turns, the system turn and the history before it, as the room goes.
OP5_SQL = r"""
WITH RECURSIVE source AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
), turns AS (
  -- control strings, a backslash for each backslash, bar after < and line end in a role
  SELECT *, '<|im_start|>' || replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\' || chr(10)) || chr(10) || replace(replace(text, '\', '\\'), '<|', '<\|') || '<|im_end|>' || chr(10) AS shown,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS g
  FROM source
), counted AS (
  SELECT *, strlen(shown) AS tokens, length(shown) AS chars, g // 256 AS s FROM turns
), systems AS (
  SELECT conv_id, tokens, chars FROM counted WHERE g = 0 AND role = 'system'
), numbered AS (
  SELECT c.*, coalesce(y.tokens, 0) AS system_tokens, coalesce(y.chars, 0) AS system_chars, y.conv_id IS NOT NULL AS has_system FROM counted c LEFT JOIN systems y USING (conv_id)
), filled AS (
  SELECT conv_id, g, g AS head, tokens AS used FROM numbered WHERE g % 256 = 0
  UNION ALL
  SELECT n.conv_id, n.g, CASE WHEN fits THEN f.head ELSE n.g END, CASE WHEN fits THEN f.used + n.tokens ELSE n.tokens END
  FROM filled f JOIN numbered n ON n.conv_id = f.conv_id AND n.g = f.g + 1 AND n.g % 256 > 0,
       LATERAL (SELECT f.used + n.tokens <= 2048 - 512 - CASE WHEN f.head = 0 THEN 0 ELSE n.system_tokens END AS fits)
), spans AS (
  SELECT conv_id, head, max(used) AS used FROM filled GROUP BY ALL
), rooms AS (
  SELECT conv_id, head, n.s, n.has_system, CASE WHEN head = 0 THEN 0 ELSE n.system_chars END AS system_chars,
         2048 - used - CASE WHEN head = 0 THEN 0 ELSE n.system_tokens END AS room
  FROM spans JOIN numbered n USING (conv_id) WHERE n.g = head
), history AS (
  SELECT b.conv_id, b.room, h.chars, sum(h.tokens) OVER (PARTITION BY b.conv_id, b.head ORDER BY h.g DESC) AS total
  FROM rooms b JOIN numbered h ON h.conv_id = b.conv_id AND h.g BETWEEN b.head - 8 AND b.head - 1 AND h.s >= b.s - 1
  WHERE NOT (h.g = 0 AND b.has_system)
), shown AS (
  SELECT conv_id, chars FROM numbered
  UNION ALL SELECT conv_id, chars FROM history WHERE total <= least(512, room)
  UNION ALL SELECT conv_id, system_chars FROM rooms WHERE room >= 0
), sizes AS (
  SELECT conv_id, sum(chars)::BIGINT AS formatted_chars FROM shown GROUP BY conv_id
), texts AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY g) AS everything,
         coalesce(string_agg(text, '' ORDER BY g) FILTER (role = 'assistant'), '') AS loss
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(everything) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM texts JOIN sizes USING (conv_id)
"""

OP7_SQL = rf"""
WITH split AS (
  SELECT page_id,
         CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), '{UPPER}', '{UPPER.lower()}') AS host,
         regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path
  FROM split
), rules(verdict, rule_host, rule_path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fits AS (
  SELECT page_id, host, path, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS place
  FROM parts LEFT JOIN rules
    ON (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE place = 1
"""

#: Documents with equal shingles are one class; classes meet in their shingles.
OP8_SQL = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS g
  FROM docs
), classes AS MATERIALIZED (
  SELECT min(doc_id) AS c, g, len(g) AS n FROM sets WHERE len(g) > 0 GROUP BY g
), grams AS MATERIALIZED (
  SELECT c, n, hash(unnest(g)) AS x FROM classes
), links AS MATERIALIZED (
  SELECT a.c AS a, b.c AS b FROM grams a JOIN grams b USING (x)
  WHERE a.c < b.c AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), ways AS MATERIALIZED (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(a, b) AS (
  SELECT c, c FROM classes
  UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a
), components AS (
  SELECT a AS c, min(b) AS component_id FROM reach GROUP BY a
)
SELECT s.doc_id, len(s.g) AS n_shingles, coalesce(component_id, s.doc_id) AS component_id
FROM sets s LEFT JOIN classes k ON s.g = k.g LEFT JOIN components USING (c)
"""

ORACLES = {
    "op3_secret_scans": OP3_SQL,
    "op4_decontamination": OP4_SQL,
    "op5_chat_format": OP5_SQL,
    "op7_url_filters": OP7_SQL,
    "op8_jaccard_join": OP8_SQL,
}
