"""SQL for the queries of this subpackage that SQL can express."""

WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = f"""
WITH RECURSIVE doc AS (SELECT doc_id, {WORDS.format(_LOWER)} AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i : array_to_string(w[i : i + 4], ' ')))) END AS s FROM doc),
class AS (SELECT MIN(doc_id) AS cid, s FROM sets WHERE len(s) > 0 GROUP BY s),
flat AS (SELECT cid, len(s) AS n, unnest(s) AS g FROM class),
pair AS (SELECT x.cid AS a, y.cid AS b, COUNT(*) AS common, ANY_VALUE(x.n) AS na, ANY_VALUE(y.n) AS nb FROM flat x JOIN flat y ON x.g = y.g AND x.cid < y.cid GROUP BY 1, 2),
link AS (SELECT a, b FROM pair WHERE 100 * common >= 75 * (na + nb - common)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT cid AS node, cid AS root FROM class UNION SELECT e.b, r.root FROM reach r JOIN edge e ON e.a = r.node),
label AS (SELECT node, MIN(root) AS component FROM reach GROUP BY 1)
SELECT doc_id, len(sets.s) AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(cid, doc_id) AS set_id
FROM sets LEFT JOIN class ON sets.s = class.s LEFT JOIN label ON node = cid
"""

_DIGIT = "(instr('0123456789abcdef', substr(h, (5 * i) // 4 + {}, 1)) - 1)"
OP5 = f"""
WITH page AS (SELECT page_id, encode(coalesce(html, '')) AS p FROM pages),
digest AS (SELECT page_id, octet_length(p) AS size, sha1(p) AS h FROM page),
named AS (SELECT page_id, size, array_to_string(list_transform(range(32), lambda i : substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((({_DIGIT.format(1)} * 16 + {_DIGIT.format(2)}) >> CAST(3 - (5 * i) % 4 AS INT)) & 31), 1)), '') AS digest FROM digest),
best AS (SELECT *, MAX(page_id) OVER (PARTITION BY digest, size) AS top FROM named)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to FROM best
"""

OP7 = f"""
WITH doc AS (SELECT doc_id, row_number() OVER () AS r, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
start AS (SELECT r, unnest(range(1, len(w) - 33)) AS i FROM doc WHERE len(w) >= 35),
win AS (SELECT start.r, i, sha256(array_to_string(w[i : i + 34], ' ')) AS h FROM start JOIN doc USING (r)),
twice AS (SELECT r, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING COUNT(*) > 1)),
gone AS (SELECT r, list(DISTINCT j) AS spots FROM (SELECT r, unnest(range(i, i + 35)) AS j FROM twice) GROUP BY 1),
kept AS (SELECT doc_id, len(w) AS n_words, coalesce(len(spots), 0) AS n_removed, w, coalesce(spots, []) AS spots FROM doc LEFT JOIN gone USING (r))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(list_transform(list_filter(range(1, n_words + 1), lambda k : NOT list_contains(spots, k)), lambda k : w[k]), ' ')) AS kept_sha256 FROM kept
"""

_CRC32 = "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c : [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda s, x : xor(xor(s, x) >> 1, 3988292384 * (xor(s, x) & 1))), 4294967295)"
OP11 = f"""
WITH turn AS (SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, length(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL),
dict AS (SELECT k, row_number() OVER (ORDER BY k) AS id, ANY_VALUE(n) AS n FROM turn GROUP BY k),
own AS (SELECT conv_id, list(id ORDER BY turn NULLS FIRST, k) AS s FROM turn JOIN dict USING (k) GROUP BY 1),
conv AS (SELECT c.conv_id, {_CRC32.replace("conv_id", "c.conv_id")} % 6 AS h, c.s, b.s AS f FROM own c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100),
whole AS (SELECT conv_id, list_concat(coalesce(f, [])[1 : h], s[h + 1 :]) AS s FROM conv),
spot AS (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS depth FROM whole),
node AS (SELECT depth, s[1 : depth] AS path, MIN(conv_id) AS conv_id, COUNT(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(s) = depth), '')) AS ends_sha256 FROM spot GROUP BY 1, 2),
up AS (SELECT node.*, path[: depth - 1] AS above, coalesce(dict.n, 0) AS n FROM node LEFT JOIN dict ON dict.id = path[depth]),
kid AS (SELECT above AS path, COUNT(*) AS n_children FROM up WHERE depth > 0 GROUP BY 1),
full_node AS (SELECT up.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * n AS saves FROM up LEFT JOIN kid USING (path)),
anc AS (SELECT unnest(list_transform(range(0, depth + 1), lambda i : path[1 : i])) AS path, CASE WHEN n_children = 0 THEN 1 ELSE 0 END AS leaf, saves FROM full_node),
sums AS (SELECT path, SUM(leaf) AS n_leaves, SUM(saves) AS saved_tokens FROM anc GROUP BY 1)
SELECT x.conv_id, x.depth, p.conv_id AS parent_conv_id, x.n_convs, x.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, x.ends_sha256
FROM full_node x JOIN sums USING (path) LEFT JOIN full_node p ON x.depth > 0 AND p.path = x.above
"""

ORACLE = {"op11_conversation_trie": OP11, "op4_ngram_jaccard": OP4, "op5_arc_to_warc": OP5, "op7_recompression_dedup": OP7}
