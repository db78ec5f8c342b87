"""DuckDB SQL for the queries that SQL can express, written apart from the operators."""

from __future__ import annotations

_OP4 = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), seen AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before_,
    lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS after_,
    length(text) + length(regexp_replace(text, '[^\\]', '', 'g'))
      + (SELECT sum((length(text) - length(replace(text, c, ''))) // length(c)) FROM (VALUES ('<<SYS>>'), ('<</SYS>>'), ('[INST]'), ('[/INST]'), ('<s>'), ('</s>'), ('<|end|>'), ('<|'), ('|>')) v(c)
         WHERE NOT (c = '<|' AND contains(text, '<|end|>')) AND NOT (c = '|>' AND contains(text, '<|end|>'))) AS escaped
  FROM rows_
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(escaped + CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 16 WHEN 'assistant' THEN 8 ELSE 12 + length(role) END)::BIGINT AS formatted_chars,
  bool_and(CASE WHEN before_ IS NULL THEN role IN ('system', 'user')
                WHEN before_ = 'system' THEN role = 'user'
                WHEN before_ = 'user' THEN role = 'assistant'
                WHEN before_ = 'assistant' THEN role = 'user' ELSE false END
           AND (after_ IS NOT NULL OR role = 'assistant')) AS valid
FROM seen GROUP BY conv_id
"""


_OP6 = r"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS (SELECT item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL),
items AS (SELECT item_id, w, least(len(w), 10) AS n FROM bw WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1 : i + n], ' ') AS k FROM (SELECT item_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM items)),
sizes AS (SELECT DISTINCT n FROM items),
spots AS (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS k FROM (SELECT doc_id, n, w, unnest(range(len(w) - n + 1)) AS i FROM dw, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM spots JOIN windows USING (n, k)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item COLLATE "C") AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_OP8 = r"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
spots AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 13], ' ') AS k FROM (SELECT doc_id, w, unnest(range(len(w) - 12)) AS i FROM dw WHERE len(w) >= 13)),
least_ AS (SELECT k, min(doc_id) AS owner FROM spots GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM spots JOIN least_ USING (k) WHERE doc_id > owner),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM dw),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM dw LEFT JOIN kept USING (doc_id)
"""

#: Components over ``nodes(id)`` and ``links(a, b)``, both ways: the smallest id that is reached.
_REACHED = "reach AS (SELECT id AS a, id AS root FROM nodes UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.a), roots AS (SELECT a AS id, min(root) AS root FROM reach GROUP BY a)"

_OP7 = rf"""
WITH RECURSIVE sound AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM sound x JOIN sound y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= 0.98),
nodes AS (SELECT DISTINCT a AS id FROM links), {_REACHED}, counts AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(root, vec_id)::BIGINT AS component_id, coalesce(root, vec_id) = vec_id AS kept FROM embeddings e LEFT JOIN roots r ON r.id = vec_id LEFT JOIN counts c ON c.id = vec_id
"""

_OP9 = rf"""
WITH RECURSIVE dw AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
reps AS (SELECT w, min(doc_id) AS rep FROM dw WHERE len(w) > 0 GROUP BY w),
shingles AS (SELECT rep, s, count(*) AS c FROM (SELECT rep, array_to_string(w[i + 1 : i + 5], ' ') AS s FROM (SELECT rep, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM reps)) GROUP BY ALL),
totals AS (SELECT rep, sum(c) AS n FROM shingles GROUP BY rep),
shares AS (SELECT rep, s, c, c / n AS p FROM shingles JOIN totals USING (rep)),
pairs AS (SELECT x.rep AS a, y.rep AS b FROM shares x JOIN shares y ON x.s = y.s AND x.rep < y.rep GROUP BY ALL HAVING sum(least(x.p, y.p)) >= 0.8 - 1e-9),
every_ AS (SELECT a, b, s, max(CASE WHEN x.rep = a THEN c ELSE 0 END) AS ca, max(CASE WHEN x.rep = b THEN c ELSE 0 END) AS cb FROM pairs JOIN shares x ON x.rep IN (a, b) GROUP BY a, b, s),
kinds AS (SELECT a, b, ca, cb, count(*) AS n FROM every_ GROUP BY ALL),
near_ AS (SELECT a, b FROM (SELECT i.a, i.b, i.ca, i.cb, any_value(i.n) / sum(greatest(j.ca / i.ca, j.cb / i.cb) * j.n) AS part FROM kinds i JOIN kinds j ON i.a = j.a AND i.b = j.b WHERE i.ca > 0 AND i.cb > 0 GROUP BY ALL) GROUP BY a, b HAVING sum(part) >= 0.8),
links AS (SELECT a, b FROM near_ UNION ALL SELECT b, a FROM near_), nodes AS (SELECT DISTINCT a AS id FROM links), {_REACHED},
classes AS (SELECT w, coalesce(root, rep) AS class FROM reps LEFT JOIN roots ON id = rep)
SELECT doc_id, coalesce(class, doc_id)::BIGINT AS class_id, coalesce(class, doc_id) = doc_id AS kept FROM dw LEFT JOIN classes USING (w)
"""

ORACLES = {"op4_chat_format": _OP4, "op6_decontaminate": _OP6, "op7_vector_dedup": _OP7, "op8_substring_dedup": _OP8, "op9_minhash_dedup": _OP9}
