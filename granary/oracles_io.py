"""DuckDB SQL for the queries of :mod:`granary.queries_io` and those with the stand-in embedder."""

from __future__ import annotations

from granary import oracles as base
from granary.config import QUERY_PREFIX

_DOCS, _CHUNKS = base._DOCS, base._CHUNKS
_SCREENED = r"trim(regexp_replace(replace(text, chr(0), ' '), '\s+', ' ', 'g'))"

_JOBS = rf"""{_DOCS}, placed AS (SELECT doc_id, source AS dimension_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 10 + 1 AS batch_number FROM docs),
batches AS (SELECT dimension_id, batch_number::BIGINT AS batch_number, list(doc_id::VARCHAR ORDER BY doc_id) AS documents FROM placed GROUP BY ALL),
asked_ AS (SELECT 'src' || (item_id % 20) AS dimension_id, list(coalesce(text, '') ORDER BY item_id) AS questions, list(item_id ORDER BY item_id) AS numbers FROM benchmark GROUP BY 1),
jobs AS (SELECT * FROM asked_ JOIN batches USING (dimension_id)),
checked AS (SELECT *, CASE WHEN batch_number % 5 IN (0, 2) THEN 'wrong question count' WHEN batch_number % 5 = 3 AND list_reverse(questions) <> questions THEN 'changed question order' WHEN batch_number % 5 = 4 THEN 'result escaped document batch' END AS error FROM jobs)"""

_LINKS = rf"""{_DOCS}, links AS (SELECT doc_id, lang AS dimension, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS number, source || '/' || doc_id AS url, sha256(text) AS sha, {base._reason(_SCREENED)} AS reason FROM docs)"""

_JUDGED = rf"""{base._MATCHES}, named_ AS (SELECT query_id, 'c' || (query_id // 7) AS category_id, query_id % 7 + 1 AS question_no, text AS question FROM asked)"""


def _embedded(name: str, relation: str, key: str, text: str, size: int) -> str:
    """CTE ``name(key, dense)``: signed counts of hashed tokens, scaled to unit length."""
    return rf"""{name}_h AS (SELECT {key}, ('0x' || substr(md5(t), 1, 8))::UBIGINT AS h FROM (SELECT {key}, unnest({base._tokens(text)}) AS t FROM {relation})),
{name}_c AS (SELECT {key}, (h % {size})::INT AS d, sum(CASE WHEN h >= 2147483648 THEN -1 ELSE 1 END)::DOUBLE AS s FROM {name}_h GROUP BY ALL),
{name}_m AS (SELECT {key}, map_from_entries(list((d, s))) AS m, sqrt(sum(s * s))::FLOAT AS norm FROM {name}_c GROUP BY ALL),
{name} AS (SELECT {key}, list_transform(range({size}), lambda i: coalesce(m[i::INT], 0)::FLOAT / CASE WHEN norm = 0 THEN 1::FLOAT ELSE norm END) AS dense FROM {name}_m)"""


def _hybrid(chunks: str, asked: str, k: int) -> str:
    """CTEs up to ``fused(query_id, chunk_id, score, rank)`` over the relations ``chunks(chunk_id, text)`` and ``asked(query_id, text)``; the terms' CTEs are those of ``_bm25`` without its own questions."""
    sparse = base._bm25(chunks, 100).split(",\n", 1)[1]
    return rf"""{sparse}, {_embedded('ce', chunks, 'chunk_id', 'text', 64)}, {_embedded('qe', asked, 'query_id', f"'{QUERY_PREFIX}' || text", 64)},
dense_ AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, round(list_cosine_similarity(q.dense::DOUBLE[], c.dense::DOUBLE[]), 6) AS score FROM qe q, ce c WHERE len(list_filter(q.dense, lambda x: x <> 0)) > 0 AND len(list_filter(c.dense, lambda x: x <> 0)) > 0) QUALIFY rank <= 100),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query_id, chunk_id, rank FROM ranked UNION ALL FROM dense_) GROUP BY ALL) QUALIFY rank <= {k})"""


#: The ontology's questions over all documents, reranked to twelve, floored, and the first sentences of the first three as evidence.
_FRAMEWORK = rf"""{_DOCS}, chunks AS (SELECT doc_id::VARCHAR AS chunk_id, text FROM docs), {base._ONTOLOGY.replace("asked AS", "onto_asked AS")},
asked AS (SELECT dimension_id || '/' || category_id || '/' || n AS query_id, question AS text FROM onto_asked), {_hybrid('chunks', 'asked', 20)},
pairs AS (SELECT f.query_id, f.chunk_id, f.rank AS prior, c.text, list_distinct({base._tokens('a.text')}) AS q, list_distinct({base._tokens('c.text')}) AS t FROM fused f JOIN asked a USING (query_id) JOIN chunks c USING (chunk_id)),
reranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, prior) AS rank FROM (SELECT *, round(1 / (1 + exp(-round(coalesce(len(list_intersect(q, t)) * 6.0::DOUBLE / nullif(len(q), 0), 0) - 3.0, 9))), 9) AS score FROM pairs) QUALIFY rank <= 12),
kept_ AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM reranked WHERE score >= 0.05),
quoted AS (SELECT query_id, chunk_id, nth, trim(string_split(regexp_replace(text, '([.!?])\s+([\p{{Lu}}\p{{N}}"“(])', '\1' || chr(1) || '\2', 'g'), chr(1))[1][1:600], chr(32) || chr(9) || chr(10) || chr(13)) AS quote, text FROM kept_ WHERE nth <= 3),
proposed_ AS (SELECT *, nth - 1 AS position FROM quoted UNION ALL SELECT *, (SELECT count(*) FROM quoted x WHERE x.query_id = q.query_id) FROM quoted q WHERE nth = 1),
blank_ AS (SELECT query_id, bool_or(quote = '') AS bad FROM proposed_ GROUP BY query_id),
grounded_ AS (SELECT p.*, lower(trim(regexp_replace(quote, '\s+', ' ', 'g'))) AS e, contains(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), lower(trim(regexp_replace(quote, '\s+', ' ', 'g')))) AS good FROM proposed_ p JOIN blank_ USING (query_id) WHERE NOT bad),
accepted_ AS (SELECT query_id, position FROM grounded_ WHERE good QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id, e ORDER BY position) = 1),
by_category AS (SELECT category_id, count(position) AS matches FROM onto_asked o LEFT JOIN accepted_ a ON a.query_id = o.dimension_id || '/' || o.category_id || '/' || o.n GROUP BY category_id),
seen_ AS (SELECT category_id, count(DISTINCT chunk_id) AS retrieved FROM onto_asked o JOIN kept_ k ON k.query_id = o.dimension_id || '/' || o.category_id || '/' || o.n GROUP BY category_id)"""

_COLUMNS = rf"""{_DOCS}, w AS (SELECT doc_id, list_filter({base._words('text')}, lambda x: length(x) <= 12) AS w FROM docs),
p AS (SELECT doc_id, page, w[page * 96 + 1 : page * 96 + 96] AS w FROM (SELECT *, unnest(range((len(w) + 95) // 96)) AS page FROM w)),
h AS (SELECT *, w[1:48] AS a, w[49:96] AS b FROM p),
l AS (SELECT doc_id, page, list_transform(range((len(a) + 5) // 6), lambda i: array_to_string(a[i * 6 + 1 : i * 6 + 6], ' ')) AS a, list_transform(range((len(b) + 5) // 6), lambda i: array_to_string(b[i * 6 + 1 : i * 6 + 6], ' ')) AS b, len(b) AS n FROM h)"""
_ROWS = "list_transform(range(len(a)), lambda i: a[i + 1] || CASE WHEN i < len(b) THEN chr(9) || b[i + 1] ELSE '' END)"

_SETTINGS = (
    ("chunk size", "wordSize must be a positive integer."), ("chunk overlap", "overlapWords must be a non-negative integer"), ("chunk shared", "overlapWords must be strictly smaller than wordSize"), ("chunk assembly", 'assembly must be "page" or "flow"'), ("least words", "20"),
    ("top", "topK must be a positive integer."), ("score", "minimumRetrievalScore must be between 0 and 1."), ("words", "Hierarchy configuration values must be finite numbers."), ("calibration", "configuration must be an object."), ("calibration chunk", "configuration.chunk must be an object."),
    ("calibration top", "retrieval.topK must be an integer between 1 and 100."), ("calibration strategy", "retrieval.strategy must be dense, sparse or hybrid."), ("reranking", "reranking.strategy must be cross_encoder."), ("candidates", "reranking.candidates must be an integer between topK and 100."), ("taken candidates", "30"),
    ("service key", "STORE_API_KEY is required for a remote store."), ("service size", "VECTOR_SIZE must be a positive integer."), ("service name", "x"), ("no dimensions", "Ontology must contain a dimensions array."), ("empty dimensions", "Ontology must contain at least one dimension."), ("dimension twice", 'Dimension id "d" is duplicated.'),
    ("category twice", 'Category id "c" is duplicated.'), ("no questions", "dimensions[0].categories[0].questions must contain at least one question."), ("many categories", "Ontology must contain no more than 100 categories."), ("ontology", "1"), ("asked nothing", "Provide calibration questions as JSON."),
    ("asked numbers", "questions must be a non-empty array of strings."), ("asked", "a,b"),
)
_STATES = (
    ("before", "false"), ("after", "true"), ("same size", "fine"), ("other size", "Vector dimension mismatch: the collection has 3, received 4."), ("bad size", "vectorSize must be a positive safe integer."), ("no points", "The collection holds no points."), ("nothing", "At least one chunk is required."),
    ("no vector", "The number of chunks and vectors must be equal."),
)


def _values(rows: tuple[tuple[str, str], ...], names: str) -> str:
    quoted = ", ".join("('" + "', '".join(x.replace("'", "''") for x in row) + "')" for row in rows)
    return f"SELECT * FROM (VALUES {quoted}) v({names})"


ORACLES = {
    "s04_text_sources": rf"WITH {_DOCS} SELECT doc_id AS document_id, 1::BIGINT AS page, CASE WHEN doc_id % 7 <> 0 THEN md5({base._clean('text')}) END AS text_md5, CASE WHEN doc_id % 7 = 0 THEN source || '.txt is not valid UTF-8 text.' END AS error FROM docs",
    "s11_folder_order": rf"""WITH {_DOCS}, f AS (SELECT DISTINCT source, CASE WHEN doc_id % 4 = 0 THEN 'notes' || doc_id || '.pdf' ELSE 'topic-' || (doc_id * 7919 % 1000) || '-' || (doc_id * 31 % 97) || '.pdf' END || CASE WHEN doc_id % 9 = 0 THEN '.' || doc_id ELSE '' END AS name FROM docs)
SELECT source, name, row_number() OVER (PARTITION BY source ORDER BY coalesce(nullif(regexp_extract(name, '-(\d+)\.pdf$', 1), '')::DOUBLE, 'infinity'::DOUBLE), name) AS position FROM f""",
    "s13_candidate_links": rf"""WITH {_DOCS}, s AS (SELECT DISTINCT source, substr(source, 4)::INT AS n FROM docs WHERE regexp_full_match(source, 'src[0-9]+') AND source <> 'src3'), l AS (SELECT source, n, unnest(range(5 * n)) AS i FROM s)
SELECT n::BIGINT AS source_no, row_number() OVER (PARTITION BY n ORDER BY i) - 1 AS position, source || '/' || i AS url FROM l WHERE i % 6 <> 0""",
    "s15_upload_checks": rf"""WITH {_DOCS}, f AS (SELECT floor(sqrt(doc_id))::BIGINT AS upload, doc_id AS ordinal, source || '.' || kind AS name, lower(kind) AS kind, CASE WHEN doc_id % 11 = 0 THEN 0 WHEN doc_id % 17 = 0 THEN 209715200 ELSE n_chars END AS size
  FROM (SELECT *, ['pdf', 'TXT', 'md', 'csv', 'exe', 'docx', 'pdf', 'pdf'][doc_id * 13 % 8 + 1] AS kind FROM docs) WHERE doc_id > 0),
e AS (SELECT *, CASE WHEN kind = 'exe' THEN name || ' is not a supported document type.' WHEN size = 0 THEN name || ' is empty.' WHEN size > 104857600 THEN name || ' exceeds the 100 MB file limit.' END AS basic, CASE WHEN kind NOT IN ('pdf', 'txt', 'md') THEN name || ' is accepted for upload, but is not implemented in the RAG chunker yet.' END AS later FROM f)
SELECT upload, CASE WHEN count(*) > 10 THEN 'Select no more than 10 documents at once.' ELSE coalesce(arg_min(basic, ordinal) FILTER (basic IS NOT NULL), arg_min(later, ordinal) FILTER (later IS NOT NULL)) END AS error FROM e GROUP BY upload""",
    "s16_pdf_screen": rf"WITH {_DOCS} SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR octet_length(encode(text)) + 5 < 10000 THEN 'not a PDF' END AS error FROM docs",
    "k02_collection_states": _values(_STATES, "step, said"),
    "k06_ordered_csv": rf"WITH {_DOCS} SELECT lpad(doc_id::VARCHAR, 12, '0') AS id, lang, md5(text) AS text_md5 FROM docs",
    "k08_json_round_trip": rf"WITH {_DOCS} SELECT doc_id, source, len(string_split(text, chr(10)))::BIGINT AS lines, md5(text) AS text_md5 FROM docs",
    "k09_numbered_files": rf"""WITH {base._FETCHED}, tried AS (FROM fetched WHERE n <= 1000), good AS (SELECT *, n = min(n) OVER (PARTITION BY dimension, sha) AS fresh FROM tried WHERE reason IS NULL),
acc AS (SELECT dimension, url, row_number() OVER (PARTITION BY dimension ORDER BY n) AS number FROM good WHERE fresh QUALIFY number <= 100)
SELECT dimension || '-' || number || '.pdf' AS name, octet_length(encode(text))::BIGINT AS size, sha256(text) AS sha256 FROM acc JOIN docs d ON d.source || '/' || d.doc_id = acc.url""",
    "k05_answer_fields": rf"""WITH {_CHUNKS}, every_asked AS (SELECT item_id AS query_id, coalesce(text, '') AS text FROM benchmark), errors_ AS (SELECT query_id, CASE WHEN {base._trim('text')} = '' THEN 'Enter a question about the selected documents.' WHEN length(text) > 2000 THEN 'Question must be 2,000 characters or fewer.' END AS error FROM every_asked),
asked AS (SELECT query_id, text FROM every_asked), {_hybrid('chunks', 'asked', 5)}, found AS (SELECT query_id, rank, chunk_id, f.score, c.text, c.source FROM fused f JOIN chunks c USING (chunk_id)),
sized AS (SELECT *, string_split_regex({base._trim('text')}, '\s+') AS w FROM found), used AS (SELECT *, coalesce(sum(len(w)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_ FROM sized QUALIFY before_ < 1200),
told AS (SELECT query_id, string_agg('[Page 1] [Source: ' || source || ']' || chr(10) || array_to_string(w[1 : least(len(w), 1200 - before_)::BIGINT], ' '), chr(10) || chr(10) ORDER BY rank) AS context FROM used GROUP BY query_id),
said AS (SELECT query_id, string_split(regexp_replace(regexp_replace(context, '^[^\n]*\n', ''), '([.!?])\s+([\p{{Lu}}\p{{N}}"“(])', '\1' || chr(1) || '\2', 'g'), chr(1))[1] AS answer FROM told)
SELECT e.query_id, md5(coalesce(error, answer, '')) AS answer_md5, 0::BIGINT AS indexed, coalesce(string_agg(source || '|1|1|' || printf('%.6f', score) || '|' || md5(f.text), ';' ORDER BY rank), '') AS sources FROM errors_ e LEFT JOIN said USING (query_id) LEFT JOIN found f USING (query_id) GROUP BY e.query_id, error, answer""",
    "k05_calibration_fields": rf"""WITH {_CHUNKS}, {base._bm25('chunks', 1000000000)}, b AS (SELECT chunk_id, source, (row_number() OVER (PARTITION BY source ORDER BY chunk_id) - 1) // 10 + 1 AS batch FROM chunks),
s AS (SELECT query_id, chunk_id, score, source, batch, a.text, row_number() OVER (PARTITION BY query_id, batch ORDER BY score DESC, chunk_id) AS place FROM ranked JOIN asked a USING (query_id) JOIN b USING (chunk_id) WHERE source = 'src' || (query_id % 20) QUALIFY place <= 20),
g AS (SELECT source, batch, query_id, any_value(text) AS text, string_agg(place || ':' || chunk_id, ',' ORDER BY place) AS matches FROM s GROUP BY ALL)
SELECT source AS dimension_id, batch::BIGINT AS batch_number, true AS ok, row_number() OVER (PARTITION BY source, batch ORDER BY query_id) - 1 AS position, md5(text) AS question_md5, matches FROM g""",
    "k05_hierarchy_fields": rf"""WITH {_FRAMEWORK} SELECT category_id, matches::BIGINT AS matches, coalesce(retrieved, 0)::BIGINT AS retrieved, matches::BIGINT AS candidates FROM by_category LEFT JOIN seen_ USING (category_id)""",
    "a06_framework": rf"""WITH {_FRAMEWORK} SELECT DISTINCT dimension_id, category_id, matches::BIGINT AS matches FROM by_category JOIN onto USING (category_id)""",
    "r08_embeddings": rf"WITH {_DOCS}, {_embedded('e', 'docs', 'doc_id', 'text', 16)} SELECT doc_id, list_transform(coalesce(dense, list_transform(range(16), lambda i: 0::FLOAT)), lambda x: round(x::DOUBLE, 5)) AS dense FROM docs LEFT JOIN e USING (doc_id)",
    "q09_empty_documents": rf"WITH {_DOCS} SELECT doc_id AS document_id, source || ' contains no extractable text.' || CASE WHEN doc_id % 2 = 0 THEN ' OCR may be required.' ELSE '' END AS error FROM docs WHERE doc_id % 10 = 3 OR len({base._words('text')}) = 0",
    "q10_settings": _values(_SETTINGS, "setting, said"),
    "b08_quarantined_pages": rf"""WITH {base._PAGES}, c AS (SELECT document_id, page, {base._clean('text')} AS t, len({base._words('text')}) AS n FROM paged), r AS (SELECT *, {base._reason('t')} AS why FROM c),
w AS (SELECT document_id, page, CASE WHEN n <= 200 THEN 1 ELSE (ceil((n - 200) / 150) + 1)::BIGINT END AS k FROM r WHERE why IS NULL AND n > 0) SELECT document_id, sum(k)::BIGINT AS chunks, count(*)::BIGINT AS pages, sum(k)::BIGINT AS last FROM w GROUP BY document_id""",
    "m01_jobs": rf"WITH {_JOBS} SELECT dimension_id, batch_number, array_to_string(documents, ',') AS documents, len(questions)::BIGINT AS questions, md5(array_to_string(questions, chr(10))) AS questions_md5 FROM jobs",
    "q15_result_checks": rf"WITH {_JOBS} SELECT dimension_id, batch_number, error FROM checked",
    "j07_zipped_results": rf"""WITH {_JOBS}, q AS (SELECT *, unnest(range(1, len(questions) + 1)) AS i FROM checked WHERE error IS NULL), d AS (SELECT *, unnest(documents[1:2]) AS document_id FROM q)
SELECT dimension_id, batch_number, numbers[i]::BIGINT AS question_number, md5(questions[i]) AS question_md5, document_id, document_id || '-1' AS chunk_id FROM d""",
    "m03_job_runner": rf"WITH {_JOBS} SELECT dimension_id, batch_number, len(documents)::BIGINT AS documents, row_number() OVER (ORDER BY dimension_id, batch_number) AS job_no, 'failed' AS first_run, 'completed' AS status, true AS finished FROM jobs",
    "m04_pending_jobs": rf"WITH {_JOBS}, n AS (SELECT dimension_id, batch_number, row_number() OVER (ORDER BY dimension_id, batch_number) AS job_no FROM jobs) FROM n WHERE job_no > (SELECT count(*) FROM jobs) * 2 // 3",
    "m05_audit": rf"""WITH {_LINKS}, once AS (SELECT sha, arg_min_null(reason, doc_id) AS screen, min(doc_id) AS first_ FROM links GROUP BY sha),
j AS (SELECT dimension, number, url, CASE WHEN first_ % 11 = 0 THEN 'application extractor: no words' WHEN doc_id % 9 <> 0 AND doc_id % 10 <> 0 THEN NULL ELSE screen END AS reason FROM links JOIN once USING (sha) WHERE doc_id % 8 <> 0)
SELECT dimension, number::BIGINT AS old, url, row_number() OVER (PARTITION BY dimension ORDER BY number) AS number, NULL::VARCHAR AS reason FROM j WHERE reason IS NULL UNION ALL SELECT dimension, number, url, NULL, reason FROM j WHERE reason IS NOT NULL""",
    "m06_recovered": rf"""WITH {_LINKS}, fine AS (SELECT sha FROM links GROUP BY sha HAVING min(reason) IS NULL)
SELECT dimension, url, 40 + row_number() OVER (PARTITION BY dimension ORDER BY links.number) AS number FROM links WHERE doc_id % 4 = 0 AND sha IN (FROM fine) QUALIFY 40 + row_number() OVER (PARTITION BY dimension ORDER BY links.number) <= 100""",
    "m07_shortfalls": rf"""WITH {base._FETCHED}, tried AS (FROM fetched WHERE n <= 1000), good AS (SELECT dimension, sha FROM tried WHERE reason IS NULL GROUP BY ALL), s AS (SELECT dimension, count(*) AS tried, least(100, (SELECT count(*) FROM good g WHERE g.dimension = f.dimension)) AS saved FROM fetched f GROUP BY dimension)
SELECT dimension, CASE WHEN tried >= 1000 THEN 'gave up after trying 1000 links' ELSE 'sources ran out' END || ' (' || saved || '/100 saved)' AS message FROM s WHERE saved < 100""",
    "u04_unseen_links": r"""WITH l AS (SELECT regexp_extract(coalesce(url, ''), '^[a-z]+://([^/?#]*)', 1) AS source_no, page_id, coalesce(url, '') AS url FROM pages), t AS (SELECT *, row_number() OVER (PARTITION BY source_no ORDER BY page_id) AS turn FROM l),
o AS (FROM t QUALIFY row_number() OVER (PARTITION BY url ORDER BY turn, source_no) = 1) SELECT url, source_no, turn, row_number() OVER (ORDER BY turn, source_no) AS "order" FROM o WHERE url NOT IN (SELECT url FROM l WHERE page_id % 2 = 0)""",
    "a03_question_counts": rf"""WITH {_JUDGED} SELECT query_id::VARCHAR AS question_id, category_id, (SELECT count(*) FROM retrieved r WHERE r.query_id = n.query_id)::BIGINT AS retrieved, (SELECT count(*) FROM judged j WHERE j.query_id = n.query_id)::BIGINT AS generated,
(SELECT count(*) FROM judged j WHERE j.query_id = n.query_id AND rejected IS NULL)::BIGINT AS accepted FROM named_ n""",
    "a05_rejected_candidates": rf"WITH {_JUDGED}, r AS (SELECT category_id, question_no, position, md5(question) || ': ' || rejected AS said FROM judged JOIN named_ USING (query_id) WHERE rejected IS NOT NULL) SELECT category_id, coalesce(string_agg(said, '; ' ORDER BY question_no, position), '') AS rejected FROM (SELECT DISTINCT category_id FROM named_) LEFT JOIN r USING (category_id) GROUP BY category_id",
    "a07_totals": rf"WITH {_JUDGED}, m AS (SELECT category_id, count(DISTINCT question) AS q, count(*) AS n FROM judged JOIN named_ USING (query_id) WHERE rejected IS NULL GROUP BY category_id) SELECT sum(q)::BIGINT AS matched_questions, sum(n)::BIGINT AS matched_candidates FROM m",
    "r06_batched_rerank": base.ORACLES["r06_rerank"],
    "g03_requests": r"SELECT item_id AS query_id, length('Passages:' || chr(10) || 'About ' || item_id || chr(10) || chr(10) || 'Question: ' || coalesce(text, ''))::VARCHAR AS answer FROM benchmark",
    "l03_columns": rf"WITH {_COLUMNS} SELECT doc_id AS document_id, page + 1 AS page, md5(array_to_string(CASE WHEN len(b) >= 4 AND n / len(b) >= 5 THEN list_concat(a, b) ELSE {_ROWS} END, chr(10))) AS text_md5 FROM l",
    "l07_screened_layout": rf"WITH {_COLUMNS} SELECT doc_id AS document_id, page + 1 AS page, md5(array_to_string({_ROWS}, chr(10))) AS text_md5 FROM l",
}
