"""DuckDB SQL for the queries that SQL can express, written apart from the operators."""

from __future__ import annotations

_DOCS = "docs AS (SELECT doc_id, coalesce(text, '') AS text, lang, source, n_chars FROM documents)"


def _clean(x: str) -> str:
    out = rf"regexp_replace(replace({x}, chr(0), ' '), '<latexit\b.*?</latexit>', ' ', 'gis')"
    out = rf"regexp_replace({out}, '(\w)-\r?\n(\w)', '\1\2', 'g')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


def _words(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda w: w <> '')"


def _letters(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '\p{{L}}'))"


def _trim(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"


def _edge(x: str) -> str:
    return rf"regexp_replace(regexp_replace(lower({_clean(x)}), '\d[\d\s]*', '#', 'g'), '\s+', '', 'g')"


def _cells(x: str) -> str:
    return rf"list_filter(list_transform(string_split_regex({x}, '\t+| {{3,}}'), lambda c: {_clean('c')}), lambda c: c <> '')"


_REFERENCE = r"(?i)^(?:\d+(?:\.\d+)*\.?\s*)?(?:references|bibliography|works cited|literature cited|bibliograf[ií]a|r[ée]f[ée]rences(?: bibliographiques)?|литература|література|список літератури|список литературы|список використаних джерел)(?:$|[\s(:])"


def _heading(x: str) -> str:
    sound = rf"regexp_matches({x}, '\p{{L}}{{3,}}') AND {_letters(x)} / length({x}) >= 0.6 AND NOT regexp_matches({x}, '(?:^|\s)(?:\p{{L}}\s){{3,}}\p{{L}}(?:\s|$)') AND NOT regexp_matches({x}, '\p{{L}}{{20,}}') AND NOT contains({x}, '_')"
    numbered = rf"regexp_matches({x}, '^\d+(?:\.\d+)*\.?\s+\p{{Lu}}[^.!?]{{2,100}}$') AND len(regexp_extract_all({x}, '\p{{L}}{{2,}}')) <= 10 AND NOT regexp_matches({x}, '[,;]$')"
    capitals = rf"length({x}) BETWEEN 4 AND 100 AND regexp_matches({x}, '\p{{Lu}}') AND upper({x}) = {x} AND NOT contains({x}, 'ß') AND NOT regexp_matches({x}, '[.!?]$')"
    named = rf"regexp_matches({x}, '(?i)^(?:abstract|introduction|conclusions?|methods?|results?|discussion)$')"
    return rf"({sound} AND (regexp_matches({x}, '{_REFERENCE}') OR CASE WHEN regexp_matches({x}, '^\d+(?:\.\d+)*\.?\s+') THEN {numbered} ELSE {named} OR {capitals} END))"


def _caption(x: str) -> str:
    return rf"regexp_matches({x}, '(?i)^(?:fig(?:ure)?|table)\s*\d+(?:[.:\s-]|$)')"


def _reason(cleaned: str) -> str:
    tokens = rf"string_split_regex({cleaned}, '\s+')"
    joined = rf"len(list_filter({tokens}, lambda t: regexp_matches(t, '\p{{L}}{{36,}}')))"
    return rf"""CASE WHEN {cleaned} = '' THEN 'no extractable text'
      WHEN regexp_matches({cleaned}, '(?i)^(?:#(?:NAME|REF|VALUE|DIV/0|N/A)[!?]?\s*)+$') THEN 'spreadsheet error in place of page text'
      WHEN length({cleaned}) - length(replace({cleaned}, '�', '')) > greatest(2, length({cleaned}) * 0.01) THEN 'too many replacement characters'
      WHEN (len({tokens}) <= 3 AND {joined} > 0) OR {joined} >= greatest(3, len({tokens}) * 0.1) THEN 'probable joined words'
      WHEN length({cleaned}) >= 100 AND len({tokens}) < 8 THEN 'too few word boundaries' END"""


_PAGES = rf"""{_DOCS}, cut AS (SELECT doc_id AS document_id, string_split(text, chr(10)) AS lines FROM docs),
paged AS (SELECT document_id, p + 1 AS page, array_to_string(lines[p * 12 + 1 : p * 12 + 12], chr(10)) AS text FROM (SELECT *, unnest(range((len(lines) - 1) // 12 + 1)) AS p FROM cut))"""

_LINES = rf"""{_PAGES}, split_ AS (SELECT document_id, page, string_split_regex({_trim('text')}, '\r?\n') AS lines FROM paged),
lines AS (SELECT document_id, page, len(lines) - 1 AS last, i AS line_no, {_trim('lines[i + 1]')} AS line FROM (SELECT *, unnest(range(len(lines))) AS i FROM split_)),
edges AS (SELECT document_id, 'first' AS edge, {_edge('line')} AS key FROM lines WHERE line_no = 0 AND line <> '' AND length(line) <= 120
  UNION ALL SELECT document_id, 'last', {_edge('line')} FROM lines WHERE line_no = last AND line <> '' AND length(line) <= 120),
repeated AS (SELECT document_id, edge, key FROM edges GROUP BY ALL HAVING count(*) >= 2)"""

_KINDS = rf"""{_LINES}, cells AS (SELECT *, {_edge('line')} AS key, {_cells('line')} AS cells FROM lines),
rows_ AS (SELECT *, len(cells) >= 3 OR (len(cells) >= 2 AND contains(line, chr(9))) AS is_row FROM cells),
kinds AS (SELECT document_id, page, line_no, line, cells, is_row, CASE WHEN line = '' THEN 'blank'
  WHEN line_no = 0 AND EXISTS (FROM repeated r WHERE r.document_id = x.document_id AND r.edge = 'first' AND r.key = x.key) THEN 'header'
  WHEN line_no = last AND (EXISTS (FROM repeated r WHERE r.document_id = x.document_id AND r.edge = 'last' AND r.key = x.key) OR regexp_matches(line, '^\d+$')) THEN 'footer'
  WHEN {_caption('line')} THEN 'caption' WHEN {_heading('line')} THEN 'heading' WHEN is_row THEN 'row' ELSE 'text' END AS kind FROM rows_ x)"""

_STOP = "'a','an','and','are','as','at','be','but','by','for','if','in','into','is','it','no','not','of','on','or','such','that','the','their','then','there','these','they','this','to','was','will','with'"


def _tokens(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def _bm25(chunks: str, k: int) -> str:
    """CTEs up to ``ranked(query_id, chunk_id, score, rank)``; ``chunks``: a relation of chunk_id and text."""
    return rf"""asked AS (SELECT item_id AS query_id, coalesce(text, '') AS text FROM benchmark),
words AS (SELECT chunk_id, list_filter({_tokens('text')}, lambda t: t NOT IN ({_STOP})) AS w FROM {chunks}),
posted AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(w) AS dl, unnest(w) AS term FROM words) GROUP BY ALL),
terms AS (SELECT DISTINCT query_id, unnest(list_filter({_tokens('text')}, lambda t: t NOT IN ({_STOP}))) AS term FROM asked),
idf AS (SELECT term, ln(1 + ((SELECT count(*) FROM {chunks}) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM posted GROUP BY term),
scored AS (SELECT query_id, chunk_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / 100.0))), 6) AS score FROM terms JOIN posted USING (term) JOIN idf USING (term) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored QUALIFY rank <= {k})"""


_CHUNKS = f"{_DOCS}, chunks AS (SELECT doc_id AS chunk_id, text, source, lang FROM docs)"


def _uuid(blob: str) -> str:
    digest = f"sha1(unhex('47129d6b906b4c3998fd76c3ac5a0060') || encode({blob}))"
    return f"(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::INT % 4) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) FROM (SELECT {digest} AS h))"


_MATCHES = rf"""{_CHUNKS}, {_bm25('chunks', 3)},
retrieved AS (SELECT query_id, chunk_id, rank, c.text, c.source FROM ranked JOIN chunks c USING (chunk_id)),
proposed AS (SELECT query_id, unnest(CASE rank WHEN 1 THEN [2, 7] ELSE [rank * 2] END) AS position, rank, CASE rank WHEN 3 THEN -1 ELSE chunk_id END AS cid,
  CASE WHEN rank = 2 AND query_id % 2 = 1 THEN 'quite invented words' ELSE translate(text[1:60], 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') END AS quote FROM retrieved),
squeezed AS (SELECT p.*, r.text, r.source, lower(trim(regexp_replace(quote, '\s+', ' ', 'g'))) AS q FROM proposed p LEFT JOIN retrieved r ON r.query_id = p.query_id AND r.chunk_id = p.cid),
grounded AS (SELECT *, coalesce(q <> '' AND contains(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), q), false) AS good FROM squeezed),
judged AS (SELECT *, CASE WHEN NOT good THEN 'A cited chunk or verbatim evidence quote was not present in retrieval.'
  WHEN position > min(position) FILTER (good) OVER (PARTITION BY query_id, cid, q) THEN 'Duplicate quoted passage for this question.' END AS rejected FROM grounded)"""

_ONTOLOGY = """onto(dimension_no, dimension_id, dimension, dd, category_no, category_id, category, cd, tail, questions) AS (VALUES
 (0, 'form', 'Form', 'How a text is made.', 0, 'words', 'Words', 'Which words it has.', chr(10) || 'Include: frequent words; rare words.' || chr(10) || 'Exclude: marks.', ['Is the thing on the shore?', 'And who heeds the other?']),
 (0, 'form', 'Form', 'How a text is made.', 1, 'lines', 'Lines', 'How lines end.', '', ['Que dit la fin de la ligne?']),
 (1, 'sense', 'Sense', 'What a text says.', 0, 'claims', 'Claims', 'What it claims.', chr(10) || 'Include: statements.', ['Was ist die Einheit der Dinge?', 'Zzz qqq?', 'What is this for?'])),
asked AS (SELECT *, questions[n] AS question FROM (SELECT *, unnest(range(1, len(questions) + 1)) AS n FROM onto))"""

_FETCHED = rf"""{_DOCS}, fetched AS (SELECT lang AS dimension, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n, source || '/' || doc_id AS url, sha256(text) AS sha,
  CASE WHEN length(text) < 100 THEN 'not a PDF' ELSE {_reason(r"trim(regexp_replace(replace(text, chr(0), ' '), '\s+', ' ', 'g'))")} END AS reason FROM docs)"""

_COSINE = "list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"
_SOUND = "embedding IS NOT NULL AND list_aggregate(embedding::DOUBLE[], 'sum') IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0"


def _context(k: int, budget: int, header: str, words: str) -> str:
    return rf"""WITH {_CHUNKS}, {_bm25('chunks', k)},
sized AS (SELECT query_id, rank, chunk_id, c.source, {words} AS w FROM ranked JOIN chunks c USING (chunk_id)),
used AS (SELECT *, coalesce(sum(len(w)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_ FROM sized QUALIFY before_ < {budget}),
kept AS (SELECT *, w[1 : least(len(w), {budget} - before_)::BIGINT] AS k FROM used)
SELECT query_id, md5(string_agg({header} || chr(10) || array_to_string(k, ' '), chr(10) || chr(10) ORDER BY rank)) AS context_md5, sum(len(k))::BIGINT AS words, count(*)::BIGINT AS passages FROM kept GROUP BY query_id"""

_BLOCKS = rf"""{_KINDS}, seen AS (SELECT *, kind IN ('header', 'footer', 'caption', 'heading') AS single, lag(kind) OVER w AS kind_before, lag(line) OVER w AS line_before,
  last_value(CASE WHEN kind = 'heading' THEN {_clean('line')} END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY page, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section
  FROM kinds WINDOW w AS (PARTITION BY document_id, page ORDER BY line_no)),
flush_ AS (SELECT *, kind IN ('blank', 'text') OR (single AND NOT is_row) AS flushes, kind = 'text' AND kind_before = 'text' AND NOT regexp_matches(line_before, '[.!?]$') AS goes_on FROM seen),
numbers AS (SELECT *, sum(CASE WHEN coalesce(goes_on, false) THEN 0 ELSE 1 END) OVER w AS para, sum(flushes::INT) OVER w AS tab FROM flush_ WINDOW w AS (PARTITION BY document_id, page ORDER BY line_no)),
every_ AS (SELECT document_id, page, line_no AS pos, 0 AS after, kind AS type, {_clean('line')} AS text, section FROM numbers WHERE single
  UNION ALL SELECT document_id, page, pos, 1, CASE WHEN coalesce(regexp_matches(section, '{_REFERENCE}'), false) THEN 'reference' ELSE 'paragraph' END, {_clean(r"replace(regexp_replace(lines, '(\p{Ll})\s?-\n(\p{Ll})', '\1\2', 'g'), chr(10), ' ')")}, section
    FROM (SELECT document_id, page, max(line_no) AS pos, arg_max_null(section, line_no) AS section, string_agg(line, chr(10) ORDER BY line_no) AS lines FROM numbers WHERE kind = 'text' GROUP BY document_id, page, para)
  UNION ALL SELECT document_id, page, max(line_no), 1, 'table', coalesce(string_agg(array_to_string(cells, ' | '), chr(10) ORDER BY line_no) FILTER (kind = 'row'), ''), arg_max_null(section, line_no) FROM numbers WHERE NOT flushes GROUP BY document_id, page, tab),
blocks AS (SELECT document_id, page, row_number() OVER (PARTITION BY document_id, page ORDER BY pos, after) AS block_no, type, text, section FROM every_ WHERE text <> '')"""


def _prose(x: str) -> str:
    return rf"""(SELECT CASE WHEN len(list_filter(r, lambda c: len(c) = 2 AND regexp_matches(trim(c[1]), '^(?:\(?[\dA-Za-z]{{1,3}}[.)]|[•▪◦\-–])$'))) * 2 >= len(r)
  OR (len(list_filter(r, lambda c: len(c) > 2)) = 0 AND len(list_filter(flatten(r), lambda c: len({_words('c')}) >= 5)) * 2 >= len(flatten(r))) THEN array_to_string(flatten(r), ' ') END
  FROM (SELECT list_transform(string_split({x}, chr(10)), lambda l: string_split(l, ' | ')) AS r))"""


#: Passages of 200 words with 50 shared ones, runs of fewer than 40 stay open. Three recursions: rows of tables, blocks of documents, groups of runs.
_PASSAGES = rf"""{_BLOCKS}, flat AS (SELECT document_id, page, block_no, CASE WHEN coalesce(p, '') <> '' THEN 'paragraph' ELSE type END AS type, CASE WHEN coalesce(p, '') <> '' THEN p ELSE text END AS text, section
  FROM (SELECT *, CASE WHEN type = 'table' THEN {_prose('text')} END AS p FROM blocks)),
placed AS (SELECT *, coalesce(sum(len({_words('text')})) OVER (PARTITION BY document_id, page ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, lead(type) OVER (PARTITION BY document_id, page ORDER BY block_no) AS next_type FROM flat),
sound AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page, block_no) AS i, CASE WHEN type = 'table' OR (type = 'caption' AND coalesce(next_type, '') = 'table') THEN 'table' WHEN type = 'reference' THEN 'reference' ELSE 'prose' END AS family
  FROM placed WHERE type NOT IN ('header', 'footer') AND regexp_matches(text, '\p{{L}}')),
tabled AS (SELECT document_id, i, text, list_transform(string_split(text, chr(10)), lambda l: len({_words('l')})) AS n, string_split(text, chr(10)) AS l FROM sound WHERE type = 'table'),
table_rows AS (SELECT document_id, i, 1 AS pos, 1 AS g, n[1] AS size, 0 AS rows_ FROM tabled
  UNION ALL SELECT r.document_id, r.i, r.pos + 1, CASE WHEN r.rows_ > 0 AND r.size + t.n[r.pos + 1] > 200 THEN r.g + 1 ELSE r.g END, CASE WHEN r.rows_ > 0 AND r.size + t.n[r.pos + 1] > 200 THEN t.n[1] ELSE r.size END + t.n[r.pos + 1], CASE WHEN r.rows_ > 0 AND r.size + t.n[r.pos + 1] > 200 THEN 1 ELSE r.rows_ + 1 END
    FROM table_rows r JOIN tabled t USING (document_id, i) WHERE r.pos < len(t.n)),
table_pieces AS (SELECT document_id, i, g AS j, any_value(t.l[1]) || CASE WHEN max(pos) > 1 THEN chr(10) || string_agg(t.l[pos], chr(10) ORDER BY pos) FILTER (pos > 1) ELSE '' END AS text FROM table_rows JOIN tabled t USING (document_id, i) GROUP BY document_id, i, g),
said AS (SELECT document_id, i, start, page, family, unnest(parts) AS part, generate_subscripts(parts, 1) AS j FROM (SELECT *, CASE WHEN type = 'caption' THEN [text] ELSE string_split(regexp_replace(text, '([.!?])\s+([\p{{Lu}}\p{{N}}"“(])', '\1' || chr(1) || '\2', 'g'), chr(1)) END AS parts FROM sound WHERE type NOT IN ('table', 'heading'))),
sized AS (SELECT *, {_words('part')} AS w, start + coalesce(sum(len({_words('part')})) OVER (PARTITION BY document_id, i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM said),
cut_up AS (SELECT *, unnest(range(0, CASE WHEN len(w) <= 200 THEN 1 ELSE (ceil((len(w) - 200) / 150) * 150 + 1)::BIGINT END, 150)) AS k FROM sized WHERE len(w) > 0),
pieces AS (SELECT document_id, i, j * 100000 + k AS j, CASE WHEN len(w) <= 200 THEN part ELSE array_to_string(w[k + 1 : k + 200], ' ') END AS text, page, (s + k)::BIGINT AS start, least(len(w) - k, 200) AS n, family FROM cut_up
  UNION ALL SELECT document_id, i, j, t.text, page, start, len({_words('t.text')}), 'table' FROM table_pieces t JOIN sound USING (document_id, i) WHERE len({_words('t.text')}) > 0
  UNION ALL SELECT document_id, i, 0, text, page, start, len({_words('text')}), 'prose' FROM sound WHERE type = 'heading'),
totals AS (SELECT document_id, i, sum(n)::BIGINT AS n FROM pieces GROUP BY ALL),
runs_ AS (SELECT document_id, 0::BIGINT AS i, 0 AS run, false AS open_, '' AS family, NULL::VARCHAR AS section, 0::BIGINT AS n, false AS in_ FROM (SELECT DISTINCT document_id FROM sound)
  UNION ALL SELECT b.document_id, b.i, CASE WHEN b.type <> 'heading' AND NOT (small OR same_) THEN r.run + 1 ELSE r.run END, b.type <> 'heading' OR small, CASE WHEN b.type <> 'heading' AND NOT (small OR same_) THEN b.family ELSE r.family END,
    CASE WHEN b.type <> 'heading' AND NOT (small OR same_) THEN b.section ELSE r.section END, CASE WHEN b.type = 'heading' THEN CASE WHEN small THEN r.n + t.n ELSE r.n END WHEN small OR same_ THEN r.n + t.n ELSE t.n END, b.type <> 'heading' OR small
    FROM runs_ r JOIN sound b ON b.document_id = r.document_id AND b.i = r.i + 1 JOIN totals t ON t.document_id = b.document_id AND t.i = b.i,
    LATERAL (SELECT r.open_ AND r.n < 40 AS small, r.open_ AND r.family = b.family AND r.section IS NOT DISTINCT FROM b.section AS same_)),
members AS (SELECT p.*, r.run, r.family AS run_family, r.section, row_number() OVER (PARTITION BY p.document_id, r.run ORDER BY p.i, p.j) - 1 AS pos FROM pieces p JOIN runs_ r USING (document_id, i) WHERE r.in_),
run_starts AS (SELECT document_id, run, arg_min(run_family, i) AS run_family, arg_min_null(section, i) AS section FROM members GROUP BY ALL),
lengths AS (SELECT document_id, run, list(n ORDER BY pos) AS ns FROM members GROUP BY ALL),
sums AS (SELECT document_id, run, run_family, section, len(ns) AS size, list_transform(range(len(ns) + 1), lambda k: coalesce(list_sum(ns[1:k]), 0)::BIGINT) AS p FROM lengths JOIN run_starts USING (document_id, run)),
groups_ AS (SELECT document_id, run, 1 AS g, 0::BIGINT AS s, 0::BIGINT AS f, coalesce(list_max(list_filter(range(1, size), lambda k: p[k + 2] - p[1] <= 200)), 0)::BIGINT AS e FROM sums
  UNION ALL SELECT document_id, run, g + 1, q, f, greatest(f, coalesce(list_max(list_filter(range(f + 1, size), lambda k: p[k + 2] - p[q + 1] <= 200)), f))::BIGINT
    FROM (SELECT document_id, run, g, p, size, f, CASE WHEN p[f + 2] - p[q + 1] > 200 THEN f ELSE q END AS q FROM (SELECT m.document_id, m.run, m.g, u.p, u.size, m.e + 1 AS f,
      coalesce(list_min(list_filter(range(m.s, m.e + 1), lambda k: u.p[m.e + 2] - u.p[k + 1] <= CASE u.run_family WHEN 'prose' THEN 50 ELSE 0 END)), m.e + 1) AS q FROM groups_ m JOIN sums u USING (document_id, run) WHERE m.e + 1 < u.size))),
ends_ AS (SELECT x.*, u.run_family, u.section, lag(s) OVER w AS s_before, max(g) OVER (PARTITION BY document_id, run) AS last_g, u.p[e + 2] - u.p[f + 1] AS fresh, u.p[lag(e) OVER w + 2] - u.p[lag(s) OVER w + 1] AS before_n FROM groups_ x JOIN sums u USING (document_id, run) WINDOW w AS (PARTITION BY document_id, run ORDER BY g)),
folded AS (SELECT *, g > 1 AND g = last_g AND fresh < 40 AND before_n + fresh <= 240 AS folds FROM ends_),
final_ AS (SELECT document_id, run, g, s, coalesce(lead(CASE WHEN folds THEN e END) OVER w, e) AS e, section, folds FROM folded WINDOW w AS (PARTITION BY document_id, run ORDER BY g) QUALIFY NOT folds),
of_group AS (SELECT x.document_id, x.run, x.g, x.section, m.pos, m.text, m.page, m.start, m.n, m.family, lag(m.family) OVER (PARTITION BY x.document_id, x.run, x.g ORDER BY m.pos) AS family_before FROM final_ x JOIN members m ON m.document_id = x.document_id AND m.run = x.run AND m.pos BETWEEN x.s AND x.e),
family_words AS (SELECT document_id, run, g, family, sum(n) AS n, min(pos) AS first_ FROM of_group GROUP BY ALL),
main_ AS (SELECT document_id, run, g, family FROM family_words QUALIFY row_number() OVER (PARTITION BY document_id, run, g ORDER BY n DESC, first_) = 1),
passages AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY run, g) AS ordinal, m.family, x.section, body, page, page_end, word_start FROM (SELECT document_id, run, g, any_value(section) AS section,
  string_agg(CASE WHEN family_before IS NULL THEN '' WHEN 'table' IN (family, family_before) THEN chr(10) ELSE ' ' END || text, '' ORDER BY pos) AS body, arg_min(page, pos) AS page, arg_max(page, pos) AS page_end, arg_min(start, pos) AS word_start FROM of_group GROUP BY document_id, run, g) x JOIN main_ m USING (document_id, run, g))"""

#: The first passage of each set of near copies in a document: words of each are told by the normal form, the choice is greedy by ordinal.
_DISTINCT = rf"""{_PASSAGES}, forms AS (SELECT *, trim(regexp_replace(lower(body), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS form FROM passages),
listed AS (SELECT document_id, ordinal, form, len(string_split(form, ' ')) AS n, list_distinct(string_split(form, ' ')) AS own FROM forms),
close_ AS (SELECT b.document_id, a.ordinal AS a, b.ordinal AS b FROM listed a JOIN listed b ON a.document_id = b.document_id AND a.ordinal < b.ordinal, LATERAL (SELECT len(list_intersect(a.own, b.own)) AS both_) WHERE a.form = b.form
  OR (a.n >= 20 AND b.n >= 20 AND least(len(a.own), len(b.own)) >= 0.94 * greatest(len(a.own), len(b.own)) AND both_ / (len(a.own) + len(b.own) - both_) >= 0.94)),
near_ AS (SELECT document_id, b, list(a) AS before_ FROM close_ GROUP BY ALL),
chosen AS (SELECT document_id, 0::BIGINT AS ordinal, []::BIGINT[] AS kept FROM (SELECT DISTINCT document_id FROM forms)
  UNION ALL SELECT c.document_id, f.ordinal, CASE WHEN f.form = '' OR list_has_any(c.kept, coalesce(n.before_, [])) THEN c.kept ELSE list_append(c.kept, f.ordinal) END FROM chosen c JOIN forms f ON f.document_id = c.document_id AND f.ordinal = c.ordinal + 1 LEFT JOIN near_ n ON n.document_id = f.document_id AND n.b = f.ordinal),
kept_ AS (SELECT document_id, unnest(arg_max(kept, ordinal)) AS ordinal FROM chosen GROUP BY document_id),
distinct_ AS (SELECT p.* FROM passages p JOIN kept_ USING (document_id, ordinal))"""


def _label(x: str) -> str:
    return rf"CASE WHEN {x} <> '' AND len({_words(x)}) <= 12 AND {_letters(x)} / length({x}) >= 0.6 AND regexp_matches({x}, '\p{{L}}{{3,}}') AND NOT contains({x}, '_') THEN {x} END"


_TOPICS = rf"named AS (SELECT document_id, arg_min(text, page * 1000000 + block_no) AS topic FROM blocks WHERE type = 'heading' AND {_label('text')} IS NOT NULL AND NOT regexp_matches(text, '(?i)^(?:abstract|introduction|references|bibliography)$') GROUP BY document_id)"


ORACLES = {
    "t01_clean_text": rf"WITH {_DOCS} SELECT doc_id, md5({_clean('text')}) AS clean_md5, len({_words('text')})::BIGINT AS words, {_letters('text')}::BIGINT AS letters FROM docs",
    "t04_section_labels": rf"""WITH {_DOCS}, f AS (SELECT doc_id, string_split(text, chr(10))[1] AS x FROM docs)
SELECT doc_id, round(CASE WHEN x = '' THEN NULL ELSE {_letters('x')} / length(x) END, 9) AS ratio, CASE WHEN x <> '' AND len({_words('x')}) <= 12 AND {_letters('x')} / length(x) >= 0.6 AND regexp_matches(x, '\p{{L}}{{3,}}') AND NOT contains(x, '_') THEN x END AS label FROM f""",
    "t04_line_labels": rf"""WITH {_DOCS}, f AS (SELECT doc_id, i, x FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs)),
g AS (SELECT doc_id, i, CASE WHEN x = '' THEN NULL ELSE {_letters('x')} / length(x) END AS ratio, CASE WHEN x <> '' AND len({_words('x')}) <= 12 AND {_letters('x')} / length(x) >= 0.6 AND regexp_matches(x, '\p{{L}}{{3,}}') AND NOT contains(x, '_') THEN x END AS label FROM f)
SELECT doc_id, count(*)::BIGINT AS lines, round(avg(ratio), 9) AS ratio, count(label)::BIGINT AS labels, md5(coalesce(string_agg(label, chr(10) ORDER BY i), '')) AS labels_md5 FROM g GROUP BY doc_id""",
    "t05_dedup_form": rf"WITH {_DOCS} SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))) AS form_md5 FROM docs",
    "t06_sentences": rf"""WITH {_DOCS} SELECT doc_id, (len(regexp_extract_all(text, '[.!?]\s+[\p{{Lu}}\p{{N}}"“(]')) + 1)::BIGINT AS sentences FROM docs""",
    "t07_prose_tables": rf"""WITH {_DOCS}, r AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: string_split(x, ' | ')) AS rows_ FROM docs),
c AS (SELECT *, flatten(rows_) AS cells, len(list_filter(rows_, lambda x: len(x) = 2 AND regexp_matches(trim(x[1]), '^(?:\(?[\dA-Za-z]{{1,3}}[.)]|[•▪◦\-–])$'))) AS marked FROM r)
SELECT doc_id, CASE WHEN marked * 2 >= len(rows_) OR (len(list_filter(rows_, lambda x: len(x) > 2)) = 0 AND len(list_filter(cells, lambda x: len({_words('x')}) >= 5)) * 2 >= len(cells)) THEN md5(array_to_string(cells, ' ')) END AS prose_md5 FROM c""",
    "t10_edge_keys": rf"WITH {_DOCS}, f AS (SELECT doc_id, string_split(text, chr(10))[1] AS a, string_split(text, chr(10))[-1] AS b FROM docs) SELECT doc_id, md5({_edge('a')}) AS first_md5, md5({_edge('b')}) AS last_md5, len({_cells('a')})::BIGINT AS cells FROM f",
    "t10_line_keys": rf"""WITH {_DOCS}, f AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS a, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs)
SELECT doc_id, count(*)::BIGINT AS lines, md5(string_agg({_edge('a')}, chr(10) ORDER BY i)) AS keys_md5, sum(len({_cells('a')}))::BIGINT AS cells FROM f GROUP BY doc_id""",
    "t12_headings": rf"""WITH {_DOCS}, l AS (SELECT doc_id, {_trim('x')} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM docs))
SELECT doc_id, count(*)::BIGINT AS lines, count(*) FILTER ({_heading('line')})::BIGINT AS headings, count(*) FILTER ({_caption('line')})::BIGINT AS captions, count(*) FILTER (regexp_matches(line, '{_REFERENCE}'))::BIGINT AS references FROM l WHERE line <> '' GROUP BY doc_id""",
    "t14_joined_lines": rf"WITH {_DOCS} SELECT doc_id, md5({_clean(r"replace(regexp_replace(text, '(\p{Ll})\s?-\n(\p{Ll})', '\1\2', 'g'), chr(10), ' ')")}) AS joined_md5 FROM docs",
    "t15_labels": rf"""WITH {_DOCS}, s AS (SELECT *, n_chars * n_chars AS b, doc_id % 3 AS d FROM docs)
SELECT doc_id, '[Page ' || n_chars || '] [Source: ' || source || ' .txt]' AS page_label, CASE WHEN doc_id % 2 = 0 THEN 'Row ' || d ELSE 'Row ' || d || '-' || (d + 1) END || ' | Source: ' || source AS row_label,
CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f', floor(b / 1024 * 10 + 0.5) / 10) || ' KB' ELSE printf('%.1f', floor(b / 1048576 * 10 + 0.5) / 10) || ' MB' END AS size,
CASE WHEN {_trim('text')} = '' THEN 'Enter a question about the selected documents.' WHEN length(text) > 2000 THEN 'Question must be 2,000 characters or fewer.' END AS question_error, source || '.tar' AS topic, md5(lower({_trim(r"regexp_replace(text, '\s+', ' ', 'g')")})) AS evidence_md5 FROM s""",
    "t16_token_overlap": rf"""WITH {_DOCS}, a AS (SELECT item_id, list_distinct({_tokens('text')}) AS asked FROM benchmark), d AS (SELECT doc_id, doc_id % (SELECT count(*) FROM benchmark) AS item_id, list_distinct({_tokens('text')}) AS own FROM docs),
b AS (SELECT doc_id, item_id, len(list_intersect(own, asked)) AS n, len(own) + len(asked) AS total FROM d JOIN a USING (item_id))
SELECT doc_id, item_id, n::BIGINT AS shared, round(CASE WHEN total > n THEN n / (total - n) END, 9) AS jaccard FROM b""",
    "t20_category_queries": rf"""WITH {_ONTOLOGY} SELECT dimension_id || '/' || category_id || '/' || n AS question_id, n::BIGINT AS question_no, category_id,
'Dimension: ' || dimension || '. ' || dd || chr(10) || 'Category: ' || category || '. ' || cd || tail || chr(10) || 'Question: ' || question AS query FROM asked""",
    "t25_identity_hashes": rf"""WITH {_DOCS}, k AS (SELECT doc_id, 'txt' AS extension, sha256(text) AS source_hash, sha1(lower(source || '/Doc-' || doc_id || '.TXT') || ':' || sha256(text)) AS document_id FROM docs)
SELECT doc_id, extension, source_hash, document_id, sha1(source_hash || ':200:50:txt:flow:document-processing-v2') AS fingerprint, sha1(document_id || ':1:1:200:50:txt:structured-v2-flow') AS chunk_id, {_uuid('document_id')} AS point_id FROM k""",
    "q01_page_quality": rf"WITH {_PAGES}, c AS (SELECT document_id, page, {_clean('text')} AS t FROM paged) SELECT document_id, page::BIGINT AS page, {_reason('t')} AS reason FROM c",
    "q02_preflight_gate": rf"""WITH {_PAGES}, c AS (SELECT document_id, page, text, trim(regexp_replace(replace(text, chr(0), ' '), '\s+', ' ', 'g')) AS t FROM paged), r AS (SELECT *, {_reason('t')} AS why FROM c),
s AS (SELECT document_id, min(page) FILTER (why IS NOT NULL) AS page, min_by(why, page) FILTER (why IS NOT NULL) AS why, count(*) AS pages, coalesce(sum(len({_words('text')})) FILTER (why IS NULL), 0) AS words FROM r GROUP BY document_id)
SELECT document_id, page IS NULL AND words >= 50 AS ok, page::BIGINT AS page, CASE WHEN page IS NOT NULL THEN why WHEN words < 50 THEN 'fewer than 50 extractable words' END AS reason, pages::BIGINT AS pages, words::BIGINT AS words FROM s""",
    "s02_extensions": r"""WITH e AS (SELECT page_id, lower(string_split(string_split(coalesce(url, ''), '/')[-1], '.')[-1]) AS extension FROM pages)
SELECT page_id, extension, CASE WHEN extension NOT IN ('pdf', 'txt', 'md') THEN 'Document type ".' || extension || '" is not implemented for chunking' END AS error FROM e""",
    "s07_recognised_pages": rf"""WITH {_PAGES}, c AS (SELECT *, {_clean('text')} AS t FROM paged), r AS (SELECT *, CASE WHEN text <> '' THEN {_reason('t')} END AS why FROM c)
SELECT document_id, page::BIGINT AS page, CASE WHEN why IS NULL THEN 'extracted' WHEN page % 2 = 0 THEN 'ocr' ELSE 'quarantined' END AS quality, CASE WHEN why IS NOT NULL AND page % 2 = 1 THEN 'Extraction: ' || why || '; OCR: no extractable text' END AS quality_reason,
CASE WHEN why IS NULL THEN length(text) WHEN page % 2 = 0 THEN 27 ELSE 0 END::BIGINT AS chars FROM r""",
    "b02_repeated_edges": rf"WITH {_LINES} SELECT document_id, edge, key FROM repeated",
    "b04_line_kinds": rf"WITH {_KINDS} SELECT document_id, " + ", ".join(f"count(*) FILTER (kind = '{k}')::BIGINT AS {k}" for k in ("blank", "header", "footer", "caption", "heading", "row", "text")) + " FROM kinds GROUP BY document_id",
    "b07_section_fill": rf"""WITH {_KINDS}, f AS (SELECT document_id, page, line_no, last_value(CASE WHEN kind = 'heading' THEN {_clean('line')} END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY page, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM kinds)
SELECT document_id, page::BIGINT AS page, arg_max_null(section, line_no) AS section FROM f GROUP BY ALL""",
    "c01_word_windows": rf"""WITH {_DOCS}, s AS (SELECT doc_id::VARCHAR AS document_id, {_words('text')} AS w FROM docs), n AS (SELECT *, unnest(range(CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 200 THEN 1 ELSE (ceil((len(w) - 200) / 150) + 1)::BIGINT END)) * 150 AS a FROM s)
SELECT document_id, a::BIGINT AS word_start, len(w[a + 1 : a + 200])::BIGINT AS word_count, md5(array_to_string(w[a + 1 : a + 200], ' ')) AS text_md5, sha1(document_id || ':1:' || a || ':200:50:txt') AS chunk_id FROM n""",
    "d02_point_dedup": rf"WITH {_DOCS}, k AS (SELECT text, max(doc_id) AS doc_id FROM docs GROUP BY text) SELECT doc_id, {_uuid('sha1(text)')} AS point_id FROM k",
    "d05_content_dedup": rf"WITH {_DOCS} SELECT min(doc_id) AS doc_id, sha256(text) AS sha256 FROM docs GROUP BY text",
    "r01_dense_topk": rf"""WITH v AS (FROM embeddings WHERE {_SOUND}), s AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, round({_COSINE}, 6) AS score FROM v q, v WHERE q.vec_id % 100 = 0 AND len(q.embedding) = len(v.embedding))
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 10""",
    "r02_bm25_topk": rf"WITH {_CHUNKS}, {_bm25('chunks', 20)} SELECT query_id, chunk_id, score, rank FROM ranked",
    "r03_rrf_hybrid": rf"""WITH {_CHUNKS}, {_bm25('chunks', 100)}, v AS (FROM embeddings WHERE {_SOUND}),
d AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, round({_COSINE}, 6) AS score FROM v q JOIN benchmark b ON b.item_id = q.vec_id, v) QUALIFY rank <= 100),
f AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query_id, chunk_id, rank FROM ranked UNION ALL FROM d) GROUP BY ALL)
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM f QUALIFY rank <= 5""",
    "r06_rerank": rf"""WITH {_CHUNKS}, {_bm25('chunks', 20)}, o AS (SELECT r.query_id, r.chunk_id, r.rank AS prior, list_distinct({_tokens('a.text')}) AS q, list_distinct({_tokens('c.text')}) AS t FROM ranked r JOIN asked a USING (query_id) JOIN chunks c USING (chunk_id)),
s AS (SELECT query_id, chunk_id, prior, round(1 / (1 + exp(-round(len(list_intersect(q, t)) * 6.0::DOUBLE / len(q) - 3.0, 9))), 9) AS score FROM o),
k AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, prior) AS rank FROM s QUALIFY rank <= 12) FROM k WHERE score >= 0.05""",
    "r09_calibration_pairs": rf"""WITH {_CHUNKS}, {_bm25('chunks', 1000000000)}, b AS (SELECT chunk_id, source, (row_number() OVER (PARTITION BY source ORDER BY chunk_id) - 1) // 10 + 1 AS batch FROM chunks),
s AS (SELECT query_id, chunk_id, score, source, batch, a.text FROM ranked JOIN asked a USING (query_id) JOIN b USING (chunk_id) WHERE source = 'src' || (query_id % 20))
SELECT source AS dimension_id, batch::BIGINT AS batch_number, md5(text) AS question_md5, row_number() OVER (PARTITION BY query_id, batch ORDER BY score DESC, chunk_id) AS rank, chunk_id::VARCHAR AS document_id, score AS retrieval_score, '' AS related FROM s QUALIFY rank <= 20""",
    "q04_scoped_topk": rf"WITH {_DOCS}, chunks AS (SELECT doc_id AS chunk_id, text FROM docs WHERE source IN ('src1', 'src2', 'src3', 'src4') AND lang IS DISTINCT FROM 'fr' AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)), {_bm25('chunks', 5)} SELECT query_id, chunk_id, score, rank FROM ranked",
    "q05_empty_scope": "SELECT doc_id AS chunk_id, source FROM documents WHERE false",
    "j03_exclude_auxiliary": "SELECT doc_id AS chunk_id, source FROM documents WHERE lang IS DISTINCT FROM 'fr'",
    "g01_context_budget": _context(5, 1200, "'[Page 1] [Source: ' || source || ']'", rf"string_split_regex({_trim('c.text')}, '\s+')"),
    "g02_hierarchy_context": _context(12, 4000, "'[Chunk ' || chunk_id || '] [Source: ' || source || '] [Page 1]'", _words("c.text")),
    "x01_ontology": rf"WITH {_ONTOLOGY} SELECT dimension_no::BIGINT AS dimension_no, dimension_id, category_no::BIGINT AS category_no, category_id, n::BIGINT AS question_no, question FROM asked",
    "q07_grounding": rf"WITH {_MATCHES} SELECT query_id::VARCHAR AS question_id, position::BIGINT AS position, rejected, source FROM judged",
    "q14_responses": r"""SELECT item_id::VARCHAR AS question_id, CASE item_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'The hierarchy model omitted matches.' WHEN 2 THEN 'The hierarchy model returned invalid JSON.' WHEN 3 THEN 'The hierarchy model returned a match without evidence.'
WHEN 4 THEN 'The hierarchy model returned an invalid match explicitness.' ELSE 'The hierarchy model returned an invalid evidence quote.' END AS error, CASE WHEN item_id % 6 IN (1, 2) THEN 0 ELSE 1 END::BIGINT AS matches FROM benchmark""",
    "a04_category_diagnostics": rf"""WITH {_MATCHES}, c AS (SELECT query_id, 'c' || (query_id // 7) AS category_id, text AS question FROM asked),
r AS (SELECT category_id, count(DISTINCT chunk_id) AS n FROM retrieved JOIN c USING (query_id) GROUP BY ALL),
m AS (SELECT category_id, count(DISTINCT question) FILTER (rejected IS NULL) AS q, count(*) FILTER (rejected IS NULL) AS ok, count(*) FILTER (rejected IS NOT NULL) AS bad FROM judged JOIN c USING (query_id) GROUP BY ALL)
SELECT category_id, coalesce(n, 0)::BIGINT AS retrieved_chunks, coalesce(q, 0)::BIGINT AS matched_questions, coalesce(ok, 0)::BIGINT AS matched_candidates, coalesce(bad, 0)::BIGINT AS rejected FROM (SELECT DISTINCT category_id FROM c) LEFT JOIN r USING (category_id) LEFT JOIN m USING (category_id)""",
    "m01_batches": rf"WITH p AS (SELECT doc_id, source AS dimension_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS position FROM documents) SELECT doc_id, dimension_id, position::BIGINT AS position, ((position - 1) // 10 + 1)::BIGINT AS batch_number FROM p",
    "m07_corpus_accept": rf"""WITH {_FETCHED}, tried AS (FROM fetched WHERE n <= 1000), good AS (SELECT *, n = min(n) OVER (PARTITION BY dimension, sha) AS fresh FROM tried WHERE reason IS NULL),
acc AS (SELECT dimension, url, n, row_number() OVER (PARTITION BY dimension ORDER BY n) AS number FROM good WHERE fresh QUALIFY number <= 100), full_ AS (SELECT dimension, max(n) AS stop FROM acc GROUP BY dimension HAVING count(*) = 100),
rej AS (SELECT dimension, url, n, reason FROM tried WHERE reason IS NOT NULL UNION ALL SELECT dimension, url, n, 'duplicate PDF' FROM good WHERE NOT fresh)
SELECT dimension, url, number::BIGINT AS number, NULL::VARCHAR AS reason FROM acc UNION ALL SELECT dimension, url, NULL, reason FROM rej LEFT JOIN full_ USING (dimension) WHERE stop IS NULL OR n < stop""",
    "u02_round_robin": r"""WITH l AS (SELECT regexp_extract(coalesce(url, ''), '^[a-z]+://([^/?#]*)', 1) AS source_no, page_id, coalesce(url, '') AS url FROM pages), t AS (SELECT *, row_number() OVER (PARTITION BY source_no ORDER BY page_id) AS turn FROM l),
o AS (FROM t QUALIFY row_number() OVER (PARTITION BY url ORDER BY turn, source_no) = 1) SELECT url, source_no, turn, row_number() OVER (ORDER BY turn, source_no) AS "order" FROM o""",
    "l06_layout": rf"""WITH {_DOCS}, w AS (SELECT doc_id, {_words('text')} AS w FROM docs), l AS (SELECT doc_id, i, array_to_string(w[i * 8 + 1 : i * 8 + 8], chr(9)) AS line FROM (SELECT *, unnest(range((len(w) + 7) // 8)) AS i FROM w))
SELECT doc_id AS document_id, md5(string_agg(line, chr(10) ORDER BY i)) AS text_md5 FROM l GROUP BY doc_id""",
    "k01_upsert": f"SELECT {_uuid('vec_id::VARCHAR')} AS point_id, vec_id::VARCHAR AS chunk_id, CASE WHEN vec_id % 2 = 0 THEN 9 ELSE label END::BIGINT AS label FROM embeddings",
    "k06_csv_round_trip": rf"WITH {_DOCS} SELECT lpad(doc_id::VARCHAR, 12, '0') AS id, source, md5(text) AS text_md5 FROM docs",
    "b05_blocks": rf"WITH {_BLOCKS} SELECT document_id, page::BIGINT AS page, block_no::BIGINT AS block_no, type, md5(text) AS text_md5, section FROM blocks",
    "b09_rebuilt_pages": rf"WITH {_BLOCKS} SELECT document_id, page::BIGINT AS page, md5(string_agg(text, chr(10) ORDER BY block_no)) AS text_md5 FROM blocks GROUP BY document_id, page",
    "c03_word_starts": rf"WITH {_BLOCKS} SELECT document_id, page::BIGINT AS page, block_no::BIGINT AS block_no, coalesce(sum(len({_words('text')})) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, lead(type) OVER w AS next_type FROM blocks WINDOW w AS (PARTITION BY document_id, page ORDER BY block_no)",
    "c08_packed_groups": rf"WITH RECURSIVE {_PASSAGES} SELECT document_id, ordinal::BIGINT AS ordinal, family, section, md5(body) AS body_md5, page::BIGINT AS page, page_end::BIGINT AS page_end, word_start::BIGINT AS word_start FROM passages",
    "d01_distinct_passages": rf"WITH RECURSIVE {_DISTINCT} SELECT document_id, ordinal::BIGINT AS ordinal, md5(body) AS body_md5 FROM distinct_",
    "c15_document_topics": rf"""WITH {_PAGES.replace("paged AS (SELECT document_id", "all_pages AS (SELECT document_id")}, paged AS (FROM all_pages WHERE page % 7 <> 0), {_BLOCKS.replace(_PAGES + ", ", "", 1)}, {_TOPICS},
q AS (SELECT document_id, string_agg(page::VARCHAR, ',' ORDER BY page) FILTER (page % 7 = 0) AS bad, string_agg(page::VARCHAR, ',' ORDER BY page) FILTER (page % 5 = 0 AND page % 7 <> 0) AS ocr, count(*) FILTER (page % 7 = 0) AS reasons FROM all_pages GROUP BY document_id)
SELECT doc_id AS document_id, coalesce(topic, source) AS document_topic, coalesce(bad, '') AS quarantined, coalesce(ocr, '') AS ocr, reasons::BIGINT AS reasons FROM docs d JOIN q ON q.document_id = d.doc_id LEFT JOIN named n ON n.document_id = d.doc_id""",
    "c16_passage_chunks": rf"""WITH RECURSIVE {_DISTINCT}, {_TOPICS}, keys AS (SELECT doc_id, source, sha1(doc_id || ':' || sha256(text)) AS document_id FROM docs), labelled AS (SELECT *, {_label('section')} AS label FROM distinct_), told AS (SELECT *, coalesce(label || chr(10), '') || body AS text FROM labelled)
SELECT sha1(k.document_id || ':' || t.page || ':' || t.ordinal || ':200:50:pdf:structured-v2-flow') AS chunk_id, k.document_id, source, t.page::BIGINT AS page, row_number() OVER (PARTITION BY k.document_id ORDER BY t.ordinal) AS number, md5(text) AS text_md5, len({_words('text')})::BIGINT AS word_count, label AS section, coalesce(n.topic, source) AS topic,
CASE family WHEN 'prose' THEN 'paragraph' ELSE family END AS block_type, CASE family WHEN 'reference' THEN 'auxiliary' ELSE 'evidence' END AS role FROM told t JOIN keys k ON k.doc_id = t.document_id LEFT JOIN named n ON n.document_id = t.document_id""",
    "flagship": rf"""WITH {_DOCS}, s AS (SELECT doc_id::VARCHAR AS document_id, source, {_words('text')} AS w FROM docs), n AS (SELECT *, unnest(range(CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 200 THEN 1 ELSE (ceil((len(w) - 200) / 150) + 1)::BIGINT END)) * 150 AS a FROM s),
chunks AS (SELECT sha1(document_id || ':1:' || a || ':200:50:txt') AS chunk_id, source, array_to_string(w[a + 1 : a + 200], ' ') AS text FROM n), {_bm25('chunks', 5)},
sized AS (SELECT query_id, rank, c.source, string_split_regex({_trim('c.text')}, '\s+') AS w FROM ranked JOIN chunks c USING (chunk_id)),
used AS (SELECT *, coalesce(sum(len(w)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_ FROM sized QUALIFY before_ < 1200),
kept AS (SELECT *, w[1 : least(len(w), 1200 - before_)::BIGINT] AS k FROM used)
SELECT query_id, string_agg('[Page 1] [Source: ' || source || ']' || chr(10) || array_to_string(k, ' '), chr(10) || chr(10) ORDER BY rank) AS context, sum(len(k))::BIGINT AS words, count(*)::BIGINT AS passages FROM kept GROUP BY query_id""",
}


def oracle_sql() -> dict[str, str]:
    from granary import oracles_io

    return ORACLES | oracles_io.ORACLES
