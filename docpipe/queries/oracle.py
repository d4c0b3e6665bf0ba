"""The results of the registered queries in plain SQL, written independently of the jobs.

Where the input of a query is made from a table, the expected result is mostly made from that table directly, without
the format in between; small sections are merged by a recursive fold, not in closed form.
"""

from __future__ import annotations

from docpipe.constants import ARCHIVE_TEXT_EXTENSIONS, SPACE, SPACE_CLASS
from docpipe.functions import html as H
from docpipe.queries import fixtures as D
from docpipe.queries.registry import MAX_BODY_IN_QUERIES

NL = "chr(10)"
AS_OF = f"TIMESTAMP '{D.AS_OF}'"
ORACLES: dict[str, str] = {}


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """A pattern without possessive quantifiers, as a literal."""
    return lit(pattern.replace("*+", "*").replace("++", "+").replace("?+", "?"))


def trim(expr: str) -> str:
    return f"trim({expr}, {lit(SPACE)})"


def slug(expr: str) -> str:
    key = f"substr(regexp_replace(regexp_replace(lower({expr}), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g'), 1, 60)"
    return f"CASE WHEN {key} = '' THEN 'section' ELSE {key} END"


def case(value: str, results: list[str | None], default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {i} THEN {'NULL' if r is None else lit(r)}" for i, r in enumerate(results))
    return f"CASE {value} {arms} ELSE {default} END"


def add(name: str, sql: str) -> None:
    ORACLES[name] = sql


# ---- sources and sinks

RESPONSES = f"""
resp AS (
  SELECT page_id, url, CASE WHEN page_id % 10 = 9 THEN 404 ELSE 200 END AS status, 'text/html' AS content_type,
    CASE WHEN page_id % 13 = 0 THEN '999999999' WHEN page_id % 13 = 1 THEN 'n/a' ELSE strlen(html)::VARCHAR END AS content_length,
    html, strlen(html)::BIGINT AS body_bytes, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(page_id) AS fetched_at
  FROM pages)"""


def size_reason(limit: int) -> str:
    return f"""CASE
      WHEN try_cast(content_length AS BIGINT) > {limit} THEN 'Download too large: ' || content_length || ' bytes exceeds {limit} byte limit'
      WHEN body_bytes > {limit} THEN 'Download exceeded {limit} byte limit after ' || body_bytes || ' bytes' END"""


def record_id(url: str, micros: str) -> str:
    return f"substr(sha256({url} || chr(1) || {micros}), 1, 32)"


add("responses_scan", f"WITH {RESPONSES} SELECT url, status::BIGINT AS status, content_type, body_bytes, md5(html) AS body_md5 FROM resp")
add("size_guard", f"WITH {RESPONSES} SELECT page_id, {size_reason(MAX_BODY_IN_QUERIES)} AS reason FROM resp")
add("status_gate", f"WITH {RESPONSES} SELECT page_id, status < 400 AS accepted, CASE WHEN status >= 400 THEN 'HTTP ' || status END AS reason FROM resp")
add(
    "raw_passthrough",
    f"WITH {RESPONSES} SELECT url, body_bytes, md5(html) AS body_md5 FROM resp WHERE status < 400 AND {size_reason(104857600)} IS NULL",
)
add(
    "utf8_decode",
    f"""SELECT doc_id, CASE doc_id % 6 WHEN 1 THEN chr(65279) || text WHEN 2 THEN replace(text, {NL}, chr(13) || {NL})
        WHEN 3 THEN text || chr(65533) ELSE text END AS text FROM documents""",
)
add(
    "record_rows",
    f"""WITH {RESPONSES} SELECT {record_id("url", "epoch_us(fetched_at)")} AS record_id, url, content_type, fetched_at,
        strftime(fetched_at, '%Y-%m-%d') AS fetched_date FROM resp""",
)

HEADER_ROWS = f"""
{RESPONSES},
hdr AS (
  SELECT page_id, url || {case("page_id % 7", D.SUFFIXES)} AS url, {case("page_id % 10", D.HEADERS)} AS content_type,
    html, body_bytes FROM resp),
ext AS (SELECT *, list_last(string_split(regexp_extract(lower(url), '^[^?#]*'), '.')) AS extension FROM hdr),
kinds AS (
  SELECT *, CASE
      WHEN content_type ILIKE '%text/html%' THEN 'html'
      WHEN content_type ILIKE '%application/pdf%' THEN 'pdf'
      WHEN content_type ILIKE '%application/json%' THEN 'json'
      WHEN content_type ILIKE '%text/csv%' THEN 'csv'
      WHEN regexp_matches(lower(content_type), 'application/(zip|gzip|x-tar)') THEN 'zip'
      WHEN extension = 'pdf' THEN 'pdf' WHEN extension = 'csv' THEN 'csv'
      WHEN extension IN ('zip', 'tar', 'gz', 'tgz') THEN 'zip'
      WHEN extension = 'json' THEN 'json'
      WHEN extension IN ('html', 'htm') THEN 'html'
      ELSE 'unknown' END AS kind,
    coalesce(regexp_matches(lower(content_type), 'application/pdf|application/octet-stream|image/|audio/|video/'), false) AS is_binary
  FROM ext)"""

add("url_extension", f"WITH {HEADER_ROWS} SELECT page_id, extension FROM kinds")
add("detect_content_type", f"WITH {HEADER_ROWS} SELECT page_id, kind FROM kinds")
add("binary_predicate", f"WITH {HEADER_ROWS} SELECT page_id, is_binary FROM kinds")
add(
    "kind_histogram",
    f"""WITH {HEADER_ROWS} SELECT kind, count(*) AS n_docs, sum(body_bytes)::BIGINT AS total_bytes, max(body_bytes)::BIGINT AS max_bytes,
        count(*) FILTER (body_bytes <= {MAX_BODY_IN_QUERIES}) AS n_small,
        round(count(*) FILTER (body_bytes <= {MAX_BODY_IN_QUERIES}) / count(*), 4) AS small_share FROM kinds GROUP BY kind""",
)
add(
    "binary_originals",
    f"""WITH {HEADER_ROWS} SELECT url, CASE kind WHEN 'pdf' THEN 'document' WHEN 'zip' THEN 'archive' ELSE 'file' END AS key,
        CASE kind WHEN 'pdf' THEN 'document.pdf' WHEN 'zip' THEN 'archive.zip' ELSE 'file.bin' END AS filename,
        body_bytes, md5(html) AS body_md5 FROM kinds WHERE kind IN ('pdf', 'zip') OR (kind = 'unknown' AND is_binary)""",
)
add(
    "large_predicate",
    "SELECT doc_id, strlen(text)::BIGINT AS n_bytes, strlen(text) > 51200 AS is_large, strlen(text) > 2000 AS over_2000 FROM documents",
)
add(
    "stream_ingest",
    f"""WITH {RESPONSES} SELECT {record_id("url", "epoch_us(fetched_at)")} AS record_id, url, content_type, fetched_at,
        'html' AS kind, body_bytes FROM resp WHERE status < 400 AND {size_reason(104857600)} IS NULL""",
)

# ---- published runs

DOCUMENT_RESPONSES = f"""
kinds AS (
  SELECT doc_id, source, '{{"id": ' || doc_id || ', "source": "' || source || '"}}' AS about, text,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS fetched_at FROM documents),
answers AS (
  SELECT k.*, e.suffix, e.content_type, 'https://example.org/' || doc_id || e.suffix AS url,
    CASE e.suffix WHEN '.json' THEN about || CASE WHEN doc_id % 7 = 0 THEN ',' ELSE '' END
      WHEN '.html' THEN '<h1>' || source || '</h1><p>' || doc_id || '</p>' ELSE text END AS body,
    CASE WHEN doc_id % 13 = 1 THEN 'size' WHEN doc_id % 10 = 9 THEN 'status' WHEN body IS NULL THEN 'body'
      WHEN e.suffix = '.json' AND doc_id % 7 = 0 THEN 'convert' END AS stage
  FROM kinds k, (VALUES ('.txt', 'text/plain'), ('.png', 'image/png'), ('.html', 'text/html'), ('.json', 'application/json')) e(suffix, content_type)),
ids AS (SELECT *, {record_id("url", "epoch_us(fetched_at)")} AS record_id, strlen(body) > 2000 AS large FROM answers WHERE stage IS NULL),
five AS (
  SELECT 'results' AS tbl, url AS identity,
    CASE suffix WHEN '.txt' THEN 'text' WHEN '.png' THEN 'binary' WHEN '.html' THEN 'markdown' ELSE 'json' END AS first,
    CASE WHEN suffix = '.png' OR (suffix = '.txt' AND large) THEN 'false' ELSE 'true' END AS second,
    md5(CASE WHEN suffix = '.html' THEN '# ' || source || chr(10) || chr(10) || doc_id
      WHEN suffix = '.json' THEN '{{' || chr(10) || '  "id": ' || doc_id || ',' || chr(10) || '  "source": "' || source || '"' || chr(10) || '}}'
      WHEN suffix = '.txt' AND NOT large THEN text ELSE '' END) AS content FROM ids
  UNION ALL SELECT 'records', url, content_type, strftime(fetched_at, '%Y-%m-%d'), md5(record_id) FROM ids WHERE suffix = '.png' OR (suffix = '.txt' AND large)
  UNION ALL SELECT 'chunks', record_id, 'content', '0/' || strlen(text), md5(text) FROM ids WHERE suffix = '.txt' AND large
  UNION ALL SELECT 'originals', record_id, 'file', 'file.bin', md5(text) FROM ids WHERE suffix = '.png'
  UNION ALL SELECT 'rejects', url, stage, CASE stage WHEN 'size' THEN 'Download too large: 999999999 bytes exceeds 104857600 byte limit'
      WHEN 'status' THEN 'HTTP 500' WHEN 'body' THEN 'missing body' ELSE 'invalid JSON' END, md5('') FROM answers WHERE stage IS NOT NULL)
"""

add(
    "retention_all_tables",
    f"""WITH {DOCUMENT_RESPONSES.replace("FROM documents)", "FROM documents WHERE doc_id >= 100)")}
        SELECT five.*, step FROM five, (VALUES ('logged'), ('compacted')) s(step)""",
)
add("ingest_tables", f"WITH {DOCUMENT_RESPONSES} SELECT * FROM five")
add("stream_tables", f"WITH {DOCUMENT_RESPONSES} SELECT * FROM five")
add(
    "ingest_accounting",
    f"""WITH {DOCUMENT_RESPONSES} SELECT url, (stage IS NULL)::BIGINT AS n_results, (stage IS NOT NULL)::BIGINT AS n_rejects,
        (SELECT count(*) FROM answers) AS run_inputs, (SELECT count(*) FROM five WHERE tbl = 'results') AS run_results,
        (SELECT count(*) FROM five WHERE tbl = 'rejects') AS run_rejects, (SELECT count(*) FROM five WHERE tbl = 'chunks') AS run_chunks FROM answers""",
)

# ---- plain text

HEADING = f"""(length(t) BETWEEN 2 AND 120 AND (
    regexp_matches(t, '^\\d+(\\.\\d+)*\\.?[{SPACE_CLASS}]')
    OR regexp_matches(t, '(?i)^(chapter|section|part|appendix)[{SPACE_CLASS}]+\\d')
    OR (t = upper(replace(t, 'ß', 'ss')) AND length(t) > 3)
    OR regexp_matches(t, '(?i)^(abstract|introduction|background|method|result|discussion|conclusion|references|acknowledgment)')))"""


def text_parts(source: str) -> str:
    """lines, secs (numbered sections) of a relation (doc_id, text)."""
    return f"""
lines AS (
  SELECT *, {HEADING} AS is_h FROM (
    SELECT doc_id, i, line, {trim("line")} AS t FROM (
      SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i
      FROM (SELECT doc_id, string_split(text, {NL}) AS parts FROM {source})))),
secs AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS idx, title, {slug("title")} AS key, content FROM (
    SELECT doc_id, sec, coalesce(max(t) FILTER (is_h), 'introduction') AS title,
      {trim(f"string_agg(line, {NL} ORDER BY i) FILTER (NOT is_h AND t <> '')")} AS content
    FROM (SELECT *, sum(is_h::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS sec FROM lines)
    GROUP BY doc_id, sec)
  WHERE content <> '')"""


def text_chunks(source: str) -> str:
    """chunks (doc_id, chunk_index, key, title, content); needs WITH RECURSIVE."""
    return f"""{text_parts(source)},
fold AS (
  SELECT doc_id, idx, 0::BIGINT AS grp, length(content)::BIGINT AS acc FROM secs WHERE idx = 0
  UNION ALL
  SELECT s.doc_id, s.idx,
    CASE WHEN f.acc < 1000 OR length(s.content) < 1000 THEN f.grp ELSE f.grp + 1 END,
    CASE WHEN f.acc < 1000 OR length(s.content) < 1000 THEN f.acc + 2 + length(s.content) ELSE length(s.content) END
  FROM fold f JOIN secs s ON s.doc_id = f.doc_id AND s.idx = f.idx + 1),
paras AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS idx, {trim("p")} AS content FROM (
    SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (
      SELECT doc_id, regexp_split_to_array(text, '\\n\\n+') AS ps FROM {source}
      WHERE doc_id NOT IN (SELECT doc_id FROM secs)))
  WHERE {trim("p")} <> ''),
chunks AS (
  SELECT doc_id, grp AS chunk_index, arg_min(key, idx) AS key, arg_min(title, idx) AS title,
    string_agg(content, {NL} || {NL} ORDER BY idx) AS content
  FROM secs JOIN fold USING (doc_id, idx) GROUP BY doc_id, grp
  UNION ALL
  SELECT doc_id, idx, 'para_' || idx, 'paragraph ' || (idx + 1), content FROM paras)"""


TRANSCRIPTS = f"""
transcripts AS (
  SELECT conv_id || '/' || (turn // {D.TURNS_PER_BLOCK}) AS doc_id,
    string_agg('Section ' || turn || ' ' || role || {NL} || text, {NL} ORDER BY turn) AS text
  FROM conversations GROUP BY conv_id, turn // {D.TURNS_PER_BLOCK})"""
ALL_HEADINGS = f"""
words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(upper(replace(text, 'ß', 'ss')), '\\s+'), lambda w: w <> '') AS ws FROM documents),
headings AS (
  SELECT doc_id, array_to_string(list_transform(generate_series(0, greatest(len(ws) - 1, 0) // 4), lambda i: array_to_string(ws[i * 4 + 1 : i * 4 + 4], ' ')),
    {NL} || {NL}) AS text FROM words)"""

add(
    "chunk_rows",
    f"""WITH RECURSIVE {TRANSCRIPTS}, {text_chunks("transcripts")}
        SELECT doc_id AS record_id, chunk_index, key, title, content, strlen(content)::BIGINT AS size_bytes,
          {AS_OF} AS created_at, {AS_OF} + INTERVAL 1 DAY AS expires_at FROM chunks""",
)
add("text_lines", f"SELECT doc_id, (generate_subscripts(parts, 1) - 1)::BIGINT AS line_no, unnest(parts) AS line FROM (SELECT doc_id, string_split(text, {NL}) AS parts FROM documents)")
add(
    "text_headings",
    f"""WITH {TRANSCRIPTS}, src AS (SELECT doc_id, text FROM transcripts UNION ALL SELECT doc_id::VARCHAR, text FROM documents),
        {text_parts("src")} SELECT doc_id, (i - 1)::BIGINT AS line_no, t AS heading FROM lines WHERE is_h""",
)
add("text_sections", f"WITH {TRANSCRIPTS}, {text_parts('transcripts')} SELECT doc_id, idx AS chunk_index, key, title, content FROM secs")
add(
    "slug_keys",
    f"""WITH {text_parts("documents")}, titles AS (
          SELECT t AS title FROM lines WHERE is_h
          UNION SELECT array_to_string(string_split(url, '/')[-2:], '/') FROM pages
          UNION SELECT string_split(text, {NL})[1] FROM documents)
        SELECT title, {slug("title")} AS key FROM titles""",
)
add(
    "text_paragraphs",
    f"""WITH RECURSIVE {ALL_HEADINGS}, {text_chunks('headings')}
        SELECT doc_id, idx AS chunk_index, 'para_' || idx AS key, 'paragraph ' || (idx + 1) AS title, content FROM paras""",
)
add("text_merge_small", f"WITH RECURSIVE {TRANSCRIPTS}, {text_chunks('transcripts')} SELECT doc_id, chunk_index, key, title, content FROM chunks")
add("text_chunks", f"WITH RECURSIVE {text_chunks('documents')} SELECT doc_id, chunk_index, key, title, content FROM chunks")
add(
    "text_fallback",
    """SELECT doc_id, 'text' AS type, strlen(text) <= 2000 AS "inline", CASE WHEN strlen(text) <= 2000 THEN text ELSE '' END AS data,
       CASE WHEN strlen(text) > 2000 THEN 'content' END AS key, CASE WHEN strlen(text) > 2000 THEN 'content' END AS title,
       CASE WHEN strlen(text) > 2000 THEN text END AS content FROM documents""",
)
PDFS = """
pdfs AS (
  SELECT doc_id, 'https://example.org/' || source || '/' || doc_id || '.pdf' AS url,
    CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN ' ' ELSE text END AS text FROM documents)"""
add(
    "pdf_text_outcomes",
    f"""WITH {PDFS}, o AS (SELECT doc_id, CASE WHEN text IS NULL THEN 'failed' WHEN {trim("text")} = '' THEN 'blank' ELSE 'text' END AS outcome FROM pdfs)
        SELECT doc_id, outcome, CASE WHEN outcome <> 'text' THEN 'document' END AS key, CASE WHEN outcome <> 'text' THEN 'original pdf' END AS title,
          CASE outcome WHEN 'failed' THEN 'PDF text extraction failed' WHEN 'blank' THEN 'PDF contains no extractable text' END AS content FROM o""",
)
MICROS_2024 = "epoch_us(TIMESTAMP '2024-01-01')"
add(
    "derived_records",
    f"""WITH RECURSIVE {PDFS}, readable AS (SELECT * FROM pdfs WHERE {trim("text")} <> ''), {text_chunks("readable")},
        recs AS (
          SELECT url, 'application/pdf' AS content_type, NULL::BIGINT AS doc_id FROM pdfs
          UNION ALL SELECT 'pdf:text:' || url, 'text/markdown', doc_id FROM readable)
        SELECT {record_id("url", MICROS_2024)} AS record_id, url, content_type,
          CASE WHEN chunk_index IS NOT NULL THEN 'section_' || lpad(chunk_index::VARCHAR, greatest(2, length(chunk_index::VARCHAR))::INT, '0') || '.md' END AS filename,
          key, title, strlen(content)::BIGINT AS size_bytes
        FROM recs LEFT JOIN chunks USING (doc_id)""",
)

# ---- HTML. The pages have a known structure, which these statements rely on.

BODY = f"body AS (SELECT page_id, regexp_replace(html, {re2(H.NOISE)}, '', 'g') AS body FROM pages)"
TOKENS = f"""
{BODY},
tok AS (SELECT page_id, unnest(ts) AS token, generate_subscripts(ts, 1) AS pos FROM (
  SELECT page_id, regexp_extract_all(body, {re2(H.TOKEN)}) AS ts FROM body)),
tags AS (SELECT *, CASE WHEN length(token) > 1 AND token[1] = '<' THEN lower(regexp_extract(token, '^</?([a-zA-Z][^\\s/>]*)', 1)) END AS tag FROM tok)"""
in_list = lambda names: ", ".join(lit(n) for n in names)


def decode(expr: str) -> str:
    """The entities that occur; a reference may lack its semicolon."""
    expr = f"regexp_replace({expr}, '&(amp|quot|copy|middot|lt|gt)([^;a-zA-Z0-9]|$)', '&\\1;\\2', 'g')"
    for name, char in (("middot", "·"), ("copy", "©"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        expr = f"replace({expr}, '&{name};', '{char}')"
    return expr


def escape(expr: str) -> str:
    expr = f"regexp_replace({expr}, '([\\\\*`\\[\\]_])', '\\\\\\1', 'g')"
    expr = f"regexp_replace({expr}, '^(-|\\+ |=+|#{{1,6}} |~~~|>)', '\\\\\\1')"
    return f"regexp_replace({expr}, '^(\\d+)\\. ', '\\1\\\\. ')"


def collapse(expr: str) -> str:
    return f"regexp_replace({expr}, '[ \\t\\r\\n]+', ' ', 'g')"


BLOCK_TAG = "</?(?:nav|ul|li|div|article|h1|p|footer)(?:\\s[^>]*)?>"
BLOCKS = f"""
{BODY},
cut AS (SELECT page_id, regexp_split_to_array(body, '{BLOCK_TAG}') AS texts, regexp_extract_all(body, '{BLOCK_TAG}') AS tags FROM body),
raw AS (
  SELECT page_id, i - 1 AS block, texts[i] AS seg, CASE WHEN i > 1 THEN tags[i - 1] ELSE '' END AS tag_text
  FROM (SELECT *, unnest(generate_series(1, len(texts))) AS i FROM cut)),
frags AS (
  SELECT page_id, block, seg, CASE WHEN tag_text[2] = '/' THEN '' ELSE regexp_extract(tag_text, '^<([a-z0-9]+)', 1) END AS tag,
    regexp_extract_all(seg, '<[^>]*>|[^<]+') AS fs FROM raw),
inner_text AS (
  SELECT page_id, block, tag, contains(seg, '<b>') AS bold,
    trim(regexp_replace(array_to_string(list_transform(fs, lambda f, i: CASE
      WHEN f LIKE '<a %' THEN '['
      WHEN f = '</a>' THEN '](' || {decode("regexp_extract(fs[i - 2], 'href=\"([^\"]*)\"', 1)")} || ')'
      WHEN f LIKE '<%' THEN ''
      ELSE {escape(decode(collapse("ltrim(f)")))} END), ''), ' +', ' ', 'g')) AS t
  FROM frags),
blocks AS (SELECT page_id, block, tag, CASE WHEN bold THEN '**' || t || '**' ELSE t END AS text FROM inner_text WHERE t <> ''),
marked AS (
  SELECT page_id, block, CASE
      WHEN lag(tag) OVER w IS NULL THEN ''
      WHEN tag = 'li' AND lag(tag) OVER w = 'li' THEN {NL}
      ELSE {NL} || {NL} END
    || CASE tag WHEN 'li' THEN '*   ' WHEN 'h1' THEN '# ' ELSE '' END || text AS md
  FROM blocks WINDOW w AS (PARTITION BY page_id ORDER BY block)),
pages_md AS (
  SELECT page_id, coalesce(string_agg(md, '' ORDER BY block), '') AS markdown FROM pages LEFT JOIN marked USING (page_id) GROUP BY page_id)"""
PAGE_SECTIONS = f"""
{BODY},
page_sections AS (
  SELECT page_id, {trim(f"array_to_string(list_filter(regexp_extract_all(body, '(?s)<(?:nav|div|article|footer)(?:\\s[^>]*)?>(.*?)</(?:nav|div|article|footer)>', 1), lambda x: {trim('x')} <> ''), {NL})")} AS content FROM body)"""
ARTICLES = f"""
articles AS (
  SELECT source || '/' || (doc_id // {D.DOCS_PER_BLOCK}) AS article_id, doc_id, source || ' doc ' || doc_id AS title, text,
    {trim("replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')")} AS content
  FROM documents),
article_sections AS (
  SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY doc_id) - 1 AS chunk_index,
    trim(regexp_replace({escape(collapse(trim("text")))}, ' +', ' ', 'g')) AS markdown
  FROM articles WHERE content <> '')"""

add("html_body", f"WITH {BODY} SELECT * FROM body")
add(
    "html_tokens",
    f"""WITH {TOKENS} SELECT page_id, pos::BIGINT AS pos, token, tag, CASE WHEN tag IS NULL THEN 'text' WHEN tag IN ({in_list(H.VOID_TAGS)}) THEN 'void'
        WHEN token[2] = '/' THEN 'close' ELSE 'open' END AS kind FROM tags""",
)
add(
    "html_tag_counts",
    f"""WITH {TOKENS} SELECT tag, count(*) AS n_tags, count(*) FILTER (token[2] = '/') AS n_closing,
        CASE WHEN tag IN ({in_list(H.BLOCK_TAGS)}) THEN 'block' WHEN tag IN ({in_list(H.VOID_TAGS)}) THEN 'void' ELSE 'inline' END AS role
        FROM tags WHERE tag IS NOT NULL GROUP BY tag""",
)
add("html_blocks", f"WITH {BLOCKS} SELECT page_id, block::BIGINT AS block, tag, text FROM blocks")
add("html_to_markdown", f"WITH {BLOCKS} SELECT page_id, markdown FROM pages_md")
add(
    "html_nested_marks",
    """WITH d AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g')) AS words FROM documents)
        SELECT doc_id, 'x' || repeat('**', (doc_id % 8 + 1)::INT) || 'a' || chr(2) || ' ' || CASE WHEN words = '' THEN '' ELSE words || ' ' END || chr(16) || 'B'
          || repeat('**', (doc_id % 8 + 1)::INT) || chr(1) || ' ' || repeat('_', (doc_id % 6)::INT) || 'e' || repeat('_', (doc_id % 6)::INT)
          || chr(10) || chr(10) || 'nd' AS markdown FROM d""",
)
add(
    "html_links",
    f"""WITH {BODY}, found AS (
          SELECT page_id, regexp_extract_all(body, '<a href="([^"]*)"[^>]*>', 1) AS hrefs, regexp_extract_all(body, '(?s)<a href="[^"]*"[^>]*>(.*?)</a>', 1) AS texts FROM body)
        SELECT page_id, unnest(generate_series(1, len(hrefs)))::BIGINT AS link_no, {decode("unnest(hrefs)")} AS href,
          trim({decode(collapse("unnest(texts)"))}) AS text FROM found""",
)
add("html_entities", f"SELECT page_id, {decode('html')} AS decoded FROM pages")
add(
    "html_sections",
    f"""WITH {PAGE_SECTIONS}, {ARTICLES}
        SELECT page_id::VARCHAR AS article_id, 0::BIGINT AS chunk_index, 'content' AS key, 'content' AS title, content FROM page_sections
        UNION ALL SELECT article_id, chunk_index, {slug("title")}, title, content FROM article_sections""",
)
add(
    "html_section_markdown",
    f"WITH {ARTICLES} SELECT article_id, chunk_index, {slug('title')} AS key, title, markdown AS content FROM article_sections",
)

# ---- CSV, from the customers directly


def customers(by: str = "c_mktsegment") -> str:
    name = "c_name || ', \"q\"'"
    row = f"['' || c_custkey, {name}] || CASE WHEN c_custkey % 10 = 0 THEN [] ELSE ['' || c_nationkey] END"
    return f"""
rows AS (
  SELECT doc_id, 0 AS row_idx, ['key', 'name', 'nation'] AS fields FROM (SELECT DISTINCT {by} || '/' || (c_custkey // {D.ROWS_PER_BLOCK}) AS doc_id FROM customer)
  UNION ALL
  SELECT {by} || '/' || (c_custkey // {D.ROWS_PER_BLOCK}), row_number() OVER (PARTITION BY {by}, c_custkey // {D.ROWS_PER_BLOCK} ORDER BY c_custkey), {row}
  FROM customer),
drawn AS (SELECT *, '| ' || array_to_string(fields || CASE WHEN len(fields) < 3 THEN [''] ELSE [] END, ' | ') || ' |' AS line,
  max(row_idx) OVER (PARTITION BY doc_id) AS last FROM rows)"""


HEAD_LINES = f"'| key | name | nation |' || {NL} || '| --- | --- | --- |' || {NL}"
add("csv_cells", f"WITH {customers()} SELECT doc_id, row_idx::BIGINT AS row_idx, (generate_subscripts(fields, 1) - 1)::BIGINT AS col_idx, unnest(fields) AS value FROM rows")
add("csv_shape", f"WITH {customers()} SELECT doc_id, count(*) AS n_rows, max(len(fields))::BIGINT AS n_cols, 3::BIGINT AS header_cols FROM rows GROUP BY doc_id")
add(
    "csv_to_markdown",
    f"WITH {customers('c_nationkey')} SELECT doc_id, {HEAD_LINES} || string_agg(line, {NL} ORDER BY row_idx) AS markdown FROM drawn WHERE row_idx > 0 GROUP BY doc_id",
)
CSV_GROUPS = f"""
groups AS (
  SELECT doc_id, (row_idx - 1) // 100 AS chunk_index, min(row_idx) AS s, max(row_idx) AS e,
    {HEAD_LINES} || string_agg(line, {NL} ORDER BY row_idx) AS content
  FROM drawn WHERE row_idx > 0 AND last + 1 > 101 GROUP BY doc_id, (row_idx - 1) // 100)"""
add("csv_row_groups", f"WITH {customers()}, {CSV_GROUPS} SELECT doc_id, chunk_index::BIGINT AS chunk_index, 'rows_' || s || '_' || e AS key, 'rows ' || s || '-' || e AS title, content FROM groups")
add(
    "forced_inline",
    f"""WITH {customers()}, {DOCUMENT_RESPONSES}, tables AS (
          SELECT 'https://example.org/' || doc_id AS url, 'csv' AS type, max(last) + 1 <= 101 AS "inline",
            {HEAD_LINES} || string_agg(line, {NL} ORDER BY row_idx) AS data FROM drawn WHERE row_idx > 0 GROUP BY doc_id),
        shown AS (
          SELECT url, suffix, body, CASE suffix WHEN '.html' THEN '# ' || source || {NL} || {NL} || doc_id WHEN '.txt' THEN text
            WHEN '.json' THEN '{{' || {NL} || '  "id": ' || doc_id || ',' || {NL} || '  "source": "' || source || '"' || {NL} || '}}' ELSE '' END AS data FROM ids)
        SELECT * FROM tables
        UNION ALL SELECT url, CASE suffix WHEN '.html' THEN 'markdown' WHEN '.txt' THEN 'text' WHEN '.json' THEN 'json' ELSE 'binary' END,
          suffix <> '.png' AND strlen(CASE suffix WHEN '.html' THEN data ELSE body END) <= 30, data FROM shown""",
)

# ---- JSON, from the events directly


def pretty_props(indent: int) -> str:
    pad = " " * indent
    return f"regexp_replace(props, '^\\{{(\"[a-z]+\": [0-9]+)\\}}$', '{{' || {NL} || '{pad}  \\1' || {NL} || '{pad}}}')"


BROKEN = """
broken AS (
  SELECT event_id, props, CASE event_id % 12
      WHEN 1 THEN props || ' x' WHEN 2 THEN props || ',' WHEN 3 THEN '[' || props || ',]' WHEN 4 THEN replace(props, '"', '''')
      WHEN 5 THEN '[' || props || ',01]' WHEN 6 THEN '[' || props || '}' WHEN 7 THEN replace(props, ':', ',')
      WHEN 8 THEN '[' || props || ', null, -1.5e3]' ELSE props END AS json FROM events)"""
# json_valid of the engine lets a comma before a closing bracket pass.
VALID = "(json_valid(json) AND NOT regexp_matches(json, ',\\s*[\\]}]'))"
add("json_valid", f"WITH {BROKEN} SELECT event_id, {VALID} AS valid FROM broken")
add(
    "json_pretty",
    f"""WITH {BROKEN} SELECT event_id, {VALID} AS valid, CASE WHEN {VALID} THEN CASE WHEN event_id % 12 = 8
        THEN '[' || {NL} || '  ' || {pretty_props(2)} || ',' || {NL} || '  null,' || {NL} || '  -1.5e3' || {NL} || ']' ELSE {pretty_props(0)} END END AS pretty FROM broken""",
)
EVENT_BLOCK = f"(event_id // {D.EVENTS_PER_BLOCK})"
add(
    "json_members",
    f"""SELECT user_id || '/' || {EVENT_BLOCK} AS doc_id, row_number() OVER (PARTITION BY user_id, {EVENT_BLOCK} ORDER BY event_id) - 1 AS chunk_index,
        'e' || event_id AS key, 'e' || event_id AS title, {pretty_props(0)} AS content FROM events""",
)
ITEMS = f"""
items AS (
  SELECT event_type || '/' || {EVENT_BLOCK} AS doc_id, row_number() OVER (PARTITION BY event_type, {EVENT_BLOCK} ORDER BY event_id) - 1 AS chunk_index,
    strlen('{{"id": ' || event_id || ', "user": ' || user_id || ', "type": "' || event_type || '", "props": ' || props || '}}') AS n_bytes,
    '{{' || {NL} || '  "id": ' || event_id || ',' || {NL} || '  "user": ' || user_id || ',' || {NL} || '  "type": "' || event_type || '",' || {NL}
    || '  "props": ' || {pretty_props(2)} || {NL} || '}}' AS content FROM events)"""
add("json_items", f"WITH {ITEMS} SELECT doc_id, chunk_index, 'item_' || chunk_index AS key, '[' || chunk_index || ']' AS title, content FROM items")
FILE_ROWS = f"""
file_rows AS (
  SELECT c_custkey // 1000000 AS block, row_number() OVER (PARTITION BY c_custkey // 1000000 ORDER BY c_custkey) AS row_idx, c_custkey::VARCHAR AS key,
    c_name || ', "q"' || CASE WHEN c_custkey % 5 = 0 THEN {NL} || 'line' ELSE '' END AS name,
    CASE WHEN c_custkey % 10 <> 0 THEN c_nationkey::VARCHAR END AS nation FROM customer
  UNION ALL SELECT DISTINCT c_custkey // 1000000, 0, 'key', 'name', 'nation' FROM customer)"""
add(
    "csv_file_cells",
    f"""WITH {FILE_ROWS} SELECT block, row_idx, 0::BIGINT AS col_idx, key AS value FROM file_rows
        UNION ALL SELECT block, row_idx, 1, name FROM file_rows UNION ALL SELECT block, row_idx, 2, nation FROM file_rows WHERE nation IS NOT NULL""",
)
add(
    "csv_file_groups",
    f"""WITH {FILE_ROWS} SELECT block, (row_idx - 1) // 100 AS chunk_index, 'rows_' || min(row_idx) || '_' || max(row_idx) AS key,
        'rows ' || min(row_idx) || '-' || max(row_idx) AS title, '| key | name | nation |' || {NL} || '| --- | --- | --- |' || {NL}
        || string_agg('| ' || key || ' | ' || name || ' | ' || coalesce(nation, '') || ' |', {NL} ORDER BY row_idx) AS content
        FROM file_rows WHERE row_idx > 0 AND block IN (SELECT block FROM file_rows GROUP BY block HAVING count(*) > 101) GROUP BY block, (row_idx - 1) // 100""",
)
add(
    "json_file_items",
    f"""WITH n AS (SELECT *, event_id // 1000000 AS block, row_number() OVER (PARTITION BY event_id // 1000000 ORDER BY event_id) - 1 AS chunk_index FROM events)
        SELECT block, chunk_index, 'item_' || chunk_index AS key, '[' || chunk_index || ']' AS title, '{{' || {NL} || '  "id": ' || event_id || ',' || {NL}
        || '  "type": "a,[' || event_type || '",' || {NL} || '  "props": ' || {pretty_props(2)} || {NL} || '}}' AS content FROM n""",
)
add(
    "json_scalar",
    """SELECT event_id, 0::BIGINT AS chunk_index, 'value' AS key, 'value' AS title,
       CASE event_id % 4 WHEN 0 THEN '"' || event_type || '"' WHEN 1 THEN '' || user_id WHEN 2 THEN 'true' ELSE 'null' END AS content FROM events""",
)
add(
    "rejects_by_reason",
    f"""WITH {RESPONSES}, {BROKEN}, r AS (
          SELECT CASE WHEN {size_reason(MAX_BODY_IN_QUERIES)} IS NOT NULL THEN 'size' ELSE 'status' END AS stage,
            coalesce({size_reason(MAX_BODY_IN_QUERIES)}, 'HTTP ' || status) AS reason
          FROM resp WHERE status >= 400 OR {size_reason(MAX_BODY_IN_QUERIES)} IS NOT NULL
          UNION ALL SELECT 'convert', 'invalid JSON' FROM broken WHERE NOT {VALID})
        SELECT stage, count(*) AS n_rejects, count(DISTINCT reason) AS n_reasons FROM r GROUP BY stage""",
)

# ---- archives

MEMBERS = f"""
docs AS (SELECT *, source || '/' || (doc_id // {D.DOCS_PER_BLOCK}) AS archive_id FROM documents),
members AS (
  SELECT archive_id, doc_id + 1 AS entry_index, lang || '/Doc ' || doc_id || {case("doc_id % 5", D.EXTENSIONS)} AS entry_name,
    strlen(text)::BIGINT AS size, false AS is_directory, text AS content FROM docs
  UNION ALL SELECT DISTINCT archive_id, 0, 'docs/', 0, true, NULL FROM docs),
texts AS (
  SELECT *, {trim("content")} AS trimmed FROM members
  WHERE NOT is_directory AND list_last(string_split(lower(entry_name), '.')) IN ({in_list(ARCHIVE_TEXT_EXTENSIONS)})),
listings AS (
  SELECT archive_id, 'Archive contains ' || count(*) || ' files:' || {NL} || {NL}
    || string_agg(entry_name || '  (' || size || ' B)', {NL} ORDER BY entry_index) AS content FROM members GROUP BY archive_id)"""
MEMBER_KEY = "substr(regexp_replace(entry_name, '(?i)[^a-z0-9._-]+', '_', 'g'), 1, 60)"
ARCHIVE_NO = "(regexp_extract(archive_id, '^src(\\d+)/', 1)::INT % 5)"
BROKEN_ID = f"(CASE WHEN {ARCHIVE_NO} = 0 THEN 'lost/' ELSE '' END || archive_id)"
add("archive_index", f"WITH {MEMBERS} SELECT archive_id, 'index' AS key, 'file index' AS title, content FROM listings")
add("archive_text_members", f"WITH {MEMBERS} SELECT archive_id, entry_index, entry_name, size FROM texts")
add(
    "archive_member_chunks",
    f"WITH {MEMBERS} SELECT archive_id, entry_index, {MEMBER_KEY} AS key, entry_name AS title, trimmed AS content FROM texts WHERE trimmed <> ''",
)
add(
    "archive_errors",
    f"""WITH {MEMBERS} SELECT DISTINCT {BROKEN_ID} AS archive_id, 'error' AS key, 'extraction error' AS title, 'Failed to extract archive contents.' AS content,
        {ARCHIVE_NO} = 0 AS lone FROM members WHERE {ARCHIVE_NO} IN (0, 1)""",
)
add(
    "archive_chunks",
    f"""WITH {MEMBERS}, c AS (
          SELECT archive_id, -1 AS pos, 'index' AS key, 'file index' AS title, length(content) AS n_chars FROM listings
          UNION ALL SELECT archive_id, entry_index, {MEMBER_KEY}, entry_name, length(trimmed) FROM texts WHERE trimmed <> ''
          UNION ALL SELECT DISTINCT {BROKEN_ID}, 1000000000000, 'error', 'extraction error', 35 FROM members WHERE {ARCHIVE_NO} IN (0, 1))
        SELECT archive_id, row_number() OVER (PARTITION BY archive_id ORDER BY pos) - 1 AS chunk_index, key, title, n_chars::BIGINT AS n_chars FROM c""",
)

# ---- routing of all kinds

add(
    "route_summary",
    f"""WITH {BLOCKS}, {ARTICLES}, {BROKEN}, {ITEMS}, {PDFS},
        {customers()}, {customers('c_nationkey').replace('rows AS', 'rows2 AS').replace('FROM rows)', 'FROM rows2)').replace('drawn AS', 'drawn2 AS')},
        article_md AS (
          SELECT article_id, sum(strlen('## ' || title || {NL} || {NL} || markdown) + 2) - 2 AS n_bytes, count(*) AS n_chunks FROM article_sections GROUP BY article_id),
        arrays AS (SELECT doc_id, sum(n_bytes + 2) AS n_bytes, count(*) AS n_chunks FROM items GROUP BY doc_id),
        tables AS (
          SELECT doc_id, max(row_idx) AS n FROM drawn GROUP BY doc_id
          UNION ALL SELECT doc_id, max(row_idx) FROM drawn2 GROUP BY doc_id),
        r AS (
          SELECT 'markdown' AS type, strlen(markdown) <= 51200 AS "inline", CASE WHEN strlen(markdown) > 51200 THEN 1 ELSE 0 END AS n FROM pages_md
          UNION ALL SELECT 'markdown', n_bytes <= 51200, CASE WHEN n_bytes > 51200 THEN n_chunks ELSE 0 END FROM article_md
          UNION ALL SELECT 'json', true, 0 FROM broken WHERE {VALID}
          UNION ALL SELECT 'json', n_bytes <= 51200, CASE WHEN n_bytes > 51200 THEN n_chunks ELSE 0 END FROM arrays
          UNION ALL SELECT 'csv', n <= 100, CASE WHEN n <= 100 THEN 0 ELSE (n + 99) // 100 END FROM tables
          UNION ALL SELECT 'pdf', false, 0 FROM pdfs
          UNION ALL SELECT 'text', strlen(text) <= 51200, (strlen(text) > 51200)::INT FROM documents
          UNION ALL SELECT 'binary', false, 0 FROM documents)
        SELECT type, "inline", count(*) AS n_docs, sum(n)::BIGINT AS n_chunks FROM r GROUP BY type, "inline" """,
)

# ---- records

RECORDS = """
recs AS (
  SELECT 'r' || event_id AS record_id, event_id, 'https://example.org/' || event_type || '/' || event_id AS url, ts AS fetched_at FROM events),
crecs AS (
  SELECT 'c' || conv_id AS record_id, 'https://example.org/c/' || conv_id AS url, 'text/markdown' AS content_type,
    TIMESTAMP '2023-12-20 00:00:00' + to_hours(conv_id * 12) AS fetched_at FROM conversations WHERE turn = 0),
chunks AS (
  SELECT 'c' || conv_id AS record_id, turn AS chunk_index, role AS key, role AS title, text AS content, strlen(text)::BIGINT AS size_bytes FROM conversations),
requests AS (
  SELECT DISTINCT 'c' || (c_custkey // 10) AS record_id, CASE c_custkey % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'assistant' ELSE 'nope' END AS key FROM customer)"""
LIVE = f"fetched_at >= {AS_OF} - INTERVAL 30 DAY"


def status(at: str = "fetched_at") -> str:
    return f"CASE WHEN {AS_OF} - {at} > INTERVAL 30 DAY THEN 'expired' WHEN {AS_OF} - {at} > INTERVAL 1 DAY THEN 'stale' ELSE 'fresh' END"


def size_label(size: str) -> str:
    def tenths(unit: int) -> str:
        return f"printf('%.1f', floor({size} / {unit} * 10 + 0.5) / 10)"

    return f"CASE WHEN {size} < 1024 THEN {size} || ' B' WHEN {size} < 1048576 THEN {tenths(1024)} || ' KB' ELSE {tenths(1048576)} || ' MB' END"


MINUTES = f"floor((epoch_us({AS_OF}) - epoch_us(fetched_at)) / 60000000 + 0.5)::BIGINT"
AGE = f"""CASE WHEN {MINUTES} < 1 THEN 'just now' WHEN {MINUTES} < 60 THEN {MINUTES} || 'm ago'
  WHEN {MINUTES} < 1440 THEN ({MINUTES} // 60) || 'h ago' ELSE ({MINUTES} // 1440) || 'd ago' END"""

add("record_status", f"WITH {RECORDS} SELECT record_id, fetched_at, {status()} AS status FROM recs")
add("list_records", f"WITH {RECORDS} SELECT record_id, url, fetched_at, {status()} AS status, {AGE} AS age FROM recs WHERE {status()} <> 'expired' ORDER BY fetched_at DESC, record_id")
add(
    "resolve_records",
    f"""WITH {RECORDS} SELECT r.record_id, url, content_type, fetched_at, {status()} AS status, chunk_index, key, title, size_bytes
        FROM crecs r LEFT JOIN chunks c ON r.record_id = c.record_id
        WHERE {status()} <> 'expired' AND r.record_id IN (SELECT record_id FROM requests)""",
)
FIRST = "first AS (SELECT record_id, key, min(chunk_index) AS chunk_index FROM chunks GROUP BY record_id, key)"
add(
    "chunk_lookup",
    f"""WITH {RECORDS}, {FIRST} SELECT q.record_id, q.key, f.chunk_index, c.title, c.content FROM requests q
        JOIN first f ON f.record_id = q.record_id AND f.key = q.key
        JOIN chunks c ON c.record_id = f.record_id AND c.chunk_index = f.chunk_index
        WHERE q.record_id IN (SELECT record_id FROM crecs WHERE {LIVE})""",
)
add("chunk_lookup_written", ORACLES["chunk_lookup"])
add(
    "lookup_misses",
    f"""WITH {RECORDS} SELECT record_id, key, CASE WHEN record_id NOT IN (SELECT record_id FROM crecs WHERE {LIVE}) THEN 'record not found' ELSE 'chunk not found' END AS reason
        FROM requests WHERE record_id NOT IN (SELECT record_id FROM crecs WHERE {LIVE}) OR (record_id, key) NOT IN (SELECT (record_id, key) FROM chunks)""",
)
add("retention_survivors", f"WITH {RECORDS} SELECT record_id, fetched_at FROM recs WHERE {status()} <> 'expired'")
add("surviving_chunks", f"WITH {RECORDS} SELECT record_id, chunk_index, key, size_bytes FROM chunks WHERE record_id IN (SELECT record_id FROM crecs WHERE {LIVE})")
add(
    "retention_counts",
    f"""WITH {RECORDS}, aged AS (SELECT {AS_OF} - (fetched_at + CASE WHEN event_id % 7 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END) > INTERVAL 30 DAY AS old FROM recs)
        SELECT count(*) AS n_records, count(*) FILTER (old) AS n_deleted, count(*) FILTER (NOT old) AS n_kept FROM aged""",
)
add(
    "record_summary",
    f"""WITH {RECORDS} SELECT record_id, sum(size_bytes)::BIGINT AS total_bytes, count(*) AS n_chunks, {size_label("sum(size_bytes)::BIGINT")} AS size,
        arg_min(key, chunk_index) AS first_key, arg_min(content, chunk_index) AS preview FROM chunks GROUP BY record_id""",
)
add(
    "record_index",
    f"""WITH {RECORDS}, live AS (SELECT * FROM crecs WHERE {LIVE}),
        head AS (SELECT record_id, ['URL: ' || url, 'Type: ' || content_type, 'Fetched: ' || strftime(fetched_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z',
          'Status: ' || {status()}, '', 'Chunks:'] AS ls FROM live)
        SELECT record_id, (generate_subscripts(ls, 1) - 1)::BIGINT AS line_no, unnest(ls) AS line FROM head
        UNION ALL SELECT record_id, chunk_index + 6, '  ' || lpad('' || (chunk_index + 1), greatest(2, length('' || (chunk_index + 1)))::INT, ' ') || '. ' || title || '  (' || {size_label("size_bytes")} || ')'
        FROM chunks WHERE record_id IN (SELECT record_id FROM live)""",
)
add(
    "size_labels",
    f"""WITH {RECORDS}, s AS (SELECT record_id, chunk_index, size_bytes FROM chunks UNION ALL SELECT record_id, chunk_index, size_bytes * 5003 FROM chunks)
        SELECT *, {size_label("size_bytes")} AS size FROM s""",
)
add("age_labels", f"WITH {RECORDS} SELECT record_id, {MINUTES} AS minutes, {AGE} AS age FROM recs")
add(
    "duplicate_chunk_keys",
    f"WITH {RECORDS} SELECT record_id, key, count(*) AS n_chunks, min(chunk_index) AS first_index FROM chunks GROUP BY record_id, key HAVING count(*) > 1",
)

# ---- text audit

ISSUES = f"""
issues AS (SELECT doc_id, doc_id % 6 = 1 AS has_bom, CASE WHEN doc_id % 6 = 2 AND contains(text, {NL}) THEN 1::BIGINT END AS crlf_line, doc_id % 6 = 3 AS malformed FROM documents),
counted AS (SELECT *, (has_bom::INT + (crlf_line IS NOT NULL)::INT + malformed::INT)::BIGINT AS n_issues FROM issues)"""
add("encoding_issues", f"WITH {ISSUES} SELECT * FROM counted")
add(
    "encoding_report",
    f"WITH {ISSUES} SELECT count(*) AS n_files, count(*) FILTER (n_issues > 0) AS n_files_with_issues, sum(n_issues)::BIGINT AS n_issues, sum(n_issues) = 0 AS passed FROM counted",
)
PATH = "CASE doc_id % {n} {arms} END".format(
    n=len(D.PATHS),
    arms=" ".join(f"WHEN {i} THEN {lit(t.split('{}')[0])} || source || '_' || doc_id || {lit(t.split('{}')[1])}" for i, t in enumerate(D.PATHS)),
)
add(
    "audit_candidates",
    f"""WITH p AS (SELECT doc_id, {PATH} AS path FROM documents)
        SELECT * FROM p WHERE (regexp_matches(path, '^(src|docs|tools)/') OR regexp_matches(path, '^[^/]+\\.(md|json)$'))
          AND NOT regexp_matches(path, '(^|/)(node_modules|\\.git|dist|data\\.sqlite)(/|$)|\\.(db|sqlite)(/|$)')""",
)
