"""The same results in DuckDB SQL, over the same tables."""

from __future__ import annotations

FILE_PAGES = r"""
file_pages AS (
  SELECT 'gs://lake/raw/cases_pdf/batch.' || (conv_id // 10) || '.pdf' AS file_path,
         row_number() OVER (PARTITION BY conv_id // 10 ORDER BY conv_id, turn) AS page,
         CASE WHEN role = 'system' OR contains(text, chr(10)) THEN text
              ELSE text || chr(10) || 'Num. ' || conv_id || ' - Pág. ' || (turn + 1) END AS page_text,
         role, text
  FROM conversations
)"""

STAMPS = FILE_PAGES + r""",
stamps AS (
  SELECT file_path, page,
         regexp_extract(page_text, 'Num\. ([1-9][0-9]*) - Pág\. ([1-9][0-9]*)', 1) AS doc_id,
         regexp_extract(page_text, 'Num\. ([1-9][0-9]*) - Pág\. ([1-9][0-9]*)', 2) AS piece_page
  FROM file_pages
  WHERE regexp_matches(page_text, 'Num\. ([1-9][0-9]*) - Pág\. ([1-9][0-9]*)')
)"""

INDEX = STAMPS + r""",
page_index AS (
  SELECT file_path, doc_id, min(page) AS min_page, max(page) AS max_page
  FROM stamps GROUP BY file_path, doc_id
)"""

FIRST = INDEX + r""",
first_documents AS (
  SELECT file_path, doc_id, min_page, max_page FROM (
    SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY min_page, doc_id) AS rk FROM page_index
  ) WHERE rk <= 4
)"""

SLICE = INDEX + r""",
sliced AS (
  SELECT p.file_path, p.page, p.page_text, i.doc_id, i.min_page, i.max_page
  FROM file_pages p JOIN page_index i
    ON p.file_path = i.file_path AND p.page BETWEEN i.min_page AND i.max_page
)"""

MARKDOWN = SLICE + r""",
measured AS (
  SELECT *, 'batch.' || regexp_extract(file_path, 'batch\.([0-9]+)\.pdf$', 1) AS stem,
         coalesce(sum(octet_length(encode(page_text)) + 2) OVER (
           PARTITION BY file_path, doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 67108864 AS piece
  FROM sliced
),
parts AS (
  SELECT *, dense_rank() OVER (PARTITION BY file_path, doc_id ORDER BY piece) - 1 AS part FROM measured
),
markdown AS (
  SELECT file_path, stem, doc_id, part, max(part) OVER (PARTITION BY file_path, doc_id) + 1 AS n_parts, n_pages,
         'raw/cases_md/' || stem || '/' || doc_id || CASE WHEN part = 0 THEN '' ELSE '.part' || part END || '.md' AS object_path, markdown
  FROM (
    SELECT file_path, stem, doc_id, part, count(*) AS n_pages, string_agg(page_text, chr(10) || chr(10) ORDER BY page) AS markdown
    FROM parts GROUP BY file_path, stem, doc_id, part
  )
)"""

CONVERSATION_ITEMS = r"""
items AS (
  SELECT conv_id AS doc_id, turn AS row_idx,
         CASE WHEN role = 'user' THEN 'section_header' ELSE 'text' END AS label, text
  FROM conversations
)"""


def headers(keys: str, items: str = "items") -> str:
    return f"""
headers AS (
  SELECT {keys}, row_idx AS index_y, text AS text_y,
         lead(row_idx) OVER (PARTITION BY {keys} ORDER BY row_idx) AS previous_section_index
  FROM {items} WHERE label = 'section_header'
)"""


def attached(keys: str, items: str = "items", keep_last: bool = False) -> str:
    using = ", ".join(k.strip() for k in keys.split(","))
    upper = "x.row_idx < h.previous_section_index"
    if keep_last:
        upper = f"({upper} OR h.previous_section_index IS NULL)"
    return f"""
attached AS (
  SELECT {using}, x.row_idx AS index_x, x.text AS text, h.text_y AS section, h.index_y, h.previous_section_index
  FROM {items} x JOIN headers h USING ({using})
  WHERE x.row_idx > h.index_y AND {upper}
)"""


CASE_SECTIONS = (
    INDEX
    + r""",
lines AS (
  SELECT file_path, page, role, unnest(string_split(text, chr(10))) AS text,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM file_pages
),
items AS (
  SELECT l.file_path, d.doc_id,
         row_number() OVER (PARTITION BY l.file_path, d.doc_id ORDER BY l.page, l.pos) - 1 AS row_idx,
         CASE WHEN l.role = 'user' AND l.pos = 1 THEN 'section_header' ELSE 'text' END AS label, l.text
  FROM lines l JOIN page_index d
    ON l.file_path = d.file_path AND l.page BETWEEN d.min_page AND d.max_page
  WHERE l.text <> ''
),"""
    + headers("file_path, doc_id")
    + ","
    + attached("file_path, doc_id")
)

HTML_ITEMS = r"""
cleaned AS (
  SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/]*)', 1) AS doc_id,
         chr(2) || regexp_replace(
           translate(
             regexp_replace(html, '(?is)<!--.*?-->|<!doctype[^>]*>|<head\b.*?</head\s*>|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'),
             chr(1) || chr(2), '  '),
           '(?i)<(/?(?:h[1-6]|p|li|body|div|article|section|header|footer|main|nav|aside|ul|ol|table|tr|td|th|blockquote|pre))\b[^>]*>',
           chr(1) || '\1' || chr(2), 'g') AS marked
  FROM pages
),
pieces AS (
  SELECT doc_id, page_id, unnest(string_split(marked, chr(1))) AS piece,
         generate_subscripts(string_split(marked, chr(1)), 1) AS pos
  FROM cleaned
),
blocks AS (
  SELECT doc_id, page_id, pos, lower(split_part(piece, chr(2), 1)) AS tag,
         trim(regexp_replace(
           replace(replace(replace(replace(replace(replace(
             regexp_replace(split_part(piece, chr(2), 2), '(?i)</?[a-z][^>]*>', ' ', 'g'),
             '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'),
           '[ \t\r\n]+', ' ', 'g')) AS text
  FROM pieces
),
items AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_id, pos) - 1 AS row_idx,
         CASE WHEN regexp_matches(tag, '^h[1-6]$') THEN 'section_header' WHEN tag = 'li' THEN 'list_item' ELSE 'text' END AS label,
         text
  FROM blocks WHERE text <> ''
)"""

TEXT_PAGES = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents
)
SELECT doc_id, (pos // 10 + 1)::BIGINT AS page, string_agg(line, chr(10) ORDER BY pos) AS page_text
FROM lines GROUP BY doc_id, pos // 10"""

PRODUCTS = r"""
products AS (
  SELECT p_partkey AS id, p_name AS name, p_name || ' ' || p_type AS description, p_brand AS category,
         p_retailprice AS price, 'product photo ' || p_name AS image_desc,
         'gs://lake/images/' || p_partkey || '.jpg' AS image_uri
  FROM part
)"""


def hashed(name: str, source: str, key: str, text: str, width: int, seed: str = "") -> str:
    """CTEs `{name}` with `(key, pos, x)`, one row per place of the vector that is not 0."""
    return f"""
{name}_digests AS (
  SELECT {key}, md5('{seed}' || word) AS digest
  FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) AS word FROM {source})
),
{name}_counts AS (
  SELECT {key}, ('0x' || substr(digest, 1, 8))::BIGINT % {width} AS pos,
         sum(CASE WHEN substr(digest, 9, 1) < '8' THEN 1 ELSE -1 END)::DOUBLE AS c
  FROM {name}_digests GROUP BY ALL HAVING c <> 0
),
{name}_lengths AS (SELECT {key}, sqrt(sum(c * c)) AS length FROM {name}_counts GROUP BY ALL),
{name} AS (
  SELECT {key}, pos, (c / length)::FLOAT AS x FROM {name}_counts JOIN {name}_lengths USING ({key})
  UNION ALL
  SELECT {key}, 0, 1::FLOAT FROM {source} ANTI JOIN {name}_lengths USING ({key})
)"""


def checksum(name: str, key: str) -> str:
    return f"(SELECT {key}, round(sum(x::DOUBLE * (pos + 1)), 3) AS s FROM {name} GROUP BY ALL)"


KNN = r"""
WITH places AS (
  SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings
),
means AS (SELECT label, pos, avg(x) AS x FROM places GROUP BY label, pos),
queries AS (SELECT label AS qid, list(x ORDER BY pos) AS vector FROM means GROUP BY label),
distances AS (
  SELECT q.qid, e.vec_id, round(1 - list_cosine_similarity(e.embedding::DOUBLE[], q.vector), 9) AS d
  FROM embeddings e, queries q
)
SELECT qid, vec_id, round(d, 6) AS distance, rank::INTEGER AS rank FROM (
  SELECT qid, vec_id, d, row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) AS rank FROM distances
) WHERE rank <= 10"""

KNN_MANY = r"""
WITH distances AS (
  SELECT q.vec_id AS qid, e.vec_id, round(1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS d
  FROM embeddings e JOIN embeddings q ON e.vec_id <> q.vec_id
)
SELECT qid, vec_id, round(d, 6) AS distance, rank::INTEGER AS rank FROM (
  SELECT qid, vec_id, d, row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) AS rank FROM distances
) WHERE rank <= 10"""

POSTINGS = r"""
postings AS (
  SELECT doc_id, term, count(*) AS tf
  FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents)
  GROUP BY doc_id, term
)"""

BM25 = (
    "WITH"
    + POSTINGS
    + r""",
lengths AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS length FROM documents),
corpus AS (SELECT count(*) AS n, avg(length) AS avg_length FROM lengths),
terms AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
searches AS (
  SELECT DISTINCT qid, unnest(regexp_extract_all(lower(query), '[\p{L}\p{N}]+')) AS term
  FROM (VALUES (0, 'worthless double ring'), (1, 'La que, des leur'), (2, 'the DER und')) AS v(qid, query)
),
scored AS (
  SELECT s.qid, p.doc_id,
         sum(ln(1 + (c.n - t.df + 0.5) / (t.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * l.length / c.avg_length))) AS score
  FROM searches s JOIN terms t USING (term) JOIN postings p USING (term) JOIN lengths l USING (doc_id), corpus c
  GROUP BY s.qid, p.doc_id
)
SELECT qid::BIGINT AS qid, doc_id, round(score, 6) AS score, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored
) WHERE rank <= 10"""
)

MESSAGES = (
    "WITH"
    + INDEX
    + r"""
SELECT file_path || '/' || doc_id AS key,
       '{"doc_id":"' || doc_id || '","min_page":' || min_page || ',"max_page":' || max_page
       || ',"bucket":"lake","file_path":"' || substr(file_path, 11) || '"}' AS value
FROM page_index"""
)

ORACLE: dict[str, str] = {
    "page_stamps": "WITH" + STAMPS + " SELECT * FROM stamps",
    "page_index": "WITH" + INDEX + " SELECT * FROM page_index",
    "first_documents": "WITH" + FIRST + " SELECT * FROM first_documents",
    "page_range_slice": "WITH" + SLICE + " SELECT * FROM sliced",
    "document_markdown": "WITH" + MARKDOWN + " SELECT * FROM markdown",
    "doc_messages": MESSAGES,
    "unconverted_documents": "WITH" + INDEX + " SELECT * FROM page_index WHERE min_page <> max_page",
    "case_sections": "WITH" + CASE_SECTIONS + " SELECT * FROM attached",
    "case_sections_embedded": "WITH"
    + CASE_SECTIONS
    + ","
    + hashed("vectors", "attached", "file_path, doc_id, index_x", "text", 384)
    + f" SELECT attached.*, 384 AS text_width, s AS text_checksum FROM attached JOIN {checksum('vectors', 'file_path, doc_id, index_x')} USING (file_path, doc_id, index_x)",
    "section_headers": "WITH" + CONVERSATION_ITEMS + "," + headers("doc_id") + " SELECT * FROM headers",
    "section_attach": "WITH" + CONVERSATION_ITEMS + "," + headers("doc_id") + "," + attached("doc_id") + " SELECT * FROM attached",
    "section_attach_window": "WITH" + CONVERSATION_ITEMS + "," + headers("doc_id") + "," + attached("doc_id") + " SELECT * FROM attached",
    "section_attach_keep_last": "WITH"
    + CONVERSATION_ITEMS
    + ","
    + headers("doc_id")
    + ","
    + attached("doc_id", keep_last=True)
    + " SELECT a.* FROM attached a JOIN items i ON a.doc_id = i.doc_id AND a.index_x = i.row_idx WHERE i.label <> 'section_header'",
    "html_text_items": "WITH" + HTML_ITEMS + " SELECT doc_id, row_idx, '#/texts/' || row_idx AS self_ref, label, text FROM items",
    "html_sections": "WITH" + HTML_ITEMS + "," + headers("doc_id") + "," + attached("doc_id") + " SELECT * FROM attached",
    "pages_from_text": TEXT_PAGES,
    "uri_parts": r"""
WITH parts AS (
  SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/]*)/?(.*)$', 1) AS bucket,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/]*)/?(.*)$', 2) AS object_path
  FROM pages
),
named AS (SELECT *, regexp_extract(rtrim(object_path, '/'), '[^/]*$') AS last_segment FROM parts)
SELECT *, CASE WHEN regexp_matches(last_segment, '^.+\.[^.]+$') THEN regexp_extract(last_segment, '^(.+)\.[^.]+$', 1)
          ELSE last_segment END AS stem
FROM named""",
    "distinct_prefixes": r"""
SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/]*)/', 1) AS bucket, regexp_extract(url, '^[a-z]+://[^/]*/([^/]*/)', 1) AS prefix
FROM pages WHERE regexp_matches(url, '^[a-z]+://[^/]*/[^/]*/')""",
    "catalog_enrich": "WITH" + PRODUCTS + " SELECT * EXCLUDE (image_desc) FROM products",
    "catalog_roundtrip": "WITH"
    + PRODUCTS
    + " SELECT category, count(*) AS n, min(price) AS min_price, max(image_uri) AS max_uri FROM products GROUP BY category",
    "product_catalog": "WITH"
    + PRODUCTS
    + ","
    + hashed("texts", "products", "id", "description", 384)
    + ","
    + hashed("images", "products", "id", "image_desc", 512, "image")
    + f"""
SELECT p.id, name, description, category, price, image_uri, 384 AS text_width, t.s AS text_checksum,
       512 AS image_width, i.s AS image_checksum
FROM products p JOIN {checksum('texts', 'id')} t ON p.id = t.id JOIN {checksum('images', 'id')} i ON p.id = i.id""",
    "envelope_decode": r"""
WITH envelopes AS (
  SELECT '{"message":{"data":"' || base64(encode('{"event_id":' || event_id || ',"event_type":"' || event_type || '"}')) || '"}}' AS envelope
  FROM events
),
decoded AS (SELECT decode(from_base64(json_extract_string(envelope, '$.message.data'))) AS payload FROM envelopes)
SELECT json_extract_string(payload, '$.event_id')::BIGINT AS event_id,
       json_extract_string(payload, '$.event_type') AS event_type, NULL::VARCHAR AS reason
FROM decoded""",
    "dead_letter_split": r"""
SELECT user_id, count(*) AS attempts, CASE WHEN count(*) >= 5 THEN 'dead_letter' ELSE 'retry' END AS destination
FROM events WHERE event_type = 'error' GROUP BY user_id""",
    "text_embeddings": "WITH"
    + hashed("vectors", "documents", "doc_id", "text", 384)
    + " SELECT doc_id, 384 AS width, pos::INTEGER AS pos, round(x::DOUBLE, 6) AS weight FROM vectors",
    "image_desc_embeddings": "WITH"
    + PRODUCTS
    + ","
    + hashed("vectors", "products", "id", "image_desc", 512, "image")
    + " SELECT id, 512 AS width, pos::INTEGER AS pos, round(x::DOUBLE, 6) AS weight FROM vectors",
    "vector_norms": r"""
WITH places AS (
  SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings
)
SELECT vec_id, round(sqrt(sum(x * x)), 6) AS norm, round(sum(x * pos) / sqrt(sum(x * x)), 3) AS unit_checksum
FROM places GROUP BY vec_id""",
    "vector_width_check": "SELECT vec_id, len(embedding)::INTEGER AS width, len(embedding) = 64 AS fits FROM embeddings",
    "knn_cosine": KNN,
    "knn_many": KNN_MANY,
    "ivf_assign": "SELECT vec_id, true AS nearest FROM embeddings",
    "ann_search": "SELECT DISTINCT label AS qid, 10::BIGINT AS hits, true AS exact, true AS recalled FROM embeddings",
    "ann_search_leaves": "SELECT doc_id AS qid, 10::BIGINT AS hits, true AS exact, true AS recalled, true AS pruned FROM documents WHERE doc_id % 50 = 0",
    "markdown_objects": "WITH" + MARKDOWN + " SELECT object_path, md5(markdown) AS md5 FROM markdown",
    "object_inventory": r"""
WITH objects AS (
  SELECT 'texts/' || source || '-' || (doc_id // 100) || '.txt' AS name, string_agg(coalesce(text, ''), chr(12) ORDER BY doc_id) AS body
  FROM documents GROUP BY source, doc_id // 100
)
SELECT name, octet_length(encode(body))::BIGINT AS size, md5(body) AS md5 FROM objects""",
    "ann_search_full_probe": KNN,
    "fts_postings": "WITH" + POSTINGS + " SELECT * FROM postings",
    "fts_terms": "WITH" + POSTINGS + " SELECT term, count(*) AS df, sum(tf)::BIGINT AS total FROM postings GROUP BY term",
    "fts_lengths": r"SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS length FROM documents",
    "bm25_scan": BM25,
    "bm25_search": BM25,
    "bm25_blocks": BM25,
    "fts_block_postings": "WITH" + POSTINGS + " SELECT * FROM postings",
    "stream_file_arrivals": "WITH" + FILE_PAGES + " SELECT DISTINCT file_path FROM file_pages",
    "stream_page_index": MESSAGES,
    "stream_page_ranges": "WITH" + INDEX + " SELECT * FROM page_index",
    "stream_redelivery": MESSAGES,
    "custom_embeddings": r"""
WITH counts AS (
  SELECT doc_id, [(len(t) - len(replace(t, x, '')))::DOUBLE FOR x IN ['a', 'e', 'i', 'o', 'u']] AS c
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
),
normed AS (SELECT doc_id, c, sqrt(list_sum([x * x FOR x IN c])) AS n FROM counts)
SELECT doc_id, """ + ", ".join(f"CASE WHEN n > 0 THEN round((c[{i + 1}] / n)::FLOAT::DOUBLE, 5) END AS v{i}" for i in range(5)) + " FROM normed",
    "stream_convert": "WITH" + MARKDOWN + " SELECT * FROM markdown",
}
