"""The results of the operators that SQL can express, in DuckDB SQL over the same tables."""

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SUBSTRING_DEDUP = r"""
WITH docs AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS pos FROM docs WHERE len(w) >= 13),
windows AS (SELECT doc_id, pos, array_to_string(w[pos:pos + 12], ' ') AS said FROM starts),
firsts AS (SELECT said, min(doc_id) AS least FROM windows GROUP BY said),
gone AS (
  SELECT DISTINCT doc_id, pos + k AS pos
  FROM windows JOIN firsts USING (said), range(13) AS t(k) WHERE least < doc_id
),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM docs),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS said
  FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(said, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)"""

NEAR_DEDUP = (
    r"""
WITH RECURSIVE docs AS (SELECT doc_id, coalesce(regexp_extract_all(""" + LOWER.format("text") + r""", '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[pos:pos + 2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS pos FROM docs WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id
),
links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)
),
reached AS (
  SELECT doc_id AS a, doc_id AS b FROM docs
  UNION
  SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN sizes USING (doc_id)"""
)

DECONTAMINATION = (
    r"""
WITH docs AS (SELECT doc_id, coalesce(regexp_extract_all(""" + LOWER.format("text") + r""", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(""" + LOWER.format("text") + r""", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
cut AS (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS pos FROM items WHERE len(w) > 0),
held AS (SELECT DISTINCT item_id, n, array_to_string(w[pos:pos + n - 1], ' ') AS said FROM cut),
places AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM docs, (SELECT DISTINCT n FROM held) WHERE len(w) >= n
),
windows AS (SELECT doc_id, n, pos, array_to_string(w[pos:pos + n - 1], ' ') AS said FROM places),
found AS (SELECT doc_id, n, pos, item_id FROM windows JOIN held USING (n, said)),
hits AS (
  SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS word FROM found) GROUP BY doc_id
),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)"""
)

# The checksum of a text of ASCII characters: each is mixed in and shifted out bit by bit.
CRC32 = """xor(4294967295, list_reduce(
  list_prepend(4294967295::BIGINT, flatten([[ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split({}, '')])),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END))"""

# States of the pattern: 1 nothing yet, 2 after s, 3 after u, 4 after a; a state is a pair of cost and audit.
CONVERSATIONS = (
    r"""
WITH RECURSIVE told AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         """ + CRC32.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')") + r""" % 20 AS kind
  FROM conversations
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM told WHERE kind <> 0
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS ending FROM damaged
),
marked AS (
  SELECT *, CASE WHEN ending = '' THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS earlier
  FROM placed
),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE earlier IS NOT NULL AND earlier || c NOT IN ('su', 'ua', 'au')) AS illegal,
         list(struct_pack(c := CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' WHEN c IN ('s', 'u', 'a') THEN c ELSE 'o' END,
                          t := (fault = 'truncated')::BIGINT, role := role, text := text) ORDER BY i) AS rows
  FROM marked GROUP BY conv_id
),
walked AS (
  SELECT conv_id, rows, 0 AS done, [struct_pack(cost := 0::BIGINT, audit := '')] || [struct_pack(cost := 1000000000000::BIGINT, audit := '') for k in range(3)] AS s
  FROM counted
  UNION ALL
  SELECT conv_id, rows, done + 1, CASE WHEN r.c = 'x' THEN [struct_pack(cost := x.cost + 3, audit := x.audit || 'D') for x in w] ELSE [
    struct_pack(cost := w[1].cost + 3, audit := w[1].audit || 'D'),
    least(struct_pack(cost := w[2].cost + 3, audit := w[2].audit || 'D'),
          struct_pack(cost := w[1].cost + r.t + CASE WHEN r.c = 's' THEN 0 ELSE 1000000000000 END, audit := w[1].audit || 'K')),
    least(struct_pack(cost := w[3].cost + 3, audit := w[3].audit || 'D'),
          struct_pack(cost := w[1].cost + r.t + CASE WHEN r.c = 'u' THEN 0 ELSE 2 END, audit := w[1].audit || CASE WHEN r.c = 'u' THEN 'K' ELSE 'R' END),
          struct_pack(cost := w[2].cost + r.t + CASE WHEN r.c = 'u' THEN 0 ELSE 2 END, audit := w[2].audit || CASE WHEN r.c = 'u' THEN 'K' ELSE 'R' END),
          struct_pack(cost := w[4].cost + r.t + CASE WHEN r.c = 'u' THEN 0 ELSE 2 END, audit := w[4].audit || CASE WHEN r.c = 'u' THEN 'K' ELSE 'R' END)),
    least(struct_pack(cost := w[4].cost + 3, audit := w[4].audit || 'D'),
          struct_pack(cost := w[3].cost + r.t + CASE WHEN r.c = 'a' THEN 0 ELSE 2 END, audit := w[3].audit || CASE WHEN r.c = 'a' THEN 'K' ELSE 'R' END))
  ] END
  FROM (
    SELECT conv_id, rows, done, r, [s[1], s[2], u, least(s[4], struct_pack(cost := u.cost + 2, audit := u.audit || 'I'))] AS w
    FROM (SELECT *, rows[done + 1] AS r, least(s[3], struct_pack(cost := s[1].cost + 2, audit := s[1].audit || 'I'),
                 struct_pack(cost := s[2].cost + 2, audit := s[2].audit || 'I'), struct_pack(cost := s[4].cost + 2, audit := s[4].audit || 'I')) AS u
          FROM walked WHERE done < len(rows))
  )
),
ended AS (
  SELECT conv_id, rows, least(s[1], s[4], struct_pack(cost := s[3].cost + 2, audit := s[3].audit || 'I'), struct_pack(cost := s[2].cost + 4, audit := s[2].audit || 'II')) AS best
  FROM walked WHERE done = len(rows)
),
steps AS (SELECT conv_id, rows, unnest(string_split(best.audit, '')) AS edit, generate_subscripts(string_split(best.audit, ''), 1) AS k FROM ended WHERE best.audit <> ''),
reached AS (SELECT *, count(*) FILTER (WHERE edit <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS i FROM steps),
left_over AS (SELECT conv_id, edit, k, rows[i] AS r, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS j FROM reached WHERE edit <> 'D'),
system AS (SELECT conv_id, bool_or(j = 1 AND edit = 'K' AND r.c = 's')::BIGINT AS n FROM left_over GROUP BY conv_id),
said AS (
  SELECT l.conv_id, string_agg(
    CASE WHEN edit = 'K' THEN r.role WHEN (j - n) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE r.text END, chr(10) ORDER BY k) AS lines
  FROM left_over l JOIN system s ON l.conv_id IS NOT DISTINCT FROM s.conv_id GROUP BY l.conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ended e ON o.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN said d ON o.conv_id IS NOT DISTINCT FROM d.conv_id"""
)

MIXING = r"""
WITH RECURSIVE docs AS (SELECT doc_id, source, len(coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []))::BIGINT AS size FROM documents),
named AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighed AS (
  SELECT source, source_size, 2 * source_size AS most, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, sum(source_size) OVER () AS everything FROM named
),
-- Sources fill up in the order of their room by weight; the level with k full ones is right if the next one has room for it.
filling AS (
  SELECT *, sum(most) OVER w - most AS held, sum(weight) OVER () - (sum(weight) OVER w - weight) AS free, most / weight AS room
  FROM weighed WINDOW w AS (ORDER BY most / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)
),
level AS (SELECT (1.5::DOUBLE * everything::DOUBLE - held::DOUBLE) / free::DOUBLE AS level FROM filling WHERE most::DOUBLE > (1.5::DOUBLE * everything::DOUBLE - held::DOUBLE) / free::DOUBLE * weight ORDER BY room, source NULLS LAST LIMIT 1),
targets AS (SELECT source, source_size, least(most::DOUBLE, coalesce((SELECT level FROM level), 0::DOUBLE) * weight) AS target FROM weighed),
placed AS (
  SELECT d.*, t.source_size, t.target, d.size > 0 AND t.target > 0 AND d.size >= greatest(t.target / 100, t.source_size / 1000000) AS heavy
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
),
heavy AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size DESC, doc_id NULLS FIRST) AS j FROM placed WHERE heavy),
walked AS (
  SELECT source, 0::BIGINT AS j, NULL::BIGINT AS doc_id, 0::HUGEINT AS copies, target AS rest, source_size AS words, ('0x' || left(md5(coalesce('mix=' || source, 'mix')), 8))::HUGEINT AS upto FROM targets
  UNION ALL
  SELECT source, j, doc_id, (upto + units) // 4294967296, rest - ((upto + units) // 4294967296)::DOUBLE * size, words - size, (upto + units) % 4294967296
  FROM (
    SELECT h.source, h.j, h.doc_id, h.size, rest, words, upto, floor(least(greatest(rest / words::DOUBLE, 0), 2) * 4294967296)::HUGEINT AS units
    FROM walked w JOIN heavy h ON w.source IS NOT DISTINCT FROM h.source AND h.j = w.j + 1
  )
),
rests AS (SELECT source, arg_max(rest, j) AS rest, arg_max(words, j) AS words, arg_max(upto, j) AS upto FROM walked GROUP BY source),
expected AS (
  SELECT p.*, r.upto AS start, CASE WHEN words > 0 THEN floor(least(greatest(rest / words::DOUBLE, 0), 2) * 4294967296)::HUGEINT ELSE 0 END AS units
  FROM placed p JOIN rests r ON p.source IS NOT DISTINCT FROM r.source WHERE NOT heavy
),
summed AS (SELECT *, sum(units) OVER (PARTITION BY source ORDER BY size DESC, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) + start AS upto FROM expected),
counted AS (
  SELECT doc_id, size, source_size, target, source, (upto // 4294967296 - (upto - units) // 4294967296)::BIGINT AS copies FROM summed
  UNION ALL
  SELECT h.doc_id, size, source_size, target, h.source, copies::BIGINT FROM heavy h JOIN walked w ON h.source IS NOT DISTINCT FROM w.source AND h.j = w.j
)
SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies FROM counted"""

MERKLE = (
    r"""
WITH RECURSIVE fields AS (
  SELECT doc_id, lang, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS front, text,
         CASE WHEN """ + CRC32.format("doc_id::VARCHAR") + r""" % 3 = 0 THEN """ + LOWER.format("text") + r""" ELSE text END AS now
  FROM documents
),
digests AS (
  SELECT doc_id, lang, sha256(front || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(front || coalesce(strlen(now) || ':' || now, '-')) AS changed FROM fields
),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS spot FROM digests),
-- The levels of each language's tree, and then of the tree of their roots, as lists.
grown AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY spot) AS nodes FROM leaves GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, [sha256(array_to_string(nodes[8 * i + 1:8 * i + 8], '')) for i in range((len(nodes) + 7) // 8)] FROM grown WHERE len(nodes) > 1
),
subroots AS (SELECT lang, nodes[1] AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM grown WHERE len(nodes) = 1),
above AS (
  SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM subroots
  UNION ALL
  SELECT level + 1, [sha256(array_to_string(nodes[8 * i + 1:8 * i + 8], '')) for i in range((len(nodes) + 7) // 8)] FROM above WHERE len(nodes) > 1
),
levels AS (
  SELECT s.lang, g.level, g.nodes, NULL::BIGINT AS place, height FROM grown g JOIN subroots s ON g.lang IS NOT DISTINCT FROM s.lang WHERE len(g.nodes) > 1
  UNION ALL
  SELECT s.lang, s.height + a.level, a.nodes, s.place // (8 ** a.level)::BIGINT, height FROM subroots s, above a WHERE len(a.nodes) > 1
),
climbed AS (
  SELECT doc_id, lang, spot, leaf, 0 AS level, changed AS digest, '' AS proof FROM leaves
  UNION ALL
  SELECT doc_id, lang, spot, leaf, level + 1, sha256(array_to_string([CASE WHEN i = own THEN digest ELSE run[i + 1] END for i in range(len(run))], '')),
         proof || array_to_string([run[i + 1] for i in range(len(run)) if i <> own], '')
  FROM (
    SELECT c.*, coalesce(l.place, spot // (8 ** c.level)::BIGINT)::BIGINT % 8 AS own,
           l.nodes[coalesce(l.place, spot // (8 ** c.level)::BIGINT)::BIGINT // 8 * 8 + 1:coalesce(l.place, spot // (8 ** c.level)::BIGINT)::BIGINT // 8 * 8 + 8] AS run
    FROM climbed c JOIN levels l ON c.lang IS NOT DISTINCT FROM l.lang AND c.level = l.level
  )
),
tops AS (SELECT *, row_number() OVER (PARTITION BY lang, spot ORDER BY level DESC) AS latest FROM climbed)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, digest AS folded_root, digest = root AS verified
FROM tops t JOIN subroots s ON t.lang IS NOT DISTINCT FROM s.lang, (SELECT nodes[1] AS root FROM above WHERE len(nodes) = 1)
WHERE latest = 1"""
)
