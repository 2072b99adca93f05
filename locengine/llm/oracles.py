"""DuckDB SQL for the queries that SQL can express, written from their contracts."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TEXT = _LOWER.format("coalesce(text, '')")

OP2 = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_TEXT}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({_TEXT}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
  WHERE item_id IS NOT NULL
), size AS (
  SELECT *, least(13, len(w)) AS n FROM b WHERE len(w) > 0
), place AS (
  SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM size
), win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM place
), dp AS (
  SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i
  FROM d, (SELECT DISTINCT n FROM win)
), hit AS (
  SELECT dp.doc_id, dp.i, dp.n, win.item_id
  FROM dp JOIN win ON win.n = dp.n AND win.t = array_to_string(dp.w[dp.i:dp.i + dp.n - 1], ' ')
), word AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), item AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)
"""

OP6 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_TEXT}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d) WHERE len(w) > 2
  UNION ALL
  SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) IN (1, 2)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * k >= 90 * (x.n + y.n - k)
), reach AS (
  SELECT a AS doc_id, b AS other FROM link
  UNION
  SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.other
)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles,
  least(d.doc_id, min(reach.other)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reach USING (doc_id) GROUP BY d.doc_id
"""

OP7 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), q AS (
  SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p
), r AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM q
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM r
"""

OP9 = r"""
WITH d AS (
  SELECT doc_id, source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens,
    md5(concat_ws('|', '0', source, doc_id)) AS k
  FROM documents
), f AS (
  SELECT *, CAST('0x' || substr(k, 1, 4) AS INTEGER) AS fine FROM d
), s AS (
  SELECT source, sum(n_tokens) AS t FROM f GROUP BY source
), range_ AS (
  SELECT max(t) AS most, min(t) AS least, sum(t) AS total FROM s WHERE t > 0
), e AS (
  -- (most / least) ** (1 - a) = 2 has this solution; none is needed below 2
  SELECT *, CASE WHEN most <= 2 * least THEN 0 ELSE 1 - ln(2) / ln(most / least) END AS a FROM range_
), z AS (
  SELECT sum(pow(t / total, a)) AS norm, max(t / pow(t / total, a)) AS unit
  FROM s, e WHERE t > 0
), w AS (
  SELECT source, CAST(t AS BIGINT) AS t, pow(t / total, a) / norm AS weight,
    CAST(floor(pow(t / total, a) * unit + 0.5) AS BIGINT) AS quota,
    greatest(0, 16 - CAST(ceil(log2(greatest(ceil(t / 100000), 1))) AS INTEGER)) AS shift
  FROM s, e, z WHERE t > 0
), b AS (
  SELECT f.source, fine >> shift AS block, w.weight, w.shift, w.quota // w.t AS epochs,
    w.quota % w.t AS rest, CAST(sum(n_tokens) AS BIGINT) AS tokens
  FROM f JOIN w USING (source) GROUP BY ALL
), turn AS (
  SELECT *, unnest(range(0, CASE WHEN rest > 0 THEN epochs + 1 ELSE epochs END)) AS epoch FROM b
), placed AS (
  SELECT *, md5(concat_ws('|', '0', source, block, epoch)) AS draw FROM turn
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY source, epoch ORDER BY draw, block) AS position,
    sum(tokens) OVER (PARTITION BY source, epoch ORDER BY draw, block ROWS UNBOUNDED PRECEDING) AS cum
  FROM placed
), use_ AS (
  SELECT *, CASE WHEN epoch = epochs AND cum > rest THEN rest - (cum - tokens) END AS room
  FROM ordered WHERE epoch < epochs OR cum - tokens < rest
), all_ AS (
  SELECT f.doc_id, f.source, f.n_tokens, u.weight, u.epoch, u.block, u.position, u.room,
    sum(f.n_tokens) OVER (PARTITION BY f.source, u.epoch, u.block ORDER BY f.k, f.n_tokens
      ROWS UNBOUNDED PRECEDING) AS so_far
  FROM f JOIN use_ u ON u.source = f.source AND u.block = fine >> u.shift
)
SELECT doc_id, source, n_tokens, round(weight, 9) AS weight, epoch, CAST(block AS INTEGER) AS block,
  CAST(position AS INTEGER) AS position
FROM all_ WHERE room IS NULL OR so_far <= room
"""

OP10 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS t
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 33, 1))) AS i FROM d) WHERE len(w) > 34
), again AS (
  SELECT doc_id, i FROM win WHERE t IN (SELECT t FROM win GROUP BY t HAVING count(*) > 1)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM again
), word AS (
  SELECT doc_id, unnest(w) AS v, generate_subscripts(w, 1) AS i FROM d
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(v, ' ' ORDER BY i) AS t
  FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP12 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(replace(text, '\', '\\'),
      '<s>|</s>|<<SYS>>|<</SYS>>|\[/?INST\]|\[/?ROLE\]|\[TEXT\]', '\0 ', 'g') AS esc,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM t
), f AS (
  SELECT *, CASE role
      WHEN 'user' THEN length('<s>[INST]  [/INST]')
      WHEN 'assistant' THEN length('  </s>')
      WHEN 'system' THEN length('<<SYS>><</SYS>>') + 4
      ELSE length('[ROLE][TEXT][/ROLE]') + length(role) END + length(esc) AS chars,
    CASE WHEN CASE role
        WHEN 'system' THEN i > 0
        WHEN 'user' THEN NOT (i = 0 OR prev IN ('system', 'assistant'))
        WHEN 'assistant' THEN i = 0 OR prev <> 'user'
        ELSE true END THEN i
      WHEN i = n - 1 AND role <> 'assistant' THEN n END AS wrong
  FROM e
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  min(wrong) IS NULL AS valid, CAST(min(wrong) AS BIGINT) AS wrong_turn
FROM f GROUP BY conv_id
"""

OP13 = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_TEXT}, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), total AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM (
    SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
    FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k
  ) GROUP BY ALL
), c AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10
), cut AS (
  SELECT lang, k, phrase, a, w, unnest(range(1, k)) AS j FROM c
), scored AS (
  SELECT cut.*, x.f AS l, y.f AS r,
    CAST((CAST(a AS HUGEINT) * a * 1000000) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(cut.w[:j], ' ')
    JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(cut.w[j + 1:], ' ')
), weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), longer AS (
  SELECT lang, phrase, max(a) AS most FROM (
    SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase
    FROM c WHERE k = 3
  ) GROUP BY ALL
), ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM weakest s LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

ORACLES = {
    "op2_decontamination": OP2,
    "op6_jaccard_join": OP6,
    "op7_warc": OP7,
    "op9_mixing": OP9,
    "op10_substring_dedup": OP10,
    "op12_chat_format": OP12,
    "op13_collocations": OP13,
}
