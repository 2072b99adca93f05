"""SQL for the comparison engine: the registered queries, written as relational SQL.

The operators work inside document rows; this SQL works on exploded lines with window
functions, recursion and list functions, so the two agree only if both are right.
"""

from __future__ import annotations

from locengine.functions.text import WHITESPACE, WS
from locengine.operators import batch
from locengine.plans import fixtures as fx

ORACLES: dict[str, str] = {}


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


STRIP = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||" + "||".join(
    f"chr({ord(c)})" for c in WHITESPACE if c not in "\t\n\x0b\x0c\r"
)
ACC = "[À-ÖØ-öø-ÿ]"
SKIP = (
    r"^https?://|^[a-zA-Z0-9._%+-]+@|^=[\p{L}\p{N}_]+\("
    rf"|^[\p{{Nd}}{WS}.,:%/+\-×÷()]+$"
)
BOX = "[┌┐└┘│├┤─┬┴┼╔╗╚╝║╠╣═╦╩╬+|]"
NL = "chr(10)"


def strip(x: str) -> str:
    return f"trim({x}, {STRIP})"


def fold(x: str) -> str:
    return f"translate({x}, {lit(fx.ACCENTED)}, {lit(fx.FOLDED)})"


def translatable(x: str) -> str:
    return f"(regexp_matches({x}, {lit(ACC)}) AND NOT regexp_matches({x}, {lit(SKIP)}))"


# Named parts; a query takes those it needs, in this order.
PARTS: dict[str, str] = {}

PARTS["lines"] = f"""
SELECT doc_id, generate_subscripts(string_split(text, {NL}), 1) - 1 AS line_idx,
       unnest(string_split(text, {NL})) AS raw FROM documents"""
PARTS["md_lines"] = """
SELECT doc_id, CAST(line_idx + (line_idx + 9) // 12 + (line_idx + 6) // 12 - 1 AS int) AS line_idx,
  '```' AS raw FROM lines WHERE line_idx % 12 IN (3, 6)
UNION ALL
SELECT doc_id, CAST(line_idx + (line_idx + 9) // 12 + (line_idx + 6) // 12 AS int) AS line_idx, CASE
  WHEN line_idx % 12 = 5 AND doc_id % 2 = 0 THEN concat('│ ', raw, ' │')
  WHEN line_idx % 12 = 8 THEN concat('| ', substr(raw, 1, 12), ' | ', substr(raw, 13), ' |')
  WHEN line_idx % 12 = 9 THEN concat('# ', raw)
  ELSE raw END AS raw FROM lines"""
PARTS["file_types"] = """
SELECT doc_id, lang, CASE WHEN doc_id % 9 = 8 THEN 'pdf' WHEN doc_id % 9 % 3 = 0 THEN 'txt'
  WHEN doc_id % 9 % 3 = 1 THEN 'md' ELSE 'csv' END AS file_type FROM documents"""
PARTS["fences"] = f"""
SELECT *, {strip('raw')} AS s, starts_with({strip('raw')}, '```') AS is_fence FROM md_lines"""
PARTS["marked"] = f"""
SELECT *, inside AND bool_or(regexp_matches(raw, {lit(BOX)})) OVER (PARTITION BY doc_id, block)
  AS is_diagram
FROM (SELECT *, block % 2 = 1 AND block < total AS inside FROM (
  SELECT *, sum(is_fence::int) OVER (PARTITION BY doc_id ORDER BY line_idx) AS block,
         sum(is_fence::int) OVER (PARTITION BY doc_id) AS total FROM fences)
  WHERE NOT is_fence)"""
PARTS["items"] = f"""
SELECT doc_id, line_idx, 0 AS item, 'body' AS type, CAST(NULL AS int) AS cell_index, s AS text
FROM marked WHERE NOT inside AND {translatable('s')} AND NOT (s LIKE '|%' AND s LIKE '%|')
UNION ALL
SELECT doc_id, line_idx, cell_index, 'table_cell', cell_index, text FROM (
  SELECT doc_id, line_idx,
    CAST(generate_subscripts(string_split(substr(s, 2, length(s) - 2), '|'), 1) - 1 AS int) AS cell_index,
    {strip("unnest(string_split(substr(s, 2, length(s) - 2), '|'))")} AS text
  FROM marked WHERE NOT inside AND {translatable('s')} AND s LIKE '|%' AND s LIKE '%|')
WHERE {translatable('text')}
UNION ALL
SELECT doc_id, line_idx, item, 'diagram_token', NULL, text FROM (
  SELECT doc_id, line_idx, generate_subscripts(tokens, 1) AS item, unnest(tokens) AS text
  FROM (SELECT doc_id, line_idx,
    regexp_extract_all(raw, {lit(f'{ACC}+(?:[{WS}]*{ACC}+)*')}) AS tokens
    FROM marked WHERE is_diagram))"""
PARTS["segs"] = """
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_idx, item) - 1 AS seq,
  concat('line[', line_idx, ']') AS location, line_idx, type, cell_index, text FROM items"""


def replies_of(source: str) -> dict[str, str]:
    """Greedy batches of ``source`` (doc_id, seq, text), replies of the stand-in model and
    the outcome per segment."""
    return {
        "ranked": f"""
SELECT doc_id, seq, text, length(text) AS len,
  row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS rn FROM {source}""",
        "packing": """
SELECT doc_id, rn, seq, text, CAST(0 AS bigint) AS batch_id, CAST(len AS bigint) AS chars,
  1 AS segs, len FROM ranked WHERE rn = 1
UNION ALL
SELECT r.doc_id, r.rn, r.seq, r.text,
  CASE WHEN p.chars + r.len > 600 OR p.segs >= 5 THEN p.batch_id + 1 ELSE p.batch_id END,
  CASE WHEN p.chars + r.len > 600 OR p.segs >= 5 THEN r.len ELSE p.chars + r.len END,
  CASE WHEN p.chars + r.len > 600 OR p.segs >= 5 THEN 1 ELSE p.segs + 1 END, r.len
FROM packing p JOIN ranked r ON r.doc_id = p.doc_id AND r.rn = p.rn + 1""",
        "batched": """
SELECT *, count(*) OVER b AS n, sum(len) OVER b + 3 * (count(*) OVER b - 1) AS size
FROM packing WINDOW b AS (PARTITION BY doc_id, batch_id)""",
        # Prompt and reply are joined and split again: a segment that ends in a bar moves
        # the cut, exactly as it does for a model.
        "prompts": """
SELECT doc_id, batch_id, string_split(string_agg(text, '|||' ORDER BY seq), '|||') AS sent,
  any_value(size) AS size FROM batched GROUP BY doc_id, batch_id""",
        "replies": f"""
SELECT doc_id, batch_id, sent, size, CASE WHEN size % 11 = 0 THEN NULL ELSE
  concat(array_to_string(list_transform(sent, lambda x: CASE WHEN length(x) % 5 = 0 THEN x
    ELSE concat(' ', {fold('x')}, ' ') END), '|||'),
    CASE WHEN size % 7 = 0 THEN '|||extra' ELSE '' END) END AS reply FROM prompts""",
        "outcomes": f"""
SELECT *, CASE WHEN reply IS NULL THEN 'timeout' WHEN len(parts) <> n THEN 'count'
    WHEN regexp_matches({strip('part')}, {lit(ACC)}) THEN 'leak' ELSE 'accept' END AS route,
  CASE WHEN reply IS NULL THEN text WHEN len(parts) <> n THEN NULL ELSE {strip('part')} END AS piece
FROM (SELECT *, parts[row_number() OVER (PARTITION BY doc_id, batch_id ORDER BY seq)] AS part
  FROM (SELECT b.*, r.reply, string_split({strip('r.reply')}, '|||') AS parts
    FROM batched b JOIN replies r USING (doc_id, batch_id)))""",
        "settled": f"""
SELECT doc_id, seq, text,
  CASE WHEN route IN ('accept', 'timeout') THEN piece
       WHEN len % 13 = 0 AND regexp_matches(text, {lit(ACC)}) THEN {strip('text')}
       ELSE {strip(fold('text'))} END AS translated_text,
  CASE WHEN route IN ('accept', 'timeout') THEN 0
       WHEN NOT regexp_matches(text, {lit(ACC)}) THEN 1
       WHEN len % 13 = 0 THEN 3 WHEN len % 5 = 0 THEN 2 ELSE 1 END AS retry_count,
  CASE WHEN route = 'accept' THEN 'accepted' WHEN route = 'timeout' THEN 'timeout'
       WHEN len % 13 = 0 AND regexp_matches(text, {lit(ACC)}) THEN 'best_effort'
       ELSE 'accepted' END AS status
FROM outcomes""",
    }


def sql(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    parts = {n: PARTS[n] for n in PARTS if n in names} | (extra or {})
    if not parts:
        return body.strip()
    recursive = "RECURSIVE " if "packing" in parts or "replacing" in parts else ""
    return (
        "WITH " + recursive + ",\n".join(f"{n} AS ({q.strip()})" for n, q in parts.items())
        + "\n" + body.strip()
    )


MD = ("lines", "md_lines")
MARKED = (*MD, "fences", "marked")
SEGS = (*MARKED, "items", "segs")
BITEXT = ("bitext", "tagged")

PARTS["bitext"] = fx.BITEXT.format(conversations="conversations")
PARTS["tagged"] = fx.TAGGED.format(bitext="bitext")
PARTS["tm_raw"] = fx.TM_RAW.format(bitext="bitext")
PARTS["tm"] = """
SELECT source, target, seq FROM tm_raw
QUALIFY row_number() OVER (PARTITION BY source ORDER BY seq DESC) = 1"""
PARTS["job_events"] = fx.JOB_EVENTS.format(events="events")
PARTS["jobs"] = fx.JOBS.format(job_events="job_events")
PARTS["attempts"] = """
SELECT job_id, event_id AS attempt_number, status AS phase, status <> 'failed' AS success
FROM job_events WHERE status <> 'pending'"""

# ---- sources and sinks ----------------------------------------------------------------

URL = "CASE WHEN page_id % 3 = 0 THEN concat(url, '.DocX') ELSE url END"
ORACLES["detect_types"] = rf"""
SELECT page_id, CASE WHEN ext IN ('docx', 'xlsx', 'pptx', 'pdf', 'md', 'txt', 'csv') THEN ext END
  AS file_type
FROM (SELECT page_id, lower(regexp_extract({URL}, '[^/.][^/]*\.([^./]*)$', 1)) AS ext FROM pages)"""
_PLACE = {c: i for i, c in enumerate(fx.CHARSETS)}
_JAPANESE = ", ".join(str(_PLACE[c]) for c in fx.JAPANESE)
# A text of ASCII alone has the same bytes in all charsets of one-byte units.
ORACLES["decode_corpus"] = f"""
SELECT doc_id, CASE n WHEN {_PLACE['utf-16']} THEN 'utf-16' WHEN {_PLACE['utf-16-le']} THEN 'utf-16-le'
    WHEN {_PLACE['utf-16-be']} THEN 'utf-16-be' ELSE CASE WHEN n < 2 OR regexp_full_match(text, '[\\x00-\\x7F]*')
    THEN 'utf-8' WHEN n = {_PLACE['cp932']} THEN 'cp932' WHEN n = {_PLACE['euc_jp']} THEN 'euc_jp'
    WHEN n = {_PLACE['iso2022_jp']} THEN 'iso2022_jp' ELSE 'cp1252' END END AS encoding, md5(text) AS text_md5
FROM (SELECT doc_id, n, CASE WHEN n IN ({_JAPANESE})
    THEN translate(text, {lit(fx.ACCENTED)}, {lit(fx.KANA)}) ELSE text END AS text
  FROM (SELECT *, doc_id % {len(fx.CHARSETS)} AS n FROM documents))"""
ORACLES["lines"] = sql(
    f"""
SELECT doc_id, line_idx, raw, {strip('raw')} AS text FROM lines l
WHERE raw <> '' OR line_idx < (SELECT max(line_idx) FROM lines m WHERE m.doc_id = l.doc_id)""",
    "lines",
)
ORACLES["office_runs"] = sql(
    """
SELECT doc_id, 'word/document.xml' AS part, line_idx AS ordinal, 0 AS run_idx,
  substr(raw, 1, 10) AS text, true AS has_format FROM lines WHERE raw <> ''
UNION ALL
SELECT doc_id, 'word/document.xml', line_idx, 1, substr(raw, 11), false
FROM lines WHERE length(raw) > 10""",
    "lines",
)

ORACLES["office_runs_xlsx"] = sql(
    """
SELECT doc_id, 'xl/workbook.xml' AS part, 'sheet' AS kind, 0 AS ordinal, concat('S', doc_id) AS text FROM documents
UNION ALL
SELECT doc_id, CASE WHEN line_idx % 2 = 0 THEN 'xl/sharedStrings.xml' ELSE 'xl/worksheets/one.xml' END,
  CASE WHEN line_idx % 2 = 0 THEN 'si' ELSE 'is' END, CAST(line_idx // 2 AS int), raw FROM lines WHERE raw <> ''""",
    "lines",
)
ORACLES["office_partial"] = sql(
    """
SELECT doc_id, concat('ppt/slides/slide', line_idx // 20, '.xml') AS part, CAST(line_idx % 20 AS int) AS ordinal,
  CASE WHEN k = 1 AND NOT starts_with(raw, ' ') THEN 1 ELSE 0 END AS run_idx,
  CASE WHEN k = 0 THEN string_split(raw, ' ')[1] ELSE substr(raw, length(string_split(raw, ' ')[1]) + 1) END AS text,
  k = 0 AS has_format, false AS unread
FROM lines, (SELECT unnest([0, 1]) AS k)
WHERE NOT (line_idx // 20 = 1 AND doc_id % 5 = 0)
  AND CASE WHEN k = 0 THEN string_split(raw, ' ')[1] <> '' ELSE contains(raw, ' ') END
UNION ALL
SELECT DISTINCT doc_id, 'ppt/slides/slide1.xml', NULL, NULL, NULL, NULL, true FROM lines
WHERE line_idx = 20 AND doc_id % 5 = 0""",
    "lines",
)

CONF = f"""
SELECT *, CASE WHEN blank THEN 0.0 ELSE greatest(0.0, least(1.0, round(
    CASE WHEN cache_hit THEN least(base + 0.2, 1.0) ELSE base END, 2))) END AS confidence
FROM (SELECT *, CAST(1.0 AS double)
  - CASE WHEN regexp_matches(regexp_replace(target, '</?tag[0-9]+/?>', '', 'g'), {lit(ACC)})
      THEN 0.5 ELSE 0.0 END
  - CASE WHEN list_sort(regexp_extract_all(source, '</?tag[0-9]+/?>'))
           = list_sort(regexp_extract_all(target, '</?tag[0-9]+/?>')) THEN 0.0 ELSE 0.4 END
  - CASE WHEN ratio < 0.3 OR ratio > 3.0 THEN 0.3 ELSE 0.0 END
  - CAST(0.1 AS double) * least(retry_count, 3) AS base
  FROM (SELECT *, coalesce({strip('target')}, '') = '' AS blank,
    CAST(length({strip('target')}) AS double) / greatest(length({strip('source')}), 1) AS ratio
    FROM tagged))"""
PARTS["conf"] = CONF
PARTS["buckets"] = """
SELECT *, CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence < 0.6 THEN 'low'
  ELSE 'medium' END AS bucket FROM conf"""
PARTS["units"] = f"""
SELECT conv_id AS doc_id, seq % 100 AS pos, source, target, confidence,
  CASE WHEN seq % 10 = 4 THEN 'final' WHEN coalesce({strip('target')}, '') = '' THEN 'new'
    WHEN confidence < 0.6 THEN 'needs-review-translation' ELSE 'translated' END AS state
FROM conf"""


def to_21(x: str) -> str:
    return f"""CASE {x} WHEN 'new' THEN 'initial' WHEN 'translated' THEN 'translated'
  WHEN 'needs-review-translation' THEN 'reviewed' WHEN 'final' THEN 'final' ELSE 'initial' END"""


def inline(x: str, version: str) -> str:
    """Escaped text with its only tag number converted, by literal replacement: an
    unclosed tag stays escaped text."""
    esc = f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    first, last = (
        ('<pc id="1" type="fmt">', "</pc>")
        if version == "2.1"
        else (
            '<bpt id="1" ctype="x-tag1">&lt;tag1&gt;</bpt>',
            '<ept id="1">&lt;/tag1&gt;</ept>',
        )
    )
    return f"""CASE WHEN {x} LIKE '%<tag1>%</tag1>%'
  THEN replace(replace({esc}, '&lt;tag1&gt;', {lit(first)}), '&lt;/tag1&gt;', {lit(last)})
  ELSE {esc} END"""


NOTES = """concat('<note from="system">location: line[', pos, ']</note>',
  '<note from="system">type: body</note><note from="system">confidence: ',
  printf('%.2f', confidence), '</note>')"""
BLANK_TARGET = f"coalesce({strip('target')}, '') = ''"
UNITS = ("bitext", "tagged", "conf", "units")
ORACLES["xliff_export"] = sql(
    f"""
SELECT doc_id, pos AS seq, concat('<trans-unit id="', pos + 1,
  '" translate="yes"><source xml:lang="ja">', {inline('source', '1.2')},
  '</source><target xml:lang="vi" state="', state, '">',
  CASE WHEN {BLANK_TARGET} THEN '' ELSE {inline('target', '1.2')} END, '</target>', {NOTES},
  '</trans-unit>') AS unit FROM units""",
    *UNITS,
)
ORACLES["xliff_export_v21"] = sql(
    f"""
SELECT doc_id, pos AS seq, concat('<unit id="u', pos + 1, '"><segment state="', {to_21('state')},
  '"><source>', {inline('source', '2.1')}, '</source><target>',
  CASE WHEN {BLANK_TARGET} THEN '' ELSE {inline('target', '2.1')} END,
  '</target></segment>', {NOTES}, '</unit>') AS unit FROM units""",
    *UNITS,
)
for _version, _name, _prefix in (("1.2", "xliff_import", ""), ("2.1", "xliff_import_v21", "u")):
    ORACLES[_name] = sql(
        f"""
SELECT doc_id, '{_version}' AS version,
  row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS unit_no,
  concat('{_prefix}', pos + 1) AS unit_id, source AS text,
  CASE WHEN {BLANK_TARGET} THEN '' ELSE target END AS translated_text, state AS xliff_state,
  concat('line[', pos, ']') AS location, 'body' AS type, round(confidence, 2) AS confidence
FROM units""",
        *UNITS,
    )
ORACLES["tm_upsert"] = sql("SELECT source, target, seq FROM tm", "bitext", "tm_raw", "tm")
ORACLES["latest_wins"] = ORACLES["tm_upsert"]
ORACLES["write_documents"] = r"""
SELECT page_id, concat(substr(name, 1, length(name) - length(ext)), '_vi', ext) AS name
FROM (SELECT page_id, name, CASE WHEN regexp_matches(name, '^\.*[^.].*\.[^.]*$')
    THEN regexp_extract(name, '\.[^.]*$') ELSE '' END AS ext
  FROM (SELECT page_id, regexp_extract(url, '[^/]*$') AS name FROM pages))"""

ORACLES["document_files"] = """
SELECT concat('in/', source, '/', doc_id // 10, '/', doc_id % 10, '_vi.md') AS name, md5(text) AS md5,
  CAST(strlen(text) AS bigint) AS bytes FROM documents"""
_HEAD = """concat('<?xml version="1.0" encoding="UTF-8"?>', chr(10),
  '<xliff version="1.2" xmlns="urn:oasis:names:tc:xliff:document:1.2">', chr(10), '<file original="talks/', doc_id,
  '.md" source-language="ja" target-language="vi" datatype="x-md" tool-id="locengine">', chr(10),
  '<header><tool tool-id="locengine" tool-name="locengine"/></header>', chr(10), '<body>', chr(10))"""
ORACLES["exchange_files"] = f"""
SELECT concat('talks/', doc_id, '.md.xlf') AS name, md5(content) AS md5, CAST(strlen(content) AS bigint) AS bytes
FROM (SELECT doc_id, concat({_HEAD}, string_agg(concat(unit, chr(10)), '' ORDER BY seq), '</body>', chr(10), '</file>',
    chr(10), '</xliff>', chr(10)) AS content FROM ({ORACLES['xliff_export']}) GROUP BY doc_id)"""

# ---- filters and projections ----------------------------------------------------------

REAL_LINES = """
SELECT l.* FROM lines l JOIN (SELECT doc_id, max(line_idx) AS last FROM lines GROUP BY doc_id) m
  ON m.doc_id = l.doc_id WHERE l.raw <> '' OR l.line_idx < m.last"""
PARTS["real_lines"] = REAL_LINES
LINES = ("lines", "real_lines")
ORACLES["has_script"] = sql(
    f"SELECT doc_id, line_idx, regexp_matches(raw, {lit(ACC)}) AS has_script FROM real_lines", *LINES
)
ORACLES["translatable"] = sql(
    f"SELECT doc_id, line_idx, {translatable(strip('raw'))} AS translatable FROM real_lines", *LINES
)
ORACLES["script_leak"] = sql(
    f"SELECT doc_id, line_idx, len(regexp_extract_all(raw, {lit(ACC)})) > 0 AS script_leak "
    "FROM real_lines",
    *LINES,
)

PARTS["word_rows"] = """
SELECT doc_id, line_idx, generate_subscripts(string_split(raw, ' '), 1) - 1 AS i,
  unnest(string_split(raw, ' ')) AS word FROM lines"""
PARTS["run_rows"] = """
SELECT doc_id, line_idx, i + (i + 4) // 9 AS run_idx, concat(word, ' ') AS text,
  (i + line_idx) % 3 = 0 AS has_format, i % 11 = 10 AS in_link FROM word_rows
UNION ALL
SELECT doc_id, line_idx, i + (i + 4) // 9 + 1, '[1]', i % 2 = 0, false FROM word_rows WHERE i % 9 = 4"""
PARTS["kept_runs"] = f"""
SELECT *, row_number() OVER p - 1 AS kept_idx,
  sum(has_format::int) OVER (p ROWS UNBOUNDED PRECEDING) AS tag
FROM run_rows WHERE NOT in_link AND NOT regexp_matches({strip('text')}, '^\\[\\p{{Nd}}+\\]$')
WINDOW p AS (PARTITION BY doc_id, line_idx ORDER BY run_idx)"""
PARTS["tag_segs"] = f"""
SELECT * FROM (
  SELECT doc_id, line_idx, {strip('''string_agg(CASE WHEN has_format
    THEN concat('<tag', tag, '>', text, '</tag', tag, '>') ELSE text END, '' ORDER BY run_idx)''')} AS text
  FROM kept_runs GROUP BY doc_id, line_idx) WHERE {translatable('text')}"""
RUNS = ("lines", "word_rows", "run_rows", "kept_runs")
ORACLES["footnote_runs"] = sql(
    "SELECT doc_id, line_idx AS ordinal, kept_idx, text, has_format FROM kept_runs", *RUNS
)
ORACLES["tag_numbers"] = sql(
    """
SELECT doc_id, line_idx AS ordinal, run_idx, CASE WHEN has_format THEN
  sum(has_format::int) OVER (PARTITION BY doc_id, line_idx ORDER BY run_idx) END AS tag FROM run_rows""",
    "lines", "word_rows", "run_rows",
)
ORACLES["tag_runs"] = sql(
    """
SELECT doc_id, line_idx AS seq, concat('word/document.xml:p[', line_idx, ']') AS location,
  'body' AS type, text FROM tag_segs""",
    *RUNS, "tag_segs",
)
ORACLES["run_boundary_space"] = sql(
    r"""
SELECT doc_id, line_idx AS ordinal, string_agg(CASE WHEN regexp_matches(text, '\p{L}$')
    AND regexp_matches(following, '^\p{L}') THEN concat(text, ' ') ELSE text END, '|' ORDER BY run_idx) AS text
FROM (SELECT *, lead(text) OVER (PARTITION BY doc_id, line_idx ORDER BY run_idx) AS following
  FROM (SELECT doc_id, line_idx, run_idx, rtrim(text, ' ') AS text FROM run_rows))
GROUP BY doc_id, line_idx""",
    "lines", "word_rows", "run_rows",
)

# An empty last line of a document is not a line.
PARTS["marked_lines"] = """
SELECT * FROM marked x WHERE raw <> '' OR line_idx < (
  SELECT max(line_idx) FROM md_lines y WHERE y.doc_id = x.doc_id)"""
ORACLES["fence_state"] = sql(
    "SELECT doc_id, line_idx, inside FROM marked_lines", *MARKED, "marked_lines"
)
ORACLES["diagram_blocks"] = sql(
    "SELECT doc_id, line_idx, CAST(block AS int) AS block, is_diagram FROM marked WHERE inside", *MARKED
)
_SEG_COLUMNS = "doc_id, seq, location, type, cell_index, text"
ORACLES["extract_text"] = sql(f"SELECT {_SEG_COLUMNS} FROM segs", *SEGS)
for _name, _type in (
    ("body_segments", "body"), ("table_cells", "table_cell"), ("diagram_tokens", "diagram_token"),
):
    ORACLES[_name] = sql(f"SELECT {_SEG_COLUMNS} FROM segs WHERE type = '{_type}'", *SEGS)


def pieces_of(source: str) -> str:
    """Sentences packed to 400 characters by a fold over the sentence list."""
    ends = lit(f"([.!?])[{WS}]*")
    cut = f"string_split(regexp_replace(text, {ends}, concat('\\1', chr(1)), 'g'), chr(1))"
    return f"""
SELECT * EXCLUDE (folded), generate_subscripts(folded.done, 1) - 1 AS piece,
  {strip('unnest(folded.done)')} AS piece_text
FROM (SELECT * EXCLUDE (packed), {{'done': CASE WHEN packed.cur = '' THEN packed.done
    ELSE list_append(packed.done, packed.cur) END}} AS folded
  FROM (SELECT *, list_reduce(list_transform({cut}, lambda x: {{'done': CAST([] AS varchar[]), 'cur': x}}),
      lambda a, x: CASE WHEN x.cur = '' THEN a
        WHEN a.cur <> '' AND length(a.cur) + length(x.cur) > 400
          THEN {{'done': list_append(a.done, a.cur), 'cur': x.cur}}
        ELSE {{'done': a.done, 'cur': concat(a.cur, x.cur)}} END,
      {{'done': CAST([] AS varchar[]), 'cur': ''}}) AS packed
    FROM {source} WHERE length(text) > 400))"""


PARTS["seg_pieces"] = pieces_of("segs")
PARTS["split_segs"] = """
SELECT doc_id, seq, concat(location, '[p', piece, ']') AS location, CAST(piece AS int) AS piece,
  piece_text AS text FROM seg_pieces
UNION ALL
SELECT doc_id, seq, location, NULL, text FROM segs WHERE length(text) <= 400"""
ORACLES["split_long"] = sql("SELECT * FROM split_segs", *SEGS, "seg_pieces", "split_segs")

PARTS["heavy"] = """
SELECT doc_id, line_idx AS seq, concat('word/document.xml:p[', line_idx, ']') AS location,
  len(regexp_extract_all(text, '</?tag[0-9]+>')) > 8 AS heavy,
  CASE WHEN len(regexp_extract_all(text, '</?tag[0-9]+>')) > 8
    THEN regexp_replace(text, '</?tag[0-9]+>', '', 'g') ELSE text END AS text FROM tag_segs"""
PARTS["plain_heavy"] = "SELECT * FROM heavy WHERE heavy"
PARTS["heavy_pieces"] = pieces_of("plain_heavy")
PARTS["office_segs"] = """
SELECT doc_id, seq, concat(location, '[p', piece, ']') AS location, CAST(piece AS int) AS piece,
  piece_text AS text FROM heavy_pieces
UNION ALL
SELECT doc_id, seq, location, NULL, text FROM heavy WHERE NOT heavy OR length(text) <= 400"""
OFFICE = (*RUNS, "tag_segs", "heavy", "plain_heavy", "heavy_pieces", "office_segs")
ORACLES["strip_heavy_tags"] = sql("SELECT * FROM office_segs", *OFFICE)
ORACLES["office_segments"] = sql(
    f"""
SELECT doc_id, seq, piece, location, 'body' AS type, text FROM office_segs
QUALIFY row_number() OVER (PARTITION BY doc_id, {strip('text')} ORDER BY seq, piece) = 1""",
    *OFFICE,
)
ORACLES["chunk_text"] = """
WITH RECURSIVE cutting AS (
  SELECT doc_id, -1 AS chunk_idx, '' AS chunk, text AS rest FROM documents
  UNION ALL
  SELECT doc_id, chunk_idx + 1, substr(rest, 1, n), substr(rest, n + 1) FROM (
    SELECT *, CASE WHEN length(rest) <= 400 THEN length(rest)
      WHEN regexp_matches(substr(rest, 1, 400), '[.!?\\n]')
        THEN 400 - length(regexp_extract(substr(rest, 1, 400), '[^.!?\\n]*$'))
      ELSE 400 END AS n FROM cutting WHERE rest <> ''))
SELECT doc_id, chunk_idx, chunk FROM cutting WHERE chunk_idx >= 0""".replace("\\\\n", "\\n")
ORACLES["xliff_tags"] = sql(
    """
SELECT seq,
  concat(replace(replace(source, '<tag1>', '<bpt id="1" ctype="x-tag1">&lt;tag1&gt;</bpt>'),
    '</tag1>', '<ept id="1">&lt;/tag1&gt;</ept>'), '<x id="2" ctype="x-tag2"/>',
    '<bpt id="3" ctype="x-tag3">&lt;tag3&gt;</bpt>', source, '<ept id="3">&lt;/tag3&gt;</ept>') AS v12,
  concat(replace(replace(source, '<tag1>', '<pc id="1" type="fmt">'), '</tag1>', '</pc>'),
    '<ph id="2" type="other"/><pc id="3" type="fmt">', source, '</pc>') AS v21,
  concat(source, '<tag2/><tag3>', source, '</tag3>') AS back12,
  concat(source, '<tag2/><tag3>', source, '</tag3>') AS back21
FROM tagged""",
    *BITEXT,
)
ORACLES["xliff_state"] = sql(
    f"""
SELECT doc_id, pos AS seq, state, {to_21('state')} AS state21, state AS back FROM units""",
    *UNITS,
)
ORACLES["locations"] = sql(
    """
SELECT NULL AS part, 'line' AS kind, CAST(regexp_extract(location, '\\[([0-9]+)\\]', 1) AS int)
  AS ordinal, piece, count(*) AS segments FROM split_segs GROUP BY ALL
UNION ALL
SELECT 'word/document.xml', 'p', line_idx, NULL, count(*) FROM tag_segs GROUP BY ALL""".replace(
        "\\\\", "\\"
    ),
    *SEGS, "seg_pieces", "split_segs", *RUNS, "tag_segs",
)

ABBREVIATION = "regexp_replace({0}, '([A-Z]{{2,}})([A-Z][a-zà-ỹ])', '\\1 \\2', 'g')"


def abbreviation(x: str) -> str:
    return ABBREVIATION.format(x)


def spacing(x: str) -> str:
    """Spaces between accented and ASCII words, decided character by character on the
    list ``c`` of characters."""
    foreign = "regexp_matches({0}, '\\p{{L}}') AND NOT regexp_matches({0}, '[\\x00-\\x7F]')"

    def any_foreign(first: str, last: str) -> str:
        test = foreign.format("ch")
        return f"len(list_filter(c[greatest({first}, 1):{last}], lambda ch: {test})) > 0"

    return f"""(SELECT array_to_string(list_transform(range(1, len(c) + 1), lambda i: concat(c[i],
  CASE WHEN i = len(c) THEN ''
    WHEN regexp_matches(c[i], '\\p{{Ll}}') AND regexp_matches(c[i + 1], '[A-Z0-9]')
      THEN CASE WHEN {any_foreign('i - 2', 'i')} THEN ' ' ELSE '' END
    WHEN regexp_matches(c[i], '[A-Za-z]') AND regexp_matches(c[i + 1], '\\p{{Lu}}')
      THEN CASE WHEN NOT regexp_matches(c[i + 1], '[\\x00-\\x7F]') THEN ' '
        WHEN {any_foreign('i + 2', 'i + 4')} AND NOT {any_foreign('i - 3', 'i')} THEN ' ' ELSE '' END
    ELSE '' END)), '') FROM (SELECT string_split({abbreviation(x)}, '') AS c))"""


ORACLES["latin_spacing"] = sql(
    f"""
SELECT doc_id, line_idx, {abbreviation("upper(replace(raw, 'ß', 'ss'))")} AS abbreviation,
  {spacing("regexp_replace(raw, '([a-zß-ÿ]) ([A-Z0-9À-Þ])', '\\1\\2', 'g')")} AS line
FROM real_lines""",
    *LINES,
)
ORACLES["visual_width"] = sql(
    f"""
SELECT doc_id, line_idx, list_sum(widths) AS width, array_to_string(list_transform(
  list_filter(range(1, least(len(c), 41) + 1), lambda i: list_sum(widths[1:i]) <= 40), lambda i: c[i]), '') AS prefix
FROM (SELECT doc_id, line_idx, c, list_transform(c, lambda x:
    CASE WHEN regexp_matches(x, '[アイウ]') THEN 2 ELSE 1 END) AS widths
  FROM (SELECT doc_id, line_idx, string_split(translate(raw, 'abc', 'アイウ'), '') AS c FROM real_lines))""",
    *LINES,
)

# ---- translations, rebuild ------------------------------------------------------------

PARTS["translated"] = f"""
SELECT *, CASE WHEN type = 'diagram_token' THEN concat({fold('text')}, '+')
  WHEN type = 'body' AND seq % 7 = 3 THEN NULL
  WHEN type = 'body' THEN concat('|## ', {fold('text')}, '|')
  ELSE {fold('text')} END AS target FROM segs"""


def cleaned(x: str, prefix: str) -> str:
    tail = f"CASE WHEN ends_with({x}, '|') THEN rtrim(left({x}, length({x}) - 1), {STRIP}) ELSE {x} END"
    head = f"(SELECT CASE WHEN starts_with(y, '|') THEN ltrim(substr(y, 2), {STRIP}) ELSE y END FROM (SELECT {tail} AS y))"
    any_prefix = "'^(### |## |# |- |\\* |> )'"
    once = f"regexp_replace({head}, {any_prefix}, '')"
    return f"""(SELECT CASE WHEN {prefix} = '' THEN regexp_replace(z, '^(### |## |# )', '')
  WHEN starts_with(z, {prefix}) THEN regexp_replace(substr(z, length({prefix}) + 1), {any_prefix}, '')
  ELSE regexp_replace(z, {any_prefix}, '') END FROM (SELECT {once} AS z))"""


PREFIX = "regexp_extract(ltrim(raw, " + STRIP + "), '^(### |## |# |- |\\* |> )')"


def rebuilt_line(target: str) -> str:
    return (
        f"concat(repeat(' ', length(raw) - length(ltrim(raw, {STRIP}))), prefix, "
        + spacing(cleaned(target, "prefix"))
        + ")"
    )


ORACLES["md_prefix_fix"] = sql(
    f"""
SELECT doc_id, seq, {rebuilt_line('target')} AS line FROM (SELECT *, {PREFIX} AS prefix FROM (
  SELECT doc_id, seq, target, concat('   ', CASE WHEN seq % 2 = 0 THEN '- ' ELSE '' END, text) AS raw
  FROM translated WHERE type = 'body' AND target IS NOT NULL))""",
    *SEGS, "translated",
)
PARTS["cell_lines"] = f"""
SELECT doc_id, line_idx, list_reduce(
    list_transform(cells, lambda x: {{'t': x.text, 'r': x.target}}),
    lambda a, x: CASE WHEN strpos(a.t, x.t) = 0 THEN a ELSE {{'t': concat(
      left(a.t, strpos(a.t, x.t) - 1), x.r, substr(a.t, strpos(a.t, x.t) + length(x.t))), 'r': ''}} END,
    {{'t': raw, 'r': ''}}).t AS line
FROM (SELECT s.doc_id, s.line_idx, any_value(m.raw) AS raw,
    list({{'text': text, 'target': spaced}} ORDER BY -length(text), seq) AS cells
  FROM (SELECT *, {spacing('target')} AS spaced FROM translated
    WHERE type = 'table_cell' AND text <> target) s JOIN md_lines m USING (doc_id, line_idx)
  GROUP BY s.doc_id, s.line_idx)"""
PARTS["token_rows"] = f"""
SELECT s.doc_id, s.line_idx, m.raw, s.text, min_by(spaced, seq) AS target, min(seq) AS seq,
  string_split(m.raw, s.text) AS parts
FROM (SELECT *, {spacing('target')} AS spaced FROM translated
  WHERE type = 'diagram_token' AND text <> target) s JOIN md_lines m USING (doc_id, line_idx)
GROUP BY s.doc_id, s.line_idx, m.raw, s.text"""
PARTS["occurrences"] = """
SELECT doc_id, line_idx, raw, text, target, seq,
  unnest(list_transform(range(1, len(parts)), lambda k:
    list_sum(list_transform(parts[1:k], lambda x: length(x))) + (k - 1) * length(text))) AS spot
FROM token_rows"""
PARTS["token_lines"] = f"""
SELECT doc_id, line_idx, {spacing('folded.line')} AS line, folded.overflow AS overflow FROM (
  SELECT doc_id, line_idx, list_reduce(steps,
    lambda a, x: {{
      'line': concat(left(a.line, x.spot), x.target, repeat(' ', greatest(0, x.size
          + length(substr(a.line, x.spot + x.size + 1)) - length(ltrim(substr(a.line, x.spot + x.size + 1), ' '))
          - length(x.target))), ltrim(substr(a.line, x.spot + x.size + 1), ' ')),
      'overflow': a.overflow OR length(x.target) > x.size
          + length(substr(a.line, x.spot + x.size + 1)) - length(ltrim(substr(a.line, x.spot + x.size + 1), ' ')),
      'spot': 0, 'size': 0, 'target': ''}},
    {{'line': raw, 'overflow': false, 'spot': 0, 'size': 0, 'target': ''}}) AS folded
  FROM (SELECT doc_id, line_idx, any_value(raw) AS raw, list({{'line': '', 'overflow': false,
      'spot': CAST(spot AS int), 'size': CAST(length(text) AS int), 'target': target}} ORDER BY spot DESC, seq) AS steps
    FROM occurrences GROUP BY doc_id, line_idx))"""
PARTS["body_lines"] = f"""
SELECT doc_id, line_idx, {rebuilt_line('target')} AS line FROM (
  SELECT s.doc_id, s.line_idx, m.raw, s.target, {PREFIX} AS prefix
  FROM translated s JOIN md_lines m USING (doc_id, line_idx)
  WHERE type = 'body' AND target IS NOT NULL)"""
ORACLES["cell_replace"] = sql(
    "SELECT * FROM cell_lines", *SEGS, "translated", "cell_lines"
)
TOKENS = ("translated", "token_rows", "occurrences", "token_lines")
ORACLES["diagram_replace"] = sql("SELECT * FROM token_lines", *SEGS, *TOKENS)
REBUILD_PARTS = ("cell_lines", "token_rows", "occurrences", "token_lines", "body_lines")
PARTS["rebuilt"] = f"""
SELECT doc_id, md5(string_agg(line, {NL} ORDER BY line_idx)) AS text_md5,
  length(string_agg(line, {NL} ORDER BY line_idx)) AS chars
FROM (SELECT m.doc_id, m.line_idx, coalesce(c.line, b.line, k.line, m.raw) AS line FROM md_lines m
  LEFT JOIN cell_lines c USING (doc_id, line_idx) LEFT JOIN body_lines b USING (doc_id, line_idx)
  LEFT JOIN token_lines k USING (doc_id, line_idx)) GROUP BY doc_id"""
ORACLES["rebuild_documents"] = sql(
    "SELECT * FROM rebuilt", *SEGS, "translated", *REBUILD_PARTS, "rebuilt"
)
ORACLES["review_roundtrip"] = sql(
    "SELECT doc_id, text_md5 FROM rebuilt",
    *SEGS,
    extra={
        "sent": PARTS["translated"],
        "reviewed": f"""
SELECT doc_id, {strip('text')} AS source, target FROM sent WHERE coalesce({strip('target')}, '') <> ''
QUALIFY row_number() OVER (PARTITION BY doc_id, {strip('text')} ORDER BY seq DESC) = 1""",
        "translated": f"""
SELECT s.doc_id, s.seq, s.line_idx, s.type, s.text, {strip('r.target')} AS target
FROM segs s LEFT JOIN reviewed r ON r.doc_id = s.doc_id AND r.source = {strip('s.text')}""",
    }
    | {n: PARTS[n] for n in (*REBUILD_PARTS, "rebuilt")},
)
ORACLES["translation_map"] = sql(
    f"""
SELECT doc_id, {strip('text')} AS source, {strip('target')} AS target, seq FROM translated
WHERE {strip('target')} <> '' AND {strip('text')} <> {strip('target')}
QUALIFY row_number() OVER (PARTITION BY doc_id, {strip('text')} ORDER BY seq DESC) = 1""",
    *SEGS, "translated",
)

# ---- joins ----------------------------------------------------------------------------

MEMORY = ("bitext", "tm_raw", "tm")
ORACLES["tm_lookup"] = sql(
    """
SELECT conv_id, turn, t.target AS translated_text, t.target IS NOT NULL AS cache_hit
FROM conversations c LEFT JOIN tm t ON t.source = c.text AND t.target <> ''""",
    *MEMORY,
)
ORACLES["tm_misses"] = sql(
    """
SELECT DISTINCT text FROM conversations c
WHERE NOT EXISTS (SELECT 1 FROM tm t WHERE t.source = c.text AND t.target <> '')""",
    *MEMORY,
)
ORACLES["review_merge"] = sql(
    f"""
SELECT t.conv_id AS doc_id, t.seq, coalesce(r.target, t.target) AS translated_text,
  r.target IS NOT NULL AS reviewed
FROM tagged t LEFT JOIN (
  SELECT key, concat('R ', max(seq)) AS target FROM (
    SELECT seq, {strip("concat('<tag1>', substr(source, 1, 10), '</tag1>', substr(source, 11))")} AS key
    FROM bitext WHERE conv_id % 4 <> 1) GROUP BY key) r ON r.key = {strip('t.source')}""",
    *BITEXT,
)
ORACLES["phrase_replace"] = sql(
    """
SELECT doc_id, seq, CASE WHEN hit IS NOT NULL THEN hit WHEN w <> plain THEN w END AS translated_text
FROM replacing QUALIFY row_number() OVER (PARTITION BY doc_id, seq ORDER BY rk DESC) = 1""",
    "lines",
    extra={
        "texts": f"""
SELECT doc_id, line_idx AS seq, raw, {strip('marked')} AS stripped,
  regexp_replace({strip('marked')}, '\\[\\p{{Nd}}+\\]', '', 'g') AS plain
FROM (SELECT *, CASE WHEN line_idx % 4 = 0 THEN concat(substr(raw, 1, 20), '[3]', substr(raw, 21))
  ELSE raw END AS marked FROM lines)""",
        "pairs": f"""
SELECT doc_id, seq, {strip('source')} AS source, {strip("concat('«', substr(line, 3, 5), '»')")} AS target
FROM (SELECT *, CASE seq % 3 WHEN 0 THEN line WHEN 1 THEN substr(line, 1, 10)
    ELSE substr(line, 5, 4) END AS source
  FROM (SELECT doc_id, seq, {strip('raw')} AS line FROM texts))""",
        "tmap": """
SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY -length(source), first_seq) AS rk FROM (
  SELECT doc_id, source, target, min(seq) OVER (PARTITION BY doc_id, source) AS first_seq
  FROM pairs WHERE source <> '' AND target <> '' AND source <> target
  QUALIFY row_number() OVER (PARTITION BY doc_id, source ORDER BY seq DESC) = 1)""",
        "replacing": """
SELECT t.doc_id, t.seq, t.plain, coalesce(a.target, b.target) AS hit, CAST(0 AS bigint) AS rk, t.plain AS w
FROM texts t LEFT JOIN tmap a ON a.doc_id = t.doc_id AND a.source = t.stripped
  LEFT JOIN tmap b ON b.doc_id = t.doc_id AND b.source = t.plain
UNION ALL
SELECT r.doc_id, r.seq, r.plain, r.hit, m.rk, replace(r.w, m.source, m.target)
FROM replacing r JOIN tmap m ON m.doc_id = r.doc_id AND m.rk = r.rk + 1 WHERE r.hit IS NULL""",
    },
)
ORACLES["paragraph_fallback"] = sql(
    f"""
SELECT p.doc_id, p.seq, CASE WHEN a.target IS NOT NULL THEN 'tagged' WHEN b.target IS NOT NULL
  THEN 'plain' END AS match_kind, md5(coalesce(a.target, b.target)) AS target_md5
FROM p LEFT JOIN tmap a ON a.doc_id = p.doc_id AND a.source = p.text
LEFT JOIN tmap b ON b.doc_id = p.doc_id AND b.source = p.plain""",
    *RUNS, "tag_segs",
    extra={
        "p": f"""
SELECT doc_id, line_idx AS seq, text, {strip("regexp_replace(text, '</?tag[0-9]+>', '', 'g')")} AS plain
FROM tag_segs""",
        "tmap": f"""
SELECT doc_id, source, {strip(fold('source'))} AS target FROM (
  SELECT DISTINCT doc_id, CASE WHEN seq % 3 = 0 THEN text ELSE plain END AS source FROM p WHERE seq % 3 <> 2)""",
    },
)
ORACLES["paragraph_rebuild"] = sql(
    """
SELECT doc_id, seq, CASE WHEN w IS NULL THEN NULL WHEN w = start THEN NULL ELSE md5(w) END AS target_md5
FROM (SELECT doc_id, seq, start, w FROM replacing
  QUALIFY row_number() OVER (PARTITION BY doc_id, seq ORDER BY stage DESC, rk DESC) = 1)""",
    *RUNS, "tag_segs",
    extra={
        "p": """
SELECT doc_id, line_idx AS seq, text, regexp_replace(text, '</?tag[0-9]+>', '', 'g') AS plain FROM tag_segs""",
        "tmap": f"""
SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY -length(source), first_seq) AS rk FROM (
  SELECT doc_id, source, {strip(fold('source'))} AS target, min(seq) AS first_seq FROM (
    SELECT doc_id, seq, {strip("CASE seq % 3 WHEN 0 THEN text WHEN 1 THEN plain ELSE substr(plain, 1, 12) END")} AS source
    FROM p) GROUP BY doc_id, source) WHERE source <> '' AND source <> target AND target <> ''""",
        "last": "SELECT doc_id, max(rk) AS n FROM tmap GROUP BY doc_id",
        "replacing": f"""
SELECT p.doc_id, p.seq, p.plain, 1 AS stage, CAST(0 AS bigint) AS rk, a.target IS NOT NULL AS hit,
  text AS start, coalesce(a.target, text) AS w, coalesce(n, 0) AS n
FROM p LEFT JOIN last USING (doc_id) LEFT JOIN tmap a ON a.doc_id = p.doc_id AND a.source = p.text
UNION ALL
SELECT r.doc_id, r.seq, r.plain, CASE WHEN r.rk = r.n THEN 2 ELSE r.stage END,
  CASE WHEN r.rk = r.n THEN 0 ELSE r.rk + 1 END,
  CASE WHEN r.rk = r.n THEN b.target IS NOT NULL ELSE false END,
  CASE WHEN r.rk = r.n THEN {strip('r.plain')} ELSE r.start END,
  CASE WHEN r.rk = r.n THEN coalesce(b.target, {strip('r.plain')}) ELSE replace(r.w, m.source, m.target) END, r.n
FROM replacing r LEFT JOIN tmap m ON m.doc_id = r.doc_id AND m.rk = r.rk + 1
LEFT JOIN tmap b ON b.doc_id = r.doc_id AND b.source = {strip('r.plain')}
WHERE NOT r.hit AND (r.rk < r.n OR (r.stage = 1 AND r.w = r.start))""",
    },
)
STAMP = "strftime(created_at, '%Y-%m-%d %H:%M:%S.%f')"
JOBS = ("job_events", "jobs", "attempts")
ATTEMPT = "concat(attempt_number, ':', phase, ':', success)"
ORACLES["job_detail"] = sql(
    f"""
SELECT job_id, filename, {STAMP} AS created_at,
  CASE WHEN attempt_number IS NULL THEN '' ELSE {ATTEMPT} END AS attempt
FROM jobs LEFT JOIN attempts USING (job_id)""",
    *JOBS,
)
ORACLES["ordered_attempts"] = sql(
    f"""
SELECT job_id, CAST(attempt_number AS bigint) AS attempt_number, {ATTEMPT} AS attempt
FROM attempts""",
    *JOBS,
)

# ---- aggregations, windows, top-k -----------------------------------------------------

ORACLES["dedup_segments"] = sql(
    f"""
SELECT doc_id, seq, text FROM segs
QUALIFY row_number() OVER (PARTITION BY doc_id, {strip('text')} ORDER BY seq) = 1""",
    *SEGS,
)
_TAGS = "list_sort(regexp_extract_all({0}, '</?tag[0-9]+{1}>'))"
ORACLES["tag_check"] = sql(
    f"""
SELECT seq, coalesce({_TAGS.format('source', '')} = {_TAGS.format('t', '')}, false) AS paired,
  coalesce({_TAGS.format('source', '/?')} = {_TAGS.format('t', '/?')}, false) AS all_tags
FROM (SELECT *, CASE WHEN seq % 2 = 0 THEN target || '<tag9/>' ELSE target END AS t FROM tagged)""",
    *BITEXT,
)
SCORED = ("bitext", "tagged", "conf", "buckets")
ORACLES["confidence_score"] = sql(
    "SELECT conv_id AS doc_id, seq, confidence, bucket FROM buckets", *SCORED
)
_STATS = """count(*) AS total, count(*) FILTER (bucket = 'high') AS high_count,
  count(*) FILTER (bucket = 'medium') AS medium_count, count(*) FILTER (bucket = 'low') AS low_count"""
ORACLES["confidence_stats"] = sql(
    f"""
SELECT {_STATS}, round(100.0 * count(*) FILTER (bucket = 'high') / greatest(count(*), 1), 6) AS high_pct,
  round(coalesce(avg(confidence), 0), 6) AS avg_confidence FROM buckets""",
    *SCORED,
)
ORACLES["confidence_report"] = sql(
    """
SELECT conv_id AS doc_id, bucket, count(*) AS segments FROM buckets GROUP BY ROLLUP (conv_id, bucket)""",
    *SCORED,
)
ORACLES["segment_counts"] = sql(
    """
SELECT d.doc_id, type, coalesce(n, 0) AS segments,
  CASE WHEN n IS NULL THEN 'failed' ELSE 'extracted' END AS status
FROM documents d LEFT JOIN (SELECT doc_id, type, count(*) AS n FROM segs GROUP BY ALL) USING (doc_id)""",
    *SEGS,
)
ORACLES["glossary_table"] = f"""
SELECT 1 AS part, item_id AS id, concat('| ', replace(substr(text, 1, length(text) // 2), {NL}, ' '), ' | ',
  replace(substr(text, length(text) // 2 + 1), {NL}, ' '), ' | ',
  CASE WHEN item_id % 2 = 0 THEN 'general' ELSE '' END, ' |') AS line FROM benchmark
UNION ALL SELECT 0, NULL, {lit(batch.GLOSSARY_HEAD)} WHERE EXISTS (SELECT 1 FROM benchmark)
UNION ALL SELECT 2, NULL, concat({NL}, {lit(batch.GLOSSARY_TAIL)}) WHERE EXISTS (SELECT 1 FROM benchmark)"""


def _prompt_sql() -> str:
    base = "\n".join(
        f"WHEN '{file_type}' THEN {lit(prompt)}" for file_type, prompt in batch.base_prompts().items()
    )
    tags = "regexp_extract_all(text, '</?tag[0-9]+>')"
    return sql(
        f"""
SELECT doc_id, seq, attempt, md5(concat(CASE file_type {base} END, {NL}, glossary,
  CASE WHEN attempt > 1 THEN concat({NL}, {NL}, CASE WHEN len({tags}) > 0 THEN concat(
    {lit(batch.TAG_WARNING)}, array_to_string({tags}, ' '), {NL}) ELSE '' END,
    {lit(batch.LEAK_WARNING)}) ELSE '' END)) AS prompt_md5
FROM segs JOIN file_types USING (doc_id), (SELECT unnest([1, 2]) AS attempt),
  (SELECT concat({lit(batch.GLOSSARY_HEAD)}, {NL}, string_agg(concat('| ', n_name, ' | ', pretty,
     ' |  |'), {NL} ORDER BY n_nationkey), {NL}, {NL}, {lit(batch.GLOSSARY_TAIL)}) AS glossary
   FROM (SELECT n_nationkey, n_name, array_to_string(list_transform(string_split(n_name, ' '),
     lambda w: concat(upper(left(w, 1)), lower(substr(w, 2)))), ' ') AS pretty FROM nation))""",
        *SEGS, "file_types",
    )


ORACLES["prompt_rows"] = _prompt_sql()
REPLIES = replies_of("segs")
_UPTO = ("ranked", "packing")
_PACK = {k: REPLIES[k] for k in _UPTO}
_BATCHED = _PACK | {"batched": REPLIES["batched"]}
_REPLIES = _BATCHED | {k: REPLIES[k] for k in ("prompts", "replies")}
_OUTCOMES = _REPLIES | {"outcomes": REPLIES["outcomes"]}
ORACLES["pack_batches"] = sql("SELECT doc_id, seq, batch_id FROM packing", *SEGS, extra=_PACK)
ORACLES["batch_check"] = sql(
    """
SELECT doc_id, count(*) AS batches, sum(n) AS sent, sum(got) AS received,
  count(*) FILTER (got <> n) AS mismatched, count(*) FILTER (lost) AS timeouts
FROM (SELECT doc_id, batch_id, any_value(n) AS n, bool_and(reply IS NULL) AS lost,
    coalesce(len(string_split(any_value(reply), '|||')), 0) AS got
  FROM batched JOIN replies USING (doc_id, batch_id) GROUP BY ALL) GROUP BY doc_id""",
    *SEGS, extra=_REPLIES,
)
ORACLES["batch_translate"] = sql(
    """
SELECT doc_id, batch_id, any_value(n) AS segments, any_value(reply) AS reply
FROM batched JOIN replies USING (doc_id, batch_id) GROUP BY ALL""",
    *SEGS, extra=_REPLIES,
)
ORACLES["accepted_vs_retry"] = sql(
    "SELECT doc_id, batch_id, seq, piece AS translated_text, route FROM outcomes",
    *SEGS, extra=_OUTCOMES,
)
ORACLES["retry_loop"] = sql(
    "SELECT doc_id, seq, translated_text, retry_count, status FROM settled",
    *SEGS, extra=REPLIES,
)
ORACLES["job_summary"] = sql(
    """
SELECT count(*) FILTER (status = 'completed') AS ok, count(*) AS total,
  CAST(sum(CAST(duration AS decimal(18, 6))) AS double) AS seconds, sum(length(status)) AS segments
FROM job_events WHERE status IN ('completed', 'failed')""",
    "job_events",
)
ORACLES["job_progress"] = sql(
    """
SELECT doc_id AS job_id, batch_id, done, round(0.3 + 0.5 * done / greatest(total, 1), 6) AS progress
FROM (SELECT doc_id, batch_id, sum(n) OVER (PARTITION BY doc_id ORDER BY batch_id) AS done,
    sum(n) OVER (PARTITION BY doc_id) AS total
  FROM (SELECT doc_id, batch_id, count(*) AS n FROM packing GROUP BY ALL))""",
    *SEGS, extra=_PACK,
)
ORACLES["recent_jobs"] = sql(
    f"""
SELECT job_id, filename, {STAMP} AS created_at FROM jobs
ORDER BY jobs.created_at DESC, job_id DESC LIMIT 20""",
    "job_events", "jobs",
)
ORACLES["job_status"] = sql(
    """
SELECT job_id, status, events FROM (
  SELECT *, count(*) OVER (PARTITION BY job_id) AS events, row_number() OVER (PARTITION BY job_id
    ORDER BY (status IN ('completed', 'failed')) DESC, ts DESC, event_id DESC) AS rn FROM job_events)
WHERE rn = 1""",
    "job_events",
)

# ---- sets, whole flow, stream ---------------------------------------------------------

ORACLES["extract_all"] = sql(
    f"""
SELECT doc_id, file_type, location, type, cell_index, text, NULL AS error
FROM segs JOIN file_types USING (doc_id) WHERE file_type <> 'pdf'
UNION ALL
SELECT doc_id, 'docx', location, 'body', NULL, text, NULL FROM (
  SELECT doc_id, concat('word/document.xml:p[', line_idx, ']') AS location, {strip('''
    concat('<tag1>', substr(raw, 1, 10), '</tag1>', substr(raw, 11))''')} AS text, line_idx FROM lines)
WHERE {translatable('text')}
QUALIFY row_number() OVER (PARTITION BY doc_id, text ORDER BY line_idx) = 1
UNION ALL
SELECT doc_id, 'docx', NULL, NULL, NULL, NULL, 'unbound prefix: line 1, column 0' FROM documents
UNION ALL
SELECT doc_id, file_type, NULL, NULL, NULL, NULL, 'unsupported type' FROM file_types
WHERE file_type = 'pdf'""",
    *SEGS, "file_types",
)
PARTS["text_segs"] = """
SELECT s.*, f.file_type, f.lang FROM segs s JOIN file_types f USING (doc_id)
WHERE file_type <> 'pdf'"""
PARTS["known"] = f"""
SELECT text AS source, CASE WHEN length(text) < 20 THEN '' ELSE {fold('text')} END AS target
FROM (SELECT DISTINCT text FROM segs JOIN file_types USING (doc_id) WHERE lang = 'fr')"""
PARTS["owners"] = """
SELECT doc_id, seq, text FROM text_segs
WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.source = text AND k.target <> '')
QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id, seq) = 1"""
CORPUS = (*SEGS, "file_types", "text_segs", "known", "owners")
_RESULT = replies_of("owners") | {
    "joined": """
SELECT s.doc_id, s.seq, s.text AS source, coalesce(k.target, r.translated_text) AS target,
  CASE WHEN k.target IS NOT NULL THEN 0 ELSE r.retry_count END AS retry_count,
  k.target IS NOT NULL AS cache_hit
FROM text_segs s LEFT JOIN known k ON k.source = s.text AND k.target <> ''
LEFT JOIN settled r ON r.text = s.text""",
    "conf2": CONF.replace("FROM tagged", "FROM joined"),
    "rated": PARTS["buckets"].replace("FROM conf", "FROM conf2"),
}
ORACLES["translate_corpus"] = sql(
    """
SELECT doc_id, seq, target AS translated_text, retry_count, cache_hit, confidence, bucket
FROM rated""",
    *CORPUS, extra=_RESULT,
)
ORACLES["translate_corpus_documents"] = sql(
    "SELECT r.* FROM rebuilt r JOIN file_types USING (doc_id) WHERE file_type <> 'pdf'",
    *CORPUS,
    extra=_RESULT
    | {
        "translated": """
SELECT s.doc_id, s.seq, s.line_idx, s.type, s.text, r.target
FROM text_segs s JOIN rated r USING (doc_id, seq) WHERE r.target <> ''"""
    }
    | {n: PARTS[n] for n in (*REBUILD_PARTS, "rebuilt")},
)
ORACLES["translate_corpus_export"] = sql(
    f"""
SELECT doc_id, seq + 1 AS line_no, md5(concat('<trans-unit id="', seq + 1,
  '" translate="yes"><source xml:lang="ja">', {inline('text', '1.2')},
  '</source><target xml:lang="vi" state="', CASE WHEN blank THEN 'new'
    WHEN confidence < 0.6 THEN 'needs-review-translation' ELSE 'translated' END, '">',
  CASE WHEN blank THEN '' ELSE {inline('target', '1.2')} END,
  '</target><note from="system">location: ', location, '</note><note from="system">type: ', type,
  '</note><note from="system">confidence: ', printf('%.2f', confidence), '</note></trans-unit>')) AS line_md5
FROM (SELECT s.doc_id, s.seq, s.location, s.type, s.text, r.target, r.blank, r.confidence
  FROM text_segs s JOIN rated r USING (doc_id, seq))""",
    *CORPUS, extra=_RESULT,
)
ORACLES["translate_corpus_import"] = sql(
    f"""
SELECT s.doc_id, s.seq, r.target AS translated_text,
  CASE WHEN r.target IS NULL THEN 0.0 WHEN length(r.target) > 3 * length(s.text) THEN 0.7 ELSE 1.0 END
    AS confidence
FROM text_segs s LEFT JOIN (SELECT DISTINCT text, concat('R ', {fold('text')}) AS target
  FROM segs JOIN file_types USING (doc_id) WHERE lang = 'fr') r ON r.text = s.text""",
    *SEGS, "file_types", "text_segs",
)
ORACLES["stream_job_status"] = sql(
    """
SELECT job_id, arg_max(status, (status IN ('completed', 'failed'), ts, event_id)) AS status
FROM job_events GROUP BY job_id""",
    "job_events",
)
ORACLES["translate_corpus_status"] = sql(
    f"""
SELECT f.doc_id, CASE WHEN total IS NULL THEN 'failed' ELSE 'completed' END AS status,
  coalesce(total, 0) AS segments_count, CASE WHEN file_type = 'pdf' THEN 'unsupported type'
    WHEN total IS NULL THEN 'no translatable text' END AS error,
  high_count, medium_count, low_count, avg_confidence
FROM file_types f LEFT JOIN (SELECT doc_id, {_STATS}, round(avg(confidence), 6) AS avg_confidence
  FROM rated GROUP BY doc_id) USING (doc_id)""",
    *CORPUS, extra=_RESULT,
)
ORACLES["translate_corpus_memory"] = sql(
    """
SELECT source, target, CAST(1 AS bigint) AS seq FROM known
WHERE source NOT IN (SELECT text FROM settled WHERE status = 'accepted')
UNION ALL
SELECT text, translated_text, 2 FROM settled WHERE status = 'accepted'""",
    *CORPUS, extra=replies_of("owners"),
)
ORACLES["corpus_failures"] = sql(
    f"""
SELECT f.doc_id, CASE WHEN total IS NULL OR refused > 0 THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN file_type = 'pdf' THEN 'unsupported type' WHEN total IS NULL THEN 'no translatable text'
    WHEN refused > 0 THEN 'RuntimeError: refused' END AS error,
  coalesce(refused, 0) AS refused, file_type <> 'pdf' AND coalesce(refused, 0) = 0 AS written
FROM file_types f LEFT JOIN (SELECT doc_id, count(*) AS total, count(*) FILTER (length(text) % 17 = 0
    AND NOT EXISTS (SELECT 1 FROM known k WHERE k.source = text AND k.target <> '')) AS refused
  FROM text_segs GROUP BY doc_id) USING (doc_id)""",
    *SEGS, "file_types", "text_segs", "known",
)
_STREAM = {
    k: (PARTS[k].replace("md_lines", "lines") if k == "fences" else PARTS[k])
    for k in ("lines", "fences", "marked", "items", "segs")
}
ORACLES["stream_tm_lookup"] = sql(
    f"""
SELECT s.doc_id, s.seq, s.text, k.target AS translated_text, k.target IS NOT NULL AS cache_hit
FROM segs s LEFT JOIN (SELECT DISTINCT text AS source, {fold('text')} AS target
  FROM segs JOIN documents d USING (doc_id) WHERE lang = 'fr') k ON k.source = s.text""".replace(
        "SELECT DISTINCT text AS source", "SELECT DISTINCT segs.text AS source"
    ).replace(fold("text") + " AS target\n  FROM segs", fold("segs.text") + " AS target\n  FROM segs"),
    extra=_STREAM,
)

# ---- column types ---------------------------------------------------------------------

# Where the comparison engine would give a wider type than the operator.
_INTS = {
    "line_idx": [
        "lines", "has_script", "translatable", "script_leak", "fence_state", "diagram_blocks",
        "latin_spacing", "visual_width", "cell_replace", "diagram_replace",
    ],
    "ordinal": ["office_runs", "footnote_runs", "tag_numbers", "locations", "run_boundary_space"],
    "kept_idx": ["footnote_runs"],
    "run_idx": ["tag_numbers"],
    "tag": ["tag_numbers"],
    "width": ["visual_width"],
    "chars": ["rebuild_documents", "translate_corpus_documents"],
    "segments": ["batch_translate"],
}
_LONGS = {
    "sent": ["batch_check"],
    "received": ["batch_check"],
    "segments": ["job_summary"],
    "done": ["job_progress"],
}


def _cast(name: str, column: str, kind: str) -> None:
    ORACLES[name] = (
        f"SELECT * REPLACE (CAST({column} AS {kind}) AS {column}) FROM (\n{ORACLES[name]})"
    )


for _kind, _columns in (("int", _INTS), ("bigint", _LONGS)):
    for _column, _names in _columns.items():
        for _name in _names:
            _cast(_name, _column, _kind)
_cast("translate_corpus_import", "confidence", "double")
