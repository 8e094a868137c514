"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_TOKEN = "⟦PH:[0-9]{6}⟧"


def _strip(c: str) -> str:
    return f"trim({c}, {_SPACES})"


def _tokens(c: str) -> str:
    return f"regexp_extract_all({c}, '{_TOKEN}')"


def _bare(c: str) -> str:
    return f"regexp_replace({c}, '{_TOKEN}', '', 'g')"


def _count(c: str, kind: str) -> str:
    return f"length(regexp_replace({c}, '[^{kind}]', '', 'g'))"


_KANA, _LATIN = "ぁ-ゟ゠-ヿｦ-ﾟー", "A-Za-z"

SEG = f"""
src AS (SELECT doc_id, source AS book,
  '⟦PH:000001⟧ ' || coalesce(text, '') || ' ⟦PH:00000' || CAST(doc_id % 3 + 1 AS VARCHAR) || '⟧' AS source_text FROM documents),
seg AS (SELECT CAST(doc_id AS VARCHAR) AS segment_id, book, doc_id AS order_index, source_text,
  CASE doc_id % 5 WHEN 0 THEN ' ' || chr(10) WHEN 1 THEN source_text WHEN 2 THEN '[中]' || source_text
    WHEN 3 THEN '[中]' || {_bare("source_text")} ELSE '⟦PH:000001⟧[中]' || source_text END AS translated FROM src)
"""

TERMS = """
raw AS (SELECT split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) AS source, min(item_id) AS item_id FROM benchmark GROUP BY 1),
terms AS (SELECT source, '术语' || CAST(item_id AS VARCHAR) || '（' || source || '）' AS target, item_id % 2 = 0 AS force, item_id AS term_rank
          FROM raw WHERE item_id % 5 <> 4)
"""

_MISMATCH = f"list_sort({_tokens('source_text')}) <> list_sort({_tokens('translated')})"
_PROBE = _strip(_bare(_strip("source_text")))
_SAME = f"({_strip('source_text')} = {_strip('translated')} AND {_PROBE} <> '')"
_LONG = f"(length({_PROBE}) >= 40 AND {_count(_PROBE, _LATIN)} >= 20)"
_RETRY = f"({_SAME} AND ({_count(_PROBE, _KANA)} >= 1 OR {_LONG}))"
_BLANK = f"({_strip('translated')} = '')"


def _issues() -> str:
    return f"""
WITH {SEG}, {TERMS},
i AS (SELECT segment_id, 'empty_translation' AS issue_type, 0 AS check_order FROM seg WHERE {_BLANK}
  UNION ALL SELECT segment_id, 'placeholder_mismatch', 1 FROM seg WHERE NOT {_BLANK} AND {_MISMATCH}
  UNION ALL SELECT segment_id, 'same_as_source', 2 FROM seg WHERE NOT {_BLANK} AND {_SAME} AND ({_count(_PROBE, _KANA)} >= 2 OR {_LONG})
  UNION ALL SELECT segment_id, 'term_inconsistency', 3 FROM seg JOIN terms ON contains(lower(source_text), lower(source)) AND force AND NOT contains(translated, target))
"""


#: Missing tokens of seg rows, in order of first sight: m (segment_id, missing).
def _missing(text: str) -> str:
    return f"""
s1 AS (SELECT segment_id, unnest({_tokens("source_text")}) AS t, generate_subscripts({_tokens("source_text")}, 1) AS p FROM seg),
s2 AS (SELECT segment_id, t, count(*) AS n, min(p) AS p FROM s1 GROUP BY segment_id, t),
d1 AS (SELECT segment_id, unnest({_tokens(text)}) AS t FROM seg),
d2 AS (SELECT segment_id, t, count(*) AS n FROM d1 GROUP BY segment_id, t),
m AS (SELECT s2.segment_id, string_agg(repeat(s2.t, greatest(0, s2.n - coalesce(d2.n, 0))), '' ORDER BY s2.p) AS missing
      FROM s2 LEFT JOIN d2 ON s2.segment_id = d2.segment_id AND s2.t = d2.t GROUP BY s2.segment_id)
"""


_SITE = """
site AS (SELECT doc_id, 'text/ch' || doc_id || '.xhtml' AS file_path, 's' || doc_id AS anchor,
  CASE doc_id % 5 WHEN 0 THEN '#s' || doc_id WHEN 1 THEN 'ch' || (doc_id + 1) || '.xhtml#s' || (doc_id + 1) WHEN 2 THEN 'ch' || (doc_id + 1) || '.xhtml#none'
    WHEN 3 THEN 'https://example.org/#' || doc_id ELSE 'other/ch' || (doc_id + 1) || '.xhtml#s' || (doc_id + 1) END AS href FROM documents),
links AS (SELECT file_path, href, CASE WHEN split_part(href, '#', 1) = '' THEN file_path ELSE 'text/' || split_part(href, '#', 1) END AS target,
  split_part(href, '#', 2) AS fragment, href LIKE 'http://%' OR href LIKE 'https://%' OR href LIKE 'mailto:%' AS outside FROM site)
"""

_FIRST_TWO = "split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2)"
_FIRST_WORD = "regexp_extract(text, '^[^ \\t\\n\\r\\x0b\\f]*')"
_LIST = "list(struct_pack(turn := turn, h := {}) ORDER BY turn)"

_TASK_LINE = r"""regexp_replace(line, '(?:https?://\\S+|mailto:\\S+)|[0-9]{1,3}(?:,[0-9]{3})*(?:\\.[0-9]+)?(?:st|nd|rd|th)?|[0-9]+', '', 'g')"""
#: Lines of documents that make a task: what is left of them without numbers and addresses is not blank.
LINES = f"""
l AS (SELECT CAST(doc_id AS VARCHAR) AS book, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
p AS (SELECT book, count(*) FILTER (WHERE {_strip(_TASK_LINE)} <> '') AS n FROM l GROUP BY book)
"""

_WORD = "[A-Za-z][A-Za-z''’-]*|[A-Z]{2,}"
_CONNECTOR = "('of', 'the', 'and', 'de', 'von', 'van', 'la', 'le', 'di', 'da', 'du')"
_STOP = "('the', 'a', 'an', 'in', 'on', 'at', 'for', 'to', 'from', 'and', 'but', 'or', 'nor', 'yet', 'so', 'he', 'she', 'it', 'they', 'we', 'i', 'this', 'that', 'these', 'those', 'chapter', 'book', 'part')"
_UPPER = "({0} = upper({0}) AND regexp_matches({0}, '[A-Z]'))"


def _mined(single: bool) -> str:
    """Capitalised runs of words: stretches of capitals and connectors from their first capital on, trimmed at both ends."""
    alone = f"lower(phrase) NOT IN {_STOP}" if single else f"{_UPPER.format('phrase')} AND lower(phrase) NOT IN {_STOP}"
    return f"""
s AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[\n\r.!?;:]+')) AS sentence, generate_subscripts(regexp_split_to_array(text, '[\n\r.!?;:]+'), 1) AS k FROM documents WHERE length({_strip('text')}) >= 2),
w AS (SELECT doc_id, k, unnest(regexp_extract_all(sentence, '{_WORD}')) AS word, generate_subscripts(regexp_extract_all(sentence, '{_WORD}'), 1) AS i FROM s),
c AS (SELECT *, length(word) >= 2 AND ({_UPPER.format('word')} OR regexp_matches(word, '^[A-Z]') AND regexp_matches(substr(word, 2), '[A-Za-z]')) AS cap, lower(word) IN {_CONNECTOR} AS conn FROM w),
b AS (SELECT *, sum(CASE WHEN cap OR conn THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, k ORDER BY i) AS stretch FROM c),
r AS (SELECT doc_id, k, stretch, list(word ORDER BY i) AS ws, list(cap ORDER BY i) AS cs, list(conn ORDER BY i) AS ns FROM b WHERE cap OR conn GROUP BY doc_id, k, stretch),
e AS (SELECT *, list_position(cs, true) AS first, (SELECT max(j) FROM unnest(range(1, len(ns) + 1)) AS t(j) WHERE NOT ns[j]) AS last FROM r WHERE list_contains(cs, true)),
t AS (SELECT *, (SELECT min(j) FROM unnest(range(first, last + 1)) AS t(j) WHERE lower(ws[j]) NOT IN ('the', 'a', 'an') OR j = last) AS start FROM e WHERE last >= first),
f AS (SELECT array_to_string(ws[start:last], ' ') AS phrase, last - start + 1 AS n FROM t),
found AS (SELECT phrase, count(*) AS freq FROM f WHERE length(phrase) >= 3 AND NOT regexp_full_match(phrase, '[IVXLCDM]+') AND (n > 1 OR {alone}) GROUP BY phrase),
top AS (SELECT * FROM found WHERE freq >= 2 ORDER BY freq DESC, length(phrase) DESC, phrase LIMIT 300)
"""


#: Texts cut to pieces of 1200 code points at most: c (doc_id, n, piece). After each cut white space is passed over.
_CHUNKS = f"""
c AS (SELECT doc_id, 0 AS n, CAST(NULL AS VARCHAR) AS piece, text AS rest, length(text) <= 1200 AS whole FROM documents
  UNION ALL SELECT doc_id, n + 1,
    CASE WHEN length(rest) <= 1200 THEN rest WHEN {_strip("left(rest, cut)")} = '' THEN left(rest, 1200) ELSE {_strip("left(rest, cut)")} END,
    CASE WHEN length(rest) > 1200 THEN ltrim(substr(rest, 1 + CASE WHEN {_strip("left(rest, cut)")} = '' THEN 1200 ELSE cut END), {_SPACES}) END, false
  FROM (SELECT *, coalesce(nullif(length(regexp_extract(left(rest, 1200), '(?s)^(.*[。！？.!?;；:：])\\s', 1)), 0),
      nullif(CASE WHEN strpos(reverse(left(rest, 1200)), ' ') > 0 AND strpos(reverse(left(rest, 1200)), ' ') < least(1200, length(rest)) THEN least(1200, length(rest)) + 1 - strpos(reverse(left(rest, 1200)), ' ') ELSE 0 END, 0), 1200) AS cut
    FROM c WHERE rest IS NOT NULL AND (rest <> '' OR n = 0)))
"""

_STYLE = """CASE doc_id % 6 WHEN 0 THEN 'faithful_fluent' WHEN 1 THEN 'literary_cn' WHEN 2 THEN 'concise_cn' ELSE 'faithful_literal' END"""

ORACLES = {
    "seg_hash": "SELECT doc_id, sha256(text) AS source_hash FROM documents",
    "mock_translate": "SELECT doc_id, sha256('[中]' || text) AS translated_hash FROM documents",
    "token_counts": f"WITH {SEG}, t AS (SELECT segment_id, unnest({_tokens('source_text')}) AS token FROM seg) SELECT segment_id, token, count(*) AS n FROM t GROUP BY segment_id, token",
    "placeholder_mismatch": f"WITH {SEG} SELECT segment_id, 'error' AS severity, 'placeholder_mismatch' AS issue_type FROM seg WHERE NOT {_BLANK} AND {_MISMATCH}",
    "empty_translation": f"WITH {SEG} SELECT segment_id, 'empty_translation' AS issue_type, '译文为空' AS message FROM seg WHERE {_BLANK}",
    "unchanged_detect": f"""WITH {SEG} SELECT segment_id, {_RETRY} AS retry,
        CASE WHEN {_SAME} AND {_count(_PROBE, _KANA)} >= 2 THEN '译文与原文完全一致（含日文假名）' WHEN {_SAME} AND {_LONG} THEN '译文与原文完全一致（长拉丁文本）' END AS message FROM seg""",
    "needs_repair": f"WITH {SEG} SELECT segment_id, {_BLANK} OR {_MISMATCH} OR {_RETRY} AS bad FROM seg",
    "unchanged_count": f"WITH {SEG} SELECT count(*) FILTER (WHERE {_strip('source_text')} = {_strip('translated')}) AS unchanged FROM seg",
    "repair_tokens": f"""WITH {SEG}, {_missing("translated")}
        SELECT segment_id, sha256(CASE WHEN missing = '' THEN translated WHEN {_BLANK} THEN missing ELSE {_strip("translated")} || ' ' || missing END) AS repaired_hash
        FROM seg JOIN m USING (segment_id)""",
    "candidate_choice": f"""WITH {SEG.replace("seg AS (SELECT CAST", "seg0 AS (SELECT CAST")},
        seg AS (SELECT segment_id, source_text, CASE WHEN trim(translated) <> '' THEN translated ELSE '' END AS r, CASE WHEN order_index % 2 = 0 THEN source_text ELSE '' END AS d FROM seg0),
        {_missing("CASE WHEN r <> '' THEN r ELSE d END")}
        SELECT segment_id, sha256(CASE WHEN r <> '' AND list_sort({_tokens("source_text")}) = list_sort({_tokens("r")}) THEN r WHEN d <> '' AND list_sort({_tokens("source_text")}) = list_sort({_tokens("d")}) THEN d
          WHEN missing = '' THEN CASE WHEN r <> '' THEN r ELSE d END WHEN {_strip("CASE WHEN r <> '' THEN r ELSE d END")} = '' THEN missing
          ELSE {_strip("CASE WHEN r <> '' THEN r ELSE d END")} || ' ' || missing END) AS chosen_hash FROM seg JOIN m USING (segment_id)""",
    "decode_tokens": f"""WITH {SEG} SELECT segment_id, sha256(replace(replace(replace(source_text, '⟦PH:000001⟧', '<b>1</b>'), '⟦PH:000002⟧', book), '⟦PH:000003⟧', '')) AS decoded_hash FROM seg""",
    "term_hits": f"WITH {TERMS} SELECT doc_id, terms.source, target, force FROM documents JOIN terms ON contains(lower(text), lower(terms.source))",
    "term_inconsistency": f"""WITH {SEG}, {TERMS} SELECT segment_id, 'term_inconsistency' AS issue_type, '强制术语未遵守: ' || source || ' -> ' || target AS message
        FROM seg JOIN terms ON contains(lower(source_text), lower(source)) AND force AND NOT contains(translated, target)""",
    "batch_term_hits": f"""WITH {SEG}, {TERMS} SELECT book, source, target, min(order_index) AS first_index FROM seg JOIN terms ON contains(lower(source_text), lower(source)) GROUP BY book, source, target""",
    "format_term": f"""WITH t AS (SELECT item_id, {_FIRST_TWO} AS s FROM benchmark),
        u AS (SELECT item_id, s, CASE item_id % 4 WHEN 0 THEN '' WHEN 1 THEN '译（' || s || '）' WHEN 2 THEN '译 (' || s || ')' ELSE 'plain' END AS g FROM t),
        l AS (SELECT *, CASE WHEN g <> '' AND (suffix(g, '（' || s || '）') OR suffix(g, '(' || s || ')')) THEN trim(left(g, length(g) - length(s) - 2)) ELSE g END AS left_part FROM u)
        SELECT item_id, CASE WHEN g = '' OR contains(g, '（' || s || '）') OR contains(g, '(' || s || ')') THEN g ELSE g || '（' || s || '）' END AS formatted,
          left_part, regexp_matches(left_part, '[一-鿿]') AS cjk FROM l""",
    "normalise_targets": """SELECT item_id, CASE item_id % 3 WHEN 0 THEN '术语（' || split_part(text, ' ', 1) || '）' ELSE '' END AS target, item_id % 3 = 1 AS cleared FROM benchmark""",
    "fill_outcomes": f"""WITH s AS (SELECT DISTINCT {_FIRST_WORD} AS source FROM documents WHERE {_FIRST_WORD} <> '')
        SELECT CASE length(source) % 3 WHEN 0 THEN 'kept' WHEN 1 THEN 'filled' ELSE 'rejected' END AS outcome, count(*) AS n FROM s GROUP BY 1""",
    "new_terms_anti": f"""WITH f AS (SELECT {_FIRST_WORD} AS phrase, count(*) AS freq FROM documents WHERE {_FIRST_WORD} <> '' GROUP BY 1),
        top AS (SELECT * FROM f WHERE freq >= 2 ORDER BY freq DESC, length(phrase) DESC, phrase LIMIT 300)
        SELECT phrase AS source, '' AS target, 'auto-generated; freq=' || CAST(freq AS VARCHAR) AS note FROM top
        WHERE NOT EXISTS (SELECT 1 FROM benchmark WHERE split_part(text, ' ', 1) = phrase)""",
    "cache_probe": f"""WITH {SEG}, p AS (SELECT segment_id, source_text, CASE WHEN order_index % 3 = 0 THEN NULL WHEN order_index % 2 = 0 AND translated <> '' THEN translated ELSE source_text END AS cached FROM seg)
        SELECT segment_id, CASE WHEN cached IS NULL THEN 'pending' WHEN {_RETRY.replace("translated", "cached")} THEN 'suspicious' ELSE 'cached' END AS state, sha256(cached) AS cached_hash FROM p""",
    "tm_upsert": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY CASE WHEN value >= 50 THEN 1 ELSE 0 END DESC, ts DESC, event_id DESC) AS n FROM events)
        SELECT user_id, event_type, event_id, value, props FROM r WHERE n = 1""",
    "greedy_batches": """WITH RECURSIVE d AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
        b AS (SELECT source, doc_id, n_chars, k, 0 AS batch_no, 1 AS in_batch, n_chars AS size FROM d WHERE k = 1
          UNION ALL SELECT d.source, d.doc_id, d.n_chars, d.k, CASE WHEN in_batch >= 20 OR size + d.n_chars > 8000 THEN batch_no + 1 ELSE batch_no END,
            CASE WHEN in_batch >= 20 OR size + d.n_chars > 8000 THEN 1 ELSE in_batch + 1 END, CASE WHEN in_batch >= 20 OR size + d.n_chars > 8000 THEN d.n_chars ELSE size + d.n_chars END
          FROM b JOIN d ON d.source = b.source AND d.k = b.k + 1)
        SELECT source, doc_id, n_chars, batch_no FROM b""",
    "prev_context": "SELECT conv_id, turn, coalesce(right(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), 300), '') AS context_prev_source FROM conversations",
    "merge_chunks": "SELECT conv_id, sha256(string_agg(CASE WHEN role <> 'system' THEN text ELSE '' END, '' ORDER BY turn)) AS merged_hash FROM conversations GROUP BY conv_id",
    "poetry_lines": """WITH n AS (SELECT doc_id, doc_id % 4 = 0 AS longer, length(text) - length(replace(text, chr(10), '')) + 1 AS e FROM documents WHERE lang <> 'en')
        SELECT 'poetry_line_mismatch' AS issue_type, '诗歌行数变化: expected=' || e || ', got=' || (e + 1) AS message, '{"node_task_id":"' || doc_id || '"}' AS meta FROM n WHERE longer""",
    "qa_issues": f"{_issues()} SELECT segment_id, 'error' AS severity, issue_type, check_order FROM i",
    "qa_type_counts": f"{_issues()} SELECT issue_type, count(*) AS n FROM i GROUP BY issue_type",
    "qa_gate": """WITH c AS (SELECT count(*) FILTER (WHERE toxic = 1) AS error_count, count(*) FILTER (WHERE toxic <> 1 AND quality = 0) AS warn_count FROM labels),
        g AS (SELECT *, greatest(CAST(floor((SELECT count(*) FROM documents) * 0.005) AS BIGINT), 20) AS warn_cap FROM c)
        SELECT *, error_count = 0 AND warn_count <= warn_cap AS passed FROM g""",
    "link_break": f"""WITH {_SITE}
        SELECT 'link_break' AS issue_type, CASE WHEN f.file_path IS NULL THEN 'href target file missing: ' ELSE 'href fragment missing: ' END || l.href || ' from ' || l.file_path AS message
        FROM links l LEFT JOIN site f ON f.file_path = l.target LEFT JOIN site a ON a.file_path = l.target AND a.anchor = l.fragment
        WHERE NOT outside AND fragment <> '' AND a.file_path IS NULL""",
    "link_targets": f"WITH {_SITE} SELECT file_path, href, CASE WHEN outside THEN 'text/' || split_part(href, '#', 1) ELSE target END AS target, fragment, outside FROM links",
    "toc_changes": "SELECT 'toc_href_mismatch' AS issue_type, count(DISTINCT conv_id) AS n FROM conversations WHERE conv_id % 7 = 0 AND turn = 1 AND sha256(text) <> 'changed' HAVING count(*) > 0",
    "attribute_changes": """WITH p AS (SELECT page_id, regexp_extract_all(html, '(href|class|lang)=', 1) AS s FROM pages WHERE page_id % 6 = 0)
        SELECT 'Watched attributes changed in p' || page_id AS message, '{"before_count":' || len(s) || ',"after_count":' || len(list_filter(s, lambda x: x <> 'href')) || '}' AS meta FROM p WHERE list_contains(s, 'href')""",
    "task_union": """WITH u AS (SELECT conv_id, role, turn, 0 AS branch FROM conversations WHERE role <> 'system' UNION ALL SELECT conv_id, role, turn, 1 FROM conversations WHERE role = 'system')
        SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY branch, turn) AS order_index FROM u""",
    "node_ids": "SELECT source, doc_id, 'NT_' || lpad(CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS VARCHAR), 6, '0') AS node_task_id FROM documents",
    "revise_join": """SELECT c.conv_id, c.turn, sha256(coalesce(d.text, '')) AS draft_hash, sha256(coalesce(r.text, '')) AS revised_hash FROM conversations c
        LEFT JOIN conversations d ON d.conv_id = c.conv_id AND d.turn = c.turn + 1 LEFT JOIN conversations r ON r.conv_id = c.conv_id AND r.turn = c.turn + 2 WHERE c.role = 'user'""",
    "translated_tasks": "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "failed_ids": "SELECT DISTINCT user_id FROM events WHERE event_type = 'error'",
    "segment_types": """WITH t AS (SELECT unnest(regexp_extract_all(html, '<([a-z0-9]+)', 1)) AS tag FROM pages)
        SELECT CASE WHEN tag = 'title' THEN 'title' WHEN regexp_full_match(tag, 'h[0-9]+') THEN 'heading' WHEN tag = 'li' THEN 'list_item' WHEN tag IN ('td', 'th') THEN 'table_cell' ELSE 'paragraph' END AS segment_type,
          count(*) AS n FROM t GROUP BY 1""",
    "class_filter": """WITH c AS (SELECT page_id, unnest(regexp_extract_all(html, 'class="([^"]*)"', 1)) AS c FROM pages)
        SELECT page_id, count(*) AS n FROM c WHERE list_has_any(string_split(lower(c), ' '), ['ad', 'raw']) GROUP BY page_id""",
    "style_guides": f"""WITH s AS (SELECT doc_id, {_STYLE} AS style FROM documents)
        SELECT doc_id, style, CASE style WHEN 'faithful_fluent' THEN 'faithful_fluent_zh_hans' WHEN 'literary_cn' THEN 'literary_zh_hans' WHEN 'concise_cn' THEN 'concise_zh_hans' ELSE 'faithful_literal_zh_hans' END AS translate_guide,
          CASE style WHEN 'faithful_fluent' THEN 'fluent' WHEN 'literary_cn' THEN 'literary' WHEN 'concise_cn' THEN 'concise' ELSE 'light' END || '_revision_keep_meaning_and_placeholders' AS revise_guide FROM s""",
    "reply_check": "SELECT conv_id AS batch_key, CASE conv_id % 4 WHEN 2 THEN 'duplicate id' WHEN 3 THEN CASE WHEN count(*) > 0 THEN CASE WHEN count(*) = 1 THEN 'id/translated_text missing' ELSE 'ids mismatch' END END END AS error FROM conversations GROUP BY conv_id",
    "run_counts": f"""WITH {SEG} SELECT count(*) AS total_segments, count(*) FILTER (WHERE translated <> '') AS translated_segments, count(*) FILTER (WHERE order_index % 3 = 0) AS cached_segments,
        count(DISTINCT CASE WHEN order_index % 3 <> 0 THEN book END) AS llm_calls, count(*) FILTER (WHERE trim(translated, ' ') = chr(10)) AS failed_segments FROM seg""",
    "provider_run": f"""WITH {SEG} SELECT segment_id, 'MockProvider+MockReviser' AS provider, sha256('[中]' || source_text) AS draft_hash, sha256('[校][中]' || source_text) AS revise_hash, true AS ok FROM seg""",
    # Every page leaves its meta element open.
    "parse_failures": "SELECT 'html_parse_fail' AS issue_type, CAST(page_id AS VARCHAR) AS file_path, 'mismatched tag' AS why FROM pages WHERE page_id % 3 <> 0",
    "toc_snapshot": """WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS book, lower(regexp_extract(coalesce(text, ''), '[A-Za-z]{3,}')) AS label FROM documents),
        h AS (SELECT *, 'ch1.xhtml#' || book || ' ch1.xhtml #' || label AS hrefs FROM d)
        SELECT book, 'NT_TOC_000001' AS node_task_id, 'ch1.xhtml#' || book AS href, label AS source_text, hrefs FROM h WHERE label <> ''
        UNION ALL SELECT book, CASE WHEN label = '' THEN 'NT_TOC_000001' ELSE 'NT_TOC_000002' END, 'ch1.xhtml', 'all', hrefs FROM h""",
    "epub_round_trip": f"""WITH {LINES} SELECT book, 'title' AS segment_type, 1 AS n_tasks, 'NT_000001' AS first_id FROM p
        UNION ALL SELECT book, 'paragraph', n, 'NT_000002' FROM p WHERE n > 0""",
    "epub_rewrite": f"WITH {LINES} SELECT book, n AS n_translated, n AS n_paragraphs FROM p WHERE n > 0",
    "archive_files": f"WITH {LINES} SELECT book, n AS n_paragraphs, 0 AS n_elsewhere FROM p WHERE n > 0",
    "term_freq_topk": f"WITH {_mined(False)} SELECT phrase, freq FROM top",
    "term_mining": f"""WITH {TERMS}, {_mined(True)} SELECT source, target, force, '' AS note, 0 AS branch FROM terms
        UNION ALL SELECT phrase, '', false, 'auto-generated; freq=' || CAST(freq AS VARCHAR), 1 FROM top WHERE phrase NOT IN (SELECT source FROM terms)""",
    "chunk_text": f"WITH RECURSIVE {_CHUNKS} SELECT doc_id, count(piece) AS n_chunks, max(length(piece)) AS longest FROM c GROUP BY doc_id",
    "segments_build": f"""WITH RECURSIVE {_CHUNKS}, p AS (SELECT doc_id AS book, n, piece FROM c WHERE piece IS NOT NULL)
        SELECT book, CAST(n - 1 AS INTEGER) AS chunk_index, 'S' || lpad(CAST(n AS VARCHAR), 9, '0') AS segment_id, sha256(piece) AS text_hash,
          sha256(coalesce(right(lag(piece) OVER (PARTITION BY book ORDER BY n), 300), '')) AS context_hash FROM p""",
    # Word runs stand between marks, so that RE2, which looks neither back nor ahead, can tell whole ones.
    "mask_literals": r"""WITH RECURSIVE p0 AS (SELECT doc_id, text, regexp_extract_all(text, '(https?://[^\s\x{85}\x{a0}\x{2000}-\x{200a}]+|mailto:[^\s\x{85}\x{a0}\x{2000}-\x{200a}]+)') AS m1,
          regexp_replace(text, 'https?://[^\s\x{85}\x{a0}\x{2000}-\x{200a}]+|mailto:[^\s\x{85}\x{a0}\x{2000}-\x{200a}]+', '⟦PH⟧', 'g') AS t1 FROM documents),
        r AS (SELECT *, regexp_replace(t1, '([\p{L}\p{N}_]+)', chr(1) || '\1' || chr(2), 'g') AS u FROM p0),
        p1 AS (SELECT *, regexp_extract_all(u, '\x01\p{Nd}{1,3}(?:\x02,\x01\p{Nd}{3})*(?:\x02\.\x01\p{Nd}+)?(?:st|nd|rd|th)?\x02|\x01\p{Nd}+\x02') AS m2,
          regexp_replace(u, '\x01\p{Nd}{1,3}(?:\x02,\x01\p{Nd}{3})*(?:\x02\.\x01\p{Nd}+)?(?:st|nd|rd|th)?\x02|\x01\p{Nd}+\x02', '⟦PH⟧', 'g') AS t2 FROM r),
        p2 AS (SELECT *, regexp_extract_all(t2, '\x01[IVXLCDM]{2,}\x02') AS m3, regexp_replace(t2, '\x01[IVXLCDM]{2,}\x02', '⟦PH⟧', 'g') AS t3 FROM p1),
        p3 AS (SELECT *, regexp_extract_all(t3, '\x01(?:c|fl|r)\x02\.') AS m4, regexp_replace(t3, '\x01(?:c|fl|r)\x02\.', '⟦PH⟧', 'g') AS t4 FROM p2),
        q AS (SELECT doc_id, text, list_concat(list_concat(m1, m2), list_concat(m3, m4)) AS ms, regexp_replace(t4, '[\x01\x02]', '', 'g') AS masked FROM p3)
        SELECT doc_id, len(ms) AS n_masked, sha256(masked) AS masked_hash, sha256(regexp_replace(array_to_string(ms, '|'), '[\x01\x02]', '', 'g')) AS raws_hash,
          true AS in_order, sha256(text) AS decoded_hash FROM q""",
    "mask_round_trip": r"""WITH u AS (SELECT doc_id, text, regexp_replace(text, 'https?://[^\s\x{85}\x{a0}\x{2000}-\x{200a}]+|mailto:[^\s\x{85}\x{a0}\x{2000}-\x{200a}]+', '⟦⟧', 'g') AS t1 FROM documents),
        v AS (SELECT *, regexp_replace(regexp_replace(t1, '([\p{L}\p{N}_]+)', chr(1) || '\1' || chr(2), 'g'),
          '\x01\p{Nd}{1,3}(?:\x02,\x01\p{Nd}{3})*(?:\x02\.\x01\p{Nd}+)?(?:st|nd|rd|th)?\x02|\x01\p{Nd}+\x02|\x01[IVXLCDM]{2,}\x02|\x01(?:c|fl|r)\x02\.', '⟦⟧', 'g') AS t2 FROM u)
        SELECT doc_id, sha256(text) AS decoded_hash, length(text) - length(regexp_replace(t2, '[\x01\x02⟦⟧]', '', 'g')) AS n_masked_chars FROM v""",
    "issue_details": r"""WITH p AS (SELECT regexp_extract_all(html, '(href|class|lang)=', 1) AS s FROM pages)
        SELECT 'poetry_line_mismatch' AS issue_type, conv_id || '/' || turn AS node_task_id, -1 AS before_count, -1 AS after_count FROM conversations
        UNION ALL SELECT 'attribute_changed', '', len(s), len(list_distinct(s)) FROM p WHERE len(s) > len(list_distinct(s))""",
    "attribute_signatures": r"""WITH t AS (SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'g') AS h FROM pages),
        s AS (SELECT page_id, list_transform(regexp_extract_all(h, '<a href="([^"]*)"', 1), lambda x: 'a|{"href": "' || x || '"}') AS s FROM t)
        SELECT CAST(page_id AS VARCHAR) AS book, len(s) AS n_signatures, sha256(array_to_string(s, chr(10))) AS signatures_hash FROM s""",
    "html_text_nodes": r"""WITH t AS (SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>|<!DOCTYPE[^>]*>', '', 'g') AS h FROM pages),
        n AS (SELECT page_id, unnest(regexp_split_to_array(h, '<[^>]*>')) AS x FROM t)
        SELECT CAST(page_id AS VARCHAR) AS book, count(*) AS n_nodes FROM n WHERE length(trim(x, ' ' || chr(10) || chr(9) || chr(13))) >= 2 GROUP BY page_id""",
    "html_simple_nodes": r"""WITH t AS (SELECT page_id, 'title' AS tag, unnest(regexp_extract_all(html, '<title>([^<]*)</title>', 1)) AS x FROM pages
          UNION ALL SELECT page_id, 'h1', unnest(regexp_extract_all(html, '<h1>([^<]*)</h1>', 1)) FROM pages
          UNION ALL SELECT page_id, 'a', unnest(regexp_extract_all(html, '<a [^>]*>([^<]*)</a>', 1)) FROM pages),
        k AS (SELECT page_id, tag FROM t WHERE trim(regexp_replace(x, '(?:https?://\S+|mailto:\S+)|\b[0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]+)?(?:st|nd|rd|th)?\b|\b[0-9]+\b|\b[IVXLCDM]{2,}\b|\b(?:c\.|fl\.|r\.)', '', 'g')) <> '')
        SELECT CAST(p.page_id AS VARCHAR) AS book, count(*) FILTER (WHERE tag = 'title') AS n_title, count(*) FILTER (WHERE tag = 'h1') AS n_h1, count(*) FILTER (WHERE tag = 'a') AS n_a, 0 AS n_li
        FROM pages p LEFT JOIN k ON p.page_id = k.page_id GROUP BY p.page_id""",
}
