"""SQL that gives the same rows as some queries of this subpackage, for DuckDB."""

from __future__ import annotations

from lectern.llm.cutoff import MIN_AT_LIMIT, SIGMAS

_SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"

# A chunk whose rows disagree counts under the least of its keys; in the tables its rows differ in nothing that makes a key.
P1_CHUNK_COUNTS = rf"""
WITH rows_ AS (
  SELECT chunk_id, lower(regexp_replace(regexp_replace(source_id, '^{_SPACE}+', ''), '{_SPACE}+$', '')) AS source, nullif(lower(regexp_extract(lang, '^{_SPACE}*([A-Za-z]+)', 1)), '') AS language,
    regexp_replace(lower(regexp_replace(regexp_replace(scope, '^{_SPACE}+', ''), '{_SPACE}+$', '')), '[\t-\r\x20_\-]+', ' ', 'g') AS domain, md5(coalesce(text, '')) AS h FROM chunks
), once_ AS (SELECT min(source) AS source, min(language) AS language, min(domain) AS domain FROM rows_ GROUP BY coalesce(chunk_id, chr(1) || concat_ws(chr(2), coalesce(source, chr(3)), coalesce(language, chr(3)), coalesce(domain, chr(3)), h))),
levels_ AS (
  SELECT 'all' AS level, NULL AS source, NULL AS language, NULL AS domain FROM once_ UNION ALL SELECT 'source', source, NULL, NULL FROM once_
  UNION ALL SELECT 'language', NULL, language, NULL FROM once_ UNION ALL SELECT 'domain', NULL, NULL, domain FROM once_ UNION ALL SELECT 'slice', source, language, domain FROM once_
) SELECT level, source, language, domain, count(*) AS n_chunks FROM levels_ GROUP BY ALL
"""

P2_FOUND = rf"""
WITH rows_ AS (
  SELECT DISTINCT chunk_id, lower(regexp_replace(regexp_replace(source_id, '^{_SPACE}+', ''), '{_SPACE}+$', '')) AS source, text
  FROM chunks WHERE chunk_id IS NOT NULL AND source_id IS NOT NULL AND text IS NOT NULL
), each_ AS (
  SELECT chunk_id, source, unnest(string_split(text, chr(10))) AS raw, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM rows_
), keyed AS (
  SELECT chunk_id, source, line_no, regexp_replace(replace(lower(raw), 'ß', 'ss'), '[\t-\r\x1c-\x20\x{{85}}\p{{Z}}\p{{Nd}}]+', '', 'g') AS line FROM each_
), known AS (
  SELECT source, line FROM keyed WHERE regexp_matches(line, '\p{{L}}') GROUP BY source, line HAVING count(DISTINCT chunk_id) >= 8
)
SELECT DISTINCT chunk_id, CAST(line_no AS INTEGER) AS line_no FROM keyed JOIN known USING (source, line)
"""

P2_CLEAN = f"""
WITH found_ AS ({P2_FOUND}), gone_ AS (SELECT chunk_id, list(line_no) AS n FROM found_ GROUP BY chunk_id),
kept_ AS (SELECT chunk_id, source_id, text, string_split(text, chr(10)) AS ls, coalesce(n, []) AS n FROM chunks LEFT JOIN gone_ USING (chunk_id))
SELECT chunk_id, source_id, text, array_to_string(list_filter(ls, lambda x, i: NOT list_contains(n, CAST(i AS INTEGER))), chr(10)) AS clean_text,
  CAST(len(list_filter(ls, lambda x, i: list_contains(n, CAST(i AS INTEGER)))) AS INTEGER) AS lines_removed FROM kept_
"""

# Lines are named by their least spelling without outer white space.
P2_LINES = rf"""
WITH rows_ AS (
  SELECT DISTINCT chunk_id, lower(regexp_replace(regexp_replace(source_id, '^{_SPACE}+', ''), '{_SPACE}+$', '')) AS source, text
  FROM chunks WHERE chunk_id IS NOT NULL AND source_id IS NOT NULL AND text IS NOT NULL
), each_ AS (SELECT chunk_id, source, unnest(string_split(text, chr(10))) AS raw FROM rows_),
keyed AS (SELECT *, regexp_replace(replace(lower(raw), 'ß', 'ss'), '[\t-\r\x1c-\x20\x{{85}}\p{{Z}}\p{{Nd}}]+', '', 'g') AS line FROM each_)
SELECT source, min(regexp_replace(regexp_replace(raw, '^{_SPACE}+', ''), '{_SPACE}+$', '')) AS line, count(DISTINCT chunk_id) AS chunks
FROM keyed k WHERE regexp_matches(k.line, '\p{{L}}') GROUP BY source, k.line HAVING count(DISTINCT chunk_id) >= 8
"""

_LONG = f"""
WITH bare_ AS (SELECT DISTINCT chunk_id, regexp_replace(regexp_replace(text, '^{_SPACE}+', ''), '{_SPACE}+$', '') AS t FROM chunks WHERE chunk_id IS NOT NULL),
long_ AS (SELECT chunk_id, t FROM bare_ WHERE length(t) > (SELECT max_size FROM size_limits WHERE limit_name = 'chunk_text'))
"""
P3_FOUND = f"{_LONG} SELECT DISTINCT chunk_id FROM long_"
P3_REJOINED = f"{_LONG} SELECT chunk_id, md5(t) AS text_md5, CAST(0 AS BIGINT) AS over_limit, 0 AS odd_overlaps FROM long_"

_OWNER = f"lower(regexp_replace(regexp_replace(source_id, '^{_SPACE}+', ''), '{_SPACE}+$', ''))"
P4_LIMITS = rf"""
WITH bare_ AS (
  SELECT file, regexp_replace(text, '\x{{FFFD}}+$', '') AS t FROM raw_pages WHERE page_id IS NOT NULL
), kept_ AS (
  SELECT file, t, length(t) AS cp, strlen(t) AS b, length(t) - length(replace(t, chr(10), '')) AS lf, (length(t) - length(replace(t, chr(13) || chr(10), ''))) // 2 AS crlf,
    length(t) - length(replace(t, chr(13), '')) AS cr, length(t) - length(replace(t, chr(9), '')) AS tab, length(t) - length(replace(t, '"', '')) AS quotes,
    length(t) - length(replace(t, '&', '')) AS amps, length(t) - length(replace(replace(t, '<', ''), '>', '')) AS angles, length(t) - length(replace(t, chr(92), '')) AS slashes,
    length(regexp_replace(t, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')) AS wide
  FROM bare_ WHERE regexp_replace(t, '{_SPACE}+', '', 'g') <> ''
), owner_ AS (SELECT file, min({_OWNER}) AS source FROM source_manifest WHERE file IS NOT NULL GROUP BY file),
sizes_ AS (
  SELECT source, unnest([
    {{'measure': 'code_points', 'size': cp}}, {{'measure': 'utf16_units', 'size': cp + wide}}, {{'measure': 'utf8_bytes', 'size': b}},
    {{'measure': 'code_points_crlf', 'size': cp + lf - crlf}}, {{'measure': 'code_points_lf', 'size': cp - crlf}},
    {{'measure': 'utf8_bytes_crlf', 'size': b + lf - crlf}}, {{'measure': 'utf8_bytes_lf', 'size': b - crlf}},
    {{'measure': 'entities', 'size': cp + 4 * amps + 3 * angles + 5 * quotes}}, {{'measure': 'json', 'size': cp + lf + cr + tab + quotes + slashes}}], recursive := true)
  FROM kept_ LEFT JOIN owner_ USING (file)
), total_ AS (SELECT source, count(*) AS n_captures FROM kept_ LEFT JOIN owner_ USING (file) GROUP BY source),
at_ AS (SELECT source, measure, size, count(*) AS n_at FROM sizes_ GROUP BY source, measure, size HAVING count(*) >= {MIN_AT_LIMIT}),
even_ AS (SELECT a.*, n_captures, n_captures / greatest(size, 1) * 2 AS even FROM at_ a JOIN total_ t ON a.source IS NOT DISTINCT FROM t.source)
SELECT source, measure, CAST(size AS INTEGER) AS size, n_at, n_captures FROM even_ WHERE n_at > even + {SIGMAS} * sqrt(even)
"""

P6_PLACED = """
SELECT limit_name, count(*) AS documents, count(*) FILTER (coalesce(text, '') = '') AS empty, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS wrong
FROM documents, (SELECT DISTINCT limit_name FROM size_limits WHERE suffix(limit_name, '_box')) WHERE doc_id IS NOT NULL GROUP BY limit_name
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_chunk_counts": P1_CHUNK_COUNTS, "p2_found": P2_FOUND, "p2_clean": P2_CLEAN, "p2_lines": P2_LINES, "p3_found": P3_FOUND, "p3_rejoined": P3_REJOINED, "p4_limits": P4_LIMITS, "p6_placed": P6_PLACED}
