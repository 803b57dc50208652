"""SQL for DuckDB that gives the rows of the core's queries."""

from __future__ import annotations

from lectern.config import (
    ACCEPTED,
    CHUNK_CAP,
    CHUNK_LEAST,
    CHUNK_TRACES,
    DANGLING,
    EVALUATION_STOPWORDS,
    FILE_TRACES,
    FOOTER_MARKERS,
    JUMP_PHRASE,
    LINK_LINE,
    NAVIGATION_PHRASE,
    NEAR_DUPLICATE,
    REQUIRED_COLUMNS,
    SEARCH_LABELS,
    SEARCH_STOPWORDS,
    SENTENCE_ENDS,
    SHORT_FILE,
    START_MARKERS,
    Settings,
)
from lectern.operators.corpus import CHUNK_COLUMNS

SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _in(words) -> str:
    return ", ".join(map(_q, words))


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{SPACE}+', ''), '{SPACE}+$', '')"


def _blank(x: str) -> str:
    return f"coalesce({_strip(x)} = '', true)"


def _lf(x: str) -> str:
    return f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"


def _norm_url(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(lower({_strip(x)}), '^https?://', ''), '(index)?(\.php|\.html)?/?$', ''), '/+$', '')"


def _lines(x: str) -> str:
    parts = rf"regexp_split_to_array({x}, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]')"
    return f"list_filter({parts}, lambda l, i: i < len({parts}) OR l <> '')"


CHUNKS = "chunks_ AS (SELECT * FROM chunks WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC) = 1)"
PAGES = "pages_ AS (SELECT * FROM raw_pages WHERE page_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY loaded_at DESC) = 1)"
QUESTIONS = "questions_ AS (SELECT question_id, min(question) AS question FROM questions WHERE question_id IS NOT NULL GROUP BY question_id)"
TF = f"""docs_ AS (SELECT doc_id, coalesce(title, '') AS title, source_url, coalesce(text, '') AS text FROM documents),
words_ AS (SELECT doc_id, unnest(regexp_extract_all(lower(title || ' ' || text), '[a-z0-9]+')) AS term FROM docs_),
tf_ AS (SELECT doc_id, term, count(*) AS tf FROM words_ WHERE term NOT IN ({_in(SEARCH_STOPWORDS)}) GROUP BY doc_id, term),
df_ AS (SELECT term, count(*) AS df FROM tf_ GROUP BY term)"""
HITS = f"""{TF}, {QUESTIONS},
asked_ AS (SELECT DISTINCT question_id, unnest(regexp_extract_all(lower(coalesce(question, '')), '[a-z0-9]+')) AS term FROM questions_),
scored_ AS (SELECT question_id, doc_id, sum(ln((SELECT count(*) FROM documents)::DOUBLE / df) * (1 + 0.1 * (tf - 1))) AS s FROM asked_ JOIN tf_ USING (term) JOIN df_ USING (term) GROUP BY question_id, doc_id),
ranked_ AS (SELECT question_id, doc_id, round(s, 6) AS score, CAST(row_number() OVER (PARTITION BY question_id ORDER BY round(s, 6) DESC, doc_id) AS INTEGER) AS rank FROM scored_ WHERE s > 0)"""


def _rule(pattern: str) -> str:
    bare = pattern.replace("(?Ud)", "").replace("(?U)", "")
    return f"regexp_matches(lower({_strip("coalesce(question, '')")}), '{bare}')"


def _passages(settings: Settings, rules: dict[str, str]) -> str:
    routed = " OR ".join(map(_rule, rules.values()))
    return f"""{HITS}, routed_ AS (SELECT question_id, question, ({routed}) AS routed FROM questions_),
kept_ AS (SELECT r.question_id, rank, doc_id, score, max(score) OVER (PARTITION BY r.question_id) AS best FROM ranked_ r JOIN routed_ USING (question_id) WHERE rank <= {settings.top_k} AND NOT routed),
passages_ AS (SELECT question_id, rank, doc_id, title, source_url, text FROM kept_ JOIN docs_ USING (doc_id) WHERE score >= greatest({settings.support_threshold}, best * {settings.support_ratio})),
first_ AS (SELECT * FROM passages_ QUALIFY row_number() OVER (PARTITION BY question_id, source_url ORDER BY rank) = 1),
cited_ AS (SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY rank) AS INTEGER) AS rank, title, source_url AS url FROM first_)"""


def _clean(x: str) -> str:
    t = _lf(x)
    starts = ", ".join(f"nullif(strpos(t, {_q(m)}), 0)" for m in START_MARKERS)
    ends = ", ".join(f"nullif(strpos(substr(t, s + 1), {_q(m)}), 0) + s" for m in FOOTER_MARKERS)
    drop = " OR ".join(
        [
            f"contains(l, {_q(NAVIGATION_PHRASE)})",
            f"(starts_with(l, '[') AND contains(l, {_q(JUMP_PHRASE)}))",
            f"l IN ({_in(SEARCH_LABELS)})",
            "starts_with(l, '![')",
            rf"(regexp_matches(l, '^[-*+]{SPACE}*\[') AND contains(l, '](') AND length(l) < {LINK_LINE})",
            rf"regexp_matches(l, '^\p{{Nd}}+\.{SPACE}*\[')",
            rf"(regexp_matches(l, '^\[[^\]]+\]\([^)]+\)$') AND length(l) < {LINK_LINE})",
            rf"regexp_matches(l, '^https?://[^\t-\r\x1c-\x20\x{{85}}\p{{Z}}]+$')",
        ]
    )
    flat = r"replace(regexp_replace(l, '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '`', '')"
    bare = f"regexp_replace({_strip(f"regexp_replace(regexp_replace({flat}, '^#+', ''), '#+$', '')")}, '^-+$', '')"
    plain = _strip(f"regexp_replace({bare}, '{SPACE}+', ' ', 'g')")
    return f"""lf_ AS (SELECT page_id, {t} AS t FROM pages_),
start_ AS (SELECT page_id, t, coalesce({starts}, 1) AS s FROM lf_),
seg_ AS (SELECT page_id, substr(t, s, least({ends}, length(t) + 1) - s) AS seg FROM start_),
lines_ AS (SELECT page_id, list_transform({_lines("seg")}, lambda l: {_strip("l")}) AS ls FROM seg_),
kept_ AS (SELECT page_id, list_filter(list_transform(ls, lambda l: CASE WHEN l = '' THEN l WHEN {drop} THEN NULL ELSE nullif({plain}, '') END), lambda l: l IS NOT NULL) AS ls FROM lines_)
SELECT page_id, {_strip(f"regexp_replace(array_to_string(ls, chr(10)), '{chr(92)}n{{3,}}', chr(10) || chr(10), 'g')")} AS clean_text FROM kept_"""


def _sentences() -> str:
    norm = _strip(rf"regexp_replace(regexp_replace({_lf('text')}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")
    marked = rf"regexp_replace(t, '([.!?]){SPACE}+([A-Z(])', '\1' || chr(1) || '\2', 'g')"
    return f"""norm_ AS (SELECT doc_id, {norm} AS t FROM documents WHERE text IS NOT NULL),
parts_ AS (SELECT doc_id, list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {_strip("s")}), lambda s: s <> '') AS p FROM norm_)
SELECT doc_id, CAST(unnest(range(len(p))) AS INTEGER) AS at, unnest(p) AS sentence FROM parts_"""


def _vectors() -> str:
    return f"""{CHUNKS}, n_ AS (SELECT count(*) AS n FROM chunks_),
words_ AS (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM chunks_),
tf_ AS (SELECT chunk_id, term, count(*) AS tf FROM words_ WHERE term NOT IN ({_in(EVALUATION_STOPWORDS)}) GROUP BY chunk_id, term),
df_ AS (SELECT term, count(*) AS df FROM tf_ GROUP BY term),
idf_ AS (SELECT term, df, ln((n + 1)::DOUBLE / (df + 1)) + 1 AS idf FROM df_, n_),
raw_ AS (SELECT chunk_id, term, (1 + ln(tf)) * idf AS w FROM tf_ JOIN idf_ USING (term)),
vec_ AS (SELECT chunk_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY chunk_id)) AS w FROM raw_)"""


def _top1() -> str:
    return f"""{_vectors()},
qwords_ AS (SELECT case_id, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) AS term FROM eval_cases),
qtf_ AS (SELECT case_id, term, count(*) AS tf FROM qwords_ WHERE term NOT IN ({_in(EVALUATION_STOPWORDS)}) GROUP BY case_id, term),
qraw_ AS (SELECT case_id, term, (1 + ln(tf)) * coalesce(idf, ln((n + 1)::DOUBLE) + 1) AS w FROM qtf_ CROSS JOIN n_ LEFT JOIN idf_ USING (term)),
qvec_ AS (SELECT case_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY case_id)) AS w FROM qraw_),
dots_ AS (SELECT case_id, chunk_id, round(sum(q.w * v.w), 6) AS score FROM qvec_ q JOIN vec_ v USING (term) GROUP BY case_id, chunk_id),
top_ AS (SELECT case_id, chunk_id, score FROM dots_ WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY score DESC, chunk_id) = 1)"""


def _verdicts() -> str:
    return f"""{_top1()},
named_ AS (SELECT case_id, {_strip("lower(source_id)")} AS source_id, score FROM top_ JOIN chunks_ USING (chunk_id)),
judged_ AS (SELECT c.case_id, source_id AS top_source, coalesce(score, 0) AS score,
  CASE WHEN escalate THEN coalesce(score, 0) < {ACCEPTED} ELSE coalesce(list_contains(expected, source_id), false) AND coalesce(score, 0) >= {ACCEPTED} END AS passed
  FROM eval_cases c LEFT JOIN named_ n USING (case_id))"""


def _pairs() -> str:
    return f"""{_vectors()}, bare_ AS (SELECT chunk_id, {_strip("text")} AS t FROM chunks_ WHERE text IS NOT NULL),
who_ AS (SELECT chunk_id AS id, min(chunk_id) OVER (PARTITION BY t) AS rep, count(*) OVER (PARTITION BY t) AS copies FROM bare_ WHERE t <> ''),
rv_ AS (SELECT chunk_id, term, w FROM vec_ WHERE chunk_id IN (SELECT rep FROM who_)),
pairs_ AS (SELECT a.chunk_id AS a, b.chunk_id AS b, round(sum(a.w * b.w), 6) AS score FROM rv_ a JOIN rv_ b ON a.term = b.term AND a.chunk_id < b.chunk_id GROUP BY 1, 2 HAVING round(sum(a.w * b.w), 6) > {NEAR_DUPLICATE})"""


def oracle_sql(settings: Settings, rules: dict[str, str]) -> dict[str, str]:
    say = settings.messages
    passages = _passages(settings, rules)
    issues = (
        f"list_filter([CASE WHEN len(found) > 0 THEN 'boilerplate: ' || array_to_string(found, ', ') END, CASE WHEN length(t) < {SHORT_FILE} THEN 'short' END, "
        f"CASE WHEN t <> '' AND right(t, 1) NOT IN ({_in(SENTENCE_ENDS)}) THEN 'ends oddly' END, "
        rf"CASE WHEN regexp_matches(t, '(^|[^\p{{L}}\p{{N}}_])({'|'.join(DANGLING)})$') THEN 'dangling word' END], lambda x: x IS NOT NULL)"
    )
    gate = f"""{PAGES}, bare_ AS (SELECT page_id, {_strip("coalesce(text, '')")} AS t FROM pages_),
found_ AS (SELECT page_id, t, list_filter([{_in(FILE_TRACES)}], lambda x: contains(t, x)) AS found FROM bare_),
gated_ AS (SELECT page_id, CAST(length(t) AS INTEGER) AS n_chars, {issues} AS i FROM found_),
out_ AS (SELECT page_id, n_chars, array_to_string(i, '; ') AS issues, len(i) = 0 AS ok FROM gated_)"""
    leaks = " UNION ALL ".join(f"SELECT {_q(t)} AS trace, count(*) FILTER (contains(text, {_q(t)})) AS rows FROM chunks_" for t in CHUNK_TRACES)
    missing = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({_blank(c)}) AS missing FROM chunks_" for c in REQUIRED_COLUMNS)
    dups = f"SELECT md5({_strip('text')}) AS text_hash, count(*) AS copies FROM chunks_ WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1"
    bad = "NOT coalesce(starts_with(source_url, 'https://'), false)"
    counts = {
        "rows": "count(*)", "empty": f"count(*) FILTER ({_blank('text')})", "missing_cells": "CAST(coalesce(sum(" + " + ".join(f"CAST({_blank(c)} AS INTEGER)" for c in REQUIRED_COLUMNS) + "), 0) AS BIGINT)",
        "bad_urls": f"count(*) FILTER ({bad})", "sources": "count(DISTINCT source_id)", "over_cap": f"count(*) FILTER (char_count > {CHUNK_CAP})", "thin": f"count(*) FILTER (char_count < {CHUNK_LEAST})",
    } | {f"leak {t}": f"count(*) FILTER (contains(text, {_q(t)}))" for t in CHUNK_TRACES}
    report = " UNION ALL ".join(f"SELECT {_q(k)} AS \"check\", {v} AS value FROM chunks_" for k, v in counts.items())
    entries = f"""listed_ AS (SELECT {_norm_url("url")} AS key, max(file) AS file FROM source_manifest WHERE file IS NOT NULL GROUP BY 1)"""
    urls = rf"list_filter(list_transform(list_slice({_lines('text')}, 1, 6), lambda l: regexp_extract(l, 'https?://[^\t-\r\x1c-\x20\x{{85}}\p{{Z}})]+')), lambda u: u <> '')"
    first = f"coalesce(list_extract({urls}, 1), '')"
    lab = lambda c: rf"regexp_replace(lower({_strip(c)}), '[\t-\r\x20_\-]+', ' ', 'g')"
    fields = ("scope", "change_frequency", "content_version")
    diffs = " UNION ALL ".join(
        ["SELECT n, 'source_id' AS field, CASE WHEN a IS NOT NULL THEN 'yes' END AS registry, CASE WHEN b IS NOT NULL THEN 'yes' END AS manifest FROM both_ WHERE a IS NULL OR b IS NULL"]
        + [f"SELECT n, '{f}', a_{f}, b_{f} FROM both_ WHERE a IS NOT NULL AND b IS NOT NULL AND a_{f} IS DISTINCT FROM b_{f}" for f in fields]
    )
    registry = f"""WITH a_ AS (SELECT TRY_CAST(id AS BIGINT) AS n, 1 AS a, {", ".join(f"min({lab(f)}) AS a_{f}" for f in fields)} FROM approved_sources WHERE id IS NOT NULL GROUP BY 1),
b_ AS (SELECT TRY_CAST(regexp_extract(source_id, '([0-9]+)[^0-9]*$', 1) AS BIGINT) AS n, 1 AS b, {", ".join(f"min({lab(f)}) AS b_{f}" for f in fields)} FROM source_manifest WHERE source_id IS NOT NULL GROUP BY 1),
both_ AS (SELECT * FROM a_ FULL JOIN b_ USING (n) WHERE n IS NOT NULL)
SELECT 'src' || lpad(CAST(n AS VARCHAR), 6, '0') AS source_id, field, registry, manifest FROM ({diffs})"""
    return {
        "tokens_of": f"WITH {TF} SELECT doc_id, array_to_string(list_filter(regexp_extract_all(lower(title || ' ' || text), '[a-z0-9]+'), lambda t: t NOT IN ({_in(SEARCH_STOPWORDS)})), ' ') AS tokens FROM docs_",
        "term_freq": f"WITH {TF} SELECT doc_id, term, tf FROM tf_",
        "doc_freq": f"WITH {TF} SELECT term, df FROM df_",
        "idf": f"WITH {TF} SELECT term, df, round(ln((SELECT count(*) FROM documents)::DOUBLE / df), 6) AS idf FROM df_",
        "search_topk": f"WITH {HITS} SELECT question_id, rank, doc_id, score FROM ranked_ WHERE rank <= {settings.top_k}",
        "search_top1": f"WITH {HITS} SELECT question_id, doc_id, score FROM ranked_ WHERE rank = 1",
        "best_score": f"WITH {HITS} SELECT question_id, max(score) AS best FROM ranked_ GROUP BY question_id",
        "support_gate": f"""WITH {HITS}, top_ AS (SELECT *, max(score) OVER (PARTITION BY question_id) AS best FROM ranked_ WHERE rank <= {settings.top_k})
SELECT question_id, rank, doc_id, score, best FROM top_ WHERE score >= greatest({settings.support_threshold}, best * {settings.support_ratio})""",
        "route_rule_hits": f"WITH {QUESTIONS} SELECT question_id, {', '.join(f'{_rule(p)} AS {k}' for k, p in rules.items())} FROM questions_",
        "route_escalation": f"WITH {QUESTIONS} SELECT question_id, ({' OR '.join(map(_rule, rules.values()))}) AS escalate FROM questions_",
        "rejected_questions": f"WITH {QUESTIONS} SELECT question_id FROM questions_ WHERE coalesce(question, '') = ''",
        "answer_pipeline": f"""WITH {passages},
src_ AS (SELECT question_id, string_agg(concat_ws('|', title, url), chr(10) ORDER BY rank) AS sources FROM cited_ GROUP BY question_id)
SELECT q.question_id,
  CASE WHEN routed THEN {_q(say.escalated)} WHEN p.question_id IS NOT NULL THEN {_q(say.extract)} || {_strip("p.text")} ELSE {_q(say.unsupported)} END AS answer,
  coalesce(sources, '') AS sources,
  CASE WHEN routed THEN 'escalated' WHEN p.question_id IS NOT NULL THEN 'supported' ELSE 'unsupported' END AS support_status,
  CASE WHEN p.question_id IS NULL THEN {_q(say.escalation)} END AS escalation,
  CASE WHEN p.question_id IS NULL THEN 'policy' ELSE {_q(settings.generator)} END AS model
FROM routed_ q LEFT JOIN (SELECT * FROM passages_ QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY rank) = 1) p USING (question_id) LEFT JOIN src_ USING (question_id) WHERE question <> ''""",
        "citations": f"WITH {passages} SELECT question_id, rank, title, url FROM cited_",
        "prompt_context": f"""WITH {passages} SELECT question_id, md5(string_agg('[' || title || ' — ' || coalesce(source_url, '') || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank)) AS context_md5 FROM passages_ GROUP BY question_id""",
        "health": f"SELECT count(*) AS documents, {_q(settings.generator)} AS backend FROM documents",
        "norm_urls": f"SELECT DISTINCT url, {_norm_url('url')} AS key FROM source_manifest",
        "first_urls": f"WITH {PAGES} SELECT page_id, {first} AS first_url FROM pages_",
        "capture_match": f"WITH {PAGES}, {entries}, keyed_ AS (SELECT page_id, {_norm_url(f'coalesce(url, {first})')} AS key FROM pages_) SELECT page_id, file FROM keyed_ JOIN listed_ USING (key) WHERE key <> ''",
        "capture_argmax": f"WITH {PAGES} SELECT file, page_id, CAST(length(text) AS INTEGER) AS n_chars FROM pages_ WHERE file IS NOT NULL AND text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file ORDER BY length(text) DESC, page_id) = 1",
        "clean_page": f"WITH {PAGES}, {_clean('text')}",
        "sentence_counts": f"WITH {_sentences()}",
        "chunk_sizes": f"WITH {CHUNKS} SELECT chunk_id, CAST(length(text) AS INTEGER) AS chars, CAST(round_even(length(text) / 4.0, 0) AS INTEGER) AS estimate FROM chunks_",
        "chunk_ids": f"WITH {CHUNKS} SELECT chunk_id AS old_id, 'c' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS chunk_id FROM (SELECT chunk_id, row_number() OVER (ORDER BY chunk_id) AS n FROM chunks_)",
        "chunk_file": f"WITH {CHUNKS} SELECT " + ", ".join(c if c in ("char_count", "token_estimate_approx") else f"coalesce({c}, '') AS {c}" for c in CHUNK_COLUMNS) + " FROM chunks_",
        "corpus_projection": f"WITH {CHUNKS} SELECT chunk_id AS id, source_title AS title, source_url, text, date_accessed AS retrieved, source_id, scope, topic, content_version, change_frequency FROM chunks_",
        "build_summary": f"WITH {CHUNKS} SELECT count(*) AS rows, count(DISTINCT source_id) AS sources FROM chunks_",
        "size_stats": f"""WITH {CHUNKS} SELECT min(char_count) AS min_chars, CAST(trunc(median(char_count)) AS INTEGER) AS median_chars, CAST(trunc(avg(char_count)) AS INTEGER) AS mean_chars, max(char_count) AS max_chars,
count(*) FILTER (char_count > {CHUNK_CAP}) AS over_cap, count(*) FILTER (char_count < {CHUNK_LEAST}) AS thin FROM chunks_""",
        "empty_chunks": f"WITH {CHUNKS} SELECT chunk_id FROM chunks_ WHERE {_blank('text')}",
        "dup_texts": f"WITH {CHUNKS} {dups}",
        "missing_cells": f"WITH {CHUNKS} {missing}",
        "bad_urls": f"WITH {CHUNKS} SELECT chunk_id, source_url FROM chunks_ WHERE {bad}",
        "leak_counts": f"WITH {CHUNKS} SELECT * FROM ({leaks}) WHERE rows > 0",
        "dataset_gate": f"WITH {CHUNKS}, dups_ AS ({dups}) {report} UNION ALL SELECT 'duplicate_texts', count(*) FROM dups_",
        "text_gate": f"WITH {gate} SELECT page_id, n_chars, issues, ok FROM out_",
        "text_gate_summary": f"WITH {gate} SELECT count(*) AS files, count(*) FILTER (NOT ok) AS flagged, count(*) FILTER (ok) AS clean FROM out_",
        "manifest_missing": "SELECT DISTINCT file FROM source_manifest WHERE file IS NOT NULL AND file NOT IN (SELECT file FROM raw_pages WHERE file IS NOT NULL)",
        "manifest_orphans": "SELECT DISTINCT file FROM raw_pages WHERE file IS NOT NULL AND file NOT IN (SELECT file FROM source_manifest WHERE file IS NOT NULL)",
        "registry_differences": registry,
        "eval_idf": f"WITH {_vectors()} SELECT term, df, round(idf, 6) AS idf FROM idf_",
        "cosine_top1": f"WITH {_top1()} SELECT case_id, chunk_id, score FROM top_",
        "eval_verdicts": f"WITH {_verdicts()} SELECT case_id, top_source, score, passed FROM judged_",
        "eval_passed": f"WITH {_verdicts()} SELECT count(*) FILTER (passed) AS passed, count(*) AS cases FROM judged_",
        "near_duplicates": f"WITH {_pairs()} SELECT a, b, score FROM pairs_",
        "first_near_duplicates": f"WITH {_pairs()} SELECT a, b, score FROM pairs_ ORDER BY a, b LIMIT 8",
        "near_duplicate_links": f"""WITH {_pairs()}, ends_ AS (SELECT a AS rep FROM pairs_ UNION ALL SELECT b FROM pairs_), n_links_ AS (SELECT rep, count(*) AS links FROM ends_ GROUP BY rep)
SELECT id, rep, copies, coalesce(links, 0) AS links FROM who_ LEFT JOIN n_links_ USING (rep)""",
    }
