"""SQL counterparts of the flows' queries."""

from __future__ import annotations

from quillspark import providers as P
from quillspark.functions import urls as U
from quillspark.operators import alerts as A
from quillspark.operators import report as R
from quillspark.operators import scan as S
from quillspark.plans import inputs

RSRC = """src AS (SELECT doc_id + 1 AS n, 'S' || (doc_id + 1) AS id, 'http://' || source || '.example.com/' || repeat('x', doc_id % 80) AS url, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'Title ' || doc_id END AS title,
 CASE WHEN doc_id % 4 <> 1 THEN ['lang ' || lang, source] ELSE [] END AS bullets, doc_id % 10 = 0 AS said, CASE WHEN doc_id % 2 = 0 THEN 'from ' || source END AS reliability, CASE WHEN doc_id % 7 > 0 THEN '2024-01-15' ELSE '—' END AS day, doc_id % 5 = 4 AS dup, source, doc_id FROM documents),
 al AS (SELECT *, coalesce(nullif(title, ''), url) AS name FROM src), sn AS (SELECT * FROM al WHERE NOT dup)"""
RESPONSES = """r AS (SELECT page_id, url, CASE WHEN page_id % 4 = 0 THEN url || '/new' ELSE url END AS final_url, CASE page_id % 11 WHEN 0 THEN 404 WHEN 1 THEN 503 WHEN 2 THEN 0 ELSE 200 END AS status,
 ['text/html; charset=utf-8', 'application/pdf', 'text/plain; x', 'application/xhtml+xml', 'image/png', '', 'TEXT/HTML'][page_id % 7 + 1] AS ct, html FROM pages),
 z AS (SELECT *, CASE WHEN status >= 400 THEN 'http_' || status WHEN page_id % 7 IN (0, 3) THEN 'html' WHEN page_id % 7 = 1 THEN 'pdf' WHEN page_id % 7 = 2 THEN 'text' ELSE 'binary' END AS kind FROM r)"""


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def lines(section: int, *rows: str) -> str:
    return " UNION ALL ".join(f"SELECT {section} AS section, 0 AS n, {k} AS k, {lit(x)} AS line" for k, x in enumerate(rows))


def listed(section: int, of: str, items: str) -> str:
    return f"SELECT {section}, n, generate_subscripts(x, 1) - 1, unnest(x) FROM (SELECT n, {items} AS x FROM {of})"


def oracle_sql() -> dict[str, str]:
    from quillspark.plans.oracle import RUN, USABLE, authority, classified, dedupe, found, normalized, part

    some = "list_transform(bullets, lambda b: '- ' || b)"
    report = " UNION ALL ".join([
        lines(0, "# Deep Research Report: tables", "", "*Generated on 2024-01-15 00:00 UTC | Run ID: `run_test`*", "", "---", ""),
        lines(10, "## Executive Summary", ""), lines(12, ""), lines(20, "## Key Findings", ""), lines(30, "## Deep Dive", ""), lines(33, ""),
        lines(40, "## Notable Quotes", ""), lines(50, "## Contradictions and Uncertainty", "", R.UNCERTAIN, "", R.GAPS, ""),
        lines(51, "- **3 source(s)** could not be retrieved or were inaccessible at the time of this run."),
        lines(52, "- **2 near-duplicate source(s)** were removed; they may contain additional nuance not captured here."), lines(53, ""),
        lines(60, "## What to Read Next", "", R.NEXT, ""), lines(70, "## Source Library", "", R.LIBRARY, "", "| ID | Title | URL | Retrieved |", "|----|-------|-----|-----------|"),
        lines(72, "", "---", "", R.CLOSING),
        f"SELECT 11, 0, 0, 'This report synthesizes findings on **tables** from ' || count(*) || ' sources spanning domains including ' || array_to_string(list_sort(list(DISTINCT source || '.example.com'))[1:5], ', ') || {lit('. ' + R.SECTIONS_BELOW)} FROM sn",
        listed(21, "(SELECT * FROM sn ORDER BY n LIMIT 8) WHERE len(bullets) > 0", f"list_concat(['### From [' || id || '] — ' || name], {some}, [''])"),
        listed(31, "sn WHERE len(bullets) > 0", f"list_concat(['### ' || name || ' [' || id || ']', '', 'Source reliability: *' || coalesce(reliability, {lit(R.NO_RELIABILITY)}) || '*', ''], {some}, [''])"),
        listed(41, "sn WHERE said", "['> \"said ' || doc_id || '\"', '>', '> — [' || id || ']: ' || name, '']"),
        listed(61, "(SELECT *, row_number() OVER (ORDER BY n) AS r FROM sn ORDER BY n LIMIT 5)", "list_concat([r || '. **[' || name || '](' || url || ')** [' || id || ']'], CASE WHEN reliability IS NOT NULL THEN ['   *' || reliability || '*'] ELSE [] END, [''])"),
        listed(71, "sn", "['| ' || id || ' | ' || left(coalesce(nullif(title, ''), '—'), 50) || ' | ' || left(url, 60) || CASE WHEN length(url) > 60 THEN '…' ELSE '' END || ' | ' || day || ' |']"),
    ])
    plain = lambda head, items: "SELECT n, k, line FROM (" + lines(0, *head) + ") UNION ALL SELECT n, k, line FROM (" + listed(0, "al WHERE NOT dup", items) + ") u(s, n, k, line)"
    lower_type = "lower(ct)"
    pdf = f"(contains({lower_type}, 'pdf') OR ends_with(lower(url), '.pdf'))"
    waits = "CASE WHEN least(page_id % 5, 2) >= 1 THEN 1.5 ELSE 0 END + CASE WHEN least(page_id % 5, 2) >= 2 THEN 2.25 ELSE 0 END"
    path, host = part("url", 3), authority("url")
    service = "CASE " + " ".join(f"WHEN contains(lower(alert_text), {lit(x)}) THEN {lit(x)}" for x in A.SERVICES) + " ELSE 'unknown-service' END"
    names = ", ".join(map(lit, A.SERVICES))
    escalates = f"severity = 'critical' OR {' OR '.join(f'contains(lower(alert_text), {lit(p)})' for p in A.ESCALATING)}"
    normal = f"nd AS (SELECT doc_id, {normalized('text')} AS text FROM documents WHERE doc_id % 17 <> 0 AND {USABLE})"
    return {
        "report_markdown": f"WITH {RSRC} SELECT CAST(section AS INTEGER) AS section, CAST(n AS BIGINT) AS n, CAST(k AS INTEGER) AS k, line FROM ({report})",
        "report_offline": f"WITH {RSRC} " + plain(["# Research Report: tables", "", R.OFFLINE, "", "## Sources", ""], "['- **[' || id || ']** ' || name]"),
        "report_fallback": f"WITH {RSRC} " + plain(["# Research Report: tables", "", R.FAILED, ""], "list_concat(['- **[' || id || ']** ' || name], list_transform(bullets, lambda b: '  - ' || b))"),
        "summary_brief": f"WITH {RSRC}, b AS (SELECT n, array_to_string(list_concat(['[' || id || '] ' || url], list_transform(bullets[1:3], lambda x: '  - ' || x)), chr(10)) AS t FROM src ORDER BY n LIMIT 10) SELECT string_agg(t, chr(10) || chr(10) ORDER BY n) AS brief FROM b",
        "page_kinds": f"WITH {RESPONSES} SELECT page_id, kind AS a1, CASE WHEN page_id % 13 = 0 THEN 'disallowed by robots.txt' WHEN status >= 400 OR status = 0 THEN 'HTTP ' || status WHEN contains({lower_type}, 'html') OR (NOT {pdf} AND ct = '') THEN 'html' WHEN {pdf} THEN 'pdf' ELSE 'unsupported content-type: ' || ct END AS a2 FROM z",
        "fetched_pages": f"WITH {RESPONSES} SELECT url, CASE WHEN status < 400 THEN nullif(final_url, url) END AS canonical_url, status, CASE WHEN status < 400 THEN CASE kind WHEN 'html' THEN 'text/html' WHEN 'pdf' THEN 'application/pdf' ELSE coalesce(nullif(trim(string_split(ct, ';')[1]), ''), CASE WHEN kind = 'binary' THEN 'unknown' END) END END AS content_type, CASE WHEN status >= 400 THEN kind END AS error, kind = 'pdf' AS pdf_text_unavailable, CASE WHEN kind = 'html' THEN length(html) END AS n_html, CASE WHEN kind = 'text' THEN length(html) END AS n_text FROM z",
        "retry_schedule": f"WITH q AS (SELECT {host} AS domain, page_id AS ord, page_id % 5 AS failures, {waits} AS w FROM pages), s AS (SELECT *, coalesce(sum(w + 1) OVER (PARTITION BY domain ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM q), t AS (SELECT *, CAST(unnest(range(0, least(failures, 2) + 1)) AS INTEGER) AS attempt FROM s) SELECT domain, ord, attempt, CAST(start + [0, 1.5, 3.75][attempt + 1] AS DOUBLE) AS at, attempt >= failures AS ok FROM t",
        "robots_longest": f"WITH ru AS (SELECT {host} AS h, false AS ok, left({path}, 3) AS x FROM pages WHERE page_id % 5 = 0 UNION SELECT {host}, true, {path} FROM pages WHERE page_id % 7 = 0), p AS (SELECT page_id, {host} AS h, (CASE WHEN {path} = '' THEN '/' ELSE {path} END) || CASE WHEN {part('url', 4)} <> '' THEN '?' || {part('url', 4)} ELSE '' END AS p FROM pages) SELECT page_id, coalesce((SELECT ok FROM ru WHERE ru.h = p.h AND x <> '' AND starts_with(p.p, x) ORDER BY length(x) DESC, ok DESC LIMIT 1), true) AS allowed FROM p",
        "fetch_ways": f"SELECT page_id, CASE WHEN regexp_matches(lower({path}), {lit(chr(92) + '.(' + '|'.join(U.BINARY_EXTENSIONS) + ')$')}) THEN 'binary' ELSE 'page' END AS way FROM pages",
        "source_projection": "SELECT 'S' || doc_id AS id, 'http://' || source AS url, CASE WHEN doc_id % 3 = 0 THEN 'http://c/' || source END AS canonical_url, CASE WHEN doc_id % 4 > 0 THEN nullif(lang, '') END AS title, 'text/html' AS content_type, CASE WHEN doc_id % 5 > 0 THEN 'someone' END AS author, CAST(NULL AS VARCHAR) AS published_at FROM documents",
        "source_projection_a2": "SELECT 'S' || doc_id AS id, 'http://' || source AS url, CASE WHEN doc_id % 2 > 0 THEN 'http://moved' END AS canonical_url, CASE WHEN doc_id % 4 > 0 THEN nullif(lang, '') END AS title, 'text/html' AS content_type, doc_id % 6 = 0 AS pdf_text_unavailable FROM documents",
        "kept_sources": f"WITH {RSRC} SELECT n, id, url FROM sn ORDER BY n LIMIT 20",
        "run_ids": "SELECT doc_id, '20240115_010203_' || left(sha256(CAST(doc_id AS VARCHAR)), 8) AS a1, 'run_' || left(sha256(CAST(doc_id AS VARCHAR)), 12) AS a2, CASE WHEN doc_id * 7 < 60 THEN doc_id * 7 || 's' ELSE (doc_id * 7) // 60 || 'm' || lpad(CAST((doc_id * 7) % 60 AS VARCHAR), 2, '0') || 's' END AS elapsed FROM documents",
        "history_last": "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 8",
        "key_quotes": "SELECT conv_id, turn, 0 AS k, 'q' || conv_id AS quote, CAST(turn AS INTEGER) AS start_offset, 0 AS end_offset FROM conversations UNION ALL SELECT conv_id, turn, 1, role, 0, 9 FROM conversations WHERE role <> ''",
        "concept_union": "SELECT doc_id, array_to_string(list_sort(list_distinct([lower(source), 'two ' || lower(lang)])), ';') AS concepts FROM documents",
        "judge_replies": "SELECT conv_id, turn, (conv_id + turn) % 3 <> 1 AS complete, CASE WHEN (conv_id + turn) % 3 = 0 THEN 'it is ' || role ELSE '' END AS answer FROM conversations",
        "enrich_offline": f"SELECT doc_id, source AS title, CASE WHEN doc_id % 3 > 0 THEN 'One ' || lang || '.;Two ' || source || '!' ELSE {lit(P.UNAVAILABLE['a2'])} END AS bullets, CASE WHEN doc_id % 3 > 0 THEN '' ELSE {lit(P.UNRATED['a2'])} END AS notes FROM documents",
        "outage_flow": f"WITH {classified()}, v AS (SELECT *, CASE event_id % 4 WHEN 0 THEN floor(confidence * 1000) / 1000 WHEN 1 THEN NULL WHEN 2 THEN 0 ELSE 0.9 END AS cf FROM c WHERE alert_text <> '  ') SELECT event_id, 'Issue detected in ' || service || ' with severity ' || severity || '.' AS summary, strftime(ts, 'inc-%Y-%m-%d-%H%M') AS incident_id, CASE event_id % 4 WHEN 0 THEN 'disk' WHEN 2 THEN 'malformed reply' ELSE 'Unknown' END AS root_cause, round(CAST(coalesce(cf, 0) AS DOUBLE), 6) AS confidence, {escalates} OR coalesce(cf, 0) < 0.6 AS should_escalate, event_id % 4 <> 0 AS needs_external, 'No critical errors for ' || service || ' before alert.' AS recent_logs FROM v",
        "external_knowledge": f"WITH {classified()}, t AS (SELECT doc_id AS ord, concat_ws(' ', lang, source, [{names}][doc_id % {len(A.SERVICES)} + 1]) AS title FROM documents), h AS (SELECT s.service, ord, title, row_number() OVER (PARTITION BY s.service ORDER BY ord) AS r FROM (SELECT DISTINCT service FROM c) s JOIN t ON contains(lower(title), s.service)), k AS (SELECT service, string_agg(title, chr(10) ORDER BY ord) AS knowledge FROM h WHERE r <= 3 GROUP BY service) SELECT event_id, service, knowledge FROM c LEFT JOIN k USING (service)",
        "findings_fold": f"WITH {found()} SELECT (SELECT count(*) FROM sf) AS files_scanned, count(*) AS findings, md5(coalesce(string_agg(id, ',' ORDER BY file, i), '')) AS ids_md5 FROM fs",
        "triage_unread": f"WITH {found()} SELECT id, CAST(0 AS BIGINT) AS rejected, {lit(S.UNREAD)} AS reason FROM fs",
        "scan_and_patch": f"WITH {found()}, g AS (SELECT * FROM fs WHERE severity IN ('critical', 'high')) SELECT (SELECT count(*) FROM sf) AS total_files_scanned, (SELECT count(*) FROM fs) AS total_vulns_detected, count(*) AS confirmed_vulns, CAST(0 AS BIGINT) AS false_positives_rejected, count(*) AS patches_generated, md5(coalesce(string_agg(id, ',' ORDER BY id), '')) AS ids_md5 FROM g",
        "research_offline": dedupe(0.85, "nd", normal + ", ").replace("SELECT d.doc_id, f.duplicate_of FROM nd d LEFT JOIN f USING (doc_id)", "SELECT count(*) AS fetched, count(*) - count(f.duplicate_of) AS kept, count(f.duplicate_of) AS duplicates, (SELECT count(*) FROM documents WHERE doc_id % 17 = 0) AS failures FROM nd d LEFT JOIN f USING (doc_id)"),
        "robots_groups": f"WITH h AS (SELECT DISTINCT {host} AS host FROM pages) SELECT host, unnest(['a', 'b']) AS agent, false AS allow, '/p' AS prefix FROM h UNION ALL SELECT host, unnest(['a', 'b']), true, '/p/' || host FROM h UNION ALL SELECT host, '*', false, '/q' FROM h",
        "crawl_columns": f"WITH {RESPONSES} SELECT url, final_url, '' AS title, '' AS text, CAST(NULL AS VARCHAR) AS html, ct AS content_type, false AS pdf_text_unavailable, CAST(NULL AS VARCHAR) AS error, 0 AS depth FROM z",
    }
