"""SQL counterparts of the catalog's queries, built from the same fixed values."""

from __future__ import annotations

from quillspark.functions import html as H
from quillspark.functions import urls as U
from quillspark.functions.text import SPACE, WORD, boilerplate
from quillspark.operators import alerts as A
from quillspark.operators import scan as S
from quillspark.operators.suffixes import COMMON
from quillspark.plans import inputs


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rep(x: str, rx: str, by: str = "''") -> str:
    return f"regexp_replace({x}, {q(rx)}, {by}, 'g')"


def strip(x: str) -> str:
    return rep(x, f"^{SPACE}+|{SPACE}+$")


def collapse(x: str) -> str:
    return strip(rep(x, f"{SPACE}+", "' '"))


def normalized(x: str) -> str:
    x = collapse(x)
    for p in boilerplate():
        x = rep(x, p)
    return collapse(x)


def whitespace(x: str) -> str:
    return strip(rep(rep(f"replace({x}, chr(9), ' ')", " {2,}", "' '"), "\n{3,}", "chr(10) || chr(10)"))


def decode(x: str) -> str:
    for name, value in H.ENTITIES:
        x = f"replace({x}, {q(name)}, {q(value)})"
    return x


def meta(key: str, attribute: str = "property") -> str:
    k = key.replace(".", r"\.")
    one = f"""regexp_extract(html, {q(rf'(?is)<meta\b[^>]*\b{attribute}=["' + "'" + rf']{k}["' + "'" + r'][^>]*\bcontent=["' + "'" + r']([^"' + "'" + r']*)["' + "'" + r']')}, 1)"""
    two = f"""regexp_extract(html, {q(r'(?is)<meta\b[^>]*\bcontent=["' + "'" + r']([^"' + "'" + r']*)["' + "'" + rf'][^>]*\b{attribute}=["' + "'" + rf']{k}["' + "'" + r']')}, 1)"""
    return decode(f"(CASE WHEN {one} <> '' THEN {one} ELSE {two} END)")


def dropped(variant: str) -> str:
    x = rep("html", r"(?s)<!--.*?-->")
    for name in H.DROPPED[variant]:
        x = rep(x, H.element(name))
    return x


def page_text(variant: str) -> str:
    if variant == "a2":
        return whitespace(decode(rep(dropped("a2"), r"(?s)<[^>]*>", "chr(10)")))
    x = decode(rep(rep(dropped("a1"), r"(?is)<head\b[^>]*>.*?</head\s*>"), r"(?s)<[^>]*>", "chr(10)"))
    return strip(rep(rep(x, r"[ \t\r]*\n[ \t\r]*", "chr(10)"), r"\n{2,}", "chr(10)"))


SPLIT = q(U._SPLIT)


def part(url: str, i: int) -> str:
    return f"regexp_extract({url}, {SPLIT}, {i})"


def authority(url: str) -> str:
    return part(url, 2)


def origin(url: str) -> str:
    return f"lower({part(url, 1)}) || '://' || {authority(url)}"


def normal_url(url: str) -> str:
    bare = rep(url, "#.*$")
    return f"CASE WHEN ends_with({bare}, '/') AND {part(bare, 3)} <> '/' THEN left({bare}, length({bare}) - 1) ELSE {bare} END"


def host(url: str) -> str:
    return rep(rep(rep(f"lower({authority(url)})", "^.*@"), ":[0-9]*$"), r"\.$")


def registered(source: str) -> str:
    """(..., registered) of a source with url, as rd."""
    kind = lambda a, b, c: f"CASE WHEN starts_with(rule, '!') THEN {a} WHEN starts_with(rule, '*.') THEN {b} ELSE {c} END"
    return f"""ru AS (SELECT unnest([{', '.join(map(q, COMMON))}]) AS rule), rk AS (SELECT {kind('substr(rule, 2)', 'substr(rule, 3)', 'rule')} AS ending, {kind(-1, 1, 0)} AS more, starts_with(rule, '!') AS wins FROM ru),
sr AS (SELECT *, {host('url')} AS host FROM {source}), hl AS (SELECT DISTINCT host, string_split(host, '.') AS l FROM sr WHERE host <> '' AND NOT regexp_full_match(host, '[0-9.]+')),
he AS (SELECT host, len(l) AS labels, k, array_to_string(l[len(l) - k + 1:], '.') AS ending FROM (SELECT host, l, unnest(range(1, len(l) + 1)) AS k FROM hl)),
hm AS (SELECT host, any_value(labels) AS labels, max({{'w': wins, 'n': k + more}}).n AS n FROM he JOIN rk USING (ending) WHERE k + more <= labels GROUP BY host),
rd AS (SELECT sr.*, CASE WHEN n < labels THEN array_to_string(string_split(sr.host, '.')[labels - n:], '.') ELSE {authority('url')} END AS registered FROM sr LEFT JOIN hm USING (host))"""


HREF = q(r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']".replace('\\"', '"'))
HREFS = f"h AS (SELECT url, unnest(regexp_extract_all(html, {HREF}, 1)) AS raw, generate_subscripts(regexp_extract_all(html, {HREF}, 1), 1) - 1 AS pos FROM pages), l AS (SELECT url, pos, {decode('raw')} AS href FROM h)"
# the tables hold rooted and absolute links only; others would make the counterpart differ
LINK = f"CASE WHEN starts_with(href, '/') THEN {origin('url')} || {rep('href', '#.*$')} ELSE {rep('href', '#.*$')} END"
LINKS = f"{HREFS}, k AS (SELECT url, link, min(pos) AS pos FROM (SELECT url, pos, {LINK} AS link FROM l) WHERE starts_with(link, 'http://') OR starts_with(link, 'https://') GROUP BY url, link)"

TERMS = f"w AS (SELECT doc_id, regexp_extract_all(lower(text), {q(WORD)}) AS t FROM {{docs}}), tf AS (SELECT doc_id, term, count(*) AS n, count(*) / max(total) AS tf FROM (SELECT doc_id, len(t) AS total, unnest(t) AS term FROM w) GROUP BY doc_id, term)"
IDF = "idf AS (SELECT term, count(*) AS df, ln(1 + (SELECT count(*) FROM {docs}) / (1 + count(*))) AS idf FROM tf GROUP BY term)"
VECTORS = "x AS (SELECT doc_id, term, tf, tf * idf AS w FROM tf JOIN idf USING (term)), nm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM x GROUP BY doc_id), v AS (SELECT doc_id, term, tf, w / norm AS w FROM x JOIN nm USING (doc_id) WHERE norm > 0)"
CLASSES = "kk AS (SELECT doc_id, string_agg(term || ':' || round(tf, 12), ',' ORDER BY term) AS k FROM v GROUP BY doc_id), cl AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS rep FROM kk)"
PAIRS = "own AS (SELECT v.* FROM v JOIN cl USING (doc_id) WHERE doc_id = rep), pairs AS (SELECT a.doc_id AS i, b.doc_id AS j, sum(a.w * b.w) AS sim FROM own a JOIN own b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY 1, 2 HAVING sum(a.w * b.w) >= {t})"
GREEDY = """
nodes AS (SELECT id, row_number() OVER (ORDER BY id) AS k, coalesce((SELECT list(i) FROM pairs WHERE j = id), []) AS smaller FROM (SELECT i AS id FROM pairs UNION SELECT j FROM pairs)),
g AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept UNION ALL SELECT g.k + 1, CASE WHEN list_has_any(g.kept, n.smaller) THEN g.kept ELSE list_append(g.kept, n.id) END FROM g JOIN nodes n ON n.k = g.k + 1),
kept AS (SELECT unnest(kept) AS id FROM (SELECT kept FROM g ORDER BY k DESC LIMIT 1)),
gone AS (SELECT j AS rep, min(i) AS duplicate_of FROM pairs WHERE i IN (SELECT id FROM kept) AND j NOT IN (SELECT id FROM kept) GROUP BY j),
f AS (SELECT cl.doc_id, coalesce(gone.duplicate_of, CASE WHEN cl.rep < cl.doc_id THEN cl.rep END) AS duplicate_of FROM cl LEFT JOIN gone USING (rep))
SELECT d.doc_id, f.duplicate_of FROM {docs} d LEFT JOIN f USING (doc_id)"""


def fill(x: str, docs: str = "documents", t: float = 0.0) -> str:
    return x.replace("{docs}", docs).replace("{t}", str(t))


def dedupe(t: float, docs: str = "documents", first: str = "") -> str:
    return "WITH RECURSIVE " + first + ", ".join(fill(x, docs, t) for x in (TERMS, IDF, VECTORS, CLASSES, PAIRS, GREEDY)).strip()


NGRAM = f"""
s AS (SELECT doc_id, translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy') AS t FROM documents WHERE len(list_filter(regexp_split_to_array(text, {q(SPACE + "+")}), lambda x: x <> '')) >= 30),
w AS (SELECT doc_id, regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]{{2,}}') AS t FROM s),
c AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(list_concat(t, [t[i] || ' ' || t[i + 1] FOR i IN range(1, len(t))])) AS term FROM w) GROUP BY doc_id, term),
vo AS (SELECT term, count(*) AS df, sum(n) AS total FROM c GROUP BY term ORDER BY total DESC, term LIMIT 20000),
x AS (SELECT doc_id, term, n AS tf, (1 + ln(n)) * (ln((1.0 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM c JOIN vo USING (term)),
nm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM x GROUP BY doc_id), v AS (SELECT doc_id, term, tf, w / norm AS w FROM x JOIN nm USING (doc_id)),
kk AS (SELECT doc_id, string_agg(term || ':' || round(w, 10), ',' ORDER BY term) AS k FROM v GROUP BY doc_id), cl AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS rep FROM kk)"""



def last(mark: str, n: int) -> str:
    """Place of the mark's last occurrence in w, from 0; -1 without any."""
    return f"(CASE WHEN instr(reverse(w), reverse({mark})) = 0 THEN -1 ELSE length(w) - instr(reverse(w), reverse({mark})) - {n} + 1 END)"


MARKS = (("'. '", 2), ("('.' || chr(10))", 2), ("(chr(10) || chr(10))", 2), ("chr(10)", 1))
STEP = "CASE " + " ".join(f"WHEN s + 1000 < n AND {last(m, k)} > 800 THEN s + {last(m, k)} + {k}" for m, k in MARKS) + " ELSE least(s + 1000, n) END"
CHUNKS = f"""
b AS (SELECT doc_id, text, length(text) AS n, CAST(0 AS BIGINT) AS s, substr(text, 1, 1000) AS w, 0 AS go FROM documents WHERE length(text) > 0
 UNION ALL SELECT doc_id, text, n, e - 200, substr(text, e - 199, 1000), go + 1 FROM (SELECT *, {STEP} AS e FROM b) WHERE e - 200 < n - 200),
p AS (SELECT doc_id, s, {strip("substr(text, s + 1, e - s)")} AS text FROM (SELECT *, {STEP} AS e FROM b)),
c AS (SELECT doc_id AS document_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS chunk_index, text FROM p WHERE text <> '')"""

COS = "list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
NEAR = f"m AS (SELECT a.vec_id AS query_id, b.vec_id, b.label, {COS.format(a='a.embedding', b='b.embedding')} AS s FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM m)"
CONCEPTS = inputs.CONCEPTS.replace("{array}", "list_value")


def edges(variant: str) -> str:
    shared = "len(list_intersect(a.concepts, b.concepts))"
    ni, nj = "len(list_distinct(a.concepts))", "len(list_distinct(b.concepts))"
    weight = f"0.7 * sim + 0.3 * CASE WHEN least(ni, nj) > 0 THEN shared / least(ni, nj) ELSE 0 END" if variant == "a3" else "0.65 * sim + 0.35 * shared / greatest(ni, nj, 1)"
    return f"cc AS ({CONCEPTS}), e0 AS (SELECT a.vec_id AS src, b.vec_id AS dst, round({COS.format(a='a.embedding', b='b.embedding')}, 12) AS sim, {shared} AS shared, {ni} AS ni, {nj} AS nj FROM cc a JOIN cc b ON a.label = b.label AND a.vec_id < b.vec_id), e AS (SELECT src, dst, sim, shared, {weight} AS weight FROM e0 WHERE sim {'>=' if variant == 'a3' else '>'} 0.1)"


BOTH = "bw AS (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e)"


def classified() -> str:
    low = "lower(alert_text)"
    service = "CASE " + " ".join(f"WHEN contains({low}, {q(s)}) THEN {q(s)}" for s in A.SERVICES) + " ELSE 'unknown-service' END"
    severity = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains({low}, {q(p)})' for p in ps)} THEN {q(n)}" for n, ps in A.SEVERITIES.items()) + " ELSE 'medium' END"
    return f"al AS ({inputs.ALERTS}), c AS (SELECT *, {service} AS service, {severity} AS severity FROM al WHERE {strip('alert_text')} <> '')"


def source_files(files: str) -> str:
    ext = "string_split(path, '.')[-1]"
    lang = "CASE " + ext + " " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in S.LANGUAGES.items()) + " END"
    skip = " OR ".join(f"starts_with(path, {q(p)})" for p in S.SKIPPED)
    return f"fi AS ({files}), sf AS (SELECT *, {lang} AS language FROM fi WHERE contains(path, '.') AND {lang} IS NOT NULL AND NOT ({skip}))"


def found() -> str:
    parts = [f"SELECT path AS file, {o} AS det_ord, '{k}' AS vuln_type, '{s}' AS severity, unnest(regexp_extract_all(content, {q(rx)})) AS evidence, generate_subscripts(regexp_extract_all(content, {q(rx)}), 1) - 1 AS pos FROM sf" for o, k, s, rx in S.DETECTORS]
    return f"{source_files(inputs.DOC_FILES)}, fd AS ({' UNION ALL '.join(parts)}), fn AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY det_ord, pos) - 1 AS i FROM fd), fs AS (SELECT *, concat_ws(':', file, vuln_type, i) AS id FROM fn)"


RUN = "rp AS (SELECT doc_id, text, 'http://' || source || '.example.com/' || doc_id AS url, CASE WHEN doc_id % 17 = 0 THEN 'http_500' END AS error, CASE WHEN doc_id % 5 = 4 THEN 'S1' END AS duplicate_of FROM documents)"
USABLE = f"length({strip('text')}) >= 50"
MEDIA = "CASE lower(regexp_extract(" + part("url", 3) + r", '\.([A-Za-z0-9]+)$', 1)) " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in U.MEDIA_TYPES.items()) + " ELSE 'application/octet-stream' END"


def oracle_sql() -> dict[str, str]:
    tf, idf = fill(TERMS), fill(IDF)
    vec = f"{tf}, {idf}, {VECTORS}, {CLASSES}"
    out = {
        "usable_sources": f"SELECT doc_id, 'S' || row_number() OVER (ORDER BY doc_id) AS id, lang FROM documents WHERE {USABLE}",
        "normalize_text": f"SELECT doc_id, {normalized('text')} AS text FROM documents",
        "normalize_whitespace": f"SELECT doc_id, {whitespace('text')} AS text FROM documents",
        "truncate_text": "SELECT doc_id, CASE WHEN length(text) > 500 THEN left(text, 500) || '…' ELSE text END AS text FROM documents",
        "tokenize_tf": f"WITH {tf} SELECT doc_id, term, n, round(tf, 9) AS tf FROM tf",
        "doc_freq_idf": f"WITH {tf}, {idf} SELECT term, df, round(idf, 9) AS idf FROM idf",
        "tfidf_cosine_pairs": f"WITH {vec}, {fill(PAIRS, t=0.85)} SELECT i, j, round(sim, 6) AS sim FROM pairs",
        "vector_classes": f"WITH {vec} SELECT doc_id, rep FROM cl",
        "dedupe_greedy_085": dedupe(0.85),
        "dedupe_greedy_070": dedupe(0.70),
        "dedupe_greedy_050": dedupe(0.50),
        "dedupe_ngram": f"WITH RECURSIVE {NGRAM.strip()}, {fill(PAIRS, t=0.85)}, {fill(GREEDY).strip()}",
        "dedupe_normalized": dedupe(0.85, "nd", f"nd AS (SELECT doc_id, {normalized('text')} AS text FROM documents WHERE {USABLE}), "),
        "chunk_text": f"WITH RECURSIVE {CHUNKS.strip()} SELECT document_id, chunk_index, left(sha256(document_id || ':' || chunk_index), 16) AS id, length(text) AS n, md5(text) AS text_md5 FROM c",
        "context_budget": f"WITH RECURSIVE {CHUNKS.strip()}, u AS (SELECT *, coalesce(sum(length(text)) OVER z, 0) + 2 * greatest(count(*) OVER z - 1, 0) AS used FROM c WINDOW z AS (PARTITION BY document_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT document_id, count(*) AS chunks, md5(string_agg(text, chr(10) || chr(10) ORDER BY chunk_index)) AS context_md5 FROM u WHERE used < 4000 GROUP BY document_id",
        "vector_topk": f"WITH {NEAR} SELECT query_id, vec_id, round(s, 6) AS sim, rank FROM r WHERE rank <= 5",
        "vector_topk_filtered": f"WITH {NEAR}, z AS (SELECT query_id, vec_id, s, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM r WHERE rank <= 10 AND label < 5) SELECT query_id, vec_id, round(s, 6) AS sim, rank FROM z WHERE rank <= 5",
        "edges_a3": f"WITH {edges('a3')} SELECT src, dst, round(sim, 6) AS sim, shared, round(weight, 6) AS weight FROM e",
        "edges_a4": f"WITH {edges('a4')} SELECT src, dst, round(sim, 6) AS sim, shared, round(weight, 6) AS weight FROM e",
        "neighbors": f"WITH {edges('a3')}, {BOTH} SELECT src, dst, round(weight, 6) AS weight, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rank FROM bw WHERE src % 10 = 0",
        "shortest_distance": f"WITH {edges('a3')}, {BOTH}, st AS (SELECT src, dst, CASE WHEN weight > 0 THEN 1 / weight ELSE 10 END AS cost FROM bw), h0 AS (SELECT vec_id AS start, vec_id AS node, 1.0::DOUBLE AS d FROM embeddings WHERE vec_id % 20 = 0), h1 AS (SELECT start, dst AS node, d + cost AS d FROM h0 JOIN st ON node = src), h2 AS (SELECT start, dst AS node, d + cost AS d FROM h1 JOIN st ON node = src) SELECT start, node, round(min(d), 6) AS distance FROM (FROM h0 UNION ALL FROM h1 UNION ALL FROM h2) GROUP BY start, node",
        "upsert_chunks": "SELECT doc_id AS id, lang, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS state FROM documents WHERE doc_id % 3 = 0 OR doc_id % 2 = 0",
        "merged_batches": "SELECT doc_id AS id, lang, source, CASE WHEN doc_id % 7 = 0 THEN 'four' WHEN doc_id % 5 = 0 THEN 'three' WHEN doc_id % 3 = 0 THEN 'two' ELSE 'one' END AS state FROM documents WHERE doc_id % 7 = 0 OR (doc_id % 10 > 0 AND (doc_id % 2 = 0 OR doc_id % 3 = 0 OR doc_id % 5 = 0))",
        "upsert_edges": f"WITH {edges('a3')}, nw AS (SELECT src, dst, weight FROM e WHERE src % 2 = 0 AND src % 4 > 0 AND dst % 4 > 0), nb AS (SELECT src, dst, weight FROM nw UNION ALL SELECT dst, src, weight FROM nw), od AS (SELECT src, dst FROM e WHERE src % 3 = 0 UNION ALL SELECT dst, src FROM e WHERE src % 3 = 0) SELECT src, dst, round(weight, 6) AS weight FROM nb UNION ALL SELECT src, dst, 2.0 FROM od ANTI JOIN nb USING (src, dst)",
        "delete_document": f"WITH {edges('a3')}, {BOTH} SELECT src, dst, round(weight, 6) AS weight FROM bw JOIN embeddings a ON a.vec_id = src JOIN embeddings b ON b.vec_id = dst WHERE a.label >= 3 AND b.label >= 3 UNION ALL SELECT vec_id, NULL, NULL FROM embeddings WHERE label >= 3",
        "collection_names": "SELECT page_id, 'graphrag_' || left(sha256(url), 16) AS name FROM pages",
        "page_title": f"SELECT page_id, CASE WHEN {meta('og:title')} <> '' THEN {meta('og:title')} ELSE {strip(decode('regexp_extract(html, ' + q(r'(?is)<title\b[^>]*>(.*?)</title\s*>') + ', 1)'))} END AS title, {meta('author', 'name')} AS author, CASE WHEN {meta('article:published_time')} <> '' THEN {meta('article:published_time')} ELSE {meta('datePublished', 'name')} END AS published FROM pages",
        "page_text": f"SELECT page_id, {page_text('a1')} AS text FROM pages",
        "page_text_a2": f"SELECT page_id, {page_text('a2')} AS text FROM pages",
        "page_links": f"WITH {LINKS} SELECT url, pos, link FROM k",
        "page_outlinks": f"WITH {HREFS} SELECT url, pos, CASE WHEN starts_with(trim(href), '/') THEN {origin('url')} || trim(href) ELSE trim(href) END AS link FROM l WHERE starts_with(trim(href), '/') OR starts_with(trim(href), 'http://') OR starts_with(trim(href), 'https://')",
        "url_normalize": f"WITH {registered('pages')} SELECT page_id, {normal_url('url')} AS normal, {authority('url')} AS authority, registered, regexp_matches(lower({part('url', 3)}), {q(chr(92) + '.(' + '|'.join(U.BINARY_EXTENSIONS) + ')$')}) AS is_binary, {MEDIA} AS media_type FROM rd",
        "domain_top5": f"SELECT {authority('url')} AS domain, count(*) AS n, min(page_id) AS first FROM pages GROUP BY 1 ORDER BY n DESC, first LIMIT 5",
        "registered_domains": f"WITH sh AS ({inputs.SHOPS}), {registered('sh')} SELECT c_custkey, registered FROM rd",
        "domain_top5_registered": f"WITH {registered('pages')} SELECT registered AS domain, count(*) AS n, min(page_id) AS first FROM rd GROUP BY 1 ORDER BY n DESC, first LIMIT 5",
        "same_domain_links": f"WITH {LINKS} SELECT url, count(*) AS links FROM k WHERE {authority('url')} = {authority('link')} GROUP BY url",
        "robots_allowed": f"SELECT page_id FROM pages WHERE NOT ({authority('url')} IN ('ththre.example.com', 'm.therou.example.com', 'thther.example.org') AND starts_with({part('url', 3)}, '/en'))",
        "alert_classify": f"WITH {classified()} SELECT event_id, service, severity FROM c",
        "alert_error_codes": rf"WITH {classified()} SELECT event_id, array_to_string(regexp_extract_all(alert_text, '\b(?:5[0-9]{{2}}|4[0-9]{{2}})\b'), ',') AS codes FROM c",
        "alert_escalate": f"WITH {classified()}, z AS (SELECT *, severity = 'critical' OR {' OR '.join(f'contains(lower(alert_text), {q(p)})' for p in A.ESCALATING)} OR coalesce(confidence, 0) < 0.6 AS should_escalate FROM c) SELECT event_id, strftime(ts, 'inc-%Y-%m-%d-%H%M') AS incident_id, should_escalate, CASE WHEN should_escalate THEN 'Immediate human escalation required' ELSE 'Continue monitoring' END AS next_recommendation, 'Issue detected in ' || service || ' with severity ' || severity || '.' AS summary FROM z",
        "source_file_filter": f"WITH {source_files(inputs.FILES)} SELECT path, language FROM sf",
        "source_file_first": f"WITH {source_files(inputs.FILES)} SELECT path, language FROM sf ORDER BY path LIMIT 10",
        "detector_scan": f"WITH {found()} SELECT file, vuln_type, severity, pos, evidence FROM fs",
        "finding_ids": f"WITH {found()} SELECT id, file, i FROM fs",
        "findings_reduce": f"WITH {found()} SELECT path AS file, count(fs.id) AS findings FROM sf LEFT JOIN fs ON file = path GROUP BY path",
        "triage_confirmed": f"WITH {found()} SELECT id, severity FROM fs WHERE severity IN ('critical', 'high')",
        "scan_report": f"WITH {found()} SELECT (SELECT count(*) FROM sf) AS files_scanned, count(*) AS total_findings, count(*) FILTER (severity IN ('critical', 'high')) AS confirmed, CAST(7 AS BIGINT) AS reported_false_positives, count(*) - count(*) FILTER (severity IN ('critical', 'high')) AS derived_false_positives FROM fs",
        "patches": f"WITH {found()} SELECT id, '# TODO: review ' || vuln_type || ' in ' || file AS patch FROM fs WHERE severity IN ('critical', 'high')",
        "run_stats_a1": f"WITH {RUN}, z AS (SELECT *, error IS NULL AND {USABLE} AS good FROM rp) SELECT count(*) FILTER (good) AS fetched, count(*) FILTER (good AND duplicate_of IS NULL) AS kept, count(*) FILTER (good AND duplicate_of IS NOT NULL) AS duplicates, count(*) FILTER (error IS NOT NULL) AS failures FROM z",
        "run_stats_a2": f"WITH {RUN}, z AS (SELECT *, error IS NULL AND text <> '' AS good FROM rp) SELECT count(*) AS fetched, least(count(*) FILTER (good AND duplicate_of IS NULL), 20) AS kept, count(*) FILTER (good AND duplicate_of IS NOT NULL) AS duplicates, count(*) FILTER (error IS NOT NULL) AS failures FROM z",
        "failures_anti": f"WITH {RUN}, fa AS (SELECT doc_id AS ord, 'u' || (doc_id % 40) AS url, error FROM rp WHERE error IS NOT NULL) SELECT min(ord) AS ord, url, arg_min(error, ord) AS error FROM fa WHERE url NOT IN (SELECT 'u' || doc_id FROM rp WHERE error IS NULL AND doc_id < 20) GROUP BY url",
        "sources_union": f"WITH {RUN} SELECT CAST(CASE WHEN error IS NOT NULL THEN 2 WHEN duplicate_of IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS section, doc_id FROM rp",
        "enrich_records": "WITH r AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS title FROM documents), f AS (SELECT id, id % 2 = 0 AS has, CASE WHEN id % 2 = 0 AND id % 4 <> 0 THEN 'someone' END AS new_author, title FROM r) SELECT id, CASE WHEN has THEN 'new' ELSE title END AS title, new_author AS author, CASE WHEN has THEN '2025' ELSE '2024' END AS published_at, 'a1' AS variant FROM f UNION ALL SELECT id, CASE WHEN title <> '' THEN title WHEN has THEN 'new' END, CASE WHEN has THEN CASE WHEN id % 4 = 0 THEN '' ELSE 'someone' END END, '2024', 'a2' FROM f",
        "llm_json_extract": f"""WITH r AS ({inputs.REPLIES}) SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN reply WHEN 1 THEN '{{"turn": ' || turn || '}}' WHEN 2 THEN '{{"turn": ' || turn || ', "ok": true}}' END AS found, CASE WHEN (conv_id + turn) % 4 < 3 THEN turn END AS value FROM r""",
        "event_props": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
        "ordered_concat": "SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS text_md5, count(*) AS turns FROM conversations GROUP BY conv_id",
        "concepts_offline": f"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), {q(WORD)})) AS t FROM documents), c AS (SELECT doc_id, t, count(*) AS n FROM w WHERE length(t) >= 4 GROUP BY doc_id, t), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, t) AS r FROM c), g AS (SELECT doc_id, string_agg(t, ',' ORDER BY r) AS concepts FROM r WHERE r <= 20 GROUP BY doc_id) SELECT d.doc_id, coalesce(g.concepts, '') AS concepts FROM documents d LEFT JOIN g USING (doc_id)",
        "triage_semi_join": "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
        "rate_schedule": f"SELECT page_id, {authority('url')} AS domain, row_number() OVER (PARTITION BY {authority('url')} ORDER BY page_id) - 1 AS second FROM pages",
        "extracted_pages": "WITH w AS (SELECT page_id, CASE WHEN page_id % 9 = 0 THEN url || '/missing' ELSE url END AS url FROM pages) SELECT page_id, url, CAST(CASE WHEN url IN (SELECT url FROM pages) THEN 200 ELSE 404 END AS BIGINT) AS status, CASE WHEN url IN (SELECT url FROM pages) THEN NULL ELSE 'http_404' END AS error FROM w",
    }
    out["cached_concepts"] = out["concepts_offline"]
    out["vector_index_all"] = out["vector_topk"]
    from quillspark.plans import flows_sql

    return out | flows_sql.oracle_sql()
