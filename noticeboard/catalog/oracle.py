"""SQL counterparts of the registered queries, written independently of the Spark plans."""
from __future__ import annotations

from noticeboard.catalog.fixtures import WORDS, with_fixtures
from noticeboard.fixed_values import EVENT_CATEGORIES, MARKUP_MARKERS, NOTICE_TYPES, SOURCE_STAMP

_CATEGORIES = ", ".join(f"'{c}'" for c in EVENT_CATEGORIES)
_TYPE_ROWS = ", ".join(
    "('{}', '{}', '{}', {}, {}, {})".format(*[str(x).replace("'", "''") for x in r])
    for r in NOTICE_TYPES)


def _spaced(words: str) -> str:
    return f"(' ' || array_to_string({words}, '  ') || ' ')"


def _day(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d')"


# ---- phrase search ----

_PHRASES = """phrase_hits AS (
    SELECT p.phrase, p.words, d.id, d.tokens, len(d.tokens) AS n_tokens
    FROM (SELECT *, {text} AS spaced FROM docs) d
    JOIN (SELECT DISTINCT {phrase} AS phrase, words FROM wanted WHERE len(words) > 0) p
      ON contains(d.spaced, p.phrase)),
counted AS (
    SELECT phrase, words, id, n_tokens,
           len(list_filter(range(1, n_tokens - len(words) + 2),
                           lambda i: tokens[i:i + len(words) - 1] = words)) AS tf
    FROM phrase_hits)""".format(text=_spaced("tokens"), phrase=_spaced("words"))

_RANK = ("0.1 * list_sum(list_transform(range(1, tf + 1), lambda j: 1.0::DOUBLE / (j * j))) "
         "/ 1.64493406685 / log2(n_tokens + 1)")

_FILTER = """(f_category IS NULL OR d.event_category = f_category)
      AND (f_action IS NULL OR d.action_taken = f_action)
      AND (f_code IS NULL OR d.code = f_code)
      AND (f_from IS NULL OR d.date >= f_from) AND (f_to IS NULL OR d.date <= f_to)
      AND (f_sig IS NULL OR d.significance_score >= f_sig)"""

_PAGES = """ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id
              ORDER BY score DESC NULLS LAST, date DESC NULLS FIRST, id) AS rank FROM scored),
paged AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY date DESC NULLS FIRST, id) AS position
    FROM ranked WHERE rank <= k)"""


def _wanted(source: str, words_of: str = "q") -> str:
    return (f"wanted AS (SELECT *, regexp_extract_all(lower({words_of}), {WORDS}) AS words "
            f"FROM {source})")


def _keyword_scores(where: str = "true") -> str:
    return f"""SELECT r.query_id, r.k, d.id, d.date,
           {_RANK} + coalesce(d.significance_score, 0) / 100.0::DOUBLE
           - least(length(d.fulltext) / 20000.0::DOUBLE, 1.0) AS score
    FROM counted c JOIN docs d ON c.id = d.id
    JOIN wanted r ON {_spaced('r.words')} = c.phrase
    WHERE {_FILTER} AND {where}"""


_RESULT = (f"SELECT query_id, id, {_day('date')} AS date, round(score, 6) AS score, rank, position "
           "FROM paged")

# ---- vectors of texts: word counts hashed into 64 places ----

_TEXT_VECTORS = """text_places AS (
    SELECT kind, key, CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % 64 AS place, count(*) AS n
    FROM (SELECT kind, key, unnest(words) AS w FROM texts) GROUP BY ALL),
components AS (
    SELECT kind, key, place,
           CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY kind, key)) AS FLOAT) AS DOUBLE) AS v
    FROM text_places),
norms AS (SELECT kind, key, sqrt(sum(v * v)) AS norm, max(v) AS largest FROM components GROUP BY ALL)"""

_TEXTS = f"""texts AS (
    SELECT 'doc' AS kind, id AS key, regexp_extract_all(lower(fulltext), {WORDS}) AS words FROM docs
    UNION ALL
    SELECT DISTINCT 'query', CAST(query_id AS VARCHAR), words FROM wanted WHERE is_sentence)"""

_COSINES = """cosines AS (
    SELECT CAST(q.key AS BIGINT) AS query_id, d.id,
           round(coalesce(dot, 0) / (qn.norm * nullif(dn.norm, 0)), 9) AS cosine
    FROM norms qn JOIN (SELECT 'query' AS kind, CAST(query_id AS VARCHAR) AS key FROM wanted
                        WHERE is_sentence) q ON qn.kind = q.kind AND qn.key = q.key
    CROSS JOIN docs d
    LEFT JOIN norms dn ON dn.kind = 'doc' AND dn.key = d.id
    LEFT JOIN (SELECT a.key AS qk, b.key AS dk, sum(a.v * b.v) AS dot
               FROM components a JOIN components b
                 ON a.place = b.place AND a.kind = 'query' AND b.kind = 'doc'
               GROUP BY a.key, b.key) x ON x.qk = q.key AND x.dk = d.id)"""

_WANTED = f"""wanted AS (
    SELECT *, regexp_extract_all(lower(q), {WORDS}) AS words,
           len(string_split_regex(trim(q), '\\s+')) > 3 AS is_sentence FROM requests),
longest AS (
    SELECT query_id, list_sort(list_transform(words, lambda w: (-length(w), w)))[1] AS pick FROM wanted),
keyworded AS (
    SELECT w.*, struct_extract_at(pick, 2) AS keyword FROM wanted w JOIN longest l ON w.query_id = l.query_id)"""


def _semantic_scores(bonus: bool, filtered: bool = True) -> str:
    plus = (f"CASE WHEN contains({_spaced('d.tokens')}, ' ' || r.keyword || ' ') THEN 0.1 ELSE 0 END"
            if bonus else "0")
    return f"""SELECT r.query_id, r.k, d.id, d.date, c.cosine + {plus} AS score
    FROM cosines c JOIN docs d ON c.id = d.id JOIN keyworded r ON c.query_id = r.query_id
    WHERE {_FILTER if filtered else 'true'}"""


def _both(k: str = "r.k", bonus: bool = True) -> str:
    """Scores of both routes with their route names."""
    keyword = _keyword_scores("NOT r.is_sentence")
    return f"""scored AS (
    SELECT query_id, {k.replace('r.', '')} AS k, id, date, score, route FROM (
        SELECT *, 'keyword' AS route FROM ({keyword})
        UNION ALL SELECT *, 'semantic' AS route FROM ({_semantic_scores(bonus)})))"""


_ROUTED = ",\n".join([with_fixtures("docs", "requests"), _WANTED, _PHRASES, _TEXTS, _TEXT_VECTORS,
                      _COSINES])

# ---- entities ----

_TIMELINE = """wanted AS (
    SELECT entity_id, CASE WHEN coalesce(nzbn, '') <> '' THEN 'nzbn'
                           WHEN coalesce(company_number, '') <> '' THEN 'number'
                           WHEN coalesce(name, '') <> '' THEN 'name' END AS how,
           nzbn, company_number, name FROM entities),
matched AS (
    SELECT w.entity_id, n.* FROM wanted w JOIN orders_n n ON w.how = 'nzbn' AND n.nzbn = w.nzbn
    UNION ALL
    SELECT w.entity_id, n.* FROM wanted w JOIN orders_n n
        ON w.how = 'number' AND n.company_number = w.company_number
    UNION ALL
    SELECT w.entity_id, n.* FROM (SELECT * FROM wanted WHERE how = 'name') w
        JOIN orders_n n ON n.title ILIKE '%' || w.name || '%'),
timelines AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY date ASC NULLS LAST, id)
                   AS rank FROM matched) WHERE rank <= 40)"""

_RELATED = """links AS (
    SELECT seed_id, id, rank FROM (
        SELECT s.id AS seed_id, n.id, row_number() OVER (PARTITION BY s.id
                   ORDER BY n.date DESC NULLS FIRST, n.id) AS rank
        FROM (SELECT DISTINCT a.id AS seed, b.id AS other FROM postings a JOIN postings b
              ON a.party = b.party AND a.id <> b.id {seeds}) p
        JOIN orders_n s ON s.id = p.seed JOIN orders_n n ON n.id = p.other) WHERE rank <= 15)"""

# ---- write path ----

_HALF = """half AS (
    SELECT d.*, CASE WHEN significance_score IS NOT NULL THEN fulltext END AS plain_english,
           significance_score IS NOT NULL AS enriched, e.embedding
    FROM docs d LEFT JOIN embeddings e ON d.doc_id = e.vec_id)"""

_ANSWERS = f"""answers AS (
    SELECT CAST(doc_id AS VARCHAR) AS id, doc_id % 22 AS shape, doc_id, text, source, lang,
           doc_id % 22 = 0 OR doc_id % 22 > 10 AS good FROM documents),
annotations AS (
    SELECT id, CASE WHEN good THEN trim(source) ELSE '' END AS headline,
           CASE WHEN good THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') ELSE '' END AS plain_english,
           CASE WHEN good AND doc_id % 3 = 0 THEN 'land'
                WHEN good AND source IN ({_CATEGORIES}) THEN source ELSE 'other' END AS event_category,
           CASE WHEN good THEN 'rule_made' ELSE 'other' END AS action_taken,
           CASE WHEN good THEN source || '|' || lang ELSE '' END AS parties,
           CASE WHEN good THEN greatest(0, least(100, doc_id % 150 - 20))
                WHEN shape IN (4, 5) THEN 75 WHEN shape = 10 THEN least(100, doc_id) ELSE 0 END AS score,
           CASE WHEN good THEN 'why' ELSE '' END AS significance_reason
    FROM answers WHERE good OR shape IN (1, 4, 5, 9, 10))"""

_LOG = """log AS (SELECT event_id, ts, CAST(user_id AS VARCHAR) AS ip, event_type AS route, value, props
            FROM events)"""


def _decisions(day_cap: int | None) -> str:
    cap = (f"WHEN global_rank > {day_cap} THEN 'day' " if day_cap else "")
    return f"""WITH {_LOG},
    a AS (SELECT *, row_number() OVER (PARTITION BY ip, strftime(ts, '%Y-%m-%d %H')
                                       ORDER BY ts, event_id) AS r1 FROM log),
    b AS (SELECT *, CASE WHEN r1 <= 1 THEN row_number() OVER (
              PARTITION BY ip, strftime(ts, '%Y-%m-%d'), r1 <= 1 ORDER BY ts, event_id) END AS r2 FROM a),
    c AS (SELECT *, CASE WHEN r2 <= 2 THEN row_number() OVER (
              PARTITION BY strftime(ts, '%Y-%m-%d'), coalesce(r2 <= 2, false)
              ORDER BY ts, event_id) END AS global_rank FROM b),
    d AS (SELECT event_id, CASE WHEN r1 > 1 THEN 'ip_minute' WHEN r2 > 2 THEN 'ip_day' {cap}
                           ELSE 'ok' END AS reason FROM c)
    SELECT event_id, CAST(CASE reason WHEN 'ok' THEN 200 WHEN 'day' THEN 503 ELSE 429 END AS BIGINT)
           AS status, reason FROM d"""


_RULE_CASES = {
    "aw": ("liquidation", "application_filed"), "al": ("liquidation", "liquidator_appointed"),
    "vw": ("liquidation", "other"), "ar": ("receivership", "receiver_appointed"),
    "aa": ("administration", "administrator_appointed"), "ba": ("bankruptcy", "bankruptcy_declared"),
    "cb": ("cessation", "business_ceased"), "ds": ("company_removal", "company_struck_off"),
    "md": ("creditor_meeting", "meeting_called"), "sl": ("legislation", "rule_made"),
    "dl": ("legislation", "rule_made"), "ln": ("land", "land_action"), "lt": ("land", "land_action"),
    "ct": ("charity_or_society", "status_changed"), "is": ("charity_or_society", "status_changed"),
    "fs": ("charity_or_society", "status_changed"), "vr": ("appointment", "other"),
}


def _by_code(i: int) -> str:
    whens = " ".join(f"WHEN '{c}' THEN '{v[i]}'" for c, v in _RULE_CASES.items())
    return f"CASE code {whens} ELSE 'other' END"


_RULED = f"""ruled AS (
    SELECT *, {_by_code(0)} AS category, {_by_code(1)} AS action, CAST(least(100, floor(length(
           'Notice type: ' || type || chr(10) || 'Company/subject: ' || title || chr(10) || chr(10)
           || 'Full text:' || chr(10) || fulltext) / 100)) AS BIGINT) AS rule_score FROM notices)"""

_CLIENTS = """clients AS (
    SELECT *, CASE WHEN event_id % 3 = 0 THEN trim(split_part(ip || '.1.2.3, 10.0.0.1', ',', 1))
                   WHEN event_id % 5 <> 0 THEN 'peer-' || ip ELSE 'unknown' END AS client FROM log)"""

_CUT = "text"
for _m in MARKUP_MARKERS:
    _CUT = f"split_part({_CUT}, '{_m}', 1)"

ORACLE: dict[str, str] = {
    "page_records": with_fixtures("notices") + f""",
    pages AS (SELECT 2000 + doc_id % 25 AS year, doc_id // 2500 AS page, count(*) AS n
              FROM documents GROUP BY ALL),
    placed AS (SELECT d.*, 2000 + doc_id % 25 AS year, doc_id // 2500 AS page,
                      row_number() OVER (PARTITION BY doc_id % 25, doc_id // 2500 ORDER BY doc_id) - 1
                      AS position FROM documents d)
    SELECT n.id, p.source || ' ' || p.lang || ' ' || CAST(p.doc_id AS VARCHAR) AS title,
           CAST(g.n AS INTEGER) AS result_count,
           CAST(greatest(1, ceil(g.n / 100)) AS INTEGER) AS page_count, g.n < 100 AS live_edge,
           p.position, CAST(p.year AS INTEGER) AS year,
           md5(p.text || CASE WHEN p.doc_id % 2 = 0
               THEN ' NZBN: ' || lpad(CAST(p.doc_id AS VARCHAR), 13, '0')
               ELSE ' Company No.: WN. ' || CAST(p.doc_id AS VARCHAR) END) AS body_md5
    FROM placed p JOIN pages g ON p.year = g.year AND p.page = g.page
    LEFT JOIN notices n ON n.doc_id = p.doc_id""",

    "page_year_window": with_fixtures("notices") + """
    SELECT CAST(year AS INTEGER) AS year, count(*) AS n, min(id) AS first_id FROM notices
    WHERE year BETWEEN 2005 AND 2014 GROUP BY year""",

    "build_notices": with_fixtures("notices") + f"""
    SELECT id, code, type, {_day('date')} AS date, title, nzbn, company_number,
           md5(fulltext) AS fulltext_md5, landing_url, '{SOURCE_STAMP}' AS source,
           doc_id % 50 = 0 AS bad_day FROM notices""",

    "appended_notices": with_fixtures("notices") + """
    SELECT year, code, count(*) AS n, max(id) AS last_id FROM notices GROUP BY year, code""",

    "type_facets": with_fixtures("notices") + f""",
    types(code, label, category, active, tier, insolvency) AS (VALUES {_TYPE_ROWS})
    SELECT category, CAST(tier AS INTEGER) AS tier, insolvency, count(*) AS n,
           count(DISTINCT type) AS n_types
    FROM notices JOIN types ON notices.code = types.code WHERE active GROUP BY ALL""",

    "notice_lookup": with_fixtures("docs") + f"""
    SELECT id, {_day('date')} AS date, type, headline, event_category, action_taken,
           significance_score, title, md5(fulltext) AS fulltext_md5
    FROM docs WHERE doc_id IN (SELECT doc_id FROM labels)""",

    "request_log_lines": f"""WITH {_LOG}, {_CLIENTS}
    SELECT route, substr(sha256('salt' || client), 1, 16) AS ip_hash,
           substr(repeat(route, 60), 1, 200) AS ua, props AS request, CAST(200 AS BIGINT) AS status,
           CAST(floor(value) AS BIGINT) AS ms, substr(repeat(props, 60), 1, 300) AS error,
           strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, strftime(ts, '%Y-%m-%d') AS day FROM clients""",

    "log_retention": """WITH days AS (
        SELECT CASE WHEN CAST(ts AS DATE) >= DATE '2024-01-15' THEN 'kept' ELSE 'pruned' END AS outcome,
               CAST(ts AS DATE) AS day FROM events)
    SELECT outcome, count(DISTINCT day) AS n_days, count(*) AS n_rows,
           CASE WHEN outcome = 'kept' THEN count(*) END AS n_retained FROM days GROUP BY outcome""",

    "request_clients": f"""WITH {_LOG}, {_CLIENTS}
    SELECT event_id, client AS ip, substr(sha256('salt' || client), 1, 16) AS ip_hash,
           strftime(ts, '%Y-%m-%dT%H:%M') AS minute, strftime(ts, '%Y-%m-%d') AS day,
           greatest(1, CAST(86400 - ceil((epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 1000000.0)
                            AS BIGINT)) AS retry_after FROM clients""",

    "notice_tokens": with_fixtures("docs") + """
    SELECT id, len(tokens) AS n_tokens, md5(array_to_string(tokens, ' ')) AS tokens_md5 FROM docs""",

    "query_routing": with_fixtures("requests") + f"""
    SELECT query_id, q, len(string_split_regex(trim(q), '\\s+')) > 3 AS is_sentence,
           array_to_string(regexp_extract_all(lower(q), {WORDS}), ' ') AS words,
           CAST(greatest(1, least(100, k * 10)) AS BIGINT) AS k FROM requests""",

    "annotation_parse": f"""WITH {_ANSWERS}
    SELECT id, headline, md5(plain_english) AS plain_md5, event_category, action_taken, parties, score,
           significance_reason FROM annotations""",

    "parsed_filters": with_fixtures("requests") + f""",
    shaped AS (
        SELECT query_id, q, CASE WHEN item_id % 7 = 3 THEN f_category END AS f_category,
               CASE WHEN item_id % 11 = 4 THEN f_action ELSE '' END AS f_action, item_id, query_id % 5 AS shape
        FROM (SELECT *, query_id // 1000 AS item_id FROM requests)),
    parsed AS (
        SELECT *, CASE WHEN shape IN (0, 4) AND item_id % 2 = 0 THEN 'land' END AS category,
               CASE WHEN shape = 3 THEN 'rule_made' END AS action,
               CASE WHEN shape IN (1, 2) THEN [] WHEN shape = 3 THEN ['one', 'two "x"']
                    ELSE string_split(q, ' ')[1:4] END AS keywords FROM shaped)
    SELECT query_id, trim(q) AS semantic_query,
           nullif(coalesce(f_category, category), '') AS event_category,
           nullif(coalesce(f_action, action), '') AS action_taken,
           array_to_string(keywords, '|') AS keywords,
           coalesce(array_to_string(list_filter(list_transform(keywords, lambda k:
               array_to_string(regexp_extract_all(lower(replace(k, '"', ' ')), {WORDS}), ' ')),
               lambda p: p <> ''), '|'), '') AS phrases FROM parsed""",

    "clean_answers": f"""WITH answers AS (
        SELECT conv_id AS run_id, turn AS step,
               '## ' || text || chr(10) || '---' || chr(10) || '  # **bold** `code` __x__' || chr(10) ||
               CASE turn % 3 WHEN 0 THEN '<tool_call id=1>' WHEN 1 THEN 'x invoke name=y'
                    ELSE 'end' END AS text FROM conversations),
    cut AS (SELECT run_id, step, text, replace(replace({_CUT}, '**', ''), '__', '') AS prose FROM answers)
    SELECT run_id, step, text LIKE '%<tool_call%' OR text LIKE '%invoke name=%' AS leaked,
           md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(prose,
               '(?m)^\\s{{0,3}}#{{1,6}}\\s*', '', 'g'), '(?m)^\\s*[-*_]{{3,}}\\s*$', '', 'g'),
               '`([^`]*)`', '\\1', 'g'), '^\\s+|\\s+$', '', 'g')) AS prose_md5 FROM cut""",

    "annotator_inputs": with_fixtures("docs") + """
    SELECT id, md5('Notice type: ' || type || chr(10) || 'Company/subject: ' ||
           CASE WHEN doc_id % 7 <> 0 THEN title ELSE 'None' END || chr(10) || chr(10) || 'Full text:' ||
           chr(10) || fulltext) AS prompt_md5 FROM docs""",

    "filtered_notices": with_fixtures("docs") + f"""
    SELECT id, {_day('date')} AS date, headline, event_category AS category,
           significance_score AS significance, title AS name FROM docs
    WHERE event_category = 'land' AND date BETWEEN DATE '2000-01-05' AND DATE '2024-01-01'
      AND significance_score >= 0""",

    "pending_counts": with_fixtures("docs") + f""", {_HALF}
    SELECT count(*) FILTER (NOT enriched) AS n_unannotated,
           count(*) FILTER (plain_english IS NOT NULL AND embedding IS NULL) AS n_unembedded FROM half""",

    "pending_vectors": with_fixtures("docs") + f""", {_HALF}
    SELECT count(*) AS n_pending FROM half WHERE plain_english IS NOT NULL AND embedding IS NULL""",

    "pending_annotations": with_fixtures("docs") + f""", {_HALF}
    SELECT id, title FROM half WHERE NOT enriched""",

    "next_chunk": with_fixtures("docs") + f""", {_HALF}
    SELECT id, title FROM half WHERE plain_english IS NOT NULL AND embedding IS NULL
    ORDER BY id LIMIT 50""",

    "unlabelled_notices": """SELECT CAST(doc_id AS VARCHAR) AS id,
           CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'present' ELSE 'absent' END AS kind
    FROM documents""",

    "party_overlap": with_fixtures("orders_n", "postings") + f"""
    SELECT n.id, {_day('any_value(n.date)')} AS date, count(*) AS n_parties
    FROM orders_n n JOIN postings p ON n.id = p.id GROUP BY n.id
    HAVING bool_or(party IN ('Supplier#000000001', 'Supplier#000000004', 'Supplier#000000007'))""",

    "phrase_lookup": with_fixtures("docs") + f""",
    wanted AS (SELECT ['of', 'the'] AS words), {_PHRASES}
    SELECT id, {_day('date')} AS date, round(score, 6) AS score FROM (
        SELECT d.id, d.date, {_RANK} + coalesce(d.significance_score, 0) / 100.0::DOUBLE
               - least(length(d.fulltext) / 20000.0::DOUBLE, 1.0) AS score
        FROM counted c JOIN docs d ON c.id = d.id WHERE d.significance_score >= 0
        ORDER BY score DESC, d.date DESC NULLS FIRST, d.id LIMIT 20)""",

    "phrase_matches": with_fixtures("docs", "requests") + f", {_wanted('requests')}, {_PHRASES}" + f"""
    SELECT w.query_id, c.id, c.tf AS occurrences FROM counted c JOIN wanted w
      ON {_spaced('w.words')} = c.phrase""",

    "any_phrase_matches": with_fixtures("docs") + f"""
    SELECT id, contains({_spaced('tokens')}, ' of  the ')
               OR contains({_spaced('tokens')},
                           {_spaced(f"regexp_extract_all(lower(type || ' ' || code), {WORDS})")}) AS hit
    FROM docs""",

    "keyword_search": with_fixtures("docs", "requests") + f""", {_wanted('requests')}, {_PHRASES},
    scored AS ({_keyword_scores()}), {_PAGES} {_RESULT}""",

    "text_vectors": with_fixtures("docs") + f""",
    texts AS (SELECT 'doc' AS kind, id AS key, regexp_extract_all(lower(fulltext), {WORDS}) AS words
              FROM docs), {_TEXT_VECTORS}
    SELECT d.id, CAST(64 AS BIGINT) AS dim, round(coalesce(norm, 0), 5) AS norm,
           round(coalesce(largest, 0), 5) AS largest
    FROM docs d LEFT JOIN norms n ON n.key = d.id""",

    "vector_search": """WITH pairs AS (
        SELECT q.vec_id AS query_id, CAST(v.vec_id AS VARCHAR) AS id,
               round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score
        FROM embeddings q CROSS JOIN embeddings v)
    SELECT query_id, id, round(score, 6) AS score, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, id) AS rank
        FROM pairs) WHERE rank <= 10""",

    "semantic_search": _ROUTED + f", scored AS ({_semantic_scores(True)}), {_PAGES} {_RESULT}",

    "routed_search": _ROUTED + f", {_both()}, {_PAGES}" + f"""
    SELECT query_id, route, id, {_day('date')} AS date, round(score, 6) AS score, position FROM paged""",

    "search_responses": _ROUTED + f", {_both()}, {_PAGES}" + """
    SELECT r.query_id, CASE WHEN is_sentence THEN 'semantic' ELSE 'keyword' END AS route,
           CASE WHEN is_sentence THEN keyword END AS keywords, count(p.id) AS count
    FROM keyworded r LEFT JOIN paged p ON p.query_id = r.query_id GROUP BY ALL""",

    "compact_search": _ROUTED + f", {_both('12', False)}, {_PAGES}" + f"""
    SELECT p.query_id, p.position, p.id, {_day('p.date')} AS date, d.headline,
           d.event_category AS category, d.significance_score AS significance
    FROM paged p JOIN docs d ON p.id = d.id""",

    "search_regression": with_fixtures("docs", "requests") + f""",
    cases AS (
        SELECT *, true AS expect_hit, regexp_extract_all(lower(q), {WORDS}) AS words FROM requests
        UNION ALL
        SELECT * REPLACE (-query_id - 1 AS query_id), false,
               list_reverse(regexp_extract_all(lower(q), {WORDS})) FROM requests),
    wanted AS (SELECT * FROM cases), {_PHRASES},
    scored AS ({_keyword_scores()}), {_PAGES},
    answers AS (SELECT query_id, count(*) AS n, max(CASE WHEN position = 1 THEN id END) AS top
                FROM paged GROUP BY query_id)
    SELECT c.query_id, c.expect_hit, coalesce(n, 0) AS n,
           CASE WHEN c.expect_hit THEN coalesce(n, 0) > 0 AND contains(lower(coalesce(d.headline, '')), 'en')
                ELSE coalesce(n, 0) = 0 END AS passed
    FROM cases c LEFT JOIN answers a ON c.query_id = a.query_id LEFT JOIN docs d ON d.id = a.top""",

    "company_timeline": with_fixtures("orders_n", "entities") + f""", {_TIMELINE}
    SELECT entity_id, rank, id, {_day('date')} AS date, headline, event_category AS category,
           significance_score AS significance, title AS name FROM timelines""",

    "related_parties": with_fixtures("orders_n", "postings") + ", " + _RELATED.format(seeds="") + f"""
    SELECT l.seed_id, l.rank, n.id, {_day('n.date')} AS date, n.headline, n.event_category AS category,
           n.significance_score AS significance FROM links l JOIN orders_n n ON l.id = n.id""",

    "entity_dossier": with_fixtures("orders_n", "entities", "postings") + f""", {_TIMELINE},
    picked AS (
        SELECT entity_id, n_notices, id AS notice_id, headline, event_category AS category,
               significance_score AS significance FROM (
            SELECT *, count(*) OVER (PARTITION BY entity_id) AS n_notices,
                   row_number() OVER (PARTITION BY entity_id ORDER BY coalesce(significance_score, -1) DESC,
                                      date DESC NULLS LAST, id DESC) AS r FROM timelines) WHERE r = 1),
    """ + _RELATED.format(seeds="AND a.id IN (SELECT notice_id FROM picked)") + """
    SELECT p.*, l.rank AS related_rank, l.id AS related_id
    FROM picked p LEFT JOIN links l ON l.seed_id = p.notice_id""",

    "corpus_totals": with_fixtures("orders_n") + f"""
    SELECT count(*) AS notice_count, {_day('min(date)')} AS oldest, {_day('max(date)')} AS newest
    FROM orders_n""",

    "notices_per_year": with_fixtures("docs") + """
    SELECT year(date) AS year, count(*) AS count FROM docs WHERE date IS NOT NULL GROUP BY 1""",

    "stats_document": with_fixtures("docs") + f""",
    years AS (SELECT year(date) AS y, count(*) AS n FROM docs WHERE date IS NOT NULL GROUP BY 1)
    SELECT '{{"notice_count":' || (SELECT count(*) FROM docs) || ',"oldest":"' ||
           (SELECT {_day('min(date)')} FROM docs) || '","newest":"' || (SELECT {_day('max(date)')} FROM docs)
           || '","yearly":[' || (SELECT string_agg('{{"year":' || y || ',"count":' || n || '}}', ',' ORDER BY y)
           FROM years) || ']}}' AS document""",

    "upserted_notices": with_fixtures("docs") + """
    SELECT id, title || ' v2' AS title, '1' AS nzbn, 'new' AS source,
           CASE WHEN significance_score IS NOT NULL THEN event_category END AS event_category,
           CASE WHEN significance_score IS NOT NULL THEN '2020-01-01' ELSE '2024-05-05' END AS loaded_at,
           CASE WHEN significance_score IS NOT NULL THEN '2020-01-02' END AS enriched_at FROM docs""",

    "rule_annotations": with_fixtures("notices") + f""", {_RULED}
    SELECT id, title AS headline, title || ': ' || category || ', ' || action AS plain_english,
           category AS event_category, action AS action_taken, title AS parties, rule_score AS score,
           'by notice type' AS significance_reason FROM ruled""",

    "journaled_annotations": with_fixtures("notices") + f""", {_RULED}
    SELECT id, title AS headline, category AS event_category,
           CAST(CASE WHEN length(coalesce(title, '')) % 5 = 0 THEN 2 ELSE 1 END AS BIGINT) AS tries FROM ruled""",

    "annotation_write_back": with_fixtures("docs") + f""", {_ANSWERS}
    SELECT d.id, CASE WHEN fill THEN a.headline ELSE d.headline END AS headline,
           CASE WHEN fill THEN a.event_category ELSE d.event_category END AS event_category,
           CAST(CASE WHEN fill THEN a.score ELSE d.significance_score END AS BIGINT) AS score,
           CASE WHEN fill THEN '2024-05-05' WHEN doc_id % 3 = 0 THEN '2020-01-02' END AS enriched_at
    FROM (SELECT d.*, doc_id % 3 <> 0 AND a.id IS NOT NULL AS fill
          FROM docs d LEFT JOIN annotations a ON d.id = a.id WHERE significance_score IS NOT NULL) d
    LEFT JOIN annotations a ON d.id = a.id""",

    "incremental_update": with_fixtures("notices") + f""", {_RULED}
    SELECT id, code, type, {_day('date')} AS date, title, nzbn, company_number,
           category AS event_category, rule_score AS score, CAST(64 AS BIGINT) AS dim,
           len(regexp_extract_all(lower(title || ' ' || fulltext), {WORDS})) AS n_tokens FROM ruled""",

    "reloaded_notices": with_fixtures("notices") + f"""
    SELECT id, code, type, {_day('date')} AS date, title, nzbn, company_number,
           md5(fulltext) AS fulltext_md5, '{SOURCE_STAMP}' AS source FROM notices""",

    "window_hits": f"""WITH {_LOG}
    SELECT 'ip_minute' AS kind, ip, strftime(ts, '%Y-%m-%dT%H:%M') AS "window", count(*) AS hits
    FROM log GROUP BY ALL
    UNION ALL SELECT 'ip_day', ip, strftime(ts, '%Y-%m-%d') AS d, count(*) FROM log GROUP BY ip, d
    UNION ALL SELECT 'day', '*', strftime(ts, '%Y-%m-%d') AS d, count(*) FROM log GROUP BY d""",

    "rate_decisions": _decisions(200),

    "run_summary": with_fixtures("citations") + """
    SELECT s.run_id, n_steps, coalesce(n_sources, 0) AS n_sources, coalesce(n_reads, 0) AS n_reads
    FROM (SELECT conv_id AS run_id, count(*) FILTER (trim(text) <> '') AS n_steps
          FROM conversations GROUP BY 1) s
    LEFT JOIN (SELECT run_id, count(DISTINCT id) AS n_sources, count(*) AS n_reads
               FROM citations GROUP BY 1) c ON s.run_id = c.run_id""",

    "first_citations": with_fixtures("citations") + """
    SELECT run_id, id, min(step) AS first_step FROM citations GROUP BY run_id, id""",

    "stream_window_hits": f"""WITH {_LOG}
    SELECT strftime(ts, '%Y-%m-%d %H') AS hour, ip, count(*) AS hits FROM log GROUP BY ALL""",

    "stream_rate_decisions": _decisions(None).replace("%Y-%m-%d %H", "%Y-%m-%d %H:%M"),

    "stream_request_log": f"""WITH {_LOG}
    SELECT strftime(ts, '%Y-%m-%d') AS day, substr(sha256('salt' || ip), 1, 16) AS ip_hash,
           count(*) AS n FROM log GROUP BY ALL""",
}
