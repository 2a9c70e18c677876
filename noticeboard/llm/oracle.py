"""SQL counterparts of this package's queries, for those that SQL can express."""
from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = r"[^\x20\x09-\x0D]+"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

CONTROL = (r"\|(?:turn|text|end|image|audio|document|im_start|im_end|endoftext)\|>|/?s>|/?INST\]|/?SYS>>|<SYS>>"
           r"|<\/SYS>>")

ORACLE: dict[str, str] = {
    "op1_chat": rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'),
                                           (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
f AS (SELECT *, regexp_replace(text, '([<\[])(\\*)({CONTROL})', '\1\\\2\3', 'g') AS escaped FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(escaped) + length(role) + 23)::BIGINT AS formatted_chars, 0::BIGINT AS expanded_tokens
FROM f GROUP BY conv_id""",
    "op2_minhash": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle
      FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
          FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
          WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents
          UNION SELECT b.b, r.root FROM reach r JOIN both_ways b ON b.a = r.node WHERE r.root < b.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT node, min(root) AS component_id FROM reach GROUP BY node) r ON r.node = d.doc_id""",
    "op11_search": rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, text FROM documents),
t AS (SELECT r, unnest(regexp_extract_all({LOWER}, '{TERM}')) AS term FROM d),
tf AS (SELECT r, term, count(*) AS tf FROM t GROUP BY r, term),
n AS (SELECT r, sum(tf) AS n FROM tf GROUP BY r),
g AS (SELECT count(*) AS big_n, sum(n) AS big_l FROM n),
w AS (SELECT term, floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, g GROUP BY term, big_n),
q AS (SELECT item_id, unnest(regexp_extract_all({LOWER}, '{TERM}')) AS term FROM benchmark),
s AS (SELECT q.item_id, d.doc_id, d.r,
             sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (25 + (75 * n.n * g.big_n) // g.big_l))))::BIGINT AS score
      FROM q JOIN tf USING (term) JOIN w USING (term) JOIN n USING (r) JOIN d USING (r), g
      GROUP BY q.item_id, d.doc_id, d.r),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST, r) AS rank
      FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id::BIGINT AS doc_id, score FROM k WHERE rank <= 10""",
}
