"""DuckDB SQL of the operators whose results SQL can state."""

from __future__ import annotations

from poolscope.llm.lines import check_sql as line_dedup
from poolscope.llm.urls import check_sql as url_filters

WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = f"""
WITH RECURSIVE cut AS (SELECT doc_id, {WORDS.format(LOWERED)} AS ws FROM documents),
grams AS (SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(ws) >= 5 THEN [array_to_string(ws[i : i + 4], ' ') FOR i IN range(1, len(ws) - 3)]
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS gram FROM cut),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared s JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * s.n >= 75 * (a.n + b.n - s.n)),
reached AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reached r JOIN links l ON l.x = r.y),
least AS (SELECT x AS doc_id, min(y) AS component_id FROM reached GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)"""

SUBSTRINGS = f"""
WITH cut AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS ws FROM documents),
starts AS (SELECT doc_id, unnest([{{'spot': i, 'key': md5(array_to_string(ws[i : i + 49], ' '))}} FOR i IN range(1, len(ws) - 48)], recursive := true)
  FROM cut WHERE len(ws) >= 50),
earliest AS (SELECT key, min(doc_id) AS source FROM starts GROUP BY key),
gone AS (SELECT DISTINCT doc_id, spot + step AS place FROM starts JOIN earliest USING (key), range(0, 50) t(step) WHERE source < doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS place FROM cut),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS text FROM words ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM cut LEFT JOIN kept USING (doc_id)"""

TERMS = f"regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

LEXICAL = f"""
WITH docs AS (SELECT doc_id, {TERMS} AS ts FROM documents),
whole AS (SELECT count(*) FILTER (WHERE len(ts) > 0) AS docs, sum(len(ts))::BIGINT AS terms FROM docs),
asked AS (SELECT DISTINCT item_id, unnest({TERMS}) AS term FROM benchmark),
counted AS (SELECT doc_id, n, term, count(*) AS times FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counted, whole GROUP BY term, docs),
values_ AS (SELECT doc_id, term, w * ((1000000000 * times) // (1000 * times + 8 * (10 + (90 * n * docs) // terms))) AS points
  FROM counted JOIN weights USING (term), whole),
scored AS (SELECT item_id, doc_id, sum(points)::BIGINT AS score FROM asked JOIN values_ USING (term) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10"""

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

ORACLE_SQL = {
    "op2_jaccard_join": JACCARD,
    "op3_substring_dedup": SUBSTRINGS,
    "op5_line_dedup": line_dedup(),
    "op13_lexical_search": LEXICAL,
    "op11_url_filters": url_filters(URL_RULES),
}
