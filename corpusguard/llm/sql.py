"""SQL for DuckDB that gives the rows of the operators' queries by plain means."""

from __future__ import annotations

from corpusguard.llm import decontaminate, url_filter

_WORDS = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

#: All pairs that share a shingle, and every document reachable by links.
JACCARD_JOIN = f"""
WITH RECURSIVE cut AS (SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
placed AS (
  SELECT doc_id, unnest(list_transform(generate_series(1, greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM cut WHERE len(w) > 0
),
shingles AS (SELECT DISTINCT doc_id, s FROM placed),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, min(r.other) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN reach r USING (doc_id) GROUP BY d.doc_id, s.n
"""

#: Every window of every document.
SUBSTRING_DEDUP = f"""
WITH cut AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
windows AS (
  SELECT doc_id, unnest(generate_series(1, len(w) - 12)) AS i, unnest(list_transform(generate_series(1, len(w) - 12), lambda i: array_to_string(w[i:i + 12], ' '))) AS s
  FROM cut WHERE len(w) >= 13
),
firsts AS (SELECT s, min(doc_id) AS first FROM windows GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS i FROM windows JOIN firsts USING (s) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(w) AS x, unnest(generate_series(1, len(w))) AS i FROM cut WHERE len(w) > 0),
kept AS (
  SELECT doc_id, count(*) AS n_words, count(g.i) AS n_removed, string_agg(x, ' ' ORDER BY words.i) FILTER (g.i IS NULL) AS text
  FROM words LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM cut LEFT JOIN kept USING (doc_id)
"""

_GROUPS = ["CAST('0x' || substr(d, {}, 5) AS BIGINT)".format(5 * i + 1) for i in range(8)]
_DIGITS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(({g} >> {shift}) & 31 AS INTEGER) + 1, 1)" for g in _GROUPS for shift in (15, 10, 5, 0))

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d FROM pages),
f AS (SELECT page_id, html, d, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_DIGITS} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

ORACLE_SQL: dict[str, str] = {
    "op1_jaccard_join": JACCARD_JOIN,
    "op3_decontaminate": decontaminate.ORACLE,
    "op7_url_filter": url_filter.ORACLE,
    "op9_warc": WARC,
    "op10_substring_dedup": SUBSTRING_DEDUP,
}
