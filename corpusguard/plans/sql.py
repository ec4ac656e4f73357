"""SQL for DuckDB that gives the same rows as the registered queries."""

from __future__ import annotations

from corpusguard.operators.detect import fingerprint
from corpusguard.operators.ledger import ANY_TARGET, BUDGET_REASON, GONE, PHASE_STATES, WORK_STATES
from corpusguard.operators.paths import EXCLUDED_PATHS
from corpusguard.operators.rules import ENTROPY_ABOVE, GENERIC_TOKEN, LEAST_DIGITS, PORTABLE, ruleset_version
from corpusguard.plans.planted import findings_sql, lines_sql
from corpusguard.plans.queries import AS_OF, QUERY_KEY

SQL: dict[str, str] = {}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SQL["entropy_by_lang"] = f"""
WITH tokens AS (
  SELECT lang, source, doc_id, unnest(regexp_extract_all(text, '{GENERIC_TOKEN}')) AS token FROM documents
),
numbered AS (SELECT *, row_number() OVER () AS k FROM tokens WHERE length(regexp_replace(token, '[^0-9]', '', 'g')) >= {LEAST_DIGITS}),
chars AS (SELECT k, lang, source, length(token) AS n, unnest(string_split(token, '')) AS c FROM numbered),
counts AS (SELECT k, lang, source, n, c, count(*) AS m FROM chars GROUP BY ALL),
bits AS (SELECT k, lang, source, -sum(m / n * log2(m / n)) AS h FROM counts GROUP BY ALL)
SELECT lang, source, count(*) AS n, count(*) FILTER (h > {ENTROPY_ABOVE}) AS n_high, sum(h) AS bits FROM bits GROUP BY lang, source
"""

SQL["rule_hits_by_source"] = (
    f"WITH {lines_sql()} SELECT source, rule_id, CAST(sum(n) AS BIGINT) AS n FROM ("
    + " UNION ALL ".join(f"SELECT source, {_quoted(name)} AS rule_id, coalesce(len(regexp_extract_all(whole, {_quoted(p)})), 0) AS n FROM texts" for name, p in PORTABLE.items())
    + ") GROUP BY source, rule_id"
)

# The documents themselves hold no token; what the lines hold is known.
_FOUND = f"WITH {lines_sql()}, {findings_sql(lambda value: fingerprint(value, QUERY_KEY))}"
SQL["detect_findings"] = f"""{_FOUND}
SELECT doc_id, source, rule_id, CAST(length(text) + 1 + a AS INTEGER) AS span_start, CAST(length(text) + 1 + b AS INTEGER) AS span_end,
  CAST(length(text) - length(replace(text, chr(10), '')) + 2 AS INTEGER) AS line_no, context_name, fingerprint, CAST(b - a AS INTEGER) AS value_len, 'path' AS origin, 'unknown' AS triage
FROM texts JOIN found USING (slot, variant) WHERE text IS NOT NULL
"""
SQL["findings_by_rule"] = f"{_FOUND} SELECT rule_id, count(*) AS n, count(DISTINCT fingerprint) AS n_values FROM texts JOIN found USING (slot, variant) WHERE text IS NOT NULL GROUP BY rule_id"
_REDACTED = "CASE WHEN redacted IS NULL THEN text ELSE text || chr(10) || redacted || chr(10) END"
SQL["redact_documents"] = f"WITH {lines_sql()} SELECT doc_id, lang, source, {_REDACTED} AS text, CASE WHEN text IS NULL THEN 0 ELSE coalesce(n, 0) END AS n_redacted FROM texts"
SQL["redact_by_function"] = f"WITH {lines_sql()} SELECT doc_id, CAST(n AS BIGINT) AS n, sha256({_REDACTED}) AS text_sha256 FROM texts WHERE n > 0 AND text IS NOT NULL"

SQL["excluded_paths"] = f"""
WITH cut AS (SELECT page_id, regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path FROM pages),
odd AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN '/vendor' || path WHEN page_id % 7 = 1 THEN path || '/App.Test.tsx' ELSE path END AS path FROM cut)
SELECT page_id, regexp_matches(path, {_quoted("|".join(f"(?:{p})" for p in EXCLUDED_PATHS))}, 'i') AS excluded FROM odd
"""

SQL["diff_parts"] = """
WITH d AS (SELECT doc_id, 'f' || doc_id || '.txt' AS f FROM documents)
SELECT doc_id, 0 AS part_no, '<commit-diff>' AS path, 'no header' AS part FROM d WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, 1, '<commit-diff>:' || f, chr(10) || '+one' || chr(10) FROM d WHERE doc_id % 3 <> 0
UNION ALL SELECT doc_id, 2, '<commit-diff>:' || f, chr(10) || '+two' || chr(10) FROM d WHERE doc_id % 3 <> 0
"""

SQL["merge_findings"] = """
WITH f AS (
  SELECT o_custkey AS source_id, o_orderpriority AS rule_id, o_orderstatus AS fingerprint,
    CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '<commit-diff>:' END || 'p' || o_orderkey AS path,
    CASE WHEN o_orderkey % 3 = 0 THEN 'path' ELSE 'diff' END AS origin, CAST(o_orderkey % 100 AS INTEGER) AS line_no,
    CAST(o_orderkey % 50 AS VARCHAR) AS seq_id, o_orderkey AS arrival, 1 - o_orderkey % 2 AS fresh
  FROM orders
),
place AS (
  SELECT *, row_number() OVER (PARTITION BY source_id, rule_id, fingerprint ORDER BY CASE origin WHEN 'path' THEN 0 ELSE 1 END, fresh, arrival) AS n FROM f
),
seen AS (SELECT source_id, rule_id, fingerprint, seq_id, min(fresh * 1000000000000 + arrival) AS first FROM f GROUP BY ALL),
lists AS (SELECT source_id, rule_id, fingerprint, string_agg(seq_id, ',' ORDER BY first) AS seen_in FROM seen GROUP BY ALL)
SELECT source_id, rule_id, fingerprint, path, origin, line_no, seen_in FROM place JOIN lists USING (source_id, rule_id, fingerprint) WHERE n = 1
"""

SQL["status_counts_zero_filled"] = """
SELECT CAST(v.position AS INTEGER) AS position, v.value, count(o.o_orderkey) AS n
FROM (VALUES (0, 'F'), (1, 'O'), (2, 'P'), (3, 'X')) v(position, value) LEFT JOIN orders o ON o.o_orderstatus = v.value
GROUP BY v.position, v.value
"""
SQL["count_by_type"] = "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1"
SQL["entity_options"] = """
SELECT c_custkey, min(c_name) AS c_name, count(*) AS count, count(*) FILTER (o_orderstatus = 'F') AS "F_count", count(*) FILTER (o_orderstatus = 'O') AS "O_count",
  count(*) FILTER (o_orderstatus IS NULL OR o_orderstatus NOT IN ('F', 'O')) AS unknown_count
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey
"""
SQL["top_entities"] = """
SELECT c_custkey, min(c_name) AS c_name, count(*) AS count FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey ORDER BY count DESC, c_custkey LIMIT 20
"""
SQL["cross_filter_facets"] = """
WITH r AS (SELECT n_name, o_orderstatus AS s, o_orderpriority AS p FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT 'n_name' AS facet, n_name AS value, count(*) AS n FROM r WHERE s IN ('F', 'P') AND p IN ('1-URGENT', '2-HIGH') GROUP BY 2
UNION ALL SELECT 'o_orderstatus', s, count(*) FROM r WHERE p IN ('1-URGENT', '2-HIGH') GROUP BY 2
UNION ALL SELECT 'o_orderpriority', p, count(*) FROM r WHERE s IN ('F', 'P') GROUP BY 2
"""
SQL["page_with_total"] = """
SELECT o_orderkey, o_orderdate, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS total
FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100 OFFSET 50
"""
SQL["free_text_search"] = """
SELECT c_custkey, 'slash' AS kind FROM customer WHERE lower(c_mktsegment) LIKE '%uild%' AND contains(lower(c_name), '00001')
UNION ALL SELECT c_custkey, 'plain' FROM customer WHERE contains(lower(c_mktsegment), 'machine') OR contains(lower(c_name), 'machine')
UNION ALL SELECT c_custkey, 'none' FROM customer WHERE contains(lower(c_mktsegment), 'y%') OR contains(lower(c_name), 'y%')
"""
_SCOPE = """
WITH grants AS (SELECT DISTINCT lower(c_mktsegment) AS owner, lower(c_name) AS name FROM customer WHERE c_custkey % 5 = 0),
r AS (SELECT o_orderkey, c_mktsegment AS owner, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey)
"""
SQL["scope_semi_join"] = _SCOPE + "SELECT owner, count(*) AS n FROM r WHERE EXISTS (SELECT 1 FROM grants g WHERE g.owner = lower(r.owner) AND g.name = lower(r.name)) GROUP BY owner"
SQL["scope_without_grants"] = "SELECT CAST(0 AS BIGINT) AS n"
SQL["pending_anti_join"] = "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality IS NOT NULL AND toxic IS DISTINCT FROM 1)"
SQL["orphan_results"] = """
WITH s AS (SELECT l.doc_id + CASE WHEN l.doc_id % 10 = 0 THEN 1000000000 ELSE 0 END AS doc_id, source FROM labels l JOIN documents d USING (doc_id))
SELECT doc_id, source FROM s WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = s.doc_id AND d.source = s.source)
"""
SQL["counts_or_zero"] = """
SELECT c_custkey, count(o_orderkey) AS n, count(o_orderkey) FILTER (o_orderstatus = 'F') AS head, count(o_orderkey) FILTER (o_orderstatus = 'O') AS history
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey
"""
SQL["two_key_sort"] = """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN ts END AS finished_at, ts AS started_at FROM events
ORDER BY finished_at DESC NULLS LAST, started_at DESC NULLS LAST, event_id DESC LIMIT 200
"""
SQL["claim_oldest"] = "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 25"
SQL["deterministic_sample"] = "SELECT o_orderkey FROM orders ORDER BY sha256('17|' || o_orderkey), o_orderkey LIMIT 500"
SQL["first_source_wins"] = """
SELECT id, source, doc_id FROM (
  SELECT sha256(text) AS id, source, doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY source, doc_id) AS n FROM documents WHERE text IS NOT NULL
) WHERE n = 1
"""
SQL["union_of_sources"] = """
SELECT 'documents' AS source, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM documents
UNION ALL SELECT 'pages', count(*), CAST(sum(page_id) AS BIGINT) FROM pages
UNION ALL SELECT 'benchmark', count(*), CAST(sum(item_id) AS BIGINT) FROM benchmark
"""
SQL["last_write_wins"] = """
SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1
"""
SQL["json_field_filter"] = "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50"
SQL["named_event_lines"] = """
SELECT event_id AS source_id, 'own' || user_id AS owner, 'n/' || event_type AS name FROM events WHERE event_id % 3 <> 0 AND event_id % 4 <> 0 AND event_id % 5 <> 0
"""
SQL["json_strings"] = "SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE c_mktsegment || '|x' END AS strings FROM customer"
SQL["collapsed_text"] = r"SELECT doc_id, substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 200) AS text FROM documents"
SQL["unicode_words"] = r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+')) AS n FROM documents"
SQL["url_hosts"] = r"""
WITH h AS (SELECT page_id, nullif(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '') AS host FROM pages)
SELECT page_id, host, host = 'example.com' OR host LIKE '%.example.com' AS inside FROM h
"""
SQL["urls_in_pages"] = "SELECT page_id, CAST(2 AS BIGINT) AS n FROM pages"
SQL["exact_dup_groups"] = """
SELECT sha256(text) AS id, count(*) AS n, min(doc_id) AS first, count(DISTINCT lang) AS langs FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1
"""
SQL["corpus_checksum"] = """
WITH m AS (SELECT md5(doc_id || '|' || coalesce(text, '')) AS d FROM documents)
SELECT count(*) AS n, CAST(sum(CAST('0x' || substr(d, 1, 8) AS BIGINT)) AS BIGINT) AS part0, CAST(sum(CAST('0x' || substr(d, 9, 8) AS BIGINT)) AS BIGINT) AS part1 FROM m
"""

_MAIL_SOURCE = """
list_extract(['nazario-2022', 'nazario-2024', 'phishing-pot', 'trec05', 'trec07', 'spamassassin-easy_ham', 'spamassassin-easy_ham_2', 'spamassassin-hard_ham', 'other'], CAST(doc_id % 9 AS INTEGER) + 1)
"""
SQL["source_split_case"] = f"""
WITH s AS (SELECT doc_id, {_MAIL_SOURCE} AS m FROM documents)
SELECT doc_id,
  CASE WHEN m IN ('nazario-2024', 'phishing-pot', 'trec05') THEN 'test' WHEN m = 'nazario-2022' OR m LIKE 'spamassassin-%' THEN 'validation' ELSE 'train' END AS a,
  CASE WHEN m IN ('nazario-2024', 'phishing-pot', 'trec05', 'trec07') THEN 'test' WHEN m IN ('nazario-2022', 'spamassassin-hard_ham') THEN 'validation' ELSE 'train' END AS b,
  CASE WHEN m IN ('nazario-2024', 'phishing-pot', 'trec05', 'spamassassin-hard_ham') THEN 'test' WHEN m IN ('nazario-2022', 'spamassassin-easy_ham_2') THEN 'validation' ELSE 'train' END AS c,
  CASE WHEN m LIKE 'nazario-20%' THEN right(m, 4) WHEN m LIKE 'trec0%' THEN '20' || right(m, 2) WHEN m LIKE 'spamassassin-%' THEN '2003' ELSE 'unknown' END AS year
FROM s
"""

_HASHED = f"""
b AS (
  SELECT *, CAST('0x' || substr(md5(CAST(doc_id % 150 AS VARCHAR)), 1, 15) AS BIGINT) AS common, doc_id // 150 AS k, {_MAIL_SOURCE} AS mail_source FROM documents
),
m AS (
  SELECT xor(xor(common, CAST(1 AS BIGINT) << CAST(k * 7 % 60 AS BIGINT)), CAST(1 AS BIGINT) << CAST(k * 13 % 60 AS BIGINT)) AS simhash, mail_source AS source, printf('%012d', doc_id) AS source_id,
    CASE WHEN doc_id % 10 = 3 THEN 'phishing' ELSE 'ham' END AS label FROM b
),
h AS (SELECT DISTINCT simhash FROM m),
links AS (SELECT x.simhash AS a, y.simhash AS b FROM h x, h y WHERE x.simhash <> y.simhash AND bit_count(xor(x.simhash, y.simhash)) <= 3),
reach(a, b) AS (SELECT simhash, simhash FROM h UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
c AS (SELECT m.*, md5(CAST(m.simhash AS VARCHAR)) AS id, x.cluster FROM m JOIN (SELECT a AS simhash, min(b) AS cluster FROM reach GROUP BY a) x USING (simhash))
"""
_KEPT = """
s AS (
  SELECT *, CASE WHEN source IN ('nazario-2024', 'phishing-pot', 'trec05', 'trec07') THEN 'test' WHEN source IN ('nazario-2022', 'spamassassin-hard_ham') THEN 'validation' ELSE 'train' END AS split,
    count(DISTINCT label) OVER (PARTITION BY cluster) AS labels, count(*) OVER (PARTITION BY cluster) AS size FROM c
),
kept AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY CASE split WHEN 'test' THEN 1 WHEN 'validation' THEN 2 ELSE 3 END, source, source_id) AS n FROM s WHERE labels = 1) WHERE n = 1
),
lost AS (
  SELECT reason, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT DISTINCT cluster, CASE WHEN labels > 1 THEN 'conflicting_label' ELSE 'duplicate' END AS reason, CASE WHEN labels > 1 THEN size ELSE size - 1 END AS n FROM s
  ) WHERE n > 0 GROUP BY reason
)
"""
SQL["near_duplicate_clusters"] = f"WITH RECURSIVE {_HASHED} SELECT source_id, simhash, cluster FROM c"
SQL["split_of_hashes"] = f"WITH RECURSIVE {_HASHED}, {_KEPT} SELECT id, source, source_id, label, split FROM kept"
SQL["split_exclusions"] = f"WITH RECURSIVE {_HASHED}, {_KEPT} SELECT reason, n FROM lost"


def _json_counts(key: str, rows: str) -> str:
    return f"(SELECT '{{' || string_agg('\"' || k || '\":' || n, ',' ORDER BY k) || '}}' FROM (SELECT {key} AS k, {rows}))"


SQL["split_manifest"] = f"""
WITH RECURSIVE {_HASHED}, {_KEPT}
SELECT 17 AS seed, 'trec07_in_test' AS split_policy, {_json_counts("source", "count(*) AS n FROM m GROUP BY source")} AS source_counts,
  {_json_counts("split", "count(*) AS n FROM kept GROUP BY split")} AS split_counts, {_json_counts("reason", "n FROM lost")} AS excluded
"""

_OUTCOMES = """
o AS (
  SELECT l.doc_id, lang, source, CASE WHEN quality = 0 THEN 'phishing' ELSE 'ham' END AS label,
    CASE WHEN toxic = 1 THEN 'suspicious' WHEN l.doc_id % 11 = 0 THEN 'review' WHEN l.doc_id % 13 = 0 THEN 'error' ELSE 'no_signals' END AS status
  FROM labels l JOIN documents d USING (doc_id)
)
"""
SQL["confusion_matrix"] = (
    "WITH"
    + _OUTCOMES
    + """
SELECT lang, label, count(*) FILTER (status = 'suspicious') AS suspicious, count(*) FILTER (status = 'review') AS review,
  count(*) FILTER (status = 'no_signals') AS no_signals, count(*) FILTER (status = 'error') AS error FROM o GROUP BY lang, label
"""
)


def _wilson(name: str, s: str, n: str) -> str:
    z = "1.959963984540054"
    p = f"({s} / nullif({n}, 0))"
    centre = f"({p} + {z} * {z} / (2 * {n})) / (1 + {z} * {z} / {n})"
    spread = f"{z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4 * {n} * {n})) / (1 + {z} * {z} / {n})"
    return f"CASE WHEN {n} > 0 THEN greatest(0.0, {centre} - {spread}) END AS {name}_low, CASE WHEN {n} > 0 THEN least(1.0, {centre} + {spread}) END AS {name}_high"


_RATES = [*"recall fpr precision specificity f1 balanced_accuracy strict_accuracy review_rate error_rate".split(), *(f"{r}_{e}" for r in ("recall", "fpr", "precision", "specificity") for e in ("low", "high"))]


def _summary(groups: str, rows: str) -> str:
    by = f"{groups}, " if groups else ""
    rounded = ", ".join(f"round({r}, 9) AS {r}" for r in _RATES)
    return f"""
WITH {_OUTCOMES},
c AS (
  SELECT {by}count(*) FILTER (label = 'phishing') AS phishing, count(*) FILTER (label = 'ham') AS ham,
    count(*) FILTER (label = 'phishing' AND status = 'suspicious') AS tp, count(*) FILTER (label = 'ham' AND status = 'suspicious') AS fp,
    count(*) FILTER (label = 'ham' AND status = 'no_signals') AS tn, count(*) FILTER (status = 'review') AS review, count(*) FILTER (status = 'error') AS errors
  FROM ({rows}) {f"GROUP BY {groups}" if groups else ""}
),
r AS (SELECT *, tp / nullif(phishing, 0) AS recall, fp / nullif(ham, 0) AS fpr, tp / nullif(tp + fp, 0) AS precision, tn / nullif(ham, 0) AS specificity FROM c)
SELECT {by}phishing, ham, tp, fp, tn, review, errors, {rounded} FROM (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) END AS f1, (recall + specificity) / 2 AS balanced_accuracy,
  (tp + tn) / nullif(phishing + ham, 0) AS strict_accuracy, review / nullif(phishing + ham, 0) AS review_rate, errors / nullif(phishing + ham, 0) AS error_rate,
  {_wilson("recall", "tp", "phishing")}, {_wilson("fpr", "fp", "ham")}, {_wilson("precision", "tp", "(tp + fp)")}, {_wilson("specificity", "tn", "ham")}
FROM r)
"""


SQL["confusion_metrics"] = _summary("", "SELECT * FROM o")
SQL["grouped_metrics"] = _summary(
    "grouping, value", "SELECT 'all' AS grouping, '' AS value, label, status FROM o UNION ALL SELECT 'lang', lang, label, status FROM o UNION ALL SELECT 'source', source, label, status FROM o"
)
SQL["class_weights"] = "SELECT quality AS label, count(*) AS n, (SELECT count(quality) FROM labels) / ((SELECT count(DISTINCT quality) FROM labels) * count(*)) AS weight FROM labels WHERE quality IS NOT NULL GROUP BY quality"
_TIMED = "t AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value >= 0 AND value < 120000)"
SQL["latency_p95_lower_index"] = f"""
WITH {_TIMED}
SELECT event_type, quantile_cont(value, 0.5) AS median, count(*) AS n,
  max(value) FILTER (k = CAST(floor((n - 1) * 0.95) AS BIGINT) + 1) AS p95, max(value) FILTER (k = CAST(floor((n - 1) * 0.99) AS BIGINT) + 1) AS p99
FROM t GROUP BY event_type
"""
SQL["latency_p95_overall"] = """
WITH t AS (SELECT value, row_number() OVER (ORDER BY value) AS k, count(*) OVER () AS n FROM events WHERE value >= 0 AND value < 120000)
SELECT max(value) AS p95 FROM t WHERE k = CAST(floor((n - 1) * 0.95) AS BIGINT) + 1
"""
SQL["cost_totals"] = """
SELECT sum(CASE WHEN event_id % 6 <> 0 THEN coalesce(value, 0.0) ELSE 0.0 END) AS cost, max(value) FILTER (event_id % 6 <> 0 AND event_id % 10 <> 0) AS slowest,
  count(*) FILTER (event_id % 10 = 0) AS failed FROM events
"""
SQL["mail_assessment"] = """
WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host FROM pages),
m AS (
  SELECT page_id, page_id % 5 = 0 AS credential, page_id % 2 = 1 AND NOT (host = 'example.org' OR host LIKE '%.example.org') AS foreign_link, page_id % 4 = 0 AND host <> 'other.example' AS mislabelled,
    page_id % 6 = 0 AS truncated, CASE WHEN page_id % 7 = 0 THEN 'review' WHEN page_id % 7 = 1 THEN 'error' ELSE 'no_signals' END AS choice FROM h
),
s AS (
  SELECT *, CASE WHEN choice = 'error' THEN 'error' WHEN mislabelled THEN 'suspicious' WHEN choice = 'no_signals' AND (credential OR truncated) THEN 'review' ELSE choice END AS status,
    concat_ws(',', CASE WHEN credential THEN 'credential_request' END, CASE WHEN foreign_link THEN 'sender_link_domain_mismatch' END, CASE WHEN mislabelled THEN 'link_label_mismatch' END) AS observations FROM m
)
SELECT page_id, observations, status, CAST(1 + truncated::INT + (choice = 'review')::INT + (observations = '')::INT AS BIGINT) AS n_limitations FROM s
"""

_WORK = f"""
w AS (
  SELECT o_orderkey AS source_id, list_extract([{", ".join(map(_quoted, WORK_STATES))}], CAST(o_orderkey % 5 AS INTEGER) + 1) AS status,
    CAST(o_orderkey % 3 AS INTEGER) AS epoch, o_orderkey % 7 AS retry, CAST(o_orderdate AS TIMESTAMP) AS started_at,
    CASE WHEN o_orderkey % 4 = 0 THEN '{GONE}' WHEN o_orderkey % 4 = 1 THEN 'time' END AS reason
  FROM orders
)
"""


def _by_status(status: str, epoch: str = "epoch", extra: str = "") -> str:
    return f"WITH {_WORK}{extra} SELECT status, epoch, count(*) AS n, CAST(sum(source_id) AS BIGINT) AS ids FROM (SELECT {status} AS status, {epoch} AS epoch, source_id FROM w) GROUP BY status, epoch"


SQL["ledger_requeue_stale"] = _by_status("CASE WHEN status = 'in_progress' AND started_at < TIMESTAMP '1995-12-31 23:00:00' THEN 'pending' ELSE status END")
SQL["ledger_requeue_failed"] = _by_status(f"CASE WHEN status = 'failed' AND retry < 3 AND reason <> '{GONE}' THEN 'pending' ELSE status END")
SQL["ledger_cancel_before"] = _by_status("CASE WHEN epoch < 2 AND status IN ('pending', 'in_progress') THEN 'cancelled' ELSE status END")
_CLAIMED = ", claimed AS (SELECT source_id FROM w WHERE status = 'pending' AND epoch <= 1 ORDER BY CASE WHEN started_at IS NULL THEN 0 ELSE 1 END, source_id LIMIT 100)"
_IN = "source_id IN (SELECT source_id FROM claimed)"
SQL["ledger_claim"] = _by_status(f"CASE WHEN {_IN} THEN 'in_progress' ELSE status END", f"CASE WHEN {_IN} THEN 1 ELSE epoch END", _CLAIMED)
SQL["ledger_seed_phases"] = f"""
WITH {_WORK} SELECT phase, 'done' AS status, count(*) AS n, CAST(sum(source_id) AS BIGINT) AS ids FROM w, (VALUES ('head'), ('history')) p(phase) WHERE w.status = 'done' GROUP BY phase
"""
SQL["incremental_rows"] = f"""
WITH m AS (SELECT o_orderkey AS source_id, o_orderkey % 1000 AS mark FROM orders WHERE o_orderkey % 5 = 2 AND CASE WHEN o_orderkey % 10 = 2 THEN {_quoted(ruleset_version())} ELSE 'old' END = {_quoted(ruleset_version())})
SELECT l_orderkey AS source_id, count(*) AS n FROM lineitem LEFT JOIN m ON m.source_id = l_orderkey WHERE mark IS NULL OR l_partkey % 1000 > mark GROUP BY l_orderkey
"""
SQL["ledger_claimable"] = f"""WITH {_WORK} SELECT source_id, '1' AS target FROM w WHERE source_id % 2 = 0 AND epoch = 1 AND status <> 'cancelled'"""
SQL["queue_status"] = f"""WITH {_WORK} SELECT count(*) FILTER (status = 'pending' AND started_at IS NULL) AS "new", count(*) FILTER (status = 'pending' AND started_at IS NOT NULL) AS again,
  {", ".join(f"count(*) FILTER (status = '{x}') AS {x}" for x in WORK_STATES)} FROM w"""
_PHASES = f"""
p AS (
  SELECT o_orderkey AS source_id, phase, list_extract([{", ".join(map(_quoted, PHASE_STATES))}], CAST(o_orderkey % 6 AS INTEGER) + 1) AS status,
    CASE WHEN o_orderkey % 5 = 0 THEN '{ANY_TARGET}' ELSE CAST(o_orderkey % 4 + 1 AS VARCHAR) END AS target, CASE WHEN o_orderkey % 6 = 2 THEN '0' END AS completed, CAST(o_orderkey % 3 AS INTEGER) AS epoch
  FROM orders, (VALUES ('head'), ('history')) n(phase)
),
few AS (SELECT w.* FROM w WHERE source_id <= 64)
"""
SQL["phase_lookup"] = f"""
WITH {_WORK}, {_PHASES}, q AS (SELECT * FROM p WHERE source_id % 7 <> 0 AND NOT (phase = 'history' AND source_id % 4 = 1))
SELECT w.source_id, h.status AS head_status, h.completed AS head_completed, y.status AS history_status, y.completed AS history_completed
FROM w LEFT JOIN (SELECT * FROM q WHERE phase = 'head') h USING (source_id) LEFT JOIN (SELECT * FROM q WHERE phase = 'history') y USING (source_id)
"""
SQL["ledger_add"] = f"""
WITH {_WORK}, new AS (SELECT DISTINCT l_orderkey + CASE WHEN l_linenumber = 1 THEN 0 ELSE 1000000 END AS source_id FROM lineitem),
both_ AS (SELECT status, epoch, source_id FROM w UNION ALL SELECT 'pending', 0, source_id FROM new WHERE source_id NOT IN (SELECT source_id FROM w))
SELECT status, epoch, count(*) AS n, CAST(sum(source_id) AS BIGINT) AS ids FROM both_ GROUP BY ALL
"""
# Of the source: an older or equal epoch, and not cancelled in this one; of the phase: the
# same, unless the source is at work in this epoch.
SQL["ledger_schedule"] = f"""
WITH {_WORK}, {_PHASES},
x AS (SELECT p.*, few.epoch AS we, few.status AS ws FROM p JOIN few USING (source_id)),
hit AS (
  SELECT *, phase = 'head' AND source_id IN (1, 2, 3, 4, 5, 6, 7, 32, 33, 34, 35, 36, 37, 38, 39, 64) AND epoch <= 1 AND we <= 1 AND NOT (we = 1 AND ws = 'cancelled')
    AND NOT (epoch = 1 AND status = 'cancelled' AND NOT (we = 1 AND ws = 'in_progress')) AS h FROM x
)
SELECT source_id, phase, CASE WHEN h THEN 'pending' ELSE status END AS status, CASE WHEN h THEN '9' ELSE target END AS target, CASE WHEN h THEN 1 ELSE epoch END AS epoch FROM hit
"""
SQL["ledger_claim_phase"] = f"""
WITH {_WORK}, {_PHASES},
hit AS (
  SELECT p.*, p.phase = 'head' AND p.source_id IN (1, 2, 3, 4, 5, 6, 7, 32, 33, 34, 35, 36, 37, 38, 39, 64) AND p.status = 'pending' AND p.target <> '{ANY_TARGET}' AND few.status <> 'cancelled' AS h
  FROM p JOIN few USING (source_id)
)
SELECT source_id, phase, CASE WHEN h THEN 'running' ELSE status END AS status, CASE WHEN h THEN TIMESTAMP '{AS_OF}' END AS started_at FROM hit
"""
SQL["ledger_finish_phase"] = f"""
WITH {_WORK}, {_PHASES},
hit AS (
  SELECT p.source_id, p.status, p.completed, few.status AS ws, few.retry AS wr, few.watermark AS wm,
    p.source_id IN (1, 2, 3, 4, 5, 6, 7, 32, 33, 34, 35, 36, 37, 38, 39, 64) AND p.status = 'running' AS h, p.source_id % 2 = 1 AS good
  FROM p JOIN (SELECT w.*, CASE WHEN status = 'done' THEN CAST(source_id % 1000 AS VARCHAR) END AS watermark FROM w WHERE source_id <= 64) few USING (source_id) WHERE p.phase = 'head'
)
SELECT source_id, CASE WHEN h THEN CASE WHEN good THEN 'done' ELSE 'failed' END ELSE status END AS status, CASE WHEN h AND good THEN '9' ELSE completed END AS completed,
  CAST(h AND NOT good AS INTEGER) AS tries, CASE WHEN h AND ws <> 'cancelled' THEN CASE WHEN good THEN 'done' ELSE 'failed' END ELSE ws END AS work_status,
  CASE WHEN h AND good AND ws <> 'cancelled' THEN '9' ELSE wm END AS watermark, CAST(wr + (h AND NOT good AND ws <> 'cancelled')::INT AS INTEGER) AS work_tries FROM hit
"""
SQL["ledger_control"] = """
SELECT CAST(step AS INTEGER) AS step, action, state, CAST(epoch AS INTEGER) AS epoch FROM (VALUES
  (0, 'admit', 'ready', 0), (1, 'stop', 'stopping', 1), (2, 'stop', 'stopping', 1), (3, 'finish', 'stopping', 1),
  (4, 'finish', 'stopped', 1), (5, 'admit', 'ready', 1), (6, 'stop', 'stopping', 2), (7, 'finish', 'stopped', 2)) v(step, action, state, epoch)
"""
SQL["scan_budget"] = f"""
WITH r AS (SELECT l_suppkey AS source_id, sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber RANGE UNBOUNDED PRECEDING) AS upto FROM lineitem)
SELECT source_id, CASE WHEN max(upto) > 15000 THEN 'incomplete' ELSE 'done' END AS status, CASE WHEN max(upto) > 15000 THEN '{BUDGET_REASON}' END AS reason, count(*) FILTER (upto <= 15000) AS scanned FROM r GROUP BY source_id
"""
SQL["scoped_rescan"] = f"""{_FOUND},
k AS (
  SELECT DISTINCT CAST(regexp_extract(source, '[0-9]+') AS BIGINT) AS source_id, 'aws_access_key_id' AS rule_id, 'p' || doc_id AS fingerprint FROM documents WHERE doc_id % 2 = 0
  UNION SELECT CAST(regexp_extract(source, '[0-9]+') AS BIGINT), rule_id, fingerprint FROM texts JOIN found USING (slot, variant)
    WHERE text IS NOT NULL AND CAST(regexp_extract(source, '[0-9]+') AS BIGINT) = 3 AND rule_id IN ('aws_access_key_id', 'aws_secret_access_key')
)
SELECT source_id, rule_id, CASE WHEN source_id = 3 THEN 'unknown' ELSE 'valid' END AS triage, count(*) AS n FROM k GROUP BY ALL
"""
SQL["frozen_list_mismatches"] = """
WITH f AS (SELECT o_orderkey AS position, CASE WHEN o_orderkey % 90 = 5 THEN -o_custkey ELSE o_custkey END AS id FROM orders WHERE o_orderkey % 100 <> 7)
SELECT coalesce(r.o_orderkey, f.position) AS position, r.o_custkey AS found, f.id AS expected
FROM (SELECT * FROM orders WHERE o_orderkey % 100 <> 9) r FULL JOIN f ON f.position = r.o_orderkey WHERE r.o_custkey IS DISTINCT FROM f.id
"""
SQL["sorted_customers"] = "SELECT c_custkey, c_mktsegment FROM customer ORDER BY lower(c_mktsegment) DESC, c_custkey DESC LIMIT 50"
SQL["windowed_events"] = "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2"
