"""SQL for the queries of ingest gates, threads, judgments and reports."""

from __future__ import annotations

from mailquarry.plans.oracle import ASK, AUTH, DATED, EMBEDDABLE, EVEN, LINKS, METRICS, PREDECESSORS, SPACE, M, bm25, embedded, strip, tokens

def _bare(c: str) -> str:
    """An address in lower case without angle brackets and white space at the ends."""
    return f"lower({strip(f"regexp_replace({strip(c)}, '^<+|>+$', '', 'g')")})"


def _clean(c: str) -> str:
    return f"list_distinct(list_filter(list_transform(coalesce({c}, []), lambda x: {_bare('x')}), lambda x: x <> ''))"


def _address(c: str) -> str:
    return f"coalesce({_bare(c)}, '')"


_PLAIN = lambda c: f"trim(regexp_replace(coalesce({c}, ''), '{SPACE}+', ' ', 'g'))"


def _ordered(c: str) -> str:
    """Distinct clean values in the order of their first place; a list function that makes distinct keeps no order."""
    return f"(SELECT coalesce(string_agg(v, ';' ORDER BY i), '') FROM (SELECT v, min(i) AS i FROM (SELECT unnest(l) AS v, generate_subscripts(l, 1) AS i FROM (SELECT list_filter(list_transform(coalesce({c}, []), lambda x: {_address('x')}), lambda x: x <> '') AS l)) GROUP BY v))"


_NORMAL = f"nz AS (SELECT id, {_address('from_addr')} AS sender, {_clean('to_addrs')} AS receivers, {_clean('cc_addrs')} AS copied FROM m)"
_LIVE = f"""r AS (SELECT id, arrival, {EMBEDDABLE} AS text FROM emails WHERE id IS NOT NULL), h AS (SELECT (min(arrival) + max(arrival)) // 2 AS h FROM r),
a AS (SELECT id, arg_max(text, arrival) AS text FROM r GROUP BY ALL), b AS (SELECT id, arg_max(text, arrival) AS old FROM r, h WHERE arrival <= h GROUP BY ALL)"""
_MEANS = METRICS + """, mn AS (SELECT method, count(query_id) AS queries, round(coalesce(avg(ndcg), 0), 4) AS ndcg, round(coalesce(avg(mrr), 0), 4) AS mrr, round(coalesce(avg(recall), 0), 4) AS recall FROM (SELECT unnest(['bm25', 'vector', 'hybrid', 'unjudged']) AS method) LEFT JOIN met USING (method) GROUP BY ALL)"""
_FULL = f"""{LINKS.split('links AS')[0].replace(M, '%s')}links AS (SELECT DISTINCT id, parent FROM a JOIN k USING (message_id) WHERE parent <> id)"""
_THREADED = f"""WITH RECURSIVE {PREDECESSORS}, {_FULL.replace('%s, ', '')}, every AS (FROM links UNION SELECT id, previous FROM pred),
hb AS (SELECT id AS u, parent AS v FROM links UNION SELECT parent, id FROM links), eb AS (SELECT id AS u, parent AS v FROM every UNION SELECT parent, id FROM every),
hr AS (SELECT id AS u, id AS v FROM m UNION SELECT hr.u, hb.v FROM hr JOIN hb ON hb.u = hr.v), er AS (SELECT id AS u, id AS v FROM m UNION SELECT er.u, eb.v FROM er JOIN eb ON eb.u = er.v),
hc AS (SELECT u AS id, min(v) AS component FROM hr GROUP BY ALL), ec AS (SELECT u AS id, min(v) AS component FROM er GROUP BY ALL)"""
_SWEEP = {
    "default subject^3": (3, 1, 1, 1), "subject^1 (no boost)": (1, 1, 1, 1), "subject^2": (2, 1, 1, 1), "subject^5": (5, 1, 1, 1), "subject^3 people^2": (3, 1, 2, 2), "subject^3 body^2": (3, 2, 1, 1), "no people fields": (3, 1, 0, 0),
}
_BOOSTS = ", ".join(f"('{c}', '{f}', {b}::DOUBLE)" for c, bs in _SWEEP.items() for f, b in zip(("subject", "body", "from", "to"), bs) if b)
_STAGE = """count(*) FILTER (status = 200) AS n, round(avg({v}) FILTER (status = 200), 1) AS mean, round(quantile_disc({v}, 0.5) FILTER (status = 200), 1) AS p50, round(quantile_disc({v}, 0.95) FILTER (status = 200), 1) AS p95, round(quantile_disc({v}, 0.99) FILTER (status = 200), 1) AS p99, round(max({v}) FILTER (status = 200), 1) AS most, round(avg(CASE WHEN status = 200 THEN 1.0 ELSE 0.0 END), 6) AS success"""
_FIRST_TWO = "round(coalesce(max(x) FILTER (dim = 0), 0), 6) AS v0, round(coalesce(max(x) FILTER (dim = 1), 0), 6) AS v1"

SQL: dict[str, str] = {
    "normalised": f"WITH {M} SELECT id, {_address('from_addr')} AS sender, {_ordered('to_addrs')} AS receivers, {_ordered('cc_addrs')} AS copied, {_PLAIN('from_name')} AS name, {_PLAIN('subject')} AS subject, {_address('from_addr')} AS person_id FROM m",
    "stage_counts": f"WITH {M}, {_NORMAL}, c AS (SELECT count(*) AS p, count(*) FILTER (sender = '') AS f, count(*) FILTER (len(receivers) + len(copied) = 0) AS r FROM nz) SELECT 'normalise' AS stage, 'processed' AS counter, p AS n FROM c UNION ALL SELECT 'normalise', 'reason: from-missing', f FROM c UNION ALL SELECT 'normalise', 'reason: no-recipients', r FROM c",
    "bulk_counts": "SELECT 'bulk' AS stage, 'processed' AS counter, count(*) AS n FROM emails UNION ALL SELECT 'bulk', 'reason: bulk:missing_id', count(*) FILTER (id IS NULL) FROM emails UNION ALL SELECT 'bulk', 'reason: bulk:version_conflict', count(id) - count(DISTINCT id) FROM emails",
    "iso_dates": f"WITH {M} SELECT id, epoch_us(TRY_CAST(CASE WHEN regexp_full_match(date_text, '\\d{{4}}-\\d{{2}}-\\d{{2}}[T ]\\d{{2}}:\\d{{2}}:\\d{{2}}(\\.\\d{{1,6}})?(Z|[+-]\\d{{2}}:\\d{{2}})') THEN date_text END AS TIMESTAMPTZ)) AS us FROM m",
    "extract_mailboxes": f"WITH {M} SELECT id, mailbox FROM m WHERE mailbox IN (SELECT mailbox FROM mailboxes WHERE date_order = 'dmy')",
    "exact_selection": f"WITH {M} SELECT id, mailbox, row_number() OVER (ORDER BY sha1(mailbox), mailbox, id) AS position FROM m WHERE mailbox IS NOT NULL QUALIFY position <= 700",
    "index_projection": f"WITH {M} SELECT id, nullif(subject, '') AS subject, nullif(from_addr, '') AS from_addr, CASE WHEN len(to_addrs) > 0 THEN array_to_string(to_addrs, ';') END AS to_addrs, CASE WHEN len(cc_addrs) > 0 THEN array_to_string(cc_addrs, ';') END AS cc_addrs, has_attachment FROM m",
    "line_count": "SELECT count(*) AS n FROM emails",
    "spot_check": f"""WITH {M}, {_NORMAL}, s AS (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY arrival, id) - 1 AS n, greatest(1, count(*) OVER () // 400) AS k FROM m) WHERE n % k = 0),
f AS (SELECT id, list_distinct(list_transform(regexp_extract_all(array_to_string(list_filter(list_concat(coalesce(to_addrs, []), coalesce(cc_addrs, [])), lambda x: x IS NOT NULL), ' '), '[A-Za-z0-9_.\\-+'']+@[A-Za-z0-9_.\\-]+\\.[A-Za-z]{{2,}}'), lambda x: lower(x))) AS found FROM m),
g AS (SELECT id, array_to_string(list_sort(list_filter(found, lambda x: NOT list_contains(list_concat(receivers, copied), x))), ';') AS missing FROM f JOIN nz USING (id) JOIN s USING (id)) SELECT id, missing FROM g WHERE missing <> ''""",
    "text_fingerprints": f"WITH {M} SELECT id, sha1('hashed-64/200/160/8' || chr(10) || {EMBEDDABLE}) AS print FROM m",
    "row_fingerprints": f"WITH {M} SELECT id, sha1(" + " || chr(10) || ".join(f"'{c}=' || coalesce('''' || {c} || '''', 'null')" for c in ("body", "date_text", "folder", "from_addr", "subject")) + ") AS print FROM m",
    "passage_vectors": f"""WITH {M}, w AS (SELECT id, list_filter(regexp_split_to_array(concat_ws(chr(10) || chr(10), nullif(subject, ''), nullif(body, '')), '{SPACE}+'), lambda x: x <> '') AS w FROM m), p AS (SELECT id || '#' || k AS key, array_to_string(w[k * 160 + 1 : k * 160 + 200], ' ') AS text FROM (SELECT id, w, unnest(range(0, least(8, greatest(1, ceil((len(w) - 200) / 160.0)::INT + 1)))) AS k FROM w WHERE len(w) > 0)),
{embedded('v', 'SELECT key, text FROM p', 'key')} SELECT p.key AS id, round(coalesce(sqrt(sum(x * x)), 0), 4) AS length, {_FIRST_TWO} FROM p LEFT JOIN v ON v.key = p.key GROUP BY ALL""",
    "incremental_vectors": f"WITH {_LIVE}, {embedded('v', 'SELECT id AS key, text FROM a', 'key')} SELECT a.id, CASE WHEN old IS NULL THEN 'new' WHEN old = text THEN 'reuse' ELSE 'again' END AS action, {_FIRST_TWO} FROM a LEFT JOIN b USING (id) LEFT JOIN v ON v.key = a.id GROUP BY a.id, action",
    "verify_gate": f"WITH {M}, t AS (SELECT id AS key, {EMBEDDABLE} AS text FROM m), {embedded('v', 'SELECT key, text FROM t', 'key')}, c AS (SELECT count(DISTINCT key) AS k FROM v) SELECT count(*) AS n, count(*) AS expected, true AS count_ok, any_value(k) AS with_vectors, count(*) > 0 AND any_value(k) > 0 AS smoke_ok FROM m, c",
    "known_words": f"WITH {DATED}, {ASK} SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest({tokens('text')}) AS term FROM qa) WHERE term IN (SELECT unnest({tokens('text')}) FROM documents)",
    "threads": _THREADED + " SELECT id, component FROM ec",
    "thread_counters": _THREADED + """, z AS (SELECT component, count(*) AS k FROM ec GROUP BY ALL), x AS (SELECT id, in_reply_to AS message_id FROM m UNION ALL SELECT id, unnest(ref_ids) FROM m)
SELECT (SELECT count(*) FROM x JOIN k USING (message_id) WHERE parent <> id) AS linked_by_headers, (SELECT count(DISTINCT component) FROM hc) - count(*) AS linked_by_subject_fallback, count(*) AS threads, count(*) FILTER (k > 1) AS multi_message_threads, max(k) AS largest FROM z""",
    "method_means": _MEANS + " SELECT method, queries, ndcg, mrr, recall FROM mn",
    "regression_gate": _MEANS + " SELECT b.ndcg AS previous, a.ndcg AS current, round(a.ndcg - b.ndcg, 4) AS delta, CASE WHEN a.queries = 0 THEN 'skipped' WHEN round(a.ndcg - b.ndcg, 4) < -0.02 THEN 'regression' ELSE 'ok' END AS verdict FROM mn a, mn b WHERE a.method = 'hybrid' AND b.method = 'bm25'",
    "boost_sweep": f"""WITH {DATED}, {ASK}, {bm25('o', EVEN, False)}, cfg(method, field, boost) AS (VALUES {_BOOSTS}), sf AS (SELECT query_id, field, id, sum(s) AS s FROM o_x GROUP BY ALL HAVING count(*) >= CASE WHEN any_value(k) <= 2 THEN any_value(k) ELSE any_value(k) // 2 END),
sc AS (SELECT method, query_id, id, round(max(cfg.boost * s), 6) AS score FROM sf JOIN cfg USING (field) GROUP BY ALL), runs AS (SELECT method, query_id, id, row_number() OVER (PARTITION BY method, query_id ORDER BY score DESC, id) AS rank FROM sc QUALIFY rank <= 120), {AUTH},
ir AS (SELECT query_id, doc_id AS id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS r FROM auth), ideal AS (SELECT query_id, sum(CASE WHEN r <= 10 THEN (pow(2, grade) - 1) / log2(r + 1) ELSE 0 END) AS idcg FROM ir GROUP BY ALL),
fo AS (SELECT method, query_id, sum(CASE WHEN rank <= 10 THEN (pow(2, grade) - 1) / log2(rank + 1) ELSE 0 END) AS dcg, min(rank) FILTER (grade >= 1) AS first FROM runs JOIN ir USING (query_id, id) GROUP BY ALL),
me AS (SELECT method, round(coalesce(dcg / nullif(idcg, 0), 0), 6) AS ndcg, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr FROM ideal CROSS JOIN (SELECT DISTINCT method FROM cfg) LEFT JOIN fo USING (method, query_id)),
av AS (SELECT method AS configuration, round(avg(ndcg), 4) AS ndcg, round(avg(mrr), 4) AS mrr FROM me GROUP BY ALL) SELECT configuration, ndcg, round(ndcg - (SELECT ndcg FROM av WHERE configuration = 'default subject^3'), 4) AS delta, mrr FROM av""",
    "model_grades": "SELECT doc_id AS id, nullif(regexp_extract(coalesce(text, ''), '[0-3]'), '')::INT AS grade FROM documents",
    "relevance_report": METRICS + """, g AS (SELECT method, split, category, count(*) AS queries, round(avg(ndcg), 4) AS ndcg, round(avg(mrr), 4) AS mrr, round(avg(recall), 4) AS recall FROM met JOIN judged_queries USING (query_id) GROUP BY GROUPING SETS ((method), (method, split), (method, category)))
SELECT CASE WHEN split IS NULL AND category IS NULL THEN 'all' WHEN category IS NULL THEN 'split ' || split ELSE 'category ' || category END AS part, '| ' || method || ' | ' || printf('%.4f', ndcg) || ' | ' || printf('%.4f', mrr) || ' | ' || printf('%.4f', recall) || ' | ' || queries || ' |' AS line FROM g""",
    "judged_by_both": "SELECT query_id, doc_id AS id FROM qrels WHERE source = 'human' AND query_id IS NOT NULL AND doc_id IS NOT NULL INTERSECT SELECT query_id, doc_id FROM qrels WHERE source <> 'human' EXCEPT SELECT query_id, doc_id FROM qrels WHERE grade IS NULL",
    "bench_summary": f"SELECT 'wall' AS stage, {_STAGE.format(v='wall_ms')} FROM latency_samples UNION ALL SELECT 'embed', {_STAGE.format(v='embed_ms')} FROM latency_samples",
    "p95_gate": "SELECT round(quantile_disc(wall_ms, 0.95) FILTER (status = 200), 1) AS p95, 300.0::DOUBLE AS target, round(quantile_disc(wall_ms, 0.95) FILTER (status = 200), 1) < 300 AS met FROM latency_samples",
    "recent_queries": "SELECT query_id, sampled_at AS at, hits FROM (SELECT * FROM latency_samples WHERE query_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sampled_at DESC NULLS LAST, sample_id DESC) = 1) ORDER BY sampled_at DESC NULLS LAST, sample_id DESC LIMIT 20",
}
