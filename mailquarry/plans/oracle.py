"""SQL that gives the same rows as the registered queries, for checking them side by side."""

from __future__ import annotations

# The patterns are written out here on their own, not taken from the operators they check.
WS = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SPACE = WS
BREAK = r"\r\n|[\n\x{0B}\x{0C}\r\x{1C}\x{1D}\x{1E}\x{85}\x{2028}\x{2029}]"
REPLY_MARKS = r"(?i)^\s*((re|fw|fwd|aw|sv)\s*:\s*)+"
FORWARD_CHAIN = r"(?i)^\s*((re|aw|sv)\s*:\s*)*fwd?\s*:"
STOPS = ["a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with"]


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


M = "m AS (SELECT * FROM emails WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY arrival) = 1)"
DATED = "m AS (SELECT *, date_trunc('second', ingested_at) AS ts FROM emails WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY arrival) = 1)"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def tokens(c: str) -> str:
    return f"regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}]+')"


def english(c: str) -> str:
    stops = ", ".join(f"'{w}'" for w in STOPS)
    return f"list_transform(list_filter({tokens(c)}, lambda t: NOT list_contains([{stops}], t)), lambda t: regexp_replace(regexp_replace(t, 'ies$', 'y'), '([^s])s$', '\\1'))"


def topic(c: str) -> str:
    return strip(f"regexp_replace(regexp_replace(coalesce({c}, ''), {_quoted(REPLY_MARKS)}, ''), '[ \\t]+', ' ', 'g')")


#: DuckDB measures edits in bytes, so letters beyond ASCII are first given one byte each.
_ODD = "áàâäãåæçéèêëíìîïñóòôöõøœúùûüýÿßłńśźżćęą"


def edits(a: str, b: str) -> str:
    signs = "".join(f"chr({i})" if k == 0 else f" || chr({i})" for k, i in enumerate([*range(1, 32), *range(58, 58 + len(_ODD) - 31)]))
    one = lambda c: f"translate({c}, '{_ODD}', {signs})"
    return f"damerau_levenshtein({one(a)}, {one(b)})"


ASK = """qa AS (SELECT query_id, trim(regexp_replace(regexp_replace(query, '"[^"]*"', ' ', 'g'), '(from|to|cc|subject|after|before):\\S+', ' ', 'g')) AS text,
  list_transform(regexp_extract_all(query, '"([^"]+)"', 1), lambda x: trim(x)) AS phrases, nullif(lower(regexp_extract(query, 'from:(\\S+)', 1)), '') AS sender, nullif(regexp_extract(query, 'after:(\\d{4}-\\d{2}-\\d{2})', 1), '') AS after FROM judged_queries WHERE query_id IS NOT NULL),
let AS (SELECT query_id, id FROM qa JOIN m ON (sender IS NULL OR lower(from_addr) = sender) AND (after IS NULL OR ts >= (after || ' 00:00:00+00')::TIMESTAMPTZ) WHERE sender IS NOT NULL OR after IS NOT NULL)"""
_MAIL = {"subject": ("subject", True), "body": ("body", True), "from": ("from_addr", False), "to": ("array_to_string(coalesce(to_addrs, []), ' ')", False)}


def bm25(name: str, boosts: dict[str, float], filtered: bool) -> str:
    """CTEs that end in ``name`` (query_id, id, score): the match set of terms and phrases."""
    n = name
    words = " UNION ALL ".join(f"SELECT id, '{f}' AS field, {(english if _MAIL[f][1] else tokens)(_MAIL[f][0])} AS w, {b}::DOUBLE AS boost FROM m" for f, b in boosts.items())
    terms = " UNION ".join(f"SELECT query_id, '{f}' AS field, unnest({(english if _MAIL[f][1] else tokens)('text')}) AS term FROM qa" for f in boosts)
    only = "WHERE (NOT EXISTS (FROM qa WHERE qa.query_id = x.query_id AND (sender IS NOT NULL OR after IS NOT NULL)) OR (x.query_id, x.id) IN (SELECT (query_id, id) FROM let))" if filtered else ""
    return f"""{n}_w AS ({words}),
{n}_t AS (SELECT *, count(*) OVER (PARTITION BY query_id, field) AS k FROM ({terms})),
{n}_st AS (SELECT field, count(*) AS n_docs, sum(len(w))::DOUBLE / count(*) AS avg_len FROM {n}_w GROUP BY ALL),
{n}_p AS (SELECT field, id, word, count(*) AS tf, any_value(n) AS len, any_value(boost) AS boost FROM (SELECT field, id, boost, unnest(w) AS word, len(w) AS n FROM {n}_w) GROUP BY ALL),
{n}_v AS (SELECT field, word, count(*) AS df FROM {n}_p GROUP BY ALL),
{n}_k AS (SELECT DISTINCT field, term, CASE WHEN length(term) < 5 THEN 0 WHEN length(term) < 8 THEN 1 ELSE 2 END AS edits FROM {n}_t),
{n}_e AS (SELECT field, term, word, df, {edits("term", "word")} AS d FROM {n}_k JOIN {n}_v USING (field) WHERE word[1] = term[1] AND abs(length(word) - length(term)) <= edits AND d <= edits
  QUALIFY row_number() OVER (PARTITION BY field, term ORDER BY d, df DESC, word) <= 50),
{n}_x AS (SELECT query_id, field, term, id, boost, k, max((1 - d::DOUBLE / least(length(term), length(word))) * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) AS s
  FROM {n}_t JOIN {n}_e USING (field, term) JOIN {n}_p USING (field, word) JOIN {n}_st USING (field) GROUP BY ALL),
{n}_f AS (SELECT query_id, id, sum(s) * any_value(boost) AS s FROM {n}_x x {only} GROUP BY query_id, id, field HAVING count(*) >= CASE WHEN any_value(k) <= 2 THEN any_value(k) ELSE any_value(k) // 2 END),
{n}_q AS (SELECT DISTINCT query_id, array_to_string({tokens('p')}, ' ') AS p FROM (SELECT query_id, unnest(phrases) AS p FROM qa) WHERE len({tokens('p')}) > 0),
{n}_d AS (SELECT id, ' ' || array_to_string({tokens('subject')}, ' ') || ' ' AS s, ' ' || array_to_string({tokens('body')}, ' ') || ' ' AS b FROM m),
{n}_h AS (SELECT query_id, id, count(*) AS got, sum(CASE WHEN contains(s, ' ' || p || ' ') THEN 3.0 ELSE 0 END + CASE WHEN contains(b, ' ' || p || ' ') THEN 1.0 ELSE 0 END)::DOUBLE AS s FROM {n}_q JOIN {n}_d ON contains(s, ' ' || p || ' ') OR contains(b, ' ' || p || ' ') GROUP BY ALL),
{n}_g AS (SELECT x.query_id, x.id, x.s FROM {n}_h x JOIN (SELECT query_id, count(*) AS need FROM {n}_q GROUP BY ALL) USING (query_id) {only + ' AND' if only else 'WHERE'} got = need),
{n} AS (SELECT query_id, id, round(sum(s), 6) AS score FROM (SELECT query_id, id, max(s) AS s FROM {n}_f GROUP BY ALL UNION ALL SELECT query_id, id, s FROM {n}_g) JOIN qa USING (query_id) GROUP BY query_id, id
  HAVING count(*) = any_value(CASE WHEN len({tokens('text')}) > 0 THEN 1 ELSE 0 END + CASE WHEN len(phrases) > 0 THEN 1 ELSE 0 END))"""


EVEN = {"subject": 1.0, "body": 1.0, "from": 1.0, "to": 1.0}
_WINDOWED = f"""SELECT id, w[k * 160 + 1 : k * 160 + 200] AS w, k FROM (SELECT id, w, unnest(range(0, least(8, greatest(1, ceil((len(w) - 200) / 160.0)::INT + 1)))) AS k FROM (SELECT id, list_filter(regexp_split_to_array(concat_ws(chr(10) || chr(10), nullif(subject, ''), nullif(body, '')), '{SPACE}+'), lambda x: x <> '') AS w FROM m) WHERE len(w) > 0)"""


def embedded(name: str, rows: str, key: str) -> str:
    """CTE ``name`` (key, dim, x): texts as hashed vectors of length one."""
    h = "('0x' || substr(md5(t), 1, 6))::INT"
    return f"""{name}_e AS (SELECT {key}, {h} % 64 AS dim, sum(CASE WHEN ({h} // 64) % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS x FROM (SELECT {key}, unnest({english('text')}) AS t FROM ({rows})) GROUP BY ALL),
{name} AS (SELECT {key}, dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY {key})), 6) AS x FROM {name}_e WHERE x <> 0)"""


VECTOR = f"""pas AS (SELECT id, k, array_to_string(w, ' ') AS text FROM ({_WINDOWED})),
{embedded('pv', 'SELECT id, k, text FROM pas', 'id, k')}, {embedded('qv', "SELECT query_id, concat_ws(' ', text, array_to_string(phrases, ' ')) AS text FROM qa", 'query_id')},
pn AS (SELECT id, k, sqrt(sum(x * x)) AS l FROM pv GROUP BY ALL), qn AS (SELECT query_id, sqrt(sum(x * x)) AS l FROM qv GROUP BY ALL),
vs AS (SELECT query_id, id, k, sum(qv.x * pv.x) AS dot FROM qv JOIN pv USING (dim) GROUP BY ALL),
vm AS (SELECT query_id, id, max(round(dot / (pn.l * qn.l), 6)) AS score FROM vs JOIN pn USING (id, k) JOIN qn USING (query_id) GROUP BY ALL),
vl AS (SELECT x.query_id, x.id, score, row_number() OVER (PARTITION BY x.query_id ORDER BY score DESC, x.id) AS rank FROM vm x JOIN qa USING (query_id)
  WHERE score > 0 AND ((sender IS NULL AND after IS NULL) OR (x.query_id, x.id) IN (SELECT (query_id, id) FROM let)) AND (len(phrases) = 0 OR (x.query_id, x.id) IN (SELECT (query_id, id) FROM l1_g)) QUALIFY rank <= 120)"""
LEGS = f"WITH {DATED}, {ASK}, {bm25('l1', EVEN, True)}, {VECTOR}, l1r AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM l1 QUALIFY rank <= 120)"
FUSED = LEGS + """, fu AS (SELECT query_id, id, b.rank AS bm25_rank, v.rank AS vector_rank, round(coalesce(1.0::DOUBLE / (60 + b.rank), 0) + coalesce(1.0::DOUBLE / (60 + v.rank), 0), 9) AS score FROM l1r b FULL JOIN vl v USING (query_id, id)),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fu QUALIFY rank <= 120)"""
RUNS = FUSED + """, runs AS (SELECT 'bm25' AS method, query_id, rank, id FROM l1r UNION ALL SELECT 'vector', query_id, rank, id FROM vl UNION ALL SELECT 'hybrid', query_id, rank, id FROM fused)"""
AUTH = """auth AS (SELECT query_id, doc_id, grade, source FROM qrels WHERE query_id IS NOT NULL AND doc_id IS NOT NULL AND grade IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY CASE source WHEN 'human' THEN 2 WHEN 'llm' THEN 1 ELSE 0 END DESC, source, grade) = 1)"""
METRICS = RUNS + f""", {AUTH},
ir AS (SELECT query_id, doc_id AS id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS r FROM auth),
ideal AS (SELECT query_id, sum(CASE WHEN r <= 10 THEN (pow(2, grade) - 1) / log2(r + 1) ELSE 0 END) AS idcg, count(*) FILTER (grade >= 1) AS relevant FROM ir GROUP BY ALL),
fo AS (SELECT method, query_id, sum(CASE WHEN rank <= 10 THEN (pow(2, grade) - 1) / log2(rank + 1) ELSE 0 END) AS dcg, min(rank) FILTER (grade >= 1) AS first, count(*) FILTER (grade >= 1 AND rank <= 50) AS found FROM runs JOIN ir USING (query_id, id) GROUP BY ALL),
met AS (SELECT method, query_id, round(coalesce(dcg / nullif(idcg, 0), 0), 6) AS ndcg, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr, round(coalesce(found::DOUBLE / nullif(relevant, 0), 0), 6) AS recall
  FROM ideal CROSS JOIN (SELECT DISTINCT method FROM runs) LEFT JOIN fo USING (method, query_id))"""
_CELL = lambda c: f"CASE WHEN regexp_matches(coalesce({c}, ''), '^[=+\\-@\\t\\r]') THEN '''' || coalesce({c}, '') ELSE coalesce({c}, '') END"
FUZZY = f"""WITH {DATED}, {ASK}, v AS (SELECT word, count(*) AS df FROM (SELECT DISTINCT id, unnest({tokens("subject")}) AS word FROM m) GROUP BY ALL),
qt AS (SELECT DISTINCT query_id, unnest({tokens("text")}) AS term FROM qa),
near AS (SELECT term, word, df, {edits("word", "term")} AS d FROM (SELECT DISTINCT term, CASE WHEN length(term) < 5 THEN 0 WHEN length(term) < 8 THEN 1 ELSE 2 END AS k FROM qt) JOIN v ON word[1] = term[1] AND abs(length(word) - length(term)) <= k WHERE d <= k
  QUALIFY row_number() OVER (PARTITION BY term ORDER BY d, df DESC, word) <= 50),
fix AS (SELECT query_id, term, arg_max(word, (df, word)) AS suggestion FROM qt JOIN near USING (term) WHERE d = 1 AND length(term) >= 5 AND term NOT IN (SELECT word FROM v) GROUP BY ALL)"""
_CLEAN_TAGS = lambda c: f"list_sort(list_distinct(list_filter(list_transform(coalesce({c}, []), lambda t: lower({strip('t')})), lambda t: regexp_matches(t, '^[a-z0-9][a-z0-9-]{{0,31}}$'))))"
TAGS = f"""WITH RECURSIVE e0 AS (SELECT DISTINCT ON (email_id, seq) email_id, seq, op, {_CLEAN_TAGS("add_tags")} AS a, {_CLEAN_TAGS("remove_tags")} AS r, tagged_by FROM tag_events WHERE email_id IS NOT NULL AND seq IS NOT NULL),
e AS (SELECT *, row_number() OVER (PARTITION BY email_id ORDER BY seq) AS n FROM e0),
f AS (SELECT email_id, 0::BIGINT AS n, []::VARCHAR[] AS tags, NULL::VARCHAR AS who FROM e WHERE n = 1
UNION ALL
SELECT f.email_id, e.n, CASE WHEN len(p.t) > 16 THEN f.tags ELSE p.t END,
  CASE WHEN len(p.t) > 16 THEN f.who ELSE e.tagged_by END
FROM f JOIN e ON e.email_id = f.email_id AND e.n = f.n + 1, LATERAL (SELECT CASE WHEN e.op = 'replace' THEN e.a ELSE list_sort(list_filter(list_distinct(list_concat(f.tags, e.a)), lambda t: NOT list_contains(e.r, t))) END AS t) p),
last AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY email_id ORDER BY n DESC) = 1),
state AS (SELECT email_id, array_to_string(tags, ',') AS tags, who AS tagged_by FROM last WHERE len(tags) > 0)"""
LINKS = f"""{M}, k AS (SELECT message_id, arg_min(id, (arrival, id)) AS parent FROM m WHERE message_id IS NOT NULL GROUP BY ALL),
a AS (SELECT id, in_reply_to AS message_id FROM m UNION SELECT id, unnest(ref_ids) FROM m),
links AS (SELECT DISTINCT id, parent FROM a JOIN k USING (message_id) WHERE parent <> id)"""
COMPONENTS = f"""WITH RECURSIVE {LINKS}, b AS (SELECT id AS u, parent AS v FROM links UNION SELECT parent, id FROM links),
reach AS (SELECT id AS u, id AS v FROM m UNION SELECT reach.u, b.v FROM reach JOIN b ON b.u = reach.v),
comp AS (SELECT u AS id, min(v) AS component FROM reach GROUP BY ALL)"""


def facet(name: str, values: str, size: int = 10) -> str:
    return f"(SELECT '{name}' AS facet, key, count(*) AS n FROM (SELECT DISTINCT id, unnest({values}) AS key FROM m) WHERE key IS NOT NULL AND key <> '' GROUP BY key ORDER BY n DESC, key LIMIT {size})"


SHARDS = "s AS (SELECT event_id, 'v1' AS \"index\", user_id % 1009 AS shard, event_id % 89 AS node, CASE WHEN event_type IN ('view', 'click') THEN 'p' ELSE 'r' END AS prirep FROM events)"
VECTORS = "v AS (SELECT vec_id AS id, embedding::DOUBLE[64] AS e, label FROM embeddings)"

EMBEDDABLE = f"concat_ws(chr(10) || chr(10), nullif({strip('coalesce(subject, %s)' % _quoted(''))}, ''), nullif({strip('coalesce(body, %s)' % _quoted(''))}, ''))"
_LOW = lambda c: f"list_distinct(list_filter(list_transform(coalesce({c}, []), lambda x: lower(x)), lambda x: x IS NOT NULL))"
PREDECESSORS = f"""{DATED}, pb AS (SELECT id, ts, lower(from_addr) AS who, {_LOW("to_addrs")} AS tos, {topic('subject')} AS topic, regexp_matches(coalesce(subject, ''), {_quoted(REPLY_MARKS)}) AS answers, regexp_matches(coalesce(subject, ''), {_quoted(FORWARD_CHAIN)}) AS forward FROM m),
po AS (SELECT topic, min(ts) AS oldest FROM pb GROUP BY ALL),
pj AS (SELECT a.id, b.id AS previous, b.ts AS b_at, CASE WHEN coalesce(list_contains(a.tos, b.who) AND a.who IS DISTINCT FROM b.who, false) THEN 2 WHEN coalesce(list_contains(b.tos, a.who), false) THEN 1 WHEN coalesce(a.who = b.who AND (list_has_any(a.tos, b.tos) OR a.forward), false) THEN 1 ELSE 0 END AS strength
FROM pb a JOIN pb b ON a.topic = b.topic AND a.topic <> '' AND a.answers AND a.id <> b.id JOIN po ON po.topic = a.topic
WHERE CASE WHEN b.ts IS NULL THEN (a.ts IS NULL AND b.id < a.id) OR (a.ts IS NOT NULL AND (oldest IS NULL OR oldest >= a.ts - INTERVAL 30 DAY)) ELSE a.ts IS NOT NULL AND (b.ts < a.ts OR (b.ts = a.ts AND b.id < a.id)) AND b.ts >= a.ts - INTERVAL 30 DAY END),
pred AS (SELECT id, previous, strength FROM pj WHERE strength > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY strength DESC, b_at DESC NULLS LAST, previous DESC) = 1)"""

SQL: dict[str, str] = {
    "canonical_ids": f"WITH {M} SELECT id, sha1(coalesce(lower(from_addr), '') || chr(10) || lower(array_to_string(list_sort(list_concat(coalesce(to_addrs, []), coalesce(cc_addrs, []))), ',')) || chr(10) || coalesce(date_text, '') || chr(10) || {strip('coalesce(subject, %s)' % _quoted(''))} || chr(10) || {strip('coalesce(body, %s)' % _quoted(''))}) AS canonical FROM m",
    "dedupe_merge": """WITH d AS (SELECT id, arg_min(struct_pack(s := subject, f := from_addr), arrival) AS f, count(*) AS deliveries FROM emails WHERE id IS NOT NULL GROUP BY ALL),
x AS (SELECT id, mailbox, min(arrival) AS a FROM emails WHERE mailbox <> '' GROUP BY ALL), y AS (SELECT id, folder, min(arrival) AS a FROM emails WHERE folder <> '' GROUP BY ALL)
SELECT d.id, f.s AS subject, f.f AS from_addr, coalesce((SELECT string_agg(mailbox, ',' ORDER BY a) FROM x WHERE x.id = d.id), '') AS mailboxes, coalesce((SELECT string_agg(folder, ',' ORDER BY a) FROM y WHERE y.id = d.id), '') AS folders, deliveries FROM d""",
    "subject_normalise": f"WITH {M} SELECT id, {topic('subject')} AS topic, regexp_matches(coalesce(subject, ''), {_quoted(REPLY_MARKS)}) AS answers, regexp_matches(coalesce(subject, ''), {_quoted(FORWARD_CHAIN)}) AS forward FROM m",
    "split_quoted": f"""WITH {M}, l AS (SELECT id, regexp_split_to_array(coalesce(body, ''), {_quoted(BREAK)}) AS l FROM m),
c AS (SELECT id, l, coalesce(list_position(list_transform(l, lambda x: regexp_matches(x, '(?i)^\\s*--+\\s*original message\\s*--') OR regexp_matches(x, '(?i)^\\s*--+\\s*forwarded by\\b') OR regexp_matches(x, '^\\s*_{{10,}}\\s*$') OR regexp_matches(x, '(?i)^\\s*on\\b.{{0,160}}\\bwrote:\\s*$') OR ltrim(x, ' ' || chr(9))[1] = '>'), true), len(l) + 1) AS cut FROM l)
SELECT id, {strip("array_to_string(l[1:cut - 1], chr(10))")} AS new_text, {strip("array_to_string(l[cut:], chr(10))")} AS quoted_text FROM c""",
    "display_names": f"""WITH {M}, n AS (SELECT id, from_addr, to_addrs, {strip("regexp_replace(regexp_replace(" + strip("regexp_replace(regexp_replace(coalesce(from_name, ''), '<[^>]*>', ' ', 'g'), '" + SPACE + "+', ' ', 'g')") + ", '^\"+|\"+$', '', 'g'), '^''+|''+$', '', 'g')")} AS name FROM m),
p AS (SELECT *, {strip("split_part(name, ',', 1)")} AS l, {strip("split_part(name, ',', 2)")} AS f FROM n)
SELECT id, CASE WHEN name = '' OR regexp_matches(name, '[=/@]') THEN '' WHEN length(name) - length(replace(name, ',', '')) = 1 AND l <> '' AND f <> '' THEN left(f || ' ' || l, 64) ELSE left(name, 64) END AS name,
array_to_string(list_transform(list_filter(regexp_split_to_array(split_part(lower(from_addr), '@', 1), '[._-]'), lambda x: x <> ''), lambda x: upper(x[1]) || x[2:]), ' ') AS person,
CASE WHEN len(to_addrs) > 2 THEN array_to_string(to_addrs[1:2], ', ') || ' and ' || (len(to_addrs) - 2)::VARCHAR || ' more' ELSE array_to_string(to_addrs, ', ') END AS label FROM p""",
    "normalise_addresses": f"""WITH {M}, t AS (SELECT id, unnest(to_addrs) AS x, generate_subscripts(to_addrs, 1) AS i FROM m), u AS (SELECT id, lower({strip('x')}) AS x, min(i) AS i FROM t GROUP BY ALL HAVING x <> '')
SELECT id, lower({strip("regexp_replace(" + strip("from_addr") + ", '^<+|>+$', '', 'g')")}) AS person_id, coalesce((SELECT string_agg(x, ';' ORDER BY i) FROM u WHERE u.id = m.id), '') AS recipients FROM m""",
    "missing_counters": f"WITH {M} SELECT count(*) AS processed, count(*) FILTER (coalesce(from_addr, '') = '') AS no_sender, count(*) FILTER (coalesce(subject, '') = '') AS no_subject, count(*) FILTER (coalesce(body, '') = '') AS no_body, count(*) FILTER (coalesce(date_text, '') = '') AS no_date, count(*) FILTER (len(coalesce(to_addrs, [])) = 0) AS no_recipients FROM m",
    "reply_links": f"WITH {LINKS} SELECT id, parent FROM links",
    "thread_components": COMPONENTS + " SELECT id, component FROM comp",
    "thread_stats": COMPONENTS + ", z AS (SELECT component, count(*) AS n FROM comp GROUP BY ALL) SELECT count(*) AS threads, count(*) FILTER (n > 1) AS multi_message_threads, max(n) AS largest FROM z",
    "best_predecessor_30d": "WITH " + PREDECESSORS + " SELECT id, previous, strength FROM pred",
    "chunk_windows": f"""WITH {M}, t AS (SELECT id, list_filter(regexp_split_to_array(concat_ws(chr(10) || chr(10), nullif(subject, ''), nullif(body, '')), '{SPACE}+'), lambda x: x <> '') AS w FROM m),
c AS (SELECT id, w, unnest(range(0, least(8, greatest(1, ceil((len(w) - 200) / 160.0)::INT + 1)))) AS k FROM t WHERE len(w) > 0)
SELECT id, k::INT AS chunk_no, len(w[k * 160 + 1 : k * 160 + 200])::INT AS n_tokens, array_to_string(w[k * 160 + 1 : k * 160 + 200], ' ') AS chunk FROM c""",
    "incremental_reuse": f"""WITH r AS (SELECT id, arrival, {EMBEDDABLE} AS x FROM emails WHERE id IS NOT NULL), h AS (SELECT (min(arrival) + max(arrival)) // 2 AS h FROM r),
a AS (SELECT id, arg_max(x, arrival) AS x FROM r GROUP BY ALL), b AS (SELECT id, arg_max(x, arrival) AS y FROM r, h WHERE arrival <= h GROUP BY ALL)
SELECT id, CASE WHEN y IS NULL THEN 'new' WHEN x = y THEN 'reuse' ELSE 'again' END AS action FROM a LEFT JOIN b USING (id)""",
    "sample_whole_groups": f"WITH {M}, s AS (SELECT mailbox, count(*) AS n FROM m WHERE mailbox IS NOT NULL GROUP BY ALL) SELECT mailbox, n, coalesce(sum(n) OVER (ORDER BY sha1(mailbox), mailbox ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM s QUALIFY before < 500",
    "step_sample": f"WITH {M}, n AS (SELECT id, row_number() OVER (ORDER BY arrival, id) - 1 AS row_no, greatest(1, count(*) OVER () // 100) AS k FROM m) SELECT id, row_no FROM n WHERE row_no % k = 0",
    "bm25_topk": f"WITH {DATED}, {ASK}, {bm25('o', EVEN, False)} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM o QUALIFY rank <= 10",
    "phrase_matches": f"WITH {DATED}, {ASK}, {bm25('o', {'subject': 1.0}, False)} SELECT query_id, id FROM o_g",
    "rrf_fusion": FUSED + " SELECT query_id, id, score, rank::INT AS rank, bm25_rank::INT AS bm25_rank, vector_rank::INT AS vector_rank FROM fused",
    "hybrid_page": FUSED + " SELECT query_id, id, rank::INT AS rank, max(rank) OVER (PARTITION BY query_id) > 20 AS more FROM fused QUALIFY rank > 10 AND rank <= 20",
    "fuzzy_terms": FUZZY + " SELECT term, word, df, d::INT AS d FROM near",
    "spelling_fix": FUZZY + " SELECT query_id, term, suggestion FROM fix",
    "knn_topk": f"WITH {VECTORS}, s AS (SELECT q.id AS query_id, v.id, round(array_cosine_similarity(q.e, v.e), 6) AS score FROM v q JOIN v ON q.id % 50 = 0) SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM s QUALIFY rank <= 10",
    "knn_filtered_collapse": f"WITH {VECTORS}, s AS (SELECT q.id AS query_id, v.id, v.label, round(array_cosine_similarity(q.e, v.e), 6) AS score FROM v q JOIN v ON q.id % 50 = 0 AND v.label % 2 = 0), k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 120) SELECT query_id, label, id, score FROM k QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, id) = 1",
    "filtered_search": f"WITH {DATED}, {ASK}, {bm25('o', EVEN, True)} SELECT query_id, id FROM o JOIN qa USING (query_id) WHERE sender IS NOT NULL OR after IS NOT NULL",
    "facet_terms": f"WITH {M} " + " UNION ALL ".join([facet("senders", "[lower(from_addr)]"), facet("recipients", "list_transform(list_concat(coalesce(to_addrs, []), coalesce(cc_addrs, [])), lambda x: lower(x))"), facet("folders", "[folder]"), facet("mailboxes", "[mailbox]"), facet("has_attachment", "[has_attachment::VARCHAR]", 2)]),
    "facet_month_histogram": f"WITH {DATED} SELECT strftime(ts AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS n FROM m WHERE ts IS NOT NULL GROUP BY ALL",
    "histogram_gapfill": f"""WITH {DATED}, h AS (SELECT folder, date_trunc('month', ts AT TIME ZONE 'UTC')::DATE AS d, count(*) AS n FROM m WHERE ts IS NOT NULL GROUP BY ALL),
r AS (SELECT folder, unnest(generate_series(min(d)::TIMESTAMP, max(d)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS d FROM h GROUP BY folder) SELECT r.folder, strftime(r.d, '%Y-%m') AS month, coalesce(n, 0)::BIGINT AS n FROM r LEFT JOIN h ON h.d = r.d AND h.folder IS NOT DISTINCT FROM r.folder""",
    "thread_view": f"WITH {DATED} SELECT thread_id, id, row_number() OVER (PARTITION BY thread_id ORDER BY ts NULLS LAST, id)::INT AS position, count(*) OVER (PARTITION BY thread_id) AS total FROM m WHERE thread_id IS NOT NULL QUALIFY position <= 100",
    "suggest_people": f"WITH {M}, p AS (SELECT DISTINCT left(mailbox, 2) AS prefix FROM mailboxes), c AS (SELECT lower(from_addr) AS address, count(*) AS n FROM m WHERE from_addr IS NOT NULL GROUP BY ALL) SELECT prefix, address, n FROM p JOIN c ON starts_with(address, prefix) QUALIFY row_number() OVER (PARTITION BY prefix ORDER BY n DESC, address) <= 5",
    "suggest_subjects": f"""WITH {M}, p AS (SELECT DISTINCT regexp_extract(query, '^([a-z]+ [a-z]{{2}})', 1) AS prefix FROM judged_queries), c AS (SELECT s AS subject, count(*) AS n FROM (SELECT lower({topic('subject')}) AS s FROM m) WHERE s <> '' GROUP BY s)
SELECT prefix, subject, n FROM p JOIN c ON prefix <> '' AND contains(' ' || array_to_string({tokens('subject')}, ' '), ' ' || prefix) QUALIFY row_number() OVER (PARTITION BY prefix ORDER BY n DESC, subject) <= 10""",
    "tag_fold": TAGS + " SELECT email_id, tags, tagged_by FROM state",
    "tag_counts": TAGS + " SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(tags, ',')) AS tag FROM state) GROUP BY ALL ORDER BY n DESC, tag LIMIT 200",
    "tag_filter": TAGS + f", {M} SELECT id, subject FROM m WHERE id IN (SELECT email_id FROM state WHERE list_has_any(string_split(tags, ','), ['privileged', 'hot']))",
    "export_rows": f"WITH {M} SELECT {_CELL('id')} AS id, {_CELL('from_addr')} AS from_addr, {_CELL('array_to_string(to_addrs, %s)' % _quoted('; '))} AS to_addrs, {_CELL('subject')} AS subject, {_CELL('folder')} AS folder FROM m",
    "judgment_precedence": f"WITH {AUTH} SELECT query_id, doc_id, grade, source FROM auth",
    "ndcg_mrr_recall": METRICS + " SELECT method, query_id, ndcg, mrr, recall FROM met",
    "eval_grouping_sets": METRICS + " SELECT method, coalesce(split, '*') AS split, coalesce(category, '*') AS category, count(*) AS queries, round(avg(ndcg), 5) AS ndcg, round(avg(mrr), 5) AS mrr, round(avg(recall), 5) AS recall FROM met JOIN judged_queries USING (query_id) GROUP BY GROUPING SETS ((method), (method, split), (method, category))",
    "pool_union": RUNS + " SELECT DISTINCT query_id, id FROM runs WHERE rank <= 20",
    "label_todo": RUNS + " SELECT DISTINCT query_id, id FROM runs WHERE rank <= 20 AND (query_id, id) NOT IN (SELECT (query_id, doc_id) FROM qrels WHERE (source = 'human' OR source LIKE 'auto:%') AND grade IS NOT NULL AND query_id IS NOT NULL AND doc_id IS NOT NULL)",
    "auto_grade": RUNS + f""", po AS (SELECT DISTINCT query_id, id FROM runs WHERE rank <= 20),
h AS (SELECT query_id, po.id, phrases, sender IS NOT NULL OR after IS NOT NULL AS filtered, {tokens("text")} AS terms, (sender IS NULL OR lower(from_addr) = sender) AND (after IS NULL OR coalesce((ts AT TIME ZONE 'UTC')::DATE >= after::DATE, false)) AS fits, lower(coalesce(subject, '') || chr(10) || coalesce(body, '')) AS x FROM po JOIN qa USING (query_id) JOIN m ON m.id = po.id),
g AS (SELECT *, len(list_filter(list_distinct(terms), lambda t: contains(x, t))) AS hits, len(list_distinct(terms)) AS k FROM h),
r AS (SELECT query_id, id, CASE WHEN filtered AND k > 0 THEN 'both' WHEN filtered THEN 'filter' WHEN len(phrases) > 0 THEN 'phrase' ELSE 'terms' END AS kind, * EXCLUDE (query_id, id) FROM g)
SELECT query_id, id, 'auto:' || kind AS source, (CASE kind WHEN 'phrase' THEN CASE WHEN contains(x, lower(phrases[1])) THEN 3 ELSE 0 END WHEN 'filter' THEN CASE WHEN fits THEN 3 ELSE 0 END
  WHEN 'both' THEN CASE WHEN NOT coalesce(fits, false) THEN 0 WHEN hits > 0 THEN 3 ELSE 1 END ELSE CASE WHEN hits = 0 THEN 0 WHEN hits = k THEN 3 ELSE 2 END END)::INT AS grade FROM r""",
    "judgment_coverage": "SELECT category, source, count(*) AS n, count(DISTINCT query_id) AS queries, count(*) FILTER (grade IS NULL) AS ungraded FROM qrels JOIN judged_queries USING (query_id) GROUP BY ALL",
    "latency_percentiles": """SELECT query_id, count(*) FILTER (status = 200) AS n, round(avg(wall_ms) FILTER (status = 200), 1) AS mean, round(quantile_disc(wall_ms, 0.5) FILTER (status = 200), 1) AS p50, round(quantile_disc(wall_ms, 0.95) FILTER (status = 200), 1) AS p95,
round(quantile_disc(wall_ms, 0.99) FILTER (status = 200), 1) AS p99, round(max(wall_ms) FILTER (status = 200), 1) AS most, round(avg(CASE WHEN status = 200 THEN 1.0 ELSE 0.0 END), 6) AS success FROM latency_samples GROUP BY ALL""",
    "phase_bucketing": """WITH a AS (SELECT min(sampled_at) AS a FROM latency_samples), x AS (SELECT CASE WHEN sampled_at < a + INTERVAL 60 SECOND THEN 'before' WHEN sampled_at < a + INTERVAL 200 SECOND THEN 'during' ELSE 'after' END AS phase, status FROM latency_samples, a WHERE sampled_at IS NOT NULL)
SELECT phase, count(*) AS n, count(*) FILTER (status <> 200) AS failed FROM x GROUP BY ALL""",
    "status_transitions": "WITH s AS (SELECT query_id, sampled_at, sample_id AS seq, CASE WHEN status = 200 THEN 'up' ELSE 'down' END AS state FROM latency_samples) SELECT query_id, seq, state FROM (SELECT *, lag(state) OVER (PARTITION BY query_id ORDER BY sampled_at, seq) AS b FROM s) WHERE state IS DISTINCT FROM b",
    "promoted_replicas": f"WITH {SHARDS}, h AS (SELECT (min(event_id) + max(event_id)) // 2 AS h FROM s) SELECT DISTINCT \"index\", shard FROM s, h WHERE prirep = 'p' AND event_id > h AND (shard, node) IN (SELECT (shard, node) FROM s, h WHERE prirep = 'r' AND event_id <= h)",
    "busiest_primary": f"WITH {SHARDS} SELECT node, count(*) AS n FROM s WHERE prirep = 'p' GROUP BY ALL ORDER BY n DESC, node LIMIT 1",
    "facet_rollup": "SELECT strftime(l_shipdate, '%Y-%m') AS month, l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (1, 2)",
    "hydrate_topk": "SELECT o_custkey, c_name, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders JOIN customer ON c_custkey = o_custkey QUALIFY rank <= 3",
}
