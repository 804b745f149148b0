"""SQL for the queries of what is served."""

from __future__ import annotations

from mailquarry.plans.oracle import _CELL, ASK, DATED, EVEN, FUSED, SPACE, TAGS, M, _quoted, bm25, facet, strip, tokens, topic

_NAME = (
    f"n0 AS (SELECT *, {strip('regexp_replace(regexp_replace(' + strip('regexp_replace(regexp_replace(coalesce(from_name, %s), %s, %s, %s), %s, %s, %s)' % (_quoted(''), _quoted('<[^>]*>'), _quoted(' '), _quoted('g'), _quoted(SPACE + '+'), _quoted(' '), _quoted('g'))) + ', %s, %s, %s), %s, %s, %s)' % (_quoted(chr(94) + chr(34) + '+|' + chr(34) + '+$'), _quoted(''), _quoted('g'), _quoted(chr(94) + chr(39) + '+|' + chr(39) + '+$'), _quoted(''), _quoted('g')))} AS nm FROM m),\n"
    f"named AS (SELECT *, CASE WHEN nm = '' OR regexp_matches(nm, '[=/@]') THEN '' WHEN length(nm) - length(replace(nm, ',', '')) = 1 AND {strip(chr(115) + 'plit_part(nm, %s, 1)' % _quoted(','))} <> '' AND {strip('split_part(nm, %s, 2)' % _quoted(','))} <> '' THEN left({strip('split_part(nm, %s, 2)' % _quoted(','))} || ' ' || {strip('split_part(nm, %s, 1)' % _quoted(','))}, 64) ELSE left(nm, 64) END AS shown FROM n0)"
)
_STATE = TAGS.replace("WITH RECURSIVE ", "")
#: The fused search with the folded tags beside it.
SEARCHED = FUSED.replace("WITH ", f"WITH RECURSIVE {_STATE}, ", 1)
_TOTALS = "tot AS (SELECT query_id, max(n) AS total FROM (SELECT query_id, count(*) AS n FROM l1 GROUP BY ALL UNION ALL SELECT query_id, count(*) FROM fused GROUP BY ALL) GROUP BY ALL)"
_KEYWORD = f"WITH {DATED}, {ASK}, {bm25('o', EVEN, False)}, top AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM o QUALIFY rank <= 120)"


def marked(text: str, words: str) -> str:
    """The text escaped, the words of the list marked; neighbours share a boundary, so it is done twice."""
    edge = r"[^\p{L}\p{N}\x{E000}\x{E001}]"
    pattern = f"'(?i)(^|{edge})(' || array_to_string({words}, '|') || ')($|{edge})'"
    once = f"regexp_replace({text}, {pattern}, '\\1' || chr(57344) || '\\2' || chr(57345) || '\\3', 'g')"
    twice = f"regexp_replace({once}, {pattern}, '\\1' || chr(57344) || '\\2' || chr(57345) || '\\3', 'g')"
    safe = f"replace(replace(replace(replace({twice}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;')"
    return f"replace(replace({safe}, chr(57344), '<em>'), chr(57345), '</em>')"


def highlighted(page: str) -> str:
    """CTE ``marks`` (query_id, id, subject_mark, fragments) over the pairs of ``page``."""
    words = tokens("concat_ws(' ', text, array_to_string(phrases, ' '))")
    body = f"trim(regexp_replace(left(coalesce(body, ''), 100000), '{SPACE}+', ' ', 'g'))"
    return f"""hw AS (SELECT query_id, list_sort(list_distinct({words})) AS w FROM qa WHERE len({words}) > 0),
hd AS (SELECT query_id, p.id, w, coalesce(subject, '') AS s, {body} AS b FROM ({page}) p JOIN hw USING (query_id) JOIN m ON m.id = p.id),
hp AS (SELECT query_id, id, w, generate_subscripts(x, 1) AS i, trim(unnest(x)) AS piece FROM (SELECT query_id, id, w, regexp_extract_all(b, '(\\S(?:.{{0,158}}\\S)?(?: |$)|\\S{{160}})', 1) AS x FROM hd)),
hm AS (SELECT query_id, id, i, {marked('piece', 'w')} AS t FROM hp),
hn AS (SELECT query_id, id, i, t, (length(t) - length(replace(t, '<em>', ''))) // 4 AS n FROM hm),
hb AS (SELECT query_id, id, i, t FROM hn WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY n DESC, i) <= 2),
hf AS (SELECT query_id, id, string_agg(t, ' ... ' ORDER BY i) AS fragments FROM hb GROUP BY ALL),
hs AS (SELECT query_id, id, {marked('s', 'w')} AS t FROM hd),
marks AS (SELECT query_id, id, CASE WHEN contains(t, '<em>') THEN t END AS subject_mark, fragments FROM hs LEFT JOIN hf USING (query_id, id))"""


_ISO = "strftime(ts AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ')"
_SEVERAL = lambda c: f"array_to_string(list_filter(coalesce({c}, []), lambda x: x IS NOT NULL), '; ')"
_CELLS = ", ".join(f"{_CELL(e)} AS {n}" for n, e in (("id", "m.id"), ("message_id", "message_id"), ("date", _ISO), ('"from"', "from_addr"), ('"to"', _SEVERAL("to_addrs")), ("cc", _SEVERAL("cc_addrs")), ("subject", "subject"), ("thread_id", "thread_id"), ("tags", "replace(tags, ',', '; ')")))
_STATE_TAGS = f"WITH RECURSIVE {_STATE}"
_NO_STOP = ", ".join(f"'{w}'" for w in "the a an of to and or in on for is are was were that this it with as at by be from".split())
_CONCEPTS = (
    "hiding:concealment spe restatement|hide:concealment spe|hidden:concealment spe|conceal:concealment|losses:writedown impairment restatement|loss:writedown impairment|writedown:writedown impairment|impairment:impairment writedown|"
    "fraud:concealment restatement whistleblower|partnership:spe ljm raptor|partnerships:spe ljm raptor|raptor:raptor spe|hedge:hedging raptor|hedges:hedging raptor|hedging:hedging|offbalance:spe|vehicle:spe|vehicles:spe|"
    "whistleblower:whistleblower|warned:whistleblower risk|warning:whistleblower risk|concerns:whistleblower risk|earnings:earnings disclosure|restate:restatement|restatement:restatement|trading:trading|california:california trading|"
    "power:power trading|gas:gas trading|legal:legal governance|board:board governance|audit:audit governance controls|merger:merger diligence|credit:credit counterparty liquidity|risk:risk|disclosure:disclosure|conflict:conflict governance"
)
_FW = lambda c: f"list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9'']+'), lambda t: length(t) > 1 AND t NOT IN ({_NO_STOP}))"
_FIX = f"""WITH {DATED}, {ASK.split('let AS')[0].rstrip().rstrip(',')},
fq AS (SELECT query_id, lower(unnest(regexp_split_to_array(text, '\\s+'))) AS word FROM qa),
ff AS (SELECT query_id, word, count(*) AS times FROM fq WHERE word <> '' AND word NOT IN ({_NO_STOP}) GROUP BY ALL),
flet AS (SELECT query_id, id FROM qa JOIN m ON (sender IS NULL OR contains(lower(coalesce(from_addr, '')), sender) OR contains(lower(coalesce(from_name, '')), sender)) AND (after IS NULL OR coalesce(ts >= (after || ' 00:00:00+00')::TIMESTAMPTZ, false)) WHERE sender IS NOT NULL OR after IS NOT NULL),
fp AS (SELECT id, part, term, count(*) AS n FROM (SELECT id, 's' AS part, unnest({_FW("coalesce(subject, '')")}) AS term FROM m UNION ALL SELECT id, 'b', unnest({_FW("concat_ws(' ', coalesce(body, ''), coalesce(quoted_text, ''))")}) FROM m) GROUP BY ALL),
fm AS (SELECT term, word, starts_with(term, word) AS begins FROM (SELECT DISTINCT term FROM fp), (SELECT DISTINCT word FROM ff) WHERE starts_with(term, word) OR (length(word) >= 5 AND abs(length(word) - length(term)) <= 2 AND levenshtein(term, word) <= CASE WHEN length(word) > 7 THEN 2 ELSE 1 END)),
fs AS (SELECT id, word, coalesce(sum(n * CASE WHEN part = 's' THEN 3 ELSE 1 END) FILTER (begins), 0.6)::DOUBLE AS s FROM fp JOIN fm USING (term) GROUP BY ALL),
fh AS (SELECT query_id, id, CASE WHEN contains(lower(coalesce(subject, '')), lower(p)) THEN 6.0 ELSE 0 END + CASE WHEN contains(lower(coalesce(body, '')), lower(p)) THEN 3.0 ELSE 0 END AS s FROM m, (SELECT query_id, unnest(phrases) AS p FROM qa) WHERE contains(lower(coalesce(subject, '')), lower(p)) OR contains(lower(coalesce(body, '')), lower(p))),
fk AS (SELECT query_id, id, round(sum(s), 6) AS score FROM (SELECT query_id, id, s * times AS s FROM fs JOIN ff USING (word) UNION ALL SELECT query_id, id, s::DOUBLE FROM fh) GROUP BY ALL),
lex AS (SELECT split_part(x, ':', 1) AS word, unnest(string_split(split_part(x, ':', 2), ' ')) AS concept FROM (SELECT unnest(string_split('{_CONCEPTS}', '|')) AS x)),
fw AS (SELECT query_id, concept, sum(times) AS n FROM ff JOIN lex USING (word) GROUP BY ALL),
fn AS (SELECT query_id, sqrt(sum(n * n)) AS norm FROM fw GROUP BY ALL),
fc AS (SELECT query_id, id, round(sum(n)::DOUBLE / (any_value(norm) * sqrt(any_value(k))), 9) AS score FROM (SELECT id, len(concepts) AS k, unnest(concepts) AS concept FROM m) JOIN fw USING (concept) JOIN fn USING (query_id) GROUP BY ALL),
fx AS (SELECT query_id, id FROM (SELECT query_id, id FROM fk UNION SELECT query_id, id FROM fc) JOIN qa USING (query_id) WHERE (sender IS NULL AND after IS NULL) OR (query_id, id) IN (SELECT (query_id, id) FROM flet)),
fr AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS bm25_rank FROM fk JOIN fx USING (query_id, id)),
fv AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS vector_rank FROM fc JOIN fx USING (query_id, id)),
fu AS (SELECT query_id, id, bm25_rank, vector_rank, round(coalesce(1.0::DOUBLE / (60 + bm25_rank), 0) + coalesce(1.0::DOUBLE / (60 + vector_rank), 0), 9) AS rrf FROM fr FULL JOIN fv USING (query_id, id)),
fz AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, id) AS rank FROM fu)"""
_NEEDLES = f"list_concat(list_transform(phrases, lambda p: lower(p)), list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '' AND w NOT IN ({_NO_STOP})))"
_RAW = f"list_filter(list_concat(phrases, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: lower(w) NOT IN ({_NO_STOP}))), lambda w: w <> '')"
_UNPREFIXED = "regexp_replace(coalesce(subject, ''), '(?i)^(re|fw|fwd):\\s*', '')"

SQL: dict[str, str] = {
    "search_hits": SEARCHED + f""", {_TOTALS}, {_NAME}
SELECT query_id, f.id, f.rank::INT AS rank, round(score, 6) AS score, bm25_rank::INT AS bm25_rank, vector_rank::INT AS vector_rank, coalesce(subject, '') AS subject, coalesce(from_addr, '') AS sender, shown AS sender_name, coalesce(has_attachment, false) AS has_attachment, coalesce(duplicate_count, 1) AS copies, coalesce(tags, '') AS tags, total
FROM fused f JOIN tot USING (query_id) JOIN named ON named.id = f.id LEFT JOIN state ON email_id = f.id WHERE f.rank <= 20""",
    "search_totals": FUSED + f", {_TOTALS} SELECT query_id, total FROM tot",
    "search_filters": f"WITH {DATED}, {ASK} SELECT query_id, id FROM let",
    "search_picked": f"{_STATE_TAGS}, {M} SELECT id FROM m WHERE folder IN ('inbox', 'sent', 'all documents') AND NOT coalesce(has_attachment, false) AND id IN (SELECT email_id FROM state WHERE list_has_any(string_split(tags, ','), ['privileged', 'hot', 'responsive']))",
    "search_facets": f"WITH {DATED}, {ASK}, {bm25('o', EVEN, True)}, e AS (SELECT DISTINCT * FROM (" + " UNION ALL ".join(f"SELECT query_id, id, '{n}' AS facet, unnest({v}) AS key FROM o JOIN m USING (id)" for n, v in (("senders", "[lower(from_addr)]"), ("recipients", "list_transform(list_concat(coalesce(to_addrs, []), coalesce(cc_addrs, [])), lambda x: lower(x))"), ("folders", "[folder]"), ("mailboxes", "[mailbox]"), ("has_attachment", "[has_attachment::VARCHAR]"))) + """)),
c AS (SELECT query_id, facet, key, count(*) AS n FROM e WHERE key <> '' GROUP BY ALL) SELECT query_id, facet, key, n FROM c QUALIFY row_number() OVER (PARTITION BY query_id, facet ORDER BY n DESC, key) <= CASE WHEN facet = 'has_attachment' THEN 2 ELSE 10 END""",
    "highlights": f"{_KEYWORD}, {highlighted('SELECT query_id, id FROM top WHERE rank <= 5')} SELECT query_id, id, subject_mark, fragments FROM marks",
    "search_snippets": FUSED + f""", {highlighted('SELECT query_id, id FROM fused WHERE rank <= 20')}, b0 AS (SELECT id, {strip("coalesce(body, '')")} AS b FROM m),
s AS (SELECT query_id, f.id, bm25_rank IS NULL AS semantic, coalesce(fragments, subject_mark, nullif({strip('pas.text')}, ''), CASE WHEN b <> '' THEN left(b, 240) || CASE WHEN length(b) > 240 THEN '...' ELSE '' END END, '') AS snippet
FROM fused f LEFT JOIN marks USING (query_id, id) LEFT JOIN pas ON pas.id = f.id AND pas.k = 0 LEFT JOIN b0 ON b0.id = f.id WHERE rank <= 20) SELECT query_id, id, snippet, CASE WHEN semantic THEN regexp_replace(snippet, '</?em>', '', 'g') END AS semantic_text FROM s""",
    "reranked_page": f"""{_KEYWORD}, op AS (SELECT query_id, text, list_distinct({tokens('text')}) AS w FROM qa WHERE sender IS NULL AND after IS NULL AND len(phrases) = 0 AND text <> ''),
hd AS (SELECT query_id, id, w, {tokens("trim(concat_ws(chr(10), " + strip("coalesce(subject, '')") + ", left(trim(regexp_replace(coalesce(body, ''), '" + SPACE + "+', ' ', 'g')), 1200)))")} AS d FROM top JOIN op USING (query_id) JOIN m USING (id) WHERE rank <= 50),
sc AS (SELECT query_id, id, round((len(list_intersect(w, d)) + 0.25 * len(list_intersect(w, d[1:20])))::DOUBLE / greatest(len(w), 1), 6) AS rerank_score FROM hd)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, id)::INT AS rank, rerank_score FROM sc
UNION ALL SELECT query_id, id, rank::INT, NULL FROM top WHERE rank > 50 OR query_id NOT IN (SELECT query_id FROM op)""",
    "export_complete": f"{_STATE_TAGS}, {DATED}, held AS (SELECT m.*, tags FROM m LEFT JOIN state ON email_id = m.id WHERE has_attachment), m2 AS (SELECT *, row_number() OVER (ORDER BY ts DESC NULLS LAST, message_id NULLS LAST, id) AS rank, count(*) OVER () AS total FROM held) SELECT rank, {_CELLS}, total > 50000 AS truncated FROM m2 m WHERE rank <= 50000",
    "export_ranked": _KEYWORD.replace("WITH ", f"WITH RECURSIVE {_STATE}, ", 1) + f" SELECT query_id, top.rank, {_CELLS} FROM top JOIN m ON m.id = top.id LEFT JOIN state ON email_id = top.id",
    "email_views": f"{_STATE_TAGS}, {DATED}, {_NAME} SELECT id, coalesce(subject, '') AS subject, coalesce(from_addr, '') AS sender, shown AS name, ts AS at, body, coalesce(tags, '') AS tags FROM named LEFT JOIN state ON email_id = id WHERE id IN (SELECT doc_id FROM qrels)",
    "thread_messages": f"{_STATE_TAGS}, {DATED}, t AS (SELECT thread_id, id, row_number() OVER (PARTITION BY thread_id ORDER BY ts NULLS LAST, id)::INT AS position, count(*) OVER (PARTITION BY thread_id) AS total FROM m WHERE thread_id IS NOT NULL QUALIFY position <= 100) SELECT thread_id, id, position, total, coalesce(tags, '') AS tags FROM t LEFT JOIN state ON email_id = id",
    "suggest_both": f"""WITH {M}, p AS (SELECT DISTINCT left(mailbox, 3) AS prefix FROM mailboxes), a AS (SELECT lower(from_addr) AS address, count(*) AS n FROM m WHERE from_addr IS NOT NULL GROUP BY ALL), c AS (SELECT s, count(*) AS n FROM (SELECT lower({topic('subject')}) AS s FROM m) WHERE s <> '' GROUP BY s),
x AS (SELECT prefix, 'person' AS kind, address AS value, n FROM p JOIN a ON starts_with(address, prefix) QUALIFY row_number() OVER (PARTITION BY prefix ORDER BY n DESC, address) <= 5), y AS (SELECT prefix, 'subject' AS kind, s AS value, n FROM p JOIN c ON contains(' ' || array_to_string({tokens('s')}, ' '), ' ' || prefix) QUALIFY row_number() OVER (PARTITION BY prefix ORDER BY n DESC, s) <= 5) FROM x UNION ALL FROM y""",
    "tag_batch": f"""{_STATE_TAGS}, w AS (SELECT DISTINCT doc_id AS email_id FROM qrels WHERE doc_id IS NOT NULL ORDER BY 1 LIMIT 500), j AS (SELECT coalesce(s.email_id, w.email_id) AS email_id, w.email_id IS NOT NULL AS asked, CASE WHEN coalesce(tags, '') = '' THEN []::VARCHAR[] ELSE string_split(tags, ',') END AS have, tagged_by FROM state s FULL JOIN w ON s.email_id = w.email_id),
k AS (SELECT *, list_sort(list_filter(list_distinct(list_concat(have, ['reviewed', 'second-pass'])), lambda t: t <> 'hot')) AS after FROM j), l AS (SELECT *, asked AND len(after) <= 16 AS ok FROM k)
SELECT email_id, array_to_string(CASE WHEN ok THEN after ELSE have END, ',') AS tags, CASE WHEN ok AND after <> have THEN 'batch' ELSE tagged_by END AS tagged_by, ok AND after <> have AS changed FROM l WHERE len(CASE WHEN ok THEN after ELSE have END) > 0""",
    "lens_bars": f"WITH {M}, f AS (" + " UNION ALL ".join([facet("senders", "[lower(from_addr)]"), facet("recipients", "list_transform(list_concat(coalesce(to_addrs, []), coalesce(cc_addrs, [])), lambda x: lower(x))"), facet("folders", "[folder]"), facet("mailboxes", "[mailbox]"), facet("has_attachment", "[has_attachment::VARCHAR]", 2)]) + ") SELECT facet, key, n, round(greatest(100.0::DOUBLE * n / max(n) OVER (PARTITION BY facet), 4), 3) AS width FROM f",
    "health": "SELECT 'green' AS status, 1::INT AS nodes, count(DISTINCT id) + count(DISTINCT CASE WHEN id IS NULL THEN 1 END) AS docs FROM emails",
    "display_dates": f"WITH {DATED}, u AS (SELECT id, ts AT TIME ZONE 'UTC' AS t FROM m WHERE ts IS NOT NULL) SELECT id, strftime(t, '%-d %b %Y') AS short, strftime(t, '%-d %b %Y at %H:%M UTC') AS long, strftime(t, '%b %Y') AS month, strftime(last_day(t), '%Y-%m-%d') AS last_day FROM u",
    "display_counts": """WITH s AS (SELECT *, floor(wall_ms * 10 + 0.5)::BIGINT AS tenths FROM latency_samples)
SELECT sample_id, CASE WHEN wall_ms >= 100 THEN floor(wall_ms + 0.5)::BIGINT::VARCHAR ELSE (tenths // 10)::VARCHAR || '.' || (tenths % 10)::VARCHAR END || ' ms' AS wall, format('{:,}', hits) || ' ' || CASE WHEN hits = 1 THEN 'email' ELSE 'emails' END AS found, format('{:,}', sample_id * 1000) AS grouped FROM s""",
    "reflowed": f"""WITH {M}, p AS (SELECT id, unnest(x) AS para, generate_subscripts(x, 1) AS i FROM (SELECT id, regexp_split_to_array(body, '\\n{{2,}}') AS x FROM m WHERE body IS NOT NULL)),
l AS (SELECT id, i, unnest(x) AS line, generate_subscripts(x, 1) AS j FROM (SELECT id, i, string_split(para, chr(10)) AS x FROM p)),
f AS (SELECT *, regexp_matches(line, '^\\s*([-*•>]|[0-9]+[.)]\\s|[A-Z][A-Za-z0-9_ ]{{0,24}}:\\s|___|===)') AS laid, lag(line) OVER w AS before, lag(regexp_matches(line, '^\\s*([-*•>]|[0-9]+[.)]\\s|[A-Z][A-Za-z0-9_ ]{{0,24}}:\\s|___|===)')) OVER w AS laid_before FROM l WINDOW w AS (PARTITION BY id, i ORDER BY j)),
g AS (SELECT *, coalesce(length(regexp_replace(before, '\\s+$', '')) >= 45 AND trim(line) <> '' AND NOT laid AND NOT laid_before, false) AS goes FROM f),
h AS (SELECT *, coalesce(lead(goes) OVER (PARTITION BY id, i ORDER BY j), false) AS next FROM g),
k AS (SELECT id, i, string_agg(CASE WHEN j = 1 THEN '' WHEN goes THEN ' ' ELSE chr(10) END || CASE WHEN next THEN regexp_replace(CASE WHEN goes THEN regexp_replace(line, '^\\s+', '') ELSE line END, '\\s+$', '') WHEN goes THEN regexp_replace(line, '^\\s+', '') ELSE line END, '' ORDER BY j) AS t FROM h GROUP BY ALL)
SELECT id, string_agg(t, chr(10) || chr(10) ORDER BY i) AS text FROM k GROUP BY ALL""",
    "decoded": f"WITH {M} SELECT id, body AS text FROM m WHERE body IS NOT NULL",
    "fixture_keywords": _FIX + " SELECT query_id, id, score FROM fk",
    "fixture_concepts": _FIX + " SELECT query_id, id, score FROM fc",
    "fixture_fused": _FIX + " SELECT query_id, id, rrf, rank::INT AS rank, bm25_rank::INT AS bm25_rank, vector_rank::INT AS vector_rank FROM fz",
    "fixture_page": _FIX + f""", cs AS (SELECT query_id, id, rank, CASE WHEN rank <= 50 AND len(phrases) = 0 AND sender IS NULL AND after IS NULL THEN round(list_sum(list_concat([0.0::DOUBLE], list_transform({_NEEDLES}, lambda n: CASE WHEN contains(hay, n) THEN 1.0::DOUBLE / (1 + (instr(hay, n) - 1) / 120.0::DOUBLE) ELSE 0 END))), 6) END AS "cross"
FROM fz JOIN qa USING (query_id) JOIN (SELECT id, lower(coalesce(subject, '') || ' ' || coalesce(body, '')) AS hay FROM m) USING (id)) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY (rank > 50)::INT, "cross" DESC NULLS LAST, rank)::INT AS position, rank::INT AS rank, "cross" FROM cs QUALIFY position <= 12""",
    "fixture_facets": f"""WITH {DATED}, e AS (SELECT 'senders' AS facet, from_addr AS key FROM m UNION ALL SELECT 'recipients', unnest(to_addrs) FROM m UNION ALL SELECT 'folders', folder FROM m UNION ALL SELECT 'topics', unnest(concepts) FROM m),
c AS (SELECT facet, key, count(*) AS n FROM e WHERE key IS NOT NULL GROUP BY ALL), h AS (SELECT date_trunc('month', ts AT TIME ZONE 'UTC')::DATE AS d, count(*) AS n FROM m WHERE ts IS NOT NULL GROUP BY ALL), r AS (SELECT unnest(generate_series((SELECT min(d) FROM h)::TIMESTAMP, (SELECT max(d) FROM h)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS d)
SELECT facet, key, n FROM c QUALIFY row_number() OVER (PARTITION BY facet ORDER BY n DESC, key) <= CASE WHEN facet = 'topics' THEN 10 ELSE 12 END UNION ALL SELECT 'months', strftime(d, '%Y-%m'), coalesce(n, 0)::BIGINT FROM r LEFT JOIN h USING (d) UNION ALL SELECT 'attachments', CASE WHEN len(coalesce(attachment_names, [])) > 0 THEN 'with' ELSE 'without' END, count(*) FROM m GROUP BY ALL""",
    "fixture_titles": f"WITH {DATED}, t AS (SELECT thread_id, arg_min({_UNPREFIXED}, (ts IS NULL, coalesce(ts, '1970-01-01'::TIMESTAMPTZ), id)) AS title, count(*) AS n FROM m WHERE thread_id IS NOT NULL GROUP BY ALL) SELECT thread_id, title, n FROM t",
    "fixture_fragments": _FIX + rf""", nd AS (SELECT query_id, '(?i)\b(' || array_to_string(list_transform(list_sort(list_transform({_RAW}, lambda w: {{'n': -length(w), 'w': w}})), lambda x: regexp_escape(x.w)), '|') || ')' AS pt FROM qa WHERE len({_RAW}) > 0),
tx AS (SELECT query_id, fz.id, pt, coalesce(body, '') || ' ' || coalesce(quoted_text, '') AS t FROM fz JOIN nd USING (query_id) JOIN m ON m.id = fz.id WHERE rank <= 12),
ix AS (SELECT *, CASE WHEN regexp_matches(t, pt) THEN length(regexp_split_to_array(t, pt)[1]) ELSE -1 END AS k FROM tx), st AS (SELECT *, greatest(0, k - 70) AS a FROM ix),
c1 AS (SELECT *, CASE WHEN a > 0 THEN '…' || regexp_replace(substr(t, a + 1, 220), '^\S*\s', '') ELSE substr(t, a + 1, 220) END AS f FROM st), c2 AS (SELECT *, CASE WHEN a + 220 < length(t) THEN regexp_replace(f, '\s\S*$', '') || '…' ELSE f END AS g FROM c1)
SELECT query_id, id, CASE WHEN k >= 0 THEN regexp_replace(g, pt, '<em>\1</em>', 'g') END AS fragment FROM c2""",
    "fixture_suggest": f"""WITH {M}, p AS (SELECT DISTINCT left(mailbox, 4) AS prefix FROM mailboxes), k AS (SELECT DISTINCT prefix, owner_addr AS address FROM p JOIN mailboxes ON contains(owner_addr, prefix) OR contains(lower(owner_name), prefix)),
s AS (SELECT DISTINCT id, unnest(list_concat([from_addr], coalesce(to_addrs, []))) AS address FROM m), c AS (SELECT address, count(*) AS n FROM s GROUP BY ALL), v AS (SELECT {_UNPREFIXED} AS value, min(arrival) AS first FROM m GROUP BY ALL)
SELECT prefix, 'person' AS kind, address AS value, coalesce(n, 0)::BIGINT AS n FROM k LEFT JOIN c USING (address) QUALIFY row_number() OVER (PARTITION BY prefix ORDER BY coalesce(n, 0) DESC, address) <= 4
UNION ALL SELECT prefix, 'subject', value, 1 FROM p JOIN v ON contains(lower(value), prefix) QUALIFY row_number() OVER (PARTITION BY prefix ORDER BY first) <= 4""",
}
